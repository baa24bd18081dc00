"""BPE encoding and decoding with reuse of content-defined chunks.

A rolling (gear) hash over the last 32 bytes cuts every text where its low bits are
zero, so passages that documents share give the same chunks wherever they stand. A
chunk's core, from its first to its last white space, is encoded once and reused for
every document that holds it; within a core that is new, words seen before are reused
the same way. A cut may fall inside a word: there the two fragments are joined and
encoded again together with their neighbour words, and the window grows until its
encoding agrees with what both sides already have (at worst it becomes the text).

Chunks and words are kept per worker process in tables bounded by bytes and entries
(words in two generations, so that those in use stay); what falls out is encoded again, so the bounds cost time and never change a result.
Keys are the bytes themselves, not their hashes.

All this rests on words that never depend on each other across white space and on a decoder
that joins tokens with spaces. ``independent_words`` proves both from the tokenizer's file when it is
loaded; a file it cannot vouch for is used whole, text by text.

Null texts count as empty (no ids, empty decoded text); very long texts are encoded whole. Rows are independent: ties,
repeated rows, extra columns and empty tables need no rule. No shuffle.
"""

from __future__ import annotations

import json
import os
import struct

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from thermalis.llm.arrowio import map_texts

SPACES = b" \t\n\r\x0b\x0c"
#: A cut every so many bytes on average (a power of two).
CHUNK_BYTES = 2048
#: Words of the younger generation before it becomes the older one; bytes of chunks.
WORDS_KEPT, CHUNK_BYTES_KEPT = 250_000, 24 << 20
_LOADED: dict = {}


def gear_table():
    import numpy as np

    return np.random.default_rng(20240229).integers(0, 1 << 32, 256, dtype=np.uint32)


def cut_points(raw: bytes, table, average: int = CHUNK_BYTES) -> list[int]:
    """Ends of chunks inside ``raw``: where the hash of the last 32 bytes ends in zeros."""
    import numpy as np

    if len(raw) <= 32:
        return []
    h = table[np.frombuffer(raw, np.uint8)]
    for shift in (1, 2, 4, 8, 16):  # h[i] = sum of table[byte i-k] << k for k < 32, by doubling
        h[shift:] += h[:-shift] << np.uint32(shift)
    # the high bits depend on all 32 bytes
    at = np.flatnonzero((h[31:] >> np.uint32(16)) % np.uint32(average) == 0) + 32
    return at[at < len(raw)].tolist()


#: Alternatives of a splitting pattern that match no white space (fixed values: contractions, letters, one digit, the rest).
_SPACELESS = {"'s", "'t", "'re", "'ve", "'m", "'ll", "'d", r"[\p{L}]+", r"[\p{N}]", r"[^\s\p{L}\p{N}]+"}


def independent_words(tokenizer: dict) -> bool:
    """Whether a tokenizer file's settings make the text between white space independent of what surrounds it.

    The normalizer may compose (no character composes with white space), lower-case and
    turn runs of white space into spaces; the pre-tokenizer must drop white space by a pattern whose
    alternatives match none; added tokens must hold none; and tokens are joined with spaces.
    """
    steps = lambda part, name: part[name] if part and part["type"] == "Sequence" else [part]
    normal = steps(tokenizer["normalizer"], "normalizers")
    split, *bytes_ = steps(tokenizer["pre_tokenizer"], "pretokenizers")
    return (
        {s["type"] for s in normal} == {"NFC", "Replace", "Lowercase"}
        and all(s["type"] != "Replace" or (s["pattern"] == {"Regex": r"\s+"} and s["content"] == " ") for s in normal)
        and split["type"] == "Split"
        and split["behavior"] == "Removed"
        and split["invert"]
        and set(split["pattern"].get("Regex", " ").split("|")) <= _SPACELESS
        and all(s["type"] == "ByteLevel" and not s["add_prefix_space"] and not s["use_regex"] for s in bytes_)
        and all(t["content"].startswith("<|") and not any(c.isspace() for c in t["content"]) and not (t["lstrip"] or t["rstrip"] or t["normalized"]) for t in tokenizer["added_tokens"])
        and tokenizer["model"]["type"] == "BPE"
        and not tokenizer["model"]["dropout"]
        and tokenizer["post_processor"] is None
        and tokenizer["decoder"] is None
    )


class Codec:
    def __init__(self, path: str):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")  # a task has one core
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.no_truncation()
        self.tokenizer.no_padding()
        with open(path, encoding="utf-8") as f:
            self.proven = independent_words(json.load(f))
        self.table = gear_table()
        #: Chunks met, and those of them that had to be encoded.
        self.met = self.encoded = 0
        self.words: dict[bytes, tuple[bytes, str]] = {}
        self.older: dict[bytes, tuple[bytes, str]] = {}
        self.chunks: dict[bytes, tuple[bytes, str]] = {}
        self.chunk_bytes = 0

    def library(self, texts: list[str]) -> list[tuple[bytes, str]]:
        ids = [e.ids for e in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]
        shown = self.tokenizer.decode_batch(ids, skip_special_tokens=False)
        return [(struct.pack(f"<{len(i)}I", *i), s) for i, s in zip(ids, shown, strict=True)]

    def learn(self, words: set[bytes]) -> None:
        new = []
        for w in words:
            if w not in self.words:
                known = self.older.get(w)
                if known is None:
                    new.append(w)
                else:
                    self.words[w] = known
        for i in range(0, len(new), 4096):
            part = new[i : i + 4096]
            self.words.update(zip(part, self.library([w.decode() for w in part]), strict=True))

    def core(self, core: bytes) -> tuple[bytes, str]:
        found = self.chunks.get(core)
        self.met += 1
        if found is None:
            self.encoded += 1
            got = [self.words[w] for w in core.split()]
            found = b"".join([g[0] for g in got]), " ".join([g[1] for g in got if g[1]])
            size = len(core) + len(found[0]) + len(found[1]) + 300
            if self.chunk_bytes + size > CHUNK_BYTES_KEPT:
                self.chunks.clear()
                self.chunk_bytes = 0
            self.chunks[core] = found
            self.chunk_bytes += size
        return found

    def parts(self, text: str) -> tuple[bytes, list[tuple[int, int, bool]]]:
        """(text's bytes, spans in order; True: a word that a cut went through)."""
        raw = text.encode()
        if b"<|" not in raw:  # special strings are looked for before letters are lowered
            raw = raw.lower()
        spans, start = [], 0
        for cut in cut_points(raw, self.table):
            if cut <= start:
                continue
            if raw[cut - 1] in SPACES or raw[cut] in SPACES:
                left = right = cut
            else:
                left = max(start, max(raw.rfind(s, start, cut) for s in (b" ", b"\n", b"\t", b"\r", b"\x0b", b"\x0c")) + 1)
                right = min((x for x in (raw.find(s, cut) for s in (b" ", b"\n", b"\t", b"\r", b"\x0b", b"\x0c")) if x >= 0), default=len(raw))
            if left > start:
                spans.append((start, left, False))
            if right > left:
                spans.append((left, right, True))
            start = right
        if start < len(raw):
            spans.append((start, len(raw), False))
        return raw, spans

    def repair(self, raw: bytes, left: int, right: int) -> tuple[bytes, str]:
        """Encode the word at left:right among more and more of its neighbours until they agree."""
        reach = 48
        while True:
            a = max(0, left - reach)
            while a > 0 and raw[a - 1] not in SPACES:
                a -= 1
            b = min(len(raw), right + reach)
            while b < len(raw) and raw[b] not in SPACES:
                b += 1
            before, word, after, window = self.library([raw[a:left].decode(), raw[left:right].decode(), raw[right:b].decode(), raw[a:b].decode()])
            if before[0] + word[0] + after[0] == window[0]:
                return word
            if a == 0 and b == len(raw):
                raise ValueError("this tokenizer's words depend on each other across white space")
            reach *= 4

    def encode(self, texts: list[str]) -> tuple[list[bytes], list[str]]:
        """Ids as little-endian unsigned 32-bit integers, and the decoded text, of each text."""
        if not self.proven:
            got = self.library(texts)
            return [g[0] for g in got], [g[1] for g in got]
        if len(self.words) > WORDS_KEPT:  # between slices only: a slice needs what it has learnt
            self.older, self.words = self.words, {}
        cut = [self.parts(t) for t in texts]
        new = set()
        for raw, spans in cut:
            for a, b, joint in spans:
                if not joint and raw[a:b] not in self.chunks:
                    new.update(raw[a:b].split())
        self.learn(new)
        # most joints agree with one word on each side: all of a slice at once
        joints = [(raw, a, b) for raw, spans in cut for a, b, joint in spans if joint]
        near = []
        for raw, a, b in joints:
            before, after = raw[max(0, a - 64) : a].split(), raw[b : b + 64].split()
            near.append((before[-1] if len(before) > 1 else b"", raw[a:b], after[0] if len(after) > 1 else b""))
        self.learn({w for n in near for w in n if w})
        windows = self.library([b" ".join(n).decode() for n in near])
        repaired = {}
        for (raw, a, b), n, window in zip(joints, near, windows, strict=True):
            got = [self.words[w] for w in n if w]
            agreed = b"".join([g[0] for g in got]) == window[0]
            repaired[id(raw), a] = self.words[n[1]] if agreed else self.repair(raw, a, b)
        ids, shown = [], []
        for raw, spans in cut:
            got = []
            for a, b, joint in spans:
                if joint:
                    got.append(repaired[id(raw), a])
                else:
                    core = raw[a:b]
                    if core not in self.chunks:
                        self.learn({w for w in core.split() if w not in self.words})
                    got.append(self.core(core))
            ids.append(b"".join([g[0] for g in got]))
            shown.append(" ".join([g[1] for g in got if g[1]]))
        return ids, shown


def codec(path: str) -> Codec:
    if path not in _LOADED:
        _LOADED[path] = Codec(path)
    return _LOADED[path]


def encode_decode(df: DataFrame, tokenizer_path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per row: id, ``ids`` (binary, little-endian unsigned 32-bit) and ``decoded`` text.

    The ids are those of the tokenizers library without added special tokens,
    truncation or padding; ``decoded`` is its ``decode`` of them, special tokens kept.
    """

    def make():
        encode = codec(tokenizer_path).encode

        def work(texts):
            ids, shown = encode(texts)
            return [pa.array(ids, pa.binary()), pa.array(shown, pa.string())]

        return work

    return map_texts(df, id_col, text_col, f"{id_col} long, ids binary, decoded string", make)


def digests(encoded: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """n_tokens and SHA-256 digests of the ids and of the decoded text's UTF-8."""
    return encoded.select(
        id_col,
        (F.octet_length("ids") / 4).cast("long").alias("n_tokens"),
        F.sha2(F.col("ids"), 256).alias("ids_sha256"),
        F.sha2(F.col("decoded").cast("binary"), 256).alias("decoded_sha256"),
    )
