"""Token-id output in training order: fixed-stride shards of permuted sequences.

Texts are tokenised, ended with an end token, joined in the order of each input
partition and cut into sequences of ``length`` ids (the last of a partition is padded
with end tokens). Sequences are numbered partition by partition, and a keyed Feistel
permutation of the least power of four that holds them, walked along its cycles until
it lands below their number, gives each a global slot: a bijection that needs no sort,
no shuffle of keys and no table, and that any reader can compute again. Slots are
range-partitioned by shard, and a task writes its shards as files of raw little-endian
ids, sequence ``slot`` at byte ``(slot % per_shard) * length * width`` of its shard, so a
reader starts or resumes at any slot with one seek and reads on sequentially.

The numbered sequences are written once to the shared checkpoint folder (zstd),
since their number is needed before the first slot is known; what the driver gets is
one count for each input partition. A shard is written under a name of its own and
renamed when complete, so tasks that are run again or twice leave the same files. The manifest comes last.

Null and empty texts are an end token alone; very long texts run over as many sequences as they need. Null ids are kept as nulls in
``doc_ids``; ties and repeated rows are kept, each with its tokens. Extra columns are
ignored. An empty table has no sequences and no shard.
"""

from __future__ import annotations

import base64
import json
import re
import uuid

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from thermalis.llm.arrowio import map_columns, slices
from thermalis.llm.scratch import Scratch

_LOADED: dict = {}
#: Words remembered by a worker process.
WORDS_KEPT = 600_000


class WordTokens(dict):
    """Word after a space -> its ids as bytes.

    With the pattern used here, no token spans the place before a single space that
    stands between two characters that are not white space, so such words can be
    encoded one by one; texts with other white space around a space go whole.
    """

    _unsafe = re.compile(r" \s|\s |^\s|\s$|[\x1c-\x1f]")

    def __init__(self, path: str, pattern: str, end: int):
        import tiktoken

        super().__init__()
        with open(path, "rb") as f:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
        self.end = end
        self.dtype = np.dtype("<u2") if max(end, *ranks.values()) < 1 << 16 else np.dtype("<u4")
        self.ordinary = tiktoken.Encoding("own", pat_str=pattern, mergeable_ranks=ranks, special_tokens={}).encode_ordinary
        self.end_bytes = np.array([end], self.dtype).tobytes()

    def __missing__(self, word: str) -> bytes:
        found = np.array(self.ordinary(" " + word), self.dtype).tobytes()
        if len(word) < 64:
            self[word] = found
        return found

    def encode(self, text: str) -> bytes:
        if not text or self._unsafe.search(text):
            return np.array(self.ordinary(text), self.dtype).tobytes() + self.end_bytes
        first, *rest = text.split(" ")
        return np.array(self.ordinary(first), self.dtype).tobytes() + b"".join(map(self.__getitem__, rest)) + self.end_bytes


def word_tokens(path: str, pattern: str, end: int) -> WordTokens:
    key = (path, pattern, end)
    if key not in _LOADED:
        _LOADED[key] = WordTokens(*key)
    if len(_LOADED[key]) > WORDS_KEPT:
        _LOADED[key].clear()
    return _LOADED[key]


def permute(index: np.ndarray, count: int, key: int, rounds: int = 6) -> np.ndarray:
    """The slot of each index: a keyed bijection of 0 .. count-1."""
    from thermalis.llm.words import mix

    half = np.uint64(max(1, (max(1, count - 1).bit_length() + 1) // 2))
    mask = np.uint64((1 << int(half)) - 1)
    keys = mix(np.arange(1, rounds + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15) ^ np.uint64(key & (2**64 - 1)))

    def once(x):
        left, right = x >> half, x & mask
        for k in keys:
            left, right = right, left ^ (mix(right ^ k) & mask)
        return (left << half) | right

    slot = once(np.asarray(index, np.uint64))
    while len(out := np.flatnonzero(slot >= np.uint64(count))):  # walk the cycle back into range
        slot[out] = once(slot[out])
    return slot.astype(np.int64)


def sequences(df: DataFrame, tokenizer_path: str, pattern: str, end: int, length: int, id_col: str, text_col: str) -> DataFrame:
    """(part, number in part, tokens before padding, ids of documents, ids as bytes), cut within each partition."""
    rows = df.select(F.col(id_col).cast("long").alias("id"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"))

    def run(batches):
        part, number, held, docs = TaskContext.get().partitionId(), 0, bytearray(), []
        tokens = word_tokens(tokenizer_path, pattern, end)
        size = length * tokens.dtype.itemsize

        def emit(out):
            cols = list(zip(*out, strict=True))
            return pa.array(cols[0], pa.int32()), [list(c) for c in cols[1:]]

        for batch in batches:
            for piece in slices(batch, "text", 1 << 20):
                out = []
                for doc, text in zip(piece.column("id").to_pylist(), piece.column("text").to_pylist(), strict=True):
                    held += tokens.encode(text)
                    docs.append(doc)
                    at = 0
                    while len(held) - at >= size:
                        out.append((part, number, length, docs, bytes(held[at : at + size])))
                        at += size
                        number, docs = number + 1, [doc] if len(held) > at else []
                    if at:
                        del held[:at]
                if out:
                    yield emit(out)
        if held:
            n = len(held) // tokens.dtype.itemsize
            yield emit([(part, number, n, docs, bytes(held) + tokens.end_bytes * (length - n))])

    out = map_columns(rows.withColumnRenamed("id", "doc"), "part int, number long, n_tokens int, doc_ids array<long>, body binary", lambda b: run(_renamed(b)))
    return out


def _renamed(batches):
    for b in batches:
        yield b.rename_columns(["id", "text"])


#: Sequences (two megabytes at the default length) that the packing dictionary is made from.
DICTIONARY_FROM, DICTIONARY_BYTES = 1500, 32 << 10


def packing_dictionary(bodies: list[bytes]) -> bytes:
    """What short bodies have in common, for packing them one by one in the shuffle; empty if there are few."""
    import zstandard

    return zstandard.train_dictionary(DICTIONARY_BYTES, bodies).as_bytes() if sum(map(len, bodies)) > 16 * DICTIONARY_BYTES else b""


def packer(dictionary: bytes):
    import zstandard

    return zstandard.ZstdCompressor(level=6, dict_data=zstandard.ZstdCompressionDict(dictionary) if dictionary else None)


def unpacker(dictionary: bytes):
    import zstandard

    return zstandard.ZstdDecompressor(dict_data=zstandard.ZstdCompressionDict(dictionary) if dictionary else None)


#: Reduce partitions at most; beyond, a partition holds several shards, one after another.
MOST_PARTS = 20_000


def store_of(uri: str):
    """(file system, path on it), for use in Python tasks."""
    from pyarrow import fs

    return fs.FileSystem.from_uri(re.sub("^s3a://", "s3://", uri))


def write_shards(df: DataFrame, out_uri: str, tokenizer_path: str, pattern: str, end: int, key: int, length: int = 1024, per_shard: int = 8192, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Write the shards and return one row for each sequence.

    Columns: slot, shard, byte_offset, n_tokens (without padding), doc_ids (documents
    with tokens in it, in order) and sha256 of the bytes written. When this returns all shards are there, and
    after them ``out_uri/manifest.json``, which states the layout; a run that fails leaves none.
    """
    spark, scratch = df.sparkSession, Scratch(df.sparkSession)
    cut = scratch.save(sequences(df, tokenizer_path, pattern, end, length, id_col, text_col), "zstd")
    shared = spark.sparkContext.broadcast(packing_dictionary([bytes(r["body"]) for r in cut.select("body").limit(DICTIONARY_FROM).collect()]))
    counts = sorted((r["part"], r["count"]) for r in cut.groupBy("part").count().collect())
    total = sum(n for _, n in counts)
    starts = np.cumsum([0] + [n for _, n in counts])
    parts = np.array([p for p, _ in counts], np.int64)
    width = word_tokens(tokenizer_path, pattern, end).dtype.itemsize
    store, root = store_of(out_uri)
    store.create_dir(root, recursive=True)

    def place(batches):
        pack = packer(shared.value).compress
        for b in batches:
            part = np.searchsorted(parts, b.column("part").to_numpy())
            slot = permute(starts[part] + b.column("number").to_numpy(), total, key)
            yield b.column("part"), [slot, slot // per_shard, b.column("n_tokens"), b.column("doc_ids"), [pack(x) for x in b.column("body").to_pylist()]]

    placed = map_columns(cut.select("part", "number", "n_tokens", "doc_ids", "body"), "part int, slot long, shard long, n_tokens int, doc_ids array<long>, body binary", place).drop("part")
    n_shards = max(1, -(-total // per_shard))
    # the ranges are known, so they are dealt by number: no sampling pass over what is packed; neighbouring shards go together where there are many
    together = -(-n_shards // MOST_PARTS)
    dealt = placed.repartitionById(-(-n_shards // together), F.floor(F.col("shard") / together).cast("int")).sortWithinPartitions("slot")

    def write(batches):
        import hashlib

        unpack = unpacker(shared.value).decompress
        store, root = store_of(out_uri)
        now, stream, name = None, None, None

        def close():
            stream.close()
            store.move(name, f"{root}/shard-{now:08d}.bin")

        for b in batches:
            digest = []
            for shard, body in zip(b.column("shard").to_pylist(), b.column("body").to_pylist(), strict=True):
                if shard != now:
                    if stream is not None:
                        close()
                    now, name = shard, f"{root}/.writing-{shard:08d}-{uuid.uuid4().hex}"
                    stream = store.open_output_stream(name)
                raw = unpack(body)
                stream.write(raw)
                digest.append(hashlib.sha256(raw).hexdigest())
            slot = b.column("slot").to_numpy()
            yield b.column("slot"), [b.column("shard"), (slot % per_shard) * length * width, b.column("n_tokens"), b.column("doc_ids"), digest]
        if stream is not None:
            close()

    written = scratch.save(map_columns(dealt, "slot long, shard long, byte_offset long, n_tokens int, doc_ids array<long>, sha256 string", write))
    scratch.drop(cut)
    with store.open_output_stream(f"{root}/manifest.json") as f:
        f.write(json.dumps({"sequences": total, "length": length, "width": width, "per_shard": per_shard, "key": key, "end": end}).encode())
    return written


def read_sequences(out_uri: str, start: int = 0, count: int | None = None):
    """Yield the ids of ``count`` sequences from slot ``start`` on, one seek and then sequentially."""
    store, root = store_of(out_uri)
    with store.open_input_stream(f"{root}/manifest.json") as f:
        m = json.loads(f.read())
    stop = m["sequences"] if count is None else min(m["sequences"], start + count)
    size, slot = m["length"] * m["width"], start
    while slot < stop:
        shard = slot // m["per_shard"]
        with store.open_input_file(f"{root}/shard-{shard:08d}.bin") as f:
            f.seek((slot % m["per_shard"]) * size)
            while slot < stop and slot // m["per_shard"] == shard:
                yield np.frombuffer(f.read(size), f"<u{m['width']}")
                slot += 1
