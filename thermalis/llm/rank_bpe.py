"""Byte-level BPE from a rank file with the tiktoken library, and raw-byte decoding.

Each match of a splitting pattern is encoded separately. A text of at most ``LONG``
characters goes to the library whole. A longer one is cut where no match can cross and
none can look across: between a character that is not white space and one that is. No
alternative of a pattern vouched for by ``cuts_before_space`` takes white space after
anything else, none looks back, and the one lookahead asks only about the character
after a run of white space. A run of white space of ``LONG`` or more characters, on
which the library's matcher may overflow its stack, is encoded as the single piece
that the pattern makes of it: all but its last character, or all of it at the end of
the text. The parts' ids, one after another, are the text's ids.

A pattern that is not vouched for is never cut. Ids are decoded to bytes, so a token that
holds part of a character is no loss; the decoded bytes are those of the text.

Null texts count as empty (no ids, no bytes); very long texts are encoded whole, part by
part; rows are independent, so ties, repeated rows, null ids, extra columns and empty
tables need no rule. No shuffle.
"""

from __future__ import annotations

import base64
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from thermalis.llm.arrowio import map_columns, map_texts

#: Characters up to which a text, or a run of white space, goes to the library whole.
LONG = 32_768
#: Alternatives known to take either no white space after another character, or white space alone (fixed values).
_SAFE_ALTERNATIVES = {"'s", "'t", "'re", "'ve", "'m", "'ll", "'d", r" ?\p{L}+", r" ?\p{N}+", r" ?[^\s\p{L}\p{N}]+", r"\s+(?!\S)", r"\s+"}
#: The characters of Unicode's property White_Space (fixed values).
_WHITE = r"\t-\r \x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000"
_EDGE = re.compile(f"[^{_WHITE}](?=[{_WHITE}])")
_LOADED: dict = {}


def cuts_before_space(pattern: str) -> bool:
    """Whether every alternative of ``pattern`` is known to allow a cut before white space."""
    return set(pattern.split("|")) <= _SAFE_ALTERNATIVES


def load_ranks(path: str) -> dict[bytes, int]:
    """Token bytes and their ranks; all 256 single bytes must be there, and no rank twice."""
    with open(path, "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    if not all(bytes([b]) in ranks for b in range(256)) or len(set(ranks.values())) != len(ranks):
        raise ValueError("not a complete byte-level rank file")
    return ranks


class Codec:
    def __init__(self, path: str, pattern: str, long: int = LONG):
        import tiktoken

        self.library = tiktoken.Encoding("ranks", pat_str=pattern, mergeable_ranks=load_ranks(path), special_tokens={})
        self.cuts, self.long = cuts_before_space(pattern), long
        self._run = re.compile(f"[{_WHITE}]{{{max(2, long)},}}")

    def edges(self, text: str) -> Iterator[int]:
        """Places where ``text`` may be cut, at most about ``long`` characters apart where it allows that."""
        start = 0
        while len(text) - start > self.long:
            stop = start + self.long
            last = None
            for reach in (1024, self.long):  # near the end of the window first
                for last in _EDGE.finditer(text, max(start, stop - reach), stop):
                    pass
                if last:
                    break
            last = last or _EDGE.search(text, stop)
            if not last:
                return
            start = last.end()
            yield start

    def parts(self, text: str) -> Iterator[tuple[str, bool]]:
        """The parts of a text in order, and whether the part is a single piece of white space."""
        if len(text) <= self.long or not self.cuts:
            yield text, False
            return
        start = 0
        for stop in [*self.edges(text), len(text)]:
            for run in self._run.finditer(text, start, stop) if stop - start > self.long else ():
                if run.start() > start:
                    yield text[start : run.start()], False
                start = run.end() if run.end() == len(text) else run.end() - 1
                yield text[run.start() : start], True
            if start < stop:
                yield text[start:stop], False
            start = stop

    def encode(self, text: str) -> list[int]:
        if len(text) <= self.long:
            return self.library.encode_ordinary(text)
        ids: list[int] = []
        for part, single in self.parts(text):
            ids += self.library._encode_single_piece(part) if single else self.library.encode_ordinary(part)
        return ids

    def decode(self, ids: list[int]) -> bytes:
        return self.library.decode_bytes(ids)


def codec(path: str, pattern: str) -> Codec:
    """One a worker process for each file and pattern."""
    if (path, pattern) not in _LOADED:
        _LOADED[path, pattern] = Codec(path, pattern)
    return _LOADED[path, pattern]


def encode_decode(df: DataFrame, path: str, pattern: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per row: id, ``ids`` (array of int) and ``decoded``, the bytes that these ids stand for."""

    def make():
        c = codec(path, pattern)

        def work(texts):
            ids = [c.encode(t) for t in texts]
            return [pa.array(ids, pa.list_(pa.int32())), pa.array([c.decode(i) for i in ids], pa.binary())]

        return work

    return map_texts(df, id_col, text_col, f"{id_col} long, ids array<int>, decoded binary", make)


def decode(df: DataFrame, path: str, pattern: str, id_col: str = "doc_id", ids_col: str = "ids") -> DataFrame:
    """Per row: id and ``decoded``, the bytes of the ids; null lists count as empty. Ids outside the file, null ones too, are an error."""

    def run(batches):
        c = codec(path, pattern)
        for batch in batches:
            yield batch.column("id"), [pa.array([c.decode(i or []) for i in batch.column("ids").to_pylist()], pa.binary())]

    return map_columns(df.select(F.col(id_col).alias("id"), F.col(ids_col).cast("array<int>").alias("ids")), f"{id_col} long, decoded binary", run)


def digests(encoded: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """n_tokens, and SHA-256 digests of the ids (decimal, joined by commas) and of the decoded bytes."""
    return encoded.select(
        id_col,
        F.size("ids").cast("long").alias("n_tokens"),
        F.sha2(F.concat_ws(",", F.col("ids").cast("array<string>")), 256).alias("ids_sha256"),
        F.sha2(F.col("decoded"), 256).alias("decoded_sha256"),
    )
