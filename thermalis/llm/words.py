"""Vectorised word hashing: whole Arrow columns of text to arrays, no Python strings.

A word is a maximal run of bytes outside a set of separators; A-Z count as a-z. Its
64-bit hash is a polynomial in its bytes (each replaced by a fixed random number),
mixed with its length, so equal words have equal hashes everywhere.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: ASCII white space: 0x20 and 0x09 to 0x0D.
SPACE = np.zeros(256, bool)
SPACE[[0x20, *range(0x09, 0x0E)]] = True
_MULTIPLIER = np.uint64(0x9E3779B97F4A7C15)
_BYTES = np.random.default_rng(7001).integers(1, 1 << 63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_BYTES[ord("A") : ord("Z") + 1] = _BYTES[ord("a") : ord("z") + 1]
_POWERS = np.ones(1, np.uint64)


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit integers that spreads every bit."""
    with np.errstate(over="ignore"):
        x = x ^ (x >> np.uint64(30))
        x = x * np.uint64(0xBF58476D1CE4E5B9)
        x = x ^ (x >> np.uint64(27))
        x = x * np.uint64(0x94D049BB133111EB)
        return x ^ (x >> np.uint64(31))


def _powers(n: int) -> np.ndarray:
    global _POWERS
    if len(_POWERS) < n:
        with np.errstate(over="ignore"):
            _POWERS = np.concatenate([np.ones(1, np.uint64), np.cumprod(np.full(max(64, 2 * n), _MULTIPLIER, np.uint64))])
    return _POWERS


def text_bytes(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(bytes of all texts, offsets of each text in them); null texts are empty."""
    texts = pc.fill_null(texts, "").cast(pa.large_string())
    offsets = np.frombuffer(texts.buffers()[1], np.int64)[texts.offset : texts.offset + len(texts) + 1] if len(texts) else np.zeros(1, np.int64)
    data = texts.buffers()[2]
    raw = np.frombuffer(data, np.uint8)[offsets[0] : offsets[-1]] if data is not None else np.zeros(0, np.uint8)
    return raw, offsets - offsets[0]


def word_spans(raw: np.ndarray, offsets: np.ndarray, separators: np.ndarray = SPACE) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of all words, in order; no word spans two texts."""
    inside = ~separators[raw]
    before = np.empty_like(inside)
    before[:1] = False
    before[1:] = inside[:-1]
    first = offsets[:-1][offsets[:-1] < len(raw)]
    before[first] = False
    starts = np.flatnonzero(inside & ~before)
    after = np.empty_like(inside)
    after[-1:] = False
    after[:-1] = inside[1:]
    after[first[first > 0] - 1] = False
    return starts, np.flatnonzero(inside & ~after) + 1


def hash_words(raw: np.ndarray, starts: np.ndarray, ends: np.ndarray, separators: np.ndarray = SPACE) -> np.ndarray:
    if not len(starts):
        return np.zeros(0, np.uint64)
    lengths = ends - starts
    values = np.where(separators, np.uint64(0), _BYTES)[raw[starts[0] :]]
    spread = np.diff(np.append(starts, len(raw)))
    at = np.arange(len(raw) - starts[0], dtype=np.int64) - np.repeat(starts - starts[0], spread)
    np.minimum(at, lengths.max() - 1, out=at)  # what lies beyond a word is separators, worth 0
    with np.errstate(over="ignore"):
        values *= _powers(int(lengths.max()))[at]
        return mix(np.add.reduceat(values, starts - starts[0]) + lengths.astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93))


def hash_prefixes(raw: np.ndarray, starts: np.ndarray, ends: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """(hashes of the first ``n`` bytes of each word that is longer, which words those are)."""
    which = np.flatnonzero(ends - starts > n)
    out = np.full(len(which), n, np.uint64)
    with np.errstate(over="ignore"):
        for k in range(n):
            out += _BYTES[raw[starts[which] + k]] * _powers(n)[k]
        return mix(out * np.uint64(0xA0761D6478BD642F)), which


def words(texts: pa.Array, separators: np.ndarray = SPACE) -> tuple[np.ndarray, np.ndarray]:
    """(hashes of all words, offsets of each text's words in them)."""
    raw, offsets = text_bytes(texts)
    starts, ends = word_spans(raw, offsets, separators)
    return hash_words(raw, starts, ends, separators), np.searchsorted(starts, offsets)


def combine(hashes: np.ndarray, n: int) -> np.ndarray:
    """Hash of each run of ``n`` neighbouring words, in place of its first word."""
    with np.errstate(over="ignore"):
        out = hashes[: len(hashes) - n + 1].copy()
        for k in range(1, n):
            out = mix(out) + hashes[k : len(hashes) - n + 1 + k]
        return mix(out * np.uint64(2) + np.uint64(n))


def shingles(hashes: np.ndarray, offsets: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """(hashes, row) of each text's ``n``-word shingles, repeats included.

    A text of fewer words, but at least one, has its whole sequence as its shingle.
    """
    counts = np.diff(offsets)
    whole = np.flatnonzero(counts >= n)
    run = combine(hashes, n) if len(hashes) >= n else np.zeros(0, np.uint64)
    size = counts[whole] - n + 1
    rows = np.repeat(whole, size)
    inner = np.arange(size.sum()) - np.repeat(np.cumsum(size) - size, size)
    out = run[np.repeat(offsets[whole], size) + inner]
    short = np.flatnonzero((counts > 0) & (counts < n))
    if len(short):
        more = np.array([combine(hashes[offsets[r] : offsets[r + 1]], int(counts[r]))[0] for r in short], np.uint64)
        out, rows = np.concatenate([out, more]), np.concatenate([rows, short])
        order = np.argsort(rows, kind="stable")
        out, rows = out[order], rows[order]
    return out, rows
