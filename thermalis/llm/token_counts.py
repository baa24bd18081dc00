"""Token counts by the whole-token shortcut.

A sentencepiece BPE model joins neighbouring symbols only into pieces of its
vocabulary. If every piece with a word mark after its first character consists of
word marks alone, no merge crosses from a word's last character into the next mark,
so the text falls into segments (marks, then a word) whose pieces never depend on
each other. Likewise a character that is in no longer piece, such as the line feed
here, stands alone. ``Counter`` proves both facts from the vocabulary when it is
loaded, tries on probes that the model's normalizer changes nothing but spaces, keeps
their number and puts one in front, uses the library for whole texts if anything fails, and finds, by encoding each one alone, the vocabulary strings that give
exactly one token; those are counted as they stand, and only other segments are
merged by the library, once each as long as they stay in a bounded table.

Null texts count as empty (0 bytes, 0 tokens); very long texts count whole; rows are independent, so ties,
repeated rows and empty tables need no rule; other columns are ignored. No shuffle.
"""

from __future__ import annotations

import re

from pyspark.sql import DataFrame

from thermalis.llm.arrowio import map_texts

MARK = "▁"
#: Segments remembered besides the vocabulary, and the longest that is remembered.
REMEMBERED, LONGEST = 700_000, 48
_LOADED: dict = {}


class Counter(dict):
    """Segment -> number of tokens; missing segments are merged by the library."""

    def __init__(self, path: str):
        import sentencepiece

        super().__init__()
        self.model = model = sentencepiece.SentencePieceProcessor(model_file=path)
        pieces = [model.id_to_piece(i) for i in range(model.get_piece_size()) if not (model.is_control(i) or model.is_unknown(i) or model.is_byte(i))]
        #: True if segments are independent and "\n" stands alone, by the vocabulary.
        self.proven = all(MARK not in p[1:] or not p.strip(MARK) for p in pieces) and not any("\n" in p for p in pieces) and model.encode("a\nb", out_type=int)[1:2] == model.encode("\n", out_type=int)[1:] and model.encode("") == []
        if self.proven:
            for piece, ids in zip(pieces, model.encode([p[1:] if p[0] == MARK else "\n" + p for p in pieces], num_threads=1), strict=True):
                alone = ids if piece[0] == MARK else ids[2:]
                if len(alone) == 1 and piece.strip(MARK) and " " not in piece:
                    self[piece.replace(MARK, " ")] = 1
            self["\n"] = 1
            self.line_feed = model.encode("\n")[1]
        self.whole_tokens = len(self)
        self.vocabulary = dict(self)
        self.segments = re.compile(r" *[^ \n]+|\n| +").findall
        # whatever the normalizer does to spaces, width, case or composition shows here
        probes = ["a", " a", "a ", "  a   b  ", "a\tb", "\u00a0a\u3000b", "\uff21\ufb01\u2460", "e\u0301 \u00c9", "A\r\n b\n\n c", "\u200b\ufeffx", MARK + "a" + MARK * 2, "<s> </s> <unk> <pad>"]
        kept = [" " + p.replace(MARK, " ") for p in probes]
        if self.proven and hasattr(model, "normalize"):
            self.proven = [model.normalize(p).replace(MARK, " ") for p in probes] == kept
        if self.proven:
            self.proven = self.count(probes) == [len(ids) for ids in model.encode(probes, num_threads=1)]

    def __missing__(self, segment: str) -> int:
        """Put off: what a slice of texts lacks is merged in one call."""
        self.lacking.append((self.row, segment))
        return 0

    def merge(self, segments: list[str]) -> list[int]:
        """Tokens of each segment, a hundred to a text with line feeds between."""
        import numpy as np

        joined = ["\n" + "\n".join(segments[i : i + 100]) for i in range(0, len(segments), 100)]
        ids = np.array([x for found in self.model.encode(joined, num_threads=1) for x in found[found[0] != self.line_feed :]], dtype=np.int64)
        cuts = np.flatnonzero(ids == self.line_feed)
        return (np.diff(np.append(cuts, len(ids))) - 1).tolist()

    def count(self, texts: list[str]) -> list[int]:
        if not self.proven:
            return [len(ids) for ids in self.model.encode(texts, num_threads=1)]
        counts, self.lacking = [0] * len(texts), []
        for self.row, text in enumerate(texts):
            if text:
                counts[self.row] = sum(map(self.__getitem__, self.segments(" " + text.replace(MARK, " "))))
        rest = list({s for _, s in self.lacking})
        sizes = dict(zip(rest, self.merge(rest), strict=True))
        for row, segment in self.lacking:
            counts[row] += sizes[segment]
        if len(self) > self.whole_tokens + REMEMBERED:
            self.clear()
            self.update(self.vocabulary)
        self.update((s, n) for s, n in sizes.items() if len(s) <= LONGEST)
        return counts


def counter(path: str) -> Counter:
    """One per worker process and model file."""
    if path not in _LOADED:
        _LOADED[path] = Counter(path)
    return _LOADED[path]


def count_tokens(df: DataFrame, model_path: str, id_col: str = "doc_id", text_col: str = "text", limit: int = 4096) -> DataFrame:
    """Per row: id, UTF-8 bytes, tokens without added ones, and whether they exceed ``limit``."""

    def make():
        count = counter(model_path).count

        def work(texts):
            n = count(texts)
            return [[len(t.encode()) for t in texts], n, [x > limit for x in n]]

        return work

    return map_texts(df, id_col, text_col, f"{id_col} long, n_bytes long, n_tokens long, over_limit boolean", make)
