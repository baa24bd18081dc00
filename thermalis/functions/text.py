"""Text expressions: normal forms, pattern predicates, shingles and similarity.

Patterns use Java's ``(?iU)`` so that letters with accents count as word characters; a
normal form holds a-z, apostrophes and spaces only and needs neither flag (``plain``).
Every function takes and returns Columns and stays inside code generation.
"""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

from thermalis.functions import lexicon


def clean(text: Column, null_text: str = "nan") -> Column:
    """Null texts become ``null_text``."""
    return F.coalesce(text.cast("string"), F.lit(null_text))


def tokens(text: Column, kind: str = "words") -> Column:
    """Lower-cased runs of letters and apostrophes (``words``) or of digits too (``alnum``)."""
    pattern = "[a-zA-Z']+" if kind == "words" else "[a-zA-Z0-9']+"
    return F.regexp_extract_all(F.lower(F.trim(text)), F.lit(pattern), F.lit(0))


def lemmatise(words: Column, lemmas: dict[str, str] | None = None) -> Column:
    """Replace words that have a lemma; the identity without a table."""
    if not lemmas:
        return words
    table = F.create_map(*(F.lit(x) for pair in lemmas.items() for x in pair))
    return F.transform(words, lambda w: F.coalesce(table[w], w))


def normalise(text: Column, kind: str = "words", lemmas: dict[str, str] | None = None) -> Column:
    return F.array_join(lemmatise(tokens(text, kind), lemmas), " ")


def matches(text: Column, pattern: str, lowered: bool = False, plain: bool = False) -> Column:
    """One pattern, behind a plain substring test where the pattern has a literal to look for."""
    literal = re.fullmatch(r"\\b([a-z0-9' &]+)\\b", pattern)
    found = text.rlike(("" if plain else "(?iU)") + pattern)
    return (text if lowered or plain else F.lower(text)).contains(literal[1]) & found if literal else found


def any_of(text: Column, patterns: list[str], lowered: bool = False, plain: bool = False) -> Column:
    """Whether any pattern occurs: long literals behind substring tests, the others in one alternation."""
    tested = [p for p in patterns if re.fullmatch(r"\\b[a-z0-9' &]{4,}\\b", p)]
    rest = [p for p in patterns if p not in tested]
    found = [matches(text, p, lowered, plain) for p in tested] + ([text.rlike(("" if plain else "(?iU)") + "(?:" + "|".join(rest) + ")")] if rest else [])
    out = found[0]
    for f in found[1:]:
        out = out | f
    return out


def count_of(text: Column, patterns: list[str]) -> Column:
    return sum((F.when(matches(text, p), 1).otherwise(0) for p in patterns), F.lit(0))


def required_words(pattern: str) -> list[str]:
    """Words that every match of ``pattern`` holds as runs of a-z and 0-9 between other characters.

    Parts that may be absent or may continue a word count for nothing; a pattern of which too little is known gives none.
    """
    p = re.sub(r"\((?:\?:)?[^()|]*\)\?", "\0", pattern)
    p = re.sub(r"\[[^\]]*\][?*+]?|\\w[*+]?", "\0", p)
    p = re.sub(r"\\[sb][+*]?", " ", p)
    if re.search(r"[a-z0-9][?*+{]|[|()\\]", p):
        return []
    return list(dict.fromkeys(w for w in re.split("[^a-z0-9\0]+", p) if w and "\0" not in w))


def term_pattern(term: str) -> str:
    return r"(?<!\w)" + re.escape(term).replace(r"\ ", r"\s+") + r"(?!\w)"


def term_words(term: str) -> list[str]:
    return re.findall("[a-z0-9]+", term)


class Spotted:
    """Patterns looked for in a text by way of the set of its words.

    A text is cut into words once and met with the vocabulary of all patterns at once, whatever their number; a
    pattern is tried only where all its words occur. In a normal form a pattern that is one whole word needs no trial.
    ``words`` is an expression to be stored as a column before use (``held``), so that it is worked out once a row.
    """

    def __init__(self, text: Column, plain: bool, patterns: list[str], terms: list[str] = ()):
        self.text, self.plain, self.held = text, plain, None
        vocabulary = sorted({w for p in patterns for w in required_words(p)} | {w for t in terms for w in term_words(t)})
        cut = F.split(F.translate(text, "'", " "), " ") if plain else F.regexp_extract_all(text, F.lit("[a-z0-9]+"), F.lit(0))
        self.words = F.array_intersect(cut, F.array(*map(F.lit, vocabulary)))

    def has(self, words: list[str]) -> Column:
        out = F.array_contains(self.held, words[0])
        for w in words[1:]:
            out = out & F.array_contains(self.held, w)
        return out

    def term(self, term: str) -> Column:
        """A lexicon term between characters that are no word characters; normal forms only."""
        words = term_words(term)
        return self.has(words) if words == [term] else self.has(words) & self.text.rlike(term_pattern(term))

    def pattern(self, pattern: str) -> Column:
        words, flags = required_words(pattern), "" if self.plain else "(?iU)"
        if not words:
            literal = max(re.findall("[a-z0-9]+", re.sub(r"\\\w", " ", pattern)), key=len, default="")
            return self.text.contains(literal) & self.text.rlike(flags + pattern)
        return self.has(words) if self.plain and pattern == rf"\b{words[0]}\b" else self.has(words) & self.text.rlike(flags + pattern)

    def any(self, patterns: list[str]) -> Column:
        found = [self.pattern(p) for p in patterns]
        out = found[0]
        for f in found[1:]:
            out = out | f
        return out


def lexicon_matches(spotted: Spotted) -> Column:
    """Map from category to the terms found in a normal form, in the list's order; no empty categories."""
    keys = F.array(*(F.lit(k) for k in lexicon.POSITIVE_LEXICON))
    values = F.array(*(F.filter(F.array(*(F.when(spotted.term(t), F.lit(t)) for t in terms)), lambda x: x.isNotNull()) for terms in lexicon.POSITIVE_LEXICON.values()))
    return F.map_filter(F.map_from_arrays(keys, values), lambda _, v: F.size(v) > 0)


def rule_hits(spotted: Spotted) -> Column:
    """Array of (family, subcategory), one for each exclusion pattern that the lower-cased text matches, in order."""
    found = [F.when(spotted.pattern(p), F.struct(F.lit(f).alias("family"), F.lit(s).alias("subcategory"))) for f, s, patterns in lexicon.EXCLUSION_RULES for p in patterns]
    return F.filter(F.array(*found), lambda x: x.isNotNull())


def is_repost(text: Column) -> Column:
    return any_of(F.trim(text), lexicon.REPOSTS)


def shingles(words: Column, n: int = 5) -> Column:
    """Distinct n-word shingles; fewer words give one, none gives an empty set."""
    many = F.array_distinct(F.transform(F.sequence(F.lit(1), F.greatest(F.size(words) - n + 1, F.lit(1))), lambda i: F.array_join(F.slice(words, i, n), " ")))
    return F.when(F.size(words) == 0, F.array().cast("array<string>")).otherwise(many)


def jaccard(a: Column, b: Column) -> Column:
    """Of two sets; 1 for two empty ones."""
    return F.when((F.size(a) == 0) & (F.size(b) == 0), F.lit(1.0)).otherwise(F.size(F.array_intersect(a, b)) / F.size(F.array_union(a, b)))
