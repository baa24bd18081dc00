"""Toxicity by multiple-instance learning with noisy-or.

A text is a bag of sentences (cut at ``.``, ``!``, ``?`` and line feeds); a sentence is
the set of its words (A-Z lower-cased, ASCII punctuation taken off) and of their first
four and five bytes, so that inflected forms share a stem. A sentence is offensive with
probability sigmoid(bias + sum of these features' weights), and a text is toxic unless none of its sentences is: 1 - prod(1 - p). The weights are fitted to the
texts' labels alone by gradient descent on the noisy-or likelihood; the sentences'
probabilities then say where the offence stands.

Fitting takes at most ``max_docs`` labelled rows, chosen by a hash of their ids, and of
those at most ``max_bytes`` of features, in one task: a text that no longer fits is left out, later ones that fit are not. Features in fewer than ``min_docs``
of these documents have no weight, nor have those whose share of toxic documents is
within ``min_z`` standard errors of their share of the others. The model is a table (hash of word, weight) of at
most ``max_words`` rows. Scoring covers every row where it lies, without a shuffle.

Null and empty texts have no sentence and score 0; texts of any length are scored whole. A null
id has no label, and is scored. Ties need no rule. A document with several labels
counts as toxic if one says so. Repeated rows are scored alike; without labelled rows
every score is 0; extra columns are ignored; an empty table gives an empty result.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from thermalis.llm.arrowio import map_columns, slices
from thermalis.llm.words import SPACE, hash_prefixes, hash_words, text_bytes, word_spans

_PUNCTUATION = SPACE.copy()
_PUNCTUATION[[ord(c) for c in "!\"#$%&'()*+,-./:;<=>?@[\\]^_`{|}~"]] = True
_END = np.zeros(256, bool)
_END[[ord(c) for c in ".!?\n"]] = True
#: Bytes of a word's beginning that are features besides the word.
STEMS = (4, 5)
#: The model's row that holds the bias instead of a word's weight.
BIAS = -1


def sentence_words(texts: pa.Array):
    """(feature hashes, sentence of each feature, text of each sentence, sentence spans in bytes).

    A sentence lists each of its features once; sentences without words are left out.
    """
    raw, offsets = text_bytes(texts)
    starts, ends = word_spans(raw, offsets, _PUNCTUATION)
    hashes = hash_words(raw, starts, ends, _PUNCTUATION)
    breaks = np.cumsum(_END[raw], dtype=np.int64) if len(raw) else np.zeros(0, np.int64)
    rows = np.searchsorted(offsets, starts, side="right") - 1
    group = breaks[starts] + rows if len(starts) else np.zeros(0, np.int64)
    new = np.flatnonzero(np.diff(group, prepend=-1) != 0)
    sentence = np.repeat(np.arange(len(new)), np.diff(np.append(new, len(starts))))
    spans = np.stack([starts[new], ends[np.append(new[1:], len(starts)) - 1]]) - offsets[rows[new]] if len(new) else np.zeros((2, 0), np.int64)
    stems = [hash_prefixes(raw, starts, ends, n) for n in STEMS]
    hashes = np.concatenate([hashes, *(h for h, _ in stems)])
    sentence = np.concatenate([sentence, *(sentence[which] for _, which in stems)])
    order = np.lexsort((hashes, sentence))
    h, s = hashes[order], sentence[order]
    once = np.ones(len(h), bool)
    once[1:] = (h[1:] != h[:-1]) | (s[1:] != s[:-1])
    return h[once], s[once], rows[new], spans


def _sigmoid(x):
    return 1 / (1 + np.exp(-np.clip(x, -40, 40)))


def screen(docs: list[np.ndarray], label: np.ndarray, min_docs: int, min_z: float, max_words: int) -> np.ndarray:
    """Ascending features that enough documents have and that tell toxic ones from others, the clearest if there are too many."""
    once = [np.unique(d) for d in docs]
    none = [np.zeros(0, np.uint64)]
    features, n = np.unique(np.concatenate(once or none), return_counts=True)
    toxic, c = np.unique(np.concatenate([d for d, y in zip(once, label, strict=True) if y == 1] or none), return_counts=True)
    ones = np.zeros(len(features), np.int64)
    ones[np.searchsorted(features, toxic)] = c
    n1, n0 = max(1, int((label == 1).sum())), max(1, int((label == 0).sum()))
    share = n / max(1, len(label))
    z = np.abs((ones / n1 - (n - ones) / n0) / np.sqrt(np.maximum(share * (1 - share), 1e-12) * (1 / n1 + 1 / n0)))
    kept = np.flatnonzero((n >= min_docs) & (z >= min_z))
    return np.sort(features[kept[np.lexsort((features[kept], -z[kept]))][:max_words]])


def fit_noisy_or(vocabulary: np.ndarray, feature: np.ndarray, sentence: np.ndarray, text: np.ndarray, label: np.ndarray, rounds: int = 300, rate: float = 0.5, decay: float = 2e-5) -> dict[int, float]:
    """Weights by feature hash; the bias under ``BIAS``. ``feature`` numbers the vocabulary, ``sentence`` and ``text`` say where it stands."""
    if not len(label):
        return {}
    n_sentences, weights, bias = len(text), np.zeros(len(vocabulary)), -4.0
    toxic = label[text] == 1
    seen, seen_bias = np.full(len(vocabulary), 1e-2), 1e-2
    for _ in range(rounds):
        p = _sigmoid(bias + np.bincount(sentence, weights[feature], n_sentences))
        none = np.bincount(text, np.log1p(-np.minimum(p, 1 - 1e-12)), len(label))  # log of P(no offence)
        some = np.maximum(-np.expm1(none), 1e-9)
        pull = np.where(toxic, p * (np.exp(none) / some)[text], -p)
        step = np.bincount(feature, pull[sentence], len(vocabulary)) / len(label) * 1000 - decay * 1000 * weights
        seen += step * step
        weights += rate * step / np.sqrt(seen)
        step_bias = pull.sum() / len(label) * 1000
        seen_bias += step_bias * step_bias
        bias += rate * step_bias / np.sqrt(seen_bias)
    return {BIAS: float(bias)} | dict(zip(vocabulary.view(np.int64).tolist(), weights.tolist(), strict=True))


class Scorer:
    def __init__(self, model: dict[int, float]):
        words = {k: v for k, v in model.items() if k != BIAS}
        self.trained = BIAS in model
        self.bias = model.get(BIAS, 0.0)
        keys = np.array(list(words), np.int64).view(np.uint64)
        order = np.argsort(keys)
        self.keys, self.weights = keys[order], np.array(list(words.values()), float)[order]

    def sentences(self, texts: pa.Array):
        """(probability, text, spans) of every sentence."""
        hashes, sentence, text, spans = sentence_words(texts)
        if not self.trained:
            return np.zeros(len(text)), text, spans
        weight = np.zeros(len(hashes))
        if len(self.keys):
            at = np.minimum(np.searchsorted(self.keys, hashes), len(self.keys) - 1)
            weight = np.where(self.keys[at] == hashes, self.weights[at], 0.0)
        return _sigmoid(self.bias + np.bincount(sentence, weight, len(text))), text, spans

    def worst(self, texts: pa.Array):
        """Per text: its probability, how many sentences are offensive (0.5 or more), and the place and probability of the worst (-1, 0 for none; of equal ones the first)."""
        p, text, _ = self.sentences(texts)
        order = np.lexsort((np.arange(len(p)), -p, text))
        first = order[np.concatenate([[True], text[order][1:] != text[order][:-1]])] if len(p) else order
        place, most = np.full(len(texts), -1), np.zeros(len(texts))
        place[text[first]], most[text[first]] = first - np.searchsorted(text, text[first]), p[first]
        return self.combined(p, text, len(texts)), np.bincount(text[p >= 0.5], minlength=len(texts)), place, most

    def texts(self, texts: pa.Array) -> np.ndarray:
        p, text, _ = self.sentences(texts)
        return self.combined(p, text, len(texts))

    @staticmethod
    def combined(p: np.ndarray, text: np.ndarray, n: int) -> np.ndarray:
        """Noisy-or of each text's sentences."""
        return -np.expm1(np.bincount(text, np.log1p(-np.minimum(p, 1 - 1e-12)), n)) + 0.0


def train(df: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic", max_docs: int = 12_000, max_bytes: int = 96 << 20, min_docs: int = 4, min_z: float = 4.0, max_words: int = 1 << 17) -> dict[int, float]:
    """Fit to a bounded sample of the labelled rows; the model comes back to the driver (at most ``max_words`` rows)."""
    chosen = (
        labels.where(F.col(label_col).isNotNull() & F.col(id_col).isNotNull())
        .groupBy(F.col(id_col).alias("id"))
        .agg(F.max(F.col(label_col).cast("int")).alias("label"))
        .orderBy(F.xxhash64("id"), "id")
        .limit(max_docs)
    )
    texts = df.select(F.col(id_col).alias("id"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"))
    # at most max_docs pairs of id and label are broadcast; texts that no longer fit the byte bound, in order of id hash, are left out
    sample = texts.join(F.broadcast(chosen), "id").select("id", "label", "text")

    def features(batches):
        for batch in batches:
            for part in slices(batch, "text"):
                h, s, t, _ = sentence_words(part.column("text"))
                first = np.searchsorted(s, np.arange(len(t) + 1))
                per_text = np.searchsorted(t, np.arange(part.num_rows + 1))
                bodies = [h[first[a] : first[b]].astype("<u8").tobytes() for a, b in zip(per_text[:-1], per_text[1:], strict=True)]
                sizes = [np.diff(first[a : b + 1]).astype("<i4").tobytes() for a, b in zip(per_text[:-1], per_text[1:], strict=True)]
                yield part.column("id"), [part.column("label"), pa.array(bodies, pa.binary()), pa.array(sizes, pa.binary())]

    table = map_columns(sample, "id long, label int, words binary, sizes binary", features)

    def fit(batches):
        words, sizes, label, used = [], [], [], 0
        for batch in batches:
            for y, w, z in zip(*(batch.column(c).to_pylist() for c in ("label", "words", "sizes")), strict=True):
                if used + len(w) <= max_bytes:  # a text that does not fit costs only itself
                    used += len(w)
                    words.append(np.frombuffer(w, "<u8"))
                    sizes.append(np.frombuffer(z, "<i4"))
                    label.append(y)
        label = np.array(label, np.int64)
        vocabulary = screen(words, label, min_docs, min_z, max_words)
        feature, sentence, text, base = [], [], [], 0
        for k, (w, z) in enumerate(zip(words, sizes, strict=True)):
            at = np.minimum(np.searchsorted(vocabulary, w), max(0, len(vocabulary) - 1))
            on = np.flatnonzero(vocabulary[at] == w) if len(vocabulary) else np.zeros(0, np.int64)
            feature.append(at[on])
            sentence.append(base + np.repeat(np.arange(len(z)), z)[on])
            text.append(np.full(len(z), k))
            base += len(z)
        join = lambda x: np.concatenate(x or [np.zeros(0, np.int64)]).astype(np.int64)
        model = fit_noisy_or(vocabulary, join(feature), join(sentence), join(text), label)
        yield pa.array(list(model), pa.int64()), [list(model.values())]

    one = table.repartition(1).sortWithinPartitions(F.xxhash64("id"), "id", "sizes", "words")
    model = map_columns(one, "id long, weight double", fit).toPandas()
    return dict(zip(model["id"].tolist(), model["weight"].tolist(), strict=True))


def score(df: DataFrame, model: dict[int, float], id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per row: id, ``score``, offensive sentences, and the place (from 0, null if there is none) and probability of the worst sentence."""
    sent = df.sparkSession.sparkContext.broadcast(model)
    rows = df.select(F.col(id_col).alias("id"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"))

    def run(batches):
        scorer = Scorer(sent.value)
        for batch in batches:
            for part in slices(batch, "text"):
                score, n, place, most = scorer.worst(part.column("text"))
                yield part.column("id"), [score, n, pa.array(place, mask=place < 0), most]

    return map_columns(rows, "id long, score double, offensive_sentences long, worst_sentence long, worst_probability double", run).withColumnRenamed("id", id_col)


def without_toxic(df: DataFrame, model: dict[int, float], text_col: str = "text", threshold: float = 0.5) -> DataFrame:
    """The rows of ``df`` whose score is below ``threshold``, as they are."""
    sent = df.sparkSession.sparkContext.broadcast(model)

    def run(batches):
        scorer = Scorer(sent.value)
        for batch in batches:
            for part in slices(batch, text_col):
                yield part.filter(pa.array(scorer.texts(part.column(text_col)) < threshold))

    return df.mapInArrow(run, df.schema)


def locate_sentences(df: DataFrame, model: dict[int, float], id_col: str = "doc_id", text_col: str = "text", threshold: float = 0.5) -> DataFrame:
    """Per offending sentence: id, its place among the text's sentences, its words and probability."""
    sent = df.sparkSession.sparkContext.broadcast(model)
    rows = df.select(F.col(id_col).alias("id"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"))

    def run(batches):
        scorer = Scorer(sent.value)
        for batch in batches:
            for part in slices(batch, "text"):
                p, text, spans = scorer.sentences(part.column("text"))
                found = np.flatnonzero(p >= threshold)
                first = np.searchsorted(text, text[found])
                raw = [t.encode() for t in part.column("text").to_pylist()] if len(found) else []
                shown = [raw[text[k]][spans[0, k] : spans[1, k]].decode() for k in found]
                yield part.column("id").take(pa.array(text[found])), [found - first, shown, p[found]]

    return map_columns(rows, f"{id_col} long, sentence long, sentence_text string, probability double", run)
