"""Training by epochs and inference in batches for the text classifier.

Texts are bags of hashed words weighted by inverse document frequency; a row's vector has length one. The model is a softmax over
two classes. An epoch is one pass over the rows for all folds at once: every fold's state scores each row, rows of other folds add to its
gradient of the class-weighted cross-entropy, and rows of its own validate it. Rows stay where they are; a task hands on one vector of sums for
each fold, as large as the model. Contributions are whole multiples of 2**-30, so their sums, and with them
the models, do not depend on how rows are dealt to tasks.

Each fold starts from its own seed and keeps the state with the best F1 on its rows. Blank and null texts teach nothing and are scored like any other.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from thermalis.operators.evaluation import group_folds
from thermalis.sources.scratch import saved

#: Features of a text; texts scored at once by batched inference.
FEATURES, BATCH = 1 << 12, 64
#: Bytes of text, and places of texts, that a task handles at once; one longer text forms a slice of its own.
TEXT_BYTES, PLACES = 2 << 20, 1 << 18
_UNIT = float(1 << 30)
_GAPS = re.compile("[^a-z0-9']+")


def words(text: str | None) -> list[str]:
    """The words that ``evaluation.baseline_model`` splits a text into."""
    return [w for w in _GAPS.split((text or "").lower()) if w]


def murmur3(data: bytes, seed: int = 42) -> int:
    """Signed 32-bit MurmurHash3 (x86), by which Spark's HashingTF numbers its terms."""
    full, h = 0xFFFFFFFF, seed

    def scramble(k: int) -> int:
        k = k * 0xCC9E2D51 & full
        return ((k << 15 | k >> 17) & full) * 0x1B873593 & full

    whole = len(data) // 4 * 4
    for i in range(0, whole, 4):
        h ^= scramble(int.from_bytes(data[i : i + 4], "little"))
        h = ((h << 13 | h >> 19) & full) * 5 + 0xE6546B64 & full
    if whole < len(data):
        h ^= scramble(int.from_bytes(data[whole:], "little"))
    h ^= len(data)
    for shift, factor in ((16, 0x85EBCA6B), (13, 0xC2B2AE35)):
        h = (h ^ h >> shift) * factor & full
    h ^= h >> 16
    return h - (1 << 32) if h >> 31 else h


class Places(dict):
    """Feature numbers of words, remembered up to a bound."""

    def __init__(self, features: int, most: int = 200_000):
        super().__init__()
        self.features, self.most = features, most

    def __missing__(self, word: str) -> int:
        if len(self) >= self.most:
            self.clear()
        place = self[word] = murmur3(word.encode()) % self.features
        return place


def slices(batch: pa.RecordBatch, sizes: pa.Array, limit: int) -> Iterator[pa.RecordBatch]:
    """Cut a batch so that no slice has more than ``limit`` of ``sizes``, but for single rows."""
    ends, start = np.cumsum(sizes.fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64)), 0
    while start < batch.num_rows:
        base = ends[start - 1] if start else 0
        stop = max(start + 1, int(np.searchsorted(ends, base + limit, side="right")))
        yield batch.slice(start, stop - start)
        start = stop


class Bags:
    """Texts as counts of features: ``rows``, ``places`` and ``counts`` of their entries, by row and place."""

    def __init__(self, size: np.ndarray, flat: np.ndarray, features: int):
        self.n = len(size)
        keys, self.counts = np.unique(np.repeat(np.arange(self.n), size) * features + flat, return_counts=True)
        self.rows, self.places = keys // features, keys % features
        self.filled = np.unique(self.rows)
        self.starts = np.searchsorted(self.rows, self.filled)

    @classmethod
    def of_lists(cls, lists: list, features: int) -> Bags:
        size = np.array([len(x) for x in lists], np.int64)
        return cls(size, np.fromiter((p for x in lists for p in x), np.int64, int(size.sum())), features)

    @classmethod
    def of_column(cls, lists: pa.ListArray, features: int) -> Bags:
        return cls(lists.value_lengths().to_numpy(zero_copy_only=False).astype(np.int64), lists.flatten().to_numpy(zero_copy_only=False).astype(np.int64), features)

    def per_row(self, values: np.ndarray) -> np.ndarray:
        """Sums of entries' values; the order inside a row is by place, whatever rows are beside it."""
        out = np.zeros(self.n)
        if len(values):
            out[self.filled] = np.add.reduceat(values, self.starts)
        return out

    def weighted(self, idf: np.ndarray, unit: bool) -> np.ndarray:
        values = self.counts * idf[self.places]
        if not unit:
            return values
        length = np.sqrt(self.per_row(values * values))
        return values / np.maximum(length, 1e-300)[self.rows]


def softmax(scores: np.ndarray) -> np.ndarray:
    """Of each row of two scores."""
    e = np.exp(scores - scores.max(axis=1, keepdims=True))
    return e / e.sum(axis=1, keepdims=True)


class State:
    """A model: weights of (class, feature), intercepts, inverse document frequencies, and whether rows have length one."""

    def __init__(self, weights: np.ndarray, bias: np.ndarray, idf: np.ndarray, unit: bool):
        self.weights, self.bias, self.idf, self.unit = weights, bias, idf, unit

    def scores(self, bags: Bags) -> np.ndarray:
        values = bags.weighted(self.idf, self.unit)
        return np.column_stack([bags.per_row(values * self.weights[c][bags.places]) + self.bias[c] for c in (0, 1)])

    @classmethod
    def of_pipeline(cls, model) -> State:
        """Of a fitted ``evaluation.baseline_model``."""
        idf, head = model.stages[2].idf.toArray(), model.stages[3]
        one = head.coefficients.toArray()
        return cls(np.stack([np.zeros_like(one), one]), np.array([0.0, head.intercept]), idf, False)


def predict_batched(df: DataFrame, states: dict[int, State], text_col: str = "sentence", fold_col: str | None = None, batch: int = BATCH) -> DataFrame:
    """``df`` with pred_label and pred_prob_1, scored ``batch`` texts at a time.

    A worker process loads the states once. With ``fold_col`` each row is scored by the state
    of its fold, else by the only state.
    """
    from pyspark.ml.functions import predict_batch_udf
    from pyspark.sql.types import StructType

    features = next(iter(states.values())).weights.shape[1]

    def load() -> Callable:
        places = Places(features)

        def predict(texts: np.ndarray, folds: np.ndarray) -> dict[str, np.ndarray]:
            bags = Bags.of_lists([[places[w] for w in words(t)] for t in texts.ravel()], features)
            chance, folds = np.full((bags.n, 2), np.nan), folds.ravel()
            for fold in np.unique(folds):
                own = folds == fold
                chance[own] = softmax(states[int(fold)].scores(bags))[own]
            return {"pred_label": chance.argmax(axis=1).astype(np.int32), "pred_prob_1": chance[:, 1]}

        return predict

    score = predict_batch_udf(load, return_type=StructType.fromDDL("pred_label int, pred_prob_1 double"), batch_size=batch)
    fold = F.col(fold_col) if fold_col else F.lit(next(iter(states)))
    out = df.withColumn("_p", score(F.coalesce(F.col(text_col).cast("string"), F.lit("")), fold.cast("int")))
    return out.select(*df.columns, "_p.pred_label", "_p.pred_prob_1")


class Trained:
    """``states`` by fold, the best of each; ``history``: fold, epoch, loss, accuracy, precision, recall, f1."""

    def __init__(self, states: dict[int, State], history: pd.DataFrame):
        self.states, self.history = states, history

    def history_table(self, spark) -> DataFrame:
        return spark.createDataFrame(self.history, "fold int, epoch int, loss double, accuracy double, precision double, recall double, f1 double")


def _featured(df: DataFrame, features: int) -> DataFrame:
    """fold, label and feature numbers of every row with words; null labels teach nothing."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        places = Places(features)
        for batch in batches:
            for b in slices(batch, pc.binary_length(batch.column("text")), TEXT_BYTES):
                lists = pa.array([np.fromiter((places[w] for w in words(t)), np.int32) for t in b.column("text").to_pylist()], pa.list_(pa.int32()))
                yield pa.RecordBatch.from_arrays([b.column("fold"), b.column("label"), lists], names=["fold", "label", "places"])

    return df.mapInArrow(run, "fold int, label int, places array<int>").where("size(places) > 0")


def _sums(rows: DataFrame, folds: int, width: int, add: Callable[[np.ndarray, pa.RecordBatch], None]) -> np.ndarray:
    """By fold: the whole numbers that ``add`` puts into a task's (folds, width) sums from slices of the task's rows."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((folds, width), np.int64)
        for batch in batches:
            for b in slices(batch, batch.column("places").value_lengths(), PLACES):
                add(total, b)
        sums = pa.ListArray.from_arrays(pa.array(np.arange(folds + 1) * width, pa.int32()), pa.array(total.ravel()))
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(folds), pa.int32()), sums], names=["fold", "sums"])

    return _added(rows.mapInArrow(run, "fold int, sums array<long>"), folds, width)


def _added(parts: DataFrame, folds: int, width: int) -> np.ndarray:
    """Vectors of whole numbers added up by fold: folds * width numbers reach the driver."""
    sums = parts.select("fold", F.posexplode("sums").alias("at", "x")).where("x <> 0").groupBy("fold", "at").agg(F.sum("x").alias("x")).toPandas()
    out = np.zeros((folds, width), np.int64)
    out[sums["fold"].to_numpy(int), sums["at"].to_numpy(int)] = sums["x"].to_numpy(np.int64)
    return out


def _frequencies(rows: DataFrame, folds: int, features: int) -> tuple[np.ndarray, np.ndarray]:
    """By fold: rows of either label, and in how many rows a feature occurs."""

    def add(sums, b):
        bags, fold = Bags.of_column(b.column("places"), features), b.column("fold").to_numpy()
        np.add.at(sums, (fold, b.column("label").to_numpy()), 1)
        np.add.at(sums, (fold[bags.rows], 2 + bags.places), 1)

    out = _sums(rows, folds, 2 + features, add)
    return out[:, :2], out[:, 2:]


def _epoch(rows: DataFrame, states: list[State], weights: np.ndarray) -> np.ndarray:
    """By fold: gradient of (class, feature) and of the intercepts, loss, weight, and tp, fp, fn, tn on the fold's own rows."""
    features, folds = states[0].weights.shape[1], len(states)

    def add(total, b):
        bags, fold, label = Bags.of_column(b.column("places"), features), b.column("fold").to_numpy(), b.column("label").to_numpy()
        for k, state in enumerate(states):
            chance, others = softmax(state.scores(bags)), fold != k
            guess = chance.argmax(axis=1)[~others]
            hit = label[~others]
            total[k, -4:] += [np.sum((guess == g) & (hit == h)) for g, h in ((1, 1), (1, 0), (0, 1), (0, 0))]
            weight = np.where(others, weights[k][label], 0.0)
            values = bags.weighted(state.idf, state.unit)
            for c in (0, 1):
                push = weight * (chance[:, c] - (label == c))
                each = np.rint(values * push[bags.rows] * _UNIT)  # whole numbers, whose sums below 2**53 are exact
                total[k, c * features : (c + 1) * features] += np.bincount(bags.places, each, features).astype(np.int64)
                total[k, 2 * features + c] += int(np.rint(push * _UNIT).sum())
            losses = -np.log(np.maximum(chance[np.arange(bags.n), label], 1e-300)) * weight
            total[k, 2 * features + 2] += int(np.rint(losses * _UNIT).sum())
            total[k, 2 * features + 3] += int(np.rint(weight * _UNIT).sum())

    return _sums(rows, folds, 2 * features + 8, add)


def _quality(tp: int, fp: int, fn: int, tn: int) -> tuple[float, float, float, float]:
    share = lambda a, b: a / b if b else 0.0
    precision, recall = share(tp, tp + fp), share(tp, tp + fn)
    return share(tp + tn, tp + fp + fn + tn), precision, recall, share(2 * precision * recall, precision + recall)


def train_by_epochs(df: DataFrame, fold_col: str = "fold_id", folds: int = 5, text_col: str = "sentence", label_col: str = "label", epochs: int = 8, rate: float = 0.05, decay: float = 0.01, seed: int = 42, features: int = FEATURES) -> Trained:
    """One model a fold, each trained on the rows of all other folds and validated on its own after every epoch.

    Rows whose fold is ``folds`` belong to none: every model learns from them. A fold without own rows keeps its last state. The steps are Adam's with weight decay. A fold whose training rows lack a class is an error, as for ``class_weights``.
    """
    rows = df.where(F.col(label_col).isin(0, 1)).select(F.col(fold_col).cast("int").alias("fold"), F.col(label_col).cast("int").alias("label"), F.col(text_col).cast("string").alias("text"))
    rows = saved(_featured(rows.where(F.col("fold").between(0, folds)), features), "features")
    labels, found = _frequencies(rows, folds + 1, features)
    states, weights = [], np.zeros((folds, 2))
    for k in range(folds):
        n = labels.sum(axis=0) - labels[k]
        if not n.all():
            raise ValueError("class weights need two classes")
        weights[k] = n.sum() / (2 * n)
        idf = np.log((n.sum() + 1) / (found.sum(axis=0) - found[k] + 1))
        start = np.random.default_rng(seed + k).normal(0, 0.01, (2, features))
        states.append(State(start, np.zeros(2), idf, True))
    mean, spread = [np.zeros((folds, 2, features + 1)) for _ in range(2)]
    best, history = {}, []
    for epoch in range(epochs + 1):  # the last pass only validates
        sums = _epoch(rows, states, weights)
        for k, state in enumerate(states):
            total = max(sums[k, 2 * features + 3] / _UNIT, 1e-300)
            quality = _quality(*map(int, sums[k, -4:]))
            history.append((k, epoch, sums[k, 2 * features + 2] / _UNIT / total, *quality))
            if epoch and (k not in best or not sums[k, -4:].any() or quality[3] > best[k][0]):
                best[k] = quality[3], state
            if epoch < epochs:
                slope = np.column_stack([sums[k, : 2 * features].reshape(2, features), sums[k, 2 * features : 2 * features + 2]]) / _UNIT / total
                mean[k] = 0.9 * mean[k] + 0.1 * slope
                spread[k] = 0.999 * spread[k] + 0.001 * slope * slope
                t = epoch + 1
                step = rate * (mean[k] / (1 - 0.9**t)) / (np.sqrt(spread[k] / (1 - 0.999**t)) + 1e-8)
                states[k] = State(state.weights * (1 - rate * decay) - step[:, :-1], state.bias - step[:, -1], state.idf, True)
    kept = pd.DataFrame(history, columns=["fold", "epoch", "loss", "accuracy", "precision", "recall", "f1"])
    return Trained({k: s for k, (_, s) in best.items()}, kept.astype({"fold": "int32", "epoch": "int32"}))


def train_final(df: DataFrame, **how) -> State:
    """The last state of one model trained on all rows, with nothing held out."""
    return train_by_epochs(df.withColumn("_fold", F.lit(1)), "_fold", 1, **how).states[0]


def cross_train(df: DataFrame, group: str = "city_id", folds: int = 5, **how) -> tuple[Trained, DataFrame]:
    """Trained folds by whole groups, and every row predicted by the model that did not see its group.

    Rows without a group take no part.
    """
    placed = df.join(group_folds(df, group, folds).select(group, F.col("fold").alias("fold_id")), group)
    trained = train_by_epochs(placed, "fold_id", folds, **how)
    return trained, predict_batched(placed, trained.states, fold_col="fold_id")
