"""Metrics, class weights, grouped folds, audit samples and a trainable baseline."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from thermalis.sources.scratch import saved


def ratio(a, b) -> Column:
    """a / b, 0 where b is 0."""
    return F.coalesce(F.try_divide(a, b), F.lit(0.0))


def confusion_metrics(label: str = "label", predicted: str = "pred_label") -> list[Column]:
    y, p = F.col(label), F.col(predicted)
    count = lambda c: F.sum(F.when(c, 1).otherwise(0))
    tp, right = count((y == 1) & (p == 1)), count(y == p)
    pos, found = count(y == 1), count(p == 1)
    precision, recall = ratio(tp, found), ratio(tp, pos)
    return [F.count("*").alias("n"), ratio(right, F.count("*")).alias("accuracy"), precision.alias("precision"), recall.alias("recall"), ratio(2 * precision * recall, precision + recall).alias("f1")]


def overall_metrics(df: DataFrame, label: str = "label", predicted: str = "pred_label") -> DataFrame:
    return df.agg(*confusion_metrics(label, predicted))


def monthly_metrics(df: DataFrame, month: str = "month", label: str = "label", predicted: str = "pred_label") -> DataFrame:
    """Months with both classes only."""
    both = df.groupBy(month).agg(*confusion_metrics(label, predicted), F.min(label).alias("lo"), F.max(label).alias("hi"))
    return both.where("lo <> hi").drop("lo", "hi")


def classification_report(df: DataFrame, label: str = "label", predicted: str = "pred_label") -> DataFrame:
    """Per class, then macro and weighted averages."""
    cells = df.groupBy(F.col(label).alias("y"), F.col(predicted).alias("p")).count()
    sides = cells.select(F.explode(F.array(F.struct(F.col("y").alias("c"), F.lit(1).alias("true"), F.lit(0).alias("pred"), F.lit(0).alias("hit")), F.struct(F.col("p").alias("c"), F.lit(0).alias("true"), F.lit(1).alias("pred"), (F.col("y") == F.col("p")).cast("int").alias("hit")))).alias("s"), "count")
    per = sides.groupBy(F.col("s.c").alias("class")).agg(*(F.sum(F.col(f"s.{k}") * F.col("count")).alias(k) for k in ("true", "pred", "hit")))
    per = per.select(F.col("class").cast("string").alias("class"), ratio(F.col("hit"), F.col("pred")).alias("precision"), ratio(F.col("hit"), F.col("true")).alias("recall"), F.col("true").alias("support"))
    per = per.withColumn("f1", ratio(2 * F.col("precision") * F.col("recall"), F.col("precision") + F.col("recall")))
    names = ("precision", "recall", "f1")
    macro = per.agg(F.lit("macro avg").alias("class"), *(F.avg(c).alias(c) for c in names), F.sum("support").alias("support"))
    weighted = per.agg(F.lit("weighted avg").alias("class"), *((F.sum(F.col(c) * F.col("support")) / F.sum("support")).alias(c) for c in names), F.sum("support").alias("support"))
    order = ["class", *names, "support"]
    return per.select(order).union(macro.select(order)).union(weighted.select(order))


def fold_summary(df: DataFrame, metrics: tuple[str, ...] = ("accuracy", "precision", "recall", "f1")) -> DataFrame:
    """Mean and population deviation of each metric over folds."""
    return df.agg(*(f(m).alias(f"{m}_{n}") for m in metrics for n, f in (("mean", F.avg), ("std", F.stddev_pop))))


def class_weights(df: DataFrame, label: str = "label") -> DataFrame:
    """Balanced weights n / (classes * n of class); needs exactly two classes."""
    per = df.groupBy(label).agg(F.count("*").alias("n_class"))
    whole = Window.partitionBy()  # two rows
    out = per.withColumn("k", F.count("*").over(whole)).withColumn("n", F.sum("n_class").over(whole))
    checked = F.when(F.col("k") == 2, F.col("n") / (F.col("k") * F.col("n_class"))).otherwise(F.raise_error(F.lit("class weights need two classes")))
    return out.select(label, "n_class", checked.cast("double").alias("class_weight"))


def group_folds(df: DataFrame, group: str = "city_id", folds: int = 5) -> DataFrame:
    """(group, n, fold): groups by size descending (then name) go to the lightest fold, of equals to the first.

    The sizes are combined before the shuffle; then one row for each group streams past a heap of the folds' loads.
    Fewer than two groups are an error.
    """
    sizes = df.where(F.col(group).isNotNull()).groupBy(group).agg(F.count("*").alias("n"))

    def deal(batches):
        import heapq

        heap, seen = [(0, k) for k in range(folds)], 0
        for b in batches:
            placed = []
            for n in b["n"]:
                load, fold = heap[0]
                heapq.heapreplace(heap, (load + int(n), fold))
                placed.append(fold)
            seen += len(placed)
            b["fold"] = placed
            yield b
        if min(seen, folds) < 2:
            raise ValueError("grouped folds need two groups")

    kind = df.schema[group].dataType.simpleString()
    return sizes.repartition(1).sortWithinPartitions(F.desc("n"), group).mapInPandas(deal, f"`{group}` {kind}, n long, fold int")


def audit_allocation(df: DataFrame, month: str = "month", stratum: str = "continent", per_month: int = 500) -> DataFrame:
    """Rows to audit per month and stratum: proportional, half-even, drift spread over strata by size."""
    n = df.groupBy(F.col(month).alias("month"), F.col(stratum).alias("stratum")).agg(F.count("*").alias("n"))
    m = Window.partitionBy("month")
    out = n.withColumn("target", F.least(F.lit(per_month), F.sum("n").over(m)))
    out = out.withColumn("share", F.bround(F.col("n") / F.sum("n").over(m) * F.col("target")).cast("long"))
    out = out.withColumn("diff", F.col("target") - F.sum("share").over(m)).withColumn("k", F.row_number().over(m.orderBy(F.desc("n"), "stratum")) - 1).withColumn("strata", F.count("*").over(m))
    turns = F.floor(F.abs(F.col("diff")) / F.col("strata")) + (F.col("k") < F.abs(F.col("diff")) % F.col("strata")).cast("long")
    return out.select("month", "stratum", "n", F.least(F.col("n"), F.greatest(F.lit(0), F.col("share") + F.signum("diff").cast("long") * turns)).cast("long").alias("n_take"))


def audit_sample(df: DataFrame, month: str = "month", stratum: str = "continent", per_month: int = 500, seed: int = 42) -> DataFrame:
    """Rows chosen in the order of a digest of seed and row inside each stratum, with empty review columns.

    A row competes first inside one of 32 slices of its stratum, so a stratum with most of
    the rows is not ordered in one task.
    """
    take = audit_allocation(df, month, stratum, per_month).where("n_take > 0").select(F.col("month").alias("m"), F.col("stratum").alias("s"), "n_take")
    joined = df.join(take, (F.col(month) == F.col("m")) & (F.col(stratum) == F.col("s")))
    order = F.md5(F.concat(F.lit(f"{seed}:"), F.col("row_index").cast("string")).cast("binary"))
    cut = joined.withColumn("slice", F.pmod(F.xxhash64("row_index"), F.lit(32)))
    first = cut.withColumn("r", F.row_number().over(Window.partitionBy("m", "s", "slice").orderBy(order, "row_index"))).where("r <= n_take")
    last = first.withColumn("r", F.row_number().over(Window.partitionBy("m", "s").orderBy(order, "row_index"))).where("r <= n_take")
    return last.select(*df.columns, F.lit("").alias("manual_label"), F.lit("").alias("manual_review_notes"), F.lit("pending").alias("audit_status"))


def baseline_model(seed: int = 42, features: int = 1 << 14):
    """Untrained text classifier: hashed words, inverse document frequency, weighted logistic regression."""
    from pyspark.ml import Pipeline
    from pyspark.ml.classification import LogisticRegression
    from pyspark.ml.feature import IDF, HashingTF, RegexTokenizer

    return Pipeline(
        stages=[
            RegexTokenizer(inputCol="sentence", outputCol="words", pattern="[^a-z0-9']+"),
            HashingTF(inputCol="words", outputCol="tf", numFeatures=features),
            IDF(inputCol="tf", outputCol="features"),
            LogisticRegression(labelCol="label", weightCol="class_weight", maxIter=20, regParam=0.01),
        ]
    )


def fit_baseline(df: DataFrame, seed: int = 42):
    """Fit on non-blank texts with balanced weights."""
    usable = df.where(F.trim("sentence") != "")
    weighted = usable.join(F.broadcast(class_weights(usable).select("label", "class_weight")), "label")
    return baseline_model(seed).fit(weighted)


def predict_baseline(model, df: DataFrame) -> DataFrame:
    from pyspark.ml.functions import vector_to_array

    out = model.transform(df)
    return out.select(*df.columns, F.col("prediction").cast("int").alias("pred_label"), vector_to_array("probability")[1].alias("pred_prob_1"))


def cross_validate(df: DataFrame, group: str = "city_id", folds: int = 5, seed: int = 42) -> DataFrame:
    """Predictions of every row by the model that did not see its group. One fit per fold."""
    placed = df.join(group_folds(df, group, folds).select(group, F.col("fold").alias("fold_id")), group)
    # every fit reads its rows several times: they are written once, so no pass joins them again
    placed = saved(placed, "placed")
    out = None
    for k in range(folds):
        fit = placed.where(F.col("fold_id") != k)
        held = placed.where(F.col("fold_id") == k)
        one = predict_baseline(fit_baseline(fit, seed + k), held)
        out = one if out is None else out.unionByName(one)
    return out
