"""A training corpus from raw documents: four stages, each one written before the next.

toxicity (documents judged toxic go), n-gram Jaccard join (of each group of near copies
the one with the least id stays), benchmark decontamination (documents with a passage of
a benchmark item go), BPE encoding and decoding (what stays, as token ids and decoded
text by digest). Every stage but the last returns the columns of ``documents``.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from thermalis.llm import bpe_codec, decontaminate, jaccard_join, toxicity
from thermalis.llm.queries import crc_fold, table
from thermalis.llm.scratch import Scratch


def without(docs: DataFrame, ids: DataFrame) -> DataFrame:
    """``docs`` whose doc_id is not among ``ids``; rows with a null id stay."""
    return docs.join(ids.select("doc_id").distinct(), "doc_id", "left_anti").select(*docs.columns)


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The model learns from labelled rows outside the held-out fold, among the stage's own documents.

    Rows go one by one, whatever their ids; null and empty texts score 0 and stay, and without labels every row does.
    """
    model = toxicity.train(docs, table(spark, sf_dir, "labels").where(crc_fold() != 0))
    return toxicity.without_toxic(docs, model)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Five-word shingles, similarity 0.8; of each group the rows with the least id stay.

    Rows that share an id stay or go together; null ids, and null, empty and wordless texts, link with nothing and stay.
    """
    groups = jaccard_join.cluster_sets(docs, n=5, percent=80)
    return without(docs, groups.where("component_id <> doc_id"))


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows with a passage of a benchmark item go, judged one by one where they lie (null ids, repeats and all); null and empty texts stay."""
    return decontaminate.without_contaminated(docs, table(spark, sf_dir, "benchmark"))


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of digests for each document; null texts count as empty, repeated rows give repeated rows."""
    return bpe_codec.digests(bpe_codec.encode_decode(docs, public_tokenizers.path("word_bpe_49k.json")))


STAGES = [
    ("toxicity", drop_toxic),
    ("ngram_jaccard_join", drop_near_copies),
    ("benchmark_decontamination", drop_contaminated),
    ("bpe_codec", encode),
]

#: No stage but simple filters can be stated in SQL; tests compare with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``; a stage's table is dropped once the next one is written. Empty tables and extra columns pass through."""
    scratch, docs, before = Scratch(spark), table(spark, sf_dir, "documents"), None
    for _, stage in STAGES:
        docs = scratch.save(stage(spark, docs, sf_dir))
        if before is not None:
            scratch.drop(before)
        before = docs
    return docs
