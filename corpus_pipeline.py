"""The corpus pipeline: quality, near-duplicates, repeated passages, source mix, packing.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame; ``run`` writes each stage's result as Parquet to the shared
folder and hands what it reads from there to the next. All but the last return the columns of ``documents``. Every stage
works on all that its predecessor kept. Further columns of ``docs``, whatever their names, are left out. An empty table gives an empty one
in every stage, and nulls in ``lang``, ``source`` and ``n_chars`` are values like any other.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lattica.llm import common, mixing, packing, quality, simhash, substring_dedup

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents scored below the threshold go. The labels are those of the corpus; held-out ones are not read.

    Null and empty texts score the share of good ones among the labelled, and so stay or go together. Null ids are scored like others; rows
    repeated whole and texts that tie score alike and all stay or all go. Texts of any length are read whole."""
    return quality.keep_good(docs.select(*COLUMNS), common.table(spark, sf_dir, "labels")).select(*COLUMNS)


def near_dedup_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each near-duplicate group stays: the one with the smallest id.

    Null and empty texts are one group (fingerprint zero). Of rows repeated whole one stays; of rows with one id but different texts the smallest text, null
    first. Rows with a null id stay only where their group has no other id, and then one of them does."""
    return simhash.near_dedup(docs.select(*COLUMNS))


def substring_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Words of repeated passages go. A document that loses words becomes its other words, joined by one space, and one
    that loses all of them goes; a document that loses none, null and empty texts among them, keeps its text as it is.

    Null ids lose nothing. Rows repeated whole are one document and keep the same words. ``n_chars`` is that of the text that is left."""
    out = substring_dedup.rlz_dedup(docs.select(*COLUMNS))
    lost = F.col("dedup.n_removed") > 0
    out = out.filter(~lost | (F.col("dedup.n_removed") < F.col("dedup.n_words")))
    out = out.withColumn("n_chars", F.when(lost, F.length("dedup.kept").cast("long")).otherwise(F.col("n_chars")))
    return out.withColumn("text", F.when(lost, F.col("dedup.kept")).otherwise(F.col("text"))).select(*COLUMNS)


def mixing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each source comes to its target: documents are repeated or left out, one a source may be cut.

    Documents without words (null, empty) have no row. A null source is a source. Rows repeated whole each have their own words. ``n_chars`` is that of the text
    that is taken."""
    out = mixing.mix(docs.select(*COLUMNS))
    return out.withColumn("n_chars", F.length("text").cast("long")).select(*COLUMNS)


def packing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of all documents in sequences. Null and empty texts are the end id alone; null and repeated ids are documents of their own."""
    return packing.harmonic_pack(docs.select(*COLUMNS))


STAGES = [
    ("quality classifier", quality_stage),
    ("SimHash near-dedup", near_dedup_stage),
    ("substring dedup", substring_stage),
    ("mixing sources to target weights", mixing_stage),
    ("packing", packing_stage),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = common.table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = common.written(stage(spark, docs, sf_dir), "stage")
    return docs


QUERIES = {"pipeline": run}

#: A fitted classifier and tokenizer ids are beyond SQL; tests compare with a brute-force version instead.
ORACLE_SQL = None
