"""A training corpus made from ``documents``, stage by stage.

Each stage's result is written as Parquet to the shared folder and read again, so
a lost executor costs no more than the stage at hand.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from eventloom.llm import decontam, mixing, neardup, quality, secretscan
from eventloom.session import broadcast_if_small, durable, scratch_path, tune

COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")


def good_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows whose text the classifier rejects go. It is trained on the labelled ones among ``docs``."""
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    rows = _keyed(docs)
    scored = quality.predict(rows.select(F.col("row").alias("doc_id"), "text"), quality.train(docs, labels))
    return _without(rows, scored.where("predicted = 0").select(F.col("doc_id").alias("row")))


def distinct_enough(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each group of near-duplicates stays: the one with the smallest doc_id, null last.

    Among equal ids it is the one with the smallest hash of the text, then the first row.
    """
    rows = _keyed(docs)
    return _without(rows, neardup.surplus(rows, "row", width=5, percent=80))


def decontaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows that hold a passage of the benchmark go."""
    benchmark = spark.read.parquet(f"{sf_dir}/benchmark.parquet")
    rows = _keyed(docs)
    met = decontam.overlaps(rows.select(F.col("row").alias("doc_id"), "text"), benchmark)
    return _without(rows, met.select(F.col("doc_id").alias("row")))


def without_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every secret is replaced by a mark; the rest of the text and all other documents stay as they are."""
    return secretscan.redacted(docs.select(*COLUMNS), secretscan.advance(docs).findings)


def mixed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The training mix: taken blocks by shard and slot, each piece with its doc_id and text."""
    return mixing.mixture(docs).text(docs)


def _keyed(docs: DataFrame) -> DataFrame:
    """``docs`` with a stored key of each row, so that repeated and null ids are told apart.

    Rows read straight from Parquet files are known by file and position; any others are
    stored with a number.
    """
    if docs._jdf.queryExecution().analyzed().nodeName() == "LogicalRelation":
        return docs.select(*COLUMNS, F.concat_ws(" ", "_metadata.row_index", "_metadata.file_path").alias("row"))
    path = scratch_path(docs.sparkSession, "rows")
    docs.select(*COLUMNS, F.monotonically_increasing_id().cast("string").alias("row")).write.parquet(path)
    return docs.sparkSession.read.parquet(path)


def _without(rows: DataFrame, rejected: DataFrame) -> DataFrame:
    """``rows`` of ``_keyed`` but for those whose key is in ``rejected``, without the key."""
    keys = durable(rejected.select("row").distinct())
    return rows.join(broadcast_if_small(keys), "row", "left_anti").select(*COLUMNS)


#: Applied in this order; each works on all rows that its predecessor kept.
STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("quality classifier", good_quality),
    ("minhash near-dedup", distinct_enough),
    ("benchmark decontamination", decontaminated),
    ("secret scans", without_secrets),
    ("source mixing", mixed),
]

#: Trained and drawn stages have no SQL; tests hold every stage against a plain version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    tune(spark)
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for _, stage in STAGES:
        path = scratch_path(spark, "stage")
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return docs
