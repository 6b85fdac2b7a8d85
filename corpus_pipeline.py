"""The corpus pipeline: each stage reads what the one before kept; the last packs it."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window, functions as F

from kerbline.llm import decontam, packing, quality, simhash, toxicity
from kerbline.session import scratch_path, ship_code

# What names a row in a decision: its id and its text, so that rows that share an id are judged apart.
ROW = ["doc_id", "__text"]


def _named(docs: DataFrame) -> DataFrame:
    return docs.withColumn("__text", F.xxhash64("text"))


def _same(other: str):
    return F.col("doc_id").eqNullSafe(F.col(f"{other}.doc_id")) & (F.col("__text") == F.col(f"{other}.__text"))


def reject_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents go whose score is 0.5 or more; the model learns from ``labels`` on this stage's input."""
    ship_code(spark)
    model = toxicity.fit(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    return docs.filter(toxicity.score_column(spark, model, F.col("text")) < 0.5)


def reject_low_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents go whose score is below 0.5."""
    ship_code(spark)
    weights, _ = quality.fit(docs)
    return docs.filter(quality.score_column(spark, weights, F.col("text")) >= 0.5)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document stays of every component of linked fingerprints: the one with the least id (then text hash)."""
    ship_code(spark)
    named = _named(docs)
    marked = simhash.near_duplicates(named.select(F.struct(*ROW).alias("row"), "text"), key="row")
    kept = marked.filter(F.col("row") == F.col("component_id")).select(F.col("row").alias("kept"))
    one = Window.partitionBy(*ROW).orderBy(F.lit(1))  # rows given twice; dealt as the join is
    return named.join(kept, _same("kept"), "left_semi").withColumn("__n", F.row_number().over(one)).filter("__n = 1").select(*docs.columns)


def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents go that carry benchmark windows in a twentieth of their words or more."""
    ship_code(spark)
    named = _named(docs)
    marked = decontam.find_contamination(named.select(F.struct(*ROW).alias("row"), "text"), spark.read.parquet(f"{sf_dir}/benchmark.parquet"), key="row")
    return named.join(marked.filter("contaminated").select(F.col("row").alias("gone")), _same("gone"), "left_anti").select(*docs.columns)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    ship_code(spark)
    return packing.pack_documents(docs)


STAGES = [
    ("toxicity", reject_toxic),
    ("quality classifier", reject_low_quality),
    ("simhash near-dedup", near_dedup),
    ("benchmark decontamination", decontaminate),
    ("best-fit packing", pack),
]

# The models, fingerprints and token ids of the stages have no SQL form.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages one after another over ``documents``, each written as Parquet and read again."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for n, (_, stage) in enumerate(STAGES):
        path = scratch_path(spark, f"stage{n}")
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return docs
