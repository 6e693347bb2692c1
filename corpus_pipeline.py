"""Documents to training sequences: five operators in a row, each stage's rows saved and read again.

A stage is (name, function); a function takes (spark, docs, sf_dir) and returns a DataFrame.  All but
the last return the columns of documents.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cotejo.llm.decontam import contamination
from cotejo.llm.kernels import free_name
from cotejo.llm.neardup import near_duplicates
from cotejo.llm.packing import pack
from cotejo.llm.quality import judge
from cotejo.llm.substring import remove_repeats
from cotejo.plans.saved import saved

#: The last stage's rows depend on a tokenizer and on partitions, which SQL doesn't express.
ORACLE_SQL = None


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality rules keep."""
    return judge(docs).where("kept").select(docs.columns)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each group of near-duplicates: that of the smallest doc_id (rows without one come last).

    Rows are judged one by one, by a number of their own, so rows that share a doc_id and rows without one
    stay unless their text is in the group of another row.
    """
    key = free_name(docs.columns, "row_key")
    keyed = saved(docs.withColumn(key, F.monotonically_increasing_id()))
    found = near_duplicates(keyed.select(F.col(key).alias("doc_id"), "text")).select(F.col("doc_id").alias(key), "component_id")
    kept = found.join(keyed.select(key, "doc_id"), key).groupBy("component_id").agg(F.min(F.struct(F.col("doc_id").isNull().alias("last"), "doc_id", key)).alias("first"))
    return keyed.join(kept.select(F.col("first").getField(key).alias(key)).hint("shuffle_hash"), key, "left_semi").select(docs.columns)


def substring_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without the passages that a document with a smaller doc_id has; texts that lose every word go."""
    left = remove_repeats(docs).where("n_removed = 0 OR kept <> ''").withColumn("text", F.when(F.col("n_removed") > 0, F.col("kept")).otherwise(F.col("text")))
    if "n_chars" in docs.columns:
        left = left.withColumn("n_chars", F.when(F.col("n_removed") > 0, F.length("text").cast("long")).otherwise(F.col("n_chars")))
    return left.select(docs.columns)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a passage of the benchmark."""
    found = contamination(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))
    return found.where("n_hit = 0").select(docs.columns)


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str, tokenizer: str | None = None) -> DataFrame:
    """Pieces of token sequences."""
    if tokenizer is None:
        import public_tokenizers

        tokenizer = public_tokenizers.path("word_bpe_49k.json")
    return pack(docs, tokenizer)


STAGES = [
    ("quality rules", quality),
    ("near-duplicate removal", near_dedup),
    ("substring dedup", substring_dedup),
    ("benchmark decontamination", decontamination),
    ("packing", packing),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The last stage's rows over the documents of sf_dir."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for _, stage in STAGES[:-1]:
        docs = saved(stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)
