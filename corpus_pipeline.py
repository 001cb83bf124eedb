"""A corpus pipeline: toxic documents go, one of each near-copy group stays, benchmark passages are cut out, sources
are mixed to their weights, and token ids are written and read back. Each stage is written before the next reads it.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from terraloom.llm import decontaminate, mixing, neardup, tokens, toxicity
from terraloom.llm.queries import table, tokenizer_path
from terraloom.llm.shared import stored


def small_batches(spark: SparkSession) -> None:
    """Has Spark hand Python tasks fewer rows at a time than by default: rows here are whole documents."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "2000")


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the calibrated votes don't call toxic. Without labelled documents all stay; null texts and ids do, too."""
    small_batches(spark)
    votes = toxicity.fit_from_labels(docs, table(spark, sf_dir, "labels"))
    scored = toxicity.score_toxicity(docs, votes)
    return scored.where("toxicity.predicted = 0").select(*docs.columns)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The document of the smallest id of each group linked by shingle similarity; others stay as they are."""
    small_batches(spark)
    return neardup.keep_one(docs)


def cut_benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without the words that benchmark windows cover, n_chars adjusted; one that had only such words goes."""
    small_batches(spark)
    cut = decontaminate.remove_leaks(docs.withColumn("__chars", F.length("text")), table(spark, sf_dir, "benchmark"))
    changed = F.col("__chars").isNotNull() & (F.length("text") != F.col("__chars"))
    cut = cut.where(~changed | (F.length("text") > 0))
    if "n_chars" in docs.columns:
        cut = cut.withColumn("n_chars", F.when(changed, F.length("text").cast(docs.schema["n_chars"].dataType)).otherwise(F.col("n_chars")))
    return cut.select(*docs.columns)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document as often as its source's repetition rate and its own draw say."""
    small_batches(spark)
    return mixing.mix(docs)


def write_tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row per written record, read back by key: doc_id, start, n_tokens, ids_crc32, shard, record."""
    small_batches(spark)
    manifest = tokens.write_token_shards(docs, tokenizer_path())
    return tokens.read_token_shards(manifest).withColumnRenamed("key", "doc_id")


STAGES = [
    ("toxicity", drop_toxic),
    ("near_copies", drop_near_copies),
    ("decontamination", cut_benchmark),
    ("mixing", mix_sources),
    ("tokens", write_tokens),
]

#: SQL can express neither the trained votes nor the tokenizer; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = stored(stage(spark, docs, sf_dir), name)
    return docs
