"""The numbered queries over the given tables, and SQL for those that SQL can express."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import decontaminate, langid, licenses, mixing, neardup, onebit, periodic, pii, repeats, spelling, tokens, toxicity, voting


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def tokenizer_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def op1_nearest_vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    index, how = onebit.build_index(table(spark, sf_dir, "embeddings"))
    return onebit.search(index, how, F.col("id") % 20 == 0)


def op2_token_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    manifest = tokens.write_token_shards(table(spark, sf_dir, "documents"), tokenizer_path())
    return tokens.read_token_shards(manifest).withColumnRenamed("key", "doc_id")


def op3_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.leak_digest(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op4_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses.scan_licenses(table(spark, sf_dir, "documents"))


def op5_mix_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    planned = mixing.mixing_plan(table(spark, sf_dir, "documents"))
    return planned.select("doc_id", "mix.size", "mix.source_size", "mix.target", (F.col("mix.size") * F.col("mix.copies")).alias("taken"))


def op6_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return neardup.jaccard_components(table(spark, sf_dir, "documents")).drop("n_rows")


def op7_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return repeats.repeat_digest(table(spark, sf_dir, "documents"))


def op8_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    docs = table(spark, sf_dir, "documents")
    held_out = F.coalesce(toxicity.fold("doc_id", 4) == 2, F.lit(False))
    models = langid.fit_languages(docs.where(~held_out), public_tokenizers.path("piece_bpe_32k.model"))
    found = langid.identify_languages(docs.select("doc_id", "text"), models)
    return found.select("doc_id", held_out.alias("held_out"), F.col("language.lang").alias("lang_pred"), "language.score")


def op9_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    votes = toxicity.fit_from_labels(docs, table(spark, sf_dir, "labels"))
    held_out = F.coalesce(toxicity.fold("doc_id", 3) == 1, F.lit(False))
    return toxicity.score_toxicity(docs, votes).select("doc_id", held_out.alias("held_out"), "toxicity.score", "toxicity.predicted")


def op10_personal_data(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return pii.pii_digest(docs, pii.fit_detector(docs))


def op11_quality_votes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return voting.quality_digest(table(spark, sf_dir, "documents"))


def op12_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Texts of which a tail is a repeated stretch where a hash of the document says so."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", F.crc32(F.col("doc_id").cast("string")).alias("h"))
    words = F.when(F.col("h") % 10 == 0, F.filter(F.split("text", r"[\x20\x09-\x0D]+"), lambda w: w != ""))
    docs = docs.withColumn("words", words).withColumn("n", F.size("words")).withColumn("g", F.expr("h div 10"))
    docs = docs.withColumn("a", F.when(F.col("n") > 0, F.col("g") % F.col("n")).cast("int")).withColumn("p", F.expr("1 + (n - a) div (3 + g % 8)").cast("int"))
    again = F.flatten(F.array_repeat(F.slice("words", F.col("a") + 1, F.col("p")), F.expr("(n - a) div p + 1").cast("int")))
    spoiled = F.array_join(F.concat(F.slice("words", F.lit(1), F.col("a")), F.slice(again, F.lit(1), F.col("n") - F.col("a"))), " ")
    return periodic.runs_digest(docs.select("doc_id", F.when(F.col("n") > 0, spoiled).otherwise(F.col("text")).alias("text")))


def op13_spelling_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Runs of which one letter is deleted where a hash of document and run says so."""

    def spoiled(run: Column) -> Column:
        h = F.crc32(F.concat_ws(":", F.coalesce(F.col("doc_id").cast("string"), F.lit("")), run))
        at = (h % F.length(run)).cast("int")
        return F.when(h % 31 == 0, F.concat(F.substr(run, F.lit(1), at), F.substr(run, at + 2))).otherwise(run)

    return spelling.spelling_groups(spelling.word_counts(table(spark, sf_dir, "documents"), change=spoiled))


OP5_SQL = r"""
WITH sized AS (SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+'))::BIGINT AS size FROM documents),
per AS (SELECT source, sum(size)::BIGINT AS source_size FROM sized GROUP BY source),
weighed AS (SELECT *, 1 + (row_number() OVER (ORDER BY source IS NULL, source) - 1) % 3 AS w FROM per),
reached AS (SELECT *, 3 * source_size AS most, 3 * source_size / w::DOUBLE AS reach FROM weighed),
leveled AS (SELECT *, sum(source_size) OVER () AS total,
  coalesce(sum(most) OVER (ORDER BY reach, source IS NULL, source ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before,
  sum(w) OVER (ORDER BY reach, source IS NULL, source ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS after FROM reached),
flagged AS (SELECT *, reach <= (total - before)::DOUBLE / after AS capped FROM leveled),
aimed AS (SELECT *, round(CASE WHEN capped THEN most::DOUBLE ELSE
  w * ((total - sum(CASE WHEN capped THEN most ELSE 0 END) OVER ())::DOUBLE / sum(CASE WHEN capped THEN 0 ELSE w END) OVER ()) END, 6) AS target FROM flagged),
rated AS (SELECT *, CASE WHEN source_size > 0 THEN least(target / source_size, 3.0::DOUBLE) ELSE 0.0::DOUBLE END AS rate FROM aimed),
drawn AS (SELECT d.doc_id, d.size, r.source_size, r.target, r.rate, floor(r.rate) AS whole,
  ('0x' || substr(md5('17:' || coalesce(d.doc_id::VARCHAR, '') || ':' || d.size), 1, 12))::BIGINT / 281474976710656.0::DOUBLE AS draw
  FROM sized d JOIN rated r ON d.source IS NOT DISTINCT FROM r.source)
SELECT doc_id, size, source_size, target, size * (whole + CASE WHEN draw < rate - whole THEN 1 ELSE 0 END)::BIGINT AS taken FROM drawn
"""

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_nearest_vectors": op1_nearest_vectors,
    "op2_token_shards": op2_token_shards,
    "op3_decontaminate": op3_decontaminate,
    "op4_license_scan": op4_license_scan,
    "op5_mix_sources": op5_mix_sources,
    "op6_jaccard_join": op6_jaccard_join,
    "op7_suffix_dedup": op7_suffix_dedup,
    "op8_language_id": op8_language_id,
    "op9_toxicity": op9_toxicity,
    "op10_personal_data": op10_personal_data,
    "op11_quality_votes": op11_quality_votes,
    "op12_periodic_runs": op12_periodic_runs,
    "op13_spelling_variants": op13_spelling_variants,
}
ORACLES = {"op4_license_scan": licenses.oracle_sql(), "op5_mix_sources": OP5_SQL, "op11_quality_votes": voting.oracle_sql()}
