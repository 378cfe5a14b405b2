"""Queries of this subpackage's operators, with production parameters, and SQL where it can express them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from folio.llm import decontaminate, html, lines, minhash, mixing, negatives, packing, periods, quality_model, rules, suffix, toxicity, warc
from folio.llm.common import held_out


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _scored(df: DataFrame, least: float) -> DataFrame:
    return df.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= least).cast("int").alias("predicted"))


def op1_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents")
    model = toxicity.fit(docs, _table(spark, sf_dir, "labels"))
    return _scored(toxicity.score(docs.select("doc_id", "text"), model).drop("text"), 0.7)


def op2_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return minhash.near_duplicates(_table(spark, sf_dir, "documents"))


def op3_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents")
    model = quality_model.fit(docs, _table(spark, sf_dir, "labels"))
    return _scored(quality_model.score(docs.select("doc_id", "text"), model).drop("text"), 0.5)


def op4_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warc.archived(_table(spark, sf_dir, "pages")).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


def op5_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rules.rated(_table(spark, sf_dir, "documents")).drop("rejected_by")


def op6_suffix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffix.without_repeats(_table(spark, sf_dir, "documents"))


def op7_html(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html.extracted(_table(spark, sf_dir, "pages"))


def op8_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = lines.deduplicated(_table(spark, sf_dir, "documents").select("doc_id", "text"))
    return out.select("doc_id", "n_lines", "n_gone", "n_links", F.sha2(F.coalesce("text", F.lit("")).cast("binary"), 256).alias("kept_sha256"))


def op9_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.leaks(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark"))


def op10_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mixed(_table(spark, sf_dir, "documents").select("doc_id", "text", "source")).select("doc_id", "size", "source_size", "target", "taken")


def op11_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _table(spark, sf_dir, "embeddings")
    finite = F.col("embedding").isNotNull() & ~F.exists("embedding", lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    label = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    vector = F.transform("embedding", lambda x: F.floor(F.lit(256.0) * x.cast("double")))
    return negatives.mined(rows.where(finite).select(F.col("vec_id").alias("id"), label.alias("label"), vector.alias("vector")))


def op12_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The tokenizer's file is named by a public package that is on all machines."""
    import public_tokenizers

    out = packing.pieces(_table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"))
    return out.select("doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset")


def op13_periods(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = periods.periodic(periods.looped(_table(spark, sf_dir, "documents")))
    top = F.array_max(F.transform("runs", lambda r: F.struct(r["length"].alias("length"), (-r["start"]).alias("back"), (-r["period"]).alias("short"))))
    told = F.array_join(F.transform("runs", lambda r: F.concat_ws(",", r["start"].cast("string"), r["length"].cast("string"), r["period"].cast("string"))), "\n")
    rows = out.withColumn("top", top).withColumn("told", F.when(F.size("runs") > 0, F.concat(told, F.lit("\n"))).otherwise(""))
    return rows.select(
        "doc_id", F.size("runs").cast("long").alias("n_runs"), (-F.col("top.back")).alias("start"), F.col("top.length").alias("length"), (-F.col("top.short")).alias("period"),
        F.expr("(1000 * top.length) div -top.short").alias("exponent_milli"), F.sha2(F.col("told").cast("binary"), 256).alias("runs_sha256"), F.sha2(F.col("collapsed").cast("binary"), 256).alias("collapsed_sha256"),
    )


QUERIES = {f.__name__: f for f in (op1_toxicity, op2_minhash, op3_quality, op4_warc, op5_rules, op6_suffix, op7_html, op8_lines, op9_decontaminate, op10_mixing, op11_negatives, op12_packing, op13_periods)}
ORACLES = {"op5_rules": rules.SQL, "op10_mixing": mixing.SQL, "op11_negatives": negatives.SQL}
