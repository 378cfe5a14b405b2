"""A corpus pipeline: each stage reads what the one before it wrote as Parquet.

Stages take (spark, docs, sf_dir) and return the documents they keep, with the columns of documents; the last one
adds what the mix makes of them. Null and empty texts are clean, repeat nothing, leak nothing and go only in the mix,
where they have no words. Rows that repeat a doc_id are judged as the stage's operator says; rows without one stay where
the stage needs ids to tell what goes. Empty tables give empty ones.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from folio.llm import decontaminate, lines, minhash, mixing, toxicity
from folio.llm.common import new_path, remove, unused

#: Score from which a document counts as toxic.
TOXIC = 0.7


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that score below TOXIC; the classifier learns from the labels of the documents given. A null or empty text has the score of a text without words."""
    model = toxicity.fit(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    return toxicity.score(docs, model).where(F.col("score") < TOXIC).select(*docs.columns)


def dedup_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of alike lines of the corpus the first by (doc_id, line number) stays. n_chars is that of the new text.

    Documents of which no line stays are copies line by line and go; those without a line to begin with, null texts too, stay.
    """
    out = lines.deduplicated(docs).where((F.col("n_lines") == 0) | (F.col("n_gone") < F.col("n_lines")))
    return out.withColumn("n_chars", F.when(F.col("n_gone") > 0, F.length("text").cast("long")).otherwise(F.col("n_chars"))).select(*docs.columns)


def dedup_documents(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The document of smallest id of each group of near duplicates; documents without an id or without words stay.

    Rows that repeat the id of a document that stays all stay.
    """
    gone = minhash.near_duplicates(docs).where("not kept").select(F.col("doc_id").alias(gone_id := unused(docs.columns, "gone_id"))).distinct()
    return docs.join(gone, F.col("doc_id").cast("long") == F.col(gone_id), "left_anti")


def drop_leaks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a passage of the benchmark; documents without an id stay."""
    return decontaminate.clean(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """What the mix takes, in the order of virtual finish times, with size, target, copies and taken words; documents without words are never taken."""
    return mixing.served(mixing.mixed(docs))


STAGES = [
    ("toxicity", drop_toxic),
    ("line_dedup", dedup_lines),
    ("near_dedup", dedup_documents),
    ("decontamination", drop_leaks),
    ("mixing", mix_sources),
]

#: SQL has neither the classifier nor the sketches of these stages.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The rows of the last stage. What a stage wrote goes when the next one has read it; the last one's goes with the session."""
    docs, before = spark.read.parquet(f"{sf_dir}/documents.parquet"), None
    for name, stage in STAGES:
        path = new_path(spark, f"pipeline-{name}")
        stage(spark, docs, sf_dir).write.parquet(path)
        if before:
            remove(spark, before)
        docs, before = spark.read.parquet(path), path
    return docs
