"""Pages and images from files, and documents as text files."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from folio.errors import IngestionError
from folio.operators import images, pages


def read_pages(spark: SparkSession, path: str, kind: str = "parquet") -> DataFrame:
    """(doc_id, page, md): pages of parquet or JSON tables (doc_id, page, md, and text and success where known), of "results"

    (one JSON file of a parser's result per document, named by its doc_id), or of "markdown" files with page markers, named alike.
    """
    if kind in ("parquet", "json"):
        return pages.normal(spark.read.format(kind).load(path))
    if kind not in ("results", "markdown"):
        raise IngestionError(f"pages of an unknown kind: {kind}")
    files = spark.read.text(path, wholetext=True).select(F.regexp_extract(F.input_file_name(), r"(\d+)\.[^./]*$", 1).cast("long").alias("doc_id"), "value")
    if kind == "results":
        return pages.from_json(files.withColumnRenamed("value", "json"))
    return pages.split(files.withColumnRenamed("value", "markdown")).select("doc_id", "page", F.col("text").alias("md"))


def read_images(spark: SparkSession, path: str) -> DataFrame:
    """(doc_id, page, img_idx, ext, b64, b64_len, img_pos) of a parquet table of placed images, margins left out."""
    return images.by_page(images.from_placements(spark.read.parquet(path)))


def write_texts(page_table: DataFrame, path: str) -> None:
    """Writes each document, its pages after their markers, as UTF-8 text in a folder of its own, doc_id=N."""
    rows = pages.assembled(pages.normal(page_table)).select("doc_id", F.col("markdown").alias("value"))
    rows.write.mode("overwrite").partitionBy("doc_id").text(path)
