"""Pages of markdown: their normal form, one text per document with page markers, and back to pages and lines."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from folio.functions.text import PAGE_MARKER

_PAGES = "ARRAY<STRUCT<page: BIGINT, md: STRING, text: STRING, success: BOOLEAN>>"


def normal(pages: DataFrame, *more: str) -> DataFrame:
    """(doc_id, page, md): pages that were parsed (success true or not told); without markdown their plain text, else nothing.

    Reads doc_id, page and md, and text and success where they exist; those of the columns more that exist are passed on.
    """
    has = set(pages.columns)
    parsed = pages.where(F.coalesce("success", F.lit(True))) if "success" in has else pages
    return parsed.select("doc_id", F.col("page").cast("long").alias("page"), F.coalesce("md", *(["text"] if "text" in has else []), F.lit("")).alias("md"), *(c for c in more if c in has))


def from_json(results: DataFrame) -> DataFrame:
    """(doc_id, page, md) of parsers' results (doc_id, json): a list of pages, an object with pages, or a list of such objects."""
    told = results.select("doc_id", F.coalesce(*(_parsed(F.get_json_object("json", at), kind) for at, kind in (("$[*].pages", f"ARRAY<{_PAGES}>"), ("$.pages", _PAGES), ("$", _PAGES)))).alias("pages"))
    rows = told.select("doc_id", F.explode("pages").alias("p")).where("p.page is not null")
    return normal(rows.select("doc_id", "p.*"))


def _parsed(json: Column, kind: str) -> Column:
    if kind == _PAGES:
        return F.from_json(json, kind)
    one, many = F.from_json(json, _PAGES), F.from_json(json, kind)
    return F.coalesce(F.when(F.get(one, F.lit(0))["page"].isNotNull(), one), F.flatten(many))


def assembled(pages: DataFrame, before: DataFrame | None = None) -> DataFrame:
    """(doc_id, markdown): pages in order, each after its marker; before (doc_id, page, lines), one row a page, goes before the text of its page.

    Documents are dealt to a fixed number of partitions: texts become many lines, which Spark doesn't foresee when it joins
    small partitions to one, and what follows by doc_id stays in them. The lines to put before travel as rows of their own, so
    texts are neither joined nor sent once more.
    """
    parts = int(pages.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    rows = pages.select("doc_id", "page", "md")
    if before is not None:
        rows = rows.withColumn("text", F.lit(True)).unionByName(before.where("doc_id is not null and page is not null").select("doc_id", "page", "lines", F.lit(False).alias("text")), allowMissingColumns=True)
    rows = rows.repartition(parts, "doc_id")
    if before is not None:
        rows = rows.withColumn("lines", F.max("lines").over(Window.partitionBy("doc_id", "page"))).where("text").withColumn("md", F.concat_ws("\n", "lines", "md"))
    part = F.concat(F.lit("--- Page "), F.col("page").cast("string"), F.lit(" ---\n"), "md")
    rows = rows.select("doc_id", F.struct("page", part.alias("md")).alias("part"))
    return rows.groupBy("doc_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list("part")), lambda x: x["md"]), "\n").alias("markdown"))


def split(documents: DataFrame) -> DataFrame:
    """(doc_id, part, page, text): markdown cut at its page markers; what stands before the first belongs to no page."""
    parts = F.slice(F.split("markdown", PAGE_MARKER), 2, 1_000_000_000)
    pages = F.regexp_extract_all("markdown", F.lit(PAGE_MARKER), F.lit(1))
    rows = documents.select("doc_id", F.posexplode(F.arrays_zip(pages.alias("page"), parts.alias("text"))).alias("part", "p"))
    return rows.select("doc_id", F.col("part").cast("long").alias("part"), F.col("p.page").cast("long").alias("page"), F.regexp_replace("p.text", r"\s+$", "").alias("text"))


def tagged(documents: DataFrame) -> DataFrame:
    """documents, page markers in markdown replaced by page tags."""
    return documents.withColumn("markdown", F.regexp_replace("markdown", PAGE_MARKER, r"[[PAGE_$1]]"))


def lines(documents: DataFrame) -> DataFrame:
    """(doc_id, line_no, line) of the tagged markdown, cut at line feeds alone."""
    rows = tagged(documents).select("doc_id", F.posexplode(F.split("markdown", "\n", -1)).alias("line_no", "line"))
    return rows.select("doc_id", F.col("line_no").cast("long").alias("line_no"), "line")


def latest(parts: DataFrame, by: list[str], order: str) -> DataFrame:
    """The rows of the largest order among those of equal by."""
    return parts.withColumn("_last", F.max(order).over(Window.partitionBy(*by))).where(F.col(order) == F.col("_last")).drop("_last")
