"""Captions in page text, and their match with the images of pages."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from folio.functions.text import CAPTION, IMAGE_TAG, LABEL, NO_CAPTION, NO_TAG_CAPTION, VISUAL, normalized_label, stripped
from folio.operators.containment import contained
from folio.operators.pages import latest

#: The letters that a caption begins with, told before the pattern is tried, which is slow where it fails.
BEGINS = "(?=[FfTt])"


def mined(pages: DataFrame, order: str | None = None) -> DataFrame:
    """(doc_id, page, cap_pos, label, full_caption, normalized) of the captions in md.

    Where a page number repeats in a document, the last part by order that has a caption replaces those before it;
    without order all parts count.
    """
    parts = pages.select("doc_id", "page", *([order] if order else []), F.regexp_extract_all("md", F.lit(BEGINS + CAPTION), F.lit(1)).alias("found"))
    if order:
        parts = latest(parts.where(F.size("found") > 0), ["doc_id", "page"], order)
    # An outer explode: for an inner one Spark adds a filter that matches each page's text once more.
    rows = parts.select("doc_id", "page", F.posexplode_outer("found").alias("cap_pos", "caption")).where("caption is not null")
    rows = rows.select("doc_id", "page", F.col("cap_pos").cast("long").alias("cap_pos"), stripped(F.col("caption")).alias("full_caption"))
    rows = rows.withColumn("label", stripped(F.regexp_extract("full_caption", LABEL, 1)))
    return rows.select("doc_id", "page", "cap_pos", "label", "full_caption", normalized_label(F.col("label")).alias("normalized"))


def matched(images: DataFrame, captions: DataFrame, lookahead: int = 1) -> DataFrame:
    """images with label and caption: image i of a page takes figure i, else table i, of the page and those after it.

    Captions are dealt to the pages that may use them first, so the join is on equal keys.
    """
    kind = F.when(F.col("normalized").startswith("fig"), "fig").when(F.col("normalized").startswith("table"), "table")
    dealt = captions.withColumn("kind", kind).where("kind is not null").withColumn("target", F.explode(F.sequence(F.col("page") - lookahead, F.col("page"))))
    order = Window.partitionBy("doc_id", "target", "kind").orderBy("page", "cap_pos")
    placed = dealt.select("doc_id", F.col("target").alias("page"), "kind", (F.row_number().over(order) - 1).cast("long").alias("img_pos"), "label", "full_caption", "normalized")
    one = placed.groupBy("doc_id", "page", "img_pos").agg(
        *(F.coalesce(F.max(F.when(F.col("kind") == "fig", F.col(c))), F.max(F.when(F.col("kind") == "table", F.col(c)))).alias(c) for c in ("label", "full_caption", "normalized"))
    )
    out = images.join(one, ["doc_id", "page", "img_pos"], "left")
    return out.withColumn("caption", F.coalesce("full_caption", F.lit(NO_CAPTION))).withColumn("label", F.coalesce("label", F.lit(""))).withColumn("normalized_label", F.coalesce("normalized", F.lit(""))).drop("full_caption", "normalized")


def lines(images: DataFrame) -> DataFrame:
    """(doc_id, page, lines): the captions of a page's images as lines to put before its text."""
    return images.where(F.col("caption") != NO_CAPTION).groupBy("doc_id", "page").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("img_pos", "caption"))), lambda x: F.concat(F.lit("[Visual Component] Caption: "), x["caption"])), "\n").alias("lines"))


def injected(pages: DataFrame, images: DataFrame) -> DataFrame:
    """pages with the captions of their images as lines before the text."""
    return pages.join(lines(images), ["doc_id", "page"], "left").withColumn("md", F.concat_ws("\n", "lines", "md")).drop("lines")


def visual(text):
    return F.regexp_extract_all(text, F.lit(VISUAL), F.lit(1))


def beside_tags(documents: DataFrame) -> DataFrame:
    """(doc_id, pos, tag, caption): image tags of markdown, each with the first two lines with text that follow it."""
    parts = F.slice(F.split("markdown", IMAGE_TAG, -1), 2, 1_000_000_000)
    rows = documents.select("doc_id", F.posexplode(F.arrays_zip(F.regexp_extract_all("markdown", F.lit(IMAGE_TAG), F.lit(1)).alias("tag"), parts.alias("text"))).alias("pos", "p"))
    lines = F.filter(F.transform(F.split("p.text", "\n"), stripped), lambda x: x != "")
    return rows.select("doc_id", F.col("pos").cast("long").alias("pos"), F.col("p.tag").alias("tag"), F.when(F.size(lines) > 0, F.array_join(F.slice(lines, 1, 2), " ")).otherwise(F.lit(NO_TAG_CAPTION)).alias("caption"))


def tag_sources(tags: DataFrame, files: DataFrame) -> DataFrame:
    """(doc_id, pos, tag, name): the first file (doc_id, file_no, name) of the document whose name holds the tag, or the other way round.

    Tags and names meet by what they hold (containment.contained()), so a document's tags aren't compared with all its files.
    """
    named = files.where("name is not null").groupBy("doc_id", "name").agg(F.min("file_no").alias("file_no"))
    first = files.where("name is not null").groupBy("doc_id").agg(F.min_by("name", "file_no").alias("name"), F.min("file_no").alias("file_no"))
    asked = tags.select("doc_id", "tag").distinct()
    in_name = contained(asked.withColumnRenamed("tag", "pattern"), named.select("doc_id", F.col("name").alias("text_id"), F.col("name").alias("text"))).select("doc_id", F.col("pattern").alias("tag"), F.col("text_id").alias("name"))
    in_tag = contained(named.select("doc_id", F.col("name").alias("pattern")), asked.select("doc_id", F.col("tag").alias("text_id"), F.col("tag").alias("text"))).select("doc_id", F.col("text_id").alias("tag"), F.col("pattern").alias("name"))
    met = in_name.unionByName(in_tag).join(named, ["doc_id", "name"])
    # An empty tag is in every name, and an empty name in every tag.
    met = met.unionByName(asked.where("tag = ''").join(first, "doc_id").select(*met.columns)).unionByName(asked.join(named.where("name = ''"), "doc_id").select(*met.columns))
    best = met.groupBy("doc_id", "tag").agg(F.min_by("name", "file_no").alias("name"))
    return tags.select("doc_id", "pos", "tag").join(best, ["doc_id", "tag"], "left").select("doc_id", "pos", "tag", "name")
