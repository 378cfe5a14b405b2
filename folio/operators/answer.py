"""Answers from retrieved sections: intent, context, citations, figures, prompt and an extractive answer."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from folio.functions.text import ANSWERING, INTENT, filled, terms
from folio.operators.captions import visual
from folio.operators.images import in_ranges
from folio.operators.search import figure_number

CONTEXT = 2500


def is_visual(query: Column) -> Column:
    return F.lower(query).rlike(INTENT)


def _in_order(value: Column, by: str = "\n\n") -> Column:
    return F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("seq", value.alias("v")))), lambda x: x["v"]), by)


def _pages() -> Column:
    return F.concat(F.col("page_start").cast("string"), F.lit("-"), F.col("page_end").cast("string"))


def contexts(found: DataFrame) -> DataFrame:
    """(query_id, doc_id, context, sources) of retrieved sections."""
    block = F.concat(F.lit("[Pages: "), _pages(), F.lit(" | Section: "), "title", F.lit("]\n"), F.left("content", F.lit(CONTEXT)))
    source = F.concat(F.lit("Section: '"), F.col("title"), F.lit("', Page "), _pages())
    return found.groupBy("query_id", "doc_id").agg(_in_order(block).alias("context"), _in_order(source, "; ").alias("sources"), F.count("*").alias("n_sections"))


def _numbers(texts: Column) -> Column:
    """The figure numbers that an array of captions names."""
    squeezed = F.transform(texts, lambda c: F.regexp_replace(F.lower(c), r"(?U)[.\s]", ""))
    return F.array_distinct(F.flatten(F.transform(squeezed, lambda c: F.regexp_extract_all(c, F.lit(r"fig(?:ure)?(\d+)(?!\w)"), F.lit(1)))))


def _asked(questions: DataFrame) -> DataFrame:
    return questions.select("query_id", "doc_id", figure_number(F.col("query")).alias("number")).where("number is not null")


def _first(asked: DataFrame, known: DataFrame, *by: str) -> DataFrame:
    found = asked.join(known, ["doc_id", "number"]).groupBy("query_id", "doc_id").agg(F.min(F.struct(*by)).alias("at"))
    return found.select("query_id", "doc_id", "at.page", "at.img_pos")


def _node_images(claims: DataFrame, images: DataFrame) -> DataFrame:
    """(doc_id, seq, page, img_pos, number): the images of sections and the figures that their captions name."""
    rows = claims.select("doc_id", "seq", "page", "img_pos").join(images.select("doc_id", "page", "img_pos", "caption"), ["doc_id", "page", "img_pos"])
    return rows.select("doc_id", "seq", "page", "img_pos", F.explode(_numbers(F.array("caption"))).alias("number"))


def node_figures(questions: DataFrame, images: DataFrame, claims: DataFrame) -> DataFrame:
    """(query_id, doc_id, page, img_pos): in document order, the first image of a section whose caption is the figure asked for."""
    return _first(_asked(questions), _node_images(claims, images), "seq", "page", "img_pos")


def figures(questions: DataFrame, images: DataFrame) -> DataFrame:
    """(query_id, doc_id, page, img_pos): by page and place, the first image whose label or caption is the figure asked for."""
    known = images.select("doc_id", "page", "img_pos", F.explode(_numbers(F.array("label", "caption"))).alias("number"))
    return _first(_asked(questions), known, "page", "img_pos")


def content_figures(questions: DataFrame, images: DataFrame, sections: DataFrame) -> DataFrame:
    """(query_id, doc_id, page, img_pos): the first image, empty ones aside, on the pages of the first section that has one and a content caption of the figure asked for."""
    captioned = sections.select("doc_id", "seq", F.explode(_numbers(visual(F.col("content")))).alias("number"))
    there = images.where("b64_len > 0").select("doc_id", "page", "img_pos")
    known = captioned.join(in_ranges(sections.join(captioned.select("doc_id", "seq").distinct(), ["doc_id", "seq"], "left_semi"), there), ["doc_id", "seq"]).join(there, ["doc_id", "page"])
    return _first(_asked(questions), known, "seq", "page", "img_pos")


def resolved(questions: DataFrame, images: DataFrame, claims: DataFrame, sections: DataFrame) -> DataFrame:
    """(query_id, doc_id, page, img_pos, pass): captions of the sections' images, else labels and captions by page, else captions in content."""
    tries = (node_figures(questions, images, claims), figures(questions, images), content_figures(questions, images, sections))
    rows = [x.select("query_id", "doc_id", F.struct(F.lit(k).cast("long").alias("pass"), "page", "img_pos").alias("at")) for k, x in enumerate(tries, 1)]
    found = rows[0].unionByName(rows[1]).unionByName(rows[2]).groupBy("query_id", "doc_id").agg(F.min("at").alias("at"))
    return found.select("query_id", "doc_id", "at.page", "at.img_pos", "at.pass")


def attached(questions: DataFrame, found: DataFrame, images: DataFrame, claims: DataFrame, sections: DataFrame) -> DataFrame:
    """(query_id, doc_id, page, img_pos, copies): the image sent with each visual question.

    Asked for a figure: its image in the first retrieved section that has it, once for each retrieved section, else the
    image found in the whole document, once. Without a number: the first image of the first retrieved section that has one,
    once for each. found has the retrieved sections (query_id, doc_id, seq).
    """
    key = ["query_id", "doc_id"]
    own = found.select(*key, "seq").distinct()
    numbered, plain = _asked(questions), questions.where(is_visual(F.col("query")) & figure_number(F.col("query")).isNull())
    best = F.min(F.struct("seq", "page", "img_pos")).alias("at")
    local = numbered.join(own, key).join(_node_images(claims, images), ["doc_id", "seq", "number"]).groupBy(*key).agg(best)
    first = plain.select(*key).join(own, key).join(claims.select("doc_id", "seq", "page", "img_pos"), ["doc_id", "seq"]).groupBy(*key).agg(best)
    each = local.unionByName(first).join(own.groupBy(*key).agg(F.count("*").alias("copies")), key).select(*key, "at.page", "at.img_pos", "copies")
    rest = questions.join(own.select(*key).distinct(), key, "left_semi").join(each.select(*key), key, "left_anti")
    return each.unionByName(resolved(rest, images, claims, sections).select(*key, "page", "img_pos", F.lit(1).cast("long").alias("copies")))


def prompts(questions: DataFrame, found: DataFrame) -> DataFrame:
    """(query_id, doc_id, prompt, sources, is_visual)."""
    rows = questions.join(contexts(found), ["query_id", "doc_id"])
    return rows.select("query_id", "doc_id", filled(ANSWERING, query=F.col("query"), context=F.col("context")).alias("prompt"), "sources", is_visual(F.col("query")).alias("is_visual"))


def extracts(questions: DataFrame, found: DataFrame) -> DataFrame:
    """(query_id, doc_id, answer): the sentence or line of the retrieved sections that shares most different terms with the question.

    Of equals the first; without a shared term the first of all; an empty text if there is none. No model is asked.
    """
    key = ["query_id", "doc_id"]
    # a lambda of one argument: transform() would give F.trim each piece's place as the characters to trim
    pieces = F.filter(F.transform(F.regexp_extract_all(F.left("content", F.lit(CONTEXT)), F.lit(r"[^\n.!?]+[.!?]*"), F.lit(0)), lambda x: F.trim(x)), lambda x: x != "")
    rows = questions.select(*key, F.array_distinct(terms(F.col("query"))).alias("asked")).join(found.select(*key, "seq", F.posexplode_outer(pieces).alias("pos", "piece")), key)
    shared = F.size(F.array_intersect("asked", terms(F.coalesce("piece", F.lit("")))))
    best = rows.groupBy(*key).agg(F.min_by("piece", F.struct((-shared).alias("less"), F.col("piece").isNull().alias("none"), "seq", "pos")).alias("answer"))
    return best.select(*key, F.coalesce("answer", F.lit("")).alias("answer"))
