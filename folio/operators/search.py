"""Finding sections: index entries, figure shortcut, model replies, BM25 and their cascade."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from folio.functions.text import FIGURE_QUERY, NAVIGATION, collapsed, filled, safe_title, terms
from folio.operators.captions import visual

K1, B, EPSILON = 1.5, 0.75, 0.25
#: How often a term of the title counts.
TITLE_WEIGHT = 3


def index_entries(sections: DataFrame, claims: DataFrame | None = None) -> DataFrame:
    """(doc_id, seq, node_id, title, pages, has_figures, figure_captions, preview, children, search) of each section.

    has_figures tells whether claims (doc_id, seq) gives the section an image; children are structs of node_id and title;
    search is the lower-cased content.
    """
    children = sections.where("parent_seq is not null").groupBy("doc_id", F.col("parent_seq").alias("seq")).agg(
        F.transform(F.array_sort(F.collect_list(F.struct("seq", "node_id", safe_title(F.col("title")).alias("title")))), lambda x: F.struct(x["node_id"].alias("node_id"), x["title"].alias("title"))).alias("children")
    )
    rows = sections.join(children, ["doc_id", "seq"], "left")
    if claims is None:
        rows = rows.withColumn("held", F.lit(None).cast("boolean"))
    else:
        rows = rows.join(claims.select("doc_id", "seq", F.lit(True).alias("held")).distinct(), ["doc_id", "seq"], "left")
    preview = F.regexp_replace(collapsed(F.left("content", F.lit(300))), r'[\x00-\x1f"\\]', "")
    return rows.select(
        "doc_id", "seq", "node_id", safe_title(F.col("title")).alias("title"), F.concat(F.col("page_start").cast("string"), F.lit("-"), F.col("page_end").cast("string")).alias("pages"),
        F.when(F.col("held"), "Yes").otherwise("No").alias("has_figures"), F.transform(visual(F.col("content")), safe_title).alias("figure_captions"), preview.alias("preview"),
        F.coalesce("children", F.array().cast("array<struct<node_id:string,title:string>>")).alias("children"), F.lower("content").alias("search"),
    )


def _quoted(x: Column | str) -> Column:
    return F.concat(F.lit('"'), F.col(x) if isinstance(x, str) else x, F.lit('"'))


def _listed(items: Column, indent: str) -> Column:
    """JSON of a list of items that are JSON already, one a line."""
    return F.when(F.size(items) == 0, F.lit("[]")).otherwise(F.concat(F.lit(f"[\n{indent}  "), F.array_join(items, f",\n{indent}  "), F.lit(f"\n{indent}]")))


def entry_json(entries: DataFrame) -> DataFrame:
    """(doc_id, entries): the index entries of a document as indented JSON, without their search text.

    Quotes, backslashes and control characters are gone from the values already; other characters stand for themselves.
    """
    child = F.transform("children", lambda c: F.concat(F.lit('{\n        "node_id": '), _quoted(c["node_id"]), F.lit(',\n        "title": '), _quoted(c["title"]), F.lit("\n      }")))
    values = [F.concat(F.lit(f'    "{c}": '), _quoted(c)) for c in ("node_id", "title", "pages", "has_figures")]
    values += [F.concat(F.lit('    "figure_captions": '), _listed(F.transform("figure_captions", _quoted), "    ")), F.concat(F.lit('    "preview": '), _quoted("preview"))]
    values.append(F.when(F.size("children") > 0, F.concat(F.lit('    "children": '), _listed(child, "    "))))
    entry = F.concat(F.lit("  {\n"), F.concat_ws(",\n", *values), F.lit("\n  }"))
    joined = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("seq", entry.alias("json")))), lambda x: x["json"]), ",\n")
    return entries.groupBy("doc_id").agg(F.concat(F.lit("[\n"), joined, F.lit("\n]")).alias("entries"))


def navigation_prompts(questions: DataFrame, entries: DataFrame) -> DataFrame:
    """(query_id, doc_id, prompt): what a ranker of sections is asked."""
    rows = questions.join(entry_json(entries), "doc_id")
    return rows.select("query_id", "doc_id", filled(NAVIGATION, query=F.col("query"), entries=F.col("entries")).alias("prompt"))


def term_counts(entries: DataFrame, asked: DataFrame | None = None) -> DataFrame:
    """(doc_id, seq, n, dl, avgdl, mark, term, tf): terms of title, thrice, and text; n is the number of the document's entries, dl how many terms an entry has and avgdl their mean.

    A text becomes many times its bytes in terms, which Spark doesn't foresee when it joins small partitions of texts to one,
    so texts are dealt to a fixed number of partitions. asked terms (doc_id, term) come along as rows of their own, those with mark.
    """
    parts = int(entries.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    heads, words = terms(F.col("title")), terms(F.col("content"))
    each = F.flatten(F.concat(F.array_repeat(heads, TITLE_WEIGHT), F.array(words)))
    doc = Window.partitionBy("doc_id")
    texts = entries.select("doc_id", "seq", "title", "content", F.lit(None).cast("array<string>").alias("asked"))
    if asked is not None:
        texts = texts.unionByName(asked.groupBy("doc_id").agg(F.collect_set("term").alias("asked")), allowMissingColumns=True)
    mark = F.col("asked").isNotNull()
    sized = texts.repartition(parts, "doc_id").select("doc_id", "seq", mark.alias("mark"), F.when(mark, F.col("asked")).otherwise(each).alias("each"))
    sized = sized.withColumn("dl", F.coalesce(F.when(~F.col("mark") & F.col("each").isNotNull(), F.size("each")), F.lit(0)).cast("long"))
    sized = sized.withColumn("n", F.count_if(~F.col("mark")).over(doc)).withColumn("avgdl", F.sum("dl").over(doc) / F.nullif("n", F.lit(0)))
    key = ["doc_id", "seq", "n", "dl", "avgdl", "mark"]
    return sized.select(*key, F.explode("each").alias("term")).groupBy(*key, "term").agg(F.count("*").alias("tf"))


def weighted_terms(entries: DataFrame, asked: DataFrame | None = None) -> DataFrame:
    """(doc_id, seq, term, tf, dl, avgdl, df, idf, first): a term in over half of the entries gets EPSILON of the mean idf.

    Everything is counted within the document, so all windows keep the partitioning by doc_id that term_counts() has, and one
    order of the terms serves them all. first marks one row of each term. Of a document's terms only those asked (doc_id, term)
    are returned, if given, weighed among all: the others needn't leave their task to meet no question.
    """
    doc = Window.partitionBy("doc_id")
    term = Window.partitionBy("doc_id", "term")
    rows = term_counts(entries, asked).withColumn("first", (F.row_number().over(term.orderBy("mark", "seq")) == 1) & ~F.col("mark")).withColumn("df", F.count_if(~F.col("mark")).over(term))
    rows = rows.withColumn("wanted", F.max("mark").over(term)).withColumn("raw", F.ln(F.col("n") - F.col("df") + 0.5) - F.ln(F.col("df") + 0.5))
    rows = rows.withColumn("mean", F.sum(F.when(F.col("first"), F.col("raw"))).over(doc) / F.nullif(F.count_if("first").over(doc), F.lit(0))).where("not mark")
    rows = rows if asked is None else rows.where("wanted")
    return rows.select("doc_id", "seq", "term", "tf", "dl", "avgdl", "df", F.when(F.col("raw") < 0, EPSILON * F.col("mean")).otherwise(F.col("raw")).alias("idf"), "first")


def term_weights(entries: DataFrame) -> DataFrame:
    """(doc_id, term, df, idf) of each term of a document."""
    return weighted_terms(entries).where("first").select("doc_id", "term", "df", "idf")


def bm25(questions: DataFrame, entries: DataFrame, postings: DataFrame | None = None) -> DataFrame:
    """(query_id, doc_id, seq, score) of the entries that share a term with the question, rounded to six places; postings are weighted_terms() that are stored."""
    asked = questions.select("query_id", "doc_id", F.explode(terms(F.col("query"))).alias("term")).groupBy("query_id", "doc_id", "term").agg(F.count("*").alias("qtf"))
    met = asked.join(weighted_terms(entries, asked.select("doc_id", "term")) if postings is None else postings, ["doc_id", "term"])
    part = F.col("qtf") * F.col("idf") * F.col("tf") * (K1 + 1) / (F.col("tf") + K1 * (1 - B + B * F.col("dl") / F.col("avgdl")))
    return met.groupBy("query_id", "doc_id", "seq").agg(F.round(F.sum(part), 6).alias("score"))


def bm25_hits(questions: DataFrame, entries: DataFrame, postings: DataFrame | None = None) -> DataFrame:
    """(query_id, doc_id, seq, score): the best section and a second of half its score or more, else the first section with 0."""
    key = ["query_id", "doc_id"]
    own = Window.partitionBy(*key)
    top = bm25(questions, entries, postings).where("score > 0").withColumn("rank", F.row_number().over(own.orderBy(F.desc("score"), "seq"))).where("rank <= 2").withColumn("top", F.max("score").over(own))
    found = top.where((F.col("rank") == 1) | (F.col("score") >= 0.5 * F.col("top"))).select(*key, "seq", "score")
    return _or_first(questions, found).select(*key, "seq", F.coalesce("score", F.lit(0.0)).alias("score"))


def _or_first(questions: DataFrame, hits: DataFrame) -> DataFrame:
    """hits, and the first section for questions without any."""
    return questions.select("query_id", "doc_id").join(hits, ["query_id", "doc_id"], "left").withColumn("seq", F.coalesce("seq", F.lit(0).cast("long")))


def figure_number(query: Column) -> Column:
    return F.nullif(F.regexp_extract(F.lower(query), FIGURE_QUERY, 1), F.lit(""))


def figure_hits(questions: DataFrame, sections: DataFrame) -> DataFrame:
    """(query_id, doc_id, seq): the first section with a caption of the figure asked for; numbers are joined, not patterns."""
    numbers = F.flatten(F.transform(visual(F.col("content")), lambda c: F.regexp_extract_all(F.regexp_replace(F.lower(c), r"(?U)[.\s]", ""), F.lit(r"fig(?:ure)?(\d+)(?!\w)"), F.lit(1))))
    captioned = sections.select("doc_id", "seq", F.explode(F.array_distinct(numbers)).alias("number"))
    asked = questions.withColumn("number", figure_number(F.col("query"))).where("number is not null")
    return asked.join(captioned, ["doc_id", "number"]).groupBy("query_id", "doc_id").agg(F.min("seq").alias("seq"))


REPLY = "thinking STRING, node_list ARRAY<STRING>"


def parsed_reply(raw: Column) -> Column:
    """struct(thinking, node_list) of a model's reply: strict JSON, then bare keys, then any quoted ids; null if none."""
    bare = F.regexp_replace(raw, r"(?mU)^```(?:json)?\s*|\s*```$", "")
    body = F.regexp_extract(bare, r"(?s)(\{.*\})", 1)
    strict, loose = F.from_json(body, REPLY), F.from_json(body, REPLY, {"allowUnquotedFieldNames": "true"})
    ids = F.regexp_extract_all(raw, F.lit(r'"(\d{4})"'), F.lit(1))
    saved = F.when(F.size(ids) > 0, F.struct(F.lit("regex-extracted").alias("thinking"), ids.alias("node_list")))
    return F.when(strict["node_list"].isNotNull(), strict).when(loose["node_list"].isNotNull(), loose).otherwise(saved)


def valid_hits(replies: DataFrame, sections: DataFrame) -> DataFrame:
    """(query_id, doc_id, seq, pos): the ids of replies (query_id, doc_id, node_list) that exist, in their order, repeats kept."""
    rows = replies.select("query_id", "doc_id", F.posexplode("node_list").alias("pos", "node_id"))
    return rows.join(sections.select("doc_id", "node_id", "seq"), ["doc_id", "node_id"]).select("query_id", "doc_id", "seq", F.col("pos").cast("long").alias("pos"))


def cascade(questions: DataFrame, sections: DataFrame, replies: DataFrame | None = None, named: DataFrame | None = None, postings: DataFrame | None = None) -> DataFrame:
    """(query_id, doc_id, seq, via): figure shortcut, else valid ids of a ranker's replies, else BM25 for the rest only.

    Replies and named, the figure_hits(), are read more than once: give tables, not plans that ask a model.
    """
    key = ["query_id", "doc_id"]
    out = (figure_hits(questions, sections) if named is None else named).withColumn("via", F.lit("figure"))
    rest = questions.join(out.select(*key), key, "left_anti")
    if replies is not None:
        ranked = valid_hits(replies.join(rest.select(*key), key, "left_semi"), sections).select(*key, "seq").distinct().withColumn("via", F.lit("ranker"))
        out, rest = out.unionByName(ranked), rest.join(ranked.select(*key).distinct(), key, "left_anti")
    return out.unionByName(bm25_hits(rest, sections, postings).select(*key, "seq").withColumn("via", F.lit("bm25")))


def retrieved(hits: DataFrame, questions: DataFrame, sections: DataFrame) -> DataFrame:
    """Sections of each question by document order; a question without any gets the root."""
    own = hits.select("query_id", "doc_id", "seq").distinct()
    return _or_first(questions, own).distinct().join(sections, ["doc_id", "seq"])
