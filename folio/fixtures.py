"""Paged documents derived from the driver's tables: each conversation is a document, each turn a page. With the same in SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from folio.operators import images as imaging
from folio.operators import pages


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def turns(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "conversations").select(F.col("conv_id").alias("doc_id"), "turn", "role", F.coalesce("text", F.lit("")).alias("text"))


TURNS = "turns AS (SELECT conv_id AS doc_id, turn, role, coalesce(text, '') AS text FROM conversations)"


def _heading():
    """The first line of a turn as a heading, its level by role."""
    level = F.when(F.col("role") == "system", 1).when(F.col("role") == "user", 2).otherwise(3)
    return F.concat(F.repeat(F.lit("#"), level), F.lit(" "), F.split("text", "\n", -1)[0])


_HEADING = "repeat('#', CASE role WHEN 'system' THEN 1 WHEN 'user' THEN 2 ELSE 3 END) || ' ' || string_split(text, chr(10))[1]"


def raw_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(doc_id, line_no, line): per turn a page tag, a heading and the lines of the text."""
    return pages.lines(pages.assembled(turns(spark, sf_dir).select("doc_id", (F.col("turn") + 1).alias("page"), F.concat_ws("\n", _heading(), "text").alias("md"))))


RAW_LINES = f"""
{TURNS},
parts AS (SELECT doc_id, turn, list_concat(['[[PAGE_' || (turn + 1) || ']]', {_HEADING}], string_split(text, chr(10))) AS xs FROM turns),
exploded AS (SELECT doc_id, turn, unnest(xs) AS line, generate_subscripts(xs, 1) AS pos FROM parts),
raw_lines AS (SELECT doc_id, row_number() OVER (PARTITION BY doc_id ORDER BY turn, pos) - 1 AS line_no, line FROM exploded)"""


def paged_markdown(spark: SparkSession, sf_dir: str, headed: bool = False) -> DataFrame:
    """(doc_id, page, md): the text of each turn with a caption line of its own, under a heading if asked for."""
    plain = F.array_join(F.regexp_extract_all("text", F.lit("[A-Za-z0-9 ]+"), F.lit(0)), "")  # stretches, not each other character
    mark = F.element_at(F.array(F.lit(":"), F.lit("."), F.lit("a:")), (F.col("doc_id") % 3 + 1).cast("int"))
    caption = F.when(F.col("role") == "assistant", F.concat(F.lit("Fig "), F.col("turn") + 1, mark, F.lit(" "), plain)).when(F.col("role") == "user", F.concat(F.lit("Table "), F.col("turn") + 1, F.lit(". "), plain))
    extra = F.when(F.col("doc_id") % 5 == 0, F.lit("config 3: settings here"))
    return turns(spark, sf_dir).select("doc_id", (F.col("turn") + 1).alias("page"), F.concat_ws("\n", *([_heading()] if headed else []), "text", caption, extra).alias("md"))


def _paged(head: str) -> str:
    return f"""
{TURNS},
paged_md AS (SELECT doc_id, turn + 1 AS page, concat_ws(chr(10), {head}text,
    CASE role WHEN 'assistant' THEN 'Fig ' || (turn + 1) || ([':', '.', 'a:'])[doc_id % 3 + 1] || ' ' || regexp_replace(text, '[^A-Za-z0-9 ]', '', 'g')
              WHEN 'user' THEN 'Table ' || (turn + 1) || '. ' || regexp_replace(text, '[^A-Za-z0-9 ]', '', 'g') END,
    CASE WHEN doc_id % 5 = 0 THEN 'config 3: settings here' END) AS md FROM turns)"""


PAGED_MD, HEADED_MD = _paged(""), _paged(f"{_HEADING}, ")


def images(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(doc_id, page, img_idx, b64, b64_len, img_pos): each web page's bytes stand in for an image."""
    rows = table(spark, sf_dir, "pages").select((F.col("page_id") % 100).alias("doc_id"), (1 + F.expr("page_id div 100") % 3).alias("page"), F.col("page_id").alias("img_idx"), F.replace(F.replace(F.base64(F.col("html").cast("binary")), F.lit("\r")), F.lit("\n")).alias("b64"))
    return imaging.by_page(rows.withColumn("b64_len", F.length("b64").cast("long")))


IMAGES = """
images AS (SELECT page_id % 100 AS doc_id, 1 + (page_id // 100) % 3 AS page, row_number() OVER (PARTITION BY page_id % 100, 1 + (page_id // 100) % 3 ORDER BY page_id) - 1 AS img_pos,
    to_base64(encode(html)) AS b64, length(to_base64(encode(html))) AS b64_len FROM pages)"""


def questions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(query_id, doc_id, query): every turn's whole text, asked of its own conversation."""
    return turns(spark, sf_dir).select((F.col("doc_id") * 1000 + F.col("turn")).alias("query_id"), "doc_id", F.col("text").alias("query"))


QUESTIONS = "questions AS (SELECT doc_id * 1000 + turn AS query_id, doc_id, text AS query FROM turns)"

#: Asked of every conversation, and what a ranker replies to each.
LITERALS = ("explain figure 2", "show me table 3", "configure fig. 4", "which paragraph", "what is it", "")
REPLIES = (None, None, '{"thinking": "t", "node_list": ["0001"]}', '{"thinking": "t", "node_list": ["0002", "0999", "0001", "0002"]}', 'none of "0999" fits', None)


def literal_questions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(query_id, doc_id, query): figures, tables, words without a match and an empty question, for every document."""
    docs = turns(spark, sf_dir).select("doc_id").distinct()
    return docs.select("doc_id", F.posexplode(F.array(*map(F.lit, LITERALS))).alias("k", "query")).select((F.col("doc_id") * 10 + F.col("k")).alias("query_id"), "doc_id", "query")


def literal_replies(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(query_id, doc_id, raw): replies to literal_questions()."""
    docs = turns(spark, sf_dir).select("doc_id").distinct()
    return docs.select("doc_id", F.posexplode(F.array(*map(F.lit, REPLIES))).alias("k", "raw")).where("raw is not null").select((F.col("doc_id") * 10 + F.col("k")).alias("query_id"), "doc_id", "raw")


LITERAL_QUESTIONS = f"questions AS (SELECT doc_id * 10 + k AS query_id, doc_id, query FROM (SELECT DISTINCT doc_id FROM turns), (VALUES {', '.join(f"({k}, '{x}')" for k, x in enumerate(LITERALS))}) v(k, query))"


def items(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(doc_id, page, pos, type, value, md, level, name, path, bbox): typed items of each turn: a heading, a text, and an image or a table by role."""
    head = F.split("text", "\n", -1)[0]
    level = F.when(F.col("role") == "system", 1).when(F.col("role") == "user", 2).otherwise(3)
    none = F.lit(None).cast("string")
    box = F.array(F.struct(F.lit(1.0).alias("x0"), F.lit(2.0).alias("y0"), (F.col("turn") + 10.0).alias("x1"), F.lit(20.0).alias("y1")))
    item = lambda kind, value=none, md=none, level=F.lit(None), name=none, path=none, bbox=F.lit(None): F.struct(
        F.lit(kind).alias("type"), value.alias("value"), md.alias("md"), level.cast("int").alias("level"), name.alias("name"), path.alias("path"), bbox.cast("array<struct<x0:double,y0:double,x1:double,y1:double>>").alias("bbox")
    )
    name = F.concat(F.lit("fig_"), F.col("turn").cast("string"))
    picture = F.when(F.col("role") == "assistant", item("image", name=name, path=F.concat(F.lit("images/"), name, F.lit(".png")), bbox=box)).when(F.col("role") == "user", item("table", md=F.concat(F.lit("| "), F.col("turn").cast("string"), F.lit(" | $x_"), F.col("turn").cast("string"), F.lit("$ |"))))
    formula = F.concat(F.col("text"), F.lit(" where $$y_"), F.col("turn").cast("string"), F.lit(" = m$$"))
    rows = turns(spark, sf_dir).select("doc_id", (F.col("turn") + 1).alias("page"), F.posexplode(F.filter(F.array(item("heading", head, level=level), item("text", formula), picture), lambda x: x.isNotNull())).alias("pos", "item"))
    return rows.select("doc_id", "page", "pos", "item.*")
