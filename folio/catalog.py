"""Registered queries of the engine's own operators, and the same in SQL."""

from __future__ import annotations

import re
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from folio import fixtures, storage
from folio.functions.text import ANSWERING, CAPTION, FIGURE_QUERY, INTENT, LABEL, NAVIGATION, STOP_WORDS, TOKEN, host, terms
from folio.operators import answer, captions, containment, graph, images, outline, pages, search
from folio.plans import engine, index, store

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return add


# --- SQL of the shared steps ---------------------------------------------------

_CARRIED = (
    fixtures.RAW_LINES
    + r""",
tagged AS (SELECT *, try_cast(nullif(regexp_extract(line, '\[\[PAGE_(\d+)\]\]', 1), '') AS BIGINT) AS tag FROM raw_lines),
carried AS (SELECT doc_id, line_no, line, coalesce(last_value(tag IGNORE NULLS) OVER (PARTITION BY doc_id ORDER BY line_no ROWS UNBOUNDED PRECEDING), 1) AS page, tag AS own FROM tagged),
pages_of AS (SELECT doc_id, line_no, line, page FROM carried WHERE own IS NULL)"""
)
_HEADS = (
    _CARRIED
    + r""",
sectioned AS (SELECT *, sum((level > 0)::INT) OVER (PARTITION BY doc_id ORDER BY line_no ROWS UNBOUNDED PRECEDING)::BIGINT AS seq FROM (
    SELECT *, length(regexp_extract(line, '^(#{1,6})\s+(.*)$', 1)) AS level, trim(regexp_extract(line, '^(#{1,6})\s+(.*)$', 2), ' ' || chr(9) || chr(13)) AS title FROM pages_of))"""
)
_NODES = (
    _HEADS
    + r""",
first_head AS (SELECT doc_id, line_no AS first_no FROM sectioned WHERE seq = 1 AND level > 0),
root_end AS (SELECT t.doc_id, max_by(t.tag, t.line_no) AS root_end FROM tagged t LEFT JOIN first_head USING (doc_id) WHERE t.tag IS NOT NULL AND (first_no IS NULL OR t.line_no < first_no) GROUP BY 1),
bodies AS (SELECT doc_id, seq, string_agg(line, chr(10) ORDER BY line_no) AS content FROM sectioned WHERE level = 0 AND regexp_matches(line, '\S') GROUP BY 1, 2),
every AS (
    SELECT d.doc_id, 0::BIGINT AS seq, 0::BIGINT AS level, 'Document Header / Introduction' AS title, 1::BIGINT AS page_start, coalesce(root_end, 1) AS page_end0 FROM (SELECT DISTINCT doc_id FROM raw_lines) d LEFT JOIN root_end USING (doc_id)
    UNION ALL SELECT doc_id, seq, level, title, page, page FROM sectioned WHERE level > 0),
nodes AS (SELECT e.doc_id, e.seq, printf('%04d', e.seq) AS node_id, e.level, e.title, e.page_start, e.page_end0, coalesce(content, '') AS content FROM every e LEFT JOIN bodies b ON e.doc_id = b.doc_id AND e.seq = b.seq),
parented AS (SELECT n.*, (SELECT max(m.seq) FROM nodes m WHERE m.doc_id = n.doc_id AND m.seq < n.seq AND m.level < n.level) AS parent_seq FROM nodes n)"""
)
_RANGES = (
    _NODES
    + r""",
sibling AS (SELECT *, lead(page_start) OVER (PARTITION BY doc_id, parent_seq ORDER BY seq) AS next_start FROM parented),
ranged AS (
    SELECT doc_id, seq, 0 AS depth, page_end0 AS page_end FROM sibling WHERE seq = 0
    UNION ALL SELECT s.doc_id, s.seq, r.depth + 1, greatest(s.page_start, coalesce(s.next_start, r.page_end)) FROM sibling s JOIN ranged r ON s.doc_id = r.doc_id AND s.parent_seq = r.seq),
outline AS (SELECT p.*, r.depth, r.page_end FROM parented p JOIN ranged r ON p.doc_id = r.doc_id AND p.seq = r.seq)"""
)
_STOPS = ",".join(f"'{x}'" for x in STOP_WORDS)
_TERMS = f"list_filter(regexp_extract_all(lower({{0}}), '{TOKEN}'), lambda x: (length(x) > 2 OR contains(x, '-')) AND x NOT IN ({_STOPS}))"


def _sql_text(template: str, **values: str) -> str:
    """SQL of a template with an expression in place of each {name}."""
    for name, value in values.items():
        template = template.replace("{" + name + "}", f"\0{value}\0")
    quoted = (x if k % 2 else "'" + x.replace("'", "''") + "'" for k, x in enumerate(template.split("\0")))
    return "concat(" + ", ".join(quoted) + ")"


def _bm25(base: str, questions: str) -> str:
    """Adds to base, which ends with outline, the questions and their hits."""
    return f"""{base}, {questions},
entries AS (SELECT doc_id, seq, title, content FROM outline),
counts AS (SELECT doc_id, seq, term, sum(w) AS tf FROM (
    SELECT doc_id, seq, unnest({_TERMS.format("title")}) AS term, 3 AS w FROM entries UNION ALL SELECT doc_id, seq, unnest({_TERMS.format("content")}), 1 FROM entries) GROUP BY 1, 2, 3),
sizes AS (SELECT doc_id, count(*) AS n FROM entries GROUP BY 1),
raws AS (SELECT doc_id, term, count(*) AS df, ln(any_value(n) - count(*) + 0.5) - ln(count(*) + 0.5) AS raw FROM counts JOIN sizes USING (doc_id) GROUP BY 1, 2),
idfs AS (SELECT doc_id, term, df, CASE WHEN raw < 0 THEN 0.25 * (sum(raw) OVER (PARTITION BY doc_id) / count(*) OVER (PARTITION BY doc_id)) ELSE raw END AS idf FROM raws),
lengths AS (SELECT doc_id, seq, sum(tf) AS dl FROM counts GROUP BY 1, 2),
means AS (SELECT doc_id, sum(dl)::DOUBLE / any_value(n) AS avgdl FROM lengths JOIN sizes USING (doc_id) GROUP BY 1),
asked AS (SELECT query_id, doc_id, term, count(*) AS qtf FROM (SELECT query_id, doc_id, unnest({_TERMS.format("query")}) AS term FROM questions) GROUP BY 1, 2, 3),
scored AS (SELECT query_id, doc_id, seq, round(sum(qtf * idf * tf * 2.5 / (tf + 1.5 * (0.25 + 0.75 * dl / avgdl))), 6) AS score
    FROM asked JOIN idfs USING (doc_id, term) JOIN counts USING (doc_id, term) JOIN lengths USING (doc_id, seq) JOIN means USING (doc_id) GROUP BY 1, 2, 3),
topped AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, seq) AS rank, max(score) OVER (PARTITION BY query_id) AS top FROM scored WHERE score > 0),
found AS (SELECT query_id, doc_id, seq, score FROM topped WHERE rank = 1 OR rank = 2 AND score >= 0.5 * top),
hits AS (SELECT * FROM found UNION ALL SELECT query_id, doc_id, 0, 0.0 FROM questions WHERE query_id NOT IN (SELECT query_id FROM found))"""


_BM25 = _bm25(_RANGES, fixtures.QUESTIONS)
_CAPTIONS = (
    fixtures.PAGED_MD
    + r""",
caps AS (SELECT doc_id, page, unnest(regexp_extract_all(md, 'CAPTION_', 1, 'i')) AS cap, generate_subscripts(regexp_extract_all(md, 'CAPTION_', 1, 'i'), 1) - 1 AS cap_pos FROM paged_md),
labelled AS (SELECT doc_id, page, cap_pos::BIGINT AS cap_pos, regexp_extract(trim(cap), 'LABEL_', 1, 'i') AS label, trim(cap) AS full_caption FROM caps),
captions AS (SELECT *, regexp_replace(lower(label), '[.\s]', '', 'g') AS normalized FROM labelled)""".replace("CAPTION_", CAPTION.removeprefix("(?iU)")).replace("LABEL_", LABEL.removeprefix("(?iU)"))
)
_MATCHED = (
    _CAPTIONS
    + ","
    + fixtures.IMAGES
    + r""",
dealt AS (SELECT c.*, CASE WHEN normalized LIKE 'fig%' THEN 'fig' WHEN normalized LIKE 'table%' THEN 'table' END AS kind, unnest([page - 1, page]) AS target FROM captions c),
placed AS (SELECT *, row_number() OVER (PARTITION BY doc_id, target, kind ORDER BY page, cap_pos) - 1 AS img_pos FROM dealt WHERE kind IS NOT NULL),
matched AS (SELECT i.doc_id, i.page, i.img_pos, coalesce(f.label, t.label, '') AS label, coalesce(f.full_caption, t.full_caption, 'Aucune légende trouvée') AS caption, coalesce(f.normalized, t.normalized, '') AS normalized_label
    FROM images i LEFT JOIN placed f ON f.kind = 'fig' AND f.doc_id = i.doc_id AND f.target = i.page AND f.img_pos = i.img_pos
    LEFT JOIN placed t ON t.kind = 'table' AND t.doc_id = i.doc_id AND t.target = i.page AND t.img_pos = i.img_pos)"""
)
_CLAIMED = """
large AS (SELECT * FROM images WHERE b64_len >= 5000),
claims AS (SELECT l.doc_id, l.page, l.img_pos, min(o.seq) AS seq FROM large l JOIN outline o ON o.doc_id = l.doc_id AND l.page BETWEEN o.page_start AND o.page_end GROUP BY 1, 2, 3)"""
_CLAIMS = f"{_RANGES},{fixtures.IMAGES},{_CLAIMED}"


def _outline(spark: SparkSession, sf_dir: str) -> DataFrame:
    return outline.outline(fixtures.raw_lines(spark, sf_dir))


def _matched(spark: SparkSession, sf_dir: str) -> DataFrame:
    return captions.matched(fixtures.images(spark, sf_dir), captions.mined(fixtures.paged_markdown(spark, sf_dir)))


def _corpus(spark: SparkSession, sf_dir: str) -> engine.Corpus:
    """The conversations, each turn under a heading and with a caption, ingested with their images."""
    return engine.ingest(fixtures.paged_markdown(spark, sf_dir, headed=True), fixtures.images(spark, sf_dir)).stored()


_INJECTED = (
    _MATCHED
    + r""",
own AS (SELECT doc_id, page, string_agg('[Visual Component] Caption: ' || caption, chr(10) ORDER BY img_pos) AS lines FROM matched WHERE caption <> 'Aucune légende trouvée' GROUP BY 1, 2),
injected AS (SELECT p.doc_id, p.page, concat_ws(chr(10), o.lines, p.md) AS md FROM paged_md p LEFT JOIN own o ON p.doc_id = o.doc_id AND p.page = o.page)"""
)
_INGESTED = (
    fixtures.HEADED_MD
    + _INJECTED.removeprefix(fixtures.PAGED_MD)
    + """,
marked AS (SELECT doc_id, string_split(string_agg('[[PAGE_' || page || ']]' || chr(10) || md, chr(10) ORDER BY page), chr(10)) AS xs FROM injected GROUP BY 1),
raw_lines AS (SELECT doc_id, generate_subscripts(xs, 1) - 1 AS line_no, unnest(xs) AS line FROM marked)"""
    + _RANGES.removeprefix(fixtures.RAW_LINES)
    + ","
    + _CLAIMED
)
_CLEAN = r"""regexp_replace({0}, '["\\\x00-\x1f]', '', 'g')"""
_VISUAL = r"regexp_extract_all({0}, '\[Visual Component\] Caption:\s*(.*?)(?:\n|$)', 1)"
_PREVIEW = r"""regexp_replace(trim(regexp_replace(left(content, 300), '\s+', ' ', 'g')), '[\x00-\x1f"\\]', '', 'g')"""
_ENTRIES = f"""
children AS (SELECT doc_id, parent_seq AS seq, list({{'node_id': node_id, 'title': {_CLEAN.format("title")}}} ORDER BY seq) AS children FROM outline WHERE parent_seq IS NOT NULL GROUP BY 1, 2),
entries_of AS (SELECT o.doc_id, o.seq, o.node_id, {_CLEAN.format("title")} AS title, page_start || '-' || page_end AS pages, CASE WHEN EXISTS (SELECT 1 FROM claims c WHERE c.doc_id = o.doc_id AND c.seq = o.seq) THEN 'Yes' ELSE 'No' END AS has_figures,
    list_transform({_VISUAL.format("content")}, lambda x: {_CLEAN.format("x")}) AS figure_captions, {_PREVIEW} AS preview, coalesce(c.children, []) AS children, lower(content) AS search
    FROM outline o LEFT JOIN children c ON o.doc_id = c.doc_id AND o.seq = c.seq)"""
#: Captions in the content of sections, and the first section that has one of the figure asked for.
_NAMED = f"""
caption_of AS (SELECT doc_id, seq, regexp_replace(lower(unnest({_VISUAL.format("content")})), '[.\\s]', '', 'g') AS cap FROM outline),
asked_for AS (SELECT query_id, doc_id, query, regexp_extract(lower(query), '{FIGURE_QUERY.removeprefix("(?U)")}', 1) AS number FROM questions),
shortcut AS (SELECT query_id, a.doc_id, min(seq) AS seq FROM asked_for a JOIN caption_of c ON a.doc_id = c.doc_id AND a.number <> '' AND regexp_matches(cap, 'fig(?:ure)?' || number || '\\b') GROUP BY 1, 2)"""

# --- pages and outlines ------------------------------------------------------------


@query(f"WITH {fixtures.RAW_LINES} SELECT * FROM raw_lines")
def page_lines(spark, sf_dir):
    return fixtures.raw_lines(spark, sf_dir)


@query(f"WITH {_CARRIED} SELECT * FROM pages_of")
def page_carry(spark, sf_dir):
    return outline.carried(fixtures.raw_lines(spark, sf_dir))


@query(f"WITH {fixtures.PAGED_MD} SELECT doc_id, string_agg('--- Page ' || page || ' ---' || chr(10) || md, chr(10) ORDER BY page) AS markdown FROM paged_md GROUP BY 1")
def paged_markdown(spark, sf_dir):
    return pages.assembled(fixtures.paged_markdown(spark, sf_dir))


@query(f"WITH {fixtures.PAGED_MD} SELECT doc_id, row_number() OVER (PARTITION BY doc_id ORDER BY page) - 1 AS part, page, regexp_replace(chr(10) || md || chr(10), '\\s+$', '') AS text FROM paged_md")
def page_split(spark, sf_dir):
    """Splits assembled markdown at its page markers again."""
    return pages.split(paged_markdown(spark, sf_dir))


@query(rf"WITH {fixtures.PAGED_MD}, whole AS (SELECT doc_id, string_agg('[[PAGE_' || page || ']]' || chr(10) || md, chr(10) ORDER BY page) AS markdown FROM paged_md GROUP BY 1) SELECT doc_id, unnest(string_split(markdown, chr(10))) AS line, generate_subscripts(string_split(markdown, chr(10)), 1) - 1 AS line_no FROM whole")
def page_tags(spark, sf_dir):
    """The lines of assembled markdown, its page markers made tags."""
    return pages.lines(paged_markdown(spark, sf_dir))


@query(f"WITH {_HEADS} SELECT doc_id, line_no, page, level, title, seq FROM sectioned WHERE level > 0")
def heading_detect(spark, sf_dir):
    return outline.sectioned(outline.carried(fixtures.raw_lines(spark, sf_dir))).where("level > 0").select("doc_id", "line_no", "page", "level", "title", "seq")


@query(f"WITH {_NODES} SELECT doc_id, seq, node_id, level, title, page_start FROM nodes")
def node_ids(spark, sf_dir):
    return outline.nodes(fixtures.raw_lines(spark, sf_dir)).select("doc_id", "seq", "node_id", "level", "title", "page_start")


@query(f"WITH {_NODES} SELECT doc_id, seq, parent_seq FROM parented")
def outline_parent(spark, sf_dir):
    return outline.parented(outline.nodes(fixtures.raw_lines(spark, sf_dir))).select("doc_id", "seq", "parent_seq")


@query(f"WITH {_NODES} SELECT doc_id, seq, content FROM nodes")
def node_content(spark, sf_dir):
    return outline.nodes(fixtures.raw_lines(spark, sf_dir)).select("doc_id", "seq", "content")


@query(f"WITH RECURSIVE {_RANGES} SELECT doc_id, seq, page_start, page_end FROM outline")
def page_ranges(spark, sf_dir):
    return _outline(spark, sf_dir).select("doc_id", "seq", "page_start", "page_end")


@query(f"WITH RECURSIVE {_RANGES} SELECT doc_id, count(*) AS sections, greatest(1, max(page_end), max(page_start)) AS total_pages FROM outline GROUP BY 1")
def section_totals(spark, sf_dir):
    return outline.totals(_outline(spark, sf_dir))


@query(f"WITH RECURSIVE {_RANGES} SELECT doc_id, string_agg(repeat('  ', depth) || CASE WHEN depth > 0 THEN '└─ ' ELSE '' END || '[' || node_id || '] ' || title || '  (p.' || page_start || ')', chr(10) ORDER BY seq) AS outline FROM outline GROUP BY 1")
def print_outline(spark, sf_dir):
    return outline.printed(_outline(spark, sf_dir))


# --- captions and images -------------------------------------------------------------


@query(f"WITH {_CAPTIONS} SELECT * FROM captions")
def caption_mine(spark, sf_dir):
    return captions.mined(fixtures.paged_markdown(spark, sf_dir))


@query(f"WITH {fixtures.IMAGES} SELECT doc_id, page, img_pos, b64_len, md5(b64) AS b64_md5 FROM images")
def image_group(spark, sf_dir):
    return fixtures.images(spark, sf_dir).select("doc_id", "page", "img_pos", "b64_len", F.md5("b64").alias("b64_md5"))


@query(f"WITH {_MATCHED} SELECT * FROM matched")
def caption_match(spark, sf_dir):
    return _matched(spark, sf_dir).select("doc_id", "page", "img_pos", "label", "caption", "normalized_label")


@query(f"WITH {_INJECTED} SELECT * FROM injected")
def caption_inject(spark, sf_dir):
    return captions.injected(fixtures.paged_markdown(spark, sf_dir), _matched(spark, sf_dir)).select("doc_id", "page", "md")


@query(rf"WITH {_INJECTED} SELECT doc_id, page, array_to_string(regexp_extract_all(md, '\[Visual Component\] Caption:\s*(.*?)(?:\n|$)', 1), '|') AS captions FROM injected")
def visual_captions(spark, sf_dir):
    return caption_inject(spark, sf_dir).select("doc_id", "page", F.array_join(captions.visual(F.col("md")), "|").alias("captions"))


@query(f"WITH RECURSIVE {_CLAIMS} SELECT * FROM claims")
def image_claim(spark, sf_dir):
    return images.claimed(_outline(spark, sf_dir), fixtures.images(spark, sf_dir)).select("doc_id", "page", "img_pos", "seq")


@query(
    f"WITH RECURSIVE {_CLAIMS}, ranked AS (SELECT c.*, md5(i.b64) AS b64_md5, row_number() OVER (PARTITION BY c.doc_id, md5(i.b64) ORDER BY c.seq, c.page, c.img_pos) AS rk FROM claims c JOIN images i USING (doc_id, page, img_pos)) SELECT r.doc_id, r.seq, o.title, o.page_start, r.page, r.img_pos, r.b64_md5 FROM ranked r JOIN outline o ON o.doc_id = r.doc_id AND o.seq = r.seq WHERE rk = 1"
)
def image_gallery(spark, sf_dir):
    sections, own = _outline(spark, sf_dir), fixtures.images(spark, sf_dir)
    return images.gallery(images.claimed(sections, own), own, sections).withColumn("b64_md5", F.md5("b64")).drop("b64")


@query(f"WITH RECURSIVE {_CLAIMS}, ranked AS (SELECT c.*, row_number() OVER (PARTITION BY doc_id ORDER BY seq, page, img_pos) AS rk FROM claims c) SELECT r.doc_id, r.seq, o.title, md5(i.b64) AS b64_md5 FROM ranked r JOIN outline o USING (doc_id, seq) JOIN images i USING (doc_id, page, img_pos) WHERE rk = 1")
def first_image(spark, sf_dir):
    sections, own = _outline(spark, sf_dir), fixtures.images(spark, sf_dir)
    return images.first_image(images.gallery(images.claimed(sections, own), own, sections)).select("doc_id", "seq", "title", F.md5("b64").alias("b64_md5"))


@query(f"WITH RECURSIVE {_CLAIMS}, once AS (SELECT DISTINCT c.doc_id, md5(i.b64) AS m FROM claims c JOIN images i USING (doc_id, page, img_pos)) SELECT o.doc_id, count(*) AS sections, greatest(1, max(page_end), max(page_start)) AS total_pages, any_value(coalesce(n, 0)) AS figures FROM outline o LEFT JOIN (SELECT doc_id, count(*) AS n FROM once GROUP BY 1) USING (doc_id) GROUP BY 1")
def welcome_metrics(spark, sf_dir):
    sections, own = _outline(spark, sf_dir), fixtures.images(spark, sf_dir)
    figures = images.gallery(images.claimed(sections, own), own, sections).groupBy("doc_id").agg(F.count("*").alias("figures"))
    return outline.totals(sections).join(figures, "doc_id", "left").withColumn("figures", F.coalesce("figures", F.lit(0).cast("long")))


_LAYOUT = "SELECT page_id % 100 AS doc_id, 1 + (page_id {div} 100) % 3 AS page, page_id AS img_pos, 60 + page_id * 37 % 300 AS x0, 160 + page_id * 37 % 300 AS x1, 60 + page_id * 53 % 700 AS y0, 140 + page_id * 53 % 700 AS y1, 842 AS height FROM {pages}"


@query(f"WITH p AS ({_LAYOUT.format(div='//', pages='pages')}) SELECT doc_id, page, img_pos FROM p WHERE y0 >= 70 AND y1 <= height - 70")
def image_margins(spark, sf_dir):
    fixtures.table(spark, sf_dir, "pages").createOrReplaceTempView("folio_pages")
    return images.within_margins(spark.sql(_LAYOUT.format(div="div", pages="folio_pages"))).select("doc_id", "page", "img_pos")


_SPANS = "SELECT doc_id, page, x0 + 10 AS x0, x1 - 10 AS x1, CASE WHEN img_pos % 3 = 0 THEN y0 - 30 ELSE y1 + 10 END AS y0, CASE WHEN img_pos % 3 = 0 THEN y0 - 12 ELSE y1 + 28 END AS y1, 'caption   of ' || img_pos AS text FROM layout"


@query(
    f"""WITH layout AS ({_LAYOUT.format(div="//", pages="pages")}), spans AS ({_SPANS}),
met AS (SELECT i.doc_id, i.page, i.img_pos, s.y0, s.x0, s.text, s.y0 < i.y1 + 50 AND s.y1 > i.y1 AS below FROM layout i JOIN spans s ON i.doc_id = s.doc_id AND i.page = s.page AND s.x0 < i.x1 + 20 AND s.x1 > i.x0 - 20 AND (s.y0 < i.y1 + 50 AND s.y1 > i.y1 OR s.y0 < i.y0 AND s.y1 > i.y0 - 50)),
low AS (SELECT doc_id, page, img_pos, regexp_replace(string_agg(text, ' ' ORDER BY y0, x0, text), '\\s+', ' ', 'g') AS t FROM met WHERE below GROUP BY 1, 2, 3),
high AS (SELECT doc_id, page, img_pos, regexp_replace(string_agg(text, ' ' ORDER BY y0, x0, text), '\\s+', ' ', 'g') AS t FROM met WHERE NOT below GROUP BY 1, 2, 3)
SELECT l.doc_id, l.page, l.img_pos, coalesce(low.t, high.t, 'Aucune légende trouvée') AS caption FROM layout l LEFT JOIN low ON l.doc_id = low.doc_id AND l.page = low.page AND l.img_pos = low.img_pos LEFT JOIN high ON l.doc_id = high.doc_id AND l.page = high.page AND l.img_pos = high.img_pos"""
)
def caption_zone(spark, sf_dir):
    fixtures.table(spark, sf_dir, "pages").createOrReplaceTempView("folio_pages")
    layout = spark.sql(_LAYOUT.format(div="div", pages="folio_pages"))
    layout.createOrReplaceTempView("folio_layout")
    return images.zone_captions(layout, spark.sql(_SPANS.replace("FROM layout", "FROM folio_layout")))


# --- search ---------------------------------------------------------------------------


@query(
    f"WITH RECURSIVE {_INGESTED}, {_ENTRIES} SELECT doc_id, seq, node_id, title, pages, has_figures, array_to_string(figure_captions, '|') AS figure_captions, preview, array_to_string(list_transform(children, lambda x: x.node_id || ':' || x.title), '|') AS children, search FROM entries_of"
)
def index_entries(spark, sf_dir):
    joined = F.array_join(F.transform("children", lambda x: F.concat(x["node_id"], F.lit(":"), x["title"])), "|")
    return engine.entries(_corpus(spark, sf_dir)).withColumn("figure_captions", F.array_join("figure_captions", "|")).withColumn("children", joined)


@query(f"WITH RECURSIVE {_INGESTED} SELECT doc_id, seq, node_id, level, title, parent_seq, page_start, page_end, content FROM outline")
def ingest_outline(spark, sf_dir):
    return _corpus(spark, sf_dir).sections.select("doc_id", "seq", "node_id", "level", "title", "parent_seq", "page_start", "page_end", "content")


@query(f"WITH RECURSIVE {_INGESTED} SELECT * FROM claims")
def ingest_claims(spark, sf_dir):
    return _corpus(spark, sf_dir).claims.select("doc_id", "page", "img_pos", "seq")


def _grown(spark, sf_dir):
    """The same corpus from pages that come in three lots, some of them late, again or corrected, and images that come last."""
    paged = fixtures.paged_markdown(spark, sf_dir, headed=True)
    lot = lambda k: paged.where((F.col("page") + F.col("doc_id")) % 2 == k)
    grown = store.Store(spark, storage.fresh_path(spark, "store", temporary=True), buckets=4)
    grown.upsert(lot(1).withColumn("version", F.lit(1)).unionByName(lot(0).where("page % 3 = 0").select("doc_id", "page", F.lit("# Draft\ndraft text").alias("md"), F.lit(0).alias("version"))))
    grown.upsert(lot(0).unionByName(lot(1).where("page % 4 = 1")).withColumn("version", F.lit(1)))
    grown.upsert(images=fixtures.images(spark, sf_dir))
    return grown.corpus()


@query(f"WITH RECURSIVE {_INGESTED} SELECT doc_id, seq, node_id, level, title, parent_seq, page_start, page_end, content FROM outline")
def grown_outline(spark, sf_dir):
    sections = _grown(spark, sf_dir).sections.join(fixtures.turns(spark, sf_dir).select("doc_id").distinct(), "doc_id", "left_semi")
    return sections.select("doc_id", "seq", "node_id", "level", "title", "parent_seq", "page_start", "page_end", "content")


@query(f"WITH RECURSIVE {_INGESTED} SELECT * FROM claims")
def grown_claims(spark, sf_dir):
    return _grown(spark, sf_dir).claims.select("doc_id", "page", "img_pos", "seq")


_JSON_CHILD = """list_transform(children, lambda c: '{' || chr(10) || '        "node_id": "' || c.node_id || '",' || chr(10) || '        "title": "' || c.title || '"' || chr(10) || '      }')"""
_JSON_LIST = "CASE WHEN len({0}) = 0 THEN '[]' ELSE '[' || chr(10) || '{1}  ' || array_to_string({0}, ',' || chr(10) || '{1}  ') || chr(10) || '{1}]' END"
_JSON_CAPTIONS = _JSON_LIST.format("""list_transform(figure_captions, lambda x: '"' || x || '"')""", "    ")
_JSON_CHILDREN = _JSON_LIST.format(_JSON_CHILD, "    ")
_JSON = f"""
written AS (SELECT doc_id, '[' || chr(10) || string_agg('  {{' || chr(10) || concat_ws(',' || chr(10), '    "node_id": "' || node_id || '"', '    "title": "' || title || '"', '    "pages": "' || pages || '"', '    "has_figures": "' || has_figures || '"',
    '    "figure_captions": ' || {_JSON_CAPTIONS}, '    "preview": "' || preview || '"',
    CASE WHEN len(children) > 0 THEN '    "children": ' || {_JSON_CHILDREN} END) || chr(10) || '  }}', ',' || chr(10) ORDER BY seq) || chr(10) || ']' AS entries FROM entries_of GROUP BY 1)"""


@query(f"WITH RECURSIVE {_INGESTED}, {_ENTRIES}, {_JSON}, {fixtures.LITERAL_QUESTIONS} SELECT query_id, q.doc_id, {_sql_text(NAVIGATION, query='query', entries='entries')} AS prompt FROM questions q JOIN written w ON q.doc_id = w.doc_id")
def navigation_prompts(spark, sf_dir):
    return search.navigation_prompts(fixtures.literal_questions(spark, sf_dir), engine.entries(_corpus(spark, sf_dir)))


@query(f"SELECT doc_id, array_to_string({_TERMS.format('text')}, ' ') AS terms FROM documents")
def tokenize_terms(spark, sf_dir):
    return fixtures.table(spark, sf_dir, "documents").select("doc_id", F.array_join(terms(F.col("text")), " ").alias("terms"))


@query(f"WITH RECURSIVE {_BM25} SELECT doc_id, term, df, round(idf, 6) AS idf FROM idfs")
def term_stats(spark, sf_dir):
    return search.term_weights(_outline(spark, sf_dir)).withColumn("idf", F.round("idf", 6))


@query(f"WITH RECURSIVE {_BM25} SELECT * FROM scored")
def bm25_scores(spark, sf_dir):
    return search.bm25(fixtures.questions(spark, sf_dir), _outline(spark, sf_dir))


@query(f"WITH RECURSIVE {_BM25} SELECT query_id, doc_id, seq::BIGINT AS seq, score::DOUBLE AS score FROM hits")
def bm25_top2(spark, sf_dir):
    return search.bm25_hits(fixtures.questions(spark, sf_dir), _outline(spark, sf_dir))


@query(f"WITH RECURSIVE {_INGESTED}, {fixtures.LITERAL_QUESTIONS}, {_NAMED} SELECT * FROM shortcut")
def figure_shortcut(spark, sf_dir):
    return search.figure_hits(fixtures.literal_questions(spark, sf_dir), _corpus(spark, sf_dir).sections)


_REPLIES = [
    (1, '{"thinking": "t", "node_list": ["0002", "0001", "0002", "0999"]}'),
    (2, '```json\n{"thinking": "f", "node_list": ["0001"]}\n```'),
    (3, '{thinking: "b", node_list: ["0003"]}'),
    (4, 'The sections "0001" and "0000" fit.'),
    (5, "nothing"),
    (6, '{"thinking": "n", "node_list": null}'),
]


def _replies(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each reply about each document."""
    docs = fixtures.turns(spark, sf_dir).select("doc_id").distinct()
    told = F.array(*(F.struct(F.lit(k).cast("long").alias("k"), F.lit(raw).alias("raw")) for k, raw in _REPLIES))
    return docs.select("doc_id", F.explode(told).alias("r")).select((F.col("doc_id") * 10 + F.col("r.k")).alias("query_id"), "doc_id", "r.raw")


@query(
    "SELECT doc_id * 10 + k AS query_id, thinking, node_list FROM (SELECT DISTINCT conv_id AS doc_id FROM conversations), (VALUES (1::BIGINT, 't', '0002,0001,0002,0999'), (2, 'f', '0001'), (3, 'b', '0003'), (4, 'regex-extracted', '0001,0000'), (5, NULL, NULL), (6, NULL, NULL)) v(k, thinking, node_list)"
)
def reply_parse(spark, sf_dir):
    got = search.parsed_reply(F.col("raw"))
    return _replies(spark, sf_dir).select("query_id", got["thinking"].alias("thinking"), F.array_join(got["node_list"], ",").alias("node_list"))


@query(
    f"WITH RECURSIVE {_RANGES}, replies AS (SELECT doc_id * 10 + k AS query_id, doc_id, unnest(ids) AS node_id, generate_subscripts(ids, 1) - 1 AS pos FROM (SELECT DISTINCT doc_id FROM turns), (VALUES (1::BIGINT, ['0002', '0001', '0002', '0999']), (2, ['0001']), (3, ['0003']), (4, ['0001', '0000'])) v(k, ids)) SELECT query_id, r.doc_id, o.seq, pos FROM replies r JOIN outline o USING (doc_id, node_id)"
)
def reply_validate(spark, sf_dir):
    replies = _replies(spark, sf_dir).select("query_id", "doc_id", search.parsed_reply(F.col("raw"))["node_list"].alias("node_list"))
    return search.valid_hits(replies, _outline(spark, sf_dir))


_RANKED = """
ranked AS (SELECT DISTINCT q.query_id, q.doc_id, o.seq FROM questions q JOIN (VALUES (2, '0001'), (3, '0002'), (3, '0001')) v(k, node_id) ON q.query_id = q.doc_id * 10 + k JOIN outline o ON o.doc_id = q.doc_id AND o.node_id = v.node_id WHERE q.query_id NOT IN (SELECT query_id FROM shortcut)),
cascaded AS (
    SELECT query_id, doc_id, seq::BIGINT AS seq, 'figure' AS via FROM shortcut UNION ALL SELECT query_id, doc_id, seq, 'ranker' FROM ranked
    UNION ALL SELECT query_id, doc_id, seq, 'bm25' FROM hits WHERE query_id NOT IN (SELECT query_id FROM shortcut UNION ALL SELECT query_id FROM ranked))"""
_ASKED = f"{_bm25(_INGESTED, fixtures.LITERAL_QUESTIONS)}, {_NAMED}, {_RANKED}"


@query(f"WITH RECURSIVE {_ASKED} SELECT * FROM cascaded")
def search_cascade(spark, sf_dir):
    return engine.find(_corpus(spark, sf_dir), fixtures.literal_questions(spark, sf_dir), replies=fixtures.literal_replies(spark, sf_dir))


_BY_LENGTH = re.sub(r"ranked AS \(.*?\)\),\ncascaded", "ranked AS (SELECT q.query_id, q.doc_id, o.seq FROM questions q JOIN outline o ON o.doc_id = q.doc_id AND o.node_id = '0001' WHERE length(query) % 3 = 0 AND q.query_id NOT IN (SELECT query_id FROM shortcut)),\ncascaded", _ASKED, flags=re.S)


def _by_length(prompt: str) -> str | None:
    """A ranker that names section 1 where the question's length is a multiple of 3, says nothing, or fails."""
    asked = prompt.split("\nQuery: ", 1)[1].split("\n\nDocument structure:", 1)[0]
    if len(asked) % 3 == 2:
        raise ValueError("no answer")
    return None if len(asked) % 3 else '{"thinking": "by length", "node_list": ["0001"]}'


@query(f"WITH RECURSIVE {_BY_LENGTH} SELECT * FROM cascaded")
def ranker_cascade(spark, sf_dir):
    """The cascade with a live ranker, whose replies are stored before anything reads them."""
    return engine.find(_corpus(spark, sf_dir), fixtures.literal_questions(spark, sf_dir), ranker=_by_length)


@query(f"WITH RECURSIVE {_BM25} SELECT * FROM scored")
def indexed_scores(spark, sf_dir):
    """BM25 from a stored index."""
    return search.bm25(fixtures.questions(spark, sf_dir), None, index.stored(_outline(spark, sf_dir)).postings())


@query(f"WITH RECURSIVE {_BM25} SELECT h.query_id, o.doc_id, o.seq, o.node_id, o.title FROM hits h JOIN outline o ON h.doc_id = o.doc_id AND h.seq = o.seq")
def retrieve_nodes(spark, sf_dir):
    asked, sections = fixtures.questions(spark, sf_dir), _outline(spark, sf_dir)
    return search.retrieved(search.bm25_hits(asked, sections), asked, sections).select("query_id", "doc_id", "seq", "node_id", "title")


# --- answers ----------------------------------------------------------------------------


def _found(spark, sf_dir):
    asked, sections = fixtures.questions(spark, sf_dir), storage.written(_outline(spark, sf_dir), "sections")  # read by the search and for its hits
    return asked, search.retrieved(search.bm25_hits(asked, sections), asked, sections)


@query(f"SELECT item_id, regexp_matches(lower(text), '{INTENT}') AS is_visual FROM benchmark")
def visual_intent(spark, sf_dir):
    return fixtures.table(spark, sf_dir, "benchmark").select("item_id", answer.is_visual(F.col("text")).alias("is_visual"))


_FOUND = "SELECT h.query_id, o.* FROM {0} h JOIN outline o ON h.doc_id = o.doc_id AND h.seq = o.seq"


def _contexts(hits: str) -> str:
    return f"SELECT query_id, doc_id, string_agg('[Pages: ' || page_start || '-' || page_end || ' | Section: ' || title || ']' || chr(10) || left(content, 2500), chr(10) || chr(10) ORDER BY seq) AS context, string_agg('Section: ''' || title || ''', Page ' || page_start || '-' || page_end, '; ' ORDER BY seq) AS sources, count(*) AS n_sections FROM ({_FOUND.format(hits)}) GROUP BY 1, 2"


@query(f"WITH RECURSIVE {_BM25} SELECT query_id, doc_id, context FROM ({_contexts('hits')})")
def context_blocks(spark, sf_dir):
    return answer.contexts(_found(spark, sf_dir)[1]).select("query_id", "doc_id", "context")


@query(f"WITH RECURSIVE {_BM25} SELECT query_id, doc_id, sources, n_sections FROM ({_contexts('hits')})")
def search_citations(spark, sf_dir):
    return answer.contexts(_found(spark, sf_dir)[1]).select("query_id", "doc_id", "sources", "n_sections")


_PROMPT = _sql_text(ANSWERING, query="query", context="context")


@query(f"WITH RECURSIVE {_BM25} SELECT query_id, c.doc_id, {_PROMPT} AS prompt, sources, regexp_matches(lower(query), '{INTENT}') AS is_visual FROM ({_contexts('hits')}) c JOIN questions q USING (query_id)")
def answer_prompts(spark, sf_dir):
    asked, found = _found(spark, sf_dir)
    return answer.prompts(asked, found)


@query(
    rf"""WITH {_MATCHED}, {fixtures.LITERAL_QUESTIONS}, asked AS (SELECT query_id, doc_id, regexp_extract(lower(query), 'fig(?:ure)?\.?\s*(\d+)', 1) AS number FROM questions),
hit AS (SELECT query_id, m.doc_id, page, img_pos FROM matched m JOIN asked a ON m.doc_id = a.doc_id AND number <> '' WHERE regexp_matches(regexp_replace(lower(label), '[.\s]', '', 'g'), 'fig(?:ure)?' || number || '\b') OR regexp_matches(regexp_replace(lower(caption), '[.\s]', '', 'g'), 'fig(?:ure)?' || number || '\b'))
SELECT query_id, doc_id, page, img_pos FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY page, img_pos) AS rk FROM hit) WHERE rk = 1"""
)
def figure_resolve(spark, sf_dir):
    return answer.figures(fixtures.literal_questions(spark, sf_dir), _matched(spark, sf_dir))


_TRIES = r"""
names AS (SELECT doc_id, page, img_pos, regexp_replace(lower(label), '[.\s]', '', 'g') AS label, regexp_replace(lower(caption), '[.\s]', '', 'g') AS caption FROM matched),
numbered AS (SELECT * FROM asked_for WHERE number <> ''),
local_of AS (SELECT query_id, a.doc_id, c.seq, n.page, n.img_pos FROM numbered a JOIN names n ON n.doc_id = a.doc_id AND regexp_matches(caption, 'fig(?:ure)?' || number || '\b') JOIN claims c ON c.doc_id = n.doc_id AND c.page = n.page AND c.img_pos = n.img_pos),
told_of AS (SELECT query_id, a.doc_id, i.page, i.img_pos, c.seq FROM numbered a JOIN caption_of c ON a.doc_id = c.doc_id AND regexp_matches(cap, 'fig(?:ure)?' || number || '\b') JOIN outline o ON o.doc_id = c.doc_id AND o.seq = c.seq JOIN images i ON i.doc_id = c.doc_id AND i.page BETWEEN o.page_start AND o.page_end WHERE b64_len > 0),
tries AS (
    SELECT query_id, doc_id, page, img_pos, 1 AS pass, seq FROM local_of
    UNION ALL SELECT query_id, a.doc_id, page, img_pos, 2, 0 FROM numbered a JOIN names n ON n.doc_id = a.doc_id AND (regexp_matches(label, 'fig(?:ure)?' || number || '\b') OR regexp_matches(caption, 'fig(?:ure)?' || number || '\b'))
    UNION ALL SELECT query_id, doc_id, page, img_pos, 3, seq FROM told_of),
resolved AS (SELECT query_id, doc_id, page, img_pos, pass FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY pass, seq, page, img_pos) AS rk FROM tries) WHERE rk = 1)"""


@query(f"WITH RECURSIVE {_INGESTED}, {fixtures.LITERAL_QUESTIONS}, {_NAMED}, {_TRIES} SELECT * FROM resolved")
def figure_cascade(spark, sf_dir):
    corpus = _corpus(spark, sf_dir)
    return answer.resolved(fixtures.literal_questions(spark, sf_dir), corpus.images, corpus.claims, corpus.sections)


_ATTACHED = f"""
found_of AS (SELECT DISTINCT query_id, doc_id, seq FROM cascaded),
sent AS (SELECT query_id, doc_id, count(*) AS copies FROM found_of GROUP BY 1, 2),
near AS (
    SELECT query_id, l.doc_id, l.seq, l.page, l.img_pos FROM local_of l JOIN found_of o USING (query_id, seq)
    UNION ALL SELECT query_id, o.doc_id, o.seq, c.page, c.img_pos FROM found_of o JOIN asked_for a USING (query_id) JOIN claims c ON c.doc_id = o.doc_id AND c.seq = o.seq WHERE a.number = '' AND regexp_matches(lower(a.query), '{INTENT}')),
attached AS (
    SELECT query_id, n.doc_id, page, img_pos, copies FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY seq, page, img_pos) AS rk FROM near) n JOIN sent USING (query_id) WHERE rk = 1
    UNION ALL SELECT query_id, doc_id, page, img_pos, 1 FROM resolved WHERE query_id NOT IN (SELECT query_id FROM near))"""


@query(f"WITH RECURSIVE {_ASKED}, {_TRIES}, {_ATTACHED} SELECT * FROM attached")
def image_attachments(spark, sf_dir):
    corpus, asked = _corpus(spark, sf_dir), fixtures.literal_questions(spark, sf_dir)
    found = engine.retrieve(corpus, asked, replies=fixtures.literal_replies(spark, sf_dir))
    return answer.attached(asked, found, corpus.images, corpus.claims, corpus.sections)


_EXTRACTS = rf"""
pieces AS (SELECT query_id, doc_id, seq, unnest(xs) AS piece, generate_subscripts(xs, 1) AS pos FROM (SELECT query_id, doc_id, seq, list_filter(list_transform(regexp_extract_all(left(content, 2500), '[^\n.!?]+[.!?]*'), lambda x: trim(x)), lambda x: x <> '') AS xs FROM ({_FOUND.format("found_of")}))),
shared AS (SELECT p.*, len(list_intersect({_TERMS.format("query")}, {_TERMS.format("piece")})) AS n FROM pieces p JOIN questions q USING (query_id)),
extracts AS (SELECT query_id, piece AS answer FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY n DESC, seq, pos) AS rk FROM shared) WHERE rk = 1)"""


@query(
    f"WITH RECURSIVE {_ASKED}, {_TRIES}, {_ATTACHED}, {_EXTRACTS}, told AS ({_contexts('found_of')}) SELECT query_id, q.doc_id, {_PROMPT} AS prompt, coalesce(a.copies, 0) AS n_images, md5(i.b64) AS image_md5, coalesce(e.answer, '') AS answer, t.sources FROM questions q JOIN told t USING (query_id) LEFT JOIN attached a USING (query_id) LEFT JOIN images i ON i.doc_id = a.doc_id AND i.page = a.page AND i.img_pos = a.img_pos LEFT JOIN extracts e USING (query_id)"
)
def ask(spark, sf_dir):
    got = engine.ask(_corpus(spark, sf_dir), fixtures.literal_questions(spark, sf_dir), replies=fixtures.literal_replies(spark, sf_dir))
    return got.select("query_id", "doc_id", "prompt", F.size("images").cast("long").alias("n_images"), F.md5(F.get("images", F.lit(0))).alias("image_md5"), "answer", F.array_join("sources", "; ").alias("sources"))


@query(
    f"WITH RECURSIVE {_RANGES}, shut AS (SELECT *, lead(depth) OVER (PARTITION BY doc_id ORDER BY seq) AS after, lag(depth) OVER (PARTITION BY doc_id ORDER BY seq) AS before FROM outline) SELECT doc_id, '[' || string_agg(CASE WHEN before >= depth THEN ',' ELSE '' END || left(j, length(j) - 1) || ',\"nodes\":[' || repeat(']}}', (CASE WHEN after IS NULL THEN depth + 1 ELSE depth - after + 1 END)::INT), '' ORDER BY seq) || ']' AS tree FROM (SELECT *, to_json({{'node_id': node_id, 'title': title, 'page_start': page_start, 'page_end': page_end, 'content': content, 'base64_images': []::VARCHAR[], 'image_captions': []::VARCHAR[], 'image_labels': []::VARCHAR[]}})::VARCHAR AS j FROM shut) GROUP BY 1"
)
def nested_tree(spark, sf_dir):
    return outline.nested(_outline(spark, sf_dir))


@query(f"WITH RECURSIVE {_RANGES} SELECT doc_id, seq, node_id, depth::INT AS depth, title, content, parent_seq, page_start, page_end FROM outline")
def tree_read_back(spark, sf_dir):
    return outline.unnested(outline.nested(_outline(spark, sf_dir)))[0].drop("level")


@query(
    f"WITH {fixtures.TURNS}, asked AS (SELECT DISTINCT doc_id, p AS pattern FROM (SELECT doc_id, unnest([left(text, 6), substr(text, 3, 12), left(text, 40)]) AS p FROM turns) WHERE p <> '') SELECT a.doc_id, pattern, t.turn AS text_id FROM asked a JOIN turns t ON a.doc_id = t.doc_id AND contains(t.text, a.pattern)"
)
def contained_passages(spark, sf_dir):
    """Which turns of a conversation hold what each of them begins with."""
    turns = fixtures.turns(spark, sf_dir)
    heads = turns.select("doc_id", F.explode(F.array(F.left("text", F.lit(6)), F.substring("text", 3, 12), F.left("text", F.lit(40)))).alias("pattern"))
    return containment.contained(heads, turns.select("doc_id", F.col("turn").alias("text_id"), "text"))


# --- graph, export, sources ---------------------------------------------------------------


@query("SELECT page_id, regexp_extract(url, '^[a-z]+://([^/?#]+)', 1) AS host FROM pages")
def host_of_url(spark, sf_dir):
    return fixtures.table(spark, sf_dir, "pages").select("page_id", host(F.col("url")).alias("host"))


@query(
    rf"WITH {_NODES}, slugs AS (SELECT doc_id, seq, regexp_replace(regexp_replace(lower(title), '[^a-z0-9]+', '_', 'g'), '^_+|_+$', '', 'g') AS slug FROM nodes WHERE seq > 0), nth AS (SELECT *, row_number() OVER (PARTITION BY doc_id, slug ORDER BY seq) - 1 AS k FROM slugs) SELECT doc_id, seq, 'section_' || slug || CASE WHEN k > 0 THEN '_' || k ELSE '' END AS vertex_id FROM nth"
)
def section_slugs(spark, sf_dir):
    return graph.section_ids(outline.nodes(fixtures.raw_lines(spark, sf_dir))).select("doc_id", "seq", "vertex_id")


@query(f"WITH {_NODES} SELECT c.doc_id, p.node_id AS source, c.node_id AS target, 'contains' AS edge_type FROM parented c JOIN parented p ON c.doc_id = p.doc_id AND c.parent_seq = p.seq")
def graph_edges(spark, sf_dir):
    return graph.contains_edges(outline.parented(outline.nodes(fixtures.raw_lines(spark, sf_dir))))


_FORMULA_TEXT = "coalesce(text, '') || chr(10) || 'so $x_' || doc_id || '$ and $$y = m_' || doc_id || '$$'"


@query(
    rf"""WITH t AS (SELECT doc_id, regexp_replace({_FORMULA_TEXT}, '\${{3,}}', '', 'g') AS t FROM documents),
f AS (SELECT doc_id, list_concat(regexp_extract_all(t, '\$\$([^$]+)\$\$', 1), regexp_extract_all(regexp_replace(t, '\$\$([^$]+)\$\$', '', 'g'), '\$([^$\n]+)\$', 1)) AS fs FROM t),
e AS (SELECT doc_id, unnest(fs) AS content, generate_subscripts(fs, 1) - 1 AS pos FROM f) SELECT doc_id, pos, 'formula_' || pos AS formula_id, content FROM e"""
)
def formulas(spark, sf_dir):
    """The documents, each with two formulas of its own added."""
    added = F.concat(F.coalesce("text", F.lit("")), F.lit("\nso $x_"), F.col("doc_id").cast("string"), F.lit("$ and $$y = m_"), F.col("doc_id").cast("string"), F.lit("$$"))
    return graph.formulas(fixtures.table(spark, sf_dir, "documents").withColumn("text", added))


@query(f"WITH {_NODES} SELECT doc_id, string_agg(part, chr(10) ORDER BY seq) AS markdown FROM (SELECT doc_id, seq, concat_ws(chr(10), CASE WHEN level > 0 THEN repeat('#', level) || ' ' || title END, nullif(content, '')) AS part FROM nodes) WHERE part <> '' GROUP BY 1")
def markdown_export(spark, sf_dir):
    return graph.markdown(outline.nodes(fixtures.raw_lines(spark, sf_dir)))


_ITEMS = f"{fixtures.TURNS}, tree AS (SELECT *, (row_number() OVER (PARTITION BY doc_id ORDER BY turn) - 1)::BIGINT AS seq, CASE role WHEN 'system' THEN 1 WHEN 'user' THEN 2 ELSE 3 END::BIGINT AS level, string_split(text, chr(10))[1] AS title, text || ' where $$y_' || turn || ' = m$$' AS summary FROM turns), up AS (SELECT t.*, printf('%04d', t.seq) AS node_id, (SELECT max(m.seq) FROM tree m WHERE m.doc_id = t.doc_id AND m.seq < t.seq AND m.level < t.level) AS parent_seq FROM tree t), deep AS (SELECT doc_id, seq, 0 AS depth FROM up WHERE parent_seq IS NULL UNION ALL SELECT u.doc_id, u.seq, d.depth + 1 FROM up u JOIN deep d ON u.doc_id = d.doc_id AND u.parent_seq = d.seq)"


@query(f"WITH RECURSIVE {_ITEMS} SELECT u.doc_id, u.seq, node_id, parent_seq, level, depth::BIGINT AS depth, title, turn + 1 AS page_index, summary, (role = 'assistant')::BIGINT AS n_visuals, (role = 'user')::BIGINT AS n_tables FROM up u JOIN deep USING (doc_id, seq)")
def item_tree(spark, sf_dir):
    tree = graph.item_tree(fixtures.items(spark, sf_dir))
    return tree.select("doc_id", "seq", "node_id", "parent_seq", "level", "depth", "title", "page_index", "summary", F.size("visuals").cast("long").alias("n_visuals"), F.size("tables").cast("long").alias("n_tables"))


@query(
    f"WITH RECURSIVE {_ITEMS} SELECT doc_id, string_agg(repeat('#', depth + 1) || ' ' || title || chr(10) || chr(10) || summary || CASE role WHEN 'assistant' THEN chr(10) || chr(10) || '![fig_' || turn || '](images/fig_' || turn || '.png)' WHEN 'user' THEN chr(10) || chr(10) || '| ' || turn || ' | $x_' || turn || '$ |' ELSE '' END, chr(10) || chr(10) ORDER BY seq) AS markdown FROM up JOIN deep USING (doc_id, seq) GROUP BY 1"
)
def item_markdown(spark, sf_dir):
    return graph.item_markdown(graph.item_tree(fixtures.items(spark, sf_dir)))


@query(f"WITH {fixtures.TURNS} SELECT doc_id, 'fig_' || turn AS node_id, 'images/fig_' || turn || '.png' AS path, turn + 1 AS page, 1.0::DOUBLE AS x0, (turn + 10)::DOUBLE AS x1 FROM turns WHERE role = 'assistant'")
def item_images(spark, sf_dir):
    return graph.item_images(graph.item_tree(fixtures.items(spark, sf_dir))).select("doc_id", "node_id", "path", "page", "bbox.x0", "bbox.x1")


def _item_graph(spark, sf_dir):
    """The graph of the items; each figure is referred to with the title of its own section as context."""
    rows = fixtures.turns(spark, sf_dir).where("role = 'assistant'")
    refs = rows.select("doc_id", F.col("turn").alias("ref_no"), F.concat(F.lit("fig_"), F.col("turn").cast("string")).alias("target_node_id"), F.split("text", "\n", -1)[0].alias("context"))
    return graph.item_adjacency(graph.item_tree(fixtures.items(spark, sf_dir)), refs)


@query(
    f"WITH RECURSIVE {_ITEMS} SELECT doc_id, 'tree_' || node_id AS id, 'section' AS node_type, title, summary AS content FROM up UNION ALL SELECT doc_id, 'fig_' || turn, 'figure', 'fig_' || turn, 'images/fig_' || turn || '.png' FROM up WHERE role = 'assistant' UNION ALL SELECT doc_id, 'tbl_' || node_id || '_0', 'text_block', 'tbl_' || node_id || '_0', '| ' || turn || ' | $x_' || turn || '$ |' FROM up WHERE role = 'user' UNION ALL SELECT doc_id, 'formula_' || seq, 'formula', 'formula_' || seq, 'y_' || turn || ' = m' FROM up"
)
def item_vertices(spark, sf_dir):
    return _item_graph(spark, sf_dir)[0]


@query(
    f"WITH RECURSIVE {_ITEMS} SELECT c.doc_id, 'tree_' || p.node_id AS source, 'tree_' || c.node_id AS target, 'contains' AS edge_type FROM up c JOIN up p ON c.doc_id = p.doc_id AND c.parent_seq = p.seq UNION ALL SELECT doc_id, 'tree_' || node_id, 'fig_' || turn, 'contains' FROM up WHERE role = 'assistant' UNION ALL SELECT doc_id, 'tree_' || node_id, 'tbl_' || node_id || '_0', 'contains' FROM up WHERE role = 'user' UNION ALL SELECT doc_id, 'tree_' || node_id, 'formula_' || seq, 'contains' FROM up UNION ALL SELECT r.doc_id, 'tree_' || (SELECT min(u.node_id) FROM up u WHERE u.doc_id = r.doc_id AND contains(u.summary, r.title)), 'fig_' || r.turn, 'references' FROM up r WHERE role = 'assistant'"
)
def item_edges(spark, sf_dir):
    return _item_graph(spark, sf_dir)[1]


_SLUGS = r"slugs AS (SELECT *, regexp_replace(regexp_replace(lower(title), '[^a-z0-9]+', '_', 'g'), '^_+|_+$', '', 'g') AS slug FROM parented WHERE seq > 0), nth AS (SELECT *, row_number() OVER (PARTITION BY doc_id, slug ORDER BY seq) - 1 AS k FROM slugs), named AS (SELECT *, 'section_' || slug || CASE WHEN k > 0 THEN '_' || k ELSE '' END AS vertex_id FROM nth)"
_PICTURES = f"{fixtures.IMAGES}, pictures AS (SELECT i.doc_id, 'fig_' || page || '_' || img_pos AS id, 'images/' || page || '_' || img_pos || '.png' AS path, page FROM images i JOIN (SELECT DISTINCT doc_id FROM turns) USING (doc_id))"


def _page_graph(spark, sf_dir):
    """The graph of the outlines with their images, each beside a text of its page and referred to from nowhere in particular."""
    sections = outline.parented(outline.nodes(fixtures.raw_lines(spark, sf_dir)))
    name = F.concat(F.col("page").cast("string"), F.lit("_"), F.col("img_pos").cast("string"))
    pictures = fixtures.images(spark, sf_dir).join(sections.select("doc_id").distinct(), "doc_id", "left_semi").select("doc_id", "page", F.concat(F.lit("fig_"), name).alias("node_id"), F.concat(F.lit("images/"), name, F.lit(".png")).alias("path"))
    beside = pictures.select("doc_id", F.col("node_id").alias("source_id"), F.concat(F.lit("text_"), F.col("page").cast("string")).alias("target_id"))
    refs = pictures.select("doc_id", F.col("node_id").alias("ref_no"), F.col("node_id").alias("target_node_id"), F.lit("no section says this").alias("context"))
    return graph.adjacency(sections, pictures, beside, refs)


@query(f"WITH {_NODES}, {_SLUGS}, {_PICTURES} SELECT doc_id, vertex_id AS id, 'section' AS node_type, title, content FROM named UNION ALL SELECT doc_id, id, 'figure', id, path FROM pictures")
def graph_vertices(spark, sf_dir):
    return _page_graph(spark, sf_dir)[0]


@query(
    f"WITH {_NODES}, {_SLUGS}, {_PICTURES}, firsts AS (SELECT doc_id, min_by(vertex_id, seq) AS vertex_id FROM named GROUP BY 1) SELECT c.doc_id, p.vertex_id AS source, c.vertex_id AS target, 'contains' AS edge_type FROM named c JOIN named p ON c.doc_id = p.doc_id AND c.parent_seq = p.seq UNION ALL SELECT doc_id, id, 'text_' || page, 'co-located' FROM pictures UNION ALL SELECT p.doc_id, vertex_id, id, 'references' FROM pictures p JOIN firsts USING (doc_id)"
)
def graph_all_edges(spark, sf_dir):
    return _page_graph(spark, sf_dir)[1]


@query(
    r"""WITH t AS (SELECT doc_id, list_filter(list_transform(string_split(coalesce(text, ''), chr(10)), lambda x: regexp_replace(x, '^\s+|\s+$', '', 'g')), lambda x: x <> '') AS xs FROM documents)
SELECT doc_id, 0::BIGINT AS pos, 'shot_' || doc_id || '.png' AS tag, CASE WHEN len(xs) = 0 THEN 'No caption detected.' ELSE array_to_string(xs[:2], ' ') END AS caption, 'shot_' || doc_id AS name FROM t UNION ALL SELECT doc_id, 1, 'last', 'No caption detected.', NULL FROM t"""
)
def tag_captions(spark, sf_dir):
    """The documents between two image tags; the first has a file."""
    docs = fixtures.table(spark, sf_dir, "documents")
    marked = docs.select("doc_id", F.concat(F.lit("![shot_"), F.col("doc_id").cast("string"), F.lit(".png](x)\n\n"), F.coalesce("text", F.lit("")), F.lit("\n![last](y)")).alias("markdown"))
    tags = captions.beside_tags(marked)
    files = docs.select("doc_id", F.lit(0).alias("file_no"), F.concat(F.lit("shot_"), F.col("doc_id").cast("string")).alias("name"))
    return tags.join(captions.tag_sources(tags, files), ["doc_id", "pos", "tag"])
