"""Graph view of documents: vertices and edges of outlines and of trees of typed items, formulas and markdown.

Vertices are (doc_id, id, node_type, title, content), edges (doc_id, source, target, edge_type).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from folio import storage
from folio.operators.containment import contained
from folio.operators.outline import ROOT_TITLE, parented

BOX = "STRUCT<x0: DOUBLE, y0: DOUBLE, x1: DOUBLE, y1: DOUBLE>"
VISUALS = f"ARRAY<STRUCT<image_id: STRING, page: BIGINT, path: STRING, bbox: ARRAY<{BOX}>>>"
TABLES = "ARRAY<STRUCT<page: BIGINT, markdown_content: STRING>>"


def section_ids(sections: DataFrame) -> DataFrame:
    """Adds vertex_id: section_ and a slug of the title; repeats in a document get _1, _2 and so on."""
    slug = F.regexp_replace(F.regexp_replace(F.lower("title"), "[^a-z0-9]+", "_"), "^_+|_+$", "")
    df = sections.where("seq > 0").withColumn("slug", slug)
    nth = F.row_number().over(Window.partitionBy("doc_id", "slug").orderBy("seq")) - 1
    return df.withColumn("vertex_id", F.concat(F.lit("section_"), "slug", F.when(nth > 0, F.concat(F.lit("_"), nth)).otherwise(F.lit("")))).drop("slug")


def contains_edges(sections: DataFrame) -> DataFrame:
    """(doc_id, source, target, edge_type) from parents to children."""
    up = sections.select("doc_id", F.col("seq").alias("parent_seq"), F.col("node_id").alias("source"))
    return sections.where("parent_seq is not null").join(up, ["doc_id", "parent_seq"]).select("doc_id", "source", F.col("node_id").alias("target"), F.lit("contains").alias("edge_type"))


def _formulas(text: Column) -> Column:
    text = F.regexp_replace(F.coalesce(text, F.lit("")), r"\${3,}", "")
    block = F.regexp_extract_all(text, F.lit(r"\$\$([^$]+)\$\$"), F.lit(1))
    return F.concat(block, F.regexp_extract_all(F.regexp_replace(text, r"\$\$([^$]+)\$\$", ""), F.lit(r"\$([^$\n]+)\$"), F.lit(1)))


def formulas(docs: DataFrame) -> DataFrame:
    """(doc_id, pos, formula_id, content): $$ blocks, then $ spans of what is left; runs of three dollars are no formula."""
    return docs.select("doc_id", F.posexplode(_formulas(F.col("text"))).alias("pos", "content")).select("doc_id", F.col("pos").cast("long").alias("pos"), F.concat(F.lit("formula_"), F.col("pos").cast("string")).alias("formula_id"), "content")


def _vertex(id_, kind: str, title, content) -> list[Column]:
    return [F.col("doc_id"), id_.alias("id"), F.lit(kind).alias("node_type"), title.alias("title"), F.coalesce(content, F.lit("")).alias("content")]


def _edge(source, target, kind: str = "contains") -> list[Column]:
    return [F.col("doc_id"), source.alias("source"), target.alias("target"), F.lit(kind).alias("edge_type")]


def _held_formulas(held: DataFrame) -> DataFrame:
    """(doc_id, owner, id, content): the formulas of (doc_id, seq, owner, content), numbered through the document."""
    each = held.select("doc_id", "seq", "owner", F.posexplode(_formulas(F.col("content"))).alias("pos", "formula"))
    nth = F.row_number().over(Window.partitionBy("doc_id").orderBy("seq", "pos")) - 1
    return each.select("doc_id", "owner", F.concat(F.lit("formula_"), nth.cast("string")).alias("id"), F.col("formula").alias("content"))


def _references(held: DataFrame, refs: DataFrame) -> DataFrame:
    """Edges of refs (doc_id, ref_no, target_node_id, context) from the first of (doc_id, seq, owner, content) that has the context, else from the first of the document.

    Contexts meet contents by containment.contained(); contents don't travel with the references.
    """
    owners = held.select("doc_id", "seq", "owner")
    first = owners.groupBy("doc_id").agg(F.min(F.struct("seq", "owner")).alias("first"))
    met = contained(refs.select("doc_id", F.col("context").alias("pattern")), held.select("doc_id", F.col("seq").alias("text_id"), F.col("content").alias("text")))
    best = met.groupBy("doc_id", F.col("pattern").alias("context")).agg(F.min("text_id").alias("seq")).join(owners, ["doc_id", "seq"]).groupBy("doc_id", "context").agg(F.min("owner").alias("owner"))
    rows = refs.select("doc_id", "ref_no", "target_node_id", "context").distinct().join(best, ["doc_id", "context"], "left").join(first, "doc_id")
    return rows.select(*_edge(F.coalesce("owner", F.col("first.owner")), F.col("target_node_id"), "references"))


def _graph(held: DataFrame, up: DataFrame, figures: DataFrame | None, co_located: DataFrame | None, refs: DataFrame | None) -> tuple[DataFrame, DataFrame]:
    found = _held_formulas(held)
    vertices, edges = found.select(*_vertex(F.col("id"), "formula", F.col("id"), F.col("content"))), up.unionByName(found.select(*_edge(F.col("owner"), F.col("id"))))
    if figures is not None:
        vertices = vertices.unionByName(figures.select(*_vertex(F.col("node_id"), "figure", F.col("node_id"), F.col("path"))))
    if co_located is not None:
        edges = edges.unionByName(co_located.select(*_edge(F.col("source_id"), F.col("target_id"), "co-located")))
    if refs is not None:
        edges = edges.unionByName(_references(held, refs))
    return vertices, edges


def adjacency(sections: DataFrame, figures: DataFrame | None = None, co_located: DataFrame | None = None, refs: DataFrame | None = None) -> tuple[DataFrame, DataFrame]:
    """Vertices and edges of outlines (doc_id, seq, title, content, parent_seq).

    A document without headings is one vertex "document". figures has (doc_id, node_id, path), co_located (doc_id, source_id,
    target_id), refs (doc_id, ref_no, target_node_id, context).
    """
    own = section_ids(sections)
    bare = sections.join(own.select("doc_id").distinct(), "doc_id", "left_anti").withColumn("vertex_id", F.lit("document"))
    held = own.unionByName(bare, allowMissingColumns=True)
    vertices = own.select(*_vertex(F.col("vertex_id"), "section", F.col("title"), F.col("content"))).unionByName(bare.select(*_vertex(F.col("vertex_id"), "document", F.col("title"), F.col("content"))))
    parents = own.select("doc_id", F.col("seq").alias("parent_seq"), F.col("vertex_id").alias("source"))
    up = own.where("parent_seq > 0").join(parents, ["doc_id", "parent_seq"]).select(*_edge(F.col("source"), F.col("vertex_id")))
    more, edges = _graph(held.select("doc_id", "seq", F.col("vertex_id").alias("owner"), "content"), up, figures, co_located, refs)
    return vertices.unionByName(more), edges


def markdown(sections: DataFrame) -> DataFrame:
    """(doc_id, markdown): headings by level and contents, in order."""
    part = F.concat_ws("\n", F.when(F.col("level") > 0, F.concat(F.expr("repeat('#', cast(level as int))"), F.lit(" "), "title")), F.nullif("content", F.lit("")))
    return sections.groupBy("doc_id").agg(F.array_join(F.filter(F.transform(F.array_sort(F.collect_list(F.struct("seq", part.alias("part")))), lambda x: x["part"]), lambda x: x != ""), "\n").alias("markdown"))


# --- trees of typed items -------------------------------------------------------------


def item_tree(items: DataFrame) -> DataFrame:
    """(doc_id, seq, node_id, parent_seq, level, depth, title, page_index, summary, visuals, tables) of a parser's items.

    items has (doc_id, page, pos, type, value, md, level, name, path, bbox). Headings nest by level; the texts after one, to the
    next, are its summary, images its visuals and tables its tables. What stands before the first heading of a document is
    held by a node titled ROOT_TITLE; documents without such items have none.
    """
    order = Window.partitionBy("doc_id").orderBy("page", "pos")
    is_head = F.col("type") == "heading"
    df = items.withColumn("head", F.sum(is_head.cast("long")).over(order)).withColumn("at", F.struct("page", "pos"))
    of = lambda kind, value: F.transform(F.array_sort(F.collect_list(F.when(F.col("type") == kind, F.struct("at", value.alias("v"))))), lambda x: x["v"])
    nodes = df.groupBy("doc_id", "head").agg(
        F.max(F.when(is_head, F.greatest("level", F.lit(1)))).cast("long").alias("level"),
        F.max(F.when(is_head, F.col("value"))).alias("title"),
        F.min("page").alias("page_index"),
        F.array_join(of("text", F.col("value")), "\n").alias("summary"),
        of("image", F.struct(F.col("name").alias("image_id"), "page", "path", "bbox")).cast(VISUALS).alias("visuals"),
        of("table", F.struct("page", F.col("md").alias("markdown_content"))).cast(TABLES).alias("tables"),
    )
    nodes = nodes.withColumn("level", F.coalesce("level", F.lit(1).cast("long"))).withColumn("title", F.coalesce("title", F.lit(ROOT_TITLE)))
    nodes = nodes.withColumn("seq", (F.row_number().over(Window.partitionBy("doc_id").orderBy("head")) - 1).cast("long"))
    return _deep(parented(nodes.drop("head").withColumn("node_id", F.format_string("%04d", "seq"))))


def _deep(nodes: DataFrame) -> DataFrame:
    """Adds depth, how many ancestors a node has: the last node of each smaller level that no later one of a still smaller level cuts off."""
    before = Window.partitionBy("doc_id").orderBy("seq").rowsBetween(Window.unboundedPreceding, -1)
    df = nodes.withColumns({f"_l{k}": F.last(F.when(F.col("level") == k, F.col("seq")), True).over(before) for k in range(1, 6)})
    depth = F.lit(0).cast("long")
    for k in range(1, 6):
        cut = F.greatest(F.lit(-1).cast("long"), F.lit(-1).cast("long"), *(F.col(f"_l{j}") for j in range(1, k)))
        depth = depth + F.coalesce((F.col("level") > k) & (F.col(f"_l{k}") > cut), F.lit(False)).cast("long")
    return df.withColumn("depth", depth).drop(*(f"_l{k}" for k in range(1, 6)))


def item_markdown(tree: DataFrame) -> DataFrame:
    """(doc_id, markdown) of item_tree(): headings by depth, summaries, image tags and tables."""
    tags = F.transform("visuals", lambda v: F.concat(F.lit("!["), v["image_id"], F.lit("]("), F.coalesce(v["path"], F.lit("")), F.lit(")")))
    parts = F.concat(F.array(F.concat(F.expr("repeat('#', cast(depth as int) + 1)"), F.lit(" "), "title"), F.col("summary")), tags, F.transform("tables", lambda t: t["markdown_content"]))
    part = F.array_join(F.filter(parts, lambda x: x != ""), "\n\n")
    return tree.groupBy("doc_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("seq", part.alias("part")))), lambda x: x["part"]), "\n\n").alias("markdown"))


def item_images(tree: DataFrame) -> DataFrame:
    """(doc_id, node_id, path, page, bbox) of the visuals of item_tree(); bbox is the first box."""
    rows = tree.select("doc_id", "seq", F.posexplode("visuals").alias("pos", "v"))
    return rows.select("doc_id", F.col("v.image_id").alias("node_id"), "v.path", "v.page", F.get("v.bbox", F.lit(0)).alias("bbox"))


def item_adjacency(tree: DataFrame, refs: DataFrame | None = None) -> tuple[DataFrame, DataFrame]:
    """Vertices and edges of item_tree(): sections tree_ID, visuals by their ids, tables tbl_ID_N and the formulas of summaries.

    Every kind of them reads the tree, so it is stored once; the files go with the session.
    """
    own = storage.written(tree, "tree").withColumn("vertex_id", F.concat(F.lit("tree_"), "node_id"))
    parents = own.select("doc_id", F.col("seq").alias("parent_seq"), F.col("vertex_id").alias("source"))
    up = own.where("parent_seq is not null").join(parents, ["doc_id", "parent_seq"]).select(*_edge(F.col("source"), F.col("vertex_id")))
    images = own.select("doc_id", "vertex_id", F.explode("visuals").alias("v")).select("doc_id", "vertex_id", F.col("v.image_id").alias("id"), F.col("v.path").alias("path"))
    tables = own.select("doc_id", "vertex_id", "node_id", F.posexplode("tables").alias("pos", "t")).withColumn("id", F.concat(F.lit("tbl_"), "node_id", F.lit("_"), F.col("pos").cast("string")))
    held = own.select("doc_id", "seq", F.col("vertex_id").alias("owner"), F.col("summary").alias("content"))
    more, edges = _graph(held, up, None, None, refs)
    vertices = own.select(*_vertex(F.col("vertex_id"), "section", F.col("title"), F.col("summary"))).unionByName(images.select(*_vertex(F.col("id"), "figure", F.col("id"), F.col("path"))))
    vertices = vertices.unionByName(tables.select(*_vertex(F.col("id"), "text_block", F.col("id"), F.col("t.markdown_content")))).unionByName(more)
    return vertices, edges.unionByName(images.select(*_edge(F.col("vertex_id"), F.col("id")))).unionByName(tables.select(*_edge(F.col("vertex_id"), F.col("id"))))
