"""Section outlines of paged lines: pages, headings, parents, contents, page ranges and their prints."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from folio import storage
from folio.functions.text import HEADING, NO_CAPTION, PAGE_TAG, normalized_label, stripped

ROOT_TITLE = "Document Header / Introduction"


def _tagged(lines: DataFrame) -> DataFrame:
    """Lines with their tag (empty if none), its number and the page of the last tag before them (1 at first)."""
    order = Window.partitionBy("doc_id").orderBy("line_no")
    rows = lines.withColumn("tag", F.regexp_extract("line", PAGE_TAG, 1)).withColumn("own", F.expr("try_cast(nullif(tag, '') AS long)"))
    return rows.withColumn("page", F.coalesce(F.last("own", True).over(order), F.lit(1).cast("long")))


def carried(lines: DataFrame) -> DataFrame:
    """Lines with the page of the last tag before them (1 at first); lines with a tag go."""
    return _tagged(lines).where("tag = ''").drop("tag", "own")


def sectioned(lines: DataFrame) -> DataFrame:
    """Carried lines with level (0: no heading), title and seq, the heading each belongs to in document order."""
    level = F.length(F.regexp_extract("line", HEADING, 1)).cast("long")
    order = Window.partitionBy("doc_id").orderBy("line_no")
    return lines.withColumn("level", level).withColumn("title", stripped(F.regexp_extract("line", HEADING, 2))).withColumn("seq", F.sum((F.col("level") > 0).cast("long")).over(order))


def nodes(lines: DataFrame) -> DataFrame:
    """(doc_id, seq, node_id, level, title, page_start, page_end0, content) of each section, the root among them.

    page_end0 is the last page seen in a section, markers included; only the root's is used. Lines are put into their sections
    by one order of the document's lines, tags among them, and each section is made from its own lines: nothing is joined, and
    lines that come by doc_id aren't shuffled.
    """
    order = Window.partitionBy("doc_id").orderBy("line_no")
    level = F.when(F.col("tag") == "", F.length(F.regexp_extract("line", HEADING, 1))).otherwise(F.lit(0)).cast("long")
    rows = _tagged(lines).withColumn("level", level)
    rows = rows.withColumn("seq", F.sum((F.col("level") > 0).cast("long")).over(order)).withColumn("first", F.row_number().over(order) == 1)
    # A document that begins with a heading has no line of the root, so its first line stands for the root too.
    rows = rows.withColumn("seq", F.explode(F.when(F.col("first") & (F.col("level") > 0), F.array(F.lit(0).cast("long"), "seq")).otherwise(F.array("seq"))))
    head, root = (F.col("level") > 0) & (F.col("seq") > 0), F.col("seq") == 0
    text = F.when((F.col("tag") == "") & (F.col("level") == 0) & F.col("line").rlike(r"(?U)\S"), F.struct("line_no", "line"))
    made = rows.groupBy("doc_id", "seq").agg(
        *(F.max(F.when(head, x)).alias(name) for name, x in (("level", F.col("level")), ("title", stripped(F.regexp_extract("line", HEADING, 2))), ("page", F.col("page")))),
        F.max_by("own", F.when(F.col("own").isNotNull(), F.col("line_no"))).alias("last"),
        F.array_join(F.transform(F.array_sort(F.collect_list(text)), lambda x: x["line"]), "\n").alias("content"),
    )
    one = F.lit(1).cast("long")
    return made.select(
        "doc_id", "seq", F.format_string("%04d", "seq").alias("node_id"), F.coalesce("level", F.lit(0).cast("long")).alias("level"), F.when(root, F.lit(ROOT_TITLE)).otherwise(F.col("title")).alias("title"),
        F.when(root, one).otherwise(F.col("page")).alias("page_start"), F.when(root, F.coalesce("last", one)).otherwise(F.col("page")).alias("page_end0"), "content",
    )


def parented(sections: DataFrame) -> DataFrame:
    """Adds parent_seq (null for the root): the last section before of a smaller level, by one window for each level."""
    before = Window.partitionBy("doc_id").orderBy("seq").rowsBetween(Window.unboundedPreceding, -1)
    last = [F.last(F.when(F.col("level") == k, F.col("seq")), True).over(before) for k in range(6)]
    df = sections.withColumns({f"_p{k}": x for k, x in enumerate(last)})
    parent = F.greatest(*(F.when(F.col("level") > k, F.col(f"_p{k}")) for k in range(6)))
    return df.withColumn("parent_seq", parent).drop(*(f"_p{k}" for k in range(6)))


def ranged(sections: DataFrame, tail_policy: str = "reference") -> DataFrame:
    """Adds page_end and depth: a section ends where its next sibling starts, a last child where its parent ends.

    The latest section of each level before a section holds its ancestors, those that no later section of a smaller level
    cuts off, so ends pass down from the root within one window, without joins; pages may run backwards.
    tail_policy "extend" lets the root end on the last page of all instead of the last one before the first heading.
    """
    doc, after = Window.partitionBy("doc_id"), Window.partitionBy("doc_id", "parent_seq").orderBy("seq")
    before = doc.orderBy("seq").rowsBetween(Window.unboundedPreceding, -1)
    root_end = F.max(F.when(F.col("seq") == 0, F.col("page_end0"))).over(doc) if tail_policy == "reference" else F.max("page_start").over(doc)
    df = sections.withColumn("_next", F.lead("page_start").over(after)).withColumn("_end", root_end)
    df = df.withColumns({f"_l{k}": F.last(F.when(F.col("level") == k, F.struct("seq", "page_start", F.col("_next").alias("next"))), True).over(before) for k in range(1, 6)})
    depth = (F.col("level") > 0).cast("int")
    for k in range(1, 6):
        up = F.col(f"_l{k}")
        is_up = (F.col("level") > k) & up.isNotNull() & (up["seq"] > F.greatest(F.lit(0), F.lit(0), *(F.col(f"_l{j}")["seq"] for j in range(1, k))))
        is_up = F.coalesce(is_up, F.lit(False))
        depth = depth + is_up.cast("int")
        df = df.withColumn("_end", F.when(is_up, F.greatest(up["page_start"], F.coalesce(up["next"], F.col("_end")))).otherwise(F.col("_end")))
    end = F.when(F.col("seq") == 0, F.col("_end")).otherwise(F.greatest("page_start", F.coalesce("_next", "_end")))
    return df.withColumn("page_end", end).withColumn("depth", depth).drop("_next", "_end", "page_end0", *(f"_l{k}" for k in range(1, 6)))


def outline(lines: DataFrame, tail_policy: str = "reference") -> DataFrame:
    return ranged(parented(nodes(lines)), tail_policy)


def printed(sections: DataFrame) -> DataFrame:
    """(doc_id, outline): the sections, indented, in one text."""
    indent = F.expr("repeat('  ', depth)")
    line = F.concat(indent, F.when(F.col("depth") > 0, F.lit("└─ ")).otherwise(F.lit("")), F.lit("["), "node_id", F.lit("] "), "title", F.lit("  (p."), F.col("page_start").cast("string"), F.lit(")"))
    return sections.groupBy("doc_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("seq", line.alias("line")))), lambda x: x["line"]), "\n").alias("outline"))


def totals(sections: DataFrame) -> DataFrame:
    """(doc_id, sections, total_pages)."""
    return sections.groupBy("doc_id").agg(F.count("*").alias("sections"), F.greatest(F.lit(1).cast("long"), F.max("page_end"), F.max("page_start")).alias("total_pages"))


def nested(sections: DataFrame, images: DataFrame | None = None) -> DataFrame:
    """(doc_id, tree): the outline as JSON, sections nested in "nodes" lists.

    Sections come in preorder, so each is written with what opens it and, after it, as many ends as the next one is less
    deep. images has the images of sections: (doc_id, seq, page, img_pos, b64, caption, label).
    """
    rows = sections
    if images is not None:
        each = F.transform(F.array_sort(F.collect_list(F.struct("page", "img_pos", "b64", "caption", "label"))), lambda x: x)
        rows = rows.join(images.groupBy("doc_id", "seq").agg(each.alias("_images")), ["doc_id", "seq"], "left")
    else:
        rows = rows.withColumn("_images", F.lit(None).cast("array<struct<page:bigint,img_pos:bigint,b64:string,caption:string,label:string>>"))
    of = lambda c: F.coalesce(F.transform("_images", lambda x: x[c]), F.array().cast("array<string>"))
    node = F.to_json(F.struct("node_id", "title", "page_start", "page_end", "content", of("b64").alias("base64_images"), of("caption").alias("image_captions"), of("label").alias("image_labels")))
    order = Window.partitionBy("doc_id").orderBy("seq")
    less = F.col("depth") - F.coalesce(F.lead("depth").over(order), F.lit(0))
    rows = rows.withColumn("_less", F.when(F.lead("depth").over(order).isNull(), F.col("depth") + 1).otherwise(less + 1))
    comma = F.when(F.coalesce(F.lag("depth").over(order), F.lit(-1)) >= F.col("depth"), F.lit(",")).otherwise(F.lit(""))
    text = F.concat(comma, F.expr("substr(_node, 1, length(_node) - 1)"), F.lit(',"nodes":['), F.expr("repeat(']}', cast(_less as int))"))
    rows = rows.withColumn("_node", node).withColumn("_text", text)
    joined = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("seq", "_text"))), lambda x: x["_text"]), "")
    return rows.groupBy("doc_id").agg(F.concat(F.lit("["), joined, F.lit("]")).alias("tree"))


NODE = "node_id STRING, title STRING, page_start BIGINT, page_end BIGINT, content STRING, base64_images ARRAY<STRING>, image_captions ARRAY<STRING>, image_labels ARRAY<STRING>, nodes ARRAY<STRING>"


def unnested(trees: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Sections and images of trees (doc_id, tree) as nested() writes them, however deep; a tree may also be one node without a list.

    Sections are (doc_id, seq, node_id, level, title, content, parent_seq, page_start, page_end, depth), numbered in preorder; a tree knows no
    levels of headings, so level is depth. Images are (doc_id, page, img_pos, seq, b64, b64_len, caption, label, normalized_label): each counts for the
    first page of its section, in the order of the sections. One step a level of the trees, each written to the shared folder. A null
    tree, and one that isn't JSON, has no sections; of nodes that lack a field its default is taken.
    """
    spark = trees.sparkSession
    listed = F.when(F.ltrim("tree").startswith("["), F.from_json("tree", "ARRAY<STRING>")).otherwise(F.array("tree"))
    front = trees.select("doc_id", F.posexplode(listed).alias("pos", "json")).select("doc_id", F.array("pos").alias("path"), "json")
    levels = []
    while True:
        told = front.select("doc_id", "path", F.from_json("json", NODE).alias("n")).where("n.node_id is not null or n.title is not null or n.nodes is not null")
        levels.append(storage.written(told.select("doc_id", "path", "n.*"), "level"))
        front = levels[-1].select("doc_id", "path", F.posexplode("nodes").alias("pos", "json")).select("doc_id", F.concat("path", F.array("pos")).alias("path"), "json").where("json is not null")
        if front.isEmpty():
            break
    rows = spark.createDataFrame([], levels[0].schema)
    for level in levels:
        rows = rows.unionByName(level)
    order = Window.partitionBy("doc_id").orderBy("path")  # a path comes before those that go on from it
    rows = storage.written(rows.withColumn("seq", (F.row_number().over(order) - 1).cast("long")), "nodes")
    up = rows.select("doc_id", F.col("path").alias("above"), F.col("seq").alias("parent_seq"))
    depth = F.size("path") - 1
    own = rows.withColumn("above", F.slice("path", 1, F.greatest(F.lit(0), depth))).join(up, ["doc_id", "above"], "left")
    start = F.coalesce("page_start", F.lit(1).cast("long"))
    sections = own.select(
        "doc_id", "seq", F.coalesce("node_id", F.format_string("%04d", "seq")).alias("node_id"), depth.cast("long").alias("level"), F.coalesce("title", F.lit("")).alias("title"), F.coalesce("content", F.lit("")).alias("content"),
        "parent_seq", start.alias("page_start"), F.coalesce("page_end", start).alias("page_end"), depth.cast("int").alias("depth"),
    )
    at = lambda c: F.get(c, F.col("k"))
    held = rows.select("doc_id", "seq", start.alias("page"), "image_captions", "image_labels", F.posexplode("base64_images").alias("k", "b64")).where("b64 is not null")
    place = F.row_number().over(Window.partitionBy("doc_id", "page").orderBy("seq", "k")) - 1
    pictures = held.select("doc_id", "page", place.cast("long").alias("img_pos"), "seq", "b64", F.length("b64").cast("long").alias("b64_len"), F.coalesce(at("image_captions"), F.lit(NO_CAPTION)).alias("caption"), F.coalesce(at("image_labels"), F.lit("")).alias("label"))
    pictures = pictures.withColumn("normalized_label", normalized_label(F.col("label")))
    return sections, pictures
