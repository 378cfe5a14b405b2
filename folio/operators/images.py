"""Images of sections: margins, claims by page range, gallery, zones."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from folio.functions.text import NO_CAPTION, collapsed

LEAST_B64 = 5000


#: Pages that share a bucket when page ranges meet pages.
BUCKET = 64


def in_ranges(sections: DataFrame, pages: DataFrame) -> DataFrame:
    """(doc_id, seq, page): the given pages (doc_id, page) that the page ranges of sections hold.

    Ranges meet pages by buckets of pages. Ranges of many buckets would make many rows, so a range has one for each bucket
    in which its document has a page, found from the document's own list of buckets.
    """
    known = pages.select("doc_id", "page").distinct().withColumn("bucket", F.floor(F.col("page") / BUCKET))
    buckets = known.groupBy("doc_id").agg(F.collect_set("bucket").alias("buckets"))
    held = sections.where("page_start <= page_end").select("doc_id", "seq", "page_start", "page_end").join(buckets, "doc_id")
    held = held.withColumn("bucket", F.explode(F.filter("buckets", lambda b: (b >= F.floor(F.col("page_start") / BUCKET)) & (b <= F.floor(F.col("page_end") / BUCKET)))))
    return held.join(known, ["doc_id", "bucket"]).where(F.col("page").between(F.col("page_start"), F.col("page_end"))).select("doc_id", "seq", "page")


def claimed(sections: DataFrame, images: DataFrame) -> DataFrame:
    """(doc_id, page, img_pos, seq): a page's large images belong to the first section whose pages hold it."""
    large = images.where(F.col("b64_len") >= LEAST_B64).select("doc_id", "page", "img_pos")
    owner = in_ranges(sections, large).groupBy("doc_id", "page").agg(F.min("seq").alias("seq"))
    return large.join(owner, ["doc_id", "page"])


def gallery(claims: DataFrame, images: DataFrame, sections: DataFrame) -> DataFrame:
    """Claimed images in page order, each payload once per document; equal payloads are told by their md5, and payloads are joined last."""
    key = ["doc_id", "page", "img_pos"]
    rows = claims.join(images.select(*key, F.md5("b64").alias("sum")), key)
    first = rows.groupBy("doc_id", "sum").agg(F.min(F.struct("seq", "page", "img_pos")).alias("at")).select("doc_id", "at.*")
    titled = first.join(sections.select("doc_id", "seq", "title", "page_start"), ["doc_id", "seq"])
    return titled.join(images.select(*key, "b64"), key).select("doc_id", "seq", "title", "page_start", "page", "img_pos", "b64")


def first_image(gallery: DataFrame) -> DataFrame:
    """(doc_id, seq, title, page, img_pos, b64): the first image of the first section that has one."""
    return gallery.groupBy("doc_id").agg(F.min_by(F.struct("seq", "title", "page", "img_pos", "b64"), F.struct("seq", "page", "img_pos")).alias("at")).select("doc_id", "at.*")


def from_placements(placements: DataFrame) -> DataFrame:
    """(doc_id, page, img_idx, ext, b64, b64_len) of images (doc_id, page, img_idx, ext, content, y0, y1, height) within the margins."""
    b64 = F.regexp_replace(F.base64("content"), "[\r\n]", "")
    return within_margins(placements.where("y0 is not null")).select("doc_id", "page", "img_idx", "ext", b64.alias("b64"), F.length(b64).cast("long").alias("b64_len"))


def by_page(images: DataFrame) -> DataFrame:
    """images with img_pos, their place on the page by img_idx."""
    return images.withColumn("img_pos", (F.row_number().over(Window.partitionBy("doc_id", "page").orderBy("img_idx")) - 1).cast("long"))


def within_margins(placements: DataFrame, top: float = 70, bottom: float = 70) -> DataFrame:
    return placements.where((F.col("y0") >= top) & (F.col("y1") <= F.col("height") - bottom))


#: Tiles to each side of the box in which a page's images seek their captions.
TILES = 16


def _tiled(rows: DataFrame, box: DataFrame, x: tuple, y: tuple) -> DataFrame:
    """rows, once for each tile (tx, ty) of their page's box that the rectangle x, y touches."""

    def tiles(low, high, least, most):
        place = lambda v: F.least(F.lit(TILES - 1), F.greatest(F.lit(0), F.floor((v - F.col(least)) / F.col("side")).cast("int")))
        inside = (F.greatest(low, high) >= F.col(least)) & (F.least(low, high) <= F.col(most))
        return F.when(inside, F.sequence(place(F.least(low, high)), place(F.greatest(low, high))))

    met = rows.join(box, ["doc_id", "page"])
    met = met.withColumn("_tx", tiles(*x, "bx0", "bx1")).withColumn("_ty", tiles(*y, "by0", "by1"))
    return met.withColumn("tx", F.explode("_tx")).withColumn("ty", F.explode("_ty")).drop("_tx", "_ty")


def zone_captions(images: DataFrame, spans: DataFrame) -> DataFrame:
    """(doc_id, page, img_pos, caption): text in the zone below an image, else in one of its height above it.

    Images and spans meet by tiles of the box around their page's zones, each pair in the one tile where their common part begins,
    so a page of many spans isn't compared span by span with all its images.
    """
    zone_x, zone_y = (F.col("x0") - 20, F.col("x1") + 20), (F.col("y0") - 50, F.col("y1") + 50)
    low = lambda a, b: F.min(F.least(a, b))
    high = lambda a, b: F.max(F.greatest(a, b))
    box = images.groupBy("doc_id", "page").agg(low(*zone_x).alias("bx0"), high(*zone_x).alias("bx1"), low(*zone_y).alias("by0"), high(*zone_y).alias("by1"))
    box = box.withColumn("side", F.greatest(F.lit(1.0), F.col("bx1") - F.col("bx0"), F.col("by1") - F.col("by0")) / TILES)
    names = ["x0", "x1", "y0", "y1"]
    i = _tiled(images.select("doc_id", "page", "img_pos", *names), box, zone_x, zone_y)
    s = _tiled(spans.select("doc_id", "page", *names, "text"), box, (F.col("x0"), F.col("x1")), (F.col("y0"), F.col("y1"))).select("doc_id", "page", "tx", "ty", "text", *(F.col(c).alias(f"s{c}") for c in names))
    beside = F.expr("sx0 < x1 + 20 and sx1 > x0 - 20")
    below, above = F.expr("sy0 < y1 + 50 and sy1 > y1"), F.expr("sy0 < y0 and sy1 > y0 - 50")
    place = lambda v, least: F.least(F.lit(TILES - 1), F.greatest(F.lit(0), F.floor((v - F.col(least)) / F.col("side")).cast("int")))
    once = (F.col("tx") == place(F.greatest("sx0", F.col("x0") - 20), "bx0")) & (F.col("ty") == place(F.greatest("sy0", F.col("y0") - 50), "by0"))
    met = i.join(s, ["doc_id", "page", "tx", "ty"]).where(once & beside & (below | above)).select("doc_id", "page", "img_pos", below.alias("below"), F.col("sy0").alias("y0"), F.col("sx0").alias("x0"), "text")
    text = lambda side: collapsed(F.array_join(F.transform(F.array_sort(F.collect_list(F.when(side, F.struct("y0", "x0", "text")))), lambda x: x["text"]), " "))
    found = met.groupBy("doc_id", "page", "img_pos").agg(text(F.col("below")).alias("low"), text(~F.col("below")).alias("high"))
    return images.select("doc_id", "page", "img_pos").join(found, ["doc_id", "page", "img_pos"], "left").select("doc_id", "page", "img_pos", F.coalesce(F.nullif("low", F.lit("")), F.nullif("high", F.lit("")), F.lit(NO_CAPTION)).alias("caption"))
