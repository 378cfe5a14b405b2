"""Near-duplicate documents: one-permutation MinHash with optimal densification, bands and star edges.

One hash of each shingle gives both its bin and its rank in the bin; an empty bin borrows from the bin
that a hash of (bin, attempt) names, trying on until that one is filled, so every signature is full.
Texts with equal shingle sets are one text from then on, however many copies there are. Each bucket of a
band links its members to one centre (a star), so a bucket of k texts gives k - 1 pairs. Links are confirmed
on the full sets. Members of a bucket that the stars leave in different components are then joined exactly.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from folio.llm.common import bloom, bounded_batches, discard, in_bloom, kept, mix, scratch, shingle_sets, smaller_batches, stored, text_blocks
from folio.llm.components import components

BANDS, ROWS, SHINGLE = 32, 4, 5
BINS = BANDS * ROWS
#: Links are needed at this share of the union, as a fraction.
SIMILAR = (75, 100)
_TRIES = 64
#: Texts of one component and shingle that may meet each other in vain.
HEAVY = 64
#: log2 of the bits of the filters of ids, whose size doesn't depend on the data.
BITS = 26


def _borrow() -> np.ndarray:
    """The bins that an empty bin asks, in order."""
    at, k = np.meshgrid(np.arange(BINS, dtype=np.uint64), np.arange(_TRIES, dtype=np.uint64), indexing="ij")
    return (mix(at * np.uint64(1_000_003) + k * np.uint64(7_919) + np.uint64(12345)) % np.uint64(BINS)).astype(np.int64)


_BORROW = _borrow()


def signature(shingles: np.ndarray) -> np.ndarray:
    """BINS values of 64 bits for a set that isn't empty."""
    scrambled = mix(shingles + np.uint64(0x632BE59BD9B4E019))
    bins = (scrambled >> np.uint64(64 - BINS.bit_length() + 1)).astype(np.int64)
    order = np.argsort(scrambled)  # bins are the leading bits, so this sorts by bin, then rank
    bins = bins[order]
    first = np.flatnonzero(np.concatenate(([True], bins[1:] != bins[:-1])))
    out, full = np.zeros(BINS, np.uint64), np.zeros(BINS, bool)
    out[bins[first]] = scrambled[order[first]]
    full[bins[first]] = True
    if not full.all():
        empty = np.flatnonzero(~full)
        asked = full[_BORROW[empty]]
        found = asked.any(1)
        source = _BORROW[empty, asked.argmax(1)]
        lost = np.flatnonzero(~found)
        source[lost] = np.flatnonzero(full)[(empty[lost] * 31) % full.sum()] if len(lost) else source[lost]
        out[empty] = out[source]
    return out


def band_keys(sig: np.ndarray) -> np.ndarray:
    acc = np.arange(BANDS, dtype=np.uint64) + np.uint64(1)
    for k in range(ROWS):
        acc = mix(acc * np.uint64(0x9FB21C651E98DF25) + sig.reshape(BANDS, ROWS)[:, k])
    return acc.view(np.int64)


_SIGNED = "doc_id long, n_shingles long, h1 long, h2 long, bands array<long>, sketch array<long>"


def _signed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        ids = batch.column("doc_id")
        for row, data, offsets in text_blocks(batch):
            n, h1, h2, bands, sketch = [], [], [], [], []
            for own in shingle_sets(data, offsets, SHINGLE):
                for x, y in zip((n, h1, h2), _known(own), strict=True):
                    x.append(y)
                if len(own):
                    sig = signature(own)
                    bands.append(band_keys(sig))
                    sketch.append((mix(sig) & np.uint64(255)).astype(np.uint8).view(np.int64))
                else:
                    bands.append(None), sketch.append(None)
            yield pa.RecordBatch.from_arrays(
                [ids.slice(row, len(n)).cast(pa.int64()), pa.array(n, pa.int64()), pa.array(h1, pa.int64()), pa.array(h2, pa.int64()), pa.array(bands, pa.list_(pa.int64())), pa.array(sketch, pa.list_(pa.int64()))],
                ["doc_id", "n_shingles", "h1", "h2", "bands", "sketch"],
            )


_SET = "doc_id long, n_shingles long, h1 long, h2 long, own binary"


def _known(own: np.ndarray) -> tuple[int, int, int]:
    """Size and two hashes of a set; a doc_id that repeats stands for the largest of them."""
    return len(own), int(own.sum(dtype=np.uint64).view(np.int64)), int(np.bitwise_xor.reduce(mix(own + np.uint64(77))).view(np.int64))


def _sets(wanted: np.ndarray):
    """The set of each text whose doc_id the filter of wanted ids lets pass."""

    def sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            batch = batch.filter(_perhaps(batch, wanted))
            ids = batch.column("doc_id")
            for row, data, offsets in text_blocks(batch):
                own = list(shingle_sets(data, offsets, SHINGLE))
                told = [_known(x) for x in own]
                yield pa.RecordBatch.from_arrays(
                    [ids.slice(row, len(own)), *(pa.array([x[k] for x in told], pa.int64()) for k in range(3)), pa.array([x.tobytes() for x in own], pa.binary())], ["doc_id", "n_shingles", "h1", "h2", "own"]
                )

    return sets


def _passing(wanted: np.ndarray):
    """The texts whose doc_id the filter of wanted ids lets pass."""

    def passing(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield batch.filter(_perhaps(batch, wanted)).select(["doc_id", "text"])

    return passing


def _exploded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The shingles of the texts whose set is the one that root was given for."""
    for batch in batches:
        of = np.asarray(batch.column("h1"))
        for row, data, offsets in text_blocks(batch):
            own = [x if len(x) and _known(x)[1] == of[row + k] else x[:0] for k, x in enumerate(shingle_sets(data, offsets, SHINGLE))]
            n = np.array([len(x) for x in own])
            at = pa.array(np.repeat(np.arange(len(n)) + row, n))
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id").take(at), batch.column("root").take(at), pa.array(np.repeat(n, n), pa.int64()), pa.array(np.concatenate(own).view(np.int64))], ["doc_id", "root", "n", "shingle"]
            )


def _perhaps(batch: pa.RecordBatch, wanted: np.ndarray) -> pa.Array:
    return pa.array(in_bloom(wanted, np.asarray(batch.column("id_key")).view(np.uint64)))


def _confirmed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        keep = []
        for x, y in zip(batch.column("x_set"), batch.column("y_set"), strict=True):
            x, y = np.frombuffer(x.as_buffer(), np.uint64), np.frombuffer(y.as_buffer(), np.uint64)
            if len(x) > len(y):
                x, y = y, x
            at = np.minimum(np.searchsorted(y, x), len(y) - 1)
            both = int((y[at] == x).sum())
            keep.append(SIMILAR[1] * both >= SIMILAR[0] * (len(x) + len(y) - both))
        yield pa.RecordBatch.from_arrays([batch.column("a"), batch.column("b"), pa.array(keep, pa.bool_())], ["a", "b", "linked"])


def _alike(left, right):
    """In how many of the bins the sketches agree: their bytes are compared eight at a time."""
    same = F.lit(BINS)
    for i in range(BINS // 8):
        x = left[i].bitwiseXOR(right[i])
        for by in (4, 2, 1):
            x = x.bitwiseOR(F.shiftrightunsigned(x, by))
        same = same - F.bit_count(x.bitwiseAND(F.lit(0x0101010101010101)))
    return same


def _may_link(x, y):
    """False only for pairs that cannot be linked: by their sizes, or five standard deviations of the estimate below the limit."""
    least, most = F.least(x["n"], y["n"]), F.greatest(x["n"], y["n"])
    share = SIMILAR[0] / SIMILAR[1]
    floor = BINS * (F.lit(share) - 5 * F.sqrt(F.lit(share * (1 - share)) / F.least(least, F.lit(BINS))))
    return (SIMILAR[1] * least >= SIMILAR[0] * most) & (_alike(x["sketch"], y["sketch"]) >= floor)


def near_duplicates(docs: DataFrame) -> DataFrame:
    """doc_id, n_shingles, component_id and kept of every document.

    Texts are linked when 100 * |intersection| >= 75 * |union| of their sets of five-word shingles
    (lower-cased A-Z); a text of one to four words is one shingle; a text without words, null or empty, has
    no set, is linked with nothing and is kept. Equal sets are linked at any size. Rows that repeat a doc_id
    give a row each, in one component; others are linked with them through the largest of their sets. Rows of null
    doc_id give a row each, of null component_id, are linked with nothing and are kept. No rows give no rows. Only doc_id (cast to long) and text are read.
    """
    spark = docs.sparkSession
    bounded_batches(spark)
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    with scratch(spark):
        signed = stored(docs.mapInArrow(_signed, _SIGNED), "signed")
        filled = signed.where("n_shingles > 0 and doc_id is not null")
        texts = stored(filled.groupBy("n_shingles", "h1", "h2").agg(F.min("doc_id").alias("rep")), "texts")
        reps = filled.join(texts.select(F.col("rep").alias("doc_id")).distinct(), "doc_id", "left_semi")
        reps = reps.groupBy("doc_id").agg(F.max(F.struct("n_shingles", "h1", "h2", "bands", "sketch")).alias("at")).select("doc_id", "at.*")
        roots = components(_links(docs.select("doc_id", "text", F.xxhash64("doc_id").alias("id_key")), reps))
        at = texts.join(roots, texts["rep"] == roots["node"], "left").select("n_shingles", "h1", "h2", F.coalesce("root", "rep").alias("root"))
        own = signed.drop("bands", "sketch").join(at, ["n_shingles", "h1", "h2"], "left")
        out = own.select("doc_id", "n_shingles", F.when(F.col("doc_id").isNotNull(), F.coalesce("root", "doc_id")).alias("component_id"), F.coalesce(F.col("root") == F.col("doc_id"), F.lit(True)).alias("kept"))
        return kept(stored(out, "components"))


def _buckets(reps: DataFrame) -> DataFrame:
    """(key, doc_id, n, h1, sketch, score) of the buckets with two texts or more; score counts a text's meetings with others."""
    rows = reps.select(F.explode("bands").alias("key"), "doc_id")
    full = rows.groupBy("key").agg(F.count("*").alias("met")).where("met > 1")
    rows = stored(rows.join(full, "key"), "met")
    known = reps.select("doc_id", F.col("n_shingles").alias("n"), "h1", "sketch")
    return rows.drop("met").join(rows.groupBy("doc_id").agg(F.sum("met").alias("score")).join(known, "doc_id"), "doc_id")


def _links(docs: DataFrame, reps: DataFrame) -> DataFrame:
    """Edges (a, b) that connect the texts as all confirmed links between members of a bucket do.

    Each bucket is a star around the text that meets the most others. Members that the confirmed links leave
    in different components of one bucket are then compared exactly, by the rare shingles that any linked
    pair must share, so that neither a star's centre nor the estimate that spares a star's hopeless pairs hides a link.
    """
    buckets = stored(_buckets(reps), "buckets")
    centre = buckets.groupBy("key").agg(F.max_by("doc_id", F.struct("score", (-F.col("doc_id")).alias("last"))).alias("doc_id"))
    x, y = buckets.join(centre, ["key", "doc_id"]).alias("x"), buckets.alias("y")
    near = _may_link({c: F.col(f"x.{c}") for c in buckets.columns}, {c: F.col(f"y.{c}") for c in buckets.columns})
    stars = x.join(y, (F.col("x.key") == F.col("y.key")) & (F.col("x.doc_id") != F.col("y.doc_id")) & near)
    links = _verified(docs, stored(stars.select(F.greatest("x.doc_id", "y.doc_id").alias("a"), F.least("x.doc_id", "y.doc_id").alias("b")).distinct(), "pairs"))
    at = buckets.select("key", "doc_id", "h1").join(components(links), F.col("doc_id") == F.col("node"), "left").select("key", "doc_id", "h1", F.coalesce("root", "doc_id").alias("root"))
    at = stored(at, "placed")
    discard(buckets)
    mixed = at.groupBy("key").agg(F.min("root").alias("lo"), F.max("root").alias("hi")).where("lo <> hi").select("key")
    rest = stored(at.join(mixed, "key").select("doc_id", "h1", "root").distinct(), "rest")
    return links.unionByName(_verified(docs, stored(_sharing_rare(docs, rest), "pairs")))


def _sharing_rare(docs: DataFrame, rest: DataFrame) -> DataFrame:
    """Pairs (a, b) of different roots that may be linked, by prefix and position filters.

    In the order of rising frequency (then hash), linked sets with |y| <= |x| share a shingle among the first
    |y| - ceil(6/7 |y|) + 1 of y and the first |x| - ceil(3/4 |x|) + 1 of x, and what follows the first shared
    one must hold the ceil(3/7 (|x| + |y|)) shingles that the link needs. The texts of one root would meet in vain:
    roots with more than HEAVY texts of a shingle meet only those of other roots, so that no row meets more than
    HEAVY others in vain, however large a component is.
    """
    ids = bloom(rest.select(F.xxhash64("doc_id").alias("key")), BITS)
    each = docs.mapInArrow(_passing(ids), "doc_id long, text string").join(rest, "doc_id").select("doc_id", "text", "root", "h1")
    each = stored(each.mapInArrow(_exploded, "doc_id long, root long, n long, shingle long"), "shingles")
    shared = each.groupBy("shingle").agg(F.count("*").alias("df")).where("df > 1")
    own = Window.partitionBy("doc_id")
    ranked = each.join(shared, "shingle").withColumn("place", F.dense_rank().over(own.orderBy("df", "shingle")))
    ranked = ranked.select("doc_id", "root", "n", "shingle", (F.col("n") - F.max("place").over(own) + F.col("place") - 1).alias("at"))
    probes = stored(ranked.where("at < n - ceil(3 * n / 4) + 1"), "prefixes")
    discard(each)
    roots = probes.groupBy("shingle", "root").agg(F.count("*").alias("members"))
    several = roots.groupBy("shingle").agg(F.min("root").alias("first"), F.max("root").alias("last")).where("first <> last").select("shingle")
    heavy = stored(roots.where(F.col("members") > HEAVY).join(several, "shingle").select("shingle", "root"), "heavy")
    marked = probes.join(several, "shingle").join(heavy.withColumn("is_heavy", F.lit(True)), ["shingle", "root"], "left").join(heavy.select("shingle").distinct().withColumn("beside", F.lit(True)), "shingle", "left")
    marked = stored(marked, "probes")
    # light roots meet in place 0, heavy ones (x) light ones (y) in place 1, light ones heavy ones in place 2; heavy ones meet by pairs of roots
    places = lambda own, met: F.explode(F.when(F.col("is_heavy"), F.array(F.lit(own))).when(F.col("beside"), F.array(F.lit(0), F.lit(met))).otherwise(F.array(F.lit(0))))
    small = marked.where("at < n - ceil(6 * n / 7) + 1")
    own = ["shingle", "root", "doc_id", "n", "at"]
    x, y = marked.select(*own, places(1, 2).alias("place")).alias("x"), small.select(*own, places(2, 1).alias("place")).alias("y")
    fits = F.expr("(y.n < x.n or y.n = x.n and y.doc_id < x.doc_id) and 4 * y.n >= 3 * x.n and 7 * least(x.n - x.at, y.n - y.at) >= 3 * (x.n + y.n)")
    pair = [F.greatest("x.doc_id", "y.doc_id").alias("a"), F.least("x.doc_id", "y.doc_id").alias("b")]
    met = x.join(y, F.expr("x.shingle = y.shingle and x.place = y.place and x.root <> y.root") & fits).select(*pair)
    both = heavy.alias("r").join(heavy.alias("s"), F.expr("r.shingle = s.shingle and r.root <> s.root")).select("r.shingle", F.col("r.root").alias("x_root"), F.col("s.root").alias("y_root")).alias("m")
    x, y = marked.where("is_heavy").alias("x"), small.where("is_heavy").alias("y")
    more = x.join(both, F.expr("x.shingle = m.shingle and x.root = m.x_root")).join(y, F.expr("m.shingle = y.shingle and m.y_root = y.root") & fits).select(*pair)
    return met.unionByName(more).distinct()


def _verified(docs: DataFrame, pairs: DataFrame) -> DataFrame:
    """Those of the pairs (a, b) that the full sets link."""
    ends = pairs.select(F.col("a").alias("doc_id")).union(pairs.select(F.col("b").alias("doc_id")))
    wanted = bloom(ends.select(F.xxhash64("doc_id").alias("key")), BITS)
    each = docs.mapInArrow(_sets(wanted), _SET).join(ends.distinct(), "doc_id", "left_semi")
    sets = stored(each.groupBy("doc_id").agg(F.max(F.struct("n_shingles", "h1", "h2", "own")).alias("at")).select("doc_id", "at.own"), "sets")
    with smaller_batches(docs.sparkSession, 64):  # two sets a row
        left = pairs.join(sets.select(F.col("doc_id").alias("a"), F.col("own").alias("x_set")), "a")
        both = left.join(sets.select(F.col("doc_id").alias("b"), F.col("own").alias("y_set")), "b")
        out = stored(both.select("a", "b", "x_set", "y_set").mapInArrow(_confirmed, "a long, b long, linked boolean").where("linked").select("a", "b"), "links")
    discard(sets)
    return out
