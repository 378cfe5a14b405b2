"""Hard negatives by a Voronoi-partition distributed nearest-neighbour join on integer vectors.

Scores are inner products. With M the greatest norm, a vector x becomes (x, sqrt(M * M - |x|^2)) and an anchor (a, 0): then
|a - x|^2 = |a|^2 + M * M - 2 a.x, so high scores are short distances. Each vector belongs to the cell of its nearest pivot and
knows its distance from it. Anchors of neighbouring cells form groups of about GROUP. An anchor's radius bounds how far what it
seeks can lie; for each cell, the radii and pivot distances of a group's anchors bound the distances from the pivot at which
vectors can serve any of them (triangle inequality), and only vectors within go to the group. There they are dealt to slices,
so that no task holds more than one group's anchors and about SLICE vectors; each slice is joined exactly and the best of all
slices win.

The join runs twice: for each anchor's best vectors of its own label, whose radius comes from the nearest few vectors of that
label in each cell, and for the best vectors of other labels with scores from low to high percent of a positive's, whose radius
comes from the positives' scores. Where distances hardly differ, as between random directions of many dimensions, the
bounds prune little, and the work is that of all anchors against all vectors.

Rows with a null id, label or vector, or with a null component, take no part, nor do vectors whose squared length is 2^53 or
more, beyond which scores aren't exact. Vectors of different lengths meet as if zeros followed. Rows that repeat an id are
rows of their own; of equal scores the smaller id comes first. Empty tables give no rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from folio.llm.common import bounded_batches, kept, scratch, stored

#: Pivots, and the rows of the bounded sample from which they are chosen.
PIVOTS, SAMPLE = 64, 1024
#: Anchors that are joined together, at most about; no more than GROUPS groups are made, so that their bounds stay small.
GROUP, GROUPS = 16384, 4096
#: Vectors of a slice, at most about, and slices of a group at least, where there are so many rows.
SLICE, SLICES = 32768, 32
#: Scores that are computed at once, and anchors, at most.
CELLS, ROWS = 1 << 21, 256
#: Ways over which the anchors of a label are spread.
SALTS = 16

RESULT = "anchor_id long, positive_id long, rank int, negative_id long, positive_score long, negative_score long"
_VECTORS = "uid long, id long, label long, cell int, far double, vector binary"
_ANCHORS = "uid long, id long, label long, cell int, radius double, vector binary"


class _Space:
    """What all tasks know: the pivots, the greatest norm and how vectors are packed. A few dozen KB."""

    def __init__(self, pivots: np.ndarray, square: float, most: int) -> None:
        self.pivots, self.square, self.dims = pivots.astype(float), square, pivots.shape[1]
        self.kind = next(k for k in (np.int8, np.int16, np.int32, np.int64) if most <= np.iinfo(k).max)
        self.exact = np.float32 if square < 1 << 24 else np.float64  # no partial sum of a product is longer
        self.tall = np.sqrt(np.maximum(square - (self.pivots**2).sum(1), 0))
        self.slack = 1e-5 * np.sqrt(square) + 1e-9

    def unpacked(self, column: pa.ChunkedArray | pa.Array) -> np.ndarray:
        if isinstance(column, pa.ChunkedArray):
            column = column.combine_chunks()
        n = len(column)
        if not n or not self.dims:
            return np.zeros((n, self.dims), self.exact)
        raw = np.frombuffer(column.buffers()[2], np.uint8)
        first = np.frombuffer(column.buffers()[1], np.int32, n + 1, 4 * column.offset)
        return raw[first[0] : first[-1]].view(self.kind).reshape(n, self.dims).astype(self.exact)

    def from_pivots(self, x: np.ndarray, anchors: bool) -> np.ndarray:
        """Distances of rows of x from all pivots, as anchors or as vectors that are sought."""
        x = x.astype(float)
        own = (x**2).sum(1)
        product = x @ self.pivots.T
        if not anchors:
            product += np.sqrt(np.maximum(self.square - own, 0))[:, None] * self.tall
            own = np.full(len(x), self.square)
        return np.sqrt(np.maximum(own[:, None] + self.square - 2 * product, 0))


def _matrix(column: pa.Array, dims: int) -> np.ndarray:
    """Lists of integers as rows, zeros where a list is shorter."""
    sizes = np.diff(np.asarray(column.offsets))
    out = np.zeros((len(column), dims), np.int64)
    out[np.arange(dims) < sizes[:, None]] = np.asarray(column.flatten())
    return out


def _pivots(sample: np.ndarray, most: int) -> np.ndarray:
    """Rows of the sample, each as far as can be from those before it."""
    chosen, far = [0], ((sample - sample[0]).astype(float) ** 2).sum(1)
    while len(chosen) < most and far.max() > 0:
        chosen.append(int(far.argmax()))
        far = np.minimum(far, ((sample - sample[chosen[-1]]).astype(float) ** 2).sum(1))
    return sample[chosen]


def _placed(space: _Space):
    """(id, label, vector as a list) become vectors with a number of their own, their cell and the distance from its pivot."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        uid = TaskContext.get().partitionId() << 40
        for batch in batches:
            x = _matrix(batch.column("vector"), space.dims)
            far = space.from_pivots(x, False)
            cell = far.argmin(1)
            packed = pa.array([r.tobytes() for r in x.astype(space.kind)], pa.binary())
            columns = [pa.array(np.arange(uid, uid + len(x))), batch.column("id"), batch.column("label"), pa.array(cell.astype(np.int32)), pa.array(far[np.arange(len(x)), cell]), packed]
            uid += len(x)
            yield pa.RecordBatch.from_arrays(columns, names=[f.split()[0] for f in _VECTORS.split(", ")])

    return run


def _own_radius(space: _Space, seek: int):
    """Anchors with near, the distances from their pivots of the nearest few of their label by cell, get a radius that holds seek others of the label."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            near = batch.column("near")
            offsets = np.asarray(near.offsets)
            cells, fars = (np.asarray(near.values.field(k)) for k in ("cell", "far"))
            apart = space.from_pivots(space.unpacked(batch.column("vector")), True)
            radius = np.empty(len(apart))
            for k, (a, b) in enumerate(zip(offsets[:-1], offsets[1:], strict=True)):
                reach = np.sort(apart[k, cells[a:b]] + fars[a:b])
                radius[k] = reach[min(seek, len(reach) - 1)]  # one of them may be the anchor itself
            cell = apart.argmin(1).astype(np.int32)
            yield pa.RecordBatch.from_arrays([batch.column("uid"), batch.column("id"), batch.column("label"), pa.array(cell), pa.array(radius), batch.column("vector")], names=[f.split()[0] for f in _ANCHORS.split(", ")])

    return run


def _range_radius(space: _Space, low: int):
    """Anchors with the scores of their positives get the radius of low percent of the least of them."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = space.unpacked(batch.column("vector")).astype(float)
            least = np.array([low * min(s) / 100 for s in batch.column("scores").to_pylist()])
            radius = np.sqrt(np.maximum((x**2).sum(1) + space.square - 2 * least, 0))
            names = ["uid", "id", "label", "cell", "radius", "vector", "group", "scores"]
            yield pa.RecordBatch.from_arrays([pa.array(radius) if c == "radius" else batch.column(c) for c in names], names=names)

    return run


def _reach(space: _Space):
    """Anchors (group, radius, vector) become (group, cell, least, most): distances from a cell's pivot at which a vector may serve one of the batch's anchors."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n = len(space.pivots)
        for batch in batches:
            apart, radius = space.from_pivots(space.unpacked(batch.column("vector")), True), np.asarray(batch.column("radius"))[:, None] + space.slack
            group = np.asarray(batch.column("group"))
            for g in np.unique(group):
                own = group == g
                columns = [np.full(n, g, np.int32), np.arange(n, dtype=np.int32), (apart[own] - radius[own]).min(0), (apart[own] + radius[own]).max(0)]
                yield pa.RecordBatch.from_arrays([pa.array(c) for c in columns], names=["group", "cell", "least", "most"])

    return run


def _copied(bounds: np.ndarray, slices: int):
    """Vectors go to the groups that they may serve: bounds[group, cell] has the least and the greatest distance from the pivot."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        next_ = TaskContext.get().partitionId() * 7919
        for batch in batches:
            cell, far = np.asarray(batch.column("cell")), np.asarray(batch.column("far"))
            slice_ = (np.arange(next_, next_ + len(cell)) % slices).astype(np.int32)
            next_ += len(cell)
            for g in range(len(bounds)):
                at = np.flatnonzero((far >= bounds[g, cell, 0]) & (far <= bounds[g, cell, 1]))
                if len(at):
                    own = batch.take(pa.array(at))
                    columns = [pa.array(np.full(len(at), g, np.int32)), pa.array(slice_[at]), *(own.column(c) for c in ("uid", "id", "label", "vector"))]
                    yield pa.RecordBatch.from_arrays(columns, names=["group", "slice", "uid", "id", "label", "vector"])

    return run


def _columns(table: pa.Table, *names: str) -> list[np.ndarray]:
    return [table.column(c).to_numpy() for c in names]


def _first(row: np.ndarray, most: int) -> np.ndarray:
    """Which entries are among the first most of their row; equal rows stand together."""
    start = np.flatnonzero(np.concatenate(([True], row[1:] != row[:-1])))
    return np.arange(len(row)) - np.repeat(start, np.diff([*start, len(row)])) < most


def _positives(space: _Space, seek: int):
    """The best seek vectors of a slice that have an anchor's label, for each anchor of a group."""

    def run(key: tuple, vectors: pa.Table, anchors: pa.Table) -> pa.Table:
        vectors, anchors = vectors.sort_by([("label", "ascending"), ("id", "ascending"), ("uid", "ascending")]), anchors.sort_by("label")
        uid, id_, label = _columns(vectors, "uid", "id", "label")
        auid, aid, alabel = _columns(anchors, "uid", "id", "label")
        x, a = space.unpacked(vectors.column("vector")), space.unpacked(anchors.column("vector"))
        out = []
        for value in np.intersect1d(label, alabel):
            v0, v1 = np.searchsorted(label, value), np.searchsorted(label, value, "right")
            a0, a1 = np.searchsorted(alabel, value), np.searchsorted(alabel, value, "right")
            step = max(1, CELLS // (v1 - v0))
            for at in range(a0, a1, step):
                end = min(at + step, a1)
                score = a[at:end] @ x[v0:v1].T
                score[auid[at:end, None] == uid[None, v0:v1]] = -np.inf
                least = np.partition(score, -seek, 1)[:, -seek] if v1 - v0 > seek else np.full(end - at, -np.inf)
                row, k = np.nonzero((score >= least[:, None]) & (score > -np.inf))
                won = score[row, k].astype(np.int64)
                order = np.lexsort((k, -won, row))  # vectors stand by id
                order = order[_first(row[order], seek)]
                row, k = at + row[order], v0 + k[order]
                out.append((auid[row], aid[row], uid[k], id_[k], won[order]))
        columns = [np.concatenate(c) for c in zip(*out, strict=True)] if out else [np.zeros(0, np.int64)] * 5
        return pa.table([pa.array(c) for c in columns], names=["uid", "anchor_id", "other", "id", "score"])

    return run


def _negatives(space: _Space, seek: int, low: int, high: int):
    """The best seek vectors of a slice with another label whose score is from low to high percent of a positive's, for each anchor and score of its positives."""

    def run(key: tuple, vectors: pa.Table, anchors: pa.Table) -> pa.Table:
        vectors = vectors.sort_by([("id", "ascending"), ("uid", "ascending")])
        uid, id_, label = _columns(vectors, "uid", "id", "label")
        auid, alabel = _columns(anchors, "uid", "label")
        x, a = space.unpacked(vectors.column("vector")), space.unpacked(anchors.column("vector"))
        asked = anchors.column("scores").to_pylist()
        out, step = [], min(ROWS, max(1, CELLS // max(1, len(x))))
        for at in range(0, len(a), step):
            end = min(at + step, len(a))
            row_of = np.repeat(np.arange(end - at), [len(s) for s in asked[at:end]])
            want = np.array([s for own in asked[at:end] for s in own], np.int64)
            least = np.array([low * min(own) // 100 for own in asked[at:end]])[:, None]
            most = np.array([-(-high * max(own) // 100) for own in asked[at:end]])[:, None]
            score = a[at:end] @ x.T
            row, k = np.nonzero((score >= least) & (score <= most) & (alabel[at:end, None] != label[None]))
            won = score[row, k].astype(np.int64)
            order = np.lexsort((k, -won, row))
            row, k, won = row[order], k[order], won[order]
            keys = (row.astype(np.int64) << 54) - won
            first = np.searchsorted(keys, (row_of.astype(np.int64) << 54) - high * want // 100)
            for j in range(seek):
                i = first + j
                good = i < len(keys)
                good[good] = (row[i[good]] == row_of[good]) & (100 * won[i[good]] >= low * want[good])
                i, own = i[good], good.nonzero()[0]
                out.append((auid[at + row_of[own]], want[own], uid[k[i]], id_[k[i]], won[i]))
        columns = [np.concatenate(c) for c in zip(*out, strict=True)] if out else [np.zeros(0, np.int64)] * 5
        return pa.table([pa.array(c.astype(np.int64)) for c in columns], names=["uid", "positive_score", "other", "id", "score"])

    return run


def _groups(counts: dict[int, int], pivots: np.ndarray, most: int) -> tuple[list[int], list[int], int]:
    """First group and number of groups of each cell, and their sum: neighbouring cells share one of up to most anchors, larger cells are split."""
    first, parts = [0] * len(pivots), [1] * len(pivots)
    todo, at, group, held = set(counts), None, 0, 0
    while todo:
        at = min(todo) if at is None else min(todo, key=lambda c: (float(((pivots[c] - pivots[at]) ** 2).sum()), c))
        todo.remove(at)
        if held and held + counts[at] > most:
            group, held = group + 1, 0
        first[at], parts[at] = group, -(-counts[at] // most)
        held += counts[at]
        if parts[at] > 1:
            group, held = group + parts[at], 0
    return first, parts, group + (held > 0)


def _joined(space: _Space, vectors: DataFrame, anchors: DataFrame, n_groups: int, slices: int, join, schema: str) -> DataFrame:
    """join() on the anchors of each group and the vectors that may serve them, slice by slice."""
    bounds = np.empty((n_groups, len(space.pivots), 2))
    bounds[:, :, 0], bounds[:, :, 1] = np.inf, -np.inf
    told = anchors.select("group", "radius", "vector").mapInArrow(_reach(space), "group int, cell int, least double, most double")
    told = told.groupBy("group", "cell").agg(F.min("least").alias("least"), F.max("most").alias("most")).toArrow()
    bounds[told.column("group").to_numpy(), told.column("cell").to_numpy()] = np.stack(_columns(told, "least", "most"), 1)
    sought = vectors.mapInArrow(_copied(bounds, slices), "group int, slice int, uid long, id long, label long, vector binary")
    asking = anchors.withColumn("slice", F.explode(F.sequence(F.lit(0), F.lit(slices - 1)))).drop("radius", "cell")
    return sought.groupBy("group", "slice").cogroup(asking.groupBy("group", "slice")).applyInArrow(join, schema)


def _best(rows: DataFrame, by: list[str], most: int) -> DataFrame:
    place = F.row_number().over(Window.partitionBy(*by).orderBy(F.desc("score"), "id", "other"))
    return rows.withColumn("rank", place).where(F.col("rank") <= most)


def mined(rows: DataFrame, every: int = 100, positives: int = 5, negatives: int = 5, low: int = 80, high: int = 100, group: int = GROUP, slice_: int = SLICE) -> DataFrame:
    """Hard negatives of rows (id, label, vector: array of long); anchors are the rows whose id is divisible by every.

    (anchor_id, positive_id, rank, negative_id, positive_score, negative_score): for each anchor and each of its positives, the
    best other rows of its label, the best rows of other labels that score from low to high percent of the positive. The
    result is stored, and goes with the session.
    """
    spark = rows.sparkSession
    bounded_batches(spark)
    own = rows.select(F.col("id").cast("long").alias("id"), F.col("label").cast("long").alias("label"), F.col("vector").cast("array<long>").alias("vector"))
    square = F.aggregate("vector", F.lit(0.0), lambda s, x: s + x.cast("double") * x.cast("double"))
    own = own.where("id is not null and label is not null and vector is not null").where(~F.exists("vector", lambda x: x.isNull())).withColumn("square", square).where(F.col("square") < float(1 << 53))
    told = own.agg(F.count("*"), F.max(F.size("vector")), F.max("square"), F.max(F.greatest(F.coalesce(F.array_max("vector"), F.lit(0)), -F.coalesce(F.array_min("vector"), F.lit(0))))).first()
    n, dims, longest, most = told
    if not n:
        return spark.createDataFrame([], RESULT)
    with scratch(spark):
        sample = own.orderBy(F.xxhash64("id", "vector")).limit(SAMPLE).select("vector").toArrow().column(0).combine_chunks()
        space = _Space(_pivots(_matrix(sample, dims), PIVOTS), float(longest), int(most))
        vectors = stored(own.drop("square").mapInArrow(_placed(space), _VECTORS), "vectors")
        slices = max(-(-n // slice_), min(SLICES, -(-n // 256)))

        few = F.row_number().over(Window.partitionBy("label", "cell").orderBy("far"))
        near = vectors.select("label", "cell", "far", few.alias("k")).where(F.col("k") <= positives + 1).groupBy("label").agg(F.collect_list(F.struct("cell", "far")).alias("near"))
        near = near.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
        asking = vectors.where(F.col("id") % every == 0).select("uid", "id", "label", "vector", F.pmod(F.xxhash64("uid"), F.lit(SALTS)).cast("int").alias("salt"))
        anchors = stored(asking.join(near, ["label", "salt"]).mapInArrow(_own_radius(space, positives), _ANCHORS), "anchors")
        counts = {r["cell"]: r["count"] for r in anchors.groupBy("cell").count().collect()}  # one a pivot
        if not counts:
            return spark.createDataFrame([], RESULT)
        first, parts, n_groups = _groups(counts, space.pivots, max(group, -(-sum(counts.values()) // GROUPS)))
        at = lambda values: F.element_at(F.array(*map(F.lit, values)), F.col("cell") + 1)
        anchors = anchors.withColumn("group", at(first) + F.pmod(F.xxhash64("uid"), at(parts)).cast("int"))

        best = _joined(space, vectors, anchors, n_groups, slices, _positives(space, positives), "uid long, anchor_id long, other long, id long, score long")
        best = stored(_best(best, ["uid"], positives).select("uid", "anchor_id", F.col("id").alias("positive_id"), F.col("score").alias("positive_score")), "positives")

        scores = best.where("positive_score >= 0").groupBy("uid").agg(F.collect_set("positive_score").alias("scores"))
        ranged = stored(anchors.drop("radius").join(scores, "uid").mapInArrow(_range_radius(space, low), "uid long, id long, label long, cell int, radius double, vector binary, group int, scores array<long>"), "ranges")
        found = _joined(space, vectors, ranged, n_groups, slices, _negatives(space, negatives, low, high), "uid long, positive_score long, other long, id long, score long")
        found = _best(found, ["uid", "positive_score"], negatives).select("uid", "positive_score", F.col("id").alias("negative_id"), F.col("score").alias("negative_score"), "rank")
        return kept(stored(best.join(found, ["uid", "positive_score"]).select("anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score"), "hard-negatives"))


SQL = r"""
WITH rows AS (
    SELECT row_number() OVER () AS uid, vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label, list_transform(embedding, lambda x: floor(256 * x::DOUBLE)) AS v
    FROM embeddings
    WHERE vec_id IS NOT NULL AND label IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), scored AS (
    SELECT a.uid, a.vec_id AS anchor_id, a.label = b.label AS same, b.uid AS other, b.vec_id, list_inner_product(a.v, b.v)::BIGINT AS score
    FROM (SELECT * FROM rows WHERE vec_id % 100 = 0) a JOIN rows b ON a.uid <> b.uid
), positives AS (
    SELECT uid, anchor_id, vec_id AS positive_id, score AS positive_score FROM scored WHERE same
    QUALIFY row_number() OVER (PARTITION BY uid ORDER BY score DESC, vec_id, other) <= 5
)
SELECT p.anchor_id, p.positive_id, row_number() OVER (PARTITION BY p.uid, p.positive_id, p.positive_score ORDER BY s.score DESC, s.vec_id, s.other)::INT AS rank,
       s.vec_id AS negative_id, p.positive_score, s.score AS negative_score
FROM positives p JOIN scored s ON s.uid = p.uid AND NOT s.same AND 80 * p.positive_score <= 100 * s.score AND 100 * s.score <= 100 * p.positive_score
QUALIFY rank <= 5
"""
