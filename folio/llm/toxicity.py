"""Toxicity by non-negative positive-unlabelled learning.

A linear classifier over word stems is trained in numpy from confirmed toxic texts (P) and unlabelled texts
(U) only. With the class prior p the risk is w_P * R_P(+) + w_N * max(0, R_U(-) - p * R_P(-)), so the toxic texts
among the unlabelled ones don't count as clean, and the corrected term never turns negative. U are texts that aren't
confirmed toxic, and p is their toxic share: that of all labelled rows that may be learnt from, less the toxic rows
that are confirmed. Toxic texts are rare, so the weights are those of a balance b of the classes: w_P = b, and
w_N = (1 - b) / (1 - p).
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StructField, StructType

from folio.llm.common import _LOWER, bounded_batches, held_out, mix, scratch, shingle_sets, span_hashes, stored, text_blocks, token_spans

#: A stem is a word's first bytes, so many of them; 0 stands for the whole word.
STEMS = (0, 4, 5, 6)


@dataclass(frozen=True)
class Sample:
    """Bounds of what is learnt from; the texts are drawn by a hash of doc_id."""

    positive: int = 3000
    unlabelled: int = 9000
    features: int = 4096
    #: Least evidence of a feature: toxic texts with it, times the log of how much more often they have it (8 + n / 5 with n under 60 toxic texts).
    evidence: float = 12.0
    #: Share of the risk that toxic texts stand for.
    balance: float = 0.3


@dataclass
class Model:
    keys: np.ndarray
    weights: np.ndarray
    bias: float

    def scores(self, bags: list[np.ndarray]) -> np.ndarray:
        """bags: the distinct features of each text, as positions in keys."""
        z = np.array([self.weights[x].sum() for x in bags]) + self.bias
        return 1 / (1 + np.exp(-np.clip(z, -40, 40)))


def stems(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the stems of each word (words x STEMS), and the first word of each row; words are letters and digits."""
    data = _LOWER[data]
    starts, ends, first = token_spans(data, offsets)
    out = np.stack([span_hashes(data, starts, np.minimum(ends, starts + k) if k else ends) + np.uint64(k) for k in STEMS], 1) if len(starts) else np.zeros((0, len(STEMS)), np.uint64)
    return out, first


_MARKS = ("m0", "m1", "m2")


def _marked(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Three MinHash values of each text's shingles: a near copy shares one of them almost surely; a text's place by a hash of all of them."""
    for batch in batches:
        for row, data, offsets in text_blocks(batch):
            own = list(shingle_sets(data, offsets))
            least = np.array([[mix(x + np.uint64(k)).min() if len(x) else 0 for k in range(len(_MARKS))] for x in own], np.uint64).view(np.int64)
            part = batch.slice(row, len(own))
            place = pa.array([int(mix(x).sum(dtype=np.uint64).view(np.int64)) for x in own], pa.int64())
            yield pa.RecordBatch.from_arrays([part.column("text"), part.column("toxic"), *(pa.array(least[:, k]) for k in range(len(_MARKS))), place], ["text", "toxic", *_MARKS, "place"])


def _counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(feature, p, u) of a batch: how many toxic and unlabelled texts have the feature."""
    for batch in batches:
        toxic = np.asarray(batch.column("toxic").to_pylist(), bool)
        found: tuple[list, list] = ([], [])
        for row, data, offsets in text_blocks(batch):
            each, first = stems(data, offsets)
            for k in range(len(offsets) - 1):
                found[int(toxic[row + k])].append(np.unique(each[first[k] : first[k + 1]]))
        for kind, own in enumerate(found):
            if own:
                keys, n = np.unique(np.concatenate(own), return_counts=True)
                zero = np.zeros(len(n), np.int64)
                yield pa.RecordBatch.from_arrays([pa.array(keys.view(np.int64)), pa.array(n if kind else zero), pa.array(zero if kind else n)], ["feature", "p", "u"])


def _bagged(keys: np.ndarray):
    def bags(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row, own in _found(batch, keys):
                yield pa.RecordBatch.from_arrays([batch.column("toxic").slice(row, len(own)), pa.array(own, pa.list_(pa.int32()))], ["toxic", "bag"])

    return bags


def _found(batch: pa.RecordBatch, keys: np.ndarray) -> Iterator[tuple[int, list[np.ndarray]]]:
    low = np.zeros(1 << 16, bool)  # most features of a text are none of the keys
    low[(keys & np.uint64(0xFFFF)).astype(np.int64)] = True
    for row, data, offsets in text_blocks(batch):
        each, first = stems(data, offsets)
        flat = each.ravel()
        may = np.flatnonzero(low[(flat & np.uint64(0xFFFF)).astype(np.int64)])
        at = np.minimum(np.searchsorted(keys, flat[may]), max(len(keys) - 1, 0))
        hit = keys[at] == flat[may] if len(keys) else np.zeros(len(may), bool)
        at, where = at[hit], may[hit] // len(STEMS)
        cut = np.searchsorted(where, first)
        yield row, [np.unique(at[a:b]).astype(np.int32) for a, b in zip(cut[:-1], cut[1:], strict=True)]


def nnpu_slopes(w: np.ndarray, b: float, rows: np.ndarray, cols: np.ndarray, is_p: np.ndarray, prior: float, balance: float) -> tuple[np.ndarray, float]:
    """Slopes of the risk by w and b (last), and its corrected term; text rows[k] has feature cols[k].

    The loss is the sigmoid: of a text counted as negative it is the score, as positive 1 less it. It is bounded, so texts
    far on the right side cannot drive the corrected term R_U(-) - p * R_P(-) below zero. Where that is below zero all
    the same, only its reverse is followed, as in the published rule.
    """
    share = np.where(is_p, 1 / is_p.sum(), 1 / (~is_p).sum())
    up = 1 / (1 + np.exp(-np.clip(b + np.bincount(rows, w[cols], len(is_p)), -40, 40)))
    bend = share * up * (1 - up)
    corrected = (up * share)[~is_p].sum() - prior * (up * share)[is_p].sum()
    slope_corrected = (1 - balance) / (1 - prior) * np.where(is_p, -prior * bend, bend)
    slope = np.where(is_p, -balance * bend, 0) + slope_corrected if corrected >= 0 else -slope_corrected
    return np.append(np.bincount(cols, slope[rows], len(w)), slope.sum()), float(corrected)


def train_nnpu(positive: list[np.ndarray], unlabelled: list[np.ndarray], n: int, prior: float, balance: float, steps: int = 1000, rate: float = 0.05, decay: float = 1e-6) -> tuple[np.ndarray, float]:
    """Weights and bias of least non-negative risk, by Adam on all rows; without texts of either kind a low score for all."""
    if not positive or not unlabelled:
        return np.zeros(n), -4.0
    bags = positive + unlabelled
    rows = np.repeat(np.arange(len(bags)), [len(x) for x in bags])
    cols = np.concatenate(bags).astype(np.int64)
    is_p = np.arange(len(bags)) < len(positive)
    w, b = np.zeros(n), -1.0
    m, v = np.zeros(n + 1), np.zeros(n + 1)
    for t in range(1, steps + 1):
        grad, _ = nnpu_slopes(w, b, rows, cols, is_p, prior, balance)
        grad[:-1] += decay * w
        m = 0.9 * m + 0.1 * grad
        v = 0.999 * v + 0.001 * grad**2
        step = rate * (m / (1 - 0.9**t)) / (np.sqrt(v / (1 - 0.999**t)) + 1e-8)
        w, b = w - step[:-1], b - step[-1]
    return w, float(b)


def _drawn(df: DataFrame, n: int, most: int) -> DataFrame:
    """About most of n rows, by a hash of doc_id."""
    return df if n <= most else df.where(F.pmod(F.xxhash64("doc_id", F.lit(71)), F.lit(1_000_000)) < int(1_000_000 * most / n))


def fit(docs: DataFrame, labels: DataFrame, sample: Sample = Sample()) -> Model:
    """Learns from the rows whose labels may be used, at most about as many as sample says. Without toxic rows every score is low.

    Rows of labels that repeat a doc_id count once, with the larger label; those without one or without a label don't count. Rows
    of docs that repeat a doc_id are texts of their own. Null and empty texts have no stems. Which rows are learnt
    from, and so the scores, depends on ids, labels and texts alone.
    """
    spark = docs.sparkSession
    bounded_batches(spark)
    with scratch(spark):
        return _fitted(docs, labels, sample)


def _fitted(docs: DataFrame, labels: DataFrame, sample: Sample) -> Model:
    labels = labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("toxic").cast("int").alias("toxic")).where("toxic is not null").groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    known = labels.where(~held_out(F.col("doc_id"))).agg(F.count("*").alias("n"), F.sum("toxic").alias("p")).first()
    own = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").where(~held_out(F.col("doc_id")))
    toxic_ids = labels.where((F.col("toxic") == 1) & ~held_out(F.col("doc_id"))).select("doc_id")
    toxic = _drawn(toxic_ids, known["p"] or 0, sample.positive)
    n_own = own.count()
    drawn = _drawn(own, n_own, sample.unlabelled)
    share, told = (known["p"] or 0) / max(known["n"], 1), min(known["n"] / max(n_own, 1), 1.0)
    prior = float(np.clip(share * (1 - told) / max(1 - share * told, 1e-9), 0.005, 0.5))  # of texts that aren't confirmed
    rows = own.join(toxic, "doc_id").withColumn("toxic", F.lit(True)).unionByName(drawn.join(toxic_ids, "doc_id", "left_anti").withColumn("toxic", F.lit(False)))
    rows = stored(rows.select("text", "toxic").mapInArrow(_marked, "text string, toxic boolean, m0 long, m1 long, m2 long, place long"), "drawn")
    for mark in _MARKS:  # copies of one toxic text would make its chance words look telling
        rows = rows.withColumn("nth", F.row_number().over(Window.partitionBy("toxic", mark).orderBy("place", "text"))).where("nth = 1").drop("nth")
    rows = stored(rows.select("text", "toxic"), "sample")
    size = {r["toxic"]: r["count"] for r in rows.groupBy("toxic").count().collect()}
    n_p, n_u = size.get(True, 0), size.get(False, 0)
    rate_p, rate_u = F.col("p") / max(n_p, 1), F.col("u") / max(n_u, 1)
    clean = F.greatest((rate_u - prior * rate_p) / (1 - prior), F.lit(0.5 / max(n_u, 1)))
    counted = rows.mapInArrow(_counts, "feature long, p long, u long").groupBy("feature").agg(F.sum("p").alias("p"), F.sum("u").alias("u"))
    told = counted.where(rate_p > 4 * clean).select("feature", (F.col("p") * F.log(rate_p / clean)).alias("tells")).where(F.col("tells") >= min(sample.evidence, 8 + n_p / 5))
    best = told.orderBy(F.desc("tells"), "feature").limit(sample.features).toArrow()
    keys = np.sort(best.column("feature").to_numpy().view(np.uint64))
    got = rows.mapInArrow(_bagged(keys), "toxic boolean, bag array<int>").toArrow()
    is_p = got.column("toxic").to_numpy(zero_copy_only=False)
    bags = [np.asarray(x.values, np.int64) for chunk in got.column("bag").chunks for x in chunk]
    bags = sorted(zip(is_p.tolist(), bags, strict=True), key=lambda x: (x[0], x[1].tobytes()))  # rows come in no fixed order
    w, b = train_nnpu([x for p, x in bags if p], [x for p, x in bags if not p], len(keys), prior, sample.balance)
    return Model(keys, w, b)


def score(docs: DataFrame, model: Model) -> DataFrame:
    """The given columns with score (0 to 1, higher: likelier toxic; a column of this name is replaced), of every row and its whole text.

    Null and empty texts have the score of a text without stems. Repeated rows have equal scores. No rows give no rows.
    """
    bounded_batches(docs.sparkSession)
    columns = [c for c in docs.columns if c not in ("score",)]

    def scored(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            got = [model.scores(own) for _, own in _found(batch, model.keys)]
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in columns), pa.array(np.concatenate(got) if got else np.zeros(0))], [*columns, "score"])

    return docs.select(*columns).mapInArrow(scored, StructType([*docs.select(*columns).schema.fields, StructField("score", DoubleType())]))
