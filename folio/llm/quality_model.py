"""Document quality by attention-based multiple-instance learning.

A text is a bag of passages of PASSAGE words. Each passage is described by shares of its bytes and words and
encoded by one tanh layer; gated attention, softmax of w . (tanh(V h) * sigmoid(U h)) over the passages of a
text, weighs them; the weighted mean is scored. All weights are learnt together from document labels alone.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StructField, StructType

from folio.llm.common import _LOWER, bounded_batches, held_out, mix, span_hashes, text_blocks, words

PASSAGE = 64
_CLASSES = [b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"abcdefghijklmnopqrstuvwxyz", b"0123456789", b".", b",;:", b"!?", b"#*$%&<>", b"|", b"\n", b"()[]{}", b"/\\@=_~^+-", b"\"'", bytes(range(128, 192)), bytes(range(192, 256))]
_CLASS = np.full(256, len(_CLASSES), np.int64)
for _k, _own in enumerate(_CLASSES):
    _CLASS[list(_own)] = _k
N_FEATURES = len(_CLASSES) + 8


def passages(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Features of the passages of each row, and the first passage of each row; a row without words has one, of zeros."""
    starts, ends, first = words(data, offsets)
    n_words = np.diff(first)
    n_pass = np.maximum(1, -(-n_words // PASSAGE))
    begin = np.concatenate(([0], np.cumsum(n_pass)))
    out = np.zeros((begin[-1], N_FEATURES))
    if not len(starts):
        return out, begin
    row_of = np.repeat(np.arange(len(n_words)), n_words)
    within = np.arange(len(starts)) - first[row_of]
    own = begin[row_of] + within // PASSAGE
    head = np.flatnonzero(np.concatenate(([True], own[1:] != own[:-1])))
    where = own[head]
    n = np.diff(np.append(head, len(own))).astype(float)
    last = np.append(head[1:], len(own)) - 1
    kinds = _CLASS[data]
    size = (ends[last] - starts[head]).astype(float)
    for k in range(len(_CLASSES)):
        total = np.concatenate(([0], np.cumsum(kinds == k)))
        out[where, k] = (total[ends[last]] - total[starts[head]]) / size
    lengths = (ends - starts).astype(float)
    hashes = span_hashes(_LOWER[data], starts, ends)
    again = np.zeros(len(starts))
    again[1:] = (hashes[1:] == hashes[:-1]) & (own[1:] == own[:-1])
    both = np.sort(mix(hashes + mix(own.astype(np.uint64))))  # equal only for one word of one passage
    key = mix(hashes + mix(own.astype(np.uint64)))
    order = np.argsort(key, kind="stable")
    new = np.zeros(len(key))
    new[order] = np.concatenate(([True], both[1:] != both[:-1]))
    capital = ((data[starts] >= 65) & (data[starts] <= 90)).astype(float)
    odd_end = np.isin(kinds[ends - 1], (5, 6, 7)).astype(float)
    long_ = (lengths > 20).astype(float)
    sums = lambda x: np.add.reduceat(x, head)
    mean = sums(lengths) / n
    base = len(_CLASSES)
    for k, x in enumerate((mean / 10, np.sqrt(np.maximum(sums(lengths**2) / n - mean**2, 0)) / 10, sums(new) / n, sums(again) / n, sums(capital) / n, sums(odd_end) / n, sums(long_) / n, np.minimum(n, PASSAGE) / PASSAGE)):
        out[where, base + k] = x
    return out, begin


@dataclass
class Model:
    mean: np.ndarray
    scale: np.ndarray
    weights: dict[str, np.ndarray]

    def scores(self, x: np.ndarray, begin: np.ndarray) -> np.ndarray:
        return _forward(self.weights, (x - self.mean) / self.scale, begin)["y"]


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -40, 40)))


def _forward(p: dict, x: np.ndarray, begin: np.ndarray) -> dict:
    own = np.repeat(np.arange(len(begin) - 1), np.diff(begin))
    h = np.tanh(x @ p["E"] + p["e"])
    v, u = np.tanh(h @ p["V"]), _sigmoid(h @ p["U"])
    a = (v * u) @ p["w"]
    a = np.exp(a - np.maximum.reduceat(a, begin[:-1])[own])
    a /= np.add.reduceat(a, begin[:-1])[own]
    z = np.add.reduceat(a[:, None] * h, begin[:-1], axis=0)
    return {"own": own, "x": x, "h": h, "v": v, "u": u, "a": a, "z": z, "y": _sigmoid(z @ p["c"] + p["d"])}


def _slopes(p: dict, f: dict, label: np.ndarray, begin: np.ndarray) -> dict:
    dy = (f["y"] - label) / len(label)
    dz = dy[:, None] * p["c"]
    own, a, h = f["own"], f["a"], f["h"]
    da = (dz[own] * h).sum(1)
    ds = a * (da - np.add.reduceat(a * da, begin[:-1])[own])
    dvu = ds[:, None] * p["w"]
    dv, du = dvu * f["u"] * (1 - f["v"] ** 2), dvu * f["v"] * f["u"] * (1 - f["u"])
    dh = (a[:, None] * dz[own] + dv @ p["V"].T + du @ p["U"].T) * (1 - h**2)
    return {"E": f["x"].T @ dh, "e": dh.sum(0), "V": h.T @ dv, "U": h.T @ du, "w": (f["v"] * f["u"]).T @ ds, "c": f["z"].T @ dy, "d": dy.sum()}


def train(x: np.ndarray, begin: np.ndarray, label: np.ndarray, hidden: int = 24, gate: int = 12, steps: int = 500, rate: float = 0.02, decay: float = 1e-4, seed: int = 5) -> Model:
    """Adam on all bags. With labels of one kind, or none, the score is that kind's share everywhere."""
    rng = np.random.default_rng(seed)
    mean, scale = (x.mean(0), x.std(0) + 1e-3) if len(x) else (np.zeros(N_FEATURES), np.ones(N_FEATURES))
    p = {"E": rng.normal(0, N_FEATURES**-0.5, (N_FEATURES, hidden)), "e": np.zeros(hidden), "V": rng.normal(0, hidden**-0.5, (hidden, gate)), "U": rng.normal(0, hidden**-0.5, (hidden, gate)), "w": rng.normal(0, gate**-0.5, gate), "c": np.zeros(hidden), "d": np.zeros(())}
    if len(label) == 0 or label.min() == label.max():
        return Model(mean, scale, p | {"d": np.array(20.0 * (label.mean() - 0.5) if len(label) else 0.0)})
    x = (x - mean) / scale
    m, v = {k: np.zeros_like(w) for k, w in p.items()}, {k: np.zeros_like(w) for k, w in p.items()}
    for t in range(1, steps + 1):
        for k, g in _slopes(p, _forward(p, x, begin), label, begin).items():
            g = g + decay * p[k] * (k not in "ed")
            m[k] = 0.9 * m[k] + 0.1 * g
            v[k] = 0.999 * v[k] + 0.001 * g**2
            p[k] = p[k] - rate * (0.1 if t > 0.8 * steps else 1) * (m[k] / (1 - 0.9**t)) / (np.sqrt(v[k] / (1 - 0.999**t)) + 1e-8)
    return Model(mean, scale, p)


def _bags(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for row, data, offsets in text_blocks(batch):
            x, begin = passages(data, offsets)
            own = [x[a:b].astype(np.float32).tobytes() for a, b in zip(begin[:-1], begin[1:], strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column("quality").slice(row, len(own)), pa.array(own, pa.binary())], ["quality", "bag"])


def fit(docs: DataFrame, labels: DataFrame, most: int = 4000) -> Model:
    """Learns from about most labelled rows (drawn by a hash of doc_id) among those whose labels may be used.

    What reaches the driver of a text are N_FEATURES numbers for each PASSAGE of its words, no text. Rows of labels that
    repeat a doc_id count once, with the larger label; those without one or without a label don't count. Rows of docs that
    repeat a doc_id are texts of their own, all with its label. Null and empty texts are one passage of zeros.
    """
    bounded_batches(docs.sparkSession)
    labels = labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("quality").cast("int").alias("quality")).where("quality is not null").groupBy("doc_id").agg(F.max("quality").alias("quality"))
    labels = labels.where(~held_out(F.col("doc_id")))
    n = labels.count()
    if n > most:
        labels = labels.where(F.pmod(F.xxhash64("doc_id", F.lit(72)), F.lit(1_000_000)) < int(1_000_000 * most / n))
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").join(labels, "doc_id").select("quality", "text", "doc_id")
    got = rows.mapInArrow(_bags, "quality int, bag binary").toArrow()
    bags = [np.frombuffer(x, np.float32).reshape(-1, N_FEATURES) for x in got.column("bag").to_pylist()]
    label = got.column("quality").to_numpy().astype(float)
    order = sorted(range(len(bags)), key=lambda i: (bags[i].tobytes(), label[i]))  # rows come in no fixed order
    begin = np.concatenate(([0], np.cumsum([len(bags[i]) for i in order]))).astype(np.int64)
    return train(np.concatenate([bags[i] for i in order]).astype(float) if bags else np.zeros((0, N_FEATURES)), begin, label[order] if bags else label)


def score(docs: DataFrame, model: Model) -> DataFrame:
    """The given columns with score (0 to 1, higher: better; a column of this name is replaced), of every row and its whole text.

    Null and empty texts have the score of one passage without words. Repeated rows have equal scores. No rows give no rows.
    """
    bounded_batches(docs.sparkSession)
    columns = [c for c in docs.columns if c != "score"]

    def scored(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            got = [model.scores(*passages(data, offsets)) for _, data, offsets in text_blocks(batch)]
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in columns), pa.array(np.concatenate(got) if got else np.zeros(0))], [*columns, "score"])

    return docs.select(*columns).mapInArrow(scored, StructType([*docs.select(*columns).schema.fields, StructField("score", DoubleType())]))
