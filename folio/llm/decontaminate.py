"""Benchmark decontamination by spaced seeds.

A seed is a window of SPAN tokens of which a fixed mask keeps some, so a substitution at a position that is left
out changes nothing. An item shorter than a seed has a seed of its whole length for each position left out. Seeds
of the benchmark and of the documents are joined on their hashes; around each hit the aligned tokens are compared,
and a stretch of the item with enough equal tokens is a leak. Every set of substitutions that EQUAL allows leaves a seed.

Where tokens repeat, so do seeds with all that is about them; a document's or an item's places of one seed that have the same
surroundings are one, the first. A run of one token, or of a few in turn, so meets another in a number of places that doesn't grow
with their lengths. Items too short to miss a token have one seed, all of it, whose first place in a document counts.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from folio.llm.common import bounded_batches, kept, mix, stored, text_blocks, tokens, unused

# The masks. Any two positions are left out by one of them, and, shifted within an item of 15 to 19 tokens, any three.
MASKS = ("1011011010", "1101110100", "1001101011", "0101011101", "0011110011", "0111101100", "1110000111", "0100111110", "1010111001")
SPAN = len(MASKS[0])
#: A leak is a stretch of this many aligned tokens (or the whole item, if shorter) with this share equal.
STRETCH, EQUAL = 20, (80, 100)
SIDE = STRETCH - 1
#: log2 of the bits of the filter over benchmark seeds, whose size doesn't depend on the data.
BITS = 26


def seeds(hashes: np.ndarray, first: np.ndarray) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(mask, seed hashes, valid): for each position the seed that starts there, if its window stays in its row."""
    n = len(hashes) - SPAN + 1
    if n <= 0:
        return
    end = np.repeat(first[1:], np.diff(first))[:n]
    valid = np.arange(n) + SPAN <= end
    for k, mask in enumerate(MASKS):
        acc = np.full(n, k + 1, np.uint64)
        for j, c in enumerate(mask):
            if c == "1":
                acc = acc * np.uint64(0xD6E8FEB86659FD93) + hashes[j : j + n]
        yield k, mix(acc), valid


def exact(n: int) -> bool:
    """Whether no token of a stretch of n may differ."""
    return EQUAL[1] * (n - 1) < EQUAL[0] * n


def whole(hashes: np.ndarray, first: np.ndarray, n: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(hashes of n tokens without one of them, valid) for each token that may be left out, or of all of them if none may; for items shorter than a seed."""
    m = max(len(hashes) - n + 1, 0)
    valid = np.arange(m) + n <= np.repeat(first[1:], np.diff(first))[:m]
    terms = [hashes[j : j + m] * np.uint64(pow(0xD6E8FEB86659FD93, j + 1, 1 << 64)) for j in range(n)]
    every = sum(terms, np.zeros(m, np.uint64))
    if exact(n):
        yield mix(every + np.uint64(100 + SPAN * n + n)), valid
        return
    for j, own in enumerate(terms):
        yield mix(every - own + np.uint64(100 + SPAN * n + j)), valid


#: Tokens that a seed brings along: its own and SIDE on either side.
AROUND = SPAN + 2 * SIDE


def _around(hashes: np.ndarray, at: np.ndarray, low: np.ndarray, high: np.ndarray) -> pa.Array:
    """The AROUND tokens about each place, as bytes; places outside low to high are 0."""
    near = at[:, None] + np.arange(-SIDE, SPAN + SIDE)
    inside = (near >= low[:, None]) & (near < high[:, None])
    found = np.where(inside, hashes[np.clip(near, 0, max(len(hashes) - 1, 0))], np.uint64(0))
    return pa.FixedSizeBinaryArray.from_buffers(pa.binary(8 * AROUND), len(at), [None, pa.py_buffer(np.ascontiguousarray(found))]).cast(pa.binary())


#: Rows that carry their surroundings in one batch.
_SLICE = 4096
_WEIGHTS = mix(np.arange(1, AROUND + 1, dtype=np.uint64)) | np.uint64(1)


def _different(owner: np.ndarray, key: np.ndarray, around: np.ndarray) -> np.ndarray:
    """The first of the places that agree in owner, key and what is about them (a hash of it)."""
    _, at = np.unique(np.stack([owner.astype(np.uint64), key, around], 1), axis=0, return_index=True)
    return np.sort(at)


def _about(hashes: np.ndarray, low: np.ndarray, high: np.ndarray) -> Callable[[np.ndarray], np.ndarray]:
    """Hashes of the AROUND tokens about places, those outside low to high as 0."""

    def told(at: np.ndarray) -> np.ndarray:
        out = np.empty(len(at), np.uint64)
        for k in range(0, len(at), _SLICE):
            here = at[k : k + _SLICE]
            near = here[:, None] + np.arange(-SIDE, SPAN + SIDE)
            inside = (near >= low[here, None]) & (near < high[here, None])
            out[k : k + _SLICE] = (np.where(inside, hashes[np.clip(near, 0, len(hashes) - 1)], np.uint64(0)) * _WEIGHTS).sum(1)
        return out

    return told


def _item_seeds(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for row, data, offsets in text_blocks(batch):
            hashes, first = tokens(data, offsets)
            sizes = np.diff(first)
            owner = np.repeat(np.arange(len(sizes)), sizes)
            found = [(h[v], np.flatnonzero(v)) for _, h, v in seeds(hashes, first)]
            for n in range(1, SPAN):
                for h, v in whole(hashes, first, n):
                    v = v & (sizes[owner[: len(v)]] == n)
                    found.append((h[v], np.flatnonzero(v)))
            keys, at = (np.concatenate(x) for x in zip(*found, strict=True))
            if len(at):
                chosen = _different(owner[at], keys, _about(hashes, first[owner], first[owner + 1])(at))
                keys, at = keys[chosen], at[chosen]
            for k in range(0, len(keys), _SLICE):
                here = at[k : k + _SLICE]
                own = owner[here]
                yield pa.RecordBatch.from_arrays(
                    [pa.array(keys[k : k + _SLICE].view(np.int64)), batch.column("item_id").take(pa.array(own + row)), pa.array(here - first[own]), pa.array(sizes[own]), _around(hashes, here, first[own], first[own + 1])],
                    ["key", "item_id", "item_at", "size", "item"],
                )


def _probing(filter_: np.ndarray, short: list[int]):
    def probe(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row, data, offsets in text_blocks(batch):
                hashes, first = tokens(data, offsets)
                owner = np.repeat(np.arange(len(first) - 1), np.diff(first))
                about = _about(hashes, first[owner], first[owner + 1])
                for h, v, all_ in [*((h, v, False) for _, h, v in seeds(hashes, first)), *((h, v, exact(n)) for n in short for h, v in whole(hashes, first, n))]:
                    slot = (h >> np.uint64(64 - BITS)).astype(np.int64)
                    at = np.flatnonzero(v & ((filter_[slot >> 3] >> (slot & 7).astype(np.uint8)) & 1).astype(bool))
                    if len(at):
                        at = at[_different(owner[at], h[at], np.zeros(len(at), np.uint64) if all_ else about(at))]
                    for k in range(0, len(at), _SLICE):
                        here = at[k : k + _SLICE]
                        own = owner[here]
                        yield pa.RecordBatch.from_arrays(
                            [pa.array(h[here].view(np.int64)), batch.column("doc_id").take(pa.array(own + row)), pa.array(here - first[own]), _around(hashes, here, first[own], first[own + 1])], ["key", "doc_id", "doc_at", "around"]
                        )

    return probe


def _tokens_of(column: pa.Array) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), np.uint64).reshape(-1, AROUND)


def best_stretch(doc: np.ndarray, item: np.ndarray, item_at: np.ndarray, size: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(equal tokens, length, first place from item_at - SIDE on) of the best stretch of each aligned pair; ties go to the first."""
    place = item_at[:, None] - SIDE + np.arange(AROUND)
    equal = (doc == item) & (place >= 0) & (place < size[:, None])
    length = np.minimum(size, STRETCH)
    low = np.maximum(0, SIDE - item_at)
    sums = np.zeros((len(doc), AROUND + 1), np.int64)
    np.cumsum(equal, axis=1, out=sums[:, 1:])
    starts = np.arange(AROUND + 1)
    ends = np.minimum(starts + length[:, None], AROUND)
    got = np.take_along_axis(sums, ends, 1) - sums
    most = np.minimum(AROUND, size - item_at + SIDE)
    got[(starts < low[:, None]) | (starts + length[:, None] > np.maximum(most, low + length)[:, None])] = -1
    at = got.argmax(1)
    return np.take_along_axis(got, at[:, None], 1)[:, 0], length, at


def _verified(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        if not batch.num_rows:
            continue
        item_at, size, doc_at = (np.asarray(batch.column(c)) for c in ("item_at", "size", "doc_at"))
        matched, length, at = best_stretch(_tokens_of(batch.column("around")), _tokens_of(batch.column("item")), item_at, size)
        found = pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("item_id"), pa.array(matched), pa.array(length), pa.array(doc_at - SIDE + at)], ["doc_id", "item_id", "matched", "stretch", "begins"])
        yield found.filter(pa.array(EQUAL[1] * matched >= EQUAL[0] * length))


def leaks(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """doc_id, item_id, matched, stretch and begins (first token) of the best aligned stretch of each leak.

    Tokens are runs of letters and digits, A-Z lowered. Items and texts without tokens, null
    or empty, match nothing. Ids are cast to long; rows that repeat one count as one document or item, those
    without one as well. Of equally good stretches the first counts. An empty table gives no rows. Only the
    fixed-size filter of seeds goes to all tasks; documents' seeds that pass it are joined with the benchmark's, and
    either side brings along no more than the tokens about its seed.
    """
    spark = docs.sparkSession
    bounded_batches(spark)
    items = kept(stored(benchmark.select(F.col("item_id").cast("long").alias("item_id"), "text").mapInArrow(_item_seeds, "key long, item_id long, item_at long, size long, item binary"), "seeds"))
    slots = items.select(F.shiftrightunsigned("key", 64 - BITS).alias("slot"))
    bits = slots.select(F.shiftright("slot", 3).alias("byte"), F.expr("shiftleft(1, cast(slot % 8 as int))").alias("bit"))
    got = bits.groupBy("byte").agg(F.bit_or("bit").alias("bits")).toArrow()
    filter_ = np.zeros(1 << (BITS - 3), np.uint8)
    filter_[got.column("byte").to_numpy()] = got.column("bits").to_numpy().astype(np.uint8)
    short = sorted(r[0] for r in items.where(F.col("size") < SPAN).select("size").distinct().collect())  # fewer than SPAN
    hits = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(_probing(filter_, short), "key long, doc_id long, doc_at long, around binary")
    both = hits.join(items, "key").select("doc_id", "item_id", "doc_at", "around", "item_at", "size", "item")
    found = both.mapInArrow(_verified, "doc_id long, item_id long, matched long, stretch long, begins long")
    best = F.max_by(F.struct("matched", "stretch", "begins"), F.struct("matched", (-F.col("begins")).alias("b"))).alias("best")
    return found.groupBy("doc_id", "item_id").agg(best).select("doc_id", "item_id", "best.*")


def clean(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """The documents without a leak; of rows that repeat a doc_id all or none stay, rows without one always."""
    leaking = unused(docs.columns, "leaking")
    gone = leaks(docs, benchmark).where("doc_id is not null").select(F.col("doc_id").alias(leaking)).distinct()
    return docs.join(gone, F.col("doc_id").cast("long") == F.col(leaking), "left_anti")
