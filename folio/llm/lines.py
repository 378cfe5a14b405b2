"""Line deduplication by a segment-partition edit join.

A line within EDITS edits of another shares, unchanged, at least one of EDITS + 1 segments of the shorter of
the two. Every distinct line is indexed by its segments (length, number, segment) and probes the indexes of the
lengths from its own down to EDITS less, with just the substrings whose position an edit script of that size
allows. Pairs that meet are verified by a banded bit-parallel edit distance.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from folio.llm.common import _BLANK, SpanHasher, bloom, bounded_batches, in_bloom, kept, looked_up, mix, scratch, stored, text_blocks, unused
from folio.llm.components import components

EDITS = 2
#: Shorter lines (in code points) are equal or different; their segments would be too short to tell lines apart.
LEAST = 24


def within(a: str, b: str, most: int = EDITS) -> bool:
    """Whether a and b are at most so many edits apart: Myers' bit vectors, kept to a band of 2 * most + 1 diagonals.

    Each bit vector holds the vertical differences of one column within the band, and the band moves down a row with
    each column, so a step costs the same however long the lines are.
    """
    if len(a) > len(b):
        a, b = b, a
    m, n = len(a), len(b)
    if n - m > most:
        return False
    k = 0
    while k < m and a[k] == b[k]:
        k += 1
    a, b = a[k:], b[k:]
    k = 0
    while k < len(a) and a[-1 - k] == b[-1 - k]:
        k += 1
    a, b = a[: len(a) - k], b[: len(b) - k]
    m, n = len(a), len(b)
    if not m:
        return n <= most
    width = 2 * most + 1
    full, top = (1 << width) - 1, 1 << (width - 1)
    # Bit i of column j stands for row j - most + i of a (from 0); rows above the first act as rows of cost j - row.
    vp, vn, score = full & ~((1 << most) - 1), 0, min(most, m)
    for j in range(n):
        eq = 0
        for i in range(width):
            row = j - most + i
            if 0 <= row < m and a[row] == b[j]:
                eq |= 1 << i
        d0 = (((eq & vp) + vp) ^ vp) | eq | vn
        hp = vn | (~(d0 | vp) & full)
        hn = d0 & vp & full
        if j + most < m:
            score += 0 if d0 & top else 1
        else:
            bit = 1 << (m - 1 - j + most)  # the last row has been reached; go along it
            if m - 1 - j + most < 0:
                return False
            score += (1 if hp & bit else 0) - (1 if hn & bit else 0)
        shifted = (d0 >> 1) & full
        vp = (hn | (~(shifted | hp) & full)) & full
        vn = shifted & hp & full
    return score <= most


def line_list(text: str | None) -> list[str]:
    return (text or "").split("\n")


#: A bit by lead byte; the bytes that continue a code point have none.
_BAG = np.left_shift(np.uint64(1), mix(np.arange(256, dtype=np.uint64)) & np.uint64(63))
_BAG[0x80:0xC0] = 0
#: A bit by the lead bytes of two neighbours.
_PAIR = np.uint64(1) << (mix(np.arange(1 << 16, dtype=np.uint64)) >> np.uint64(58))
#: log2 of the bits of the filters, whose size doesn't depend on the data.
BITS = 27


#: Blanks at either end of a line that are passed over one by one.
_STEPS = 16


def _spans(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(row, line number, start, end) of the lines with a word, stripped of blanks."""
    breaks = np.flatnonzero(data == 10)
    begin = np.concatenate((offsets[:-1], breaks + 1))
    begin.sort(kind="stable")
    start, end, inner = begin.copy(), np.append(begin[1:], len(data)), None  # the break itself goes as a blank
    live = np.flatnonzero(start < end)
    for _ in range(_STEPS):
        live = live[_BLANK[data[start[live]]]]
        start[live] += 1
        live = live[start[live] < end[live]]
    live = live[_BLANK[data[start[live]]]]
    if len(live):
        inner = np.append(np.flatnonzero(~_BLANK[data]), len(data))
        start[live] = inner[np.searchsorted(inner, start[live])]
    own = np.flatnonzero(start < end)  # they have a word, which ends the way back
    begin, start, end = begin[own], start[own], end[own]
    live = np.arange(len(own))
    for _ in range(_STEPS):
        live = live[_BLANK[data[end[live] - 1]]]
        end[live] -= 1
    live = live[_BLANK[data[end[live] - 1]]]
    if len(live):
        inner = np.flatnonzero(~_BLANK[data]) if inner is None else inner
        end[live] = inner[np.searchsorted(inner, end[live]) - 1] + 1
    row = np.searchsorted(offsets, start, "right") - 1
    return row, np.searchsorted(breaks, begin) - np.searchsorted(breaks, offsets[:-1])[row], start, end


class _Long:
    """The lines of a block that are long enough to be alike without being equal."""

    def __init__(self, data: np.ndarray, hashed: SpanHasher, start: np.ndarray, end: np.ndarray, h: np.ndarray) -> None:
        lead = np.flatnonzero((data & 0xC0) != 0x80)
        begin, stop = np.searchsorted(lead, start), np.searchsorted(lead, end)
        keep = stop - begin >= LEAST
        self.data, self.hashed, self.h = data, hashed, h[keep]
        self.begin, self.length = begin[keep], (stop - begin)[keep]
        self.at = np.append(lead, len(data))  # byte of each code point
        self.from_, self.to = start[keep], end[keep]

    def keys(self, rows: np.ndarray, start: np.ndarray, size: np.ndarray, of: np.ndarray, k: int) -> np.ndarray:
        a = self.begin[rows] + start
        own = self.hashed(self.at[a], self.at[a + size])
        return mix(own + mix(of.astype(np.uint64) * np.uint64(EDITS + 1) + np.uint64(k)))

    def bags(self, rows: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
        """Parities of the code points of each line, or of the lines named, and of their pairs of neighbours, by first bytes."""
        data, from_, to, begin, length, lead = self.data, self.from_, self.to, self.begin, self.length, self.at[:-1]
        if rows is not None:  # their bytes only
            size, length = to[rows] - from_[rows], length[rows]
            to, stop = np.cumsum(size), np.cumsum(length)
            data = data[np.repeat(from_[rows] - (to - size), size) + np.arange(size.sum())]
            from_, begin, lead = to - size, stop - length, np.flatnonzero((data & 0xC0) != 0x80)
        if not len(length):
            return np.zeros(0, np.int64), np.zeros(0, np.int64)
        one = np.bitwise_xor.reduceat(looked_up(_BAG, data, 1), np.stack([from_, to], 1).ravel())[::2]
        first = data[lead].astype(np.uint16)
        pair = looked_up(_PAIR, (first[:-1] << np.uint16(8)) | first[1:], 2)
        two = np.bitwise_xor.reduceat(pair, np.stack([begin, begin + length - 1], 1).ravel())[::2]
        return one.view(np.int64), two.view(np.int64)


_ROWS = "kind byte, a long, b long, c long, d long"


def _placed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Places of lines (kind 0, the first of a text 2: doc_id, line number, h, text_key) and index entries (kind 1: key, h, bag, pairs)."""
    for batch in batches:
        for first, data, offsets in text_blocks(batch):
            row, number, start, end = _spans(data, offsets)
            hashed = SpanHasher(data)
            h = hashed(start, end)
            ids, texts = (np.asarray(batch.column(c))[row + first] for c in ("doc_id", "text_key"))
            head = np.ones(len(row), bool)
            head[1:] = row[1:] != row[:-1]
            names = ["kind", *"abcd"]
            yield pa.RecordBatch.from_arrays([pa.array(np.where(head, 2, 0).astype(np.int8)), pa.array(ids), pa.array(number), pa.array(h.view(np.int64)), pa.array(texts)], names)
            new = np.sort(np.unique(h, return_index=True)[1])
            lines = _Long(data, hashed, start[new], end[new], h[new])
            rows, (bags, twos) = np.arange(len(lines.h)), lines.bags()
            for k, (at, size) in enumerate(segments(lines.length)):
                key = lines.keys(rows, at, size, lines.length, k).view(np.int64)
                yield pa.RecordBatch.from_arrays([pa.array(np.ones(len(key), np.int8)), pa.array(key), pa.array(lines.h.view(np.int64)), pa.array(bags), pa.array(twos)], names)


def _probing(once: np.ndarray, twice: np.ndarray):
    """Probes (key, h, bag, pairs) that the filters of index keys, and of those of several lines, let pass."""

    def probe(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for _, data, offsets in text_blocks(batch):
                _, _, start, end = _spans(data, offsets)
                hashed = SpanHasher(data)
                h = hashed(start, end)
                new = np.sort(np.unique(h, return_index=True)[1])  # a line that the block repeats probes once
                lines = _Long(data, hashed, start[new], end[new], h[new])
                keys, rows = [], []
                for less, k, own, at, size in probes(lines.length):
                    key = lines.keys(own, at, size, lines.length[own] - less, k)
                    itself = (at == segments(lines.length[own])[k][0]) if not less else np.zeros(len(own), bool)
                    ok = np.where(itself, in_bloom(twice, key), in_bloom(once, key))
                    keys.append(key[ok]), rows.append(own[ok])
                key, own = np.concatenate(keys), np.concatenate(rows)
                met, own = np.unique(own, return_inverse=True)
                bags, twos = lines.bags(met)
                yield pa.RecordBatch.from_arrays([pa.array(key.view(np.int64)), pa.array(lines.h.view(np.int64)[met][own]), pa.array(bags[own]), pa.array(twos[own])], ["key", "h", "bag", "pairs"])

    return probe


def _has_line(wanted: np.ndarray):
    """The wanted lines (h, line), by a filter of their hashes."""

    def pick(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for _, data, offsets in text_blocks(batch):
                _, _, start, end = _spans(data, offsets)
                h = SpanHasher(data)(start, end)
                at = np.flatnonzero(in_bloom(wanted, h))
                at = at[np.unique(h[at], return_index=True)[1]]
                yield pa.RecordBatch.from_arrays([pa.array(h[at].view(np.int64)), pa.array([data[a:b].tobytes().decode("utf-8", "replace") for a, b in zip(start[at], end[at], strict=True)], pa.string())], ["h", "line"])

    return pick


def segments(length: np.ndarray) -> list[tuple[np.ndarray, np.ndarray]]:
    """(start, size) of each of the EDITS + 1 segments of lines of these lengths; the last ones may be one longer."""
    n = EDITS + 1
    base, more = length // n, length % n
    out, start = [], np.zeros_like(length)
    for k in range(n):
        size = base + (k >= n - more)
        out.append((start, size))
        start = start + size
    return out


def probes(length: np.ndarray) -> Iterator[tuple[int, int, np.ndarray, np.ndarray, np.ndarray]]:
    """(less, segment, rows, start, size): substrings that lines of these lengths look up among lines so much shorter.

    With d more code points than the indexed line, segment k may have moved by -k to k as seen from the left, and by
    d - (EDITS - k) to d + (EDITS - k) as seen from the right.
    """
    for less in range(EDITS + 1):
        rows = np.flatnonzero(length - less >= LEAST)
        own = length[rows]
        for k, (start, size) in enumerate(segments(own - less)):
            for by in range(max(-k, less - (EDITS - k)), min(k, less + (EDITS - k)) + 1):
                at = start + by
                ok = (at >= 0) & (at + size <= own)
                yield less, k, rows[ok], at[ok], size[ok]


def _checked(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        ok = [within(x, y) for x, y in zip(batch.column("x").to_pylist(), batch.column("y").to_pylist(), strict=True)]
        yield pa.RecordBatch.from_arrays([batch.column("a"), batch.column("b")], ["a", "b"]).filter(pa.array(ok, pa.bool_()))


def line_links(docs: DataFrame, index: DataFrame) -> DataFrame:
    """(a, b): hashes h of the different lines at most EDITS edits apart; index has key, h, bag and pairs of all lines.

    Probes go to the join only if a filter of fixed size says that another line may have their key. The text of
    the lines that meet is fetched by such a filter too; both joins are exact.
    """
    index = stored(index.distinct(), "index")
    kinds = index.groupBy("key").agg(F.min("h").alias("lo"), F.max("h").alias("hi"))
    once, twice = bloom(index, BITS), bloom(kinds.where("lo <> hi"), BITS)
    x, y = index.alias("x"), docs.mapInArrow(_probing(once, twice), "key long, h long, bag long, pairs long").distinct().alias("y")
    # an edit changes the parity of two code points and of four pairs of neighbours at most
    met = x.join(y, F.expr(f"x.key = y.key and x.h <> y.h and bit_count(x.bag ^ y.bag) <= {2 * EDITS} and bit_count(x.pairs ^ y.pairs) <= {4 * EDITS}"))
    pairs = stored(met.select(F.greatest("x.h", "y.h").alias("a"), F.least("x.h", "y.h").alias("b")).distinct(), "pairs")
    ends = stored(pairs.select(F.explode(F.array("a", "b")).alias("key")).distinct(), "ends")  # read twice
    lines = docs.mapInArrow(_has_line(bloom(ends, BITS)), "h long, line string").join(ends.withColumnRenamed("key", "h"), "h", "left_semi")
    lines = stored(lines.groupBy("h").agg(F.min("line").alias("line")), "lines")
    left = pairs.join(lines.select(F.col("h").alias("a"), F.col("line").alias("x")), "a")
    both = left.join(lines.select(F.col("h").alias("b"), F.col("line").alias("y")), "b")
    return stored(both.select("a", "b", "x", "y").mapInArrow(_checked, "a long, b long"), "links")


def _kept_text(marks: str):
    """The rows with the lines that marks names taken out of their text."""

    def keep(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at, gone = batch.schema.get_field_index("text"), batch.column(marks)
            some = pc.fill_null(pc.greater(pc.list_value_length(gone), 0), False)
            texts = []
            for text, own in zip(batch.column(at).filter(some).to_pylist(), gone.filter(some).to_pylist(), strict=True):
                own = set(own)
                texts.append("\n".join(x for k, x in enumerate(line_list(text)) if k not in own))
            if texts:
                field = batch.schema.field(at)
                batch = batch.set_column(at, field, pc.replace_with_mask(batch.column(at), some, pa.array(texts, field.type)))
            yield batch

    return keep


_ADDED = ("n_lines", "n_gone", "n_links")


def deduplicated(docs: DataFrame, scope: str = "corpus") -> DataFrame:
    """The columns of docs, text without repeated lines, and n_lines, n_gone and n_links (long; columns of these names are replaced).

    Lines are cut at \\n and stripped of ASCII blanks; lines without more than blanks always stay and aren't counted.
    Lines are alike if equal or, from LEAST code points on, linked through lines at most EDITS edits apart. Of alike
    lines the first by (doc_id, hash of the text, line number) stays: in the corpus, or with scope "document" in each
    document. n_links counts the linked different lines of the document's lines. Null texts stay null. No rows give
    no rows. doc_id is cast to long; rows that repeat one, or have none, are told apart by their texts, and equal rows
    count as one document, which each of them is.
    """
    spark = docs.sparkSession
    bounded_batches(spark)
    docs = docs.select(*(c for c in docs.columns if c not in _ADDED))
    id_, key = F.coalesce(F.col("doc_id").cast("long"), F.lit(-1).cast("long")), F.xxhash64("text")
    slim = docs.select(id_.alias("doc_id"), key.alias("text_key"), "text")
    with scratch(spark):
        each = kept(stored(_marked(slim, scope), "marks"))
    of, at, marks = (unused(docs.columns, x) for x in ("of_doc", "of_text", "marks"))
    joined = docs.join(each.select(F.col("doc_id").alias(of), F.col("text_key").alias(at), F.struct(*_ADDED, "gone").alias(marks)), (id_ == F.col(of)) & (key == F.col(at)), "left")
    gone = unused(docs.columns, "gone")
    filled = joined.select(*(F.col(f"`{c}`") for c in docs.columns), *(F.coalesce(f"{marks}.{c}", F.lit(0).cast("long")).alias(c) for c in _ADDED), F.col(f"{marks}.gone").alias(gone))
    return filled.mapInArrow(_kept_text(gone), filled.schema).drop(gone)


def _marked(slim: DataFrame, scope: str) -> DataFrame:
    """(doc_id, text_key, n_lines, n_gone, n_links, gone) of the texts with a line."""
    rows = stored(slim.mapInArrow(_placed, _ROWS), "places")
    lines = rows.where("kind <> 1").selectExpr("kind = 2 AS head", "a AS doc_id", "b AS line_no", "c AS h", "d AS text_key")
    links = line_links(slim, rows.where("kind = 1").selectExpr("a AS key", "b AS h", "c AS bag", "d AS pairs"))
    degree = links.select(F.explode(F.array("a", "b")).alias("h")).groupBy("h").agg(F.count("*").alias("n"))
    near = stored(components(links).withColumnRenamed("node", "h").join(degree, "h"), "classes")
    placed = lines.join(near, "h", "left").select("head", "doc_id", "text_key", "line_no", F.coalesce("root", "h").alias("class"), F.coalesce("n", F.lit(0)).alias("n"))
    if scope == "document":
        own = ["doc_id", "text_key", "class"]
        first = placed.groupBy(*own).agg(F.min("line_no").alias("first_no"), F.max("line_no").alias("last_no")).where("last_no > first_no").drop("last_no")
        marked = placed.join(first, own, "left").withColumn("again", F.coalesce(F.col("line_no") > F.col("first_no"), F.lit(False)))
    else:
        place = F.struct("doc_id", "text_key", "line_no")
        first = placed.groupBy("class").agg(F.min(place).alias("first"), F.count("*").alias("places")).where("places > 1").drop("places")
        first = stored(first, "first")  # with no aggregate below the join, AQE may split the places of a hot class
        marked = placed.join(first, "class", "left").withColumn("again", F.coalesce(place > F.col("first"), F.lit(False)))
    equal = F.count_if("head")  # rows of one doc_id and text
    return marked.groupBy("doc_id", "text_key").agg(
        F.expr("count(*) div count_if(head)").alias("n_lines"), (F.count_if("again") / equal).cast("long").alias("n_gone"), (F.sum("n") / equal).cast("long").alias("n_links"), F.collect_set(F.when(F.col("again"), F.col("line_no"))).alias("gone")
    )
