"""Periodic runs: stretches of words that repeat with a period, found by divide and conquer at midpoints.

A run is a stretch of words with smallest period q, of at least max(12, 2 q) words, that neither neighbour extends. Words are
interned, so all comparisons are exact. Each run lies in one stretch of words that are covered by windows of SEED words which
the text holds twice or more: both copies of each word of a run lie in such windows. The search works on these stretches
alone. A stretch is halved until it is too short for a run; at each midpoint two Z-functions give, for each q, how far the
words q apart stay equal to both sides, which yields every run that crosses the midpoint. A run is found whole at the one
midpoint that splits it within the smallest part that holds it, so repetitions that a neighbour of the part extends are left
to a larger part. What is found for the same stretch by several periods is one run, of the smallest.

A null or empty text has no words and no runs; ids are passed on as they are, null and repeated ones too.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import count

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from folio.llm.common import WORD, bounded_batches, mix, rolled, unused

#: Words that a run has at least.
SHORTEST = 12
#: Equal words that any run shares with itself shifted by its period, at least: max(SHORTEST - q, q) for a period of q.
SEED = SHORTEST // 2
#: Words of a part up to which its periods are tried one by one; beyond, all at once.
FEW = 160
RUNS = T.ArrayType(T.StructType([T.StructField(c, T.LongType()) for c in ("start", "length", "period")]))


def z_function(s: list[int]) -> list[int]:
    """For each position, how many items from there on equal the first ones; the whole length for position 0."""
    n = len(s)
    z = [0] * n
    if n:
        z[0] = n
    left = right = 0
    for i in range(1, n):
        k = 0
        if i < right:
            k = z[i - left]
            if k < right - i:
                z[i] = k
                continue
            k = right - i
        while i + k < n and s[k] == s[i + k]:
            k += 1
        z[i] = k
        if i + k > right:
            left, right = i, i + k
    return z


def _crossing(own: list[int], lo: int, mid: int, hi: int) -> list[tuple[int, int, int]]:
    """(start, end, period) of the repetitions of own[lo:hi] around mid, at least two periods and SHORTEST long, as far as they go within."""
    nl, nr = mid - lo, hi - mid
    part = own[lo:hi]
    ahead = z_function([*part[nl:], -1, *part])  # from nr + 1 on: equal words from a place and from mid on
    back = z_function([*part[:nl][::-1], -1, *part[::-1]])  # from nl + 1 on, from the end: equal words up to a place and up to mid
    if nl + nr > FEW:
        return _far_crossing(np.array(ahead), np.array(back), lo, mid, hi)
    found = []
    for q in range(1, nr + 1):  # the words from mid on equal those q to the right, and those before mid
        forth = ahead[nr + 1 + nl + q] if q < nr else 0
        behind = back[nl + 1 + nr - q] if q < nr or nl else 0
        n = behind + q + forth
        if n >= SHORTEST and n >= 2 * q:
            found.append((mid - behind, mid + q + forth, q))
    for q in range(1, nl + 1):  # those q to the left
        forth = ahead[nr + 1 + nl - q]
        behind = back[nl + 1 + nr + q] if q < nl else 0
        n = behind + q + forth
        if n >= SHORTEST and n >= 2 * q:
            found.append((mid - q - behind, mid + forth, q))
    return found


def _far_crossing(ahead: np.ndarray, back: np.ndarray, lo: int, mid: int, hi: int) -> list[tuple[int, int, int]]:
    """The same for a longer part, all periods at once."""
    nl, nr = mid - lo, hi - mid
    found = []
    for shift, most in ((1, nr), (-1, nl)):
        q = np.arange(1, most + 1)
        at = nl + shift * q  # within the part; its end may be hi
        forth = np.append(ahead[nr + 1 :], 0)[at]
        behind = np.append(back[nl + 1 :], 0)[nl + nr - at]
        start, stop = np.minimum(at, nl) - behind, np.maximum(at, nl) + forth
        good = (stop - start >= 2 * q) & (stop - start >= SHORTEST)
        found += zip((start[good] + lo).tolist(), (stop[good] + lo).tolist(), q[good].tolist(), strict=True)
    return found


def _stretches(ids: np.ndarray) -> list[tuple[int, int]]:
    """The longest stretches of words covered by windows of SEED words that come twice or more in the stretch.

    Equal hashes of other windows only lengthen them. A window whose likes all lie in other stretches isn't part of a run, for
    a run covers all words between its copies; what goes with it may part a stretch, so this is done again until none goes.
    """
    seeds = rolled(mix(ids.astype(np.uint64)), SEED)
    if not len(seeds):
        return []
    order = np.argsort(seeds, kind="stable")  # likes stand together, from left to right
    same = seeds[order[1:]] == seeds[order[:-1]]
    one, two = order[:-1][same], order[1:][same]
    while len(one):
        change = np.zeros(len(ids) + 1, np.int64)
        again = np.zeros(len(seeds), bool)
        again[one] = again[two] = True
        change[: len(seeds)] += again
        change[SEED : SEED + len(seeds)] -= again
        covered = np.concatenate(([False], np.cumsum(change[:-1]) > 0, [False]))
        edges = np.flatnonzero(covered[1:] != covered[:-1])
        first = edges[::2]
        near = np.searchsorted(first, one, "right") == np.searchsorted(first, two, "right")
        if near.all():
            return [(int(a), int(b)) for a, b in zip(first, edges[1::2], strict=True) if b - a >= SHORTEST]
        one, two = one[near], two[near]
    return []


def _within(own: list[int]) -> dict[tuple[int, int], int]:
    """{(start, end): period} of the runs of a stretch.

    What lies inside a long run of period q, beyond its first q words and short of its end, comes q words earlier too. Parts
    that are inside so are not searched; runs found in the first period are copied instead, until no run copies another.
    """
    found: dict[tuple[int, int], int] = {}
    spared: dict[tuple[int, int], int] = {}
    todo: list[tuple[int, int, list[tuple[int, int, int]]]] = [(0, len(own), [])]
    n = len(own)
    while todo:
        lo, hi, long = todo.pop()
        mid = (lo + hi) // 2
        for start, stop, q in _crossing(own, lo, mid, hi):
            # Neighbours outside the part must not go on with the period; within it none does.
            if start == lo and start > 0 and own[start - 1] == own[start - 1 + q] or stop == hi and stop < n and own[stop] == own[stop - q]:
                continue
            if q < found.get((start, stop), n):
                found[start, stop] = q
                if stop - start > q + SHORTEST:
                    long = [*long, (start, stop, q)]
        for a, b in ((lo, mid), (mid, hi)):
            if b - a < SHORTEST:
                continue
            around = next(((start, stop) for start, stop, q in long if start + q < a and b < stop), None)
            if around is None:
                todo.append((a, b, [r for r in long if r[0] + r[2] < b and a < r[1]]))
            else:
                spared[around] = found[around]
    before = -1
    while before < len(found):  # what one run copies may lie in the first period of another
        before = len(found)
        for (start, stop), q in sorted(spared.items(), key=lambda r: r[1]):
            for (a, b), p in [r for r in found.items() if start < r[0][0] <= start + q and r[0][1] < stop]:
                found |= {(a + k, b + k): p for k in range(q, stop - b, q)}
    return found


def runs_of(ids: list[int]) -> np.ndarray:
    """The runs of interned words, as rows (start, length, period) by start, then period."""
    rows = [(first + start, stop - start, q) for first, last in _stretches(np.array(ids, np.int64)) for (start, stop), q in _within(ids[first:last]).items()]
    return np.array(sorted(rows, key=lambda r: (r[0], r[2])), np.int64).reshape(-1, 3)


def _collapsed(words: list[bytes], runs: np.ndarray) -> bytes:
    """The words left when each run keeps its first period alone, joined by spaces."""
    if not len(runs):
        return b" ".join(words)
    change = np.zeros(len(words) + 1, np.int64)
    np.add.at(change, runs[:, 0] + runs[:, 2], 1)
    np.add.at(change, runs[:, 0] + runs[:, 1], -1)
    return b" ".join([words[k] for k in np.flatnonzero(np.cumsum(change[:-1]) == 0)])


def _searched(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The last column of each batch, a text, becomes its number of words, runs and collapsed text."""
    kind = pa.struct([("start", pa.int64()), ("length", pa.int64()), ("period", pa.int64())])
    for batch in batches:
        counts, offsets, texts, rows = [], [0], [], []
        for text in batch.column(batch.num_columns - 1).cast(pa.large_binary()):
            words = (text.as_py() or b"").split()  # cuts at the blanks of WORD
            known: dict[bytes, int] = {}
            own = runs_of(list(map(known.setdefault, words, count())))
            counts.append(len(words))
            rows.append(own)
            offsets.append(offsets[-1] + len(own))
            texts.append(_collapsed(words, own))
        flat = np.concatenate(rows) if rows else np.zeros((0, 3), np.int64)
        structs = pa.StructArray.from_arrays([pa.array(flat[:, k]) for k in range(3)], fields=list(kind))
        runs = pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), structs)
        new = [pa.array(counts, pa.int64()), runs, pa.array(texts, pa.binary()).cast(pa.string())]
        yield pa.RecordBatch.from_arrays([*batch.columns[:-1], *new], names=[str(k) for k in range(batch.num_columns + 2)])


def periodic(docs: DataFrame, text: str = "text") -> DataFrame:
    """docs with n_words, runs (an array of start, length and period, by start, then period) and collapsed, the text whose runs keep their first period.

    Columns of docs that have one of these names keep their values under the name with an underscore more. One pass, without
    a shuffle; a task holds one text and its runs at a time beside its batch.
    """
    bounded_batches(docs.sparkSession)
    new = ["n_words", "runs", "collapsed"]
    names: list[str] = []
    for c in docs.columns:
        names.append(unused([*new, *names, *(x for x in docs.columns if x != c)], c) if c.lower() in new else c)
    carried = docs.toDF(*names)
    source = names[docs.columns.index(text)]
    rows = carried.select("*", F.col(source).alias(unused(names, "searched")))
    schema = T.StructType([*carried.schema.fields, T.StructField("n_words", T.LongType()), T.StructField("runs", RUNS), T.StructField("collapsed", T.StringType())])
    return rows.mapInArrow(_searched, schema)


def looped(docs: DataFrame) -> DataFrame:
    """(doc_id, text): documents of which a tenth, told by a hash of the id, goes on in a loop.

    With h = crc32 of the decimal doc_id and g = h div 10: where h mod 10 is 0 and the text has n > 0 words, each word i from
    a = g mod n on becomes word a + (i - a) mod p, p = 1 + floor((n - a) / (3 + g mod 8)). Other texts, and those without an id,
    stay as they are.
    """
    h = F.crc32(F.col("doc_id").cast("string").cast("binary"))
    words = F.regexp_extract_all("text", F.lit(f"({WORD})"), F.lit(1))
    rows = docs.select("doc_id", "text", h.alias("h")).withColumn("w", F.when((F.col("h") % 10 == 0), words))
    rows = rows.withColumn("n", F.size("w")).withColumn("g", F.expr("h div 10")).withColumn("a", F.when(F.col("n") > 0, F.expr("cast(g % n as int)")))
    rows = rows.withColumn("p", F.expr("cast(1 + (n - a) div (3 + g % 8) as int)"))
    told = F.expr("array_join(transform(w, (x, i) -> if(i < a, x, w[a + (i - a) % p])), ' ')")
    return rows.select("doc_id", F.when(F.col("n") > 0, told).otherwise(F.col("text")).alias("text"))
