"""Exact repeated passages by common-prefix interval trees over a sparse suffix array.

Of every LENGTH consecutive bytes one position, their anchor, is chosen by the bytes alone (the least hash of
GRAM bytes), so equal passages of that length have equal anchors and only suffixes that start at anchors need
sorting. Anchors with equal GRAM bytes meet in one task with the text around them. There the suffixes are sorted, a
stack scan of the common prefixes of neighbours yields the tree of prefix intervals, and each interval's
members are sorted once more by what stands before them: members that differ to the left end the repeat there,
members that agree extend it. So every maximal repeat group comes out with all occurrences, not neighbours only.

Around an anchor stand the windows it was chosen for; anchors with all of that text equal are one context, known
by its hash and count, and need no sorting. Anchors that too many different contexts share are split by halves of
their windows, again and again, down to single windows if need be, so no task gets an unbounded group.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from folio.llm.common import _P, _P_INVERSE, _TABLE, _power, bounded_batches, kept, mix, scratch, span_hashes, stored, text_blocks

LENGTH, GRAM = 400, 32
WINDOW = LENGTH - GRAM + 1
#: Different contexts of one anchor that a task compares.
MOST = 512
_PLACE = 20  # bits for the place in a piece
_PIECE = 1 << (_PLACE - 1)


def _pieces(data: np.ndarray, offsets: np.ndarray) -> Iterator[tuple[int, np.ndarray, np.ndarray, int]]:
    """(row, bytes, offsets, first byte in the row) of stretches short enough for a place in one."""
    if len(data) < 1 << _PLACE:
        yield 0, data, offsets, 0
        return
    for row in range(len(offsets) - 1):
        own = data[offsets[row] : offsets[row + 1]]
        for at in range(0, max(len(own) - LENGTH + 1, 1), _PIECE):
            part = own[at : at + _PIECE + LENGTH - 1]
            yield row, part, np.array([0, len(part)]), at


def anchors(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, ...]:
    """(row, place, low, high, gram hash): each anchor with the first and last window start it was chosen for."""
    n = len(data) - GRAM + 1
    if n < WINDOW:
        return (np.zeros(0, np.int64),) * 4 + (np.zeros(0, np.uint64),)
    sums = np.zeros(len(data) + 1, np.uint64)
    np.cumsum(_TABLE[data] * _power(_P, len(data))[: len(data)], out=sums[1:])
    gram = mix((sums[GRAM:] - sums[:-GRAM]) * _power(_P_INVERSE, n)[:n])
    low_bits = np.uint64((1 << _PLACE) - 1)
    ranked = (gram & ~low_bits) | np.arange(n, dtype=np.uint64)
    padded = np.full(-(-n // WINDOW) * WINDOW, np.iinfo(np.uint64).max)
    padded[:n] = ranked
    square = padded.reshape(-1, WINDOW)
    prefix = np.minimum.accumulate(square, 1).ravel()
    suffix = np.minimum.accumulate(square[:, ::-1], 1)[:, ::-1].ravel()
    starts = n - WINDOW + 1
    chosen = (np.minimum(suffix[:starts], prefix[WINDOW - 1 : WINDOW - 1 + starts]) & low_bits).astype(np.int64)
    row = np.repeat(np.arange(len(offsets) - 1), np.diff(offsets))[:starts]
    valid = np.arange(starts) + LENGTH <= offsets[1:][row]
    new = np.ones(starts, bool)
    new[1:] = (chosen[1:] != chosen[:-1]) | (row[1:] != row[:-1]) | ~valid[:-1]
    low = np.flatnonzero(valid & new)
    end = np.ones(starts, bool)
    end[:-1] = new[1:] | ~valid[1:]
    high = np.flatnonzero(valid & end)
    return row[low], chosen[low], low, high, gram[chosen[low]]


_FOUND = "gram long, context long, doc_id long, text_key long, place long, low long, high long"


def _anchored(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for first, data, offsets in text_blocks(batch):
            for row0, part, cuts, at in _pieces(data, offsets):
                row, place, low, high, gram = anchors(part, cuts)
                if not len(row):
                    continue
                context = mix(span_hashes(part, low, high + LENGTH) + mix((place - low).astype(np.uint64) * np.uint64(1 << 12) + (high - place + WINDOW).astype(np.uint64)))
                base = cuts[row] - at
                yield pa.RecordBatch.from_arrays(
                    [pa.array(gram.view(np.int64)), pa.array(context.view(np.int64)), *(batch.column(c).take(pa.array(row + row0 + first)) for c in ("doc_id", "text_key")), *(pa.array(x - base) for x in (place, low, high))],
                    ["gram", "context", "doc_id", "text_key", "place", "low", "high"],
                )


#: gram and of are those of the anchor that a context, or a part of one, comes from.
_CONTEXT = "key long, context long, n long, doc_id long, text_key long, place long, before int, text binary, gram long, of long"


def _quoted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The text of each wanted context."""
    for batch in batches:
        for text, wanted, doc, key in zip(batch.column("text"), *(batch.column(c).to_pylist() for c in ("wanted", "doc_id", "text_key")), strict=True):
            raw = (text.as_py() or "").encode()
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array([x["gram"] for x in wanted], pa.int64()), pa.array([x["context"] for x in wanted], pa.int64()), pa.array([x["n"] for x in wanted], pa.int64()), pa.array([doc] * len(wanted), pa.int64()), pa.array([key] * len(wanted), pa.int64()),
                    pa.array([x["place"] for x in wanted], pa.int64()), pa.array([x["place"] - x["low"] for x in wanted], pa.int32()), pa.array([raw[x["low"] : x["high"] + LENGTH] for x in wanted], pa.binary()),
                    pa.array([x["gram"] for x in wanted], pa.int64()), pa.array([x["context"] for x in wanted], pa.int64()),
                ],
                ["key", "context", "n", "doc_id", "text_key", "place", "before", "text", "gram", "of"],
            )


def common(a: bytes, b: bytes) -> int:
    """Length of the common prefix."""
    lo, hi = 0, min(len(a), len(b))
    if a[:hi] == b[:hi]:
        return hi
    while lo < hi:
        mid = (lo + hi + 1) // 2
        if a[lo:mid] == b[lo:mid]:
            lo = mid
        else:
            hi = mid - 1
    return lo


def intervals(lcp: list[int]) -> Iterator[tuple[int, int, int]]:
    """(common prefix, first, last) of every interval of the tree, by a stack scan; lcp[k] is that of suffixes k - 1 and k."""
    stack: list[tuple[int, int]] = [(0, 0)]
    for k in range(1, len(lcp) + 1):
        now = lcp[k] if k < len(lcp) else 0
        left = k - 1
        while stack[-1][0] > now:
            depth, left = stack.pop()
            yield depth, left, k - 1
        if now > stack[-1][0]:
            stack.append((now, left))


def groups(contexts: list[tuple[int, bytes]], counts: list[int]) -> Iterator[tuple[int, int, list[int]]]:
    """(bytes before the anchor, bytes from it on, members) of every maximal repeat of at least LENGTH bytes among aligned contexts (bytes before the anchor, text).

    An interval of the tree of what follows the anchor holds the members that agree so far and no further. Sorted by what stands before,
    they form a tree again, whose intervals agree to the left so far and no further; those that all go on alike to the right
    belong to a deeper interval. A context that counts more than once is a group of its own.
    """
    after = [text[k:] for k, text in contexts]
    before = [text[:k][::-1] for k, text in contexts]
    order = sorted(range(len(contexts)), key=lambda i: after[i])
    rank = {i: k for k, i in enumerate(order)}
    lcp = [0] + [common(after[a], after[b]) for a, b in zip(order, order[1:], strict=False)]
    deepest = max(map(len, before), default=0)
    for i, n in enumerate(counts):
        if n > 1 and len(contexts[i][1]) >= LENGTH:
            yield contexts[i][0], len(after[i]), [i]
    for depth, first, last in intervals(lcp):
        if depth + deepest < LENGTH:
            continue
        members = sorted(order[first : last + 1], key=lambda i: before[i])
        shared = [0] + [common(before[a], before[b]) for a, b in zip(members, members[1:], strict=False)]
        found = list(intervals(shared)) if depth + max(shared) >= LENGTH else []
        if depth >= LENGTH and min(shared[1:]) == 0:
            found.append((0, 0, len(members) - 1))
        for left, a, b in found:
            if left + depth >= LENGTH:
                own = members[a : b + 1]
                if b - a < last - first:
                    places = [rank[i] for i in own]
                    if min(lcp[min(places) + 1 : max(places) + 1]) > depth:
                        continue
                yield left, depth, own


def repeats(contexts: list[tuple[int, bytes]]) -> dict[int, list[tuple[int, int]]]:
    """Of aligned contexts (bytes before the anchor, text): their stretches, from the anchor, in groups()."""
    out: dict[int, list[tuple[int, int]]] = {}
    for left, depth, members in groups(contexts, [1] * len(contexts)):
        for i in members:
            out.setdefault(i, []).append((-left, depth))
    return out


def _grouped(batches: Iterator[pa.RecordBatch]) -> Iterator[list[dict]]:
    """Rows of each key, which come sorted."""
    own: list[dict] = []
    for batch in batches:
        for row in batch.to_pylist():
            if own and own[-1]["key"] != row["key"]:
                yield own
                own = []
            own.append(row)
    if own:
        yield own


_RANGE = "doc_id long, text_key long, begin long, end long"


def _ranges(rows: list[tuple[int, int, int, int]]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], pa.int64()) for k in range(4)], ["doc_id", "text_key", "begin", "end"])


def _compared(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    out: list[tuple[int, int, int, int]] = []
    for own in _grouped(batches):
        for i, stretches in repeats([(x["before"], x["text"]) for x in own]).items():
            if own[i]["n"] == 1:
                out += [(own[i]["doc_id"], own[i]["text_key"], own[i]["place"] + a, own[i]["place"] + b) for a, b in stretches]
        if len(out) >= 1000:
            yield _ranges(out)
            out = []
    yield _ranges(out)


def _hash(*parts: bytes) -> int:
    return int.from_bytes(hashlib.blake2b(b"|".join(parts), digest_size=8).digest(), "little", signed=True)


def _halved(span: int):
    """Splits contexts by where their windows start: in stretches of span starts, counted back from the anchor."""

    def halves(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for x in batch.to_pylist():
                before, text = x["before"], x["text"]
                least, most = before - (len(text) - LENGTH), before  # how far before the anchor its windows start
                for part in range(least // span, most // span + 1):
                    a, b = max(least, part * span), min(most, part * span + span - 1)
                    core = text[before - part * span : before - part * span - span + 1 + LENGTH]  # is in all windows of the part
                    own = text[before - b : before - a + LENGTH]
                    out.append(x | {"key": _hash(str(span).encode(), str(part).encode(), core), "context": _hash(str(a).encode(), own), "before": b, "text": own})
            yield pa.RecordBatch.from_pylist(out, batch.schema)

    return halves


def _split(contexts: DataFrame, span: int) -> DataFrame:
    """Ranges of contexts whose key too many share."""
    parts = stored(contexts.mapInArrow(_halved(span), _CONTEXT), "parts")
    return _resolved(parts, span // 2)


def _resolved(parts: DataFrame, span: int) -> DataFrame:
    """Ranges (doc_id, text_key, begin, end) of the single contexts of parts: of repeats among the contexts of each key."""
    # Counts are stored before they are joined: AQE splits a hot key only where nothing stands between shuffle and join.
    same = stored(parts.groupBy("key", "context").agg(F.sum("n").alias("all")), "counts")
    keys = stored(same.groupBy("key").agg(F.count("*").alias("kinds"), F.sum("all").alias("rows"), F.min("all").alias("least")).where("rows > 1"), "keys")
    begin = F.col("place") - F.col("before")
    ranges = parts.where("n = 1").select("key", "context", "doc_id", "text_key", begin.alias("begin"), (begin + F.octet_length("text")).alias("end"))
    whole = ranges.join(same.where(F.col("all") > 1).select("key", "context"), ["key", "context"]).select("doc_id", "text_key", "begin", "end")
    firsts = parts.groupBy("key", "context").agg(F.min(F.struct("doc_id", "text_key", "place", "before", "text", "gram", "of")).alias("at"), F.sum("n").alias("n"))
    rest = stored(firsts.join(keys.where("kinds > 1 and least = 1"), "key").select("key", "context", "n", "at.*", "kinds"), "contested")
    out = whole.unionByName(_sorted(rest.where(F.col("kinds") <= MOST)))
    crowded = rest.where(F.col("kinds") > MOST)
    return out if crowded.isEmpty() else out.unionByName(_split(crowded.drop("kinds"), max(span, 1)))


def _sorted(contexts: DataFrame) -> DataFrame:
    own = contexts.select("key", "n", "doc_id", "text_key", "place", "before", "text")
    return own.repartition("key").sortWithinPartitions("key").mapInArrow(_compared, _RANGE)


def _contexts(docs: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame, DataFrame]:
    """All anchors; the contexts with their counts; the texts of those that must be compared; and the anchors' grams that too many share."""
    found = stored(docs.mapInArrow(_anchored, _FOUND), "anchors")
    same = stored(found.groupBy("gram", "context").agg(F.count("*").alias("n"), F.min(F.struct("doc_id", "text_key", "place", "low", "high")).alias("at")), "contexts")
    grams = stored(same.groupBy("gram").agg(F.count("*").alias("kinds"), F.min("n").alias("least")).where("kinds > 1 and least = 1"), "grams")
    contested = same.join(grams, "gram").select("gram", "context", "n", "at.*", "kinds")
    wanted = contested.groupBy("doc_id", "text_key").agg(F.collect_list(F.struct("gram", "context", "n", "place", "low", "high")).alias("wanted"))
    quoted = docs.join(wanted, ["doc_id", "text_key"]).select("doc_id", "text_key", "text", "wanted").mapInArrow(_quoted, _CONTEXT)
    kinds = grams.select(F.col("gram").alias("key"), "kinds")
    crowded = stored(kinds.where(F.col("kinds") > MOST), "crowded")
    return found, same, stored(quoted, "quoted"), crowded


def _again(found: DataFrame, same: DataFrame) -> DataFrame:
    """Anchors whose context is found again. Those of the commonest contexts, at most 10,000, are not shuffled, as their rows would meet in one task."""
    most, on = max(MOST, found.count() // 10_000), ["gram", "context"]
    hot, rest = (same.where(x).select(on) for x in (F.col("n") > most, F.col("n").between(2, most)))
    if hot.isEmpty():
        return found.join(rest, on)
    return found.join(F.broadcast(hot), on).unionByName(found.join(F.broadcast(hot), on, "left_anti").join(rest, on))


def repeated(docs: DataFrame) -> DataFrame:
    """(doc_id, text_key, begin, end): stretches of bytes of each text that are covered by LENGTH-byte strings found elsewhere too."""
    found, same, quoted, crowded = _contexts(docs)
    whole = _again(found, same).select("doc_id", "text_key", F.col("low").alias("begin"), (F.col("high") + LENGTH).alias("end"))
    out = whole.unionByName(_sorted(quoted.join(crowded, "key", "left_anti")))
    if not crowded.isEmpty():
        out = out.unionByName(_split(quoted.join(crowded, "key", "left_semi"), 128))
    return out


_MEMBER = "group long, length long, back long, key long, context long"


def _members(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The contexts of each maximal repeat, how long it is and how far before the anchor it begins."""
    for own in _grouped(batches):
        out = []
        for left, depth, members in groups([(x["before"], x["text"]) for x in own], [x["n"] for x in own]):
            x = own[members[0]]
            told = _hash(b"group", x["text"][x["before"] - left : x["before"] + depth])
            out += [(told, left + depth, left, own[i]["key"], own[i]["context"]) for i in members]
        yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in out], pa.int64()) for k in range(5)], [c.split()[0] for c in _MEMBER.split(", ")])


def repeat_groups(docs: DataFrame) -> DataFrame:
    """(group, length, doc_id, begin): every repeat of LENGTH bytes or more that is maximal in the text about an anchor, with all its occurrences.

    group is a hash of the repeated bytes, begin the first byte of an occurrence. A repeat is maximal if its occurrences neither
    all go on alike to the left nor to the right; one that is longer than the windows of its anchor comes out as a group for
    each of its anchors, which overlap, and one about a crowded anchor as groups of the parts of its windows. Rows that repeat a
    doc_id are told apart by their texts; equal rows have their occurrences once. Null ids come as null. The groups are stored and go with the session.
    """
    spark = docs.sparkSession
    bounded_batches(spark)
    lone = F.lit(-1).cast("long")
    known = docs.select(F.coalesce(F.col("doc_id").cast("long"), lone).alias("doc_id"), F.xxhash64("text").alias("text_key"), "text")
    with scratch(spark):
        found, same, quoted, crowded = _contexts(known)
        compare = lambda rows: rows.select(*(c.split()[0] for c in _CONTEXT.split(", "))).repartition("key").sortWithinPartitions("key").mapInArrow(_members, _MEMBER)
        # Contexts of a gram that nothing contests count as they are; their bytes needn't be fetched.
        sole = same.where("n > 1").join(quoted.select("gram", F.col("of").alias("context")), ["gram", "context"], "left_anti")
        all_ = sole.select(F.xxhash64("gram", "context").alias("group"), (F.col("at.high") - F.col("at.low") + LENGTH).alias("length"), (F.col("at.place") - F.col("at.low")).alias("back"), "gram", "context")
        own = compare(quoted.join(crowded, "key", "left_anti"))
        all_ = all_.unionByName(own.select("group", "length", "back", F.col("key").alias("gram"), "context"))
        rest, span = quoted.join(crowded, "key", "left_semi"), 128
        while not rest.isEmpty():
            parts = stored(rest.mapInArrow(_halved(span), _CONTEXT), "parts")
            firsts = parts.groupBy("key", "context").agg(F.min(F.struct("doc_id", "text_key", "place", "before", "text", "gram", "of")).alias("at"), F.sum("n").alias("n"))
            kinds = stored(firsts.groupBy("key").agg(F.count("*").alias("kinds"), F.sum("n").alias("all")).where("all > 1"), "kinds")
            firsts = stored(firsts.join(kinds, "key").select("key", "context", "n", "at.*", "kinds"), "firsts")
            own = compare(firsts.where(F.col("kinds") <= MOST))
            all_ = all_.unionByName(own.join(parts.select("key", "context", "gram", "of"), ["key", "context"]).select("group", "length", "back", "gram", F.col("of").alias("context")))
            rest = parts.join(firsts.where(F.col("kinds") > MOST).select("key").distinct(), "key", "left_semi")
            span = max(1, span // 2)
        held = found.join(stored(all_.distinct(), "spans"), ["gram", "context"])
        # one occurrence of a group may come by several windows
        rows = held.groupBy("group", "length", "doc_id", "text_key", (F.col("place") - F.col("back")).alias("begin")).agg(F.count("*").alias("_n"))
        rows = rows.select("group", "length", F.nullif("doc_id", lone).alias("doc_id"), "begin")
        return kept(stored(rows, "groups"))


def _removed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        out: tuple[list, ...] = ([], [], [], [])
        for text, begin, end in zip(batch.column("text"), batch.column("begins").to_pylist(), batch.column("ends").to_pylist(), strict=True):
            raw = (text.as_py() or "").encode()
            kept, at, gone, spans = hashlib.sha256(), 0, 0, 0
            for a, b in merged(begin or [], end or []):
                kept.update(raw[at:a])
                at, gone, spans = b, gone + b - a, spans + 1
            kept.update(raw[at:])
            for x, y in zip(out, (len(raw), gone, spans, kept.hexdigest()), strict=True):
                x.append(y)
        yield pa.RecordBatch.from_arrays([batch.column("doc_id"), *(pa.array(x, pa.int64()) for x in out[:3]), pa.array(out[3], pa.string())], ["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256"])


def merged(begin: list[int], end: list[int]) -> Iterator[tuple[int, int]]:
    """Maximal runs of the union; runs that touch are one."""
    last = None
    for a, b in sorted(zip(begin, end, strict=True)):
        if last and a <= last[1]:
            last = (last[0], max(last[1], b))
        else:
            if last:
                yield last
            last = (a, b)
    if last:
        yield last


def without_repeats(docs: DataFrame) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans and kept_sha256 of every document.

    Texts are UTF-8 bytes, null as empty. Each byte goes that a LENGTH-byte string covers which also starts anywhere
    else, in the same document too. Shorter texts lose nothing. Each row counts as a document of its own, rows that repeat
    a doc_id or have none as well. doc_id is cast to long. No rows give no rows.
    """
    spark = docs.sparkSession
    bounded_batches(spark)
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64("text").alias("text_key"), "text")
    known = docs.withColumn("doc_id", F.coalesce("doc_id", F.lit(-1).cast("long")))
    with scratch(spark):
        gone = repeated(known).groupBy("doc_id", "text_key").agg(F.collect_list("begin").alias("begins"), F.collect_list("end").alias("ends"))
        gone = kept(stored(gone.select(F.col("doc_id").alias("of"), F.col("text_key").alias("at"), "begins", "ends"), "ranges"))
    joined = docs.join(gone, (F.coalesce("doc_id", F.lit(-1).cast("long")) == F.col("of")) & (F.col("text_key") == F.col("at")), "left")
    return joined.select("doc_id", "text", "begins", "ends").mapInArrow(_removed, "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string")
