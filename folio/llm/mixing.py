"""Mixing sources to target weights by weighted fair queueing.

A source's documents queue in a fixed shuffled order. A document's virtual finish time is the words of its
source up to its end, over the source's target; sources with a target above their size queue again, up to
REPEATS times in all. All turns of all sources stand in one order, that of the times at which half of a turn is
served (the finish time less half the document's own share, so that a source ends within half a document of its
aim and not a whole one short). Their words are summed up along that order, and it is cut where half of a turn
is past the total budget. No task sorts all turns: words are summed by ranges of time, and only the range in which
the budget runs out is looked at again, in ever finer ranges.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from folio.llm.common import kept, scratch, stored, unused
from folio.llm.rules import word_list

REPEATS = 3
#: Documents that one task orders.
RUN = 2000
#: Ranges of time that words are summed by at a time; so many rows reach the driver.
RANGES = 1024


def targets(sized: DataFrame) -> DataFrame:
    """(source, source_size, target) of each source; sized has source and size.

    Sources by code point, null last, weigh 1, 2, 3, repeating. They share all words by weight, but none gets over
    REPEATS times its size; what is above is shared by the others. The level L with sum(min(cap, L * weight)) = all is
    the largest of the levels that filling the first k caps (by cap over weight) leaves to the rest.
    """
    sources = sized.groupBy("source").agg(F.sum("size").alias("source_size"))
    order = Window.orderBy(F.col("source").asc_nulls_last())
    weighed = sources.withColumn("weight", (F.row_number().over(order) - 1) % 3 + 1).withColumn("cap", REPEATS * F.col("source_size"))
    by_cap = Window.orderBy(F.col("cap") / F.col("weight"), F.col("source").asc_nulls_last())
    run = by_cap.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    level = (F.sum("source_size").over(Window.partitionBy()) - F.sum("cap").over(run) + F.col("cap")) / (F.sum("weight").over(Window.partitionBy()) - F.sum("weight").over(run) + F.col("weight"))
    out = weighed.withColumn("level", level.cast("double")).withColumn("level", F.max("level").over(Window.partitionBy()))
    return out.select("source", "source_size", F.least(F.col("cap").cast("double"), F.col("level") * F.col("weight")).alias("target"))


_ADDED = ("size", "source_size", "target", "copies", "taken", "virtual_finish")


def mixed(docs: DataFrame) -> DataFrame:
    """docs with size, source_size, target, copies, taken and virtual_finish (columns of these names are replaced).

    size counts the words of the text (null and empty: 0). copies: how many of the document's turns the mix takes, each
    whole; none of a document without words. taken is copies * size. virtual_finish is that of the first turn (null where
    the target is 0). Equal shuffle keys, those of rows that repeat a doc_id or have none, go by size, then by a hash of
    the text; turns of equal time by key, source and place. No rows give no rows. No task holds a source: its order is
    cut into runs by the key's first digits, and the words before each run come from the sums of runs.
    """
    own = [c for c in docs.columns if c not in _ADDED]
    n = {x: unused([*own, *_ADDED], x) for x in ("queue", "key", "run", "tie", "before", "ends", "source_size", "target")}
    queue = F.coalesce(F.concat(F.lit("="), F.col("source").cast("string")), F.lit(""))
    keyed = docs.select(
        *(F.col(f"`{c}`") for c in own), F.size(word_list(F.coalesce("text", F.lit("")))).cast("long").alias("size"), queue.alias(n["queue"]), F.md5(F.coalesce(F.col("doc_id").cast("string"), F.lit(""))).alias(n["key"]), F.xxhash64("text").alias(n["tie"])
    )
    with scratch(docs.sparkSession):
        slim = stored(keyed.select(F.col("source").cast("string").alias("source"), "size", F.col(n["queue"]).alias("queue"), F.col(n["key"]).alias("key")), "sizes")
        digits = max(1, math.ceil(math.log(max(slim.count(), 1) / RUN + 1, 16)))
        slim = slim.withColumn("run", F.substring("key", 1, digits))
        aims = targets(slim.select("source", "size")).withColumn("queue", F.coalesce(F.concat(F.lit("="), "source"), F.lit("")))
        runs = slim.groupBy("queue", "run").agg(F.sum("size").alias("sum"))
        before = F.sum("sum").over(Window.partitionBy("queue").orderBy("run").rowsBetween(Window.unboundedPreceding, Window.currentRow)) - F.col("sum")
        runs = kept(stored(runs.withColumn("before", before).join(aims, "queue").select("queue", "run", "before", "source_size", "target"), "runs"))
        within = Window.partitionBy("queue", "run").orderBy("key", "size").rowsBetween(Window.unboundedPreceding, Window.currentRow)
        turns = slim.where("size > 0").join(runs, ["queue", "run"]).withColumn("ends", F.col("before") + F.sum("size").over(within)).where("target > 0")
        turns = turns.withColumn("turn", F.explode(F.array(*(F.lit(e) for e in range(REPEATS)))))
        turns = stored(turns.select(_served_at(F.col("turn")).alias("at"), "key", "queue", "ends", "turn", "size"), "turns")
        last = _cut(turns, slim.agg(F.sum("size")).first()[0] or 0)
    runs = runs.select(*(F.col(c).alias(n[c]) for c in runs.columns))
    within = Window.partitionBy(n["queue"], n["run"]).orderBy(n["key"], "size", n["tie"]).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    df = keyed.withColumn(n["run"], F.substring(n["key"], 1, digits)).join(runs, [n["queue"], n["run"]]).withColumn(n["ends"], F.col(n["before"]) + F.sum("size").over(within))
    size, target = F.col("size"), F.col(n["target"])
    copies = F.lit(0).cast("long")
    for e in range(REPEATS):
        at = _served_at(F.lit(e), n["ends"], n["source_size"], n["target"])
        taken = F.lit(True) if last is None else F.struct(at, n["key"], n["queue"], n["ends"], F.lit(e)) < F.struct(*(F.lit(x).cast(t) for x, t in zip(last, ("double", "string", "string", "long", "int"), strict=True)))
        copies = copies + F.when((size > 0) & (target > 0), taken.cast("long")).otherwise(0)
    df = df.withColumn(n["before"], copies)  # from here on: copies
    return df.select(
        *(F.col(f"`{c}`") for c in own), "size", F.col(n["source_size"]).alias("source_size"), target.alias("target"), F.col(n["before"]).alias("copies"), (F.col(n["before"]) * size).alias("taken"), F.when(target > 0, F.col(n["ends"]) / target).alias("virtual_finish")
    )


def _served_at(turn: Column, ends: str = "ends", source_size: str = "source_size", target: str = "target") -> Column:
    """The virtual time at which half of a document is served in a turn."""
    return F.try_divide(2.0 * (turn * F.col(source_size) + F.col(ends)) - F.col("size"), 2.0 * F.col(target))


def _cut(turns: DataFrame, budget: int) -> tuple | None:
    """(at, key, queue, ends, turn) of the first turn half of which is past the budget, by the order of these; None if there is none.

    Words are summed by RANGES ranges of time; of the one in which the sum passes the budget, and the next with a turn, finer
    ranges are made in turn, until a task can sort what is left.
    """
    low, high, n = turns.agg(F.min("at"), F.max("at"), F.count("*")).first()
    served = 0  # words of the turns before low
    while n > RUN and high > low:
        here = turns.where(F.col("at").between(low, high))
        place = F.least(F.floor((F.col("at") - low) / (high - low) * RANGES), F.lit(RANGES - 1))
        found = sorted(tuple(r) for r in here.groupBy(place.alias("range")).agg(F.min("at"), F.max("at"), F.count("*"), F.sum("size")).collect())
        k, sums = 0, served
        while k < len(found) - 1 and sums + found[k][4] <= budget:
            sums += found[k][4]
            k += 1
        both = found[k : k + 2]
        if sum(x[3] for x in both) == n:
            break
        low, high, n, served = both[0][1], both[-1][2], sum(x[3] for x in both), sums
    order = Window.orderBy("at", "key", "queue", "ends", "turn").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    rest = turns.where(F.col("at").between(low, high)).withColumn("sum", F.lit(served) + F.sum("size").over(order))
    first = rest.where(2 * F.col("sum") - F.col("size") > 2 * budget).select(F.min(F.struct("at", "key", "queue", "ends", "turn")).alias("first")).first()[0]
    return tuple(first) if first else None


def served(mix: DataFrame) -> DataFrame:
    """The documents that the mix takes, range-sorted by virtual finish time, ties by doc_id."""
    return mix.where("copies > 0").repartitionByRange(F.col("virtual_finish"), F.col("doc_id")).sortWithinPartitions("virtual_finish", "doc_id")


SQL = r"""
WITH sized AS (SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+'))::BIGINT AS size FROM documents),
sources AS (SELECT source, sum(size)::BIGINT AS source_size FROM sized GROUP BY source),
weighed AS (SELECT *, (row_number() OVER (ORDER BY source ASC NULLS LAST) - 1) % 3 + 1 AS weight, 3 * source_size AS cap FROM sources),
levels AS (
  SELECT *, (sum(source_size) OVER () - sum(cap) OVER o + cap)::DOUBLE / (sum(weight) OVER () - sum(weight) OVER o + weight)::DOUBLE AS level FROM weighed
  WINDOW o AS (ORDER BY cap::DOUBLE / weight, source ASC NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)),
aims AS (SELECT source, source_size, least(cap::DOUBLE, (SELECT max(level) FROM levels) * weight) AS target FROM levels),
queued AS (
  SELECT d.doc_id, d.size, d.source, a.source_size, a.target, md5(d.doc_id::VARCHAR) AS key,
    sum(d.size) OVER (PARTITION BY d.source ORDER BY md5(d.doc_id::VARCHAR), d.size ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS ends
  FROM sized d JOIN aims a ON d.source IS NOT DISTINCT FROM a.source),
turns AS (SELECT q.*, e, (2.0::DOUBLE * (e * source_size + ends)::DOUBLE - size::DOUBLE) / (2.0::DOUBLE * target) AS moment FROM queued q, range(3) r(e) WHERE size > 0 AND target > 0),
ran AS (SELECT *, row_number() OVER o AS place, sum(size) OVER o AS words FROM turns WINDOW o AS (ORDER BY moment, key, source ASC NULLS FIRST, ends, e ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)),
cut AS (SELECT min(place) AS at_place FROM ran WHERE 2 * words - size > 2 * (SELECT sum(source_size) FROM sources)),
copied AS (SELECT doc_id, source, ends, count(*) AS copies FROM ran WHERE place < coalesce((SELECT at_place FROM cut), 1 << 62) GROUP BY ALL)
SELECT q.doc_id, q.size, q.source_size, q.target, (q.size * coalesce(c.copies, 0))::BIGINT AS taken
FROM queued q LEFT JOIN copied c ON q.doc_id = c.doc_id AND q.ends = c.ends AND q.source IS NOT DISTINCT FROM c.source AND q.size > 0
"""
