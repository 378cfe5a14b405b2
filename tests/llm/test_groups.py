"""Repeat groups: all occurrences of each, maximal where one anchor sees them whole, and what they cover is what op6 removes."""

import random
from collections import Counter

import pytest
from pyspark.sql import functions as F

from folio.llm import suffix


def corpus(seed):
    rng = random.Random(seed)
    text = lambda n: "".join(rng.choice("abcdefgh é\n") for _ in range(n))
    passages = [text(n) for n in (410, 415, 430, 700, 1600)]
    docs = []
    for _ in range(30):
        parts = []
        for _ in range(rng.randrange(4)):
            p = rng.choice(passages)
            cut = rng.choice([0, 0, 3, 12])
            parts += [text(rng.randrange(60)), p[cut:], text(rng.randrange(3))]
        docs.append("".join(parts))
    return passages, [*enumerate(docs), (900, None), (901, ""), (902, "x" * 1200), (903, docs[0]), (904, docs[0]), (None, docs[1])]


@pytest.mark.parametrize("most", [512, 3])
def test_groups_have_all_their_occurrences(spark, monkeypatch, most):
    monkeypatch.setattr(suffix, "MOST", most)
    passages, rows = corpus(3)
    raw = {i: (t or "").encode() for i, t in rows}
    docs = spark.createDataFrame([(i, t, "x") for i, t in rows], "doc_id long, text string, length string")
    got, seen = {}, {}
    for r in suffix.repeat_groups(docs).collect():
        got.setdefault((r["group"], r["length"]), []).append((r["doc_id"], r["begin"]))
    assert got and len({g for g, _ in got}) == len(got)
    for (_, n), places in got.items():
        own = {raw[i][b : b + n] for i, b in places}
        assert len(own) == 1 and n >= 400
        string = own.pop()
        want = [(i, b) for i, t in raw.items() for b in range(len(t) - n + 1) if t.startswith(string, b)]
        assert len(want) > 1 and sorted(places, key=str) == sorted(want, key=str)
        seen[string] = places
    if most == 512:  # what a few windows cover, and so mostly one anchor, comes out as it is, no shorter and no longer
        exact = 0
        for p in passages[:3]:
            p = p.encode()
            at = [(t, b) for t in raw.values() for b in range(len(t) - len(p) + 1) if t.startswith(p, b)]
            left = right = 0
            while all(b > left for _, b in at) and len({t[b - left - 1] for t, b in at}) == 1:
                left += 1
            while all(b + len(p) + right < len(t) for t, b in at) and len({t[b + len(p) + right] for t, b in at}) == 1:
                right += 1
            t, b = at[0]
            exact += len(at) > 1 and t[b - left : b + len(p) + right] in seen
        assert exact >= 2
    covered = {}
    for string, places in seen.items():
        for i, b in places:
            covered.setdefault(i, set()).update(range(b, b + len(string)))
    removed = {r["doc_id"]: r["n_removed"] for r in suffix.without_repeats(docs).collect()}
    assert removed == {i: len(covered.get(i, ())) for i in raw} and sum(removed.values()) > 5000


def test_groups_of_nothing(spark):
    assert suffix.repeat_groups(spark.createDataFrame([(1, "short"), (2, None)], "doc_id long, text string")).collect() == []


@pytest.mark.parametrize("adaptive", [False, True])
def test_rows_of_one_context_are_dealt_to_several_tasks(spark, monkeypatch, adaptive):
    """False: copies, whose anchors stay in their tasks. True: parts of contexts that agree, which AQE splits."""
    monkeypatch.setattr(suffix, "MOST", 8)
    n, passage = 240, "".join(random.Random(5).choices("abcdefgh é\n", k=900))
    conf = {"adaptive.enabled": adaptive, "adaptive.coalescePartitions.enabled": False, "adaptive.skewJoin.skewedPartitionThresholdInBytes": 100, "adaptive.skewJoin.skewedPartitionFactor": 1.0, "adaptive.advisoryPartitionSizeInBytes": 50, "autoBroadcastJoinThreshold": -1, "files.maxPartitionBytes": 1 << 20}
    before = {k: spark.conf.get(f"spark.sql.{k}") for k in conf}
    try:
        for k, v in conf.items():
            spark.conf.set(f"spark.sql.{k}", str(v).lower())
        docs = spark.range(n).select(F.col("id").alias("doc_id"), F.col("id").alias("text_key"), F.lit(passage).alias("text")).repartition(6)
        if adaptive:
            one = [F.lit(1).cast(kind).alias(c) for c, kind in (x.split() for x in suffix._CONTEXT.split(", ")) if c not in ("doc_id", "text_key", "before", "text")]
            parts = docs.select("doc_id", "text_key", F.lit(0).alias("before"), F.encode("text", "utf-8").alias("text"), *one)
            found = suffix._resolved(suffix.stored(parts, "parts"), 1)
        else:
            found = suffix.repeated(docs)
        dealt = Counter(r["task"] for r in found.withColumn("task", F.spark_partition_id()).collect())
    finally:
        for k, v in before.items():
            spark.conf.set(f"spark.sql.{k}", v)
    assert dealt.total() >= n > max(dealt.values())
