"""Every set of substitutions that the limit of a leak allows leaves a seed."""

import itertools
import random

import numpy as np
import pytest

from folio.llm import decontaminate as d


def keys(row, n):
    first = np.array([0, len(row)])
    found = [(h, v) for _, h, v in d.seeds(row, first)] if n >= d.SPAN else list(d.whole(row, first, n))
    return [set(enumerate(h[v].tolist())) for h, v in found]


@pytest.mark.parametrize("n", range(1, d.STRETCH + 1))
def test_each_pattern_leaves_a_seed(n):
    own = np.random.default_rng(n).integers(1, 1 << 63, n, dtype=np.uint64)
    want = keys(own, n)
    most = max(k for k in range(n) if d.EQUAL[1] * (n - k) >= d.EQUAL[0] * n)
    for size in range(most + 1):
        for at in itertools.combinations(range(n), size):
            row = own.copy()
            row[list(at)] += np.uint64(1)
            assert any(a & b for a, b in zip(want, keys(row, n), strict=True)), at


def test_substituted_items_are_leaks(spark):
    rng = random.Random(4)
    sizes = (1, 2, 3, 4, 5, 6, 7, 8, 9, 10, 11, 12)
    items = [" ".join(f"i{n}x{k}" for k in range(n)) for n in sizes]
    docs, want = [], set()
    for i, n in enumerate(sizes):
        for changed in range(4):
            for at in itertools.islice(itertools.combinations(range(n), changed), 12):
                own = [x if k not in at else "other" for k, x in enumerate(items[i].split())]
                if 10 * (n - changed) >= 8 * n:
                    want.add((len(docs), i, n - changed))
                docs.append(" ".join([*(f"f{rng.randint(0, 99)}" for _ in range(9)), *own, "end"]))
    table = spark.createDataFrame(list(enumerate(docs)), "doc_id long, text string")
    bench = spark.createDataFrame(list(enumerate(items)), "item_id long, text string")
    assert {tuple(r)[:3] for r in d.leaks(table, bench).collect()} == want


def test_repeated_tokens_equal_brute_force(spark):
    """Few different tokens, in turn or at random, so that seeds come again and again; items of 1 to 30 tokens."""
    rng = random.Random(9)
    make = lambda n: [rng.choice(("a", "b")) for _ in range(n)] if rng.random() < 0.5 else (["x", "y", "z", "x"] * n)[:n]
    items = [make(n) for n in (1, 2, 3, 4, 4, 6, 9, 12, 20, 25, 30)] + [["w"] * 40, ["q"], [f"d{k % 7}" for k in range(30)]]
    docs = [make(rng.randrange(60)) for _ in range(40)] + [["w"] * 300, [], ["q", *["w"] * 20, "q"], [f"d{k % 7}" for k in range(3, 90)]]
    want = set()
    for i, own in enumerate(docs):
        for j, item in enumerate(items):
            n = min(len(item), 20)
            at = lambda k, own=own: own[k] if 0 <= k < len(own) else None  # noqa: E731  where a seed fits, a stretch may begin before the document, or end after it
            found = [(sum(at(b + k) == item[a + k] for k in range(n)), -b) for a in range(len(item) - n + 1) for b in (range(1 - n, len(own)) if n >= d.SPAN else range(len(own) - n + 1))]
            best = max(found, default=(0, 0))
            if found and 10 * best[0] >= 8 * n:
                want.add((i, j, best[0], n, -best[1]))
    table = spark.createDataFrame([(i, " ".join(x)) for i, x in enumerate(docs)], "doc_id long, text string")
    bench = spark.createDataFrame([(i, " ".join(x)) for i, x in enumerate(items)], "item_id long, text string")
    assert len(want) > 100 and {tuple(r) for r in d.leaks(table, bench).collect()} == want


def test_one_token_over_and_over_takes_no_square(spark):
    text = "ab " * 20_000
    frame = lambda key: spark.createDataFrame([(1, text)], f"{key} long, text string")
    hits = frame("doc_id").mapInArrow(d._probing(np.full(1 << (d.BITS - 3), 255, np.uint8), []), "key long, doc_id long, doc_at long, around binary")
    assert hits.count() < 9 * 2 * d.AROUND
    assert d.leaks(frame("doc_id"), frame("item_id")).first()["matched"] == 20
