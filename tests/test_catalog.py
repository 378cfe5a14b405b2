"""Each query against its SQL, and outlines against a sequential model."""

import os
import random

import duckdb
import pytest

from folio import catalog
from folio.operators import outline

DATA = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for f in os.listdir(DATA):
        con.execute(f"CREATE VIEW {f.removesuffix('.parquet')} AS SELECT * FROM '{DATA}/{f}'")
    return con


def rows(columns, values):
    order = sorted(range(len(columns)), key=lambda k: columns[k])
    return sorted(repr([round(v[k], 9) if isinstance(v[k], float) else v[k] for k in order]) for v in values)


@pytest.mark.parametrize("name", list(catalog.QUERIES))
def test_query_equals_its_sql(spark, duck, name):
    got = catalog.QUERIES[name](spark, DATA)
    want = duck.execute(catalog.ORACLES[name])
    columns = [x[0] for x in want.description]
    assert sorted(got.columns) == sorted(columns)
    assert rows(got.columns, [tuple(r) for r in got.collect()]) == rows(columns, want.fetchall())


def model(lines):
    """Parent and last page of each section, by a stack."""
    page, nodes, stack = 1, [[0, 1, 1, None, []]], [0]
    for line in lines:
        if line.startswith("[[PAGE_"):
            page = int(line[7:-2])
            nodes[stack[-1]][2] = page
        elif line.startswith("#"):
            level = len(line.split(" ")[0])
            while nodes[stack[-1]][0] >= level:
                stack.pop()
            nodes.append([level, page, page, stack[-1], []])
            nodes[stack[-1]][4].append(len(nodes) - 1)
            stack.append(len(nodes) - 1)

    def finish(k):
        children = nodes[k][4]
        for c, after in zip(children, [*children[1:], None], strict=False):
            end = nodes[after][1] if after is not None else nodes[k][2]
            nodes[c][2] = max(nodes[c][1], end)
            finish(c)

    finish(0)
    return [(k, n[3], n[1], n[2]) for k, n in enumerate(nodes)]


def test_outline_equals_a_stack_on_random_documents(spark):
    rng = random.Random(3)
    docs = [[f"[[PAGE_{rng.randint(1, 9)}]]" if rng.random() < 0.3 else "#" * rng.randint(1, 6) + " t" if rng.random() < 0.6 else "body" for _ in range(25)] for _ in range(60)]
    lines = spark.createDataFrame([(d, k, x) for d, own in enumerate(docs) for k, x in enumerate(own)], "doc_id long, line_no long, line string")
    got = {}
    for r in outline.outline(lines).select("doc_id", "seq", "parent_seq", "page_start", "page_end").collect():
        got.setdefault(r[0], []).append(tuple(r)[1:])
    for d, own in enumerate(docs):
        assert sorted(got[d]) == model(own), own
