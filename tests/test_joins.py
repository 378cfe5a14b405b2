"""Containment and grid joins against comparing all pairs, and trees that go out and come back."""

import json
import random

from pyspark.sql import functions as F

from folio import fixtures, storage
from folio.operators import captions, containment, graph, images, outline
from folio.plans import engine


def test_contained_equals_all_pairs(spark):
    rng = random.Random(4)
    word = lambda: "".join(rng.choice("abé") for _ in range(rng.randrange(1, 5)))
    texts = [(d, k, " ".join(word() for _ in range(rng.choice([0, 1, 5, 300])))) for d in range(4) for k in range(6)] + [(1, 99, None), (2, 98, "\n" * 20 + "a\nb" * 200)]
    patterns = []
    for d in range(5):
        for _ in range(40):
            t = rng.choice([x for i, _, x in texts if i == d or d == 4] or [""]) or ""
            a = rng.randrange(len(t) + 1)
            patterns.append((d, t[a : a + rng.choice([1, 3, 7, 8, 14, 15, 16, 40, 300])]))
        patterns += [(d, "zz"), (d, "zzzzzzzzzzzzzzzzzzzzzzzz"), (d, ""), (d, None)]
    got = containment.contained(spark.createDataFrame(patterns, "doc_id long, pattern string"), spark.createDataFrame(texts, "doc_id long, text_id long, text string"))
    want = {(d, p, k) for d, p in patterns for i, k, t in texts if p and i == d and t and p in t}
    rows = [tuple(r) for r in got.select("doc_id", "pattern", "text_id").collect()]
    assert len(want) > 100 and len(rows) == len(set(rows)) and set(rows) == want


def test_only_places_that_begin_a_pattern_leave_their_task(spark):
    """1000 texts of 6000 characters; 20 of them hold the patterns of their document, the others only part of them."""
    text = F.concat_ws(" ", F.transform(F.sequence(F.lit(1), F.lit(1000)), lambda i: F.substring(F.md5(F.concat(i.cast("string"), F.lit("-"), F.col("id").cast("string"))), 1, 5)))
    texts = spark.range(1000).select((F.col("id") % 20).alias("doc_id"), F.col("id").alias("text_id"), F.concat(text, F.when(F.col("id") < 20, " the pattern here é").otherwise(" the pattern her")).alias("text"))
    patterns = spark.range(20).select(F.col("id").alias("doc_id"), F.explode(F.array(F.lit("the pattern here é"), F.lit("re é"))).alias("pattern"))
    named, keys = containment.met_by_key(patterns, texts)
    assert named.count() == 40 and 40 <= keys.count() < 100
    got = containment.contained(patterns, texts).collect()
    assert sorted((r["doc_id"], r["text_id"]) for r in got) == sorted((k, k) for k in range(20) for _ in range(2))


def test_the_item_graph_plans_its_tree_once(spark):
    """Of the windows of the tree none is left in the plans over it; formulas are numbered by one."""
    turns = spark.createDataFrame([(1, k, "user" if k % 2 else "assistant", f"turn {k}") for k in range(6)], "conv_id long, turn long, role string, text string")
    path = storage.fresh_path(spark, "items", temporary=True)
    turns.write.parquet(f"{path}/conversations.parquet")
    refs = turns.select(F.col("conv_id").alias("doc_id"), F.col("turn").alias("ref_no"), F.lit("fig_0").alias("target_node_id"), F.col("text").alias("context"))
    edges = graph.item_adjacency(graph.item_tree(fixtures.items(spark, path)), refs)[1]
    assert edges._jdf.queryExecution().optimizedPlan().toString().count("Window [") <= 1
    assert {(r["source"], r["target"]) for r in edges.where("edge_type = 'references'").collect()} == {(f"tree_{k:04d}", "fig_0") for k in range(6)}
    assert containment.contained(refs.select("doc_id", F.lit(None).cast("string").alias("pattern")), refs.select("doc_id", F.col("ref_no").alias("text_id"), F.col("context").alias("text"))).count() == 0


def test_tag_sources_equal_all_pairs(spark):
    rng = random.Random(5)
    name = lambda: "".join(rng.choice("ab1.") for _ in range(rng.randrange(0, 7))) * rng.choice([1, 1, 4])
    tags = [(d, k, name()) for d in range(5) for k in range(12)]
    files = [(d, k, name()) for d in range(4) for k in range(9)] + [(0, 9, None)]
    got = captions.tag_sources(spark.createDataFrame(tags, "doc_id long, pos long, tag string"), spark.createDataFrame(files, "doc_id long, file_no long, name string"))
    want = sorted((d, k, t, next((n for i, _, n in files if i == d and n is not None and (t in n or n in t)), None)) for d, k, t in tags)
    assert sorted(map(tuple, got.collect()), key=lambda r: r[:3]) == sorted(want, key=lambda r: r[:3]) and any(r[3] for r in want)


def by_hand(pictures, spans):
    out = []
    for d, p, k, x0, x1, y0, y1 in pictures:
        near = [s for s in spans if s[:2] == (d, p) and s[2] < x1 + 20 and s[3] > x0 - 20]
        low = sorted((s[4], s[2], s[6]) for s in near if s[4] < y1 + 50 and s[5] > y1)
        high = sorted((s[4], s[2], s[6]) for s in near if not (s[4] < y1 + 50 and s[5] > y1) and s[4] < y0 and s[5] > y0 - 50)
        text = lambda rows: " ".join(" ".join(r[2] for r in rows).split())
        out.append((d, p, k, text(low) or text(high) or captions.NO_CAPTION))
    return sorted(out)


def test_zone_captions_equal_all_pairs(spark):
    rng = random.Random(6)
    rect = lambda wide: (lambda x, y: (x, x + rng.uniform(0, wide), y, y + rng.uniform(0, wide)))(rng.uniform(-50, 700), rng.uniform(-50, 900))
    pictures = [(d, p, k, *rect(300)) for d in range(2) for p in range(3) for k in range(7)] + [(5, 1, 0, 10.0, 20.0, 10.0, 20.0)]
    spans = [(d, p, *rect(90), f"s{d}{p}{k}  x") for d in range(2) for p in range(4) for k in range(60)] + [(0, 0, -1e9, 1e9, -1e9, 1e9, "everywhere"), (5, 1, 0.0, 40.0, 25.0, 30.0, "below"), (5, 1, None, 40.0, 25.0, 30.0, "nowhere")]
    got = images.zone_captions(spark.createDataFrame(pictures, "doc_id long, page long, img_pos long, x0 double, x1 double, y0 double, y1 double"), spark.createDataFrame(spans, "doc_id long, page long, x0 double, x1 double, y0 double, y1 double, text string"))
    assert sorted(map(tuple, got.collect())) == by_hand(pictures, [s for s in spans if s[2] is not None])


def test_a_page_of_many_spans_meets_its_tiles_only(spark):
    """40000 spans and 400 images of one page: pairs that share a tile are few of the 16 million."""
    spans = spark.range(40_000).select(F.lit(1).cast("long").alias("doc_id"), F.lit(1).cast("long").alias("page"), (F.col("id") % 200 * 50.0).alias("x0"), (F.col("id") % 200 * 50.0 + 40).alias("x1"), (F.expr("id div 200") * 50.0).alias("y0"), (F.expr("id div 200") * 50.0 + 12).alias("y1"), F.col("id").cast("string").alias("text"))
    pictures = spark.range(400).select(F.lit(1).cast("long").alias("doc_id"), F.lit(1).cast("long").alias("page"), F.col("id").alias("img_pos"), (F.col("id") % 20 * 500.0).alias("x0"), (F.col("id") % 20 * 500.0 + 30).alias("x1"), (F.expr("id div 20") * 500.0).alias("y0"), (F.expr("id div 20") * 500.0 + 30).alias("y1"))
    got = images.zone_captions(pictures, spans)
    assert got.where(F.col("caption") == captions.NO_CAPTION).count() == 0


def test_trees_go_out_and_come_back(spark):
    rng = random.Random(7)
    lines = []
    for d in range(6):
        own, level = [], 0
        for k in range(40):
            if rng.random() < 0.6:
                level = min(6, level + 1) if rng.random() < 0.6 else rng.randint(1, max(1, level))
                own.append(f"{'#' * level} head \"{k}\" of {d}")
            else:
                own.append(rng.choice(["[[PAGE_%d]]" % (k + 1), 'text with "quotes" \\ and é', "- list"]))
        lines += [(d, k, x) for k, x in enumerate(own)]
    sections = outline.outline(spark.createDataFrame(lines, "doc_id long, line_no long, line string"))
    held = spark.createDataFrame([(d, s, 1, k, f"b64 {d} {s} {k}", f"Fig {k}: a thing", f"Fig {k}") for d in range(6) for s in (0, 2, 3) for k in range(2)], "doc_id long, seq long, page long, img_pos long, b64 string, caption string, label string")
    trees = outline.nested(sections, held)
    back, pictures = outline.unnested(trees)
    columns = ["doc_id", "seq", "node_id", "title", "content", "parent_seq", "page_start", "page_end", "depth"]
    got, want = ([tuple(r) for r in x.select(*columns).orderBy("doc_id", "seq").collect()] for x in (back, sections))
    assert got == want and max(r[-1] for r in want) >= 6
    assert sorted(map(tuple, pictures.select("doc_id", "seq", "b64", "caption", "label").collect())) == sorted(map(tuple, held.select("doc_id", "seq", "b64", "caption", "label").collect()))
    order = pictures.select("doc_id", "seq", "page", "img_pos", "b64", "caption", "label")
    assert sorted(map(tuple, outline.nested(back, order).collect())) == sorted(map(tuple, trees.collect()))


def test_trees_of_others(spark):
    deep = {"title": "leaf", "nodes": []}
    for k in range(30):
        deep = {"title": f"t{k}", "nodes": [deep, {"title": "side"}]}
    trees = [(1, json.dumps(deep)), (2, "[]"), (3, None), (4, "no json"), (5, json.dumps([{"node_id": "a", "title": "one", "content": "weights of terms", "page_start": 3}, {"node_id": "b", "title": "two"}]))]
    corpus = engine.from_trees(spark.createDataFrame(trees, "doc_id long, tree string"))
    rows = corpus.sections.orderBy("doc_id", "seq").collect()
    assert [r["doc_id"] for r in rows] == [1] * 61 + [5] * 2 and max(r["depth"] for r in rows) == 30
    assert [r["node_id"] for r in rows if r["doc_id"] == 5] == ["a", "b"] and rows[-2]["page_end"] == 3 and rows[-1]["page_start"] == 1
    answer = engine.ask(corpus, spark.createDataFrame([(1, 5, "which weights")], "query_id long, doc_id long, query string")).first()
    assert answer["answer"] == "weights of terms" and answer["sources"] == ["Section: 'one', Page 3-3"]
