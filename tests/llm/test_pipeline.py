"""Stages of the corpus pipeline on small tables."""

import random

import corpus_pipeline


def test_lines_go_across_documents(spark):
    shared = "a line that stands in more than one document"
    rows = [(1, f"first\n{shared}"), (2, f"{shared}\nsecond"), (3, f"third\n{shared}."), (4, f"first\n{shared}"), (5, None), (6, "")]
    docs = spark.createDataFrame([(i, t, len(t or "")) for i, t in rows], "doc_id long, text string, n_chars long")
    got = {r["doc_id"]: (r["text"], r["n_chars"]) for r in corpus_pipeline.dedup_lines(spark, docs, "").collect()}
    assert got == {1: (f"first\n{shared}", 6 + len(shared)), 2: ("second", 6), 3: ("third", 5), 5: (None, 0), 6: ("", 0)}


def test_documents_without_an_id_stay(spark):
    text = " ".join(f"w{k}" for k in range(40))
    docs = spark.createDataFrame([(1, text), (2, text), (None, "of its own, with no copy at all"), (3, "another text that has no copy")], "doc_id long, text string")
    got = [r["doc_id"] for r in corpus_pipeline.dedup_documents(spark, docs, "").collect()]
    assert sorted(got, key=lambda x: x or 0) == [None, 1, 3]


def test_whole_pipeline(spark, tmp_path):
    """Planted cases go, clean documents stay up to the mix, and an empty table runs through."""
    rng = random.Random(3)
    words = ["".join(rng.choice("abcdefghijklm") for _ in range(rng.randint(3, 8))) for _ in range(500)]
    prose = lambda n: " ".join(rng.choice(words) for _ in range(n))
    leak, twin = prose(30), prose(80)
    rows = [(k, prose(60) + (" vilezz rottenqq" if k % 5 == 0 else ""), "en", "ab"[k % 2]) for k in range(200)]
    rows += [(300, twin, "en", "a"), (301, twin + " end", "en", "b"), (302, f"{prose(20)} {leak} {prose(20)}", "en", "a"), (303, None, "en", None), (304, "", "en", "a"), (None, prose(50), "en", "a")]
    frame = spark.createDataFrame([(*r, len(r[1] or "")) for r in rows], "doc_id long, text string, lang string, source string, n_chars long")
    frame.write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(k, int(k % 5 == 0), 1) for k in range(0, 200) if k % 3], "doc_id long, toxic int, quality int").write.parquet(f"{tmp_path}/labels.parquet")
    spark.createDataFrame([(1, leak)], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    docs, seen = frame, {}
    for name, stage in corpus_pipeline.STAGES:
        docs = stage(spark, docs, str(tmp_path))
        if name != "mixing":
            assert docs.columns == frame.columns
        docs.write.parquet(f"{tmp_path}/{name}")
        docs = spark.read.parquet(f"{tmp_path}/{name}")
        seen[name] = {r["doc_id"] for r in docs.collect()}
    clean = {k for k in range(200) if k % 5}
    assert not any(k % 5 == 0 for k in seen["toxicity"] if k is not None and k < 200) and len(clean - seen["toxicity"]) <= 8
    assert {300, 301, 302, 303, 304, None} <= seen["toxicity"]
    assert seen["line_dedup"] - {301} == seen["toxicity"] - {301}
    assert 300 in seen["near_dedup"] and 301 not in seen["near_dedup"]
    assert seen["decontamination"] == seen["near_dedup"] - {302}
    assert seen["mixing"] <= seen["decontamination"] and 303 not in seen["mixing"]
    assert {r["doc_id"] for r in corpus_pipeline.run(spark, str(tmp_path)).collect()} == seen["mixing"]
    empty = tmp_path / "empty"
    for name in ("documents", "labels", "benchmark"):
        spark.read.parquet(f"{tmp_path}/{name}.parquet").limit(0).write.parquet(f"{empty}/{name}.parquet")
    assert corpus_pipeline.run(spark, str(empty)).count() == 0
