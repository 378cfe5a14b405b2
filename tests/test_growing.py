"""What outlives a call: replies of models, corpora that grow, their index, own data sources, and counts of stages."""

import base64
import json
import os
import random
import re
import uuid
from pathlib import Path

import pytest
from pyspark.sql import functions as F

from folio.errors import IngestionError, ModelError, RetrievalError
from folio.operators import replies, search
from folio.plans import engine, index, store
from folio.sources import formats
from folio.streaming import ingestion

QUESTIONS = "query_id long, doc_id long, query string"
PAGES = "doc_id long, page long, md string"
PLACED = "doc_id long, page long, img_pos long, b64 string, b64_len long"
MD = [(d, p, f"# Part {p} of {d}\nSome words on topic{p} and more{d}.\nFig {p}: drawing of topic{p} number {d}\n## Detail {p}\nterms about item{p % 3}") for d in range(12) for p in range(1, 5)]


@pytest.fixture(scope="module")
def corpus(spark):
    placed = [(d, 2, 0, "x" * 5000, 5000) for d in range(12)]
    return engine.ingest(spark.createDataFrame(MD, PAGES), spark.createDataFrame(placed, PLACED)).stored()


def calls(folder):
    return sorted(Path(folder).iterdir())


def counting(folder, say):
    """A model that leaves a file for each call."""

    def model(prompt, *pictures):
        Path(folder, uuid.uuid4().hex).write_text(prompt)
        return say(prompt)

    return model


def test_a_random_ranker_is_asked_once_a_prompt(spark, corpus, tmp_path):
    (tmp_path / "calls").mkdir()
    ranker = counting(tmp_path / "calls", lambda p: random.choice([None, '{"node_list": ["0001"]}', '{"node_list": ["0002", "0003"]}', "no"]))  # noqa: S311
    questions = spark.createDataFrame([(k, k % 12, f"which section tells of topic{k % 4} please {k}") for k in range(60)] + [(60, 0, "explain figure 2")], QUESTIONS)
    found = engine.find(corpus, questions, ranker)
    got = {}
    for r in found.collect() + found.collect():  # a second reading asks nobody
        got.setdefault(r["query_id"], set()).add(r["via"])
    assert len(got) == 61 and all(len(ways) == 1 for ways in got.values()) and got[60] == {"figure"}
    assert {w for ways in got.values() for w in ways} == {"ranker", "bm25", "figure"}
    assert len(calls(tmp_path / "calls")) == 60


def test_a_job_that_starts_again_asks_what_is_missing(spark, tmp_path):
    (tmp_path / "calls").mkdir()
    prompts = spark.createDataFrame([(k, 0, f"prompt {k}") for k in range(30)], "query_id long, doc_id long, prompt string")
    log, first = str(tmp_path / "log"), counting(tmp_path / "calls", lambda p: p[::-1])
    assert replies.asked(prompts.where("query_id < 20"), first, log).count() == 20
    got = {r["query_id"]: r["raw"] for r in replies.asked(prompts, first, log).collect()}
    assert got == {k: f"prompt {k}"[::-1] for k in range(30)} and len(calls(tmp_path / "calls")) == 30
    os.remove(tmp_path / "log/wave=1/_SUCCESS")  # as if the second job had died while writing
    assert replies.asked(prompts, first, log).count() == 30 and len(calls(tmp_path / "calls")) == 40
    changed = prompts.withColumn("prompt", F.when(F.col("query_id") == 3, "new").otherwise(F.col("prompt")))
    assert {r["raw"] for r in replies.asked(changed.where("query_id = 3"), first, log).collect()} == {"wen"} and len(calls(tmp_path / "calls")) == 41
    twice = prompts.where("query_id = 7").unionByName(prompts.where("query_id = 7"))
    assert replies.asked(twice, first, log).count() == 1


def test_errors_are_rows(spark, tmp_path):
    import time

    prompts = spark.createDataFrame([(k, 0, ("bad", "slow", "good")[k % 3]) for k in range(24)], "query_id long, doc_id long, prompt string")

    def model(prompt):
        if prompt == "bad":
            raise RuntimeError("broken")
        if prompt == "slow":
            time.sleep(30)
        return prompt

    began = time.time()
    log = str(tmp_path / "log")
    got = {r["query_id"]: (r["raw"], r["error"]) for r in replies.asked(prompts, model, log, timeout=0.5).collect()}
    assert time.time() - began < 25  # 8 slow ones, at once
    assert all(got[k] == ((None, "RuntimeError: broken"), (None, "no reply within 0.5 s"), ("good", None))[k % 3] for k in range(24))
    again = replies.asked(prompts, lambda p: "better", log, again=True)
    assert all(r["raw"] == ("good" if r["query_id"] % 3 == 2 else "better") and r["error"] is None for r in again.collect())
    with pytest.raises(ModelError, match="broken"):
        replies.asked(prompts.where("prompt = 'bad'"), model, str(tmp_path / "down"), wave=2)


def test_an_answerer_that_fails_stops_nothing(spark, corpus):
    questions = spark.createDataFrame([(1, 1, "topic1 words"), (2, 2, "topic2 words")], QUESTIONS)
    rows = engine.ask(corpus, questions, answerer=lambda prompt, images: 1 / 0 if "topic1 words" in prompt else "fine").collect()
    assert {r["query_id"]: (r["answer"], r["error"] is None) for r in rows} == {1: (None, False), 2: ("fine", True)}


# --- the stored index ------------------------------------------------------------------


def _scores(rows):
    return sorted((r["query_id"], r["doc_id"], r["seq"], r["score"]) for r in rows.collect())


def test_index_equals_counting_and_meets_questions_without_a_shuffle(spark, corpus, tmp_path):
    questions = spark.createDataFrame([(k, k % 12, f"item{k % 3} terms topic{k % 5} drawing") for k in range(40)], QUESTIONS)
    own = index.stored(corpus.sections, str(tmp_path / "index"), parts=3, buckets=4)
    want = _scores(search.bm25(questions, corpus.sections))
    assert want and _scores(search.bm25(questions, corpus.sections, own.postings())) == want
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        plan = search.bm25(questions, corpus.sections, own.postings())._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    lines = plan.split("\n")
    at = next(k for k, line in enumerate(lines) if "FileScan" in line and "Bucketed: true" in line)
    depth, above = re.search("[A-Z]", lines[at]).start(), []
    for line in reversed(lines[:at]):  # what stands over the scan, up to the join
        if (start := re.search("[A-Z]", line).start()) < depth:
            depth = start
            above.append(line[start:].split(" ")[0].split("(")[0])
            if above[-1] == "SortMergeJoin":
                break
    assert above[-1] == "SortMergeJoin" and "Exchange" not in above, plan


def test_index_is_kept_by_document(spark, corpus, tmp_path):
    own = index.stored(corpus.sections, str(tmp_path / "index"), parts=3, buckets=4)
    changed = corpus.sections.where("doc_id in (2, 5)").withColumn("content", F.concat("content", F.lit(" novel novel item0")))
    own.update(changed, spark.createDataFrame([(7,)], "doc_id long"))
    now = corpus.sections.where("doc_id not in (2, 5, 7)").unionByName(changed)
    want = sorted(map(tuple, search.weighted_terms(now).drop("first").collect()))
    assert sorted(map(tuple, own.postings().select("doc_id", "seq", "term", "tf", "dl", "avgdl", "df", "idf").collect())) == want
    other = index.Index(spark, str(tmp_path / "index"), 3, 4)
    spark.sql(f"DROP TABLE {other.table}")  # another session's catalog knows nothing of it
    assert other.postings().count() == len(want)
    own.update(corpus.sections.where("false"), corpus.sections.select("doc_id"))
    assert own.postings().count() == 0
    with pytest.raises(RetrievalError):
        index.Index(spark, str(tmp_path / "none")).postings()


# --- growing ---------------------------------------------------------------------------


def _rows(df):
    return sorted(map(repr, (tuple(r) for r in df.select(*sorted(df.columns)).collect())))


def _same(a, b):
    return all(_rows(getattr(a, name)) == _rows(getattr(b, name)) for name in ("sections", "images", "claims"))


def test_late_and_repeated_pages_give_what_one_ingest_gives(spark, tmp_path):
    rng = random.Random(3)
    placed = spark.createDataFrame([(d, 2, k, str(k) * 5000, 5000) for d in range(12) for k in range(2)], PLACED)
    want = engine.ingest(spark.createDataFrame(MD, PAGES), placed).stored()
    arrivals = [(d, p, "# wrong\nold text", 0) for d, p, _ in MD if rng.random() < 0.3] + [(*r, 1) for r in MD] + [(*r, 1) for r in MD if rng.random() < 0.3]
    rng.shuffle(arrivals)
    own = store.Store(spark, str(tmp_path / "store"), buckets=3)
    ix = index.Index(spark, str(tmp_path / "index"), 2, 2)
    cut = [0, 25, 26, len(arrivals)]
    for a, b in zip(cut[:-1], cut[1:], strict=True):
        own.upsert(spark.createDataFrame(arrivals[a:b], f"{PAGES}, version long"), index=ix)
    own.upsert(images=placed.where("doc_id < 7"), index=ix)
    counted = own.upsert(images=placed.where("doc_id >= 6"), index=ix)
    assert _same(own.corpus(), want) and counted["documents"] == 6 and counted["images"]["rows"] == 12
    assert sorted(map(tuple, ix.postings().select("doc_id", "seq", "term", "tf", "idf").collect())) == sorted(map(tuple, search.weighted_terms(want.sections).select("doc_id", "seq", "term", "tf", "idf").collect()))
    kept = {p.name for t in ("sections", "images") for p in (tmp_path / "store" / t).glob("bucket=*/batch=*")}
    assert kept <= {"batch=2", "batch=3", "batch=4"}  # versions that no kept commit names are gone


def test_an_upsert_runs_again_after_a_failure(spark, tmp_path):
    own = store.Store(spark, str(tmp_path), buckets=2)
    one, two = spark.createDataFrame(MD[:6], PAGES), spark.createDataFrame(MD[4:], PAGES)
    own.upsert(one, number=0)
    before = own.corpus()
    own.upsert(two, number=1)
    os.remove(tmp_path / "commits/1.json")  # as if it had died just before its commit
    assert _same(own.corpus(), before)
    own.upsert(two, number=1)
    metrics = own.upsert(two, number=1)  # a third time: nothing happens
    assert metrics["pages"]["without_text"] == 0
    assert _same(own.corpus(), engine.ingest(spark.createDataFrame(MD, PAGES), spark.createDataFrame([], PLACED)).stored())
    with pytest.raises(IngestionError):
        own.upsert(one, number=-1)
    with pytest.raises(IngestionError):
        store.Store(spark, str(tmp_path / "empty")).corpus()


def test_a_stream_of_scattered_pages(spark, tmp_path):
    rows = MD[:]
    random.Random(5).shuffle(rows)
    for k in range(3):
        spark.createDataFrame([(*r, 1) for r in rows[k::3]], f"{PAGES}, version long").coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    query = ingestion.ingesting(spark, str(tmp_path / "in"), None, str(tmp_path / "out"), buckets=2, max_files=1)
    query.awaitTermination(240)
    own = store.Store(spark, str(tmp_path / "out"), 2)
    assert own.commits() == [0, 1, 2]
    assert _same(own.corpus(), engine.ingest(spark.createDataFrame(MD, PAGES), spark.createDataFrame([], PLACED)).stored())


# --- data sources ----------------------------------------------------------------------


def test_pages_source(spark, tmp_path):
    shapes = {1: [{"page": 1, "md": "a"}, {"page": 2, "md": None, "text": "b"}], 2: {"pages": [{"page": 1, "md": "c"}, {"page": 2, "md": "d", "success": False}]}, 3: [{"pages": [{"page": 1, "md": "e"}]}, {"pages": [{"page": 2}]}], 4: [], 5: "text"}
    for k, x in shapes.items():
        (tmp_path / f"{k}.json").write_text(json.dumps(x))
    (tmp_path / "6.json").write_text("{cut")
    (tmp_path / "noname.json").write_text("[]")
    (tmp_path / "7.json").write_bytes(b'["\xff"]')
    pages, errors = formats.read_results(spark, str(tmp_path), slice_=40)
    assert sorted(map(tuple, pages.collect())) == [(1, 1, "a"), (1, 2, "b"), (2, 1, "c"), (3, 1, "e"), (3, 2, "")]
    assert sorted((r["doc_id"] or 0, r["error"].split(":")[0]) for r in errors.collect()) == [(0, "ValueError"), (5, "TypeError"), (6, "JSONDecodeError"), (7, "UnicodeDecodeError")]
    rows = spark.read.format("folio_pages").option("slice", 1).load(str(tmp_path))
    assert rows.rdd.getNumPartitions() == 8  # a file each
    chosen = rows.where("doc_id in (1, 3)")
    assert chosen.rdd.getNumPartitions() == 2 and {r["doc_id"] for r in chosen.collect()} == {1, 3}
    assert rows.where("doc_id = 2 and page = 1").select("md").collect()[0]["md"] == "c"
    reader = formats.PageReader({"path": str(tmp_path)})
    assert len(list(reader.pushFilters([formats.In(("page",), (1,)), formats.EqualTo(("doc_id",), 1)]))) == 1 and reader.wanted == {1}


def test_image_sink(spark, tmp_path):
    rows = [(d, 1, k, "PNG" if k else None, base64.b64encode(f"image {d} {k}".encode()).decode()) for d in range(5) for k in range(3)]
    images = spark.createDataFrame(rows, "doc_id long, page long, img_pos long, ext string, b64 string").repartition(3)
    told = formats.write_images(images, str(tmp_path)).collect()
    assert len(told) == 15 and all((tmp_path / r["file"]).read_bytes() == f"image {r['doc_id']} {r['img_pos']}".encode() and r["bytes"] == 9 for r in told)
    bad = images.unionByName(spark.createDataFrame([(9, 1, 0, "png", "no base64!")], images.schema))
    files = lambda: sorted(p for p in tmp_path.rglob("*") if p.is_file() and ".crc" not in p.name)
    before = files()
    with pytest.raises(Exception, match="base64|Invalid|padding|Only"):
        formats.write_images(bad, str(tmp_path))
    assert files() == before  # nothing of a job that failed is left
    assert formats.write_images(bad, str(tmp_path), bad="skip").count() == 30
    assert formats.write_images(images.where("doc_id = 1").drop("ext"), str(tmp_path), mode="overwrite").count() == 3
    assert sum(p.suffix != ".jsonl" for p in files()) == 3 and len({p.name.split("-")[0] for p in files() if p.suffix == ".jsonl"}) == 1
    with pytest.raises(Exception, match="lack"):
        images.drop("b64").write.format("folio_images").mode("append").save(str(tmp_path))


def test_metrics_of_a_question(spark, corpus):
    metrics = engine.Metrics()
    questions = spark.createDataFrame([(1, 1, "topic1 words"), (2, 2, "explain figure 2"), (3, 3, "zzz")], QUESTIONS)
    engine.ask(corpus, questions, metrics=metrics).collect()
    assert metrics.values()["found"] == {"figure": 1, "ranker": 0, "bm25": 2}
