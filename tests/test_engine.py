"""Ingestion, questions and plug-ins on small documents."""

import io
import json
import time
import urllib.error
import urllib.request

import pytest
from pyspark.sql import functions as F

from folio.errors import IngestionError
from folio.operators import answer, captions, graph, images, outline, pages, plugins, replies, search
from folio.plans import engine, store
from folio.sources import pages as source
from folio.streaming import ingestion

IMAGES = "doc_id long, page long, img_pos long, b64 string, b64_len long"
MD = [(1, 1, "# Intro\nThis is the intro."), (1, 2, "## Method\nWe weigh terms by rank. Ties go first.\nFig 1: the weights of all terms"), (1, 3, "## Results\nSee the table."), (2, 1, "no heading at all")]


@pytest.fixture(scope="module")
def corpus(spark):
    table = spark.createDataFrame(MD, "doc_id long, page long, md string")
    return engine.ingest(table, spark.createDataFrame([(1, 2, 0, "x" * 5000, 5000), (1, 3, 0, "y", 1)], IMAGES)).stored()


def test_ask_extracts_and_attaches(spark, corpus):
    questions = spark.createDataFrame([(1, 1, "how are terms weighed by rank"), (2, 1, "explain figure 1"), (3, 2, "anything"), (4, 1, "which graph")], "query_id long, doc_id long, query string")
    replies = spark.createDataFrame([(4, 1, '{"thinking": "t", "node_list": ["0002"]}')], "query_id long, doc_id long, raw string")
    got = {r["query_id"]: r for r in engine.ask(corpus, questions, replies=replies).collect()}
    assert got[1]["answer"] == "We weigh terms by rank." and got[1]["images"] == []
    assert len(got[2]["images"][0]) == 5000 and got[2]["sources"] == ["Section: 'Intro', Page 1-1"]  # the caption stands before the page's heading
    assert got[3]["answer"] == "no heading at all"
    assert got[4]["sources"] == ["Section: 'Method', Page 2-3"] and len(got[4]["images"]) == 1
    via = {r["query_id"]: r["via"] for r in engine.find(corpus, questions, replies=replies).collect()}
    assert via == {1: "bm25", 2: "figure", 3: "bm25", 4: "ranker"}


def test_extracts_lose_the_spaces_around_them_and_nothing_else(spark):
    cases = [("None here. A pear  \nend", "pear", "A pear"), ("0 pears 0", "pears", "0 pears 0"), ("no\n1 plum 1", "plum", "1 plum 1"), ("   \n first ", "absent", "first"), ("", "pear", "")]
    questions = spark.createDataFrame([(k, 1, x[1]) for k, x in enumerate(cases)], "query_id long, doc_id long, query string")
    found = spark.createDataFrame([(k, 1, 0, x[0]) for k, x in enumerate(cases)], "query_id long, doc_id long, seq long, content string")
    assert {r["query_id"]: r["answer"] for r in answer.extracts(questions, found).collect()} == {k: x[2] for k, x in enumerate(cases)}


def test_plug_ins(spark, corpus):
    questions = spark.createDataFrame([(1, 1, "terms")], "query_id long, doc_id long, query string")
    ranker = lambda prompt: '{"node_list": ["0003"]}' if '"title": "Results"' in prompt and "Query: terms" in prompt else None
    got = engine.ask(corpus, questions, ranker=ranker, answerer=lambda prompt, pictures: f"{len(pictures)} {prompt[-14:]}").first()
    assert got["answer"] == "0 See the table." or got["answer"].endswith("See the table.")
    slow = engine.find(corpus, questions, ranker=lambda prompt: time.sleep(20), timeout=0.2).first()
    assert slow["via"] == "bm25"
    assert replies.in_time(lambda: 1 / 0, 1) == (None, "ZeroDivisionError: division by zero")


def test_chat_client(monkeypatch):
    sent = []

    def answered(reply):
        def send(request, timeout):
            sent.append((request.full_url, json.loads(request.data)))
            if isinstance(reply, Exception):
                raise reply
            return io.BytesIO(json.dumps(reply).encode())

        monkeypatch.setattr(urllib.request, "urlopen", send)

    client = plugins.ChatClient("http://h:1/", "m")
    answered({"message": {"content": " {} "}})
    assert client.ranker()("p") == "{}" and sent[-1][1]["format"] == "json" and sent[-1][1]["options"] == {"num_ctx": 2048, "num_predict": 256}
    answered({"message": {"content": "answer"}})
    assert client.chat([{"role": "user", "content": "hi"}]) == "answer"
    assert sent[-1] == ("http://h:1/api/chat", {"model": "m", "messages": [{"role": "user", "content": "hi"}], "temperature": 0.0, "stream": False})
    answered({"response": "old"})
    assert client.chat([], model="other") == "old" and sent[-1][1]["model"] == "other"
    answered({"unknown": 1})
    with pytest.raises(ValueError):
        client.chat([])
    answered(urllib.error.HTTPError("u", 500, "no", None, None))
    with pytest.raises(urllib.error.HTTPError):
        client.chat([])
    monkeypatch.undo()
    assert not plugins.ChatClient("http://127.0.0.1:9", "m", 0.2).is_available()


def test_sources(spark, tmp_path):
    (tmp_path / "results").mkdir()
    shapes = {1: [{"page": 1, "md": "a"}, {"page": 2, "md": None, "text": "b"}], 2: {"pages": [{"page": 1, "md": "c"}, {"page": 2, "md": "d", "success": False}]}, 3: [{"pages": [{"page": 1, "md": "e"}]}, {"pages": [{"page": 2}]}]}
    for k, x in shapes.items():
        (tmp_path / "results" / f"{k}.json").write_text(json.dumps(x))
    got = source.read_pages(spark, str(tmp_path / "results"), "results")
    assert sorted(map(tuple, got.collect())) == [(1, 1, "a"), (1, 2, "b"), (2, 1, "c"), (3, 1, "e"), (3, 2, "")]
    source.write_texts(got, str(tmp_path / "texts"))
    assert "".join(p.read_text() for p in (tmp_path / "texts" / "doc_id=1").glob("*.txt")) == "--- Page 1 ---\na\n--- Page 2 ---\nb\n"
    with pytest.raises(IngestionError):
        source.read_pages(spark, "x", "pdf")
    placed = spark.createDataFrame([(1, 1, 2, "png", b"later", 80.0, 90.0, 842.0), (1, 1, 1, "png", b"first", 80.0, 90.0, 842.0), (1, 1, 0, "png", b"margin", 10.0, 90.0, 842.0), (1, 1, 3, "png", b"nowhere", None, None, 842.0)], "doc_id long, page long, img_idx long, ext string, content binary, y0 double, y1 double, height double")
    placed.write.parquet(str(tmp_path / "images"))
    got = source.read_images(spark, str(tmp_path / "images")).select("img_idx", "img_pos", F.unbase64("b64").cast("string"))
    assert sorted(map(tuple, got.collect())) == [(1, 0, "first"), (2, 1, "later")]


def test_stream(spark, tmp_path):
    spark.createDataFrame(MD, "doc_id long, page long, md string").coalesce(1).write.parquet(str(tmp_path / "in"))
    query = ingestion.ingesting(spark, str(tmp_path / "in"), spark.createDataFrame([(1, 2, 0, "x" * 5000, 5000)], IMAGES), str(tmp_path / "out"))
    query.awaitTermination(120)
    grown = store.Store(spark, str(tmp_path / "out")).corpus()
    assert grown.sections.count() == 5 and grown.claims.count() == 1


def test_repeated_pages_and_far_markers(spark):
    marked = spark.createDataFrame([(1, "lost\n--- Page 1 ---\nFig 1: first one\n--- Page 1 ---\nFig 2: second one\n--- Page 1 ---\nnothing")], "doc_id long, markdown string")
    parts = pages.split(marked).withColumnRenamed("text", "md")
    assert [r["label"] for r in captions.mined(parts, "part").collect()] == ["Fig 2"]
    assert sorted(r["label"] for r in captions.mined(parts).collect()) == ["Fig 1", "Fig 2"]
    sections = spark.createDataFrame([(1, 0, 1, 900_000_000), (1, 1, 70, 100), (1, 2, 5, 4)], "doc_id long, seq long, page_start long, page_end long")
    there = spark.createDataFrame([(1, 64), (1, 99), (1, 899_999_999), (2, 1)], "doc_id long, page long")
    assert sorted(map(tuple, images.in_ranges(sections, there).collect())) == [(1, 0, 64), (1, 0, 99), (1, 0, 899_999_999), (1, 1, 99)]


def test_nested_tree(spark, corpus):
    own = corpus.claims.join(corpus.images, ["doc_id", "page", "img_pos"]).select("doc_id", "seq", "page", "img_pos", "b64", "caption", "label")
    got = {r["doc_id"]: json.loads(r["tree"]) for r in outline.nested(corpus.sections, own).collect()}
    assert [n["title"] for n in got[1][0]["nodes"]] == ["Intro"] and [n["title"] for n in got[1][0]["nodes"][0]["nodes"]] == ["Method", "Results"]
    assert got[1][0]["nodes"][0]["nodes"][0]["image_labels"] == ["Fig 1"] and got[2][0]["nodes"] == []


def test_graph_of_nothing(spark):
    nothing = outline.parented(outline.nodes(spark.createDataFrame([(1, 0, "")], "doc_id long, line_no long, line string")))
    vertices, edges = graph.adjacency(nothing)
    assert [(r["id"], r["node_type"]) for r in vertices.collect()] == [("document", "document")] and edges.count() == 0


def test_terms_are_counted_in_as_many_tasks_as_the_session_asks_for(spark):
    """Small partitions of texts are not joined to one before their terms come out."""
    sections = spark.range(400).select((F.col("id") % 40).alias("doc_id"), (F.col("id") / 40).cast("long").alias("seq"), F.lit("Alpha title").alias("title"), F.when(F.col("id") % 40 > 0, F.concat(F.lit("alpha beta word"), (F.col("id") % 7).cast("string"))).alias("content"))
    got = search.weighted_terms(sections)
    assert got.rdd.getNumPartitions() == int(spark.conf.get("spark.sql.shuffle.partitions")) == 4
    one = {(r["seq"], r["term"]): r for r in got.where("doc_id = 1").collect()}
    assert one[0, "alpha"]["tf"] == 4 and one[0, "alpha"]["dl"] == 9 and one[0, "alpha"]["avgdl"] == 9.0 and one[0, "alpha"]["df"] == 10
    assert got.where("doc_id = 0").count() == 0  # their content is null


def test_captions_are_mined_once(spark):
    paged = spark.createDataFrame([(1, 1, "# A\nFig 1: a first caption\ntext")], "doc_id long, page long, md string")
    pictures = spark.createDataFrame([(1, 1, 0, "QUJD", 6000)], "doc_id long, page long, img_pos long, b64 string, b64_len long")
    corpus = engine.ingest(paged, pictures)
    assert corpus.images.first()["caption"] == "Fig 1: a first caption"
    for rows in (corpus.sections, corpus.images):
        assert "{5,120}" not in rows._jdf.queryExecution().optimizedPlan().toString()


def test_a_page_is_searched_for_captions_once(spark, tmp_path):
    """An inner explode brings a filter that matches the text again; each caption begins with a letter that is told first."""
    texts = ["x fIG 1: a first caption\ntable 2. of things fig 3: another\nFig 4: no", "none", None, "Fıg 5: without a dot\nTABLE\n\n6a: on two lines, Table 7 - no"]
    spark.createDataFrame([(1, k, x) for k, x in enumerate(texts)], "doc_id long, page long, md string").write.parquet(str(tmp_path / "pages"))
    got = captions.mined(spark.read.parquet(str(tmp_path / "pages")))
    assert got._jdf.queryExecution().optimizedPlan().toString().count("{5,120}") == 1
    assert sorted((r["page"], r["cap_pos"], r["full_caption"]) for r in got.collect()) == [(0, 0, "fIG 1: a first caption"), (0, 1, "table 2. of things fig 3: another"), (3, 0, "Fıg 5: without a dot"), (3, 1, "TABLE\n\n6a: on two lines, Table 7 - no")]


def test_terms_not_asked_for_stay_in_their_task(spark):
    sections = spark.createDataFrame([(1, 0, "Alpha", "beta beta gamma"), (1, 1, "Delta", "beta epsilon"), (1, 2, "", None), (2, 0, "Beta", "")], "doc_id long, seq long, title string, content string")
    asked = spark.createDataFrame([(1, "beta"), (1, "beta"), (1, "absent"), (2, "alpha"), (2, "beta"), (3, "beta")], "doc_id long, term string")
    whole = search.weighted_terms(sections)
    want = whole.join(asked.distinct(), ["doc_id", "term"], "left_semi").select(*whole.columns)
    got = search.weighted_terms(sections, asked)
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, want.collect())) and got.count() == 3
    assert {r["n"] for r in search.term_counts(sections, asked).where("doc_id = 1 and not mark").collect()} == {3}


def test_an_outline_takes_one_shuffle_of_its_pages(spark, tmp_path):
    """From pages to sections texts are dealt to a fixed number of tasks by document once, and not joined."""
    table = [(1, 2, "body\n# A [[PAGE_9]]\n"), (1, 1, "# First\n \none"), (1, 1, "twice"), (2, 1, "only a body"), (3, 4, "")]
    spark.createDataFrame(table, "doc_id long, page long, md string").write.parquet(str(tmp_path / "pages"))
    spark.createDataFrame([(1, 1, "Fig 1: above"), (2, 9, "Fig 2: no such page"), (None, 1, "x"), (3, 4, "a\nb")], "doc_id long, page long, lines string").write.parquet(str(tmp_path / "before"))
    own, before = (spark.read.parquet(str(tmp_path / x)) for x in ("pages", "before"))
    got = {r["doc_id"]: r["markdown"] for r in pages.assembled(own, before).collect()}
    assert got == {1: "--- Page 1 ---\nFig 1: above\n# First\n \none\n--- Page 1 ---\nFig 1: above\ntwice\n--- Page 2 ---\nbody\n# A [[PAGE_9]]\n", 2: "--- Page 1 ---\nonly a body", 3: "--- Page 4 ---\na\nb\n"}
    sections = outline.outline(pages.lines(pages.assembled(own, before)))
    plan = sections._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange") == 1 and "Join" not in plan and sections.rdd.getNumPartitions() == 4
    rows = sorted((r["doc_id"], r["seq"], r["title"], r["page_start"], r["page_end"], r["content"]) for r in sections.collect())
    assert rows == [(1, 0, outline.ROOT_TITLE, 1, 1, "Fig 1: above"), (1, 1, "First", 1, 1, "one\nFig 1: above\ntwice\nbody"), (2, 0, outline.ROOT_TITLE, 1, 1, "only a body"), (3, 0, outline.ROOT_TITLE, 1, 4, "a\nb")]


def test_a_document_that_begins_with_a_heading_has_a_root(spark):
    lines = [(1, 0, "# A"), (1, 1, "[[PAGE_7]]"), (1, 2, "text"), (2, 0, "[[PAGE_3]] # no heading"), (2, 1, "[[PAGE_99999999999999999999]]"), (2, 2, "## B")]
    got = outline.nodes(spark.createDataFrame(lines, "doc_id long, line_no long, line string")).drop("node_id")
    assert sorted(map(tuple, got.collect())) == [(1, 0, 0, outline.ROOT_TITLE, 1, 1, ""), (1, 1, 1, "A", 1, 1, "text"), (2, 0, 0, outline.ROOT_TITLE, 1, 3, ""), (2, 1, 2, "B", 3, 3, "")]
