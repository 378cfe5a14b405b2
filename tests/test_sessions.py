"""Streams of questions: answers with history in order, resets, timeouts, and starting again from the checkpoints."""

import json

import pytest

from folio.plans import engine
from folio.streaming import sessions

MD = [(1, 1, "# Intro\nThis is the intro.\n## Method\nWe weigh terms by rank."), (2, 1, "# Other\nRivers flow north.\n## More\nHills stand still.")]


@pytest.fixture(scope="module")
def corpus(spark):
    none = spark.createDataFrame([], "doc_id long, page long, img_pos long, b64 string, b64_len long")
    return engine.ingest(spark.createDataFrame(MD, "doc_id long, page long, md string"), none).stored()


def at(second):
    return f"2024-05-01 10:{second // 60:02}:{second % 60:02}"


def send(folder, name, rows):
    folder.mkdir(exist_ok=True)
    (folder / f"{name}.json").write_text("".join(json.dumps({"session_id": s, "at": at(t), "doc_id": d, "query": q}) + "\n" for s, t, d, q in rows))


def run(spark, corpus, tmp_path):
    """Both streams take what has arrived, and stop."""
    assert sessions.chatting(spark, str(tmp_path / "in"), corpus, str(tmp_path / "out"), max_files=1).awaitTermination(200) in (None, True)
    assert sessions.remembering(spark, str(tmp_path / "out"), timeout=600).awaitTermination(200) in (None, True)
    rows = sessions.history(spark, str(tmp_path / "out")).orderBy("session_id", "at").collect()
    return {(r["session_id"], r["query"], r["turn"]): (r["answer"], list(r["so_far"])) for r in rows}


def test_sessions_remember_reset_and_start_again(spark, corpus, tmp_path):
    send(tmp_path / "in", "1", [("a", 5, 1, "which terms are weighed"), ("a", 2, 1, "what intro"), ("b", 3, 2, "rivers flow where"), ("c", 4, 99, "a document that isn't there")])
    got = run(spark, corpus, tmp_path)
    assert got[("a", "what intro", 1)] == ("This is the intro.", [])
    assert got[("a", "which terms are weighed", 2)] == ("We weigh terms by rank.", ["what intro"])
    assert got[("b", "rivers flow where", 1)] == ("Rivers flow north.", []) and got[("c", "a document that isn't there", 1)] == (None, [])
    # New streams from the same checkpoints go on with the sessions.
    send(tmp_path / "in", "2", [("a", 30, 1, "terms again"), ("b", 31, 2, "/reset"), ("b", 32, 2, "rivers after reset"), ("b", 900, 2, "rivers after silence")])
    got = run(spark, corpus, tmp_path)
    assert got[("a", "terms again", 3)][1] == ["what intro", "which terms are weighed"]
    assert got[("b", "rivers after reset", 1)][1] == [] and got[("b", "rivers after silence", 1)][1] == []
    assert len(got) == 7
    send(tmp_path / "in", "3", [("a", 40, 1, None), ("a", 41, 1, "intro anew")])
    got = run(spark, corpus, tmp_path)
    assert got[("a", "intro anew", 1)][1] == [] and len(got) == 8
