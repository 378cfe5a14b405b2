"""Chat sessions: a stream of messages becomes answers, and each session's history of turns in order.

Two streams, each with a checkpoint of its own, so that either starts again where it was. The first asks the corpus and writes a
folder per batch, which a repeated batch writes again. The second keeps state per session, reads these answers and numbers
the turns; a reset empties the session, as does a silence longer than its timeout.

    {target}/answers/batch=N       session_id, at, doc_id, query, answer, sources; query null: a reset
    {target}/history               session_id, turn, at, doc_id, query, answer, sources, so_far
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle, StreamingQuery

from folio import storage
from folio.operators import plugins
from folio.plans import engine

MESSAGES = "session_id STRING, at TIMESTAMP, doc_id BIGINT, query STRING"
ANSWERS = f"{MESSAGES}, answer STRING, sources ARRAY<STRING>"
HISTORY = "session_id STRING, turn BIGINT, at TIMESTAMP, doc_id BIGINT, query STRING, answer STRING, sources ARRAY<STRING>, so_far ARRAY<STRING>"
#: What a session's user types to begin anew: no text, or this.
RESET = "/reset"
#: Questions that a turn's so_far holds, the latest ones; the state holds no more.
REMEMBERED = 20


def answered(corpus: engine.Corpus, messages: DataFrame, **options) -> DataFrame:
    """Messages with answer and sources; resets have none, nor have questions on documents that the corpus lacks."""
    keyed = storage.written(messages.withColumn("query_id", F.xxhash64("session_id", "at", "doc_id", "query")), "messages")
    questions = keyed.where(~_is_reset()).select("query_id", "doc_id", "query").distinct().join(corpus.sections.select("doc_id").distinct(), "doc_id", "left_semi")
    told = engine.ask(corpus, questions.select("query_id", "doc_id", "query"), **options).select("query_id", "answer", "sources")
    return keyed.join(told, "query_id", "left").select("session_id", "at", "doc_id", "query", "answer", "sources")


def _is_reset():
    return F.col("query").isNull() | (F.trim("query").isin("", RESET))


class _Session(StatefulProcessor):
    """The turns of a session since its last reset: how many, the latest questions, and when the last one came."""

    def __init__(self, timeout: int | None) -> None:
        self.timeout = timeout

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.turns = handle.getValueState("turns", "n bigint, at double, questions array<string>")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        n, last, questions = (self.turns.get() if self.turns.exists() else None) or (0, None, [])
        questions = list(questions)
        out = []
        arrived = pd.concat(list(rows)).sort_values(["at", "query"], kind="stable", na_position="first")
        for row in arrived.itertuples(index=False):
            at = row.at.timestamp()
            if self.timeout is not None and last is not None and at - last > self.timeout:
                n, questions = 0, []
            last = at
            if row.query is None or row.query.strip() in ("", RESET):
                n, questions = 0, []
                continue
            n += 1
            out.append((key[0], n, row.at, row.doc_id, row.query, row.answer, row.sources, list(questions)))
            questions = [*questions, row.query][-REMEMBERED:]
        if n:
            self.turns.update((n, last, questions))
        elif self.turns.exists():
            self.turns.clear()
        yield pd.DataFrame(out, columns=[c.split()[0] for c in HISTORY.split(", ")])

    def close(self) -> None:
        pass


def chatting(spark: SparkSession, source: str, corpus: engine.Corpus, target: str, ranker: plugins.NodeRanker | None = None, answerer: plugins.Answerer | None = None, max_files: int | None = None) -> StreamingQuery:
    """Starts the first stream: messages from JSON files in source become answers in target. Replies of models are kept in target too."""

    def add(batch: DataFrame, number: int) -> None:
        rows = answered(corpus, batch, ranker=ranker, answerer=answerer, log=f"{target}/replies")
        rows.write.mode("overwrite").parquet(f"{target}/answers/batch={number}")

    arriving = spark.readStream.schema(MESSAGES)
    arriving = (arriving.option("maxFilesPerTrigger", max_files) if max_files else arriving).json(source)
    return arriving.writeStream.foreachBatch(add).option("checkpointLocation", f"{target}/progress-answers").trigger(availableNow=True).start()


def remembering(spark: SparkSession, target: str, timeout: int | None = None, max_files: int | None = None) -> StreamingQuery:
    """Starts the second stream: answers become the history of their sessions; after timeout seconds without a message a session begins anew."""
    storage.shipped(spark)
    provider = "spark.sql.streaming.stateStore.providerClass"
    if not spark.conf.get(provider, "").endswith("RocksDBStateStoreProvider"):  # the only one that holds such state
        spark.conf.set(provider, "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    arriving = spark.readStream.schema(ANSWERS)
    arriving = (arriving.option("maxFilesPerTrigger", max_files) if max_files else arriving).option("recursiveFileLookup", "true").parquet(f"{target}/answers")
    rows = arriving.groupBy("session_id").transformWithStateInPandas(_Session(timeout), HISTORY, "Append", "None")
    return rows.writeStream.format("parquet").option("path", f"{target}/history").option("checkpointLocation", f"{target}/progress-history").trigger(availableNow=True).start()


def history(spark: SparkSession, target: str) -> DataFrame:
    """All turns of all sessions so far."""
    return spark.read.schema(HISTORY).parquet(f"{target}/history")
