"""Replies of models as durable tables: each prompt is asked once, and a job that starts again asks only what is missing.

A log is a folder of waves. A wave holds the replies to at most WAVE prompts, is written by one Spark job and counts once that
job has left its mark (_SUCCESS), so a job that dies loses the replies of one wave at most. What no wave holds is asked. A row
stands for (query_id, doc_id) and the md5 of its prompt: a prompt that has changed since, as when a document was ingested anew,
is another one. Speculative copies of tasks would ask twice: leave spark.speculation off, as it is by default.
"""

from __future__ import annotations

import threading
from collections.abc import Callable, Iterator
from queue import Empty, SimpleQueue

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from folio import storage
from folio.errors import ModelError

#: Prompts of a wave, calls that a task makes at once, and prompts that it takes at a time.
WAVE, AT_ONCE, BATCH = 20_000, 8, 64
SCHEMA = "query_id long, doc_id long, prompt_md5 string, raw string, error string"
_KEY = ["query_id", "doc_id", "prompt_md5"]


def in_time(call: Callable[[], str | None], seconds: float) -> tuple[str | None, str | None]:
    """(reply, error) of a call; a call that takes longer is left to end by itself."""
    got: list[tuple[str | None, str | None]] = []

    def run() -> None:
        try:
            got.append((call(), None))
        except Exception as error:  # noqa: BLE001  whatever a model's client raises is told in the row
            got.append((None, f"{type(error).__name__}: {error}"))

    thread = threading.Thread(target=run, daemon=True)
    thread.start()
    thread.join(seconds)
    return got[0] if got else (None, f"no reply within {seconds:g} s")


def at_once(calls: list[Callable[[], str | None]], seconds: float, most: int = AT_ONCE) -> list[tuple[str | None, str | None]]:
    """in_time() of each call, so many at the same time; each has its own deadline."""
    out: list[tuple[str | None, str | None]] = [(None, None)] * len(calls)
    todo: SimpleQueue[int] = SimpleQueue()
    for k in range(len(calls)):
        todo.put(k)

    def work() -> None:
        while True:
            try:
                k = todo.get_nowait()
            except Empty:
                return
            out[k] = in_time(calls[k], seconds)

    threads = [threading.Thread(target=work, daemon=True) for _ in range(min(most, len(calls)))]
    for thread in threads:
        thread.start()
    for thread in threads:
        thread.join()
    return out


def _asking(model: Callable, seconds: float, most: int, pictures: bool):
    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            for at in range(0, len(frame), BATCH):
                own = frame.iloc[at : at + BATCH]
                given = [(p, list(x) if x is not None else []) for p, x in zip(own["prompt"], own["images"], strict=True)] if pictures else [(p,) for p in own["prompt"]]
                told = at_once([lambda g=g: model(*g) for g in given], seconds, most)
                yield own[_KEY].assign(raw=[r for r, _ in told], error=[e for _, e in told])

    return run


def _waves(spark: SparkSession, log: str) -> list[int]:
    """The numbers of the log's finished waves."""
    path = spark._jvm.org.apache.hadoop.fs.Path(log)
    fs = path.getFileSystem(spark._jsc.hadoopConfiguration())
    if not fs.exists(path):
        return []
    found = (x.getPath().getName() for x in fs.listStatus(path))
    return sorted(int(n[5:]) for n in found if n.startswith("wave=") and fs.exists(spark._jvm.org.apache.hadoop.fs.Path(f"{log}/{n}/_SUCCESS")))


def known(spark: SparkSession, log: str) -> DataFrame:
    """The replies that a log holds."""
    waves = _waves(spark, log)
    return spark.read.schema(SCHEMA).parquet(*(f"{log}/wave={n}" for n in waves)) if waves else spark.createDataFrame([], SCHEMA)


def asked(prompts: DataFrame, model: Callable, log: str | None = None, timeout: float = 15.0, most: int = AT_ONCE, again: bool = False, wave: int = WAVE) -> DataFrame:
    """(query_id, doc_id, prompt_md5, raw, error): a model's replies to prompts (query_id, doc_id, prompt, and images where the model takes them).

    The replies are stored in log, or in a new one that goes with the session. again: prompts whose reply is an error are
    asked once more; the newer reply counts. A ModelError tells that a wave got nothing but errors, so that a model that is
    down isn't asked for all that is left; its replies are kept and the next call goes on after them.
    """
    spark = prompts.sparkSession
    storage.shipped(spark)
    log = log or storage.fresh_path(spark, "replies", temporary=True)
    pictures = "images" in prompts.columns
    wanted = prompts.select("query_id", "doc_id", F.md5(F.col("prompt").cast("binary")).alias("prompt_md5"), "prompt", *(["images"] if pictures else []))
    wanted = storage.written(wanted.dropDuplicates(_KEY), "prompts")
    have = known(spark, log)
    missing = wanted.join(have.where("error is null") if again else have, _KEY, "left_anti")
    n = missing.count()
    if n:
        first = max(_waves(spark, log), default=-1) + 1
        parts = -(-n // wave)
        missing = storage.written(missing.withColumn("wave", F.pmod(F.xxhash64(*_KEY), F.lit(parts))), "missing") if parts > 1 else missing.withColumn("wave", F.lit(0))
        for k in range(parts):
            own = missing.where(F.col("wave") == k).drop("wave")
            own = own.repartition(max(1, spark.sparkContext.defaultParallelism), *_KEY)
            own.mapInPandas(_asking(model, timeout, most, pictures), SCHEMA).write.mode("overwrite").parquet(f"{log}/wave={first + k}")
            told = spark.read.schema(SCHEMA).parquet(f"{log}/wave={first + k}").agg(F.count("*").alias("n"), F.count("error").alias("bad"), F.first("error", True).alias("one")).first()
            if told["n"] and told["n"] == told["bad"] and k + 1 < parts:
                raise ModelError(f"none of {told['n']} prompts was answered: {told['one']}")
    rows = known(spark, log).join(wanted.select(*_KEY), _KEY, "left_semi")
    if again:  # an answer counts before errors
        rows = rows.groupBy(*_KEY).agg(F.max_by(F.struct("raw", "error"), F.col("error").isNull()).alias("r")).select(*_KEY, "r.raw", "r.error")
    return rows
