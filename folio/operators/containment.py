"""Which texts of a document contain which patterns, without comparing each with each.

A pattern is known by its first 2 ** k bytes of UTF-8, as many as it has (MOST at most): their hash together with the document is
its key. Wherever the pattern stands in a text, so do these bytes. A Bloom filter of all keys, of fixed size, tells in the task
that reads a text which of its places may begin with a key; only these travel, meet the patterns by (doc_id, key), and are
compared after. So what is shuffled grows with what is found, not with the places of all texts. A null pattern or text meets
nothing, an empty pattern is left out: every text holds it.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import IntegerType, LongType, StructField, StructType

from folio import storage
from folio.llm.common import BLOCK, bloom, bounded_batches, in_bloom, mix, text_blocks

#: Bytes of a pattern that make its key, at most; a power of two.
MOST = 4096
#: log2 of the bits of the filter.
BITS = 27


def _doubled(data: np.ndarray) -> Iterator[tuple[int, np.ndarray]]:
    """(n, hashes of all stretches of n bytes) for n = 1, 2, 4 and so on."""
    n, each = 1, mix(data.astype(np.uint64) + np.uint64(1))
    while n <= MOST and len(each):
        yield n, each
        each = mix(each[: max(0, len(each) - n)] * np.uint64(0xD6E8FEB86659FD93) + each[n:])
        n *= 2


def _keyed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Patterns with how many bytes their keys are made of, and the keys."""
    for batch in batches:
        doc, sizes, keys = np.asarray(batch.column("_doc")).view(np.uint64), np.zeros(len(batch), np.int32), np.zeros(len(batch), np.uint64)
        for first, data, offsets in text_blocks(batch, "pattern"):
            length = np.diff(offsets)
            for n, each in _doubled(data):
                own = np.flatnonzero(length >= n)
                sizes[first + own], keys[first + own] = n, mix(each[offsets[own]] ^ doc[first + own])
        yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("pattern"), pa.array(sizes), pa.array(keys.view(np.int64))], ["doc_id", "pattern", "size", "key"])


def _met(known: np.ndarray, sizes: list[int]):
    """The keys that each text may hold, of the sizes that occur, in order; without patterns none."""
    sizes = sizes or [0]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            doc = np.asarray(batch.column("_doc")).view(np.uint64)
            for first, data, offsets in text_blocks(batch):
                row, end = np.repeat(np.arange(len(offsets) - 1), np.diff(offsets)), np.repeat(offsets[1:], np.diff(offsets))
                for at in range(0, len(data), BLOCK):
                    for n, each in _doubled(data[at : at + BLOCK + MOST - 1]):
                        if n > sizes[-1]:
                            break
                        if n not in sizes:
                            continue
                        own = slice(at, at + min(len(each), BLOCK))
                        inside = np.flatnonzero(np.arange(own.start, own.stop) + n <= end[own])
                        rows = first + row[own][inside]
                        keys = mix(each[inside] ^ doc[rows])
                        hit = in_bloom(known, keys)
                        if hit.any():
                            found = np.unique(np.stack([rows[hit].astype(np.uint64), keys[hit]]), axis=1)
                            yield pa.RecordBatch.from_arrays([*(batch.column(c).take(pa.array(found[0].view(np.int64))) for c in ("doc_id", "text_id")), pa.array(found[1].view(np.int64))], ["doc_id", "text_id", "key"])

    return run


def met_by_key(patterns: DataFrame, texts: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The different patterns (doc_id, pattern, size, key), stored, and the keys (doc_id, text_id, key) that texts may hold."""
    bounded_batches(patterns.sparkSession)
    asked = patterns.select("doc_id", "pattern").where("pattern <> ''").distinct()
    schema = StructType([*asked.schema.fields, StructField("size", IntegerType()), StructField("key", LongType())])
    named = storage.written(asked.withColumn("_doc", F.xxhash64("doc_id")).mapInArrow(_keyed, schema), "patterns")
    sizes = sorted(r["size"] for r in named.select("size").distinct().collect())  # powers of two up to MOST
    schema = StructType([*(texts.schema[c] for c in ("doc_id", "text_id")), StructField("key", LongType())])
    rows = texts.where("text <> ''").select("doc_id", "text_id", "text", F.xxhash64("doc_id").alias("_doc"))
    return named, rows.mapInArrow(_met(bloom(named.select("key"), BITS), sizes), schema)


def contained(patterns: DataFrame, texts: DataFrame) -> DataFrame:
    """(doc_id, pattern, text_id): each different pattern (doc_id, pattern) with the texts (doc_id, text_id, text) of its document that hold it.

    The patterns are stored with their keys when this is called; the files go with the session.
    """
    named, keys = met_by_key(patterns, texts)
    maybe = named.select("doc_id", "pattern", "key").join(keys, ["doc_id", "key"]).select("doc_id", "pattern", "text_id").distinct()
    return maybe.join(texts.select("doc_id", "text_id", "text"), ["doc_id", "text_id"]).where(F.contains("text", F.col("pattern"))).select("doc_id", "pattern", "text_id")
