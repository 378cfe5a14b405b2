"""New pages as they arrive: each batch is merged into a growing corpus."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming import StreamingQuery

from folio.plans.index import Index
from folio.plans.store import BUCKETS, PAGES, Store


def ingesting(spark: SparkSession, source: str, image_table: DataFrame | None, target: str, index: Index | None = None, buckets: int = BUCKETS, max_files: int | None = None) -> StreamingQuery:
    """Starts a stream over parquet files of pages (doc_id, page, md; version where known) in source.

    The pages of a document may come in any files and batches, late, again or corrected by a greater version. Each batch is
    an upsert into the Store in target, with the images that image_table has of its documents; its progress is kept there too.
    A batch that is run again after a failure has the same number and the same result.
    """
    store = Store(spark, target, buckets)

    def add(batch: DataFrame, number: int) -> None:
        known = image_table.join(batch.select("doc_id").distinct(), "doc_id", "left_semi") if image_table is not None else None
        store.upsert(batch, known, number, index)

    arriving = spark.readStream.schema(PAGES)
    arriving = (arriving.option("maxFilesPerTrigger", max_files) if max_files else arriving).parquet(source)
    return arriving.writeStream.foreachBatch(add).option("checkpointLocation", f"{target}/progress").trigger(availableNow=True).start()
