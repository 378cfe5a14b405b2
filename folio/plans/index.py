"""A stored inverted index: the weighted terms of sections as a table bucketed by (doc_id, term), kept up to date by document.

All of BM25's counts are a document's own, so a document that changes changes its own rows alone. The table is partitioned by
PARTS hashes of doc_id; an update writes the parts of its documents anew and leaves the others. Within a part, rows lie in
buckets by (doc_id, term), sorted, so that questions, dealt by the same keys, meet them without a shuffle or a sort of the index.
Each part is replaced as a whole; an update that was cut off is repeated with the same documents.
"""

from __future__ import annotations

import hashlib
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from folio import storage
from folio.errors import RetrievalError
from folio.operators import search

PARTS, BUCKETS = 16, 32
_COLUMNS = "doc_id BIGINT, seq BIGINT, term STRING, tf BIGINT, dl BIGINT, avgdl DOUBLE, df BIGINT, idf DOUBLE, part INT"


def _part(parts: int):
    return F.pmod(F.xxhash64("doc_id"), F.lit(parts)).cast("int")


@dataclass(frozen=True)
class Index:
    """The index in a folder of the shared storage; parts and buckets are those it was made with."""

    spark: SparkSession
    path: str
    parts: int = PARTS
    buckets: int = BUCKETS

    @property
    def table(self) -> str:
        return f"folio_postings_{hashlib.md5(self.path.encode()).hexdigest()[:16]}"

    def _known(self) -> None:
        """Tells the session's catalog of the table and its parts."""
        if not self.spark.catalog.tableExists(self.table):
            path = self.spark._jvm.org.apache.hadoop.fs.Path(self.path)
            path.getFileSystem(self.spark._jsc.hadoopConfiguration()).mkdirs(path)
            at = self.path.replace("'", "\\'")
            self.spark.sql(f"CREATE TABLE {self.table} ({_COLUMNS}) USING parquet PARTITIONED BY (part) CLUSTERED BY (doc_id, term) SORTED BY (doc_id, term) INTO {self.buckets} BUCKETS LOCATION '{at}'")
            self.spark.sql(f"ALTER TABLE {self.table} RECOVER PARTITIONS")

    def exists(self) -> bool:
        path = self.spark._jvm.org.apache.hadoop.fs.Path(self.path)
        return path.getFileSystem(self.spark._jsc.hadoopConfiguration()).exists(path)

    def postings(self) -> DataFrame:
        """search.weighted_terms() as stored."""
        if not self.exists():
            raise RetrievalError(f"no index in {self.path}")
        self._known()
        return self.spark.table(self.table).drop("part")

    def update(self, sections: DataFrame, gone: DataFrame | None = None) -> None:
        """Sections (doc_id, seq, title, content) of whole documents replace what the index has of these; documents in gone (doc_id) leave it."""
        new = storage.written(search.weighted_terms(sections).drop("first"), "postings").withColumn("part", _part(self.parts))
        touched = sections.select("doc_id").distinct()
        touched = storage.written(touched if gone is None else touched.unionByName(gone.select("doc_id")).distinct(), "touched")
        told = [r["part"] for r in touched.select(_part(self.parts).alias("part")).distinct().collect()]  # at most so many as there are parts
        if not told:
            return
        fresh = not self.exists()
        self._known()
        rows = new
        if not fresh:
            old = self.spark.table(self.table).where(F.col("part").isin(told)).join(touched, "doc_id", "left_anti")
            rows = storage.written(new.unionByName(old), "merged")
        columns = [c.split()[0] for c in _COLUMNS.split(", ")]
        filled = {r["part"] for r in rows.select("part").distinct().collect()}
        rows = rows.select(*columns).repartition(self.buckets, "doc_id", "term").sortWithinPartitions("part", "doc_id", "term")
        rows.createOrReplaceTempView(f"{self.table}_rows")
        mode = "spark.sql.sources.partitionOverwriteMode"
        before = self.spark.conf.get(mode)
        self.spark.conf.set(mode, "dynamic")
        try:
            self.spark.sql(f"INSERT OVERWRITE TABLE {self.table} PARTITION (part) SELECT * FROM {self.table}_rows")
        finally:
            self.spark.conf.set(mode, before)
            self.spark.catalog.dropTempView(f"{self.table}_rows")
        if not fresh:
            for part in set(told) - filled:  # nothing is left of them
                self.spark.sql(f"ALTER TABLE {self.table} DROP IF EXISTS PARTITION (part={part})")
                storage.remove(self.spark, f"{self.path}/part={part}")
        self.spark.catalog.refreshTable(self.table)


def stored(sections: DataFrame, path: str | None = None, parts: int = PARTS, buckets: int = BUCKETS) -> Index:
    """The index of sections in path, or in a folder that goes with the session."""
    spark = sections.sparkSession
    out = Index(spark, path or storage.fresh_path(spark, "index", temporary=True), parts, buckets)
    out.update(sections)
    return out
