"""A corpus that grows: pages and images arrive late, again or corrected, and the tables stay those of one ingest of all of them.

Documents lie in buckets by a hash of their id. An upsert merges what has arrived with the pages of the documents that it
touches, makes these documents anew and writes the buckets they are in as new versions, beside the old ones:

    {path}/{table}/bucket=B/batch=N/*.parquet      pages, placed, sections, images and claims
    {path}/commits/N.json                          the version of each bucket, and what upsert N counted

A version counts once the commit that names it is there, which appears as a whole. An upsert that is run again after a failure
writes the same folders again; readers hold on to the versions of the last commit they have read.
"""

from __future__ import annotations

import json
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from folio import storage
from folio.errors import IngestionError
from folio.functions.text import NO_CAPTION
from folio.operators import pages as paging
from folio.plans import engine
from folio.plans.index import Index
from folio.plans.metrics import Metrics

BUCKETS = 64
#: Commits of which versions are kept for readers that have begun.
KEPT = 2
PAGES = "doc_id BIGINT, page BIGINT, md STRING, version BIGINT"
PLACED = "doc_id BIGINT, page BIGINT, img_pos BIGINT, b64 STRING, b64_len BIGINT, version BIGINT"
TABLES = ("pages", "placed", "sections", "images", "claims")


def _fs(spark: SparkSession, at: str):
    path = spark._jvm.org.apache.hadoop.fs.Path(at)
    return path.getFileSystem(spark._jsc.hadoopConfiguration()), path


def _names(spark: SparkSession, at: str) -> list[str]:
    fs, path = _fs(spark, at)
    return [x.getPath().getName() for x in fs.listStatus(path)] if fs.exists(path) else []


def newest(rows: DataFrame, key: list[str]) -> DataFrame:
    """One row of each key: that of the greatest version, of equal versions the greatest by its other columns, so that no order of arrival matters."""
    rest = [c for c in rows.columns if c not in (*key, "version")]
    at = F.struct("version", *rest)
    return rows.groupBy(*key).agg(F.max(at).alias("_at")).select(*(F.col(c) if c in key else F.col(f"_at.{c}").alias(c) for c in rows.columns))


@dataclass(frozen=True)
class Store:
    """The tables in path, a folder that the driver and all executors share."""

    spark: SparkSession
    path: str
    buckets: int = BUCKETS
    tail_policy: str = "reference"

    # --- reading -----------------------------------------------------------------

    def commits(self) -> list[int]:
        return sorted(int(n.removesuffix(".json")) for n in _names(self.spark, f"{self.path}/commits") if n.endswith(".json"))

    def _commit(self, number: int | None = None) -> dict:
        known = self.commits()
        if not known:
            return {"versions": {}, "metrics": {}}
        text = self.spark.read.text(f"{self.path}/commits/{known[-1] if number is None else number}.json", wholetext=True).first()[0]
        return json.loads(text)

    def metrics(self, number: int | None = None) -> dict:
        """What the last upsert, or upsert number, counted."""
        return self._commit(number)["metrics"]

    def _table(self, name: str, versions: dict[str, int], schema: str | None, only: list[int] | None = None) -> DataFrame | None:
        there = set(_names(self.spark, f"{self.path}/{name}"))
        at = [f"{self.path}/{name}/bucket={b}/batch={n}" for b, n in sorted(versions.items()) if (only is None or int(b) in only) and f"bucket={b}" in there]
        at = [x for x in at if _fs(self.spark, x)[0].exists(_fs(self.spark, x)[1])]  # a version of a bucket without rows has no folder
        if not at:
            return self.spark.createDataFrame([], schema) if schema else None
        return (self.spark.read.schema(schema) if schema else self.spark.read).parquet(*at)

    def corpus(self) -> engine.Corpus:
        """The corpus of the last commit."""
        versions = self._commit()["versions"]
        found = [self._table(name, versions, None) for name in ("sections", "images", "claims")]
        if found[0] is None:
            raise IngestionError(f"nothing has been ingested into {self.path}")
        empty = engine.ingest(self.spark.createDataFrame([], PAGES), self.spark.createDataFrame([], PLACED).drop("version"))
        return engine.Corpus(*(x if x is not None else self.spark.createDataFrame([], y.schema) for x, y in zip(found, (empty.sections, empty.images, empty.claims), strict=True)))

    # --- writing -----------------------------------------------------------------

    def upsert(self, pages: DataFrame | None = None, images: DataFrame | None = None, number: int | None = None, index: Index | None = None) -> dict:
        """Merges pages (doc_id, page, md; text, success and version where known) and images (doc_id, page, img_pos, b64, b64_len; version where known).

        Of rows with the same (doc_id, page), or (doc_id, page, img_pos), the greatest version counts. Returns what was
        counted while the tables were written. A number that has been committed already changes nothing.
        """
        known = self.commits()
        number = (known[-1] + 1 if known else 0) if number is None else number
        if number in known:
            return self.metrics(number)
        if known and number < known[-1]:
            raise IngestionError(f"upsert {number} comes after upsert {known[-1]}")
        spark, metrics = self.spark, Metrics()
        bucket = F.pmod(F.xxhash64("doc_id"), F.lit(self.buckets)).cast("int")

        def normal(rows: DataFrame | None, schema: str) -> DataFrame:
            if rows is None:
                return spark.createDataFrame([], schema)
            version = F.coalesce(F.col("version").cast("long"), F.lit(0)) if "version" in rows.columns else F.lit(0).cast("long")
            rows = (paging.normal(rows, "version") if schema == PAGES else rows).withColumn("version", version.alias("version"))
            return rows.where("doc_id is not null and page is not null").select(*(c.split()[0] for c in schema.split(", ")))

        arrived = {"pages": storage.written(normal(pages, PAGES), "arrived"), "placed": storage.written(normal(images, PLACED), "arrived-images")}
        touched = storage.written(arrived["pages"].select("doc_id").unionByName(arrived["placed"].select("doc_id")).distinct(), "touched")
        told = sorted(r[0] for r in touched.select(bucket).distinct().collect())  # at most so many as there are buckets
        commit = self._commit()
        versions = commit["versions"]

        def put(name: str, new: DataFrame, old: DataFrame | None, **counted) -> None:
            """New rows, and those of the untouched documents of the same buckets."""
            watched = metrics.watch(name, new, **counted)
            rows = watched if old is None else watched.unionByName(old.join(touched, "doc_id", "left_anti").select(*new.columns))
            rows = rows.withColumn("bucket", bucket).withColumn("batch", F.lit(number)).repartition("bucket", F.pmod(F.xxhash64("doc_id", F.lit(1)), F.lit(8)))
            rows.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("bucket", "batch").parquet(f"{self.path}/{name}")

        own = {}
        for name, schema, key in (("pages", PAGES, ["doc_id", "page"]), ("placed", PLACED, ["doc_id", "page", "img_pos"])):
            old = self._table(name, versions, schema, told)
            merged = newest(arrived[name].unionByName(old.join(touched, "doc_id", "left_semi")), key)
            put(name, merged, old, rows=F.count("*"), **({"without_text": F.count_if(F.trim("md") == "")} if name == "pages" else {}))
            fresh = {str(b): number for b in told}
            own[name] = self._table(name, fresh, schema, told).join(touched, "doc_id", "left_semi").drop("version")
        made = engine.ingest(own["pages"], own["placed"], self.tail_policy)
        tables = {"sections": made.sections, "images": made.images}
        for name, counted in (("sections", {"rows": F.count("*"), "longest": F.max(F.length("content"))}), ("images", {"rows": F.count("*"), "without_caption": F.count_if(F.col("caption") == NO_CAPTION)})):
            put(name, tables[name], self._table(name, versions, None, told), **counted)
        written = {name: self._fresh(name, told, number, tables[name]).join(touched, "doc_id", "left_semi") for name in tables}
        put("claims", engine.claims(written["sections"], written["images"]), self._table("claims", versions, None, told), rows=F.count("*"))
        if index is not None:
            left = touched.join(written["sections"].select("doc_id").distinct(), "doc_id", "left_anti")
            index.update(written["sections"], left)
        counted = metrics.values() | {"documents": touched.count()}
        self._write_commit(number, {"versions": versions | {str(b): number for b in told}, "metrics": counted})
        self._clean()
        return counted

    def _fresh(self, name: str, told: list[int], number: int, like: DataFrame) -> DataFrame:
        found = self._table(name, {str(b): number for b in told}, None, told)
        return found.select(*like.columns) if found is not None else self.spark.createDataFrame([], like.schema)

    def _write_commit(self, number: int, commit: dict) -> None:
        """The commit appears under its name by one rename."""
        fs, path = _fs(self.spark, f"{self.path}/commits/{number}.tmp")
        out = fs.create(path, True)
        out.write(bytearray(json.dumps(commit).encode()))
        out.close()
        if not fs.rename(path, _fs(self.spark, f"{self.path}/commits/{number}.json")[1]):
            raise IngestionError(f"commit {number} could not be written to {self.path}")

    def _clean(self) -> None:
        """Deletes the versions that none of the last KEPT commits names."""
        known = self.commits()[-KEPT:]
        named = [self._commit(n)["versions"] for n in known]
        for name in TABLES:
            for folder in _names(self.spark, f"{self.path}/{name}"):
                b = folder.removeprefix("bucket=")
                if b == folder:
                    continue
                held = {f"batch={v[b]}" for v in named if b in v}
                for version in _names(self.spark, f"{self.path}/{name}/{folder}"):
                    if version.startswith("batch=") and version not in held and int(version[6:]) <= known[-1]:
                        storage.remove(self.spark, f"{self.path}/{name}/{folder}/{version}")
