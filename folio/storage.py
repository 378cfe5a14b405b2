"""Tables in the folder that the driver and all executors share: they cut lineage and survive lost executors."""

from __future__ import annotations

import atexit
import logging
import tempfile
import uuid
import zipfile
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession


def shared_dir(spark: SparkSession) -> str:
    """The folder named in spark.checkpoint.dir; where it is unset, in local mode only (as in tests), a temporary one."""
    at = spark.conf.get("spark.checkpoint.dir", None)
    if not at:
        at = getattr(spark.sparkContext, "_folio_shared", None)
        if at is None:
            master = spark.sparkContext.master
            if not master.startswith("local") or master.startswith("local-cluster"):
                raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
            at = "file://" + tempfile.mkdtemp(prefix="folio-")
            spark.sparkContext._folio_shared = at
    return at.rstrip("/")


def fresh_path(spark: SparkSession, name: str, temporary: bool = False) -> str:
    """A path in the shared folder that nothing has; if temporary, what is written there goes with the session."""
    path = f"{shared_dir(spark)}/folio/{spark.sparkContext.applicationId}/{name}-{uuid.uuid4().hex[:12]}"
    if temporary:
        atexit.register(remove, spark, path)
    return path


def remove(spark: SparkSession, path: str) -> None:
    """Deletes a path, if the session still runs."""
    try:
        at = spark._jvm.org.apache.hadoop.fs.Path(path)
        at.getFileSystem(spark._jsc.hadoopConfiguration()).delete(at, True)
    except Exception as error:  # noqa: BLE001  mostly: the session has ended before the interpreter
        logging.getLogger(__name__).debug("not deleted: %s: %s", path, error)


def written(df: DataFrame, name: str) -> DataFrame:
    """The rows, written to the shared folder and read back; the files go with the session."""
    spark = df.sparkSession
    path = fresh_path(spark, name, temporary=True)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def shipped(spark: SparkSession) -> None:
    """Sends this package to the workers, once per context, so that they need no copy of the repository."""
    context = spark.sparkContext
    if not getattr(context, "_folio_shipped", False):
        package = Path(__file__).resolve().parent
        at = Path(tempfile.mkdtemp(prefix="folio-code-")) / "folio.zip"
        with zipfile.ZipFile(at, "w") as out:
            for source in sorted(package.rglob("*.py")):
                out.write(source, source.relative_to(package.parent))
        context.addPyFile(str(at))
        context._folio_shipped = True
