"""Data sources of one's own: a parser's results as pages, and images as files with a manifest.

    formats.register(spark)
    spark.read.format("folio_pages").load(folder)
    images.write.format("folio_images").mode("append").save(folder)

Both reach their folder by pyarrow's file systems (local, hdfs, s3, gs), since the workers in which such sources run have no
JVM; the folder must be one that all machines see.
"""

from __future__ import annotations

import base64
import binascii
import json
import re
import uuid
from collections.abc import Iterable, Iterator
from dataclasses import dataclass, field

from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceWriter, EqualTo, Filter, In, InputPartition, WriterCommitMessage
from pyspark.sql.types import Row, StructType

from folio.storage import shipped

PAGES = "doc_id bigint, page bigint, md string, file string, error string"
IMAGES = "doc_id bigint, page bigint, img_pos bigint, ext string, b64 string"
MANIFEST = "doc_id bigint, page bigint, img_pos bigint, file string, bytes bigint, sha256 string"
#: Bytes of files that a partition of a source reads, at most about.
SLICE = 32 << 20
_NAMED = re.compile(r"(\d+)\.[^./]*$")


def opened(path: str) -> tuple[fs.FileSystem, str]:
    return fs.FileSystem.from_uri(path) if "://" in path or path.startswith("file:") else (fs.LocalFileSystem(), path)


# --- pages in ------------------------------------------------------------------------


@dataclass
class Files(InputPartition):
    """Files of about SLICE bytes, each with the id of its document."""

    own: list[tuple[str, int | None]] = field(default_factory=list)


class PageSource(DataSource):
    """folio_pages: a folder of a parser's results, one JSON file per document, named by its doc_id.

    A result is a list of pages, an object with pages, or a list of such objects; a page has page, md, text and success. Pages
    that failed are left out; without markdown a page has its plain text, else nothing. A file that can't be read, isn't JSON,
    has another shape or isn't named by an id gives one row with error, and stops nothing. Filters on doc_id (= and IN) choose
    files before any is opened. Option slice: bytes of files a partition.
    """

    @classmethod
    def name(cls) -> str:
        return "folio_pages"

    def schema(self) -> str:
        return PAGES

    def reader(self, schema: StructType) -> PageReader:
        return PageReader(self.options)


class PageReader(DataSourceReader):
    def __init__(self, options: dict) -> None:
        self.path, self.slice, self.wanted = options["path"], int(options.get("slice", SLICE)), None

    def pushFilters(self, filters: list[Filter]) -> Iterable[Filter]:
        for each in filters:
            asked = {each.value} if isinstance(each, EqualTo) else set(each.value) if isinstance(each, In) else None
            if asked is not None and each.attribute == ("doc_id",):
                self.wanted = asked if self.wanted is None else self.wanted & asked
            else:
                yield each

    def partitions(self) -> list[Files]:
        system, at = opened(self.path)
        found = system.get_file_info(fs.FileSelector(at, recursive=True))
        out, size = [Files()], 0
        for info in sorted((x for x in found if x.type == fs.FileType.File and not x.base_name.startswith(("_", "."))), key=lambda x: x.path):
            named = _NAMED.search(info.base_name)
            doc_id = int(named[1]) if named and int(named[1]) < 1 << 63 else None
            if self.wanted is not None and doc_id not in self.wanted:
                continue
            if out[-1].own and size + info.size > self.slice:
                out.append(Files())
                size = 0
            out[-1].own.append((info.path, doc_id))
            size += info.size
        return out

    def read(self, partition: Files) -> Iterator[tuple]:
        system, _ = opened(self.path)
        for file, doc_id in partition.own:
            try:
                if doc_id is None:
                    raise ValueError("the file isn't named by a doc_id")
                with system.open_input_stream(file) as stream:
                    rows = list(_pages(json.loads(stream.read())))
            except (OSError, ValueError, TypeError) as error:
                yield doc_id, None, None, file, f"{type(error).__name__}: {error}"
                continue
            for page, md in rows:
                yield doc_id, page, md, file, None


def _pages(result: object) -> Iterator[tuple[int, str]]:
    """(page, md) of a parser's result."""
    if isinstance(result, dict):
        result = [result]
    if not isinstance(result, list):
        raise TypeError("a result is a list or an object")
    listed = [x for x in result if isinstance(x, dict) and "pages" in x]
    for each in [p for x in listed for p in x["pages"] or ()] if listed else result:
        if not isinstance(each, dict):
            raise TypeError("a page is an object")
        if each.get("page") is None or each.get("success") is False:
            continue
        text = each.get("md") if each.get("md") is not None else each.get("text")
        yield int(each["page"]), "" if text is None else str(text)


# --- images out ----------------------------------------------------------------------


@dataclass
class Written(WriterCommitMessage):
    """What a task has written."""

    part: str
    files: int
    bytes: int


class ImageSink(DataSource):
    """folio_images: base64 images (doc_id, page, img_pos, ext, b64) as files, with a manifest.

        {folder}/write-ID/doc_id=D/page-P-K.EXT
        {folder}/manifest/ID-*.jsonl                {doc_id, page, img_pos, file, bytes, sha256} of each, made when the job commits

    Only what a manifest names counts. A task that fails deletes its files, a job that fails the whole write-ID. Task attempts
    write apart. Mode overwrite drops earlier manifests and their files when the new ones are there. A payload that isn't
    base64 fails its task; option bad=skip leaves it out instead.
    """

    @classmethod
    def name(cls) -> str:
        return "folio_images"

    def schema(self) -> str:
        return IMAGES

    def writer(self, schema: StructType, overwrite: bool) -> ImageWriter:
        missing = {c.split()[0] for c in IMAGES.split(", ")} - set(schema.names)
        if missing:
            raise ValueError(f"images lack {', '.join(sorted(missing))}")
        return ImageWriter(self.options, overwrite)


class ImageWriter(DataSourceWriter):
    def __init__(self, options: dict, overwrite: bool) -> None:
        self.path, self.skip, self.overwrite, self.id = options["path"], options.get("bad") == "skip", overwrite, uuid.uuid4().hex

    def write(self, rows: Iterator[Row]) -> Written:
        from hashlib import sha256

        from pyspark import TaskContext

        system, at = opened(self.path)
        context = TaskContext.get()
        part = f"{context.partitionId():06}-{context.taskAttemptId()}"
        base, told, size, made = f"{at}/write-{self.id}/{part}", [], 0, set()
        try:
            for row in rows:
                try:
                    content = base64.b64decode(row["b64"], validate=True) if row["b64"] is not None else None
                except (binascii.Error, ValueError):
                    if not self.skip:
                        raise
                    content = None
                if content is None:
                    continue
                folder = f"{base}/doc_id={row['doc_id']}"
                if folder not in made:
                    system.create_dir(folder)
                    made.add(folder)
                file = f"{folder}/page-{row['page']}-{row['img_pos']}.{re.sub('[^a-z0-9]', '', (row['ext'] or '').lower()) or 'png'}"
                with system.open_output_stream(file) as out:
                    out.write(content)
                size += len(content)
                told.append(json.dumps({"doc_id": row["doc_id"], "page": row["page"], "img_pos": row["img_pos"], "file": file.removeprefix(f"{at}/"), "bytes": len(content), "sha256": sha256(content).hexdigest()}))
            system.create_dir(base)
            with system.open_output_stream(f"{base}/_manifest") as out:
                out.write("".join(f"{x}\n" for x in told).encode())
        except BaseException:
            _delete(system, base)
            raise
        return Written(part, len(told), size)

    def commit(self, messages: list[Written | None]) -> None:
        system, at = opened(self.path)
        earlier = _manifests(system, at) if self.overwrite else []
        system.create_dir(f"{at}/manifest")
        for message in messages:
            if message is not None and message.files:
                system.move(f"{at}/write-{self.id}/{message.part}/_manifest", f"{at}/manifest/{self.id}-{message.part}.jsonl")
        own = {m.part for m in messages if m is not None}
        for info in system.get_file_info(fs.FileSelector(f"{at}/write-{self.id}", allow_not_found=True)):
            if info.base_name not in own:  # an attempt that another one has overtaken
                _delete(system, info.path)
        for file in earlier:
            _delete(system, f"{at}/write-{file.rpartition('/')[2].partition('-')[0]}")
            system.delete_file(file)

    def abort(self, messages: list[Written | None]) -> None:
        system, at = opened(self.path)
        _delete(system, f"{at}/write-{self.id}")


def _manifests(system: fs.FileSystem, at: str) -> list[str]:
    return [x.path for x in system.get_file_info(fs.FileSelector(f"{at}/manifest", allow_not_found=True))]


def _delete(system: fs.FileSystem, at: str) -> None:
    if system.get_file_info(at).type == fs.FileType.Directory:
        system.delete_dir(at)


def register(spark: SparkSession) -> None:
    """Makes both formats known, and lets Spark hand filters to them."""
    shipped(spark)
    spark.dataSource.register(PageSource)
    spark.dataSource.register(ImageSink)
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")


def read_results(spark: SparkSession, path: str, slice_: int = SLICE) -> tuple[DataFrame, DataFrame]:
    """(pages, errors): (doc_id, page, md) of a folder of results, and (doc_id, file, error) of the files that can't be read."""
    register(spark)
    rows = spark.read.format("folio_pages").option("slice", slice_).load(path)
    return rows.where("error is null").select("doc_id", "page", "md"), rows.where("error is not null").select("doc_id", "file", "error")


def write_images(images: DataFrame, path: str, mode: str = "append", bad: str = "fail") -> DataFrame:
    """Writes images (doc_id, page, img_pos, b64, and ext where known) as files and returns the manifest of the folder."""
    spark = images.sparkSession
    register(spark)
    rows = images if "ext" in images.columns else images.withColumn("ext", F.lit("png"))
    rows.select(*(c.split()[0] for c in IMAGES.split(", "))).write.format("folio_images").option("bad", bad).mode(mode).save(path)
    return manifest(spark, path)


def manifest(spark: SparkSession, path: str) -> DataFrame:
    """(doc_id, page, img_pos, file, bytes, sha256) of the images in a folder."""
    system, at = opened(path)
    return spark.read.schema(MANIFEST).json(f"{path}/manifest") if _manifests(system, at) else spark.createDataFrame([], MANIFEST)
