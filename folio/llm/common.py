"""Shared kernels: storage in the shared folder, ASCII-blank tokens and vectorised hashes.

Conventions for every operator of this subpackage:

* a null text counts as an empty text, and an empty text has no words, lines or bytes;
* only the named id and text columns are read, so further columns never clash;
* hashes are 64 bits wide and depend on the bytes alone, so that reruns and other machines agree.
"""

from __future__ import annotations

import atexit
import contextlib
import gc
import tempfile
import zipfile
from collections.abc import Iterator
from contextvars import ContextVar
from pathlib import Path

import numpy as np
import pyarrow as pa
from py4j.protocol import Py4JError
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from folio.storage import fresh_path, remove, shared_dir  # noqa: F401

#: Bytes of text that a kernel works on at a time.
BLOCK = 1 << 19
WORD = r"[^\x20\x09-\x0D]+"

_RNG = np.random.default_rng(20240229)
_TABLE = _RNG.integers(1, 2**63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_P = 0x9E3779B97F4A7C15 | 1
_P_INVERSE = pow(_P, -1, 1 << 64)
_BLANK = np.zeros(256, bool)
_BLANK[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_powers: dict[int, np.ndarray] = {}


# --- storage ---------------------------------------------------------------


#: Paths that the open scratch() block has written.
_written: ContextVar[list[str] | None] = ContextVar("written", default=None)


def new_path(spark: SparkSession, name: str) -> str:
    """A path in the shared folder; what is written there goes with the open scratch() block, else with the session."""
    path = fresh_path(spark, name)
    own = _written.get()
    if own is None:
        atexit.register(remove, spark, path)
    else:
        own.append(path)
    return path


def stored(df: DataFrame, name: str) -> DataFrame:
    """Writes the rows to the shared folder and reads them back: cuts lineage and survives lost executors."""
    spark = df.sparkSession
    path = new_path(spark, name)
    df.write.option("parquet.block.size", 8 << 20).parquet(path)  # a task's buffer stays small
    out = spark.read.schema(df.schema).parquet(path)
    out._folio_path = path
    return out


@contextlib.contextmanager
def scratch(spark: SparkSession) -> Iterator[None]:
    """Deletes at its end what was written within, but for what kept() handed on."""
    token = _written.set([])
    try:
        yield
    finally:
        own = _written.get()
        _written.reset(token)
        for path in own or ():
            remove(spark, path)
        collect_garbage(spark)


def collect_garbage(spark: SparkSession) -> None:
    """Lets Spark drop the shuffle files, broadcasts and plans of what was cut off or deleted: it does so when the driver's garbage is collected.

    What the JVM's many short-lived threads have freed stays with the C library, hundreds of MB of it in a session of many
    jobs; the JVM's own diagnostic command for it gives that back, where there is one.
    """
    gc.collect()
    jvm, array = spark._jvm, spark.sparkContext._gateway.new_array
    jvm.System.gc()
    with contextlib.suppress(Py4JError):  # the bean's own class isn't public, so it is called through its interface
        find, kinds, values = jvm.java.lang.Class.forName, array(jvm.java.lang.Class, 4), array(jvm.java.lang.Object, 4)
        for k, name in enumerate(("javax.management.ObjectName", "java.lang.String", "[Ljava.lang.Object;", "[Ljava.lang.String;")):
            kinds[k] = find(name)
        values[0], values[1] = jvm.javax.management.ObjectName("com.sun.management:type=DiagnosticCommand"), "systemTrimNativeHeap"
        find("javax.management.MBeanServerConnection").getMethod("invoke", kinds).invoke(jvm.java.lang.management.ManagementFactory.getPlatformMBeanServer(), values)


def kept(df: DataFrame) -> DataFrame:
    """df, whose stored rows outlive the open scratch() block: they go when the session ends, or by discard()."""
    own = _written.get()
    if own is not None and df._folio_path in own:
        own.remove(df._folio_path)
        atexit.register(remove, df.sparkSession, df._folio_path)
    return df


def discard(df: DataFrame) -> None:
    """Deletes what stored() wrote; no plan over it may run from then on."""
    remove(df.sparkSession, df._folio_path)
    collect_garbage(df.sparkSession)


def shipped(spark: SparkSession) -> None:
    """Sends this package to the executors, once per context, so that they need no copy of the repository."""
    context = spark.sparkContext
    if not getattr(context, "_folio_shipped", False):
        package = Path(__file__).resolve().parent.parent
        at = Path(tempfile.mkdtemp(prefix="folio-code-")) / "folio.zip"
        with zipfile.ZipFile(at, "w") as out:
            for source in sorted(package.rglob("*.py")):
                out.write(source, source.relative_to(package.parent))
        context.addPyFile(str(at))
        context._folio_shipped = True


#: What Arrow hands to Python at once, at most: rows and bytes.
BATCH_ROWS, BATCH_BYTES = 256, 8 << 20


def bounded_batches(spark: SparkSession) -> None:
    """Ships the code and lowers, for the session, what Arrow hands to Python at once, so that long texts fit a worker's memory.

    Plans returned by the operators run with these two settings, the same for all of them; lower settings are left alone.
    """
    shipped(spark)
    for key, most in (("maxRecordsPerBatch", BATCH_ROWS), ("maxBytesPerBatch", BATCH_BYTES)):
        now = spark.conf.get(f"spark.sql.execution.arrow.{key}").removesuffix("b")
        if not (now.isdigit() and 0 < int(now) <= most):
            spark.conf.set(f"spark.sql.execution.arrow.{key}", most)


@contextlib.contextmanager
def smaller_batches(spark: SparkSession, rows: int) -> Iterator[None]:
    """Fewer rows at once for the actions within."""
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(key)
    spark.conf.set(key, rows)
    try:
        yield
    finally:
        spark.conf.set(key, before)


def unused(columns: list[str], name: str) -> str:
    """name, longer by as many underscores as it takes to differ from all columns, in any case of letters."""
    known = {c.lower() for c in columns}
    while name.lower() in known:
        name += "_"
    return name


def held_out(doc_id):
    """True for the rows whose labels no model may see: crc32(doc_id as text) mod 3 is 1."""
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")) % 3 == 1


#: log2 of the words of a Bloom filter that reach the driver in one row.
_BLOCK_BITS = 12


def _blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Words (word, bits), all of a block in one partition, as blocks of bytes."""
    found: dict[int, np.ndarray] = {}
    for batch in batches:
        word, bits = np.asarray(batch.column("word")), np.asarray(batch.column("bits"))
        for block in np.unique(word >> _BLOCK_BITS):
            own = word >> _BLOCK_BITS == block
            found.setdefault(int(block), np.zeros(1 << _BLOCK_BITS, np.int32))[word[own] & ((1 << _BLOCK_BITS) - 1)] = bits[own]
    yield pa.RecordBatch.from_arrays([pa.array(list(found), pa.int64()), pa.array([x.tobytes() for x in found.values()], pa.binary())], ["block", "words"])


def bloom(keys: DataFrame, bits: int) -> np.ndarray:
    """A Bloom filter of 2 ** bits bits over the hashes in column key; it reaches the driver as such, 2 ** (bits - 3) bytes at most."""
    slots = keys.select(F.explode(F.array(F.shiftrightunsigned("key", 64 - bits), F.col("key").bitwiseAND(F.lit((1 << bits) - 1)))).alias("slot"))
    words = slots.select(F.shiftright("slot", 5).alias("word"), F.expr("shiftleft(1, cast(slot % 32 as int))").alias("bit")).groupBy("word").agg(F.bit_or("bit").alias("bits"))
    out = np.zeros((1 << (bits - 5 - _BLOCK_BITS), 1 << _BLOCK_BITS), np.uint32)
    got = words.repartition(F.shiftright("word", _BLOCK_BITS)).mapInArrow(_blocks, "block long, words binary").toArrow()
    for block, own in zip(got.column("block").to_pylist(), got.column("words"), strict=True):
        out[block] = np.frombuffer(own.as_buffer(), np.uint32)
    return out.ravel()


def in_bloom(filter_: np.ndarray, h: np.ndarray) -> np.ndarray:
    """Whether both bits of each hash, those named by its first and by its last bits, are set."""
    bits, hit = len(filter_).bit_length() + 4, np.ones(len(h), bool)
    for slot in ((h >> np.uint64(64 - bits)).astype(np.int64), (h & np.uint64((1 << bits) - 1)).astype(np.int64)):
        hit &= ((filter_[slot >> 5] >> (slot & 31).astype(np.uint32)) & 1).astype(bool)
    return hit


# --- blocks of text ----------------------------------------------------------


def text_blocks(batch: pa.RecordBatch, column: str = "text", limit: int = BLOCK) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(first row, bytes, offsets of rows) of consecutive rows with about limit bytes of UTF-8 text."""
    texts = batch.column(column)
    if pa.types.is_dictionary(texts.type):
        texts = texts.dictionary_decode()
    texts = texts.cast(pa.large_string()).fill_null("")
    n = len(texts)
    if not n:
        return
    offsets = np.frombuffer(texts.buffers()[1], np.int64, n + 1, texts.offset * 8)
    data = np.frombuffer(texts.buffers()[2], np.uint8) if texts.buffers()[2] is not None else np.zeros(0, np.uint8)
    row = 0
    while row < n:
        end = max(row + 1, int(np.searchsorted(offsets, offsets[row] + limit, "right")) - 1)
        yield row, data[offsets[row] : offsets[end]], offsets[row : end + 1] - offsets[row]
        row = end


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective scrambling of 64-bit values."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def _power(base: int, n: int) -> np.ndarray:
    have = _powers.get(base)
    if have is None or len(have) < n:
        size = 1 << max(12, (n - 1).bit_length())
        out = np.full(size, np.uint64(base))
        out[0] = 1
        with np.errstate(over="ignore"):
            np.multiply.accumulate(out, out=out)
        if size > 2 * BLOCK:
            return out
        _powers[base] = have = out
    return have


def span_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Hashes of data[start:end] for each span; starts must not decrease. Works through long data in pieces."""
    out = np.zeros(len(starts), np.uint64)
    i = 0
    while i < len(starts):
        base = int(starts[i])
        j = max(i + 1, int(np.searchsorted(starts, base + BLOCK, "right")))
        top = int(ends[i:j].max())
        if top - base > 2 * BLOCK and j > i + 1:
            j = max(i + 1, i + int(np.argmax(np.maximum.accumulate(ends[i:j]) > base + 2 * BLOCK)))
            top = int(ends[i:j].max())
        sums = np.zeros(top - base + 1, np.uint64)
        np.cumsum(_TABLE[data[base:top]] * _power(_P, top - base)[: top - base], out=sums[1:])
        s, e = starts[i:j] - base, ends[i:j] - base
        out[i:j] = mix((sums[e] - sums[s]) * _power(_P_INVERSE, top - base + 1)[s] + (e - s).astype(np.uint64))
        i = j
    return out


_room = np.empty(0, np.uint64)


def looked_up(table: np.ndarray, at: np.ndarray, zeros: int = 0) -> np.ndarray:
    """table[at] and so many zeros, of 64 bits each; for blocks, in memory that the next call uses again."""
    global _room
    n = len(at) + zeros
    out = np.empty(n, np.uint64) if n > 2 * BLOCK + 2 else _room
    if len(out) < n:
        out = _room = np.empty(2 * BLOCK + 2, np.uint64)
    np.take(table, at, out=out[: len(at)], mode="clip")  # all are within
    out[len(at) : n] = 0
    return out[:n]


class SpanHasher:
    """span_hashes() of one block, many times: the sums over its bytes are made once."""

    def __init__(self, data: np.ndarray) -> None:
        self.data, self.sums = data, None
        if len(data) <= 2 * BLOCK:
            each = looked_up(_TABLE, data)
            each *= _power(_P, len(data))[: len(data)]
            self.sums = np.empty(len(data) + 1, np.uint64)
            self.sums[0] = 0
            np.cumsum(each, out=self.sums[1:])
            self.back = _power(_P_INVERSE, len(data) + 1)

    def __call__(self, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        if self.sums is None:
            return span_hashes(self.data, starts, ends)
        return mix((self.sums[ends] - self.sums[starts]) * self.back[starts] + (ends - starts).astype(np.uint64))


def words(data: np.ndarray, offsets: np.ndarray, lower: bool = True) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts and ends of the words (runs without ASCII blanks) of each row, and the first word of each row."""
    solid = ~_BLANK[data]
    edge = np.zeros(len(data) + 1, bool)
    edge[offsets] = True
    before = np.zeros(len(data), bool)
    before[1:] = solid[:-1]
    before &= ~edge[:-1]
    after = np.zeros(len(data), bool)
    after[:-1] = solid[1:]
    after &= ~edge[1:]
    starts = np.flatnonzero(solid & ~before)
    ends = np.flatnonzero(solid & ~after) + 1
    return starts, ends, np.searchsorted(starts, offsets)


def word_hashes(data: np.ndarray, offsets: np.ndarray, lower: bool = True) -> tuple[np.ndarray, np.ndarray]:
    """Hash of each word, A-Z lowered if asked for, and the first word of each row."""
    if lower:
        data = _LOWER[data]
    starts, ends, first = words(data, offsets)
    return span_hashes(data, starts, ends), first


def rolled(hashes: np.ndarray, n: int) -> np.ndarray:
    """Hashes of each n consecutive words."""
    if len(hashes) < n:
        return np.zeros(0, np.uint64)
    m = len(hashes) - n + 1
    acc = np.zeros(m, np.uint64)
    for k in range(n):
        acc = acc * np.uint64(0xD6E8FEB86659FD93) + hashes[k : k + m]
    return mix(acc)


def shingle_sets(data: np.ndarray, offsets: np.ndarray, n: int = 5) -> Iterator[np.ndarray]:
    """The sorted distinct n-word shingles of each row; a row with fewer words is one shingle, without words none."""
    hashes, first = word_hashes(data, offsets)
    all_ = rolled(hashes, n)
    for a, b in zip(first[:-1], first[1:], strict=True):
        if b - a >= n:
            own = np.sort(all_[a : b - n + 1])
            keep = np.empty(len(own), bool)
            keep[0] = True
            np.not_equal(own[1:], own[:-1], out=keep[1:])
            yield own[keep]
        elif b > a:
            yield mix(rolled(hashes[a:b], int(b - a)) + np.uint64(b - a))
        else:
            yield hashes[:0]


_LETTER = np.zeros(256, bool)
_LETTER[48:58] = _LETTER[97:123] = _LETTER[128:] = True


def token_spans(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts and ends of the runs of ASCII letters, digits and bytes of other letters, and the first of each row; data is lowered."""
    solid = _LETTER[data]
    edge = np.zeros(len(data) + 1, bool)
    edge[offsets] = True
    cut = np.ones(len(data), bool)
    cut[1:] = ~solid[:-1]
    starts = np.flatnonzero(solid & (cut | edge[:-1]))
    cut = np.ones(len(data), bool)
    cut[:-1] = ~solid[1:]
    ends = np.flatnonzero(solid & (cut | edge[1:])) + 1
    return starts, ends, np.searchsorted(starts, offsets)


def tokens(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hash of each token, A-Z lowered, and the first token of each row."""
    data = _LOWER[data]
    starts, ends, first = token_spans(data, offsets)
    return span_hashes(data, starts, ends), first
