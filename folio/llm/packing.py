"""Cost-balanced packing of documents into training sequences of bounded length.

A document is its token ids and an end id. A piece of n tokens costs its sequence n + n * n / (6 * width): the multiplications
of a transformer's layers of that width grow with the tokens, those of attention within a piece with their square. Each stretch
of CAPACITY tokens of a long document fills a sequence of its own. What remains of the documents is dealt to groups by a hash;
a group opens as many sequences as its tokens fill and hands the remainders out by descending cost, each to the sequence of
least cost that still has room for it. A remainder that fits nowhere any more is cut: its first part fills the sequence with
most room. The tokens beyond the last full sequence of a group go to sequences whose lengths are powers of two, which need no
padding; so no sequence has any.

A null text is an empty one, whose only token is the end id. Rows that repeat an id are packed one by one. Ids are passed on.
"""

from __future__ import annotations

import heapq
import json
import re
import zlib
from collections.abc import Iterator
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from folio.llm.common import bounded_batches, kept, scratch, stored

#: Tokens of a sequence, a power of two.
CAPACITY = 1024
#: Width of the model whose cost is estimated.
WIDTH = 768
#: Remainders that are packed together, about; at most 2 MB of ids a 1000.
GROUP = 4096
#: Bits of a piece's number within its task or group.
_BITS = 36

PIECES = "doc_id long, start long, length long, ids binary, ids_crc32 long, doc_tokens long, sequence_id long, offset long, cost double"
_TOKENS = "uid long, doc_id long, start long, length long, ids binary, doc_tokens long"

# --- tokens ------------------------------------------------------------------

#: How the byte-level tokenizer that is built in cuts texts, and the characters that stand for the bytes 0 to 32, 127 to 160 and 173.
CUT = r"'(?:[sdmt]|ll|ve|re)| ?\p{L}++| ?\p{N}++| ?[^\s\p{L}\p{N}]++|\s++$|\s+(?!\S)|\s"
SHIFTED = 256
#: A run of characters without a blank that goes to the tokenizers library, whose merges take no time that grows with its square.
_SOLID = re.compile(r"\S{2048}")


class Encoder:
    """Ids of texts, by the tokenizer in a file of the tokenizers library.

    Where the file holds plain byte-level pair merges, numbered in the order in which they apply, tiktoken merges by these numbers,
    which gives the same ids in a fifth of the time; texts with very long words, and all other files, go to the library itself.
    Names of special tokens in a text are text.
    """

    def __init__(self, path: str) -> None:
        from tokenizers import Tokenizer

        self.slow, self.fast = Tokenizer.from_file(path), None
        self.slow.encode_special_tokens = True
        told = json.loads(self.slow.to_str())
        model, cut = told["model"], told["pre_tokenizer"] or {}
        plain = model["type"] == "BPE" and not any(model.get(k) for k in ("dropout", "continuing_subword_prefix", "end_of_word_suffix", "byte_fallback", "ignore_merges"))
        plain &= cut.get("type") == "ByteLevel" and cut["use_regex"] and not cut["add_prefix_space"] and not told["normalizer"]
        if plain and all(x["special"] and not (x["lstrip"] or x["rstrip"]) for x in told["added_tokens"]):
            names = {x["content"] for x in told["added_tokens"]}
            vocab = {k: v for k, v in model["vocab"].items() if k not in names}
            order = [vocab["".join(x.split(" ") if isinstance(x, str) else x)] for x in model["merges"]]
            if len(order) + 256 == len(vocab) and order == sorted(order):
                import tiktoken

                byte = _bytes()
                self.fast = tiktoken.Encoding("packing", pat_str=CUT, mergeable_ranks={bytes(byte[c] for c in k): v for k, v in vocab.items()}, special_tokens={})

    def __call__(self, text: str) -> list[int]:
        if self.fast is None or _SOLID.search(text):
            return self.slow.encode(text, add_special_tokens=False).ids
        return self.fast.encode_ordinary(text)


def _bytes() -> dict[str, int]:
    """The byte that each character of a byte-level vocabulary stands for: printable Latin ones themselves, the others in turn from SHIFTED on."""
    own = {chr(b): b for b in range(256) if 32 < b < 127 or (b > 160 and b != 173)}
    return own | {chr(SHIFTED + k): b for k, b in enumerate(sorted(set(range(256)) - set(own.values())))}


@cache
def encoder(path: str) -> Encoder:
    """One a worker and file."""
    return Encoder(path)


def token_cost(length, width: int = WIDTH):
    """What a piece of so many tokens costs its sequence."""
    return length + length * length / (6.0 * width)


def _tokenized(path: str, end: int, capacity: int):
    """Batches of (doc_id, text) become a document's full stretches, numbered in their task, and its remainder, each with its ids."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = encoder(path)
        task = TaskContext.get()
        uid = task.partitionId() << _BITS if task else 0
        for batch in batches:
            texts = [x.as_py() or "" for x in batch.column("text")]
            docs = batch.column("doc_id").to_pylist()
            rows: list[tuple] = []
            size = 0
            for k, text in enumerate(texts):
                told = encode(text)
                n = len(told) + 1
                ids = np.array([*told, end], "<u4").tobytes()
                for start in range(0, n, capacity):
                    own = ids[4 * start : 4 * (start + capacity)]
                    rows.append((uid, docs[k], start, len(own) // 4, own, n))
                    uid += 1
                    size += len(own)
                if size > 4 << 20:
                    yield _batch(rows, _TOKENS)
                    rows, size = [], 0
            yield _batch(rows, _TOKENS)

    return run


_KINDS = {"long": pa.int64(), "binary": pa.binary(), "double": pa.float64()}


def _batch(rows: list[tuple], schema: str) -> pa.RecordBatch:
    fields = [x.split() for x in schema.split(", ")]
    columns = list(zip(*rows, strict=True)) if rows else [[] for _ in fields]
    return pa.RecordBatch.from_arrays([pa.array(c, _KINDS[kind]) for c, (_, kind) in zip(columns, fields, strict=True)], names=[name for name, _ in fields])


# --- one group ----------------------------------------------------------------


class _Open:
    """Open sequences by room and cost: a tree over the room, 0 to capacity tokens, holds the least cost of those with at least so much."""

    def __init__(self, n: int, capacity: int) -> None:
        self.half = 1 << capacity.bit_length()
        self.heaps: list[list[tuple[float, int]]] = [[] for _ in range(capacity + 1)]
        self.heaps[capacity] = [(0.0, k) for k in range(n)]
        self.best: list[tuple[float, int]] = [(np.inf, -1)] * (2 * self.half)
        self._renew(capacity)

    def _renew(self, room: int) -> None:
        at = self.half + room
        self.best[at] = (self.heaps[room][0][0], room) if self.heaps[room] else (np.inf, -1)
        while at > 1:
            at >>= 1
            self.best[at] = min(self.best[2 * at], self.best[2 * at + 1])

    def take(self, least: int) -> tuple[float, int, int] | None:
        """(cost, sequence, room) of the least cost with that much room or more; None if there is none."""
        found, at = (np.inf, -1), self.half + least
        found = self.best[at]
        while at > 1:
            if not at & 1:
                found = min(found, self.best[at + 1])
            at >>= 1
        return self._out(found[1])

    def widest(self) -> tuple[float, int, int] | None:
        """(cost, sequence, room) of one with most room."""
        at = 1
        while at < self.half:
            at = 2 * at + (self.best[2 * at + 1][1] >= 0)
        return self._out(self.best[at][1])

    def _out(self, room: int) -> tuple[float, int, int] | None:
        if room < 0:
            return None
        cost, k = heapq.heappop(self.heaps[room])
        self._renew(room)
        return cost, k, room

    def put(self, cost: float, k: int, room: int) -> None:
        if room:
            heapq.heappush(self.heaps[room], (cost, k))
            self._renew(room)


def packed(lengths: np.ndarray, capacity: int = CAPACITY, width: int = WIDTH) -> list[tuple[int, int, int, int, int]]:
    """(item, start, length, sequence, offset): items of 1 to capacity tokens in sequences that are full, but for the last ones, of lengths that are powers of two."""
    total = int(lengths.sum())
    n = total // capacity
    order = np.lexsort((np.arange(len(lengths)), -lengths))
    fills, out = _Open(n, capacity), []
    waits: list[tuple[int, int, int]] = []  # what is left of an item: no sequence has room for it as a whole

    def add(item: int, start: int, length: int, at: tuple[float, int, int]) -> None:
        cost, k, room = at
        out.append((item, start, length, k, capacity - room))
        fills.put(cost + token_cost(length, width), k, room - length)

    for item in order.tolist():
        length = int(lengths[item])
        at = fills.take(length)
        if at:
            add(item, 0, length, at)
        else:
            waits.append((item, 0, length))
    tail: list[tuple[int, int, int]] = []
    for item, start, length in waits:
        while length:
            at = fills.take(length) or fills.widest()
            if not at:
                tail.append((item, start, length))
                break
            part = min(length, at[2])
            add(item, start, part, at)
            start, length = start + part, length - part
    left, k, offset = total - n * capacity, n, 0
    size = 1 << left.bit_length() >> 1
    for item, start, length in tail:
        while length:
            part = min(length, size - offset)
            out.append((item, start, part, k, offset))
            start, length, offset = start + part, length - part, offset + part
            if offset == size:
                left, k, offset = left - size, k + 1, 0
                size = 1 << left.bit_length() >> 1
    return out


def _grouped(capacity: int, width: int):
    def run(key: tuple, table: pa.Table) -> pa.Table:
        table = table.sort_by("uid")
        lengths = np.asarray(table.column("length"))
        columns = {c: table.column(c).to_pylist() for c in ("doc_id", "start", "doc_tokens")}
        ids, base, rows = table.column("ids").combine_chunks(), key[0].as_py() << _BITS, []
        for item, start, length, k, offset in packed(lengths, capacity, width):
            own = ids[item].as_buffer().to_pybytes()[4 * start : 4 * (start + length)]
            rows.append((columns["doc_id"][item], columns["start"][item] + start, length, own, zlib.crc32(own), columns["doc_tokens"][item], 2 * (base + k) + 1, offset, token_cost(length, width)))
        return pa.Table.from_batches([_batch(rows, PIECES)])

    return run


def _full(width: int):
    """Full stretches are sequences as they are."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, n = batch.column("ids"), batch.num_rows
            length = np.asarray(batch.column("length"))
            columns = {
                "doc_id": batch.column("doc_id"), "start": batch.column("start"), "length": batch.column("length"), "ids": ids,
                "ids_crc32": pa.array([zlib.crc32(x.as_buffer()) for x in ids], pa.int64()), "doc_tokens": batch.column("doc_tokens"),
                "sequence_id": pa.array(2 * np.asarray(batch.column("uid"))), "offset": pa.array(np.zeros(n, np.int64)), "cost": pa.array(token_cost(length, width)),
            }
            yield pa.RecordBatch.from_pydict(columns)

    return run


def pieces(docs: DataFrame, tokenizer: str, end: int = 0, capacity: int = CAPACITY, width: int = WIDTH, group: int = GROUP) -> DataFrame:
    """(doc_id, start, length, ids, ids_crc32, doc_tokens, sequence_id, offset, cost): the pieces of all documents (doc_id, text).

    tokenizer is the path of a byte-level tokenizer's file, the same on all machines; ids are unsigned, little-endian and 32 bits
    wide. Tokens are stored once, full stretches pass by as they are, and the remainders are shuffled once, group by group.
    Which documents meet in a group follows the files the rows come from, so other files of the same rows are packed otherwise.
    """
    if capacity < 1 or capacity & (capacity - 1):
        raise ValueError("capacity must be a power of two")
    spark = docs.sparkSession
    bounded_batches(spark)
    with scratch(spark):
        tokens = kept(stored(docs.select("doc_id", "text").mapInArrow(_tokenized(tokenizer, end, capacity), _TOKENS), "tokens"))
        rest = tokens.where(F.col("length") < capacity)
        n = max(1, -(-rest.count() // group))
    own = rest.withColumn("group", F.pmod(F.xxhash64("uid"), F.lit(n))).groupBy("group").applyInArrow(_grouped(capacity, width), PIECES)
    return tokens.where(F.col("length") == capacity).mapInArrow(_full(width), PIECES).unionByName(own)
