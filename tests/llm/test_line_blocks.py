"""The kernels of op8 that read blocks of text, against plain Python."""

import random

import numpy as np
import pyarrow as pa
import pytest

from folio.llm import common, lines

BLANKS = " \t\r\x0b\x0c"


def blocks(texts):
    yield from common.text_blocks(pa.RecordBatch.from_arrays([pa.array(texts, pa.string())], ["text"]))


@pytest.mark.parametrize("seed", range(20))
def test_lines_of_blocks(seed):
    rng = random.Random(seed)
    parts = ["\n", *BLANKS, "a", "é", "日", "x" * 30, "é𝄞" * 15, " " * 40, "\t \x0b" * 9]
    texts = [rng.choice([None, "", "".join(rng.choice(parts) for _ in range(rng.randint(0, 30)))]) for _ in range(40)]
    want = [(r, k, x.strip(BLANKS)) for r, text in enumerate(texts) for k, x in enumerate((text or "").split("\n")) if x.strip(BLANKS)]
    got = [(f + r, k, data[a:b].tobytes().decode()) for f, data, offsets in blocks(texts) for r, k, a, b in zip(*lines._spans(data, offsets), strict=True)]
    assert got == want


def test_bags_of_some_lines():
    rng = random.Random(7)
    texts = ["\n".join("".join(rng.choice("abé日𝄞 ") for _ in range(rng.randint(20, 60))) for _ in range(9)) for _ in range(5)]
    for _, data, offsets in blocks(texts):
        _, _, start, end = lines._spans(data, offsets)
        hashed = common.SpanHasher(data)
        long = lines._Long(data, hashed, start, end, hashed(start, end))
        whole = long.bags()
        for rows in (np.arange(len(long.h)), np.arange(1, len(long.h), 3), np.zeros(0, int)):
            assert all(np.array_equal(x[rows], y) for x, y in zip(whole, long.bags(rows), strict=True))
        rare = np.array([int(np.bitwise_xor.reduce(lines._BAG[data[a:b]])) for a, b in zip(long.from_, long.to, strict=True)], np.uint64)
        assert np.array_equal(rare.view(np.int64), whole[0])


def test_texts_that_lose_nothing_are_not_rebuilt():
    schema = pa.schema([("text", pa.string()), ("gone", pa.list_(pa.int64()))])
    untouched = pa.RecordBatch.from_arrays([pa.array(["a\nb", None, ""]), pa.array([[], None, None], pa.list_(pa.int64()))], schema=schema)
    mixed = pa.RecordBatch.from_arrays([pa.array(["a\nb\nc", None, "a\nb", "é"]), pa.array([[0, 2], None, [], [0]], pa.list_(pa.int64()))], schema=schema)
    out = list(lines._kept_text("gone")(iter([untouched, mixed])))
    assert out[0] is untouched
    assert out[1].column("text").to_pylist() == ["b", None, "a\nb", ""] and out[1].schema == schema
