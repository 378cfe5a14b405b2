"""op11, op12 and op13 against brute force and SQL on small tables: nulls, empty and long texts, ties, repeated rows, empty tables, clashing columns."""

import hashlib
import random
import re
import zlib

import duckdb
import numpy as np
import pyarrow as pa
import pyarrow.parquet as pq
import pytest

from folio.llm import negatives, packing, periods, queries

WORD = re.compile(r"[^\x20\x09-\x0D]+")


# --- periodic runs -------------------------------------------------------------


def runs_by_hand(w):
    """Every stretch of each period, the smallest period of each kept."""
    out = {}
    for q in range(1, len(w) // 2 + 1):
        i = 0
        while i + q < len(w):
            j = i
            while j + q < len(w) and w[j] == w[j + q]:
                j += 1
            if j + q - i >= max(12, 2 * q):
                out.setdefault((i, j + q - i), q)
            i = j + 1
    return sorted(((s, n, q) for (s, n), q in out.items()), key=lambda r: (r[0], r[2]))


def test_runs_equal_brute_force():
    rng = random.Random(1)
    for _ in range(1500):
        n, k = rng.randrange(90), rng.choice([1, 2, 2, 3, 5, 30])
        w = [rng.randrange(k) for _ in range(n)]
        for _ in range(rng.randrange(3) if n else 0):
            a = rng.randrange(n)
            p, b = rng.randrange(1, (n - a) // 2 + 2), rng.randrange(a, n + 1)
            for i in range(a, b):
                w[i] = w[a + (i - a) % p]
        assert [tuple(r) for r in periods.runs_of(w).tolist()] == runs_by_hand(w), w
    for a, b in (([0], [0, 1]), ([0, 0], [0, 0, 1]), ([0, 1], [0, 1, 1, 0])):  # runs in runs, of many periods
        while len(b) < 1000:
            a, b = b, b + a
        assert [tuple(r) for r in periods.runs_of(b).tolist()] == runs_by_hand(b)
    for _ in range(150):
        w = []
        for _ in range(rng.randrange(1, 5)):
            u = [rng.randrange(2) for _ in range(rng.randrange(1, 12))]
            for _ in range(3):
                u = (u * rng.randrange(1, 5) + [rng.randrange(3) for _ in range(rng.randrange(3))])[:400]
            w += u
        assert [tuple(r) for r in periods.runs_of(w).tolist()] == runs_by_hand(w), w
    assert periods.runs_of([0] * 60_000).tolist() == [[0, 60_000, 1]]


def test_z_function():
    rng = random.Random(2)
    for _ in range(300):
        s = [rng.randrange(2) for _ in range(rng.randrange(20))]
        want = [next((k for k in range(len(s) - i) if s[k] != s[i + k]), len(s) - i) for i in range(len(s))]
        assert periods.z_function(s) == want


def test_op13(spark, tmp_path):
    rng = random.Random(3)
    texts = [None, "", " \n", "one", "é ü " * 9, "a b c " * 40, "x " * 3000, "\t".join(f"w{k}" for k in range(500)), " ".join(["q"] * 12), " ".join(["q"] * 11), "a\x1cb a\x1cb " * 8, "a\xa0b " * 12]
    texts += [" ".join(rng.choice("ab" if k % 2 else "abcdefghijklmnop") for _ in range(rng.randrange(80))) for k in range(120)]
    rows = [(i, t) for i, t in enumerate(texts)] + [(5, texts[5]), (None, "k " * 20), (7, "other")]
    pq.write_table(pa.table({"doc_id": pa.array([r[0] for r in rows], pa.int64()), "text": [r[1] for r in rows], "runs": [1] * len(rows), "n": [2] * len(rows)}), tmp_path / "documents.parquet")
    df = queries.QUERIES["op13_periods"](spark, str(tmp_path))
    assert df.dtypes == [("doc_id", "bigint"), *((c, "bigint") for c in ("n_runs", "start", "length", "period", "exponent_milli")), ("runs_sha256", "string"), ("collapsed_sha256", "string")]
    want, looped = [], 0
    for i, t in rows:
        w = WORD.findall(t or "")
        n, h = len(w), None if i is None else zlib.crc32(str(i).encode())
        if n and h is not None and h % 10 == 0:
            g = h // 10
            a = g % n
            p = 1 + (n - a) // (3 + g % 8)
            w, looped = [w[k] if k < a else w[a + (k - a) % p] for k in range(n)], looped + 1
        own = runs_by_hand(w)
        top = min(own, key=lambda r: (-r[1], r[0], r[2])) if own else (None,) * 3
        gone = {k for s, m, q in own for k in range(s + q, s + m)}
        told = "".join(f"{s},{m},{q}\n" for s, m, q in own)
        kept = " ".join(x for k, x in enumerate(w) if k not in gone)
        want.append((i, len(own), *top, 1000 * top[1] // top[2] if own else None, hashlib.sha256(told.encode()).hexdigest(), hashlib.sha256(kept.encode()).hexdigest()))
    key = lambda r: tuple((x is None, x) for x in r)
    assert looped > 5 and sorted(map(tuple, df.collect()), key=key) == sorted(want, key=key)


def test_periodic_keeps_clashing_columns(spark):
    got = periods.periodic(spark.createDataFrame([(1, "a " * 12, "r", 5)], "doc_id long, text string, Runs string, n_words long")).collect()[0].asDict()
    assert got == {"doc_id": 1, "text": "a " * 12, "Runs_": "r", "n_words_": 5, "n_words": 12, "runs": [(0, 12, 1)], "collapsed": "a"}


# --- packing -------------------------------------------------------------------


def check_pieces(rows, ids_of, capacity=1024):
    """Each id of each document in one piece, sequences without a gap, full or of a power of two."""
    docs, sequences = {}, {}
    for r in rows:
        docs.setdefault(r["doc_id"], []).append(r)
        sequences.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
    assert docs.keys() == ids_of.keys()
    for i, own in docs.items():
        ids = ids_of[i]
        at = 0
        for r in sorted(own, key=lambda r: r["start"]):
            assert r["start"] == at and r["length"] > 0 and r["doc_tokens"] == len(ids)
            at += r["length"]
            assert r["ids_crc32"] == zlib.crc32(np.array(ids[r["start"] : at], "<u4").tobytes())
        assert at == len(ids)
    for own in sequences.values():
        at = 0
        for offset, length in sorted(own):
            assert offset == at
            at += length
        assert at <= capacity and at & (at - 1) == 0
    return sequences


def test_op12(spark, tmp_path):
    import public_tokenizers
    from tokenizers import Tokenizer

    rng = random.Random(4)
    words = [f"{a}{b}" for a in "bcdfgklm" for b in ("an", "ost", "ie", "é")]
    texts = [None, "", " ", "<|endoftext|> is text", "x" * 50_000, "many " * 9000, "中文 tekst\n\n\tmit  Leerraum "]
    texts += [" ".join(rng.choice(words) for _ in range(rng.choice([3, 40, 300, 700]))) for _ in range(150)]
    pq.write_table(pa.table({"doc_id": pa.array(range(len(texts)), pa.int64()), "text": texts, "length": [0] * len(texts)}), tmp_path / "documents.parquet", row_group_size=40)
    tokenizer = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    tokenizer.encode_special_tokens = True
    want = {i: [*tokenizer.encode(t or "", add_special_tokens=False).ids, 0] for i, t in enumerate(texts)}
    df = queries.QUERIES["op12_packing"](spark, str(tmp_path))
    assert df.dtypes == [(c, "bigint") for c in ("doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset")]
    sequences = check_pieces(df.collect(), want)
    total = sum(map(len, want.values()))
    assert len(sequences) <= total // 1024 + 10
    pq.write_table(pa.table({"doc_id": pa.array([], pa.int64()), "text": pa.array([], pa.string())}), tmp_path / "none.parquet")
    assert packing.pieces(spark.read.parquet(str(tmp_path / "none.parquet")), public_tokenizers.path("byte_bpe_50k.json")).collect() == []


def test_pieces_hold_their_ids_and_repeated_rows(spark):
    import public_tokenizers

    docs = spark.createDataFrame([(1, "some words here"), (1, "some words here"), (None, "other"), (2, None)], "doc_id long, text string")
    rows = packing.pieces(docs, public_tokenizers.path("byte_bpe_50k.json"), capacity=4, group=2).collect()
    assert sum(r["length"] for r in rows) == 4 + 4 + 2 + 1
    assert all(zlib.crc32(r["ids"]) == r["ids_crc32"] and len(r["ids"]) == 4 * r["length"] for r in rows)
    with pytest.raises(ValueError):
        packing.pieces(docs, "x", capacity=1000)


def test_packed_balances_costs():
    rng = np.random.default_rng(5)
    for _ in range(60):
        capacity = int(2 ** rng.integers(0, 9))
        lengths = rng.integers(1, capacity + 1, int(rng.integers(0, 150)))
        out = packing.packed(lengths, capacity)
        pieces = [{"doc_id": i, "start": s, "length": n, "sequence_id": k, "offset": o, "doc_tokens": int(lengths[i]), "ids_crc32": zlib.crc32(np.zeros(n, "<u4").tobytes())} for i, s, n, k, o in out]
        check_pieces(pieces, {i: [0] * n for i, n in enumerate(lengths.tolist())}, capacity)
    # Whole items come by descending cost, each to the sequence of least cost that has room for it; then what fits nowhere is cut.
    lengths = np.minimum(900, rng.lognormal(4.5, 1, 700).astype(int) + 1)
    out, n = packing.packed(lengths), int(lengths.sum()) // 1024
    cost, room, whole = [0.0] * n, [1024] * n, [r for r in out if r[2] == lengths[r[0]] and r[3] < n]
    first_cut = next((k for k, r in enumerate(out) if r[2] < lengths[r[0]]), len(out))
    for item, _, length, k, _ in out[:first_cut]:
        assert room[k] >= length and cost[k] == min(c for c, r in zip(cost, room, strict=True) if r >= length)
        cost[k], room[k] = cost[k] + packing.token_cost(length), room[k] - length
    assert [int(lengths[r[0]]) for r in out[:first_cut]] == sorted((int(lengths[r[0]]) for r in out[:first_cut]), reverse=True)
    assert len(whole) > 0.85 * len(lengths)


def test_encoder_equals_its_library():
    import public_tokenizers

    encode = packing.encoder(public_tokenizers.path("byte_bpe_50k.json"))
    assert encode.fast is not None
    rng = random.Random(6)
    parts = [" ", "  ", "\n", "\t", "\x1c", "\xa0", " ", "　", "\x85", "᠎", "a", "'s", "'", "1", "²", "é", "!", "中", "\r", "<|endoftext|>", "the", "'LL", "́", "🙂"]
    for _ in range(4000):
        text = "".join(rng.choice(parts) for _ in range(rng.randrange(14)))
        assert encode(text) == encode.slow.encode(text, add_special_tokens=False).ids
    every = "".join(f"a{chr(c)}b {chr(c)} " for c in range(0x3000) if not 0xD800 <= c < 0xE000)
    assert encode(every) == encode.slow.encode(every, add_special_tokens=False).ids


# --- hard negatives --------------------------------------------------------------


def embeddings(tmp_path, rows):
    pq.write_table(pa.table({"vec_id": pa.array([r[0] for r in rows], pa.int64()), "embedding": pa.array([r[1] for r in rows], pa.list_(pa.float32())), "label": pa.array([r[2] for r in rows], pa.int32()), "score": [1] * len(rows)}), tmp_path / "embeddings.parquet", row_group_size=300)
    return str(tmp_path)


def test_op11_equals_its_sql(spark, tmp_path):
    rng = np.random.default_rng(7)
    near = rng.normal(size=8) / 3
    rows = [(i, (near + rng.normal(size=8) * 0.02 if i % 3 == 0 else rng.normal(size=8) * (0.1 + i % 5 / 8)).tolist(), int(i % 10)) for i in range(1500)]
    rows += [(1, rows[1][1], 3), (100, rows[100][1], 0), (100, rows[100][1], 0), (300, [0.0] * 8, 4), (200, near.tolist(), 9)]  # repeated ids and rows, a vector of nothing
    rows += [(2000, None, 1), (2100, [float("nan")] * 8, 1), (2200, [float("inf")] * 8, 1), (2300, near.tolist(), None), (2400, [None] * 8, 2), (2500, near.tolist(), 77)]  # 77 has no other row
    at = embeddings(tmp_path, rows)
    con = duckdb.connect()
    con.execute(f"CREATE VIEW embeddings AS SELECT * FROM '{at}/embeddings.parquet'")
    df = queries.QUERIES["op11_negatives"](spark, at)
    assert df.dtypes == [("anchor_id", "bigint"), ("positive_id", "bigint"), ("rank", "int"), ("negative_id", "bigint"), ("positive_score", "bigint"), ("negative_score", "bigint")]
    got, want = sorted(map(tuple, df.collect())), sorted(con.execute(queries.ORACLES["op11_negatives"]).fetchall())
    assert len(want) > 100 and got == want


def by_hand(rows, every, positives=5, negatives_=5, low=80, high=100):
    out = []
    for k, (i, label, v) in enumerate(rows):
        if i % every:
            continue
        scored = sorted((-sum(a * b for a, b in zip(v, x, strict=False)), j, m) for m, (j, _, x) in enumerate(rows) if m != k)
        for s, j, _ in [t for t in scored if rows[t[2]][1] == label][:positives]:
            fit = [(t, n) for t, n, m in scored if rows[m][1] != label and low * -s <= 100 * -t <= high * -s][:negatives_]
            out += [(i, j, r + 1, n, -s, -t) for r, (t, n) in enumerate(fit)]
    return sorted(out)


@pytest.mark.parametrize("group", [3, 10_000])
def test_mined_prunes_nothing_that_counts(spark, group):
    """Clusters far apart: the bounds spare most copies, and many small groups give the same rows as one."""
    rng = np.random.default_rng(8)
    centres = rng.integers(-400, 400, (12, 5))
    rows = [(i, int(rng.integers(4)), (centres[i % 12] * (1 + i % 3) + rng.integers(-9, 9, 5)).tolist()) for i in range(900)]
    df = spark.createDataFrame([(*r, "x") for r in rows], "id long, label long, vector array<long>, uid string")
    got = negatives.mined(df, every=10, group=group, slice_=200)
    assert sorted(map(tuple, got.collect())) == by_hand(rows, 10)


def test_mined_large_and_ragged_vectors(spark):
    rows = [(0, 1, [2_000_000, 5]), (1, 1, [1_900_000]), (2, 2, [1_700_000, 9, 4]), (3, 2, []), (4, 1, [-(10**6)]), (5, 2, [1_999_999]), (6, 1, [10**12]), (10, 2, [])]
    df = spark.createDataFrame(rows, "id long, label long, vector array<long>")
    assert sorted(map(tuple, negatives.mined(df, every=10).collect())) == by_hand([r for r in rows if r[0] != 6], 10)
    assert negatives.mined(df.where("false")).collect() == [] and negatives.mined(df, every=1000).where("false").columns == ["anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score"]
