"""Archives that are cut, broken, mixed or zipped record by record: what can be read counts, the rest is told."""

import gzip
import random

import pytest

from folio.llm import warc


def records(k, n=4):
    return [warc.ArcRecord(f"http://h/{k}/{j}", "1.2.3.4", "20240102030405", "text/html", f"HTTP/1.1 200 OK\r\nX-Row: {100 * k + j}\r\n\r\n{'same' if j == 0 else f'page {k} {j}'}".encode()) for j in range(n)]


def members(data, sizes):
    """The bytes as gzip members of these sizes."""
    out, at = b"", 0
    for n in [*sizes, len(data)]:
        out += gzip.compress(data[at : at + n])
        at += n
    return out


def test_broken_arcs_are_quarantined(spark, tmp_path):
    arcs = tmp_path / "arcs"
    arcs.mkdir()
    whole = {k: warc.arc_bytes(records(k), 1 + k % 2) for k in range(8)}
    (arcs / "0.arc.gz").write_bytes(gzip.compress(whole[0]))
    (arcs / "1.arc").write_bytes(whole[1])
    (arcs / "2.arc.gz").write_bytes(members(whole[2], [200, 31, 1]))
    (arcs / "3.arc").write_bytes(whole[3][:-12])  # cut within its last record
    (arcs / "4.arc.gz").write_bytes(gzip.compress(whole[4])[:-30])  # cut within a member
    (arcs / "5.arc").write_bytes(b"no archive\nat all\n")
    (arcs / "6.arc").write_bytes(whole[6] + b"junk line\n" + whole[6])
    (arcs / "7.arc").write_bytes(b"")
    found = {r["name"].split(":")[0]: r for r in warc.convert_arcs(spark, str(arcs), str(tmp_path / "warcs")).collect()}
    assert set(found) == {"3.arc", "4.arc.gz", "5.arc", "6.arc"}
    assert found["6.arc"]["offset"] == len(whole[6]) - 1 and "no record line" in found["6.arc"]["reason"] and "ends early" in found["3.arc"]["reason"]
    rows = warc.read_archives(spark, str(tmp_path / "warcs")).collect()
    got = {r["page_id"]: r["record_type"] for r in rows}
    assert all(r["reason"] is None for r in rows) and {k for k in got if k < 400 or k >= 600} == {100 * k + j for k in (0, 1, 2, 3, 6) for j in range(4)} - {303}
    assert got[600] == "response" and all(got[100 * k] == "revisit" for k in range(4))


def test_broken_warcs_are_told(spark, tmp_path):
    (tmp_path / "arcs").mkdir()
    (tmp_path / "arcs/a.arc").write_bytes(warc.arc_bytes(records(1), 1))
    warc.convert_arcs(spark, str(tmp_path / "arcs"), str(tmp_path / "warcs"))
    file = next((tmp_path / "warcs").glob("part-*.gz"))
    whole = gzip.decompress(file.read_bytes())
    bad = tmp_path / "bad"
    bad.mkdir()
    (bad / "cut.warc").write_bytes(whole[:-20])
    (bad / "changed.warc").write_bytes(whole.replace(b"page 1 2", b"page 1 X"))
    (bad / "junk.warc.gz").write_bytes(gzip.compress(b"WARC/1.1\r\nContent-Length: 12x\r\n\r\n"))
    rows = warc.read_archives(spark, str(bad)).collect()
    told = {r["file"]: r["reason"] for r in rows if r["reason"]}
    assert "ends early" in told["cut.warc"] and "digest" in told["changed.warc"] and "length" in told["junk.warc.gz"]
    assert sorted(r["page_id"] for r in rows if not r["reason"]) == sorted([100, 101, 102, 100, 101, 103])


def shuffled(spark):
    """Bytes that the session's stages wrote to shuffles."""
    sc = spark.sparkContext
    stages = sc._jsc.sc().statusStore().stageList(None, False, False, sc._gateway.new_array(sc._jvm.double, 0), None)
    return sum(stages.apply(k).shuffleWriteBytes() for k in range(stages.size()))


def test_records_are_converted_where_their_file_is_read(spark, tmp_path):
    (tmp_path / "arcs").mkdir()
    pages = [random.Random(j // 2).randbytes(1 << 18).hex() for j in range(8)]  # in pairs; half as long when zipped
    head = "HTTP/1.1 200 OK\r\nX-Row: "
    for k in range(2):
        own = [warc.ArcRecord(f"http://h/{j}", "1.2.3.4", "2024", "text/html", f"{head}{j}\r\n\r\n{pages[j]}".encode()) for j in range(k, 8, 2)]
        (tmp_path / f"arcs/{k}.arc.gz").write_bytes(gzip.compress(warc.arc_bytes(own, 1 + k)))
    before, most = shuffled(spark), spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", -1)  # as if there were many revisits
    try:
        assert warc.convert_arcs(spark, str(tmp_path / "arcs"), str(tmp_path / "warcs")).count() == 0
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", most)
    assert shuffled(spark) - before < 0.75 * sum(map(len, pages))
    rows = warc.read_archives(spark, str(tmp_path / "warcs")).collect()
    assert {r["page_id"]: (r["payload_bytes"], r["refers_to"], r["reason"]) for r in rows} == {j: (1 << 19, None if j % 2 else j + 1, None) for j in range(8)}
    assert len(rows) == 8


def test_records_are_unzipped_as_they_are_read():
    import tracemalloc

    big = [warc.ArcRecord(f"http://b/{k}", "0.0.0.0", "2024", "text/plain", b"x" * (1 << 20)) for k in range(60)]
    data = gzip.compress(warc.arc_bytes(big, 2))
    del big
    tracemalloc.start()
    assert sum(len(r.block) for r in warc.read_arc(data)) == 60 << 20
    assert tracemalloc.get_traced_memory()[1] < 8 << 20
    tracemalloc.stop()


@pytest.mark.parametrize("data", [b"", b"\n\n"])
def test_empty_archives(data):
    assert list(warc.read_arc(data)) == [] and list(warc.read_warc(data)) == []
