"""Web archives: round trip, plain reading of the written files, broken and foreign archives."""

import base64
import gzip
import hashlib
import os
import random

import pytest
from pyspark.sql import types as T

from llm.fixtures import SF
from tabforge.llm import warc
from tabforge.session import scratch_path

PAGES = T.StructType([T.StructField("page_id", T.LongType()), T.StructField("url", T.StringType()), T.StructField("html", T.StringType()),
                      T.StructField("rid", T.StringType()), T.StructField("block", T.StringType()), T.StructField("value", T.StringType())])
BIG = "é" * 600 + "x" * 30_000
ROWS = [(1, "http://a", BIG), (2, "http://b", BIG), (3, None, BIG), (4, "u\r\nX: y", None), (5, "", ""), (6, "c", "short"), (7, "c", "short"), (8, "d", "y" * 999),
        (9, "d", "y" * 999), (10, "d", "y" * 1000), (11, "d", "y" * 1000), (11, "d", "y" * 1000), (None, "n", "z" * 1500), (12, "n", "z" * 1500), (None, "n", None),
        (13, "m", ("WARC/1.1\r\nWARC-Type: response\r\nContent-Length: 5\r\n\r\n" + "0\r\n\r\n\n") * 700), (14, "WARC/1.0\r\n", "WARC/1."), (15, "l", "日本\n" * 200_000),
        (16, "x", "\r\n\r\n"), (17, "k", "q" * (8192 - len(warc.HTTP_HEAD)))]


def plain(rows):
    """The contract, row by row; of equal rows with the largest id any one is the response."""
    out, keeper = [], {}
    for i, (page, _, html) in enumerate(rows):
        k = (html or "").encode()
        if len(k) >= 1000 and (k not in keeper or (page is not None and (rows[keeper[k]][0] is None or page >= rows[keeper[k]][0]))):
            keeper[k] = i
    for i, (page, _, html) in enumerate(rows):
        k = (html or "").encode()
        again = k in keeper and keeper[k] != i
        out.append((page, len(k), hashlib.sha1(k).hexdigest(), "revisit" if again else "response", rows[keeper[k]][0] if again else None))
    return sorted(out, key=str)


def result(df):
    return sorted(((r.page_id, r.payload_bytes, r.payload_digest, r.record_type, r.refers_to) for r in df.collect()), key=str)


def pages(spark, rows):
    return spark.createDataFrame([(*r, "r", "b", "v") for r in rows], PAGES)


def files(path):
    return sorted(os.path.join(path, f) for f in os.listdir(path) if f.endswith(".gz"))


def test_round_trip(spark):
    path = scratch_path(spark, "warc-test")
    warc.write_archives(pages(spark, ROWS).repartition(3), path)
    assert result(warc.page_digests(spark, path)) == plain(ROWS)
    whole = warc.reassemble(warc.read_records(spark, path)).where("type = 'response'").collect()
    assert {r.status for r in whole} == {"ok"}
    want = {(None if p is None else str(p)): (h or "").encode() for p, _, h in ROWS}
    assert all(bytes(r.payload) == want[r.page_id] or r.page_id is None for r in whole)


def test_files_by_a_plain_reader(spark):
    """Every byte of the files belongs to a record of the stated length; segments count up and add up to the total."""
    path = scratch_path(spark, "warc-test")
    warc.write_archives(pages(spark, ROWS), path)
    records = []
    for f in files(path):
        data, at = gzip.open(f).read(), 0
        while at < len(data):
            end = data.index(b"\r\n\r\n", at)
            lines = data[at:end].decode().split("\r\n")
            assert lines[0] == "WARC/1.1"
            head = dict(line.split(": ", 1) for line in lines[1:])
            n = int(head["Content-Length"])
            records.append((head, data[end + 4:end + 4 + n]))
            assert data[end + 4 + n:end + 8 + n] == b"\r\n\r\n"
            at = end + 8 + n
    ids = [h["WARC-Record-ID"] for h, _ in records]
    assert len(set(ids)) == len(ids)
    origins = {h["WARC-Record-ID"]: (h, b) for h, b in records if h["WARC-Type"] != "continuation"}
    assert len(origins) == len(ROWS)
    assert max(len(b) for _, b in records) <= warc.SEGMENT_BYTES
    for origin, (head, block) in origins.items():
        rest = sorted((int(h["WARC-Segment-Number"]), b, h.get("WARC-Segment-Total-Length")) for h, b in records if h.get("WARC-Segment-Origin-ID") == origin)
        assert ("WARC-Segment-Number" in head) == bool(rest)
        assert [k for k, _, _ in rest] == list(range(2, len(rest) + 2))
        if rest:
            assert int(rest[-1][2]) == len(block) + sum(len(b) for _, b, _ in rest)
    assert any("WARC-Segment-Number" in h for h, _ in origins.values())


def test_corpus(spark):
    rows = [tuple(r) for r in spark.read.parquet(f"{SF}/pages.parquet").select("page_id", "url", "html").collect()]
    assert result(warc.op11_warc(spark, SF)) == plain(rows)


def _record(kind, block, **headers):
    lines = [f"WARC-Type: {kind}", *[f"{k.replace('_', '-')}: {v}" for k, v in headers.items()], f"Content-Length: {len(block)}"]
    return ("WARC/1.0\r\n" + "\r\n".join(lines) + "\r\n\r\n").encode() + block + b"\r\n\r\n"


def _http(body, chunked=True):
    return b"HTTP/1.1 200 OK\r\n" + (b"Transfer-Encoding: Chunked\r\n" if chunked else b"") + b"\r\n" + body


def test_foreign_and_broken_archives(spark, tmp_path):
    """Members per record, segments over files and out of order, base32 digests, chunk extensions; faults keep their row."""
    page = b"0123456789" * 10
    body = b"a;x=1\r\n" + page[:10] + b"\r\n5A\r\n" + page[10:] + b"\r\n0\r\nTrailer: 1\r\n\r\n"
    block = _http(body)
    cuts = [block[:40], block[40:90], block[90:91], block[91:]]

    def segments(name, parts, total, **extra):
        out = [_record("response", parts[0], WARC_Record_ID=name, WARC_Segment_Number=1, **extra)]
        for k, p in enumerate(parts[1:], 2):
            last = {"WARC_Segment_Total_Length": total} if k == len(parts) else {}
            out.append(_record("continuation", p, WARC_Record_ID=f"{name}-{k}", WARC_Segment_Origin_ID=name, WARC_Segment_Number=k, **last))
        return out
    b32 = "sha1:" + base64.b32encode(hashlib.sha1(page).digest()).decode()
    good = segments("<g>", cuts, len(block), WARC_Payload_Digest=b32)
    gap = segments("<gap>", cuts, len(block))
    del gap[2]
    endless = segments("<endless>", cuts, len(block))[:-1]
    wrong = segments("<wrong>", cuts, len(block) + 1)
    digest = [_record("response", block, WARC_Record_ID="<digest>", WARC_Payload_Digest="sha1:" + "0" * 40)]
    framing = [_record("response", _http(b"zz\r\nabc\r\n"), WARC_Record_ID="<framing>"), _record("response", _http(b"4\r\nabc"), WARC_Record_ID="<short>")]
    simple = [_record("warcinfo", b"software: x", WARC_Record_ID="<i>"), _record("response", _http(page, False), WARC_Record_ID="<plain>")]
    orphan = [_record("continuation", b"x", WARC_Record_ID="<o2>", WARC_Segment_Origin_ID="<o>", WARC_Segment_Number=2, WARC_Segment_Total_Length=5)]
    again = [_record("revisit", _http(b""), WARC_Record_ID="<r>", WARC_Refers_To="<g>"), _record("revisit", _http(b""), WARC_Record_ID="<r2>", WARC_Refers_To="<nobody>")]
    records = good * 2 + gap + endless + wrong + digest + framing + simple + orphan + again  # the good one was archived twice
    random.Random(3).shuffle(records)
    for i in range(3):
        with open(tmp_path / f"f{i}.warc.gz", "wb") as f:
            f.write(b"".join(gzip.compress(r) for r in records[i::3]))
    with open(tmp_path / "cut.warc.gz", "wb") as f:
        f.write(gzip.compress(simple[1] + _record("response", block, WARC_Record_ID="<lost>")[:-30]))
    rows = warc.reassemble(warc.read_records(spark, str(tmp_path))).collect()
    got = {r.record_id: (r.status, None if r.payload is None else bytes(r.payload)) for r in rows if r.type == "response"}
    assert got == {"<g>": ("ok", page), "<gap>": ("missing segment", None), "<endless>": ("missing segment", None), "<wrong>": ("wrong length", None),
                   "<digest>": ("bad digest", None), "<framing>": ("bad framing", None), "<short>": ("bad framing", None), "<plain>": ("ok", page)}
    assert sorted((r.type, r.status) for r in rows if r.type in ("continuation", "unreadable")) == [("continuation", "missing segment"), ("unreadable", "unreadable")]
    digests = {r.record_type: 0 for r in warc.page_digests(spark, str(tmp_path)).collect()}
    assert set(digests) == {"response", "revisit", "continuation", "unreadable"}
    seen = {(r.record_type, r.payload_bytes) for r in warc.page_digests(spark, str(tmp_path)).where("record_type = 'revisit'").collect()}
    assert seen == {("revisit", 100), ("revisit", None)}


@pytest.mark.parametrize("rows", [[], [(1, None, None)]])
def test_few_pages(spark, rows):
    path = scratch_path(spark, "warc-test")
    warc.write_archives(pages(spark, rows), path)
    assert result(warc.page_digests(spark, path)) == plain(rows)
