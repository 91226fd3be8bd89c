import base64
import gzip
import hashlib
import uuid
from collections import defaultdict

import pyarrow as pa

from skuweave.llm import queries as Q
from skuweave.llm import warc as W

SF = "/root/testdata/sf0.001"
PAGES = "page_id long, url string, html string, length int"


def pages(spark):
    tricky = "WARC/1.1\r\nWARC-Type: response\r\n\r\nx\r\n\r\n"
    rows = [(1, "http://a/", "same é"), (2, None, "same é"), (9, "http://b/\r\nX: 1", "same é"), (3, "u", None), (4, "u", ""), (5, "u", tricky), (6, "u", tricky), (None, "u", "same é"), (7, "u", "\n"), (8, "u", "long " * 50_000), (9, "http://b/", "same é")]
    return spark.createDataFrame([(*r, 0) for r in rows], PAGES)


def expected(rows, least=0):
    groups = defaultdict(list)
    for i, html in rows:
        groups[html or ""].append(-1 if i is None else i)
    out = []
    for body, members in groups.items():
        data, first = body.encode(), max(members)
        digest = base64.b32encode(hashlib.sha1(data).digest()).decode()
        for k, i in enumerate(sorted(members, reverse=True)):
            again = k > 0 and len(data) >= least
            out.append((None if i < 0 else i, len(data), digest, "revisit" if again else "response", first if again else None))
    return sorted(out, key=str)


def result(df):
    return sorted(((r.source_id, r.payload_bytes, r.payload_digest, r.record_type, r.refers_to) for r in df.collect()), key=str)


def test_query_matches_brute_force(spark):
    rows = [(r.page_id, r.html) for r in spark.read.parquet(f"{SF}/pages.parquet").collect()]
    got = sorted(((r.page_id, r.payload_bytes, r.payload_digest, r.record_type, r.refers_to) for r in Q.op5_warc(spark, SF).collect()), key=str)
    assert got == expected(rows)


def test_round_trip(spark, tmp_path):
    df = pages(spark)
    rows = [(r.page_id, r.html) for r in df.collect()]
    assert result(W.archived(df, path=f"{tmp_path}/a")) == expected(rows)
    assert result(W.archived(df, min_bytes=5)) == expected(rows, 5)
    back = W.read(spark, f"{tmp_path}/a").collect()
    assert all(r.intact for r in back)
    text = {r.source_id: r.payload for r in back if r.record_type == "response"}
    text = {i: bytes(x).decode() for i, x in text.items()}
    assert text[9] == "same é" and text[6] == rows[6][1] and text[8] == rows[9][1] and text[4] == ""
    named = {r.record_id: r.source_id for r in back}
    assert all(named[r.refers_to_record] == r.refers_to for r in back if r.record_type == "revisit")
    raw = gzip.decompress(next(p for p in (tmp_path / "a").glob("*.gz")).read_bytes())
    assert raw.startswith(b"WARC/1.1\r\nWARC-Type: ") and raw.endswith(b"\r\n\r\n")


def test_pages_in_another_order_at_each_run(spark, tmp_path):
    runs = tmp_path / "runs"
    runs.mkdir()

    def shuffled(batches):
        rows = pa.Table.from_batches(batches)
        (runs / uuid.uuid4().hex).touch()
        n = len(list(runs.iterdir()))
        yield from rows.take([(i + n) % rows.num_rows for i in range(rows.num_rows)]).to_batches()

    df = pages(spark).coalesce(1)
    want = expected([(r.page_id, r.html) for r in df.collect()])
    assert result(W.archived(df.mapInArrow(shuffled, df.schema))) == want


def test_rewriting_archives(spark, tmp_path):
    raw = W.records_of(pages(spark))
    W.write(raw, f"{tmp_path}/raw")
    W.rewrite(spark, f"{tmp_path}/raw", f"{tmp_path}/once")
    W.rewrite(spark, f"{tmp_path}/once", f"{tmp_path}/twice")
    want = expected([(r.page_id, r.html) for r in pages(spark).collect()])
    assert result(W.read(spark, f"{tmp_path}/once")) == result(W.read(spark, f"{tmp_path}/twice")) == want


def test_empty_table(spark):
    assert W.archived(pages(spark).limit(0)).count() == 0


def test_archives_of_others(spark, tmp_path):
    def record(version, kind, name, block, **head):
        lines = [f"WARC/{version}", f"WARC-Type: {kind}", f"WARC-Record-ID: <{name}>", f"Content-Length: {len(block)}", *(f"{k.replace('_', '-')}: {v}" for k, v in head.items())]
        return "\r\n".join(lines).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"

    http = b"HTTP/1.1 200 OK\r\nA: b\r\n\r\n"
    parts = [
        record("1.0", "warcinfo", "urn:i", b"software: x"), record("1.0", "request", "urn:q", b"GET / HTTP/1.1\r\n\r\n"),
        record("1.0", "response", "urn:a", http + b"hello", content_type="application/http", WARC_Target_URI="http://a/"),
        record("1.1", "response", "urn:b", http + b"hello \xff\r\n\r\nWARC/1.0", Content_Type="application/http; msgtype=response", WARC_Payload_Digest="sha1:WRONG"),
        record("1.1", "response", "urn:c", http + b"hello", Content_Type="application/http", WARC_Payload_Digest="sha256:00"),
        record("1.1", "revisit", "urn:r", http, Content_Type="application/http", WARC_Payload_Digest="sha1:VL2MMHO4YXUKFWV63YHTWSBM3GXKSQ2N", WARC_Refers_To="<urn:z>", X_Payload_Length=5),
    ]
    (tmp_path / "in").mkdir()
    (tmp_path / "in/members.warc.gz").write_bytes(b"".join(map(gzip.compress, parts)))
    (tmp_path / "in/whole.warc.gz").write_bytes(gzip.compress(b"".join(parts)))
    (tmp_path / "in/plain.warc").write_bytes(b"".join(parts))
    got = [(*r[:4], r.payload and bytes(r.payload)) for r in W.read(spark, str(tmp_path / "in")).select("record_id", "record_type", "payload_bytes", "intact", "payload").collect()]
    assert sorted(got) == sorted(3 * [("urn:a", "response", 5, True, b"hello"), ("urn:b", "response", 19, False, b"hello \xff\r\n\r\nWARC/1.0"), ("urn:c", "response", 5, True, b"hello"), ("urn:r", "revisit", 5, True, None)])
    W.rewrite(spark, str(tmp_path / "in"), str(tmp_path / "out"))
    again = W.read(spark, str(tmp_path / "out")).collect()
    assert all(r.intact for r in again) and {bytes(r.payload) for r in again if r.record_id == "urn:b" and r.payload} == {b"hello \xff\r\n\r\nWARC/1.0"}
    full = [r for r in again if r.record_type == "response"]
    assert len(again) == 12 and sorted(r.record_id for r in full) == ["urn:b", "urn:c"]
    assert {r.refers_to_record for r in again if r.record_type == "revisit"} == {"urn:b", "urn:c"}


def test_rewriting_keeps_bytes_headers_and_other_records(spark, tmp_path):
    png, gone = b"\x89PNG\r\n\x1a\n\x00\xff\xfe" * 9, b"HTTP/1.1 404 Not Found\r\nContent-Type: image/png\r\nX-Odd: \xff\r\n\r\n"

    def record(kind, name, block, content_type):
        return f"WARC/1.0\r\nWARC-Type: {kind}\r\nWARC-Record-ID: <{name}>\r\nContent-Type: {content_type}\r\nX-Own: é\r\nContent-Length: {len(block)}".encode() + b"\r\n\r\n" + block + b"\r\n\r\n"

    web = "application/http; msgtype=response"
    parts = [record("warcinfo", "urn:i", b"software: x\r\n\r\nmore \xfe", "application/warc-fields"), record("response", "urn:1", gone + png, web), record("response", "urn:2", gone + png, web),
             record("request", "urn:q", b"GET / HTTP/1.1\r\nHost: a\r\n\r\n", "application/http; msgtype=request"), record("response", "urn:d", b"\x00\x01 dns", "text/dns")]
    (tmp_path / "in").mkdir()
    (tmp_path / "in/a.warc.gz").write_bytes(b"".join(map(gzip.compress, parts)))
    W.rewrite(spark, str(tmp_path / "in"), str(tmp_path / "out"))
    got = {r.record_id: r for r in W.read(spark, str(tmp_path / "out"), others=True).collect()}
    assert got.keys() == {"urn:i", "urn:1", "urn:2", "urn:q", "urn:d"} and all(r.intact for r in got.values())
    assert bytes(got["urn:2"].payload) == png and bytes(got["urn:2"].http) == gone and got["urn:2"].record_type == "response"
    assert got["urn:1"].record_type == "revisit" and got["urn:1"].refers_to_record == "urn:2" and bytes(got["urn:1"].http) == gone
    assert bytes(got["urn:d"].payload) == b"\x00\x01 dns" and got["urn:d"].content_type == "text/dns" and got["urn:d"].http is None
    raw = b"".join(gzip.decompress(p.read_bytes()) for p in (tmp_path / "out").glob("*.gz"))
    assert parts[0] in raw and parts[3] in raw


def test_files_are_bounded_by_bytes(spark, tmp_path):
    df = spark.createDataFrame([(i, "u", f"{i} " + "x" * (200_000 if i % 10 == 0 else 10)) for i in range(40)], "page_id long, url string, html string").coalesce(1)
    W.write(W.records_of(df), f"{tmp_path}/a", file_bytes=450_000)
    sizes = [len(gzip.decompress(p.read_bytes())) for p in (tmp_path / "a").glob("*.gz")]
    assert max(sizes) <= 450_000 and len(sizes) > 3 and W.read(spark, f"{tmp_path}/a").count() == 40
