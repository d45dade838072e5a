import base64
import hashlib
import zlib

import pytest

from leadloom.llm import warc as W

SCHEMA = "page_id long, url string, html string, file string, key string, digest string, offset long"


def page_rows():
    rows = [(i, f"http://www.Host{i % 3}.example.com/p/{i % 11}?q={i}", f"<p>{i % 17}</p>" * (i % 5), "f", "k", "d", 1) for i in range(120)]
    rows += [(i, "https://hot.example.org/same", "hot \r\n\r\n page é", "f", "k", "d", 1) for i in range(200, 260)]
    rows += [(300, None, None, None, None, None, None), (301, "not a url\n{}", "", "f", "k", "d", 1), (302, "http://[bad", "x" * 300_000, "f", "k", "d", 1),
             (303, "http://ü.example/ä b", None, "f", "k", "d", 1), (None, "http://a.b/", "hot \r\n\r\n page é", "f", "k", "d", 1),
             (None, "http://a.b/", "lonely", "f", "k", "d", 1), (304, "http://a.b:8080/", "WARC/1.1\r\n\r\n", "f", "k", "d", 1)]
    rows.append(rows[5])
    return rows


def brute(rows):
    order = lambda r: (r[0] is None, r[0] or 0, r[1] or "")
    head = {}
    for r in sorted(rows, key=order):
        head.setdefault(r[2] or "", r)
    out = []
    for r in rows:
        p, h = (r[2] or "").encode(), head[r[2] or ""]
        first = order(r) == order(h)
        out.append((r[0], len(p), base64.b32encode(hashlib.sha1(p).digest()).decode(), "response" if first else "revisit", None if first else h[0]))
    return sorted(out, key=str)


def test_round_trip(spark):
    rows = page_rows()
    df = spark.createDataFrame(rows, SCHEMA).repartition(4)
    got = W.round_trip(df).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to").collect()
    assert sorted(map(tuple, got), key=str) == brute(rows)


@pytest.mark.parametrize("block_lines", [1, 7, 1000])
def test_lookup_finds_exactly_the_captures_of_a_key(spark, tmp_path, block_lines):
    rows = page_rows()
    folder = f"file://{tmp_path}/w"
    captures = W.write_archives(spark.createDataFrame(rows, SCHEMA).repartition(6), folder)
    index = W.CaptureIndex.build(captures, folder, block_lines)
    for url in ("https://hot.example.org/same", rows[7][1], "http://hot.example.org:80/same", None, "http://none.example/"):
        got = index.lookup(spark.createDataFrame([(url,), (url,)], "url string")).collect()
        want = [r[0] for r in rows if W.surt(r[1]) == W.surt(url)]
        assert sorted(x["page_id"] for x in got) == sorted(want)
    payloads = {r["page_id"]: r for r in index.read(index.lookup(spark.createDataFrame([(rows[7][1],)], "url string")), True).collect()}
    assert bytes(payloads[7]["payload"] or b"").decode() == rows[7][2] or payloads[7]["record_type"] == "revisit"


def test_files_are_gzip_members_of_warc_records(spark, tmp_path):
    W.write_archives(spark.createDataFrame(page_rows()[:9], SCHEMA).coalesce(1), f"file://{tmp_path}/w")
    data = b"".join(p.read_bytes() for p in (tmp_path / "w").glob("*.warc.gz"))
    n = 0
    while data:
        z = zlib.decompressobj(31)
        text = z.decompress(data)
        assert text.startswith(b"WARC/1.1\r\nWARC-Type: re") and text.endswith(b"\r\n\r\n")
        data, n = z.unused_data, n + 1
    assert n == 9


def test_small_payloads_can_always_be_responses(spark, tmp_path):
    rows = [(1, "u", "ab", "f", "k", "d", 1), (2, "u", "ab", "f", "k", "d", 1), (3, "u", "long enough", "f", "k", "d", 1), (4, "u", "long enough", "f", "k", "d", 1)]
    folder = f"file://{tmp_path}/w"
    df = spark.createDataFrame(rows, SCHEMA)
    index = W.CaptureIndex.build(W.write_archives(df, folder, min_bytes=5), folder)
    got = {r["page_id"]: r["record_type"] for r in index.read(index.lookup(df)).collect()}
    assert got == {1: "response", 2: "response", 3: "response", 4: "revisit"}


def test_surt():
    assert W.surt("http://www.A.com:80/x?y=1#f") == "com,a,www)/x?y=1"
    assert W.surt("a.com") == "com,a)/" and W.surt(None) == "" and W.surt("https://a.com:8080") == "com,a:8080)/"


def test_damage_is_noticed():
    data = W.record(1, "http://a/", b"payload", W.digest_of(b"other"), None)
    with pytest.raises(ValueError, match="damaged"):
        W.parse(data)


def test_empty_table(spark):
    assert W.round_trip(spark.createDataFrame([], SCHEMA)).collect() == []


def test_one_url_and_one_payload_for_most_captures(spark, tmp_path):
    rows = [(i, "https://hot.example.org/", "the error page of every site", "f", "k", "d", 1) for i in range(3000)]
    rows += [(3000 + i, f"https://s{i}.example.org/", f"page {i}", "f", "k", "d", 1) for i in range(50)]
    folder = f"file://{tmp_path}/w"
    df = spark.createDataFrame(rows, SCHEMA).repartition(7)
    index = W.CaptureIndex.build(W.write_archives(df, folder), folder)
    got = {r["page_id"]: r for r in index.read(index.lookup(df)).collect()}
    assert len(got) == len(rows)
    assert all((r["record_type"], r["refers_to"]) == (("revisit", 0) if 0 < i < 3000 else ("response", None)) for i, r in got.items())
