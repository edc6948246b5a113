import hashlib
import base64
import gzip
import io
import random
import zlib

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from gleaner.llm.warc import EMPTY, Capture, Damage, arc_file, archive, base32_sha1, convert_arcs, full_date, read_arc, read_back, read_warc, scan_arc, warc_record


@pytest.mark.parametrize("version", [1, 2])
def test_arc_round_trip(version):
    rng = random.Random(version)
    captures = [Capture(f"http://h{i}.example/a?b={i}", "10.0.0.1", "20010203040506", "text/html", rng.randbytes(rng.choice([0, 1, 400]))) for i in range(20)]
    captures.append(Capture("", "10.0.0.1", "20010203040506", "text/html", b"http://x 1.1.1.1 20010203040506 text/html 3\nabc\n\n"))
    data = arc_file(captures, version)
    assert list(read_arc(data)) == captures
    with pytest.raises(ValueError):
        list(read_arc(data[:-10]))
    with pytest.raises(ValueError):
        list(read_arc(arc_file([], version).replace(b"text/plain ", b"text/plain - -", 1)))


def test_warc_round_trip_and_damage():
    a = Capture("http://x/ä\r\nWARC-Type: evil", "1.2.3.4", "20010203040506", "text/html", b"WARC/1.1\r\n\r\n\r\nbody\r\n\r\n")
    data = warc_record(a, 7) + b"\r\n\r\n" + warc_record(a, 8, 7, a.url, a.date) + b"\r\n\r\n"
    (h1, b1), (h2, b2) = read_warc(data)
    assert h1["warc-type"] == "response" and b1.endswith(a.payload) and h1["warc-date"] == "2001-02-03T04:05:06Z"
    assert h2["warc-type"] == "revisit" and h2["warc-refers-to"] == h1["warc-record-id"] and b2.endswith(b"\r\n\r\n") and h2["warc-payload-digest"] == h1["warc-payload-digest"]
    for bad in (data[:-5], data.replace(b"body", b"bodi", 1), b"x" + data):
        with pytest.raises(ValueError):
            list(read_warc(bad))


def test_archive(spark):
    rng = random.Random(2)
    rows = [(i, f"http://h{i % 9}.example/{i}", rng.choice(["<p>ä</p>", "", None, f"<p>{i}</p>\r\n\r\nWARC/1.1\r\n", "x" * rng.randint(1, 5000)])) for i in range(150)]
    rows += [(500, None, "<b>"), (501, "http://a b", "<b>"), (None, "http://n", "<i>"), (502, "u", "y" * 500_000), (503, "u", "<p>ä</p>"), (503, "u", "<p>ä</p>")]
    df = spark.createDataFrame(rows, "page_id long, url string, html string").selectExpr("*", "1 as number", "2 as n", "3 as digest").repartition(4)
    for least in (0, 9):
        most = {}
        for i, _, h in rows:
            b = (h or "").encode()
            if len(b) >= least and i is not None:
                most[b] = max(i, most.get(b, i))
        want = []
        for i, _, h in rows:
            b = (h or "").encode()
            win = most.get(b)
            again = win is not None and i is not None and win != i
            want.append((i, len(b), base64.b32encode(hashlib.sha1(b).digest()).decode(), "revisit" if again else "response", win if again else None))
        got = [tuple(r)[:5] for r in archive(df, least).collect()]
        assert sorted(got, key=str) == sorted(want, key=str)
    assert archive(df.limit(0)).count() == 0


OLD = b"""filedesc://old-crawl.arc 0.0.0.0 20000103110000 text/plain 72
1 0 OldCrawler
URL IP-address Archive-date Content-type Archive-length

http://a.example/ 192.0.2.1 20000103110102 text/html 69
HTTP/1.0 200 OK\r
Server: old\r
Content-Type: text/html\r
\r
<h1>one</h1>

http://a.example/gone 192.0.2.1 20000103110103 text/html 44
HTTP/1.0 404 Not Found\nServer: old\n\nnothing\n
dns:a.example 192.0.2.9 20000103110104 text/dns 20
a.example. A 192.0.2
"""
# a header of version 2 with the fields that version adds
NEW = (
    b"filedesc://new.arc 0.0.0.0 20020103110000 text/plain 200 - - 0 new.arc 117\n"
    b"2 0 NewCrawler\nURL IP-address Archive-date Content-type Result-code Checksum Location Offset Filename Archive-length\n"
    b"http://b.example/ 192.0.2.2 20020103110102 text/html 200 - - 200 new.arc 50\nHTTP/1.1 200 OK\r\nTransfer: x\r\n\r\n<h1>one</h1>\r\n\r\n\r\n\n"
    b"http://b.example/plain 192.0.2.2 20020103110105 text/plain 200 - - 300 new.arc 12\n<h1>one</h1>\n"
)


def test_legacy_files_with_http_headers():
    old = list(read_arc(OLD))
    assert [(c.url, c.status, c.payload) for c in old] == [
        ("http://a.example/", "200", b"<h1>one</h1>"), ("http://a.example/gone", "404", b"nothing\n"), ("dns:a.example", "200", b"a.example. A 192.0.2"),
    ]
    assert old[0].head.endswith(b"text/html\r\n\r\n") and old[1].head == b"HTTP/1.0 404 Not Found\nServer: old\n\n" and old[2].head == b""
    new = list(read_arc(NEW))
    assert [(c.url, c.status, c.payload) for c in new] == [("http://b.example/", "200", b"<h1>one</h1>\r\n\r\n\r\n"), ("http://b.example/plain", "200", b"<h1>one</h1>")]
    ((h, block),) = read_warc(warc_record(old[0], 1) + b"\r\n\r\n")
    assert block == old[0].head + b"<h1>one</h1>" and block.count(b"HTTP/") == 1
    assert h["warc-payload-digest"] == f"sha1:{base32_sha1(b'<h1>one</h1>')}" and h["warc-block-digest"] == f"sha1:{base32_sha1(block)}"


def test_convert_files_by_path(spark, tmp_path):
    head = b"HTTP/1.1 200 OK\r\nServer: s\r\n\r\n"
    one = [Capture(f"http://a/{i}", "192.0.2.1", f"2001010101010{i}", "text/html", b"<p>same</p>" if i < 3 else b"<p>%d</p>" % i, "200", head) for i in range(6)]
    two = [Capture(f"http://b/{i}", "192.0.2.2", f"2002010101010{i}", "text/html", [b"<p>same</p>", b"", b"big" * 90_000][i], "200", b"" if i else head) for i in range(3)]
    (tmp_path / "in" / "deep").mkdir(parents=True)
    (tmp_path / "in" / "a.arc").write_bytes(arc_file(one, 1, "a.arc"))
    data = arc_file(two, 2, "b.arc")
    (tmp_path / "in" / "deep" / "b.arc.gz").write_bytes(gzip.compress(data[:100]) + gzip.compress(data[100:]))
    (tmp_path / "in" / "notes.txt").write_text("no archive")
    convert_arcs(spark, f"file://{tmp_path}/in", f"file://{tmp_path}/out", file_bytes=3000)
    got = {r.url: r for r in read_back(spark, f"file://{tmp_path}/out").collect()}
    assert set(got) == {c.url for c in one + two}
    for c in one + two:
        assert got[c.url].payload_bytes == len(c.payload) and got[c.url].payload_digest == base32_sha1(c.payload)
        assert got[c.url].record_type == ("revisit" if c.payload == b"<p>same</p>" and c.url != "http://b/0" else "response")
    files = sorted((tmp_path / "out").glob("part-*"))
    assert len(files) > 2
    for f in files:  # one gzip member for each record, and an empty one at the end
        data, n = f.read_bytes(), 0
        assert data.endswith(EMPTY)
        while data:
            d = zlib.decompressobj(31)
            found = list(read_warc(d.decompress(data)))
            assert d.eof and len(found) == (1 if d.unused_data else 0)
            data = d.unused_data
            n += len(found)
        assert n
    again = list(read_warc(b"".join(gzip.decompress(f.read_bytes()) for f in files)))
    assert len(again) == 11 and all(b.count(b"HTTP/1.1") == 1 for h, b in again if h["warc-type"] != "warcinfo")
    assert sorted(h["warc-filename"] for h, _ in again if h["warc-type"] == "warcinfo") == ["a.arc", "b.arc"]


ODD = b"""filedesc://odd.arc 0.0.0.0 19960923142103 text/plain 65
1 0 Odd
URL IP-address Archive-date Content-type Archive-length

http://a/b c 192.0.2.1 20000103110102 text/html 5
12345
http://a/type 192.0.2.1 20000103110102 text/html; charset=x 5
12345
http://a/early 192.0.2.1 199609231421 text/html 5
12345
dns:a.example 192.0.2.9 20000103110104 text/dns 20
a.example. A 192.0.2
ftp://f/x - 20000103 application/octet-stream 3
abc
http://a/bad 192.0.2.1 20001303110102 text/html 5
12345
http://a/wrong 192.0.2.1 20000103110102 text/html 3
12345
more of it
http://a/next 2001:db8::1 20000103110102 text/html 5
12345
http://a/cut 192.0.2.1 20000103110102 text/html 500
123"""


def test_lines_that_crawls_have():
    found = list(scan_arc(io.BytesIO(ODD)))
    good, bad = [c for c in found if not isinstance(c, Damage)], [c for c in found if isinstance(c, Damage)]
    assert [(c.url, c.date, c.mime, c.kind) for c in good] == [
        ("filedesc://odd.arc", "19960923142103", "application/warc-fields", "warcinfo"), ("http://a/b c", "20000103110102", "text/html", "response"),
        ("http://a/type", "20000103110102", "text/html; charset=x", "response"), ("http://a/early", "19960923142100", "text/html", "response"),
        ("dns:a.example", "20000103110104", "text/dns", "resource"), ("ftp://f/x", "20000103000000", "application/octet-stream", "resource"),
        ("http://a/wrong", "20000103110102", "text/html", "response"), ("http://a/next", "20000103110102", "text/html", "response"),
    ]
    assert [d.reason.split(":")[0] for d in bad] == ["no date", "no header line", "500 bytes declared, 3 left"]
    assert bad[1].n_bytes == len(b"45\nmore of it\n") and ODD[bad[1].offset :].startswith(b"45\nmore of it\n")
    ((h, block),) = read_warc(warc_record(good[4], 1) + b"\r\n\r\n")
    assert h["warc-type"] == "resource" and h["content-type"] == "text/dns" and block == b"a.example. A 192.0.2" and h["warc-payload-digest"] == h["warc-block-digest"]
    ((h, block),) = read_warc(warc_record(good[0], 0) + b"\r\n\r\n")
    assert h["warc-type"] == "warcinfo" and b"publisher: Odd\r\n" in block and "warc-target-uri" not in h
    ((h, _),) = read_warc(warc_record(good[3], 1) + b"\r\n\r\n")
    assert h["warc-date"] == "1996-09-23T14:21:00Z"


@pytest.mark.parametrize(("date", "want"), [("1996", "19960101000000"), ("199612", "19961201000000"), ("2000022910", "20000229100000"), ("20000103110102123", "20000103110102"), ("19970229", None), ("199", None), ("20000103110199", None)])
def test_dates(date, want):
    if want is None:
        with pytest.raises(ValueError, match="no date"):
            full_date(date)
    else:
        assert full_date(date) == want


@settings(max_examples=200, deadline=None)
@given(st.data())
def test_no_bytes_end_the_scan(data):
    """Whatever is done to a file, scanning it ends, and its captures before the damage are there."""
    sound = arc_file([Capture(f"http://h/{i}", "192.0.2.1", "20010203040506", "text/html", b"x" * i) for i in range(8)], data.draw(st.sampled_from([1, 2])))
    at = data.draw(st.integers(0, len(sound)))
    broken = sound[:at] + data.draw(st.binary(max_size=60)) + sound[data.draw(st.integers(at, len(sound))) :]
    before = [c for c in read_arc(sound) if sound.index(c.url.encode() + b" ") + 200 < at]
    found = [c for c in scan_arc(io.BytesIO(broken)) if isinstance(c, Capture) and c.kind != "warcinfo"]
    assert found[: len(before)] == before


def test_damaged_files_do_not_end_a_job(spark, tmp_path):
    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "odd.arc").write_bytes(ODD)
    (tmp_path / "in" / "none.arc").write_bytes(b"")
    (tmp_path / "in" / "junk.arc").write_bytes(b"\x00\xff" * 500)
    packed = gzip.compress(arc_file([Capture("http://g/1", "192.0.2.1", "20010203040506", "text/html", b"12345"), Capture("http://g/2", "192.0.2.1", "20010203040506", "text/html", random.Random(1).randbytes(9000))], 1, "g.arc"))
    (tmp_path / "in" / "g.arc.gz").write_bytes(packed[:4000])
    aside = convert_arcs(spark, f"file://{tmp_path}/in", f"file://{tmp_path}/out").collect()
    assert sorted((r.file, r.reason.split(":")[0]) for r in aside) == [
        ("g.arc.gz", "cannot be unpacked"), ("junk.arc", "no header line"), ("odd.arc", "500 bytes declared, 3 left"), ("odd.arc", "no date"), ("odd.arc", "no header line"),
    ]
    got = {r.url: r.record_type for r in read_back(spark, f"file://{tmp_path}/out").collect()}
    assert len(got) == 8 and got["dns:a.example"] == got["ftp://f/x"] == "resource" and sum(t == "response" for t in got.values()) == 2
