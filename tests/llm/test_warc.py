import gzip

import pytest

from papyra.llm import warc

from . import brute
from .conftest import prose, rows

PAGES = [(0, "http://a/ b", "<p>é</p>"), (1, None, None), (2, "", ""), (3, "http://c/?q=ü", prose(1, 3000)), (4, "x", "<p>é</p>"), (5, "y", "<p>é</p>"), (6, "z", "filedesc://x 0.0.0.0\n2 1\n\r\n\r\nWARC/1.0\r\n"), (7, "w", "a\x00b\r\n\r\nc"), (8, "v", "X-Page-Id: 99\r\n\r\nContent-Length: 5"), (9, "v", "z" * 3_000_000)]
COLUMNS = ("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


@pytest.fixture(scope="module")
def pages(spark):
    return spark.createDataFrame([(*p, "clash") for p in PAGES], "page_id long, url string, html string, name string").repartition(2)


@pytest.mark.parametrize("size", [warc.ARCHIVE_BYTES, 200])
def test_round_trip(pages, monkeypatch, size):
    monkeypatch.setattr(warc, "ARCHIVE_BYTES", size)
    out = warc.read_records(warc.convert(warc.write_arc(pages)))
    assert rows(out, *COLUMNS) == sorted(brute.warc([(i, h) for i, _, h in PAGES]), key=repr)


def test_both_versions(pages):
    arcs = warc.write_arc(pages.repartition(5)).collect()
    assert {a.version for a in arcs} == {1, 2}
    for a in arcs:
        raw = gzip.decompress(a.content)
        assert raw.startswith(b"filedesc://" + a.name.encode()) and f"\n{warc.ARC_FIELDS[a.version]}\n".encode() in raw[:400]
        for at, head, block in warc.read_arc(a.content):
            assert len(block) == int(head["Archive-length"]) and a.content[at : at + 2] == b"\x1f\x8b"
            if a.version == 2:
                assert int(head["Offset"]) == at


def test_records(pages):
    for a in warc.convert(warc.write_arc(pages, "19991231235958")).collect():
        (info, _), *own = warc.read_warc(a.content)
        assert info["WARC-Type"] == "warcinfo" and info["WARC-Filename"] == a.name and info["Content-Type"] == "application/warc-fields"
        for head, block in own:
            assert head["WARC-Date"] == "1999-12-31T23:59:58Z" and head["WARC-Record-ID"].startswith("<urn:uuid:") and " " not in head["WARC-Target-URI"]
            assert head["WARC-Block-Digest"] == f"sha1:{warc.digest(block)}"
            names = {"WARC-Refers-To", "WARC-Refers-To-Target-URI", "WARC-Refers-To-Date", "WARC-Profile"}
            assert names & set(head) == (names if head["WARC-Type"] == "revisit" else set())
    read = warc.read_records(warc.convert(warc.write_arc(pages))).collect()
    by = {r.record_id: r for r in read}
    assert len(by) == len(read) and all(by[r.refers_to_id].record_type == "response" and by[r.refers_to_id].payload_digest == r.payload_digest for r in read if r.refers_to_id)


def test_pages_without_an_id(spark):
    df = spark.createDataFrame([(None, "http://a/1", "same"), (None, "http://a/2", "same"), (3, "http://a/3", "other"), (None, None, "other"), (None, None, "alone")], "page_id long, url string, html string")
    out = rows(warc.read_records(warc.convert(warc.write_arc(df))), "page_id", "payload_bytes", "record_type", "refers_to")
    assert out == sorted([(None, 4, "revisit", None), (None, 4, "response", None), (3, 5, "response", None), (None, 5, "revisit", 3), (None, 5, "response", None)], key=repr)


def test_payload_of_many_pages(spark):
    df = spark.range(400).selectExpr("id AS page_id", "concat('http://a/', id) AS url", "CASE WHEN id % 2 = 0 THEN 'same' ELSE concat('own ', id div 4) END AS html")
    want = brute.warc([(r.page_id, r.html) for r in df.collect()])
    assert rows(warc.read_records(warc.convert(warc.write_arc(df.repartition(3)))), *COLUMNS) == sorted(want, key=repr)


HTTP = b"HTTP/1.0 200 OK\r\nContent-Type: text/html; charset=x\r\n\r\n<p>http://x 1.2.3.4 20010203040506 text/html 9\n</p>"
DNS = b"20010203040500\nexample.org. 300 IN A 1.2.3.4\n"


def genuine(version, broken=b""):
    """An archive as crawlers wrote them: blanks in content type and URL, a name server's answer, a head with bare line feeds, no page ids."""
    more = (lambda at: b" 200 - - %d a.arc" % at) if version == 2 else (lambda at: b"")
    about = b"%d 0 Some Archive\n%s\n\n" % (version, warc.ARC_FIELDS[version].encode())
    bare = HTTP.replace(b"\r\n", b"\n")
    out = [b"filedesc://a.arc 0.0.0.0 20010203040500 text/plain%s %d\n" % (more(0), len(about)) + about]
    for url, mime, block in ((b"dns:example.org", b"text/dns", DNS), (b"http://example.org/a b", b"text/html; charset=x", HTTP), (b"http://example.org/c", b"text/html", bare)):
        out.append(b"%s 1.2.3.4 20010203040506 %s%s %d\n" % (url, mime, more(7), len(block)) + block + b"\n")
        out.append(broken)
    return [x for x in out if x]


@pytest.mark.parametrize("version", [1, 2])
@pytest.mark.parametrize("form", ["plain", "members", "whole"])
def test_archives_of_others(spark, version, form):
    parts = genuine(version)
    content = {"plain": b"".join(parts), "members": b"".join(map(gzip.compress, parts)), "whole": gzip.compress(b"".join(parts))}[form]
    got = list(warc.read_arc(content))
    assert [(h["URL"], h["Content-type"], h["Archive-date"], b) for _, h, b in got] == [("dns:example.org", "text/dns", "20010203040506", DNS), ("http://example.org/a b", "text/html; charset=x", "20010203040506", HTTP), ("http://example.org/c", "text/html", "20010203040506", HTTP.replace(b"\r\n", b"\n"))]
    places = {"plain": [sum(map(len, parts[:k])) for k in (1, 2, 3)], "members": [sum(len(gzip.compress(x)) for x in parts[:k]) for k in (1, 2, 3)], "whole": [-1 - sum(map(len, parts[:k])) for k in (1, 2, 3)]}[form]
    assert [at for at, _, _ in got] == places
    arcs = spark.createDataFrame([("a.arc", version, content)], warc.ARCHIVE)
    warcs = warc.convert(arcs)
    out = sorted(warc.read_records(warcs).collect(), key=lambda r: r.url)
    assert [(r.url, r.page_id, r.record_type, r.payload_bytes, r.date) for r in out] == [
        ("dns:example.org", None, "resource", len(DNS), "2001-02-03T04:05:06Z"), ("http://example.org/a%20b", None, "revisit", 51, "2001-02-03T04:05:06Z"), ("http://example.org/c", None, "response", 51, "2001-02-03T04:05:06Z"),
    ]
    assert out[1].refers_to_id == out[2].record_id and warc.read_errors(arcs).count() == 0
    heads = [h for r in warcs.collect() for h, _ in warc.read_warc(r.content)]
    assert [h["Content-Type"] for h in heads if h["WARC-Type"] == "resource"] == ["text/dns"]


@pytest.mark.parametrize("version", [1, 2])
def test_bad_records_are_reported(spark, version):
    content = b"".join(genuine(version, b"not a header\nat all\n")) + b"http://example.org/cut 1.2.3.4 20010203040506 text/html%s 5000\nshort" % (b" 200 - - 7 a.arc" if version == 2 else b"")
    arcs = spark.createDataFrame([("a.arc", version, content), ("b.arc", version, gzip.compress(b"".join(genuine(version)))[:-9])], warc.ARCHIVE)
    assert warc.read_records(warc.convert(arcs)).where("name IS NOT NULL").count() == 6
    errors = [(r.name, r.error) for r in warc.read_errors(arcs).orderBy("name", "at").collect()]
    assert [e for _, e in errors if "no ARC header" in e] == ["no ARC header: not a header"] * 3 and any("5000 bytes is cut" in e for _, e in errors) and any(n == "b.arc" and "gzip" in e for n, e in errors)


def test_repeated_rows_and_threshold(pages):
    twice = warc.read_records(warc.convert(warc.write_arc(pages.union(pages.where("page_id = 5")))))
    assert twice.where("page_id = 5 AND record_type = 'response'").count() == 2
    assert {r.page_id for r in warc.read_records(warc.convert(warc.write_arc(pages), min_bytes=5)).where("record_type = 'revisit'").collect()} == {0, 4}
    assert warc.read_records(warc.convert(warc.write_arc(pages.limit(0)))).count() == 0


def test_damage(pages):
    own = warc.convert(warc.write_arc(pages.coalesce(1))).first().content
    with pytest.raises(ValueError):
        list(warc.read_warc(own[:-9]))
    raw = gzip.decompress(own)
    with pytest.raises(ValueError):
        list(warc.read_warc(raw.replace(b"<p>", b"<b>")))
    assert len(list(warc.read_warc(raw))) == len(PAGES) + 1


def test_export(pages, tmp_path):
    files = warc.export(warc.convert(warc.write_arc(pages)), f"file://{tmp_path}/out").collect()
    assert files and all((tmp_path / "out" / f.name).stat().st_size == f.bytes for f in files)


def test_tables(spark, sf):
    from papyra.llm.queries import op5_warc

    read = [tuple(r) for r in spark.read.parquet(f"{sf}/pages.parquet").select("page_id", "html").collect()]
    assert rows(op5_warc(spark, sf)) == sorted(brute.warc(read), key=repr)
