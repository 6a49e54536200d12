import base64
import gzip
import hashlib
import zlib

import pytest

from tickloom.llm import warc
from tickloom.llm.queries import QUERIES
from tickloom.llm.site_style import visible_text

SF = "/root/testdata/sf0.001"


def sha1(data):
    return "sha1:" + base64.b32encode(hashlib.sha1(data).digest()).decode()


def test_round_trip_and_links(spark, tmp_path):
    html = [None, "", "<p>x</p>", "a\r\n\r\nWARC/1.0\r\nWARC-Type: response\r\n\r\n b", "é🙂" * 20_000]
    rows = [(i, f"http://h/{i}", h, "x") for i, h in enumerate(html)] + [(None, None, "<title>t</title>n", "x"), (2, "http://h/2", "<p>x</p>", "x")]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string, headers string")
    made = warc.responses(pages)
    path = f"file://{tmp_path}/w"
    warc.write_warc(made, path, file_bytes=500)
    read = warc.read_warc(spark, path).collect()
    assert sorted((sorted(r.headers.items()), bytes(r.block)) for r in read) == sorted((sorted(r.headers.items()), bytes(r.block)) for r in made.collect())
    warc.write_warc(warc.derive(warc.read_warc(spark, path)), path + "d", file_bytes=900)
    derived = warc.read_warc(spark, path + "d").collect()
    assert len(derived) == 2 * len(rows)
    by_id = {r.headers["WARC-Record-ID"]: r for r in read}
    for r in derived:
        source = by_id[r.headers["WARC-Refers-To"]]
        body = bytes(source.block).split(b"\r\n\r\n", 1)[1]
        assert r.headers["WARC-Refers-To-Date"] == source.headers["WARC-Date"] and r.headers.get("WARC-Target-URI") == source.headers.get("WARC-Target-URI")
        assert r.headers["WARC-Block-Digest"] == sha1(bytes(r.block)) and source.headers["WARC-Payload-Digest"] == sha1(body)
        if r.headers["WARC-Type"] == "conversion":
            assert bytes(r.block).decode() == visible_text(body.decode())
        else:
            fields = dict(x.split(": ", 1) for x in bytes(r.block).decode().split("\r\n") if x)
            assert fields["source-payload-digest"] == sha1(body) and fields["source-status"] == "HTTP/1.1 200 OK" and fields["source-header-Content-Length"] == str(len(body)) and fields["source-payload-matches"] == "true"


def test_visible_text():
    html = "<head><title>t</title><meta a></head><body><nav>m<br>n</nav><script>x</script><p>a <b>b</b>&amp;c</p>d<!-- e --></body>"
    assert visible_text(html) == "m n\na b&c\nd" and visible_text("") == "" and visible_text("<p>x<head>never closed") == "x"


def test_no_records(spark, tmp_path):
    empty = spark.createDataFrame([], "page_id long, url string, html string")
    warc.write_warc(warc.responses(empty), f"file://{tmp_path}/w")
    assert warc.read_warc(spark, f"file://{tmp_path}/w").count() == 0
    other = spark.createDataFrame([({"WARC-Type": "request"}, b"GET /")], "headers map<string,string>, block binary")
    assert warc.derive(other).count() == 0


def test_query(spark):
    found = {r.page_id: r for r in QUERIES["op4_warc_derivatives"](spark, SF).collect()}
    pages = spark.read.parquet(f"{SF}/pages.parquet").collect()
    assert len(found) == len(pages)
    for p in pages:
        r, text = found[p.page_id], visible_text(p.html)
        assert (r.url, r.payload_digest, r.n_bytes, r.n_chars, r.text_sha256, r.linked) == (p.url, sha1(p.html.encode()), len(p.html.encode()), len(text), hashlib.sha256(text.encode()).hexdigest(), True)
        assert r.refers_to == warc.record_id("response", p.page_id, p.url, sha1(p.html.encode()))


def test_members_and_foreign_files(spark, tmp_path):
    """Every record is a gzip member; other WARC headers of a source are kept; plain files and blocks of any bytes are read."""
    blocks = [b"HTTP/1.1 200 OK\r\nX: y\r\n\r\n\xff\xfe\x00" + bytes(range(256)) * k for k in range(4)]
    rows = [({"WARC-Type": "response", "WARC-Record-ID": f"<urn:{k}>", "WARC-Truncated": "length", "Content-Length": str(len(b))}, b) for k, b in enumerate(blocks)]
    made = spark.createDataFrame(rows, "headers map<string,string>, block binary").coalesce(1)
    warc.write_warc(made, f"file://{tmp_path}/w", file_bytes=10**6)
    (file,) = [p.read_bytes() for p in (tmp_path / "w").glob("part-*")]
    found, members = file, []
    while found:
        d = zlib.decompressobj(31)
        members.append(d.decompress(found))
        found = d.unused_data
    assert [m.startswith(b"WARC/1.0\r\n") for m in members] == [True] * 4 + [False] and members[-1] == b""
    (tmp_path / "plain").mkdir()
    (tmp_path / "plain" / "a.warc").write_bytes(gzip.decompress(file))
    for folder in ("w", "plain"):
        read = warc.read_warc(spark, f"file://{tmp_path}/{folder}")
        assert sorted(bytes(r.block) for r in read.collect()) == sorted(blocks)
        fields = [bytes(r.block) for r in warc.derive(read).collect() if r.headers["WARC-Type"] == "metadata"]
        assert len(fields) == 4 and all(b"source-warc-WARC-Truncated: length\r\n" in f for f in fields)


def test_long_and_repeated_pages(spark, tmp_path):
    """A page of 50 MB goes to a file and back, and to its derivatives; repeated pages stay as many rows."""
    text = "<p>" + "word &amp; " * 5_000_000
    pages = spark.createDataFrame([(1, "http://h/1", text), (2, "http://h/2", "<p>x"), (2, "http://h/2", "<p>x")], "page_id long, url string, html string")
    pages.repartition(3).write.parquet(f"file://{tmp_path}/pages.parquet")
    found = sorted((r.page_id, r.n_bytes, r.n_chars, r.linked) for r in QUERIES["op4_warc_derivatives"](spark, f"file://{tmp_path}").collect())
    assert found == [(1, len(text), 7 * 5_000_000 - 1, True), (2, 4, 1, True), (2, 4, 1, True)]


def test_members_are_inflated_by_zlib(monkeypatch):
    """Each record a member, or the whole file, with zeros between, large records and empty ones; not by Python's slow reader."""
    records = [(b"WARC/1.0\r\nContent-Length: %d\r\n\r\n" % n, bytes(range(256)) * (n // 512) + b"x" * (n - n // 512 * 256)) for n in (0, 1, 5000, 3_000_000, 7)]
    want = [block for _, block in records]
    each, whole = [warc.member(h, b) for h, b in records], gzip.compress(b"".join(h + b + b"\r\n\r\n" for h, b in records))
    monkeypatch.setattr(gzip, "GzipFile", None)
    for data in (b"".join(each), warc.EMPTY.join(each), (b"\0" * 9).join(each), whole):
        assert [b for _, b in warc.parse_warc(data)] == want
    for data in (b"".join(each)[:-3], whole[: len(whole) // 2]):
        with pytest.raises(EOFError):
            list(warc.parse_warc(data))
    with pytest.raises(zlib.error):
        list(warc.parse_warc(b"".join(each)[:-6] + b"zz" + b"".join(each)[-4:]))
