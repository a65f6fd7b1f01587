"""Page dumps: records, batch and stream reads, pushed filters, fetches."""

import gzip

from tallyrack.sources import warc as W


def record(url, status, body, kind="response", extra="", charset="utf-8"):
    http = f"HTTP/1.1 {status} Any\r\nContent-Type: text/html; charset={charset}\r\n{extra}\r\n".encode() + body
    head = f"WARC/1.0\r\nWARC-Type: {kind}\r\nWARC-Target-URI: {url}\r\nWARC-Date: 2024-05-06T07:08:09Z\r\nContent-Length: {len(http)}\r\n\r\n".encode()
    return head + http + b"\r\n\r\n"


ONE = [record("https://www.a.example.com/x", 200, "é WARC/1.0\r\n\r\n<p>".encode()), record("https://a.example.com/r", 301, b"", extra="Location: /x2\r\n"), record("https://a.example.com/q", 200, b"", kind="request")]
TWO = [record("http://b.example.com/z", 200, "grün".encode("latin-1"), charset="latin-1"), record("http://b.example.com/g", 404, gzip.compress(b"gone"), extra="Content-Encoding: gzip\r\n")]


def files(folder):
    folder.mkdir(exist_ok=True)
    (folder / "a-1.warc").write_bytes(b"".join(ONE) + TWO[0][:60])
    (folder / "a-2.warc.gz").write_bytes(b"".join(map(gzip.compress, TWO)))
    (folder / "notes.txt").write_text("WARC/1.0")


def test_dump(spark, tmp_path):
    files(tmp_path / "d")
    rows = {r.url: r for r in W.dump(spark, str(tmp_path / "d")).collect()}
    assert rows.keys() == {"https://www.a.example.com/x", "https://a.example.com/r", "http://b.example.com/z", "http://b.example.com/g"}
    x = rows["https://www.a.example.com/x"]
    assert x.html == "é WARC/1.0\r\n\r\n<p>" and x.host == "a.example.com" and x.status == 200 and str(x.fetched) == "2024-05-06 07:08:09" and x.file.endswith("a-1.warc")
    assert rows["https://a.example.com/r"].location == "/x2" and rows["http://b.example.com/z"].html == "grün" and rows["http://b.example.com/g"].html == "gone"
    own = W.dump(spark, f"file://{tmp_path}/d").filter("host IN ('b.example.com', 'c') AND status = 404 AND url LIKE '%g'")
    assert [r.url for r in own.collect()] == ["http://b.example.com/g"]
    assert W.dump(spark, str(tmp_path / "none")).collect() == []


def test_pushed_filters():
    reader = W.DumpReader("x")
    left = list(reader.pushFilters([W.EqualTo(("status",), 200), W.In(("host",), ("a", "b")), W.EqualTo(("url",), "u"), W.EqualTo(("host",), "b")]))
    assert [f.attribute for f in left] == [("url",)] and reader.wanted == {"status": {200}, "host": {"b"}}
    headers, content = next(iter(W.records(__import__("io").BytesIO(ONE[1]))))
    assert W.response(headers, content, {"status": {200}}) is None and W.response(headers, content, {"status": {301}})[3] == 301


def test_dump_as_a_stream_that_is_stopped(spark, tmp_path):
    """Each file is read once, before and after a restart."""
    folder = tmp_path / "d"
    files(folder)
    for more in (None, b"".join(ONE[:1])):
        if more:
            (folder / "a-3.warc").write_bytes(more)
        run = W.dump_stream(spark, str(folder)).writeStream.format("parquet").option("path", str(tmp_path / "out")).option("checkpointLocation", str(tmp_path / "c")).trigger(availableNow=True).start()
        assert run.awaitTermination(120)
    got = sorted((r.file.rpartition("/")[2], r.url[-2:]) for r in spark.read.parquet(str(tmp_path / "out")).collect())
    assert got == [("a-1.warc", "/r"), ("a-1.warc", "/x"), ("a-2.warc.gz", "/g"), ("a-2.warc.gz", "/z"), ("a-3.warc", "/x")]


def test_fetches(spark, tmp_path):
    pages = spark.createDataFrame(
        [("http://s.example.com/a", 302, "b?x=1", None), ("http://s.example.com/b?x=1", 301, "/c", ""), ("http://s.example.com/c", 200, None, "ok"), ("http://s.example.com/l", 307, "/m", ""), ("http://s.example.com/m", 307, "/l", ""), ("http://s.example.com/e", 503, None, "busy"), ("http://s.example.com/n", 304, None, "same")],
        "url string, status int, location string, html string",
    )
    wanted = spark.createDataFrame([(f"http://s.example.com/{p}",) for p in "aclenz"] + [("http://s.example.com/a",)], "url string")
    got = {r.url[-1]: (r.final_url, r.status, r.html, r.error) for r in W.fetched(wanted, pages, 5).collect()}
    at = "http://s.example.com/"
    assert got == {"a": (at + "c", 200, "ok", None), "c": (at + "c", 200, "ok", None), "l": (at + "m", 307, None, "too_many_redirects"), "e": (at + "e", 503, None, "http_503"), "n": (at + "n", 304, "same", None), "z": (at + "z", None, None, "page_load_failed")}
    pages.write.parquet(str(tmp_path / "p.parquet"))
    assert W.stored(spark, str(tmp_path / "p.parquet")).count() == 7
