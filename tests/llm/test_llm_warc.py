import glob
import gzip
import hashlib
import random
from collections import Counter
from html.parser import HTMLParser

from vigil.llm import warc, warcfiles
from vigil.llm.queries import op6_warc_derivatives

PAGE = (
    '<!DOCTYPE html><html lang="de"><head><title>A &amp; B\n c</title><script>var t="</p>";</script><style>p{}</style></head>'
    '<body><!-- <p>no</p> --><h1>One</h1><p>two <b>bold</b> &lt;tag&gt; &#8217;x&#x21;<br>three</p><a href="/x?a=1&amp;b=2" title="1>0">link</a>'
    "<A HREF='http://y/'>up</A><noscript>hidden</noscript><p>tail"
)
SCHEMA = "page_id long, url string, html string, type string, block string, header string, page string"


def frame(spark, rows):
    return spark.createDataFrame([(*r, "t", "b", "h", "p") for r in rows], SCHEMA).repartition(2)


def test_plain_text():
    assert warc.plain_text(PAGE) == "A & B\nc\nOne\ntwo bold <tag> ’x!\nthree\nlinkup\ntail"
    assert warc.plain_text("") == "" and warc.plain_text("a < b") == "a < b"
    assert warc.plain_text("x<script>never closed <p>y") == "x"
    assert warc.plain_text("x<!-- never closed <p>y") == "x"


class Reader(HTMLParser):
    """A second way to the text, by the standard library's tokenizer."""

    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.out, self.off = [], 0

    def handle_starttag(self, tag, attrs):
        self.off += tag in warc._DROPPED
        self.out.append("\n" if tag in warc._BLOCK else "")

    def handle_endtag(self, tag):
        self.off -= tag in warc._DROPPED
        self.out.append("\n" if tag in warc._BLOCK else "")

    def handle_data(self, data):
        if not self.off:
            self.out.append(data)


def test_plain_text_equals_a_parser_on_the_pages(spark):
    for (page,) in spark.read.parquet("/root/testdata/sf0.001/pages.parquet").select("html").collect():
        reader = Reader()
        reader.feed(page)
        reader.close()
        lines = (" ".join(x.split()) for x in "".join(reader.out).split("\n"))
        assert warc.plain_text(page) == "\n".join(x for x in lines if x)


def read_warc(raw):
    """Headers and block of each record, by a plain walk over the bytes."""
    out, at = [], 0
    while at < len(raw):
        stop = raw.index(b"\r\n\r\n", at)
        version, *lines = raw[at:stop].decode().split("\r\n")
        assert version.startswith("WARC/")
        headers = dict(x.split(": ", 1) for x in lines)
        begin = stop + 4
        at = begin + int(headers["Content-Length"])
        assert raw[at : at + 4] == b"\r\n\r\n"
        out.append((headers, raw[begin:at]))
        at += 4
    return out


def test_records_are_linked_and_carry_digests(spark, tmp_path):
    rows = [(1, "http://a/b c", PAGE), (2, None, None), (3, "http://e/", ""), (None, "http://n/\r\nX: y", "<p>ü</p>"), (3, "http://e/", "")]
    source = warc.responses(frame(spark, rows))
    records = warc.derivatives(source)
    warc.write_warc(records, str(tmp_path / "out"))
    got = [x for f in sorted(glob.glob(str(tmp_path / "out/part-*"))) for x in read_warc(open(f, "rb").read())]
    assert len(got) == 10
    responses = {r["record_id"]: r for r in source.collect()}
    conversions = {h["WARC-Record-ID"] for h, _ in got if h["WARC-Type"] == "conversion"}
    for headers, block in got:
        r = responses[headers["WARC-Refers-To"]]
        assert headers["WARC-Block-Digest"] == "sha256:" + hashlib.sha256(block).hexdigest()
        assert headers["WARC-Payload-Digest"] == r["payload_digest"] == "sha256:" + hashlib.sha256(r["payload"].encode()).hexdigest()
        assert headers.get("WARC-Target-URI") == r["target_uri"] and headers["WARC-Date"] == warc.DATE
        if headers["WARC-Type"] == "metadata":
            assert headers["WARC-Concurrent-To"] in conversions
        else:
            assert block.decode() == warc.plain_text(r["payload"])
    meta = next(b.decode() for h, b in got if h["WARC-Type"] == "metadata" and h.get("WARC-Target-URI") == "http://a/b c")
    assert meta == (
        "title: A & B c\r\nlanguage: de\r\nhttp-status: HTTP/1.1 200 OK\r\nhttp-header: Content-Type: text/html; charset=utf-8\r\n"
        f"http-header: Content-Length: {len(PAGE.encode())}\r\noutlink: /x?a=1&b=2\r\noutlink: http://y/\r\n"
    )


def test_empty_table_and_long_page(spark):
    assert warc.derivatives(warc.responses(frame(spark, []))).count() == 0
    rnd = random.Random(1)
    page = "".join(rnd.choice(["<p>", "</div>", "<a href='", '"', "'", ">", "<", "word ", "&amp;", "<!--"]) for _ in range(60_000))
    got = warc.derivatives(warc.responses(frame(spark, [(1, "u", page)]))).where("type = 'conversion'").collect()
    assert got[0]["block"] == warc.plain_text(page)


def record(kind, ident, block, *more):
    lines = [b"WARC/1.0", b"WARC-Type: " + kind, b"WARC-Record-ID: <" + ident + b">", *more, b"Content-Length: " + str(len(block)).encode()]
    return b"\r\n".join(lines) + b"\r\n\r\n" + block + b"\r\n\r\n"


def archive(seed, nested=True):
    """Records with blocks of all kinds; with ``nested``, archives in archives and false record starts."""
    rnd = random.Random(seed)
    out = [record(b"warcinfo", b"i%d" % seed, b"software: x\r\n")]
    for k in range(60):
        body = bytes(rnd.choice(b"ab\r\n\x00\xff\xc3 WARC/") for _ in range(rnd.choice([0, 1, 7, 300, 3000])))
        body += rnd.choice([b"", b"\r\n", b"\r\n\r\n", b"\r\n\r\nWARC", b"\r\n\r\n\r\n"])
        if nested and k % 9 == 4:
            body += b"\r\n\r\n" + record(b"response", b"inner%d" % k, b"in the block") * 2 + b"tail\r\n\r\nWARC/1.0\r\nContent-Length: 99999\r\n\r\nx"
        out.append(record([b"response", b"request"][k % 4 == 3], b"s%dr%d" % (seed, k), body, b"warc-date:  2019-0%d-01T00:00:00Z" % (1 + k % 9), b"X-Note: a\r\n folded"))
    return out


def found(spark, path):
    return Counter((r["block"] is not None and bytes(r["block"]), r["id"]) for r in warcfiles.read_records(spark, path).where("whole").select("block", warcfiles.field(warc.F.col("head"), "WARC-Record-ID").alias("id")).collect())


def wanted(*archives):
    return Counter((block, h["WARC-Record-ID"]) for a in archives for r in a for h, block in [(dict(x.split(":", 1) if ": " not in x else x.split(": ", 1) for x in r[: r.index(b"\r\n\r\n")].decode().replace("\r\n ", " ").split("\r\n")[1:]), r[r.index(b"\r\n\r\n") + 4 : -4])])


def test_files_are_read_by_splits_and_by_members(spark, tmp_path):
    a, b, c = archive(1), archive(2, nested=False), archive(3)
    (tmp_path / "a.warc").write_bytes(b"".join(a))
    (tmp_path / "b.warc").write_bytes(b"".join(b))
    (tmp_path / "c.warc.gz").write_bytes(b"".join(gzip.compress(r) for r in c))
    (tmp_path / "d.warc").write_bytes(b"")
    for size in (b"128m", b"20000b", b"3001b"):
        spark.conf.set("spark.sql.files.maxPartitionBytes", size.decode())
        try:
            assert found(spark, str(tmp_path)) == wanted(a, b, c), size
        finally:
            spark.conf.unset("spark.sql.files.maxPartitionBytes")


def test_a_record_that_ends_early_is_not_whole(spark, tmp_path):
    (tmp_path / "a.warc").write_bytes(record(b"response", b"x", b"fine") + record(b"response", b"y", b"0123456789")[:-9])
    got = sorted((r["whole"], bytes(r["block"])) for r in warcfiles.read_records(spark, str(tmp_path)).collect())
    assert got == [(False, b"01234"), (True, b"fine")]


def test_derivatives_keep_what_the_source_says(spark, tmp_path):
    http = "HTTP/1.1 203 Fine\r\nServer: s/1\r\nContent-Type: text/html; charset=iso-8859-1\r\nSet-Cookie: a=1\r\nSet-Cookie: b=2\r\n\r\n"
    page = http.encode() + "<title>Süß</title><p>één".encode("latin-1")
    plain = b"HTTP/1.0 200 OK\r\ncontent-type: text/plain\r\n\r\nas <it> is"
    image = b"HTTP/1.0 200 OK\r\nContent-Type: image/png\r\n\r\n\x89PNG\r\n\r\n\x00"
    raw = record(b"response", b"urn:a", page, b"WARC-Date: 2020-02-03T04:05:06Z", b"WARC-Target-URI: http://h/", b"WARC-Payload-Digest: sha1:ABC")
    raw += record(b"request", b"urn:q", b"GET / HTTP/1.1\r\n\r\n") + record(b"response", b"urn:p", plain) + record(b"response", b"urn:i", image) + record(b"response", b"urn:n", b"no empty line")
    (tmp_path / "a.warc").write_bytes(raw)
    got = {(r["refers_to"], r["type"]): r for r in warc.derivatives(warcfiles.read_responses(spark, str(tmp_path))).collect()}
    assert {i for i, _ in got} == {"<urn:a>", "<urn:p>", "<urn:i>", "<urn:n>"}
    a, meta = got["<urn:a>", "conversion"], got["<urn:a>", "metadata"]
    assert a["block"] == "Süß\néén" and got["<urn:p>", "conversion"]["block"] == "as <it> is" and got["<urn:i>", "conversion"]["block"] == ""
    assert "WARC-Date: 2020-02-03T04:05:06Z\r\n" in a["header"] and a["payload_digest"] == meta["payload_digest"] == "sha1:ABC" and a["target_uri"] == "http://h/"
    assert meta["block"] == (
        "title: Süß\r\nlanguage: \r\nhttp-status: HTTP/1.1 203 Fine\r\nhttp-header: Server: s/1\r\n"
        "http-header: Content-Type: text/html; charset=iso-8859-1\r\nhttp-header: Set-Cookie: a=1\r\nhttp-header: Set-Cookie: b=2\r\n"
    )
    assert got["<urn:i>", "metadata"]["payload_digest"] == "sha256:" + hashlib.sha256(b"\x89PNG\r\n\r\n\x00").hexdigest()
    assert "WARC-Date" not in got["<urn:p>", "conversion"]["header"]


def test_the_query_equals_derivatives_of_the_table(spark):
    sf = "/root/testdata/sf0.001"
    direct = warc.derivatives(warc.responses(spark.read.parquet(f"{sf}/pages.parquet")))
    cols = ["page_id", "type", "record_id", "refers_to", "target_uri", "payload_digest", "block_digest", "content_length"]
    assert Counter(op6_warc_derivatives(spark, sf).select(*cols).collect()) == Counter(direct.select(*cols).collect())
