import hashlib
import html
import re
import time

import pytest
from pyspark.sql import functions as F

from pairloom.llm import warc

PAGES = "page_id long, url string, html string, kind string, block string"
ROWS = [
    (1, "http://a.example/x", "<html lang='fr'><head><title>T &amp; <b>x</b>\n y</title><style>p{}</style></head><body><p>One&nbsp;two<br>three&#233; &#x1F600; &bogus; a&b <a href='/l?a=1&amp;b=2'>link</a><!-- no --><script>var t='</p>';</script></p></body>", "k", "b"),
    (2, "http://b.example/\r\nX: y", "", None, None),
    (3, None, None, None, None),
    (4, "http://c", "plain WARC/1.0 text\r\n\r\nWARC/1.1 with marks", None, None),
    (4, "http://c", "plain WARC/1.0 text\r\n\r\nWARC/1.1 with marks", None, None),
    (5, "http://d", "<p>" + "long word " * 20_000, None, None),
    (6, "http://e", "<script>open and never closed <p>x", None, None),
    (None, "http://f", "1 < 2 &lt;b&gt; &#0; &#xD800; &#99999999;", None, None),
]


@pytest.fixture(scope="module")
def derived(spark):
    return warc.derive(warc.responses(spark.createDataFrame(ROWS, PAGES))).cache()


def test_text_and_facts(derived):
    one = {r.kind: r.block for r in derived.where("page_id = 1").collect()}
    assert one["conversion"] == "T & x y\nOne two\nthreeé \U0001f600 &bogus; a&b link"
    lines = one["metadata"].split("\r\n")
    assert {"title: T & x y", "lang: fr", "outlink: /l?a=1&b=2", "http-status: 200"} <= set(lines) and lines[-1] == ""
    texts = {r.page_id: r.block for r in derived.where("kind = 'conversion'").collect()}
    assert texts[2] == texts[3] == texts[6] == ""
    assert texts[None] == "1 < 2 <b> &#0; &#xD800; &#99999999;"
    assert len(texts[5]) == 199_999


def test_references_against_the_standard_library(spark):
    texts = ["a &amp; b", "&eacute;&#8364;&#x20ac;", "&amp;lt;", "no reference", "&Auml;&ecirc;&NotEqualTilde;&CounterClockwiseContourIntegral;", "&nosuchname;", "&", "&;", "&&amp;&", "x&copy y"]
    df = spark.createDataFrame([(t,) for t in texts], "t string")
    for r in df.select("t", warc.unescaped(F.col("t")).alias("u")).collect():
        # The standard library also reads references without their end mark.
        assert r.u == (html.unescape(r.t) if r.t != "x&copy y" else r.t)


def test_headers_link_and_describe(spark, derived):
    source = {r.record_id: r for r in warc.responses(spark.createDataFrame(ROWS, PAGES)).collect()}
    for r in derived.collect():
        fields = dict(re.findall(r"(?m)^([\w-]+): (.*?)\r?$", r.headers))
        origin = source[r.refers_to]
        assert fields["WARC-Refers-To"] == r.refers_to != r.record_id == fields["WARC-Record-ID"]
        assert fields["WARC-Payload-Digest"] == origin.payload_digest == r.payload_digest
        assert r.payload_digest == "sha256:" + hashlib.sha256(origin.payload.encode()).hexdigest()
        assert r.block_digest == "sha256:" + hashlib.sha256(r.block.encode()).hexdigest()
        assert int(fields["Content-Length"]) == len(r.block.encode())
        assert "\n" not in r.headers.replace("\r\n", "") and fields.get("X") is None
    assert derived.count() == 2 * len(ROWS)


def test_files_read_back_exactly(spark, derived, tmp_path):
    path = str(tmp_path / "warc")
    warc.write_records(derived, path, 3)
    columns = ["kind", "record_id", "refers_to", "headers", "block"]
    got = sorted(tuple(r) for r in warc.read_records(spark, path).select(columns).collect())
    assert got == sorted(tuple(r) for r in derived.select(columns).collect())


def test_missing_fields_and_empty_table(spark):
    kinds = "page_id long, record_id string, target string, date string, status int, content_type string, payload string, payload_digest string"
    got = warc.derive(spark.createDataFrame([(None,) * 8], kinds)).collect()
    assert len(got) == 2 and all(r.refers_to.startswith("<urn:uuid:") for r in got)
    assert warc.derive(spark.createDataFrame([], kinds)).count() == 0


def test_open_tags_take_linear_time(spark):
    pages = [(i, "u", (part * (1_000_000 // len(part)))) for i, part in enumerate(("<a ", "<title", "<p ", "<html ", "<script ", "<a href=", "<!-", "<title>", "&", "<a href='x"))]
    start = time.time()
    found = warc.derive(warc.responses(spark.createDataFrame(pages, "page_id long, url string, html string").repartition(4)))
    assert found.count() == 20 and found.agg(F.sum(F.length("block"))).first()[0] > 0
    assert time.time() - start < 60


def test_captured_responses_keep_their_headers(spark, tmp_path):
    payload = "<title>T</title><p>&Auml;rger"
    http = "HTTP/1.1 404 Not Found\r\nContent-Type: text/html\r\nX-Cache: a:b\r\n\r\n"
    block = http + payload
    head = f"WARC/1.1\r\nWARC-Type: response\r\nWARC-Record-ID: <urn:uuid:1>\r\nWARC-Target-URI: http://x/\r\nWARC-Date: 2024-01-01T00:00:00Z\r\nWARC-Payload-Digest: sha1:ABC\r\nContent-Length: {len(block)}"
    big = "y" * 5000
    other = head.replace("response", "resource").replace(f"Length: {len(block)}", f"Length: {len(big)}")
    rows_ = [(head, block), (other, big), (head.replace("uuid:1", "uuid:2"), block)]
    warc.write_records(spark.createDataFrame(rows_, "headers string, block string"), str(tmp_path / "w"), 4, 4000)
    read = warc.read_records(spark, str(tmp_path / "w"))
    assert read.count() == 3
    derived = warc.derive(warc.captured(read)).where("refers_to = '<urn:uuid:1>'").collect()
    blocks = {r.kind: r.block for r in derived}
    assert blocks["conversion"] == "T\n\u00c4rger"
    lines = blocks["metadata"].split("\r\n")
    assert {"http-status: 404", "http-content-type: text/html", "http-header: X-Cache: a:b", "title: T"} <= set(lines)
    assert {r.payload_digest for r in derived} == {"sha1:ABC"}
    assert all("WARC-Target-URI: http://x/" in r.headers and "WARC-Date: 2024-01-01T00:00:00Z" in r.headers for r in derived)


def test_white_space_folds_once(spark):
    pages = [
        (1, "u", "a\r\n b\t\tc <p>\n x <b> </b>  y&nbsp; z\x0b\fq<!-- x\n --> r <!-- open"),
        (2, "u", "<script>a</script >b\n<STYLE x>c</style>d<br>\n e<script>f"),
    ]
    found = warc.derive(warc.responses(spark.createDataFrame(pages, "page_id long, url string, html string")))
    texts = {r.page_id: r.block for r in found.where("kind = 'conversion'").collect()}
    assert texts == {1: "a b c\nx y z q r", 2: "b d\ne"}
