"""Derived WARC records: metadata and plain-text conversions of responses.

A response row becomes two records that refer to it: a ``metadata`` record with facts about the
capture (status, type, title, language, links) and a ``conversion`` record with the page as plain text.
Both name the response in WARC-Refers-To, keep its target and date, repeat its payload digest, and
have an identifier and a block digest of their own. Metadata repeats the response's own header fields. Identifiers are made from the response's
identifier and the kind, so reruns give equal records.

Text is found by patterns in the JVM: comments, scripts and styles go, block tags break lines, other
tags vanish, character references are read, white space is folded. Null or empty payloads give an
empty conversion. Rows without an identifier get one from target, date and payload; repeated rows
give repeated records. Header values lose line breaks, so a record cannot be split by its source.
"""

import json
import re
from collections.abc import Iterator
from html.entities import html5

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

VERSION = "WARC/1.1"
RECORD = T.StructType([T.StructField(n, T.StringType()) for n in ("kind", "record_id", "refers_to", "headers", "block")])
# Records and bytes in a written file; bound what a reader holds.
FILE_RECORDS = 20_000
FILE_BYTES = 1 << 29

# The references that pages use most; the table of all of them is asked after these.
COMMON = ("amp", "lt", "gt", "quot", "apos", "nbsp", "copy", "reg", "laquo", "raquo", "middot", "ndash", "mdash", "hellip", "eacute")
_HIDDEN = r"(?is)<(?:!--.*?(?:-->|$)|(script|style|noscript|template)\b[^<>]*+>.*?(?:</\1\s*+>|$))"
# A tag ends before the next one begins, so one that is never closed is not read again from every place.
_BREAKS = r"(?i)<(?:/?(?:p|div|h[1-6]|li|ul|ol|tr|table|article|section|header|footer|nav|blockquote|pre|title|body|head)\b[^<>]*+>|br\b[^<>]*+>)"
_TAGS = r"<[!/?A-Za-z][^<>]*+>"


def _one_line(value: Column) -> Column:
    return F.trim(F.regexp_replace(F.coalesce(value, F.lit("")), r"[\x00-\x1F\x7F]+", " "))


def uuid_of(value: Column) -> Column:
    """A record identifier from the MD5 of a string."""
    h = F.md5(value.cast("binary"))
    cut = lambda a, n: F.substring(h, a, n)
    return F.concat(F.lit("<urn:uuid:"), F.concat_ws("-", cut(1, 8), cut(9, 4), cut(13, 4), cut(17, 4), cut(21, 12)), F.lit(">"))


def digest_of(block: Column) -> Column:
    return F.concat(F.lit("sha256:"), F.sha2(block.cast("binary"), 256))


def responses(pages: DataFrame, date: str = "1970-01-01T00:00:00Z") -> DataFrame:
    """Response rows from stored pages (``url``, ``html``), with the headers that such a capture has."""
    payload = F.coalesce("html", F.lit(""))
    return pages.select(
        "page_id",
        uuid_of(F.concat_ws("\n", F.lit("response"), F.col("page_id").cast("string"), _one_line(F.col("url")), payload)).alias("record_id"),
        _one_line(F.col("url")).alias("target"),
        F.lit(date).alias("date"),
        F.lit(200).alias("status"),
        F.lit("text/html; charset=utf-8").alias("content_type"),
        payload.alias("payload"),
        digest_of(payload).alias("payload_digest"),
    )


def _names() -> list[str]:
    """All names of character references that end with a semicolon."""
    return [name[:-1] for name in html5 if name.endswith(";")]


def unescaped(text: Column) -> Column:
    """Character references in text as characters; unknown ones stay."""
    common, every = (
        # One constant, which the optimizer reads once.
        F.from_json(F.lit(json.dumps({n: html5[f"{n};"] for n in names})), "map<string, string>")
        for names in (COMMON, _names())
    )
    # Each piece after the first starts behind an ampersand.
    pieces = F.split(text, "&")

    def read(piece: Column) -> Column:
        body = F.substring_index(piece, ";", 1)
        ended = F.length(body) < F.length(piece)
        number = F.when(body.rlike(r"^#[0-9]{1,7}$"), F.substring(body, 2, 7).cast("int")).when(
            body.rlike(r"^#[xX][0-9A-Fa-f]{1,6}$"), F.conv(F.substring(body, 3, 6), 16, 10).cast("int")
        )
        valid = number.between(1, 0xD7FF) | number.between(0xE000, 0x10FFFF)
        char = F.when(valid, F.decode(F.unhex(F.lpad(F.hex(number.cast("long")), 8, "0")), "UTF-32"))
        named = F.when(body.rlike(r"^[A-Za-z][A-Za-z0-9]{1,40}$"), F.coalesce(common[body], every[body]))
        text = F.when(ended, F.when(body.startswith("#"), char).otherwise(named))
        return F.coalesce(F.concat(text, F.substr(piece, F.length(body) + 2)), F.concat(F.lit("&"), piece))

    rest = F.array_join(F.transform(F.slice(pieces, 2, F.greatest(F.size(pieces) - 1, F.lit(0))), read), "")
    return F.when(text.contains("&"), F.concat(pieces[0], rest)).otherwise(text)


def with_plain_text(df: DataFrame, html: str, out: str) -> DataFrame:
    """Add column ``out`` with the text of a page in column ``html``.

    In steps over columns: an expression that is used several times is computed once.
    """
    shown = F.regexp_replace(F.coalesce(html, F.lit("")), _HIDDEN, " ")
    # Runs of spaces are folded once, at the end.
    flat = F.regexp_replace(shown, r"[\t-\r]+", " ")
    bare = F.regexp_replace(F.regexp_replace(flat, _BREAKS, "\n"), _TAGS, "")
    read = df.withColumn(out, bare).withColumn(out, unescaped(F.col(out)))
    tidy = F.regexp_replace(F.regexp_replace(out, r"[ \x{A0}]+", " "), r" ?\n[ \n]*", "\n")
    return read.withColumn(out, F.btrim(tidy, F.lit(" \n")))


def derive(found: DataFrame) -> DataFrame:
    """``page_id``, ``kind``, ``record_id``, ``refers_to``, ``payload_digest``, ``block_digest``,
    ``headers``, ``block``: two records for each response row.

    A column ``http_headers``, lines of the response's own header fields, is optional; the metadata
    record repeats every field.
    """
    payload = F.coalesce("payload", F.lit(""))
    own = F.coalesce(
        "record_id", uuid_of(F.concat_ws("\n", F.lit("response"), _one_line(F.col("target")), _one_line(F.col("date")), payload))
    )
    base = found.select(
        "page_id",
        own.alias("source_id"),
        _one_line(F.col("target")).alias("target"),
        _one_line(F.col("date")).alias("date"),
        F.col("status"),
        _one_line(F.col("content_type")).alias("content_type"),
        F.coalesce(_one_line(F.col("payload_digest")), digest_of(payload)).alias("payload_digest"),
        payload.alias("payload"),
        (F.col("http_headers") if "http_headers" in found.columns else F.lit(None)).cast("string").alias("_http"),
    )
    first = lambda p: F.regexp_extract("payload", p, 1)
    # The text of a title, without markup and on one line.
    before = F.split("payload", "(?i)</title", 2)
    named = F.when(F.size(before) == 2, F.regexp_extract(before[0], r"(?is)<title[^<>]*+>(.*)", 1))
    base = with_plain_text(base.withColumn("_title", named), "_title", "_title")
    title = _one_line(F.col("_title"))
    base = with_plain_text(base, "payload", "_text")
    links = F.transform(
        F.regexp_extract_all("payload", F.lit(r"(?i)<a\b[^<>]*?\bhref\s*=\s*[\"']([^\"'<>]*)"), 1),
        lambda x: F.concat(F.lit("outlink: "), _one_line(unescaped(x))),
    )
    facts = F.concat(
        F.array(
            F.concat(F.lit("http-status: "), F.coalesce(F.col("status").cast("string"), F.lit(""))),
            F.concat(F.lit("http-content-type: "), F.col("content_type")),
            F.concat(F.lit("title: "), title),
            F.concat(F.lit("lang: "), first(r"(?i)<html\b[^<>]*?\blang\s*=\s*[\"']([A-Za-z-]*)")),
        ),
        links,
        F.transform(
            F.filter(F.split(F.coalesce("_http", F.lit("")), r"\r?\n"), lambda x: x.contains(":")),
            lambda x: F.concat(F.lit("http-header: "), _one_line(x)),
        ),
    )
    blocks = F.array(
        F.struct(
            F.lit("metadata").alias("kind"),
            F.lit("application/warc-fields").alias("type"),
            F.concat(F.array_join(facts, "\r\n"), F.lit("\r\n")).alias("block"),
        ),
        F.struct(F.lit("conversion").alias("kind"), F.lit("text/plain; charset=utf-8").alias("type"), F.col("_text").alias("block")),
    )
    each = base.select(*[c for c in base.columns if c not in ("payload", "_title", "_text", "_http")], F.explode(blocks).alias("b")).select(
        "*", "b.kind", "b.type", "b.block"
    )
    each = each.withColumn("record_id", uuid_of(F.concat_ws("\n", "kind", "source_id"))).withColumn(
        "block_digest", digest_of(F.col("block"))
    )
    header = lambda name, value: F.concat(F.lit(f"{name}: "), value)
    headers = F.concat_ws(
        "\r\n",
        F.lit(VERSION),
        header("WARC-Type", F.col("kind")),
        header("WARC-Record-ID", F.col("record_id")),
        header("WARC-Refers-To", F.col("source_id")),
        header("WARC-Target-URI", F.col("target")),
        header("WARC-Date", F.col("date")),
        header("WARC-Payload-Digest", F.col("payload_digest")),
        header("WARC-Block-Digest", F.col("block_digest")),
        header("Content-Type", F.col("type")),
        header("Content-Length", F.octet_length("block").cast("string")),
    )
    return each.select(
        "page_id", "kind", "record_id", F.col("source_id").alias("refers_to"), "payload_digest", "block_digest", headers.alias("headers"), "block"
    )


def write_records(records: DataFrame, path: str, file_records: int = FILE_RECORDS, file_bytes: int = FILE_BYTES) -> None:
    """WARC files from ``headers`` and ``block``; Spark's text writer sets the marks between records.

    A file holds at most ``file_records`` records and, but for a single larger one, ``file_bytes``.
    """
    whole = records.select(F.concat("headers", F.lit("\r\n\r\n"), "block").alias("value"))
    size = F.octet_length("value")
    most = whole.agg(F.max(size).alias("m")).first()["m"] or 0
    usual = file_bytes // file_records
    parts = [(whole.where(size <= usual), file_records), (whole.where(size > usual), max(file_bytes // max(most, 1), 1))]
    for part, count in parts if most > usual else parts[:1]:
        part.write.mode("append").option("lineSep", "\r\n\r\n").option("maxRecordsPerFile", min(count, file_records)).text(path)


def _parse(data: bytes) -> Iterator[dict]:
    at = 0
    while (at := data.find(b"WARC/", at)) >= 0:
        split = data.index(b"\r\n\r\n", at)
        headers = data[at:split].decode(errors="replace")
        fields = dict(re.findall(r"(?m)^([\w-]+): ?(.*?)\r?$", headers))
        end = split + 4 + int(fields["Content-Length"])
        yield {
            "kind": fields.get("WARC-Type"),
            "record_id": fields.get("WARC-Record-ID"),
            "refers_to": fields.get("WARC-Refers-To"),
            "headers": headers,
            "block": data[split + 4 : end].decode(errors="replace"),
        }
        at = end


def read_records(spark: SparkSession, path: str) -> DataFrame:
    """Records of WARC files by their Content-Length; a file is one task, as the writer bounds it."""
    kind = pa.schema([(n, pa.string()) for n in RECORD.names])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for data in batch.column(0):
                rows = []
                for record in _parse(data.as_py()):
                    rows.append(record)
                    if len(rows) == 1_000:
                        yield pa.RecordBatch.from_pylist(rows, schema=kind)
                        rows = []
                yield pa.RecordBatch.from_pylist(rows, schema=kind)

    files = spark.read.format("binaryFile").load(path).select("content")
    return files.mapInArrow(run, RECORD)


def captured(records: DataFrame) -> DataFrame:
    """Response rows for ``derive`` from the response records of WARC files.

    The block's own headers end at its first empty line; without one the whole block is payload.
    """

    def field(name: str) -> Column:
        return F.regexp_extract("headers", rf"(?im)^{name}: ?(.*?)\r?$", 1)

    split = F.split("block", "\r?\n\r?\n", 2)
    message = records.where(F.col("kind") == "response").select("record_id", "headers", "block", split.alias("_parts"))
    http = F.when((F.size("_parts") == 2) & F.col("block").startswith("HTTP/"), F.col("_parts")[0])
    typed = message.withColumn("http_headers", http)
    digest = field("WARC-Payload-Digest")
    return typed.select(
        F.lit(None).cast("long").alias("page_id"),
        "record_id",
        field("WARC-Target-URI").alias("target"),
        field("WARC-Date").alias("date"),
        F.regexp_extract("http_headers", r"^HTTP/\S+ +([0-9]{3})", 1).try_cast("int").alias("status"),
        F.regexp_extract("http_headers", r"(?im)^content-type: *(.*?)\r?$", 1).alias("content_type"),
        F.when(http.isNull(), F.col("block")).otherwise(F.col("_parts")[1]).alias("payload"),
        F.when(digest != "", digest).alias("payload_digest"),
        "http_headers",
    )
