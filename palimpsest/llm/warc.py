"""WARC derivatives: metadata and plain-text conversion records made from responses."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

DATE = "2024-01-01T00:00:00Z"
CRLF = "\r\n"
# What goes, what becomes a new line, what is left out; in this order.
HIDDEN = "(?is)<!--.*?-->|<head\\b.*?</head\\s*>|<script\\b.*?</script\\s*>|<style\\b.*?</style\\s*>"
BREAKS = "(?i)</?(?:p|div|br|li|ul|ol|h[1-6]|tr|td|th|table|article|section|nav|header|footer|title|pre|blockquote)\\b[^>]*>"
TAGS = "<[^>]*>"
ENTITIES = (("&nbsp;", " "), ("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "'"), ("&amp;", "&"))


def digest(block: Column) -> Column:
    """sha1: and the digest in base 32."""
    h = F.sha1(block.cast("binary"))
    parts = [F.lpad(F.conv(F.substring(h, 1 + 5 * i, 5), 16, 32), 4, "0") for i in range(8)]
    return F.concat(F.lit("sha1:"), F.translate(F.upper(F.concat(*parts)), "0123456789ABCDEFGHIJKLMNOPQRSTUV", "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567"))


def record_id(kind: str, *parts: Column) -> Column:
    """A urn:uuid that follows from the record's kind and source."""
    h = F.md5(F.concat_ws("|", F.lit(kind), *(F.coalesce(p.cast("string"), F.lit("")) for p in parts)).cast("binary"))
    cut = [F.substring(h, a, n) for a, n in ((1, 8), (9, 4), (13, 4), (17, 4), (21, 12))]
    return F.concat(F.lit("<urn:uuid:"), F.concat_ws("-", *cut), F.lit(">"))


def responses(pages: DataFrame, date: str = DATE) -> DataFrame:
    """(page_id, record_id, target_uri, date, http_headers, payload): pages as response records.

    A null url is the empty one, a null html an empty payload. ``date`` is the capture's, which
    the table lacks.
    """
    body = F.coalesce(F.col("html"), F.lit(""))
    head = F.concat(F.lit(f"HTTP/1.1 200 OK{CRLF}Content-Type: text/html; charset=utf-8{CRLF}Content-Length: "), F.octet_length(body).cast("string"), F.lit(CRLF))
    return pages.select("page_id", record_id("response", F.col("page_id"), F.col("url")).alias("record_id"), F.coalesce("url", F.lit("")).alias("target_uri"), F.lit(date).alias("date"), head.alias("http_headers"), body.alias("payload"))


def plain_text(html: Column) -> Column:
    """The visible text, a line for each block."""
    x = F.regexp_replace(html, HIDDEN, " ")
    x = F.regexp_replace(x, BREAKS, "\n")
    x = F.regexp_replace(x, TAGS, "")
    for a, b in ENTITIES:
        x = F.replace(x, F.lit(a), F.lit(b))
    x = F.regexp_replace(x, "[ \\t\\r\\f\\x0B]+", " ")
    return F.regexp_replace(F.regexp_replace(x, " ?\\n[ \\n]*", "\n"), "^[ \\n]+|[ \\n]+$", "")


def derivatives(response: DataFrame) -> DataFrame:
    """Two records for each response, linked to it: metadata (application/warc-fields), then conversion (text/plain).

    (page_id, record_type, record_id, refers_to, target_uri, date, content_type,
    content_length, block_digest, source_block_digest, source_payload_digest, source_headers, block).
    refers_to is the response's record id, source_headers its HTTP headers as they were, the source
    digests those of its block (headers, empty line, payload) and of its payload. Lengths count bytes.

    ``serialised`` writes the source's headers and digests as fields of both records. A response with an empty payload has an empty
    conversion block; null payloads and headers count as empty, other nulls as missing fields. Record ids follow from the source's, so
    responses under one record id, which WARC forbids, give records under one id. Very long payloads are taken whole. Other columns are ignored. No rows in: no rows out.
    """
    response = response.withColumns({c: F.coalesce(c, F.lit("")) for c in ("payload", "http_headers")})
    p = F.col("payload")
    title = F.regexp_extract(p, "(?is)<title[^>]*>(.*?)</title", 1)
    lang = F.regexp_extract(p, "(?i)<html[^>]*\\blang=\"([^\"]*)\"", 1)
    links = F.regexp_extract_all(p, F.lit("href=\"([^\"]*)\""), F.lit(1))
    x = response.select(
        "page_id", F.col("record_id").alias("refers_to"), "target_uri", "date", F.col("http_headers").alias("source_headers"),
        digest(F.concat("http_headers", F.lit(CRLF), p)).alias("source_block_digest"), digest(p).alias("source_payload_digest"),
        title.alias("t"), lang.alias("l"), links.alias("links"), plain_text(p).alias("text"),
    )
    fields = [F.concat(F.lit("sourceRecordId: "), "refers_to"), F.concat(F.lit("sourceDigest: "), "source_payload_digest"), F.concat(F.lit("title: "), F.regexp_replace("t", "\\s+", " ")), F.concat(F.lit("language: "), "l")]
    block = F.concat(*(y for f in fields for y in (f, F.lit(CRLF))), F.concat_ws("", F.transform("links", lambda u: F.concat(F.lit("outlink: "), u, F.lit(CRLF)))))
    both = F.array(
        F.struct(F.lit("metadata").alias("record_type"), record_id("metadata", F.col("refers_to")).alias("record_id"), F.lit("application/warc-fields").alias("content_type"), block.alias("block")),
        F.struct(F.lit("conversion").alias("record_type"), record_id("conversion", F.col("refers_to")).alias("record_id"), F.lit("text/plain").alias("content_type"), F.col("text").alias("block")),
    )
    x = x.select("page_id", "refers_to", "target_uri", "date", "source_headers", "source_block_digest", "source_payload_digest", F.inline(both))
    return x.select(
        "page_id", "record_type", "record_id", "refers_to", "target_uri", "date", "content_type", F.octet_length("block").cast("long").alias("content_length"),
        digest(F.col("block")).alias("block_digest"), "source_block_digest", "source_payload_digest", "source_headers", "block",
    )


def serialised(records: DataFrame) -> DataFrame:
    """(page_id, record_type, record): the records of ``derivatives`` as WARC/1.1 text, two line ends after each; the source's headers and digests are extension fields."""
    named = (("WARC-Type", "record_type"), ("WARC-Record-ID", "record_id"), ("WARC-Refers-To", "refers_to"), ("WARC-Target-URI", "target_uri"), ("WARC-Date", "date"), ("WARC-Block-Digest", "block_digest"), ("WARC-Source-Block-Digest", "source_block_digest"), ("WARC-Source-Payload-Digest", "source_payload_digest"), ("Content-Type", "content_type"), ("Content-Length", "content_length"))
    head = [F.when(F.col(c).isNotNull(), F.concat(F.lit(f"{k}: "), F.col(c).cast("string"), F.lit(CRLF))).otherwise("") for k, c in named]
    source = F.array_join(F.transform(F.filter(F.split("source_headers", CRLF), lambda h: h != ""), lambda h: F.concat(F.lit("WARC-Source-Header: "), h, F.lit(CRLF))), "")
    return records.select("page_id", "record_type", F.concat(F.lit(f"WARC/1.1{CRLF}"), *head, source, F.lit(CRLF), "block", F.lit(CRLF * 2)).alias("record"))


def op1_warc_derivatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    return derivatives(responses(spark.read.parquet(f"{sf_dir}/pages.parquet")))


def _sql_digest(x: str) -> str:
    part = "[substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', ((v >> s) & 31) + 1, 1) for s in [15, 10, 5, 0]]"
    return f"'sha1:' || array_to_string(flatten([{part} for v in [('0x' || substr(sha1({x}), 1 + 5 * i, 5))::bigint for i in range(8)]]), '')"


def _sql_id(kind: str, x: str) -> str:
    return f"'<urn:uuid:' || regexp_replace(md5('{kind}|' || {x}), '(.{{8}})(.{{4}})(.{{4}})(.{{4}})(.{{12}})', '\\1-\\2-\\3-\\4-\\5') || '>'"


def _sql_text(x: str) -> str:
    for pattern, to in ((HIDDEN, "' '"), (BREAKS, "chr(10)"), (TAGS, "''")):
        x = f"regexp_replace({x}, '{pattern}', {to}, 'g')"
    for a, b in ENTITIES:
        x = f"replace({x}, '{a}', '{b.replace(chr(39), chr(39) * 2)}')"
    x = f"regexp_replace({x}, '[ \\t\\r\\f\\x0B]+', ' ', 'g')"
    return f"regexp_replace(regexp_replace({x}, ' ?\\n[ \\n]*', chr(10), 'g'), '^[ \\n]+|[ \\n]+$', '', 'g')"


ORACLE = f"""
with r as (
  select page_id, {_sql_id("response", "coalesce(page_id::varchar, '') || '|' || coalesce(url, '')")} as refers_to, coalesce(url, '') as target_uri, '{DATE}' as date,
    'HTTP/1.1 200 OK' || chr(13) || chr(10) || 'Content-Type: text/html; charset=utf-8' || chr(13) || chr(10) || 'Content-Length: ' || strlen(coalesce(html, '')) || chr(13) || chr(10) as source_headers,
    coalesce(html, '') as p
  from pages),
x as (
  select *, {_sql_digest("source_headers || chr(13) || chr(10) || p")} as source_block_digest, {_sql_digest("p")} as source_payload_digest from r),
y as (
  select *, 'metadata' as record_type, {_sql_id("metadata", "refers_to")} as record_id, 'application/warc-fields' as content_type,
    'sourceRecordId: ' || refers_to || chr(13) || chr(10) || 'sourceDigest: ' || source_payload_digest || chr(13) || chr(10)
    || 'title: ' || regexp_replace(regexp_extract(p, '(?is)<title[^>]*>(.*?)</title', 1), '\\s+', ' ', 'g') || chr(13) || chr(10)
    || 'language: ' || regexp_extract(p, '(?i)<html[^>]*\\blang="([^"]*)"', 1) || chr(13) || chr(10)
    || array_to_string([('outlink: ' || u || chr(13) || chr(10)) for u in regexp_extract_all(p, 'href="([^"]*)"', 1)], '') as block
  from x
  union all
  select *, 'conversion', {_sql_id("conversion", "refers_to")}, 'text/plain', {_sql_text("p")} from x)
select page_id, record_type, record_id, refers_to, target_uri, date, content_type, strlen(block)::bigint as content_length,
  {_sql_digest("block")} as block_digest, source_block_digest, source_payload_digest, source_headers, block
from y"""
