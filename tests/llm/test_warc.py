from __future__ import annotations

import base64
import hashlib
import html as entities
import re

from palimpsest.llm.warc import derivatives, responses, serialised


def digest(b: bytes) -> str:
    return "sha1:" + base64.b32encode(hashlib.sha1(b).digest()).decode()


def test_records_are_linked_and_preserve_their_source(spark):
    pages = spark.read.parquet("/root/testdata/sf0.001/pages.parquet")
    source = {r.page_id: r for r in responses(pages).collect()}
    html = {r.page_id: r.html for r in pages.collect()}
    got = derivatives(responses(pages)).collect()
    assert len(got) == 2 * len(source) and len({r.record_id for r in got}) == len(got)
    for r in got:
        s = source[r.page_id]
        assert r.refers_to == s.record_id and r.source_headers == s.http_headers and r.target_uri == s.target_uri
        assert r.source_payload_digest == digest(html[r.page_id].encode())
        assert r.source_block_digest == digest((s.http_headers + "\r\n" + s.payload).encode())
        assert r.block_digest == digest(r.block.encode()) and r.content_length == len(r.block.encode())
        if r.record_type == "conversion":
            assert not re.search(r"<\w", r.block) and "track(" not in r.block
        else:
            assert f"sourceRecordId: {s.record_id}\r\n" in r.block
            assert r.block.count("outlink: ") == html[r.page_id].count('href="')


def test_text(spark):
    page = '<html lang="fr"><head><title>T &amp; U</title></head><body><!-- <p>no --><script>var a="</p>";</script><p>One<b>two</b>&nbsp;&lt;x&gt;<p>\n\nThree &amp;amp; <br>four</body></html>'
    df = spark.createDataFrame([(1, "u", page)], "page_id long, url string, html string")
    got = {r.record_type: r.block for r in derivatives(responses(df)).collect()}
    assert got["conversion"] == "Onetwo <x>\nThree &amp; \nfour".replace("; \n", ";\n")
    assert "title: T &amp; U\r\nlanguage: fr\r\n" in got["metadata"] and entities.unescape("&amp;") == "&"


def test_awkward_rows(spark):
    rows = [(1, None, None, "a"), (None, "u", "<p>x", "b"), (2, "u", "", "c"), (3, "u", "<p>" + "word " * 300_000, "d"), (4, "v", "<", "e"), (4, "v", "<", "e")]
    df = spark.createDataFrame(rows, "page_id long, url string, html string, block string")
    got = derivatives(responses(df))
    assert got.count() == 12
    text = {(r.page_id, r.block) for r in got.where("record_type = 'conversion' and page_id is not null and page_id <> 3").collect()}
    assert text == {(1, ""), (2, ""), (4, "<")}
    record = serialised(got.where("page_id = 2")).collect()
    assert all(r.record.startswith("WARC/1.1\r\nWARC-Type: ") and r.record.endswith("\r\n\r\n") for r in record)
    assert derivatives(responses(df.limit(0))).count() == 0
