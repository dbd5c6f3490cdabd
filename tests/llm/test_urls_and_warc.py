import base64
import hashlib
import json
import time
from html.parser import HTMLParser

import pytest
import random

import duckdb
from pyspark.sql import functions as F

from seriesmend.llm import urls, warc
from seriesmend.llm.queries import ORACLES, QUERIES

PAGES = "page_id long, url string, html string"

URLS = [
    None, "", "no scheme", "http://", "HTTP://A.Net", "http://a.net/", "http://net/x", "https://EXAMPLE.net/en/a?b#c",
    "https://x.example.net/en/", "https://x.example.net/en", "https://notexample.com/de/", "http://b.example.com/de/q",
    "http://example.com/de", "http://org/fr/", "http://Ä.org/fr/x?y", "http://a.org/FR/", "http://a.net:80/x",
    "https://www.cheap-pills.example.org/a/?utm_source=x&b=1&a=2#f", "http://cheap-pills.example.org:443/a?a=2&b=1",
    "http://q?x://y/z", "http://a#b://c",
]


def test_query_equals_sql(spark, folder_of):
    rng = random.Random(1)
    hosts = ["a.net", "example.net", "x.example.com", "a.org", "cheap-pills.example.com", "casino.example.org"]
    rows = list(enumerate(URLS)) + [
        (100 + i, f"http{rng.choice(['', 's'])}://{rng.choice(['', 'www.', 'm.'])}{rng.choice(hosts)}"
         f"{rng.choice(['', '/', '/en/', '/de/x', '/fr/'])}{rng.choice(['', '?utm_a=1', '?b=2&a=1', '#t'])}") for i in range(300)]
    pages = spark.createDataFrame([(i, u, None) for i, u in rows + rows[:3]], PAGES)
    folder = folder_of(pages=pages)
    con = duckdb.connect()
    con.execute(f"CREATE VIEW pages AS SELECT * FROM '{folder}/pages.parquet/*.parquet'")
    df = QUERIES["op6_url_filter"](spark, folder)
    want = con.execute(f"SELECT {', '.join(df.columns)} FROM ({ORACLES['op6_url_filter']})").fetchall()
    key = lambda r: tuple(map(str, r))
    assert sorted(map(tuple, df.collect()), key=key) == sorted(want, key=key)


def test_filter_has_no_misses_and_the_join_no_false_hits(spark, monkeypatch):
    monkeypatch.setattr(urls, "BITS_PER_URL", 2)   # many false hits
    listed = urls.listed_urls(spark.createDataFrame([(f"http://h/{i}",) for i in range(0, 400, 2)], "url string"))
    rows = spark.createDataFrame([(f"https://h/{i}/",) for i in range(400)] + [(None,)], "url string").withColumn("w0_", F.lit(1))
    for most in (1 << 20, 0):   # broadcast and joined
        monkeypatch.setattr(urls, "FILTER_BYTES", most)
        got = urls.mark_listed(rows, "url", listed, "hit")
        assert got.columns == ["url", "w0_", "hit"]
        assert {r.url for r in got.collect() if r.hit} == {f"https://h/{i}/" for i in range(0, 400, 2)}
        assert got.count() == 401


def test_empty_list_and_table(spark):
    none = spark.createDataFrame([], "url string")
    pages = spark.createDataFrame([(1, "http://x.com/", "")], PAGES)
    assert [r.verdict for r in urls.judge(pages, urls.listed_urls(none)).collect()] == ["allow"]
    assert urls.judge(pages.limit(0), urls.listed_urls(pages.select("url"))).count() == 0


PAGE = (
    "<!DOCTYPE html><html><head><title>T &amp; x</title><style>p{}</style><script>var t='</p>';</script></head>"
    "<body><!-- <p>no</p> --><h1>Head</h1><p>One&nbsp;two<br>three <a href='/l?a&amp;b'>link</a> 1 < 2</p></body></html>"
)


def test_page_text():
    title, text, links = warc.page_text(PAGE)
    assert (title, links) == ("T & x", ["/l?a&b"])
    assert text == "T & x\nHead\nOne two\nthree link 1 < 2"
    assert warc.page_text("") == ("", "", [])
    assert warc.page_text("a<!-- b")[1] == "a" and warc.page_text("a<script>b")[1] == "a"
    assert warc.page_text("a<b")[1] == "a" and warc.page_text("İ<P>x</P>İ<script>y</script>z")[1].split("\n") == ["İ", "x", "İz"]


def test_closing_tags_in_any_case():
    page = ("{0}<TITLE>Son {0}</TITLE><Script>x</SCRIPT>one<style>p</Style><NOSCRIPT>n</NoScript>"
            "<template>t</TEMPLATE> two <a href='/l'>three</A>")
    for letter in "iİKſ\u1e9e":
        title, text, links = warc.page_text(page.format(letter))
        assert title == f"Son {letter}" and links == ["/l"]
        assert text == f"{letter}\nSon {letter}\none two three"
    # only A-Z have another case here
    assert warc.page_text("a<script>b</ſcript>c</SCRIPT>d")[1] == "ad" and warc.page_text("a<script>b</scrİpt>c")[1] == "a"


def test_records_are_linked_and_whole(spark, folder_of):
    rows = [(1, "http://a/b", PAGE), (1, "http://a/b", PAGE), (None, None, None), (3, "u\r\nX: y", "<p>" * 2000 + "ü")]
    folder = folder_of(pages=spark.createDataFrame(rows, PAGES).withColumn("record", F.lit(1)))
    got = QUERIES["op10_warc_derivatives"](spark, folder).collect()
    assert len(got) == 8
    for r in got:
        headers, block = warc.parsed(bytes(r.record))
        known = dict(headers)
        assert known["WARC-Record-ID"] == r.record_id != r.refers_to == known["WARC-Refers-To"]
        assert known["WARC-Block-Digest"] == warc.digest(block) == r.block_digest
        assert int(known["Content-Length"]) == len(block) == r.content_length
        assert known["WARC-Type"] == r.record_type and known["WARC-Source-Payload-Digest"] == r.payload_digest
    one = [r for r in got if r.page_id == 1]
    assert len({r.record_id for r in one}) == 2 and len({r.refers_to for r in one}) == 1
    meta = json.loads(warc.parsed(bytes(next(r for r in one if r.record_type == "metadata").record))[1])
    assert meta["page"]["links"] == ["/l?a&b"] and ["WARC-Target-URI", "http://a/b"] in meta["source"]["warc_headers"]
    assert meta["source"]["payload_digest"] == warc.digest(PAGE.encode())
    text = next(r for r in one if r.record_type == "conversion")
    assert warc.parsed(bytes(text.record))[1].decode() == warc.page_text(PAGE)[1]


def test_odd_responses(spark):
    records = spark.createDataFrame([(1, None), (2, b""), (3, b"WARC/1.0\r\nA: b\r\n\r\n\xff<p>x")], "page_id long, response binary")
    got = warc.derivatives(records).collect()
    assert sorted(r.page_id for r in got) == [2, 2, 3, 3] and {r.refers_to for r in got} == {""}
    assert warc.derivatives(records.limit(0)).count() == 0


class PlainReader(HTMLParser):
    """The same text and links by the standard library's parser."""

    def __init__(self, page):
        super().__init__(convert_charrefs=True)
        self.title, self.links, self.parts, self.hidden, self.titles = "", [], [], 0, 0
        self.in_title = False
        self.feed(page)
        self.close()

    def handle_starttag(self, tag, attrs):
        if tag in warc.BREAKING:
            self.parts.append("\n")
        self.hidden += tag in warc.HIDDEN
        self.in_title = tag == "title"
        if tag == "a" and dict(attrs).get("href") is not None:
            self.links.append(dict(attrs)["href"])

    def handle_endtag(self, tag):
        if tag in warc.BREAKING:
            self.parts.append("\n")
        self.hidden -= tag in warc.HIDDEN
        self.in_title = False

    def handle_data(self, data):
        if self.in_title:
            self.title += data
        if not self.hidden:
            self.parts.append(data)

    def text(self):
        lines = (" ".join(line.split()) for line in "".join(self.parts).split("\n"))
        return "\n".join(line for line in lines if line)


def test_every_page_against_the_standard_parser(spark, small):
    """Texts, titles, links, identifiers, digests and lengths of the whole query."""
    pages = {r.page_id: r for r in spark.read.parquet(f"{small}/pages.parquet").collect()}
    got = QUERIES["op10_warc_derivatives"](spark, small).collect()
    assert len(got) == 2 * len(pages) and len({r.record_id for r in got}) == len(got)
    for r in got:
        page = pages[r.page_id]
        payload = page.html.encode()
        plain = PlainReader(page.html)
        head, _, body = bytes(r.record).partition(b"\r\n\r\n")
        fields = dict(line.split(": ", 1) for line in head.decode().split("\r\n")[1:])
        sha1 = "sha1:" + base64.b32encode(hashlib.sha1(payload).digest()).decode()
        assert r.target_uri == page.url == fields["WARC-Target-URI"] and r.payload_digest == sha1
        assert fields["WARC-Date"] == warc.NO_DATE and body[int(fields["Content-Length"]):] == b"\r\n\r\n"
        block = body[:-4]
        if r.record_type == "conversion":
            assert block.decode() == plain.text()
        else:
            meta = json.loads(block)
            assert meta["page"]["links"] == plain.links and meta["page"]["title"] == " ".join(plain.title.split())
            source = dict(meta["source"]["warc_headers"])
            assert source["WARC-Record-ID"] == r.refers_to and meta["source"]["payload_length"] == len(payload)
            assert meta["source"]["length_known"] is True


@pytest.mark.parametrize("told", ["abc", "-5", "", "1e3", "9" * 30, "١٢"])
def test_a_length_that_is_none_takes_the_rest(spark, told):
    response = warc.record([("WARC-Type", "response"), ("WARC-Record-ID", "<x>")], b"HTTP/1.1 200 OK\r\n\r\n<p>text").replace(
        b"Content-Length: 26", f"Content-Length: {told}".encode())
    got = warc.derivatives(spark.createDataFrame([(1, response)], "page_id long, response binary")).collect()
    by_kind = {r.record_type: warc.parsed(bytes(r.record)) for r in got}
    assert by_kind["conversion"][1] == b"text"
    assert json.loads(by_kind["metadata"][1])["source"]["length_known"] is False
    assert dict(by_kind["conversion"][0])["WARC-Date"] == warc.NO_DATE


@pytest.mark.parametrize("page", ["<title>" * 150_000, "<title>a" * 100_000 + "</title>", "<a href=" * 120_000, "<script>" * 100_000, "<" * 500_000, "<p " * 300_000])
def test_a_hostile_page_takes_linear_time(page):
    started = time.time()
    warc.page_text(page)
    assert time.time() - started < 5
