"""Derived WARC records: metadata and plain text, linked to the responses they come from.

A response record (its bytes, in the WARC format) becomes two records.  The
conversion record holds the page's text, the metadata record a JSON envelope with
the source's WARC and HTTP headers, its digests, the page's title and its links.
Both name the response in WARC-Refers-To and have identifiers that follow from it,
so that a repeated run writes equal records.  A response without a date gets that of
``NO_DATE``, and so do its records, since the format asks for one and a run has none to give.

Nulls: see ``responses`` and ``derivatives``.  Repeated rows give equal records, with equal
identifiers; an empty table gives none.  A page of any length is read whole, in time that
grows with its length, one page at a time.
"""

from __future__ import annotations

import base64
import hashlib
import html
import json
import re
import uuid
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, functions as F
from pyspark.sql.types import StructType

from seriesmend.llm.common import quoted, text_of

# fixed values of the format
VERSION, END = "WARC/1.1", b"\r\n\r\n"
BREAKING = frozenset(
    "address article aside blockquote br dd div dl dt figure footer form h1 h2 h3 h4 h5 h6 header hr li main "
    "nav ol p pre section table td th title tr ul".split()
)
NO_DATE = "1970-01-01T00:00:00Z"
HIDDEN = ("script", "style", "noscript", "template")
_ENDS = {name: re.compile(f"</{name}", re.I | re.A) for name in (*HIDDEN, "title")}
_NAME = re.compile(r"/?([a-zA-Z][a-zA-Z0-9]*)")
_HREF = re.compile(r"""\bhref\s*=\s*("[^"]*"|'[^']*'|[^\s"'>]+)""", re.I)


def digest(data: bytes) -> str:
    return "sha1:" + base64.b32encode(hashlib.sha1(data).digest()).decode()


def record(headers: list[tuple[str, str]], block: bytes) -> bytes:
    """The bytes of a record; line ends in header values become blanks."""
    lines = [VERSION, *[f"{k}: {re.sub(r'[\r\n]+', ' ', v)}" for k, v in headers], f"Content-Length: {len(block)}"]
    return "\r\n".join(lines).encode() + END + block + END


def parsed(data: bytes) -> tuple[list[tuple[str, str]], bytes]:
    """Headers in order, and the block, of a record's bytes."""
    headers, block, _ = parsed_with_length(data)
    return headers, block


def parsed_with_length(data: bytes) -> tuple[list[tuple[str, str]], bytes, bool]:
    """The same, and whether Content-Length told the block's size.

    Where it is missing, no number, negative or beyond the end, the block is the rest.
    """
    head, _, rest = data.partition(END)
    headers = [tuple(line.split(": ", 1)) for line in head.decode("utf-8", "replace").split("\r\n")[1:] if ": " in line]
    told = next((v.strip() for k, v in headers if k.lower() == "content-length"), "")
    sound = told.isascii() and told.isdigit() and len(told) < 19 and int(told) <= len(rest)
    return headers, rest[: int(told)] if sound else rest, sound


def page_text(page: str) -> tuple[str, str, list[str]]:
    """Title, visible text and link targets of a page, in one pass over its tags.

    What never ends (a comment, a script, a tag) hides the rest of the page.
    """
    out, links, title, at = [], [], "", 0
    missing = set()   # closing tags that don't come any more

    def ending(name: str, at: int) -> int:
        """The place of a closing tag, in any case of A-Z."""
        found = None if name in missing else _ENDS[name].search(page, at)
        if found is None:
            missing.add(name)
        return found.start() if found else -1

    while True:
        start = page.find("<", at)
        if start < 0:
            out.append(page[at:])
            break
        out.append(page[at:start])
        if page.startswith("<!--", start):
            end = page.find("-->", start + 4)
            at = end + 3
        else:
            named = _NAME.match(page, start + 1)
            if not named and not page.startswith(("<!", "<?"), start):
                out.append("<")
                at = start + 1
                continue
            end = page.find(">", start)
            at = end + 1
            name = named[1].lower() if named else ""
            if end >= 0 and page[start + 1] != "/":
                if name in HIDDEN:
                    end = ending(name, at)
                    at = end
                elif name == "title" and not title:
                    stop = ending(name, at)
                    title = page[at:stop] if stop >= 0 else ""
                elif name == "a" and (href := _HREF.search(page, start, end)):
                    links.append(html.unescape(href[1].strip("\"'")))
            if name in BREAKING:
                out.append("\n")
        if end < 0:
            break
    lines = (" ".join(line.split()) for line in html.unescape("".join(out)).split("\n"))
    return " ".join(html.unescape(title).split()), "\n".join(line for line in lines if line), links


def http_parts(block: bytes) -> tuple[str, list[tuple[str, str]], bytes]:
    """Status line, headers and payload of a response block."""
    head, _, payload = block.partition(END)
    lines = head.decode("utf-8", "replace").split("\r\n")
    return lines[0], [tuple(x.split(": ", 1)) for x in lines[1:] if ": " in x], payload


def _derived_id(kind: str, source: str) -> str:
    return f"<urn:uuid:{uuid.uuid5(uuid.NAMESPACE_URL, f'{kind}:{source}')}>"


def derive(response: bytes) -> list[tuple[str, str, str, str, str, str, int, bytes]]:
    """(kind, id, refers to, target, source payload digest, block digest, length, bytes), twice."""
    headers, block, sound = parsed_with_length(response)
    known = {k.lower(): v for k, v in headers}
    status, http, payload = http_parts(block)
    source = known.get("warc-record-id", "")
    payload_digest = known.get("warc-payload-digest") or digest(payload)
    title, text, links = page_text(payload.decode("utf-8", "replace"))
    envelope = {
        "source": {"warc_headers": headers, "status": status, "http_headers": http,
                   "block_digest": digest(block), "payload_digest": payload_digest, "payload_length": len(payload),
                   "length_known": sound},
        "page": {"title": title, "links": links, "text_length": len(text)},
    }
    blocks = (("conversion", "text/plain", text.encode()),
              ("metadata", "application/json", json.dumps(envelope, ensure_ascii=False).encode("utf-8", "surrogatepass")))
    out = []
    for kind, mime, body in blocks:
        own = _derived_id(kind, source)
        fields = [("WARC-Type", kind), ("WARC-Record-ID", own), ("WARC-Refers-To", source)]
        fields += [("WARC-Date", known.get("warc-date") or NO_DATE)]
        fields += [(k, known[k.lower()]) for k in ("WARC-Target-URI", "WARC-Warcinfo-ID") if k.lower() in known]
        fields += [("WARC-Source-Payload-Digest", payload_digest), ("WARC-Block-Digest", digest(body)), ("Content-Type", mime)]
        out.append((kind, own, source, known.get("warc-target-uri", ""), payload_digest, digest(body), len(body),
                    record(fields, body)))
    return out


DERIVED = (
    "record_type string, record_id string, refers_to string, target_uri string, "
    "payload_digest string, block_digest string, content_length long, record binary"
)


def responses(pages: DataFrame, page_id: str = "page_id", url: str = "url", page: str = "html",
              into: str = "response") -> DataFrame:
    """page_id, and binary ``into``: a response record made of a page.

    Its identifier follows from page_id, url and page, so equal rows give equal
    records.  A null url or page is empty.
    """
    schema = StructType(pages.select(quoted(page_id)).schema.fields).add(into, "binary")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            made = []
            for key, uri, text in zip(*[batch.column(i).to_pylist() for i in range(3)]):
                payload = text.encode("utf-8", "surrogatepass")
                block = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8" + END + payload
                own = uuid.uuid5(uuid.NAMESPACE_URL, f"response:{key}:{uri}:{digest(payload)}")
                made.append(record([
                    ("WARC-Type", "response"), ("WARC-Record-ID", f"<urn:uuid:{own}>"), ("WARC-Target-URI", uri),
                    ("WARC-Date", NO_DATE), ("WARC-Payload-Digest", digest(payload)), ("WARC-Block-Digest", digest(block)),
                    ("Content-Type", "application/http; msgtype=response")], block))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(made, pa.binary())], names=[page_id, into])

    rows = pages.select(quoted(page_id), text_of(url).alias("url_"), text_of(page).alias("page_"))
    return rows.mapInArrow(run, schema)


def derivatives(records: DataFrame, response: str = "response") -> DataFrame:
    """Two rows per response: its conversion and its metadata record.

    ``response`` is replaced by the columns of ``DERIVED``; others are kept, unless
    they have one of those names.  A null response gives no rows; one without
    headers gives records that refer to an empty identifier.
    """
    names = [c.split()[0] for c in DERIVED.split(", ")]
    others = [c for c in records.columns if c != response and c not in names]
    kept = records.select(*[quoted(c) for c in others])
    schema = StructType(kept.schema.fields + records.sparkSession.createDataFrame([], DERIVED).schema.fields)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                some = batch.slice(at, 256)
                made = [row for data in some.column(response).to_pylist() for row in derive(data)]
                twice = pa.array([i // 2 for i in range(2 * some.num_rows)], pa.int64())
                columns = [some.column(c).take(twice) for c in others]
                kinds = [pa.string()] * 6 + [pa.int64(), pa.binary()]
                columns += [pa.array([row[i] for row in made], kinds[i]) for i in range(8)]
                yield pa.RecordBatch.from_arrays(columns, names=[*others, *names])

    whole = records.filter(quoted(response).isNotNull()).select(*[quoted(c) for c in [*others, response]])
    return whole.mapInArrow(run, schema)
