"""WARC derivatives: a metadata and a conversion record for every response record.

A response record (identifier, target URI, date, HTTP header, payload) gives

* a ``conversion`` record: the page as plain text, with ``WARC-Refers-To`` the response;
* a ``metadata`` record (``application/warc-fields``): title, declared language, size of the
  text, the outgoing links and the source's headers, with ``WARC-Refers-To`` the response and
  ``WARC-Concurrent-To`` the conversion.

Both keep the response's target URI, date and payload digest (its own where it has one, else
that of the payload here) and refer to its identifier; a response without an identifier gets one from
its id, URI and payload. Identifiers are version-5 UUIDs of the source identifier and the kind of
record, so a retried task writes the same records again. ``read_responses`` reads them from WARC files: the
payload digest of the source or of its bytes as sent, the body without chunks and compression and in
its own character set. Records follow ISO 28500; ``serialise`` and ``parse`` write and read them.

Edge cases: a null or empty payload gives an empty text and no links; a null URI gives records
without a target URI, a missing date records without one, which ``warc_members`` dates as told; rows that
repeat wholly are the same response and give the same records; an empty table gives an empty result;
further columns are ignored.
"""

from __future__ import annotations

import base64
import gzip
import hashlib
import html
import re
import uuid
import zlib
from collections.abc import Iterator
from datetime import UTC, datetime

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

VERSION = "WARC/1.1"
RECORD = (
    "page_id long, warc_type string, record_id string, refers_to string, concurrent_to string, target_uri string, "
    "warc_date string, content_type string, content_length long, block_digest string, source_payload_digest string, "
    "headers array<struct<name: string, value: string>>, block binary"
)

#: Elements whose content isn't text of the page; elements that start a new line (fixed values).
SILENT = "script|style|noscript|template|title"
BREAKING = (
    "address article aside blockquote body br dd div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 "
    "head header hr html li main nav ol option p pre section select table tbody td tfoot th thead tr ul"
)

_SILENT = re.compile(rf"<!--.*?(?:-->|\Z)|<({SILENT})\b[^>]*>.*?(?:</\1\s*>|\Z)|<[!?][^>]*>", re.S | re.I)
_BREAK = re.compile(rf"</?(?:{BREAKING.replace(' ', '|')})\b[^>]*>", re.I)
_TAG = re.compile(r"</?[A-Za-z][^>]*>")
_TITLE, _TITLE_END = re.compile(r"<title\b[^>]*>", re.I), re.compile(r"</title\s*>", re.I)
_HTML, _LANG = re.compile(r"<html\b[^>]*>", re.I), re.compile(r"\blang\s*=\s*[\"']?([\w-]+)", re.I)
_ANCHOR = re.compile(r"<a\b[^>]*>", re.I)
_HREF = re.compile(r"\bhref\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]+))", re.I)
_BLANK = re.compile(r"[^\S\n]+")


def digest(data: bytes) -> str:
    """Labelled digest as web archives write it: SHA-1 in base 32."""
    return "sha1:" + base64.b32encode(hashlib.sha1(data, usedforsecurity=False).digest()).decode()


def record_id(kind: str, source: str) -> str:
    return f"<urn:uuid:{uuid.uuid5(uuid.NAMESPACE_URL, f'{kind} {source}')}>"


_OPEN = re.compile(r"<[A-Za-z/!?]")


def _closed(page: str | None) -> str:
    """The page with a tag that its end cuts off ended there. As every tag ends, scans are linear."""
    page = page or ""
    return page + ">" if _OPEN.search(page, page.rfind(">") + 1) else page


def plain_text(page: str | None) -> str:
    """The page's text: a line for each block, character references resolved, blank lines gone."""
    text = _TAG.sub("", _BREAK.sub("\n", _closed(_SILENT.sub(" ", _closed(page)))))
    lines = (line.strip() for line in _BLANK.sub(" ", html.unescape(text)).split("\n"))
    return "\n".join(line for line in lines if line)


def links(page: str | None) -> list[str]:
    """Targets of the page's links in order, repeats included."""
    found = (_HREF.search(tag) for tag in _ANCHOR.findall(_closed(page)))
    return [html.unescape(next((x for x in m.groups() if x), "")).strip() for m in found if m]


def title(page: str | None) -> str:
    page = _closed(page)
    start = _TITLE.search(page)
    end = start and _TITLE_END.search(page, start.end())
    return _one_line(html.unescape(page[start.end() : end.start()])) if end else ""


def language(page: str | None) -> str:
    tag = _HTML.search(_closed(page))
    m = tag and _LANG.search(tag[0])
    return m[1] if m else ""


def _one_line(value: str) -> str:
    return re.sub(r"[\x00-\x1f\x7f]+", " ", value).strip()


def derive(page_id, uri: str | None, page: str | None, date: str | None, source_headers: list[tuple[str, str]], source: str | None = None, payload_digest: str | None = None) -> list[tuple]:
    """The two derived records of a response, in the columns of ``RECORD``."""
    seen = payload_digest or digest((page or "").encode("utf-8", "surrogatepass"))
    source = source or record_id("response", f"{page_id} {uri} {seen}")
    uri = _one_line(uri) if uri is not None else None
    text = plain_text(page)
    conversion, metadata = record_id("conversion", source), record_id("metadata", source)
    fields = [("title", title(page)), ("language", language(page)), ("text-length", str(len(text)))]
    fields += [(f"source-{k.lower()}", _one_line(v)) for k, v in source_headers]
    fields += [("outlink", _one_line(x)) for x in links(page)]
    blocks = (
        ("conversion", conversion, None, "text/plain; charset=utf-8", text.encode("utf-8", "surrogatepass")),
        ("metadata", metadata, conversion, "application/warc-fields", "".join(f"{k}: {v}\r\n" for k, v in fields).encode("utf-8", "surrogatepass")),
    )
    out = []
    for kind, own, beside, content_type, block in blocks:
        made = digest(block)
        headers = [("WARC-Type", kind), ("WARC-Record-ID", own), ("WARC-Refers-To", source)]
        headers += [("WARC-Date", date)] if date else []
        headers += [("WARC-Target-URI", uri)] if uri else []
        headers += [("WARC-Concurrent-To", beside)] if beside else []
        headers += [("WARC-Source-Payload-Digest", seen), ("WARC-Block-Digest", made)]
        headers += [("Content-Type", content_type), ("Content-Length", str(len(block)))]
        out.append((page_id, kind, own, source, beside, uri, date, content_type, len(block), made, seen, headers, block))
    return out


def serialise(headers: list[tuple[str, str]], block: bytes, compress: bool = True) -> bytes:
    """One record of a WARC file, by default as a gzip member of its own."""
    head = VERSION + "\r\n" + "".join(f"{k}: {v}\r\n" for k, v in headers) + "\r\n"
    data = head.encode() + block + b"\r\n\r\n"
    return gzip.compress(data, mtime=0) if compress else data


def parse(data: bytes) -> Iterator[tuple[dict[str, str], bytes]]:
    """Headers (names in lower case) and block of each record of a WARC file, gzipped or not."""
    if data[:2] == b"\x1f\x8b":
        data = gzip.decompress(data)
    at = 0
    while at < len(data):
        if data[at : at + 2] == b"\r\n":
            at += 2
            continue
        if data[at : at + 5] != b"WARC/":
            raise ValueError(f"no WARC record at byte {at}")
        end = data.index(b"\r\n\r\n", at)
        lines = data[at:end].decode("utf-8", "replace").split("\r\n")[1:]
        headers = {k.strip().lower(): v.strip() for k, _, v in (line.partition(":") for line in lines)}
        size = int(headers.get("content-length", "0"))
        yield headers, data[end + 4 : end + 4 + size]
        at = end + 4 + size


_CHARSET = re.compile(r"charset\s*=\s*[\"']?([\w.:-]+)", re.I)


def _unchunked(body: bytes) -> bytes:
    """The body of a chunked transfer; as it is where it isn't one."""
    out, at = [], 0
    while True:
        end = body.find(b"\r\n", at)
        size = body[at:end].split(b";")[0].strip() if end >= 0 else b""
        if not re.fullmatch(rb"[0-9A-Fa-f]+", size):
            return b"".join(out) if out and at >= len(body) else body
        if not (n := int(size, 16)):
            return b"".join(out)
        out.append(body[end + 2 : end + 2 + n])
        at = end + 2 + n + 2


def _plain_body(body: bytes, named: dict[str, str]) -> str:
    """The body without transfer and content encodings, in its character set."""
    if "chunked" in named.get("transfer-encoding", "").lower():
        body = _unchunked(body)
    coding = named.get("content-encoding", "").lower().strip()
    try:
        if coding in ("gzip", "x-gzip"):
            body = zlib.decompress(body, 47)
        elif coding == "deflate":
            body = zlib.decompress(body) if body[:1] == b"\x78" else zlib.decompress(body, -15)
    except zlib.error:
        pass  # archives often hold the body decoded already
    charset = _CHARSET.search(named.get("content-type", "")) or _CHARSET.search(body[:2048].decode("latin-1"))
    try:
        return body.decode(charset[1] if charset else "utf-8", "replace")
    except LookupError:
        return body.decode("utf-8", "replace")


def read_responses(files: DataFrame) -> DataFrame:
    """The responses in WARC files: page_id (null), url, html, warc_date, source_id, payload_digest, source_headers.

    files: rows (content) as the binaryFile source gives them; one file is read at a time.
    """

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            for data in b["content"]:
                rows = []
                for headers, block in parse(bytes(data)):
                    if headers.get("warc-type") == "response":
                        head, _, body = block.partition(b"\r\n\r\n")
                        named = [tuple(x.strip() for x in line.split(":", 1)) for line in head.decode("latin-1").split("\r\n")[1:] if ":" in line]
                        page = _plain_body(body, {k.lower(): v for k, v in named})
                        seen = headers.get("warc-payload-digest") or digest(body)
                        rows.append((None, headers.get("warc-target-uri"), page, headers.get("warc-date"), headers.get("warc-record-id"), seen, named))
                columns = ["page_id", "url", "html", "warc_date", "source_id", "payload_digest", "source_headers"]
                yield pd.DataFrame(rows, columns=columns).astype({"page_id": "Int64"})

    schema = (
        "page_id long, url string, html string, warc_date string, source_id string, payload_digest string, "
        "source_headers array<struct<name: string, value: string>>"
    )
    return files.select("content").mapInPandas(run, schema)


def derivatives(responses: DataFrame) -> DataFrame:
    """Two rows in the columns of ``RECORD`` for each response.

    responses: page_id, url, html and, where known, warc_date, source_id, payload_digest, source_headers.
    """
    extra = {"warc_date": "string", "source_id": "string", "payload_digest": "string", "source_headers": "array<struct<name: string, value: string>>"}
    have = [F.col(c) if c in responses.columns else F.lit(None).cast(t).alias(c) for c, t in extra.items()]
    names = ["page_id", "warc_type", "record_id", "refers_to", "concurrent_to", "target_uri", "warc_date", "content_type"]
    names += ["content_length", "block_digest", "source_payload_digest", "headers", "block"]

    types = [pa.int64(), *[pa.string()] * 7, pa.int64(), *[pa.string()] * 2]
    types += [pa.list_(pa.struct([("name", pa.string()), ("value", pa.string())])), pa.binary()]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for at in range(0, b.num_rows, 256):
                rows = []
                for r in b.slice(at, 256).to_pylist():
                    own = [(h["name"], h["value"]) for h in r["source_headers"] or ()]
                    made = derive(r["page_id"], r["url"], r["html"], r["warc_date"], own, r["source_id"], r["payload_digest"])
                    rows += [(*x[:11], [{"name": k, "value": v} for k, v in x[11]], x[12]) for x in made]
                columns = zip(*rows, strict=True)
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types, strict=True)], names=names)

    inputs = responses.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), F.col("html").cast("string").alias("html"), *have)
    return inputs.mapInArrow(run, RECORD)


def warc_members(records: DataFrame, written_at: str | None = None) -> DataFrame:
    """member (binary): each record as one gzip member; concatenated they are a WARC file.

    Records without a date are dated ``written_at`` (the time of the call, where None).
    """
    now = written_at or datetime.now(UTC).strftime("%Y-%m-%dT%H:%M:%SZ")

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            made = []
            for hs, x in zip(b["headers"], b["block"], strict=True):
                named = [(h["name"], h["value"]) for h in hs]
                named += [] if any(k == "WARC-Date" for k, _ in named) else [("WARC-Date", now)]
                made.append(serialise(named, bytes(x)))
            yield pd.DataFrame({"member": made})

    return records.select("headers", "block").mapInPandas(run, "member binary")


def page_responses(pages: DataFrame) -> DataFrame:
    """Pages as responses: the headers that a server sends with such a page stand for the source's."""
    header = lambda k, v: F.struct(F.lit(k).alias("name"), v.alias("value"))
    length = F.octet_length(F.coalesce("html", F.lit(""))).cast("string")
    headers = F.array(header("Content-Type", F.lit("text/html; charset=utf-8")), header("Content-Length", length))
    return pages.select("page_id", "url", "html", headers.alias("source_headers"))


def derivative_digests(pages: DataFrame) -> DataFrame:
    """The derived records of every page, with the SHA-256 of the block in place of the block."""
    return derivatives(page_responses(pages)).select(
        "page_id",
        "warc_type",
        "record_id",
        "refers_to",
        "concurrent_to",
        "target_uri",
        "warc_date",
        "content_type",
        "content_length",
        "block_digest",
        "source_payload_digest",
        F.expr("size(headers)").alias("n_headers"),
        F.sha2("block", 256).alias("block_sha256"),
    )
