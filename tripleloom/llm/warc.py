"""WARC derivatives: from response records, linked metadata and plain-text conversion records."""

from __future__ import annotations

import base64
import hashlib
import html
import re
import uuid
from collections.abc import Iterator
from typing import BinaryIO
from urllib.parse import urljoin

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: The capture date of pages that carry none.
DATE = "2024-01-01T00:00:00Z"
#: Record ids are name-based (version 5) in the namespace for URLs, so a repeated task agrees.
_NAMES = uuid.NAMESPACE_URL

#: Elements that end a line, and those whose content is no text.
_BREAKS = frozenset(
    "address article aside blockquote br dd div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 head header hr html li main "
    "nav ol option p pre section table tbody td tfoot th thead title tr ul body".split()
)
_HIDDEN = frozenset("script style template noscript".split())
# a tag's name, and its attributes up to the > that no quotes hold
_TAG = re.compile(r"<(/?)([a-zA-Z][^\s/>]*+)((?:[^>\"']++|\"[^\"]*+\"|'[^']*+')*+)>")
_PLAIN_TAG = re.compile(r"<(/?)([a-zA-Z][^\s/>]*+)([^>]*+)>")
_ATTRIBUTE = re.compile(r"([^\s=/\"'>]++)(?:\s*+=\s*+(?:\"([^\"]*+)\"|'([^']*+)'|([^\s\"'>]++)))?")
_SPACE = re.compile(r"[^\S\n]+")
_LINES = re.compile(r" ?\n[\s]*")

#: Columns of a record: text all of them, but for its length.
RECORD = T.StructType(
    [
        T.StructField(name, T.LongType() if name == "n_bytes" else T.StringType())
        for name in (
            "record_id", "record_type", "refers_to", "target_uri", "date", "content_type", "source_headers",
            "source_digest", "block_digest", "payload_digest", "n_bytes", "headers", "block",
        )
    ]
)


def digest(data: bytes) -> str:
    return "sha1:" + base64.b32encode(hashlib.sha1(data, usedforsecurity=False).digest()).decode()


def record_id(*parts: str) -> str:
    return f"<urn:uuid:{uuid.uuid5(_NAMES, chr(31).join(parts))}>"


def _attribute(text: str, name: str) -> str | None:
    """The value of an attribute of a tag, entities resolved."""
    for found in _ATTRIBUTE.finditer(text):
        if found[1].lower() == name:
            return html.unescape(next((v for v in found.groups()[1:] if v is not None), ""))
    return None


class Page:
    """What is read out of a page, in one pass over its tags: text, title, lang and links.

    No comments, scripts or styles; a line for each block; entities resolved. A > inside quotes doesn't end a tag. Where quotes are left open, the rest of
    the page is read without them, and where a tag, comment or script is, the rest is text, or nothing; so each character is passed over a few times at most.
    """

    def __init__(self, page: str):
        self.title = self.lang = None
        self.links: dict[str, None] = {}
        parts: list[str] = []
        tag, at, title = _TAG, 0, None
        closed = True  # can a tag still end?
        while (begin := page.find("<", at)) >= 0:
            parts.append(page[at:begin])
            at = begin
            if page.startswith("<!--", begin):
                end = page.find("-->", begin + 4)
                parts.append(" ")
                at = end + 3 if end >= 0 else len(page)
                continue
            if page.startswith(("<!", "<?"), begin):
                end = page.find(">", begin) if closed else -1
                closed &= end >= 0
                at = end + 1 if end >= 0 else begin + 1
                parts.append("" if end >= 0 else "<")
                continue
            starts = begin + 1 < len(page) and (page[begin + 1].isascii() and page[begin + 1].isalpha() or page[begin + 1] == "/" and page[begin + 2 : begin + 3].isascii() and page[begin + 2 : begin + 3].isalpha())
            found = tag.match(page, begin) if closed and starts else None
            if found is None and closed and starts:
                tag = _PLAIN_TAG
                found = tag.match(page, begin)
                closed = found is not None
            if found is None:
                parts.append("<")
                at = begin + 1
                continue
            at, name, attributes = found.end(), found[2].lower(), found[3]
            if name in _HIDDEN and not found[1]:
                end = re.compile(rf"</{name}\s*+>", re.I).search(page, at)
                parts.append(" ")
                at = end.end() if end else len(page)
                continue
            if name == "title" and self.title is None:
                if found[1] and title is not None:
                    self.title = _one_line(html.unescape("".join(parts[title:])))
                elif not found[1] and title is None:
                    title = len(parts) + 1
            if name == "html" and not found[1] and self.lang is None:
                self.lang = _attribute(attributes, "lang") or None
            if name == "a" and not found[1] and (link := _attribute(attributes, "href")) is not None:
                self.links[link] = None
            parts.append("\n" if name in _BREAKS else "")
        parts.append(page[at:])
        if title is not None and self.title is None:
            self.title = _one_line(html.unescape("".join(parts[title:])))
        self.text = _LINES.sub("\n", _SPACE.sub(" ", html.unescape("".join(parts)))).strip()


def plain_text(page: str) -> str:
    """The readable text of a page."""
    return Page(page).text


def _one_line(value: str) -> str:
    return " ".join(value.split())


def _utf8(text: str) -> bytes:
    return text.encode("utf-8", "replace")


def warc_headers(fields: list[tuple[str, str | None]]) -> str:
    """The head of a record, up to and with its empty line; fields without a value are left out."""
    return "WARC/1.1\r\n" + "".join(f"{k}: {_one_line(v)}\r\n" for k, v in fields if v is not None) + "\r\n"


def response(uri: str | None, page: str, date: str, key: str) -> dict:
    """A response record around a page: HTTP head and body."""
    body = _utf8(page)
    head = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(body)}\r\n\r\n"
    payload, block = digest(body), digest(_utf8(head) + body)
    own = record_id("response", key, uri or "", payload)
    size = len(body) + len(head)
    fields = [
        ("WARC-Type", "response"),
        ("WARC-Record-ID", own),
        ("WARC-Target-URI", uri),
        ("WARC-Date", date),
        ("Content-Type", "application/http; msgtype=response"),
        ("WARC-Payload-Digest", payload),
        ("WARC-Block-Digest", block),
        ("Content-Length", str(size)),
    ]
    return {
        "record_id": own, "record_type": "response", "refers_to": None, "target_uri": uri, "date": date,
        "content_type": "application/http; msgtype=response", "source_headers": head, "source_digest": payload,
        "block_digest": block, "payload_digest": payload, "n_bytes": size, "headers": warc_headers(fields), "block": head + page,
    }


def _derived(kind: str, content_type: str, block: str, source: dict) -> dict:
    data = _utf8(block)
    own, block_digest = record_id(kind, source["record_id"], source["block_digest"]), digest(data)
    fields = [
        ("WARC-Type", kind),
        ("WARC-Record-ID", own),
        ("WARC-Refers-To", source["record_id"]),
        ("WARC-Target-URI", source["target_uri"]),
        ("WARC-Date", source["date"]),
        ("WARC-Source-Payload-Digest", source["payload_digest"]),
        ("Content-Type", content_type),
        ("WARC-Block-Digest", block_digest),
        ("Content-Length", str(len(data))),
    ]
    return {
        "record_id": own, "record_type": kind, "refers_to": source["record_id"], "target_uri": source["target_uri"],
        "date": source["date"], "content_type": content_type, "source_headers": source["source_headers"],
        "source_digest": source["payload_digest"], "block_digest": block_digest, "payload_digest": block_digest,
        "n_bytes": len(data), "headers": warc_headers(fields), "block": block,
    }


_CHARSET = re.compile(r"charset\s*=\s*[\"']?([\w.:-]+)", re.I)


def _decoded(body: bytes, head: str) -> str:
    """A body as text, by the character set that its head names; what doesn't fit becomes the replacement character."""
    named = _CHARSET.search(head)
    try:
        return body.decode(named[1] if named else "utf-8", "replace")
    except LookupError:
        return body.decode("utf-8", "replace")


def derivatives(source: dict) -> list[dict]:
    """The metadata and the conversion record of a response record, whose block is text or bytes."""
    block = source["block"]
    if isinstance(block, bytes):
        first, _, body = block.partition(b"\r\n\r\n")
        head = first.decode("utf-8", "replace")
        page = Page(_decoded(body, head))
    else:
        head, _, body = block.partition("\r\n\r\n")
        page = Page(body)
    status, *lines = head.split("\r\n")
    fields = [f"source-record-id: {source['record_id']}", f"source-payload-digest: {source['payload_digest']}"]
    fields += [f"source-block-digest: {source['block_digest']}", f"http-status: {_one_line(status)}"]
    fields += [f"http-header: {_one_line(x)}" for x in lines if x]
    if page.lang:
        fields.append(f"html-lang: {_one_line(page.lang.lower())}")
    if page.title is not None:
        fields.append(f"html-title: {page.title}")
    fields += [f"outlink: {_one_line(_joined(source['target_uri'], x))} L a/@href" for x in page.links]
    metadata = "".join(x + "\r\n" for x in fields)
    return [
        _derived("metadata", "application/warc-fields", metadata, source),
        _derived("conversion", "text/plain; charset=utf-8", page.text, source),
    ]


def _joined(base: str | None, link: str) -> str:
    try:
        return urljoin(base or "", link)
    except ValueError:  # not a url, such as one with half a pair of brackets
        return link


def _arrow(rows: list[dict], schema: T.StructType) -> list[pa.Array]:
    kinds = {"string": pa.string(), "bigint": pa.int64()}
    return [pa.array([r[f.name] for r in rows], kinds[f.dataType.simpleString()]) for f in schema]


def _records(df: DataFrame, make, columns: list[str], keep: str | None) -> DataFrame:
    """make(row) gives the records of a row; `keep` is repeated beside each."""
    kept = [df.schema[keep]] if keep else []
    schema = T.StructType(kept + RECORD.fields)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for lo in range(0, whole.num_rows, 500):
                batch = whole.slice(lo, 500)
                made = [make(r) for r in batch.select(columns).to_pylist()]
                at = pa.array([i for i, m in enumerate(made) for _ in m], pa.int64())
                arrays = [batch.column(batch.schema.get_field_index(keep)).take(at)] if keep else []
                yield pa.RecordBatch.from_arrays([*arrays, *_arrow([r for m in made for r in m], RECORD)], schema.names)

    return df.mapInArrow(run, schema)


def responses(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html", date: str = DATE) -> DataFrame:
    """Response records of a table of pages: id_col and the columns of RECORD.

    A null page is an empty body; a null url leaves the target out. The record id is derived from id, url and payload, so
    repeated rows give equal records. An empty table gives no records.
    """
    pages = pages.select(F.col(id_col).alias("id"), F.col(url_col).alias("url"), F.col(html_col).alias("html"))

    def make(row: dict) -> list[dict]:
        return [response(row["url"], row["html"] or "", date, str(row["id"]))]

    return _records(pages, make, ["id", "url", "html"], "id").withColumnRenamed("id", id_col)


def derive(records: DataFrame, keep: str | None = None) -> DataFrame:
    """Metadata and conversion records of response records: `keep`, if given, and the columns of RECORD.

    refers_to, target_uri and date are those of the response; source_headers and source_digest are its HTTP head and payload
    digest. Records of other types are passed over. Nulls in a response count as empty texts. Blocks are texts, as responses() makes them, or
    bytes, as read_records() gives them.
    """
    columns = ["record_id", "target_uri", "date", "source_headers", "block_digest", "payload_digest", "block"]

    def make(row: dict) -> list[dict]:
        return derivatives({k: v if v is not None or k == "target_uri" else "" for k, v in row.items()})

    found = records.where(F.col("record_type") == "response").select(*([keep] if keep else []), *columns)
    return _records(found, make, columns, keep)


def write_records(records: DataFrame, path: str, per_file: int = 20_000) -> None:
    """WARC files, gzip-compressed: every record's head, block and the two line ends after it."""
    whole = records.select(F.concat("headers", "block").alias("value"))
    whole.write.option("lineSep", "\r\n\r\n").option("compression", "gzip").option("maxRecordsPerFile", per_file).text(path)


def parse(file: BinaryIO) -> Iterator[tuple[str, dict[str, str], bytes]]:
    """Head, fields by lower-case name, and block, of every record of a WARC file, one at a time."""
    while line := file.readline():
        if not line.startswith(b"WARC/"):
            continue  # the line ends between records
        head = [line]
        while (line := file.readline()) not in (b"\r\n", b"\n", b""):
            head.append(line)
        fields = {}
        for x in head[1:]:
            k, _, v = x.decode("utf-8", "replace").partition(":")
            fields[k.strip().lower()] = v.strip()
        yield b"".join(head).decode("utf-8", "replace") + "\r\n", fields, file.read(int(fields.get("content-length", 0)))


def read_records(spark: SparkSession, path: str) -> DataFrame:
    """Records of gzip-compressed or plain WARC files: the columns of RECORD, the block as bytes.

    Files are inflated member by member and given out record by record, so a task holds one file as it is stored and one record. Of a
    response, source_headers is its HTTP head and source_digest its payload's digest; a digest that the file lacks is made.
    """
    schema = T.StructType([T.StructField(f.name, T.BinaryType() if f.name == "block" else f.dataType) for f in RECORD])
    kinds = [pa.binary() if f.name == "block" else pa.int64() if f.name == "n_bytes" else pa.string() for f in RECORD]

    def record(head: str, fields: dict[str, str], block: bytes) -> tuple:
        kind, get = fields.get("warc-type"), fields.get
        http, cut, body = block.partition(b"\r\n\r\n") if kind == "response" else (b"", b"", block)
        payload = get("warc-payload-digest") or digest(body)
        headers = (http + cut).decode("utf-8", "replace") if kind == "response" else None
        source = payload if kind == "response" else get("warc-source-payload-digest")
        return (
            get("warc-record-id"), kind, get("warc-refers-to"), get("warc-target-uri"), get("warc-date"), get("content-type"), headers,
            source, get("warc-block-digest") or digest(block), payload, len(block), head, block,
        )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import gzip
        import io

        for batch in batches:
            for content in batch.column(0):
                data = content.as_buffer()
                stored = io.BytesIO(data)
                file = io.BufferedReader(gzip.GzipFile(fileobj=stored), 1 << 20) if data[:2].to_pybytes() == b"\x1f\x8b" else stored
                held, size = [], 0
                for found in parse(file):
                    held.append(record(*found))
                    size += len(found[2])
                    if size > 1 << 24 or len(held) == 1000:
                        yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*held, strict=True), kinds, strict=True)], schema.names)
                        held, size = [], 0
                if held:
                    yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*held, strict=True), kinds, strict=True)], schema.names)

    return spark.read.format("binaryFile").load(path).select("content").mapInArrow(run, schema)
