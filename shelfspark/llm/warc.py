"""WARC derivatives: metadata and plain-text conversion records linked to the response that they come from.

A record is a row: headers as an ordered map, the block as bytes. Identifiers follow from the source row, so a rerun writes the
same records. `write_warc` stores records as rows of gzip members, each a WARC file by itself; `read_warc` reads them back.
"""

import base64
import gzip
import hashlib
import html
import json
import re
import uuid
from dataclasses import dataclass, field
from urllib.parse import urljoin

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

_NAMESPACE = uuid.UUID("8e0f6d0e-52f4-5d6b-9d5b-3c1d4b8f1a77")
DATE = "1970-01-01T00:00:00Z"
_PAIR = pa.list_(pa.struct([("name", pa.string()), ("value", pa.string())]))
RECORD = pa.schema([("page_id", pa.string()), ("type", pa.string()), ("record_id", pa.string()), ("refers_to", pa.string()),
                    ("target_uri", pa.string()), ("headers", _PAIR), ("block", pa.binary())])
RECORD_SQL = ("page_id string, type string, record_id string, refers_to string, target_uri string, "
              "headers array<struct<name string, value string>>, block binary")

# Elements without readable text, and elements that end a line.
_HIDDEN = ("noscript", "template")
_RAW = {n: re.compile(rf"</{n}(?=[\s/>])[^<>]*>?", re.I) for n in ("script", "style", "title")}
# What may stand in a head; any other element, and any text, begins the body.
_IN_HEAD = {"base", "basefont", "bgsound", "head", "html", "link", "meta", "noframes", "noscript", "script", "style", "template", "title"}
_CLOSED = re.compile(r"</(noscript|template|title)(?=[\s/>])", re.I)
_LINE = ("address article aside blockquote br dd div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hr li main nav ol p pre "
         "section table td th tr ul").split()
_MARKUP = re.compile(r"<(?:!--(?P<comment>.*?)(?:-->|\Z)|(?P<close>/?)(?P<name>[a-zA-Z][a-zA-Z0-9]*)(?P<rest>[^<>]*)>|[!?/][^<>]*>)", re.S)
_ATTRIBUTE = re.compile(r"([^\s=/\"'>]+)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]*))")


def _attribute(source: str, wanted: str) -> str | None:
    """The first attribute of that name with its references resolved, blanks around it gone."""
    for name, double, single, bare in _ATTRIBUTE.findall(source):
        if name.lower() == wanted:
            return html.unescape(double or single or bare).strip()
    return None


@dataclass
class Page:
    """What a page says: readable text, title, language, and the targets of its links in their order."""

    text: str = ""
    title: str | None = None
    lang: str | None = None
    links: list[str] = field(default_factory=list)


def digest(data: bytes) -> str:
    return "sha1:" + base64.b32encode(hashlib.sha1(data).digest()).decode()


def plain_text(markup: str) -> str:
    """Readable text of a page, see `read_page`."""
    return read_page(markup).text


def read_page(markup: str) -> Page:
    """Text, title, language and links of a page: hidden elements and comments go, block elements end a line, references are resolved.

    A head ends at its end tag, at the body, or at the first element or text that cannot stand in it. A script, a style and a
    head's title are raw up to their own end tag; a script, style or comment that is never closed hides the rest of the page,
    as in a browser, any other element hides nothing then. A `<` that opens no tag is text. Links and language come from
    elements that are not hidden, the title from the head.
    """
    out, at, hidden, head = [], 0, None, False
    page = Page()
    last = {found[1].lower(): found.start() for found in _CLOSED.finditer(markup)}
    while found := _MARKUP.search(markup, at):
        if hidden is None:
            text = markup[at: found.start()]
            head = head and not text.strip()
            out.append(text)
        at = found.end()
        name = (found["name"] or "").lower()
        opens = name and not found["close"] and not found["rest"].endswith("/")
        if opens and (name in ("script", "style") or name == "title" and head and not hidden):
            end = _RAW[name].search(markup, at) if name != "title" or at <= last.get(name, -1) else None
            if name == "title":
                stop = end.start() if end else start if (start := markup.find("<", at)) >= 0 else len(markup)
                page.title = " ".join(html.unescape(markup[at:stop]).split()) if page.title is None else page.title
            if end:
                at = end.end()
            elif name == "title":
                at = stop
            else:
                at, hidden = len(markup), name
                break
        elif hidden:
            if found["close"] and name == hidden:
                hidden = None
        elif opens and name in _HIDDEN and found.start() < last.get(name, -1):
            hidden = name
        else:
            if name == "head" and not head:
                head = bool(opens)
            elif head and name:
                head = name not in ("head", "body", "html", "br") if found["close"] else name in _IN_HEAD
            if name in _LINE:
                out.append("\n")
            if name == "a" and not found["close"] and (link := _attribute(found["rest"], "href")) is not None:
                page.links.append(link)
            elif name == "html" and opens and page.lang is None:
                page.lang = _attribute(found["rest"], "lang")
    if hidden is None:
        out.append(markup[at:])
    lines = (" ".join(line.split()) for line in html.unescape("".join(out)).split("\n"))
    page.text = "\n".join(line for line in lines if line)
    return page


def _resolved(base: str | None, link: str) -> str:
    """A link against its page's address; as it stands where either is no address."""
    try:
        return urljoin(base or "", link)
    except ValueError:
        return link


def http_response(page: str) -> bytes:
    body = page.encode("utf-8", "replace")
    return b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: %d\r\n\r\n" % len(body) + body


def _split_http(block: bytes) -> tuple[list[tuple[str, str]], bytes]:
    """(headers of the source, payload)."""
    head, mark, payload = block.partition(b"\r\n\r\n")
    if not mark or not head.startswith(b"HTTP/"):
        return [], block
    lines = head.decode("latin-1").split("\r\n")[1:]
    return [tuple(part.strip() for part in line.partition(":")[::2]) for line in lines if ":" in line], payload


def _record_id(kind: str, *parts: str) -> str:
    return f"<urn:uuid:{uuid.uuid5(_NAMESPACE, json.dumps([kind, *parts]))}>"


def _headers(kind: str, record_id: str, uri: str | None, date: str, block: bytes, content_type: str, more: list[tuple[str, str]]) -> list[dict]:
    pairs = [("WARC-Type", kind), ("WARC-Record-ID", record_id), ("WARC-Date", date)]
    pairs += [("WARC-Target-URI", uri)] if uri is not None else []
    pairs += [*more, ("WARC-Block-Digest", digest(block)), ("Content-Type", content_type), ("Content-Length", str(len(block)))]
    return [{"name": n, "value": re.sub(r"[\r\n]+", " ", v)} for n, v in pairs]


def _response(page_id: str, url: str | None, page: str | None, date: str) -> dict:
    block = http_response(page or "")
    record_id = _record_id("response", page_id, url or "", digest(block))
    more = [("WARC-Payload-Digest", digest(_split_http(block)[1]))]
    return {"page_id": page_id, "type": "response", "record_id": record_id, "refers_to": None, "target_uri": url,
            "headers": _headers("response", record_id, url, date, block, "application/http; msgtype=response", more), "block": block}


def _derived(source: dict) -> list[dict]:
    """The metadata and the conversion record of a response."""
    known = {x["name"].lower(): x["value"] for x in source["headers"]}
    http, payload = _split_http(source["block"])
    charset = next((m[1] for n, v in http if n.lower() == "content-type" and (m := re.search(r"charset=([\w-]+)", v))), "utf-8")
    try:
        markup = payload.decode(charset, "replace")
    except LookupError:
        markup = payload.decode("utf-8", "replace")
    page = read_page(markup)
    text = page.text.encode("utf-8", "replace")
    fields = [("title", page.title), ("language", page.lang.lower() if page.lang else None)]
    fields += [("outlink", " ".join(_resolved(source["target_uri"], link).split())) for link in page.links]
    fields += [(f"source-{n.lower()}", v) for n, v in http]
    facts = "".join(f"{n}: {v}\r\n" for n, v in fields if v is not None).encode("utf-8", "replace")
    date, uri = known.get("warc-date", DATE), source["target_uri"]
    payload_digest = known.get("warc-payload-digest") or digest(payload)
    links = [("WARC-Refers-To", source["record_id"])]
    links += [("WARC-Refers-To-Target-URI", uri)] if uri is not None else []
    links += [("WARC-Refers-To-Date", date), ("WARC-Source-Payload-Digest", payload_digest)]
    out = []
    for kind, block, content_type in (("metadata", facts, "application/warc-fields"), ("conversion", text, "text/plain; charset=utf-8")):
        record_id = _record_id(kind, source["record_id"])
        out.append({"page_id": source["page_id"], "type": kind, "record_id": record_id, "refers_to": source["record_id"], "target_uri": uri,
                    "headers": _headers(kind, record_id, uri, date, block, content_type, links), "block": block})
    return out


def _texts(batch: pa.RecordBatch):
    """page_id, url, html of each row; bytes that are no UTF-8 become replacement characters."""
    columns = [batch.column(c).cast(pa.binary()).to_pylist() for c in ("page_id", "url", "html")]
    return zip(*([None if x is None else x.decode("utf-8", "replace") for x in column] for column in columns))


def responses(pages: DataFrame, date: str = DATE) -> DataFrame:
    """Response records of pages (page_id, url, html; other columns are ignored).

    A null page has an empty payload, a null url no target, a null page_id an empty identifier. Equal rows give equal records;
    a page of any length is one record, held in memory with its derivatives.
    """

    def work(batches):
        for batch in batches:
            yield pa.RecordBatch.from_pylist([_response(i or "", u, h, date) for i, u, h in _texts(batch)], RECORD)

    return pages.select(*[F.col(c).cast("string").alias(c) for c in ("page_id", "url", "html")]).mapInArrow(work, RECORD_SQL)


def derive(records: DataFrame) -> DataFrame:
    """Metadata and conversion records of the response records in `records`; records of other types give none.

    Both carry WARC-Refers-To, the target and date of the source, its payload digest, and a digest of their own block; the
    metadata lists title, language, links and the source's HTTP headers.
    """

    def work(batches):
        for batch in batches:
            rows = [d for r in batch.to_pylist() if r["type"] == "response" for d in _derived(r | {"headers": r["headers"] or [], "block": r["block"] or b""})]
            yield pa.RecordBatch.from_pylist(rows, RECORD)

    return records.select(*RECORD.names).mapInArrow(work, RECORD_SQL)


def build(pages: DataFrame, date: str = DATE) -> DataFrame:
    """Response records of the pages with their derivatives, each page's three records together."""

    def work(batches):
        for batch in batches:
            out = []
            for i, u, h in _texts(batch):
                source = _response(i or "", u, h, date)
                out += [source, *_derived(source)]
            yield pa.RecordBatch.from_pylist(out, RECORD)

    return pages.select(*[F.col(c).cast("string").alias(c) for c in ("page_id", "url", "html")]).mapInArrow(work, RECORD_SQL)


def to_bytes(record: dict) -> bytes:
    """A record as it stands in an uncompressed file."""
    head = "".join(f"{x['name']}: {x['value']}\r\n" for x in record["headers"])
    return b"WARC/1.1\r\n" + head.encode() + b"\r\n" + (record["block"] or b"") + b"\r\n\r\n"


def from_bytes(raw: bytes) -> list[dict]:
    """Records of an uncompressed file; raises ValueError where it is broken."""
    out, at = [], 0
    while at < len(raw):
        end = raw.find(b"\r\n\r\n", at)
        if end < 0 or not raw.startswith(b"WARC/", at):
            raise ValueError(f"no record at byte {at}")
        headers = []
        for line in raw[at:end].decode().split("\r\n")[1:]:
            name, _, value = line.partition(": ")
            headers.append({"name": name, "value": value})
        known = {x["name"].lower(): x["value"] for x in headers}
        size = int(known["content-length"])
        block = raw[end + 4: end + 4 + size]
        if len(block) < size or digest(block) != known["warc-block-digest"]:
            raise ValueError(f"the block at byte {end + 4} is not what its headers say")
        out.append({"type": known["warc-type"], "record_id": known["warc-record-id"], "refers_to": known.get("warc-refers-to"),
                    "target_uri": known.get("warc-target-uri"), "headers": headers, "block": block})
        at = end + 4 + size + 4
    return out


def write_warc(records: DataFrame, folder: str) -> None:
    """Store records as rows of gzip members (a member is a WARC file by itself) with their type and identifier."""

    def work(batches):
        for batch in batches:
            rows = batch.to_pylist()
            yield pa.RecordBatch.from_arrays(
                [pa.array([r[c] for r in rows], pa.string()) for c in ("page_id", "type", "record_id")]
                + [pa.array([gzip.compress(to_bytes(r), mtime=0) for r in rows], pa.binary())], ["page_id", "type", "record_id", "member"])

    members = records.mapInArrow(work, "page_id string, type string, record_id string, member binary")
    members.write.mode("errorifexists").parquet(folder)


def read_warc(spark: SparkSession, folder: str) -> DataFrame:
    """Records that `write_warc` stored."""

    def work(batches):
        for batch in batches:
            out = []
            for page_id, member in zip(batch.column("page_id").to_pylist(), batch.column("member").to_pylist()):
                out += [r | {"page_id": page_id} for r in from_bytes(gzip.decompress(member))]
            yield pa.RecordBatch.from_pylist(out, RECORD)

    return spark.read.parquet(folder).select("page_id", "member").mapInArrow(work, RECORD_SQL)
