"""WARC derivatives: from response records to linked metadata and plain-text conversion records.

``responses`` wraps fetched pages as WARC/1.1 response records. ``derive`` turns each response into two records: a
metadata record (JSON: the source's WARC and HTTP headers, title, links) and a conversion record (plain text). Both
carry WARC-Refers-To with the response's record id, its target URI and date, and its payload digest, so the link
back survives any later shuffle. ``write_records`` stores records as one gzip member each.

Record ids are name-based (from page id, target URI and payload digest), so a repeated run or a retried task gives the same ids.

Defined cases: a null or empty page is a response with an empty payload, an empty text and no links; a null URL is an
empty target URI; a payload that begins with an HTTP status line and headers up to a blank line brings its own headers,
any other gets minimal ones; a header that is repeated has the list of its values; links in noscript and template count,
those written by scripts or inside comments don't, and of an element with several the first counts; the first title is
the title; a tag left open at the end of a page is text; very long and broken pages take linear time; repeated rows give equal records; an empty table gives none; other columns are not read.
"""

from __future__ import annotations

import base64
import gzip
import hashlib
import html
import json
import re
import uuid

import pyarrow as pa
import pyarrow.fs as pafs
from pyspark import TaskContext
from pyspark.sql import DataFrame

DATE = "1970-01-01T00:00:00Z"
SPACE = uuid.UUID("6ba7b811-9dad-11d1-80b4-00c04fd430c8")  # the standard's name space for URLs
HIDDEN = frozenset({"script", "style", "template", "noscript"})  # no visible text
OPAQUE = frozenset({"script", "style"})  # no tags either
LINKS = frozenset({"a", "area", "link", "img", "script", "iframe"})
BREAKS = frozenset(
    "address article aside blockquote body br dd div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 head header hr html li main nav ol p pre section table td th title tr ul".split()
)
CLOSE = {k: re.compile(rf"</{k}\s*>", re.I) for k in (*HIDDEN, "title")}
NAME = re.compile(r"[a-zA-Z][a-zA-Z0-9]*")
#: A tag without surprises; it never looks beyond the next < or > and never goes back.
PLAIN_TAG = re.compile(r"""<(/?)([a-zA-Z][a-zA-Z0-9]*+)((?:\s++[^\s<>"'=/]++(?:\s*+=\s*+(?:"[^"<>]*+"|'[^'<>]*+'|[^\s"'<>=`]++))?+)*+)\s*+/?>""")
ENDS = re.compile(r"[>=]")
VALUE = re.compile(r"\s*(?:[\"']|([^\s>]*))")
NUMBER = re.compile(r"&#0+(?=[0-9])"), re.compile(r"&#[1-9][0-9]{7,};?")  # leading zeros; numbers beyond any character
STATUS = re.compile(rb"HTTP/\d(?:\.\d)? \d{3}(?: [^\r\n]*)?(?:\r\n|\Z)")
BLANKS = re.compile(r"[^\S\n]+")
LINES = re.compile(r" ?\n[ \n]*")


def digest(data: bytes) -> str:
    return "sha1:" + base64.b32encode(hashlib.sha1(data).digest()).decode()


def record_id(*parts: object) -> str:
    return f"<urn:uuid:{uuid.uuid5(SPACE, json.dumps(parts))}>"


def serialize(headers: dict[str, str], block: bytes) -> bytes:
    head = "WARC/1.1\r\n" + "".join(f"{k}: {v}\r\n" for k, v in headers.items())
    return head.encode() + b"\r\n" + block + b"\r\n\r\n"


def fields(lines: list[str]) -> dict[str, str | list[str]]:
    """Value by name in the order of the lines, of a repeated name the list of its values; an indented line goes on the one before."""
    pairs: list[tuple[str, list[str]]] = []
    for line in lines:
        if line[:1] in (" ", "\t") and pairs:
            pairs[-1][1].append(line.strip())
        else:
            name, _, value = line.partition(":")
            pairs.append((name.strip(), [value.strip()]))
    found: dict[str, str | list[str]] = {}
    for name, values in pairs:
        value = " ".join(x for x in values if x)
        if name not in found:
            found[name] = value
        elif isinstance(found[name], list):
            found[name].append(value)
        else:
            found[name] = [found[name], value]
    return found


def parse(record: bytes) -> tuple[dict[str, str | list[str]], bytes]:
    """Headers and block of one serialized record."""
    head, _, rest = record.partition(b"\r\n\r\n")
    headers = fields(head.decode().split("\r\n")[1:])
    return headers, rest[: int(headers["Content-Length"])]


def split_http(block: bytes) -> tuple[str, dict[str, str | list[str]], bytes]:
    """Status line, headers and payload of an HTTP response; a block that isn't one is all payload."""
    head, end, payload = block.partition(b"\r\n\r\n")
    if not end or not STATUS.match(head):
        return "", {}, block
    status, *lines = head.decode("utf-8", "replace").split("\r\n")
    return status, fields(lines), payload


def tag_end(page: str, at: int, wanted: bool, end: int) -> tuple[int, dict[str, str]]:
    """Where the tag whose name ends at ``at`` ends, behind its ``>``, or -1 if not before ``end``, and its href and src if ``wanted``."""
    found: dict[str, str] = {}
    while (m := ENDS.search(page, at, end)) is not None:
        if m[0] == ">":
            return m.end(), found
        name = page[at : m.start()].split()[-1:] if wanted else []
        m = VALUE.match(page, m.end(), end)
        value, at = m[1], m.end()
        if value is None:
            close = page.find(page[at - 1], at, end)
            if close < 0:
                break
            value, at = page[at:close], close + 1
        if name and (name := name[0].lower()) in ("href", "src"):
            found.setdefault(name, value)
    return -1, found


def scan(page: str) -> tuple[str, str | None, list[tuple[str, str, str]]]:
    """Visible raw text, raw title and links (element, attribute, raw value) of a page, in one pass over its ``<`` and ``>``.

    Quoted values may hold a ``>``, until a tag would stay open to the end of the page. Every search starts behind what is
    done or is the last of its kind, so the work is linear in the page, however its tags are broken. Behind the last
    ``>`` there are no tags, only text and an open comment.
    """
    out: list[str] = []
    links: list[tuple[str, str, str]] = []
    title, titles, quotes = None, True, True
    at, hidden, last = 0, 0, page.rfind(">")

    def text(a, b):
        if b > (a := max(a, hidden)):
            out.append(page[a:b])

    while (i := page.find("<", at)) >= 0:
        if (m := PLAIN_TAG.match(page, i)) is not None and (name := m[2].lower()) not in HIDDEN and name != "title":
            if at >= hidden:
                if i > at:
                    out.append(page[at:i])
                if name in BREAKS:
                    out.append("\n")
            else:
                text(at, i)
                if i >= hidden and name in BREAKS:
                    out.append("\n")
            at = m.end()
            if name in LINKS and not m[1] and m[3]:
                links += [(name, k, v) for k, v in list(tag_end(page, m.end(2), True, at)[1].items())[:1]]
            continue
        if page.startswith("<!--", i):
            text(at, i)
            close = page.find("-->", i + 4)
            at = close + 3 if close >= 0 else len(page)
            if i >= hidden:
                out.append(" ")
            continue
        if i > last:
            break
        closing = page.startswith("/", i + 1)
        m = NAME.match(page, i + 1 + closing)
        if m is None:
            if page[i + 1 : i + 2] in ("/", "!", "?"):
                end = page.index(">", i) + 1
                text(at, i)
                at = end
            else:
                text(at, i + 1)
                at = i + 1
            continue
        text(at, i)
        name = m[0].lower()
        at, values = tag_end(page, m.end(), not closing and name in LINKS, len(page)) if quotes else (-1, {})
        if at < 0:  # a quote is left open: from here on tags end at the first >
            quotes = False
            at = page.index(">", m.end()) + 1
            values = tag_end(page, m.end(), not closing and name in LINKS, at)[1]
        links += [(name, k, v) for k, v in list(values.items())[:1]]
        if i < hidden:
            if not closing and name in OPAQUE:
                close = CLOSE[name].search(page, at)
                at = close.end() if close else len(page)
            continue
        if not closing and name in HIDDEN:
            close = CLOSE[name].search(page, at)
            hidden = close.end() if close else len(page)
            out.append(" ")
            if name in OPAQUE:
                at = hidden
        elif name in BREAKS:
            out.append("\n")
        if titles and name == "title" and not closing:
            titles = False
            if (close := CLOSE["title"].search(page, at)) is not None:
                title = page[at : close.start()]
    text(at, len(page))
    return "".join(out), title, links


def characters(raw: str) -> str:
    """References become characters; numbers beyond any character, however long, become U+FFFD."""
    if "&" not in raw:
        return raw
    if "&#" in raw:
        raw = NUMBER[1].sub("\ufffd", NUMBER[0].sub("&#", raw))
    return html.unescape(raw)


def page_text(page: str) -> str:
    """Visible text: hidden parts and tags go, block elements break lines, references become characters, blanks collapse."""
    return visible(scan(page)[0])


def visible(raw: str) -> str:
    return LINES.sub("\n", BLANKS.sub(" ", characters(raw).replace("\r", "\n"))).strip()


def page_metadata(page: str) -> dict:
    return metadata(*scan(page)[1:])


def metadata(title: str | None, links: list[tuple[str, str, str]]) -> dict:
    return {"Title": None if title is None else characters(title).strip(), "Links": [{"path": f"{n.upper()}@/{k}", "url": characters(v)} for n, k, v in links]}


def response(page_id: object, url: str | None, page: str | None, date: str = DATE) -> bytes:
    """One page as a serialized response record."""
    payload = (page or "").encode()
    status, _, body = split_http(payload)
    if status:
        block, payload = payload, body
    else:
        block = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode() + payload
    uri, of_payload = " ".join((url or "").split()), digest(payload)
    return serialize({
        "WARC-Type": "response", "WARC-Record-ID": record_id("response", page_id, uri, of_payload), "WARC-Date": date, "WARC-Target-URI": uri,
        "WARC-Payload-Digest": of_payload, "WARC-Block-Digest": digest(block), "Content-Type": "application/http; msgtype=response", "Content-Length": str(len(block)),
    }, block)


def derivatives(record: bytes) -> list[tuple[str, str, bytes]]:
    """Kind, record id and bytes of the metadata and the conversion record of a response."""
    source, block = parse(record)
    status, headers, payload = split_http(block)
    raw, title, links = scan(payload.decode("utf-8", "replace"))
    envelope = {
        "WARC-Header-Metadata": source,
        "Payload-Metadata": {"HTTP-Response-Metadata": {"Response-Message": status, "Headers": headers, "Entity-Length": len(payload), "Entity-Digest": digest(payload), "HTML-Metadata": metadata(title, links)}},
    }
    out = []
    for kind, mime, own in (
        ("metadata", "application/json", json.dumps({"Envelope": envelope}, ensure_ascii=False, separators=(",", ":")).encode()),
        ("conversion", "text/plain", visible(raw).encode()),
    ):
        rid = record_id(kind, source["WARC-Record-ID"])
        out.append((kind, rid, serialize({
            "WARC-Type": kind, "WARC-Record-ID": rid, "WARC-Date": source["WARC-Date"], "WARC-Target-URI": source["WARC-Target-URI"],
            "WARC-Refers-To": source["WARC-Record-ID"], "WARC-Refers-To-Target-URI": source["WARC-Target-URI"], "WARC-Refers-To-Date": source["WARC-Date"],
            "WARC-Source-Payload-Digest": source["WARC-Payload-Digest"], "WARC-Block-Digest": digest(own), "Content-Type": mime, "Content-Length": str(len(own)),
        }, own)))
    return out


def responses(pages: DataFrame, date: str = DATE) -> DataFrame:
    """``page_id`` and ``record``, the serialized response, of pages with ``page_id``, ``url`` and ``html``."""

    def run(batches):
        for batch in batches:
            rows = zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2), strict=True)
            records = [response(i, u, h.as_py(), date) for i, u, h in rows]
            yield pa.RecordBatch.from_pydict({"page_id": batch.column(0), "record": pa.array(records, pa.binary())})

    return pages.selectExpr("cast(page_id as long) page_id", "url", "html").mapInArrow(run, "page_id long, record binary")


def derive(records: DataFrame) -> DataFrame:
    """Two rows per response: ``page_id``, ``record_type``, ``record_id``, ``refers_to``, ``target_uri``, digests, sizes and the serialized ``record``."""
    names = ("page_id", "record_type", "record_id", "refers_to", "target_uri", "source_payload_digest", "block_digest", "block_bytes", "record")
    kinds = (pa.int64(), *[pa.string()] * 6, pa.int64(), pa.binary())

    def run(batches):
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                rows = []
                for page_id, record in zip(batch.column(0).slice(at, 256).to_pylist(), batch.column(1).slice(at, 256), strict=True):
                    for kind, rid, own in derivatives(record.as_py()):
                        h, block = parse(own)
                        rows.append((page_id, kind, rid, h["WARC-Refers-To"], h["WARC-Target-URI"], h["WARC-Source-Payload-Digest"], h["WARC-Block-Digest"], len(block), own))
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), kinds, strict=True)], names=list(names))

    ddl = ", ".join(f"{n} {'long' if n in ('page_id', 'block_bytes') else 'binary' if n == 'record' else 'string'}" for n in names)
    return records.select("page_id", "record").mapInArrow(run, ddl)


FILE_BYTES = 1 << 30


def write_records(records: DataFrame, folder: str, file_bytes: int = FILE_BYTES) -> DataFrame:
    """Store ``record`` of every row in .warc.gz files, in a folder that all executors reach; returns file names and counts.

    A partition streams into one file after another of about ``file_bytes``, a record at a time. A file appears under its name when it is whole, and a
    repeated attempt replaces it.
    """

    def run(batches):
        fs, top = pafs.FileSystem.from_uri(folder)
        fs.create_dir(top, recursive=True)
        place, number, out, attempt, held, n = TaskContext.get().partitionId(), 0, None, "", 0, 0

        def finish():
            out.close()
            name = f"part-{place:06d}-{number:05d}.warc.gz"
            fs.move(attempt, f"{top}/{name}")
            return pa.RecordBatch.from_pydict({"file": [name], "records": [n]})

        for batch in batches:
            for x in batch.column(0):
                if out is None:
                    attempt = f"{top}/.{place}-{uuid.uuid4().hex}.tmp"
                    out, held, n = fs.open_output_stream(attempt), 0, 0
                part = gzip.compress(x.as_py(), 6, mtime=0)
                out.write(part)
                held, n = held + len(part), n + 1
                if held >= file_bytes:
                    yield finish()
                    out, number = None, number + 1
        if out is not None:
            yield finish()

    return records.select("record").mapInArrow(run, "file string, records long")
