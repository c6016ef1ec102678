"""WARC derivatives: linked metadata and plain-text conversion records.

Each response record gives a ``metadata`` record (application/warc-fields) and a
``conversion`` record (text/plain). Both name the response in WARC-Refers-To,
with its target URI and date; both keep the source's headers and digests, and
have block digests of their own. Identifiers of derived records are made from
the response's identifier, so a repeated run gives the same records.

Records are rows (type, id, uri, date, headers, block); :func:`parse` and
:func:`serialize` turn them from and into WARC/1.1 bytes, gzipped record by
record.

A response's chunks and content coding (gzip, deflate, zstd) are undone and its
character set honoured; with another coding the conversion is empty and the
metadata names it. Reading markup and files takes time linear in their size.

Defined cases: a null url has no target URI; null html is an empty page with an
empty conversion; repeated pages give repeated records of one identifier; a null
page_id is kept; an empty table gives no records; other columns are not read.
"""

from __future__ import annotations

import base64
import codecs
import gzip
import hashlib
import html as entities
import re
import uuid
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

NAMESPACE = uuid.UUID("6ba7b811-9dad-11d1-80b4-00c04fd430c8")  # RFC 4122, URLs
DATE = "2024-01-01T00:00:00Z"
#: Fixed sets of element names: not shown, and ending a line.
HIDDEN = frozenset("script style noscript template".split())
BREAKS = frozenset("p div br li ul ol table tr h1 h2 h3 h4 h5 h6 article section nav header footer blockquote pre title hr dd dt dl form body html head".split())
_NAME, _CLOSE_TITLE = re.compile(r"/?([a-zA-Z][^\s/>]*)"), re.compile("</title", re.I)
_CLOSE = {name: re.compile(rf"</{name}\s*>", re.I) for name in HIDDEN}
_SPACE, _LINES = re.compile(r"[^\S\n]+"), re.compile(r"\s*\n\s*")
_LANG = re.compile(r"\blang\s*=\s*[\"']?([\w-]+)", re.I)
_HREF = re.compile(r"\bhref\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]+))", re.I)
#: Character references of so many digits name no character, and int() refuses them.
_LONG_REFERENCE = re.compile("&#[0-9]{200,};?")
_META, _CHARSET = re.compile(rb"<meta\b[^>]{0,500}?charset\s*=\s*[\"']?\s*([\w:.-]+)", re.I), re.compile(r"charset\s*=\s*[\"']?\s*([\w:.-]+)", re.I)
_BOMS = ((codecs.BOM_UTF8, "utf-8"), (codecs.BOM_UTF16_LE, "utf-16-le"), (codecs.BOM_UTF16_BE, "utf-16-be"))
#: Codecs of Python that no page is written in.
_NO_CHARSET = frozenset("idna punycode raw_unicode_escape unicode_escape undefined mbcs oem".split())
INFLATE_AT_ONCE = 1 << 16


def sha1_digest(block: bytes) -> str:
    return "sha1:" + base64.b32encode(hashlib.sha1(block).digest()).decode()


def unescape(text: str) -> str:
    return entities.unescape(_LONG_REFERENCE.sub("\ufffd", text))


@dataclass
class Page:
    """What one pass over a page's markup finds."""

    text: str
    title: str
    lang: str
    links: list[str]


def read_page(html: str) -> Page:
    """Visible text (hidden parts out, block tags as line ends, entities decoded), title, language and links.

    One pass from tag to tag: a tag ends at its next ``>``, and once something
    is never closed it isn't looked for again, so time is linear in any markup.
    """
    out, links, title, lang, at, titled, closed = [], [], "", None, 0, False, True
    while True:
        start = html.find("<", at)
        if start < 0:
            break
        out.append(html[at:start])
        if html.startswith("<!--", start):
            end = html.find("-->", start + 4)
            out.append(" ")
            at = len(html) if end < 0 else end + 3
            continue
        end = html.find(">", start) if closed else -1
        closed = end >= 0
        name = _NAME.match(html, start + 1)
        if not closed or not (name or html[start + 1 : start + 9].lower() == "!doctype"):
            out.append("<")
            at = start + 1
            continue
        at = end + 1
        if not name:
            out.append(" ")
            continue
        tag, opening = name[1].lower(), html[start + 1] != "/"
        if opening and tag in HIDDEN:
            over = _CLOSE[tag].search(html, at)
            at = over.end() if over else len(html)
            out.append(" ")
            continue
        if opening and tag == "a":
            href = _HREF.search(html, start, end)
            links += [href[href.lastindex]] if href else []
        elif opening and tag == "html" and lang is None:
            found = _LANG.search(html, start, end)
            lang = found[1] if found else None
        elif opening and tag == "title" and not titled:
            over, titled = _CLOSE_TITLE.search(html, at), True
            title = html[at : over.start()] if over else ""
        if tag in BREAKS:
            out.append("\n")
    out.append(html[at:])
    text = _LINES.sub("\n", _SPACE.sub(" ", unescape("".join(out)))).strip()
    one = lambda x: re.sub(r"\s+", " ", unescape(x)).strip()
    return Page(text, one(re.sub("<[^<>]*>", "", title)), lang or "", [one(x) for x in links])


def plain_text(html: str) -> str:
    return read_page(html).text


def record_id(*parts: object) -> str:
    return f"<urn:uuid:{uuid.uuid5(NAMESPACE, chr(31).join(map(str, parts)))}>"


Record = tuple[str, dict[str, str], bytes]  # type, headers, block


def response(url: str | None, html: str | None, date: str = DATE) -> Record:
    """A response record of a stored page, with its HTTP head."""
    payload = (html or "").encode("utf-8", "replace")
    block = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: %d\r\n\r\n" % len(payload) + payload
    headers = {"WARC-Type": "response", "WARC-Record-ID": record_id("response", url, hashlib.sha256(payload).hexdigest()), "WARC-Date": date}
    if url is not None:
        headers["WARC-Target-URI"] = re.sub(r"[\r\n]+", " ", url)
    headers |= {"WARC-Payload-Digest": sha1_digest(payload), "WARC-Block-Digest": sha1_digest(block), "Content-Type": "application/http;msgtype=response", "Content-Length": str(len(block))}
    return "response", headers, block


def http_payload(block: bytes) -> tuple[list[str], bytes]:
    """Header lines and body of an HTTP message; a block without a head is all body."""
    head, sep, body = block.partition(b"\r\n\r\n")
    if not sep or not head.startswith(b"HTTP/"):
        return [], block
    return head.decode("latin-1").split("\r\n"), body


def _dechunked(body: bytes) -> bytes:
    out, at = [], 0
    while (end := body.find(b"\r\n", at)) >= 0:
        try:
            n = int(body[at:end].split(b";")[0].strip() or b"0", 16)
        except ValueError:
            return body if not out else b"".join(out)
        if not n:
            break
        out.append(body[end + 2 : end + 2 + n])
        at = end + 2 + n + 2
    return b"".join(out) if out else body


def _inflated(body: bytes, coding: str) -> bytes | None:
    """The body without one content coding; what a broken stream still gives; None if the coding is unknown."""
    if coding in ("", "identity"):
        return body
    if coding == "zstd":
        import zstandard

        try:
            return zstandard.ZstdDecompressor().decompressobj().decompress(body)
        except zstandard.ZstdError:
            return b""
    if coding not in ("gzip", "x-gzip", "deflate"):
        return None
    raw = coding == "deflate" and (len(body) < 2 or body[0] & 15 != 8 or (body[0] * 256 + body[1]) % 31)
    stream, out = zlib.decompressobj(-15 if raw else 47), []
    try:
        for i in range(0, len(body), INFLATE_AT_ONCE):
            out.append(stream.decompress(body[i : i + INFLATE_AT_ONCE]))
    except zlib.error:
        pass
    return b"".join(out)


def _charset(label: str | None) -> str | None:
    try:
        found = codecs.lookup((label or "").strip().lower())
    except (LookupError, ValueError):
        return None
    name = found.name.replace("-", "_")
    if name in _NO_CHARSET or not found._is_text_encoding:
        return None
    # As browsers do: these labels mean the Windows code page.
    return "cp1252" if name in ("iso8859_1", "ascii") else found.name


def decoded(head: list[str], body: bytes) -> tuple[str, str]:
    """The body as text, and the content coding that could not be undone.

    Transfer and content codings go first; the character set is that of a byte
    order mark, the Content-Type, a ``<meta>`` in the first 4096 bytes, or UTF-8.
    """
    fields = {k.strip().lower(): v.strip() for k, v in (x.split(":", 1) for x in head[1:] if ":" in x)}
    if fields.get("transfer-encoding", "").lower() == "chunked":
        body = _dechunked(body)
    for coding in reversed([x.strip().lower() for x in fields.get("content-encoding", "").split(",")]):
        made = _inflated(body, coding)
        if made is None:
            return "", coding
        body = made
    for mark, name in _BOMS:
        if body.startswith(mark):
            return body[len(mark) :].decode(name, "replace"), ""
    told, meta = _CHARSET.search(fields.get("content-type", "")), _META.search(body, 0, 4096)
    name = _charset(told[1] if told else None) or _charset(meta[1].decode("latin-1") if meta else None) or "utf-8"
    return body.decode(name, "replace"), ""


def _derived(kind: str, source: dict[str, str], content_type: str, block: bytes) -> Record:
    headers = {"WARC-Type": kind, "WARC-Record-ID": record_id(kind, source["WARC-Record-ID"]), "WARC-Date": source.get("WARC-Date", DATE), "WARC-Refers-To": source["WARC-Record-ID"]}
    if "WARC-Target-URI" in source:
        headers |= {"WARC-Target-URI": source["WARC-Target-URI"], "WARC-Refers-To-Target-URI": source["WARC-Target-URI"]}
    headers["WARC-Refers-To-Date"] = source.get("WARC-Date", DATE)
    headers |= {f"X-Source-{k}": source[k] for k in ("WARC-Payload-Digest", "WARC-Block-Digest", "Content-Type") if k in source}
    headers |= {"WARC-Block-Digest": sha1_digest(block), "Content-Type": content_type, "Content-Length": str(len(block))}
    return kind, headers, block


def derive(source: Record) -> tuple[Record, Record]:
    """The metadata and conversion records of a response."""
    _, headers, block = source
    head, payload = http_payload(block)
    html, unread = decoded(head, payload)
    page = read_page(html)
    one = lambda x: re.sub(r"\s+", " ", x).strip()
    fields = [("title", page.title), ("lang", page.lang), ("textLength", str(len(page.text)))]
    fields += [("unreadContentEncoding", unread)] * bool(unread)
    fields += [("http", one(x)) for x in head] + [("outlink", x) for x in page.links]
    meta = "".join(f"{k}: {v}\r\n" for k, v in fields).encode("utf-8", "replace")
    return _derived("metadata", headers, "application/warc-fields", meta), _derived("conversion", headers, "text/plain; charset=utf-8", page.text.encode("utf-8", "replace"))


def serialize(records: list[Record]) -> bytes:
    """WARC/1.1, each record a gzip member of its own."""
    out = []
    for _, headers, block in records:
        head = "WARC/1.1\r\n" + "".join(f"{k}: {v}\r\n" for k, v in headers.items()) + "\r\n"
        out.append(gzip.compress(head.encode("utf-8", "replace") + block + b"\r\n\r\n", 6, mtime=0))
    return b"".join(out)


def _members(data: bytes) -> Iterator[bytes]:
    """The members of gzipped data, each inflated in steps."""
    view, at = memoryview(data), 0
    while at < len(view):
        stream, out = zlib.decompressobj(31), []
        while not stream.eof:
            if at >= len(view):
                raise ValueError("a gzip member is cut off")
            piece = view[at : at + INFLATE_AT_ONCE]
            out.append(stream.decompress(piece))
            at += len(piece) - len(stream.unused_data)
        yield b"".join(out)


def parse(data: bytes) -> Iterator[Record]:
    """Records of WARC bytes, gzipped by record or plain, in one pass."""
    if data[:2] == b"\x1f\x8b":
        for raw in _members(data):
            yield from parse(raw)
        return
    at = 0
    while at < len(data):
        end = data.find(b"\r\n\r\n", at)
        if end < 0 or not data.startswith(b"WARC/", at):
            raise ValueError("not a WARC record")
        lines = data[at:end].decode("utf-8", "replace").split("\r\n")[1:]
        headers = dict(line.split(": ", 1) if ": " in line else (line.rstrip(":"), "") for line in lines)
        n = int(headers["Content-Length"])
        yield headers.get("WARC-Type", ""), headers, data[end + 4 : end + 4 + n]
        at = end + 4 + n
        at += 4 * data.startswith(b"\r\n\r\n", at)


def build_derivatives(pages: DataFrame) -> DataFrame:
    """(page_id, type, record_id, refers_to, target_uri, source_payload_digest, block_digest, headers, block)."""
    schema = "page_id long, type string, record_id string, refers_to string, target_uri string, source_payload_digest string, block_digest string, headers map<string,string>, block binary"
    names = [x.strip().split(" ")[0] for x in schema.replace("map<string,string>", "map").split(",")]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for i in range(0, len(pdf), 500):
                rows, part = [], pdf.iloc[i : i + 500]
                for page, url, html in zip(part["page_id"], part["url"], part["html"], strict=True):
                    for kind, h, block in derive(response(url, html)):
                        rows.append((page, kind, h["WARC-Record-ID"], h["WARC-Refers-To"], h.get("WARC-Target-URI"), h["X-Source-WARC-Payload-Digest"], h["WARC-Block-Digest"], h, block))
                yield pd.DataFrame(rows, columns=names).astype({"page_id": "Int64"})

    return pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string"), F.col("html").cast("string")).mapInPandas(run, schema)


def derive_files(files: DataFrame) -> DataFrame:
    """(path, place, warc): the derivatives of each response in the WARC files of (path, content).

    One row a derived record, in the order of the file; ``warc`` is its bytes, so
    the rows of a path in order of place are a WARC file.
    """

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for path, content in zip(pdf["path"], pdf["content"], strict=True):
                place = 0
                for source in parse(bytes(content or b"")):
                    made = derive(source) if source[0] == "response" else ()
                    if made:
                        yield pd.DataFrame({"path": path, "place": range(place, place + len(made)), "warc": [serialize([r]) for r in made]})
                        place += len(made)

    return files.select("path", "content").mapInPandas(run, "path string, place long, warc binary")
