"""Text from the bytes of documents in rich formats, with the standard library alone.

Each reader takes a file's bytes and returns its text, or None if it has none that can be read: a bad file costs a null, not the job.
``document_texts`` applies them to a frame of files, Arrow batch by Arrow batch, after the checks of size and archives.
"""

from __future__ import annotations

import csv
import email
import email.policy
import io
import json
import posixpath
import re
import unicodedata
import zipfile
import zlib
from collections.abc import Callable, Iterator
from html import unescape
from xml.etree import ElementTree

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Limits of files and archives.
MAX_FILE_BYTES, MAX_UNPACKED_BYTES, MAX_RATIO = 100 << 20, 500 << 20, 100.0
MAX_ENTITIES, MAX_REFERENCES = 10, 10_000


def decoded(raw: bytes) -> str:
    """SRC-04: by byte-order mark, else UTF-8, else Windows-1252."""
    for mark, codec in ((b"\xef\xbb\xbf", "utf-8"), (b"\xff\xfe", "utf-16-le"), (b"\xfe\xff", "utf-16-be")):
        if raw.startswith(mark):
            return raw[len(mark) :].decode(codec, "replace")
    try:
        return raw.decode("utf-8")
    except UnicodeDecodeError:
        return raw.decode("cp1252", "replace")


def normalised(text: str) -> str:
    """SRC-17: NFC, line feeds only, at most one blank line, trimmed."""
    text = unicodedata.normalize("NFC", text).replace("\r\n", "\n").replace("\r", "\n")
    return re.sub(r"\n{3,}", "\n\n", text).strip()


# -- archives ----------------------------------------------------------------------------------------------------------
def bad_entry(name: str) -> bool:
    """VAL-02: an archive entry that would leave its folder."""
    return name.startswith(("/", "\\")) or "\0" in name or bool(re.match(r"[A-Za-z]:", name)) or ".." in re.split(r"[/\\]", name)


def zip_bomb(packed: int, unpacked: int) -> bool:
    """VAL-02: an entry that unpacks to too much, or too much for its size."""
    return unpacked > MAX_UNPACKED_BYTES or (packed > 0 and unpacked / packed > MAX_RATIO)


def xml_bomb(text: str) -> bool:
    """VAL-03: too many entities or references, or an entity that refers to another one."""
    found = re.findall(r"<!ENTITY\s+(?:%\s+)?(\S+)\s+[\"']([^\"']*)[\"']", text)
    names = {n for n, _ in found}
    nested = any(f"&{n};" in value for _, value in found for n in names)
    return text.count("<!ENTITY") > MAX_ENTITIES or text.count("&") > MAX_REFERENCES or nested


class Archive:
    """A ZIP file whose entries are checked before they are unpacked."""

    def __init__(self, raw: bytes):
        self.zip = zipfile.ZipFile(io.BytesIO(raw))

    def read(self, name: str) -> bytes:
        entry = self.zip.getinfo(name)
        if bad_entry(name) or zip_bomb(entry.compress_size, entry.file_size):
            raise ValueError("unsafe archive entry")
        return self.zip.read(name)

    def xml(self, name: str) -> ElementTree.Element:
        text = decoded(self.read(name))
        if xml_bomb(text):
            raise ValueError("unsafe XML")
        return ElementTree.fromstring(text)


def local(element: ElementTree.Element) -> str:
    return element.tag.rpartition("}")[2]


def spelled(root: ElementTree.Element, leaves: dict[str, str], blocks: set[str], only: str | None = None) -> str:
    """Text below an element: of ``only`` such elements if named, with signs for some elements and a line's end after blocks."""
    out: list[str] = []

    def walk(e: ElementTree.Element, on: bool) -> None:
        on = on or only is None or local(e) == only
        out.append(leaves.get(local(e), ""))
        if on and e.text:
            out.append(e.text)
        for child in e:
            walk(child, on and local(e) == only if only else on)
            if child.tail and only is None:
                out.append(child.tail)
        if local(e) in blocks:
            out.append("\n")

    walk(root, False)
    return "".join(out)


def docx_text(raw: bytes) -> str:
    """SRC-08: runs of text, with tabs, breaks and paragraphs."""
    return spelled(Archive(raw).xml("word/document.xml"), {"tab": "\t", "br": "\n"}, {"p"}, only="t").strip()


def odt_text(raw: bytes) -> str:
    """SRC-09: paragraphs and headings of content.xml."""
    root = Archive(raw).xml("content.xml")
    body = next((e for e in root.iter() if local(e) == "body"), root)
    parts = [spelled(e, {"tab": "\t", "line-break": "\n", "s": " "}, set()) for e in body.iter() if local(e) in ("p", "h")]
    return "\n".join(parts).strip()


def epub_text(raw: bytes) -> str:
    """SRC-10: the pages of the spine, in its order."""
    archive = Archive(raw)
    package = next(e.attrib["full-path"] for e in archive.xml("META-INF/container.xml").iter() if local(e) == "rootfile")
    root, folder = archive.xml(package), posixpath.dirname(package)
    files = {e.attrib["id"]: e.attrib["href"] for e in root.iter() if local(e) == "item"}
    spine = [e.attrib["idref"] for e in root.iter() if local(e) == "itemref"]
    pages = (html_text(decoded(archive.read(posixpath.normpath(posixpath.join(folder, files[i]))))) for i in spine if i in files)
    return "\n\n".join(p for p in pages if p)


# -- markup ------------------------------------------------------------------------------------------------------------
def html_text(text: str) -> str:
    """SRC-06, for pages inside other files."""
    for name in ("script", "style", "noscript", "head"):
        text = re.sub(rf"(?is)<{name}\b[^>]*>.*?</{name}\s*>", " ", text)
    text = re.sub(r"(?s)<!--.*?-->|<[^>]+>", " ", text)
    return re.sub(r"\s+", " ", unescape(text)).strip()


#: RTF words that stand for a sign, and groups whose text does not count.
RTF_SIGNS = {"par": "\n", "line": "\n", "tab": "\t", "emdash": "—", "endash": "–", "lquote": "‘", "rquote": "’", "ldblquote": "“", "rdblquote": "”", "bullet": "•"}
RTF_SKIPPED = {"fonttbl", "colortbl", "stylesheet", "info", "pict", "object", "fldinst", "header", "footer", "headerf", "footerf"}
RTF = re.compile(r"(?P<brace>[{}])|\\u(?P<code>-?[0-9]+)\??|\\'(?P<hex>[0-9A-Fa-f]{2})|\\(?P<sign>[{}\\])|\\(?P<end>[\r\n])|\\(?P<word>[A-Za-z]+)-?[0-9]* ?|\\.|(?P<text>[^{}\\]+)", re.DOTALL)


def rtf_text(raw: bytes) -> str:
    """SRC-11: text of RTF without its tables and pictures."""
    out: list[str] = []
    skipping = [False]  # of each open group
    for m in RTF.finditer(decoded(raw)):
        kind, value = m.lastgroup, m.group(m.lastgroup) if m.lastgroup else ""
        if kind == "brace":
            if value == "{":
                skipping.append(skipping[-1])
            elif len(skipping) > 1:
                skipping.pop()
        elif kind == "word" and value in RTF_SKIPPED:
            skipping[-1] = True
        elif not skipping[-1]:
            if kind == "code":
                out.append(chr(int(value) % 65536))
            elif kind == "hex":
                out.append(bytes.fromhex(value).decode("cp1252", "replace"))
            else:
                out.append({"sign": value, "text": value, "end": "\n", "word": RTF_SIGNS.get(value, "")}.get(kind or "", ""))
    lines = [line.rstrip() for line in "".join(out).splitlines()]
    return re.sub(r"\n{3,}", "\n\n", "\n".join(lines)).strip()


#: LaTeX environments left out whole, commands whose argument is text, headings, and commands left out with their arguments.
TEX_SKIPPED = "equation equation* align align* gather gather* math displaymath eqnarray eqnarray* figure table lstlisting verbatim tikzpicture".split()
TEX_KEPT = "textbf textit emph underline textsc textrm textsf texttt mbox text title author date footnote".split()
TEX_HEADINGS = "section subsection subsubsection chapter paragraph subparagraph".split()
TEX_BREAKS = {"par": "\n\n", "newline": "\n\n", "linebreak": "\n\n", "item": "\n", "quad": " ", "qquad": " "}
TEX_TOKEN = re.compile(r"\\(?P<word>[A-Za-z@]+)\*?(?:\[[^\]]*\])?|\\(?P<sign>.)|(?P<open>\{)|(?P<close>\})|(?P<tie>~)|(?P<text>[^\\{}~]+)", re.DOTALL)


def tex_text(raw: bytes) -> str:
    """SRC-12: text of LaTeX without comments, mathematics, floats and commands."""
    text = re.sub(r"(?m)(?<!\\)%.*$", "", decoded(raw))
    names = "|".join(map(re.escape, TEX_SKIPPED))
    text = re.sub(rf"(?s)\\begin\{{({names})\}}.*?\\end\{{\1\}}", "", text)
    text = re.sub(r"(?s)(?<!\\)\$\$.*?\$\$|(?<!\\)\$.*?(?<!\\)\$", "", text)
    out: list[str] = []
    hidden = [False]  # of each open group
    pending = False  # whether the next group is a left-out command's argument
    for m in TEX_TOKEN.finditer(text):
        kind, value = m.lastgroup, m.group(m.lastgroup)
        if kind == "open":
            hidden.append(hidden[-1] or pending)
            pending = False
            continue
        if kind == "close":
            left_out = len(hidden) > 1 and hidden.pop() and not hidden[-1]
            pending = left_out and text[m.end() : m.end() + 1] == "{"
            continue
        pending = False
        if hidden[-1]:
            continue
        if kind == "word":
            out.append("\n\n" if value in TEX_HEADINGS else "\n" if value == "end" else TEX_BREAKS.get(value, ""))
            pending = value not in TEX_KEPT and value not in TEX_HEADINGS and value not in TEX_BREAKS
        else:
            out.append({"sign": {"\\": "\n"}.get(value, value if value in "%$&#_ " else ""), "tie": " ", "text": value}[kind])
    return re.sub(r"\n{3,}", "\n\n", re.sub(r"(?m)[ \t]+$", "", "".join(out))).strip()


# -- mail and chats ----------------------------------------------------------------------------------------------------
def _body(message: email.message.Message) -> str:
    if message.is_multipart():
        parts = message.get_payload()
        for kind in ("text/plain", "text/html"):
            for part in parts:
                if part.get_content_type() == kind and (text := _body(part)).strip():
                    return text
        return next((text for part in parts if part.is_multipart() and (text := _body(part)).strip()), "")
    payload = message.get_payload(decode=True) or b""
    try:
        text = payload.decode(message.get_content_charset() or "utf-8", "replace")
    except LookupError:
        text = payload.decode("utf-8", "replace")
    return html_text(text) if "html" in message.get_content_type() else text


def eml_text(raw: bytes) -> str:
    """SRC-13: a message's plain text, else its HTML, else what a nested part has."""
    return _body(email.message_from_bytes(raw, policy=email.policy.compat32)).strip()


def mbox_text(raw: bytes) -> str:
    """SRC-14: the messages of a mailbox, ruled off."""
    parts = re.split(rb"(?m)^From .*\n?", raw)
    return "\n\n---\n\n".join(t for t in map(eml_text, filter(bytes.strip, parts)) if t)


#: Where chats keep their messages, and messages their text.
CHAT_LISTS = ("messages", "tweets", "data", "chats", "items")
CHAT_FIELDS = ("content", "text", "body", "message", "full_text", "tweet")
CSV_FIELDS = ("content", "text", "body", "message", "msg", "comment")


def _message(message: object) -> str | None:
    if not isinstance(message, dict):
        return None
    found = next((v.strip() for f in CHAT_FIELDS if isinstance(v := message.get(f), str) and v.strip()), None)
    if found is None and isinstance(parts := message.get("text"), list):
        texts = [p if isinstance(p, str) else p.get("text") if isinstance(p, dict) else None for p in parts]
        found = "".join(t for t in texts if isinstance(t, str)) or None
    return found


def chat_json_text(raw: bytes) -> str:
    """SRC-15: the messages of a chat export, blank lines between."""
    value = json.loads(decoded(raw))
    lists = [value] if isinstance(value, list) else [v for k in CHAT_LISTS if isinstance(v := value.get(k), list)]
    return next((t for rows in lists if (t := "\n\n".join(filter(None, map(_message, rows))))), "")


def chat_csv_text(raw: bytes) -> str:
    """SRC-16: the column that is named like a message, else the last."""
    head, *rows = csv.reader(io.StringIO(decoded(raw)))
    at = next((i for i, h in enumerate(head) if any(n in h.lower() for n in CSV_FIELDS)), len(head) - 1 if len(head) > 1 else None)
    return "" if at is None else "\n\n".join(r[at].strip() for r in rows if len(r) > at and r[at].strip())


# -- PDF ---------------------------------------------------------------------------------------------------------------
PDF_STREAM = re.compile(rb"<<(?P<dict>(?:[^<>]|<(?!<)|>(?!>)|<<[^<>]*>>)*)>>\s*stream\r?\n(?P<data>.*?)\r?\nendstream", re.DOTALL)
PDF_TEXT = re.compile(rb"\((?P<str>(?:[^()\\]|\\.)*)\)|(?P<gap>-?[0-9]+(?:\.[0-9]+)?)|(?P<op>T\*|Td|TD|Tj|TJ|ET|')", re.DOTALL)
PDF_ESCAPES = {b"n": b"\n", b"r": b"\r", b"t": b"\t", b"b": b"", b"f": b""}


def _pdf_string(raw: bytes) -> str:
    def escape(m: re.Match[bytes]) -> bytes:
        c = m.group(1)
        return bytes([int(c, 8) % 256]) if c.isdigit() else PDF_ESCAPES.get(c, c)

    return re.sub(rb"\\([0-7]{1,3}|.)", escape, raw, flags=re.DOTALL).decode("cp1252", "replace")


def pdf_text(raw: bytes) -> str | None:
    """SRC-07: strings shown by the content streams, plain or deflated, in order; None if encrypted or without text.

    Fonts with encodings of their own are not resolved.
    """
    if not raw.startswith(b"%PDF") or b"/Encrypt" in raw:
        return None
    pages = []
    for m in PDF_STREAM.finditer(raw):
        data = m.group("data")
        if b"FlateDecode" in m.group("dict"):
            try:
                data = zlib.decompressobj().decompress(data, MAX_UNPACKED_BYTES)
            except zlib.error:
                continue
        out: list[str] = []
        for block in re.findall(rb"BT\b(.*?\bET)", data, re.DOTALL):
            for t in PDF_TEXT.finditer(block):
                if t.lastgroup == "str":
                    out.append(_pdf_string(t.group("str")))
                elif t.lastgroup == "gap" and float(t.group("gap")) < -200:
                    out.append(" ")
                elif t.lastgroup == "op" and t.group("op") in (b"T*", b"Td", b"TD", b"ET", b"'"):
                    out.append("\n")
        if text := re.sub(r"\n{2,}", "\n", "".join(out)).strip():
            pages.append(text)
    return "\n\n".join(pages) or None


READERS: dict[str, Callable[[bytes], str | None]] = {
    "pdf": pdf_text, "docx": docx_text, "odt": odt_text, "epub": epub_text, "rtf": rtf_text, "tex": tex_text, "eml": eml_text, "mbox": mbox_text,
    "json": chat_json_text, "csv": chat_csv_text, "html": lambda raw: html_text(decoded(raw)), "txt": decoded,
}


def kind_of(name: str, raw: bytes) -> str:
    """FOR-01: by first bytes, an archive's contents, then the name's ending; plain text otherwise."""
    if raw.startswith(b"%PDF"):
        return "pdf"
    if raw.startswith(b"{\\rtf"):
        return "rtf"
    if raw.startswith(b"PK\x03\x04"):
        try:
            names = set(zipfile.ZipFile(io.BytesIO(raw)).namelist())
        except zipfile.BadZipFile:
            return "zip"
        return next((k for k, n in (("docx", "word/document.xml"), ("epub", "META-INF/container.xml"), ("odt", "content.xml")) if n in names), "zip")
    ending = name.rpartition(".")[2].lower()
    return {"htm": "html", "latex": "tex", "md": "txt"}.get(ending, ending if ending in READERS else "txt")


def read_document(name: str, raw: bytes | None) -> str | None:
    """Normalised text of a file, or None."""
    if raw is None or len(raw) > MAX_FILE_BYTES or "\0" in name:
        return None
    reader = READERS.get(kind_of(name, raw))
    try:
        text = reader(raw) if reader else None
    except (ValueError, KeyError, StopIteration, IndexError, AttributeError, zipfile.BadZipFile, ElementTree.ParseError, csv.Error):
        return None
    return normalised(text) or None if text is not None else None


def document_texts(files: DataFrame, name: str = "path", content: str = "content") -> DataFrame:
    """SRC-01 to 17: ``text`` beside the columns of a frame of files, such as ``binaryFile`` gives; the content column goes."""

    @F.pandas_udf("string")
    def text(batches: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.Series]:
        for names, contents in batches:
            yield pd.Series([read_document(str(n), None if c is None else bytes(c)) for n, c in zip(names, contents, strict=True)], dtype=object)

    rows = files.where(F.octet_length(content) <= MAX_FILE_BYTES)
    return rows.select(*[c for c in files.columns if c != content], text(F.col(name), F.col(content)).alias("text"))


def unsafe_entry(name: Column) -> Column:
    """VAL-02 as a column."""
    return name.rlike(r"^[/\\]") | name.contains("\0") | name.rlike(r"^[A-Za-z]:") | F.exists(F.split(name, r"[/\\]"), lambda p: p == "..")


def unsafe_size(packed: Column, unpacked: Column) -> Column:
    return (unpacked > MAX_UNPACKED_BYTES) | ((packed > 0) & (unpacked / F.nullif(packed, F.lit(0)) > MAX_RATIO))
