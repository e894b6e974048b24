"""Registered readers of rich formats: small files made here, and the texts that they hold as SQL values."""

from __future__ import annotations

import io
import zipfile
import zlib

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from scriptorium.functions.dialect import DUCK
from scriptorium.plans.text_queries import Query
from scriptorium.sources import formats as X


def archive(**files: str) -> bytes:
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w", zipfile.ZIP_DEFLATED) as z:
        for name, text in files.items():
            z.writestr(name, text)
    return out.getvalue()


def pdf(*pages: bytes, packed: bool = True) -> bytes:
    parts = [b"%PDF-1.4\n"]
    for i, p in enumerate(pages):
        data = zlib.compress(p) if packed else p
        parts.append(b"%d 0 obj\n<< /Length %d%s >>\nstream\n%s\nendstream\nendobj\n" % (i + 1, len(data), b" /Filter /FlateDecode" if packed else b"", data))
    return b"".join([*parts, b"trailer\n<<>>\n%%EOF"])


W = 'xmlns:w="http://schemas.openxmlformats.org/wordprocessingml/2006/main"'
DOCX = archive(**{"word/document.xml": f'<w:document {W}><w:body><w:p><w:r><w:t>First</w:t><w:tab/><w:t>line</w:t></w:r></w:p><w:p><w:r><w:t xml:space="preserve">Second </w:t><w:br/><w:t>end</w:t></w:r></w:p></w:body></w:document>'})
ODT = archive(**{"content.xml": '<o:document xmlns:o="office" xmlns:t="text"><o:body><o:text><t:h>Head</t:h><t:p>One <t:span>two</t:span> three</t:p></o:text></o:body></o:document>'})
EPUB = archive(**{
    "META-INF/container.xml": '<container><rootfiles><rootfile full-path="OPS/book.opf"/></rootfiles></container>',
    "OPS/book.opf": '<package><manifest><item id="b" href="b.xhtml"/><item id="a" href="text/a.xhtml"/></manifest><spine><itemref idref="a"/><itemref idref="b"/></spine></package>',
    "OPS/text/a.xhtml": "<html><head><title>no</title></head><body><p>Chapter &amp; one</p></body></html>", "OPS/b.xhtml": "<html><body><p>Two</p><script>no()</script></body></html>",
})
MAIL = b"From: a@example.com\nSubject: no\nContent-Type: multipart/alternative; boundary=b\n\n--b\nContent-Type: text/html\n\n<p>html</p>\n--b\nContent-Type: text/plain\n\nPlain body\n--b--\n"
HTML_MAIL = b"Subject: no\nContent-Type: text/html; charset=utf-8\n\n<p>Only <b>html</b></p>\n"

#: Query, file name, content, and its text (None: no text can be read).
SAMPLES: list[tuple[str, str, bytes, str | None]] = [
    ("src_04", "a.txt", "\ufeffone\r\ntwo".encode(), "one\ntwo"), ("src_04", "b.txt", "drei ü".encode("utf-16"), "drei ü"), ("src_04", "c.txt", "caf\u00e9 \u201cx\u201d".encode("cp1252"), "café “x”"), ("src_04", "d.txt", b"", None),
    ("src_07", "a.pdf", pdf(b"BT /F1 12 Tf (Page one) Tj 0 -14 Td (next \\(line\\)) Tj ET", b"BT [(Wo) 20 (rd) -300 (two)] TJ ET"), "Page one\nnext (line)\n\nWord two"),
    ("src_07", "plain.pdf", pdf(b"BT (Caf\\351) Tj ET", packed=False), "Café"), ("src_07", "locked.pdf", pdf(b"BT (x) Tj ET") + b"<< /Encrypt 1 0 R >>", None), ("src_07", "image.pdf", pdf(b"q 1 0 0 1 0 0 cm Q"), None),
    ("src_08", "a.docx", DOCX, "First\tline\nSecond \nend"), ("src_08", "broken.docx", b"PK\x03\x04broken", None), ("src_09", "a.odt", ODT, "Head\nOne two three"), ("src_10", "a.epub", EPUB, "Chapter & one\n\nTwo"),
    ("src_11", "a.rtf", rb"{\rtf1\ansi{\fonttbl{\f0 Times;}}\f0 Hello \b bold\b0  {\i slant}\par caf\'e9 \u8211? \ldblquote x\rdblquote\line {\*\x{\info no}}\{end\}}", "Hello bold slant\ncafé – “x”\n{end}"),
    ("src_12", "a.tex", rb"""\documentclass{article}\usepackage[utf8]{inputenc} % comment
\begin{document}\section{Intro} Some \textbf{bold} and \emph{soft} text, 50\% off, $x^2$ here~now.
\begin{equation} a = b \end{equation}\begin{itemize}\item first\cite{k} \item second\end{itemize}\newcommand{\x}{hidden}\end{document}""", "Intro Some bold and soft text, 50% off,  here now.\n\n first\n second"),
    ("src_13", "a.eml", MAIL, "Plain body"), ("src_13", "b.eml", HTML_MAIL, "Only html"), ("src_14", "a.mbox", b"From x Mon\n" + HTML_MAIL + b"\nFrom y Tue\nSubject: t\n\nSecond\n", "Only html\n\n---\n\nSecond"),
    ("src_15_export", "a.json", b'{"messages": [{"id": 1, "content": " hi "}, {"text": ["a", {"type": "b", "text": "c"}]}, {"x": 1}]}', "hi\n\nac"), ("src_15_export", "b.json", b'[{"body": "one"}, {"full_text": "two"}, 3]', "one\n\ntwo"), ("src_15_export", "c.json", b'{"messages": []}', None), ("src_15_export", "d.json", b"{bad", None),
    ("src_16", "a.csv", b'date,Message Text,user\n1," hello, you ",a\n2,,b\n3,bye,c\n', "hello, you\n\nbye"), ("src_16", "b.csv", b"date,said\n1,last column\n", "last column"), ("src_16", "c.csv", b"one\n1\n", None),
    ("src_17_nfc", "a.txt", "e\u0301a\r\n\r\n\r\n\rb ".encode(), "\u00e9a\n\nb"),
]

ENTRIES = [("a/b.xml", 10, 900), ("../x", 1, 1), ("a/../../x", 1, 1), ("/etc/x", 1, 1), ("C:x", 1, 1), ("\\x", 1, 1), ("a..b", 1, 1), ("big", 1 << 20, 600 << 20), ("dense", 10, 1001), ("empty", 0, 0)]
UNSAFE = {"../x", "a/../../x", "/etc/x", "C:x", "\\x"}
BOMBS = {"big", "dense"}


def values(rows: list[tuple], names: str) -> str:
    spell = lambda v: "NULL" if v is None else ("true" if v else "false") if isinstance(v, bool) else str(v) if isinstance(v, int) else "replace(replace(" + DUCK.text(v.replace("\n", "\x1e").replace("\t", "\x1f")) + ", chr(30), chr(10)), chr(31), chr(9))"
    return f"SELECT * FROM (VALUES {', '.join('(' + ', '.join(map(spell, r)) + ')' for r in rows)}) AS t({names})"


def reading(key: str) -> tuple[Query, str]:
    mine = [s[1:] for s in SAMPLES if s[0] == key]

    def query(spark: SparkSession, sf_dir: str) -> DataFrame:
        return X.document_texts(spark.createDataFrame([(n, bytearray(c)) for n, c, _ in mine], "path string, content binary"))

    return query, values([(n, t) for n, _, t in mine], "path, text")


def entries(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = spark.createDataFrame(ENTRIES, "name string, packed long, unpacked long")
    return rows.select("name", X.unsafe_entry(F.col("name")).alias("unsafe"), F.coalesce(X.unsafe_size(F.col("packed"), F.col("unpacked")), F.lit(False)).alias("bomb"))


QUERIES: dict[str, tuple[Query, str | None]] = {key: reading(key) for key in dict.fromkeys(s[0] for s in SAMPLES)}
QUERIES["val_02"] = (entries, values([(n, n in UNSAFE, n in BOMBS) for n, *_ in ENTRIES], "name, unsafe, bomb"))
