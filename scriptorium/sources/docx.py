"""How a DOCX file was made: its paragraphs with revision ids, its runs with their formatting, and what follows from them.

A kernel takes paragraphs and runs from the files' bytes; everything else is SQL over these rows that engines share.
"""

from __future__ import annotations

import re
import zipfile
from collections.abc import Iterator
from xml.etree import ElementTree

import pandas as pd
from pyspark.sql import DataFrame

from scriptorium.sources.formats import Archive, local

PARAGRAPHS = "file_id long, i long, rsid string, heading boolean, words long, font string, size long"
PROPERTIES = "file_id long, author string, created string, modified string, revisions long, tool string, total_minutes double, word_count double, settings_rsids array<string>"


def _value(e: ElementTree.Element | None, name: str = "val") -> str | None:
    return None if e is None else next((v for k, v in e.attrib.items() if k.rpartition("}")[2] == name), None)


def _child(e: ElementTree.Element, *path: str) -> ElementTree.Element | None:
    found: ElementTree.Element | None = e
    for name in path:
        found = None if found is None else next((c for c in found if local(c) == name), None)
    return found


def paragraphs_of(raw: bytes) -> list[tuple]:
    """DOC-01, 03, 04: (i, rsid, heading, words, font, size) of each run, or of a paragraph without any; font and size where overridden."""
    out = []
    body = Archive(raw).xml("word/document.xml")
    for i, p in enumerate(e for e in body.iter() if local(e) == "p"):
        rsid = _value(p, "rsidR") or _value(p, "rsidRDefault")
        heading = (_value(_child(p, "pPr", "pStyle")) or "").lower().startswith("heading")
        runs = [e for e in p.iter() if local(e) == "r"]
        for r in runs:
            words = len("".join(t.text or "" for t in r.iter() if local(t) == "t").split())
            fonts, size = _child(r, "rPr", "rFonts"), _value(_child(r, "rPr", "sz"))
            out.append((i, rsid, heading, words, _value(fonts, "ascii") or _value(fonts, "hAnsi"), int(size) if size else None))
        if not runs:
            out.append((i, rsid, heading, 0, None, None))
    return out


def properties_of(raw: bytes) -> tuple:
    """FOR-03, SET-06: properties of the core and application parts, and the settings' revision ids in order, each once."""
    archive = Archive(raw)
    names = set(archive.zip.namelist())
    texts: dict[str, str] = {}
    for part in ("docProps/core.xml", "docProps/app.xml"):
        if part in names:
            texts |= {local(e): (e.text or "").strip() for e in archive.xml(part).iter() if (e.text or "").strip()}
    settings = archive.read("word/settings.xml").decode("utf-8", "replace") if "word/settings.xml" in names else ""
    rsids = list(dict.fromkeys(re.findall(r"<w:rsid(?:Root)? w:val=\"([0-9A-Fa-f]+)\"", settings)))
    number = lambda k, kind: kind(texts[k]) if re.fullmatch(r"[0-9]+", texts.get(k, "")) else None
    return (texts.get("creator"), texts.get("created"), texts.get("modified"), number("revision", int), texts.get("Application"), number("TotalTime", float), number("Words", float), rsids)


def _rows(files: DataFrame, take, schema: str) -> DataFrame:
    columns = [c.split()[0] for c in schema.split(", ")]

    def apply(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            out: list[tuple] = []
            for file_id, content in zip(batch["file_id"], batch["content"], strict=True):
                try:
                    out += [(file_id, *row) for row in take(bytes(content))]
                except (ValueError, KeyError, zipfile.BadZipFile, ElementTree.ParseError):
                    continue
            yield pd.DataFrame(out, columns=columns).astype(object)

    return files.select("file_id", "content").mapInPandas(apply, schema)


def paragraphs(files: DataFrame) -> DataFrame:
    """DOC-01: all runs of a frame of files (file_id, content); unreadable files have none."""
    return _rows(files, paragraphs_of, PARAGRAPHS)


def properties(files: DataFrame) -> DataFrame:
    return _rows(files, lambda raw: [properties_of(raw)], PROPERTIES)


# -- statements over the rows ----------------------------------------------------------------------------------------------
ONE = "(SELECT file_id, i, max(rsid) AS rsid, bool_or(heading) AS heading, CAST(sum(words) AS BIGINT) AS words FROM {runs} AS r0 GROUP BY file_id, i)"
BY = "(PARTITION BY file_id ORDER BY i)"
BLOCKS = f"(SELECT file_id, rsid, block, min(i) AS first_paragraph, max(i) AS last_paragraph, count(*) AS size FROM (SELECT *, sum(new) OVER (PARTITION BY file_id ORDER BY i ROWS UNBOUNDED PRECEDING) AS block FROM (SELECT *, CASE WHEN rsid = lag(rsid) OVER {BY} THEN 0 ELSE 1 END AS new FROM {ONE} AS p) AS n) AS b WHERE rsid IS NOT NULL GROUP BY file_id, rsid, block)"
#: DOC-02, WIN-05: paste events are blocks of five paragraphs or more; anomalous ones are over ten and twice the mean block.
PASTES = f"SELECT file_id, rsid, first_paragraph, last_paragraph, size, size >= 10 AND size > 2 * mean_size AS anomalous FROM (SELECT *, avg(size) OVER (PARTITION BY file_id) AS mean_size FROM {BLOCKS} AS k) AS m WHERE size >= 5"
_RANKS = f"(SELECT file_id, rank() OVER (PARTITION BY file_id ORDER BY i) * 1e0 AS p, rank() OVER (PARTITION BY file_id ORDER BY upper(lpad(rsid, 16, '0'))) + (count(*) OVER (PARTITION BY file_id, rsid) - 1) / 2e0 AS v FROM {ONE} AS p1 WHERE rsid IS NOT NULL)"
_RHO = f"(SELECT file_id, CASE WHEN count(*) >= 3 THEN 1 - 6 * sum((p - v) * (p - v)) / (count(*) * (count(*) * count(*) - 1e0)) END AS rho FROM {_RANKS} AS rk GROUP BY file_id)"
_SCATTER = f"(SELECT file_id, count(*) AS paragraphs, count(DISTINCT rsid) AS rsids, avg(CASE WHEN differs THEN 1e0 ELSE 0e0 END) AS scatter FROM (SELECT file_id, rsid, (n > 1 AND coalesce(rsid, '') <> coalesce(before, '') AND i > 0) OR (n > 1 AND i < n - 1 AND coalesce(rsid, '') <> coalesce(after, '')) AS differs FROM (SELECT *, lag(rsid) OVER {BY} AS before, lead(rsid) OVER {BY} AS after, count(*) OVER (PARTITION BY file_id) AS n FROM {ONE} AS p2) AS q) AS d GROUP BY file_id)"
_LARGEST = f"(SELECT file_id, max(size) AS largest FROM {BLOCKS} AS k2 GROUP BY file_id)"
REVISIONS_ALL = f"(SELECT s.file_id, s.paragraphs, s.rsids, s.rsids * 1e0 / s.paragraphs AS diversity, s.scatter, coalesce(l.largest, 0) AS largest, r.rho FROM {_SCATTER} AS s LEFT JOIN {_LARGEST} AS l ON l.file_id = s.file_id LEFT JOIN {_RHO} AS r ON r.file_id = s.file_id)"
#: DOC-02, AGG-09: diversity, scatter and progression of the revision ids.
REVISIONS = f"SELECT file_id, paragraphs, rsids, largest, round(diversity, 5) AS diversity, round(scatter, 5) AS scatter, round(rho, 5) AS progression, CASE WHEN paragraphs >= 5 AND diversity < 0.05 THEN 'high' WHEN paragraphs >= 5 AND diversity < 0.15 THEN 'medium' ELSE 'none' END AS low_diversity FROM {REVISIONS_ALL} AS v"
_MOST = lambda c: f"(SELECT file_id, {c} FROM (SELECT file_id, {c}, row_number() OVER (PARTITION BY file_id ORDER BY count(*) DESC, {c}) AS nth FROM {{runs}} AS r1 WHERE {c} IS NOT NULL GROUP BY file_id, {c}) AS c1 WHERE nth = 1)"
_FORMATS = f"(SELECT r.file_id, r.i, (r.font IS NULL OR f.font IS NULL OR r.font = f.font) AND (r.size IS NULL OR z.size IS NULL OR r.size = z.size) AS fits FROM {{runs}} AS r LEFT JOIN {_MOST('font')} AS f ON f.file_id = r.file_id LEFT JOIN {_MOST('size')} AS z ON z.file_id = r.file_id)"
#: DOC-03, AGG-12: share of runs in the most common font and size.
CONSISTENCY = f"(SELECT file_id, count(*) AS runs, avg(CASE WHEN fits THEN 1e0 ELSE 0e0 END) AS consistency FROM {_FORMATS} AS t GROUP BY file_id)"
#: DOC-03, WIN-06: clusters of paragraphs with other formatting, at most two apart.
CLUSTERS = f"SELECT file_id, min(i) AS first_paragraph, max(i) AS last_paragraph FROM (SELECT *, sum(new) OVER (PARTITION BY file_id ORDER BY i ROWS UNBOUNDED PRECEDING) AS cluster FROM (SELECT file_id, i, CASE WHEN i <= lag(i) OVER {BY} + 2 THEN 0 ELSE 1 END AS new FROM (SELECT DISTINCT file_id, i FROM {_FORMATS} AS t2 WHERE NOT fits) AS o) AS c) AS s GROUP BY file_id, cluster"
_SECTIONS = f"(SELECT file_id, section, sum(words) AS words FROM (SELECT file_id, words, sum(CASE WHEN heading THEN 1 ELSE 0 END) OVER (PARTITION BY file_id ORDER BY i ROWS UNBOUNDED PRECEDING) AS section FROM {ONE} AS p3) AS s1 GROUP BY file_id, section HAVING sum(words) > 0)"
_SECTION_CV = f"(SELECT file_id, count(*) AS sections, CASE WHEN count(*) > 1 THEN stddev_samp(words) / avg(words) ELSE 0e0 END AS section_cv FROM {_SECTIONS} AS s2 GROUP BY file_id)"
_EMPTY = f"(SELECT file_id, count(*) AS empty_runs FROM (SELECT file_id, i - place AS grp FROM (SELECT file_id, i, row_number() OVER {BY} AS place FROM {ONE} AS p4 WHERE words = 0) AS e GROUP BY file_id, i - place HAVING count(*) >= 2) AS g GROUP BY file_id)"
#: DOC-04: paragraphs, sections and runs of empty paragraphs.
STRUCTURE = f"SELECT p.file_id, count(*) AS paragraphs, count(*) FILTER (WHERE words > 0) AS filled, round(coalesce(avg(words) FILTER (WHERE words > 0), 0e0), 5) AS mean_words, round(CASE WHEN count(*) FILTER (WHERE words > 0) > 1 THEN stddev_samp(words) FILTER (WHERE words > 0) / avg(words) FILTER (WHERE words > 0) ELSE 0e0 END, 5) AS cv, coalesce(max(s.sections), 0) AS sections, round(coalesce(max(s.section_cv), 0e0), 5) AS section_cv, coalesce(max(e.empty_runs), 0) AS empty_runs FROM {ONE} AS p LEFT JOIN {_SECTION_CV} AS s ON s.file_id = p.file_id LEFT JOIN {_EMPTY} AS e ON e.file_id = p.file_id GROUP BY p.file_id"
#: DOC-05: how the file was built.
PATTERN = f"SELECT v.file_id, round(c.consistency, 5) AS consistency, CASE WHEN paragraphs < 5 THEN 'insufficient' WHEN diversity > 0.15 AND scatter > 0.30 AND consistency > 0.8 THEN 'organic' WHEN diversity <= 0.05 AND largest * 1e0 / paragraphs > 0.5 THEN 'bulk insertion' ELSE 'hybrid' END AS pattern FROM {REVISIONS_ALL} AS v JOIN {CONSISTENCY} AS c ON c.file_id = v.file_id"
STATEMENTS = {"doc_02": REVISIONS, "doc_02_pastes": PASTES, "doc_03": CLUSTERS, "doc_04": STRUCTURE, "doc_05": PATTERN}
