"""Registered forensics of DOCX files made here from a rule, with their rows as SQL values."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from scriptorium.plans.format_queries import W, archive, values
from scriptorium.plans.text_queries import Query
from scriptorium.sources import docx as D

#: file: (paragraph, rsid, heading, words, font, size) of every run.
RUNS: dict[int, list[tuple]] = {
    1: [(i, f"00A{i // 2:05X}", i % 8 == 0, 3 + i * 5 % 11, None, None) for i in range(24)],
    2: [(i, "00B00001" if i < 18 else f"00B000{i:02d}", i in (0, 12), 0 if i in (5, 6, 20) else 9 + i % 4, "Arial" if i in (3, 4, 9) else "Times", 28 if i == 4 else 24) for i in range(22)],
    3: [(i, "00C00001", False, 12, "Times", 24) for i in range(40)],
    4: [(0, None, False, 4, None, None), (1, "00D00001", True, 2, None, None), (1, "00D00001", True, 5, "Arial", None)],
}


def made(runs: list[tuple]) -> bytes:
    body, last = [], None
    for i, rsid, heading, words, font, size in runs:
        look = (f'<w:rFonts w:ascii="{font}"/>' if font else "") + (f'<w:sz w:val="{size}"/>' if size else "")
        run = f"<w:r><w:rPr>{look}</w:rPr><w:t>{' '.join(['word'] * words)}</w:t></w:r>"
        if i == last:
            body[-1] = body[-1].removesuffix("</w:p>") + run + "</w:p>"
        else:
            style = '<w:pPr><w:pStyle w:val="Heading1"/></w:pPr>' if heading else ""
            body.append(f'<w:p{f" w:rsidR=\"{rsid}\"" if rsid else ""}>{style}{run}</w:p>')
        last = i
    rsids = dict.fromkeys(r[1] for r in runs if r[1])
    core = '<c:coreProperties xmlns:c="c" xmlns:d="d"><d:creator>Ann</d:creator><d:created>2024-01-01T00:00:00Z</d:created><c:revision>7</c:revision></c:coreProperties>'
    app = "<Properties><Application>Writer</Application><TotalTime>90</TotalTime><Words>300</Words></Properties>"
    settings = f"<w:settings {W}><w:rsids>{''.join(f'<w:rsid w:val=\"{r}\"/>' for r in [*rsids, *rsids])}</w:rsids></w:settings>"
    return archive(**{"word/document.xml": f"<w:document {W}><w:body>{''.join(body)}</w:body></w:document>", "docProps/core.xml": core, "docProps/app.xml": app, "word/settings.xml": settings})


def files(spark: SparkSession) -> DataFrame:
    rows = [(k, bytearray(made(v))) for k, v in RUNS.items()] + [(9, bytearray(b"PK\x03\x04 broken"))]
    return spark.createDataFrame(rows, "file_id long, content binary")


VALUES = values([(k, *row) for k, rows in RUNS.items() for row in rows], "file_id, i, rsid, heading, words, font, size")
TYPED = f"(SELECT CAST(file_id AS BIGINT) AS file_id, CAST(i AS BIGINT) AS i, rsid, heading, CAST(words AS BIGINT) AS words, font, CAST(size AS BIGINT) AS size FROM ({VALUES}))"


def stated(statement: str) -> tuple[Query, str]:
    return lambda spark, sf_dir: spark.sql(statement, runs=D.paragraphs(files(spark))), statement.format(runs=TYPED)


def properties(spark: SparkSession, sf_dir: str) -> DataFrame:
    return D.properties(files(spark)).withColumn("settings_rsids", F.array_join("settings_rsids", ","))


QUERIES: dict[str, tuple[Query, str | None]] = {
    "doc_01": (lambda spark, sf_dir: D.paragraphs(files(spark)).withColumn("size", F.coalesce("size", F.lit(0))), f"SELECT * REPLACE (coalesce(size, 0) AS size) FROM {TYPED}"),
    "for_03": (properties, f"SELECT file_id, 'Ann' AS author, '2024-01-01T00:00:00Z' AS created, CAST(NULL AS VARCHAR) AS modified, CAST(7 AS BIGINT) AS revisions, 'Writer' AS tool, 90.0::DOUBLE AS total_minutes, 300.0::DOUBLE AS word_count, string_agg(rsid, ',' ORDER BY i) AS settings_rsids FROM (SELECT file_id, rsid, min(i) AS i FROM {TYPED} WHERE rsid IS NOT NULL GROUP BY 1, 2) GROUP BY 1"),
    **{key: stated(statement) for key, statement in D.STATEMENTS.items()},
}
