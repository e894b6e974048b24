"""Scores and lookups over small frames, as expressions that SQL engines share; the statements apply them to literal rows."""

from __future__ import annotations

from scriptorium.operators import register as R

#: PII-01: points for each piece of evidence of how a document was made; all that hold are added.
EVIDENCE = {
    "author IS NOT NULL": 5, "created IS NOT NULL": 5, "modified IS NOT NULL": 5, "revisions IS NOT NULL": 5, "tool IS NOT NULL": 5,
    "paragraphs >= 5": 8, "rsids >= 3": 7, "rsids * 1e0 / nullif(paragraphs, 0) > 0.1": 8, "settings_rsids > 0": 7,
    "default_font IS NOT NULL": 7, "runs > 0": 6, "consistency > 0": 7, "revisions > 1": 8, "total_minutes IS NOT NULL": 7, "velocity IS NOT NULL": 5, "span_hours IS NOT NULL": 5,
}
PROCESS_INTEGRITY = f"least({' + '.join(f'CASE WHEN {test} THEN {points} ELSE 0 END' for test, points in EVIDENCE.items())}, 100)"
INTEGRITY_LEVEL = "CASE WHEN score > 80 THEN 'Strong' WHEN score > 50 THEN 'Moderate' WHEN score > 20 THEN 'Limited' ELSE 'Insufficient' END"
_FILES = "(VALUES (1, 'Ann', '2024-01-01', '2024-01-02', 12, 'Writer', 40, 9, 4, 'Times', 80, 0.9, 55.0, 14.0, 24.0), (2, 'Ann', '2024-01-01', NULL, 1, NULL, 4, 1, 0, NULL, 4, 0.0, NULL, NULL, NULL), (3, NULL, NULL, NULL, NULL, NULL, NULL, NULL, NULL, NULL, NULL, NULL, NULL, NULL, NULL), (4, NULL, '2024-01-01', '2024-01-02', 3, 'Writer', 60, 2, 0, 'Times', 9, 0.5, NULL, NULL, 24.0)) AS t(file_id, author, created, modified, revisions, tool, paragraphs, rsids, settings_rsids, default_font, runs, consistency, total_minutes, velocity, span_hours)"
INTEGRITY = f"SELECT file_id, CAST(score AS INT) AS score, {INTEGRITY_LEVEL} AS level FROM (SELECT file_id, {PROCESS_INTEGRITY} AS score FROM {_FILES}) AS s"

#: ACS-01 with evidence of every kind.
CONFIDENCE = f"SELECT case_id, round(CAST({R.acs('forensics', 'stylometric', 'text_score')} AS DOUBLE), 4) AS acs, CAST({R.margin('forensics', 'stylometric', 'text_score')} AS DOUBLE) AS margin FROM (VALUES (1, 80.0, 60.0, 70.0), (2, 80.0, NULL, 70.0), (3, NULL, 60.0, 70.0), (4, NULL, NULL, 70.0), (5, 20.0, 10.0, 0.0)) AS t(case_id, forensics, stylometric, text_score)"

#: MSC-10: label and colour of a metric's assessment.
ASSESSMENT = "CASE WHEN abs(z) <= 1 THEN 'expected' WHEN abs(z) <= 2 THEN 'atypical' ELSE 'anomalous' END"
COLOUR = "CASE WHEN abs(z) <= 1 THEN 'blue' WHEN abs(z) <= 2 THEN 'yellow' ELSE 'red' END"
LABELS = f"SELECT id, {ASSESSMENT} AS label, {COLOUR} AS colour FROM (VALUES (1, 0.4), (2, -1.0), (3, 1.5), (4, -2.0), (5, 3.1)) AS t(id, z)"

#: MSC-13: ground truth from a path, else from the label beside it.
ORIGIN = "CASE WHEN lower(path) LIKE '%/ai/%' OR contains(lower(path), '_ai_') THEN 'ai' WHEN lower(path) LIKE '%/human/%' OR contains(lower(path), '_human_') THEN 'human' WHEN label IS NULL THEN 'unknown' WHEN label = 'ai' THEN 'ai' ELSE 'human' END"
TRUTH = f"SELECT path, {ORIGIN} AS origin FROM (VALUES ('/x/ai/a.txt', 'human'), ('/x/AI/b.txt', NULL), ('/x/human/c.txt', 'ai'), ('/x/set_ai_1.txt', NULL), ('/x/set_human_1.txt', NULL), ('/x/d.txt', 'ai'), ('/x/e.txt', 'human'), ('/x/aide.txt', NULL)) AS t(path, label)"

#: SRC-20: the layout of a labelled table, from its column names, spelled as ',a,b,'.
LAYOUT = "CASE WHEN contains(c, ',text,') AND contains(c, ',label,') AND contains(c, ',source,') THEN 'daigt_v2' WHEN contains(c, ',text,') AND contains(c, ',label,') THEN 'generic' WHEN contains(c, ',text,') AND contains(c, ',generated,') THEN 'generated_flag' WHEN contains(c, ',human_text,') OR contains(c, ',ai_text,') THEN 'paired' ELSE 'unknown' END"
DATASETS = f"SELECT id, {LAYOUT} AS layout FROM (SELECT id, replace(lower(concat(',', columns, ',')), ',', ',') AS c FROM (VALUES (1, 'Text,label,source,prompt'), (2, 'label,text'), (3, 'text,generated'), (4, 'human_text,id'), (5, 'a,ai_text'), (6, 'body')) AS t(id, columns)) AS s"

#: SRT-01: flags by severity, then place.
SORTED = "SELECT CAST(row_number() OVER (ORDER BY CASE severity WHEN 'high' THEN 0 WHEN 'medium' THEN 1 ELSE 2 END, place) AS INT) AS nth, severity, place FROM (VALUES ('low', 1), ('high', 9), ('medium', 3), ('high', 2), ('low', 0)) AS t(severity, place)"
