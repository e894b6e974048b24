"""Metrics, flags and history of writing sessions, as SQL over capture events.

Events have document_id, session_id, seq, elapsed_ms, event_type and text_length. The statements use only what SQL engines share, so the
same text runs here and in the database that checks it.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Gaps that count as typing; keys and gaps that timing needs; fast gaps and pauses.
GAP_MS, KEYS, GAPS, FAST_MS, PAUSE_MS = 30_000, 10, 5, 50, 5_000
#: The ``events`` table stands in: a user's document is written in two sessions a month, four hours of the table are a second.
KINDS = "CASE event_type WHEN 'click' THEN 'keystroke' WHEN 'view' THEN 'keystroke' WHEN 'purchase' THEN 'paste' WHEN 'signup' THEN 'save' ELSE CASE WHEN value < 20 THEN 'undo' WHEN value < 40 THEN 'delete' WHEN value < 60 THEN 'focus_loss' ELSE 'ai_accepted' END END"
SCALE = 14400


def as_capture(events: DataFrame) -> DataFrame:
    elapsed = F.expr(f"unix_millis(cast(ts as timestamp)) div {SCALE}")
    return events.select(F.col("user_id").alias("document_id"), F.concat(F.date_format("ts", "yyyy-MM-"), F.when(F.dayofmonth("ts") < 16, "a").otherwise("b")).alias("session_id"), F.col("event_id").alias("seq"), elapsed.alias("elapsed_ms"), F.expr(KINDS).alias("event_type"), F.floor("value").cast("long").alias("text_length"))


CAPTURE_SQL = f"(SELECT user_id AS document_id, strftime(CAST(ts AS TIMESTAMP), '%Y-%m-') || CASE WHEN day(CAST(ts AS TIMESTAMP)) < 16 THEN 'a' ELSE 'b' END AS session_id, event_id AS seq, (epoch_us(CAST(ts AS TIMESTAMP)) // 1000) // {SCALE} AS elapsed_ms, {KINDS} AS event_type, CAST(floor(value) AS BIGINT) AS text_length FROM events)"

COUNTS = ", ".join(f"count(*) FILTER (WHERE event_type = '{k}') AS {n}" for k, n in (("keystroke", "keys"), ("paste", "pastes"), ("save", "saves"), ("undo", "undos"), ("delete", "deletes"), ("focus_loss", "focus_losses"), ("ai_accepted", "ai_accepted")))
CHARS = ", ".join(f"coalesce(sum(text_length) FILTER (WHERE event_type = '{k}'), 0) AS {n}" for k, n in (("keystroke", "typed"), ("paste", "pasted"), ("ai_accepted", "ai_chars")))
SESSIONS = f"(SELECT document_id, session_id, count(*) AS events, {COUNTS}, {CHARS}, coalesce(max(text_length) FILTER (WHERE event_type = 'paste'), 0) AS largest_paste, max(elapsed_ms) - min(elapsed_ms) AS duration_ms FROM {{capture}} GROUP BY document_id, session_id)"
HISTORIES = f"(SELECT document_id, count(*) AS sessions, {', '.join(f'sum({c}) AS {c}' for c in ('events', 'keys', 'pastes', 'saves', 'undos', 'deletes', 'focus_losses', 'ai_accepted', 'typed', 'pasted', 'ai_chars', 'duration_ms'))}, max(largest_paste) AS largest_paste FROM {SESSIONS} GROUP BY document_id)"
RATIO = "CASE WHEN {b} > 0 THEN {a} * 1e0 / {b} ELSE 0e0 END"
METRICS = {
    "minutes": "duration_ms / 60000e0",
    "typing_speed": RATIO.format(a="typed", b="(duration_ms / 60000e0)"),
    "paste_ratio": RATIO.format(a="pasted", b="(typed + pasted)"),
    "ai_ratio": RATIO.format(a="ai_chars", b="(typed + pasted)"),
    "undo_rate": RATIO.format(a="undos * 1000", b="typed"),
    "revision_intensity": RATIO.format(a="(undos + deletes) * 1000", b="typed"),
    "focus_loss_per_hour": RATIO.format(a="focus_losses", b="(duration_ms / 3600000e0)"),
}
FLAGS = [
    ("high_paste_ratio", "paste_ratio > 0.50", "CASE WHEN paste_ratio > 0.80 THEN 'high' ELSE 'medium' END"), ("bulk_paste", "largest_paste > 500", "CASE WHEN largest_paste > 2000 THEN 'high' ELSE 'medium' END"),
    ("unrealistic_speed", "typing_speed > 800 AND minutes > 1", "'high'"), ("high_ai_usage", "ai_ratio > 0.20", "CASE WHEN ai_ratio > 0.50 THEN 'high' ELSE 'medium' END"),
    ("insufficient_time", "typed + pasted > 1000 AND minutes < 5", "'medium'"), ("no_revision", "typed + pasted > 500 AND revision_intensity < 1 AND minutes > 10", "'low'"), ("uniform_timing", "cv < 0.15 AND mean_ms < 200", "'high'"),
]
CONFIDENCE = "least(least(events / 100e0, 0.3e0) + least(duration_ms / 60000e0 / 30e0, 0.3e0) + CASE WHEN keys > 0 THEN 0.2e0 ELSE 0e0 END + CASE WHEN saves > 0 THEN 0.1e0 ELSE 0e0 END, 1e0)"


def measured(source: str) -> str:
    return f"(SELECT *, {', '.join(f'{e} AS {k}' for k, e in METRICS.items())} FROM {source})"


GAPS_SQL = "(SELECT document_id, session_id, elapsed_ms - lag(elapsed_ms) OVER (PARTITION BY document_id, session_id ORDER BY elapsed_ms, seq) AS gap, count(*) OVER (PARTITION BY document_id, session_id) AS keys FROM {capture} WHERE event_type = 'keystroke')"
RANKED = f"(SELECT document_id, session_id, gap, count(*) OVER (PARTITION BY document_id, session_id) AS gaps, row_number() OVER (PARTITION BY document_id, session_id ORDER BY gap) AS r FROM {GAPS_SQL} AS g WHERE keys >= {KEYS} AND gap > 0 AND gap < {GAP_MS})"
#: STR-02, AGG-07: timing of a session's keystrokes, with the upper median.
TIMING = f"(SELECT document_id, session_id, count(*) AS gaps, avg(gap) AS mean_ms, max(CASE WHEN r = floor(gaps / 2) + 1 THEN gap END) AS median_ms, stddev_pop(gap) AS sd_ms, stddev_pop(gap) / avg(gap) AS cv, avg(CASE WHEN gap < {FAST_MS} THEN 1e0 ELSE 0e0 END) AS fast, avg(CASE WHEN gap > {PAUSE_MS} THEN 1e0 ELSE 0e0 END) AS pauses FROM {RANKED} AS k GROUP BY document_id, session_id HAVING count(*) >= {GAPS})"
ROUNDED = ", ".join(f"round({m}, 5) AS {m}" for m in METRICS)
SESSION_METRICS = f"SELECT document_id, session_id, events, typed, pasted, pastes, largest_paste, ai_accepted, {ROUNDED}, round({CONFIDENCE}, 5) AS confidence FROM {measured(SESSIONS)} AS m"
HISTORY_METRICS = f"SELECT document_id, sessions, typed, pasted, pastes, largest_paste, ai_accepted, {ROUNDED}, round(minutes / sessions, 5) AS avg_session_minutes, round(CASE WHEN sessions = 1 THEN {CONFIDENCE} ELSE least(sessions * 0.1e0 + minutes * 0.01e0, 1e0) END, 5) AS confidence FROM {measured(HISTORIES)} AS m"
HISTORY_SUMMARY = f"SELECT document_id, sessions, events, duration_ms, typed, pasted, round({METRICS['paste_ratio']}, 6) AS paste_ratio, ai_accepted, saves, pastes, undos, focus_losses FROM {HISTORIES} AS h"
TIMINGS = f"SELECT document_id, session_id, gaps, round(mean_ms, 5) AS mean_ms, median_ms, round(sd_ms, 5) AS sd_ms, round(cv, 5) AS cv, round(fast, 5) AS fast, round(pauses, 5) AS pauses FROM {TIMING} AS t"
_MEASURED = f"(SELECT m.*, t.cv, t.mean_ms FROM {measured(SESSIONS)} AS m LEFT JOIN {TIMING} AS t ON m.document_id = t.document_id AND m.session_id = t.session_id)"
SESSION_FLAGS = " UNION ALL ".join(f"SELECT document_id, session_id, '{name}' AS flag, {severity} AS severity FROM {_MEASURED} AS f WHERE {test}" for name, test, severity in FLAGS)


def run(statement: str, capture: DataFrame) -> DataFrame:
    return capture.sparkSession.sql(statement, capture=capture)
