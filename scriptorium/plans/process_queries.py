"""Registered queries of the writing process; their SQL is the statement that they run."""

from __future__ import annotations

from pyspark.sql import functions as F

from scriptorium.operators import process as P
from scriptorium.plans.text_queries import Query, on

WIDE = {"document_id", "session_id", "flag", "severity", "paste_ratio", "mean_ms", "sd_ms", "cv", "fast", "pauses", "confidence", "avg_session_minutes", *P.METRICS}


def process(statement: str) -> tuple[Query, str]:
    def rows(events):
        made = P.run(statement, P.as_capture(events))
        return made.select(*[F.col(c) if c in WIDE else F.col(c).cast("long").alias(c) for c in made.columns])

    return on("events", rows), statement.format(capture=P.CAPTURE_SQL)


def cast(statement: str, *names: str) -> str:
    """The database sums whole numbers wider."""
    return f"SELECT * REPLACE ({', '.join(f'CAST({n} AS BIGINT) AS {n}' for n in names)}) FROM ({statement})"


CHARS = ("typed", "pasted")
QUERIES: dict[str, tuple[Query, str | None]] = {}
for _key, _statement, _names in (
    ("str_02_timing", P.TIMINGS, ("median_ms",)), ("str_03", P.SESSION_METRICS, CHARS), ("str_03_history", P.HISTORY_METRICS, (*CHARS, "pastes", "ai_accepted")), ("str_04_flags", P.SESSION_FLAGS, ()),
    ("str_07", P.HISTORY_SUMMARY, ("events", "duration_ms", *CHARS, "ai_accepted", "saves", "pastes", "undos", "focus_losses")),
):
    _query, _sql = process(_statement)
    QUERIES[_key] = (_query, cast(_sql, *_names) if _names else _sql)
