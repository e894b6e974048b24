"""Registered research measurements, small lookups and manifests, with the SQL that checks each."""

from __future__ import annotations

from scriptorium.functions.dialect import DUCK
from scriptorium.operators import countermeasures as M
from scriptorium.operators import lookups as K
from scriptorium.operators import research as S
from scriptorium.plans.text_queries import Query, docs

SOURCE = "(SELECT doc_id, coalesce(text, '') AS text FROM documents)"


def sql(name: str) -> str:
    make, columns = S.REPORTS[name]
    return f"SELECT doc_id, {', '.join(f'{e} AS {k}' for k, e in columns(DUCK).items())} FROM {M.sql(make(DUCK), SOURCE)}"


def measured(name: str) -> tuple[Query, str]:
    return docs(lambda d: S.report(d, name)), sql(name)


def stated(statement: str) -> tuple[Query, str]:
    """A statement over literal rows that both engines run as it is."""
    return lambda spark, sf_dir: spark.sql(statement), statement


QUERIES: dict[str, tuple[Query, str | None]] = {
    "res_02": measured("tone"),
    "res_05": measured("argument"),
    "res_06": measured("construction"),
    "res_07": measured("first_language"),
    "res_08": measured("rewriting"),
    "pii_01": stated(K.INTEGRITY),
    "msc_10": stated(K.LABELS),
    "msc_13": stated(K.TRUTH),
    "src_20": stated(K.DATASETS),
    "acs_01_general": stated(K.CONFIDENCE),
    "srt_01": stated(K.SORTED),
}
