"""Registered round trips through files, manifests and certificates, with the SQL that checks each."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from scriptorium.functions.dialect import DUCK
from scriptorium.operators import countermeasures as M
from scriptorium.operators import identity as I
from scriptorium.operators import process as P
from scriptorium.plans import identity_queries as N
from scriptorium.plans.format_queries import values
from scriptorium.plans.text_queries import Query
from scriptorium.session import fresh_path, table
from scriptorium.sources import records as X

WORDS = f"len({M.ws(DUCK, 'text')})"
SESSIONS = [
    '{"session_id": "b", "document_name": "d", "source": "editor", "started_at": "2024-01-02", "events": [{"seq": 1, "elapsed_ms": 0, "event_type": "Keystroke", "text_length": 1}, {"seq": 2, "elapsed_ms": 400, "event_type": "Paste", "text_length": 2500, "position": {"paragraph": 0, "offset": 1}}]}',
    '{"session_id": "a",\n "document_name": "d", "source": "editor", "started_at": "2024-01-01", "events": [{"seq": 1, "elapsed_ms": 100, "event_type": "keystroke", "text_length": 3}]}',
    '{"no": "session"}', "{broken", '{"session_id": "c", "document_name": "e", "started_at": "2024-01-03", "events": []}',
]
MANIFESTS = [(1, '<P>\n<Title> A novel </Title>\n  <BinderItem ID="3" Type="Text">\n  <BinderItem UUID="x" ID="A-7">\n</P>', "A novel", "3,x"), (2, "<P></P>", "Untitled", ""), (3, '<Title></Title><BinderItem ID="no">', "", "")]


def training(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = fresh_path(spark, "records")
    docs = table(spark, sf_dir, "documents")
    records = X.training_records(docs, F.lit("human"), F.coalesce("lang", F.lit("")))
    half = F.col("doc_id") % 2 == 0
    X.append_records(X.training_records(docs.where(half), F.lit("human"), F.coalesce("lang", F.lit(""))), path)
    X.append_records(X.training_records(docs.where(~half), F.lit("human"), F.coalesce("lang", F.lit(""))), path)
    return X.read_records(spark, path).select(*records.columns).groupBy("label", "source", "register").agg(F.count(F.lit(1)).alias("n"), F.sum("word_count").alias("words"), F.sum(F.octet_length("text")).alias("bytes"))


def exported(kind: str) -> Query:
    def query(spark: SparkSession, sf_dir: str) -> DataFrame:
        path, rows = fresh_path(spark, f"export-{kind}"), I.author_profiles(table(spark, sf_dir, "documents"))
        X.export(rows, path, kind)
        reader = spark.read.schema(rows.schema)
        return reader.option("header", "true").csv(path) if kind == "csv" else reader.json(path)

    return query


def sessions(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = fresh_path(spark, "sessions")
    for i, text in enumerate(SESSIONS):
        spark.createDataFrame([(text,)], "value string").coalesce(1).write.text(f"{path}/{i}")
    return X.session_events(X.read_sessions(spark, f"{path}/*"))


def manifests(spark: SparkSession, sf_dir: str) -> DataFrame:
    title, ids = X.manifest(F.col("xml"))
    return spark.createDataFrame([m[:2] for m in MANIFESTS], "id long, xml string").select("id", title.alias("title"), F.array_join(ids, ",").alias("items"))


def certified(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Certificates of all documents, checked against documents of which one in three ids lost its last character."""
    docs = table(spark, sf_dir, "documents")
    later = docs.withColumn("text", F.when(F.col("doc_id") % 3 == 0, F.expr("left(text, length(text) - 1)")).otherwise(F.col("text")))
    made = X.certificates(docs)
    return made.select("doc_id", "root").join(X.verified(made, later), "doc_id")


LEAF = lambda k, v: f"sha256('{k}:' || {v})"
ROOT = f"sha256(sha256({LEAF('file_hash', 'sha256(text)')} || {LEAF('file_size', 'strlen(text)')}) || sha256({LEAF('word_count', WORDS)} || {LEAF('source', "coalesce(source, '')")}))"
PROFILES = f"SELECT who AS author, documents, {', '.join(f'e_{c} AS {c}' for c in I.COMPARED)} FROM {N.PROFILES}"

QUERIES: dict[str, tuple[Query, str | None]] = {
    "src_18": (training, f"SELECT 'human' AS label, source, coalesce(lang, '') AS register, count(*) AS n, CAST(sum({WORDS.replace('text', 't')}) AS BIGINT) AS words, CAST(sum(strlen(t)) AS BIGINT) AS bytes FROM (SELECT source, lang, trim(coalesce(text, ''), ' ') AS t FROM documents) GROUP BY ALL"),
    "src_21": (sessions, values([("d", "b", 1, 0, "keystroke", 1), ("d", "b", 2, 400, "paste", 2500), ("d", "a", 1, 100, "keystroke", 3)], "document_id, session_id, seq, elapsed_ms, event_type, text_length").replace("SELECT *", "SELECT document_id, session_id, CAST(seq AS BIGINT) AS seq, CAST(elapsed_ms AS BIGINT) AS elapsed_ms, event_type, CAST(text_length AS BIGINT) AS text_length", 1)),
    "str_03_sessions": (lambda spark, sf: P.run("SELECT document_id, session_id, CAST(typed AS BIGINT) AS typed, CAST(pasted AS BIGINT) AS pasted, largest_paste FROM " + P.SESSIONS + " AS s", sessions(spark, sf)), values([("d", "a", 3, 0, 0), ("d", "b", 1, 2500, 2500)], "document_id, session_id, typed, pasted, largest_paste").replace("SELECT *", "SELECT document_id, session_id, CAST(typed AS BIGINT) AS typed, CAST(pasted AS BIGINT) AS pasted, CAST(largest_paste AS BIGINT) AS largest_paste", 1)),
    "snk_03": (exported("json"), PROFILES),
    "snk_04": (exported("csv"), PROFILES),
    "msc_06": (manifests, values([(m[0], m[2], m[3]) for m in MANIFESTS], "id, title, items").replace("SELECT *", "SELECT CAST(id AS BIGINT) AS id, title, items", 1)),
    "cry_02": (certified, f"SELECT doc_id, {ROOT} AS root, true AS root_valid, doc_id % 3 <> 0 OR text = '' AS hash_valid, doc_id % 3 <> 0 OR text = '' AS size_valid FROM documents"),
}
