"""Training records, session files, manifests, exports, certificates and settings."""

from __future__ import annotations

import tomllib
from dataclasses import dataclass, fields
from pathlib import Path

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from scriptorium.functions import text as T

RECORD = "text string, label string, source string, register string, model string, prompt_type string, word_count long"
EVENT = "seq: bigint, timestamp: string, elapsed_ms: bigint, event_type: string, text_length: bigint, position: struct<paragraph: bigint, offset: bigint, selection_length: bigint>, source: string"
SESSION = f"session_id string, document_name string, source string, started_at string, ended_at string, plugin_version string, schema_version int, events array<struct<{EVENT}>>"


def training_records(docs: DataFrame, label: Column, register: Column) -> DataFrame:
    """SRC-18: records as the trainers read them: trimmed text, label, source, register and word count."""
    text = F.trim(F.coalesce("text", F.lit("")))
    return docs.select(text.alias("text"), label.alias("label"), F.col("source"), register.alias("register"), F.lit("").alias("model"), F.lit("").alias("prompt_type"), F.size(T.ws_words(text)).cast("long").alias("word_count"))


def append_records(records: DataFrame, path: str) -> None:
    """SRC-18: add records to a folder of JSON lines; the files that are there stay as they are."""
    records.write.mode("append").json(path)


def read_records(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(RECORD).json(path)


def export(rows: DataFrame, path: str, kind: str) -> None:
    """SNK-03, 04: profiles and batch results as JSON lines, CSV with a header, or Parquet."""
    writer = rows.write.option("header", "true") if kind == "csv" else rows.write
    {"json": writer.json, "csv": writer.csv, "parquet": writer.parquet}[kind](path)


def read_sessions(spark: SparkSession, path: str) -> DataFrame:
    """SRC-21: capture sessions of a file or folder, one JSON object a file, by their start; files that are no sessions are left out."""
    rows = spark.read.schema(SESSION).option("multiLine", "true").option("mode", "PERMISSIVE").json(path)
    return rows.where("session_id is not null").orderBy("started_at")


def session_events(sessions: DataFrame) -> DataFrame:
    """The sessions' events in the columns that the process metrics read."""
    rows = sessions.select(F.col("document_name").alias("document_id"), "session_id", F.explode("events").alias("e"))
    return rows.select("document_id", "session_id", F.col("e.seq").alias("seq"), F.col("e.elapsed_ms").alias("elapsed_ms"), F.lower("e.event_type").alias("event_type"), F.col("e.text_length").alias("text_length"))


def manifest(xml: Column) -> tuple[Column, Column]:
    """MSC-06: a project's title, and the ids of its binder items."""
    title = F.trim(F.regexp_extract(xml, r"(?s)<Title>(.*?)</Title>", 1))
    return F.when(xml.contains("<Title>"), title).otherwise("Untitled"), F.regexp_extract_all(xml, F.lit(r'(?m)^\s*<BinderItem[^>\n]*?ID="([^"]*)"'), F.lit(1))


def certificates(docs: DataFrame) -> DataFrame:
    """CRY-02: a certificate's fields and Merkle root: leaves are SHA-256 of name:value, pairs of the joined hex."""
    values = {"file_hash": F.sha2("text", 256), "file_size": F.octet_length("text").cast("string"), "word_count": F.size(T.ws_words(F.col("text"))).cast("string"), "source": F.coalesce("source", F.lit(""))}
    rows = docs.select("doc_id", "text", *[v.alias(k) for k, v in values.items()])
    a, b, c, d = (F.sha2(F.concat(F.lit(f"{k}:"), F.col(k)), 256) for k in values)
    return rows.withColumn("root", F.sha2(F.concat(F.sha2(F.concat(a, b), 256), F.sha2(F.concat(c, d), 256)), 256))


def verified(certificates_: DataFrame, docs: DataFrame) -> DataFrame:
    """CRY-02, MSC-07: whether each certificate's root fits its fields, and its hash and size the document at hand."""
    a, b, c, d = (F.sha2(F.concat(F.lit(f"{k}:"), F.col(k)), 256) for k in ("file_hash", "file_size", "word_count", "source"))
    root = F.sha2(F.concat(F.sha2(F.concat(a, b), 256), F.sha2(F.concat(c, d), 256)), 256)
    now = docs.select("doc_id", F.sha2("text", 256).alias("now"), F.octet_length("text").cast("string").alias("bytes"))
    rows = certificates_.drop("text").join(now, "doc_id")
    return rows.select("doc_id", (root == F.col("root")).alias("root_valid"), (F.col("now") == F.col("file_hash")).alias("hash_valid"), (F.col("bytes") == F.col("file_size")).alias("size_valid"))


@dataclass(frozen=True)
class Settings:
    """MSC-17: settings with their defaults."""

    min_words: int = 500
    confidence_threshold: float = 0.85
    profiles_dir: str = "profiles"
    feature_set: str = "standard"

    @classmethod
    def load(cls, path: str | Path) -> Settings:
        """From a TOML file on the driver; what it does not name keeps its default, as everything does if it does not exist."""
        file = Path(path)
        found = tomllib.loads(file.read_text()) if file.exists() else {}
        return cls(**{f.name: found[f.name] for f in fields(cls) if f.name in found})
