"""A training corpus from ``documents``: language ID, near-duplicates, decontamination, mixing, token files.

Each stage takes (spark, docs, sf_dir), works on all that its predecessor kept and returns a DataFrame, which
``run`` writes as Parquet in the shared folder and reads again as the next stage's documents. All but the last
return the columns of ``documents``, and any others, whose names must not begin with two underscores.

Documents are told apart by doc_id, which may be null, and text. Null, empty and letterless texts go with language ID. Of equal rows one
stays. An empty table gives an empty result. Long texts are taken whole.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from scriptorium.llm.decontaminate import decontaminated
from scriptorium.llm.langid import UNDETERMINED, fit, identify
from scriptorium.llm.mixing import mix
from scriptorium.llm.neardup import LAST, near_duplicates
from scriptorium.llm.tokens import token_ids
from scriptorium.session import fresh_path, materialize, reclaim_executors, table

#: A document whose likeliest language has a smaller share of its words' posterior is rejected.
LANGUAGE_SHARE = 0.4
#: Ids of dropped documents up to which their list is broadcast (8 bytes each).
BROADCAST_IDS = 1_000_000


def small(ids: DataFrame) -> DataFrame:
    """Broadcast if the list is short."""
    return F.broadcast(ids) if ids.count() <= BROADCAST_IDS else ids


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents in no language that the model knows; learns from the labelled rows.

    Only the rejected rows' keys come back from the model, so the texts never leave it again.
    """
    print_ = F.xxhash64("text").alias("print")
    found = identify(docs.select("doc_id", print_, "text"), fit(docs), keep=("doc_id", "print"))
    rejected = found.where((F.col("lang_pred") == UNDETERMINED) | (F.col("score") < LANGUAGE_SHARE))
    rejected = small(materialize(rejected.select(F.col("doc_id").alias("__id"), F.col("print").alias("__print")).distinct(), "rejected"))
    same = F.col("doc_id").eqNullSafe(F.col("__id")) & (F.xxhash64("text") == F.col("__print"))
    return docs.join(rejected, same, "left_anti").select(*docs.columns)


def near_duplicate_removal(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps one document of each group of linked documents: the one with the smallest doc_id (null last), then hash of its text.

    Rows are told apart by doc_id and text, so that texts which share an id stand for themselves; equal rows are one document.
    """
    found = near_duplicates(docs).where("group_id is not null").select("group_id", F.coalesce("doc_id", F.lit(LAST)).alias("__id"), F.col("text_print").alias("__print"))
    found = materialize(found.groupBy("group_id", "__id", "__print").agg(F.count(F.lit(1)).alias("n")), "grouped")
    leaders = found.groupBy("group_id").agg(F.min(F.struct("__id", "__print")).alias("lead"), F.sum("n").alias("all")).where(F.col("all") > 1)
    members = found.join(leaders, "group_id").withColumn("leads", F.col("lead") == F.struct("__id", "__print"))
    members = materialize(members.where("not leads or n > 1").select("__id", "__print", "leads"), "members")
    same = (F.coalesce(F.col("doc_id").cast("long"), F.lit(LAST)) == F.col("__id")) & (F.xxhash64("text") == F.col("__print"))
    kept = docs.join(small(members), same, "left_anti").select(*docs.columns)
    repeated = members.where("leads")
    if repeated.limit(1).count():
        one = docs.join(small(repeated), same, "left_semi").withColumn("__print", F.xxhash64("text")).dropDuplicates(["doc_id", "__print"])
        kept = kept.union(one.select(*docs.columns))
    return kept


def benchmark_decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents that repeat an item of ``benchmark``."""
    return decontaminated(docs, table(spark, sf_dir, "benchmark"))


def source_mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document as often as the mix takes it (0 to 2 times)."""
    return mix(docs)


def token_output(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Writes the token files and reports every document of the mix from them."""
    import public_tokenizers

    reclaim_executors(spark)  # the encoders' memory comes on top of the heaps that the stages before have filled
    return token_ids(docs, public_tokenizers.path("byte_bpe_50k.json"), end_id=2)


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("language_id", language_id),
    ("near_duplicate_removal", near_duplicate_removal),
    ("benchmark_decontamination", benchmark_decontamination),
    ("source_mixing", source_mixing),
    ("token_output", token_output),
]

#: SQL can express neither the field nor the tokenizer; the tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        path = fresh_path(spark, f"pipeline-{name}")
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return docs
