"""The registered queries of this package, and the SQL that checks them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from scriptorium.session import table


def op1_nearest_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    from scriptorium.llm.neighbours import nearest

    return nearest(table(spark, sf_dir, "embeddings"))


def op2_token_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    from scriptorium.llm.tokens import token_ids

    return token_ids(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"), end_id=2)


def op3_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    from scriptorium.llm.langid import fit, identify

    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    fold = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 4 == 2
    model = fit(docs.where(F.coalesce(~fold, F.lit(True))))
    found = identify(docs, model)
    return found.select("doc_id", F.coalesce(fold, F.lit(False)).alias("held_out"), "lang_pred", "score")


def op4_benchmark_leaks(spark: SparkSession, sf_dir: str) -> DataFrame:
    from scriptorium.llm.decontaminate import contaminated

    return contaminated(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op5_weighted_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    from scriptorium.llm.mixing import schedule

    return schedule(table(spark, sf_dir, "documents")).select("doc_id", "size", "source_size", "target", "taken", "copies", "virtual_finish")


def op6_hilbert_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    from scriptorium.llm.hilbert import hilbert_shards

    placed = hilbert_shards(table(spark, sf_dir, "documents"), shards=40)
    return placed.select("doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"), "cell", "position")


def op7_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    from scriptorium.llm.licenses import scan_licenses

    return scan_licenses(table(spark, sf_dir, "documents")).drop("blocks")


def op9_personal_data(spark: SparkSession, sf_dir: str) -> DataFrame:
    from scriptorium.llm.pii import find_personal_data

    return find_personal_data(table(spark, sf_dir, "documents"))


def op8_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from scriptorium.llm.substrings import remove_repeats

    return remove_repeats(table(spark, sf_dir, "documents")).drop("kept_text")


def op10_near_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    from scriptorium.llm.neardup import near_duplicates

    return near_duplicates(table(spark, sf_dir, "documents")).select("doc_id", "n_shingles", "component_id", "kept")


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {k: f for k, f in sorted(globals().items()) if k.startswith("op") and callable(f)}


#: Exact by nature: a word goes if a window over it started earlier somewhere.
OP8_SQL = r"""
WITH w AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents),
starts AS (SELECT doc_id, unnest(range(1, len(w) - 18)) AS i, w FROM w WHERE len(w) >= 20),
windows AS (SELECT doc_id, i, sha256(array_to_string(w[i:i + 19], ' ')) AS k FROM starts),
later AS (SELECT doc_id, i FROM windows QUALIFY row_number() OVER (PARTITION BY k ORDER BY doc_id, i) > 1),
words AS (SELECT doc_id, unnest(range(1, len(w) + 1)) AS i, unnest(w) AS word FROM w),
gone AS (SELECT words.doc_id, words.i, word, bool_or(later.i IS NOT NULL) OVER (PARTITION BY words.doc_id ORDER BY words.i ROWS 19 PRECEDING) AS g FROM words LEFT JOIN later ON later.doc_id = words.doc_id AND later.i = words.i)
SELECT d.doc_id, count(word) AS n_words, count(*) FILTER (g) AS n_removed, sha256(coalesce(string_agg(word, ' ' ORDER BY i) FILTER (NOT g), '')) AS kept_sha256
FROM documents d LEFT JOIN gone ON gone.doc_id = d.doc_id GROUP BY 1
"""

#: All pairs that share a shingle, counted exactly; components by closure.
OP10_SQL = r"""
WITH RECURSIVE w AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents),
s AS (SELECT DISTINCT doc_id, unnest(list_transform(range(1, greatest(len(w) - 4, 1) + 1), lambda i: array_to_string(w[i:i + 4], ' '))) AS shingle FROM w WHERE len(w) > 0),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY 1),
pairs AS (SELECT a.doc_id AS x, b.doc_id AS y, count(*) AS c FROM s a JOIN s b USING (shingle) WHERE a.doc_id < b.doc_id GROUP BY ALL),
links AS (SELECT x, y FROM pairs JOIN n p ON p.doc_id = x JOIN n q ON q.doc_id = y WHERE 100 * c >= 75 * (p.n + q.n - c)),
both_ways AS (SELECT x, y FROM links UNION ALL SELECT y, x FROM links),
reach AS (SELECT doc_id AS id, doc_id AS r FROM documents UNION SELECT reach.id, both_ways.y FROM reach JOIN both_ways ON reach.r = both_ways.x)
SELECT d.doc_id, coalesce(any_value(n.n), 0) AS n_shingles, min(r) AS component_id, min(r) = d.doc_id AS kept
FROM documents d JOIN reach ON reach.id = d.doc_id LEFT JOIN n ON n.doc_id = d.doc_id GROUP BY d.doc_id
"""


def oracle_sql() -> dict[str, str]:
    return {"op8_substring_dedup": OP8_SQL, "op10_near_duplicates": OP10_SQL}
