"""Corpus operators: quality, dedup, folds, splits, summaries; ``source`` plays the author."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from scriptorium.functions import text as T
from scriptorium.operators.profiles import r6


def n_words(text: Column) -> Column:
    return F.size(T.ws_words(text))


def quality(docs: DataFrame) -> DataFrame:
    """AGG-25: length, character diversity and sentences in one score."""
    chars = F.filter(F.split("text", ""), lambda c: c != "")
    rows = docs.select("doc_id", n_words(F.col("text")).alias("w"), (F.size(F.array_distinct(chars)) / F.greatest(F.length("text"), F.lit(1))).alias("d"), F.length(F.regexp_replace("text", "[^.!?]", "")).alias("s"))
    score = 0.5 * F.least(F.col("w") / 2000.0, F.lit(1.0)) + 0.2 * F.when(F.col("d") < 0.01, 0.1).otherwise(1.0) + 0.3 * F.least(F.col("s") / 3.0, F.lit(1.0))
    return rows.select("doc_id", F.col("w").cast("long").alias("words"), r6(F.when(F.col("w") == 0, 0.0).otherwise(score)).alias("quality"))


def first_copies(docs: DataFrame) -> DataFrame:
    """SET-05: of equal texts the one with the smallest doc_id; the aggregate combines before the shuffle, so many copies cost little."""
    firsts = docs.groupBy(F.sha2("text", 256).alias("sha256")).agg(F.min("doc_id").alias("doc_id"), F.count(F.lit(1)).alias("copies"))
    return firsts.select("doc_id", "sha256", "copies")


def quality_filter(docs: DataFrame, min_words: int = 100, min_quality: float = 0.5) -> DataFrame:
    """FLT-03: first copies, then enough words, then enough quality, in that order."""
    firsts = docs.join(first_copies(docs).select("doc_id"), "doc_id", "left_semi")
    return quality(firsts).where((F.col("words") >= min_words) & (F.col("quality") >= min_quality))


def summary(docs: DataFrame) -> DataFrame:
    """AGG-13, 14, MSC-03: documents and words per author."""
    rows = docs.select(F.col("source").alias("author"), n_words(F.col("text")).alias("w"))
    return rows.groupBy("author").agg(F.count(F.lit(1)).alias("documents"), F.sum("w").alias("words"), r6(F.avg("w")).alias("avg_words"), F.min("w").cast("long").alias("min_words"), F.max("w").cast("long").alias("max_words"))


def ranked(rows: DataFrame, group: str, bucket: Column, *order: str) -> DataFrame:
    """``r`` and ``n``: place within the group, from 1, and the group's size, in two levels: places within buckets, and what lies in the
    buckets before. Buckets must follow the order; a group with any share of all rows spreads over as many tasks as it has buckets."""
    rows = rows.withColumn("__b", bucket)
    sizes = rows.groupBy(group, "__b").agg(F.count(F.lit(1)).alias("c"))
    by = Window.partitionBy(group)
    offsets = sizes.select(F.col(group).alias("__g"), F.col("__b").alias("__o"), (F.sum("c").over(by.orderBy("__b")) - F.col("c")).alias("__before"), F.sum("c").over(by).alias("n"))
    inside = F.row_number().over(Window.partitionBy(group, "__b").orderBy(*order))
    joined = rows.withColumn("__in", inside).join(offsets, F.col(group).eqNullSafe(F.col("__g")) & (F.col("__b") == F.col("__o")))
    return joined.withColumn("r", F.col("__before") + F.col("__in")).drop("__b", "__g", "__o", "__before", "__in")


#: Ids in a bucket of documents in their order; and low bits of a hash below its bucket.
BUCKET_IDS, BUCKET_BITS = 100_000, 20


def folds(docs: DataFrame, k: int = 5) -> DataFrame:
    """WIN-08: stratified fold numbers, in order within each class."""
    rows = ranked(docs.select("doc_id", "lang"), "lang", F.floor(F.col("doc_id") / BUCKET_IDS), "doc_id")
    return rows.select("doc_id", "lang", ((F.col("r") - 1) % k).cast("long").alias("fold"))


def hashed(key: Column, seed: int = 42) -> Column:
    """A number from 0 up to 2^32 by MD5, equal on every engine."""
    return F.conv(F.substring(F.md5(F.concat_ws(":", key.cast("string"), F.lit(str(seed))).cast("binary")), 1, 8), 16, 10).cast("long")


def stratified_split(docs: DataFrame) -> DataFrame:
    """WIN-09: 70/15/15 within each author, in hashed order."""
    rows = docs.select("doc_id", "source", hashed(F.col("doc_id")).alias("h"))
    rows = ranked(rows, "source", F.shiftright("h", BUCKET_BITS), "h", "doc_id")
    train, val = F.floor(F.col("n") * 0.70 + 0.5), F.floor(F.col("n") * 0.15 + 0.5)
    return rows.select("doc_id", "source", F.when(F.col("r") <= train, "train").when(F.col("r") <= train + val, "val").otherwise("test").alias("split"))


def split_statistics(docs: DataFrame) -> DataFrame:
    """MSC-04: documents of each split per author."""
    return stratified_split(docs).groupBy("source").agg(*[F.count_if(F.col("split") == s).alias(s) for s in ("train", "val", "test")])


def bucket_split(docs: DataFrame) -> DataFrame:
    """WIN-10: split by the hash's bucket of a hundred."""
    b = hashed(F.col("doc_id")) % 100
    return docs.select("doc_id", b.alias("bucket"), F.when(b < 80, "train").when(b < 90, "val").otherwise("test").alias("split"))


def vocabulary_growth(docs: DataFrame) -> DataFrame:
    """SET-03, RES-09: words that each of an author's documents adds to those before."""
    rows = docs.select("source", "doc_id", F.explode(F.array_distinct(T.tokens(F.col("text")))).alias("token"))
    first = rows.groupBy("source", "token").agg(F.min("doc_id").alias("doc_id"))
    added = first.groupBy("source", "doc_id").agg(F.count(F.lit(1)).alias("added"))
    total = F.sum("added").over(Window.partitionBy("source").orderBy("doc_id"))
    return added.withColumn("vocabulary", total)


def author_profiles(docs: DataFrame) -> DataFrame:
    """AGG-05: averages of each author's documents."""
    from scriptorium.operators.profiles import lexical

    rows = lexical(docs).join(docs.select("doc_id", F.col("source").alias("author")), "doc_id")
    return rows.groupBy("author").agg(F.count(F.lit(1)).alias("documents"), *[F.round(F.avg(c), 5).alias(c) for c in ("ttr", "hapax_ratio", "avg_word_length", "yule_k")])


def distribution(docs: DataFrame) -> DataFrame:
    """MSC-16: documents and lengths by label and author."""
    return docs.groupBy("lang", "source").agg(F.count(F.lit(1)).alias("n"), F.min("n_chars").alias("lo"), F.max("n_chars").alias("hi"), r6(F.avg("n_chars")).alias("mean"))
