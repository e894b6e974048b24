"""Text from marked-up pages, chats and plain files; checks of files and archives; digests."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

SKIPPED = ("script", "style", "noscript", "head")
ENTITIES = {"&nbsp;": " ", "&lt;": "<", "&gt;": ">", "&quot;": '"', "&#39;": "'", "&amp;": "&"}


def html_text(html: Column) -> Column:
    """SRC-06: text of a page's body without skipped elements, comments and tags; white space collapsed."""
    x = html
    for name in SKIPPED:
        x = F.regexp_replace(x, rf"(?is)<{name}[^>]*>.*?</{name}\s*>", " ")
    x = F.regexp_replace(F.regexp_replace(x, r"(?s)<!--.*?-->", " "), r"(?s)<[^>]+>", " ")
    for entity, value in ENTITIES.items():
        x = F.replace(x, F.lit(entity), F.lit(value))
    return F.trim(F.regexp_replace(x, r"\s+", " "))


def markdown_text(text: Column) -> Column:
    """SRC-05: text of Markdown: no fenced code, no marks; link texts and inline code stay."""
    x = F.regexp_replace(text, r"(?s)```.*?(?:```|$)", "")
    x = F.regexp_replace(x, r"!?\[([^\]]*)\]\([^)]*\)", "$1")
    x = F.regexp_replace(x, r"(?m)^\s{0,3}(?:#{1,6}\s+|>\s?|[-*+]\s+|\d+\.\s+)", "")
    return F.trim(F.regexp_replace(x, r"(\*\*|__|`|~~)", ""))


def normalised(text: Column) -> Column:
    """SRC-17: line ends to LF, at most one blank line, trimmed."""
    x = F.regexp_replace(text, r"\r\n?", "\n")
    return F.regexp_replace(F.regexp_replace(x, r"\n{3,}", "\n\n"), r"^\s+|\s+$", "")


def page_texts(pages: DataFrame) -> DataFrame:
    return pages.select("page_id", html_text(F.col("html")).alias("text"))


def chat_texts(turns: DataFrame) -> DataFrame:
    """SRC-15: each conversation's turns in order, blank lines between."""
    ordered = F.sort_array(F.collect_list(F.struct("turn", "text")))
    return turns.groupBy("conv_id").agg(F.array_join(F.transform(ordered, lambda t: t["text"]), "\n\n").alias("text"), F.count(F.lit(1)).alias("turns"))


def xml_bomb(content: Column) -> Column:
    """VAL-03: more than ten entity declarations or ten thousand references."""
    return (F.regexp_count(content, F.lit("<!ENTITY")) > 10) | (F.regexp_count(content, F.lit("&")) > 10_000)


def safe_name(name: Column) -> Column:
    """VAL-04: a file name without path marks."""
    return F.regexp_replace(F.replace(name, F.lit(".."), F.lit("_")), r"[/\\:\x00]", "_")


def digests(docs: DataFrame) -> DataFrame:
    """FOR-02, CRY-03, MSC-07, 08: size, SHA-256, signature with a secret, fingerprint."""
    sha = F.sha2("text", 256)
    return docs.select("doc_id", F.octet_length("text").cast("long").alias("size"), sha.alias("sha256"), F.sha2(F.concat(F.lit("secret"), F.col("text")), 256).alias("signature"), F.substring(sha, 1, 16).alias("fingerprint"))


def tampering(docs: DataFrame) -> DataFrame:
    """FOR-05: zero-width characters, with the finding and its risk."""
    n = F.length("text") - F.length(F.regexp_replace("text", "[​‌‍﻿­]", ""))
    return docs.select("doc_id", n.cast("long").alias("zero_width"), (n > 3).alias("suspicious"), F.when(n > 3, 0.3).otherwise(0.0).alias("risk"))


def merkle_root(docs: DataFrame) -> DataFrame:
    """CRY-01: root over the documents in order: leaves are SHA-256 of id:text, pairs of the joined hex, an odd one moves up.

    A level is one aggregate by half the position, so the number of jobs is the logarithm of the number of leaves.
    """
    from pyspark.sql import Window

    from scriptorium.session import materialize

    hashed = docs.select(F.col("doc_id").alias("o"), F.sha2(F.concat_ws(":", F.col("doc_id").cast("string"), "text"), 256).alias("h"))
    # positions in two levels: ranges of ids, and places within each; no task sorts all leaves
    ranged = materialize(hashed.repartitionByRange("o").sortWithinPartitions("o").withColumn("p", F.spark_partition_id()), "leaves")
    sizes = ranged.groupBy("p").agg(F.count(F.lit(1)).alias("n"))
    offsets = sizes.select("p", (F.sum("n").over(Window.orderBy("p")) - F.col("n")).alias("before"))  # one row a partition
    place = F.row_number().over(Window.partitionBy("p").orderBy("o")) - 1
    level = materialize(ranged.withColumn("place", place).join(F.broadcast(offsets), "p").select((F.col("before") + F.col("place")).cast("long").alias("i"), "h"), "level")
    n = level.count()
    leaves = n
    while n > 1:
        pairs = level.groupBy(F.expr("i div 2").alias("i")).agg(F.sort_array(F.collect_list(F.struct("i", "h"))).alias("x"))
        joined = F.when(F.size("x") == 1, F.col("x")[0]["h"]).otherwise(F.sha2(F.concat(F.col("x")[0]["h"], F.element_at("x", -1)["h"]), 256))
        level = materialize(pairs.select("i", joined.alias("h")), "merkle")
        n = -(-n // 2)
    return level.select(F.lit(leaves).cast("long").alias("leaves"), F.col("h").alias("root"))


def read_corpus(spark: SparkSession, path: str) -> DataFrame:
    """SRC-01 to 04: (author, path, size, text) of the plain files under path/author/; BOMs choose the decoder, then UTF-8."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path)
    c = F.col("content")
    head = lambda n: F.hex(F.substring(c, 1, n))
    text = F.when(head(3) == "EFBBBF", F.decode(F.expr("substring(content, 4)"), "UTF-8")).when(head(2) == "FFFE", F.decode(F.expr("substring(content, 3)"), "UTF-16LE")).when(head(2) == "FEFF", F.decode(F.expr("substring(content, 3)"), "UTF-16BE")).otherwise(F.decode(c, "UTF-8"))
    return files.where(F.col("length") <= 100 * 1024 * 1024).select(F.element_at(F.split("path", "/"), -2).alias("author"), "path", F.col("length").alias("size"), normalised(text).alias("text"))


def detect_format(content: Column) -> Column:
    """FOR-01: a file's kind by its first bytes."""
    head = F.hex(F.substring(content, 1, 8))
    return F.when(head.startswith("25504446"), "pdf").when(head.startswith("504B0304"), "zip").when(head.startswith("7B5C727466"), "rtf").when(head.startswith("D0CF11E0"), "ole").otherwise("text")
