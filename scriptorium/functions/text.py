"""Tokenisers, splitters and word measures as native column expressions."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Unicode words; the same pattern serves every engine that checks the results.
WORD = r"(?:\p{L}[\p{L}\p{M}]*(?:['’.:·]\p{L}[\p{L}\p{M}]*)*|\p{N}+(?:['’.,;]\p{N}+)*|_)+"


def tokens(text: Column) -> Column:
    """Lower-cased Unicode words that hold a letter or digit (TOK-01)."""
    return F.filter(F.regexp_extract_all(F.lower(text), F.lit(WORD), F.lit(0)), lambda w: w.rlike(r"[\p{L}\p{N}]"))


def ws_words(text: Column) -> Column:
    """White-space words (TOK-02); none for a blank text."""
    return F.filter(F.split(text, r"\s+"), lambda w: w != "")


def _marked(text: Column, follow: str) -> Column:
    marked = F.regexp_replace(text, rf"([.!?])([\s{follow}]|$)", "$1\u0001$2")
    parts = F.transform(F.split(marked, "\u0001"), lambda s: F.regexp_replace(s, r"^\s+|\s+$", ""))
    return F.filter(parts, lambda s: s != "")


def sentences(text: Column, follow: str = "\"')") -> Column:
    """Sentences A: cut after . ! ? before white space, a quote, a bracket or the end; an unfinished tail of one word goes (TOK-03)."""
    return F.filter(_marked(text, follow), lambda s: s.rlike(r"[.!?]$") | s.rlike(r"\s"))


def sentences_b(text: Column) -> Column:
    """Sentences B: as A, but no cut before an apostrophe (TOK-04)."""
    return sentences(text, "\")")


def sentences_c(text: Column, min_words: int = 3) -> Column:
    """Sentences C: cut at every . ! ?, with a minimum of white-space words (TOK-05)."""
    parts = F.transform(F.split(text, "[.!?]"), lambda s: F.regexp_replace(s, r"^\s+|\s+$", ""))
    return F.filter(parts, lambda s: (s != "") & (F.size(F.split(s, r"\s+")) >= min_words))


def sentence_marks(text: Column) -> Column:
    """Sentence counter D: number of . ! ? but one at least (TOK-06)."""
    return F.greatest(F.length(F.regexp_replace(text, "[^.!?]", "")), F.lit(1))


def sentences_e(text: Column) -> Column:
    """Sentences E: cut at white space after . ! ? (TOK-07)."""
    return F.split(text, r"(?<=[.!?])\s+")


def paragraphs(text: Column, delimiter: str = "\n\n") -> Column:
    """Paragraphs: cut at the delimiter, trimmed, none empty (TOK-08)."""
    parts = F.transform(F.split(text, delimiter), lambda p: F.regexp_replace(p, r"^\s+|\s+$", ""))
    return F.filter(parts, lambda p: p != "")


def syllables(word: Column) -> Column:
    """Vowel groups, less a silent final e; one at least, and for words of up to three bytes (TOK-13)."""
    groups = F.regexp_count(word, F.lit("[aeiouy]+"))
    counted = F.greatest(groups - (word.endswith("e") & (groups > 1)).cast("int"), F.lit(1))
    return F.when(F.octet_length(word) <= 3, 1).otherwise(counted)


def occurrences(text: Column, phrase: str) -> Column:
    """Non-overlapping places of a phrase."""
    return ((F.length(text) - F.length(F.replace(text, F.lit(phrase), F.lit("")))) / len(phrase)).cast("long")


def token_rows(docs: DataFrame) -> DataFrame:
    """(doc_id, pos, token), pos from 0."""
    return docs.select("doc_id", F.posexplode(tokens(F.col("text"))).alias("pos", "token"))


def sentence_rows(docs: DataFrame) -> DataFrame:
    """(doc_id, idx, sentence, n_ws) by splitter A."""
    rows = docs.select("doc_id", F.posexplode(sentences(F.col("text"))).alias("idx", "sentence"))
    return rows.withColumn("n_ws", F.size(F.split("sentence", r"\s+")))


def run_lengths(array: str) -> str:
    """SQL of the lengths of the runs of equal neighbours in a sorted array (a column, which is read for every element)."""
    starts = f"filter(sequence(1, greatest(size({array}), 1)), j -> j <= size({array}) and (j = 1 or get({array}, j - 1) <> get({array}, j - 2)))"
    return f"transform(array({starts}), st -> transform(st, (j, k) -> cast(coalesce(get(st, k + 1), size({array}) + 1) - j as bigint)))[0]"


def counted(rows: DataFrame, array: Column, *keys: str) -> DataFrame:
    """(keys, k, c): the distinct elements of an array in order, and how often each occurs; within the row, without a shuffle."""
    rows = rows.select(*keys, F.sort_array(array).alias("__s"))
    return rows.select(*keys, F.array_distinct("__s").alias("k"), F.expr(run_lengths("__s")).alias("c"))


def token_counts(docs: DataFrame) -> DataFrame:
    """(doc_id, token, n), counted within the row: what follows groups by document, of which each task has whole ones."""
    rows = counted(docs, tokens(F.col("text")), "doc_id")
    return rows.select("doc_id", F.explode(F.arrays_zip("k", "c")).alias("e")).select("doc_id", F.col("e.k").alias("token"), F.col("e.c").alias("n"))


def bound(value: Column, body: Callable[[Column], Column]) -> Column:
    """body(value), with value computed once however often, and wherever, body reads it."""
    return F.get(F.transform(F.array(value), body), 0)


def bigram_array(words: Column) -> Column:
    """Adjacent pairs joined by a space."""
    pairs = lambda w: F.zip_with(F.slice(w, F.lit(1), F.size(w) - 1), F.slice(w, F.lit(2), F.size(w)), lambda a, b: F.concat_ws(" ", a, b))
    return bound(words, lambda w: F.when(F.size(w) >= 2, pairs(w)).otherwise(F.array().cast("array<string>")))


def char_ngrams(text: Column, n: int) -> Column:
    """Character n-grams in order (TOK-09)."""
    grams = lambda c: F.transform(F.sequence(F.lit(1), F.size(c) - (n - 1)), lambda i: F.concat(*[F.get(c, i + (k - 1)) for k in range(n)]))
    return bound(F.filter(F.split(text, ""), lambda c: c != ""), lambda c: F.when(F.size(c) >= n, grams(c)).otherwise(F.array().cast("array<string>")))


def shingles(text: Column, n: int = 5) -> Column:
    """Distinct word n-shingles of the lower-cased text (TOK-11)."""
    made = lambda w: F.transform(F.sequence(F.lit(1), F.greatest(F.size(w) - (n - 1), F.lit(1))), lambda i: F.array_join(F.slice(w, i, F.lit(n)), " "))
    return F.array_distinct(bound(ws_words(F.lower(text)), lambda w: F.when(F.size(w) > 0, made(w)).otherwise(F.array().cast("array<string>"))))
