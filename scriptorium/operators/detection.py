"""Sequence and window features of a document's words, sentences and paragraphs."""

from __future__ import annotations

from functools import reduce

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.window import WindowSpec

from scriptorium.functions import kernels as K
from scriptorium.functions import lexicons as L
from scriptorium.functions import text as T
from scriptorium.operators import measures
from scriptorium.operators.profiles import listed, r6, ratio


def by_doc() -> WindowSpec:
    return Window.partitionBy("doc_id")


def fixed_windows(docs: DataFrame, size: int) -> DataFrame:
    """TOK-14: distinct tokens of each whole window of ``size`` tokens."""
    n = docs.select("doc_id", F.size(T.tokens(F.col("text"))).alias("n"))
    rows = T.token_rows(docs).join(n, "doc_id").withColumn("win", F.expr(f"cast(pos div {size} as bigint)")).where(F.col("win") < F.expr(f"n div {size}"))
    return rows.groupBy("doc_id", "win").agg(F.countDistinct("token").alias("distinct_tokens"))


def sliding_windows(docs: DataFrame, size: int, step: int) -> DataFrame:
    """TOK-15: (doc_id, win, start_word, end_word, words) of each window of ``size`` tokens, every ``step``."""
    rows = docs.select("doc_id", T.tokens(F.col("text")).alias("toks")).where(F.size("toks") >= size)
    at = rows.select("doc_id", "toks", F.posexplode(F.sequence(F.lit(0), F.size("toks") - size, F.lit(step))).alias("win", "start_word"))
    return at.select("doc_id", "win", "start_word", (F.col("start_word") + size).cast("long").alias("end_word"), F.slice("toks", F.col("start_word") + 1, size).alias("words"))


def content_rows(docs: DataFrame) -> DataFrame:
    """(doc_id, rn, token): words of over two bytes that are no function words, numbered from 0."""
    rows = T.token_rows(docs).where((F.octet_length("token") > 2) & ~listed(L.FUNCTION_WORDS))
    return rows.withColumn("rn", F.row_number().over(by_doc().orderBy("pos")) - 1)


def synonym_variation(docs: DataFrame, size: int = 50) -> DataFrame:
    """TOK-16, DET-15: mean share of distinct words in chunks of content words, the last one included."""
    chunks = content_rows(docs).groupBy("doc_id", F.expr(f"rn div {size}").alias("win")).agg((F.countDistinct("token") / F.count(F.lit(1))).alias("r"))
    return chunks.groupBy("doc_id").agg(r6(F.avg("r")).alias("variation"))


def burstiness(docs: DataFrame, size: int = 100) -> DataFrame:
    """DET-01: mean (variance - mean) / (variance + mean) of the window counts of recurring content words; empty windows by algebra."""
    big = T.token_rows(docs).where(F.octet_length("token") > 1).withColumn("p", F.row_number().over(by_doc().orderBy("pos")) - 1)
    wins = big.groupBy("doc_id").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") >= 2 * size).select("doc_id", F.expr(f"n div {size}").alias("wins"))
    counts = big.where(~listed(L.FUNCTION_WORDS)).join(wins, "doc_id").withColumn("win", F.expr(f"p div {size}"))
    counts = counts.groupBy("doc_id", "token", "wins", "win").agg(F.count(F.lit(1)).alias("c"))
    inside = F.when(F.col("win") < F.col("wins"), F.col("c")).otherwise(0)
    sums = counts.groupBy("doc_id", "token", "wins").agg(F.sum("c").alias("total"), F.sum(inside).alias("s"), F.sum(inside * inside).alias("q")).where("total >= 3")
    mu = F.col("s") / F.col("wins")
    var = (F.col("q") - F.col("s").cast("double") * F.col("s") / F.col("wins")) / (F.col("wins") - 1)
    rows = sums.select("doc_id", mu.alias("mu"), var.alias("v"))
    value = F.when(F.col("v") + F.col("mu") == 0, 0.0).otherwise((F.col("v") - F.col("mu")) / (F.col("v") + F.col("mu")))
    return rows.groupBy("doc_id").agg(r6(F.avg(value)).alias("burstiness"), F.count(F.lit(1)).alias("tracked"))


def zipf(docs: DataFrame) -> DataFrame:
    """DET-02: slope and fit of log frequency over log rank."""
    rows = T.token_counts(docs).where(F.col("token").rlike(r"\p{L}"))
    ranked = rows.select("doc_id", F.ln("n").alias("y"), F.ln(F.row_number().over(by_doc().orderBy(F.desc("n"), "token"))).alias("x"))
    per = ranked.groupBy("doc_id").agg(F.count(F.lit(1)).alias("v"), F.regr_slope("y", "x").alias("m"), F.regr_r2("y", "x").alias("r")).where("v >= 50")
    return per.select("doc_id", r6(F.col("m")).alias("slope"), r6(F.abs(F.col("m") + 1)).alias("deviation"), r6(F.col("r")).alias("r2"))


def hedge_ratio(docs: DataFrame) -> DataFrame:
    """DET-03: hedges per intensifier."""
    some = lambda words: F.sum(F.when(listed(words), F.col("n")).otherwise(0))
    per = T.token_counts(docs).groupBy("doc_id").agg(some(L.HEDGES).alias("h"), some(L.INTENSIFIERS).alias("i"))
    value = F.when(F.col("i") > 0, F.col("h") / F.col("i")).when(F.col("h") > 0, 2.0 * F.col("h"))
    return per.select("doc_id", r6(value).alias("ratio"))


def autocorrelation(docs: DataFrame) -> DataFrame:
    """DET-04: autocorrelation of sentence lengths at lags 1 and 2 about the whole mean."""
    rows = T.sentence_rows(docs).withColumn("k", F.count(F.lit(1)).over(by_doc())).where("k >= 5").withColumn("d", F.col("n_ws") - F.avg("n_ws").over(by_doc()))
    order = by_doc().orderBy("idx")
    rows = rows.withColumn("d1", F.lead("d", 1).over(order)).withColumn("d2", F.lead("d", 2).over(order))
    per = rows.groupBy("doc_id").agg(F.first("k").alias("k"), F.sum(F.col("d") * F.col("d")).alias("s"), F.sum(F.col("d") * F.col("d1")).alias("s1"), F.sum(F.col("d") * F.col("d2")).alias("s2"))
    flat = F.col("s") < 1e-9
    return per.select("doc_id", r6(F.when(flat, 0.0).otherwise(F.col("s1") / F.col("s"))).alias("lag1"), r6(F.when(flat | (F.col("k") < 6), 0.0).otherwise(F.col("s2") / F.col("s"))).alias("lag2"))


def repetition_delta(docs: DataFrame) -> DataFrame:
    """DET-07: difference between the halves' reuse of content words."""
    rows = content_rows(docs).withColumn("n", F.count(F.lit(1)).over(by_doc())).where("n >= 2").withColumn("first", F.col("rn") < F.expr("n div 2"))
    halves = rows.groupBy("doc_id", "first").agg((1 - F.countDistinct("token") / F.count(F.lit(1))).alias("reuse"))
    pick = lambda c: F.max(F.when(c, F.col("reuse")))
    return halves.groupBy("doc_id").agg(r6(F.abs(pick(F.col("first")) - pick(~F.col("first")))).alias("delta"))


def transition_density(docs: DataFrame) -> DataFrame:
    """DET-09: places of transition phrases per 1000 white-space words."""
    rows = docs.select("doc_id", F.lower("text").alias("t"), F.greatest(F.size(T.ws_words(F.col("text"))), F.lit(1)).alias("w"))
    total = reduce(lambda a, b: a + b, [T.occurrences(F.col("t"), p) for p in L.TRANSITIONS])
    return rows.select("doc_id", r6(total * 1000.0 / F.col("w")).alias("per_1000"))


def paragraph_variation(docs: DataFrame, delimiter: str = "\n") -> DataFrame:
    """DET-10: coefficient of variation of paragraph lengths, four paragraphs at least."""
    rows = docs.select("doc_id", F.explode(T.paragraphs(F.col("text"), delimiter)).alias("p")).withColumn("n", F.size(F.split("p", r"\s+")))
    return rows.groupBy("doc_id").agg(F.count(F.lit(1)).alias("k"), F.stddev_samp("n").alias("s"), F.avg("n").alias("m")).where("k >= 4").select("doc_id", r6(F.col("s") / F.col("m")).alias("cv"))


def _sentences_b(docs: DataFrame) -> DataFrame:
    return docs.select("doc_id", T.sentences_b(F.col("text")).alias("s")).where(F.size("s") >= 5)


def opening_diversity(docs: DataFrame) -> DataFrame:
    """DET-11: distinct opening words per sentence."""
    first = F.transform("s", lambda s: F.lower(F.get(F.split(s, r"\s+"), 0)))
    return _sentences_b(docs).select("doc_id", r6(F.size(F.array_distinct(first)) / F.size("s")).alias("diversity"))


def nested_clauses(docs: DataFrame) -> DataFrame:
    """DET-12: share of sentences with two commas or more."""
    return _sentences_b(docs).select("doc_id", r6(F.size(F.filter("s", lambda s: T.occurrences(s, ",") >= 2)) / F.size("s")).alias("nested"))


def sophistication_slope(docs: DataFrame) -> DataFrame:
    """DET-14: growth of the mean word length from the first to the last quarter."""
    rows = T.token_rows(docs).withColumn("q", F.expr("count(1) over (partition by doc_id) div 4")).where("q >= 20")
    size = F.octet_length("token")
    last = F.avg(F.when((F.col("pos") >= 3 * F.col("q")) & (F.col("pos") < 4 * F.col("q")), size))
    return rows.groupBy("doc_id").agg(r6((last - F.avg(F.when(F.col("pos") < F.col("q"), size))) / 3).alias("slope"))


def modals(docs: DataFrame) -> DataFrame:
    """DET-17, 18: modal verbs per 1000 words and their diversity."""
    per = T.token_counts(docs).groupBy("doc_id").agg(F.sum("n").alias("w"), F.sum(F.when(listed(L.MODALS), F.col("n")).otherwise(0)).alias("m"), F.count_if(listed(L.MODALS)).alias("k"))
    return per.select("doc_id", r6(1000.0 * F.col("m") / F.col("w")).alias("density"), r6(ratio(F.col("k").cast("double"), F.col("m"))).alias("diversity"))


def register_consistency(docs: DataFrame, delimiter: str = "\n") -> DataFrame:
    """DET-19: variance over paragraphs of 0.6 mean word bytes + 4 share of words over 8 bytes."""
    paragraphs = F.transform(T.paragraphs(F.col("text"), delimiter), lambda p: F.transform(F.split(p, r"\s+"), lambda w: F.octet_length(w)))
    rows = docs.select("doc_id", F.explode(paragraphs).alias("b")).where(F.size("b") >= 10)
    total = F.aggregate("b", F.lit(0.0), lambda a, x: a + x)
    level = 0.6 * total / F.size("b") + 4 * F.size(F.filter("b", lambda x: x > 8)) / F.size("b")
    per = rows.select("doc_id", level.alias("f")).groupBy("doc_id").agg(F.count(F.lit(1)).alias("k"), F.var_samp("f").alias("v"))
    return per.select("doc_id", r6(F.when(F.col("k") < 3, 0.0).otherwise(F.col("v"))).alias("consistency"))


def _first_words(docs: DataFrame) -> DataFrame:
    word = F.regexp_replace(F.lower(F.get(F.split("sentence", r"\s+"), 0)), r"[^\p{L}]", "")
    return T.sentence_rows(docs).select("doc_id", "idx", word.alias("w"))


def connective_redundancy(docs: DataFrame) -> DataFrame:
    """DET-20: adjacent sentences that both open with a connective."""
    rows = _first_words(docs).withColumn("c", F.col("w").isin(*L.CONNECTIVES)).withColumn("d", F.lead("c").over(by_doc().orderBy("idx")))
    return rows.groupBy("doc_id").agg(F.count_if(F.col("c") & F.col("d")).alias("redundant"))


def initial_adverbs(docs: DataFrame) -> DataFrame:
    """DET-21: share of sentences that open with a word in ly of over three bytes."""
    hit = F.col("w").endswith("ly") & (F.octet_length("w") > 3)
    return _first_words(docs).groupBy("doc_id").agg(r6(F.avg(hit.cast("double"))).alias("ratio"))


def punctuation_entropy(docs: DataFrame) -> DataFrame:
    """DET-23: entropy of the punctuation marks in bits."""
    marks = docs.select("doc_id", F.explode(F.filter(F.split("text", ""), lambda c: c.isin(*L.PUNCTUATION_DIVERSITY))).alias("mark")).groupBy("doc_id", "mark").agg(F.count(F.lit(1)).alias("n"))
    p = F.col("n") / F.sum("n").over(by_doc())
    return marks.select("doc_id", p.alias("p")).groupBy("doc_id").agg(r6(-F.sum(F.col("p") * F.log2("p"))).alias("entropy"))


def quote_integration(docs: DataFrame) -> DataFrame:
    """DET-24: signal words per quotation, one at most; null without quotations."""
    marks = sum((T.occurrences(F.col("text"), m) for m in "\"“”"), F.lit(0))
    rows = docs.select("doc_id", F.lower("text").alias("t"), marks.alias("m")).withColumn("q", F.expr("m div 2"))
    signals = reduce(lambda a, b: a + b, [T.occurrences(F.col("t"), p) for p in L.QUOTE_SIGNALS])
    return rows.select("doc_id", r6(F.when(F.col("q") > 0, F.least(signals / F.col("q"), F.lit(1.0)))).alias("integration"))


def enumeration(docs: DataFrame) -> DataFrame:
    """DET-25: share of sentences that open with an enumeration marker or hold one after a comma."""
    s = F.lower("sentence")
    hit: Column = reduce(lambda a, b: a | b, [s.startswith(m) | s.contains(f", {m}") for m in L.ENUMERATIONS])
    return T.sentence_rows(docs).groupBy("doc_id").agg(r6(F.avg(hit.cast("double"))).alias("ratio"))


def paragraph_overlap(docs: DataFrame, delimiter: str = "\n") -> DataFrame:
    """DET-26, SET-01: mean Jaccard similarity of adjacent paragraphs' content words."""
    content = lambda p: F.array_distinct(F.filter(F.split(F.lower(p), r"[^\p{L}]+"), lambda w: (F.octet_length(w) > 2) & ~w.isin(*L.FUNCTION_WORDS)))
    parts = F.filter(F.split("text", delimiter), lambda p: p != "")
    rows = docs.select("doc_id", F.transform(parts, content).alias("s")).where(F.size("s") >= 2)
    pairs = rows.select("doc_id", F.explode(F.arrays_zip(F.slice(F.col("s"), F.lit(1), F.size("s") - 1).alias("a"), F.slice(F.col("s"), F.lit(2), F.size("s") - 1).alias("b"))).alias("x"))
    common = F.size(F.array_intersect("x.a", "x.b"))
    joint = F.size("x.a") + F.size("x.b") - common
    return pairs.groupBy("doc_id").agg(r6(F.avg(F.when(joint == 0, 0.0).otherwise(common / joint))).alias("jaccard"))


def conditional_entropy(docs: DataFrame) -> DataFrame:
    """RES-01: entropy of the next word given the word, in bits."""
    rows = T.token_rows(docs).withColumn("b", F.lead("token").over(by_doc().orderBy("pos"))).where("b is not null")
    n = rows.groupBy("doc_id", F.col("token").alias("a"), "b").agg(F.count(F.lit(1)).alias("n"))
    p = n.select("doc_id", (F.col("n") / F.sum("n").over(by_doc())).alias("p"), (F.col("n") / F.sum("n").over(Window.partitionBy("doc_id", "a"))).alias("c"))
    return p.groupBy("doc_id").agg(r6(-F.sum(F.col("p") * F.log2("c"))).alias("entropy"))


PRONOUNS, SPLICE_OPENERS = L.PRONOUNS, L.SPLICE_OPENERS


def comma_splices(docs: DataFrame) -> DataFrame:
    """DET-13: parts between commas of three words or more that open with a pronoun, less one, per sentence; ten sentences at least."""
    first = lambda w: F.regexp_replace(F.lower(F.get(w, 0)), r"[^\p{L}]", "")
    parts = F.transform(F.split("text", ","), lambda p: T.ws_words(p))
    hits = F.size(F.filter(parts, lambda w: (F.size(w) >= 3) & first(w).isin(*SPLICE_OPENERS)))
    rows = docs.select("doc_id", hits.alias("h"), F.size(T.sentences_b(F.col("text"))).alias("s")).where("s >= 10")
    return rows.select("doc_id", r6(F.greatest(F.col("h") - 1, F.lit(0)) / F.col("s")).alias("ratio"))


def passive_clustering(docs: DataFrame) -> DataFrame:
    """DET-08: variance of the share of passive sentences over runs of a quarter of them; twenty sentences at least."""
    s = docs.select("doc_id", T.sentences_b(F.col("text")).alias("s")).where(F.size("s") >= 20).select("doc_id", F.expr("size(s) div 4").alias("k"), F.posexplode("s").alias("i", "sentence"))
    clean = F.lower(F.regexp_replace(F.regexp_replace("sentence", r"[^\p{L}\s]", ""), r"\s+", " "))
    hit = F.concat(F.lit(" "), clean, F.lit(" ")).rlike(r" (?:was|were|is|are|been|being) [^ ]*(?:ed|en) ")
    runs = s.groupBy("doc_id", F.expr("i div k").alias("run")).agg(F.avg(hit.cast("double")).alias("r"))
    return runs.groupBy("doc_id").agg(r6(F.var_samp("r")).alias("clustering"))


def pronoun_shifts(docs: DataFrame) -> DataFrame:
    """DET-22: share of changes between successive sentences that open with a pronoun."""
    rows = _first_words(docs).where(F.col("w").isin(*PRONOUNS)).withColumn("before", F.lag("w").over(by_doc().orderBy("idx"))).where("before is not null")
    return rows.groupBy("doc_id").agg(r6(F.avg((F.col("w") != F.col("before")).cast("double"))).alias("shifts"))


def diversity_length(docs: DataFrame) -> DataFrame:
    """DET-06: correlation over token windows of the type-token ratio with the mean length of the sentences in proportion."""
    return K.mapped(docs, ["doc_id"], measures.diversity_of, {"correlation": pa.float64()})
