"""All scored detection features of a text in one pass over its row.

Every feature is read off the text's words, sentences and paragraphs, which a kernel makes once; nothing is exploded and nothing is shuffled,
so the plan is one narrow step at any scale.
"""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from scriptorium.functions import kernels as K
from scriptorium.functions import lexicons as L
from scriptorium.functions import text as T
from scriptorium.functions.dialect import SPARK, Dialect, let, quoted
from scriptorium.functions.text import run_lengths
from scriptorium.operators import measures
from scriptorium.operators.measures import TAGS, verb_forms

NAMES = list(measures.FEATURES)
#: The features as the columns of a kernel.
FIELDS = dict.fromkeys(NAMES, pa.float64())


def tag_sql(d: Dialect, w: str) -> str:
    """TOK-12: number in TAGS of a lower-cased word's part of speech: by dictionary, digits, then suffix; a noun otherwise."""
    lists = [L.POS_DETERMINERS, L.POS_PRONOUNS, L.POS_PREPOSITIONS, L.POS_CONJUNCTIONS, L.MODALS, L.POS_AUXILIARIES, L.POS_PARTICLES, L.POS_ADVERBS, L.POS_ADJECTIVES, verb_forms(), L.POS_NOUNS]
    cases = [f"WHEN {w} IN ({d.words(words)}) THEN {i}" for i, words in enumerate(lists)]
    cases.append(f"WHEN translate({w}, '0123456789.,', '') = '' THEN {TAGS.index('NUM')}")
    for tag, endings, longer in L.POS_SUFFIXES:
        test = " OR ".join(f"{w} LIKE '%{e}'" for e in endings)
        cases.append(f"WHEN ({test}){f' AND {d.bytes(w)} > {longer}' if longer else ''} THEN {TAGS.index(tag)}")
    return f"CASE {' '.join(cases)} ELSE {TAGS.index('NOUN')} END"


def entropy(counts: str) -> str:
    """Of an array of counts, in bits."""
    n = f"aggregate({counts}, 0L, (a, x) -> a + x)"
    return let(n, "n_", f"-aggregate({counts}, 0D, (a, c) -> a + (c / n_) * log2(c / n_))")


def features(docs: DataFrame, *keys: str, delimiter: str = "\n\n") -> DataFrame:
    """DET-28, PAR-01: ``keys`` and one column for each scored feature, null where the text is too short for it."""
    return K.mapped(docs, list(keys or ("doc_id",)), lambda text: [measures.features(text, delimiter)], FIELDS)


def tagged(docs: DataFrame) -> DataFrame:
    """TOK-12: how often each part of speech occurs in a document."""
    tags = F.expr(f"transform({SPARK.tokens('text')}, w -> {tag_sql(SPARK, 'w')})")
    rows = docs.select("doc_id", F.explode(tags).alias("t")).groupBy("doc_id", "t").agg(F.count(F.lit(1)).alias("n"))
    return rows.select("doc_id", F.get(F.array(*map(F.lit, TAGS)), F.col("t")).alias("tag"), "n")


def pos_entropy(docs: DataFrame) -> DataFrame:
    """DET-05: entropies of tag trigrams and bigrams, 20 words at least."""
    rows = docs.select("doc_id", F.expr(f"transform({SPARK.tokens('text')}, w -> {tag_sql(SPARK, 'w')})").alias("t")).where(F.size("t") >= 20)
    rows = rows.select("doc_id", F.expr("sort_array(transform(sequence(1, size(t) - 2), i -> get(t, i - 1) * 144 + get(t, i) * 12 + get(t, i + 1)))").alias("tri"), F.expr("sort_array(transform(sequence(1, size(t) - 1), i -> get(t, i - 1) * 12 + get(t, i)))").alias("bi"))
    rows = rows.select("doc_id", F.expr(run_lengths("tri")).alias("c3"), F.expr(run_lengths("bi")).alias("c2"), F.size("tri").cast("long").alias("total"))
    return rows.select("doc_id", F.round(F.expr(entropy("c3")), 6).alias("trigram_entropy"), F.size("c3").cast("long").alias("unique_trigrams"), "total", F.round(F.expr(entropy("c2")), 6).alias("bigram_entropy"))


def determiner_distance(docs: DataFrame, reach: int = 7) -> DataFrame:
    """DET-16, JOI-08: mean distance from a determiner to the first noun-like word within ``reach``; 100 words at least."""
    nounlike = f"octet_length(w) > 2 and not (w like '%ly' or w like '%ful' or w like '%ous' or w like '%ive') and not w IN ({quoted(L.DETERMINERS)})"
    rows = docs.select("doc_id", T.tokens(F.col("text")).alias("t")).where(F.size("t") >= 100)
    rows = rows.select("doc_id", "t", F.expr(f"filter(sequence(1, size(t)), i -> get(t, i - 1) IN ({quoted(L.DETERMINERS)}))").alias("at"))
    first = f"array_min(filter(sequence(1, {reach}), j -> exists(slice(t, i + j, 1), w -> {nounlike})))"
    rows = rows.select("doc_id", F.expr(f"filter(transform(at, i -> {first}), x -> x is not null)").alias("d"))
    return rows.select("doc_id", F.size("d").cast("long").alias("pairs"), F.round(F.expr("if(size(d) = 0, 0D, aggregate(d, 0D, (a, x) -> a + x) / size(d))"), 6).alias("distance"))


def function_word_clusters(docs: DataFrame, size: int = 200) -> DataFrame:
    """DET-27: spread of the share of function words over windows, and mean divergence of consecutive windows."""
    words = f"array({quoted(L.CLUSTER_WORDS)})"
    rows = docs.select("doc_id", T.tokens(F.col("text")).alias("t")).where(F.size("t") >= 3 * size).select("doc_id", "t", F.expr(f"size(t) div {size}").alias("k"))
    rows = rows.select("doc_id", "k", F.expr(f"transform(sequence(0, k - 1), i -> filter(slice(t, i * {size} + 1, {size}), w -> array_contains({words}, w)))").alias("w"))
    rows = rows.select("doc_id", "k", "w", F.expr(f"transform(w, x -> size(x) / {float(size)}D)").alias("r"))
    p = lambda i: f"(size(filter(get(w, {i}), y -> y = x)) / {float(size)}D)"
    half = lambda a, b: f"if({a} > 0, {a} * ln({a} / (({a} + {b}) / 2)), 0D)"
    one = f"aggregate(array_union(get(w, i - 1), get(w, i)), 0D, (acc, x) -> acc + {half(p('i - 1'), p('i'))} + {half(p('i'), p('i - 1'))}) / 2"
    divergence = f"aggregate(transform(sequence(1, k - 1), i -> greatest({one}, 0D)), 0D, (acc, x) -> acc + x) / (k - 1)"
    cv = f"if({SPARK.mean('r')} > 1e-15, sqrt({SPARK.sample_variance('r')}) / {SPARK.mean('r')}, 0D)"
    return rows.select("doc_id", F.col("k").alias("windows"), F.round(F.expr(cv), 6).alias("ratio_cv"), F.round(F.expr(divergence), 6).alias("divergence"))
