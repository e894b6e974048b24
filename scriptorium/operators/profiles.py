"""Lexical, syntactic, semantic and stylistic profiles: one row per document or per document and unit."""

from __future__ import annotations

from functools import reduce

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from scriptorium.functions import kernels as K
from scriptorium.functions import lexicons as L
from scriptorium.functions import text as T
from scriptorium.operators import measures


def r6(x: Column) -> Column:
    return F.round(x, 6)


def half_away(x: Column, digits: int) -> Column:
    """Rounded as the checking SQL rounds doubles: the scaled double itself, halves away from zero.

    ``F.round`` rounds the shortest decimal that spells the double, so the two differ where that decimal ends in a 5 and the double lies beside it.
    """
    scale = float(10**digits)
    return F.round(x * scale, 0) / scale


def ratio(a: Column, b: Column) -> Column:
    """a / b, 0 where b is 0."""
    return F.when(b == 0, 0.0).otherwise(a / b)


def pearson(x: str, y: str) -> Column:
    """AGG-08: Pearson's r as an aggregate, 0 where either side is constant."""
    spread = F.stddev_pop(x) * F.stddev_pop(y)
    return F.when(spread < 1e-12, 0.0).otherwise(F.covar_pop(x, y) / F.nullif(spread, F.lit(0.0)))


def lexical(docs: DataFrame) -> DataFrame:
    """LEX-01, 02, 03, 05, 06, 07: richness of a document's vocabulary from its token counts."""
    per = T.token_counts(docs).groupBy("doc_id").agg(
        F.sum("n").alias("total"), F.count(F.lit(1)).alias("distinct"), F.count_if(F.col("n") == 1).alias("hapax"), F.count_if(F.col("n") == 2).alias("dis"),
        F.sum(F.col("n") * F.octet_length("token")).alias("bytes"), F.sum(F.col("n") * F.col("n")).alias("squares"),
    )
    n, v = F.col("total"), F.col("distinct")
    return per.select(
        "doc_id", "total", "distinct", "hapax", "dis",
        r6(v / n).alias("ttr"), r6(F.col("hapax") / n).alias("hapax_ratio"), r6(ratio(F.col("hapax").cast("double"), F.col("dis"))).alias("hapax_dis_ratio"),
        r6(F.col("bytes") / n).alias("avg_word_length"), r6(F.greatest(1e4 * (F.col("squares") - n) / (n * n), F.lit(0.0))).alias("yule_k"),
        r6(F.when(F.col("hapax") == v, 0.0).otherwise(100 * F.ln(n) / (1 - F.col("hapax") / v))).alias("honore_r"), r6(F.pow(n, F.pow(v, F.lit(-0.172)))).alias("brunet_w"),
    )


def word_lengths(docs: DataFrame) -> DataFrame:
    """LEX-03: histogram of word lengths in bytes."""
    return T.token_counts(docs).groupBy("doc_id", F.octet_length("token").alias("bytes")).agg(F.sum("n").alias("n"))


def mattr(docs: DataFrame, width: int = 500) -> DataFrame:
    """LEX-04: mean type-token ratio over all windows, from each token's previous place; no window is built."""
    rows = T.token_rows(docs)
    previous = F.coalesce(F.lag("pos").over(Window.partitionBy("doc_id", "token").orderBy("pos")), F.lit(-1))
    sizes = docs.select("doc_id", F.size(T.tokens(F.col("text"))).alias("n"))
    rows = rows.withColumn("prev", previous).join(sizes, "doc_id")
    new_in = F.greatest(F.lit(0), F.least("pos", F.col("n") - width) - F.greatest(F.col("prev") + 1, F.col("pos") - (width - 1), F.lit(0)) + 1)
    per = rows.groupBy("doc_id").agg(F.first("n").alias("n"), F.sum(new_in).alias("found"), F.count_if(F.col("prev") == -1).alias("distinct"))
    value = F.when(F.col("n") < width, F.col("distinct") / F.col("n")).otherwise(F.col("found") / (F.lit(width) * (F.col("n") - width + 1)))
    return per.select("doc_id", r6(value).alias("mattr"))


def sentence_profile(docs: DataFrame) -> DataFrame:
    """SYN-01, 03: sentence counts, lengths and kinds."""
    rows = T.sentence_rows(docs)
    end = lambda mark: F.count_if(F.col("sentence").endswith(mark))
    per = rows.groupBy("doc_id").agg(F.count(F.lit(1)).alias("sentences"), F.avg("n_ws").alias("w"), F.avg(F.octet_length("sentence")).alias("b"), F.coalesce(F.var_samp("n_ws"), F.lit(0.0)).alias("var"), end("?").alias("questions"), end("!").alias("exclamations"))
    return per.select("doc_id", "sentences", r6(F.col("w")).alias("avg_words"), r6(F.col("b")).alias("avg_bytes"), r6(F.col("var")).alias("var_words"), "questions", "exclamations", (F.col("sentences") - F.col("questions") - F.col("exclamations")).alias("statements"), r6(F.col("questions") / F.col("sentences")).alias("question_ratio"))


def sentence_lengths(docs: DataFrame) -> DataFrame:
    """SYN-02: histogram of sentence lengths in words."""
    return T.sentence_rows(docs).groupBy("doc_id", F.col("n_ws").cast("long").alias("words")).agg(F.count(F.lit(1)).alias("n"))


def sentence_openings(docs: DataFrame) -> DataFrame:
    """SYN-04: how often each word opens a sentence."""
    first = F.regexp_replace(F.lower(F.get(F.split("sentence", r"\s+"), 0)), r"[^\p{L}]", "")
    return T.sentence_rows(docs).select("doc_id", first.alias("opening")).where("opening <> ''").groupBy("doc_id", "opening").agg(F.count(F.lit(1)).alias("n"))


def passive(docs: DataFrame) -> DataFrame:
    """SYN-05: share of sentences with a form of be before a word in ed, en, wn or nt."""
    clean = F.lower(F.regexp_replace(F.regexp_replace("sentence", r"[^\p{L}\s]", ""), r"\s+", " "))
    hit = F.concat(F.lit(" "), clean, F.lit(" ")).rlike(rf" (?:{'|'.join(L.BE_FORMS)}) [^ ]*(?:ed|en|wn|nt) ")
    return T.sentence_rows(docs).groupBy("doc_id").agg(F.count_if(hit).alias("passive"), r6(F.avg(hit.cast("double"))).alias("passive_ratio"))


def paragraph_profile(docs: DataFrame, delimiter: str = "\n") -> DataFrame:
    """SEM-01, STY-06: paragraph count, mean length, variance and share of short ones, in bytes."""
    rows = docs.select("doc_id", F.explode(T.paragraphs(F.col("text"), delimiter)).alias("p"))
    size = F.octet_length("p")
    per = rows.groupBy("doc_id").agg(F.count(F.lit(1)).alias("paragraphs"), F.avg(size).alias("m"), F.coalesce(F.var_samp(size), F.lit(0.0)).alias("v"), F.avg((size < 50).cast("double")).alias("s"))
    return per.select("doc_id", "paragraphs", r6(F.col("m")).alias("avg_bytes"), r6(F.col("v")).alias("var_bytes"), r6(F.col("s")).alias("short_ratio"))


def listed(words: list[str]) -> Column:
    return F.col("token").isin(*words)


def discourse(docs: DataFrame) -> DataFrame:
    """SEM-02: discourse markers, single by token, multi by place in the joined tokens."""
    toks = T.tokens(F.col("text"))
    joined = F.array_join(toks, " ")
    single = F.size(F.filter(toks, lambda w: w.isin(*L.DISCOURSE_SINGLE)))
    multi = reduce(lambda a, b: a + b, [T.occurrences(F.col("joined"), p) for p in L.DISCOURSE_MULTI])
    rows = docs.select("doc_id", F.size(toks).cast("long").alias("n"), single.cast("long").alias("single"), joined.alias("joined"))
    return rows.select("doc_id", "single", multi.alias("multi"), r6(ratio((F.col("single") + multi) * 1000.0, F.col("n"))).alias("per_1000"))


def readability(docs: DataFrame) -> DataFrame:
    """SEM-03 to 07: Flesch-Kincaid, Gunning Fog, Coleman-Liau, ARI and syllables per word."""
    counts = T.token_counts(docs).withColumn("syl", T.syllables(F.col("token")))
    per = counts.groupBy("doc_id").agg(F.sum("n").alias("w"), F.sum(F.col("n") * F.col("syl")).alias("syl"), F.sum(F.when(F.col("syl") >= 3, F.col("n")).otherwise(0)).alias("hard"), F.sum(F.col("n") * F.octet_length("token")).alias("c"))
    rows = per.join(docs.select("doc_id", T.sentence_marks(F.col("text")).alias("s")), "doc_id")
    w, s, c = F.col("w"), F.col("s"), F.col("c")
    return rows.select(
        "doc_id", r6(0.39 * w / s + 11.8 * F.col("syl") / w - 15.59).alias("flesch_kincaid"), r6(0.4 * (w / s + 100.0 * F.col("hard") / w)).alias("gunning_fog"),
        r6(5.88 * c / w - 29.6 * s / w - 15.8).alias("coleman_liau"), r6(4.71 * c / w + 0.5 * w / s - 21.43).alias("ari"), r6(F.col("syl") / w).alias("avg_syllables"),
    )


def punctuation(docs: DataFrame) -> DataFrame:
    """STY-01: histogram of punctuation marks."""
    marks = F.explode(F.filter(F.split("text", ""), lambda c: c.isin(*L.PUNCTUATION)))
    return docs.select("doc_id", marks.alias("mark")).groupBy("doc_id", "mark").agg(F.count(F.lit(1)).alias("n"))


def mark_rates(docs: DataFrame) -> DataFrame:
    """STY-02, 03: marks per byte, dashes, ellipses, brackets and quotes."""
    t = F.col("text")
    size = F.octet_length(t)
    em = T.occurrences(t, "—") + T.occurrences(t, "---") + T.occurrences(t, " -- ")
    rates = [r6(T.occurrences(t, m) / size).alias(name) for m, name in (("!", "exclamation_rate"), ("?", "question_rate"), (",", "comma_rate"), (";", "semicolon_rate"), (":", "colon_rate"))]
    return docs.where(size > 0).select("doc_id", *rates, em.alias("em_dashes"), T.occurrences(t, "–").alias("en_dashes"), F.greatest(T.occurrences(t, "-") - 3 * em, F.lit(0)).cast("long").alias("hyphens"), (T.occurrences(t, "…") + T.occurrences(t, "...")).alias("ellipses"), T.occurrences(t, "(").alias("brackets"), T.occurrences(t, '"').alias("quotes"))


def style_words(docs: DataFrame) -> DataFrame:
    """STY-04, 05: contractions, hedges and intensifiers."""
    n = F.col("n")
    some = lambda c: F.sum(F.when(c, n).otherwise(0))
    contraction = (F.col("token") == "cannot") | (F.col("token").contains("'") & (F.octet_length("token") > 2))
    per = T.token_counts(docs).groupBy("doc_id").agg(F.sum("n").alias("w"), some(contraction).alias("contractions"), some(listed(L.HEDGES)).alias("hedges"), some(listed(L.INTENSIFIERS)).alias("intensifiers"))
    return per.select("doc_id", "contractions", "hedges", "intensifiers", r6(F.col("hedges") / F.col("w")).alias("hedge_ratio"), r6(F.col("intensifiers") / F.col("w")).alias("intensifier_ratio"))


def function_word_rates(docs: DataFrame) -> DataFrame:
    """FNW-01: occurrences per 1000 words of each function word, by a semi-join with the lexicon."""
    counts = T.token_counts(docs)
    lexicon = docs.sparkSession.createDataFrame([(w,) for w in L.FUNCTION_WORDS], "token string")
    sizes = docs.select("doc_id", F.size(T.tokens(F.col("text"))).alias("w"))
    return counts.join(F.broadcast(lexicon), "token", "left_semi").join(sizes, "doc_id").select("doc_id", "token", r6(1000.0 * F.col("n") / F.col("w")).alias("per_1000"))


def function_word_summary(docs: DataFrame) -> DataFrame:
    """FNW-02: share and diversity of function words."""
    per = T.token_counts(docs).groupBy("doc_id").agg(F.sum("n").alias("w"), F.sum(F.when(listed(L.FUNCTION_WORDS), F.col("n")).otherwise(0)).alias("f"), F.count_if(listed(L.FUNCTION_WORDS)).alias("kinds"))
    return per.select("doc_id", r6(F.col("f") / F.col("w")).alias("ratio"), r6(ratio(F.col("kinds").cast("double"), F.col("f"))).alias("diversity"))


def top_ngrams(docs: DataFrame, kind: str = "wb", keep: int = 500) -> DataFrame:
    """NGR-01: relative frequencies of the most frequent n-grams of a document; ties by gram. Counted and ranked within the row."""
    return K.mapped(docs, ["doc_id"], lambda text: measures.top_ngrams(text, kind, keep), {"gram": pa.string(), "rank": pa.int32(), "freq": pa.float64()})
