"""Scores, tiers and comparisons over long feature tables (doc_id, feature, value)."""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from scriptorium.functions import kernels as K
from scriptorium.functions import lexicons as L
from scriptorium.functions import text as T
from scriptorium.functions.dialect import SPARK
from scriptorium.operators import countermeasures as M
from scriptorium.operators import detection as D
from scriptorium.operators import fused as U
from scriptorium.operators import measures
from scriptorium.operators import register as R
from scriptorium.operators.profiles import half_away, r6

#: Feature, centre, steepness, weight, whether the absolute value counts.
SCORE_PARAMS = [
    ("burstiness", 0.30, -15.0, 0.22, False), ("zipf_deviation", 0.10, -20.0, 0.20, False), ("hedge_ratio", 1.05, -3.0, 0.15, False),
    ("autocorrelation", 0.05, 15.0, 0.13, False), ("pos_entropy", 4.7, -3.0, 0.12, False), ("diversity_length", 0.10, 8.0, 0.09, False),
    ("repetition_delta", 0.05, -10.0, 0.09, False), ("passive_clustering", 0.01, -50.0, 0.03, False), ("transition_density", 15.0, 0.3, 0.03, False),
    ("paragraph_cv", 0.40, -5.0, 0.03, False), ("opening_diversity", 0.50, -5.0, 0.03, False), ("nested_clauses", 0.25, -5.0, 0.03, False),
    ("comma_splices", 0.01, -100.0, 0.03, False), ("sophistication_slope", 0.03, -30.0, 0.02, True), ("register_consistency", 0.02, -30.0, 0.02, False),
    ("initial_adverbs", 0.08, 15.0, 0.02, False), ("modal_density", 12.0, 0.2, 0.02, False), ("punctuation_entropy", 2.0, -2.0, 0.02, False),
    ("enumeration", 0.10, 15.0, 0.02, False), ("paragraph_overlap", 0.08, -10.0, 0.02, False),
]
#: Upper bounds of the score tiers, their names and actions.
TIERS = [(0.15, "HUMAN AUTHORED", "Accept"), (0.35, "LIKELY HUMAN", "Accept with note"), (0.65, "MIXED / UNCERTAIN", "Human review required"), (0.85, "AI ASSISTED", "Investigation recommended"), (None, "AI GENERATED", "Policy enforcement action")]
MIN_WORDS = 500

#: Words of a heatmap's window, and from one window to the next.
HEAT_SIZE, HEAT_STEP = 300, 75
PARAMS = {name: rest for name, *rest in SCORE_PARAMS}


def one_score(name: str) -> str:
    """SCO-01 of a feature's column, as SQL."""
    centre, steepness, _, absolute = PARAMS[name]
    return f"1e0 / (1e0 + exp(-({steepness}) * ({f'abs({name})' if absolute else name} - {centre})))"


def score_sql() -> str:
    """SCO-02: weighted mean of the present features' scores, 0.5 if there is none, as SQL over the features' columns."""
    top = " + ".join(f"coalesce({w}e0 * ({one_score(n)}), 0e0)" for n, (_, _, w, _) in PARAMS.items())
    weight = " + ".join(f"CASE WHEN {n} IS NULL THEN 0e0 ELSE {w}e0 END" for n, (_, _, w, _) in PARAMS.items())
    return f"coalesce(least(greatest(({top}) / nullif({weight}, 0e0), 0e0), 1e0), 0.5e0)"


def used_sql() -> str:
    return "(" + " + ".join(f"CASE WHEN {n} IS NULL THEN 0 ELSE 1 END" for n in PARAMS) + ")"


def logistic(x: Column, centre: Column | float, steepness: Column | float) -> Column:
    """SCO-01."""
    return 1.0 / (1.0 + F.exp(-steepness * (x - centre)))


def gated(docs: DataFrame, words: int = MIN_WORDS) -> DataFrame:
    """FLT-01: documents of ``words`` white-space words or more."""
    return docs.where((F.octet_length("text") >= 2 * words - 1) & (F.regexp_count("text", F.lit(r"\S+")) >= words))


def rounded(features: DataFrame, *keys: str | Column) -> DataFrame:
    return features.select(*keys, *[half_away(F.col(n), 6).alias(n) for n in U.NAMES])


def features(docs: DataFrame) -> DataFrame:
    """DET-28: all features of the documents that are long enough, one row each; absent ones are null."""
    return rounded(U.features(gated(docs)), "doc_id")


def feature_scores(docs: DataFrame) -> DataFrame:
    """SCO-01: (doc_id, feature, value, score) of each present feature."""
    rows = features(docs)
    pairs = F.array(*[F.struct(F.lit(n).alias("feature"), F.col(n).alias("value"), F.expr(one_score(n)).alias("score")) for n in U.NAMES])
    return rows.select("doc_id", F.explode(F.filter(pairs, lambda x: x["value"].isNotNull())).alias("x")).select("doc_id", "x.*")


def composite(docs: DataFrame) -> DataFrame:
    """SCO-02, 04: weighted mean of the present features' scores, with its tier and action."""
    per = features(docs).select("doc_id", F.expr(used_sql()).cast("long").alias("features"), F.round(F.expr(score_sql()), 4).alias("score"))
    return per.select("doc_id", "features", "score", tier(F.col("score"), 1).alias("tier"), tier(F.col("score"), 2).alias("action"))


def detect(docs: DataFrame) -> DataFrame:
    """SCO-03, 09, 10: the detector. Boilerplate is left out if enough text remains; register and countermeasures adjust the score.

    A kernel reads each text once; the countermeasures read the original text, the score the chosen one.
    """
    adjusting = ("nnes_adjustment", "editing_adjustment", "humanizer_adjustment")

    def measure(text: str) -> list[tuple]:
        scored = measures.chosen(text, MIN_WORDS)
        return [(*measures.features(scored), *measures.register(scored), *measures.adjustments(text))]

    register = {f"r_{n}": kind for n, kind in R.FIELDS.items()}
    measured = K.mapped(gated(docs), ["doc_id"], measure, {**U.FIELDS, **register, **dict.fromkeys(adjusting, pa.float64())})
    scored = rounded(measured, "doc_id", *register, *adjusting)
    rows = scored.select("doc_id", F.expr(score_sql()).alias("raw"), F.expr(used_sql()).alias("used"), *adjusting, *[F.col(r).alias(r[2:]) for r in register])
    rows = M.applied(rows, [*R.feature_layers(SPARK)[3:], *R.rule_layers(SPARK)])
    zero, one = F.lit(0.0), F.lit(1.0)
    within = lambda x: F.least(F.greatest(x, zero), one)
    double = lambda c: F.col(c).cast("double")
    adjusted = double("nnes_adjustment") + double("editing_adjustment") + double("humanizer_adjustment")
    rows = rows.withColumn("measures", adjusted).withColumn("score", F.round(within(within(F.col("raw") + double("register_adjustment")) + F.col("measures")), 5))
    unsure = (F.col("used") < 5) & (F.col("score") > 0.15) & (F.col("score") < 0.85)
    return rows.select("doc_id", F.col("used").cast("long").alias("used"), F.round("raw", 5).alias("raw"), "label", F.round("measures", 5).alias("measures"), "score", F.round(F.least(F.col("used") / 7.0, one), 5).alias("confidence"), F.when(unsure, "INCONCLUSIVE").otherwise(tier(F.col("score"), 1)).alias("tier"))


def heatmap(docs: DataFrame) -> DataFrame:
    """SCO-11, TOK-15: score of every window of 300 words, 75 apart. A window's text is its words joined, so sentence features vanish."""

    def windows(text: str) -> list[tuple]:
        words = K.cased_tokens(text)
        return [(win, *measures.features(part)) for win, part in measures.windows(words, HEAT_SIZE, HEAT_STEP)] if len(words) >= HEAT_SIZE else []

    scored = rounded(K.mapped(gated(docs), ["doc_id"], windows, {"win": pa.int64(), **U.FIELDS}), "doc_id", "win")
    return scored.select("doc_id", "win", (F.col("win") * HEAT_STEP).alias("word_start"), (F.col("win") * HEAT_STEP + HEAT_SIZE).alias("word_end"), F.expr(used_sql()).cast("long").alias("features"), half_away(F.expr(score_sql()), 4).alias("score"))


def heat_summary(docs: DataFrame) -> DataFrame:
    """SCO-11: least, greatest and mean score of a document's windows."""
    rows = heatmap(docs).groupBy("doc_id").agg(F.sort_array(F.collect_list(F.struct("win", "score"))).alias("w")).withColumn("s", F.col("w.score"))
    # scores are added in the windows' order, so that a mean halfway between two values is the same each time
    mean = half_away(F.aggregate("s", F.lit(0.0), lambda a, x: a + x) / F.size("s"), 4)
    return rows.select("doc_id", F.size("s").cast("long").alias("windows"), F.array_min("s").alias("lo"), F.array_max("s").alias("hi"), mean.alias("mean"))


def tier(score: Column, part: int) -> Column:
    """SCO-04: name (1) or action (2) of a score's tier."""
    out = None
    for bound, *names in TIERS:
        if bound is None:
            return out.otherwise(names[part - 1])
        out = (F if out is None else out).when(score < bound, names[part - 1])
    raise AssertionError


def explanation(docs: DataFrame, keep: int = 3) -> DataFrame:
    """SCO-13, WIN-03: the features that speak most for a document's score."""
    rank = F.row_number().over(Window.partitionBy("doc_id").orderBy(F.desc(F.round("score", 6)), "feature"))
    return feature_scores(docs).withColumn("rank", rank).where(F.col("rank") <= keep).select("doc_id", "rank", "feature", r6(F.col("score")).alias("score"))


def length_factor(words: Column) -> Column:
    """CNF-01: confidence by length of the text."""
    bounds = [(100, 0.4), (300, 0.6), (500, 0.75), (1000, 0.9), (2000, 0.95)]
    out = F
    for bound, value in bounds:
        out = out.when(words < bound, value)
    return out.otherwise(1.0)


#: Samples from which a mode is chosen, its name, and its weights of the detector and of the author's match.
MODES = [(0, "AI Detection (no baseline)", 1.0, 0.0), (2, "Hybrid (AI detection + stylometric comparison)", 0.55, 0.45), (None, "Authorship Verification (full profile)", 0.25, 0.75)]


def mode_sql(part: int) -> str:
    """Name (1) or weights (2, 3) of the mode for a number of samples."""
    spell = lambda v: f"'{v}'" if isinstance(v, str) else f"{v}e0"
    return "CASE " + " ".join(f"WHEN samples <= {m[0]} THEN {spell(m[part])}" for m in MODES if m[0] is not None) + f" ELSE {spell(MODES[-1][part])} END"


COMPOSITE = f"round(least(greatest({mode_sql(2)} * score + {mode_sql(3)} * (1e0 - confidence), 0e0), 1e0), 4)"
#: MSC-09: what match and score say together.
READING = "CASE WHEN confidence > 0.6 AND score <= 0.5 THEN 'author, human patterns' WHEN confidence > 0.6 THEN 'author, with signs of assistance' WHEN score <= 0.5 THEN 'another hand, or a changed style' ELSE 'neither the author nor human patterns' END"


def multimode(docs: DataFrame) -> DataFrame:
    """SCO-12, JOI-11, MSC-09: the detector's score and the author's match, weighted by how many samples of the author there are."""
    from scriptorium.operators import identity as I

    samples = docs.groupBy("source").agg(F.count(F.lit(1)).alias("samples")).withColumnRenamed("source", "who")
    found = detect(docs).select("doc_id", "score").join(I.compare(docs).select("doc_id", "author", "confidence"), "doc_id").join(samples, F.col("author").eqNullSafe(F.col("who")))
    rows = found.select("doc_id", "author", F.expr(mode_sql(1)).alias("mode"), F.expr(COMPOSITE).alias("composite"), F.expr(READING).alias("reading"))
    return rows.withColumn("tier", tier(F.col("composite"), 1))


def feature_csv(docs: DataFrame, path: str) -> None:
    """SNK-02: label, source, word_count and the features with eight decimals, as CSV with a header."""
    counted = K.mapped(gated(docs), ["doc_id", "source"], lambda text: [(len(K.splitter(text)(text)), *measures.features(text))], {"word_count": pa.int64(), **U.FIELDS})
    rows = rounded(counted, "doc_id", F.col("source").alias("label"), "word_count")
    decimals = [F.format_string("%.8f", F.coalesce(n, F.lit(0.0))).alias(n) for n in U.NAMES]
    rows.select("label", F.col("doc_id").alias("source"), "word_count", *decimals).write.option("header", "true").csv(path)
