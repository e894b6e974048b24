"""Metrics of scores and labels. ``predictions`` gives a deterministic score to measure: length against the label."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from scriptorium.operators.profiles import r6


def predictions(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """(doc_id, grp, y, score, pred)."""
    score = F.round(F.least(F.col("n_chars") / 5000.0, F.lit(1.0)), 2)
    return docs.join(labels, "doc_id").select("doc_id", F.col("lang").alias("grp"), F.col("quality").cast("int").alias("y"), score.alias("score"), (score >= 0.5).cast("int").alias("pred"))


def confusion(p: DataFrame) -> DataFrame:
    """AGG-15: counts of actual and predicted classes."""
    return p.groupBy(F.col("y").alias("actual"), F.col("pred").alias("predicted")).agg(F.count(F.lit(1)).alias("n"))


def binary_metrics(p: DataFrame) -> DataFrame:
    """AGG-15, 16, MSC-01, 11: accuracy, precision, recall, F1 and the mean of both error rates."""
    hit = lambda y, k: F.count_if((F.col("y") == y) & (F.col("pred") == k))
    c = p.agg(hit(1, 1).alias("tp"), hit(0, 1).alias("fp"), hit(1, 0).alias("fn"), hit(0, 0).alias("tn"))
    tp, fp, fn, tn = (F.col(x) for x in ("tp", "fp", "fn", "tn"))
    return c.select("tp", "fp", "fn", "tn", r6((tp + tn) / (tp + fp + fn + tn)).alias("accuracy"), r6(tp / (tp + fp)).alias("precision"), r6(tp / (tp + fn)).alias("recall"), r6(2 * tp / (2 * tp + fp + fn)).alias("f1"), r6((fp / (fp + tn) + fn / (fn + tp)) / 2).alias("eer"))


def roc(p: DataFrame) -> DataFrame:
    """Points of the ROC curve, one for each distinct score: first aggregated, so the running sums go over scores, not rows."""
    s = p.groupBy("score").agg(F.sum("y").alias("pos"), F.sum(1 - F.col("y")).alias("neg"))
    upto = Window.orderBy(F.desc("score"))
    every = Window.partitionBy()
    return s.select("score", (F.sum("pos").over(upto) / F.sum("pos").over(every)).alias("tpr"), (F.sum("neg").over(upto) / F.sum("neg").over(every)).alias("fpr"))


def auc(p: DataFrame, target: float = 0.02) -> DataFrame:
    """AGG-17, ML-13: trapezoid AUC, and the true positive rate at a false positive rate."""
    order = Window.orderBy(F.desc("score"))
    step = roc(p).withColumn("t0", F.coalesce(F.lag("tpr").over(order), F.lit(0.0))).withColumn("f0", F.coalesce(F.lag("fpr").over(order), F.lit(0.0)))
    return step.agg(r6(F.sum((F.col("fpr") - F.col("f0")) * (F.col("tpr") + F.col("t0")) / 2)).alias("auc"), r6(F.coalesce(F.max(F.when(F.col("fpr") <= target, F.col("tpr"))), F.lit(0.0))).alias("tpr_at_fpr"))


def right_riemann_auc(p: DataFrame) -> DataFrame:
    """AGG-18: area by right sums."""
    order = Window.orderBy(F.desc("score"))
    step = roc(p).withColumn("f0", F.coalesce(F.lag("fpr").over(order), F.lit(0.0)))
    return step.agg(r6(F.sum((F.col("fpr") - F.col("f0")) * F.col("tpr"))).alias("auroc"))


def equal_error(p: DataFrame) -> DataFrame:
    """MSC-12: the ROC point where false positives and misses are closest."""
    gap = F.round(F.abs(F.col("fpr") - (1 - F.col("tpr"))), 9)
    best = roc(p).agg(F.min(F.struct(gap.alias("gap"), (-F.col("score")).alias("s"), "fpr", "tpr")).alias("x"))
    return best.select((-F.col("x.s")).alias("threshold"), r6((F.col("x.fpr") + 1 - F.col("x.tpr")) / 2).alias("eer"))


def calibration(p: DataFrame, bins: int = 10) -> DataFrame:
    """AGG-19, 20: expected calibration error with (lo, hi] and with floor bins, and the Brier score."""
    rows = p.withColumn("up", F.ceil(F.col("score") * bins)).withColumn("down", F.least(F.floor(F.col("score") * bins), F.lit(bins - 1)))

    def ece(b: str) -> DataFrame:
        some = rows.where(F.col(b) > 0) if b == "up" else rows
        per = some.groupBy(b).agg(F.count(F.lit(1)).alias("n"), F.abs(F.avg("score") - F.avg("y")).alias("gap"))
        return per.agg(F.sum(F.col("n") * F.col("gap")).alias(f"s_{b}"))

    total = rows.agg(F.count(F.lit(1)).alias("n"), r6(F.avg(F.pow(F.col("score") - F.col("y"), 2))).alias("brier"))
    return total.crossJoin(ece("up")).crossJoin(ece("down")).select(r6(F.col("s_up") / F.col("n")).alias("ece_closed"), r6(F.col("s_down") / F.col("n")).alias("ece_floor"), "brier")  # three single rows


def threshold_at(p: DataFrame, target: float = 0.1) -> DataFrame:
    """AGG-21: the smallest score whose false positive rate stays within the target."""
    return roc(p).where(F.col("fpr") <= target).agg(F.min("score").alias("threshold"), r6(F.max("fpr")).alias("fpr"))


def bias(p: DataFrame) -> DataFrame:
    """AGG-22, ADV-03: mean, spread and 95 % interval of each group; whether consecutive groups' intervals overlap."""
    g = p.groupBy("grp").agg(F.count(F.lit(1)).alias("n"), F.avg("score").alias("m"), F.stddev_samp("score").alias("s"))
    half = 1.96 * F.col("s") / F.sqrt("n")
    g = g.withColumn("lo", F.col("m") - half).withColumn("hi", F.col("m") + half)
    order = Window.orderBy("grp")
    overlap = (F.lag("hi").over(order) >= F.col("lo")) & (F.lag("lo").over(order) <= F.col("hi"))
    return g.select("grp", "n", r6(F.col("m")).alias("mean"), r6(F.col("s")).alias("sd"), r6(F.col("lo")).alias("lo"), r6(F.col("hi")).alias("hi"), F.coalesce(overlap, F.lit(False)).alias("overlaps_previous"), r6(F.max("m").over(Window.partitionBy()) - F.min("m").over(Window.partitionBy())).alias("disparity"))
