"""The machine-learning surface on pyspark.ml: vectors of text features, classifiers, ensembles, folds, calibration."""

from __future__ import annotations

from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.classification import GBTClassifier, LinearSVC, LogisticRegression, RandomForestClassifier
from pyspark.ml.feature import Imputer, StandardScaler, VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.ml.regression import IsotonicRegression
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from scriptorium.operators import corpus, profiles

COLUMNS = ["ttr", "hapax_ratio", "avg_word_length", "yule_k", "flesch_kincaid", "avg_syllables", "comma_rate", "hedge_ratio"]


def feature_table(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """MSC-15, ML-01: one row of scalar features per labelled document."""
    rows = labels.select("doc_id", F.col("quality").cast("double").alias("label")).join(docs, "doc_id").select("doc_id", "label", "text", "lang")
    out = rows.select("doc_id", "label", "lang")
    for part in (profiles.lexical(rows), profiles.readability(rows), profiles.mark_rates(rows), profiles.style_words(rows)):
        out = out.join(part.select("doc_id", *[c for c in COLUMNS if c in part.columns]), "doc_id", "left")
    return out


def pipeline(kind: str = "logistic") -> Pipeline:
    """ML-02, 05, 06, 10, 14: median imputation, standard scores, and a classifier."""
    models = {"logistic": LogisticRegression(maxIter=20), "forest": RandomForestClassifier(numTrees=20, seed=42), "boosted": GBTClassifier(maxIter=10, seed=42), "svm": LinearSVC(maxIter=20)}
    return Pipeline(stages=[Imputer(strategy="median", inputCols=COLUMNS, outputCols=[f"{c}_i" for c in COLUMNS]), VectorAssembler(inputCols=[f"{c}_i" for c in COLUMNS], outputCol="raw_features"), StandardScaler(inputCol="raw_features", outputCol="features", withMean=True), models[kind]])


def train(rows: DataFrame, kind: str = "logistic") -> PipelineModel:
    return pipeline(kind).fit(rows)


def scores(model: PipelineModel, rows: DataFrame) -> DataFrame:
    """(doc_id, label, score): probability of class 1, or the logistic of an SVM's margin."""
    out = model.transform(rows)
    score = vector_to_array("probability")[1] if "probability" in out.columns else 1 / (1 + F.exp(-vector_to_array("rawPrediction")[1]))
    return out.select("doc_id", "label", score.alias("score"))


def ensemble(rows: DataFrame, weights: dict[str, float] | None = None) -> DataFrame:
    """ML-11, SCO-14: weighted mean of several models' scores."""
    weights = weights or {"boosted": 0.7, "logistic": 0.2, "svm": 0.1}
    out = rows.select("doc_id", "label")
    for kind in weights:
        out = out.join(scores(train(rows, kind), rows).select("doc_id", F.col("score").alias(kind)), "doc_id")
    return out.select("doc_id", "label", (sum(w * F.col(k) for k, w in weights.items()) / sum(weights.values())).alias("score"))


def cross_validate(rows: DataFrame, k: int = 3, kind: str = "logistic") -> DataFrame:
    """ML-07, WIN-08: out-of-fold scores over stratified folds."""
    folds = rows.join(corpus.folds(rows.select("doc_id", F.col("label").cast("string").alias("lang")), k).select("doc_id", "fold"), "doc_id")
    parts = [scores(train(folds.where(F.col("fold") != i), kind), folds.where(F.col("fold") == i)).withColumn("fold", F.lit(i)) for i in range(k)]
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part)
    return out


def calibrated(scored: DataFrame) -> DataFrame:
    """ML-12: isotonic calibration of scores."""
    rows = scored.withColumn("features", F.col("score"))
    return IsotonicRegression(labelCol="label", featuresCol="score", predictionCol="calibrated").fit(scored).transform(rows).select("doc_id", "label", "score", "calibrated")
