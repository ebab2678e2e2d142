"""Forecast models on Spark ML: imputation, logistic regression, boosted trees, calibration."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass
from functools import partial, reduce
from multiprocessing.pool import ThreadPool

from pyspark import SparkContext, inheritable_thread_target
from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.classification import GBTClassificationModel, GBTClassifier, LogisticRegression
from pyspark.ml.feature import Imputer, StandardScaler, VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.ml.regression import IsotonicRegression
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from chronoflux.operators.skill import best_threshold, brier_and_ece, contingency, scores
from chronoflux.session import stage_table

EFFECTIVE_N = 150.0
BAND_Z = 1.64


def class_weights(rows: DataFrame, y: str, train: Column) -> DataFrame:
    """Weight column that balances the classes of the training rows."""
    share = rows.filter(train).agg(F.avg(F.col(y).cast("double")).alias("__s"))
    weight = F.when(F.col(y) == 1, 0.5 / F.greatest("__s", F.lit(1e-9))).otherwise(0.5 / F.greatest(1 - F.col("__s"), F.lit(1e-9)))
    return rows.join(F.broadcast(share)).withColumn("weight", weight).drop("__s")


def _prepared(features: Sequence[str]) -> list:
    filled = [f"__i_{c}" for c in features]
    return [
        Imputer(strategy="median", inputCols=list(features), outputCols=filled),
        VectorAssembler(inputCols=filled, outputCol="__v", handleInvalid="keep"),
    ]


def fit_logistic(rows: DataFrame, features: Sequence[str], y: str, train: Column, max_iter: int = 100) -> PipelineModel:
    """Class-weighted logistic regression on imputed, scaled features."""
    data = class_weights(rows, y, train).filter(train)
    stages = [*_prepared(features), StandardScaler(inputCol="__v", outputCol="__x", withMean=True),
              LogisticRegression(featuresCol="__x", labelCol=y, weightCol="weight", maxIter=max_iter)]
    return Pipeline(stages=stages).fit(data)


def fit_trees(
    rows: DataFrame, features: Sequence[str], y: str, train: Column, validation: Column,
    trees: int = 400, depth: int = 6, rate: float = 0.05, subsample: float = 0.8, seed: int = 42, patience: int = 30,
) -> PipelineModel:
    """Weighted gradient-boosted trees, as many as give the least loss on the validation rows.

    Trees are added until ``patience`` of them in a row bring no lower loss (Spark's own
    early stop ends at the first small step). One fitted ensemble serves all its
    prefixes: losses come tree by tree, and the best prefix is kept without another fit.
    The first fit has few more trees than ``patience``, as many targets settle there.
    Medians that fill gaps are those of the training rows. Training rows of one class
    enter as one row of their weight (:func:`one_class`).
    """
    data = class_weights(rows, y, train).filter(train | validation).withColumn("__val", validation)
    filled = Pipeline(stages=_prepared(features)).fit(data.filter(~F.col("__val")))
    data = stage_table(filled.transform(data).select("__v", y, "weight", "__val"))
    booster = GBTClassifier(
        featuresCol="__v", labelCol=y, weightCol="weight", maxDepth=depth, stepSize=rate,
        subsamplingRate=subsample, seed=seed, maxMemoryInMB=512,
    )
    fitted, judged = data.filter(~F.col("__val")), data.filter("__val")
    n = min(trees, patience + max(1, patience // 3))
    if one_class(fitted, y):
        merged = fitted.groupBy(y).agg(F.first("__v").alias("__v"), F.sum("weight").alias("weight"))
        fitted, n = stage_table(merged.coalesce(1)), trees
        booster = booster.setSubsamplingRate(1.0)
    while True:
        model = booster.setMaxIter(n).fit(fitted)
        best, over = least_loss(model.evaluateEachIteration(judged), patience)
        if over or n == trees:
            return PipelineModel([*filled.stages, first_trees(model, best)])
        n = min(trees, n * 5 // 2)


def one_class(rows: DataFrame, y: str) -> bool:
    """Whether all rows have one and the same label.

    All residuals of a round are then equal, whatever the features and the rows drawn:
    each tree is one leaf that holds their value, and one row that carries the weight of
    all gives the same ensemble without a pass over the rows per tree.
    """
    low, high, known, n = rows.agg(F.min(y), F.max(y), F.count(y), F.count("*")).first()
    return 0 < known == n and low == high


def first_trees(model: GBTClassificationModel, n: int) -> GBTClassificationModel:
    """The ensemble of the first ``n`` trees."""
    if n >= model.getNumTrees:
        return model
    gateway, java = SparkContext._active_spark_context._gateway, model._java_obj
    kept = gateway.new_array(gateway.jvm.org.apache.spark.ml.regression.DecisionTreeRegressionModel, n)
    weights = gateway.new_array(gateway.jvm.double, n)
    for i in range(n):
        kept[i], weights[i] = java.trees()[i], float(model.treeWeights[i])
    short = GBTClassificationModel(gateway.jvm.org.apache.spark.ml.classification.GBTClassificationModel(model.uid, kept, weights))
    return short.setFeaturesCol(model.getFeaturesCol())


def least_loss(losses: Sequence[float], patience: int) -> tuple[int, bool]:
    """Rounds up to the least loss, and whether ``patience`` rounds passed without a lower one."""
    if losses[0] != losses[0]:  # no validation rows
        return len(losses), False
    best = 0
    for i, loss in enumerate(losses):
        if loss < losses[best]:
            best = i
        elif i - best >= patience:
            return best + 1, True
    return best + 1, False


def predict(model: PipelineModel, rows: DataFrame, out: str = "p") -> DataFrame:
    scored = model.transform(rows).withColumn(out, vector_to_array("probability")[1])
    return scored.select(*rows.columns, out)


def importances(model: PipelineModel, features: Sequence[str], df: DataFrame) -> DataFrame:
    """Split-gain importance per feature with its rank; one row per feature."""
    values = [float(v) for v in model.stages[-1].featureImportances.toArray()]  # ends at the last feature that splits
    values += [0.0] * (len(features) - len(values))
    pairs = sorted(zip(features, values, strict=True), key=lambda kv: (-kv[1], kv[0]))
    rows = [(name, value, rank) for rank, (name, value) in enumerate(pairs, start=1)]
    return df.sparkSession.createDataFrame(rows, "feature string, gain double, rank int")


@dataclass
class Calibration:
    model: object

    def apply(self, rows: DataFrame, p: str, out: str) -> DataFrame:
        scored = self.model.transform(rows.withColumn("__p", F.col(p)))
        return scored.withColumn(out, F.greatest(F.lit(0.0), F.least(F.lit(1.0), "__iso"))).drop("__iso", "__p")


def fit_isotonic(rows: DataFrame, p: str, y: str) -> Calibration:
    """Monotone calibration fitted on the given (validation) rows.

    Rows of equal score enter as one weighted row; the fit depends on nothing else.
    """
    grouped = rows.groupBy(F.col(p).alias("__p")).agg(F.avg(F.col(y).cast("double")).alias("__y"), F.count("*").cast("double").alias("__w"))
    model = IsotonicRegression(featuresCol="__p", labelCol="__y", weightCol="__w", predictionCol="__iso").fit(grouped)
    return Calibration(model)


def probability_band(p: Column) -> tuple[Column, Column]:
    half = BAND_Z * F.sqrt(F.greatest(p * (1 - p), F.lit(0.0)) / EFFECTIVE_N)
    return F.greatest(F.lit(0.0), p - half), F.least(F.lit(1.0), p + half)


def score_series(model: PipelineModel, calibration: Calibration, rows: DataFrame, observed: Column) -> DataFrame:
    """Calibrated probability per row, null while unobserved, with a 90 % band."""
    scored = calibration.apply(predict(model, rows, "p_raw"), "p_raw", "p_cal")
    p = F.when(observed, F.col("p_cal"))
    low, high = probability_band(F.col("p"))
    return scored.withColumn("p", p).withColumn("p_lo", low).withColumn("p_hi", high)


def evaluate(rows: DataFrame, p: str, y: str, validation: Column, test: Column) -> DataFrame:
    """Threshold tuned on validation, scores and calibration on test: one row."""
    event = F.col(y) == 1
    chosen = best_threshold(rows.filter(validation), [], p, event).select("threshold")
    judged = rows.filter(test).join(F.broadcast(chosen))
    skill = scores(contingency(judged, ["threshold"], event, F.col(p) >= F.col("threshold")))
    return skill.join(F.broadcast(brier_and_ece(rows.filter(test), [], p, y)))


def ablation(
    rows: DataFrame, groups: dict[str, Sequence[str]], targets: Sequence[str], train: Column, validation: Column, test: Column,
    parallelism: int = 9, **kw
) -> DataFrame:
    """Boosted trees per feature group and target, calibrated on validation, scored on test.

    ``parallelism`` fits run side by side, as their many short jobs leave executors idle.
    Each is scored in its own thread too: one plan over all scores is planned anew after
    every stage of any of them.
    """

    def one(name: str, target: str) -> DataFrame:
        model = fit_trees(rows, groups[name], target, train, validation, **kw)
        scored = stage_table(predict(model, rows.filter(validation | test), "p_raw"))
        scored = fit_isotonic(scored.filter(validation), "p_raw", target).apply(scored, "p_raw", "p")
        judged = evaluate(scored, "p", target, validation, test)
        return stage_table(judged.withColumns({"features": F.lit(name), "target": F.lit(target)}))

    tasks = [inheritable_thread_target(rows.sparkSession)(partial(one, name, target)) for target in targets for name in groups]
    with ThreadPool(min(parallelism, len(tasks))) as pool:
        return reduce(DataFrame.unionByName, pool.map(lambda task: task(), tasks))


def climatology(rows: DataFrame, y: str, train: Column) -> DataFrame:
    return rows.filter(train).agg(F.avg(F.col(y).cast("double")).alias("p"))


def persistence_baseline(rows: DataFrame, counts: Sequence[str], y: str, validation: Column, test: Column) -> DataFrame:
    """Best trailing count by validation TSS, its threshold, and its scores on test."""
    long = rows.select(y, validation.alias("__val"), test.alias("__test"), F.inline(F.array(*[
        F.struct(F.lit(-i).alias("n"), F.lit(c).alias("score"), F.coalesce(F.col(c), F.lit(0)).cast("double").alias("x"))
        for i, c in enumerate(counts)])))
    tuned = best_threshold(long.filter("__val"), ["n", "score"], "x", F.col(y) == 1)
    best = tuned.agg(F.max(F.struct("tss", "n", "score", "threshold")).alias("b")).select("b.score", "b.threshold")
    judged = long.filter("__test").join(F.broadcast(best), "score")
    return scores(contingency(judged, ["score", "threshold"], F.col(y) == 1, F.col("x") >= F.col("threshold")))
