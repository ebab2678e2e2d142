"""Forecast models: prefixes of an ensemble, and what their fits may see."""

import threading

import numpy as np
import pandas as pd
import pytest
from pyspark.ml.classification import GBTClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.sql import functions as F

from chronoflux.operators import models as M


@pytest.fixture(scope="module")
def rows(spark):
    rng = np.random.default_rng(2)
    n = 600
    pdf = pd.DataFrame({"i": np.arange(n), "a": rng.normal(0, 1, n), "b": rng.normal(0, 1, n), "c": 1.0})
    pdf["y"] = (pdf["a"] + 0.5 * rng.normal(0, 1, n) > 0.3).astype(int)
    pdf["part"] = np.where(pdf["i"] % 3 == 2, "val", "train")
    pdf.loc[pdf["i"] % 7 == 0, "b"] = np.nan
    return spark.createDataFrame(pdf).withColumn("b", F.nanvl("b", F.lit(None).cast("double"))).cache()


def test_prefix_of_an_ensemble_equals_a_shorter_fit(rows):
    data = VectorAssembler(inputCols=["a", "c"], outputCol="v").transform(rows)
    booster = GBTClassifier(featuresCol="v", labelCol="y", maxDepth=3, stepSize=0.1, subsamplingRate=0.8, seed=5)
    long, short = booster.setMaxIter(9).fit(data), booster.setMaxIter(4).fit(data)
    cut = M.first_trees(long, 4)
    assert cut.getNumTrees == 4 and M.first_trees(long, 9) is long
    ours, theirs = (m.transform(data).orderBy("i").select("probability").collect() for m in (cut, short))
    assert ours == theirs


def test_trees_stop_at_the_least_validation_loss(rows):
    model = M.fit_trees(rows, ["a", "b", "c"], "y", F.col("part") == "train", F.col("part") == "val", trees=30, depth=3, patience=4)
    assert 1 <= model.stages[-1].getNumTrees <= 30
    gains = {r.feature: (r.gain, r["rank"]) for r in M.importances(model, ["a", "b", "c"], rows).collect()}
    assert len(gains) == 3 and gains["a"][1] == 1 and gains["c"][0] == 0.0
    assert sum(g for g, _ in gains.values()) == pytest.approx(1.0)
    scored = M.predict(model, rows).collect()
    assert len(scored) == 600 and all(0 <= r.p <= 1 for r in scored)


def test_medians_come_from_the_training_rows(rows):
    shifted = rows.withColumn("b", F.when(F.col("part") == "val", F.lit(1e6)).otherwise(F.col("b")))
    model = M.fit_trees(shifted, ["a", "b"], "y", F.col("part") == "train", F.col("part") == "val", trees=2, depth=2)
    assert abs(model.stages[0].surrogateDF.first()["b"]) < 1


def test_losses_decide_the_number_of_trees():
    assert M.least_loss([3.0, 2.0, 2.5, 2.4], 2) == (2, True)
    assert M.least_loss([3.0, 2.0, 1.0], 2) == (3, False)
    assert M.least_loss([float("nan")] * 3, 2) == (3, False)


def test_ablation_has_a_row_per_group_and_target(rows):
    data = rows.withColumn("z", (F.col("b") > 0).cast("int")).fillna(0, ["z"])
    third = F.col("i") % 3
    out = M.ablation(data, {"one": ["a"], "both": ["a", "b"]}, ["y", "z"], third == 0, third == 1, third == 2, trees=3, depth=2, patience=2).collect()
    assert sorted((r.features, r.target) for r in out) == [("both", "y"), ("both", "z"), ("one", "y"), ("one", "z")]
    assert all(r.tp + r.fp + r.fn + r.tn == 200 for r in out)


def test_one_class_is_boosted_as_one_row(rows, monkeypatch):
    train, val = F.col("part") == "train", F.col("part") == "val"
    flat = rows.withColumn("y", F.when(train, F.lit(1)).otherwise(F.col("y")))
    seen, plain = [], GBTClassifier.fit

    def fit(self, data, *a):
        seen.append(data.count())
        return plain(self, data, *a)

    monkeypatch.setattr(GBTClassifier, "fit", fit)
    one_sided = M.fit_trees(flat.withColumn("y", F.lit(1)), ["a", "b"], "y", train, val, trees=20, depth=3, patience=4)
    assert seen == [1] and one_sided.stages[-1].getNumTrees == 20
    mixed = M.fit_trees(flat, ["a", "b"], "y", train, val, trees=20, depth=3, patience=4)
    data = M.class_weights(flat, "y", train).filter(train)
    data = VectorAssembler(inputCols=["a", "c"], outputCol="v").transform(data)
    n = mixed.stages[-1].getNumTrees
    whole = plain(GBTClassifier(featuresCol="v", labelCol="y", weightCol="weight", maxDepth=3, stepSize=0.05, subsamplingRate=0.8, seed=42, maxIter=n), data)
    want = whole.transform(data).first().probability[1]
    assert {round(r.p, 12) for r in M.predict(mixed, flat).collect()} == {round(want, 12)}


def test_a_target_that_settles_at_once_costs_few_trees(rows, monkeypatch):
    asked, plain = [], GBTClassifier.fit

    def fit(self, data, *a):
        asked.append((self.getMaxIter(), self.getCacheNodeIds()))
        return plain(self, data, *a)

    monkeypatch.setattr(GBTClassifier, "fit", fit)
    noise = rows.withColumn("y", (F.xxhash64("i") % 2 == 0).cast("int"))
    M.fit_trees(noise, ["a", "b"], "y", F.col("part") == "train", F.col("part") == "val", trees=40, depth=2, patience=6)
    assert asked[0] == (8, False)
    monkeypatch.setattr(M, "least_loss", lambda losses, patience: (len(losses), False))
    asked.clear()
    M.fit_trees(rows, ["a", "b"], "y", F.col("part") == "train", F.col("part") == "val", trees=40, depth=1, patience=6)
    assert [n for n, _ in asked] == [8, 20, 40]


def test_all_fits_of_an_ablation_run_side_by_side(rows, monkeypatch):
    met, plain = threading.Barrier(6), M.fit_trees

    def fit(*a, **kw):
        met.wait(60)
        return plain(*a, **kw)

    monkeypatch.setattr(M, "fit_trees", fit)
    third = F.col("i") % 3
    groups = {"a": ["a"], "b": ["b"], "both": ["a", "b"]}
    data = rows.withColumn("z", 1 - F.col("y"))
    out = M.ablation(data, groups, ["y", "z"], third == 0, third == 1, third == 2, trees=1, depth=1, patience=1).collect()
    assert len(out) == 6
