"""Thresholds and test scores of every fold, and scalers of many sessions."""

import time

import numpy as np
import pytest
from pyspark.sql import functions as F

from test_training import sessions_of
from undertone.operators import fold_scores, ordering, splits


def two_models():
    """A scorer that workers can have by value."""
    def score(x):
        a = x[:, 0][None] * np.array([1.0, -2.0, 0.5])[:, None]
        return {"a": a, "b": np.round(np.abs(a) + x[:, 1][None], 1)}

    return score


@pytest.mark.parametrize("rest,share", [(44, 0.9), (60, 0.5), (12, 1.0), (44, 0.0)])
def test_thresholds_are_exact_percentiles(spark, monkeypatch, rest, share):
    monkeypatch.setattr(fold_scores, "REST", rest)
    rng = np.random.default_rng(4)
    x = np.concatenate([rng.normal(size=(400, 2)), np.zeros((30, 2)), rng.normal(size=(3, 2)) * 1e-300])
    sessions = [("s", "t", "u", "other")[k % 4] for k in range(len(x))]
    label = rng.integers(0, 2, len(x))
    matrix = sessions_of(spark, x, sessions, label).repartition(5)
    folds = ["s", "t", "u"]
    tests, limits = fold_scores.score_folds(matrix, folds, two_models(), share)
    scores, session = two_models()(x), np.array(sessions)
    got = {(r["fold"], r["model_name"]): r["threshold"] for r in limits.collect()}
    assert len(got) == 6
    for (fold, model), limit in got.items():
        assert limit == pytest.approx(np.percentile(scores[model][folds.index(fold)][session != fold], 100 * share), rel=1e-12, abs=1e-300)
    want = sorted((f, m, int(label[k]), s[folds.index(f)][k]) for m, s in scores.items() for k, f in enumerate(sessions) if f in folds)
    assert sorted(tuple(r) for r in tests.collect()) == [tuple(w) for w in want]


def test_digits_order_as_keys_do(spark):
    x = np.concatenate([np.random.default_rng(0).normal(size=300) * 10.0 ** np.arange(-150, 150), [0.0, -0.0, 1.0, -1.0]])
    keys = spark.createDataFrame([(float(v),) for v in x], "v double").select(ordering.ordered_key(F.col("v")).alias("k")).collect()
    assert (fold_scores.leading_digits(x, fold_scores.REST) == np.array([r["k"] for r in keys]) >> fold_scores.REST).all()


def test_scores_must_be_finite(spark):
    matrix = sessions_of(spark, np.ones((8, 1)), ["s", "t"] * 4)
    with pytest.raises(Exception, match="not finite"):
        fold_scores.score_folds(matrix, ["s", "t"], lambda x: {"m": np.full((2, len(x)), np.nan)}, 0.9)


def test_scalers_of_thousands_of_sessions_are_linear(spark):
    def seconds(sessions):
        rows = spark.range(2 * sessions).select(
            F.format_string("s%06d", F.col("id") % sessions).alias("source_file"), F.col("id").cast("string").alias("flow_id"),
            F.lit(0).alias("label"), F.randn(1).alias("f0"), F.rand(2).alias("f1"))
        rows = rows.cache()
        rows.count()
        start = time.perf_counter()
        found = splits.fold_scalers(rows)
        assert found.count() == 2 * sessions
        taken = time.perf_counter() - start
        some = found.filter("fold = 's000007' and feature = 'f0'").first()
        values = [r["f0"] for r in rows.filter("source_file <> 's000007'").select("f0").collect()]
        assert some["mean"] == pytest.approx(np.mean(values)) and some["scale"] == pytest.approx(np.std(values))
        rows.unpersist()
        return taken

    seconds(500)
    few, many = seconds(5_000), seconds(20_000)
    # Four times the sessions: far from the sixteen-fold work of a quadratic frame.
    assert many < 8 * max(few, 0.5)
