"""Leave-one-session-out evaluation of all detectors."""

from datetime import UTC, datetime

import numpy as np
from pyspark.sql import DataFrame, functions as F

from undertone.operators import boosted
from undertone.operators.autoencoder import reconstruction_error, train_autoencoders
from undertone.operators.fold_scores import score_folds
from undertone.operators.iforest import collect_forests, train_isolation_forest
from undertone.operators.metrics import (
    check_contamination, check_scores, evaluate_scores, mask_rates,
)
from undertone.operators.prepare import check_matrix, feature_names, model_matrix
from undertone.operators.splits import fold_census, fold_scalers, list_folds
from undertone.schema import RESULT_SCHEMA
from undertone.session import durable

# Names that results of earlier runs carry, whichever library trains the model.
FOREST, AUTOENCODER, SUPERVISED = (
    "Isolation Forest", "Autoencoder", "XGBoost (supervised reference)",
)
# A broadcast of fold models stays below about 70 MB: 1 MB per forest.
FOLDS_AT_ONCE = 64
# One feature's scalers are two numbers a fold.
COLUMN_FOLDS_AT_ONCE = 512


def detector_scorer(models):
    """Scores of both label-free models under every fold; ``models`` is a broadcast, in order of folds."""

    def score(x):
        return {
            FOREST: np.stack([forest.raw_scores(x) for forest, *_ in models.value]),
            AUTOENCODER: np.stack([
                reconstruction_error(flat, (x - mean) / scale) for _, flat, mean, scale in models.value]),
        }

    return score


def column_scorer(model, mean, scale):
    """One feature, standardized by each fold's scaler, as the score."""

    def score(x):
        return {model: (x[:, 0][None] - mean) / scale}

    return score


def scaler_arrays(scalers: DataFrame, folds, names):
    """(folds, features) arrays of means and scales."""
    at = {(r["fold"], r["feature"]): (r["mean"], r["scale"]) for r in scalers.collect()}
    grid = np.array([[at[f, n] for n in names] for f in folds], dtype=float)
    return grid[:, :, 0], grid[:, :, 1]


def unsupervised_scores(matrix: DataFrame, census: dict, contamination: float = 0.1, seed: int = 42, **training):
    """(test scores, thresholds) of both label-free models of every fold.

    Folds are a column, not a loop: one pass trains and two passes score up to FOLDS_AT_ONCE. A forest
    needs no scaling, since its cuts move with the columns. Forest scores are moved so that the
    contamination percentile of each training fold is 0.
    """
    spark, names = matrix.sparkSession, feature_names(matrix.columns)
    folds, tests, limits = sorted(census), None, None
    scalers = durable(fold_scalers(matrix), "scalers")
    trees = training.pop("n_estimators", 200)
    rows = sum(c["test_legit"] + c["test_covert"] for c in census.values())
    for start in range(0, len(folds), FOLDS_AT_ONCE):
        group = folds[start:start + FOLDS_AT_ONCE]
        sizes = {f: census[f]["train_legit"] + census[f]["train_covert"] for f in group}
        forests = collect_forests(train_isolation_forest(matrix, sizes, trees, seed), trees)
        mean, scale = scaler_arrays(scalers.filter(F.col("fold").isin(group)), group, names)
        weights = train_autoencoders(matrix, rows, group, mean, scale, seed=seed, **training)
        models = spark.sparkContext.broadcast([(forests[f], weights[i], mean[i], scale[i]) for i, f in enumerate(group)])
        scored, found = score_folds(matrix, group, detector_scorer(models), 1 - contamination)
        tests, limits = (scored, found) if tests is None else (tests.unionByName(scored), limits.unionByName(found))
    by = ["fold", "model_name"]
    limits = durable(limits, "limits")
    forest = F.col("model_name") == FOREST
    shifted = tests.join(limits, by).select(
        *by, "label", F.when(forest, F.col("score") - F.col("threshold")).otherwise(F.col("score")).alias("score"))
    return shifted, limits.withColumn("threshold", F.when(forest, 0.0).otherwise(F.col("threshold")))


def supervised_scores(matrix: DataFrame, census: dict, iterations=100):
    """Test scores of boosted trees for folds whose training rows have both classes.

    All folds train together, and one pass scores every row by the model that has not seen its session.
    """
    weights = {f: c["train_legit"] / c["train_covert"] for f, c in sorted(census.items()) if c["train_legit"] and c["train_covert"]}
    if not weights:
        return None
    rows = sum(c["test_legit"] + c["test_covert"] for c in census.values())
    models = boosted.train_boosted(matrix, weights, rows, iterations)
    return durable(boosted.score_held_out(models, matrix).select(
        F.col("source_file").alias("fold"), F.lit(SUPERVISED).alias("model_name"), "label", "score"), "supervised")


def result_rows(metrics: DataFrame, census: DataFrame, protocol, run_timestamp) -> DataFrame:
    """Metrics joined with the fold census, rates masked, in the result schema."""
    supervised = F.col("model_name") == SUPERVISED
    rows = mask_rates(metrics.join(census, "fold")).withColumns({
        "protocol": F.lit(protocol), "run_timestamp": F.lit(run_timestamp),
        "uses_training_labels": supervised,
        "scale_pos_weight": F.when(
            supervised, F.try_divide(F.col("train_legit").cast("double"), F.col("train_covert"))
        ),
    })
    return rows.select(*[F.col(f.name).cast(f.dataType) for f in RESULT_SCHEMA])


def utc_now() -> str:
    return datetime.now(UTC).isoformat()


def run_loso(
    features: DataFrame, protocol: str, contamination: float = 0.1, seed: int = 42,
    supervised: bool = True, iterations: int = 100, run_timestamp: str | None = None, **training,
) -> DataFrame:
    """One result row per (fold, model); append it to the result table to keep runs."""
    check_contamination(contamination)
    matrix = durable(model_matrix(features, protocol), "matrix")
    check_matrix(matrix, protocol)
    list_folds(matrix)
    census = fold_census(matrix)
    by_fold = {r["fold"]: r.asDict() for r in census.collect()}
    tests, limits = unsupervised_scores(matrix, by_fold, contamination, seed, **training)
    by = ["fold", "model_name"]
    tests = durable(tests, "shifted")
    check_scores(tests)
    metrics = evaluate_scores(tests, by, thresholds=limits, contamination=contamination)
    if supervised:
        labelled = supervised_scores(matrix, by_fold, iterations)
        if labelled is not None:
            metrics = metrics.unionByName(
                evaluate_scores(labelled, by, threshold=boosted.PROBABILITY_THRESHOLD)
            )
    return result_rows(metrics, census, protocol, run_timestamp or utc_now())


def loso_with_column_scorer(
    features: DataFrame, protocol: str, column: str, contamination: float = 0.1,
    run_timestamp: str | None = None,
) -> DataFrame:
    """The same evaluation with one standardized feature as the score: nothing is trained."""
    check_contamination(contamination)
    matrix = durable(model_matrix(features, protocol).select("source_file", "flow_id", "label", column), "matrix")
    folds = list_folds(matrix)
    scalers = durable(fold_scalers(matrix), "scalers")
    tests, limits = None, None
    for start in range(0, len(folds), COLUMN_FOLDS_AT_ONCE):
        group = folds[start:start + COLUMN_FOLDS_AT_ONCE]
        mean, scale = scaler_arrays(scalers.filter(F.col("fold").isin(group)), group, [column])
        scored, found = score_folds(matrix, group, column_scorer(column, mean, scale), 1 - contamination)
        tests, limits = (scored, found) if tests is None else (tests.unionByName(scored), limits.unionByName(found))
    metrics = evaluate_scores(
        durable(tests, "column-scores"), ["fold", "model_name"], thresholds=limits, contamination=contamination)
    return result_rows(metrics, fold_census(matrix), protocol, run_timestamp or utc_now())
