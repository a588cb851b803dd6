"""Full-data detectors for scoring new traffic. Not evaluation evidence."""

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, types as T

from undertone.operators.autoencoder import reconstruction_error, train_autoencoders
from undertone.operators.iforest import EVERYTHING, collect_forests, train_isolation_forest
from undertone.operators.metrics import score_threshold
from undertone.operators.prepare import (
    apply_scaler, check_matrix, feature_names, fit_scaler, model_matrix, scaler_map,
)
from undertone.schema import PROTOCOLS
from undertone.session import durable
from undertone.sources.model_store import Detector, save_detector

TRAINING_SCORES = T.StructType([
    T.StructField("source_file", T.StringType()), T.StructField("flow_id", T.StringType()),
    T.StructField("label", T.IntegerType()),
    T.StructField("forest", T.DoubleType()), T.StructField("autoencoder", T.DoubleType()),
])


def matrix_scores(matrix: DataFrame, forest=None, weights=None) -> DataFrame:
    """Raw forest scores and reconstruction errors of a standardized matrix; null without a model."""
    names = feature_names(matrix.columns)

    def score(frames):
        for frame in frames:
            x = frame[names].to_numpy(dtype=float)
            yield pd.DataFrame({
                "source_file": frame["source_file"], "flow_id": frame["flow_id"], "label": frame["label"],
                "forest": forest.raw_scores(x) if forest is not None else None,
                "autoencoder": reconstruction_error(weights, x) if weights is not None else None,
            })

    return matrix.mapInPandas(score, TRAINING_SCORES)


def train_forest(standardized: DataFrame, rows: int, seed: int = 42, n_estimators: int = 200):
    trees = train_isolation_forest(standardized, {EVERYTHING: rows}, n_estimators, seed)
    return collect_forests(trees, n_estimators)[EVERYTHING]


def train_weights(standardized: DataFrame, rows: int, seed: int = 42, **training):
    """Autoencoder weights; the matrix is already standardized, so its own scaler is neutral."""
    zero = np.zeros((1, len(feature_names(standardized.columns))))
    return train_autoencoders(standardized, rows, [EVERYTHING], zero, zero + 1.0, seed=seed, **training)[0]


def train_detectors(standardized: DataFrame, rows: int, seed: int = 42, n_estimators: int = 200, **training):
    """(forest, weights) on every row of an already standardized matrix."""
    return (train_forest(standardized, rows, seed, n_estimators),
            train_weights(standardized, rows, seed, **training))


def thresholds(scores: DataFrame, contamination: float = 0.1) -> dict:
    """Training percentile of both score columns."""
    rows = scores.unpivot([], ["forest", "autoencoder"], "model_name", "score")
    return {r["model_name"]: r["threshold"] for r in score_threshold(rows, ["model_name"], contamination).collect()}


def train_detector(features: DataFrame, protocol: str, contamination: float = 0.1, seed: int = 42, **training) -> Detector:
    matrix = durable(model_matrix(features, protocol), "matrix")
    rows = check_matrix(matrix, protocol)
    names = feature_names(matrix.columns)
    fitted = scaler_map(fit_scaler(matrix))
    standardized = apply_scaler(matrix, fitted)
    forest, weights = train_detectors(standardized, rows, seed, **training)
    limits = thresholds(durable(matrix_scores(standardized, forest, weights), "training_scores"), contamination)
    # The offset moves the forest's own decision boundary, and with it the threshold, to zero.
    return Detector(
        protocol, names, np.array([fitted[n][0] for n in names]), np.array([fitted[n][1] for n in names]),
        forest, limits["forest"], 0.0, weights, limits["autoencoder"], rows,
    )


def train_final(features: DataFrame, directory, protocols=PROTOCOLS, **options) -> dict:
    """Train and save one detector per protocol on all rows, without labels."""
    models = {}
    for protocol in protocols:
        models[protocol] = train_detector(features, protocol, **options)
        save_detector(features.sparkSession, models[protocol], directory)
    return models
