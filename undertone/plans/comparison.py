"""Exploratory comparison on a random row split. Sessions leak across it; see ``plans.loso``."""

from pyspark.sql import DataFrame, functions as F

from undertone.operators.metrics import evaluate_scores, shifted_thresholds
from undertone.operators.prepare import apply_scaler, check_matrix, fit_scaler, model_matrix, scaler_map
from undertone.operators.splits import stratified_split
from undertone.plans.final_models import matrix_scores, train_detectors
from undertone.plans.loso import AUTOENCODER, FOREST, utc_now
from undertone.session import durable, stored


def run_random_split_comparison(
    features: DataFrame, protocol: str | None = None, contamination: float = 0.1, seed: int = 42,
    run_timestamp: str | None = None, **training,
) -> DataFrame:
    """One result row per model over a stratified 70/30 split; scaler and threshold from train."""
    # A plain projection of each row: computed anew by every reader sooner than stored once more.
    matrix = model_matrix(stored(features, "features"), protocol)
    check_matrix(matrix, protocol)
    parts = durable(stratified_split(matrix, 0.3, seed), "split")
    raw_train = parts.filter("part = 'train'").drop("part")
    fitted = scaler_map(fit_scaler(raw_train))
    train, test = (
        apply_scaler(parts.filter(F.col("part") == part).drop("part"), fitted) for part in ("train", "test")
    )
    forest, weights = train_detectors(train, raw_train.count(), seed, **training)

    def long(matrix):
        scored = durable(matrix_scores(matrix, forest, weights), "split_scores")
        return scored.withColumnsRenamed({"forest": FOREST, "autoencoder": AUTOENCODER}).unpivot(
            ["source_file", "flow_id", "label"], [FOREST, AUTOENCODER], "model_name", "score"
        )

    train_scores, test_scores = long(train), long(test)
    # The offset moves the forest's own decision boundary, and with it the threshold, to zero.
    limits = durable(
        shifted_thresholds(train_scores, ["model_name"], F.col("model_name") == FOREST, contamination), "limits")
    shifted = test_scores.join(limits.select("model_name", "offset"), "model_name").withColumn(
        "score", F.col("score") - F.col("offset")
    ).drop("offset")
    metrics = evaluate_scores(
        shifted, ["model_name"], thresholds=limits.select("model_name", "threshold"), contamination=contamination)
    return metrics.withColumns({
        "protocol": F.lit(protocol or "combined"), "run_timestamp": F.lit(run_timestamp or utc_now()),
    })
