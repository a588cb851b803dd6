"""Score new traffic with saved detectors; nothing is refitted."""

import pandas as pd
from pyspark.sql import DataFrame, functions as F, types as T
from pyspark.sql.functions import pandas_udf

from undertone.operators.autoencoder import reconstruction_error
from undertone.operators.features import build_flow_features
from undertone.operators.prepare import model_matrix

SCORE_TYPE = T.StructType([
    T.StructField("forest", T.DoubleType()), T.StructField("autoencoder", T.DoubleType()),
])
OUTPUT = [
    "flow_id", "start_timestamp", "end_timestamp", "packet_count", "isolation_forest_score",
    "autoencoder_reconstruction_error", "flagged_by_either",
]


def detector_udf(model):
    """Both anomaly scores of a batch of feature rows. The model is about 1 MB."""

    @pandas_udf(SCORE_TYPE)
    def scores(values: pd.DataFrame) -> pd.DataFrame:
        x = (values.to_numpy(dtype=float) - model.mean) / model.scale
        return pd.DataFrame({
            "forest": model.forest.raw_scores(x) - model.forest_offset,
            "autoencoder": reconstruction_error(model.weights, x),
        })

    return scores


def finite(column, what):
    ok = column.isNotNull() & ~F.isnan(column) & (F.abs(column) != float("inf"))
    return F.when(ok, column).otherwise(F.raise_error(F.lit(f"non-finite {what}")).cast("double"))


def with_scores(features: DataFrame, model, check: bool = True) -> DataFrame:
    """Add both scores to feature rows of the model's protocol, using its saved column order.

    With ``check`` a non-finite feature or score fails the job; without, such rows carry it on.
    """
    prepared = model_matrix(features.withColumn("label", F.lit(0)), model.protocol)
    missing = [n for n in model.names if n not in prepared.columns]
    if missing:
        raise ValueError(f"features the model needs are absent: {', '.join(missing)}")
    from_name = {n: F.col(n).cast("double") for n in model.names}
    inputs = [finite(c, f"feature {n}") if check else c for n, c in from_name.items()]
    both = detector_udf(model)(F.struct(*[c.alias(n) for n, c in zip(from_name, inputs)]))
    rows = features.withColumn("_s", both)
    forest, error = F.col("_s.forest"), F.col("_s.autoencoder")
    return rows.withColumns({
        "isolation_forest_score": finite(forest, "score") if check else forest,
        "autoencoder_reconstruction_error": finite(error, "score") if check else error,
    }).drop("_s")


def flag(scored: DataFrame, forest_threshold: float, autoencoder_threshold: float) -> DataFrame:
    """Flagged when either score reaches its threshold."""
    return scored.withColumn(
        "flagged_by_either",
        (F.col("isolation_forest_score") >= F.lit(forest_threshold))
        | (F.col("autoencoder_reconstruction_error") >= F.lit(autoencoder_threshold)),
    )


def score_captures(packets: DataFrame, model, **flow_parameters) -> DataFrame:
    """Flow windows of any number of captures with scores and flags."""
    mine = packets.filter(F.lower("protocol") == model.protocol)
    if mine.isEmpty():
        raise ValueError(f"no usable {model.protocol} packets")
    features = build_flow_features(mine, include_timestamps=True, **flow_parameters)
    scored = flag(with_scores(features, model), model.forest_threshold, model.autoencoder_threshold)
    return scored.select("source_file", *OUTPUT)


def score_summary(scored: DataFrame) -> DataFrame:
    """Windows, flagged windows and packets of a scored table."""
    return scored.agg(
        F.count(F.lit(1)).alias("flow_windows"), F.count_if("flagged_by_either").alias("flagged"),
        F.coalesce(F.sum("packet_count"), F.lit(0)).alias("packets_analyzed"),
    )


def with_status(scored: DataFrame) -> DataFrame:
    return scored.withColumn(
        "status", F.when(F.col("flagged_by_either"), "Flagged - demo").otherwise("Not flagged")
    )
