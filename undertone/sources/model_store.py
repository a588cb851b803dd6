"""Saved detectors as Parquet tables, with the checks a loader must make."""

import math
from dataclasses import dataclass

import numpy as np
from pyspark.errors import AnalysisException
from pyspark.sql import SparkSession, types as T

from undertone.operators.autoencoder import initial_weights
from undertone.operators.iforest import EVERYTHING, TREE_SCHEMA, Forest

EVIDENCE_WARNING = (
    "Trained on all available sessions with nothing held out. Scores of this model are a live "
    "demonstration, not leave-one-session-out evidence, and must not be presented as such."
)
META_SCHEMA = T.StructType([
    T.StructField("protocol", T.StringType()),
    T.StructField("feature_names", T.ArrayType(T.StringType())),
    T.StructField("forest_feature_names", T.ArrayType(T.StringType())),
    T.StructField("forest_offset", T.DoubleType()),
    T.StructField("forest_threshold", T.DoubleType()),
    T.StructField("autoencoder_threshold", T.DoubleType()),
    T.StructField("input_dim", T.IntegerType()),
    T.StructField("training_flow_count", T.LongType()),
    T.StructField("demo_only", T.BooleanType()),
    T.StructField("evidence", T.StringType()),
    T.StructField("warning", T.StringType()),
])
SCALER_SCHEMA = T.StructType([
    T.StructField("position", T.IntegerType()),
    T.StructField("feature", T.StringType()),
    T.StructField("mean", T.DoubleType()),
    T.StructField("scale", T.DoubleType()),
])
WEIGHTS_SCHEMA = T.StructType([T.StructField("weights", T.ArrayType(T.DoubleType()))])


@dataclass
class Detector:
    """Everything scoring needs for one protocol; about 1 MB whatever it was trained on."""

    protocol: str
    names: list
    mean: np.ndarray
    scale: np.ndarray
    forest: Forest
    forest_offset: float
    forest_threshold: float
    weights: np.ndarray
    autoencoder_threshold: float
    training_flow_count: int
    demo_only: bool = True
    warning: str = EVIDENCE_WARNING


def save_detector(spark: SparkSession, model: Detector, directory):
    base = f"{directory}/{model.protocol}"

    def put(rows, schema, name):
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("overwrite").parquet(f"{base}/{name}")

    trees = zip(model.forest.feature, model.forest.cut, model.forest.path)
    put([(EVERYTHING, i, f.tolist(), c.tolist(), p.tolist(), model.forest.sample_rows)
         for i, (f, c, p) in enumerate(trees)], TREE_SCHEMA, "forest_nodes")
    put([(model.weights.tolist(),)], WEIGHTS_SCHEMA, "ae_weights")
    put([(i, n, float(model.mean[i]), float(model.scale[i])) for i, n in enumerate(model.names)],
        SCALER_SCHEMA, "scaler")
    put([(model.protocol, model.names, model.names, float(model.forest_offset),
          float(model.forest_threshold), float(model.autoencoder_threshold), len(model.names),
          model.training_flow_count, model.demo_only, "full_data", model.warning)],
        META_SCHEMA, "model_meta")


def load_detector(spark: SparkSession, protocol: str, directory) -> Detector:
    """Load and check one protocol's tables; refuse missing, reordered or incomplete ones."""
    base = f"{directory}/{protocol}"

    def get(name, schema):
        try:
            return spark.read.schema(schema).parquet(f"{base}/{name}").collect()
        except AnalysisException as error:
            raise ValueError(f"model table {name} of '{protocol}' is missing; train the models first") from error

    meta_rows, scaler = get("model_meta", META_SCHEMA), get("scaler", SCALER_SCHEMA)
    trees, weight_rows = get("forest_nodes", TREE_SCHEMA), get("ae_weights", WEIGHTS_SCHEMA)
    counts = {"model_meta": len(meta_rows), "ae_weights": len(weight_rows)}
    wrong = [f"{name} holds {n} rows instead of one" for name, n in counts.items() if n != 1]
    if not trees:
        wrong.append("forest_nodes holds no tree")
    if wrong:
        raise ValueError(f"cannot use the saved '{protocol}' models: {'; '.join(wrong)}")
    meta, scaler = meta_rows[0], sorted(scaler, key=lambda r: r["position"])
    names, forest = list(meta["feature_names"] or []), Forest.from_rows(trees)
    weights = np.array(weight_rows[0]["weights"], dtype=float)
    numbers = {n: meta[n] for n in ("forest_threshold", "autoencoder_threshold", "forest_offset")}
    checks = {
        "its feature names are empty, missing or repeated": bool(names) and None not in names and len({*names}) == len(names),
        "scaler and forest list other features or another order":
            names == [r["feature"] for r in scaler] and names == meta["forest_feature_names"],
        f"it was trained on {meta['input_dim']} inputs, not {len(names)}": meta["input_dim"] == len(names),
        "a tree splits on a feature that is not there": forest.feature.max(initial=0) < max(1, len(names)),
        "the autoencoder has weights for another number of inputs": len(weights) == len(initial_weights(len(names), 0)),
        "it is not marked as trained on all data": meta["demo_only"] is True,
        **{f"{n} is not a finite number": x is not None and math.isfinite(x) for n, x in numbers.items()},
    }
    wrong = [text for text, fine in checks.items() if not fine]
    if wrong:
        raise ValueError(f"cannot use the saved '{protocol}' models: {'; '.join(wrong)}")
    return Detector(
        protocol, list(names), np.array([r["mean"] for r in scaler]), np.array([r["scale"] for r in scaler]),
        forest, meta["forest_offset"], meta["forest_threshold"], weights,
        meta["autoencoder_threshold"], meta["training_flow_count"], True, meta["warning"],
    )
