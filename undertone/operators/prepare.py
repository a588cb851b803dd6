"""From the feature dataset to a numeric model matrix. Labels are never model inputs."""

import sys

from pyspark.sql import Column, DataFrame, functions as F

from undertone.schema import (
    DNS_ONLY, ICMP_ONLY, METADATA_COLUMNS, PROTOCOLS, TIMING, require_columns,
)

KEYS = ["source_file", "flow_id", "label"]
# Query length is already in the matrix as its mean; the longest query repeats the same signal.
ALWAYS_DROPPED = ["max_query_length"]


def is_true(column: Column) -> Column:
    """The spellings of true that a re-read flag column may carry."""
    return F.coalesce(column.cast("string").isin("true", "True", "1"), F.lit(False))


def feature_names(columns, protocol=None) -> list[str]:
    """Model inputs in table order, without metadata and the other protocol's columns."""
    dropped = {*METADATA_COLUMNS, *ALWAYS_DROPPED}
    dropped |= {"dns": set(ICMP_ONLY), "icmp": set(DNS_ONLY)}.get(protocol, set())
    return [c for c in columns if c not in dropped]


def model_matrix(features: DataFrame, protocol: str | None = None) -> DataFrame:
    """Keys plus one DOUBLE column per model input, imputed. Lazy; see ``check_matrix``.

    Missing timing becomes 0 only on single-packet rows. With no protocol both are kept and
    the columns of the other protocol are filled with 0.
    """
    require_columns(features, ["protocol", "label", "source_file"], "feature table")
    if protocol is not None:
        protocol = protocol.lower()
        if protocol not in PROTOCOLS:
            raise ValueError(f"protocol must be one of {', '.join(PROTOCOLS)} or left out, not '{protocol}'")
        features = features.filter(F.lower("protocol") == protocol)
    names = feature_names(features.columns, protocol)
    single = is_true(F.col("is_single_packet_flow"))
    filled = set() if protocol else {*DNS_ONLY, *ICMP_ONLY}

    def value(name):
        column = F.col(name)
        if name == "is_single_packet_flow":
            text = column.cast("string")
            flag = F.when(text.isin("true", "True"), "1").when(text.isin("false", "False"), "0")
            return flag.otherwise(text).cast("double")
        column = column.cast("double")
        if name in TIMING:
            return F.when(single, F.coalesce(column, F.lit(0.0))).otherwise(column)
        return F.coalesce(column, F.lit(0.0)) if name in filled else column

    if "flow_id" in features.columns:
        flow_id = F.col("flow_id").cast("string")
    else:
        # Draws, shards and splits go by row: without an id, what the row holds tells rows apart.
        flow_id = F.hex(F.xxhash64(*[F.col(c) for c in sorted(features.columns)]))
    label = F.col("label").cast("double")
    whole = F.when(label.isNull() | (label == F.floor(label)), label.cast("int")).otherwise(
        F.raise_error(F.concat(F.lit("a label must be a whole number, not "), label.cast("string"))).cast("int"))
    return features.select(
        "source_file", flow_id.alias("flow_id"), whole.alias("label"),
        *[value(name).alias(name) for name in names],
    )


def check_matrix(matrix: DataFrame, protocol=None) -> int:
    """One pass of checks before training; returns the row count.

    Refuses an empty table, rows without a capture session and values that are still missing.
    """
    names = feature_names(matrix.columns)
    blank = F.coalesce(F.trim("source_file"), F.lit("")) == ""
    row = matrix.agg(
        F.count(F.lit(1)).alias("rows"), F.count_if(blank).alias("blank"),
        *[F.count_if(F.col(n).isNull() | F.isnan(n)).alias(n) for n in names],
    ).first()
    if not row["rows"]:
        raise ValueError(f"No rows to train on: the feature table has none of protocol {protocol or 'dns or icmp'}")
    if row["blank"]:
        raise ValueError(f"{row['blank']} of {row['rows']} rows have a blank source_file, so they belong to no session")
    missing = [n for n in names if row[n]]
    if missing:
        raise ValueError("the matrix has empty cells: " + ", ".join(f"{n} in {row[n]} rows" for n in missing))
    return row["rows"]


def scale_of(count: Column, mean: Column, variance: Column) -> Column:
    """Population deviation; 1 for a column that is constant up to rounding."""
    eps = F.lit(sys.float_info.epsilon)
    noise = count * eps * variance + F.pow(count * mean * eps, 2)
    return F.when(variance <= noise, F.lit(1.0)).otherwise(F.sqrt(variance))


def long_form(matrix: DataFrame, keys, names) -> DataFrame:
    """One row per (key, feature): the wide columns turned on their side."""
    return matrix.unpivot(keys, names, "feature", "value")


def fit_scaler(matrix: DataFrame) -> DataFrame:
    """(feature, mean, scale) in one aggregation; column sums are combined on the map side."""
    names = feature_names(matrix.columns)
    stats = matrix.agg(*[
        F.struct(F.count(n).cast("double").alias("n"), F.avg(n).alias("mean"),
                 F.var_pop(n).alias("var")).alias(n)
        for n in names
    ])
    return long_form(stats, [], names).select(
        "feature", F.col("value.mean").alias("mean"),
        scale_of(F.col("value.n"), F.col("value.mean"), F.col("value.var")).alias("scale"),
    )


def scaler_map(scaler: DataFrame) -> dict:
    """The fitted scaler as {feature: (mean, scale)}; one small row per feature."""
    return {r["feature"]: (r["mean"], r["scale"]) for r in scaler.collect()}


def apply_scaler(matrix: DataFrame, fitted: dict) -> DataFrame:
    """Standardize with saved means and scales; nothing is refitted."""
    names = feature_names(matrix.columns)
    keep = [c for c in matrix.columns if c not in names]
    return matrix.select(
        *keep,
        *[((F.col(n) - F.lit(fitted[n][0])) / F.lit(fitted[n][1])).alias(n) for n in names],
    )
