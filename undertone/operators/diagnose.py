"""Dataset audits: sizes, missing values, balance, correlation, per-label summaries."""

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window, functions as F, types as T

from undertone.operators.ordering import exact_percentiles
from undertone.operators.prepare import long_form
from undertone.schema import PROTOCOLS, require_columns

MIN_FLOWS = 30
NEAR_PERFECT = 0.95
AUDITED = [
    "packet_count", "duration_seconds", "size_mean", "size_std", "size_cv",
    "interarrival_mean", "interarrival_std", "interarrival_cv", "entropy_mean", "entropy_max",
    "is_single_packet_flow", "mean_query_length", "txt_null_ratio", "max_query_length",
    "icmp_size_cv",
]
INSPECTED = {
    "dns": ["size_cv", "interarrival_cv", "entropy_mean", "compression_ratio_mean",
            "mean_query_length", "txt_null_ratio"],
    "icmp": ["size_cv", "interarrival_cv", "entropy_mean", "compression_ratio_mean",
             "icmp_size_cv"],
}
TWO_SIDED = ("size_cv", "icmp_size_cv")
COMPARED = ["size_cv", "interarrival_cv", "entropy_mean", "compression_ratio_mean",
            "mean_query_length", "duration_seconds", "packet_count"]


def class_sizes(features: DataFrame) -> DataFrame:
    """Rows and share of each (protocol, label), with zeros for absent groups."""
    require_columns(features, ["protocol", "label"], "feature table")
    spark = features.sparkSession
    grid = spark.createDataFrame(
        [(p, label) for p in PROTOCOLS for label in (0, 1)], "protocol string, label int"
    )
    counts = features.groupBy(
        F.lower("protocol").alias("protocol"), F.col("label").cast("int").alias("label")
    ).agg(F.count(F.lit(1)).alias("count"))
    total = F.coalesce(counts.agg(F.sum("count")).scalar(), F.lit(0))
    return grid.join(counts, ["protocol", "label"], "left").select(
        "protocol", "label", F.coalesce("count", F.lit(0)).alias("count")
    ).withColumn(
        "percentage", F.coalesce(F.try_divide(F.col("count") * F.lit(100.0), total), F.lit(0.0))
    )


def short_groups(features: DataFrame, minimum: int = MIN_FLOWS) -> DataFrame:
    return class_sizes(features).filter(F.col("count") < minimum).select("protocol", "label", "count")


def _missing(column):
    return F.col(column).isNull()


def missing_values(features: DataFrame) -> DataFrame:
    """Nulls and their share per column, from one pass."""
    columns = features.columns
    counts = features.agg(
        F.count(F.lit(1)).alias("_rows"), *[F.count_if(_missing(c)).alias(c) for c in columns]
    )
    return long_form(counts, ["_rows"], columns).select(
        F.col("feature").alias("column_name"), F.col("value").alias("nan_count"),
        F.coalesce(F.try_divide(F.col("value") * F.lit(100.0), F.col("_rows")), F.lit(0.0))
        .alias("nan_percentage"),
    )


def dropna_loss(features: DataFrame) -> DataFrame:
    """Rows a blind drop of incomplete rows would lose."""
    any_missing = F.lit(False)
    for column in features.columns:
        any_missing = any_missing | _missing(column)
    lost, total = F.count_if(any_missing), F.count(F.lit(1))
    return features.agg(
        lost.alias("dropped"), total.alias("total"),
        F.coalesce(F.try_divide(lost * F.lit(100.0), total), F.lit(0.0)).alias("dropped_percentage"),
    )


def class_balance(features: DataFrame) -> DataFrame:
    """Legit and covert rows with their ratio, overall and per protocol."""
    legit, covert = F.count_if(F.col("label") == 0), F.count_if(F.col("label") == 1)
    rows = features.select(F.lower("protocol").alias("protocol"), "label").rollup("protocol").agg(
        F.grouping("protocol").alias("_total"), legit.alias("legit"), covert.alias("covert")
    )
    return rows.select(
        F.when(F.col("_total") == 1, "overall").otherwise(F.col("protocol")).alias("name"),
        "legit", "covert",
        F.when(F.col("covert") > 0, F.concat(
            F.format_string("%.2f", F.col("legit") / F.col("covert")), F.lit(":1")))
        .when(F.col("legit") > 0, "∞:1").otherwise("n/a").alias("ratio"),
    )


PAIR_SCHEMA = T.StructType([
    T.StructField("left", T.StringType()), T.StructField("right", T.StringType()),
    *[T.StructField(n, T.DoubleType()) for n in (
        "n", "x", "y", "xy", "xx", "yy", "x_low", "x_high", "y_low", "y_high")],
])


def pair_moments(columns):
    """Per batch, for every pair over rows with both values: count, means, centred products, ranges."""

    def reduce(frames):
        for frame in frames:
            values = frame.to_numpy(dtype=float)
            present = ~np.isnan(values)
            here = present.astype(float)
            n = here.T @ here
            shift = np.where(present, values, 0.0).sum(axis=0) / np.maximum(here.sum(axis=0), 1.0)
            x = np.where(present, values - shift, 0.0)
            count = np.maximum(n, 1.0)
            sx = x.T @ here
            mean = sx / count
            xy = x.T @ x - sx * sx.T / count
            xx = (x * x).T @ here - sx * mean
            low = np.stack([np.where(present & present[:, [b]], values, np.inf).min(axis=0, initial=np.inf)
                            for b in range(len(columns))], axis=1)
            high = np.stack([np.where(present & present[:, [b]], values, -np.inf).max(axis=0, initial=-np.inf)
                             for b in range(len(columns))], axis=1)
            center = mean + shift[:, None]
            left, right = np.meshgrid(columns, columns, indexing="ij")
            yield pd.DataFrame({
                "left": left.ravel(), "right": right.ravel(), "n": n.ravel(),
                "x": center.ravel(), "y": center.T.ravel(), "xy": xy.ravel(),
                "xx": xx.ravel(), "yy": xx.T.ravel(), "x_low": low.ravel(), "x_high": high.ravel(),
                "y_low": low.T.ravel(), "y_high": high.T.ravel(),
            })

    return reduce


def correlation(features: DataFrame, columns=AUDITED) -> DataFrame:
    """Pearson correlation of every pair over rows where both are present; null if undefined.

    One pass: each batch becomes one small row per pair, then the rows of a pair are merged
    around their common mean, which keeps digits and leaves constant columns recognisable.
    """
    require_columns(features, columns, "feature table")
    numbers = features.select(*[F.col(c).cast("double").alias(c) for c in columns])
    rows = numbers.mapInPandas(pair_moments(list(columns)), PAIR_SCHEMA).filter("n > 0")
    pair = Window.partitionBy("left", "right")
    total = F.sum("n").over(pair)
    dx = F.col("x") - F.sum(F.col("n") * F.col("x")).over(pair) / total
    dy = F.col("y") - F.sum(F.col("n") * F.col("y")).over(pair) / total
    merged = rows.withColumns({"dx": dx, "dy": dy}).groupBy("left", "right").agg(
        F.sum(F.col("xy") + F.col("n") * F.col("dx") * F.col("dy")).alias("xy"),
        F.sum(F.col("xx") + F.col("n") * F.col("dx") * F.col("dx")).alias("xx"),
        F.sum(F.col("yy") + F.col("n") * F.col("dy") * F.col("dy")).alias("yy"),
        ((F.min("x_low") < F.max("x_high")) & (F.min("y_low") < F.max("y_high"))).alias("varies"),
    )
    value = F.when(F.col("varies"), F.try_divide(F.col("xy"), F.sqrt("xx") * F.sqrt("yy")))
    bounded = F.when(value.isNotNull(), F.least(F.greatest(value, F.lit(-1.0)), F.lit(1.0)))
    every = features.sparkSession.createDataFrame(
        [(a, b) for a in columns for b in columns], "left string, right string"
    )
    return every.join(merged, ["left", "right"], "left").select("left", "right", bounded.alias("correlation"))


def near_duplicates(features: DataFrame, columns=AUDITED, limit: float = NEAR_PERFECT) -> DataFrame:
    """Feature pairs, in table order, whose correlation is nearly perfect."""
    order = F.array(*[F.lit(c) for c in columns])
    return correlation(features, columns).filter(
        (F.array_position(order, F.col("left")) < F.array_position(order, F.col("right")))
        & (F.abs("correlation") > limit)
    )


def recommendation(features: DataFrame) -> DataFrame:
    """Whether every group is large enough for a supervised comparison, and which are not."""
    group = F.format_string("%s/label=%d: %d", "protocol", "label", "count")
    short = F.col("count") < MIN_FLOWS
    return class_sizes(features).agg(
        F.when(F.count_if(short) == 0, "SUFFICIENT FOR SUPERVISED COMPARISON")
        .otherwise("UNSUPERVISED-ONLY RECOMMENDED").alias("recommendation"),
        F.coalesce(F.array_join(F.array_sort(F.collect_list(F.when(short, group))), ", "), F.lit(""))
        .alias("below_minimum"),
    )


def _labelled_long(features: DataFrame) -> DataFrame:
    """(protocol, label, feature, value) of the inspected features of each protocol."""
    every = sorted({f for fs in INSPECTED.values() for f in fs})
    require_columns(features, ["protocol", "label", *every], "feature table")
    rows = long_form(
        features.select(F.lower("protocol").alias("protocol"), F.col("label").cast("int").alias("label"),
                        *[F.col(c).cast("double").alias(c) for c in every]),
        ["protocol", "label"], every,
    )
    wanted = F.lit(False)
    for protocol, names in INSPECTED.items():
        wanted = wanted | ((F.col("protocol") == protocol) & F.col("feature").isin(*names))
    return rows.filter(wanted)


def describe_by_label(features: DataFrame) -> DataFrame:
    """Count, mean, sample deviation, minimum, quartiles and maximum per protocol, label, feature."""
    rows, by = _labelled_long(features), ["protocol", "label", "feature"]
    plain = rows.groupBy(*by).agg(
        F.count("value").alias("count"), F.avg("value").alias("mean"),
        F.stddev_samp("value").alias("std"), F.min("value").alias("min"), F.max("value").alias("max"),
    )
    quartiles = exact_percentiles(rows, by, "value", {"q25": 0.25, "q50": 0.5, "q75": 0.75})
    return plain.join(quartiles, by, "left")


def direction_check(features: DataFrame) -> DataFrame:
    """Covert against legit means; one-sided features pass when covert is higher."""
    means = _labelled_long(features).groupBy("protocol", "feature").agg(
        F.avg(F.when(F.col("label") == 0, F.col("value"))).alias("legit_mean"),
        F.avg(F.when(F.col("label") == 1, F.col("value"))).alias("covert_mean"),
    )
    legit, covert = F.col("legit_mean"), F.col("covert_mean")
    both = legit.isNotNull() & covert.isNotNull()
    return means.withColumns({
        "direction": F.when(~both, "n/a").when(covert > legit, "↑").when(covert < legit, "↓").otherwise("→"),
        "two_sided": F.col("feature").isin(*TWO_SIDED),
        "passes": F.when(~F.col("feature").isin(*TWO_SIDED), F.coalesce(covert > legit, F.lit(False))),
    })


def baseline_sessions(features: DataFrame) -> DataFrame:
    """Mean and sample deviation of seven features per legitimate DNS session."""
    require_columns(features, ["protocol", "label", "source_file", *COMPARED], "feature table")
    rows = features.filter((F.lower("protocol") == "dns") & (F.col("label") == 0))
    stats = rows.groupBy("source_file").agg(*[
        F.struct(F.avg(F.col(c).cast("double")).alias("mean"),
                 F.stddev_samp(F.col(c).cast("double")).alias("std")).alias(c) for c in COMPARED
    ])
    return long_form(stats, ["source_file"], COMPARED).select(
        "feature", "source_file", F.col("value.mean").alias("mean"), F.col("value.std").alias("std")
    ).orderBy("feature", "source_file")


def session_totals(features: DataFrame, packets: DataFrame) -> DataFrame:
    """Flow counts of legitimate DNS sessions beside the totals of their raw packets."""
    flows = (
        features.filter((F.lower("protocol") == "dns") & (F.col("label") == 0))
        .groupBy("source_file")
        .agg(F.count(F.lit(1)).alias("flow_count"), F.sum("packet_count").alias("feature_packet_count_sum"))
    )
    raw = packets.groupBy("source_file").agg(
        F.count(F.lit(1)).alias("raw_packet_count"),
        ((F.max("ts_us") - F.min("ts_us")) / F.lit(1e6)).alias("raw_duration_seconds"),
    )
    return flows.join(raw, "source_file", "left").withColumn(
        "raw_packets_per_second", F.try_divide(F.col("raw_packet_count"), F.col("raw_duration_seconds"))
    )
