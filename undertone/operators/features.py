"""One feature row per short flow or per window of a long flow."""

from pyspark.sql import Column, DataFrame, Window, functions as F

from undertone.functions.scalars import is_txt_or_null, payload_scalars
from undertone.operators.flows import (
    FLOW, SECOND, check_parameters, microseconds, number_flows, place_packets, stored_slices,
)
from undertone.schema import FLOW_FEATURE_COLUMNS


def ratio(numerator: Column, denominator: Column) -> Column:
    """numerator / denominator, 0 where the denominator is 0 or missing."""
    return F.coalesce(F.try_divide(numerator, denominator), F.lit(0.0))


def mean_std_cv(value: Column, prefix: str) -> list[Column]:
    """Mean, population deviation and their ratio; all 0 for no values."""
    mean = F.coalesce(F.avg(value), F.lit(0.0))
    spread = F.coalesce(F.stddev_pop(value), F.lit(0.0))
    return [
        mean.alias(f"{prefix}_mean"), spread.alias(f"{prefix}_std"),
        ratio(spread, mean).alias(f"{prefix}_cv"),
    ]


def icmp_size_cv(length: Column) -> Column:
    """Population coefficient of variation of the non-null lengths."""
    return ratio(F.stddev_pop(length), F.avg(length))


def dns_query_anomaly(query_length: Column, qtype: Column) -> list[Column]:
    """Mean and longest query, and the TXT/NULL share among packets with a known type."""
    zero = F.lit(0.0)
    return [
        F.coalesce(F.avg(query_length), zero).alias("mean_query_length"),
        F.coalesce(F.avg(is_txt_or_null(qtype)), zero).alias("txt_null_ratio"),
        F.coalesce(F.max(query_length).cast("double"), zero).alias("max_query_length"),
    ]


def with_payload_scalars(packets: DataFrame) -> DataFrame:
    """Replace the payload by its entropy and compression ratio, in the scan stage.

    The payload is the widest column; dropping it here keeps it out of every shuffle.
    """
    if "payload_bytes" not in packets.columns:
        return packets
    return (
        packets.withColumn("_payload", payload_scalars("payload_bytes"))
        .withColumns({"entropy": F.col("_payload.entropy"),
                      "compression_ratio": F.col("_payload.ratio")})
        .drop("_payload", "payload_bytes")
    )


def placed_packets(packets, timeout_seconds, window_seconds, min_duration_to_split):
    """Packets in their flow windows, and the slices that define the flows."""
    check_parameters(timeout_seconds, window_seconds, min_duration_to_split)
    timeout_us = microseconds(timeout_seconds)
    keyed, slices = stored_slices(packets, timeout_us)
    placed = place_packets(
        with_payload_scalars(keyed), slices, timeout_us,
        microseconds(window_seconds), microseconds(min_duration_to_split),
    )
    return placed, slices


def aggregate_windows(placed: DataFrame) -> DataFrame:
    """Side-channel statistics per (flow, window). Aggregated on the map side before its shuffle."""
    seconds = F.col("gap_us") / F.lit(float(SECOND))
    query = [
        *dns_query_anomaly(F.col("query_length"), F.col("qtype")),
        icmp_size_cv(F.col("payload_length")).alias("icmp_size_cv"),
    ]
    rows = placed.groupBy(*FLOW, "window_bin").agg(
        F.count(F.lit(1)).alias("packet_count"),
        F.min("ts_us").alias("window_start_us"),
        F.max("ts_us").alias("window_end_us"),
        F.max("flow_seq").alias("flow_seq"),
        F.max("is_long").alias("is_long"),
        *mean_std_cv(F.col("packet_size"), "size"),
        *mean_std_cv(seconds, "interarrival"),
        F.avg("entropy").alias("entropy_mean"),
        F.max("entropy").alias("entropy_max"),
        F.avg("compression_ratio").alias("compression_ratio_mean"),
        F.max("compression_ratio").alias("compression_ratio_max"),
        *query,
    )
    return rows.withColumns({
        "duration_seconds": (F.col("window_end_us") - F.col("window_start_us")) / F.lit(float(SECOND)),
        "is_single_packet_flow": F.col("packet_count") == 1,
    })


def name_windows(windows: DataFrame, numbered: DataFrame) -> DataFrame:
    """Attach the names of the conversation and ``flow_id``: the flow number, with ``_w{k}`` for window k of a long flow.

    Columns of the other protocol become null.
    """
    index = F.row_number().over(Window.partitionBy(*FLOW, "flow_seq").orderBy("window_bin")) - 1
    named = windows.withColumn("window_index", index).join(numbered, [*FLOW, "flow_seq"])
    number = F.col("flow_number").cast("string")
    dns, icmp = F.col("protocol") == "dns", F.col("protocol") == "icmp"
    only = {"mean_query_length": dns, "txt_null_ratio": dns, "max_query_length": dns, "icmp_size_cv": icmp}
    return named.withColumns({
        "flow_id": F.when(F.col("is_long"), F.concat(number, F.lit("_w"), F.col("window_index").cast("string")))
        .otherwise(number),
        **{name: F.when(where, F.col(name)) for name, where in only.items()},
    })


def build_flow_features(
    packets: DataFrame,
    timeout_seconds: float = 30.0,
    window_seconds: float = 30.0,
    min_duration_to_split: float = 60.0,
    include_timestamps: bool = False,
) -> DataFrame:
    """Feature rows of all captures and both protocols in one plan.

    ``packets`` follows ``schema.PACKET_SCHEMA``; captures are told apart by ``source_file``.
    Columns of the other protocol are null.
    """
    placed, slices = placed_packets(packets, timeout_seconds, window_seconds, min_duration_to_split)
    named = name_windows(aggregate_windows(placed), number_flows(slices))
    extra = [
        (F.col("window_start_us") / F.lit(float(SECOND))).alias("start_timestamp"),
        (F.col("window_end_us") / F.lit(float(SECOND))).alias("end_timestamp"),
    ] if include_timestamps else []
    return named.select(*FLOW_FEATURE_COLUMNS, "source_file", *extra)
