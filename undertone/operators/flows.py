"""Bidirectional flows by inactivity gap, and windows inside long flows.

A tunnel is one long conversation and may hold a large part of all packets, so no step sorts the
packets of a whole conversation together. Time is cut into slices no longer than the inactivity
timeout. Packets of one conversation inside one slice always belong to one flow, so flow borders
show between slice summaries, which are few: at most one per slice of elapsed time. Packets are
only ever ordered within (conversation, slice).
"""

import itertools

from pyspark.sql import Column, DataFrame, Window, functions as F

from undertone.operators.ordering import positions
from undertone.schema import PROTOCOLS
from undertone.session import durable, release

CONVERSATION = ["source_file", "protocol", "ip_a", "port_a", "ip_b", "port_b"]
# A hash of the conversation leads its key wherever rows are sorted or joined: Spark compares the first 8 bytes
# of the first column quickly, and names of captures and addresses begin alike.
KEYED = ["conversation_hash", *CONVERSATION]
# Once no two conversations are known to share a hash, it stands for the key: names would be most of a row.
FLOW = ["conversation_hash", "flow_start_us"]
PLACE = ["conversation_hash", "slice"]
NO_PORT = -1
SECOND = 1_000_000
# A slice is the most one task may have to sort of one conversation, so a long timeout must not
# lengthen it.
LONGEST_SLICE_US = 30 * SECOND
# Capture positions that fit in one long number beside the microsecond of a slice.
POSITIONS = 1 << 38


def microseconds(seconds) -> int:
    return int(round(seconds * SECOND))


def check_parameters(timeout_seconds, window_seconds=None, min_duration=None):
    if timeout_seconds < 0:
        raise ValueError(f"a timeout of {timeout_seconds} s ends flows before they start; give 0 or more")
    if window_seconds is not None and microseconds(window_seconds) <= 0:
        raise ValueError(f"windows of {window_seconds} s hold no time; give a microsecond or more")
    if min_duration is not None and min_duration < 0:
        raise ValueError(f"min_duration_to_split is {min_duration} s, but no flow is shorter than 0 s")


def port_or_none(port: Column) -> Column:
    """An integer port; null or empty text gives null, other text is an error."""
    text = port.cast("string")
    return F.when(text != "", text).cast("int")


def with_conversation(packets: DataFrame) -> DataFrame:
    """Add the direction-free conversation key: endpoints ordered by address text, then port.

    Key parts are never null, so keys join by plain equality and no packet drops out: missing
    ports, and all ICMP ports, become -1; a missing address or capture name becomes "".
    """
    protocol = F.lower("protocol")

    def endpoint(side):
        port = F.when(protocol == "icmp", F.lit(NO_PORT)).otherwise(
            F.coalesce(port_or_none(F.col(f"{side}_port")), F.lit(NO_PORT))
        )
        ip = F.coalesce(F.col(f"{side}_ip"), F.lit(""))
        return F.struct(ip.alias("ip"), port.alias("port"))

    return (
        packets.withColumn("_a", F.least(endpoint("src"), endpoint("dst")))
        .withColumn("_b", F.greatest(endpoint("src"), endpoint("dst")))
        .withColumns({
            "source_file": F.coalesce("source_file", F.lit("")),
            "protocol": F.coalesce(protocol, F.lit("")),
            "ip_a": F.coalesce("_a.ip", F.lit("")), "port_a": F.coalesce("_a.port", F.lit(NO_PORT)),
            "ip_b": F.coalesce("_b.ip", F.lit("")), "port_b": F.coalesce("_b.port", F.lit(NO_PORT)),
        })
        .drop("_a", "_b")
        .withColumn("conversation_hash", conversation_hash(0))
    )


def conversation_hash(seed: int) -> Column:
    return F.xxhash64(F.lit(seed), *CONVERSATION)


def check_packets(packets: DataFrame) -> DataFrame:
    """Fail the job on a packet without a time, or of a protocol other than DNS or ICMP."""
    known = F.lower("protocol").isin(*PROTOCOLS)
    wrong = F.concat(F.lit("protocol must be 'dns' or 'icmp', not "),
                     F.coalesce("protocol", F.lit("null")))
    return packets.withColumns({
        "protocol": F.when(known, F.lower("protocol"))
        .otherwise(F.raise_error(wrong).cast("string")),
        "ts_us": F.coalesce("ts_us", F.raise_error(F.lit("packet without a time")).cast("long")),
    })


def flow_slices(packets: DataFrame, timeout_us: int) -> DataFrame:
    """One row per (conversation, non-empty slice), with the flow it belongs to.

    Reads only key and time columns. The packet-sized shuffle is pre-aggregated on the map side
    and spreads a busy conversation over its slices.
    """
    # Time in the slice and capture position in one number: unlike a struct it aggregates by hash, unsorted.
    # A position of over 38 bits takes a decimal, which is slow.
    start = F.col("ts_us") - F.pmod("ts_us", F.lit(slice_length(timeout_us)))
    fits = F.col("packet_seq").between(0, POSITIONS - 1)
    narrow = (F.col("ts_us") - start) * F.lit(POSITIONS) + F.col("packet_seq")
    base = F.lit("1" + "0" * 19).cast("decimal(20,0)")

    def wide(ts, position):
        return ((ts.cast("decimal(19,0)") * base).cast("decimal(38,0)") + position).cast("decimal(38,0)")

    slices = packets.withColumn("slice", slice_of(timeout_us)).groupBy(*KEYED, "slice").agg(
        F.min("ts_us").alias("first_us"),
        F.max("ts_us").alias("last_us"),
        F.min(F.when(fits, narrow)).alias("_narrow"),
        F.min(F.when(~fits, wide(F.col("ts_us"), F.col("packet_seq")))).alias("_wide"),
    )
    from_narrow = F.pmod("_narrow", F.lit(POSITIONS))
    narrow_us = F.col("slice") * F.lit(slice_length(timeout_us)) + F.call_function("div", F.col("_narrow"), F.lit(POSITIONS))
    least = F.least(F.col("_wide"), F.when(F.col("_narrow").isNotNull(), wide(narrow_us, from_narrow)))
    slices = slices.withColumn(
        "slice_seq",
        F.when(F.col("_wide").isNull(), from_narrow)
        .otherwise((least - wide(F.col("first_us"), F.lit(0))).cast("bigint")),
    ).drop("_narrow", "_wide")
    in_order = Window.partitionBy(*KEYED).orderBy("slice")
    up_to_here = in_order.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    whole_flow = Window.partitionBy(*KEYED, "flow_start_us")
    before = F.lag("last_us").over(in_order)
    is_head = F.col("before_us").isNull() | (F.col("first_us") - F.col("before_us") > F.lit(timeout_us))
    return (
        slices.withColumn("before_us", before)
        .withColumns({"is_head": is_head, "before_us": F.when(~is_head, F.col("before_us"))})
        .withColumn("flow_start_us", F.max(F.when(F.col("is_head"), F.col("first_us"))).over(up_to_here))
        .withColumns({
            "flow_end_us": F.max("last_us").over(whole_flow),
            "flow_seq": F.max(F.when(F.col("is_head"), F.col("slice_seq"))).over(whole_flow),
        })
        .withColumn("is_tail", F.col("last_us") == F.col("flow_end_us"))
        .drop("last_us", "slice_seq")
    )


def stored_slices(packets: DataFrame, timeout_us: int) -> tuple[DataFrame, DataFrame]:
    """Checked packets by conversation, and their slices, stored. No two conversations share a ``conversation_hash``.

    Several plans read the slices; stored, their windows are computed once. Should two conversations share a hash,
    the next seed is tried, so the hash is as exact a key as the names.
    """
    checked = with_conversation(check_packets(packets))
    for seed in itertools.count():
        keyed = checked.withColumn("conversation_hash", conversation_hash(seed))
        slices = durable(flow_slices(keyed, timeout_us), "slices")
        names = slices.filter("is_head").select(*KEYED).distinct()
        if names.groupBy("conversation_hash").count().filter("count > 1").isEmpty():
            return keyed, slices
        release(slices)


def slice_length(timeout_us: int) -> int:
    return min(max(timeout_us, 1), LONGEST_SLICE_US)


def slice_of(timeout_us: int) -> Column:
    """Whole-number slice index; exact for times before 1970 too.

    A slice is never longer than the timeout, so no flow can end inside it.
    """
    slice_us = slice_length(timeout_us)
    return F.expr(f"(ts_us - pmod(ts_us, {slice_us}L)) div {slice_us}L")


def place_packets(packets: DataFrame, slices: DataFrame, timeout_us, window_us, min_duration_us):
    """Give every packet its flow, its window and the gap to its predecessor in that window.

    Adds flow_start_us, flow_end_us, flow_seq, is_long, window_bin (bins counted from the flow
    start, the lone last packet of a long flow moved to the bin before it) and gap_us.
    """
    in_slice = Window.partitionBy(*PLACE).orderBy("ts_us", "packet_seq")
    # Neighbours first: the slice sort then also serves the join.
    ordered = (
        packets.withColumn("slice", slice_of(timeout_us))
        .withColumn("_previous", F.lag("ts_us").over(in_slice))
        .withColumn("_is_last", F.lead("ts_us").over(in_slice).isNull())
    )
    joined = ordered.join(slices.drop(*CONVERSATION), PLACE)

    def bin_of(ts):
        offset = F.call_function("div", ts - F.col("flow_start_us"), F.lit(window_us).cast("long"))
        return F.when(F.col("is_long"), offset).otherwise(F.lit(0).cast("long"))

    return (
        joined.withColumn("_previous", F.coalesce("_previous", "before_us"))
        .withColumn("is_long", F.col("flow_end_us") - F.col("flow_start_us") >= F.lit(min_duration_us))
        .withColumn("_bin", bin_of(F.col("ts_us")))
        .withColumn("_previous_bin", F.when(F.col("_previous").isNotNull(), bin_of(F.col("_previous"))))
        # The last packet is alone in its bin exactly when its predecessor sits in an earlier one.
        .withColumn(
            "window_bin",
            F.when(F.col("is_tail") & F.col("_is_last"), F.coalesce("_previous_bin", "_bin"))
            .otherwise(F.col("_bin")),
        )
        .withColumn(
            "gap_us",
            F.when(F.col("_previous_bin") == F.col("window_bin"), F.col("ts_us") - F.col("_previous")),
        )
        .drop("_previous", "_is_last", "_bin", "_previous_bin", "before_us", "is_head", "is_tail",
              "first_us", "slice")
    )


def number_flows(slices: DataFrame) -> DataFrame:
    """Per capture, number flows from 0 in order of their first packet.

    Equal start times are ordered by capture position. Ranked through one-second buckets, so
    a capture with very many flows is never one sort.
    """
    heads = slices.filter("is_head").select(
        *FLOW, *CONVERSATION, "flow_seq",
        F.expr(f"(flow_start_us - pmod(flow_start_us, {SECOND}L)) div {SECOND}L").alias("second"),
    )
    order = ["flow_start_us", "flow_seq", *CONVERSATION[1:]]
    return positions(heads, ["source_file"], "second", order, "flow_number").drop("second")


def assign_flows(packets: DataFrame, timeout_seconds: float = 30) -> DataFrame:
    """Packets plus ``flow_id`` (BIGINT, per capture). A gap equal to the timeout stays inside."""
    check_parameters(timeout_seconds)
    timeout_us = microseconds(timeout_seconds)
    keyed, slices = stored_slices(packets, timeout_us)
    numbered = number_flows(slices)
    placed = keyed.withColumn("slice", slice_of(timeout_us)).join(
        slices.join(numbered.select(*FLOW, "flow_seq", "flow_number"), [*FLOW, "flow_seq"])
        .select(*PLACE, F.col("flow_number").cast("long").alias("flow_id")),
        PLACE,
    )
    return placed.select(*packets.columns, "flow_id")
