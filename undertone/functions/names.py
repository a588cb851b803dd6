"""Capture file names: ``{protocol}_{source}_{legit|covert}_{timestamp}.pcap``."""

from pyspark.sql import Column, functions as F

# Fixed value: the name format. ``\z`` because Java's ``$`` also matches before a final newline.
CAPTURE_NAME = r"\A([^_]+)_([^_]+)_(legit|covert)_([0-9]{8}T[0-9]{6}Z)\.pcap\z"
PARTS = ("protocol", "source", "condition", "timestamp")


def parse_capture_name(name: Column) -> Column:
    """A struct of the four parts, or null for any other name."""
    parts = [F.regexp_extract(name, CAPTURE_NAME, i + 1).alias(p) for i, p in enumerate(PARTS)]
    return F.when(name.rlike(CAPTURE_NAME), F.struct(*parts))


def capture_time(timestamp: Column) -> Column:
    """The capture's start as a zone-free UTC timestamp; null for impossible dates."""
    digits = F.regexp_replace(timestamp, "[TZ]", "")
    return F.try_to_timestamp(digits, F.lit("yyyyMMddHHmmss")).cast("timestamp_ntz")
