"""The inventory of capture files."""

from pyspark.sql import DataFrame, SparkSession, functions as F

from undertone.functions.names import PARTS, capture_time, parse_capture_name
from undertone.schema import MANIFEST_COLUMNS, MANIFEST_SCHEMA
from undertone.sources.captures import capture_splits, list_captures, packet_counts


def named_captures(files: DataFrame) -> DataFrame:
    """Keep files whose ``filename`` follows the capture name format; one manifest row each."""
    named = files.withColumn("_parts", parse_capture_name(F.col("filename"))).filter("_parts is not null")
    size = F.col("length") if "length" in files.columns else F.lit(None)
    return named.select(
        "filename", *[F.col(f"_parts.{p}").alias(p) for p in PARTS],
        size.cast("long").alias("file_size_bytes"), F.lit(None).cast("long").alias("packet_count"),
    )


def scan_capture_dir(spark: SparkSession, path, count_packets: bool = False) -> DataFrame:
    """One row per validly named ``*.pcap`` in a directory, by name.

    ``count_packets`` fills packet_count from a pass over the record headers.
    """
    files = list_captures(spark, path, "*.pcap")
    manifest = named_captures(files)
    if count_packets:
        counts = packet_counts(capture_splits(files)).withColumnRenamed("source_file", "filename")
        manifest = manifest.drop("packet_count").join(counts, "filename", "left")
    return manifest.select(*MANIFEST_COLUMNS).orderBy("filename")


def write_manifest(manifest: DataFrame, path):
    manifest.select(*MANIFEST_COLUMNS).write.mode("overwrite").csv(path, header=True)


def read_manifest(spark: SparkSession, path) -> DataFrame:
    return spark.read.schema(MANIFEST_SCHEMA).csv(path, header=True)


def summarize_manifest(manifest: DataFrame) -> DataFrame:
    """Captures by protocol and condition."""
    return (
        manifest.groupBy("protocol", "condition").agg(F.count(F.lit(1)).alias("count"))
        .orderBy("protocol", "condition")
    )


def with_capture_time(manifest: DataFrame) -> DataFrame:
    return manifest.withColumn("captured_at", capture_time(F.col("timestamp")))
