"""A feature dataset that follows a folder of captures: a refresh reads only what is new or changed.

Each refresh compares the folder with the manifest of the last one, builds the rows of captures that are
new or differ in length or time of change, and writes them to a folder of their own with a manifest that
names, for every capture, the run its rows are in. The commit of that manifest makes all of it visible at
once; rows of changed and removed captures are in no manifest from then on.
"""

import json
import uuid

from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql.types import StructField, StructType, StringType

from undertone.plans.dataset import build_dataset
from undertone.schema import DATASET_COLUMNS, DATASET_SCHEMA
from undertone.session import durable
from undertone.sources.capture_format import load_captures
from undertone.sources.history import DIGITS, LOG, Folder, commits
from undertone.sources.manifest import named_captures
from undertone.sources.tables import in_dataset_order

RUNS, MANIFESTS = "runs", "manifests"
MANIFEST = "filename string, length bigint, modified bigint, run string, error string"


def list_files(spark: SparkSession, folder: str) -> DataFrame:
    """(filename, length, modified) of a folder's files; their contents are not read."""
    files = spark.read.format("binaryFile").load(folder)
    return files.select(
        F.element_at(F.split("path", "/"), -1).alias("filename"), "length",
        F.unix_micros("modificationTime").alias("modified"))


def read_manifest(spark: SparkSession, table: str, version: int | None = None) -> DataFrame:
    """The manifest as of a version, or the newest one; empty before the first refresh."""
    known = commits(spark, table)
    if version is not None and version not in known:
        raise ValueError(f"version {version} is not in the dataset, which has {sorted(known)}")
    if not known:
        return spark.createDataFrame([], MANIFEST)
    run = known[max(known) if version is None else version]["run"]
    return spark.read.schema(MANIFEST).parquet(f"{table}/{MANIFESTS}/{run}")


def changes(before: DataFrame, now: DataFrame) -> DataFrame:
    """One row per file of either listing: filename, length, modified, run, error and ``change``."""
    old = before.select(F.col("filename").alias("_name"), F.col("length").alias("_length"), F.col("modified").alias("_modified"), "run", "error")
    same = (F.col("length") == F.col("_length")) & (F.col("modified") == F.col("_modified"))
    return now.join(old, F.col("filename") == F.col("_name"), "full").select(
        F.coalesce("filename", "_name").alias("filename"), "length", "modified", "run", "error",
        F.when(F.col("_name").isNull(), "new").when(F.col("filename").isNull(), "removed")
        .when(same, "kept").otherwise("changed").alias("change"))


def refresh(spark: SparkSession, folder: str, table: str, **flow_parameters) -> DataFrame:
    """Bring the dataset at ``table`` up to the captures in ``folder``; returns what changed.

    Damaged and refused captures have no rows and their reason in the manifest; they are read again only
    once they change. Of two refreshes at once one fails and changes nothing.
    """
    known = commits(spark, table)
    found = durable(changes(read_manifest(spark, table), list_files(spark, folder)), "changes")
    run = uuid.uuid4().hex
    touched = found.filter(F.col("change").isin("new", "changed"))
    # Names of captures reach the driver, as in any listing; the reader plans only these files.
    names = [r["filename"] for r in touched.select("filename").collect()]
    if names:
        packets, problems = load_captures(spark, folder, where=F.col("source_file").isin(names))
        packets = durable(packets, "packets")
        dataset, failures = build_dataset(named_captures(touched.select("filename", "length")), packets, **flow_parameters)
        in_dataset_order(dataset).write.parquet(f"{table}/{RUNS}/run={run}")
        # A packet that cannot be decoded costs that packet, not its capture.
        whole = packets.select(F.col("source_file").alias("_ok")).distinct()
        reasons = problems.select("source_file", "error").unionByName(failures.toDF("source_file", "error"))
        reasons = reasons.groupBy("source_file").agg(F.min("error").alias("_reason")).join(
            whole, F.col("source_file") == F.col("_ok"), "left_anti")
        touched = touched.drop("run", "error").join(reasons, F.col("filename") == F.col("source_file"), "left").select(
            "filename", "length", "modified", F.lit(run).alias("run"), F.col("_reason").alias("error"))
    else:
        touched = touched.drop("change")
    columns = ["filename", "length", "modified", "run", "error"]
    kept = found.filter("change = 'kept'").select(*columns)
    kept.unionByName(touched.select(*columns)).write.parquet(f"{table}/{MANIFESTS}/{run}")
    version = max(known, default=0) + 1
    if not Folder(spark, f"{table}/{LOG}").create(f"{version:0{DIGITS}d}.json", json.dumps({"run": run})):
        raise RuntimeError(f"another refresh has made version {version} of {table}; run this one again")
    return found.select("filename", "change")


def read_dataset(spark: SparkSession, table: str, version: int | None = None) -> DataFrame:
    """The dataset's rows as of a version, or the newest one, with the run that built them."""
    manifest = read_manifest(spark, table, version).select(F.col("filename").alias("_file"), F.col("run").alias("_run"))
    runs = [r["_run"] for r in manifest.select("_run").distinct().collect()]
    schema = StructType([*DATASET_SCHEMA, StructField("run", StringType())])
    written = {name.removeprefix("run=") for name in Folder(spark, f"{table}/{RUNS}").names()}
    paths = [f"{table}/{RUNS}/run={run}" for run in runs if run in written]
    if not paths:
        return spark.createDataFrame([], schema)
    rows = spark.read.schema(schema).option("basePath", f"{table}/{RUNS}").parquet(*paths)
    current = (F.col("source_file") == F.col("_file")) & (F.col("run") == F.col("_run"))
    return rows.join(manifest, current, "left_semi").select(*DATASET_COLUMNS, "run")
