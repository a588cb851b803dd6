"""A table of scored windows that a stream writes exactly once, with a place for rows that have no score.

Each batch of the stream writes its rows to a folder of their own and commits that folder under the
batch's number. A batch that runs again, after a lost driver or a restart, finds its commit and changes
nothing; rows of an attempt that was never committed are not read.
"""

import json
import uuid

from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.types import BooleanType, StringType, StructField, StructType

from undertone.sources.history import DIGITS, LOG, Folder, commits

BATCHES = "batches"
SCORES = ("isolation_forest_score", "autoencoder_reconstruction_error")


def with_reason(scored: DataFrame) -> DataFrame:
    """Add ``reason``: null for a usable row, else which score is missing or not finite."""
    reason = F.lit(None).cast("string")
    for name in reversed(SCORES):
        value = F.col(name)
        usable = value.isNotNull() & ~F.isnan(value) & (F.abs(value) != float("inf"))
        reason = F.when(~usable, F.lit(f"no finite {name}")).otherwise(reason)
    return scored.withColumn("reason", reason)


def commit_batch(scored: DataFrame, batch: int, path: str) -> bool:
    """Add the rows of one batch to the table, once. Tells whether this call did it."""
    spark = scored.sparkSession
    folder, name = Folder(spark, f"{path}/{LOG}"), f"{batch:0{DIGITS}d}.json"
    if batch in commits(spark, path):
        return False
    run = uuid.uuid4().hex
    # One write for both kinds of rows, so the batch is computed once.
    rows = with_reason(scored)
    rows.withColumn("quarantined", F.col("reason").isNotNull()).write.partitionBy("quarantined").parquet(f"{path}/{BATCHES}/run={run}")
    text = json.dumps({"run": run})
    if folder.create(name, text):
        return True
    if batch in commits(spark, path):
        return False
    # The commit of a writer lost before it wrote the content.
    folder.replace(name, text)
    return True


def write_scored(scored: DataFrame, path: str, progress: str, **trigger) -> StreamingQuery:
    """Start writing a scored stream to the table at ``path``; ``trigger`` as for a stream writer."""
    def sink(rows, batch):
        commit_batch(rows, batch, path)

    return (scored.writeStream.foreachBatch(sink).outputMode("append").option("checkpointLocation", progress)
            .trigger(**(trigger or {"availableNow": True})).start())


def read_batches(spark: SparkSession, path: str, schema: StructType) -> DataFrame:
    """Rows of every committed batch: one folder a batch, named on the driver."""
    whole = StructType([*schema, StructField("reason", StringType()), StructField("run", StringType()),
                        StructField("quarantined", BooleanType())])
    runs = [f"{path}/{BATCHES}/run={c['run']}" for _, c in sorted(commits(spark, path).items())]
    if not runs:
        return spark.createDataFrame([], whole).drop("run")
    return spark.read.schema(whole).option("basePath", f"{path}/{BATCHES}").parquet(*runs).drop("run")


def read_scored(spark: SparkSession, path: str, schema: StructType) -> DataFrame:
    """Committed rows with usable scores; ``schema`` is that of the scored stream."""
    return read_batches(spark, path, schema).filter("not quarantined").drop("reason", "quarantined")


def read_quarantine(spark: SparkSession, path: str, schema: StructType) -> DataFrame:
    """Committed rows without usable scores, and why."""
    return read_batches(spark, path, schema).filter("quarantined").drop("quarantined")
