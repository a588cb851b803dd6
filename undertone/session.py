"""Session settings and durable intermediate tables."""

import tempfile
import uuid
import weakref

from pyspark.sql import DataFrame, SparkSession

# The folder of every stored table, as long as its DataFrame is in use.
_FOLDERS = weakref.WeakKeyDictionary()

# Settings a session for this package should have. Shuffle partitions stay with the cluster;
# adaptive execution coalesces small ones and splits skewed joins.
RECOMMENDED = {
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
    "spark.sql.execution.arrow.maxRecordsPerBatch": "20000",
    "spark.sql.session.timeZone": "UTC",
}


def build_session(app_name="undertone", master=None, **extra) -> SparkSession:
    builder = SparkSession.builder.appName(app_name)
    if master:
        builder = builder.master(master)
    for key, value in {**RECOMMENDED, **extra}.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


def shared_dir(spark: SparkSession) -> str:
    """The folder for intermediate tables: the one the cluster names in spark.checkpoint.dir.

    Only a local session without that setting gets a temporary folder; on a cluster an unset
    folder is an error, since a machine-local path would vanish with its machine.
    """
    context = spark.sparkContext
    named = spark.conf.get("spark.checkpoint.dir", None) or context.getCheckpointDir()
    if named:
        return named
    if not context.master.startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a folder all executors share")
    context.setCheckpointDir(tempfile.mkdtemp(prefix="undertone-"))
    return context.getCheckpointDir()


def durable(df: DataFrame, name="table") -> DataFrame:
    """Write ``df`` once to the shared folder and read it back.

    Cuts the lineage of results that several jobs read, survives lost executors, and keeps
    Parquet column pruning for every later reader. The written size is known to the optimizer,
    so joining a small stored table broadcasts it below spark.sql.autoBroadcastJoinThreshold
    and shuffles it above, without a hint.
    """
    path = f"{shared_dir(df.sparkSession).rstrip('/')}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    stored = df.sparkSession.read.schema(df.schema).parquet(path)
    _FOLDERS[stored] = path
    return stored


def stored(df: DataFrame, name="table") -> DataFrame:
    """``df`` itself if it is a table of ``durable``, else stored as one."""
    return df if df in _FOLDERS else durable(df, name)


def release(*tables: DataFrame) -> None:
    """Remove tables of ``durable`` once everything that reads them has been written itself.

    What is written needs no recomputation, so a lost executor needs none of them again. Other
    DataFrames, also those derived from a stored table, are left alone.
    """
    for table in tables:
        path = _FOLDERS.pop(table, None)
        if path is not None:
            context = table.sparkSession.sparkContext
            folder = context._jvm.org.apache.hadoop.fs.Path(path)
            folder.getFileSystem(context._jsc.hadoopConfiguration()).delete(folder, True)


def checkpointed(df: DataFrame) -> DataFrame:
    """A reliable checkpoint in the shared folder; unlike ``durable`` it keeps the partitioning."""
    context = df.sparkSession.sparkContext
    folder = shared_dir(df.sparkSession)
    if context.getCheckpointDir() is None:
        context.setCheckpointDir(folder)
    return df.checkpoint()
