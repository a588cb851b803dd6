"""The history of evaluation runs: a table whose versions are commits.

A run's rows are written to a folder of their own. The commit that makes them part of the table is a
small file named by the next version number, created only where no such file exists, so of two writers
that want the same number one wins and the other takes the next. A reader takes the folders named by the
commits up to a version, all at once; a run half written, or written by a task that ran twice, is
in no commit.
"""

import json
import uuid

from pyspark.sql import DataFrame, SparkSession

from undertone.operators.results import evaluation_report
from undertone.schema import RESULT_SCHEMA

LOG, RUNS, DIGITS = "_commits", "runs", 12


class Folder:
    """Names and small files of one folder of any file system that Spark can write to."""

    def __init__(self, spark: SparkSession, path: str):
        hadoop = spark._jvm.org.apache.hadoop.fs
        self.make = lambda name: hadoop.Path(f"{path}/{name}")
        self.root = hadoop.Path(path)
        self.system = self.root.getFileSystem(spark._jsc.hadoopConfiguration())
        self.jvm = spark._jvm

    def names(self) -> list:
        if not self.system.exists(self.root):
            return []
        return sorted(status.getPath().getName() for status in self.system.listStatus(self.root))

    def read(self, name: str) -> str:
        stream = self.system.open(self.make(name))
        try:
            return bytes(stream.readAllBytes()).decode()
        finally:
            stream.close()

    def create(self, name: str, text: str) -> bool:
        """Create the file with this content unless it exists; tells whether it did."""
        self.system.mkdirs(self.root)
        try:
            if self.system.getScheme() == "file":
                # The local file system's own check is not atomic.
                local = self.jvm.java.io.File(self.make(name).toUri().getPath())
                if not local.createNewFile():
                    return False
                stream = self.system.create(self.make(name), True)
            else:
                stream = self.system.create(self.make(name), False)
        except Exception as error:
            if "AlreadyExists" in str(error):
                return False
            raise
        stream.write(text.encode())
        stream.close()
        return True

    def replace(self, name: str, text: str):
        stream = self.system.create(self.make(name), True)
        stream.write(text.encode())
        stream.close()


def commits(spark: SparkSession, path: str) -> dict:
    """{version: commit}; a commit whose writer was lost before it wrote the content counts for nothing."""
    folder, found = Folder(spark, f"{path}/{LOG}"), {}
    for name in folder.names():
        if name.endswith(".json"):
            try:
                found[int(name[:DIGITS])] = json.loads(folder.read(name))
            except json.JSONDecodeError:
                continue
    return found


def append_run(results: DataFrame, path: str, attempts: int = 100) -> int:
    """Add a run to the history and return the version that holds it. Any number may append at once."""
    spark, run = results.sparkSession, uuid.uuid4().hex
    results.write.parquet(f"{path}/{RUNS}/{run}")
    folder = Folder(spark, f"{path}/{LOG}")
    taken = [int(name[:DIGITS]) for name in folder.names() if name.endswith(".json")]
    version = max(taken, default=0) + 1
    for _ in range(attempts):
        if folder.create(f"{version:0{DIGITS}d}.json", json.dumps({"run": run})):
            return version
        version += 1
    raise RuntimeError(f"no free version for a run after {attempts} attempts, the last was {version - 1}")


def read_history(spark: SparkSession, path: str, version: int | None = None, schema=RESULT_SCHEMA) -> DataFrame:
    """All runs as of ``version``, or now. Columns an older run lacks are null; without runs it is empty.

    The list of runs is fixed when this is called: later appends do not change what the result reads.
    """
    known = commits(spark, path)
    if version is not None and version not in known:
        raise ValueError(f"version {version} is not in the history, which has {sorted(known)}")
    runs = [f"{path}/{RUNS}/{c['run']}" for v, c in sorted(known.items()) if version is None or v <= version]
    if not runs:
        return spark.createDataFrame([], schema)
    return spark.read.schema(schema).parquet(*runs)


def history_report(spark: SparkSession, path: str, protocol: str, version: int | None = None) -> dict:
    """The newest run of a protocol, with the summaries of its rates."""
    return evaluation_report(read_history(spark, path, version), protocol)
