"""A gang: tasks that run side by side, hold shares of one table and add up arrays step by step.

Spark launches all members together (a barrier stage); when one is lost it starts the whole stage
again, so a step never misses a share. Members exchange arrays as files of the folder all executors
share, where that takes milliseconds, else through ``allGather``, which takes a second and passes the
driver. A gang is only as large as its exchange allows. What is computed depends on the rows
alone: one member, or twenty, add up the same terms.
"""

import base64
import math
import os
import time
import uuid

import numpy as np
import pyarrow as pa
from pyspark import BarrierTaskContext
from pyspark.sql import DataFrame, SparkSession

from undertone.session import shared_dir

# Bytes that all steps together may send through the driver, or read from the shared folder.
TRAFFIC, FOLDER_TRAFFIC = 1 << 34, 1 << 38
# Seconds of an all-reduce through the driver, and those beyond which files are no better.
GATHER_SECONDS, SLOW_FILES = 1.0, 0.2
# Work of one member, in seconds, that is worth the two or three that a trial of the folder takes.
WORTH_A_TRIAL = 60
TRIAL_ROUNDS = 20
# Seconds of a file exchange by application and folder, once tried.
_TRIED: dict = {}


class Slow(Exception):
    """A file did not come in time."""


class FileExchange:
    """Arrays of all members, step by step, through two small files a member.

    Odd and even steps have a file each: a mark with the number of the step, written last, and behind it the
    array. Whoever has all arrays of a step knows that all members have read those of the step before.
    """

    def __init__(self, folder: str, context: BarrierTaskContext, size: int):
        # A stage that starts again must not meet the files of the attempt before: members agree on a name.
        self.name = context.allGather(uuid.uuid4().hex)[0]
        self.folder, self.member, self.size, self.step = f"{folder}/{self.name}", context.partitionId(), size, 0
        os.makedirs(self.folder, exist_ok=True)
        self.open = {(self.member, k): os.open(self.path(self.member, k), os.O_RDWR | os.O_CREAT, 0o666) for k in (0, 1)}

    def path(self, member, turn):
        return f"{self.folder}/{member}-{turn}"

    def mark(self):
        return f"{self.name}{self.step:020d}".encode()

    def read(self, member, length, patience):
        """A member's array of the current step; waits for it."""
        start, mark, key = time.monotonic(), self.mark(), (member, self.step % 2)
        while True:
            if key not in self.open and os.path.exists(self.path(*key)):
                self.open[key] = os.open(self.path(*key), os.O_RDONLY)
            if key in self.open and os.pread(self.open[key], len(mark), 0) == mark:
                return os.pread(self.open[key], length, len(mark))
            if time.monotonic() - start > patience:
                raise Slow(self.path(*key))
            time.sleep(0.0001)

    def parts(self, data: bytes, patience=math.inf) -> list:
        """Every member's ``data`` of this step, all of one length, in the members' order."""
        self.step += 1
        own, mark = self.open[self.member, self.step % 2], self.mark()
        os.pwrite(own, data, len(mark))
        os.pwrite(own, mark, 0)
        return [data if m == self.member else self.read(m, len(data), patience) for m in range(self.size)]

    def close(self):
        for file in self.open.values():
            os.close(file)


class Gang:
    """What a member knows of its gang."""

    def __init__(self, size: int, folder: str | None = None):
        self.size, self.files = size, None
        if folder and size > 1:
            self.files = FileExchange(folder, BarrierTaskContext.get(), size)

    def close(self):
        if self.files:
            self.files.close()

    @property
    def leads(self) -> bool:
        return self.size == 1 or BarrierTaskContext.get().partitionId() == 0

    def total(self, array: np.ndarray) -> np.ndarray:
        """The sum of every member's array, in the members' order, so all hold the same bits."""
        if self.size == 1:
            return array
        if self.files:
            parts = self.files.parts(np.ascontiguousarray(array, np.float64).tobytes())
            return sum(np.frombuffer(part, np.float64) for part in parts).reshape(array.shape)
        text = base64.b64encode(np.ascontiguousarray(array, np.float64).tobytes()).decode("ascii")
        parts = BarrierTaskContext.get().allGather(text)
        return sum(np.frombuffer(base64.b64decode(part), np.float64) for part in parts).reshape(array.shape)


def local_folder(spark: SparkSession) -> str | None:
    """The shared folder as tasks may open it, or None for a store that plain files do not reach."""
    folder = shared_dir(spark).rstrip("/")
    if folder.startswith("file:"):
        return "/" + folder[5:].lstrip("/")
    return None if ":/" in folder else folder


def exchange_seconds(spark: SparkSession) -> float:
    """What an all-reduce of small files takes between all slots of the cluster, tried once per application."""
    folder, size = local_folder(spark), spark.sparkContext.defaultParallelism
    if folder is None or size < 2:
        return math.inf
    known = spark.sparkContext.applicationId, folder
    if known not in _TRIED:
        place = f"{folder}/gang-{uuid.uuid4().hex}"

        def trial(batches):
            for _ in batches:
                pass
            seconds = math.inf
            try:
                files = FileExchange(place, BarrierTaskContext.get(), size)
                # The first round waits for whoever left the barrier last.
                files.parts(bytes(8), patience=5.0)
                start = time.monotonic()
                for _ in range(TRIAL_ROUNDS):
                    files.parts(bytes(8), patience=2.0)
                seconds = (time.monotonic() - start) / TRIAL_ROUNDS
                files.close()
            except (OSError, Slow):
                pass
            yield pa.RecordBatch.from_pydict({"seconds": [seconds]})

        rows = spark.range(size, numPartitions=size).mapInArrow(trial, "seconds double", barrier=True).collect()
        remove(spark, place)
        _TRIED[known] = max(r["seconds"] for r in rows)
    return _TRIED[known]


def remove(spark: SparkSession, folder: str):
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"file://{folder}")
    path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


def gang_size(spark, rows: int, steps: int, numbers: int, worth: int, pause: float = GATHER_SECONDS) -> int:
    """Members for ``rows`` rows that are gone over in every step, with ``numbers`` numbers added up.

    ``worth`` rows are a second's work and an all-reduce takes ``pause`` seconds; a member must have as much
    work in a step, and small tables are quickest with a gang of one. Through the driver the pause is a
    second, as Spark looks for the end of an all-gather once a second. No more
    members than the cluster can run at once: a barrier stage waits for all its slots.
    """
    limit, size = (TRAFFIC, 11) if pause >= GATHER_SECONDS else (FOLDER_TRAFFIC, 8)
    traffic = math.isqrt(limit // max(1, steps * numbers * size))
    return max(1, min(int(rows / (worth * pause)), spark.sparkContext.defaultParallelism, traffic))


def plan_gang(spark, rows: int, steps: int, numbers: int, worth: int) -> tuple[int, str | None]:
    """(members, folder of their files): ``gang_size`` by the quicker of both ways to exchange arrays."""
    if rows / worth * steps > WORTH_A_TRIAL:
        pause = exchange_seconds(spark)
        if pause <= SLOW_FILES:
            size = gang_size(spark, rows, steps, numbers, worth, max(pause, 0.001))
            if size > 1:
                return size, f"{local_folder(spark)}/gang-{uuid.uuid4().hex}"
    return gang_size(spark, rows, steps, numbers, worth), None


def run_gang(rows: DataFrame, size: int, key: str, order, function, schema, folder: str | None = None) -> list:
    """``function(gang, batches)`` on ``size`` shares of ``rows``, dealt by ``key`` and sorted by ``order``.

    Each member gets the Arrow batches of its share; what they yield, a bounded number of rows, is returned.
    ``folder`` is where members exchange files, if they do; it is removed in the end.
    """
    def member(batches):
        gang = Gang(size, folder)
        yield from function(gang, batches)
        gang.close()

    shares = rows.repartition(size, key).sortWithinPartitions(*order)
    try:
        return shares.mapInArrow(member, schema, barrier=size > 1).collect()
    finally:
        if folder:
            remove(rows.sparkSession, folder)
