"""Helpers shared by the operators of this folder."""

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window, functions as F

LOWER_ASCII = bytes.maketrans(bytes(range(65, 91)), bytes(range(97, 123)))


def folded_words(text: bytes) -> list:
    """Words between spaces and 0x09-0x0D, A-Z in lower case; other bytes stay as they are."""
    return text.translate(LOWER_ASCII).split()


def mixed(values: np.ndarray) -> np.ndarray:
    """Spread 64-bit numbers evenly (the finalizer of splitmix64)."""
    values = values.astype(np.uint64, copy=True)
    values ^= values >> np.uint64(30)
    values *= np.uint64(0xBF58476D1CE4E5B9)
    values ^= values >> np.uint64(27)
    values *= np.uint64(0x94D049BB133111EB)
    values ^= values >> np.uint64(31)
    return values


PIECE_BYTES = 8 << 20


def pieces(batch, most_bytes):
    """Slices of a batch whose texts have about ``most_bytes`` at most; a longer row is one by itself."""
    wide = [c for c in batch.columns if pa.types.is_binary(c.type) or pa.types.is_string(c.type)]
    if batch.num_rows < 2 or sum(c.nbytes for c in wide) <= most_bytes:
        yield batch
        return
    widths = sum(pc.fill_null(pc.binary_length(c), 0).to_numpy(zero_copy_only=False).astype(np.int64) for c in wide)
    ends = np.cumsum(widths)
    start = 0
    while start < batch.num_rows:
        before = ends[start - 1] if start else 0
        stop = max(start + 1, int(np.searchsorted(ends, before + most_bytes, "right")))
        yield batch.slice(start, stop - start)
        start = stop


def map_batches(df: DataFrame, function, schema, piece_bytes=PIECE_BYTES) -> DataFrame:
    """``mapInArrow`` for a function of one record batch that yields column dicts or batches.

    Batches are cut to pieces by the bytes of their texts, since Spark cuts them by rows alone.
    """
    arrow = to_arrow(schema)

    def run(batches):
        for batch in (piece for whole in batches for piece in pieces(whole, piece_bytes)):
            for out in function(batch):
                if isinstance(out, dict):
                    out = pa.RecordBatch.from_arrays(
                        [as_array(out[f.name], f.type) for f in arrow], schema=arrow)
                if out.num_rows:
                    yield out
        # The worker goes on to other tasks, or waits beside those of the JVM.
        pa.default_memory_pool().release_unused()

    return df.mapInArrow(run, schema)


def as_array(values, kind):
    return values if isinstance(values, pa.Array) else pa.array(values, kind)


def to_arrow(schema) -> pa.Schema:
    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import StructType

    return to_arrow_schema(schema if isinstance(schema, StructType) else StructType.fromDDL(schema))


def numbered(df: DataFrame, by, seed_columns, total: int, name: str, order=(), rows_per_bucket=65536) -> DataFrame:
    """Add ``name``: gapless 0-based numbers within ``by``, in no particular but repeatable order.

    Rows are dealt into hash buckets of ``seed_columns``. Totals of buckets give each bucket its
    first number, and only rows of one bucket are sorted together, so no group is one task's.
    Rows equal in ``seed_columns`` and ``order`` may swap numbers, nothing else may.
    """
    buckets = max(1, -(-total // rows_per_bucket))
    df = df.withColumn("_bucket", F.pmod(F.xxhash64(*seed_columns), F.lit(buckets)).cast("int"))
    earlier = Window.partitionBy(*by).orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)
    starts = df.groupBy(*by, "_bucket").agg(F.count(F.lit(1)).alias("_rows")).select(
        *by, "_bucket", F.coalesce(F.sum("_rows").over(earlier), F.lit(0)).alias("_start"))
    inside = Window.partitionBy(*by, "_bucket").orderBy(F.xxhash64(F.lit(1), *seed_columns), *seed_columns, *order)
    return (
        df.join(starts, [*by, "_bucket"])
        .withColumn(name, F.col("_start") + F.row_number().over(inside) - 1)
        .drop("_bucket", "_start")
    )
