"""Ranks, running totals and exact percentiles that never sort a whole group in one task.

A plain window over a group puts the group into one task. Here every group is cut into ordered
buckets first. Bucket totals are small, so their running totals are cheap; only rows of one
(group, bucket) are ever sorted together. The answers are exact whatever the buckets are.
"""

from pyspark.sql import DataFrame, Window, functions as F

from undertone.session import durable

# A bucket of more rows than this is split by the next digit of its values, unless it is one value.
BUCKET_ROWS = 1 << 16
DIGIT = 16
# The bits of IEEE 754 doubles.
MANTISSA, LEAST_EXPONENT, INFINITE, NOT_A_NUMBER = 52, -1022, 0x7FF << 52, 0x7FF8 << 48


def bucket_offsets(totals: DataFrame, by, bucket: str, columns) -> DataFrame:
    """Replace each column of per-bucket totals by the sum over the buckets before it."""
    before = (
        Window.partitionBy(*by).orderBy(bucket).rowsBetween(Window.unboundedPreceding, -1)
    )
    return totals.select(
        *by, bucket,
        *[F.coalesce(F.sum(c).over(before), F.lit(0)).alias(f"{c}_before") for c in columns],
    )


def positions(df: DataFrame, by, bucket: str, order, name="position") -> DataFrame:
    """0-based position of each row within ``by``, ordered by ``bucket`` and then ``order``."""
    # Names may begin alike, and Spark sorts quickly by the first 8 bytes: a hash leads the sort.
    within = Window.partitionBy("_lead", *by, bucket)
    ranked = df.withColumn("_lead", F.xxhash64(*by, bucket)).withColumns({
        "_inside": F.row_number().over(within.orderBy(*order)) - 1,
        "rows": F.count(F.lit(1)).over(within),
    }).drop("_lead")
    # One row per bucket, from the rows already shuffled by bucket.
    totals = ranked.filter("_inside = 0").select(*by, bucket, "rows")
    offsets = bucket_offsets(totals, by, bucket, ["rows"])
    return (
        ranked.join(offsets, [*by, bucket])
        .withColumn(name, F.col("_inside") + F.col("rows_before"))
        .drop("_inside", "rows", "rows_before")
    )


def ordered_key(value):
    """A whole number of 64 bits per double that orders as the doubles do: the bits, negated below zero.

    Both zeros are 0, NaN comes after infinity, and null stays null.
    """
    size = F.abs(value)
    power = F.floor(F.log2(size))
    # The logarithm is rounded: put the exponent right by comparing with exact powers of two.
    near = F.pow(F.lit(2.0), power)
    power = power + F.when(size >= 2 * near, 1).when(size < near, -1).otherwise(0)
    power = F.greatest(power, F.lit(LEAST_EXPONENT)).cast("bigint")
    bits = (power - LEAST_EXPONENT) * F.lit(1 << MANTISSA) + F.floor(
        size / F.pow(F.lit(2.0), power) * F.lit(float(1 << MANTISSA))).cast("bigint")
    bits = F.when(size == 0, F.lit(0)).when(size == float("inf"), F.lit(INFINITE)).otherwise(bits)
    return F.when(F.isnan(value), F.lit(NOT_A_NUMBER)).when(value < 0, -bits).otherwise(bits)


def radix_buckets(df: DataFrame, by, column: str, sums: dict) -> tuple[DataFrame, DataFrame]:
    """``df`` with ``_bucket``, which never falls as ``column`` rises, and the totals of the buckets.

    ``sums`` maps a name to a column to add up; totals also hold ``rows``. Rows are counted per group by
    the leading digit of their key; groups of rows above BUCKET_ROWS are counted by the next digit, until
    every bucket is small or a single value. Buckets are named by the least key they may hold, so
    those of different depths order together.
    """
    df = df.withColumn("_key", ordered_key(F.col(column).cast("double")))

    def start(shift):
        return F.shiftleft(F.shiftright("_key", shift), shift)

    def counted(rows):
        return durable(rows.groupBy(*by, "_bucket").agg(
            F.count(F.lit(1)).alias("rows"), *[F.sum(value).alias(name) for name, value in sums.items()]), "digits")

    shift = 64 - DIGIT
    df = df.withColumn("_bucket", start(shift))
    found = counted(df)
    totals = found
    while shift:
        full = found.filter(F.col("rows") > BUCKET_ROWS)
        if full.isEmpty():
            break
        shift -= DIGIT
        # Few rows, whose known small size lets Spark broadcast them.
        named = durable(full.select(*[F.col(c).alias(f"_of_{c}") for c in (*by, "_bucket")]), "full-buckets")
        same = [F.col(c).eqNullSafe(F.col(f"_of_{c}")) for c in (*by, "_bucket")]
        df = df.join(named, same, "left").withColumn(
            "_bucket", F.when(F.col("_of__bucket").isNull(), F.col("_bucket")).otherwise(start(shift))).withColumn(
            "_split", F.col("_of__bucket").isNotNull())
        found = counted(df.filter("_split"))
        totals = totals.join(named, same, "left_anti").unionByName(found)
        df = df.drop("_split", *[f"_of_{c}" for c in (*by, "_bucket")])
    return df.drop("_key"), totals


def running_counts(df: DataFrame, by, column: str, sums: dict) -> DataFrame:
    """One row per distinct value of ``column`` within ``by``: its sums and the sums before it.

    ``sums`` maps a name to a column to add up. Equal values collapse before any sort.
    """
    bucketed, totals = radix_buckets(df, by, column, sums)
    cells = bucketed.groupBy(*by, "_bucket", column).agg(
        *[F.sum(value).alias(name) for name, value in sums.items()]
    )
    offsets = bucket_offsets(totals, by, "_bucket", list(sums))
    before = (
        Window.partitionBy(*by, "_bucket").orderBy(column)
        .rowsBetween(Window.unboundedPreceding, -1)
    )
    inner = cells.select(
        "*", *[F.coalesce(F.sum(n).over(before), F.lit(0)).alias(f"_{n}_in") for n in sums]
    )
    joined = inner.join(offsets, [*by, "_bucket"])
    return joined.select(
        *by, column, *sums,
        *[(F.col(f"_{n}_in") + F.col(f"{n}_before")).alias(f"{n}_before") for n in sums],
    )


def exact_percentiles(df: DataFrame, by, column: str, shares: dict) -> DataFrame:
    """Linear-interpolated percentiles of the non-null values of ``column``, per group.

    ``by`` names at least one column. ``shares`` maps an output column to a share in [0, 1].
    """
    ends = percentile_ends(df, by, column, shares)
    return ends.select(*by, *[
        between(F.col(f"{n}_lo"), F.col(f"{n}_hi"), F.col(f"{n}_step")).alias(n) for n in shares])


def between(low, high, step):
    """The value ``step`` of the way from ``low`` to ``high``."""
    return F.when(step < 0.5, low + (high - low) * step).otherwise(high - (high - low) * (1 - step))


def percentile_ends(df: DataFrame, by, column: str, shares: dict) -> DataFrame:
    """Per share the two values its percentile lies between and how far from the first: _lo, _hi and _step.

    Bucket counts locate the buckets that hold the wanted ranks; only rows of those buckets are
    shuffled and sorted.
    """
    df = df.select(*by, F.col(column).cast("double").alias("_v")).filter("_v is not null")
    bucketed, totals = radix_buckets(df, by, "_v", {})
    placed = (
        bucket_offsets(totals, by, "_bucket", ["rows"])
        .join(totals, [*by, "_bucket"])
        .withColumn("_n", F.sum("rows").over(Window.partitionBy(*by)))
    )
    rank = {name: (F.col("_n") - 1) * F.lit(float(share)) for name, share in shares.items()}
    edges = [f(r) for r in rank.values() for f in (F.floor, F.ceil)]
    holds = F.lit(False)
    for edge in edges:
        holds = holds | (
            (edge >= F.col("rows_before")) & (edge < F.col("rows_before") + F.col("rows"))
        )
    # A few rows per group. Stored, so that their known size lets Spark broadcast them.
    wanted = durable(placed.filter(holds).select(*by, "_bucket", "_n", "rows_before"), "ranks")
    near = (
        bucketed.join(wanted, [*by, "_bucket"])
        .groupBy(*by, "_bucket", "_v")
        .agg(F.count(F.lit(1)).alias("_c"), F.first("_n").alias("_n"),
             F.first("rows_before").alias("_start"))
    )
    inside = (
        Window.partitionBy(*by, "_bucket").orderBy("_v")
        .rowsBetween(Window.unboundedPreceding, -1)
    )
    near = near.withColumn(
        "_start", F.col("_start") + F.coalesce(F.sum("_c").over(inside), F.lit(0))
    )

    def at(edge):
        here = (edge >= F.col("_start")) & (edge < F.col("_start") + F.col("_c"))
        return F.max(F.when(here, F.col("_v")))

    ends = near.groupBy(*by).agg(
        F.first("_n").alias("_n"),
        *[at(F.floor(r)).alias(f"{name}_lo") for name, r in rank.items()],
        *[at(F.ceil(r)).alias(f"{name}_hi") for name, r in rank.items()],
    )

    steps = [(r - F.floor(r)).alias(f"{name}_step") for name, r in rank.items()]
    return ends.select(*by, *[f"{name}_{end}" for name in shares for end in ("lo", "hi")], *steps)
