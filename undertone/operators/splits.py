"""Leave-one-session-out folds and the stratified random split."""

import math

from pyspark.sql import DataFrame, Window, functions as F

from undertone.operators.ordering import bucket_offsets
from undertone.operators.prepare import feature_names, long_form, scale_of
from undertone.session import durable


def list_folds(matrix: DataFrame) -> list[str]:
    """Distinct sessions, ascending; each is one fold.

    One name a session reaches the driver, however many rows a session has.
    """
    rows = matrix.select("source_file").distinct().collect()
    if len(rows) < 2:
        raise ValueError("leave-one-session-out needs at least two distinct capture sessions")
    return sorted(r["source_file"] for r in rows)


def fold_census(matrix: DataFrame) -> DataFrame:
    """Per fold: class counts on both sides, fold type, and whether training lacks legit rows."""
    sessions = matrix.groupBy(F.col("source_file").alias("fold")).agg(
        F.count_if(F.col("label") == 0).alias("test_legit"),
        F.count_if(F.col("label") == 1).alias("test_covert"),
    )
    all_legit = sessions.agg(F.sum("test_legit")).scalar()
    all_covert = sessions.agg(F.sum("test_covert")).scalar()
    return sessions.select(
        "fold",
        F.when(F.col("test_covert") == 0, "legit-holdout")
        .when(F.col("test_legit") == 0, "covert-holdout")
        .otherwise("mixed-holdout").alias("fold_type"),
        (all_legit - F.col("test_legit") == 0).alias("training_had_no_legit_examples"),
        (all_legit - F.col("test_legit")).alias("train_legit"),
        (all_covert - F.col("test_covert")).alias("train_covert"),
        "test_legit", "test_covert",
    )


def fold_scalers(matrix: DataFrame) -> DataFrame:
    """(fold, feature, mean, scale) fitted on the rows outside each fold, in one data pass.

    Sessions are reduced to moments first. The rest of the data is then everything before plus
    everything after a session: two running sums, one from either end, so the work is linear in
    the sessions. Means are measured from the overall mean to keep digits. Minimum and maximum tell constant columns
    exactly, where subtraction would leave rounding noise.
    """
    names = feature_names(matrix.columns)
    sessions = matrix.groupBy("source_file").agg(*[
        F.struct(
            F.count(n).cast("double").alias("n"), F.avg(n).alias("mean"),
            F.var_pop(n).alias("var"), F.min(n).alias("low"), F.max(n).alias("high"),
        ).alias(n) for n in names
    ])
    rows = long_form(sessions, ["source_file"], names).select(
        F.col("source_file").alias("fold"), "feature", "value.*"
    )
    whole = Window.partitionBy("feature")
    before = whole.orderBy("fold").rowsBetween(Window.unboundedPreceding, -1)
    # A frame that runs to the end is summed anew for every row; one that starts there is not.
    after = whole.orderBy(F.desc("fold")).rowsBetween(Window.unboundedPreceding, -1)
    center = F.sum(F.col("n") * F.col("mean")).over(whole) / F.sum("n").over(whole)
    rows = rows.withColumn("center", center).withColumn("shift", F.col("mean") - F.col("center"))

    def rest(value):
        zero = F.lit(0.0)
        return F.coalesce(F.sum(value).over(before), zero) + F.coalesce(F.sum(value).over(after), zero)

    n, shift = F.col("n"), F.col("shift")
    rows = rows.select(
        "fold", "feature", "center",
        rest(n).alias("n"), rest(n * shift).alias("s1"),
        rest(n * F.col("var")).alias("within"), rest(n * shift * shift).alias("s2"),
        F.least(F.min("low").over(before), F.min("low").over(after)).alias("low"),
        F.greatest(F.max("high").over(before), F.max("high").over(after)).alias("high"),
    ).filter("n > 0")
    mean_shift = F.col("s1") / F.col("n")
    variance = F.greatest(
        (F.col("within") + F.col("s2") - F.col("s1") * mean_shift) / F.col("n"), F.lit(0.0)
    )
    constant = F.col("low") == F.col("high")
    mean = F.when(constant, F.col("low")).otherwise(F.col("center") + mean_shift)
    return rows.select(
        "fold", "feature", mean.alias("mean"),
        F.when(constant, F.lit(1.0)).otherwise(scale_of(F.col("n"), mean, variance)).alias("scale"),
    )


def loso_rows(matrix: DataFrame, folds: list[str]) -> DataFrame:
    """Every row once per fold, marked train or test. Rows x folds: evaluation needs them all."""
    fold = F.explode(F.array(*[F.lit(f) for f in folds]))
    return matrix.withColumn("fold", fold).withColumn(
        "part", F.when(F.col("source_file") == F.col("fold"), "test").otherwise("train")
    )


def stratified_split(matrix: DataFrame, test_share: float = 0.3, seed: int = 42) -> DataFrame:
    """Add ``part``: an exact share of each class goes to test, chosen by a seeded row hash.

    Test rows are those of the lowest hashes. Counts of hash buckets settle all but one bucket of a class,
    so only the rows of that bucket are ranked; no other row is shuffled.
    """
    hashed = matrix.withColumn("_hash", F.xxhash64("source_file", "flow_id", F.lit(seed))).withColumn(
        "_bucket", F.shiftright("_hash", 52)
    )
    totals = durable(hashed.groupBy("label", "_bucket").agg(F.count(F.lit(1)).alias("rows")), "split-buckets")
    sizes = {r["label"]: r["n"] for r in totals.groupBy("label").agg(F.sum("rows").alias("n")).collect()}
    if set(sizes) - {0, 1}:
        raise ValueError("labels must be 0 or 1")
    quota = test_quota(sizes, test_share)
    limit = F.lit(0)
    for label, count in quota.items():
        limit = F.when(F.col("label") == label, F.lit(count)).otherwise(limit)
    left = limit - F.col("rows_before")
    # The bucket of a class's last test row, if it has one: a row per class.
    edges = bucket_offsets(totals, ["label"], "_bucket", ["rows"]).join(totals, ["label", "_bucket"]).filter(
        (left > 0) & (left <= F.col("rows"))
    ).select("label", "_bucket", left.alias("left")).collect()
    below, inside, quota_inside = F.lit(False), F.lit(False), F.lit(0)
    for edge in edges:
        mine = F.col("label") == edge["label"]
        below = below | (mine & (F.col("_bucket") < edge["_bucket"]))
        inside = inside | (mine & (F.col("_bucket") == edge["_bucket"]))
        quota_inside = F.when(mine, F.lit(edge["left"])).otherwise(quota_inside)
    settled = hashed.filter(~inside).withColumn("part", F.when(below, "test").otherwise("train"))
    in_order = Window.partitionBy("label").orderBy("_hash", "source_file", "flow_id")
    ranked = hashed.filter(inside).withColumn("_rank", F.row_number().over(in_order)).withColumn(
        "part", F.when(F.col("_rank") <= quota_inside, "test").otherwise("train")
    )
    columns = [*matrix.columns, "part"]
    return settled.select(*columns).unionByName(ranked.select(*columns))


def test_quota(sizes: dict, share: float) -> dict:
    """Test rows per class: proportional, rounded so that the total is ceil(share x rows)."""
    total = sum(sizes.values())
    wanted = math.ceil(share * total)
    exact = {label: n * wanted / total for label, n in sizes.items()}
    quota = {label: math.floor(x) for label, x in exact.items()}
    for label in sorted(exact, key=lambda k: (quota[k] - exact[k], k))[: wanted - sum(quota.values())]:
        quota[label] += 1
    return quota
