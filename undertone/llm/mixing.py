"""Mixing sources to target weights.

Word totals per source give each source a target and a repetition rate. Every document is taken
floor(rate) times, and once more when its hash, read as a number in [0, 1), falls below the
fraction of the rate.
"""

from pyspark.sql import DataFrame, Window, functions as F

from undertone.session import durable

MOST_REPEATS = 3
WEIGHTS = (1, 2, 3)
WORD = r"[^\x20\x09-\x0D]+"


def source_targets(sizes: DataFrame) -> DataFrame:
    """Per source: source_size, target and rate. ``sizes`` has _source and _size.

    Sources are ordered by code point, null last, and weigh 1, 2, 3, 1, ... They share the sum of
    all sizes by weight; none gets more than three times its own size, and what that leaves over
    goes to the others by weight. With sources ordered by cap / weight, the capped ones come first,
    so one running sum finds the level (words per unit of weight) at which the shares add up.
    """
    # One row per source from here on.
    sources = sizes.groupBy("_source").agg(F.sum("_size").alias("source_size"))
    place = F.row_number().over(Window.orderBy(F.col("_source").asc_nulls_last())) - 1
    sources = sources.withColumn("_weight", F.element_at(F.array(*map(F.lit, WEIGHTS)), (place % len(WEIGHTS) + 1).cast("int")))
    sources = sources.withColumn("_cap", (MOST_REPEATS * F.col("source_size")).cast("double"))
    by_ratio = Window.orderBy(F.col("_cap") / F.col("_weight"), F.col("_source").asc_nulls_last())
    before = by_ratio.rowsBetween(Window.unboundedPreceding, -1)
    every = Window.orderBy(F.lit(0)).rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    words_left = F.sum("source_size").over(every) - F.coalesce(F.sum("_cap").over(before), F.lit(0.0))
    weight_left = F.sum("_weight").over(every) - F.coalesce(F.sum("_weight").over(before), F.lit(0))
    sources = sources.withColumn("_level", words_left / weight_left)
    # The level of the first source that stays under its cap holds for all after it.
    level = F.min(F.when(F.col("_cap") / F.col("_weight") >= F.col("_level"), F.struct(F.col("_cap") / F.col("_weight"), F.col("_level").alias("level")))).over(every)["level"]
    target = F.coalesce(F.least(F.col("_cap"), F.col("_weight") * level), F.col("_cap"))
    return sources.withColumn("target", target).select(
        "_source", "source_size", "target",
        F.when(F.col("source_size") > 0, F.least(F.col("target") / F.col("source_size"), F.lit(float(MOST_REPEATS))))
        .otherwise(0.0).alias("rate"))


def with_copies(docs: DataFrame, seed: str = "mix") -> DataFrame:
    """Rows of ``docs`` as structs under _row, so that no name clashes, plus _source, _size, _draw,
    source_size, target, rate and _copies; all rows, also those taken 0 times."""
    return add_copies(docs.select(
        F.struct("*").alias("_row"), F.col("source").alias("_source"),
        F.coalesce(F.regexp_count("text", F.lit(WORD)), F.lit(0)).cast("bigint").alias("_size"),
        # 53 bits of the hash as a number in [0, 1).
        (F.shiftrightunsigned(F.xxhash64(F.lit(seed), "doc_id", "text"), 11) / F.lit(float(1 << 53))).alias("_draw")))


def add_copies(sized: DataFrame) -> DataFrame:
    # Stored, so that the few rows per source join by their known size.
    targets = durable(source_targets(sized.select("_source", "_size")), "mix-targets")
    # A source may hold a third of all rows; null is a source of its own.
    joined = sized.join(targets.withColumnRenamed("_source", "_of"), F.col("_source").eqNullSafe(F.col("_of")))
    extra = (F.col("_draw") < F.col("rate") - F.floor("rate")).cast("int")
    return joined.withColumn("_copies", (F.floor("rate") + extra).cast("int")).drop("_of")


def mix_report(docs: DataFrame) -> DataFrame:
    """One row per document: doc_id, size, source_size, target, taken (words, repeats counted), copies.

    A null or empty text has size 0 and takes nothing; a source of such texts has target 0. A null
    source is a source. Repeated rows draw alike. An empty table gives an empty result.
    """
    sized = docs.select(
        "doc_id", F.col("source").alias("_source"),
        F.coalesce(F.regexp_count("text", F.lit(WORD)), F.lit(0)).cast("bigint").alias("_size"),
        (F.shiftrightunsigned(F.xxhash64(F.lit("mix"), "doc_id", "text"), 11) / F.lit(float(1 << 53))).alias("_draw"))
    # Narrow rows, written once: totals and decisions read them, not the texts again.
    return add_copies(durable(sized, "mix-sizes")).select(
        "doc_id", F.col("_size").alias("size"), "source_size", "target",
        (F.col("_size") * F.col("_copies")).alias("taken"), F.col("_copies").alias("copies"))


def mix_documents(docs: DataFrame) -> DataFrame:
    """The mix itself: rows of ``docs``, each as often as it is taken; the same columns as ``docs``."""
    copied = with_copies(docs)
    return copied.filter("_copies > 0").withColumn(
        "_copy", F.explode(F.sequence(F.lit(1), F.col("_copies")))).select("_row.*")
