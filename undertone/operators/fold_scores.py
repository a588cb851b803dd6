"""Scores of every fold's models, without a table of rows times folds.

A row is a test row of one fold and a training row of all others. Test scores are kept; of training
scores a percentile is all that is wanted. One pass over the rows counts each fold's training scores by
the leading digits of their order-preserving keys. The counts tell which digits hold the wanted ranks, and
a second pass scores again and lets only scores with these digits out, about one in a hundred. The
percentile is exact.
"""

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F, types as T
from pyspark.sql.pandas.types import to_arrow_schema

from undertone.operators.ordering import bucket_offsets, running_counts
from undertone.operators.prepare import feature_names
from undertone.session import durable

# Bits of a key that do not count as leading: 8 bits of the mantissa do.
REST, SCORE_ROWS = 44, 4096
FOUND = T.StructType([
    T.StructField("fold", T.IntegerType()),
    T.StructField("model_name", T.StringType()),
    T.StructField("label", T.IntegerType()),
    T.StructField("score", T.DoubleType()),
    T.StructField("digit", T.LongType()),
    T.StructField("rows", T.LongType()),
])
BY = ["fold", "model_name"]


def leading_digits(scores: np.ndarray, rest: int) -> np.ndarray:
    """The keys of ``ordering.ordered_key``, without their last ``rest`` bits."""
    bits = np.abs(scores).view(np.int64)
    return np.where(scores < 0, -bits, bits) >> rest


def scored_slices(batches, scorer, width):
    """(sessions, labels, {model: (folds, rows) scores}) of a few thousand rows at a time."""
    for batch in batches:
        for start in range(0, batch.num_rows, SCORE_ROWS):
            part = batch.slice(start, SCORE_ROWS)
            x = part.column(2).flatten().to_numpy().reshape(part.num_rows, width)
            scores = scorer(x)
            if not all(np.isfinite(s).all() for s in scores.values()):
                raise ValueError("a model gave a score that is not finite")
            yield part.column(0).to_numpy(), part.column(1).to_numpy(), scores


def output(**columns):
    schema = to_arrow_schema(FOUND)
    size = max(len(c) for c in columns.values())
    return pa.RecordBatch.from_arrays(
        [pa.array(columns[f.name], f.type) if f.name in columns else pa.nulls(size, f.type) for f in schema], schema=schema)


def first_pass(scorer, width, folds):
    """Test scores, and counts of each fold's training scores by digit."""
    def run(batches):
        counts: dict = {}
        for session, label, scores in scored_slices(batches, scorer, width):
            tested = np.flatnonzero(session >= 0)
            for model, values in scores.items():
                if len(tested):
                    yield output(fold=session[tested], model_name=[model] * len(tested), label=label[tested],
                                 score=values[session[tested], tested])
                digits = leading_digits(values, REST)
                for fold in range(folds):
                    for digit, n in zip(*np.unique(digits[fold][session != fold], return_counts=True)):
                        counts[fold, model, int(digit)] = counts.get((fold, model, int(digit)), 0) + int(n)
        if counts:
            keys = list(zip(*counts))
            yield output(fold=keys[0], model_name=keys[1], digit=keys[2], rows=list(counts.values()))

    return run


def second_pass(scorer, width, wanted):
    """Training scores whose digit holds a wanted rank: ``wanted`` is {(fold, model): digits}."""
    def run(batches):
        for session, _, scores in scored_slices(batches, scorer, width):
            for (fold, model), digits in wanted.items():
                here = leading_digits(scores[model][fold], REST)
                rows = np.flatnonzero(np.isin(here, digits) & (session != fold))
                if len(rows):
                    yield output(fold=[fold] * len(rows), model_name=[model] * len(rows),
                                 score=scores[model][fold][rows], digit=here[rows], rows=np.ones(len(rows), np.int64))

    return run


def score_folds(matrix: DataFrame, folds: list, scorer, share: float) -> tuple[DataFrame, DataFrame]:
    """(test scores, thresholds) of every fold's models.

    ``scorer`` maps rows of features to {model: (folds, rows) scores}; it goes to the tasks, so it holds the
    models of a bounded number of folds. Test scores are (fold, model_name, label, score), one per row of a
    fold and model; thresholds are (fold, model_name, threshold), the ``share`` percentile of training scores.
    """
    names = feature_names(matrix.columns)
    rows = matrix.select(
        (F.array_position(F.array(*map(F.lit, folds)), F.col("source_file")) - 1).cast("int").alias("session"),
        F.col("label").cast("int").alias("label"), F.array(*names).cast("array<double>").alias("x"))
    found = durable(rows.mapInArrow(first_pass(scorer, len(names), len(folds)), FOUND), "fold-scores")
    totals = durable(found.filter("digit is not null").groupBy(*BY, "digit").agg(F.sum("rows").alias("rows")), "digit-counts")
    sizes = {tuple(r[c] for c in BY): r["n"] for r in totals.groupBy(*BY).agg(F.sum("rows").alias("n")).collect()}
    ranks = {key: (n - 1) * share for key, n in sizes.items()}
    wished = matrix.sparkSession.createDataFrame(
        [(*key, math.floor(r), math.ceil(r)) for key, r in ranks.items()], "fold int, model_name string, low bigint, high bigint")
    placed = bucket_offsets(totals, BY, "digit", ["rows"]).join(totals, [*BY, "digit"]).join(wished, BY)

    def holds(rank):
        return (F.col(rank) >= F.col("rows_before")) & (F.col(rank) < F.col("rows_before") + F.col("rows"))

    # Two digits per fold and model at most.
    chosen = placed.filter(holds("low") | holds("high")).collect()
    wanted, before = {}, {}
    for r in chosen:
        wanted.setdefault((r["fold"], r["model_name"]), []).append(r["digit"])
        before[r["fold"], r["model_name"], r["digit"]] = r["rows_before"]
    near = durable(rows.mapInArrow(second_pass(scorer, len(names), wanted), FOUND).groupBy(*BY, "digit", "score").agg(
        F.sum("rows").alias("n")), "near-scores")
    inside = running_counts(near, [*BY, "digit"], "score", {"n": F.col("n")})
    starts = matrix.sparkSession.createDataFrame(
        [(*key, b) for key, b in before.items()], "fold int, model_name string, digit bigint, start bigint")
    inside = inside.join(starts, [*BY, "digit"]).join(wished, BY).withColumn(
        "first", F.col("start") + F.col("n_before"))

    def at(rank):
        return F.max(F.when((F.col(rank) >= F.col("first")) & (F.col(rank) < F.col("first") + F.col("n")), F.col("score"))).alias(rank)

    ends = {tuple(r[c] for c in BY): (r["low"], r["high"]) for r in inside.groupBy(*BY).agg(at("low"), at("high")).collect()}
    limits = []
    for (fold, model), (low, high) in ends.items():
        step = ranks[fold, model] % 1
        limits.append((folds[fold], model, low + (high - low) * step if step < 0.5 else high - (high - low) * (1 - step)))
    named = F.element_at(F.array(*map(F.lit, folds)), F.col("fold") + 1)
    tests = found.filter("digit is null").select(named.alias("fold"), "model_name", "label", "score")
    return tests, matrix.sparkSession.createDataFrame(limits, "fold string, model_name string, threshold double")
