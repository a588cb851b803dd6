"""Threshold, ranking and confusion metrics over score tables.

A score table has ``label`` (0/1), ``score`` (higher is more anomalous) and grouping columns.
"""

from pyspark.sql import Column, DataFrame, functions as F

from undertone.operators.ordering import between, exact_percentiles, percentile_ends, running_counts
from undertone.session import durable


def check_contamination(contamination: float):
    if not 0 < contamination <= 0.5:
        raise ValueError(f"a contamination of {contamination} is not above 0 and at most one half")


def check_scores(scored: DataFrame, labelled: bool = True):
    """One pass: refuse an empty table, non-finite scores and labels other than 0 and 1."""
    bad_score = F.col("score").isNull() | F.isnan("score") | (F.abs("score") == float("inf"))
    bad_label = ~F.coalesce(F.col("label").isin(0, 1), F.lit(False)) if labelled else F.lit(False)
    row = scored.agg(
        F.count(F.lit(1)).alias("n"), F.count_if(bad_score).alias("scores"),
        F.count_if(bad_label).alias("labels"),
    ).first()
    if not row["n"]:
        raise ValueError("labels and scores must be nonempty")
    if row["scores"]:
        raise ValueError("scores must be finite")
    if row["labels"]:
        raise ValueError("labels must be 0 or 1")


def score_threshold(training: DataFrame, by, contamination: float = 0.1, column="score") -> DataFrame:
    """The (1 - contamination) percentile of training scores per group, exactly."""
    check_contamination(contamination)
    return exact_percentiles(training, by, column, {"threshold": 1 - contamination})


def shifted_thresholds(training: DataFrame, by, moved: Column, contamination: float = 0.1) -> DataFrame:
    """(offset, threshold) per group: the training percentile, and that of the scores less the offset.

    The offset is 0 for groups that are not ``moved``. Less a constant, scores keep their order, so the scores
    next to the percentile stay next to it, and one search finds both numbers.
    """
    check_contamination(contamination)
    ends = percentile_ends(training, by, "score", {"t": 1 - contamination})
    low, high, step, offset = (F.col(c) for c in ("t_lo", "t_hi", "t_step", "offset"))
    return ends.withColumn("offset", F.when(moved, between(low, high, step)).otherwise(0.0)).select(
        *by, "offset", between(low - offset, high - offset, step).alias("threshold"))


def ranking_metrics(scored: DataFrame, by) -> DataFrame:
    """ROC area (ties count half) and step-sum average precision; null for one class."""
    label = F.col("label").cast("long")
    # Counting from the highest score down needs no group totals, hence no join.
    downward = scored.withColumn("_down", -F.col("score"))
    steps = running_counts(downward, by, "_down", {"pos": label, "neg": 1 - label})
    pos, neg = F.col("pos").cast("double"), F.col("neg").cast("double")
    hits = F.col("pos_before") + pos
    wins = F.sum(neg * (F.col("pos_before") + pos / 2))
    precision = hits / (hits + F.col("neg_before") + neg)
    all_pos, all_neg = F.sum(pos), F.sum(neg)
    both = (all_pos > 0) & (all_neg > 0)
    return steps.groupBy(*by).agg(
        F.when(both, F.try_divide(wins, all_pos * all_neg)).alias("roc_auc"),
        F.when(both, F.try_divide(F.sum(pos * precision), all_pos)).alias("avg_precision"),
    )


def share(numerator: Column, denominator: Column) -> Column:
    return F.coalesce(F.try_divide(numerator.cast("double"), denominator), F.lit(0.0))


def confusion(scored: DataFrame, by) -> DataFrame:
    """The four cells at ``threshold`` (a column): flagged when score >= threshold."""
    flagged, covert = F.col("score") >= F.col("threshold"), F.col("label") == 1
    return scored.groupBy(*by).agg(
        F.first("threshold").alias("threshold"),
        F.count_if(flagged & covert).alias("tp"), F.count_if(flagged & ~covert).alias("fp"),
        F.count_if(~flagged & ~covert).alias("tn"), F.count_if(~flagged & covert).alias("fn"),
    )


def with_rates(cells: DataFrame) -> DataFrame:
    """Precision, recall and F1 from the four cells; 0 where undefined."""
    tp, fp, fn = F.col("tp"), F.col("fp"), F.col("fn")
    return cells.withColumns({
        "precision": share(tp, tp + fp), "recall": share(tp, tp + fn),
        "f1": share(2 * tp, 2 * tp + fp + fn),
    })


def evaluate_scores(
    test: DataFrame, by, training: DataFrame | None = None, contamination: float = 0.1,
    threshold: float | None = None, thresholds: DataFrame | None = None,
) -> DataFrame:
    """All metrics of a scored test table.

    The threshold comes from training scores only, or from their percentiles found already
    (``thresholds``, by group), or is a fixed value declared in advance; never two of these.
    """
    if sum(x is not None for x in (threshold, training, thresholds)) != 1:
        raise ValueError("give either training scores or a fixed threshold without training_scores")
    if threshold is not None:
        if threshold != threshold or abs(threshold) == float("inf"):
            raise ValueError("a fixed threshold must be finite")
        placed = test.withColumn("threshold", F.lit(float(threshold)))
        source, prior = "fixed", F.lit(None).cast("double")
    else:
        known = score_threshold(training, by, contamination) if thresholds is None else thresholds
        placed = test.join(durable(known, "thresholds"), by)
        source, prior = "training_percentile", F.lit(float(contamination))
    cells = with_rates(confusion(placed, by))
    return cells.join(ranking_metrics(test, by), by).withColumns({
        "threshold_source": F.lit(source), "contamination": prior,
    })


def mask_rates(results: DataFrame) -> DataFrame:
    """False-positive rate only on legit holdouts, recall only on covert holdouts."""
    fp, tn, tp, fn = (F.col(c) for c in ("fp", "tn", "tp", "fn"))
    return results.withColumns({
        "fpr": F.when(F.col("fold_type") == "legit-holdout", F.try_divide(fp.cast("double"), fp + tn)),
        "recall": F.when(F.col("fold_type") == "covert-holdout", F.try_divide(tp.cast("double"), tp + fn)),
    })
