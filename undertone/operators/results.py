"""Saved evaluation runs: newest run, summaries, pivot."""

from pyspark.sql import DataFrame, functions as F

MODEL_ORDER = ["Isolation Forest", "Autoencoder", "XGBoost (supervised reference)"]
RATES = {"legit-holdout": "fpr", "covert-holdout": "recall"}


def latest_run(results: DataFrame, protocol: str) -> DataFrame:
    """Rows of the newest run of a protocol; runs are never pooled. Times compare as UTC."""
    rows = results.filter(F.col("protocol") == protocol)
    if "run_timestamp" not in results.columns:
        return rows
    newest = rows.agg(F.max_by("run_timestamp", F.to_timestamp("run_timestamp"))).scalar()
    return rows.filter(F.col("run_timestamp") == newest)


def require_rows(rows: DataFrame, protocol: str) -> DataFrame:
    if rows.isEmpty():
        raise ValueError(f"No saved results for {protocol}; run the evaluation first.")
    return rows


def rate_summary(results: DataFrame, fold_type: str) -> DataFrame:
    """Mean, sample deviation and session count per model of the rate that fold type measures."""
    rate = F.col(RATES[fold_type])
    return results.filter(F.col("fold_type") == fold_type).groupBy("model_name").agg(
        F.avg(rate).alias("mean"), F.stddev_samp(rate).alias("std"), F.count(rate).alias("count")
    )


def evaluation_report(results: DataFrame, protocol: str) -> dict[str, DataFrame]:
    rows = require_rows(latest_run(results, protocol), protocol)
    return {
        "per_fold_results": rows,
        **{f"{rate}_summary": rate_summary(rows, kind) for kind, rate in RATES.items()},
    }


def summary_pivot(results: DataFrame) -> DataFrame:
    """One row per model: mean and session count of both rates, in the fixed model order."""
    fpr = rate_summary(results, "legit-holdout").withColumn("metric", F.lit("FPR"))
    recall = rate_summary(results, "covert-holdout").withColumn("metric", F.lit("Recall"))
    wide = fpr.unionByName(recall).groupBy("model_name").pivot("metric", ["FPR", "Recall"]).agg(
        F.max("mean").alias("mean"), F.max("count").alias("count")
    )
    place = F.array_position(F.array(*[F.lit(m) for m in MODEL_ORDER]), F.col("model_name"))
    return (
        wide.filter(F.col("model_name").isin(*MODEL_ORDER))
        .orderBy(place)
        .select(
            "model_name", F.col("FPR_mean").alias("mean_fpr"), F.col("Recall_mean").alias("mean_recall"),
            F.coalesce("FPR_count", F.lit(0)).alias("count_fpr"),
            F.coalesce("Recall_count", F.lit(0)).alias("count_recall"),
        )
    )
