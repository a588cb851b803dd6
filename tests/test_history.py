"""The run history: concurrent appends, snapshots, lost writers."""

from concurrent.futures import ThreadPoolExecutor

import pytest

from undertone.schema import RESULT_SCHEMA
from undertone.sources import history


def run_rows(spark, stamp, folds=("a", "b"), rate=0.5):
    names = [f.name for f in RESULT_SCHEMA]
    rows = []
    for k, fold in enumerate(folds):
        known = {"protocol": "dns", "run_timestamp": stamp, "fold": fold, "model_name": "Autoencoder", "tp": k, "fpr": rate, "recall": rate,
                 "fold_type": ("legit-holdout", "covert-holdout")[k % 2]}
        rows.append(tuple(known.get(n) for n in names))
    return spark.createDataFrame(rows, RESULT_SCHEMA)


def test_concurrent_appends_are_all_kept(spark, tmp_path):
    path = str(tmp_path / "history")
    with ThreadPoolExecutor(6) as pool:
        versions = list(pool.map(lambda k: history.append_run(run_rows(spark, f"2026-01-0{k + 1}T00:00:00Z"), path), range(6)))
    assert sorted(versions) == [1, 2, 3, 4, 5, 6]
    assert history.read_history(spark, path).count() == 12
    stamps = {r[0] for r in history.read_history(spark, path).select("run_timestamp").distinct().collect()}
    assert len(stamps) == 6


def test_snapshots_do_not_move(spark, tmp_path):
    path = str(tmp_path)
    assert history.read_history(spark, path).count() == 0
    first = history.append_run(run_rows(spark, "2026-01-01T00:00:00Z"), path)
    then = history.read_history(spark, path)
    second = history.append_run(run_rows(spark, "2026-03-01T00:00:00+02:00", ("a", "b", "c"), 0.25), path)
    # Rows written without a commit, and a commit that never got its content, are no runs.
    run_rows(spark, "2027-01-01T00:00:00Z").write.parquet(f"{path}/runs/orphan")
    (tmp_path / "_commits" / f"{second + 1:012d}.json").write_text("")
    third = history.append_run(run_rows(spark, "2026-02-01T00:00:00Z"), path)
    assert (first, second, third) == (1, 2, 4)
    assert then.count() == history.read_history(spark, path, first).count() == 2
    assert history.read_history(spark, path, second).count() == 5 and history.read_history(spark, path).count() == 7
    with pytest.raises(ValueError, match="version 3"):
        history.read_history(spark, path, 3)


def test_the_newest_run_is_reported(spark, tmp_path):
    path = str(tmp_path)
    for stamp, rate in (("2026-01-01T00:00:00Z", 0.1), ("2026-03-01T00:00:00Z", 0.4), ("2026-02-01T00:00:00Z", 0.2)):
        history.append_run(run_rows(spark, stamp, rate=rate), path)
    report = history.history_report(spark, path, "dns")
    assert {r["run_timestamp"] for r in report["per_fold_results"].collect()} == {"2026-03-01T00:00:00Z"}
    assert report["fpr_summary"].first()["mean"] == report["recall_summary"].first()["mean"] == 0.4
    assert history.history_report(spark, path, "dns", 1)["fpr_summary"].first()["mean"] == 0.1
    with pytest.raises(ValueError, match="icmp"):
        history.history_report(spark, path, "icmp")
