import math
import random
import statistics

import numpy as np
import pytest
from pyspark.sql import functions as F

from undertone.operators import diagnose, metrics, prepare, results, splits
from undertone.operators.ordering import exact_percentiles, positions, running_counts
from undertone.plans.loso import loso_with_column_scorer
from undertone.schema import DATASET_SCHEMA, RESULT_SCHEMA
from undertone.sources.tables import append_results, read_features, read_results, to_json_records, write_features

BASE = dict(packet_count=2, duration_seconds=1.0, size_mean=70.0, size_std=1.0, size_cv=0.1, interarrival_mean=1.0,
            interarrival_std=0.0, interarrival_cv=0.0, is_single_packet_flow=False, entropy_mean=3.0, entropy_max=4.0,
            compression_ratio_mean=0.9, compression_ratio_max=1.0)


def table(spark, rows):
    full = [{"flow_id": str(i), **BASE, **row} for i, row in enumerate(rows)]
    return spark.createDataFrame([tuple(r.get(f.name) for f in DATASET_SCHEMA) for r in full], DATASET_SCHEMA)


def dns_row(source="d1.pcap", label=0, **more):
    return {"protocol": "dns", "source_file": source, "label": label, "mean_query_length": 10.0,
            "txt_null_ratio": 0.0, "max_query_length": 12.0, **more}


def icmp_row(source="i1.pcap", label=0, **more):
    return {"protocol": "ICMP", "source_file": source, "label": label, "icmp_size_cv": 0.5, **more}


def test_matrix_columns_and_imputation(spark):
    single = dict(is_single_packet_flow=True, interarrival_mean=None, interarrival_std=None, interarrival_cv=None)
    features = table(spark, [dns_row(**single), icmp_row()])
    sizes = {p: len(prepare.feature_names(prepare.model_matrix(features, p).columns)) for p in ("dns", "icmp")}
    combined = prepare.model_matrix(features)
    assert sizes == {"dns": 15, "icmp": 14} and len(prepare.feature_names(combined.columns)) == 16
    assert "max_query_length" not in combined.columns
    assert prepare.check_matrix(combined) == 2
    row = combined.filter("source_file = 'd1.pcap'").first()
    assert row["interarrival_cv"] == 0 and row["icmp_size_cv"] == 0 and row["is_single_packet_flow"] == 1


def test_matrix_refusals(spark):
    with pytest.raises(ValueError, match="missing columns"):
        prepare.model_matrix(spark.createDataFrame([(1,)], "label int"))
    good = table(spark, [dns_row()])
    with pytest.raises(ValueError, match="protocol must be"):
        prepare.model_matrix(good, "tcp")
    with pytest.raises(ValueError, match="No rows"):
        prepare.check_matrix(prepare.model_matrix(good, "icmp"), "icmp")
    with pytest.raises(ValueError, match="source_file"):
        prepare.check_matrix(prepare.model_matrix(table(spark, [dns_row("  ")]), "dns"))
    with pytest.raises(ValueError, match="interarrival_cv"):
        prepare.check_matrix(prepare.model_matrix(table(spark, [dns_row(interarrival_cv=None)]), "dns"))
    text = good.withColumn("size_mean", F.lit("many"))
    with pytest.raises(Exception, match="CAST_INVALID_INPUT"):
        prepare.model_matrix(text, "dns").collect()
    halved = good.withColumn("label", F.lit(0.7))
    with pytest.raises(Exception, match="whole number"):
        prepare.model_matrix(halved, "dns").collect()


def test_rows_without_a_flow_id_stay_apart(spark):
    features = table(spark, [dns_row(size_mean=float(i)) for i in range(5)]).drop("flow_id")
    assert prepare.model_matrix(features, "dns").select("flow_id").distinct().count() == 5


def test_flag_spellings(spark):
    flags = spark.createDataFrame([("True",), ("true",), ("1",), ("False",), ("0",), (None,)], "is_single_packet_flow string")
    rows = flags.select(F.lit("dns").alias("protocol"), F.lit(0).alias("label"), F.lit("s").alias("source_file"),
                        "is_single_packet_flow", F.lit(None).cast("double").alias("interarrival_mean"))
    out = prepare.model_matrix(rows, "dns").select("is_single_packet_flow", "interarrival_mean").collect()
    assert [r[0] for r in out] == [1, 1, 1, 0, 0, None] and [r[1] for r in out] == [0, 0, 0, None, None, None]


def test_scaler_leaves_constant_columns_shiftable(spark):
    matrix = prepare.model_matrix(table(spark, [dns_row(size_mean=x, size_std=0.1) for x in (1.0, 2.0, 6.0)]), "dns")
    fitted = prepare.scaler_map(prepare.fit_scaler(matrix))
    assert fitted["size_mean"] == (3.0, pytest.approx(statistics.pstdev([1, 2, 6])))
    assert fitted["size_std"][1] == 1.0
    ready = prepare.apply_scaler(matrix, fitted)
    assert ready.agg(F.avg("size_mean")).first()[0] == pytest.approx(0, abs=1e-12)
    unseen = matrix.withColumn("size_std", F.lit(7.1))
    assert prepare.apply_scaler(unseen, fitted).first()["size_std"] == pytest.approx(7.0)


def test_fold_scalers_match_a_refit_on_the_other_sessions(spark):
    rng = random.Random(3)
    rows = [dns_row(f"s{i % 5}.pcap", size_mean=1e6 + rng.random(), size_std=5.0 if i % 5 else rng.random(),
                    entropy_mean=rng.gauss(0, 1)) for i in range(200)]
    matrix = prepare.model_matrix(table(spark, rows), "dns")
    found = {(r["fold"], r["feature"]): (r["mean"], r["scale"]) for r in splits.fold_scalers(matrix).collect()}
    assert len(found) == 5 * 15
    for fold in {r["source_file"] for r in rows}:
        for name in ("size_mean", "size_std", "entropy_mean", "packet_count"):
            rest = np.array([float({**BASE, **r}[name]) for r in rows if r["source_file"] != fold])
            scale = rest.std() if rest.min() != rest.max() else 1.0
            assert found[fold, name] == (pytest.approx(rest.mean(), rel=1e-12), pytest.approx(scale, rel=1e-6))


def test_census_and_fold_types(spark):
    rows = [dns_row("a"), dns_row("b", 1), dns_row("c"), dns_row("c", 1)]
    census = {r["fold"]: r for r in splits.fold_census(prepare.model_matrix(table(spark, rows), "dns")).collect()}
    assert [census[f]["fold_type"] for f in "abc"] == ["legit-holdout", "covert-holdout", "mixed-holdout"]
    assert (census["a"]["train_legit"], census["a"]["train_covert"]) == (1, 2)
    with pytest.raises(ValueError, match="two distinct"):
        splits.list_folds(table(spark, [dns_row("a")]))


def test_stratified_split_is_exact_and_repeatable(spark):
    matrix = prepare.model_matrix(table(spark, [dns_row(label=int(i < 13)) for i in range(40)]), "dns")
    split = splits.stratified_split(matrix)
    counts = {(r["label"], r["part"]): r["count"] for r in split.groupBy("label", "part").count().collect()}
    assert counts == {(1, "test"): 4, (1, "train"): 9, (0, "test"): 8, (0, "train"): 19}
    parts = lambda df: sorted((r["flow_id"], r["part"]) for r in df.collect())
    assert parts(split) == parts(splits.stratified_split(matrix.repartition(7)))
    assert splits.test_quota({0: 5, 1: 5}, 0.3) == {0: 2, 1: 1}


def scored(spark, labels, scores, group="g"):
    return spark.createDataFrame([(group, int(y), float(s)) for y, s in zip(labels, scores)], "g string, label int, score double")


def test_reference_score_vectors(spark):
    perfect = metrics.evaluate_scores(scored(spark, [0, 0, 1, 1], [.1, .2, .8, .9]), ["g"],
                                      scored(spark, [0] * 4, [.1, .2, .3, .4])).first()
    assert (perfect["roc_auc"], perfect["avg_precision"], perfect["f1"]) == (1, 1, 1)
    assert (perfect["tp"], perfect["tn"], perfect["fp"], perfect["fn"]) == (2, 2, 0, 0)
    half = metrics.ranking_metrics(scored(spark, [0, 0, 1, 1], [.1, .4, .2, .3]), ["g"]).first()
    assert half["roc_auc"] == pytest.approx(0.5)
    train = scored(spark, [0] * 4, [0, .1, .2, .3])
    assert metrics.score_threshold(train, ["g"]).first()["threshold"] == pytest.approx(0.27)
    fixed = metrics.evaluate_scores(scored(spark, [0, 1], [.2, .7]), ["g"], threshold=0.5).first()
    assert (fixed["tp"], fixed["tn"], fixed["threshold_source"], fixed["contamination"]) == (1, 1, "fixed", None)
    one_class = metrics.evaluate_scores(scored(spark, [1, 1], [.1, .9]), ["g"], train).first()
    assert one_class["roc_auc"] is None and one_class["avg_precision"] is None and one_class["tp"] + one_class["fn"] == 2
    with pytest.raises(ValueError, match="without training_scores"):
        metrics.evaluate_scores(train, ["g"], train, threshold=0.5)


@pytest.mark.parametrize("bad", [0.0, 0.6, float("nan")])
def test_bad_contamination(spark, bad):
    with pytest.raises(ValueError, match="contamination"):
        metrics.score_threshold(scored(spark, [0], [1]), ["g"], bad)


@pytest.mark.parametrize("labels,values", [([], []), ([0], [float("nan")]), ([0], [float("inf")]), ([2], [1.0])])
def test_bad_scores(spark, labels, values):
    with pytest.raises(ValueError):
        metrics.check_scores(scored(spark, labels, values))


def brute_auc_ap(labels, scores):
    pos = [s for y, s in zip(labels, scores) if y]
    neg = [s for y, s in zip(labels, scores) if not y]
    auc = sum((p > n) + 0.5 * (p == n) for p in pos for n in neg) / (len(pos) * len(neg))
    ap = before = 0
    for cut in sorted(set(scores), reverse=True):
        hit = sum(p >= cut for p in pos)
        ap += (hit - before) / len(pos) * hit / sum(s >= cut for s in scores)
        before = hit
    return auc, ap


def test_ranking_and_percentiles_against_brute_force_with_a_hot_group(spark):
    rng = random.Random(5)
    groups = {"hot": 3000, "small": 40, "tied": 300, "one": 1}
    data = [(g, rng.randrange(2), float(rng.randrange(3)) if g == "tied" else rng.gauss(5 * (g == "hot"), 1))
            for g, n in groups.items() for _ in range(n)]
    df = spark.createDataFrame(data, "g string, label int, score double")
    found = {r["g"]: r for r in metrics.ranking_metrics(df, ["g"]).collect()}
    shares = {"p10": 0.1, "p50": 0.5, "p90": 0.9, "p100": 1.0}
    cuts = {r["g"]: r for r in exact_percentiles(df, ["g"], "score", shares).collect()}
    for g in groups:
        labels, scores = zip(*[(y, s) for name, y, s in data if name == g])
        for name, share in shares.items():
            assert cuts[g][name] == pytest.approx(np.percentile(scores, 100 * share), abs=1e-12)
        if g == "one":
            assert found[g]["roc_auc"] is None
            continue
        auc, ap = brute_auc_ap(labels, scores)
        assert (found[g]["roc_auc"], found[g]["avg_precision"]) == (pytest.approx(auc), pytest.approx(ap))
    steps = running_counts(df, ["g"], "score", {"n": F.lit(1)}).filter("g = 'tied'").orderBy("score").collect()
    assert len(steps) == 3 and steps[2]["n_before"] + steps[2]["n"] == 300


def test_positions_do_not_depend_on_buckets(spark):
    rows = spark.range(500).select(F.lit("a").alias("g"), (F.col("id") * 7919 % 500).alias("v")).withColumn("b", F.col("v").cast("int").bitwiseAND(F.lit(0x1F0)))
    out = positions(rows, ["g"], "b", ["v"])
    assert all(r["position"] == r["v"] for r in out.collect())


def history(spark):
    rows = [("dns", "old", "2026-01-01T00:00:00Z", "legit-holdout", 0.9, None), ("dns", "b1", "2026-09-26T00:00:00Z", "legit-holdout", 0.1, None),
            ("dns", "b2", "2026-09-26T00:00:00Z", "legit-holdout", 0.3, None), ("dns", "c1", "2026-09-26T00:00:00Z", "covert-holdout", None, 0.8),
            ("icmp", "x", "2026-10-01T00:00:00Z", "legit-holdout", 0.5, None)]
    full = [dict(zip(("protocol", "fold", "run_timestamp", "fold_type", "fpr", "recall"), r)) | {"model_name": "Isolation Forest"} for r in rows]
    return spark.createDataFrame([tuple(r.get(f.name) for f in RESULT_SCHEMA) for r in full], RESULT_SCHEMA)


def test_report_of_the_newest_run(spark):
    report = results.evaluation_report(history(spark), "dns")
    assert {r["fold"] for r in report["per_fold_results"].collect()} == {"b1", "b2", "c1"}
    fpr, recall = report["fpr_summary"].first(), report["recall_summary"].first()
    assert (fpr["mean"], fpr["std"], fpr["count"]) == (pytest.approx(0.2), pytest.approx(math.sqrt(0.02)), 2)
    assert (recall["mean"], recall["std"], recall["count"]) == (0.8, None, 1)
    pivot = results.summary_pivot(results.latest_run(history(spark), "icmp")).collect()
    assert [tuple(r) for r in pivot] == [("Isolation Forest", 0.5, None, 1, 0)]
    with pytest.raises(ValueError, match="No saved results"):
        results.evaluation_report(history(spark), "tcp")


def test_result_history_grows(spark, tmp_path):
    path = str(tmp_path / "runs")
    append_results(history(spark), path)
    append_results(history(spark).drop("fpr"), path)
    again = read_results(spark, path)
    assert again.count() == 10 and again.filter("fpr is not null").count() == 4


def test_feature_table_round_trip_and_json(spark, tmp_path):
    features = table(spark, [dns_row(), {**icmp_row(), "protocol": "icmp"}])
    write_features(features.select(*reversed(features.columns)), str(tmp_path / "f"))
    back = read_features(spark, str(tmp_path / "f"))
    assert back.columns == features.columns and sorted(map(str, back.collect())) == sorted(map(str, features.collect()))
    odd = spark.createDataFrame([(0.1 + 0.2, float("nan"), None)], "a double, b double, c string")
    assert to_json_records(odd).first()[0] == '{"a":0.30000000000000004,"b":null,"c":null}'


def test_column_scorer_evaluation(spark):
    rows = [icmp_row(s, int(s != "base"), size_mean=float((3 * k + i) ** 2)) for k, s in enumerate(("base", "hans", "ptun")) for i in range(3)]
    out = {r["fold"]: r for r in loso_with_column_scorer(table(spark, rows), "icmp", "size_mean").collect()}
    assert set(out) == {"base", "hans", "ptun"}
    assert out["base"]["training_had_no_legit_examples"] and out["base"]["recall"] is None and out["base"]["fpr"] == 0
    assert out["hans"]["fpr"] is None and out["hans"]["recall"] is not None and out["hans"]["roc_auc"] is None
    assert all(r["tp"] + r["fp"] + r["tn"] + r["fn"] == 3 for r in out.values())


def audit_table(spark):
    rng = random.Random(7)
    rows = [dns_row(f"s{i % 2}", int(i % 3 == 0), size_mean=float(i), max_query_length=2.0 * i + 1, mean_query_length=float(i) if i % 5 else None,
                    entropy_mean=rng.random()) for i in range(60)]
    return table(spark, [*rows, icmp_row("i", 0)])


def test_audits(spark):
    t = audit_table(spark)
    sizes = {(r["protocol"], r["label"]): r["count"] for r in diagnose.class_sizes(t).collect()}
    assert sizes == {("dns", 0): 40, ("dns", 1): 20, ("icmp", 0): 1, ("icmp", 1): 0}
    assert diagnose.short_groups(t).count() == 3
    advice = diagnose.recommendation(t).first()
    assert advice[0].startswith("UNSUPERVISED") and advice[1] == "dns/label=1: 20, icmp/label=0: 1, icmp/label=1: 0"
    balance = {r["name"]: r["ratio"] for r in diagnose.class_balance(t).collect()}
    assert balance == {"overall": "2.05:1", "dns": "2.00:1", "icmp": "∞:1"}
    missing = {r["column_name"]: r["nan_count"] for r in diagnose.missing_values(t).collect()}
    assert missing["mean_query_length"] == 13 and missing["icmp_size_cv"] == 60 and missing["label"] == 0
    assert diagnose.dropna_loss(t).first()["dropped"] == 61


def test_correlation_with_gaps_and_constant_columns(spark):
    import pandas as pd

    t = audit_table(spark).repartition(5)
    found = {(r["left"], r["right"]): r["correlation"] for r in diagnose.correlation(t).collect()}
    frame = pd.DataFrame([r.asDict() for r in t.collect()])[diagnose.AUDITED].apply(pd.to_numeric)
    expected = frame.corr()
    assert len(found) == 225
    for (a, b), value in found.items():
        want = expected.at[a, b]
        assert value is None if np.isnan(want) else value == pytest.approx(want, abs=1e-9), (a, b)
    pairs = {(r["left"], r["right"]) for r in diagnose.near_duplicates(t).collect()}
    assert pairs == {("size_mean", "mean_query_length"), ("size_mean", "max_query_length"), ("mean_query_length", "max_query_length")}


def test_directions_and_sessions(spark, packets):
    rows = [dns_row(label=0, size_cv=0.5, entropy_mean=3.0), dns_row(label=1, size_cv=0.1, entropy_mean=4.0), icmp_row(label=0)]
    t = table(spark, rows)
    checks = {(r["protocol"], r["feature"]): r for r in diagnose.direction_check(t).collect()}
    assert checks["dns", "size_cv"]["direction"] == "↓" and checks["dns", "size_cv"]["two_sided"] and checks["dns", "size_cv"]["passes"] is None
    assert checks["dns", "entropy_mean"]["direction"] == "↑" and checks["dns", "entropy_mean"]["passes"]
    assert checks["dns", "interarrival_cv"]["direction"] == "→" and not checks["dns", "interarrival_cv"]["passes"]
    assert checks["icmp", "entropy_mean"]["direction"] == "n/a"
    stats = {(r["feature"], r["source_file"]): r for r in diagnose.baseline_sessions(t).collect()}
    assert stats["size_cv", "d1.pcap"]["mean"] == 0.5 and stats["size_cv", "d1.pcap"]["std"] is None
    from conftest import dns
    raw = packets([{**dns(5), "source_file": "d1.pcap"}, {**dns(9), "source_file": "d1.pcap"}])
    total = diagnose.session_totals(t, raw).first()
    assert (total["flow_count"], total["feature_packet_count_sum"], total["raw_packet_count"], total["raw_packets_per_second"]) == (1, 2, 2, 0.5)
    lone = diagnose.session_totals(t, packets([{**dns(5), "source_file": "d1.pcap"}])).first()
    assert lone["raw_packets_per_second"] is None


def test_reports_name_missing_columns(spark):
    small = table(spark, [dns_row()]).drop("size_cv", "packet_count")
    for report in (diagnose.correlation, diagnose.direction_check, diagnose.baseline_sessions):
        with pytest.raises(ValueError, match="size_cv"):
            report(small)
