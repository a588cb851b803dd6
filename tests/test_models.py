import math
import random

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from conftest import dns, icmp
from test_evaluation import icmp_row, table
from undertone.operators import boosted
from undertone.operators.autoencoder import reconstruction_error, train_autoencoders
from undertone.operators.features import build_flow_features
from undertone.operators.iforest import EVERYTHING, average_path, collect_forests, grow_tree, predict_labels, train_isolation_forest
from undertone.operators.scoring import score_captures, score_summary, with_scores, with_status
from undertone.plans.comparison import run_random_split_comparison
from undertone.plans.dataset import build_dataset, dataset_counts, empty_captures
from undertone.plans.final_models import train_final
from undertone.plans.loso import AUTOENCODER, FOREST, SUPERVISED, run_loso
from undertone.sources.manifest import named_captures
from undertone.sources.model_store import load_detector


def matrix_of(spark, x, labels=None):
    labels = labels if labels is not None else [0] * len(x)
    rows = [("s", str(i), int(y), *map(float, row)) for i, (row, y) in enumerate(zip(x, labels))]
    names = ", ".join(f"f{k} double" for k in range(x.shape[1]))
    return spark.createDataFrame(rows, f"source_file string, flow_id string, label int, {names}")


def test_path_lengths_and_depth():
    assert (average_path(1), average_path(2)) == (0, 1)
    assert average_path(256) == pytest.approx(2 * (np.log(255) + 0.5772156649) - 2 * 255 / 256)
    feature, cut, path = grow_tree(np.random.default_rng(0).normal(size=(256, 3)), np.random.default_rng(1))
    assert len(cut) == 255 and len(path) == 256 and path.max() <= 8 + average_path(256)
    constant = grow_tree(np.ones((5, 2)), np.random.default_rng(1))
    assert np.allclose(constant[2], average_path(5))


def test_forest_finds_planted_outliers_whatever_the_partitioning(spark):
    rng = np.random.default_rng(42)
    x = np.vstack([rng.normal(0, 0.25, (100, 2)), rng.uniform(4, 6, (5, 2)) * rng.choice([-1, 1], (5, 2))])
    matrix = matrix_of(spark, x)
    forest = collect_forests(train_isolation_forest(matrix, {EVERYTHING: 105}))[EVERYTHING]
    again = collect_forests(train_isolation_forest(matrix.repartition(7), {EVERYTHING: 105}))[EVERYTHING]
    scores = forest.raw_scores(x)
    assert forest.sample_rows == 105 and len(forest.cut) == 200
    assert np.allclose(scores, again.raw_scores(x))
    assert scores[100:].min() > np.median(scores)
    cut = np.percentile(scores, 90)
    assert (scores[100:] > cut).sum() >= 4
    flags = spark.createDataFrame([(float(s - cut),) for s in scores], "s double").select(predict_labels(F.col("s")).alias("p"))
    assert flags.agg(F.sum("p")).first()[0] == (scores > cut).sum() == 11


def test_forest_samples_are_exact_on_larger_tables(spark):
    matrix = matrix_of(spark, np.random.default_rng(0).normal(size=(3000, 2)))
    rows = train_isolation_forest(matrix, {EVERYTHING: 3000}, n_estimators=20).collect()
    assert len(rows) == 20 and {r["sample_rows"] for r in rows} == {256}


def test_autoencoder_separates_unseen_shapes(spark):
    rng = np.random.default_rng(42)
    x, odd = rng.normal(0, 0.15, (128, 4)), np.full((8, 4), 6.0)
    one = np.zeros((1, 4))
    weights = train_autoencoders(matrix_of(spark, x), 128, [EVERYTHING], one, one + 1)[0]
    assert np.median(reconstruction_error(weights, odd)) > 10 * np.median(reconstruction_error(weights, x))
    again = train_autoencoders(matrix_of(spark, x).repartition(5), 128, [EVERYTHING], one, one + 1)[0]
    assert np.allclose(weights, again)


def test_autoencoder_rounds_over_several_shards(spark, monkeypatch):
    from undertone.operators import autoencoder

    monkeypatch.setattr(autoencoder, "ROWS_PER_SHARD", 100)
    rng = np.random.default_rng(1)
    z = rng.normal(size=(400, 1))
    x = np.hstack([z, 2 * z, -z, 0.5 * z]) + rng.normal(0, 0.05, (400, 4))
    one = np.zeros((1, 4))
    weights = train_autoencoders(matrix_of(spark, x), 400, [EVERYTHING], one, one + 1, lr=5e-3)[0]
    assert reconstruction_error(weights, x).mean() < 0.3 * (x**2).mean()


def test_autoencoder_guards(spark, caplog):
    one = np.zeros((1, 2))
    with pytest.raises(ValueError, match="at least one"):
        train_autoencoders(matrix_of(spark, np.zeros((1, 2))), 0, [EVERYTHING], one, one + 1)
    train_autoencoders(matrix_of(spark, np.zeros((2, 2))), 2, [EVERYTHING], one, one + 1, epochs=1)
    assert "clamping to 2" in caplog.text


def test_supervised_reference(spark):
    from pyspark.ml.evaluation import BinaryClassificationEvaluator

    rng = np.random.default_rng(42)
    x = np.vstack([rng.normal(0, 1, (100, 3)), rng.normal(3, 1, (25, 3))])
    matrix = matrix_of(spark, x, [0] * 100 + [1] * 25)
    assert boosted.class_counts(matrix) == (100, 25)
    scored = boosted.score_supervised(boosted.train_supervised(matrix, iterations=10), matrix)
    auc = BinaryClassificationEvaluator(rawPredictionCol="score").evaluate(scored)
    assert auc > 0.95 and scored.filter("score < 0 or score > 1").count() == 0
    for bad, text in ((matrix.filter("label = 0"), "both"), (matrix.limit(0), "nonempty"), (matrix.withColumn("label", F.lit(3)), "0 .legit.")):
        with pytest.raises(ValueError, match=text):
            boosted.train_supervised(bad)


def lab(spark):
    rng = random.Random(11)
    rows = []
    for k, (source, label) in enumerate((("b1", 0), ("b2", 0), ("t1", 1), ("t2", 1))):
        for _ in range(40):
            rows.append(icmp_row(source, label, size_mean=rng.gauss(80 + 40 * label, 5), entropy_mean=rng.gauss(3 + 2 * label, 0.3),
                                 icmp_size_cv=abs(rng.gauss(0.05 + 0.5 * label, 0.05)), packet_count=2 + rng.randrange(4)))
    return table(spark, rows)


def test_session_held_out_evaluation_of_all_models(spark):
    out = run_loso(lab(spark), "icmp", iterations=5, epochs=10, n_estimators=30).collect()
    assert len(out) == 12 and {r["model_name"] for r in out} == {FOREST, AUTOENCODER, SUPERVISED}
    for r in out:
        assert r["tp"] + r["fp"] + r["tn"] + r["fn"] == 40 and r["roc_auc"] is None
        assert (r["fpr"] is None) == (r["fold_type"] != "legit-holdout")
        assert (r["recall"] is None) == (r["fold_type"] != "covert-holdout")
        if r["model_name"] == SUPERVISED:
            assert r["uses_training_labels"] and (r["threshold"], r["threshold_source"]) == (0.5, "fixed")
            assert r["scale_pos_weight"] == r["train_legit"] / r["train_covert"] and r["contamination"] is None
        else:
            assert not r["uses_training_labels"] and r["scale_pos_weight"] is None and r["contamination"] == 0.1
    recall = {r["fold"]: r["recall"] for r in out if r["model_name"] == SUPERVISED}
    assert recall["t1"] > 0.9 and recall["t2"] > 0.9


def test_folds_without_a_class_skip_the_supervised_model(spark):
    two = lab(spark).filter("source_file in ('b1', 't1')")
    out = run_loso(two, "icmp", epochs=2, n_estimators=5).collect()
    assert len(out) == 4 and all(r["model_name"] != SUPERVISED for r in out)
    assert [r["training_had_no_legit_examples"] for r in out if r["fold"] == "b1"] == [True, True]


def test_random_split(spark):
    rows = run_random_split_comparison(lab(spark), None, epochs=5, n_estimators=20).collect()
    assert {r["model_name"] for r in rows} == {FOREST, AUTOENCODER} and {r["protocol"] for r in rows} == {"combined"}
    assert all(r["tp"] + r["fp"] + r["tn"] + r["fn"] == 48 and 0 <= r["roc_auc"] <= 1 for r in rows)


@pytest.fixture(scope="module")
def saved(spark, packets, tmp_path_factory):
    rng = random.Random(2)
    rows = []
    for k in range(40):
        covert = k % 4 == 0
        for i in range(4):
            rows.append({**dns(100 * k + i * rng.random(), sport=4000 + k, payload_bytes=rng.randbytes(90) if covert else b"example.com",
                               query_length=60 if covert else 11, qtype="TXT" if covert else "A"), "source_file": f"dns_{k % 2}"})
            rows.append({**icmp(100 * k + i, f"10.0.1.{k}", payload_bytes=bytes(range(56)), payload_length=56), "source_file": f"icmp_{k % 2}"})
    frame = packets(rows)
    folder = str(tmp_path_factory.mktemp("models"))
    features = build_flow_features(frame).withColumn("label", F.lit(0))
    return frame, folder, train_final(features, folder, epochs=5, n_estimators=25)


def test_saved_detectors_round_trip_and_score(spark, saved):
    frame, folder, models = saved
    assert set(models) == {"dns", "icmp"}
    model = load_detector(spark, "dns", folder)
    assert model.names == models["dns"].names and len(model.names) == 15 and model.training_flow_count == 40
    assert np.array_equal(model.weights, models["dns"].weights) and np.array_equal(model.forest.cut, models["dns"].forest.cut)
    out = score_captures(frame, model)
    rows = out.collect()
    assert len(rows) == 40 and sum(r["packet_count"] for r in rows) == 160
    for r in rows:
        assert isinstance(r["flow_id"], str) and r["start_timestamp"] <= r["end_timestamp"]
        assert r["flagged_by_either"] == (r["isolation_forest_score"] >= model.forest_threshold
                                          or r["autoencoder_reconstruction_error"] >= model.autoencoder_threshold)
    flagged = sum(r["flagged_by_either"] for r in rows)
    assert 1 <= flagged < 20
    assert tuple(score_summary(out).first()) == (40, flagged, 160)
    assert with_status(out).filter("status = 'Flagged - demo'").count() == flagged


def test_scoring_refuses_unusable_input(spark, packets, saved):
    model = load_detector(spark, "dns", saved[1])
    with pytest.raises(ValueError, match="no usable dns packets"):
        score_captures(packets([icmp(0)]), model)
    broken = build_flow_features(packets([dns(0)])).withColumn("size_mean", F.lit(float("inf")))
    with pytest.raises(Exception, match="non-finite feature size_mean"):
        with_scores(broken, model).collect()


@pytest.mark.parametrize("name,change,text", [
    ("model_meta", lambda d: d.withColumn("demo_only", F.lit(False)), "not marked"),
    ("model_meta", lambda d: d.withColumn("autoencoder_threshold", F.lit(float("nan"))), "autoencoder_threshold is not a finite"),
    ("model_meta", lambda d: d.withColumn("feature_names", F.reverse("feature_names")), "order"),
    ("model_meta", lambda d: d.withColumn("input_dim", F.lit(3)), "trained on 3 inputs"),
    ("scaler", lambda d: d.withColumn("position", -F.col("position")), "order"),
    ("ae_weights", lambda d: d.withColumn("weights", F.slice("weights", 1, 5)), "another number of inputs"),
    ("forest_nodes", lambda d: d.limit(0), "no tree"),
    (None, None, "missing"),
])
def test_tampered_models_are_refused(spark, saved, tmp_path, name, change, text):
    for table_name in ("model_meta", "scaler", "ae_weights", "forest_nodes"):
        source = spark.read.parquet(f"{saved[1]}/dns/{table_name}")
        if name is not None:
            (change(source) if table_name == name else source).write.parquet(f"{tmp_path}/dns/{table_name}")
    with pytest.raises(ValueError, match=text):
        load_detector(spark, "dns", str(tmp_path))


def test_dataset_labels_failures_and_empty_captures(spark, packets):
    names = ["dns_base_legit_20240101T000000Z.pcap", "icmp_hans_covert_20240101T000000Z.pcap",
             "tcp_x_legit_20240101T000000Z.pcap", "dns_none_covert_20240101T000000Z.pcap"]
    manifest = named_captures(spark.createDataFrame([(n, 1) for n in names], "filename string, length long"))
    frame = packets([{**dns(0), "source_file": names[0]}, {**icmp(0), "source_file": names[1]},
                     {**icmp(0), "source_file": names[0]}, {**dns(0), "source_file": "unlisted"}])
    dataset, failures = build_dataset(manifest, frame)
    assert sorted((r["source_file"], r["label"], r["protocol"]) for r in dataset.collect()) == [
        (names[0], 0, "dns"), (names[1], 1, "icmp")]
    assert len(dataset.columns) == 21 and dataset_counts(dataset).count() == 2
    assert [tuple(r) for r in failures.collect()] == [(names[2], "unknown protocol tcp")]
    assert [r[0] for r in empty_captures(manifest, frame).collect()] == [names[3]]


def test_stream_equals_batch_on_closed_flows(spark, packets, saved, tmp_path):
    from undertone.streaming.live import read_packet_stream, stream_score

    model = load_detector(spark, "dns", saved[1])
    rng = random.Random(4)
    rows = [{**dns(1000 + rng.randrange(0, 4000) / 4, f"10.0.0.{rng.randrange(4)}", sport=1 + rng.randrange(3),
                   payload_bytes=rng.randbytes(rng.randrange(40)), query_length=rng.randrange(1, 60), qtype=rng.choice(["A", "TXT", None])),
             "source_file": "live"} for _ in range(1500)]
    rows += [{**icmp(1005), "source_file": "live"}]
    end = [{**dns(9000 + 100 * i, "10.0.9.9"), "source_file": "live"} for i in range(3)]
    rows.sort(key=lambda r: r["t"])
    frame = packets([*rows, *end])
    source = str(tmp_path / "in")
    for part in range(3):
        frame.filter((F.col("packet_seq") >= 500 * part) & (F.col("packet_seq") < 500 * (part + 1)) if part < 2 else F.col("packet_seq") >= 1000).coalesce(1).write.mode("append").parquet(source)
    query = (
        stream_score(read_packet_stream(spark, source, files_per_trigger=1), model, late_by="10 seconds")
        .writeStream.format("memory").queryName("live_scores").outputMode("append")
        .option("checkpointLocation", str(tmp_path / "progress")).trigger(availableNow=True).start()
    )
    query.awaitTermination()
    columns = ["start_timestamp", "end_timestamp", "packet_count", "flagged_by_either", "isolation_forest_score", "autoencoder_reconstruction_error"]
    key = lambda r: tuple(round(x, 6) if isinstance(x, float) else x for x in r)
    streamed = sorted(key(r) for r in spark.table("live_scores").select(*columns).collect())
    batch = sorted(key(r) for r in score_captures(frame.filter("ts_us < 8000000000"), model).select(*columns).collect())
    closed = [r for r in streamed if r[0] < 8000]
    assert len(batch) > 50 and [r[:4] for r in closed] == [r[:4] for r in batch]
    assert np.allclose([r[4:] for r in closed], [r[4:] for r in batch], atol=1e-6)


@pytest.mark.parametrize("at_once", [1 << 16, 7])
def test_stream_measures_windows_together(monkeypatch, at_once):
    """One pass over the packets of a conversation, however many windows they fill; blocks change no figure."""
    from undertone.streaming import live

    rng = np.random.default_rng(3)
    ts = np.cumsum(rng.choice([200_000, 3_000_000, 50_000_000], 900, p=[0.6, 0.35, 0.05]))
    columns = [np.where(rng.random(900) < 0.3, np.nan, rng.random(900)) for _ in live.MEASURES]
    passes, measure = [], live.Moments.of_stretches
    monkeypatch.setattr(live, "PACKETS_AT_ONCE", at_once)
    monkeypatch.setattr(live.Moments, "of_stretches", lambda *a: passes.append(1) or measure(*a))
    state = live.Conversation()
    rows = live.absorb(("a.pcap", "dns"), state, ts, columns, 30_000_000, 5_000_000, 10_000_000)
    rows += live.close(("a.pcap", "dns"), state.flow, 10_000_000)
    assert len(passes) == math.ceil(900 / at_once) and len(rows) > 100
    got = pd.DataFrame(rows, columns=[f.name for f in live.FEATURE_ROW])
    assert got["packet_count"].sum() == 900
    for row in got.to_dict("records"):
        inside = (ts >= round(row["start_timestamp"] * 1e6)) & (ts <= round(row["end_timestamp"] * 1e6))
        gaps, values = np.diff(ts[inside]) / 1e6, [c[inside][~np.isnan(c[inside])] for c in columns]
        assert inside.sum() == row["packet_count"]
        assert np.isclose(row["interarrival_mean"], gaps.mean() if len(gaps) else 0.0, rtol=1e-12)
        assert np.isclose(row["interarrival_std"], gaps.std() if len(gaps) else 0.0, rtol=1e-9, atol=1e-12)
        assert np.isclose(row["size_std"], values[0].std() if len(values[0]) else 0.0, rtol=1e-9, atol=1e-12)
        assert (row["entropy_max"] == values[1].max()) if len(values[1]) else pd.isna(row["entropy_max"])
    stored = live.Conversation(state.flow, {"ts_us": [1, 2], "entropy": [0.5, math.nan]})
    assert live.Conversation.from_json(stored.to_json()).to_json() == stored.to_json()
