"""The random split, thresholds of shifted scores and the walk down a forest, against plain versions."""

import numpy as np
import pytest
from pyspark.sql import Window, functions as F

from undertone.operators import autoencoder, metrics, splits
from undertone.operators.iforest import Forest, depth_limit, grow_tree


def keyed(spark, rows):
    """Rows of two classes; every fourth repeats the key of the one before."""
    number = F.when(F.col("id") % 4 == 3, F.col("id") - 1).otherwise(F.col("id"))
    return spark.range(rows, numPartitions=4).select(
        F.lit("a").alias("source_file"), number.cast("string").alias("flow_id"),
        (F.floor(F.col("id") / 4) % 3 == 0).cast("int").alias("label"), F.col("id").cast("double").alias("f0"))


@pytest.mark.parametrize("share", [0.0, 0.3, 1.0])
def test_split_takes_the_lowest_hashes_of_each_class(spark, share):
    rows = keyed(spark, 20_000)
    lowest = Window.partitionBy("label").orderBy(F.xxhash64("source_file", "flow_id", F.lit(7)), "source_file", "flow_id")
    ranked = rows.withColumn("rank", F.row_number().over(lowest)).collect()
    quota = splits.test_quota({y: sum(r["label"] == y for r in ranked) for y in (0, 1)}, share)
    want = sorted((r["flow_id"], r["rank"] <= quota[r["label"]]) for r in ranked)
    got = splits.stratified_split(rows, share, 7).collect()
    assert sorted((r["flow_id"], r["part"] == "test") for r in got) == want
    assert sorted(r["f0"] for r in got) == list(range(20_000))


def test_split_shuffles_only_rows_of_one_bucket_a_class(spark, tmp_path):
    keyed(spark, 20_000).write.parquet(f"{tmp_path}/rows")
    split = splits.stratified_split(spark.read.parquet(f"{tmp_path}/rows"), 0.3, 7)
    split.write.format("noop").mode("overwrite").save()
    plan = split._jdf.queryExecution().executedPlan()
    split.collect()
    lines = plan.toString().splitlines()
    exchanged = [line for line in lines if "Exchange hashpartitioning" in line]
    assert "Join" not in plan.toString() and len(exchanged) <= 2 and all("label" in line for line in exchanged)


def test_thresholds_of_shifted_scores_come_from_one_search(spark):
    rng = np.random.default_rng(1)
    values = [(g, 0, float(v)) for g in "ab" for v in [*rng.random(501) / 3 + 0.4, 1e-9, 0.1 + 0.2]]
    training = spark.createDataFrame(values, "g string, label int, score double")
    moved = F.col("g") == "a"
    found = {r["g"]: r for r in metrics.shifted_thresholds(training, ["g"], moved).collect()}
    offsets = {r["g"]: r["threshold"] for r in metrics.score_threshold(training, ["g"]).collect()}
    shifted = training.withColumn("score", F.col("score") - F.when(moved, F.lit(offsets["a"])).otherwise(0.0))
    again = {r["g"]: r["threshold"] for r in metrics.score_threshold(shifted, ["g"]).collect()}
    assert found["a"]["offset"] == offsets["a"] and found["b"]["offset"] == 0.0
    assert {g: r["threshold"] for g, r in found.items()} == again
    with pytest.raises(ValueError, match="contamination"):
        metrics.shifted_thresholds(training, ["g"], moved, 0.7)


def plain_paths(forest, x):
    out = np.zeros(len(x))
    for feature, cut, path in zip(forest.feature, forest.cut, forest.path):
        for at, row in enumerate(x):
            node = 0
            for _ in range(depth_limit(forest.sample_rows)):
                node = 2 * node + 1 + int(row[feature[node]] > cut[node])
            out[at] += path[node - len(cut)]
    return out


@pytest.mark.parametrize("sample", [1, 2, 5, 9, 40, 256])
def test_a_walk_tests_all_nodes_near_the_root(sample):
    from undertone.operators.iforest import top_nodes

    rng = np.random.default_rng(sample)
    trees = [grow_tree(rng.normal(size=(sample, 3)).round(1), rng) for _ in range(7)]
    forest = Forest(*(np.array([t[k] for t in trees]) for k in range(3)), sample)
    x = rng.normal(size=(200, 3)).round(1)
    x[0, 1], x[1] = np.nan, np.inf
    assert (forest.paths(x) == plain_paths(forest, x)).all()
    assert len(forest.raw_scores(x[:0])) == 0
    tests = rng.random((7, 50)) < 0.5
    want = [3 + 4 * t[0] + 2 * t[1 + t[0]] + t[3 + 2 * t[0] + t[1 + t[0]]] + 4 for t in tests.T.astype(int)]
    assert (top_nodes(tests, 3) == want).all()


def test_gradients_reuse_their_arrays_and_match_differences():
    rng = np.random.default_rng(4)
    flat = autoencoder.initial_weights(5, 1)
    for rows in (40, 7, 40):
        x, used = rng.normal(size=(rows, 5)), (rng.random(rows) < 0.7).astype(float)
        loss = lambda w: (used * ((autoencoder.activations(autoencoder.layers(w[None], 5)[0], x)[-1] - x) ** 2).mean(axis=1)).sum()
        got = autoencoder.gradient_sum(flat[None], x[None], used[None])[0]
        for at in range(0, len(flat), 17):
            step = np.zeros_like(flat)
            step[at] = 1e-6
            assert got[at] == pytest.approx((loss(flat + step) - loss(flat - step)) / 2e-6, rel=1e-4, abs=1e-5)
        memory = {k: id(v) for k, v in autoencoder._MEMORY.items()}
        assert (autoencoder.gradient_sum(flat[None], x[None], used[None])[0] == got).all()
        assert memory == {k: id(v) for k, v in autoencoder._MEMORY.items()}
