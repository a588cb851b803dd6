"""Training at any size: the gang, exact samples, and boosting of all folds at once."""

import os
from types import SimpleNamespace

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from test_models import matrix_of
from undertone.operators import autoencoder, gang, iforest


def sessions_of(spark, x, sessions, labels=None):
    rows = [(s, str(i), int(labels[i]) if labels is not None else 0, *map(float, row)) for i, (s, row) in enumerate(zip(sessions, x))]
    names = ", ".join(f"f{k} double" for k in range(x.shape[1]))
    return spark.createDataFrame(rows, f"source_file string, flow_id string, label int, {names}")


def plain_training(x, steps_of_rows, sessions, folds, mean, scale, steps, epochs, lr, seed):
    """One fold after another, one row set a step, no gang."""
    out = []
    for k, fold in enumerate(folds):
        flat = autoencoder.initial_weights(x.shape[1], seed)[None]
        state = [flat.copy(), np.zeros_like(flat), np.zeros_like(flat), np.zeros((1, 1))]
        z = ((x.astype(np.float32) - mean[k]) / scale[k])
        for _ in range(epochs):
            for step in range(steps):
                rows = (steps_of_rows == step) & (sessions != fold)
                if rows.any():
                    g = autoencoder.gradient_sum(state[0], z[rows][None], np.ones((1, rows.sum()))) / rows.sum()
                    autoencoder.adam(state, g, np.array([[True]]), lr)
        out.append(state[0][0])
    return np.array(out)


@pytest.mark.parametrize("rows", [100, 100_000])
def test_one_rule_trains_small_and_large_tables(spark, rows):
    """The same plain loop tells the weights of 100 and of 100,000 rows."""
    rng = np.random.default_rng(rows)
    frame = spark.range(rows).select(
        F.when(F.col("id") % 3 == 0, "a").when(F.col("id") % 3 == 1, "b").otherwise("c").alias("source_file"),
        F.col("id").cast("string").alias("flow_id"), F.lit(0).alias("label"),
        *[F.randn(k).alias(f"f{k}") for k in range(3)]).cache()
    folds, mean, scale = ["a", ""], rng.normal(size=(2, 3)), np.array([[1.0, 2, 0.5], [1, 1, 1]])
    epochs = 3 if rows < 1000 else 1
    got = autoencoder.train_autoencoders(frame, rows, folds, mean, scale, epochs=epochs, seed=5)
    steps = autoencoder.epoch_steps(rows, 32)
    data = frame.withColumn("step", F.pmod(F.xxhash64("source_file", "flow_id", F.lit(5)), F.lit(steps))).toPandas()
    want = plain_training(
        data[["f0", "f1", "f2"]].to_numpy(), data["step"].to_numpy(), data["source_file"].to_numpy(), folds, mean, scale,
        steps, epochs, 1e-3, 5)
    assert np.allclose(got, want, atol=1e-9)


def test_members_and_streams_do_not_change_the_weights(spark, monkeypatch):
    x = np.random.default_rng(3).normal(size=(240, 4))
    matrix = sessions_of(spark, x, ["s", "t"] * 120).cache()
    one = np.zeros((2, 4))

    def train(**more):
        return autoencoder.train_autoencoders(matrix, 240, ["", "t"], one, one + 1, epochs=2, batch_size=120, **more)

    alone = train()
    assert np.allclose(alone, train(members=3), atol=1e-12)
    monkeypatch.setattr(autoencoder, "HELD_BYTES", 0)
    assert np.array_equal(alone, train())
    # More members than rows: some have none.
    few = matrix.limit(2)
    assert autoencoder.train_autoencoders(few, 2, [""], one[:1], one[:1] + 1, epochs=1, batch_size=2, members=4).shape == alone[:1].shape


def test_size_of_a_gang(spark):
    assert gang.gang_size(spark, 999, 10, 10, 1000) == 1
    assert gang.gang_size(spark, 10**9, 10, 10, 1000) == spark.sparkContext.defaultParallelism
    assert gang.gang_size(spark, 10**9, 6400, 10**6, 1000) == 1


def test_samples_are_the_lowest_rows_of_every_fold(spark, monkeypatch):
    monkeypatch.setattr(iforest, "SUBSAMPLE", 16)
    monkeypatch.setattr(iforest, "SKETCH_ROWS", 50)
    rng = np.random.default_rng(8)
    sessions = rng.choice(["big"] * 20 + ["a", "b", "c"], 1500)
    matrix = sessions_of(spark, rng.normal(size=(1500, 2)), sessions).repartition(9)
    folds = ["big", "a", iforest.EVERYTHING, "c"]
    keys = {(r["k"], r["source_file"]): (r["f0"], r["f1"]) for r in matrix.select(
        F.xxhash64("source_file", "flow_id", F.lit(1)).alias("k"), "source_file", "f0", "f1").collect()}
    tables = iforest.tree_samples(matrix, folds, 5, 1).toArrow()
    for tree in range(5):
        table = tables.filter(np.equal(tables.column("tree").to_numpy(), tree))
        sample = iforest.merged(table, len(folds), 2)
        order = iforest.priorities(np.array([k for k, _ in keys], np.int64).view(np.uint64), tree, 1)
        for number, fold in enumerate(folds):
            rows = sorted((p, x) for p, ((_, s), x) in zip(order, keys.items()) if s != fold)
            assert sample.bottom(number).tolist() == [list(x) for _, x in rows[:16]]
        assert len(sample.x) <= 4 * 16


def test_sketches_that_know_their_limit_take_whole_batches(monkeypatch):
    """Once no fold needs more rows, few rows of a batch are low enough: cutting it up costs a sort per tree and cut."""
    x, keys = np.random.default_rng(9).normal(size=(20000, 2)), np.arange(20000) * 7919
    keys[-1] = keys[0]
    batch = pa.RecordBatch.from_arrays([
        pa.array(keys), pa.array(np.full(20000, -1, np.int32)), pa.FixedSizeListArray.from_arrays(pa.array(x.ravel()), 2)],
        names=["key", "session", "x"])
    monkeypatch.setattr(iforest, "TaskContext", SimpleNamespace(get=lambda: SimpleNamespace(partitionId=lambda: 0)))
    calls, add = [], iforest.Sample.add
    monkeypatch.setattr(iforest.Sample, "add", lambda sample, *rows: calls.append(len(rows[0])) or add(sample, *rows))
    sketch, = iforest.sketch_rows(1, 2, 3, 1)([batch])
    assert calls == [4096] * 3 + [20000 - 4096] * 3
    for tree in range(3):
        order = np.lexsort((x[:, 1], x[:, 0], iforest.priorities(keys.view(np.uint64), tree, 1)))[:256]
        assert np.frombuffer(sketch.column("x")[tree].as_py()).reshape(-1, 2).tolist() == x[order].tolist()


def test_every_row_enters_trees_equally_often(spark, monkeypatch):
    """Inclusion counts of 600 rows over 300 trees lie as a binomial's would."""
    monkeypatch.setattr(iforest, "SUBSAMPLE", 60)
    x = np.arange(600, dtype=float)[:, None]
    tables = iforest.tree_samples(matrix_of(spark, x).repartition(3), [iforest.EVERYTHING], 300, 7).toArrow()
    counts = np.zeros(600)
    for tree in range(300):
        rows = iforest.merged(tables.filter(np.equal(tables.column("tree").to_numpy(), tree)), 1, 1).bottom(0)
        assert len(rows) == 60
        counts[rows[:, 0].astype(int)] += 1
    assert counts.min() > 0 and abs(counts.mean() - 30) < 1e-9
    assert 0.8 < counts.var() / (300 * 0.1 * 0.9) < 1.25


def test_forests_must_be_complete(spark):
    matrix = matrix_of(spark, np.random.default_rng(0).normal(size=(50, 2)))
    nodes = iforest.train_isolation_forest(matrix, {iforest.EVERYTHING: 50}, 6).cache()
    assert len(iforest.collect_forests(nodes, 6)[iforest.EVERYTHING].cut) == 6
    with pytest.raises(ValueError, match="5 different trees"):
        iforest.collect_forests(nodes.filter("tree <> 3"), 6)


def two_classes(rng, n, sessions=("a", "b", "c")):
    label = (rng.random(n) < 0.3).astype(int)
    x = rng.normal(size=(n, 4)) + label[:, None] * np.array([1.5, 0, -1, 0.2])
    x[:, 3] = np.round(x[:, 3])
    return x, label, [sessions[k % len(sessions)] for k in range(n)]


def area(label, score):
    order = np.argsort(score)
    ranks = np.empty(len(score))
    ranks[order] = np.arange(1, len(score) + 1)
    pos = label.sum()
    return (ranks[label == 1].sum() - pos * (pos + 1) / 2) / (pos * (len(label) - pos))


def test_boosted_trees_rank_as_spark_ml_does(spark):
    from pyspark.ml.classification import GBTClassifier
    from pyspark.ml.feature import VectorAssembler
    from pyspark.ml.functions import vector_to_array

    from undertone.operators import boosted

    rng = np.random.default_rng(1)
    x, label, sessions = two_classes(rng, 1500)
    matrix = sessions_of(spark, x, sessions, label).cache()
    train, test = matrix.filter("source_file <> 'c'"), matrix.filter("source_file = 'c'")
    ours = boosted.score_supervised(boosted.train_supervised(train, 30), test).toPandas()
    ready = VectorAssembler(inputCols=[f"f{k}" for k in range(4)], outputCol="v")
    legit, covert = boosted.class_counts(train)
    weighted = ready.transform(train).withColumn("w", F.when(F.col("label") == 1, legit / covert).otherwise(1.0))
    theirs = GBTClassifier(featuresCol="v", weightCol="w", maxIter=30, maxDepth=3, stepSize=0.1, seed=1).fit(weighted)
    theirs = theirs.transform(ready.transform(test)).select("flow_id", vector_to_array("probability")[1].alias("p")).toPandas()
    both = ours.merge(theirs, on="flow_id")
    assert abs(area(both["label"].to_numpy(), both["score"]) - area(both["label"].to_numpy(), both["p"])) < 0.02
    assert np.corrcoef(both["score"], both["p"])[0, 1] > 0.95


def plain_boosting(x, label, weight, cuts, iterations):
    """One fold by exhaustive search over the same cuts; probabilities of the training rows."""
    margin = np.zeros(len(x))
    for _ in range(iterations):
        p = 1 / (1 + np.exp(-margin))
        g, h = weight * (p - label), weight * p * (1 - p)

        def value(rows):
            return g[rows].sum() ** 2 / (h[rows].sum() + 1)

        def split(rows, depth):
            if depth == 3:
                margin[rows] += -0.1 * g[rows].sum() / (h[rows].sum() + 1)
                return
            best = (1e-6, None)
            for j, points in enumerate(cuts):
                for c in points:
                    left = rows & (x[:, j] <= c)
                    right = rows & ~left
                    if h[left].sum() >= 1 and h[right].sum() >= 1:
                        gain = value(left) + value(right) - value(rows)
                        if gain > best[0] + 1e-9:
                            best = gain, (left, right)
            if best[1] is None:
                margin[rows] += -0.1 * g[rows].sum() / (h[rows].sum() + 1)
            else:
                for part in best[1]:
                    split(part, depth + 1)

        split(np.ones(len(x), bool), 0)
    return 1 / (1 + np.exp(-margin))


def test_folds_train_together_as_they_would_alone(spark):
    from undertone.operators import boosted

    rng = np.random.default_rng(2)
    x, label, sessions = two_classes(rng, 400)
    matrix = sessions_of(spark, x, sessions, label).cache()
    cuts = boosted.quantile_cuts(matrix)
    weights = {"a": 2.0, boosted.EVERYTHING: 1.0, "c": 3.0}
    models = boosted.train_boosted(matrix, weights, 400, iterations=4)
    for fold, weight in weights.items():
        used = np.array(sessions) != fold
        want = plain_boosting(x[used], label[used], np.where(label[used] == 1, weight, 1.0), cuts, 4)
        assert np.allclose(models[fold].probabilities(x[used]), want, atol=1e-5)
    together = boosted.train_boosted(matrix, weights, 400, iterations=1, members=2)
    alone = boosted.train_boosted(matrix, weights, 400, iterations=1)
    for fold in weights:
        assert np.allclose(together[fold].margins(x), alone[fold].margins(x), atol=1e-9)


def test_jobs_do_not_depend_on_the_number_of_folds(spark, monkeypatch):
    from undertone.operators import boosted

    calls = []
    monkeypatch.setattr(boosted, "run_gang", lambda *a, run=boosted.run_gang: calls.append(1) or run(*a))
    rng = np.random.default_rng(3)
    names = tuple(f"s{k}" for k in range(20))
    x, label, sessions = two_classes(rng, 400, names)
    matrix = sessions_of(spark, x, sessions, label).cache()
    for folds in (names[:2], names):
        calls.clear()
        models = boosted.train_boosted(matrix, {f: 1.0 for f in folds}, 400, iterations=2)
        assert len(models) == len(folds) and len(calls) == 1
        scored = boosted.score_held_out(models, matrix)
        assert scored.count() == sum(s in folds for s in sessions) and scored.filter("score < 0 or score > 1").count() == 0
    # Where margins of few folds fit beside the rows, folds take turns.
    monkeypatch.setattr(boosted, "HELD_BYTES", 400 * (4 + 5 + 5 * 8))
    calls.clear()
    assert len(boosted.train_boosted(matrix, {f: 1.0 for f in names}, 400, iterations=1)) == 20 and len(calls) == 3


def test_a_table_without_splits(spark):
    from undertone.operators import boosted

    matrix = sessions_of(spark, np.ones((40, 2)), ["a"] * 40, np.arange(40) % 2).cache()
    model = boosted.train_supervised(matrix, 3)
    assert np.allclose(model.probabilities(np.ones((3, 2))), 0.5)


def test_members_exchange_files_where_the_folder_is_shared(spark, monkeypatch):
    from undertone.operators import boosted

    assert gang.exchange_seconds(spark) < gang.SLOW_FILES
    # A minute's work of one member, a hundred milliseconds a step: too little for the driver, enough for files.
    assert gang.plan_gang(spark, 100_000, 1000, 100, 1_000_000)[0] > 1
    assert gang.gang_size(spark, 100_000, 1000, 100, 1_000_000) == 1
    sizes = []
    for module in (autoencoder, boosted):
        monkeypatch.setattr(module, "run_gang", lambda *a, run=module.run_gang: sizes.append((a[1], a[6])) or run(*a))
    rng = np.random.default_rng(4)
    x, label, sessions = two_classes(rng, 300)
    matrix = sessions_of(spark, x, sessions, label).cache()
    mean, scale = np.zeros((2, x.shape[1])), np.ones((2, x.shape[1]))

    def train():
        sizes.clear()
        weights = autoencoder.train_autoencoders(matrix, 300, ["a", ""], mean, scale, epochs=3, batch_size=50)
        return weights, boosted.train_boosted(matrix, {"a": 1.0, "": 2.0}, 300, 3)

    weights, models = train()
    assert sizes == [(1, None)] * 2
    monkeypatch.setattr(gang, "WORTH_A_TRIAL", 0)
    monkeypatch.setattr(autoencoder, "ROWS_PER_SHARD", 100)
    monkeypatch.setattr(boosted, "ROWS_PER_MEMBER", 100)
    again, others = train()
    assert all(size == 4 and folder for size, folder in sizes)
    assert np.allclose(weights, again, atol=1e-12)
    assert all(np.allclose(models[f].margins(x), others[f].margins(x), atol=1e-9) for f in models)
    # The files are gone with the gang.
    assert not any(os.path.exists(folder) for _, folder in sizes)


def test_a_store_without_files_leaves_the_exchange_to_the_driver(spark, monkeypatch):
    monkeypatch.setattr(gang, "shared_dir", lambda spark: "hdfs://cluster/shared")
    assert gang.exchange_seconds(spark) == np.inf
    assert gang.plan_gang(spark, 10**9, 10, 10, 1000) == (4, None)
