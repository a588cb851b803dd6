"""Order-preserving keys, radix buckets, and what is counted with them."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from undertone.operators import ordering
from undertone.operators.metrics import ranking_metrics


def difficult_doubles():
    rng = np.random.default_rng(0)
    bits = rng.integers(-(2**63), 2**63 - 1, 4000, dtype=np.int64).view(np.float64)
    powers = 2.0 ** np.arange(-1074, 1024)
    near = np.concatenate([powers, np.nextafter(powers, 0), np.nextafter(powers, np.inf)])
    plain = rng.normal(size=500)
    every = np.concatenate([bits[np.isfinite(bits)], near, -near, plain, [0.0, -0.0, np.inf, -np.inf, 5e-324, -5e-324, 1.7976931348623157e308]])
    return every[~np.isnan(every)]


def test_keys_are_the_bits_of_the_doubles(spark):
    x = difficult_doubles()
    frame = spark.createDataFrame([(float(v),) for v in x], "v double")
    got = np.array([r["k"] for r in frame.select(ordering.ordered_key(F.col("v")).alias("k")).collect()])
    size = np.abs(x).view(np.int64)
    assert (got == np.where(x < 0, -size, size)).all()
    nan, none = spark.sql("select double('nan') v union all select null").select(ordering.ordered_key(F.col("v")).alias("k")).collect()
    assert nan["k"] > got.max() and none["k"] is None


@pytest.mark.parametrize("limit", [1, 7, 1 << 16])
def test_buckets_stay_small_and_in_order(spark, monkeypatch, limit):
    monkeypatch.setattr(ordering, "BUCKET_ROWS", limit)
    rng = np.random.default_rng(1)
    rows = [("one", float(v)) for v in [*rng.normal(size=300), *[0.25] * 60, *(1 + rng.random(200) * 1e-9)]]
    rows += [(None, float(v)) for v in rng.exponential(size=100)]
    bucketed, totals = ordering.radix_buckets(spark.createDataFrame(rows, "g string, v double"), ["g"], "v", {"twice": F.lit(2)})
    got = sorted(((r["g"] or "", r["v"], r["_bucket"]) for r in bucketed.collect()))
    for (g, v, b), (h, w, c) in zip(got, got[1:]):
        assert g != h or b <= c
    inside = {}
    for g, v, b in got:
        inside.setdefault((g, b), []).append(v)
    assert all(len(v) <= limit or len(set(v)) == 1 for v in inside.values())
    assert {(r["g"] or "", r["_bucket"]): (r["rows"], r["twice"]) for r in totals.collect()} == {
        k: (len(v), 2 * len(v)) for k, v in inside.items()}


@pytest.mark.parametrize("limit", [3, 1 << 16])
def test_percentiles_and_areas_at_any_size_of_buckets(spark, monkeypatch, limit):
    monkeypatch.setattr(ordering, "BUCKET_ROWS", limit)
    rng = np.random.default_rng(2)
    groups = {"a": rng.normal(size=257), "b": np.round(rng.normal(size=400), 1), "c": np.array([3.5]), "d": np.full(50, -1.0)}
    rows = [(g, float(v), int(rng.random() < 0.4)) for g, x in groups.items() for v in x] + [("a", None, 0)]
    frame = spark.createDataFrame(rows, "g string, v double, label int")
    shares = {"low": 0.0, "q": 0.25, "most": 0.9, "top": 1.0}
    for r in ordering.exact_percentiles(frame, ["g"], "v", shares).collect():
        for name, share in shares.items():
            assert r[name] == pytest.approx(np.percentile(groups[r["g"]], 100 * share), rel=1e-12)
    scored = frame.filter("v is not null").withColumnRenamed("v", "score")
    for r in ranking_metrics(scored, ["g"]).collect():
        pairs = [(v, y) for g, v, y in rows if g == r["g"] and v is not None]
        pos, neg = [v for v, y in pairs if y], [v for v, y in pairs if not y]
        if pos and neg:
            wins = sum((p > n) + (p == n) / 2 for p in pos for n in neg)
            assert r["roc_auc"] == pytest.approx(wins / len(pos) / len(neg))
            hits = [sum(p >= v for p in pos) / sum(x >= v for x, _ in pairs) for v in pos]
            assert r["avg_precision"] == pytest.approx(sum(hits) / len(pos))
        else:
            assert r["roc_auc"] is None
