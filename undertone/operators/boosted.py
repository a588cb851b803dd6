"""Supervised boosted trees: a labelled reference, not a novelty detector.

Features are cut at quantiles once, over all rows. A tree grows level by level: one histogram of
gradients per fold, node, feature and bin is added up over a gang of tasks, and every member reads the
same best splits from it. Folds are a dimension of the histogram, so all folds train in one job.
"""

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F, types as T
from pyspark.sql.pandas.types import to_arrow_schema

from undertone.operators.gang import plan_gang, run_gang
from undertone.operators.iforest import EVERYTHING
from undertone.operators.prepare import feature_names

PROBABILITY_THRESHOLD = 0.5
DEPTH, BINS, STEP = 3, 128, 0.1
# Weight added to every leaf's rows, least weight of a child, least gain of a split.
LEAF_WEIGHT, LEAST_CHILD, LEAST_GAIN = 1.0, 1.0, 1e-6
# Rows times folds that keep a member busy for a second a level; bytes of a share a task may hold.
ROWS_PER_MEMBER, HELD_BYTES = 10_000_000, 1 << 29
FOLDS_AT_ONCE = 64
# Rows whose cells of a histogram are counted at once: they stay in the processor's cache.
PIECE_ROWS = 1 << 15

TREES_SCHEMA = T.StructType([
    T.StructField("fold", T.IntegerType()),
    T.StructField("feature", T.ArrayType(T.IntegerType())),
    T.StructField("bin", T.ArrayType(T.IntegerType())),
    T.StructField("leaf", T.ArrayType(T.DoubleType())),
])


@dataclass
class Boosted:
    """Trees of one model: per tree a heap of splits (row goes right above its cut) and its leaves."""

    names: list
    feature: np.ndarray
    cut: np.ndarray
    leaf: np.ndarray

    def margins(self, x: np.ndarray) -> np.ndarray:
        total, every = np.zeros(len(x)), np.arange(len(x))
        for feature, cut, leaf in zip(self.feature, self.cut, self.leaf):
            node = np.zeros(len(x), np.int64)
            for _ in range(DEPTH):
                node = 2 * node + 1 + (x[every, feature[node]] > cut[node])
            total += leaf[node - len(cut)]
        return total

    def probabilities(self, x: np.ndarray) -> np.ndarray:
        return 1.0 / (1.0 + np.exp(-self.margins(x)))


def class_counts(matrix: DataFrame) -> tuple[int, int]:
    row = matrix.agg(
        F.count_if(F.col("label") == 0).alias("legit"), F.count_if(F.col("label") == 1).alias("covert"),
        F.count(F.lit(1)).alias("rows"),
    ).first()
    if not row["rows"]:
        raise ValueError("no training rows: boosted trees need nonempty features and labels")
    if row["legit"] + row["covert"] != row["rows"]:
        raise ValueError(f"{row['rows'] - row['legit'] - row['covert']} training labels are not 0 (legit) or 1 (covert)")
    if not row["legit"] or not row["covert"]:
        raise ValueError(f"boosted trees learn from both classes, here are {row['legit']} legit and {row['covert']} covert rows")
    return row["legit"], row["covert"]


def quantile_cuts(matrix: DataFrame, bins: int = BINS) -> list:
    """Ascending cut points per feature, at most ``bins`` - 1, from one pass of mergeable sketches."""
    names = feature_names(matrix.columns)
    shares = F.array(*[F.lit(i / bins) for i in range(1, bins)])
    row = matrix.agg(*[
        F.struct(F.percentile_approx(n, shares, F.lit(20 * bins)).alias("cuts"), F.max(n).alias("most")).alias(n) for n in names]).first()
    # Nothing lies above a cut at the maximum.
    return [np.unique([c for c in row[n]["cuts"] or [] if c < row[n]["most"]]) for n in names]


def best_splits(histogram: np.ndarray):
    """Per fold and node: feature, bin, and the (gradient, weight) sums left and right of the best split.

    ``histogram`` is (folds, nodes, features, bins, 2). A node without a useful split has bin -1 and
    all its rows on the left.
    """
    folds, nodes, features, bins, _ = histogram.shape
    left = np.cumsum(histogram, axis=3)
    whole = left[:, :, :1, -1:]
    right = whole - left

    def value(sums):
        return sums[..., 0] ** 2 / (sums[..., 1] + LEAF_WEIGHT)

    gain = value(left) + value(right) - value(whole)
    gain[(left[..., 1] < LEAST_CHILD) | (right[..., 1] < LEAST_CHILD)] = -np.inf
    flat = gain.reshape(folds, nodes, -1)
    best = flat.argmax(axis=2)
    useful = np.take_along_axis(flat, best[..., None], 2)[..., 0] > LEAST_GAIN
    where = np.arange(folds)[:, None], np.arange(nodes)[None], best // bins, best % bins
    sums_left = np.where(useful[..., None], left[where], whole[:, :, 0, 0])
    return np.where(useful, best // bins, 0), np.where(useful, best % bins, -1), sums_left, whole[:, :, 0, 0] - sums_left


def grower(cuts: list, folds: int, covert_weights: np.ndarray, iterations: int):
    """A member's part of the training of all folds."""
    features, inner = len(cuts), 2**DEPTH - 1

    def grow(gang, batches):
        binned, sessions, labels = [], [], []
        for batch in batches:
            x = batch.column(2).flatten().to_numpy().reshape(batch.num_rows, features)
            binned.append(np.stack([np.searchsorted(c, x[:, j]) for j, c in enumerate(cuts)]).astype(np.uint8))
            sessions.append(batch.column(0).to_numpy().astype(np.int32))
            labels.append(batch.column(1).to_numpy().astype(np.int8))
        binned = np.concatenate(binned, axis=1) if binned else np.zeros((features, 0), np.uint8)
        session = np.concatenate(sessions) if sessions else np.zeros(0, np.int32)
        label = np.concatenate(labels) if labels else np.zeros(0, np.int8)
        rows = binned.shape[1]
        margin, node = np.zeros((folds, rows), np.float32), np.zeros((folds, rows), np.uint8)
        out = [([], [], []) for _ in range(folds)]
        for _ in range(iterations):
            node[:] = 0
            tree = np.zeros((folds, inner), np.int32), np.full((folds, inner), -1, np.int32)
            for depth in range(DEPTH):
                nodes = 2**depth
                histogram = np.zeros((folds, nodes, features, BINS, 2))
                for fold in range(folds):
                    for at in range(0, rows, PIECE_ROWS):
                        piece = slice(at, at + PIECE_ROWS)
                        covert = label[piece]
                        p = 1.0 / (1.0 + np.exp(-margin[fold, piece].astype(float)))
                        weight = np.where(covert == 1, covert_weights[fold], 1.0) * (session[piece] != fold)
                        parts = weight * (p - covert), weight * p * (1 - p)
                        base = node[fold, piece].astype(np.intp) * BINS
                        for j in range(features):
                            cells = base + binned[j, piece]
                            for k, part in enumerate(parts):
                                histogram[fold, :, j, :, k] += np.bincount(cells, part, nodes * BINS).reshape(nodes, BINS)
                feature, split, left, right = best_splits(gang.total(histogram))
                first = nodes - 1
                tree[0][:, first:first + nodes], tree[1][:, first:first + nodes] = feature, split
                for fold in range(folds):
                    for at in range(0, rows, PIECE_ROWS):
                        piece = slice(at, at + PIECE_ROWS)
                        here = node[fold, piece]
                        cut = split[fold][here]
                        above = (cut >= 0) & (binned[:, piece][feature[fold][here], np.arange(len(here))] > cut)
                        node[fold, piece] = 2 * here + above
            sums = np.stack([left, right], axis=2).reshape(folds, 2**DEPTH, 2)
            leaf = -STEP * sums[..., 0] / (sums[..., 1] + LEAF_WEIGHT)
            for fold in range(folds):
                margin[fold] += leaf[fold][node[fold]].astype(np.float32)
                for parts, new in zip(out[fold], (tree[0][fold], tree[1][fold], leaf[fold])):
                    parts.extend(new.tolist())
        if gang.leads:
            yield pa.RecordBatch.from_arrays(
                [pa.array(c, f.type) for c, f in zip([list(range(folds)), *map(list, zip(*out))], to_arrow_schema(TREES_SCHEMA))],
                schema=to_arrow_schema(TREES_SCHEMA))

    return grow


def train_boosted(
    matrix: DataFrame, weights: dict, rows: int, iterations: int = 100, members: int | None = None,
) -> dict:
    """{fold: Boosted} for every fold of ``weights``, trees of depth 3 with a step of 0.1.

    A fold trains on the rows of other sessions, ``EVERYTHING`` on all. ``weights`` holds what a covert
    row counts for, legit / covert of the fold's training rows. The number of jobs depends on how many
    folds' margins fit in memory beside the rows, one for up to FOLDS_AT_ONCE folds of ordinary size.
    """
    names = feature_names(matrix.columns)
    cuts = quantile_cuts(matrix)
    found, folds, start = {}, list(weights), 0
    numbers = 2 ** (DEPTH - 1) * len(names) * BINS * 2
    while start < len(folds):
        left = min(FOLDS_AT_ONCE, len(folds) - start)
        size, folder = (members, None) if members else plan_gang(
            matrix.sparkSession, rows * left, DEPTH * iterations, left * numbers, ROWS_PER_MEMBER)
        # A row holds a byte a feature, and a margin and a node a fold.
        fit = (HELD_BYTES // max(1, -(-rows // size)) - len(names) - 5) // 5
        group = folds[start:start + max(1, min(left, fit))]
        data = matrix.select(
            (F.array_position(F.array(*map(F.lit, group)), F.col("source_file")) - 1).cast("int").alias("_session"),
            F.col("label").cast("int").alias("_label"), F.array(*names).cast("array<double>").alias("_x"),
            F.xxhash64("source_file", "flow_id").alias("_order"))
        trees = run_gang(
            data, size, "_order", ["_order"], grower(cuts, len(group), np.array([weights[f] for f in group], float), iterations),
            TREES_SCHEMA, folder)
        for row in trees:
            feature, split = (np.array(row[n], np.int32).reshape(iterations, -1) for n in ("feature", "bin"))
            cut = np.full(feature.shape, np.inf)
            for j, points in enumerate(cuts):
                mine = (feature == j) & (split >= 0)
                cut[mine] = points[split[mine]]
            found[group[row["fold"]]] = Boosted(names, feature, cut, np.array(row["leaf"]).reshape(iterations, -1))
        start += len(group)
    return found


def train_supervised(matrix: DataFrame, iterations: int = 100) -> Boosted:
    """One model on all rows, covert rows weighted by legit / covert."""
    legit, covert = class_counts(matrix)
    return train_boosted(matrix, {EVERYTHING: legit / covert}, legit + covert, iterations)[EVERYTHING]


def score_held_out(models: dict, matrix: DataFrame) -> DataFrame:
    """Keys plus ``score``, the probability of the covert class, of every row whose session has a model.

    A row is scored once, by the model that has not seen its session; a model of EVERYTHING scores all.
    """
    names = feature_names(matrix.columns)
    keys = [c for c in matrix.columns if c not in names]
    shared = matrix.sparkSession.sparkContext.broadcast(models)
    schema = T.StructType([*[matrix.schema[k] for k in keys], T.StructField("score", T.DoubleType())])
    arrow = to_arrow_schema(schema)

    def score(batches):
        for batch in batches:
            x = np.stack([batch.column(n).to_numpy(zero_copy_only=False) for n in names], axis=1)
            session = np.array(batch.column("source_file").to_pylist(), object)
            out, known = np.zeros(len(x)), np.zeros(len(x), bool)
            for fold, model in shared.value.items():
                rows = np.ones(len(x), bool) if fold == EVERYTHING else session == fold
                if rows.any():
                    out[rows], known[rows] = model.probabilities(x[rows]), True
            columns = [*[batch.column(k) for k in keys], pa.array(out)]
            yield pa.RecordBatch.from_arrays(columns, schema=arrow).filter(pa.array(known))

    return matrix.mapInArrow(score, schema)


def score_supervised(model: Boosted, matrix: DataFrame) -> DataFrame:
    """Keys plus ``score`` of all rows."""
    return score_held_out({EVERYTHING: model}, matrix)
