"""Isolation forest: exact samples from mergeable sketches, one small task per tree, vectorised scoring."""

import zlib
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, functions as F, types as T
from pyspark.sql.pandas.types import to_arrow_schema

from undertone.operators.prepare import feature_names

SUBSAMPLE = 256
TREES = 200
# Rows a sketch takes in at once until it knows which are too high; groups of sketches that merge before the last merge.
SKETCH_ROWS, FAN = 4096, 64
# Rows that walk down the trees together: few enough to stay near the processor, many enough for calls of numpy to pay.
SCORE_ROWS = 16384
# Levels of a tree whose nodes all rows are tested at.
TOP_LEVELS = 4
EVERYTHING = ""  # fold name for a model trained on all rows

TREE_SCHEMA = T.StructType([
    T.StructField("fold", T.StringType()),
    T.StructField("tree", T.IntegerType()),
    T.StructField("feature", T.ArrayType(T.IntegerType())),
    T.StructField("cut", T.ArrayType(T.DoubleType())),
    T.StructField("path", T.ArrayType(T.DoubleType())),
    T.StructField("sample_rows", T.IntegerType()),
])
SKETCH_SCHEMA = T.StructType([
    T.StructField("tree", T.IntegerType()),
    T.StructField("group", T.IntegerType()),
    T.StructField("priority", T.BinaryType()),
    T.StructField("session", T.BinaryType()),
    T.StructField("x", T.BinaryType()),
])


def average_path(n) -> float:
    """Mean depth of an unsuccessful search in a binary search tree of n keys."""
    if n <= 1:
        return 0.0
    if n == 2:
        return 1.0
    return 2.0 * (np.log(n - 1.0) + np.euler_gamma) - 2.0 * (n - 1.0) / n


def depth_limit(n) -> int:
    return int(np.ceil(np.log2(max(n, 2))))


def mixed(values: np.ndarray) -> np.ndarray:
    """64-bit numbers spread evenly (the finalizer of splitmix64)."""
    values = values ^ (values >> np.uint64(30))
    values *= np.uint64(0xBF58476D1CE4E5B9)
    values ^= values >> np.uint64(27)
    values *= np.uint64(0x94D049BB133111EB)
    values ^= values >> np.uint64(31)
    return values


def priorities(keys: np.ndarray, tree: int, seed: int) -> np.ndarray:
    """A number per row and tree; the rows of the lowest numbers are the tree's sample."""
    salt = mixed(np.array([(seed << 20) + tree + 1], np.uint64))
    return mixed(keys ^ salt)


class Sample:
    """A mergeable sketch: of the rows seen, those that some fold's bottom ``size`` may hold.

    A fold's bottom leaves out its own session, so it is not the bottom of all rows. A row stays while
    for at least one fold fewer than ``size`` lower rows are open to that fold; however large one
    session is, that is at most about twice ``size`` rows.
    """

    def __init__(self, folds: int, width: int, size: int):
        self.folds, self.size = np.arange(folds), size
        self.limit = None
        self.priority, self.session = np.zeros(0, np.uint64), np.zeros(0, np.int32)
        self.x = np.zeros((0, width))

    def add(self, priority, session, x):
        """Take in rows; ``session`` is the number of the fold that must not see the row, or -1."""
        if self.limit is not None:
            low = np.flatnonzero(priority <= self.limit)
            if not len(low):
                return
            priority, session, x = priority[low], session[low], x[low]
        priority = np.concatenate([self.priority, priority])
        session, x = np.concatenate([self.session, session]), np.concatenate([self.x, x])
        order = np.argsort(priority, kind="stable")
        if (np.diff(priority[order]) == 0).any():
            # Rows of one key are told apart by what they hold, not by the order they came in.
            order = np.lexsort((*x.T[::-1], priority))
        open_to = session[order][:, None] != self.folds
        before = np.cumsum(open_to, axis=0) - open_to
        needed = (open_to & (before < self.size)).any(axis=1)
        order = order[needed]
        self.priority, self.session, self.x = priority[order], session[order], x[order]
        full = open_to.sum(axis=0) >= self.size
        self.limit = self.priority[-1] if full.all() else None

    def bottom(self, fold: int) -> np.ndarray:
        return self.x[self.session != fold][:self.size]

    def packed(self):
        return self.priority.tobytes(), self.session.tobytes(), self.x.tobytes()


def sketch_rows(folds: int, width: int, trees: int, seed: int):
    """A task's sketch per tree: one pass over its rows, in bounded memory."""
    schema = to_arrow_schema(SKETCH_SCHEMA)

    def sketch(batches):
        samples = [Sample(folds, width, SUBSAMPLE) for _ in range(trees)]
        for batch in batches:
            start = 0
            while start < batch.num_rows:
                known = all(sample.limit is not None for sample in samples)
                part = batch.slice(start, batch.num_rows if known else SKETCH_ROWS)
                start += part.num_rows
                keys = part.column(0).to_numpy().view(np.uint64)
                session = part.column(1).to_numpy().astype(np.int32)
                x = part.column(2).flatten().to_numpy().reshape(part.num_rows, width)
                for tree, sample in enumerate(samples):
                    sample.add(priorities(keys, tree, seed), session, x)
        group = TaskContext.get().partitionId() % FAN
        rows = [(tree, group, *sample.packed()) for tree, sample in enumerate(samples) if len(sample.x)]
        yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows) if rows else [()] * 5, schema)], schema=schema)

    return sketch


def merged(table: pa.Table, folds: int, width: int) -> Sample:
    """One sketch from the sketches in ``table``."""
    sample = Sample(folds, width, SUBSAMPLE)
    for priority, session, x in zip(*(table.column(n).to_pylist() for n in ("priority", "session", "x"))):
        sample.add(np.frombuffer(priority, np.uint64), np.frombuffer(session, np.int32), np.frombuffer(x).reshape(-1, width))
    return sample


def tree_samples(matrix: DataFrame, folds: list, trees: int, seed: int) -> DataFrame:
    """One sketch per tree over all rows: exact bottom-k samples of every fold, whatever the data size.

    Tasks send sketches, not rows. They merge in two levels, so no task meets them all at once.
    """
    names = feature_names(matrix.columns)
    width = len(names)
    rows = matrix.select(
        F.xxhash64("source_file", "flow_id", F.lit(seed)).alias("key"),
        (F.array_position(F.array(*map(F.lit, folds)), F.col("source_file")) - 1).cast("int").alias("session"),
        F.array(*names).cast("array<double>").alias("x"))
    sketches = rows.mapInArrow(sketch_rows(len(folds), width, trees, seed), SKETCH_SCHEMA)

    def merge(table):
        sample = merged(table, len(folds), width)
        return pa.Table.from_arrays([pa.array([v], f.type) for v, f in zip(
            (table.column("tree")[0].as_py(), table.column("group")[0].as_py(), *sample.packed()), to_arrow_schema(SKETCH_SCHEMA))],
            schema=to_arrow_schema(SKETCH_SCHEMA))

    return sketches.groupBy("tree", "group").applyInArrow(merge, SKETCH_SCHEMA)


def grow_tree(rows: np.ndarray, rng) -> tuple:
    """One isolation tree as a complete binary heap: feature, cut and, per leaf slot, path length."""
    limit = depth_limit(len(rows))
    inner = 2**limit - 1
    feature, cut = np.zeros(inner, dtype=np.int32), np.full(inner, np.inf)
    path = np.zeros(2**limit)
    stack = [(0, 0, np.arange(len(rows)))]
    while stack:
        node, depth, members = stack.pop()
        block = rows[members]
        low, high = block.min(axis=0), block.max(axis=0)
        varied = np.flatnonzero(high > low)
        if depth == limit or len(members) <= 1 or not len(varied):
            width = 2 ** (limit - depth)
            first = (node + 1) * width - 2**limit
            path[first:first + width] = depth + average_path(len(members))
            continue
        chosen = rng.choice(varied)
        threshold = rng.uniform(low[chosen], high[chosen])
        if threshold >= high[chosen]:
            threshold = low[chosen]
        feature[node], cut[node] = chosen, threshold
        right = block[:, chosen] > threshold
        stack.append((2 * node + 1, depth + 1, members[~right]))
        stack.append((2 * node + 2, depth + 1, members[right]))
    return feature, cut, path


def tree_builder(folds: list, width: int, seed: int):
    """Grow one tree of every fold from the tree's sketches."""
    schema = to_arrow_schema(TREE_SCHEMA)

    def build(table: pa.Table) -> pa.Table:
        tree = table.column("tree")[0].as_py()
        sample, grown = merged(table, len(folds), width), []
        for number, fold in enumerate(folds):
            rows = sample.bottom(number)
            if not len(rows):
                continue
            rng = np.random.default_rng([seed, tree, zlib.crc32(fold.encode())])
            feature, cut, path = grow_tree(rows, rng)
            grown.append((fold, tree, feature.tolist(), cut.tolist(), path.tolist(), len(rows)))
        return pa.Table.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*grown), schema)], schema=schema)

    return build


def train_isolation_forest(
    matrix: DataFrame, sizes: dict, n_estimators: int = TREES, seed: int = 42
) -> DataFrame:
    """Forest nodes for every fold at once. Labels are not read.

    ``sizes`` maps a fold to its training row count; a fold trains on the rows of the other
    sessions, and the fold ``EVERYTHING`` on all. Every row is as likely as any other to be one of
    a tree's 256, and each tree draws its own.
    """
    if not sizes or min(sizes.values()) < 1:
        raise ValueError("every forest needs at least one training row")
    folds, width = list(sizes), len(feature_names(matrix.columns))
    sketches = tree_samples(matrix, folds, n_estimators, seed)
    return sketches.groupBy("tree").applyInArrow(tree_builder(folds, width, seed), TREE_SCHEMA)


@dataclass
class Forest:
    """All trees of one model as arrays; about 1 MB for 200 trees."""

    feature: np.ndarray
    cut: np.ndarray
    path: np.ndarray
    sample_rows: int

    @classmethod
    def from_rows(cls, rows) -> "Forest":
        rows = sorted(rows, key=lambda r: r["tree"])
        return cls(
            np.array([r["feature"] for r in rows], dtype=np.int32),
            np.array([r["cut"] for r in rows], dtype=float),
            np.array([r["path"] for r in rows], dtype=float),
            rows[0]["sample_rows"],
        )

    def raw_scores(self, x: np.ndarray) -> np.ndarray:
        """2^(-mean path / expected path), in (0, 1]; higher is more anomalous."""
        pieces = [self.paths(piece) for piece in np.array_split(x, max(1, -(-len(x) // SCORE_ROWS)))]
        scale = average_path(self.sample_rows) or 1.0
        return np.exp2(-np.concatenate(pieces) / len(self.cut) / scale)

    def paths(self, x: np.ndarray) -> np.ndarray:
        """The rows' path lengths, summed over the trees."""
        depth = depth_limit(self.sample_rows)
        top = min(depth, TOP_LEVELS)
        columns = np.ascontiguousarray(x.T)
        values, first = columns.ravel(), np.arange(len(x))
        total = np.zeros(len(x))
        node, cell = np.empty((2, len(x)), dtype=np.intp)
        value, edge = np.empty((2, len(x)))
        right = np.empty(len(x), dtype=bool)
        tests = np.empty((2 ** top - 1, len(x)), dtype=bool)
        cells = self.feature.astype(np.intp) * len(x)
        # No index is out of range; "clip" lets numpy write to the arrays at hand.
        for feature, column, cut, path in zip(self.feature, cells, self.cut, self.path):
            for number, test in enumerate(tests):
                np.greater(columns[feature[number]], cut[number], out=test)
            node[:] = top_nodes(tests, top)
            for _ in range(depth - top):
                column.take(node, out=cell, mode="clip")
                cell += first
                values.take(cell, out=value, mode="clip")
                cut.take(node, out=edge, mode="clip")
                np.greater(value, edge, out=right)
                node *= 2
                node += 1
                node += right
            node -= len(cut)
            total += path.take(node, out=value, mode="clip")
        return total


def top_nodes(tests: np.ndarray, levels: int) -> np.ndarray:
    """The node below ``levels`` levels that each row comes to; ``tests`` tells for all nodes above who goes right.

    Near the root, testing every row at all nodes of a level is quicker than fetching each row's own test.
    """
    taken, node = [], np.zeros(tests.shape[1], np.uint8)
    for level in range(levels):
        here = tests[2 ** level - 1:2 ** (level + 1) - 1]
        # Halve the choice by what was taken at the level above, then the one above that.
        for went_right in reversed(taken):
            here = here[::2] ^ ((here[::2] ^ here[1::2]) & went_right)
        taken.append(here[0])
        node += node
        node += here[0]
    return node.astype(np.intp) + (2 ** levels - 1)


def collect_forests(nodes: DataFrame, trees: int | None = None) -> dict:
    """{fold: Forest}; call it on a bounded number of folds (1 MB each). Checks ``trees``, if given."""
    by_fold: dict = {}
    for row in nodes.collect():
        by_fold.setdefault(row["fold"], []).append(row)
    for fold, rows in by_fold.items():
        found = {r["tree"] for r in rows}
        if len(found) != len(rows) or (trees is not None and len(rows) != trees):
            raise ValueError(f"the forest of fold '{fold}' has {len(found)} different trees in {len(rows)} rows, not {trees}")
    return {fold: Forest.from_rows(rows) for fold, rows in by_fold.items()}


def predict_labels(score):
    """1 for anomalous: a score above zero, as the offset puts the boundary there."""
    return F.when(score > 0, 1).otherwise(0)
