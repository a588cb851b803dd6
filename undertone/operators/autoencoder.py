"""Reconstruction autoencoder, trained by mini-batch Adam on gradients summed over a gang of tasks.

A step's mini-batch is the rows a hash deals to it, wherever they lie. Every member of the gang adds up
the gradients of its own rows, the sums meet in an all-reduce, and all members take the same
step of Adam, for all folds together. The number of members changes who adds, not what is added.
"""

import logging
import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F, types as T
from pyspark.sql.pandas.types import to_arrow_schema

from undertone.operators.gang import plan_gang, run_gang
from undertone.operators.prepare import feature_names
from undertone.session import durable

logger = logging.getLogger("undertone.autoencoder")

HIDDEN = (16, 8, 16)
# Rows times folds that keep a member of the gang busy for a second: its shard of a mini-batch.
ROWS_PER_SHARD = 500_000
# Rows of one matrix product, whose layers stay in the processor's cache; steps of an epoch at most; bytes of a share
# that a task may hold.
PIECE_ROWS, MOST_STEPS, HELD_BYTES = 1024, 64, 1 << 28

# Arrays of the last gradient, by layer: one piece of rows at most.
_MEMORY: dict = {}

# Weights and what Adam carries from step to step, per fold.
STATE_SCHEMA = T.StructType([
    T.StructField("fold", T.IntegerType()),
    *[T.StructField(n, T.ArrayType(T.DoubleType())) for n in ("weights", "m", "v")],
    T.StructField("moved", T.DoubleType()),
])


def layer_shapes(inputs: int):
    widths = (inputs, *HIDDEN, inputs)
    return list(zip(widths[:-1], widths[1:]))


def initial_weights(inputs: int, seed: int) -> np.ndarray:
    """One flat vector: per layer a matrix and a bias, uniform within 1/sqrt(inputs of the layer)."""
    rng = np.random.default_rng(seed)
    parts = []
    for rows, columns in layer_shapes(inputs):
        bound = 1.0 / math.sqrt(rows)
        parts += [rng.uniform(-bound, bound, rows * columns), rng.uniform(-bound, bound, columns)]
    return np.concatenate(parts)


def layers(flat: np.ndarray, inputs: int) -> list:
    """Per fold, views of its weight matrices and biases in the flat (folds, size) array."""
    out = [[] for _ in flat]
    at = 0
    for rows, columns in layer_shapes(inputs):
        middle, end = at + rows * columns, at + (rows + 1) * columns
        for stack, weights in zip(out, flat):
            stack.append((weights[at:middle].reshape(rows, columns), weights[middle:end]))
        at = end
    return out


def activations(stack, x: np.ndarray) -> list:
    """Activations of each layer of one fold for its rows; linear at the end."""
    values = [x]
    for index, (matrix, bias) in enumerate(stack):
        z = values[-1] @ matrix
        z += bias
        values.append(np.maximum(z, 0.0, out=z) if index < len(stack) - 1 else z)
    return values


def gradient_sum(flat: np.ndarray, x: np.ndarray, used: np.ndarray) -> np.ndarray:
    """Gradients of the rows' mean squared errors, summed over the rows each fold may use.

    Folds take turns: what one fold's layers need of a piece of rows stays in the processor's cache.
    """
    return np.stack([one_gradient(*fold) for fold in zip(layers(flat, x.shape[2]), x, used)])


def one_gradient(stack, x: np.ndarray, used: np.ndarray) -> np.ndarray:
    """One fold's sum. Arrays lie feature by feature and are kept at hand, so all but products run along memory."""
    rows, inputs = x.shape
    values = [at_hand("value", 0, inputs, rows)]
    np.copyto(values[0], x.T)
    for index, (matrix, bias) in enumerate(stack, 1):
        z = np.matmul(matrix.T, values[-1], out=at_hand("value", index, len(bias), rows))
        z += bias[:, None]
        values.append(np.maximum(z, 0.0, out=z) if index < len(stack) else z)
    delta, parts, ones = values[-1], [], np.ones(rows)
    delta -= values[0]
    delta *= used * (2.0 / inputs)
    for index in range(len(stack) - 1, -1, -1):
        parts += [delta @ ones, (values[index] @ delta.T).ravel()]
        if index:
            width = len(values[index])
            delta = np.matmul(stack[index][0], delta, out=at_hand("delta", index, width, rows))
            delta *= np.greater(values[index], 0.0, out=at_hand("positive", index, width, rows, bool))
    return np.concatenate(parts[::-1])


def at_hand(name: str, index: int, width: int, rows: int, kind=float) -> np.ndarray:
    """An array whose memory the next call for the same name and index uses again."""
    memory = _MEMORY.get((name, index))
    if memory is None or memory.size < width * rows:
        memory = _MEMORY[name, index] = np.empty(width * rows, kind)
    return memory[:width * rows].reshape(width, rows)


def adam(state, g, moving, lr):
    """One step of Adam, in place; folds that are not moving keep weights and moments."""
    flat, m, v, steps = state
    steps += moving
    m[:] = np.where(moving, 0.9 * m + 0.1 * g, m)
    v[:] = np.where(moving, 0.999 * v + 0.001 * g * g, v)
    t = np.maximum(steps, 1.0)
    flat -= np.where(moving, lr * (m / (1 - 0.9**t)) / (np.sqrt(v / (1 - 0.999**t)) + 1e-8), 0.0)


def by_step(batches, steps: int, inputs: int):
    """A share sorted by step, as one list of (rows, sessions) pieces per step; some lists are empty."""
    at, pieces = 0, []
    for batch in batches:
        step = batch.column(0).to_numpy()
        x = batch.column(2).flatten().to_numpy().reshape(len(step), inputs).astype(np.float32)
        session = batch.column(1).to_numpy()
        edges = [0, *(np.flatnonzero(np.diff(step)) + 1), len(step)]
        for left, right in zip(edges[:-1], edges[1:]):
            while right > left and at < step[left]:
                yield pieces
                at, pieces = at + 1, []
            for start in range(left, right, PIECE_ROWS):
                stop = min(right, start + PIECE_ROWS)
                pieces.append((x[start:stop], session[start:stop]))
    while at < steps:
        yield pieces
        at, pieces = at + 1, []


def trainer(state, mean, scale, steps, epochs, lr):
    """A member's part of ``epochs`` epochs that start from ``state``."""
    folds, inputs = mean.shape

    def train(gang, batches):
        now = [x.copy() for x in state]
        share = by_step(batches, steps, inputs)
        # A share read once need not be held.
        share = share if epochs == 1 else list(share)
        for _ in range(epochs):
            for pieces in share:
                # Per fold: the summed gradient, and the rows it sums.
                sums = np.zeros((folds, now[0].shape[1] + 1))
                for x, session in pieces:
                    for fold in range(folds):
                        one, used = slice(fold, fold + 1), (session != fold).astype(float)
                        sums[one, :-1] += gradient_sum(now[0][one], ((x - mean[fold]) / scale[fold])[None], used[None])
                        sums[fold, -1] += used.sum()
                sums = gang.total(sums)
                rows = sums[:, -1:]
                adam(now, sums[:, :-1] / np.maximum(rows, 1.0), rows > 0, lr)
        if gang.leads:
            yield pa.RecordBatch.from_pydict({
                "fold": np.arange(folds, dtype=np.int32), **{n: list(x) for n, x in zip(("weights", "m", "v"), now)},
                "moved": now[3][:, 0]}, to_arrow_schema(STATE_SCHEMA))

    return train


def epoch_steps(rows: int, batch_size: int) -> int:
    """Steps of an epoch: batches of ``batch_size`` rows on average, or larger ones so that MOST_STEPS do."""
    return max(1, min(MOST_STEPS, -(-rows // batch_size)))


def train_autoencoders(
    matrix: DataFrame, rows: int, folds, mean, scale,
    epochs: int = 100, lr: float = 1e-3, batch_size: int = 32, seed: int = 42, members: int | None = None,
) -> np.ndarray:
    """Weights of shape (folds, size), one autoencoder per fold. Labels are not read.

    ``folds`` names the session each model must not see ("" for none); ``mean`` and ``scale``
    are (folds, features) arrays of the fold scalers. A hash deals every row to a step of the
    epoch; a step is one mini-batch, whoever holds its rows. ``members`` sets the size of the gang.
    """
    if rows < 1:
        raise ValueError("training needs at least one flow")
    if batch_size > rows:
        logger.warning("batch_size %d exceeds %d flows; clamping to %d", batch_size, rows, rows)
        batch_size = rows
    names = feature_names(matrix.columns)
    mean, scale = np.asarray(mean, float), np.asarray(scale, float)
    flat = np.tile(initial_weights(len(names), seed), (len(folds), 1))
    state = [flat, np.zeros_like(flat), np.zeros_like(flat), np.zeros((len(folds), 1))]
    steps = epoch_steps(rows, batch_size)
    members, folder = (members, None) if members else plan_gang(
        matrix.sparkSession, rows * len(folds) // steps, steps * epochs, flat.size + len(folds), ROWS_PER_SHARD)
    order = F.xxhash64("source_file", "flow_id", F.lit(seed))
    data = matrix.select(
        F.pmod(order, F.lit(steps)).cast("int").alias("_step"),
        (F.array_position(F.array(*map(F.lit, folds)), F.col("source_file")) - 1).cast("int").alias("_session"),
        F.array(*names).cast("array<double>").alias("_x"), order.alias("_order"))
    # A share that fits in memory is read once for all epochs, a larger one once an epoch, as a stream.
    share_bytes = 4 * (len(names) + 1) * -(-rows // members)
    at_once = epochs if share_bytes <= HELD_BYTES else 1
    if at_once < epochs:
        data = durable(data, "training-rows")
    for _ in range(0, epochs, at_once):
        # folds x a few thousand numbers, whatever the data size
        trained = run_gang(
            data, members, "_order", ["_step", "_order"], trainer(state, mean, scale, steps, at_once, lr), STATE_SCHEMA, folder)
        trained.sort(key=lambda r: r["fold"])
        state = [np.array([r[n] for r in trained]) for n in ("weights", "m", "v")]
        state.append(np.array([[r["moved"]] for r in trained]))
    return state[0]


def reconstruction_error(flat: np.ndarray, x: np.ndarray) -> np.ndarray:
    """Mean squared error per row of one model's standardized rows."""
    return ((activations(layers(flat[None], x.shape[1])[0], x)[-1] - x) ** 2).mean(axis=1)
