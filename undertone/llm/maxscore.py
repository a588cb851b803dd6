"""Exact top-k search by inner product with MaxScore.

A component of a vector is a posting of its dimension. Vectors are dealt into shards by hash, a
shard holds its postings dimension by dimension; queries come in blocks. Per query, the dimensions
are split by their score bounds: those with the smallest bounds, whose sum stays below the score of
the k-th best so far, are non-essential. Essential postings are added up for all vectors of a
stretch; the other dimensions are probed only for vectors that can still reach the k-th score, and
every stretch raises that score. Shards return k hits per query, and the hits merge.
"""

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window, functions as F

from undertone.llm.common import to_arrow
from undertone.session import durable

SHARD_ROWS, BLOCK_ROWS, STRETCH = 4096, 512, 512
PACKED = "_part int, _ids binary, _width int, _cells binary"
HITS = "query_id bigint, vec_id bigint, score bigint"


def weights(vectors: DataFrame, id_column="vec_id", vector_column="embedding", scale=64) -> DataFrame:
    """_id and _weights: floor(scale * x) per component; rows that take no part are left out.

    Those are rows without an id, and vectors that are null or hold null or non-finite components.
    """
    vector = F.col(vector_column).cast("array<double>")
    sound = F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf"))))
    return vectors.filter(F.col(id_column).isNotNull() & vector.isNotNull() & sound).select(
        F.col(id_column).cast("bigint").alias("_id"), F.transform(vector, lambda x: F.floor(x * scale).cast("bigint")).alias("_weights"))


def packed(rows: DataFrame, size: int, total: int) -> DataFrame:
    """Rows of about ``size`` vectors each, as matrices. Shorter vectors end in zeros: no postings."""
    schema = to_arrow(PACKED)
    parts = max(1, -(-total // size))

    def pack(table):
        ids, cells = table.column("_id").to_numpy(), table.column("_weights").to_pylist()
        width = max(map(len, cells), default=0)
        matrix = np.zeros((len(cells), width), np.int64)
        for i, row in enumerate(cells):
            matrix[i, :len(row)] = row
        return pa.Table.from_arrays([pa.array([v], f.type) for v, f in zip(
            (table.column("_part")[0].as_py(), ids.astype(np.int64).tobytes(), width, matrix.tobytes()), schema)], schema=schema)

    dealt = rows.withColumn("_part", F.pmod(F.xxhash64("_id"), F.lit(parts)).cast("int"))
    return dealt.groupBy("_part").applyInArrow(pack, PACKED)


def unpacked(ids, width, cells):
    ids = np.frombuffer(ids, np.int64)
    return ids, np.frombuffer(cells, np.int64).reshape(len(ids), width)


def best_rows(query, ids, scores, k):
    """Places of the k best ids of every query, an id counted once with its highest score."""
    order = np.lexsort((-scores, ids, query))
    q, i = query[order], ids[order]
    first = np.ones(len(order), bool)
    first[1:] = (q[1:] != q[:-1]) | (i[1:] != i[:-1])
    order = order[first]
    order = order[np.lexsort((ids[order], -scores[order], query[order]))]
    q = query[order]
    starts = np.flatnonzero(np.concatenate([[True], q[1:] != q[:-1]])) if len(q) else np.zeros(0, int)
    rank = np.arange(len(q)) - np.repeat(starts, np.diff(np.append(starts, len(q))))
    return order[rank < k], rank[rank < k]


def search(query_ids, queries, ids, vectors, k):
    """MaxScore of a block of queries over one shard: (query number, id, score) of the hits."""
    width = max(queries.shape[1], vectors.shape[1])
    queries = np.pad(queries, ((0, 0), (0, width - queries.shape[1])))
    vectors = np.pad(vectors, ((0, 0), (0, width - vectors.shape[1])))
    # Whole numbers are exact in doubles up to 2^53; larger ones are multiplied as integers.
    largest = float(np.abs(queries).max(initial=0)) * float(np.abs(vectors).max(initial=0)) * max(width, 1)
    kind = np.float64 if largest < 2.0 ** 53 else np.int64
    queries, vectors = queries.astype(kind), vectors.astype(kind)
    high, low = np.maximum(vectors.max(0, initial=0), 0), np.minimum(vectors.min(0, initial=0), 0)
    # Most that a dimension's postings can add to a query's score.
    bounds = np.maximum(queries * high, queries * low)
    by_bound = np.argsort(bounds, axis=1)
    sums = np.cumsum(np.take_along_axis(bounds, by_bound, 1), axis=1)
    rows = np.arange(len(queries))
    floor = np.full(len(queries), -np.inf)
    q = np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, kind)
    for at in range(0, len(ids), STRETCH):
        some, here = vectors[at:at + STRETCH], ids[at:at + STRETCH]
        spare = sums < floor[:, None]
        count = spare.sum(1)
        essential = np.ones_like(queries, bool)
        np.put_along_axis(essential, by_bound, ~spare, 1)
        rest = np.where(count > 0, sums[rows, np.maximum(count - 1, 0)], 0) if width else np.zeros(len(queries))
        partial = (queries * essential) @ some.T
        alive = (partial + rest[:, None] >= floor[:, None]) & (query_ids[:, None] != here[None, :])
        r, c = np.nonzero(alive)
        score = partial[r, c]
        probe = count[r] > 0
        score[probe] += np.einsum("ij,ij->i", (queries * ~essential)[r[probe]], some[c[probe]])
        good = score >= floor[r]
        merged = [np.concatenate([old, new]) for old, new in zip(q, (r[good], here[c[good]], score[good]))]
        kept, rank = best_rows(*merged, k)
        q = tuple(x[kept] for x in merged)
        full = rank == k - 1
        floor[q[0][full]] = q[2][full]
    return q


def top_k(vectors: DataFrame, every: int = 20, k: int = 20, **columns) -> DataFrame:
    """The k highest inner products of every vector whose id is divisible by ``every``, against all others.

    Returns query_id, rank (from 1), vec_id and score; ties go to the smaller vec_id. A query does
    not meet rows of its own id. Rows that repeat an id are one item whose score is its highest.
    Vectors of different lengths meet as if the shorter one ended in zeros. Fewer than k others
    give fewer hits; an empty table or one without queries gives an empty result.
    """
    rows = durable(weights(vectors, **columns), "vectors")
    total = rows.count()
    shards = durable(packed(rows, SHARD_ROWS, total), "vector-shards")
    asked = rows.filter(F.col("_id") % every == 0)
    blocks = packed(asked, BLOCK_ROWS, asked.count()).select(
        F.col("_part").alias("_block"), F.col("_ids").alias("_q_ids"), F.col("_width").alias("_q_width"), F.col("_cells").alias("_q_cells"))
    # Every block visits every shard: one row a visit, not one a pair of vectors.
    everywhere = F.explode(F.sequence(F.lit(0), F.lit(max(1, -(-total // SHARD_ROWS)) - 1))).alias("_part")
    visits = blocks.select("*", everywhere).join(shards, "_part")

    def visit(table):
        row = table.to_pylist()[0]
        query_ids, queries = unpacked(row["_q_ids"], row["_q_width"], row["_q_cells"])
        q, ids, scores = search(query_ids, queries, *unpacked(row["_ids"], row["_width"], row["_cells"]), k)
        return pa.table({"query_id": query_ids[q], "vec_id": ids, "score": scores.astype(np.int64)})

    # A visit is a group of one row, so a task holds one shard and one block at a time.
    found = visits.groupBy("_part", "_block").applyInArrow(visit, HITS)
    hits = found.groupBy("query_id", "vec_id").agg(F.max("score").alias("score"))
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id"))
    return hits.withColumn("rank", rank).filter(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
