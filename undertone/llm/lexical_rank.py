"""Ranked lexical search of items over documents by dense blocked matrix multiplication.

Items come in tiles with a compact vocabulary: only the terms of the tile's items. A task turns its
documents, a block at a time, into a dense tile of term impacts over that vocabulary and multiplies it
with the tile's term weights in float64 (BLAS). Impacts and weights are whole numbers; a tile's
vocabulary is cut so that no partial sum can reach 2^53, which makes every product exact, and the
parts are added as 64-bit integers. Each tile keeps the k best documents an item, ties and all: a
score equal to the k-th best still counts until the smaller doc_id has won.

Documents are read once per vocabulary block. Their counts of that block's terms are stored, narrow,
so that document frequencies, which the weights need, come before the scores.
"""

from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window, functions as F

from undertone.llm.common import map_batches, to_arrow
from undertone.session import durable

# Terms of the items that one reading of the documents looks for. Only these go to the tasks.
BLOCK_TERMS = 1 << 17
TILE_ITEMS, TILE_ROWS, TILE_TERMS = 32, 1024, 4096
# No impact reaches this: (1000000000 * tf) div (1000 * tf + 8 * m) with m of 1 or more.
IMPACT, EXACT = 1_000_000, 1 << 53
# Terms are runs of these bytes: letters and digits, and all of UTF-8 beyond ASCII. A-Z read as a-z.
TERM_BYTES = bytes(
    b + 32 if 65 <= b <= 90 else b if b >= 128 or 48 <= b <= 57 or 97 <= b <= 122 else 32 for b in range(256))
COUNTS = "doc_id bigint, n_terms bigint, places binary, counts binary"
HITS = "item_number int, doc_id bigint, score bigint"


def terms(text: str) -> list:
    return text.encode().translate(TERM_BYTES).split()


def item_terms(items: DataFrame) -> DataFrame:
    """item_id, term and its occurrences; rows of one item_id are one item."""
    def count(batch):
        ids, found, times = [], [], []
        for item, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
            bag = Counter(terms(text))
            ids += [item] * len(bag)
            found += bag.keys()
            times += bag.values()
        yield {"item_id": ids, "term": found, "times": times}

    rows = items.select(F.col("item_id").cast("bigint"), F.coalesce("text", F.lit("")).alias("text"))
    return map_batches(rows, count, "item_id bigint, term binary, times bigint").groupBy("item_id", "term").agg(
        F.sum("times").alias("times"))


class Vocabulary:
    """Items of one block and the numbers of their terms."""

    def __init__(self, rows):
        """``rows``: (item_id, term, times), each term of an item once."""
        rows = [(item, bytes(term), times) for item, term, times in rows]
        names = sorted({term for _, term, _ in rows})
        self.numbers = {name: k for k, name in enumerate(names)}
        self.ids = sorted({item for item, _, _ in rows}, key=lambda item: (item is None, item or 0))
        number = {item: k for k, item in enumerate(self.ids)}
        self.entries = np.array(
            [(number[item], self.numbers[term], times) for item, term, times in rows], np.int64).reshape(-1, 3)


def counted(docs: DataFrame, numbers: dict) -> DataFrame:
    """doc_id, n_terms, and the numbers and counts of the looked-for terms of every whole text."""
    look = numbers.get

    def count(batch):
        sizes, places, counts = [], [], []
        for text in batch.column(1).to_pylist():
            words = terms(text) if text else []
            found = np.array([n for n in map(look, words) if n is not None], np.int32)
            which, times = np.unique(found, return_counts=True)
            sizes.append(len(words))
            places.append(which.astype(np.int32).tobytes())
            counts.append(times.astype(np.int64).tobytes())
        yield {"doc_id": batch.column(0), "n_terms": sizes, "places": places, "counts": counts}

    return map_batches(docs, count, COUNTS)


def frequencies(counts: DataFrame, size: int) -> np.ndarray:
    """Documents that hold each term, in order of the terms' numbers."""
    def tally(batches):
        total = np.zeros(size, np.int64)
        for batch in batches:
            total += np.bincount(np.frombuffer(b"".join(batch.column(0).to_pylist()), np.int32), minlength=size)
        held = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(held), pa.array(total[held])], names=["place", "held"])

    rows = counts.select("places").mapInArrow(tally, "place bigint, held bigint")
    # One row per term of the block.
    found = rows.groupBy("place").agg(F.sum("held").alias("held")).toArrow()
    out = np.zeros(size, np.int64)
    out[found.column("place").to_numpy()] = found.column("held").to_numpy()
    return out


def weighted(entries: np.ndarray, held: np.ndarray, documents: int) -> np.ndarray:
    """Per entry the term's weight times its occurrences in the item."""
    weight = np.floor(1000 * np.log((2 * documents + 2) / (2 * held + 1).astype(float))).astype(np.int64)
    return weight[entries[:, 1]] * entries[:, 2]


def item_tiles(entries: np.ndarray, weights: np.ndarray, items: int) -> list:
    """Per tile: its first item, its number of items, and parts (terms, dense weights).

    The weights of a part sum to less than 2^53 over IMPACT for each item, so no product is inexact.
    A weight too large for that is split over several parts.
    """
    tiles, limit = [], (EXACT - 1) // IMPACT
    order = np.lexsort((entries[:, 1], entries[:, 0]))
    entries, weights = entries[order], weights[order]
    for first in range(0, items, TILE_ITEMS):
        size = min(TILE_ITEMS, items - first)
        at, to = np.searchsorted(entries[:, 0], [first, first + size])
        rest, parts = weights[at:to].copy(), []
        where = entries[at:to]
        while len(rest):
            # As many terms, in order, as fit the limit for every item of the tile.
            now = np.minimum(rest, limit)
            names = np.unique(where[:, 1])
            column = np.searchsorted(names, where[:, 1])
            most = np.zeros(len(names))
            np.maximum.at(most, column, now.astype(float))
            fits = min(TILE_TERMS, max(1, int(np.searchsorted(np.cumsum(most), limit, side="right"))))
            taken = column < fits
            dense = np.zeros((fits, size))
            dense[column[taken], where[taken, 0] - first] = now[taken]
            parts.append((names[:fits], dense))
            rest = np.where(taken, rest - now, rest)
            left = rest > 0
            rest, where = rest[left], where[left]
        tiles.append((first, size, parts))
    return tiles


def best_of(items, scores, ids, k):
    """Places of the k best rows of every item: highest score, then smallest id; masked ids come last."""
    order = np.lexsort((ids.filled(0), np.ma.getmaskarray(ids), -scores, items))
    sorted_items = items[order]
    starts = np.flatnonzero(np.concatenate([[True], sorted_items[1:] != sorted_items[:-1]])) if len(order) else np.zeros(0, int)
    rank = np.arange(len(order)) - np.repeat(starts, np.diff(np.append(starts, len(order))))
    return order[rank < k], rank[rank < k]


class Best:
    """The k best documents so far of every item, and the score the next one has to reach."""

    def __init__(self, items, k):
        self.k, self.floor = k, np.ones(items, np.int64)
        self.rows = np.zeros(0, np.int64), np.zeros(0, np.int64), np.ma.zeros(0, np.int64)

    def add(self, first, scores, ids):
        """Scores of documents (rows) for the items from ``first`` on (columns)."""
        floor = self.floor[first:first + scores.shape[1]]
        if len(scores) > self.k:
            # The k-th best of this tile alone is a bound too; equal scores stay in.
            np.maximum(floor, np.partition(scores, -self.k, axis=0)[-self.k], out=floor)
        row, item = np.nonzero(scores >= floor)
        if not len(row):
            return
        rows = item + first, scores[row, item], ids[row]
        merged = [np.ma.concatenate(pair) if k == 2 else np.concatenate(pair) for k, pair in enumerate(zip(self.rows, rows))]
        kept, rank = best_of(*merged, self.k)
        self.rows = tuple(x[kept] for x in merged)
        full = rank == self.k - 1
        self.floor[self.rows[0][full]] = np.maximum(self.floor[self.rows[0][full]], self.rows[1][full])


def lengths_factor(n_terms: np.ndarray, documents: int, total: int) -> np.ndarray:
    """m of documents of ``n_terms`` terms: 25 + (75 * n * documents) div total, exact at any size."""
    if 75 * int(n_terms.max(initial=0)) * documents < 1 << 62:
        return 25 + (75 * documents * n_terms) // max(1, total)
    return np.array([25 + 75 * int(n) * documents // total for n in n_terms], np.int64)


def scored(counts: DataFrame, tiles: list, terms_in_block: int, items: int, documents: int, total: int, k: int) -> DataFrame:
    """The k best documents an item of every partition of ``counts``: item_number, doc_id and score."""
    schema = to_arrow(HITS)

    def run(batches):
        best, place = Best(items, k), np.full(terms_in_block, -1, np.int32)
        for batch in batches:
            for at in range(0, batch.num_rows, TILE_ROWS):
                part = batch.slice(at, TILE_ROWS)
                cells = part.column(2).to_pylist()
                which = np.frombuffer(b"".join(cells), np.int32)
                times = np.frombuffer(b"".join(part.column(3).to_pylist()), np.int64)
                row = np.repeat(np.arange(len(cells)), [len(c) // 4 for c in cells])
                m = lengths_factor(part.column(1).to_numpy(), documents, total)
                impact = (1_000_000_000 * times) // (1000 * times + 8 * m[row])
                mask = part.column(0).is_null().to_numpy(zero_copy_only=False)
                ids = np.ma.array(part.column(0).fill_null(0).to_numpy(), mask=mask)
                for first, size, parts in tiles:
                    scores = np.zeros((len(cells), size), np.int64)
                    for names, weights in parts:
                        place[names] = np.arange(len(names))
                        column = place[which]
                        held = column >= 0
                        # Only documents with a term of this part have a row in the dense tile.
                        rows, dense_row = np.unique(row[held], return_inverse=True)
                        dense = np.zeros((len(rows), len(names)))
                        dense[dense_row, column[held]] = impact[held]
                        scores[rows] += (dense @ weights).astype(np.int64)
                        place[names] = -1
                    best.add(first, scores, ids)
        items_found, scores, ids = best.rows
        yield pa.RecordBatch.from_arrays([
            pa.array(items_found.astype(np.int32)), pa.array(ids.filled(0), mask=np.ma.getmaskarray(ids)), pa.array(scores)],
            schema=schema)

    return counts.mapInArrow(run, HITS)


def rank_documents(docs: DataFrame, items: DataFrame, k: int = 10) -> DataFrame:
    """The k highest-scoring documents of every item: item_id, rank (from 1), doc_id and score.

    Scores above 0 only; equal ones by ascending doc_id, null last. Null and empty texts have no terms:
    such documents count for nothing, such items find nothing. Rows that repeat an item_id are
    one item, null being one too; every row of ``docs`` is a document, also a repeated one, which
    counts and may be found as often as it stands there. Other columns are not read. Without
    documents or items the result is empty.

    Items are dealt into blocks by hash so that a block has about BLOCK_TERMS terms; an item is
    never split. What tasks receive, and what the driver holds, is one block's terms and weights.
    """
    spark = docs.sparkSession
    asked = durable(item_terms(items), "item-terms")
    blocks = max(1, -(-asked.count() // BLOCK_TERMS))
    texts = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"))
    found = None
    for block in range(blocks):
        rows = asked.filter(F.pmod(F.xxhash64("item_id"), F.lit(blocks)) == block).collect()
        vocabulary = Vocabulary(rows)
        size, names = len(vocabulary.numbers), vocabulary.ids
        counts = durable(counted(texts, vocabulary.numbers), "term-counts")
        sums = counts.agg(F.count_if(F.col("n_terms") > 0).alias("documents"), F.sum("n_terms").alias("total")).first()
        documents, total = sums["documents"], sums["total"] or 0
        weights = weighted(vocabulary.entries, frequencies(counts, size), documents)
        tiles = item_tiles(vocabulary.entries, weights, len(names))
        hits = scored(counts, tiles, size, len(names), documents, total, k)
        named = spark.createDataFrame(list(enumerate(names)), "item_number int, item_id bigint")
        # The few best of each partition; names by their known small size.
        hits = durable(hits, "item-hits").join(named, "item_number").select("item_id", "doc_id", "score")
        found = hits if found is None else found.unionByName(hits)
    rank = F.row_number().over(Window.partitionBy("item_id").orderBy(F.desc("score"), F.col("doc_id").asc_nulls_last()))
    return found.withColumn("rank", rank).filter(F.col("rank") <= k).select("item_id", "rank", "doc_id", "score")
