"""Exact Jaccard components of word n-gram sets, with signature trees.

1. A document becomes the set of its n-grams, 64-bit hashes; equal sets are one node (a 128-bit
   key). In any one order of all n-grams, the first |x| - ceil(t |x|) + k members of two sets with
   similarity t or more have k members in common, or their whole overlap. The order is by rarity,
   then by hash, so that a passage of many documents comes last: a sketch of 2^20 counts over all
   documents gives every n-gram a level, the logarithm of its count. Counts that collide change the
   order, never the result. These prefix tokens are the buckets; tokens that one node alone holds
   fall away. Tasks combine what they meet in one batch before the shuffle, so a token of very many
   documents sends one row a batch.
   Pairs of texts that share a token or two by chance grow with the square of their number. So a
   node stays in a bucket only if it can share k tokens with another node: those of its buckets of
   three and more nodes, and those of the one bucket that a pair has for itself.
2. In every bucket one node is compared with the others: a star, not all pairs. Its links merge
   most copies, and the node, now compared with all, leaves the bucket. Further rounds do the same
   for components still apart, so small buckets are done with. Buckets of over a block have a star
   in every size class, and their nodes stay.
3. Nodes of a bucket that still belong to different components meet in signature trees. A leaf is
   a node with its size and a bitmap of its hashed n-grams; inner nodes hold the OR of their
   bitmaps, the size range and the largest number of n-grams lost to shared bits. If two sets have
   a bit in common for each shared n-gram but those lost, then
       overlap <= common bits + lost n-grams of either side,
   and a pair of tree nodes is left as soon as that, or the sizes, rule out the similarity. Pairs of
   leaves that remain are compared exactly, once for all the buckets of a batch that they meet in.
   Roots are blocks of bounded size, so a bucket of any size is many small pairs of trees.

Stars pass the same bound first. Links are checked on whole sets, made again from the texts of the
documents in question only.
"""

import math
from itertools import groupby

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window, functions as F

from undertone.llm.common import PIECE_BYTES, folded_words, map_batches, mixed, pieces, to_arrow
from undertone.llm.components import connected_components
from undertone.session import durable, release

CACHE = 50_000
BLOCK = 1024
FANOUT = 8
PACK_ROWS = 4096
PAIR_ROWS = 1 << 20
LEAST_BITS = 2048
STAR_ROUNDS = 3
COMMON = 8
COMMON_ROUNDS = 2
CELL_BITS = 20
CHUNK_BITS = 10
WHOLE = -1
DOC_ROW, FORWARD, LIVE = 0, 1, 2
PROFILE = "_kind tinyint, _id bigint, _text_key bigint, _set_key binary, _node bigint, _n bigint, _token bigint, _bits binary"
STEP = np.uint64(0x9E3779B97F4A7C15)
CHUNK_WORDS = 1 << 20


class WordHashes(dict):
    def __missing__(self, word):
        if len(self) > CACHE:
            self.clear()
        value = self[word] = xxhash.xxh64_intdigest(word)
        return value


def shingles(text: bytes, size: int, hashes: WordHashes) -> np.ndarray:
    """Sorted distinct hashes of the n-grams; a shorter text is one n-gram of its own length."""
    words = folded_words(text)
    if not words:
        return np.zeros(0, np.uint64)
    values = np.fromiter(map(hashes.__getitem__, words), np.uint64, len(words))
    size = min(size, len(words))
    count = len(words) - size + 1
    total = np.full(count, size, np.uint64)
    with np.errstate(over="ignore"):
        for i in range(size):
            total = total * STEP + values[i:i + count]
    return np.unique(mixed(total))


def common_tokens(n, percent: int):
    """Prefix tokens a set of n members shares with each similar one at least."""
    return min(COMMON, -(-percent * n // 100))


def prefix_length(n: int, percent: int) -> int:
    return n - -(-percent * n // 100) + common_tokens(n, percent)


def least_overlap(n, m, percent: int):
    """Smallest overlap of sets of n and m members with percent% similarity, as whole numbers."""
    return -(-(percent * (n + m)) // (100 + percent))


def node_of(set_key: bytes) -> int:
    """The number of a node while pairs are looked for: half of its set's key.

    Should two sets share a number, they are looked up and compared one by one in the end.
    """
    return int.from_bytes(set_key[:8], "little", signed=True)


def keyed(docs: DataFrame) -> DataFrame:
    return docs.select(F.col("doc_id").cast("bigint").alias("_id"), F.xxhash64("text").alias("_text_key"),
                       F.col("text").cast("binary").alias("_text"))


def cells_of(grams: np.ndarray) -> np.ndarray:
    return (grams >> np.uint64(64 - CELL_BITS)).astype(np.int64)


def rarity_levels(docs: DataFrame, size: int) -> np.ndarray:
    """A level per cell of n-grams: the bits of the number of documents counted there.

    A task counts its documents in one array and sends it in chunks; tasks that add chunks up hold
    one sum per chunk. The levels are 1 MB for any input.
    """
    hashes = WordHashes()
    chunk = 1 << CHUNK_BITS
    schema = "_chunk int, _counts binary"
    arrow = to_arrow(schema)

    def send(counts):
        parts = counts.reshape(-1, chunk)
        used = np.flatnonzero(parts.any(axis=1))
        return pa.RecordBatch.from_arrays(
            [pa.array(used, pa.int32()), pa.array([parts[k].tobytes() for k in used], pa.binary())], schema=arrow)

    def count(batches):
        # Two bytes a count: what a task counts beyond them is common in any case.
        counts = np.zeros(1 << CELL_BITS, np.int64)
        for batch in (piece for whole in batches for piece in pieces(whole, PIECE_BYTES)):
            for text in batch.column(2).to_pylist():
                np.add.at(counts, cells_of(shingles(text or b"", size, hashes)), 1)
        yield send(np.minimum(counts, 65535).astype(np.uint16))

    def add(batches):
        sums = {}
        for batch in batches:
            for k, part in zip(batch.column(0).to_pylist(), batch.column(1)):
                part = np.frombuffer(part.as_buffer(), np.uint16).astype(np.int64)
                sums[k] = sums[k] + part if k in sums else part
        levels = [np.frexp(v)[1].astype(np.uint8).tobytes() for v in sums.values()]
        yield pa.RecordBatch.from_arrays([pa.array(list(sums), pa.int32()), pa.array(levels, pa.binary())], schema=arrow)

    found = keyed(docs).mapInArrow(count, schema).repartition("_chunk").mapInArrow(add, schema)
    levels = np.zeros((1 << (CELL_BITS - CHUNK_BITS), chunk), np.uint8)
    for row in found.collect():
        levels[row["_chunk"]] = np.frombuffer(row["_counts"], np.uint8)
    return levels.ravel()


def profile(docs: DataFrame, size: int, percent: int) -> DataFrame:
    """A row per document, and the prefix tokens of its node."""
    hashes = WordHashes()
    levels = docs.sparkSession.sparkContext.broadcast(rarity_levels(docs, size))

    def prefix(grams):
        rarest = np.argsort(levels.value[cells_of(grams)], kind="stable")
        return grams[rarest[:prefix_length(len(grams), percent)]]

    def run(batch):
        rows, sizes, prefixes = [], {}, []
        for text in batch.column(2).to_pylist():
            grams = shingles(text or b"", size, hashes)
            if not len(grams):
                rows.append((None, None, 0, None))
                continue
            key = xxhash.xxh3_128_digest(grams.tobytes())
            node = node_of(key)
            rows.append((key, node, len(grams), bitmap(grams).tobytes()))
            if node not in sizes:
                sizes[node] = len(grams)
                prefixes.append(prefix(grams))
        key, node, n, bits = (list(c) for c in zip(*rows)) if rows else ([], [], [], [])
        yield {"_kind": [DOC_ROW] * len(rows), "_id": batch.column(0), "_text_key": batch.column(1), "_set_key": key,
               "_node": node, "_n": n, "_token": [None] * len(rows), "_bits": bits}
        if not prefixes:
            return
        nodes, n = np.array(list(sizes), np.int64), np.array(list(sizes.values()), np.int64)
        owner = np.repeat(np.arange(len(prefixes)), [len(p) for p in prefixes])
        token = np.concatenate(prefixes).view(np.int64)
        order = np.argsort(token, kind="stable")
        first = np.ones(len(order), bool)
        first[1:] = token[order][1:] != token[order][:-1]
        run_size = np.diff(np.append(np.flatnonzero(first), len(order)))
        shared = np.repeat(run_size > 1, run_size)
        # Back in the order of nodes, so that stored node numbers repeat.
        for kind, places in ((FORWARD, np.sort(order[first])), (LIVE, np.sort(order[shared]))):
            if len(places):
                nulls, none = pa.nulls(len(places), pa.int64()), pa.nulls(len(places), pa.binary())
                yield {"_kind": np.full(len(places), kind, np.int8), "_id": nulls, "_text_key": nulls, "_set_key": none,
                       "_node": nodes[owner[places]], "_n": n[owner[places]], "_token": token[places], "_bits": none}

    return map_batches(keyed(docs), run, PROFILE)


def live_postings(table: DataFrame, percent: int) -> DataFrame:
    """(_token, _node, _n, _tokens, _all) of tokens that several (``_all``) nodes hold; at most one row a batch and token is shuffled.

    Left out are nodes that share too few tokens with any other of the bucket.
    """
    of_token = Window.partitionBy("_token")
    forward = table.filter(F.col("_kind") == FORWARD).select("_token", "_node", "_n")
    met = forward.withColumns({"_low": F.min("_node").over(of_token), "_high": F.max("_node").over(of_token)})
    live = durable(met.filter("_low <> _high").select("_token", "_node", "_n").unionByName(
        table.filter(F.col("_kind") == LIVE).select("_token", "_node", "_n")).distinct(), "live")
    found = buckets_of(live.withColumn("_tokens", F.lit(1).cast("bigint")))
    release(live)
    for _ in range(COMMON_ROUNDS):
        # Fewer nodes leave fewer tokens to share.
        left = durable(sharing(found, percent), "sharing")
        release(found)
        found = buckets_of(left)
        release(left)
    return found


def buckets_of(postings: DataFrame) -> DataFrame:
    """(_token, _node, _n, _tokens, _all) of buckets of several (``_all``) nodes.

    Buckets that hold the same nodes are one bucket, that of the smallest token, with the number of
    ``_tokens`` of them all: copies share many.
    """
    holds = postings.groupBy("_token").agg(
        F.count(F.lit(1)).alias("n"), F.sum(F.xxhash64("_node").cast("decimal(20,0)")).alias("s"),
        F.bit_xor(F.xxhash64(F.lit(1), "_node")).alias("t"), F.min("_tokens").alias("_tokens")).filter("n > 1")
    buckets = durable(holds.groupBy("n", "s", "t").agg(F.min("_token").alias("_token"), F.sum("_tokens").alias("_tokens")).select(
        "_token", "_tokens", F.col("n").alias("_all")), "buckets")
    found = durable(postings.drop("_tokens").join(buckets, "_token"), "live-buckets")
    release(buckets)
    return found


def sharing(postings: DataFrame, percent: int) -> DataFrame:
    """The postings of nodes that may share as many tokens with another of the bucket as a similar one does.

    Two nodes have at most one bucket of their own; whatever else they share lies in larger ones.
    All that a pair shares stays if it is enough, so what is left can be looked through again.
    """
    of_node = Window.partitionBy("_node")
    pair = F.when(F.col("_all") == 2, F.col("_tokens"))
    larger = F.coalesce(F.sum(F.when(F.col("_all") > 2, F.col("_tokens"))).over(of_node), F.lit(0))
    own = F.coalesce(pair, F.max(pair).over(of_node), F.lit(0))
    needed = F.least(F.lit(COMMON), F.ceil(F.col("_n") * percent / 100))
    return postings.withColumn("_may_share", larger + own).filter(F.col("_may_share") >= needed).select("_token", "_node", "_n", "_tokens")


def star_heads(classed: DataFrame, number: int) -> DataFrame:
    """The node of each bucket and class that comes first by a hash, another one every round."""
    return classed.groupBy("_token", "_class").agg(
        F.min_by(F.struct("_node", "_n", "_component"), F.xxhash64(F.lit(number), "_node")).alias("_head"),
        F.min("_component").alias("_first"), F.max("_component").alias("_last"))


def star_pairs(still: DataFrame, percent: int, number: int) -> DataFrame:
    """Pairs (a, b) of the heads with the nodes of their bucket and class in other components.

    A bucket of up to a block is one class. Larger ones have two overlapping rows of classes, so
    that sizes near a class border meet in one of them.
    """
    width = math.log(100 / percent)
    place = F.log("_n") / F.lit(width)
    classes = F.when(F.col("_all") <= BLOCK, F.array(F.lit(WHOLE).cast("bigint"))).otherwise(F.array(F.floor(place) * 2, F.floor(place + 0.5) * 2 + 1))
    classed = still.withColumn("_class", F.explode(classes))
    heads = star_heads(classed, number).filter("_first <> _last")
    pairs = classed.join(heads, ["_token", "_class"]).filter("_head._component <> _component")
    return sized_pairs(pairs.select(F.col("_head._node").alias("a"), F.col("_node").alias("b"),
                                    F.col("_head._n").alias("n_a"), F.col("_n").alias("n_b")), percent)


def without_heads(still: DataFrame, number: int) -> DataFrame:
    """The postings without the heads of buckets of up to a block, which have met all their bucket."""
    heads = star_heads(still.filter(F.col("_all") <= BLOCK).withColumn("_class", F.lit(WHOLE)), number)
    heads = heads.select("_token", F.col("_head._node").alias("_met"))
    return still.join(heads, "_token", "left").filter("_met is null or _met <> _node").drop("_met")


def sized_pairs(pairs, percent):
    fits = F.least("n_a", "n_b") * 100 >= F.greatest("n_a", "n_b") * percent
    return pairs.filter(fits).select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()


def sets_of(docs: DataFrame, homes: DataFrame, nodes: DataFrame, size: int) -> DataFrame:
    """(_set_key, _node, _set) of some nodes, from the text of one document each (``homes``)."""
    wanted = durable(homes.join(nodes, "_node", "left_semi").select(F.col("_id").alias("_of"), F.col("_text_key").alias("_of_text")).distinct(), "wanted")
    mine = keyed(docs)
    texts = mine.join(wanted, mine["_id"].eqNullSafe(wanted["_of"]) & (mine["_text_key"] == wanted["_of_text"]), "left_semi")
    hashes = WordHashes()

    def run(batch):
        grams = [shingles(t or b"", size, hashes).tobytes() for t in batch.column(2).to_pylist()]
        keys = [xxhash.xxh3_128_digest(g) for g in grams]
        yield {"_set_key": keys, "_node": [node_of(k) for k in keys], "_set": grams}

    # Rows that repeat an id and text give the same set again.
    return map_batches(texts, run, "_set_key binary, _node bigint, _set binary").dropDuplicates(["_set_key"])


def leaves_meet(n, x, m, y, percent) -> bool:
    """Whether two sets of n and m members with bitmaps x and y (one row each) may be similar."""
    width = min(x.shape[1], y.shape[1])
    x, y = folded(x, width), folded(y, width)
    common, one, two = (int(np.bitwise_count(v).sum()) for v in (x & y, x, y))
    return common + min(n - one, m - two) >= least_overlap(n, m, percent)


def plausible(pairs: DataFrame, signed: DataFrame, percent: int) -> DataFrame:
    """The pairs that the bound on the overlap of two signatures leaves."""
    left = signed.select(F.col("_node").alias("a"), F.col("_n").alias("_n_a"), F.col("_bits").alias("_bits_a"))
    right = signed.select(F.col("_node").alias("b"), F.col("_n").alias("_n_b"), F.col("_bits").alias("_bits_b"))
    both = pairs.join(left, "a").join(right, "b").select("a", "b", "_n_a", "_n_b", "_bits_a", "_bits_b")

    def bound(batch):
        keep = []
        sizes = zip(batch.column(2).to_pylist(), batch.column(3).to_pylist())
        for (n, m), x, y in zip(sizes, batch.column(4), batch.column(5)):
            x, y = (np.frombuffer(v.as_buffer(), np.uint64)[None, :] for v in (x, y))
            keep.append(leaves_meet(n, x, m, y, percent))
        keep = pa.array(keep, pa.bool_())
        yield {"a": batch.column(0).filter(keep), "b": batch.column(1).filter(keep)}

    return map_batches(both, bound, "a bigint, b bigint").distinct()


def checked(pairs: DataFrame, docs: DataFrame, homes: DataFrame, size: int, percent: int) -> DataFrame:
    """Of the stored pairs of nodes, the set keys (a, b) of those that are similar, by their whole sets.

    The pairs are released.
    """
    ends = pairs.select(F.col("a").alias("_node")).unionByName(pairs.select(F.col("b").alias("_node"))).distinct()
    sets = durable(sets_of(docs, homes, ends, size), "sets")
    left = sets.select(F.col("_node").alias("a"), F.col("_set_key").alias("x"), F.col("_set").alias("_x"))
    right = sets.select(F.col("_node").alias("b"), F.col("_set_key").alias("y"), F.col("_set").alias("_y"))
    both = pairs.join(left, "a").join(right, "b").select("x", "y", "_x", "_y")

    def compare(batch):
        keep = []
        for x, y in zip(batch.column(2), batch.column(3)):
            x, y = (np.frombuffer(v.as_buffer(), np.uint64) for v in (x, y))
            common = len(x) + len(y) - len(np.union1d(x, y))
            keep.append(100 * common >= percent * (len(x) + len(y) - common))
        keep = pa.array(keep, pa.bool_())
        yield {"a": batch.column(0).filter(keep), "b": batch.column(1).filter(keep)}

    found = durable(map_batches(both, compare, "a binary, b binary"), "similar")
    release(pairs, sets)
    return found


# --- signature trees -----------------------------------------------------------------------------


def bitmap_bits(n: int) -> int:
    """Bits of a node's bitmap: the power of two from 2n on, ``LEAST_BITS`` at least."""
    return max(LEAST_BITS, 1 << (2 * n - 1).bit_length())


def bitmap(grams: np.ndarray) -> np.ndarray:
    bits = bitmap_bits(len(grams))
    out = np.zeros(bits, bool)
    # The low bits: halves of a longer bitmap fold onto a shorter one.
    out[(grams & np.uint64(bits - 1)).astype(np.int64)] = True
    return np.packbits(out, bitorder="little").view(np.uint64)


def folded(words: np.ndarray, width: int) -> np.ndarray:
    """OR the bitmaps in rows down to ``width`` words."""
    while words.shape[1] > width:
        half = words.shape[1] // 2
        words = words[:, :half] | words[:, half:]
    return words


class Level:
    """Tree nodes of one height: bitmaps, size ranges and most n-grams lost to shared bits."""

    def __init__(self, bits, low, high, lost):
        self.bits, self.low, self.high, self.lost = bits, low, high, lost

    def above(self):
        """Nodes of the next height, FANOUT children each."""
        cuts = np.arange(0, len(self.low), FANOUT)
        return Level(np.bitwise_or.reduceat(self.bits, cuts, axis=0), np.minimum.reduceat(self.low, cuts),
                     np.maximum.reduceat(self.high, cuts), np.maximum.reduceat(self.lost, cuts))


def tree(bits, sizes):
    """Levels from the leaves up to a root."""
    levels = [Level(bits, sizes, sizes, sizes - np.bitwise_count(bits).sum(1, dtype=np.int64))]
    while len(levels[-1].low) > 1:
        levels.append(levels[-1].above())
    return levels


def may_overlap(a: Level, i, b: Level, j, percent):
    """Which pairs of tree nodes may hold a similar pair."""
    keep = (100 * b.high[j] >= percent * a.low[i]) & (100 * a.high[i] >= percent * b.low[j])
    near = np.flatnonzero(keep)
    step = max(1, CHUNK_WORDS // a.bits.shape[1])
    for at in range(0, len(near), step):
        some = near[at:at + step]
        x, y = i[some], j[some]
        most = np.bitwise_count(a.bits[x] & b.bits[y]).sum(1, dtype=np.int64) + np.minimum(a.lost[x], b.lost[y])
        most = np.minimum(most, np.minimum(a.high[x], b.high[y]))
        keep[some] = most >= least_overlap(a.low[x], b.low[y], percent)
    return keep


def dual_traversal(one, other, percent):
    """Pairs of leaves that the bounds leave, from the roots of two trees down."""
    i = j = np.zeros(1, np.int64)
    at, bt = len(one) - 1, len(other) - 1
    while True:
        keep = may_overlap(one[at], i, other[bt], j, percent)
        i, j = i[keep], j[keep]
        if not len(i) or (at == 0 and bt == 0):
            return i, j
        # The higher tree opens first.
        if at >= bt:
            at -= 1
            i, j = children(i, j, len(one[at].low))
        else:
            bt -= 1
            j, i = children(j, i, len(other[bt].low))


def by_width(ours, theirs, percent):
    """Leaves of two blocks grouped by the length of their bitmaps: (places, places, common length).

    Lengths follow sizes, so lengths too far apart hold no similar sets, and leaves fold little.
    """
    groups = []
    for maps in (ours, theirs):
        widths = np.array([m.shape[1] for m in maps])
        groups.append({int(w): np.flatnonzero(widths == w) for w in np.unique(widths)})
    for width, places in groups[0].items():
        for other, partners in groups[1].items():
            if max(width, other) * percent < 200 * min(width, other):
                yield places, partners, min(width, other)


def children(parents, partners, count):
    opened = (parents[:, None] * FANOUT + np.arange(FANOUT)).ravel()
    there = opened < count
    return opened[there], np.repeat(partners, FANOUT)[there]


def pack_blocks(members: DataFrame, postings: int) -> DataFrame:
    """One row per (token, size class, part): its nodes, sorted by component, and their bitmaps.

    A call packs the blocks that fall into one hash bucket, about ``PACK_ROWS`` rows.
    """
    schema = ("_token bigint, _class int, _part int, _nodes binary, _components binary, _sizes binary, "
              "_bits array<binary>, _first bigint, _last bigint")
    names = ["_token", "_class", "_part", "_component", "_node", "_n", "_bits"]
    arrow = to_arrow(schema)

    def pack(table):
        rows = sorted(zip(*(table.column(n).to_pylist() for n in names)))
        out = []
        for (token, size_class, part), some in groupby(rows, key=lambda r: r[:3]):
            some = list(some)
            out.append((
                token, size_class, part, *(np.array([r[i] for r in some], np.int64).tobytes() for i in (4, 3, 5)),
                [r[6] for r in some], some[0][3], some[-1][3]))
        return pa.Table.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*out), arrow)], schema=arrow)

    calls = max(1, -(-postings // PACK_ROWS))
    return members.groupBy(F.pmod(F.xxhash64("_token", "_class", "_part"), F.lit(calls)).alias("_call")).applyInArrow(pack, schema)


def open_postings(live: DataFrame, components: DataFrame) -> DataFrame:
    """Postings of the buckets that hold several components, with those of ``components`` (_node, component).

    Nodes not in it are their own. Stored components are released.
    """
    known = durable(live.join(components, "_node", "left").select(
        "_token", "_node", "_n", "_all", F.coalesce("component", "_node").alias("_component")), "live-components")
    open_tokens = known.groupBy("_token").agg(
        F.min("_component").alias("x"), F.max("_component").alias("y")).filter("x <> y").select("_token")
    open_tokens = durable(open_tokens, "open-tokens")
    found = durable(known.join(open_tokens, "_token", "left_semi"), "open-postings")
    release(known, open_tokens, components)
    return found


def tree_pairs(still: DataFrame, signed: DataFrame, percent: int) -> DataFrame:
    """Pairs (a, b) of nodes of different components that share a live token and pass the signature trees."""
    # Buckets with the same smallest node become one: pairs share very many tokens, but few smallest nodes.
    heads = still.groupBy("_token").agg(F.min("_node").alias("_head"))
    still = durable(still.join(heads, "_token").select(
        F.col("_head").alias("_token"), "_node", "_n", "_component").distinct(), "tree-postings")
    # A bucket is one block. Larger ones split into size classes, those into parts; a class is as
    # wide as the similarity's ratio, so it meets itself and its neighbours.
    step = math.log(100 / percent)
    counted = still.join(still.groupBy("_token").agg(F.count(F.lit(1)).alias("_all")), "_token")
    classed = counted.withColumn("_class", F.when(F.col("_all") <= BLOCK, WHOLE).otherwise(F.floor(F.log("_n") / F.lit(step))).cast("int"))
    parts = classed.groupBy("_token", "_class").agg(F.ceil(F.count(F.lit(1)) / BLOCK).cast("int").alias("_parts"))
    dealt = classed.join(parts, ["_token", "_class"]).withColumn("_part", F.pmod(F.xxhash64("_component"), F.col("_parts")).cast("int"))
    # Components larger than a block are dealt by node.
    crowded = dealt.groupBy("_token", "_class", "_part").agg(F.ceil(F.count(F.lit(1)) / (2 * BLOCK)).cast("int").alias("_over"))
    dealt = dealt.join(crowded, ["_token", "_class", "_part"]).withColumn(
        "_part", (F.col("_part") + F.col("_parts") * F.pmod(F.xxhash64("_node"), F.col("_over"))).cast("int"))
    members = dealt.join(signed.select("_node", "_bits"), "_node").select(
        "_token", "_class", "_part", "_component", "_node", "_n", "_bits")
    blocks = durable(pack_blocks(members, still.count()), "blocks")
    load = ["_nodes", "_components", "_sizes", "_bits"]
    alone = blocks.filter((F.col("_class") == WHOLE) & (F.col("_first") != F.col("_last"))).select(
        *load, *[F.col(c).alias(f"{c}2") for c in load])
    # Roots meet by their keys alone; only pairs with something to compare fetch their bitmaps.
    place = ["_class", "_part", "_first", "_last"]
    roots = blocks.filter(F.col("_class") != WHOLE).select("_token", *place)
    other = roots.select("_token", *[F.col(c).alias(f"{c}2") for c in place])
    near = roots.withColumn("_class2", F.explode(F.sequence(F.col("_class"), F.col("_class") + 2))).join(other, ["_token", "_class2"]).filter(
        "(_class < _class2 or _part <= _part2) and not (_first = _last and _first2 = _last2 and _first = _first2)")
    near = durable(near.select("_token", "_class", "_part", "_class2", "_part2"), "roots")
    key = ["_token", "_class", "_part"]
    met = near.join(blocks.select(*key, *load), key).join(
        blocks.select("_token", F.col("_class").alias("_class2"), F.col("_part").alias("_part2"), *[F.col(c).alias(f"{c}2") for c in load]),
        ["_token", "_class2", "_part2"])

    def unpack(row, end):
        nodes, comps, sizes = (np.frombuffer(row[f"{c}{end}"], np.int64) for c in ("_nodes", "_components", "_sizes"))
        return sizes, nodes, comps, [np.frombuffer(b, np.uint64)[None, :] for b in row[f"_bits{end}"]]

    def traverse(batch):
        found, held = [], 0
        for k in range(batch.num_rows):
            row = batch.slice(k, 1).to_pylist()[0]
            a, b = unpack(row, ""), unpack(row, "2")
            for one, other, width in by_width(a[3], b[3], percent):
                trees = [tree(np.concatenate([folded(x[3][i], width) for i in at]), x[0][at]) for x, at in ((a, one), (b, other))]
                i, j = dual_traversal(*trees, percent)
                i, j = one[i], other[j]
                apart = a[2][i] != b[2][j]
                i, j = i[apart], j[apart]
                x, y = a[1][i], b[1][j]
                found.append(np.stack([np.minimum(x, y), np.maximum(x, y)], axis=1))
                held += len(i)
                if held > PAIR_ROWS:
                    found = [np.unique(np.concatenate(found), axis=0)]
                    held = len(found[0])
                    if held > PAIR_ROWS // 2:
                        yield {"a": found[0][:, 0], "b": found[0][:, 1]}
                        found, held = [], 0
        if held:
            pairs = np.unique(np.concatenate(found), axis=0)
            yield {"a": pairs[:, 0], "b": pairs[:, 1]}

    met = alone.unionByName(met.select(*alone.columns))
    found = durable(map_batches(met, traverse, "a bigint, b bigint").distinct(), "tree-pairs")
    release(still, blocks, near)
    return found


def similar_components(docs: DataFrame, size: int = 5, percent: int = 80) -> DataFrame:
    """One row per document: _id, _text_key, _set_key, _node, _n (set size), _component.

    Links are similarities of ``percent`` per cent or more between the sets of ``size``-word n-grams;
    components are what is reachable by links. A text shorter than n words is one n-gram; null
    texts and texts without words have no key and no component. Repeated rows are rows.
    """
    table = durable(profile(docs, size, percent), "profile")
    rows = durable(table.filter(F.col("_kind") == DOC_ROW).select("_id", "_text_key", "_set_key", "_node", "_n"), "document-rows")
    homes = durable(rows.filter("_set_key is not null").groupBy("_set_key", "_node").agg(
        F.min(F.struct(F.col("_id").isNull().alias("none"), "_id", "_text_key")).alias("h")).select("_set_key", "_node", "h._id", "h._text_key"), "homes")
    live = live_postings(table, percent)
    met = durable(live.select("_node").distinct(), "met-nodes")
    signed = durable(table.filter((F.col("_kind") == DOC_ROW) & F.col("_node").isNotNull()).select("_set_key", "_node", "_n", "_bits").join(
        met, "_node", "left_semi").dropDuplicates(["_set_key"]), "signatures")
    release(table, met)
    still, links, components = live.withColumn("_component", F.col("_node")), None, None
    for number in range(STAR_ROUNDS):
        pairs = durable(plausible(star_pairs(still, percent, number), signed, percent), "pairs")
        found = checked(pairs, docs, homes, size, percent)
        # What earlier rounds linked goes on as its components alone.
        links = found if components is None else found.unionByName(components.select(F.col("node").alias("a"), F.col("component").alias("b")))
        components = durable(connected_components(links), "components")
        merged = components.join(homes, F.col("node") == F.col("_set_key")).groupBy("_node").agg(
            F.min(F.xxhash64("component")).alias("component"))
        before, still = still, open_postings(without_heads(still, number).drop("_component"), durable(merged, "merged"))
        release(before if number else live)
    links = components.select(F.col("node").alias("a"), F.col("component").alias("b")).unionByName(
        checked(tree_pairs(still, signed, percent), docs, homes, size, percent))
    components = durable(connected_components(links), "components")
    return rows.join(components.select(F.col("node").alias("_set_key"), F.col("component").alias("_component")), "_set_key", "left").withColumn(
        "_component", F.coalesce("_component", "_set_key"))


def component_report(docs: DataFrame, size: int = 5, percent: int = 80) -> DataFrame:
    """doc_id, n_shingles and component_id (the smallest doc_id reachable by links, itself included).

    Documents without words have n_shingles 0 and are their own component. A null doc_id never is a
    component's id unless all its documents have none. An empty table gives an empty result.
    """
    rows = durable(similar_components(docs, size, percent), "classes")
    ids = rows.filter("_component is not null").groupBy("_component").agg(F.min("_id").alias("_least"))
    return rows.join(ids, "_component", "left").select(
        F.col("_id").alias("doc_id"), F.col("_n").alias("n_shingles"),
        F.when(F.col("_component").isNull(), F.col("_id")).otherwise(F.col("_least")).alias("component_id"))


def keep_one_each(docs: DataFrame, size: int = 5, percent: int = 80) -> DataFrame:
    """Rows of ``docs``: of each component the one with the smallest id; documents without words all stay.

    A null id comes after all others; equal ids go by a hash of the text. Of rows that repeat an id
    and text one stays, also without words. Columns may have any names. An empty table stays empty.
    """
    rows = durable(similar_components(docs, size, percent), "classes")
    first = F.min(F.struct(F.col("_id").isNull().alias("none"), "_id", "_text_key")).alias("h")
    kept = rows.filter("_component is not null").groupBy("_component").agg(first).select("h._id", "h._text_key")
    count = rows.groupBy("_id", "_text_key").agg(F.count(F.lit(1)).alias("_times"))
    kept = kept.withColumnsRenamed({"_id": "_k", "_text_key": "_kt"}).join(
        count, F.col("_k").eqNullSafe(F.col("_id")) & (F.col("_kt") == F.col("_text_key"))).select("_k", "_kt", "_times")
    bare = rows.filter("_component is null").select(F.col("_id").alias("_k"), F.col("_text_key").alias("_kt"), F.lit(1).cast("bigint").alias("_times")).distinct()
    kept = durable(kept.unionByName(bare), "kept")
    here = F.col("_own_id").eqNullSafe(F.col("_k")) & (F.col("_own_text") == F.col("_kt"))
    # Columns of docs may have any name, so a row goes along as one struct.
    rows = docs.select(F.struct("*").alias("_row"), F.col("doc_id").cast("bigint").alias("_own_id"), F.xxhash64("text").alias("_own_text"))
    # Only rows that repeat an id and text have to be told apart, and of those one stays.
    once = rows.join(kept.filter("_times = 1"), here, "left_semi")
    again = rows.join(kept.filter("_times > 1"), here, "left_semi").dropDuplicates(["_own_id", "_own_text"])
    return once.unionByName(again).select("_row.*")
