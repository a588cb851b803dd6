"""Sharding by balanced label propagation.

Rows that share a link key are neighbours. Labels are shards. Every round each link group looks
at the labels of its members, and members move towards the label where most of the group can be
together. Moves obey quotas: a shard takes as many rows as it gives back in exchange, plus its
free room. Rows without neighbours fill up what is left, so row counts differ by at most one.

A group larger than a shard is split by hash into pieces that fit. Quotas and loads are tables of
shards x shards numbers, whatever the input; every other step is a join or an aggregate.
"""

from pyspark.sql import DataFrame, functions as F

from undertone.llm.common import numbered
from undertone.session import durable

HUB = ["_k1", "_k2", "_piece"]


def capacities(rows: int, shards: int) -> list:
    return [rows // shards + (s < rows % shards) for s in range(shards)]


def pick(values, index):
    """Element ``index`` of a short list of numbers, as an expression."""
    return F.element_at(F.array(*[F.lit(int(v)) for v in values]).cast("array<bigint>"), (index + 1).cast("int"))


def move_quotas(wishes: dict, room: list) -> dict:
    """How many rows may move from shard s to shard t, for every wished (s, t).

    Opposite wishes cancel out; what is left shares the free room of the target.
    """
    even = {(s, t): min(n, wishes.get((t, s), 0)) for (s, t), n in wishes.items()}
    quotas = dict(even)
    for t, free in enumerate(room):
        over = {s: n - even[s, t] for (s, target), n in wishes.items() if target == t}
        wanted = sum(over.values())
        left = min(max(free, 0), wanted)
        for s in sorted(over, key=lambda s: (-over[s], s)):
            given = min(over[s], left)
            quotas[s, t] += given
            left -= given
    return quotas


def propagate(linked: DataFrame, total: int, shards: int, rounds: int) -> DataFrame:
    """Move the rows of ``linked`` (HUB columns, _id, _label) for some rounds; stops when none moves."""
    caps = capacities(total, shards)
    for _ in range(rounds):
        loads = {r["_label"]: r["n"] for r in linked.groupBy("_label").agg(F.count(F.lit(1)).alias("n")).collect()}
        room = [caps[s] - loads.get(s, 0) for s in range(shards)]
        votes = linked.groupBy(*HUB, "_label").agg(F.count(F.lit(1)).alias("_votes"))
        sizes = votes.groupBy(*HUB).agg(F.sum("_votes").alias("_size"))
        together = F.least(F.col("_size"), F.col("_votes") + F.greatest(pick(room, F.col("_label")), F.lit(0)))
        best = votes.join(sizes, HUB).groupBy(*HUB).agg(
            F.max_by("_label", F.struct(together, "_votes", F.xxhash64(*HUB, "_label"))).alias("_wish"))
        wished = durable(linked.join(best, HUB), "shard-wishes")
        moves = wished.filter("_wish <> _label")
        counts = {(r["_label"], r["_wish"]): r["n"] for r in
                  moves.groupBy("_label", "_wish").agg(F.count(F.lit(1)).alias("n")).collect()}
        quotas = {pair: n for pair, n in move_quotas(counts, room).items() if n}
        if not quotas:
            break
        # The same bucket for all members of a group: groups move whole where quotas allow.
        placed = numbered(moves, ["_label", "_wish"], HUB, total, "_place", order=["_id"])
        pair = F.col("_label") * shards + F.col("_wish")
        quota = pick([quotas.get((s, t), 0) for s in range(shards) for t in range(shards)], pair)
        moved = placed.withColumn("_label", F.when(F.col("_place") < quota, F.col("_wish")).otherwise(F.col("_label")))
        stayed = wished.filter("_wish = _label")
        linked = durable(moved.select(stayed.columns).unionByName(stayed).drop("_wish"), "shard-labels")
    return linked


def shard_documents(docs: DataFrame, shards: int = 24, rounds: int = 6) -> DataFrame:
    """Put every row into a shard so that equal texts meet and row counts differ by at most one.

    Returns doc_id, size (UTF-8 bytes plus 8), text_crc32, law ("rows"), shard, slot (0, 1, ... in
    its shard), grown_shard (null under this law) and group_rows (rows with the same text).
    A null text has no bytes, checksum 0 and no neighbours; empty texts are equal texts. Repeated
    rows and null ids are rows like any other. An empty table gives an empty result. Columns of
    ``docs`` other than doc_id and text do not matter.
    """
    if shards < 1:
        raise ValueError("shards must be positive")
    rows = durable(docs.select(
        F.col("doc_id").alias("_id"),
        (F.coalesce(F.octet_length("text"), F.lit(0)) + 8).cast("bigint").alias("size"),
        F.coalesce(F.crc32(F.col("text").cast("binary")), F.lit(0)).cast("bigint").alias("text_crc32"),
        F.when(F.col("text").isNotNull(), F.xxhash64("text")).alias("_k1"),
        F.when(F.col("text").isNotNull(), F.xxhash64(F.lit("again"), "text")).alias("_k2"),
    ), "shard-rows")
    total = rows.count()
    caps = capacities(total, shards)
    fits = max(1, caps[-1] * 9 // 10)
    groups = durable(
        rows.filter("_k1 is not null").groupBy("_k1", "_k2").agg(F.count(F.lit(1)).alias("_rows")).filter("_rows > 1"),
        "shard-groups")
    pieces = F.when(F.col("_rows") > caps[-1], F.ceil(F.col("_rows") / fits)).otherwise(1)
    marked = rows.join(groups, ["_k1", "_k2"], "left")
    linked = marked.filter("_rows is not null").withColumn(
        "_piece", F.pmod(F.xxhash64("_id", F.lit("piece")), pieces).cast("int"))
    first = numbered(linked, [], ["_id"], total, "_place", order=["_k1", "_k2"])
    linked = durable(first.withColumn("_label", (F.col("_place") % shards).cast("int")).drop("_place"), "shard-labels")
    linked = propagate(linked, total, shards, rounds)

    taken = {r["_label"]: r["n"] for r in linked.groupBy("_label").agg(F.count(F.lit(1)).alias("n")).collect()}
    ends, end = [], 0
    for s in range(shards):
        end += caps[s] - taken.get(s, 0)
        ends.append(end)
    starts = [0, *ends[:-1]]
    alone = numbered(marked.filter("_rows is null"), [], ["_id"], total, "_place", order=["size", "text_crc32"])
    # The first shard whose free places end behind this one.
    shard = F.size(F.filter(F.array(*[F.lit(e).cast("bigint") for e in ends]), lambda e: e <= F.col("_place")))
    alone = alone.withColumn("_label", shard).withColumn(
        "slot", F.col("_place") - pick(starts, F.col("_label")) + pick([taken.get(s, 0) for s in range(shards)], F.col("_label")))
    linked = numbered(linked, ["_label"], ["_id"], total, "slot", order=["_k1", "_k2"])

    def shown(df):
        return df.select(
            F.col("_id").alias("doc_id"), "size", "text_crc32", F.lit("rows").alias("law"),
            F.col("_label").cast("int").alias("shard"), F.col("slot").cast("bigint").alias("slot"),
            F.lit(None).cast("int").alias("grown_shard"), F.coalesce("_rows", F.lit(1)).cast("bigint").alias("group_rows"))

    return shown(alone).unionByName(shown(linked))
