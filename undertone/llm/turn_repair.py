"""Repair of damaged conversations by aligning their turns to the alternating grammar.

A sound conversation reads, by the initials of its roles, ``(s?(ua)+)?``: nothing, or user and
assistant in turns, a system turn perhaps before them. The cheapest edits that make a conversation
sound are found by Wagner-Fischer alignment of its turns to the grammar's string of each feasible
length. All these strings end alike, so the tables of all lengths share their columns: cell (i, r)
is the least cost of turning the rows from i on into the last r letters. Costs beyond a limit leave
a band (Ukkonen): the limit starts low, doubles, and stops at the cost of the incumbent, a script
found by one pass over the rows. Scripts of equal cost are traced together, letter by letter, so
that of all lengths the audit least in ASCII wins.

Order, faults and the edited texts are Spark's work. Python sees one short string per conversation,
a letter per turn; a worker remembers the short ones it has aligned.
"""

from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window, functions as F

DELETE, INSERT, REROLE, UNFINISHED = 2, 5, 1, 5
SPACES = " \t\n\x0b\x0c\r"
FAULTS = ("blank", "duplicate", "truncated")
EDITS = "cost bigint, audit string, turns array<struct<place:int,role:string>>"
# Rows of the table kept at a time: every KEPT-th one, and those between two of them.
KEPT = 256
SHORT = 32
FAR = np.int64(1) << 60


def least(rows, unfinished, wanted):
    """Least cost of turning ``rows`` rows, some of them unfinished, into ``wanted`` letters, whatever their roles."""
    removed = np.maximum(0, rows - wanted)
    return DELETE * removed + INSERT * np.maximum(0, wanted - rows) + np.where(
        unfinished > removed, UNFINISHED * (unfinished - removed), 0)


class Table:
    """Costs of the rows from i on against the last r letters, within a band of cost ``limit``."""

    def __init__(self, roles, unfinished, limit):
        self.roles, self.unfinished, self.limit = roles, unfinished, limit
        n = len(roles)
        self.after = np.append(np.cumsum(unfinished[::-1])[::-1], 0)
        # The widest the band can be; cells outside a row's own band are FAR.
        self.low, self.width = -(limit // DELETE) - 1, limit // DELETE + limit // INSERT + 3
        self.kept, self.block = {}, {}
        row = self.last_row()
        self.kept[n] = row
        for i in range(n - 1, -1, -1):
            row = self.row_before(i, row)
            if i % KEPT == 0:
                self.kept[i] = row

    def letters(self, i):
        """Lengths r of the cells of row i."""
        return len(self.roles) - i + self.low + np.arange(self.width)

    def last_row(self):
        r = self.letters(len(self.roles))
        return np.where((r >= 0) & (INSERT * r <= self.limit), INSERT * r, FAR)

    def row_before(self, i, below):
        """Row i from row i + 1. Cell k of row i stands for one letter more than cell k of row i + 1."""
        r = self.letters(i)
        wrong = (r % 2 == 1) != (self.roles[i] == "a") if self.roles[i] in "ua" else np.ones(len(r), bool)
        row = below + np.where(wrong, REROLE, 0) + (UNFINISHED if self.unfinished[i] else 0)
        row[r < 1] = FAR
        # Deleting the row leaves as many letters, which is the cell to the right.
        row[:-1] = np.minimum(row[:-1], below[1:] + DELETE)
        row[r < 0] = FAR
        # Any number of insertions at once.
        steps = INSERT * np.arange(len(r))
        row = np.minimum.accumulate(row - steps) + steps
        # The rows before cost at least the deletion of each unfinished one.
        spent = DELETE * (self.after[0] - self.after[i])
        alive = (r >= 0) & (row + spent <= self.limit) & (least(len(self.roles) - i, self.after[i], r) + spent <= self.limit)
        return np.where(alive, row, FAR)

    def row(self, i):
        """Row i, computed again from the nearest kept row below it."""
        if i in self.kept:
            return self.kept[i]
        if i not in self.block:
            below = min(-(-i // KEPT) * KEPT, len(self.roles))
            self.block, row = {}, self.kept[below]
            for j in range(below - 1, below - KEPT, -1):
                row = self.row_before(j, row)
                self.block[j] = row
                if j == 0:
                    break
        return self.block[i]

    def costs(self, i, lengths):
        """Costs of row i at these lengths; FAR outside the band."""
        if i > len(self.roles):
            return np.full(len(lengths), FAR)
        place = np.asarray(lengths) - (len(self.roles) - i + self.low)
        inside = (place >= 0) & (place < self.width) & (np.asarray(lengths) >= 0)
        return np.where(inside, self.row(i)[np.clip(place, 0, self.width - 1)], FAR)


def incumbent(roles, unfinished):
    """The cost of a script found in one pass: unfinished turns go, others alternate from the first on."""
    kept = [r for r, bad in zip(roles, unfinished) if not bad]
    cost = DELETE * (len(roles) - len(kept))
    body = kept[1:] if kept[:1] == ["s"] and len(kept) > 2 else kept
    best = DELETE * len(kept)
    even = len(body) // 2 * 2
    best = min(best, sum(role != "ua"[k % 2] for k, role in enumerate(body[:even])) * REROLE + DELETE * (len(body) - even))
    return cost + best


def starts(table):
    """The least total cost, and where scripts of that cost begin: lengths without and with a system turn."""
    n = len(table.roles)
    even = np.arange(0, n + table.low + table.width + 1, 2)
    plain = table.costs(0, even)
    best = int(plain.min(initial=FAR))
    headed = {}
    gone = 0
    for i, role in enumerate(table.roles):
        if gone > min(best, table.limit):
            break
        if role == "s":
            lengths = np.arange(2, n - i + table.low + table.width, 2)
            cost = gone + (UNFINISHED if table.unfinished[i] else 0) + table.costs(i + 1, lengths)
            if len(cost) and cost.min() <= best:
                least_here = int(cost.min())
                if least_here < best:
                    best, headed = least_here, {}
                headed[i] = set(lengths[cost == best].tolist())
        gone += DELETE
    return best, set(even[plain == best].tolist()), headed


def traced(table, forced):
    """The least cost and, of all scripts that have it, the edits of the audit least in ASCII.

    ``forced[i]`` rows before row i must be deleted. All tied scripts are followed at once; they have
    the same letters so far, so they stand at the same row and differ in the letters still to come.
    """
    total, plain, headed = starts(table)
    left, i, n = total, 0, len(table.roles)
    audit, turns = ["D" * forced[0]], []
    # Scripts that still wait for their system turn: its row, and the lengths that follow it.
    while True:
        waiting = any(place >= i for place in headed)
        if i == n and 0 in plain:
            break
        here = np.array(sorted(plain), np.int64)
        if i < n:
            gone = here[table.costs(i + 1, here) == left - DELETE] if len(here) else here
            later = {place: lengths for place, lengths in headed.items() if place > i}
            if len(gone) or later:
                audit.append("D" + "D" * forced[i + 1])
                plain, headed, left, i = set(gone.tolist()), later, left - DELETE, i + 1
                continue
        more = here[here > 0]
        put = more[table.costs(i, more - 1) == left - INSERT]
        if len(put):
            audit.append("I")
            turns.append((-1, "ua"[int(put[0]) % 2]))
            plain, headed, left = set((put - 1).tolist()), {}, left - INSERT
            continue
        role, extra = table.roles[i], UNFINISHED if table.unfinished[i] else 0
        after = table.costs(i + 1, more - 1)
        same = (more % 2 == 1) == (role == "a") if role in "ua" else np.zeros(len(more), bool)
        kept = set((more[same & (after == left - extra)] - 1).tolist())
        if waiting and i in headed:
            kept |= headed[i]
        if kept:
            audit.append("K")
            turns.append((i, None))
            left -= extra
        else:
            changed = more[~same & (after == left - extra - REROLE)]
            audit.append("R")
            turns.append((i, "ua"[int(changed[0]) % 2]))
            kept, left = set((changed - 1).tolist()), left - extra - REROLE
        audit.append("D" * forced[i + 1])
        plain, headed, i = kept, {}, i + 1
    return total, "".join(audit), turns


def aligned(shape: str):
    """Cost, audit and turns (row, new role) of a conversation of this shape, a letter per row.

    x is a row that must go; s, u, a and o stand for the roles' initials, in capitals where the text is
    unfinished. A row of -1 is an inserted one; roles are u, a or None for a kept one.
    """
    places = [k for k, letter in enumerate(shape) if letter != "x"]
    forced = np.diff([-1, *places, len(shape)]) - 1
    roles = [shape[k].lower() for k in places]
    unfinished = np.array([shape[k].isupper() for k in places], bool)
    most = incumbent(roles, unfinished)
    limit = min(most, DELETE * int(unfinished.sum()) + 8)
    while True:
        table = Table(roles, unfinished, limit)
        if limit == most or min(starts(table)[0], FAR) <= limit:
            break
        limit = min(most, 2 * limit)
    cost, audit, turns = traced(table, forced.tolist())
    names = {"u": "user", "a": "assistant", None: None}
    return (cost + DELETE * (len(shape) - len(places)), audit,
            [(places[i] if i >= 0 else -1, names[role]) for i, role in turns])


@lru_cache(maxsize=1 << 15)
def remembered(shape: str):
    """``aligned`` for short conversations, many of which are alike."""
    return aligned(shape)


def align(shapes: pa.Array) -> pa.Array:
    kind = pa.struct([("cost", pa.int64()), ("audit", pa.string()), (
        "turns", pa.list_(pa.struct([("place", pa.int32()), ("role", pa.string())])))])
    found = ((remembered if len(shape) <= SHORT else aligned)(shape) for shape in shapes.to_pylist())
    return pa.array([(c, a, [{"place": p, "role": r} for p, r in t]) for c, a, t in found], kind)


def damaged(conversations: DataFrame) -> DataFrame:
    """Rows broken in one of five ways, or not, by crc32 of ``conv_id:turn`` modulo 20; others as they are.

    0 drops the row (its _lost is true), 1 empties the text, 2 removes its full stops, exclamation
    and question marks, 3 repeats the row, 4 makes it the user's. Null texts and roles, and null ids
    in the key, read as one space.
    """
    space = F.lit(" ")
    key = F.concat(F.coalesce(F.col("conv_id").cast("string"), space), F.lit(":"), F.coalesce(F.col("turn").cast("string"), space))
    rows = conversations.select(
        "conv_id", "turn", F.coalesce("role", space).alias("role"), F.coalesce("text", space).alias("text"),
        (F.crc32(key.cast("binary")) % 20).alias("_kind"))
    kind = F.col("_kind")
    text = F.when(kind == 1, "").when(kind == 2, F.translate("text", ".!?", "")).otherwise(F.col("text"))
    return rows.select(
        "conv_id", "turn", F.when(kind == 4, "user").otherwise(F.col("role")).alias("role"), text.alias("text"),
        (kind == 0).alias("_lost"),
        F.explode(F.when(kind == 3, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0)))).alias("_copy")).drop("_copy")


def repaired(turns: DataFrame) -> DataFrame:
    """One row per conversation: its faults, the cheapest edits, and the repaired turns.

    ``turns`` has conv_id, turn, role and text, and may have _lost for rows that only name their
    conversation. Returns conv_id, gaps, blank, duplicate, truncated, illegal, cost, audit and
    repaired, an array of (role, text).

    Rows are ordered by turn (null first), then role, then text, so repeated rows lie side by side.
    Null roles and texts are one space; a role of another initial than s, u or a fits nowhere and is
    changed or deleted. Rows without a conv_id form one conversation. A conversation is one value of
    the result, as long as a value may be. Clashing and other columns are not read; an empty table
    gives an empty result.
    """
    lost = F.col("_lost") if "_lost" in turns.columns else F.lit(False)
    rows = turns.select(
        "conv_id", "turn", F.coalesce("role", F.lit(" ")).alias("role"), F.coalesce("text", F.lit(" ")).alias("text"),
        lost.alias("_lost"))
    # One exchange: the window and the groups below both fit this partitioning.
    rows = rows.repartition("conv_id")
    same = Window.partitionBy("conv_id", "_lost", "role", "text").orderBy(F.col("turn").asc_nulls_first())
    last = F.right(F.rtrim("text", F.lit(SPACES)), F.lit(1))
    fault = F.when(last == "", "blank").when(F.row_number().over(same) > 1, "duplicate").when(
        ~last.isin(".", "!", "?"), "truncated")
    turn = F.struct("turn", "role", "text", fault.alias("fault"))
    rows = rows.select("conv_id", F.when(~F.col("_lost"), turn).alias("_turn"), "turn", "_lost")
    grouped = rows.groupBy("conv_id").agg(
        F.sort_array(F.collect_list("_turn")).alias("_turns"),
        F.max(F.when(~F.col("_lost"), F.col("turn"))).alias("_most"), F.min(F.when(~F.col("_lost"), F.col("turn"))).alias("_least"))

    def with_fault(name):
        return F.size(F.filter("_turns", lambda t: t["fault"] == name)).cast("bigint")

    known = F.array_distinct(F.filter(F.transform("_turns", lambda t: t["turn"]), lambda x: x.isNotNull()))
    grouped = grouped.select(
        "conv_id", "_turns", F.coalesce(F.col("_most") - F.col("_least") + 1 - F.size(known), F.lit(0)).cast("bigint").alias("gaps"),
        F.transform("_turns", lambda t: F.left(t["role"], F.lit(1))).alias("_initials"),
        *[with_fault(name).alias(name) for name in FAULTS])

    def letter(turn):
        initial = F.left(turn["role"], F.lit(1))
        initial = F.when(initial.isin("s", "u", "a"), initial).otherwise("o")
        return F.when(turn["fault"].isin("blank", "duplicate"), "x").when(
            turn["fault"] == "truncated", F.upper(initial)).otherwise(initial)

    pairs = F.zip_with(
        F.slice("_initials", F.lit(1), F.greatest(F.size("_initials") - 1, F.lit(0))),
        F.slice("_initials", F.lit(2), F.greatest(F.size("_initials") - 1, F.lit(0))), lambda a, b: F.concat(a, b))
    edits = F.arrow_udf(align, EDITS)
    # Only the letters go to Python; the turns wait beside it.
    shaped = grouped.select(
        "*", F.size(F.filter(pairs, lambda p: ~p.isin("su", "ua", "au"))).cast("bigint").alias("illegal"),
        edits(F.concat_ws("", F.transform("_turns", letter))).alias("_edits"))

    def put(edit):
        old = F.get("_turns", edit["place"])
        return F.struct(F.coalesce(edit["role"], old["role"]).alias("role"),
                        F.when(edit["place"] < 0, "").otherwise(old["text"]).alias("text"))

    return shaped.select(
        "conv_id", "gaps", *FAULTS, "illegal", "_edits.cost", "_edits.audit",
        F.transform("_edits.turns", put).alias("repaired"))


def repair_report(conversations: DataFrame) -> DataFrame:
    """``repaired`` of the damaged conversations, the turns as a hash of their ``role:text`` lines."""
    lines = F.concat_ws("\n", F.transform("repaired", lambda t: F.concat(t["role"], F.lit(":"), t["text"])))
    return repaired(damaged(conversations)).withColumn("repaired_sha256", F.sha2(lines, 256)).drop("repaired")
