"""Benchmark decontamination by templates.

Both sides become templates: numbers (digits or number words), names (capitalised words inside a
sentence) and units after a number turn into typed placeholders, other words are lower-cased without
punctuation. A number glued to its unit ("120km") is two words of the template; units of one or two
letters that are words or names of variables themselves count only there. Windows of
template words are hash-joined, so a question with new numbers or names still meets its original.
On every diagonal of matching windows, and on neighbouring diagonals together (a word more or less
moves the rest of a text), the slots must be consistent: one value of the benchmark item stands for
one value of the document throughout.

A second, loose template takes capitalised words at a sentence start for names as well, and a run of
names or of numbers for one placeholder, so that renamed subjects and names of several words match.

Items without a usable template window, and those in scripts without spaces, match exactly and as a
whole: their windows are the first and the last ``size`` tokens, where a token is a word, a symbol or
a character of such a script.

All texts of a piece of a batch are hashed together: one polynomial prefix hash a version gives the
hash of any window of any size by a subtraction and a product.

A fixed-size bitmap of the benchmark's window hashes goes to the tasks, so that only windows that
may match leave them; the join decides.
"""

import re
from array import array
from itertools import chain

import numpy as np
import xxhash
from pyspark.sql import DataFrame, Window, functions as F

from undertone.llm.common import map_batches, mixed
from undertone.session import durable

WINDOW = 8
LEAST_LITERALS = 4
RUN = 6
BITMAP_BITS = 23
CACHE_BYTES = 96 << 20
# Bytes of one cached word besides its letters, about.
WORD_BYTES = 180
PIECE_BYTES = 2 << 20
# Words more or less between two parts of an item that still count together.
SLACK = 8
STRICT, LOOSE, EXACT = range(3)
LITERAL, NUMBER, NAME, UNIT = range(4)
IS_NUMBER, IS_CAPITAL, IS_UNIT, IS_NOTHING, ENDS_SENTENCE, HAS_UNIT = (1 << bit for bit in range(6))
# Units of measure that become a placeholder after a number, those that do so only
# where they are glued to it, and number words.
UNITS = frozenset(
    "mm cm dm m km in ft yd mi inch inches foot feet mile miles meter meters metre metres kilometer kilometers "
    "mg g kg t lb lbs oz gram grams kilogram kilograms ounce ounces pound pounds ml cl l liter liters litre litres "
    "s sec second seconds min minute minutes h hr hour hours day days week weeks month months year years "
    "w kw v a hz khz mhz ghz pa bar j kj cal kcal k c f percent dollar dollars euro euros cent cents usd eur gbp".split())
GLUED_ONLY = frozenset("in a m s h k t g l w v j c f".split())
NUMBER_WORDS = frozenset(
    "zero one two three four five six seven eight nine ten eleven twelve thirteen fourteen fifteen sixteen seventeen "
    "eighteen nineteen twenty thirty forty fifty sixty seventy eighty ninety hundred thousand million billion dozen".split())
# End of fixed values.
DIGITS = r"[+\-]?[$€£]?\d[\d.,:/]*"
ONE_NUMBER_WORD = f"(?:{'|'.join(sorted(NUMBER_WORDS))})"
NUMERIC = re.compile(rf"{DIGITS}(?:%|[$€£]|st|nd|rd|th)?|{ONE_NUMBER_WORD}(?:-{ONE_NUMBER_WORD})*")
GLUED = re.compile(rf"({DIGITS})[-°]?({'|'.join(sorted(UNITS, key=lambda unit: (-len(unit), unit)))})")
SPACED_UNITS = UNITS - GLUED_ONLY
BASE = 0x9E3779B97F4A7C15
EDGES = re.compile(r"^\W+|\W+$")
ENDS = re.compile(r"[.!?:]\W*$")
# Thai, Lao, Myanmar, Khmer, kana, Han with its extensions, and half-width kana.
UNSPACED = "\u0e00-\u0eff\u1000-\u109f\u1780-\u17ff\u3005-\u3007\u3040-\u30ff\u31f0-\u31ff\u3400-\u9fff\uf900-\ufaff\uff66-\uff9f\U00020000-\U0003ffff"
TOKEN = re.compile(rf"[{UNSPACED}]|[^\W{UNSPACED}]+|[^\w\s]")
WORDLIKE = re.compile(rf"[\w{UNSPACED}]")
HAS_UNSPACED = re.compile(rf"[{UNSPACED}]")
WINDOWS_SCHEMA = "_owner bigint, _text_key bigint, _template int, _size int, _at int, _hash bigint, _slots array<string>"


class Kinds(dict):
    """Word as written -> row of a table of facts; new words wait until ``rows`` has met them all.

    Facts: hash of the core in lower case, and bits that tell what the word is.
    """

    def __init__(self):
        super().__init__()
        self.reset()

    def reset(self):
        self.clear()
        self.words, self.bytes = [], 0
        self.hashes, self.flags = np.zeros(0, np.uint64), np.zeros(0, np.uint8)
        self.new_hashes, self.new_flags = array("Q"), array("B")

    def add(self, word, low, flags):
        self.words.append(word)
        self.new_hashes.append(xxhash.xxh64_intdigest(low.encode("utf-8", "replace")))
        self.new_flags.append(flags)

    def __missing__(self, word):
        row = self[word] = len(self.words)
        self.bytes += WORD_BYTES + 2 * len(word)
        if word.isalpha():
            core, ends = word, 0
        else:
            core, ends = EDGES.sub("", word), ENDS_SENTENCE if ENDS.search(word) else 0
        low = core.lower()
        glued = GLUED.fullmatch(low) if core[:1].isdecimal() else None
        if glued:
            self.add(glued[1], glued[1], IS_NUMBER | HAS_UNIT)
            self.add(glued[2], glued[2], IS_UNIT | ends)
        else:
            number = low in NUMBER_WORDS or not core.isalpha() and NUMERIC.fullmatch(low)
            self.add(word, low, ends | (IS_NUMBER if number else 0) | (IS_CAPITAL if core[:1].isupper() else 0)
                     | (IS_UNIT if low in SPACED_UNITS else 0) | (0 if core else IS_NOTHING))
        return row

    def core(self, row):
        return EDGES.sub("", self.words[row]).lower()

    def rows(self, texts):
        """Rows of the template words of all texts (bytes or None), and the text of each. Punctuation vanishes."""
        if self.bytes > CACHE_BYTES:
            self.reset()
        split = [(t or b"").decode("utf-8", "replace").split() for t in texts]
        rows = np.fromiter(map(self.__getitem__, chain.from_iterable(split)), np.int64)
        owner = np.repeat(np.arange(len(texts)), np.array([len(words) for words in split], np.int64))
        if self.new_hashes:
            self.hashes = np.concatenate([self.hashes, np.array(self.new_hashes, np.uint64)])
            self.flags = np.concatenate([self.flags, np.array(self.new_flags, np.uint8)])
            self.new_hashes, self.new_flags = array("Q"), array("B")
        glued = self.flags[rows] & HAS_UNIT > 0
        if glued.any():
            times = 1 + glued
            second = np.cumsum(times)[glued] - 1
            rows, owner = np.repeat(rows, times), np.repeat(owner, times)
            rows[second] += 1
        words = self.flags[rows] & IS_NOTHING == 0
        return rows[words], owner[words]

    def template(self, rows, owner):
        """Hash and kind of every template word, its kind in the loose template, and whether it begins a sentence."""
        flags = self.flags[rows]
        after_end, after_number = np.ones(len(rows), bool), np.zeros(len(rows), bool)
        inside = owner[1:] == owner[:-1]
        number = flags & IS_NUMBER > 0
        after_end[1:], after_number[1:] = (flags[:-1] & ENDS_SENTENCE > 0) | ~inside, number[:-1] & inside
        loose = np.where(flags & IS_CAPITAL, NAME, LITERAL)
        loose[(flags & IS_UNIT > 0) & after_number] = UNIT
        loose[number] = NUMBER
        return self.hashes[rows], np.where((loose == NAME) & after_end, LITERAL, loose), loose, after_end


class TokenHashes(dict):
    bytes = 0

    def __missing__(self, token):
        found = self[token] = xxhash.xxh64_intdigest(token.encode("utf-8", "replace"))
        self.bytes += WORD_BYTES + 2 * len(token)
        return found

    def of(self, tokens):
        if self.bytes > CACHE_BYTES:
            self.clear()
            self.bytes = 0
        return np.fromiter(map(self.__getitem__, tokens), np.uint64, len(tokens))


class Powers:
    """BASE ** i and its inverse modulo 2^64, for as many i as were asked for."""

    def __init__(self):
        self.up = self.down = np.ones(1, np.uint64)

    def of(self, n):
        if n > len(self.up):
            n = max(n, 2 * len(self.up))
            powers = lambda base: np.concatenate([[np.uint64(1)], np.cumprod(np.full(n - 1, base, np.uint64))])
            self.up, self.down = powers(BASE), powers(pow(BASE, -1, 1 << 64))
        return self.up, self.down


POWERS, WORDS = Powers(), Kinds()


def word_facts():
    """The facts of this worker process; they depend on nothing but the words, so tasks share them."""
    return WORDS


def tokens_of(text):
    return TOKEN.findall((text or b"").decode("utf-8", "replace").lower())


def item_tokens(text):
    """Tokens of an item without the symbols around them; none if they are too few."""
    tokens = tokens_of(text)
    real = [k for k, token in enumerate(tokens) if WORDLIKE.match(token)]
    tokens = tokens[real[0]:real[-1] + 1] if real else []
    return tokens if len(tokens) >= LEAST_LITERALS else []


class Version:
    """Template words of one or more texts, whose windows are hashed by differences of one prefix hash."""

    def __init__(self, hashes, kinds, owner, template):
        self.kinds, self.owner, self.template = kinds, owner, template
        up, _ = POWERS.of(len(hashes) + 1)
        values = mixed(np.where(kinds == LITERAL, hashes, kinds.astype(np.uint64)) + np.uint64(template << 32))
        self.prefix = np.concatenate([np.zeros(1, np.uint64), np.cumsum(values * up[:len(values)])])
        self.literals = np.concatenate([[0], np.cumsum(kinds == LITERAL)])
        self.names = np.concatenate([[0], np.cumsum(kinds == NAME)])

    def windows(self, size, named=False):
        """(first word, hash) of the windows of ``size`` words of one text with enough literal words.

        ``named`` leaves only those with a name.
        """
        n = len(self.owner) - size + 1
        if n < 1:
            return np.zeros(0, np.int64), np.zeros(0, np.uint64)
        wanted = (self.owner[:n] == self.owner[size - 1:]) & (self.literals[size:] - self.literals[:-size] >= min(LEAST_LITERALS, size))
        if named:
            wanted &= self.names[size:] > self.names[:-size]
        at = np.flatnonzero(wanted)
        return at, mixed((self.prefix[at + size] - self.prefix[at]) * POWERS.of(n)[1][at] + np.uint64(size))


def versions(rows, owner, texts, known):
    """(version, whether only windows with a name count, texts it counts for, places in ``rows``) of all versions.

    Capitals get lost or appear when texts are copied, so in the strict template a plain version
    goes along; windows without a name are the same in both and come once. The loose template is
    left out of texts where it has no name and no number, so that it says nothing new.
    """
    hashes, kinds, loose, begins = known.template(rows, owner)
    every, all_texts = np.arange(len(rows) + 1), np.ones(texts, bool)
    yield Version(hashes, np.where(kinds == NAME, LITERAL, kinds), owner, STRICT), False, all_texts, every
    if (kinds == NAME).any():
        yield Version(hashes, kinds, owner, STRICT), True, all_texts, every
    runs = (loose == NAME) | (loose == NUMBER)
    if runs.any():
        more = np.zeros(len(loose), bool)
        more[1:] = runs[1:] & (loose[1:] == loose[:-1]) & ~begins[1:]
        firsts = np.flatnonzero(~more)
        some = np.bincount(owner, runs, texts) > 0
        yield Version(hashes[firsts], loose[firsts], owner[firsts], LOOSE), False, some, np.append(firsts, len(rows))


def template_windows(rows: DataFrame, window: int, sizes=None, bitmap=None) -> DataFrame:
    """Windows of the texts in ``rows`` (_owner, _text_key, _text).

    With a bitmap, windows of all ``sizes`` (template -> sizes) that it knows; else those of
    ``window`` words, or of all words of a shorter text with enough of them, and where the
    template has none, exact ones: two of the largest power of two that fits, first and last, so
    that there are few sizes however long the items are.
    """
    known_tokens = TokenHashes()

    def wanted_sizes(version, texts):
        """(size, texts whose windows have that size)."""
        lengths = np.bincount(version.owner, minlength=len(texts))
        if bitmap is not None:
            return [(size, texts) for size in sizes.get(version.template, ())]
        own = np.where(texts & (lengths >= LEAST_LITERALS), np.minimum(window, lengths), 0)
        return [(size, own == size) for size in np.unique(own[own > 0]).tolist()]

    def looked_up(bits, at, found):
        place = found >> np.uint64(64 - BITMAP_BITS)
        known = (bits[place >> np.uint64(3)] >> (place & np.uint64(7)).astype(np.uint8)) & 1
        return at[known > 0], found[known > 0]

    def exact_windows(text, bits):
        tokens = item_tokens(text) if bits is None else tokens_of(text)
        wanted = [1 << (len(tokens).bit_length() - 1)] if bits is None and tokens else sizes.get(EXACT, ()) if bits is not None else []
        hashes = known_tokens.of(tokens)
        version = Version(hashes, np.full(len(tokens), LITERAL), np.zeros(len(tokens), np.int64), EXACT)
        for size in wanted:
            at, found = version.windows(size)
            if bits is None:
                ends = sorted({0, len(at) - 1})
                yield size, at[ends], found[ends]
            else:
                yield size, *looked_up(bits, at, found)

    def cut(batch):
        out = {"_owner": [], "_text_key": [], "_template": [], "_size": [], "_at": [], "_hash": [], "_slots": []}
        bits = bitmap.value if bitmap is not None else None
        owners, keys, texts = (batch.column(i).to_pylist() for i in range(3))
        known_words = word_facts()
        words, owner = known_words.rows(texts)
        usable = np.zeros(len(texts), bool)
        for version, named, counted, places in versions(words, owner, len(texts), known_words):
            first_of = np.searchsorted(version.owner, np.arange(len(texts)))
            for size, own in wanted_sizes(version, counted):
                at, found = version.windows(size, named)
                if bits is not None:
                    at, found = looked_up(bits, at, found)
                kept = own[version.owner[at]]
                at, found = at[kept], found[kept]
                text = version.owner[at]
                usable[text] = True
                for i, a, h in zip(text.tolist(), at.tolist(), found.view(np.int64).tolist()):
                    # Slot values in order, each with its kind; a run of names or numbers is one.
                    slots = [f"{version.kinds[j]}{' '.join(known_words.core(r) for r in words[places[j]:places[j + 1]].tolist())}"
                             for j in range(a, a + size) if version.kinds[j] != LITERAL]
                    for name, value in zip(out, (owners[i], keys[i], version.template, size, a - int(first_of[i]), h, slots)):
                        out[name].append(value)
        for i, text in enumerate(texts):
            if EXACT in sizes if bits is not None else not usable[i] or HAS_UNSPACED.search((text or b"").decode("utf-8", "replace")):
                for size, at, found in exact_windows(text, bits):
                    for a, h in zip(at.tolist(), found.view(np.int64).tolist()):
                        for name, value in zip(out, (owners[i], keys[i], EXACT, size, a, h, [])):
                            out[name].append(value)
        yield out

    return map_batches(rows, cut, WINDOWS_SCHEMA, PIECE_BYTES)


def window_bitmap(benchmark_windows: DataFrame):
    """A bitmap of 2^23 bits (1 MB, whatever the benchmark's size) of window hashes."""
    place = F.shiftrightunsigned("_hash", 64 - BITMAP_BITS)
    bytes_ = benchmark_windows.select(
        F.shiftright(place, 3).alias("byte"), F.expr(f"shiftleft(1, cast(shiftrightunsigned(_hash, {64 - BITMAP_BITS}) % 8 as int))").alias("bit")
    ).groupBy("byte").agg(F.bit_or("bit").alias("bits"))
    bitmap = np.zeros(1 << (BITMAP_BITS - 3), np.uint8)
    for r in bytes_.toLocalIterator():
        bitmap[r["byte"]] = r["bits"]
    return bitmap


def keyed(table: DataFrame, id_column) -> DataFrame:
    return table.select(F.col(id_column).cast("bigint").alias("_owner"), F.xxhash64("text").alias("_text_key"),
                        F.col("text").cast("binary").alias("_text"))


def leaks(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW) -> DataFrame:
    """Which documents hold which benchmark items: doc_id, _text_key, item_id, matched, item_windows, same_slots.

    An item is leaked if, on one diagonal of a document with consistent slots, at least half of its
    windows match, or 6 of them (13 words); or if on diagonals at most ``SLACK`` apart, again with
    consistent slots, the matching windows cover as many of its words as that many windows in a row
    do. Either template may do so, each by itself. An exact item (see above) is leaked if both its
    windows match on one diagonal. same_slots tells whether all slot values are the
    item's own, that is, whether it is a copy rather than a new version. Items shorter than a window
    match as a whole; those with under 4 words or tokens never do, nor do null or empty texts. Rows
    that share an id and text are one document. A null id is an id. Empty tables give an empty result.
    """
    items = keyed(benchmark, "item_id")
    cut = durable(template_windows(items, window), "benchmark-windows")
    of_item = Window.partitionBy("_owner", "_text_key", "_template")
    # Distinct first words: the two versions of a window count once.
    theirs = durable(cut.select(
        F.col("_owner").alias("item_id"), F.col("_text_key").alias("_item_key"), "_template", "_size", F.col("_at").alias("_item_at"), "_hash",
        F.col("_slots").alias("_item_slots"), F.size(F.collect_set("_at").over(of_item)).cast("bigint").alias("item_windows")), "benchmark-windows")
    # At most ``window`` sizes a template, and as many exact ones as the longest item's length has bits.
    sizes = {}
    for r in theirs.select("_template", "_size").distinct().orderBy("_template", "_size").collect():
        sizes.setdefault(r["_template"], []).append(r["_size"])
    bitmap = docs.sparkSession.sparkContext.broadcast(window_bitmap(theirs))
    found = template_windows(keyed(docs, "doc_id"), window, sizes, bitmap).withColumnRenamed("_owner", "doc_id")
    # Only matches are written; a benchmark passage may sit in very many documents.
    hits = durable(found.join(theirs, ["_hash", "_template", "_size"]).withColumn("_diagonal", F.col("_at") - F.col("_item_at")), "leak-windows")
    # Every diagonal by itself, and bands of 2 x SLACK diagonals, each of which begins in the middle of the one before.
    band = F.floor(F.col("_diagonal") / SLACK).cast("int")
    lane = lambda banded, place: F.struct(F.lit(banded).alias("banded"), place.alias("place"))
    hits = hits.withColumn("_lane", F.explode(F.array(lane(False, F.col("_diagonal")), lane(True, band), lane(True, band - 1))))
    line = ["doc_id", "_text_key", "item_id", "_item_key", "_template", "_lane"]
    pairs = hits.filter(F.size("_slots") > 0).select(
        *line, F.explode(F.arrays_zip(F.col("_item_slots").alias("theirs"), F.col("_slots").alias("ours"))).alias("_slot"))
    slots = pairs.groupBy(*line, F.col("_slot.theirs").alias("_theirs")).agg(
        F.min("_slot.ours").alias("_low"), F.max("_slot.ours").alias("_high")).groupBy(*line).agg(
        F.bool_and(F.col("_low") == F.col("_high")).alias("_consistent"),
        F.bool_and((F.col("_low") == F.col("_theirs")) & (F.col("_high") == F.col("_theirs"))).alias("_same"))
    # First words of one item's windows: no more than the item has words.
    lines = hits.groupBy(*line).agg(
        F.array_sort(F.collect_set("_item_at")).alias("_matched_at"), F.first("item_windows").alias("item_windows"), F.first("_size").alias("_size"))
    on = lines["_text_key"] == slots["_text_key"]
    for name in ("doc_id", "item_id", "_item_key", "_template", "_lane"):
        on = on & lines[name].eqNullSafe(slots[name])
    joined = lines.join(slots, on, "left").select(
        *[lines[c] for c in lines.columns], F.coalesce(slots["_consistent"], F.lit(True)).alias("_consistent"),
        F.coalesce(slots["_same"], F.lit(True)).alias("_same"))
    matched = F.size("_matched_at").cast("bigint")
    least = F.least(F.lit(RUN), F.ceil(F.col("item_windows") / 2))
    # The last window has none after it and covers all its words.
    steps = F.zip_with("_matched_at", F.slice("_matched_at", 2, matched.cast("int")), lambda at, after: F.least(F.coalesce(after - at, "_size"), "_size"))
    covered = F.aggregate(steps, F.lit(0), lambda total, x: total + x)
    least = F.when(F.col("_template") == EXACT, F.col("item_windows")).otherwise(least)
    enough = (matched >= least) | ((F.col("_template") != EXACT) & F.col("_lane.banded") & (covered >= F.col("_size") + least - 1))
    return joined.filter(F.col("_consistent") & enough).groupBy("doc_id", "_text_key", "item_id").agg(
        F.max(matched).alias("matched"), F.max("item_windows").alias("item_windows"), F.bool_or("_same").alias("same_slots"))


def leak_report(docs: DataFrame, benchmark: DataFrame, **options) -> DataFrame:
    """One row per document and leaked item; documents without a leak have none."""
    return leaks(docs, benchmark, **options).groupBy("doc_id", "item_id").agg(
        F.max("matched").alias("matched"), F.max("item_windows").alias("item_windows"), F.bool_or("same_slots").alias("same_slots"))


def without_leaks(docs: DataFrame, benchmark: DataFrame, **options) -> DataFrame:
    """Rows of ``docs`` that hold no benchmark item.

    Null and empty texts hold none and stay; rows that repeat an id and text go or stay together.
    Columns may have any names. Empty tables are allowed on both sides.
    """
    caught = durable(leaks(docs, benchmark, **options).select(
        F.col("doc_id").alias("_leak_id"), F.col("_text_key").alias("_leak_text")).distinct(), "leaks")
    rows = docs.select(F.struct("*").alias("_row"), F.col("doc_id").cast("bigint").alias("_own_id"), F.xxhash64("text").alias("_own_text"))
    return rows.join(caught, F.col("_own_id").eqNullSafe(F.col("_leak_id")) & (F.col("_own_text") == F.col("_leak_text")), "left_anti").select("_row.*")
