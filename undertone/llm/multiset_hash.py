"""Fingerprints of documents as homomorphic hashes of their paragraphs, in Spark expressions only.

Every paragraph (the text between line breaks) hashes to a wide vector, and a document's fingerprint
is the sum of its paragraphs' vectors, lane by lane modulo 2^32. So the order of paragraphs does not
matter, a paragraph is inserted by adding its vector and deleted by subtracting it, and the sum of
two documents' fingerprints is that of both together.

A vector has two kinds of lanes. IDENTITY lanes are hashed from the whole paragraph and tell
different multisets of paragraphs apart. LIKENESS lanes hold a +1 or -1 for every distinct pair of
adjacent words of the paragraph, so the cosine of two documents' lanes estimates the cosine of
their multisets of word pairs. The hash is not made to withstand an adversary.
"""

from pyspark.sql import DataFrame, Window, functions as F

from undertone.session import durable

MODULUS = 1 << 32
IDENTITY, LIKENESS = 8, 128
# Four 16-bit counters in one number; a counter holds CHUNK word pairs at most.
ONES, CHUNK = 0x0001000100010001, 32767
HALVES = 0x0000FFFF0000FFFF
# Rows of one cell of neighbouring ids, on average; a table has at most about MOST_CELLS cells.
CELL_ROWS, MOST_CELLS = 1024, 1 << 17
CUTS = 255
LAST_CELL = (1 << 63) - 1


def paragraphs(text):
    return F.split(text, "\n")


def word_pairs(parts):
    """Hashes of a paragraph's distinct pairs of a word and the one after it, the last of them alone, paragraph by paragraph."""
    words = F.transform(parts, lambda p: F.transform(F.split(p, " "), lambda w: F.xxhash64(w)))
    return F.flatten(F.transform(
        words, lambda w: F.array_distinct(F.zip_with(
            w, F.slice(w, F.lit(2), F.size(w)), lambda a, b: F.xxhash64(a, b)))))


def identity_lanes(parts):
    """IDENTITY lanes of an array of paragraphs, two out of every 64-bit hash of a paragraph."""
    def lane(number):
        def part(p):
            seeded = F.xxhash64(F.lit(number // 2), p)
            return (F.shiftrightunsigned(seeded, 32) if number % 2 else seeded).bitwiseAND(F.lit(MODULUS - 1))
        return F.aggregate(parts, F.lit(0).cast("bigint"), lambda total, p: (total + part(p)) % MODULUS)

    return [lane(number) for number in range(IDENTITY)]


def vectors(rows: DataFrame, keys, text="_text") -> DataFrame:
    """``keys`` and ``vector``, an array of IDENTITY + LIKENESS lanes, of every row of ``rows``.

    ``keys`` must tell the rows apart. Word pairs become rows and are summed by ``keys`` at once, in
    generated code: each of 32 sums carries four counters. A table already partitioned by some
    of the keys is not shuffled.
    """
    names = [f"_i{n}" for n in range(IDENTITY)]
    parts = rows.select(*keys, paragraphs(F.coalesce(F.col(text), F.lit(""))).alias("_parts"))
    # The array is a column of its own, so that exploding it stays in generated code.
    listed = parts.select(
        *keys, *[lane.alias(name) for name, lane in zip(names, identity_lanes(F.col("_parts")))],
        word_pairs(F.col("_parts")).alias("_listed"))
    pairs = listed.select(*keys, *names, F.posexplode("_listed").alias("_at", "_pair")).select(
        *keys, *names, F.floor(F.col("_at") / CHUNK).cast("int").alias("_chunk"),
        F.xxhash64("_pair").alias("_h0"), F.xxhash64(F.lit(1), "_pair").alias("_h1"))
    counters = [(h, shift) for h in ("_h0", "_h1") for shift in range(16)]
    packed = pairs.groupBy(*keys, *names, "_chunk").agg(
        F.count(F.lit(1)).alias("_pairs"),
        *[F.sum(F.shiftrightunsigned(h, shift).bitwiseAND(F.lit(ONES))).alias(f"{h}_{shift}") for h, shift in counters])
    # Long texts have several chunks: counters of 32 bits from here on.
    wide = packed.groupBy(*keys, *names).agg(
        F.sum("_pairs").alias("_pairs"),
        *[F.sum(half.bitwiseAND(F.lit(HALVES))).alias(f"{h}_{shift}_{k}") for h, shift in counters
          for k, half in enumerate((F.col(f"{h}_{shift}"), F.shiftrightunsigned(f"{h}_{shift}", 16)))])
    halves = F.array(*[f"{h}_{shift}_{k}" for h, shift in counters for k in (0, 1)])
    # Ones less zeros.
    lanes = F.flatten(F.transform(halves, lambda half: F.array(*[
        F.pmod(2 * count - F.col("_pairs"), F.lit(MODULUS))
        for count in (half.bitwiseAND(F.lit(MODULUS - 1)), F.shiftrightunsigned(half, 32))])))
    return wide.select(*keys, F.concat(F.array(*names), lanes).alias("vector"))


def added(vector, other):
    """The fingerprint vector once the paragraphs of ``other`` are inserted."""
    return F.zip_with(vector, other, lambda a, b: (a + b) % MODULUS)


def removed(vector, other):
    """The fingerprint vector once the paragraphs of ``other`` are deleted."""
    return F.zip_with(vector, other, lambda a, b: F.pmod(a - b, F.lit(MODULUS)))


def encoded(vector):
    """The fingerprint: eight hexadecimal digits a lane."""
    return F.concat_ws("", F.transform(vector, lambda lane: F.lower(F.lpad(F.hex(lane), 8, "0"))))


def decoded(fingerprint):
    """The vector of a fingerprint."""
    return F.transform(
        F.sequence(F.lit(0), F.lit(IDENTITY + LIKENESS - 1)),
        lambda n: F.conv(F.substring(fingerprint, n * 8 + 1, F.lit(8)), 16, 10).cast("bigint"))


def likeness(vector, other):
    """0 to 1: the cosine of the likeness lanes; 1 for equal vectors only."""
    def signed(v):
        lanes = F.slice(v, IDENTITY + 1, LIKENESS)
        return F.transform(lanes, lambda x: F.when(x >= MODULUS // 2, x - MODULUS).otherwise(x).cast("double"))

    def product(a, b):
        return F.aggregate(F.zip_with(a, b, lambda x, y: x * y), F.lit(0.0), lambda total, x: total + x)

    a, b = signed(vector), signed(other)
    scale = F.sqrt(product(a, a)) * F.sqrt(product(b, b))
    cosine = F.when(scale > 0, product(a, b) / scale).otherwise(0.0)
    # Different texts never read as equal, whatever the rounding.
    return F.when(vector == other, 1.0).otherwise(F.greatest(F.lit(0.0), F.least(cosine, F.lit(1 - 2.0 ** -53))))


def with_cells(rows: DataFrame) -> tuple[DataFrame, list]:
    """Deal rows (_id, _text, _hash) into ordered groups of neighbours; also the groups' columns.

    A cell holds ids of one stretch, wide enough for CELL_ROWS of them were they spread like the middle
    half of all ids. A cell of far more rows is cut at quantiles of its own ids, and an id that
    fills whole parts of it, or no id at all, by the leading bits of the text's hash.
    """
    shape = rows.agg(
        F.count(F.lit(1)).alias("rows"), F.min("_id").alias("low"),
        F.percentile_approx("_id", F.array(F.lit(0.25), F.lit(0.75)), F.lit(1000)).alias("middle")).first()
    target = max(CELL_ROWS, -(-shape["rows"] // MOST_CELLS))
    low, (left, right) = shape["low"] or 0, shape["middle"] or (0, 0)
    width = max(1, (right - left) * 2 * target // max(1, shape["rows"]))
    # Ids far outside the middle half share the outermost cells, which are cut where they are crowded.
    floor = max(low, left - 2 * (right - left) - width)
    most = 5 * (right - left) // width + 2
    cell = F.floor((F.col("_id").cast("double") - F.lit(float(floor))) / F.lit(float(width)))
    cell = F.greatest(F.lit(-1), F.least(F.lit(most), cell)).cast("bigint")
    rows = rows.withColumn("_cell", F.when(F.col("_id").isNull(), LAST_CELL).otherwise(cell))
    crowded = durable(
        rows.groupBy("_cell").agg(F.count(F.lit(1)).alias("_rows")).filter(F.col("_rows") > 8 * target)
        .select(F.col("_cell").alias("_full")), "crowded-cells")
    shares = F.array(*[F.lit(i / (CUTS + 1)) for i in range(1, CUTS + 1)])
    cuts = durable(
        rows.join(crowded, F.col("_cell") == F.col("_full")).groupBy("_full")
        .agg(F.percentile_approx("_id", shares, F.lit(10 * CUTS)).alias("_cuts")), "cell-cuts")
    rows = rows.join(cuts, F.col("_cell") == F.col("_full"), "left")
    below = F.coalesce(F.size(F.filter("_cuts", lambda cut: cut < F.col("_id"))), F.lit(0))
    hot = F.col("_full").isNotNull() & (
        F.col("_id").isNull() | (F.size(F.filter("_cuts", lambda cut: cut == F.col("_id"))) > 1))
    rows = rows.withColumns({
        "_part": F.when(F.col("_cuts").isNull(), 0).otherwise(below),
        "_slice": F.when(hot, F.shiftright("_hash", 56)).otherwise(-128).cast("int")})
    return rows.drop("_full", "_cuts"), ["_cell", "_part", "_slice"]


def with_next(docs: DataFrame, id_column="doc_id", text_column="text") -> tuple[DataFrame, list, list]:
    """Every document with its text, the next one's, and its place among its neighbours.

    Documents are ordered by id (null last), then by the hash of their text; the first one follows
    the last. Returns a table partitioned by the groups' columns, these columns, and the columns that
    order a group. Each group ends in a copy of the next group's first row, for which _own is false.
    """
    rows = docs.select(
        F.col(id_column).cast("bigint").alias("_id"), F.coalesce(text_column, F.lit("")).alias("_text"))
    rows, group = with_cells(rows.withColumn("_hash", F.xxhash64("_text")))
    key = F.struct(F.col("_id").isNull().alias("none"), F.col("_id").alias("id"), F.col("_hash").alias("hash"))
    # One narrow row per group, about MOST_CELLS in all whatever the table.
    firsts = durable(rows.groupBy(*group).agg(F.min(key).alias("_key")), "group-firsts")
    in_order = Window.orderBy(*group)
    whole = in_order.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    after = firsts.select(*group, F.coalesce(F.lead("_key").over(in_order), F.first("_key").over(whole)).alias("_next"))
    after = durable(after.select(*[F.col(c).alias(f"_to{c}") for c in group], "_next.*"), "group-ends")
    # Rows equal in id and text hash are one such first row.
    ends = rows.join(after, F.col("_id").eqNullSafe(F.col("id")) & (F.col("_hash") == F.col("hash")))
    ends = ends.select(*[F.col(f"_to{c}").alias(c) for c in group], "_id", "_text", "_hash", F.lit(False).alias("_own"))
    ends = ends.dropDuplicates(group)
    both = rows.select(*group, "_id", "_text", "_hash", F.lit(True).alias("_own")).unionByName(ends)
    order = [F.col("_own").desc(), F.col("_id").asc_nulls_last(), F.col("_hash"), F.col("_text")]
    inside = Window.partitionBy(*group).orderBy(*order)
    return both.withColumns({
        "_place": F.row_number().over(inside), "_next": F.lead("_text").over(inside)}), group


def fingerprint_report(docs: DataFrame) -> DataFrame:
    """One row per document: its fingerprint, that of its edited text, and how alike they are.

    The edited text is the document without its last floor(n_chars / 2) code points, followed by the
    first as many code points of the next document in ascending doc_id; the first follows the last.
    Returns doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited and near_next.

    A null text is empty: one empty paragraph. Null doc_ids come last; rows of one doc_id are in the
    order of their texts' hashes, so repeated rows follow each other. A table of one document is its own
    next one; an empty table gives an empty result. Other columns are not read.
    """
    rows, group = with_next(docs)
    size = F.length("_text")
    half = F.floor(size / 2).cast("int")
    edited = F.concat(F.substring("_text", F.lit(1), size - half), F.substring("_next", F.lit(1), half))
    own = F.struct(F.lit(0).alias("which"), F.col("_text").alias("text"))
    rows = rows.select(
        *group, "_place", "_own", "_id", size.cast("bigint").alias("_chars"),
        F.when(F.col("_own"), F.array(own, F.struct(F.lit(1).alias("which"), edited.alias("text"))))
        .otherwise(F.array(own)).alias("_texts"))
    texts = rows.select(*group, "_place", "_own", "_id", "_chars", F.explode("_texts").alias("_of")).select(
        *group, "_place", "_own", "_id", "_chars", F.col("_of.which").alias("_which"),
        F.when(F.col("_of.which") == 1, F.sha2("_of.text", 256)).alias("_sha"), F.col("_of.text").alias("_text"))
    found = vectors(texts, [*group, "_place", "_own", "_id", "_chars", "_which", "_sha"])
    # A document's two rows lie side by side, and the next document's first one after them.
    inside = Window.partitionBy(*group).orderBy("_place", "_which")
    near = found.select(
        "*", F.lead("vector").over(inside).alias("_edited"), F.lead("_sha").over(inside).alias("_edited_sha"),
        F.lead("vector", 2).over(inside).alias("_after"))
    return near.filter("_own and _which = 0").select(
        F.col("_id").alias("doc_id"), F.col("_chars").alias("n_chars"), F.col("_edited_sha").alias("edited_sha256"),
        encoded(F.col("vector")).alias("fingerprint"), encoded(F.col("_edited")).alias("edited_fingerprint"),
        likeness(F.col("vector"), F.col("_edited")).alias("near_edited"),
        likeness(F.col("vector"), F.col("_after")).alias("near_next"))
