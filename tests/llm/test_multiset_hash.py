"""Multiset hashes: their algebra, the texts they are made of, and how alike they say texts are."""

import hashlib
import random

import pytest
from pyspark.sql import functions as F

from undertone.llm import multiset_hash

WORDS = [a + b + c for a in "bdfgklm" for b in "aeiou" for c in ("", "n", "rt", "ss")]


def prose(rng, lines, words=12):
    return "\n".join(" ".join(rng.choice(WORDS) for _ in range(words)) for _ in range(lines))


def vectors_of(spark, texts):
    frame = spark.createDataFrame(list(enumerate(texts)), "_n int, _text string")
    return {r["_n"]: r["vector"] for r in multiset_hash.vectors(frame, ["_n"]).collect()}


def test_sums_of_paragraphs(spark):
    rng = random.Random(1)
    a, b = prose(rng, 7), prose(rng, 5)
    shuffled = a.split("\n")
    rng.shuffle(shuffled)
    texts = [a, b, a + "\n" + b, "\n".join(shuffled), a + "\n" + a, "", None, a + "\n"]
    frame = spark.createDataFrame(list(enumerate(texts)), "_n int, _text string")
    found = multiset_hash.vectors(frame, ["_n"]).cache()
    v = {r["_n"]: r["vector"] for r in found.collect()}
    assert all(len(x) == 136 and all(0 <= lane < 2**32 for lane in x) for x in v.values())
    assert v[0] == v[3] and v[5] == v[6]
    pairs = found.alias("x").join(found.alias("y"), F.col("x._n") < F.col("y._n")).select(
        F.col("x._n").alias("i"), F.col("y._n").alias("j"),
        multiset_hash.added(F.col("x.vector"), F.col("y.vector")).alias("plus"),
        multiset_hash.removed(F.col("y.vector"), F.col("x.vector")).alias("minus"),
        (multiset_hash.decoded(multiset_hash.encoded(F.col("x.vector"))) == F.col("x.vector")).alias("same"))
    rows = {(r["i"], r["j"]): r for r in pairs.collect()}
    assert rows[0, 1]["plus"] == v[2] and rows[0, 2]["minus"] == v[1] and rows[1, 2]["minus"] == v[0]
    assert rows[0, 4]["minus"] == v[0] and rows[0, 5]["plus"] == v[7]
    assert all(r["same"] for r in rows.values())
    assert len({tuple(v[n]) for n in (0, 1, 2, 4, 5, 7)}) == 6


def test_long_texts_have_several_chunks(spark, monkeypatch):
    rng = random.Random(2)
    texts = [prose(rng, 40), prose(rng, 1, 500), prose(rng, 300, 3)]
    whole = vectors_of(spark, texts)
    monkeypatch.setattr(multiset_hash, "CHUNK", 7)
    assert vectors_of(spark, texts) == whole


def expected_texts(rows):
    """(doc_id, n_chars, edited_sha256) of rows without ties."""
    rows = sorted(((i, t or "") for i, t in rows), key=lambda r: (r[0] is None, r[0] or 0))
    out = []
    for k, (i, text) in enumerate(rows):
        half = len(text) // 2
        edited = text[:len(text) - half] + rows[(k + 1) % len(rows)][1][:half]
        out.append((i, len(text), hashlib.sha256(edited.encode()).hexdigest()))
    return out


COLUMNS = ["doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next"]


def report(spark, rows):
    frame = spark.createDataFrame([(*r, "x", 1) for r in rows], "doc_id bigint, text string, _cell string, vector int")
    found = multiset_hash.fingerprint_report(frame)
    assert found.columns == COLUMNS
    return found.collect()


def difficult(rng):
    ids = rng.sample(range(-500, 4000), 300) + [10**15, -10**15, 2**62, None]
    texts = [None, "", "one", "ä漢字😀", "a\n\n b", "word " * 30_000] + [prose(rng, rng.randrange(1, 9)) for _ in range(400)]
    return [(i, texts[k]) for k, i in enumerate(ids)]


@pytest.mark.parametrize("cell", [1, 4, 1024])
def test_edited_texts_at_any_size_of_cells(spark, monkeypatch, cell):
    monkeypatch.setattr(multiset_hash, "CELL_ROWS", cell)
    rows = difficult(random.Random(3))
    got = report(spark, rows)
    assert sorted(map(str, [tuple(r)[:3] for r in got])) == sorted(map(str, expected_texts(rows)))
    for r in got:
        assert 0 <= r["near_edited"] <= 1 and 0 <= r["near_next"] <= 1
        assert (r["near_edited"] == 1) == (r["fingerprint"] == r["edited_fingerprint"])


def test_repeated_ids_and_no_ids(spark, monkeypatch):
    monkeypatch.setattr(multiset_hash, "CELL_ROWS", 2)
    rng = random.Random(4)
    rows = [(7, prose(rng, 2)) for _ in range(150)] + [(None, prose(rng, 2)) for _ in range(150)] + [(9, "same text")] * 90
    rows += [(i, prose(rng, 3)) for i in range(20, 60)]
    got = report(spark, rows)
    assert len(got) == len(rows)
    # Rows of one id follow each other in the order of their texts' hashes.
    frame = spark.createDataFrame(rows, "doc_id bigint, text string").select("doc_id", "text", F.xxhash64("text").alias("h"))
    ordered = [(r["doc_id"], r["text"]) for r in sorted(
        frame.collect(), key=lambda r: (r["doc_id"] is None, r["doc_id"] or 0, r["h"]))]
    want = []
    for k, (i, text) in enumerate(ordered):
        half = len(text) // 2
        edited = text[:len(text) - half] + ordered[(k + 1) % len(ordered)][1][:half]
        want.append((i, len(text), hashlib.sha256(edited.encode()).hexdigest()))
    assert sorted(map(str, [tuple(r)[:3] for r in got])) == sorted(map(str, want))


def test_likeness_follows_what_texts_share(spark):
    rng = random.Random(5)
    rows = [(i, prose(rng, 10)) for i in range(200)]
    got = report(spark, rows)
    assert all(0.25 < r["near_edited"] < 0.8 and r["near_next"] < 0.4 for r in got)
    assert 0.45 < sum(r["near_edited"] for r in got) / 200 < 0.6 and sum(r["near_next"] for r in got) / 200 < 0.1
    # One word over and over in one paragraph weighs as one pair.
    junk = report(spark, [(0, prose(rng, 10)), (1, "spam " * 2000)])
    assert min(r["near_edited"] for r in junk if r["doc_id"] == 0) > 0.4


def test_one_document_and_none(spark):
    only = report(spark, [(5, "ab\ncd")])[0]
    assert only["edited_sha256"] == hashlib.sha256(b"ab\nab").hexdigest() and only["near_next"] == 1
    assert report(spark, []) == []
