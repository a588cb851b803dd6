"""Ranked search against plain integer arithmetic."""

import math
import random
import re
from collections import Counter

import numpy as np
import pytest

from undertone.llm import lexical_rank

TERM = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
WORDS = [a + b for a in "bdfgklmnprst" for b in ("a", "e", "i", "o", "u", "an", "er")] + ["Ä", "漢字", "7", "éa"]


def split(text):
    return [t.translate(LOWER) for t in TERM.findall(text or "")]


def plain_rank(docs, items, k):
    bags = [(i, Counter(split(t))) for i, t in docs]
    many = sum(bool(b) for _, b in bags)
    total = sum(sum(b.values()) for _, b in bags)
    held = Counter(t for _, b in bags for t in b)
    asked = {}
    for i, t in items:
        asked.setdefault(i, Counter()).update(split(t))
    out = []
    for item, bag in asked.items():
        hits = []
        for i, b in bags:
            n = sum(b.values())
            score = sum(
                times * math.floor(1000 * math.log((2 * many + 2) / (2 * held[t] + 1)))
                * ((1_000_000_000 * b[t]) // (1000 * b[t] + 8 * (25 + (75 * n * many) // total)))
                for t, times in bag.items() if b[t])
            if score > 0:
                hits.append((-score, i is None, i or 0, i))
        out += [(item, r, i, -s) for r, (s, _, _, i) in enumerate(sorted(hits)[:k], 1)]
    return out


def ranked(spark, docs, items, **more):
    docs = spark.createDataFrame([(*d, 0, "x") for d in docs], "doc_id bigint, text string, score int, item_id string")
    items = spark.createDataFrame([(*i, 1) for i in items], "item_id bigint, text string, rank int")
    return [tuple(r) for r in lexical_rank.rank_documents(docs, items, **more).collect()]


@pytest.fixture(scope="module")
def tables():
    rng = random.Random(9)
    words = lambda n: " ".join(rng.choice(WORDS) + rng.choice(["", ",", ".\n", "-" + rng.choice(WORDS)]) for _ in range(n))
    docs = [(i, words(rng.randrange(1, 60))) for i in range(500)]
    docs += [(None, words(20)), (None, None), (700, ""), (701, " .,!"), (702, words(30_000)), (703, "BA ba Ba")]
    # Ties: copies under other ids, repeated rows, more equal scores than places.
    docs += [(800 + i, "rare words here") for i in range(40)] + [docs[3]] * 3 + [(3, "another text")]
    items = [(i, words(rng.randrange(1, 25))) for i in range(70)]
    items += [(100, "rare"), (100, "words"), (101, None), (102, "..."), (None, "rare here"), (103, "nothing of this zzz"), (104, "ba " * 5000)]
    return docs, items


@pytest.mark.parametrize("k,block_terms,tile_rows", [(10, 1 << 17, 1024), (3, 40, 16), (1000, 1 << 17, 64)])
def test_ranks_are_exact(spark, tables, monkeypatch, k, block_terms, tile_rows):
    monkeypatch.setattr(lexical_rank, "BLOCK_TERMS", block_terms)
    monkeypatch.setattr(lexical_rank, "TILE_ROWS", tile_rows)
    docs, items = tables
    assert sorted(map(str, ranked(spark, docs, items, k=k))) == sorted(map(str, plain_rank(docs, items, k)))


def test_nothing_to_rank(spark, tables):
    docs, items = tables
    assert ranked(spark, [], items[:5]) == [] and ranked(spark, docs[:5], []) == []
    assert ranked(spark, [(1, None)], items[:5]) == []


def test_products_stay_exact_beyond_the_limit():
    """Weights whose products with impacts would pass 2^53 are cut into parts that cannot."""
    rng = np.random.default_rng(0)
    entries = np.array([(i, t, 1) for i in range(40) for t in rng.choice(90, 30, replace=False)], np.int64)
    weights = rng.integers(0, 40_000_000_000, len(entries))
    tiles = lexical_rank.item_tiles(entries, weights, 40)
    assert max(len(parts) for _, _, parts in tiles) > 3
    impact = rng.integers(0, lexical_rank.IMPACT, (25, 90))
    want = np.zeros((25, 40), np.int64)
    for (i, t, _), w in zip(entries, weights):
        want[:, i] += impact[:, t] * w
    got = np.zeros((25, 40), np.int64)
    for first, size, parts in tiles:
        for names, dense in parts:
            assert dense.sum(axis=0).max() * lexical_rank.IMPACT < 2**53
            got[:, first:first + size] += (impact[:, names].astype(float) @ dense).astype(np.int64)
    assert (got == want).all()


def test_lengths_beyond_64_bits():
    n = np.array([1, 10**9, 3], np.int64)
    want = [25 + (75 * int(x) * 10**13) // 10**16 for x in n]
    assert lexical_rank.lengths_factor(n, 10**13, 10**16).tolist() == want
