"""Decontamination against plain Python: words one by one, all windows, all pairs of windows."""

import random
from collections import defaultdict
from math import ceil

import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from undertone.llm import decontamination
from undertone.llm.common import pieces


def template_words(text):
    """(value, strict kind, loose kind, begins a sentence) of every template word."""
    out, after_end, after_number = [], True, False
    for word in text.split():
        core = decontamination.EDGES.sub("", word)
        if not core:
            continue
        low, ends = core.lower(), bool(decontamination.ENDS.search(word))
        glued = decontamination.GLUED.fullmatch(low)
        if glued:
            out += [(glued[1], "1", "1", after_end), (glued[2], "3", "3", False)]
            after_end, after_number = ends, False
            continue
        number = bool(decontamination.NUMERIC.fullmatch(low))
        unit = after_number and low in decontamination.UNITS and low not in decontamination.GLUED_ONLY
        loose = "1" if number else "3" if unit else "2" if core[0].isupper() else "0"
        out.append((low, "0" if loose == "2" and after_end else loose, loose, after_end))
        after_end, after_number = ends, number
    return out


def all_windows(text, size_of):
    """(template, first, values, slots) of all windows with enough literal words."""
    words = template_words(text)
    found = set()

    def cut(template, items, named=False):
        size = size_of(len(items))
        for at in range(len(items) - size + 1 if size else 0):
            part = items[at:at + size]
            if sum(kind == "0" for _, kind in part) < 4 or named and all(kind != "2" for _, kind in part):
                continue
            found.add((template, at, tuple(value if kind == "0" else kind for value, kind in part),
                       tuple(kind + value for value, kind in part if kind != "0")))

    cut(0, [(v, "0" if k == "2" else k) for v, k, _, _ in words])
    cut(0, [(v, k) for v, k, _, _ in words], True)
    if any(loose in "12" for _, _, loose, _ in words):
        runs = []
        for k, (value, _, loose, begins) in enumerate(words):
            if k and loose in "12" and loose == words[k - 1][2] and not begins:
                runs[-1] = (f"{runs[-1][0]} {value}", loose)
            else:
                runs.append((value, loose))
        cut(1, runs)
    return found


def own_size(length):
    return min(8, length) if length >= 4 else 0


def leaked(doc, item):
    """Whether an item that has template windows is in a document, and whether all slots are the item's."""
    theirs = all_windows(item, own_size)
    found, same = False, False
    for template in (0, 1):
        lanes = defaultdict(list)
        for t, at, values, slots in theirs:
            for t2, at2, values2, slots2 in all_windows(doc, lambda n: len(values) if n >= len(values) else 0):
                if t == t2 == template and values == values2:
                    hit = (at, len(values), slots, slots2)
                    band = (at2 - at) // decontamination.SLACK
                    for lane in (("one", at2 - at), ("band", band), ("band", band - 1)):
                        lanes[lane].append(hit)
        total = len({at for t, at, _, _ in theirs if t == template})
        for (kind, _), hits in lanes.items():
            pairs = {p for _, _, a, b in hits for p in zip(a, b)}
            if len({a for a, _ in pairs}) < len(pairs):
                continue
            places, size = sorted({h[0] for h in hits}), hits[0][1]
            least = min(6, ceil(total / 2))
            covered = len({p + k for p in places for k in range(size)})
            if len(places) >= least or kind == "band" and covered >= size + least - 1:
                found, same = True, same or all(a == b for a, b in pairs)
    return found, same


WORDS = "the of apples pears Tom Mary Ann Paris buys sells 3 7 12 120km 5 km kg in a three four hours. Then 20% $5 twenty-one -- many more left today who has".split()


def random_text(rng, n):
    return " ".join(rng.choice(WORDS) for _ in range(n))


def altered(rng, text):
    words = text.split()
    for _ in range(rng.randrange(4)):
        words[rng.randrange(len(words))] = rng.choice(WORDS)
    if rng.random() < 0.3:
        words.insert(rng.randrange(len(words)), rng.choice(WORDS))
    return " ".join(words)


def test_windows_against_one_word_at_a_time(spark):
    rng = random.Random(5)
    texts = [random_text(rng, rng.randrange(1, 40)) for _ in range(120)] + ["", None, "-- ?"]
    frame = spark.createDataFrame(list(enumerate(texts)), "item_id bigint, text string").repartition(3)
    got = decontamination.template_windows(decontamination.keyed(frame, "item_id"), 8).filter(F.col("_template") < 2).collect()
    found, values_of = defaultdict(set), defaultdict(set)
    want = {(i, t, at, slots): values for i, text in enumerate(texts) for t, at, values, slots in all_windows(text or "", own_size)}
    for r in got:
        key = (r["_owner"], r["_template"], r["_at"], tuple(r["_slots"]))
        found[key].add(r["_hash"])
        values_of[r["_hash"]].add((r["_template"], want.get(key)))
    assert found.keys() == want.keys() and all(len(h) == 1 for h in found.values())
    assert all(len(v) == 1 for v in values_of.values())
    assert len(values_of) == len({(t, v) for (_, t, _, _), v in want.items()})


def test_leaks_against_all_pairs_of_windows(spark):
    rng = random.Random(8)
    items = [t for t in (random_text(rng, rng.randrange(9, 24)) for _ in range(30)) if all_windows(t, own_size)]
    docs = [f"{random_text(rng, 12)} {altered(rng, rng.choice(items))} {random_text(rng, 12)}" for _ in range(90)]
    got = decontamination.leak_report(
        spark.createDataFrame(list(enumerate(docs)), "doc_id bigint, text string").repartition(4),
        spark.createDataFrame(list(enumerate(items)), "item_id bigint, text string"))
    want = {(d, i): leaked(doc, item) for d, doc in enumerate(docs) for i, item in enumerate(items)}
    assert {(r.doc_id, r.item_id): r.same_slots for r in got.collect()} == {k: same for k, (found, same) in want.items() if found}
    assert 20 < sum(found for found, _ in want.values())


@pytest.mark.parametrize("change", [("120km", "450km"), ("120km", "450 km"), ("three", "four"), ("three", "17"), ("120km", "7-miles")])
def test_glued_units_and_number_words_are_slots(spark, change):
    item = "a train travels 120km in three hours toward the distant coast without any stop on its way"
    docs = spark.createDataFrame([(1, f"Well then: {item.replace(*change)}"), (2, "a train travels far")], "doc_id bigint, text string")
    benchmark = spark.createDataFrame([(1, item)], "item_id bigint, text string")
    got = decontamination.leak_report(docs, benchmark).collect()
    assert [(r.doc_id, r.item_id, r.same_slots) for r in got] == [(1, 1, False)]


def test_short_words_after_a_number_stay_literal():
    kinds = [kind for _, kind, _, _ in template_words("there are 5 in the box and 5km to go")]
    assert kinds == list("00100001300")
    facts = decontamination.Kinds()
    rows, owner = facts.rows([b"there are 5 in the box and 5km to go", None])
    assert "".join(map(str, facts.template(rows, owner)[1])) == "".join(kinds)


def test_long_texts_and_a_full_cache_change_nothing(spark, monkeypatch):
    rng = random.Random(3)
    item = "gardeners know that roses want plenty of water before noon when summers grow hot and dry"
    long = " ".join(f"w{rng.randrange(10**6)}" for _ in range(20_000))
    docs = [(i, f"{long} {item if i % 2 else ''} {long}") for i in range(20)]
    frame = spark.createDataFrame(docs, "doc_id bigint, text string").coalesce(1)
    benchmark = spark.createDataFrame([(1, item)], "item_id bigint, text string")
    assert sorted(r.doc_id for r in decontamination.leak_report(frame, benchmark).collect()) == list(range(1, 20, 2))
    monkeypatch.setattr(decontamination, "CACHE_BYTES", 1000)
    facts = decontamination.Kinds()
    for _ in range(3):
        rows, owner = facts.rows([item.encode(), long.encode()])
        assert [facts.core(r) for r in rows[owner == 0]] == item.split()


def test_pieces_of_a_batch_are_bounded_and_whole():
    texts = [b"x" * n for n in (0, 5, 900, 20, 3000, 1, 1)] + [None, b"y" * 400]
    batch = pa.record_batch({"id": list(range(9)), "text": texts})
    cut = list(pieces(batch, 1000))
    assert pa.Table.from_batches(cut).to_pylist() == batch.to_pylist()
    assert all(p.num_rows == 1 or sum(len(t or b"") for t in p["text"].to_pylist()) <= 1000 for p in cut) and len(cut) > 2
    assert list(pieces(batch.slice(0, 0), 10)) == [batch.slice(0, 0)] and len(list(pieces(batch, 10_000))) == 1
