"""The text operators against plain Python, on rows made to be difficult."""

import collections
import hashlib
import random
import zlib

import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F

from undertone.llm import (
    chat_format, components, decontamination, language_id, line_dedup, maxscore, mixing, sharding, signature_tree, token_counts, warc,
)

DOCS = "doc_id bigint, text string, lang string, source string, n_chars bigint, size int, shard string, score double"
WORDS = [f"{a}{b}" for a in "bdfgklmnprst" for b in ("a", "e", "i", "o", "u", "an", "er", "ing")]


def sentence(rng, n):
    return " ".join(rng.choice(WORDS) for _ in range(n))


@pytest.fixture(scope="module")
def texts():
    rng = random.Random(7)
    out = [None, "", " \t\n", "one", "one", "two  words", "A\nb\nA ", "ä ß 漢字 end", "İstanbul x"]
    base = sentence(rng, 120)
    for k in range(12):
        words = base.split()
        for _ in range(k):
            words[rng.randrange(len(words))] = rng.choice(WORDS)
        out.append(" ".join(words))
    out += [base] * 5 + [base.upper()] + [sentence(rng, rng.randrange(3, 80)) + "\nshared line of all" for _ in range(30)]
    return [*out, sentence(rng, 20_000)]


@pytest.fixture(scope="module")
def docs(spark, texts):
    rows = [(i, t, ["en", "de", None][i % 3], [None, "a", "b", "b", ""][i % 5], None, 1, "x", 0.5) for i, t in enumerate(texts)]
    # A null id, a repeated row and a repeated id with another text.
    rows += [(None, "null id", None, "a", None, 1, None, None), rows[10], (11, "another text of eleven", "en", "b", 1, 1, "x", 1.0)]
    return spark.createDataFrame(rows, DOCS)


@pytest.fixture(scope="module")
def no_docs(spark):
    return spark.createDataFrame([], DOCS)


def gathered(df, *columns):
    return [tuple(r[c] for c in columns) for r in df.collect()]


def jaccard_components(rows, size, percent):
    sets, inverted = [], collections.defaultdict(list)
    for text in rows:
        words = (text or "").encode().translate(bytes.maketrans(bytes(range(65, 91)), bytes(range(97, 123)))).split()
        n = min(size, len(words))
        sets.append({tuple(words[i:i + n]) for i in range(len(words) - n + 1)} if words else set())
    parent = list(range(len(rows)))

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i, s in enumerate(sets):
        shared = collections.Counter(o for g in s for o in inverted[g])
        for g in s:
            inverted[g].append(i)
        for o, k in shared.items():
            if 100 * k >= percent * (len(s) + len(sets[o]) - k):
                a, b = sorted((root(i), root(o)))
                parent[b] = a
    return [len(s) for s in sets], [root(i) for i in range(len(rows))]


@pytest.mark.parametrize("size,percent", [(4, 85), (5, 80)])
def test_jaccard_components(docs, size, percent):
    rows = gathered(docs, "doc_id", "text")
    sizes, roots = jaccard_components([t for _, t in rows], size, percent)
    least = collections.defaultdict(list)
    for (i, _), r in zip(rows, roots):
        least[r].append(i)
    want = collections.Counter(
        (i, n, i if not n else min((x for x in least[r] if x is not None), default=None)) for (i, _), n, r in zip(rows, sizes, roots))
    got = signature_tree.component_report(docs, size, percent)
    assert collections.Counter(gathered(got, "doc_id", "n_shingles", "component_id")) == want


def test_one_document_of_each_component_stays(docs, no_docs):
    kept = signature_tree.keep_one_each(docs)
    assert kept.columns == docs.columns
    rows = gathered(kept, "doc_id", "text")
    _, roots = jaccard_components([t for _, t in rows], 5, 80)
    assert len(set(roots)) == len(roots)
    bare = sum(not (t or "").split() for _, t in gathered(docs, "doc_id", "text"))
    assert sum(not (t or "").split() for _, t in rows) == bare
    assert signature_tree.keep_one_each(no_docs).count() == 0
    assert signature_tree.component_report(no_docs).count() == 0


def test_split_blocks_find_what_one_block_finds(spark, monkeypatch):
    rng = random.Random(3)
    passage = sentence(rng, 60)
    rows = [(i, sentence(rng, rng.randrange(5, 60)) + " " + passage + " " + sentence(rng, rng.randrange(5, 60))) for i in range(150)]
    rows += [(200 + i, rows[i][1].replace(rows[i][1].split()[0], "zz", 1)) for i in range(0, 150, 7)]
    frame = spark.createDataFrame(rows, "doc_id bigint, text string")
    monkeypatch.setattr(signature_tree, "BLOCK", 8)
    _, roots = jaccard_components([t for _, t in rows], 4, 70)
    want = {i: rows[r][0] for (i, _), r in zip(rows, roots)}
    assert dict(gathered(signature_tree.component_report(frame, 4, 70), "doc_id", "component_id")) == want


def test_texts_that_share_one_ngram_by_chance_meet_in_no_bucket(spark):
    rng = random.Random(4)
    words = lambda n: " ".join(f"w{rng.randrange(10**12)}" for _ in range(n))
    texts = [[] for _ in range(60)]
    for k in range(60):
        for step in range(1, 7):
            passage = words(5)
            for at in (k, (k + step) % 60):
                texts[at] += [passage, words(3)]
    rows = [(k, " ".join(text)) for k, text in enumerate(texts)]
    frame = spark.createDataFrame(rows, "doc_id bigint, text string")
    assert signature_tree.live_postings(signature_tree.profile(frame, 5, 10), 10).count() == 0


def test_what_a_pair_shares_in_its_own_and_in_larger_buckets_counts_together(spark):
    rng = random.Random(5)
    rows = []
    for _ in range(60):
        size = rng.randrange(6, 40)
        base = [f"b{rng.randrange(10**9)}" for _ in range(size)]
        near = list(base)
        near[rng.randrange(size)] = "other"
        rows += [base, near]
        for _ in range(rng.randrange(4)):
            at = rng.randrange(size)
            run = base[at:at + rng.randrange(4, 14)]
            rows.append([f"c{rng.randrange(10**9)}" for _ in range(rng.randrange(1, 30))] + run)
    rows = [(k, " ".join(words)) for k, words in enumerate(rows)]
    frame = spark.createDataFrame(rows, "doc_id bigint, text string").repartition(3)
    _, roots = jaccard_components([t for _, t in rows], 3, 60)
    want = {i: rows[r][0] for (i, _), r in zip(rows, roots)}
    assert len(set(want.values())) < len(rows)
    assert dict(gathered(signature_tree.component_report(frame, 3, 60), "doc_id", "component_id")) == want


def test_bounds_never_rule_out_a_similar_pair():
    rng = np.random.default_rng(1)
    for _ in range(200):
        pool = rng.integers(0, 2**63, 400).astype(np.uint64)
        x = np.unique(rng.choice(pool, rng.integers(1, 300)))
        y = np.unique(rng.choice(pool, rng.integers(1, 300)))
        common = len(np.intersect1d(x, y))
        percent = 100 * common // (len(x) + len(y) - common)
        if percent:
            a, b = (signature_tree.bitmap(s)[None, :] for s in (x, y))
            assert signature_tree.leaves_meet(len(x), a, len(y), b, percent)


def test_components_of_a_chain_and_a_star(spark):
    links = [(i, i + 1) for i in range(40)] + [(100, 100 + i) for i in range(1, 30)] + [(7, 7)]
    got = dict(gathered(components.connected_components(spark.createDataFrame(links, "a bigint, b bigint")), "node", "component"))
    assert got == {**{i: 0 for i in range(41)}, **{100 + i: 100 for i in range(30)}}


def test_shards_are_even_and_copies_meet(docs, no_docs):
    rows = sharding.shard_documents(docs, shards=5).collect()
    assert len(rows) == docs.count()
    by_shard = collections.defaultdict(list)
    for r in rows:
        by_shard[r.shard].append(r.slot)
    assert max(map(len, by_shard.values())) - min(map(len, by_shard.values())) <= 1
    assert all(sorted(s) == list(range(len(s))) for s in by_shard.values())
    places = collections.defaultdict(set)
    for r in rows:
        places[r.text_crc32, r.size].add(r.shard)
    copies = collections.Counter((r.text_crc32, r.size) for r in rows)
    assert all(len(places[k]) == 1 for k, n in copies.items() if 1 < n < 10 and k != (0, 8))
    texts = {i: t for i, t in gathered(docs, "doc_id", "text")}
    for r in rows:
        if r.doc_id not in (11, None):
            raw = (texts[r.doc_id] or "").encode()
            assert (r.size, r.text_crc32) == (len(raw) + 8, zlib.crc32(raw))
    assert sharding.shard_documents(no_docs).count() == 0


def test_a_group_larger_than_a_shard_fills_shards(spark):
    frame = spark.range(90).select(F.col("id").alias("doc_id"), F.when(F.col("id") < 40, "same").otherwise(F.col("id").cast("string")).alias("text"))
    rows = sharding.shard_documents(frame, shards=9).collect()
    assert {len([r for r in rows if r.shard == s]) for s in range(9)} == {10}
    assert len({r.shard for r in rows if r.group_rows == 40}) <= 7


def test_move_quotas_keep_capacities():
    rng = random.Random(5)
    for _ in range(100):
        wishes = {(s, t): rng.randrange(20) for s in range(4) for t in range(4) if s != t}
        room = [rng.randrange(-1, 6) for _ in range(4)]
        quotas = sharding.move_quotas(wishes, room)
        for t in range(4):
            into = sum(n for (_, to), n in quotas.items() if to == t)
            out = sum(n for (frm, _), n in quotas.items() if frm == t)
            assert into - out <= max(room[t], 0)
        assert all(0 <= n <= wishes[p] for p, n in quotas.items())


def targets(sizes, weights):
    """Share, cap, share the excess again until nobody is above."""
    total, capped = float(sum(sizes)), {}
    while True:
        free = [i for i in range(len(sizes)) if i not in capped]
        left, weight = total - sum(capped.values()), sum(weights[i] for i in free)
        over = [i for i in free if weight and left * weights[i] / weight > 3 * sizes[i]]
        if not over:
            return [capped.get(i, left * weights[i] / weight if weight else 0.0) for i in range(len(sizes))]
        capped |= {i: 3.0 * sizes[i] for i in over}


def test_mix_targets_and_copies(docs, no_docs):
    rows = mixing.mix_report(docs).collect()
    assert len(rows) == docs.count()
    assert all(0 <= r.taken <= 3 * r.size and r.taken == r.size * r.copies for r in rows)
    assert collections.Counter(map(tuple, rows)) == collections.Counter(map(tuple, mixing.mix_report(docs).collect()))
    mixed = mixing.mix_documents(docs)
    assert mixed.columns == docs.columns and mixed.count() == sum(r.copies for r in rows)
    sums = collections.defaultdict(int)
    for i, t, s in gathered(docs, "doc_id", "text", "source"):
        sums[s] += len((t or "").encode().split())
    order = sorted(sums, key=lambda s: (s is None, s or ""))
    want = dict(zip([sums[s] for s in order], targets([sums[s] for s in order], [i % 3 + 1 for i in range(len(order))])))
    assert all(abs(r.target - want[r.source_size]) < 1e-6 * max(1, r.target) for r in rows)
    assert mixing.mix_report(no_docs).count() == 0


@pytest.mark.parametrize("sizes", [[1, 1, 1000], [0, 0], [5, 100, 100, 1], [0, 10, 3]])
def test_targets_by_water_level(spark, sizes):
    frame = spark.createDataFrame([(f"s{i}", n) for i, n in enumerate(sizes)], "_source string, _size bigint")
    got = [r.target for r in mixing.source_targets(frame).orderBy("_source").collect()]
    assert got == pytest.approx(targets(sizes, [i % 3 + 1 for i in range(len(sizes))]))


def test_mix_keeps_columns_of_any_name(docs):
    names = ["target", "rate", "source_size", "_source", "_size", "_draw", "_copies", "_copy", "_of", "_row", "a.b"]
    wide = docs.withColumns({name: F.concat(F.lit(name), F.col("doc_id").cast("string")) for name in names})
    mixed = mixing.mix_documents(wide)
    assert mixed.columns == wide.columns
    plain = collections.Counter(map(tuple, mixing.mix_documents(docs).collect()))
    rows = mixed.collect()
    assert collections.Counter(tuple(r)[:len(docs.columns)] for r in rows) == plain
    assert all(r[name] == (None if r.doc_id is None else f"{name}{r.doc_id}") for r in rows for name in names)


def test_mix_comes_near_its_targets(spark):
    frame = spark.range(20_000).select(F.col("id").alias("doc_id"), F.lit("a b c").alias("text"), (F.col("id") % 7).cast("string").alias("source"))
    by_source = mixing.mix_report(frame).groupBy(F.col("doc_id") % 7)
    rows = by_source.agg(F.first("target").alias("target"), F.sum("taken").alias("taken")).collect()
    assert all(abs(r.taken - r.target) < 0.05 * r.target for r in rows)


def test_lines_of_many_documents_go(docs, no_docs):
    rows = gathered(docs, "doc_id", "text")
    held = collections.Counter(k for _, t in rows for k in {line_dedup.line_key(x) for x in (t or "").encode().split(b"\n")} if k)
    want = []
    for i, t in rows:
        lines = (t or "").encode().split(b"\n")
        kept = [x for x in lines if held[line_dedup.line_key(x)] < 10]
        want.append((i, len(lines), len(lines) - len(kept), hashlib.sha256(b"\n".join(kept)).hexdigest()))
    for batches, fanout in ((4, 3), (5, 2), (1, 3)):
        got = line_dedup.line_report(docs, batches=batches, fanout=fanout)
        assert collections.Counter(gathered(got, "doc_id", "n_lines", "n_dropped", "kept_sha256")) == collections.Counter(want)
    assert any(dropped for _, _, dropped, _ in want)
    assert line_dedup.line_report(no_docs).count() == 0


def test_tokens_as_the_library_counts_them(docs, no_docs):
    library = token_counts.load(public_tokenizers.path("byte_bpe_50k.json"))
    for i, n, tokens in gathered(token_counts.count_tokens(docs.filter("doc_id <> 11")), "doc_id", "n_bytes", "n_tokens"):
        text = {j: t for j, t in gathered(docs.filter("doc_id <> 11"), "doc_id", "text")}[i] or ""
        assert (n, tokens) == (len(text.encode()), len(library.encode(text, add_special_tokens=False).ids))
    assert token_counts.count_tokens(no_docs).count() == 0


def test_token_counter_on_odd_texts():
    path = public_tokenizers.path("byte_bpe_50k.json")
    counter, library = token_counts.Counter(path, token_counts.whole_tokens(path)), token_counts.load(path)
    rng = random.Random(2)
    odd = ["<|endoftext|>", " ", "\n", "\t", "'s", "'LL", "漢", "é", " ", " ", "1", "²", "x", "Ω", "\x1c", "\x85", "😀", "a", "!", "ǅ"]
    for _ in range(400):
        text = "".join(rng.choice(odd) for _ in range(rng.randrange(12)))
        assert counter(text) == len(library.encode(text, add_special_tokens=False).ids), repr(text)


def test_pattern_and_library_agree_on_known_code_points():
    import regex

    library = token_counts.load(public_tokenizers.path("byte_bpe_50k.json")).pre_tokenizer
    cut, known = regex.compile(token_counts.PATTERN).findall, regex.compile(token_counts.KNOWN).fullmatch
    for c in map(chr, range(0xD800)):
        if known(c):
            text = f"a{c}1 {c} !{c}"
            assert [x for x, _ in library.pre_tokenize_str(text)] == [token_counts.in_letters(x) for x in cut(text)], hex(ord(c))


def test_top_k_of_all_others(spark):
    rng = np.random.default_rng(4)
    rows = [(i, [float(x) for x in rng.normal(0, 0.2, 6)]) for i in range(700)]
    rows[40] = (40, rows[20][1])
    rows += [(900, None), (901, [None] * 6), (902, [float("nan")] * 6), (903, [float("inf")] * 6), (None, [0.1] * 6), (880, [0.3, -0.3]), (20, rows[20][1]), (860, [])]
    frame = spark.createDataFrame(rows, "vec_id bigint, embedding array<float>")
    sound = [(i, np.floor(64 * np.array(v, np.float32).astype(np.float64)).astype(int)) for i, v in rows
             if i is not None and v is not None and all(x is not None and np.isfinite(x) for x in v)]
    want = []
    for q in {i for i, _ in sound if i % 20 == 0}:
        best = {}
        for v in [v for i, v in sound if i == q]:
            for i, w in sound:
                if i != q:
                    n = min(len(v), len(w))
                    best[i] = max(best.get(i, -10**9), int((v[:n] * w[:n]).sum()))
        want += [(q, r + 1, i, s) for r, (i, s) in enumerate(sorted(best.items(), key=lambda x: (-x[1], x[0]))[:20])]
    assert sorted(gathered(maxscore.top_k(frame), "query_id", "rank", "vec_id", "score")) == sorted(want)
    assert maxscore.top_k(frame.limit(0)).count() == 0


def test_search_prunes_without_loss():
    rng = np.random.default_rng(8)
    vectors, queries = rng.integers(-40, 40, (3000, 16)), rng.integers(-40, 40, (25, 16))
    ids = rng.permutation(3000)
    q, found, scores = maxscore.search(np.arange(10_000, 10_025), queries, ids, vectors, 20)
    for k in range(25):
        whole = sorted(zip(-(vectors @ queries[k]), ids))[:20]
        assert list(zip(-scores[q == k].astype(int), found[q == k])) == whole


BENCHMARK = [
    (1, "A train leaves Berlin at 9 and travels 120 km in 3 hours toward the distant coast without any stop on its way"),
    (2, "short one"), (3, None), (4, ""), (5, "the quick brown fox jumps over that lazy dog while seven sleepy cats keep watching from the old wall")]


def test_leaks_and_new_versions_are_found(spark):
    filler = sentence(random.Random(1), 40)
    rows = [
        (1, f"{filler} {BENCHMARK[0][1].lower()} {filler}"),
        (2, f"{filler} A train leaves Madrid at 7 and travels 450 km in 5 hours toward the distant coast without any stop on its way"),
        (3, f"{filler} the quick brown fox jumps over that lazy dog, while seven sleepy cats keep watching"),
        (4, filler), (5, None), (6, ""), (7, "short one"), (8, "the quick brown fox " + filler), (None, BENCHMARK[4][1]), (3, filler)]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string")
    benchmark = spark.createDataFrame(BENCHMARK, "item_id bigint, text string")
    got = gathered(decontamination.leak_report(docs, benchmark), "doc_id", "item_id", "same_slots")
    assert sorted(got, key=str) == sorted([(1, 1, True), (2, 1, False), (3, 5, True), (None, 5, True)], key=str)
    left = gathered(decontamination.without_leaks(docs, benchmark), "doc_id", "text")
    assert sorted(left, key=str) == sorted([r for r in rows if r not in (rows[0], rows[1], rows[2], rows[8])], key=str)
    assert decontamination.leak_report(docs, benchmark.limit(0)).count() == 0
    assert decontamination.without_leaks(docs.limit(0), benchmark).count() == 0


def test_slots_must_be_consistent(spark):
    item = "if x has 5 apples and buys 7 pears then gives 5 apples away how many pears and apples remain here"
    docs = spark.createDataFrame([(1, item.replace("5", "8")), (2, item.replace("5", "8", 1))], "doc_id bigint, text string")
    benchmark = spark.createDataFrame([(1, item)], "item_id bigint, text string")
    assert gathered(decontamination.leak_report(docs, benchmark), "doc_id", "same_slots") == [(1, False)]


def test_renamed_subjects_and_inserted_words_are_found(spark):
    tom = "Tom has 5 apples. Tom buys 3 more apples. How many apples does Tom have now?"
    ann = tom.replace("5", "7").replace("3", "4")
    words = "gardeners know that roses want plenty of water before noon when summers grow hot and dry".split()
    filler = sentence(random.Random(12), 30)
    docs = spark.createDataFrame([
        (1, f"{filler}. {ann.replace('Tom', 'Sara')} {filler}"), (2, f"{filler}. {ann.replace('Tom', 'Mary Ann')}"),
        (3, f"{filler} {' '.join(words[:8])} surely {' '.join(words[8:])} {filler}"), (4, f"{filler}. {tom}"),
        # One subject under two names, half of an item, and both halves far from each other.
        (5, f"{filler}. {ann.replace('Tom', 'Sara', 2).replace('Tom', 'Ida')}"), (6, f"{filler} {' '.join(words[:8])} {filler}"),
        (7, f"{' '.join(words[:8])} {filler} {' '.join(words[8:])}")], "doc_id bigint, text string")
    benchmark = spark.createDataFrame([(1, tom), (2, " ".join(words))], "item_id bigint, text string")
    assert len(words) == 16
    got = gathered(decontamination.leak_report(docs, benchmark), "doc_id", "item_id", "same_slots")
    assert sorted(got) == [(1, 1, False), (2, 1, False), (3, 2, True), (4, 1, True)]
    assert sorted(r.doc_id for r in decontamination.without_leaks(docs, benchmark).collect()) == [5, 6, 7]


def test_items_without_a_template_window_are_found_exactly(spark):
    sum_, chinese, thai, year = "What is 12 * 7 + 3?", "小明有五个苹果，吃了两个，还剩几个？", "แมวกินปลากี่ตัวในวันนี้", "In 1990 12 km?"
    filler = sentence(random.Random(13), 30)
    docs = spark.createDataFrame([
        (1, f"{filler} {sum_} {filler}"), (2, f"{filler} What is 12 * 3 + 7? {filler}"), (3, f"{filler} what is 112 * 7 + 3"),
        (4, f"前面的话。{chinese}后面的话。"), (5, f"前面的话。{chinese.replace('五', '六')}后面的话。"), (6, f"ก่อน{thai}หลัง"), (7, filler + " " + year),
        # Both ends of an item, but not its middle nor the same distance.
        (8, f"{chinese[:16]}很好{chinese[2:]}"[:18] + chinese[-3:]), (9, "What is 12 * 7 + what is + 3?"), (10, None), (11, "?")], "doc_id bigint, text string")
    benchmark = spark.createDataFrame([(1, sum_), (2, chinese), (3, thai), (4, year), (5, "7?"), (6, None), (7, "* * * * *")], "item_id bigint, text string")
    got = gathered(decontamination.leak_report(docs, benchmark), "doc_id", "item_id", "same_slots")
    assert sorted(got) == [(1, 1, True), (4, 2, True), (6, 3, True), (7, 4, True)]
    assert sorted(r.doc_id for r in decontamination.without_leaks(docs, benchmark).collect()) == [2, 3, 5, 8, 9, 10, 11]


def test_languages(spark):
    rng = random.Random(6)
    languages = {"en": ["the", "and", "with", "house", "thing", "water"], "de": ["der", "und", "mit", "haus", "ding", "wasser"],
                 "ru": ["дом", "вода", "с", "и", "вещь", "река"]}

    def text(lang, n):
        return " ".join(rng.choice(languages[lang]) for _ in range(n))

    rows = [(i, text(lang, 30), lang) for i, lang in enumerate(["en", "de", "ru"] * 40)]
    rows += [(500, None, "en"), (501, "", "de"), (502, "123 !!", "en"), (None, text("de", 30), "en"), (503, text("en", 40) + " " + text("de", 90), None), (504, "漢字", None)]
    frame = spark.createDataFrame(rows, "doc_id bigint, text string, lang string")
    got = {r.doc_id: r for r in language_id.language_report(frame).collect()}
    assert all(got[i].lang_pred == lang and got[i].held_out == (zlib.crc32(str(i).encode()) % 4 == 2) for i, t, lang in rows[:120])
    assert {got[i].lang_pred for i in (500, 501, 502)} == {"und"} and not got[None].held_out and got[None].lang_pred == "de"
    assert got[503].lang_pred == "de" and got[503].n_spans == 2 and 0.5 < got[503].score < 0.9
    kept = language_id.keep_identified(frame)
    assert kept.columns == frame.columns and {500, 501, 502}.isdisjoint(r.doc_id for r in kept.collect())
    assert {r.lang_pred for r in language_id.language_report(frame.withColumn("lang", F.lit(None).cast("string"))).collect()} == {"und"}
    assert language_id.language_report(frame.limit(0)).count() == 0


def test_a_full_word_cache_changes_no_label(monkeypatch):
    rng = np.random.default_rng(3)
    model = language_id.Model.of_counts(
        ["a", "b", "c"], rng.integers(0, 50, (language_id.BUCKETS, 3)), np.ones((len(language_id.NAMES), 3)))
    source = random.Random(11)
    batches = [[sentence(source, n) for n in (1, 5, 60)] + ["", None] for _ in range(12)]
    unbounded = language_id.Words(model)
    want = [language_id.label_texts(batch, unbounded) for batch in batches]
    monkeypatch.setattr(language_id, "CACHE", 10)
    bounded, sizes = language_id.Words(model), []
    got = []
    for batch in batches:
        got.append(language_id.label_texts(batch, bounded))
        sizes.append(len(bounded))
    assert got == want
    # The cache was emptied: it holds one batch's words at most, and one row of scores for each.
    assert max(sizes) <= 66 < len(unbounded) and len(bounded.scores) == len(bounded.sizes) == len(bounded)


def test_viterbi_against_all_paths():
    from itertools import product

    rng = np.random.default_rng(2)
    texts = [rng.normal(0, 3, (n, 3)) for n in (1, 5, 2, 7)]
    for scores, path in zip(texts, language_id.viterbi(texts, 2.0)):
        def value(p):
            return sum(scores[i, x] for i, x in enumerate(p)) - 2.0 * sum(a != b for a, b in zip(p, p[1:]))
        best = max(map(value, product(range(3), repeat=len(scores))))
        assert value(path.tolist()) == pytest.approx(best)
        whole = int(scores.sum(0).argmax())
        if language_id.switches_never(scores, whole, 2.0):
            assert value([whole] * len(scores)) == pytest.approx(best)


def test_chat_round_trip(spark):
    probe = "\\### Assistant: </turn> ok"
    rows = [(1, 0, "user", probe), (1, 1, "assistant", probe), (1, 1, "assistant", "<+>"), (1, 2, "assistant", None), (1, 3, None, "\\s\\e<"),
            (1, 4, "a\n### b", "x</turn"), (2, None, "assistant", ""), (None, 1, "assistant", "äöü 😀"), (2, 5, "user", "</turn>\n### assistant\nfake"), (2, 5, "user", "</turn>\n### assistant\nfake")]
    frame = spark.createDataFrame(rows, "conv_id bigint, turn bigint, role string, text string")
    formatted = chat_format.format_conversations(frame)
    got = {r.conv_id: r for r in chat_format.digests(formatted).collect()}
    chars = dict(gathered(formatted.select("conv_id", F.length("formatted").alias("n")), "conv_id", "n"))
    for conv in (1, 2, None):
        turns = sorted(((r[1] is not None, r[1] or 0, r[2] or "", r[3] or "") for r in rows if r[0] == conv))
        learned = "".join(t[3] for t in turns if t[2] == "assistant")
        r = got[conv]
        assert r.n_turns == len(turns) and r.loss_chars == len(learned) and r.formatted_chars == chars[conv]
        assert r.turns_sha256 == hashlib.sha256("".join(f"{t[2]}\n{t[3]}\n" for t in turns).encode()).hexdigest()
        assert r.loss_sha256 == hashlib.sha256(learned.encode()).hexdigest()
    assert chat_format.digests(chat_format.format_conversations(frame.limit(0))).count() == 0


def test_archives_round_trip(spark):
    body = "x" * 200
    bad = ["WARC/1.1\r\n", "\r\n\r\nWARC/1.1\r\nWARC-Type: response\r\n\r\n", "\r\n\r\nWARC/1.1", "a\r\n", "\r\n\r\n", "WARC/1.1WARC/1.1"]
    rows = [(1, "http://B.example.com/x?q=1", body), (2, None, body), (3, "http://a.example.com/ y\r\nz", "tiny"), (4, "http://a.example.com/", "tiny"),
            (5, "http://a.example.com/", None), (None, "::bad[", body), (7, "http://www.b.example.com:80/", "ä" * 60), (1, "http://b.example.com/x", body), (-5, "http://c", "ä" * 60)]
    rows += [(20 + i, f"http://m.example.com/{i}", b) for i, b in enumerate(bad)] + [(40 + i, "http://m.example.com/", b * 40) for i, b in enumerate(bad)]
    frame = spark.createDataFrame(rows, "page_id bigint, url string, html string").repartition(3)
    got = warc.archive_pages(frame, range_rows=5).collect()
    first = {}
    for i, _, html in rows:
        raw = (html or "").encode()
        if len(raw) >= 100 and i is not None:
            first[raw] = min(i, first.get(raw, i))
    want = []
    for i, _, html in rows:
        raw = (html or "").encode()
        refers = first.get(raw) if first.get(raw) != i else None
        want.append((i, len(raw), hashlib.sha256(raw).hexdigest(), "revisit" if refers is not None else "response", refers))
    assert collections.Counter((r.page_id, r.payload_bytes, r.payload_digest, r.record_type, r.refers_to) for r in got) == collections.Counter(want)
    ordered = [(r.url_key, r.captured, r.page_id is not None, r.page_id or 0) for r in sorted(got, key=lambda r: (r.range_no, r.place))]
    assert ordered == sorted(ordered) and len({r.range_no for r in got}) > 2
    assert warc.archive_pages(frame.limit(0)).count() == 0


def test_loser_tree_merges_any_runs():
    rng = random.Random(9)
    for k in range(9):
        runs = [sorted(rng.randrange(30) for _ in range(rng.randrange(6))) for _ in range(k)]
        assert list(warc.LoserTree(runs)) == sorted(x for r in runs for x in r)


def test_damaged_records_are_told():
    good = warc.record(1, "http://a", b"payload", hashlib.sha256(b"payload").hexdigest(), None)
    assert warc.parse(good + warc.GAP)["payload_bytes"] == 7
    for broken in (good[:-3], good.replace(b"payload", b"paxload"), good + b"more"):
        with pytest.raises(ValueError):
            warc.parse(broken)
