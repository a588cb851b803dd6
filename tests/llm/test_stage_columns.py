"""The filters of the pipeline keep columns of any name, and rows of any kind."""

import random

from undertone.llm import decontamination, language_id, signature_tree

WORDS = {"en": "the and with house thing water over under".split(), "de": "der und mit haus ding wasser auf unter".split()}
NAMES = ["_k", "_kt", "_key", "_language", "_leak_id", "_row", "_own_id", "column_0"]


def test_filters_keep_columns_of_any_name(spark):
    rng = random.Random(2)

    def text(lang, n):
        return " ".join(rng.choice(WORDS[lang]) + str(rng.randrange(50)) * (rng.random() < 0.3) for _ in range(n))

    item = "gardeners know that roses want plenty of water before noon when summers grow hot and dry"
    texts = [(i, text(lang, 40), lang) for i, lang in enumerate(["en", "de"] * 30)]
    long, copy = text("en", 20_000), texts[4][1]
    texts += [(100, copy, "en"), (101, f"{text('en', 20)} {item} {text('en', 20)}", "en"), (102, None, "en"), (103, "", "de"), (104, "12 34", "en"),
              (105, long, "en"), (105, long, "en"), (None, text("de", 30), "de")]
    docs = spark.createDataFrame([(*t, *[f"{k}-{n}" for n in NAMES]) for k, t in enumerate(texts)],
                                 ", ".join(["doc_id bigint", "text string", "lang string", *[f"{n} string" for n in NAMES]]))
    benchmark = spark.createDataFrame([(1, item)], "item_id bigint, text string")
    whole = {tuple(r) for r in docs.collect()}
    known = language_id.keep_identified(docs)
    single = signature_tree.keep_one_each(known)
    clean = decontamination.without_leaks(single, benchmark)
    want = [*range(60), 101, 105, 105, None]
    for got, ids in ((known, [*want, 100]), (single, [i for k, i in enumerate(want) if k != 61]), (clean, [*range(60), 105, None])):
        rows = got.collect()
        assert got.columns == docs.columns and {tuple(r) for r in rows} <= whole
        assert sorted(map(str, (r.doc_id for r in rows))) == sorted(map(str, ids))
    for keep in (language_id.keep_identified, signature_tree.keep_one_each, lambda d: decontamination.without_leaks(d, benchmark)):
        assert keep(docs.limit(0)).count() == 0
