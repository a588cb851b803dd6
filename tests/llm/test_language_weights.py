"""The label of a mixed text is the language of most of its letters, whatever their bytes."""

import random

from undertone.llm import language_id


def test_letters_count_alike_in_every_script(spark):
    rng = random.Random(2)
    words = {"en": ["the", "and", "with", "house", "thing", "water"], "ru": ["дом", "вода", "река", "вещь", "лес", "небо"]}

    def text(lang, letters):
        out = []
        while letters > 0:
            out.append(rng.choice([w for w in words[lang] if len(w) <= letters] or [words[lang][0][:letters]]))
            letters -= len(out[-1])
        return " ".join(out)

    rows = [(i, text(lang, 150), lang) for i, lang in enumerate(["en", "ru"] * 40)]
    mixed = {900: (260, 148), 901: (160, 140), 902: (140, 160), 903: (100, 200)}
    rows += [(i, text("en", a) + " " + text("ru", b), None) for i, (a, b) in mixed.items()]
    rows += rows[:3]
    frame = spark.createDataFrame([(*r, "x") for r in rows], "doc_id bigint, text string, lang string, lang_pred string")
    got = {r["doc_id"]: r for r in language_id.language_report(frame).collect()}
    for i, (a, b) in mixed.items():
        assert got[i]["lang_pred"] == ("en" if a > b else "ru")
        assert abs(got[i]["score"] - max(a, b) / (a + b)) < 0.02
