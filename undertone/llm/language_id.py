"""Language identification with spans.

The script of a word (by code point ranges) narrows the languages that may have written it; hashed
byte trigrams score the word under each of them; a Viterbi pass over the words, with a penalty for
switching the language, labels spans. The language with most letters is the document's, and its
share of the letters is the score.

Most texts never switch. That is proved, without a pass over the words one by one, by the best
gain any stretch of words could have under another language: at most half a penalty means that no
path with a switch beats the path without. Other texts go through the Viterbi pass, all texts of
a batch side by side.
"""

import re

import numpy as np
from pyspark.sql import DataFrame, functions as F

from undertone.llm.common import map_batches

BUCKETS = 1 << 16
SWITCH_PENALTY = 15.0
LEAST_SCRIPT_SHARE = 0.01
CACHE = 1_000_000
UNKNOWN = "und"
WORD = re.compile(r"[^\W\d_]+")
# First code points of script ranges. A range lasts until the next one.
SCRIPTS = [
    (0x0000, "Latin"), (0x0370, "Greek"), (0x0400, "Cyrillic"), (0x0530, "Armenian"), (0x0590, "Hebrew"),
    (0x0600, "Arabic"), (0x0900, "Devanagari"), (0x0980, "Bengali"), (0x0A00, "Gurmukhi"), (0x0A80, "Gujarati"),
    (0x0B00, "Oriya"), (0x0B80, "Tamil"), (0x0C00, "Telugu"), (0x0C80, "Kannada"), (0x0D00, "Malayalam"),
    (0x0D80, "Sinhala"), (0x0E00, "Thai"), (0x0E80, "Lao"), (0x0F00, "Tibetan"), (0x1000, "Myanmar"),
    (0x10A0, "Georgian"), (0x1100, "Hangul"), (0x1200, "Ethiopic"), (0x1780, "Khmer"), (0x1800, "Mongolian"),
    (0x1E00, "Latin"), (0x1F00, "Greek"), (0x2000, "Other"), (0x3040, "Kana"), (0x3100, "Han"),
    (0xAC00, "Hangul"), (0xD800, "Other"), (0xF900, "Han"), (0xFB00, "Latin"), (0xFB1D, "Hebrew"),
    (0xFB50, "Arabic"), (0xFE70, "Arabic"), (0xFF00, "Latin"), (0xFF66, "Kana"), (0x10000, "Other"), (0x20000, "Han"),
]
NAMES = sorted({name for _, name in SCRIPTS})
STARTS = np.array([start for start, _ in SCRIPTS])
SCRIPT_OF_RANGE = np.array([NAMES.index(name) for _, name in SCRIPTS])


def words_of(text: str) -> list:
    return WORD.findall(text.lower())


def trigrams(words):
    """(bucket of the trigram around every byte, first position of every word)."""
    encoded = [w.encode("utf-8", "replace") for w in words]
    data = np.frombuffer(b"\0" + b"\0".join(encoded) + b"\0", np.uint8)
    sizes = np.fromiter(map(len, encoded), np.int64, len(encoded))
    inside = np.flatnonzero(data[1:-1]) + 1
    wide = data.astype(np.uint32)
    code = (wide[inside - 1] << np.uint32(16)) | (wide[inside] << np.uint32(8)) | wide[inside + 1]
    buckets = (code * np.uint32(2654435761)) >> np.uint32(16)
    return buckets.astype(np.int64), np.concatenate([[0], np.cumsum(sizes)[:-1]]), sizes


def scripts_of(words):
    first = np.fromiter((ord(w[0]) for w in words), np.int64, len(words))
    return SCRIPT_OF_RANGE[np.searchsorted(STARTS, first, "right") - 1]


class Model:
    """Trigram log probabilities per language, and which scripts a language is written in."""

    def __init__(self, languages, table=None, writes=None):
        self.languages, self.table, self.writes = languages, table, writes

    @classmethod
    def of_counts(cls, languages, counts, scripts):
        smooth = counts + 0.5
        share = scripts / np.maximum(scripts.sum(0), 1)
        return cls(languages, np.log(smooth / smooth.sum(0)).astype(np.float32), share >= LEAST_SCRIPT_SHARE)

    def score(self, words):
        """Log probability of each word under each language, and the letters of each word."""
        buckets, starts, _ = trigrams(words)
        scores = np.add.reduceat(self.table[buckets], starts, axis=0)
        allowed = self.writes[scripts_of(words)]
        # Words of a script no language uses say nothing.
        known = allowed.any(1)
        scores = np.where(allowed, scores, scores.min(1, keepdims=True) - 50)
        letters = np.fromiter(map(len, words), np.int64, len(words))
        return np.where(known[:, None], scores, 0).astype(np.float32), letters


class Words(dict):
    """Word -> row of a table of scores; new words wait until ``settle``."""

    def __init__(self, model):
        super().__init__()
        self.model, self.waiting = model, []
        self.scores = np.zeros((0, len(model.languages)), np.float32)
        self.sizes = np.zeros(0, np.int64)

    def __missing__(self, word):
        self.waiting.append(word)
        row = self[word] = len(self)
        return row

    def settle(self):
        if self.waiting:
            scores, sizes = self.model.score(self.waiting)
            self.scores, self.sizes = np.concatenate([self.scores, scores]), np.concatenate([self.sizes, sizes])
            self.waiting = []


def switches_never(scores, best, penalty):
    """True if no stretch of words gains more than half a penalty under another language."""
    gains = np.cumsum(scores - scores[:, best:best + 1], axis=0, dtype=np.float64)
    lowest = np.minimum.accumulate(np.concatenate([np.zeros((1, gains.shape[1])), gains[:-1]]), axis=0)
    return (gains - lowest).max() <= penalty / 2


def viterbi(texts, penalty):
    """Best language per word for each array of scores, all arrays side by side."""
    order = sorted(range(len(texts)), key=lambda i: -len(texts[i]))
    sizes = np.array([len(texts[i]) for i in order])
    offsets = np.concatenate([[0], np.cumsum(sizes)[:-1]])
    flat = np.concatenate([texts[i] for i in order]).astype(np.float64)
    languages = flat.shape[1]
    back = np.zeros((len(flat), languages), np.int16)
    value = flat[offsets].copy()
    own = np.arange(languages)
    active = [int(np.searchsorted(-sizes, -t, "left")) for t in range(sizes[0] + 1)]
    for t in range(1, sizes[0]):
        n = active[t]
        here = offsets[:n] + t
        now = value[:n]
        top = now.argmax(1)
        jump = now[np.arange(n), top][:, None] - penalty
        stay = now >= jump
        back[here] = np.where(stay, own, top[:, None])
        value[:n] = np.where(stay, now, jump) + flat[here]
    label = value.argmax(1)
    path = np.zeros(len(flat), np.int64)
    path[offsets + sizes - 1] = label
    for t in range(sizes[0] - 1, 0, -1):
        n = active[t]
        here = offsets[:n] + t
        path[here - 1] = back[here, path[here]]
    out = [None] * len(texts)
    for k, i in enumerate(order):
        out[i] = path[offsets[k]:offsets[k] + sizes[k]]
    return out


def label_texts(texts, words: Words, penalty=SWITCH_PENALTY):
    """(language, score, spans) per text; spans are (start, end, language) in code points."""
    model = words.model
    if len(words) > CACHE:
        words.clear()
        words.__init__(model)
    rows = [np.fromiter(map(words.__getitem__, words_of(t)), np.int64) if t and model.languages else () for t in texts]
    words.settle()
    out, mixed_at, mixed_scores = [(UNKNOWN, 0.0, [])] * len(texts), [], []
    for i, row in enumerate(rows):
        if len(row):
            scores = words.scores[row]
            best = int(scores.sum(0, dtype=np.float64).argmax())
            if switches_never(scores, best, penalty):
                out[i] = (model.languages[best], 1.0, [(0, len(texts[i]), model.languages[best])])
            else:
                mixed_at.append(i)
                mixed_scores.append(scores)
    if mixed_at:
        for i, path in zip(mixed_at, viterbi(mixed_scores, penalty)):
            letters = np.bincount(path, words.sizes[rows[i]], len(model.languages))
            best = int(letters.argmax())
            out[i] = (model.languages[best], float(letters[best] / letters.sum()), spans_of(texts[i], path, model.languages))
    return out


def spans_of(text, path, languages):
    """Spans of words with one label; a span ends where the next one starts."""
    text = text if len(text.lower()) == len(text) else text.lower()
    borders = np.concatenate([[0], np.flatnonzero(np.diff(path)) + 1])
    wanted, starts = set(borders.tolist()), []
    for k, match in enumerate(WORD.finditer(text.lower())):
        if k in wanted:
            starts.append(match.start() if k else 0)
    ends = [*starts[1:], len(text)]
    return [(s, e, languages[path[b]]) for s, e, b in zip(starts, ends, borders)]


def remainder(column="doc_id"):
    return F.crc32(F.col(column).cast("string").cast("binary")) % 4


def learnable(docs: DataFrame) -> DataFrame:
    """Rows a model may learn from: a text, a language, and an id outside the held-out quarter."""
    return docs.filter(F.col("text").isNotNull() & F.col("lang").isNotNull() & (remainder() != 2)).select(
        F.col("doc_id").alias("_id"), F.col("lang").cast("string").alias("_lang"), F.col("text").cast("binary").alias("_text"))


def train(labelled: DataFrame, per_language: int = 1500) -> Model:
    """A model from about ``per_language`` rows of each language, chosen by the hash of their id.

    That bound is the classifier's sample, the same at any size of the corpus. The model has 65,536
    numbers a language. ``labelled`` has _id, _lang, _text (see ``learnable``); without any row the
    model knows no language.
    """
    counts = {r["_lang"]: r["n"] for r in labelled.groupBy("_lang").agg(F.count(F.lit(1)).alias("n")).collect()}
    languages = sorted(counts)
    if not languages:
        return Model([])
    places = {lang: i for i, lang in enumerate(languages)}
    scale = 1 << 30
    below = F.create_map(*[F.lit(x) for lang in languages for x in (lang, int(scale * min(1.0, per_language / counts[lang])))])
    sample = labelled.filter(F.pmod(F.xxhash64("_id"), F.lit(scale)) < below[F.col("_lang")])

    def count(batch):
        rows = {}
        for lang, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
            words = words_of(text.decode("utf-8", "replace"))
            if words:
                grams, letters = rows.setdefault(lang, (np.zeros(BUCKETS, np.int64), np.zeros(len(NAMES), np.int64)))
                grams += np.bincount(trigrams(words)[0], minlength=BUCKETS)
                letters += np.bincount(scripts_of(words), minlength=len(NAMES))
        for lang, (grams, letters) in rows.items():
            whole = np.concatenate([grams, letters])
            used = np.flatnonzero(whole)
            yield {"_lang": [lang] * len(used), "_feature": used, "_n": whole[used]}

    features = map_batches(sample.select("_lang", "_text"), count, "_lang string, _feature bigint, _n bigint")
    # At most languages x (buckets + scripts) rows.
    totals = np.zeros((BUCKETS + len(NAMES), len(languages)))
    for r in features.groupBy("_lang", "_feature").agg(F.sum("_n").alias("n")).toLocalIterator():
        totals[r["_feature"], places[r["_lang"]]] = r["n"]
    return Model.of_counts(languages, totals[:BUCKETS], totals[BUCKETS:])


def with_language(docs: DataFrame, model: Model, penalty=SWITCH_PENALTY) -> DataFrame:
    """``docs`` plus _language, _language_score and _language_spans. Only the text is looked at."""
    import pyarrow as pa
    from pyspark.sql import types as T

    shared = docs.sparkSession.sparkContext.broadcast((model.languages, model.table, model.writes))
    span = T.StructType([T.StructField("start", T.IntegerType()), T.StructField("end", T.IntegerType()), T.StructField("lang", T.StringType())])
    schema = T.StructType([*docs.schema.fields, T.StructField("_language", T.StringType()),
                           T.StructField("_language_score", T.DoubleType()), T.StructField("_language_spans", T.ArrayType(span))])
    place, words = docs.columns.index("text"), []
    span_type = pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32()), ("lang", pa.string())]))

    def label(batch):
        if not words:
            words.append(Words(Model(*shared.value)))
        # Words that a text cannot hold as text fall back to replacement characters.
        texts = [None if t is None else t.decode("utf-8", "replace") for t in batch.column(place).cast(pa.binary()).to_pylist()]
        labels = label_texts(texts, words[0], penalty)
        spans = [[{"start": s, "end": e, "lang": lang} for s, e, lang in one] for _, _, one in labels]
        columns = [*batch.columns, pa.array([x[0] for x in labels], pa.string()),
                   pa.array([x[1] for x in labels], pa.float64()), pa.array(spans, span_type)]
        yield pa.RecordBatch.from_arrays(columns, names=[f.name for f in schema])

    return map_batches(docs, label, schema)


def language_report(docs: DataFrame, per_language: int = 1500, penalty: float = SWITCH_PENALTY) -> DataFrame:
    """doc_id, held_out, lang_pred, score and n_spans of every row.

    The model learns from texts and languages of rows outside the held-out quarter. A null text or
    one without letters is ``und`` with score 0 and no spans; so is everything if nothing can be
    learned. A null id is not held out and teaches nothing. Ties go to the language first in
    code point order. Repeated rows get the same label; an empty table gives an empty result.
    """
    model = train(learnable(docs), per_language)
    labelled = with_language(docs.select("doc_id", "text"), model, penalty)
    return labelled.select(
        "doc_id", F.coalesce(remainder() == 2, F.lit(False)).alias("held_out"), F.col("_language").alias("lang_pred"),
        F.col("_language_score").alias("score"), F.size("_language_spans").alias("n_spans"))


def keep_identified(docs: DataFrame, least_score: float = 0.5, **options) -> DataFrame:
    """Rows whose language is known: not ``und``, and at least ``least_score`` of the letters in one language.

    Null texts and those without letters go; repeated rows stay or go together. Columns may have any
    names. Without labelled rows nothing is known, so nothing stays; an empty table stays empty.
    """
    # Columns of docs may have any name but ``text``, so they go under numbers meanwhile.
    rows = docs.toDF(*["text" if c == "text" else f"column_{k}" for k, c in enumerate(docs.columns)])
    labelled = with_language(rows, train(learnable(docs), **options))
    known = labelled.filter((F.col("_language") != UNKNOWN) & (F.col("_language_score") >= least_score))
    return known.select(*rows.columns).toDF(*docs.columns)
