"""Token counts with a whole-token shortcut.

Byte-level BPE cuts a text into pre-tokens and merges the bytes of each. Which vocabulary strings
come out as a single token is proved once, on the driver, by encoding every one of them with the
library. In the tasks a pre-token that is such a string counts as one, with a set lookup; only the
rest is merged, by the library's own BPE model, once per distinct pre-token of a task.

Characters that this module's pattern and the library might class differently (anything beyond the
ranges in ``KNOWN``) send the whole text to the library instead.
"""

import json

import public_tokenizers
import regex
from pyspark.sql import DataFrame, functions as F

from undertone.llm.common import map_batches

# The pre-token pattern of byte_bpe_50k.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
# Code points on whose classes both sides agree; a test goes through all of them.
KNOWN = r"[\x00-\x1b\x20-ɏΑ-ΡΣ-ϿА-я‐-‧一-龥ぁ-ゖ]"
CACHE = 1_000_000
RESULT_SCHEMA = "doc_id bigint, n_bytes bigint, n_tokens bigint, over_limit boolean"


def byte_letters():
    """Byte-level BPE writes each byte as a printable character: itself, or the next free one from 256."""
    printable = [*range(33, 127), *range(161, 173), *range(174, 256)]
    others = [b for b in range(256) if b not in set(printable)]
    return {**{b: chr(b) for b in printable}, **{b: chr(256 + i) for i, b in enumerate(others)}}


LETTERS = byte_letters()


def in_letters(text: str) -> str:
    return text.encode("utf-8").decode("latin-1").translate(LETTERS)


def load(path: str):
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(path)
    tokenizer.no_truncation()
    tokenizer.no_padding()
    return tokenizer


def special_strings(path: str) -> list:
    with open(path, encoding="utf-8") as file:
        return [t["content"] for t in json.load(file).get("added_tokens", [])]


def whole_tokens(path: str) -> frozenset:
    """Vocabulary strings that the library encodes, alone, as exactly one token.

    The vocabulary bounds the set; strings that are no valid text, or that the pattern would cut,
    can never be met as a pre-token and are left out.
    """
    tokenizer, cut = load(path), regex.compile(PATTERN)
    back = {ord(letter): b for b, letter in LETTERS.items()}
    texts = []
    for token in tokenizer.get_vocab():
        try:
            text = bytes(back[ord(c)] for c in token).decode("utf-8")
        except (KeyError, UnicodeDecodeError):
            continue
        if cut.fullmatch(text) and cut.findall(text) == [text]:
            texts.append(text)
    encoded = tokenizer.encode_batch(texts, add_special_tokens=False)
    return frozenset(t for t, e in zip(texts, encoded) if len(e.ids) == 1)


class Counter:
    """Counts the tokens of texts as the library would."""

    def __init__(self, path: str, whole: frozenset):
        self.library, self.special = load(path), special_strings(path)
        self.model = self.library.model
        self.pieces = regex.compile(PATTERN).findall
        self.strange = regex.compile("[^" + KNOWN[1:]).search
        self.whole, self.known = whole, dict.fromkeys(whole, 1)

    def __call__(self, text: str) -> int:
        if not text:
            return 0
        if self.strange(text) or any(s in text for s in self.special):
            return len(self.library.encode(text, add_special_tokens=False).ids)
        known, total = self.known, 0
        for piece in self.pieces(text):
            count = known.get(piece)
            if count is None:
                count = self.merge(piece)
            total += count
        return total

    def merge(self, piece: str) -> int:
        if len(self.known) > CACHE + len(self.whole):
            self.known = dict.fromkeys(self.whole, 1)
        count = self.known[piece] = len(self.model.tokenize(in_letters(piece)))
        return count


def count_tokens(docs: DataFrame, tokenizer: str = "byte_bpe_50k.json", limit: int = 512) -> DataFrame:
    """doc_id, n_bytes (UTF-8), n_tokens and over_limit (more than ``limit`` tokens) of every row.

    Special strings inside texts are special tokens, as the library does by default; none are added.
    A null text is empty: no bytes, no tokens. Repeated rows and null ids are rows like any other;
    an empty table gives an empty result. ``tokenizer`` names a file every machine has.
    """
    shared = docs.sparkSession.sparkContext.broadcast(whole_tokens(public_tokenizers.path(tokenizer)))
    counters = {}

    def count(batch):
        if tokenizer not in counters:
            counters[tokenizer] = Counter(public_tokenizers.path(tokenizer), shared.value)
        counter, sizes, tokens = counters[tokenizer], [], []
        for text in batch.column(1).to_pylist():
            text = text or b""
            sizes.append(len(text))
            tokens.append(counter(text.decode("utf-8", "replace")))
        yield {"doc_id": batch.column(0), "n_bytes": sizes, "n_tokens": tokens, "over_limit": [t > limit for t in tokens]}

    rows = docs.select(F.col("doc_id").cast("bigint").alias("_id"), F.col("text").cast("binary").alias("_text"))
    return map_batches(rows, count, RESULT_SCHEMA)
