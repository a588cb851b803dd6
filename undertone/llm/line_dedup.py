"""Line deduplication with levelled sorted runs of line keys.

A run is a stored table of line keys with the number of documents that hold them, sorted by key.
Batches of documents arrive one after another: a batch drops the keys that a run already knows to
be frequent (a merge anti-join: both sides are sorted by key), and adds the rest as a new run of
level 0. When a level has ``fanout`` runs they merge into one run of the next level, so a key is
rewritten a logarithmic number of times. Frequent lines are those whose runs sum up to the limit.
"""

import hashlib

import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, functions as F

from undertone.llm.common import LOWER_ASCII, map_batches
from undertone.session import durable

BLANK = b" \t\n\x0b\x0c\r"
LINE_SCHEMA = "_id bigint, _text_key bigint, _key binary"
RESULT_SCHEMA = "doc_id bigint, n_lines bigint, n_dropped bigint, kept binary"


def line_key(line: bytes) -> bytes:
    """The line without blanks at its ends, A-Z in lower case."""
    return line.strip(BLANK).translate(LOWER_ASCII)


def document_keys(docs: DataFrame, least_chars: int) -> DataFrame:
    """One row per document and distinct key of at least ``least_chars`` code points (128-bit hashes)."""

    def keys(batch):
        rows, texts, ids, out = [], [], [], []
        for i, text in enumerate(batch.column(2).to_pylist()):
            found = {line_key(line) for line in (text or b"").split(b"\n")}
            found = [k for k in found if len(k) >= least_chars and (least_chars < 2 or len(k.decode("utf-8", "replace")) >= least_chars)]
            rows.extend([i] * len(found))
            out.extend(xxhash.xxh3_128_digest(k) for k in found)
        at = pa.array(rows, pa.int32())
        ids, texts = batch.column(0).take(at), batch.column(1).take(at)
        yield {"_id": ids, "_text_key": texts, "_key": out}

    return map_batches(with_text_key(docs), keys, LINE_SCHEMA)


def with_text_key(docs):
    """(id, text key, text bytes): rows that agree in the first two have the same lines."""
    return docs.select(F.col("doc_id").cast("bigint").alias("_id"), F.xxhash64("text").alias("_text_key"),
                       F.col("text").cast("binary").alias("_text"))


class LineRuns:
    """Levels of sorted runs (_key, _docs); ``levels[k]`` lists the runs of level k."""

    def __init__(self, limit: int, fanout: int = 3, levels=None):
        self.limit, self.fanout, self.levels = limit, fanout, levels or [[]]

    def runs(self):
        return [run for level in self.levels for run in level]

    def add(self, counts: DataFrame):
        """Add a batch: rows of _key and _docs, the number of its documents that hold the key."""
        for run in self.runs():
            counts = counts.join(run.filter(F.col("_docs") >= self.limit), "_key", "left_anti")
        self.levels[0].append(durable(counts.select("_key", "_docs").sortWithinPartitions("_key"), "line-run"))
        self.compact()

    def compact(self):
        for level in range(len(self.levels)):
            if len(self.levels[level]) >= self.fanout:
                if level + 1 == len(self.levels):
                    self.levels.append([])
                merged = merge_runs(self.levels[level])
                self.levels[level + 1].append(durable(merged.sortWithinPartitions("_key"), "line-run"))
                self.levels[level] = []

    def frequent(self) -> DataFrame:
        """Keys found in at least ``limit`` documents. A key left out of a batch is in a run above the limit."""
        return merge_runs(self.runs()).filter(F.col("_docs") >= self.limit).select("_key")


def merge_runs(runs):
    merged = runs[0]
    for run in runs[1:]:
        merged = merged.unionByName(run)
    return merged.groupBy("_key").agg(F.sum("_docs").alias("_docs"))


def dedup_lines(docs: DataFrame, limit: int = 10, least_chars: int = 1, batches: int = 4, fanout: int = 3) -> DataFrame:
    """Drop every line whose key (``line_key``) is found in at least ``limit`` documents.

    Returns doc_id, n_lines (before dropping), n_dropped and kept (UTF-8 bytes of the other lines,
    joined by newlines). Texts are split at newlines; a null or empty text is one empty line. Keys
    under ``least_chars`` code points are never dropped. Every row counts as one document, repeated
    rows and null ids too. An empty table gives an empty result. The documents are taken in as
    ``batches`` arriving batches, by hash; the result does not depend on their number.
    """
    lines = durable(document_keys(docs, least_chars).withColumn(
        "_batch", F.pmod(F.xxhash64("_id", "_text_key"), F.lit(batches)).cast("int")), "lines")
    counts = durable(lines.groupBy("_batch", "_key").agg(F.count(F.lit(1)).alias("_docs")), "line-counts")
    runs = LineRuns(limit, fanout)
    for batch in range(batches):
        runs.add(counts.filter(F.col("_batch") == batch))
    frequent = durable(runs.frequent(), "frequent-lines")
    # Per document at most its own distinct lines. Repeated rows share one entry.
    marked = durable(
        lines.join(frequent, "_key").groupBy("_id", "_text_key").agg(F.collect_set("_key").alias("_drop")), "line-drops")
    own = with_text_key(docs)
    joined = own.join(
        marked.select(F.col("_id").alias("_of"), F.col("_text_key").alias("_of_text"), "_drop"),
        F.col("_id").eqNullSafe(F.col("_of")) & (F.col("_text_key") == F.col("_of_text")), "left")

    def drop(batch):
        total, dropped, kept = [], [], []
        for text, out in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist()):
            out = set(out or ())
            parts = (text or b"").split(b"\n")
            stay = parts
            if out:
                stay = [line for line in parts if not is_dropped(line, out, least_chars)]
            total.append(len(parts))
            dropped.append(len(parts) - len(stay))
            kept.append(b"\n".join(stay))
        yield {"doc_id": batch.column(0), "n_lines": total, "n_dropped": dropped, "kept": kept}

    return map_batches(joined.select("_id", "_text", "_drop"), drop, RESULT_SCHEMA)


def is_dropped(line: bytes, drop: set, least_chars: int) -> bool:
    key = line_key(line)
    if len(key) < least_chars or (least_chars > 1 and len(key.decode("utf-8", "replace")) < least_chars):
        return False
    return xxhash.xxh3_128_digest(key) in drop


def line_report(docs: DataFrame, **options) -> DataFrame:
    return dedup_lines(docs, **options).select(
        "doc_id", "n_lines", "n_dropped", F.sha2("kept", 256).alias("kept_sha256"))


def sha256(text: bytes) -> str:
    return hashlib.sha256(text).hexdigest()
