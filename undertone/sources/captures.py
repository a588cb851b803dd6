"""Capture files (.pcap, .pcapng): listing, checks, and distributed reading into raw frames.

A first light pass walks record headers only and cuts every file, however large, into byte
ranges that start on a record. A second pass reads the ranges in parallel.
"""

import io
import json
import struct

import pandas as pd
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession, functions as F, types as T

from undertone.sources.frames import decode_frames
from undertone.session import durable

# Limits and file signatures of accepted captures.
SUFFIXES = (".pcap", ".pcapng")
MAX_BYTES = 50 * 1024 * 1024
MAGICS = ("d4c3b2a1", "a1b2c3d4", "4d3cb2a1", "a1b23c4d", "0a0d0d0a")
# End of fixed values.

SPLIT_BYTES = 32 * 1024 * 1024
BATCH_FRAMES = 4096

HEAD_SCHEMA = T.StructType([
    T.StructField("path", T.StringType()),
    T.StructField("length", T.LongType()),
    T.StructField("magic", T.BinaryType()),
])
SPLIT_SCHEMA = T.StructType([
    T.StructField("path", T.StringType()),
    T.StructField("source_file", T.StringType()),
    T.StructField("start", T.LongType()),
    T.StructField("end", T.LongType()),
    T.StructField("first_seq", T.LongType()),
    T.StructField("packets", T.LongType()),
    T.StructField("layout", T.StringType()),
    T.StructField("error", T.StringType()),
])
FRAME_SCHEMA = T.StructType([
    T.StructField("source_file", T.StringType()),
    T.StructField("packet_seq", T.LongType()),
    T.StructField("ts_us", T.LongType()),
    T.StructField("orig_len", T.IntegerType()),
    T.StructField("link_type", T.IntegerType()),
    T.StructField("frame", T.BinaryType()),
])


class BadCapture(ValueError):
    pass


def list_captures(spark: SparkSession, path, glob="*.pcap*") -> DataFrame:
    """(path, length, filename) of capture files; contents are not read."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", glob).load(path)
    return files.select("path", "length", F.element_at(F.split("path", "/"), -1).alias("filename"))


def open_capture(path):
    """A buffered, seekable stream over a file of any supported file system."""
    if path.startswith("file:"):
        source = fs.LocalFileSystem().open_input_file("/" + path[5:].lstrip("/"))
    elif "://" in path:
        system, inner = fs.FileSystem.from_uri(path)
        source = system.open_input_file(inner)
    else:
        source = fs.LocalFileSystem().open_input_file(path)
    return io.BufferedReader(source, 1 << 20)


def _read(stream, size):
    data = stream.read(size)
    if len(data) < size:
        raise BadCapture("truncated capture")
    return data


def read_layout(stream) -> dict:
    """The file header: byte order, clock units and link types."""
    magic = stream.read(4)
    if magic.hex() not in MAGICS:
        raise BadCapture("no valid capture header")
    if magic.hex() == "0a0d0d0a":
        stream.seek(0)
        return {"kind": "blocks", "order": "<", "links": []}
    order = "<" if magic.hex() in ("d4c3b2a1", "4d3cb2a1") else ">"
    unit = 10**9 if magic.hex() in ("4d3cb2a1", "a1b23c4d") else 10**6
    link = struct.unpack(order + "I", _read(stream, 20)[16:])[0] & 0xFFFF
    return {"kind": "records", "order": order, "links": [[link, unit]]}


def _micros(ticks, unit):
    return (ticks * 1_000_000 + unit // 2) // unit


def _record(stream, layout, body):
    order = layout["order"]
    second, part, kept, size = struct.unpack(order + "IIII", _read(stream, 16))
    link, unit = layout["links"][0]
    data = _take(stream, kept, body)
    return second * 1_000_000 + _micros(part, unit), size, link, data


def _take(stream, size, body):
    if body:
        return _read(stream, size)
    stream.seek(size, io.SEEK_CUR)
    return None


def _interface(content, order):
    """Link type and ticks per second of an interface block."""
    link, unit, at = struct.unpack(order + "H", content[:2])[0], 10**6, 8
    while at + 4 <= len(content):
        code, size = struct.unpack(order + "HH", content[at:at + 4])
        if code == 0:
            break
        if code == 9:
            value = content[at + 4]
            unit = 2 ** (value & 0x7F) if value & 0x80 else 10**value
        at += 4 + (size + 3) // 4 * 4
    return [link, unit]


def _block(stream, layout, body):
    """One block; a packet tuple for packet blocks, else None. Updates the layout in place."""
    head = _read(stream, 8)
    if head[:4].hex() == "0a0d0d0a":
        mark = _read(stream, 4)
        layout["order"] = "<" if mark.hex() == "4d3c2b1a" else ">"
        layout["links"] = []
        _read(stream, struct.unpack(layout["order"] + "I", head[4:])[0] - 12)
        return None
    order = layout["order"]
    kind, total = struct.unpack(order + "II", head)
    if total < 12 or total % 4:
        raise BadCapture("damaged block")
    if kind == 1:
        layout["links"].append(_interface(_read(stream, total - 12), order))
        _read(stream, 4)
        return None
    if kind == 6:
        place, high, low, kept, size = struct.unpack(order + "IIIII", _read(stream, 20))
        if place >= len(layout["links"]):
            raise BadCapture("packet of an undeclared interface")
        link, unit = layout["links"][place]
        data = _take(stream, kept, body)
        _take(stream, total - 32 - kept, False)
        _read(stream, 4)
        return _micros(high << 32 | low, unit), size, link, data
    _take(stream, total - 12, False)
    _read(stream, 4)
    return None


def walk(stream, layout, start, end, body):
    """Yield (offset before, packet) for the packets in [start, end)."""
    step = _record if layout["kind"] == "records" else _block
    stream.seek(start)
    while (at := stream.tell()) < end:
        packet = step(stream, layout, body)
        if stream.tell() > end:
            raise BadCapture("truncated capture")
        if packet is not None:
            yield at, packet


def capture_heads(files: DataFrame) -> DataFrame:
    """Path, length and first four bytes of each file."""

    def read(frames):
        for frame in frames:
            magics = []
            for path in frame["path"]:
                with open_capture(path) as stream:
                    magics.append(stream.read(4))
            yield pd.DataFrame({"path": frame["path"], "length": frame["length"], "magic": magics})

    return files.select("path", "length").mapInPandas(read, HEAD_SCHEMA)


def validate_captures(heads: DataFrame, max_bytes: int = MAX_BYTES) -> DataFrame:
    """Add ``reason``: null for an accepted capture, else why it is refused."""
    name = F.lower("path")
    suffix = F.lit(False)
    for ending in SUFFIXES:
        suffix = suffix | name.endswith(ending)
    magic = F.lower(F.hex("magic")).isin(*MAGICS)
    return heads.withColumn(
        "reason",
        F.when(~suffix, "not a .pcap or .pcapng file")
        .when(F.col("length") > max_bytes, "exceeds the size limit")
        .when(~F.coalesce(magic, F.lit(False)), "no valid capture header"),
    )


def capture_splits(files: DataFrame, split_bytes: int = SPLIT_BYTES) -> DataFrame:
    """Byte ranges that start on a record, with packet counts; a damaged file ends in an error row."""

    def index(frames):
        for frame in frames:
            for path, length in zip(frame["path"], frame["length"]):
                yield pd.DataFrame(list(_index(path, int(length), split_bytes)),
                                   columns=[f.name for f in SPLIT_SCHEMA])

    return files.select("path", "length").mapInPandas(index, SPLIT_SCHEMA)


def _index(path, length, split_bytes):
    name = path.rsplit("/", 1)[-1]
    start = seq = count = 0
    saved = "{}"
    try:
        with open_capture(path) as stream:
            layout = read_layout(stream)
            start, saved = stream.tell(), json.dumps(layout)
            for at, _ in walk(stream, layout, start, length, body=False):
                if at - start >= split_bytes and count:
                    yield path, name, start, at, seq, count, saved, None
                    start, seq, count, saved = at, seq + count, 0, json.dumps(layout)
                count += 1
                good_end = stream.tell()
            yield path, name, start, length, seq, count, saved, None
    except BadCapture as problem:
        if count:
            yield path, name, start, good_end, seq, count, saved, None
        yield path, name, None, None, seq + count, 0, saved, str(problem)


def read_frames(splits: DataFrame) -> DataFrame:
    """Raw frames of the given byte ranges; a few thousand frames in memory at a time."""

    def load(frames):
        for frame in frames:
            for row in frame.itertuples(index=False):
                rows = []
                with open_capture(row.path) as stream:
                    packets = walk(stream, json.loads(row.layout), int(row.start), int(row.end), body=True)
                    for offset, (_, (ts_us, size, link, data)) in enumerate(packets):
                        rows.append((row.source_file, int(row.first_seq) + offset, ts_us, size, link, data))
                        if len(rows) >= BATCH_FRAMES:
                            yield pd.DataFrame(rows, columns=[f.name for f in FRAME_SCHEMA])
                            rows = []
                if rows:
                    yield pd.DataFrame(rows, columns=[f.name for f in FRAME_SCHEMA])

    usable = splits.filter("error is null and packets > 0")
    tasks = max(1, usable.count())
    return usable.repartition(tasks, "path", "start").mapInPandas(load, FRAME_SCHEMA)


def read_captures(files: DataFrame, strict: bool = True) -> tuple[DataFrame, DataFrame]:
    """(packets, problems) of capture files.

    A packet that cannot be decoded costs that packet. A file that cannot be read to its end is
    a failed capture: strict reading drops all its packets, lenient reading keeps those before
    the damage. Problems are (source_file, packet_seq, error).
    """
    splits = durable(capture_splits(files), "splits")
    failed = splits.filter("error is not null").select("source_file", F.col("first_seq").alias("packet_seq"), "error")
    if strict:
        splits = splits.join(failed.select("source_file"), "source_file", "left_anti")
    packets, rejected = decode_frames(read_frames(splits))
    return packets, failed.unionByName(rejected)


def packet_counts(splits: DataFrame) -> DataFrame:
    """Packets per capture file from the header pass."""
    return splits.groupBy("source_file").agg(F.sum("packets").alias("packet_count"))
