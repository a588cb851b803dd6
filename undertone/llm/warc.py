"""WARC archives of pages, and their index by external merge.

Writing: every page is a WARC record in an HTTP envelope, made in the scan and written by Spark's
text writer, so archives go wherever Spark can write and lost tasks are written again. Records are
separated by a fixed boundary. A payload that holds its version mark is sent chunked, with a chunk
border inside every mark, so readers may cut archives at boundaries, in parallel, at any offset.

Reading: records become captures; every batch of captures is a run sorted by URL key and time. A
table of cut keys slices the runs into ranges, and each range merges its slices with a loser tree.
Ranges follow each other, so their histories are in global order. Cut keys hold the time as well,
so one URL with very many captures spreads over ranges.
"""

import datetime
import hashlib
import uuid
from urllib.parse import urlsplit

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window, functions as F

from undertone.llm.common import map_batches, to_arrow
from undertone.session import durable, shared_dir

# Fixed values of the format.
VERSION, GAP = b"WARC/1.1\r\n", b"\r\n\r\n"
BOUNDARY = GAP + VERSION
MARK = b"WARC/1.1"
START = datetime.datetime(2024, 1, 1)
LEAST_SHARED = 100
RANGE_ROWS = 50_000
SAMPLE_PER_RANGE = 64
CAPTURE = [
    ("page_id", "bigint"), ("url", "string"), ("url_key", "string"), ("captured", "string"), ("payload_bytes", "bigint"),
    ("payload_digest", "string"), ("record_type", "string"), ("refers_to", "bigint")]
CAPTURE_SCHEMA = ", ".join(f"{n} {t}" for n, t in CAPTURE)


def url_key(url) -> str:
    """Sort-friendly key: host parts from the right, then path and query, all in lower case."""
    if not url:
        return ""
    try:
        parts = urlsplit(url)
        host = (parts.hostname or "").removeprefix("www.")
        port = f":{parts.port}" if parts.port else ""
    except ValueError:
        return url.lower()
    query = f"?{parts.query}" if parts.query else ""
    return f"{','.join(reversed(host.split('.')))}{port}){parts.path or '/'}{query}".lower()


def header_safe(text: str) -> str:
    """Control characters and spaces of an URL, percent-encoded."""
    return "".join(c if c > " " and c != "\x7f" else f"%{ord(c):02X}" for c in text)


def captured_at(page_id) -> str:
    """Pages carry no time: one capture a second from a fixed start, by id."""
    return (START + datetime.timedelta(seconds=(page_id or 0) % (10**9))).strftime("%Y-%m-%dT%H:%M:%SZ")


def name_of(page_id) -> str:
    return f"<urn:page:{'' if page_id is None else page_id}>"


def id_of(name):
    text = name.strip("<>").rpartition(":")[2]
    return int(text) if text else None


def chunked(payload: bytes) -> bytes:
    """HTTP chunks with a border inside every version mark, so that no boundary can form."""
    pieces = payload.split(MARK)
    chunks = [(MARK[4:] if i else b"") + p + (MARK[:4] if i < len(pieces) - 1 else b"") for i, p in enumerate(pieces)]
    return b"".join(b"%x\r\n%b\r\n" % (len(c), c) for c in chunks if c) + b"0\r\n\r\n"


def unchunked(body: bytes) -> bytes:
    out, at = [], 0
    while True:
        end = body.index(b"\r\n", at)
        size = int(body[at:end], 16)
        if not size:
            return b"".join(out)
        out.append(body[end + 2:end + 2 + size])
        at = end + 4 + size


def record(page_id, url, payload: bytes, digest: str, refers_to) -> bytes:
    """One WARC record without the boundary that follows it; a revisit if ``refers_to`` is an id."""
    revisit = refers_to is not None
    http = [b"HTTP/1.1 200 OK", b"Content-Type: text/html; charset=utf-8"]
    # A revisit keeps the length of what it does not repeat.
    http.append(b"Content-Length: %d" % len(payload))
    body = payload
    if revisit:
        body = b""
    elif MARK in payload:
        http.append(b"Transfer-Encoding: chunked")
        body = chunked(payload)
    block = b"\r\n".join(http) + GAP + body
    head = [f"WARC-Type: {'revisit' if revisit else 'response'}", f"WARC-Record-ID: {name_of(page_id)}"]
    if url:
        head.append(f"WARC-Target-URI: {header_safe(url)}")
    head += [f"WARC-Date: {captured_at(page_id)}", f"WARC-Payload-Digest: sha256:{digest}"]
    if revisit:
        head += ["WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest", f"WARC-Refers-To: {name_of(refers_to)}"]
    head += ["Content-Type: application/http;msgtype=response", f"Content-Length: {len(block)}"]
    return VERSION + "\r\n".join(head).encode("utf-8", "replace") + GAP + block


def parse(data: bytes) -> dict:
    """The capture in one record; ValueError if it is not whole."""
    head, gap, rest = data.partition(GAP)
    fields = dict(line.split(": ", 1) for line in head.decode("utf-8", "replace").split("\r\n") if ": " in line)
    size = int(fields["Content-Length"])
    block, tail = rest[:size], rest[size:]
    if not gap or len(block) < size or tail.strip(b"\r\n"):
        raise ValueError(f"damaged record {fields.get('WARC-Record-ID')}")
    http, _, body = block.partition(GAP)
    lines = dict(line.split(": ", 1) for line in http.decode("latin-1").split("\r\n")[1:])
    digest, kind = fields["WARC-Payload-Digest"].removeprefix("sha256:"), fields["WARC-Type"]
    length = int(lines["Content-Length"])
    if kind == "response":
        body = unchunked(body) if lines.get("Transfer-Encoding") == "chunked" else body
        if len(body) != length or hashlib.sha256(body).hexdigest() != digest:
            raise ValueError(f"payload of {fields['WARC-Record-ID']} does not fit its digest")
    url = fields.get("WARC-Target-URI")
    return {
        "page_id": id_of(fields["WARC-Record-ID"]), "url": url, "url_key": url_key(url), "captured": fields["WARC-Date"],
        "payload_bytes": length, "payload_digest": digest, "record_type": kind,
        "refers_to": id_of(fields["WARC-Refers-To"]) if kind == "revisit" else None}


def write_archives(pages: DataFrame, folder: str):
    """Write one record a row of ``pages`` (page_id, url, html) below ``folder``.

    Among rows with equal payloads of at least 100 bytes those with the smallest page_id are
    responses, the others revisit it. Payloads never meet in a shuffle, only their digests do.
    """
    payload = F.coalesce(F.col("html").cast("binary"), F.lit(b""))
    rows = pages.select(F.col("page_id").cast("bigint").alias("_id"), F.col("url").cast("string").alias("_url"),
                        payload.alias("_payload"), F.sha2(payload, 256).alias("_digest"))
    known = rows.filter(F.octet_length("_payload") >= LEAST_SHARED).select("_id", "_digest")
    shared = durable(known.groupBy("_digest").agg(F.min("_id").alias("_first"), F.count(F.lit(1)).alias("_n"))
                     .filter("_n > 1 and _first is not null").drop("_n"), "shared-payloads")
    joined = rows.join(shared, "_digest", "left").select("_id", "_url", "_payload", "_digest", "_first")

    def write(batch):
        out = []
        for page, url, body, digest, first in zip(*(batch.column(i).to_pylist() for i in range(5))):
            out.append(record(page, url, body, digest, first if first is not None and first != page else None))
        yield {"value": out}

    map_batches(joined, write, "value binary").select(F.col("value").cast("string")).write.option(
        "lineSep", GAP.decode()).text(folder)


def read_archives(spark: SparkSession, folder: str) -> DataFrame:
    """The captures of all records below ``folder``."""

    def read(batch):
        found = [parse(data) for data in batch.column(0).to_pylist()]
        yield {name: [f[name] for f in found] for name, _ in CAPTURE}

    records = spark.read.option("lineSep", BOUNDARY.decode()).text(folder)
    return map_batches(records.select(F.col("value").cast("binary")), read, CAPTURE_SCHEMA)


class LoserTree:
    """Merges k sorted runs: inner nodes keep the loser of their match, the root's winner leaves."""

    def __init__(self, runs):
        self.runs = [iter(r) for r in runs]
        self.heads = [next(r, None) for r in self.runs]
        k = len(self.runs)
        self.losers = [-1] * k
        winners = [-1] * k + list(range(k))
        for node in range(k - 1, 0, -1):
            a, b = winners[2 * node], winners[2 * node + 1]
            winners[node], self.losers[node] = (a, b) if self.before(a, b) else (b, a)
        self.winner = winners[1] if k > 1 else 0

    def before(self, a, b):
        """Used-up runs lose; equal heads leave in the order of their runs."""
        x, y = self.heads[a], self.heads[b]
        if x is None or y is None:
            return y is None and (x is not None or a < b)
        return x < y or (x == y and a < b)

    def __iter__(self):
        k = len(self.runs)
        while k and self.heads[self.winner] is not None:
            yield self.heads[self.winner]
            at = self.winner
            self.heads[at] = next(self.runs[at], None)
            node = (at + k) // 2
            while node:
                if self.before(self.losers[node], at):
                    self.losers[node], at = at, self.losers[node]
                node //= 2
            self.winner = at


def sort_key(row):
    """URL key, time, then page id, a missing id first."""
    return (row["url_key"], row["captured"], row["page_id"] is not None, row["page_id"] or 0)


def cut_keys(captures: DataFrame, ranges: int) -> list:
    """``ranges`` - 1 keys from a hash sample of bounded size; they only balance ranges, any keys would do."""
    if ranges < 2:
        return []
    total = captures.count()
    every = max(1, total // (ranges * SAMPLE_PER_RANGE))
    key = F.struct("url_key", "captured")
    rank = F.ntile(ranges).over(Window.orderBy(key))
    sample = captures.filter(F.pmod(F.xxhash64("page_id", "url_key"), F.lit(every)) == 0).select("url_key", "captured")
    firsts = sample.withColumn("_part", rank).groupBy("_part").agg(F.min(key).alias("k")).orderBy("_part").collect()
    return sorted({(r["k"]["url_key"], r["k"]["captured"]) for r in firsts[1:]})


def merged_index(captures: DataFrame, range_rows: int = RANGE_ROWS) -> DataFrame:
    """All captures plus range_no and place: ordered by both, they are in order of URL key, time and page id."""
    ranges = max(1, -(-captures.count() // range_rows))
    cuts = cut_keys(captures, ranges)
    columns = [n for n, _ in CAPTURE]
    out_schema = f"{CAPTURE_SCHEMA}, range_no int, place bigint"
    packed_schema = "range_no int, _run string, _rows binary"
    row_type, out_type = to_arrow(CAPTURE_SCHEMA), to_arrow(out_schema)
    counter = [0]

    def runs(batch):
        from bisect import bisect_right

        rows = sorted(batch.to_pylist(), key=sort_key)
        counter[0] += 1
        slices = {}
        for row in rows:
            slices.setdefault(bisect_right(cuts, (row["url_key"], row["captured"])), []).append(row)
        run = f"{TaskContext.get().partitionId():08d}-{counter[0]:08d}"
        for part, some in slices.items():
            sink = pa.BufferOutputStream()
            with pa.ipc.new_stream(sink, row_type) as writer:
                writer.write_batch(pa.RecordBatch.from_pylist(some, row_type))
            yield {"range_no": [part], "_run": [run], "_rows": [sink.getvalue().to_pybytes()]}

    def merge(table):
        slices = sorted(zip(table.column("_run").to_pylist(), table.column("_rows").to_pylist()))
        ordered = [pa.ipc.open_stream(data).read_all().to_pylist() for _, data in slices]
        keyed = [[(sort_key(r), run, i, r) for i, r in enumerate(rows)] for run, rows in enumerate(ordered)]
        rows = [item[3] for item in LoserTree(keyed)]
        part = table.column("range_no")[0].as_py()
        arrays = [pa.array([r[n] for r in rows], t.type) for n, t in zip(columns, row_type)]
        arrays += [pa.array([part] * len(rows), pa.int32()), pa.array(range(len(rows)), pa.int64())]
        return pa.Table.from_arrays(arrays, schema=out_type)

    slices = map_batches(captures.select(*columns), runs, packed_schema)
    return slices.groupBy("range_no").applyInArrow(merge, out_schema)


def archive_pages(pages: DataFrame, folder: str = None, range_rows: int = RANGE_ROWS) -> DataFrame:
    """Write ``pages`` as WARC archives, read them back and merge their index.

    Returns page_id, payload_bytes, payload_digest (SHA-256 of the whole payload), record_type,
    refers_to, url_key, captured, range_no and place. A null html is an empty payload. A null url
    has an empty key. A null page_id is never revisited unless all its copies have none, and then
    all are responses; rows that repeat the smallest id of a payload are responses too. An empty
    table gives an empty result. Other columns do not matter.
    """
    spark = pages.sparkSession
    folder = folder or f"{shared_dir(spark).rstrip('/')}/warc-{uuid.uuid4().hex}"
    write_archives(pages, folder)
    captures = durable(read_archives(spark, folder), "captures")
    return merged_index(captures, range_rows).select(
        "page_id", "payload_bytes", "payload_digest", "record_type", "refers_to", "url_key", "captured", "range_no", "place")
