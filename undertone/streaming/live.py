"""Continuous scoring: flows form in a keyed state of bounded size and leave it when closed.

A conversation's state holds packets that may still be overtaken by an earlier one (those newer
than the watermark) and merged statistics of the windows that are not final yet. It never holds
the packets of a flow, so an endless tunnel costs no more state than a short exchange. One
trigger's packets of one conversation meet in one task; size triggers with maxFilesPerTrigger.
"""

import hashlib
import json
import math
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession, functions as F, types as T
from pyspark.sql.streaming.state import GroupStateTimeout

from undertone.functions.scalars import is_txt_or_null
from undertone.operators.features import with_payload_scalars
from undertone.operators.flows import (
    CONVERSATION, check_packets, check_parameters, microseconds, with_conversation,
)
from undertone.operators.scoring import flag, with_scores
from undertone.schema import FLOW_FEATURE_COLUMNS, PACKET_SCHEMA

# Packets of a conversation whose windows are measured together.
PACKETS_AT_ONCE = 1 << 16
MEASURES = ["packet_size", "entropy", "compression_ratio", "query_length", "payload_length", "is_txt_or_null"]
FEATURE_ROW = T.StructType([
    T.StructField("source_file", T.StringType()),
    T.StructField("flow_start_us", T.LongType()),
    T.StructField("flow_id", T.StringType()),
    T.StructField("protocol", T.StringType()),
    T.StructField("packet_count", T.LongType()),
    *[T.StructField(n, T.BooleanType() if n == "is_single_packet_flow" else T.DoubleType())
      for n in FLOW_FEATURE_COLUMNS[3:]],
    T.StructField("start_timestamp", T.DoubleType()),
    T.StructField("end_timestamp", T.DoubleType()),
    T.StructField("conversation", T.StringType()),
])
STATE = T.StructType([T.StructField("conversation", T.StringType())])


@dataclass
class Moments:
    """Count, mean, squared deviation and maximum; two of them merge exactly."""

    n: int = 0
    mean: float = 0.0
    m2: float = 0.0
    top: float = -math.inf

    @classmethod
    def of_stretches(cls, values, starts):
        """Per row of ``values``, the moments of its stretches, which begin at ``starts``; NaN counts for nothing."""
        known = ~np.isnan(values)
        n = np.add.reduceat(known, starts, axis=1, dtype=np.int64)
        mean = np.add.reduceat(np.where(known, values, 0.0), starts, axis=1) / np.maximum(n, 1)
        sizes = np.diff(starts, append=values.shape[1])
        off = np.where(known, values - np.repeat(mean, sizes, axis=1), 0.0)
        m2 = np.add.reduceat(off * off, starts, axis=1)
        top = np.maximum.reduceat(np.where(known, values, -math.inf), starts, axis=1)
        return [list(map(cls, *row)) for row in zip(n.tolist(), mean.tolist(), m2.tolist(), top.tolist())]

    def plus(self, other):
        n = self.n + other.n
        if not n:
            return Moments()
        step = other.mean - self.mean
        return Moments(n, self.mean + step * other.n / n,
                       self.m2 + other.m2 + step * step * self.n * other.n / n, max(self.top, other.top))

    def std(self):
        return math.sqrt(self.m2 / self.n) if self.n else 0.0

    def cv(self):
        return self.std() / self.mean if self.n and self.mean else 0.0


@dataclass
class WindowStats:
    bin: int
    first: int
    last: int
    count: int
    gaps: Moments
    measures: dict

    @classmethod
    def of_stretches(cls, bins, ts, columns, starts):
        """One a stretch of packets; ``starts`` are the places of their first packets."""
        gaps = np.diff(ts, prepend=ts[0]) / 1e6
        gaps[starts] = np.nan
        gaps, *measures = Moments.of_stretches(np.stack([gaps, *columns]), starts)
        ends = np.append(starts[1:], len(ts))
        whole = zip(bins[starts].tolist(), ts[starts].tolist(), ts[ends - 1].tolist(), (ends - starts).tolist())
        return [cls(*numbers, gap, dict(zip(MEASURES, values))) for numbers, gap, *values in zip(whole, gaps, *measures)]

    def plus(self, later):
        """Join a later stretch of the same window; the gap between them belongs to it."""
        gap = (later.first - self.last) / 1e6
        between = Moments(1, gap, 0.0, gap)
        return WindowStats(
            self.bin, self.first, later.last, self.count + later.count,
            self.gaps.plus(between).plus(later.gaps),
            {name: self.measures[name].plus(later.measures[name]) for name in self.measures},
        )


@dataclass
class OpenFlow:
    start: int
    windows: list
    named: int = 0

    @property
    def last(self):
        return self.windows[-1].last


@dataclass
class Conversation:
    """The open flow, and packets (as column lists, in time order) that the watermark has not passed."""

    flow: OpenFlow | None = None
    waiting: dict = field(default_factory=dict)

    def to_json(self):
        return json.dumps(self, default=vars)

    @classmethod
    def from_json(cls, text):
        stored = json.loads(text)
        flow = stored["flow"]
        if flow is not None:
            flow = OpenFlow(flow["start"], [
                WindowStats(
                    w["bin"], w["first"], w["last"], w["count"], Moments(**w["gaps"]),
                    {name: Moments(**m) for name, m in w["measures"].items()},
                ) for w in flow["windows"]
            ], flow["named"])
        return cls(flow, stored["waiting"])


def feature_row(key, flow, stats, suffix):
    """One output row; the flow is named by its start, since a stream has no capture-wide count."""
    source_file, protocol = key[0], key[1]
    m, dns = stats.measures, protocol == "dns"
    name = f"{flow.start}{suffix}"
    query, kind = m["query_length"], m["is_txt_or_null"]
    mean = lambda moments: moments.mean if moments.n else None
    top = lambda moments: moments.top if moments.n else None
    return (
        source_file, flow.start, name, protocol, stats.count, (stats.last - stats.first) / 1e6,
        m["packet_size"].mean, m["packet_size"].std(), m["packet_size"].cv(),
        stats.gaps.mean, stats.gaps.std(), stats.gaps.cv(), stats.count == 1,
        mean(m["entropy"]), top(m["entropy"]), mean(m["compression_ratio"]), top(m["compression_ratio"]),
        (query.mean if query.n else 0.0) if dns else None,
        (kind.mean if kind.n else 0.0) if dns else None,
        (query.top if query.n else 0.0) if dns else None,
        None if dns else m["payload_length"].cv(),
        stats.first / 1e6, stats.last / 1e6, conversation_name(key),
    )


def conversation_name(key) -> str:
    """A hash of the conversation: with it a flow_id is unique, also where two flows start together."""
    return hashlib.blake2b(repr(tuple(key)).encode(), digest_size=8).hexdigest()


def emit_final(key, flow, min_duration_us):
    """Rows of windows that later packets can no longer change; they leave the state.

    The last window may still grow, and the one before it may still take in a lone last packet.
    """
    if flow.last - flow.start < min_duration_us:
        return []
    keep = 1 if flow.windows[-1].count > 1 else 2
    done, flow.windows = flow.windows[:-keep], flow.windows[-keep:]
    rows = [feature_row(key, flow, w, f"_w{flow.named + i}") for i, w in enumerate(done)]
    flow.named += len(done)
    return rows


def close(key, flow, min_duration_us):
    windows = flow.windows
    if flow.last - flow.start < min_duration_us:
        whole = windows[0]
        for later in windows[1:]:
            whole = whole.plus(later)
        return [feature_row(key, flow, whole, "")]
    if len(windows) > 1 and windows[-1].count < 2:
        windows = [*windows[:-2], windows[-2].plus(windows[-1])]
    return [feature_row(key, flow, w, f"_w{flow.named + i}") for i, w in enumerate(windows)]


def absorb(key, state, ts, columns, timeout_us, window_us, min_duration_us):
    """Feed packets in time order; work is per stretch of packets in one window, not per packet."""
    rows = []
    for start in range(0, len(ts), PACKETS_AT_ONCE):
        some = slice(start, start + PACKETS_AT_ONCE)
        rows += absorb_some(key, state, ts[some], [c[some] for c in columns], timeout_us, window_us, min_duration_us)
    return rows


def absorb_some(key, state, ts, columns, timeout_us, window_us, min_duration_us):
    rows, flow = [], state.flow
    if flow is not None and ts[0] - flow.last > timeout_us:
        rows += close(key, flow, min_duration_us)
        flow = None
    # Every packet counts its bin from the start of its flow; the first may belong to the flow that is open.
    heads = np.concatenate([[0], np.flatnonzero(np.diff(ts) > timeout_us) + 1])
    since = ts[heads]
    if flow is not None:
        since[0] = flow.start
    bins = (ts - np.repeat(since, np.diff(heads, append=len(ts)))) // window_us
    borders = np.diff(bins) != 0
    borders[heads[1:] - 1] = True
    starts = np.concatenate([[0], np.flatnonzero(borders) + 1])
    stretches = WindowStats.of_stretches(bins, ts, columns, starts)
    edges = [*np.searchsorted(starts, heads).tolist(), len(stretches)]
    for left, right in zip(edges[:-1], edges[1:]):
        if left:
            rows += close(key, flow, min_duration_us)
            flow = None
        if flow is None:
            flow = OpenFlow(stretches[left].first, [])
        for stats in stretches[left:right]:
            if flow.windows and flow.windows[-1].bin == stats.bin:
                flow.windows[-1] = flow.windows[-1].plus(stats)
            else:
                flow.windows.append(stats)
        rows += emit_final(key, flow, min_duration_us)
    state.flow = flow
    return rows


def in_time_order(waiting, frames):
    """(times, capture positions, measures) of packets that waited and of new ones, by time and capture position."""
    names = ["ts_us", "packet_seq", *MEASURES]
    known = [[np.array(waiting[n]) for n in names]] if waiting else []
    known += [[f[n].to_numpy() for n in names] for f in frames]
    if not known:
        return np.zeros(0, np.int64), np.zeros(0, np.int64), [np.zeros(0)] * len(MEASURES)
    ts, seq, *columns = [np.concatenate(parts) for parts in zip(*known)]
    order = np.lexsort((seq, ts))
    return ts[order].astype(np.int64), seq[order], [c[order].astype(float) for c in columns]


def conversation_updater(timeout_us, window_us, min_duration_us):
    names = [f.name for f in FEATURE_ROW]

    def update(key, frames, group):
        state = Conversation.from_json(group.get[0]) if group.exists else Conversation()
        watermark_us = group.getCurrentWatermarkMs() * 1000
        ts, seq, columns = in_time_order(state.waiting, [] if group.hasTimedOut else frames)
        settled = int(np.searchsorted(ts, watermark_us))
        rows = absorb(key, state, ts[:settled], [c[:settled] for c in columns], timeout_us, window_us, min_duration_us)
        state.waiting = {}
        if settled < len(ts):
            left = dict(zip(["ts_us", "packet_seq", *MEASURES], [ts, seq, *columns]))
            state.waiting = {n: c[settled:].tolist() for n, c in left.items()}
        flow = state.flow
        if flow is not None and watermark_us > flow.last + timeout_us:
            if not state.waiting or state.waiting["ts_us"][0] - flow.last > timeout_us:
                rows += close(key, flow, min_duration_us)
                state.flow = None
        if state.flow is None and not state.waiting:
            if group.exists:
                group.remove()
        else:
            # Wake when the watermark passes the next waiting packet or the end of the open flow.
            due = [state.waiting["ts_us"][0]] if state.waiting else []
            due += [state.flow.last + timeout_us] if state.flow else []
            group.update((state.to_json(),))
            group.setTimeoutTimestamp(max(min(due), watermark_us) // 1000 + 1)
        if rows:
            yield pd.DataFrame(rows, columns=names)

    return update


def read_packet_stream(spark: SparkSession, path, files_per_trigger: int = 64) -> DataFrame:
    """A growing directory of packet Parquet files as a stream."""
    reader = spark.readStream.schema(PACKET_SCHEMA).option("maxFilesPerTrigger", files_per_trigger)
    return reader.parquet(path)


def write_packet_files(packets: DataFrame, path: str, files: int | None = None):
    """Packets as Parquet files that a stream reads in event-time order, whatever it takes a trigger.

    A file holds one range of time. A file stream takes the oldest files first, so they get
    modification times a millisecond apart in the order of their ranges; a store that does not keep
    them is an error, since packets read out of order would be dropped as late.
    """
    packets.repartitionByRange(*([files] if files else []), "ts_us").write.parquet(path)
    session = packets.sparkSession
    folder = session._jvm.org.apache.hadoop.fs.Path(path)
    store = folder.getFileSystem(session._jsparkSession.sessionState().newHadoopConf())
    written = {s.getPath().getName(): s for s in store.listStatus(folder) if s.getPath().getName().startswith("part-")}
    names = sorted(written, key=lambda name: (int(name.split("-")[1]), name))
    newest = max((s.getModificationTime() for s in written.values()), default=0)
    for place, name in enumerate(names):
        store.setTimes(written[name].getPath(), newest - len(names) + 1 + place, -1)
    kept = {s.getPath().getName(): s.getModificationTime() for s in store.listStatus(folder)}
    if any(kept[a] >= kept[b] for a, b in zip(names, names[1:])):
        raise RuntimeError(f"{path} keeps no modification times; a stream cannot read its files in order")


def stream_features(
    packets: DataFrame, timeout_seconds: float = 30.0, window_seconds: float = 30.0,
    min_duration_to_split: float = 60.0, late_by: str = "1 minute",
) -> DataFrame:
    """Feature rows of closed flow windows, in append mode.

    Packets later than ``late_by`` are dropped, which a batch run would not do.
    """
    check_parameters(timeout_seconds, window_seconds, min_duration_to_split)
    rows = with_payload_scalars(with_conversation(check_packets(packets)))
    rows = rows.withColumns({
        "is_txt_or_null": is_txt_or_null(F.col("qtype")).cast("double"),
        "event_time": F.timestamp_micros("ts_us"),
    }).select(*CONVERSATION, "ts_us", "packet_seq", "event_time",
              *[F.col(m).cast("double").alias(m) for m in MEASURES])
    update = conversation_updater(
        microseconds(timeout_seconds), microseconds(window_seconds), microseconds(min_duration_to_split)
    )
    return rows.withWatermark("event_time", late_by).groupBy(*CONVERSATION).applyInPandasWithState(
        update, FEATURE_ROW, STATE, "append", GroupStateTimeout.EventTimeTimeout
    )


def stream_score(packets: DataFrame, model, **parameters) -> DataFrame:
    """Scored and flagged windows of a packet stream."""
    mine = packets.filter(F.lower("protocol") == model.protocol)
    scored = with_scores(stream_features(mine, **parameters), model, check=False)
    return flag(scored, model.forest_threshold, model.autoencoder_threshold).select(
        "source_file", "conversation", "flow_id", "start_timestamp", "end_timestamp", "packet_count",
        "isolation_forest_score", "autoencoder_reconstruction_error", "flagged_by_either",
    )
