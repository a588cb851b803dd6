import random
from collections import defaultdict

import pytest
from pyspark.sql import functions as F

from conftest import dns, icmp
from undertone.operators import flows
from undertone.operators.features import build_flow_features, placed_packets
from undertone.operators.flows import assign_flows


def flow_ids(df):
    return [r["flow_id"] for r in df.orderBy("packet_seq").collect()]


def test_both_directions_share_a_flow(packets):
    rows = [dns(0), dns(2, "10.0.0.53", "10.0.0.2", 53, 53000)]
    assert flow_ids(assign_flows(packets(rows))) == [0, 0]


@pytest.mark.parametrize("gap,expected", [(30, [0, 0]), (30.000001, [0, 1]), (31, [0, 1])])
def test_only_a_longer_gap_splits(packets, gap, expected):
    assert flow_ids(assign_flows(packets([dns(0), dns(gap)]))) == expected


def test_interleaved_conversations(packets):
    rows = [icmp(0), icmp(1, "10.0.0.3"), icmp(2), icmp(3, "10.0.0.3")]
    assert flow_ids(assign_flows(packets(rows))) == [0, 1, 0, 1]


def test_icmp_ignores_ports_and_addresses_order_as_text(packets):
    rows = [icmp(0, "10.0.0.10", "10.0.0.2", src_port=5), icmp(1, "10.0.0.2", "10.0.0.10", src_port=9)]
    assert flow_ids(assign_flows(packets(rows))) == [0, 0]
    same_ip = [dns(0, "::1", "::1", 9, 5), dns(1, "::1", "::1", 5, 9), dns(2, "::1", "::1", 5, 8)]
    assert flow_ids(assign_flows(packets(same_ip))) == [0, 0, 1]


def test_zero_timeout_keeps_equal_times_together(packets):
    assert flow_ids(assign_flows(packets([dns(5), dns(5), dns(5.000001)]), 0)) == [0, 0, 1]


def test_parameters_are_checked(packets):
    rows = packets([dns(0)])
    with pytest.raises(ValueError, match="timeout"):
        assign_flows(rows, -1)
    with pytest.raises(ValueError, match="window"):
        build_flow_features(rows, window_seconds=0)
    with pytest.raises(ValueError, match="min_duration"):
        build_flow_features(rows, min_duration_to_split=-1)


def test_other_protocols_fail_the_job(packets):
    with pytest.raises(Exception, match="protocol must be"):
        build_flow_features(packets([{**dns(0), "protocol": "tcp"}])).collect()


def reference_windows(rows, timeout, window, shortest):
    """A plain state machine over one list of packets: {packet_seq: (flow, window or None, gap)}."""
    out, captures = {}, defaultdict(list)
    for row in rows:
        captures[row["source_file"]].append(row)
    for packets in captures.values():
        packets.sort(key=lambda r: (r["ts_us"], r["packet_seq"]))
        open_flows, flows = {}, []
        for p in packets:
            ends = sorted([(p["src_ip"], p["src_port"] if p["protocol"] == "dns" else -1),
                           (p["dst_ip"], p["dst_port"] if p["protocol"] == "dns" else -1)])
            key = (p["protocol"], *ends)
            flow = open_flows.get(key)
            if flow is None or p["ts_us"] - flows[flow][-1]["ts_us"] > timeout:
                flow = open_flows[key] = len(flows)
                flows.append([])
            flows[flow].append(p)
        for number, members in enumerate(flows):
            start, span = members[0]["ts_us"], members[-1]["ts_us"] - members[0]["ts_us"]
            if span < shortest:
                pieces, named = [members], False
            else:
                bins = defaultdict(list)
                for p in members:
                    bins[(p["ts_us"] - start) // window].append(p)
                pieces, named = [bins[b] for b in sorted(bins)], True
                if len(pieces) > 1 and len(pieces[-1]) < 2:
                    pieces[-2:] = [pieces[-2] + pieces[-1]]
            for k, piece in enumerate(pieces):
                for before, p in zip([None, *piece], piece):
                    name = f"{number}_w{k}" if named else str(number)
                    gap = None if before is None else p["ts_us"] - before["ts_us"]
                    out[p["source_file"], p["packet_seq"]] = (name, gap)
    return out


@pytest.mark.parametrize("timeout,window,shortest", [(30, 30, 60), (50, 7, 20), (5, 30, 0), (2, 0.5, 3)])
def test_against_a_state_machine_with_a_hot_conversation(spark, packets, timeout, window, shortest):
    rng = random.Random(timeout)
    rows = []
    for i in range(3000):
        hot = rng.random() < 0.4
        host = "10.0.0.9" if hot else f"10.0.0.{rng.randrange(12)}"
        # Whole and half seconds give ties, gaps equal to the timeout and bin edges.
        t = rng.randrange(0, 1200 if hot else 4000) / 2
        row = dns(t, host, "10.9.0.53", 1 + rng.randrange(2) * (not hot)) if hot or rng.random() < 0.6 else icmp(t, host)
        if rng.random() < 0.5:
            row["src_ip"], row["dst_ip"] = row["dst_ip"], row["src_ip"]
            row["src_port"], row["dst_port"] = row.get("dst_port"), row.get("src_port")
        row["source_file"] = "hot.pcap" if hot else f"{rng.randrange(3)}.pcap"
        rows.append(row)
    frame = packets(rows)
    plain = [r.asDict() for r in frame.collect()]
    expected = reference_windows(plain, timeout * 10**6, int(window * 10**6), shortest * 10**6)
    options = {"timeout_seconds": timeout, "window_seconds": window, "min_duration_to_split": shortest}
    placed, _ = placed_packets(frame, **options)
    gaps = {(r["source_file"], r["packet_seq"]): r["gap_us"] for r in placed.collect()}
    assert gaps == {k: gap for k, (_, gap) in expected.items()}
    numbers = {(r["source_file"], r["packet_seq"]): r["flow_id"] for r in assign_flows(frame, timeout).collect()}
    assert numbers == {k: int(name.split("_")[0]) for k, (name, _) in expected.items()}
    counted = defaultdict(int)
    for (capture, _), (name, _) in expected.items():
        counted[capture, name] += 1
    found = {(r["source_file"], r["flow_id"]): r["packet_count"] for r in build_flow_features(frame, **options).collect()}
    assert found == dict(counted)


def test_no_step_gathers_a_whole_conversation_of_packets(packets):
    """Packet-sized shuffles carry the time slice; nothing is joined without keys."""
    plan = build_flow_features(packets([dns(0), dns(1)]))._jdf.queryExecution().executedPlan().toString()
    assert "CartesianProduct" not in plan and "NestedLoop" not in plan and "SinglePartition" not in plan
    lines = [x for x in plan.splitlines() if "lag(ts_us" in x and "Window" in x]
    assert lines and all("slice" in x for x in lines)
    assert "payload_bytes" not in "".join(x for x in plan.splitlines() if "Exchange" in x)


def test_long_flow_windows_and_times(packets):
    rows = [icmp(t, payload_bytes=b"payload", payload_length=56, packet_size=84) for t in range(0, 151, 2)]
    out = build_flow_features(packets(rows), include_timestamps=True).orderBy("start_timestamp").collect()
    assert [r["flow_id"] for r in out] == [f"0_w{i}" for i in range(5)]
    assert [r["packet_count"] for r in out] == [15, 15, 15, 15, 16]
    assert [r["start_timestamp"] for r in out] == [0, 30, 60, 90, 120]
    assert [r["end_timestamp"] for r in out] == [28, 58, 88, 118, 150]
    assert build_flow_features(packets(rows)).columns[-1] == "source_file"


def test_short_and_long_flows_of_one_capture(packets):
    rows = [icmp(1000 + 10 * i, *(("10.0.0.2", "10.0.0.1") if i % 2 == 0 else ("10.0.0.1", "10.0.0.2")))
            for i in range(10)] + [icmp(1100, "10.0.0.3")]
    out = build_flow_features(packets(rows), include_timestamps=True).orderBy("start_timestamp").collect()
    assert [r["flow_id"] for r in out] == ["0_w0", "0_w1", "0_w2", "1"]
    assert [r["start_timestamp"] for r in out] == [1000, 1030, 1060, 1100]
    assert [r["end_timestamp"] for r in out] == [1020, 1050, 1090, 1100]


def test_feature_values(packets):
    rows = [
        dns(10, packet_size=60, payload_bytes=b"aabc", query_length=10, qtype="A"),
        dns(12, packet_size=80, payload_bytes=None, query_length=20, qtype="txt"),
        icmp(20, packet_size=100, payload_length=56), icmp(25, packet_size=140, payload_length=0),
        icmp(90, "10.0.0.8", payload_length=0),
    ]
    out = {(r["protocol"], r["packet_count"]): r for r in build_flow_features(packets(rows)).collect()}
    d, i, one = out["dns", 2], out["icmp", 2], out["icmp", 1]
    assert (d["size_mean"], d["size_std"], d["duration_seconds"]) == (70, 10, 2)
    assert (d["interarrival_mean"], d["interarrival_std"], d["interarrival_cv"]) == (2, 0, 0)
    assert (d["entropy_mean"], d["entropy_max"]) == (0.75, 1.5)
    assert (d["mean_query_length"], d["txt_null_ratio"], d["max_query_length"]) == (15, 0.5, 20)
    assert d["icmp_size_cv"] is None and i["mean_query_length"] is None and i["max_query_length"] is None
    assert i["icmp_size_cv"] == 1.0 and i["interarrival_mean"] == 5
    assert one["is_single_packet_flow"] and one["interarrival_cv"] == 0 and one["icmp_size_cv"] == 0


def test_source_file_separates_captures(packets):
    rows = [dns(0), {**dns(1), "source_file": "b.pcap"}]
    assert build_flow_features(packets(rows)).filter(F.col("flow_id") == "0").count() == 2


def test_a_packet_without_a_time_fails_the_job(spark, packets):
    rows = packets([dns(0), dns(1)]).withColumn("ts_us", F.when(F.col("packet_seq") == 0, F.col("ts_us")))
    with pytest.raises(Exception, match="packet without a time"):
        assign_flows(rows).collect()


def test_slices_are_computed_once_and_sorted_by_a_hash(spark, packets):
    rows = build_flow_features(packets([icmp(t) for t in (0, 1, 100)]))
    plan = rows._jdf.queryExecution().optimizedPlan().toString()
    # Packets are read for their places only; all else comes from the stored slices.
    assert plan.count("LogicalRDD") + plan.count("LocalRelation") == 1
    windows = [line for line in plan.splitlines() if "windowspecdefinition" in line]
    assert windows and all("conversation_hash" in line or "_lead" in line or "second" in line for line in windows)
    assert sorted(r["packet_count"] for r in rows.collect()) == [1, 2]


def test_conversations_that_share_a_hash_are_told_apart(packets, monkeypatch):
    seeds, plain = [], flows.conversation_hash

    def clashing(seed):
        seeds.append(seed)
        return F.lit(5) if seed < 2 else plain(seed)

    rows = packets([icmp(t, src) for t in (0, 10, 20) for src in ("10.0.0.2", "10.0.0.3")])
    want = sorted(map(tuple, build_flow_features(rows).collect()))
    monkeypatch.setattr(flows, "conversation_hash", clashing)
    assert sorted(map(tuple, build_flow_features(rows).collect())) == want and max(seeds) == 2


def test_names_of_conversations_stay_out_of_shuffles_of_packets(packets):
    plan = build_flow_features(packets([dns(0), dns(1), icmp(3)]))._jdf.queryExecution().executedPlan().toString()
    lines = plan.splitlines()
    packet_sized = [x for x in lines if ("lag(ts_us" in x and "Window" in x) or "partial_count" in x]
    assert packet_sized and not any("ip_a" in x or "source_file" in x for x in packet_sized)


@pytest.mark.parametrize("late", [2**38, 2**62])
def test_capture_positions_of_any_size_order_flows(packets, late):
    """Flows that start together are numbered by the position of their first packet, however large or negative."""
    places = {"10.0.0.2": [late + 1, late], "10.0.0.3": [late - 5, 9], "10.0.0.4": [late, -7], "10.0.0.5": [8, 3]}
    rows = [icmp(t, src, packet_seq=seq) for src, seqs in places.items() for t, seq in ((0, seqs[0]), (0, seqs[1]), (-40, 20 + seqs[1]))]
    found = {(r["src_ip"], r["packet_seq"]): r["flow_id"] for r in assign_flows(packets(rows)).collect()}
    assert [found[src, 20 + places[src][1]] for src in ("10.0.0.4", "10.0.0.5", "10.0.0.3", "10.0.0.2")] == [0, 1, 2, 3]
    assert [found[src, places[src][0]] for src in ("10.0.0.4", "10.0.0.5", "10.0.0.3", "10.0.0.2")] == [4, 5, 6, 7]
