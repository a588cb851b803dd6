import random
import socket
import struct
import zlib

import pytest
from pyspark.sql import functions as F

from undertone.functions import fields, scalars
from undertone.functions.names import capture_time, parse_capture_name
from undertone.sources import captures, dissector
from undertone.sources.frames import decode_frames
from undertone.sources.manifest import (
    read_manifest, scan_capture_dir, summarize_manifest, with_capture_time, write_manifest,
)


def column(spark, values, function, kind="string"):
    df = spark.createDataFrame([(i, v) for i, v in enumerate(values)], f"i int, v {kind}")
    return [r[0] for r in df.select(function(F.col("v")), "i").orderBy("i").collect()]


def test_entropy_and_compression(spark):
    noise = random.Random(1).randbytes(1000)
    data = [bytes(1000), noise, b"", None, b"aabc", bytes(range(256)) * 4]
    for entropy in (scalars.shannon_entropy, scalars.shannon_entropy_builtin):
        out = column(spark, data, entropy, "binary")
        assert out[0] == 0 and out[1] > 7 and out[2] == out[3] == 0
        assert out[4] == pytest.approx(1.5) and out[5] == pytest.approx(8)
    ratios = column(spark, data, scalars.compression_ratio, "binary")
    assert ratios[1] == len(zlib.compress(noise, 9)) / 1000 and ratios[2] == ratios[3] == 0
    assert ratios[5] < 0.5 < ratios[4]


def test_scalars_are_callable_from_sql(spark):
    scalars.register(spark)
    row = spark.sql("select shannon_entropy(cast('ab' as binary)) e, compression_ratio(cast('' as binary)) c").first()
    assert (row["e"], row["c"]) == (1.0, 0.0)


def test_integers_times_types_and_hex(spark):
    assert column(spark, ["0x1F", "x12y3", "", None, "none", "9" * 30], fields.to_integer) == [31, 12, None, None, None, None]
    times = ["1700000000.25", "1970-01-01T00:00:01Z", "1970-01-01T00:00:01", "1970-01-01T01:00:00.5+01:00",
             "1970-01-01T00:00:00.123456789Z", "1e3", "soon", "1.5d", None]
    assert column(spark, times, fields.to_epoch_us) == [
        1700000000250000, 1000000, 1000000, 500000, 123456, 1000000000, None, None, None]
    names = ["16", " txt ", "TXT (16)", "0x1c", "65", "weird", "", None, "TYPE65", "A(1)"]
    assert column(spark, names, fields.record_type_name) == [
        "TXT", "TXT", "TXT", "AAAA", "TYPE65", "WEIRD", None, None, "TYPE65", "A"]
    texts = ["61:62", "6162", "61 62", '["6162", 3]', "abc", "zz", "", None]
    assert column(spark, texts, fields.hex_bytes) == [b"ab", b"ab", b"ab", b"ab", None, None, b"", None]


def test_payload_choice(spark):
    rows = [(b"u", b"t", "n", "x"), (b"", b"\0\2ab", "n", "x"), (None, b"\0\3ab", "n", "x"),
            (None, None, "n", "x"), (None, b"", None, "x"), (None, None, "", None)]
    df = spark.createDataFrame([(i, *r) for i, r in enumerate(rows)], "i int, u binary, t binary, n string, x string")
    out = df.select("i", fields.dns_payload(F.col("u"), F.col("t"), F.col("n"), F.col("x")).alias("p")).orderBy("i")
    assert [bytes(r["p"]) for r in out.collect()] == [b"u", b"ab", b"\0\3ab", b"n|x", b"x", b""]


def test_fields_at_any_depth(spark):
    layers = ['{"dns.qry.name":"flat","q":{"dns.qry.name":"deep"}}', '{"Queries":{"a: x":{"dns.qry.name":"a \\"q\\", b"}}}',
              '{"dns.qry.name_raw":["aa"]}', '{"x":{"dns.qry.name":["6162","1"]}}', None]
    assert column(spark, layers, lambda c: fields.field(c, "dns.qry.name")) == [
        "flat", 'a "q", b', None, '["6162","1"]', None]


NAMES = ["dns_iodine_covert_20240101T000000Z.pcap", "icmp_baseline_legit_20240102T030405Z.pcap",
         "a_b_legit_20240101T000000Z.pcap\n", "dns_x_other_20240101T000000Z.pcap", "dns_a_b_legit_20240101T000000Z.pcap",
         "Dns_x_covert_20240101T000000Z.pcap.gz", "invalid_name.pcap"]


def test_capture_names(spark):
    parts = column(spark, NAMES, parse_capture_name)
    assert parts[0].asDict() == {"protocol": "dns", "source": "iodine", "condition": "covert", "timestamp": "20240101T000000Z"}
    assert parts[1]["timestamp"] == "20240102T030405Z" and parts[2:] == [None] * 5
    assert str(column(spark, ["20240102T030405Z", "20249902T030405Z"], capture_time)) == \
        "[datetime.datetime(2024, 1, 2, 3, 4, 5), None]"


# --- captures written byte by byte -------------------------------------------------------------


def ip4(body, proto, src="10.0.0.2", dst="10.0.0.53", ttl=64, flags=0):
    head = struct.pack(">BBHHHBBH", 0x45, 0, 20 + len(body), 0, flags, ttl, proto, 0)
    return head + socket.inet_aton(src) + socket.inet_aton(dst) + body


def message(name, kind=1, answers=0):
    labels = b"".join(bytes([len(x)]) + x.encode() for x in name.split("."))
    flags = 0x8180 if answers else 0x0100
    return struct.pack(">HHHHHH", 1, flags, 1, answers, 0, 0) + labels + b"\0" + struct.pack(">HH", kind, 1)


def udp(data, sport=53000, dport=53):
    return struct.pack(">HHHH", sport, dport, 8 + len(data), 0) + data


def tcp(data, sport=53000, dport=53):
    return struct.pack(">HHIIBBHHH", sport, dport, 0, 0, 0x50, 0x18, 0, 0, 0) + data


def ping(data, kind=8):
    return struct.pack(">BBHHH", kind, 0, 0, 1, 1) + data


def pcap(frames, link=101, order="<", nano=False, start=1000.0):
    magic = 0xA1B23C4D if nano else 0xA1B2C3D4
    out = struct.pack(order + "IHHiIII", magic, 2, 4, 0, 0, 65535, link)
    for i, frame in enumerate(frames):
        out += struct.pack(order + "IIII", int(start) + 2 * i, 250_000_000 if nano else 250_000, len(frame), len(frame)) + frame
    return out


def block(kind, body, order):
    size = 12 + len(body)
    return struct.pack(order + "II", kind, size) + body + struct.pack(order + "I", size)


def pcapng(frames, link=101, order="<"):
    out = block(0x0A0D0D0A, struct.pack(order + "IHHq", 0x1A2B3C4D, 1, 0, -1), order)
    resolution = struct.pack(order + "HHB3x", 9, 1, 9) + struct.pack(order + "HH", 0, 0)
    out += block(1, struct.pack(order + "HHI", link, 0, 0) + resolution, order)
    for i, frame in enumerate(frames):
        ticks = (1000 + 2 * i) * 10**9 + 250_000_000
        pad = b"\0" * (-len(frame) % 4)
        body = struct.pack(order + "IIIII", 0, ticks >> 32, ticks & 0xFFFFFFFF, len(frame), len(frame)) + frame + pad
        out += block(6, body, order) + block(5, b"\0" * 8, order)
    return out


FRAMES = [
    ip4(udp(message("example.com")), 17), ip4(tcp(struct.pack(">H", 38) + message("payload.example.com", 16)[:37] + b"\0"), 6),
    ip4(ping(b"request-data"), 1), ip4(ping(b"reply-data-longer", 0), 1, ttl=63), ip4(udp(b"x" * 20, 1, 2), 17),
]
WRITERS = {
    "little.pcap": lambda f: pcap(f), "big.pcap": lambda f: pcap(f, order=">"), "nano.pcap": lambda f: pcap(f, nano=True),
    "ether.pcap": lambda f: pcap([b"\2" * 12 + b"\x81\0\0\1" + b"\x08\0" + x for x in f], 1),
    "cooked.pcap": lambda f: pcap([b"\0" * 14 + b"\x08\0" + x for x in f], 113),
    "blocks.pcapng": lambda f: pcapng(f), "bigblocks.pcapng": lambda f: pcapng(f, order=">"),
}


@pytest.mark.parametrize("split_bytes", [32 << 20, 60])
def test_every_capture_format_gives_the_same_packets(spark, tmp_path, split_bytes):
    for name, write in WRITERS.items():
        (tmp_path / name).write_bytes(write(FRAMES))
    files = captures.list_captures(spark, str(tmp_path))
    splits = captures.capture_splits(files, split_bytes)
    assert splits.count() == (len(WRITERS) if split_bytes > 100 else splits.filter("packets < 5").count())
    packets, rejected = decode_frames(captures.read_frames(splits))
    assert rejected.count() == 0
    by_file = {}
    for r in packets.orderBy("source_file", "packet_seq").collect():
        by_file.setdefault(r["source_file"], []).append(r)
    assert set(by_file) == set(WRITERS)
    for rows in by_file.values():
        assert [r["packet_seq"] for r in rows] == [0, 1, 2, 3]
        assert [r["ts_us"] for r in rows] == [1000250000 + 2000000 * i for i in range(4)]
        assert [r["qtype"] for r in rows[:2]] == ["A", "TXT"]
        assert rows[0]["query_name"] == "example.com" and rows[0]["query_length"] == 11
        assert (rows[0]["src_port"], rows[0]["dst_port"]) == (53000, 53)
        assert bytes(rows[0]["payload_bytes"]) == message("example.com")
        assert [bytes(r["payload_bytes"]) for r in rows[2:]] == [b"request-data", b"reply-data-longer"]
        assert [r["payload_length"] for r in rows[2:]] == [12, 17]
        assert [(r["icmp_type"], r["icmp_code"], r["ttl"]) for r in rows[2:]] == [(8, 0, 64), (0, 0, 63)]


def test_packet_size_is_the_whole_frame(spark, tmp_path):
    (tmp_path / "a.pcap").write_bytes(pcap(FRAMES[2:4]))
    packets, _ = captures.read_captures(captures.list_captures(spark, str(tmp_path)))
    assert sorted(r["packet_size"] for r in packets.collect()) == sorted(map(len, FRAMES[2:4]))


def test_ipv6_responses_fragments_and_cut_off_packets(spark, tmp_path):
    body = udp(message("v6.example", 28, answers=3), 53, 4000)
    six = struct.pack(">IHBB", 0x60000000, len(body), 17, 64) + socket.inet_pton(socket.AF_INET6, "fd00::1") \
        + socket.inet_pton(socket.AF_INET6, "fd00::2") + body
    frames = [six, ip4(ping(b"part"), 1, flags=0x2000), ip4(udp(b"tiny"), 17)]
    (tmp_path / "a.pcap").write_bytes(pcap(frames))
    packets, problems = captures.read_captures(captures.list_captures(spark, str(tmp_path)))
    row = packets.first()
    assert (row["src_ip"], row["dst_ip"], row["answer_count"], row["qtype"]) == ("fd00::1", "fd00::2", 3, "AAAA")
    errors = {r["packet_seq"]: r["error"] for r in problems.collect()}
    assert "fragment" in errors[1] and "DNS header" in errors[2] and packets.count() == 1


def test_truncated_capture_is_strict_or_lenient(spark, tmp_path):
    (tmp_path / "cut.pcap").write_bytes(pcap(FRAMES[2:4])[:-5])
    (tmp_path / "cutng.pcapng").write_bytes(pcapng(FRAMES[2:4])[:-30])
    (tmp_path / "good.pcap").write_bytes(pcap(FRAMES[2:4]))
    files = captures.list_captures(spark, str(tmp_path))
    packets, problems = captures.read_captures(files, strict=True)
    assert {r["source_file"] for r in packets.collect()} == {"good.pcap"} and packets.count() == 2
    assert {r["source_file"]: r["error"] for r in problems.collect()} == {
        "cut.pcap": "truncated capture", "cutng.pcapng": "truncated capture"}
    lenient, _ = captures.read_captures(files, strict=False)
    assert lenient.filter("source_file = 'cut.pcap'").count() == 1


def test_capture_checks(spark, tmp_path):
    (tmp_path / "a.pcap").write_bytes(pcap([]))
    (tmp_path / "b.pcapng").write_bytes(pcapng([]))
    (tmp_path / "c.pcap").write_bytes(b"nope")
    (tmp_path / "d.txt").write_bytes(pcap([]))
    (tmp_path / "e.pcap").write_bytes(pcap([bytes(500)]))
    heads = captures.capture_heads(captures.list_captures(spark, str(tmp_path), "*"))
    reasons = {r["path"][-6:]: r["reason"] for r in captures.validate_captures(heads, 400).collect()}
    assert reasons["a.pcap"] is None and reasons["pcapng"] is None
    assert "header" in reasons["c.pcap"] and "not a" in reasons["/d.txt"] and "limit" in reasons["e.pcap"]


def test_manifest_scan_write_read(spark, tmp_path):
    folder = tmp_path / "raw"
    folder.mkdir()
    for size, name in enumerate(n for n in NAMES if "\n" not in n):
        (folder / name).write_bytes(b"\0" * size)
    (folder / NAMES[0]).write_bytes(pcap(FRAMES))
    manifest = scan_capture_dir(spark, str(folder), count_packets=True)
    rows = manifest.collect()
    assert [r["filename"] for r in rows] == sorted(NAMES[:2])
    assert rows[0]["packet_count"] == 5 and rows[1]["file_size_bytes"] == 1
    write_manifest(manifest, str(tmp_path / "m"))
    again = read_manifest(spark, str(tmp_path / "m"))
    assert sorted(map(tuple, again.collect())) == sorted(map(tuple, rows))
    assert [tuple(r) for r in summarize_manifest(again).collect()] == [("dns", "covert", 1), ("icmp", "legit", 1)]
    assert with_capture_time(again).filter("captured_at is null").count() == 0


def test_export_lines(spark, tmp_path):
    (tmp_path / "x.json").write_text(
        '{"source_file":"a","packet_seq":1,"layers":{"frame":{"frame.time_epoch":"1.5","frame.len":"90"},'
        '"ip":{"ip.src":"1.1.1.1","ip.dst":"2.2.2.2"},"udp":{"udp.srcport":"1","udp.dstport":"53","udp.payload":"61:62"},'
        '"dns":{"t":{"dns.flags.response":"1"},"dns.count.answers":"2","Queries":{"q":{"dns.qry.name":"n.x","dns.qry.type":"16"}}}}}\n'
        '{"source_file":"a","packet_seq":2,"layers":{"frame":{},"icmp":{"icmp.type":"8"}}}\n')
    good, bad = dissector.export_packets(dissector.read_exports(spark, str(tmp_path)))
    row = good.first()
    assert (row["ts_us"], row["qtype"], row["answer_count"], row["query_name"], row["packet_size"]) == (1500000, "TXT", 2, "n.x", 90)
    assert bytes(row["payload_bytes"]) == b"ab" and good.count() == 1
    assert [r["packet_seq"] for r in bad.collect()] == [2]
