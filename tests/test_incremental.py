"""A dataset that follows its folder: what a refresh reads, and what it leaves alone."""

import os

import pytest

from test_parsing import FRAMES, ip4, message, pcap, ping, udp
from undertone.plans import incremental
from undertone.sources.history import Folder

DNS = [ip4(udp(message("example.com"), 40000 + k), 17, f"10.0.0.{k + 2}") for k in range(4)]
ICMP = [ip4(ping(b"x" * 20), 1, f"10.0.0.{k + 2}") for k in range(3)]


def name(k, protocol="dns"):
    return f"{protocol}_t{k}_legit_20240101T00000{k}Z.pcap"


def state(spark, table, version=None):
    rows = incremental.read_dataset(spark, table, version).groupBy("source_file").sum("packet_count").collect()
    return {r[0]: r[1] for r in rows}


def changes_of(found):
    return {r["filename"]: r["change"] for r in found.collect()}


def test_a_refresh_reads_only_what_is_new_or_changed(spark, tmp_path):
    folder, table = tmp_path / "captures", str(tmp_path / "dataset")
    folder.mkdir()
    (folder / name(0)).write_bytes(pcap(DNS))
    (folder / name(1, "icmp")).write_bytes(pcap(ICMP))
    (folder / name(2)).write_bytes(pcap(DNS)[:-3])
    (folder / "notes.txt").write_text("x")
    assert set(changes_of(incremental.refresh(spark, str(folder), table)).values()) == {"new"}
    assert state(spark, table) == {name(0): 4, name(1, "icmp"): 3}
    errors = {r["filename"]: r["error"] for r in incremental.read_manifest(spark, table).collect()}
    assert errors == {name(0): None, name(1, "icmp"): None, name(2): "truncated capture", "notes.txt": "not a .pcap or .pcapng file"}

    # Junk of the same length and time: were the file opened again, its rows would be lost.
    times = os.stat(folder / name(0))
    (folder / name(0)).write_bytes(b"j" * times.st_size)
    os.utime(folder / name(0), ns=(times.st_atime_ns, times.st_mtime_ns))
    (folder / name(2)).write_bytes(pcap(DNS[:2]))
    os.utime(folder / name(2), (1, 1))
    (folder / name(3)).write_bytes(pcap(DNS[:1]))
    (folder / name(1, "icmp")).unlink()
    found = changes_of(incremental.refresh(spark, str(folder), table))
    assert found == {name(0): "kept", name(1, "icmp"): "removed", name(2): "changed", name(3): "new", "notes.txt": "kept"}
    assert state(spark, table) == {name(0): 4, name(2): 2, name(3): 1}
    # The first version still reads as it did.
    assert state(spark, table, 1) == {name(0): 4, name(1, "icmp"): 3}
    rows = incremental.read_dataset(spark, table)
    assert rows.select("run").distinct().count() == 2

    assert set(changes_of(incremental.refresh(spark, str(folder), table)).values()) == {"kept"}
    assert state(spark, table) == {name(0): 4, name(2): 2, name(3): 1}
    with pytest.raises(ValueError, match="version 9"):
        incremental.read_dataset(spark, table, 9)


def test_of_two_refreshes_at_once_one_fails(spark, tmp_path, monkeypatch):
    folder, table = tmp_path / "captures", str(tmp_path / "dataset")
    folder.mkdir()
    (folder / name(0)).write_bytes(pcap(FRAMES[:2]))
    incremental.refresh(spark, str(folder), table)
    (folder / name(1)).write_bytes(pcap(DNS))

    def late(*args, load=incremental.load_captures, **more):
        # Meanwhile another refresh commits the next version.
        assert Folder(spark, f"{table}/_commits").create(f"{2:012d}.json", "{}")
        return load(*args, **more)

    monkeypatch.setattr(incremental, "load_captures", late)
    with pytest.raises(RuntimeError, match="version 2"):
        incremental.refresh(spark, str(folder), table)


def test_an_empty_dataset(spark, tmp_path):
    assert incremental.read_dataset(spark, str(tmp_path / "none")).count() == 0
