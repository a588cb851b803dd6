import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

from undertone.schema import PACKET_SCHEMA  # noqa: E402
from undertone.session import build_session  # noqa: E402


@pytest.fixture(scope="session")
def spark():
    session = build_session("tests", "local[4]", **{
        "spark.sql.shuffle.partitions": "4", "spark.ui.enabled": "false", "spark.driver.memory": "4g",
        "spark.ui.showConsoleProgress": "false",
    })
    session.sparkContext.setLogLevel("ERROR")
    yield session
    session.stop()


@pytest.fixture(scope="session")
def packets(spark):
    """Packet rows from dicts; times in seconds under ``t``."""

    def make(rows):
        full = []
        for i, row in enumerate(rows):
            row = {"source_file": "a.pcap", "packet_seq": i, "packet_size": 80, "payload_bytes": b"x", **row}
            row["ts_us"] = int(round(row.pop("t") * 1_000_000))
            full.append(tuple(row.get(f.name) for f in PACKET_SCHEMA))
        return spark.createDataFrame(full, PACKET_SCHEMA)

    return make


def dns(t, src="10.0.0.2", dst="10.0.0.53", sport=53000, dport=53, **more):
    return {"t": t, "protocol": "dns", "src_ip": src, "dst_ip": dst, "src_port": sport, "dst_port": dport, **more}


def icmp(t, src="10.0.0.2", dst="10.0.0.1", **more):
    return {"t": t, "protocol": "icmp", "src_ip": src, "dst_ip": dst, **more}
