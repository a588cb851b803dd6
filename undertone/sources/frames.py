"""From raw link-layer frames to packet rows, with Spark's own binary expressions.

Input rows: source_file, packet_seq, ts_us, orig_len, link_type, frame BINARY. Only the DNS
question, a chain of labels, and IPv6 text need a small vectorised helper.
"""

import socket

import pandas as pd
from pyspark.sql import DataFrame, functions as F, types as T
from pyspark.sql.functions import pandas_udf

from undertone.functions.fields import big_endian, record_type_name, without_length_prefix
from undertone.sources.dissector import split_malformed

# Link types of capture files and the sizes of their headers.
ETHERNET, COOKED, COOKED_2 = 1, 113, 276
BARE_IP = (12, 14, 101, 228, 229)
LOOPBACK = (0, 108)
VLAN_TAGS = (0x8100, 0x88A8)
TCP, UDP, ICMP = 6, 17, 1
DNS_PORT = 53
# End of fixed values.


HEADER = T.StructType([
    T.StructField("transport", T.IntegerType()),
    T.StructField("src_ip", T.StringType()), T.StructField("dst_ip", T.StringType()),
    T.StructField("ttl", T.IntegerType()), T.StructField("fragment", T.BooleanType()),
    T.StructField("src_port", T.IntegerType()), T.StructField("dst_port", T.IntegerType()),
    T.StructField("body_at", T.IntegerType()), T.StructField("body_size", T.IntegerType()),
])
NOT_IP = (None,) * 9


def _number(frame, at, size=2):
    return int.from_bytes(frame[at:at + size], "big")


def _network_offset(frame, link):
    """Where the IP header starts; None for links and payloads that are not IP."""
    if link == ETHERNET:
        at = 12
        while _number(frame, at) in VLAN_TAGS and at < 24:
            at += 4
        return at + 2 if _number(frame, at) in (0x0800, 0x86DD) else None
    return {COOKED: 16, COOKED_2: 20, **dict.fromkeys(LOOPBACK, 4), **dict.fromkeys(BARE_IP, 0)}.get(link)


def dissect_header(frame, link):
    """Addresses, ports and the place of the transport payload (for ICMP: after its 8 bytes)."""
    at = _network_offset(frame, link)
    if at is None or len(frame) <= at:
        return NOT_IP
    version = frame[at] >> 4
    if version == 4 and len(frame) >= at + 20:
        start, transport, ttl = at + (frame[at] & 15) * 4, frame[at + 9], frame[at + 8]
        fragment = _number(frame, at + 6) & 0x3FFF != 0
        first = _number(frame, at + 6) & 0x1FFF == 0
        # A zero total length means the sender left segmentation to the network card.
        end = at + (_number(frame, at + 2) or len(frame) - at)
        family, src, dst = socket.AF_INET, frame[at + 12:at + 16], frame[at + 16:at + 20]
    elif version == 6 and len(frame) >= at + 40:
        start, transport, ttl, fragment, first = at + 40, frame[at + 6], None, False, True
        end = start + _number(frame, at + 4)
        family, src, dst = socket.AF_INET6, frame[at + 8:at + 24], frame[at + 24:at + 40]
    else:
        return NOT_IP
    ported = transport in (TCP, UDP) and first
    ports = (_number(frame, start), _number(frame, start + 2)) if ported else (None, None)
    skip = (frame[start + 12] >> 4) * 4 if transport == TCP and first and len(frame) > start + 12 else 8
    end = min(end, len(frame))
    return (transport, socket.inet_ntop(family, bytes(src)), socket.inet_ntop(family, bytes(dst)), ttl,
            fragment, *ports, start + skip, end - start - skip)


@pandas_udf(HEADER)
def frame_header(frame: pd.Series, link: pd.Series) -> pd.DataFrame:
    rows = [dissect_header(f, k) if f is not None else NOT_IP for f, k in zip(frame, link)]
    numbers = {f.name: "Int64" for f in HEADER if isinstance(f.dataType, T.IntegerType)}
    return pd.DataFrame(rows, columns=HEADER.names).astype({**numbers, "fragment": "boolean"})


QUESTION = T.StructType([T.StructField("name", T.StringType()), T.StructField("type", T.LongType())])


def first_question(message):
    """Name and type of a DNS message's first question; (None, None) if there is none or it is cut off."""
    if message is None or len(message) < 12 or not _number(message, 4):
        return None, None
    labels, at = [], 12
    while at < len(message):
        size = message[at]
        if size == 0:
            kind = _number(message, at + 1) if at + 3 <= len(message) else None
            return (".".join(labels) or "<Root>"), kind
        if size > 63 or at + 1 + size > len(message):
            break
        labels.append(bytes(message[at + 1:at + 1 + size]).decode("utf-8", "replace"))
        at += 1 + size
    return None, None


@pandas_udf(QUESTION)
def dns_question(message: pd.Series) -> pd.DataFrame:
    return pd.DataFrame([first_question(m) for m in message], columns=QUESTION.names).astype({"type": "Int64"})


def decode_frames(frames: DataFrame) -> tuple[DataFrame, DataFrame]:
    """DNS and ICMP packets of raw frames, and the DNS/ICMP frames that could not be used.

    Frames of other traffic are not packets of this table and are left out of both.
    """
    rows = frames.withColumn("_h", frame_header("frame", "link_type")).select(
        "source_file", "packet_seq", "ts_us", F.col("orig_len").alias("packet_size"), "_h.*",
        F.substring("frame", F.col("_h.body_at") + 1, F.col("_h.body_size")).alias("_body"),
        F.substring("frame", F.col("_h.body_at") - 7, F.lit(2)).alias("_kind"),
    )
    on_dns_port = (F.col("src_port") == DNS_PORT) | (F.col("dst_port") == DNS_PORT)
    is_icmp = (F.col("transport") == ICMP) & F.col("ttl").isNotNull()
    dns = F.col("protocol") == "dns"
    rows = rows.filter(is_icmp | (F.col("transport").isin(TCP, UDP) & on_dns_port)).withColumn(
        "protocol", F.when(F.col("transport") == ICMP, "icmp").otherwise("dns")
    )
    # Acknowledgements and handshakes on port 53 carry no DNS message.
    rows = rows.filter((F.col("transport") != TCP) | (F.col("body_size") > 0))
    message = F.when(F.col("transport") == TCP, without_length_prefix(F.col("_body"))).otherwise(F.col("_body"))
    rows = rows.withColumn("payload_bytes", F.coalesce(message, F.lit(b""))).withColumn(
        "_question", dns_question(F.when(dns, F.col("payload_bytes")))
    )
    payload, name = F.col("payload_bytes"), F.col("_question.name")
    response = F.shiftright(big_endian(payload, 2, 1), 7) == 1
    error = (
        F.when(F.col("fragment"), "fragment of a larger packet")
        .when(dns & (F.octet_length(payload) < 12), "cut off before the end of the DNS header")
        .when(F.col("body_size") < 0, "cut off before the end of the ICMP header")
    )
    return split_malformed(rows.withColumns({
        "query_name": name,
        "query_length": F.when(dns, F.coalesce(F.char_length(name), F.lit(0))),
        "qtype": record_type_name(F.col("_question.type").cast("string")),
        "answer_count": F.when(dns & response, big_endian(payload, 6, 2)),
        "icmp_type": F.when(~dns, big_endian(F.col("_kind"), 0, 1)),
        "icmp_code": F.when(~dns, big_endian(F.col("_kind"), 1, 1)),
        "payload_length": F.when(~dns, F.octet_length(payload)),
        "error": error,
    }))
