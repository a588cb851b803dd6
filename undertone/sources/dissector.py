"""Packet rows from dissector exports: JSON lines with one packet each.

A line holds ``source_file``, ``packet_seq`` and ``layers``; a layer stays JSON text until a
field of it is read. Files split anywhere between lines, so one huge capture is many tasks.
"""

from pyspark.sql import DataFrame, SparkSession, functions as F, types as T

from undertone.functions.fields import (
    dns_payload, field, hex_bytes, record_type_name, to_epoch_us, to_integer,
)
from undertone.schema import PACKET_SCHEMA

LAYERS = ["frame", "ip", "ipv6", "udp", "tcp", "dns", "icmp", "data"]
EXPORT_SCHEMA = T.StructType([
    T.StructField("source_file", T.StringType()),
    T.StructField("packet_seq", T.LongType()),
    T.StructField("layers", T.StructType([T.StructField(x, T.StringType()) for x in LAYERS])),
])
BASE = ["source_file", "packet_seq"]


def read_exports(spark: SparkSession, path) -> DataFrame:
    return spark.read.schema(EXPORT_SCHEMA).json(path)


def layer(name):
    return F.col(f"layers.{name}")


def number(text):
    return F.trim(text).try_cast("int")


def packet_frame(rows: DataFrame) -> DataFrame:
    """Bring decoded columns into the packet schema; absent ones become null."""
    nothing = F.lit(None)
    return rows.select(*[
        (F.col(f.name) if f.name in rows.columns else nothing).cast(f.dataType).alias(f.name)
        for f in PACKET_SCHEMA
    ])


def split_malformed(rows: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Good packets, and (source_file, packet_seq, error) of the others. One bad packet costs one row."""
    good = packet_frame(rows.filter("error is null"))
    return good, rows.filter("error is not null").select(*BASE, "error")


def with_fields(exports: DataFrame, wanted: dict) -> DataFrame:
    """Read each needed layer field once, as a text column; later columns build on these."""
    wanted = {"_time": "frame.time_epoch", "_length": "frame.len", **wanted}
    present = {f"_has_{name}": layer(name).isNotNull() for name in LAYERS}
    return exports.select(
        *BASE, *[column.alias(name) for name, column in present.items()],
        *[field(layer(path.split(".")[0]), path).alias(name) for name, path in wanted.items()],
    )


COMMON = {"ts_us": lambda: to_epoch_us(F.col("_time")), "packet_size": lambda: number(F.col("_length"))}
DNS_FIELDS = {
    **{f"_{side}{version[2:]}": f"{version}.{side}" for side in ("src", "dst") for version in ("ip", "ipv6")},
    **{f"_{kind}_{part}": f"{kind}.{part}" for kind in ("udp", "tcp") for part in ("srcport", "dstport", "payload")},
    "_name": "dns.qry.name", "_type": "dns.qry.type", "_response": "dns.flags.response",
    "_answers": "dns.count.answers", "_txt": "dns.txt",
}
ICMP_FIELDS = {
    "_src": "ip.src", "_dst": "ip.dst", "_ttl": "ip.ttl", "_icmp_type": "icmp.type",
    "_code": "icmp.code", "_raw": "icmp.data_raw", "_data": "data.data",
}


def dns_rows(exports: DataFrame) -> DataFrame:
    """DNS packets with an ``error`` column that is null for good ones."""
    rows = with_fields(exports.filter(layer("dns").isNotNull()), DNS_FIELDS)

    def address(side):
        return F.when(F.col("_has_ip"), F.col(f"_{side}")).otherwise(F.col(f"_{side}v6"))

    def port(side):
        return number(F.when(F.col("_has_udp"), F.col(f"_udp_{side}port")).otherwise(F.col(f"_tcp_{side}port")))

    name = F.nullif("_name", F.lit(""))
    response = F.coalesce(to_integer(F.col("_response")) == 1, F.lit(False))
    rows = rows.withColumns({
        **{key: make() for key, make in COMMON.items()},
        "protocol": F.lit("dns"), "src_ip": address("src"), "dst_ip": address("dst"),
        "src_port": port("src"), "dst_port": port("dst"),
        "query_name": name,
        "query_length": F.coalesce(F.char_length(name), F.lit(0)),
        "qtype": record_type_name(F.col("_type")),
        "answer_count": F.when(response, to_integer(F.col("_answers"))),
        "payload_bytes": dns_payload(
            hex_bytes(F.col("_udp_payload")), hex_bytes(F.col("_tcp_payload")), name, F.col("_txt")
        ),
    })
    no_layer = ~F.col("_has_ip") & ~F.col("_has_ipv6") | ~F.col("_has_udp") & ~F.col("_has_tcp")
    required = ["src_ip", "dst_ip", "src_port", "dst_port", "ts_us", "packet_size"]
    return rows.withColumn("error", F.when(no_layer, "no supported IP/transport layer").otherwise(
        _missing(required)
    ))


def icmp_rows(exports: DataFrame) -> DataFrame:
    """ICMP packets over IPv4 with an ``error`` column that is null for good ones."""
    rows = with_fields(exports.filter(layer("icmp").isNotNull()), ICMP_FIELDS)
    payload = F.coalesce(hex_bytes(F.col("_raw")), hex_bytes(F.col("_data")), F.lit(b""))
    rows = rows.withColumns({
        **{key: make() for key, make in COMMON.items()},
        "protocol": F.lit("icmp"), "src_ip": F.col("_src"), "dst_ip": F.col("_dst"),
        "icmp_type": to_integer(F.col("_icmp_type")), "icmp_code": to_integer(F.col("_code")),
        "payload_bytes": payload, "payload_length": F.octet_length(payload),
        "ttl": to_integer(F.col("_ttl")),
    })
    required = ["src_ip", "dst_ip", "ts_us", "packet_size"]
    return rows.withColumn(
        "error", F.when(~F.col("_has_ip"), "no IPv4 layer").otherwise(_missing(required))
    )


def _missing(required):
    absent = F.concat_ws(", ", *[F.when(F.col(c).isNull(), F.lit(c)) for c in required])
    return F.when(absent != "", F.concat(F.lit("unusable "), absent))


def export_packets(exports: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Packets of both protocols, and the malformed rows."""
    dns_good, dns_bad = split_malformed(dns_rows(exports))
    icmp_good, icmp_bad = split_malformed(icmp_rows(exports))
    return dns_good.unionByName(icmp_good), dns_bad.unionByName(icmp_bad)
