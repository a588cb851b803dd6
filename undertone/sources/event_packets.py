"""A deterministic packet table over an ``events`` table, for tests and benchmarks.

Twelve capture sessions (per protocol four legitimate, two covert); every column is a plain
expression of one event row, so the view costs one scan and no shuffle.
"""

from pyspark.sql import DataFrame, SparkSession, functions as F

from undertone.schema import PACKET_SCHEMA

# Events are sparse, so the flow parameters are the defaults times 900.
SPARSE = {"timeout_seconds": 27000, "window_seconds": 27000, "min_duration_to_split": 54000}


def event_packets(spark: SparkSession, sf_dir: str) -> DataFrame:
    events = spark.read.parquet(f"{sf_dir}/events.parquet")
    slot = F.expr("user_id % 12")
    dns = F.expr("user_id % 2 = 0")
    covert = slot >= 8
    digest = F.md5(F.col("event_id").cast("string").cast("binary"))
    tool = (
        F.when(slot == 8, "iodine").when(slot == 9, "hans")
        .when(slot == 10, "dnscat2").when(slot == 11, "ptunnel").otherwise("baseline")
    )
    client = F.concat(F.lit("10.0."), F.expr("user_id div 256"), F.lit("."), F.expr("user_id % 256"))
    client_port = F.expr("cast(40000 + user_id % 1000 as int)")
    server, server_port = F.lit("10.9.0.53"), F.lit(53)
    upward = F.expr("event_id % 2 = 0")
    payload = F.when(covert, digest).otherwise(F.col("props"))
    name = F.when(
        dns,
        F.concat(F.when(covert, F.concat(digest, F.lit("."))).otherwise(F.lit("")),
                 F.col("event_type"), F.lit(".example.lab")),
    )
    qtype = F.when(
        dns,
        F.when(F.col("event_type") == "click", "A").when(F.col("event_type") == "view", "AAAA")
        .when(F.col("event_type") == "purchase", "TXT").when(F.col("event_type") == "signup", "NULL"),
    )
    columns = {
        "source_file": F.concat(
            F.when(dns, "dns").otherwise("icmp"), F.lit("_"), tool, F.lit("_"),
            F.when(covert, "covert").otherwise("legit"), F.lit("_202401"),
            (slot + 10).cast("string"), F.lit("T000000Z.pcap"),
        ),
        "packet_seq": F.col("event_id"),
        "ts_us": F.expr("timestampdiff(MICROSECOND, TIMESTAMP_NTZ'1970-01-01 00:00:00', ts)"),
        "protocol": F.when(dns, "dns").otherwise("icmp"),
        "src_ip": F.when(upward, client).otherwise(server),
        "dst_ip": F.when(upward, server).otherwise(client),
        "src_port": F.when(dns, F.when(upward, client_port).otherwise(server_port)),
        "dst_port": F.when(dns, F.when(upward, server_port).otherwise(client_port)),
        "packet_size": F.expr("cast(42 + floor(value) as int)") + F.octet_length(payload),
        "payload_bytes": payload.cast("binary"),
        "query_name": name,
        "query_length": F.octet_length(name),
        "qtype": qtype,
        "payload_length": F.octet_length(payload),
    }
    nothing = F.lit(None)
    return events.select(*[
        columns.get(field.name, nothing).cast(field.dataType).alias(field.name)
        for field in PACKET_SCHEMA
    ])
