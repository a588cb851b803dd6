"""Values of dissector exports: layer fields, integers, times, record types, payload bytes."""

from pyspark.sql import Column, functions as F

# DNS record types with a name of their own.
RECORD_TYPES = {
    1: "A", 2: "NS", 5: "CNAME", 6: "SOA", 10: "NULL", 12: "PTR", 15: "MX", 16: "TXT",
    28: "AAAA", 33: "SRV", 41: "OPT", 255: "ANY",
}
# End of fixed values.

EPOCH = "TIMESTAMP_NTZ'1970-01-01 00:00:00'"
JSON_VALUE = r'"(?:[^"\\]|\\.)*"|\[[^\]]*\]|[^,}\s]+'


def field(layer: Column, name: str) -> Column:
    """A field of a layer's JSON text: at the top, else its first occurrence at any depth."""
    pattern = '"' + name.replace(".", r"\.") + r'"\s*:\s*(' + JSON_VALUE + ")"
    literal = F.regexp_extract(layer, pattern, 1)
    nested = F.get_json_object(F.concat(F.lit('{"v":'), literal, F.lit("}")), "$.v")
    return F.coalesce(
        F.get_json_object(layer, f"$['{name}']"), F.when(literal != "", nested)
    )


def to_integer(text: Column) -> Column:
    """The first decimal or 0x number in a text; null if there is none."""
    token = F.lower(F.regexp_extract(text, r"(?i)0x[0-9a-f]+|[0-9]+", 0))
    hexadecimal = F.conv(F.substring(token, 3, 64), 16, 10)
    return F.when(
        token != "", F.when(token.startswith("0x"), hexadecimal).otherwise(token).try_cast("bigint")
    )


def micros_of(timestamp: Column) -> Column:
    """Microseconds since 1970 of a zone-free timestamp, whatever the session zone."""
    return F.timestamp_diff("MICROSECOND", F.lit("1970-01-01").cast("timestamp_ntz"), timestamp)


def to_epoch_us(text: Column) -> Column:
    """Microseconds from epoch-seconds text or ISO-8601 text; a missing zone means UTC."""
    text = F.trim(text)
    number = text.rlike(r"\A[+-]?([0-9]+\.?[0-9]*|\.[0-9]+)([eE][+-]?[0-9]+)?\z")
    seconds = F.when(number, text).try_cast("decimal(29,9)")
    zone = r"(Z|[+-][0-9]{2}:?[0-9]{2})\z"
    zoned = F.when(text.rlike(zone), F.unix_micros(text.try_cast("timestamp")))
    naive = F.when(~text.rlike(zone), micros_of(text.try_cast("timestamp_ntz")))
    return F.coalesce(F.round(seconds * F.lit(1_000_000)).cast("bigint"), F.when(~number, zoned), F.when(~number, naive))


def record_type_name(text: Column) -> Column:
    """A record type by name: a known label, else its number's label or TYPEn, else the label."""
    label = F.regexp_extract(F.upper(F.trim(text)), r"\A([^\s(]*)", 1)
    names = F.create_map(*[F.lit(x) for pair in RECORD_TYPES.items() for x in pair])
    code = to_integer(text)
    by_code = F.coalesce(F.try_element_at(names, code.try_cast("int")), F.concat(F.lit("TYPE"), code.cast("string")))
    known = label.isin(*RECORD_TYPES.values())
    return F.when(known, label).when(code.isNotNull(), by_code).otherwise(F.nullif(label, F.lit("")))


def hex_bytes(text: Column) -> Column:
    """Bytes from hex text, colons and blanks ignored; of a list its first item; null if invalid."""
    text = F.when(text.startswith("["), F.get_json_object(text, "$[0]")).otherwise(text)
    compact = F.regexp_replace(text, "[: ]", "")
    return F.when(compact.rlike(r"\A([0-9a-fA-F]{2})*\z"), F.unhex(compact))


def big_endian(data: Column, offset, length: int) -> Column:
    """Unsigned integer of ``length`` bytes at a 0-based offset."""
    offset = offset if isinstance(offset, Column) else F.lit(offset)
    piece = F.substring(data, offset + 1, F.lit(length))
    return F.conv(F.hex(piece), 16, 10).cast("bigint")


def without_length_prefix(payload: Column) -> Column:
    """DNS over TCP: drop the two length bytes when they state the remaining size."""
    size = F.octet_length(payload)
    declared = big_endian(payload, 0, 2) == size - 2
    return F.when((size >= 2) & declared, F.substring(payload, F.lit(3), size)).otherwise(payload)


def dns_payload(udp: Column, tcp: Column, query_name: Column, txt: Column) -> Column:
    """UDP payload, else TCP payload, else the visible DNS strings; never null."""
    empty = F.lit("")
    words = F.concat_ws("|", F.nullif(query_name, empty), F.nullif(txt, empty))
    filled_udp = F.when(F.octet_length(udp) > 0, udp)
    filled_tcp = F.when(F.octet_length(tcp) > 0, without_length_prefix(tcp))
    return F.coalesce(filled_udp, filled_tcp, words.cast("binary"))
