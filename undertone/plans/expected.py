"""The same results as plain SQL over the source tables, for an independent engine.

Written from the definitions, packet by packet with ordinary windows, not from the job's plans.
"""

PACKETS = """
packets AS (
  SELECT event_id AS packet_seq, epoch_us(ts) AS ts_us, user_id % 12 AS slot, event_type,
    CASE WHEN user_id % 2 = 0 THEN 'dns' ELSE 'icmp' END AS protocol,
    CASE WHEN user_id % 12 >= 8 THEN 'covert' ELSE 'legit' END AS condition,
    CASE WHEN user_id % 12 >= 8 THEN 1 ELSE 0 END AS label,
    (CASE WHEN user_id % 2 = 0 THEN 'dns' ELSE 'icmp' END) || '_' ||
      (CASE user_id % 12 WHEN 8 THEN 'iodine' WHEN 9 THEN 'hans' WHEN 10 THEN 'dnscat2'
        WHEN 11 THEN 'ptunnel' ELSE 'baseline' END) || '_' ||
      (CASE WHEN user_id % 12 >= 8 THEN 'covert' ELSE 'legit' END) ||
      '_202401' || (10 + user_id % 12) || 'T000000Z.pcap' AS source_file,
    '10.0.' || (user_id // 256) || '.' || (user_id % 256) AS client_ip,
    CASE WHEN user_id % 2 = 0 THEN (40000 + user_id % 1000)::INTEGER END AS client_port,
    CASE WHEN user_id % 2 = 0 THEN 53 END AS server_port,
    event_id % 2 = 0 AS upward,
    CASE WHEN user_id % 12 >= 8 THEN md5(event_id::VARCHAR) ELSE props END AS payload,
    CASE WHEN user_id % 2 = 0 THEN
      (CASE WHEN user_id % 12 >= 8 THEN md5(event_id::VARCHAR) || '.' ELSE '' END)
        || event_type || '.example.lab' END AS query_name,
    CASE WHEN user_id % 2 = 0 THEN CASE event_type WHEN 'click' THEN 'A' WHEN 'view' THEN 'AAAA'
      WHEN 'purchase' THEN 'TXT' WHEN 'signup' THEN 'NULL' END END AS qtype,
    (42 + floor(value))::INTEGER AS base_size
  FROM events
),
sized AS (
  SELECT *, octet_length(payload::BLOB)::INTEGER AS payload_length,
    octet_length(query_name::BLOB)::INTEGER AS query_length,
    base_size + octet_length(payload::BLOB)::INTEGER AS packet_size,
    CASE WHEN upward THEN client_ip ELSE '10.9.0.53' END AS src_ip,
    CASE WHEN upward THEN '10.9.0.53' ELSE client_ip END AS dst_ip,
    CASE WHEN upward THEN client_port ELSE server_port END AS src_port,
    CASE WHEN upward THEN server_port ELSE client_port END AS dst_port,
    CASE WHEN octet_length(payload::BLOB) = 0 THEN 0.0
      ELSE abs(list_aggregate(string_split(payload, ''), 'entropy')) END AS entropy
  FROM packets
)"""

CAPTURE_FILES = """, dealt AS (
  SELECT *, (slot * 3 + packet_seq % 3 + packet_seq // 6000) % 7 AS damage,
    split_part(source_file, '_', 1) || '_' || split_part(source_file, '_', 2) || '-' ||
      (CASE packet_seq % 3 WHEN 0 THEN '1' WHEN 1 THEN '113' ELSE '101' END) || '_' || condition || '_202401' || (10 + slot) ||
      'T' || lpad((packet_seq // 6000)::VARCHAR, 6, '0') AS stem
  FROM packets),
files AS (
  SELECT stem || (CASE WHEN damage = 2 THEN 'Z.pcapx' ELSE 'Z.pcap' END) AS source_file, any_value(condition) = 'covert' AS covert,
    CASE WHEN damage <> 2 THEN any_value(protocol) END AS protocol, CASE WHEN damage <> 2 THEN any_value(condition) END AS condition,
    (CASE damage WHEN 0 THEN 0 WHEN 1 THEN count(*) - 1 WHEN 2 THEN 0 ELSE count(*) END)::BIGINT AS packets,
    CASE damage WHEN 0 THEN 'no valid capture header' WHEN 1 THEN 'truncated capture'
      WHEN 2 THEN 'not a .pcap or .pcapng file' END AS error, min(ts_us) AS first_us, max(ts_us) AS last_us
  FROM dealt GROUP BY stem, damage)
"""

FLOWS = PACKETS + """,
keyed AS (
  SELECT *, (dst_ip, coalesce(dst_port, -1)) < (src_ip, coalesce(src_port, -1)) AS swapped FROM sized
),
conversations AS (
  SELECT *, CASE WHEN swapped THEN dst_ip ELSE src_ip END AS ip_a,
    CASE WHEN swapped THEN dst_port ELSE src_port END AS port_a,
    CASE WHEN swapped THEN src_ip ELSE dst_ip END AS ip_b,
    CASE WHEN swapped THEN src_port ELSE dst_port END AS port_b
  FROM keyed
),
gaps AS (
  SELECT *, ts_us - lag(ts_us) OVER conv AS gap FROM conversations
  WINDOW conv AS (PARTITION BY source_file, protocol, ip_a, port_a, ip_b, port_b ORDER BY ts_us, packet_seq)
),
heads AS (
  SELECT *, CASE WHEN gap IS NULL OR gap > 27000000000 THEN 1 ELSE 0 END AS is_head FROM gaps
),
counted AS (
  SELECT *, sum(is_head) OVER (PARTITION BY source_file, protocol, ip_a, port_a, ip_b, port_b
    ORDER BY ts_us, packet_seq ROWS UNBOUNDED PRECEDING) AS nth FROM heads
),
numbered AS (
  SELECT source_file, ip_a, port_a, ip_b, port_b, nth,
    row_number() OVER (PARTITION BY source_file ORDER BY ts_us, packet_seq) - 1 AS flow_number
  FROM counted WHERE is_head = 1
),
flows AS (
  SELECT c.*, n.flow_number FROM counted c JOIN numbered n ON c.source_file = n.source_file
    AND c.ip_a = n.ip_a AND c.port_a IS NOT DISTINCT FROM n.port_a AND c.ip_b = n.ip_b
    AND c.port_b IS NOT DISTINCT FROM n.port_b AND c.nth = n.nth
),
spans AS (
  SELECT *, min(ts_us) OVER f AS flow_start, max(ts_us) OVER f AS flow_end FROM flows
  WINDOW f AS (PARTITION BY source_file, flow_number)
),
bins AS (
  SELECT *, flow_end - flow_start >= 54000000000 AS is_long,
    CASE WHEN flow_end - flow_start >= 54000000000
      THEN (ts_us - flow_start) // 27000000000 ELSE 0 END AS bin FROM spans
),
ranked AS (
  SELECT *, dense_rank() OVER (PARTITION BY source_file, flow_number ORDER BY bin) - 1 AS win0 FROM bins
),
sizes AS (
  SELECT *, count(*) OVER (PARTITION BY source_file, flow_number, win0) AS win_rows,
    max(win0) OVER (PARTITION BY source_file, flow_number) AS last_win FROM ranked
),
windowed AS (
  SELECT *, CASE WHEN win0 = last_win AND last_win > 0 AND win_rows < 2 THEN win0 - 1 ELSE win0 END AS win
  FROM sizes
),
placed AS (
  SELECT *, ts_us - lag(ts_us) OVER (PARTITION BY source_file, flow_number, win ORDER BY ts_us, packet_seq) AS gap_us,
    CASE WHEN is_long THEN flow_number::VARCHAR || '_w' || win ELSE flow_number::VARCHAR END AS flow_id
  FROM windowed
)"""

FEATURES = FLOWS + """,
features AS (
  SELECT flow_id, protocol, source_file, label, count(*) AS packet_count,
    min(ts_us) AS start_us, max(ts_us) AS end_us,
    (max(ts_us) - min(ts_us)) / 1e6 AS duration_seconds,
    avg(packet_size) AS size_mean, stddev_pop(packet_size) AS size_std,
    coalesce(stddev_pop(packet_size) / nullif(avg(packet_size), 0), 0) AS size_cv,
    coalesce(avg(gap_us / 1e6), 0) AS interarrival_mean,
    coalesce(stddev_pop(gap_us / 1e6), 0) AS interarrival_std,
    coalesce(stddev_pop(gap_us / 1e6) / nullif(avg(gap_us / 1e6), 0), 0) AS interarrival_cv,
    count(*) = 1 AS is_single_packet_flow,
    avg(entropy) AS entropy_mean, max(entropy) AS entropy_max,
    CASE WHEN protocol = 'dns' THEN coalesce(avg(query_length), 0) END AS mean_query_length,
    CASE WHEN protocol = 'dns' THEN coalesce(avg(CASE WHEN qtype IS NOT NULL
      THEN (qtype IN ('TXT', 'NULL'))::INTEGER END), 0) END AS txt_null_ratio,
    CASE WHEN protocol = 'dns' THEN coalesce(max(query_length), 0)::DOUBLE END AS max_query_length,
    CASE WHEN protocol = 'icmp' THEN
      coalesce(stddev_pop(payload_length) / nullif(avg(payload_length), 0), 0) END AS icmp_size_cv
  FROM placed GROUP BY flow_id, protocol, source_file, label
)"""

NUDGE = 1.23e-7


def rounded(name, digits=6, alias=None, source=None):
    """Rounding shared with the catalog: a nudge keeps exact ties from falling either way."""
    return f"round(({source or name}) + {NUDGE!r}, {digits}) AS {alias or name}"


# Seconds are whole microseconds and fall on ties; fewer digits keep them stable.
SECONDS = ("duration_seconds", "interarrival_mean", "interarrival_std")


def digits_of(name):
    return 4 if name in SECONDS else 6


def rounded_list(names):
    return ", ".join(rounded(n, digits_of(n)) for n in names)


def on(base, select):
    return f"WITH {base}\n{select}"


SIZE = ["size_mean", "size_std", "size_cv"]
TIMING = ["interarrival_mean", "interarrival_std", "interarrival_cv"]
ENTROPY = ["entropy_mean", "entropy_max"]
DNS = ["mean_query_length", "txt_null_ratio", "max_query_length"]
NUMERIC = ["packet_count", "duration_seconds", *SIZE, *TIMING, *ENTROPY, *DNS, "icmp_size_cv"]
DNS_INPUTS = ["packet_count", "duration_seconds", *SIZE, *TIMING, "is_single_packet_flow", *ENTROPY,
              "mean_query_length", "txt_null_ratio"]
ICMP_INPUTS = ["packet_count", "duration_seconds", *SIZE, *TIMING, "is_single_packet_flow", *ENTROPY,
               "icmp_size_cv"]
ALL_INPUTS = ["packet_count", "duration_seconds", *SIZE, *TIMING, "is_single_packet_flow", *ENTROPY,
              "mean_query_length", "txt_null_ratio", "icmp_size_cv"]
KEY = "source_file, flow_id"


def feature_select(names):
    plain = [n for n in names if n in ("packet_count", "is_single_packet_flow")]
    return on(FEATURES, f"SELECT {KEY}, {', '.join(plain + [rounded_list([n for n in names if n not in plain])])} FROM features")


def matrix(names, protocol):
    casts = ", ".join(
        f"{n}::INTEGER::DOUBLE AS {n}" if n == "is_single_packet_flow" else
        f"coalesce({n}, 0)::DOUBLE AS {n}" for n in names
    )
    where = f" WHERE protocol = '{protocol}'" if protocol else ""
    return FEATURES + f",\nmatrix AS (SELECT source_file, flow_id, label, {casts} FROM features{where})"


def long_union(names, table, keys, value="{0}"):
    return " UNION ALL ".join(
        f"SELECT {keys}, '{n}' AS feature, {value.format(n)} AS value FROM {table}" for n in names
    )


def scaler_sql(names, where=""):
    return " UNION ALL ".join(
        f"SELECT '{n}' AS feature, {rounded('mean', 6, source=f'avg({n})')}, "
        + rounded("scale", 6, source=f"CASE WHEN stddev_pop({n}) < 1e-9 THEN 1.0 ELSE stddev_pop({n}) END")
        + f" FROM matrix{where}" for n in names
    )


def fold_scaler_sql(names):
    return " UNION ALL ".join(
        f"SELECT f.fold, '{n}' AS feature, {rounded('mean', 6, source=f'avg({n})')}, "
        + rounded("scale", 6, source=f"CASE WHEN min({n}) = max({n}) THEN 1.0 ELSE stddev_pop({n}) END")
        + " FROM folds f JOIN matrix m ON m.source_file <> f.fold GROUP BY f.fold" for n in names
    )


def folds_of(base):
    return base + ",\nfolds AS (SELECT DISTINCT source_file AS fold FROM matrix)"


CENSUS = """census AS (
  SELECT f.fold, count(*) FILTER (m.source_file <> f.fold AND label = 0) AS train_legit,
    count(*) FILTER (m.source_file <> f.fold AND label = 1) AS train_covert,
    count(*) FILTER (m.source_file = f.fold AND label = 0) AS test_legit,
    count(*) FILTER (m.source_file = f.fold AND label = 1) AS test_covert
  FROM folds f CROSS JOIN matrix m GROUP BY f.fold
),
census_typed AS (
  SELECT *, CASE WHEN test_covert = 0 THEN 'legit-holdout' WHEN test_legit = 0 THEN 'covert-holdout'
    ELSE 'mixed-holdout' END AS fold_type, train_legit = 0 AS training_had_no_legit_examples FROM census
)"""

# The score of the checks is the raw size_mean for ranking, and standardized per fold for LOSO.
LOSO = folds_of(matrix(DNS_INPUTS, "dns")) + ",\n" + CENSUS + """,
scalers AS (
  SELECT f.fold, avg(size_mean) AS mean, stddev_pop(size_mean) AS scale
  FROM folds f JOIN matrix m ON m.source_file <> f.fold GROUP BY f.fold
),
scored AS (
  SELECT s.fold, m.label, m.source_file = s.fold AS is_test, (m.size_mean - s.mean) / s.scale AS score
  FROM scalers s CROSS JOIN matrix m
),
limits AS (SELECT fold, quantile_cont(score, 0.9) AS threshold FROM scored WHERE NOT is_test GROUP BY fold),
cells AS (
  SELECT s.fold, any_value(threshold) AS threshold,
    count(*) FILTER (score >= threshold AND label = 1) AS tp, count(*) FILTER (score >= threshold AND label = 0) AS fp,
    count(*) FILTER (score < threshold AND label = 0) AS tn, count(*) FILTER (score < threshold AND label = 1) AS fn
  FROM scored s JOIN limits l ON s.fold = l.fold WHERE is_test GROUP BY s.fold
),
loso AS (
  SELECT 'dns' AS protocol, fold, fold_type, train_legit, train_covert, test_legit, test_covert,
    threshold, coalesce(tp / nullif(tp + fp, 0), 0) AS precision,
    CASE WHEN fold_type = 'covert-holdout' THEN tp / (tp + fn) END AS recall,
    coalesce(2 * tp / nullif(2 * tp + fp + fn, 0), 0) AS f1, tp, fp, tn, fn,
    CASE WHEN fold_type = 'legit-holdout' THEN fp / (fp + tn) END AS fpr
  FROM cells JOIN census_typed USING (fold)
)"""

RANKED = FEATURES + """,
scored AS (SELECT protocol, label, size_mean AS score FROM features),
ranks AS (
  SELECT *, rank() OVER (PARTITION BY protocol ORDER BY score)
    + (count(*) OVER (PARTITION BY protocol, score) - 1) / 2.0 AS avg_rank FROM scored
),
totals AS (
  SELECT protocol, count(*) FILTER (label = 1) AS p, count(*) FILTER (label = 0) AS n,
    sum(avg_rank) FILTER (label = 1) AS rank_sum FROM ranks GROUP BY protocol
),
steps AS (
  SELECT protocol, score, count(*) FILTER (label = 1) AS here_pos, count(*) AS here FROM scored GROUP BY protocol, score
),
running AS (
  SELECT *, sum(here_pos) OVER w AS pos, sum(here) OVER w AS seen FROM steps
  WINDOW w AS (PARTITION BY protocol ORDER BY score DESC ROWS UNBOUNDED PRECEDING)
),
ap AS (SELECT r.protocol, sum((here_pos / p) * (pos / seen)) AS avg_precision FROM running r JOIN totals t ON r.protocol = t.protocol GROUP BY r.protocol)"""

LIMITED = FEATURES + """,
scored AS (SELECT protocol, label, size_mean AS score FROM features),
limits AS (SELECT protocol, quantile_cont(score, 0.9) AS threshold FROM scored WHERE label = 0 GROUP BY protocol),
cells AS (
  SELECT s.protocol, any_value(threshold) AS threshold,
    count(*) FILTER (score >= threshold AND label = 1) AS tp, count(*) FILTER (score >= threshold AND label = 0) AS fp,
    count(*) FILTER (score < threshold AND label = 0) AS tn, count(*) FILTER (score < threshold AND label = 1) AS fn
  FROM scored s JOIN limits l ON s.protocol = l.protocol GROUP BY s.protocol
)"""

RATES = (
    "SELECT protocol, " + rounded("threshold", 6) + ", tp, fp, tn, fn, "
    + rounded("precision", 6, source="coalesce(tp / nullif(tp + fp, 0), 0)") + ", "
    + rounded("recall", 6, source="coalesce(tp / nullif(tp + fn, 0), 0)") + ", "
    + rounded("f1", 6, source="coalesce(2 * tp / nullif(2 * tp + fp + fn, 0), 0)") + " FROM cells"
)

AUDITED = [
    "packet_count", "duration_seconds", "size_mean", "size_std", "size_cv", "interarrival_mean",
    "interarrival_std", "interarrival_cv", "entropy_mean", "entropy_max", "is_single_packet_flow",
    "mean_query_length", "txt_null_ratio", "max_query_length", "icmp_size_cv",
]
INSPECTED = {"dns": ["size_cv", "interarrival_cv", "entropy_mean", "mean_query_length", "txt_null_ratio"],
             "icmp": ["size_cv", "interarrival_cv", "entropy_mean", "icmp_size_cv"]}
NUMBERS = FEATURES + """,
numbers AS (SELECT protocol, label, source_file, """ + ", ".join(
    f"{n}::INTEGER::DOUBLE AS {n}" if n == "is_single_packet_flow" else f"{n}::DOUBLE AS {n}" for n in AUDITED
) + " FROM features)"


def pair_sql():
    rows = []
    for a in AUDITED:
        for b in AUDITED:
            both = f"{a} IS NOT NULL AND {b} IS NOT NULL"
            value = (f"CASE WHEN min({a}) FILTER ({both}) < max({a}) FILTER ({both}) AND "
                     f"min({b}) FILTER ({both}) < max({b}) FILTER ({both}) THEN corr({a}, {b}) END")
            rows.append(f"SELECT '{a}' AS \"left\", '{b}' AS \"right\", {value} AS value FROM numbers")
    return " UNION ALL ".join(rows)


INSPECTED_LONG = " UNION ALL ".join(
    f"SELECT protocol, label, '{n}' AS feature, {n} AS value FROM numbers WHERE protocol = '{p}'"
    for p, names in INSPECTED.items() for n in names
)
COMPARED = ["size_cv", "interarrival_cv", "entropy_mean", "mean_query_length", "duration_seconds", "packet_count"]

NAMES = """
names AS (
  SELECT event_id, CASE event_id % 6
    WHEN 0 THEN 'dns_tool' || user_id || '_legit_20240101T000000Z.pcap'
    WHEN 1 THEN 'icmp_' || event_type || '_covert_202401' || lpad((event_id % 28 + 1)::VARCHAR, 2, '0') || 'T101112Z.pcap'
    WHEN 2 THEN 'dns_' || event_type || '_benign_20240101T000000Z.pcap'
    WHEN 3 THEN 'dns_a_b_legit_20240101T000000Z.pcap'
    WHEN 4 THEN event_type || '_x_covert_20240101T000000Z.pcapng'
    ELSE 'dns_x_legit_20240101T000000Z.pcap' || chr(10) END AS filename
  FROM events
)"""
NAME_PATTERN = "([^_]+)_([^_]+)_(legit|covert)_([0-9]{8}T[0-9]{6}Z)\\.pcap"

TOKENS = """
tokens AS (
  SELECT event_id, CASE event_id % 6
    WHEN 0 THEN 'port ' || user_id || ' of 9' WHEN 1 THEN '0x' || lower(to_hex(event_id))
    WHEN 2 THEN event_type WHEN 3 THEN props WHEN 4 THEN 'TXT (16)' ELSE '' END AS text
  FROM events
)"""
TOKEN_VALUE = """CASE event_id % 6 WHEN 0 THEN regexp_extract(text, '[0-9]+')::BIGINT WHEN 1 THEN event_id
  WHEN 3 THEN nullif(regexp_extract(text, '[0-9]+'), '')::BIGINT WHEN 4 THEN 16 END"""

TIMES = """
times AS (
  SELECT event_id, epoch_us(ts) AS us, CASE event_id % 5
    WHEN 0 THEN (epoch_us(ts) // 1000000) || '.' || lpad((epoch_us(ts) % 1000000)::VARCHAR, 6, '0')
    WHEN 1 THEN strftime(ts, '%Y-%m-%dT%H:%M:%S.%f') || 'Z'
    WHEN 2 THEN strftime(ts, '%Y-%m-%dT%H:%M:%S.%f')
    WHEN 3 THEN strftime(ts, '%Y-%m-%dT%H:%M:%S.%f') || '+02:00'
    ELSE event_type END AS text
  FROM events
)"""

TYPES = """
types AS (
  SELECT event_id, event_type, CASE event_id % 7 WHEN 0 THEN '16' WHEN 1 THEN ' txt (16)' WHEN 2 THEN '0x1c'
    WHEN 3 THEN (event_id % 300)::VARCHAR WHEN 4 THEN event_type WHEN 5 THEN 'TYPE65 (HTTPS)' ELSE ' ' END AS text
  FROM events
)"""
TYPE_VALUE = """CASE event_id % 7 WHEN 0 THEN 'TXT' WHEN 1 THEN 'TXT' WHEN 2 THEN 'AAAA'
  WHEN 3 THEN CASE event_id % 300 WHEN 1 THEN 'A' WHEN 2 THEN 'NS' WHEN 5 THEN 'CNAME' WHEN 6 THEN 'SOA'
    WHEN 10 THEN 'NULL' WHEN 12 THEN 'PTR' WHEN 15 THEN 'MX' WHEN 16 THEN 'TXT' WHEN 28 THEN 'AAAA'
    WHEN 33 THEN 'SRV' WHEN 41 THEN 'OPT' WHEN 255 THEN 'ANY' ELSE 'TYPE' || (event_id % 300) END
  WHEN 4 THEN upper(event_type) WHEN 5 THEN 'TYPE65' END"""

HEXES = """
hexes AS (
  SELECT event_id, props, CASE event_id % 5 WHEN 0 THEN lower(hex(props::BLOB))
    WHEN 1 THEN rtrim(regexp_replace(hex(props::BLOB), '(..)', '\\1:', 'g'), ':')
    WHEN 2 THEN '["' || hex(props::BLOB) || '", "7"]' WHEN 3 THEN hex(props::BLOB) || 'a' ELSE event_type END AS text
  FROM events
)"""

EXPORTED = PACKETS + """,
exported AS (
  SELECT *, protocol = 'dns' AND packet_seq % 11 = 0 AS six, protocol = 'dns' AND packet_seq % 5 = 0 AS tcp,
    packet_seq % 17 = 0 AS lost FROM sized
)"""

DATASET = FEATURES

SQL = {
    "packet_sessions": on(PACKETS, """SELECT source_file, protocol, count(*) AS packets,
      sum(packet_size)::BIGINT AS bytes, min(ts_us) AS first_us, max(ts_us) AS last_us,
      count(qtype) AS typed FROM sized GROUP BY source_file, protocol"""),
    "capture_names": on(NAMES, f"""SELECT event_id,
      CASE WHEN ok THEN regexp_extract(filename, '{NAME_PATTERN}', 1) END AS protocol,
      CASE WHEN ok THEN regexp_extract(filename, '{NAME_PATTERN}', 2) END AS source,
      CASE WHEN ok THEN regexp_extract(filename, '{NAME_PATTERN}', 3) END AS condition,
      CASE WHEN ok THEN regexp_extract(filename, '{NAME_PATTERN}', 4) END AS "timestamp"
      FROM (SELECT *, regexp_full_match(filename, '{NAME_PATTERN}') AS ok FROM names)"""),
    "manifest_summary": on(PACKETS, """SELECT protocol, condition, count(DISTINCT source_file) AS "count"
      FROM sized GROUP BY protocol, condition"""),
    "integer_tokens": on(TOKENS, f"SELECT event_id, {TOKEN_VALUE} AS value FROM tokens"),
    "epoch_texts": on(TIMES, """SELECT event_id, CASE event_id % 5 WHEN 3 THEN us - 7200000000
      WHEN 4 THEN NULL ELSE us END AS ts_us FROM times"""),
    "record_types": on(TYPES, f"SELECT event_id, {TYPE_VALUE} AS qtype FROM types"),
    "hex_texts": on(HEXES, """SELECT event_id, CASE WHEN event_id % 5 < 3 THEN hex(props::BLOB) END AS bytes FROM hexes"""),
    "dns_payload_choice": on(PACKETS, """SELECT packet_seq, CASE packet_seq % 4
      WHEN 0 THEN hex(payload::BLOB) WHEN 1 THEN hex(payload::BLOB) WHEN 2 THEN 'FFFF' || hex(payload::BLOB)
      ELSE hex((query_name || CASE WHEN packet_seq % 3 = 0 THEN '|note' ELSE '' END)::BLOB) END AS payload
      FROM sized WHERE protocol = 'dns'"""),
    "dns_export_packets": on(EXPORTED, """SELECT source_file, packet_seq, ts_us,
      CASE WHEN six THEN 'fd00::' || src_ip ELSE src_ip END AS src_ip,
      CASE WHEN six THEN 'fd00::' || dst_ip ELSE dst_ip END AS dst_ip, src_port, dst_port, query_name, query_length,
      coalesce(qtype, 'TYPE65') AS qtype, CASE WHEN packet_seq % 2 = 1 THEN 2 END::INTEGER AS answer_count,
      CASE WHEN packet_seq % 7 = 0 THEN hex((query_name || '|note')::BLOB) ELSE hex(payload::BLOB) END AS payload,
      packet_size FROM exported WHERE protocol = 'dns' AND NOT lost"""),
    "icmp_export_packets": on(EXPORTED, """SELECT source_file, packet_seq, ts_us, src_ip, dst_ip,
      CASE WHEN packet_seq % 3 = 0 THEN 8 ELSE 0 END::INTEGER AS icmp_type, 0::INTEGER AS icmp_code,
      hex(payload::BLOB) AS payload, payload_length, packet_size, 64::INTEGER AS ttl
      FROM exported WHERE protocol = 'icmp' AND NOT lost"""),
    "malformed_exports": on(EXPORTED, """SELECT source_file, packet_seq,
      CASE WHEN protocol = 'dns' THEN 'no supported IP/transport layer' ELSE 'no IPv4 layer' END AS error
      FROM exported WHERE lost"""),
    "raw_frame_packets": on(PACKETS, """SELECT source_file, packet_seq, ts_us, protocol, src_ip, dst_ip, src_port, dst_port,
      query_name, coalesce(query_length, NULL)::INTEGER AS query_length,
      CASE WHEN protocol = 'dns' THEN coalesce(qtype, 'TYPE65') END AS qtype,
      CASE WHEN protocol = 'dns' AND packet_seq % 2 = 1 THEN 2 END::INTEGER AS answer_count,
      CASE WHEN protocol = 'icmp' THEN CASE WHEN packet_seq % 2 = 1 THEN 0 ELSE 8 END END::INTEGER AS icmp_type,
      CASE WHEN protocol = 'icmp' THEN payload_length END AS payload_length, packet_size, 64::INTEGER AS ttl FROM sized"""),
    "capture_files": on(PACKETS, CAPTURE_FILES + """
      SELECT source_file, protocol, condition, packets, error, CASE WHEN error IS NULL THEN packets ELSE 0 END AS read,
        CASE WHEN error IS NULL THEN first_us END AS first_us, CASE WHEN error IS NULL THEN last_us END AS last_us FROM files"""),
    "refused_captures": on(PACKETS, CAPTURE_FILES + """
      SELECT source_file, packets AS packet_seq, error FROM files WHERE covert AND error IS NOT NULL AND protocol IS NOT NULL"""),
    "incremental_dataset": on(PACKETS, CAPTURE_FILES + """
      SELECT stem || 'Z.pcap' AS filename, CASE WHEN slot % 2 = 1 THEN 'new' WHEN slot = 0
          AND count(*) FILTER ((packet_seq // 10) % 2 = 0) > 0 THEN 'changed' ELSE 'kept' END AS change,
        CASE WHEN slot = 0 AND count(*) FILTER ((packet_seq // 10) % 2 = 0) > 0
          THEN count(*) FILTER ((packet_seq // 10) % 2 = 0) ELSE count(*) END AS packets
      FROM dealt WHERE damage > 2 GROUP BY stem, slot"""),
    "conversation_keys": on(FLOWS, """SELECT packet_seq, source_file, protocol, ip_a, port_a, ip_b, port_b FROM conversations"""),
    "flow_assignment": on(FLOWS, "SELECT source_file, packet_seq, flow_number::BIGINT AS flow_id FROM flows"),
    "flow_windows": on(FEATURES, "SELECT source_file, flow_id, packet_count, start_us, end_us FROM features"),
    "window_gaps": on(FLOWS, "SELECT source_file, packet_seq, gap_us FROM placed"),
    "payload_entropy": on(PACKETS, "SELECT packet_seq, " + rounded("entropy", 6) + " FROM sized"),
    "document_entropy": "SELECT doc_id, " + rounded("entropy", 6, source="""abs(list_aggregate(
      regexp_extract_all(hex(encode(text)), '..'), 'entropy'))""") + " FROM documents",
    "tunnel_record_types": on(PACKETS, """SELECT packet_seq, CASE WHEN qtype IS NOT NULL
      THEN (qtype IN ('TXT', 'NULL'))::INTEGER END AS is_tunnel_type FROM sized"""),
    "size_statistics": feature_select(SIZE),
    "timing_statistics": feature_select(TIMING),
    "window_counts": feature_select(["packet_count", "is_single_packet_flow", "duration_seconds"]),
    "entropy_statistics": feature_select(ENTROPY),
    "dns_query_statistics": feature_select(DNS),
    "icmp_size_variation": feature_select(["icmp_size_cv"]),
    "flow_features": feature_select(["packet_count", "is_single_packet_flow", *NUMERIC[1:]]),
    "labelled_dataset": on(DATASET, "SELECT source_file, flow_id, protocol, label, packet_count, "
                           + rounded_list(["size_mean", "entropy_mean"]) + " FROM features"),
    "dataset_counts": on(DATASET, 'SELECT protocol, label, count(*) AS "count" FROM features GROUP BY protocol, label'),
    "dataset_failures": on(PACKETS, """SELECT DISTINCT source_file, CASE slot WHEN 3 THEN 'unknown protocol tcp'
      ELSE 'unknown condition unclear' END AS error FROM sized WHERE slot IN (3, 4)"""),
    **{
        f"{p or 'combined'}_matrix": on(matrix(names, p), f"SELECT {KEY}, label, " + ", ".join(
            rounded(n, digits_of(n)) for n in names) + " FROM matrix")
        for p, names in (("dns", DNS_INPUTS), ("icmp", ICMP_INPUTS), (None, ALL_INPUTS))
    },
    "matrix_scaler": on(matrix(DNS_INPUTS, "dns"), scaler_sql([n for n in DNS_INPUTS if n not in SECONDS])),
    "standardized_matrix": on(matrix(ICMP_INPUTS, "icmp"), f"SELECT {KEY}, label, " + ", ".join(
        rounded(n, 5, source=f"({n} - avg({n}) OVER ()) / nullif(stddev_pop({n}) OVER (), 0)")
        for n in ("size_mean", "entropy_mean", "icmp_size_cv", "packet_count")) + " FROM matrix"),
    "loso_folds": on(folds_of(matrix(DNS_INPUTS, "dns")), """SELECT fold, CASE WHEN source_file = fold
      THEN 'test' ELSE 'train' END AS part, count(*) AS "rows" FROM folds CROSS JOIN matrix GROUP BY ALL"""),
    "fold_census": on(folds_of(matrix(DNS_INPUTS, "dns")) + ",\n" + CENSUS, """SELECT fold, fold_type,
      training_had_no_legit_examples, train_legit, train_covert, test_legit, test_covert FROM census_typed"""),
    "fold_scalers": on(folds_of(matrix(ICMP_INPUTS, "icmp")),
                       fold_scaler_sql([n for n in ICMP_INPUTS if n not in SECONDS])),
    "split_sizes": on(matrix(DNS_INPUTS, "dns"), """SELECT label, part, "rows" FROM (
      WITH n AS (SELECT label, count(*) AS c FROM matrix GROUP BY label),
      t AS (SELECT *, ceil(0.3 * sum(c) OVER ()) AS total, c * ceil(0.3 * sum(c) OVER ()) / sum(c) OVER () AS exact FROM n),
      q AS (SELECT *, floor(exact) AS low, row_number() OVER (ORDER BY floor(exact) - exact, label) AS nth,
        total - sum(floor(exact)) OVER () AS spare FROM t),
      r AS (SELECT label, c, (low + CASE WHEN nth <= spare THEN 1 ELSE 0 END)::BIGINT AS test FROM q)
      SELECT label, 'test' AS part, test AS "rows" FROM r UNION ALL SELECT label, 'train', (c - test)::BIGINT FROM r)"""),
    "training_thresholds": on(FEATURES, "SELECT protocol, " + rounded(
        "threshold", 6, source="quantile_cont(size_mean, 0.9)") + " FROM features GROUP BY protocol"),
    "ranking_metrics": on(RANKED, "SELECT t.protocol, " + rounded(
        "roc_auc", 6, source="(rank_sum - p * (p + 1) / 2.0) / (p::DOUBLE * n)") + ", " + rounded("avg_precision", 6)
        + " FROM totals t JOIN ap ON t.protocol = ap.protocol"),
    "confusion_at_training_threshold": on(LIMITED, RATES),
    "confusion_at_fixed_threshold": on(FEATURES + """,
      cells AS (SELECT protocol, 150.0 AS threshold, count(*) FILTER (size_mean >= 150 AND label = 1) AS tp,
        count(*) FILTER (size_mean >= 150 AND label = 0) AS fp, count(*) FILTER (size_mean < 150 AND label = 0) AS tn,
        count(*) FILTER (size_mean < 150 AND label = 1) AS fn FROM features GROUP BY protocol)""", RATES),
    "loso_single_feature": on(LOSO, "SELECT protocol, fold, fold_type, train_legit, train_covert, test_legit, test_covert, "
        + ", ".join(rounded(n, 6) for n in ("threshold", "precision", "recall", "f1", "fpr")) + ", tp, fp, tn, fn FROM loso"),
    "fpr_summary": on(LOSO, "SELECT 'size_mean' AS model_name, " + rounded("mean", 6, source="avg(fpr)") + ", "
        + rounded("std", 6, source="stddev_samp(fpr)") + ', count(fpr) AS "count" FROM loso WHERE fold_type = \'legit-holdout\''),
    "recall_summary": on(LOSO, "SELECT 'size_mean' AS model_name, " + rounded("mean", 6, source="avg(recall)") + ", "
        + rounded("std", 6, source="stddev_samp(recall)") + ', count(recall) AS "count" FROM loso WHERE fold_type = \'covert-holdout\''),
    "latest_run": on(LOSO, "SELECT '2026-02-01T00:00:00+00:00' AS run_timestamp, fold, tp, fp, tn, fn FROM loso"),
    "run_history": on(LOSO, "SELECT '2026-02-01T00:00:00+00:00' AS run_timestamp, fold, tp, fp, tn, fn, 3::BIGINT AS runs, "
        "3 * (SELECT count(*) FROM loso)::BIGINT AS rows, "
        + rounded("mean_fpr", 6, source="(SELECT avg(fpr) FROM loso WHERE fold_type = 'legit-holdout')") + " FROM loso"),
    "summary_pivot": on(LOSO, "SELECT 'Isolation Forest' AS model_name, "
        + rounded("mean_fpr", 6, source="avg(fpr)") + ", " + rounded("mean_recall", 6, source="avg(recall)")
        + ", count(fpr) AS count_fpr, count(recall) AS count_recall FROM loso"),
    "flagged_by_either": on(FEATURES, f"""SELECT {KEY}, size_mean >= (SELECT quantile_cont(size_mean, 0.9) FROM features)
      OR entropy_mean >= (SELECT quantile_cont(entropy_mean, 0.9) FROM features) AS flagged_by_either FROM features"""),
    "score_summary": on(FEATURES + """, f AS (SELECT packet_count,
      size_mean >= (SELECT quantile_cont(size_mean, 0.9) FROM features)
      OR entropy_mean >= (SELECT quantile_cont(entropy_mean, 0.9) FROM features) AS flagged FROM features)""",
      "SELECT count(*) AS flow_windows, count(*) FILTER (flagged) AS flagged, sum(packet_count)::BIGINT AS packets_analyzed FROM f"),
    "class_sizes": on(FEATURES, """SELECT g.protocol, g.label, count(f.flow_id) AS "count",
      """ + rounded("percentage", 6, source="100.0 * count(f.flow_id) / (SELECT count(*) FROM features)") + """
      FROM (SELECT * FROM (VALUES ('dns'), ('icmp')) p(protocol), (VALUES (0), (1)) l(label)) g
      LEFT JOIN features f ON f.protocol = g.protocol AND f.label = g.label GROUP BY g.protocol, g.label"""),
    "short_groups": on(FEATURES, """SELECT protocol, label, count(*) AS "count" FROM features
      GROUP BY protocol, label HAVING count(*) < 900"""),
    "missing_values": on(FEATURES, " UNION ALL ".join(
        f"SELECT '{n}' AS column_name, count(*) FILTER ({n} IS NULL) AS nan_count, "
        + rounded("nan_percentage", 6, source=f"100.0 * count(*) FILTER ({n} IS NULL) / count(*)") + " FROM features"
        for n in ["flow_id", "protocol", *AUDITED, "label", "source_file"])),
    "dropna_loss": on(FEATURES, """SELECT count(*) FILTER (mean_query_length IS NULL OR icmp_size_cv IS NULL) AS dropped,
      count(*) AS total, round(100.0 * count(*) FILTER (mean_query_length IS NULL OR icmp_size_cv IS NULL) / count(*), 6)
      AS dropped_percentage FROM features"""),
    "class_balance": on(FEATURES, """SELECT coalesce(protocol, 'overall') AS name, count(*) FILTER (label = 0) AS legit,
      count(*) FILTER (label = 1) AS covert,
      printf('%.2f', count(*) FILTER (label = 0) / count(*) FILTER (label = 1)) || ':1' AS ratio
      FROM features GROUP BY ROLLUP (protocol)"""),
    "correlation_matrix": on(NUMBERS, 'SELECT "left", "right", ' + rounded("correlation", 6, source="value")
                             + " FROM (" + pair_sql() + ")"),
    "near_duplicate_features": on(NUMBERS, 'SELECT "left", "right", ' + rounded("correlation", 6, source="value") + " FROM ("
        + pair_sql() + f""") WHERE abs(value) > 0.95 AND list_position({AUDITED!r}, "left") < list_position({AUDITED!r}, "right")"""),
    "supervised_recommendation": on(FEATURES, """SELECT CASE WHEN count(*) FILTER (c < 30) = 0
      THEN 'SUFFICIENT FOR SUPERVISED COMPARISON' ELSE 'UNSUPERVISED-ONLY RECOMMENDED' END AS recommendation,
      coalesce(string_agg(CASE WHEN c < 30 THEN protocol || '/label=' || label || ': ' || c END, ', '
        ORDER BY protocol, label), '') AS below_minimum
      FROM (SELECT protocol, label, count(*) AS c FROM features GROUP BY protocol, label)"""),
    "describe_by_label": on(NUMBERS, 'SELECT protocol, label, feature, count(value) AS "count", ' + ", ".join([
        rounded("mean", 4, source="avg(value)"), rounded("std", 4, source="stddev_samp(value)"),
        rounded("min", 4, source="min(value)"), rounded("q25", 4, source="quantile_cont(value, 0.25)"),
        rounded("q50", 4, source="quantile_cont(value, 0.5)"), rounded("q75", 4, source="quantile_cont(value, 0.75)"),
        rounded("max", 4, source="max(value)")]) + f" FROM ({INSPECTED_LONG}) GROUP BY protocol, label, feature"),
    "direction_check": on(NUMBERS, "SELECT protocol, feature, " + ", ".join([
        rounded("legit_mean", 4, source="avg(value) FILTER (label = 0)"),
        rounded("covert_mean", 4, source="avg(value) FILTER (label = 1)")]) + f""",
      CASE WHEN avg(value) FILTER (label = 1) > avg(value) FILTER (label = 0) THEN '↑'
        WHEN avg(value) FILTER (label = 1) < avg(value) FILTER (label = 0) THEN '↓' ELSE '→' END AS direction,
      feature IN ('size_cv', 'icmp_size_cv') AS two_sided,
      CASE WHEN feature NOT IN ('size_cv', 'icmp_size_cv')
        THEN avg(value) FILTER (label = 1) > avg(value) FILTER (label = 0) END AS passes
      FROM ({INSPECTED_LONG}) GROUP BY protocol, feature"""),
    "baseline_sessions": on(NUMBERS, " UNION ALL ".join(
        f"SELECT '{n}' AS feature, source_file, " + rounded("mean", 3, source=f"avg({n})") + ", "
        + rounded("std", 3, source=f"stddev_samp({n})")
        + " FROM numbers WHERE protocol = 'dns' AND label = 0 GROUP BY source_file" for n in COMPARED)),
    "session_totals": on(FEATURES, """SELECT f.*, raw_packet_count, """ + rounded("raw_duration_seconds", 4) + ", "
        + rounded("raw_packets_per_second", 9, source="raw_packet_count / raw_duration_seconds") + """
      FROM (SELECT source_file, count(*) AS flow_count, sum(packet_count)::BIGINT AS feature_packet_count_sum
        FROM features WHERE protocol = 'dns' AND label = 0 GROUP BY source_file) f
      JOIN (SELECT source_file, count(*) AS raw_packet_count, (max(ts_us) - min(ts_us)) / 1e6 AS raw_duration_seconds
        FROM sized GROUP BY source_file) r ON f.source_file = r.source_file"""),
}

# Windows the watermark, one hour behind the last packet, makes final: all of closed flows, and
# of open long flows those that later packets cannot change.
STREAMED = FEATURES + """,
mark AS (SELECT max(ts_us) // 1000 * 1000 - 3600000000 AS us FROM sized),
starts AS (
  SELECT DISTINCT source_file, flow_id, flow_number, flow_start, flow_end, is_long, win FROM placed
),
settled AS (
  SELECT source_file, flow_number, win0, count(*) AS c, max(ts_us) AS last_us, any_value(flow_start) AS flow_start
  FROM ranked, mark WHERE flow_end + 27000000000 >= mark.us AND ts_us < mark.us
  GROUP BY source_file, flow_number, win0
),
open_flows AS (
  SELECT source_file, flow_number, max(win0) - CASE WHEN max_by(c, win0) > 1 THEN 1 ELSE 2 END AS final_win
  FROM settled GROUP BY source_file, flow_number HAVING max(last_us) - any_value(flow_start) >= 54000000000
)"""
SQL["stream_flow_windows"] = on(STREAMED,
    "SELECT f.source_file, s.flow_start || CASE WHEN is_long THEN '_w' || win ELSE '' END AS flow_id, packet_count, "
    + rounded_list(["duration_seconds", "size_mean", "size_std", "interarrival_mean", "entropy_mean"])
    + """ FROM features f JOIN starts s ON f.source_file = s.source_file AND f.flow_id = s.flow_id
      LEFT JOIN open_flows o ON o.source_file = s.source_file AND o.flow_number = s.flow_number, mark
      WHERE s.flow_end + 27000000000 < mark.us OR s.win <= o.final_win""")

SQL["final_models"] = on(FEATURES, """SELECT protocol, 200::INTEGER AS trees, CASE protocol WHEN 'dns' THEN 15 ELSE 14 END::INTEGER AS inputs,
  count(*) AS trained_on, count(*) AS rows, sum(packet_count)::BIGINT AS packets, true AS forest_at_tenth,
  true AS autoencoder_at_tenth, true AS flags FROM features GROUP BY protocol""")

# Only DNS packets reach the stream that scores them, so they alone move its watermark.
STREAM_THRESHOLD = 20.0
SQL["stream_scores"] = on(STREAMED.replace("FROM sized)", "FROM sized WHERE protocol = 'dns')"),
    f"""SELECT f.source_file, s.flow_start || CASE WHEN is_long THEN '_w' || win ELSE '' END AS flow_id, packet_count,
      0.0::DOUBLE AS isolation_forest_score, """ + rounded(
        "autoencoder_reconstruction_error", 6, source="(packet_count ** 2 + (size_mean / 100) ** 2 + entropy_mean ** 2) / 3") + f""",
      (packet_count ** 2 + (size_mean / 100) ** 2 + entropy_mean ** 2) / 3 >= {STREAM_THRESHOLD} AS flagged_by_either,
      true AS is_unique
      FROM features f JOIN starts s ON f.source_file = s.source_file AND f.flow_id = s.flow_id
      LEFT JOIN open_flows o ON o.source_file = s.source_file AND o.flow_number = s.flow_number, mark
      WHERE f.protocol = 'dns' AND (s.flow_end + 27000000000 < mark.us OR s.win <= o.final_win)""")
