"""Explicit table schemas. Nothing in the package infers a type from data."""

from pyspark.sql import types as T

PROTOCOLS = ("dns", "icmp")

# Column names and order of the published tables.
MANIFEST_COLUMNS = [
    "filename", "protocol", "source", "condition", "timestamp", "file_size_bytes", "packet_count",
]
FLOW_FEATURE_COLUMNS = [
    "flow_id", "protocol", "packet_count", "duration_seconds",
    "size_mean", "size_std", "size_cv",
    "interarrival_mean", "interarrival_std", "interarrival_cv",
    "is_single_packet_flow", "entropy_mean", "entropy_max",
    "compression_ratio_mean", "compression_ratio_max",
    "mean_query_length", "txt_null_ratio", "max_query_length", "icmp_size_cv",
]
LABEL_VALUES = {"legit": 0, "covert": 1}
# End of fixed values.

DATASET_COLUMNS = [*FLOW_FEATURE_COLUMNS, "label", "source_file"]
METADATA_COLUMNS = ["label", "source_file", "flow_id", "protocol"]
DNS_ONLY = ["mean_query_length", "txt_null_ratio", "max_query_length"]
ICMP_ONLY = ["icmp_size_cv"]
TIMING = ["interarrival_mean", "interarrival_std", "interarrival_cv"]

MANIFEST_SCHEMA = T.StructType([
    T.StructField("filename", T.StringType()),
    T.StructField("protocol", T.StringType()),
    T.StructField("source", T.StringType()),
    T.StructField("condition", T.StringType()),
    T.StructField("timestamp", T.StringType()),
    T.StructField("file_size_bytes", T.LongType()),
    T.StructField("packet_count", T.LongType()),
])

# ``ts_us`` is whole microseconds since 1970; ``packet_seq`` is the position in the capture.
PACKET_SCHEMA = T.StructType([
    T.StructField("source_file", T.StringType()),
    T.StructField("packet_seq", T.LongType()),
    T.StructField("ts_us", T.LongType()),
    T.StructField("protocol", T.StringType()),
    T.StructField("src_ip", T.StringType()),
    T.StructField("dst_ip", T.StringType()),
    T.StructField("src_port", T.IntegerType()),
    T.StructField("dst_port", T.IntegerType()),
    T.StructField("packet_size", T.IntegerType()),
    T.StructField("payload_bytes", T.BinaryType()),
    T.StructField("query_name", T.StringType()),
    T.StructField("query_length", T.IntegerType()),
    T.StructField("qtype", T.StringType()),
    T.StructField("answer_count", T.IntegerType()),
    T.StructField("icmp_type", T.IntegerType()),
    T.StructField("icmp_code", T.IntegerType()),
    T.StructField("payload_length", T.IntegerType()),
    T.StructField("ttl", T.IntegerType()),
])

_FEATURE_TYPES = {
    "flow_id": T.StringType(), "protocol": T.StringType(), "packet_count": T.LongType(),
    "is_single_packet_flow": T.BooleanType(), "label": T.IntegerType(),
    "source_file": T.StringType(),
}
DATASET_SCHEMA = T.StructType([
    T.StructField(name, _FEATURE_TYPES.get(name, T.DoubleType())) for name in DATASET_COLUMNS
])

RESULT_SCHEMA = T.StructType([
    T.StructField("protocol", T.StringType()),
    T.StructField("run_timestamp", T.StringType()),
    T.StructField("fold", T.StringType()),
    T.StructField("fold_type", T.StringType()),
    T.StructField("training_had_no_legit_examples", T.BooleanType()),
    T.StructField("train_legit", T.LongType()),
    T.StructField("train_covert", T.LongType()),
    T.StructField("test_legit", T.LongType()),
    T.StructField("test_covert", T.LongType()),
    T.StructField("uses_training_labels", T.BooleanType()),
    T.StructField("scale_pos_weight", T.DoubleType()),
    T.StructField("model_name", T.StringType()),
    T.StructField("roc_auc", T.DoubleType()),
    T.StructField("avg_precision", T.DoubleType()),
    T.StructField("threshold", T.DoubleType()),
    T.StructField("threshold_source", T.StringType()),
    T.StructField("contamination", T.DoubleType()),
    T.StructField("precision", T.DoubleType()),
    T.StructField("recall", T.DoubleType()),
    T.StructField("f1", T.DoubleType()),
    T.StructField("tp", T.LongType()),
    T.StructField("fp", T.LongType()),
    T.StructField("tn", T.LongType()),
    T.StructField("fn", T.LongType()),
    T.StructField("fpr", T.DoubleType()),
])


def require_columns(df, columns, what="table"):
    """Refuse a table that lacks columns, naming them."""
    missing = sorted(set(columns) - set(df.columns))
    if missing:
        raise ValueError(f"{what} is missing columns: {', '.join(missing)}")
