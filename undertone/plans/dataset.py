"""The labelled feature dataset over many captures."""

from pyspark.sql import DataFrame, functions as F

from undertone.operators.features import build_flow_features
from undertone.schema import LABEL_VALUES, PROTOCOLS
from undertone.sources.tables import in_dataset_order


def manifest_problems(manifest: DataFrame) -> DataFrame:
    """(source_file, error) of manifest rows that cannot be processed."""
    protocol = F.coalesce(F.lower("protocol"), F.lit("null"))
    condition = F.coalesce(F.lower("condition"), F.lit("null"))
    error = F.when(~protocol.isin(*PROTOCOLS), F.concat(F.lit("unknown protocol "), protocol)).when(
        ~condition.isin(*LABEL_VALUES), F.concat(F.lit("unknown condition "), condition)
    )
    return manifest.select(F.col("filename").alias("source_file"), error.alias("error")).filter("error is not null")


def usable_captures(manifest: DataFrame) -> DataFrame:
    condition = F.lower("condition")
    label = F.when(condition == "legit", LABEL_VALUES["legit"]).when(condition == "covert", LABEL_VALUES["covert"])
    return manifest.filter(F.lower("protocol").isin(*PROTOCOLS) & label.isNotNull()).select(
        F.col("filename").alias("source_file"), F.lower("protocol").alias("protocol"), label.alias("label")
    )


def build_dataset(manifest: DataFrame, packets: DataFrame, **flow_parameters) -> tuple[DataFrame, DataFrame]:
    """(dataset, failures). All captures in one plan; a failed capture never stops the others.

    Packets are kept for captures of the manifest and only in the capture's own protocol. A
    stored manifest has a known size: small, it is broadcast and packets are not shuffled for it.
    """
    usable = usable_captures(manifest)
    mine = packets.join(
        usable.select("source_file", F.col("protocol").alias("_protocol")), "source_file"
    ).filter(F.lower("protocol") == F.col("_protocol")).drop("_protocol")
    features = build_flow_features(mine, **flow_parameters)
    labelled = features.join(usable.select("source_file", "label"), "source_file")
    return in_dataset_order(labelled), manifest_problems(manifest)


def empty_captures(manifest: DataFrame, packets: DataFrame) -> DataFrame:
    """Usable captures without a single packet of their protocol."""
    have = packets.select("source_file", F.lower("protocol").alias("protocol")).distinct()
    return usable_captures(manifest).join(have, ["source_file", "protocol"], "left_anti").select("source_file")


def dataset_counts(dataset: DataFrame) -> DataFrame:
    return dataset.groupBy("protocol", "label").agg(F.count(F.lit(1)).alias("count"))
