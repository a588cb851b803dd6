"""Stored tables: feature dataset, evaluation runs, JSON records."""

from pyspark.sql import DataFrame, SparkSession, functions as F

from undertone.schema import DATASET_COLUMNS, DATASET_SCHEMA, RESULT_SCHEMA


def in_dataset_order(features: DataFrame) -> DataFrame:
    """The 21 dataset columns in their fixed order and types; absent ones become null."""
    nothing = F.lit(None)
    return features.select(*[
        (F.col(f.name) if f.name in features.columns else nothing).cast(f.dataType).alias(f.name)
        for f in DATASET_SCHEMA
    ])


def write_features(features: DataFrame, path):
    """Parquet, one directory per protocol, so that per-protocol training reads only its half."""
    in_dataset_order(features).write.mode("overwrite").partitionBy("protocol").parquet(path)


def read_features(spark: SparkSession, path) -> DataFrame:
    return spark.read.schema(DATASET_SCHEMA).parquet(path).select(*DATASET_COLUMNS)


def append_results(results: DataFrame, path):
    """Add a run to the result history. Earlier runs stay as they are."""
    results.write.mode("append").parquet(path)


def read_results(spark: SparkSession, path, schema=RESULT_SCHEMA) -> DataFrame:
    """The result history; columns an older run lacks are null."""
    return spark.read.schema(schema).parquet(path)


def to_json_records(df: DataFrame) -> DataFrame:
    """One JSON object per row; missing and non-finite numbers become null, digits are kept."""
    clean = [
        F.when(~F.isnan(f.name) & (F.abs(f.name) != float("inf")), F.col(f.name)).alias(f.name)
        if f.dataType.typeName() in ("double", "float") else F.col(f.name)
        for f in df.schema
    ]
    return df.select(F.to_json(F.struct(*clean), {"ignoreNullFields": "false"}).alias("record"))
