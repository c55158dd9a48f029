"""Readers and writers: Parquet tables, unquoted TSV, packed list files, JSON dictionaries."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

RECORD_SCHEMA = T.StructType([T.StructField(c, T.StringType()) for c in ("entity_id", "business_name", "business_address", "country")])
TRUTH_SCHEMA = T.StructType([T.StructField(c, T.StringType()) for c in ("source1_entity_id", "matched_entity_ids")])


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    """One Parquet table of a data folder."""
    return spark.read.parquet(f"{folder}/{name}.parquet")


def read_tsv(spark: SparkSession, path: str, schema: T.StructType = RECORD_SCHEMA) -> DataFrame:
    """Tab-separated text with a header, never quoted, all columns strings, missing values as ''."""
    return spark.read.schema(schema).csv(path, sep="\t", header=True, quote="", escape="").fillna("")


def write_tsv(df: DataFrame, path: str, single_file: bool = False) -> None:
    """The inverse of :func:`read_tsv`. ``single_file`` is for small reports; large results stay in parts."""
    out = df.coalesce(1) if single_file else df
    out.write.mode("overwrite").csv(path, sep="\t", header=True, quote="", escape="", emptyValue="", nullValue="")


def write_grouped(df: DataFrame, path: str, key: str) -> None:
    """Parquet in which all rows of a key value share one file."""
    df.repartition(key).write.mode("overwrite").parquet(path)


def write_dictionary(df: DataFrame, path: str) -> None:
    """Two string columns as JSON lines."""
    df.write.mode("overwrite").json(path)


def read_dictionary(spark: SparkSession, path: str, key: str = "word", value: str = "canon") -> DataFrame:
    return spark.read.schema(f"{key} string, {value} string").json(path)


def truth_pairs(truth: DataFrame) -> DataFrame:
    """One row per listed id of a comma list; blanks dropped."""
    ids = F.explode(F.split("matched_entity_ids", ","))
    return truth.select(F.col("source1_entity_id").alias("s1"), F.trim(ids).alias("sx")).where("sx <> ''")
