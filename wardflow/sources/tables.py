"""Readers for the input tables.

The columns this library reads are declared, so a read needs no schema
inference, reads only those columns, and fails early if a file disagrees
(e.g. an order date stored as a zoned timestamp, which would make the
season depend on the session time zone).
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

INPUT_SCHEMAS = {
    "orders": "o_orderkey bigint, o_custkey bigint, o_totalprice double, o_orderdate timestamp_ntz",
    "lineitem": "l_orderkey bigint",
    "conversations": "conv_id bigint, turn bigint, role string, text string",
}


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One parquet table of a data directory, e.g. ``orders``."""
    reader = spark.read
    if name in INPUT_SCHEMAS:
        reader = reader.schema(INPUT_SCHEMAS[name])
    return reader.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def file_states(spark: SparkSession, sf_dir: str, name: str) -> list[str]:
    """What tells one state of a table's files from another (names, sizes,
    times, in one row for any number of files), without reading them."""
    files = (spark.read.format("binaryFile").option("recursiveFileLookup", "true")
             .load(f"{sf_dir.rstrip('/')}/{name}.parquet"))
    each = F.xxhash64("path", "length", "modificationTime").cast("decimal(38,0)")
    return [str(x) for x in files.agg(F.count("path"), F.sum("length"), F.sum(each), F.max("modificationTime")).first()]
