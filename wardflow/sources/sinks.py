"""Ops A2, A3: persist the patient table."""

from __future__ import annotations

import re
import uuid

from pyspark.sql import DataFrame, SparkSession

from wardflow.session import delete_path, path_exists, require_shared, scratch_path

#: Properties of the catalog entry: the folders of the version it shows and of
#: the one before.
CURRENT, BEFORE = "wardflow.folder", "wardflow.folder.before"


def _quoted(name: str) -> str:
    return ".".join(f"`{part}`" for part in name.replace("`", "").split("."))


def _versions(spark: SparkSession, table_name: str) -> dict[str, str]:
    """The folders that the catalog entry names; none if it is not ours."""
    if not spark.catalog.tableExists(table_name):
        return {}
    rows = spark.sql(f"SHOW TBLPROPERTIES {_quoted(table_name)}").collect()
    return {r.key: r.value for r in rows if r.key in (CURRENT, BEFORE)}


def write_patient_table(df: DataFrame, table_name: str = "patient_data",
                        fmt: str = "parquet") -> DataFrame:
    """A2: overwrite a catalog table, replacing its schema; returns the
    table as read back.

    The rows are written to a new folder under the warehouse; only when they
    are complete does the name change to it, in one statement to the catalog.
    A reader sees the old rows or the new, and a write that fails or is killed
    leaves the old ones in place. The catalog entry is a view of the newest
    folder. The folder before it stays until the next write, for readers that
    have begun; older ones are deleted. ``df`` may read the table itself.

    A name that belongs to a table or view of someone else is an error, and so
    is anything else that goes wrong. ``fmt="delta"`` needs the Delta jars on
    the classpath and overwrites in Delta's own transaction.
    """
    spark = df.sparkSession
    require_shared(spark, "spark.sql.warehouse.dir")
    if fmt == "delta":
        df.write.format(fmt).mode("overwrite").option("overwriteSchema", "true").saveAsTable(table_name)
        return spark.table(table_name)
    known = _versions(spark, table_name)
    if not known and spark.catalog.tableExists(table_name):
        raise ValueError(f"{table_name} exists and was not written by this function")
    where = f"{spark.conf.get('spark.sql.warehouse.dir').rstrip('/')}/{re.sub(r'[^0-9A-Za-z_.]', '_', table_name)}.versions"
    folder = f"{where}/{uuid.uuid4().hex}"
    df.write.format(fmt).save(folder)
    rows = f"SELECT * FROM {fmt}.`{folder}`"
    if known:
        # Replacing a view drops it first, and a reader would miss it then.
        spark.sql(f"ALTER VIEW {_quoted(table_name)} AS {rows}")
        spark.sql(f"ALTER VIEW {_quoted(table_name)} SET TBLPROPERTIES "
                  f"('{CURRENT}' = '{folder}', '{BEFORE}' = '{known[CURRENT]}')")
    else:
        spark.sql(f"CREATE OR REPLACE VIEW {_quoted(table_name)} TBLPROPERTIES ('{CURRENT}' = '{folder}') AS {rows}")
    if known.get(BEFORE):
        delete_path(spark, known[BEFORE])
    return spark.table(table_name)


def output_exists(spark: SparkSession, output: str) -> bool:
    """Whether what a finished stage left is there: a folder that was written
    whole, or ``table:<name>`` with its folder."""
    if not output.startswith("table:"):
        return path_exists(spark, f"{output}/_SUCCESS")
    name = output.removeprefix("table:")
    known = _versions(spark, name)
    if known:
        return path_exists(spark, f"{known[CURRENT]}/_SUCCESS")
    return spark.catalog.tableExists(name)


def write_patient_parquet(df: DataFrame, path: str | None = None,
                          name: str = "patient_data") -> DataFrame:
    """A3: overwrite a parquet folder (by default a new one under the cluster's
    shared checkpoint folder) and return it as read back."""
    if path is None:
        path = scratch_path(df.sparkSession, name)
    df.write.mode("overwrite").parquet(path)
    return df.sparkSession.read.parquet(path)
