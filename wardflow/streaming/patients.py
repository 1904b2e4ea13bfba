"""Patients arriving as a stream: incrementally maintained answer cells.

The answers to questions (H4) read a small table of sums per specialty, age,
season and risk (``plans.answers.base_cells``), and the first ten patients. Both
can be kept up to date without the patients that are already in them: cells are
sums, so the cells of a batch are added to them by key, and the first ten of the
old ten and the batch are the new ten.

``PatientCells`` keeps these two tables as numbered versions in a shared folder:

    <folder>/v=<n>/cells, <folder>/v=<n>/preview, <folder>/v=<n>/ready

A version is valid once its ``ready`` table (one row: the stream's batch number)
is complete. Each version is written from the one before and one batch, to its
own folder, so a batch that is tried again after a failure writes the same
version again, and a batch that is already in the newest version is skipped. The
two newest versions stay, for answers under way; older ones are deleted.

Patients are added, as in the application's append-only loads; a patient that
arrives twice counts twice.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from wardflow import constants as K
from wardflow.operators import inspect
from wardflow.plans.answers import base_cells, merged_cells
from wardflow.session import checkpoint_dir, child_folders, delete_path, path_exists

#: Versions that stay: the newest, and the one that answers may still read.
KEEP_VERSIONS = 2


class PatientCells:
    """Answer cells and preview rows of all patients so far."""

    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.folder = spark, folder.rstrip("/")

    def _at(self, version: int, table: str) -> str:
        return f"{self.folder}/v={version:012d}/{table}"

    def versions(self) -> list[int]:
        """The valid versions, oldest first."""
        found = [int(n.removeprefix("v=")) for n in child_folders(self.spark, self.folder) if n.startswith("v=")]
        return [v for v in sorted(found) if path_exists(self.spark, self._at(v, "ready/_SUCCESS"))]

    def latest(self) -> int | None:
        versions = self.versions()
        return versions[-1] if versions else None

    def batch_of(self, version: int) -> int:
        """The number of the last batch that the version holds."""
        return self.spark.read.json(self._at(version, "ready"), "batch long").first().batch

    def tables(self, version: int | None = None) -> tuple[DataFrame, DataFrame]:
        """Cells and preview rows of a version (default: the newest)."""
        version = self.latest() if version is None else version
        if version is None:
            raise ValueError(f"{self.folder} holds no patients yet")
        return tuple(self.spark.read.parquet(self._at(version, t)) for t in ("cells", "preview"))

    def start_from(self, patients: DataFrame) -> None:
        """The first version, from a whole patient table (unless there is one)."""
        if self.latest() is None:
            self._write(0, -1, base_cells(patients), inspect.preview_rows(patients))

    def add(self, batch: DataFrame, number: int) -> None:
        """The next version: the newest one and a batch of patients."""
        newest = self.latest()
        if newest is None:
            return self._write(0, number, base_cells(batch), inspect.preview_rows(batch))
        if self.batch_of(newest) >= number:
            return None
        cells, preview = self.tables(newest)
        both = preview.unionByName(batch.select(*preview.columns))
        return self._write(newest + 1, number, merged_cells(cells, base_cells(batch)),
                           inspect.preview_rows(both, K.PREVIEW_ROWS))

    def _write(self, version: int, number: int, cells: DataFrame, preview: DataFrame) -> None:
        cells.write.mode("overwrite").parquet(self._at(version, "cells"))
        preview.write.mode("overwrite").parquet(self._at(version, "preview"))
        self.spark.range(1).select(F.lit(number).cast("long").alias("batch")).coalesce(1).write.mode(
            "overwrite").json(self._at(version, "ready"))
        for old in self.versions()[:-KEEP_VERSIONS]:
            delete_path(self.spark, f"{self.folder}/v={old:012d}")


def patient_stream(spark: SparkSession, path: str, schema, fmt: str = "parquet",
                   max_files_per_trigger: int | None = None) -> DataFrame:
    """A streaming DataFrame of the patient files arriving in ``path``, with
    the columns of the patient table."""
    reader = spark.readStream.schema(schema).format(fmt)
    if max_files_per_trigger:
        reader = reader.option("maxFilesPerTrigger", max_files_per_trigger)
    return reader.load(path)


def start_cells(stream: DataFrame, cells: PatientCells, name: str = "patient_cells",
                checkpoint_location: str | None = None, available_now: bool = False,
                processing_time: str | None = None) -> StreamingQuery:
    """Adds every micro-batch of patients to ``cells``."""
    where = checkpoint_location or f"{checkpoint_dir(stream.sparkSession).rstrip('/')}/streams/{name}"
    writer = (stream.writeStream.queryName(name).option("checkpointLocation", where)
              .foreachBatch(lambda batch, number: cells.add(batch, number)))
    if available_now:
        writer = writer.trigger(availableNow=True)
    elif processing_time:
        writer = writer.trigger(processingTime=processing_time)
    return writer.start()
