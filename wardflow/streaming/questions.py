"""Questions arriving as a stream (Structured Streaming).

The application answers each typed question as it arrives. Here questions
land as files in a folder and are read with ``readStream``:

* ``prepared_stream``: H1-H3 per row, stateless, any output mode;
* ``intent_count_stream``: H5 as a stateful streaming aggregation whose
  state lives in the query's checkpoint (survives restarts);
* ``start_answering``: H4 per micro-batch through ``foreachBatch``. Given
  ``PatientCells``, every micro-batch is answered from the newest version, so
  patients that arrive while the query runs count in the next batch's answers,
  as the application reads its table at each question. Given a fixed patient
  table, its cells and preview rows are computed once for the life of the
  query. Each micro-batch overwrites its own ``epoch=<id>`` folder, so a batch
  that is retried after a failure replaces its output instead of duplicating it.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming import StreamingQuery

from wardflow.operators import inspect
from wardflow.operators import questions as Q
from wardflow.plans.answers import answer_questions, prepared_cells
from wardflow.session import checkpoint_dir, release, reliable_checkpoint
from wardflow.streaming.patients import PatientCells

QUESTION_SCHEMA = "question_id bigint, question string"


def question_stream(spark: SparkSession, path: str, schema: str = QUESTION_SCHEMA,
                    fmt: str = "parquet", max_files_per_trigger: int | None = None) -> DataFrame:
    """A streaming DataFrame of the question files arriving in ``path``."""
    reader = spark.readStream.schema(schema).format(fmt)
    if max_files_per_trigger:
        reader = reader.option("maxFilesPerTrigger", max_files_per_trigger)
    return reader.load(path)


def prepared_stream(stream: DataFrame, question: str = "question") -> DataFrame:
    """H1-H3 on a stream: intent, params and route per question."""
    return Q.prepare_questions(stream, question)


def intent_count_stream(stream: DataFrame, question: str = "question") -> DataFrame:
    """H5 on a stream: running question count per intent."""
    return Q.intent_counts(stream, question)


def _stream_checkpoint(spark: SparkSession, name: str) -> str:
    return f"{checkpoint_dir(spark).rstrip('/')}/streams/{name}"


def start_answering(stream: DataFrame, patients: DataFrame | PatientCells, sink_path: str,
                    name: str = "answers", checkpoint_location: str | None = None,
                    available_now: bool = False, processing_time: str | None = None,
                    question: str = "question") -> StreamingQuery:
    """H4 on a stream: answers of every micro-batch under
    ``sink_path/epoch=<batch id>`` (parquet), from the ``PatientCells`` as they
    are then, or from a fixed patient table."""
    spark = stream.sparkSession
    if isinstance(patients, PatientCells):
        current = patients.tables
    else:
        fixed = prepared_cells(patients), reliable_checkpoint(inspect.preview_rows(patients), "preview")
        current = lambda: fixed

    def answer_batch(batch: DataFrame, epoch_id: int) -> None:
        cells, preview = current()
        out = answer_questions(batch, None, question=question, cells=cells, preview=preview)
        out.write.mode("overwrite").parquet(f"{sink_path.rstrip('/')}/epoch={epoch_id}")
        release(out, only=("questions", "answers"))

    writer = (stream.writeStream.queryName(name).foreachBatch(answer_batch)
              .option("checkpointLocation", checkpoint_location or _stream_checkpoint(spark, name)))
    if available_now:
        writer = writer.trigger(availableNow=True)
    elif processing_time:
        writer = writer.trigger(processingTime=processing_time)
    return writer.start()
