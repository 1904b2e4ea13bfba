"""The question stream gives the same answers as the batch job."""

from __future__ import annotations

import tempfile

from pyspark.sql import functions as F

from fixtures import QUESTIONS
from wardflow.plans.answers import answer_questions
from wardflow.streaming import patients as P
from wardflow.streaming import questions as S


def test_stream_answers_equal_batch(spark, patients_small):
    src = tempfile.mkdtemp(prefix="wardflow-qsrc-")
    rows = [(i, q) for i, q, *_ in QUESTIONS]
    spark.createDataFrame(rows[:10], S.QUESTION_SCHEMA).coalesce(1).write.mode("append").parquet(src)
    spark.createDataFrame(rows[10:], S.QUESTION_SCHEMA).coalesce(1).write.mode("append").parquet(src)
    sink = tempfile.mkdtemp(prefix="wardflow-qsink-")
    q = S.start_answering(S.question_stream(spark, src, max_files_per_trigger=1), patients_small,
                          sink, name="answers_test", available_now=True)
    q.awaitTermination(300)
    got = spark.read.parquet(sink).drop("epoch")
    want = answer_questions(spark.createDataFrame(rows, S.QUESTION_SCHEMA), patients_small)
    assert got.count() == want.count()
    assert got.exceptAll(want.select(*got.columns)).count() == 0


def test_intent_count_stream(spark):
    src = tempfile.mkdtemp(prefix="wardflow-qsrc-")
    rows = [(i, q) for i, q, *_ in QUESTIONS]
    spark.createDataFrame(rows, S.QUESTION_SCHEMA).coalesce(1).write.mode("append").parquet(src)
    counts = S.intent_count_stream(S.prepared_stream(S.question_stream(spark, src)))
    q = (counts.writeStream.format("memory").queryName("intent_counts_test").outputMode("complete")
         .option("checkpointLocation", tempfile.mkdtemp(prefix="wardflow-sck-"))
         .trigger(availableNow=True).start())
    q.awaitTermination(300)
    got = {r.intent: r.question_count for r in spark.table("intent_counts_test").collect()}
    want: dict = {}
    for _i, _q, intent, _r in QUESTIONS:
        want[intent] = want.get(intent, 0) + 1
    assert got == want


def test_restart_processes_only_new_files(spark, patients_small):
    src = tempfile.mkdtemp(prefix="wardflow-qsrc-")
    sink = tempfile.mkdtemp(prefix="wardflow-qsink-")
    ckpt = tempfile.mkdtemp(prefix="wardflow-qck-")
    rows = [(i, q) for i, q, *_ in QUESTIONS]
    spark.createDataFrame(rows[:5], S.QUESTION_SCHEMA).coalesce(1).write.mode("append").parquet(src)

    def run():
        q = S.start_answering(S.question_stream(spark, src), patients_small, sink,
                              name="answers_restart", checkpoint_location=ckpt, available_now=True)
        q.awaitTermination(300)

    run()
    first = spark.read.parquet(sink).select("question_id").distinct().count()
    run()  # nothing new: the committed offsets are in the checkpoint
    assert spark.read.parquet(sink).count() == spark.read.parquet(sink).dropDuplicates().count()
    spark.createDataFrame(rows[5:], S.QUESTION_SCHEMA).coalesce(1).write.mode("append").parquet(src)
    run()
    ids = {r.question_id for r in spark.read.parquet(sink).select("question_id").distinct().collect()}
    assert first == 5 and ids == {i for i, _q in rows}
    per_epoch = spark.read.parquet(sink).groupBy("question_id").agg(
        F.countDistinct("epoch").alias("e"))
    assert per_epoch.filter("e > 1").count() == 0


def _answers(spark, sink):
    df = spark.read.parquet(sink)
    return sorted(map(tuple, df.select("question_id", "intent", "route", "group_key", "metric", "value",
                                       "text_value").collect()), key=str)


def _expected(spark, rows, patients):
    df = answer_questions(spark.createDataFrame(rows, S.QUESTION_SCHEMA), patients)
    return sorted(map(tuple, df.select("question_id", "intent", "route", "group_key", "metric", "value",
                                       "text_value").collect()), key=str)


def test_patients_that_arrive_between_questions_count(spark, patients_small):
    """Questions, a batch of patients, the same questions: two sets of answers."""
    asked, arriving = tempfile.mkdtemp(prefix="wardflow-qsrc-"), tempfile.mkdtemp(prefix="wardflow-psrc-")
    sink, state = tempfile.mkdtemp(prefix="wardflow-qsink-"), tempfile.mkdtemp(prefix="wardflow-cells-")
    ckpt = {n: tempfile.mkdtemp(prefix=f"wardflow-{n}-") for n in ("q", "p")}
    first = patients_small.filter("patient_id % 3 <> 0")
    later = patients_small.filter("patient_id % 3 = 0")
    cells = P.PatientCells(spark, state)
    cells.start_from(first)
    rows = [(i, q) for i, q, *_ in QUESTIONS]

    def ask(number):
        spark.createDataFrame([(i + 100 * number, q) for i, q in rows], S.QUESTION_SCHEMA).coalesce(1).write.mode(
            "append").parquet(asked)
        S.start_answering(S.question_stream(spark, asked), cells, sink, name=f"cells_q{number}",
                          checkpoint_location=ckpt["q"], available_now=True).awaitTermination(300)

    ask(0)
    later.coalesce(1).write.mode("append").parquet(arriving)
    P.start_cells(P.patient_stream(spark, arriving, patients_small.schema), cells, name="cells_p",
                  checkpoint_location=ckpt["p"], available_now=True).awaitTermination(300)
    ask(1)
    got = _answers(spark, sink)
    before = _expected(spark, rows, first)
    after = _expected(spark, [(i + 100, q) for i, q in rows], patients_small)
    assert before != [(r[0] - 100, *r[1:]) for r in after]
    rounded = lambda rs: [tuple(round(x, 6) if isinstance(x, float) else x for x in r) for r in rs]
    assert rounded(got) == rounded(sorted(before + after, key=str))


def test_cells_are_the_same_however_patients_arrive(spark, patients_small):
    from wardflow.plans.answers import base_cells
    cells = P.PatientCells(spark, tempfile.mkdtemp(prefix="wardflow-cells-"))
    parts = [patients_small.filter(F.col("patient_id") % 4 == i) for i in range(4)]
    for n in (0, 1, 1, 2, 2, 0, 3):      # some batches are tried again
        cells.add(parts[n], n)
    table, preview = cells.tables()
    key = ["kind", "specialty", "age", "season", "readmit_risk"]
    sums = [c for c in table.columns if c not in key]
    plain = lambda df: sorted(
        (tuple(map(str, r[:5])), tuple(round(float(x), 6) for x in r[5:])) for r in df.select(*key, *sums).collect())
    assert plain(table) == plain(base_cells(patients_small))
    assert [r.patient_id for r in preview.orderBy("patient_id").collect()] == list(range(1, 11))
    assert cells.versions() == [2, 3] and cells.batch_of(3) == 3


def test_an_unfinished_version_is_not_read(spark, patients_small):
    import os
    folder = tempfile.mkdtemp(prefix="wardflow-cells-")
    cells = P.PatientCells(spark, folder)
    cells.add(patients_small.limit(20), 0)
    cells.add(patients_small.limit(5), 1)
    os.remove(f"{folder}/v={1:012d}/ready/_SUCCESS")
    total = lambda: cells.tables()[0].filter("kind = 'sa'").agg(F.sum("n")).first()[0]
    assert cells.versions() == [0] and total() == 20
    cells.add(patients_small.limit(5), 1)
    assert cells.versions() == [0, 1] and total() == 25
