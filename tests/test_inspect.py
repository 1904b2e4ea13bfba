"""A2-A9 and the encoders."""

from __future__ import annotations

import hashlib

import pytest
from pyspark.sql import functions as F

from wardflow.functions import encoding
from wardflow.operators import inspect
from wardflow.sources import sinks


def test_sample_matches_sorted_hash(patients_small):
    ids = [r.patient_id for r in patients_small.select("patient_id").collect()]
    for n in (1, 37, 500, 1499, 1500, 5000):
        got = sorted(r.patient_id for r in inspect.sample_rows(patients_small, n=n).collect())
        want = sorted(sorted(ids, key=lambda i: (hashlib.md5(f"42:{i}".encode()).hexdigest(), i))[:n])
        assert got == want, n


def test_preview_and_count(patients_small):
    assert [r.patient_id for r in inspect.preview_rows(patients_small).collect()] == list(range(1, 11))
    assert inspect.row_count(patients_small).first().row_count == patients_small.count()


def test_profile(patients_small):
    rows = inspect.table_profile(patients_small).collect()
    assert [r.column_name for r in rows] == patients_small.columns
    assert all(r.non_null_count == r.row_count == 1500 for r in rows)


def test_validate(spark, patients_small):
    ok = inspect.validate_columns(patients_small).first()
    assert ok.is_valid and ok.status == "ok" and ok.missing_columns == []
    bad = inspect.validate_columns(patients_small.drop("los", "wait_days")).first()
    assert not bad.is_valid and bad.status == "missing" and bad.missing_columns == ["los", "wait_days"]
    empty = inspect.validate_columns(patients_small.limit(0)).first()
    assert not empty.is_valid and empty.status == "empty"


def test_adhoc_sql(spark, patients_small):
    out = inspect.adhoc_sql(spark, patients_small, "SELECT count(*) AS n FROM patients WHERE age > :a",
                            args={"a": 60}).first()
    assert out.n == patients_small.filter("age > 60").count()


def test_encode_decode_roundtrip(spark, patients_small):
    enc = encoding.one_hot_encode(patients_small)
    assert "specialty_General Surgery" in enc.columns and "specialty_Cardiology" not in enc.columns
    assert len(encoding.feature_columns()) == 15
    dec = encoding.one_hot_decode(enc)
    j = dec.select("patient_id", "gender", "specialty", "season").exceptAll(
        patients_small.select("patient_id", "gender", "specialty", "season"))
    assert j.count() == 0


def test_decode_defaults(spark):
    cols = ["gender_M"] + encoding.indicator_columns()["specialty"] + encoding.indicator_columns()["season"]
    zero = spark.createDataFrame([tuple([0] * len(cols))], ", ".join(f"`{c}` int" for c in cols))
    r = encoding.one_hot_decode(zero).first()
    assert (r.gender, r.specialty, r.season) == ("F", "Cardiology", "Autumn")


def test_write_read_back(spark, patients_small):
    t = sinks.write_patient_table(patients_small, "patient_data_test")
    assert t.count() == 1500
    p = sinks.write_patient_parquet(patients_small, name="patient_data_test")
    assert p.count() == 1500


def test_feature_fill(spark):
    df = spark.createDataFrame([(1, None, 3)], "patient_id bigint, age int, los int")
    assert encoding.feature_fill(df).first().age == 0


def test_validate_pages(patients_small):
    rows = {r.page: r for r in inspect.validate_pages(patients_small.drop("season")).collect()}
    assert rows["seasonal"].missing_columns == ["season"] and not rows["seasonal"].is_valid
    assert rows["core"].is_valid and rows["risk"].is_valid


def test_first_patients_equals_preview_of_table(spark, patients_small):
    from wardflow.sources.patients import first_patients
    for n in (1, 10, 37):
        got = [tuple(r) for r in first_patients(spark, "/root/testdata/sf0.001", n).collect()]
        want = [tuple(r) for r in inspect.preview_rows(patients_small, n).collect()]
        assert got == want
    plan = first_patients(spark, "/root/testdata/sf0.001", 10)._jdf.queryExecution().optimizedPlan().toString()
    assert "LeftSemi" in plan


def _folder(spark, name):
    return next(r.value for r in spark.sql(f"SHOW TBLPROPERTIES {name}").collect() if r.key == sinks.CURRENT)


def test_a_foreign_folder_is_left_alone(spark, patients_small):
    import os
    where = spark.conf.get("spark.sql.warehouse.dir").removeprefix("file:")
    folder = os.path.join(where, "foreign_table")
    os.makedirs(folder)
    with open(os.path.join(folder, "keep.txt"), "w") as f:
        f.write("mine")
    assert sinks.write_patient_table(patients_small, "foreign_table").count() == 1500
    assert os.listdir(folder) == ["keep.txt"]
    patients_small.limit(3).write.saveAsTable("table_of_another")
    with pytest.raises(ValueError, match="not written by this function"):
        sinks.write_patient_table(patients_small, "table_of_another")
    assert spark.table("table_of_another").count() == 3


def test_readers_see_the_old_table_or_the_new(spark, patients_small):
    """Reads go on while the table is overwritten again and again, with a
    schema that changes."""
    import threading
    name = "switched_table"
    sinks.write_patient_table(patients_small.limit(100).withColumn("v", F.lit(0)), name)
    seen, failed, stop = set(), [], threading.Event()

    def read():
        while not stop.is_set():
            try:
                df = spark.table(name)
                rows = df.collect()
                seen.add((len(rows), len(df.columns), frozenset(r.v for r in rows)))
            except Exception as e:  # noqa: BLE001 - any error is what must not happen
                failed.append(e)

    reader = threading.Thread(target=read)
    reader.start()
    written = {(100, 14, frozenset({0}))}
    for v in range(1, 6):
        df = patients_small.limit(100 + v).withColumn("v", F.lit(v))
        df = df.withColumn("w", F.lit(v)) if v % 2 else df
        sinks.write_patient_table(df, name)
        written.add((100 + v, 14 + v % 2, frozenset({v})))
    stop.set()
    reader.join()
    assert not failed and seen <= written
    assert spark.table(name).count() == 105


def test_the_catalog_entry_stays_while_it_is_switched(spark, patients_small):
    """It is altered: one that is dropped and made again begins at another time."""
    import time

    def begun():
        described = spark.sql("DESCRIBE TABLE EXTENDED entry_that_stays").collect()
        return next(r.data_type for r in described if r.col_name == "Created Time")

    sinks.write_patient_table(patients_small.limit(3), "entry_that_stays")
    first = begun()
    time.sleep(1.1)
    for n in (5, 7):
        again = sinks.write_patient_table(patients_small.limit(n).withColumn("v", F.lit(n)), "entry_that_stays")
        assert again.count() == n and again.columns[-1] == "v" and begun() == first
    known = sinks._versions(spark, "entry_that_stays")
    assert len(set(known.values())) == 2 and all(sinks.path_exists(spark, f) for f in known.values())


def test_a_reader_that_has_begun_goes_on(spark, patients_small):
    name = "begun_table"
    old = sinks.write_patient_table(patients_small.limit(10), name)
    new = sinks.write_patient_table(patients_small.limit(20), name)
    assert old.count() == 10 and new.count() == 20
    grown = sinks.write_patient_table(spark.table(name).unionByName(patients_small.limit(5)), name)
    assert grown.count() == 25


def test_a_failed_write_leaves_the_old_table(spark, patients_small):
    name = "failed_table"
    sinks.write_patient_table(patients_small.limit(10), name)
    before = _folder(spark, name)
    with pytest.raises(Exception, match="broken row"):
        sinks.write_patient_table(patients_small.withColumn("x", F.raise_error(F.lit("broken row")).cast("int")), name)
    assert _folder(spark, name) == before and spark.table(name).count() == 10


def test_only_two_versions_are_kept(spark, patients_small):
    import os
    name = "kept_table"
    for n in range(1, 5):
        sinks.write_patient_table(patients_small.limit(n), name)
    where = os.path.dirname(_folder(spark, name)).removeprefix("file:")
    assert len(os.listdir(where)) == 2


def test_release_deletes_the_copies_of_a_result(spark, patients_small):
    import os

    from wardflow.operators import queue
    from wardflow.session import release, scratch_root
    done = queue.capacity_scheduled(patients_small)
    assert done.count() == 1500
    folders = {f.removeprefix("file://").rsplit("/", 1)[0] for f in done.inputFiles() if scratch_root(spark)[-20:] in f}
    assert len(folders) == 1 and all(map(os.path.exists, folders))
    release(done)
    assert not any(map(os.path.exists, folders)) and patients_small.count() == 1500


def test_cluster_refuses_a_local_folder():
    from wardflow.session import _shared
    assert _shared("file:/tmp/x", "local[2]") == "file:/tmp/x" and _shared("hdfs://x/y", "yarn") == "hdfs://x/y"
    for folder in ("file:///tmp/x", "/tmp/x"):
        with pytest.raises(RuntimeError):
            _shared(folder, "spark://host:7077")
    # What counts is the file system that the folder belongs to.
    assert _shared("/user/me/x", "yarn", "hdfs://name:8020/user/me/x") == "/user/me/x"
    with pytest.raises(RuntimeError, match="sharedMount"):
        _shared("/mnt/x", "yarn", "file:/mnt/x")
    assert _shared("/mnt/x", "yarn", "file:/mnt/x", allow_file=True) == "/mnt/x"


def test_a_folder_is_judged_by_its_file_system(spark):
    from wardflow.session import SHARED_MOUNT, _checked
    with pytest.raises(RuntimeError, match="local to one machine"):
        _checked(spark, "/user/me/x", "yarn")
    spark.conf.set(SHARED_MOUNT, "true")
    try:
        assert _checked(spark, "/user/me/x", "yarn") == "/user/me/x"
    finally:
        spark.conf.unset(SHARED_MOUNT)
    # A default file system that is not this machine's.
    conf = spark._jsparkSession.sparkContext().hadoopConfiguration()
    before = conf.get("fs.defaultFS")
    conf.set("fs.defaultFS", "viewfs://store/")
    conf.set("fs.viewfs.mounttable.store.link./user", "file:///tmp")
    spark.conf.set("fs.defaultFS", "viewfs://store/")
    try:
        assert _checked(spark, "/user/me/x", "yarn") == "/user/me/x"
    finally:
        spark.conf.unset("fs.defaultFS")
        conf.set("fs.defaultFS", before)


@pytest.fixture()
def standalone(spark, monkeypatch, tmp_path):
    """The session says that it is a cluster's; its folders are a mount."""
    from wardflow import session
    sc, master, get = spark.sparkContext, "spark://host:7077", type(spark.conf).get
    monkeypatch.setattr(sc, "master", master)
    monkeypatch.setattr(type(spark.conf), "get", lambda self, key, *default: master if key == "spark.master"
                        else get(self, key, *default))
    before = sc.getCheckpointDir()
    sc.setCheckpointDir(str(tmp_path / "shared"))
    monkeypatch.setattr(session, "_MET", set())
    yield spark
    sc.setCheckpointDir(before)


def test_a_mount_that_all_machines_see_is_accepted(standalone, patients_small, tmp_path):
    import os

    from wardflow.operators import queue
    from wardflow.session import checkpoint_dir
    assert queue.queue_position(patients_small).agg(F.max("queue_position")).first()[0] == 1500
    assert sinks.write_patient_parquet(patients_small).count() == 1500
    assert sinks.write_patient_table(patients_small, "mounted_table").count() == 1500
    # Nothing of the trial stays.
    assert not [x for x in os.listdir(checkpoint_dir(standalone).removeprefix("file:")) if "trial" in x]


def test_a_folder_in_which_the_machines_do_not_meet_is_refused(standalone, monkeypatch, tmp_path):
    from pyspark.sql.readwriter import DataFrameWriter

    from wardflow.session import _accepted
    with pytest.raises(RuntimeError, match="local to one machine"):
        _accepted(standalone, "/proc/none", "spark://host:7077")
    # Tasks wrote to disks of their own: the driver finds some of the rows.
    parquet = DataFrameWriter.parquet
    monkeypatch.setattr(DataFrameWriter, "parquet",
                        lambda self, path: parquet(self._df.filter("id > 0").write, path))
    with pytest.raises(RuntimeError, match="local to one machine"):
        _accepted(standalone, str(tmp_path), "spark://host:7077")
    monkeypatch.undo()
    assert _accepted(standalone, str(tmp_path), "spark://host:7077") == str(tmp_path)


def _without_checkpoint_folder(spark, monkeypatch) -> list[str]:
    """As if none were set; returns those that are."""
    sc, place, get = spark.sparkContext, [], type(spark.conf).get
    monkeypatch.setattr(type(spark.conf), "get", lambda self, key, *default: default[0] if key == "spark.checkpoint.dir"
                        else get(self, key, *default))
    monkeypatch.setattr(sc, "getConf", dict)
    monkeypatch.setattr(sc, "getCheckpointDir", lambda: place[-1] if place else None)
    monkeypatch.setattr(sc, "setCheckpointDir", place.append)
    return place


def test_a_cluster_without_a_checkpoint_folder_uses_its_warehouse(standalone, patients_small, monkeypatch):
    from wardflow import session
    from wardflow.operators import queue
    place = _without_checkpoint_folder(standalone, monkeypatch)
    with pytest.warns(UserWarning, match="checkpoint.dir is not set"):
        folder = session.checkpoint_dir(standalone)
    assert folder == standalone.conf.get("spark.sql.warehouse.dir").rstrip("/") + "/wardflow.checkpoints"
    assert queue.queue_position(patients_small).agg(F.max("queue_position")).first()[0] == 1500
    assert sinks.write_patient_parquet(patients_small).count() == 1500
    # One that the machines do not share has the same place taken.
    place[:] = ["file:/proc/none"]
    with pytest.warns(UserWarning, match="local to one machine"):
        assert session.checkpoint_dir(standalone) == folder
    # Nowhere to meet: an error that says why.
    place.clear()
    monkeypatch.setattr(session, "_trial", lambda spark, folder: "no rows were found")
    with pytest.raises(RuntimeError, match="checkpoint.dir is not set.*warehouse.*no rows were found"):
        session.checkpoint_dir(standalone)


def test_a_local_cluster_without_a_checkpoint_folder_uses_its_warehouse(spark, monkeypatch):
    from wardflow import session
    _without_checkpoint_folder(spark, monkeypatch)
    monkeypatch.setattr(spark.sparkContext, "master", "local-cluster[3,2,3000]")
    with pytest.warns(UserWarning, match="checkpoint.dir is not set"):
        assert session.checkpoint_dir(spark).endswith("/wardflow.checkpoints")


def test_a_checkpoint_folder_that_executors_do_not_share_is_not_used(spark, monkeypatch):
    from wardflow import session
    place = _without_checkpoint_folder(spark, monkeypatch)
    monkeypatch.setattr(spark.sparkContext, "master", "local-cluster[3,2,3000]")
    trial = session._trial
    monkeypatch.setattr(session, "_trial", lambda spark, folder: (
        "of 4 rows that tasks wrote there, 0 were found" if folder.startswith("file:/proc/self") else trial(spark, folder)))
    place.append("file:/proc/self/cwd/x")
    with pytest.warns(UserWarning, match="not shared by the executors .of 4 rows"):
        assert session.checkpoint_dir(spark).endswith("/wardflow.checkpoints")


def test_sample_plan_meets_one_partition_only_over_bucket_counts(patients_small):
    lines = inspect.sample_rows(patients_small, n=100)._jdf.queryExecution() \
        .executedPlan().toString().splitlines()
    singles = [i for i, line in enumerate(lines) if "Exchange SinglePartition" in line]
    assert singles
    for i in singles:
        assert "HashAggregate" in lines[i + 1] and "_wf_b" in lines[i + 1], lines[i + 1]


def test_adhoc_sql_leaves_the_callers_view(spark, patients_small):
    spark.range(3).createOrReplaceTempView("patients")
    try:
        before = {t.name for t in spark.catalog.listTables()}
        got = inspect.adhoc_sql(spark, patients_small, "SELECT count(*) AS n FROM patients")
        assert got.first().n == 1500 and spark.table("patients").count() == 3
        assert {t.name for t in spark.catalog.listTables()} == before
        two = inspect.adhoc_sql(spark, patients_small.limit(7), "SELECT * FROM patients")
        assert two.count() == 7 and got.first().n == 1500
    finally:
        spark.catalog.dropTempView("patients")


def test_adhoc_sql_forms(spark, patients_small):
    run = lambda q, **k: inspect.adhoc_sql(spark, patients_small, q, **k)
    ordered = [r.patient_id for r in run("SELECT patient_id FROM patients ORDER BY patient_id DESC LIMIT 3;").collect()]
    assert ordered == [1500, 1499, 1498]
    assert run("WITH a AS (SELECT age FROM patients) SELECT max(age) AS m FROM a -- the oldest").first().m <= 120
    assert run("SELECT count(*) AS n FROM patients WHERE age > :a", args={"a": 200}).first().n == 0
    assert run("SELECT regexp_extract('aab', 'a{2}', 0) AS x FROM patients LIMIT 1").first().x == "aa"
    assert run("SELECT 1 AS n FROM patients p WHERE EXISTS (SELECT 1 FROM patients q WHERE q.age > p.age)").count() > 0
    assert run("SELECT count(*) AS n FROM p", view="p").first().n == 1500


@pytest.mark.parametrize("text", [
    "DROP TABLE adhoc_kept", "DROP VIEW adhoc_kept", "INSERT INTO adhoc_kept VALUES (1)", "TRUNCATE TABLE adhoc_kept",
    "CREATE TABLE adhoc_new AS SELECT 1", "SELECT 1; DROP TABLE adhoc_kept", "SET spark.sql.shuffle.partitions=3",
    "CACHE TABLE patients", "SELECT 1) INSERT INTO adhoc_kept VALUES (2", "SELECT 1); DROP TABLE adhoc_kept --"])
def test_adhoc_sql_refuses_anything_but_queries(spark, patients_small, text):
    from pyspark.errors import ParseException
    if not spark.catalog.tableExists("adhoc_kept"):
        spark.range(2).write.saveAsTable("adhoc_kept")
    with pytest.raises(ParseException):
        inspect.adhoc_sql(spark, patients_small, text)
    assert spark.table("adhoc_kept").count() == 2 and not spark.catalog.tableExists("adhoc_new")


def test_profile_with_sample_rows(patients_small):
    plain = inspect.table_profile(patients_small).collect()
    rows = inspect.table_profile(patients_small, sample=4).collect()
    assert [r[:5] for r in map(tuple, plain)] == [(r.ordinal, r.column_name, r.data_type, r.non_null_count, r.row_count)
                                                   for r in rows]
    first = patients_small.orderBy("patient_id").limit(4).collect()
    by = {r.column_name: r.sample_values for r in rows}
    assert by["patient_id"] == ["1", "2", "3", "4"]
    assert by["specialty"] == [r.specialty for r in first] and by["age"] == [str(r.age) for r in first]
    assert [float(x) for x in by["priority_score"]] == [round(r.priority_score, 6) for r in first]
    missing = inspect.table_profile(patients_small.withColumn("gender", F.lit(None).cast("string")), sample=2).collect()
    assert {r.column_name: r.sample_values for r in missing}["gender"] == [None, None]
    assert inspect.table_profile(patients_small.limit(0), sample=3).first().sample_values == []
