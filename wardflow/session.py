"""Session helpers: local session for tests and benches, and tables written
to the shared checkpoint folder."""

from __future__ import annotations

import os
import tempfile
import uuid
import warnings

from py4j.protocol import Py4JError
from pyspark.errors import PySparkException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Session setting: paths of the local file system are a mount that every
#: machine of the cluster shares.
SHARED_MOUNT = "spark.wardflow.sharedMount"
#: (application, folder) of the ``file:`` folders in which all machines met.
_MET: set[tuple[str, str]] = set()


def local_session(cores: int | str = "*", shuffle_partitions: int = 8,
                  app_name: str = "wardflow") -> SparkSession:
    """Session used by tests and ``bench.py``; clusters bring their own."""
    builder = (
        SparkSession.builder.master(f"local[{cores}]")
        .appName(app_name)
        .config("spark.sql.shuffle.partitions", str(shuffle_partitions))
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.driver.memory", os.environ.get("WARDFLOW_DRIVER_MEMORY", "8g"))
    )
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def _shared(folder: str, master: str, resolved: str | None = None, allow_file: bool = False) -> str:
    """``folder``, unless it is machine-local while the session is a cluster's.
    ``resolved`` is the folder with its file system (a path without a scheme
    belongs to the cluster's default one); ``allow_file`` says that ``file:``
    paths are a mount that all machines share."""
    if not master.startswith("local") and not allow_file and (resolved or folder).startswith(("file:", "/")):
        raise RuntimeError(f"{folder} is local to one machine; set a folder that all executors share, or, "
                           f"if it is a shared mount, {SHARED_MOUNT}=true")
    return folder


def _checked(spark: SparkSession, folder: str, master: str) -> str:
    where, system = _located(spark, folder)
    allow = spark.conf.get(SHARED_MOUNT, "false").lower() == "true"
    return _shared(folder, master, system.makeQualified(where).toString(), allow)


def _trial(spark: SparkSession, folder: str) -> str:
    """Why the machines do not meet in ``folder``; empty if they do: the driver
    finds all that tasks write there, and tasks can read it. Tried once per
    application and folder that passes, with two rows for each task slot."""
    key = (spark.conf.get("spark.app.id", "app"), folder)
    if key in _MET:
        return ""
    n = 2 * max(2, spark.sparkContext.defaultParallelism)
    path = f"{folder.rstrip('/')}/wardflow-trial-{uuid.uuid4().hex}"
    try:
        spark.range(0, n, 1, n).write.parquet(path)
        back = spark.read.schema("id bigint").parquet(path).agg(F.count("id"), F.sum("id")).first()
    except (PySparkException, Py4JError) as error:
        return f"a trial there failed: {(str(error).strip().splitlines() or [type(error).__name__])[0]}"
    try:
        delete_path(spark, path)
    except Py4JError:  # the rows are of no use, but do no harm
        pass
    if tuple(back) != (n, n * (n - 1) // 2):
        return f"of {n} rows that tasks wrote there, {back[0]} were found"
    _MET.add(key)
    return ""


def _accepted(spark: SparkSession, folder: str, master: str) -> str:
    """``folder``, if its file system is a shared one, or it is a mount of which
    the setting or a trial tells that all machines share it. The executors of a
    local cluster may have paths of their own (/proc/self), so it has the trial
    too."""
    try:
        _checked(spark, folder, master)
        refused = f"{folder} is not shared by the executors" if master.startswith("local-cluster") else ""
    except RuntimeError as error:
        refused = str(error)
    if refused and (why := _trial(spark, folder)):
        raise RuntimeError(f"{refused} ({why})")
    return folder


def require_shared(spark: SparkSession, setting: str) -> None:
    """Error if the folder that ``setting`` names is machine-local on a cluster."""
    master = spark.conf.get("spark.master", "local")
    folder = spark.conf.get(setting, None)
    if folder:
        _accepted(spark, folder, master)


def _warehouse_folder(spark: SparkSession, why: str) -> str:
    """A folder of the warehouse, which all machines share, in place of a
    checkpoint folder that is not set or not shared. An error if the machines
    do not meet in the warehouse either."""
    sc = spark.sparkContext
    folder = f"{spark.conf.get('spark.sql.warehouse.dir').rstrip('/')}/wardflow.checkpoints"
    try:
        _accepted(spark, folder, sc.master)
    except RuntimeError as error:
        raise RuntimeError(f"{why}; the warehouse cannot take its place: {error}") from None
    warnings.warn(f"{why}; intermediate tables go to {folder}", stacklevel=3)
    sc.setCheckpointDir(folder)
    return sc.getCheckpointDir()


def checkpoint_dir(spark: SparkSession) -> str:
    """The shared checkpoint folder of the cluster.

    Read from the session (``spark.checkpoint.dir`` or an earlier
    ``setCheckpointDir``). A cluster without one, or with one that its machines
    do not share, gets a folder of its warehouse, if they share that; else it
    is an error, since a folder of one machine would not survive its loss.
    Only a session on one machine without one gets a fresh temporary folder.
    """
    configured = spark.conf.get("spark.checkpoint.dir", None)
    try:
        sc = spark.sparkContext
    except Exception:  # noqa: BLE001 - Spark Connect: the server owns the folder
        if configured:
            return configured
        raise RuntimeError("spark.checkpoint.dir is not set on the server") from None
    current = sc.getCheckpointDir()
    configured = configured or sc.getConf().get("spark.checkpoint.dir", None)
    try:
        if current:
            return _accepted(spark, current, sc.master)
        if configured:
            sc.setCheckpointDir(_accepted(spark, configured, sc.master))
            return sc.getCheckpointDir() or configured
    except RuntimeError as refused:
        return _warehouse_folder(spark, str(refused))
    if sc.master != "local" and not sc.master.startswith("local["):
        return _warehouse_folder(spark, "spark.checkpoint.dir is not set; set it to a shared, reliable folder")
    sc.setCheckpointDir(tempfile.mkdtemp(prefix="wardflow-ckpt-"))
    return sc.getCheckpointDir()


def scratch_root(spark: SparkSession) -> str:
    """Folder of this application's intermediate tables."""
    app = spark.conf.get("spark.app.id", "app")
    return f"{checkpoint_dir(spark).rstrip('/')}/wardflow-{app}"


def scratch_path(spark: SparkSession, name: str = "table") -> str:
    return f"{scratch_root(spark)}/{name}-{uuid.uuid4().hex}"


def reliable_checkpoint(df: DataFrame, name: str = "table") -> DataFrame:
    """Write ``df`` once as parquet under the checkpoint folder and read it
    back, cutting its lineage.

    ``Dataset.checkpoint`` computes an uncached plan twice (once to count,
    once to write the files); a written table computes it once, and the
    read-back is a columnar scan with pruning and filter pushdown. The files
    stay until ``release`` (the returned frame reads them lazily).
    """
    spark = df.sparkSession
    path = scratch_path(spark, name)
    df.write.mode("overwrite").parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def _located(spark: SparkSession, path: str):
    """A path and its own file system."""
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    return where, where.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf())


def path_exists(spark: SparkSession, path: str) -> bool:
    where, system = _located(spark, path)
    return bool(system.exists(where))


def child_folders(spark: SparkSession, path: str) -> list[str]:
    """Names of the folders in a folder; none if it does not exist."""
    where, system = _located(spark, path)
    if not system.exists(where):
        return []
    return sorted(s.getPath().getName() for s in system.listStatus(where) if s.isDirectory())


def delete_path(spark: SparkSession, path: str) -> None:
    """Delete one folder through its own file system."""
    where, system = _located(spark, path)
    system.delete(where, True)


def release(*frames: DataFrame, spark: SparkSession | None = None, only: tuple[str, ...] = ()) -> None:
    """Delete intermediate tables that are no longer read.

    With ``frames``: the tables written by ``reliable_checkpoint`` that these
    frames read (those whose name is in ``only``, if given); other files are
    never touched. With
    ``spark`` alone: every intermediate table of this application, for a
    caller that has consumed all its results.
    """
    if spark is not None:
        delete_path(spark, scratch_root(spark))
    for df in frames:
        session = df.sparkSession
        marker = "/" + scratch_root(session).rsplit("/", 1)[-1] + "/"
        for folder in {f.rsplit("/", 1)[0] for f in df.inputFiles() if marker in f}:
            if not only or folder.rsplit("/", 1)[-1].rsplit("-", 1)[0] in only:
                delete_path(session, folder)

