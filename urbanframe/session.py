"""Session factory and shared-storage helpers."""

from __future__ import annotations

import uuid
import zipfile
from collections.abc import Iterator
from contextlib import contextmanager
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession


def build_session(
    master: str | None = None,
    app_name: str = "urbanframe",
    shuffle_partitions: int | None = None,
    extra: dict[str, str] | None = None,
) -> SparkSession:
    """Return a session configured for the library's contract.

    * session time zone pinned to UTC, so ``year()``/``month()`` of parsed
      timestamps do not depend on the host;
    * ANSI mode left at the 4.x default (on): operators use ``try_*`` forms so bad
      input becomes NULL instead of failing the job;
    * AQE on, with partition coalescing and skew-join splitting, so hot keys in a
      sort-merge / shuffled-hash join are split at run time;
    * the web UI off (no listening server besides what Spark itself needs).

    On a cluster pass ``master=None`` and let spark-submit decide; size
    ``shuffle_partitions`` to the data (about 128-256 MB of shuffle per partition).
    """
    builder = SparkSession.builder.appName(app_name)
    if master:
        builder = builder.master(master)
    conf = {
        "spark.sql.session.timeZone": "UTC",
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.coalescePartitions.enabled": "true",
        "spark.sql.adaptive.skewJoin.enabled": "true",
        "spark.ui.enabled": "false",
        "spark.ui.showConsoleProgress": "false",
        "spark.sql.execution.arrow.pyspark.enabled": "true",
    }
    if master and master.startswith("local"):
        # local mode runs every task inside the driver JVM
        conf["spark.driver.memory"] = "8g"
    if shuffle_partitions is not None:
        conf["spark.sql.shuffle.partitions"] = str(shuffle_partitions)
    conf.update(extra or {})
    for key, value in conf.items():
        builder = builder.config(key, value)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    ship_package(spark)
    return spark


def ship_package(spark: SparkSession) -> None:
    """Give this package to the Python workers, once per application.

    Functions that run in workers are pickled by reference, so a worker must be
    able to import the package wherever the driver was started.
    """
    sc = spark.sparkContext
    if sc.applicationId in _shipped:
        return
    package = Path(__file__).resolve().parent
    archive = Path(sc._temp_dir) / "urbanframe-package.zip"  # read by the driver alone, which serves it
    with zipfile.ZipFile(archive, "w") as z:
        for f in sorted(package.rglob("*.py")):
            z.write(f, str(Path(package.name) / f.relative_to(package)))
    sc.addPyFile(str(archive))
    _shipped.add(sc.applicationId)


_shipped: set[str] = set()


def checkpoint_dir(spark: SparkSession) -> str:
    """Shared folder for intermediate tables.

    It is, in this order, the SparkContext's checkpoint folder, the setting
    ``spark.checkpoint.dir``, or a folder under ``spark.sql.warehouse.dir``.  On a
    cluster it must be storage that the driver and all executors share: a folder
    on the local file system is refused there unless ``spark.checkpoint.dir``
    names it, which states that every machine mounts it.
    """
    sc = spark.sparkContext
    named = sc.getCheckpointDir() or spark.conf.get("spark.checkpoint.dir", None)
    if named:
        if not sc.getCheckpointDir():
            sc.setCheckpointDir(named)
        return sc.getCheckpointDir() or named
    folder = spark.conf.get("spark.sql.warehouse.dir").rstrip("/") + "/_intermediate"
    if not sc.master.startswith("local") and _is_local_path(spark, folder):
        raise ValueError(
            f"intermediate tables need shared storage, but {folder} is local to each machine; set spark.checkpoint.dir"
        )
    sc.setCheckpointDir(folder)
    return sc.getCheckpointDir() or folder


def _is_local_path(spark: SparkSession, folder: str) -> bool:
    """True if ``folder`` lies on a machine's own file system (its scheme is ``file``)."""
    path = spark._jvm.org.apache.hadoop.fs.Path(folder)
    return path.getFileSystem(spark._jsc.hadoopConfiguration()).getUri().getScheme() == "file"


def scratch_path(spark: SparkSession, name: str) -> str:
    """A fresh, never reused sub-folder of the shared checkpoint folder."""
    base = checkpoint_dir(spark).rstrip("/")
    return f"{base}/{name}-{uuid.uuid4().hex}"


# frees a query's shuffle files as soon as the query has ended
SHUFFLE_CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


@contextmanager
def shuffle_cleanup(spark: SparkSession) -> Iterator[None]:
    """Within the block, every finished query drops its shuffle files."""
    before = spark.conf.get(SHUFFLE_CLEANUP, None)
    spark.conf.set(SHUFFLE_CLEANUP, "true")
    try:
        yield
    finally:
        if before is None:
            spark.conf.unset(SHUFFLE_CLEANUP)
        else:
            spark.conf.set(SHUFFLE_CLEANUP, before)


# bytes of rows that Spark hands to a Python worker at once
ARROW_BYTES = "spark.sql.execution.arrow.maxBytesPerBatch"


def small_batches(spark: SparkSession, size: str = "4m") -> None:
    """Let Spark hand rows to Python workers in batches of about ``size``, unless the session has a limit of its own.

    Spark's default is 64 MB or 10,000 rows, which an executor holds several times for every
    running task: in the buffers it fills, in the worker, and in the rows it gets back.  The
    setting stays with the session, since a plan takes it when it is run.
    """
    if spark.conf.get(ARROW_BYTES, None) is None:
        spark.conf.set(ARROW_BYTES, size)


def materialize(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` once as Parquet under the shared checkpoint folder and read it back.

    Cuts the lineage like ``checkpoint()``, but computes the plan only once (a
    reliable RDD checkpoint runs it a second time to write it) and stores it
    columnar and compressed.  The files live on the cluster's shared storage, so
    losing an executor does not lose them; the shuffle files behind them are no
    longer needed and are dropped at once.  The folder belongs to the innermost
    open :class:`Intermediates`, else to the application (:func:`remove_intermediate`).
    """
    spark = df.sparkSession
    path = owned_path(spark, name)
    with shuffle_cleanup(spark):
        df.write.mode("overwrite").option("compression", "zstd").parquet(path)
    # the schema is known: passing it skips reading Parquet footers to infer it
    back = spark.read.schema(df.schema).parquet(path)
    back._intermediate_path = path
    return back


def owned_path(spark: SparkSession, name: str) -> str:
    """A fresh folder as :func:`scratch_path` gives it, deleted with its owner's other folders."""
    path = scratch_path(spark, name)
    scopes = _scopes.get(spark.sparkContext.applicationId)
    if scopes:
        scopes[-1]._paths.append(path)
    else:
        _written.setdefault(spark.sparkContext.applicationId, []).append(path)
    return path


_written: dict[str, list[str]] = {}  # application -> folders outside of any scope
_scopes: dict[str, list["Intermediates"]] = {}  # application -> open scopes, the innermost last


class Intermediates:
    """Owner of the scratch folders written inside its ``with`` block.

    Tables that have had their last reader are deleted at once by :func:`release`; at
    the end of the block the rest goes, but for the tables handed to :meth:`keep`,
    which pass to the enclosing owner.  Deleted on an error, too.
    """

    def __init__(self, spark: SparkSession):
        self.spark = spark
        self._paths: list[str] = []
        self._kept: list[str] = []

    def __enter__(self) -> "Intermediates":
        _scopes.setdefault(self.spark.sparkContext.applicationId, []).append(self)
        return self

    def keep(self, table: DataFrame) -> DataFrame:
        """Let ``table``, a result of :func:`materialize`, outlive the block."""
        self._kept.append(table._intermediate_path)
        return table

    def __exit__(self, *error: object) -> None:
        app = self.spark.sparkContext.applicationId
        open_scopes = _scopes[app]
        open_scopes.remove(self)
        kept = [p for p in self._paths if p in self._kept]
        for p in self._paths:
            if p not in self._kept:
                _delete(self.spark, p)
        (open_scopes[-1]._paths if open_scopes else _written.setdefault(app, [])).extend(kept)


def release(*tables: DataFrame) -> None:
    """Delete the folders of materialized tables whose last reader has ended."""
    for table in tables:
        path = table._intermediate_path
        app = table.sparkSession.sparkContext.applicationId
        for owner in [_written.get(app, []), *(s._paths for s in _scopes.get(app, []))]:
            if path in owner:
                owner.remove(path)
        _delete(table.sparkSession, path)


def _delete(spark: SparkSession, folder: str) -> None:
    path = spark._jvm.org.apache.hadoop.fs.Path(folder)
    path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def remove_intermediate(spark: SparkSession) -> int:
    """Delete every intermediate folder this application wrote and still owns; returns their number.

    Call it when all results built on them have been written or collected.
    """
    paths = _written.pop(spark.sparkContext.applicationId, [])
    for p in paths:
        _delete(spark, p)
    return len(paths)
