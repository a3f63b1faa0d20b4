"""Session helpers: a local session for tests and the bench, and a shared
scratch location taken from ``spark.checkpoint.dir``."""
from __future__ import annotations

import os
import re
import tempfile
import uuid
from contextlib import contextmanager
from contextvars import ContextVar

from pyspark.sql import SparkSession


def local_session(cores: int | str = "*", shuffle_partitions: int = 8,
                  app: str = "quarry") -> SparkSession:
    """A local session configured the way the library expects a cluster to be:
    AQE on, Arrow on, UI off, UTC."""
    builder = (
        SparkSession.builder.master(f"local[{cores}]")
        .appName(app)
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.sql.shuffle.partitions", str(shuffle_partitions))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.coalescePartitions.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        # One BLAS thread per Python worker: Spark already runs one worker
        # per core, so threaded BLAS would only oversubscribe the cores.
        .config("spark.executorEnv.OPENBLAS_NUM_THREADS", "1")
        .config("spark.executorEnv.OMP_NUM_THREADS", "1")
        .config("spark.executorEnv.MKL_NUM_THREADS", "1")
        .config("spark.driver.memory", os.environ.get("QUARRY_DRIVER_MEMORY", "16g"))
    )
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    ensure_checkpoint_dir(spark)
    ship_package(spark)
    return spark


def ensure_checkpoint_dir(spark: SparkSession) -> str:
    """Return the shared checkpoint folder.  A cluster names it in
    ``spark.checkpoint.dir``; when it is unset, a local session gets a folder
    of its own, and any other raises, as executors would not share it."""
    cur = spark.conf.get("spark.checkpoint.dir", None)
    if not cur:
        cur = spark.sparkContext.getCheckpointDir()
    if not cur:
        if not re.match(r"local(\[|$)", spark.sparkContext.master):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        cur = tempfile.mkdtemp(prefix="quarry-ckpt-")
        spark.conf.set("spark.checkpoint.dir", cur)
    if not spark.sparkContext.getCheckpointDir():
        spark.sparkContext.setCheckpointDir(cur)
    return cur


def scratch_path(spark: SparkSession, name: str) -> str:
    """A fresh sub-folder of the shared checkpoint folder for written tables."""
    base = ensure_checkpoint_dir(spark)
    return f"{base.rstrip('/')}/quarry-{name}-{uuid.uuid4().hex[:12]}"


_SHIPPED: set = set()


def ship_package(spark: SparkSession) -> None:
    """Make ``quarry`` importable in Python workers (``addPyFile`` of a zip of
    the package), once per SparkContext.  Python UDFs, ``mapInArrow`` and
    ``applyInPandas`` functions refer to the package's kernels by name."""
    sc = spark.sparkContext
    key = id(sc._jsc) if sc._jsc is not None else id(sc)
    if key in _SHIPPED:
        return
    if not sc.master.startswith("local") or "quarry" in (spark.conf.get("spark.submit.pyFiles", "") or ""):
        # On a cluster the package is installed on executors or passed with
        # --py-files; nothing is shipped from the driver's disk.
        _SHIPPED.add(key)
        return
    import zipfile

    pkg = os.path.dirname(os.path.abspath(__file__))
    out = os.path.join(tempfile.mkdtemp(prefix="quarry-pkg-"), "quarry.zip")
    with zipfile.ZipFile(out, "w", zipfile.ZIP_DEFLATED) as z:
        for root, _dirs, files in os.walk(pkg):
            if "__pycache__" in root:
                continue
            for f in files:
                if f.endswith(".py"):
                    full = os.path.join(root, f)
                    z.write(full, os.path.relpath(full, os.path.dirname(pkg)))
    sc.addPyFile(out)
    _SHIPPED.add(key)


def materialize(df, options: dict | None = None):
    """Cut lineage of an intermediate result that is read more than once:
    write it as a parquet table into the shared checkpoint folder and read
    it back.  One computation (``checkpoint(eager=True)`` on an unpersisted
    plan computes it twice: once to count, once to write), and the written
    table survives the loss of executors, unlike a cache or a local
    checkpoint.  ``options`` are those of the writer.  Inside
    ``scratch_tables`` the table lasts as long as the block."""
    spark = df.sparkSession
    path = scratch_path(spark, "table")
    scope = _SCOPE.get()
    if scope is not None:
        scope.paths.append(path)
    df.write.mode("overwrite").options(**(options or {})).parquet(path)
    table = spark.read.parquet(path)
    if scope is not None:
        scope.tables.append((table, path))
    return table


class ScratchTables:
    """What ``materialize`` wrote inside a block: all paths, and the tables
    that were read back."""

    def __init__(self, outer: ScratchTables | None):
        self.outer, self.paths, self.tables = outer, [], []

    def keep(self, *tables) -> None:
        """Leave these tables, as ``materialize`` returned them, to the block
        around this one, if there is one."""
        for table in tables:
            path = next((p for t, p in self.tables if t is table), None)
            if path is None:
                raise ValueError("not a table that materialize wrote in this block")
            self.paths.remove(path)
            if self.outer is not None:
                self.outer.paths.append(path)
                self.outer.tables.append((table, path))


_SCOPE: ContextVar[ScratchTables | None] = ContextVar("scratch_tables", default=None)


@contextmanager
def scratch_tables(spark: SparkSession):
    """Delete at the end of the block the tables that ``materialize`` wrote in
    it, but for those that ``keep`` names: what the block returns may read
    only these.  Blocks may be nested."""
    scope = ScratchTables(_SCOPE.get())
    token = _SCOPE.set(scope)
    try:
        yield scope
    finally:
        _SCOPE.reset(token)
        jvm, conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
        for path in scope.paths:
            folder = jvm.org.apache.hadoop.fs.Path(path)
            folder.getFileSystem(conf).delete(folder, True)
