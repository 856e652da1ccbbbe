"""Session helpers: building a session for tests/bench, and the shared folder
used for reliable checkpoints and scratch tables.

On a cluster the folder comes from ``spark.checkpoint.dir`` (a shared file
system). Only when the session names none and runs in one process (unit
tests, local runs) do we create a private one; elsewhere that is an error.
"""

from __future__ import annotations

import os
import re
import tempfile
import uuid
import zipfile
from contextlib import contextmanager
from contextvars import ContextVar

from pyspark.sql import SparkSession
from pyspark.sql.functions import broadcast

_LOCAL_DEFAULTS = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
    "spark.ui.enabled": "false",
    "spark.ui.showConsoleProgress": "false",
}


def get_spark(master: str = "local[8]", app: str = "linecdc", shuffle_partitions: int = 8,
              extra: dict | None = None) -> SparkSession:
    """Session for tests and the bench. Cluster jobs build their own session."""
    b = SparkSession.builder.master(master).appName(app)
    conf = dict(_LOCAL_DEFAULTS)
    conf["spark.sql.shuffle.partitions"] = str(shuffle_partitions)
    conf.setdefault("spark.driver.memory", os.environ.get("LINECDC_DRIVER_MEMORY", "8g"))
    conf.update(extra or {})
    for k, v in conf.items():
        b = b.config(k, v)
    spark = b.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    ensure_checkpoint_dir(spark)
    return spark


# Rows of an Arrow batch to a Python worker: texts may have thousands of characters, and
# both sides hold a batch several times.
ARROW_ROWS = 1000


def prepare_session(spark: SparkSession) -> None:
    """What every registered query needs of a session that somebody else has built: the
    shared folder, the package on the executors, UTC, and bounded Arrow batches (a
    smaller number that is set already is left)."""
    ensure_checkpoint_dir(spark)
    ship_package(spark)
    if spark.conf.get("spark.sql.session.timeZone") != "UTC":
        spark.conf.set("spark.sql.session.timeZone", "UTC")
    rows = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if not 0 < int(spark.conf.get(rows)) <= ARROW_ROWS:
        spark.conf.set(rows, str(ARROW_ROWS))


def ensure_checkpoint_dir(spark: SparkSession) -> str:
    """Return the reliable checkpoint folder, setting a private one only if unset."""
    sc = spark.sparkContext
    current = sc.getCheckpointDir()
    if current:
        return current
    configured = sc.getConf().get("spark.checkpoint.dir", None)
    if configured:
        sc.setCheckpointDir(configured)
    elif re.fullmatch(r"local(\[.*\])?", sc.master):
        # Unset, in one process: local runs and tests.
        sc.setCheckpointDir(tempfile.mkdtemp(prefix="linecdc-ckpt-"))
    else:
        raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
    return sc.getCheckpointDir()


def ship_package(spark: SparkSession) -> None:
    """Give the package to the Python workers through the driver's file server, so
    that they need no copy of it and no working directory of ours. Once a session."""
    sc = spark.sparkContext
    if getattr(sc, "_linecdc_shipped", False):
        return
    root = os.path.dirname(os.path.abspath(__file__))
    path = os.path.join(tempfile.mkdtemp(prefix="linecdc-py-"), "linecdc.zip")
    with zipfile.ZipFile(path, "w") as z:
        for folder, _, names in os.walk(root):
            for n in names:
                if n.endswith(".py"):
                    z.write(os.path.join(folder, n), os.path.relpath(os.path.join(folder, n), os.path.dirname(root)))
    sc.addPyFile(path)
    sc._linecdc_shipped = True


_SCOPE: ContextVar[str] = ContextVar("linecdc_scratch_scope", default="")


def scratch_root(spark: SparkSession, scope: str | None = None) -> str:
    scope = _SCOPE.get() if scope is None else scope
    return f"{ensure_checkpoint_dir(spark).rstrip('/')}/linecdc-scratch{'/' * bool(scope)}{scope}"


@contextmanager
def scratch_scope(name: str):
    """Scratch tables made inside go to a folder of their own, which
    ``drop_scratch`` deletes when what they led to has been written."""
    token = _SCOPE.set(name)
    try:
        yield
    finally:
        _SCOPE.reset(token)


def drop_scratch(spark: SparkSession, scope: str = "") -> None:
    """Delete the scratch tables of a scope (default: all of the session's shared
    folder), at the end of a job whose result has been written elsewhere."""
    path = spark._jvm.org.apache.hadoop.fs.Path(scratch_root(spark, scope))
    path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def scratch_path(spark: SparkSession, name: str) -> str:
    """A fresh path under the shared checkpoint folder for tables a job writes."""
    return f"{scratch_root(spark)}/{name}-{uuid.uuid4().hex}"


# Rows as a join holds them take several times the bytes of their Parquet files.
ROWS_TO_FILE = "16"


@contextmanager
def true_sizes(spark: SparkSession):
    """Inside, Spark takes the size of a stored table's rows, not of its compressed files,
    when it decides which tables go whole through the driver to all tasks."""
    conf = "spark.sql.sources.fileCompressionFactor"
    before = spark.conf.get(conf)
    spark.conf.set(conf, ROWS_TO_FILE)
    try:
        yield
    finally:
        spark.conf.set(conf, before)


# Rows of a table of names and numbers up to which it goes to all tasks.
BROADCAST_ROWS = 100_000


@contextmanager
def few_broadcasts(spark: SparkSession, rows: int):
    """Inside, with more than ``BROADCAST_ROWS`` rows, no table goes through the driver that
    code does not send itself: each one takes a page of the driver's memory, several live at
    a time, and the next rounds' are built before the last ones' are collected."""
    conf = "spark.sql.autoBroadcastJoinThreshold"
    before = spark.conf.get(conf)
    if rows > BROADCAST_ROWS:
        spark.conf.set(conf, "-1")
    try:
        yield
    finally:
        spark.conf.set(conf, before)


@contextmanager
def planned_once(spark: SparkSession):
    """Inside, a plan is not made anew after each of its stages: for small jobs whose joins
    say how they are done, which the driver plans for longer than they run."""
    conf = "spark.sql.adaptive.enabled"
    before = spark.conf.get(conf)
    spark.conf.set(conf, "false")
    try:
        yield
    finally:
        spark.conf.set(conf, before)


def small_table(df, name: str = "small"):
    """``df`` written once; a join sends it to the other side's tasks if it is small, which
    Spark can't tell beforehand of a group-by's result and would shuffle both sides."""
    table = materialize(df, name)
    return broadcast(table) if table.count() <= BROADCAST_ROWS else table


def materialize(df, name: str = "stage"):
    """Write ``df`` as Parquet under the shared checkpoint folder and return the
    re-read table. Used to cut lineage in iterative jobs; a lost executor
    recomputes nothing older than the last written table."""
    path = scratch_path(df.sparkSession, name)
    # The path is new and only read from here: no file has to say that it is whole.
    df.write.mode("overwrite").option("mapreduce.fileoutputcommitter.marksuccessfuljobs", "false").parquet(path)
    # The columns are known: no job looks them up in the files.
    return df.sparkSession.read.schema(df.schema).parquet(path)
