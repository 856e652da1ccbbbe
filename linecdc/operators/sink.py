"""Sinks and keyed state: first-wins, insert-if-absent, snapshots, dead
letters and redrive (B1-B9, E3, G3, G4, I2, I3).

The change table is Parquet partitioned by ``(run_id, batch_id)``. A batch is
written with dynamic partition overwrite into its own partition, after an
anti-join on ``event_id`` against every *other* partition: replaying a batch
rewrites the same rows, and an id stored by any earlier batch is never
written again (first write wins).
"""

from __future__ import annotations

from concurrent.futures import ThreadPoolExecutor

from pyspark import inheritable_thread_target
from pyspark.sql import Column, DataFrame, Observation, SparkSession, Window
from pyspark.sql import functions as F

from linecdc.functions.text import built, select_built
from linecdc.operators.codec import CORRUPT, decode, publish_frame, split, to_table_rows, validate
from linecdc.schema import EVENT_COLUMNS, change_table_ddl
from linecdc.session import materialize, planned_once, scratch_path, small_table


# Batches up to this many ids (about 50 MB) go to the history's tasks; larger ones are shuffled with it.
BROADCAST_IDS = 1_000_000
# Batches up to this many ids are one file of their partition.
ONE_FILE_IDS = 100_000
# Bytes of a batch's files up to which one task decodes it: dealing it out would take longer.
ONE_TASK_BYTES = 1 << 20
# Bytes of stored ids that are read by one task and written to one file.
MERGED_BYTES = 32 << 20


def first_wins(valid: DataFrame, order: tuple[str, ...] = ("partition", "offset")) -> DataFrame:
    """One row per event_id, the one with the smallest log position. A row without a
    position comes last, so an id is kept even if none of its rows has one. Rows at one
    position are ordered by a hash of their columns, so a replay keeps the same one.

    The row number is limited to 1, so Spark drops the other rows of an id before the
    exchange already: one exchange, and a hot id sends one row a task."""
    return valid.withColumn("_rn", built(_place, tuple(order), tuple(valid.columns))).where("_rn = 1").drop("_rn")


def _place(order: tuple[str, ...], columns: tuple[str, ...]) -> Column:
    first = Window.partitionBy("event_id").orderBy(*[F.asc_nulls_last(c) for c in order], F.xxhash64(*columns))
    return F.row_number().over(first)


def _exists(spark: SparkSession, path: str) -> bool:
    jvm = spark.sparkContext._jvm
    p = jvm.org.apache.hadoop.fs.Path(path)
    fs = p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    return fs.exists(p)


def define_table(spark: SparkSession, name: str, path: str) -> DataFrame:
    """The change table at ``path`` under a name in the catalog, with its
    declared columns; partitions written so far are found."""
    spark.sql(change_table_ddl(name, path))
    spark.sql(f"ALTER TABLE {name} RECOVER PARTITIONS")
    return spark.table(name)


def read_table(spark: SparkSession, path: str) -> DataFrame:
    """The change table (all partitions)."""
    return spark.read.parquet(path)


class StoredIds:
    """The ids in a change table, for a stream that asks again and again: those of its own run
    as a few tables, so that a batch does not list and open all partitions before it. A
    partition is a table of its own at first; ``FAN`` tables of a level are written as one of
    the next. What the run has stored is looked up when it starts and when a batch comes
    again, other runs' partitions at each batch."""

    FAN = 8

    def __init__(self, path: str, run_id: str):
        self.path, self.run_id, self.levels, self.seen = path.rstrip("/"), run_id, None, set()

    def _listed(self, spark: SparkSession, path: str) -> list[str]:
        jvm = spark.sparkContext._jvm
        p = jvm.org.apache.hadoop.fs.Path(path)
        fs = p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
        return [f.getPath().getName() for f in fs.listStatus(p) if f.isDirectory()] if fs.exists(p) else []

    def _own(self, spark: SparkSession) -> str:
        return "run_id=" + spark._jvm.org.apache.spark.sql.catalyst.catalog.ExternalCatalogUtils.escapePathName(self.run_id)

    def before(self, spark: SparkSession, batch_id: int) -> DataFrame | None:
        """``event_id`` of all partitions but that of the batch; None if there are none."""
        own = self._own(spark)
        if self.levels is None or batch_id in self.seen:
            there = [n for n in self._listed(spark, f"{self.path}/{own}") if n.startswith("batch_id=") and n != f"batch_id={batch_id}"]
            self.levels, self.seen = [[f"{self.path}/{own}/{n}" for n in there]], {int(n.split("=")[1]) for n in there}
        self._merge(spark)
        others = [f"{self.path}/{n}" for n in self._listed(spark, self.path) if n.startswith("run_id=") and n != own]
        read = lambda paths: spark.read.schema("event_id string").parquet(*paths).select("event_id")
        found = [read(paths) for paths in ([p for level in self.levels for p in level], others) if paths]
        return found[0].unionByName(found[1]) if len(found) > 1 else found[0] if found else None

    def add(self, spark: SparkSession, batch_id: int) -> None:
        """The batch's partition has been written."""
        self.levels[0].append(f"{self.path}/{self._own(spark)}/batch_id={batch_id}")
        self.seen.add(batch_id)

    def _merge(self, spark: SparkSession) -> None:
        for k, level in enumerate(self.levels):
            if len(level) >= self.FAN:
                merged, ids = scratch_path(spark, "ids"), spark.read.schema("event_id string").parquet(*level)
                ids.coalesce(1 + stored_bytes(ids) // MERGED_BYTES).write.parquet(merged)
                level.clear()
                if k + 1 == len(self.levels):
                    self.levels.append([])
                self.levels[k + 1].append(merged)


def stored_bytes(df: DataFrame) -> int:
    """The bytes of a plan's rows, as Spark takes them: those of the files of a scan."""
    return int(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes())


def insert_few(events: DataFrame, path: str, run_id: str, batch_id: int, rows: int, stored: DataFrame | None, loaded_at=None,
               order: tuple[str, str] = ("partition", "offset")) -> dict:
    """As ``insert_if_absent``, of a stored table of at most ``ONE_FILE_IDS`` events: they are
    one task's work, so nothing of them is stored or dealt out on the way. ``stored`` has the
    ids of the other partitions."""
    spark, batch = events.sparkSession, first_wins(events.coalesce(1), order)
    if stored is not None:
        # At most the batch's ids both ways: a table has an id once a run.
        hits = stored.join(F.broadcast(events.select("event_id")), "event_id", "left_semi")
        batch = batch.join(F.broadcast(hits), "event_id", "left_anti")
    with planned_once(spark):
        inserted = write_partition(batch.select(*EVENT_COLUMNS), path, run_id, batch_id, loaded_at, True)
    return {"offered": rows, "inserted": inserted, "duplicate": rows - inserted}


def insert_if_absent(events: DataFrame, path: str, run_id: str, batch_id: int,
                     loaded_at=None, order: tuple[str, str] = ("partition", "offset")) -> dict:
    """Append ``events`` (valid, with log coordinates) once per event_id.

    Returns counts ``offered, inserted, duplicate`` (F2). An empty batch writes
    nothing (C12). ``order`` names the columns whose least value wins; without
    them no row could be said to be first, so they are required.

    The winners are written once, counted on the way, and read from there. The history
    gives only its key column, reduced to the batch's ids before anything is shuffled;
    rows are stored in order of file and time, so lookups skip row groups."""
    if missing := [c for c in order if c not in events.columns]:
        raise ValueError(f"first write wins needs the columns {missing}")
    spark = events.sparkSession
    seen, own_ids = Observation(), Observation()
    batch = materialize(first_wins(events.observe(seen, F.count(F.lit(1)).alias("n")), order).observe(
        own_ids, F.count(F.lit(1)).alias("n")), "batch")
    offered, ids = seen.get["n"], own_ids.get["n"]
    if not ids:
        return {"offered": 0, "inserted": 0, "duplicate": 0}
    if _exists(spark, path):
        own = batch.select("event_id")
        hits = (spark.read.schema("event_id string, run_id string, batch_id long").parquet(path)
                .where(~((F.col("run_id") == run_id) & (F.col("batch_id") == batch_id))).select("event_id")
                .join(F.broadcast(own) if ids <= BROADCAST_IDS else own, "event_id", "left_semi"))
        batch = batch.join(hits.distinct(), "event_id", "left_anti")
        if ids > ONE_FILE_IDS:  # else dealing the rows out in order would read the history again
            batch = materialize(batch, "absent")
    extra = [c for c in ("version", "change_seq") if c in batch.columns]
    inserted = write_partition(batch.select(*EVENT_COLUMNS, *extra), path, run_id, batch_id, loaded_at, ids <= ONE_FILE_IDS)
    return {"offered": offered, "inserted": inserted, "duplicate": offered - inserted}


def of_batch(rows: DataFrame, run_id: str, batch_id: int) -> DataFrame:
    """``rows`` with their partition's columns. A number would be part of the generated code,
    which would be compiled anew for every batch; a folder's name is the same for a text."""
    return rows.withColumns({"run_id": F.lit(run_id), "batch_id": F.lit(str(batch_id))})


def write_partition(events: DataFrame, path: str, run_id: str, batch_id: int, loaded_at=None, one_file: bool = False) -> int:
    """Events as the change table's partition of a batch, in order of file and time; their
    number. ``one_file`` for few rows: one task sorts and writes them."""
    kept = Observation()
    rows = to_table_rows(events)
    rows = rows.coalesce(1) if one_file else rows.repartitionByRange("file_name", "event_timestamp")
    rows = (rows.sortWithinPartitions("file_name", "event_timestamp")
            .observe(kept, F.count(F.lit(1)).alias("n"))
            .withColumn("loaded_at", loaded_at if loaded_at is not None else F.current_timestamp()))
    (of_batch(rows, run_id, batch_id).write.mode("overwrite").option("partitionOverwriteMode", "dynamic")
     .partitionBy("run_id", "batch_id").parquet(path))
    return kept.get["n"]


def spread(records: DataFrame) -> DataFrame:
    """A batch's records over at least as many tasks as there are cores. A file of the log is
    cut into splits, but a row group is read whole by one of them, and decoding a record
    takes far longer than moving it."""
    return records.repartition(max(records.sparkSession.sparkContext.defaultParallelism, records.rdd.getNumPartitions()))


def _counts() -> tuple[Column, Column]:
    return F.count_if(F.col("reason").isNull()).alias("valid"), F.count_if(F.col("reason").isNotNull()).alias("invalid")


def write_batch(records: DataFrame, table_path: str, dlq_path: str, run_id: str, batch_id: int,
                loaded_at=None, ids: StoredIds | None = None) -> dict:
    """B8 body: decode once (unless the stream has) -> split -> first-wins -> insert-if-absent;
    invalid rows to the dead-letter table. Returns counts (F2); nothing is collected. ``ids`` is what a
    stream keeps from batch to batch. The job of a small batch takes less time than the
    driver needs for it, so a batch has few, and the dead letters are written beside the rest."""
    seen, ids = Observation(), ids or StoredIds(table_path, run_id)
    spark, small = records.sparkSession, stored_bytes(records) <= ONE_TASK_BYTES
    with ThreadPoolExecutor(2) as beside:
        submit = lambda f, *args, **kw: beside.submit(inheritable_thread_target(spark)(f), *args, **kw)
        stored = submit(ids.before, spark, batch_id) if small else None
        if not {*EVENT_COLUMNS, CORRUPT, "reason"} <= {*records.columns}:
            records = validate(decode(records if small else spread(records)))
        valid, dlq = split(materialize(records.observe(seen, *built(_counts)), "decoded"))
        rows, n_dlq = seen.get["valid"], seen.get["invalid"]
        letters = submit(append_dlq, dlq, dlq_path, run_id, batch_id, n=n_dlq)
        if not rows:
            counts = {"offered": 0, "inserted": 0, "duplicate": 0}
        elif rows <= ONE_FILE_IDS:
            known = stored.result() if stored else ids.before(spark, batch_id)
            counts = insert_few(valid, table_path, run_id, batch_id, rows, known, loaded_at)
            if counts["inserted"]:
                ids.add(spark, batch_id)
        else:
            counts = insert_if_absent(valid, table_path, run_id, batch_id, loaded_at)
            ids.levels = None
        letters.result()
    counts["invalid"] = n_dlq
    counts["offered"] += n_dlq
    return counts


DLQ_COLUMNS = {"key": "binary", "value": "binary", "reason": "string", "topic": "string", "partition": "int",
               "offset": "long", "timestamp": "timestamp"}


def _letters(there: tuple[str, ...]) -> list[Column]:
    return [(F.col(c) if c in there else F.lit(None)).cast(t).alias(c) for c, t in DLQ_COLUMNS.items()]


def append_dlq(dlq: DataFrame, path: str, run_id: str, batch_id: int, status: str = "pending", n: int | None = None) -> int:
    """B2: dead letters of every path in one form: key and bytes as they came, the
    reason, and the log position if there is one. Replays of the same batch
    overwrite their own partition. Returns the row count. Unless ``n`` gives it, ``dlq`` is
    counted, then written: it should be of a stored table."""
    there = dlq.columns
    rows = select_built(dlq, _letters, tuple(c for c in DLQ_COLUMNS if c in there))
    n = rows.count() if n is None else n
    if n:
        (of_batch(rows.withColumn("status", F.lit(status)), run_id, batch_id)
         .write.mode("overwrite").option("partitionOverwriteMode", "dynamic")
         .partitionBy("run_id", "batch_id").parquet(path))
    return n


def send_once(records: DataFrame, deliver) -> tuple[DataFrame, DataFrame]:
    """(delivered, undelivered) of ``records(key, value)``. ``deliver(records)``
    returns the records it could deliver; its plan runs once, into a status table,
    and both sides are read from there."""
    sent = materialize(deliver(records).select("key", "value").distinct(), "delivered")
    same = records["key"].eqNullSafe(sent["key"]) & records["value"].eqNullSafe(sent["value"])
    return sent, records.join(sent, same, "left_anti")


def redrive(pending: DataFrame, deliver) -> tuple[DataFrame, DataFrame]:
    """Re-publish pending payloads keeping their key; entries whose
    delivery fails again stay pending (pending anti-join delivered)."""
    return send_once(materialize(pending, "pending"), deliver)


def log_rows(records: DataFrame, topic: str, batch_id: int) -> DataFrame:
    """``records(key, value)`` with log coordinates for a landing folder that stands
    in for a topic: a writing task is a partition, offsets rise with batch and row."""
    row = F.monotonically_increasing_id()
    return records.select("key", "value", F.lit(topic).alias("topic"), F.shiftright(row, 33).cast("int").alias("partition"),
                          (F.lit(batch_id << 33) + row.bitwiseAND(F.lit((1 << 33) - 1))).alias("offset"),
                          F.current_timestamp().alias("timestamp"))


def log_writer(fmt: str, path: str | None = None, topic: str = "file-changes", batch_id: int = 0, writer: str = "",
               accepts: Column | None = None, **options):
    """B1: a ``deliver`` that writes records to the log and returns those that arrived.
    ``kafka`` takes the connector's options; with ``acks=all`` and retries a write that
    fails in the end raises, the batch is replayed, and the table's key makes that
    harmless. ``parquet`` writes rows of Kafka's form to the folder ``path``, in a
    partition of the writer and batch, so a replay writes the same again. Records that
    do not meet the condition ``accepts`` are refused: neither sent nor returned."""
    if fmt not in ("kafka", "parquet"):
        raise ValueError(f"unknown log format {fmt!r}")

    def deliver(records: DataFrame) -> DataFrame:
        taken = records if accepts is None else records.where(F.coalesce(accepts, F.lit(False)))
        if fmt == "kafka":
            sure = {"kafka.acks": "all", "kafka.retries": "5", **options}
            taken.write.format("kafka").options(topic=topic, **sure).save()
        else:
            (log_rows(taken, topic, batch_id).withColumn("writer", F.lit(writer)).withColumn("log_batch", F.lit(batch_id))
             .write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("writer", "log_batch").parquet(path))
        return taken
    return deliver


def publish(events: DataFrame, writer=None) -> DataFrame:
    """B1: records to the log through ``writer`` (see ``log_writer``); returns them."""
    rec = publish_frame(events)
    return writer(materialize(rec, "outbox")) if writer is not None else rec


def snapshot_latest(snapshots: DataFrame) -> DataFrame:
    """Latest version per file. Versions are few rows per file."""
    latest = small_table(snapshots.groupBy("file_name").agg(F.max("version").alias("version")), "latest")
    return snapshots.join(latest, ["file_name", "version"], "left_semi")


def advance_snapshots(lines: DataFrame, path: str, run_id: str, batch_id: int) -> None:
    """Append line rows of new versions to the snapshot table, in the
    writing batch's own partition (a replay rewrites the same rows). Readers
    take the latest version per file (G4)."""
    (lines.select("file_name", "version", "line_number", "line")
     .withColumn("run_id", F.lit(run_id)).withColumn("batch_id", F.lit(batch_id).cast("long"))
     .write.mode("overwrite").option("partitionOverwriteMode", "dynamic")
     .partitionBy("run_id", "batch_id").parquet(path))


def sink_writer(target: str, targets: dict[str, dict]):
    """The writer of a named target, ``write(events, run_id, batch_id) -> counts``.
    ``targets`` maps names to a format and its options:

    * ``parquet``: ``path``; insert-if-absent into the change table there;
    * ``merge``: ``table``, in a catalog whose tables take row-level commands; the
      batch's first rows are the source of one MERGE (B5);
    * ``jdbc``: a Spark JDBC writer's options; the batch's first rows go to
      ``<dbtable>_staging``, and ``execute`` (a function of the statement) runs the
      MERGE in the database.

    An unknown name or format raises."""
    if target not in targets:
        raise ValueError(f"unknown target {target!r}; known: {sorted(targets)}")
    options = dict(targets[target])
    fmt = options.pop("format", "parquet")

    def rows(events: DataFrame) -> DataFrame:
        return materialize(to_table_rows(first_wins(events).select(*EVENT_COLUMNS)).withColumn(
            "loaded_at", F.current_timestamp()), "staged")

    def parquet(events: DataFrame, run_id: str, batch_id: int) -> dict:
        return insert_if_absent(events, options["path"], run_id, batch_id)

    def merge(events: DataFrame, run_id: str, batch_id: int) -> dict:
        staged = rows(events)
        staged.createOrReplaceTempView("linecdc_staged")
        events.sparkSession.sql(merge_sql(options["table"], "linecdc_staged"))
        return {"offered": staged.count()}

    def jdbc(events: DataFrame, run_id: str, batch_id: int) -> dict:
        opts = {k: v for k, v in options.items() if k not in ("execute", "dbtable")}
        staged, staging = rows(events), options["dbtable"] + "_staging"
        staged.write.mode("overwrite").format("jdbc").options(**opts, dbtable=staging).save()
        options["execute"](merge_sql(options["dbtable"], staging))
        return {"offered": staged.count()}

    writers = {"parquet": parquet, "merge": merge, "jdbc": jdbc}
    if fmt not in writers:
        raise ValueError(f"unknown sink format {fmt!r}; known: {sorted(writers)}")
    return writers[fmt]


def merge_sql(table: str, staging: str) -> str:
    """The statement that inserts the staged rows whose event_id is absent."""
    cols = [*EVENT_COLUMNS, "loaded_at"]
    return (f"MERGE INTO {table} AS t USING {staging} AS s ON t.event_id = s.event_id "
            f"WHEN NOT MATCHED THEN INSERT ({', '.join(cols)}) VALUES ({', '.join('s.' + c for c in cols)})")


def target_batch_writer(target: str, targets: dict[str, dict], dlq_path: str, run_id: str):
    """B9 as a ``foreachBatch`` body: decode, dead letters, and the target's writer."""
    write_to = sink_writer(target, targets)

    def write(batch_df: DataFrame, batch_id: int) -> None:
        valid, dlq = split(materialize(validate(decode(batch_df)), "decoded"))
        append_dlq(dlq, dlq_path, run_id, batch_id)
        if not valid.isEmpty():
            write_to(valid, run_id, batch_id)
    return write


def compact_snapshots(spark: SparkSession, path: str, out_path: str) -> DataFrame:
    """B6 compaction: keep only the latest version of each file (G4), written to
    ``out_path`` as one partition; readers then switch to ``out_path``."""
    snap = spark.read.parquet(path).drop("run_id", "batch_id")
    latest = snapshot_latest(snap)
    (latest.withColumn("run_id", F.lit("compacted")).withColumn("batch_id", F.lit(0).cast("long"))
     .write.mode("overwrite").partitionBy("run_id", "batch_id").parquet(out_path))
    return spark.read.parquet(out_path)
