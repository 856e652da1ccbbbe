"""Keyed state: debounce on a timer and versions held until they are whole (K5, K6), as
``transformWithState`` processors, and the ids seen so far (K7), as an aggregation; all
over the RocksDB state store.

Rows are combined or packed before they are grouped, so a file that gets most of a
batch's rows sends few and large ones; state lies on disk, in chunks of lines, and a
task holds one chunk.
"""

from __future__ import annotations

import json
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle, StreamingQuery

from linecdc.operators.codec import LOG_COLUMNS, PAYLOAD, decode, validate
from linecdc.operators.diff import diff_lines
from linecdc.operators.sink import append_dlq, insert_if_absent, write_partition
from linecdc.schema import EVENT_COLUMNS
from linecdc.session import materialize, ship_package, small_table

ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def use_state_store(spark: SparkSession) -> None:
    """Timers and map state need the RocksDB provider; checkpoints keep their own."""
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", ROCKSDB)
    ship_package(spark)


# ---------------------------------------------------------------- K5

BURST = "file_name string, session_start timestamp, session_end timestamp, n_saves long, version long"


def _combine(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """One row per file of a partition's batch: count, first and last time, last version."""
    for pdf in frames:
        if len(pdf):
            last = pdf.sort_values(["ts", "version"]).groupby("file_name", dropna=False, sort=False)
            yield last.agg(session_start=("ts", "min"), session_end=("ts", "max"), n_saves=("ts", "size"),
                           version=("version", "last")).reset_index()


class Debouncer(StatefulProcessor):
    """The open burst of a file, and the timer that ends it. Every notification puts the
    timer off to ``gap_ms`` after now; when it runs out, the burst is emitted with the
    version of its last notification (by time, then version), and forgotten."""

    def __init__(self, gap_ms: int):
        self.gap_ms = gap_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.burst = handle.getValueState("burst", "first timestamp, last timestamp, n long, version long")

    def handleInputRows(self, key, rows, timerValues):
        first, last, n, version = self.burst.get() if self.burst.exists() else (None, None, 0, None)
        for pdf in rows:
            for r in pdf.itertuples(index=False):
                first = r.session_start if first is None else min(first, r.session_start)
                if last is None or (r.session_end, r.version) > (last, version):
                    last, version = r.session_end, r.version
                n += int(r.n_saves)
        self.burst.update((first, last, int(n), int(version)))
        for t in list(self.handle.listTimers()):
            self.handle.deleteTimer(t)
        self.handle.registerTimer(timerValues.getCurrentProcessingTimeInMs() + self.gap_ms)
        return iter(())

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo):
        first, last, n, version = self.burst.get()
        self.burst.clear()
        yield pd.DataFrame({"file_name": [key[0]], "session_start": [first], "session_end": [last],
                            "n_saves": [n], "version": [version]})

    def close(self) -> None:
        pass


def debounce_on_timer(notes: DataFrame, gap_ms: int = 500) -> DataFrame:
    """K5, trailing edge: one row per burst of (file_name, ts, version), emitted once
    ``gap_ms`` of processing time have passed without a notification of the file. No
    later event is needed; run it with a processing-time trigger, whose triggers let
    timers run out."""
    use_state_store(notes.sparkSession)
    few = notes.select("file_name", F.col("ts").cast("timestamp").alias("ts"), F.col("version").cast("long").alias("version"))
    few = few.mapInPandas(_combine, BURST)
    return few.groupBy("file_name").transformWithStateInPandas(
        statefulProcessor=Debouncer(gap_ms), outputStructType=BURST, outputMode="Append", timeMode="ProcessingTime")


# ---------------------------------------------------------------- K6

CHUNK_LINES = 1024
# Lines that a packing task holds.
PACK_LINES = 1 << 17
# Chunks that are handed on together.
CHUNKS_OUT = 16
PACKED = "file_name string, version long, n_lines long, chunk long, n long, lines string"
RELEASED = "file_name string, version long, side string, lines string"


def _packed(held: dict[tuple, list]) -> pd.DataFrame:
    out = []
    for key, own in held.items():
        lines = dict(own)
        if len(lines) < len(own) and len(lines) < len(set(own)):  # a number with two different lines
            out.append((*key, -1, json.dumps(own)))
        else:
            out.append((*key, len(lines), json.dumps(lines)))
    return pd.DataFrame(out, columns=["file_name", "version", "n_lines", "chunk", "n", "lines"])


def _pack(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Line rows as one row per file, version and chunk: {line_number: line} as JSON, and
    how many; [[line_number, line], ...] and -1 if a number has two different lines."""
    held, n = {}, 0
    for pdf in frames:
        cols = (pdf[c].tolist() for c in ("file_name", "version", "n_lines", "chunk", "line_number", "line"))
        for name, version, n_lines, chunk, number, line in zip(*cols):
            own = held.setdefault((name, version, n_lines, chunk), [])
            if not pd.isna(number):
                own.append((int(number), line))
        n += len(pdf)
        if n >= PACK_LINES:
            yield _packed(held)
            held, n = {}, 0
    if held:
        yield _packed(held)


class VersionKeeper(StatefulProcessor):
    """State of a file: the lines of its last released version, the lines of versions
    that are not whole or wait for an earlier one, and how many lines each has so far.

    A line that is delivered again changes nothing. A line that differs from the one
    stored under its number is emitted as ``conflict``; the first stays. Rows of a
    version that was released, or passed over, are late and dropped. Chunks are taken,
    kept and emitted as they are packed; only one that comes in parts is opened."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.known = handle.getValueState("known", "version long, chunks string")
        self.waiting = handle.getMapState("waiting", "version long", "n_lines long, have long, chunks string")
        self.pending = handle.getMapState("pending", "version long, chunk long", "lines string")
        self.current = handle.getMapState("current", "chunk long", "lines string")

    def handleInputRows(self, key, rows, timerValues):
        out = []
        for row in self._rows(key[0], rows):
            out.append(row)
            if len(out) == CHUNKS_OUT:
                yield self._frame(out)
                out = []
        if out:
            yield self._frame(out)

    @staticmethod
    def _frame(rows: list[tuple]) -> pd.DataFrame:
        return pd.DataFrame(rows, columns=["file_name", "version", "side", "lines"])

    def _rows(self, name: str, rows) -> Iterator[tuple]:
        known, chunks = self.known.get() if self.known.exists() else (None, "[]")
        waiting = {k[0]: (v[0], v[1], dict.fromkeys(json.loads(v[2]))) for k, v in self.waiting.iterator()}
        touched = set()
        for pdf in rows:
            for r in pdf.itertuples(index=False):
                if known is None or r.version > known:
                    version, chunk = int(r.version), int(r.chunk)
                    _, have, own = waiting.get(version, (0, 0, {}))
                    if r.n:
                        added, conflicts = self._store((version, chunk), int(r.n), r.lines)
                        have += added
                        own[chunk] = None
                        yield from ((name, version, "conflict", json.dumps({n: x})) for n, x in conflicts)
                    waiting[version] = (int(r.n_lines), have, own)
                    touched.add(version)
        # Release from the earliest on, as long as it is whole.
        for version in sorted(waiting):
            n_lines, have, new = waiting[version]
            if have != n_lines:
                break
            if known is not None:
                for c in json.loads(chunks) or [None]:
                    yield name, version, "old", self.current.getValue((c,))[0] if c is not None else "{}"
            for c in set(json.loads(chunks)) - set(new):
                self.current.removeKey((c,))
            for c in new:
                lines = self.pending.getValue((version, c))[0]
                self.current.updateValue((c,), (lines,))
                self.pending.removeKey((version, c))
                yield name, version, "new", lines
            if not new:
                yield name, version, "new", "{}"
            if self.waiting.containsKey((version,)):
                self.waiting.removeKey((version,))
            touched.discard(version)
            known, chunks = version, json.dumps([*new])
            self.known.update((known, chunks))
        for version in touched:
            n_lines, have, own = waiting[version]
            self.waiting.updateValue((version,), (n_lines, have, json.dumps([*own])))

    def _store(self, at: tuple[int, int], n: int, lines: str) -> tuple[int, list[tuple]]:
        """Puts a packed chunk to those waiting: how many lines are new, and which conflict."""
        there = self.pending.containsKey(at)
        if n > 0 and not there:
            self.pending.updateValue(at, (lines,))
            return n, []
        held, conflicts = json.loads(self.pending.getValue(at)[0]) if there else {}, []
        before, more = len(held), json.loads(lines)
        for number, line in more.items() if n > 0 else more:
            if held.setdefault(str(number), line) != line:
                conflicts.append((number, line))
        if len(held) > before:
            self.pending.updateValue(at, (json.dumps(held),))
        return len(held) - before, conflicts

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo):
        return iter(())

    def close(self) -> None:
        pass


def released_versions(rows: DataFrame) -> DataFrame:
    """K6: (file_name, version, n_lines, line_number, line) of versions that come in any
    order and number of batches -> (file_name, version, side, line_number, line) of each
    version once it is whole and all earlier ones are released: its lines (``new``) and,
    but for a file's first version, those of the version before (``old``)."""
    use_state_store(rows.sparkSession)
    whole = F.col("file_name").isNotNull() & F.col("version").isNotNull() & F.col("n_lines").isNotNull()
    chunk = F.floor((F.coalesce("line_number", F.lit(0)) - 1) / CHUNK_LINES).cast("long")
    # A chunk's lines meet in one task before they are packed, in whatever order they come.
    packed = (rows.where(whole).select("file_name", F.col("version").cast("long").alias("version"), F.col("n_lines").cast("long").alias("n_lines"),
                                       chunk.alias("chunk"), "line_number", "line")
              .repartition("file_name", "version", "chunk").mapInPandas(_pack, PACKED))
    kept = packed.groupBy("file_name").transformWithStateInPandas(
        statefulProcessor=VersionKeeper(), outputStructType=RELEASED, outputMode="Append", timeMode="None")
    lines = F.from_json("lines", "map<string,string>", {"maxStringLen": str((1 << 31) - 1)})
    # A version without lines has one row without a number.
    return kept.select("file_name", "version", "side", F.explode_outer(lines).alias("line_number", "line")).withColumn(
        "line_number", F.col("line_number").cast("int"))


def released_batch_writer(events_path: str, dlq_path: str, run_id: str, detected_at_fn=None):
    """``foreachBatch`` body: the events of the batch's released versions, once each;
    conflicting lines to the dead letters. No other table is read."""
    def write(batch_df: DataFrame, batch_id: int) -> None:
        rows = materialize(batch_df, "released")
        if rows.isEmpty():
            return
        bad = rows.where("side = 'conflict'").select(
            F.encode("file_name", "UTF-8").alias("key"), F.encode(F.to_json(F.struct("version", "line_number", "line")), "UTF-8").alias("value"),
            F.lit("conflicting_line").alias("reason"))
        append_dlq(bad, dlq_path, run_id, batch_id)
        paired = small_table(rows.where("side = 'old'").select("file_name", "version").distinct(), "paired")
        side = lambda s: rows.where((F.col("side") == s) & F.col("line_number").isNotNull()).join(
            paired, ["file_name", "version"], "left_semi").drop("side")
        if paired.isEmpty():
            return
        events = diff_lines(side("old"), side("new"), detected_at_fn(paired) if detected_at_fn else None)
        insert_if_absent(events, events_path, run_id, batch_id, order=("version", "change_seq"))
    return write


def start_keyed_diff_stream(lines: DataFrame, events_path: str, dlq_path: str, checkpoint: str, detected_at_fn=None,
                            available_now: bool = False, processing_time: str = "10 seconds") -> StreamingQuery:
    from linecdc.streaming.pipelines import run_id_for

    w = released_versions(lines).writeStream.foreachBatch(released_batch_writer(
        events_path, dlq_path, run_id_for(lines.sparkSession, checkpoint), detected_at_fn)).option("checkpointLocation", checkpoint)
    return (w.trigger(availableNow=True) if available_now else w.trigger(processingTime=processing_time)).start()


# ---------------------------------------------------------------- K7

def first_seen(records: DataFrame) -> DataFrame:
    """Per batch, the records whose id no earlier batch had, over all time: event
    columns, log columns, ``key``, ``value`` and ``reason`` (null if valid; a dead letter's
    id is its log position). Of several in one batch the least position counts.

    The state holds an id's first row and the times of its first and last batch. An id is
    new if both are this batch's, so a batch asks the state for its own ids, and the
    change table is never read, however long it has grown."""
    tagged = validate(decode(records))
    columns = [F.col(c) for c in (*EVENT_COLUMNS, *(c for c in (*PAYLOAD, *LOG_COLUMNS) if c in tagged.columns), "reason")]
    place = F.struct(*[F.coalesce(F.col(c).cast("long"), F.lit((1 << 63) - 1)) for c in ("partition", "offset")])
    key = F.when(F.col("reason").isNull(), F.concat(F.lit("id:"), "event_id")).otherwise(
        F.concat_ws(":", F.lit("at"), F.coalesce("topic", F.lit("")), F.col("partition").cast("string"), F.col("offset").cast("string")))
    rows = tagged.select(key.alias("_id"), F.struct(*columns).alias("row"), place.alias("place"), F.current_timestamp().alias("now"))
    seen = rows.groupBy("_id").agg(F.min_by("row", "place").alias("first"), F.min("now").alias("since"), F.max("now").alias("last"))
    return seen.where(F.col("since") == F.col("last")).select("first.*")


def start_dedup_stream(records: DataFrame, table_path: str, dlq_path: str, checkpoint: str, available_now: bool = False,
                       processing_time: str = "10 seconds") -> StreamingQuery:
    """K4/K7: the log -> change table stream without a look at the table: what is new is
    known from state. The table must be this query's own (its state knows no other
    writer's ids). A replayed batch writes its partition again."""
    from linecdc.streaming.pipelines import run_id_for

    use_state_store(records.sparkSession)
    run_id = run_id_for(records.sparkSession, checkpoint)

    def write(batch_df: DataFrame, batch_id: int) -> None:
        new = materialize(batch_df, "first-seen")
        append_dlq(new.where(F.col("reason").isNotNull()), dlq_path, run_id, batch_id)
        rows = new.where(F.col("reason").isNull())
        if not rows.isEmpty():
            write_partition(rows.select(*EVENT_COLUMNS), table_path, run_id, batch_id)

    w = first_seen(records).writeStream.outputMode("update").foreachBatch(write).option("checkpointLocation", checkpoint)
    return (w.trigger(availableNow=True) if available_now else w.trigger(processingTime=processing_time)).start()
