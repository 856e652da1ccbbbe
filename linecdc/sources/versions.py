"""Text files as line rows, in batch and as a stream (A1, A3).

``TextVersions`` is a Spark data source. A file is read in byte ranges, so a file of any
size is read in parallel; small files and small ranges share a task.

*Lines.* A line belongs to the range in which it starts. A range looks three bytes back,
as many as the longest terminator has, to learn whether its first byte starts a line,
and reads on behind its end until its last line is whole. The terminators are those of
``str.splitlines``; in UTF-8 none of them can be part of another character. Every byte
lies in one line or terminator, so a version is valid UTF-8 if all its lines are. An
empty file has one row without a line, so that it is known as a version.

*Versions.* A version is a path with a modification time and a length; its number is
the time in microseconds, raised where needed so that it grows with every save of the
path. The stream's offset is the number of a listing in the ``state`` folder
(path -> time, length, version). A trigger compares the folder with the last listing,
so a path that was saved again is read again, and each version once; a restart finds
the listings of its offsets. Two saves between two triggers are one version, with the
last content. A file that changes while it is read gives rows with the reason
``changed``; the next trigger reads it anew.

Files are opened through Arrow's file systems (local or mounted folders, hdfs, s3, gs,
abfs), by executors and by the driver's listing.
"""

from __future__ import annotations

import json
import re
from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import pyarrow as pa
from pyarrow import fs as pafs
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceStreamReader, InputPartition
from pyspark.sql.streaming import StreamingQuery

from linecdc.operators.sink import _exists
from linecdc.session import materialize, ship_package

RANGE_BYTES = 64 << 20
TASK_BYTES = 4 << 20  # ranges smaller than this share a task
READ_BYTES = 1 << 20
TAIL_BYTES = 4096  # read at first behind a range's end, for its last line
BATCH_LINES = 8192
KEPT_LISTINGS = 16
BROADCAST_ROWS = 200_000  # ranges or rejected versions (a path and a few numbers each) up to which they go to the lines

# Fixed value: the terminators of str.splitlines, as UTF-8.
TERMINATOR = re.compile(rb"\r\n|[\n\r\x0b\x0c\x1c\x1d\x1e]|\xc2\x85|\xe2\x80[\xa8\xa9]")
LONGEST = 3
# What may be the beginning of a terminator when a buffer ends with it.
UNFINISHED = re.compile(rb"(\r|\xc2|\xe2|\xe2\x80)\Z")

SCHEMA = ("file_path string, version long, detected_at timestamp, length long, range_start long, "
          "n long, line string, reason string")
ARROW = pa.schema([("file_path", pa.string()), ("version", pa.int64()), ("detected_at", pa.timestamp("us", "UTC")),
                   ("length", pa.int64()), ("range_start", pa.int64()), ("n", pa.int64()), ("line", pa.string()),
                   ("reason", pa.string())])


def filesystem(path: str) -> tuple[pafs.FileSystem, str]:
    """The file system of a path or URI, and the path in it."""
    if "://" in path or path.startswith("file:"):
        return pafs.FileSystem.from_uri(re.sub(r"^file:/+", "file:///", path))
    return pafs.LocalFileSystem(), path


def lines_of_range(f, start: int, end: int) -> Iterator[bytes]:
    """The lines that start in bytes ``start`` to ``end`` of an open file, without terminators."""
    at = max(0, start - LONGEST)
    f.seek(at)
    buffer, begin, last = b"", at, False  # buffer holds the file from byte ``begin``
    line = 0 if start == 0 else None  # where the present line starts, if it starts in this range
    seek = at  # up to here everything has been searched
    while True:
        # A terminator that the buffer may cut is left for the next round.
        for m in TERMINATOR.finditer(buffer, seek - begin):
            if not last and m.end() == len(buffer) and UNFINISHED.search(buffer):
                break
            stop, nxt = begin + m.start(), begin + m.end()
            if line is not None:
                yield buffer[line - begin:stop - begin]
            seek, line = nxt, nxt if start <= nxt < end else None
            if nxt >= end:
                return
        if last:
            if line is not None and line < begin + len(buffer):
                yield buffer[line - begin:]
            return
        cut = UNFINISHED.search(buffer)
        seek = max(seek, begin + (cut.start() if cut else len(buffer)))
        if line is None and seek >= end:
            return
        keep = seek if line is None else line
        buffer, begin = buffer[keep - begin:], keep
        ahead = min(READ_BYTES, max(0, end - begin - len(buffer)) + TAIL_BYTES)
        more = f.read(max(ahead, len(buffer)))  # a long line doubles what is read, so copies stay linear
        last = not more
        buffer += more


@dataclass
class Piece:
    path: str
    mtime: int  # microseconds
    length: int
    version: int
    start: int
    end: int


class Ranges(InputPartition):
    def __init__(self, pieces: list[Piece]):
        self.pieces = pieces


def plan_ranges(files: Sequence[tuple[str, int, int, int]], size: int, task: int = 0) -> list[Ranges]:
    """(path, mtime, length, version) as ranges of ``size`` bytes, in partitions of about
    ``task`` bytes (one range at least): files cut, small ones together."""
    out, part, held = [], [], 0
    for path, mtime, length, version in files:
        for start in range(0, max(1, length), size):
            end = min(length, start + size)
            if part and held + end - start > max(size, task):
                out.append(Ranges(part))
                part, held = [], 0
            part.append(Piece(path, mtime, length, version, start, end))
            held += end - start
    return out + [Ranges(part)] if part else out


def _micros(info: pafs.FileInfo) -> int:
    return (info.mtime_ns or 0) // 1000


def list_files(path: str, extensions: str | None = None) -> dict[str, tuple[int, int]]:
    """path -> (modification time, length) of the files in a folder (not below it), or of one file."""
    path = path.rstrip("/")
    fs, root = filesystem(path)
    prefix = path[:len(path) - len(root)] if path.endswith(root) else ""
    info = fs.get_file_info(root)
    if info.type == pafs.FileType.NotFound:
        return {}
    found = [info] if info.type == pafs.FileType.File else fs.get_file_info(pafs.FileSelector(root, recursive=False))
    wanted = [e.strip().lower() for e in (extensions or "").split(",") if e.strip()]
    keep = lambda x: x.type == pafs.FileType.File and (
        not wanted or ("." + x.extension.lower() if x.extension else "") in wanted)
    return {prefix + x.path: (_micros(x), x.size) for x in found if keep(x)}


def read_pieces(pieces: list[Piece]) -> Iterator[pa.RecordBatch]:
    for p in pieces:
        head = (p.path, p.version, p.mtime, p.length, p.start)
        fs, inner = filesystem(p.path)

        def same() -> bool:
            info = fs.get_file_info(inner)
            return info.type == pafs.FileType.File and (_micros(info), info.size) == (p.mtime, p.length)

        def rows(found: list[tuple]) -> pa.RecordBatch:
            cols = [pa.array([h] * len(found), t) for h, t in zip(head, ARROW.types)]
            return pa.RecordBatch.from_arrays([*cols, *(pa.array(c, t) for c, t in zip(zip(*found), ARROW.types[5:]))], schema=ARROW)

        if not same():
            yield rows([(None, None, "changed")])
            continue
        found, n = [], 0
        with fs.open_input_file(inner) as f:
            for raw in lines_of_range(f, p.start, p.end):
                try:
                    found.append((n, raw.decode("utf-8"), None))
                except UnicodeDecodeError:
                    found.append((n, None, "bad_utf8"))
                n += 1
                if len(found) == BATCH_LINES:
                    yield rows(found)
                    found = []
        if not same():
            found.append((None, None, "changed"))
        if p.length == 0:
            found.append((None, None, None))
        if found:
            yield rows(found)


class VersionReader(DataSourceReader):
    def __init__(self, options: dict):
        self.options = options

    def partitions(self) -> list[InputPartition]:
        files = list_files(self.options["path"], self.options.get("extensions"))
        return plan_ranges([(p, *x, x[0]) for p, x in sorted(files.items())], int(self.options.get("rangebytes", RANGE_BYTES)), TASK_BYTES)

    def read(self, partition: Ranges | None) -> Iterator[pa.RecordBatch]:
        return read_pieces(partition.pieces if partition else [])


class VersionStreamReader(DataSourceStreamReader):
    def __init__(self, options: dict):
        self.options = options
        self.fs, self.root = filesystem(options["state"])

    def _name(self, n: int) -> str:
        return f"{self.root.rstrip('/')}/listing-{n:012d}.json"

    def _numbers(self) -> list[int]:
        found = self.fs.get_file_info(pafs.FileSelector(self.root, allow_not_found=True))
        return sorted(int(m[1]) for x in found if (m := re.fullmatch(r"listing-(\d+)\.json", x.base_name)))

    def _load(self, n: int) -> dict[str, list[int]]:
        if n == 0:
            return {}
        with self.fs.open_input_stream(self._name(n)) as f:
            return json.loads(f.read())

    def _store(self, n: int, listing: dict[str, list[int]]) -> None:
        self.fs.create_dir(self.root)
        whole = self._name(n)
        with self.fs.open_output_stream(whole + ".new") as f:
            f.write(json.dumps(listing).encode())
        self.fs.move(whole + ".new", whole)

    def initialOffset(self) -> dict:
        return {"listing": 0}

    def latestOffset(self) -> dict:
        last = max(self._numbers(), default=0)
        known = self._load(last)
        now = list_files(self.options["path"], self.options.get("extensions"))
        new = sorted((x, p) for p, x in now.items() if p not in known or tuple(known[p][:2]) != x)
        new = new[:int(self.options.get("maxfilespertrigger", len(new) or 1))]
        if not new:
            return {"listing": last}
        listing = {p: x for p, x in known.items() if p in now}  # a deleted path raises nothing
        for (mtime, length), p in new:
            listing[p] = [mtime, length, max(mtime, known[p][2] + 1 if p in known else 0)]
        self._store(last + 1, listing)
        return {"listing": last + 1}

    def partitions(self, start: dict, end: dict) -> list[InputPartition]:
        if start["listing"] == end["listing"]:
            return []
        before, after = self._load(start["listing"]), self._load(end["listing"])
        new = [(p, x[0], x[1], x[2]) for p, x in sorted(after.items()) if before.get(p) != x]
        return plan_ranges(new, int(self.options.get("rangebytes", RANGE_BYTES)), TASK_BYTES)

    def read(self, partition: Ranges) -> Iterator[pa.RecordBatch]:
        return read_pieces(partition.pieces)

    def commit(self, end: dict) -> None:
        for n in self._numbers():
            if n < end["listing"] - KEPT_LISTINGS:
                self.fs.delete_file(self._name(n))


class TextVersions(DataSource):
    """Options: ``path`` (a folder or a file), ``extensions`` (comma-separated, with dots),
    ``rangeBytes``; for streams also ``state`` (a folder of the query's own, shared) and
    ``maxFilesPerTrigger``."""

    @classmethod
    def name(cls) -> str:
        return "text_versions"

    def schema(self) -> str:
        return SCHEMA

    def _options(self) -> dict:
        return {k.lower(): v for k, v in self.options.items()}

    def reader(self, schema) -> DataSourceReader:
        return VersionReader(self._options())

    def streamReader(self, schema) -> DataSourceStreamReader:
        return VersionStreamReader(self._options())


def _with_options(r, path: str, extensions: Sequence[str] | None, **options):
    r = r.format(TextVersions.name()).option("path", path)
    options["extensions"] = ",".join(extensions) if extensions else None
    for k, v in options.items():
        r = r if v is None else r.option(k, str(v))
    return r.load()


def _register(spark: SparkSession) -> None:
    ship_package(spark)
    spark.dataSource.register(TextVersions)


def number_lines(raw: DataFrame, file_key=None) -> tuple[DataFrame, DataFrame]:
    """(lines, rejected) of raw rows, which should be a stored table: they are read three
    times. ``lines(file_name, file_path, version, detected_at, n_lines, line_number, line)``;
    an empty version has one row with a null line number. ``rejected(file_path, version,
    reason)``: versions with a line that is no UTF-8, or that changed while they were read.

    Numbers are a range's first number plus the place in the range; the sum over the
    ranges before runs over a table of one row a range."""
    key = ["file_path", "version"]
    rejected = raw.where(F.col("reason").isNotNull()).groupBy(*key).agg(F.min("reason").alias("reason"))
    counts = raw.where(F.col("n").isNotNull()).groupBy(*key, "range_start").agg(F.count("*").alias("own"))
    counts = materialize(counts, "range-counts")
    before = Window.partitionBy(*key).orderBy("range_start").rowsBetween(Window.unboundedPreceding, -1)
    ranges = counts.select(*key, "range_start", F.coalesce(F.sum("own").over(before), F.lit(0)).alias("first"),
                           F.sum("own").over(Window.partitionBy(*key)).alias("n_lines"))
    small = lambda df, n: F.broadcast(df) if n <= BROADCAST_ROWS else df
    name = (file_key or (lambda path: path))(F.col("file_path"))
    bad = materialize(rejected, "rejected")
    lines = raw.where(F.col("reason").isNull()).join(small(bad, bad.count()), key, "left_anti")
    lines = lines.join(small(ranges, counts.count()), [*key, "range_start"], "left").select(
        name.alias("file_name"), *key, "detected_at", F.coalesce("n_lines", F.lit(0)).cast("long").alias("n_lines"),
        (F.col("first") + F.col("n") + 1).alias("line_number"), "line")
    return lines, bad


def read_files(spark: SparkSession, path: str, extensions: Sequence[str] | None = None,
               range_bytes: int = RANGE_BYTES, file_key=None) -> tuple[DataFrame, DataFrame]:
    """A1: every file of a folder, of any size, as (lines, rejected); see ``number_lines``."""
    _register(spark)
    return number_lines(materialize(_with_options(spark.read, path, extensions, rangeBytes=range_bytes), "file-lines"), file_key)


def version_source(spark: SparkSession, path: str, state: str, extensions: Sequence[str] | None = None,
                   range_bytes: int = RANGE_BYTES, max_files: int | None = None) -> DataFrame:
    """A3: raw rows of every new version of the files in a folder, as a stream."""
    _register(spark)
    return _with_options(spark.readStream, path, extensions, rangeBytes=range_bytes, state=state, maxFilesPerTrigger=max_files)


def version_batch_writer(lines_path: str, run_id: str, file_key=None, then=None):
    """``foreachBatch`` body: numbered lines of the batch's versions to ``lines_path`` and
    rejected versions to ``<lines_path>_rejected``, in the batch's own partition, so a
    replay writes the same again; then ``then(lines, batch_id)``, if given."""
    def write(batch_df: DataFrame, batch_id: int) -> None:
        raw = materialize(batch_df, "file-lines")
        lines, rejected = number_lines(raw, file_key)
        own = lambda df: (df.withColumn("run_id", F.lit(run_id)).withColumn("batch_id", F.lit(batch_id).cast("long"))
                          .write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("run_id", "batch_id"))
        own(lines).parquet(lines_path)
        own(rejected).parquet(lines_path.rstrip("/") + "_rejected")
        if then is not None:
            stored = batch_df.sparkSession.read.parquet(lines_path)
            then(stored.where((F.col("run_id") == run_id) & (F.col("batch_id") == batch_id)).drop("run_id", "batch_id"), batch_id)
    return write


def start_version_stream(spark: SparkSession, path: str, lines_path: str, checkpoint: str,
                         extensions: Sequence[str] | None = None, range_bytes: int = RANGE_BYTES,
                         max_files: int | None = None, file_key=None, then=None, available_now: bool = False,
                         processing_time: str = "10 seconds") -> StreamingQuery:
    """A3: the folder's new versions as lines, trigger by trigger; listings lie in the
    checkpoint folder."""
    from linecdc.streaming.pipelines import run_id_for

    raw = version_source(spark, path, f"{checkpoint.rstrip('/')}/listings", extensions, range_bytes, max_files)
    w = raw.writeStream.foreachBatch(version_batch_writer(lines_path, run_id_for(spark, checkpoint), file_key, then)).option(
        "checkpointLocation", checkpoint)
    return (w.trigger(availableNow=True) if available_now else w.trigger(processingTime=processing_time)).start()


def stored_versions(spark: SparkSession, lines_path: str) -> DataFrame:
    """The lines that a version stream has stored so far."""
    if not _exists(spark, lines_path):
        raise FileNotFoundError(lines_path)
    return spark.read.parquet(lines_path).drop("run_id", "batch_id")


def saves(lines: DataFrame) -> DataFrame:
    """(file_name, version, save): 1 for a file's first version, 2 for its second, ..."""
    seen = lines.select("file_name", "version").distinct()
    return seen.withColumn("save", F.row_number().over(Window.partitionBy("file_name").orderBy("version")))
