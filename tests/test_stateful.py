"""Debounce on a timer, and versions held in keyed state."""

import random
import time
from datetime import datetime, timedelta


import pytest

from linecdc.operators.diff import diff_versions
from linecdc.streaming import stateful as S

NOTE = "file_name string, ts timestamp, version long"
ROW = "file_name string, version long, n_lines long, line_number int, line string"


def land(spark, rows, schema, folder, name):
    spark.createDataFrame(rows, schema).coalesce(1).write.parquet(f"{folder}/{name}")


def wait_for(check, seconds=90):
    end = time.time() + seconds
    while time.time() < end:
        if check():
            return True
        time.sleep(0.3)
    return False


def test_open_burst_fires_without_further_input(spark, tmp_path):
    folder = tmp_path / "notes"
    at = lambda s: datetime(2024, 1, 1) + timedelta(seconds=s)
    land(spark, [("a", at(0), 1), ("a", at(2), 3), ("a", at(2), 2), ("b", at(1), 7)], NOTE, folder, "one")
    src = spark.readStream.schema(NOTE).parquet(f"{folder}/*")
    q = (S.debounce_on_timer(src, 1000).writeStream.format("parquet").option("path", str(tmp_path / "out"))
         .option("checkpointLocation", str(tmp_path / "ckpt")).outputMode("append").trigger(processingTime="200 milliseconds").start())
    got = lambda: sorted((r["file_name"], r["session_start"], r["session_end"], r["n_saves"], r["version"])
                         for r in spark.read.schema(S.BURST).parquet(str(tmp_path / "out")).collect())
    try:
        first = [("a", at(0), at(2), 3, 3), ("b", at(1), at(1), 1, 7)]
        assert wait_for(lambda: len(got()) == 2) and got() == first
        land(spark, [("a", at(9), 5)], NOTE, folder, "two")  # the next burst is one of its own
        assert wait_for(lambda: len(got()) == 3) and got() == sorted([*first, ("a", at(9), at(9), 1, 5)])
    finally:
        q.stop()


def rows_of(versions):
    return [(f, v, len(ls), i + 1, x) for (f, v), ls in versions.items() for i, x in enumerate(ls)] + [
        (f, v, 0, None, None) for (f, v), ls in versions.items() if not ls]


def run(spark, tmp_path, batches):
    folder, events, dlq, ckpt = (str(tmp_path / x) for x in ("in", "events", "dlq", "ckpt"))
    progress = []
    for i, rows in enumerate(batches):
        land(spark, rows, ROW, folder, f"b{i}")
        src = spark.readStream.schema(ROW).parquet(f"{folder}/*")
        q = S.start_keyed_diff_stream(src, events, dlq, ckpt, available_now=True)
        q.awaitTermination()
        progress += [p for p in q.recentProgress if p["numInputRows"]]
    return events, dlq, progress


def changes(df):
    return sorted((r["file_name"], r["version"], r["event_type"], r["line_number"], r["old_value"], r["new_value"]) for r in df.collect())


def test_as_a_batch_diff_in_any_order(spark, tmp_path, monkeypatch):
    """Versions spread over batches, out of order, with lines delivered twice and empty versions."""
    monkeypatch.setattr(S, "CHUNK_LINES", 3)
    rng = random.Random(4)
    versions, text = {}, {"f": [f"f{i}" for i in range(9)], "g": ["x"] * 4, "h": []}
    for v in range(1, 5):
        for f in text:
            ls = [x for x in text[f] if rng.random() > 0.2]
            for _ in range(3):
                ls.insert(rng.randint(0, len(ls)), rng.choice(["x", "{", f"new {v}"]))
            text[f] = ls if (f, v) != ("h", 3) else []
            versions[f, v] = list(text[f])
    rows = rows_of(versions)
    rng.shuffle(rows)
    rows += rows[:10]  # delivered again
    events, dlq, _ = run(spark, tmp_path, [rows[:20], rows[20:40], rows[40:]])
    whole = spark.createDataFrame([(f, v, n, x) for f, v, _, n, x in rows_of(versions) if n],
                                  "file_name string, version long, line_number int, line string")
    # Empty versions are known to the stream; in a batch history of lines they are not.
    want = [c for c in changes(diff_versions(whole)) if c[0] != "h"]
    got = changes(spark.read.parquet(events))
    assert [c for c in got if c[0] != "h"] == want
    assert [c[1:4] for c in got if c[0] == "h" and c[1] == 3] == [(3, "DELETE", i + 1) for i in range(len(versions["h", 2]))]
    assert [c[1:4] for c in got if c[0] == "h" and c[1] == 4] == [(4, "INSERT", i + 1) for i in range(len(versions["h", 4]))]


def test_conflicts_go_to_the_dead_letters_and_late_rows_are_dropped(spark, tmp_path):
    first = rows_of({("f", 1): ["a", "b"]})
    second = [("f", 2, 2, 1, "a"), ("f", 2, 2, 1, "A"), ("f", 2, 2, 2, "c"), ("f", 1, 2, 1, "late")]
    events, dlq, _ = run(spark, tmp_path, [first, second])
    assert changes(spark.read.parquet(events)) == [("f", 2, "UPDATE", 2, "b", "c")]
    bad = spark.read.parquet(dlq).collect()
    assert [(r["reason"], bytes(r["value"]).decode()) for r in bad] == [
        ("conflicting_line", '{"version":2,"line_number":1,"line":"A"}')]


def test_state_stays_flat(spark, tmp_path):
    folder, out = str(tmp_path / "in"), str(tmp_path / "out")
    for v in range(1, 21):
        land(spark, rows_of({("f", v): [f"line {i} {v if i == v else 0}" for i in range(200)]}), ROW, folder, f"b{v:02d}")
    src = spark.readStream.schema(ROW).option("maxFilesPerTrigger", 1).parquet(f"{folder}/*")
    q = (S.released_versions(src).writeStream.format("parquet").option("path", out)
         .option("checkpointLocation", str(tmp_path / "ckpt")).trigger(availableNow=True).start())
    q.awaitTermination()
    state = [p["stateOperators"][0]["numRowsTotal"] for p in q.recentProgress if p["numInputRows"]]
    assert len(state) == 20 and max(state) <= state[0]
    assert spark.read.parquet(out).where("side = 'new'").count() == 20 * 200


@pytest.mark.parametrize("rows", [[], [("f", 1, 0, None, None)]])
def test_nothing_to_compare(spark, tmp_path, rows):
    run(spark, tmp_path, [rows])
    assert not (tmp_path / "events").exists()
