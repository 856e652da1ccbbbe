"""Byte ranges with exact line rules, and new versions of a path as a stream."""

import io
import os
import time

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from linecdc.functions.text import base_name
from linecdc.sources import versions as V

TERMINATORS = ["\n", "\r", "\r\n", "\x0b", "\x0c", "\x1c", "\x1d", "\x1e", "\x85", " ", " "]
PIECES = [*TERMINATORS, "a", "bc", "é", "‧", "‪", "漢", "\U0001f600", "﻿", "\x1f", "Â", "€"]


def by_ranges(data: bytes, size: int, read: int = 1 << 20) -> list[str]:
    old, V.READ_BYTES = V.READ_BYTES, read
    try:
        return [x.decode() for at in range(0, max(1, len(data)), size)
                for x in V.lines_of_range(io.BytesIO(data), at, min(len(data), at + size))]
    finally:
        V.READ_BYTES = old


@settings(max_examples=400, deadline=None)
@given(st.lists(st.sampled_from(PIECES), max_size=30), st.integers(1, 9), st.sampled_from([1, 2, 3, 5, 1 << 20]))
def test_ranges_as_splitlines(parts, size, read):
    text = "".join(parts)
    assert by_ranges(text.encode(), size, read) == text.splitlines()


@pytest.mark.parametrize("terminator", TERMINATORS)
def test_terminator_at_every_offset_of_a_cut(terminator):
    for before in range(12):
        text = "x" * before + terminator + "y" * 9 + terminator
        assert by_ranges(text.encode(), 7, 2) == text.splitlines()


def test_a_line_longer_than_many_ranges():
    text = "a" * 5000 + " " + "b" * 3000
    assert by_ranges(text.encode(), 7, 16) == text.splitlines()


def read(spark, folder, **kw):
    lines, rejected = V.read_files(spark, str(folder), file_key=base_name, **kw)
    out = {}
    for r in lines.collect():
        out.setdefault(r["file_name"], []).append((r["line_number"], r["line"], r["n_lines"]))
    return {k: sorted(v) for k, v in out.items()}, {os.path.basename(r["file_path"]): r["reason"] for r in rejected.collect()}


def test_files_in_ranges_of_seven_bytes(spark, tmp_path):
    texts = {"mixed.txt": "one\r\ntwo three\rfour\x85\n\nsix é 漢\x1c", "plain.txt": "a\nb", "bom.txt": "﻿x\ny\n",
             "empty.txt": "", "long.txt": "z" * 500 + "\n" + "w" * 300, "more.TXT": "\n\n"}
    for name, t in texts.items():
        (tmp_path / name).write_bytes(t.encode())
    (tmp_path / "bad.txt").write_bytes(b"good line\nbad \xff line\ngood again " * 9)
    (tmp_path / "cut.txt").write_bytes("fine\n€".encode()[:-1])
    (tmp_path / "skip.bin").write_bytes(b"\xff\n")
    (tmp_path / "sub.txt").mkdir()
    got, rejected = read(spark, tmp_path, extensions=[".txt"], range_bytes=7)
    want = {k: [(i + 1, x, len(t.splitlines())) for i, x in enumerate(t.splitlines())] or [(None, None, 0)] for k, t in texts.items()}
    assert got == want
    assert rejected == {"bad.txt": "bad_utf8", "cut.txt": "bad_utf8"}


def test_no_files(spark, tmp_path):
    assert read(spark, tmp_path) == ({}, {})
    assert read(spark, tmp_path / "missing") == ({}, {})


def test_small_files_share_a_task_and_large_ones_are_cut():
    plan = V.plan_ranges([("a", 0, 3, 1), ("b", 0, 4, 1), ("c", 0, 25, 1), ("d", 0, 0, 1)], 10)
    assert [[(x.path, x.start, x.end) for x in p.pieces] for p in plan] == [
        [("a", 0, 3), ("b", 0, 4)], [("c", 0, 10)], [("c", 10, 20)], [("c", 20, 25), ("d", 0, 0)]]


def save(path, text):
    path.write_bytes(text if isinstance(text, bytes) else text.encode())
    time.sleep(0.01)


def trigger(spark, folder, root, **kw):
    V.start_version_stream(spark, str(folder), f"{root}/lines", f"{root}/ckpt", range_bytes=8, file_key=base_name,
                           available_now=True, **kw).awaitTermination()


def stored(spark, root):
    lines = V.stored_versions(spark, f"{root}/lines")
    out = {}
    for r in lines.join(V.saves(lines), ["file_name", "version"]).collect():
        out.setdefault((r["file_name"], r["save"]), []).append((r["line_number"], r["line"]))
    return {k: [x for _, x in sorted(v, key=lambda x: x[0] or 0)] for k, v in out.items()}


def test_saves_of_a_path_are_versions(spark, tmp_path):
    folder, root = tmp_path / "in", tmp_path / "out"
    folder.mkdir()
    save(folder / "a.txt", "one\ntwo\nthree\n")
    save(folder / "b.txt", "other")
    trigger(spark, folder, root)
    first = {("a.txt", 1): ["one", "two", "three"], ("b.txt", 1): ["other"]}
    assert stored(spark, root) == first
    trigger(spark, folder, root)  # a restart gives none
    assert stored(spark, root) == first
    save(folder / "a.txt", "one\nTWO\nthree\nfour\r\nfive")
    save(folder / "c.txt", "")
    os.remove(folder / "b.txt")  # raises nothing
    trigger(spark, folder, root)
    save(folder / "a.txt", b"\xff")
    trigger(spark, folder, root)
    assert stored(spark, root) == {**first, ("a.txt", 2): ["one", "TWO", "three", "four", "five"], ("c.txt", 1): [None]}
    bad = spark.read.parquet(f"{root}/lines_rejected").collect()
    assert [(os.path.basename(r["file_path"]), r["reason"]) for r in bad] == [("a.txt", "bad_utf8")]


def test_limited_triggers_and_same_clock(spark, tmp_path):
    folder, root = tmp_path / "in", tmp_path / "out"
    folder.mkdir()
    for i in range(5):
        save(folder / f"{i}.txt", f"line {i}")
    for _ in range(3):
        trigger(spark, folder, root, max_files=2)
    assert stored(spark, root) == {(f"{i}.txt", 1): [f"line {i}"] for i in range(5)}
    # A save that does not move the clock is a version of a higher number, as its length differs.
    was = os.stat(folder / "0.txt")
    save(folder / "0.txt", "line 0, longer")
    os.utime(folder / "0.txt", ns=(was.st_atime_ns, was.st_mtime_ns))
    trigger(spark, folder, root)
    assert stored(spark, root)[("0.txt", 2)] == ["line 0, longer"]


def test_listings_survive_a_crash_before_the_offset_is_logged(tmp_path):
    folder = tmp_path / "in"
    folder.mkdir()
    save(folder / "a.txt", "x")
    reader = lambda: V.VersionStreamReader({"path": str(folder), "state": str(tmp_path / "state")})
    one = reader().latestOffset()
    save(folder / "a.txt", "xy")
    save(folder / "b.txt", "z")
    two = reader().latestOffset()  # the first was never used
    pieces = lambda a, b: [(os.path.basename(x.path), x.length) for p in reader().partitions(a, b) for x in p.pieces]
    assert pieces({"listing": 0}, two) == [("a.txt", 2), ("b.txt", 1)]
    assert pieces(one, two) == [("a.txt", 2), ("b.txt", 1)] and pieces(two, two) == []
    assert reader().latestOffset() == two
    # What was overwritten before it was read is not passed off as the listed version.
    rows = [r for b in V.read_pieces([x for p in reader().partitions({"listing": 0}, one) for x in p.pieces]) for r in b.to_pylist()]
    assert [r["reason"] for r in rows] == ["changed"]
