"""File source: versions as line rows, newline styles, bad UTF-8, extension filter."""

import os
import tempfile

import pytest

from linecdc.functions.text import base_name
from linecdc.operators.diff import diff_lines
from linecdc.sources.files import read_versions


def test_read_and_diff_two_saves(spark):
    d1, d2 = tempfile.mkdtemp(prefix="linecdc-t1-"), tempfile.mkdtemp(prefix="linecdc-t2-")
    with open(os.path.join(d1, "sample.txt"), "w", newline="") as f:
        f.write("host = alpha\r\nport = 7070\r\n")
    with open(os.path.join(d1, "skip.bin"), "wb") as f:
        f.write(b"\xff\xfe")
    with open(os.path.join(d2, "sample.txt"), "w", newline="") as f:
        f.write("host = beta\nport = 7070")
    with open(os.path.join(d2, "bad.txt"), "wb") as f:
        f.write(b"ok\n\xff\n")
    old, rej1 = read_versions(spark, d1, extensions=[".txt"], file_key=base_name)
    new, rej2 = read_versions(spark, d2, extensions=[".txt", ".csv"], file_key=base_name)
    assert [r.line for r in old.orderBy("line_number").collect()] == [
        "host = alpha", "port = 7070"]
    assert rej1.count() == 0 and [r.reason for r in rej2.collect()] == ["bad_utf8"]
    o = old.select("file_name", "line_number", "line").withColumn("version", F_lit2())
    n = new.select("file_name", "line_number", "line").withColumn("version", F_lit2())
    ev = diff_lines(o, n).collect()
    assert [(r.event_type, r.line_number, r.new_value) for r in ev] == [("UPDATE", 1, "host = beta")]


def F_lit2():
    from pyspark.sql import functions as F
    return F.lit(2).cast("long")


def test_equal_base_names_are_different_files(spark, tmp_path):
    from linecdc.operators.diff import diff_versions

    for d, text in (("x", "one\ntwo\n"), ("y", "other\nlines\nhere\n")):
        (tmp_path / d).mkdir()
        (tmp_path / d / "part-0.txt").write_text(text)
    lines, _ = read_versions(spark, f"{tmp_path}/*")
    assert lines.select("file_name").distinct().count() == 2
    assert diff_versions(lines.select("file_name", "version", "line_number", "line")).count() == 0


def test_scratch_needs_a_shared_folder_off_local_mode(spark, monkeypatch):
    from types import SimpleNamespace

    from linecdc import session

    sc = SimpleNamespace(getCheckpointDir=lambda: None, getConf=lambda: SimpleNamespace(get=lambda *a: None), master="yarn")
    with pytest.raises(ValueError):
        session.ensure_checkpoint_dir(SimpleNamespace(sparkContext=sc))
