"""Versions rebuilt from a keyframe and composed change sets."""

import random

import pytest

from linecdc.operators import deltas as D
from linecdc.operators.diff import diff_versions
from linecdc.session import scratch_path

LINES = "file_name string, version long, line_number int, line string"


def history(seed, files=4, versions=7):
    rng, out = random.Random(seed), {}
    for f in range(files):
        text = [f"{f}:{i}" for i in range(rng.randint(0, 25))]
        for v in range(1, versions + 1):
            if rng.random() < 0.15:
                pass  # saved as it was
            elif rng.random() < 0.1:
                text = []
            else:
                for _ in range(rng.randint(0, 6)):
                    at, what = rng.randint(0, len(text)), rng.random()
                    if what < 0.4:
                        text[at:at] = [rng.choice(["{", "}", f"new {v}"])] * rng.randint(1, 3)
                    elif text:
                        at = min(at, len(text) - 1)
                        text[at:at + rng.randint(1, 3)] = [] if what < 0.7 else [f"edit {v}"]
            out[f"f{f}", 10 * v] = list(text)
    return out


@pytest.mark.parametrize("seed, every, bits", [(1, 7, 16), (2, 3, 16), (3, 7, 2)])
def test_any_version_from_its_keyframe(spark, monkeypatch, seed, every, bits):
    monkeypatch.setattr(D, "BLOCK_BITS", bits)  # small: ranges and runs cross blocks
    versions = history(seed)
    lines = spark.createDataFrame([(f, v, i + 1, x) for (f, v), ls in versions.items() for i, x in enumerate(ls)]
                                  + [(f, v, None, None) for (f, v), ls in versions.items() if not ls], LINES)
    whole = lines.where("line_number is not null")
    events = diff_versions(lines)
    path = scratch_path(spark, "deltas")
    D.write_deltas(lines, events, path, every)
    kept = {(r["file_name"], r["version"]) for r in spark.read.parquet(f"{path}/keyframes").collect()}
    assert len(kept) < len(versions) and whole.count() > spark.read.parquet(f"{path}/keyframes").count()
    targets = spark.createDataFrame(list(versions), "file_name string, version long")
    got = {}
    for r in D.rebuild(spark, path, targets).collect():
        got.setdefault((r["file_name"], r["version"]), []).append((r["line_number"], r["line"]))
    assert {k: [x for _, x in sorted(v)] for k, v in got.items()} == {k: v for k, v in versions.items() if v}
    assert all([n for n, _ in sorted(v)] == list(range(1, len(v) + 1)) for v in got.values())


def test_no_targets(spark):
    path = scratch_path(spark, "deltas")
    lines = spark.createDataFrame([("f", 1, 1, "a"), ("f", 2, 1, "b")], LINES)
    D.write_deltas(lines, diff_versions(lines), path, 2)
    none = spark.createDataFrame([], "file_name string, version long")
    assert D.rebuild(spark, path, none).count() == 0
