"""Cases derived from the alignment rule: every gap of up to three lines on either side, at
the start, in the middle and at the end of a file, and lists in which the rule has to
choose (ties, repeated lines, moved blocks). The expected events come from a model that
tries every block."""

from itertools import product

import pytest
from pyspark.sql import functions as F

from conftest import lines_df
from linecdc.operators.diff import diff_lines, diff_per_file


def blocks(old, new, a, b, c, d):
    """Longest common block of old[a:b] and new[c:d], the earliest in old, then in new;
    then the same on either side."""
    best = max(((n, -i, -j) for i in range(a, b) for j in range(c, d) for n in range(1, min(b - i, d - j) + 1)
                if old[i:i + n] == new[j:j + n]), default=None)
    if best is None:
        return []
    n, i, j = best[0], -best[1], -best[2]
    return blocks(old, new, a, i, c, j) + [(i, j, n)] + blocks(old, new, i + n, b, j + n, d)


def model(old, new):
    """Events of the gaps: pairs are updates, what is left over on one side is deleted or inserted."""
    out, i, j = [], 0, 0
    for bi, bj, n in [*blocks(old, new, 0, len(old), 0, len(new)), (len(old), len(new), 0)]:
        for k in range(max(bi - i, bj - j)):
            if i + k < bi and j + k < bj:
                out.append(("UPDATE", j + k + 1, old[i + k], new[j + k]))
            elif i + k < bi:
                out.append(("DELETE", i + k + 1, old[i + k], None))
            else:
                out.append(("INSERT", j + k + 1, None, new[j + k]))
        i, j = bi + n, bj + n
    return out


def gap(na, nb, head, tail):
    """Lists that share ``head`` lines before and ``tail`` lines after a gap of na and nb lines."""
    around = lambda middle: [f"head {k}" for k in range(head)] + middle + [f"tail {k}" for k in range(tail)]
    return around([f"was {k}" for k in range(na)]), around([f"is {k}" for k in range(nb)])


CASES = {f"gap_{na}_{nb}_{place}": gap(na, nb, head, tail) for na, nb in product(range(4), repeat=2)
         for place, head, tail in (("start", 0, 2), ("middle", 2, 3), ("end", 3, 0), ("all", 0, 0))}
CASES |= {
    "two_gaps": (["u", "v", "w", "x", "y", "z"], ["u", "V", "w", "x", "z", "zz"]),
    "tie_in_old": (["r", "s", "t", "r", "s"], ["r", "s"]),
    "tie_in_new": (["r", "s"], ["q", "r", "s", "t", "r", "s"]),
    "alternating": (["{", "}"] * 4, ["}", "{"] * 3),
    "doubled_lines": (["m", "n", "o"], ["m", "m", "n", "n", "o", "o"]),
    "moved_block": (["a1", "a2", "b1", "b2", "b3"], ["b1", "b2", "b3", "a1", "a2"]),
    "moved_line": (["one", "two", "three", "four"], ["two", "three", "one", "four"]),
    "all_equal_lines": (["="] * 5, ["="] * 3),
    "nothing_in_common": (["g", "h"], ["i", "j", "k"]),
    "no_prefix_trim": (["x", "p", "q"], ["x", "y", "x", "p", "q"]),
    "empty_string_line": ([""], ["a", ""]),
}


@pytest.fixture(scope="module")
def events(spark):
    old = lines_df(spark, {k: v[0] for k, v in CASES.items()})
    new = lines_df(spark, {k: v[1] for k, v in CASES.items()})
    ev = diff_lines(old, new, F.lit("2024-01-01 00:00:00").cast("timestamp"))
    got = {}
    for r in ev.collect():
        got.setdefault(r.file_name, []).append(r)
    return got


@pytest.mark.parametrize("name", sorted(CASES))
def test_case(events, name):
    rows = sorted(events.get(name, []), key=lambda r: r.change_seq)
    assert [(r.event_type, r.line_number, r.old_value, r.new_value) for r in rows] == model(*CASES[name])
    # Invariants: null pattern by type, ids unique, change order 1..n.
    for r in rows:
        assert (r.old_value is None) == (r.event_type == "INSERT")
        assert (r.new_value is None) == (r.event_type == "DELETE")
    assert len({r.event_id for r in rows}) == len(rows)
    assert [r.change_seq for r in rows] == list(range(1, len(rows) + 1))


def test_event_ids_deterministic(spark):
    old = lines_df(spark, {"f": ["a", "b"]})
    new = lines_df(spark, {"f": ["a", "c"]})
    a = diff_lines(old, new).select("event_id").collect()
    b = diff_lines(old, new).select("event_id").collect()
    assert a == b and len(a) == 1


@pytest.mark.parametrize("max_lines", [20_000, 3])
def test_per_file_function_gives_the_same_events(spark, events, max_lines):
    """Files above the limit go through the rounds; the events are those of both ways."""
    old = lines_df(spark, {k: v[0] for k, v in CASES.items()})
    new = lines_df(spark, {k: v[1] for k, v in CASES.items()})
    got = {}
    for r in diff_per_file(old, new, F.lit("2024-01-01 00:00:00").cast("timestamp"), max_lines).collect():
        got.setdefault(r.file_name, []).append(r)
    key = lambda r: r.change_seq
    assert {k: sorted(v, key=key) for k, v in got.items()} == {k: sorted(v, key=key) for k, v in events.items()}
