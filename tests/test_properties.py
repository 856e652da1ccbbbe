"""Properties over many random pairs per Spark run (hypothesis draws the pairs):
apply(old, diff(old, new)) == new; null pattern by type; count = sum of max."""

from difflib import SequenceMatcher

from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st

from conftest import lines_df
from linecdc.operators.diff import apply_changes, diff_lines

line = st.sampled_from(["a", "b", "c", "", "a b", "x=1"])
pair = st.tuples(st.lists(line, max_size=12), st.lists(line, max_size=12))


@settings(max_examples=2, deadline=None, suppress_health_check=list(HealthCheck))
@given(st.lists(pair, min_size=10, max_size=25))
def test_diff_properties(spark, pairs):
    files = {f"p{i}": p for i, p in enumerate(pairs)}
    old = lines_df(spark, {k: v[0] for k, v in files.items()})
    new = lines_df(spark, {k: v[1] for k, v in files.items()})
    ev = diff_lines(old, new)
    rows = ev.collect()
    for r in rows:
        assert (r.old_value is None) == (r.event_type == "INSERT")
        assert (r.new_value is None) == (r.event_type == "DELETE")
    assert len({r.event_id for r in rows}) == len(rows)
    exp_n = sum(max(i2 - i1, j2 - j1) for a, b in files.values()
                for t, i1, i2, j1, j2 in SequenceMatcher(None, a, b, autojunk=False).get_opcodes() if t != "equal")
    assert len(rows) == exp_n
    got = {}
    for r in apply_changes(old, ev).collect():
        got.setdefault(r.file_name, []).append((r.line_number, r.line))
    for f, (a, b) in files.items():
        if a == b and not a:
            continue
        assert [x for _, x in sorted(got.get(f, []))] == b, f
