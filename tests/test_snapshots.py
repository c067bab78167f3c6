from datetime import datetime

from hypothesis import given, settings
from hypothesis import strategies as st

from siftline.operators.snapshots import extend_ordinals, pack_bits, snapshot_changes, unpack_bits

ROWS = "snapshot_id int, path string, modified_ts long, size_bytes long, delivered_at timestamp, root string, bucket int"
RUNS = "snapshot_id int, root string, taken_at timestamp, complete boolean"
T = datetime(2024, 1, 1)


@settings(max_examples=60, deadline=None)
@given(st.sets(st.integers(0, 32767), max_size=300))
def test_bits_round_trip(bits):
    assert set(unpack_bits(pack_bits(sorted(bits))).nonzero()[0]) == bits


def test_runs_are_small():
    assert len(pack_bits(list(range(30000)))) < 10


def changes(spark, rows, runs):
    data = spark.createDataFrame([(*r, "x", 1) for r in rows], ROWS)
    return sorted((r["snapshot_id"], r["path"], r["change"]) for r in snapshot_changes(data, spark.createDataFrame(runs, RUNS)).collect())


def test_changes(spark):
    runs = [(1, "/a", T, True), (2, "/a", T, False), (3, "/a", T, True), (1, "/ab", T, True), (3, "/ab", T, True)]
    rows = [
        (1, "/a/x", 10, 1, T), (1, "/a/y", None, 1, T), (1, "/a/z", 10, 1, T), (1, "/ab/q", 10, 1, T), (1, None, 1, 1, T),
        (2, "/a/gone", 10, 1, T),
        (3, "/a/x", 10_000_000_000_500 // 1000, 1, T), (3, "/a/x", 10, 1, datetime(2023, 1, 1)), (3, "/a/y", None, 1, T), (3, "\\a\\new", 1, None, T), (3, "/ab/q", 10, 2, T), (3, "/c/none", 1, 1, T),
    ]
    assert changes(spark, rows, runs) == [(3, "/a/new", "added"), (3, "/a/x", "changed"), (3, "/a/z", "removed"), (3, "/ab/q", "changed")]


def test_very_many_roots(spark):
    from siftline.operators.snapshots import current_rows

    data = [(1, "\\r\\2\\a", 1, 1, T), (1, "/r/2", 1, 1, T), (1, "/r/22/a", 1, 1, T), (1, "/r/2/in/b", 1, 1, T), (1, None, 1, 1, T), (1, "/r/2/cafe\u0301", 1, 1, T), (1, "/else", 1, 1, T)]
    rows = spark.createDataFrame([(*r, "x", 1) for r in data], ROWS)
    runs = spark.createDataFrame([(1, f"/r/{i}", T, True) for i in range(20)] + [(1, "/r/2/in", T, False)], RUNS)
    one, two = (sorted(tuple(r) for r in current_rows(rows, runs, most).collect()) for most in (100, 5))
    assert one == two and {r[2] for r in one} == {"/r/2", "/r/2/a", "/r/2/caf\xe9"}


def test_units_and_forms(spark):
    runs = [(1, "C:/u", T, True), (2, "C:/u", T, True)]
    assert changes(spark, [(1, "C:\\u\\e\u0301", 1_700_000_000, 1, T), (2, "C:/u/\xe9", 1_700_000_000_999, 1, T)], runs) == []


def test_empty(spark):
    assert changes(spark, [], [(1, "/a", T, True)]) == [] and changes(spark, [(1, "/a/x", 1, 1, T)], []) == []


def test_ordinals_stay(spark):
    one = spark.createDataFrame([("/r", f"/r/{i}", 1) for i in range(20)], "root string, path string, snapshot_id int")
    two = one.union(spark.createDataFrame([("/r", "/r/0a", 2)], one.schema))
    first = extend_ordinals(one, buckets=2)
    later = {r["path"]: (r["bucket"], r["ordinal"]) for r in extend_ordinals(two, first).collect()}
    assert all(later[r["path"]] == (r["bucket"], r["ordinal"]) for r in first.collect()) and len(set(later.values())) == 21
