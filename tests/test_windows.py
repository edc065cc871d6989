import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from ridgeline.operators import windows
from ridgeline.operators.windows import Thresholds

EVENT = "event_id bigint, ts bigint, source_entity string, destination_entity string"


def events(seed, n=600):
    r = random.Random(seed)
    return [(k, k // 3, f"s{r.randint(0, 12)}", f"d{r.randint(0, 9)}") for k in range(n)]


def sequential(rows, t, merge=True, ratio=0.5, tail_pairs=True):
    out, cur = [], []

    def close():
        s, d = {x[2] for x in cur}, {x[3] for x in cur}
        return [len(out), cur[0][1], cur[-1][1], len(cur), len({x[2:] for x in cur}), len(s), len(d), len(s | d), False]

    for x in rows:
        cur.append(x)
        c = close()
        if c[3] >= t.m and c[4] >= t.e and c[5] >= t.v_src and c[6] >= t.v_dst:
            out.append(c)
            cur = []
    if cur:
        c = close()
        if merge and out and c[3] < ratio * t.m:
            out[-1][2], out[-1][3], out[-1][8] = c[2], out[-1][3] + c[3], True
            out[-1][4] += c[4] if tail_pairs else 0
        else:
            out.append(c)
    return [tuple(x) for x in out]


@pytest.mark.parametrize("t", [Thresholds(90, 5, 2, 2), Thresholds(10, 60, 2, 2), Thresholds(10, 5, 13, 2), Thresholds(10, 5, 2, 10), Thresholds(1, 1, 1, 1), Thresholds(10_000, 1, 1, 1)])
@pytest.mark.parametrize("options", [{}, {"merge_tail": False}, {"tail_pairs": False, "tail_ratio": 1.0}])
def test_scan_equals_sequential_reading(t, options):
    rows = events(t.m)
    r, pieces, k = random.Random(t.e), [], 0
    while k < len(rows):
        part = rows[k : k + r.randint(1, min(t.m, 200))]
        k += len(part)
        code = lambda f: np.array([hash(f(x)) for x in part], np.int64)
        pieces.append(windows.piece_of(np.array([x[1] for x in part]), {"e": code(lambda x: x[2:]), "v_src": code(lambda x: x[2]), "v_dst": code(lambda x: x[3])}))
    got = list(windows.scan_windows(iter(pieces), t, options.get("merge_tail", True), options.get("tail_ratio", 0.5), options.get("tail_pairs", True)))
    assert [tuple(x) for x in got] == sequential(rows, t, options.get("merge_tail", True), options.get("tail_ratio", 0.5), options.get("tail_pairs", True))


def test_adaptive_windows_on_spark(spark):
    rows = events(3)
    t = Thresholds(40, 30, 10, 8)
    df = spark.createDataFrame(rows, EVENT).repartition(7)
    got = windows.adaptive_windows(df, t, ["ts", "event_id"]).orderBy("idx").collect()
    assert [tuple(r) for r in got] == sequential(rows, t)


def test_no_events(spark):
    empty = spark.createDataFrame([], EVENT)
    assert windows.adaptive_windows(empty, Thresholds(1, 1, 1, 1), ["ts", "event_id"]).count() == 0
    assert windows.fixed_event_windows(empty, 5, ["ts", "event_id"]).count() == 0
    assert windows.quartiles(empty, F.col("ts")).first().asDict() == {"n": 0, "min": None, "q1": None, "median": None, "q3": None, "max": None, "mean": None}


def test_fixed_windows(spark):
    df = spark.createDataFrame(events(1, 25), EVENT).repartition(4)
    got = [tuple(r) for r in windows.fixed_event_windows(df, 10, ["ts", "event_id"]).orderBy("idx").collect()]
    assert got == [(0, 0, 3, 10, False), (1, 3, 8, 10, True)]
    assert windows.fixed_event_windows(df, 26, ["ts", "event_id"]).count() == 0


def test_positions_are_dense(spark):
    df = spark.createDataFrame(events(2, 100), EVENT).repartition(6)
    assert [(r.pos, r.event_id) for r in windows.numbered(df, ["event_id"]).orderBy("event_id").collect()] == [(k, k) for k in range(100)]


def test_ranges_against_all_pairs(spark):
    points = spark.createDataFrame([(k, None if k == 3 else k * 400) for k in range(30)], "p int, t bigint")
    ranges = spark.createDataFrame([(0, 0, 0), (1, 100, 5000), (2, 5000, 5000), (3, 9000, 100), (4, None, 5), (5, 400, 11_999)], "r int, a bigint, b bigint")
    got = {(x.p, x.r) for x in windows.in_ranges(points, ranges, "t", "a", "b").collect()}
    assert got == {(p, r) for p in range(30) if p != 3 for r, a, b in [(0, 0, 0), (1, 100, 5000), (2, 5000, 5000), (5, 400, 11_999)] if a <= p * 400 <= b}


def test_attacks_go_to_the_first_window_of_a_shared_second(spark):
    found = spark.createDataFrame([(0, 0, 10), (1, 10, 20), (2, 21, 30)], "idx bigint, ts_start bigint, ts_end bigint")
    alerts = spark.createDataFrame([(1, 10, "C2"), (2, 4, "C9"), (3, 10, "C2"), (4, 25, "C1"), (5, 99, "C1"), (6, None, "C1")], "alert_id bigint, ts bigint, pivot string")
    once = windows.annotate_attacks(found, alerts)
    for out in (once, windows.annotate_attacks(once, alerts)):
        assert {r.idx: (r.has_attack, r.attack_pivots, r.attack_event_count) for r in out.collect()} == {0: (True, ["C9", "C2"], 3), 1: (False, [], 0), 2: (True, ["C1"], 1)}
    assert {r.pivot: (r.windows, r.idxs) for r in windows.pivot_coverage(once).collect()} == {"C9": (1, [0]), "C2": (1, [0]), "C1": (1, [2])}


def test_quartiles_do_not_interpolate(spark):
    values = [5, 1, 9, 9, 2, None, 7, 3]
    a = sorted(v for v in values if v is not None)
    row = windows.quartiles(spark.createDataFrame([(v,) for v in values], "x int"), F.col("x")).first()
    assert (row.n, row.min, row.q1, row.median, row.q3, row.max, row["mean"]) == (7, 1, a[7 // 4], a[7 // 2], a[3 * 7 // 4], 9, sum(a) / 7)


def test_stream_equals_batch(spark, tmp_path):
    from ridgeline.streaming.windows import stream_windows

    rows = events(5, 400)
    for k in range(0, 400, 130):
        spark.createDataFrame(rows[k : k + 130], EVENT).coalesce(1).write.parquet(str(tmp_path / "in" / f"p{k:04d}"))
    t = Thresholds(40, 30, 10, 8)
    source = spark.readStream.schema(EVENT).option("maxFilesPerTrigger", 1).option("recursiveFileLookup", "true").parquet(str(tmp_path / "in"))
    query = stream_windows(source, t).writeStream.format("memory").queryName("closed").option("checkpointLocation", str(tmp_path / "state")).outputMode("append").start()
    try:
        query.processAllAvailable()
    finally:
        query.stop()
    got = sorted(tuple(r)[1:] for r in spark.table("closed").collect())
    assert got == [x[:8] for x in sequential(rows, t, merge=False)][: len(got)] and len(got) >= 4
