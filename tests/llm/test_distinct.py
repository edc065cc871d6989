import numpy as np
import pytest
from pyspark.sql import functions as F

from ridgeline.llm import distinct

KEYS = ["g"]


def hashed(spark, n, g="a", seed=0, repeats=1):
    return spark.range(n * repeats).select(F.lit(g).alias("g"), F.xxhash64(F.col("id") % n, F.lit(seed)).alias("h"))


def estimate(df, precision=distinct.PRECISION):
    return {r.g: r.estimate for r in distinct.estimates(distinct.sketch(df, KEYS, ["h"], precision), KEYS, precision).collect()}


def plain_registers(hashes, precision):
    """Register to the ranks seen, one hash at a time."""
    seen = {}
    for h in hashes:
        h &= (1 << 64) - 1
        rest, rank = h >> precision, 1
        while rank <= 64 - precision and not rest & 1:
            rest, rank = rest >> 1, rank + 1
        seen.setdefault(h & ((1 << precision) - 1), set()).add(rank)
    return {r: (max(k) << 2) | ((max(k) - 1 in k) << 1) | (max(k) - 2 in k) for r, k in seen.items()}


def states(sketch, precision=distinct.PRECISION):
    return {int(e) >> 8: int(e) & 255 for e in distinct.entries_of(bytes(sketch), precision)}


@pytest.mark.parametrize("n", [1, 10, 400, 5000, 60_000, 400_000])
def test_error_is_within_the_bound(spark, n):
    assert abs(estimate(hashed(spark, n, repeats=2))["a"] - n) <= max(distinct.error_bound() * n, 0.01)


def test_standard_error(spark):
    df = spark.range(60).crossJoin(spark.range(3000).withColumnRenamed("id", "k")).select(F.col("id").cast("string").alias("g"), F.xxhash64("id", "k").alias("h"))
    errors = np.array(list(estimate(df, 8).values())) / 3000 - 1
    expected = distinct.error_bound(8) / 3
    assert 0.7 * expected < errors.std() < 1.4 * expected and abs(errors.mean()) < 0.6 * expected


@pytest.mark.parametrize("precision", [4, 8, 12])
def test_sketches_equal_plain_registers(spark, precision):
    df = spark.range(3000).select(F.when(F.col("id") % 3 == 0, "a").when(F.col("id") % 50 == 1, None).otherwise("b").alias("g"), F.xxhash64("id").alias("h"), F.when(F.col("id") < 5, F.xxhash64("id", F.lit(1))).alias("k"))
    plain = {}
    for r in df.collect():
        for m in ("h", "k"):
            if r[m] is not None:
                plain.setdefault((r.g, m), []).append(r[m])
    got = {(r.g, r.measure): states(r.sketch, precision) for r in distinct.sketch(df.repartition(5), KEYS, ["h", "k"], precision).collect()}
    assert got == {k: plain_registers(v, precision) for k, v in plain.items()}


@pytest.mark.parametrize("entries", [distinct.ENTRIES, 1 << 12])
def test_merging_parts_equals_the_whole(spark, monkeypatch, entries):
    monkeypatch.setattr(distinct, "ENTRIES", entries)
    monkeypatch.setattr(distinct, "ROWS", 1 << 10)
    parts = hashed(spark, 20_000).unionByName(hashed(spark, 300, "b")).withColumn("part", F.pmod("h", F.lit(700)))
    small = distinct.sketch(parts, ["g", "part"], ["h"])
    whole = {r.g: states(r.sketch) for r in distinct.sketch(parts, KEYS, ["h"]).collect()}
    for combine in (True, False):
        merged = [(r.g, states(r.sketch)) for r in distinct.merge(small, KEYS, combine=combine).collect()]
        assert len(merged) == 2 and dict(merged) == whole
    placed = [(r.g, states(r.sketch)) for r in distinct.merge_placed(small.repartition("g"), KEYS).collect()]
    assert len(placed) == 2 and dict(placed) == whole


def test_sketches_are_small(spark):
    few, many = (distinct.sketch(hashed(spark, n), KEYS, ["h"]).first().sketch for n in (100, 50_000))
    assert len(few) <= 300 and len(many) == 1 << distinct.PRECISION
    assert len(states(many)) == (1 << distinct.PRECISION)


def test_nulls_are_no_items_and_empty_sets_have_no_row(spark):
    df = spark.createDataFrame([("a", None), (None, 5), ("b", 1), ("b", 1)], "g string, h bigint").withColumn("h", F.when(F.col("h").isNotNull(), F.xxhash64("h")))
    assert {g: round(x) for g, x in estimate(df).items()} == {None: 1, "b": 1}
    assert estimate(spark.createDataFrame([], "g string, h bigint")) == {}


def test_likelihood_is_largest_at_the_estimate():
    def log_likelihood(n, registers, found):
        total, m = 0.0, registers
        for r in range(m):
            top, bits = (found[r] >> 2, found[r] & 3) if r in found else (0, 0)
            absent = sum(2.0**-k for k in range(top + 1, 65))
            for below, bit in ((1, 2), (2, 1)):
                if top - below >= 1:
                    p = 1 - np.exp(-n / m * 2.0 ** (below - top))
                    total += np.log(p) if bits & bit else np.log(1 - p)
            total += (np.log(1 - np.exp(-n / m * 2.0**-top)) if top else 0) - n / m * absent
        return total

    rng = np.random.default_rng(4)
    found = plain_registers([int(x) for x in rng.integers(0, 2**63, 500)], 6)
    state = np.array(list(found.values()))
    n = distinct.likelihood_estimates(np.zeros(len(state), int), state, 2, 64)
    assert n[1] == 0 and abs(n[0] - 500) < 150
    best = log_likelihood(n[0], 64, found)
    assert all(log_likelihood(n[0] * f, 64, found) < best for f in (0.97, 1.03))


def test_hash_without_bits_has_the_last_rank():
    register, state = distinct.states_of(np.array([3, -1], np.int64), 4)
    assert register.tolist() == [3, 15] and (state >> 2).tolist() == [61, 1]


@pytest.mark.parametrize("most", [50_000, 0])
def test_windows_against_exact_counts(spark, monkeypatch, most):
    monkeypatch.setattr(distinct, "BROADCAST_DAYS", most)
    day = distinct.DAY
    rng = np.random.default_rng(3)
    rows = [(int(t) if t >= 0 else None, c, f"s{a}" if a else None, f"d{b}" if b else None) for t, c, a, b in zip(rng.integers(-500, 3 * day, 4000), rng.choice(["A", "B", "C"], 4000), rng.integers(0, 40, 4000), rng.integers(0, 60, 4000), strict=True)]
    events = spark.createDataFrame(rows, "ts bigint, category string, s string, d string")
    events = events.select("ts", "category", *[h.alias(n) for n, h in distinct.event_hashes(F.col("s"), F.col("d")).items()])
    spans = [(1, 0, day - 1, ["A"]), (2, 0, 3 * day - 1, ["A", "B", "B"]), (3, 5000, 5999, ["C"]), (4, 5999, 2 * day + 7, ["A", "C"]), (5, 100, 50, ["A"]), (6, 0, 0, ["Z"]), (7, 1, 5, None), (8, None, 5, ["A"]), (9, day, day, ["A", "B", "C"])]
    windows = spark.createDataFrame(spans, "window bigint, ts_start bigint, ts_end bigint, categories array<string>")
    got = {(r.window, r.measure): r.estimate for r in distinct.estimates(distinct.window_sketches(events, windows), ["window"]).collect()}
    for w, a, b, cs in spans:
        inside = [r for r in rows if cs and a is not None and r[0] is not None and a <= r[0] <= b and r[1] in cs]
        for m, exact in (("e", {r[2:] for r in inside if r[2] and r[3]}), ("v_src", {r[2] for r in inside if r[2]}), ("v_dst", {r[3] for r in inside if r[3]})):
            assert abs(got.get((w, m), 0) - len(exact)) <= distinct.error_bound() * len(exact) + 0.01, (w, m)
