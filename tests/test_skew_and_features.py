from collections import Counter

import pytest
from pyspark.sql import functions as F

from ridgeline.functions.names import entity
from ridgeline.operators.features import ALL_TYPES, NO_TYPE, entity_features, entity_type_counts, known_types
from ridgeline.operators.skew import heavy_keys, role_rows, skew_free_aggregate, skew_join


@pytest.fixture(scope="module")
def skewed(spark):
    rows = [("hot", k) for k in range(4000)] + [(f"k{k % 700}", k) for k in range(5000)] + [(None, 1)] * 1000
    return rows, spark.createDataFrame(rows, "key string, v int").repartition(5).cache()


def test_heavy_keys_are_complete(skewed):
    rows, df = skewed
    heavy = heavy_keys(df, "key", 0.05)
    assert heavy.totals == {None: 10_000}
    found = {r.key for r in heavy.keys.collect()}
    assert "hot" in found and all(n <= 0.05 * len(rows) or k in found for k, n in Counter(k for k, _ in rows if k).items())


def test_counts_equal_plain_counts(skewed):
    rows, df = skewed
    heavy = heavy_keys(df, "key", 0.05).keys
    out = skew_free_aggregate(df, ["key"], {"n": F.count(F.lit(1)), "s": F.sum("v"), "m": F.max("v")}, {"n": F.sum("n"), "s": F.sum("s"), "m": F.max("m")}, heavy)
    want = Counter(k for k, _ in rows if k)
    got = {r.key: r for r in out.collect()}
    assert {k: r.n for k, r in got.items()} == dict(want)
    assert got["hot"].s == sum(range(4000)) and got["hot"].m == 3999


def test_join_equals_plain_join(spark, skewed):
    _, df = skewed
    other = spark.createDataFrame([("hot", "a"), ("hot", "b"), ("k1", "c"), (None, "d")], "key string, w string")
    heavy = heavy_keys(df, "key", 0.05).keys
    for how in ("inner", "left"):
        for most in (10, 1):
            ours = sorted(map(tuple, skew_join(df, other, "key", heavy, how, most).select("key", "v", "w").collect()), key=str)
            plain = sorted(map(tuple, df.join(other, "key", how).select("key", "v", "w").collect()), key=str)
            assert [x for x in ours if x[0]] == [x for x in plain if x[0]]
    with pytest.raises(ValueError):
        skew_join(df, other, "key", heavy, "full")


def test_no_rows(spark):
    empty = spark.createDataFrame([], "source_entity string, destination_entity string")
    roles = role_rows(empty, entity)
    heavy = heavy_keys(roles, "entity", 0.01, group="role")
    assert heavy.totals == {} and skew_free_aggregate(roles, ["role", "entity"], {"n": F.count(F.lit(1))}, {"n": F.sum("n")}, heavy.keys).count() == 0


def test_a_share_too_small_for_the_sketch_is_an_error(spark):
    with pytest.raises(ValueError, match="counters"):
        heavy_keys(spark.range(3).selectExpr("cast(id as string) AS key"), "key", 1e-5)


def test_too_many_groups(spark):
    with pytest.raises(ValueError):
        heavy_keys(spark.range(10).select(F.col("id").cast("string").alias("g"), F.lit("x").alias("key")), "key", 0.1, group="g", max_groups=5)


EVENTS = "event_id bigint, source_entity string, event_type string, ts bigint, loaded_at int, entity string"


def features(spark, rows, as_of=100):
    events = spark.createDataFrame(rows, EVENTS)
    counts = entity_type_counts(events, entity(F.col("source_entity")), F.col("event_type"), F.col("ts"), "event_id", "loaded_at")
    return entity_features(counts, known_types(events, F.col("event_type")), as_of)


def test_entity_rows(spark):
    rows = [
        (1, "A$@DOM1", "x", 10, 1, "clash"), (1, "A$@DOM1", "x", 10, 2, "clash"), (1, "B", "y", 99, 3, None), (2, "A", "x", 30, 1, None), (3, "A", None, None, 1, None),
        (4, "", "x", 5, 1, None), (5, None, "x", 5, 1, None), (None, "B", "a.b`c", 7, 1, None), (None, "B", "a.b`c", 7, 1, None), (6, "B", "y", 40, None, None),
    ]
    out = {r["entity"]: r.asDict() for r in features(spark, rows).collect()}
    assert set(out) == {"A", "B"}
    a, b = out["A"], out["B"]
    assert (a["x_n"], a["x_latest"], a["x_since"]) == (2, 30, 70)
    assert (a[f"{NO_TYPE}_n"], a[f"{NO_TYPE}_latest"], a[f"{NO_TYPE}_since"]) == (1, None, None)
    assert (a["y_n"], a["y_latest"]) == (0, None)
    assert (a[f"{ALL_TYPES}_n"], a[f"{ALL_TYPES}_latest"], a[f"{ALL_TYPES}_since"]) == (3, 30, 70)
    # rows without an id can't be recognised as repeats
    assert b["a.b`c_n"] == 2 and b["y_n"] == 1 and b[f"{ALL_TYPES}_n"] == 3


def test_no_events(spark):
    out = features(spark, [])
    assert out.count() == 0 and out.columns == ["entity", "(all)_n", "(all)_latest", "(all)_since"]


def test_types_outside_the_list_count_in_the_totals(spark):
    events = spark.createDataFrame([(1, "A", "x", 1, 1, None), (2, "A", "z", 2, 1, None)], EVENTS)
    counts = entity_type_counts(events, entity(F.col("source_entity")), F.col("event_type"), F.col("ts"), "event_id", "loaded_at")
    row = entity_features(counts, ["x"], 5).first().asDict()
    assert row == {"entity": "A", "x_n": 1, "x_latest": 1, "x_since": 4, "(all)_n": 2, "(all)_latest": 2, "(all)_since": 3}
    with pytest.raises(ValueError):
        known_types(events, F.col("event_type"), most=1)
