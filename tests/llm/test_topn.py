import math
import random

import pytest
from pyspark.sql import functions as F

from ridgeline.llm.topn import top_items

ROWS = "g bigint, item string, score double, salt string, rank int"


def ranked(spark, rows, n=3, salts=4):
    df = spark.createDataFrame(rows, ROWS)
    return {(r.group, r["rank"]): (r["item"], r.score) for r in top_items(df, F.col("g"), F.col("item"), F.col("score"), n, salts).collect()}


def brute(rows, n):
    best = {}
    for g, item, score, *_ in rows:
        if g is not None and item is not None and score is not None and not math.isnan(score):
            best[g, item] = max(best.get((g, item), -math.inf), score)
    out = {}
    for g in {g for g, _ in best}:
        own = sorted(((i, s) for (h, i), s in best.items() if h == g), key=lambda x: (-x[1], x[0].encode()))
        out |= {(g, k): x for k, x in enumerate(own[:n], 1)}
    return out


@pytest.mark.parametrize("n, salts", [(1, 1), (3, 4), (10, 64)])
def test_against_sorting(spark, n, salts):
    r = random.Random(n)
    items = [f"h{k}" for k in range(200)] + ["é", "Z", "", "z", "\U0001f600", "￿"]
    rows = [(r.choice([1, 1, 1, 2, 3, None]), r.choice([*items, None]), r.choice([0.0, 0.5, 0.5, 1.0, r.random(), None, float("nan"), float("inf"), -2.0]), None, 7) for _ in range(3000)]
    assert ranked(spark, rows, n, salts) == brute(rows, n)


def test_small_and_empty_groups(spark):
    rows = [(1, "b", 0.5, "x", 1), (1, "a", 0.5, "y", 2), (1, "a", 0.1, None, None), (2, "c", None, None, None)]
    assert ranked(spark, rows) == {(1, 1): ("a", 0.5), (1, 2): ("b", 0.5)}
    assert ranked(spark, []) == {}
