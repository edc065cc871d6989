"""Per-key results when a handful of keys hold most rows.

Heavy keys are found by a mergeable frequent-items sketch (one pass, bounded memory).  Their rows meet the
bounded heavy list in a broadcast join and are aggregated in two phases, so that no task owns a heavy key;
the other rows take the ordinary shuffle.  The two results are disjoint and are united.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ridgeline.session import cut_lineage

#: Sketch counters for each wanted heavy key; the relative count error is 3.5 / counters.
COUNTERS_PER_KEY = 64
#: Most counters of a sketch; a share that needs more is an error, for keys could be missed.
MOST_COUNTERS = 1 << 19


@dataclass(frozen=True)
class Heavy:
    """Heavy keys and the total number of rows of each group; ``keys`` has at most 2 / share rows for each group."""

    keys: DataFrame
    totals: dict[object, int]


def heavy_keys(df: DataFrame, key: str, share: float, group: str | None = None, max_groups: int = 64) -> Heavy:
    """Every key that holds more than ``share`` of the rows (of its ``group``), by a frequent-items sketch.

    No key above the share is missed: the sketch's error is a twentieth of the share.  A few keys below it may be
    listed, which costs nothing but speed.  Null keys are never heavy, but their rows count in the totals.
    ``group`` must have few values (roles, categories): at most ``max_groups``, else ValueError; so is a share too
    small for the sketch.
    """
    if not 0 < share < 1:
        raise ValueError("share must lie between 0 and 1")
    wanted = max(2, int(2 / share))
    counters = 1 << (wanted * COUNTERS_PER_KEY - 1).bit_length()
    if counters > MOST_COUNTERS:
        raise ValueError(f"a share below {2 * COUNTERS_PER_KEY / MOST_COUNTERS:.2g} needs more counters than the sketch has")
    by = [F.col(group)] if group else [F.lit(None).cast("string").alias("__group")]
    name = group or "__group"
    rows = (
        df.groupBy(*by)
        .agg(
            F.count(F.lit(1)).alias("rows"),
            F.expr(f"approx_top_k(`{key}`, {wanted}, {counters})").alias("top"),
        )
        .limit(max_groups + 1)
        .collect()
    )
    if len(rows) > max_groups:
        raise ValueError(f"{name} has more than {max_groups} values")
    totals = {r[name]: r["rows"] for r in rows}
    found = [
        (r[name], x["item"])
        for r in rows
        for x in r["top"] or []
        if x["item"] is not None and x["count"] > share * r["rows"] / 2
    ]
    fields = [T.StructField(name, df.schema[group].dataType if group else T.StringType()), T.StructField(key, df.schema[key].dataType)]
    keys = df.sparkSession.createDataFrame(found, T.StructType(fields))
    return Heavy(keys if group else keys.drop(name), totals)


def skew_free_aggregate(
    df: DataFrame,
    keys: Sequence[str],
    partial: dict[str, Column],
    merge: dict[str, Column],
    heavy: DataFrame,
    salts: int = 64,
) -> DataFrame:
    """``partial`` aggregates for each key, made without a straggling task.

    ``merge`` holds for each name the aggregate that combines partial results (sum for counts and sums, min, max).
    ``heavy`` is the bounded list of heavy keys (one or more of ``keys``).  Heavy rows are aggregated by key and salt,
    the salt being their input partition modulo ``salts``, and then merged: at most ``salts`` rows for each heavy
    key reach the second phase.  Rows with a null key belong to no key and are left out.
    """
    keyed = df.dropna(subset=list(keys))
    on = [k for k in keys if k in heavy.columns]
    small = F.broadcast(heavy.select(*on))
    salted = keyed.join(small, on).withColumn("__salt", F.pmod(F.spark_partition_id(), F.lit(salts)))
    first = salted.groupBy(*keys, "__salt").agg(*[c.alias(n) for n, c in partial.items()])
    hot = first.groupBy(*keys).agg(*[c.alias(n) for n, c in merge.items()])
    cold = keyed.join(small, on, "left_anti").groupBy(*keys).agg(*[c.alias(n) for n, c in partial.items()])
    return hot.unionByName(cold)


def skew_join(
    left: DataFrame, right: DataFrame, key: str, heavy: DataFrame, how: str = "inner", most_rows: int = 1_000_000, salts: int = 64
) -> DataFrame:
    """``left`` joined with ``right`` on ``key`` where ``left`` is skewed: heavy keys by broadcast, others by shuffle.

    The rows of ``right`` for heavy keys are broadcast only if there are at most ``most_rows``.  Beyond that the rows of
    ``left`` for a heavy key are spread over ``salts`` parts, which meet as many copies of the rows of ``right``.
    ``how`` is ``inner`` or ``left``; rows of ``left`` with a null key match nothing.
    """
    if how not in ("inner", "left"):
        raise ValueError("how must be inner or left")
    small = F.broadcast(heavy.select(key))
    hot_right = cut_lineage(right.join(small, key, "left_semi"))  # counted and joined
    hot_left = left.join(small, key, "left_semi")
    if hot_right.count() <= most_rows:
        hot = hot_left.join(F.broadcast(hot_right), key, how)
    else:
        spread = hot_left.withColumn("__salt", F.pmod(F.monotonically_increasing_id(), F.lit(salts)).cast("int"))
        copies = hot_right.withColumn("__salt", F.explode(F.sequence(F.lit(0), F.lit(salts - 1))))
        hot = spread.join(copies, [key, "__salt"], how).drop("__salt")
    cold = left.join(small, key, "left_anti").join(right.join(small, key, "left_anti"), key, how)
    return hot.unionByName(cold)


def role_rows(events: DataFrame, entity_of) -> DataFrame:
    """Two rows for each event, (role, entity): its source and its destination; ``entity_of`` maps a name column."""
    return events.select(
        F.explode(
            F.array(
                F.struct(F.lit("source").alias("role"), entity_of(F.col("source_entity")).alias("entity")),
                F.struct(F.lit("destination").alias("role"), entity_of(F.col("destination_entity")).alias("entity")),
            )
        ).alias("r")
    ).select("r.role", "r.entity")
