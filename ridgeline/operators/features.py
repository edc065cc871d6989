"""One feature row for each entity from its events."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Stands for events without a type, and for the totals over all types.
NO_TYPE, ALL_TYPES = "(none)", "(all)"


def once(df: DataFrame, key: str, order: str, columns: Sequence[str]) -> DataFrame:
    """``columns`` of the first row of each ``key`` by ``order`` (ties: smallest columns); rows without a key all stay."""
    pack = F.struct(F.col(order), *[F.col(c) for c in columns])
    keyed = df.filter(F.col(key).isNotNull()).groupBy(key).agg(F.min(pack).alias("p")).select(*[F.col(f"p.{c}") for c in columns])
    return keyed.unionByName(df.filter(F.col(key).isNull()).select(*columns))


def entity_type_counts(df: DataFrame, entity: Column, type_: Column, time: Column, event_id: str, loaded: str) -> DataFrame:
    """(entity, event_type, n, latest), each event id counted once, as its first delivery has it.

    Events without an entity are left out; events without a type have the type ``(none)``; a null time counts but
    is never the latest.
    """
    rows = df.select(
        F.col(event_id).alias("event_id"), F.col(loaded).alias("loaded"), entity.alias("entity"), F.coalesce(type_, F.lit(NO_TYPE)).alias("event_type"), time.alias("at")
    )
    return (
        once(rows, "event_id", "loaded", ["entity", "event_type", "at"])
        .filter(F.col("entity").isNotNull())
        .groupBy("entity", "event_type")
        .agg(F.count(F.lit(1)).alias("n"), F.max("at").alias("latest"))
    )


def known_types(df: DataFrame, type_: Column, most: int = 5000) -> list[str]:
    """Sorted list of the types in ``df``; more than ``most`` would be no sensible list of columns and is an error."""
    found = [r[0] for r in df.select(F.coalesce(type_, F.lit(NO_TYPE)).alias("t")).distinct().limit(most + 1).collect()]
    if len(found) > most:
        raise ValueError(f"more than {most} event types; give an explicit list or use entity_type_counts")
    return sorted(found)


def entity_features(counts: DataFrame, types: Sequence[str], as_of: int | None) -> DataFrame:
    """One row for each entity: ``<type>_n``, ``<type>_latest`` and ``<type>_since`` for each of ``types``.

    ``(all)_n``, ``(all)_latest`` and ``(all)_since`` are totals over all types, listed or not.  A type without
    events has n 0 and null times.  ``as_of`` is the time to which recency is measured.  The long table is moved
    once, by entity, as a few rows for each type; totals and pivot then need no further exchange.
    """
    both = (
        counts.repartition("entity")
        .withColumn("t", F.explode(F.array(F.col("event_type"), F.lit(ALL_TYPES))))
        .groupBy("entity")
        .pivot("t", [*types, ALL_TYPES])
        .agg(F.sum("n").alias("n"), F.max("latest").alias("latest"))
    )
    out = [F.col("entity")]
    for t in [*types, ALL_TYPES]:
        name = t.replace("`", "``")
        latest = F.col(f"`{name}_latest`")
        out += [
            F.coalesce(F.col(f"`{name}_n`"), F.lit(0)).cast("bigint").alias(f"{t}_n"),
            latest.alias(f"{t}_latest"),
            (F.lit(as_of).cast("bigint") - latest).alias(f"{t}_since"),
        ]
    return both.select(*out)
