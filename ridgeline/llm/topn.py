"""The best items of every group, also of groups with millions of items."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def top_items(df: DataFrame, group: Column, item: Column, score: Column, n: int, salts: int = 64) -> DataFrame:
    """(group, item, score, rank): the ``n`` items of highest score in every group, ties by item in byte order.

    An item counts once, with its highest score.  Rows with a null group, item or score (NaN is null here) do not
    count.  First each group is hashed by item into ``salts`` subgroups, each of which is ranked and keeps n; then the
    at most n * salts survivors of a group are ranked.  The same item always falls into the same subgroup.
    """
    rows = df.select(group.alias("group"), item.alias("item"), F.nanvl(score.cast("double"), F.lit(None)).alias("score")).dropna()
    best = rows.groupBy("group", "item").agg(F.max("score").alias("score")).withColumn("salt", F.pmod(F.xxhash64("item"), F.lit(salts)))
    order = [F.desc("score"), F.asc("item")]
    first = best.withColumn("rank", F.row_number().over(Window.partitionBy("group", "salt").orderBy(*order))).filter(F.col("rank") <= n)
    last = first.withColumn("rank", F.row_number().over(Window.partitionBy("group").orderBy(*order)))
    return last.filter(F.col("rank") <= n).select("group", "item", "score", "rank")
