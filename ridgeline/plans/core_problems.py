"""Registered queries of the problems kept in the core: skewed keys, broken lines, entity features."""

from __future__ import annotations

from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ridgeline.functions.names import entity
from ridgeline.operators.features import ALL_TYPES, NO_TYPE, entity_features, entity_type_counts, known_types
from ridgeline.operators.quads import parse_quads
from ridgeline.operators.skew import heavy_keys, role_rows, skew_free_aggregate, skew_join
from ridgeline.sources.tables import table

HEAVY_SHARE = 0.01


def _role_counts(spark: SparkSession, folder: str) -> tuple[DataFrame, dict[object, int]]:
    roles = role_rows(table(spark, folder, "unified_event"), entity)
    heavy = heavy_keys(roles, "entity", HEAVY_SHARE, group="role")
    counts = skew_free_aggregate(roles, ["role", "entity"], {"n": F.count(F.lit(1))}, {"n": F.sum("n")}, heavy.keys)
    return counts, heavy.totals


def p2_found(spark: SparkSession, folder: str) -> DataFrame:
    counts, totals = _role_counts(spark, folder)
    limit = F.when(F.col("role") == "source", totals.get("source", 0)).otherwise(totals.get("destination", 0)) * F.lit(HEAVY_SHARE)
    return counts.filter(F.col("n") > limit).select("role", "entity")


def p2_entity_rows(spark: SparkSession, folder: str) -> DataFrame:
    return _role_counts(spark, folder)[0]


def p2_pivot_rank(spark: SparkSession, folder: str) -> DataFrame:
    """Events of every category by source, with how often the source is a destination: a skewed join, then counts."""
    events = table(spark, folder, "unified_event").select(entity(F.col("source_entity")).alias("entity"), "event_category")
    heavy = heavy_keys(events, "entity", HEAVY_SHARE).keys
    received = table(spark, folder, "unified_event").select(entity(F.col("destination_entity")).alias("entity")).filter(F.col("entity").isNotNull()).groupBy("entity").agg(F.count(F.lit(1)).alias("received"))
    joined = skew_join(events.filter(F.col("entity").isNotNull()), received, "entity", heavy, "left").withColumn("received", F.coalesce("received", F.lit(0)))
    return skew_free_aggregate(
        joined, ["entity", "event_category"], {"sent": F.count(F.lit(1)), "received": F.max("received")}, {"sent": F.sum("sent"), "received": F.max("received")}, heavy
    )


def p3_found(spark: SparkSession, folder: str) -> DataFrame:
    lines = table(spark, folder, "quad_raw").select("line_id", "line")
    return parse_quads(lines).filter(F.col("reason").isNotNull()).select("line_id", "reason").distinct()


def p3_quads(spark: SparkSession, folder: str) -> DataFrame:
    lines = table(spark, folder, "quad_raw").select("line_id", "line")
    return parse_quads(lines).filter(F.col("reason").isNull()).drop("reason", "rejected")


def p4_entity_features(spark: SparkSession, folder: str) -> DataFrame:
    events = table(spark, folder, "unified_event")
    as_of = events.agg(F.max("ts")).first()[0]
    counts = entity_type_counts(events, entity(F.col("source_entity")), F.col("event_type"), F.col("ts"), "event_id", "loaded_at")
    return entity_features(counts, known_types(events, F.col("event_type")), as_of)


def p4_entity_type_counts(spark: SparkSession, folder: str) -> DataFrame:
    events = table(spark, folder, "unified_event")
    return entity_type_counts(events, entity(F.col("source_entity")), F.col("event_type"), F.col("ts"), "event_id", "loaded_at")


def p4_feature_cells(spark: SparkSession, folder: str) -> DataFrame:
    """The feature table with a row for each cell that has events: (entity, event_type, n, latest, since)."""
    wide = p4_entity_features(spark, folder)
    types = [c.removesuffix("_since") for c in wide.columns if c.endswith("_since")]
    column = lambda t, k: F.col("`" + f"{t}_{k}".replace("`", "``") + "`")
    cells = F.array(*[F.struct(F.lit(t).alias("event_type"), *[column(t, k).alias(k) for k in ("n", "latest", "since")]) for t in types])
    return wide.select("entity", F.explode(cells).alias("c")).select("entity", "c.*").filter(F.col("n") > 0)


QUERIES = {
    "p2_found": p2_found,
    "p2_entity_rows": p2_entity_rows,
    "p2_pivot_rank": p2_pivot_rank,
    "p3_found": p3_found,
    "p3_quads": p3_quads,
    "p4_entity_features": p4_entity_features,
    "p4_entity_type_counts": p4_entity_type_counts,
    "p4_feature_cells": p4_feature_cells,
}


def sql_entity(name: str) -> str:
    return rf"nullif(regexp_replace(regexp_replace(coalesce({name}, ''), '(?i)@DOM[0-9]+$', ''), '\$$', ''), '')"


_ROLES = f"""roles AS (SELECT 'source' AS role, {sql_entity('source_entity')} AS entity FROM unified_event
    UNION ALL SELECT 'destination', {sql_entity('destination_entity')} FROM unified_event)"""

_CELL = r'(?:"(?:[^"]|"")*"|[^",]*)'
_QUADS = rf"""quads AS (
    SELECT line_id, coalesce(line, '') AS line,
        regexp_full_match(coalesce(line, ''), '(?s){_CELL}(?:,{_CELL})*') AS quoted,
        regexp_full_match(coalesce(line, ''), '(?s){_CELL}(?:,{_CELL}){{4}}') AS five,
        regexp_extract(coalesce(line, ''), '(?s)^({_CELL}),({_CELL}),({_CELL}),({_CELL}),({_CELL})$', ['timestamp', 'src_node', 'dst_node', 'action_state', 'source_file']) AS c
    FROM quad_raw),
cells AS (
    SELECT line_id, quoted, five, {', '.join(f'''CASE WHEN c.{k} LIKE '"%' THEN replace(substring(c.{k}, 2, length(c.{k}) - 2), '""', '"') ELSE c.{k} END AS {k}''' for k in ('timestamp', 'src_node', 'dst_node', 'action_state', 'source_file'))} FROM quads),
judged AS (
    SELECT *, CASE
        WHEN NOT quoted THEN 'quoting'
        WHEN NOT five THEN 'columns'
        WHEN NOT regexp_full_match(timestamp, '[1-9][0-9]{{0,8}}') THEN 'timestamp'
        WHEN NOT CASE source_file
            WHEN 'auth' THEN regexp_full_match(action_state, '[^_\s]+_(Success|Failure)_[^_\s]+(_[^_\s]+)+')
            WHEN 'flows' THEN regexp_full_match(action_state, 'NetFlow_[0-9]+_(N[0-9]+|[0-9]+)>(N[0-9]+|[0-9]+)')
                AND coalesce(try_cast(regexp_extract(action_state, '_([0-9]+)>', 1) AS INT), 0) <= 65535
                AND coalesce(try_cast(regexp_extract(action_state, '>([0-9]+)$', 1) AS INT), 0) <= 65535
            WHEN 'redteam' THEN regexp_full_match(action_state, 'RedTeam_via_C[0-9]+')
            WHEN 'dns' THEN action_state = 'DNS_Query'
            WHEN 'proc' THEN action_state IN ('Process_Start', 'Process_End')
            ELSE true END THEN 'action_state' END AS reason FROM cells)"""

_TYPE_COUNTS = f"""firsts AS (
    SELECT {sql_entity('source_entity')} AS entity, coalesce(event_type, '(none)') AS event_type, ts
    FROM unified_event QUALIFY row_number() OVER (PARTITION BY event_id ORDER BY loaded_at) = 1),
counts AS (SELECT entity, event_type, count(*) AS n, max(ts) AS latest FROM firsts WHERE entity IS NOT NULL GROUP BY ALL)"""

ORACLES = {
    "p2_found": f"""WITH {_ROLES}, totals AS (SELECT role, count(*) AS total FROM roles GROUP BY role)
SELECT role, entity FROM roles JOIN totals USING (role) WHERE entity IS NOT NULL GROUP BY role, entity, total HAVING count(*) > 0.01 * total""",
    "p2_entity_rows": f"WITH {_ROLES} SELECT role, entity, count(*) AS n FROM roles WHERE entity IS NOT NULL GROUP BY role, entity",
    "p2_pivot_rank": f"""WITH r AS (SELECT {sql_entity('destination_entity')} AS entity, count(*) AS received FROM unified_event GROUP BY 1),
s AS (SELECT {sql_entity('source_entity')} AS entity, event_category, count(*) AS sent FROM unified_event GROUP BY 1, 2)
SELECT s.entity, event_category, sent, coalesce(received, 0) AS received FROM s LEFT JOIN r ON s.entity = r.entity WHERE s.entity IS NOT NULL""",
    "p3_found": f"WITH {_QUADS} SELECT DISTINCT line_id, reason FROM judged WHERE reason IS NOT NULL",
    "p3_quads": f"WITH {_QUADS} SELECT line_id, timestamp, src_node, dst_node, action_state, source_file FROM judged WHERE reason IS NULL",
    "p4_feature_cells": f"""WITH {_TYPE_COUNTS}, everything AS (SELECT * FROM counts UNION ALL SELECT entity, '(all)', sum(n)::BIGINT, max(latest) FROM counts GROUP BY entity)
SELECT entity, event_type, n, latest, (SELECT max(ts) FROM unified_event) - latest AS since FROM everything""",
    "p4_entity_type_counts": f"WITH {_TYPE_COUNTS} SELECT * FROM counts",
}


def features_sql(types: list[str]) -> str:
    """The feature table's SQL with an explicit list of types, as the pivot has one."""
    columns = []
    for t in types:
        own, name = t.replace("'", "''"), t.replace('"', '""')
        columns += [f"""coalesce(list_extract(ns, list_position(kinds, '{own}')), 0) AS "{name}_n\"""", f"""list_extract(times, list_position(kinds, '{own}')) AS "{name}_latest\"""", f"""newest - list_extract(times, list_position(kinds, '{own}')) AS "{name}_since\""""]
    return f"""WITH {_TYPE_COUNTS}, everything AS (SELECT * FROM counts UNION ALL SELECT entity, '(all)', sum(n)::BIGINT, max(latest) FROM counts GROUP BY entity),
lists AS MATERIALIZED (SELECT entity, list(event_type ORDER BY event_type) AS kinds, list(n ORDER BY event_type) AS ns, list(latest ORDER BY event_type) AS times, (SELECT max(ts) FROM unified_event) AS newest FROM everything GROUP BY entity)
SELECT entity, {', '.join(columns)} FROM lists"""


def oracles(events: str = "/root/testdata/sf0.01/unified_event.parquet") -> dict[str, str]:
    """ORACLES, and the feature table's SQL with the types of the table it is compared on, where that is there."""
    import pyarrow.compute as pc
    import pyarrow.parquet as pq

    if not Path(events).exists():
        return ORACLES
    types = pc.unique(pc.fill_null(pq.read_table(events, columns=["event_type"]).column(0), NO_TYPE)).to_pylist()
    return ORACLES | {"p4_entity_features": features_sql([*sorted(types), ALL_TYPES])}
