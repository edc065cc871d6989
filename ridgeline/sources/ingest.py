"""From raw text over five-column quads to unified events, and back to files."""

from __future__ import annotations

import json
from collections.abc import Callable
from pathlib import Path

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ridgeline.functions.names import account_part, domain_part, machine_part, normalize_node
from ridgeline.functions.parsers import auth_fields, flow_fields, is_noise_flow, pivot_machine, proc_action

QUAD_COLUMNS = ("timestamp", "src_node", "dst_node", "action_state", "source_file")
QUAD_SCHEMA = T.StructType([T.StructField(c, T.StringType()) for c in QUAD_COLUMNS])
EVENT_COLUMNS = ("timestamp", "ts", "source_entity", "destination_entity", "event_category", "event_type", "event_detail")
# The order in which categories are read from storage, and the logs that are cleaned only on demand.
CATEGORIES = ("AUTH", "FLOW", "DNS", "PROC", "ALERT")
OPTIONAL = ("dns", "proc")

RowBuilder = Callable[[Column], dict[str, Column]]


def _auth_row(f: Column) -> dict[str, Column]:
    return {"timestamp": f[0], "src_node": F.concat_ws("|", f[1], f[3]), "dst_node": f[4], "action_state": F.concat_ws("_", f[7], f[8], f[6], f[5])}


def _flow_row(f: Column) -> dict[str, Column]:
    return {"timestamp": f[0], "src_node": f[2], "dst_node": f[4], "action_state": F.concat(F.lit("NetFlow_"), f[6], F.lit("_"), f[3], F.lit(">"), f[5])}


def _alert_row(f: Column) -> dict[str, Column]:
    return {"timestamp": f[0], "src_node": f[1], "dst_node": f[3], "action_state": F.concat(F.lit("RedTeam_via_"), f[2])}


#: Least number of fields and row builder of each raw log; add entries to read further logs.
CONVERTERS: dict[str, tuple[int, RowBuilder]] = {"auth": (9, _auth_row), "flows": (7, _flow_row), "redteam": (4, _alert_row)}


def convert_raw(lines: DataFrame, category: str, value: str = "value") -> DataFrame:
    """Quads of raw comma-separated lines; blank lines and lines with too few fields are dropped.

    An unknown ``category`` is a KeyError.
    """
    least, build = CONVERTERS[category]
    text = F.regexp_replace(F.col(value), r"^\s+|\s+$", "")
    fields = lines.select(F.split(text, ",", -1).alias("f")).filter((F.size("f") >= least))
    return fields.select(*[c.alias(n) for n, c in build(F.col("f")).items()], F.lit(category).alias("source_file"))


def read_raw(spark: SparkSession, path: str, category: str) -> DataFrame:
    return convert_raw(spark.read.text(path), category)


def write_quads(quads: DataFrame, folder: str, category: str, rows_per_part: int = 5_000_000) -> None:
    """CSV parts with a header and doubled quotes below ``folder/<category>``, at most ``rows_per_part`` rows each."""
    quads.select(*QUAD_COLUMNS).write.mode("overwrite").option("header", True).option("escape", '"').option("maxRecordsPerFile", rows_per_part).csv(f"{folder}/{category}")


def read_quads(spark: SparkSession, path: str) -> DataFrame:
    """Quads of CSV parts; empty cells are '' and never null."""
    rows = spark.read.schema(QUAD_SCHEMA).option("header", True).option("escape", '"').option("multiLine", True).csv(path)
    return rows.select(*[F.coalesce(c, F.lit("")).alias(c) for c in QUAD_COLUMNS])


def prepare(spark: SparkSession, raw: dict[str, str], folder: str, rows_per_part: int = 5_000_000) -> dict[str, dict[str, object]]:
    """Quads of every raw log in ``raw`` (category to path) as CSV parts; a missing file gives an error entry."""
    done: dict[str, dict[str, object]] = {}
    for category, path in raw.items():
        CONVERTERS[category]  # noqa: B018 - an unknown category is an error before anything is written
        if "://" not in path and not Path(path).exists():
            done[category] = {"error": f"missing file {path}"}
            continue
        write_quads(read_raw(spark, path, category), folder, category, rows_per_part)
        done[category] = {"rows": read_quads(spark, f"{folder}/{category}").count()}
    return done


def _event(category: str, source: Column, destination: Column, detail: dict[str, Column], strict: bool) -> list[Column]:
    """Columns of an event; a timestamp that is no number gives a null ts, or ends the job if ``strict``."""
    stamp = F.col("timestamp")
    number = stamp.try_cast("bigint")
    return [
        stamp.alias("timestamp"),
        (F.when(number.isNull(), F.raise_error(F.concat(F.lit("no time: "), F.coalesce(stamp, F.lit("null")))).cast("bigint")).otherwise(number) if strict else number).alias("ts"),
        source.alias("source_entity"),
        destination.alias("destination_entity"),
        F.lit(category).alias("event_category"),
        F.col("action_state").alias("event_type"),
        F.to_json(F.struct(*[c.alias(n) for n, c in detail.items()])).alias("event_detail"),
    ]


def clean_auth(quads: DataFrame, strict: bool = False) -> DataFrame:
    """Auth events, one for each quad; the detail has the action's parts (or raw), account, domain and machine."""
    node = F.col("src_node")
    detail = auth_fields(F.col("action_state")) | {"account": account_part(node), "account_domain": domain_part(node), "source_machine_raw": machine_part(node)}
    return quads.select(*_event("AUTH", machine_part(node), normalize_node(F.col("dst_node")), detail, strict))


def clean_flows(quads: DataFrame, strict: bool = False, filter_noise: bool = True) -> DataFrame:
    """Flow events without broadcast chatter."""
    kept = quads.filter(~is_noise_flow(F.col("action_state"))) if filter_noise else quads
    return kept.select(*_event("FLOW", normalize_node(F.col("src_node")), normalize_node(F.col("dst_node")), flow_fields(F.col("action_state")), strict))


def clean_dns(quads: DataFrame, strict: bool = False) -> DataFrame:
    return quads.select(*_event("DNS", normalize_node(F.col("src_node")), normalize_node(F.col("dst_node")), {"query": F.lit("DNS_Query")}, strict))


def clean_proc(quads: DataFrame, strict: bool = False, include_self_loops: bool = False) -> DataFrame:
    """Process events; those whose normalised ends are the same are dropped unless wanted."""
    a, b = normalize_node(F.col("src_node")), normalize_node(F.col("dst_node"))
    kept = quads if include_self_loops else quads.filter(a != b)
    return kept.select(*_event("PROC", a, b, {"action": proc_action(F.col("action_state"))}, strict))


def clean_redteam(quads: DataFrame, strict: bool = False) -> DataFrame:
    """Alert events; the source is the pivot host of the action, else the normalised source."""
    action = F.col("action_state")
    pivot = pivot_machine(action)
    detail = {"pivot_machine": pivot, "raw": F.when(pivot.isNull(), F.coalesce(action, F.lit("")))}
    return quads.select(*_event("ALERT", normalize_node(F.coalesce(pivot, F.col("src_node"))), normalize_node(F.col("dst_node")), detail, strict))


CLEANERS: dict[str, Callable[..., DataFrame]] = {"auth": clean_auth, "flows": clean_flows, "dns": clean_dns, "proc": clean_proc, "redteam": clean_redteam}


def cleaning_counts(quads: DataFrame) -> DataFrame:
    """For each source_file: total_in, noise_filtered, self_loops_dropped, total_out, kept_pct."""
    noise = (F.col("source_file") == "flows") & is_noise_flow(F.col("action_state"))
    loop = (F.col("source_file") == "proc") & (normalize_node(F.col("src_node")) == normalize_node(F.col("dst_node")))
    counted = quads.filter(F.col("source_file").isin(*CLEANERS)).groupBy("source_file").agg(
        F.count(F.lit(1)).alias("total_in"), F.count_if(noise).alias("noise_filtered"), F.count_if(loop).alias("self_loops_dropped")
    )
    out = F.col("total_in") - F.col("noise_filtered") - F.col("self_loops_dropped")
    return counted.withColumn("total_out", out).withColumn("kept_pct", F.col("total_out") * 100.0 / F.col("total_in"))


def clean_quads(quads: DataFrame, categories: tuple[str, ...] = ("auth", "flows", "redteam"), strict: bool = False) -> DataFrame:
    """Unified events of the quads whose source_file is one of ``categories``."""
    parts = [CLEANERS[c](quads.filter(F.col("source_file") == c), strict) for c in categories]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def write_events(events: DataFrame, path: str) -> None:
    """Parquet partitioned by category; ts is a number, so that row groups prune by time."""
    events.write.mode("overwrite").partitionBy("event_category").parquet(path)


def has_rows(spark: SparkSession, path: str) -> bool:
    """Whether ``path`` exists, in whatever file system it names."""
    place = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return place.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(place)


def read_events(spark: SparkSession, path: str, categories: tuple[str, ...] | None = None, max_files: int | None = None) -> DataFrame:
    """Events with their storage position: category_no, file_no, file_name and row_no are a total order.

    Categories stand in the order of CATEGORIES; a file's number is that of its name, and files that share one (parts
    split by size) follow by name.  ``max_files`` keeps the first files of each category.
    """
    events = spark.read.parquet(path)
    if categories is not None:
        events = events.filter(F.col("event_category").isin(*categories))
    file = F.col("_metadata.file_path")
    number = F.regexp_extract(file, r"part-?0*(\d+)", 1).try_cast("bigint")
    order = F.array_position(F.array(*[F.lit(c) for c in CATEGORIES]), F.col("event_category"))
    placed = events.withColumns({"category_no": order, "file_no": number, "file_name": file, "row_no": F.col("_metadata.row_index")})
    if max_files is not None:
        ranked = placed.select("event_category", "file_no", "file_name").distinct().withColumn("__k", F.expr("row_number() over (partition by event_category order by file_no, file_name)"))
        placed = placed.join(F.broadcast(ranked.filter(F.col("__k") <= max_files).select("file_name")), "file_name", "left_semi")
    return placed


def save_json(value: object, path: str) -> None:
    Path(path).parent.mkdir(parents=True, exist_ok=True)
    Path(path).write_text(json.dumps(value, indent=2, ensure_ascii=False))


def load_json(path: str, default: object = None) -> object:
    """Value of a JSON file, or ``default`` where it is missing or damaged."""
    try:
        return json.loads(Path(path).read_text())
    except (OSError, ValueError):
        return default
