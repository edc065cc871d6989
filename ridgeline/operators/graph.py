"""Host graphs of windows: micro-slices, edges with features, nodes with features, weights and labels.

Every frame holds all windows, keyed by window_idx; ``placed`` means window events: window_idx, ts, source_entity,
destination_entity and, where features need it, event_detail.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ridgeline.functions.parsers import detail_field, port_number

# Names of the auth features, and the ports used where no vocabulary was built.
AUTH_FEATURES = ("is_auth", "status_success", "proto_NTLM", "proto_Kerberos", "proto_Negotiate", "proto_unknown")
KNOWN_PROTOCOLS = ("NTLM", "Kerberos", "Negotiate")
DEFAULT_PORTS = (445, 389, 80, 88, 139, 135, 443, 22, 1433, 2049, 111, 161, 7002, 6002, 137, 3306, 1241, 8080, 8081, 1094, 427, 53, 2989, 2432, 1300, 3493, 2000, 1434, 1109, 2010)

SLICES, LEAST_CATEGORY = 4, 5
# Fixed value: weight of the one feature that is no category.
LOG_COUNT_WEIGHT = 0.5
PAIR = ("window_idx", "source_entity", "destination_entity")


def port_vocabulary(flows: DataFrame, order: Sequence[str], top: int = 30) -> DataFrame:
    """(port_idx, port, n): the most frequent numbers among source and destination ports; ties go to the first seen."""
    ports = flows.select(F.struct(*order).alias("o"), F.posexplode(F.array(port_number(detail_field(F.col("event_detail"), "src_port")), port_number(detail_field(F.col("event_detail"), "dst_port")))).alias("k", "port"))
    counted = ports.filter(F.col("port").isNotNull()).groupBy("port").agg(F.count(F.lit(1)).alias("n"), F.min(F.struct("o", "k")).alias("first"))
    best = counted.orderBy(F.desc("n"), "first").limit(top)
    return best.select((F.row_number().over(Window.orderBy(F.desc("n"), "first")) - 1).alias("port_idx"), "port", "n")


def default_vocabulary(spark) -> DataFrame:
    return spark.createDataFrame(list(enumerate(DEFAULT_PORTS)), "port_idx int, port bigint")


def vocabulary_document(vocabulary: DataFrame, flow_events: int) -> dict[str, object]:
    """The vocabulary as a JSON document."""
    rows = vocabulary.orderBy("port_idx").collect()
    names = [f"port_{r['port']}" for r in rows]
    return {
        "top_k_ports": len(rows), "auth_features": list(AUTH_FEATURES), "port_features": names, "feature_names": [*AUTH_FEATURES, *names],
        "port_index": {str(r["port"]): r["port_idx"] for r in rows}, "total_flow_events": flow_events,
    }


def slice_bounds(windows: DataFrame, slices: int = SLICES) -> DataFrame:
    """(window_idx, slice, slice_start, slice_end): half-open parts of equal width, starts cut to whole seconds.

    Windows without duration have none; an event at a window's very end lies in none.
    """
    width = (F.col("ts_end") - F.col("ts_start")) / F.lit(float(slices))
    at = lambda j: F.col("ts_start") + (j * width).cast("bigint")
    return windows.filter(F.col("ts_end") > F.col("ts_start")).select(
        F.col("idx").alias("window_idx"), F.explode(F.transform(F.sequence(F.lit(0), F.lit(slices - 1)), lambda j: F.struct(j.alias("slice"), at(j).alias("slice_start"), at(j + 1).alias("slice_end")))).alias("s")
    ).select("window_idx", "s.slice", "s.slice_start", "s.slice_end")


def sliced(placed: DataFrame, windows: DataFrame, slices: int = SLICES) -> DataFrame:
    """Placed events with their slice; those in no slice drop out.  Windows have few slices, so no bounds are joined."""
    span = windows.filter(F.col("ts_end") > F.col("ts_start")).select(F.col("idx").alias("window_idx"), "ts_start", "ts_end")
    width = (F.col("ts_end") - F.col("ts_start")) / F.lit(float(slices))
    slot = F.lit(0)
    for j in range(1, slices + 1):
        slot = slot + (F.col("ts") >= F.col("ts_start") + (F.lit(j) * width).cast("bigint")).cast("int")
    return placed.join(span, "window_idx").withColumn("slice", slot).filter(F.col("slice") < slices).drop("ts_start", "ts_end")


def pair_cells(placed: DataFrame, windows: DataFrame, slices: int = SLICES, auth: bool = False) -> DataFrame:
    """(window_idx, slice, source_entity, destination_entity, cnt): all that edges and nodes need of the placed events.

    ``slice`` is null for events in none, whose hosts still are nodes.  With ``auth`` the auth features of the events
    come too, so that one exchange of partial counts serves edges, nodes and features.
    """
    span = windows.filter(F.col("ts_end") > F.col("ts_start")).select(F.col("idx").alias("window_idx"), "ts_start", "ts_end")
    width = (F.col("ts_end") - F.col("ts_start")) / F.lit(float(slices))
    slot = F.lit(0)
    for j in range(1, slices + 1):
        slot = slot + (F.col("ts") >= F.col("ts_start") + (F.lit(j) * width).cast("bigint")).cast("int")
    cut = placed.join(span, "window_idx", "left").withColumn("slice", F.when(slot < slices, slot))
    return cut.groupBy("window_idx", "slice", "source_entity", "destination_entity").agg(F.count(F.lit(1)).alias("cnt"), *(_auth_flags() if auth else []))


def cell_edges(cells: DataFrame) -> DataFrame:
    """Slice edges of pair cells."""
    return cells.filter(F.col("slice").isNotNull()).select("window_idx", "slice", "source_entity", "destination_entity", "cnt")


def cell_auth_features(cells: DataFrame) -> DataFrame:
    """The auth features of every pair, from pair cells that hold them."""
    return cells.groupBy(*PAIR).agg(F.lit(1.0).alias("is_auth"), *[F.max(n).alias(n) for n in AUTH_FEATURES[1:]])


def slice_edges(cut: DataFrame) -> DataFrame:
    return cut.groupBy("window_idx", "slice", "source_entity", "destination_entity").agg(F.count(F.lit(1)).alias("cnt"))


def slice_degrees(edges: DataFrame) -> DataFrame:
    """(window_idx, slice, node, out_events, in_events): degrees by events, from slice edges."""
    ends = edges.select("window_idx", "slice", F.explode(F.array(
        F.struct(F.col("source_entity").alias("node"), F.col("cnt").alias("o"), F.lit(0).cast("bigint").alias("i")),
        F.struct(F.col("destination_entity").alias("node"), F.lit(0).cast("bigint").alias("o"), F.col("cnt").alias("i")))).alias("x"))
    return ends.groupBy("window_idx", "slice", "x.node").agg(F.sum("x.o").alias("out_events"), F.sum("x.i").alias("in_events"))


def slice_counts(edges: DataFrame) -> DataFrame:
    """(window_idx, slice, n_events, n_pairs, n_sources, n_dests) of slice edges."""
    nodes = slice_degrees(edges).groupBy("window_idx", "slice").agg(F.count_if(F.col("out_events") > 0).alias("n_sources"), F.count_if(F.col("in_events") > 0).alias("n_dests"))
    return edges.groupBy("window_idx", "slice").agg(F.sum("cnt").alias("n_events"), F.count(F.lit(1)).alias("n_pairs")).join(nodes, ["window_idx", "slice"])


def window_edges(edges: DataFrame, slices: int = SLICES) -> DataFrame:
    """One row for each pair of a window: cnt, occ_0.. (0 or 1 in each slice) and mcount_0.. (log1p of its events there)."""
    each = [F.sum(F.when(F.col("slice") == j, F.col("cnt")).otherwise(0)).alias(f"c{j}") for j in range(slices)]
    wide = edges.groupBy(*PAIR).agg(F.sum("cnt").alias("cnt"), *each)
    return wide.select(*PAIR, "cnt", *[(F.col(f"c{j}") > 0).cast("double").alias(f"occ_{j}") for j in range(slices)], *[F.log1p(f"c{j}").alias(f"mcount_{j}") for j in range(slices)])


def _auth_flags() -> list[Column]:
    status, protocol = detail_field(F.col("event_detail"), "status", "?"), detail_field(F.col("event_detail"), "protocol", "?")
    flag = lambda c: F.max(c.cast("int")).cast("double")
    known = [flag(protocol == p).alias(f"proto_{p}") for p in KNOWN_PROTOCOLS]
    return [flag(status == "Success").alias("status_success"), *known, flag(~protocol.isin(*KNOWN_PROTOCOLS)).alias("proto_unknown")]


def auth_features(placed: DataFrame) -> DataFrame:
    """The auth features of every pair, from the status and protocol of its events (damaged details count as unknown)."""
    return placed.groupBy(*PAIR).agg(F.lit(1.0).alias("is_auth"), *_auth_flags())


def port_features(flows: DataFrame, vocabulary: DataFrame, size: int = 30) -> DataFrame:
    """port_0.. of every pair: 1 where a flow in the window uses the vocabulary's port on either side."""
    ports = flows.select(*PAIR, F.explode(F.array(port_number(detail_field(F.col("event_detail"), "src_port")), port_number(detail_field(F.col("event_detail"), "dst_port")))).alias("port"))
    small = F.broadcast(vocabulary.filter(F.col("port_idx") < size).select("port", "port_idx"))
    found = ports.join(small, "port").groupBy(*PAIR).agg(F.bit_or(F.expr("shiftleft(1L, port_idx)")).alias("mask"))
    return found.select(*PAIR, *[F.expr(f"cast(mask >> {k} & 1 as double)").alias(f"port_{k}") for k in range(size)])


def edge_features(edges: DataFrame, auth: DataFrame, ports: DataFrame, size: int = 30) -> DataFrame:
    """Window edges with 6 auth, ``size`` port features and log_count; pairs without any get zeros."""
    joined = edges.join(auth, list(PAIR), "left").join(ports, list(PAIR), "left")
    names = [*AUTH_FEATURES, *(f"port_{k}" for k in range(size))]
    return joined.withColumns({n: F.coalesce(n, F.lit(0.0)) for n in names}).withColumn("log_count", F.log1p("cnt"))


def feature_names(size: int = 30) -> list[str]:
    return [*AUTH_FEATURES, *(f"port_{k}" for k in range(size))]


def window_nodes(placed: DataFrame) -> DataFrame:
    """(window_idx, node, node_id): every host of a window's events, numbered in byte order."""
    ends = placed.select("window_idx", F.explode(F.array("source_entity", "destination_entity")).alias("node")).distinct()
    return ends.withColumn("node_id", F.row_number().over(Window.partitionBy("window_idx").orderBy("node")) - 1)


def node_degrees(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """Nodes with out_deg and in_deg by distinct pairs; nodes without edges get 0."""
    ends = edges.select("window_idx", F.explode(F.array(
        F.struct(F.col("source_entity").alias("node"), F.lit(1).alias("o"), F.lit(0).alias("i")),
        F.struct(F.col("destination_entity").alias("node"), F.lit(0).alias("o"), F.lit(1).alias("i")))).alias("x"))
    degrees = ends.groupBy("window_idx", "x.node").agg(F.sum("x.o").alias("out_deg"), F.sum("x.i").alias("in_deg"))
    joined = nodes.join(degrees, ["window_idx", "node"], "left")
    return joined.withColumns({c: F.coalesce(c, F.lit(0)) for c in ("out_deg", "in_deg")})


def acp(out: Column, in_: Column) -> Column:
    """Asymmetry of a node: out / (in + 1)."""
    return out / (in_ + F.lit(1.0))


def _zscores(df: DataFrame, names: Sequence[str], by: str = "window_idx") -> DataFrame:
    """Columns less their mean, over their population deviation (1 where that is 0), within each window."""
    stats = df.groupBy(by).agg(*[F.avg(n).alias(f"__m_{n}") for n in names], *[F.stddev_pop(n).alias(f"__s_{n}") for n in names])
    scaled = {n: (F.col(n) - F.col(f"__m_{n}")) / F.when(F.col(f"__s_{n}") > 1e-12, F.col(f"__s_{n}")).otherwise(1.0) for n in names}
    return df.join(stats, by).withColumns(scaled).drop(*[f"__{k}_{n}" for n in names for k in "ms"])


def node_features(nodes: DataFrame, scaled: bool = True) -> DataFrame:
    """Degrees with the eight features x0..x7, as z-scores within the window unless not ``scaled``; x2 is always 0."""
    top = nodes.groupBy("window_idx").agg(F.greatest(F.max("in_deg"), F.lit(1)).alias("__in"), F.greatest(F.log1p(F.max("in_deg")), F.lit(1.0)).alias("__lin"), F.greatest(F.log1p(F.max("out_deg")), F.lit(1.0)).alias("__lout"))
    o, i = F.col("out_deg"), F.col("in_deg")
    raw = nodes.join(top, "window_idx").withColumns(
        {
            "x0": F.log1p(i), "x1": F.log1p(o), "x2": F.lit(0.0), "x3": F.log1p(acp(o, i)), "x4": F.log1p(i / F.col("__in") * 1e7) / 16.0,
            "x5": F.log1p(acp(o, i)) / 12.0, "x6": F.log1p(i) / F.col("__lin"), "x7": F.log1p(o) / F.col("__lout"),
        }
    ).drop("__in", "__lin", "__lout")
    return _zscores(raw, [f"x{k}" for k in range(8)]) if scaled else raw


def degree_targets(nodes: DataFrame) -> DataFrame:
    """(window_idx, node, t_in, t_out): z-scored log degrees."""
    return _zscores(nodes.select("window_idx", "node", F.log1p("in_deg").alias("t_in"), F.log1p("out_deg").alias("t_out")), ["t_in", "t_out"])


def peak_acp(degrees: DataFrame) -> DataFrame:
    """(window_idx, node, acp_peak, acp_full): largest asymmetry of a slice, and that of the summed degrees, by events."""
    o, i = F.col("out_events"), F.col("in_events")
    return degrees.groupBy("window_idx", "node").agg(F.max(acp(o, i)).alias("acp_peak"), acp(F.sum(o), F.sum(i)).alias("acp_full"))


def feature_counts(features: DataFrame, names: Sequence[str]) -> DataFrame:
    """(window_idx, feature, cnt, n_edges) in long form."""
    long = F.explode(F.array(*[F.struct(F.lit(n).alias("feature"), F.col(f"__{n}").alias("cnt")) for n in names])).alias("f")
    sums = features.groupBy("window_idx").agg(F.count(F.lit(1)).alias("n_edges"), *[F.sum(n).alias(f"__{n}") for n in names])
    return sums.select("window_idx", "n_edges", long).select("window_idx", "f.feature", "f.cnt", "n_edges")


def _with_count(rows: DataFrame, name: str, value: Column) -> DataFrame:
    """Rows of the binary features, and one for log_count in every window."""
    return rows.unionByName(rows.select("window_idx").distinct().select("window_idx", F.lit("log_count").alias("feature"), value.alias(name)))


def ief_weights(counts: DataFrame) -> DataFrame:
    """(window_idx, feature, weight): 1 / sqrt(frequency), a feature counting at least once, over the window's mean.

    log_count, which is no category, has the fixed weight LOG_COUNT_WEIGHT.
    """
    raw = F.lit(1.0) / F.sqrt(F.greatest("cnt", F.lit(1.0)) / F.col("n_edges"))
    rows = counts.withColumn("raw", raw).select("window_idx", "feature", (F.col("raw") / F.avg("raw").over(Window.partitionBy("window_idx"))).alias("weight"))
    return _with_count(rows, "weight", F.lit(LOG_COUNT_WEIGHT))


def category_mask(counts: DataFrame, least: int = LEAST_CATEGORY) -> DataFrame:
    """(window_idx, feature, active): features that enough edges have; log_count always is active."""
    return _with_count(counts.select("window_idx", "feature", (F.col("cnt") >= least).cast("int").alias("active")), "active", F.lit(1))


def active_categories(counts: DataFrame, least: int = LEAST_CATEGORY) -> DataFrame:
    """(window_idx, active, total, ratio) of the binary features."""
    return category_mask(counts, least).filter(F.col("feature") != "log_count").groupBy("window_idx").agg(F.sum("active").alias("active"), F.count(F.lit(1)).alias("total"), F.avg("active").alias("ratio"))


def occupancy_report(edges: DataFrame, slices: int = SLICES) -> DataFrame:
    """(window_idx, pct_sparse, pct_full): edges seen in at most a quarter, and in all, of the slices."""
    mean = sum((F.col(f"occ_{j}") for j in range(slices)), F.lit(0.0)) / slices
    return edges.groupBy("window_idx").agg((F.avg((mean <= 0.25).cast("double")) * 100).alias("pct_sparse"), (F.avg((mean >= 1.0).cast("double")) * 100).alias("pct_full"))


def labels(nodes: DataFrame, windows: DataFrame) -> DataFrame:
    """(window_idx, node, label): 1 for the pivots of the window among its nodes."""
    pivots = windows.select(F.col("idx").alias("window_idx"), F.explode("attack_pivots").alias("node")).distinct().withColumn("label", F.lit(1))
    return nodes.select("window_idx", "node").join(pivots, ["window_idx", "node"], "left").withColumn("label", F.coalesce("label", F.lit(0)))


def rate_report(counts: DataFrame, bounds: DataFrame) -> DataFrame:
    """(window_idx, slice, events_per_second) with a duration of at least a second."""
    rate = F.col("n_events") / F.greatest(F.col("slice_end") - F.col("slice_start"), F.lit(1))
    return counts.join(bounds, ["window_idx", "slice"]).select("window_idx", "slice", rate.alias("events_per_second"))
