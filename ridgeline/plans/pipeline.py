"""Whole runs: raw logs to events, events to windows, windows to scores and reports."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ridgeline.operators import evaluate, graph, model, rank, windows
from ridgeline.operators.windows import Thresholds
from ridgeline.session import cut_lineage
from ridgeline.sources import ingest


@dataclass(frozen=True)
class Config:
    """Settings of a run; every one of them is honoured by the functions below."""

    thresholds: Thresholds
    output: str = "output"
    fit: model.Fit = field(default_factory=model.Fit)
    seeds: tuple[int, ...] = (42, 123, 456)
    fusion: tuple[float, float, float] = (0.60, 0.0, 0.40)
    pivots: tuple[str, ...] = ()
    slices: int = graph.SLICES
    order: tuple[str, ...] = ("ts", "event_id")
    limit: int | None = None


@dataclass(frozen=True)
class Graphs:
    """Nodes with features, edges with features, and labels of all windows."""

    nodes: DataFrame
    edges: DataFrame
    labels: DataFrame


def config_from(document: dict) -> Config:
    """Config of a JSON document with thresholds, training, seeds, pivots and output_root."""
    t, training = document["thresholds"], dict(document.get("training", {}))
    fusion = tuple(training.pop(k, d) for k, d in (("fusion_alpha", 0.6), ("fusion_beta", 0.0), ("fusion_delta", 0.4)))
    return Config(
        Thresholds(t["M_min"], t["E_min"], t["V_min_src"], t["V_min_dst"]), document.get("output_root", "output"), model.Fit(**training),
        tuple(document.get("seeds", (42, 123, 456))), fusion, tuple(document.get("pivots", ())),
    )


def preprocess(
    spark: SparkSession, raw: dict[str, str], folder: str, rows_per_part: int = 5_000_000, quads: str | None = None, events: str | None = None,
    include: Sequence[str] = (), skip: Sequence[str] = (), strict: bool = False,
) -> dict[str, object]:
    """Raw logs to quad parts, to events in Parquet, and to the port vocabulary; counts of what was written.

    ``quads`` and ``events`` are the folders in between, by default below ``folder``.  Every category that has quad
    parts there is cleaned, DNS and process events only if ``include`` names them.  ``skip`` leaves out steps:
    ``prepare``, ``clean``, ``vocabulary``; the later ones read what is stored.
    """
    quads, events = quads or f"{folder}/quads", events or f"{folder}/events"
    report: dict[str, object] = {}
    if "prepare" not in skip:
        report["prepared"] = ingest.prepare(spark, raw, quads, rows_per_part)
    if "clean" not in skip:
        wanted = [c for c in ingest.CLEANERS if c in include or c not in ingest.OPTIONAL]
        there = [c for c in wanted if ingest.has_rows(spark, f"{quads}/{c}")]
        if there:
            rows = ingest.read_quads(spark, f"{quads}/{there[0]}")
            for c in there[1:]:
                rows = rows.unionByName(ingest.read_quads(spark, f"{quads}/{c}"))
            ingest.write_events(ingest.clean_quads(rows, tuple(there), strict), events)
            report["cleaning"] = [r.asDict() for r in ingest.cleaning_counts(rows).collect()]
    if "vocabulary" not in skip and ingest.has_rows(spark, events):
        flows = ingest.read_events(spark, events, ("FLOW",))
        count = flows.count()
        if count:
            vocabulary = graph.port_vocabulary(flows, ["file_no", "file_name", "row_no"])
            ingest.save_json(graph.vocabulary_document(vocabulary, count), f"{folder}/feature_names.json")
    return report


def alerts_of(events: DataFrame, strict: bool = False) -> DataFrame:
    """(alert_id, ts, pivot) of the alerts: the detail's pivot_machine, else ``unknown``.

    A damaged detail counts as one without a pivot, or ends the job if ``strict``.
    """
    detail = F.parse_json("event_detail") if strict else F.try_parse_json("event_detail")
    pivot = F.coalesce(F.try_variant_get(detail, "$.pivot_machine", "string"), F.lit("unknown"))
    return events.filter(F.col("event_category") == "ALERT").select(F.col("event_id").alias("alert_id"), "ts", pivot.alias("pivot"))


def build_windows(events: DataFrame, config: Config, kind: str = "adaptive", events_per_window: int = 2_000_000, categories: Sequence[str] = ("AUTH",), strict: bool = False) -> DataFrame:
    """Adaptive or fixed-event windows of the events, with the attacks that the alerts name."""
    stream = events.filter(F.col("event_category").isin(*categories))
    if kind == "adaptive":
        found = windows.adaptive_windows(stream, config.thresholds, list(config.order))
    else:
        found = windows.fixed_event_windows(stream, events_per_window, list(config.order))
    return cut_lineage(windows.annotate_attacks(found, alerts_of(events, strict)))


def build_graphs(events: DataFrame, found: DataFrame, vocabulary: DataFrame | None = None, slices: int = graph.SLICES) -> Graphs:
    """Graphs of all windows in one plan; windows without duration have none."""
    usable = found.filter(F.col("ts_end") > F.col("ts_start"))
    own = ["ts", "source_entity", "destination_entity", "event_detail"]
    placed = windows.window_events(events.filter(F.col("event_category") == "AUTH").select(*own), usable)
    flows = windows.window_events(events.filter(F.col("event_category") == "FLOW").select(*own), usable)
    words = vocabulary if vocabulary is not None else graph.default_vocabulary(events.sparkSession)
    cells = cut_lineage(graph.pair_cells(placed, usable, slices, auth=True))
    edges = graph.window_edges(graph.cell_edges(cells), slices)
    featured = cut_lineage(graph.edge_features(edges, graph.cell_auth_features(cells), graph.port_features(flows, words)))
    nodes = cut_lineage(graph.node_features(graph.node_degrees(graph.window_nodes(cells), featured)))
    return Graphs(nodes, featured, graph.labels(nodes, usable))


def score(graphs: Graphs, config: Config, seeds: Sequence[int] | None = None, objectives: Sequence[tuple[float, float]] | None = None) -> DataFrame:
    """Fitted scores of every node, with the fused score, degrees and label."""
    objective = [(config.fit.lambda_deg, config.fit.lambda_pr)]
    fitted = model.train_scores(graphs.nodes, graphs.edges, graph.feature_names(), seeds or config.seeds, objectives or objective, config.fit)
    joined = fitted.withColumn("score", rank.fused(*config.fusion)).join(graphs.labels, ["window_idx", "node"], "left")
    return cut_lineage(joined.join(graphs.nodes.select("window_idx", "node", "out_deg", "in_deg"), ["window_idx", "node"], "left"))


def failures(scored: DataFrame) -> DataFrame:
    """(window_idx, seed, lambda_deg, lambda_pr, error) of the fits that failed."""
    return scored.filter(F.col("error").isNotNull()).select("window_idx", "seed", "lambda_deg", "lambda_pr", "error")


def benchmark(events: DataFrame, found: DataFrame, config: Config, vocabulary: DataFrame | None = None) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Precision of every attack window over the seeds, the summary, and this run's failed fits.

    Results are kept below the output folder, one row for each window; windows with stored results are not fitted
    again.  A window of which any fit failed has no result, as a mean over fewer seeds would look like one: it is fitted
    again by the next run.
    """
    spark, store = events.sparkSession, f"{config.output}/benchmark.parquet"
    attacked = found.filter("has_attack")
    done = spark.read.parquet(store) if ingest.has_rows(spark, store) else None
    todo = evaluate.unfinished(attacked, done) if done is not None else attacked
    if config.limit is not None:
        todo = todo.orderBy("idx").limit(config.limit)
    todo = cut_lineage(todo)
    failed = spark.createDataFrame([], "window_idx bigint, seed int, lambda_deg double, lambda_pr double, error string")
    if not todo.isEmpty():
        every = score(build_graphs(events, todo, vocabulary, config.slices), config)
        failed = failures(every)
        scored = every.join(F.broadcast(failed.select("window_idx").distinct()), "window_idx", "left_anti")
        aps = evaluate.average_precision(scored, ("window_idx", "seed"))
        ranks = scored.withColumn("rank", F.rank().over(rank.Window.partitionBy("window_idx", "seed").orderBy(F.desc("score")))).filter(F.col("label") == 1)
        best = ranks.groupBy("window_idx", "node").agg(F.min("rank").alias("best")).groupBy("window_idx").agg(F.map_from_entries(F.sort_array(F.collect_list(F.struct("node", "best")))).alias("per_pivot"))
        sizes = scored.groupBy("window_idx").agg(F.count_distinct("node").alias("nodes"), F.avg("train_s").alias("train_s_mean"))
        evaluate.seed_summary(aps).join(sizes, "window_idx").join(best, "window_idx", "left").write.mode("append").parquet(store)
    results = spark.read.parquet(store) if ingest.has_rows(spark, store) else spark.createDataFrame([], "window_idx bigint, ap_mean double")
    return results.orderBy("window_idx"), evaluate.ap_summary(results.withColumnRenamed("ap_mean", "ap")), failed


def stability(events: DataFrame, found: DataFrame, config: Config, vocabulary: DataFrame | None = None, top: int = 200) -> dict[str, DataFrame]:
    """Reports over the quiet windows: candidates, leaders, persistent hosts, overlaps, ranks of the given hosts, and one
    row of summary (windows, leaders, mean overlap and its pairs, persistent hosts, failed fits)."""
    quiet = found.filter(~F.col("has_attack"))
    if config.limit is not None:
        quiet = quiet.orderBy("idx").limit(config.limit)
    every = score(build_graphs(events, quiet, vocabulary, config.slices), config, seeds=config.seeds[:1])
    scored = every.filter(F.col("error").isNull())
    best = cut_lineage(evaluate.top_candidates(scored, top))
    hosts = events.sparkSession.createDataFrame([(p,) for p in config.pivots], "node string")
    seen = cut_lineage(scored.select("window_idx").distinct())
    overlap, persistent = evaluate.adjacent_jaccard(best, windows=seen), evaluate.persistent_hosts(best)
    counts = seen.agg(F.count(F.lit(1)).alias("windows"))
    for part in (
        best.filter(F.col("rn") == 1).agg(F.count_distinct("node").alias("leaders")),
        evaluate.overlap_summary(overlap).select(F.col("mean").alias("top50_jaccard_mean"), F.col("pairs").alias("top50_jaccard_pairs")),
        persistent.agg(F.count(F.lit(1)).alias("persistent_hosts")), failures(every).agg(F.count(F.lit(1)).alias("failed")),
    ):
        counts = counts.join(F.broadcast(part), F.lit(True))  # one row each
    return {
        "top": best, "leaders": evaluate.top1_frequency(best), "persistent": persistent, "overlap": overlap,
        "pivots": evaluate.host_ranks(scored, hosts), "summary": counts, "failures": failures(every),
    }


def ablation(events: DataFrame, found: DataFrame, config: Config, vocabulary: DataFrame | None = None, fixed: DataFrame | None = None) -> DataFrame:
    """(study, config, mean AP and counts) over the attack windows: one fit for each pair of loss weights.

    ``fixed`` are fixed-event windows for the fourth study, windowing, in which they are scored like the adaptive ones.
    ``failed`` counts the failed fits of a study's windows.
    """
    aps, failed = [], []
    for windows_of, objectives in ((found, list(evaluate.OBJECTIVES.values())), (fixed, [evaluate.OBJECTIVES["unified"]])):
        if windows_of is None:
            continue
        attacked = windows_of.filter("has_attack")
        if config.limit is not None:
            attacked = attacked.orderBy("idx").limit(config.limit)
        graphs = build_graphs(events, attacked, vocabulary, config.slices)
        every = score(graphs, config, objectives=objectives)
        scores = evaluate.ablation_scores(every.filter(F.col("error").isNull()))
        if windows_of is fixed:
            scores = scores.filter((F.col("study") == "signal") & (F.col("config") == "A+R")).withColumn("study", F.lit("windowing")).withColumn("config", F.lit("fixed-event"))
        aps.append(evaluate.average_precision(scores.join(graphs.labels, ["window_idx", "node"]), ("study", "config", "window_idx", "seed")))
        failed.append(failures(every).count())
    out = None
    for own, n in zip(aps, failed, strict=True):
        part = own.groupBy("study", "config").agg(F.avg("ap").alias("mean"), F.max("ap").alias("max"), F.min("ap").alias("min"), F.count_distinct("window_idx").alias("windows")).withColumn("failed", F.lit(n))
        out = part if out is None else out.unionByName(part)
    return out


def window_report(found: DataFrame, pivots: Sequence[str] = ()) -> dict[str, object]:
    """Quartiles of events, hours, pairs, sources and destinations, and the windows of each pivot."""
    hours = (F.col("ts_end") - F.col("ts_start")) / 3600.0
    measures = {"m": F.col("m"), "hours": hours} | {c: F.col(c) for c in ("e", "v_src", "v_dst", "v_total") if c in found.columns}
    coverage = {r["pivot"]: r["idxs"] for r in windows.pivot_coverage(found).collect()}
    return {"quartiles": {n: windows.quartiles(found, c).first().asDict() for n, c in measures.items()}, "coverage": {p: coverage.get(p, []) for p in pivots} if pivots else coverage}


def report_markdown(report: dict[str, object], total: int, attacked: int) -> str:
    """The window report as Markdown: counts, quartiles of each measure, and the windows of each pivot."""
    shown = {"hours": "Duration (h)", "m": "Events", "e": "Pairs", "v_src": "Sources", "v_dst": "Destinations", "v_total": "Hosts"}
    lines = ["# Windows", "", f"- Windows: {total}", f"- With attack: {attacked} ({100 * attacked / max(total, 1):.1f} %)", "", "| Measure | Min | Q1 | Median | Q3 | Max | Mean |", "|---|---|---|---|---|---|---|"]
    for name, title in shown.items():
        q = report["quartiles"].get(name)
        if q and q["n"]:
            digits = 1 if name == "hours" else 0
            lines.append(f"| {title} | " + " | ".join(f"{q[k]:,.{digits}f}" for k in ("min", "q1", "median", "q3", "max", "mean")) + " |")
    lines += ["", "## Pivots", "", *(f"- {p}: {len(w)} windows {w}" for p, w in report["coverage"].items())]
    return "\n".join(lines)
