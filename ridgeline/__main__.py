"""Command line: ``python -m ridgeline COMMAND --config FILE ...``; ``toy`` needs no data."""

from __future__ import annotations

import argparse
import dataclasses
import json
import tempfile
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ridgeline.operators.model import Fit
from ridgeline.operators.windows import windows_document, windows_markdown
from ridgeline.plans import pipeline
from ridgeline.session import local_session
from ridgeline.sources import ingest
from ridgeline.sources.toy import PIVOT, TOY_THRESHOLDS, toy_events

_STORAGE = ("category_no", "file_no", "file_name", "row_no")
ORDERS = {"storage": _STORAGE, "ts": ("ts", *_STORAGE)}


def _parser() -> argparse.ArgumentParser:
    parser = argparse.ArgumentParser(prog="ridgeline", description=__doc__)
    commands = parser.add_subparsers(dest="command", required=True)
    for name in ("preprocess", "windows", "stats", "benchmark", "stability", "ablation", "toy"):
        c = commands.add_parser(name)
        c.add_argument("--config", required=name != "toy")
        c.add_argument("--out", help="output folder instead of the config's")
        c.add_argument("--order", choices=ORDERS, default="ts", help="order in which events are read")
        if name == "preprocess":
            c.add_argument("--raw-dir", required=True)
            c.add_argument("--rows-per-part", type=int, default=5_000_000)
            c.add_argument("--quads-dir", help="folder of the quad parts")
            c.add_argument("--cleaned-dir", help="folder of the events")
            for step in ("prepare", "clean", "vocabulary"):
                c.add_argument(f"--skip-{step}", action="store_true")
            for log in ingest.OPTIONAL:
                c.add_argument(f"--include-{log}", action="store_true")
        c.add_argument("--strict", action="store_true", help="a damaged time or alert ends the job")
        if name != "preprocess":
            c.add_argument("--max-files", type=int, help="read the first files of each category only")
        if name == "windows":
            c.add_argument("--kind", choices=("adaptive", "fixed"), default="adaptive")
            c.add_argument("--events-per-window", type=int, default=2_000_000)
            c.add_argument("--categories", type=lambda v: tuple(v.split(",")), default=("AUTH",))
        if name == "ablation":
            c.add_argument("--fixed-windows", help="output folder of fixed-event windows, for the windowing study")
        if name in ("benchmark", "stability", "ablation", "toy"):
            c.add_argument("--limit", type=int)
            c.add_argument("--seeds", type=lambda v: tuple(int(x) for x in v.split(",")))
            c.add_argument("--epochs", type=int)
    return parser


def _config(args: argparse.Namespace) -> tuple[pipeline.Config, str]:
    document = json.loads(Path(args.config).read_text())
    config = pipeline.config_from(document)
    changes = {"output": args.out or config.output, "order": ORDERS[args.order]}
    changes |= {k: v for k in ("limit", "seeds") if (v := getattr(args, k, None)) is not None}
    if getattr(args, "epochs", None):
        changes["fit"] = dataclasses.replace(config.fit, epochs=args.epochs)
    return dataclasses.replace(config, **changes), document.get("data_root", "data")


def _events(spark: SparkSession, root: str, max_files: int | None) -> DataFrame:
    return ingest.read_events(spark, f"{root}/events", max_files=max_files).withColumn("event_id", F.xxhash64("file_name", "row_no"))


def main(argv: list[str] | None = None, spark: SparkSession | None = None) -> None:
    args = _parser().parse_args(argv)
    spark = spark or SparkSession.getActiveSession() or local_session("*")
    if args.command == "toy":
        config = pipeline.Config(TOY_THRESHOLDS, args.out or tempfile.mkdtemp(), Fit(epochs=args.epochs or 20), args.seeds or (42,), pivots=(PIVOT,), limit=args.limit)
        events = toy_events(spark)
        found = pipeline.build_windows(events, config)
        print(windows_markdown(found))
        pipeline.benchmark(events, found, config)[0].show(truncate=False)
        return
    config, root = _config(args)
    if args.command == "preprocess":
        raw = {c: f"{args.raw_dir}/{c}.txt" for c in ingest.CONVERTERS}
        skip = [x for x in ("prepare", "clean", "vocabulary") if getattr(args, f"skip_{x}")]
        include = [x for x in ingest.OPTIONAL if getattr(args, f"include_{x}")]
        print(json.dumps(pipeline.preprocess(spark, raw, root, args.rows_per_part, args.quads_dir, args.cleaned_dir, include, skip, args.strict), indent=2))
        return
    events, store = _events(spark, root, args.max_files), f"{config.output}/windows.parquet"
    if args.command == "windows":
        found = pipeline.build_windows(events, config, args.kind, args.events_per_window, args.categories, args.strict)
        found.write.mode("overwrite").parquet(store)
        scanned = events.filter(F.col("event_category").isin(*args.categories)).count()
        ingest.save_json(windows_document(found, args.kind, dataclasses.asdict(config.thresholds), scanned), f"{config.output}/windows.json")
        Path(config.output, "windows.md").write_text(windows_markdown(found) + "\n")
        return
    found = spark.read.parquet(store)
    stored = ingest.load_json(f"{root}/feature_names.json")
    ports = [(k, int(p)) for p, k in stored["port_index"].items()] if stored else []
    vocabulary = spark.createDataFrame(ports, "port_idx int, port bigint") if ports else None
    if args.command == "stats":
        report = pipeline.window_report(found, config.pivots)
        ingest.save_json(report, f"{config.output}/window_stats.json")
        Path(config.output, "window_stats.md").write_text(pipeline.report_markdown(report, found.count(), found.filter("has_attack").count()) + "\n")
    elif args.command == "benchmark":
        results, summary, failed = pipeline.benchmark(events, found, config, vocabulary)
        ingest.save_json({"windows": [r.asDict() for r in results.collect()], "summary": summary.first().asDict(), "failed": [r.asDict() for r in failed.collect()]}, f"{config.output}/benchmark.json")
    elif args.command == "stability":
        reports = pipeline.stability(events, found, config, vocabulary)
        for name, frame in reports.items():
            (frame.drop("embedding") if "embedding" in frame.columns else frame).write.mode("overwrite").parquet(f"{config.output}/stability_{name}.parquet")
    else:
        fixed = spark.read.parquet(f"{args.fixed_windows}/windows.parquet") if args.fixed_windows else None
        pipeline.ablation(events, found, config, vocabulary, fixed).write.mode("overwrite").parquet(f"{config.output}/ablation.parquet")


if __name__ == "__main__":
    main()
