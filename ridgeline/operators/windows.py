"""Windows over an event stream: adaptive, of fixed event counts, their events, attacks and statistics."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ridgeline.session import cut_lineage

WINDOW_SCHEMA = "idx bigint, ts_start bigint, ts_end bigint, m bigint, e bigint, v_src bigint, v_dst bigint, v_total bigint, is_merged_tail boolean"


@dataclass(frozen=True)
class Thresholds:
    """Least events, pairs, sources and destinations of a window; it closes at the first event where all hold."""

    m: int
    e: int
    v_src: int
    v_dst: int


#: Most events of a piece, the part of the stream that a task reduces to its distinct hashes.
PIECE = 1 << 16
KINDS = ("e", "v_src", "v_dst")


@dataclass(frozen=True)
class Piece:
    """Consecutive events, reduced: the times with the place of the first event of each run of equal ones, and for
    every kind the distinct hashes in order, with the places of their first and last event."""

    n: int
    times: np.ndarray
    time_at: np.ndarray
    hashes: dict[str, tuple[np.ndarray, np.ndarray, np.ndarray]]

    def time(self, place: int) -> int:
        return int(self.times[np.searchsorted(self.time_at, place, side="right") - 1])


def piece_of(ts: np.ndarray, columns: dict[str, np.ndarray]) -> Piece:
    n = len(ts)
    runs = np.flatnonzero(np.concatenate(([True], ts[1:] != ts[:-1])))
    hashes = {}
    for kind in KINDS:
        order = np.argsort(columns[kind], kind="stable")
        own = columns[kind][order]
        first = np.flatnonzero(np.concatenate(([True], own[1:] != own[:-1])))
        hashes[kind] = own[first], order[first], order[np.append(first[1:], n) - 1]
    return Piece(n, ts[runs], runs, hashes)


class Scan:
    """The window being filled, in a stream of pieces of at most ``thresholds.m`` events.

    A window that starts within a piece can't close in it, so all that is needed of a piece is which hashes come
    first, and which are there after a given place.
    """

    def __init__(self, thresholds: Thresholds) -> None:
        self.t = thresholds
        self.m, self.first, self.last, self.idx = 0, 0, 0, 0
        self.seen = {k: np.zeros(0, np.int64) for k in KINDS}

    def _row(self, seen: dict[str, np.ndarray], m: int, last: int) -> list[object]:
        total = len(np.union1d(seen["v_src"], seen["v_dst"]))
        return [self.idx, self.first, last, m, *(len(seen[k]) for k in KINDS), total, False]

    def take(self, piece: Piece) -> list[object] | None:
        """Adds a piece; the window that closes in it, if one does."""
        if self.m == 0:
            self.first = int(piece.times[0])
        fresh, places, close = {}, {}, self.t.m - self.m - 1
        for kind, least in zip(KINDS, (self.t.e, self.t.v_src, self.t.v_dst), strict=True):
            values, first, _ = piece.hashes[kind]
            known = self.seen[kind]
            at = np.searchsorted(known, values)
            new = np.ones(len(values), bool) if not len(known) else known[np.minimum(at, len(known) - 1)] != values
            fresh[kind], places[kind] = new, at
            missing = least - len(known)
            if missing > 0:
                starts = np.sort(first[new])
                close = max(close, int(starts[missing - 1]) if missing <= len(starts) else piece.n)
        close = max(close, 0)
        until = min(close, piece.n - 1)
        seen = {}
        for kind in KINDS:
            values, first, _ = piece.hashes[kind]
            own = fresh[kind] & (first <= until)
            seen[kind] = np.insert(self.seen[kind], places[kind][own], values[own])
        if close >= piece.n:
            self.seen, self.m, self.last = seen, self.m + piece.n, int(piece.times[-1])
            return None
        row = self._row(seen, self.m + close + 1, piece.time(close))
        self.idx += 1
        self.m, self.last = piece.n - close - 1, int(piece.times[-1])
        self.first = piece.time(close + 1) if self.m else 0
        self.seen = {k: piece.hashes[k][0][piece.hashes[k][2] > close] for k in KINDS}
        return row

    def open_row(self) -> list[object]:
        return self._row(self.seen, self.m, self.last)


def scan_windows(pieces: Iterator[Piece], t: Thresholds, merge_tail: bool, tail_ratio: float, tail_pairs: bool) -> Iterator[list[object]]:
    """Rows of WINDOW_SCHEMA from the stream's pieces; the last window is held back for the tail."""
    scan, held = Scan(t), None
    for piece in pieces:
        row = scan.take(piece)
        if row is not None:
            if held is not None:
                yield held
            held = row
    if scan.m and merge_tail and held is not None and scan.m < tail_ratio * t.m:
        held[2], held[3], held[8] = scan.last, held[3] + scan.m, True
        held[4] += len(scan.seen["e"]) if tail_pairs else 0
        yield held
    else:
        if held is not None:
            yield held
        if scan.m:
            yield scan.open_row()


_PIECES = "part int, seq bigint, n int, times binary, time_at binary, " + ", ".join(f"{k} binary, {k}_first binary, {k}_last binary" for k in KINDS)


def stream_pieces(rows: DataFrame, order: list[str], size: int) -> DataFrame:
    """Pieces of at most ``size`` events of the stream in its total order, by part of the sorted stream and place in it.

    ``rows``: the columns of ``order``, ts, e, v_src, v_dst.  The sort and the reduction are distributed; a piece ends
    where a part of the sort ends.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, seq, held = TaskContext.get().partitionId(), 0, {c: np.zeros(0, np.int64) for c in ("ts", *KINDS)}

        def reduced(own: dict[str, np.ndarray]) -> pa.RecordBatch:
            p = piece_of(own["ts"], own)
            values = [p.times, p.time_at.astype(np.int32)] + [x if x.dtype == np.int64 and k == 0 else x.astype(np.int32) for kind in KINDS for k, x in enumerate(p.hashes[kind])]
            return pa.RecordBatch.from_arrays([pa.array([part], pa.int32()), pa.array([seq]), pa.array([p.n], pa.int32()), *(pa.array([x.tobytes()], pa.binary()) for x in values)], names=[c.split()[0] for c in _PIECES.split(", ")])

        for b in batches:
            held = {c: np.concatenate([v, np.asarray(b.column(c))]) for c, v in held.items()}
            while len(held["ts"]) >= size:
                yield reduced({c: v[:size] for c, v in held.items()})
                held, seq = {c: v[size:] for c, v in held.items()}, seq + 1
        if len(held["ts"]):
            yield reduced(held)

    return rows.orderBy(*order).select("ts", *KINDS).mapInArrow(run, _PIECES)


def _read_piece(row: dict[str, object]) -> Piece:
    each = {k: (np.frombuffer(row[k], np.int64), np.frombuffer(row[f"{k}_first"], np.int32), np.frombuffer(row[f"{k}_last"], np.int32)) for k in KINDS}
    return Piece(row["n"], np.frombuffer(row["times"], np.int64), np.frombuffer(row["time_at"], np.int32), each)


def adaptive_windows(
    events: DataFrame, thresholds: Thresholds, order: list[str], merge_tail: bool = True, tail_ratio: float = 0.5, tail_pairs: bool = True
) -> DataFrame:
    """Adaptive windows of ``events`` (ts, source_entity, destination_entity), read in the total order ``order``.

    A window closes at the first event where its events, distinct pairs, sources and destinations all reach their
    thresholds, and all counts start anew.  A tail of less than ``tail_ratio`` of the event threshold joins the last
    window (its pairs are added, though some may repeat, if ``tail_pairs``), else it is a window of its own.
    Boundaries depend on everything before them.  Sorting the stream and finding each piece's distinct hashes, with
    their first and last places, is distributed; what one task then chains are the pieces' distinct hashes (64 bits;
    two names of one hash would count once), some sets of numbers for each piece and no event.  No events, no windows.
    """
    s, d = F.col("source_entity"), F.col("destination_entity")
    names = [f"__o{k}" for k in range(len(order))]
    rows = events.select(*[F.col(c).alias(n) for c, n in zip(order, names, strict=True)], F.col("ts").cast("bigint").alias("ts"), F.xxhash64(s).alias("v_src"), F.xxhash64(d).alias("v_dst"), F.xxhash64(s, d).alias("e"))
    pieces = stream_pieces(rows, names, max(1, min(thresholds.m, PIECE)))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found = list(scan_windows((_read_piece(r) for b in batches for k in range(b.num_rows) for r in b.slice(k, 1).to_pylist()), thresholds, merge_tail, tail_ratio, tail_pairs))
        names = [x.split()[0] for x in WINDOW_SCHEMA.split(", ")]
        kinds = [pa.int64()] * 8 + [pa.bool_()]
        yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in found], kind) for k, kind in enumerate(kinds)], names=names)

    return pieces.repartition(1).sortWithinPartitions("part", "seq").mapInArrow(run, WINDOW_SCHEMA)


def numbered(df: DataFrame, order: list[str]) -> DataFrame:
    """``df`` with ``pos``, 0 and up in the total order ``order``: a distributed sort and each part's offset."""
    ordered = cut_lineage(df.orderBy(*order)).withColumn("__id", F.monotonically_increasing_id())
    part = F.shiftright("__id", 33)
    sizes = ordered.groupBy(part.alias("__part")).agg(F.count(F.lit(1)).alias("__n"))
    before = Window.orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = sizes.withColumn("__before", F.coalesce(F.sum("__n").over(before), F.lit(0))).drop("__n")
    return ordered.withColumn("__part", part).join(F.broadcast(offsets), "__part").withColumn("pos", F.col("__before") + F.col("__id").bitwiseAND(F.lit((1 << 33) - 1))).drop("__id", "__part", "__before")


def fixed_event_windows(events: DataFrame, n: int, order: list[str]) -> DataFrame:
    """Windows of ``n`` events each: idx, ts_start, ts_end, m, is_merged_tail.

    A tail of fewer events extends the last window's end, whose m stays; without a full window there is none.
    """
    rows = numbered(events.select(*dict.fromkeys([*order, "ts"])), order)
    parts = rows.groupBy(F.expr(f"pos div {n}").alias("idx")).agg(F.min_by("ts", "pos").alias("ts_start"), F.max_by("ts", "pos").alias("ts_end"), F.count(F.lit(1)).alias("m"))
    tails = parts.filter(F.col("m") < n).select((F.col("idx") - 1).alias("idx"), F.col("ts_end").alias("tail_end"))
    full = parts.filter(F.col("m") == n).join(F.broadcast(tails), "idx", "left")
    return full.select("idx", "ts_start", F.coalesce("tail_end", "ts_end").alias("ts_end"), "m", F.col("tail_end").isNotNull().alias("is_merged_tail"))


def in_ranges(points: DataFrame, ranges: DataFrame, at: str, start: str, end: str, bucket: int = 900) -> DataFrame:
    """Inner join of points with the ranges that hold them, both ends inclusive.

    Ranges are spread over buckets of ``bucket`` and meet the points in an equi-join, so that neither side has to be
    small; null points and ranges match nothing.
    """
    spread = ranges.filter(F.col(start) <= F.col(end)).withColumn("__bucket", F.explode(F.sequence(F.expr(f"`{start}` div {bucket}"), F.expr(f"`{end}` div {bucket}"))))
    keyed = points.filter(F.col(at).isNotNull()).withColumn("__bucket", F.expr(f"`{at}` div {bucket}"))
    return keyed.join(spread, "__bucket").filter((F.col(at) >= F.col(start)) & (F.col(at) <= F.col(end))).drop("__bucket")


def window_events(events: DataFrame, windows: DataFrame) -> DataFrame:
    """Events with the idx of every window that holds their time; a shared boundary second counts in both."""
    return in_ranges(events, windows.select(F.col("idx").alias("window_idx"), "ts_start", "ts_end"), "ts", "ts_start", "ts_end").drop("ts_start", "ts_end")


def annotate_attacks(windows: DataFrame, alerts: DataFrame) -> DataFrame:
    """``windows`` with has_attack, attack_pivots (distinct, in order of time and name) and attack_event_count.

    ``alerts``: alert_id, ts, pivot.  An alert belongs to the first window that holds its time.
    """
    placed = in_ranges(alerts, windows.select("idx", "ts_start", "ts_end"), "ts", "ts_start", "ts_end").groupBy("alert_id", "ts", "pivot").agg(F.min("idx").alias("idx"))
    pivots = placed.groupBy("idx", "pivot").agg(F.count(F.lit(1)).alias("n"), F.min("ts").alias("first"))
    per = pivots.groupBy("idx").agg(F.sum("n").alias("attack_event_count"), F.transform(F.sort_array(F.collect_list(F.struct("first", "pivot"))), lambda x: x["pivot"]).alias("attack_pivots"))
    return windows.drop("has_attack", "attack_pivots", "attack_event_count").join(per, "idx", "left").withColumns(
        {
            "has_attack": F.col("attack_event_count").isNotNull(),
            "attack_pivots": F.coalesce("attack_pivots", F.array().cast("array<string>")),
            "attack_event_count": F.coalesce("attack_event_count", F.lit(0)),
        }
    )


def window_counts(placed: DataFrame) -> DataFrame:
    """Exact m, e, v_src, v_dst, v_total of placed events (window_idx, source_entity, destination_entity)."""
    pairs = placed.groupBy("window_idx", "source_entity", "destination_entity").agg(F.count(F.lit(1)).alias("m"))
    ends = pairs.select("window_idx", "m", F.explode(F.array(F.struct(F.lit(1).alias("role"), F.col("source_entity").alias("node")), F.struct(F.lit(2).alias("role"), F.col("destination_entity").alias("node")))).alias("x"))
    roles = ends.groupBy("window_idx", "x.node").agg(F.bit_or("x.role").alias("roles"))
    nodes = roles.groupBy("window_idx").agg(F.count_if(F.col("roles") != 2).alias("v_src"), F.count_if(F.col("roles") != 1).alias("v_dst"), F.count(F.lit(1)).alias("v_total"))
    return pairs.groupBy("window_idx").agg(F.sum("m").alias("m"), F.count(F.lit(1)).alias("e")).join(nodes, "window_idx")


def quartiles(df: DataFrame, value: Column) -> DataFrame:
    """One row: n, min, q1, median, q3, max, mean; quartiles are the values at n div 4, n div 2 and 3n div 4, no interpolation.

    Meant for tables of windows; without rows all but n are null.
    """
    ranked = df.select(value.alias("x")).filter(F.col("x").isNotNull())
    counted = ranked.groupBy("x").agg(F.count(F.lit(1)).alias("c"))
    upto = counted.withColumn("upto", F.sum("c").over(Window.orderBy("x"))).withColumn("n", F.sum("c").over(Window.partitionBy()))
    at = lambda k: F.min(F.when(F.col("upto") > k, F.col("x")))
    return upto.agg(
        F.coalesce(F.max("n"), F.lit(0)).alias("n"), F.min("x").alias("min"), at(F.expr("n div 4")).alias("q1"), at(F.expr("n div 2")).alias("median"),
        at(F.expr("3 * n div 4")).alias("q3"), F.max("x").alias("max"), (F.sum(F.col("x") * F.col("c")) / F.sum("c")).alias("mean"),
    )


def pivot_coverage(windows: DataFrame) -> DataFrame:
    """(pivot, windows, idxs): the windows that list each pivot."""
    return windows.select("idx", F.explode("attack_pivots").alias("pivot")).groupBy("pivot").agg(F.count(F.lit(1)).alias("windows"), F.sort_array(F.collect_list("idx")).alias("idxs"))


def windows_document(windows: DataFrame, kind: str, thresholds: dict[str, int], scanned: int) -> dict[str, object]:
    """The windows as one JSON document, unrounded and with the tail flag."""
    rows = [r.asDict() for r in windows.orderBy("idx").collect()]
    for r in rows:
        r["dur_h"] = (r["ts_end"] - r["ts_start"]) / 3600
    return {"windows": rows, "kind": kind, "thresholds": thresholds, "n_windows": len(rows), "total_events": sum(r["m"] for r in rows), "scanned_events": scanned}


def windows_markdown(windows: DataFrame) -> str:
    """Markdown table of the windows."""
    lines = ["| idx | start | end | hours | M | E | V_src | V_dst | attack |", "|---|---|---|---|---|---|---|---|---|"]
    for r in windows.orderBy("idx").collect():
        d = r.asDict()
        lines.append("| " + " | ".join(str(d.get(k, "")) for k in ("idx", "ts_start", "ts_end")) + f" | {(d['ts_end'] - d['ts_start']) / 3600:.2f} | " + " | ".join(str(d.get(k, "")) for k in ("m", "e", "v_src", "v_dst")) + f" | {'yes' if d.get('has_attack') else 'no'} |")
    return "\n".join(lines)
