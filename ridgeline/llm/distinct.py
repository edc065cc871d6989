"""Distinct counts by mergeable registers, with maximum-likelihood estimates.

An item's hash gives a register and a rank k with probability 2**-k.  A register keeps its maximum rank and, as two
indicator bits, whether the two ranks below it occurred: 8 bits, 2**precision registers.  Registers merge without
loss, in any order.  The estimate is the maximum of the likelihood, for which the number of registers in each state
suffices.

A sketch is one binary value for a key and measure: three bytes for each filled register (register, state), or one
byte for every register where that is shorter.  Tasks sketch their own rows, many keys at once; only sketches are
moved, to where those of one key lie side by side and are merged in one pass.

Relative standard error: sqrt(4.63 / 8 / registers), so 1.19 % for 4096 registers; ``error_bound`` is three times that.
Sets much smaller than the number of registers are nearly exact.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ridgeline.session import cut_lineage

PRECISION = 12
#: Fixed value: memory-variance product of such registers under maximum likelihood, in bits.
VARIANCE_PRODUCT = 4.631
DAY = 86_400
#: Days touched by all windows, added up, to which cells are broadcast (about 100 small rows a day); beyond, joins shuffle.
BROADCAST_DAYS = 50_000
#: Rows that a task sketches at once, and filled registers that it merges at once.
ROWS, ENTRIES = 1 << 19, 1 << 21


def error_bound(precision: int = PRECISION) -> float:
    """Relative error that an estimate exceeds in about 3 of 1000 cases."""
    return 3 * (VARIANCE_PRODUCT / 8 / (1 << precision)) ** 0.5


def states_of(hashes: np.ndarray, precision: int = PRECISION) -> tuple[np.ndarray, np.ndarray]:
    """Register and state (rank * 4, no indicator bits) of each 64-bit hash."""
    h = hashes.view(np.uint64)
    rest = h >> np.uint64(precision)
    low = rest & (~rest + np.uint64(1))
    rank = np.where(rest == 0, 64 - precision, np.log2(np.maximum(low, 1).astype(float)).astype(np.int64)) + 1
    return (h & np.uint64((1 << precision) - 1)).astype(np.int64), rank * 4


def merged(entries: np.ndarray) -> np.ndarray:
    """Entries (group and register above 8 bits of state) with one for each group and register."""
    entries = np.sort(entries)
    if not len(entries):
        return entries
    owner = entries >> 8
    first = np.flatnonzero(np.concatenate(([True], owner[1:] != owner[:-1])))
    last = np.append(first[1:], len(entries)) - 1
    top = (entries[last] >> 2) & 63  # states are sorted, so the last has the highest rank
    fall = np.repeat(top, last - first + 1) - ((entries >> 2) & 63)
    bits = np.bitwise_or.reduceat((4 | entries & 3) >> np.minimum(fall, 3), first)
    return (owner[first] << 8) | (top << 2) | (bits & 3)


def packed(entries: np.ndarray, groups: int, precision: int = PRECISION) -> list[bytes]:
    """The sketch of each group, of merged entries."""
    bounds = np.searchsorted(entries, np.arange(groups + 1) << (precision + 8))
    register, state = ((entries >> 8) & ((1 << precision) - 1)).astype("<u2" if precision <= 16 else "<u4"), entries.astype(np.uint8)
    size, out = register.itemsize + 1, []
    for a, b in zip(bounds[:-1], bounds[1:], strict=True):
        if (b - a) * size < 1 << precision:
            out.append(register[a:b].tobytes() + state[a:b].tobytes())
        else:
            dense = np.zeros(1 << precision, np.uint8)
            dense[register[a:b]] = state[a:b]
            out.append(dense.tobytes())
    return out


def entries_of(sketch: bytes, precision: int = PRECISION) -> np.ndarray:
    """Filled registers of a sketch as register * 256 + state."""
    if len(sketch) == 1 << precision:
        state = np.frombuffer(sketch, np.uint8)
        register = np.flatnonzero(state)
        return (register << 8) | state[register]
    kind = "<u2" if precision <= 16 else "<u4"
    n = len(sketch) // (np.dtype(kind).itemsize + 1)
    return (np.frombuffer(sketch, kind, n).astype(np.int64) << 8) | np.frombuffer(sketch, np.uint8, n, len(sketch) - n)


def _codes(batch: pa.Table | pa.RecordBatch, keys: Sequence[str]) -> np.ndarray:
    """Number of each row's combination of keys, in no order; nulls are a value."""
    code = np.zeros(batch.num_rows, np.int64)
    for k in keys:
        column = batch.column(k)
        column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
        own = column.dictionary_encode("encode")
        own = own.combine_chunks() if isinstance(own, pa.ChunkedArray) else own
        code = code * (len(own.dictionary) + 1) + np.asarray(own.indices)
        code = np.unique(code, return_inverse=True)[1]
    return code


def _emitted(batch: pa.Table | pa.RecordBatch, first: np.ndarray, keys: Sequence[str], measures: list[str], sketches: list[bytes]) -> Iterator[pa.RecordBatch]:
    """Rows (keys, measure, sketch) in batches of bounded size, without empty sketches."""
    for k in range(0, len(sketches), 4096):
        some = [i for i in range(k, min(k + 4096, len(sketches))) if sketches[i]]
        own = batch.select([*keys]).take(pa.array(first[some], pa.int64()))
        columns = [c.combine_chunks() if isinstance(c, pa.ChunkedArray) else c for c in own.columns]
        yield pa.RecordBatch.from_arrays([*columns, pa.array([measures[i] for i in some], pa.string()), pa.array([sketches[i] for i in some], pa.binary())], names=[*keys, "measure", "sketch"])


def _sketched(keys: Sequence[str], measures: Sequence[str], precision: int) -> Callable:
    def flush(held: list[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = pa.Table.from_batches(held)
        code = _codes(table, keys)
        groups = int(code.max()) + 1
        first = np.zeros(groups, np.int64)
        first[code[::-1]] = np.arange(len(code))[::-1]
        entries = []
        for j, name in enumerate(measures):
            column = table.column(name).combine_chunks()
            there = np.asarray(column.is_valid())
            register, state = states_of(np.asarray(column.drop_null()).astype(np.int64, copy=False), precision)
            entries.append((((code[there] * len(measures) + j) << precision | register) << 8) | state)
        sketches = packed(merged(np.concatenate(entries)), groups * len(measures), precision)
        yield from _emitted(table, np.repeat(first, len(measures)), keys, list(measures) * groups, sketches)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, rows = [], 0
        for batch in batches:
            held.append(batch)
            rows += batch.num_rows
            if rows >= ROWS:
                yield from flush(held)
                held, rows = [], 0
        if rows:
            yield from flush(held)

    return run


def _joined(keys: Sequence[str], precision: int, ordered: bool) -> Callable:
    """Merges sketches of equal keys and measure: all of a task where its rows are ordered by these, else nearby ones."""
    by = [*keys, "measure"]

    def flush(table: pa.Table, sizes: np.ndarray) -> tuple[np.ndarray, list[bytes]]:
        code = _codes(table, by)
        groups = int(code.max()) + 1
        first = np.zeros(groups, np.int64)
        first[code[::-1]] = np.arange(len(code))[::-1]
        each = [entries_of(x.as_py(), precision) for x in table.column("sketch")]
        entries = (np.repeat(code, [len(e) for e in each]) << (precision + 8)) | np.concatenate(each)
        return first, packed(merged(entries), groups, precision)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        size = 0
        for batch in batches:
            step = max(1, ENTRIES >> precision)
            for k in range(0, batch.num_rows, step):
                held.append(batch.slice(k, step))
                size += held[-1].column("sketch").nbytes
                if size >= ENTRIES:
                    table = pa.Table.from_batches(held)
                    first, sketches = flush(table, size)
                    out = list(_emitted(table, first, keys, [table.column("measure")[int(i)].as_py() for i in first], sketches))
                    held, size = [], 0
                    if ordered:  # the last key may go on
                        whole = pa.Table.from_batches(out).combine_chunks()
                        last = table.slice(table.num_rows - 1).select(by).to_pylist()[0]
                        at = next(i for i, r in enumerate(whole.select(by).to_pylist()) if r == last)
                        held = whole.slice(at, 1).to_batches()
                        size = held[0].column("sketch").nbytes
                        out = pa.concat_tables([whole.slice(0, at), whole.slice(at + 1)]).to_batches()
                    yield from out
        if held:
            table = pa.Table.from_batches(held)
            first, sketches = flush(table, size)
            yield from _emitted(table, first, keys, [table.column("measure")[int(i)].as_py() for i in first], sketches)

    return run


def _schema(df: DataFrame, keys: Sequence[str]) -> str:
    return ", ".join([*(f"`{k}` {df.schema[k].dataType.simpleString()}" for k in keys), "measure string, sketch binary"])


def sketch(df: DataFrame, keys: Sequence[str], measures: Sequence[str], precision: int = PRECISION) -> DataFrame:
    """One sketch (keys, measure, sketch) for each key and measure; the columns ``measures`` hold 64-bit hashes.

    A null hash is no item, a null key is a key.  A key without items has no row.
    """
    partial = df.select(*keys, *measures).mapInArrow(_sketched(keys, measures, precision), _schema(df, keys))
    return merge(partial, keys, precision, combine=False)


def merge(sketches: DataFrame, keys: Sequence[str], precision: int = PRECISION, combine: bool = True) -> DataFrame:
    """Sketches of larger spans from any smaller or partial ones, by ``keys``; near ones are merged before they move."""
    schema, rows = _schema(sketches, keys), sketches.select(*keys, "measure", "sketch")
    if combine:
        rows = rows.mapInArrow(_joined(keys, precision, False), schema)
    return merge_placed(rows.repartition(*keys, "measure"), keys, precision)


def merge_placed(sketches: DataFrame, keys: Sequence[str], precision: int = PRECISION) -> DataFrame:
    """Like ``merge`` within each partition, without moving rows."""
    rows = sketches.select(*keys, "measure", "sketch").sortWithinPartitions(*keys, "measure")
    return rows.mapInArrow(_joined(keys, precision, True), _schema(sketches, keys))


def likelihood_estimates(row: np.ndarray, state: np.ndarray, rows: int, registers: int) -> np.ndarray:
    """Distinct counts of largest likelihood; each filled register is given by its row and state.

    With L = n / registers, a rank k is absent with probability exp(-L 2**-k): an absent rank adds to ``alpha``, one
    that occurred to ``beta``.  The derivative, -alpha + sum beta_k 2**-k / (exp(L 2**-k) - 1), falls in L; its root
    is found by bisection of log L, for all rows at once.
    """
    top, bits = state >> 2, state & 3
    filled = np.bincount(row, minlength=rows)
    alpha = np.bincount(row, 2.0**-top, rows) + registers - filled
    beta = np.bincount(row * 65 + top, minlength=rows * 65).astype(float)
    for below, bit in ((1, 2), (2, 1)):
        rank, there = top - below, (bits & bit) > 0
        some = rank >= 1
        beta += np.bincount((row * 65 + rank)[some & there], minlength=rows * 65)
        gone = some & ~there
        alpha += np.bincount(row[gone], 2.0 ** -rank[gone], rows)
    beta, p = beta.reshape(rows, 65), 2.0 ** -np.arange(65.0)
    low, high = np.full(rows, -20.0), np.full(rows, 45.0)
    for _ in range(60):
        mid = (low + high) / 2
        x = np.exp(mid)[:, None] * p
        up = (beta * p / np.expm1(np.minimum(x, 700))).sum(1) > alpha
        low, high = np.where(up, mid, low), np.where(up, high, mid)
    return np.where(filled > 0, registers * np.exp((low + high) / 2), 0.0)


def estimates(sketches: DataFrame, keys: Sequence[str], precision: int = PRECISION) -> DataFrame:
    """(keys, measure, estimate) of merged sketches.  A key without items has no row; its count is 0."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(0, batch.num_rows, 512):
                own = batch.slice(k, 512)
                each = [entries_of(x.as_py(), precision) for x in own.column("sketch")]
                row = np.repeat(np.arange(len(each)), [len(e) for e in each])
                found = likelihood_estimates(row, np.concatenate(each) & 255, len(each), 1 << precision)
                yield pa.RecordBatch.from_arrays([*(own.column(c) for c in (*keys, "measure")), pa.array(found)], names=[*keys, "measure", "estimate"])

    schema = _schema(sketches, keys).replace("sketch binary", "estimate double")
    return sketches.select(*keys, "measure", "sketch").mapInArrow(run, schema)


def event_hashes(source: Column, destination: Column) -> dict[str, Column]:
    """Hashes of the pairs, sources and destinations of events; a pair needs both ends."""
    return {
        "e": F.when(source.isNotNull() & destination.isNotNull(), F.xxhash64(source, destination)),
        "v_src": F.when(source.isNotNull(), F.xxhash64(source)),
        "v_dst": F.when(destination.isNotNull(), F.xxhash64(destination)),
    }


def time_cells(windows: DataFrame) -> DataFrame:
    """(day, cell_start, cell_end): the days that windows touch, cut wherever a window starts or ends.

    ``windows`` has ts_start and ts_end, both inclusive.  A day has at most 86,400 cells.
    """
    days = windows.select(F.explode(F.sequence(F.expr(f"ts_start div {DAY}"), F.expr(f"ts_end div {DAY}"))).alias("day")).select("day", (F.col("day") * DAY).alias("cell_start"))
    cuts = windows.select(F.explode(F.array(F.col("ts_start"), F.col("ts_end") + 1)).alias("cell_start")).select(F.expr(f"cell_start div {DAY}").alias("day"), "cell_start")
    every = days.unionByName(cuts.join(days.select("day").distinct(), "day", "left_semi")).distinct()
    ends = F.expr(f"coalesce(lead(cell_start) over (partition by day order by cell_start), (day + 1) * {DAY})")
    return every.withColumn("cell_end", ends)


def window_sketches(events: DataFrame, windows: DataFrame, precision: int = PRECISION, bucket: int = 900) -> DataFrame:
    """Sketches of each window: (window, measure, sketch).

    ``events``: ts, category, and the hash columns e, v_src, v_dst.  ``windows``: window (unique), ts_start, ts_end,
    categories.  Events meet their time cell in an equi-join on time buckets; sketches are made for each cell and
    category, merged into days where they lie, and a window merges its whole days and the cells of the days it covers
    in part.  Events without a time lie in no window.
    """
    ranged = windows.filter(F.col("ts_start") <= F.col("ts_end"))
    days_of = F.sum(F.expr(f"ts_end div {DAY} - ts_start div {DAY} + 1"))
    few = (ranged.agg(days_of).first()[0] or 0) <= BROADCAST_DAYS
    small_side = F.broadcast if few else (lambda df: df)
    cells = time_cells(ranged)
    spread = cells.withColumn("bucket", F.explode(F.sequence(F.expr(f"cell_start div {bucket}"), F.expr(f"(cell_end - 1) div {bucket}"))))
    placed = events.filter(F.col("ts").isNotNull() & F.col("category").isNotNull()).withColumn("bucket", F.expr(f"ts div {bucket}")).join(small_side(spread), "bucket").filter((F.col("ts") >= F.col("cell_start")) & (F.col("ts") < F.col("cell_end")))
    keys = ["day", "cell_start", "category"]
    # merged by the whole key first, so that a day with very many rows burdens no task; then days lie together
    of_cell = cut_lineage(sketch(placed, keys, ["e", "v_src", "v_dst"], precision).repartition("day"))
    of_day = merge_placed(of_cell, ["day", "category"], precision)
    by_day = ranged.select(
        "window", "ts_start", "ts_end",
        F.explode(F.array_distinct("categories")).alias("category"),
    ).withColumn("day", F.explode(F.sequence(F.expr(f"ts_start div {DAY}"), F.expr(f"ts_end div {DAY}"))))
    full = (F.col("ts_start") <= F.col("day") * DAY) & (F.col("ts_end") >= (F.col("day") + 1) * DAY - 1)
    whole = by_day.filter(full).select("window", "category", "day")
    parts = by_day.filter(~full).join(cells, "day").filter((F.col("cell_start") >= F.col("ts_start")) & (F.col("cell_end") <= F.col("ts_end") + 1)).select("window", "category", "day", "cell_start")
    kept = ["window", "measure", "sketch"]
    return merge(of_day.join(small_side(whole), ["day", "category"]).select(*kept).unionByName(of_cell.join(small_side(parts), keys).select(*kept)), ["window"], precision)
