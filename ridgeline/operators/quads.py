"""Separating raw five-column lines into cells, and lines that fail into reasons.

Each Arrow batch of a table, and each raw file, is one byte buffer.  Quote masks and their prefix parity give the
delimiters of the whole buffer at once, and in a file also the record ends, for quoted cells may hold line breaks;
cells are then slices of the buffer and are checked column by column.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

CELLS = ("timestamp", "src_node", "dst_node", "action_state", "source_file")

# The form that each source file asks of its action_state.
_SPACE = r"\s\x0b\x{85}\pZ"
_PART = rf"[^_{_SPACE}]+"
_PORT = r"(?:N[0-9]+|0*(?:[0-9]{1,4}|[1-5][0-9]{4}|6[0-4][0-9]{3}|65[0-4][0-9]{2}|655[0-2][0-9]|6553[0-5]))"
ACTION_FORMS = {
    "auth": rf"\A{_PART}_(?:Success|Failure)_{_PART}(?:_{_PART})+\z",
    "flows": rf"\ANetFlow_[0-9]+_{_PORT}>{_PORT}\z",
    "redteam": r"\ARedTeam_via_C[0-9]+\z",
    "dns": r"\ADNS_Query\z",
    "proc": r"\AProcess_(?:Start|End)\z",
}
TIMESTAMP_FORM = r"\A[1-9][0-9]{0,8}\z"

_QUOTE, _COMMA, _BREAK, _RETURN = 34, 44, 10, 13
#: Lines that a record of a file may hold.  A quote that isn't closed within them is broken, and its line a record.
RECORD_LINES = 1000
#: Records of a file that are checked at once.
_RECORDS = 20_000


def _flags(at: np.ndarray, n: int) -> np.ndarray:
    return np.bincount(at, minlength=n)[:n] > 0


def structural_index(buf: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Positions of the delimiters of all records of ``buf``, and whether each record's quoting is broken.

    ``off`` holds the n + 1 record bounds.  A byte is inside quotes where the number of quotes before it, in its
    record, is odd.
    """
    n = len(off) - 1
    record = np.repeat(np.arange(n), np.diff(off))
    quote = buf == _QUOTE
    before = np.concatenate(([0], np.cumsum(quote)))
    inside = ((before[:-1] - before[off[:-1]][record]) & 1).astype(bool)
    delimiter = (buf == _COMMA) & ~inside
    opening, closing = np.flatnonzero(quote & ~inside), np.flatnonzero(quote & inside)
    first, last = off[:-1][record], off[1:][record] - 1
    prev, after = opening - 1, closing + 1
    fits_open = opening == first[opening]
    rest = ~fits_open
    fits_open[rest] = delimiter[prev[rest]] | quote[prev[rest]]
    fits_close = closing == last[closing]
    rest = ~fits_close
    fits_close[rest] = delimiter[after[rest]] | quote[after[rest]]
    broken = ((before[off[1:]] - before[off[:-1]]) & 1).astype(bool)
    broken |= _flags(record[opening[~fits_open]], n) | _flags(record[closing[~fits_close]], n)
    return np.flatnonzero(delimiter), broken


def record_bounds(buf: np.ndarray, most: int = RECORD_LINES) -> tuple[np.ndarray, np.ndarray]:
    """Start and end of every record of a file's bytes: line breaks where the parity of the quotes before is even.

    Line breaks (and a carriage return before one) belong to no record; one at the end of the file starts none.
    """
    breaks = np.flatnonzero(buf == _BREAK)
    starts = np.concatenate(([0], breaks + 1))
    ends = np.append(breaks, len(buf))
    if starts[-1] == len(buf):
        starts, ends = starts[:-1], ends[:-1]
    before = np.concatenate(([0], np.cumsum(buf == _QUOTE)))
    odd = np.flatnonzero((before[ends] - before[starts]) & 1)
    goes_on = np.zeros(len(starts), np.int64)
    k = 0
    while k < len(odd):  # only lines in which a quoted cell opens or closes
        if k + 1 < len(odd) and odd[k + 1] - odd[k] < most:
            goes_on[odd[k] : odd[k + 1]] = 1
            k += 2
        else:
            k += 1
    first = np.flatnonzero(np.concatenate(([True], goes_on[:-1] == 0))) if len(starts) else np.zeros(0, np.int64)
    last = np.append(first[1:], len(starts))[: len(first)] - 1
    end = ends[last]
    back = (end > starts[first]) & (buf[np.maximum(end - 1, 0)] == _RETURN) if len(buf) else np.zeros(len(end), bool)
    return starts[first], end - back


def _slices(buf: np.ndarray, start: np.ndarray, end: np.ndarray) -> pa.Array:
    size = end - start
    bounds = np.concatenate(([0], np.cumsum(size)))
    data = buf[np.repeat(start - bounds[:-1], size) + np.arange(bounds[-1])]
    binary = pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(start), [None, pa.py_buffer(bounds.astype(np.int64).tobytes()), pa.py_buffer(data.tobytes())])
    return binary.cast(pa.large_string())


def parse_lines(lines: pa.Array) -> tuple[list[pa.Array], pa.Array]:
    """Five arrays of cells (null in lines that fail) and the reasons (null in good lines)."""
    n = len(lines)
    raw = pc.fill_null(lines.cast(pa.large_binary()), b"")
    bounds = np.frombuffer(raw.buffers()[1], np.int64, n + 1 + raw.offset)[raw.offset :] if n else np.zeros(1, np.int64)
    data = raw.buffers()[2] if n else None
    buf = np.frombuffer(data, np.uint8)[bounds[0] : bounds[-1]] if data is not None and bounds[-1] > bounds[0] else np.zeros(0, np.uint8)
    off = bounds - bounds[0]
    delimiters, broken = structural_index(buf, off)
    record = np.searchsorted(off, delimiters, side="right") - 1
    if n and len(delimiters):  # empty records share an offset with the record after them
        record = np.repeat(np.arange(n), np.diff(off))[delimiters]
    count = np.bincount(record, minlength=n) + 1
    reason = np.full(n, None, object)
    reason[count != len(CELLS)] = "columns"
    reason[broken] = "quoting"
    whole = (count == len(CELLS)) & ~broken
    rows = np.flatnonzero(whole)
    at = delimiters[whole[record]].reshape(-1, len(CELLS) - 1) if len(delimiters) else np.zeros((0, len(CELLS) - 1), np.int64)
    starts = np.column_stack([off[:-1][rows], at + 1])
    ends = np.column_stack([at, off[1:][rows]])
    cells = []
    for k in range(len(CELLS)):
        start, end = starts[:, k], ends[:, k]
        quoted = np.zeros(len(rows), bool)
        some = end > start
        quoted[some] = buf[start[some]] == _QUOTE
        cell = _slices(buf, start + quoted, end - quoted)
        cells.append(pc.replace_substring(cell, '""', '"') if quoted.any() else cell)
    timed = np.asarray(pc.match_substring_regex(cells[0], TIMESTAMP_FORM))
    formed = np.ones(len(rows), bool)
    for source, form in ACTION_FORMS.items():
        own = np.asarray(pc.equal(cells[4], source))
        formed[own] = np.asarray(pc.match_substring_regex(cells[3].filter(pa.array(own)), form))
    own_reason = np.where(~timed, "timestamp", np.where(~formed, "action_state", None))
    reason[rows] = own_reason
    place = np.full(n, -1)
    good = np.array([x is None for x in own_reason], bool)
    place[rows[good]] = np.flatnonzero(good)
    take = pa.array(place, mask=place < 0)
    return [c.take(take).cast(pa.string()) for c in cells], pa.array(reason, pa.string())


def parse_quads(df: DataFrame, line: str = "line") -> DataFrame:
    """``df`` with the five cells of ``line`` and ``reason`` in place of the line.

    Good lines have five cells and a null reason, lines that fail have null cells, the line itself in ``rejected``
    and the first reason that holds: ``quoting``, ``columns``, ``timestamp``, ``action_state``.  A null or empty
    line has no five cells, so its reason is ``columns``.  A source_file that is none of the known ones asks for no
    form of action_state.  Columns of ``df`` other than ``line`` are kept; one that has the name of a cell (or
    ``reason``, ``rejected``) gets the prefix ``in_``.
    """
    added = (*CELLS, "reason", "rejected")
    kept = [c for c in df.columns if c != line]
    names = {}
    for c in kept:
        name = c
        while name in added or (name != c and name in kept):
            name = "in_" + name
        names[c] = name
    source = df.select(*[F.col(f"`{c}`").alias(names[c]) for c in kept], F.col(f"`{line}`").cast("string").alias("__line"))
    schema = ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in source.schema if f.name != "__line"), *(f"{c} string" for c in added)])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lines = batch.column(batch.schema.get_field_index("__line"))
            cells, reason = parse_lines(lines)
            rejected = pc.if_else(pc.is_valid(reason), lines.cast(pa.string()), pa.scalar(None, pa.string()))
            others = [i for i, f in enumerate(batch.schema) if f.name != "__line"]
            yield pa.RecordBatch.from_arrays(
                [*(batch.column(i) for i in others), *cells, reason, rejected],
                names=[*(batch.schema.field(i).name for i in others), *added],
            )

    return source.mapInArrow(run, schema)


def parse_quad_files(spark: SparkSession, path: str, header: bool = False) -> DataFrame:
    """Records of raw quad files: file_name, line_no (the record's number from 1), the cells, reason and rejected.

    A quoted cell may span lines.  A file is read by one task, as files with line breaks in cells always are; parts
    of bounded size, which the sinks write, keep that short.  ``header`` skips each file's first record.
    """
    files = spark.read.format("binaryFile").load(path).select("path", "content")
    added = (*CELLS, "reason", "rejected")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for name, content in zip(batch.column("path").to_pylist(), batch.column("content"), strict=True):
                buf = np.frombuffer(content.as_buffer(), np.uint8) if content.is_valid else np.zeros(0, np.uint8)
                start, end = record_bounds(buf)
                for k in range(int(header), len(start), _RECORDS):
                    lines = _slices(buf, start[k : k + _RECORDS], end[k : k + _RECORDS])
                    cells, reason = parse_lines(lines)
                    rejected = pc.if_else(pc.is_valid(reason), lines.cast(pa.string()), pa.scalar(None, pa.string()))
                    number = pa.array(np.arange(k + 1, k + 1 + len(lines)))
                    yield pa.RecordBatch.from_arrays([pa.array([name.rsplit("/", 1)[-1]] * len(lines), pa.string()), number, *cells, reason, rejected], names=["file_name", "line_no", *added])

    return files.mapInArrow(run, ", ".join(["file_name string", "line_no bigint", *(f"{c} string" for c in added)]))
