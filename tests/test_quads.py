import csv
import io
import random

import numpy as np
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from ridgeline.operators import quads
from ridgeline.operators.quads import CELLS, parse_lines, parse_quads

GOOD = "6,U1@DOM1|C2,C3,LogOn_Success_Network_NTLM,auth"
CASES = [
    (GOOD, None), ('6,"U1, svc|C2",C3,LogOn_Success_Network_NTLM,auth', None), ('6,"a ""b""\nc",C3,DNS_Query,dns', None), ('"6","a","b","Process_End","proc"', None),
    ("", "columns"), (None, "columns"), ("1,2", "columns"), (GOOD + GOOD, "columns"), ('6,a"b,C3,DNS_Query,dns', "quoting"), ('6,"a"b,C3,DNS_Query,dns', "quoting"),
    ('6,"a,C3,DNS_Query,dns', "quoting"), ('"', "quoting"), ('""', "columns"), ('6,"a\\"b",c,DNS_Query,dns', "quoting"), ('6,"",c,DNS_Query,dns', None), (' "6",a,b,DNS_Query,dns', "quoting"),
    ("06,a,b,DNS_Query,dns", "timestamp"), ("0,a,b,DNS_Query,dns", "timestamp"), ("1000000000,a,b,DNS_Query,dns", "timestamp"), ("999999999,a,b,DNS_Query,dns", None), ("+6,a,b,DNS_Query,dns", "timestamp"), ("6\n,a,b,DNS_Query,dns", "timestamp"), ("٣,a,b,DNS_Query,dns", "timestamp"),
    ("6,a,b,LogOn_Success_Network,auth", "action_state"), ("6,a,b,LogOn_Success_Network_W_A_P,auth", None), ("6,a,b,LogOn__Network_NTLM,auth", "action_state"), ("6,a,b,LogOn_Success_Net work_NTLM,auth", "action_state"), ("6,a,b,LogOn_success_Network_NTLM,auth", "action_state"),
    ("6,a,b,LogOn_Success_Network_NTLM ,auth", "action_state"), ("6,a,b,NetFlow_6_445>N1,flows", None), ("6,a,b,NetFlow_6_65535>0,flows", None), ("6,a,b,NetFlow_6_65536>0,flows", "action_state"), ("6,a,b,NetFlow_6_N>0,flows", "action_state"), ("6,a,b,NetFlow_x_1>0,flows", "action_state"),
    ("6,a,b,RedTeam_via_C12,redteam", None), ("6,a,b,RedTeam_via_U12,redteam", "action_state"), ("6,a,b,DNS_Query_,dns", "action_state"), ("6,a,b,Process_start,proc", "action_state"), ("6,a,b,anything,other", None), ("x,a,b,Process_start,proc", "timestamp"),
]


def test_reasons():
    _, reason = parse_lines(pa.array([c for c, _ in CASES], pa.string()))
    assert list(zip([c for c, _ in CASES], reason.to_pylist(), strict=True)) == CASES


def test_cells():
    lines = [c for c, r in CASES if r is None]
    cells, reason = parse_lines(pa.array(lines, pa.string()))
    assert reason.null_count == len(lines)
    for k, line in enumerate(lines):
        assert [c[k].as_py() for c in cells] == next(csv.reader(io.StringIO(line, newline="")))


@settings(max_examples=300, deadline=None)
@given(st.lists(st.text(st.sampled_from('a,"\n_é1'), max_size=12), max_size=8), st.integers(0, 3))
def test_quoting_against_a_sequential_reader(lines, skip):
    def reads(line):
        k, cells = 0, 0
        while True:
            if line[k : k + 1] == '"':
                k += 1
                while line[k : k + 1] != '"' or line[k : k + 2] == '""':
                    if k >= len(line):
                        return None
                    k += 2 if line[k : k + 2] == '""' else 1
                k += 1
            else:
                while k < len(line) and line[k] != ",":
                    if line[k] == '"':
                        return None
                    k += 1
            cells += 1
            if k == len(line):
                return cells
            if line[k] != ",":
                return None
            k += 1

    lines = lines[skip:]
    _, reason = parse_lines(pa.array(["x", *lines], pa.string())[1:])
    for line, why in zip(lines, reason.to_pylist(), strict=True):
        cells = reads(line)
        assert why == ("quoting" if cells is None else "columns" if cells != 5 else why)
        assert cells is None or why != "quoting"


def test_frames_keep_columns_and_rename_clashes(spark):
    rows = spark.createDataFrame([(1, "x", GOOD), (1, "x", GOOD), (2, None, "bad"), (None, "z", None)], "line_id bigint, reason string, line string")
    out = parse_quads(rows)
    assert out.columns == ["line_id", "in_reason", *CELLS, "reason", "rejected"]
    found = sorted(out.collect(), key=str)
    assert [(r.in_reason, r.timestamp, r.reason, r.rejected) for r in found] == [("x", "6", None, None), ("x", "6", None, None), (None, None, "columns", "bad"), ("z", None, "columns", None)]


def test_empty_table_and_long_lines(spark):
    empty = spark.createDataFrame([], "line_id bigint, line string")
    assert parse_quads(empty).count() == 0
    long = spark.createDataFrame([(1, "6," + "a" * 2_000_000 + ",b,DNS_Query,dns"), (2, "," * 300_000)], "line_id bigint, line string")
    assert {r.line_id: (r.reason, r.n) for r in parse_quads(long).select("line_id", "reason", F.length("src_node").alias("n")).collect()} == {1: (None, 2_000_000), 2: ("columns", None)}


@pytest.mark.parametrize("n", [0, 1])
def test_sliced_arrays(n):
    lines = pa.array(["bad", GOOD, GOOD], pa.string())[n:2]
    _, reason = parse_lines(lines)
    assert reason.to_pylist() == ["columns", None][n:]


def plain_records(data):
    """Record ends by reading character by character."""
    out, own, inside = [], "", False
    for c in data:
        if c == "\n" and not inside:
            out.append(own.removesuffix("\r"))
            own = ""
        else:
            inside ^= c == '"'
            own += c
    return out + ([own.removesuffix("\r")] if own else [])


def records(data, most=1000):
    buf = np.frombuffer(data.encode(), np.uint8)
    return [data.encode()[a:b].decode() for a, b in zip(*quads.record_bounds(buf, most), strict=True)]


def test_record_ends_follow_the_quotes():
    r = random.Random(6)
    for _ in range(300):
        data = "".join(r.choice(['a', ',', '"', '""', '\n', '\r\n', 'b"c\n"']) for _ in range(r.randint(0, 40)))
        if data.count('"') % 2 == 0:
            assert records(data) == plain_records(data), data
    # a quote that is never closed, or too late, breaks its own line only
    assert records('1,"a\n2,b\n3,c\n') == ['1,"a', "2,b", "3,c"]
    assert records('1,"a\n2,b\n3,c"\n4,"x\ny"\n', 3) == ['1,"a\n2,b\n3,c"', '4,"x\ny"']
    assert records('1,"a\n2,b\n3,c"\n4,"x\ny"\n', 2) == ['1,"a', "2,b", '3,c"\n4,"x', 'y"']
    assert records("") == [] and records("\n\na") == ["", "", "a"]


def test_files_with_line_breaks_in_cells(spark, tmp_path, monkeypatch):
    good = [f'{k + 1},"U{k}\nx, ""y""",C{k},DNS_Query,dns' for k in range(50)]
    (tmp_path / "dns_part000.csv").write_bytes(("timestamp,src_node,dst_node,action_state,source_file\r\n" + "\r\n".join(good) + "\r\nbad line\n").encode())
    (tmp_path / "dns_part001.csv").write_bytes(b"")
    (tmp_path / "dns_part002.csv").write_bytes(b'7,"open,C1,DNS_Query,dns\n8,a,b,DNS_Query,dns')
    rows = quads.parse_quad_files(spark, str(tmp_path), header=True).orderBy("file_name", "line_no").collect()
    assert [(r.timestamp, r.src_node) for r in rows if r.file_name.endswith("000.csv") and r.reason is None] == [(str(k + 1), f'U{k}\nx, "y"') for k in range(50)]
    assert [(r.line_no, r.reason, r.rejected) for r in rows if r.reason] == [(52, "columns", "bad line")]
    loose = quads.parse_quad_files(spark, str(tmp_path / "dns_part002.csv")).orderBy("line_no").collect()
    assert [(r.line_no, r.reason, r.timestamp) for r in loose] == [(1, "quoting", None), (2, None, "8")]
