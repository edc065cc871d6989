import pytest
from pyspark.sql import functions as F

from ridgeline.operators.windows import windows_document, windows_markdown
from ridgeline.plans import pipeline
from ridgeline.sources import ingest

AUTH = ["1,SERVICE@C31,x,C77$@DOM2,C31,NTLM,Network,LogOn,Success", "2,C8$@DOM3,x,C9,C31,Kerberos,Network,LogOn,Success", "3,U4@DOM1,x,C31,C20@dom5,NTLM,Network,LogOn,Failure", "", "  ", "4,short"]
FLOWS = ["5,0,C1,445,C2,N1,6,9,9", "6,0,C1,137,C2,137,17,9,9"]
RED = ["7,U1@DOM1,C17693,C3$"]


def write(path, lines):
    path.write_text("\n".join(lines) + "\n")
    return str(path)


def test_cleaning_literals(spark):
    rows = [("1", "SERVICE@C31|C77$@DOM2", "C31", "LogOn_Success_Network_NTLM", "auth"), ("2", "C8$@DOM3|C9", "C31", "LogOn_Success_Network_Kerberos", "auth"), ("3", "U4@DOM1|C31$", "C20@dom5", "LogOn_Failure_Network_NTLM", "auth")]
    events = ingest.clean_auth(spark.createDataFrame(rows, ingest.QUAD_SCHEMA)).orderBy("ts").collect()
    assert [(e.source_entity, e.destination_entity) for e in events] == [("C77", "C31"), ("C9", "C31"), ("C31", "C20")]


def test_strict_times(spark):
    quads = spark.createDataFrame([("x1", "a", "b", "DNS_Query", "dns")], ingest.QUAD_SCHEMA)
    assert ingest.clean_dns(quads).first().ts is None
    with pytest.raises(Exception, match="no time: x1"):
        ingest.clean_quads(quads, ("dns",), strict=True).collect()
    alerts = spark.createDataFrame([(1, 5, "ALERT", '{"pivot_machine": "C1"}'), (2, 6, "ALERT", "{}"), (3, 7, "ALERT", "{bro"), (4, 8, "AUTH", None)], "event_id bigint, ts bigint, event_category string, event_detail string")
    assert [(r.alert_id, r.pivot) for r in pipeline.alerts_of(alerts).orderBy("alert_id").collect()] == [(1, "C1"), (2, "unknown"), (3, "unknown")]
    with pytest.raises(Exception, match="MALFORMED|bro"):
        pipeline.alerts_of(alerts, strict=True).collect()


def test_self_loops_and_alerts(spark):
    rows = [("1", "C1$@DOM1", "C1", "Process_Start", "proc"), ("2", "C1", "C2", "Process_End", "proc"), ("3", "U1", "C2", "RedTeam_via_C9", "redteam"), ("4", "U1$", "C2", "other", "redteam"), ("x", None, None, None, "dns")]
    quads = spark.createDataFrame(rows, ingest.QUAD_SCHEMA)
    assert ingest.clean_proc(quads.filter("source_file = 'proc'")).count() == 1
    assert ingest.clean_proc(quads.filter("source_file = 'proc'"), include_self_loops=True).count() == 2
    assert [e.source_entity for e in ingest.clean_redteam(quads.filter("source_file = 'redteam'")).orderBy("ts").collect()] == ["C9", "U1"]
    dns = ingest.clean_dns(quads.filter("source_file = 'dns'")).first()
    assert (dns.ts, dns.source_entity, dns.destination_entity) == (None, "", "")
    counts = {r.source_file: r for r in ingest.cleaning_counts(quads).collect()}
    assert (counts["proc"].total_in, counts["proc"].self_loops_dropped, counts["proc"].total_out) == (2, 1, 1)


def test_quads_round_trip_with_quotes(spark, tmp_path):
    rows = [("1", 'a "b", c', "", "x\ny", "auth"), ("2", "p", "q", '""', "auth")]
    ingest.write_quads(spark.createDataFrame(rows, ingest.QUAD_SCHEMA), str(tmp_path), "auth", 1)
    assert sorted(map(tuple, ingest.read_quads(spark, str(tmp_path / "auth")).collect())) == rows


def test_preprocess(spark, tmp_path):
    raw = {"auth": write(tmp_path / "auth.txt", AUTH), "flows": write(tmp_path / "flows.txt", FLOWS), "redteam": write(tmp_path / "redteam.txt", RED)}
    report = pipeline.preprocess(spark, raw | {"auth": raw["auth"]}, str(tmp_path / "out"))
    assert report["prepared"] == {"auth": {"rows": 3}, "flows": {"rows": 2}, "redteam": {"rows": 1}}
    events = ingest.read_events(spark, str(tmp_path / "out/events"))
    assert {(e.event_category, e.source_entity, e.destination_entity) for e in events.collect()} == {("AUTH", "C77", "C31"), ("AUTH", "C9", "C31"), ("AUTH", "C31", "C20"), ("FLOW", "C1", "C2"), ("ALERT", "C17693", "C3")}
    vocabulary = ingest.load_json(str(tmp_path / "out/feature_names.json"))
    assert vocabulary["port_features"] == ["port_445"] and vocabulary["total_flow_events"] == 1
    assert ingest.read_events(spark, str(tmp_path / "out/events"), ("AUTH",), max_files=1).count() <= 3
    assert "error" in pipeline.preprocess(spark, {"auth": str(tmp_path / "none")}, str(tmp_path / "o2"))["prepared"]["auth"]
    assert ingest.load_json(str(tmp_path / "none"), 5) == 5
    # optional logs join on demand, steps can be left out, and categories stand in their order
    for name, action, node in (("dns", "DNS_Query", "C6"), ("proc", "Process_Start", "C7")):
        ingest.write_quads(spark.createDataFrame([("9", node, "C8", action, name)], ingest.QUAD_SCHEMA), str(tmp_path / "out/quads"), name)
    report = pipeline.preprocess(spark, {}, str(tmp_path / "out"), events=str(tmp_path / "all"), include=("dns", "proc"), skip=("prepare", "vocabulary"))
    assert set(report) == {"cleaning"} and {r["source_file"]: r["total_out"] for r in report["cleaning"]} == {"auth": 3, "flows": 1, "dns": 1, "proc": 1, "redteam": 1}
    stored = ingest.read_events(spark, str(tmp_path / "all")).orderBy("category_no", "file_no", "file_name", "row_no").collect()
    assert [e.event_category for e in stored] == ["AUTH"] * 3 + ["FLOW", "DNS", "PROC", "ALERT"]
    assert pipeline.preprocess(spark, {}, str(tmp_path / "out"), skip=("prepare", "clean", "vocabulary")) == {}


def test_windows_document(spark):
    found = spark.createDataFrame([(0, 0, 5400, 7, False)], "idx bigint, ts_start bigint, ts_end bigint, m bigint, is_merged_tail boolean")
    doc = windows_document(found, "adaptive", {"m": 1}, 9)
    assert doc["n_windows"] == 1 and doc["total_events"] == 7 and doc["scanned_events"] == 9 and doc["windows"][0]["dur_h"] == 1.5
    assert "| 0 | 0 | 5400 | 1.50 | 7 |" in windows_markdown(found.withColumn("has_attack", F.lit(True)))


def test_plans_prune_and_push_down(spark, tmp_path):
    ingest.write_events(spark.range(100).selectExpr("cast(id as string) as timestamp", "id as ts", "'a' as source_entity", "'b' as destination_entity", "'AUTH' as event_category", "'t' as event_type", "'{}' as event_detail"), str(tmp_path / "e"))
    plan = spark.read.parquet(str(tmp_path / "e")).filter("event_category = 'AUTH' and ts >= 50").select("source_entity")._jdf.queryExecution().toString()
    assert "GreaterThanOrEqual(ts,50)" in plan and "PartitionFilters: [isnotnull(event_category" in plan and "event_detail" not in plan.split("ReadSchema:")[-1].split("\n")[0]


def test_a_cluster_needs_a_checkpoint_folder():
    from types import SimpleNamespace

    from ridgeline.session import cut_lineage

    context = SimpleNamespace(master="spark://host:7077", getCheckpointDir=lambda: None)
    session = SimpleNamespace(sparkContext=context, conf=SimpleNamespace(get=lambda key, default: default))
    with pytest.raises(RuntimeError, match="spark.checkpoint.dir"):
        cut_lineage(SimpleNamespace(sparkSession=session))
