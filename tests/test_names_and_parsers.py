import pytest
from pyspark.sql import functions as F

from ridgeline.functions import names, parsers


def column(spark, values, build):
    rows = spark.createDataFrame([(k, v) for k, v in enumerate(values)], "k int, v string").select("k", build(F.col("v")).alias("x"))
    return [r.x for r in rows.orderBy("k").collect()]


@pytest.mark.parametrize(
    "name, node",
    [("C5170$@DOM1", "C5170"), ("U66@dom12", "U66"), ("X$$", "X$"), ("A@DOM1@DOM2", "A@DOM1"), ("", ""), (None, ""), ("C1", "C1"), ("@DOM1", ""), ("$", ""), ("a@DOM1 ", "a@DOM1 ")],
)
def test_normalize_node(spark, name, node):
    assert column(spark, [name], names.normalize_node) == [node]


def test_entity_is_null_for_no_name(spark):
    assert column(spark, [None, "", "$@DOM3", "C9$"], names.entity) == [None, None, None, "C9"]


def test_accounts(spark):
    values = ["C599$@DOM1|C1619", "ANONYMOUS LOGON@C586|C1250", "C1$@DOM1", "a|b|c", "x@y@z|C2$", "|C3", None, ""]
    assert column(spark, values, names.account_part) == ["C599$", "ANONYMOUS LOGON", "", "a", "x@y", "", "", ""]
    assert column(spark, values, names.domain_part) == ["DOM1", "C586", "", "", "z", "", "", ""]
    assert column(spark, values, names.machine_part) == ["C1619", "C1250", "C1", "b|c", "C2", "C3", "", ""]


def test_auth_actions(spark):
    values = ["LogOn_Success_Network_NTLM", "LogOn_Success_Network_WAVE_AUTH", "TGS_Success_?_?", "", None]
    fields = parsers.auth_fields
    assert column(spark, values, lambda c: fields(c)["status"]) == ["Success", None, "Success", None, None]
    assert column(spark, values, lambda c: fields(c)["raw"]) == [None, "LogOn_Success_Network_WAVE_AUTH", None, "", ""]


def test_flow_actions(spark):
    values = ["NetFlow_17_137>137", "NetFlow_1_N2>N3", "NetFlow_6_445>N1", "NetFlow_6_4_5>1", "flow", None]
    assert column(spark, values, parsers.is_noise_flow) == [True, False, False, False, False, False]
    assert column(spark, values, lambda c: parsers.flow_fields(c)["src_port"]) == ["137", "N2", "445", "4_5", None, None]


def test_other_actions(spark):
    assert column(spark, ["Process_Start", "xProcess_Process_a", "Start", None], parsers.proc_action) == ["Start", "xProcess_a", "Start", ""]
    assert column(spark, ["RedTeam_via_C17693", "a RedTeam_via_C1 b", "RedTeam_via_U1", None], parsers.pivot_machine) == ["C17693", "C1", None, None]


def test_ports(spark):
    assert column(spark, [" 445 ", "0445", "N3", "", None, "x", "99999999999999999999"], parsers.port_number) == [445, 445, None, None, None, None, None]


def test_damaged_details_have_no_fields(spark):
    values = ['{"status": "Success"}', '{"status": "Success", "x": ', "[]", None, "", '{"status": null}']
    assert column(spark, values, lambda c: parsers.detail_field(c, "status", "?")) == ["Success", "?", "?", "?", "?", "?"]
