"""Column builders for the action strings of each event category, and for ports."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Forms of the action strings, and ports of broadcast chatter.
AUTH_FORM = r"\A([^_]+)_([^_]+)_([^_]+)_([^_]+)\z"
FLOW_FORM = r"\ANetFlow_([^_]+)_([^>]+)>([^>]+)\z"
PIVOT_FORM = r"RedTeam_via_(C[0-9]+)"
NOISE_PROTOCOL = "17"
NOISE_PORTS = ("137", "138", "123")


def _group(action: Column, form: str, k: int) -> Column:
    return F.when(F.coalesce(action, F.lit("")).rlike(form), F.regexp_extract(action, form, k))


def auth_fields(action: Column) -> dict[str, Column]:
    """action_category, status, subtype, protocol of a four-part auth action, all null for any other; raw holds that one."""
    parts = {name: _group(action, AUTH_FORM, k) for k, name in enumerate(("action_category", "status", "subtype", "protocol"), 1)}
    return parts | {"raw": F.when(~F.coalesce(action, F.lit("")).rlike(AUTH_FORM), F.coalesce(action, F.lit("")))}


def flow_fields(action: Column) -> dict[str, Column]:
    """protocol, src_port, dst_port of a flow action, all null for any other; raw holds that one."""
    parts = {name: _group(action, FLOW_FORM, k) for k, name in enumerate(("protocol", "src_port", "dst_port"), 1)}
    return parts | {"raw": F.when(~F.coalesce(action, F.lit("")).rlike(FLOW_FORM), F.coalesce(action, F.lit("")))}


def proc_action(action: Column) -> Column:
    """The action without its first ``Process_``, wherever that stands."""
    s = F.coalesce(action, F.lit(""))
    at = F.instr(s, "Process_")
    return F.when(at > 0, F.concat(F.substring(s, F.lit(1), at - 1), F.substring(s, at + 8, F.length(s)))).otherwise(s)


def pivot_machine(action: Column) -> Column:
    """The host named by ``RedTeam_via_<host>`` anywhere in the action, else null."""
    return F.nullif(F.regexp_extract(F.coalesce(action, F.lit("")), PIVOT_FORM, 1), F.lit(""))


def is_noise_flow(action: Column) -> Column:
    """True for UDP flows to broadcast and time ports; an action of another form is never noise."""
    parts = flow_fields(action)
    return F.coalesce((parts["protocol"] == NOISE_PROTOCOL) & parts["dst_port"].isin(*NOISE_PORTS), F.lit(False))


def port_number(port: Column) -> Column:
    """Whole number of a port, null for empty, masked (``N...``) and other values."""
    p = F.trim(port)
    return F.when(p.rlike(r"\A[+-]?[0-9]{1,18}\z"), p.try_cast("bigint"))


def service_ports(src_port: Column, dst_port: Column) -> Column:
    """The numbers among a flow's two ports, in order."""
    return F.filter(F.array(port_number(src_port), port_number(dst_port)), lambda p: p.isNotNull())


def detail_field(detail: Column, name: str, default: str | None = None) -> Column:
    """String field of a JSON detail; ``default`` where the field is missing or any part of the JSON is damaged."""
    value = F.try_variant_get(F.try_parse_json(detail), f"$.{name}", "string")
    return F.coalesce(value, F.lit(default)) if default is not None else value
