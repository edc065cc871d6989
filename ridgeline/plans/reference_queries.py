"""Registered queries of the authentication-graph operators, each beside the SQL of the same result."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ridgeline.functions import parsers
from ridgeline.functions.names import account_part, domain_part, entity, machine_part, normalize_node
from ridgeline.operators import evaluate, graph, model, rank, windows
from ridgeline.operators.features import once
from ridgeline.operators.quads import parse_quads
from ridgeline.plans.core_problems import _QUADS, sql_entity
from ridgeline.session import cut_lineage
from ridgeline.sources import ingest
from ridgeline.sources.tables import table

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}

ORDER = ["ts", "event_id"]


def _register(sql: str | None = None) -> Callable:
    def add(run: Callable[[SparkSession, str], DataFrame]) -> Callable:
        QUERIES[run.__name__] = run
        if sql is not None:
            ORACLES[run.__name__] = sql
        return run

    return add


def _r(name: str) -> Column:
    return F.round(F.col(name), 6).alias(name)


def _long(*names: str) -> dict[str, Column]:
    """Whole numbers as SQL has them."""
    return {n: F.col(n).cast("bigint") for n in names}


# ---- inputs ------------------------------------------------------------------------------------------------------

_STREAM = f"""st AS (SELECT * FROM (
    SELECT event_id, ts, {sql_entity('source_entity')} AS src, {sql_entity('destination_entity')} AS dst, event_category AS category, event_type, event_detail
    FROM unified_event QUALIFY row_number() OVER (PARTITION BY event_id ORDER BY loaded_at) = 1) WHERE ts IS NOT NULL AND src IS NOT NULL AND dst IS NOT NULL),
wi AS (SELECT idx, ts_start, ts_end, attack_pivots FROM window_info WHERE kind = 'adaptive')"""
_PLACED = _STREAM + """,
pl AS (SELECT idx AS window_idx, ts, src, dst, event_detail FROM st JOIN wi ON ts BETWEEN ts_start AND ts_end WHERE category = 'AUTH')"""
_SLICED = _PLACED + """,
sl AS (SELECT window_idx, slice, src, dst, count(*) AS cnt FROM (
    SELECT window_idx, src, dst, CASE WHEN ts < ts_start + trunc(1 * ((ts_end - ts_start) / 4.0))::BIGINT THEN 0 WHEN ts < ts_start + trunc(2 * ((ts_end - ts_start) / 4.0))::BIGINT THEN 1
        WHEN ts < ts_start + trunc(3 * ((ts_end - ts_start) / 4.0))::BIGINT THEN 2 WHEN ts < ts_start + trunc(4 * ((ts_end - ts_start) / 4.0))::BIGINT THEN 3 END AS slice
    FROM pl JOIN wi ON window_idx = idx WHERE ts_end > ts_start) WHERE slice IS NOT NULL GROUP BY ALL)"""
_EDGES = _SLICED + """,
ed AS (SELECT window_idx, src, dst, sum(cnt)::BIGINT AS cnt FROM sl GROUP BY ALL),
nd AS (SELECT window_idx, node, row_number() OVER (PARTITION BY window_idx ORDER BY node) - 1 AS node_id FROM (SELECT window_idx, src AS node FROM pl UNION SELECT window_idx, dst FROM pl)),
dg AS (SELECT n.window_idx, n.node, n.node_id, coalesce(o.n, 0) AS out_deg, coalesce(i.n, 0) AS in_deg FROM nd n
    LEFT JOIN (SELECT window_idx, src, count(*) AS n FROM ed GROUP BY ALL) o ON n.window_idx = o.window_idx AND n.node = o.src
    LEFT JOIN (SELECT window_idx, dst, count(*) AS n FROM ed GROUP BY ALL) i ON n.window_idx = i.window_idx AND n.node = i.dst)"""
_ALPHA = _EDGES + """,
al AS (SELECT *, row_number() OVER (PARTITION BY window_idx ORDER BY out_deg / (in_deg + 1.0), node) / count(*) OVER (PARTITION BY window_idx) AS score_alpha FROM dg)"""


def _json(field: str, default: str | None = "?") -> str:
    value = f"CASE WHEN json_valid(event_detail) THEN json_extract_string(event_detail, '$.{field}') END"
    return f"coalesce({value}, '{default}')" if default is not None else value


def _port(field: str) -> str:
    return f"try_cast(nullif(regexp_extract(trim({_json(field, None)}), '^[+-]?[0-9]{{1,18}}$'), '') AS BIGINT)"


_VOCABULARY = f"""fp AS (SELECT ts, event_id, 0 AS k, {_port('src_port')} AS port FROM st WHERE category = 'FLOW' UNION ALL SELECT ts, event_id, 1, {_port('dst_port')} FROM st WHERE category = 'FLOW'),
vo AS (SELECT row_number() OVER (ORDER BY n DESC, first) - 1 AS port_idx, port, n FROM (SELECT port, count(*) AS n, min((ts, event_id, k)) AS first FROM fp WHERE port IS NOT NULL GROUP BY port) QUALIFY port_idx < 30)"""
_AUTH = f"""au AS (SELECT window_idx, src, dst, max((status = 'Success')::INT)::DOUBLE AS status_success, max((protocol = 'NTLM')::INT)::DOUBLE AS "proto_NTLM", max((protocol = 'Kerberos')::INT)::DOUBLE AS "proto_Kerberos",
    max((protocol = 'Negotiate')::INT)::DOUBLE AS "proto_Negotiate", max((protocol NOT IN ('NTLM', 'Kerberos', 'Negotiate'))::INT)::DOUBLE AS proto_unknown
    FROM (SELECT window_idx, src, dst, {_json('status')} AS status, {_json('protocol')} AS protocol FROM pl) GROUP BY ALL)"""
_PORTS = _VOCABULARY + f""",
pp AS (SELECT window_idx, src, dst, port_idx FROM (
    SELECT idx AS window_idx, src, dst, unnest([{_port('src_port')}, {_port('dst_port')}]) AS port FROM st JOIN wi ON ts BETWEEN ts_start AND ts_end WHERE category = 'FLOW') JOIN vo USING (port)),
po AS (SELECT window_idx, src, dst, {', '.join(f'max((port_idx = {k})::INT)::DOUBLE AS port_{k}' for k in range(30))} FROM pp GROUP BY ALL)"""
_FEATURES = _EDGES + f", {_AUTH}, {_PORTS}" + """,
ef AS (SELECT e.window_idx, e.src, e.dst, e.cnt, 1.0::DOUBLE AS is_auth, coalesce(status_success, 0) AS status_success, coalesce("proto_NTLM", 0) AS "proto_NTLM", coalesce("proto_Kerberos", 0) AS "proto_Kerberos",
    coalesce("proto_Negotiate", 0) AS "proto_Negotiate", coalesce(proto_unknown, 0) AS proto_unknown, """ + ", ".join(f"coalesce(port_{k}, 0)::DOUBLE AS port_{k}" for k in range(30)) + """, ln(1 + e.cnt) AS log_count
    FROM ed e LEFT JOIN au ON e.window_idx = au.window_idx AND e.src = au.src AND e.dst = au.dst LEFT JOIN po ON e.window_idx = po.window_idx AND e.src = po.src AND e.dst = po.dst)"""
_NAMES = graph.feature_names()
_COUNTS = _FEATURES + f""",
fc AS (UNPIVOT (SELECT window_idx, count(*) AS n_edges, {', '.join(f'sum("{n}") AS "{n}"' for n in _NAMES)} FROM ef GROUP BY window_idx) ON {', '.join(f'"{n}"' for n in _NAMES)} INTO NAME feature VALUE cnt)"""
_RARITY = _FEATURES + f""",
fr AS (SELECT window_idx, {', '.join(f'-ln(greatest(avg("{n}"), 1e-10)) AS "w_{n}"' for n in _NAMES)} FROM ef GROUP BY window_idx),
ra AS (SELECT ef.window_idx, src, dst, {' + '.join(f'"{n}" * "w_{n}"' for n in _NAMES)} AS rarity FROM ef JOIN fr USING (window_idx))"""
_PEAK = _SLICED + """,
sd AS (SELECT window_idx, slice, node, sum(o)::BIGINT AS out_events, sum(i)::BIGINT AS in_events FROM (SELECT window_idx, slice, src AS node, cnt AS o, 0 AS i FROM sl UNION ALL SELECT window_idx, slice, dst, 0, cnt FROM sl) GROUP BY ALL),
pk AS (SELECT window_idx, node, max(out_events / (in_events + 1.0)) AS acp_peak, sum(out_events) / (sum(in_events) + 1.0) AS acp_full FROM sd GROUP BY ALL)"""
_STABLE = f"""ho AS (SELECT window_idx, {sql_entity('host')} AS node, max(score) AS score FROM run_nonattack WHERE score BETWEEN 0 AND 1 AND NOT isnan(score) AND out_deg > 0 AND window_idx IS NOT NULL AND {sql_entity('host')} IS NOT NULL GROUP BY 1, 2),
tp AS (SELECT *, row_number() OVER (PARTITION BY window_idx ORDER BY score DESC, node) AS rn FROM ho)"""
_SCORED = _ALPHA + """,
sc AS (SELECT al.window_idx, al.node, al.out_deg, al.score_alpha AS score, coalesce(p.label, 0) AS label FROM al LEFT JOIN (SELECT DISTINCT idx AS window_idx, unnest(attack_pivots) AS node, 1 AS label FROM wi) p ON al.window_idx = p.window_idx AND al.node = p.node)"""


def _stream(spark: SparkSession, folder: str, category: str | None = None, detail: bool = True) -> DataFrame:
    """Clean events: each id once as first delivered, with a time and both entities; only AUTH and FLOW need ``detail``."""
    more = ["event_type", "event_detail"] if detail else ["event_type"]
    raw = table(spark, folder, "unified_event").select(
        "event_id", "ts", entity(F.col("source_entity")).alias("source_entity"), entity(F.col("destination_entity")).alias("destination_entity"), "event_category", *more, "loaded_at"
    )
    if category is not None:
        raw = raw.filter(F.col("event_category") == category)
    kept = once(raw, "event_id", "loaded_at", ["event_id", "ts", "source_entity", "destination_entity", "event_category", *more])
    return kept.filter(F.col("ts").isNotNull() & F.col("source_entity").isNotNull() & F.col("destination_entity").isNotNull())


def _info(spark: SparkSession, folder: str) -> DataFrame:
    return table(spark, folder, "window_info").filter(F.col("kind") == "adaptive").select("idx", "ts_start", "ts_end", "attack_pivots")


def _placed(spark: SparkSession, folder: str, category: str = "AUTH", detail: bool = False) -> DataFrame:
    return windows.window_events(_stream(spark, folder, category, detail), _info(spark, folder))


def _slice_edges(spark: SparkSession, folder: str) -> DataFrame:
    return graph.cell_edges(graph.pair_cells(_placed(spark, folder), _info(spark, folder)))


def _edges(spark: SparkSession, folder: str) -> DataFrame:
    return graph.window_edges(_slice_edges(spark, folder))


def _graph(spark: SparkSession, folder: str, features: bool = False) -> tuple[DataFrame, DataFrame, DataFrame | None]:
    """Nodes with degrees, edges, and edges with features if wanted; events are read and deduplicated once."""
    cells = cut_lineage(graph.pair_cells(_placed(spark, folder, detail=features), _info(spark, folder), auth=features))
    edges = graph.window_edges(graph.cell_edges(cells))
    nodes = graph.node_degrees(graph.window_nodes(cells), edges)
    if not features:
        return nodes, edges, None
    flows = cut_lineage(_stream(spark, folder, "FLOW").select(*ORDER, "source_entity", "destination_entity", "event_detail"))
    ports = graph.port_features(windows.window_events(flows, _info(spark, folder)), graph.port_vocabulary(flows, ORDER))
    return nodes, edges, graph.edge_features(edges.select(*graph.PAIR, "cnt"), graph.cell_auth_features(cells), ports)


def _nodes(spark: SparkSession, folder: str) -> DataFrame:
    return _graph(spark, folder)[0]


def _vocabulary(spark: SparkSession, folder: str) -> DataFrame:
    return graph.port_vocabulary(_stream(spark, folder, "FLOW"), ORDER)


def _ports(spark: SparkSession, folder: str) -> DataFrame:
    flows = cut_lineage(_stream(spark, folder, "FLOW").select(*ORDER, "source_entity", "destination_entity", "event_detail"))
    return graph.port_features(windows.window_events(flows, _info(spark, folder)), graph.port_vocabulary(flows, ORDER))


def _features(spark: SparkSession, folder: str) -> DataFrame:
    return _graph(spark, folder, True)[2]


def _counts(spark: SparkSession, folder: str) -> DataFrame:
    return graph.feature_counts(_features(spark, folder), _NAMES)


def _peak(spark: SparkSession, folder: str) -> DataFrame:
    return graph.peak_acp(graph.slice_degrees(_slice_edges(spark, folder)))


def _rarity(spark: SparkSession, folder: str, top: int = 1) -> DataFrame:
    nodes, _, features = _graph(spark, folder, True)
    return rank.rarity_scores(nodes, rank.edge_rarity(features, _NAMES), top)


def _quads(spark: SparkSession, folder: str, source: str | None = None) -> DataFrame:
    good = parse_quads(table(spark, folder, "quad_raw").select("line_id", "line")).filter(F.col("reason").isNull()).drop("reason", "rejected")
    return good if source is None else good.filter(F.col("source_file") == source)


def _scored(spark: SparkSession, folder: str) -> DataFrame:
    nodes = _nodes(spark, folder)
    scores = nodes.select("window_idx", "node", "out_deg", rank.percentile(graph.acp(F.col("out_deg"), F.col("in_deg"))).alias("score"))
    return scores.join(graph.labels(nodes, _info(spark, folder)), ["window_idx", "node"])


def _usable(spark: SparkSession, folder: str) -> DataFrame:
    runs = table(spark, folder, "run_nonattack").select("window_idx", entity(F.col("host")).alias("node"), "score", "out_deg")
    usable = runs.filter((F.col("score") >= 0) & (F.col("score") <= 1) & F.col("node").isNotNull() & F.col("window_idx").isNotNull() & (F.col("out_deg") > 0))
    return usable.groupBy("window_idx", "node").agg(F.max("score").alias("score"), F.max("out_deg").alias("out_deg"))


def _stable(spark: SparkSession, folder: str) -> DataFrame:
    return evaluate.top_candidates(_usable(spark, folder))


# ---- scalar functions --------------------------------------------------------------------------------------------


@_register(rf"""SELECT DISTINCT name, regexp_replace(regexp_replace(coalesce(name, ''), '(?i)@DOM[0-9]+$', ''), '\$$', '') AS node FROM (SELECT source_entity AS name FROM unified_event UNION ALL SELECT destination_entity FROM unified_event)""")
def node_names(spark: SparkSession, folder: str) -> DataFrame:
    names = table(spark, folder, "unified_event").select(F.explode(F.array("source_entity", "destination_entity")).alias("name")).distinct()
    return names.select("name", normalize_node(F.col("name")).alias("node"))


@_register(rf"""WITH {_QUADS}, sp AS (SELECT line_id, src_node, position('|' IN src_node) AS bar, split_part(src_node, '|', 1) AS lft FROM judged WHERE reason IS NULL)
SELECT line_id, CASE WHEN bar = 0 THEN '' WHEN contains(lft, '@') THEN regexp_extract(lft, '(?s)^(.*)@[^@]*$', 1) ELSE lft END AS account,
    CASE WHEN bar > 0 THEN regexp_extract(lft, '(?s)@([^@]*)$', 1) ELSE '' END AS account_domain,
    regexp_replace(regexp_replace(CASE WHEN bar = 0 THEN src_node ELSE substring(src_node, bar + 1) END, '(?i)@DOM[0-9]+$', ''), '\$$', '') AS machine FROM sp""")
def split_accounts(spark: SparkSession, folder: str) -> DataFrame:
    node = F.col("src_node")
    return _quads(spark, folder).select("line_id", account_part(node).alias("account"), domain_part(node).alias("account_domain"), machine_part(node).alias("machine"))


_AUTH_RE = "'^([^_]+)_([^_]+)_([^_]+)_([^_]+)$'"
_FLOW_RE = "'^NetFlow_([^_]+)_([^>]+)>([^>]+)$'"


def _types(spark: SparkSession, folder: str, category: str) -> DataFrame:
    return table(spark, folder, "unified_event").filter(F.col("event_category") == category).select("event_type").distinct()


@_register(f"""WITH t AS (SELECT DISTINCT event_type FROM unified_event WHERE event_category = 'AUTH'), m AS (SELECT event_type, regexp_matches(coalesce(event_type, ''), {_AUTH_RE}) AS ok FROM t)
SELECT event_type, {', '.join(f"CASE WHEN ok THEN regexp_extract(event_type, {_AUTH_RE}, {k}) END AS {n}" for k, n in enumerate(('action_category', 'status', 'subtype', 'protocol'), 1))}, CASE WHEN NOT ok THEN coalesce(event_type, '') END AS raw FROM m""")
def auth_actions(spark: SparkSession, folder: str) -> DataFrame:
    return _types(spark, folder, "AUTH").select("event_type", *[c.alias(n) for n, c in parsers.auth_fields(F.col("event_type")).items()])


@_register(f"""WITH t AS (SELECT DISTINCT event_type FROM unified_event WHERE event_category = 'FLOW'), m AS (SELECT event_type, regexp_matches(coalesce(event_type, ''), {_FLOW_RE}) AS ok FROM t),
f AS (SELECT event_type, {', '.join(f"CASE WHEN ok THEN regexp_extract(event_type, {_FLOW_RE}, {k}) END AS {n}" for k, n in enumerate(('protocol', 'src_port', 'dst_port'), 1))}, CASE WHEN NOT ok THEN coalesce(event_type, '') END AS raw FROM m)
SELECT *, coalesce(protocol = '17' AND dst_port IN ('137', '138', '123'), false) AS noise,
    array_to_string(list_filter([try_cast(regexp_extract(src_port, '^[0-9]+$') AS BIGINT), try_cast(regexp_extract(dst_port, '^[0-9]+$') AS BIGINT)], lambda x: x IS NOT NULL), ',') AS ports FROM f""")
def flow_actions(spark: SparkSession, folder: str) -> DataFrame:
    parts = _types(spark, folder, "FLOW").select("event_type", *[c.alias(n) for n, c in parsers.flow_fields(F.col("event_type")).items()])
    return parts.withColumn("noise", parsers.is_noise_flow(F.col("event_type"))).withColumn("ports", F.array_join(F.transform(parsers.service_ports(F.col("src_port"), F.col("dst_port")), lambda x: x.cast("string")), ","))


@_register("""SELECT DISTINCT event_category, event_type, CASE WHEN position('Process_' IN coalesce(event_type, '')) > 0 THEN left(event_type, position('Process_' IN event_type) - 1) || substring(event_type, position('Process_' IN event_type) + 8) ELSE coalesce(event_type, '') END AS action,
    nullif(regexp_extract(coalesce(event_type, ''), 'RedTeam_via_(C[0-9]+)', 1), '') AS pivot FROM unified_event WHERE event_category IN ('PROC', 'ALERT', 'DNS')""")
def other_actions(spark: SparkSession, folder: str) -> DataFrame:
    rows = table(spark, folder, "unified_event").filter(F.col("event_category").isin("PROC", "ALERT", "DNS")).select("event_category", "event_type").distinct()
    return rows.withColumns({"action": parsers.proc_action(F.col("event_type")), "pivot": parsers.pivot_machine(F.col("event_type"))})


# ---- raw text and cleaning ---------------------------------------------------------------------------------------


def _raw_lines(spark: SparkSession, folder: str, category: str, *fields: str) -> DataFrame:
    """Raw lines made from the events; a null name leaves a field out, so that its line is too short."""
    events = table(spark, folder, "unified_event").filter(F.col("event_category") == category)
    return events.select(F.expr(f"concat_ws(',', {', '.join(fields)})").alias("value"))


# fields that follow from the event's number, the same text in both languages
_PROTOCOL = "CASE event_id % 3 WHEN 0 THEN 'NTLM' WHEN 1 THEN 'Kerberos' ELSE '?' END"
_STATUS = "CASE event_id % 2 WHEN 0 THEN 'Success' ELSE 'Failure' END"
_KIND = "CASE event_id % 5 WHEN 0 THEN 'LogOff' WHEN 1 THEN 'TGS' ELSE 'LogOn' END"
_SRC_PORT = "CASE event_id % 4 WHEN 0 THEN '445' WHEN 1 THEN '137' ELSE 'N12' END"
_DST_PORT = "CASE event_id % 7 WHEN 0 THEN '137' WHEN 1 THEN '88' ELSE 'N7' END"
_NUMBER = "CASE event_id % 2 WHEN 0 THEN '6' ELSE '17' END"
_COMPLETE = "source_entity IS NOT NULL AND destination_entity IS NOT NULL AND ts IS NOT NULL"


@_register(f"""SELECT ts::VARCHAR AS timestamp, 'U' || event_id || '@DOM1|' || source_entity AS src_node, destination_entity AS dst_node,
    ({_KIND}) || '_' || ({_STATUS}) || '_Network_' || ({_PROTOCOL}) AS action_state, 'auth' AS source_file FROM unified_event WHERE event_category = 'AUTH' AND {_COMPLETE}""")
def raw_auth_convert(spark: SparkSession, folder: str) -> DataFrame:
    lines = _raw_lines(spark, folder, "AUTH", "ts", "concat('U', event_id, '@DOM1')", "'U0@DOM1'", "source_entity", "destination_entity", _PROTOCOL, "'Network'", _KIND, _STATUS)
    return ingest.convert_raw(lines, "auth")


@_register(f"""SELECT ts::VARCHAR AS timestamp, source_entity AS src_node, destination_entity AS dst_node, 'NetFlow_' || ({_NUMBER}) || '_' || ({_SRC_PORT}) || '>' || ({_DST_PORT}) AS action_state, 'flows' AS source_file
FROM unified_event WHERE event_category = 'FLOW' AND {_COMPLETE}""")
def raw_flow_convert(spark: SparkSession, folder: str) -> DataFrame:
    return ingest.convert_raw(_raw_lines(spark, folder, "FLOW", "ts", "event_id", "source_entity", _SRC_PORT, "destination_entity", _DST_PORT, _NUMBER), "flows")


@_register("""SELECT ts::VARCHAR AS timestamp, 'U' || event_id || '@DOM1' AS src_node, destination_entity AS dst_node, 'RedTeam_via_' || source_entity AS action_state, 'redteam' AS source_file
FROM unified_event WHERE event_category = 'ALERT' AND source_entity IS NOT NULL AND destination_entity IS NOT NULL AND ts IS NOT NULL""")
def raw_redteam_convert(spark: SparkSession, folder: str) -> DataFrame:
    return ingest.convert_raw(_raw_lines(spark, folder, "ALERT", "ts", "concat('U', event_id, '@DOM1')", "source_entity", "destination_entity"), "redteam")


def _norm(name: str) -> str:
    return rf"regexp_replace(regexp_replace(coalesce({name}, ''), '(?i)@DOM[0-9]+$', ''), '\$$', '')"


_MACHINE = _norm("CASE WHEN contains(src_node, '|') THEN substring(src_node, position('|' IN src_node) + 1) ELSE src_node END")
_CLEAN = "timestamp, try_cast(timestamp AS BIGINT) AS ts, {s} AS source_entity, {d} AS destination_entity, '{c}' AS event_category, action_state AS event_type"


def _parts(form: str, names: tuple[str, ...]) -> str:
    """The parts of an action as the detail has them; an action of another form is kept raw."""
    whole = f"regexp_matches(action_state, {form})"
    parts = [f"CASE WHEN {whole} THEN regexp_extract(action_state, {form}, {k}) END AS detail_{n}" for k, n in enumerate(names, 1)]
    return ", ".join([*parts, f"CASE WHEN NOT {whole} THEN action_state END AS detail_raw"])


def _details(events: DataFrame, *names: str) -> DataFrame:
    return events.withColumns({f"detail_{n}": parsers.detail_field(F.col("event_detail"), n) for n in names}).drop("event_detail")


_AUTH_NAMES, _FLOW_NAMES = ("action_category", "status", "subtype", "protocol"), ("protocol", "src_port", "dst_port")
_LEFT = "split_part(src_node, '|', 1)"
_ACCOUNT = rf"""CASE WHEN NOT contains(src_node, '|') THEN '' WHEN contains({_LEFT}, '@') THEN regexp_extract({_LEFT}, '(?s)^(.*)@[^@]*$', 1) ELSE {_LEFT} END AS detail_account,
    CASE WHEN contains(src_node, '|') THEN regexp_extract({_LEFT}, '(?s)@([^@]*)$', 1) ELSE '' END AS detail_account_domain, {_MACHINE} AS detail_source_machine_raw"""


@_register(f"WITH {_QUADS} SELECT {_CLEAN.format(s=_MACHINE, d=_norm('dst_node'), c='AUTH')}, {_parts(_AUTH_RE, _AUTH_NAMES)}, {_ACCOUNT} FROM judged WHERE reason IS NULL AND source_file = 'auth'")
def clean_auth(spark: SparkSession, folder: str) -> DataFrame:
    return _details(ingest.clean_auth(_quads(spark, folder, "auth")), *_AUTH_NAMES, "raw", "account", "account_domain", "source_machine_raw")


@_register(f"WITH {_QUADS} SELECT {_CLEAN.format(s=_norm('src_node'), d=_norm('dst_node'), c='FLOW')}, {_parts(_FLOW_RE, _FLOW_NAMES)} FROM judged WHERE reason IS NULL AND source_file = 'flows' AND NOT (regexp_matches(action_state, '^NetFlow_17_[^>]+>(137|138|123)$'))")
def clean_flows(spark: SparkSession, folder: str) -> DataFrame:
    return _details(ingest.clean_flows(_quads(spark, folder, "flows")), *_FLOW_NAMES, "raw")


@_register(f"WITH {_QUADS} SELECT {_CLEAN.format(s=_norm('src_node'), d=_norm('dst_node'), c='DNS')}, 'DNS_Query' AS detail_query FROM judged WHERE reason IS NULL AND source_file = 'dns'")
def clean_dns(spark: SparkSession, folder: str) -> DataFrame:
    return _details(ingest.clean_dns(_quads(spark, folder, "dns")), "query")


@_register(f"WITH {_QUADS} SELECT {_CLEAN.format(s=_norm('src_node'), d=_norm('dst_node'), c='PROC')}, replace(action_state, 'Process_', '') AS detail_action FROM judged WHERE reason IS NULL AND source_file = 'proc' AND {_norm('src_node')} <> {_norm('dst_node')}")
def clean_proc(spark: SparkSession, folder: str) -> DataFrame:
    return _details(ingest.clean_proc(_quads(spark, folder, "proc")), "action")


_PIVOT = "nullif(regexp_extract(coalesce(action_state, ''), 'RedTeam_via_(C[0-9]+)', 1), '')"


@_register(f"""WITH {_QUADS}, red AS (SELECT timestamp, src_node, dst_node, action_state FROM judged WHERE reason IS NULL AND source_file = 'redteam'
    UNION ALL SELECT ts::VARCHAR, source_entity, destination_entity, event_type FROM unified_event WHERE event_category = 'ALERT')
SELECT {_CLEAN.format(s=_norm(f'coalesce({_PIVOT}, src_node)'), d=_norm('dst_node'), c='ALERT')}, {_PIVOT} AS detail_pivot_machine, CASE WHEN {_PIVOT} IS NULL THEN coalesce(action_state, '') END AS detail_raw FROM red""")
def clean_redteam(spark: SparkSession, folder: str) -> DataFrame:
    """Alert lines of the quads, and quads made of the alerts among the events."""
    alerts = table(spark, folder, "unified_event").filter(F.col("event_category") == "ALERT").select(F.col("ts").cast("string").alias("timestamp"), F.col("source_entity").alias("src_node"), F.col("destination_entity").alias("dst_node"), F.col("event_type").alias("action_state"))
    lines = _quads(spark, folder, "redteam").select("timestamp", "src_node", "dst_node", "action_state")
    return _details(ingest.clean_redteam(lines.unionByName(alerts)), "pivot_machine", "raw")


@_register(f"""WITH {_QUADS}, c AS (SELECT source_file, count(*) AS total_in, count(*) FILTER (WHERE source_file = 'flows' AND regexp_matches(action_state, '^NetFlow_17_[^>]+>(137|138|123)$')) AS noise_filtered,
    count(*) FILTER (WHERE source_file = 'proc' AND {_norm('src_node')} = {_norm('dst_node')}) AS self_loops_dropped FROM judged WHERE reason IS NULL AND source_file IN ('auth', 'flows', 'dns', 'proc', 'redteam') GROUP BY source_file)
SELECT *, total_in - noise_filtered - self_loops_dropped AS total_out, round((total_in - noise_filtered - self_loops_dropped) * 100.0 / total_in, 6)::DOUBLE AS kept_pct FROM c""")
def cleaning_stats(spark: SparkSession, folder: str) -> DataFrame:
    return ingest.cleaning_counts(_quads(spark, folder)).withColumn("kept_pct", F.round(F.col("kept_pct").cast("double"), 6))


@_register(f"WITH {_STREAM}, {_VOCABULARY} SELECT * FROM vo")
def port_vocab(spark: SparkSession, folder: str) -> DataFrame:
    return _vocabulary(spark, folder).withColumns(_long("port_idx"))


# ---- windows -----------------------------------------------------------------------------------------------------


@_register(f"""WITH {_STREAM}, o AS (SELECT ts, row_number() OVER (ORDER BY ts, event_id) - 1 AS pos, count(*) OVER () AS n FROM st WHERE category = 'AUTH'),
p AS (SELECT pos // 700 AS idx, min(ts) AS ts_start, max(ts) AS ts_end, count(*) AS m FROM o GROUP BY 1),
t AS (SELECT idx - 1 AS idx, ts_end AS tail_end FROM p WHERE m < 700)
SELECT idx, ts_start, coalesce(tail_end, ts_end) AS ts_end, m, tail_end IS NOT NULL AS is_merged_tail FROM (SELECT * FROM p WHERE m = 700) LEFT JOIN t USING (idx)""")
def fixed_event_windows(spark: SparkSession, folder: str) -> DataFrame:
    return windows.fixed_event_windows(_stream(spark, folder, "AUTH", False), 700, ORDER)


def _adaptive_sql(m: int, e: int, vs: int, vd: int, tail: str) -> str:
    """Windows by recursion over their starts; ``tail`` is merge, drop (merged without its pairs) or own."""
    merged = f"(SELECT count(*) FROM wins) > 1 AND m < {0.5 * m}" if tail != "own" else "false"
    return f"""WITH RECURSIVE {_STREAM}, ev AS MATERIALIZED (SELECT row_number() OVER (ORDER BY ts, event_id) AS pos, ts, src, dst FROM st WHERE category = 'AUTH'),
a AS MATERIALIZED (SELECT pos, ts, src, dst, coalesce(lag(pos) OVER (PARTITION BY src, dst ORDER BY pos), 0) AS pp, coalesce(lag(pos) OVER (PARTITION BY src ORDER BY pos), 0) AS ps, coalesce(lag(pos) OVER (PARTITION BY dst ORDER BY pos), 0) AS pd FROM ev),
bounds AS (SELECT 1::BIGINT AS s UNION ALL SELECT (SELECT min(pos) + 1 FROM (SELECT pos, pos - b.s + 1 AS m, count(*) FILTER (WHERE pp < b.s) OVER w AS e, count(*) FILTER (WHERE ps < b.s) OVER w AS vs, count(*) FILTER (WHERE pd < b.s) OVER w AS vd FROM a WHERE pos >= b.s WINDOW w AS (ORDER BY pos)) WHERE m >= {m} AND e >= {e} AND vs >= {vs} AND vd >= {vd}) FROM bounds b WHERE b.s IS NOT NULL),
starts AS (SELECT row_number() OVER (ORDER BY s) - 1 AS idx, s, coalesce(lead(s) OVER (ORDER BY s), 1 + (SELECT max(pos) FROM a)) AS z, lead(s) OVER (ORDER BY s) IS NULL AS open FROM bounds WHERE s IS NOT NULL AND s <= (SELECT max(pos) FROM a)),
wins AS (SELECT idx, open, arg_min(ts, pos) AS ts_start, arg_max(ts, pos) AS ts_end, count(*) AS m, count(DISTINCT (src, dst)) AS e, count(DISTINCT src) AS v_src, count(DISTINCT dst) AS v_dst FROM starts JOIN a ON pos >= s AND pos < z GROUP BY ALL),
vt AS (SELECT idx, count(*) AS v_total FROM (SELECT idx, src AS node FROM starts JOIN a ON pos >= s AND pos < z UNION SELECT idx, dst FROM starts JOIN a ON pos >= s AND pos < z) GROUP BY idx),
tl AS (SELECT * FROM wins WHERE open AND {merged})
SELECT w.idx, w.ts_start, coalesce(t.ts_end, w.ts_end) AS ts_end, w.m + coalesce(t.m, 0) AS m, w.e + {'coalesce(t.e, 0)' if tail == 'merge' else '0'} AS e, w.v_src, w.v_dst, v_total, t.idx IS NOT NULL AS is_merged_tail
FROM wins w JOIN vt ON w.idx = vt.idx LEFT JOIN tl t ON t.idx = w.idx + 1 WHERE w.idx NOT IN (SELECT idx FROM tl)"""


def _adaptive(m: int, e: int, vs: int, vd: int, **tail: object) -> Callable[[SparkSession, str], DataFrame]:
    return lambda spark, folder: windows.adaptive_windows(_stream(spark, folder, "AUTH", False), windows.Thresholds(m, e, vs, vd), ORDER, **tail)


for _name, _args, _tail, _options in (
    ("adaptive_windows", (500, 50, 20, 20), "merge", {}),
    ("adaptive_windows_pairs", (100, 400, 20, 20), "merge", {}),
    ("adaptive_windows_sources", (100, 100, 250, 20), "drop", {"tail_pairs": False}),
    ("adaptive_windows_own_tail", (400, 100, 20, 280), "own", {"merge_tail": False}),
):
    QUERIES[_name], ORACLES[_name] = _adaptive(*_args, **_options), _adaptive_sql(*_args, _tail)


@_register(f"""WITH {_PLACED} SELECT window_idx, count(*) AS m, count(DISTINCT (src, dst)) AS e, count(DISTINCT src) AS v_src, count(DISTINCT dst) AS v_dst, any_value(v_total) AS v_total FROM pl JOIN (SELECT window_idx, count(*) AS v_total FROM (SELECT window_idx, src FROM pl UNION SELECT window_idx, dst FROM pl) GROUP BY 1) USING (window_idx) GROUP BY window_idx""")
def window_statistics(spark: SparkSession, folder: str) -> DataFrame:
    return windows.window_counts(_placed(spark, folder))


@_register(f"""WITH {_PLACED}, c AS (SELECT window_idx, count(*) AS m FROM pl GROUP BY 1), l AS (SELECT list_sort(list(m)) AS a, avg(m) AS mean, count(*) AS n FROM c)
SELECT n, a[1] AS min, a[n // 4 + 1] AS q1, a[n // 2 + 1] AS median, a[3 * n // 4 + 1] AS q3, a[-1] AS max, round(mean, 6) AS mean FROM l""")
def window_quantiles(spark: SparkSession, folder: str) -> DataFrame:
    return windows.quartiles(windows.window_counts(_placed(spark, folder)), F.col("m")).withColumn("mean", _r("mean"))


@_register(f"WITH {_PLACED} SELECT (SELECT sum(e)::BIGINT FROM (SELECT window_idx, count(DISTINCT (src, dst)) AS e FROM pl GROUP BY 1)) AS pairs_by_window, count(DISTINCT (src, dst)) AS pairs FROM pl")
def window_unique_pairs(spark: SparkSession, folder: str) -> DataFrame:
    pairs = _placed(spark, folder).groupBy("source_entity", "destination_entity").agg(F.count_distinct("window_idx").alias("windows"))
    return pairs.agg(F.sum("windows").alias("pairs_by_window"), F.count(F.lit(1)).alias("pairs"))


_ALERTS = _STREAM + """,
hit AS (SELECT event_id, ts, regexp_extract(event_type, 'RedTeam_via_(C[0-9]+)', 1) AS pv, min(idx) AS idx FROM st JOIN wi ON ts BETWEEN ts_start AND ts_end WHERE category = 'ALERT' AND regexp_matches(event_type, 'RedTeam_via_(C[0-9]+)') GROUP BY ALL),
ann AS (SELECT wi.idx, ts_start, ts_end, coalesce(n, 0) AS attack_event_count, n IS NOT NULL AS has_attack, coalesce(pivots, '') AS pivots FROM wi LEFT JOIN (SELECT idx, sum(c)::BIGINT AS n, string_agg(pv, ',' ORDER BY first, pv) AS pivots FROM (SELECT idx, pv, count(*) AS c, min(ts) AS first FROM hit GROUP BY ALL) GROUP BY idx) h ON wi.idx = h.idx)"""


def _annotated(spark: SparkSession, folder: str) -> DataFrame:
    alerts = _stream(spark, folder, "ALERT", False).select(F.col("event_id").alias("alert_id"), "ts", parsers.pivot_machine(F.col("event_type")).alias("pivot")).filter(F.col("pivot").isNotNull())
    return windows.annotate_attacks(_info(spark, folder), alerts)


@_register(f"WITH {_ALERTS} SELECT * FROM ann")
def attack_annotation(spark: SparkSession, folder: str) -> DataFrame:
    return _annotated(spark, folder).select("idx", "ts_start", "ts_end", "attack_event_count", "has_attack", F.array_join("attack_pivots", ",").alias("pivots"))


@_register(f"WITH {_ALERTS} SELECT pv AS \"pivot\", count(DISTINCT idx) AS windows, string_agg(DISTINCT idx::VARCHAR, ',' ORDER BY idx::VARCHAR) AS idxs FROM hit GROUP BY pv")
def pivot_coverage(spark: SparkSession, folder: str) -> DataFrame:
    return windows.pivot_coverage(_annotated(spark, folder)).withColumn("idxs", F.array_join(F.array_sort(F.transform("idxs", lambda x: x.cast("string"))), ","))


# ---- micro-slices and graphs -------------------------------------------------------------------------------------


@_register(f"WITH {_SLICED} SELECT window_idx, slice, sum(cnt)::BIGINT AS n_events, count(*) AS n_pairs, count(DISTINCT src) AS n_sources, count(DISTINCT dst) AS n_dests FROM sl GROUP BY ALL")
def micro_slices(spark: SparkSession, folder: str) -> DataFrame:
    return graph.slice_counts(_slice_edges(spark, folder))


@_register(f"""WITH {_SLICED}, b AS (SELECT idx AS window_idx, j AS slice, ts_start + trunc(j * ((ts_end - ts_start) / 4.0))::BIGINT AS slice_start, ts_start + trunc((j + 1) * ((ts_end - ts_start) / 4.0))::BIGINT AS slice_end FROM wi, range(4) t(j) WHERE ts_end > ts_start)
SELECT b.window_idx, b.slice, round(sum(cnt) / greatest(any_value(slice_end - slice_start), 1), 6) AS events_per_second FROM sl JOIN b USING (window_idx, slice) GROUP BY ALL""")
def slice_rates(spark: SparkSession, folder: str) -> DataFrame:
    return graph.rate_report(graph.slice_counts(_slice_edges(spark, folder)), graph.slice_bounds(_info(spark, folder))).withColumns({"events_per_second": _r("events_per_second")} | _long("slice"))


@_register(f"WITH {_PEAK} SELECT * FROM sd")
def slice_degrees(spark: SparkSession, folder: str) -> DataFrame:
    return graph.slice_degrees(_slice_edges(spark, folder))


@_register(f"WITH {_SLICED} SELECT window_idx, slice, src AS source_entity, dst AS destination_entity, cnt FROM sl")
def slice_edge_counts(spark: SparkSession, folder: str) -> DataFrame:
    return _slice_edges(spark, folder)


@_register(f"""WITH {_SLICED} SELECT window_idx, src AS source_entity, dst AS destination_entity, sum(cnt)::BIGINT AS cnt, {', '.join(f'max((slice = {j})::INT)::DOUBLE AS occ_{j}' for j in range(4))},
    {', '.join(f'round(ln(1 + sum(CASE WHEN slice = {j} THEN cnt ELSE 0 END)), 6) AS mcount_{j}' for j in range(4))} FROM sl GROUP BY ALL""")
def edge_time_targets(spark: SparkSession, folder: str) -> DataFrame:
    return _edges(spark, folder).withColumns({f"mcount_{j}": _r(f"mcount_{j}") for j in range(4)})


@_register(f"WITH {_SLICED}, o AS (SELECT window_idx, src, dst, count(*) / 4.0 AS x FROM sl GROUP BY ALL) SELECT window_idx, round(avg((x <= 0.25)::INT) * 100, 6) AS pct_sparse, round(avg((x >= 1)::INT) * 100, 6) AS pct_full FROM o GROUP BY window_idx")
def occupancy(spark: SparkSession, folder: str) -> DataFrame:
    return graph.occupancy_report(_edges(spark, folder)).withColumns({c: _r(c) for c in ("pct_sparse", "pct_full")})


@_register(f"WITH {_PEAK} SELECT window_idx, node, round(acp_peak, 6)::DOUBLE AS acp_peak, round(acp_full, 6)::DOUBLE AS acp_full FROM pk")
def peak_acp(spark: SparkSession, folder: str) -> DataFrame:
    return _peak(spark, folder).withColumns({c: _r(c) for c in ("acp_peak", "acp_full")})


@_register(f"WITH {_EDGES} SELECT * FROM dg")
def window_degrees(spark: SparkSession, folder: str) -> DataFrame:
    return _nodes(spark, folder).withColumns(_long("node_id"))


@_register(f"WITH {_PLACED}, {_AUTH} SELECT window_idx, src AS source_entity, dst AS destination_entity, 1.0::DOUBLE AS is_auth, * EXCLUDE (window_idx, src, dst) FROM au")
def auth_features(spark: SparkSession, folder: str) -> DataFrame:
    return graph.auth_features(_placed(spark, folder, detail=True))


@_register(f"WITH {_STREAM}, {_PORTS} SELECT window_idx, src AS source_entity, dst AS destination_entity, * EXCLUDE (window_idx, src, dst) FROM po")
def port_features(spark: SparkSession, folder: str) -> DataFrame:
    return _ports(spark, folder)


@_register(f"WITH {_FEATURES} SELECT src AS source_entity, dst AS destination_entity, * EXCLUDE (src, dst, log_count), round(log_count, 6) AS log_count FROM ef")
def edge_features(spark: SparkSession, folder: str) -> DataFrame:
    return _features(spark, folder).withColumn("log_count", _r("log_count"))


_X = ("ln(1 + in_deg)", "ln(1 + out_deg)", "0.0", "ln(1 + out_deg / (in_deg + 1.0))", "ln(1 + in_deg / greatest(max(in_deg) OVER w, 1) * 1e7) / 16", "ln(1 + out_deg / (in_deg + 1.0)) / 12",
      "ln(1 + in_deg) / greatest(max(ln(1 + in_deg)) OVER w, 1)", "ln(1 + out_deg) / greatest(max(ln(1 + out_deg)) OVER w, 1)")


@_register(f"""WITH {_EDGES}, x AS (SELECT window_idx, node, node_id, out_deg, in_deg, {', '.join(f'({e})::DOUBLE AS x{k}' for k, e in enumerate(_X))} FROM dg WINDOW w AS (PARTITION BY window_idx))
SELECT window_idx, node, node_id, out_deg, in_deg, {', '.join(f'round((x{k} - avg(x{k}) OVER w) / CASE WHEN stddev_pop(x{k}) OVER w > 1e-12 THEN stddev_pop(x{k}) OVER w ELSE 1 END, 6) + 0.0 AS x{k}' for k in range(8))} FROM x WINDOW w AS (PARTITION BY window_idx)""")
def node_features_z(spark: SparkSession, folder: str) -> DataFrame:
    return graph.node_features(_nodes(spark, folder)).withColumns({f"x{k}": (_r(f"x{k}") + F.lit(0.0)) for k in range(8)} | _long("node_id"))


@_register(f"""WITH {_EDGES}, t AS (SELECT window_idx, node, ln(1 + in_deg) AS a, ln(1 + out_deg) AS b FROM dg)
SELECT window_idx, node, {', '.join(f'round(({c} - avg({c}) OVER w) / CASE WHEN stddev_pop({c}) OVER w > 1e-12 THEN stddev_pop({c}) OVER w ELSE 1 END, 6) + 0.0 AS {n}' for c, n in (('a', 't_in'), ('b', 't_out')))} FROM t WINDOW w AS (PARTITION BY window_idx)""")
def degree_targets(spark: SparkSession, folder: str) -> DataFrame:
    return graph.degree_targets(_nodes(spark, folder)).withColumns({c: _r(c) + F.lit(0.0) for c in ("t_in", "t_out")})


@_register(f"WITH {_COUNTS} SELECT window_idx, feature, round(r / avg(r) OVER (PARTITION BY window_idx), 6) AS weight FROM (SELECT *, 1 / sqrt(greatest(cnt, 1) / n_edges) AS r FROM fc) UNION ALL SELECT DISTINCT window_idx, 'log_count', 0.5 FROM fc")
def ief_weights(spark: SparkSession, folder: str) -> DataFrame:
    return graph.ief_weights(_counts(spark, folder)).withColumn("weight", _r("weight"))


@_register(f"WITH {_COUNTS} SELECT window_idx, feature, (cnt >= 5)::INT AS active FROM fc UNION ALL SELECT DISTINCT window_idx, 'log_count', 1 FROM fc")
def category_mask(spark: SparkSession, folder: str) -> DataFrame:
    return graph.category_mask(_counts(spark, folder))


@_register(f"WITH {_COUNTS} SELECT window_idx, sum((cnt >= 5)::INT)::BIGINT AS active, count(*) AS total, round(avg((cnt >= 5)::INT), 6) AS ratio FROM fc GROUP BY window_idx")
def active_categories(spark: SparkSession, folder: str) -> DataFrame:
    return graph.active_categories(_counts(spark, folder)).withColumn("ratio", _r("ratio"))


# ---- ranks -------------------------------------------------------------------------------------------------------


@_register(f"WITH {_ALPHA} SELECT window_idx, node, round(score_alpha, 6) AS score_alpha FROM al")
def acp_percentile(spark: SparkSession, folder: str) -> DataFrame:
    return rank.asymmetry(_nodes(spark, folder)).withColumn("score_alpha", _r("score_alpha"))


@_register(f"""WITH {_PEAK}, p AS (SELECT window_idx, node, row_number() OVER (PARTITION BY window_idx ORDER BY acp_full, node) / count(*) OVER (PARTITION BY window_idx) AS p_full, row_number() OVER (PARTITION BY window_idx ORDER BY acp_peak, node) / count(*) OVER (PARTITION BY window_idx) AS p_peak FROM pk)
SELECT window_idx, node, round(p_full, 6) AS p_full, round(p_peak, 6) AS p_peak, round(greatest(p_full, p_peak), 6) AS p_max FROM p""")
def structural_scores(spark: SparkSession, folder: str) -> DataFrame:
    return rank.structural_scores(_peak(spark, folder)).withColumns({c: _r(c) for c in ("p_full", "p_peak", "p_max")})


@_register(f"""WITH {_RARITY}, b AS (SELECT n.window_idx, n.node, coalesce(max(rarity), 0) AS rarity FROM nd n LEFT JOIN ra ON n.window_idx = ra.window_idx AND n.node = ra.src GROUP BY ALL)
SELECT window_idx, node, round(rarity, 6) AS rarity, round(row_number() OVER (PARTITION BY window_idx ORDER BY round(rarity, 9), node) / count(*) OVER (PARTITION BY window_idx), 6) AS score_beta FROM b""")
def ief_rarity(spark: SparkSession, folder: str) -> DataFrame:
    return _rarity(spark, folder).withColumns({c: _r(c) for c in ("rarity", "score_beta")})


@_register(f"""WITH {_RARITY}, k AS (SELECT window_idx, src AS node, avg(rarity) AS r FROM (SELECT *, row_number() OVER (PARTITION BY window_idx, src ORDER BY rarity DESC, dst) AS k FROM ra) WHERE k <= 3 GROUP BY ALL)
SELECT n.window_idx, n.node, round(coalesce(r, 0), 6) AS rarity FROM nd n LEFT JOIN k ON n.window_idx = k.window_idx AND n.node = k.node""")
def rarity_top3(spark: SparkSession, folder: str) -> DataFrame:
    return _rarity(spark, folder, 3).select("window_idx", "node", _r("rarity"))


def _rank_sql(edges: str, keys: str, nodes: str | None = None) -> str:
    """PageRank by 120 steps of recursion, beyond which no rank moves in nine digits, from ``edges`` ev ({keys}src, dst)."""
    k = lambda a: "".join(f"{a}.{x}, " for x in keys.split())
    on = lambda a, b: "".join(f"{a}.{x} = {b}.{x} AND " for x in keys.split())
    by = ", ".join(keys.split()) or "1::INT"
    own = "".join(f"{x}, " for x in keys.split())
    return f"""{edges}, n AS MATERIALIZED ({nodes or 'SELECT src AS node FROM ev UNION SELECT dst FROM ev'}), k AS MATERIALIZED (SELECT {own}count(*) AS n FROM n GROUP BY {by}),
d AS MATERIALIZED (SELECT {own}src, count(*) AS d FROM ev GROUP BY {own}src), li AS MATERIALIZED (SELECT ev.*, d FROM ev JOIN d ON {on('ev', 'd')}ev.src = d.src),
ba AS MATERIALIZED (SELECT n.*, k.n, d.d IS NULL AS loose FROM n JOIN k ON {on('n', 'k')}true LEFT JOIN d ON {on('n', 'd')}n.node = d.src),
pr AS (SELECT 0 AS i, {own}node, 1.0::DOUBLE / n AS r FROM ba UNION ALL
    SELECT i + 1, {k('b')}b.node, 0.15 / b.n + 0.85 * coalesce(l.loose, 0) / b.n + 0.85 * coalesce(g.got, 0) FROM ba b CROSS JOIN (SELECT max(i) AS i FROM pr) s
    LEFT JOIN (SELECT {k('li')}li.dst, sum(p.r / li.d) AS got FROM li JOIN pr p ON {on('p', 'li')}p.node = li.src GROUP BY {k('li')}li.dst) g ON {on('g', 'b')}g.dst = b.node
    LEFT JOIN (SELECT {k('b2')}sum(p.r) AS loose FROM pr p JOIN ba b2 ON {on('p', 'b2')}p.node = b2.node WHERE b2.loose{' GROUP BY ' + k('b2')[:-2] if keys else ''}) l ON {on('l', 'b')}true WHERE s.i < 120)
SELECT {own}node, round(r, 6) AS pagerank FROM pr WHERE i = 120"""


@_register(_rank_sql(f"WITH RECURSIVE {_STREAM}, ev AS MATERIALIZED (SELECT DISTINCT src, dst FROM st WHERE category = 'AUTH')", ""))
def graph_pagerank(spark: SparkSession, folder: str) -> DataFrame:
    """The whole history as one graph, by joins, to a tolerance that settles six digits."""
    pairs = _stream(spark, folder, "AUTH", False).select("source_entity", "destination_entity").distinct()
    nodes = pairs.select(F.explode(F.array("source_entity", "destination_entity")).alias("node")).distinct()
    return rank.graph_pagerank(nodes, cut_lineage(pairs), tolerance=1e-9).select("node", F.round("pagerank", 6).alias("pagerank"))


@_register(_rank_sql("WITH RECURSIVE " + _EDGES + ", ev AS MATERIALIZED (SELECT window_idx, src, dst FROM ed)", "window_idx", "SELECT window_idx, node FROM nd"))
def pagerank_windows(spark: SparkSession, folder: str) -> DataFrame:
    return rank.window_pagerank(*_graph(spark, folder)[:2], tolerance=1e-10).select("window_idx", "node", F.round("pagerank", 6).alias("pagerank"))


@_register()
def laplacian_positions(spark: SparkSession, folder: str) -> DataFrame:
    return rank.laplacian_positions(*_graph(spark, folder)[:2])


@_register(f"WITH {_EDGES} SELECT window_idx, count(*) AS nodes, least(8, greatest(count(*) - 3, 0)) AS filled FROM nd GROUP BY window_idx")
def laplacian_scale(spark: SparkSession, folder: str) -> DataFrame:
    """Nodes of each window, and its position columns that have mean 0 and deviation 1 (the others are filled up)."""
    found = rank.laplacian_positions(*_graph(spark, folder)[:2])
    each = [((F.abs(F.avg(F.col("pe")[k])) < 1e-6) & (F.abs(F.stddev_pop(F.col("pe")[k]) - 1) < 1e-6)).cast("bigint") for k in range(8)]
    return found.groupBy("window_idx").agg(F.count(F.lit(1)).alias("nodes"), sum(each[1:], each[0]).alias("filled"))


@_register(f"""WITH {_RARITY}, al AS (SELECT *, row_number() OVER (PARTITION BY window_idx ORDER BY out_deg / (in_deg + 1.0), node) / count(*) OVER (PARTITION BY window_idx) AS score_alpha FROM dg),
b AS (SELECT n.window_idx, n.node, coalesce(max(rarity), 0) AS rarity FROM nd n LEFT JOIN ra ON n.window_idx = ra.window_idx AND n.node = ra.src GROUP BY ALL),
be AS (SELECT window_idx, node, row_number() OVER (PARTITION BY window_idx ORDER BY round(rarity, 9), node) / count(*) OVER (PARTITION BY window_idx) AS score_beta FROM b)
SELECT window_idx, node, round((0.6 * score_alpha + 0.4 * score_beta) / 1.0, 6) AS score FROM al JOIN be USING (window_idx, node)""")
def fused_score(spark: SparkSession, folder: str) -> DataFrame:
    nodes, _, features = _graph(spark, folder, True)
    both = rank.asymmetry(nodes).join(rank.rarity_scores(nodes, rank.edge_rarity(features, _NAMES)), ["window_idx", "node"]).withColumn("score_delta", F.lit(0.0))
    return both.select("window_idx", "node", F.round(rank.fused(0.6, 0.4, 0.0, normalise=True), 6).alias("score"))


@_register(f"""WITH {_EDGES} SELECT window_idx, node, row_number() OVER (PARTITION BY window_idx ORDER BY out_deg DESC, node) AS rank, rank() OVER (PARTITION BY window_idx ORDER BY out_deg DESC) AS competition_rank FROM dg""")
def node_ranks(spark: SparkSession, folder: str) -> DataFrame:
    return _nodes(spark, folder).select("window_idx", "node", rank.node_rank("out_deg").alias("rank"), rank.competition_rank("out_deg").alias("competition_rank")).withColumns(_long("rank", "competition_rank"))


@_register(f"WITH {_SCORED} SELECT window_idx, node, label FROM sc")
def pivot_labels(spark: SparkSession, folder: str) -> DataFrame:
    return graph.labels(_nodes(spark, folder), _info(spark, folder))


_AP = _SCORED + """,
ap AS (SELECT window_idx, coalesce(avg(CASE WHEN label = 1 THEN h / rn END), 0) AS ap, sum(label)::BIGINT AS n_pos FROM (SELECT *, sum(label) OVER w AS h, row_number() OVER w AS rn FROM sc WINDOW w AS (PARTITION BY window_idx ORDER BY score DESC, node ROWS UNBOUNDED PRECEDING)) GROUP BY window_idx)"""


@_register(f"WITH {_AP} SELECT window_idx, round(ap, 6) AS ap, n_pos FROM ap")
def average_precision(spark: SparkSession, folder: str) -> DataFrame:
    return evaluate.average_precision(_scored(spark, folder)).withColumn("ap", _r("ap"))


@_register(f"WITH {_SCORED} SELECT window_idx, {', '.join(f'max((label = 1 AND rn <= {k})::INT) AS hit_{k}' for k in (10, 50, 100))} FROM (SELECT *, row_number() OVER (PARTITION BY window_idx ORDER BY score DESC, node) AS rn FROM sc) GROUP BY window_idx")
def hit_at_k(spark: SparkSession, folder: str) -> DataFrame:
    return evaluate.hit_at(_scored(spark, folder))


@_register(f"""WITH {_AP} SELECT count(*) AS n, round(avg(ap), 6) AS mean, round(median(ap), 6) AS median, round(max(ap), 6) AS max, round(min(ap), 6) AS min, count(*) FILTER (WHERE ap >= 0.01) AS n_high, count(*) FILTER (WHERE ap >= 0.001 AND ap < 0.01) AS n_mid, count(*) FILTER (WHERE ap < 0.001) AS n_low FROM ap""")
def ap_summary(spark: SparkSession, folder: str) -> DataFrame:
    return evaluate.ap_summary(evaluate.average_precision(_scored(spark, folder))).withColumns({c: _r(c) for c in ("mean", "median", "max", "min")})


# ---- stability and runs ------------------------------------------------------------------------------------------


@_register(f"WITH {_STABLE} SELECT window_idx, node, round(score, 6) AS score, rn FROM tp WHERE rn <= 200")
def top_candidates(spark: SparkSession, folder: str) -> DataFrame:
    return _stable(spark, folder).select("window_idx", "node", _r("score"), "rn").withColumns(_long("rn"))


@_register(f"WITH {_STABLE} SELECT node, count(*) AS windows FROM tp WHERE rn = 1 GROUP BY node ORDER BY windows DESC, node LIMIT 10")
def top1_frequency(spark: SparkSession, folder: str) -> DataFrame:
    return evaluate.top1_frequency(_stable(spark, folder))


@_register(f"WITH {_STABLE} SELECT node, count(*) AS windows FROM tp WHERE rn <= 50 GROUP BY node HAVING count(*) >= 25")
def persistent_hosts(spark: SparkSession, folder: str) -> DataFrame:
    return evaluate.persistent_hosts(_stable(spark, folder))


@_register(f"""WITH {_STABLE}, s AS (SELECT window_idx, list(DISTINCT node) AS a FROM tp WHERE rn <= 50 GROUP BY window_idx), p AS (SELECT window_idx, a, lag(a) OVER (ORDER BY window_idx) AS b FROM s)
SELECT window_idx, round(len(list_intersect(a, b)) / len(list_distinct(list_concat(a, b))), 6) AS jaccard FROM p WHERE b IS NOT NULL""")
def top50_jaccard(spark: SparkSession, folder: str) -> DataFrame:
    return evaluate.adjacent_jaccard(_stable(spark, folder)).withColumn("jaccard", _r("jaccard"))


@_register(f"""WITH {_STABLE}, h AS (SELECT node FROM tp WHERE rn = 1 GROUP BY node), r AS (SELECT node, rank() OVER (PARTITION BY window_idx ORDER BY score DESC) AS rank FROM tp)
SELECT node, count(*) AS windows, trunc(median(rank))::INT AS median_rank, min(rank) AS best_rank FROM r JOIN h USING (node) GROUP BY node""")
def leader_ranks(spark: SparkSession, folder: str) -> DataFrame:
    usable = _usable(spark, folder)
    return evaluate.host_ranks(usable, evaluate.top_candidates(usable, 1)).withColumns(_long("best_rank"))


@_register(f"""WITH {_STABLE} SELECT window_idx, round(avg(score), 6) AS ap_mean, round(stddev_pop(score), 6) AS ap_std, max(score) AS ap_best, min(score) AS ap_worst, count(*) AS n_seeds,
    string_agg(round(score, 6)::VARCHAR, ',' ORDER BY node) AS per_seed FROM ho GROUP BY window_idx""")
def seed_summary(spark: SparkSession, folder: str) -> DataFrame:
    """The summary over seeds, on stored scores: each host of a window stands for a seed."""
    found = evaluate.seed_summary(_usable(spark, folder).select("window_idx", F.col("node").alias("seed"), F.col("score").alias("ap")))
    listed = F.array_join(F.transform("per_seed", lambda x: F.round(x, 6).cast("string")), ",")
    return found.withColumns({"ap_mean": _r("ap_mean"), "ap_std": _r("ap_std"), "per_seed": listed})


@_register(f"""WITH {_STABLE}, w AS (SELECT DISTINCT window_idx FROM run_nonattack WHERE window_idx IS NOT NULL), s AS (SELECT window_idx, list(DISTINCT node) FILTER (WHERE node IS NOT NULL) AS a FROM w LEFT JOIN (SELECT * FROM tp WHERE rn <= 50) USING (window_idx) GROUP BY window_idx),
p AS (SELECT coalesce(a, []) AS a, coalesce(lag(a) OVER (ORDER BY window_idx), []) AS b, row_number() OVER (ORDER BY window_idx) AS k FROM s)
SELECT round(avg(coalesce(len(list_intersect(a, b)) / nullif(len(list_distinct(list_concat(a, b))), 0), 0)), 6) AS mean, count(*) AS pairs FROM p WHERE k > 1""")
def top50_jaccard_mean(spark: SparkSession, folder: str) -> DataFrame:
    every = table(spark, folder, "run_nonattack").select("window_idx").dropna().distinct()
    return evaluate.overlap_summary(evaluate.adjacent_jaccard(_stable(spark, folder), windows=every)).withColumn("mean", _r("mean"))


@_register("SELECT idx, ts_start, ts_end FROM window_info WHERE kind = 'adaptive' AND idx NOT IN (SELECT window_idx FROM run_nonattack WHERE window_idx IS NOT NULL)")
def unfinished_windows(spark: SparkSession, folder: str) -> DataFrame:
    return evaluate.unfinished(_info(spark, folder), table(spark, folder, "run_nonattack").select("window_idx")).select("idx", "ts_start", "ts_end")


def _trained(spark: SparkSession, folder: str) -> tuple[DataFrame, DataFrame]:
    """Fits of the reference's budget, 100 epochs for each of three seeds, and the nodes they score; one that fails is an error."""
    nodes, _, features = _graph(spark, folder, True)
    return model.train_scores(graph.node_features(nodes), features, _NAMES, seeds=(42, 123, 456), fit=model.Fit(strict=True)), nodes


@_register()
def trained_scores(spark: SparkSession, folder: str) -> DataFrame:
    return _trained(spark, folder)[0].drop("embedding", "train_s")


@_register()
def benchmark_summary(spark: SparkSession, folder: str) -> DataFrame:
    fitted, nodes = _trained(spark, folder)
    scores = fitted.select("window_idx", "seed", "node", rank.fused(0.6, 0.0, 0.4).alias("score"))
    labelled = scores.join(graph.labels(nodes, _info(spark, folder)), ["window_idx", "node"])
    return evaluate.seed_summary(evaluate.average_precision(labelled, ("window_idx", "seed")))


@_register(f"""WITH {_SCORED}, b AS (SELECT window_idx, coalesce(avg(CASE WHEN label = 1 THEN h / rn END), 0) AS ap FROM (SELECT *, sum(label) OVER w AS h, row_number() OVER w AS rn FROM sc WINDOW w AS (PARTITION BY window_idx ORDER BY score DESC, node ROWS UNBOUNDED PRECEDING)) GROUP BY 1),
c AS (SELECT window_idx, coalesce(avg(CASE WHEN label = 1 THEN h / rn END), 0) AS ap FROM (SELECT *, sum(label) OVER w AS h, row_number() OVER w AS rn FROM sc WINDOW w AS (PARTITION BY window_idx ORDER BY score, node ROWS UNBOUNDED PRECEDING)) GROUP BY 1)
SELECT count(*) AS n, round(avg(b.ap - c.ap), 6) AS mean, true AS inside FROM b JOIN c USING (window_idx)""")
def bootstrap_mean(spark: SparkSession, folder: str) -> DataFrame:
    """The mean difference, and whether it lies in its bootstrap interval."""
    row = bootstrap_interval(spark, folder)
    return row.select("n", _r("mean"), ((F.col("low") <= F.col("mean")) & (F.col("mean") <= F.col("high"))).alias("inside"))


@_register()
def bootstrap_interval(spark: SparkSession, folder: str) -> DataFrame:
    scored = _scored(spark, folder)
    ours = evaluate.average_precision(scored)
    base = evaluate.average_precision(scored.withColumn("score", -F.col("score"))).select("window_idx", F.col("ap").alias("baseline"))
    return evaluate.bootstrap_interval(ours.join(base, "window_idx"))
