"""A small stream with one injected pivot, for demonstrations and end-to-end tests."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ridgeline.operators.windows import Thresholds

# Fixed values of the demonstration: thresholds, pivot, seconds, hosts, statuses, protocols and ports.
TOY_THRESHOLDS = Thresholds(m=90, e=40, v_src=15, v_dst=15)
PIVOT = "C5"
SECONDS, ATTACK, ALERTS = 300, (140, 160), (150, 155)
SOURCES = [f"C{k}" for k in range(1, 18) if k != 5]
TARGETS = [f"C{k}" for k in range(101, 121)]
FRESH = 301
STATUSES, PROTOCOLS, PORTS = ("Success", "Success", "Failure"), ("NTLM", "Kerberos", "Negotiate"), ("445", "389", "88", "80", "443", "139")


def toy_events(spark: SparkSession, seed: int = 0) -> DataFrame:
    """One logon a second with a flow beside about half of them; the pivot reaches a fresh host each second of ATTACK.

    The alerts name the pivot.  All categories come in one frame; values are drawn by hashes of second and seed.
    """
    draw = lambda name, n: F.pmod(F.xxhash64("ts", F.lit(name), F.lit(seed)), F.lit(n))
    pick = lambda name, values: F.element_at(F.array(*[F.lit(v) for v in values]), (draw(name, len(values)) + 1).cast("int"))
    seconds = spark.range(1, SECONDS + 1).select(F.col("id").alias("ts"))

    def logon(source: Column, target: Column, status: Column, protocol: Column) -> Column:
        kind = F.concat(F.lit("LogOn_"), status, F.lit("_Network_"), protocol)
        detail = F.to_json(F.struct(F.lit("LogOn").alias("action_category"), status.alias("status"), F.lit("Network").alias("subtype"), protocol.alias("protocol")))
        return _row("AUTH", source, target, kind, detail)

    def flow(source: Column, target: Column, port: Column) -> Column:
        kind = F.concat(F.lit("NetFlow_6_"), port, F.lit(">N1"))
        return _row("FLOW", source, target, kind, F.to_json(F.struct(F.lit("6").alias("protocol"), port.alias("src_port"), F.lit("N1").alias("dst_port"))))

    def _row(category: str, source: Column, target: Column, kind: Column, detail: Column) -> Column:
        return F.struct(source.alias("source_entity"), target.alias("destination_entity"), F.lit(category).alias("event_category"), kind.alias("event_type"), detail.alias("event_detail"))

    within = lambda span: (F.col("ts") >= span[0]) & (F.col("ts") < span[1])
    source, target, fresh = pick("source", SOURCES), pick("target", TARGETS), F.concat(F.lit("C"), F.col("ts") - ATTACK[0] + FRESH)
    pivot = F.lit(PIVOT)
    alert = _row("ALERT", pivot, fresh, F.lit(f"RedTeam_via_{PIVOT}"), F.lit(f'{{"pivot_machine":"{PIVOT}"}}'))
    rows = F.array(
        logon(source, target, pick("status", STATUSES), pick("protocol", PROTOCOLS)),
        F.when(draw("flow", 2) == 0, flow(source, target, pick("port", PORTS))),
        F.when(within(ATTACK), logon(pivot, fresh, F.lit("Success"), F.lit("Kerberos"))),
        F.when(within(ATTACK), flow(pivot, fresh, F.lit("445"))),
        F.when(within(ALERTS), alert),
    )
    events = seconds.select("ts", F.posexplode(rows).alias("place", "e")).filter(F.col("e").isNotNull())
    return events.select((F.col("ts") * 8 + F.col("place")).alias("event_id"), "ts", "e.*")
