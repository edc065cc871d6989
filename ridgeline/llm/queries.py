"""Registered queries of the training-data problems, and their SQL where SQL can express them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ridgeline.functions.names import entity
from ridgeline.llm import distinct, leakage, mixing, subjects, topn
from ridgeline.session import cut_lineage
from ridgeline.sources.tables import table

#: p1_found: a stored figure is wrong beyond this relative deviation.
DEVIATION = 0.1
#: Categories of which all combinations are counted.
MOST_CATEGORIES = 10


def _hashed_events(spark: SparkSession, folder: str) -> DataFrame:
    hashes = distinct.event_hashes(F.col("s"), F.col("d"))
    named = table(spark, folder, "unified_event").select(
        "ts", F.col("event_category").alias("category"), entity(F.col("source_entity")).alias("s"), entity(F.col("destination_entity")).alias("d")
    )
    return named.select("ts", "category", *[h.alias(name) for name, h in hashes.items()])


def _windows(spark: SparkSession, folder: str) -> DataFrame:
    return table(spark, folder, "window_info").withColumn("window", F.xxhash64("kind", "idx", "ts_start", "ts_end", "categories"))


def _window_counts(spark: SparkSession, folder: str) -> DataFrame:
    """(kind, idx, measure, stored, estimate) for every figure of window_info."""
    windows = _windows(spark, folder)
    distinct_windows = windows.select("window", "ts_start", "ts_end", "categories").dropDuplicates(["window"])
    found = distinct.estimates(distinct.window_sketches(_hashed_events(spark, folder), distinct_windows), ["window"])
    stored = windows.select("window", "kind", "idx", F.explode(F.array(*[F.struct(F.lit(m).alias("measure"), F.col(m).alias("stored")) for m in ("e", "v_src", "v_dst")])).alias("f"))
    return stored.select("window", "kind", "idx", "f.measure", "f.stored").join(found, ["window", "measure"], "left").select(
        "kind", "idx", "measure", "stored", F.coalesce("estimate", F.lit(0.0)).alias("estimate")
    )


def p1_found(spark: SparkSession, folder: str) -> DataFrame:
    counts = _window_counts(spark, folder)
    wrong = F.abs(F.col("stored") - F.col("estimate")) > DEVIATION * F.col("estimate")
    return counts.filter(F.col("stored").isNotNull() & wrong).select("kind", "idx", "measure").distinct()


def p1_window_estimates(spark: SparkSession, folder: str) -> DataFrame:
    return _window_counts(spark, folder).withColumn("error_bound", F.lit(distinct.error_bound()))


def p1_daily_sketches(spark: SparkSession, folder: str) -> DataFrame:
    events = _hashed_events(spark, folder).filter(F.col("ts").isNotNull()).withColumn("day", F.expr(f"ts div {distinct.DAY}"))
    return distinct.sketch(events, ["day", "category"], ["e", "v_src", "v_dst"])


def p1_daily_combinations(spark: SparkSession, folder: str) -> DataFrame:
    """Estimates for each day and every combination of the categories there are, by merging the days' stored sketches.

    Rows without a category count as ``(none)``.  There may be at most MOST_CATEGORIES, else ValueError.
    """
    stored = cut_lineage(p1_daily_sketches(spark, folder).withColumn("category", F.coalesce("category", F.lit("(none)"))))
    names = sorted(r[0] for r in stored.select("category").distinct().limit(MOST_CATEGORIES + 1).collect())
    if len(names) > MOST_CATEGORIES:
        raise ValueError(f"more than {MOST_CATEGORIES} categories have too many combinations")
    combos = lambda c: ["+".join(x for j, x in enumerate(names) if k >> j & 1) for k in range(1, 1 << len(names)) if k >> names.index(c) & 1]
    frame = spark.createDataFrame([(c, x) for c in names for x in combos(c)], "category string, categories string")
    spread = stored.join(F.broadcast(frame), "category")
    return distinct.estimates(distinct.merge(spread, ["day", "categories"]), ["day", "categories"]).withColumn("error_bound", F.lit(distinct.error_bound()))


def p1_daily_within(spark: SparkSession, folder: str) -> DataFrame:
    """Exact daily counts of each category, and whether the estimates are within twice the stated bound."""
    events = _hashed_events(spark, folder).filter(F.col("ts").isNotNull() & F.col("category").isNotNull()).withColumn("day", F.expr(f"ts div {distinct.DAY}"))
    measures = ("e", "v_src", "v_dst")
    items = events.select("day", "category", F.explode(F.array(*[F.struct(F.lit(m).alias("measure"), F.col(m).alias("h")) for m in measures])).alias("x"))
    exact = items.filter(F.col("x.h").isNotNull()).select("day", "category", "x.measure", "x.h").distinct().groupBy("day", "category", "measure").agg(F.count(F.lit(1)).alias("items"))
    found = distinct.estimates(distinct.sketch(events, ["day", "category"], measures), ["day", "category"])
    within = F.abs(F.col("estimate") - F.col("items")) <= 2 * distinct.error_bound() * F.col("items")
    return exact.join(found, ["day", "category", "measure"], "left").select("day", "category", "measure", "items", F.coalesce(within, F.lit(False)).alias("within"))


def _scored(spark: SparkSession, folder: str) -> DataFrame:
    score = F.col("score")
    usable = F.when((score >= 0) & (score <= 1), score)
    return topn.top_items(table(spark, folder, "run_nonattack"), F.col("window_idx"), entity(F.col("host")), usable, 10)


def p5_found(spark: SparkSession, folder: str) -> DataFrame:
    return _scored(spark, folder).select(F.col("group").alias("window_idx"), F.col("item").alias("host"))


def p5_ranked_hosts(spark: SparkSession, folder: str) -> DataFrame:
    return _scored(spark, folder).select(F.col("group").alias("window_idx"), F.col("item").alias("host"), "score", F.col("rank").cast("bigint").alias("rank"))


def _leaks(spark: SparkSession, folder: str) -> DataFrame:
    return leakage.leaks(table(spark, folder, "documents"), "doc_id", "text", table(spark, folder, "eval_item"), "eval_id", ["passage", "question"])


def p6_found(spark: SparkSession, folder: str) -> DataFrame:
    return _leaks(spark, folder).select("doc_id", "eval_id").distinct()


def p6_leaked_parts(spark: SparkSession, folder: str) -> DataFrame:
    return _leaks(spark, folder)


def _blank_words(text: str) -> Column:
    """ASCII letters and digits of a text, other characters being one blank; blanks at both ends."""
    return F.concat(F.lit(" "), F.trim(F.regexp_replace(F.lower(text), "[^a-z0-9]+", " ")), F.lit(" "))


def p6_verbatim(spark: SparkSession, folder: str) -> DataFrame:
    """Parts of at least 18 words that a found document holds word by word."""
    items = table(spark, folder, "eval_item").select("eval_id", F.explode(F.array(*[F.struct(F.lit(p).alias("part"), _blank_words(p).alias("whole")) for p in ("passage", "question")])).alias("p"))
    wanted = items.select("eval_id", "p.part", "p.whole").filter(F.size(F.split("whole", " ")) >= 20)
    held = table(spark, folder, "documents").select("doc_id", _blank_words("text").alias("held"))
    return _leaks(spark, folder).join(wanted, ["eval_id", "part"]).join(held, "doc_id").filter(F.col("held").contains(F.col("whole"))).select("doc_id", "eval_id", "part").distinct()


def p7_document_uses(spark: SparkSession, folder: str) -> DataFrame:
    return mixing.mix(table(spark, folder, "documents"), table(spark, folder, "mix_target"))[0]


def p7_shares(spark: SparkSession, folder: str) -> DataFrame:
    return mixing.mix(table(spark, folder, "documents"), table(spark, folder, "mix_target"))[1]


def _soft_mix(spark: SparkSession, folder: str) -> tuple[DataFrame, DataFrame]:
    return mixing.mix(table(spark, folder, "documents"), table(spark, folder, "mix_target"), soft=True)


def p7_soft_uses(spark: SparkSession, folder: str) -> DataFrame:
    """Uses of all documents; those of other or unknown sources join by the classifier's probabilities."""
    return _soft_mix(spark, folder)[0]


def p7_soft_shares(spark: SparkSession, folder: str) -> DataFrame:
    return _soft_mix(spark, folder)[1]


def _within(report: DataFrame) -> DataFrame:
    """Whether each source that has documents is within one document of its share of the total."""
    off = F.abs(F.col("used_tokens") - F.col("target_tokens"))
    return report.filter(F.col("largest_document") > 0).select("source", (off <= F.col("largest_document")).alias("within_a_document"))


def p7_shares_reached(spark: SparkSession, folder: str) -> DataFrame:
    return _within(p7_shares(spark, folder))


def p7_soft_shares_reached(spark: SparkSession, folder: str) -> DataFrame:
    return _within(p7_soft_shares(spark, folder))


def p7_classifier_accuracy(spark: SparkSession, folder: str) -> DataFrame:
    """Documents of known source held out from the classifier, those it gets right, and those of the largest source."""
    names = [r[0] for r in table(spark, folder, "mix_target").select(mixing.source_key(F.col("source"))).dropna().distinct().orderBy("source").collect()]
    keyed = table(spark, folder, "documents").select("doc_id", mixing.source_key(F.col("source")).alias("source"), "text")
    return mixing.held_out_accuracy(keyed, "text", "source", names, F.col("doc_id"))


def _subjects(spark: SparkSession, folder: str) -> DataFrame:
    return subjects.document_subjects(table(spark, folder, "documents"), table(spark, folder, "subject_label"), table(spark, folder, "subject_area"))


def p8_found(spark: SparkSession, folder: str) -> DataFrame:
    return _subjects(spark, folder).select("doc_id", "subject").distinct()


def p8_composition(spark: SparkSession, folder: str) -> DataFrame:
    return _subjects(spark, folder).groupBy("subject").agg(F.count_distinct("doc_id").alias("documents"))


def p8_label_agreement(spark: SparkSession, folder: str) -> DataFrame:
    """How many labels set by hand there are for the documents, and whether three quarters of them are found."""
    said = table(spark, folder, "subject_label").select("doc_id", F.lower(F.trim("subject")).alias("subject")).dropna().distinct()
    known = said.join(table(spark, folder, "subject_area").select("subject"), "subject", "left_semi").join(table(spark, folder, "documents").select("doc_id"), "doc_id", "left_semi")
    found = _subjects(spark, folder).select("doc_id", "subject", F.lit(1).alias("found")).distinct()
    return known.join(found, ["doc_id", "subject"], "left").agg(F.count(F.lit(1)).alias("labels"), (F.count("found") >= 0.75 * F.count(F.lit(1))).alias("most_found"))


QUERIES = {
    "p1_found": p1_found,
    "p1_window_estimates": p1_window_estimates,
    "p1_daily_sketches": p1_daily_sketches,
    "p1_daily_combinations": p1_daily_combinations,
    "p1_daily_within": p1_daily_within,
    "p5_found": p5_found,
    "p5_ranked_hosts": p5_ranked_hosts,
    "p6_found": p6_found,
    "p6_leaked_parts": p6_leaked_parts,
    "p6_verbatim": p6_verbatim,
    "p7_document_uses": p7_document_uses,
    "p7_shares": p7_shares,
    "p7_shares_reached": p7_shares_reached,
    "p7_soft_uses": p7_soft_uses,
    "p7_soft_shares": p7_soft_shares,
    "p7_soft_shares_reached": p7_soft_shares_reached,
    "p7_classifier_accuracy": p7_classifier_accuracy,
    "p8_found": p8_found,
    "p8_composition": p8_composition,
    "p8_label_agreement": p8_label_agreement,
}


def _sql_entity(name: str) -> str:
    return rf"nullif(regexp_replace(regexp_replace(coalesce({name}, ''), '(?i)@DOM[0-9]+$', ''), '\$$', ''), '')"


_TOP = f"""best AS (SELECT window_idx, {_sql_entity('host')} AS host, max(score) AS score FROM run_nonattack
    WHERE score BETWEEN 0 AND 1 AND NOT isnan(score) AND window_idx IS NOT NULL AND {_sql_entity('host')} IS NOT NULL GROUP BY 1, 2),
ranked AS (SELECT *, row_number() OVER (PARTITION BY window_idx ORDER BY score DESC, host) AS rank FROM best QUALIFY rank <= 10)"""

_REACHED = """SELECT DISTINCT lower(trim(source)) AS source, true AS within_a_document FROM mix_target
WHERE lower(trim(source)) IN (SELECT regexp_replace(lower(source), '^\\s+|\\s+$', '', 'g') FROM documents WHERE text <> '')"""

ORACLES = {
    "p1_found": f"""WITH ev AS (SELECT ts, event_category AS c, {_sql_entity('source_entity')} AS s, {_sql_entity('destination_entity')} AS d FROM unified_event WHERE ts IS NOT NULL),
truth AS (SELECT kind, idx, any_value(w.e) AS e, any_value(w.v_src) AS v_src, any_value(w.v_dst) AS v_dst,
    count(DISTINCT CASE WHEN s IS NOT NULL AND d IS NOT NULL THEN s || chr(1) || d END) AS te, count(DISTINCT s) AS ts_, count(DISTINCT d) AS td
    FROM window_info w LEFT JOIN ev ON ts BETWEEN ts_start AND ts_end AND list_contains(categories, c) GROUP BY kind, idx)
SELECT kind, idx, 'e' AS measure FROM truth WHERE abs(e - te) > 0.1 * te
UNION ALL SELECT kind, idx, 'v_src' FROM truth WHERE abs(v_src - ts_) > 0.1 * ts_
UNION ALL SELECT kind, idx, 'v_dst' FROM truth WHERE abs(v_dst - td) > 0.1 * td""",
    "p1_daily_within": f"""WITH ev AS (SELECT ts // 86400 AS day, event_category AS category, {_sql_entity('source_entity')} AS s, {_sql_entity('destination_entity')} AS d
    FROM unified_event WHERE ts IS NOT NULL AND event_category IS NOT NULL),
n AS (SELECT day, category, count(DISTINCT CASE WHEN s IS NOT NULL AND d IS NOT NULL THEN s || chr(1) || d END) AS e, count(DISTINCT s) AS v_src, count(DISTINCT d) AS v_dst FROM ev GROUP BY ALL)
SELECT day, category, measure, items, true AS within FROM (SELECT day, category, 'e' AS measure, e AS items FROM n UNION ALL SELECT day, category, 'v_src', v_src FROM n UNION ALL SELECT day, category, 'v_dst', v_dst FROM n) WHERE items > 0""",
    "p5_found": f"WITH {_TOP} SELECT window_idx, host FROM ranked",
    "p5_ranked_hosts": f"WITH {_TOP} SELECT window_idx, host, score, rank FROM ranked",
    "p6_verbatim": """WITH wanted AS (SELECT eval_id, part, ' ' || trim(regexp_replace(lower(t), '[^a-z0-9]+', ' ', 'g')) || ' ' AS whole
    FROM (SELECT eval_id, 'passage' AS part, passage AS t FROM eval_item UNION ALL SELECT eval_id, 'question', question FROM eval_item)),
held AS (SELECT doc_id, ' ' || trim(regexp_replace(lower(text), '[^a-z0-9]+', ' ', 'g')) || ' ' AS held FROM documents)
SELECT DISTINCT doc_id, eval_id, part FROM held JOIN (SELECT * FROM wanted WHERE len(string_split(whole, ' ')) >= 20) ON contains(held, whole)""",
    "p7_shares_reached": _REACHED,
    "p7_soft_shares_reached": _REACHED,
    "p8_label_agreement": """SELECT count(*) AS labels, true AS most_found FROM (SELECT DISTINCT doc_id, lower(trim(subject)) AS subject FROM subject_label)
WHERE subject IN (SELECT subject FROM subject_area) AND doc_id IN (SELECT doc_id FROM documents)""",
}
