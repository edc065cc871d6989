"""Mixing sources to target shares of the total size.

Documents belong to domains with given probabilities (one-hot where the source is known).  Document rates are fitted
by projected-gradient least squares so that the expected token totals of the domains match the targets, and are then
made whole numbers: first those of documents of uncertain domain, by a hash; the documents of known domain then make
up what is left of each domain's total, to within one document.
"""

from __future__ import annotations

import base64
import os
from collections.abc import Iterator
from dataclasses import dataclass
from pathlib import Path

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ridgeline.session import cut_lineage

#: Vocabulary file of a public tokenizer (ranks of byte pairs); RIDGELINE_TOKENIZER or the parameter names another.
TOKENIZER = os.environ.get("RIDGELINE_TOKENIZER", "/opt/tokenizers/byte_bpe_50k.tiktoken")
# Fixed value: the pattern that splits texts before byte pairs of this vocabulary are merged.
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
#: Characters beyond which a text is split by the pattern outside the tokenizer, whose matcher has a bounded stack.
LONG = 100_000
#: Hash bits of the order in which a domain's documents get one use more, and bits that each histogram resolves.
ORDER_BITS, STEP_BITS = 36, 12
#: Hash buckets of words, classes of length, and powers of the words' likelihood of the classifier.
BUCKETS, LENGTHS = 1 << 13, 128
TEMPERS = (1.0, 0.5, 0.25, 0.12, 0.06, 0.03, 0.015, 0.0)
#: Steps of the fit that are replayed before the rates are written.
REPLAY = 16

REPORT = (
    "source string, target_share double, available_tokens bigint, used_tokens bigint, share double, most_uses int, "
    "largest_document int, target_tokens double, steps int, converged boolean"
)


def token_count(text: Column, vocabulary: str = TOKENIZER) -> Column:
    """Tokens of the whole text; a null text has none.  The vocabulary is read here and travels with the job."""
    ranks = Path(vocabulary).read_bytes()

    @F.pandas_udf("bigint")
    def count(columns: Iterator[pd.Series]) -> Iterator[pd.Series]:
        import regex
        import tiktoken

        own = {base64.b64decode(a): int(b) for a, b in map(bytes.split, ranks.splitlines())}
        tokenizer = tiktoken.Encoding("own", pat_str=PATTERN, mergeable_ranks=own, special_tokens={})
        pieces = regex.compile(PATTERN)
        for column in columns:
            sizes = [
                0 if not t else len(tokenizer.encode_ordinary(t)) if len(t) <= LONG
                else sum(len(tokenizer._encode_single_piece(x.encode())) for x in pieces.findall(t))
                for t in column
            ]
            yield pd.Series(sizes, index=column.index, dtype="int64")

    return count(text)


def source_key(source: Column) -> Column:
    """Source as it compares: without case and outer blanks."""
    return F.regexp_replace(F.lower(source), r"^\s+|\s+$", "")


def _bags(text: Column) -> Column:
    words = F.filter(F.split(F.lower(F.coalesce(text, F.lit(""))), r"[^\p{L}\p{N}]+"), lambda w: w != "")
    return F.transform(words, lambda w: F.pmod(F.xxhash64(w), F.lit(BUCKETS)).cast("int"))


def _length(bag: Column) -> Column:
    """Size class of a text: a quarter of a doubling of its words."""
    return F.least(F.floor(F.log2(F.size(bag) + 1) * 4), F.lit(LENGTHS - 1)).cast("int")


def _scores(bags: pd.Series, lengths: pd.Series, words: np.ndarray, sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Log likelihoods of the words, and log prior and likelihood of the length, for each text and domain."""
    size = np.array([len(b) for b in bags], np.int64)
    found = np.zeros((len(bags), words.shape[1]))
    if size.sum():
        some = np.flatnonzero(size)
        flat = np.concatenate([np.asarray(bags.iloc[k]) for k in some])
        found[some] = np.add.reduceat(words[flat], np.cumsum(size[some]) - size[some], axis=0)
    return found, sizes[lengths.to_numpy()]


def _softmax(score: np.ndarray) -> np.ndarray:
    p = np.exp(score - score.max(1, keepdims=True))
    return p / p.sum(1, keepdims=True)


def domain_posteriors(docs: DataFrame, text: str, label: str, domains: list[str], labelled: Column | None = None) -> DataFrame:
    """``docs`` with ``posterior``, an array of the probabilities of ``domains``.

    Rows whose ``label`` is one of the domains are the labelled table and keep their label as a certainty.  The others
    get the posterior of a multinomial classifier on hashed words and the text's length, whose counts are taken over
    all labelled rows; the model has domains x BUCKETS numbers.  Words of a text are not independent, so their
    likelihood is tempered by the power of those in TEMPERS that suits a tenth of the labelled rows best, fitted
    without them.  A domain without labelled rows has probability 0.  A text without words is judged by its length.
    ``labelled`` restricts the labelled table further (to hold rows out).
    """
    codes = F.create_map(*[x for k, d in enumerate(domains) for x in (F.lit(d), F.lit(k))])
    code = codes[F.col(label)]
    bag = _bags(F.col(text))
    coded = docs.withColumn("__code", code if labelled is None else F.when(labelled, code)).withColumn("__bag", bag).withColumn("__length", _length(F.col("__bag")))
    known = coded.filter(F.col("__code").isNotNull())
    apart = (F.pmod(F.xxhash64("__bag"), F.lit(10)) == 0).cast("int")
    words, sizes = np.zeros((2, BUCKETS, len(domains))), np.zeros((2, LENGTHS, len(domains)))
    for r in known.select(apart.alias("part"), "__code", F.explode("__bag").alias("b")).groupBy("part", "__code", "b").agg(F.count(F.lit(1)).alias("n")).collect():
        words[r["part"], r["b"], r["__code"]] = r["n"]
    for r in known.groupBy(apart.alias("part"), "__code", "__length").agg(F.count(F.lit(1)).alias("n")).collect():
        sizes[r["part"], r["__length"], r["__code"]] = r["n"]

    def logs(w: np.ndarray, z: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        each = z.sum(0)
        with np.errstate(divide="ignore"):
            prior = np.log(each / each.sum()) if each.any() else np.zeros(len(each))
        return np.log((w + 0.5) / (w + 0.5).sum(0)), prior + np.log((z + 0.5) / (z + 0.5).sum(0))

    context = docs.sparkSession.sparkContext
    first = context.broadcast(logs(words[0], sizes[0]))

    @F.pandas_udf("array<double>")
    def fit(bags: pd.Series, lengths: pd.Series, truth: pd.Series) -> pd.Series:
        found, base = _scores(bags, lengths, *first.value)
        at = np.arange(len(truth)), truth.to_numpy()
        return pd.Series(list(np.column_stack([np.log(np.maximum(_softmax(base + found * t)[at], 1e-12)) for t in TEMPERS])))

    sums = known.filter(apart == 1).select(fit("__bag", "__length", "__code").alias("x")).agg(*[F.sum(F.col("x")[k]).alias(f"t{k}") for k in range(len(TEMPERS))]).first()
    temper = TEMPERS[int(np.argmax([x or 0.0 for x in sums]))]
    shared = context.broadcast(logs(words.sum(0), sizes.sum(0)))

    @F.pandas_udf("array<double>")
    def classify(bags: pd.Series, lengths: pd.Series) -> pd.Series:
        found, base = _scores(bags, lengths, *shared.value)
        return pd.Series(list(_softmax(base + found * temper)))

    certain = F.array(*[F.when(F.col("__code") == k, 1.0).otherwise(0.0) for k in range(len(domains))])
    one = known.withColumn("posterior", certain)
    rest = coded.filter(F.col("__code").isNull()).withColumn("posterior", classify("__bag", "__length"))
    return one.unionByName(rest).drop("__code", "__bag", "__length")


def held_out_accuracy(docs: DataFrame, text: str, label: str, domains: list[str], key: Column, part: int = 5) -> DataFrame:
    """One row (n, correct, largest): labelled rows held out (one in ``part`` by a hash of ``key``), those the
    classifier fitted on the others gets right, and those of the most frequent domain."""
    held = F.pmod(F.xxhash64(key), F.lit(part)) == 0
    judged = domain_posteriors(docs.withColumn("__held", held), text, label, domains, ~F.col("__held")).filter(F.col("__held") & F.col(label).isin(domains))
    names = F.array(*[F.lit(d) for d in domains])
    best = F.element_at(names, (F.array_position("posterior", F.array_max("posterior"))).cast("int"))
    counted = judged.groupBy(F.col(label)).agg(F.count(F.lit(1)).alias("n"), F.count_if(best == F.col(label)).alias("correct"))
    return counted.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("n"), F.coalesce(F.sum("correct"), F.lit(0)).alias("correct"), F.coalesce(F.max("n"), F.lit(0)).alias("largest"))


@dataclass(frozen=True)
class Rates:
    """Fitted rates: the groups with ``rate``, the total asked for, tokens of each domain asked for and reached, steps
    taken, and whether the last step moved no domain by more than the tolerance."""

    groups: DataFrame
    total: float
    target: np.ndarray
    reached: np.ndarray
    steps: int
    converged: bool


def fit_rates(groups: DataFrame, shares: np.ndarray, caps: np.ndarray, total: float | None = None, steps: int = 200, close: float = 1e-9) -> Rates:
    """Rates of ``groups`` (group, posterior, tokens).

    Minimises sum_s (tokens_s - share_s total)^2 / available_s over 0 <= rate <= cap, tokens_s being the expected
    tokens of domain s.  In the metric of the documents' sizes a gradient step of length 1 always descends.  A step
    needs one number for each domain from all groups; rates are replayed from the last REPLAY steps, before which they
    are written.  ``total`` is by default the largest for which every domain with certain tokens reaches its share from
    those within its cap; shares of domains without tokens are spread over the others in proportion.
    """
    groups = cut_lineage(groups.select("group", "posterior", F.col("tokens").cast("double").alias("tokens"), F.lit(0.0).alias("rate")))
    domains = len(shares)
    sums = lambda by: [F.sum(F.col("posterior")[k] * F.col("tokens") * by).alias(f"t{k}") for k in range(domains)]
    read = lambda df, by: np.array([x or 0.0 for x in df.agg(*sums(by)).first()], float)
    available = read(groups, F.lit(1.0))
    certain = read(groups.filter(F.array_max("posterior") == 1), F.lit(1.0))
    base = certain if certain.any() else available
    wanted = np.where(base > 0, shares, 0.0)
    wanted = wanted / max(wanted.sum(), 1e-300)
    if total is None:
        total = float(min([caps[k] * base[k] / wanted[k] for k in range(domains) if wanted[k] > 0], default=0.0))
    target = wanted * total
    history: list[np.ndarray] = []

    def rated(past: list[np.ndarray]) -> DataFrame:
        moves = np.array(past).reshape(len(past), domains)

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in batches:
                p = np.asarray(b.column("posterior").flatten()).reshape(b.num_rows, domains)
                most, rate = p @ caps, np.asarray(b.column("rate")).copy()
                for move in moves:
                    rate = np.clip(rate - p @ move, 0, most)
                yield b.set_column(b.schema.get_field_index("rate"), "rate", pa.array(rate))

        return groups.mapInArrow(run, groups.schema)

    reached, taken, converged = np.zeros(domains), 0, False
    while taken < steps and not converged:
        history.append(np.where(base > 0, (reached - target) / np.maximum(available, 1e-300), 0.0))
        taken += 1
        now = read(rated(history), F.col("rate"))
        converged = bool(np.abs(now - reached).max(initial=0.0) <= close * max(total, 1.0))
        reached = now
        if len(history) == REPLAY:
            groups, history = cut_lineage(rated(history)), []
    return Rates(rated(history) if history else groups, total, target, reached, taken, converged)


def whole_uses(docs: DataFrame, key: Column) -> DataFrame:
    """``docs`` (group, tokens, rate) with ``uses``: the rate's whole part, and one more for a share of each group.

    The documents of a group are ordered by a hash of ``key``.  Those up to the point where the group's fractional
    tokens are reached get one use more.  The point is found by histograms of 2**STEP_BITS cells, each inside the
    cell of the one before, so no group is ever ordered as a whole; documents of one last cell are ordered by key.
    Groups are sources, few enough to be broadcast.
    """
    rows = docs.withColumn("__h", F.shiftrightunsigned(F.xxhash64(key), 64 - ORDER_BITS)).withColumn("__base", F.floor(F.col("rate") + 1e-9).cast("int"))
    left = rows.groupBy("group").agg(F.sum(F.col("tokens") * (F.col("rate") - F.col("__base"))).alias("need"))
    left = left.withColumn("from", F.lit(0).cast("bigint"))
    for shift in range(ORDER_BITS - STEP_BITS, -1, -STEP_BITS):
        cell = F.shiftright(F.col("__h"), shift)
        sized = rows.join(F.broadcast(left), "group").filter(F.shiftright(F.col("__h"), shift + STEP_BITS) == F.col("from"))
        cells = sized.groupBy("group", "need", cell.alias("cell")).agg(F.sum("tokens").alias("tokens"))
        order = Window.partitionBy("group").orderBy("cell").rowsBetween(Window.unboundedPreceding, Window.currentRow)
        summed = cells.withColumn("upto", F.sum("tokens").over(order))
        # the first cell in which the need is passed; without one, everything up to the last cell is inside
        passed = summed.groupBy("group", "need").agg(F.min(F.when(F.col("upto") > F.col("need"), F.struct("cell", F.col("upto") - F.col("tokens")))).alias("p"), F.max("cell").alias("last"), F.sum("tokens").alias("all"))
        left = cut_lineage(passed.select("group", F.coalesce(F.col("need") - F.col("p.col2"), F.col("need") - F.col("all")).alias("need"), F.coalesce("p.cell", F.col("last") + 1).alias("from")))
    bound = rows.join(F.broadcast(left), "group", "left")
    inside = bound.filter(F.col("__h") != F.col("from")).withColumn("uses", F.col("__base") + (F.col("__h") < F.col("from")).cast("int"))
    at = bound.filter(F.col("__h") == F.col("from"))
    before = F.coalesce(F.sum("tokens").over(Window.partitionBy("group").orderBy(key).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    edge = at.withColumn("uses", F.col("__base") + ((before + F.col("tokens") / 2) < F.col("need")).cast("int"))
    return inside.unionByName(edge).drop("__h", "__base", "need", "from")


def mix(docs: DataFrame, targets: DataFrame, vocabulary: str = TOKENIZER, total: float | None = None, soft: bool = False) -> tuple[DataFrame, DataFrame]:
    """How often each document is used, and the shares reached.

    ``docs``: doc_id, source, text.  ``targets``: source, target_share, max_repeats (small, one row a source).
    Documents whose source is none of the targets are left out, so membership is certain and each source is one group.
    With ``soft`` they stay, as members of the domains with the classifier's probabilities, at most as often as these
    allow on average; domain totals are then expectations.  Their rates are made whole by a hash; the documents of
    known source then fill each domain's total.  Null and empty texts have no tokens and are used 0 times; repeated
    doc_ids are documents of their own.  First frame: doc_id, source, n_tokens, uses; second: source, target_share,
    available_tokens, used_tokens, share, most_uses, largest_document (of known source), target_tokens, steps,
    converged.
    """
    goals = targets.select(source_key(F.col("source")).alias("source"), "target_share", "max_repeats").dropna().orderBy("source").dropDuplicates(["source"]).orderBy("source").collect()
    names = [r["source"] for r in goals]
    shares = np.array([r["target_share"] for r in goals], float)
    caps = np.array([r["max_repeats"] for r in goals], float)
    keyed = docs.select("doc_id", source_key(F.col("source")).alias("source"), "text")
    if not names:
        spark = docs.sparkSession
        return keyed.limit(0).select("doc_id", "source", F.lit(0).cast("bigint").alias("n_tokens"), F.lit(0).alias("uses")), spark.createDataFrame([], REPORT)
    listed = F.coalesce(F.col("source").isin(names), F.lit(False))
    sized = cut_lineage(keyed.filter(listed).select("doc_id", "source", token_count(F.col("text"), vocabulary).alias("tokens")))
    certain = F.array(*[(F.col("source") == n).cast("double") for n in names]).cast("array<double>")
    groups = sized.groupBy("source").agg(F.sum("tokens").alias("tokens")).select(F.col("source").alias("group"), certain.alias("posterior"), "tokens")
    if soft:
        judged = domain_posteriors(keyed, "text", "source", names).filter(~listed)
        open_ = cut_lineage(judged.select("doc_id", "source", "posterior", token_count(F.col("text"), vocabulary).alias("tokens")).withColumn("group", F.monotonically_increasing_id().cast("string")))
        groups = groups.unionByName(open_.select("group", "posterior", "tokens"))
    fit = fit_rates(groups, shares, caps, total)
    spare = np.zeros(len(names))
    if soft:
        fitted = open_.join(fit.groups.select("group", "rate"), "group")
        u = F.shiftrightunsigned(F.xxhash64("doc_id", "group"), 11) / F.lit(float(1 << 53))
        whole = F.when(F.col("tokens") > 0, F.floor("rate") + (u < F.col("rate") - F.floor("rate")).cast("int")).otherwise(0)
        open_uses = cut_lineage(fitted.select("doc_id", "source", F.col("tokens").alias("n_tokens"), whole.cast("int").alias("uses"), "posterior"))
        spare = np.array([x or 0.0 for x in open_uses.agg(*[F.sum(F.col("posterior")[k] * F.col("n_tokens") * F.col("uses")) for k in range(len(names))]).first()], float)
    held = {r["source"]: (float(r["tokens"]), int(r["most"])) for r in sized.groupBy("source").agg(F.sum("tokens").alias("tokens"), F.max("tokens").alias("most")).collect()}
    rate = {n: min(cap, max(0.0, t - x) / held[n][0]) if held.get(n, (0,))[0] else 0.0 for n, cap, t, x in zip(names, caps, fit.reached, spare, strict=True)}
    rates = F.create_map(*[x for n, r in rate.items() for x in (F.lit(n), F.lit(float(r)))])
    rated = sized.withColumn("group", F.col("source")).withColumn("rate", rates[F.col("source")])
    full = whole_uses(rated.filter(F.col("tokens") > 0), F.col("doc_id")).unionByName(rated.filter(F.col("tokens") == 0).withColumn("uses", F.lit(0)))
    uses = full.select("doc_id", "source", F.col("tokens").alias("n_tokens"), "uses", certain.alias("posterior"))
    uses = cut_lineage(uses.unionByName(open_uses) if soft else uses)
    one = lambda k: F.col("posterior")[k]
    sums = [x for k in range(len(names)) for x in (F.sum(one(k) * F.col("n_tokens")), F.sum(one(k) * F.col("n_tokens") * F.col("uses")), F.max(F.when(one(k) > 0, F.col("uses"))))]
    got = [x or 0 for x in uses.agg(F.sum(F.col("n_tokens") * F.col("uses")), *sums).first()]
    rows = [
        (n, float(s), round(a), round(u), u / max(got[0], 1), int(m), held.get(n, (0, 0))[1], float(t), fit.steps, fit.converged)
        for n, s, a, u, m, t in zip(names, shares, got[1::3], got[2::3], got[3::3], fit.target, strict=True)
    ]
    report = docs.sparkSession.createDataFrame(rows, REPORT)
    return uses.drop("posterior"), report
