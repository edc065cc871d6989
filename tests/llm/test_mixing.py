import numpy as np
import pytest
from pyspark.sql import functions as F

from ridgeline.llm import mixing


@pytest.fixture(scope="module")
def mixed(spark):
    rng = np.random.default_rng(0)
    words = ["alpha", "beta", "gamma", "delta", "run", "light", "stone"]
    text = lambda n: " ".join(rng.choice(words, n))
    rows = [(k, "Big " if k % 2 else "big", text(rng.integers(5, 60))) for k in range(900)]
    rows += [(1000 + k, " SMALL", text(rng.integers(5, 60))) for k in range(40)] + [(2000 + k, "mid", text(20)) for k in range(200)]
    rows += [(3000, "other", "x y"), (3001, None, "x"), (3002, "mid", None), (3003, "mid", ""), (None, "mid", "null id"), (2000, "mid", "repeated id")]
    targets = [("big", 0.4, 2), ("Small", 0.3, 4), ("mid", 0.2, 1), ("absent", 0.1, 3), (None, 0.5, 1)]
    uses, report = mixing.mix(spark.createDataFrame(rows, "doc_id bigint, source string, text string"), spark.createDataFrame(targets, "source string, target_share double, max_repeats int"))
    return rows, uses.collect(), {r.source: r for r in report.collect()}


def test_every_listed_document_has_its_uses(mixed):
    rows, uses, _ = mixed
    assert len(uses) == len([r for r in rows if r[1] not in ("other", None)])
    caps = {"big": 2, "small": 4, "mid": 1}
    assert all(0 <= u.uses <= caps[u.source] for u in uses)
    assert all(u.uses == 0 for u in uses if u.n_tokens == 0)


def test_shares_are_reached_to_a_document(mixed):
    _, uses, report = mixed
    total = sum(u.n_tokens * u.uses for u in uses)
    for source, share in (("big", 0.4), ("small", 0.3), ("mid", 0.2)):
        assert abs(report[source].used_tokens - share / 0.9 * total) <= 120
        assert report[source].used_tokens == sum(u.n_tokens * u.uses for u in uses if u.source == source)
    assert report["absent"].used_tokens == 0 and abs(sum(r.share for r in report.values()) - 1) < 1e-9
    # the scarcest source is used up to its cap
    assert any(report[s].used_tokens >= c * report[s].available_tokens - 120 for s, c in (("big", 2), ("small", 4), ("mid", 1)))


def test_soft_memberships_reach_their_targets(spark):
    rng = np.random.default_rng(1)
    rows = [(str(k), rng.dirichlet([0.4, 0.4, 0.4]).tolist(), int(rng.integers(10, 100))) for k in range(120)]
    groups = spark.createDataFrame(rows, "group string, posterior array<double>, tokens bigint")
    shares, caps = np.array([0.5, 0.3, 0.2]), np.array([3.0, 3.0, 3.0])
    fit = mixing.fit_rates(groups, shares, caps, total=3000.0)
    out = fit.groups.collect()
    assert fit.total == 3000 and fit.converged and np.abs(fit.reached - fit.target).max() < 3
    reached = np.array([sum(r.posterior[k] * r.tokens * r.rate for r in out) for k in range(3)])
    assert np.abs(reached - shares * 3000).max() < 3 and min(r.rate for r in out) >= 0 and max(r.rate for r in out) <= 3 + 1e-9
    # beyond what the caps allow, the least squares keep the bounds
    far = mixing.fit_rates(groups, shares, caps, total=1e6, steps=20)
    assert max(abs(r.rate - 3) for r in far.groups.collect()) < 1e-6


def test_whole_uses_keep_the_group_total(spark):
    rng = np.random.default_rng(2)
    rows = [(k, f"g{k % 3}", int(rng.integers(1, 50)), [0.25, 1.6, 2.0][k % 3]) for k in range(3000)]
    df = spark.createDataFrame(rows, "doc_id bigint, group string, tokens bigint, rate double")
    out = mixing.whole_uses(df, F.col("doc_id")).collect()
    assert len(out) == 3000
    for g, rate in (("g0", 0.25), ("g1", 1.6), ("g2", 2.0)):
        own = [r for r in out if r.group == g]
        assert abs(sum(r.tokens * r.uses for r in own) - rate * sum(r.tokens for r in own)) <= 50
        assert {r.uses for r in own} <= {int(rate), int(rate) + (rate % 1 > 0)}


def test_classifier_prefers_the_right_domain(spark):
    rows = [(k, "a b c d" if k % 2 else "x y z w", ("one", "two")[k % 2 == 0] if k < 80 else None) for k in range(100)] + [(100, None, None), (101, "", "three")]
    df = spark.createDataFrame(rows, "doc_id bigint, text string, source string")
    out = {r.doc_id: r.posterior for r in mixing.domain_posteriors(df, "text", "source", ["one", "two"]).collect()}
    assert out[1] == [1.0, 0.0] and out[81][0] > 0.9 and out[82][1] > 0.9 and abs(sum(out[100]) - 1) < 1e-9 and len(out) == 102


def test_counts_equal_another_library(spark):
    tokenizers = pytest.importorskip("tokenizers")
    texts = ["hello world", "", None, "<|endoftext|> é\n\n", "a" * 50_000, "it's  'll \t x\u3000 中文 1234 ½", " " * 120_000 + "x", "word, " * 30_000]
    t = tokenizers.Tokenizer.from_file("/opt/tokenizers/byte_bpe_50k.json")
    t.encode_special_tokens = True
    rows = spark.createDataFrame(list(enumerate(texts)), "k int, text string").select("k", mixing.token_count(F.col("text")).alias("n")).orderBy("k").collect()
    assert [r.n for r in rows] == [len(t.encode(x or "", add_special_tokens=False).ids) for x in texts]
    with pytest.raises(FileNotFoundError):
        mixing.token_count(F.col("text"), "/nowhere/x.json")


def test_very_long_blanks_count(spark):
    rows = spark.createDataFrame([(" " * 1_000_000,)], "text string").select(mixing.token_count(F.col("text")).alias("n")).collect()
    assert rows[0].n > 0


def test_held_out_accuracy(spark):
    rows = [(k, ("one", "two")[k % 2], "a b c d" if k % 2 else "x y z w") for k in range(200)] + [(900, None, "a b"), (901, "else", "x"), (902, "one", None)]
    df = spark.createDataFrame(rows, "doc_id bigint, source string, text string")
    n, correct, largest = mixing.held_out_accuracy(df, "text", "source", ["one", "two", "absent"], F.col("doc_id")).first()
    assert 20 < n < 70 and correct >= n - 1 and largest < n
    assert tuple(mixing.held_out_accuracy(df.limit(0), "text", "source", ["one"], F.col("doc_id")).first()) == (0, 0, 0)


def test_domains_without_labelled_rows_are_never_predicted(spark):
    df = spark.createDataFrame([(1, "one", "a b"), (2, "two", "c d"), (3, None, "a b")], "doc_id bigint, source string, text string")
    out = {r.doc_id: r.posterior for r in mixing.domain_posteriors(df, "text", "source", ["absent", "one", "two"]).collect()}
    assert out[3][0] == 0 and out[3][1] > 0.6 and abs(sum(out[3]) - 1) < 1e-12


def test_soft_mixing_keeps_every_document(spark):
    rng = np.random.default_rng(5)
    rows = [(k, ("one", "two", None, "else")[k % 4], " ".join(rng.choice(["a", "b", "c", "x", "y"], rng.integers(3, 40), p=[0.4, 0.2, 0.2, 0.1, 0.1] if k % 4 in (0, 2) else [0.1, 0.1, 0.2, 0.3, 0.3]))) for k in range(800)]
    docs = spark.createDataFrame(rows, "doc_id bigint, source string, text string")
    targets = spark.createDataFrame([("one", 0.6, 2), ("two", 0.3, 3), ("absent", 0.1, 2)], "source string, target_share double, max_repeats int")
    uses, report = mixing.mix(docs, targets, soft=True)
    assert uses.count() == 800 and uses.agg(F.max("uses")).first()[0] <= 3
    got = {r.source: r for r in report.collect()}
    assert all(abs(got[s].used_tokens - got[s].target_tokens) <= got[s].largest_document for s in ("one", "two"))
    assert got["absent"].used_tokens == 0 and got["absent"].target_tokens == 0 and all(r.converged for r in got.values())
    # documents of no listed source take part by their probabilities
    assert uses.filter(F.col("source").isNull() & (F.col("uses") > 0)).count() > 20


def test_no_documents(spark):
    for soft in (False, True):
        uses, report = mixing.mix(spark.createDataFrame([], "doc_id bigint, source string, text string"), spark.createDataFrame([("a", 1.0, 2)], "source string, target_share double, max_repeats int"), soft=soft)
        assert uses.count() == 0 and [tuple(r)[:6] for r in report.collect()] == [("a", 1.0, 0, 0, 0.0, 0)]
    uses, report = mixing.mix(spark.createDataFrame([(1, "a", "x")], "doc_id bigint, source string, text string"), spark.createDataFrame([], "source string, target_share double, max_repeats int"))
    assert uses.count() == 0 and report.count() == 0
