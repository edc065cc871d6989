import json
import os
import subprocess
import sys
from pathlib import Path

import numpy as np
import pytest
from pyspark.sql import functions as F

from ridgeline.operators import evaluate, graph, model, rank
from ridgeline.plans import pipeline, reference_queries
from ridgeline.sources.toy import PIVOT, TOY_THRESHOLDS, toy_events

PLACED = "window_idx bigint, ts bigint, source_entity string, destination_entity string, event_detail string"


@pytest.fixture(scope="module")
def small(spark):
    ok = json.dumps({"status": "Success", "protocol": "NTLM"})
    rows = [(0, 0, "a", "b", ok), (0, 1, "a", "b", "{bad"), (0, 9, "a", "c", ok), (0, 10, "c", "d", ok), (1, 5, "x", "y", None)]
    return spark.createDataFrame(rows, PLACED), spark.createDataFrame([(0, 0, 10, ["c", "zz"]), (1, 5, 5, [])], "idx bigint, ts_start bigint, ts_end bigint, attack_pivots array<string>")


def test_slices_are_half_open(small):
    placed, found = small
    bounds = [tuple(r) for r in graph.slice_bounds(found).orderBy("slice").collect()]
    assert bounds == [(0, 0, 0, 2), (0, 1, 2, 5), (0, 2, 5, 7), (0, 3, 7, 10)]
    edges = graph.slice_edges(graph.sliced(placed, found))
    # the event at the window's end lies in no slice, and a window without duration has none
    assert sorted(map(tuple, edges.collect())) == [(0, 0, "a", "b", 2), (0, 3, "a", "c", 1)]
    assert sorted(map(tuple, graph.slice_degrees(edges).collect())) == [(0, 0, "a", 2, 0), (0, 0, "b", 0, 2), (0, 3, "a", 1, 0), (0, 3, "c", 0, 1)]


def test_nodes_include_hosts_outside_slices(small):
    placed, found = small
    edges = graph.window_edges(graph.slice_edges(graph.sliced(placed, found)))
    nodes = graph.node_degrees(graph.window_nodes(placed), edges)
    assert sorted(map(tuple, nodes.collect())) == [(0, "a", 0, 2, 0), (0, "b", 1, 0, 1), (0, "c", 2, 0, 1), (0, "d", 3, 0, 0), (1, "x", 0, 0, 0), (1, "y", 1, 0, 0)]
    assert {(r.node, r.label) for r in graph.labels(nodes, found).filter("window_idx = 0").collect()} == {("a", 0), ("b", 0), ("c", 1), ("d", 0)}
    flat = graph.node_features(nodes).filter("window_idx = 1").collect()
    assert all(r[f"x{k}"] == 0 for r in flat for k in range(8))


def test_damaged_details_make_an_unknown_protocol(small):
    row = next(r for r in graph.auth_features(small[0]).collect() if r.source_entity == "a" and r.destination_entity == "b")
    assert (row.is_auth, row.status_success, row.proto_NTLM, row.proto_unknown) == (1, 1, 1, 1)


def test_vocabulary_ties_go_to_the_first_seen(spark):
    flow = lambda k, a, b: (k, json.dumps({"src_port": a, "dst_port": b}))
    rows = spark.createDataFrame([flow(1, "0445", "N1"), flow(0, "80", "22"), flow(2, "445", "80"), flow(3, "x", ""), (4, None), (5, "{")], "event_id bigint, event_detail string")
    assert [tuple(r) for r in graph.port_vocabulary(rows, ["event_id"], 2).orderBy("port_idx").collect()] == [(0, 80, 2), (1, 445, 2)]


def test_pagerank_sums_to_one_and_agrees(spark):
    rng = np.random.default_rng(1)
    pairs = np.unique(rng.integers(0, 30, (80, 2)), axis=0)
    ranks, steps = rank.pagerank_array(pairs[:, 0], pairs[:, 1], 35, tolerance=0, steps=20)
    assert steps == 20 and abs(ranks.sum() - 1) < 1e-12
    nodes = spark.createDataFrame([(f"n{k:02d}",) for k in range(35)], "node string")
    edges = spark.createDataFrame([(f"n{a:02d}", f"n{b:02d}") for a, b in pairs], "source_entity string, destination_entity string")
    got = {r.node: r.pagerank for r in rank.graph_pagerank(nodes, edges, steps=20).collect()}
    assert max(abs(got[f"n{k:02d}"] - ranks[k]) for k in range(35)) < 1e-12


def test_percentiles_are_a_permutation(spark):
    df = spark.createDataFrame([(0, "b", 1.0), (0, "a", 1.0), (0, "c", 0.5), (1, "a", 2.0)], "window_idx bigint, node string, v double")
    got = {(r.window_idx, r.node): r.p for r in df.select("window_idx", "node", rank.percentile(F.col("v")).alias("p")).collect()}
    assert got == {(0, "c"): 1 / 3, (0, "a"): 2 / 3, (0, "b"): 1.0, (1, "a"): 1.0}


def test_laplacian_positions_are_padded():
    pe = rank.laplacian_array(np.array([0, 1]), np.array([1, 2]), 3)
    assert pe.shape == (3, 8)
    assert rank.laplacian_array(np.array([], int), np.array([], int), 1).shape == (1, 8)
    big = rank.laplacian_array(np.arange(19), np.arange(1, 20), 20)
    assert np.allclose(big.std(0), 1) and np.allclose(big.mean(0), 0)


def test_sparse_positions_span_the_dense_ones(monkeypatch):
    rng = np.random.default_rng(3)
    n, e = 900, 4000
    src, dst = rng.integers(0, n, e), (rng.integers(0, n, e) * rng.random(e)).astype(int)
    monkeypatch.setattr(rank, "DENSE_NODES", n)
    dense = rank.laplacian_array(src, dst, n, 5)
    monkeypatch.setattr(rank, "DENSE_NODES", 10)
    sparse = rank.laplacian_array(src, dst, n, 5)
    assert sparse.shape == dense.shape == (n, 5) and np.abs(sparse.std(0) - 1).max() < 1e-9
    overlap = np.linalg.svd(np.linalg.qr(dense[:, :4])[0].T @ np.linalg.qr(sparse)[0])[1]
    assert overlap.min() > 0.999
    # two components share their largest eigenvalue
    parts = rank.laplacian_array(np.array([*range(29), *range(30, 59)]), np.array([*range(1, 30), *range(31, 60)]), 60, 2)
    assert np.isfinite(parts).all()


def test_graph_pagerank_stops_at_the_tolerance(spark):
    rng = np.random.default_rng(5)
    pairs = sorted({(int(a), int(b)) for a, b in rng.integers(0, 12, (40, 2))})
    nodes = sorted({x for p in pairs for x in p})
    at = {x: k for k, x in enumerate(nodes)}
    exact, _ = rank.pagerank_array(np.array([at[a] for a, _ in pairs]), np.array([at[b] for _, b in pairs]), len(nodes), tolerance=1e-7)
    frames = spark.createDataFrame([(str(x),) for x in nodes], "node string"), spark.createDataFrame([(str(a), str(b)) for a, b in pairs], "source_entity string, destination_entity string")
    got = {r.node: r.pagerank for r in rank.graph_pagerank(*frames, tolerance=1e-7).collect()}
    assert all(abs(got[str(x)] - exact[at[x]]) < 1e-9 for x in nodes) and abs(sum(got.values()) - 1) < 1e-9


def test_hosts_without_a_score_rank_last_and_empty_windows_overlap_nothing(spark):
    scored = spark.createDataFrame([(1, "a", 0.9), (1, "b", 0.9), (1, "c", 0.1), (2, "a", 0.5)], "window_idx bigint, node string, score double")
    hosts = spark.createDataFrame([(1, "b"), (1, "gone"), (2, "a")], "window_idx bigint, node string")
    assert {(r.window_idx, r.node): r["rank"] for r in rank.host_ranks_or_last(scored, hosts).collect()} == {(1, "b"): 2, (1, "gone"): 3, (2, "a"): 1}
    top = spark.createDataFrame([(1, "a", 1), (3, "a", 1), (3, "b", 2)], "window_idx bigint, node string, rn int")
    every = spark.createDataFrame([(1,), (2,), (3,)], "window_idx bigint")
    assert {r.window_idx: r.jaccard for r in evaluate.adjacent_jaccard(top).collect()} == {3: 0.5}
    overlaps = evaluate.adjacent_jaccard(top, windows=every)
    assert {r.window_idx: r.jaccard for r in overlaps.collect()} == {2: 0.0, 3: 0.0}
    assert tuple(evaluate.overlap_summary(overlaps).first()) == (0.0, 2)


def graph_arrays(seed=0, n=9, e=24, f=6):
    rng = np.random.default_rng(seed)
    pairs = np.unique(rng.integers(0, n, (e, 2)), axis=0)
    ef = np.hstack([(rng.random((len(pairs), f)) < 0.4).astype(float), rng.random((len(pairs), 1))])
    return rng.standard_normal((n, 8)), ef, pairs[:, 0], pairs[:, 1], rng


def test_gradients_by_finite_differences():
    x, ef, src, dst, rng = graph_arrays()
    m = model.GraphModel(x, ef, src, dst, gamma=0.3, dtype=np.float64)
    weight, targets = rng.random(6), rng.standard_normal((len(x), 3))
    _, grads = m.loss(weight, targets, 0.5, 0.3, train=False)
    assert set(grads) == set(m.p)
    for name, value in m.p.items():
        flat, own = value.reshape(-1), grads[name].reshape(-1)
        for k in rng.choice(flat.size, min(4, flat.size), replace=False):
            keep = flat[k]
            flat[k] = keep + 1e-6
            up, _ = m.loss(weight, targets, 0.5, 0.3, train=False)
            flat[k] = keep - 1e-6
            down, _ = m.loss(weight, targets, 0.5, 0.3, train=False)
            flat[k] = keep
            assert abs((up - down) / 2e-6 - own[k]) < 1e-5 * max(1, abs(own[k])), name


@pytest.mark.parametrize("index", [[], [2, 2, 2, 0, 2], [3, 1, 0], [0] * 40 + [4, 1, 4]])
def test_sums_by_node(index):
    index = np.array(index, int)
    rows = np.random.default_rng(0).random((len(index), 3))
    exact = np.zeros((5, 3))
    np.add.at(exact, index, rows)
    assert np.allclose(model._Sums(index, 5)(rows), exact) and np.allclose(model._Sums(index, 5)(rows[:, 0]), exact[:, 0])


def test_features_that_no_edge_has_take_no_part():
    x, ef, src, dst, rng = graph_arrays(2, 30, 90)
    wide = np.insert(ef, 3, np.zeros((4, 1)), axis=1)  # four features more that no edge has
    m = model.GraphModel(x, wide, src, dst, dtype=np.float64)
    assert m.parameters - m.flat.size == 4 * sum(model.HEADS * w for w in model.WIDTHS)
    narrow = model.GraphModel(x, ef, src, dst, dtype=np.float64)
    kept = [k for k in range(10) if not 3 <= k < 7]
    for name, own in narrow.p.items():
        own[:] = m.p[name][..., kept] if name in ("e3", "e4") else m.p[name]
    weight, targets = rng.random(10), rng.standard_normal((len(x), 3))
    weight[3:7] = 0
    (value, grads), (same, others) = m.loss(weight, targets, 0.5, 0.3, train=False), narrow.loss(weight[kept], targets, 0.5, 0.3, train=False)
    assert abs(value - same) < 1e-12 and not grads["e3"][:, 3:7].any() and not grads["e4"][3:7].any()
    for name, own in others.items():
        assert np.allclose(grads[name][..., kept] if name in ("e3", "e4") else grads[name], own, atol=1e-12), name


@pytest.mark.parametrize("rate", [0.2, 0.3])
def test_dropout_keeps_its_share(rate):
    m = model.GraphModel(*graph_arrays()[:4])
    kept, up = m._keep(rate, (1001, 301), True)
    assert set(np.unique(kept)) == {0, up} and abs(up - 1 / (1 - rate)) < 1e-6
    assert abs((kept > 0).mean() - (1 - rate)) < 0.005 and abs((kept > 0).mean(0) - (1 - rate)).max() < 0.07


def test_adam_steps_as_defined():
    x, ef, src, dst, _ = graph_arrays()
    targets, fit = np.ones((len(x), 3)), model.Fit(epochs=5)
    m, own = (model.GraphModel(x, ef, src, dst, dtype=np.float64) for _ in range(2))
    m.train(fit, np.ones(6), targets)
    first = second = 0
    for step in range(1, 6):
        g = own.loss(np.ones(6), targets, fit.lambda_deg, fit.lambda_pr)[1]["a0"].base + fit.weight_decay * own.flat
        first, second = 0.9 * first + 0.1 * g, 0.999 * second + 0.001 * g**2
        own.flat -= fit.lr * first / (1 - 0.9**step) / (np.sqrt(second / (1 - 0.999**step)) + 1e-8)
    assert np.allclose(m.flat, own.flat, atol=1e-12)


def test_a_graph_without_edges_is_fitted():
    none = np.zeros(0, int)
    found = model.score_graph(np.ones((3, 8)), np.zeros((0, 7)), none, none, model.Fit(epochs=2))
    assert found["embedding"].shape == (3, 64) and np.isfinite(found["embedding"]).all()


def test_epochs_reuse_their_memory():
    # several hundred page faults an epoch took much of a fit's time; a new process, for memory freed before counts too
    script = """
import resource
import numpy as np
from ridgeline.operators import model
rng = np.random.default_rng(0)
pairs = np.unique(rng.integers(0, 540, (430, 2)), axis=0)
ef = np.hstack([rng.random((len(pairs), 36)) < 0.2, rng.random((len(pairs), 1))]).astype(float)
graph = model.GraphModel(rng.standard_normal((540, 8)), ef, pairs[:, 0], pairs[:, 1])
faults = []
for epochs in (5, 20):
    graph.train(model.Fit(epochs=epochs), np.ones(36, np.float32), rng.standard_normal((540, 3)))
    faults.append(resource.getrusage(resource.RUSAGE_SELF).ru_minflt)
print((faults[1] - faults[0]) / 20)
"""
    env = os.environ | {"PYTHONPATH": str(Path(__file__).resolve().parents[1]), "OMP_NUM_THREADS": "1"}
    assert float(subprocess.run([sys.executable, "-c", script], env=env, capture_output=True, text=True, check=True).stdout) < 50


def test_training_lowers_the_loss_and_repeats():
    x, ef, src, dst, _ = graph_arrays(1, 30, 120, 36)
    a, b = (model.score_graph(x, ef, src, dst, model.Fit(epochs=40)) for _ in range(2))
    assert a["n_params"] == 85_328 and np.mean(a["losses"][-5:]) < 0.85 * a["losses"][0]
    assert np.array_equal(a["score_delta"], b["score_delta"]) and set(np.round(a["score_alpha"] * 30)) == set(range(1, 31))
    assert model.score_graph(x, ef, src, dst, model.Fit(epochs=2, use_pe=True, use_ief=False, scaled_residuals=True))["embedding"].shape == (30, 64)


def test_failed_fits_give_an_error_row(spark):
    names = ["is_auth"]
    nodes = spark.createDataFrame([(0, "a", 0, *[0.0] * 8)], "window_idx bigint, node string, node_id int, " + ", ".join(f"x{k} double" for k in range(8)))
    edges = spark.createDataFrame([(0, "a", "missing", 1.0, 0.7)], "window_idx bigint, source_entity string, destination_entity string, is_auth double, log_count double")
    row = model.train_scores(nodes, edges, names, fit=model.Fit(epochs=1)).first()
    assert row.window_idx == 0 and row.seed == 42 and row.error and row.node is None


def broken_window(spark):
    """Two windows of nodes and edges; in the second an edge's end is no node."""
    names = graph.feature_names()
    nodes = spark.createDataFrame([(w, n, k, *[float(k)] * 8) for w in (0, 1) for k, n in enumerate("ab")], "window_idx bigint, node string, node_id int, " + ", ".join(f"x{k} double" for k in range(8)))
    edges = spark.createDataFrame([(0, "a", "b", *[1.0] * len(names), 0.7), (1, "a", "missing", *[1.0] * len(names), 0.7)], "window_idx bigint, source_entity string, destination_entity string, " + ", ".join(f"{n} double" for n in [*names, "log_count"]))
    return nodes, edges


@pytest.mark.parametrize("name", ["trained_scores", "benchmark_summary"])
def test_a_failed_fit_ends_the_registered_queries(spark, monkeypatch, name):
    # its error row fell out of the join with the labels, so that the window or a seed of it was missing from the summary
    nodes, edges = broken_window(spark)
    monkeypatch.setattr(reference_queries, "_graph", lambda spark, folder, features=False: (nodes, None, edges))
    monkeypatch.setattr(reference_queries, "_info", lambda spark, folder: spark.createDataFrame([(0, ["a"]), (1, ["a"])], "idx bigint, attack_pivots array<string>"))
    monkeypatch.setattr(graph, "node_features", lambda nodes: nodes)
    with pytest.raises(Exception, match="fit failed: window_idx 1, seed"):
        reference_queries.QUERIES[name](spark, "").collect()


def test_a_diverged_fit_is_an_error():
    x, ef, src, dst, _ = graph_arrays()
    x[0, 0] = np.nan  # all residuals are NaN, their ranks looked like scores
    with pytest.raises(ArithmeticError):
        model.score_graph(x, ef, src, dst, model.Fit(epochs=2))


def test_a_window_with_a_failed_fit_has_no_benchmark_result(spark, tmp_path, monkeypatch):
    scored = spark.createDataFrame(
        [(w, s, 0.5, 0.3, n, 0.1, v, 1, None) for w, s in ((0, 1), (0, 2), (1, 1)) for n, v in (("a", 0.9), ("b", 0.1))] + [(1, 2, 0.5, 0.3, None, None, None, None, "error")],
        "window_idx bigint, seed int, lambda_deg double, lambda_pr double, node string, train_s double, score double, label int, error string",
    )
    monkeypatch.setattr(pipeline, "build_graphs", lambda *_: None)
    monkeypatch.setattr(pipeline, "score", lambda *_: scored)
    found = spark.createDataFrame([(0, True), (1, True)], "idx bigint, has_attack boolean")
    for _ in range(2):  # by the second run too
        results, summary, failed = pipeline.benchmark(spark.range(1), found, pipeline.Config(TOY_THRESHOLDS, output=str(tmp_path)))
        assert [(r.window_idx, r.n_seeds) for r in results.collect()] == [(0, 2)] and summary.first().n == 1
        assert [(r.window_idx, r.seed, r.error) for r in failed.collect()] == [(1, 2, "error")]
        scored = scored.filter("window_idx = 1")


@pytest.mark.parametrize("name", ["trained_scores", "benchmark_summary"])
def test_registered_fits_have_the_budget_of_the_reference(monkeypatch, name):
    class Trained(Exception):
        pass

    def train(nodes, edges, features, seeds=(42,), objectives=((0.5, 0.3),), fit=None):
        raise Trained(seeds, (fit or model.Fit()).epochs, objectives)

    monkeypatch.setattr(reference_queries, "_graph", lambda spark, folder, features=False: (None, None, None))
    monkeypatch.setattr(graph, "node_features", lambda nodes: nodes)
    monkeypatch.setattr(model, "train_scores", train)
    with pytest.raises(Trained) as got:
        reference_queries.QUERIES[name](None, "")
    assert got.value.args == ((42, 123, 456), 100, ((0.5, 0.3),))


def test_evaluation(spark):
    df = spark.createDataFrame([(0, "a", 0.9, 0, 1), (0, "b", 0.8, 1, 1), (0, "c", 0.8, 1, 0), (1, "a", 0.5, 0, 1), (2, "a", 0.5, None, 1)], "window_idx bigint, node string, score double, label int, out_deg int")
    ap = {r.window_idx: (round(r.ap, 9), r.n_pos) for r in evaluate.average_precision(df).collect()}
    assert ap == {0: (round((1 / 2 + 2 / 3) / 2, 9), 2), 1: (0.0, 0), 2: (0.0, 0)}
    hits = {r.window_idx: (r.hit_1, r.hit_2) for r in evaluate.hit_at(df, (1, 2)).collect()}
    assert hits[0] == (0, 1) and hits[1] == (0, 0)
    assert [(r.node, r.rn) for r in evaluate.top_candidates(df, 5).filter("window_idx = 0").orderBy("rn").collect()] == [("a", 1), ("b", 2)]
    s = evaluate.ap_summary(spark.createDataFrame([(0.5,), (0.005,), (0.0,)], "ap double")).first()
    assert (s.n, s.n_high, s.n_mid, s.n_low, s["median"]) == (3, 1, 1, 1, 0.005)


def test_paired_differences(spark):
    d = evaluate.paired_difference([0.5, 0.6, 0.7], [0.1, 0.6, 0.2], 2000)
    assert d["wins"] == 2 and d["ties"] == 1 and d["low"] <= d["mean"] <= d["high"]
    assert evaluate.paired_difference([], [])["n"] == 0
    rng = np.random.default_rng(0)
    values = rng.normal(0.1, 0.05, 60)
    pairs = spark.createDataFrame([(k, float(v), 0.0) for k, v in enumerate(values)], "window_idx bigint, ap double, baseline double")
    row, exact = evaluate.bootstrap_interval(pairs, 400).first(), evaluate.paired_difference(values, np.zeros(60), 4000)
    assert abs(row.low - exact["low"]) < 0.005 and abs(row.high - exact["high"]) < 0.005


def test_toy_end_to_end(spark, tmp_path):
    events = toy_events(spark).cache()
    config = pipeline.Config(TOY_THRESHOLDS, output=str(tmp_path), fit=model.Fit(epochs=20), seeds=(42,), pivots=(PIVOT,))
    found = pipeline.build_windows(events, config)
    attacked = found.filter("has_attack").collect()
    assert found.count() >= 2 and [w.attack_pivots for w in attacked] == [[PIVOT]]
    graphs = pipeline.build_graphs(events, found.filter("has_attack"))
    assert graphs.labels.agg(F.sum("label")).first()[0] == 1
    results, summary, failed = pipeline.benchmark(events, found, config)
    assert failed.count() == 0
    row = results.first()
    assert results.count() == 1 and row.ap_mean > 0 and row.per_pivot[PIVOT] <= 3 and summary.first().n == 1
    before = row.train_s_mean
    again, _, _ = pipeline.benchmark(events, found, config)
    assert [r.train_s_mean for r in again.collect()] == [before]
    assert pipeline.ablation(events, found, config).count() == 14
    assert pipeline.window_report(found)["coverage"] == {PIVOT: [1]}
    fixed = pipeline.build_windows(events, config, "fixed", 100)
    assert fixed.count() == 3
