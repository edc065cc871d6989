"""Ranks, percentiles, PageRank, rarity and fused scores of nodes, within windows."""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ridgeline.session import cut_lineage, spread

#: Nodes up to which eigenvectors are those of a dense matrix.
DENSE_NODES = 512


def percentile(value: Column, node: str = "node", by: str = "window_idx") -> Column:
    """Ordinal rank over the number of nodes, in (0, 1]; equal values are ordered by node."""
    own = Window.partitionBy(by)
    return F.row_number().over(own.orderBy(value, node)) / F.count(F.lit(1)).over(own)


def node_rank(score: str = "score", node: str = "node", by: str = "window_idx") -> Column:
    """Rank by falling score from 1, equal scores by node."""
    return F.row_number().over(Window.partitionBy(by).orderBy(F.desc(score), node))


def host_ranks_or_last(scored: DataFrame, hosts: DataFrame, score: str = "score", by: str = "window_idx") -> DataFrame:
    """(window_idx, node, rank) of given hosts (window_idx, node); one that was not scored ranks last, as the number of nodes."""
    ranked = scored.select(by, "node", node_rank(score, by=by).alias("rank"))
    sizes = scored.groupBy(by).agg(F.count(F.lit(1)).alias("__n"))
    return hosts.select(by, "node").distinct().join(ranked, [by, "node"], "left").join(sizes, by).select(by, "node", F.coalesce("rank", "__n").alias("rank"))


def competition_rank(score: str = "score", by: str = "window_idx") -> Column:
    """One more than the number of better scores."""
    return F.rank().over(Window.partitionBy(by).orderBy(F.desc(score)))


def asymmetry(nodes: DataFrame) -> DataFrame:
    """(window_idx, node, score_alpha): percentile of out / (in + 1) by distinct pairs."""
    return nodes.select("window_idx", "node", percentile(F.col("out_deg") / (F.col("in_deg") + F.lit(1.0))).alias("score_alpha"))


def structural_scores(peak: DataFrame) -> DataFrame:
    """(window_idx, node, p_full, p_peak, p_max): percentiles of full and peak asymmetry, and the larger."""
    both = peak.select("window_idx", "node", percentile(F.col("acp_full")).alias("p_full"), percentile(F.col("acp_peak")).alias("p_peak"))
    return both.withColumn("p_max", F.greatest("p_full", "p_peak"))


def edge_rarity(features: DataFrame, names: Sequence[str]) -> DataFrame:
    """Edges (window_idx, source_entity, destination_entity) with rarity: the sum of -ln(frequency) of their set features."""
    freq = features.groupBy("window_idx").agg(*[F.greatest(F.avg(n), F.lit(1e-10)).alias(f"__{n}") for n in names])
    rarity = sum((F.col(n) * -F.log(F.col(f"__{n}")) for n in names), F.lit(0.0))
    return features.join(freq, "window_idx").select("window_idx", "source_entity", "destination_entity", rarity.alias("rarity"))


def rarity_scores(nodes: DataFrame, rarity: DataFrame, top: int = 1) -> DataFrame:
    """(window_idx, node, rarity, score_beta): mean of a source's ``top`` rarest edges (0 without edges), and its percentile."""
    order = Window.partitionBy("window_idx", "source_entity").orderBy(F.desc("rarity"), "destination_entity")
    if top == 1:
        best = rarity.groupBy("window_idx", F.col("source_entity").alias("node")).agg(F.max("rarity").alias("rarity"))
    else:
        kept = rarity.withColumn("__k", F.row_number().over(order)).filter(F.col("__k") <= top)
        best = kept.groupBy("window_idx", F.col("source_entity").alias("node")).agg(F.avg("rarity").alias("rarity"))
    joined = nodes.select("window_idx", "node").join(best, ["window_idx", "node"], "left").withColumn("rarity", F.coalesce("rarity", F.lit(0.0)))
    # equal sums may differ in the last bits, which must not order nodes
    return joined.withColumn("score_beta", percentile(F.round("rarity", 9)))


def pagerank_array(src: np.ndarray, dst: np.ndarray, n: int, damping: float = 0.85, tolerance: float = 1e-6, steps: int = 200) -> tuple[np.ndarray, int]:
    """PageRank of distinct edges and the number of steps; dangling mass is spread evenly, so the ranks sum to 1."""
    degree = np.bincount(src, minlength=n).astype(float)
    share = np.divide(damping, degree, out=np.zeros(n), where=degree > 0)
    rank = np.full(n, 1.0 / n)
    for step in range(1, steps + 1):
        rest = 1 - damping + damping * rank[degree == 0].sum()
        new = np.bincount(dst, (rank * share)[src], n) + rest / n
        moved, rank = np.abs(new - rank).sum(), new
        if moved < tolerance:
            break
    return rank, step


def window_pagerank(nodes: DataFrame, edges: DataFrame, damping: float = 0.85, tolerance: float = 1e-6, steps: int = 200) -> DataFrame:
    """(window_idx, node, pagerank, pr_target) for every window at once, one task for each window's aggregated edges."""
    ids = nodes.select("window_idx", "node", "node_id")
    coded = edges.join(ids.select("window_idx", F.col("node").alias("source_entity"), F.col("node_id").alias("u")), ["window_idx", "source_entity"]).join(
        ids.select("window_idx", F.col("node").alias("destination_entity"), F.col("node_id").alias("v")), ["window_idx", "destination_entity"]
    ).select(F.col("window_idx").alias("__window"), "u", "v")  # another name: both sides may stem from one frame

    def run(key: tuple, own: pd.DataFrame, pairs: pd.DataFrame) -> pd.DataFrame:
        if own.empty:
            return own.assign(pagerank=0.0)[["window_idx", "node", "pagerank"]]
        rank, _ = pagerank_array(pairs["u"].to_numpy(), pairs["v"].to_numpy(), len(own), damping, tolerance, steps)
        return own.assign(pagerank=rank[own["node_id"].to_numpy()])[["window_idx", "node", "pagerank"]]

    ranks = spread(ids, "window_idx").groupBy("window_idx").cogroup(spread(coded, "__window").groupBy("__window")).applyInPandas(run, "window_idx bigint, node string, pagerank double")
    return ranks.withColumn("pr_target", pagerank_target(F.col("pagerank")))


def graph_pagerank(nodes: DataFrame, edges: DataFrame, damping: float = 0.85, tolerance: float = 1e-6, steps: int = 200, shortest: int = 0) -> DataFrame:
    """(node, pagerank) of one graph too large for a task, to the same tolerance as that of a window.

    ``nodes``: node.  ``edges``: distinct (source_entity, destination_entity).  A step joins the ranks to the links and
    sums what each node gets; it cuts its lineage, for the next one is decided by how far the ranks moved (the sum of
    all moves).  At least ``shortest`` steps are made.  Links are laid out by their source once.
    """
    total = nodes.count()
    degree = edges.groupBy("source_entity").agg(F.count(F.lit(1)).alias("degree"))
    links = cut_lineage(edges.join(degree, "source_entity").repartition("source_entity"))
    base = cut_lineage(nodes.join(degree.withColumnRenamed("source_entity", "node"), "node", "left").select("node", "degree"))
    ranks = base.withColumn("pagerank", F.lit(1.0 / max(total, 1)))
    for step in range(1, steps + 1):
        got = links.join(ranks.select(F.col("node").alias("source_entity"), "pagerank"), "source_entity").groupBy(F.col("destination_entity").alias("node")).agg(F.sum(F.col("pagerank") / F.col("degree")).alias("got"))
        loose = ranks.filter(F.col("degree").isNull()).agg(F.coalesce(F.sum("pagerank"), F.lit(0.0))).first()[0]
        rest = (1 - damping + damping * loose) / max(total, 1)
        new = F.lit(rest) + damping * F.coalesce("got", F.lit(0.0))
        moved = cut_lineage(ranks.withColumnRenamed("pagerank", "__old").join(got, "node", "left").select("node", "degree", new.alias("pagerank"), F.abs(new - F.col("__old")).alias("__moved")))
        ranks = moved.drop("__moved")
        if step >= shortest and (moved.agg(F.sum("__moved")).first()[0] or 0.0) < tolerance:
            break
    return ranks.select("node", "pagerank")


def pagerank_target(rank: Column) -> Column:
    """Training target; falls as the rank grows."""
    return F.log1p(F.lit(1.0) / (rank * 1e7 + 1e-10))


def fused(alpha: float, beta: float, delta: float, normalise: bool = False) -> Column:
    """Weighted sum of score_alpha, score_beta and score_delta; ``normalise`` divides by the weights' sum if positive."""
    total = alpha + beta + delta
    by = total if normalise and total > 0 else 1.0
    return (F.lit(alpha) * F.col("score_alpha") + F.lit(beta) * F.col("score_beta") + F.lit(delta) * F.col("score_delta")) / F.lit(by)


def laplacian_positions(nodes: DataFrame, edges: DataFrame, dims: int = 8) -> DataFrame:
    """(window_idx, node, pe): z-scored eigenvectors of the symmetric normalised Laplacian with self loops, zero-padded.

    The smallest eigenvector is dropped.
    """
    coded = edges.select(F.col("window_idx").alias("__window"), "source_entity", "destination_entity")

    def run(key: tuple, own: pd.DataFrame, pairs: pd.DataFrame) -> pd.DataFrame:
        own = own.sort_values("node_id")
        at = {x: k for k, x in enumerate(own["node"])}
        pe = laplacian_array(np.array([at[x] for x in pairs["source_entity"]], int), np.array([at[x] for x in pairs["destination_entity"]], int), len(own), dims)
        return pd.DataFrame({"window_idx": own["window_idx"], "node": own["node"], "pe": list(pe)})

    hosts = nodes.select("window_idx", "node", "node_id")
    return spread(hosts, "window_idx").groupBy("window_idx").cogroup(spread(coded, "__window").groupBy("__window")).applyInPandas(run, "window_idx bigint, node string, pe array<double>")


def laplacian_array(src: np.ndarray, dst: np.ndarray, n: int, dims: int = 8, tolerance: float = 1e-9, steps: int = 1200) -> np.ndarray:
    """Eigenvectors 2 to dims + 1 of the smallest eigenvalues, z-scored; sparse beyond DENSE_NODES nodes.

    The smallest eigenvalues of I - S are the largest of S, the scaled symmetric links with self loops.  Lanczos
    vectors are kept orthogonal; the iteration ends when the wanted eigenvalues move less than ``tolerance``.
    """
    pairs = np.unique(np.concatenate([src * n + dst, dst * n + src, np.arange(n) * (n + 1)]).astype(np.int64)) if n else np.zeros(0, np.int64)
    u, v = pairs // max(n, 1), pairs % max(n, 1)
    degree = np.bincount(u, minlength=n).astype(float)
    weight = 1 / np.sqrt(degree[u] * degree[v])
    wanted = max(1, min(dims + 1, n - 2))
    if n <= DENSE_NODES:
        s = np.zeros((n, n))
        s[u, v] = weight
        _, vectors = np.linalg.eigh(np.eye(n) - s)
        kept = vectors[:, 1:wanted]
    else:
        kept = _largest(u, v, weight, n, wanted, tolerance, steps)[:, 1:]
    deviation = kept.std(0)
    kept = (kept - kept.mean(0)) / np.where(deviation > 0, deviation, 1)
    return np.pad(kept, ((0, 0), (0, dims - kept.shape[1])))


def _largest(u: np.ndarray, v: np.ndarray, weight: np.ndarray, n: int, wanted: int, tolerance: float, steps: int) -> np.ndarray:
    """Eigenvectors of the ``wanted`` largest eigenvalues, by blocks of Lanczos vectors with restarts.

    A block meets eigenvalues that occur several times (components of the graph).
    """
    starts = np.flatnonzero(np.concatenate(([True], u[1:] != u[:-1])))
    links = lambda x: np.add.reduceat(weight[:, None] * x[v], starts, axis=0)  # noqa: E731 - every node has its self loop
    basis = np.linalg.qr(np.random.default_rng(0).standard_normal((n, min(n, wanted + 4))))[0]
    before = np.full(wanted, np.inf)
    for _ in range(steps // 6):
        space, block = [basis], basis
        for _ in range(5):
            block = links(block)
            for _ in range(2):
                for q in space:
                    block = block - q @ (q.T @ block)
            block, _ = np.linalg.qr(block)
            space.append(block)
        q = np.linalg.qr(np.hstack(space))[0]
        values, small = np.linalg.eigh(q.T @ links(q))
        order = np.argsort(-values)[: basis.shape[1]]
        basis = q @ small[:, order]
        now = values[order[:wanted]]
        if np.abs(now - before).max() < tolerance:
            break
        before = now
    return basis[:, :wanted]
