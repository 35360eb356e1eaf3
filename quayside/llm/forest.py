"""Nearest neighbours by a forest of sorted hash strings (operator 6)."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import checkpoint

BITS = 32
#: Queries that ascend side by side in a task.
TOGETHER = 512


def planes(trees: int, dim: int, seed: int) -> np.ndarray:
    """Random hyperplanes, made anew wherever they are needed: trees x BITS x dim. Those of a tree
    are orthogonal as far as the dimension allows, which spreads its strings more evenly."""
    rng = np.random.default_rng(seed)
    return np.stack([np.concatenate([np.linalg.qr(rng.standard_normal((dim, dim)))[0] for _ in range(-(-BITS // dim))])[:BITS] for _ in range(trees)])


def hashes(x: np.ndarray, lift: np.ndarray, trees: int, seed: int) -> np.ndarray:
    """Hash strings of rows of ``x`` for every tree, as 32-bit numbers whose high bits come first.

    ``lift`` is one more coordinate. Points are lifted to the length of the longest, queries
    not at all; the angle between the two then orders points by their inner product.
    """
    lifted, worth = np.concatenate([x, lift[:, None]], axis=1), 1 << np.arange(BITS - 1, -1, -1, dtype="i8")
    return np.stack([(lifted @ h.T > 0) @ worth for h in planes(trees, x.shape[1] + 1, seed)], axis=1)


def usable(vectors: DataFrame) -> DataFrame:
    """vec_id and embedding of the rows that take part: no null id, vector or component, all
    components finite, not all zero, and of the most common dimension (ties: the larger)."""
    ok = vectors.select(F.col("vec_id").cast("long"), "embedding").where(
        "vec_id is not null and embedding is not null and not exists(embedding, x -> x is null or isnan(x) or abs(double(x)) = double('Infinity'))"
        " and exists(embedding, x -> x <> 0)"
    )
    dim = ok.groupBy(F.size("embedding").alias("dim")).count().orderBy(F.desc("count"), F.desc("dim")).first()
    return ok.where(F.size("embedding") == (dim[0] if dim else 0))


def descend(keys: np.ndarray, code: np.ndarray) -> np.ndarray:
    """Length of the longest prefix that each of ``code`` shares with any of the sorted ``keys``."""
    at = np.searchsorted(keys, code)
    beside = np.stack([keys[np.maximum(at - 1, 0)], keys[np.minimum(at, len(keys) - 1)]])
    differ = (beside ^ code).min(axis=0)
    return BITS - np.ceil(np.log2(differ + 1)).astype("i8")


def _ranges(keys: np.ndarray, code: np.ndarray, level: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Where in sorted ``keys`` the strings lie that share the first ``level`` bits with ``code``."""
    low = (code >> (BITS - level)) << (BITS - level)
    return np.searchsorted(keys, low), np.searchsorted(keys, low + (1 << (BITS - level)))


def _spans(start: np.ndarray, size: np.ndarray) -> np.ndarray:
    """The places of runs of ``size`` places each, from ``start`` on."""
    before = np.cumsum(size) - size
    return np.repeat(start - before, size) + np.arange(size.sum())


def _search(k: int, trees: int, ascent: float, quiet: int, longest: float, seed: int):
    """One shard's forest: the ``k`` best of the points that each query of the group comes to."""

    def run(group: pd.DataFrame) -> pd.DataFrame:
        group = group.sort_values("node")
        asks, node, x = group["asks"].to_numpy(), group["node"].to_numpy("i8"), np.stack(group["embedding"]).astype("f8")
        points, ids, asked = x[~asks], node[~asks], x[asks]
        m, n = len(points), len(asked)
        if not m or not n:
            return pd.DataFrame({"query": [], "node": [], "score": [], "met": []})
        lift = np.sqrt(np.maximum(0, longest**2 - (points**2).sum(1)))
        of_points, code = hashes(points, lift, trees, seed), hashes(asked, np.zeros(n), trees, seed)
        order = np.argsort(of_points, axis=0, kind="stable").T
        keys = np.take_along_axis(of_points.T, order, axis=1)
        # with so many in all trees together some tree alone holds k points, or all hold all there are
        wanted = min(trees * m, max(int(np.ceil(ascent * m)), trees * k))
        level = np.stack([descend(keys[t], code[:, t]) for t in range(trees)], axis=1).max(axis=1)
        flat, out = order.ravel(), []
        for start in range(0, n, TOGETHER):
            block = np.arange(start, min(n, start + TOGETHER))
            seen, last = np.zeros((len(block), m), bool), np.full(len(block), -np.inf)
            best: list[tuple[np.ndarray, np.ndarray]] = [(np.empty(0, "i8"), np.empty(0))] * len(block)
            calm, met, rising = np.zeros(len(block), "i8"), np.zeros(len(block), "i8"), np.arange(len(block))
            while len(rising):
                lo, hi = np.zeros((len(rising), trees), "i8"), np.zeros((len(rising), trees), "i8")
                for t in range(trees):
                    lo[:, t], hi[:, t] = _ranges(keys[t], code[block[rising], t], level[block[rising]])
                held = (hi - lo).sum(axis=1)
                for r, i in enumerate(rising.tolist()):
                    new = flat[_spans(lo[r] + m * np.arange(trees), hi[r] - lo[r])]
                    new = np.unique(new[~seen[i, new]])
                    seen[i, new] = True
                    score, at = points[new] @ asked[block[i]], new
                    near = score >= last[i]  # a tie with the last stays until ids decide
                    had = len(best[i][0])
                    at, score = np.concatenate([best[i][0], at[near]]), np.concatenate([best[i][1], score[near]])
                    first = np.lexsort((ids[at], -score))[:k]
                    best[i] = (at[first], score[first])
                    if len(first) == k:
                        last[i] = score[first[-1]]
                    met[i] += len(new)
                    calm[i] = calm[i] + 1 if len(first) == k and (first < had).all() else 0
                rising = rising[(held < wanted) & (calm[rising] < quiet)]
                level[block[rising]] -= 1
            for i, (at, score) in enumerate(best):
                out.append((np.full(len(at), node[asks][block[i]]), ids[at], score, np.full(len(at), met[i])))
        return pd.DataFrame({name: np.concatenate([o[c] for o in out]) for c, name in enumerate(("query", "node", "score", "met"))})

    return run


def candidates(nodes: DataFrame, k: int, trees: int, ascent: float, quiet: int, shard: int, asks: int, seed: int) -> DataFrame:
    """``query``, ``node``, ``score`` of the ``k`` best of every shard for the rows of ``nodes`` (node, asks,
    embedding) that ask, and ``met``, the points of the shard that were scored."""
    n, n_asks, longest = nodes.agg(
        F.count("*"), F.sum("asks"), F.sqrt(F.max(F.aggregate("embedding", F.lit(0.0), lambda a, x: a + x.cast("double") * x)))
    ).first()
    shards, parts = max(1, -(-n // shard)), max(1, -(-(n_asks or 0) // asks))
    part = lambda many, salt: F.pmod(F.xxhash64("node", F.lit(salt)), F.lit(many)).cast("int")
    each = lambda many: F.explode(F.sequence(F.lit(0), F.lit(many - 1)))
    points = nodes.select("node", F.lit(False).alias("asks"), "embedding", part(shards, 2).alias("shard"), each(parts).alias("part"))
    asking = nodes.where("asks = 1").select("node", F.lit(True).alias("asks"), "embedding", each(shards).alias("shard"), part(parts, 1).alias("part"))
    search = _search(k, trees, ascent, quiet, float(longest or 0), seed)
    return points.union(asking.select(*points.columns)).groupBy("shard", "part").applyInPandas(search, "query long, node long, score double, met long")


def neighbours(vectors: DataFrame, k: int = 20, every: int = 20, trees: int = 128, ascent: float = 0.5, quiet: int = 4, shard: int = 16_384, asks: int = 16_384, seed: int = 11) -> DataFrame:
    """query_id, rank, vec_id and score: the ``k`` nearest found of each query.

    Queries are the rows whose vec_id is divisible by ``every``. Vectors are dealt to shards of
    about ``shard`` points, and every shard has a forest of its own: a sorted array of hash
    strings for each tree. A query descends all trees of every shard to its longest matches;
    then the shard's trees ascend together, one bit at a time. Exact inner products rank the
    points that each level adds. A query's ascent ends by its own results, when ``quiet`` levels in
    a row add nothing to its nearest, or else when the prefixes hold ``ascent`` times as many points
    as the shard has (a point counts once for each tree). The stated queries meet the shards in blocks of
    ``asks``, so a vector travels once for each block of queries, whatever the number of trees.

    Equal vectors form one node, and only its ``k + 1`` smallest ids travel on. Rows that are
    null, zero, not finite or of an odd dimension take no part; repeated vec_ids count once
    for each distinct vector. An empty table gives no rows.
    """
    good = usable(vectors)
    by_value = good.groupBy("embedding").agg(
        F.min("vec_id").alias("node"), F.max((F.col("vec_id") % every == 0).cast("int")).alias("asks")
    )
    nodes = checkpoint(by_value.select("node", "asks", "embedding"))
    near = candidates(nodes, k + 1, trees, ascent, quiet, shard, asks, seed)
    order = Window.partitionBy("query").orderBy(F.desc("score"), "node")
    top = near.groupBy("query", "node").agg(F.max("score").alias("score")).withColumn("r", F.row_number().over(order)).where(F.col("r") <= k + 1)
    # ids of equal vectors: the few smallest of each node, which the window sheds before it shuffles
    ids = good.join(nodes.drop("asks"), "embedding").select("vec_id", "node").distinct()
    same = Window.partitionBy("node").orderBy("vec_id")
    few = ids.withColumn("r", F.row_number().over(same)).where(F.col("r") <= k + 1).drop("r")
    best = Window.partitionBy("query").orderBy(F.desc("score"), "vec_id")
    listed = top.join(few, "node").withColumn("r", F.row_number().over(best)).where(F.col("r") <= k + 1).select("query", "vec_id", "score")
    asked = ids.where(F.col("vec_id") % every == 0).select(F.col("vec_id").alias("query_id"), F.col("node").alias("query"))
    pairs = asked.join(listed, "query").where("vec_id <> query_id")
    last = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return pairs.withColumn("rank", F.row_number().over(last)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
