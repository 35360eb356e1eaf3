"""Hard negatives of anchors by bounds along spanning trees of the anchors (operator 12).

For a candidate c and anchors a, b it holds that b.c = a.c + (b - a).c, so that b's score lies
within |b - a| |c| of a's. Anchors are dealt to blocks of neighbours, each block has a minimum
spanning tree, and scores go down the tree as intervals. A candidate is scored again only where
its interval overlaps the window of scores that the anchor asks for.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import checkpoint

#: Components are held to +-2^24, so that every score is exact in 64 bits (up to 2^15 dimensions).
LARGEST = 1 << 24
#: Intervals are this much wider than real arithmetic makes them.
SLACK = 1e-9


def integers(vectors: DataFrame, scale: int = 256, every: int = 7, labels: int = 10) -> DataFrame:
    """vec_id, label and q (floor of ``scale`` times each component) of the rows that take part.

    Rows with a null id, label, vector or component, or one that is not finite, take no part. Of
    rows with the same vec_id the one with the smallest label and vector counts.
    """
    ok = vectors.select(F.col("vec_id").cast("long"), F.col("label").cast("long"), F.col("embedding").cast("array<double>").alias("x")).where(
        "vec_id is not null and label is not null and x is not null and not exists(x, v -> v is null or isnan(v) or abs(v) = double('Infinity'))"
    )
    q = F.transform("x", lambda v: F.greatest(F.lit(-LARGEST), F.least(F.lit(LARGEST), F.floor(v * scale))).cast("double"))
    label = F.when(F.col("vec_id") % every == 0, (F.col("label") + 1) % labels).otherwise(F.col("label"))
    one = ok.groupBy("vec_id").agg(F.min(F.struct("label", "x")).alias("of")).select("vec_id", F.col("of.label").alias("label"), F.col("of.x").alias("x"))
    return one.select("vec_id", label.alias("label"), q.alias("q"))


def spanning_tree(x: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Of the minimum spanning tree of the rows of ``x``: rows in the order of a walk from the row
    nearest the mean, and for each step of it the parent's step (-1: root), the edge and the depth."""
    n = len(x)
    square = (x * x).sum(1)
    root = int(np.argmin(((x - x.mean(0)) ** 2).sum(1)))
    parent, best = np.full(n, root), np.full(n, np.inf)
    inside, children, now = np.zeros(n, bool), [[] for _ in range(n)], root
    for _ in range(n - 1):
        inside[now] = True
        d = np.maximum(0, square + square[now] - 2 * (x @ x[now]))
        nearer = ~inside & (d < best)
        best[nearer], parent[nearer] = d[nearer], now
        now = int(np.argmin(np.where(inside, np.inf, best)))
        children[parent[now]].append(now)
    order, above, depth, todo = [], [], [], [(root, -1, 0)]
    while todo:
        i, up, k = todo.pop()
        todo += [(c, len(order), k + 1) for c in children[i]]
        order.append(i)
        above.append(up)
        depth.append(k)
    walk = np.array(order)
    edge = np.sqrt(((x[walk] - x[walk[np.maximum(above, 0)]]) ** 2).sum(1))
    return walk, np.array(above), edge, np.array(depth)


def _matrix(column: pa.Array, dim: int) -> np.ndarray:
    """Lists as rows of a matrix; missing components at the end are zero."""
    flat, at = column.flatten().to_numpy(zero_copy_only=False), column.offsets.to_numpy()
    at = at - at[0]
    size = np.diff(at)
    out = np.zeros((len(size), dim))
    rows = np.repeat(np.arange(len(size)), size)
    out[rows, np.arange(len(flat)) - np.repeat(at[:-1], size)] = flat
    return out


def trees(anchors: DataFrame, count: int, dim: int, block: int = 256) -> DataFrame:
    """``anchors`` with the block, the step, the edge from the parent's step and the depth of each.

    Blocks are runs of ``block`` anchors in the order of their components' signs, then of vec_id.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        first, rest = TaskContext.get().partitionId() << 32, None
        for batch in (*batches, None):
            held = pa.Table.from_batches([x for x in (rest, batch) if x is not None]).combine_chunks() if rest or batch else None
            rest = None
            for rows in held.to_batches(max_chunksize=block) if held else []:
                if batch is not None and rows.num_rows < block:
                    rest = rows
                    break
                walk, _, edge, depth = spanning_tree(_matrix(rows.column(2), dim))
                rows, n = rows.take(pa.array(walk)), len(walk)
                yield pa.RecordBatch.from_arrays([*rows.columns, pa.array(np.full(n, first)), pa.array(np.arange(n)), pa.array(edge), pa.array(depth)], ["vec_id", "label", "q", "block", "step", "edge", "depth"])
                first += 1

    signs = F.transform(F.slice("q", 1, 16), lambda v: v > 0)
    near = anchors.repartitionByRange(max(1, count // (16 * block)), signs, "vec_id").sortWithinPartitions(signs, "vec_id")
    return near.select("vec_id", "label", "q").mapInArrow(run, "vec_id long, label long, q array<double>, block long, step long, edge double, depth long")


class Slice:
    """Some candidates: ids, labels, vectors and their lengths."""

    def __init__(self, ids: np.ndarray, labels: np.ndarray, x: np.ndarray, exact: bool):
        self.ids, self.labels, self.length = ids, labels, np.sqrt((x * x).sum(1)) * (1 + SLACK)
        self.exact = exact  # whether doubles hold every score
        self.x = x if exact else x.astype("i8")

    def score(self, at: np.ndarray | slice, anchor: np.ndarray) -> np.ndarray:
        return self.x[at] @ (anchor if self.exact else anchor.astype("i8"))


def walk(part: Slice, q: np.ndarray, edge: np.ndarray, depth: np.ndarray, ask: Callable[[int, np.ndarray, np.ndarray], np.ndarray], told: Callable[[int, np.ndarray, np.ndarray], None]) -> None:
    """Down a tree with the intervals of all candidates' scores. Of each step ``ask`` gives the
    candidates (of which it gets low and high) whose exact scores are needed, and ``told`` gets these."""
    held: list[tuple[np.ndarray, np.ndarray]] = []
    reach = np.sqrt((q * q).sum(1)) * (1 + SLACK)
    for k in range(len(q)):
        del held[depth[k] :]
        if not k:
            low = part.score(slice(None), q[0]).astype("f8")
            high = low + (abs(low) * SLACK + SLACK)
            low = 2 * low - high
        else:
            off, most = part.length * (edge[k] * (1 + SLACK) + SLACK) + SLACK, part.length * reach[k] + SLACK
            low, high = np.maximum(held[-1][0] - off, -most), np.minimum(held[-1][1] + off, most)
        need = ask(k, low, high)
        if len(need):
            score = part.score(need, q[k])
            told(k, need, score)
            low[need] = score - (abs(score) * SLACK + SLACK)
            high[need] = score + (abs(score) * SLACK + SLACK)
        held.append((low, high))


def _best(score: np.ndarray, ids: np.ndarray, k: int) -> np.ndarray:
    """Places of the ``k`` best, ties by smaller id."""
    if len(score) > 8 * k:
        some = np.flatnonzero(score >= np.partition(score, len(score) - k)[len(score) - k])
        return some[np.lexsort((ids[some], -score[some]))[:k]]
    return np.lexsort((ids, -score))[:k]


class Positives:
    """The ``k`` best other rows of each anchor's label."""

    schema = "anchor_id long, vec_id long, score long"

    def __init__(self, k: int):
        self.k = k

    def begin(self, rows: dict[str, np.ndarray]) -> None:
        self.rows, self.found = rows, [(np.empty(0, "i8"), np.empty(0, "i8"))] * len(rows["vec_id"])

    def over(self, part: Slice) -> tuple[Callable, Callable]:
        labels, k = self.rows["label"], self.k
        of = {x: np.flatnonzero(part.labels == x) for x in np.unique(labels).tolist()}

        def ask(i: int, low: np.ndarray, high: np.ndarray) -> np.ndarray:
            at = of[labels[i]]
            at = at[part.ids[at] != self.rows["vec_id"][i]]
            sure = np.concatenate([self.found[i][0].astype("f8"), low[at]])
            floor = np.partition(sure, len(sure) - k)[len(sure) - k] if len(sure) > k else -np.inf
            return at[high[at] >= floor]

        def told(i: int, at: np.ndarray, score: np.ndarray) -> None:
            score, ids = np.concatenate([self.found[i][0], score.astype("i8")]), np.concatenate([self.found[i][1], part.ids[at]])
            best = _best(score, ids, k)
            self.found[i] = score[best], ids[best]

        return ask, told

    def end(self) -> list[pa.Array]:
        n = [len(x) for x, _ in self.found]
        return [pa.array(np.repeat(self.rows["vec_id"], n)), pa.array(np.concatenate([x for _, x in self.found])), pa.array(np.concatenate([x for x, _ in self.found]))]


class Negatives:
    """Of each anchor and positive the ``k`` best of other labels from ``least``/100 of its score up to it."""

    schema = "anchor_id long, positive_id long, negative_id long, positive_score long, negative_score long"

    def __init__(self, k: int, least: int):
        self.k, self.least = k, least

    def begin(self, rows: dict[str, np.ndarray]) -> None:
        self.rows = rows
        self.pairs = [[(int(s), int(p), -(-self.least * int(s) // 100)) for p, s in zip(ps, ss, strict=True) if s >= 0] for ps, ss in zip(rows["positives"], rows["scores"], strict=True)]
        self.found = [[(np.empty(0, "i8"), np.empty(0, "i8"))] * len(x) for x in self.pairs]

    def over(self, part: Slice) -> tuple[Callable, Callable]:
        k, labels = self.k, self.rows["label"]
        none = np.empty(0, "i8")

        def ask(i: int, low: np.ndarray, high: np.ndarray) -> np.ndarray:
            if not self.pairs[i]:
                return none
            top, floor = max(s for s, _, _ in self.pairs[i]), min(
                max(w, int(f[0][-1]) if len(f[0]) == k else w) for (_, _, w), f in zip(self.pairs[i], self.found[i], strict=True)
            )
            return np.flatnonzero((high >= floor) & (low <= top) & (part.labels != labels[i]))

        def told(i: int, at: np.ndarray, score: np.ndarray) -> None:
            score, ids = score.astype("i8"), part.ids[at]
            for j, (top, _, floor) in enumerate(self.pairs[i]):
                inside = np.flatnonzero((score <= top) & (score >= floor))
                both, named = np.concatenate([self.found[i][j][0], score[inside]]), np.concatenate([self.found[i][j][1], ids[inside]])
                best = _best(both, named, k)
                self.found[i][j] = both[best], named[best]

        return ask, told

    def end(self) -> list[pa.Array]:
        flat = [(a, p, s, f) for a, pairs, found in zip(self.rows["vec_id"].tolist(), self.pairs, self.found, strict=True) for (s, p, _), f in zip(pairs, found, strict=True)]
        n = [len(f[0]) for *_, f in flat]
        each = lambda c: pa.array(np.repeat(np.array([x[c] for x in flat], "i8"), n))
        joined = lambda c: pa.array(np.concatenate([np.empty(0, "i8"), *(x[3][c] for x in flat)]))
        return [each(0), each(1), joined(1), each(2), joined(0)]


def meet(nodes: DataFrame, steps: DataFrame, count: int, dim: int, largest: float, search: Positives | Negatives, rows: int, piece: int = 8_192) -> DataFrame:
    """What ``search`` finds for the trees of ``steps`` in each chunk of about ``rows`` candidates.

    A chunk's candidates come first and stay; the trees follow one by one, so a task holds one
    chunk and one block whatever their number. An anchor travels once for each chunk.
    """
    chunks, names = max(1, -(-count // rows)), search.schema.replace(" long", "").split(", ")
    exact = largest * largest * dim < 2**53

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        chunk, parts, pending, key = None, [], [], None

        def flush() -> Iterator[pa.RecordBatch]:
            nonlocal parts
            if pending and key[1] < 0:
                data = pa.Table.from_batches(pending)
                parts = [Slice(x.column("vec_id").to_numpy(), x.column("label").to_numpy(), _matrix(x.column("q"), dim), exact) for x in data.combine_chunks().to_batches(max_chunksize=piece)]
            elif pending:
                data = pa.Table.from_batches(pending).combine_chunks().to_batches()[0]
                about = {n: data.column(n).to_numpy() for n in ("vec_id", "label", "edge", "depth")}
                about |= {n: data.column(n).to_pylist() for n in ("positives", "scores")}
                q = _matrix(data.column("q"), dim)
                search.begin(about)
                for part in parts:
                    walk(part, q, about["edge"], about["depth"], *search.over(part))
                yield pa.RecordBatch.from_arrays(search.end(), names)
            pending.clear()

        for batch in batches:
            of, block = batch.column("chunk").to_numpy(), batch.column("block").to_numpy()
            cuts = np.flatnonzero((np.diff(of) != 0) | (np.diff(block) != 0)) + 1
            for a, b in zip([0, *cuts], [*cuts, batch.num_rows], strict=True):
                if (of[a], block[a]) != key:
                    yield from flush()
                    if of[a] != chunk:
                        chunk, parts = of[a], []
                    key = (of[a], block[a])
                pending.append(batch.slice(a, b - a))
        yield from flush()

    none = [F.lit(x).cast(t).alias(n) for n, t, x in (("block", "long", -1), ("step", "long", 0), ("edge", "double", 0), ("depth", "long", 0), ("positives", "array<long>", None), ("scores", "array<long>", None))]
    candidates = nodes.select(F.pmod(F.xxhash64("vec_id"), F.lit(chunks)).cast("int").alias("chunk"), "vec_id", "label", "q", *none)
    asking = steps.select(F.explode(F.sequence(F.lit(0), F.lit(chunks - 1))).alias("chunk"), "vec_id", "label", "q", "block", "step", "edge", "depth", *(c if c in steps.columns else F.lit(None).cast("array<long>").alias(c) for c in ("positives", "scores")))
    together = candidates.union(asking.select(*candidates.columns)).repartition(chunks, "chunk").sortWithinPartitions("chunk", "block", "step")
    return together.mapInArrow(run, search.schema)


def mine(vectors: DataFrame, every: int = 100, positives: int = 5, negatives: int = 5, least: int = 80, block: int = 256, rows: int = 32_768) -> DataFrame:
    """anchor_id, positive_id, rank, negative_id, positive_score and negative_score.

    Anchors are the rows whose vec_id is divisible by ``every``. An anchor's positives are the
    ``positives`` best other rows of its label by inner product of integer vectors. Of each the
    ``negatives`` best rows of other labels follow whose score is from ``least`` hundredths of the
    positive's up to it; a positive of negative score has none. Ties go to the smaller vec_id.

    Vectors shorter than the longest count as ending in zeros; components beyond +-2^24 count as
    that. An empty table, or one without anchors, gives no rows. The stated anchors meet all rows
    in blocks: first for the positives, and then, with their windows of scores, for the negatives.
    """
    nodes = checkpoint(integers(vectors))
    anchor = F.col("vec_id") % every == 0
    count, asking, dim, largest = nodes.agg(F.count("*"), F.count_if(anchor), F.max(F.size("q")), F.max(F.array_max(F.transform("q", F.abs)))).first()
    shape = (count, dim or 0, largest or 0.0)
    steps = checkpoint(trees(nodes.where(anchor), asking, dim or 0, block))
    near = meet(nodes, steps, *shape, Positives(positives), rows)
    best = Window.partitionBy("anchor_id").orderBy(F.desc("score"), "vec_id")
    top = near.withColumn("r", F.row_number().over(best)).where(F.col("r") <= positives)
    of = top.groupBy("anchor_id").agg(F.collect_list(F.struct("vec_id", "score")).alias("of"))
    windows = of.select(F.col("anchor_id").alias("vec_id"), F.col("of.vec_id").alias("positives"), F.col("of.score").alias("scores"))
    none = F.array().cast("array<long>")
    asked = checkpoint(steps.join(windows, "vec_id", "left").withColumns({c: F.coalesce(c, none) for c in ("positives", "scores")}))
    hard = meet(nodes, asked, *shape, Negatives(negatives, least), rows)
    last = Window.partitionBy("anchor_id", "positive_id").orderBy(F.desc("negative_score"), "negative_id")
    ranked = hard.withColumn("rank", F.row_number().over(last)).where(F.col("rank") <= negatives)
    return ranked.select("anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score")
