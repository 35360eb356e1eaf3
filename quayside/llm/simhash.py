"""SimHash near-duplicates by a segment-popcount embedding (operator 8).

A 64-bit fingerprint maps to 32 counts, the bits set in each pair of bits. The Manhattan
distance of two such vectors is never more than the Hamming distance of the fingerprints.
With the 32 coordinates in ``blocks`` groups, two vectors within Manhattan distance d agree
exactly in at least ``blocks - d`` groups, so they meet in a grid cell of one of the
C(blocks, d) subspaces. Pairs of a cell within Manhattan distance d are verified on all 64 bits.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import chain, combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import checkpoint, connected_components, texts_of, words

#: In runs up to this long all pairs are compared by shifting; longer ones use pivots.
SHORT_RUN = 48
#: A cell with more fingerprints is dealt to finer cells.
LONG_RUN = 20_000


def fingerprint(text: str | None, shingle: int = 4) -> int:
    """Unsigned 64-bit SimHash: a bit is set if it is in over half of the shingles' XXH64 (seed 42).

    Fewer words than a shingle: the whole sequence is one; no words (null, empty, white
    space only): 0.
    """
    from xxhash import xxh64_intdigest

    w = words(text)
    if not w:
        return 0
    joined = b" ".join(w)
    ends = np.cumsum(np.fromiter(map(len, w), "i8", len(w)) + 1) - 1
    n = max(1, len(w) - shingle + 1)
    starts = np.concatenate([[0], ends[: n - 1] + 1])
    stops = ends[-n:]
    h = np.fromiter((xxh64_intdigest(joined[a:b], 42) for a, b in zip(starts.tolist(), stops.tolist(), strict=True)), "<u8", n)
    votes = np.zeros(64, "i8")
    for at in range(0, n, 65536):
        votes += np.unpackbits(h[at : at + 65536].view("u1").reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype="i8")
    return int(np.packbits(2 * votes > n, bitorder="little").view("<u8")[0])


def fingerprints(docs: DataFrame, shingle: int = 4) -> DataFrame:
    """``doc_id``, ``fp`` (the fingerprint as a signed long) and any further columns of ``docs`` but
    its texts, for every document."""
    more = [c for c in docs.columns if c not in ("doc_id", "text")]
    schema = docs.select(F.col("doc_id").cast("long"), F.lit(0).cast("long").alias("fp"), *more).schema

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            fps = np.fromiter((fingerprint(t, shingle) for t in texts_of(b.column(1))), "u8", b.num_rows).view("i8")
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(fps), *[b.column(k + 2) for k in range(len(more))]], ["doc_id", "fp", *more])

    return docs.select(F.col("doc_id").cast("long"), "text", *more).mapInArrow(each, schema)


class _Forest:
    """Joins ids and says which joins were new; lives for one task's buffer."""

    def __init__(self) -> None:
        self.up: dict[int, int] = {}

    def root(self, a: int) -> int:
        up = self.up
        while (x := up.get(a, a)) != a:
            a = up[a] = up.get(x, x)
        return a

    def join(self, a: int, b: int) -> bool:
        a, b = self.root(a), self.root(b)
        if a != b:
            self.up[max(a, b)] = min(a, b)
        return a != b


def embedded(fp: np.ndarray) -> np.ndarray:
    """The 32 counts, each as two bits: at least one, and two. Their Manhattan distance is then
    the number of bits in which two of these differ."""
    low = np.uint64(0x5555555555555555)
    even, odd = fp & low, fp >> np.uint64(1) & low
    return even | odd | (even & odd) << np.uint64(1)


def _near(a: np.ndarray, b: np.ndarray, most: int) -> np.ndarray:
    return np.bitwise_count(a ^ b) <= most


def _dense(fp: np.ndarray, node: np.ndarray, most: int, forest: _Forest, out: list[tuple[int, int]]) -> None:
    """Connect one long cell without listing its pairs.

    Pivots in turn take all that is within ``most`` of them; then only balls that are still
    apart, and whose pivots are within three radii, are compared member by member.
    """
    n, ball, pivots = len(fp), np.full(len(fp), -1), []
    for i in range(n):
        if ball[i] >= 0:
            continue
        near = np.flatnonzero(_near(fp, fp[i], most))
        for j in near.tolist():
            if j != i and forest.join(int(node[i]), int(node[j])):
                out.append((int(node[i]), int(node[j])))
        ball[near[ball[near] < 0]] = len(pivots)
        pivots.append(i)
    at = fp[pivots]
    members = [np.flatnonzero(ball == k) for k in range(len(pivots))] if len(pivots) > 1 else []
    for k in range(1, len(pivots)):
        for q in np.flatnonzero(_near(at[:k], at[k], 3 * most)).tolist():
            if forest.root(int(node[pivots[k]])) == forest.root(int(node[pivots[q]])):
                continue
            for i in members[k].tolist():
                for j in members[q][_near(fp[members[q]], fp[i], most)].tolist():
                    if forest.join(int(node[i]), int(node[j])):
                        out.append((int(node[i]), int(node[j])))


def _links(most: int, long_run: int | None):
    """Arrow stage over rows (combo, cell, fp) sorted by cell: the links that span each cell.

    A cell of over ``long_run`` fingerprints is handed back as it comes, with no ``b``.
    """
    names = ["a", "b", "combo", "cell"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, long = [np.empty(0, "i8")] * 3, None
        for batch in chain(batches, [None]):
            if batch is not None:
                held = [np.concatenate([h, batch.column(k).to_numpy(zero_copy_only=False)]) for k, h in enumerate(held)]
            combo, cell, fp = held
            if not len(combo):
                continue
            new = np.flatnonzero(np.concatenate([[True], (combo[1:] != combo[:-1]) | (cell[1:] != cell[:-1])]))
            ends = np.append(new[1:], len(combo))
            # the last cell may go on in the next batch; a long one is not waited for
            on = batch is not None and not (long_run and (ends[-1] - new[-1] > long_run or (combo[-1], cell[-1]) == long))
            stop = new[-1] if on else len(combo)
            size = ends - new
            over = (size > long_run) | ((combo[new] == long[0]) & (cell[new] == long[1]) if long else False) if long_run else np.zeros(len(new), bool)
            long = (combo[-1], cell[-1]) if over[-1] else None
            back = np.repeat(over, size)
            if back.any():
                cols = [pa.array(fp[back]), pa.nulls(int(back.sum()), pa.int64()), pa.array(combo[back]), pa.array(cell[back])]
                yield pa.RecordBatch.from_arrays(cols, names)
            held = [h[stop:] for h in held]
            if not stop:
                continue
            if on:
                new, size, over = new[:-1], size[:-1], over[:-1]
            node, fp = fp[:stop], fp[:stop].view("u8")
            at = embedded(fp)
            left = np.repeat(new + size, size) - np.arange(stop)  # rows from here to the end of the cell
            left[np.repeat(size > SHORT_RUN, size)] = 0
            forest, out = _Forest(), []
            i, step = np.flatnonzero(left > 1), 1
            while len(i):
                maybe = i[_near(at[i], at[i + step], most)]
                for k in maybe[_near(fp[maybe], fp[maybe + step], most)].tolist():
                    if forest.join(int(node[k]), int(node[k + step])):
                        out.append((int(node[k]), int(node[k + step])))
                step += 1
                i = i[left[i] > step]
            for k in np.flatnonzero((size > SHORT_RUN) & ~over).tolist():
                run_at = slice(new[k], new[k] + size[k])
                _dense(fp[run_at], node[run_at], most, forest, out)
            if out:
                a, b = zip(*out, strict=True)
                yield pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64()), *[pa.nulls(len(out), pa.int64())] * 2], names)

    return run


def _masks(blocks: int, agree: int, bits: int) -> list[int]:
    """Masks of every choice of ``agree`` of ``blocks`` groups of the 64 bits, taken ``bits`` at a time."""
    held = [sum((1 << bits) - 1 << bits * i for i in range(64 // bits) if i * blocks // (64 // bits) == b) for b in range(blocks)]
    masks = [sum(c) for c in combinations(held, agree)]
    return [m - (1 << 64) if m >> 63 else m for m in masks]


def blocks_for(classes: int, most: int = 4) -> int:
    """The fewest groups with which a fingerprint meets about four others or fewer by chance in a
    cell of the coarsest subspace. Two counts agree by chance in 3 of 8 cases."""
    for blocks in range(most + 1, 17):
        size = sorted(sum(i * blocks // 32 == b for i in range(32)) for b in range(blocks))
        if classes * (3 / 8) ** sum(size[: blocks - most]) <= 4:
            return blocks
    return 16


def links(classes: DataFrame, most: int = 4, blocks: int | None = None, long_run: int = LONG_RUN) -> DataFrame:
    """Links (a, b) between the fingerprints ``fp`` of ``classes`` that span every pair at ``most`` or
    fewer differing bits.

    ``blocks`` decides only the work: rows are C(blocks, most) for each class, and more blocks
    leave fewer chance pairs in a cell. Measured on random fingerprints, 7 blocks give 0.5 of
    these a class and subspace at a million classes, and in proportion; by default the number
    of classes chooses. The fingerprints of a cell of over ``long_run`` are dealt again, by
    choices of half of the fingerprint's eight bytes, of which they must share one.
    """
    blocks = blocks or blocks_for(classes.count(), most)
    even = F.col("fp").bitwiseAND(F.lit(0x5555555555555555))
    odd = F.shiftrightunsigned("fp", 1).bitwiseAND(F.lit(0x5555555555555555))
    counts = even.bitwiseOR(odd).bitwiseOR(F.shiftleft(even.bitwiseAND(odd), 1))
    grid = F.array(*[F.col("counts").bitwiseAND(F.lit(m)) for m in _masks(blocks, blocks - most, 2)])
    cells = classes.select("fp", counts.alias("counts")).select(F.posexplode(grid).alias("combo", "cell"), "fp")
    schema = "a long, b long, combo long, cell long"

    def met(rows: DataFrame, keys: list[str], run: int | None) -> DataFrame:
        return rows.repartition(*keys).sortWithinPartitions(*keys, "fp").select(F.col(keys[0]).cast("long"), keys[1], "fp").mapInArrow(_links(most, run), schema)

    first = checkpoint(met(cells, ["combo", "cell"], long_run))
    found = first.where("b is not null").select("a", "b")
    long = first.where("b is null").select(F.col("a").alias("fp")).distinct()
    if long.isEmpty():
        return found
    finer = F.array(*[F.col("fp").bitwiseAND(F.lit(m)) for m in _masks(8, 8 - most, 8)])
    again = met(long.select(F.posexplode(finer).alias("combo", "cell"), "fp"), ["combo", "cell"], None)
    return found.union(again.select("a", "b"))


def _components(fps: DataFrame, first: Column, most: int, blocks: int | None) -> DataFrame:
    """``fp`` and ``least``, the least ``first`` of all rows whose fingerprints reach each other."""
    classes = checkpoint(fps.groupBy("fp").agg(F.min(first).alias("least")))
    roots = connected_components(links(classes.select("fp"), most, blocks)).withColumnRenamed("node", "fp")
    of_class = classes.join(roots, "fp", "left").withColumn("root", F.coalesce("root", "fp"))
    least = of_class.groupBy("root").agg(F.min("least").alias("least"))
    return of_class.select("fp", "root").join(least, "root").select("fp", "least")


def near_duplicates(docs: DataFrame, shingle: int = 4, most: int = 4, blocks: int | None = None) -> DataFrame:
    """``doc_id``, ``fp`` (signed long) and ``component_id`` for every row of ``docs``.

    component_id is the smallest doc_id reachable by links of ``most`` or fewer differing
    bits. Equal fingerprints form one class before any join, so copies never make pairs. Rows
    without doc_id keep null there, link like any other, and take their component's id (null if
    none of its rows has one); a doc_id that repeats with other texts is in several components.
    An empty table gives no rows.
    """
    fps = checkpoint(fingerprints(docs.select("doc_id", "text"), shingle))
    found = _components(fps, F.col("doc_id"), most, blocks)
    return fps.join(found, "fp").select("doc_id", "fp", F.col("least").alias("component_id"))


def keep_one(docs: DataFrame, shingle: int = 4, most: int = 4, blocks: int | None = None, broadcast_rows: int = 2_000_000) -> DataFrame:
    """One row of each component of ``docs``, with the columns as they were.

    The row with the smallest doc_id stays (one without doc_id only if none has any; ties: the
    first read). Rows are told apart by their place, not by doc_id, so ``docs`` must give its rows
    in the same order when it is read again, as tables and checkpoints do. Up to
    ``broadcast_rows`` places of rows that go are broadcast, and then no text is shuffled.
    """
    place = "place"
    while place in docs.columns:
        place += "_"
    placed = docs.withColumn(place, F.monotonically_increasing_id())
    fps = checkpoint(fingerprints(placed.select("doc_id", "text", F.col(place).alias("place")), shingle))
    first = F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "place")
    going = fps.join(_components(fps, first, most, blocks), "fp").where("place <> least.place")
    going = checkpoint(going.select(F.col("place").alias(place)))
    if going.count() <= broadcast_rows:
        going = F.broadcast(going)
    return placed.join(going, place, "left_anti").select(docs.columns)
