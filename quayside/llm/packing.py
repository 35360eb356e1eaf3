"""Best-fit packing of documents into training sequences (operator 9)."""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import checkpoint, slices
from .token_lengths import encoder

PIECES = "doc_id long, piece int, start long, length long, ids_crc32 long, task long, nth long"


def pieces(docs: DataFrame, tokenizer_path: str, capacity: int, end_id: int = 0) -> DataFrame:
    """Encode whole documents, close each with ``end_id`` and cut those over ``capacity``.

    ``task`` and ``nth`` number the pieces of one length inside the task that made them.
    Null or empty text gives one piece that holds only ``end_id``.
    """
    end, step = np.array([end_id], "<u4").tobytes(), 4 * capacity

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc, seen, task = encoder(tokenizer_path), {}, TaskContext.get().partitionId()
        for batch in slices(batches):
            rows: list[tuple] = []
            for doc, ids in zip(batch.column(0).to_pylist(), enc.encode_all(batch.column(1).to_pylist()), strict=True):
                ids += end
                for k, at in enumerate(range(0, len(ids), step)):
                    part = ids[at : at + step]
                    n = len(part) // 4
                    nth = seen[n] = seen.get(n, -1) + 1
                    rows.append((doc, k, at // 4, n, zlib.crc32(part), task, nth))
            cols = list(zip(*rows, strict=True)) or [()] * 7
            kinds = [pa.int64(), pa.int32(), *[pa.int64()] * 5]
            names = ["doc_id", "piece", "start", "length", "ids_crc32", "task", "nth"]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, kinds, strict=True)], names)

    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(cut, PIECES)


def plan(counts: dict[int, int], capacity: int, max_docs: int, max_cost: int, weights: tuple[float, float, float] = (1.0, 0.25, 0.25), norm: bool = False) -> tuple[dict[int, tuple[np.ndarray, np.ndarray, np.ndarray]], int]:
    """Vector best-fit decreasing over the histogram of lengths.

    A piece of length n asks for the vector (n tokens, 1 document, n * n attention cost) and a
    sequence offers (capacity, max_docs, max_cost). Longest first, a piece goes to the open
    sequence that can hold it under all three constraints and whose weighted dot-product of
    demand and residual is least (``norm``: whose weighted residual norm is least). Sequences
    with equal contents are handled as one group with a multiplicity, so the work depends on
    the number of distinct lengths (at most ``capacity``), never on the number of documents.

    Returns, per length, the sorted first ranks, the sequence of that rank and the offset:
    piece number r of the length lies in the last range whose first rank is <= r.
    """
    if any(n > capacity or n * n > max_cost for n in counts) or max_docs < 1:
        raise ValueError("a piece does not fit an empty sequence")
    full = np.array([capacity, max_docs, max_cost], float)
    w = np.array(weights) / full / full
    left = np.zeros((1024, 3))  # residuals of open groups
    many: list[int] = []
    inside: list[tuple] = []  # contents as linked (rest, length, pieces)
    live = 0

    def put(residual: np.ndarray, n: int, content: tuple) -> None:
        nonlocal left, live
        if live == len(left):
            left = np.concatenate([left, np.zeros_like(left)])
        if live == len(many):
            many.append(0)
            inside.append(())
        left[live], many[live], inside[live] = residual, n, content
        live += 1

    done: list[tuple[int, tuple]] = []
    for length in sorted(counts, reverse=True):
        todo, need = counts[length], np.array([length, 1, length * length], float)
        while todo:
            open_ = left[:live]
            ok = np.flatnonzero((open_ >= need).all(axis=1))
            if len(ok):
                fit = ((open_[ok] - need) ** 2 @ w) if norm else open_[ok] @ (w * need)
                g = int(ok[np.argmin(fit)])
                each = 1 if many[g] > todo else int(min(*(left[g] // need), todo // many[g]))
                used = min(many[g], todo)
                base, content, rest = left[g].copy(), inside[g], many[g] - used
                if rest:
                    many[g] = rest
                else:  # the last group takes the freed place
                    live -= 1
                    left[g], many[g], inside[g] = left[live], many[live], inside[live]
            else:
                each = int(min(*(full // need), todo))
                used, base, content = todo // each, full.copy(), ()
            residual = base - each * need
            now = (content, length, each)
            if residual.min() < 1:
                done.append((used, now))
            else:
                put(residual, used, now)
            todo -= used * each
    done += [(many[g], inside[g]) for g in range(live)]
    slots: dict[int, list] = {n: [] for n in counts}
    rank, first = dict.fromkeys(counts, 0), 0
    for n, content in done:
        at, chain = 0, []
        while content:
            chain.append(content[1:])
            content = content[0]
        for length, each in reversed(chain):
            for _ in range(each):
                slots[length].append((rank[length], first, at))
                rank[length] += n
                at += length
        first += n
    return {n: tuple(np.array(c, "i8") for c in zip(*s, strict=True)) for n, s in slots.items()}, first


def pack(docs: DataFrame, tokenizer_path: str, capacity: int = 2048, max_docs: int | None = None, max_cost: int | None = None, end_id: int = 0, weights: tuple[float, float, float] = (1.0, 0.25, 0.25), norm: bool = False) -> DataFrame:
    """One row per piece with its ``sequence_id`` and ``offset``.

    The pieces are made once and checkpointed. The plan needs only the number of pieces of
    each length, at most ``capacity`` rows on the driver at any input size; each piece then
    finds its place by its rank among those of its length, which is a prefix sum over tasks.
    Unset ``max_docs`` and ``max_cost`` leave only the token constraint binding.
    An empty table gives no rows; a null doc_id is kept as it is.
    """
    made = checkpoint(pieces(docs, tokenizer_path, capacity, end_id))
    per_task = made.groupBy("task", "length").agg(F.count("*").alias("n"))
    counts = {r[0]: r[1] for r in per_task.groupBy("length").agg(F.sum("n")).collect()}
    slots, _ = plan(counts, capacity, max_docs or capacity, max_cost or capacity * capacity, weights, norm)
    earlier = Window.partitionBy("length").orderBy("task").rowsBetween(Window.unboundedPreceding, -1)
    base = per_task.select("task", "length", F.coalesce(F.sum("n").over(earlier), F.lit(0)).alias("base"))
    placed = docs.sparkSession.sparkContext.broadcast(slots)

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            length, rank = (batch.column(k).to_numpy(zero_copy_only=False) for k in (3, 5))
            seq, at = np.empty(len(length), "i8"), np.empty(len(length), "i8")
            for n in np.unique(length):
                mine = np.flatnonzero(length == n)
                first, sequence, offset = placed.value[int(n)]
                k = np.searchsorted(first, rank[mine], "right") - 1
                seq[mine], at[mine] = sequence[k] + rank[mine] - first[k], offset[k]
            yield pa.RecordBatch.from_arrays([*batch.columns[:5], pa.array(seq), pa.array(at)], [*batch.schema.names[:5], "sequence_id", "offset"])

    ranked = made.join(base, ["task", "length"]).select("doc_id", "piece", "start", "length", "ids_crc32", (F.col("base") + F.col("nth")).alias("rank"))
    return ranked.mapInArrow(place, "doc_id long, piece int, start long, length long, ids_crc32 long, sequence_id long, offset long")
