"""Benchmark decontamination by pigeonhole edit matching (operator 4)."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.broadcast import Broadcast
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.functions import arrow_udf

from .common import checkpoint, texts_of

FIELDS = {"item_id": pa.int64()} | dict.fromkeys(("distance", "error_budget", "item_length", "match_end"), pa.int32())
LEAK = "leaks of a block"
LEAKS = "array<struct<item_id:bigint,distance:int,error_budget:int,item_length:int,match_end:int>>"


def normal(text: str | None) -> str:
    """Lower case, with every run of white space as one space; null is empty."""
    return " ".join((text or "").lower().split())


def budget(length: int, rate: float) -> int:
    """Edits allowed for an item of so many characters."""
    return int(length * rate)


def split(item: str, errors: int) -> list[tuple[int, str]]:
    """``errors + 1`` pieces of nearly equal length, with where they start."""
    cuts = [k * len(item) // (errors + 1) for k in range(errors + 2)]
    return [(a, item[a:b]) for a, b in zip(cuts, cuts[1:], strict=False)]


def bitmasks(pattern: str) -> dict[str, int]:
    masks: dict[str, int] = {}
    for k, c in enumerate(pattern):
        masks[c] = masks.get(c, 0) | 1 << k
    return masks


def myers(masks: dict[str, int], m: int, text: str, most: int) -> tuple[int, int] | None:
    """Least edit distance of the pattern to any stretch of ``text``, if at most ``most``, and
    where that stretch ends (the first such place). Myers' bit-vectors in one long integer."""
    whole, top = (1 << m) - 1, 1 << (m - 1)
    pv, mv, score, best, at = whole, 0, m, most + 1, 0
    for j, c in enumerate(text, 1):
        eq = masks.get(c, 0)
        xv = eq | mv
        xh = (((eq & pv) + pv) ^ pv) | eq
        ph = mv | (~(xh | pv) & whole)
        mh = pv & xh
        if ph & top:
            score += 1
        elif mh & top:
            score -= 1
            if score < best:
                best, at = score, j
        ph = (ph << 1) & whole
        pv = ((mh << 1) & whole) | (~(xv | ph) & whole)
        mv = ph & xv
    return (best, at) if best <= most else None


def one_edit(text: str, at: int, piece: str, before: int) -> bool:
    """Whether ``piece`` may stand right after ``at`` (or end there) with one edit: half of it is intact."""
    h, n = len(piece) // 2, len(piece)
    if before:
        return text.endswith(piece[h:], 0, at) or piece[:h] in text[max(0, at - n - 1) : max(0, at - n + h + 1)]
    return text.startswith(piece[:h], at) or piece[h:] in text[max(0, at + h - 1) : at + n + 1]


class Matcher:
    """All pieces of one block of items in one Aho-Corasick automaton."""

    def __init__(self, items: list[tuple[int, str]], rate: float):
        import ahocorasick

        self.items, self.find = [], ahocorasick.Automaton()
        where: dict[str, list[tuple]] = {}
        for item_id, text in items:
            t = normal(text)
            if not t:
                continue
            errors = budget(len(t), rate)
            parts = split(t, errors)
            for k, (at, piece) in enumerate(parts):
                # two, four and eight pieces side by side: of n pieces with fewer than n edits some
                # half again has fewer edits than pieces, so some hit of a true copy passes them all
                groups = []
                for n in (4, 8):
                    a, b = k // n * n, min(k // n * n + n, errors + 1)
                    if n // 2 < errors + 1:
                        lo, hi = parts[a][0], parts[b - 1][0] + len(parts[b - 1][1])
                        groups.append((at - lo, hi - lo, b - a - 1, bitmasks(t[lo:hi])))
                beside = parts[k ^ 1][1] if k ^ 1 <= errors else ""
                where.setdefault(piece, []).append((len(self.items), at, k & 1, beside, groups))
            self.items.append((item_id, len(t), errors, bitmasks(t)))
        for piece, found in where.items():
            self.find.add_word(piece, (len(piece), found))
        if where:
            self.find.make_automaton()

    def matches(self, text: str | None) -> list[tuple[int, int, int, int, int]]:
        t = normal(text)
        if not self.items or not t:
            return []
        spans: dict[int, list[list[int]]] = {}
        for end, (size, found) in self.find.iter(t):
            start = end + 1 - size
            for item, at, odd, beside, groups in found:
                if beside and not one_edit(t, start if odd else end + 1, beside, odd):
                    continue
                _, m, errors, _ = self.items[item]
                if not all(
                    myers(masks, n, t[max(0, start - before - most) : start - before + n + most], most)
                    for before, n, most, masks in groups
                ):
                    continue
                lo, hi = start - at - errors, start - at + m + errors
                own = spans.setdefault(item, [])
                if own and lo <= own[-1][1]:  # hits come in order of their ends: windows of one copy overlap
                    own[-1][0], own[-1][1] = min(own[-1][0], lo), max(own[-1][1], hi)
                else:
                    own.append([lo, hi])
        out = []
        for item, windows in spans.items():
            item_id, m, errors, masks = self.items[item]
            best = None
            for lo, hi in windows:
                lo = max(0, lo)
                found = myers(masks, m, t[lo:hi], errors)
                if found and (best is None or found[0] < best[0]):
                    best = (found[0], lo + found[1])
            if best:
                out.append((item_id, best[0], errors, m, best[1]))
        return sorted(out)


def blocks(benchmark: DataFrame, block_chars: int = 4_000_000) -> Iterator[list[tuple[int, str]]]:
    """Distinct items, in blocks of about ``block_chars`` characters, one block on the driver at a time."""
    items = benchmark.where("item_id is not null and text is not null").select(F.col("item_id").cast("long"), "text").distinct()
    chars = items.agg(F.sum(F.length("text"))).first()[0] or 0
    n = -(-chars // block_chars)
    for k in range(n):
        yield [(r.item_id, r.text) for r in items.where(F.pmod(F.xxhash64("item_id", "text"), F.lit(n)) == k).orderBy("item_id", "text").collect()]


def _finder(shared: Broadcast, rate: float):
    """The matches of one block of items, as a column function."""
    ready: list[Matcher] = []

    def look(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        if not ready:
            ready.append(Matcher(shared.value, rate))
        for texts in batches:
            yield pa.array([[dict(zip(FIELDS, x, strict=True)) for x in ready[0].matches(t)] for t in texts_of(texts)], pa.list_(pa.struct(FIELDS.items())))

    return arrow_udf(look, LEAKS)


def matches(docs: DataFrame, benchmark: DataFrame, rate: float = 0.1) -> DataFrame:
    """``docs`` with ``leaks``: an array of every benchmark item found in the text.

    An item of m characters (after ``normal``) is found if some stretch of the whole text is
    within ``int(m * rate)`` edits of it. The stretch must hold one of that many plus one
    pieces unchanged, so exact piece hits miss nothing; Myers' distance then decides. The
    stated items run against all rows in blocks of bounded size. Null or empty texts and items
    match nothing; items that are alike each count; with no items the arrays are empty.
    """
    found = [_found(docs, block, rate) for block in blocks(benchmark)]
    empty = F.array().cast(LEAKS)
    return docs.withColumn("leaks", found[0] if len(found) == 1 else F.concat(*found) if found else empty)


def _found(docs: DataFrame, block: list[tuple[int, str]], rate: float) -> Column:
    return _finder(docs.sparkSession.sparkContext.broadcast(block), rate)("text")


def contaminated(docs: DataFrame, benchmark: DataFrame, rate: float = 0.1, block_chars: int = 4_000_000) -> DataFrame:
    """One row per document row and benchmark item found in it.

    Every block of items has tasks of its own, so that none holds more than one automaton.
    """
    rows = docs.select(F.col("doc_id").cast("long"), "text")
    # an outer generator: an inner one would make the optimizer match every text twice
    leaks = lambda found: rows.select("doc_id", F.inline_outer(found)).where("item_id is not null")
    out = leaks(F.array().cast(LEAKS))
    for k, block in enumerate(blocks(benchmark, block_chars)):
        here = leaks(_found(rows, block, rate))
        out = out.union(here) if k else here
    return out


def clean(docs: DataFrame, benchmark: DataFrame, rate: float = 0.1, block_chars: int = 4_000_000) -> DataFrame:
    """``docs`` without the rows that hold a benchmark item; columns as they were.

    Blocks of items go over the documents in turn, each over what the ones before have left.
    """
    out = docs
    for k, block in enumerate(blocks(benchmark, block_chars)):
        out = (checkpoint(out) if k else out).withColumn(LEAK, _found(docs, block, rate)).where(F.size(LEAK) == 0).select(docs.columns)
    return out
