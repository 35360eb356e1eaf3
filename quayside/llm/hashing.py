"""Words and their contexts as 64-bit hashes, and bit sets of them, for the suffix tree."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

#: A context's hash is the sum of word hashes times powers of BASE, the last word first.
BASE, STEP, OTHER = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xD1B54A32D192ED03), np.uint64(0x2545F4914F6CDD1D)
CHUNK = 1 << 16
#: Keys whose places in a bit set a task groups before it hands them on.
KEYS = 1_000_000


def mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


#: Powers that weigh the bytes of a word by their place, and a number for each byte.
PLACE, BYTE = np.uint64(0x9FB21C651E98DF25), mix(np.arange(1, 257, dtype="u8") * BASE)
SPACE, LOWER = np.zeros(256, bool), np.arange(256, dtype="u1")
SPACE[[9, 10, 11, 12, 13, 32]] = True
LOWER[65:91] += 32


def hashed_words(texts: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Words of a run of texts (``[^\\x20\\x09-\\x0D]+`` after lower-casing A-Z), each text closed by an
    empty word: their 64-bit hashes, their last two bytes as a number, where each text's words
    begin, and how many it has. No word becomes a Python object."""
    texts = texts.cast(pa.string()).fill_null("")
    at = np.frombuffer(texts.buffers()[1], "i4")[texts.offset : texts.offset + len(texts) + 1].astype("i8")
    raw = texts.buffers()[2]
    data = LOWER[np.frombuffer(raw, "u1")[at[0] : at[-1]]] if raw is not None and at[-1] > at[0] else np.empty(0, "u1")
    at = at - at[0]
    inside = ~SPACE[data]
    edge = np.zeros(len(data) + 1, bool)  # before this byte a text begins
    edge[at] = True
    before = np.concatenate([[False], inside[:-1]]) & ~edge[:-1] if len(data) else inside
    start = inside & ~before
    starts = np.flatnonzero(start)
    last = np.flatnonzero(inside & (edge[1:] | ~np.concatenate([inside[1:], [False]]))) if len(data) else starts
    size = last - starts + 1
    place = np.arange(len(data)) - np.repeat(starts, np.diff(np.append(starts, len(data)))) if len(starts) and starts[0] == 0 else None
    if place is None:
        head = starts[0] if len(starts) else len(data)
        place = np.concatenate([np.zeros(head, "i8"), np.arange(head, len(data)) - np.repeat(starts, np.diff(np.append(starts, len(data))))])
    power = np.cumprod(np.full(int(size.max(initial=0)) + 1, PLACE))
    value = BYTE[data] * power[np.minimum(place, len(power) - 1)]
    value[~inside] = 0
    h = mix(np.add.reduceat(value, starts) + size.astype("u8") * STEP) if len(starts) else np.empty(0, "u8")
    kind = data[last].astype("i4") + (np.where(size > 1, data[last - 1], 0).astype("i4") << 8)
    each = np.diff(np.searchsorted(starts, at)) + 1
    first = np.cumsum(each) - each
    out, kinds = np.zeros(int(each.sum()), "u8"), np.zeros(int(each.sum()), "i4")
    word = np.ones(len(out), bool)
    word[first + each - 1] = False
    out[word], kinds[word] = h, kind
    return out, kinds, first, each


def distinct(keys: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """An order that sorts ``keys``, where in it each different key begins, and how often it occurs."""
    order = np.argsort(keys)
    keys = keys[order]
    new = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]])) if len(keys) else np.empty(0, "i8")
    return order, new, np.diff(np.append(new, len(keys)))


def begins(*columns: np.ndarray) -> np.ndarray:
    """Where a new value of any of the columns begins."""
    if not len(columns[0]):
        return np.empty(0, "i8")
    return np.flatnonzero(np.concatenate([[True], np.any([c[1:] != c[:-1] for c in columns], axis=0)]))


def key_of(ctx: np.ndarray, d: int) -> np.ndarray:
    """A key of the context as one of ``d`` words."""
    return mix(ctx + np.uint64(int(STEP) * d % 2**64))


def pairs_of(ctx: np.ndarray, word: np.ndarray) -> np.ndarray:
    return mix(ctx ^ mix(word + OTHER))


def past(h: np.ndarray, first: np.ndarray, d: int, end: np.uint64) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """For each position the hash of the ``d`` symbols before it, of the last d - 1 of these, and
    whether its document has so many; ``end`` stands before a document's first symbol."""
    size = np.diff(np.append(first, len(h)))
    p = np.arange(len(h)) - np.repeat(first, size)
    out, shorter, power = np.zeros(len(h), "u8"), np.zeros(len(h), "u8"), 1
    for j in range(1, d + 1):
        g = np.concatenate([np.full(min(j, len(h)), end), h[:-j]])
        shorter, out = out, out + np.where(p == j - 1, end, g) * np.uint64(power)
        power = power * int(BASE) % 2**64
    return out, shorter, p >= d - 1


def packed(*columns: np.ndarray) -> bytes:
    """Columns of numbers below 2^64 as bytes, compressed: the first bytes of all numbers, then the second, and so on."""
    head = np.array([len(c) for c in columns], "<u4").tobytes()
    body = head + b"".join(c.astype("<u8").view("u1").reshape(-1, 8).T.tobytes() for c in columns)
    return np.array([len(body)], "<u4").tobytes() + pa.compress(body, "zstd", asbytes=True)


def unpacked(value: bytes, columns: int) -> list[np.ndarray]:
    body = pa.decompress(value[4:], int(np.frombuffer(value, "<u4", 1)[0]), "zstd", asbytes=True)
    out, at = [], 4 * columns
    for n in np.frombuffer(body, "<u4", columns).astype("i8"):
        out.append(np.ascontiguousarray(np.frombuffer(body, "u1", 8 * n, at).reshape(8, n).T).view("<u8").reshape(-1))
        at += 8 * n
    return out


@dataclass
class Bits:
    """A set of keys that may say yes wrongly: two bits a key, 32 MB at most whatever the input.
    What it lets through is joined to the table it stands for."""

    n: int = 0
    bits: np.ndarray | None = None

    @staticmethod
    def of(keys: DataFrame) -> Bits:
        """Of different ``keys`` of a table that is written; repeated ones only take room."""
        n = keys.count()
        size = CHUNK << min(12, max(0, int(np.ceil(np.log2(max(1, 16 * n) / CHUNK)))))
        if not n:
            return Bits()

        def at(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            held, many = [], 0

            def flush() -> pa.RecordBatch:
                where = np.unique(np.concatenate(Bits.places(np.concatenate(held), size)))
                held.clear()
                chunk, new = np.unique(where // CHUNK, return_index=True)
                ends = pa.array(np.append(new, len(where)) * 2, pa.int32())
                inside = pa.py_buffer((where % CHUNK).astype("<u2").tobytes())
                return pa.RecordBatch.from_arrays([pa.array(chunk), pa.Array.from_buffers(pa.binary(), len(chunk), [None, ends.buffers()[1], inside])], ["chunk", "at"])

            for b in batches:
                held.append(longs(b, 0))
                many += b.num_rows
                if many >= KEYS:
                    yield flush()
                    many = 0
            if many:
                yield flush()

        def fill(table: pa.Table) -> pa.Table:
            one = np.zeros(CHUNK, bool)
            for places in table["at"]:
                one[np.frombuffer(places.as_buffer(), "<u2")] = True
            return pa.table({"chunk": table["chunk"][:1], "bits": pa.array([np.packbits(one).tobytes()], pa.binary())})

        bits = np.zeros(size // 8, "u1")
        for r in keys.mapInArrow(at, "chunk long, at binary").groupBy("chunk").applyInArrow(fill, "chunk long, bits binary").toLocalIterator():
            bits[r.chunk * CHUNK // 8 : (r.chunk + 1) * CHUNK // 8] = np.frombuffer(r.bits, "u1")
        return Bits(n, bits)

    @staticmethod
    def places(keys: np.ndarray, size: int) -> list[np.ndarray]:
        return [((keys >> np.uint64(s)) & np.uint64(size - 1)).astype("i8") for s in (0, 32)]

    def holds(self, keys: np.ndarray) -> np.ndarray:
        out = np.full(len(keys), bool(self.n))
        for x in Bits.places(keys, 8 * len(self.bits)) if self.n else []:
            out &= (self.bits[x >> 3] >> (7 - (x & 7)).astype("u1")) & 1 > 0
        return out


def mapped(df: DataFrame, f: Callable[..., list[pa.Array]], schema: str) -> DataFrame:
    names = [x.split()[0] for x in schema.split(",")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            yield pa.RecordBatch.from_arrays(f(b), names)

    return df.mapInArrow(run, schema)


def longs(b: pa.RecordBatch, k: int) -> np.ndarray:
    return b.column(k).to_numpy(zero_copy_only=False).view("u8")
