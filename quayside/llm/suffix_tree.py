"""Probabilistic suffix tree language model (operator 3).

Its alphabet is the words that occur ``least`` times; a rarer word, known or not, is the symbol
of its last two bytes, and inside that class it has its share by add-one counts. The root
predicts by add-one counts. A node of the tree is a context, the d symbols before a position;
it exists if it occurs ``least`` times. It is kept if what it says of its next symbols diverges
from what the longest kept suffix says, and it lists those next symbols whose evidence is
worth it. A symbol's probability is that of the longest kept context before it, smoothed
towards the shorter ones by absolute discounting.

All floors are absolute counts, so contexts, entries and vocabulary grow with the corpus.
They are distributed tables of 64-bit hashes; only their most frequent rows, a stated number,
are broadcast, and documents are joined to the others. What tasks hand on, n-grams and what
documents ask, is packed: a row for each group of contexts or keys, in which frequent symbols are
small numbers, keys are distances to the one before, and documents are places.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.broadcast import Broadcast
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import slices, written
from .hashing import BASE, STEP, Bits, begins, distinct, hashed_words, key_of, longs, mapped, mix, packed, pairs_of, past, unpacked

#: Hash of the closing token of every document.
END = np.zeros(1, "u8")
#: Different words or n-grams that a task counts before it hands them on, and bytes of a run of texts.
BUFFER, RUN = 1_000_000, 2_000_000
CLASS = np.uint64(0xA0761D6478BD642F)  # sets the symbols of classes apart
#: A context with one in so many of all tokens is dealt to ``SALTS`` groups by its next word.
HOT, SALTS = 2_000, 64
#: Contexts, and keys that documents ask, are dealt in so many groups at least, of which a task hands on a
#: row each, and in more for more than so many tokens a group.
GROUPS, SHARE = 1_024, 500_000
#: Symbols that have a number, the most frequent; others travel as hashes.
NUMBERED = 400_000


@dataclass
class Tree:
    """A trained tree. ``n`` tokens, ``v`` words; ``counts`` (key, n) of every word; ``own`` words that
    are symbols; ``nodes`` (key, n, gain) of every kept context and listed entry.

    The log10 probability of a word is the root's, plus the gain of each kept context before
    it, plus the gain of each of their entries for the word's symbol.
    """

    n: int
    v: int
    counts: DataFrame
    own: Bits
    nodes: DataFrame
    depth: int = 0
    bits: Bits = field(default_factory=Bits)  # of the keys of nodes
    levels: list[tuple[DataFrame, DataFrame]] = field(default_factory=list)  # contexts, entries by length


def held_out(doc_id: Column, mod: int, remainder: int) -> Column:
    """crc32(doc_id as text) mod ``mod`` is ``remainder``; false for a null id."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % mod == remainder, F.lit(False))


def _symbols(h: np.ndarray, kind: np.ndarray, own: Bits) -> np.ndarray:
    """Symbols of words with hashes ``h`` and last bytes ``kind``. A rare word that ``own`` holds
    wrongly is its own symbol, in counting as in scoring."""
    return np.where(own.holds(h), h, mix(kind.astype("u8") + CLASS))


def word_counts(docs: DataFrame) -> DataFrame:
    """``key`` (a word's hash), ``kind`` (its last two bytes), ``n`` over whole texts; each document
    adds one ``END``."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size = [], 0

        def flush() -> pa.RecordBatch:
            h, kind, n = (np.concatenate([x[k] for x in held]) for k in range(3))
            held.clear()
            order, new, _ = distinct(h)
            at, n = order[new], np.add.reduceat(n[order], new)
            return pa.RecordBatch.from_arrays([pa.array(h[at].view("i8")), pa.array(kind[at]), pa.array(n)], ["key", "kind", "n"])

        for batch in slices(batches, RUN):
            h, kind, _, _ = hashed_words(batch.column(0))
            order, new, n = distinct(h)
            held.append((h[order[new]], kind[order[new]], n))
            size += len(new)
            if size >= BUFFER:
                yield flush()
                size = 0
        if held:
            yield flush()

    return docs.select("text").mapInArrow(count, "key long, kind int, n long").groupBy("key").agg(F.max("kind").alias("kind"), F.sum("n").alias("n"))


def symbol_counts(counts: DataFrame, own: Broadcast) -> DataFrame:
    """``sym``, ``n`` tokens and ``w``, those with one more for every word, of ``counts``."""

    def run(b: pa.RecordBatch) -> list[pa.Array]:
        h = longs(b, 0)
        sym = _symbols(h, b.column(1).to_numpy(), own.value)
        return [pa.array(sym.view("i8")), b.column(2)]

    return mapped(counts.select("key", "kind", "n"), run, "sym long,n long").groupBy("sym").agg(F.sum("n").alias("n"), F.sum(F.col("n") + 1).alias("w"))


def _groups(n: int) -> int:
    """A power of two."""
    return max(GROUPS, 1 << min(14, (n // SHARE).bit_length()))


@dataclass
class Numbers:
    """The most frequent symbols, numbered from the most frequent on."""

    keys: np.ndarray  # by number
    order: np.ndarray  # that sorts them
    ordered: np.ndarray  # in order

    @staticmethod
    def of(symbols: DataFrame, most: int = NUMBERED) -> Numbers:
        top = Top.of(symbols.select(F.col("sym").alias("key"), "n"), "n", most)
        keys = top.keys[np.lexsort((top.keys, -top.values))]
        order = np.argsort(keys)
        return Numbers(keys, order, keys[order])

    def find(self, s: np.ndarray, others: np.ndarray) -> np.ndarray:
        """Numbers of symbols; one of ``others`` (sorted) that has none follows with its place there."""
        at = np.searchsorted(others, s).astype("u8") + np.uint64(len(self.keys))
        if len(self.keys):
            near = np.minimum(np.searchsorted(self.ordered, s), len(self.keys) - 1)
            at = np.where(self.ordered[near] == s, self.order[near].astype("u8"), at)
        return at

    def told(self, x: np.ndarray, others: np.ndarray) -> np.ndarray:
        """Symbols of numbers ``x``."""
        out, other, apart = np.empty(len(x), "u8"), x >= np.uint64(len(self.keys)), np.uint64(len(self.keys))
        out[other], out[~other] = others[(x[other] - apart).astype("i8")], self.keys[x[~other].astype("i8")]
        return out

    def without(self, s: np.ndarray) -> np.ndarray:
        """Those of ``s`` that have no number, sorted."""
        s = np.unique(s)
        return s[self.find(s, s) >= np.uint64(len(self.keys))]


def _grams(train: DataFrame, d: int, own: Broadcast, wanted: Broadcast, hot: Broadcast, numbers: Broadcast | None = None, listed: int = 1, groups: int = GROUPS) -> DataFrame:
    """``group``, ``ctx`` (hash of the d symbols before), ``suf`` (of the last d - 1), ``word`` (symbol), ``n``,
    where ``wanted`` may hold the context. All of a context and word lie in one group, and a group in one task.
    What occurs less than ``listed`` times leaves one row with no word for its context and group.

    A task adds up what it counts as long as that fits its buffer, and hands on one row for each group
    of contexts. A hot context's symbols are dealt to several groups, so that they do not meet in one place.
    """
    power = int(BASE) ** (d - 1) % 2**64
    back, power = np.uint64(pow(power, -1, 2**64)), np.uint64(power)  # the context is its suffix and power times its first symbol
    high, none = 65 - groups.bit_length(), Numbers(np.empty(0, "u8"), np.empty(0, "i8"), np.empty(0, "u8"))

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size, end = [], 0, _symbols(END, np.zeros(1, "i4"), own.value)[0]
        known = numbers.value if numbers else none

        def merge() -> None:
            ctx, word, suf, n = (np.concatenate([x[k] for x in held]) for k in range(4))
            order, new, _ = distinct(pairs_of(ctx, word))
            at = order[new]
            held[:] = [(ctx[at], word[at], suf[at], np.add.reduceat(n[order], new) if len(new) else n)]

        def rows() -> pa.RecordBatch:
            ctx, word, suf, n = held.pop()
            salt = np.where(np.isin(ctx, hot.value), word >> np.uint64(58), np.uint64(0))
            deal = mix(ctx + salt)
            words, which = np.unique(word, return_inverse=True)
            others = known.without(words)
            word = known.find(words, others)[which]
            # groups, in these contexts, in these words by their numbers as far as 20 bits tell: one sort
            low = np.uint64((1 << 20) - 1)
            order = np.argsort((deal & ~low) | np.minimum(word, low))
            ctx, word, suf, n, group = ctx[order], word[order], suf[order], n[order], deal[order] >> np.uint64(high)
            new = begins(ctx, group)
            suf, times = suf[new], np.diff(np.append(new, len(ctx)))
            far = (ctx[new] - suf) * back
            first, of, apart = begins(group), [], np.uint64(len(known.keys))
            more, place = others, word >= apart
            others = np.union1d(others, known.without(np.concatenate([far, suf])))
            far, suf = (known.find(x, others) for x in (far, suf))
            word[place] = np.searchsorted(others, more)[(word[place] - apart).astype("i8")].astype("u8") + apart
            each, last = group[first].astype("i4"), np.append(first[1:], len(ctx))
            for lo, hi, a, b in zip(first, last, np.searchsorted(new, first), np.searchsorted(new, last), strict=True):
                x = np.concatenate([far[a:b], suf[a:b], word[lo:hi]])
                other = x >= apart
                mine = np.unique(x[other])  # the symbols without a number of this group alone
                x[other] = np.searchsorted(mine, x[other]).astype("u8") + apart
                of.append(packed(others[(mine - apart).astype("i8")], times[a:b], x[: b - a], x[b - a : 2 * (b - a)], x[2 * (b - a) :], n[lo:hi]))
            return pa.RecordBatch.from_arrays([pa.array(each), pa.array(of, pa.binary())], ["group", "of"])

        for batch in slices(batches, RUN):
            h, kind, first, _ = hashed_words(batch.column(0))
            s = _symbols(h, kind, own.value)
            ctx, suf, ok = past(s, first, d, end)
            use = np.flatnonzero(ok & wanted.value.holds(key_of(ctx, d)))
            order, new, n = distinct(pairs_of(ctx[use], s[use]))
            at = use[order[new]]
            held.append((ctx[at], s[at], suf[at], n))
            size += len(at)
            if size >= BUFFER:
                merge()
                size = len(held[0][0])
                if size >= BUFFER // 2:
                    yield rows()
                    size = 0
        if size:
            merge()
            yield rows()

    def add(table: pa.Table) -> pa.Table:
        known, held = numbers.value if numbers else none, []
        for value in table["of"].to_pylist():
            extra, times, far, suf, word, n = unpacked(value, 6)
            far, suf, word = (known.told(x, extra) for x in (far, suf, word))
            times = times.astype("i8")
            held.append((np.repeat(suf + far * power, times), np.repeat(suf, times), word, n.astype("i8")))
        ctx, suf, word, n = (np.concatenate([x[k] for x in held]) for k in range(4))
        order, new, _ = distinct(pairs_of(ctx, word))
        at, n = order[new], np.add.reduceat(n[order], new) if len(new) else n
        ctx, suf, word = ctx[at], suf[at], word[at]
        rare = np.flatnonzero(n < listed)
        rare = rare[np.argsort(ctx[rare])]
        first = begins(ctx[rare])
        rest, often = rare[first], np.flatnonzero(n >= listed)
        n = np.concatenate([n[often], np.add.reduceat(n[rare], first) if len(first) else n[:0]])
        at, no_word = np.concatenate([often, rest]), np.arange(len(n)) >= len(often)
        cols = [pa.array(x[at].view("i8")) for x in (ctx, suf)]
        group = pa.array(np.full(len(n), table["group"][0].as_py(), "i4"))
        return pa.table([group, *cols, pa.array(word[at].view("i8"), mask=no_word), pa.array(n)], ["group", "ctx", "suf", "word", "n"])

    rows = train.select("text").mapInArrow(count, "group int, of binary")
    return rows.groupBy("group").applyInArrow(add, "group int, ctx long, suf long, word long, n long")


def fit(train: DataFrame, depth: int = 3, least: int = 100, listed: int = 3, worth: float = 3.0, divergence: float = 0.02, mu: float = 10.0) -> Tree:
    """Learn the tree from the texts of ``train``, length after length of context.

    With T occurrences of a context, n of a word after it, and P the word's probability in the
    longest kept suffix, a listed word has (n - 1) / (T + mu) + F P and any other F P, where F
    takes what is left. A word is listed if it occurs ``listed`` times after the context and this
    gains ``worth`` nats on all its occurrences. The context is kept if it then gains
    ``divergence`` nats a token, with each occurrence's own count left out by the n - 1.
    """
    spark = train.sparkSession
    counts = written(word_counts(train), "words")
    n, v = (int(x or 0) for x in counts.agg(F.sum("n"), F.count("*")).first())
    tree = Tree(n, v, counts, Bits.of(counts.where(F.col("n") >= least).select("key")), spark.createDataFrame([], "key long, n long, gain double"))
    own = spark.sparkContext.broadcast(tree.own)
    symbols = written(symbol_counts(counts, own), "symbols")
    first = lambda b: [b.column(0), b.column(1), pa.array(key_of(longs(b, 0), 1).view("i8"))]
    starts = mapped(symbols.where(F.col("n") >= least).select("sym", "n"), first, "ctx long,n long,key long")
    numbers, before = spark.sparkContext.broadcast(Numbers.of(symbols)), None
    for d in range(1, depth + 1):
        starts = written(starts, "starts")
        wanted = Bits.of(starts.select("key"))
        if not wanted.n:
            break
        hot = np.array([r.ctx for r in starts.where(F.col("n") >= max(least, n // HOT)).select("ctx").collect()], "i8").view("u8")
        shared = [spark.sparkContext.broadcast(x) for x in (wanted, hot)]
        grams = written(_grams(train, d, own, *shared, numbers, listed, _groups(n)), "grams")
        often = grams.where("word is not null").select("ctx", "suf", "word", "n")
        if before is None:
            seen = symbols.select(F.col("sym").alias("word"), F.log10(F.col("w") / (n + v + 1)).alias("prior"))
            often = often.join(seen, "word")
        else:
            often = often.join(before, ["suf", "word"])
        rest = grams.where("word is null").select("ctx", "word", "n", F.lit(None).cast("double").alias("prior"))
        # a context's rows meet once, and the one table of a level says of each row all that follows from them
        of, one = Window.partitionBy("ctx"), often.select("ctx", "word", "n", "prior").union(rest)
        one = one.select("*", F.sum("n").over(of).alias("total"), F.sum(F.when(F.col("word").isNotNull(), F.col("n") - 1)).over(of).alias("less")).where(F.col("total") >= least)
        gained = (F.col("n") - 1) / ((F.col("total") - F.col("less") + mu) * F.pow(F.lit(10.0), "prior"))
        one = one.withColumn("pick", F.coalesce(F.col("n") * F.log1p(gained) >= worth, F.lit(False)))
        sums = [F.coalesce(F.sum(F.when(F.col("pick"), x)).over(of), F.lit(0)).alias(k) for k, x in (("own", F.col("n")), ("taken", F.col("n") - 1))]
        one = one.select("ctx", "word", "n", "prior", "total", "pick", *sums, (F.min("word").over(of) == F.col("word")).alias("head"))
        one = one.withColumn("free", F.log10((F.col("total") - F.col("taken") + mu) / (F.col("total") + mu)))
        one = one.withColumn("told", F.when(F.col("pick"), F.log10((F.col("n") - 1) / (F.col("total") + mu) + F.pow(F.lit(10.0), F.col("free") + F.col("prior")))))
        gain = F.coalesce(F.sum(F.col("n") * (F.col("told") - F.col("prior"))).over(of), F.lit(0.0)) + (F.col("total") - F.col("own")) * F.col("free")
        one = one.withColumn("keep", (F.col("own") > 0) & (F.round(gain * float(np.log(10)) / F.col("total"), 9) >= divergence))
        found = written(one.where("word is not null").select("ctx", "word", "n", "prior", "total", "pick", "head", "free", "told", "keep"), "found")
        kept = found.where("keep and head").select("ctx", F.col("total").alias("n"), F.col("free").alias("gain"))
        entries = found.where("keep and pick").select("ctx", "word", "n", (F.col("told") - F.col("prior") - F.col("free")).alias("gain"))
        tree.levels.append((kept, entries))
        eff = F.when(~F.col("keep"), F.col("prior")).when(F.col("pick"), F.col("told")).otherwise(F.col("free") + F.col("prior"))
        before = found.select(F.col("ctx").alias("suf"), "word", eff.alias("prior"))

        def longer(b: pa.RecordBatch, d: int = d) -> list[pa.Array]:
            ctx = longs(b, 1) + BASE * longs(b, 0)
            return [pa.array(ctx.view("i8")), b.column(2), pa.array(key_of(ctx, d + 1).view("i8"))]

        starts = mapped(found.where(F.col("n") >= least).select("ctx", "word", "n"), longer, "ctx long,n long,key long")
    rows = None
    for d, (kept, entries) in enumerate(tree.levels, 1):
        level = kept.select(F.lit(d).alias("d"), "ctx", F.lit(None).cast("long").alias("word"), "n", "gain").union(entries.select(F.lit(d), "ctx", "word", "n", "gain"))
        rows, tree.depth = level if rows is None else rows.union(level), d

    def keyed(b: pa.RecordBatch) -> list[pa.Array]:
        key, entry = mix(longs(b, 1) + STEP * b.column(0).to_numpy().astype("u8")), b.column(2).is_valid().to_numpy(zero_copy_only=False)
        key[entry] = pairs_of(key[entry], b.column(2).drop_null().to_numpy().view("u8"))
        return [pa.array(key.view("i8")), b.column(3), b.column(4)]

    if rows is not None:
        tree.nodes = written(mapped(rows, keyed, "key long,n long,gain double"), "nodes")
    tree.bits = Bits.of(tree.nodes.select("key"))
    return tree


@dataclass
class Top:
    """The most frequent rows of a table by key: those that occur ``floor`` times."""

    floor: int
    keys: np.ndarray
    values: np.ndarray

    @staticmethod
    def of(table: DataFrame, value: str, most: int) -> Top:
        """``most`` rows at most, by the least floor (of 4 to an octave) that leaves no more."""
        step = F.floor(F.log2("n") * 4).cast("int")
        floor, held = 1, 0
        for r in table.groupBy(step.alias("step")).count().orderBy(F.desc("step")).collect():
            held += r["count"]
            if held > most:
                floor = int(np.floor(2 ** ((r.step + 1) / 4))) + 1
                break
        got = table.where(F.col("n") >= floor).select("key", F.col(value).cast("double").alias("value")).toArrow()
        keys = got["key"].to_numpy().view("u8")
        order = np.argsort(keys)
        return Top(floor, keys[order], got["value"].to_numpy()[order])

    def find(self, wanted: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Whether each key is here, and its value (0 if not)."""
        if not len(self.keys):
            return np.zeros(len(wanted), bool), np.zeros(len(wanted))
        order, at = np.argsort(wanted), np.empty(len(wanted), "i8")
        at[order] = np.searchsorted(self.keys, wanted[order])  # in order: near keys are found in near places
        at[at == len(self.keys)] = 0
        here = self.keys[at] == wanted
        return here, np.where(here, self.values[at], 0.0)


def score(docs: DataFrame, tree: Tree, kept: list[str] | None = None, top_words: int = 400_000, top_nodes: int = 1_500_000) -> DataFrame:
    """One row per document: ``kept`` columns, n_tokens, n_known, train_tokens, base_score, score.

    At most ``top_words`` words and ``top_nodes`` nodes, the most frequent, are broadcast. What
    documents ask of the others leaves one packed row for each group of keys and run of documents, which
    meets that group of the tables; a document's own row travels with them, so the texts are read once.
    """
    kept, spark = kept or ["doc_id"], docs.sparkSession
    common, frequent = Top.of(tree.counts, "n", top_words), Top.of(tree.nodes, "gain", top_nodes)
    shared = spark.sparkContext.broadcast((common, frequent, tree.bits, tree.own))
    unit, depth = float(np.log10(tree.n + tree.v + 1)), tree.depth
    groups = _groups(tree.n)
    high = 65 - groups.bit_length()  # a key's group is its bits from here on
    fields = docs.select(*kept).schema
    schema = f"row long, n_tokens long, known long, base double, gain double, {fields.simpleString()[len('struct<') : -1]}"
    names = ["group", "of", "row", "n_tokens", "known", "base", "gain", *kept]

    def parts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        common, frequent, bits, own = shared.value
        end, task, row, held, size = _symbols(END, np.zeros(1, "i4"), own)[0], TaskContext.get().partitionId() << 40, 0, [], 0
        since = 0  # the row from which on places count

        def asked_rows(schema: pa.Schema) -> pa.RecordBatch:
            """One row for each group of keys: the keys, each as what it has more than the one before, which places ask, and how often."""
            key, place, times = (np.concatenate([x[k] for x in held]) for k in range(3))
            held.clear()
            order = np.argsort(key)
            key, place, times = key[order], place[order], times[order]
            group = key >> np.uint64(high)
            first = begins(group)
            more = np.diff(key, prepend=np.zeros(1, "u8"))
            more[first] = key[first]
            of = [packed(more[a:b], place[a:b], times[a:b]) for a, b in zip(first, np.append(first[1:], len(key)), strict=True)]
            blank = [pa.nulls(len(of), schema.field(k).type) for k in range(3, len(names))]
            return pa.RecordBatch.from_arrays([pa.array(group[first].astype("i4")), pa.array(of, pa.binary()), pa.array(np.full(len(of), task + since)), *blank], names)

        for batch in slices(batches, RUN):
            if not batch.num_rows:
                continue
            h, kind, first, tokens = hashed_words(batch.column(0))
            s, doc = _symbols(h, kind, own), np.repeat(np.arange(len(tokens)), tokens)
            order, new, times = distinct(h)
            here, c = np.empty(len(h), bool), np.empty(len(h))
            here[order], c[order] = (np.repeat(x, times) for x in common.find(h[order[new]]))
            base, gain = np.log10(c + 1) - unit, np.zeros(len(h))
            asked, of = [h[~here]], [doc[~here]]
            for d in range(1, depth + 1):
                ctx, _, ok = past(s, first, d, end)
                keys = key_of(ctx, d)
                use = np.flatnonzero(ok & bits.holds(keys))
                keys, at = keys[use], use
                for look in range(2):
                    if look:
                        keys = pairs_of(keys, s[use])
                        maybe = np.flatnonzero(bits.holds(keys))
                        keys, at = keys[maybe], use[maybe]
                    found, value = frequent.find(keys)
                    gain[at] += value
                    asked.append(keys[~found])
                    of.append(doc[at[~found]])
            key, of = np.concatenate(asked), np.concatenate(of)
            order, new, times = distinct(pairs_of(key, of.astype("u8")))
            at = order[new]
            rows = row + np.arange(len(tokens))
            row += len(tokens)
            held.append((key[at], rows[of[at]] - since, times))
            size += len(at)
            cols = [pa.array((rows % groups).astype("i4")), pa.nulls(len(tokens), pa.binary()), pa.array(task + rows), pa.array(tokens)]
            cols += [pa.array(np.add.reduceat(x, first)) for x in ((here & (c > 0)).astype("i8"), base, gain)]
            own_rows = pa.RecordBatch.from_arrays([*cols, *[batch.column(k + 1) for k in range(len(kept))]], names)
            yield own_rows
            if size >= BUFFER:
                yield asked_rows(own_rows.schema)
                size, since = 0, row
        if size:
            yield asked_rows(own_rows.schema)

    def meet(asked: pa.Table, table: pa.Table) -> pa.Table:
        """The documents' own rows, and what the table has for each row that asks."""
        held, own = [], asked.filter(pc.is_null(asked["of"])).drop_columns(["group", "of"])
        keys = table["key"].to_numpy().view("u8")
        order = np.argsort(keys)
        keys, c, more = keys[order], table["c"].to_numpy()[order], table["more"].to_numpy()[order]
        asked = asked.filter(pc.is_valid(asked["of"]))
        for value, row in zip(asked["of"].to_pylist(), asked["row"].to_pylist(), strict=True) if len(keys) else ():
            step, place, times = unpacked(value, 3)
            key = np.cumsum(step)
            at = np.minimum(np.searchsorted(keys, key), len(keys) - 1)
            here = keys[at] == key
            held.append((row + place[here].astype("i8"), at[here], times[here].astype("i8")))
        if not held:
            return own
        row, at, times = (np.concatenate([x[k] for x in held]) for k in range(3))
        order, new, _ = distinct(row)
        told = [np.where(c[at] > 0, times, 0), times * np.log10(c[at] + 1.0), times * more[at]]
        cols = [pa.array(row[order[new]]), pa.nulls(len(new), pa.int64()), *[pa.array(np.add.reduceat(x[order], new) if len(new) else x) for x in told]]
        return pa.concat_tables([own, pa.Table.from_arrays([*cols, *[pa.nulls(len(new), own.schema.field(k).type) for k in kept]], schema=own.schema)])

    rows = docs.select("text", *kept).mapInArrow(parts, f"group int, of binary, {schema}")
    rare = tree.counts.where(F.col("n") < common.floor).select("key", F.col("n").alias("c"), F.lit(0.0).alias("more"))
    if tree.depth:
        rare = rare.union(tree.nodes.where(F.col("n") < frequent.floor).select("key", F.lit(0).cast("long"), "gain"))
    rare = rare.select(F.shiftrightunsigned("key", high).cast("int").alias("group"), "key", "c", "more")
    met = rows.groupBy("group").cogroup(rare.groupBy("group")).applyInArrow(meet, schema)
    per_doc = met.groupBy("row").agg(*[F.max(k).alias(k) for k in (*kept, "n_tokens")], *[F.sum(k).alias(k) for k in ("known", "base", "gain")])
    return per_doc.select(*kept, "n_tokens", F.col("known").alias("n_known"), F.lit(tree.n).cast("long").alias("train_tokens"), F.col("base").alias("base_score"), (F.col("base") + F.col("gain")).alias("score"))


def train_and_score(docs: DataFrame, mod: int = 7, remainder: int = 2, **options) -> DataFrame:
    """Learn from the rows that are not held out and score every row of ``docs``.

    Null text is an empty document (only its END). An empty table gives no rows; repeated
    rows each get one row; a null doc_id is never held out.
    """
    data = docs.select(F.col("doc_id").cast("long"), "text", held_out(F.col("doc_id"), mod, remainder).alias("held_out"))
    return score(data, fit(data.where(~F.col("held_out")), **options), ["doc_id", "held_out"])
