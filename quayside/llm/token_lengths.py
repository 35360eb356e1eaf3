"""Exact encodings by a public tokenizer, and the length histogram (operator 7)."""

from __future__ import annotations

import os
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import checkpoint, slices

#: Chunks kept by an encoder, and the longest chunk that is kept.
CACHE_CHUNKS, CACHE_CHARS = 800_000, 40
#: Unicode white space; str.split also splits at the four separators, which the tokenizers do not.
SPACE = re.compile("[\\t-\\r \\x85\\xa0\\u1680\\u2000-\\u200a\\u2028\\u2029\\u202f\\u205f\\u3000]+")
SEPARATORS = "\x1c\x1d\x1e\x1f"


class ChunkEncoder:
    """ids of texts, as little-endian unsigned 32-bit bytes, one white-space chunk at a time.

    For tokenizers like word_bpe_49k: no token spans white space, which is dropped; a run of
    letters is a piece of its own; case does not matter. A text's ids are then its chunks' ids
    in order, and most chunks repeat. New chunks of a run of texts are encoded in one call,
    with the tokenizer's own end mark between them. The store of chunks is emptied when it is
    full, so memory stays bounded whatever the vocabulary.
    """

    def __init__(self, path: str, mark: str = "<|endoftext|>"):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer, self.mark, self.seen = Tokenizer.from_file(path), mark, {}
        self.mark_id = self.tokenizer.token_to_id(mark)
        vocabulary = self.tokenizer.get_vocab()
        self.last = np.zeros(max(vocabulary.values()) + 1, bool)  # ids that end a word
        self.last[[i for t, i in vocabulary.items() if t.endswith("</w>")]] = True

    def _direct(self, text: str) -> bytes:
        return np.array(self.tokenizer.encode(text, add_special_tokens=False).ids, "<u4").tobytes()

    def _chunks(self, text: str | None) -> list[str]:
        if not text:
            return []
        try:  # Latin-1 has no marks to compose, and one lower case for each character
            text.encode("latin-1")
            text = text.lower()
        except UnicodeEncodeError:
            pass
        if any(c in text for c in SEPARATORS):
            return [x for x in SPACE.split(text) if x]
        return text.split()

    def _new(self, missing: set[str]) -> dict[str, bytes]:
        """ids of chunks that are not in store; a letter and one closing stop part there."""
        out, stops, plain = {}, {}, []
        for w in missing:
            if "<|" in w:
                out[w] = self._direct(w)
            elif w[-1] in ".,;:!?" and w[-2:-1].isalpha() and w[-2] < "\u0100":
                stops[w] = w[:-1]
            else:
                plain.append(w)
        known = self.seen
        plain = list({*plain, *(w for w in stops.values() if w not in known), *(w[-1] for w in stops if w[-1] not in known)})
        words = [w for w in plain if w.isalpha() and max(w) < "\u0100"]  # one piece each, so one closing id
        if words:
            ids = np.array(self.tokenizer.encode_batch_fast([" ".join(words)], add_special_tokens=False)[0].ids, "<u4")
            self._cut(words, ids, np.flatnonzero(self.last[ids]) + 1, 0, out)
        others = [w for w in plain if w not in out]
        if others:
            ids = np.array(self.tokenizer.encode(f" {self.mark} ".join(others), add_special_tokens=False).ids, "<u4")
            self._cut(others, ids, np.append(np.flatnonzero(ids == self.mark_id), len(ids)), 1, out)
        for w, stem in stops.items():
            out[w] = (out.get(stem) or known[stem]) + (out.get(w[-1]) or known[w[-1]])
        return out

    @staticmethod
    def _cut(chunks: list[str], ids: np.ndarray, ends: np.ndarray, gap: int, out: dict[str, bytes]) -> None:
        raw, at = ids.tobytes(), 0
        for w, end in zip(chunks, ends.tolist(), strict=True):
            out[w] = raw[4 * at : 4 * end]
            at = end + gap

    def encode_all(self, texts: list[str | None]) -> list[bytes]:
        told = [self._chunks(t) for t in texts]
        got = [list(map(self.seen.get, chunks)) for chunks in told]
        missing = {w for chunks, ids in zip(told, got, strict=True) if None in ids for w, x in zip(chunks, ids, strict=True) if x is None}
        if missing:
            new = self._new(missing)
            for k, ids in enumerate(got):
                if None in ids:
                    got[k] = [new[w] if x is None else x for w, x in zip(told[k], ids, strict=True)]
            if len(self.seen) + len(new) > CACHE_CHUNKS:
                self.seen.clear()
            self.seen.update((w, x) for w, x in new.items() if len(w) <= CACHE_CHARS)
        return [b"".join(ids) for ids in got]


_encoders: dict[str, ChunkEncoder] = {}


def encoder(path: str) -> ChunkEncoder:
    """One encoder for each Python worker, kept across its tasks."""
    if path not in _encoders:
        _encoders[path] = ChunkEncoder(path)
    return _encoders[path]


def encoded_lengths(docs: DataFrame, tokenizer_path: str, text: str = "text", eos: int = 1) -> DataFrame:
    """``length`` of each document: its ids and ``eos`` closing tokens. Null text counts as empty."""

    def lengths(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoder(tokenizer_path)
        for batch in slices(batches):
            ids = enc.encode_all(batch.column(0).to_pylist())
            yield pa.RecordBatch.from_arrays([pa.array([len(x) // 4 + eos for x in ids], pa.int64())], ["length"])

    return docs.select(text).mapInArrow(lengths, "length long")


def length_histogram(lengths: DataFrame, block: int = 1024) -> DataFrame:
    """One row per distinct ``length``, which answers every context limit exactly.

    n_docs; docs_at_least and tokens_at_least (suffix sums of this length and longer);
    docs_up_to and tokens_up_to; total_tokens; truncated_total, the tokens that remain when
    every document is cut at this length; quantile, the share of documents up to it.
    A limit between two lengths L1 < c < L2 keeps tokens_up_to(L1) + c * docs_at_least(L2).

    Sums run inside blocks of ``block`` lengths; one small row per block carries them across
    blocks, so no task sees the whole histogram. Nulls in ``length`` are ignored; an empty
    input gives no rows.
    """
    from pyspark.sql import Window

    # texts are encoded once: the histogram, a row per length, is read twice below
    h = checkpoint(lengths.where("length is not null").groupBy("length").agg(F.count("*").alias("n_docs")))
    h = h.withColumn("n_tokens", F.col("length") * F.col("n_docs")).withColumn("block", F.floor(F.col("length") / block))
    blocks = h.groupBy("block").agg(F.sum("n_docs").alias("bd"), F.sum("n_tokens").alias("bt"))
    before, everything = Window.orderBy("block").rowsBetween(Window.unboundedPreceding, -1), Window.partitionBy()
    blocks = blocks.select(  # a row for every 1,024 lengths: at most max(length) / block of them
        "block",
        F.coalesce(F.sum("bd").over(before), F.lit(0)).alias("bd"),
        F.coalesce(F.sum("bt").over(before), F.lit(0)).alias("bt"),
        F.sum("bd").over(everything).alias("all_docs"),
        F.sum("bt").over(everything).alias("total_tokens"),
    )
    inside = Window.partitionBy("block").orderBy("length").rowsBetween(Window.unboundedPreceding, 0)
    out = (
        h.join(blocks, "block")
        .withColumn("docs_up_to", F.col("bd") + F.sum("n_docs").over(inside))
        .withColumn("tokens_up_to", F.col("bt") + F.sum("n_tokens").over(inside))
    )
    return out.select(
        "length",
        "n_docs",
        (F.col("all_docs") - F.col("docs_up_to") + F.col("n_docs")).alias("docs_at_least"),
        (F.col("total_tokens") - F.col("tokens_up_to") + F.col("n_tokens")).alias("tokens_at_least"),
        "docs_up_to",
        "tokens_up_to",
        "total_tokens",
        (F.col("tokens_up_to") + F.col("length") * (F.col("all_docs") - F.col("docs_up_to"))).alias("truncated_total"),
        (F.col("docs_up_to") / F.col("all_docs")).alias("quantile"),
    )


def answer(histogram: DataFrame, limits: list[int]) -> DataFrame:
    """``context_limit``, ``kept_tokens``, ``cut_docs`` for every stated limit, from the sums of the
    greatest length up to it alone. An empty histogram gives no rows."""
    h = histogram.select("length", "docs_up_to", "tokens_up_to", (F.col("docs_up_to") + F.col("docs_at_least") - F.col("n_docs")).alias("docs"))
    each = F.explode(F.array(*[F.lit(int(x)) for x in limits])).alias("context_limit")
    below = F.col("length") <= F.col("context_limit")
    of = lambda c: F.coalesce(F.max_by(F.when(below, F.col(c)), F.when(below, F.col("length"))), F.lit(0))
    sums = h.select("*", each).groupBy("context_limit").agg(of("docs_up_to").alias("whole"), of("tokens_up_to").alias("tokens"), F.max("docs").alias("docs"))
    cut = F.col("docs") - F.col("whole")
    return sums.select("context_limit", (F.col("tokens") + F.col("context_limit") * cut).alias("kept_tokens"), cut.alias("cut_docs"))


def quantiles(histogram: DataFrame, shares: list[float]) -> DataFrame:
    """``share`` and ``length``: the least length that this share of the documents does not exceed."""
    each = F.explode(F.array(*[F.lit(float(x)) for x in shares])).alias("share")
    return histogram.select("length", "quantile", each).where("quantile >= share").groupBy("share").agg(F.min("length").alias("length"))
