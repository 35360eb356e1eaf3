"""Quality scores by Bradley-Terry pairwise ranking (operator 2)."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.functions import arrow_udf

from .common import texts_of
from .suffix_tree import held_out

KINDS = ("letters", "upper", "digits", "space", "high")
_CLASS = np.zeros(256, "i8")
for _name, _bytes in (("letters", range(97, 123)), ("upper", range(65, 91)), ("digits", range(48, 58)), ("space", [32, 9, 10, 11, 12, 13]), ("high", range(128, 256))):
    _CLASS[list(_bytes)] = 1 + KINDS.index(_name)
_PUNCTUATION = [i for i in range(33, 127) if not chr(i).isalnum()]
#: Floor under a share before its logarithm.
FLOOR = 1e-3


def features(text: str | None) -> np.ndarray:
    """Numbers of one whole text; null and empty texts have the same.

    Byte classes and punctuation as log shares; then words: log number, mean length, share of
    distinct ones, of repeats of the word before or of the line before, of words without a
    letter, in capitals, ending or starting in punctuation; and words per line.
    """
    raw = (text or "").encode("utf-8", "surrogatepass")
    n = max(1, len(raw))
    count = np.bincount(np.frombuffer(raw, "u1"), minlength=256)
    kinds = np.bincount(_CLASS, count, 6)[1:]
    w = raw.split()
    m = max(1, len(w))
    lines = raw.split(b"\n")
    top = max(map(len, w), default=0)
    shares = np.concatenate(
        [
            kinds / n,
            count[_PUNCTUATION] / n,
            [
                len(set(w)) / m,
                sum(map(bytes.__eq__, w, w[1:])) / m,
                sum(map(bytes.__eq__, w, w[2:])) / m,
                1 - len(set(lines)) / len(lines),
                sum(1 for x in w if x.isupper()) / m,
                sum(1 for x in w if not x[:1].isalpha() and x[0] < 128) / m,
                sum(1 for x in w if x[-1] < 128 and not x[-1:].isalnum()) / m,
                sum(1 for x in w if len(x) > 1 and not x[-2:].isalnum() and x[-2] < 128) / m,
            ],
        ]
    )
    sizes = np.array([np.log1p(len(w)), len(raw) / m, np.log1p(top), np.log1p(m / len(lines))])
    return np.concatenate([np.log(shares + FLOOR), shares[-8:], sizes])


@dataclass
class Ranker:
    """score = sigmoid of a line through the Bradley-Terry strength; cut: the strength scored ``at``."""

    mean: np.ndarray
    scale: np.ndarray
    weights: np.ndarray
    cut: float
    slope: float
    at: float

    def strength(self, x: np.ndarray) -> np.ndarray:
        return np.clip((x - self.mean) / self.scale, -8, 8) @ self.weights

    def score(self, x: np.ndarray) -> np.ndarray:
        z = self.slope * (self.strength(x) - self.cut) + np.log(self.at / (1 - self.at))
        return 1 / (1 + np.exp(-np.clip(z, -60, 60)))


def _logistic(x: np.ndarray, penalty: float, rounds: int = 25) -> np.ndarray:
    """Weights that minimise log(1 + exp(-x w)): every row is a difference, better minus worse."""
    w = np.zeros(x.shape[1])
    for _ in range(rounds):
        p = 1 / (1 + np.exp(np.clip(x @ w, -40, 40)))
        step = np.linalg.solve((x * (p * (1 - p))[:, None]).T @ x / len(x) + penalty * np.eye(len(w)), x.T @ p / len(x) - penalty * w)
        w += step
        if np.abs(step).max() < 1e-4:
            break
    return w


def fit(x: np.ndarray, good: np.ndarray, at: float, pairs: int = 60_000, penalty: float = 1e-3, seed: int = 7) -> Ranker:
    """Learn from preferences "each good row over each bad row".

    ``pairs`` of them are drawn, every row about equally often. The cut is the score quantile
    at which the fewest labelled rows fall on the wrong side, counting each class alike.
    With one class only, every strength is 0 and every score ``at`` or above.
    """
    mean, scale = (x.mean(0), x.std(0) + 1e-6) if len(x) else (np.zeros(x.shape[1]), np.ones(x.shape[1]))
    up, down = np.flatnonzero(good), np.flatnonzero(~good)
    if not len(up) or not len(down):
        return Ranker(mean, scale, np.zeros_like(mean), 0.0, 1.0, at)
    z, rng = np.clip((x - mean) / scale, -8, 8), np.random.default_rng(seed)
    deal = lambda rows: np.concatenate([rng.permutation(rows) for _ in range(-(-pairs // len(rows)))])[:pairs]
    w = _logistic(z[deal(up)] - z[deal(down)], penalty)
    s = z @ w
    q = np.unique(np.quantile(s, np.linspace(0, 1, 1001)))
    cuts = (q[1:] + q[:-1]) / 2 if len(q) > 1 else q
    wrong = np.searchsorted(np.sort(s[up]), cuts) / len(up) + 1 - np.searchsorted(np.sort(s[down]), cuts) / len(down)
    best = cuts[np.flatnonzero(wrong <= wrong.min() + 1e-12)]
    cut = float(best[len(best) // 2])
    d = s - cut
    slope = float(np.clip(_logistic(np.where(good, d, -d)[:, None], 1e-4)[0], 0.05, 20))
    return Ranker(mean, scale, w, cut, slope, at)


def train(docs: DataFrame, labels: DataFrame, rows: int = 20_000, mod: int = 5, at: float = 0.3, **options) -> Ranker:
    """Fit on at most ``rows`` labelled documents, those first by a hash of the id.

    Rows with crc32(doc_id as text) mod ``mod`` = 0 are never used, nor is any column but the
    text. Labels that are null, not 0 or 1, or that contradict each other for one id are left out;
    a label whose id several documents have counts once, for one of them.
    """
    usable = (
        labels.where("quality in (0, 1) and doc_id is not null")
        .groupBy(F.col("doc_id").cast("long").alias("label_id"))
        .agg(F.min("quality").alias("low"), F.max("quality").alias("high"))
        .where(F.col("low").eqNullSafe(F.col("high")) & ~held_out(F.col("label_id"), mod, 0))
        .orderBy(F.xxhash64("label_id"), "label_id")
        .limit(rows)
        .select("label_id", F.col("low").cast("int").alias("good"))
    )
    found = docs.select(F.col("doc_id").cast("long").alias("label_id"), "text").join(F.broadcast(usable), "label_id")

    def measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if b.num_rows:
                x = [features(t) for t in texts_of(b.column(1))]
                yield pa.RecordBatch.from_arrays([b.column(0), b.column(2), b.column(3), pa.array(x, pa.list_(pa.float64()))], ["label_id", "good", "h", "x"])

    # of an id's documents only the one whose text has the smallest hash comes to the driver
    measured = found.select("label_id", "text", "good", F.xxhash64("text").alias("h")).mapInArrow(measure, "label_id long, good int, h long, x array<double>")
    got = sorted(measured.groupBy("label_id", "good").agg(F.min_by("x", "h").alias("x")).collect(), key=lambda r: r.label_id)
    return fit(np.array([r.x for r in got]) if got else np.empty((0, len(features("")))), np.array([r.good == 1 for r in got], bool), at, **options)


def score(text: Column | str, ranker: Ranker) -> Column:
    """The ranker's score of a text column."""

    def run(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for texts in batches:
            x = np.array([features(t) for t in texts_of(texts)])
            yield pa.array(ranker.score(x) if len(x) else [], pa.float64())

    return arrow_udf(run, "double")(text)


def judge(docs: DataFrame, labels: DataFrame, at: float = 0.3, mod: int = 5, **options) -> DataFrame:
    """doc_id, held_out, score and predicted (1 if score >= ``at``) of every row.

    Null and empty texts are scored alike; a null doc_id is not held out; an empty table of
    documents gives no rows, an empty table of labels scores all rows ``at``.
    """
    ranker = train(docs, labels, mod=mod, at=at, **options)
    out = docs.select(F.col("doc_id").cast("long"), held_out(F.col("doc_id"), mod, 0).alias("held_out"), score("text", ranker).alias("score"))
    return out.withColumn("predicted", (F.col("score") >= at).cast("int"))


def keep_good(docs: DataFrame, labels: DataFrame, at: float = 0.3, **options) -> DataFrame:
    """``docs`` without the rows scored under ``at``; columns as they were."""
    ranker = train(docs, labels, at=at, **options)
    return docs.where(score("text", ranker) >= at)
