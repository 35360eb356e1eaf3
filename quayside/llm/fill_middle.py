"""Fill-in-the-middle documents by a sparse index of multibyte characters (operator 13).

Texts are cut as UTF-8 bytes. Only characters of more than one byte are recorded, by their
position and the bytes that they have beyond the first; between them a code point is a byte, so
a cut is converted by one ``searchsorted`` and a subtraction.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import slices

#: Marks of prefix, suffix and middle.
MARKS = ("<P>", "<S>", "<M>")


class Exceptions:
    """Code points and bytes of one text: positions of multibyte characters, and their excess bytes."""

    def __init__(self, data: np.ndarray):
        self.bytes = np.flatnonzero(data >= 0xC0)
        lead = data[self.bytes]
        self.excess = np.concatenate([[0], np.cumsum(1 + (lead >= 0xE0) + (lead >= 0xF0), dtype="i8")])
        self.chars = self.bytes - self.excess[:-1]

    def to_chars(self, cut: np.ndarray) -> np.ndarray:
        """Code points before cuts in bytes, each between two characters."""
        return cut - self.excess[np.searchsorted(self.bytes, cut)]

    def to_bytes(self, cut: np.ndarray) -> np.ndarray:
        """Bytes before cuts in code points."""
        return cut + self.excess[np.searchsorted(self.chars, cut)]


def token_ends(data: np.ndarray) -> np.ndarray:
    """Where the tokens ``[\\x20\\x09-\\x0D]*[^\\x20\\x09-\\x0D]+|[\\x20\\x09-\\x0D]+`` of a text end, in bytes.

    White space is ASCII, so no byte of a longer character is taken for it: a token ends where
    a word does, and the last, word or white space, with the text.
    """
    space = (data == 0x20) | ((data >= 0x09) & (data <= 0x0D))
    ends = np.flatnonzero(~space[:-1] & space[1:]) + 1
    return np.append(ends, len(data)) if len(data) else ends


def draw(doc_id: int | None, seed: int) -> tuple[int, ...]:
    """Four numbers under 2^32 from seed and id; a null id counts as no digits."""
    said = hashlib.sha256(f"{seed}:{'' if doc_id is None else doc_id}".encode()).hexdigest()
    return tuple(int(said[k : k + 8], 16) for k in range(0, 32, 8))


def rearrange(doc_id: int | None, text: bytes, seed: int = 42, rate: int = 50, spm: int = 80, marks: tuple[str, str, str] = MARKS) -> tuple[int, str, int | None, int | None, bytes]:
    """Tokens, form, code points of prefix and middle (null: plain), and the output."""
    data = np.frombuffer(text, "u1")
    ends = token_ends(data)
    n = len(ends)
    h1, h2, h3, h4 = draw(doc_id, seed)
    p, s, m = (x.encode() for x in marks)
    if not n or h3 % 100 >= rate or p in text or s in text or m in text:
        return n, "plain", None, None, text
    starts = np.concatenate([[0], ends])
    a, b = np.sort(starts[[h1 % (n + 1), h2 % (n + 1)]])
    a_chars, b_chars = Exceptions(data).to_chars(np.array([a, b])).tolist()
    prefix, middle, suffix = text[:a], text[a:b], text[b:]
    form = "spm" if h4 % 100 < spm else "psm"
    head = s + suffix + p + prefix if form == "spm" else p + prefix + s + suffix
    return n, form, a_chars, b_chars - a_chars, head + m + middle


def transform(docs: DataFrame, seed: int = 42, rate: int = 50, spm: int = 80, marks: tuple[str, str, str] = MARKS) -> DataFrame:
    """doc_id, n, form, prefix_chars, middle_chars and output of every row of ``docs``.

    ``rate`` of 100 texts are rearranged, ``spm`` of 100 of them with the suffix first. Null and
    empty texts, and those that hold one of ``marks``, are plain. Repeated rows are rearranged
    alike, as the ids decide; other columns of ``docs`` are not read. No row meets another, so
    nothing is shuffled, and a task holds about 4 MB of texts or one longer text.
    """
    if len(set(marks)) < 3 or not all(marks) or any(x[0] in y[1:] for x in marks for y in marks):
        raise ValueError("marks must differ, and none may begin inside another")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kinds = [pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.binary()]
        for batch in slices(batches):
            ids = batch.column(0)
            texts = batch.column(1).cast(pa.binary()).to_pylist()
            made = [rearrange(i, t or b"", seed, rate, spm, marks) for i, t in zip(ids.to_pylist(), texts, strict=True)]
            cols = [pa.array(c, t) for c, t in zip(zip(*made, strict=True), kinds, strict=True)] if made else [pa.array([], t) for t in kinds]
            cols[4] = cols[4].cast(pa.string())
            yield pa.RecordBatch.from_arrays([ids, *cols], ["doc_id", "n", "form", "prefix_chars", "middle_chars", "output"])

    rows = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string"))
    return rows.mapInArrow(run, "doc_id long, n long, form string, prefix_chars long, middle_chars long, output string")


def restored(output: Column, form: Column, marks: tuple[str, str, str] = MARKS) -> Column:
    """The text that an output was made from. Only texts without marks are rearranged, so that
    each mark stands in it once."""
    p, s, m = marks
    body, middle = F.substring_index(output, m, 1), F.substring_index(output, m, -1)
    second = lambda x: F.substring_index(body, x, -1)
    first = lambda x, following: F.substring_index(F.substring_index(body, following, 1), x, -1)
    psm, spm = F.concat(first(p, s), middle, second(s)), F.concat(second(p), middle, first(s, p))
    return F.when(form == "plain", output).when(form == "psm", psm).otherwise(spm)
