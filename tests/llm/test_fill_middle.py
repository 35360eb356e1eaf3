"""Rearranged documents against the same cuts on code points, and the way back."""

import hashlib
import random
import re

import numpy as np
import pytest
from hypothesis import given
from hypothesis import strategies as st
from pyspark.sql import functions as F

from quayside.llm import fill_middle

TOKEN = re.compile(r"[\x20\x09-\x0D]*[^\x20\x09-\x0D]+|[\x20\x09-\x0D]+")


def plainly(doc_id, text, seed=42, rate=50, spm=80):
    text = text or ""
    tokens, said = TOKEN.findall(text), hashlib.sha256(f"{seed}:{'' if doc_id is None else doc_id}".encode()).hexdigest()
    h = [int(said[k : k + 8], 16) for k in (0, 8, 16, 24)]
    n = len(tokens)
    if not text or any(x in text for x in ("<P>", "<S>", "<M>")) or h[2] % 100 >= rate:
        return n, "plain", None, None, text
    a, b = sorted((h[0] % (n + 1), h[1] % (n + 1)))
    p, m, s = "".join(tokens[:a]), "".join(tokens[a:b]), "".join(tokens[b:])
    return (n, "spm", len(p), len(m), f"<S>{s}<P>{p}<M>{m}") if h[3] % 100 < spm else (n, "psm", len(p), len(m), f"<P>{p}<S>{s}<M>{m}")


@given(st.integers(-5, 10**6), st.text(alphabet="aé中😀 \t\n\x0b\x1c\xa0<PSM>", max_size=60), st.sampled_from([50, 100]), st.sampled_from([0, 80]))
def test_cuts_are_those_of_code_points(doc_id, text, rate, spm):
    n, form, a, b, out = fill_middle.rearrange(doc_id, text.encode(), 42, rate, spm)
    assert (n, form, a, b, out.decode()) == plainly(doc_id, text, 42, rate, spm)


@given(st.text(max_size=80))
def test_index_converts_both_ways(text):
    index = fill_middle.Exceptions(np.frombuffer(text.encode(), "u1"))
    chars = np.arange(len(text) + 1)
    cuts = np.array([len(text[:k].encode()) for k in chars])
    assert index.to_bytes(chars).tolist() == cuts.tolist()
    assert index.to_chars(cuts).tolist() == chars.tolist()


def test_whole_tables(spark):
    rng = random.Random(5)
    texts = [None, "", " ", "\n\t ", "a", "é", "one <P> two", "<S>", "x" * 300_000 + " é " + "w " * 200_000, " lead and trail \x0b"]
    texts += ["".join(rng.choice("abé中😀  \n<") for _ in range(rng.randint(1, 200))) for _ in range(300)]
    rows = [(k if k % 9 else None, t, "clash") for k, t in enumerate(texts)] + [(1, "again and again", "x")] * 2
    docs = spark.createDataFrame(rows, "doc_id long, text string, output string")
    out = fill_middle.transform(docs).withColumn("back", fill_middle.restored(F.col("output"), F.col("form"))).collect()
    key = lambda r: tuple(map(str, r))
    got = sorted(((r.doc_id, r.n, r.form, r.prefix_chars, r.middle_chars, r.output, r.back) for r in out), key=key)
    assert got == sorted(((i, *plainly(i, t), t or "") for i, t, _ in rows), key=key)
    assert {r.form for r in out} == {"plain", "spm", "psm"}
    assert fill_middle.transform(docs.limit(0)).count() == 0


def test_marks_that_could_overlap_are_refused(spark):
    with pytest.raises(ValueError):
        fill_middle.transform(spark.createDataFrame([], "doc_id long, text string"), marks=("<<", "<S>", "<M>"))
