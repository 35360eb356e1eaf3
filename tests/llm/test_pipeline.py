"""The pipeline against a plain run of its four stages, with planted copies, leaks and odd rows."""

import collections
import itertools
import math
import zlib

import numpy as np
import pyarrow as pa
import pyarrow.parquet as pq
from test_tables import components, fingerprint
from tokenizers import Tokenizer

import corpus_pipeline
from quayside.llm import quality
from quayside.llm.queries import tokenizer

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars", "place"]


def planted(sf_dir):
    """Rows of ``COLUMNS``, labels and items: half the table's documents, and what a stage must find."""
    docs = [(r["doc_id"], r["text"], r["lang"], r["source"], r["n_chars"], "x") for r in pq.read_table(f"{sf_dir}/documents.parquet").to_pylist() if r["doc_id"] < 100]
    items = [(r["item_id"], r["text"]) for r in pq.read_table(f"{sf_dir}/benchmark.parquet").to_pylist()][:20]
    labels = [(r["doc_id"], r["quality"], r["toxic"]) for r in pq.read_table(f"{sf_dir}/labels.parquet").to_pylist()]
    new = []
    for k, row in enumerate(docs[:24]):
        text = row[1]
        if k % 3 == 0:  # exact copies, two of each, one of them without an id
            new += [(1000 + k, text), (None, text)]
        elif k % 3 == 1:  # one word of many is another
            new.append((1000 + k, f"{text} indeed"))
        else:  # an item inside, with an edit
            said = items[k % len(items)][1]
            new.append((1000 + k, f"{text[: len(text) // 2]} {said[:9]}~{said[10:].upper()} {text[len(text) // 2 :]}"))
    new += [(2000, None), (2001, ""), (2002, " \n"), (None, None), (2003, "word " * 5000)]
    return docs + [(i, t, "en", "hot", 0, None) for i, t in new], labels, [*items, (900, None), (None, "a"), (901, " ")]


def good(rows, labels, at=0.3):
    said = collections.defaultdict(set)
    for i, q, _ in labels:
        if i is not None and q in (0, 1):
            said[i].add(q)
    text = {r[0]: r[1] for r in rows if r[0] is not None}
    use = sorted(i for i, q in said.items() if len(q) == 1 and i in text and zlib.crc32(str(i).encode()) % 5)
    ranker = quality.fit(np.array([quality.features(text[i]) for i in use]), np.array([said[i] == {1} for i in use]), at)
    return [r for r in rows if ranker.score(np.array([quality.features(r[1])]))[0] >= at]


def one_each(rows):
    fps = [fingerprint(r[1]) for r in rows]
    near = [(a, b) for (a, x), (b, y) in itertools.combinations(enumerate(fps), 2) if (x ^ y).bit_count() <= 4]
    groups = collections.defaultdict(list)
    for k, root in components(range(len(rows)), near).items():
        groups[root].append(rows[k])
    return [min(g, key=lambda r: (r[0] is None, r[0] or 0)) for g in groups.values()]


def least_edits(item, text):
    """Least edits of the item to any stretch of the text, a row of the whole table for each character of the item."""
    at = np.arange(len(text) + 1)
    row = np.zeros(len(text) + 1, "i4")
    for p in item:
        new = row + 1
        new[1:] = np.minimum(new[1:], row[:-1] + (text != ord(p)))
        row = np.minimum.accumulate(new - at) + at
    return row.min()


def unleaked(rows, items):
    said = [" ".join((t or "").lower().split()) for i, t in items if i is not None]
    out = []
    for r in rows:
        text = np.array([ord(c) for c in " ".join((r[1] or "").lower().split())], "i4")
        if not any(x and least_edits(x, text) <= int(len(x) * 0.1) for x in said):
            out.append(r)
    return out


def like(rows):
    return collections.Counter((r[0], r[1]) for r in rows)


def test_pipeline_equals_a_plain_run(spark, sf_dir, tmp_path):
    rows, labels, items = planted(sf_dir)
    for name, told, columns in (("documents", rows, COLUMNS), ("labels", labels, ["doc_id", "quality", "toxic"]), ("benchmark", items, ["item_id", "text"])):
        pq.write_table(pa.table({c: [r[k] for r in told] for k, c in enumerate(columns)}), tmp_path / f"{name}.parquet")
    docs, left = spark.read.parquet(f"{tmp_path}/documents.parquet"), rows
    plain = (lambda x: good(x, labels), one_each, lambda x: unleaked(x, items))
    for k, ((name, stage), by_hand) in enumerate(zip(corpus_pipeline.STAGES, plain, strict=False)):
        stage(spark, docs, str(tmp_path)).write.parquet(f"{tmp_path}/stage{k}")
        docs, before = spark.read.parquet(f"{tmp_path}/stage{k}"), left
        left = by_hand(left)
        assert docs.columns == COLUMNS and like(docs.collect()) == like(left), name
        assert len(left) < len(before), name
    packed = corpus_pipeline.run(spark, str(tmp_path)).collect()
    encode = Tokenizer.from_file(tokenizer())
    want = collections.Counter()
    for r in left:
        ids = np.array([*encode.encode(r[1] or "", add_special_tokens=False).ids, 0], "<u4")
        for k, at in enumerate(range(0, len(ids), 2048)):
            want[(r[0], k, at, len(ids[at : at + 2048]), zlib.crc32(ids[at : at + 2048].tobytes()))] += 1
    assert collections.Counter((p.doc_id, p.piece, p.start, p.length, p.ids_crc32) for p in packed) == want
    places = collections.defaultdict(list)
    for p in packed:
        places[p.sequence_id].append((p.offset, p.length))
    for held in places.values():
        held.sort()
        assert [at for at, _ in held] == [0, *itertools.accumulate(n for _, n in held)][:-1] and sum(n for _, n in held) <= 2048
    assert len(places) <= math.ceil(sum(p.length for p in packed) / 2048) + 1
