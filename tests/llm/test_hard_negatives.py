"""Hard negatives against all scores of all anchors."""

import math

import numpy as np
import pytest

from quayside.llm import hard_negatives


def plainly(rows):
    first = {}
    for i, x, label in rows:
        if i is not None and label is not None and x is not None and all(v is not None and math.isfinite(v) for v in x):
            first[i] = min(first.get(i, (label, list(x))), (label, list(x)))
    v = {i: ((label + 1) % 10 if i % 7 == 0 else label, [math.floor(256 * t) for t in x]) for i, (label, x) in first.items()}
    out = set()
    for a, (label, q) in v.items():
        if a % 100:
            continue
        score = {c: sum(s * t for s, t in zip(q, x, strict=False)) for c, (_, x) in v.items() if c != a}
        best = sorted((c for c in score if v[c][0] == label), key=lambda c: (-score[c], c))[:5]
        for p in best:
            hard = sorted((c for c in score if v[c][0] != label and 80 * score[p] <= 100 * score[c] <= 100 * score[p]), key=lambda c: (-score[c], c))
            out |= {(a, p, r + 1, c, score[p], score[c]) for r, c in enumerate(hard[:5])}
    return out


def table(n, seed, centres):
    rng = np.random.default_rng(seed)
    x = rng.standard_normal((n, 8)) * 0.3 + (rng.standard_normal((centres, 8))[rng.integers(0, centres, n)] if centres else 0)
    x[n // 3 : n // 2] = x[0]  # many copies of one vector, so many ties
    return [(int(i), [float(v) for v in row], int(rng.integers(0, 10))) for i, row in enumerate(x)]


@pytest.mark.parametrize("centres", [0, 6])
def test_equals_all_scores(spark, centres):
    rows = table(1500, 3 + centres, centres)
    odd = [(2000, None, 1), (2100, [1.0] * 8, None), (None, [1.0] * 8, 1), (2200, [math.nan] * 8, 1), (2300, [math.inf] + [0.0] * 7, 1), (2400, [None] + [0.0] * 7, 1)]
    odd += [(2500, [], 3), (2600, [0.0] * 8, 3), (2700, [1.0, 2.0], 3), (100, [9.0] * 8, 9), rows[100], rows[300], (2800, [1e3] * 8, 2)]
    frame = spark.createDataFrame([(*r, "x") for r in rows + odd], "vec_id long, embedding array<float>, label int, q string")
    near = [(i, None if x is None else [None if v is None else float(np.float32(v)) for v in x], label) for i, x, label in rows + odd]
    for block, many in ((256, 32_768), (4, 200)):
        got = {(r.anchor_id, r.positive_id, r["rank"], r.negative_id, r.positive_score, r.negative_score) for r in hard_negatives.mine(frame, block=block, rows=many).collect()}
        assert got == plainly(near)
    assert got


def test_nothing_to_mine(spark):
    empty = spark.createDataFrame([], "vec_id long, embedding array<float>, label int")
    assert hard_negatives.mine(empty).count() == 0
    assert hard_negatives.mine(spark.createDataFrame([(1, [1.0], 1), (2, [1.0], 2)], empty.schema)).count() == 0
    assert hard_negatives.mine(spark.createDataFrame([(100, [1.0], 1)], empty.schema)).count() == 0


def test_scores_beyond_doubles_are_exact(spark):
    rows = [(100, [1e9, 3.0], 1), (1, [1e9, 1.0], 1), (2, [1e9, 0.999], 2), (3, [1e9, 1.0], 2), (4, [1e9, 1.1], 2)]
    frame = spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int")
    top = 1 << 24
    got = [(r["rank"], r.negative_id, r.negative_score) for r in hard_negatives.mine(frame).orderBy("rank").collect()]
    assert got == [(1, 3, top * top + 768 * 256), (2, 2, top * top + 768 * 255)]


def test_only_overlapping_candidates_are_scored():
    rng = np.random.default_rng(1)
    x = np.repeat(rng.standard_normal((40, 16)) * 100, 50, axis=0) + rng.standard_normal((2000, 16))
    x = np.floor(x)
    part = hard_negatives.Slice(np.arange(2000), np.zeros(2000, "i8"), x, True)
    anchors = x[::20]
    order, above, edge, depth = hard_negatives.spanning_tree(anchors)
    assert sorted(order.tolist()) == list(range(100)) and above[0] == -1 and all(depth[1:] == depth[above[1:]] + 1)
    scored = []

    def ask(k, low, high):
        exact = part.x @ anchors[order[k]]
        assert (low <= exact).all() and (exact <= high).all()
        need = np.flatnonzero(high >= 0.8 * exact.max())
        scored.append(len(need))
        return need

    hard_negatives.walk(part, anchors[order], edge, depth, ask, lambda k, at, score: None)
    assert sum(scored) < 0.5 * 100 * 2000
