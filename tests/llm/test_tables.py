"""SimHash, components, neighbours, URL rules, licences and the pipeline against brute force."""

import itertools
import random
import re

import duckdb
import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

import corpus_pipeline
from quayside.llm import forest, licenses, queries, simhash, url_rules
from quayside.llm.common import connected_components


def fingerprint(t):
    w = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m.group().lower(), t or ""))
    if not w:
        return 0
    h = [xxhash.xxh64_intdigest(" ".join(w[i : i + 4]).encode(), 42) for i in range(max(1, len(w) - 3))]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def components(nodes, edges):
    up = {n: n for n in nodes}

    def root(a):
        while up[a] != a:
            a = up[a]
        return a

    for a, b in edges:
        a, b = root(a), root(b)
        up[max(a, b)] = min(a, b)
    return {n: root(n) for n in nodes}


@pytest.mark.parametrize("text", [None, "", " \t", "One", "a b c d", "a b c d e A B C d É\x0bx", "w " * 70000])
def test_fingerprint(text):
    assert simhash.fingerprint(text) == fingerprint(text)


def near_texts():
    rng = random.Random(4)
    say = lambda n: [f"w{rng.randint(0, 900)}" for _ in range(n)]
    rows, base = [], say(400)
    for _ in range(260):  # a dense group of near copies
        w = list(base)
        w[rng.randrange(400)] = f"x{rng.randint(0, 99)}"
        rows.append(" ".join(w))
    rows += [" ".join(base)] * 40 + ["short"] * 5 + [None, "", "  "]
    rows += [" ".join(say(rng.randint(1, 40))) for _ in range(300)]
    order = list(range(1, len(rows) + 1))
    rng.shuffle(order)
    return list(zip(order, rows, strict=True))


def test_near_duplicates_lose_no_link(spark):
    rows = near_texts()
    docs = spark.createDataFrame([(i, t, "c") for i, t in rows] + [(None, "short", "c"), (None, "alone here", "c")], "doc_id long, text string, fp string")
    got = simhash.near_duplicates(docs).collect()
    fps = {i: fingerprint(t) for i, t in rows}
    ids = sorted(fps)
    f = np.array([fps[i] for i in ids], "u8")
    edges = [(ids[i], ids[j + i + 1]) for i in range(len(ids)) for j in np.flatnonzero(np.bitwise_count(f[i] ^ f[i + 1 :]) <= 4).tolist()]
    want = components(ids, edges)
    assert {r.doc_id: r.component_id for r in got if r.doc_id is not None} == want
    assert {r.fp % 2**64 for r in got if r.doc_id is not None} == set(fps.values())
    lost = {r.component_id for r in got if r.doc_id is None}
    assert lost == {want[next(i for i, t in rows if t == "short")], None}
    kept = simhash.keep_one(docs)
    assert kept.columns == docs.columns
    assert sorted(r.doc_id or 0 for r in kept.collect()) == sorted([0, *set(want.values())])
    assert simhash.near_duplicates(docs.limit(0)).count() == 0


@pytest.mark.parametrize(("spread", "long_run", "blocks"), [(1, 20_000, None), (6, 20_000, 7), (20, 20_000, None), (6, 100, None), (20, 10, 7), (20, 1, 5)])
def test_dense_cells_connect_like_pairs(spark, spread, long_run, blocks):
    rng = np.random.default_rng(spread)
    base = rng.integers(0, 2**63, dtype="u8")
    f = np.unique(np.array([int(base) ^ sum(1 << int(b) for b in rng.integers(0, 36, rng.integers(0, spread))) for _ in range(700)], "u8"))
    rows = spark.createDataFrame([(int(v.astype("i8")), "c") for v in f], "fp long, node string")
    edges = [(int(f[i]), int(f[j + i + 1])) for i in range(len(f)) for j in np.flatnonzero(np.bitwise_count(f[i] ^ f[i + 1 :]) <= 4).tolist()]
    links = [(r.a % 2**64, r.b % 2**64) for r in simhash.links(rows, blocks=blocks, long_run=long_run).collect()]
    assert all((a ^ b).bit_count() <= 4 for a, b in links)
    nodes = [int(x) for x in f]
    assert components(nodes, links) == components(nodes, edges)


def test_embedding_bounds_the_distance():
    rng = np.random.default_rng(6)
    a, b = rng.integers(0, 2**63, (2, 500), dtype="u8")
    counts = lambda x: np.array([[(int(v) >> 2 * i & 3).bit_count() for i in range(32)] for v in x])
    manhattan = np.abs(counts(a) - counts(b)).sum(1)
    assert (np.bitwise_count(simhash.embedded(a) ^ simhash.embedded(b)) == manhattan).all() and (manhattan <= np.bitwise_count(a ^ b)).all()
    assert [simhash.blocks_for(n) for n in (0, 1000, 50_000, 300_000, 10**7, 10**9)] == [5, 5, 6, 7, 8, 11]


def test_unlike_fingerprints_of_one_cell(spark):
    """100,000 fingerprints that agree in all counts of three blocks, and in little else."""
    rng = np.random.default_rng(3)
    f = np.unique(rng.integers(0, 2**38, 100_000, dtype="u8") << np.uint64(26))
    pairs = f[:300] ^ np.uint64(1 << 40)
    f = np.unique(np.concatenate([f, pairs]))
    rows = spark.createDataFrame([(int(v.astype("i8")),) for v in f], "fp long")
    links = {frozenset((r.a, r.b)) for r in simhash.links(rows, blocks=7, long_run=5_000).collect()}
    ids = {int(v.astype("i8")) for v in f}
    want = [(int((p ^ np.uint64(1 << 40)).astype("i8")), int(p.astype("i8"))) for p in pairs]
    got = components(ids, [tuple(x) for x in links])
    assert all(got[a] == got[b] for a, b in want)


def test_repeated_and_missing_ids_lose_no_group(spark):
    a, b, c = ("one two three four five", "six seven eight nine ten", "and now another text")
    docs = spark.createDataFrame([(5, a, 1), (7, a, 2), (5, b, 3), (2, b, 4), (None, c, 5), (None, c, 6), (None, a, 7), (5, a, 8)], "doc_id long, text string, place int")
    got = {(r.doc_id, r.fp): r.component_id for r in simhash.near_duplicates(docs).collect()}
    fp = lambda t: fingerprint(t) - (1 << 64) * (fingerprint(t) >> 63)
    assert got == {(5, fp(a)): 5, (7, fp(a)): 5, (None, fp(a)): 5, (5, fp(b)): 2, (2, fp(b)): 2, (None, fp(c)): None}
    for most in (0, 100):
        kept = simhash.keep_one(docs, broadcast_rows=most)
        assert kept.columns == docs.columns
        assert sorted((r.doc_id or 0, r.text) for r in kept.collect()) == sorted([(5, a), (2, b), (0, c)])


def test_components(spark):
    rng = random.Random(2)
    edges = [(i, i + 1) for i in range(300)] + [(1000, 1000 + i) for i in range(1, 200)] + [(rng.randint(2000, 2400), rng.randint(2000, 2400)) for _ in range(300)]
    edges += [(5, 5), (7, 6), (7, 6)]
    frame = spark.createDataFrame([*edges, (None, 1), (1, None)], "a long, b long")
    nodes = {x for e in edges if e[0] != e[1] for x in e}
    want = components(nodes, edges)
    assert {r.node: r.root for r in connected_components(frame).collect()} == want
    assert connected_components(frame.limit(0)).count() == 0


def vectors(n=1200, dim=16, seed=1):
    rng = np.random.default_rng(seed)
    x = rng.standard_normal((n, dim)).astype("f4") * rng.uniform(0.5, 2, (n, 1)).astype("f4")
    x[100:400] = x[0]
    return x


def test_neighbours_recall_and_ties(spark):
    x = vectors()
    rows = [(i, v.tolist(), "c") for i, v in enumerate(x)] + [(2000, None, "c"), (2020, [0.0] * 16, "c"), (2040, [float("nan")] * 16, "c"), (2060, [None] * 16, "c"), (2080, [1.0], "c"), (None, x[1].tolist(), "c")]
    frame = spark.createDataFrame(rows, "vec_id long, embedding array<float>, node string")
    for size in (8192, 300):
        got = {}
        for r in forest.neighbours(frame, shard=size, asks=size).collect():
            got.setdefault(r.query_id, []).append((r["rank"], r.vec_id, r.score))
        assert sorted(got) == list(range(0, 1200, 20))
        found, x8 = 0, x.astype("f8")
        for q, hits in got.items():
            hits.sort()
            s = x8 @ x8[q]
            s[q] = -np.inf
            assert [h[0] for h in hits] == list(range(1, 21)) and q not in [h[1] for h in hits]
            assert all(h[2] == pytest.approx(s[h[1]]) for h in hits)
            assert hits == sorted(hits, key=lambda h: (-h[2], h[1]))
            found += len({h[1] for h in hits} & set(np.lexsort((np.arange(len(s)), -s))[:20].tolist()))
        assert found >= 0.9 * 20 * len(got)


def test_an_ascent_ends_by_its_own_results(spark):
    """On clustered vectors a query scores few points and still finds its nearest."""
    rng = np.random.default_rng(3)
    flat = rng.standard_normal((4000, 32))
    near = rng.standard_normal((40, 32))[rng.integers(0, 40, 4000)] + 0.2 * rng.standard_normal((4000, 32))
    share = {}
    for name, x in (("flat", flat), ("near", near)):
        asks = np.arange(0, 4000, 50)
        nodes = spark.createDataFrame([(k, int(k % 50 == 0), x[k].tolist()) for k in range(4000)], "node long, asks int, embedding array<double>")
        got = forest.candidates(nodes, 21, 64, 0.5, 4, 5000, 5000, 11).toPandas()
        share[name] = got.groupby("query").met.first().mean() / 4000
        score = x[asks] @ x.T
        hits = sum(len(set(np.argsort(-score[i], kind="stable")[:21].tolist()) & set(got[got["query"] == q].node)) for i, q in enumerate(asks))
        assert hits >= 0.9 * 21 * len(asks)
    assert share["near"] < 0.75 * share["flat"]


def test_longest_matches_and_ranges():
    rng = np.random.default_rng(5)
    keys, code = np.sort(rng.integers(0, 1 << 32, 300)), rng.integers(0, 1 << 32, 50)
    code[:3] = keys[[0, 7, 299]]
    shared = lambda a, b: 32 - int(a ^ b).bit_length()
    longest = forest.descend(keys, code)
    assert longest.tolist() == [max(shared(a, c) for a in keys.tolist()) for c in code.tolist()]
    for level in (0, 3, 9):
        lo, hi = forest._ranges(keys, code, np.full(50, level))
        assert [sorted(keys[a:b].tolist()) for a, b in zip(lo, hi, strict=True)] == [[a for a in keys.tolist() if shared(a, c) >= level] for c in code.tolist()]


def test_neighbours_of_few(spark):
    few = spark.createDataFrame([(0, [1.0, 0.0]), (1, [1.0, 0.0]), (40, [0.0, 1.0])], "vec_id long, embedding array<float>")
    got = sorted((r.query_id, r["rank"], r.vec_id) for r in forest.neighbours(few).collect())
    assert got == [(0, 1, 1), (0, 2, 40), (40, 1, 0), (40, 2, 1)]
    assert forest.neighbours(few.limit(0)).count() == 0


def brute_rule(url):
    host = path = ""
    if url and "://" in url:
        rest = url.split("://", 1)[1]
        host = re.sub("[A-Z]", lambda m: m.group().lower(), re.match(r"[^/?#]*", rest).group())
        path = re.match(r"[^?#]*", rest[len(host) :]).group()
    fits = [r for r in url_rules.RULES if (host == r.split("/")[0] or host.endswith("." + r.split("/")[0])) and path.startswith(r[r.index("/") :])]
    return host, path, max(fits, key=len, default=None)


def test_url_rules(spark):
    urls = [None, "", "nothing", "http://", "http://A.NET/x", "http://net", "http://xnet/", "https://a.example.net/en/1?q", "https://EXAMPLE.net/en", "x://example.com/de/#f", "http://example.com/dex", "http://w.org/fr/a://b", "http://a.org?x=/fr/", "://a.net/", "http://é.net/Ö\n/x"]
    rows = [(i, u, "c") for i, u in enumerate(urls)] + [(0, None, "c"), (None, "http://a.net/", "c")]
    got = url_rules.judge(spark.createDataFrame(rows, "page_id long, url string, host string")).collect()
    assert len(got) == len(rows)
    for r in got:
        host, path, rule = brute_rule("http://a.net/" if r.page_id is None else urls[r.page_id])
        assert (r.host, r.path, r.rule) == (host, path, rule)
        assert r.verdict == (url_rules.RULES[rule] if rule else r.verdict) and r.verdict in ("allow", "block")
    assert url_rules.judge(spark.createDataFrame([], "page_id long, url string")).count() == 0


def tokens_of(url):
    host, path, _ = brute_rule(url)
    words = [re.sub("^[0-9]+$", "#", w) for w in re.split("[/._-]", path)]
    return {f"h:{x}" for x in host.split(".") if x} | {f"p:{w}" for w in words if w}


def mined_by_hand(labelled, support, confidence, lift):
    """Every rule of every set of tokens that a labelled page holds."""
    n = len(labelled)
    sets = {frozenset(c) for t, _ in labelled for k in range(1, len(t) + 1) for c in itertools.combinations(sorted(t), k)}
    rules = {}
    for s in sets:
        held = [v for t, v in labelled if s <= t]
        for verdict in ("verdict=block", "verdict=allow"):
            both = held.count(verdict)
            if both >= support * n - 1e-9 and both >= confidence * len(held):
                rules[s, verdict] = (both / len(held), both / n, both / len(held) * n / sum(v == verdict for _, v in labelled))
    part_as_good = lambda s, v, c: any((s - {x}, v) in rules and rules[s - {x}, v][0] >= c for x in s)
    return {k: x for k, x in rules.items() if x[2] >= lift and not part_as_good(*k, x[0])}


def test_mined_rules_equal_brute_force(spark):
    rng = random.Random(6)
    hosts = [f"{a}.{b}.example.{c}" for a in ("m", "www") for b in ("fine", "spam", "mixed") for c in ("com", "org")]
    urls = [f"http://{rng.choice(hosts)}/{rng.choice(['en', 'it', 'es'])}/{i}{rng.choice(['', '/', '.html', '?x=1'])}" for i in range(400)] + ["http://a.net/x", None, "x"]
    labels = [(i, int("spam" in u and "/it/" in u or rng.random() < 0.05)) for i, u in enumerate(urls[:400]) if rng.random() < 0.6] + [(1, 1), (1, 0), (None, 1), (2, None)]
    pages = spark.createDataFrame([(i, u, "c") for i, u in enumerate(urls)], "page_id long, url string, label string")
    frame = spark.createDataFrame(labels, "doc_id long, toxic int")
    toxic = {}
    for d, x in labels:
        if d is not None and x is not None:
            toxic[d] = max(toxic.get(d, 0), x)
    labelled = [(tokens_of(u), f"verdict={url_rules.RULES[brute_rule(u)[2]]}") for u in urls if brute_rule(u)[2]]
    labelled += [(tokens_of(u), "verdict=block" if toxic[i] else "verdict=allow") for i, u in enumerate(urls) if i in toxic and not brute_rule(u)[2]]
    for support, confidence, lift, least in ((0.02, 0.6, 1.05, 1), (0.005, 0.9, 1.02, 4), (0.005, 0.8, 1.0, 12)):
        want = mined_by_hand(labelled, max(support, least / len(labelled)), confidence, lift)
        mined = spark.createDataFrame([(sorted(t), v) for t, v in labelled] + [(["h:com"], None)], "tokens array<string>, label string")
        got = {(frozenset(r.antecedent), r.label): (r.confidence, r.support, r.lift) for r in url_rules.mine(mined, support, confidence, lift, least).collect()}
        assert got.keys() == want.keys() and want and all(got[k] == pytest.approx(want[k]) for k in want)
        decided = 0
        for r in url_rules.judge(pages, frame, support=support, confidence=confidence, lift=lift, least=least).collect():
            if r.rule:
                continue
            fits = [(*x[:2], k[1] == "verdict=block", k[1]) for k, x in want.items() if k[0] <= tokens_of(urls[r.page_id])]
            best = max(fits, default=None)
            assert r.verdict == (best[3][8:] if best else "allow") and (r.mined_tokens is not None) == bool(best)
            decided += bool(best)
        assert decided > 20
    assert url_rules.mine(mined.limit(0)).count() == 0


MIT_LINE, GPL_LINE = licenses.NAMED["MIT"][0], licenses.NAMED["GPL-3.0"][0]


def test_licences_and_folders(spark):
    files = [
        ("a/b/LICENSE", MIT_LINE), ("a/b/c/x.py", "code\nmore"), ("a/b/y.py", "# Licensed under the Apache License, Version 2.0.\ncode\ncode"),
        ("a/z.py", None), ("q.py", ""), ("a/b/c/d/COPYING", GPL_LINE.upper() + "\n\n"), ("a/b/c/d/e/f.py", "x " * 20000), (None, MIT_LINE), ("mit.txt", "mit mit the the under license of mine"),
        ("t/long.txt", "licence " * 200_000), ("t/gaps", "\n\n \n--\n\n"), ("t/blank", MIT_LINE + "\n" * 60_000 + "-\n" * 60_000 + "x"),
    ]
    frame = spark.createDataFrame([(i, p, t, "c") for i, (p, t) in enumerate(files)], "file_id long, path string, text string, row string")
    got = {r.file_id: (r.own_license, r.licence_file, r.license, r.licensed_by) for r in licenses.scan(frame).collect()}
    assert len(got) == len(files)
    assert got[0] == ("MIT", True, "MIT", None)
    assert got[1] == (None, False, "MIT", "a/b")
    assert got[2] == ("Apache-2.0", False, "Apache-2.0", None)
    assert got[3] == got[4] == got[9] == got[10] == (None, False, None, None)
    assert got[5] == ("GPL-3.0", True, "GPL-3.0", None) and got[6] == (None, False, "GPL-3.0", "a/b/c/d")
    assert got[7] == ("MIT", True, "MIT", None) and got[8][0] is None and got[11] == ("MIT", False, "MIT", None)
    assert licenses.scan(frame.limit(0)).count() == 0


def commented(mark, text, width=12):
    w = text.split()
    return "\n".join(f"{mark} {' '.join(w[i : i + width])}" for i in range(0, len(w), width))


def test_real_licence_files_and_headers(spark):
    whole = licenses.WHOLE
    mit = "MIT License\n\nCopyright (c) 2021 Some One\n\n" + "\n\n".join(commented("", t) for t in whole["MIT"][1:]) + "\n"
    bsd = {k: "Copyright 2019, Some One\nAll rights reserved.\n\n" + "\n\n".join(commented("", t) for t in whole[k][1:]) for k in ("BSD-3-Clause", "BSD-2-Clause")}
    apache = "\n                                 Apache License\n                           Version 2.0, January 2004\n                        http://www.apache.org/licenses/\n\n   TERMS AND CONDITIONS FOR USE, REPRODUCTION, AND DISTRIBUTION\n\n" + "   1. Definitions and other terms.\n\n" * 150
    gpl = "                    GNU GENERAL PUBLIC LICENSE\n                       Version 3, 29 June 2007\n\n Copyright (C) 2007 Free Software Foundation, Inc.\n\n" + "  Everyone is permitted to copy.\n\n" * 200
    gnu = licenses.GNU
    files = [
        ("m/LICENSE", mit, "MIT", True), ("b/LICENSE.txt", bsd["BSD-3-Clause"], "BSD-3-Clause", True), ("c/LICENCE", bsd["BSD-2-Clause"], "BSD-2-Clause", True),
        ("d/LICENSE", apache, "Apache-2.0", True), ("e/COPYING", gpl, "GPL-3.0", True), ("e/a.c", "// SPDX-License-Identifier: MIT\nint x;\nint y;\n", "MIT", False),
        ("f/a.c", "/* SPDX-License-Identifier: GPL-2.0-or-later */\nint x;\nint y;\n", "GPL-2.0", False), ("f/b.py", "# Copyright 2020\n#\n" + commented("#", licenses.PARTS["Apache-2.0"][1]) + "\n\nimport os\n" * 30, "Apache-2.0", False),
        ("g/x.c", commented(" *", gnu.format("", "2")) + "\n *\n" + "int x;\n" * 40, "GPL-2.0", False), ("g/y.c", commented(" *", gnu.format("Lesser", "3")) + "\n\n" + "int x;\n" * 40, "LGPL-3.0", False),
        ("h/prose.txt", "The MIT License is one of many that the public domain and software licenses debate is about, under the terms of its authors.\nMore.", None, False),
        ("m/src/z.c", "int z;", None, False), ("g/README", "Apache License, Version 2.0\nmore\nwords\nhere", "Apache-2.0", False),
    ]
    got = {r.path: r for r in licenses.scan(spark.createDataFrame([(i, p, t) for i, (p, t, _, _) in enumerate(files)], "file_id long, path string, text string")).collect()}
    assert {p: (got[p].own_license, got[p].licence_file) for p in got} == {p: (k, f) for p, _, k, f in files}
    assert got["m/src/z.c"].license == "MIT" and got["m/src/z.c"].licensed_by == "m"


@pytest.mark.parametrize("name", sorted(queries.oracle_sql()))
def test_sql(spark, sf_dir, name):
    from test_queries import ordered

    con = duckdb.connect()
    for t in ("documents", "pages", "embeddings"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf_dir}/{t}.parquet'")
    frame = queries.queries()[name](spark, sf_dir)
    told = con.execute(queries.oracle_sql()[name])
    names = [d[0] for d in told.description]
    assert sorted(names) == sorted(frame.columns)
    assert ordered(frame.select(names).collect()) == ordered(told.fetchall())


def test_pipeline_stages(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    rows, columns = docs.count(), docs.columns
    for k, (_, stage) in enumerate(corpus_pipeline.STAGES[:-1]):
        out = stage(spark, docs, sf_dir)
        assert out.columns == columns
        left = out.count()
        assert 0.6 * rows <= left <= rows, k
        docs, rows = out, left
    packed = corpus_pipeline.run(spark, sf_dir)
    assert packed.select("doc_id").distinct().count() == docs.select("doc_id").distinct().count()
    assert packed.groupBy("sequence_id").agg(F.sum("length").alias("n")).where("n > 2048").count() == 0
    none = spark.read.parquet(f"{sf_dir}/documents.parquet").limit(0)
    for _, stage in corpus_pipeline.STAGES:
        assert stage(spark, none, sf_dir).count() == 0
