"""Extraction, quality, suffix tree, decontamination, lengths and packing against brute force."""

import collections
import math
import random
import re
import time
import zlib

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from quayside.llm import decontaminate, html_text, packing, quality, suffix_tree, token_lengths
from quayside.llm.hashing import Bits, packed, unpacked
from quayside.llm.queries import tokenizer

ODD = [None, "", "  \n\t ", "one", "ça été — naïve ½²", "a\x1cb\x85c\xa0d", "x" * 5000, "word " * 3000]


def words(t):
    return re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m.group().lower(), t or ""))


@pytest.mark.parametrize(("html", "text"), [
    (None, ""), ("", ""), ("no markup", "no markup"), ("<p>a&amp;b&nbsp;c<br>d", "a&b c d"),
    ("<body><nav><a>m</a></nav><article><h1>T</h1><p>A <b>lo</b>ng paragraph, with  words.</p><p>x</p><div class='ad'>buy</div><ul><li>1<li>2</ul></article><footer>f</footer>", "T A long paragraph, with words. x 1 2"),
    ("<div id=c><p>Some long text that is the page's own, many words.</p><p>More of that text follows here, as long.</p></div><div class='side sidebar'><p>zz</p></div><div class='cookie-notice'>cookies</div><section id=comments><p>I do not agree with any of this at all, it is wrong.</p></section>", "Some long text that is the page's own, many words. More of that text follows here, as long."),
    ("<main><article><p>The story, told at length and in full here.</p></article><article class='comment'><p>A reader's long reply to that story, even longer than it.</p></article></main>", "The story, told at length and in full here."),
    ("<article><p>kept</p><script>if (a</b) {'</p>'}</script><style>p{}</style><form>name <input></form></article><![bad", "kept"),
    ("<div class='page with-sidebar'><div class='widget'><article><p>Inside a widget, yet the page's article.</p></article></div><section class='comments'><article><p>An opinion on it, much longer than the article is itself.</p></article></section></div>", "Inside a widget, yet the page's article."),
    ("<p>one<p>two<table><tr><td>a<td>b</table>", "one two a b"),
    ("<p>a</p><![foo[x]]><p>rest", "a rest"), ("<p>a</p><![bad thing><p>rest</p>", "a rest"), ("<p>a</p><![<p>b</p><p>rest</p>", "a b rest"),
    ("<![if !x]><article><p>first</p><![endif]--><![foo[y]]><p>last</p></article>", "first last"),
])
def test_main_text(html, text):
    assert html_text.main_text(html) == text


BODY = "<p>Some long text that is the page's own, many words of it.</p><p>More of that text follows here, just as long as before.</p>"
SAID = "Some long text that is the page's own, many words of it. More of that text follows here, just as long as before."


@pytest.mark.parametrize(("html", "text"), [
    (f'<div class="layout sidebar-right">{BODY}</div>', SAID), (f'<div id="content" class="print widget">{BODY}</div>', SAID),
    (f'<div class="page-header-fixed">{BODY}</div>', SAID), (f"<form action=x>{BODY}<input></form>", SAID),
    (f'<div id=page class="comments-open"><article>{BODY}</article></div>', SAID), (f'<article><div class="print widget">{BODY}</div></article>', SAID),
    (f"<main><article>{BODY}</article><article><h2>B</h2>{BODY}</article></main>", f"{SAID} B {SAID}"),
    (f"<article><header><h1>Title</h1><p>by A.</p></header>{BODY}</article>", f"Title {SAID}"), (f"<header><h1>Site</h1></header><article>{BODY}</article>", SAID),
    (f'<article>{BODY}<p style="display: none">no</p><div class="share">tweet</div></article>', SAID),
    (f"<div class=related><article><p>An other story, teaser.</p></article></div><article>{BODY}</article>", SAID),
    (f"<ul><li><a href=x>Home</a><li><a>News</a><li><a>About</a></ul><div><h1>T</h1>{BODY}</div>", f"T {SAID}"),
    (f"<div><article><p>A teaser.</p></article></div><div class=c>{BODY * 5}</div>", " ".join([SAID] * 5)),
    ("<nav>a b c</nav><footer>x</footer>", ""), ("<body><div class='share'>only this</div></body>", "only this"),
])
def test_names_do_not_drop_the_text(html, text):
    assert html_text.main_text(html) == text


@pytest.mark.parametrize("markup", ["<div>", "<div>x</span>", "<b>", "<i><div>x</div></b>", "<p><a>", "</div>", "<ul><li>x"])
def test_deep_and_stray_markup_takes_linear_time(markup):
    began = time.perf_counter()
    assert SAID in html_text.main_text(markup * 20_000 + BODY)
    assert time.perf_counter() - began < 5


def test_extract_every_row(spark):
    pages = spark.createDataFrame([(1, "u", "<p>a</p>", "clash"), (1, "u", "<p>a</p>", "clash"), (None, None, None, None)], "page_id long, url string, html string, text string")
    got = html_text.extract(pages)
    assert got.columns == ["page_id", "url", "text", "n_chars"]
    assert sorted(map(str, got.collect())) == sorted(map(str, [*[type(got.first())(page_id=1, url="u", text="a", n_chars=1)] * 2, type(got.first())(page_id=None, url=None, text="", n_chars=0)]))
    assert html_text.extract(pages.limit(0)).count() == 0


def labelled(spark, n=240):
    rng = random.Random(3)
    rows = []
    for i in range(n):
        good = i % 4 != 0
        w = ["".join(rng.choice("abcdefgh") for _ in range(rng.randint(2, 8))) for _ in range(60)]
        rows.append((i, " ".join(w) + "." if good else " ".join(x.upper() + "!!" for x in w), int(good)))
    return spark.createDataFrame([(i, t) for i, t, _ in rows], "doc_id long, text string"), spark.createDataFrame([(i, q, 0) for i, _, q in rows], "doc_id long, quality int, toxic int")


def test_quality_separates_and_holds_out(spark):
    docs, labels = labelled(spark)
    got = quality.judge(docs, labels).join(labels, "doc_id").collect()
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 5 == 0) for r in got)
    out = [r for r in got if r.held_out]
    assert sum(r.predicted == r.quality for r in out) >= 0.95 * len(out)
    assert all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.3) for r in got)
    # labels of held-out rows change nothing
    flipped = labels.withColumn("quality", F.when(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 5 == 0, 1 - F.col("quality")).otherwise(F.col("quality")))
    assert {r.doc_id: r.score for r in quality.judge(docs, flipped).collect()} == {r.doc_id: r.score for r in got}


def test_ranking_fit_minimises_the_pair_loss():
    """All pairs of a small set: the fit's loss is a minimum, by finite differences and against descent."""
    rng = np.random.default_rng(1)
    good = np.arange(40) % 3 > 0
    x = rng.standard_normal((40, 3)) + good[:, None] * np.array([1.0, -0.5, 0.0])
    d = (x[good][:, None] - x[~good][None]).reshape(-1, 3)
    loss = lambda w: np.log1p(np.exp(-d @ w)).mean() + 0.5e-2 * (w @ w)
    w = quality._logistic(d, 1e-2)
    assert all(loss(w) <= loss(w + e) for e in np.concatenate([np.eye(3), -np.eye(3)]) * 1e-2)
    at = np.zeros(3)
    for _ in range(4000):
        at -= 0.5 * (-(d / (1 + np.exp(d @ at))[:, None]).mean(0) + 1e-2 * at)
    assert w == pytest.approx(at, abs=1e-3)
    ranker = quality.fit(x, good, 0.3)
    order = ranker.score(x)
    assert (order[good][:, None] > order[~good][None]).mean() > 0.8
    # the cut has the fewest errors of all cuts, each class counted alike
    wrong = lambda c: (order[good] < c).mean() + (order[~good] >= c).mean()
    assert wrong(0.3) <= min(wrong(c) for c in order) + 1e-9


def test_repeated_labelled_ids_count_once(spark):
    docs, labels = labelled(spark, 120)
    again = docs.union(docs.where("doc_id = 1").crossJoin(spark.range(500)).select("doc_id", "text"))
    assert {r.doc_id: r.score for r in quality.judge(again, labels).collect()} == {r.doc_id: r.score for r in quality.judge(docs, labels).collect()}


def test_quality_odd_rows(spark):
    docs, labels = labelled(spark, 80)
    odd = spark.createDataFrame([(1000 + i if i else None, t, "c") for i, t in enumerate(ODD)], "doc_id long, text string, score string")
    got = quality.judge(odd, labels.union(spark.createDataFrame([(1, None, 0), (None, 1, 0), (2, 7, 0), (4, 1, 0)], labels.schema))).collect()
    assert len(got) == len(ODD) and all(0 <= r.score <= 1 for r in got)
    assert got[1].score == got[0].score
    assert all(r.score == pytest.approx(0.3) and r.predicted == 1 for r in quality.judge(odd, labels.limit(0)).collect())
    assert quality.judge(odd.limit(0), labels).count() == 0
    assert quality.keep_good(docs.withColumn("score", F.lit(1)), labels).columns == ["doc_id", "text", "score"]


def corpus(spark, n=150):
    rng = random.Random(5)
    a, b = ["der", "und", "die", "haus", "weg"], ["the", "and", "of", "road", "house"]
    rows = [(i, " ".join(rng.choice(b if i % 2 else a) if rng.random() < 0.9 else f"W{rng.randint(0, 400)}x" for _ in range(rng.randint(1, 60)))) for i in range(n)]
    return rows + [(n + i, t) for i, t in enumerate(ODD)]


def test_suffix_tree_counts_are_exact(spark):
    rows = corpus(spark)
    docs = spark.createDataFrame([(i, t, "x") for i, t in rows], "doc_id long, text string, score string")
    got = {r.doc_id: r for r in suffix_tree.train_and_score(docs, least=20).collect()}
    told = {i: [*words(t), None] for i, t in rows}
    held = {i: zlib.crc32(str(i).encode()) % 7 == 2 for i in told}
    c = collections.Counter(w for i in told if not held[i] for w in told[i])
    n, v = sum(c.values()), len(c)
    assert len(got) == len(rows)
    for i, w in told.items():
        r = got[i]
        assert (r.held_out, r.n_tokens, r.n_known, r.train_tokens) == (held[i], len(w), sum(c[x] > 0 for x in w), n)
        assert r.base_score == pytest.approx(sum(math.log10((c[x] + 1) / (n + v + 1)) for x in w))
    out = [i for i in told if held[i] and len(told[i]) > 10]
    assert sum(got[i].score for i in out) > sum(got[i].base_score for i in out)


def brute_tree(train, depth, least, listed, worth, divergence, mu):
    """The tree by dictionaries, as ``fit`` defines it; a function from words to their log10 probability."""
    told = [[*(w.encode() for w in words(t)), b""] for t in train]
    c = collections.Counter(w for t in told for w in t)
    unit = sum(c.values()) + len(c) + 1
    sym = lambda w: w if c[w] >= least else int.from_bytes(w[-2:], "big")
    root = collections.Counter()
    for w, n in c.items():
        root[sym(w)] += (n + 1) / unit
    before = lambda s, p, d: tuple(([sym(b""), *s[:p]] if p < d else s[p - d : p])[-d:]) if p >= d - 1 else None
    kept, rows = {}, [[sym(w) for w in t] for t in told]
    for d in range(1, depth + 1):
        after = collections.defaultdict(collections.Counter)
        for s in rows:
            for p, x in enumerate(s):
                after[before(s, p, d)][x] += 1
        after.pop(None, None)
        shorter = dict(kept)

        def prior(ctx, x, shorter=shorter):
            out = math.log10(root[x])
            for k in range(1, len(ctx) + 1):
                if ctx[-k:] in shorter:
                    free, logp = shorter[ctx[-k:]]
                    out = logp.get(x, free + out)
            return out

        for ctx, n in after.items():
            t = sum(n.values())
            if t < least:
                continue
            often = {x: k for x, k in n.items() if k >= listed}
            less = sum(k - 1 for k in often.values())
            pick = {x: k for x, k in often.items() if k * math.log1p((k - 1) / ((t - less + mu) * 10 ** prior(ctx[1:], x))) >= worth}
            free = math.log10((t - sum(k - 1 for k in pick.values()) + mu) / (t + mu))
            logp = {x: math.log10((k - 1) / (t + mu) + 10 ** (free + prior(ctx[1:], x))) for x, k in pick.items()}
            gain = sum(k * (logp[x] - prior(ctx[1:], x)) for x, k in pick.items()) + (t - sum(pick.values())) * free
            if pick and gain * math.log(10) / t >= divergence:
                kept[ctx] = (free, logp)
                assert sum(10 ** logp.get(x, free + prior(ctx[1:], x)) for x in root) == pytest.approx(1, abs=1e-3)

    def score(text):
        w = [*(x.encode() for x in words(text)), b""]
        s, out = [sym(x) for x in w], 0.0
        for p, x in enumerate(w):
            own = logp = math.log10(root.get(s[p], 1 / unit))
            for d in range(1, depth + 1):
                if (ctx := before(s, p, d)) in kept:
                    free, said = kept[ctx]
                    logp = said.get(s[p], free + logp)
            out += math.log10((c[x] + 1) / unit) + logp - own
        return out

    return kept, score


@pytest.mark.parametrize(("depth", "least", "listed", "worth", "divergence", "mu"), [(3, 30, 2, 1.0, 0.01, 10.0), (2, 15, 3, 3.0, 0.02, 3.0), (4, 60, 2, 0.5, 0.3, 10.0)])
def test_suffix_tree_equals_brute_force(spark, depth, least, listed, worth, divergence, mu):
    rng = random.Random(4)
    turns = ["red one up", "red two down", "blue one down", "blue two up"]
    say = lambda: rng.choice([*turns, *(f"v{rng.randint(0, 60)}" for _ in range(4)), rng.choice(["the of", "und der", f"R{rng.randint(0, 9999)}en"])])
    texts = [" ".join(say() for _ in range(rng.randint(0, 40))) for _ in range(300)]
    options = {"depth": depth, "least": least, "listed": listed, "worth": worth, "divergence": divergence, "mu": mu}
    tree = suffix_tree.fit(spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "doc_id long, text string").repartition(5), **options)
    kept, score = brute_tree(texts, **options)
    assert [k.count() for k, _ in tree.levels] == [sum(len(c) == d for c in kept) for d in range(1, len(tree.levels) + 1)]
    assert sum(e.count() for _, e in tree.levels) == sum(len(logp) for _, logp in kept.values()) and {len(c) for c in kept} >= {1, 2}
    docs = [*enumerate([*texts[:40], *turns, *[f"{t} v1 v2 R99999en" for t in turns], "never seen wörds at all", "", "red"])]
    frame = spark.createDataFrame(docs, "doc_id long, text string")
    for most in ({}, {"top_words": 0, "top_nodes": 0}, {"top_words": 40, "top_nodes": 30}):
        got = {r.doc_id: r.score for r in suffix_tree.score(frame, tree, **most).collect()}
        assert all(got[i] == pytest.approx(score(t), abs=1e-6) for i, t in docs)


def test_grams_of_a_context_and_word_lie_in_one_group(spark):
    rng = random.Random(6)
    texts = [" ".join(f"w{min(rng.randint(0, 60), rng.randint(0, 60))}" for _ in range(rng.randint(1, 40))) for _ in range(200)]
    docs = spark.createDataFrame([(t,) for t in texts], "text string").repartition(5)
    every, share = Bits(1, np.full(1 << 13, 255, "u1")), spark.sparkContext.broadcast
    want = collections.Counter(pair for t in texts for w in [["", *t.split(), ""]] for pair in zip(w, w[1:]))
    hot = np.empty(0, "u8")
    for _ in range(2):
        rows = suffix_tree._grams(docs, 1, share(every), share(every), share(hot)).collect()
        assert len({(r.ctx, r.word) for r in rows}) == len(rows) and sorted(r.n for r in rows) == sorted(want.values())
        assert all(0 <= r.group < suffix_tree.GROUPS for r in rows)
        groups = collections.defaultdict(set)
        for r in rows:
            groups[r.ctx].add(r.group)
        assert all((len(g) > 1) == (c in hot.view("i8").tolist()) for c, g in groups.items())
        hot = np.array([collections.Counter(r.ctx for r in rows).most_common(1)[0][0]], "i8").view("u8")


def test_grams_and_asks_travel_packed(spark):
    """No row for each n-gram or ask leaves a task or is made of what arrives; rare words are folded where their group is."""
    rng = random.Random(11)
    texts = [" ".join(f"w{min(rng.randint(0, 90), rng.randint(0, 90))}" for _ in range(rng.randint(0, 60))) for _ in range(150)]
    docs = spark.createDataFrame([*enumerate(texts)], "doc_id long, text string").repartition(3)
    every, share = Bits(1, np.full(1 << 13, 255, "u1")), spark.sparkContext.broadcast
    keys = suffix_tree.hashed_words(pa.array([" ".join(f"w{i}" for i in range(20))]))[0]
    numbers = suffix_tree.Numbers.of(spark.createDataFrame([(int(k), 100 - i) for i, k in enumerate(keys.view("i8"))], "sym long, n long"))
    assert list(numbers.keys) == list(keys)
    for d in (1, 2, 3):
        want = collections.Counter(tuple(w[p : p + d + 1]) for t in texts for w in [["", *t.split(), ""]] for p in range(len(w) - d))
        often = sorted(n for n in want.values() if n >= 3)
        for known in (None, share(numbers)):
            grams = suffix_tree._grams(docs, d, share(every), share(every), share(np.empty(0, "u8")), known, 3)
            assert "Generate" not in grams._jdf.queryExecution().toString()
            rows = grams.collect()
            assert sorted(r.n for r in rows if r.word is not None) == often and sum(r.n for r in rows) == sum(want.values())
    tree = suffix_tree.fit(docs, least=20)
    assert "Generate" not in suffix_tree.score(docs, tree, top_words=0, top_nodes=0)._jdf.queryExecution().toString()


def test_packed_numbers_come_back():
    rng = np.random.default_rng(3)
    columns = [rng.integers(0, 2**64, 50, "u8"), np.empty(0, "u8"), rng.integers(0, 30_000, 4_000, "u8"), np.ones(4_000, "i8")]
    value = packed(*columns)
    assert len(value) < 50 * 8 + 4_000 * 2 + 200
    assert all(np.array_equal(a, b) for a, b in zip(unpacked(value, 4), columns, strict=True))


def test_suffix_tree_learns_more_from_more(spark):
    """What is learnt of rare phrases grows with the evidence, not with its share of the corpus."""
    rng = random.Random(8)
    rows = [" ".join(f"w{rng.randint(0, 300)}" for _ in range(50)) for _ in range(600)]
    turns = ["red one up", "red two down", "blue one down", "blue two up"]
    rows += [f"w{i % 300} {turns[i % 4]} w{(7 * i) % 300}" for i in range(400)]
    tree = suffix_tree.fit(spark.createDataFrame([*enumerate(rows)], "doc_id long, text string"), least=60)
    wrong = [" ".join([*t.split()[:2], "down" if t.endswith("up") else "up"]) for t in turns]
    got = {r.doc_id: r.score for r in suffix_tree.score(spark.createDataFrame([*enumerate([*turns, *wrong])], "doc_id long, text string"), tree).collect()}
    # one word back is not enough to tell up from down, two are
    assert all(got[i] > got[i + 4] + 1.0 for i in range(4))


def test_frequent_rows_are_bounded(spark):
    table = spark.createDataFrame([(i, 1 + i // 3, float(i)) for i in range(300)], "key long, n long, gain double")
    for most in (0, 1, 10, 100, 299, 300, 1000):
        top = suffix_tree.Top.of(table, "gain", most)
        assert len(top.keys) <= most and len(top.keys) == sum(1 + i // 3 >= top.floor for i in range(300))
        here, value = top.find(np.arange(300, dtype="u8"))
        assert [(bool(a), b) for a, b in zip(here, value, strict=True)] == [(1 + i // 3 >= top.floor, float(i) if 1 + i // 3 >= top.floor else 0.0) for i in range(300)]


def test_suffix_tree_empty_and_all_held_out(spark):
    none = spark.createDataFrame([], "doc_id long, text string")
    assert suffix_tree.train_and_score(none).count() == 0
    only = [i for i in range(60) if zlib.crc32(str(i).encode()) % 7 == 2]
    got = suffix_tree.train_and_score(spark.createDataFrame([(i, "a b") for i in only], "doc_id long, text string")).collect()
    assert all(r.held_out and r.n_known == 0 and r.train_tokens == 0 and np.isfinite(r.score) for r in got)


def edit(pattern, text):
    """Least edits of the pattern to any stretch of the text, by the whole table."""
    row = list(range(len(pattern) + 1))
    best = row[-1]
    for ch in text:
        new = [0]
        for k, p in enumerate(pattern, 1):
            new.append(min(row[k] + 1, new[-1] + 1, row[k - 1] + (p != ch)))
        row = new
        best = min(best, row[-1])
    return best


def test_leaks_equal_brute_force(spark):
    rng = random.Random(9)
    say = lambda n: " ".join("".join(rng.choice("abcde") for _ in range(rng.randint(2, 7))) for _ in range(n))
    items = [(i, say(rng.randint(4, 30))) for i in range(12)] + [(90, None), (91, "  "), (92, "X"), (None, "abc")]
    docs = []
    for d in range(160):
        body = say(20)
        if d % 2:
            leak = list(items[rng.randrange(12)][1])
            for _ in range(rng.randint(0, max(1, len(leak) // 7))):
                k = rng.randrange(len(leak))
                leak[k] = rng.choice(["", "z", leak[k] + "q", leak[k].upper()])
            body = f"{say(5)}  {''.join(leak)}\n{say(5)}"
        docs.append((d, body))
    docs += [(1000 + i if i else None, t) for i, t in enumerate(ODD)]
    frame = spark.createDataFrame([(d, t, "c") for d, t in docs], "doc_id long, text string, leaks string")
    bench = spark.createDataFrame(items, "item_id long, text string")
    got = {(r.doc_id, r.item_id): r.distance for r in decontaminate.contaminated(frame, bench).collect()}
    want = {}
    for d, t in docs:
        for i, q in items:
            p = decontaminate.normal(q)
            if i is not None and p:
                n = edit(p, decontaminate.normal(t))
                if n <= int(len(p) * 0.1):
                    want[(d, i)] = n
    assert got == want and len(want) > 40
    kept = decontaminate.clean(frame, bench)
    assert kept.columns == frame.columns and kept.count() == len(docs) - len({d for d, _ in want})
    # in several blocks of items
    assert {(r.doc_id, r.item_id): r.distance for r in decontaminate.contaminated(frame, bench, block_chars=300).collect()} == want
    assert sorted(map(str, decontaminate.clean(frame, bench, block_chars=300).collect())) == sorted(map(str, kept.collect()))
    assert decontaminate.contaminated(frame, bench.limit(0)).count() == 0
    assert decontaminate.contaminated(frame.limit(0), bench).count() == 0


def test_encoder_is_exact():
    from tokenizers import Tokenizer

    plain, enc = Tokenizer.from_file(tokenizer()), token_lengths.encoder(tokenizer())
    rng = random.Random(1)
    letters = "aAbZ's tT'LL.,!?;: \x1c\x85\xa0\u2003\u0301J\u030cİΣςΣ<|endoftext|>ßÀ1²½\n\t…日本é"
    texts = ["".join(rng.choice(letters) if rng.random() < 0.97 else rng.choice(["<|endoftext|>", "don't", "we'll."]) for _ in range(rng.randint(0, 40))) for _ in range(1500)]
    texts += ODD
    for t, got in zip(texts, enc.encode_all(texts), strict=True):
        assert np.frombuffer(got, "<u4").tolist() == plain.encode(t or "", add_special_tokens=False).ids, repr(t)


def test_length_histogram(spark):
    sizes = [1, 1, 2, 5, 5, 5, 1023, 1024, 3000, None]
    h = token_lengths.length_histogram(spark.createDataFrame([(s,) for s in sizes], "length long"), block=4).collect()
    real = [s for s in sizes if s is not None]
    for r in h:
        assert (r.n_docs, r.docs_at_least, r.tokens_at_least) == (real.count(r.length), sum(s >= r.length for s in real), sum(s for s in real if s >= r.length))
        assert r.truncated_total == sum(min(s, r.length) for s in real) and r.total_tokens == sum(real)
        assert r.quantile == sum(s <= r.length for s in real) / len(real)
    frame = token_lengths.length_histogram(spark.createDataFrame([(s,) for s in sizes], "length long"))
    assert {r.context_limit: (r.kept_tokens, r.cut_docs) for r in token_lengths.answer(frame, [3, 2048]).collect()} == {3: (sum(min(s, 3) for s in real), 6), 2048: (sum(min(s, 2048) for s in real), 1)}
    for limit, kept, cut in [(r.context_limit, r.kept_tokens, r.cut_docs) for r in token_lengths.answer(frame, [0, 1, 4, 1023, 1500, 9999]).collect()]:
        assert (kept, cut) == (sum(min(s, limit) for s in real), sum(s > limit for s in real))
    assert {r.share: r.length for r in token_lengths.quantiles(frame, [0.0, 0.2, 0.5, 0.9, 1.0]).collect()} == {q: sorted(real)[max(0, math.ceil(q * len(real)) - 1)] for q in (0.0, 0.2, 0.5, 0.9, 1.0)}
    none = token_lengths.length_histogram(spark.createDataFrame([], "length long"))
    assert none.count() == token_lengths.answer(none, [5]).count() == 0


@pytest.mark.parametrize(("max_docs", "max_cost", "norm"), [(None, None, False), (3, None, False), (None, 40**2 // 2 * 3, False), (4, 40**2 * 2, True)])
def test_plan_keeps_every_constraint(max_docs, max_cost, norm):
    rng = np.random.default_rng(2)
    cap = 40
    counts = dict(zip(*[x.tolist() for x in np.unique(rng.integers(1, 35, 500), return_counts=True)], strict=True))
    slots, used = packing.plan(counts, cap, max_docs or cap, max_cost or cap * cap, norm=norm)
    bins = collections.defaultdict(list)
    for n, count in counts.items():
        first, seq, at = slots[n]
        assert first[0] == 0
        for r in range(count):
            k = np.searchsorted(first, r, "right") - 1
            bins[int(seq[k] + r - first[k])].append((int(at[k]), n))
    assert len(bins) == used
    for held in bins.values():
        held.sort()
        assert [a for a, _ in held] == np.cumsum([0, *[n for _, n in held[:-1]]]).tolist()
        assert sum(n for _, n in held) <= cap and len(held) <= (max_docs or cap) and sum(n * n for _, n in held) <= (max_cost or cap * cap)
    if not max_docs and not max_cost:
        assert used <= math.ceil(sum(n * c for n, c in counts.items()) / cap) + 2


def test_pack_places_every_piece(spark):
    from tokenizers import Tokenizer

    plain = Tokenizer.from_file(tokenizer())
    docs = [(i, t) for i, t in enumerate(ODD)] + [(None, "a b"), (1, "a b"), (50, "long tale " * 900)]
    got = packing.pack(spark.createDataFrame([(d, t, "c") for d, t in docs], "doc_id long, text string, offset string").repartition(5), tokenizer(), capacity=512).collect()
    want = collections.Counter()
    for d, t in docs:
        ids = np.array([*plain.encode(t or "", add_special_tokens=False).ids, 0], "<u4")
        for k in range(0, len(ids), 512):
            want[(d, k // 512, k, len(ids[k : k + 512]), zlib.crc32(ids[k : k + 512].tobytes()))] += 1
    assert collections.Counter((r.doc_id, r.piece, r.start, r.length, r.ids_crc32) for r in got) == want
    by = collections.defaultdict(list)
    for r in got:
        by[r.sequence_id].append((r.offset, r.length))
    for held in by.values():
        held.sort()
        assert [a for a, _ in held] == np.cumsum([0, *[n for _, n in held[:-1]]]).tolist() and sum(n for _, n in held) <= 512
    assert packing.pack(spark.createDataFrame([], "doc_id long, text string"), tokenizer()).count() == 0
