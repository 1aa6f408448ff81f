"""The similarity joins, line dedup and components against brute force."""

import random
import re
from collections import Counter
from fractions import Fraction

import numpy as np
import pytest

from tidelake.llm import line_dedup, metric_join, ngram_join
from tidelake.llm.shared import Scratch, connected_components, word_hashes


def reach(nodes, links):
    root = {n: n for n in nodes}

    def find(n):
        while root[n] != n:
            n = root[n]
        return n

    for a, b in links:
        if a != b:
            a, b = sorted((find(a), find(b)))
            root[b] = a
    return {n: find(n) for n in nodes}


def test_components(spark):
    rng = random.Random(1)
    chain = [(i, i + 1) for i in range(100, 160)]
    hub = [(7, i) for i in range(200, 260)]
    wild = [(rng.randint(300, 420), rng.randint(300, 420)) for _ in range(90)]
    links = chain + hub + wild + [(5, 5), (100, 101)]
    rng.shuffle(links)
    out = connected_components(spark.createDataFrame(links, "a long, b long"), Scratch(spark, "test"))
    nodes = {n for a, b in links if a != b for n in (a, b)}
    assert {r.node: r.root for r in out.collect()} == reach(nodes, links)
    assert out.count() == len(nodes)
    assert connected_components(spark.createDataFrame([], "a long, b long"), Scratch(spark, "test")).collect() == []


def test_word_hashes():
    rng = random.Random(8)
    texts = ["".join(rng.choice(["a", "b", "é", "\u00a0", "日", " ", "\n", "\t", "\x0b", "  "]) for _ in range(rng.randint(0, 60))) for _ in range(300)] + [None, "", " ", "x" * 3000, "w " * 500]
    names = {}
    for chunk in (8, 1 << 19):
        for t, got in zip(texts, word_hashes(texts, chunk), strict=True):
            words = re.findall(r"[^\x20\x09-\x0D]+", t or "")
            assert len(words) == len(got)
            for w, h in zip(words, got.tolist(), strict=True):
                assert names.setdefault(w, h) == h
    assert len(set(names.values())) == len(names) > 300 and word_hashes([]) == []


def shingles(t):
    w = re.findall(r"[^\x20\x09-\x0D]+", t or "")
    return {tuple(w[k : k + 5]) for k in range(max(1, len(w) - 4))} if w else set()


def corpus():
    rng = random.Random(4)
    word = lambda: "".join(rng.choice("abcdefgh") for _ in range(5))
    out = [" ".join(word() for _ in range(rng.randint(1, 120))) for _ in range(120)]
    base = [word() for _ in range(150)]
    for _ in range(60):  # a group of near copies, larger than a small bucket
        w = list(base)
        for _ in range(rng.randint(0, 5)):
            w[rng.randrange(len(w))] = word()
        out.append(" ".join(w))
    for t in out[:40]:  # near and exact copies in twos
        w = t.split()
        if len(w) > 30 and rng.random() < 0.7:
            w[rng.randrange(len(w))] = word()
        out.append("\n".join(w) if rng.random() < 0.3 else " ".join(w))
    passage = " ".join(word() for _ in range(70))
    out += [passage + " " + " ".join(word() for _ in range(rng.randint(1, 60))) for _ in range(50)]
    return out + [None, "", "  \n", "one", "one", "a b", "x " * 3000]


@pytest.mark.parametrize("crowded", [3, 16, 10**6])
def test_ngram_join(spark, crowded):
    texts = corpus()
    rows = [(i, t, "n", 1) for i, t in enumerate(texts)] + [(None, "no id at all", "n", 1)]
    out = ngram_join.similar_documents(spark.createDataFrame(rows, "doc_id long, text string, rep string, size int").repartition(5), crowded=crowded, block=16)
    found = {r.doc_id: r for r in out.collect()}
    sets = [shingles(t) for t in texts]
    links = [(a, b) for b in range(len(texts)) for a in range(b) if sets[a] and sets[b] and 5 * len(sets[a] & sets[b]) >= 4 * len(sets[a] | sets[b])]
    degree = Counter(n for x in links for n in x)
    roots = reach(range(len(texts)), links)
    assert len(found) == len(rows) and len(links) > 600
    assert {i: found[i].n_links for i in range(len(texts))} == {i: degree[i] for i in range(len(texts))}
    assert {i: found[i].component_id for i in range(len(texts))} == roots
    assert all(found[i].kept == (roots[i] == i) for i in range(len(texts)))
    assert found[None].kept and found[None].component_id is None and found[None].n_links == 0
    words = [tuple((t or "").split()) for t in texts]
    for i, w in enumerate(words):
        assert found[i].class_id == (words.index(w) if w else i)


def test_row_order_is_of_no_account(spark):
    rng = random.Random(12)
    word = lambda: "".join(rng.choice("abcdefgh") for _ in range(5))
    a, b = [word() for _ in range(60)], [word() for _ in range(60)]
    rows = [(5, " ".join(a)), (5, " ".join(b)), (7, " ".join([*a[:-1], "x"])), (9, " ".join([*b[:-1], "x"])), (11, "else")]
    found = set()
    for k in range(3):
        rng.shuffle(rows)
        out = ngram_join.similar_documents(spark.createDataFrame(rows, "doc_id long, text string").repartition(k + 1)).collect()
        found.add(tuple(sorted((r.doc_id, r.component_id, r.n_links, r.kept) for r in out)))
    assert found == {((5, 5, 1, True), (5, 5, 1, True), (7, 5, 1, False), (9, 5, 1, False), (11, 11, 0, True))}


def test_ngram_join_odd_inputs(spark):
    schema = "doc_id long, text string"
    assert ngram_join.similar_documents(spark.createDataFrame([], schema)).collect() == []
    text = " ".join(map(str, range(40)))
    twice = ngram_join.similar_documents(spark.createDataFrame([(5, text), (5, text), (9, text)], schema)).collect()
    assert sorted((r.doc_id, r.class_id, r.component_id, r.kept) for r in twice) == [(5, 5, 5, True), (5, 5, 5, True), (9, 5, 5, False)]


def test_prefixes_are_shortened_until_the_recall():
    t = Fraction(4, 5)
    for recall in (0.9, 0.99, 0.9999):
        k = ngram_join.closing_depth(0.8, 32, 8, recall)
        assert 1 - (1 - 0.8**k) ** 32 >= recall and (k == 8 or 1 - (1 - 0.8 ** (k + 1)) ** 32 < recall)
    depths = ngram_join.closing_depths(t, 32, 8, 0.9999)
    assert depths.min() == depths[-1] == ngram_join.closing_depth(0.8, 32, 8, 0.9999) and depths[3] == 8 and len(set(depths.tolist())) > 1
    for n in range(1, 40):
        have = [Fraction(k, n + m - k) for m in range(1, 2 * n) for k in range(1, min(n, m) + 1)]
        assert ngram_join.least_similarity(n, t) == pytest.approx(float(min(x for x in have if x >= t)))


def test_sketches_agree_as_often_as_sets_are_alike():
    rng = np.random.default_rng(5)
    for n in (1, 6, 40, 700):
        agree = []
        for _ in range(60):
            both = rng.integers(0, 1 << 62, n * 9, dtype=np.uint64)
            a, b = np.unique(both[: n * 8]), np.unique(both[n:])  # 7 of 9 parts are shared
            x, y = ngram_join.sketches([a, b], 256)
            agree.append((x == y).mean())
        assert np.mean(agree) == pytest.approx(7 / 9, abs=0.05)
    assert ngram_join.sketches([], 256).shape == (0, 256)
    one = ngram_join.paths(ngram_join.sketches([a, a, b], 256), 32)
    assert (one[0] == one[1]).all() and ngram_join.share_prefix(one[0], one[2], np.full(32, 1)).sum() >= ngram_join.share_prefix(one[0], one[2], np.full(32, 8)).sum()


def vectors(rng, n, labels, dims=16):
    base = rng.normal(size=(n // 4, dims))
    x = base[rng.integers(0, len(base), n)] + rng.normal(size=(n, dims)) * rng.choice([0.02, 0.1, 0.3], n)[:, None]
    x[: n // 10] = x[n // 10 : 2 * (n // 10)]
    return x.astype(np.float32), rng.integers(0, labels, n)


@pytest.mark.parametrize("cell_rows, block", [(20, 8), (1000, 1024)])
def test_metric_join(spark, cell_rows, block, monkeypatch):
    dealt = []
    near = metric_join._near
    monkeypatch.setattr(metric_join, "_near", lambda *a: (dealt.append(len(a[1])), near(*a))[1])
    x, label = vectors(np.random.default_rng(2), 300, 3)
    rows = [(i, v.tolist(), int(k)) for i, (v, k) in enumerate(zip(x, label, strict=True))]
    nan, inf = float("nan"), float("inf")
    odd = [(1000, None, 1), (1001, [0.0] * 16, 1), (1002, [nan] * 16, 1), (1003, [inf] + [0.0] * 15, 1), (1004, [None] + [1.0] * 15, 1), (1005, rows[0][1], None), (1006, [1.0, 2.0], 1), (1007, [], 1), (1008, [2 * c for c in rows[0][1]], rows[0][2])]
    df = spark.createDataFrame(rows + odd + [(None, rows[0][1], rows[0][2])], "vec_id long, embedding array<float>, label int").repartition(4)
    out = metric_join.link_vectors(df, cell_rows=cell_rows, block=block).collect()
    found = {r.vec_id: r for r in out}
    usable = [*rows, odd[8], odd[6]]
    links = []
    for i, (a, v, k) in enumerate(usable):
        for b, w, m in usable[:i]:
            if k == m and len(v) == len(w):
                p, q = np.array(v, float), np.array(w, float)
                if p @ q / np.linalg.norm(p) / np.linalg.norm(q) >= 0.93:
                    links.append((a, b))
    degree, roots = Counter(n for y in links for n in y), reach([a for a, _, _ in usable], links)
    assert len(links) > 200 and len(out) == len(rows) + len(odd) + 1 and bool(dealt) == (cell_rows == 20)
    for a, _, _ in usable:
        assert (found[a].n_links, found[a].component_id, found[a].kept) == (degree[a], roots[a], roots[a] == a)
    for a in (1000, 1001, 1002, 1003, 1004, 1005, 1007):
        assert (found[a].n_links, found[a].component_id, found[a].kept) == (0, a, True)
    assert found[None].kept and found[None].n_links == 0
    assert metric_join.link_vectors(df.limit(0)).collect() == []


def test_fingerprints_are_guaranteed_and_few():
    rng = np.random.default_rng(3)
    draw = lambda n: rng.integers(0, 1 << 62, n, dtype=np.uint64)
    for _ in range(200):
        run = draw(rng.integers(50, 90))
        texts = [np.concatenate([draw(rng.integers(0, 40)), run, draw(rng.integers(0, 40))]) for _ in range(2)]
        found = [set(line_dedup.winnow(t, 50, 10)[1].tolist()) for t in texts]
        assert found[0] & found[1]
    least = line_dedup.winnow(draw(100_000), 50, 10)[1]
    assert len(np.unique(least)) < 2.1 / 42 * 100_000


def test_pivots_of_clusters(spark):
    """Tight clusters far from each other: pivots part them, and nothing is lost."""
    rng = np.random.default_rng(7)
    base = np.eye(32)[rng.integers(0, 12, 400)]
    x = (base + rng.normal(size=(400, 32)) * 0.05).astype(np.float32)
    df = spark.createDataFrame([(i, v.tolist(), 1) for i, v in enumerate(x)], "vec_id long, embedding array<float>, label int")
    y = x.astype(float) / np.linalg.norm(x.astype(float), axis=1, keepdims=True)
    linked = (y @ y.T >= 0.93) & ~np.eye(400, dtype=bool)
    for cell_rows in (10, 10**6):
        out = {r.vec_id: r.n_links for r in metric_join.link_vectors(df, cell_rows=cell_rows, block=64).collect()}
        assert [out[i] for i in range(400)] == linked.sum(1).tolist()


@pytest.mark.parametrize("all_pivots", [4096, 0])
def test_pivots_level_by_level(spark, all_pivots, monkeypatch):
    """Cells that stay large get pivots of their own; links, copies and components are those of brute force."""
    written = []
    put = Scratch.put
    monkeypatch.setattr(Scratch, "put", lambda self, df, name: (written.append(name), put(self, df, name))[1])
    rng = np.random.default_rng(12)
    x = rng.normal(size=(700, 3))
    x[600:] = x[:100] * 2
    x[300:420] = x[300] + rng.normal(size=(120, 3)) * 0.02  # a crowd that no pivot parts
    rows = [(i, v.tolist(), "b" if i % 7 == 0 else "a") for i, v in enumerate(x)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>, label string").repartition(3)
    out = {r.vec_id: r for r in metric_join.link_vectors(df, threshold=0.995, cell_rows=15, all_pivots=all_pivots, fan_out=4, block=32).collect()}
    y = x / np.linalg.norm(x, axis=1, keepdims=True)
    label = np.array([k for _, _, k in rows])
    linked = (y @ y.T >= 0.995) & (label[:, None] == label) & ~np.eye(700, dtype=bool)
    roots = reach(range(700), np.argwhere(linked).tolist())
    assert {"split2", "split3"} <= set(written) and linked.sum() > 1000
    for i in range(700):
        assert (out[i].n_links, out[i].component_id, out[i].kept) == (linked[i].sum(), roots[i], roots[i] == i)


def test_word_dedup_finds_runs_inside_lines(spark):
    rng = random.Random(4)
    some = lambda n: ["".join(rng.choice("abcde") for _ in range(5)) for _ in range(n)]
    runs = [some(n) for n in (49, 50, 51, 59, 120)]

    def text(words):
        return "".join(w + rng.choice([" "] * 60 + ["\n", "\t ", "\n\n"]) for w in words)

    docs = [(500, text(["same"] * 160)), (501, None), (502, " \n "), (503, text(runs[3]))]
    for i in range(60):
        words = some(rng.randint(0, 60))
        for run in rng.sample(runs, rng.randint(0, 3)):
            a = rng.randint(0, 8) if rng.random() < 0.4 else 0
            words += run[a:] + some(rng.randint(0, 30))
        docs.append((i, text(words)))
    base = some(300)  # near copies, with changed words
    for i in range(40):
        w = list(base)
        for _ in range(rng.randint(0, 4)):
            w[rng.randrange(300)] = "changed" + str(rng.randrange(10))
        docs.append((700 + i, text(w[rng.choice([0, 0, 7]) :])))
    rows = [*docs, docs[44], (None, docs[5][1]), (30, docs[6][1]), (30, docs[34][1])]
    df = spark.createDataFrame([(k, t, len(t or ""), "x") for k, t in rows], "doc_id long, text string, n_chars long, removed_lines string").repartition(5)
    hashes = {r.text: r.h for r in df.selectExpr("text", "xxhash64(text) AS h").collect()}
    first = {}
    for k, t in rows:
        w = (t or "").split()
        for p in range(len(w) - 49 if k is not None else 0):
            first[tuple(w[p : p + 50])] = min((k, hashes[t]), first.get(tuple(w[p : p + 50]), (k, hashes[t])))
    want = Counter()
    for k, t in rows:
        w, gone, seen = (t or "").split(), set(), set()
        for p in range(len(w) - 49 if k is not None else 0):
            x = tuple(w[p : p + 50])
            if first[x] < (k, hashes[t]) or x in seen:
                gone.update(range(p, p + 50))
            seen.add(x)
        want[k, " ".join(x for p, x in enumerate(w) if p not in gone), len(gone)] += 1
    out = line_dedup.dedup_words(df).collect()
    assert Counter((r.doc_id, " ".join((r.text or "").split()), r.removed_words) for r in out) == want
    assert sum(n for _, _, n in want) > 1500 and any(r.removed_words and not r.removed_lines for r in out)
    assert all(r.text is None or r.n_chars == len(r.text) and bool(r.removed_runs) == (r.removed_words > 0) for r in out)
    assert line_dedup.remove_words("a b c\nd e", np.array([1]), np.array([7]), 2) == ("a\nd e", 0, 2, [(0, 0, 7)])
    assert line_dedup.dedup_words(df.limit(0)).collect() == []


def test_many_texts_at_once_are_as_each_alone():
    """Contexts and cuts of texts that are worked through together do not depend on their neighbours."""
    rng = random.Random(8)
    draw = np.random.default_rng(8)
    texts = [draw.integers(0, 1 << 62, rng.choice([0, 3, 11, 12, 13, 40, 300]), dtype=np.uint64) for _ in range(60)]
    texts += [np.tile(texts[0][:0], 1), np.full(30, 7, np.uint64), *texts[:5]]
    cuts = np.cumsum([0] + [len(t) for t in texts])
    text, *marks, whole, of = line_dedup.contexts(np.concatenate(texts), cuts, 12, 4)
    for i, t in enumerate(texts):
        _, *own, own_whole, _ = line_dedup.contexts(t, np.array([0, len(t)]), 12, 4)
        assert all((x[text == i] == y).all() for x, y in zip(marks, own, strict=True)) and (whole[of == i] == own_whole).all()
        assert own[3].sum() == len(own_whole) == max(0, len(t) - 11)
    for n in (1, 2, 5):
        docs = ["".join("é" + str(rng.randrange(50)) + rng.choice([" "] * 6 + ["\n", "\t ", "\n\n"]) for _ in range(rng.randint(n, 30))) for _ in range(80)]
        docs = [d.rstrip() if i % 3 else rng.choice(["", " ", "\n"]) + d for i, d in enumerate(docs)]
        at = [sorted(rng.sample(range(len(d.split()) - n + 1), rng.randint(1, len(d.split()) - n + 1))) for d in docs]
        found, lines, words, *_ = line_dedup.cut_texts(docs, np.repeat(np.arange(80), [len(a) for a in at]), np.concatenate(at), np.zeros(sum(map(len, at)), np.int64), n)
        for d, a, out, lost, k in zip(docs, at, found, lines, words, strict=True):
            gone = {p + j for p in a for j in range(n)}
            which = iter(range(10**6))
            left = [[next(which) in gone for _ in row.split()] for row in d.split("\n")]
            assert out.split() == [w for p, w in enumerate(d.split()) if p not in gone] and k == len(gone)
            assert lost == sum(bool(row) and all(row) for row in left)
            assert out == line_dedup.remove_words(d, np.array(a), np.zeros(len(a), np.int64), n)[0]


def test_equal_ids_with_different_texts(spark):
    rng = random.Random(6)
    line = lambda n: " ".join("".join(rng.choice("abcdefgh") for _ in range(5)) for _ in range(n))
    texts = [[line(30) for _ in range(4)] for _ in range(3)]
    rows = [(1, "\n".join(t)) for t in texts] + [(5 + i, "\n".join([line(9), *t, line(9)])) for i, t in enumerate(texts)] + [(9, "\n".join([texts[2][0], *texts[1], *texts[1]]))]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    out = {r.doc_id: r for r in line_dedup.dedup_words(df).where("doc_id > 1").collect()}
    assert [out[i].removed_words for i in (5, 6, 7, 9)] == [120, 120, 120, 240]
    judged = ngram_join.similar_documents(df).collect()
    assert {r.doc_id: (r.component_id, r.kept) for r in judged if r.doc_id in (1, 5, 6, 7)} == {1: (1, True), 5: (1, False), 6: (1, False), 7: (1, False)}
    assert [r.n_links for r in judged if r.doc_id < 9] == [1] * 6
