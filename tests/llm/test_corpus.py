"""Mixing, quality, toxicity, URL rules and the pipeline."""

import random
import re
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from tests.compare import assert_same, connect
from tidelake.llm import mixing, quality, queries, toxicity, url_rules

SF = "/root/testdata/sf0.001"
WORD = re.compile(r"[^\x20\x09-\x0D]+")


@pytest.fixture(scope="module")
def con():
    return connect(SF)


@pytest.mark.parametrize("name", sorted(queries.ORACLES))
def test_against_sql(spark, con, name):
    assert_same(queries.QUERIES[name](spark, SF), con, queries.ORACLES[name])


# mixing


def sainte_lague(votes, seats):
    given = {k: 0 for k in votes}
    for _ in range(seats):
        best = max(sorted(votes), key=lambda k: votes[k] / (2 * given[k] + 1))
        given[best] += 1
    return given


def test_seats(spark):
    rng = random.Random(5)
    rows, want = [], {}
    for g in range(6):
        votes = {f"k{i}": rng.choice([0, 1, 5, 50, 1000, 333]) for i in range(rng.randint(1, 12))}
        seats = rng.randint(0, 300) if any(votes.values()) else 0
        rows += [(f"g{g}", k, v, seats) for k, v in votes.items()]
        want |= {(f"g{g}", k): n for k, n in sainte_lague({k: v for k, v in votes.items() if v} or {"none": 1}, seats).items() if k in votes}
    df = spark.createDataFrame(rows, "g string, k string, v long, s long")
    out = {(r.g, r.k): r.seats for r in mixing._seats(df, ["g", "k"], "v", F.col("s"), ["g"]).collect()}
    assert {k: out[k] for k in want} == want and all(out[(g, k)] == 0 for g, k, v, _ in rows if v == 0)


def targets(sizes, weights=(5, 2, 1), cap=3):
    keys = sorted((k for k in sizes if k is not None), key=lambda k: k.encode()) + ([None] if None in sizes else [])
    w = {k: weights[i % 3] for i, k in enumerate(keys)}
    out, left, open_ = {}, sum(sizes.values()), set(keys)
    while open_:
        share = {k: left * w[k] / sum(w[x] for x in open_) for k in open_}
        over = {k for k in open_ if share[k] > cap * sizes[k]}
        if not over:
            return out | share
        for k in over:
            out[k] = cap * sizes[k]
            left -= out[k]
        open_ -= over
    return out


def mixable(spark):
    rng = random.Random(8)
    rows = []
    for i in range(900):
        source = rng.choice(["hot"] * 5 + ["b", "ä", "Z", None, "tiny"])
        n = rng.randint(0, 80)
        rows.append((i if rng.random() < 0.95 else 3, None if n == 7 else " ".join(["w"] * n) + "\n", "tiny" if i == 5 else source if source != "tiny" else "hot", "x"))
    rows += [(2000, "x " * 30000, "b", "x"), (None, "a b c", "Z", "x"), (2001, "", "void", "x")]
    return spark.createDataFrame(rows, "doc_id long, text string, source string, size string"), rows


def test_mix(spark):
    df, rows = mixable(spark)
    out = mixing.mix(df.repartition(5), docs_per_shard=64)
    got = out.collect()
    assert len(got) == len(rows)
    assert sorted(r.size for r in got) == sorted(len(WORD.findall(t or "")) for _, t, _, _ in rows)
    sizes = defaultdict(int)
    for _, t, s, _ in rows:
        sizes[s] += len(WORD.findall(t or ""))
    want = targets(sizes)
    by_target, taken = defaultdict(int), defaultdict(int)
    source_of = {}
    for k in sizes:
        source_of[(sizes[k], round(want[k], 6))] = k
    for r in got:
        k = source_of[(r.source_size, round(r.target, 6))]
        taken[k] += r.taken
        by_target[k] = r.target
        assert 0 <= r.taken <= 3 * r.size and r.taken == r.whole * r.size + r.part and r.part <= r.size
    assert abs(sum(by_target.values()) - sum(sizes.values())) < 1e-6
    for k, t in want.items():
        assert abs(taken[k] - t) <= max(4, 0.02 * t), (k, taken[k], t)
    again = mixing.mix(df.repartition(2), docs_per_shard=64).collect()
    key = lambda r: tuple((x is None, x) for x in r)
    assert sorted(map(tuple, got), key=key) == sorted(map(tuple, again), key=key)
    assert mixing.mix(df.limit(0)).collect() == []


def test_mix_of_shards_smaller_than_a_block(spark):
    rows = [(i, "w w" if i % 10 == 0 else None, "sparse") for i in range(4000)] + [(10_000 + i, "x " * 40, "full") for i in range(50)]
    got = mixing.mix(spark.createDataFrame(rows, "doc_id long, text string, source string"), docs_per_shard=4).collect()
    for size in (800, 2000):
        of = [r for r in got if r.source_size == size]
        assert abs(sum(r.taken for r in of) - of[0].target) <= 0.02 * of[0].target and all(r.taken <= 3 * r.size for r in of)


def test_take_gives_the_words_of_the_mix(spark):
    rng = random.Random(2)
    rows = [(i, " ".join(f"d{i}w{j}" for j in range(rng.randint(0, 40))), "abc"[i % 3], "en") for i in range(200)]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string, lang string").withColumn("n_chars", F.length("text").cast("long"))
    mixed = mixing.mix(df)
    out = mixing.take(df, mixed)
    assert out.columns == df.columns
    words = Counter()
    for r in out.collect():
        words[r.doc_id] += len(WORD.findall(r.text))
        assert r.n_chars == len(r.text) and set(WORD.findall(r.text)) <= set(WORD.findall(rows[r.doc_id][1]))
    assert {i: n for i, n in words.items() if n} == {r.doc_id: r.taken for r in mixed.collect() if r.taken}


# quality


def base(t):
    w = WORD.findall(t)
    ls = [x for x in t.split("\n") if WORD.search(x)]
    at = defaultdict(list)
    for i in range(len(w) - 4):
        at[tuple(w[i : i + 5])].append(i)
    covered = {i + k for v in at.values() if len(v) > 1 for i in v for k in range(5)}
    return len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", t)), len(ls) - len(set(ls)), len(covered)


TEXTS = ["", None, " \n ", "a b c d e a b c d e", "x " * 400, "line one\nline one\n\nline one \n", "日本 語 \U0001f600 #$% |", "a\tb\x0bc\x0cd\re f", "\u00a0 nbsp \u2003 word", "w1 w2 w3 w4 w5 w6 " * 3, " ".join(map(str, range(5000))) + " 1 2 3 4 5"]


def test_quality_features(spark):
    df = spark.createDataFrame([(i, t, "x") for i, t in enumerate(TEXTS)] + [(None, "a", "x")], "doc_id long, text string, n_words string")
    out = {r.doc_id: r for r in quality.features(df).collect()}
    for i, t in enumerate(TEXTS):
        r = out[i]
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) == base(t or ""), i
    assert out[None].n_words == 1


def em(patterns, rules, rounds=60, prior=0.85, found=0.4):
    v = np.array([p for p, _ in patterns])
    n = np.array([c for _, c in patterns], float)
    trust = np.array([r.trust for r in rules])
    pi, a, b = prior, trust.copy(), np.full(len(rules), found)
    for _ in range(rounds):
        lg = np.log(pi) + ((v == 1) * np.log(a) + (v == 0) * np.log(1 - a)).sum(1)
        lb = np.log(1 - pi) + ((v == 1) * np.log(1 - b) + (v == 0) * np.log(b)).sum(1)
        g = 1 / (1 + np.exp(lb - lg))
        pi = np.clip(((n * g).sum() + 1) / (n.sum() + 2), 0.02, 0.98)
        k, m = 4 + quality.DRAWN * (n * g).sum(), 4 + quality.DRAWN * (n * (1 - g)).sum()
        a = np.clip((((v == 1) * (n * g)[:, None]).sum(0) + k * trust) / (((v >= 0) * (n * g)[:, None]).sum(0) + k), *quality.GOOD_BOUNDS)
        b = np.clip((((v == 0) * (n * (1 - g))[:, None]).sum(0) + m * found) / (((v >= 0) * (n * (1 - g))[:, None]).sum(0) + m), *quality.BAD_BOUNDS)
    return pi, a, b


def test_quality_model_and_verdicts(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    counted = quality.features(docs).groupBy(quality.votes().alias("votes")).agg(F.count(F.lit(1)).alias("n"))
    model = quality.estimate(counted)
    pi, a, b = em([(r.votes, r.n) for r in counted.collect()], quality.RULES)
    assert np.allclose([model["pi"], *model["a"], *model["b"]], [pi, *a, *b], atol=1e-9)
    assert all(quality.GOOD_BOUNDS[0] < x < quality.GOOD_BOUNDS[1] for x in model["a"]) and all(quality.BAD_BOUNDS[0] < x < quality.BAD_BOUNDS[1] for x in model["b"])
    out = quality.judge_quality(docs).collect()
    assert len(out) == docs.count()
    labels = {r.doc_id: r.quality for r in spark.read.parquet(f"{SF}/labels.parquet").collect()}
    good = [r.kept for r in out if labels.get(r.doc_id) == 1 and not r.base_failed]
    assert sum(good) >= 0.97 * len(good)
    assert all(r.base_failed == (r.n_words < 10 or 100 * r.n_repeat_words > 20 * r.n_words) and not (r.kept and r.base_failed) for r in out)
    assert quality.judge_quality(docs.limit(0)).collect() == []
    assert len(quality.judge_quality(spark.createDataFrame([(1, None), (1, None), (None, "a")], "doc_id long, text string")).collect()) == 3


def test_a_rule_that_misfires_loses_its_weight(spark):
    """Nine of ten clean documents have symbols here, as in code: all other rules call them good, and they stay."""
    rows = [([1, 1, 0 if i % 10 else 1, 0 if i % 10 else 1, 1, 1, 1], 1) for i in range(900)] + [([0, 0, -1, -1, 0, 0, 0], 1)] * 100
    counted = spark.createDataFrame(rows, "votes array<int>, n long").groupBy("votes").agg(F.sum("n").alias("n"))
    model = quality.estimate(counted)
    assert max(model["a"][2:4]) < 0.6 and min(model["a"][:2] + model["a"][4:]) > 0.75
    judged = {tuple(r.votes): r.p for r in counted.withColumn("p", quality.posterior(F.col("votes"), model)).collect()}
    assert judged[1, 1, 0, 0, 1, 1, 1] > 0.5 > judged[0, 0, -1, -1, 0, 0, 0]


# toxicity


def clause_total(text, stems=None):
    lexicon = toxicity.Model(stems or {}, toxicity.DEFAULT).lexicon()
    return sum(c.score for c in toxicity.matched_clauses(text, lexicon)[0])


def test_grammar_scores_clauses():
    total = clause_total
    plain = total("such an idiot")
    assert plain > 0 and total("a lovely day") == 0 and total("") == 0
    assert total("he is not an idiot") < plain < total("you are an idiot")
    assert total("she said that such an idiot") < plain
    assert total("it is not so. such an idiot") == plain  # negation ends with its clause
    assert total("Vequaire rest", {"vequ": 4.0}) == pytest.approx(2.0) and total("you vequaire", {"vequ": 4.0}) == pytest.approx(4.0)
    assert len(toxicity.matched_clauses("idiot here. fine. moron there", toxicity.Model({}, []).lexicon())[0]) == 2


def test_threats_targets_and_reports_on_both_sides():
    total = clause_total
    threat = total("I will kill you")
    assert total("the pan will kill the germs, burn calories and beat eggs") == 0 == total("I will kill the germs")
    assert 0 < total("kill you") < threat and total("he said I will kill you") < threat and total("I will never kill you") < threat
    assert total("this is trash collection day") < threat
    assert total("idiot you are") == total("you idiot") > total("idiot")
    assert total("you are an idiot he said") < total("you are an idiot") and total("an idiot he said") < total("an idiot")
    assert total("idiot you are not") < total("idiot you are")


def by_hand(symbols, weights):
    """The grammar's rules, each looked up around the word itself."""
    out = 0.0

    def opened(i, step, openers, reach, closers=(), pause=0):
        """Whether an opener stands within reach on that side, nothing having closed it; closers silence what lies just beyond them."""
        side = [symbols[k] for k in (range(i) if step < 0 else range(len(symbols) - 1, i, -1))]
        left = quiet = 0
        for s in side:
            if s in closers:
                left, quiet = 0, pause
            elif s in openers and not quiet:
                left = reach
            else:
                left, quiet = max(0, left - 1), max(0, quiet - 1)
        return left > 0

    T = toxicity
    for i, s in enumerate(symbols):
        if s not in T.HARM:
            continue
        w = weights[i]
        w *= 0.25 if opened(i, -1, (T.NEGATION,), 3) else 1
        w *= 0.5 if opened(i, 1, (T.NEGATION,), 3) else 1
        w *= 0.5 if opened(i, -1, (T.REPORT,), 12) else 1
        w *= 0.5 if opened(i, 1, (T.REPORT,), 12) else 1
        if s == T.INSULT:
            w *= 2 if opened(i, -1, T.WHO, 4, (T.REPORT,)) else 1
            w *= 2 if opened(i, 1, T.WHO, 4, (T.REPORT,), 2) else 1
        else:
            w *= 1 if opened(i, -1, (T.AGENT, T.PERSON), 4) else 0.25
            w *= 1 if opened(i, 1, T.WHO, 3, (T.REPORT,), 2) else 0
        out += w
    return out


def test_composed_machines_are_the_rules():
    rng = random.Random(1)
    lexicon = toxicity.Model({}, toxicity.DEFAULT).lexicon()
    words = {toxicity.OTHER: "plate", toxicity.INSULT: "idiot", toxicity.THREAT: "kill", toxicity.TARGET: "you", toxicity.AGENT: "i", toxicity.PERSON: "he", toxicity.NEGATION: "not", toxicity.REPORT: "said"}
    for _ in range(3000):
        symbols = [rng.choice([0, 0, 0, *range(8)]) for _ in range(rng.randint(1, 18))]
        weights = [{toxicity.INSULT: 1.5, toxicity.THREAT: 4.0}.get(s, 0) for s in symbols]
        assert clause_total(" ".join(words[s] for s in symbols)) == pytest.approx(by_hand(symbols, weights)), symbols
    a, b = toxicity.within((toxicity.NEGATION,), 2, toxicity.HARM, 0.5), toxicity.within((toxicity.TARGET,), 1, toxicity.HARM, 3.0)
    for _ in range(100):
        symbols = [rng.randrange(8) for _ in range(8)]
        assert (a * b).read(symbols) == [f * g for f, g in zip(a.read(symbols), b.read(symbols), strict=True)]
    assert lexicon.read("idiot") == (toxicity.INSULT, 1.5)


def test_toxicity_query_has_the_contract(spark, tmp_path):
    import zlib

    rng = random.Random(4)
    word = lambda: "".join(rng.choice("bdfgklm") + rng.choice("aeiou") for _ in range(3))
    common, bad = [word() for _ in range(300)], [f"zerq{x}" for x in ("a", "ine", "os", "ut")]
    rows = []
    for i in range(400):
        words = [rng.choice(common) for _ in range(40)]
        if i % 4 == 0:
            for _ in range(4):
                words.insert(rng.randrange(len(words)), rng.choice(bad))
        rows.append((i, " ".join(words)))
    spark.createDataFrame([*rows, (None, "no id"), (1000, None), (1001, "")], "doc_id long, text string").write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame([(i, 1, int(i % 4 == 0)) for i in range(400)], "doc_id long, quality int, toxic int").write.parquet(str(tmp_path / "labels.parquet"))
    out = queries.op6_toxicity(spark, str(tmp_path))
    assert out.columns[:4] == ["doc_id", "held_out", "score", "predicted"]
    got = out.collect()
    assert len(got) == 403 and all(0 <= r.score <= 1 and r.predicted == int(r.score >= 0.3) for r in got)
    assert all(r.held_out == (r.doc_id is not None and zlib.crc32(str(r.doc_id).encode()) % 4 == 2) for r in got)
    assert all(r.predicted == int(r.doc_id % 4 == 0) for r in got if r.doc_id is not None and r.doc_id < 400)


def test_toxicity_is_learned_and_holds_out(spark):
    docs = spark.read.parquet("/root/testdata/sf0.1/documents.parquet").select("doc_id", "text")
    labels = spark.read.parquet("/root/testdata/sf0.1/labels.parquet")
    model = toxicity.learn(docs, labels)
    swapped = labels.withColumn("toxic", F.when(toxicity.fold(F.col("doc_id")) == 2, 1 - F.col("toxic")).otherwise(F.col("toxic")))
    assert toxicity.learn(docs, swapped) == model  # labels that are held out change nothing
    truth = labels.where(toxicity.fold(F.col("doc_id")) == 2).select("doc_id", F.col("toxic").alias("truth"))
    scored = toxicity.score_toxicity(docs.join(truth, "doc_id"), model).collect()
    hit = sum(r.toxic == 1 and r.truth == 1 for r in scored)
    assert hit / sum(r.truth for r in scored) > 0.8
    assert sum(r.toxic == 1 and r.truth == 0 for r in scored) / sum(r.truth == 0 for r in scored) < 0.02


def test_only_near_copies_are_left_out(spark):
    rng = random.Random(7)
    words = lambda n: [f"w{rng.randrange(10**6)}" for _ in range(n)]
    least = lambda n: "SELECT xxhash64('a', 'b', CAST(id AS STRING)) AS h, id FROM range(20000) ORDER BY h LIMIT " + str(n)
    common = f"a b {spark.sql(least(1)).first().id}"
    base = [words(200) for _ in range(6)]
    near = [[*base[0][:90], "other", *base[0][91:]], base[1]]
    rows = [(i, 1, 0, f"{common} {' '.join(w)}") for i, w in enumerate([*base, *near])]
    df = spark.createDataFrame(rows, "_id long, _y int, _fold long, _t string")
    assert sorted(r._id for r in toxicity.one_of_copies(df).collect()) == [0, 1, 2, 3, 4, 5]


def test_toxicity_odd_inputs(spark):
    df = spark.createDataFrame([(1, None, "a"), (1, "", "a"), (None, "you idiot moron scum", "a"), (4, "word " * 50000, "a")], "doc_id long, text string, toxic string")
    model = toxicity.learn(df, spark.createDataFrame([], "doc_id long, toxic int"))
    assert model.stems == {} and model.coefficients == toxicity.DEFAULT
    out = toxicity.score_toxicity(df, model).collect()
    assert len(out) == 4 and all(0 <= r.toxicity <= 1 for r in out)
    assert [r.toxic for r in out if r.doc_id is None] == [1] and all(r.toxic == 0 for r in out if r.doc_id is not None)
    assert toxicity.score_toxicity(df.limit(0), model).collect() == []


# URL rules


def fits(rule, host, path):
    return (host == rule.host or host.endswith("." + rule.host)) and path.startswith(rule.path)


def test_automaton_is_multiword_and_exact():
    rng = random.Random(6)
    piece = lambda: "".join(rng.choice("ab.") for _ in range(rng.randint(1, 5))).strip(".") or "a"
    rules = [url_rules.Rule("block", piece(), "/" + "".join(rng.choice("ab/") for _ in range(rng.randint(0, 4)))) for _ in range(40)]
    automaton = url_rules.GlobAutomaton(rules)
    assert automaton.words > 3
    urls = [(piece(), rng.choice(["", "/" + "".join(rng.choice("ab/.") for _ in range(8))])) for _ in range(500)]
    got = automaton.match([f".{h}{p}".encode() for h, p in urls])
    assert got.tolist() == [[fits(r, h, p) for r in rules] for h, p in urls]
    wild = url_rules.GlobAutomaton([url_rules.Rule("block", "ads*.net", "/x/*/y")])
    assert wild.match([b".ads7.net/x/q/y9", b".a.ads.net/x//y", b".ads7.org/x/q/y", b".ads/7.net/x/q/y", b""]).ravel().tolist() == [True, True, False, False, False]


def test_url_parts_and_odd_inputs(spark):
    urls = ["HTTP://Ex.COM/En/7?q=1#f", "https://a.example.com/en/7", "x://É.net", "x://h?p", "x://h#p/q", "no scheme", None, "", "a://b://c/d", "http://example.com" + "/en/" + "x" * 30000, "http://xexample.com/en/7", "x://net/de/8\n9"]
    df = spark.createDataFrame([(i, u, 1) for i, u in enumerate(urls)] + [(None, urls[1], 1)], "page_id long, url string, host int")
    out = {r.page_id: r for r in url_rules.judge_urls(df, queries.URL_RULES).collect()}
    assert [(out[i].host, out[i].path) for i in range(9)] == [("ex.com", "/En/7"), ("a.example.com", "/en/7"), ("É.net", ""), ("h", ""), ("h", ""), ("", ""), ("", ""), ("", ""), ("b:", "//c/d")]
    assert (out[1].rule, out[1].verdict) == ("example.com/en/7", "allow") and (out[9].rule, out[9].verdict) == ("com/en/", "block")
    assert (out[10].rule, out[6].rule, out[6].verdict, out[11].rule) == ("com/en/", None, "allow", "net/de/")
    assert out[None].verdict == "allow" and url_rules.judge_urls(df.limit(0), queries.URL_RULES).collect() == []
    assert {r.verdict for r in url_rules.judge_urls(df, []).collect()} == {"allow"}


# the pipeline


def test_pipeline(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    assert [n for n, _ in corpus_pipeline.STAGES] == ["toxicity", "line_dedup", "ngram_join", "mixing", "byte_bpe"]
    at, kept = docs, []
    for _, stage in corpus_pipeline.STAGES[:4]:
        at = stage(spark, at, SF)
        assert at.columns == docs.columns and at.dtypes == docs.dtypes
        at = spark.createDataFrame(at.collect(), at.schema)
        kept.append(at.count())
    assert kept[0] < docs.count() and kept[1] == kept[0] and kept[2] < kept[1]
    out = corpus_pipeline.run(spark, SF)
    assert {"doc_id", "n_tokens", "ids_sha256", "decoded_sha256"} <= set(out.columns)
    want = {r.d for r in at.select(F.sha2("text", 256).alias("d")).collect()}
    assert {r.decoded_sha256 for r in out.collect()} == want and out.count() == kept[3]


def test_pipeline_with_odd_rows(spark, tmp_path):
    rows = [(1, None, "en", "a", None), (2, "", "en", None, 0), (2, "", "en", None, 0), (None, "some words here", None, "a", 15), (5, "x " * 200, "en", "b", 400)]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame([], "doc_id long, quality int, toxic int").write.parquet(str(tmp_path / "labels.parquet"))
    corpus_pipeline.run(spark, str(tmp_path)).collect()
