"""Quality rules as weak supervision.

Each rule votes good, bad or abstains. Expectation-maximisation over the counts of vote patterns (at most 3 to the number of rules, so
bounded whatever the corpus) estimates each rule's accuracies and the share of good documents; the posterior probability of good then
decides, so that no single rule has to pass. Everything is DataFrame and SQL functions: the iterations are one expression over the array of
patterns.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidelake.llm.shared import WORD, Scratch

SYMBOLS = "#*$%&|<>"
BLANKS = " \t\n\x0b\x0c\r"
CAPITALS = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"


def features(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, n_upper) of every row, all long.

    A null text has no words. Repeats are found by 64-bit hashes of lines and of 5-word windows, sorted within the row, so the work is
    n log n in the text's length. One narrow pass, no shuffle.
    """
    text = docs.select(F.col(id_col).alias(id_col), F.coalesce(F.col(text_col), F.lit("")).alias("_t"))
    words = text.withColumn("_w", F.regexp_extract_all("_t", F.lit(WORD), F.lit(0))).withColumn("_h", F.transform("_w", lambda x: F.xxhash64(x)))
    has_word = F.lit(r"[^\x20\x09-\x0D]")
    grams = words.select(
        id_col,
        F.size("_w").cast("long").alias("n_words"),
        F.length(F.translate("_t", BLANKS, "")).cast("long").alias("word_chars"),
        (F.length("_t") - F.length(F.translate("_t", SYMBOLS, ""))).cast("long").alias("n_symbols"),
        (F.length("_t") - F.length(F.translate("_t", CAPITALS, ""))).cast("long").alias("n_upper"),
        F.transform(F.filter(F.split("_t", "\n", -1), lambda x: F.rlike(x, has_word)), lambda x: F.xxhash64(x)).alias("_l"),
        F.expr("CASE WHEN size(_h) >= 5 THEN transform(sequence(0, size(_h) - 5), i -> xxhash64(get(_h, i), get(_h, i + 1), get(_h, i + 2), get(_h, i + 3), get(_h, i + 4))) ELSE array() END").alias("_g"),
    )
    # most texts repeat no window: only the others are sorted with their places
    sorted_ = grams.withColumn("_s", F.when(F.size(F.array_distinct("_g")) < F.size("_g"), F.expr("sort_array(transform(_g, (h, i) -> named_struct('h', h, 'i', i)))")))
    places = sorted_.withColumn(
        "_p",
        F.expr("CASE WHEN _s IS NOT NULL THEN sort_array(filter(transform(_s, (x, k) -> CASE WHEN x.h = get(_s, k - 1).h OR x.h = get(_s, k + 1).h THEN x.i END), i -> i IS NOT NULL)) END"),
    )
    covered = F.expr("coalesce(aggregate(_p, named_struct('last', -5, 'n', 0L), (a, i) -> named_struct('last', i, 'n', a.n + least(5, i - a.last)), a -> a.n), 0L)")
    dup_lines = (F.size("_l") - F.size(F.array_distinct("_l"))).cast("long")
    return places.select(id_col, "n_words", "word_chars", "n_symbols", dup_lines.alias("n_dup_lines"), covered.alias("n_repeat_words"), "n_upper")


@dataclass(frozen=True)
class Rule:
    """Votes by two SQL conditions over the features; where neither holds, it abstains. trust: the share of its votes on good documents that is expected
    to be good. It is where the estimate starts and what it is drawn to, and it tells which of the two classes is the good one."""

    name: str
    good: str
    bad: str
    trust: float = 0.85


#: Thresholds of the rules. Between good and bad a rule abstains.
RULES = (
    Rule("length", "n_words >= 50", "n_words < 20"),
    Rule("word_size", "word_chars BETWEEN 3 * n_words AND 6.5 * n_words", "word_chars < 2.5 * n_words OR word_chars > 9 * n_words"),
    Rule("symbols", "100 * n_symbols <= word_chars", "100 * n_symbols > 5 * word_chars"),
    Rule("symbols_in_words", "20 * n_symbols <= n_words", "10 * n_symbols > 4 * n_words"),
    Rule("repeated_words", "100 * n_repeat_words <= 8 * n_words", "100 * n_repeat_words > 20 * n_words"),
    Rule("repeated_lines", "n_dup_lines = 0", "n_dup_lines >= 3 AND 25 * n_dup_lines > n_words"),
    Rule("capitals", "100 * n_upper <= 15 * word_chars", "100 * n_upper > 30 * word_chars"),
)


def votes(rules: tuple[Rule, ...] = RULES) -> Column:
    """Array of votes: 1 good, 0 bad, -1 abstained."""
    return F.array(*[F.expr(f"CASE WHEN {r.bad} THEN 0 WHEN {r.good} THEN 1 ELSE -1 END") for r in rules])


#: Weight of the expected accuracies: as many votes as this share of a class's documents, and four more.
DRAWN = 0.05
#: Bounds of estimated accuracies on good documents and on bad ones; they only keep logarithms finite, and the two classes apart.
GOOD_BOUNDS, BAD_BOUNDS = (0.501, 0.9999), (0.001, 0.9999)


def estimate(counted: DataFrame, rules: tuple[Rule, ...] = RULES, rounds: int = 60, prior: float = 0.85, found: float = 0.4) -> dict:
    """Expectation-maximisation over (votes, n) rows: the share of good documents, and per rule the chance that a vote on a good document is
    good and that one on a bad document is bad. A rule may find few of the bad documents (found: where that starts).

    What is expected counts as votes beside the real ones (DRAWN), so a rule that misfires on clean text loses its weight, at any size of the corpus alike."""
    n_rules, trust = len(rules), f"array({', '.join(f'{r.trust}D' for r in rules)})"
    score = lambda yes, no, at: f"aggregate(x.v, named_struct('s', 0D, 'k', 0), (t, y) -> named_struct('s', t.s + CASE y WHEN 1 THEN {yes.format('t.k')} WHEN 0 THEN {no.format('t.k')} ELSE 0D END, 'k', t.k + 1), t -> t.s) + {at}"
    good, bad = score("ln(get(p.a, {}))", "ln(1 - get(p.a, {}))", "ln(p.pi)"), score("ln(1 - get(p.b, {}))", "ln(get(p.b, {}))", "ln(1 - p.pi)")
    expect = f"transform(pats, x -> named_struct('v', x.v, 'n', cast(x.n AS double), 'g', 1 / (1 + exp(({bad}) - ({good})))))"
    total = lambda what: f"aggregate(e, 0D, (s, y) -> s + ({what}))"

    def rate(hit: int, w: str, drawn: str, first: str, bounds: tuple[float, float]) -> str:
        hits, cast = total(f"CASE WHEN get(y.v, r) = {hit} THEN {w} ELSE 0D END"), total(f"CASE WHEN get(y.v, r) >= 0 THEN {w} ELSE 0D END")
        return f"transform(sequence(0, {n_rules - 1}), r -> greatest({bounds[0]}D, least({bounds[1]}D, ({hits} + {drawn} * {first}) / ({cast} + {drawn}))))"

    share = f"greatest(0.02D, least(0.98D, ({total('y.n * y.g')} + 1D) / ({total('y.n')} + 2D)))"
    weigh = f"named_struct('e', e, 'good', 4D + {DRAWN}D * {total('y.n * y.g')}, 'bad', 4D + {DRAWN}D * {total('y.n * (1 - y.g)')})"
    inner = f"named_struct('pi', {share}, 'a', {rate(1, 'y.n * y.g', 'q.good', f'get({trust}, r)', GOOD_BOUNDS)}, 'b', {rate(0, 'y.n * (1 - y.g)', 'q.bad', f'{found}D', BAD_BOUNDS)})".replace("aggregate(e,", "aggregate(q.e,")
    fitted = f"get(transform(array({weigh}), q -> {inner}), 0)"
    start = f"named_struct('pi', {prior}D, 'a', {trust}, 'b', array_repeat({found}D, {n_rules}))"
    model = f"aggregate(sequence(1, {rounds}), {start}, (p, k) -> get(transform(array({expect}), e -> {fitted}), 0))"
    row = counted.agg(F.sort_array(F.collect_list(F.struct(F.col("votes").alias("v"), F.col("n")))).alias("pats")).select(F.expr(model).alias("m")).first().m
    return {"pi": row.pi, "a": list(row.a), "b": list(row.b)}


def posterior(vote: Column, model: dict) -> Column:
    """The probability of good, given the votes."""
    from math import log

    logit = F.lit(log(model["pi"] / (1 - model["pi"])))
    for i, (a, b) in enumerate(zip(model["a"], model["b"], strict=True)):
        logit = logit + F.when(vote[i] == 1, F.lit(log(a / (1 - b)))).when(vote[i] == 0, F.lit(log((1 - a) / b))).otherwise(0.0)
    return 1 / (1 + F.exp(-logit))


def judge_quality(docs: DataFrame, rules: tuple[Rule, ...] = RULES, threshold: float = 0.5, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, features, base_failed, quality_probability, kept) of every row.

    base_failed: fewer than 10 words, or more than a fifth of the words in repeated 5-word windows. kept: the posterior reaches the
    threshold, and the base did not fail. Null texts have no words and fail the base. Null ids and repeated rows pass through; other
    columns are not read; an empty table gives no rows. The features are written once; the patterns' counts are the only shuffle.
    """
    scratch = Scratch(docs.sparkSession, "quality")
    found = scratch.put(features(docs, id_col, text_col).withColumn("votes", votes(rules)), "features")
    model = estimate(found.groupBy("votes").agg(F.count(F.lit(1)).alias("n")), rules)
    failed = (F.col("n_words") < 10) | (100 * F.col("n_repeat_words") > 20 * F.col("n_words"))
    out = found.withColumn("base_failed", failed).withColumn("quality_probability", posterior(F.col("votes"), model))
    return out.withColumn("kept", ~F.col("base_failed") & (F.col("quality_probability") >= threshold)).drop("votes", "n_upper")


def oracle_sql(rules: tuple[Rule, ...] = RULES, rounds: int = 60, prior: float = 0.85, found: float = 0.4) -> str:
    """judge_quality over `documents` in DuckDB SQL: features by unnesting, expectation-maximisation by recursion."""
    n = range(len(rules))
    rates = lambda c: ", ".join(f"{c}{i}" for i in n)
    voted = ", ".join(f"CASE WHEN {r.bad} THEN 0 WHEN {r.good} THEN 1 ELSE -1 END AS v{i}" for i, r in enumerate(rules))
    side = lambda yes, no: " + ".join(f"CASE v{i} WHEN 1 THEN ln({yes.format(i)}) WHEN 0 THEN ln({no.format(i)}) ELSE 0 END" for i in n)
    good, bad = f"ln(pi) + {side('a{}', '1 - a{}')}", f"ln(1 - pi) + {side('1 - b{}', 'b{}')}"

    def share(i: int, hit: int, w: str, first: float, bounds: tuple[float, float]) -> str:
        drawn = f"(4 + {DRAWN} * sum({w}))"
        return f"greatest({bounds[0]}, least({bounds[1]}, (coalesce(sum({w}) FILTER (v{i} = {hit}), 0) + {drawn} * {first}) / (coalesce(sum({w}) FILTER (v{i} >= 0), 0) + {drawn})))"

    a = ", ".join(share(i, 1, "n * g", r.trust, GOOD_BOUNDS) for i, r in enumerate(rules))
    b = ", ".join(share(i, 0, "n * (1 - g)", found, BAD_BOUNDS) for i in n)
    return rf"""
        WITH RECURSIVE words AS (SELECT doc_id, coalesce(text, '') AS t, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents),
        grams AS (SELECT doc_id, i, array_to_string(w[i:i + 4], ' ') AS g FROM (SELECT doc_id, w, unnest(generate_series(1, len(w) - 4)) AS i FROM words)),
        twice AS (SELECT doc_id, i FROM grams QUALIFY count(*) OVER (PARTITION BY doc_id, g) > 1),
        covered AS (SELECT doc_id, count(DISTINCT i + k) AS n FROM twice, generate_series(0, 4) AS s(k) GROUP BY 1),
        lined AS (SELECT *, [x for x in string_split(t, chr(10)) if regexp_matches(x, '[^\x20\x09-\x0D]')] AS ls FROM words),
        features AS (
            SELECT doc_id, len(w) AS n_words, length(regexp_replace(t, '[\x20\x09-\x0D]+', '', 'g')) AS word_chars, length(regexp_replace(t, '[^#*$%&|<>]', '', 'g')) AS n_symbols,
                   length(regexp_replace(t, '[^A-Z]', '', 'g')) AS n_upper, len(ls) - len(list_distinct(ls)) AS n_dup_lines, coalesce(c.n, 0) AS n_repeat_words
            FROM lined LEFT JOIN covered c USING (doc_id)),
        voted AS (SELECT *, {voted} FROM features),
        patterns AS (SELECT {rates("v")}, count(*) AS n FROM voted GROUP BY ALL),
        em(k, pi, {rates("a")}, {rates("b")}) AS (
            SELECT 0, CAST({prior} AS DOUBLE), {", ".join(f"CAST({r.trust} AS DOUBLE)" for r in rules)}, {", ".join(f"CAST({found} AS DOUBLE)" for _ in rules)}
            UNION ALL
            SELECT k + 1, greatest(0.02, least(0.98, (sum(n * g) + 1) / (sum(n) + 2))), {a}, {b}
            FROM (SELECT *, 1 / (1 + exp(({bad}) - ({good}))) AS g FROM em, patterns WHERE k < {rounds}) GROUP BY k),
        judged AS (
            SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, n_words < 10 OR 100 * n_repeat_words > 20 * n_words AS base_failed, 1 / (1 + exp(({bad}) - ({good}))) AS p
            FROM voted, (SELECT * FROM em WHERE k = {rounds}))
        SELECT * EXCLUDE (p), round(p, 6) AS quality_probability, NOT base_failed AND p >= 0.5 AS kept FROM judged"""
