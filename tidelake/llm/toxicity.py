"""Toxicity by a weighted finite-state pattern grammar.

A text is read as clauses. A lexicon transducer, a trie over the letters of a word, turns each word into a symbol and a weight: insult, threat, target,
agent, person (agent or target), negation, report or other. The grammar has two machines over these symbols, one that reads a clause forwards and one that reads it
backwards; each is the composition of small transducers, and a word's weight is multiplied by what both say where they pass it:

    insult      weighs little by itself; a target before it, or behind it, doubles it
    threat      a verb counts only with a target behind it, and fully only with an agent before it: agent, verb, target
    negation    before, or shortly behind, discounts
    report      before or behind discounts what is reported; the speaker is no target

Matched clauses are scored, not single words, and a logistic model over the clause scores gives the document's score.

Built-in words cover general insults and the function words. Further insult stems, in whatever language, are learned from labels: word
beginnings that occur in far more toxic than clean documents. The labelled sample is bounded by a parameter.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field
from itertools import product

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidelake.llm.shared import Scratch, tidy

OTHER, INSULT, THREAT, TARGET, AGENT, PERSON, NEGATION, REPORT = range(8)

INSULTS = "idiot moron stupid dumb fool imbecile scum trash garbage loser pathetic worthless disgusting clown filth vermin parasite coward liar jerk bastard".split()
THREATS = "kill murder destroy hurt beat strangle shoot burn crush".split()
TARGETS = "you your yourself u him her them his their those these people tu vous toi ton votre du dich dir euch ihr usted ustedes".split()
AGENTS = "i we someone somebody ill gonna je nous ich wir yo nosotros".split()
PERSONS = "he she they il elle ils sie ellos ella".split()
NEGATIONS = "not no never nobody nor neither isn aren wasn weren don doesn didn without pas jamais sans nicht nie kein keine ohne nunca jamás sin".split()
REPORTS = "said says say told tells wrote writes called calls reported claimed quoted alleged dit disait sagte sagt schrieb dijo dice decía".split()

#: Words, quotation marks, and the ends of clauses.
TOKEN = re.compile(r"[^\W_]+|[.!?;:\n]+")
ENDS = frozenset(".!?;:\n")


class Lexicon:
    """The lexicon transducer: the longest beginning of a word that leads to a final state gives its symbol and weight."""

    def __init__(self, stems: dict[str, float], whole: dict[str, tuple[int, float]]):
        self.trie: dict = {}
        for word, (symbol, weight) in whole.items():
            self._add(word, True, symbol, weight)
        for stem, weight in stems.items():
            self._add(stem, False, INSULT, weight)
        self.seen: dict[str, tuple[int, float] | None] = {}

    def _add(self, word: str, whole: bool, symbol: int, weight: float) -> None:
        node = self.trie
        for c in word:
            node = node.setdefault(c, {})
        node["whole" if whole else "stem"] = (symbol, weight)

    def read(self, word: str) -> tuple[int, float] | None:
        node, out = self.trie, None
        for c in word:
            node = node.get(c)
            if node is None:
                return out
            out = node.get("stem", out)
        return node.get("whole", out)

    def symbols(self, tokens: list[str]) -> list[tuple[int, float] | None]:
        """read() of every token, by way of a bounded memo."""
        seen = self.seen
        if len(seen) > 200_000:
            seen.clear()
        for w in set(tokens):
            if w not in seen:
                seen[w] = self.read(w)
        return list(map(seen.__getitem__, tokens))


@dataclass
class Transducer:
    """Deterministic, over the symbols: moves[state][symbol] = (next state, factor on the weight of the symbol)."""

    moves: list[list[tuple[int, float]]] = field(default_factory=list)

    def __mul__(self, other: Transducer) -> Transducer:
        """The composition: both read the same symbols, and factors multiply."""
        n = len(other.moves)
        out = Transducer()
        for a, b in product(range(len(self.moves)), range(n)):
            row = []
            for s in range(8):
                (x, f), (y, g) = self.moves[a][s], other.moves[b][s]
                row.append((x * n + y, f * g))
            out.moves.append(row)
        return out

    def read(self, symbols: list[int]) -> list[float]:
        """The factor at every symbol."""
        state, out, moves = 0, [], self.moves
        for s in symbols:
            state, factor = moves[state][s]
            out.append(factor)
        return out


def within(openers: tuple[int, ...], reach: int, on: tuple[int, ...], factor: float, otherwise: float = 1.0, closers: tuple[int, ...] = (), pause: int = 0) -> Transducer:
    """For `reach` symbols after an opener, symbols `on` weigh `factor` times their weight, elsewhere `otherwise` times. A closer ends the reach, and
    for `pause` symbols behind it nothing opens."""
    out = Transducer()
    for state in range(reach + pause + 1):  # up to reach: symbols that are left; above: pauses that are left
        open_, paused = (state, 0) if state <= reach else (0, state - reach)
        row = []
        for s in range(8):
            if s in closers:
                after = reach + pause if pause else 0
            elif s in openers and not paused:
                after = reach
            else:
                after = max(0, open_ - 1) if not paused else (state - 1 if paused > 1 else 0)
            row.append((after, (factor if open_ else otherwise) if s in on else 1.0))
        out.moves.append(row)
    return out


HARM, WHO = (INSULT, THREAT), (TARGET, PERSON)
#: Read forwards: negation over three words, a report over a short clause, a target over four words, a threat's agent over four.
FORWARDS = within((NEGATION,), 3, HARM, 0.25) * within((REPORT,), 12, HARM, 0.5) * within(WHO, 4, (INSULT,), 2.0, closers=(REPORT,)) * within((AGENT, PERSON), 4, (THREAT,), 1.0, otherwise=0.25)
#: Read backwards: negation over three words, a report, whose speaker stands before it, a target over four words, a threat's target over three.
BACKWARDS = (
    within((NEGATION,), 3, HARM, 0.5)
    * within((REPORT,), 12, HARM, 0.5)
    * within(WHO, 4, (INSULT,), 2.0, closers=(REPORT,), pause=2)
    * within(WHO, 3, (THREAT,), 1.0, otherwise=0.0, closers=(REPORT,), pause=2)
)


@dataclass
class Model:
    """What scoring needs: learned stems with their weights beside a target, and the logistic model over FEATURES. left_out: near copies that the fit left out."""

    stems: dict[str, float]
    coefficients: list[float]
    threshold: float = 0.3

    left_out: int = 0

    def lexicon(self) -> Lexicon:
        whole = {w: (symbol, 0.0) for symbol, words in ((REPORT, REPORTS), (NEGATION, NEGATIONS), (TARGET, TARGETS), (AGENT, AGENTS), (PERSON, PERSONS)) for w in words}
        whole |= {w: (THREAT, 4.0) for w in THREATS}
        # a built-in insult weighs what the labels say, or else a moderate weight; alone half of it
        whole |= {w: (INSULT, 1.5) for w in INSULTS if not any(w.startswith(s) for s in self.stems)}
        return Lexicon({s: w / 2 for s, w in self.stems.items()}, whole)


FEATURES = ("bias", "log_total", "best_clause", "clauses", "density", "distinct")
#: Used where there are no labels to learn from.
DEFAULT = [-3.0, 0.8, 0.4, 0.2, 0.2, 0.3]


@dataclass(frozen=True)
class Clause:
    first: int
    last: int
    score: float


def matched_clauses(text: str, lexicon: Lexicon, forwards: Transducer = FORWARDS, backwards: Transducer = BACKWARDS) -> tuple[list[Clause], int, int]:
    """Clauses with a score above 0 (by token indexes), the distinct matched words, and the number of words."""
    tokens = TOKEN.findall(text.lower())
    read = lexicon.symbols(tokens)
    hits = [i for i, x in enumerate(read) if x is not None and x[0] in HARM]
    if not hits:
        return [], 0, len(tokens)
    out, done, words = [], -1, set()
    for hit in hits:
        if hit <= done:
            continue
        a = b = hit
        while a > 0 and tokens[a - 1][0] not in ENDS:
            a -= 1
        while b < len(tokens) and tokens[b][0] not in ENDS:
            b += 1
        symbols = [OTHER if x is None else x[0] for x in read[a:b]]
        before, behind = forwards.read(symbols), backwards.read(symbols[::-1])[::-1]
        done, score = b, 0.0
        for i in range(a, b):
            if symbols[i - a] in HARM and (weight := read[i][1] * before[i - a] * behind[i - a]) > 0:
                score += weight
                words.add(tokens[i])
        if score > 0:
            out.append(Clause(a, b - 1, score))
    return out, len(words), len(tokens)


def clause_features(text: str, lexicon: Lexicon) -> list[float]:
    clauses, distinct, n = matched_clauses(text, lexicon)
    scores = [c.score for c in clauses]
    total = sum(scores)
    return [1.0, math.log1p(total), math.log1p(max(scores, default=0.0)), math.log1p(len(scores)), math.log1p(100 * total / (n + 20)), math.log1p(distinct)]


def fold(id_col: Column) -> Column:
    """crc32 of the id as text, modulo 4. A null id gives null."""
    return F.crc32(id_col.cast("string").cast("binary")) % 4


def one_of_copies(sample: DataFrame, similarity: float = 0.4) -> DataFrame:
    """Of near copies with the same label the one with the smallest id: else the words of a text that is copied often would pass for insults, or for clean ones.

    Near copies mostly share the least hash of three words running; of those that do, a document is left out if its sets of three words and that of one
    that stays have a Jaccard similarity of 0.4 (similarity) or more."""
    w = F.split(F.lower("_t"), r"\s+")
    threes = F.expr("array_distinct(transform(sequence(0, greatest(0, size(_w) - 3)), i -> xxhash64(get(_w, i), get(_w, i + 1), get(_w, i + 2))))")
    keyed = sample.withColumn("_w", w).withColumn("_s", threes).withColumn("_k", F.coalesce(F.array_min("_s"), F.lit(0))).drop("_w")

    columns = sample.columns

    def keep(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["_id", "_t"])
        stay, having, sizes = [], {}, []
        for i, s in enumerate(pdf["_s"]):
            shared = Counter(k for x in s.tolist() for k in having.get(x, ()))
            if any(n >= similarity * (sizes[k] + len(s) - n) for k, n in shared.items()):
                continue
            for x in s.tolist():
                having.setdefault(x, []).append(len(sizes))
            sizes.append(len(s))
            stay.append(i)
        return pdf.iloc[stay][columns]

    return keyed.groupBy("_y", "_k").applyInPandas(keep, sample.schema)


#: Behind a beginning: documents with two or more words that begin so.
TWICE = "+"


def _stems_of(text: str) -> set[str]:
    words = Counter(w for w in TOKEN.findall(text.lower()) if w[0] not in ENDS)
    found: Counter = Counter()
    for w, n in words.items():
        for k in range(3, min(len(w), 9) + 1):
            found[w[:k]] += n
    return {*found, *(s + TWICE for s, n in found.items() if n > 1)}


def learn(
    docs: DataFrame,
    labels: DataFrame,
    label_col: str = "toxic",
    held_out: int | None = 2,
    most_rows: int = 8000,
    most_stems: int = 4000,
    copies: float | None = 0.4,
    id_col: str = "doc_id",
    text_col: str = "text",
) -> Model:
    """Fits the model on at most about most_rows labelled documents, chosen by a hash of the id (the bound is on the expected number).

    Rows of the fold held_out (crc32 of the id modulo 4) are never read. The stems come from all other folds; the logistic model is fitted by clause scores that
    each fold gets from the stems of the other ones, so it does not see words that were learned from the very documents it is fitted to. Several labels of
    one id count as their largest, null labels not at all. The sample's ids are broadcast, as the bound makes them small; what reaches the
    driver is counts of at most the sample's word beginnings, and a row of features for each sampled document. Of near copies (Jaccard similarity
    of three words of `copies` or more) one is read, None: all of them; the model tells how many were left out.
    """
    known = labels.select(F.col(id_col).alias("_id"), F.col(label_col).cast("int").alias("_y")).where("_id IS NOT NULL AND _y IS NOT NULL").groupBy("_id").agg((F.max("_y") > 0).cast("int").alias("_y"))
    known = known.withColumn("_fold", fold(F.col("_id")))
    if held_out is not None:
        known = known.where(F.col("_fold") != held_out)
    n = known.count()
    if n > most_rows:
        known = known.where(F.pmod(F.xxhash64("_id"), F.lit(1_000_000)) < int(1_000_000 * most_rows / n))
    sample = docs.select(F.col(id_col).alias("_id"), F.coalesce(F.col(text_col), F.lit("")).alias("_t")).join(F.broadcast(known), "_id")
    scratch = Scratch(docs.sparkSession, "toxicity")
    drawn = scratch.put(sample, "drawn")
    sample = scratch.put(one_of_copies(drawn, copies), "sample") if copies is not None else drawn
    left_out = drawn.count() - sample.count()

    def stems(label: int, wanted: set[str] | None) -> DataFrame:
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                for i in range(0, batch.num_rows, 256):
                    found: Counter = Counter()
                    part = batch.slice(i, 256)
                    for t, f in zip(part.column(0).to_pylist(), part.column(1).to_pylist(), strict=True):
                        s = _stems_of(t)
                        found.update((x, f) for x in (s if wanted is None else s & wanted))
                        found["", f] += 1
                    yield pa.RecordBatch.from_pydict({"stem": [x for x, _ in found], "fold": [f for _, f in found], "n": list(found.values())})

        return sample.where(F.col("_y") == label).select("_t", "_fold").mapInArrow(tidy(run), "stem string, fold long, n long").groupBy("stem", "fold").agg(F.sum("n").alias("n"))

    toxic = scratch.put(stems(1, None), "stems")
    n1 = {r.fold: r.n for r in toxic.where("stem = ''").collect()}
    often = toxic.groupBy("stem").agg(F.sum("n").alias("all")).where(F.col("all") >= max(4, 0.005 * sum(n1.values())))
    df1 = {(r.stem, r.fold): r.n for r in toxic.join(often, "stem").collect() if r.stem}
    df0 = {(r.stem, r.fold): r.n for r in stems(0, {x for x, _ in df1}).collect()}
    n0 = {f: n for (x, f), n in df0.items() if not x}

    def chosen(without: int | None) -> dict[str, float]:
        """The stems that the folds but one give."""
        counts = []
        for df in (df1, df0):
            total: Counter = Counter()
            for (x, f), n in df.items():
                if x and f != without:
                    total[x] += n
            counts.append(total)
        n_toxic, n_clean = (sum(n for f, n in found.items() if f != without) for found in (n1, n0))
        least = max(4, 0.005 * n_toxic)
        return choose_stems({x: n for x, n in counts[0].items() if n >= least}, counts[1], n_toxic, n_clean, most_stems)

    learned = chosen(None)
    others = {f: chosen(f) for f in sorted({*n1, *n0})}

    def measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lexicons = {f: Model(s, DEFAULT).lexicon() for f, s in others.items()}
        for batch in batches:
            rows = [clause_features(t, lexicons[f]) for t, f in zip(batch.column(0).to_pylist(), batch.column(2).to_pylist(), strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column(1), pa.array(rows, pa.list_(pa.float64()))], names=["y", "x"])

    rows = sample.select("_t", "_y", "_fold").mapInArrow(tidy(measure), "y int, x array<double>").collect()
    if not rows or not 0 < sum(r.y for r in rows) < len(rows):
        return Model(learned, DEFAULT, left_out=left_out)
    rows.sort(key=lambda r: (r.y, r.x))
    return Model(learned, fit_logistic(np.array([r.x for r in rows]), np.array([r.y for r in rows], float)), left_out=left_out)


def choose_stems(df1: dict[str, int], df0: dict[str, int], n1: int, n0: int, most: int) -> dict[str, float]:
    """Beginnings that the labels hold against a document: log-odds of at least 1.2, and a likelihood ratio that chance doesn't give.

    Longest first, and a beginning must show in documents that have it twice (an insult is repeated, a common word that starts like it rarely), or do without the toxic documents of the chosen one that begins with it and is in most of them: else a common
    word would stand for the insult that happens to start like it. Of the chosen, a longer one that says no more than a shorter one is left out, and
    each is drawn out by letters that follow it in nearly all toxic documents, so that it stands for as few other words as can be.
    """

    def weigh(a: float, b: int) -> tuple[float, float]:
        p = (a + b) / max(n1 + n0, 1)
        cells = ((a, n1 * p), (b, n0 * p), (n1 - a, n1 * (1 - p)), (n0 - b, n0 * (1 - p)))
        return math.log((a + 0.5) / (n1 + 1) * (n0 + 1) / (b + 0.5)), 2 * sum(x * math.log(x / e) for x, e in cells if x > 0 and e > 0)

    chosen: dict[str, float] = {}
    longer: Counter = Counter()
    twice = {s[:-1]: n for s, n in df1.items() if s.endswith(TWICE)}
    df1 = {s: n for s, n in df1.items() if not s.endswith(TWICE)}
    for s in sorted(df1, key=lambda s: (-len(s), s)):
        own = weigh(df1[s], df0.get(s, 0))
        rest = weigh(df1[s] - longer[s], df0.get(s, 0)) if longer[s] else own
        # one that is in no more clean documents than chance is as good as the longer one, and shorter; so is one that toxic documents without the longer one repeat
        left = twice.get(s, 0) - longer[s]
        repeated = weigh(left, df0.get(s + TWICE, 0)) if left > 0 else (-9.0, 0.0)
        often = repeated[0] >= 2.5 and repeated[1] >= 16
        if min(own[0], max(rest[0], own[0] if df0.get(s, 0) <= 0.002 * n0 or often else -9.0)) < 1.2 or own[1] < 16:
            continue
        chosen[s] = round(own[0], 4)
        for k in range(3, len(s)):
            longer[s[:k]] = max(longer[s[:k]], df1[s])
    out: dict[str, float] = {}
    for s in sorted(chosen, key=lambda s: (len(s), s)):
        shorter = next((out[s[:k]] for k in range(len(s) - 1, 2, -1) if s[:k] in out), None)
        if shorter is None or chosen[s] > shorter + 0.3:
            out[s] = chosen[s]
    longer_by: dict[str, list[str]] = {}
    for t in df1:
        longer_by.setdefault(t[:-1], []).append(t)
    exact: dict[str, float] = {}
    for s in out:
        while step := [t for t in longer_by.get(s, ()) if df1[t] >= 0.97 * df1[s]]:
            s = step[0]
        exact[s] = round(weigh(df1[s], df0.get(s, 0))[0], 4)
    return dict(sorted(exact.items(), key=lambda x: (-df1[x[0]], x[0]))[:most])


def fit_logistic(x: np.ndarray, y: np.ndarray, ridge: float = 0.5, rounds: int = 50) -> list[float]:
    """Logistic regression by Newton's method."""
    w, penalty = np.zeros(x.shape[1]), np.diag([0.01] + [ridge] * (x.shape[1] - 1))
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        step = np.linalg.solve(x.T @ (x * (p * (1 - p))[:, None]) + penalty, x.T @ (y - p) - penalty @ w)
        w = w + step
        if np.abs(step).max() < 1e-9:
            break
    return [float(round(v, 9)) for v in w]


def score_toxicity(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of docs with toxicity double (0 to 1), toxic int (1 from the model's threshold on) and toxic_clauses (their number, int).

    A null or empty text has no clauses and the score of such. Labels, languages, sources and ids are not looked at. Null ids and repeated
    rows pass through; input columns named like the new ones are replaced. One narrow pass, no shuffle.
    """
    new = ["toxicity", "toxic", "toxic_clauses"]
    docs = docs.drop(*[c for c in docs.columns if c in new])
    clash = {c: f"_{i}" for i, c in enumerate(docs.columns)}
    moved = docs.select(*[F.col(f"`{c}`").alias(a) for c, a in clash.items()])
    schema = ", ".join(f"`{a}` {t}" for a, t in moved.dtypes) + ", toxicity double, toxic int, toxic_clauses int"
    at = docs.columns.index(text_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lexicon, w = model.lexicon(), np.array(model.coefficients)
        for batch in batches:
            for i in range(0, batch.num_rows, 512):
                part = batch.slice(i, 512)
                x = np.array([clause_features(t or "", lexicon) for t in part.column(at).to_pylist()])
                score = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
                n = np.rint(np.expm1(x[:, 3])).astype(np.int32)
                yield pa.RecordBatch.from_arrays(
                    [*part.columns, pa.array(score), pa.array((score >= model.threshold).astype(np.int32)), pa.array(n)], names=[*part.schema.names, *new]
                )

    return moved.mapInArrow(tidy(run), schema).select(*[F.col(a).alias(c) for c, a in clash.items()], *new)
