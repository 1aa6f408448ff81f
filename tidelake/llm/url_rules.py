"""URL filters by a bit-parallel wildcard automaton.

All glob rules are packed into one bit vector of as many 64-bit words as they need. A rule has a state before each of its letters and
one behind the last; a star is a loop on its state. Reading byte c of the canonical URL moves every rule at once:

    D = (D << 1 & B[c]) | (D & S[c])

with B the letters that lead into states, S the loops. The words of many URLs are moved together, carries pass between words.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidelake.llm.shared import tidy


@dataclass(frozen=True)
class Rule:
    """verdict allow or block, for host (with all its subdomains) and the paths that start with path. Both may hold * as a wildcard;
    in the host it stops at the slash."""

    verdict: str
    host: str
    path: str

    @property
    def name(self) -> str:
        return self.host + self.path


class GlobAutomaton:
    """Rules over canonical URLs: a dot, the host, the path. The leading dot makes a host and its subdomains one case."""

    def __init__(self, rules: list[Rule]):
        self.rules = rules
        letters, loops, starts, finals = [], [], [], []
        for r in rules:
            starts.append(len(letters))
            letters.append(None)
            loops.append("host")  # whatever subdomains come first
            for part, kind in ((f".{r.host}", "host"), (r.path, "any")):
                for c in part.encode():
                    if c == ord("*"):
                        loops[-1] = kind
                    else:
                        letters.append(c)
                        loops.append(None)
            loops[-1] = "any"  # a path is fitted by its start
            finals.append(len(letters) - 1)
        self.words = max(1, -(-len(letters) // 64))
        self.moves, self.stays = np.zeros((257, self.words), np.uint64), np.zeros((257, self.words), np.uint64)
        for i, (c, loop) in enumerate(zip(letters, loops, strict=True)):
            bit = np.uint64(1 << (i % 64))
            if c is not None:
                self.moves[c, i // 64] |= bit
            for x in range(256) if loop else ():
                if loop == "any" or x != ord("/"):
                    self.stays[x, i // 64] |= bit
        self.stays[256] = ~np.uint64(0)  # behind the end of a URL nothing moves
        self.first = np.zeros(self.words, np.uint64)
        for i in starts:
            self.first[i // 64] |= np.uint64(1 << (i % 64))
        self.finals = finals

    def match(self, urls: list[bytes]) -> np.ndarray:
        """Which rules fit which canonical URLs: a boolean for each pair."""
        out = np.zeros((len(urls), len(self.rules)), bool)
        order = sorted(range(len(urls)), key=lambda i: len(urls[i]))
        while order:
            longest = len(urls[order[-1]])
            n = max(1, min(len(order), 2_000_000 // max(longest, 1)))
            part, order = order[-n:], order[:-n]
            out[part] = self._match([urls[i] for i in part], longest)
        return out

    def _match(self, urls: list[bytes], longest: int) -> np.ndarray:
        codes = np.full((longest, len(urls)), 256, np.int16)
        for k, u in enumerate(urls):
            codes[: len(u), k] = np.frombuffer(u, np.uint8)
        d = np.tile(self.first, (len(urls), 1))
        one, top = np.uint64(1), np.uint64(63)
        for c in codes:
            moved = d << one
            moved[:, 1:] |= d[:, :-1] >> top
            d = (moved & self.moves[c]) | (d & self.stays[c])
        return np.stack([(d[:, i // 64] >> np.uint64(i % 64)) & one == one for i in self.finals], 1) if self.finals else np.zeros((len(urls), 0), bool)


def host_of(url: Column) -> Column:
    """After the first :// up to /, ?, # or the end, A-Z lower-cased; empty for null and where there is no ://."""
    host = F.regexp_extract(url, r"(?s)^.*?://([^/?#]*)", 1)
    return F.coalesce(F.translate(host, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"), F.lit(""))


def path_of(url: Column) -> Column:
    """From the end of the host up to ?, # or the end."""
    return F.coalesce(F.regexp_extract(url, r"(?s)^.*?://[^/?#]*([^?#]*)", 1), F.lit(""))


def judge_urls(pages: DataFrame, rules: list[Rule], id_col: str = "page_id", url_col: str = "url", default: str = "allow") -> DataFrame:
    """(id, host, path, rule, verdict) of every row: the longest rule that fits decides, the first of equals; without one, default.

    A null url and one without :// have an empty host and path, which no rule fits. Null ids and repeated rows pass through; other
    columns are not read. One narrow pass, no shuffle.
    """
    cut = pages.select(F.col(id_col), host_of(F.col(url_col)).alias("host"), path_of(F.col(url_col)).alias("path"))
    kind = dict(cut.dtypes)[id_col]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        automaton = GlobAutomaton(rules)
        sizes = np.array([len(r.name) for r in rules] or [0])
        for batch in batches:
            for i in range(0, batch.num_rows, 4096):
                part = batch.slice(i, 4096)
                urls = [b"." + (h or b"") + (p or b"") for h, p in zip(part.column(1).cast(pa.binary()).to_pylist(), part.column(2).cast(pa.binary()).to_pylist(), strict=True)]
                fits = automaton.match(urls)
                best = np.where(fits, sizes[: fits.shape[1]], -1)
                best = np.where(fits.any(1), best.argmax(1), -1) if fits.shape[1] else np.full(len(urls), -1)
                names = pa.array([rules[k].name if k >= 0 else None for k in best], pa.string())
                said = pa.array([rules[k].verdict if k >= 0 else default for k in best], pa.string())
                yield pa.RecordBatch.from_arrays([*part.columns, names, said], names=[id_col, "host", "path", "rule", "verdict"])

    return cut.mapInArrow(tidy(run), f"`{id_col}` {kind}, host string, path string, rule string, verdict string")
