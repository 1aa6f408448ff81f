"""Line dedup by winnowing.

The unit that is hashed is a run of `gram` words, not a line as it stands: a passage that begins and ends inside lines holds no whole line, or none that
another document has. Of the hashes in a window of min_words words the least is selected; neighbouring windows mostly agree on it, so a text has few
distinct minima, and two texts that share min_words words running share the window, hence its minimum: fingerprints are guaranteed.

A fingerprint stands for a stretch of neighbouring windows, and the words that these cover are its context, named by their hash. Positions are joined by
that name: where a whole context occurs earlier in the corpus, all its windows do, and the first place of a context stands for all. Only where one fingerprint has several
contexts, as at the ends of a shared passage and beside a changed word, windows are told apart one by one, each by its own hash, and only those of the contexts'
first places. Matches so extend both ways, context by context and then window by window, as far as an earlier place goes along, and the words of the
later places are deleted. Earlier is by document id, then by the text's hash, then by position. A word goes only where an earlier place holds its run, so the first
occurrence always stays, also where a run overlaps its own source in a text that repeats itself.
"""

from __future__ import annotations

import itertools
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidelake.llm.shared import Scratch, flat_hashes, join_counted, powers, tidy, word_places

_MIX = 0x9E3779B97F4A7C15


def run_hashes(words: np.ndarray, n: int) -> np.ndarray:
    """The hash of the n words from each word on."""
    if n == 1:
        return words
    k, m = n // 2, max(0, len(words) - n + 1)
    half = run_hashes(words, k)
    out = half[:m] + np.uint64(pow(_MIX, k, 1 << 64)) * half[k : k + m]
    return out if n == 2 * k else out + np.uint64(pow(_MIX, 2 * k, 1 << 64)) * words[2 * k : 2 * k + m]


def least_of(values: np.ndarray, n: int) -> np.ndarray:
    """The least of the n values from each place on."""
    have = 1
    while have < n:
        step = min(have, n - have)
        values = np.minimum(values[:-step], values[step:]) if len(values) > step else values[:0]
        have += step
    return values


def winnow(words: np.ndarray, n: int, gram: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of every window of n words the hash and the least hash of its runs of `gram` words, both signed; and the hashes of all these runs."""
    if len(words) < n:
        return (np.zeros(0, np.int64),) * 3
    runs = run_hashes(words, gram) * np.uint64(0xFF51AFD7ED558CCD)
    runs ^= runs >> np.uint64(32)
    runs = (runs * np.uint64(0xC4CEB9FE1A85EC53)).view(np.int64)
    return run_hashes(words, n).view(np.int64), least_of(runs, n - gram + 1), runs


def contexts(words: np.ndarray, cuts: np.ndarray, n: int, gram: int) -> tuple[np.ndarray, ...]:
    """For each stretch of neighbouring windows of one text with one minimum: the text, the minimum, the hash of all words that the windows cover, the first window
    and their number; and of all windows the hash and the text. words: those of many texts, each from a cut to the next."""
    whole, least, _ = winnow(words, n, gram)
    windows = np.maximum(np.diff(cuts) - n + 1, 0)
    text, at = np.repeat(np.arange(len(windows)), windows), spread_out(cuts[:-1], windows)
    least = least[at]
    first = np.flatnonzero(np.concatenate([np.ones(min(1, len(at)), bool), (least[1:] != least[:-1]) | (text[1:] != text[:-1])]))
    count = np.diff(np.append(first, len(at)))
    up, down = powers(max(1 << 19, 1 << len(words).bit_length()))
    sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum(words * up[: len(words)], dtype=np.uint64)])
    a = at[first]
    covered = (sums[a + count + n - 1] - sums[a]) * down[a] + count.astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93)
    return text[first], least[first], (covered ^ (covered >> np.uint64(31))).view(np.int64), a - cuts[text[first]], count, whole[at], text


def own_repeats(whole: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Stretches of windows that the text itself has before: the first window and the number of each."""
    ordered = np.sort(whole)
    if not (ordered[1:] == ordered[:-1]).any():
        return (np.zeros(0, np.int64),) * 2
    _, first, which = np.unique(whole, return_index=True, return_inverse=True)
    again = np.concatenate([[False], first[which] < np.arange(len(whole)), [False]])
    edge = np.flatnonzero(again[1:] != again[:-1])
    return edge[::2], edge[1::2] - edge[::2]


def spread_out(a: np.ndarray, n: np.ndarray) -> np.ndarray:
    """The n numbers from each a on."""
    return np.repeat(a - np.cumsum(n) + n, n) + np.arange(n.sum())


def dedup_words(docs: DataFrame, min_words: int = 50, gram: int = 10, id_col: str = "doc_id", text_col: str = "text", chars_col: str | None = "n_chars") -> DataFrame:
    """The rows of docs without the words that stand in a run of min_words words which an earlier place has, and removed_lines, removed_words (long) and
    removed_runs array<struct<first_line, last_line, source>>: the lines of the old text that a run touches, both included, and the document that has
    it earlier. removed_lines counts the lines that lose all their words. The text's length in chars_col follows, where docs have that column.

    Words are what ASCII white space parts, and equal where the lines and blanks between them differ. A null text stays null, a text whose words all go
    becomes empty; no row is dropped. Runs below min_words words stay. A document's own repeats count. Rows with equal ids and texts are one place; of equal
    ids with different texts the one with the smaller hash is earlier. Rows with a null id are left as they are. Ids are numbers, or texts of such. Input
    columns named like the new ones are replaced.

    Three passes over the texts: for the fingerprints, for the windows of contested contexts, and for the cut. A context in m documents makes m short rows,
    which meet its first place alone; those of very common contexts and fingerprints are not shuffled to one task.
    """
    gram = min(gram, min_words)
    scratch = Scratch(docs.sparkSession, "words")
    new = ["removed_lines", "removed_words", "removed_runs"]
    docs = docs.drop(*[c for c in docs.columns if c in new])
    kept = docs.columns
    texts = docs.where(F.col(id_col).isNotNull() & F.col(text_col).isNotNull()).select(F.col(id_col).cast("long").alias("id"), F.xxhash64(text_col).alias("t"), F.col(text_col).alias("x"))

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """(id, t, f, c, a, n): a fingerprint, its context's name, and its windows, from word a on. Repeats within a text have no f and c."""
        for batch in batches:
            for i in range(0, batch.num_rows, 512):
                part = batch.slice(i, 512)
                k, t = (part.column(c).to_numpy(zero_copy_only=False) for c in (0, 1))
                words, cuts = flat_hashes(part.column(2).to_pylist())
                rows: list[tuple[np.ndarray, ...]] = []
                r = 0
                while r < part.num_rows:  # some texts at a time, whose hashes fit the processor's cache
                    end = max(r + 1, int(np.searchsorted(cuts, cuts[r] + (1 << 15), "right")) - 1)
                    text, f, c, a, n, whole, of = contexts(words[cuts[r] : cuts[end]], cuts[r : end + 1] - cuts[r], min_words, gram)
                    rows.append((text + r, f, c, a, n))
                    for x, (lo, hi) in enumerate(itertools.pairwise(np.searchsorted(of, np.arange(end - r + 1)).tolist())):
                        own, own_n = own_repeats(whole[lo:hi])
                        if len(own):
                            none = np.full(len(own), np.iinfo(np.int64).min)
                            rows.append((np.full(len(own), x + r), none, none, own, own_n))
                    r = end
                cols = [np.concatenate(x) for x in zip(*rows, strict=True)]
                none = cols[2] == np.iinfo(np.int64).min
                yield pa.RecordBatch.from_arrays([pa.array(k[cols[0]]), pa.array(t[cols[0]]), pa.array(cols[1], mask=none), pa.array(cols[2], mask=none), pa.array(cols[3], pa.int32()), pa.array(cols[4], pa.int32())], names=["id", "t", "f", "c", "a", "n"])

    marks = scratch.put(texts.mapInArrow(tidy(scan), "id long, t long, f long, c long, a int, n int"), "marks")
    own = marks.where("c IS NULL").select("id", "t", "a", "n", F.col("id").alias("src"))
    shared = marks.where("c IS NOT NULL")
    classes = shared.groupBy("c").agg(F.max("f").alias("f"), F.min(F.struct("id", "t", "a", "n")).alias("first"), F.count(F.lit(1)).alias("k"))
    classes = scratch.put(classes, "classes")
    again = join_counted(shared.select("c", "id", "t", "a", "n"), classes.where("k > 1").select("c", "k", F.col("first.id").alias("src"), F.col("first.t").alias("src_t")), "c", "k")
    again = again.where("src < id OR (src = id AND src_t < t)").select("id", "t", "a", "n", "src")

    contested = scratch.put(classes.groupBy("f").agg(F.count(F.lit(1)).alias("m")).where("m > 1"), "contested")
    unsure = join_counted(classes.select("f", "first.id", "first.t", "first.a", "first.n"), contested, "f", "m")
    unsure = unsure.groupBy("id", "t").agg(F.collect_set(F.struct("a", "n")).alias("spans"))

    def spread(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """The windows of contested contexts, one by one."""
        for batch in batches:
            for i in range(0, batch.num_rows, 256):
                part = batch.slice(i, 256)
                words, cuts = flat_hashes(part.column(2).to_pylist())
                spans, each = part.column(3).flatten(), part.column(3).value_lengths().to_numpy()
                n = spans.field("n").to_numpy()
                text = np.repeat(np.repeat(np.arange(part.num_rows), each), n)
                at = spread_out(spans.field("a").to_numpy(), n)
                whole = run_hashes(words, min_words).view(np.int64)[at + cuts[text]]
                k, t = (part.column(c).to_numpy() for c in (0, 1))
                yield pa.RecordBatch.from_arrays([pa.array(whole), pa.array(k[text]), pa.array(t[text]), pa.array(at, pa.int32())], names=["h", "id", "t", "a"])

    windows = texts.dropDuplicates(["id", "t"]).join(unsure, ["id", "t"]).select("id", "t", "x", "spans")
    windows = scratch.put(windows.mapInArrow(tidy(spread), "h long, id long, t long, a int"), "windows")
    first = windows.groupBy("h").agg(F.min(F.struct("id", "t")).alias("first"), F.count(F.lit(1)).alias("k")).where("k > 1")
    first = scratch.put(first.select("h", "k", F.col("first.id").alias("src"), F.col("first.t").alias("src_t")), "first")
    later = join_counted(windows, first, "h", "k").where("src < id OR (src = id AND src_t < t)").select("id", "t", "a", F.lit(1).alias("n"), "src")
    per_doc = again.unionByName(later).unionByName(own).groupBy(F.col("id").alias("_key"), F.col("t").alias("_hash")).agg(F.collect_set(F.struct("a", "n", "src")).alias("found"))

    clash = {c: f"_{i}" for i, c in enumerate(kept)}
    moved = docs.select(*[F.col(f"`{c}`").alias(a) for c, a in clash.items()])
    same = (F.col(clash[id_col]).cast("long") == F.col("_key")) & (F.xxhash64(clash[text_col]) == F.col("_hash"))
    both = moved.join(per_doc, same, "left").drop("_key", "_hash")
    schema = ", ".join(f"`{a}` {t}" for a, t in moved.dtypes) + ", removed_lines long, removed_words long, removed_runs array<struct<first_line: int, last_line: int, source: long>>"
    t_at, c_at = kept.index(text_col), kept.index(chars_col) if chars_col in kept else None

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(0, batch.num_rows, 512):
                part = batch.slice(i, 512)
                values, found = part.column(t_at).to_pylist(), part.column(part.num_columns - 1)
                each = np.where([v is None for v in values], 0, found.value_lengths().fill_null(0).to_numpy())
                some = np.flatnonzero(each)
                spots = found.take(pa.array(some)).flatten()
                n = spots.field("n").to_numpy()
                text = np.repeat(np.repeat(np.arange(len(some)), each[some]), n)
                done = cut_texts([values[r] for r in some], text, spread_out(spots.field("a").to_numpy(), n), np.repeat(spots.field("src").to_numpy(), n), min_words)
                lines, words, runs = np.zeros(part.num_rows, np.int64), np.zeros(part.num_rows, np.int64), np.zeros(part.num_rows, np.int64)
                lines[some], words[some], runs[some] = done[1:4]
                for r, x in zip(some, done[0], strict=True):
                    values[r] = x
                cols = [part.column(c) for c in range(part.num_columns - 1)]
                cols[t_at] = pa.array(values, pa.string())
                if c_at is not None:
                    cols[c_at] = pa.array([None if v is None else len(v) for v in values]).cast(cols[c_at].type)
                of_run = pa.StructArray.from_arrays([pa.array(x, k) for x, k in zip(done[4:], (pa.int32(), pa.int32(), pa.int64()), strict=True)], names=["first_line", "last_line", "source"])
                listed = pa.ListArray.from_arrays(pa.array(np.append(0, np.cumsum(runs)), pa.int32()), of_run)
                yield pa.RecordBatch.from_arrays([*cols, pa.array(lines), pa.array(words), listed], names=[*clash.values(), *new])

    out = both.mapInArrow(tidy(cut), schema)
    return out.select(*[F.col(a).alias(c) for c, a in clash.items()], *new)


def cut_texts(texts: list[str], text: np.ndarray, at: np.ndarray, sources: np.ndarray, n: int) -> tuple:
    """The texts without the windows of n words at the places `at` of the texts `text`: the new texts; of each the number of lines, words and runs removed; and of all
    runs the first line, the last line and the source. Of equal windows the least source counts.

    Of the blanks on both sides of a run those stay that hold a line's end, the ones before it where both or neither do."""
    data, begins, starts, ends, cuts = word_places(texts)
    at = at + cuts[text]
    order = np.lexsort((sources, at))
    at, first = np.unique(at[order], return_index=True)
    sources, text = sources[order][first], text[order][first]
    step = np.zeros(len(starts) + 1, np.int64)
    step[at] += 1
    step[at + n] -= 1
    gone = np.cumsum(step[:-1]) > 0
    of = np.repeat(np.arange(len(texts)), np.diff(cuts))
    feeds = np.flatnonzero(np.frombuffer(data, np.uint8) == 10)
    line = np.searchsorted(feeds, starts) + of  # lines of all texts, one after the other
    line_0 = np.searchsorted(feeds, begins[:-1]) + np.arange(len(texts))
    words = np.bincount(of[gone], minlength=len(texts))
    held, lost = np.bincount(line, minlength=1), np.bincount(line[gone], minlength=1)
    lost = np.flatnonzero((held[: len(lost)] == lost) & (lost > 0))
    lines = np.bincount(np.searchsorted(line_0, lost, "right") - 1, minlength=len(texts))

    edge = np.zeros(len(gone) + 1, bool)
    edge[cuts] = True
    edge[1:-1] |= gone[1:] != gone[:-1]
    a, b = np.flatnonzero(gone & edge[:-1]), np.flatnonzero(gone & edge[1:])
    begin, end = begins[:-1], begins[1:] - 1
    left = np.where(a == cuts[of[a]], begin[of[a]], ends[a - 1])  # the blanks before a run begin here,
    right = np.where(b + 1 == cuts[of[b] + 1], end[of[b]], starts[np.minimum(b + 1, len(starts) - 1)])  # and those after it end here
    feed_before = np.searchsorted(feeds, starts[a]) > np.searchsorted(feeds, left)
    feed_after = np.searchsorted(feeds, right) > np.searchsorted(feeds, ends[b])
    keep_before = feed_before | ~feed_after
    pieces: list[list[bytes]] = [[] for _ in texts]
    done = begin.copy()
    for r, lo, hi in zip(of[a].tolist(), np.where(keep_before, starts[a], left).tolist(), np.where(keep_before, right, ends[b]).tolist(), strict=True):
        pieces[r].append(data[done[r] : lo])
        done[r] = hi
    emptied = words == np.diff(cuts)
    out = ["" if emptied[r] and words[r] else b"".join([*pieces[r], data[done[r] : end[r]]]).decode() for r in range(len(texts))]

    fresh = np.flatnonzero(np.concatenate([np.ones(min(1, len(at)), bool), (np.diff(at) != 1) | (np.diff(sources) != 0) | (np.diff(text) != 0)]))
    last = np.append(fresh[1:], len(at))[: len(fresh)] - 1
    runs = np.bincount(text[fresh], minlength=len(texts))
    return out, lines, words, runs, line[at[fresh]] - line_0[text[fresh]], line[at[last] + n - 1] - line_0[text[fresh]], sources[fresh]


def remove_words(text: str, at: np.ndarray, sources: np.ndarray, min_words: int) -> tuple[str, int, int, list[tuple[int, int, int]]]:
    """One text cut: the new text, lines and words removed, and the runs."""
    out, lines, words, _, *runs = cut_texts([text], np.zeros(len(at), np.int64), at, sources, min_words)
    return out[0], int(lines[0]), int(words[0]), list(zip(*(x.tolist() for x in runs), strict=True))
