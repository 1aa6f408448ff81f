"""Token counts by prefix dynamic programming.

A text's pre-tokens never cross ASCII white space, and the normalisers used here act on the stretch between two white
spaces alone. So with c(w) the token count of the stretch w, the count of the prefix that ends with the k-th stretch is

    count[k] = count[k - 1] + c(w_k),

which is exact at every k. c is computed once by the library for each distinct stretch and kept in a bounded memo.

Inside a stretch the count of every prefix comes from a second programme, over tokens. A sequence of BPE tokens is the encoding of its text if and only if each two
neighbours are: encoded together, they stay the two tokens they are. So the last token t of a prefix's encoding is the one that ends the prefix and fits behind
the last token of the encoding of what is before t, and

    open[i] = open[i - len(t)] + 1,

one step for each character and length of a token. A prefix that is cut off is a word of its own, whose last token bears the mark of a word's end: it fits behind the
open encoding of what is before it in the same way. No prefix is encoded, and the work is linear in the stretch.

The table of prefix counts answers budget and truncation questions by binary search. It is for tokenizers of this kind: where white space counts, as for
sentencepiece and byte-level files, only whole texts are counted, and a prefix table is refused.
"""

from __future__ import annotations

import bisect
import functools
import itertools
import json
import re
import unicodedata
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame

from tidelake.llm.shared import Memo, tidy
from tidelake.llm.token_files import BYTE_CHARS

#: Stretches of a document: what stands between ASCII white space.
STRETCH = re.compile(rb"[^\x20\x09-\x0D]+")


class WordPrefixes:
    """The counts of a word's prefixes, for a BPE model whose words end in tokens with a mark of their own."""

    def __init__(self, vocab: dict, merges: list, mark: str, most_pairs: int = 1_000_000):
        self.vocab, self.mark, self.most_pairs = vocab, mark, most_pairs
        self.rank = {tuple(m.split(" ")) if isinstance(m, str) else tuple(m): i for i, m in enumerate(merges)}
        self.longest = max(len(x.removesuffix(mark)) for x in vocab)
        self.pairs: dict[tuple[str, str], bool] = {}

    def _letters(self, token: str) -> list[str]:
        body = token.removesuffix(self.mark)
        return [*body[:-1], body[-1] + token[len(body) :]]

    def _merged(self, letters: list[str]) -> list[str]:
        """The encoding, merge by merge; only ever of one token or two."""
        while len(letters) > 1:
            best = min(range(len(letters) - 1), key=lambda i: (self.rank.get((letters[i], letters[i + 1]), 1 << 60), i))
            if (letters[best], letters[best + 1]) not in self.rank:
                break
            letters[best : best + 2] = [letters[best] + letters[best + 1]]
        return letters

    def fits(self, left: str, right: str) -> bool:
        """Whether the two tokens stay what they are beside each other; left empty: whether right is its own encoding."""
        found = self.pairs.get((left, right))
        if found is None:
            if len(self.pairs) >= self.most_pairs:
                self.pairs.clear()
            want = [left, right] if left else [right]
            found = self.pairs[left, right] = self._merged([x for t in want for x in self._letters(t)]) == want
        return found

    def counts(self, word: str, ends: list[int]) -> list[int]:
        """The token count of each word[:end], ends ascending and above 0. word: in the characters that stand for bytes."""
        last, n, out, wanted = [""], [0], [], iter([*ends, 0])
        end = next(wanted)
        for i in range(1, (ends[-1] if ends else 0) + 1):
            token, count = None, 0
            for k in range(i - 1, max(0, i - self.longest) - 1, -1):
                if last[k] is not None and (t := word[k:i]) in self.vocab and self.fits(last[k], t):
                    token, count = t, n[k] + 1
                    break
            last.append(token)
            n.append(count)
            if i == end:
                end = next(wanted)
                for k in range(i - 1, max(0, i - self.longest) - 1, -1):
                    if last[k] is not None and (t := word[k:i] + self.mark) in self.vocab and self.fits(last[k], t):
                        out.append(n[k] + 1)
                        break
                else:
                    raise ValueError(f"no encoding of {word[:i]!r}")
        return out


class PrefixCounter:
    """Exact prefix counts of texts. memo: most distinct stretches that are kept; longer ones than keep_bytes are counted afresh."""

    def __init__(self, path: str, memo: int = 500_000, keep_bytes: int = 40):
        self.memo = Memo(memo, keep_bytes)
        self.prefixes: dict[bytes, list[int]] = {}
        self.words = None
        if path.endswith(".model"):
            import sentencepiece

            self.pieces = sentencepiece.SentencePieceProcessor(model_file=path)
            self.tokenizer = self.border = None
            self.whole = True
        else:
            from tokenizers import Tokenizer

            self.tokenizer = Tokenizer.from_file(path)
            self.tokenizer.no_truncation()
            self.tokenizer.no_padding()
            self.whole = any(self._blanks_count(b) for b in " \t\n\x0b\x0c\r")
            known = json.loads(self.tokenizer.to_str())
            model, self.added = known["model"], [t["content"] for t in known["added_tokens"]]
            if not self.whole and model["type"] == "BPE" and model.get("end_of_word_suffix"):
                self.words = WordPrefixes(model["vocab"], model["merges"], model["end_of_word_suffix"])
            alone = [self.tokenizer.encode(t, add_special_tokens=False).ids for t in ("0", "a 0 b", "a", "b")]
            # only for byte-level models whose words don't depend on the blanks beside them
            self.border = alone[0][0] if len(alone[0]) == 1 and alone[1] == alone[2] + alone[0] + alone[3] and self.library(["É;"])[0] == self._split("é", ";") else None

    def _blanks_count(self, blank: str) -> bool:
        """Whether a text with this white space has other tokens than its stretches have."""
        ids = lambda text: self.tokenizer.encode(text, add_special_tokens=False).ids
        texts = [blank.join(x) for x in (("a", "b"), ("", "a"), ("a", ""), ("one", "", "two"), ("It", "1", ".", "é", "'s", "日"), ("", "", ""))]
        return any(ids(t) != [i for w in STRETCH.findall(t.encode()) for i in ids(w.decode())] for t in texts)

    def _split(self, *pieces: str) -> int:
        return sum(len(self.tokenizer.model.tokenize(p.encode().decode("latin-1").translate(BYTE_CHARS))) for p in pieces)

    def library(self, texts: list[str]) -> list[int]:
        """The counts as the library gives them."""
        if self.tokenizer is None:
            return [len(x) for x in self.pieces.encode(texts, num_threads=1)]
        return [len(x.ids) for x in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]

    def word(self, text: str) -> int | None:
        """The count of Latin letters, stops behind them or not: two whole pieces, which the model takes as they are. None: anything else."""
        body = text.rstrip(".,;:!?")
        if not (body.isalpha() and max(body) < "\u0100"):
            return None
        model = self.tokenizer.model
        tail = text[len(body) :]
        return len(model.tokenize(body.lower().encode().decode("latin-1").translate(BYTE_CHARS))) + (len(model.tokenize(tail)) if tail else 0)

    def fresh(self, stretches: list[bytes]) -> list[int]:
        """The counts of stretches without ASCII white space, many in one call: a lone digit between them is one token, and parts them."""
        texts = [w.decode() for w in stretches]
        found = [self.word(t) if self.border is not None else None for t in texts]
        rest = [i for i, n in enumerate(found) if n is None]
        plain = [i for i in rest if self.border is not None and "0" not in texts[i]]
        for k in range(0, len(plain), 4096):
            part = plain[k : k + 4096]
            (x,) = self.tokenizer.encode_batch_fast([" 0 ".join([texts[i] for i in part])], add_special_tokens=False)
            ids = np.array(x.ids)
            at = np.concatenate([[-1], np.flatnonzero(ids == self.border), [len(ids)]])
            for i, n in zip(part, (np.diff(at) - 1).tolist(), strict=True):
                found[i] = n
        seen = set(plain)
        alone = [i for i in rest if i not in seen]
        for i, n in zip(alone, self.library([texts[i] for i in alone]), strict=True):
            found[i] = n
        return found

    def deltas(self, datas: list[bytes]) -> list[np.ndarray]:
        """For each text in UTF-8: c(w_1), c(w_2), ... Where white space counts, the text is one stretch."""
        if self.whole:
            return [np.array([n], np.int64) for n in self.library([d.decode() for d in datas])]
        cut = pc.ascii_split_whitespace(pa.array([d.decode() for d in datas], pa.large_string()))
        words = cut.flatten().cast(pa.large_binary()).dictionary_encode()
        names = words.dictionary.to_pylist()
        got = self.memo.get(names, self.fresh)
        laid = words.indices.to_numpy(zero_copy_only=False)
        counts = np.array(got, np.int64)[laid] if len(laid) else np.zeros(0, np.int64)
        real = (np.array([len(w) for w in names], np.int64) > 0)[laid] if len(laid) else np.zeros(0, bool)
        return [counts[a:b][real[a:b]] for a, b in itertools.pairwise(cut.offsets.to_numpy().tolist())]

    def inside(self, stretch: bytes) -> list[int]:
        """Counts of the stretch's own prefixes by characters, from 0 on."""
        if stretch not in self.prefixes:
            if self.words is None:
                raise ValueError("this tokenizer has no prefix counts: its words don't end in tokens of their own, or its white space counts")
            if len(self.prefixes) > 1000:
                self.prefixes.clear()
            self.prefixes[stretch] = self._inside(stretch.decode())
        return self.prefixes[stretch]

    def _inside(self, text: str) -> list[int]:
        lower = "".join(c.lower() for c in text)
        if len(lower) != len(text) or not unicodedata.is_normalized("NFC", text) or re.search(r"\s", text) or any(x[:2] in text for x in self.added):
            # characters that the normaliser joins, parts or drops, and special tokens: each prefix is the library's
            return [0, *itertools.chain.from_iterable(self.library([text[: i + 1] for i in range(k, min(k + 256, len(text)))]) for k in range(0, len(text), 256))]
        counts, done = [0], 0
        for _, (a, b) in self.tokenizer.pre_tokenizer.pre_tokenize_str(lower):
            piece = lower[a:b]
            ends = list(itertools.accumulate(len(c.encode()) for c in piece))
            inner = self.words.counts(piece.encode().decode("latin-1").translate(BYTE_CHARS), ends)
            if len(piece) == 3 and piece[0] == "'" and piece[1:].isalpha():  # a contraction's first two characters are two pieces
                inner[1] = inner[0] + self.words.counts(piece[1], [1])[0]
            counts += [done + n for n in inner]
            done = counts[-1]
        return counts


class PrefixTable:
    """The prefix counts of one text: ends (bytes) of its stretches and the count of the prefix up to each."""

    def __init__(self, data: bytes, counter: PrefixCounter, deltas: np.ndarray | None = None):
        """deltas: the counts of the stretches, where they are known."""
        if counter.words is None:
            raise ValueError("this tokenizer has no prefix counts: its words don't end in tokens of their own, or its white space counts")
        self.data, self.counter = data, counter
        spans = [m.span() for m in STRETCH.finditer(data)]
        self.starts, self.ends = [a for a, _ in spans], [b for _, b in spans]
        self.counts = np.concatenate([[0], np.cumsum(counter.deltas([data])[0] if deltas is None else deltas)]).astype(np.int64)

    def total(self) -> int:
        return int(self.counts[-1])

    def at(self, chars: int) -> int:
        """The exact token count of the first `chars` characters."""
        size = len(self.data.decode()[:chars].encode())
        k = bisect.bisect_right(self.ends, size)
        before = int(self.counts[k])
        if k < len(self.starts) and self.starts[k] < size:
            stretch = self.data[self.starts[k] : self.ends[k]]
            before += self.counter.inside(stretch)[len(self.data[self.starts[k] : size].decode())]
        return before

    def truncate(self, limit: int) -> str:
        """The longest prefix, without blanks behind it, that has at most `limit` tokens. It may end inside a stretch."""
        k = int(np.searchsorted(self.counts, limit, "right")) - 1
        if 0 <= k < len(self.starts):
            stretch = self.data[self.starts[k] : self.ends[k]]
            n = int(np.flatnonzero(np.array(self.counter.inside(stretch)) + self.counts[k] <= limit)[-1])
            if n:
                return self.data[: self.starts[k]].decode() + stretch.decode()[:n]
        return self.data[: self.ends[k - 1]].decode() if k > 0 else ""

    def fits(self, limit: int) -> bool:
        return self.total() <= limit


@functools.lru_cache(maxsize=2)
def prefix_counter(path: str) -> PrefixCounter:
    """One counter, with its memo, for all tasks of a worker process."""
    return PrefixCounter(path)


def token_counts(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text", limit: int | None = None, with_prefixes: bool = False) -> DataFrame:
    """(id, n_bytes, n_tokens) of every row; with a limit also over_limit boolean and fit_chars, the characters of the longest prefix, without blanks behind it,
    that has at most `limit` tokens; with_prefixes also counts array<long>, the prefix counts at the ends of stretches.

    A null text counts as empty (0 bytes, 0 tokens). Null ids and repeated rows pass through, one result each; other columns are
    not read. Whole texts are counted, whatever their length. One narrow pass, no shuffle. A limit and prefixes need a tokenizer that has prefix counts.
    """
    if (limit is not None or with_prefixes) and prefix_counter(path).words is None:
        raise ValueError(f"{path} has no prefix counts: only whole texts can be counted")
    kind = dict(docs.select(id_col).dtypes)[id_col]
    names = [id_col, "n_bytes", "n_tokens", *["over_limit", "fit_chars"] * (limit is not None), *["counts"] * with_prefixes]
    kinds = {id_col: kind, "over_limit": "boolean", "counts": "array<long>"}
    schema = ", ".join(f"`{c}` {kinds.get(c, 'long')}" for c in names)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counter = prefix_counter(path)
        for batch in batches:
            for i in range(0, batch.num_rows, 1024):
                part = batch.slice(i, 1024)
                datas = [x or b"" for x in part.column(1).cast(pa.binary()).to_pylist()]
                deltas = counter.deltas(datas)
                tables = [np.cumsum(d) for d in deltas]
                totals = [int(t[-1]) if len(t) else 0 for t in tables]
                out = [part.column(0), pa.array([len(d) for d in datas], pa.int64()), pa.array(totals, pa.int64())]
                if limit is not None:
                    fit = [len((PrefixTable(d, counter, x).truncate(limit) if n > limit else d.decode()).rstrip(" \t\n\x0b\x0c\r")) for d, n, x in zip(datas, totals, deltas, strict=True)]
                    out += [pa.array([n > limit for n in totals]), pa.array(fit, pa.int64())]
                if with_prefixes:
                    out.append(pa.array([t.tolist() for t in tables], pa.list_(pa.int64())))
                yield pa.RecordBatch.from_arrays(out, names=names)

    return docs.select(id_col, text_col).mapInArrow(tidy(run), schema)
