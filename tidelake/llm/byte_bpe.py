"""Byte-level BPE by monoid tree reduction.

A text is cut in halves until a part is a leaf; leaves are encoded by the library, and neighbours are joined up the tree. The join is
associative, because it gives the encoding of the joined text exactly:

The pattern's matches are found from left to right without looking back, a match never holds a non-space followed by white space,
and no match looks further than the character after its end and one more. So a position whose character is a blank or a line feed
and whose predecessor is no white space is a border of matches in every scan that passes it, and the matches on either side do not
depend on what lies beyond. A join looks for such a border on each side of the seam, in windows that double until one is found or the
side ends, encodes what lies between anew, and keeps the tokens outside, which are final. Halves are cut at the border nearest behind the middle, so a stretch
without borders is a leaf however long it is, and is encoded once. Decoding concatenates bytes up the tree.

A long run of white space is cut by rule, as the library's pattern matcher fails on it: of a run before other characters all but the last one are a match, at the
text's end the whole run is. Such a match is merged by itself, without the pattern.
"""

from __future__ import annotations

import base64
import functools
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from tidelake.llm.shared import tidy

#: Characters of a leaf, and tokens of a leaf in decoding.
LEAF, LEAF_IDS = 2048, 4096

#: White space in the pattern's sense, and runs of it that are cut by rule.
WHITE = "\t\n\x0b\x0c\r \x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000"
LONG_RUN = re.compile(f"[{WHITE}]{{256,}}")
BORDER = re.compile(r"\S[ \n]")


class TreeCodec:
    """Encoder and decoder over a rank file; pattern: the split before the merges."""

    def __init__(self, path: str, pattern: str, leaf: int = LEAF):
        import tiktoken

        with open(path, "rb") as f:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
        self.library = tiktoken.Encoding("tree", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})
        self.size = [0] * (max(ranks.values()) + 1)
        for token, i in ranks.items():
            self.size[i] = len(token)
        self.leaf = leaf
        self.runs = r"\s+(?!\S)|\s+" in pattern

    def encode(self, text: str) -> list[int]:
        out, at = [], 0
        for run in LONG_RUN.finditer(text) if self.runs else ():
            end = run.end() - (run.end() < len(text))
            out += self._encode(text, at, run.start())
            out += self.library._encode_single_piece(text[run.start() : end])
            at = end
        return out + self._encode(text, at, len(text))

    def _encode(self, text: str, a: int, b: int) -> list[int]:
        m = self._middle(text, a, b) if b - a > self.leaf else b
        if m == b:
            return self.library.encode_ordinary(text[a:b])
        return self.join(text, a, m, b, self._encode(text, a, m), self._encode(text, m, b))

    def _middle(self, text: str, a: int, b: int) -> int:
        """The first border behind the middle, else the last one before it, else b."""
        m = self._border_after(text, (a + b) // 2, b)
        if m == b:
            m = self._border_before(text, a, (a + b) // 2)
        return m if m > a else b

    def join(self, text: str, a: int, m: int, b: int, left: list[int], right: list[int]) -> list[int]:
        """The encoding of text[a:b] from those of text[a:m] and text[m:b]."""
        i, j = self._border_before(text, a, m), self._border_after(text, m, b)
        back = len(text[i:m].encode())
        while back > 0:
            back -= self.size[left.pop()]
        ahead, k = len(text[m:j].encode()), 0
        while ahead > 0:
            ahead -= self.size[right[k]]
            k += 1
        if back or ahead:
            raise AssertionError("a token crosses a border")
        return left + self.library.encode_ordinary(text[i:j]) + right[k:]

    @staticmethod
    def _border_before(text: str, a: int, m: int) -> int:
        """The last border in (a, m), or a."""
        window = 32
        while True:
            low = max(a + 1, m - window)
            p = max(text.rfind(" ", low, m), text.rfind("\n", low, m))
            while p > a:
                if not text[p - 1].isspace():
                    return p
                p = max(text.rfind(" ", low, p), text.rfind("\n", low, p))
            if low == a + 1:
                return a
            window *= 2

    @staticmethod
    def _border_after(text: str, m: int, b: int) -> int:
        """The first border in [m, b), or b."""
        found = BORDER.search(text, m - 1, b)
        return found.start() + 1 if found else b

    def decode(self, ids: np.ndarray) -> bytes:
        if len(ids) <= LEAF_IDS:
            return self.library.decode_bytes(ids.tolist())
        m = len(ids) // 2
        return self.decode(ids[:m]) + self.decode(ids[m:])


@functools.lru_cache(maxsize=4)
def tree_codec(path: str, pattern: str, leaf: int = LEAF) -> TreeCodec:
    """One codec for all tasks of a worker process."""
    return TreeCodec(path, pattern, leaf)


def encode_documents(docs: DataFrame, path: str, pattern: str, id_col: str = "doc_id", text_col: str = "text", leaf: int = LEAF) -> DataFrame:
    """(id, ids binary): the ids of every whole text as little-endian unsigned 32-bit integers.

    A null text is empty and has no ids. Null ids and repeated rows pass through, one result each; other columns are not read.
    One narrow pass, no shuffle.
    """
    kind = dict(docs.select(id_col).dtypes)[id_col]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = tree_codec(path, pattern, leaf)
        for batch in batches:
            for i in range(0, batch.num_rows, 512):
                part = batch.slice(i, 512)
                ids = [np.array(codec.encode(t or ""), "<u4").tobytes() for t in part.column(1).to_pylist()]
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(ids, pa.binary())], names=[id_col, "ids"])

    return docs.select(id_col, text_col).mapInArrow(tidy(run), f"`{id_col}` {kind}, ids binary")


def decode_documents(encoded: DataFrame, path: str, pattern: str, ids_col: str = "ids") -> DataFrame:
    """The rows with another column, decoded binary: the bytes that the ids stand for. Null ids decode to nothing."""
    schema = ", ".join(f"`{n}` {t}" for n, t in encoded.dtypes) + ", decoded binary"
    at = encoded.columns.index(ids_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = tree_codec(path, pattern)
        for batch in batches:
            for i in range(0, batch.num_rows, 512):
                part = batch.slice(i, 512)
                out = [codec.decode(np.frombuffer(x or b"", "<u4")) for x in part.column(at).to_pylist()]
                yield pa.RecordBatch.from_arrays([*part.columns, pa.array(out, pa.binary())], names=[*part.schema.names, "decoded"])

    return encoded.mapInArrow(tidy(run), schema)
