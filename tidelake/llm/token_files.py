"""Token-id files: a concatenated id array with Elias-Fano encoded document boundaries.

A segment file holds, little-endian:

    magic "TIDEIDS2", id width in bytes (2 or 4), documents, ids, documents without a key, the least key
    two Elias-Fano sequences: the documents' ends, and their ascending keys above the least one
    the ids

and a sequence holds:

    low bits, values, samples, bytes of the low and high parts
    low part: the low bits of each value, packed
    high part: for the i-th value v a one at bit (v >> low) + i
    samples: the bit of every SAMPLE-th one, where select starts

An end costs about 2 + log2(ids / documents) bits instead of 64, a key of a dense range little more than 2; select(i) finds a value in place, and a
document's ids are the stretch between two ends.
"""

from __future__ import annotations

import functools
import io
import posixpath
import re
import struct
import uuid
import zlib
from array import array
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyarrow import fs as pafs
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tidelake.llm.shared import Memo, shared_dir, tidy

MAGIC, SAMPLE, HEAD, PART = b"TIDEIDS2", 64, struct.Struct("<8sHQQQq"), struct.Struct("<HQQQQ")


class EliasFano:
    """A non-decreasing sequence in near-minimal space, with select by sampled ones."""

    def __init__(self, n: int, low_bits: int, low: bytes, high: bytes, samples: np.ndarray):
        self.n, self.low_bits, self.low, self.high, self.samples = n, low_bits, low, high, samples
        self.bits = np.frombuffer(high, np.uint8)

    @classmethod
    def encode(cls, values: np.ndarray) -> EliasFano:
        values = np.asarray(values, np.uint64)
        n, top = len(values), int(values[-1]) if len(values) else 0
        low_bits = min(63, max(0, (top // max(n, 1)).bit_length() - 1))
        lows = (values & np.uint64((1 << low_bits) - 1)).astype("<u8")
        bits = np.unpackbits(lows.view(np.uint8).reshape(n, 8), axis=1, bitorder="little")[:, :low_bits] if n else np.zeros((0, 0), np.uint8)
        ones = (values >> np.uint64(low_bits)).astype(np.int64) + np.arange(n)
        high = np.zeros((int(ones[-1]) + 1 if n else 0), np.uint8)
        high[ones] = 1
        return cls(n, low_bits, np.packbits(bits, bitorder="little").tobytes(), np.packbits(high, bitorder="little").tobytes(), ones[::SAMPLE].astype("<u8"))

    def _low(self, i: int) -> int:
        if not self.low_bits:
            return 0
        a, b = i * self.low_bits, (i + 1) * self.low_bits
        return (int.from_bytes(self.low[a // 8 : (b + 7) // 8], "little") >> (a % 8)) & ((1 << self.low_bits) - 1)

    def select(self, i: int) -> int:
        """The i-th value, found from the nearest sample on."""
        at, left = int(self.samples[i // SAMPLE]), i % SAMPLE
        byte = at // 8
        word = int(self.bits[byte]) >> (at % 8) << (at % 8)
        while (ones := word.bit_count()) <= left:
            left, byte = left - ones, byte + 1
            word = int(self.bits[byte])
        for _ in range(left):
            word &= word - 1
        return ((byte * 8 + (word & -word).bit_length() - 1 - i) << self.low_bits) | self._low(i)

    def all(self) -> np.ndarray:
        """Every value at once."""
        ones = np.flatnonzero(np.unpackbits(self.bits, bitorder="little"))[: self.n]
        high = ones - np.arange(self.n)
        if not self.low_bits:
            return high
        bits = np.unpackbits(np.frombuffer(self.low, np.uint8), bitorder="little")[: self.n * self.low_bits].reshape(self.n, self.low_bits)
        return (high << self.low_bits) | (bits.astype(np.int64) << np.arange(self.low_bits)).sum(1)


    def write(self, out) -> None:
        out.write(PART.pack(self.low_bits, self.n, len(self.samples), len(self.low), len(self.high)))
        out.write(self.low + self.high + np.asarray(self.samples, "<u8").tobytes())

    @classmethod
    def read(cls, data: bytes, at: int) -> tuple[EliasFano, int]:
        """The sequence at an offset, and the offset behind it. Nothing is decoded."""
        low_bits, n, n_samples, low, high = PART.unpack_from(data, at)
        at += PART.size
        return cls(n, low_bits, data[at : at + low], data[at + low : at + low + high], np.frombuffer(data, "<u8", n_samples, at + low + high)), at + low + high + 8 * n_samples


def write_segment(out, keys: list[int | None], lengths: list[int], payload: list[bytes], width: int) -> None:
    """keys: the null ones first, then ascending."""
    known = [k for k in keys if k is not None]
    least = known[0] if known else 0
    out.write(HEAD.pack(MAGIC, width, len(keys), int(sum(lengths)), len(keys) - len(known), least))
    EliasFano.encode(np.cumsum(np.asarray(lengths, np.int64))).write(out)
    EliasFano.encode(np.array([k - least for k in known], np.uint64)).write(out)
    for x in payload:
        out.write(x)


class Segment:
    """A segment file, read back. Ends and keys stay as they are written, and are found by select."""

    def __init__(self, data: bytes):
        magic, width, self.n, n_ids, self.n_null, self.least = HEAD.unpack_from(data)
        if magic != MAGIC:
            raise ValueError("not a token-id segment")
        self.ends, at = EliasFano.read(data, HEAD.size)
        self.keys, at = EliasFano.read(data, at)
        self.ids = np.frombuffer(data, f"<u{width}", n_ids, at)

    def key(self, i: int) -> int | None:
        return None if i < self.n_null else self.least + self.keys.select(i - self.n_null)

    def start(self, i: int) -> int:
        """Where the i-th document's ids begin."""
        return self.ends.select(i - 1) if i else 0

    def document(self, i: int) -> np.ndarray:
        """The ids of the i-th document, by two selects."""
        return self.ids[self.start(i) : self.ends.select(i)]


def byte_chars() -> dict[int, str]:
    """The characters that stand for bytes in a byte-level vocabulary: printable Latin-1 ones for themselves, the others from U+0100 on, in order."""
    plain = {*range(33, 127), *range(161, 173), *range(174, 256)}
    rest = [b for b in range(256) if b not in plain]
    return {b: chr(b) for b in plain} | {b: chr(256 + i) for i, b in enumerate(rest)}


BYTE_CHARS = byte_chars()


class StretchEncoder:
    """Encodes whole texts with the tokenizers library, stretch by stretch.

    Two facts about the byte-level pattern make this exact: no piece holds a non-space followed by white space, so a text can be cut
    between the two; and of a run of white space before a word only the last character, if a blank, belongs to the word's piece. A text
    whose blanks and line feeds are single is cut before each of them. Each distinct stretch is encoded once while it is in the memo: mere
    letters by the model itself, others many in one call, with line feeds between them. Any other text goes to the library whole.

    memo: most stretches kept; longer ones than keep_bytes are encoded each time they occur in a block.
    """

    BEFORE_BLANK = (b"  ", b"\n ", b"\t ", b"\r ", b"\x0b ", b"\x0c ")
    BEFORE_LINE = (b"\n\n", b" \n", b"\t\n", b"\r\n", b"\x0b\n", b"\x0c\n")
    WIDE = (b"\xc2\x85", b"\xc2\xa0", b"\xe1\x9a\x80", b"\xe2\x81\x9f", b"\xe3\x80\x80")
    WIDE_TOO = re.compile(rb"\xe2\x80[\x80-\x8a\xa8\xa9\xaf]")

    def __init__(self, path: str, memo: int = 800_000, keep_bytes: int = 40):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.no_truncation()
        self.tokenizer.no_padding()
        self.width = 2 if self.tokenizer.get_vocab_size() <= 1 << 16 else 4
        self.memo = Memo(memo, keep_bytes)
        self.model, self.code = self.tokenizer.model, "H" if self.width == 2 else "I"
        (self.line,) = self.tokenizer.encode("\n", add_special_tokens=False).ids

    def library(self, texts: list[str]) -> list[np.ndarray]:
        return [np.array(x.ids, f"<u{self.width}") for x in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]

    def ready(self, d: bytes) -> bytes | None:
        """The text with a blank before each stretch but the first: what follows is its name. One without a blank of its own begins with a zero
        byte or a line feed. None: not to be cut."""
        if d[-1:] == b" " or b"\0" in d or any(x in d for x in self.BEFORE_BLANK):
            return None
        if not d.isascii() and (any(x in d for x in self.WIDE) or (b"\xe2\x80" in d and self.WIDE_TOO.search(d))):
            return None
        if not any(x in d for x in self.BEFORE_LINE):
            d = d.replace(b"\n", b" \n")
        elif b" \n" in d:
            return None
        return b"\0" + d

    def word(self, t: bytes) -> bytes | None:
        """The ids of letters, a blank before and stops behind them or not: these are whole pieces, so the model takes them as they are. None: anything else."""
        body = t.rstrip(b".,;:!?")
        letters = body.lstrip(b" ")
        if not letters.isalpha():  # of ASCII
            if letters.isascii():
                return self.piece(t) if not letters and t.strip(b" ") else None
            if not ((wide := letters.decode()).isalpha() and max(wide) < "\u0530"):
                return None
        return self.piece(body) + self.piece(t[len(body) :])

    def piece(self, data: bytes) -> bytes:
        return array(self.code, [x.id for x in self.model.tokenize(data.decode("latin-1").translate(BYTE_CHARS))]).tobytes() if data else b""

    def fresh(self, stretches: list[bytes]) -> list[bytes]:
        """The ids of stretches, packed."""
        texts = [w[1:] if w[:1] in (b"\0", b"\n") else b" " + w for w in stretches]
        found: list = [self.word(t) for t in texts]
        rest = [i for i, x in enumerate(found) if x is None]
        for i in rest:
            texts[i] = texts[i].decode()
        joined = [i for i in rest if texts[i] and "\n" not in texts[i] and not texts[i][-1].isspace()]
        for k in range(0, len(joined), 4096):
            part = joined[k : k + 4096]
            (ids,) = self.library(["\n".join([texts[i] for i in part])])
            at = [*(np.flatnonzero(ids == self.line) * self.width).tolist(), len(ids) * self.width]
            raw, start = ids.tobytes(), 0
            for i, end in zip(part, at, strict=True):
                found[i] = raw[start:end]
                start = end + self.width
        seen = set(joined)
        alone = [i for i in rest if i not in seen]
        for i, x in zip(alone, self.library([texts[i] for i in alone]), strict=True):
            found[i] = x.tobytes()
        line = np.array([self.line], f"<u{self.width}").tobytes()
        return [line + x if w[:1] == b"\n" else x for w, x in zip(stretches, found, strict=True)]

    def encode(self, datas: list[bytes]) -> list[bytes]:
        """The ids of each text, packed little-endian. The distinct stretches of the block are looked up once each."""
        ready = [self.ready(d) for d in datas]
        whole = iter(self.library([d.decode() for d, x in zip(datas, ready, strict=True) if x is None]))
        cut = pc.split_pattern(pa.array([x for x in ready if x is not None], pa.large_binary()), pattern=b" ")
        words = cut.flatten().dictionary_encode()
        names = words.dictionary.to_pylist()
        laid = pa.array(self.memo.get(names, self.fresh), pa.large_binary()).take(words.indices)
        _, offsets, data = laid.buffers()
        ends = np.frombuffer(offsets, np.int64)[: len(laid) + 1][cut.offsets.to_numpy()] if len(laid) else np.zeros(1, np.int64)
        raw = memoryview(data) if data is not None else b""
        spans = iter(zip(ends[:-1].tolist(), ends[1:].tolist(), strict=True))
        out = []
        for x in ready:
            if x is None:
                out.append(next(whole).tobytes())
            else:
                i, j = next(spans)
                out.append(bytes(raw[i:j]))
        return out


@functools.lru_cache(maxsize=2)
def stretch_encoder(path: str) -> StretchEncoder:
    """One encoder, with its memo, for all tasks of a worker process."""
    return StretchEncoder(path)


def _open(uri: str) -> tuple[pafs.FileSystem, str]:
    return pafs.FileSystem.from_uri(uri if "://" in uri or uri.startswith("file:") else f"file://{uri}")


def write_token_files(docs: DataFrame, tokenizer: str, root: str, end_id: int | None = 2, id_col: str = "doc_id", text_col: str = "text", segment_ids: int = 1 << 23) -> DataFrame:
    """Writes every document's ids to segment files under root, in ascending order of the id, and the manifest beside them, which is returned: (path, start, n_docs, n_ids),
    a row for each file.

    Files are cut at about segment_ids ids; a document is never cut. A null text is empty and has the end id alone; null ids come
    first; rows with equal ids stand beside each other, in the order of their texts' hashes. A task that runs again writes the same
    names (a finished file appears by a rename), so lost executors and repeated attempts do no harm. The manifest is a table: its rows never come to the
    driver, and where a file begins is a sum over the files of its task and over the tasks before it. Ids are numbers, or texts of such.
    """
    parts = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    ordered = docs.select(F.col(id_col).cast("long").alias("k"), F.col(text_col).alias("t")).repartitionByRange(parts, "k").sortWithinPartitions("k", F.xxhash64("t"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder, part, seq = stretch_encoder(tokenizer), TaskContext.get().partitionId(), 0
        end = b"" if end_id is None else np.array([end_id], f"<u{encoder.width}").tobytes()
        keys, lengths, payload, size = [], [], [], 0

        def flush() -> pa.RecordBatch:
            fs, folder = _open(root)
            name = f"part-{part:06d}-{seq:05d}.ids"
            fs.create_dir(folder, recursive=True)
            draft = posixpath.join(folder, f"_{name}.{uuid.uuid4().hex}")
            buffer = io.BytesIO()
            write_segment(buffer, keys, lengths, payload, encoder.width)
            with fs.open_output_stream(draft) as out:
                out.write(buffer.getbuffer())
            fs.move(draft, posixpath.join(folder, name))
            return pa.RecordBatch.from_pydict({"part": [part], "seq": [seq], "name": [name], "n_docs": [len(keys)], "n_ids": [sum(lengths)]})

        for batch in batches:
            for i in range(0, batch.num_rows, 1024):
                rows = batch.slice(i, 1024)
                ids = encoder.encode([x or b"" for x in rows.column(1).cast(pa.binary()).to_pylist()])
                for k, x in zip(rows.column(0).to_pylist(), ids, strict=True):
                    keys.append(k)
                    payload.append(x + end)
                    lengths.append(len(payload[-1]) // encoder.width)
                    size += lengths[-1]
                    if size >= segment_ids:
                        yield flush()
                        keys, lengths, payload, size, seq = [], [], [], 0, seq + 1
        if keys:
            yield flush()

    spark = docs.sparkSession
    ordered.mapInArrow(tidy(run), "part long, seq long, name string, n_docs long, n_ids long").write.parquet(f"{root}/manifest")
    made = spark.read.schema("part long, seq long, name string, n_docs long, n_ids long").parquet(f"{root}/manifest")
    inside = Window.partitionBy("part").orderBy("seq").rowsBetween(Window.unboundedPreceding, -1)
    tasks = made.groupBy("part").agg(F.sum("n_ids").alias("_sum"))  # a row for each task of the write
    tasks = tasks.select("part", F.coalesce(F.sum("_sum").over(Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("_before"))
    start = F.col("_before") + F.coalesce(F.sum("n_ids").over(inside), F.lit(0))
    return made.join(tasks, "part").select(F.concat(F.lit(f"{root}/"), "name").alias("path"), start.alias("start"), "n_docs", "n_ids")


def read_token_files(spark: SparkSession, manifest: DataFrame, with_ids: bool = False) -> DataFrame:
    """(doc_id, start, n_tokens, ids_crc32) of every document of the files, and with_ids also ids array<long>.

    start: ids of all documents before it. ids_crc32: of the ids as little-endian unsigned 32-bit integers. An empty manifest
    gives no rows. A task reads one file at a time, and finds its documents by select.
    """
    schema = "doc_id long, start long, n_tokens long, ids_crc32 long" + ", ids array<long>" * with_ids

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for path, base in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                fs, at = _open(path)
                with fs.open_input_stream(at) as f:
                    segment = Segment(f.read())
                for first in range(0, segment.n, 4096):
                    rows = range(first, min(first + 4096, segment.n))
                    ends = [segment.ends.select(i) for i in rows]
                    starts = [segment.start(first), *ends[:-1]]
                    ids = [segment.ids[a:b].astype("<u4") for a, b in zip(starts, ends, strict=True)]
                    out = [
                        pa.array([segment.key(i) for i in rows], pa.int64()),
                        pa.array([base + a for a in starts], pa.int64()),
                        pa.array([len(x) for x in ids], pa.int64()),
                        pa.array([zlib.crc32(x.tobytes()) for x in ids], pa.int64()),
                    ]
                    if with_ids:
                        out.append(pa.array([x.tolist() for x in ids], pa.list_(pa.int64())))
                    yield pa.RecordBatch.from_arrays(out, names=["doc_id", "start", "n_tokens", "ids_crc32", "ids"][: len(out)])

    return manifest.select("path", "start").repartition("path").mapInArrow(tidy(run), schema)


def token_files(docs: DataFrame, tokenizer: str, end_id: int | None = 2, root: str | None = None) -> DataFrame:
    """Writes the files in the shared folder (or under root) and reads them back."""
    spark = docs.sparkSession
    root = root or f"{shared_dir(spark)}/tidelake/ids-{uuid.uuid4().hex}"
    return read_token_files(spark, write_token_files(docs, tokenizer, root, end_id))
