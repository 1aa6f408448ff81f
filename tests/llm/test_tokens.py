"""Byte-level BPE, token files and token counts against the libraries."""

import base64
import hashlib
import random
import zlib

import numpy as np
import pytest
import public_tokenizers as P
import tiktoken
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from tidelake.llm import byte_bpe, queries, token_counts, token_files

BITS = [" ", "  ", "\n", "\n\n", "\t", "\r\n", "a", "Foo", "bar's", "'re", "'", "1", "0", "42", "é", "\u00a0", "\u2003", "\u0301", "<|endoftext|>", "<|startoftext|>", "!!", "...", "Σ", "\x1c", "日本語", "ﬁ", "İ", "_", "\0", "\u3000", "\u2019"]
ODD = [None, "", " ", "\n", "word", "a " * 5000, "x" * 20000, "Ünï cödé  \n\n 日本 <|endoftext|> don't"]


def mixed(n, seed=3):
    rng = random.Random(seed)
    return ["".join(rng.choice(BITS) for _ in range(rng.randint(0, 14))) for _ in range(n)]


@pytest.fixture(scope="module")
def tree():
    return byte_bpe.TreeCodec(P.path("byte_bpe_multi_50k.tiktoken"), P.PATTERN, leaf=3)


def test_tree_reduction_equals_the_library(tree):
    for t in mixed(4000) + [x or "" for x in ODD]:
        ids = tree.encode(t)
        assert ids == tree.library.encode_ordinary(t)
        assert tree.decode(np.array(ids, "<u4")) == t.encode()


@settings(max_examples=200, deadline=None)
@given(st.text(alphabet=st.sampled_from(list("ab '.\n\t1é\u00a0")), max_size=40))
def test_any_cut_joins(tree, text):
    for m in range(len(text) + 1):
        left, right = tree.library.encode_ordinary(text[:m]), tree.library.encode_ordinary(text[m:])
        if 0 < m < len(text):
            assert tree.join(text, 0, m, len(text), left, right) == tree.library.encode_ordinary(text)


def docs(spark, texts):
    return spark.createDataFrame([(i, t, "x", 7) for i, t in enumerate(texts)] + [(None, "no id", "y", 8), (0, texts[0], "z", 9)], "doc_id long, text string, ids string, n_tokens int")


def test_documents_round_trip(spark):
    path = P.path("byte_bpe_multi_50k.tiktoken")
    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(path, "rb"))}
    library = tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=ranks, special_tokens={})
    out = byte_bpe.decode_documents(byte_bpe.encode_documents(docs(spark, ODD), path, P.PATTERN, leaf=64), path, P.PATTERN).collect()
    assert len(out) == len(ODD) + 2
    for r in out:
        text = "no id" if r.doc_id is None else ODD[r.doc_id] or ""
        assert np.frombuffer(r.ids, "<u4").tolist() == library.encode_ordinary(text) and bytes(r.decoded) == text.encode()
    empty = byte_bpe.encode_documents(docs(spark, ODD).limit(0), path, P.PATTERN)
    assert empty.collect() == []


def test_stretches_equal_the_library():
    encoder, whole = token_files.StretchEncoder(P.path("byte_bpe_50k.json"), memo=200), Tokenizer.from_file(P.path("byte_bpe_50k.json"))
    texts = mixed(6000) + [x or "" for x in ODD]
    for i in range(0, len(texts), 500):
        part = texts[i : i + 500]
        for t, ids in zip(part, encoder.encode([t.encode() for t in part]), strict=True):
            assert np.frombuffer(ids, "<u2").tolist() == whole.encode(t, add_special_tokens=False).ids, ascii(t)


@settings(max_examples=100, deadline=None)
@given(st.lists(st.integers(0, 5000), min_size=1, max_size=300))
def test_elias_fano(lengths):
    values = np.cumsum(lengths)
    ef = token_files.EliasFano.encode(values)
    assert ef.all().tolist() == values.tolist()
    assert [ef.select(i) for i in range(len(values))] == values.tolist()
    assert len(ef.low) + len(ef.high) <= len(values) * (3 + np.log2(values[-1] / len(values) + 1)) / 8 + 2


def test_token_files(spark, tmp_path):
    whole = Tokenizer.from_file(P.path("byte_bpe_50k.json"))
    root = f"file://{tmp_path}/ids"
    df = docs(spark, ODD)
    manifest = token_files.write_token_files(df, P.path("byte_bpe_50k.json"), root, segment_ids=300)
    made = sorted(manifest.collect(), key=lambda m: m.start)
    assert len(made) > 1 and sum(m.n_docs for m in made) == len(ODD) + 2 and [m.start for m in made] == [sum(x.n_ids for x in made[:i]) for i in range(len(made))]
    out = token_files.read_token_files(spark, manifest, with_ids=True).collect()
    at = 0
    for r in sorted(out, key=lambda r: r.start):
        text = "no id" if r.doc_id is None else ODD[r.doc_id] or ""
        ids = whole.encode(text, add_special_tokens=False).ids + [2]
        assert (r.ids, r.start, r.n_tokens, r.ids_crc32) == (ids, at, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes()))
        at += len(ids)
    keys = [r.doc_id for r in sorted(out, key=lambda r: r.start)]
    assert keys == sorted(keys, key=lambda k: (k is not None, k or 0))
    segment = token_files.Segment(open(made[0].path.removeprefix("file://"), "rb").read())
    assert segment.document(0).tolist() == next(r.ids for r in out if r.start == 0)
    assert token_files.token_files(df.limit(0), P.path("byte_bpe_50k.json")).collect() == []


def test_segments_are_read_by_select(tmp_path):
    import io

    rng = random.Random(2)
    keys = [None, None, *sorted(rng.randint(-(1 << 62), 1 << 62) for _ in range(300)), 1 << 62]
    lengths = [rng.randint(0, 900) for _ in keys]
    ids = [np.array([rng.randrange(50_000) for _ in range(n)], "<u2") for n in lengths]
    out = io.BytesIO()
    token_files.write_segment(out, keys, lengths, [x.tobytes() for x in ids], 2)
    segment = token_files.Segment(out.getvalue())
    assert [segment.key(i) for i in range(segment.n)] == keys
    order = rng.sample(range(segment.n), segment.n)
    assert all(segment.document(i).tolist() == ids[i].tolist() for i in order)
    dense = io.BytesIO()
    token_files.write_segment(dense, list(range(10**9, 10**9 + 5000)), [1] * 5000, [b"ab"] * 5000, 2)
    assert len(dense.getvalue()) < 5000 * 2 + 5000  # keys and ends together take less than a byte a document


def test_long_runs_of_white_space(tree):
    whole = byte_bpe.TreeCodec(P.path("byte_bpe_multi_50k.tiktoken"), P.PATTERN)
    for blank in (" ", "\n", "\t ", "\u3000", "\r\n"):
        for text in (blank * 300, "word" + blank * 300, blank * 300 + "word", "a" + blank * 400 + "b" + blank * 257 + "'s " + blank * 255 + "9"):
            assert whole.encode(text) == tree.encode(text) == tree.library.encode_ordinary(text), ascii(text[:9])
    for blank in (" ", "\n"):  # the library's pattern matcher fails on these
        ids = whole.encode("a" + blank * 1_000_000 + "b")
        assert whole.decode(np.array(ids, "<u4")) == ("a" + blank * 1_000_000 + "b").encode()
        short = whole.encode("a" + blank * 10_000 + "b")
        assert ids[:100] == short[:100] and ids[-2:] == short[-2:]


@pytest.mark.parametrize("name", ["word_bpe_49k.json", "byte_bpe_50k.json", "piece_bpe_32k.model"])
def test_token_counts(spark, name):
    counter = token_counts.PrefixCounter(P.path(name), memo=100)
    proven = name == "word_bpe_49k.json"
    out = token_counts.token_counts(docs(spark, ODD), P.path(name), with_prefixes=proven).collect()
    assert len(out) == len(ODD) + 2
    for r in out:
        text = "no id" if r.doc_id is None else ODD[r.doc_id] or ""
        assert (r.n_bytes, r.n_tokens) == (len(text.encode()), counter.library([text])[0])
        assert not proven or (r.counts[-1] if r.counts else 0) == r.n_tokens
    if not proven:
        with pytest.raises(ValueError):
            token_counts.token_counts(docs(spark, ODD), P.path(name), limit=5)
        with pytest.raises(ValueError):
            token_counts.PrefixTable(b"a b", counter)


def test_queries_of_tokens(spark, tmp_path):
    """The queries themselves, against the libraries."""
    texts = mixed(60) + ODD + ["one two three " * 900, "sesquipedalian" * 700]
    spark.createDataFrame([(3 * i, t, "x") for i, t in enumerate(texts)] + [(None, "no id", "y")], "doc_id long, text string, n_tokens string").repartition(3).write.parquet(str(tmp_path / "documents.parquet"))
    text_of = {3 * i: t or "" for i, t in enumerate(texts)} | {None: "no id"}
    words, ids = Tokenizer.from_file(P.path("word_bpe_49k.json")), Tokenizer.from_file(P.path("byte_bpe_50k.json"))
    count = lambda t: len(words.encode(t, add_special_tokens=False).ids)
    got = queries.op10_token_counts(spark, str(tmp_path)).collect()
    assert len(got) == len(text_of)
    for r in got:
        t = text_of[r.doc_id]
        assert (r.n_bytes, r.n_tokens, r.over_limit) == (len(t.encode()), count(t), count(t) > 2048)
        fit = t[: r.fit_chars]
        assert count(fit) <= 2048 and (not r.over_limit or count(t[: r.fit_chars + 20]) > 2048)
    at = 0
    for r in sorted(queries.op9_token_files(spark, str(tmp_path)).collect(), key=lambda r: (r.doc_id is not None, r.doc_id or 0)):
        want = ids.encode(text_of[r.doc_id], add_special_tokens=False).ids + [2]
        assert (r.start, r.n_tokens, r.ids_crc32) == (at, len(want), zlib.crc32(np.array(want, "<u4").tobytes()))
        at += len(want)
    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(P.path("byte_bpe_multi_50k.tiktoken"), "rb"))}
    library = tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=ranks, special_tokens={})
    for r in queries.op3_byte_bpe(spark, str(tmp_path)).collect():
        want = library.encode_ordinary(text_of[r.doc_id])
        assert (r.n_tokens, r.ids_sha256, r.decoded_sha256) == (len(want), hashlib.sha256(np.array(want, "<u4").tobytes()).hexdigest(), hashlib.sha256(text_of[r.doc_id].encode()).hexdigest())


def test_prefix_counts_are_exact():
    counter = token_counts.PrefixCounter(P.path("word_bpe_49k.json"), memo=100)
    for i, t in enumerate(mixed(400)):
        data = t.encode()
        (deltas,) = counter.deltas([data])
        assert int(deltas.sum()) == counter.library([t])[0], ascii(t)
        if i < 60:
            table = token_counts.PrefixTable(data, counter)
            for k in range(len(t) + 1):
                assert table.at(k) == counter.library([t[:k]])[0], (ascii(t), k)


def test_budget_questions():
    counter = token_counts.PrefixCounter(P.path("word_bpe_49k.json"))
    table = token_counts.PrefixTable(b"the quick brown fox jumps over the lazy dog", counter)
    assert table.fits(table.total()) and not table.fits(table.total() - 1)
    for limit in range(table.total() + 2):
        cut = table.truncate(limit)
        assert counter.library([cut])[0] <= limit and table.total() >= counter.library([cut])[0]
    assert table.truncate(0) == "" and table.truncate(10**6).endswith("dog")


def test_cuts_inside_stretches():
    counter = token_counts.PrefixCounter(P.path("word_bpe_49k.json"))
    for text in ["one two\n\nthree four", "日本語のテキスト処理は難しい", "internationalisation" * 3, "they're we've I'll o'l 'rest '' it's!!'re", "ΣΑΣ Straße ÉCOLE", "2001:db8::ff00", "e\u0301te\u0301", "a<|endoftext|>b"]:
        table = token_counts.PrefixTable(text.encode(), counter)
        counts = counter.library([text[:i] for i in range(len(text) + 1)])
        assert [table.at(i) for i in range(len(text) + 1)] == counts, text
        for limit in range(counts[-1] + 2):
            longest = text[: max(i for i, n in enumerate(counts) if n <= limit)]
            assert table.truncate(limit).rstrip() == longest.rstrip(), (text, limit)


def test_prefixes_of_random_words_and_of_long_ones():
    counter, rng = token_counts.PrefixCounter(P.path("word_bpe_49k.json")), random.Random(3)
    vocab = [t.removesuffix("</w>") for t in counter.words.vocab if t.isascii() and t.removesuffix("</w>").isalpha()]
    for _ in range(150):
        word = "".join(rng.choice(vocab) for _ in range(rng.randint(1, 4)))
        assert counter.inside(word.encode())[1:] == counter.library([word[: i + 1] for i in range(len(word))]), word
    long = "".join(rng.choice("etaoinshrdlu") for _ in range(20_000))
    counts = counter.inside(long.encode())
    for i in rng.sample(range(1, 20_001), 20):
        assert counts[i] == counter.library([long[:i]])[0]


def test_white_space_that_counts(spark):
    path = P.path("byte_bpe_50k.json")
    whole, texts = Tokenizer.from_file(path), ["one two\n\nthree four\n", *(x or "" for x in ODD)]
    out = token_counts.token_counts(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"), path).collect()
    assert {r.doc_id: r.n_tokens for r in out} == {i: len(whole.encode(t, add_special_tokens=False).ids) for i, t in enumerate(texts)}
    assert not token_counts.PrefixCounter(P.path("word_bpe_49k.json")).whole


def test_hash_is_of_little_endian_words():
    assert hashlib.sha256(np.array([1, 2], "<u4").tobytes()).hexdigest() == hashlib.sha256(b"\1\0\0\0\2\0\0\0").hexdigest()
