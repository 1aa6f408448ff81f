"""N-gram Jaccard join by a MinHash LSH forest with exact verification.

Documents are sets of word shingles. Documents with the same words are one class, and only class representatives are joined. A sketch of trees * deepest
MinHash values gives each of them a path of `deepest` values in every tree, a byte a value. Sorted, a tree's paths are its prefix trie: documents under one
node stand beside each other, and the longest common prefix of two is the least of those between neighbours.

Matching starts with whole paths, and prefixes are shortened document by document until the recall is met: that of the least similar partner a document
of its size can have, 1 - (1 - s^k)^trees for s at or above the threshold. Small documents can only link at some high similarities, so they close at longer prefixes
than large ones. Two documents are compared if they share, in some tree, a prefix at which one of them is still open.

Every such pair is verified by the shingles themselves, as 64-bit hashes. Nodes of few documents give pairs. The documents of a crowded node are tied to its
first one instead, and what is tied together is compared with each other block by block, as sets in matrices: the same pairs and more of the like, none less.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from fractions import Fraction

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidelake.llm.shared import Scratch, connected_components, local_components, pair_blocks, tidy, word_hashes

#: Nodes up to this many documents give their pairs one by one, more crowded ones by blocks.
CROWDED = 16
#: Shingles of a block, which bounds a comparison's memory however long the texts are.
BLOCK_SHINGLES = 1 << 20
_MIX = np.uint64(0x9E3779B97F4A7C15)


def least_similarity(n: int, threshold: Fraction) -> float:
    """The least Jaccard similarity of the threshold or more that a set of n shingles can have with another one."""
    if n > 200:
        return float(threshold)
    best = Fraction(1)
    for other in range(1, int(n / threshold) + 1):
        least = -(-threshold * (n + other) // (1 + threshold))  # shared / (n + other - shared) >= threshold
        if least <= min(n, other):
            best = min(best, Fraction(int(least), int(n + other - least)))
    return float(best)


def closing_depth(similarity: float, trees: int, deepest: int, recall: float) -> int:
    """The longest prefix with which a pair of this similarity meets in some tree with the target recall."""
    depth = deepest
    while depth > 1 and 1 - (1 - similarity**depth) ** trees < recall:
        depth -= 1
    return depth


def closing_depths(threshold: Fraction, trees: int, deepest: int, recall: float) -> np.ndarray:
    """By the number of shingles, up to 201, which stands for all larger numbers: how long prefixes are when a document closes."""
    return np.array([deepest] + [closing_depth(least_similarity(n, threshold), trees, deepest, recall) for n in range(1, 202)])


def _mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(33))) * np.uint64(0xFF51AFD7ED558CCD)
    x = (x ^ (x >> np.uint64(33))) * np.uint64(0xC4CEB9FE1A85EC53)
    return x ^ (x >> np.uint64(33))


def shingle_sets(texts: list[str], words: int = 5) -> list[np.ndarray]:
    """The sorted distinct shingle hashes of each text: runs of `words` words; a shorter text with a word is one shingle."""
    out = []
    for h in word_hashes(texts):
        k = min(words, len(h))
        if not k:
            out.append(np.zeros(0, np.uint64))
            continue
        n = len(h) - k + 1
        s = np.full(n, k, np.uint64)
        for i in range(k):
            s = s * _MIX + h[i : i + n]
            s ^= s >> np.uint64(29)
        out.append(np.unique(_mixed(s)))
    return out


def sketches(sets: list[np.ndarray], size: int) -> np.ndarray:
    """A MinHash sketch of `size` values for each set that is not empty.

    In a round every shingle is hashed to one place, which keeps the least hash; places that stay empty are filled by later rounds, and after `size` rounds each
    place gets a round of its own. A place agrees for two sets with the probability of their Jaccard similarity, as with a hash function of its own, but
    a set of n shingles costs about n + size * log(size) hashes in place of n * size.
    """
    out = np.full(len(sets) * size, np.uint64(0xFFFFFFFFFFFFFFFF))
    flat = np.concatenate(sets) if sets else np.zeros(0, np.uint64)
    who = np.repeat(np.arange(len(sets)), [len(s) for s in sets])
    todo = np.array([len(s) > 0 for s in sets], bool)
    for r in range(2 * size):
        if not len(flat):
            break
        h = _mixed(flat ^ np.uint64((r + 1) * int(_MIX) & 0xFFFFFFFFFFFFFFFF))
        place = (h >> np.uint64(50)).astype(np.int64) % size if r < size else r - size
        np.minimum.at(out, who * size + place, (h & np.uint64((1 << 48) - 1)) | np.uint64(r << 48))
        left = np.flatnonzero(todo)
        done = left[(out.reshape(-1, size)[left] != np.uint64(0xFFFFFFFFFFFFFFFF)).all(1)]
        if len(done):
            todo[done] = False
            stay = todo[who]
            flat, who = flat[stay], who[stay]
    return out.reshape(-1, size)


def paths(sketch: np.ndarray, trees: int) -> np.ndarray:
    """For each sketch its path in every tree: a byte of each of up to eight values, the first one on top of a 64-bit number."""
    step = sketch.shape[1] // trees
    byte = (_mixed(sketch + np.uint64(1)) >> np.uint64(56)).reshape(-1, trees, step)
    out = np.zeros(byte.shape[:2], np.uint64)
    for level in range(8):
        out = out << np.uint64(8) | (byte[:, :, level] if level < step else np.uint64(0))
    return out.view(np.int64)


def share_prefix(a: np.ndarray, b: np.ndarray, depth: np.ndarray) -> np.ndarray:
    """Whether two paths agree on the first `depth` values (1 to 8)."""
    return ((a ^ b).view(np.uint64) >> (64 - 8 * depth).astype(np.uint64)) == 0


def jaccard_links(inter: np.ndarray, n_a: np.ndarray, n_b: np.ndarray, threshold: Fraction) -> np.ndarray:
    """Whether inter / (n_a + n_b - inter) reaches the threshold, in integers."""
    return inter * threshold.denominator >= (n_a + n_b - inter) * threshold.numerator


#: Bits of the bitmap by which texts are left out before a shuffle: 2 MB, whatever the corpus.
BITMAP = 1 << 24


def _bit_of(ids: np.ndarray) -> np.ndarray:
    return (_mixed(ids.astype(np.int64).view(np.uint64)) % np.uint64(BITMAP)).astype(np.int64)


def id_bitmap(ids: DataFrame) -> bytes:
    """A bit for each id's hash. What has no bit is surely not among the ids; the fuller the bitmap, the less it leaves out."""

    def mark(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at = np.unique(_bit_of(batch.column(0).to_numpy()))
            yield pa.RecordBatch.from_arrays([pa.array(at + 1)], names=["bit"])  # the bitmap functions count from 1

    bits = ids.mapInArrow(tidy(mark), "bit long")
    parts = bits.groupBy(F.bitmap_bucket_number("bit").alias("k")).agg(F.bitmap_construct_agg(F.bitmap_bit_position("bit")).alias("b"))
    out = bytearray(BITMAP // 8)
    for r in parts.collect():  # 4 KB each, at most BITMAP / 32768 of them
        out[(r.k - 1) * 4096 : r.k * 4096] = r.b
    return bytes(out)


def similar_documents(
    docs: DataFrame,
    threshold: float = 0.8,
    words: int = 5,
    trees: int = 32,
    deepest: int = 8,
    recall: float = 0.9999,
    crowded: int = CROWDED,
    block: int = 512,
    id_col: str = "doc_id",
    text_col: str = "text",
) -> DataFrame:
    """(id, class_id, class_size, n_links, component_id, kept) of every row.

    class_id: the smallest id with the same words in the same order; class_size: its rows. n_links: other documents whose shingle sets have
    a Jaccard similarity of the threshold or more, copies included. component_id: the smallest id that links reach, its own included; kept:
    whether that is its own.

    Words are what ASCII white space parts; a text of fewer than `words` words is one shingle. A null text and one without words have no
    shingles: they link with nothing, not even each other. Rows with equal ids are judged by their own texts; where several texts have the same smallest id, they are one component. Rows with a
    null id link with nothing and are kept, with null class and component. Other columns are not read. An empty table gives no rows.

    recall is that of the search, for a pair exactly at the threshold; more similar pairs are found more surely, and whatever is found is verified. No
    bucket, group or partner is capped, and no pair is left out by an estimate. crowded and block only choose how pairs are compared. Ids are numbers, or
    texts of such.
    """
    if deepest > 8:
        raise ValueError("a path has eight values at most")
    scratch = Scratch(docs.sparkSession, "ngrams")
    t = Fraction(str(threshold))
    closing = closing_depths(t, trees, deepest, recall)
    shortest = int(closing.min())
    texts = docs.select(F.col(id_col).cast("long").alias("id"), F.coalesce(F.col(text_col), F.lit("")).alias("t"))

    def sign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(0, batch.num_rows, 512):
                part = batch.slice(i, 512)
                values = part.column(1).to_pylist()
                sets = shingle_sets(values, words)
                same = [xxhash.xxh3_128_digest(b" ".join(x.encode().split())) for x in values]
                laid = paths(sketches(sets, trees * deepest), trees)
                keys = pa.ListArray.from_arrays(pa.array(np.arange(len(sets) + 1) * trees, pa.int32()), pa.array(laid.ravel()))
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(same, pa.binary()), pa.array([len(s) for s in sets], pa.int32()), keys], names=["id", "same", "n", "keys"])

    signed = texts.where("id IS NOT NULL").mapInArrow(tidy(sign), "id long, same binary, n int, keys array<long>")
    signed = scratch.put(signed, "signed")
    members = signed.groupBy("same").agg(F.min("id").alias("rep"), F.count(F.lit(1)).alias("size"), F.max("n").alias("_n"))
    # a class is a node, named by its smallest id; classes that have this id too get a name beyond the ids
    beyond = F.xxhash64("same").bitwiseAND(F.lit((1 << 62) - 1)).bitwiseOR(F.lit(1 << 62))
    turn = F.row_number().over(Window.partitionBy("rep").orderBy(F.col("_n").desc(), "same"))
    members = members.withColumn("node", F.when(turn == 1, F.col("rep")).otherwise(beyond)).drop("_n")
    members = scratch.put(members, "members")
    reps = signed.join(members, "same").where("id = rep AND n > 0").dropDuplicates(["node"]).select(F.col("node").alias("rep"), "size", "n", "keys")
    reps = scratch.put(reps, "reps")

    up = np.uint64(64 - 8 * shortest)
    columns = ["tree", "path", "id", "n", "weight", "head"]

    def plant(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """A document's path in each tree. Of a node that is crowded within a batch already, the first document stands for all, the others are tied to it."""
        for batch in batches:
            rep, n = batch.column(0).to_numpy(), batch.column(1).to_numpy()
            path = batch.column(2).flatten().to_numpy()
            tree = np.tile(np.arange(trees, dtype=np.int32), len(rep))
            who = np.repeat(np.arange(len(rep)), trees)
            node = path.view(np.uint64) >> up
            order = np.lexsort((rep[who], node, tree))
            tree, path, who, node = tree[order], path[order], who[order], node[order]
            start = np.flatnonzero(np.concatenate([[True], (node[1:] != node[:-1]) | (tree[1:] != tree[:-1])])) if len(node) else np.zeros(0, np.int64)
            count = np.diff(np.append(start, len(node)))
            size, first = np.repeat(count, count), np.repeat(start, count)
            tied = (size > crowded) & (np.arange(len(node)) != first)
            left = ~tied
            rows = [tree[left], path[left], rep[who[left]], n[who[left]], np.where(size > crowded, size, 1)[left]]
            yield pa.RecordBatch.from_arrays([*(pa.array(x, k) for x, k in zip(rows, (pa.int32(), pa.int64(), pa.int64(), pa.int32(), pa.int64()), strict=True)), pa.nulls(int(left.sum()), pa.int64())], names=columns)
            pairs = np.unique(np.stack([rep[who[tied]], rep[who[first[tied]]]], 1), axis=0) if tied.any() else np.zeros((0, 2), np.int64)
            if len(pairs):  # these pass by the trees
                zero = np.zeros(len(pairs), np.int64)
                yield pa.RecordBatch.from_arrays([pa.array(zero - 1).cast(pa.int32()), pa.array(_mixed(pairs[:, 0].astype(np.uint64) * _MIX).view(np.int64)), pa.array(pairs[:, 0]), pa.array(zero).cast(pa.int32()), pa.array(zero), pa.array(pairs[:, 1])], names=columns)

    planted = reps.select("rep", "n", "keys").mapInArrow(tidy(plant), "tree int, path long, id long, n int, weight long, head long")
    node = F.shiftrightunsigned("path", int(up))
    trie = planted.withColumn("node", node).repartition("tree", "node").drop("node").sortWithinPartitions("tree", "path", "id")

    def walk(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Pairs and ties of each node, from paths in their order. Holds a batch, and of a node that goes on in the next one its rows, or its first row if it is crowded."""
        held = [np.zeros(0, np.int64)] * 5

        def nodes(rows: list[np.ndarray], last: bool) -> tuple[list[np.ndarray], list[np.ndarray]]:
            tree, path, ids, n, weight = rows
            if not len(tree):
                return [], rows
            at = path.view(np.uint64) >> up
            start = np.flatnonzero(np.concatenate([[True], (at[1:] != at[:-1]) | (tree[1:] != tree[:-1])]))
            count = np.diff(np.append(start, len(tree)))
            total, begin, number = np.repeat(np.add.reduceat(weight, start), count), np.repeat(start, count), np.repeat(np.arange(len(start)), count)
            out = []
            full = total > crowded
            away = full & (ids != ids[begin])
            if away.any():
                out.append(np.stack([ids[begin[away]], ids[away], np.ones(int(away.sum()), np.int64)], 1))
            if not last:  # the last node may go on: what is left of it is looked at again
                full |= number == number[-1]
            close = closing[np.minimum(n, len(closing) - 1)]
            for gap in range(1, int(count[~full[start]].max(initial=0))):
                i = np.flatnonzero((number[gap:] == number[:-gap]) & ~full[gap:])
                j = i + gap
                like = np.minimum(n[i], n[j]) * t.denominator >= np.maximum(n[i], n[j]) * t.numerator
                ok = like & (ids[i] != ids[j]) & share_prefix(path[i], path[j], np.minimum(close[i], close[j]))
                if ok.any():
                    x, y = ids[i[ok]], ids[j[ok]]
                    out.append(np.stack([np.minimum(x, y), np.maximum(x, y), np.zeros(len(x), np.int64)], 1))
            if last:
                return out, [x[:0] for x in rows]
            keep = np.arange(start[-1], len(tree))
            if total[-1] > crowded:
                keep = keep[:1]
            left = [x[keep] for x in rows]
            if total[-1] > crowded:
                left[4] = np.array([total[-1]])
            return out, left

        def found(out: list[np.ndarray]) -> pa.RecordBatch:
            pairs = np.unique(np.concatenate(out), axis=0) if out else np.zeros((0, 3), np.int64)
            return pa.RecordBatch.from_arrays([pa.array(pairs[:, 0]), pa.array(pairs[:, 1]), pa.array(pairs[:, 2] > 0)], names=["a", "b", "star"])

        for batch in batches:
            tree = batch.column(0).to_numpy().astype(np.int64)
            tied = tree < 0
            ids = batch.column(2).to_numpy()
            out = []
            if tied.any():
                head = batch.column(5).filter(pa.array(tied)).to_numpy()
                out.append(np.stack([head, ids[tied], np.ones(len(head), np.int64)], 1))
            new = [x[~tied] for x in (tree, batch.column(1).to_numpy(), ids, batch.column(3).to_numpy().astype(np.int64), batch.column(4).to_numpy())]
            more, held = nodes([np.concatenate(x) for x in zip(held, new, strict=True)], False)
            yield found(out + more)
        yield found(nodes(held, True)[0])

    met = trie.mapInArrow(tidy(walk), "a long, b long, star boolean").groupBy("a", "b").agg(F.max("star").alias("star"))
    met = scratch.put(met, "met")

    # crowded nodes: components of what is tied
    groups = scratch.put(connected_components(met.where("star").select("a", "b"), scratch, "stars"), "groups")
    pairs = met.where("NOT star").select("a", "b")
    pairs = pairs.join(groups.toDF("a", "ra"), "a", "left").join(groups.toDF("b", "rb"), "b", "left").where("ra IS NULL OR rb IS NULL OR ra <> rb").select("a", "b")

    pairs = scratch.put(pairs, "pairs")

    wanted = scratch.put(pairs.select(F.col("a").alias("id")).union(pairs.select("b")).union(groups.select("node")).distinct(), "wanted")
    wanted = members.join(wanted.withColumnRenamed("id", "node"), "node").groupBy(F.col("rep").alias("id")).agg(F.collect_list(F.struct("same", "node")).alias("nodes"))
    wanted = scratch.put(wanted, "wanted_ids")
    bitmap = id_bitmap(wanted.select("id"))

    def likely(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bits = np.frombuffer(bitmap, np.uint8)
        for batch in batches:
            at = _bit_of(batch.column(0).to_numpy())
            yield batch.filter(pa.array((bits[at >> 3] >> (at & 7)) & 1 == 1))

    def fetch(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(0, batch.num_rows, 512):
                part = batch.slice(i, 512)
                values, nodes = part.column(0).to_pylist(), part.column(1).to_pylist()
                node = [next((x["node"] for x in n if x["same"] == xxhash.xxh3_128_digest(b" ".join(v.encode().split()))), None) for v, n in zip(values, nodes, strict=True)]
                sets = [s.astype("<u8").tobytes() for s in shingle_sets(values, words)]
                found = pa.array([x is not None for x in node])
                yield pa.RecordBatch.from_arrays([pa.array(node, pa.int64()).filter(found), pa.array(sets, pa.binary()).filter(found)], names=["id", "s"])

    near = texts.where("id IS NOT NULL").mapInArrow(tidy(likely), "id long, t string")
    sets = near.join(wanted, "id").select("t", "nodes").mapInArrow(tidy(fetch), "id long, s binary").groupBy("id").agg(F.max("s").alias("s"))
    sets = scratch.put(sets.join(members.select(F.col("node").alias("id"), "size"), "id"), "sets")

    # other nodes: each pair by itself
    def verify(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            a, b = batch.column(0).to_pylist(), batch.column(1).to_pylist()
            sa, sb = batch.column(2).to_pylist(), batch.column(3).to_pylist()
            na, nb = batch.column(4).to_pylist(), batch.column(5).to_pylist()
            out: list[tuple[int, int, int]] = []
            for i in range(len(a)):
                x, y = np.frombuffer(sa[i], "<u8"), np.frombuffer(sb[i], "<u8")
                inter = len(np.intersect1d(x, y, assume_unique=True))
                if jaccard_links(inter, len(x), len(y), t):
                    low = min(a[i], b[i])
                    out += [(a[i], nb[i], low), (b[i], na[i], low)]
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in (zip(*out, strict=True) if out else ([], [], []))], names=["node", "links", "root"])

    one, two = (sets.toDF(c, f"s{c}", f"n{c}") for c in "ab")
    verified = pairs.join(one, "a").join(two, "b").select("a", "b", "sa", "sb", "na", "nb").mapInArrow(tidy(verify), "node long, links long, root long")

    # documents of like size within a component, block against block
    step = math.log(1 / (threshold - 1e-6))
    sized = groups.select(F.col("node").alias("id"), "root").join(reps.select(F.col("rep").alias("id"), "n"), "id")
    level = F.floor(F.log(F.col("n").cast("double")) / step).cast("int")
    sized = sized.withColumn("level", level).withColumn("group", F.explode(F.array(F.col("level"), F.col("level") - 1))).withColumn("home", F.col("level") == F.col("group"))
    room = F.greatest(F.lit(1), F.least(F.lit(block), F.floor(F.lit(BLOCK_SHINGLES) / F.max("n"))))
    blocks = pair_blocks(sized.select("root", "group", "id", "home", "n"), ["root", "group"], "id", room).drop("n").join(sets, "id")

    def compare(pdf: pd.DataFrame) -> pd.DataFrame:
        ids, sizes, home, side = (pdf[c].to_numpy() for c in ("id", "size", "home", "side"))
        rows = [np.frombuffer(s, "<u8") for s in pdf["s"]]
        n = np.array([len(r) for r in rows])
        inter = intersections(rows)
        linked = jaccard_links(inter, n[:, None], n[None, :], t)
        linked &= home[:, None] | home[None, :]
        if side.min() >= 0:
            linked &= side[:, None] != side[None, :]
        np.fill_diagonal(linked, False)
        some = linked.any(1)
        return pd.DataFrame({"node": ids[some], "links": (linked @ sizes)[some], "root": local_components(linked, ids)[some]})

    compared = blocks.groupBy("root", "group", "lo", "hi").applyInPandas(compare, "node long, links long, root long")
    found = scratch.put(verified.union(compared), "found")
    links = found.groupBy("node").agg(F.sum("links").alias("links"))
    same_id = members.where("node <> rep").select(F.col("node").alias("a"), F.col("rep").alias("b"))
    roots = connected_components(found.select(F.col("node").alias("a"), F.col("root").alias("b")).union(same_id), scratch, "links")

    classed = members.join(links, "node", "left").join(roots, "node", "left").drop("node")
    out = signed.select("id", "same", "n").join(classed, "same")
    some = F.col("n") > 0
    component = F.when(some, F.coalesce("root", "rep")).otherwise(F.col("id"))
    rows = out.select(
        F.col("id").alias(id_col),
        F.when(some, F.col("rep")).otherwise(F.col("id")).alias("class_id"),
        F.when(some, F.col("size")).otherwise(1).cast("long").alias("class_size"),
        F.when(some, F.col("size") - 1 + F.coalesce("links", F.lit(0))).otherwise(0).cast("long").alias("n_links"),
        component.alias("component_id"),
        (F.col("id") == component).alias("kept"),
    )
    null = F.lit(None).cast("long")
    return rows.unionByName(texts.where("id IS NULL").select(F.col("id").alias(id_col), null.alias("class_id"), F.lit(1).cast("long").alias("class_size"), F.lit(0).cast("long").alias("n_links"), null.alias("component_id"), F.lit(True).alias("kept")))


def intersections(rows: list[np.ndarray], columns: int = 8192) -> np.ndarray:
    """The sizes of all pairwise intersections of sorted sets, by products of 0/1 matrices over the values that occur twice or more."""
    flat = np.concatenate(rows)
    who = np.repeat(np.arange(len(rows)), [len(r) for r in rows])
    values, code, count = np.unique(flat, return_inverse=True, return_counts=True)
    shared = count > 1
    rank = np.cumsum(shared) - 1
    keep = shared[code]
    code, who = rank[code[keep]], who[keep]
    order = np.argsort(code, kind="stable")
    code, who = code[order], who[order]
    inter = np.zeros((len(rows), len(rows)))
    total = int(shared.sum())
    for start in range(0, total, columns):
        a, b = np.searchsorted(code, [start, start + columns])
        m = np.zeros((len(rows), min(columns, total - start)), np.float32)
        m[who[a:b], code[a:b] - start] = 1
        inter += m @ m.T
    inter = np.rint(inter).astype(np.int64)
    np.fill_diagonal(inter, [len(r) for r in rows])
    return inter
