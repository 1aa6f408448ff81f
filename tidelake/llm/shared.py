"""What several operators need: shared scratch tables and connected components."""

from __future__ import annotations

import ctypes
import functools
import itertools
import os
import tempfile
import uuid
import zipfile
from collections.abc import Callable, Iterator
from pathlib import Path

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: A word, wherever these operators count or compare words: a run of characters that are not ASCII white space.
WORD = r"[^\x20\x09-\x0D]+"


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir, and a local folder only where that is unset, as in tests."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        found = spark.sparkContext.getCheckpointDir()
    if not found:
        found = tempfile.mkdtemp(prefix="tidelake-")
        spark.sparkContext.setCheckpointDir(found)
    return found.rstrip("/")


#: Most bytes of an Arrow batch, and Spark's default for it.
BATCH, BATCH_DEFAULT = "spark.sql.execution.arrow.maxBytesPerBatch", "67108864b"


def ship(spark: SparkSession) -> None:
    """Prepares the session for Python workers: smaller Arrow batches, where nothing else is set, and this package.

    It is sent where neither the workers' folder nor PYTHONPATH leads to it. A cluster that has it installed, or gets it by --py-files, needs
    nothing."""
    if spark.conf.get(BATCH) == BATCH_DEFAULT:  # a batch is in the JVM's and the worker's memory at once, next to its Python copies
        spark.conf.set(BATCH, "16m")
    package = Path(__file__).resolve().parents[1]
    known = {Path(p or ".").resolve() for p in (os.getcwd(), *os.environ.get("PYTHONPATH", "").split(os.pathsep))}
    context = spark.sparkContext
    if package.parent in known or package.parent.name == "site-packages" or getattr(context, "_tidelake_shipped", False):
        return
    target = Path(tempfile.mkdtemp(prefix="tidelake-")) / f"{package.name}.zip"
    with zipfile.ZipFile(target, "w") as z:
        for f in sorted(package.rglob("*.py")):
            z.write(f, f.relative_to(package.parent))
    context.addPyFile(str(target))
    context._tidelake_shipped = True


def tidy(run: Callable[[Iterator], Iterator]) -> Callable[[Iterator], Iterator]:
    """The function of a task, which at its end gives freed memory back to the system: workers outlive tasks, and an executor has several."""

    def tidied(batches: Iterator) -> Iterator:
        yield from run(batches)
        pa.default_memory_pool().release_unused()
        if trim := getattr(ctypes.CDLL(None), "malloc_trim", None):
            trim(0)

    return tidied


class Scratch:
    """Written tables in the shared folder. They cut lineage and outlive lost executors; drop() removes what is no longer read."""

    def __init__(self, spark: SparkSession, tag: str):
        ship(spark)
        self.spark, self.root = spark, f"{shared_dir(spark)}/tidelake/{tag}-{uuid.uuid4().hex}"

    def put(self, df: DataFrame, name: str) -> DataFrame:
        path = f"{self.root}/{name}"
        df.write.parquet(path)
        return self.spark.read.schema(df.schema).parquet(path)

    def drop(self, *names: str) -> None:
        jvm = self.spark.sparkContext._jvm
        for name in names:
            path = jvm.org.apache.hadoop.fs.Path(f"{self.root}/{name}")
            path.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


_BASE = 0x9E3779B97F4A7C15 | 1
_LETTERS = np.random.default_rng(17).integers(1, 1 << 63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_BLANK = np.isin(np.arange(256), [9, 10, 11, 12, 13, 32])


@functools.lru_cache(maxsize=2)
def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """The first n powers of the base and of its inverse, modulo 2^64."""
    out = []
    for base in (_BASE, pow(_BASE, -1, 1 << 64)):
        x = np.full(n, np.uint64(base))
        x[0] = 1
        out.append(np.multiply.accumulate(x))
    return out[0], out[1]


def word_places(texts: list[str | None]) -> tuple[bytes, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """All texts in UTF-8 with blanks around them; where each text begins in it, and the end; where each word begins and ends; and the first word of each text, and
    their number."""
    datas = [(t or "").encode() for t in texts]
    data = b" ".join([b"", *datas, b""])
    blank = _BLANK[np.frombuffer(data, np.uint8)]
    edges = np.flatnonzero(blank[1:] != blank[:-1]) + 1
    starts, ends = edges[::2], edges[1::2]
    begins = np.cumsum([1] + [len(d) + 1 for d in datas])
    return data, begins, starts, ends, np.searchsorted(starts, begins)


def flat_hashes(texts: list[str | None], chunk: int = 1 << 15) -> tuple[np.ndarray, np.ndarray]:
    """64-bit hashes of all texts' words: polynomials over random numbers for the bytes, from running sums over many bytes at once; and where each text's
    begin, and the end. Texts are worked through in chunks between words, which fit the processor's cache."""
    data, _, starts, ends, cuts = word_places(texts)
    data = np.frombuffer(data, np.uint8)
    out, i = np.zeros(len(starts), np.uint64), 0
    while i < len(starts):
        a = starts[i]
        j = max(i + 1, int(np.searchsorted(ends, a + chunk, "right")))
        n = int(ends[j - 1] - a)
        up, down = powers(max(1 << 19, 1 << n.bit_length()))
        sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum(_LETTERS[data[a : a + n]] * up[:n], dtype=np.uint64)])
        s, e = starts[i:j] - a, ends[i:j] - a
        x = (sums[e] - sums[s]) * down[s]
        out[i:j] = (x ^ (x >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
        i = j
    return out, cuts


def word_hashes(texts: list[str | None], chunk: int = 1 << 15) -> list[np.ndarray]:
    """The hashes of each text's words."""
    out, cuts = flat_hashes(texts, chunk)
    return [out[a:b] for a, b in itertools.pairwise(cuts.tolist())]


class Memo:
    """A bounded memo in two generations: what is asked for again stays, the rest goes when the young generation is full. most: entries of both;
    keys longer than keep_bytes are not kept."""

    def __init__(self, most: int, keep_bytes: int):
        self.half, self.keep_bytes, self.young, self.old = most // 2, keep_bytes, {}, {}

    def get(self, keys: list[bytes], make: Callable[[list[bytes]], list]) -> list:
        """The value of each key; make gives those of the keys that are not here. keys are distinct."""
        out = list(map(self.young.get, keys))
        holes = [i for i, x in enumerate(out) if x is None]
        if not holes:
            return out
        if len(self.young) + len(holes) > self.half:
            self.old, self.young = self.young, {}
        found = list(map(self.old.get, map(keys.__getitem__, holes)))
        new = [i for i, x in zip(holes, found, strict=True) if x is None]
        made = iter(make([keys[i] for i in new]))
        for i, x in zip(holes, found, strict=True):
            out[i] = next(made) if x is None else x
        most = self.keep_bytes
        self.young.update((keys[i], out[i]) for i in holes if len(keys[i]) <= most)
        return out


def join_counted(rows: DataFrame, keys: DataFrame, key: str, n: str, share: int = 4096) -> DataFrame:
    """rows joined with keys, which has one row for a key and counts its rows in column n.

    Keys with more than one part in `share` of all counted rows can only be fewer than `share`, so these are broadcast, and their rows stay where they are;
    only the rows of the other keys are shuffled. So no key, however hot, lands in one task. Both sides are read twice: give written tables.
    """
    total = keys.agg(F.sum(n)).first()[0] or 0
    hot = F.broadcast(keys.where(F.col(n) * share > total))
    rest = rows.join(F.broadcast(hot.select(key)), key, "left_anti").join(keys.where(F.col(n) * share <= total), key)
    return rows.join(hot, key).unionByName(rest)


def pair_blocks(members: DataFrame, group: list[str], key: str, block: int | Column) -> DataFrame:
    """Deals the rows of each group to pairs of blocks, so that every two rows of a group meet in exactly one (group, lo, hi).

    A group of m rows has ceil(m / block) blocks (block: a number, or an aggregate over the group), by a hash of the key; each row goes to as many pairs as there are blocks. side tells the
    two blocks of a pair apart; it is -1 where the pair is a block with itself.
    """
    names = {c: f"_g{i}" for i, c in enumerate(group)}
    sizes = members.groupBy(*[F.col(c).alias(n) for c, n in names.items()]).agg(F.ceil(F.count(F.lit(1)) / block).cast("int").alias("_nb"))
    same = functools.reduce(lambda x, y: x & y, [F.col(c).eqNullSafe(F.col(n)) for c, n in names.items()])
    joined = members.join(sizes, same).drop(*names.values())
    own = joined.withColumn("_own", F.pmod(F.xxhash64(key), F.col("_nb")).cast("int")).withColumn("_other", F.explode(F.sequence(F.lit(0), F.col("_nb") - 1)))
    pairs = own.withColumn("lo", F.least("_own", "_other")).withColumn("hi", F.greatest("_own", "_other"))
    return pairs.withColumn("side", F.when(F.col("lo") == F.col("hi"), -1).otherwise(F.col("_own"))).drop("_nb", "_own", "_other")


def local_components(linked: np.ndarray, ids: np.ndarray) -> np.ndarray:
    """For each row of a symmetric boolean matrix the smallest id that its links reach."""
    root = ids.copy()
    neighbours = [np.flatnonzero(row) for row in linked]
    todo = np.argsort(ids, kind="stable")
    done = np.zeros(len(ids), bool)
    for start in todo:
        if done[start]:
            continue
        done[start], stack = True, [start]
        while stack:
            near = neighbours[stack.pop()]
            near = near[~done[near]]
            done[near] = True
            root[near] = ids[start]
            stack.extend(near.tolist())
    return root


def connected_components(edges: DataFrame, scratch: Scratch, name: str = "cc", most_rounds: int = 60) -> DataFrame:
    """(node, root) for every node of the undirected edges (a, b): root is the smallest node that links reach.

    Alternating star contraction: each round points the neighbours of a node at its smallest neighbour, which keeps the
    components and roughly halves the depth. Hubs are joined, never gathered, and every round is a written table.
    Self-loops and repeated edges are allowed; nodes that are in no edge between different nodes are absent.
    """
    e = edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).where("a <> b").distinct()
    e = scratch.put(e, f"{name}0")
    for i in range(1, most_rounds + 1):
        low = e.groupBy("a").agg(F.min("b").alias("m"), F.count(F.lit(1)).alias("n"))
        twice = low.where("n > 1").limit(1).count()
        if not twice and not e.join(e.select(F.col("b").alias("a")).distinct(), "a", "left_semi").limit(1).count():
            return e.select(F.col("a").alias("node"), F.col("b").alias("root")).union(e.select(F.col("b"), F.col("b")).distinct())
        small = e.join(low.select("a", "m"), "a").select(F.when(F.col("b") == F.col("m"), F.col("a")).otherwise(F.col("b")).alias("a"), F.col("m").alias("b")).distinct()
        small = scratch.put(small, f"{name}{i}s")
        near = small.union(small.select("b", "a")).toDF("u", "v").groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        large = small.join(near.withColumnRenamed("u", "b"), "b").select("a", F.col("m").alias("b")).where("a <> b").distinct()
        e = scratch.put(large, f"{name}{i}")
        scratch.drop(f"{name}{i - 1}", f"{name}{i}s")
    raise RuntimeError(f"components did not settle in {most_rounds} rounds")
