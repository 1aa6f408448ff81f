"""Near-duplicate vectors by an exact metric range join.

On unit vectors a cosine of at least t is a distance of at most r = sqrt(2 - 2t). Pivots cut each label's vectors into cells: a vector's home
is its nearest pivot. If d(x, y) <= r, with homes i and j, the triangle inequality gives d(y, p_i) <= d(y, p_j) + 2r. So a copy of
every vector in each cell whose pivot is within 2r of being nearest makes the cells independent: a pair meets in the cell of its
smaller home, and nowhere else does it count. Large cells are cut into blocks, and pairs of blocks are the tasks.

Pivots save work where vectors cluster, and cells that stay large get pivots of their own, level by level. Unrelated vectors of many dimensions are all about as far
from a pivot as from any other, so most would be copied to most cells. A sample tells beforehand: what pivots would not at least halve stays one cell, and blocks compare all of it.
"""

from __future__ import annotations

import functools
import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidelake.llm.shared import Scratch, connected_components, local_components, pair_blocks, tidy


def usable(vector: Column, label: Column, key: Column) -> Column:
    """Whether a vector can link: key, label and vector are there, all components are finite, and one is not zero."""
    v = vector.cast("array<double>")
    finite = ~F.exists(v, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    return F.coalesce(key.isNotNull() & label.isNotNull() & vector.isNotNull() & finite & F.exists(v, lambda x: x != 0), F.lit(False))


def _unit(rows: np.ndarray) -> np.ndarray:
    rows = rows / np.abs(rows).max(axis=1, keepdims=True)
    return rows / np.linalg.norm(rows, axis=1, keepdims=True)


def _near(x: np.ndarray, pivots: np.ndarray, reach: float) -> tuple[np.ndarray, np.ndarray]:
    """Distances to the pivots, and whether a pivot is within reach of being the nearest."""
    d = np.sqrt(np.maximum(0, 2 - 2 * x @ pivots.T))
    return d, d <= d.min(1, keepdims=True) + reach


def _copies(x: np.ndarray, pivots: np.ndarray, reach: float) -> tuple[np.ndarray, np.ndarray]:
    """The home of each vector, and in which cells it stands: its home, and those before it that are near."""
    d, near = _near(x, pivots, reach)
    home = d.argmin(1)
    return home, near & (np.arange(d.shape[1]) <= home[:, None])


def _saves(x: np.ndarray, pivots: np.ndarray, reach: float) -> bool:
    """Whether cells of these pivots have at most half the pairs of the whole, judged by a sample."""
    return len(pivots) > 1 and len(x) > 0 and float((_copies(x, pivots, reach)[1].mean(0) ** 2).sum()) <= 0.5


def link_vectors(
    vectors: DataFrame,
    threshold: float = 0.93,
    cell_rows: int = 4000,
    all_pivots: int = 4096,
    fan_out: int = 1024,
    block: int = 2048,
    id_col: str = "vec_id",
    vec_col: str = "embedding",
    label_col: str = "label",
) -> DataFrame:
    """(id, n_links, component_id, kept) of every row.

    n_links: other vectors of the label at a cosine of at least the threshold, in double precision. component_id: the smallest id that links
    reach, its own included; kept: whether that is its own. Vectors that are null or zero or hold null or non-finite components, and those
    without a label or an id, link with nothing (a null id has a null component and is kept). Vectors of different lengths don't link. Equal
    vectors of a label are joined as one and counted as many. Rows with equal ids are vectors of their own and one node of the components.

    Pivots are a sample by hash, one for cell_rows vectors and fan_out at most. Those of the largest labels, all_pivots in all, are held in memory and need no shuffle; other
    labels, and cells that still have more than cell_rows vectors, meet their pivots by a shuffle, as often as it helps. They only save work: every pair within reach is
    compared, in blocks of `block` rows, which bounds a task. Vectors of floats are moved as floats, which loses nothing, and compared in double precision.
    """
    kind = dict(vectors.dtypes)[vec_col]
    kind = kind if kind == "array<float>" else "array<double>"
    spark = vectors.sparkSession
    scratch = Scratch(spark, "vectors")
    rows = vectors.select(F.col(id_col).alias("id"), F.col(label_col).alias("label"), F.col(vec_col).cast(kind).alias("v"), usable(F.col(vec_col), F.col(label_col), F.col(id_col)).alias("ok"))
    rows = scratch.put(rows.withColumn("k", F.xxhash64("v")), "rows")

    classes = rows.where("ok").groupBy("label", "k", "v").agg(F.min("id").alias("rep"), F.count(F.lit(1)).alias("size"))
    classes = scratch.put(classes.withColumn("dim", F.size("v")), "classes")

    reach = 2 * math.sqrt(max(0.0, 2 - 2 * threshold)) + 1e-9
    judged = 64  # vectors beside the pivots, at least, by which these are judged

    def large(members: DataFrame, keys: list[str]) -> DataFrame:
        """The groups that need pivots: their rows, pivots, and the share of rows that a sample of enough vectors takes."""
        found = members.groupBy(*keys).agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > cell_rows)
        found = found.withColumn("p", F.least(F.lit(fan_out), F.ceil(F.col("n") / cell_rows)).cast("int"))
        return found.withColumn("share", F.least(F.lit(1.0), 3 * (F.col("p") + F.greatest("p", F.lit(judged))) / F.col("n")))

    def sampled(members: DataFrame, groups: DataFrame, keys: list[str], level: int) -> DataFrame:
        """keys, p and s: about 2p vectors of each group, in an order by hash."""
        drawn = members.join(groups, keys).where(F.pmod(F.xxhash64("rep", F.lit(11 + 2 * level)), F.lit(1 << 30)) < F.col("share") * (1 << 30))
        taken = F.sort_array(F.collect_list(F.struct(F.xxhash64("rep", F.lit(12 + 2 * level)).alias("h"), "v")))
        return drawn.groupBy(*keys).agg(F.slice(taken, F.lit(1), F.max("p") + F.greatest(F.max("p"), F.lit(judged))).alias("s"), F.max("p").alias("p"))

    # the largest labels, by pivots in memory
    pivots: dict[tuple, np.ndarray] = {}
    tried, left = [], 2 * all_pivots
    for r in large(classes, ["label", "dim"]).orderBy(F.col("n").desc(), "label", "dim").limit(all_pivots // judged).collect():
        if (need := r.p + max(r.p, judged)) <= left:
            tried.append(r)
            left -= need
    refused = {(r.label, r.dim) for r in tried}
    if tried:
        names = spark.createDataFrame([(r.label, r.dim, r.p, r.share) for r in tried], f"label {dict(classes.dtypes)['label']}, dim int, p int, share double")
        for r in sampled(classes, F.broadcast(names), ["label", "dim"], 0).collect():
            sample = _unit(np.array([x.v for x in r.s], float))
            if _saves(sample[r.p :], sample[: r.p], reach):
                pivots[(r.label, r.dim)] = sample[: r.p]
                refused.discard((r.label, r.dim))

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """cell; mask: a bit for each level, whether the cell is the vector's home there; open: whether the cell may get pivots of its own."""
        for batch in batches:
            labels, dims = batch.column(0).to_pylist(), batch.column(1).to_pylist()
            at, cells, homes, still = [], [], [], []
            groups: dict[tuple, list[int]] = {}
            for i, key in enumerate(zip(labels, dims, strict=True)):
                groups.setdefault(key, []).append(i)
            for key, members in groups.items():
                if key not in pivots:
                    at += members
                    cells += ["0"] * len(members)
                    homes += [1] * len(members)
                    still += [key not in refused] * len(members)
                    continue
                for a in range(0, len(members), 1024):
                    some = members[a : a + 1024]
                    x = _unit(np.array(batch.column(3).take(pa.array(some)).to_pylist(), float))
                    home, copies = _copies(x, pivots[key], reach)
                    r, c = np.nonzero(copies)
                    at += [some[i] for i in r]
                    cells += [str(i) for i in c.tolist()]
                    homes += (c == home[r]).astype(int).tolist()
                    still += [True] * len(r)
            take = pa.array(at, pa.int64())
            yield pa.RecordBatch.from_arrays([*(c.take(take) for c in batch.columns), pa.array(cells, pa.string()), pa.array(homes, pa.int64()), pa.array(still, pa.bool_())], names=[*batch.schema.names, "cell", "mask", "open"])

    kinds = dict(classes.dtypes)
    columns = f"label {kinds['label']}, dim int, rep {kinds['rep']}, v {kind}, size long, cell string, mask long"
    dealt = classes.select("label", "dim", "rep", "v", "size").mapInArrow(tidy(deal), f"{columns}, open boolean")
    dealt = scratch.put(dealt, "dealt")

    # cells that are still large, and other large labels, by pivots that meet them in a shuffle
    keys = ["label", "dim", "cell"]

    def choose(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            good = []
            for p, s in zip(batch.column("p").to_pylist(), batch.column("s"), strict=True):
                sample = _unit(np.array(s.values.field("v").to_pylist(), float))
                good.append(_saves(sample[p:], sample[:p], reach))
            yield batch.filter(pa.array(good, pa.bool_()))

    def split(rows: pd.DataFrame, chosen: pd.DataFrame) -> pd.DataFrame:
        own = _unit(np.stack(chosen.sort_values("i")["v"].to_numpy()).astype(float))  # a cell is named by its pivot's place, in all parts alike
        parts = []
        for a in range(0, len(rows), 1024):
            some = rows.iloc[a : a + 1024]
            home, copies = _copies(_unit(np.stack(some["v"].to_numpy()).astype(float)), own, reach)
            r, c = np.nonzero(copies)
            part = some.iloc[r][["label", "dim", "rep", "v", "size", "cell", "mask"]].copy()
            part["cell"] = [f"{x}.{i}" for x, i in zip(part["cell"], c.tolist(), strict=True)]
            part["mask"] = part["mask"].to_numpy() * 2 + (c == home[r])
            parts.append(part)
        return pd.concat(parts) if parts else rows[["label", "dim", "rep", "v", "size", "cell", "mask"]]

    ready, still, level = [(dealt.where("NOT open").drop("open"), 1)], dealt.where("open").drop("open"), 1
    while level < 40:
        groups = scratch.put(large(still, keys), f"large{level}")
        if not groups.limit(1).count():
            break
        seen = sampled(still, groups, keys, level)
        seen = seen.mapInArrow(tidy(choose), seen.schema)
        salts = F.ceil(F.col("n") / (8 * fan_out)).cast("int")
        seen = scratch.put(seen.join(groups.select(*keys, salts.alias("salts")), keys), f"pivots{level}")
        if not seen.limit(1).count():
            break
        ready.append((still.join(seen.select(*keys), keys, "left_anti").select(*dealt.drop("open").columns), level))
        salted = still.join(seen.select(*keys, "salts"), keys).withColumn("salt", F.pmod(F.xxhash64("rep", F.lit(7)), F.col("salts")).cast("int")).drop("salts")
        own = seen.select(*keys, F.explode(F.sequence(F.lit(0), F.col("salts") - 1)).alias("salt"), F.slice("s", F.lit(1), F.col("p")).alias("s")).select(*keys, "salt", F.posexplode("s.v").alias("i", "v"))
        level += 1
        still = scratch.put(salted.groupBy(*keys, "salt").cogroup(own.groupBy(*keys, "salt")).applyInPandas(lambda rows, chosen: split(rows, chosen) if len(rows) else rows.drop(columns="salt"), columns), f"split{level}")
    ready.append((still, level))
    parts = [part.withColumn("mask", ((F.col("mask") + 1) * (1 << (level - k)) - 1).cast("long")) for part, k in ready]
    blocks = pair_blocks(functools.reduce(lambda x, y: x.unionByName(y), parts), keys, "rep", block)
    homes = (1 << level) - 1

    def compare(pdf: pd.DataFrame) -> pd.DataFrame:
        x, ids, sizes, home = np.stack(pdf["v"].to_numpy()).astype(float), pdf["rep"].to_numpy(), pdf["size"].to_numpy(), pdf["mask"].to_numpy()
        x = x / np.abs(x).max(axis=1, keepdims=True)
        norm = np.linalg.norm(x, axis=1)
        linked = (x @ x.T) / np.outer(norm, norm) >= threshold
        linked &= (home[:, None] | home[None, :]) == homes  # two copies meet in a cell of their own
        side = pdf["side"].to_numpy()
        if side.min() >= 0:  # two blocks: pairs within one are another task's
            linked &= side[:, None] != side[None, :]
        np.fill_diagonal(linked, False)
        some = linked.any(1)
        return pd.DataFrame({"node": ids[some], "links": (linked @ sizes)[some], "root": local_components(linked, ids)[some]})

    found = blocks.groupBy("label", "dim", "cell", "lo", "hi").applyInPandas(compare, f"node {kinds['rep']}, links long, root {kinds['rep']}")
    found = scratch.put(found, "found")
    links = found.groupBy("node").agg(F.sum("links").alias("links"))
    roots = connected_components(found.select(F.col("node").alias("a"), F.col("root").alias("b")), scratch)

    out = rows.join(classes.withColumn("ok", F.lit(True)).select("ok", "label", "k", "v", "rep", "size"), ["ok", "label", "k", "v"], "left")
    out = out.join(links.withColumnRenamed("node", "rep"), "rep", "left").join(roots.withColumnRenamed("node", "rep"), "rep", "left")
    component = F.coalesce("root", "rep", "id")
    n_links = F.when(F.col("ok"), F.col("size") - 1 + F.coalesce("links", F.lit(0))).otherwise(0).cast("long")
    return out.select(F.col("id").alias(id_col), n_links.alias("n_links"), component.alias("component_id"), F.coalesce(F.col("id") == component, F.lit(True)).alias("kept"))
