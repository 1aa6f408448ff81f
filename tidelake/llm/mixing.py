"""Mixing sources to target weights by Sainte-Laguë apportionment.

Words are dealt in equal blocks. Every source gets a whole number of blocks by the highest quotients target / (2k + 1), then every shard of
a source by the highest quotients size / (2k + 1). A shard's documents stand in a seeded order, one after the other, in a ring of words; it
gives whole turns of the ring, and then as many words from a seeded block on as its quota has left. What a shard cannot give under the cap, the
source's other shards give. So the words taken meet the quotas to
the word, a document is taken at most as often as the cap says, and every run agrees.

Everything is DataFrame functions. Only the candidates near the rounding border are ranked: a divisor's bounds give all other seats.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidelake.llm.shared import WORD, Scratch


def _all():
    """Over all rows; only for tables with a row per source."""
    return Window.partitionBy()


def _hash32(digest: Column) -> Column:
    return F.conv(F.substring(digest, 1, 8), 16, 10).cast("long")


def _seats(df: DataFrame, keys: list[str], votes: str, total: Column, within: list[str]) -> DataFrame:
    """keys and seats: `total` seats of each group `within`, given to the highest quotients votes / (2k + 1); ties go by the keys.

    With n keys, V votes and N seats the divisor lies between V / (N + n/2) and V / (N - n/2), which bounds each key's seats from both
    sides; only the seats between the bounds are laid out and ranked, about two for each key.
    """
    w = Window.partitionBy(*within)
    x = df.withColumns({"_n": F.count(F.lit(1)).over(w), "_v": F.sum(F.col(votes).cast("double")).over(w), "_seats": total})
    share = lambda seats: F.when(F.col("_v") > 0, F.floor(F.col(votes) * seats / F.col("_v") + 0.5)).otherwise(0)
    x = x.withColumns({"_lo": F.greatest(F.lit(0), share(F.col("_seats") - F.col("_n") / 2) - 1).cast("long"), "_hi": (share(F.col("_seats") + F.col("_n") / 2) + 1).cast("long")})
    x = x.withColumn("_left", F.col("_seats") - F.sum("_lo").over(w)).withColumn("_k", F.explode(F.sequence("_lo", "_hi")))
    order = [(F.col(votes) / (2 * F.col("_k") + 1)).desc(), *[F.col(k).asc() for k in keys], F.col("_k").asc()]
    won = (F.row_number().over(Window.partitionBy(*within).orderBy(*order)) <= F.col("_left")) & (F.col(votes) > 0)
    return x.withColumn("_won", won.cast("long")).groupBy(*keys).agg((F.max("_lo") + F.sum("_won")).alias("seats"))


def source_targets(sizes: DataFrame, weights: tuple[int, ...], cap: float) -> DataFrame:
    """(skey, source_size, n_docs, target) for each source.

    Sources stand by code point, null last, and weigh as `weights` says, over and over. All words are shared by weight; a target stops at
    cap times its source's size, and what it leaves is shared by weight among the others, until none is above. That is a water level l with
    target = min(cap * size, l * weight); filled in the order of cap * size / weight, the level is the largest that occurs on the way.
    """
    src = sizes.groupBy("source").agg(F.sum("size").alias("source_size"), F.count(F.lit(1)).alias("n_docs"))
    rank = F.row_number().over(_all().orderBy(F.col("source").asc_nulls_last()))
    src = src.withColumn("weight", F.element_at(F.array(*map(F.lit, weights)), (F.pmod(rank - 1, F.lit(len(weights))) + 1).cast("int")))
    src = src.withColumn("_cap", cap * F.col("source_size"))
    by_fill = _all().orderBy((F.col("_cap") / F.col("weight")).asc(), F.col("source").asc_nulls_last())
    before = F.coalesce(F.sum("_cap").over(by_fill.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    level = (F.sum("source_size").over(_all()) - before) / F.sum("weight").over(by_fill.rowsBetween(0, Window.unboundedFollowing))
    src = src.withColumn("_level", level).withColumn("target", F.least(F.col("_cap").cast("double"), F.max("_level").over(_all()) * F.col("weight")))
    return src.select(_skey(F.col("source")).alias("skey"), "source_size", "n_docs", "target")


def _skey(source: Column) -> Column:
    return F.coalesce(F.concat(F.lit("s"), source), F.lit("n"))


def mix(
    docs: DataFrame,
    weights: tuple[int, ...] = (5, 2, 1),
    cap: int = 3,
    seed: int = 7,
    block: int = 4,
    docs_per_shard: int = 1024,
    id_col: str = "doc_id",
    text_col: str = "text",
    source_col: str = "source",
) -> DataFrame:
    """(id, size, source_size, target, taken, whole, start, part) of every row.

    size: words of the text (null: 0). taken: words that the mix takes, repeats counted: the document `whole` times, and once more `part` of
    its words from word `start` on, running on at the document's first word where they pass its end. Blocks have `block` words, whatever the
    corpus. A null source is a source of its own, a null id hashes as an empty string; rows with equal ids stand beside each other in the ring. Sources without words have the target 0; an empty table gives no rows.

    A hot source is split into shards of about docs_per_shard documents by a seeded hash, so no task holds a source's documents; sums are aggregated before they
    are shuffled. One task ranks a source's shards, two or three short rows for each 1024 documents, and one the sources.
    """
    scratch = Scratch(docs.sparkSession, "mix")
    digest = F.md5(F.concat(F.lit(f"{seed}|"), F.coalesce(F.col(id_col).cast("string"), F.lit(""))).cast("binary"))
    sizes = docs.select(F.col(id_col).alias("_id"), F.col(source_col).alias("source"), F.coalesce(F.regexp_count(F.col(text_col), F.lit(WORD)), F.lit(0)).cast("long").alias("size"), digest.alias("_h"))
    sizes = scratch.put(sizes, "sizes")

    src = scratch.put(source_targets(sizes, weights, cap), "sources")
    src = src.withColumn("block", F.lit(block).cast("long"))
    blocks = F.floor(F.sum("source_size").over(_all()) / F.col("block") + 0.5).cast("long")
    quotas = _seats(src, ["skey"], "target", blocks, [])
    n_shards = F.ceil(F.col("n_docs") / docs_per_shard).cast("long")
    src = scratch.put(src.join(quotas, "skey").withColumn("n_shards", n_shards), "quotas")

    dealt = sizes.withColumn("skey", _skey(F.col("source"))).join(src, "skey").withColumn("shard", F.pmod(_hash32(F.col("_h")), F.col("n_shards")))
    shards = dealt.groupBy("skey", "shard").agg(F.sum("size").alias("shard_size"), F.max("seats").alias("source_seats"), F.max("block").alias("_block"))
    shares = _seats(shards, ["skey", "shard"], "shard_size", F.col("source_seats"), ["skey"])
    shards = shards.join(shares, ["skey", "shard"]).withColumn("words", F.least(F.col("seats") * F.col("_block"), cap * F.col("shard_size")))
    # words of seats that a shard cannot fill go to the source's other shards, by the room that they have
    source, upto = Window.partitionBy("skey"), Window.partitionBy("skey").orderBy("shard").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    shards = shards.withColumn("_room", cap * F.col("shard_size") - F.col("words"))
    shards = shards.withColumns({"_rooms": F.sum("_room").over(source), "_upto": F.sum("_room").over(upto), "_unfilled": F.col("source_seats") * F.col("_block") - F.sum("words").over(source)})
    given = lambda at: f"coalesce((cast(least(_unfilled, _rooms) AS decimal(19, 0)) * cast({at} AS decimal(19, 0))) div cast(nullif(_rooms, 0) AS decimal(19, 0)), 0L)"
    shards = shards.withColumn("words", F.col("words") + F.expr(f"{given('_upto')} - {given('(_upto - _room)')}"))
    first = F.pmod(_hash32(F.md5(F.concat_ws("|", F.lit(str(seed)), "skey", F.col("shard").cast("string")).cast("binary"))), F.greatest(F.lit(1), F.ceil(F.col("shard_size") / F.col("_block")))) * F.col("_block")
    turns = F.when(F.col("shard_size") > 0, F.floor(F.col("words") / F.col("shard_size"))).otherwise(0).cast("long")
    shards = shards.select("skey", "shard", "shard_size", turns.alias("whole"), (F.col("words") - turns * F.col("shard_size")).alias("rest"), first.alias("first"))

    ring = Window.partitionBy("skey", "shard").orderBy("_h", "_id", "size").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    placed = dealt.join(shards, ["skey", "shard"]).withColumn("end", F.sum("size").over(ring)).withColumn("begin", F.col("end") - F.col("size"))
    stop = F.col("first") + F.col("rest")
    ahead = F.greatest(F.lit(0), F.least(F.col("end"), stop) - F.greatest(F.col("begin"), F.col("first")))
    behind = F.greatest(F.lit(0), F.least(F.col("end"), stop - F.col("shard_size")) - F.col("begin"))
    part = (ahead + behind).cast("long")
    start = F.when(ahead > 0, F.greatest(F.col("begin"), F.col("first")) - F.col("begin")).otherwise(0).cast("long")
    return placed.select(
        F.col("_id").alias(id_col), "size", "source_size", "target", (F.col("whole") * F.col("size") + part).cast("long").alias("taken"), "whole", start.alias("start"), part.alias("part")
    )


#: Between a character of a word and white space: cuts a text into stretches that each hold one word.
BEFORE_BLANK = r"(?<=[^\x20\x09-\x0D])(?=[\x20\x09-\x0D])"


def take(docs: DataFrame, mixed: DataFrame, id_col: str = "doc_id", text_col: str = "text", chars_col: str | None = "n_chars") -> DataFrame:
    """The mixed corpus itself, with the columns of docs: a row for each whole repeat of a document, and one with the part that was taken.

    A part that runs past the end goes on at the first word, behind a line feed. A document without words comes as often as its shard has whole
    turns. Of rows with equal ids (a null id is one too) each comes as often as the one that the mix took most of.
    """
    plan = mixed.groupBy(F.col(id_col).alias("_key")).agg(F.max("whole").alias("_whole"), F.max(F.struct("part", "start")).alias("_p"))
    joined = docs.join(plan, F.col(id_col).eqNullSafe(F.col("_key"))).drop("_key")
    cut = F.split(F.col(text_col), BEFORE_BLANK, -1)
    tail = F.array_join(F.slice(cut, F.col("_p.start").cast("int") + 1, F.col("_p.part").cast("int")), "")
    over = (F.col("_p.start") + F.col("_p.part") - F.regexp_count(F.col(text_col), F.lit(WORD))).cast("int")
    piece = F.when(over > 0, F.concat(tail, F.lit("\n"), F.array_join(F.slice(cut, F.lit(1), F.greatest(over, F.lit(0))), ""))).otherwise(tail)
    copies = F.concat(F.array_repeat(F.struct(F.lit(False).alias("cut")), F.col("_whole").cast("int")), F.when(F.col("_p.part") > 0, F.array(F.struct(F.lit(True).alias("cut")))).otherwise(F.array().cast("array<struct<cut:boolean>>")))
    rows = joined.withColumn("_c", F.explode(copies)).withColumn(text_col, F.when(F.col("_c.cut"), piece).otherwise(F.col(text_col)))
    if chars_col and chars_col in docs.columns:
        rows = rows.withColumn(chars_col, F.length(text_col).cast(dict(docs.dtypes)[chars_col]))
    return rows.select(*docs.columns)
