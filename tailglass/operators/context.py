"""Matches with the lines around them, gaps between, and the cap on what one file may store.

Lines are dealt by blocks of a file's lines, each with the few lines around it, so a file of any length is many tasks;
what a block must know of the blocks before it (how many lines and hits) are sums, one row a block.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

#: Lines of one block.
BLOCK = 1 << 16


def _seg(lines: DataFrame) -> DataFrame:
    return lines if "seg" in lines.columns else lines.withColumn("seg", F.lit(0))


def blocked(lines: DataFrame, place: str, size: int) -> DataFrame:
    """``lines`` with their block ``_k``: file, path, seg and a range of ``place``; a struct, so nulls are equal."""
    return lines.withColumn("_k", F.struct("file", "path", "seg", F.floor(F.col(place) / size).alias("block")))


def sums_before(blocks: DataFrame, value: str, *within: str) -> DataFrame:
    """_k and the sum of ``value`` over the earlier blocks of the same file (and path): a row for each block."""
    keys = [F.col(f"_k.{c}") for c in within]
    earlier = Window.partitionBy(*keys).orderBy("_k.seg", "_k.path", "_k.block").rowsBetween(Window.unboundedPreceding, -1)
    return blocks.select("_k", F.coalesce(F.sum(value).over(earlier), F.lit(0)).alias("_before"))


def placed(lines: DataFrame, size: int) -> DataFrame:
    """``lines`` with ``rn``: the place in the path among the rows given."""
    rows = blocked(lines, "number", size)
    own = Window.partitionBy("_k").orderBy("number", *(["frag"] if "frag" in lines.columns else []))
    before = sums_before(rows.groupBy("_k").agg(F.count("*").alias("n")), "n", "file", "path")
    rows = rows.withColumn("rn", F.row_number().over(own)).join(before, "_k")
    return rows.withColumn("rn", F.col("rn") + F.col("_before")).drop("_k", "_before")


def with_context(lines: DataFrame, n: int, skips: bool = True, size: int = BLOCK) -> DataFrame:
    """Of ``matched`` lines, the hits and up to ``n`` lines before and after each, within one path.

    rn: place in the path, of all rows given; mno: hits of the file up to here; prev: place of the last hit, where it is
    at most ``n`` before; nmno: the number of the next hit of the path, where it is at most ``n`` ahead; before, after:
    whether the row is context of a hit after or before it; gap: whether something is left out between the row and
    the one before it that is kept (false for the first).  ``skips``: numbers may skip, so places are counted first."""
    lines = _seg(lines)
    lines = placed(lines, size) if skips else lines.withColumn("rn", F.col("number"))
    # each line goes to its block, and to those whose lines have it among the n + 1 around them
    first, last = (F.floor(F.greatest(F.col("rn") + d, F.lit(1)) / size) for d in (-n - 1, n + 1))
    own = F.floor(F.col("rn") / size)
    there = lines.withColumn("_b", F.explode(F.when(first == last, F.array(own)).otherwise(F.sequence(first, last))))
    rows = there.withColumn("_k", F.struct("file", "path", "seg", F.col("_b").alias("block")))
    in_block = Window.partitionBy("_k").orderBy("rn")
    at, one = F.when(F.col("hit"), F.col("rn")), F.col("hit").cast("long")
    mine = own == F.col("_b")
    hits = rows.groupBy("_k").agg(F.sum(F.when(mine, one).otherwise(0)).alias("n"))
    rows = rows.withColumns({
        "prev": F.max(at).over(in_block.rowsBetween(-n, 0)), "next": F.min(at).over(in_block.rowsBetween(0, n)), "_own": mine,
        "mno": F.sum(F.when(mine, one).otherwise(0)).over(in_block.rowsBetween(Window.unboundedPreceding, 0)),
    })
    rows = rows.withColumns({"after": F.coalesce(~F.col("hit") & F.col("prev").isNotNull(), F.lit(False)), "before": F.coalesce(~F.col("hit") & F.col("next").isNotNull(), F.lit(False))})
    rows = rows.withColumn("_kept", F.col("hit") | F.col("after") | F.col("before"))
    # the row before this one; the n + 1 lines around a block are enough to know whether it is kept
    rows = rows.withColumns({"_last": F.lag("_kept").over(in_block), "_number": F.lag("number").over(in_block)}).where("_own AND _kept")
    rows = rows.join(sums_before(hits, "n", "file"), "_k").withColumn("mno", F.col("mno") + F.col("_before"))
    earlier = F.col("mno") > one
    return rows.withColumns({
        "gap": F.when(F.coalesce("_last", F.lit(False)), F.col("number") > F.col("_number") + 1).otherwise(earlier),
        "nmno": F.when(F.col("hit"), F.col("mno")).when(F.col("before"), F.col("mno") + 1),
    }).drop("next", "_k", "_b", "_own", "_kept", "_last", "_number", "_before")


def context_of_hits(lines: DataFrame, n: int) -> DataFrame:
    """The same rows (file, path, number, text, hit) where numbers don't skip, for files of any length.

    Only hits are spread to the numbers around them; the lines are joined to these and never sorted, so one
    file of terabytes is no single task."""
    keys = ["file", "path", "number"]
    near = lines.where("hit").select("file", "path", F.explode(F.sequence(F.col("number") - n, F.col("number") + n)).alias("number")).distinct()
    return lines.join(near, keys, "left_semi")


def capped(kept: DataFrame, cap: int) -> DataFrame:
    """What a file stores: its first ``cap`` hits with their context; the last one's ends where hit cap + 1 stands."""
    context = (F.col("after") & (F.col("mno") <= cap)) | (F.col("before") & (F.col("nmno") <= cap))
    return kept.where(F.when(F.col("hit"), F.col("mno") <= cap).otherwise(context))
