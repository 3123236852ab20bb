"""What a rotated log had left to read: the copy that holds the saved position, and the newer copies after it.

``lost`` are rows of ``judged`` that were rotated, truncated or gone; ``copies`` are rotated copies by watch and
file: path, style, key, ino, dev, size (of the text as far as it is known), fingerprint, anchor (at the saved
offset), modified, ext_form.  Style "unnamed" is a file of another name that has the saved inode.  Both are joined by
(watch, file), so each log's search is one small group.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

#: Clocks of two files may differ by so many seconds.
SLACK = 2


def seconds(c: Column | str) -> Column:
    return F.unix_seconds((F.col(c) if isinstance(c, str) else c).cast("timestamp"))


def one_style(style: Column | str, within) -> Column:
    """Whether the rows of a window have one recognised style, so that keys order them; nulls are no rows."""
    return F.coalesce((F.min(style).over(within) == F.max(style).over(within)) & F.max(style).over(within).isin("numeric", "dated"), F.lit(False))


def holders(lost: DataFrame, copies: DataFrame, whole: Callable[[DataFrame], DataFrame] | None = None) -> DataFrame:
    """For each lost (watch, file) the copy that holds its position, by the first stage that finds one.

    0 a cursor parked on a copy (``saved_modified`` is there and not null): a copy of that second that reaches the offset,
    the same inode first, then the exact time, then named styles; without a saved first line only that inode. 1 content,
    written since the last run, oldest first; 2 the same inode, unless truncated; 3 content, older, newest first.
    Content fits if first lines are the same, the copy reaches the offset, and what stands before it is the same as
    far as both are known.

    Age is the style's key where all copies of a stage have one recognised style, else the time and then the key.  Copies
    of one generation (same style, form and age by that style) that fit tie: ``whole`` (rows with path to path, whole)
    says which can be read to their ends, and the first of these is taken.  ``measured`` is the earliest time among
    them: what is newer than that is newer than the generation."""
    c = copies.select("watch", "file", *(F.col(x).alias(f"c_{x}") for x in copies.columns if x not in ("watch", "file")))
    pairs = lost.join(c, ["watch", "file"]).where((F.col("c_ino") != F.col("ino")) | (F.col("c_dev") != F.col("dev")) | F.col("ino").isNull())
    named = F.col("c_style") != "unnamed"
    same = F.coalesce(F.col("saved_anchor") == F.col("c_anchor"), F.lit(True))
    fits = F.coalesce((F.col("saved_fingerprint") == F.col("c_fingerprint")) & (F.col("c_size") >= F.col("saved_offset")) & same, F.lit(False))
    recent = seconds("c_modified") >= seconds("saved_last_seen") - SLACK
    contradicts = F.coalesce(F.col("saved_fingerprint") != F.col("c_fingerprint"), F.lit(False))
    own = F.coalesce((F.col("c_ino") == F.col("saved_ino")) & (F.col("c_dev") == F.col("saved_dev")), F.lit(False))
    inode = own & (F.col("verdict") != "truncated") & ~contradicts & same & (named | F.col("saved_fingerprint").isNotNull())
    parked, parked_order = F.lit(False), []
    if "saved_modified" in lost.columns:
        reaches = F.coalesce(F.col("c_size") >= F.col("saved_offset"), F.lit(True)) & same & ~contradicts
        parked = named & F.coalesce((seconds("saved_modified") == seconds("c_modified")) & reaches & (own | F.col("saved_fingerprint").isNotNull()), F.lit(False))
        at_0 = lambda c: F.when(F.col("stage") == 0, c)
        parked_order = [at_0(~own), at_0(F.col("saved_modified") != F.col("c_modified")), at_0(F.col("c_style") == "other")]
    # the join has sorted by (watch, file): what holds for a whole search comes in that order, and only its first stage is sorted again
    group = Window.partitionBy("watch", "file")
    stage = F.when(parked, 0).when(named & fits & recent, 1).when(inode, 2).when(named & fits, 3)
    pairs = pairs.withColumns({"_recent": recent & named, "stage": stage})
    ages = [named & F.col("_recent").eqNullSafe(F.lit(x)) for x in (True, False, None)]
    one = F.coalesce(*(F.when(a, one_style(F.when(a, F.col("c_style")), group)) for a in ages), F.lit(False))
    pairs = pairs.withColumns({"_one": one, "_stage": F.min("stage").over(group)}).where("stage = _stage")
    age = F.unix_micros(F.col("c_modified").cast("timestamp"))
    up, down = F.col("stage") != 3, F.col("stage") == 3
    by_age = [
        F.when(F.col("_one") & up, F.col("c_key")).asc(), F.when(F.col("_one") & down, F.col("c_key")).desc(), F.when(F.col("_one"), ~own),
        F.when(~F.col("_one") & up, age).asc(), F.when(~F.col("_one") & down, age).desc(),
        F.when(~F.col("_one") & up, F.struct("c_style", "c_key")).asc(), F.when(~F.col("_one") & down, F.struct("c_style", "c_key")).desc(),
    ]
    best = Window.partitionBy("watch", "file").orderBy("stage", *parked_order, *by_age, "c_path")
    alike = F.struct("stage", "c_style", "c_ext_form", F.when(F.col("c_style") == "other", F.array(age)).otherwise(F.col("c_key")).alias("age"))
    pairs = pairs.withColumn("_alike", alike).withColumns({"_n": F.row_number().over(best), "_first": F.first("_alike").over(best)})
    pairs = pairs.where("_n = 1 OR (stage IN (1, 3) AND _alike = _first)").withColumn("measured", F.min("c_modified").over(group))
    if whole is not None:
        pairs = pairs.withColumn("_many", F.count("*").over(group))
        read = whole(pairs.where("_many > 1").select(F.col("c_path").alias("path"))).select(F.col("path").alias("c_path"), (~F.col("whole")).alias("_not_whole"))
        pairs = pairs.join(read, "c_path", "left").withColumn("_cut", F.coalesce("_not_whole", F.lit(False)))
        pairs = pairs.withColumn("_n", F.row_number().over(group.orderBy("_cut", "_n"))).drop("_not_whole", "_many", "_cut")
    return pairs.where("_n = 1").drop("_n", "_alike", "_first", "_one", "_recent", "_stage")


def written_since(copies: DataFrame) -> DataFrame:
    """Of copies that may be read where none holds the position, those of one naming form.

    The classic form if there is any of it, else compressed copies of the other form and a plain one newer than
    all of them: a plain file of that form may be another log."""
    own, style = Window.partitionBy("watch", "file"), Window.partitionBy("watch", "file", "style")
    packed = F.col("compressed")
    other = F.when(F.col("style") == "dated", F.max(F.when(packed & (F.col("style") == "numeric"), F.col("modified"))).over(own)).otherwise(F.max(F.when(packed & (F.col("style") == "dated"), F.col("modified"))).over(own))
    by_key = F.max(F.when(packed, F.col("key"))).over(style)
    newest = F.coalesce(F.col("key") > by_key, F.lit(True)) & F.coalesce(F.col("modified") > other, F.lit(True))
    rows = copies.withColumns({"_classic": F.max(~F.col("ext_form")).over(own), "_packed": F.max(packed).over(own), "_newest": newest})
    return rows.where(F.when(F.col("_classic"), ~F.col("ext_form")).otherwise(packed | (F.col("_packed") & F.col("_newest")))).drop("_classic", "_packed", "_newest")


def segments(lost: DataFrame, copies: DataFrame, whole: Callable[[DataFrame], DataFrame] | None = None) -> DataFrame:
    """What to read for each lost log, in order: the holder from the saved offset, newer copies, the live file.

    Newer copies have the holder's form (an unnamed holder counts as classic), and its recognised style with a larger
    key, or any later time where styles differ.  Where no copy holds the position, those written since the last run, or
    not before the copy that the cursor was parked on, are read whole.  ``held``: the row is the holder."""
    held = holders(lost, copies, whole).select(
        "watch", "file", F.col("c_path").alias("h_path"), F.col("c_style").alias("h_style"), F.col("c_key").alias("h_key"), F.col("measured").alias("h_modified"), F.col("c_ext_form").alias("h_form"), F.col("saved_offset").alias("h_offset")
    )
    parked_on = F.col("saved_modified") if "saved_modified" in lost.columns else F.lit(None).cast("timestamp")
    one = lost.select("watch", "file", "saved_last_seen", parked_on.alias("_parked"), F.col("ino").isNotNull().alias("live"))
    every = copies.join(one, ["watch", "file"]).join(held, ["watch", "file"], "left")
    same_style = (F.col("style") == F.col("h_style")) & F.col("style").isin("numeric", "dated")
    newer = F.when(same_style, F.col("key") > F.col("h_key")).otherwise(F.col("modified") > F.col("h_modified"))
    in_chain = newer & (F.col("ext_form") == F.col("h_form")) & (F.col("style").isin("numeric", "dated") | ((F.col("style") == "other") & (F.col("h_style") == "other")))
    recent = F.when(F.col("_parked").isNotNull(), F.col("modified").cast("timestamp") >= F.col("_parked").cast("timestamp")).otherwise(seconds("modified") >= seconds("saved_last_seen") - SLACK)
    loose = every.where(F.col("h_path").isNull() & recent & F.col("style").isin("numeric", "dated"))
    loose = written_since(loose if "compressed" in loose.columns else loose.withColumn("compressed", F.lit(False)))
    chain = every.where((F.col("path") == F.col("h_path")) | F.coalesce(in_chain & F.col("h_path").isNotNull(), F.lit(False)))
    kinds = ["watch", "file", "path", "style", "key", "modified"]
    old = chain.select(*kinds, (F.col("path") == F.col("h_path")).alias("held"), "h_offset").unionByName(loose.select(*kinds, F.lit(False).alias("held"), "h_offset"))
    old = old.select(*kinds, "held", F.when(F.col("held"), F.col("h_offset")).otherwise(F.lit(0)).cast("long").alias("start"), F.when(F.col("held"), 0).otherwise(1).alias("part"))
    live = one.where("live").select("watch", "file", F.col("file").cast("string").alias("path"), F.lit(None).cast("string").alias("style"), F.lit(None).cast("array<bigint>").alias("key"), F.lit(None).cast(copies.schema["modified"].dataType).alias("modified"), F.lit(False).alias("held"), F.lit(0).cast("long").alias("start"), F.lit(2).alias("part"))
    rows = old.unionByName(live).withColumn("_one", one_style("style", Window.partitionBy("watch", "file", "part")))
    by_age = [F.when(F.col("_one"), F.col("key")), F.when(~F.col("_one"), F.col("modified")), F.when(~F.col("_one"), F.struct("style", "key"))]
    by = Window.partitionBy("watch", "file").orderBy("part", *by_age, "path")
    return rows.withColumn("seg", F.row_number().over(by).cast("int")).select("watch", "file", "path", "seg", "start", "held")
