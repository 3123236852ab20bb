"""Cursors: where each watch has read each file to, as a table.

Columns of a cursor: watch, file, offset, ino, dev, fingerprint (of the first line), anchor (of what stands
before the offset), last_seen; and where runs need it line (complete lines before the offset), in_line (the offset is
inside a line), size and modified (of a copy that the cursor is parked on, or of a compressed file read to its end).
A null is "unknown" and never compared.  A listing has file, ino, dev, size (null where compressed), fingerprint,
anchor (now, at the saved offset), modified.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def kinds_of(cursors: DataFrame) -> list[str]:
    return [c for c in cursors.columns if c not in ("watch", "file")]


def verdict() -> Column:
    """first-sight, rotated, truncated or continue; the first rule that holds.  Saved columns have the prefix saved_."""
    differ = lambda name: F.col(f"saved_{name}").isNotNull() & F.col(name).isNotNull() & (F.col(f"saved_{name}") != F.col(name))
    return (
        F.when(F.col("saved_offset").isNull(), "first-sight")
        .when(F.col("saved_ino") != F.col("ino"), "rotated")
        .when(differ("fingerprint"), "rotated")
        .when(F.col("saved_fingerprint").isNotNull() & F.col("fingerprint").isNull(), "truncated")
        .when(F.col("size").isNotNull() & (F.col("size") < F.col("saved_offset")), "truncated")
        .when(differ("anchor"), "truncated")
        .otherwise("continue")
    )


def judged(files: DataFrame, cursors: DataFrame) -> DataFrame:
    """Each listed (watch, file) with its saved cursor, the verdict and whether it moved to another device."""
    saved = cursors.select("watch", "file", *(F.col(c).alias(f"saved_{c}") for c in kinds_of(cursors)))
    rows = files.join(saved, ["watch", "file"], "left").withColumn("verdict", verdict())
    return rows.withColumn("moved", F.coalesce(F.col("verdict").eqNullSafe("continue") & (F.col("saved_dev") != F.col("dev")), F.lit(False)))


def starts(rows: DataFrame, from_start: Column | None = None) -> DataFrame:
    """``start``: the saved offset, 0, or for a first sight the end of the last complete line (0 where ``from_start``)."""
    from_start = F.lit(False) if from_start is None else F.coalesce(from_start, F.lit(False))
    first = F.when(from_start, F.lit(0)).otherwise(F.col("complete"))
    return rows.withColumn("start", F.when(F.col("verdict") == "first-sight", first).when(F.col("verdict") == "continue", F.col("saved_offset")).otherwise(F.lit(0)).cast("long"))


def new_files(files: DataFrame, moments: DataFrame) -> DataFrame:
    """Files under a glob that was looked into before and that changed since: they are read from their start.

    files: watch, file, glob, modified; moments: watch, glob, moment (the start of the glob's last run)."""
    seen = moments.select(F.col("watch").alias("w"), F.col("glob").alias("g"), "moment")
    return files.join(seen, (F.col("watch") == F.col("w")) & (F.col("glob") == F.col("g")) & (F.col("modified") >= F.col("moment")), "left_semi")


def expired(cursors: DataFrame, now: Column, ttl_days: float) -> DataFrame:
    """The cursors that stay: seen within ``ttl_days`` (to the second)."""
    age = F.unix_seconds(now.cast("timestamp")) - F.unix_seconds(F.col("last_seen").cast("timestamp"))
    return cursors.where(~(age > ttl_days * 86400) | F.col("last_seen").isNull())


def merged_moments(old: DataFrame, seen: DataFrame, configured: DataFrame) -> DataFrame:
    """Records of runs by (watch, glob): those looked into get the new moment, others of the configuration keep theirs."""
    both = old.withColumnRenamed("moment", "old").join(seen.withColumnRenamed("moment", "new"), ["watch", "glob"], "full")
    return both.join(configured, ["watch", "glob"], "left_semi").select("watch", "glob", F.coalesce("new", "old").alias("moment"))


def newest(moments: DataFrame) -> DataFrame:
    """The latest run of each watch, over its globs."""
    return moments.groupBy("watch").agg(F.max("moment").alias("newest"))


def committed(cursors: DataFrame, reads: DataFrame, delivered: DataFrame, now: Column, ttl_days: float = 30) -> DataFrame:
    """The cursors after a run.

    reads: watch, file, matched, failed, start_offset and the columns of the cursor reached; delivered: watch,
    accepted (a watch without matches needs no delivery).  A file advances unless its own read failed or it has
    matches that were not accepted; then an old cursor stays (its sighting is renewed past half the time to
    live), and a file without one is pinned where this read began: at start_offset, with start_line and
    start_in_line if they are there and no anchor, as that is of the place reached.  Cursors of files not read stay."""
    kinds = kinds_of(cursors)
    begun = [c for c in ("start_offset", "start_line", "start_in_line") if c in reads.columns]
    new = reads.select("watch", "file", "matched", "failed", *begun, *(F.col(c).alias(f"new_{c}") for c in kinds))
    rows = cursors.withColumn("had", F.lit(True)).join(new.join(delivered, "watch", "left"), ["watch", "file"], "full")
    read = F.col("failed").isNotNull()
    advance = read & ~F.col("failed") & ((F.col("matched") == 0) | F.coalesce("accepted", F.lit(False)))
    age = F.unix_seconds(now.cast("timestamp")) - F.unix_seconds(F.col("last_seen").cast("timestamp"))
    touch = read & F.coalesce(F.col("had"), F.lit(False)) & (age > ttl_days * 86400 / 2)
    out = {}
    for c in kinds:
        kept = F.when(touch, now.cast(cursors.schema[c].dataType)).otherwise(F.col(c)) if c == "last_seen" else F.col(c)
        pinned = F.col(f"start_{c}") if f"start_{c}" in begun else F.lit(None) if c in ("anchor", "size", "modified") else F.col(f"new_{c}")
        out[c] = F.when(advance, F.col(f"new_{c}")).when(F.col("had"), kept).otherwise(pinned)
    return rows.select("watch", "file", *(v.cast(cursors.schema[c].dataType).alias(c) for c, v in out.items()))
