"""Counts by file, by section and by glob."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.names import glob_to_regex


def file_counts(lines: DataFrame) -> DataFrame:
    """For each file: lines read (history is not), matched, excluded, highest rank (null: off or none)."""
    read = F.lit(True) if "is_history" not in lines.columns else ~F.coalesce("is_history", F.lit(False))
    return lines.groupBy("file").agg(
        F.count_if(read).alias("lines"), F.count_if("hit").alias("matched"), F.count_if("excluded").alias("excluded"), F.max("rank").alias("rank")
    )


def section_counts(counts: DataFrame) -> DataFrame:
    """One row over all files."""
    return counts.agg(
        F.count("*").alias("files"), F.count_if(F.col("matched") > 0).alias("files_matched"),
        *(F.coalesce(F.sum(x), F.lit(0)).cast("long").alias(x) for x in ("lines", "matched", "excluded")), F.max("rank").alias("rank"),
    )


def globs_of(path: Column, globs: Sequence[str]) -> Column:
    """The globs of the list that a path fits."""
    return F.array_compact(F.array(*(F.when(path.rlike(glob_to_regex(g)), F.lit(g)) for g in globs)))


def glob_tally(counts: DataFrame, path: Column, globs: Sequence[str]) -> DataFrame:
    """For each glob with files: files, those with lines, matches."""
    each = counts.withColumn("glob", F.explode(globs_of(path, globs)))
    return each.groupBy("glob").agg(F.count("*").alias("files"), F.count_if(F.col("lines") > 0).alias("busy"), F.sum("matched").cast("long").alias("matched"))
