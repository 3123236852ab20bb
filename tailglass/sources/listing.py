"""Files that globs name, as a table; what is a rotated copy stays out unless it is asked for.

A glob is expanded a component at a time, so only folders that its beginning names are looked into.  Names are
metadata and are gathered on the driver; everything after that is joins and windows.
"""

from __future__ import annotations

import datetime
import decimal
import os
import re
import stat
from collections.abc import Iterator, Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions.names import COMPRESSED, archive_suffix, base_name, classify, component_to_regex, directory, is_glob, kin_bases
from .loglines import micros

FILES = "glob_ord int, glob string, path string, length long, modified timestamp, ino decimal(20,0), dev decimal(20,0), problem string"


def _entries(spark: SparkSession, folder: str) -> Iterator[tuple[str, str, tuple]]:
    """(name, kind, facts) of a folder's entries; kind is dir, file or other (links, devices and so on)."""
    if "://" not in folder:
        with os.scandir(folder or "/") as found:
            for entry in found:
                facts = entry.stat(follow_symlinks=False)
                kind = "dir" if stat.S_ISDIR(facts.st_mode) else "file" if stat.S_ISREG(facts.st_mode) else "other"
                yield entry.name, kind, (facts.st_size, micros(facts), facts.st_ino, facts.st_dev)
    else:  # any store that Spark reads; there are no inodes
        path = spark._jvm.org.apache.hadoop.fs.Path(folder)
        for x in path.getFileSystem(spark._jsc.hadoopConfiguration()).listStatus(path):
            yield x.getPath().getName(), "dir" if x.isDirectory() else "other" if x.isSymlink() else "file", (x.getLen(), x.getModificationTime() * 1000, None, None)


def _expand(spark: SparkSession, pattern: str) -> Iterator[tuple]:
    """(path, facts, problem) of what a pattern names."""
    scheme, sep, rest = pattern.partition("://")
    root, parts = (f"{scheme}{sep}{rest.partition('/')[0]}", rest.partition("/")[2]) if sep else ("", pattern.removeprefix("/"))
    folders, parts = [root], parts.split("/")
    for depth, part in enumerate(parts):
        # \x{...} is how Java's engine writes a code point
        fits = re.compile(re.sub(r"\\x\{([0-9a-f]+)\}", lambda m: re.escape(chr(int(m[1], 16))), component_to_regex(part))).fullmatch
        wild, last, below = bool(set(part) & set("*?[")), depth == len(parts) - 1, []
        for folder in folders:
            if not wild and not last:
                below.append(f"{folder}/{part}")
                continue
            try:
                for name, kind, facts in _entries(spark, folder):
                    if fits(name) if wild else name == part:
                        if last and kind == "file":
                            yield f"{folder}/{name}", facts, None
                        elif not last and kind == "dir":
                            below.append(f"{folder}/{name}")
            except (FileNotFoundError, NotADirectoryError):
                continue
            except Exception as e:
                if "FileNotFoundException" in str(e):
                    continue
                if not isinstance(e, OSError) and "AccessControlException" not in str(e):
                    raise
                yield folder, (None,) * 4, f"cannot be listed: {type(e).__name__}"
        folders = below


EPOCH = datetime.datetime(1970, 1, 1, tzinfo=datetime.timezone.utc)


def listing(spark: SparkSession, patterns: Sequence[str], links: bool = False) -> DataFrame:
    """The regular files that each pattern names (a path names itself), in no order: glob_ord, glob, path and facts.

    Hidden names need a dot in their component; links are passed over; a folder that is not there has no files, and one
    that can't be read is a row with a ``problem``.  Of hard links under one glob the first path stands for all, unless
    ``links`` asks for each."""
    rows = []
    for i, pattern in enumerate(patterns):
        for path, (size, modified, ino, dev), problem in _expand(spark, pattern):
            moment = None if modified is None else EPOCH + datetime.timedelta(microseconds=modified)
            rows.append((i, pattern, path, size, moment, *(None if x is None else decimal.Decimal(x) for x in (ino, dev)), problem))
    found = spark.createDataFrame(rows, FILES)
    return found if links else without_hard_links(found, ["glob_ord"])


def in_order(files: DataFrame) -> DataFrame:
    """A listing in the order of its globs, then of paths by code point."""
    return files.orderBy("glob_ord", "path")


def without_hard_links(files: DataFrame, within: Sequence[str], order: Sequence = ("path",)) -> DataFrame:
    """One row for each (dev, ino) within the given columns, the first in ``order``; where they are unknown, every row."""
    alone = F.when(F.col("ino").isNull() | F.col("dev").isNull(), F.struct(*(F.col(c) for c in ("path",))))
    best = Window.partitionBy(*within, "dev", "ino", alone).orderBy(*order)
    return files.withColumn("_n", F.row_number().over(best)).where("_n = 1").drop("_n")


def without_archives(files: DataFrame, within: Sequence[str] = ()) -> DataFrame:
    """``files`` (with path) but copies by shape, and copies of another name in the same folder (kin) of the same ``within``."""
    within = list(within)
    files = files.withColumns({"_dir": directory(F.col("path")), "_name": base_name(F.col("path"))}).where(archive_suffix(F.col("_name")).isNull())
    names = files.select(*within, F.col("_dir"), F.col("_name").alias("base")).distinct()
    kin = files.select(*within, "_dir", "_name", F.explode(kin_bases(F.col("_name"))).alias("base")).where(F.col("base") != F.col("_name"))
    kin = kin.where(classify(F.col("_name"), F.col("base"))["style"].isin("numeric", "dated")).join(names, [*within, "_dir", "base"], "left_semi")
    return files.join(kin.select(*within, "_dir", "_name").distinct(), [*within, "_dir", "_name"], "left_anti").select(*(c for c in files.columns if c not in ("_dir", "_name")))


def union_distinct(files: DataFrame, order: Sequence[str]) -> DataFrame:
    """One row a path, its first in ``order``."""
    first = Window.partitionBy("path").orderBy(*order)
    return files.withColumn("_n", F.row_number().over(first)).where("_n = 1").drop("_n")


def listed_first(files: DataFrame) -> DataFrame:
    """``files`` (path, glob) without a glob's claim on a path that is also listed by name."""
    listed = files.where(~is_glob(F.col("glob"))).select("path").distinct()
    return files.where(~is_glob(F.col("glob"))).unionByName(files.where(is_glob(F.col("glob"))).join(listed, "path", "left_anti"))


def candidate_bases(name: Column) -> Column:
    """The logs whose copy a name may be: what is left without compression, and its possible bases."""
    plain = F.regexp_replace(name, COMPRESSED, "")
    return F.array_distinct(F.concat(F.array(plain), kin_bases(plain)))


def copies_of(entries: DataFrame, logs: DataFrame) -> DataFrame:
    """The rotated copies of each log among ``entries`` (path and facts): file, path, style, key, suffix, compressed, ext_form.

    logs: file, folder (a row for each folder to look into), saved_ino and saved_dev.  Names meet by their possible bases,
    so a folder of many logs and copies is no product.  A file of another name that has the saved inode is of style
    "unnamed".  Of hard links to one file the one whose name says most stays: recognised, then other, then unnamed."""
    entries = entries.withColumns({"_dir": directory(F.col("path")), "_name": base_name(F.col("path"))})
    logs = logs.withColumn("_base", base_name(F.col("file")))
    facts = ["path", "modified", "ino", "dev", "_dir"]
    named = entries.select(*facts, "_name", F.explode(candidate_bases(F.col("_name"))).alias("_base"))
    named = named.join(logs.select("file", F.col("folder").alias("_dir"), "_base"), ["_dir", "_base"])
    named = named.withColumn("_c", classify(F.col("_name"), F.col("_base"))).where("_c IS NOT NULL").select("file", *facts, "_c.*")
    own = logs.select("file", F.col("folder").alias("_dir"), F.col("saved_ino").alias("ino"), F.col("saved_dev").alias("dev"))
    others = entries.join(own, ["_dir", "ino", "dev"]).where(F.col("path") != F.col("file")).select("file", *facts)
    others = others.join(named.select("file", "path"), ["file", "path"], "left_anti")
    blank = {"style": F.lit("unnamed"), "key": F.array().cast("array<bigint>"), "suffix": F.lit(""), "compressed": base_name(F.col("path")).rlike(COMPRESSED), "ext_form": F.lit(False)}
    every = named.unionByName(others.select("*", *(v.alias(k) for k, v in blank.items())))
    return without_twins(best_links(every, ["file"]), ["file", "_dir"]).drop("_dir")


def best_links(files: DataFrame, within: Sequence[str]) -> DataFrame:
    """Of hard links to one file the one of the most telling style, then the first path."""
    rank = F.when(F.col("style") == "unnamed", 2).when(F.col("style") == "other", 1).otherwise(0)
    return without_hard_links(files, within, (rank, "path"))


def rotated_copies_listed(files: DataFrame) -> DataFrame:
    """Pairs (path, log) of files listed by name of which one is named as a rotated copy of the other: it will be read twice."""
    rows = files.select("path", directory(F.col("path")).alias("_dir"), base_name(F.col("path")).alias("_name")).distinct()
    pairs = rows.select("path", "_dir", "_name", F.explode(candidate_bases(F.col("_name"))).alias("_base"))
    pairs = pairs.join(rows.select(F.col("path").alias("log"), "_dir", F.col("_name").alias("_base")), ["_dir", "_base"])
    return pairs.where((F.col("path") != F.col("log")) & classify(F.col("_name"), F.col("_base"))["style"].isin("numeric", "dated")).select("path", "log")


def looked_into(globs: DataFrame, unopened: DataFrame) -> DataFrame:
    """The globs (watch, glob) of a run but those with a new file (watch, glob, file) that could not be opened: it stays new."""
    return globs.join(unopened.select("watch", "glob").distinct(), ["watch", "glob"], "left_anti")


def without_twins(copies: DataFrame, within: Sequence[str]) -> DataFrame:
    """``copies`` without compressed forms of a copy whose one plain form is still there: compression is under way."""
    same = Window.partitionBy(*within, "suffix", "ext_form")
    plain = F.count_if(~F.col("compressed")).over(same)
    return copies.withColumn("_p", plain).where(~F.col("compressed") | (F.col("_p") != 1)).drop("_p")


def oldest_first(copies: DataFrame, partition: Sequence[str], modified: str = "modified") -> DataFrame:
    """Ordinal ``age`` from 1, oldest first: by key where a log's copies have one recognised style, by time otherwise."""
    own = Window.partitionBy(*partition)
    one = (F.min("style").over(own) == F.max("style").over(own)) & (F.max("style").over(own) != "other")
    by = own.orderBy(F.when(F.col("_one"), F.col("key")), F.when(~F.col("_one"), F.col(modified)), F.when(~F.col("_one"), F.struct("style", "key")), "path")
    return copies.withColumn("_one", one).withColumn("age", F.row_number().over(by).cast("long")).drop("_one")
