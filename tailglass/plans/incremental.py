"""Runs of a watch over files: where each is to be read on, its lines, what is found, and the cursors after delivery.

Files and their rotated copies are on a file system that all executors mount.  Lists of files, copies and stretches
are metadata; lines are read, matched and counted in tasks.  What was read is written once to the shared folder with
the state of every stretch, so lines, matches and cursors are of one reading, whatever executors are lost.

A log whose file is new, cut or gone is a chain: the copy that holds its position, the newer copies, the live file.
A member that is no longer what the plan saw (another inode under its name, nothing under it, or cut while it was read)
ends the chain there: no line of it or behind it is delivered, and the cursor is parked on the last member read, which
the next run finds by its time, inode and bytes under whatever name it then has.  So is the cursor of a log whose live
file is not there.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions.names import base_name, compressed_suffix, directory, is_glob
from ..operators.context import capped, with_context
from ..operators.counts import file_counts
from ..operators.matching import matched, run_until
from ..operators.rules import Watch
from ..sources.facts import RANGE, examined, newlines, reads_to_its_end
from ..sources.listing import copies_of, listed_first, listing, looked_into, union_distinct, without_archives
from ..sources.loglines import STATE, Stretch, read_stretches
from ..sources.shared import stored
from .cursors import committed, expired, judged, merged_moments, new_files, starts
from .rotation import segments

CURSORS = (
    "watch string, file string, offset long, ino decimal(20,0), dev decimal(20,0), fingerprint string, anchor string, last_seen timestamp, line long, "
    "in_line boolean, size long, modified timestamp"
)
MOMENTS = "watch string, glob string, moment timestamp"
PLANNED = ("file", "path", "seg", "start", "number", "in_line", "ino", "dev", "fingerprint", "bytes")
PLAN = "file string, path string, seg int, start long, number long, in_line boolean, ino decimal(20,0), dev decimal(20,0), fingerprint string, bytes long"
LOST = ("rotated", "truncated")


@dataclass
class Run:
    """cursors and moments as they are after the run; failed: item, why; accepted: what ``deliver`` said, or true."""

    cursors: DataFrame
    moments: DataFrame
    failed: DataFrame
    accepted: bool


@dataclass
class Files:
    """files: watch, file, glob (null for one listed by name) and facts of the listing; claims: every glob of each file;
    globs: those looked into without a problem; problems: item, why."""

    files: DataFrame
    claims: DataFrame
    globs: DataFrame
    problems: DataFrame


def globs_among(spark: SparkSession, watch: Watch, patterns: Sequence[str]) -> DataFrame:
    return spark.createDataFrame([(watch.name, g) for g in dict.fromkeys(patterns) if set(g) & set("*?[")], "watch string, glob string")


def expanded(spark: SparkSession, watch: Watch, patterns: Sequence[str], with_archives: bool = False) -> Files:
    """What the patterns of a watch name: rotated copies under a glob are left out, and a name beats a glob."""
    rows = listing(spark, patterns).withColumn("watch", F.lit(watch.name))
    problems = rows.where("problem IS NOT NULL").select(F.col("glob").alias("item"), F.col("problem").alias("why"))
    good = rows.where("problem IS NULL").drop("problem")
    globbed, named = good.where(is_glob(F.col("glob"))), good.where(~is_glob(F.col("glob")))
    globbed = globbed if with_archives else without_archives(globbed, ["glob"])
    claimed = listed_first(named.unionByName(globbed))
    files = union_distinct(claimed, ["glob_ord"]).withColumn("glob", F.when(is_glob(F.col("glob")), F.col("glob"))).withColumnRenamed("path", "file")
    claims = claimed.where(is_glob(F.col("glob"))).select("watch", "glob", F.col("path").alias("file"), "modified")
    globs = globs_among(spark, watch, patterns).join(problems, F.col("glob") == F.col("item"), "left_anti")
    return Files(files.drop("glob_ord"), claims, globs, problems)


def with_sameness(files: DataFrame, cursors: DataFrame) -> DataFrame:
    """``files`` with the saved offset (_offset) and whether a compressed one is what its cursor says, by inode, size and
    time (_same): the cursor stands at its end, so it is left out before anything is opened."""
    saved = cursors.select("file", *(F.col(c).alias(f"_{c}") for c in ("offset", "ino", "dev", "size", "modified")))
    same = F.col("_ino").eqNullSafe(F.col("ino")) & F.col("_dev").eqNullSafe(F.col("dev")) & (F.col("_size") == F.col("length")) & (F.col("_modified") == F.col("modified"))
    packed = compressed_suffix(base_name(F.col("file"))) != ""
    return files.join(saved, "file", "left").withColumn("_same", packed & F.coalesce(same, F.lit(False))).drop("_ino", "_dev", "_size", "_modified")


def live_rows(files: DataFrame, cursors: DataFrame, from_start: Column) -> DataFrame:
    """Each file with its cursor, facts and verdict.  A compressed file that is what its cursor says (inode, size, time)
    is "unchanged" and is not opened; one that can't be read has the verdict "unreadable"."""
    rows = with_sameness(files, cursors).withColumn("whole", F.col("_offset").isNull() & ~F.coalesce(from_start, F.lit(False)))
    opened = rows.where("NOT _same")
    facts = examined(opened.select(F.col("file").alias("path"), F.col("_offset").alias("offset"), "whole")).drop("offset").withColumnRenamed("path", "file")
    rows = rows.select(*files.columns, "_same", from_start.alias("from_start")).join(facts, "file", "left")
    found = starts(judged(rows, cursors), F.col("from_start"))
    verdict = F.when(F.col("_same"), "unchanged").when(F.col("size").isNull(), "unreadable").otherwise(F.col("verdict"))
    return found.withColumn("verdict", verdict)


def chains(spark: SparkSession, rows: DataFrame, cursors: DataFrame, patterns: Sequence[str], folders: Sequence[str]) -> DataFrame:
    """PLAN rows of the logs that were rotated, cut or are gone (of those listed by name)."""
    kept = [c for c in rows.columns if c.startswith("saved_")]
    gone = cursors.join(rows.select("file"), "file", "left_anti").where(F.col("file").isin(*[p for p in patterns if not set(p) & set("*?[")]))
    blank = {c: F.lit(None).cast(rows.schema[c].dataType) for c in ("ino", "dev", "size", "fingerprint")}
    gone = gone.select("watch", "file", F.lit("rotated").alias("verdict"), *(F.col(c.removeprefix("saved_")).alias(c) for c in kept), *(v.alias(k) for k, v in blank.items()))
    lost = stored(rows.where(F.col("verdict").isin(*LOST)).select(gone.columns).unionByName(gone), "lost")  # metadata of few files
    whose = [r.file for r in lost.select("file").collect()]
    if not whose:
        return spark.createDataFrame([], PLAN)
    looked = sorted({f.rpartition("/")[0] for f in whose} | {f.rstrip("/") for f in folders})
    entries = listing(spark, [f"{f}/{x}" for f in looked for x in ("*", ".*")], links=True).where("problem IS NULL").drop("glob", "glob_ord", "problem")
    beside = lost.select("file", "saved_ino", "saved_dev", F.explode(F.array_distinct(F.array(directory(F.col("file")), *map(F.lit, (f.rstrip("/") for f in folders))))).alias("folder"))
    copies = copies_of(entries, beside).join(lost.select("file", "watch", F.col("saved_offset").alias("offset")), "file")
    copies = copies.join(examined(copies.select("path", "offset", F.lit(False).alias("whole")).distinct()).drop("complete", "in_line", "lines"), ["path", "offset"])
    copies = stored(copies, "copies")
    found = segments(lost, copies, reads_to_its_end)
    held = lost.select("file", F.col("ino").alias("_ino"), F.col("dev").alias("_dev"), F.col("fingerprint").alias("_mark"), F.col("size").alias("_size"), "saved_line", "saved_in_line")
    seen = copies.select("file", "path", F.col("ino").alias("c_ino"), F.col("dev").alias("c_dev"))
    rows = found.join(held, "file").join(seen, ["file", "path"], "left")
    live = F.col("path") == F.col("file")
    at = lambda c, other: F.when(F.col("held"), F.col(c)).otherwise(F.lit(other))
    return rows.select(
        "file", "path", "seg", "start", at("saved_line", 0).cast("long").alias("number"), F.coalesce(at("saved_in_line", False), F.lit(False)).alias("in_line"),
        F.when(live, F.col("_ino")).otherwise(F.col("c_ino")).alias("ino"), F.when(live, F.col("_dev")).otherwise(F.col("c_dev")).alias("dev"), F.when(live, F.col("_mark")).alias("fingerprint"),
        F.when(live, F.col("_size")).alias("bytes"),
    )


def planned(rows: DataFrame) -> DataFrame:
    """PLAN rows of the files that go on where they were, or are seen for the first time."""
    first = F.col("verdict") == "first-sight"
    number = F.when(F.col("start") == 0, F.lit(0)).when(first, F.col("lines")).otherwise(F.col("saved_line"))
    inside = F.when(first, (F.col("start") > 0) & F.coalesce("in_line", F.lit(False))).otherwise(F.coalesce("saved_in_line", F.lit(False)))
    plain = rows.where(F.col("verdict").isin("first-sight", "continue"))
    return plain.select("file", F.col("file").alias("path"), F.lit(1).alias("seg"), "start", number.cast("long").alias("number"), inside.alias("in_line"), "ino", "dev", "fingerprint", F.when(compressed_suffix(F.col("file")) == "", F.col("size")).alias("bytes"))


def numbered(plan: DataFrame) -> DataFrame:
    """``number`` where it is not known: the line ends before the start, counted by ranges."""
    missing = plan.where("number IS NULL AND bytes IS NOT NULL")
    counted = newlines(missing.select("path", F.lit(0).cast("long").alias("low"), F.col("start").alias("high"))).select("path", F.col("high").alias("start"), "newlines")
    return plan.join(counted, ["path", "start"], "left").withColumn("number", F.coalesce("number", "newlines", F.lit(0))).drop("newlines")


def in_ranges(plan: DataFrame, size: int) -> DataFrame:
    """A row for each range of ``size`` bytes of the plain files of a plan: part, low, stop (null for the last), lines before low."""
    rows = plan.select("*", F.posexplode(F.expr(f"sequence(start, bytes - 1, {int(size)}L)")).alias("part", "low"))
    rows = rows.withColumn("stop", F.lead("low").over(Window.partitionBy("file", "seg").orderBy("part")))
    counted = newlines(rows.where("stop IS NOT NULL").select("path", "low", F.col("stop").alias("high")), size).select("path", "low", F.col("high").alias("stop"), "newlines")
    rows = rows.join(counted, ["path", "low", "stop"], "left")
    before = F.sum(F.coalesce("newlines", F.lit(0))).over(Window.partitionBy("file", "seg").orderBy("part").rowsBetween(Window.unboundedPreceding, -1))
    return rows.withColumn("number", F.col("number") + F.coalesce(before, F.lit(0)))


def stretches(plan: DataFrame, history: int, size: int = RANGE) -> list[dict]:
    """The tasks' stretches, a row for each file, copy and range, as the data source takes them."""
    large = (F.col("bytes") - F.col("start") > 2 * size) & F.col("bytes").isNotNull()
    rows = plan.where(~large).collect()
    if len(rows) < plan.count():
        rows += in_ranges(plan.where(large), size).collect()
    whole = lambda x: None if x is None else int(x)
    out = []
    for r in rows:
        part, low, stop = (r.part, r.low, r.stop) if "part" in r else (0, r.start, None)
        out.append(Stretch(r.file, r.path, r.seg, low, int(r.number), history if part == 0 and r.start else 0, part == 0 and r.in_line, stop, part > 0, whole(r.ino), whole(r.dev), r.fingerprint))
    return [x.as_json() for x in sorted(out, key=lambda x: (x.file, x.seg, x.start))]


def states(read: DataFrame) -> DataFrame:
    """The state of each stretch: file, path, seg, at (the place reached), number and the fields of STATE."""
    rows = read.where("state IS NOT NULL").withColumn("s", F.from_json("state", STATE))
    return rows.select("file", "path", "seg", F.col("end_offset").alias("at"), "number", "s.*").where("file <> ''")


def ended(read: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """The lines that count; the cursor that each file has reached (offset null: none, the saved one stays); failed items.

    A file fails as a whole if the file itself can't be read, or is a compressed one that ends early."""
    state = states(read)
    live = F.col("path") == F.col("file")
    hurt = F.col("why").isin("denied", "damaged")
    wrong = state.where(hurt & live).select("file").distinct()
    failed = state.where((F.col("why") == "denied") | (hurt & live)).select(F.col("path").alias("item"), F.col("why"))
    stopped = F.col("why").isin("gone", "renamed", "truncated")
    stop = F.min(F.when(stopped, F.struct("seg", F.when(F.col("why") == "truncated", F.col("at")).otherwise(F.lit(-1)).cast("long").alias("at"))))
    stops = state.where(stopped).groupBy("file").agg(stop.alias("stop"))
    lines = read.where("state IS NULL").drop("state").join(stops, "file", "left").join(wrong, "file", "left_anti")
    lines = lines.where(F.col("stop").isNull() | (F.struct("seg", F.col("end_offset").alias("at")) <= F.col("stop")))
    came = lines.where(~F.col("is_history") & (F.col("seg") == F.col("stop.seg"))).select("file").distinct().withColumn("came", F.lit(True))
    lines = lines.drop("stop")
    # sorted once, by (file, seg), for the stop, the members and the files
    chain = Window.partitionBy("file").orderBy("seg").rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    every = state.withColumn("stop", stop.over(chain))
    usable = (F.col("stop").isNull() | (F.struct("seg", F.col("at")) <= F.col("stop"))) & ~F.col("why").isin("none", "gone", "renamed", "denied")
    whole = F.struct("seg", "path", "at", "number", "in_line", "ino", "dev", "size", "modified", "fingerprint", "anchor", "why")
    each = every.groupBy("file", "seg").agg(F.max_by(whole, F.when(usable, F.struct("at", "part"))).alias("end"), F.max("stop.seg").alias("stop_seg"), F.max(hurt & live).alias("wrong"))
    # the live file's own place counts unless it was cut before a line of it was read
    good = (F.col("end.path") == F.col("file")) & (~F.col("seg").eqNullSafe(F.col("stop_seg")) | F.coalesce("came", F.lit(False)))
    good |= (F.col("end.path") != F.col("file")) & F.col("end.fingerprint").isNotNull()
    last = each.join(came, "file", "left").groupBy("file").agg(F.max_by("end", F.when(good, F.col("seg"))).alias("end"), F.max("wrong").alias("wrong"))
    parked = F.col("end.path") != F.col("file")
    settled = (compressed_suffix(base_name(F.col("file"))) != "") & (F.col("end.why") == "ok")
    stamp = lambda c: F.when(parked | settled, c)
    reached = last.select(
        "file", F.col("end.at").alias("offset"), *(F.col(f"end.{c}").alias(c) for c in ("ino", "dev", "fingerprint", "anchor", "in_line")), F.col("end.number").alias("line"),
        stamp(F.col("end.size")).alias("size"), stamp(F.timestamp_micros(F.col("end.modified"))).alias("modified"), (F.coalesce("wrong", F.lit(False)) | F.col("end.at").isNull()).alias("failed"),
    )
    return lines, reached, failed


def watched(
    spark: SparkSession, watch: Watch, patterns: Sequence[str], cursors: DataFrame, deliver: Callable[[DataFrame, DataFrame], bool], now: Column, from_start: Column | None = None,
    moments: DataFrame | None = None, folders: Sequence[str] = (), with_archives: bool = False, ttl_days: float = 30, scan_seconds: float = 300, range_bytes: int = RANGE,
) -> Run:
    """Read, match and deliver what files and globs have new, and return what to remember.

    ``deliver`` gets the stored rows and the counts by file, if any line is a hit, and says whether they are accepted:
    if not, files with hits keep their cursors and come again.  ``moments``: the last run of each glob; a file under a
    glob that changed since then and has no cursor is read from its start.  ``folders``: where copies may be besides
    the log's own folder.  A file that can't be read is a failed item and the others go on; an absent one keeps its cursor."""
    moments = spark.createDataFrame([], MOMENTS) if moments is None else moments
    from_start = F.lit(False) if from_start is None else F.coalesce(from_start, F.lit(False))
    every = expanded(spark, watch, patterns, with_archives)
    own = cursors.where(F.col("watch") == watch.name)
    fresh = new_files(every.claims, moments).select("file").distinct().join(own, "file", "left_anti").withColumn("_new", F.lit(True))
    files = every.files.join(fresh, "file", "left").withColumn("_new", F.coalesce("_new", F.lit(False)))
    rows = stored(live_rows(files, own, from_start | F.col("_new")), "rows")  # a row for each file
    plan = numbered(planned(rows).unionByName(chains(spark, rows, own, patterns, folders)))
    plan = spark.createDataFrame(plan.select(*PLANNED).collect(), PLAN)  # a row for each file and copy
    read = stored(read_stretches(spark, stretches(plan, watch.context, range_bytes)), "read")
    lines, reached, failed = ended(read)
    found = matched(lines, watch, scan_seconds, run_until(scan_seconds)).persist()
    try:
        counts = file_counts(found)
        accepted = found.where("hit").isEmpty() or bool(deliver(capped(with_context(found, watch.context), watch.max_lines), counts))
        begun = plan.where("seg = 1").select("file", F.col("start").alias("start_offset"), F.col("in_line").alias("start_in_line"), F.col("number").alias("start_line"))
        reads = reached.join(begun, "file", "left").join(counts.select("file", "matched"), "file", "left")
        same = rows.where("verdict = 'unchanged'").select("file", *(F.col(f"saved_{c}").alias(c) for c in ("offset", "ino", "dev", "fingerprint", "anchor", "in_line", "line", "size", "modified")))
        reads = reads.unionByName(same.withColumns({"failed": F.lit(False), "start_offset": F.col("offset")}), allowMissingColumns=True)
        identity = rows.select("file", *(F.col(c).alias(f"_{c}") for c in ("ino", "dev", "fingerprint")))
        reads = reads.join(identity, "file", "left").withColumns({c: F.coalesce(c, f"_{c}") for c in ("ino", "dev", "fingerprint")})
        reads = reads.withColumns({"watch": F.lit(watch.name), "last_seen": now.cast("timestamp"), "matched": F.coalesce("matched", F.lit(0))})
        told = spark.createDataFrame([(watch.name, accepted)], "watch string, accepted boolean")
        after = expired(committed(cursors, reads, told, now, ttl_days), now, ttl_days)
        denied = rows.where("verdict = 'unreadable'")
        unopened = denied.join(own, "file", "left_anti").join(every.claims.select("file", F.col("glob").alias("_g")), "file").join(moments.select("watch", F.col("glob").alias("_g")), ["watch", "_g"], "left_semi")
        seen = looked_into(every.globs, unopened.select("watch", F.col("_g").alias("glob"))).withColumn("moment", now.cast("timestamp"))
        # a glob of the watch that could not be looked into keeps its moment
        later = merged_moments(moments, seen, globs_among(spark, watch, patterns).union(moments.where(F.col("watch") != watch.name).select("watch", "glob")))
        failed = every.problems.unionByName(denied.select(F.col("file").alias("item"), F.lit("cannot be read").alias("why"))).unionByName(failed)
        fixed = [spark.createDataFrame(x.collect(), x.schema) for x in (after, later if accepted else moments, failed)]  # a row for each file and glob; what was cached goes
        return Run(*fixed, accepted)
    finally:
        found.unpersist()


def run(spark: SparkSession, watch: Watch, files: Sequence[str], cursors: DataFrame, deliver: Callable[[DataFrame, DataFrame], bool], now: Column, from_start: Column | None = None) -> DataFrame:
    """``watched`` for its new cursors alone."""
    return watched(spark, watch, files, cursors, deliver, now, from_start).cursors
