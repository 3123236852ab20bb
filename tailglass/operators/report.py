"""From stored matches to the lines of a report: a budget of matches across files, headers, gaps, a budget of bytes."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions.text import clean_text
from .rules import Watch


def within_budget(kept: DataFrame, max_lines: int, n: int) -> DataFrame:
    """The section's first ``max_lines`` hits in file order with their context, and the last one's own lines after it.

    ``file_ord`` orders the files.  The place of the last hit comes from a top-k, so no task sorts all files."""
    place = F.struct("file_ord", "seg", "number")
    hits = kept.where("hit").orderBy("file_ord", "seg", "number").limit(max_lines)
    last = hits.agg(F.max(F.struct("file_ord", "seg", "number", "path", "rn")).alias("last"))  # one row
    rows = kept.join(F.broadcast(last))
    end = F.struct("last.file_ord", "last.seg", "last.number")
    own = (F.col("file_ord") == F.col("last.file_ord")) & (F.col("path") == F.col("last.path")) & F.col("after") & (F.col("prev") == F.col("last.rn"))
    return rows.where((place <= end) | own).drop("last")


def report_rows(kept: DataFrame, watch: Watch) -> DataFrame:
    """The rows that the report shows, in order: line, header or gap before it, its bytes and the bytes up to it.

    At most ``max_lines`` hits with 2 * context lines each come here, so one sort holds them."""
    rows = within_budget(kept, watch.max_lines, watch.context)
    order = Window.orderBy("file_ord", "seg", "number")
    text = clean_text(F.concat(F.col("number").cast("string"), F.when(F.col("hit"), ": ").otherwise("- "), F.col("text")))
    # a line over the cap of a piece is whole in its pieces; only one that goes on behind the last piece is cut
    cut = F.when(F.col("still_cut"), " [cut]").otherwise("") if "still_cut" in rows.columns else F.lit("")
    rows = rows.withColumns({"place": F.row_number().over(order), "new_path": F.coalesce(F.lag("path").over(order) != F.col("path"), F.lit(True)), "line": F.concat(text, cut)})
    rows = rows.withColumn("header", F.when(F.col("new_path"), clean_text(F.concat(F.lit("==> "), F.col("path"), F.lit(" <==")))).when(F.col("gap"), "--"))
    blank = F.col("new_path") & (F.col("place") > 1)
    size = F.octet_length("line") + 1 + F.coalesce(F.octet_length("header") + 1, F.lit(0)) + blank.cast("int")
    rows = rows.withColumns({"blank": blank, "bytes": size.cast("long")})
    rows = rows.withColumn("bytes_so_far", F.sum("bytes").over(order.rowsBetween(Window.unboundedPreceding, 0)))
    return rows.where(F.col("bytes_so_far") <= watch.report_bytes)


def report_lines(kept: DataFrame, watch: Watch) -> DataFrame:
    """line_no and line of the report's text."""
    rows = report_rows(kept, watch)
    lines = F.array_compact(F.array(F.when(F.col("blank"), ""), F.col("header"), F.col("line")))
    flat = rows.select("place", F.posexplode(lines).alias("part", "line"))
    return flat.select(F.row_number().over(Window.orderBy("place", "part")).cast("long").alias("line_no"), "line")


def remainder(rows: DataFrame, counts: DataFrame) -> DataFrame:
    """One row: total matches, those shown, and those left."""
    shown = rows.agg(F.count_if("hit").alias("shown"))
    total = counts.agg(F.coalesce(F.sum("matched"), F.lit(0)).cast("long").alias("total"))
    return total.join(F.broadcast(shown)).withColumn("left", F.col("total") - F.col("shown"))
