"""A watch as a streaming query: every micro-batch is matched, given its context and delivered, then committed.

The checkpoint moves on only when ``deliver`` returns, so an error there means the same batch again: at least
once for the whole batch.  What the table of cursors does and a checkpoint doesn't: to let the quiet files of a
failed batch advance by themselves.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..operators.context import capped, with_context
from ..operators.counts import file_counts
from ..operators.matching import matched
from ..operators.rules import Watch


def watch_stream(lines: DataFrame, watch: Watch, deliver: Callable[[DataFrame, DataFrame, int], None], checkpoint: str) -> StreamingQuery:
    """Over a stream of lines; ``deliver`` gets the stored rows, the counts by file and the batch number."""

    def batch(rows: DataFrame, number: int) -> None:
        found = matched(rows, watch).persist()
        try:
            if not found.where("hit").isEmpty():
                deliver(capped(with_context(found, watch.context), watch.max_lines), file_counts(found), number)
        finally:
            found.unpersist()

    return lines.writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def appended(path: str) -> Callable[[DataFrame, DataFrame, int], None]:
    """A delivery that writes each batch to its own folder, anew if it comes again."""

    def deliver(kept: DataFrame, counts: DataFrame, number: int) -> None:
        kept.write.mode("overwrite").parquet(f"{path}/kept/batch={number}")
        counts.write.mode("overwrite").parquet(f"{path}/counts/batch={number}")

    return deliver


def rolling_counts(lines: DataFrame, watch: Watch) -> DataFrame:
    """Matches of each file so far, kept by the stream's own state."""
    return matched(lines, watch).groupBy("file").agg(F.count("*").alias("lines"), F.count_if("hit").alias("matched"), F.max("rank").alias("rank"))
