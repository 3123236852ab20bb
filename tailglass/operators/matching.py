"""Which lines match a watch, by which pattern, with which priority.

Literals and plain regular expressions stay in built-in functions; other expressions go to Python's ``re`` in
Arrow batches, since Java's engine differs on them and may overflow its stack.
"""

from __future__ import annotations

import re
import signal
import threading
import time

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .rules import RANK, Pattern, Watch


def run_until(seconds: float) -> float | None:
    """The moment at which a run that begins now has searched for ``seconds``; None for no bound."""
    return time.time() + seconds if seconds > 0 else None


def hit(pattern: Pattern, text: Column, scan_seconds: float = 300, until: float | None = None) -> Column:
    """Whether a text matches; null is no match.  No batch may take longer than ``scan_seconds``, nor any go on after ``until``."""
    if not pattern.regex:
        wanted = F.lit(pattern.text.lower() if pattern.ignore_case else pattern.text)
        found = F.contains(F.lower(text) if pattern.ignore_case else text, wanted)
    elif pattern.in_jvm:
        found = text.rlike(pattern.text)
    else:
        found = _searched(pattern, scan_seconds, until)(text)
    return F.coalesce(found, F.lit(False))


def _searched(pattern: Pattern, seconds: float, until: float | None = None):
    @F.pandas_udf("boolean")
    def search(texts: pd.Series) -> pd.Series:
        find = re.compile(pattern.text, re.IGNORECASE if pattern.ignore_case else 0).search

        now = [""]

        def late(*_):
            raise TimeoutError(f"{pattern.text!r} took more than {seconds:g} s; the line begins {now[0][:80]!r}")

        def found(text: str | None) -> bool:
            now[0] = text or ""
            return text is not None and find(text) is not None

        # one deadline for all tasks of a run: what is left of it bounds this batch
        left = seconds if until is None else min(seconds or until, until - time.time())
        if until is not None and left <= 0:
            late()
        timed = left > 0 and threading.current_thread() is threading.main_thread()
        if timed:
            signal.signal(signal.SIGALRM, late)
            signal.setitimer(signal.ITIMER_REAL, left)
        try:
            return texts.map(found).astype(bool)
        finally:
            if timed:
                signal.setitimer(signal.ITIMER_REAL, 0)

    return search


def matched(lines: DataFrame, watch: Watch, scan_seconds: float = 300, until: float | None = None) -> DataFrame:
    """``lines`` with what the watch finds in each, and no row less.

    raw_hit: some pattern matches; excluded: it does and so does an exclude; hit: it does and none does;
    found: the numbers of all patterns that match, from 1; first_pattern: the first; rank: the highest priority
    of these (3 high, 2 medium, 1 low, null off).  Lines under ``is_history`` (if there) are no hits."""
    text = F.col("text")
    marks = [f"_tg_p{i}" for i in range(len(watch.patterns))]
    lines = lines.withColumns({m: hit(p, text, scan_seconds, until) for m, p in zip(marks, watch.patterns, strict=True)})
    any_of = lambda columns: F.greatest(F.lit(False), F.lit(False), *columns)
    raw = any_of([F.col(m) for m in marks])
    if "is_history" in lines.columns:
        raw &= ~F.coalesce("is_history", F.lit(False))
    lines = lines.withColumn("raw_hit", raw)
    # an exclude is looked for only where a pattern was found: Python gets a null for other lines, whatever Spark's order
    left = [hit(p, F.when(F.col("raw_hit"), text), scan_seconds, until) for p in watch.excludes]
    lines = lines.withColumn("excluded", any_of(left))
    ranks = [RANK.get(p.priority or watch.priority or "") for p in watch.patterns]
    rank = F.greatest(F.lit(None).cast("int"), F.lit(None).cast("int"), *(F.when(F.col(m), F.lit(r).cast("int")) for m, r in zip(marks, ranks, strict=True)))
    kept = F.col("hit")
    return (
        lines.withColumn("hit", F.col("raw_hit") & ~F.col("excluded"))
        .withColumn("found", F.when(kept, F.filter(F.array(*(F.when(F.col(m), F.lit(i + 1)) for i, m in enumerate(marks))), lambda x: x.isNotNull())))
        .withColumn("first_pattern", F.when(kept, F.coalesce(*(F.when(F.col(m), F.lit(i + 1)) for i, m in enumerate(marks)))))
        .withColumn("rank", F.when(kept, rank))
        .drop(*marks)
    )


def priority_name(rank: Column) -> Column:
    return F.when(rank == 3, "high").when(rank == 2, "medium").when(rank == 1, "low")
