"""Runs of a watch over files that grow and are rotated between the runs, in the layouts that rotation tools make."""

import gzip
import os
import shutil

import pytest
from pyspark.sql import functions as F

from tailglass.operators.rules import Watch
from tailglass.plans.incremental import CURSORS, run

WATCH = Watch.of("w", patterns=["line"], context=1)


def moved(log, to):
    os.rename(log, to)


def copied(log, to):
    shutil.copy2(log, to)
    log.write_text("")


def packed(log, to):
    to.write_bytes(gzip.compress(log.read_bytes()))
    log.unlink()


LAYOUTS = {"compress": (packed, "app.log.1.gz"), "copytruncate": (copied, "app.log-20190307"), "extension": (moved, "app.1.log")}


@pytest.mark.parametrize("layout", LAYOUTS)
def test_layouts(spark, tmp_path, layout):
    log, got = tmp_path / "app.log", []
    cursors = spark.createDataFrame([], CURSORS)

    def once(answer=True):
        nonlocal cursors
        got.clear()

        def deliver(kept, counts):
            got.extend((r.number, r.text) for r in kept.where("hit").orderBy("seg", "number").collect())
            return answer

        cursors = run(spark, WATCH, [str(log)], cursors, deliver, F.lit("2030-01-01").cast("timestamp"), F.lit(True))
        return list(got)

    log.write_text("old line 1\nold line 2\n")
    assert once() == [(1, "old line 1"), (2, "old line 2")]
    with log.open("a") as f:
        f.write("since line 1\nsince line 2\n")
    rotate, name = LAYOUTS[layout]
    rotate(log, tmp_path / name)
    with log.open("a") as f:
        f.write("live line 1\npart of a line")
    want = [(3, "since line 1"), (4, "since line 2"), (1, "live line 1")]
    if layout == "compress":
        assert once(False) == want  # not accepted: all of it comes again
    assert once() == want
    with log.open("a") as f:
        f.write(" and its end\n")
    assert once() == [(2, "part of a line and its end")]
    assert once() == []
    row = cursors.first()
    assert row.offset == log.stat().st_size and row.line == 2
