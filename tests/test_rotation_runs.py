"""Runs over many logs at once, each with a history of its own: what comes, once, with which numbers, and what is remembered."""

import bz2
import gzip
import json
import os
import shutil
import time

import pytest
from pyspark.sql import functions as F

from tailglass.operators.matching import matched, run_until
from tailglass.operators.rules import Watch
from tailglass.plans import incremental
from tailglass.plans.incremental import CURSORS, in_ranges, stretches, watched
from tailglass.sources.loglines import Stretch, micros, read_stretches
from tailglass.sources.loglines import stretch as read_one

WATCH = Watch.of("w", regex=["[a-z]"], max_lines=100_000)


class Runs:
    def __init__(self, spark, folder, patterns):
        self.spark, self.folder, self.patterns = spark, folder, patterns
        self.cursors, self.moments, self.failed = spark.createDataFrame([], CURSORS), None, {}

    def once(self, accept=True, **how):
        """file name: the lines that came, as (name of what was read, number, text)."""
        got = {}

        def deliver(kept, counts):
            for r in kept.where("hit").orderBy("file", "seg", "number", "frag").collect():
                got.setdefault(os.path.basename(r.file), []).append((os.path.basename(r.path), r.number, r.text))
            return accept

        done = watched(self.spark, WATCH, [str(self.folder / p) for p in self.patterns], self.cursors, deliver, F.timestamp_seconds(F.lit(int(time.time()))), moments=self.moments, **how)
        self.cursors, self.moments = done.cursors, done.moments
        self.failed = {os.path.basename(r.item): r.why for r in done.failed.collect()}
        return got

    def cursor(self, name):
        return next((r for r in self.cursors.collect() if os.path.basename(r.file) == name), None)


def put(path, text):
    path.parent.mkdir(exist_ok=True)
    with path.open("a") as f:
        f.write(text)


def stamped(path, second):
    os.utime(path, (second, second))


@pytest.fixture
def runs(spark, tmp_path):
    names = ["absent.log", "links.log", "same.log", "twin.log", "one.log", "long.log", "packed.gz", "torn.gz", "deep.log", "none.log", "b*.log", "q.log*"]
    return Runs(spark, tmp_path, names)


def test_histories(runs, tmp_path):
    p = lambda name: tmp_path / name
    for name in ("absent", "links", "same", "twin", "deep"):
        put(p(f"{name}.log"), "first of it\nold\n")
    put(p("b1.log"), "first of b\n")
    put(p("q.log"), "first of q\n")
    put(p("q.log.1"), "never a log\n")
    put(p("one.log"), "only line\n")
    put(p("long.log"), "zero\n" + "y" * 20_005)
    p("packed.gz").write_bytes(gzip.compress(b"in a pack\n"))
    torn = gzip.compress(os.urandom(3000).hex().encode() + b"\n")
    p("torn.gz").write_bytes(torn[: len(torn) // 2])
    assert runs.once() == {}  # a first sight begins at the end
    assert runs.failed == {"torn.gz": "damaged"} or runs.failed == {}
    assert (runs.cursor("one.log").line, runs.cursor("long.log").line, runs.cursor("long.log").in_line) == (1, 1, True)
    assert runs.cursor("packed.gz").size == p("packed.gz").stat().st_size

    # what happens before the second run
    put(p("absent.log"), "tail of absent\n")
    p("absent.log").rename(p("absent.log.1"))
    for name in ("links", "same", "twin", "deep"):
        put(p(f"{name}.log"), f"tail of {name}\n")
    p("links.log").rename(p("links.log.1"))
    os.link(p("links.log.1"), p("a-backup"))
    put(p("links.log"), "links anew\n")
    p("same.log").rename(p("same.log.2"))  # two rotations within a second
    put(p("same.log.1"), "between\n")
    put(p("same.log"), "same anew\n")
    for name in ("same.log.1", "same.log.2"):
        stamped(p(name), int(time.time()) + 1)
    whole = p("twin.log").read_bytes()
    p("twin.log.1.bz2").write_bytes(bz2.compress(whole + b"more of twin\n" * 9000))
    packed = gzip.compress(whole + b"more of twin\n" * 9000, 0)
    p("twin.log.1.gz").write_bytes(packed[: len(packed) - 2000])
    p("twin.log").unlink()
    put(p("twin.log"), "twin anew\n")
    put(p("b1.log"), "tail of b\n")
    p("b1.log").rename(p("b1.log.1"))
    put(p("b1.log"), "b anew\n")
    put(p("b2.log"), "b2 is new\n")
    put(p("q.log"), "more of q\n")
    put(p("one.log"), "second line\n")
    put(p("long.log"), "end of it\nlast of it\n")
    here = os.stat(p("packed.gz"))
    with p("packed.gz").open("r+b") as f:  # the same file by inode, size and time: it is not opened, so nobody sees this
        f.write(b"\0" * here.st_size)
    os.utime(p("packed.gz"), ns=(here.st_atime_ns, here.st_mtime_ns))
    # a deep chain: three rotations, the first of them packed
    p("deep.log.3.gz").write_bytes(gzip.compress(p("deep.log").read_bytes()))
    p("deep.log").unlink()
    put(p("deep.log.2"), "deep two\n")
    put(p("deep.log.1"), "deep one\n")
    put(p("deep.log"), "deep anew\n")

    want = {
        "absent.log": [("absent.log.1", 3, "tail of absent")],
        "links.log": [("links.log.1", 3, "tail of links"), ("links.log", 1, "links anew")],
        "same.log": [("same.log.2", 3, "tail of same"), ("same.log.1", 1, "between"), ("same.log", 1, "same anew")],
        "b1.log": [("b1.log.1", 2, "tail of b"), ("b1.log", 1, "b anew")],
        "b2.log": [("b2.log", 1, "b2 is new")],
        "q.log": [("q.log", 2, "more of q")],
        "one.log": [("one.log", 2, "second line")],
        "long.log": [("long.log", 2, "end of it"), ("long.log", 3, "last of it")],
        "deep.log": [("deep.log.3.gz", 3, "tail of deep"), ("deep.log.2", 1, "deep two"), ("deep.log.1", 1, "deep one"), ("deep.log", 1, "deep anew")],
    }

    def apart(got):
        twin = got.pop("twin.log")
        assert twin[0] == ("twin.log.1.bz2", 3, "tail of twin") and twin[-2:] == [("twin.log.1.bz2", 9003, "more of twin"), ("twin.log", 1, "twin anew")] and len(twin) == 9002
        return got

    before = {r.file: r for r in runs.cursors.collect()}
    assert apart(runs.once(accept=False)) == want
    assert {r.file: r.offset for r in runs.cursors.collect() if r.file in before} == {k: v.offset for k, v in before.items()}
    assert runs.cursor("b2.log").offset == 0  # pinned where its reading began
    assert apart(runs.once()) == want
    cursor = runs.cursor("absent.log")
    assert cursor.modified is not None and cursor.offset == p("absent.log.1").stat().st_size and cursor.line == 3
    assert runs.cursor("long.log").line == 3 and runs.cursor("one.log").line == 2
    assert runs.once() == {}  # the live file is still away, and nothing comes twice

    # the copy moves on and is packed, and the live file comes back
    data = p("absent.log.1").read_bytes()
    facts = os.stat(p("absent.log.1"))
    p("absent.log.2.gz").write_bytes(gzip.compress(data))
    os.utime(p("absent.log.2.gz"), ns=(facts.st_atime_ns, facts.st_mtime_ns // 10**9 * 10**9))
    p("absent.log.1").unlink()
    put(p("absent.log.1"), "a day between\n")
    put(p("absent.log"), "back again\n")
    assert runs.once() == {"absent.log": [("absent.log.1", 1, "a day between"), ("absent.log", 1, "back again")]}
    assert runs.once() == {}


def test_a_rotation_during_the_run(spark, tmp_path, monkeypatch):
    """Names move between the plan and the read: the chain stops there, and the next run reads the rest, once."""
    runs, log = Runs(spark, tmp_path, ["a.log", "c.log"]), tmp_path / "a.log"
    put(log, "first a\n")
    put(tmp_path / "c.log", "first c\n")
    runs.once()
    put(log, "two\n")
    log.rename(tmp_path / "a.log.1")
    put(log, "three\n")
    put(tmp_path / "c.log", "two c\n")

    def rotated(spark, segments):
        monkeypatch.setattr(incremental, "read_stretches", read_stretches)
        log.rename(tmp_path / "a.log.0")
        put(log, "four\n")
        (tmp_path / "c.log").rename(tmp_path / "c.log.1")
        put(tmp_path / "c.log", "three c\n")
        return read_stretches(spark, segments)

    monkeypatch.setattr(incremental, "read_stretches", rotated)
    assert runs.once() == {"a.log": [("a.log.1", 2, "two")]}
    assert runs.cursor("a.log").modified is not None and runs.cursor("c.log").line == 1
    assert runs.once() == {"a.log": [("a.log.0", 1, "three"), ("a.log", 1, "four")], "c.log": [("c.log.1", 2, "two c"), ("c.log", 1, "three c")]}
    # copytruncate between the plan and the read: nothing of the new content comes from the old place
    put(log, "five\n")

    def cut(spark, segments):
        monkeypatch.setattr(incremental, "read_stretches", read_stretches)
        shutil.copy2(log, tmp_path / "a.log-20300101")
        log.write_text("four, but new\nfive, but new\nsix\n")
        return read_stretches(spark, segments)

    monkeypatch.setattr(incremental, "read_stretches", cut)
    assert runs.once() == {}
    assert runs.once()["a.log"] == [("a.log-20300101", 2, "five"), ("a.log", 1, "four, but new"), ("a.log", 2, "five, but new"), ("a.log", 3, "six")]


def rows_of(path, **how):
    *rows, last = read_one(Stretch("f", str(path), **how))
    return [r[3:6] for r in rows], last[9], last[3], json.loads(last[10])


def test_a_cut_while_it_is_read(tmp_path):
    """Between two chunks the file is cut and filled again, with another first line or the same one."""
    for same in (True, False):
        log = tmp_path / f"a{same}"
        log.write_text("head\n" + "".join(f"old {i}\n" for i in range(40_000)))
        reader = read_one(Stretch("f", str(log)))
        got = [next(reader) for _ in range(10)]
        with log.open("r+") as f:
            f.truncate(0)
            f.write(("head\n" if same else "another\n") + "".join(f"new {i}\n" for i in range(50_000)))
        rest = list(reader)
        assert not any(r[5] and r[5].startswith("new") for r in rest)
        state, done = json.loads(rest[-1][10]), len(got) + len(rest) - 1
        assert state["why"] == "truncated" and rest[-1][3] == done and rest[-1][9] == rest[-2][9]
    log = tmp_path / "b"
    log.write_text("one\ntwo\n")
    facts = os.stat(log)
    assert rows_of(log, ino=facts.st_ino, dev=facts.st_dev)[3]["why"] == "ok"
    assert rows_of(log, ino=facts.st_ino + 1, dev=facts.st_dev)[3]["why"] == "renamed" and rows_of(log, start=9)[3]["why"] == "truncated"
    assert rows_of(log, fingerprint="x")[3]["why"] == "truncated" and rows_of(tmp_path / "c")[3]["why"] == "gone"
    assert rows_of(log)[3]["modified"] == micros(facts)


def test_a_line_in_parts(tmp_path):
    """A tail of any length and its end have one number; the line behind it has the next."""
    log = tmp_path / "a"
    log.write_bytes(b"one\n" + b"x" * 20_000)
    rows, at, number, state = rows_of(log)
    assert [(n, f, len(t)) for n, f, t in rows] == [(1, 0, 3), (2, 0, 16_000)] and (at, number, state["in_line"]) == (20_004, 1, True)
    with log.open("ab") as f:
        f.write(b"\0y" * 9000)
    rows, at, number, state = rows_of(log, start=at, number=number, in_line=True)
    assert [(n, f, t[:2]) for n, f, t in rows] == [(2, 1, "\0y")] and state["in_line"]
    with log.open("ab") as f:
        f.write(b"end\nnext\npart")
    rows, at, number, state = rows_of(log, start=at, number=number, in_line=True, history=5)
    assert rows == [(1, 0, "one"), (2, 1, "end"), (3, 0, "next")] and (number, state["in_line"]) == (3, False)
    assert log.read_bytes()[at:] == b"part"


def test_ranges_give_the_same_rows(spark, tmp_path):
    """Ranges of a plain file: lines longer than a range, runs of NULs and a last line without end."""
    import random

    rng = random.Random(4)
    lines = [rng.choice((b"", b"a", b"b" * 50, b"c" * 700, b"\0" * 30, b"\0\0d", b"e" * 17_000, b"\r")) for _ in range(900)]
    log = tmp_path / "big"
    log.write_bytes(b"\n".join(lines) + b"\nrest")
    size = log.stat().st_size
    for start, number, inside in ((0, 0, False), (len(b"\n".join(lines[:7])) + 1, 7, False)):
        plan = spark.createDataFrame([("f", str(log), 1, start, number, inside, None, None, None, size)], incremental.PLAN)
        many = stretches(plan, 2, 9001)
        assert len(many) == -(-(size - 1 - start) // 9001)
        whole = Stretch("f", str(log), 1, start, number, 2 if start else 0)
        pick = lambda segments: [tuple(r)[:10] for r in read_stretches(spark, segments).where("state IS NULL").orderBy("end_offset").collect()]
        one = pick([whole.as_json()])
        assert pick(many) == one and len(one) > 700
    huge = spark.createDataFrame([("f", str(log), 1, 0, 0, False, None, None, None, 4 << 30)], incremental.PLAN)
    assert in_ranges(huge, 64 << 20).count() == 64


def test_zst(spark, tmp_path):
    zstandard = pytest.importorskip("zstandard")
    lines = [b"line %d" % i for i in range(30_000)]
    data = b"\n".join(lines) + b"\n"
    pack = zstandard.ZstdCompressor().compress
    (tmp_path / "a.zst").write_bytes(pack(data[:100_000]) + pack(data[100_000:]))
    rows, at, number, state = rows_of(tmp_path / "a.zst")
    assert [t.encode() for _, _, t in rows] == lines and (at, number, state["why"]) == (len(data), 30_000, "ok")
    start = len(b"\n".join(lines[:20_000])) + 1
    rows, *_ = rows_of(tmp_path / "a.zst", start=start, number=20_000, history=2)
    assert rows[:3] == [(19_999, 0, "line 19998"), (20_000, 0, "line 19999"), (20_001, 0, "line 20000")]
    (tmp_path / "b.zst").write_bytes(pack(data)[:-900])
    rows, _, number, state = rows_of(tmp_path / "b.zst")
    assert state["why"] == "damaged" and number == len(rows) < 30_000


def test_a_folder_of_copies_and_no_files(spark, tmp_path):
    """Nothing to read is no error; copies are found in another folder; a name there that only looks alike is none."""
    runs = Runs(spark, tmp_path, ["x.log", "y.log"])
    old = tmp_path / "old"
    assert runs.once() == {} and runs.failed == {}
    put(tmp_path / "x.log", "one\n")
    runs.once()
    put(tmp_path / "x.log", "two\n")
    old.mkdir()
    (tmp_path / "x.log").rename(old / "x.log.1")
    put(old / "x.logs.1", "other\n")
    put(tmp_path / "x.log", "three\n")
    assert runs.once(folders=[str(old)]) == {"x.log": [("x.log.1", 2, "two"), ("x.log", 1, "three")]}
    assert runs.cursor("y.log") is None


def test_one_deadline_for_all_batches(spark):
    """Each batch is well within its own bound, and all of them together are not."""
    watch = Watch.of("slow", regex=["(a+)+$"])
    rows = spark.range(200).select(F.lit("f").alias("file"), F.lit("f").alias("path"), F.col("id").alias("number"), F.concat(F.lit("a" * 21), F.lit("!"), F.col("id")).alias("text")).coalesce(1)
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "1")
    began = time.time()
    try:
        with pytest.raises(Exception, match="took more than"):
            matched(rows, watch, 60, run_until(4)).where("hit").count()
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    assert time.time() - began < 30
