import bz2
import datetime
import gzip
import hashlib
import lzma
import os
from collections import Counter

import pytest
from pyspark.sql import functions as F

from tailglass.functions import names as N
from tailglass.functions import text as T
from tailglass.operators.context import capped, context_of_hits, with_context
from tailglass.operators.counts import file_counts
from tailglass.operators.matching import matched
from tailglass.operators.report import report_lines
from tailglass.operators.rules import Pattern, Watch, tagged
from tailglass.queries import QUERIES
from tailglass.sources.listing import in_order, listing
from tailglass.sources.loglines import read_lines
from tailglass.sources.tables import lines_of_text
from tailglass.streaming.watch import appended, rolling_counts, watch_stream

STREAM = "file string, path string, seg int, number long, text string, file_ord int"


def test_rules():
    assert tagged("[high] disk") == Pattern("disk", priority="high") and tagged("[High] disk").priority is None
    assert Pattern("a.c", regex=True).in_jvm is False and Pattern("^[a-z]+ error", regex=True).in_jvm
    assert not Pattern(r"(a|b)*", regex=True).in_jvm and Pattern("(a+)+$", regex=True).nested
    for bad in (lambda: Watch("w", ()), lambda: Pattern(""), lambda: Pattern("(", regex=True), lambda: Watch("w", (Pattern("x"),), priority="top")):
        with pytest.raises(Exception):
            bad()


def test_matching_as_python(spark):
    texts = ["Disk Failure", "disk failure (expected)", "kernel: OOM killed", "É école 123", None, "", "a%b_c", "12 34"]
    watch = Watch.of("w", patterns=["%b_", "[high] Disk"], ipatterns=["FAILURE"], regex=[r"\d{3}", "[0-9] [0-9]"], iregex=["^É|^kernel:.*oom"], iexclude=["EXPECTED"], priority="low")
    rows = matched(spark.createDataFrame([("f", "f", i, t) for i, t in enumerate(texts)], "file string, path string, number long, text string"), watch).orderBy("number").collect()
    assert [r.hit for r in rows] == [True, False, True, True, False, False, True, True]
    assert [r.excluded for r in rows] == [False, True] + [False] * 6
    assert [r.found for r in rows] == [[2, 3], None, [6], [4, 6], None, None, [1], [5]]
    assert [r.rank for r in rows] == [3, None, 1, 1, None, None, 1, 1]


def scan(rows, n, cap):
    """Line by line: (number, path, hit, gap) of what is stored."""
    out, after, pending, last, seen = [], 0, [], None, 0
    path = None
    for number, p, hit in rows:
        if p != path:
            path, after, pending = p, 0, []
        if hit:
            seen += 1
            after = n
            if seen <= cap:
                out += [*pending, (number, p, True)]
            else:
                after = 0
            pending = []
        elif after:
            after -= 1
            if seen <= cap:
                out.append((number, p, False))
        else:
            pending = (pending + [(number, p, False)])[-n:] if n else []
    return [(a, b, c, i > 0 and (a > out[i - 1][0] + 1 or b != out[i - 1][1])) for i, (a, b, c) in enumerate(out)]


def test_windows_match_a_scan(spark):
    import random

    rng = random.Random(2)
    for n, cap in ((0, 3), (1, 2), (2, 99), (3, 4)):
        rows, want = [], {}
        for f in range(40):
            own, number = [], 0
            for p in range(rng.randint(1, 2)):
                number = 0
                for _ in range(rng.randint(0, 15)):
                    number += 1 + (rng.random() < 0.1)
                    own.append((number, f"{f}-{p}", rng.random() < 0.25))
            rows += [(f"{f}", p, int(p[-1]), k, h) for k, p, h in own]
            want[f"{f}"] = scan(own, n, cap)
        frame = spark.createDataFrame(rows, "file string, path string, seg int, number long, hit boolean")
        got = {f: [] for f in want}
        for size in (1 << 16, 3):  # files of one block, and blocks that a line's context may span
            for own in got.values():
                own.clear()
            for r in capped(with_context(frame, n, size=size), cap).orderBy("file", "seg", "number").collect():
                got[r.file].append((r.number, r.path, r.hit, r.gap))
            assert got == want
    dense = spark.range(1, 200).select(F.lit("f").alias("file"), F.lit("f").alias("path"), F.col("id").alias("number"), (F.col("id") % 31 == 0).alias("hit"))
    pick = lambda df: sorted(map(tuple, df.select("number", "hit").collect()))
    assert pick(context_of_hits(dense, 3)) == pick(with_context(dense, 3))


def rendered(files, n, hits_of):
    """The report's lines as its rules say, file by file: files are lists of (path, [(number, text, goes on)])."""
    out = []
    for path, lines in files:
        marked = [hits_of(text) for _, text, _ in lines]
        kept = [i for i in range(len(lines)) if any(marked[max(0, i - n) : i + n + 1])]
        if not kept:
            continue
        out += ([""] if out else []) + [f"==> {path} <=="]
        before = None
        for i in kept:
            number, text, more = lines[i]
            if before is not None and number != before + 1:
                out.append("--")
            out.append(f"{number}{':' if marked[i] else '-'} {text}{' [cut]' if more else ''}")
            before = number
    return out


def test_report_text(spark):
    """Random files of one to three paths, with numbers that begin anywhere and skip, against a renderer of its own."""
    import random

    rng = random.Random(8)
    for n in (0, 2):
        rows, files = [], []
        for f in range(12):
            for seg in range(rng.randint(1, 3)):
                number, lines = rng.choice((0, 400)), []
                for _ in range(rng.randint(0, 14)):
                    number += 1 + (rng.random() < 0.15)
                    word = rng.choice(("ferry", "buoy", "RUDDER lost", "anchor", "tide", "tide", "tide"))
                    lines.append((number, f"{word} {rng.randint(0, 9)}", rng.random() < 0.1))
                path = f"/harbour/{f:02d}{'' if seg == 2 else f'.{9 - seg}'}"
                files.append((path, lines))
                rows += [(f"h{f:02d}", path, seg, k, t, f, more) for k, t, more in lines]
        watch = Watch.of("w", patterns=["ferry"], ipatterns=["rudder"], exclude=["ferry 3"], context=n, max_lines=1000)
        found = matched(spark.createDataFrame(rows, STREAM + ", still_cut boolean"), watch)
        text = [r.line for r in report_lines(capped(with_context(found, n), watch.max_lines), watch).orderBy("line_no").collect()]
        is_hit = lambda t: ("ferry" in t or "rudder" in t.lower()) and "ferry 3" not in t
        assert text == rendered(files, n, is_hit)
        counts = {r.file: (r.lines, r.matched) for r in file_counts(found).collect()}
        assert counts == {f: (len(own), sum(map(is_hit, own))) for f in {r[0] for r in rows} for own in [[r[4] for r in rows if r[0] == f]]}


def test_an_exclude_sees_only_hits(spark):
    """A search without end on a line that no pattern matches is never begun."""
    watch = Watch.of("w", patterns=["hit"], exclude_regex=["(a+)+$"])
    rows = spark.createDataFrame([("f", "f", 1, "a" * 40 + "!"), ("f", "f", 2, "hit aaa"), ("f", "f", 3, "hit b")], "file string, path string, number long, text string")
    assert [r.hit for r in matched(rows, watch, 5).orderBy("number").collect()] == [False, False, True]
    slow = spark.createDataFrame([("f", "f", 1, "hit " + "a" * 60 + "!")], "file string, path string, number long, text string")
    with pytest.raises(Exception, match="the line begins 'hit aaa"):
        matched(slow, watch, 1).collect()


@pytest.mark.parametrize(("suffix", "opener"), [("", open), (".gz", gzip.open), (".bz2", bz2.open), (".xz", lzma.open)])
def test_line_source(spark, tmp_path, suffix, opener):
    lines = [b"a", b"", b"b\r", b"c\rd", b"caf\xe9", b"\0\0\0", b"\0\0two", b"x" * 2000, b"y" * 2001 + b"\r", b"z" * 16001, "é".encode() * 3000]
    path = f"{tmp_path}/log{suffix}"
    with opener(path, "wb") as f:
        f.write(b"\n".join(lines) + b"\npart")
    rows = read_lines(spark, [{"file": "f", "path": path, "seg": 3}]).orderBy("number").collect()
    assert [r.number for r in rows] == [1, 2, 3, 4, 5, 7, 8, 9, 10, 11]
    assert [r.text for r in rows[:7]] == ["a", "", "b", "c\rd", "caf�", "two", "x" * 2000]
    assert [(len(r.text), r.cut, r.still_cut) for r in rows[7:9]] == [(2001, True, False), (16000, True, True)]
    assert rows[9].text == "é" * 3000 and rows[0].end_offset == 2
    again = read_lines(spark, [{"file": "f", "path": path, "start": rows[4].end_offset, "number": 5}]).orderBy("number").collect()
    assert [(r.number, r.text) for r in again] == [(r.number, r.text) for r in rows[5:]]


def moment(text, epoch=False):
    """The key of a time in UTC."""
    t = datetime.datetime.fromisoformat(text).replace(tzinfo=datetime.timezone.utc)
    return [t.year, t.month, t.day, t.hour, t.minute, t.second, int(t.timestamp()) if epoch else 0]


DAY, NOON = moment("2019-03-07"), moment("2019-03-07T12:34:56")
STAMP = moment("2019-03-07T12:34:56", True)
NAMES = [
    *((f"till.log.{n}{z}", "numeric", [-n], f".{n}", bool(z)) for n in (1, 23, 4567) for z in ("", ".gz", ".zst")),
    *((f"till.{n}.log{z}", "numeric", [-n], f".{n}", bool(z)) for n in (2, 30) for z in ("", ".xz")),
    ("till.log-20190307", "dated", DAY, "-20190307", False), ("till.log-2019030712.bz2", "dated", moment("2019-03-07T12:00:00"), "-2019030712", True),
    ("till.log-20190307123456", "dated", NOON, "-20190307123456", False), ("till.log.20190307T123456", "dated", NOON, ".20190307T123456", False),
    ("till.log-2019-03-07", "dated", DAY, "-2019-03-07", False), ("till.log.2019-03-07_12-34-56.GZ", "dated", NOON, ".2019-03-07_12-34-56", True),
    (f"till.log-{STAMP[-1]}", "dated", STAMP, f"-{STAMP[-1]}", False), (f"till.log-20190305-{STAMP[-1]}", "dated", [2019, 3, 5, *STAMP[3:]], f"-20190305-{STAMP[-1]}", False),
    ("till-20190307.log.gz", "dated", DAY, "-20190307", True), ("till.log.20190231", "other", [], ".20190231", False), ("till.log.98765", "other", [], ".98765", False),
    ("till.log.old", "other", [], ".old", False), ("till.log.xz", "other", [], "", True),
    *((x, None, None, None, None) for x in ("till.log", "till.logs", "tills.4.log", "till-bar.log", "till.4.txt", "till4.log", "a-till.log.1", None)),
]


def test_names(spark):
    rows = spark.createDataFrame([(n[0],) for n in NAMES], "name string").select("name", N.classify(F.col("name"), F.lit("till.log")).alias("c")).collect()
    assert [(r.name, *(r.c[x] if r.c else None for x in ("style", "key", "suffix", "compressed"))) for r in rows] == NAMES
    shapes = {"till.log.7": ".7", "pos-8.8": None, "net.8.8.4.4": None, "till.save": ".save", "drawer.xz": ".xz", "drawer": None, "v2.0": None, "till.log-20190307.bz2": "-20190307", "till.12.log": None, "till-bak": "-bak", None: None}
    got = {r.name: r.s for r in spark.createDataFrame([(n,) for n in shapes], "name string").select("name", N.archive_suffix(F.col("name")).alias("s")).collect()}
    assert got == shapes
    kin = spark.createDataFrame([("till.1.log",)], "name string").select(N.kin_bases(F.col("name")).alias("k")).first().k
    assert set(kin) == {"till", "till.1", "till.log"}


GLOBS = {
    "/l/a?b": {"/l/axb", "/l/a]b", "/l/a\nb"}, "/l/a[!x]b": {"/l/a]b", "/l/a\nb"}, "/l/*": {"/l/axb", "/l/a]b", "/l/a\nb", "/l/d.e", "/l/[z", "/l/dxe"}, "/l/.*": {"/l/.axb"}, "/l/[]x]*": set(), "/l/a[]]b": {"/l/a]b"},
    "/*/a[w-y]b": {"/l/axb"}, "/l/[z": {"/l/[z"}, "/l/d.e": {"/l/d.e"}, "/l/a[z-a]b": set(), "/l/a[!z-a]b": {"/l/axb", "/l/a]b", "/l/a\nb"}, "/l/*/b": {"/l/a/b"}, "/l/[.]axb": set(),
}


def test_globs(spark):
    paths = ["/l/axb", "/l/a/b", "/l/a]b", "/l/a\nb", "/l/.axb", "/l/d.e", "/l/dxe", "/l/axb\n", "/l/[z"]
    frame = spark.createDataFrame([(p,) for p in paths], "path string")
    for glob, want in GLOBS.items():
        got = {r.path for r in frame.where(F.col("path").rlike(N.glob_to_regex(glob))).collect()}
        assert got - {"/l/axb\n"} == want, glob
        assert ("/l/axb\n" in got) == (glob in ("/l/*",)), glob


def test_listing(spark, tmp_path):
    for name in ("b.log", "a.log", "c.txt", ".h.log", "_u.log", "sub/i.log", "sub/.x/j.log", "other/i.log"):
        (tmp_path / name).parent.mkdir(parents=True, exist_ok=True)
        (tmp_path / name).write_text(name)
    (tmp_path / "d.log").mkdir()
    (tmp_path / "l.log").symlink_to(tmp_path / "a.log")
    os.link(tmp_path / "b.log", tmp_path / "z.log")
    short = lambda *globs: [(r.glob_ord, r.path.removeprefix(f"{tmp_path}/")) for r in in_order(listing(spark, [f"{tmp_path}/{g}" for g in globs])).collect()]
    assert short("*.log", "*/i.log", "a.log") == [(0, "_u.log"), (0, "a.log"), (0, "b.log"), (1, "other/i.log"), (1, "sub/i.log"), (2, "a.log")]
    assert short(".*.log") == [(0, ".h.log")] and short("sub/.*/*") == [(0, "sub/.x/j.log")] and short("none/*", "no.log") == []
    far = listing(spark, [f"file://{tmp_path}/*.log"]).collect()
    assert {r.path.rpartition("/")[2] for r in far} >= {"a.log", "b.log", "_u.log"} and all(r.length for r in far)


def test_text_functions(spark):
    row = spark.range(1).select(
        T.clean_text(F.lit("a\rb\x07\tc\x85")).alias("a"), T.clean_header(F.lit(" x\ty\nz ")).alias("b"), T.attachment_name(F.lit("--my job/1"), F.lit("2026-01-02 03:04:05").cast("timestamp_ntz")).alias("c"),
        T.is_address(F.lit("a.b@c.org")).alias("d"), F.exists(F.array(*map(F.lit, ("-a@c", "a@-b", "a@.", "a@b..", "a@b\n", "a@", "@b", "a b@c", "ä@b", "a@b@c"))), T.is_address).alias("e"), T.parse_timestamp(F.lit("2026-01-02T03:04:05Z")).cast("string").alias("f"), T.clean_text(F.lit(None).cast("string")).alias("g"),
    ).first()
    assert tuple(row) == ("ab�\tc\x85", "x y z", "my_job_1-20260102T0304.txt", True, False, "2026-01-02 03:04:05", None)


def test_stream(spark, tmp_path):
    src, out, point = (str(tmp_path / x) for x in ("in", "out", "point"))
    schema = "doc_id long, text string"
    put = lambda rows: spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(src)
    put([(1, "ok\nerror one\nok"), (2, "ok")])
    watch = Watch.of("w", patterns=["error"], context=1)
    lines = lambda: lines_of_text(spark.readStream.schema(schema).parquet(src), "doc_id", "text")

    def refused(*_):
        raise RuntimeError("not accepted")

    with pytest.raises(Exception):
        watch_stream(lines(), watch, refused, point).awaitTermination()
    watch_stream(lines(), watch, appended(out), point).awaitTermination()  # the same batch again
    put([(3, "error two")])
    watch_stream(lines(), watch, appended(out), point).awaitTermination()
    kept = spark.read.parquet(f"{out}/kept")
    assert sorted((r.file, r.number, r.hit) for r in kept.collect()) == [(1, 1, False), (1, 2, True), (1, 3, False), (3, 1, True)]
    query = rolling_counts(lines(), watch).writeStream.format("memory").queryName("rolling").outputMode("complete").trigger(availableNow=True).start()
    query.awaitTermination()
    assert {(r.file, r.matched) for r in spark.table("rolling").collect()} == {(1, 1), (2, 0), (3, 1)}


def test_line_source_odd_bytes(spark, tmp_path):
    """Runs of NULs of any length, history before an offset, damaged streams."""
    for hole in (10, 15_999, 16_000, 65_535, 65_536, 70_000, 200_000):
        path = tmp_path / f"hole{hole}"
        path.write_bytes(b"one\n" + b"\0" * hole + b"disk failure\n" + b"\0" * hole + b"\r\n" + b"x\0y\n" + b"\0" * hole)
        rows = read_lines(spark, [{"file": "f", "path": str(path)}]).orderBy("number").collect()
        assert [(r.number, r.text, r.cut, r.still_cut) for r in rows] == [(1, "one", False, False), (2, "disk failure", False, False), (4, "x\0y", False, False)], hole
        assert rows[1].end_offset == 4 + hole + 13
    lines = [b"first", b"", b"\0\0", b"w" * 3000, b"v\r", *(b"%d" % i for i in range(30_000))]
    data = b"".join(x + b"\n" for x in lines)
    for suffix, opener in (("", open), (".gz", gzip.open), (".bz2", bz2.open), (".xz", lzma.open)):
        path = f"{tmp_path}/h{suffix}"
        with opener(path, "wb") as f:
            f.write(data)
        for n, upto in ((3, 5), (9, 4), (2, 29_000), (1, 1)):
            start = sum(len(x) + 1 for x in lines[:upto])
            rows = read_lines(spark, [{"file": "f", "path": path, "start": start, "number": upto, "history": n}]).where(f"number <= {upto + 1}").orderBy("number").collect()
            want = [(i + 1, lines[i].removesuffix(b"\r").decode()[:2000], i < upto) for i in range(max(0, upto - n), upto + 1) if lines[i] != b"\0\0"]
            assert [(r.number, r.text, r.is_history) for r in rows] == want
    packed = gzip.compress(data)
    for name, damaged in (("cut.gz", packed[: len(packed) // 2]), ("bad.gz", packed[:-8] + b"12345678"), ("none.gz", b"no such format")):
        (tmp_path / name).write_bytes(damaged)
        got = [r.number for r in read_lines(spark, [{"file": "f", "path": str(tmp_path / name)}]).collect()]
        assert (len(got) > 1000) == (name != "none.gz") and (name != "bad.gz" or len(got) == len(lines) - 1)


def test_anchors_of_all_documents_match_hashlib(spark, tmp_path):
    """A row for each document; multi-byte characters may lie across the edge of the last 4096 bytes."""
    texts = ["plain", "", None, "é", "a" * 4095 + "é", "é" + "a" * 4095, "b" + "日本" * 2000, "😀" * 1024, "c" + "😀" * 1024, "ab" + "😀" * 1024, "x" * 9000 + "ß\n"]
    spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    got = Counter((r.doc_id, r.anchor) for r in QUERIES["anchors"](spark, str(tmp_path)).collect())
    assert got == Counter((k, None if t is None else hashlib.sha256(t.encode()[-4096:]).hexdigest()) for k, t in enumerate(texts))
