"""The stream of log files over rotations between its batches, with restarts from the checkpoint."""

import gzip
import os

from tailglass.operators.rules import Watch
from tailglass.streaming.follow import FollowReader, followed, is_copy_of
from tailglass.streaming.watch import appended, watch_stream


def test_names():
    assert all(is_copy_of(n, "a.log") for n in ("a.log.1", "a.log.22.gz", "a.log-20300101", "a.1.log", "a-20300101.log.xz"))
    assert not any(is_copy_of(n, "a.log") for n in ("a.log", "a.log.old", "b.log.1", "a-error.log", "a.log.98765"))


def test_rotations_between_batches(spark, tmp_path):
    src, out, point = tmp_path / "logs", str(tmp_path / "out"), str(tmp_path / "point")
    src.mkdir()
    log, other = src / "a.log", src / "b.log"

    def put(path, text):
        with path.open("a") as f:
            f.write(text)

    seen: list = []

    def batch():
        """What comes in one start of the query, by file in order."""
        query = followed(spark, [str(src / "*.log")], "beginning", 1).writeStream.format("parquet").option("checkpointLocation", point).option("path", out).trigger(availableNow=True).start()
        query.awaitTermination()
        rows = [(os.path.basename(r.file), r.number, r.text) for r in spark.read.parquet(out).where("NOT is_history").orderBy("file", "seg", "number").collect()]
        new = [r for r in rows if r not in seen]
        assert len(set(rows)) == len(rows)  # nothing comes twice
        seen.extend(new)
        return sorted(new)

    put(log, "1 one\n1 two\npart")
    assert batch() == [("a.log", 1, "1 one"), ("a.log", 2, "1 two")]
    put(log, " of a line\n")
    log.rename(src / "a.log.1")
    put(log, "2 one\n")
    put(other, "b one\n")
    assert batch() == [("a.log", 1, "2 one"), ("a.log", 3, "part of a line"), ("b.log", 1, "b one")]
    put(log, "2 two\n")
    (src / "a.log.2.gz").write_bytes(gzip.compress((src / "a.log.1").read_bytes()))
    (src / "a.log.1").unlink()
    (src / "a.log.1.gz").write_bytes(gzip.compress(log.read_bytes()))
    log.unlink()
    put(log, "3 one\n")
    put(other, "b two\n")
    assert batch() == [("a.log", 1, "3 one"), ("a.log", 2, "2 two"), ("b.log", 2, "b two")]
    assert batch() == []
    history = spark.read.parquet(out).where("is_history").select("text").collect()
    assert {r.text for r in history} == {"1 two", "2 one", "b one"}


def test_a_watch_over_followed_files(spark, tmp_path):
    log = tmp_path / "a.log"
    log.write_text("before\nerror old\n")
    point, out = str(tmp_path / "point"), str(tmp_path / "out")
    start = lambda: watch_stream(followed(spark, [str(log)], history=1), Watch.of("w", patterns=["error"], context=1), appended(out), point).awaitTermination()
    start()
    with log.open("a") as f:
        f.write("error new\nafter\n")
    start()
    rows = spark.read.parquet(f"{out}/kept").orderBy("number").collect()
    assert [(r.number, r.text, r.hit) for r in rows] == [(2, "error old", False), (3, "error new", True), (4, "after", False)]


def test_a_file_that_is_away(tmp_path):
    """In one run of the query a copy stands for the file; the next batches read what it left, then the file."""
    log = tmp_path / "a.log"
    log.write_text("one\n")
    reader = FollowReader({"files": f'["{log}"]'})
    first = reader.initialOffset()
    with log.open("a") as f:
        f.write("two\n")
    log.rename(tmp_path / "a.log.1")
    second = reader.latestOffset()
    texts = lambda a, b: [r[5] for p in reader.partitions(a, b) for r in reader.read(p)]
    assert texts(first, second) == ["two"]
    third = reader.latestOffset()
    assert texts(second, third) == []
    log.write_text("three\n")
    assert texts(third, reader.latestOffset()) == ["three"]
