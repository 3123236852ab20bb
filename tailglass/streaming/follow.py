"""Log files as a stream: ``spark.readStream.format("follow")``, whose offsets hold each file's place and identity.

Options: ``files`` (JSON list of paths and globs), ``begin`` (end or beginning, for the files of the first batch; files
that come later are read from their start), ``history`` (complete lines before a batch's first line, as rows with
is_history).  Columns are those of the line source but for ``state``.

An offset is JSON: for each file inode and device, the end of its last complete line, the lines before it, and hashes of
the first line and of what stands before the place.  A batch reads each file from one offset to the next.  Where the file
is another one than at the batch's start, or was cut, it reads what was left in the copy that holds the place (by inode,
else by first line and the bytes before the place), then newer copies, then the file from its start; so a rotation between
two batches loses and repeats nothing.  While the file is away its copy stands for it.  A file that moves between plan and
read is looked for by its inode; if it is nowhere the task fails, and Spark plans the batch again.

Only what the query has committed moves: offsets are in Spark's checkpoint, so there is no state here but counts of lines
that are kept from batch to batch and counted anew after a restart.  A line without an end waits for it.  After a restart
a file that is away at that moment begins anew when it is back: copies made meanwhile are then not read.
"""

from __future__ import annotations

import glob
import json
import os
import re
from collections.abc import Iterator, Sequence
from dataclasses import replace

from pyspark.sql.datasource import DataSource, DataSourceStreamReader

from ..functions.names import COMPRESSED, DATED, EPOCH, NUMERIC, STAMPED
from ..sources.facts import before, plain_facts
from ..sources.loglines import CHUNK, DAMAGED, SCHEMA, Stretch, first_line, micros, opener_of, read_some, stretch

COPY = [re.compile(x) for x in (NUMERIC, DATED, EPOCH, STAMPED)]


def is_copy_of(name: str, log: str) -> bool:
    """Whether a name is that of a numbered or dated copy of a log, with the suffix behind the name or before its extension."""
    plain = re.sub(COMPRESSED, "", name)
    stem, own = os.path.splitext(log)
    rests = [plain[len(log) :]] if plain.startswith(log) else []
    if own and plain.startswith(stem) and plain.endswith(own) and len(plain) > len(log):
        rests.append(plain[len(stem) : len(plain) - len(own)])
    return name != log and any(p.match(rest) for rest in rests for p in COPY)


def holds(path: str, place: dict) -> bool:
    """Whether a copy has the first line of the place, reaches it and has the same bytes before it."""
    opener = opener_of(path)
    try:
        with open(path, "rb") as raw:
            stream = opener(raw, "rb") if opener else raw
            return place["first"] is not None and first_line(stream) == place["first"] and before(stream, place["offset"]) == place["anchor"]
    except DAMAGED:
        return False


def copies(path: str) -> list[tuple[int, str, os.stat_result]]:
    """(time, path, facts) of the copies beside a log, oldest first."""
    folder, name = os.path.split(path)
    out = []
    with os.scandir(folder) as entries:
        for e in entries:
            if is_copy_of(e.name, name) and e.is_file(follow_symlinks=False):
                facts = e.stat(follow_symlinks=False)
                number = re.search(r"\.(\d{1,4})(\D|$)", e.name.removeprefix(name)) or re.search(r"\.(\d{1,4})\.", e.name)
                out.append((micros(facts), -int(number[1]) if number else 0, e.path, facts))
    return [(t, p, f) for t, _, p, f in sorted(out, key=lambda x: x[:3])]


def chain(path: str, place: dict) -> list[tuple[str, os.stat_result, bool]]:
    """What a rotated log has left, oldest first: (path, facts, whether it holds the place); without a holder all copies
    that are not older than the place."""
    found = copies(path)
    at = next((i for i, (_, _, f) in enumerate(found) if (f.st_ino, f.st_dev) == (place["ino"], place["dev"])), None)
    if at is None or not holds(found[at][1], place):
        at = next((i for i, (_, p, _) in enumerate(found) if holds(p, place)), None)
    if at is None:
        return [(p, f, False) for t, p, f in found if t >= place["modified"]]
    return [(p, f, i == at) for i, (_, p, f) in enumerate(found) if i >= at]


class FollowReader(DataSourceStreamReader):
    def __init__(self, options: dict):
        self.patterns: list[str] = json.loads(options["files"])
        self.begin, self.history = options.get("begin", "end"), int(options.get("history", 0))
        #: Places as they were last seen.
        self.last: dict[str, dict] = {}

    def paths(self) -> list[str]:
        found = {}
        for pattern in self.patterns:
            names = sorted(glob.glob(pattern)) if set(pattern) & set("*?[") else [pattern]
            here = {os.path.basename(x) for x in names}
            for path in names:
                if os.path.isfile(path) and (path == pattern or not any(is_copy_of(os.path.basename(path), x) for x in here)):
                    found[path] = None
        return list(found)

    def place(self, path: str) -> dict | None:
        """Where a file ends now: behind its last complete line."""
        try:
            with open(path, "rb") as raw:
                facts = os.fstat(raw.fileno())
                _, first, _, end, _, _ = plain_facts(raw, None, True)
                end = self._end(raw, end)
                old = self.last.get(path)
                known = old is not None and (old["ino"], old["dev"], old["first"]) == (facts.st_ino, facts.st_dev, first) and old["offset"] <= end and before(raw, old["offset"]) == old["anchor"]
                low, line = (old["offset"], old["line"]) if known else (0, 0)
                raw.seek(low)
                left = end - low
                while left > 0 and (chunk := read_some(raw, min(CHUNK, left))):
                    line, left = line + chunk.count(b"\n"), left - len(chunk)
                return {"ino": facts.st_ino, "dev": facts.st_dev, "offset": end, "line": line, "first": first, "anchor": before(raw, end), "modified": micros(facts)}
        except OSError:
            return None

    @staticmethod
    def _end(raw, end: int) -> int:
        """Back to a line's end, where ``end`` is inside a long line."""
        while end > 0:
            low = max(0, end - CHUNK)
            raw.seek(low)
            if (found := raw.read(end - low).rfind(b"\n")) >= 0:
                return low + found + 1
            end = low
        return 0

    def latest(self) -> dict:
        now = {p: x for p in self.paths() if (x := self.place(p)) is not None}
        for path, old in self.last.items():
            if path not in now and not os.path.exists(path):  # away: the last of its copies stands for it
                newest = next((p for p, *_ in reversed(chain(path, old)) if not opener_of(p)), None)
                now[path] = (self.place(newest) if newest else None) or old
        self.last = now
        return now

    def initialOffset(self) -> dict:
        return self.latest() if self.begin == "end" else {}

    def latestOffset(self) -> dict:
        return self.latest()

    def partitions(self, start: dict, end: dict) -> Sequence[Stretch]:
        out = []
        for path in sorted(start.keys() | end.keys()):
            old, new = start.get(path), end.get(path)
            seg, same = 0, False
            if old is not None:
                same = new is not None and (old["ino"], old["dev"]) == (new["ino"], new["dev"]) and new["offset"] >= old["offset"] and (old["first"] is None or old["first"] == new["first"])
                same = same and (new["offset"] == old["offset"] or self._anchored(path, old, new))
                if not same:
                    for copy, facts, holder in chain(path, old):
                        if new is not None and (facts.st_ino, facts.st_dev) == (new["ino"], new["dev"]):
                            continue
                        at, line = (old["offset"], old["line"]) if holder else (0, 0)
                        out.append(Stretch(path, copy, seg, at, line, self.history if at else 0, ino=facts.st_ino, dev=facts.st_dev))
                        seg += 1
            if new is not None:
                at, line = (old["offset"], old["line"]) if same else (0, 0)
                if new["offset"] > at:
                    out.append(Stretch(path, path, seg, at, line, self.history if at else 0, stop=new["offset"], ino=new["ino"], dev=new["dev"]))
        return out or [Stretch("", "")]

    def _anchored(self, path: str, old: dict, new: dict) -> bool:
        where = moved(path, new["ino"], new["dev"])
        if where is None:
            return True
        with open(where, "rb") as raw:
            return before(raw, old["offset"]) == old["anchor"]

    def read(self, partition: Stretch) -> Iterator[tuple]:
        if not partition.path:
            return
        path = moved(partition.path, partition.ino, partition.dev)
        if path is None:
            raise RuntimeError(f"{partition.path} is no longer there under any name; the batch is to be planned again")
        for row in stretch(replace(partition, path=path)):
            if row[10] is None:
                yield row[:10]
            elif (why := json.loads(row[10])["why"]) not in ("ok", "none", "damaged"):
                raise RuntimeError(f"{path} is {why}; the batch is to be planned again")

    def commit(self, end: dict) -> None:
        pass


def moved(path: str, ino: int | None, dev: int | None) -> str | None:
    """The name that a file of this identity has now in its folder, its own first."""
    names = [path]
    folder = os.path.dirname(path)
    if os.path.isdir(folder):
        names += sorted(e.path for e in os.scandir(folder) if e.inode() == ino)
    for name in names:
        try:
            facts = os.stat(name)
        except OSError:
            continue
        if (facts.st_ino, facts.st_dev) == (ino, dev):
            return name
    return None


class Follow(DataSource):
    @classmethod
    def name(cls) -> str:
        return "follow"

    def schema(self) -> str:
        return SCHEMA.removesuffix(", state string")

    def streamReader(self, schema) -> DataSourceStreamReader:
        return FollowReader(self.options)


def followed(spark, files: Sequence[str], begin: str = "end", history: int = 0):
    """The stream of lines of these files."""
    spark.dataSource.register(Follow)
    return spark.readStream.format("follow").option("files", json.dumps(list(files))).option("begin", begin).option("history", str(history)).load()
