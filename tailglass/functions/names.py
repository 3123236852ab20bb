"""Names of log files and of their rotated copies; column expressions, so a listing of any length stays in Spark."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

# What tools that rotate, compress and copy logs call their files.
COMPRESSED = r"(?i)\.(gz|bz2|xz|zst)$"
COPY_SUFFIXES = (".bak", ".old", ".orig", ".save", "-old", "-bak")
NUMERIC = r"^\.[0-9]{1,4}$"
EPOCH = r"^[.-][0-9]{9,10}$"
#: Year, month and day, and what may follow.
DATED = r"^(-[0-9]{8}([0-9]{2})?(-[0-9]{9,10})?|-[0-9]{14}|-[0-9]{4}-[0-9]{2}-[0-9]{2}|\.[0-9]{4}-[0-9]{2}-[0-9]{2}(_[0-9]{2}-[0-9]{2}-[0-9]{2})?|\.[0-9]{8}(T[0-9]{6})?)$"
STAMPED = r"^-[0-9]{8,10}-([0-9]{9,10})$"
#: A name's own extension: from its last dot, if something but dots stands before it.
EXTENSION = r"^.*[^.].*?(\.[^.]*)$"


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body(value)`` with the value computed once, however often the body names it: plans stay small."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def is_glob(path: Column) -> Column:
    return path.rlike(r"[*?\[]")


def _class(body: str, negated: bool) -> str:
    """A bracket's characters as a class of Java's engine; never the separator."""
    parts, i = [], 0
    while i < len(body):
        first = last = body[i]
        if i + 2 < len(body) and body[i + 1] == "-":
            last = body[i + 2]
            i += 2
        i += 1
        if first <= last:
            parts.append(f"\\x{{{ord(first):x}}}-\\x{{{ord(last):x}}}")
    if not parts:
        return "[^/]" if negated else r"(?!)"
    return f"(?!/)[{'^' if negated else ''}{''.join(parts)}]"


def component_to_regex(part: str) -> str:
    """One component of a shell pattern, for Java's engine and Python's alike but for how code points are written."""
    out, i = ["" if part[:1] not in ("*", "?", "[") else r"(?!\.)"], 0
    while i < len(part):
        c, i = part[i], i + 1
        if c == "*":
            out.append("[^/]*")
        elif c == "?":
            out.append("[^/]")
        elif c == "[" and (end := part.find("]", i + 1 + (part[i : i + 1] == "!"))) >= 0:
            negated = part[i] == "!"
            out.append(_class(part[i + negated : end], negated))
            i = end + 1
        else:
            out.append(f"\\x{{{ord(c):x}}}")
    return "".join(out)


def glob_to_regex(pattern: str) -> str:
    """A shell pattern of a path as a regular expression: ``*``, ``?`` and brackets stay within a component, and a hidden name needs its dot."""
    return "^" + "/".join(map(component_to_regex, pattern.split("/"))) + r"\z"


def compressed_suffix(name: Column) -> Column:
    """The compression suffix in lower case, or an empty string."""
    return F.lower(F.regexp_extract(name, COMPRESSED, 0))


def base_name(path: Column) -> Column:
    return F.substring_index(path, "/", -1)


def directory(path: Column) -> Column:
    return F.regexp_replace(path, "/[^/]*$", "")


def _moment(seconds: Column) -> Column:
    """Year to second of an epoch in UTC, and the epoch."""

    def fields(s: Column) -> Column:
        day, rest = F.date_add(F.lit("1970-01-01").cast("date"), F.floor(s / 86400).cast("int")), s % 86400
        return F.array(*(x.cast("long") for x in (F.year(day), F.month(day), F.day(day), F.floor(rest / 3600), F.floor(rest % 3600 / 60), rest % 60, s)))

    return let(seconds, fields)


def _written(digits: Column) -> Column:
    """Year to second of fourteen digits and a zero, or null if that is no date and time from 1970 on."""

    def checked(key: Column) -> Column:
        day = F.try_to_date(F.substring(digits, 1, 8), "yyyyMMdd").isNotNull() & (key[0] >= 1970)
        return F.when(day & (key[3] < 24) & (key[4] < 60) & (key[5] < 60), key)

    places = ((1, 4), (5, 2), (7, 2), (9, 2), (11, 2), (13, 2))
    return let(F.array(*(F.substring(digits, at, n).try_cast("long") for at, n in places), F.lit(0).cast("long")), checked)


def rotation(rest: Column) -> Column:
    """What follows a log's name: struct(style, key), or null where it is no numeric or dated suffix.

    A larger key is newer within a style.  A date may carry an epoch, which then gives the time of day; ten digits
    that are no date are an epoch."""

    def dated(x: Column) -> Column:
        stamp = F.regexp_extract(x, STAMPED, 1)
        day = F.rpad(F.regexp_replace(F.when(stamp != "", F.regexp_replace(x, "-[0-9]+$", "")).otherwise(x), "[^0-9]", ""), 14, "0")
        with_stamp = lambda key: F.when(stamp != "", F.concat(F.slice(key, 1, 3), F.slice(_moment(stamp.try_cast("long")), 4, 4))).otherwise(key)
        return F.when(x.rlike(DATED), let(let(day, _written), lambda key: F.when(key.isNotNull(), with_stamp(key))))

    def found(x: Column) -> Column:
        answer = lambda style, key: F.struct(F.lit(style).alias("style"), key.alias("key"))
        number = answer("numeric", F.array(-F.substring(x, 2, 4).try_cast("long")))
        epoch = F.when(x.rlike(EPOCH), _moment(F.substring(x, 2, 10).try_cast("long")))
        by_date = let(F.coalesce(dated(x), epoch), lambda key: F.when(key.isNotNull(), answer("dated", key)))
        return F.when(x.rlike(NUMERIC), number).otherwise(by_date)

    return let(rest, found)


def classify(name: Column, base: Column) -> Column:
    """``name`` as a rotated copy of ``base``: struct(style, key, suffix, compressed, ext_form), or null.

    The suffix is what stands behind the base, or between the base's stem and its extension (ext_form), once a
    compression is taken off.  It is empty or starts with a dot or a dash; one that is neither a number nor a
    date is of style "other" behind the base, and none of the base's between stem and extension."""
    none = F.array().cast("array<bigint>")

    def between(x: Column) -> Column:
        """(suffix, ext_form) for struct(plain, own, stem)."""
        plain, own, stem = x["plain"], x["own"], x["stem"]
        behind = F.struct(F.substring(plain, F.length(base) + 1, F.length(plain)).alias("suffix"), F.lit(False).alias("ext_form"))
        within = F.struct(F.substring(plain, F.length(stem) + 1, F.length(plain) - F.length(base)).alias("suffix"), F.lit(True).alias("ext_form"))
        fits = (own != "") & (F.length(plain) > F.length(base)) & F.startswith(plain, stem) & F.endswith(plain, own)
        return F.when(F.startswith(plain, base), behind).when(fits, within)

    def verdict(cut: Column) -> Column:
        fields = lambda style, key: F.struct(style.alias("style"), key.alias("key"), cut["suffix"].alias("suffix"), name.rlike(COMPRESSED).alias("compressed"), cut["ext_form"].alias("ext_form"))
        as_copy = lambda r: F.when(r.isNotNull(), fields(r["style"], r["key"])).when(~cut["ext_form"], fields(F.lit("other"), none))
        return F.when(cut["suffix"].rlike(r"^([.-]|$)"), let(rotation(cut["suffix"]), as_copy))

    own = F.regexp_extract(base, EXTENSION, 1)
    parts = F.struct(F.regexp_replace(name, COMPRESSED, "").alias("plain"), own.alias("own"), F.substring(base, F.lit(1), F.length(base) - F.length(own)).alias("stem"))
    return F.when(name != base, let(let(parts, between), verdict))


def archive_suffix(name: Column) -> Column:
    """The suffix that gives ``name`` the shape of a copy of some log, or null: rotated, hand-made or only compressed."""

    def found(plain: Column) -> Column:
        at = lambda i: F.substring(plain, i, F.lit(1))
        places = F.sequence(F.lit(2), F.greatest(F.length(plain), F.lit(2)))
        cuts = F.filter(places, lambda i: at(i).isin(".", "-") & ~at(i - 1).rlike("[0-9]") & rotation(F.substring(plain, i, F.length(plain))).isNotNull())
        by_hand = F.coalesce(*(F.when(F.endswith(plain, F.lit(s)) & (F.length(plain) > len(s)), F.lit(s)) for s in COPY_SUFFIXES))
        rotated = let(F.get(cuts, F.lit(0)), lambda i: F.substring(plain, i, F.length(plain)))
        packed = F.regexp_extract(name, COMPRESSED, 0)
        return F.coalesce(rotated, by_hand, F.when((packed != "") & (plain != ""), packed))

    return let(F.regexp_replace(name, COMPRESSED, ""), found)


def kin_bases(name: Column) -> Column:
    """Every log that a file of this name could have been cut from: each beginning that a dot or dash follows, and the same with the name's extension behind it."""
    own = F.regexp_extract(name, EXTENSION, 1)
    cuts = F.filter(F.sequence(F.lit(2), F.greatest(F.length(name), F.lit(2))), lambda i: F.substring(name, i, F.lit(1)).isin(".", "-"))
    before = lambda i: F.substring(name, F.lit(1), i - 1)

    def bases(at: Column) -> Column:
        with_own = F.transform(F.filter(at, lambda i: (own != "") & (i - 1 < F.length(name) - F.length(own))), lambda i: F.concat(before(i), own))
        return F.array_distinct(F.concat(F.transform(at, before), with_own))

    return let(cuts, bases)
