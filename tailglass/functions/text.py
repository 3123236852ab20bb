"""Text as it may travel in a report, a header or a file name; all built-in column functions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: C0 controls but TAB, LF and CR (which is dropped), DEL, and C1 controls but NEL.
CONTROLS = r"[\x00-\x08\x0B\x0C\x0E-\x1F\x7F-\x84\x86-\x9F]"
#: The characters of both parts are fixed values; a domain begins and ends with a letter or digit, no address with a dash.
ADDRESS = r"\A(?!-)[A-Za-z0-9!#$%&'*+/=?^_`{|}~.-]+@(?![.-])[A-Za-z0-9.-]*[A-Za-z0-9]\z"


def clean_text(text: Column) -> Column:
    """Valid UTF-8 without CR; every control but TAB and line ends is U+FFFD.  Null stays null."""
    return F.regexp_replace(F.regexp_replace(F.make_valid_utf8(text), "\r", ""), CONTROLS, "\ufffd")


def clean_header(text: Column) -> Column:
    """As ``clean_text``, with TAB and every line end as a space, and no white space around."""
    return F.trim(F.regexp_replace(clean_text(text), "[\t\n\u0085\u2028\u2029]", " "))


def attachment_name(section: Column, now: Column) -> Column:
    """A plain file name for a watch and a minute: other characters become one underscore, and at most 40 characters of the watch stay."""
    stem = F.substring(F.regexp_replace(F.regexp_replace(section, "[^A-Za-z0-9._-]+", "_"), "^[-.]+", ""), 1, 40)
    return F.concat(F.when(stem == "", "section").otherwise(stem), F.lit("-"), F.date_format(now, "yyyyMMdd'T'HHmm"), F.lit(".txt"))


def is_address(text: Column) -> Column:
    """ASCII, a dot-atom, '@' and a domain; no leading '-'."""
    return text.rlike(ADDRESS)


def fingerprint(text: Column, cap: int = 4096) -> Column:
    """SHA-256 of the first line with its end, NULs before it left out, or null if no line ends within ``cap`` bytes."""
    line = F.concat(F.regexp_replace(F.substring_index(text, "\n", 1), r"\A\x00+", ""), F.lit("\n"))
    return F.when(F.contains(text, F.lit("\n")) & (F.octet_length(line) <= cap), F.sha2(line, 256))


def anchor(text: Column, offset: Column, cap: int = 4096) -> Column:
    """SHA-256 of the last ``cap`` bytes before ``offset`` (in bytes)."""
    data = F.encode(text, "UTF-8")
    start = F.greatest(offset - cap, F.lit(0))
    return F.sha2(F.substring(data, (start + 1).cast("int"), (offset - start).cast("int")), 256)


def newlines(text: Column) -> Column:
    """Line ends in a text."""
    return (F.octet_length(text) - F.octet_length(F.replace(text, F.lit("\n"), F.lit("")))).cast("long")


def timestamp(moment: Column) -> Column:
    """ISO 8601 in whole seconds, marked as UTC."""
    return F.date_format(moment, "yyyy-MM-dd'T'HH:mm:ss'Z'")


def parse_timestamp(text: Column) -> Column:
    """The moment that ``timestamp`` wrote, or null."""
    return F.try_to_timestamp(text, F.lit("yyyy-MM-dd'T'HH:mm:ss'Z'")).cast("timestamp_ntz")
