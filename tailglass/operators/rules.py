"""Watches: what to look for in lines, what to leave out, and how to report it."""

from __future__ import annotations

import re
from dataclasses import dataclass, field, replace

RANK = {"low": 1, "medium": 2, "high": 3}
# Fixed value: a priority in brackets before a pattern's text.
TAG = re.compile(r"^\[(high|medium|low)\] (.+)$", re.S)
NESTED = re.compile(r"\([^()]*[*+][^()]*\)[*+{]")
#: A regular expression that Java's engine reads as Python's: literals, plain classes, single quantifiers.
PLAIN = re.compile(r"^\^?(?:(?:[A-Za-z0-9 _:,;@#%=<>!~\"'/-]|\\[.\[\](){}*+?^$|\\]|\[\^?[A-Za-z0-9 _.,:;-]+\])(?:[*+?]|\{\d+(?:,\d+)?\})?)*$")


@dataclass(frozen=True)
class Pattern:
    """A literal, or a regular expression as Python's ``re`` reads it."""

    text: str
    regex: bool = False
    ignore_case: bool = False
    priority: str | None = None

    def __post_init__(self):
        if not self.text:
            raise ValueError("a pattern must not be empty")
        if self.priority is not None and self.priority not in RANK:
            raise ValueError(f"priority must be one of {', '.join(RANK)}: {self.priority}")
        if self.regex:
            re.compile(self.text)

    @property
    def in_jvm(self) -> bool:
        """Whether built-in functions give what Python's ``re`` gives."""
        return not self.regex or not self.ignore_case and bool(PLAIN.match(self.text))

    @property
    def nested(self) -> bool:
        """Whether a repeated group holds a repetition: such a search may take time without bound."""
        return self.regex and bool(NESTED.search(self.text))


def tagged(text: str, **kind: bool) -> Pattern:
    """A pattern whose text may start with a priority tag such as ``[high] ``."""
    found = TAG.match(text)
    return Pattern(found[2].strip(), priority=found[1], **kind) if found else Pattern(text, **kind)


@dataclass(frozen=True)
class Watch:
    name: str
    patterns: tuple[Pattern, ...]
    excludes: tuple[Pattern, ...] = ()
    priority: str | None = None
    context: int = 0
    max_lines: int = 200
    report_bytes: int = 1 << 20
    files: tuple[str, ...] = field(default=())

    def __post_init__(self):
        if not self.patterns:
            raise ValueError(f"[{self.name}] needs at least one pattern")
        if self.max_lines < 1 or self.context < 0:
            raise ValueError(f"[{self.name}] max_lines must be 1 or more and context 0 or more")
        if self.priority is not None and self.priority not in RANK:
            raise ValueError(f"[{self.name}] priority must be one of {', '.join(RANK)}")

    @classmethod
    def of(cls, name: str, *, patterns=(), ipatterns=(), regex=(), iregex=(), exclude=(), iexclude=(), exclude_regex=(), iexclude_regex=(), **more) -> Watch:
        """From lists of texts, one for each shape; patterns are tried in this order of the lists."""
        shapes = ({}, {"ignore_case": True}, {"regex": True}, {"regex": True, "ignore_case": True})
        made = tuple(tagged(t, **kind) for kind, texts in zip(shapes, (patterns, ipatterns, regex, iregex), strict=True) for t in texts)
        left = tuple(Pattern(t, **kind) for kind, texts in zip(shapes, (exclude, iexclude, exclude_regex, iexclude_regex), strict=True) for t in texts)
        return cls(name, made, left, **more)

    def with_context(self, n: int) -> Watch:
        return replace(self, context=n)
