"""HTML pages as leaf blocks: the text between block-level tags, with the path of elements around it."""

from __future__ import annotations

import html
import re
from collections import Counter
from dataclasses import dataclass

#: Element names by kind (fixed values, HTML).
BLOCKS = frozenset(
    "address article aside blockquote body button canvas caption center dd details dialog dir div dl dt fieldset figcaption figure footer form"
    " frameset h1 h2 h3 h4 h5 h6 head header hgroup hr html legend li main menu nav ol optgroup option p pre search section select summary table"
    " tbody td textarea tfoot th thead title tr ul video audio iframe".split()
)
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
#: Their content is no text of the page.
RAW = frozenset("script style noscript template svg iframe noembed noframes xmp".split())
#: Of these, the ones whose content goes on to the end of the page where no end tag follows, as in a browser.
TO_THE_END = frozenset("script style iframe noembed noframes xmp".split())
#: A start tag of these ends an open p.
ENDS_P = BLOCKS - frozenset("body button head html option optgroup title td th tr tbody thead tfoot caption".split())
#: A start tag ends an open element of these, up to one of those.
ENDS = {
    "li": (frozenset(["li"]), frozenset(["ul", "ol", "menu", "dir"])),
    "dt": (frozenset(["dt", "dd"]), frozenset(["dl"])),
    "dd": (frozenset(["dt", "dd"]), frozenset(["dl"])),
    "option": (frozenset(["option"]), frozenset(["select"])),
    "tr": (frozenset(["tr", "td", "th"]), frozenset(["table"])),
    "td": (frozenset(["td", "th"]), frozenset(["tr", "table"])),
    "th": (frozenset(["td", "th"]), frozenset(["tr", "table"])),
    "body": (frozenset(["head", "title"]), frozenset()),
}
NAME = re.compile(r"[a-zA-Z][^\s/>]*")
#: One attribute; what stands after "=" is quoted only if it begins with a quote.
NEXT = re.compile(r"""[\s/]*(?:[^\s/>][^\s/>=]*)(?:\s*=\s*(?:"[^"]*"|'[^']*'|[^\s>]+))?""")
#: Elements at either end of a deeper path that a block is described by.
DEPTH = 100
SPACE = re.compile(r"[\s/]*")
SVG = re.compile(r"<(/?)svg(?=[\s/>])(?:[^>]*?)(/?)>", re.I)
# Fixed value: tags of the page that end a drawing.
BREAKS_OUT = re.compile(
    r"<(?:/p|/br|b|big|blockquote|body|br|center|code|dd|div|dl|dt|em|embed|h[1-6]|head|hr|i|img|li|listing|menu|meta|nobr|ol|p|pre|ruby|s|small|span|strong|strike|sub|sup|table|tt|u|ul|var)(?=[\s/>])", re.I
)
ATTRIBUTE = re.compile(r"""\b(class|id|role|hidden|aria-hidden|aria-label|style)\b(?:\s*=\s*("[^"]*"|'[^']*'|[^\s>]+))?""", re.I)
PART = re.compile(r"[a-z]+")


@dataclass
class Block:
    text: str
    #: (tag, words of class, id and role) from the outermost element in.
    path: tuple[tuple[str, tuple[str, ...]], ...]
    linked: int
    marked: int


def words_of(attributes: str) -> tuple[str, ...]:
    if not attributes or attributes.isspace():
        return ()
    out: list[str] = []
    for name, value in ATTRIBUTE.findall(attributes):
        name, value = name.lower(), value.strip("\"'").lower()
        if name == "hidden" or name == "aria-hidden" and value == "true" or name == "style" and "display:none" in value.replace(" ", ""):
            out.append("hidden")
        elif name in ("class", "id", "role"):
            out += PART.findall(value)
    return tuple(dict.fromkeys(out))


class Tags:
    """The tags of a page, one after the other; each character is looked at a bounded number of times."""

    def __init__(self, page: str):
        self.page, self.last, self.quotes, self.ends = page, page.rfind(">"), True, {}
        #: Where the next --!> is (None: there is none more), and where each drawing ends, once either is asked for.
        self.bang: int | None = -1
        self.drawings: dict[int, int] | None = None

    def close(self, at: int) -> tuple[int, bool]:
        """Where the start tag whose name ends at ``at`` has its ">" (-1: it has none), and whether a "/" of its own stands before."""
        page, end = self.page, self.page.find(">", at) if at <= self.last else -1
        if end < 0 or not self.quotes or '"' not in (inside := page[at:end]) and "'" not in inside and "=" not in inside:
            return end, end > 0 and page[end - 1] == "/" and end > at
        while at < len(page):
            space = SPACE.match(page, at).end()
            if space < len(page) and page[space] == ">":
                return space, space > at and page[space - 1] == "/"
            if space == len(page):
                break
            at = NEXT.match(page, at).end()
        self.quotes = False  # a quote is open to the end of the page: from here on the next ">" ends a tag
        return end, False

    def after(self, tag: str, at: int) -> tuple[int, int]:
        """Where the next end tag of a kind begins and ends, or (-1, -1)."""
        if self.ends.get(tag) == -1:
            return -1, -1
        found = re.compile(rf"</{re.escape(tag)}(?=[\s/>])[^>]*>", re.I).search(self.page, at)
        self.ends[tag] = found.end() if found else -1
        return found.span() if found else (-1, -1)


    def comment(self, at: int) -> int:
        """The place behind the comment that begins at ``at``: it ends with --> or --!>, or at once."""
        end = self.page.find("-->", at + 2)
        if self.bang is not None and self.bang < at + 4:
            found = self.page.find("--!>", at + 4)
            self.bang = found if found >= 0 else None
        if self.bang is not None and (end < 0 or self.bang < end):
            return self.bang + 4
        return len(self.page) if end < 0 else max(end + 3, at + 5)

    def drawing(self, at: int) -> int:
        """The place behind the end tag of the svg element whose start tag ends at ``at``, or -1."""
        if self.drawings is None:
            self.drawings, open_ = {}, []
            for tag in SVG.finditer(self.page):
                if not tag[1] and not tag[2]:
                    open_.append(tag.end())
                elif tag[1] and open_:
                    self.drawings[open_.pop()] = tag.end()
        return self.drawings.get(at, -1)


def blocks(page: str | None) -> list[Block]:
    """The leaf blocks with text, in page order; white space is one space, character references are decoded."""
    out: list[Block] = []
    stack: list[tuple[str, tuple[str, ...]]] = []
    parts: list[str] = []
    open_: Counter[str] = Counter()
    linked = marked = links = marks = 0
    page = page or ""

    def flush() -> None:
        nonlocal linked, marked
        if parts:
            text = " ".join("".join(parts).split())
            if text:
                around = stack if len(stack) <= 2 * DEPTH else stack[:DEPTH] + stack[-DEPTH:]
                out.append(Block(text, tuple(x for x in around if x[0] in BLOCKS), linked, marked))
            parts.clear()
        linked = marked = 0

    def leave(depth: int) -> None:
        nonlocal links, marks
        for tag, _ in stack[depth:]:
            open_[tag] -= 1
            links -= tag == "a"
            marks -= tag in ("b", "strong")
        del stack[depth:]

    def ended(names: frozenset, until: frozenset) -> None:
        if not any(open_[x] for x in names):
            return
        for depth in range(len(stack) - 1, -1, -1):
            if stack[depth][0] in until:
                return
            if stack[depth][0] in names:
                leave(depth)
                return

    def add(raw: str) -> None:
        nonlocal linked, marked
        raw = html.unescape(raw) if "&" in raw else raw
        parts.append(raw)
        linked += len(raw) if links > 0 else 0
        marked += len(raw) if marks > 0 else 0

    tags, at, size = Tags(page), 0, len(page)
    while at < size:
        if page[at] != "<":
            end = page.find("<", at)
            end = size if end < 0 else end
            add(page[at:end])
            at = end
            continue
        ahead = page[at + 1 : at + 2]
        if ahead in ("!", "?"):
            if page.startswith("<!--", at):
                at = tags.comment(at)
            else:
                end = page.find(">", at)
                at = size if end < 0 else end + 1
            continue
        closing = ahead == "/"
        name = NAME.match(page, at + 1 + closing)
        if name is None and closing and at + 2 <= tags.last:  # no tag, and no text
            at = page.find(">", at + 2) + 1
            continue
        end, bare = tags.close(name.end()) if name else (-1, False)
        if end < 0:
            add("<")
            at += 1
            continue
        tag, attributes = name[0].lower(), page[name.end() : end]
        at = end + 1
        if closing:
            if tag in BLOCKS:
                flush()
            elif tag == "br":
                parts.append(" ")
            for depth in range(len(stack) - 1, -1, -1) if open_[tag] else ():
                if stack[depth][0] == tag:
                    leave(depth)
                    break
                if tag not in BLOCKS and stack[depth][0] in BLOCKS:  # an inline end tag ends nothing outside its block
                    break
            continue
        if tag in RAW:
            if tag == "iframe":
                flush()
            if tag == "svg":
                if not bare and (end := tags.drawing(at)) >= 0:
                    at = end
                elif not bare:  # it never ends: the next element that no drawing holds ends it
                    out_of_it = BREAKS_OUT.search(page, at)
                    at = out_of_it.start() if out_of_it else size
            else:
                _, end = tags.after(tag, at)
                at = end if end >= 0 else size if tag in TO_THE_END and not bare else at
            continue
        if tag in BLOCKS:
            flush()
            if tag in ENDS_P:
                ended(frozenset(["p"]), frozenset(["td", "th", "button", "table", "caption"]))
            if tag in ENDS:
                ended(*ENDS[tag])
        elif tag in VOID and tag in ("br", "img", "wbr", "input"):
            parts.append("" if tag == "wbr" else " ")
        if tag not in VOID and not bare:
            stack.append((tag, words_of(attributes)))
            open_[tag] += 1
            links += tag == "a"
            marks += tag in ("b", "strong")
        if tag in ("textarea", "title") and not bare:  # text without tags
            begin, _ = tags.after(tag, at)
            if begin >= 0:
                add(page[at:begin])
                at = begin
    flush()
    return out
