"""Labelled pages to train the block labeller on: random layouts out of the parts that web pages are made of.

The parts' names are those in common use for containers; the words are invented, so nothing can be learned
from the language, only from places, tags, names and the shape of texts."""

from __future__ import annotations

import random

from .page_blocks import blocks

LABELS = ("main", "chrome", "notice", "comment")
CHARS = "aeiourstlnmdkpbvghäéñçøцяжд"


class Maker:
    def __init__(self, seed: int):
        self.rng = random.Random(seed)
        self.truth: list[tuple[str, str]] = []

    def word(self) -> str:
        return "".join(self.rng.choices(CHARS[: self.rng.choice([18, 22, 27])], k=self.rng.randint(1, 10)))

    def sentence(self, low: int, high: int, end: str = ".") -> str:
        words = [self.word() + ("," if self.rng.random() < 0.08 else "") for _ in range(self.rng.randint(low, high))]
        if self.rng.random() < 0.1:
            words.insert(self.rng.randrange(len(words)), str(self.rng.randint(1, 2030)))
        if self.rng.random() < 0.04:
            words = [w + self.rng.choice(["%", "***", "###", "$", "|"]) for w in words]
        return " ".join(words).capitalize() + end

    def say(self, label: str, text: str) -> str:
        """Text of a block, with the label it must get."""
        self.truth.append((label, text))
        text = text.replace("&", "&amp;").replace("<", "&lt;")
        if self.rng.random() < 0.15 and " " in text:
            a, b = text.split(" ", 1)
            text = f"<{(t := self.rng.choice(['b', 'em', 'span', 'i']))}>{a}</{t}> {b}"
        return text

    def pick(self, *names: str) -> str:
        return self.rng.choice(names)

    def paragraph(self, label: str) -> str:
        n = self.rng.choice([1, 1, 2, 3, 5, 8])
        text = " ".join(self.sentence(1, 16, self.pick(".", ".", ".", "?", "!", ":")) for _ in range(n))
        made = self.say(label, text)
        if self.rng.random() < 0.1:
            return f"<p><b>{made}<br>"  # as carelessly written pages have it
        if self.rng.random() < 0.1:
            return f'<p>{made[:-1]}<a href="/{self.word()}">{made[-1]}</a></p>' if not made.endswith((";", ">")) else f"<p>{made}</p>"
        return f"<p>{made}</p>" if self.rng.random() < 0.9 else f"<p>{made}"

    def menu(self, label: str = "chrome", n: int | None = None) -> str:
        items = "".join(f'<li><a href="/{self.word()}">{self.say(label, " ".join(self.word() for _ in range(self.rng.randint(1, 3))))}</a></li>' for _ in range(n or self.rng.randint(2, 8)))
        return f"<{(t := self.pick('ul', 'ul', 'ol'))}>{items}</{t}>"

    def box(self, tag: str, name: str, inside: str) -> str:
        extra = f' {self.pick("class", "class", "id")}="{name}"' if name else ""
        return f"<{tag}{extra}>{inside}</{tag}>"

    def short(self, label: str) -> str:
        text = self.sentence(2, 14, self.pick(".", "", "!"))
        return self.say(label, text) if self.rng.random() < 0.5 else f"<p>{self.say(label, text)}</p>"

    def nav(self) -> str:
        tag, name = self.rng.choice([("nav", ""), ("nav", "menu"), ("div", "nav"), ("div", "navbar"), ("div", "menu"), ("div", "breadcrumb"), ("ul", "nav-links"), ("div", "main-menu"), ("nav", "navigation")])
        if tag == "ul":
            return f'<ul class="{name}">' + self.menu()[4:-5] + "</ul>"
        return self.box(tag, name, self.menu())

    def header(self) -> str:
        tag, name = self.rng.choice([("header", ""), ("div", "header"), ("header", "site-header"), ("div", "masthead"), ("div", "top-bar")])
        inside = f"<{(t := self.pick('h1', 'div', 'p', 'a'))}>{self.say('chrome', self.sentence(1, 4, ''))}</{t}>"
        return self.box(tag, name, inside + (self.nav() if self.rng.random() < 0.5 else "") + (self.box("p", "tagline", self.say("chrome", self.sentence(3, 8, self.pick(".", "")))) if self.rng.random() < 0.4 else ""))

    def footer(self) -> str:
        tag, name = self.rng.choice([("footer", ""), ("footer", ""), ("div", "footer"), ("footer", "site-footer"), ("div", "copyright"), ("div", "bottom")])
        text = self.pick("© ", "© 2024 ", "") + self.word() + self.pick(".example.org · ", " ", " | ") + self.sentence(2, 14, self.pick(".", ""))
        inside = self.say("chrome", text)
        return self.box(tag, name, (inside if self.rng.random() < 0.6 else f"<p>{inside}</p>") + (self.menu() if self.rng.random() < 0.3 else ""))

    def side(self) -> str:
        tag, name = self.rng.choice([("aside", ""), ("aside", "sidebar"), ("div", "sidebar"), ("div", "related"), ("div", "widget"), ("section", "related-posts"), ("div", "tags"), ("div", "share"), ("div", "social-links"), ("div", "author-box"), ("div", "right-column")])
        head = f"<h3>{self.say('chrome', self.sentence(1, 4, ''))}</h3>" if self.rng.random() < 0.6 else ""
        return self.box(tag, name, head + (self.menu() if self.rng.random() < 0.5 else f"<p>{self.say('chrome', self.sentence(3, 25))}</p>"))

    def notice(self) -> str:
        tag, name = self.rng.choice(
            [("div", "ad"), ("div", "ads"), ("div", "advert"), ("div", "advertisement"), ("div", "banner"), ("div", "sponsored"), ("div", "promo"), ("div", "ad-slot"), ("aside", "ad"), ("div", "adbox"), ("ins", "adsbygoogle ad")]
            + [("div", "cookie"), ("div", "cookie-notice"), ("div", "cookie-banner"), ("div", "consent"), ("div", "notice"), ("div", "alert"), ("div", "newsletter"), ("div", "subscribe"), ("div", "popup"), ("div", "modal"), ("div", "gdpr"), ("section", "newsletter-signup"), ("div", "paywall")]
        )
        tag = "div" if tag == "ins" else tag
        inside = self.short("notice") + (f"<button>{self.say('notice', self.word().capitalize())}</button>" if self.rng.random() < 0.3 else "")
        return self.box(tag, name, inside)

    def form(self) -> str:
        label = f"<label>{self.say('notice', self.sentence(1, 4, self.pick('', ':')))}</label>" if self.rng.random() < 0.7 else ""
        options = "<select>" + "".join(f"<option>{self.say('notice', self.word())}</option>" for _ in range(2)) + "</select>" if self.rng.random() < 0.2 else ""
        button = f"<button>{self.say('notice', self.word().capitalize())}</button>" if self.rng.random() < 0.7 else ""
        name = self.pick("", "search", "login", "contact", "subscribe-form")
        return self.box("form", name, label + '<input type="text">' + options + button)

    def comments(self) -> str:
        tag, name = self.rng.choice([("section", "comments"), ("div", "comments"), ("div", "comment-list"), ("ol", "commentlist"), ("div", "disqus_thread"), ("div", "responses"), ("section", "reader-comments"), ("div", "replies")])
        inner = "li" if tag == "ol" else self.pick("div", "article", "p")
        each = self.pick("comment", "comment-body", "reply", "comment")
        head = f"<h3>{self.say('comment', self.sentence(1, 3, ''))}</h3>" if self.rng.random() < 0.5 and tag != "ol" else ""
        body = "".join(self.box(inner, each, (f"<p>{self.say('comment', self.sentence(3, 30))}</p>" if inner != "p" else self.say("comment", self.sentence(3, 30)))) for _ in range(self.rng.randint(1, 5)))
        return self.box(tag, name, head + body + (self.form() if self.rng.random() < 0.3 else ""))

    def article(self) -> str:
        tag, name = self.rng.choice([("article", "")] * 5 + [("main", ""), ("div", "content"), ("div", "article"), ("div", "post"), ("div", "entry-content"), ("div", "article-body"), ("section", "post-content"), ("div", "main"), ("div", "text"), ("div", "story"), ("article", "post"), ("div", "")])
        inside = []
        if self.rng.random() < 0.8:
            inside.append(f"<{(t := self.pick('h1', 'h1', 'h1', 'h2'))}>{self.say('main', self.sentence(1, 12, self.pick('', '.')))}</{t}>")
            inside[-1] = f"<header>{inside[-1]}</header>" if self.rng.random() < 0.08 else inside[-1]
        for _ in range(self.rng.choice([1, 1, 2, 4, 8, 14])):
            kind = self.rng.random()
            if kind < 0.8:
                inside.append(self.paragraph("main"))
            elif kind < 0.86:
                inside.append(f"<h2>{self.say('main', self.sentence(1, 7, ''))}</h2>")
            elif kind < 0.9:
                inside.append("<ul>" + "".join(f"<li>{self.say('main', self.sentence(2, 12, self.pick('', '.')))}</li>" for _ in range(3)) + "</ul>")
            elif kind < 0.92:
                inside.append(f"<blockquote>{self.say('main', self.sentence(4, 20))}</blockquote>")
            elif kind < 0.94:
                inside.append("<table><tr>" + "".join(f"<td>{self.say('main', self.sentence(1, 4, ''))}</td>" for _ in range(3)) + "</tr></table>")
            elif kind < 0.98:
                inside.append(self.notice())
            else:
                inside.append(self.side())
        if self.rng.random() < 0.12:
            inside.append(self.rng.choice([self.comments, self.form, self.side, self.nav])())
        return self.box(tag, name, "".join(inside))


def page(seed: int) -> tuple[str, list[tuple[str, str]]]:
    """A page, and the label and text of each of its blocks in order."""
    m = Maker(seed)
    rng = m.rng
    if rng.random() < 0.03:  # no markup at all
        return m.say("main", " ".join(m.sentence(2, 20) for _ in range(rng.randint(1, 4)))), m.truth
    title = f"<title>{m.say('chrome', m.sentence(2, 9, ''))}</title>" if rng.random() < 0.9 else ""
    parts = ['<!DOCTYPE html><html><head><meta charset="utf-8">', title, "<style>p{margin:0}</style><script>var x='</p>';</script></head><body>"]
    if rng.random() < 0.03:  # hardly any markup
        parts += [m.paragraph("main") for _ in range(rng.randint(1, 4))]
    else:
        parts += [f() for f, share in ((m.notice, 0.2), (m.header, 0.4), (m.nav, 0.6), (m.form, 0.15), (m.notice, 0.5), (m.side, 0.15)) if rng.random() < share]
        parts.append(m.article())
        parts += [f() for f, share in ((m.notice, 0.25), (m.comments, 0.35), (m.side, 0.35), (m.form, 0.2), (m.nav, 0.1), (m.footer, 0.8), (m.notice, 0.1)) if rng.random() < share]
    parts.append("</body></html>" if rng.random() < 0.9 else "")
    return "\n".join(parts) if rng.random() < 0.3 else "".join(parts), m.truth


def labelled(n: int, seed: int = 1) -> list[tuple[list, list[int]]]:
    """Blocks and label numbers of ``n`` pages."""
    out = []
    for i in range(n):
        text, truth = page(seed * 1_000_003 + i)
        found = blocks(text)
        if found and [b.text for b in found] == [" ".join(t.split()) for _, t in truth]:
            out.append((found, [LABELS.index(label) for label, _ in truth]))
    return out
