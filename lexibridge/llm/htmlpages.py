"""Generated pages with known main text, for training and testing the block labeller."""

from __future__ import annotations

import random

#: Names that page layouts give to parts beside the main text, and to the main text.
ASIDE = {
    "nav": "nav menu navbar navigation breadcrumb breadcrumbs topnav links pagination toc".split(),
    "header": "header masthead topbar banner logo branding site-header page-header".split(),
    "footer": "footer bottom copyright legal colophon site-footer page-footer".split(),
    "side": "sidebar aside widget rail related recommended trending popular more tags".split(),
    "notice": "cookie consent notice alert popup modal gdpr warning banner message overlay".split(),
    "ad": "ad ads advert advertisement sponsor sponsored promo promotion adbox commercial".split(),
    "form": "form newsletter subscribe signup search login contact subscribe-box".split(),
    "comments": "comments comment reply replies discussion responses thread comment-list reader-comments".split(),
    "share": "share social sharing follow buttons tools".split(),
}
MAIN = "article content main post entry story body text post-content entry-content article-body main-content".split()


class _Page:
    def __init__(self, seed: int):
        self.r = random.Random(seed)
        r = self.r
        self.syllables = ["".join(r.choice("bcdfghjklmnprstvwzéüñß") + r.choice("aeiouyáèö") + r.choice(["", "n", "r", "s", "t"]) for _ in range(1)) for _ in range(60)]
        self.common = ["".join(r.choices(self.syllables, k=1)) for _ in range(20)]
        self.kept: list[str] = []
        self.style = r.choice(("plain", "plain", "plain", "junk", "caps", "cells", "bare", "repeat", "short"))
        self.count = 0

    def word(self) -> str:
        r = self.r
        return r.choice(self.common) if r.random() < 0.4 else "".join(r.choices(self.syllables, k=r.randint(1, 4)))

    def sentence(self, low: int = 4, high: int = 18, style: str = "plain") -> str:
        r = self.r
        words = [self.word() for _ in range(r.randint(low, high))]
        if style == "junk":
            words = [w + r.choice(("***", "%%%", "$$$", "###", "&amp;&amp;")) for w in words]
        if style == "caps":
            words = [w.upper() + "!!" for w in words]
        if style == "cells":
            return " | ".join(words) + r.choice((".", " |", ""))
        if style == "bare":
            return " ".join(words)
        if style == "repeat":
            return " ".join(w for w in words[:6] for _ in range(r.choice((2, 2, 7))))
        self.count += 1
        return " ".join(words).capitalize() + r.choice((".", ".", ".", "!", "?")) if style != "caps" else " ".join(words)

    def mixed(self) -> str:
        r = self.r
        n = r.choice((1, 1, 2, 3, 5, 8)) if self.style != "short" else 1
        style = self.style if r.random() < 0.7 else r.choice(("plain", "plain", "junk", "caps", "cells", "bare", "repeat"))
        low, high = r.choice(((1, 1), (1, 4), (4, 18), (4, 18), (4, 18)))
        return " ".join(self.sentence(low, high, style) for _ in range(n))

    def keep(self, text: str) -> str:
        from html import unescape

        self.kept.append(" ".join(unescape(text).split()))
        return text

    def name(self, kind: str) -> str:
        r = self.r
        names = ASIDE.get(kind, MAIN) if kind != "main" else MAIN
        value = r.choice(names)
        if r.random() < 0.15:
            value += " " + r.choice(("clearfix", "row", "col", "wrap", "box", "block", "inner"))
        return f' {r.choice(("class", "class", "id"))}="{value}"'

    def items(self, n: int) -> str:
        return "".join(f'<li><a href="/{i}">{" ".join(self.word() for _ in range(self.r.randint(1, 4)))}</a></li>' for i in range(n))

    def aside(self, kind: str) -> str:
        r = self.r
        semantic = {"nav": "nav", "header": "header", "footer": "footer", "side": "aside", "form": "form"}.get(kind)
        tag = semantic if semantic and r.random() < 0.6 else r.choice(("div", "div", "section"))
        attribute = self.name(kind) if tag in ("div", "section") or r.random() < 0.4 else ""
        if kind == "nav":
            inner = f"<ul>{self.items(r.randint(3, 9))}</ul>" if r.random() < 0.8 else " ".join(f'<a href="#">{self.word()}</a>' for _ in range(r.randint(3, 8)))
        elif kind == "header":
            inner = r.choice((f'<a href="/">{self.word()} {self.word()}</a>', f"<p>{self.sentence(2, 8)}</p>", f"<h1>{self.word()}</h1><p>{self.sentence(2, 6)}</p>", self.sentence(2, 8)))
        elif kind == "footer":
            inner = r.choice((f"&copy; {self.word()}.example.com &middot; {self.sentence(3, 9)}", f"<p>&copy; 2020 {self.word()}. {self.sentence(3, 9)}</p><ul>{self.items(3)}</ul>", f"<p>{self.sentence(4, 14)}</p>", f"<span>{self.sentence(3, 9)}</span>"))
        elif kind == "side":
            inner = r.choice((f"<h3>{self.sentence(1, 4)}</h3><ul>{self.items(r.randint(2, 7))}</ul>", f"<h2>{self.word()}</h2>" + "".join(f"<p>{self.sentence(4, 14)}</p>" for _ in range(r.randint(1, 3))), f"<p>{self.mixed()}</p>"))
        elif kind in ("notice", "ad"):
            inner = r.choice((self.sentence(3, 14), f"<p>{self.mixed()}</p>", self.mixed(), f"<p>{self.sentence(4, 16)}</p>", f'<p>{self.sentence(3, 12)}</p><button>{self.word()}</button>', f'<a href="/x">{self.sentence(2, 8)}</a>', f"<span>{self.sentence(3, 9)} {self.sentence(3, 9)}</span>"))
        elif kind == "form":
            inner = f'<label>{self.word()}</label><input type="text"><p>{self.sentence(3, 10)}</p><button>{self.word()}</button>' if r.random() < 0.7 else f"<select><option>{self.word()}<option>{self.word()}</select><p>{self.sentence(2, 9)}</p>"
        elif kind == "comments":
            head = f"<h3>{self.word()} {self.word()}</h3>" if r.random() < 0.6 else ""
            each = lambda: r.choice((f"<li><b>{self.word()}</b><p>{self.mixed()}</p></li>", f'<div class="comment"><span>{self.word()}</span><p>{self.mixed()}</p></div>', f"<p>{self.mixed()}</p>"))
            inner = head + "".join(each() for _ in range(r.randint(1, 5)))
        else:
            inner = " ".join(f'<a href="#">{self.word()}</a>' for _ in range(r.randint(2, 5)))
        return f"<{tag}{attribute}>{inner}</{tag}>"

    def part(self) -> str:
        r = self.r
        kind = r.random()
        if kind < 0.7:
            text = self.keep(self.mixed())
            words = text.split(" ")
            at = r.randrange(len(words))
            if r.random() < 0.2 and "&" not in words[at]:
                words[at] = r.choice((f"<b>{words[at]}</b>", f'<a href="/w">{words[at]}</a>', f"<em>{words[at]}</em>"))
            text = " ".join(words)
            return r.choice((f"<p>{text}</p>", f"<p>{text}</p>\n", f"<p>{text}", f"<p><b>{text}<br>", f"<div>{text}</div>"))
        if kind < 0.82:
            return f"<h{(n := r.choice((2, 2, 3)))}>{self.keep(self.sentence(1, 7))}</h{n}>"
        if kind < 0.9:
            return "<ul>" + "".join(f"<li>{self.keep(self.sentence(2, 12))}</li>" for _ in range(r.randint(2, 5))) + "</ul>"
        if kind < 0.95:
            return f"<blockquote>{self.keep(self.mixed())}</blockquote>"
        return "<table>" + "".join("<tr>" + "".join(f"<td>{self.keep(self.sentence(1, 3))}</td>" for _ in range(2)) + "</tr>" for _ in range(r.randint(1, 3))) + "</table>"

    def build(self) -> str:
        r = self.r
        before = [self.aside(k) for k in ("header", "nav", "notice", "ad", "side", "form", "nav", "share") if r.random() < 0.35]
        after = [self.aside(k) for k in ("share", "comments", "side", "ad", "form", "notice", "footer", "nav", "footer") if r.random() < 0.35]
        r.shuffle(before)
        body = [f"<h1>{self.keep(self.sentence(1, 9, self.style))}</h1>"] if r.random() < 0.85 else []
        body += [self.part() for _ in range(r.choice((0, 1, 1, 2, 3, 4, 5, 6, 8, 12, 20)))]
        for kind in ("ad", "share", "side", "notice", "form", "comments", "nav"):
            if len(body) > 1 and r.random() < 0.12:
                body.insert(r.randint(1, len(body)) if kind != "comments" else len(body), self.aside(kind))
        tag = r.choice(("article", "article", "main", "div", "div", "section"))
        attribute = self.name("main") if tag in ("div", "section") or r.random() < 0.25 else ""
        main = f"<{tag}{attribute}>{''.join(body)}</{tag}>"
        for _ in range(r.choice((0, 0, 1, 2))):
            main = r.choice((f"<main>{main}</main>", f'<div class="{r.choice(("container", "wrapper", "page", "row", "layout", "site"))}">{main}</div>', f"<div>{main}</div>"))
        head = f"<head><meta charset=utf-8><title>{self.sentence(2, 8)}</title><style>p{{margin:0}}</style><script>var t='</p>';</script></head>"
        page = f"<!DOCTYPE html><html>{head}<body>{''.join(before)}<!-- {self.word()} -->{main}{''.join(after)}</body></html>"
        return page.replace("><", ">\n<") if r.random() < 0.3 else page


def generate(seed: int) -> tuple[str, set[str]]:
    """A page and the texts of its main blocks; the same for the same seed."""
    page = _Page(seed)
    made = page.build()
    return made, set(page.kept)
