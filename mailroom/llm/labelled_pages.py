"""Labelled pages to train the main-text extractor on.

``labelled(n)`` writes ``n`` pages of many layouts from a seed. Every element that
holds main text carries ``data-y="1"``, every one that frames it ``data-y="0"``;
elements without the mark take their parent's. The extractor reads the mark as
label only, never as a feature.
"""

from __future__ import annotations

import random

_SYLLABLES = ["an", "be", "co", "da", "er", "fi", "go", "he", "in", "ka", "le", "mo", "nu", "or", "pe", "qui", "ra", "st", "tion", "va"]
# Names that layouts give to frames and to main parts (fixed values, by role).
FRAMES = {
    "nav": ["nav", "menu", "main-nav", "navbar", "breadcrumb", "breadcrumbs", "top-menu", "pagination", "nav-links"],
    "head": ["header", "site-header", "masthead", "topbar", "page-header", "branding", "logo"],
    "foot": ["footer", "site-footer", "page-footer", "copyright", "bottom", "legal", "colophon"],
    "side": ["sidebar", "side", "aside", "widget", "widget-area", "related", "related-posts", "recommended", "tags", "popular", "toc"],
    "notice": ["notice", "cookie", "cookie-notice", "cookie-banner", "consent", "alert", "gdpr", "popup", "modal", "overlay", "subscribe", "newsletter", "banner"],
    "ad": ["ad", "ads", "advert", "advertisement", "sponsored", "promo", "adsbygoogle", "ad-slot", "promoted"],
    "share": ["share", "social", "share-buttons", "sharing", "follow", "byline-share"],
    "comments": ["comments", "comment", "comment-list", "commentlist", "discussion", "replies", "disqus", "responses", "reader-comments"],
}
MAINS = ["content", "post", "article", "entry", "entry-content", "post-content", "article-body", "story", "main", "main-content", "post-body", "text", "body-text"]


class _Writer:
    def __init__(self, seed: int):
        self.r = random.Random(seed)

    def word(self) -> str:
        return "".join(self.r.choices(_SYLLABLES, k=self.r.randint(1, 4)))

    def sentence(self, low: int = 4, high: int = 18) -> str:
        words = [self.word() for _ in range(self.r.randint(low, high))]
        text = " ".join(w + ("," if self.r.random() < 0.08 else "") for w in words)
        return text[:1].upper() + text[1:] + self.r.choice(["."] * 8 + ["?", "!"])

    def prose(self, low: int = 1, high: int = 7) -> str:
        return " ".join(self.sentence() for _ in range(self.r.randint(low, high)))

    def name(self, kind: str) -> str:
        key = self.r.choice(["class", "class", "id"])
        return f'{key}="{self.r.choice(FRAMES[kind])}"'

    def links(self, low: int = 3, high: int = 9) -> str:
        items = [f'<a href="/{self.word()}">{self.word()}{" " + self.word() if self.r.random() < 0.3 else ""}</a>' for _ in range(self.r.randint(low, high))]
        if self.r.random() < 0.7:
            return "<ul>" + "".join(f"<li>{x}</li>" for x in items) + "</ul>"
        return " | ".join(items)

    def frame(self, kind: str) -> str:
        r, y = self.r, 'data-y="0"'
        if kind == "nav":
            tag = r.choice(["nav", "nav", "div"])
            return f'<{tag} {y} {self.name("nav") if tag == "div" or r.random() < 0.5 else ""}>{self.links()}</{tag}>'
        if kind == "head":
            tag = r.choice(["header", "header", "div"])
            inner = f"<h1>{self.word()}</h1>" if r.random() < 0.3 else f'<a href="/">{self.word()}</a>'
            return f'<{tag} {y} {self.name("head") if tag == "div" or r.random() < 0.5 else ""}>{inner}{"<p>" + self.sentence(2, 6) + "</p>" if r.random() < 0.5 else ""}{self.frame("nav") if r.random() < 0.4 else ""}</{tag}>'
        if kind == "foot":
            tag = r.choice(["footer", "footer", "div"])
            return f'<{tag} {y} {self.name("foot") if tag == "div" or r.random() < 0.4 else ""}>{r.choice(["&copy; ", "", "&#169; 2024 "])}{self.word()}.example &middot; {self.prose(1, 2)}{self.links(1, 4) if r.random() < 0.4 else ""}</{tag}>'
        if kind == "side":
            tag = r.choice(["aside", "aside", "div", "section"])
            body = r.choice([self.links(3, 6), f"<p>{self.prose(1, 3)}</p>", self.prose(1, 2)])
            return f'<{tag} {y} {self.name("side") if tag != "aside" or r.random() < 0.5 else ""}><h3>{self.word()}</h3>{body}</{tag}>'
        if kind == "form":
            return f'<form {y} action="/s"><label>{self.sentence(1, 4)}</label><input type="text"><select><option>{self.word()}</option><option>{self.word()}</option></select><button>{self.word()}</button>{"<p>" + self.sentence() + "</p>" if r.random() < 0.4 else ""}</form>'
        if kind == "comments":
            tag = r.choice(["section", "div", "ol", "ul"])
            item = "li" if tag in ("ol", "ul") else r.choice(["div", "article", "p"])
            own = self.name("comments") if item in ("li", "p") or r.random() < 0.5 else self.name("comments")
            each = "".join(f'<{item} {r.choice(["", "class=comment"])}>{r.choice(["", f"<b>{self.word()}</b> "])}{self.prose(1, 4) if item in ("p", "li") else f"<p>{self.prose(1, 4)}</p>"}</{item}>' for _ in range(r.randint(1, 5)))
            return f"<{tag} {y} {own}>{'<h3>' + self.word() + '</h3>' if tag in ('section', 'div') else ''}{each}</{tag}>"
        tag = r.choice(["div", "div", "section", "aside", "p"])
        body = self.prose(1, 3) if tag == "p" or r.random() < 0.5 else f"<p>{self.prose(1, 2)}</p>"
        if kind == "share":
            tag, body = "div", self.links(2, 5)
        return f"<{tag} {y} {self.name(kind)}>{body}</{tag}>"

    def block(self) -> str:
        r, k = self.r, self.r.random()
        text = self.prose()
        if r.random() < 0.3:
            at = text.find(" ", len(text) // 2)
            mark = r.choice(["b", "em", "strong", "a href=/x", "i", "code", "span"])
            text = f"{text[:at]} <{mark}>{text[at + 1:]}</{mark.split()[0]}>" if at > 0 else text
        if k < 0.66:
            return f"<p>{text}</p>" if r.random() < 0.8 else f"<p>{text}"
        if k < 0.72:
            return f"<h2>{self.sentence(1, 6)}</h2><p>{text}</p>"
        if k < 0.78:
            return f"<blockquote><p>{text}</p></blockquote>" if r.random() < 0.5 else f"<blockquote>{text}</blockquote>"
        if k < 0.86:
            tag = r.choice(["ul", "ol"])
            return f"<{tag}>" + "".join(f"<li>{self.sentence(2, 14)}</li>" for _ in range(r.randint(2, 5))) + f"</{tag}>"
        if k < 0.90:
            return "<table>" + "".join(f"<tr><td>{self.sentence(1, 4)}</td><td>{self.word()}</td></tr>" for _ in range(r.randint(2, 4))) + "</table>"
        if k < 0.93:
            return f"<figure><img src=x><figcaption>{self.sentence()}</figcaption></figure>"
        if k < 0.96:
            return f"<pre>{self.sentence()}</pre>"
        return f"<div>{text}</div>"

    def page(self) -> str:
        r = self.r
        inner = [self.block() for _ in range(r.randint(1, 9))]
        for kind in ("ad", "share", "side", "form", "notice"):
            if r.random() < 0.15:
                inner.insert(r.randint(0, len(inner)), self.frame(kind))
        title = self.sentence(2, 12)
        head = f"<h1>{title}</h1>" if r.random() < 0.8 else f"<header><h1>{title}</h1></header>" if r.random() < 0.5 else ""
        if r.random() < 0.25:
            inner.append(self.frame("comments"))
        tag = r.choice(["article", "article", "article", "main", "div", "section"])
        named = f'{r.choice(["class", "id"])}="{r.choice(MAINS)}"' if tag in ("div", "section") or r.random() < 0.3 else ""
        main = f'<{tag} data-y="1" {named}>{head}{"".join(inner)}</{tag}>'
        if r.random() < 0.3:
            outer, side = r.choice(["div", "main", "div class=container", "div class=wrapper", "div id=page"]), ""
            if r.random() < 0.5:
                side = self.frame(r.choice(["side", "ad", "comments"]))
            main = f"<{outer}>{main}{side}</{outer.split()[0]}>"
        before = [self.frame(k) for k in ("head", "nav", "notice", "ad", "form") if r.random() < 0.45]
        after = [self.frame(k) for k in ("comments", "side", "share", "ad", "form", "foot", "foot", "notice") if r.random() < 0.3]
        r.shuffle(before)
        return (f'<!DOCTYPE html><html data-y="0"><head><title>{title}</title><style>p{{margin:0}}</style><script>var t="</p>";</script></head>'
                f"<body>{''.join(before)}{main}{''.join(after)}" + r.choice(["</body></html>", "</body></html>", ""]))


def labelled(n: int, seed: int = 11) -> list[str]:
    return [_Writer(seed * 100_003 + i).page() for i in range(n)]
