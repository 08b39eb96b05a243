"""Training pages for the HTML extractor: made by rule from a seed, with the main text marked.

Layouts, tag choices, attribute names, nesting, sloppy markup and the amounts of text vary, so that no
single tag or name gives the main text away: articles carry names that boilerplate has, hold headers,
notes, tables, captions and one-word headings, and some pages are bare paragraphs.
"""

from __future__ import annotations

import random

_SYLLABLES = "ka lo mi ter an en ra shu do pel ist or vin ga te us".split()
_MAIN = ["article", "content", "main", "post", "entry", "story", "post-body", "article-text", "page-content", "text"]
_SIDE = ["sidebar", "side", "widget", "related", "aside-box", "rail"]
_NAV = ["nav", "menu", "navbar", "topnav", "breadcrumbs", "links"]
_TOP = ["header", "masthead", "banner-top", "site-header", "logo"]
_END = ["footer", "foot", "site-footer", "copyright", "legal"]
_ADS = ["ad", "ads", "advert", "sponsored", "promo", "ad-slot", "banner"]
_NOTE = ["cookie", "notice", "consent", "popup", "alert", "gdpr", "newsletter", "subscribe"]
_SHARE = ["share", "sharing", "share-buttons", "social", "social-links", "tags", "pagination", "pager", "toolbar", "meta-links"]
_BOX = ["note", "info", "tip", "remark", "callout", "box", "summary", "abstract", "lead", "highlight", "important"]
_SAID = ["comments", "comment", "discussion", "replies", "responses", "reader-comments"]
MARK = "data-main"


class PageMaker:
    """Pages with ``data-main`` on the elements of the main text."""

    def __init__(self, seed: int):
        self.r = random.Random(seed)

    def word(self) -> str:
        return "".join(self.r.choice(_SYLLABLES) for _ in range(self.r.randint(1, 4)))

    def words(self, a: int, b: int) -> str:
        n = self.r.randint(a, b)
        text = " ".join(self.word() + (self.r.choice([",", ".", ".", "!!", "###"]) if self.r.random() < 0.12 else "") for _ in range(n))
        return text.capitalize() + self.r.choice([".", ".", "", "!"])

    def attr(self, names: list[str], sure: float = 0.85) -> str:
        if self.r.random() > sure:
            return f' class="{self.word()}"' if self.r.random() < 0.5 else ""
        name = self.r.choice(names)
        kind = self.r.choice(["class", "class", "id"])
        more = f" {self.word()}" if kind == "class" and self.r.random() < 0.4 else ""
        return f' {kind}="{name}{more}"'

    def links(self, n: int) -> str:
        kind = self.r.choice(["ul", "div", "p"])
        each = "li" if kind == "ul" else "span"
        inside = "".join(f'<{each}><a href="/{self.word()}">{self.words(1, 3)}</a></{each}> ' for _ in range(n))
        return f"<{kind}>{inside}</{kind}>"

    def boilerplate(self, inside: bool = False) -> str:
        r = self.r
        kind = r.choice(["nav", "top", "end", "side", "ad", "ad", "note", "said", "form", "share"] if not inside else ["ad", "side", "said", "note", "form", "nav", "share"])
        text = f"<p>{self.words(3, 40)}</p>" if r.random() < 0.5 else self.words(2, 30)
        if kind == "nav":
            tag = r.choice(["nav", "nav", "div", "ul"])
            return f"<{tag}{self.attr(_NAV)}>{self.links(r.randint(2, 12))}</{tag}>"
        if kind == "top":
            tag = r.choice(["header", "div"])
            return f"<{tag}{self.attr(_TOP)}><h1>{self.words(1, 4)}</h1>{self.links(r.randint(0, 6)) if r.random() < 0.6 else text}</{tag}>"
        if kind == "end":
            tag = r.choice(["footer", "footer", "div"])
            return f"<{tag}{self.attr(_END)}>&copy; {self.words(2, 20)}{self.links(r.randint(1, 6)) if r.random() < 0.4 else ''}</{tag}>"
        if kind == "side":
            tag = r.choice(["aside", "aside", "div", "section"])
            return f"<{tag}{self.attr(_SIDE)}><h3>{self.words(1, 4)}</h3>{self.links(r.randint(2, 8)) if r.random() < 0.6 else text}</{tag}>"
        if kind == "ad":
            tag = r.choice(["div", "div", "section", "aside", "p"])
            return f"<{tag}{self.attr(_ADS, 1.0)}>{text if tag != 'p' else self.words(2, 30)}</{tag}>"
        if kind == "share":
            tag = r.choice(["ul", "ul", "div", "p"])
            each = "li" if tag == "ul" else "span"
            word = lambda: self.words(1, 2) if r.random() < 0.5 else f'<a href="/{self.word()}">{self.words(1, 2)}</a>'
            return f"<{tag}{self.attr(_SHARE, 1.0)}>" + "".join(f"<{each}>{word()}</{each}> " for _ in range(r.randint(1, 6))) + f"</{tag}>"
        if kind == "note" and r.random() < 0.15:
            return f"<noscript>{text}</noscript>"
        if kind == "note":
            tag = r.choice(["div", "section", "dialog"])
            return f"<{tag}{self.attr(_NOTE, 1.0)}>{text}<button>{self.words(1, 2)}</button></{tag}>"
        if kind == "said":
            tag = r.choice(["section", "div", "ol"])
            each = "li" if tag == "ol" else r.choice(["div", "article", "p"])
            one = "".join(f"<{each}{self.attr(['comment', 'reply', 'comment-body'])}>{self.words(3, 40)}</{each}>" for _ in range(r.randint(1, 6)))
            return f"<{tag}{self.attr(_SAID, 1.0)}><h3>{self.words(1, 3)}</h3>{one}</{tag}>"
        fields = "".join(f"<label>{self.words(1, 3)}</label><input name=a>" for _ in range(r.randint(1, 4)))
        if r.random() < 0.3:
            fields += "<select>" + "".join(f"<option>{self.words(1, 2)}" for _ in range(r.randint(2, 5))) + "</select>"
        return f"<form{self.attr(['search', 'login', 'form', 'signup'])}>{fields}<button>{self.words(1, 2)}</button></form>"

    def rows(self) -> str:
        """A table's rows, some with a caption or heads."""
        r, m = self.r, MARK
        wide = r.randint(1, 4)
        line = lambda tag: f"<tr {m}>" + "".join(f"<{tag} {m}>{self.words(1, 6)}</{tag}>" for _ in range(wide)) + "</tr>"
        body = "".join(line("td") for _ in range(r.randint(1, 6)))
        head = line("th") if r.random() < 0.5 else ""
        if r.random() < 0.4:
            head, body = f"<thead {m}>{head}</thead>" if head else "", f"<tbody {m}>{body}</tbody>"
        caption = f"<caption {m}>{self.words(1, 6)}</caption>" if r.random() < 0.3 else ""
        return f"<table{self.attr(['table', 'data', 'grid'], 0.3)} {m}>{caption}{head}{body}</table>"

    def paragraph(self) -> str:
        r = self.r
        inside = self.words(1, r.choice([1, 3, 30, 120, 200]))
        if r.random() < 0.15:
            inside = f"<b>{inside}" + ("</b>" if r.random() < 0.5 else "") + "<br>"
        if r.random() < 0.15:
            inside += f"<br>{self.words(1, 12)}"
        if r.random() < 0.2:
            inside += f' <a href="/{self.word()}">{self.words(1, 3)}</a> {self.words(2, 10)}'
        if r.random() < 0.05:
            inside += f" <math><mi>{self.word()}</mi></math> <video src=a.mp4>"
        return f"<p{self.attr(_BOX, 0.08)} {MARK}>{inside}" + ("</p>" if r.random() < 0.85 else "")

    def block(self, deep: int = 0) -> str:
        r, x, m = self.r, self.r.random(), MARK
        if x < 0.5:
            return self.paragraph()
        if x < 0.64:
            tag = r.choice(["h1", "h2", "h2", "h3", "h4"])
            return f"<{tag} {m}>{self.words(1, r.choice([1, 3, 8]))}</{tag}>"
        if x < 0.72:
            tag = r.choice(["ul", "ol"])
            return f"<{tag} {m}>" + "".join(f"<li {m}>{self.words(1, 20)}</li>" for _ in range(r.randint(1, 6))) + f"</{tag}>"
        if x < 0.77:
            inside = self.words(5, 60) if r.random() < 0.5 else f"<p {m}>{self.words(5, 60)}</p>"
            return f"<blockquote {m}>{inside}</blockquote>"
        if x < 0.81:
            return f"<div {m}>{self.words(3, 80)}</div>"
        if x < 0.87:
            inside = self.words(1, 30) if r.random() < 0.5 else f"<p {m}>{self.words(1, 30)}</p>"
            tag = r.choice(["div", "div", "section"])
            return f"<{tag}{self.attr(_BOX, 1.0)} {m}>{inside}</{tag}>"
        if x < 0.91:
            return self.rows()
        if x < 0.94:
            return f"<figure {m}><img src=a.png><figcaption {m}>{self.words(1, 15)}</figcaption></figure>"
        if x < 0.96:
            items = "".join(f"<dt {m}>{self.words(1, 3)}</dt><dd {m}>{self.words(1, 20)}</dd>" for _ in range(r.randint(1, 4)))
            return f"<dl {m}>{items}</dl>"
        if x < 0.97 or deep:
            return f"<pre {m}>{self.words(1, 20)}</pre>"
        inside = "".join(self.block(1) for _ in range(r.randint(1, 4)))
        tag = r.choice(["section", "section", "div", "details"])
        title = "summary" if tag == "details" else r.choice(["h2", "h3"])
        return f"<{tag} {m}><{title} {m}>{self.words(1, 4)}</{title}>{inside}</{tag}>"

    def title(self, inside: bool) -> str:
        r, m = self.r, MARK
        if r.random() > 0.75:
            return ""
        line = f"<h1 {m}>{self.words(1, r.choice([1, 10, 10]))}</h1>"
        if inside and r.random() < 0.25:
            more = f"<p {m}>{self.words(1, 20)}</p>" if r.random() < 0.4 else ""
            return f"<header{self.attr(['entry-header', 'title', 'header'], 0.3)} {m}>{line}{more}</header>"
        return line

    def page(self) -> str:
        r = self.r
        inside = [self.block() for _ in range(r.choice([1, 1, 2, 3, 3, 5, 8, 14, 20]))]
        shape = r.random()
        if shape < 0.04:  # nothing but blocks
            bare = "".join(inside)
            return bare if r.random() < 0.7 else f"<html {MARK}><body {MARK}>{bare}</body></html>"
        for _ in range(r.choice([0, 0, 0, 1, 2])):
            inside.insert(r.randint(0, len(inside)), self.boilerplate(inside=True))
        tag = r.choice(["article", "article", "article", "main", "div", "section"])
        if tag in ("article", "main"):
            anything = _SIDE + _TOP + _END + _NOTE + _ADS + _SAID + _BOX
            attr = self.attr(_MAIN, 0.3) if r.random() < 0.75 else self.attr(anything, 1.0)
        else:
            attr = self.attr(_MAIN, 0.8)
        main = f"<{tag}{attr} {MARK}>{self.title(tag in ('article', 'main'))}{''.join(inside)}</{tag}>"
        if shape < 0.08:  # an article alone
            return main
        for _ in range(r.choice([0, 0, 1, 2])):
            wrap = r.choice(["div", "main", "section"])
            extra = self.boilerplate() if r.random() < 0.3 else ""
            main = f"<{wrap}{self.attr(['wrapper', 'container', 'row', 'page'], 0.7)} {MARK}>{main}{extra}</{wrap}>"
        if shape < 0.13:  # paragraphs straight in the body
            main = f"{self.title(False)}{''.join(self.block() for _ in range(r.randint(2, 12)))}"
        before = [self.boilerplate() for _ in range(r.randint(0, 4))]
        after = [self.boilerplate() for _ in range(r.randint(0, 4))]
        head = f"<head><title>{self.words(2, 8)}</title><style>p{{margin:0}}</style><script>var t='<p>';</script></head>"
        tail = "</body></html>" if r.random() < 0.85 else ""
        return f"<!DOCTYPE html><html {MARK}>{head}<body {MARK}>{''.join(before)}<!-- {self.word()} -->{main}{''.join(after)}{tail}"
