"""Labelled pages to fit a page model on: articles in many layouts, their content marked with ``data-content``.

Words are made up and layouts drawn at random from parts that web pages are made of, so a model learns structure and
not a site. The mark is on the outermost element that is or isn't content; it is no feature.
"""

from __future__ import annotations

import random

_SYLLABLES = "ba co du er fi ga hu il ka lo mi no or pe qu ra si te un ve".split()

# Names that pages give to the parts that aren't the article.
_MENU = ["nav", "menu", "navbar", "breadcrumb", "site nav", "main menu", "top links", "pagination", "toc"]
_HEADER = ["header", "site header", "masthead", "banner", "topbar", "logo brand"]
_FOOTER = ["footer", "site footer", "copyright", "bottom legal", "colophon"]
_SIDE = ["sidebar", "aside", "widget related", "related posts", "recommended", "trending", "popular", "tags", "share social", "author box", "newsletter signup"]
_NOTICE = ["notice", "cookie consent", "alert", "cookie banner", "gdpr popup", "modal overlay", "warning message"]
_AD = ["ad", "ads", "advert", "sponsored", "promo", "ad slot", "advertisement", "banner ad"]
_COMMENT = ["comments", "comment list", "comment", "reader comments", "discussion thread", "replies"]
_FORM = ["form", "search form", "login", "subscribe", "contact"]
_BODY = ["article", "content", "post", "entry content", "main", "story body", "post body", "article text", "page content", "text", ""]


class _Page:
    def __init__(self, rng: random.Random) -> None:
        self.r = rng
        # pages whose article is no good prose: repeated words, no punctuation, very long paragraphs
        self.odd = rng.random() < 0.3

    def word(self) -> str:
        return "".join(self.r.choice(_SYLLABLES) for _ in range(self.r.randint(1, 4)))

    def words(self, low: int, high: int) -> str:
        out = [self.word() for _ in range(self.r.randint(low, high))]
        if self.r.random() < 0.15:
            out = [w + self.r.choice(["###", "&amp;&amp;&amp;", "***", "%%%", "!!"]) for w in out]
        return " ".join(out)

    def sentence(self) -> str:
        return self.words(1, 18).capitalize() + self.r.choice([".", ".", ".", "!", "?", ",", ""])

    def prose(self, low: int = 1, high: int = 8) -> str:
        return " ".join(self.sentence() for _ in range(self.r.randint(low, high)))

    def odd_prose(self) -> str:
        r = self.r
        out: list[str] = []
        for _ in range(r.randint(1, 12)):
            out += [self.word() + r.choice(["", "", "", ".", ",", "!!", " |"])] * r.randint(1, r.choice([3, 12, 60]))
        text = " ".join(out)
        return text.upper() if r.random() < 0.2 else text

    def inline(self) -> str:
        if self.odd and self.r.random() < 0.8:
            return self.odd_prose() if self.r.random() < 0.6 else self.words(1, 4)
        text = self.prose()
        kind = self.r.random()
        if kind < 0.1:
            return f'{text} <a href="/{self.word()}">{self.words(1, 4)}</a> {self.prose(1, 3)}'
        if kind < 0.25:
            tag = self.r.choice(["b", "i", "em", "strong", "span", "code"])
            return f"<{tag}>{text}</{tag}> {self.prose(1, 2)}"
        if kind < 0.3:
            return f"<b>{text}<br>"
        if kind < 0.35:
            return f"{text}<br>{self.prose()}"
        return text

    def named(self, names: list[str], content: str, tags: list[str], mark: str = "0") -> str:
        tag, name = self.r.choice(tags), self.r.choice(names)
        given = self.r.choice([f' class="{name}"', f' id="{name.replace(" ", "-")}"', f' class="{name.replace(" ", "-")} {self.word()}"', "" if tag != "div" else f' class="{name}"'])
        return f'<{tag}{given} data-content="{mark}">{content}</{tag}>'

    def links(self, low: int = 2, high: int = 9) -> str:
        items = [f'<a href="/{self.word()}">{self.words(1, 3)}</a>' for _ in range(self.r.randint(low, high))]
        if self.r.random() < 0.7:
            return "<ul>" + "".join(f"<li>{x}</li>" for x in items) + "</ul>"
        return self.r.choice([" | ", " ", " &middot; "]).join(items)

    def outside(self, kind: str) -> str:
        r = self.r
        if kind == "menu":
            return self.named(_MENU, self.links(), ["nav", "nav", "div", "ul"])
        if kind == "header":
            return self.named(_HEADER, r.choice([f"<a href='/'>{self.words(1, 3)}</a>", f"<h2>{self.words(1, 4)}</h2><p>{self.words(2, 8)}</p>", self.links(1, 5)]), ["header", "header", "div"])
        if kind == "footer":
            return self.named(_FOOTER, r.choice([f"&copy; {self.words(1, 3)}.example.com &middot; {self.prose(1, 3)}", f"<p>{self.prose(1, 2)}</p>{self.links(1, 5)}"]), ["footer", "footer", "div"])
        if kind == "side":
            return self.named(_SIDE, r.choice([f"<h3>{self.words(1, 4)}</h3>{self.links()}", f"<p>{self.prose(1, 3)}</p>", f"<h4>{self.words(1, 3)}</h4><p>{self.prose(1, 4)}</p>{self.links(1, 3)}"]), ["aside", "aside", "div", "section"])
        if kind == "notice":
            return self.named(_NOTICE, r.choice([f"{self.prose(1, 3)} <button>{self.words(1, 2)}</button>", f"<p>{self.prose(1, 3)}</p>"]), ["div", "div", "section", "aside"])
        if kind == "ad":
            return self.named(_AD, r.choice([self.prose(1, 3), f"<p>{self.prose(1, 2)}</p>", f"<a href='/x'>{self.words(2, 9)}</a>"]), ["div", "div", "aside", "section"])
        if kind == "comment":
            one = lambda: f'<{(t := r.choice(["div", "li", "article", "p"]))} class="{r.choice(["comment", "reply", "comment body"])}"><b>{self.word()}</b> {r.choice(["", "<p>"])}{self.prose(1, 5)}</{t}>'
            return self.named(_COMMENT, f"<h3>{self.words(1, 2)}</h3>" * r.randint(0, 1) + "".join(one() for _ in range(r.randint(1, 6))), ["div", "section", "ol", "aside"])
        return self.named(_FORM, f"<label>{self.words(1, 3)}</label><input name='q'><p>{self.words(1, 9)}</p>" * r.randint(1, 2) + f"<button>{self.word()}</button>", ["form"])

    def article(self) -> str:
        r = self.r
        parts = [f"<h{r.randint(1, 2)}>{self.words(1, 12)}</h1>".replace("</h1>", "</h1>" if r.random() < 0.9 else "")] if r.random() < 0.9 else []
        parts = [p if "</h1>" not in p or p.startswith("<h1") else p.replace("</h1>", "</h2>") for p in parts]
        long = r.choice([3, 14, 14, 60])
        for _ in range(r.randint(1, long)):
            kind = r.random() * (1 if long < 60 else 0.75)
            if kind < 0.7:
                parts.append(f"<p>{self.inline()}" + ("</p>" if r.random() < 0.85 else ""))
            elif kind < 0.76:
                parts.append(f"<h{r.randint(2, 4)}>{self.words(1, 7)}</h2>".replace("</h2>", ""))
                level = parts[-1][2]
                parts[-1] += f"</h{level}>"
            elif kind < 0.82:
                parts.append("<ul>" + "".join(f"<li>{self.prose(1, 2)}</li>" for _ in range(r.randint(1, 6))) + "</ul>")
            elif kind < 0.86:
                parts.append(f"<blockquote>{self.prose()}</blockquote>")
            elif kind < 0.9:
                parts.append("<table>" + "".join(f"<tr><td>{self.words(1, 3)}</td><td>{self.words(1, 4)}</td></tr>" for _ in range(r.randint(1, 4))) + "</table>")
            elif kind < 0.93:
                parts.append(f"<pre>{self.words(3, 12)}</pre>")
            elif kind < 0.96:
                parts.append(f"<figure><img src='x.png'><figcaption>{self.prose(1, 2)}</figcaption></figure>")
            else:
                parts.append(f"<div>{self.prose()}</div>")
        if r.random() < 0.25:
            parts.insert(r.randint(0, len(parts)), self.outside(r.choice(["ad", "side", "notice", "form"])))
        inner = "".join(parts)
        tag = r.choice(["article", "article", "main", "div", "section"])
        name = r.choice(_BODY)
        given = f' class="{name}"' if name and r.random() < 0.6 else f' id="{name.replace(" ", "-")}"' if name and (tag == "div" or r.random() < 0.2) else ""
        out = f'<{tag}{given} data-content="1">{inner}' + (f"</{tag}>" if r.random() < 0.95 else "")
        for _ in range(r.randint(0, 2)):
            out = f'<{r.choice(["div", "main", "section"])} class="{r.choice(["wrapper", "container", "page", "row", "layout", "inner"])}">{out}</div>' if r.random() < 0.5 else out
        return out

    def html(self) -> str:
        r = self.r
        before = [self.outside(k) for k in ("menu", "header", "notice", "ad", "side") if r.random() < 0.5]
        after = [self.outside(k) for k in ("comment", "side", "ad", "form", "footer", "menu") if r.random() < 0.45]
        r.shuffle(before)
        head = f"<head><title>{self.words(1, 8)}</title><style>p{{margin:0}}</style><script>var t=1;</script></head>"
        return f'<!DOCTYPE html><html lang="en">{head}<body>{"".join(before)}<!-- {self.word()} -->{self.article()}{"".join(after)}' + "</body></html>" * (r.random() < 0.9)


def pages(n: int, seed: int) -> list[str]:
    """``n`` labelled pages; ``data-content`` is 1 on what is content and 0 on what isn't."""
    rng = random.Random(seed)
    return [_Page(rng).html() for _ in range(n)]
