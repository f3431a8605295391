"""Labelled pages, made by rule: the training set of the page model. Each page comes with the label of each of its blocks."""

from __future__ import annotations

import random

# Names that page authors give to the parts of a page, by kind of part.
WRAPPERS = ("wrapper", "container", "page", "site", "row", "layout", "inner", "main-wrap", "grid", "app", "root", "columns")
MAIN = ("content", "main", "article", "post", "entry", "entry-content", "post-body", "story", "article-body", "text", "main-content", "article-content", "hentry", "body-text", "prose")
BOILER = {
    "nav": ("nav", "menu", "navbar", "navigation", "topnav", "main-menu", "breadcrumb", "breadcrumbs", "pagination", "pager", "toc", "tabs", "links", "skip-link"),
    "header": ("header", "masthead", "site-header", "topbar", "branding", "logo", "banner-top", "head", "page-header"),
    "footer": ("footer", "site-footer", "copyright", "colophon", "bottom", "foot", "legal", "credits", "page-footer"),
    "aside": ("sidebar", "side", "widget", "related", "aside", "recommended", "rail", "trending", "popular", "more-stories", "see-also", "tags", "author-box"),
    "ad": ("ad", "ads", "advert", "advertisement", "sponsored", "promo", "banner", "adsense", "sponsor", "ad-slot", "promotion", "commercial"),
    "notice": ("notice", "cookie", "consent", "alert", "gdpr", "paywall", "popup", "modal", "disclaimer", "cookie-banner", "notification", "overlay", "toast"),
    "share": ("share", "social", "sharing", "follow", "share-buttons", "social-links", "toolbar"),
    "form": ("form", "newsletter", "subscribe", "search", "login", "signup", "search-form", "contact-form", "subscription"),
    "comments": ("comments", "comment", "comment-list", "disqus", "respond", "replies", "discussion", "reader-comments", "comment-body", "reviews"),
}
TAGS = {"nav": ("nav", "nav", "div", "ul"), "header": ("header", "div"), "footer": ("footer", "footer", "div"), "aside": ("aside", "aside", "div"), "ad": ("div", "div", "aside", "section"), "notice": ("div", "div", "aside", "section", "dialog"), "share": ("div", "ul"), "form": ("form", "form", "div"), "comments": ("section", "div", "div")}


class Page:
    """Builds one page; blocks lists (text, is content) in page order."""

    def __init__(self, seed: int):
        self.r = random.Random(seed)
        self.html: list[str] = []
        self.blocks: list[tuple[str, bool]] = []

    def words(self, low: int, high: int) -> str:
        r = self.r
        text = " ".join("".join(r.choice("etaoinshrdlucm") for _ in range(r.randint(2, 8))) for _ in range(r.randint(low, high)))
        return text.capitalize() + r.choice((".", ".", ".", "", "!", "?", ":"))

    def named(self, names: tuple[str, ...]) -> str:
        r = self.r
        kind = r.choice(("class", "class", "class", "id", "role"))
        name = r.choice(names) + (f" {r.choice(('clearfix', 'box', 'block', 'wide', 'col-8'))}" if r.random() < 0.2 else "")
        return f' {kind}="{name}"'

    def block(self, tag: str, text: str, content: bool, inner: str = "", attrs: str = "") -> None:
        self.html.append(f"<{tag}{attrs}>{inner or text}</{tag}>")
        self.blocks.append((text, content))

    def link_list(self, low: int, high: int) -> None:
        self.html.append("<ul>")
        for _ in range(self.r.randint(low, high)):
            text = self.words(1, 4)
            self.block("li", text, False, f'<a href="/x">{text}</a>')
        self.html.append("</ul>")

    def boiler(self, kind: str) -> None:
        r = self.r
        tag = r.choice(TAGS[kind])
        attrs = self.named(BOILER[kind]) if tag in ("div", "section", "ul") or r.random() < 0.4 else ""
        self.html.append(f"<{tag}{attrs}>")
        if tag == "ul":
            for _ in range(r.randint(2, 7)):
                text = self.words(1, 3)
                self.block("li", text, False, f'<a href="/x">{text}</a>')
        elif kind in ("nav", "share"):
            self.link_list(2, 8)
        elif kind == "comments":
            for _ in range(r.randint(1, 5)):
                inner = r.random() < 0.5
                if inner:
                    self.html.append(f"<div{self.named(BOILER['comments'])}>")
                self.block(r.choice(("p", "div", "li")), self.words(3, 60), False)
                if inner:
                    self.html.append("</div>")
        elif kind == "form":
            self.block(r.choice(("p", "h4", "div")), self.words(1, 12), False)
            self.html.append('<input name="q">')
            self.block("button", self.words(1, 2), False)
        else:
            for _ in range(r.randint(1, 3)):
                if r.random() < 0.3:
                    self.link_list(1, 5)
                self.block(r.choice(("p", "div", "h3", "p")), self.words(1, 30), False)
        self.html.append(f"</{tag}>")

    def article(self) -> None:
        r = self.r
        shell = r.choice((("article", ""), ("article", ""), ("main", ""), ("div", None), ("section", None), ("td", None)))
        tag, attrs = shell[0], self.named(MAIN) if r.random() < (0.75 if shell[1] is None else 0.3) else ""
        self.html.append(f"<{tag}{attrs}>")
        if r.random() < 0.15:
            self.html.append("<header>")
            self.block("h1", self.words(2, 10), True)
            self.html.append("</header>")
        elif r.random() < 0.8:
            self.block("h1", self.words(1, 12), True)
        inner = r.random() < 0.3
        if inner:
            self.html.append(f"<div{self.named(MAIN)}>")
        for _ in range(r.randint(1, 14)):
            x = r.random()
            if x < 0.7:
                self.block("p", self.words(1, r.choice((3, 20, 90))), True)
            elif x < 0.78:
                self.block(r.choice(("h2", "h3")), self.words(1, 8), True)
            elif x < 0.84:
                self.block(r.choice(("blockquote", "pre", "div", "figcaption")), self.words(2, 30), True)
            elif x < 0.9:
                self.html.append(r.choice(("<ul>", "<ol>")))
                for _ in range(r.randint(1, 5)):
                    self.block("li", self.words(1, 20), True)
                self.html.append("</ul>")
            elif x < 0.93:
                self.html.append("<table><tr>")
                for _ in range(r.randint(1, 4)):
                    self.block("td", self.words(1, 5), True)
                self.html.append("</tr></table>")
            elif x < 0.95:
                self.block("button", self.words(1, 4), False)
            else:
                self.boiler(r.choice(("ad", "share", "form", "notice", "aside")))
        if inner:
            self.html.append("</div>")
        if r.random() < 0.25:
            self.boiler("comments")
        self.html.append(f"</{tag}>")

    def build(self) -> Page:
        r = self.r
        self.html.append("<!DOCTYPE html><html><head><title>x</title></head><body>")
        depth = r.randint(0, 2)
        for kind in ("notice", "header", "nav", "ad"):
            if r.random() < {"header": 0.5, "nav": 0.7}.get(kind, 0.3):
                self.boiler(kind)
        self.html += [f"<div{self.named(WRAPPERS)}>"] * depth
        for kind in ("nav", "aside", "ad"):
            if r.random() < 0.3:
                self.boiler(kind)
        self.article()
        for kind in ("aside", "comments", "share", "form", "nav"):
            if r.random() < 0.35:
                self.boiler(kind)
        self.html += ["</div>"] * depth
        for kind in ("footer", "notice"):
            if r.random() < {"footer": 0.8}.get(kind, 0.2):
                self.boiler(kind)
        self.html.append("</body></html>")
        return self


def labelled_pages(n: int = 600, seed: int = 0) -> list[tuple[str, list[tuple[str, bool]]]]:
    """n pages as (html, [(text of a block, is content)])."""
    pages = [Page(seed * 1_000_003 + i).build() for i in range(n)]
    return [("".join(p.html), p.blocks) for p in pages]
