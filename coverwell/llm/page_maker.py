"""Labelled pages for training: invented layouts whose article blocks are known by construction."""

from __future__ import annotations

import random

#: Containers of the article, as (tag, attribute) pairs.
ARTICLE = [
    ("article", ""), ("article", 'class="post"'), ("main", ""), ("main", 'id="main"'), ("div", 'class="article-body"'),
    ("div", 'id="content"'), ("div", 'class="entry-content"'), ("div", 'class="post-content"'), ("section", 'class="story"'),
    ("div", 'class="content"'), ("div", 'itemprop="articleBody" class="text"'), ("article", 'id="article"'), ("div", 'class="story-body"'),
]
#: Everything around it: (tag, attribute, kind of filling).
AROUND = [
    ("nav", "", "links"), ("nav", 'class="menu"', "links"), ("div", 'class="menu"', "links"), ("ul", 'class="navigation"', "links"),
    ("div", 'id="nav"', "links"), ("div", 'class="breadcrumbs"', "links"), ("header", "", "short"), ("header", 'class="site-header"', "short"),
    ("div", 'id="header"', "short"), ("div", 'class="masthead"', "short"), ("footer", "", "short"), ("footer", 'class="site-footer"', "links"),
    ("div", 'id="footer"', "short"), ("div", 'class="footer"', "links"), ("aside", "", "mixed"), ("aside", 'class="sidebar"', "mixed"),
    ("div", 'class="sidebar"', "mixed"), ("div", 'id="sidebar"', "links"), ("div", 'class="widget"', "mixed"), ("div", 'class="ad"', "short"),
    ("div", 'class="ads"', "short"), ("div", 'class="advert"', "prose"), ("div", 'class="advertisement"', "short"), ("div", 'class="banner"', "short"),
    ("div", 'class="promo"', "prose"), ("div", 'class="sponsored"', "prose"), ("div", 'class="cookie-notice"', "prose"),
    ("div", 'id="cookie-banner"', "short"), ("div", 'class="notice"', "prose"), ("div", 'class="consent"', "prose"), ("div", 'role="alert"', "short"),
    ("form", "", "form"), ("form", 'class="newsletter"', "form"), ("div", 'class="subscribe"', "prose"), ("div", 'class="login"', "form"),
    ("div", 'class="search"', "form"), ("div", 'class="comments"', "prose"), ("section", 'id="comments"', "prose"), ("ol", 'class="comment-list"', "prose"),
    ("div", 'class="comment"', "prose"), ("section", 'class="responses comments"', "prose"), ("div", 'class="related"', "links"),
    ("section", 'class="related-posts"', "links"), ("div", 'class="share"', "links"), ("div", 'class="social"', "links"), ("div", 'class="tags"', "links"),
    ("div", 'class="popup"', "prose"), ("div", 'class="modal"', "prose"), ("div", 'class="disclaimer"', "prose"), ("div", 'class="toolbar"', "links"),
    *[("div", f'class="{c}"', "short") for c in "adbox adslot ad-slot google-ad ad-container topbar cookiebar gdpr alert-bar".split()],
    *[("div", f'class="{c}"', "links") for c in "navbar topnav mainmenu submenu trending recommended most-read outbrain see-also".split()],
    *[("div", f'class="{c}"', "prose") for c in "disqus reactions user-comments reader-comments feedback signup paywall teaser".split()],
    ("div", 'class="pagination"', "links"), ("div", 'class="copyright"', "short"), ("dialog", "", "prose"), ("section", 'class="discussion"', "prose"),
]
#: Parts that some sites put inside the article's own element.
INSIDE = [x for x in AROUND if x[0] in ("aside", "form", "footer", "nav") or any(
    w in x[1] for w in ("ad", "promo", "related", "share", "comment", "newsletter", "subscribe", "notice", "tags"))]
#: What readers' comments come in; the last ones say nothing.
COMMENTS = [
    'class="comments"', 'id="comments"', 'class="thread"', 'class="replies"', 'class="discussion"', 'class="responses"', 'id="disqus_thread"',
    'class="talk"', 'class="conversation"', 'class="feedback"', 'class="forum"', 'class="reader-opinions"', "", "", "",
]
PLAIN = ["", "", "", 'class="wrapper"', 'class="container"', 'id="page"', 'class="row"', 'class="col"', 'class="inner"']
SAID = {
    "links": "home about contact news sports business menu more next previous".split(),
    "form": "search subscribe email password login submit sign name".split(),
    "short": "copyright © (c) 2024 rights reserved privacy terms sponsored advertisement".split(),
    "prose": "cookies accept consent reply posted subscribe offer buy comment said".split(),
    "comments": "replies comments responses discussion opinions reactions".split(),
    "comment": "reply replied wrote said says posted ago likes agree thanks".split(),
}


class PageMaker:
    """Draws pages; ``page()`` gives the HTML and the article blocks' texts in order."""

    def __init__(self, seed: int):
        self.r = random.Random(seed)
        self.n = 0

    def word(self) -> str:
        return "".join(self.r.choice(self.letters) for _ in range(self.r.randint(1, 4)))

    def words(self, low: int, high: int, kind: str = "") -> str:
        ws = [self.word() for _ in range(self.r.randint(low, high))]
        if kind in SAID and self.r.random() < 0.5:
            ws[self.r.randrange(len(ws))] = self.r.choice(SAID[kind])
            if self.r.random() < 0.3:
                ws[self.r.randrange(len(ws))] = self.r.choice(SAID[kind])
        ws[0] = ws[0].capitalize()
        return " ".join(ws) + self.r.choice(["", ".", ".", "!"])

    def marked(self, text: str, keep: bool) -> str:
        """Gives a block's text a serial mark, by which its label is found again."""
        self.n += 1
        self.labels[self.n] = keep
        return f"{text} q{self.n}q"

    def dressed(self, attribute: str) -> str:
        """The attribute with another word on its class or id, as sites have them."""
        if '="' not in attribute or self.r.random() < 0.5:
            return attribute
        return attribute[:-1] + self.r.choice("- _") + self.r.choice("area wrap box list section container block inner main left top x1".split()) + '"'

    def around(self, tag: str, attribute: str, kind: str) -> str:
        inner = self.filling(kind)
        if self.r.random() < 0.35:
            level = self.r.randint(2, 4)
            inner = f"<h{level}>{self.marked(self.words(1, 4, kind), False)}</h{level}>" + inner
        if self.r.random() < 0.25:
            inner = self.wrap(self.r.choice(["div", "section", "ul", "article"]), self.r.choice(["", 'class="inner"', 'class="item"', 'class="body"', 'class="text"']), inner)
        return self.wrap(tag, self.dressed(attribute), inner)

    def wrap(self, tag: str, attribute: str, inner: str) -> str:
        return f"<{tag}{' ' * bool(attribute)}{attribute}>{inner}</{tag}>"

    def paragraph(self, keep: bool, low: int, high: int, kind: str = "") -> str:
        text = self.marked(self.words(low, high, kind), keep)
        if self.r.random() < 0.15:
            ws = text.split(" ")
            ws[0] = f'<a href="/x">{ws[0]}</a>'
            text = " ".join(ws)
        if self.by_div and (keep or self.r.random() < 0.6):
            return self.wrap("div", self.by_div.strip() if keep else "", text)
        if self.r.random() < 0.15:
            return f"<p><b>{text}<br>"  # left open, as pages often are
        return f"<p>{text}</p>" if self.r.random() < 0.9 else f"<p>{text}"

    def filling(self, kind: str) -> str:
        r = self.r
        if kind == "mixed":
            kind = r.choice(["links", "prose", "short"])
        if kind == "links":
            links = [f'<a href="/{i}">{self.marked(self.words(1, 4, kind), False)}</a>' for i in range(r.randint(1, 10))]
            return "<ul>" + "".join(f"<li>{x}</li>" for x in links) + "</ul>" if r.random() < 0.7 else "".join(f"<div>{x}</div>" for x in links)
        if kind == "form":
            return f"<label>{self.marked(self.words(1, 5, kind), False)}</label><input name=x>"
        if kind == "short":
            return self.marked(self.words(1, 12, kind), False)
        many = [self.paragraph(False, 4, 60, kind) for _ in range(r.randint(1, 5))]
        return "".join(many) if r.random() < 0.7 else "".join(f"<li>{p}</li>" for p in many)

    def comments(self) -> str:
        """Readers' comments under names that may say nothing: a heading with a count, then who, when, what and a link to answer."""
        r = self.r
        tag = r.choice(["div", "div", "section", "ol", "ul"])
        item = "li" if tag in ("ol", "ul") else r.choice(["div", "div", "article", "p"])
        name = r.choice(["", self.unknown(), 'class="item"', 'class="reply"', 'class="post"'])
        inner = ""
        if r.random() < 0.8:
            level = r.choice(["h2", "h3", "h4", "div", "p"])
            inner = f"<{level}>{self.marked(f'{r.randint(1, 99)} ' + r.choice(SAID['comments']), False)}</{level}>"
        for _ in range(r.randint(1, 6)):
            parts = []
            if r.random() < 0.7:
                parts.append(self.marked(f"{self.word().capitalize()} {r.choice(['wrote:', 'says:', f'{r.randint(1, 23)} hours ago', f'{r.randint(1, 9)} days ago', 'said', '•'])}", False))
            parts.append(self.marked(self.words(2, 40, "comment"), False))
            if r.random() < 0.5:
                parts.append(f'<a href="#">{self.marked(r.choice(["Reply", "Like Reply", "Report", "Quote"]), False)}</a>')
            inner += self.wrap(item, name, "".join(f"<div>{x}</div>" if item != "p" else f"<p>{x}</p>" for x in parts) if r.random() < 0.7 else "<br>".join(parts[:1]))
        return self.wrap(tag, self.dressed(r.choice([*COMMENTS, self.unknown()])), inner)

    def last_line(self) -> str:
        """A line of rights or terms in an element that says nothing."""
        r = self.r
        start = r.choice(["Copyright 2024", "Copyright", "© 2023", "(c)", "©"])
        text = r.choice([f"{start} {self.words(1, 4)} All rights reserved.", f"{start} {self.words(1, 5)}", f"{self.words(1, 3)} All rights reserved", "Privacy policy · Terms of use"])
        return self.wrap(r.choice(["div", "div", "p", "small"]), r.choice(["", "", self.unknown()]), self.marked(text, False))

    def unknown(self) -> str:
        """A class that no one has seen before."""
        return f'class="{"".join(self.r.choice("abcdefghijklmnopqrstuvwxyz0123456789") for _ in range(self.r.randint(3, 8)))}"'

    def article(self) -> str:
        r, out = self.r, []
        if r.random() < 0.8:
            level = "h1" if r.random() < 0.8 else r.choice(["h2", "div", 'div class="title"', 'div class="headline"'])
            head = f"<{level}>{self.marked(self.words(3, 14), True)}</{level.split()[0]}>"
            out.append(f"<header>{head}</header>" if r.random() < 0.15 else head)
        for _ in range(r.randint(1, 14)):
            x = r.random()
            if x < 0.78:
                out.append(self.paragraph(True, 1, 90))
            elif x < 0.86:
                out.append(f"<h{(k := r.randint(2, 3))}>{self.marked(self.words(1, 8), True)}</h{k}>")
            elif x < 0.92:
                out.append("<ul>" + "".join(f"<li>{self.marked(self.words(2, 20), True)}</li>" for _ in range(r.randint(2, 4))) + "</ul>")
            elif x < 0.96:
                out.append(f"<blockquote>{self.paragraph(True, 5, 40)}</blockquote>")
            else:
                out.append("</p>" + self.around(*r.choice(INSIDE)))
        if r.random() < 0.25:
            out.append("</p>" + self.around(*r.choice(INSIDE)))
        return "".join(out)

    def page(self) -> tuple[str, dict[int, bool]]:
        r = self.r
        self.n, self.labels = 0, {}
        alphabet = r.choice(["abcdefghijklmnopqrstuvwxyz", "aeiouéèêàçnrstl", "äöüßaeiounrst", "абвгдежзиклмнопрст", "ابتثجحخدرزسش", "的一是不了人我在有他"])
        self.letters = ["".join(r.choice(alphabet) for _ in range(r.randint(1, 3))) for _ in range(40)]
        #: The attribute of the divs that stand for paragraphs on this page, if any do.
        self.by_div = r.choice([" ", " ", self.unknown(), 'class="par"', 'class="text"', 'class="paragraph"']) if r.random() < 0.3 else ""
        tag, attribute = r.choice(ARTICLE)
        draw = lambda most: [self.around(*x) for x in r.choices(AROUND, k=r.randint(0, most))]
        said, shape = self.article(), r.random()
        if shape < 0.2:
            body = said  # in no container of its own
        elif shape < 0.35:
            body = self.wrap("div", r.choice(["", self.unknown()]), said)
        else:
            body = self.wrap(tag, self.dressed(attribute), said)
        inner = "".join([*draw(4), body, *([self.comments()] if r.random() < 0.35 else []), *draw(4 if r.random() < 0.8 else 0), *([self.last_line()] if r.random() < 0.15 else [])])
        for _ in range(r.randint(0, 3)):
            inner = self.wrap("div", r.choice(PLAIN), inner)
        return f"<!DOCTYPE html><html><head><title>{self.words(2, 8)}</title></head><body>{inner}</body></html>", self.labels
