"""Training pages for the extractor: made-up pages whose main text is known.

The pages vary in structure (semantic elements, plain divs, tables), in the
names of their attributes, which are sometimes missing, and in what surrounds
and interrupts the article. Words are random syllables, so nothing depends on a
language.
"""

from __future__ import annotations

import html
import random

_SYLLABLES = "ba be bi bo ca ce co da de di do el en er es fa fi ga ge go ha he hi in ka ko la le li lo ma me mi mo na ne no on or pa pe po ra re ri ro sa se si so ta te ti to un va ve vi wa wo za é ü ñ ß".split()


class PageMaker:
    def __init__(self, seed: int) -> None:
        self.r = random.Random(seed)
        self.main: list[str] = []

    def word(self) -> str:
        return "".join(self.r.choice(_SYLLABLES) for _ in range(self.r.randint(1, 4)))

    def words(self, n: int) -> str:
        return " ".join(self.word() for _ in range(n))

    def sentence(self) -> str:
        words = [self.word() + ("," if self.r.random() < 0.08 else "") for _ in range(self.r.randint(1, 18))]
        return " ".join(words).capitalize() + self.r.choice([".", ".", ".", "!", "?", "!!", " &&&.", ""])

    def prose(self, most: int = 8) -> str:
        text = " ".join(self.sentence() for _ in range(self.r.randint(1, most)))
        if self.r.random() < 0.05:
            text = " | ".join(self.words(self.r.randint(3, 30)).split())
        elif self.r.random() < 0.05:
            text = "!! ".join(text.upper().split())
        elif self.r.random() < 0.05:
            text = " ".join(w + self.r.choice(["***", "%%%", "$$$", "###"]) for w in text.split())
        return text

    def attrs(self, *choices: str) -> str:
        if not choices or self.r.random() < 0.15:
            return ""
        name = self.r.choice(choices)
        return f' {self.r.choice(["class", "id", "class"])}="{name}"'

    def inline(self, text: str) -> str:
        words = html.escape(text, quote=False).split(" ")
        if len(words) > 4 and self.r.random() < 0.4:
            k = self.r.randrange(len(words) - 1)
            words[k] = self.r.choice(["<b>{}</b>", "<i>{}</i>", '<a href="/x">{}</a>', "<b>{}", "{}<br>", "<em>{}</em>"]).format(words[k])
        return " ".join(words)

    def keep(self, tag: str, text: str) -> str:
        self.main.append(" ".join(text.split()))
        return f"<{tag}>{self.inline(text)}" + ("" if tag in ("p", "li") and self.r.random() < 0.25 else f"</{tag}>")

    def links(self, n: int) -> str:
        return "".join(f'<li><a href="/{self.word()}">{self.words(self.r.randint(1, 3))}</a></li>' for _ in range(n))

    def nav(self) -> str:
        tag = self.r.choice(["nav", "nav", "div", "ul"])
        inner = self.links(self.r.randint(2, 9))
        return f"<{tag}{self.attrs('nav', 'menu', 'navbar', 'main-menu', 'navigation', 'breadcrumb')}>{inner if tag == 'ul' else f'<ul>{inner}</ul>'}</{tag}>"

    def header(self) -> str:
        tag = self.r.choice(["header", "header", "div"])
        name = self.attrs("header", "site-header", "masthead", "branding", "page-header") or (' class="header"' if tag == "div" else "")
        return f"<{tag}{name}>{self.r.choice(['<h1>{}</h1>', '<p>{}</p>', '{}', '<a href=\"/\">{}</a>']).format(self.words(3))}{self.r.choice(['', f'<p>{self.sentence()}</p>'])}</{tag}>"

    def footer(self) -> str:
        tag = self.r.choice(["footer", "footer", "div"])
        name = self.attrs("footer", "site-footer", "bottom", "copyright") or (' id="footer"' if tag == "div" else "")
        text = self.r.choice([f"&copy; {self.word()}.example.com &middot; {self.prose(2)}", f"<p>{self.prose(3)}</p>", f"<ul>{self.links(4)}</ul><p>&copy; {self.words(4)}</p>"])
        return f"<{tag}{name}>{text}</{tag}>"

    def ad(self) -> str:
        name = self.r.choice(["ad", "ads", "advert", "banner", "sponsored", "promo", "ad-slot", "advertisement", "adBox"])
        text = self.r.choice([html.escape(self.prose(2)), f"<p>{self.prose(3)}</p>", f'<a href="/ad">{self.words(5)}</a>'])
        return f'<{(t := self.r.choice(["div", "div", "aside", "section"]))} {self.r.choice(["class", "id"])}="{name}">{text}</{t}>'

    def notice(self) -> str:
        name = self.r.choice(["cookie-notice", "cookie-banner", "consent", "notice", "gdpr", "alert", "popup", "modal", "privacy-notice"])
        return f'<{(t := self.r.choice(["div", "div", "section", "aside"]))} {self.r.choice(["class", "id"])}="{name}"><p>{self.prose(3)}</p>{self.r.choice(["", "<button>OK</button>"])}</{t}>'

    def form(self) -> str:
        name = self.attrs("newsletter", "subscribe", "search", "signup", "contact-form")
        return f'<form{name}>{self.r.choice(["<p>{}</p>", "<label>{}</label>", "{}"]).format(self.prose(2))}<input name="q"><button>{self.word()}</button></form>'

    def aside(self) -> str:
        tag = self.r.choice(["aside", "aside", "div"])
        name = self.attrs("sidebar", "widget", "related", "side", "rail", "recommended", "popular") or (' class="sidebar"' if tag == "div" else "")
        body = self.r.choice([f"<h3>{self.words(2)}</h3><ul>{self.links(5)}</ul>", f"<h2>{self.words(2)}</h2><p>{self.prose(4)}</p>", f"<p>{self.prose(3)}</p>"])
        return f"<{tag}{name}>{body}</{tag}>"

    def share(self) -> str:
        return f'<div class="{self.r.choice(["share", "social", "share-buttons", "follow-us"])}">{self.r.choice([f"<ul>{self.links(3)}</ul>", self.words(3), f"<span>{self.words(2)}</span>"])}</div>'

    def comments(self) -> str:
        name = self.r.choice(["comments", "comment-list", "commentlist", "reader-comments", "discussion", "responses"])
        one = self.r.choice(["<li><p>{}</p></li>", '<div class="comment"><p>{}</p></div>', '<div class="comment"><b>{w}</b><p>{}</p></div>', '<article class="comment"><p>{}</p></article>', "<p>{}</p>"])
        many = "".join(one.format(self.prose(5), w=self.word()) for _ in range(self.r.randint(1, 6)))
        tag = self.r.choice(["section", "div", "ol" if one.startswith("<li") else "div", "aside"])
        return f'<{tag} {self.r.choice(["class", "id"])}="{name}">{self.r.choice(["", f"<h3>{self.words(1)}</h3>", f"<h2>{self.words(2)}</h2>"])}{many}</{tag}>'

    def article(self) -> str:
        out = [self.keep("h1", self.words(self.r.randint(2, 10)))] if self.r.random() < 0.9 else []
        paragraphs = self.r.choice([0, 1, 1, 2, 3, 4, 6, 9, 14])
        bold_first = self.r.random() < 0.3
        for k in range(paragraphs):
            kind = self.r.random()
            if bold_first and k % 7 == 0:
                text = self.prose()
                self.main.append(" ".join(text.split()))
                out.append(f"<p><b>{html.escape(text, quote=False)}<br>")
            elif kind < 0.7:
                out.append(self.keep("p", self.prose()))
            elif kind < 0.76:
                out.append(self.keep(self.r.choice(["h2", "h3"]), self.words(self.r.randint(1, 6))))
            elif kind < 0.81:
                tag = self.r.choice(["ul", "ol"])
                out.append(f"<{tag}>" + "".join(self.keep("li", self.prose(2)) for _ in range(self.r.randint(2, 5))) + f"</{tag}>")
            elif kind < 0.85:
                out.append("<blockquote>" + self.keep("p", self.prose(3)) + "</blockquote>")
            elif kind < 0.87:
                out.append(self.keep("pre", self.prose(2)))
            elif kind < 0.89:
                out.append("<table>" + "".join("<tr>" + self.keep("td", self.words(2)) + self.keep("td", self.words(3)) + "</tr>" for _ in range(3)) + "</table>")
            elif kind < 0.91:
                out.append('<figure><img src="/x.png">' + self.keep("figcaption", self.sentence()) + "</figure>")
            elif kind < 0.94:
                out.append(self.keep("div", self.prose(4)))
            else:
                out.append(self.r.choice([self.ad, self.aside, self.share, self.form, self.notice])())
        return "".join(out)

    def page(self) -> tuple[str, list[str]]:
        r = self.r
        title = self.words(r.randint(2, 8))
        head = f'<!DOCTYPE html><html lang="xx"><head><meta charset="utf-8"><title>{title}</title><style>p{{margin:0}}</style><script>var t="</p>";track({r.randint(0, 9)});</script></head><body>'
        before = [f() for f in (self.header, self.nav, self.ad, self.notice, self.form) if r.random() < 0.5]
        r.shuffle(before)
        tag = r.choice(["article", "article", "main", "section", "div", "div", "td"])
        name = self.attrs("content", "post", "story", "entry-content", "article-body", "main", "post-content") or (' class="content"' if tag in ("div", "td", "section") and r.random() < 0.7 else "")
        body = self.article()
        tail = [f() for f in (self.share, self.ad) if r.random() < 0.2]
        if r.random() < 0.25:
            tail.append(self.comments())
        inside = f"<{tag}{name}>{body}{''.join(tail)}</{tag}>"
        side = self.aside() if r.random() < 0.35 else ""
        if tag == "td":
            inside = f"<table><tr>{f'<td class=menu>{self.links(4)}</td>' if r.random() < 0.5 else ''}{inside}</tr></table>"
        elif r.random() < 0.4:
            inside = f"<div{self.attrs('container', 'wrapper', 'page', 'layout', 'row')}>{r.choice([side + inside, inside + side])}</div>"
            side = ""
        after = [f() for f in (self.comments, self.ad, self.aside, self.form, self.notice) if r.random() < 0.25]
        foot = self.footer() if r.random() < 0.8 else ""
        return head + "".join(before) + inside + side + "".join(after) + foot + r.choice(["", "</body></html>", "</body></html>"]), self.main


def pages(n: int, seed: int = 1) -> list[tuple[str, list[str]]]:
    """n pages with the blocks of their main text."""
    return [PageMaker(seed * 1_000_003 + i).page() for i in range(n)]
