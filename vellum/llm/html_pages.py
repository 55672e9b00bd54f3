"""Generated web pages with known main text, to train the extractor.

A page is a tree of elements, built by one of several kinds of site (news, weblog,
manual, encyclopedia, forum, shop, plain pages, layouts by tables) and written out by
a serializer that chooses as HTML allows: optional end tags left out, quotes or none,
upper-case tags, indentation, comments, character references.  Every word of the main
text is preceded by the character U+0001.
"""

from __future__ import annotations

import random
from dataclasses import dataclass, field

MARK = "\x01"
_ONSETS = "b br c ch d dr f fl g gr h j k l m n p pr qu r s sh st t th tr v w z".split()
_VOWELS = "a e i o u ai ea oo ou".split()
_CODAS = ["", "", "", "n", "r", "s", "t", "l", "nd", "st", "ck"]
#: Elements whose end tag HTML lets one leave out before an element of the same kind or the parent's end.
_OPTIONAL = frozenset("p li dt dd tr td th".split())
_INLINE = frozenset("a b i em strong span code small time".split())

# What the parts of sites call themselves in class and id attributes.
_NAMES = {
    "header": "site-header masthead top-bar page-header banner header branding".split(),
    "nav": "main-nav navigation menu primary-menu navbar breadcrumbs site-nav tabs".split(),
    "footer": "site-footer footer colophon page-foot bottom copyright legal".split(),
    "sidebar": "sidebar side-column widget-area secondary rail right-col aside".split(),
    "related": "related more-stories recommended read-next trending popular-posts most-read".split(),
    "ad": "advertisement ad-slot ads sponsor promo banner-ad sponsored adbox".split(),
    "notice": "cookie-notice consent gdpr alert-bar notice modal popup".split(),
    "form": "newsletter subscribe signup search-form login-form contact-form".split(),
    "share": "share social-buttons share-bar follow-us sharing".split(),
    "comments": "comments comment-list discussion responses replies comments-area".split(),
    "comment": "comment comment-body reply response".split(),
    "meta": "byline post-meta author-box dateline tags entry-meta".split(),
    "article": "article post entry story hentry single-post news-item".split(),
    "body": "article-body entry-content post-content story-text content body-copy prose text".split(),
    "page": "wrapper container page-wrap layout inner row grid site".split(),
}
_ROLES = {"header": "banner", "nav": "navigation", "footer": "contentinfo", "sidebar": "complementary", "article": "article", "body": "main", "form": "search"}
_TAGS = {"header": "header", "nav": "nav", "footer": "footer", "sidebar": "aside", "related": "section", "ad": "aside", "notice": "div", "form": "form", "share": "div", "comments": "section", "comment": "article", "meta": "p", "article": "article", "body": "div", "page": "div"}


@dataclass
class Node:
    tag: str
    attrs: dict[str, str] = field(default_factory=dict)
    kids: list[Node | str] = field(default_factory=list)


class Site:
    """One page's writer: its random choices, and how much its markup tells."""

    def __init__(self, r: random.Random):
        self.r = r
        self.semantic = r.random() < 0.6  # header, nav, article and so on
        self.telling = r.choice((0.0, 0.3, 0.8, 1.0))  # share of parts with a telling class
        self.vocabulary = ["".join(r.choice(_ONSETS) + r.choice(_VOWELS) + r.choice(_CODAS) for _ in range(r.choice((1, 1, 2, 2, 3)))) for _ in range(300)]

    def word(self) -> str:
        return self.r.choice(self.vocabulary)

    def words(self, a: int, b: int) -> str:
        return " ".join(self.word() for _ in range(self.r.randint(a, b)))

    def sentences(self, a: int, b: int) -> str:
        return " ".join(self.words(3, 18).capitalize() + self.r.choice("....!?") for _ in range(self.r.randint(a, b)))

    def part(self, kind: str, *kids: Node | str, tag: str | None = None) -> Node:
        """A part of the page under the tag and the names that this site gives it."""
        r = self.r
        tag = tag or (_TAGS[kind] if self.semantic or kind in ("form", "meta") else "div")
        attrs = {}
        if r.random() < self.telling:
            names = r.sample(_NAMES[kind], r.choice((1, 1, 2)))
            attrs[r.choice(("class", "class", "id"))] = " ".join(names)
            if r.random() < 0.3:
                attrs.setdefault("class", "")
                attrs["class"] = (attrs["class"] + " " + self.word()).strip()
        elif r.random() < 0.4:
            attrs["class"] = self.words(1, 2)
        if kind in _ROLES and r.random() < 0.15:
            attrs["role"] = _ROLES[kind]
        return Node(tag, attrs, list(kids))

    # --- company -----------------------------------------------------------------

    def link(self, text: str) -> Node:
        return Node("a", {"href": self.r.choice(("/", "#", "https://example.org/")) + self.word()}, [text])

    def link_list(self, a: int, b: int) -> Node:
        r = self.r
        links = [self.link(self.words(1, r.choice((2, 8)))) for _ in range(r.randint(a, b))]
        if r.random() < 0.7:
            return Node(r.choice(("ul", "ul", "ol")), {}, [Node("li", {}, [x]) for x in links])
        return Node("div", {}, [y for x in links for y in (x, r.choice((" | ", " ", " / ")))])

    def menu(self) -> Node:
        inner = self.link_list(2, 14)
        return self.part("nav", inner) if self.r.random() < 0.9 else inner

    def masthead(self) -> Node:
        r, kids = self.r, []
        kids.append(Node(r.choice(("div", "p", "span", "h1")), {}, [self.link(self.words(1, 3))]))
        if r.random() < 0.5:
            kids.append(Node("p", {}, [self.words(2, 8)]))
        if r.random() < 0.4:
            kids.append(self.menu())
        if r.random() < 0.3:
            kids.append(self.form())
        return self.part("header", *kids)

    def form(self) -> Node:
        r = self.r
        kids: list[Node | str] = [Node("label", {}, [self.words(1, 4)]), Node("input", {"type": "text", "name": self.word()}), Node("button", {}, [self.words(1, 2)])]
        if r.random() < 0.5:
            kids.insert(0, Node(r.choice(("h3", "h4", "p")), {}, [self.sentences(1, 2)]))
        return self.part("form", *kids)

    def footer(self) -> Node:
        r, kids = self.r, []
        if r.random() < 0.6:
            kids.append(self.link_list(2, 8))
        kids.append(Node(r.choice(("p", "div", "small")), {}, [f"{r.choice(('©', '(c)', 'Copyright'))} {r.randint(1998, 2025)} {self.words(1, 4)}. {self.sentences(0, 2)}"]))
        r.shuffle(kids)
        return self.part("footer", *kids)

    def aside(self) -> Node:
        r = self.r
        boxes = []
        for _ in range(r.randint(1, 4)):
            box = r.choice((self.related, self.advert, self.form, self.teasers))()
            boxes.append(box)
        return self.part("sidebar", *boxes)

    def related(self) -> Node:
        return self.part("related", Node(self.r.choice(("h2", "h3", "h4")), {}, [self.words(1, 3)]), self.link_list(2, 8))

    def teasers(self) -> Node:
        cards = [Node("div", {}, [Node("h4", {}, [self.link(self.words(3, 9))]), Node("p", {}, [self.sentences(1, 1)])]) for _ in range(self.r.randint(1, 4))]
        return self.part("related", *cards)

    def advert(self) -> Node:
        r = self.r
        return self.part("ad", r.choice((self.sentences(1, 2), Node("p", {}, [self.sentences(1, 2)]), self.link(self.words(2, 9)))))

    def notice(self) -> Node:
        return self.part("notice", Node("p", {}, [self.sentences(1, 2)]), self.link(self.words(1, 2)))

    def share(self) -> Node:
        return self.part("share", *[self.link(self.word()) for _ in range(self.r.randint(2, 5))])

    def comments(self) -> Node:
        r = self.r
        each = [self.part("comment", Node("div", {}, [self.link(self.words(1, 2)), f" {self.words(1, 3)}"]), Node("p", {}, [self.sentences(1, 4)])) for _ in range(r.randint(1, 8))]
        out = self.part("comments", Node(r.choice(("h2", "h3")), {}, [f"{len(each)} {self.word()}"]), *each)
        # Nothing but words can tell untitled comments from text, so this part is always called something.
        out.attrs.setdefault("id", r.choice(_NAMES["comments"]))
        return out

    def code(self) -> Node:
        if self.r.random() < 0.5:
            return Node("script", {}, [f"window.{self.word()} = {{{self.word()}: '<{self.word()}>'}};"])
        return Node("style", {}, [f".{self.word()} {{ color: #{self.r.randint(100, 999)}; }}"])

    def stray(self) -> Node:
        return self.r.choice((self.advert, self.notice, self.share, self.form, self.related, self.code))()

    # --- main text ---------------------------------------------------------------

    def main(self, text: str) -> list[Node | str]:
        """Marked words, with some inline markup."""
        r, out, held = self.r, [], []
        for w in text.split(" "):
            if r.random() < 0.03:
                out += [" ".join(held) + (" " if held else ""), Node(r.choice(("a", "b", "i", "em", "strong", "code", "span")), {"href": "/" + w} if r.random() < 0.3 else {}, [MARK + w]), " "]
                held = []
            else:
                held.append(MARK + w)
        return [*out, " ".join(held)]

    def paragraph(self) -> Node:
        r = self.r
        kids = self.main(self.sentences(1, r.choice((1, 3, 8))))
        if r.random() < 0.06:
            kids.insert(r.randint(0, len(kids)), Node("br"))
        if r.random() < 0.05:  # a paragraph that is all bold or a lead
            kids = [Node(r.choice(("strong", "b", "em")), {}, kids)]
        return Node("p" if r.random() < 0.93 else "div", {}, kids)

    def heading(self, level: int) -> Node:
        return Node(f"h{level}", {}, self.main(self.words(1, 10).capitalize()))

    def blocks(self, n: int) -> list[Node | str]:
        r, out = self.r, []
        for _ in range(n):
            k = r.random()
            if k < 0.78:
                out.append(self.paragraph())
            elif k < 0.84:
                out.append(self.heading(r.choice((2, 2, 3))))
            elif k < 0.88:
                out.append(Node(r.choice(("ul", "ol")), {}, [Node("li", {}, self.main(self.sentences(1, 2))) for _ in range(r.randint(2, 6))]))
            elif k < 0.91:
                out.append(Node("blockquote", {}, [self.paragraph()] if r.random() < 0.7 else self.main(self.sentences(1, 2))))
            elif k < 0.93:
                rows = [Node("tr", {}, [Node(r.choice(("td", "th")), {}, self.main(self.words(1, 4))) for _ in range(2)]) for _ in range(r.randint(1, 4))]
                out.append(Node("table", {}, rows))
            elif k < 0.95:
                out.append(Node("pre", {}, self.main(self.words(3, 14))))
            elif k < 0.96:
                out.append(Node("dl", {}, [Node(t, {}, self.main(self.words(1, 7))) for _ in range(r.randint(1, 3)) for t in ("dt", "dd")]))
            elif k < 0.97:
                out.append(Node("figure", {}, [Node("img", {"src": f"/{self.word()}.png"}), Node("figcaption", {}, self.main(self.words(2, 10)))]))
            else:
                out.append(self.stray())
        return out

    def article(self) -> Node:
        r = self.r
        body = self.blocks(r.choice((1, 2, 3, 5, 8, 12, 20)))
        if r.random() < 0.25:
            body = [self.part("body", *body)]
        if r.random() < 0.85:
            body.insert(0, self.heading(1))
        if r.random() < 0.2:
            body.append(self.share())
        if r.random() < 0.15:
            body.append(self.related())
        return self.part("article", *body)

    # --- kinds of site -----------------------------------------------------------

    def news(self) -> list[Node]:
        center = [self.article(), *self._some(self.comments, 0.4), *self._some(self.related, 0.3)]
        return [*self._some(self.notice, 0.3), self.masthead(), *self._some(self.menu, 0.7), *self._some(self.advert, 0.5), *self._columns(center), self.footer()]

    def weblog(self) -> list[Node]:
        return [self.masthead(), *self._columns([self.article(), *self._some(self.share, 0.3), *self._some(self.comments, 0.6)]), *self._some(self.footer, 0.9)]

    def manual(self) -> list[Node]:
        center = self.part("body", *self._some(self.menu, 0.3), self.heading(1), *self.blocks(self.r.randint(3, 15)), tag="main" if self.semantic else None)
        return [self.menu(), self.part("sidebar", self.link_list(4, 20), tag="nav" if self.semantic else None), center, *self._some(self.footer, 0.6)]

    def plain(self) -> list[Node]:
        return [*self._some(self.menu, 0.8), *self._some(self.stray, 0.6), self.article(), *self._some(self.footer, 0.8)]

    def bare(self) -> list[Node]:
        return [*self._some(self.menu, 0.3), *([self.heading(1)] if self.r.random() < 0.8 else []), *self.blocks(self.r.randint(1, 10)), *self._some(self.footer, 0.5)]

    def shop(self) -> list[Node]:
        center = self.part("body", self.heading(1), Node("div", {}, self.main(self.sentences(2, 6))), Node("ul", {}, [Node("li", {}, self.main(self.words(2, 6))) for _ in range(4)]))
        return [*self._some(self.notice, 0.5), self.masthead(), self.menu(), center, *self._some(self.form, 0.5), *self._some(self.teasers, 0.8), *self._some(self.comments, 0.3), self.footer()]

    def tables(self) -> list[Node]:
        left = Node("td", {"width": "180"}, [self.link_list(4, 14), *self._some(self.advert, 0.4)])
        center = Node("td", {}, [*([self.heading(self.r.choice((1, 2)))] if self.r.random() < 0.8 else []), *self.blocks(self.r.randint(2, 10))])
        foot = Node("tr", {}, [Node("td", {"colspan": "2"}, [self.footer()])])
        return [Node("table", {"border": "0", "cellpadding": "4"}, [Node("tr", {}, [Node("td", {"colspan": "2"}, [self.masthead()])]), Node("tr", {}, [left, center]), foot])]

    def _some(self, make, chance: float) -> list[Node]:
        return [make()] if self.r.random() < chance else []

    def _columns(self, center: list[Node]) -> list[Node]:
        r = self.r
        whole: list[Node | str] = center
        if self.semantic and r.random() < 0.5:
            whole = [Node("main", {}, center)]
        side = self._some(self.aside, 0.6)
        both = [*side, *whole] if r.random() < 0.3 else [*whole, *side]
        return [self.part("page", *both)] if r.random() < 0.5 else both


class Writer:
    """How a tree is written out."""

    def __init__(self, r: random.Random):
        self.r = r
        self.omit = r.choice((0.0, 0.0, 0.3, 0.8))
        self.upper = r.random() < 0.08
        self.gap = r.choice(("", "", "\n", "\n  "))
        self.comment = r.choice((0.0, 0.0, 0.05, 0.2))
        self.bare = r.random() < 0.15

    def attr(self, name: str, value: str) -> str:
        if self.bare and value.isalnum():
            return f" {name}={value}"
        quote = self.r.choice("\"\"\"'")
        return f" {name}={quote}{value}{quote}"

    def text(self, raw: str) -> str:
        out = raw.replace("&", "&amp;").replace("<", "&lt;")
        return out.replace("'", "&#39;") if self.r.random() < 0.2 else out

    def node(self, n: Node | str, raw: bool = False) -> str:
        if isinstance(n, str):
            return n if raw else self.text(n)
        tag = n.tag.upper() if self.upper else n.tag
        head = f"<{tag}{''.join(self.attr(k, v) for k, v in n.attrs.items())}>"
        if n.tag in ("br", "img", "input"):
            return head
        block = n.tag not in _INLINE
        kids = []
        for i, k in enumerate(n.kids):
            kids.append(self.node(k, n.tag in ("script", "style")))
            if block and not isinstance(k, str) and k.tag not in _INLINE:
                if self.r.random() < self.comment:
                    kids.append(f"<!-- {'-'.join(self.r.choices(_ONSETS, k=3))} -->")
                kids.append(self.gap)
            omitted = not isinstance(k, str) and k.tag in _OPTIONAL and self.r.random() < self.omit
            follower = n.kids[i + 1] if i + 1 < len(n.kids) else None
            if omitted and (follower is None or (not isinstance(follower, str) and follower.tag == k.tag)) and n.tag not in _INLINE:
                end = f"</{k.tag.upper() if self.upper else k.tag}>"
                for at in range(len(kids) - 1, -1, -1):
                    if kids[at].endswith(end):
                        kids[at] = kids[at][: -len(end)]
                        break
        return head + "".join(kids) + f"</{tag}>"


def make(seed: int, number: int) -> tuple[str, str]:
    """(html with marks, its main text without, words in page order)."""
    r = random.Random(f"{seed}-{number}")
    site, writer = Site(r), Writer(r)
    kind = r.choice((site.news, site.news, site.weblog, site.weblog, site.manual, site.plain, site.plain, site.bare, site.shop, site.tables))
    body = Node("body", {}, list(kind()))
    head = Node("head", {}, [Node("title", {}, [site.words(2, 9)]), *site._some(site.code, 0.5)])
    html = "<!doctype html>" + writer.node(Node("html", {"lang": "en"}, [head, body]))
    words: list[str] = []

    def collect(n: Node | str) -> None:
        if isinstance(n, str):
            words.extend(w[1:] for w in n.split() if w.startswith(MARK))
        else:
            for k in n.kids:
                collect(k)

    collect(body)
    return html, " ".join(words)
