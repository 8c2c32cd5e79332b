"""Main text of web pages: a linear-chain conditional random field over DOM leaf blocks.

A page is parsed to its leaf blocks, the runs of text between block-level tags, in page order. Each
block has features of its ancestors (tags, words of class and id, landmark roles, the nearest of them
that says something), of its text (length, link share, punctuation, notices, dates and names), and of
where it stands among the page's prose: inside or outside the element that holds most of it, before its
first or after its last paragraph, in how many elements of the same shape beside each other, under
which heading. The latter say what names don't. The field has one weight for each feature and label and for each pair of neighbouring labels; Viterbi decoding gives the most
likely labels of the whole page.

The field is trained here on labelled pages: `training_pages` lays out TRAINING_PAGES pages of made-up
words with menus, banners, notices, adverts, forms, sidebars, comments, bylines and footers around and
inside articles, and knows which blocks are the article. A part of the pages has the element and class
names that web templates use; the others have made-up names, none at all, or tables for layout.
Training maximises the likelihood by forward-backward and adaptive gradient steps; it is deterministic.
"""

from __future__ import annotations

import random
import re
from collections.abc import Iterable, Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kerbline.sources.markup import tokens

TRAINING_PAGES = 700
EPOCHS = 12
#: Fixed values of HTML.
_SKIPPED = frozenset("script style noscript template title svg math iframe object select option button textarea datalist canvas audio video".split())
_VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
_INLINE = frozenset("a abbr acronym b bdi bdo big cite code data del dfn em font i ins kbd label mark q rp rt ruby s samp small span strike strong sub sup time tt u var wbr img picture".split())
_CLOSES_P = frozenset("address article aside blockquote center details dialog dir div dl fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr main menu nav ol p pre search section table ul".split())
_SIBLINGS = {"li": ({"li"}, {"ul", "ol", "menu"}), "dt": ({"dt", "dd"}, {"dl"}), "dd": ({"dt", "dd"}, {"dl"}), "tr": ({"tr", "td", "th"}, {"table"}), "td": ({"td", "th"}, {"tr", "table"}), "th": ({"td", "th"}, {"tr", "table"})}
_SCOPE = frozenset("html table td th caption button object".split())

#: Words of class, id and role that web templates use, by what they stand for.
_NAMES = {
    "menu": "nav navbar navigation menu breadcrumb breadcrumbs pagination pager tabs toc skip",
    "header": "header masthead topbar banner branding logo site-title",
    "footer": "footer colophon copyright legal imprint credits",
    "side": "sidebar side aside widget rail related recommended popular trending more",
    "notice": "cookie consent notice alert gdpr popup modal overlay toast warning disclaimer",
    "advert": "ad ads advert adverts advertisement sponsor sponsored promo promotion banner-ad adsense",
    "form": "form newsletter subscribe signup login search contact register",
    "social": "share sharing social follow",
    "comments": "comment comments reply replies discussion disqus responses reviews",
    "main": "article content post entry story main body text page-content article-body post-body entry-content",
}
_KIND_OF = {word: kind for kind, words in _NAMES.items() for word in words.split()}
_TAG_KIND = {"nav": "menu", "menu": "menu", "header": "header", "footer": "footer", "aside": "side", "form": "form", "article": "main", "main": "main", "dialog": "notice", "search": "form", "fieldset": "form", "ins": "advert"}
_ROLE_KIND = {"navigation": "menu", "banner": "header", "contentinfo": "footer", "complementary": "side", "alert": "notice", "dialog": "notice", "alertdialog": "notice", "search": "form", "main": "main", "article": "main"}
_NAME_WORD = re.compile(r"[a-z]+(?:-[a-z]+)*")
_NOTICE = re.compile(r"©|\(c\)|copyright|cookie|all rights reserved|subscribe|sign up|log ?in|advertis|sponsored|read more|click here|privacy|newsletter", re.IGNORECASE)


def _kinds(tag: str, attrs: list[tuple[str, str | None]]) -> tuple[str, ...]:
    """What an element's tag, role, class and id say it is, the tag first."""
    out = []
    if tag in _TAG_KIND and tag != "ins":
        out.append(_TAG_KIND[tag])
    for key, value in attrs:
        if key == "role":
            out += [_ROLE_KIND[r] for r in (value or "").lower().split() if r in _ROLE_KIND]
        elif key in ("class", "id"):
            for name in (value or "").lower().replace("_", "-").split():
                whole = _NAME_WORD.findall(name)
                for word in whole:
                    parts = [word] if word in _KIND_OF else [p for p in word.split("-") if p in _KIND_OF]
                    out += [_KIND_OF[p] for p in parts]
    return tuple(dict.fromkeys(out))


class _Node:
    """An open element. What a block's features need of all ancestors is carried down, so a page's depth
    costs nothing: nodes share what they don't change."""

    __slots__ = ("block", "end", "kinds", "main", "nearest", "order", "other", "tag", "tags", "up")

    def __init__(self, tag: str, kinds: tuple[str, ...], parent: _Node | None, order: int):
        self.tag, self.order, self.end = tag, order, order + 1
        inline = tag in _INLINE
        self.block = parent.block if inline and parent else self
        self.up = parent.block if parent else None  # nearest element above that isn't inline
        above = parent.tags if parent else frozenset()
        self.tags = above if inline or tag in above or tag in ("html", "body") else above | {tag}
        known = parent.kinds if parent else frozenset()
        self.kinds = known if known.issuperset(kinds) else known.union(kinds)
        self.nearest = kinds[0] if kinds else parent.nearest if parent else "none"
        self.other = next((k for k in kinds if k != "main"), parent.other if parent else "none")
        self.main = "main" in kinds or (parent.main if parent else False)


Block = tuple[str, _Node, float]  # text, where it stands, share of linked characters


class _Blocks:
    """Leaf blocks of a page."""

    def __init__(self):
        self.root = _Node("body", (), None, 0)
        self.stack: list[_Node] = []
        self.open: dict[str, list[int]] = {}  # places in the stack by tag
        self.nodes = 1
        self.skipped = 0
        self.pieces: list[str] = []
        self.linked = 0
        self.place: _Node | None = None
        self.blocks: list[Block] = []

    def _flush(self) -> None:
        text = " ".join("".join(self.pieces).split())
        if text:
            self.blocks.append((text, self.place or self.root, min(1.0, self.linked / len(text))))
        self.pieces, self.linked, self.place = [], 0, None

    def _pop(self) -> None:
        node = self.stack.pop()
        node.end = self.nodes
        self.open[node.tag].pop()
        if node.tag in _SKIPPED:
            self.skipped -= 1

    def _innermost(self, tags: Iterable[str]) -> int:
        return max((held[-1] for t in tags if (held := self.open.get(t))), default=-1)

    def _close_up_to(self, wanted: Iterable[str], stop: Iterable[str]) -> None:
        """Closes the innermost open element of `wanted`, unless one of `stop` stands further in."""
        place = self._innermost(wanted)
        if place >= 0 and place >= self._innermost(stop):
            while len(self.stack) > place:
                self._pop()

    def start(self, tag: str, attrs: list[tuple[str, str]]) -> None:
        if tag not in _INLINE:
            self._flush()
        elif tag == "img":
            self.pieces.append(" ")
        if tag in _CLOSES_P:
            self._close_up_to({"p"}, _SCOPE)
        if tag in _SIBLINGS:
            self._close_up_to(*_SIBLINGS[tag])
        if tag in ("option", "a"):
            self._close_up_to({tag}, _SCOPE | _CLOSES_P)
        if tag in _VOID:
            return
        self.open.setdefault(tag, []).append(len(self.stack))
        self.stack.append(_Node(tag, _kinds(tag, attrs), self.stack[-1] if self.stack else self.root, self.nodes))
        self.nodes += 1
        if tag in _SKIPPED:
            self.skipped += 1

    def end(self, tag: str) -> None:
        if tag not in _INLINE:
            self._flush()
        self._close_up_to({tag}, ())

    def text(self, data: str) -> None:
        if self.skipped:
            return
        if self.place is None and not data.isspace():
            self.place = self.stack[-1] if self.stack else self.root
        self.pieces.append(data)
        if self.open.get("a"):
            self.linked += len(data.strip())

    def close(self) -> None:
        self._flush()
        while self.stack:
            self._pop()
        self.root.end = self.nodes


def leaf_blocks(html: str | None) -> list[Block]:
    """Blocks in page order. What a page leaves open or malforms is read as browsers do, in time linear in it."""
    page = _Blocks()
    for kind, said, attributes in tokens(html):
        if kind == "text":
            page.text(said)
        elif kind == "start":
            page.start(said, attributes)
        else:
            page.end(said)
    page.close()
    return page.blocks


_HEADING = frozenset("h1 h2 h3 h4 h5 h6".split())
_UNDER = (
    ("comments", re.compile(r"comment|repl(?:y|ies)|response|discussion|review|said", re.IGNORECASE)),
    ("related", re.compile(r"related|recommend|popular|trending|read next|more (?:from|stories|on)|also|latest|archive|categor|tags", re.IGNORECASE)),
    ("about", re.compile(r"about|author|share|follow|subscribe|newsletter|sponsor|advert|contact", re.IGNORECASE)),
)
_DATED = re.compile(r"\b\d{1,2}[./-]\d{1,2}[./-](?:19|20)\d\d\b|\b\d{1,2}\.? [A-Z][a-z]{2,8}\.? (?:19|20)\d\d\b|\b(?:19|20)\d\d-\d\d-\d\d\b|\b[A-Z][a-z]{2,8}\.? \d{1,2}, (?:19|20)\d\d\b|\b(?:\d+|an?) (?:second|minute|hour|day|week|month|year)s? ago\b")
_SIGNED = re.compile(r"^(?:By|by|BY) [A-Z][\w'-]+(?: [A-Z][\w'-]+){0,2}\s*(?:$|[|,·•–-])|^(?:[Pp]osted|[Pp]ublished|[Uu]pdated|[Ww]ritten|[Ff]iled) (?:by|on|in)\b|\b(?:says|said|wrote|writes):$|^(?:[Rr]eply|[Pp]ermalink)\b")
_CONTACT = re.compile(r"contact|imprint|terms|privacy|sitemap|faq|help|careers|home", re.IGNORECASE)


def _bucket(n: float) -> str:
    return str(int(n)) if n < 3 else "3-5" if n < 6 else "6+"


def _is_prose(text: str, words: int, linked: float) -> bool:
    return words >= 12 and linked < 0.3 and (sum(map(text.count, ".,;:!?|")) * 25 > words)


def page_features(blocks: list[Block]) -> list[tuple[tuple, list[str]]]:
    """For each block, what its place says (alike for blocks of one place) and its other features."""
    n_words = [text.count(" ") + 1 for text, _, _ in blocks]
    prose = [_is_prose(b[0], n, b[2]) for b, n in zip(blocks, n_words, strict=True)]
    mass: dict[_Node, float] = {}
    for (text, node, _), is_prose in zip(blocks, prose, strict=True):
        above = node.block.up
        if is_prose and above is not None:
            mass[above] = mass.get(above, 0.0) + len(text)
            if above.up is not None:
                mass[above.up] = mass.get(above.up, 0.0) + len(text) / 2
    best = max(mass, key=lambda node: (mass[node], node.order)) if mass else None
    inside = [best is not None and best.order <= node.order < best.end for _, node, _ in blocks]
    of_best = [k for k in range(len(blocks)) if inside[k] and prose[k]]
    first, last = (of_best[0], of_best[-1]) if of_best else (len(blocks), -1)
    groups: dict[tuple, set[int]] = {}
    held: dict[_Node, int] = {}
    for _, node, _ in blocks:
        box = node.block.up
        if box is not None:
            held[box] = held.get(box, 0) + 1
            groups.setdefault((box.up, box.tag), set()).add(box.order)
    kind = ["L" if linked >= 0.5 else "P" if is_prose else "S" for (_, _, linked), is_prose in zip(blocks, prose, strict=True)]
    far, last_seen = [99] * len(blocks), None
    for order in (range(len(blocks)), range(len(blocks) - 1, -1, -1)):
        last_seen = None
        for k in order:
            if prose[k]:
                last_seen = k
            if last_seen is not None:
                far[k] = min(far[k], abs(k - last_seen))
    longest = max(map(len, (b[0] for b in blocks)), default=1)
    # where names say what the article is, structure counts for less
    named = "m:" if any(is_prose and node.nearest == "main" for (_, node, _), is_prose in zip(blocks, prose, strict=True)) else "n:"
    out, under = [], "none"
    for k, (text, node, linked) in enumerate(blocks):
        n, words = len(text), n_words[k]
        leaf = node.block
        if leaf.tag in _HEADING or words <= 3:
            said = next((name for name, pattern in _UNDER if n < 60 and pattern.search(text)), None)
            if said or leaf.tag in _HEADING:
                under = said or "other"
        own = ["words:" + str(min(6, words.bit_length())), "links:" + str(int(linked * 4)), named + "under:" + under]
        if text[-1] in ".!?…:;\"'”»)":
            own.append(named + "ends")
        if sum(map(text.count, ".,;:!?")) * 12 > words:
            own.append(named + "punctuated")
        if n < 200 and _NOTICE.search(text):
            own.append(named + "notice-words")
        if n < 120:
            if _DATED.search(text):
                own.append(named + "dated")
            if _SIGNED.search(text):
                own.append(named + "signed")
            if _CONTACT.search(text):
                own.append(named + "contact")
        zone = ("before" if k < first else "after" if k > last else "among") if inside[k] else "outside"
        own += [named + "zone:" + zone + kind[k], named + "far:" + _bucket(far[k]), named + "long:" + str(int(4 * n / longest))]
        box = leaf.up
        if box is not None:
            beside = len(groups[box.up, box.tag])
            own.append(named + "beside:" + _bucket(beside) + ":" + _bucket(held[box]))
            own.append(named + "box:" + ("best" if box is best else "of-best" if best is not None and box.up is best else "other") + kind[k])
            share = mass.get(box, 0.0) / mass[best] if best is not None else 0.0
            own.append(named + "mass:" + str(int(share * 4)))
        own.append(named + "beside-kinds:" + (kind[k - 1] if k else "-") + kind[k] + (kind[k + 1] if k + 1 < len(blocks) else "-"))
        out.append(((leaf.tag, node.tags, node.kinds, node.nearest, node.other, node.main), own))
    return out


def place_features(place: tuple) -> list[str]:
    leaf, tags, kinds, nearest, other, main = place
    out = ["bias", "leaf:" + leaf, "nearest:" + nearest, "aside:" + other + (":in-main" if main else ":alone")]
    return out + ["in:" + t for t in sorted(tags)] + ["kind:" + k for k in sorted(kinds)]


# ---------------------------------------------------------------------------------------------
# Labelled pages

_SYLLABLES = "ka lo mi ter ven sor da li pu ran esh qui bo tal ner fi gos wen dri mar".split()


class _Pages:
    def __init__(self, seed: int):
        self.rng = random.Random(seed)

    def words(self, low: int, high: int) -> str:
        rng = self.rng
        out = ["".join(rng.choices(_SYLLABLES, k=rng.randint(1, 4))) for _ in range(rng.randint(low, high))]
        return " ".join(w + rng.choices(["", ",", "."], [12, 1, 1])[0] for w in out)

    def sentence(self, low: int = 3, high: int = 40) -> str:
        said = self.words(low, high).rstrip(",.").capitalize()
        if self.rng.random() < 0.05:  # what bylines and comments have may stand in any text
            said = self.rng.choice(["By", "On 3 May 2021", "Posted on", "Updated", "In 2021-05-03", "2 days ago", "Comments on", "About", "Contact"]) + " " + said.lower()
        return said + self.rng.choice([".", ".", ".", "!", "?"])

    def element(self, tag: str, name: str, inside: str) -> str:
        where = self.rng.choice(["class", "class", "id"])
        return f'<{tag} {where}="{name}">{inside}</{tag}>' if name else f"<{tag}>{inside}</{tag}>"

    def links(self, low: int = 2, high: int = 7) -> str:
        rows = [f'<a href="/{k}">{self.words(1, 3)}</a>' for k in range(self.rng.randint(low, high))]
        return "<ul>" + "".join(f"<li>{r}</li>" for r in rows) + "</ul>" if self.rng.random() < 0.7 else " | ".join(rows)

    def aside(self, kind: str) -> str:
        rng, pick = self.rng, self.rng.choice
        name = pick([n for n in _NAMES[kind].split() for _ in range(2)] + [""]) if kind in _NAMES else ""
        if kind == "menu":
            return pick([f"<nav>{self.links()}</nav>", self.element("div", name or "menu", self.links()), self.element("ul", name or "nav", "".join(f'<li><a href="#">{self.words(1, 2)}</a></li>' for _ in range(4)))])
        if kind == "header":
            inside = pick([f"<h1>{self.words(1, 5)}</h1>", f"<div>{self.words(1, 4)}</div><p>{self.words(2, 8)}</p>", f"<p>{self.sentence()}</p>"])
            return pick([f"<header>{inside}</header>", self.element("div", name or "header", inside), f'<div role="banner">{inside}</div>'])
        if kind == "footer":
            inside = pick(["&copy; ", "Copyright ", ""]) + self.words(1, 4) + pick([" &middot; ", ". "]) + pick([self.sentence(), self.links()])
            return pick([f"<footer>{inside}</footer>", f"<footer><p>{inside}</p></footer>", self.element("div", name or "footer", f"<p>{inside}</p>")])
        if kind == "comments":
            one = lambda: f"<p>{self.sentence(4, 60)}</p>"
            who = lambda: pick([f"{self.words(1, 2)} {rng.randint(1, 28)} May 20{rng.randint(10, 24)}", f"{self.words(1, 2)} says:", f"<b>{self.words(1, 2)}</b> {rng.randint(2, 20)} hours ago", f"<b>{self.words(1, 1)}</b>"])
            many = "".join(pick([f'<div class="comment">{one()}</div>', f"<div><div>{who()}</div>{one()}</div>", f"<div>{who()}<br>{one()}</div>", f"<li><span>{who()}</span>{one()}</li>", f"<tr><td>{who()}</td><td>{self.sentence(4, 60)}</td></tr>", f"<li>{one()}</li>", f"<article>{one()}</article>", f'<article class="comment"><h4>{self.words(1, 2)}</h4>{one()}{one()}</article>']) for _ in range(rng.randint(1, 6)))
            return self.element(pick(["section", "div", "ol", "div"]), name or "comments", pick(["", "<h3>Comments</h3>", f"<h2>{self.words(1, 3)}</h2>"]) + many)
        if kind == "form":
            inside = f"<label>{self.words(1, 4)}</label><input type=text><button>{self.words(1, 2)}</button>" + pick(["", f"<p>{self.sentence()}</p>", "<p>Subscribe to our newsletter.</p>"])
            return pick([f"<form action=/s>{inside}</form>", self.element("div", name or "newsletter", f"<form>{inside}</form>"), self.element("div", name or "subscribe", f"<p>{self.sentence()}</p>")])
        inside = pick([f"<p>{self.sentence(2, 40)}</p>", self.sentence(2, 40), f"<h3>{self.words(1, 4)}</h3>" + self.links(), f"<h3>{self.words(1, 4)}</h3><p>{self.sentence(4, 40)}</p><p>{self.sentence(4, 40)}</p>", f"<p>{self.words(2, 6)}</p>" + self.links()])
        if kind == "side" and rng.random() < 0.5:
            return pick([f"<aside>{inside}</aside>", self.element("aside", name, inside)])
        if kind == "notice" and rng.random() < 0.4:
            inside = f"<p>{pick(['We use cookies. ', 'Accept cookies? ', ''])}{self.sentence()}</p><button>OK</button>"
        if kind == "advert" and rng.random() < 0.3:
            inside = pick(["Advertisement ", "Sponsored: "]) + inside
        return self.element(pick(["div", "div", "section", "p" if "<" not in inside else "div"]), name or {"side": "sidebar", "notice": "notice", "advert": "ad", "social": "share"}[kind], inside)

    def article(self) -> str:
        """Article blocks between marks that become labels."""
        rng, pick = self.rng, self.rng.choice
        parts = [pick([f"<h1>{self.words(2, 10)}</h1>", f"<h2>{self.words(2, 10)}</h2>", "", f"<header><h1>{self.words(2, 9)}</h1></header>"])]
        for _ in range(rng.randint(1, 9)):
            parts.append(
                pick(
                    [f"<p>{self.sentence(1, 12)}</p>", f"<p>{pick(['All rights reserved.', self.words(1, 2).capitalize() + '.', 'Privacy and cookies.', 'Read more.', self.sentence(1, 3)])}</p>"] + [f"<p>{self.sentence(5, 90)} {self.sentence(3, 30)}</p>"] * 6
                    + [f"<p>{self.sentence(4, 50)}", f"<p><b>{self.sentence(4, 60)}<br><p>{self.sentence(4, 50)}</p>", f"<h2>{self.words(1, 7)}</h2>", f"<h3>{self.words(1, 6)}</h3>"]
                    + [f"<blockquote>{self.sentence(4, 40)}</blockquote>", "<ul>" + "".join(f"<li>{self.sentence(1, 18)}</li>" for _ in range(rng.randint(2, 6))) + "</ul>"]
                    + ["<ol>" + "".join(f"<li>{self.words(1, 12)}" for _ in range(3)) + "</ol>", f"<pre>{self.words(3, 20)}</pre>", f"<table><tr><th>{self.words(1, 2)}<td>{self.words(1, 4)}</table>"]
                    + [f"<p>{self.sentence(5, 40)} <a href=/x>{self.words(1, 5)}</a> {self.sentence(5, 40)}</p>", f"<div>{self.sentence(6, 60)}</div>", f"<section><p>{self.sentence(6, 60)}</p></section>"]
                    + [f"<figure><img src=x><figcaption>{self.words(3, 12)}</figcaption></figure>"]
                )
            )
        out = ["\x01" + p.replace(">", ">\x01") for p in parts]
        if rng.random() < 0.35:
            date = pick([f"{rng.randint(1, 28)} May 20{rng.randint(10, 24)}", f"20{rng.randint(10, 24)}-0{rng.randint(1, 9)}-11", f"{rng.randint(2, 9)} days ago"])
            name = self.words(1, 2).title().replace(",", "").replace(".", "")
            line = pick([f"By {name} | {date}", f"{name}, {date}", f"Posted by {name} on {date}", date, f"By {name}"])
            out.insert(1, pick([f'<p class="byline">{line}</p>', f'<div class="post-meta">{line}</div>', f"<div><span>{line}</span></div>", f"<p>{line}</p>"]))
        for _ in range(pick([0, 0, 1, 2])):
            out.insert(rng.randint(1, len(out)), self.aside(pick(["advert", "side", "menu", "notice", "form", "social", "comments"])))
        return "".join(out)

    def page(self) -> str:
        rng, pick = self.rng, self.rng.choice
        before = [self.aside(k) for k in rng.sample(["menu", "header", "notice", "advert", "form", "side", "menu"], rng.randint(1, 5))]
        after = [self.aside(k) for k in rng.sample(["comments", "side", "footer", "advert", "social", "form", "menu", "notice"], rng.randint(0, 5))] + [self.aside("footer")] * pick([0, 1, 1])
        names = _NAMES["main"].split()
        inside = self.article()
        inside = pick([lambda: f"<article>{inside}</article>"] * 3 + [lambda: f"<main>{inside}</main>", lambda: self.element("div", pick(names), inside), lambda: self.element("section", pick(names), inside), lambda: f'<article class="{pick(names)}">{inside}</article>', lambda: f"<main><article>{inside}</article></main>", lambda: f"<div><div>{inside}</div></div>"])()
        layout = rng.choices(["named", "made-up", "bare", "table"], [7, 5, 5, 3])[0]
        if layout == "table":
            cells = "".join(f"<td>{x}</td>" for x in [*before[1:2], inside, *after[:1]])
            body = f"<table><tr><td colspan=3>{''.join(before[:1] + before[2:])}</td></tr><tr>{cells}</tr><tr><td>{''.join(after[1:])}</td></tr></table>"
        else:
            body = "".join(before) + inside + "".join(after)
        if rng.random() < 0.4:
            body = f'<div class="{pick(["wrapper", "container", "page", "site"])}">{body}</div>'
        if layout != "named":
            body = self.renamed(body, layout == "made-up")
        return f"<!DOCTYPE html><html><head><title>{self.words(2, 8)}</title><style>p{{}}</style><script>var t=1;</script></head><body>{body}</body></html>"

    def renamed(self, body: str, made_up: bool) -> str:
        """The page with names that say nothing or none, and mostly without elements that do."""
        rng = self.rng
        names: dict[str, str] = {}
        name_of = lambda m: f' class="{names.setdefault(m.group(2), "c" + "".join(rng.choices("bdfghkz0123456789", k=5)))}"' if made_up else ""
        body = re.sub(r' (class|id|role)="([^"]*)"', name_of, body)
        kept = {t for t in ("nav", "header", "footer", "aside", "article", "main", "section") if rng.random() < 0.2}
        return re.sub(r"<(/?)(nav|header|footer|aside|article|main|section)\b", lambda m: m.group(0) if m.group(2) in kept else f"<{m.group(1)}div", body)


def training_pages(n: int, seed: int = 17) -> list[tuple[list[Block], list[int]]]:
    """Blocks and labels (1: article) of made-up pages. A block with the mark \\x01 is the article's."""
    pages = _Pages(seed)
    out = []
    for _ in range(n):
        blocks = leaf_blocks(pages.page())
        labels = [int("\x01" in text) for text, _, _ in blocks]
        clean = [(" ".join(text.replace("\x01", " ").split()), place, linked) for text, place, linked in blocks]
        kept = [k for k, (text, _, _) in enumerate(clean) if text]
        out.append(([clean[k] for k in kept], [labels[k] for k in kept]))
    return [p for p in out if p[0]]


# ---------------------------------------------------------------------------------------------
# The field


class ChainField:
    """Weights of features by label, of label pairs and of the first label."""

    def __init__(self, index: dict[str, int], emit: np.ndarray, step: np.ndarray, start: np.ndarray):
        self.index, self.emit, self.step, self.start = index, emit, step, start
        # only what label 1 has over label 0 matters
        self.gain = dict(zip(index, (emit[:, 1] - emit[:, 0]).tolist(), strict=True))
        self.places: dict[tuple, float] = {}

    def _place(self, place: tuple) -> float:
        if len(self.places) > 50_000:
            self.places.clear()
        out = self.places[place] = sum(self.gain.get(f, 0.0) for f in place_features(place))
        return out

    def decode(self, blocks: list[Block]) -> list[int]:
        """Most likely labels, by Viterbi."""
        if not blocks:
            return []
        places, gain = self.places, self.gain
        gains = [(places[p] if p in places else self._place(p)) + sum([gain.get(f, 0.0) for f in own]) for p, own in page_features(blocks)]
        (s00, s01), (s10, s11) = self.step.tolist()
        a, b = float(self.start[0]), float(self.start[1]) + gains[0]
        back = []
        for x in gains[1:]:
            from_a, from_b = a + s00 >= b + s10, a + s01 >= b + s11
            back.append((0 if from_a else 1, 0 if from_b else 1))
            a, b = (a + s00 if from_a else b + s10), (a + s01 if from_b else b + s11) + x
        label = int(b > a)
        out = [label]
        for choice in reversed(back):
            label = choice[label]
            out.append(label)
        return out[::-1]


def _log_sum(x: np.ndarray, axis: int) -> np.ndarray:
    most = x.max(axis=axis, keepdims=True)
    return (most + np.log(np.exp(x - most).sum(axis=axis, keepdims=True))).squeeze(axis)


def fit_field(pages: list[tuple[list, list[int]]], epochs: int = EPOCHS, rate: float = 0.3, l2: float = 1e-4) -> ChainField:
    """Maximum likelihood with adaptive gradient steps, page by page in a fixed order."""
    index: dict[str, int] = {}
    rows = []
    for blocks, labels in pages:
        named = [place_features(place) + features for place, features in page_features(blocks)]
        own = [np.array([index.setdefault(f, len(index)) for f in features]) for features in named]
        rows.append((np.concatenate(own), np.repeat(np.arange(len(own)), [len(o) for o in own]), np.array(labels)))
    emit, step, start = np.zeros((len(index), 2)), np.zeros((2, 2)), np.zeros(2)
    seen = [np.full_like(w, 1e-6) for w in (emit, step, start)]
    for _ in range(epochs):
        for features, block, labels in rows:
            n = len(labels)
            scores = np.zeros((n, 2))
            np.add.at(scores, block, emit[features])
            forward, backward = np.zeros((n, 2)), np.zeros((n, 2))
            forward[0] = start + scores[0]
            for t in range(1, n):
                forward[t] = _log_sum(forward[t - 1][:, None] + step, 0) + scores[t]
            for t in range(n - 2, -1, -1):
                backward[t] = _log_sum(step + (scores[t + 1] + backward[t + 1])[None, :], 1)
            total = _log_sum(forward[-1], 0)
            given = np.exp(forward + backward - total)
            truth = np.zeros((n, 2))
            truth[np.arange(n), labels] = 1
            pairs = np.exp(forward[:-1, :, None] + step + (scores[1:] + backward[1:])[:, None, :] - total).sum(axis=0)
            np.subtract.at(pairs, (labels[:-1], labels[1:]), 1)
            slope = np.zeros_like(emit)
            np.add.at(slope, features, (given - truth)[block])
            for w, g, s in zip((emit, step, start), (slope + l2 * emit, pairs, given[0] - truth[0]), seen, strict=True):
                s += g * g
                w -= rate * g / np.sqrt(s)
    return ChainField(index, emit, step, start)


@lru_cache(maxsize=1)
def trained_field() -> ChainField:
    return fit_field(training_pages(TRAINING_PAGES))


def main_text(html: str | None, field: ChainField) -> tuple[str, int, int]:
    """Text of the blocks that are the article, their number, and the number of all blocks."""
    blocks = leaf_blocks(html)
    kept = [b[0] for b, label in zip(blocks, field.decode(blocks), strict=True) if label]
    return " ".join(kept), len(kept), len(blocks)


def _extracted(index: dict[str, int], emit: np.ndarray, step: np.ndarray, start: np.ndarray):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        field = ChainField(index, emit, step, start)
        for batch in batches:
            rows = [main_text(html, field) for html in batch["html"]]
            texts, kept, blocks = zip(*rows, strict=True) if rows else ((), (), ())
            yield pd.DataFrame({"page_id": batch["page_id"].astype("Int64"), "url": batch["url"], "text": texts, "n_chars": [len(t) for t in texts], "n_kept": kept, "n_blocks": blocks})

    return run


def extract_main_text(pages: DataFrame) -> DataFrame:
    """(page_id, url, html, ...) -> page_id, url, text, n_chars, n_kept, n_blocks, one row for each row.

    text is the article's blocks in page order, joined by one space; character references are decoded
    and white space inside a block is one space. n_chars counts its code points, n_kept and n_blocks the
    blocks that are the article and all blocks. Null or empty html, and a page without an article, give
    an empty text. Nothing is cut off, however long the page or deep its elements; a malformed
    declaration is read as a comment. Null page_id and url stay; other columns are ignored; an empty table gives no rows.
    """
    field = trained_field()
    own = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), F.col("html").cast("string").alias("html"))
    return own.mapInPandas(_extracted(field.index, field.emit, field.step, field.start), "page_id long, url string, text string, n_chars long, n_kept long, n_blocks long")
