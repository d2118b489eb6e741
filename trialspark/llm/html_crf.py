"""Main-text extraction by a linear-chain conditional random field over DOM leaf blocks.

A page is read into leaf blocks (runs of text between block-level tags) with the tags, classes and ids above
them. Two states, content and boilerplate, are chained in page order. Features are the ancestors within the
block's article, apart from those above it, the hints of their classes, those of the neighbouring blocks, and the
block's text. Weights are fitted to labelled pages, which are written here from many layouts, and the best states
are found by Viterbi. Reading and decoding are linear in the page, whatever its nesting.
"""

from __future__ import annotations

import html
import random
import re
from functools import lru_cache
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from .common import map_rows, read, schema_with, tune, with_columns

TRAIN_PAGES, SEED, ROUNDS, PENALTY = 500, 5, 140, 1e-3

BLOCKS = frozenset("address article aside blockquote body button caption center dd details dialog dir div dl dt fieldset figcaption figure footer form frameset h1 h2 h3 h4 h5 h6 head header hgroup hr html legend li main menu nav ol optgroup option p pre search section select summary table tbody td tfoot th thead title tr ul".split())
VOID = frozenset("area base br col embed frame hr img input link meta param source track wbr".split())
#: Elements whose inside is no text of the page.
RAW = frozenset("script style noscript template textarea svg math iframe object canvas audio video noembed noframes xmp".split())
#: What a start tag ends when it is still open: elements whose end tag may be left out.
ENDS = {"li": ("li",), "dt": ("dt", "dd"), "dd": ("dt", "dd"), "tr": ("tr", "td", "th"), "td": ("td", "th"), "th": ("td", "th"), "option": ("option",)}
FENCES = frozenset("ul ol dl table article section div nav aside main body blockquote form td header footer".split())
TAG = re.compile(r"<!--.*?(?:-->|\Z)|<!\[CDATA\[.*?(?:\]\]>|\Z)|<[!?][^>]*+(?:>|\Z)|<(/?)([a-zA-Z][a-zA-Z0-9:-]*+)((?:[^<>\"']++|\"[^\"]*+\"|'[^']*+')*+)>|<(/?)([a-zA-Z][a-zA-Z0-9:-]*+)([^>]*+)(?:>|\Z)", re.S)
NAMES = re.compile(r"(?i)\b(?:class|id|role|aria-label)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+))")
UNSEEN = re.compile(r"(?i)(?<![\w-])hidden(?![\w-])|display\s*:\s*none|aria-hidden\s*=\s*[\"']?true")
WORD = re.compile(r"[a-z]+")

#: Words of class, id and role that hint at a block's part, by group.
HINTS = {
    "advert": "ad ads adv advert advertisement adsense banner promo promotion promoted sponsor sponsored dfp outbrain taboola",
    "menu": "nav navbar navigation menu breadcrumb breadcrumbs toc pagination pager tabs toolbar skip",
    "side": "sidebar side aside widget widgets related recommended popular trending more",
    "comment": "comment comments reply replies respondent disqus discussion thread reader readers",
    "notice": "cookie cookies notice consent gdpr popup modal alert overlay newsletter subscribe subscription signup paywall",
    "frame": "header footer foot masthead topbar bottom copyright legal colophon",
    "share": "share sharing social follow tags meta byline",
    "form": "form search login register contact poll",
    "body": "content article post entry main story body text prose page",
}
HINT_OF = {w: g for g, words in HINTS.items() for w in words.split()}
GROUPS = (*HINTS, "hidden")
TAGS = ("nav", "header", "footer", "aside", "form", "section", "head", "title", "button", "li", "table", "figure", "figcaption", "blockquote", "h1", "h2", "h3", "p", "pre", "dialog", "address", "select", "label", "div", "dl", "details")
SCOPED = (*(f"tag {t}" for t in TAGS), *(f"hint {g}" for g in GROUPS))
TEXT = ("short", "middle", "long", "links_some", "links_all", "linked_item", "linked_part", "stop", "copyright", "told", "under_told", "no_article", "bare", "first", "in article", "in main", "nested", "bias")
FEATURES = (*SCOPED, *(f"above {s}" for s in SCOPED), *(f"{side} hint {g}" for g in GROUPS for side in ("before", "after")), *TEXT)
AT = {f: i for i, f in enumerate(FEATURES)}
#: What notices, forms and headings of comment and link lists say.
TOLD = re.compile(r"(?i)\b(?:cookies?|newsletter|subscribe|sign up|log ?in|your e-?mail|advertisement|sponsored|comments?|repl(?:y|ies)|related|read more|most read|share this|follow us|privacy policy|terms of use|we value your)\b")
NONE: frozenset[str] = frozenset()


class Block(NamedTuple):
    """A leaf block: its text, characters of it in links, and the scope that it stands in."""

    text: str
    linked: int
    scope: Scope


class Scope(NamedTuple):
    """An open element: features of what is within its article (or the page), of what is above that, the article's tag, whether it lies in another one."""

    tag: str
    inner: frozenset[str]
    outer: frozenset[str]
    article: str
    nested: bool


def open_scope(above: Scope, tag: str, attrs: str) -> Scope:
    own = {f"tag {tag}"} if tag in TAGS else set()
    if attrs:
        own |= {f"hint {HINT_OF[w]}" for x in NAMES.findall(attrs) for w in WORD.findall("".join(x).lower()) if w in HINT_OF}
        if UNSEEN.search(attrs):
            own.add("hint hidden")
    if tag in ("article", "main"):
        return Scope(tag, frozenset(own), above.outer | above.inner, tag, above.article == "article")
    return Scope(tag, above.inner if own <= above.inner else above.inner | own, above.outer, above.article, above.nested)


def leaf_blocks(page: str) -> list[Block]:
    """The non-empty leaf blocks in page order.

    Sets of features are shared by all elements that add nothing, and open elements are found by name, so neither
    deep nesting nor end tags of what isn't open cost more than their own length.
    """
    stack, where, fences = [Scope("", NONE, NONE, "", False)], {}, []
    out, held, linked, at, size = [], [], 0, 0, len(page)

    def flush() -> None:
        nonlocal linked
        text = " ".join("".join(held).split())
        if text:
            out.append(Block(text, linked, stack[-1]))
        held.clear()
        linked = 0

    def close(down_to: int) -> None:
        while len(stack) > down_to:
            where[stack.pop().tag].pop()
        while fences and fences[-1] >= down_to:
            fences.pop()

    def last(names: tuple[str, ...]) -> int:
        return max((where[n][-1] for n in names if where.get(n)), default=0)

    def close_open(names: tuple[str, ...]) -> None:
        """Close the innermost of these, unless a fence stands between."""
        i = last(names)
        if i and not (fences and fences[-1] > i):
            close(i)

    while at < size:
        m = TAG.search(page, at)
        data = page[at : m.start() if m else size]
        if data:
            data = html.unescape(data)
            held.append(data)
            if where.get("a"):
                linked += len(data.strip())
        if not m:
            break
        at = m.end()
        end, name, attrs = (m[1], m[2], m[3]) if m[2] else (m[4], m[5], m[6])
        if not name:
            continue
        name = name.lower()
        if name in RAW and not end:
            if not attrs.rstrip().endswith("/"):
                stop = re.compile(rf"</{name}\b[^>]*+(?:>|\Z)", re.I).search(page, at)
                at = stop.end() if stop else size
            continue
        if name in BLOCKS:
            flush()
        elif name == "br":
            held.append(" ")
        if end:
            if name in BLOCKS and where.get(name):
                close(where[name][-1])
            elif name not in BLOCKS:
                close_open((name,))
        elif name not in VOID and not attrs.rstrip().endswith("/"):
            if name in BLOCKS:  # a block ends an open paragraph
                close_open(("p",))
            if name in ENDS:
                close_open(ENDS[name])
            where.setdefault(name, []).append(len(stack))
            if name in FENCES:
                fences.append(len(stack))
            stack.append(open_scope(stack[-1], name, attrs))
    flush()
    return out


def matrix(blocks: list[Block]) -> np.ndarray:
    x = np.zeros((len(blocks), len(FEATURES)), np.float32)
    article = any(b.scope.article for b in blocks)
    hints = [{s for s in b.scope.inner if s.startswith("hint ")} for b in blocks]
    heading_told = False
    for i, (text, linked, scope) in enumerate(blocks):
        row, n = x[i], len(text)
        found = [*scope.inner, *(f"above {s}" for s in scope.outer)]
        found += [f"before {h}" for h in (hints[i - 1] if i else ())] + [f"after {h}" for h in (hints[i + 1] if i + 1 < len(blocks) else ())]
        told = TOLD.search(text) is not None if n < 200 else False
        if scope.tag in ("h1", "h2", "h3", "h4", "h5", "h6"):
            heading_told = told
        most = linked > 0.8 * n
        flags = {
            "short": n < 40, "middle": 40 <= n < 120, "long": n >= 120, "links_some": linked > 0.3 * n, "links_all": most, "linked_item": most and "tag li" in scope.inner, "linked_part": most and scope.tag == "p" and bool(scope.article),
            "stop": text[-1] in ".!?:;\"'”»…", "copyright": "©" in text or "all rights" in text.lower(), "told": told, "under_told": heading_told, "no_article": not article, "bare": not scope.inner - {"tag p"} and not scope.article, "first": i == 0,
            "in article": scope.article == "article", "in main": scope.article == "main", "nested": scope.nested, "bias": True,
        }
        row[[AT[f] for f in found] + [AT[f] for f, on in flags.items() if on]] = 1
    return x


class Chain:
    """Two states: 0 boilerplate, 1 content; weights for state 1, and transition scores."""

    def __init__(self):
        self.w, self.t = np.zeros(len(FEATURES)), np.zeros((2, 2))

    def fit(self, pages: list[tuple[np.ndarray, np.ndarray]]) -> Chain:
        """Adaptive gradient ascent on the penalised log-likelihood, over all pages at once, padded to one length."""
        longest, n = max(len(y) for _, y in pages), len(pages)
        x, y, on = np.zeros((n, longest, len(FEATURES)), np.float32), np.zeros((n, longest), int), np.zeros((n, longest), bool)
        for i, (a, b) in enumerate(pages):
            x[i, : len(b)], y[i, : len(b)], on[i, : len(b)] = a, b, True
        flat, pair = x.reshape(n * longest, -1), on[:, 1:]
        seen = np.array([[((y[:, :-1] == a) & (y[:, 1:] == b) & pair).sum() for b in (0, 1)] for a in (0, 1)], float)
        first, second = [np.zeros(len(self.w) + 4) for _ in range(2)]
        for step in range(1, ROUNDS + 1):
            e = np.stack([np.zeros((n, longest)), (flat @ self.w.astype(np.float32)).reshape(n, longest)], axis=2)
            a, b = np.zeros((n, longest, 2)), np.zeros((n, longest, 2))
            a[:, 0] = e[:, 0]
            for k in range(1, longest):
                a[:, k] = np.where(on[:, k, None], e[:, k] + np.logaddexp(a[:, k - 1, :1] + self.t[0], a[:, k - 1, 1:] + self.t[1]), a[:, k - 1])
            for k in range(longest - 2, -1, -1):
                s = e[:, k + 1] + b[:, k + 1]
                b[:, k] = np.where(on[:, k + 1, None], np.logaddexp(s[:, :1] + self.t[:, 0], s[:, 1:] + self.t[:, 1]), 0)
            z = np.logaddexp(a[:, -1, 0], a[:, -1, 1])
            p = np.exp(a[:, :, 1] + b[:, :, 1] - z[:, None]) * on
            s = e[:, 1:] + b[:, 1:]
            joint = np.exp(a[:, :-1, :, None] + self.t + s[:, :, None, :] - z[:, None, None, None]) * pair[:, :, None, None]
            gradient = np.concatenate([((y - p) * on).ravel().astype(np.float32) @ flat, (seen - joint.sum(axis=(0, 1))).ravel()]) / n
            gradient -= PENALTY * np.concatenate([self.w, self.t.ravel()])
            first, second = 0.9 * first + 0.1 * gradient, 0.99 * second + 0.01 * gradient**2
            move = 0.15 * (first / (1 - 0.9**step)) / (np.sqrt(second / (1 - 0.99**step)) + 1e-8)
            self.w, self.t = self.w + move[:-4], self.t + move[-4:].reshape(2, 2)
        return self

    def decode(self, x: np.ndarray) -> list[int]:
        """Viterbi; of equal paths, boilerplate first."""
        one, back = (x @ self.w).tolist(), []
        (t00, t01), (t10, t11) = self.t.tolist()
        a, b = 0.0, one[0]
        for s in one[1:]:
            back.append((a + t00 < b + t10, a + t01 < b + t11))
            a, b = max(a + t00, b + t10), max(a + t01, b + t11) + s
        state, out = int(b > a), []
        for steps in reversed(back):
            out.append(state)
            state = int(steps[state])
        return [*reversed([*out, state])] if one else []


GOOD, BAD = "\x02", "\x03"


class Writer:
    """Writes labelled pages: each block's text begins with GOOD in content and BAD in boilerplate."""

    def __init__(self, seed: int):
        self.rng = random.Random(seed)

    def some(self, chance: float) -> bool:
        return self.rng.random() < chance

    def one(self, *options):
        return self.rng.choice(options)

    def word(self) -> str:
        return "".join(self.rng.choice("etaoinshrdlucmfwéü") for _ in range(self.rng.randint(2, 9)))

    def line(self, low: int, high: int) -> str:
        return " ".join(self.word() for _ in range(self.rng.randint(low, high)))

    def good(self, low: int = 1, high: int = 60) -> str:
        return GOOD + self.line(low, high).capitalize() + self.one(".", ".", "", "?")

    def bad(self, low: int = 1, high: int = 12) -> str:
        told = self.one("Cookies ", "Subscribe ", "Advertisement ", "Sponsored ", "Share this ", "Read more ", "Log in ") if self.some(0.15) else ""
        return BAD + told + self.line(low, high) + self.one("", "", ".")

    def link(self, mark: str = BAD, low: int = 1, high: int = 3) -> str:
        return f'<a href="/{self.word()}">{mark}{self.line(low, high)}</a>'

    def many(self, form: str, low: int, high: int, part) -> str:
        return "".join(form.format(part()) for _ in range(self.rng.randint(low, high)))

    def named(self, *names: str) -> str:
        return f'{self.one("class", "class", "id")}="{self.one(*names)}"'

    def plain_div(self, inside: str) -> str:
        return self.one("<div>{}</div>", f'<div class="{self.word()}">{{}}</div>', "<section>{}</section>", "{}").format(inside)

    def menu(self) -> str:
        items = self.many("<li>{}</li>", 2, 9, self.link)
        return self.one(f"<nav><ul>{items}</ul></nav>", f"<div {self.named('menu', 'main-nav', 'navbar', 'breadcrumbs')}><ul>{items}</ul></div>", f"<header><nav>{items}</nav></header>", f"<header><p>{self.bad(1, 8)}</p><ul>{items}</ul></header>", f"<ul>{items}</ul>", f"<nav>{self.many('{} ', 2, 6, self.link)}</nav>")

    def advert(self) -> str:
        inside = self.bad(2, 30)
        return self.one(f"<div {self.named('ad', 'ads', 'advert', 'banner-ad', 'sponsored', 'promo')}>{inside}</div>", f"<aside>{inside}</aside>", f"<aside {self.named('ad-box', 'related')}><p>{inside}</p></aside>", f"<ins {self.named('adsense')}><p>{inside}</p></ins>")

    def notice(self) -> str:
        return self.one(f"<div {self.named('cookie-notice', 'consent', 'newsletter-signup', 'popup')}><p>{self.bad(4, 25)}</p><button>{self.bad(1, 2)}</button></div>", f'<div role="alert">{self.bad(3, 20)}</div>', f"<dialog>{self.bad(3, 9)}<p>{self.bad(4, 20)}</p></dialog>", f"<div hidden><p>{self.bad(3, 20)}</p></div>", f'<p style="display:none">{self.bad(3, 20)}</p>')

    def form(self) -> str:
        fields = f"<label>{self.bad(1, 3)}</label><input name=q>" + self.one("", f"<select><option>{self.bad(1, 2)}</option><option>{self.bad(1, 2)}</option></select>")
        return f'<form action="/{self.word()}">' + self.one(fields, f"<p>{self.bad(1, 20)}</p>{fields}", f"<p>{self.bad(1, 25)}</p>", f"<h3>{self.bad(1, 6)}</h3><div>{self.bad(2, 30)}</div>{fields}", f"<fieldset><legend>{self.bad(1, 4)}</legend>{fields}</fieldset>") + self.one(f"<button>{self.bad(1, 2)}</button>", "") + "</form>"

    def comments(self) -> str:
        said = lambda: BAD + self.line(3, 50) + "."
        each = self.one("<p>{}</p>", '<div class="comment"><p>{}</p></div>', '<article class="comment"><p>{}</p></article>', "<article><p>{}</p></article>", "<li>{}</li>")
        head = self.one("Comments", "3 comments", "Reader comments", "Replies", self.word())
        return self.one("<section {0}><h2>{1}</h2>{2}</section>", "<div {0}><h3>{1}</h3>{2}</div>").format(self.named("comments", "comment-list", "reader-comments", "replies"), BAD + head, self.many(each, 1, 5, said))

    def side(self) -> str:
        inside = f"<h3>{self.bad(1, 4)}</h3>" + self.one("<ul>" + self.many("<li>{}</li>", 2, 6, self.link) + "</ul>", f"<p>{self.bad(5, 40)}</p>")
        return self.one(f"<aside>{inside}</aside>", f"<div {self.named('sidebar', 'widget', 'related-posts', 'side')}>{inside}</div>")

    def share(self) -> str:
        return f'<div {self.named("share", "social", "post-meta", "byline")}>{self.link()} {self.line(0, 4)}</div>'

    def foot(self) -> str:
        inside = self.one(f"{BAD}&copy; {self.line(1, 6)}", f"{BAD}© 2024 {self.line(1, 4)} &middot; {self.line(1, 9)}.", self.bad(2, 12))
        return self.one(f"<footer>{inside}</footer>", f"<footer><p>{inside}</p></footer>", f"<div {self.named('footer', 'site-footer')}><p>{inside}</p></div>")

    def text(self) -> str:
        r = self.one
        return r(
            *[f"<p>{self.good()}</p>"] * 8, f"<p>{self.good()}<br>{self.line(2, 30)}.", f"<p><b>{self.good(1, 8)}<br><p>{self.good()}</p>", f"<h2>{self.good(1, 7)}</h2>", f"<h3>{self.good(1, 7)}</h3><p>{self.good()}</p>", f"<ul><li>{self.good(1, 12)}</li><li>{self.good(1, 12)}</li></ul>",
            f"<blockquote><p>{self.good(4, 30)}</p></blockquote>", f'<p>{self.good(3, 30)} <a href="/x">{self.line(1, 4)}</a> {self.line(2, 20)}.</p>', f'<p>{self.good(1, 2)} <a href="/x">{self.line(6, 30)}</a></p>', f"<p>{self.link(GOOD, 3, 20)}</p>", f"<ul><li>{self.good(1, 3)} <a href=x>{self.line(2, 8)}</a> {self.line(2, 9)}</li></ul>",
            f"<figure><img src=x><figcaption>{self.good(2, 12)}</figcaption></figure>", f"<table><tr><th>{self.good(1, 3)}</th><td>{self.good(1, 3)}</td></tr></table>", f"<pre>{self.good(3, 20)}</pre>", f"<p>{self.good(1, 2)}</p>", f"<div>{self.good(1, 40)}</div>", f"<section><h2>{self.good(1, 5)}</h2><p>{self.good()}</p></section>",
            f"<dl><dt>{self.good(1, 3)}<dd>{self.good(2, 12)}</dl>", f"<details><summary>{self.good(1, 5)}</summary><p>{self.good()}</p></details>", f"<p>{GOOD}{self.line(2, 9)} {r('cookies', 'comments', 'related', 'subscribe')} {self.line(3, 30)}.</p>",
        )

    def inside(self) -> str:
        """What an article holds: its heading, its text, and boilerplate between them."""
        head = self.one(*[f"<h1>{self.good(1, 12)}</h1>"] * 3, f"<header><h1>{self.good(1, 12)}</h1></header>", f"<header><h1>{self.good(1, 12)}</h1><p {self.named('byline', 'meta')}>{self.bad(1, 6)}</p></header>", "")
        middle = [self.text() for _ in range(self.rng.randint(1, 12))]
        for extra, chance in ((self.advert, 0.25), (self.share, 0.15), (self.form, 0.2), (self.side, 0.12), (self.notice, 0.08), (self.menu, 0.06)):
            if self.some(chance):
                middle.insert(self.rng.randint(0, len(middle)), extra())
        if self.some(0.2):
            middle.append(self.comments())
        if self.some(0.08):
            middle.append(f"<footer>{self.bad(1, 9)}</footer>")
        return head + "".join(middle)

    def page(self) -> str:
        if self.some(0.08):  # no markup, or little
            return self.one(GOOD + self.line(1, 60), "".join(f"<p>{self.good()}</p>" for _ in range(self.rng.randint(1, 6))), "<p>" + self.good(1, 20), f"<html><body>{self.good(1, 30)}</body></html>", f"<h1>{self.good(1, 6)}</h1><p>{self.good()}</p>", f"<article><p>{self.good()}</p>{self.form()}<p>{self.good(1, 4)}</p></article>")
        inside, div = self.inside(), lambda x: f"<div {self.named('content', 'article-body', 'post', 'entry-content', 'story', self.word())}>{x}</div>"
        shell = self.one(*[f"<article>{inside}</article>"] * 4, f"<main><article>{inside}</article></main>", f"<main>{inside}</main>", div(inside), f"<article {self.named('post', 'story')}>{div(inside)}</article>", f"<main>{div(inside)}</main>")
        before = [x() for x, c in ((self.notice, 0.3), (self.menu, 0.9), (self.advert, 0.6), (self.form, 0.2), (self.side, 0.2)) if self.some(c)]
        after = [x() for x, c in ((self.comments, 0.2), (self.side, 0.3), (self.advert, 0.2), (self.form, 0.2), (self.notice, 0.2), (self.foot, 0.9), (self.notice, 0.1)) if self.some(c)]
        if "<article" in shell and self.some(0.3):
            after.insert(0, self.plain_div(f"<p>{self.bad(2, 20)}</p>"))
        body = "".join(before) + shell + "".join(after)
        if self.some(0.1):
            body = self.one("<form id=aspnet>{}</form>", "<div class=wrapper>{}</div>", '<div id="page">{}</div>').format(body)
        return self.one("", "<!DOCTYPE html>") + f"<html><head><title>{self.bad(2, 12)}</title></head><body>{body}" + self.one("", "</body></html>")


def labelled_pages(n: int, seed: int) -> list[tuple[list[Block], list[int]]]:
    """The blocks of written pages, without their marks, and their states."""
    writer, out = Writer(seed), []
    while len(out) < n:
        blocks = leaf_blocks(writer.page())
        if blocks and all(b.text[0] in GOOD + BAD for b in blocks):
            clean = [b._replace(text=b.text.replace(GOOD, "").replace(BAD, "").strip() or "-") for b in blocks]
            out.append((clean, [int(b.text[0] == GOOD) for b in blocks]))
    return out


@lru_cache(maxsize=1)
def model(pages: int = TRAIN_PAGES, seed: int = SEED) -> Chain:
    return Chain().fit([(matrix(blocks), np.array(states)) for blocks, states in labelled_pages(pages, seed)])


def main_text(page: str | None, chain: Chain) -> str:
    blocks = leaf_blocks(page or "")
    if not blocks:
        return ""
    return "\n\n".join(b.text for b, s in zip(blocks, chain.decode(matrix(blocks))) if s)


def extract(pages: DataFrame) -> DataFrame:
    """pages with text, the main text of html (empty if none), and n_chars (its code points).

    Null and empty html give the empty text; broken, cut-off and very long pages are read as far as they go, all
    of them, in time linear in their length; a page without markup is text. Paths of equal score go to boilerplate.
    Repeated rows give repeated results, an empty table none. Columns of pages named text or n_chars are replaced.
    """
    tune(pages.sparkSession)
    pages = pages.drop("text", "n_chars")
    shared = pages.sparkSession.sparkContext.broadcast(model())

    def add(batch: pa.RecordBatch) -> pa.RecordBatch:
        texts = [main_text(p, shared.value) for p in batch.column("html").to_pylist()]
        return with_columns(batch, text=pa.array(texts, pa.string()), n_chars=pa.array(list(map(len, texts)), pa.int64()))

    return map_rows(pages, add, schema_with(pages, text="string", n_chars="bigint"))


def op8(spark, sf_dir):
    return extract(read(spark, sf_dir, "pages").select("page_id", "url", "html")).select("page_id", "url", "text", "n_chars")
