"""HTML extraction by a recurrent block labeller.

A page is read as the sequence of its text blocks (leaves), each with its tag path. Hashed
vectors of path and words go through a bidirectional LSTM written in numpy, so that every
block is judged by the whole page, and blocks labelled as content are joined to the text.

The network is trained here, on windows of a bounded sample of the pages. Labels come from
several weak sources that vote: landmark elements, class and id names, link and text
density, and texts that stand on several pages. None of them is an input. Training pages are
varied: content moves to other containers, boilerplate (menus, notices, adverts, forms,
comments, with the words of such) is planted around and inside the article, and in half of
them all names are replaced by made-up ones, so that words, links and the neighbours decide.
"""

from __future__ import annotations

import json
import re
import zlib
from collections import Counter
from collections.abc import Iterator
from html.parser import HTMLParser

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessella.llm.sample import bounded

#: Pages to train on at most, and windows of each; a window has at most so many blocks in a row,
#: whole, and so many characters in them. A block that has more is in no window.
SAMPLE_PAGES, WINDOWS, WINDOW_BLOCKS, WINDOW_CHARS = 300, 2, 300, 200_000
PATH_DIM, WORD_DIM, EXTRA, HIDDEN, EPOCHS, SEED = 96, 192, 6, 16, 36, 13
BATCH_CELLS = 1 << 16
#: Blocks of a long page that the network reads at once; it goes on where it stopped.
STRETCH = 2048

SILENT = frozenset("script style noscript template head title meta link svg canvas iframe object audio video map select option button textarea datalist".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
#: What may stand in a head; anything else begins the body.
HEAD = frozenset("head base basefont bgsound link meta title script style noscript noframes template".split())
#: Silent elements that are passed over where the page has no end tag for them any more.
ENDED = ("button", "noscript", "object", "iframe", "template", "svg", "canvas", "audio", "video", "map", "select", "datalist")
INLINE = frozenset(
    "a abbr acronym b bdi bdo big cite code data del dfn em font i ins kbd label mark q s samp small span strike strong sub sup time tt u var wbr".split()
)
#: Elements whose blocks are not the main text.
ASIDE = frozenset("nav footer aside form menu dialog".split())
#: Words of class, id or role names that say the same, if the rest of the name says nothing else.
NAMES = frozenset(
    "ad ads advert advertisement adverts banner breadcrumb breadcrumbs comment comments cookie cookies copyright disqus footer header "
    "menu modal nav navbar navigation newsletter notice notices popup promo promoted recommended related reply replies respond share sharing sidebar "
    "signup social sponsor sponsored subscribe toolbar widget widgets complementary contentinfo search consent gdpr overlay".split()
)
NEUTRAL = frozenset("site page global main primary secondary left right top bottom list item items box container wrapper wrap block slot section inner outer links bar area row col".split())
#: Names of what holds the main text.
HOLDERS = frozenset("article main content post entry story body text".split())
#: An element that closes an open one of these when it begins.
CLOSES = {"p": "p", "li": "li", "td": "td", "th": "td", "tr": "tr", "dt": "dt", "dd": "dd", "option": "option"}
_BLANK = re.compile(r"\s+")
_NAME = re.compile(r"[a-z0-9_-]+")
_PART = re.compile(r"[a-z]+")


class _Blocks(HTMLParser):
    """Text blocks of a page in order: (path, text, characters in links)."""

    def __init__(self, html: str = ""):
        super().__init__(convert_charrefs=True)
        low = html.lower()
        self.ends = {tag: low.count("</" + tag) for tag in ENDED}
        if not self.ends["iframe"]:
            # Else the parser takes all that follows as its raw text.
            self.CDATA_CONTENT_ELEMENTS = tuple(t for t in self.CDATA_CONTENT_ELEMENTS if t != "iframe")
        self.stack: list[tuple[str, str]] = []
        self.silent = 0
        self.links = 0
        self.blocks: list[tuple[tuple[str, ...], str, int]] = []
        self.parts: list[str] = []
        self.linked = 0

    def flush(self) -> None:
        if self.parts:
            text = _BLANK.sub(" ", "".join(self.parts)).strip(" ")
            if text:
                self.blocks.append((tuple(label for tag, label in self.stack if tag not in INLINE), text, min(self.linked, len(text))))
        self.parts, self.linked = [], 0

    def _end_head(self) -> None:
        """The body begins, with or without an end of the head; a template keeps what it holds."""
        for k in range(len(self.stack) - 1, -1, -1):
            if self.stack[k][0] == "head":
                self.flush()
                self._pop(k)
                return
            if self.stack[k][0] == "template":
                return

    def handle_starttag(self, tag: str, attrs) -> None:
        if self.silent and tag not in HEAD:
            self._end_head()
        if tag in INLINE:
            self.links += tag == "a"
            self.stack.append((tag, tag))
            return
        self.flush()
        if tag in VOID or self.ends.get(tag) == 0:
            return
        shut = CLOSES.get(tag)
        if shut or tag not in SILENT:
            self._imply(tag, shut)
        # Names of the root and the body tell nothing about a block.
        names = "" if tag in ("html", "body") else " ".join(v for k, v in attrs if v and k in ("class", "id", "role"))
        label = tag + "".join("." + n for n in _NAME.findall(names.lower())) if names else tag
        self.stack.append((tag, label))
        self.silent += tag in SILENT

    def _imply(self, tag: str, shut: str | None) -> None:
        """A block closes an open paragraph; list items and cells close their like."""
        for k in range(len(self.stack) - 1, -1, -1):
            open_ = self.stack[k][0]
            if open_ == "p" or (shut and open_ == shut):
                self._pop(k)
                return
            if open_ not in INLINE and open_ not in ("p",):
                return

    def _pop(self, k: int) -> None:
        for tag, _ in self.stack[k:]:
            self.silent -= tag in SILENT
            self.links -= tag == "a"
        del self.stack[k:]

    def handle_startendtag(self, tag: str, attrs) -> None:
        if tag in ENDED:
            self.ends[tag] += 1
        self.handle_starttag(tag, attrs)
        if tag not in VOID:
            self.handle_endtag(tag)

    def handle_endtag(self, tag: str) -> None:
        if self.ends.get(tag):
            self.ends[tag] -= 1
        if tag not in INLINE:
            self.flush()
        for k in range(len(self.stack) - 1, -1, -1):
            if self.stack[k][0] == tag:
                self._pop(k)
                return
            # A stray inline end does not reach out of its block.
            if tag in INLINE and self.stack[k][0] not in INLINE:
                return

    def handle_data(self, data: str) -> None:
        if self.silent and self.stack[-1][0] == "head" and data.strip():
            self._end_head()
        if not self.silent:
            self.parts.append(data)
            if self.links:
                self.linked += len(data.strip())


def blocks(html: str | None) -> list[tuple[tuple[str, ...], str, int]]:
    parser = _Blocks(html or "")
    try:
        parser.feed(html or "")
        parser.close()
    except AssertionError:
        # The parser gives up on some broken declarations; what it read so far stands.
        pass
    parser.flush()
    return parser.blocks


def _says(name: str, words: frozenset[str]) -> bool:
    """A whole name says something if one of its parts does and no part says anything else."""
    parts = _PART.findall(name)
    return any(p in words for p in parts) and all(p in words or p in NEUTRAL for p in parts)


def landmarks(path: tuple[str, ...]) -> int:
    """1 inside an article or main element, -1 inside an element of boilerplate, else 0."""
    inside = False
    for label in path:
        tag = label.split(".")[0]
        inside = inside or tag in ("article", "main")
        if tag in ASIDE or (tag == "header" and not inside):
            return -1
    return int(inside)


def named(path: tuple[str, ...]) -> int:
    """By names alone: -1 for boilerplate, 1 for a holder of the main text, else 0."""
    names = [n for label in path for n in label.split(".")[1:]]
    if any(_says(n, NAMES) for n in names):
        return -1
    return int(any(_says(n, HOLDERS) for n in names))


def density(text: str, linked: int) -> int:
    """By links and length: -1 for mostly links, 1 for a stretch of prose, else 0."""
    if 2 * linked >= len(text):
        return -1
    return int(len(text) >= 80 and text[-1] in ".!?…:;\"»”)") - int(len(text) < 12)


def teacher(path: tuple[str, ...], text: str, linked: int, pages: int = 1) -> int:
    """The sources' joint label of a block whose text stands on ``pages`` pages of the sample.

    A sign of boilerplate in the structure or the names outweighs the others; what no
    structure speaks for needs the look of prose.
    """
    a, b, c = landmarks(path), named(path), density(text, linked)
    if a < 0 or b < 0 or (pages >= 3 and a == 0):
        return 0
    votes = 2 * a + b + c
    return int(votes > 0 or (votes == 0 and a + b == 0 and 2 * linked < len(text) and len(text) >= 25))


_PATHS: dict[tuple[str, ...], np.ndarray] = {}


def _path_vector(path: tuple[str, ...]) -> np.ndarray:
    """Hashed tags, names and their parts, and pairs of tags along the path; the innermost count once more."""
    found = _PATHS.get(path)
    if found is None:
        found = np.zeros(PATH_DIM, np.float32)
        tags = [label.split(".")[0] for label in path]
        tokens = [t for label in path for t in label.split(".")]
        tokens += [f"{n}~" for label in path for name in label.split(".")[1:] for n in _PART.findall(name)]
        tokens += [f"{x}>{y}" for x, y in zip(tags, tags[1:])] + [f"/{t}" for t in tags[-2:]]
        for t in tokens:
            h = zlib.crc32(t.encode())
            found[h % PATH_DIM] += 1.0 if h & 0x10000 else -1.0
        found /= max(1.0, float(np.abs(found).max()))
        if len(_PATHS) < 100_000:
            _PATHS[path] = found
    return found


def vectors(page: list[tuple[tuple[str, ...], str, int]], first: int = 0, total: int | None = None) -> np.ndarray:
    """(blocks, D): path, all words hashed, and a few figures of each block. ``page`` is all of it, or the blocks from ``first`` on of ``total``."""
    total = len(page) if total is None else total
    out = np.zeros((len(page), PATH_DIM + WORD_DIM + EXTRA), np.float32)
    crc = zlib.crc32
    for i, (path, text, linked) in enumerate(page):
        words = text.lower().split(" ")
        out[i, :PATH_DIM] = _path_vector(path)
        bag = np.bincount([crc(w.encode("utf-8", "surrogatepass")) % WORD_DIM for w in words], minlength=WORD_DIM)
        out[i, PATH_DIM : PATH_DIM + WORD_DIM] = np.sqrt(bag / len(words))
        n = len(text)
        ends = text[-1] in ".!?…:;"
        out[i, PATH_DIM + WORD_DIM :] = (np.log1p(n) / 8, np.log1p(len(words)) / 6, linked / n, float(ends), n / len(words) / 20, (first + i) / total)
    return out


class Labeller:
    """Bidirectional LSTM with one logistic output per block."""

    NAMES = ("wf", "uf", "bf", "wb", "ub", "bb", "v", "c")

    def __init__(self, weights: dict[str, np.ndarray]):
        self.w = weights

    @classmethod
    def fresh(cls, seed: int = SEED) -> Labeller:
        rng, d = np.random.default_rng(seed), PATH_DIM + WORD_DIM + EXTRA
        w = {}
        for s in "fb":
            w["w" + s] = rng.normal(0, 1 / np.sqrt(d), (d, 4 * HIDDEN))
            w["u" + s] = rng.normal(0, 1 / np.sqrt(HIDDEN), (HIDDEN, 4 * HIDDEN))
            w["b" + s] = np.zeros(4 * HIDDEN)
            w["b" + s][HIDDEN : 2 * HIDDEN] = 1.0
        return cls(w | {"v": rng.normal(0, 0.3, (d + 2 * HIDDEN,)), "c": np.zeros(1)})

    def _direction(self, x: np.ndarray, mask: np.ndarray, s: str, keep: bool, state: tuple | None = None):
        """Hidden states for (pages, steps, D), and the last state; a masked step leaves the state as it was."""
        n, t, _ = x.shape
        pre = x @ self.w["w" + s] + self.w["b" + s]
        h, c = state or (np.zeros((n, HIDDEN)), np.zeros((n, HIDDEN)))
        out, trace = np.zeros((n, t, HIDDEN)), []
        for k in range(t) if s == "f" else range(t - 1, -1, -1):
            z = pre[:, k] + h @ self.w["u" + s]
            i, f, o = (1 / (1 + np.exp(-z[:, a * HIDDEN : (a + 1) * HIDDEN])) for a in (0, 1, 2))
            g = np.tanh(z[:, 3 * HIDDEN :])
            m = mask[:, k, None]
            c2 = m * (f * c + i * g) + (1 - m) * c
            tc = np.tanh(c2)
            h2 = m * (o * tc) + (1 - m) * h
            if keep:
                trace.append((k, h, c, i, f, o, g, tc, m))
            h, c = h2, c2
            out[:, k] = h
        return out, trace, (h, c)

    def forward(self, x: np.ndarray, mask: np.ndarray, keep: bool = False):
        fwd, tf, _ = self._direction(x, mask, "f", keep)
        bwd, tb, _ = self._direction(x, mask, "b", keep)
        seen = np.concatenate([x, fwd, bwd], axis=2)
        p = 1 / (1 + np.exp(-(seen @ self.w["v"] + self.w["c"][0])))
        return p, (seen, tf, tb)

    def gradients(self, x: np.ndarray, y: np.ndarray, mask: np.ndarray) -> tuple[float, dict[str, np.ndarray]]:
        p, (seen, tf, tb) = self.forward(x, mask, keep=True)
        total = mask.sum()
        loss = -float((mask * (y * np.log(p + 1e-12) + (1 - y) * np.log(1 - p + 1e-12))).sum() / total)
        err = mask * (p - y) / total
        grad = {"v": np.einsum("nt,ntd->d", err, seen), "c": np.array([err.sum()])}
        d = x.shape[2]
        for s, trace, at in (("f", tf, d), ("b", tb, d + HIDDEN)):
            u = self.w["u" + s]
            gw, gu, gb = np.zeros_like(self.w["w" + s]), np.zeros_like(u), np.zeros(4 * HIDDEN)
            dh, dc = np.zeros((len(x), HIDDEN)), np.zeros((len(x), HIDDEN))
            for k, h, c, i, f, o, g, tc, m in reversed(trace):
                dh = dh + err[:, k, None] * self.w["v"][at : at + HIDDEN]
                do = m * dh * tc * o * (1 - o)
                inner = dc + m * dh * o * (1 - tc**2)
                dz = np.concatenate([m * inner * g * i * (1 - i), m * inner * c * f * (1 - f), do, m * inner * i * (1 - g**2)], axis=1)
                gw += x[:, k].T @ dz
                gu += h.T @ dz
                gb += dz.sum(axis=0)
                dh = dz @ u.T + (1 - m) * dh
                dc = m * inner * f + (1 - m) * dc
            grad |= {"w" + s: gw, "u" + s: gu, "b" + s: gb}
        return loss, grad

    def label_long(self, page: list) -> np.ndarray:
        """P(main text) per block of one page of any length: of all blocks only the forward states are held."""
        n = len(page)
        fwd, p, state = np.empty((n, HIDDEN), np.float32), np.empty(n), None
        cuts = [(lo, min(lo + STRETCH, n)) for lo in range(0, n, STRETCH)]
        for lo, hi in cuts:
            x = vectors(page[lo:hi], lo, n)[None]
            out, _, state = self._direction(x, np.ones(x.shape[:2], np.float32), "f", False, state)
            fwd[lo:hi] = out[0]
        state = None
        for lo, hi in reversed(cuts):
            x = vectors(page[lo:hi], lo, n)[None]
            out, _, state = self._direction(x, np.ones(x.shape[:2], np.float32), "b", False, state)
            p[lo:hi] = 1 / (1 + np.exp(-(np.concatenate([x[0], fwd[lo:hi], out[0]], axis=1) @ self.w["v"] + self.w["c"][0])))
        return p

    def label(self, pages: list[np.ndarray]) -> list[np.ndarray]:
        """P(main text) per block; pages of like length are computed together."""
        out: list[np.ndarray] = [np.zeros(0)] * len(pages)
        order = sorted((k for k in range(len(pages)) if len(pages[k])), key=lambda k: len(pages[k]))
        lo = 0
        while lo < len(order):
            hi = lo + 1
            while hi < len(order) and len(pages[order[hi]]) * (hi - lo + 1) <= BATCH_CELLS // 16 and hi - lo < 256:
                hi += 1
            x, mask = _padded([pages[k] for k in order[lo:hi]])
            p, _ = self.forward(x, mask)
            for row, k in enumerate(order[lo:hi]):
                out[k] = p[row, : len(pages[k])]
            lo = hi
        return out


def _padded(pages: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    t = max(len(p) for p in pages)
    x = np.zeros((len(pages), t, pages[0].shape[1]), np.float32)
    mask = np.zeros((len(pages), t), np.float32)
    for k, p in enumerate(pages):
        x[k, : len(p)] = p
        mask[k, : len(p)] = 1
    return x, mask


#: Boilerplate planted in training pages: a path to hang below the body or the article.
PLANTS = (
    ("div.sidebar", "ul", "li"), ("aside", "p"), ("aside", "div.widget", "p"), ("div.cookie-notice", "p"), ("div.banner", "p"), ("div.ad", "p"), ("div.ad",), ("div.advert",), ("aside",), ("div.comment",), ("div.notice",),
    ("form", "div"), ("form.newsletter", "p"), ("section.comments", "div.comment", "p"), ("div.comments", "ul", "li"), ("ol.comment-list", "li", "p"),
    ("div.related", "ul", "li"), ("div.share",), ("header", "p"), ("header", "h1"), ("div.menu", "ul", "li"), ("nav", "ul", "li"), ("footer", "p"), ("div.site-footer",),
    ("div.promo", "p"), ("div.popup", "p"), ("div.breadcrumbs",),
)
#: What boilerplate says.
PHRASES = (
    "We use cookies to give you the best experience.", "This site uses cookies. Accept all cookies or change your settings.", "By continuing you agree to our privacy policy and terms of use.",
    "Accept cookies", "Manage consent", "Advertisement", "Sponsored content", "Buy now and save 20% on all orders, free delivery.", "Special offer: buy one today, shop the sale now.", "Shop now",
    "Subscribe to our newsletter", "Sign up for our newsletter and get the latest offers by email.", "Enter your email address", "Log in or sign up to comment", "Leave a comment", "Post a reply",
    "Reply", "Share on social media", "Share this article", "Follow us on social media", "Related articles", "You may also like", "Most read", "Read more", "Click here", "Back to top",
    "Home", "About us", "Contact", "Search this site", "Skip to content", "All rights reserved.", "Copyright 2020. All rights reserved.", "Terms and conditions", "Privacy policy",
    "Thanks for this, I really liked reading it!", "Great post, I agree with you.", "Posted by a guest at 10:31",
    "Wir verwenden Cookies, um unsere Website zu verbessern.", "Alle Cookies akzeptieren", "Anzeige", "Jetzt kaufen und sparen", "Newsletter abonnieren", "Kommentar schreiben", "Alle Rechte vorbehalten.",
    "Nous utilisons des cookies pour améliorer votre expérience.", "Tout accepter", "Publicité", "Abonnez-vous à notre newsletter", "Laisser un commentaire", "Tous droits réservés.", "Acheter maintenant",
    "Utilizamos cookies para mejorar su experiencia.", "Aceptar todo", "Publicidad", "Suscríbete a nuestro boletín", "Deja un comentario", "Todos los derechos reservados.", "Comprar ahora",
)
#: Boilerplate that is put together anew each time: notices, offers and comments of readers.
PARTS = (
    (("We value your privacy.", "Your privacy matters to us.", "We care about your data.", "Before you continue:"), ("This website stores small files on your device", "We and our partners store and read information on your device", "Some of these files are needed for the site to work", "You can choose which files we may store"), ("to improve our services.", "to measure our audience.", "to show you content that you may like.", "and you can change your choice at any time."), ("Accept", "Reject", "More options", "")),
    (("Try", "Get", "Buy", "Discover", "Order", "Save on", "Upgrade to", "Don't miss", "Meet"), ("the amazing", "our new", "your favourite", "the best", "the all-new", "the only"), ("mattress", "phone", "shoes", "plan", "headphones", "insurance", "kitchen", "watch", "car", "of all"), ("now", "today", "now at half price!", "for only $9.99.", "20% off today!", "with free delivery.", "this week only.", "before it is gone!")),
    (("I totally agree with", "Thanks for", "Not sure about", "Loved", "I disagree with", "lol,", "Has anyone tried"), ("this,", "the author,", "you,", "the article,", "your point,", "what you wrote,"), ("keep it up!!", "but where is part two?", "it made my day.", "I had the same last year.", "my brother says the same.", "can you write more?"), ("", "", "Greetings, Anna", ":)")),
    (("Sign up", "Join us", "Register", "Leave your email"), ("and never miss a story.", "for our weekly letter.", "and get our best stories in your inbox.", "to read on."), ("No spam.", "It is free.", "You can leave at any time.", ""), ("",)),
)


def invented(rng: np.random.Generator) -> str:
    """A piece of boilerplate of PARTS."""
    return " ".join(p for k in (PARTS[rng.integers(len(PARTS))],) for p in (x[rng.integers(len(x))] for x in k) if p)


#: Containers that content is moved to, so that no one element name decides.
HOMES = (("article",), ("main",), ("main", "article"), ("main", "div"), ("article", "section"), ("div", "article"), ("div.content",), ("div.post-body",), ("div.share-price-story",), ("div",), ("div", "div"),
    ("div.page", "div.c1"), ("section",), ("div", "section"), ("main", "section", "div"), ("table", "tr", "td"), ())
ROOTS = (("html", "body"), ("html", "body"), ("body",), ())


#: What content itself may stand in, and its head in an article.
INNER = (("ul", "li"), ("ol", "li"), ("blockquote", "p"), ("table", "tr", "td"), ("pre",), ("h2",), ("h3",), ("figure", "figcaption"), ("section", "p"), ("dl", "dd"), ("dl", "dt"), ("figure",),
    ("figure", "p"), ("details", "summary"), ("details", "p"), ("h4",), ("div",), ("div", "p"), ())
HEADS = (("header", "h1"), ("header", "p"), ("header", "div", "h1"), ("header", "hgroup", "h1"), ("h1",))
#: Its headline outside of an article.
TITLES = (("h1",), ("h2",), ("div", "h1"))


def masked(page: list, rng: np.random.Generator) -> list:
    """The page with every class, id and role name replaced by a made-up one, or by none."""
    table: dict[str, str] = {}

    def other(label: str) -> str:
        tag, *names = label.split(".")
        for n in names:
            if n not in table:
                table[n] = "" if rng.random() < 0.3 else "".join(chr(97 + int(c)) for c in rng.integers(0, 26, int(rng.integers(3, 9))))
        return ".".join([tag, *(table[n] for n in names if table[n])])

    return [(tuple(map(other, path)), text, linked) for path, text, linked in page]


def variants(page: list, rng: np.random.Generator, told: list[int]) -> tuple[list, list[int]]:
    """A training page: content in another container, boilerplate planted around and inside."""
    prose = [b for b, y in zip(page, told, strict=True) if y and len(b[1]) > 40]
    home, root = HOMES[rng.integers(len(HOMES))], ROOTS[rng.integers(len(ROOTS))]
    if prose and rng.random() < 0.15:
        # A fragment: one block, at times a very long one.
        text = " ".join(prose[rng.integers(len(prose))][1] for _ in range(int(rng.choice([1, 1, 5, 200]))))
        return [((*root, *home, "p"), text, 0)], [1]
    out, labels = [], []
    # In some variants the content is mostly lists, cells and quotes.
    odd = 0.5 if rng.random() < 0.5 else 0.15
    head = "article" in home or "main" in home

    def plant(inside: bool) -> None:
        path = PLANTS[rng.integers(len(PLANTS))]
        if inside and path[0] == "header":
            return
        for _ in range(rng.integers(1, 4)):
            kind = rng.random()
            if kind < 0.6 or not prose:
                text = " ".join(PHRASES[int(k)] for k in rng.integers(0, len(PHRASES), int(rng.integers(1, 3)))) if rng.random() < 0.5 else invented(rng)
            else:
                text = prose[rng.integers(len(prose))][1]
                text = " ".join(text.split(" ")[: int(rng.integers(1, 60))])
            # What is said inside the text in no telling element is told by its words alone.
            bare = kind < 0.6 and rng.random() < 0.5
            linked = len(text) if rng.random() < 0.3 else 0
            out.append(((*root, *(home if inside else ()), *(("div.x", "p") if bare else path)), text, linked))
            labels.append(0)

    first = True
    for b, y in zip(page, told, strict=True):
        if rng.random() < 0.15:
            plant(bool(y))
        if y:
            path = tuple(x for x in b[0] if x.split(".")[0] not in ("html", "body", "article", "main", "header"))
            text = b[1]
            if first and rng.random() < 0.5:
                tops = HEADS if head else TITLES
                for _ in range(int(rng.integers(1, 3)) if head else 1):
                    out.append(((*root, *home, *tops[rng.integers(len(tops))]), " ".join(text.split(" ")[: int(rng.integers(1, 20))]), 0))
                    labels.append(1)
            first = False
            if rng.random() < odd:
                path = INNER[rng.integers(len(INNER))]
                if rng.random() < 0.5:
                    text = " ".join(text.split(" ")[: int(rng.integers(1, 12))])
            out.append(((*root, *home, *path), text, min(b[2], len(text))))
        else:
            out.append(b)
        labels.append(y)
    if rng.random() < 0.5:
        plant(False)
    return out, labels


def train(pages: list[list], epochs: int = EPOCHS, seed: int = SEED) -> Labeller:
    """Adam on the pages' blocks, on variants, and on both with masked names; without pages the untrained network."""
    rng = np.random.default_rng(seed)
    read = [p for p in pages if p]
    stands = Counter(t for p in read for t in {b[1] for b in p})
    data = []
    for p in read:
        told = [teacher(*b, stands[b[1]]) for b in p]
        for v, y in ((p, told), *(variants(p, rng, told) for _ in range(4))):
            shown = masked(v, rng) if rng.random() < 0.5 else v
            data.append((vectors(shown), np.array(y, np.float32)))
    model = Labeller.fresh(seed)
    first = {k: np.zeros_like(v) for k, v in model.w.items()}
    second = {k: np.zeros_like(v) for k, v in model.w.items()}
    data.sort(key=lambda d: len(d[0]))
    groups = [data[k : k + 32] for k in range(0, len(data), 32)]
    step, mean, n = 0, {k: np.zeros_like(v) for k, v in model.w.items()}, 0
    for epoch in range(epochs):
        rate = 0.02 if epoch < epochs // 2 else 0.008
        for k in rng.permutation(len(groups)):
            x, mask = _padded([d[0] for d in groups[k]])
            y = np.zeros_like(mask)
            for row, d in enumerate(groups[k]):
                y[row, : len(d[1])] = d[1]
            _, grad = model.gradients(x, y, mask)
            step += 1
            for name, g in grad.items():
                g = np.clip(g, -1, 1)
                first[name] = 0.9 * first[name] + 0.1 * g
                second[name] = 0.99 * second[name] + 0.01 * g**2
                model.w[name] = model.w[name] - rate * (first[name] / (1 - 0.9**step)) / (np.sqrt(second[name] / (1 - 0.99**step)) + 1e-8)
            if epoch >= epochs * 2 // 3:
                # The mean over the last steps generalises better than the last step.
                n += 1
                mean = {k: v + (model.w[k] - v) / n for k, v in mean.items()}
    return Labeller({k: v.astype(np.float32) for k, v in (mean if n else model.w).items()})


def windows(page: list, seed: int) -> list[list]:
    """Up to WINDOWS runs of whole blocks, from anywhere in the page, to train on."""
    if not page:
        return []
    rng, out = np.random.default_rng(seed), {}
    for _ in range(WINDOWS):
        lo = hi = int(rng.integers(0, max(1, len(page) - WINDOW_BLOCKS + 1)))
        chars = 0
        while hi < len(page) and hi - lo < WINDOW_BLOCKS and chars + len(page[hi][1]) <= WINDOW_CHARS:
            chars += len(page[hi][1])
            hi += 1
        if hi > lo:
            out[lo] = page[lo:hi]
    return list(out.values())


def _windows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        for h, html in zip(b.column("h").to_pylist(), b.column("html").to_pylist(), strict=True):
            found = [json.dumps(w) for w in windows(blocks(html), h & 0xFFFFFFFF)]
            yield pa.RecordBatch.from_arrays([pa.array([h] * len(found), pa.int64()), pa.array(found, pa.string())], names=["h", "page"])


def fit(pages: DataFrame, key: str = "page_id", html: str = "html", sample: int = SAMPLE_PAGES) -> Labeller:
    """Train on about ``sample`` pages, never more, chosen by hash of the key; pages of any length."""
    keys = bounded(pages.select(F.col(key).alias("k")), F.col("k"), sample).distinct()
    # At most ``sample`` keys.
    chosen = pages.select(F.col(key).alias("p"), F.col(html).alias("html")).join(F.broadcast(keys), F.col("p").eqNullSafe(F.col("k")))
    rows = chosen.select(F.xxhash64("p").alias("h"), "html").mapInArrow(_windows, "h long, page string").orderBy("h", "page").limit(WINDOWS * sample).collect()
    return train([[(tuple(path), text, linked) for path, text, linked in json.loads(r["page"])] for r in rows])


def extract(pages: DataFrame, model: Labeller, html: str = "html", batch: int = 256) -> DataFrame:
    """``pages`` with ``html`` replaced by ``text``, the main text of the whole page.

    Null and empty pages, and pages without a block of main text, have an empty text; a
    column ``text`` of the table is replaced too, all others pass through; repeated rows each
    get their row; pages of any length are read in stretches.
    """
    weights = model.w
    others = [c for c in pages.columns if c not in (html, "text")]
    held = pages.select(*[F.col(f"`{c}`").alias(f"k{i}") for i, c in enumerate(others)], F.col(html).alias("html"))
    kinds = dict(held.dtypes)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        net = Labeller(weights)
        for b in batches:
            for lo in range(0, b.num_rows, batch):
                part = b.slice(lo, batch)
                read = [blocks(h) for h in part.column("html").to_pylist()]
                found = net.label([vectors(p) if len(p) <= STRETCH else np.zeros((0, 1)) for p in read])
                found = [net.label_long(p) if len(p) > STRETCH else y for p, y in zip(read, found, strict=True)]
                texts = [" ".join(x[1] for x, q in zip(p, y, strict=True) if q >= 0.5).encode("utf-8", "replace").decode() for p, y in zip(read, found, strict=True)]
                yield pa.RecordBatch.from_arrays([*(part.column(f"k{i}") for i in range(len(others))), pa.array(texts, pa.string())], names=[*(f"k{i}" for i in range(len(others))), "text"])

    schema = ", ".join([*(f"k{i} {kinds[f'k{i}']}" for i in range(len(others))), "text string"])
    return held.mapInArrow(run, schema).withColumnsRenamed({f"k{i}": c for i, c in enumerate(others)})


def html_query(pages: DataFrame) -> DataFrame:
    out = extract(pages.select("page_id", "url", "html"), fit(pages))
    return out.select("page_id", "url", "text", F.length("text").cast("long").alias("n_chars"))
