"""Main text of web pages: a linear-chain conditional random field over the leaf blocks of a page, decoded by Viterbi."""

from __future__ import annotations

import html
import random
import re
from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Labelled pages that a model is fitted on, at most: a bounded sample by design.
MAX_PAGES = 600

_TAG = re.compile(
    r"<!--.*?(?:-->|\Z)|<!\[CDATA\[.*?(?:\]\]>|\Z)"
    r"|<(?P<end>/?)(?P<name>[a-zA-Z][^\s/>]*)(?P<attrs>(?:[^>\"']|\"[^\"]*\"|'[^']*')*)>"
    r"|</?[a-zA-Z][^>]*(?:>|\Z)|<[!?/][^>]*(?:>|\Z)",
    re.S,
)
_NAMED = re.compile(r"""\b(?:class|id|role)\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s>]+))""", re.I)
_PARTS = re.compile(r"[a-z]+")

#: Elements whose content is never read: those of raw text, which only their own end tag closes, and those that hold other
#: elements, of which LOOSE end at the next block too. What may stand in a head; elements without content, and those that
#: begin and end a block.
RAW = frozenset("script style title textarea".split())
UNREAD = RAW | frozenset("noscript template svg iframe object canvas audio video select button".split())
LOOSE = frozenset("select button".split())
IN_HEAD = frozenset("base basefont bgsound link meta title script style noscript template".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
BLOCK = frozenset(
    "address article aside blockquote body caption center dd details dialog div dl dt fieldset figcaption figure footer form frameset h1 h2 h3 h4 h5 h6 "
    "header hgroup hr html legend li main menu nav ol p pre section summary table tbody td tfoot th thead tr ul".split()
)
#: What a start tag closes, up to the elements that bound the search.
CLOSES = {"li": ("li",), "dt": ("dt", "dd"), "dd": ("dt", "dd"), "tr": ("tr", "td", "th"), "td": ("td", "th"), "th": ("td", "th"), "option": ("option",)}
BOUNDS = frozenset("ul ol dl table body article section div main td th".split())

#: Words in class, id and role that tell what a part of a page is for.
SIGNS = {
    "menu": "nav navbar navigation menu breadcrumb breadcrumbs topbar tabs pagination pager toc links",
    "head": "header masthead logo brand sitename tagline top hero",
    "foot": "footer foot copyright colophon bottom legal contentinfo imprint",
    "side": "sidebar side aside widget related recommended popular trending more tags rail complementary sharing share social",
    "note": "cookie cookies consent gdpr notice alert banner popup modal overlay message warning announcement subscribe paywall toast",
    "ad": "ad ads advert adverts advertisement sponsor sponsored promo promotion dfp adsense teaser commercial",
    "talk": "comment comments commentlist reply replies respond discussion disqus feedback reviews thread",
    "form": "form search login signin signup register newsletter contact field input",
    "main": "content article post entry story main body text page prose maincontent articlebody",
}
_SIGN = {w: k for k, v in SIGNS.items() for w in v.split()}
_SEEN = frozenset("p li h1 h2 h3 h4 h5 h6 td th div span section article main blockquote pre dd dt figcaption nav header footer aside form label address caption summary body ul ol table a legend fieldset figure dialog menu".split())


_FURNITURE = frozenset("nav header footer aside form".split())


class Open:
    """An open element, and what holds of everything in it: all that is known of the elements around is kept in sets of
    a bounded vocabulary, which most elements share with their parents, so that a page of any depth takes linear space.
    """

    __slots__ = ("tag", "tags", "signs", "own", "near", "core", "head", "inner", "marked")

    def __init__(self, tag: str, signs: tuple[str, ...], parent: Open | None):
        self.tag = tag
        up_tags, up_signs = (parent.tags, parent.signs) if parent else (frozenset(), frozenset())
        self.tags = up_tags if tag in up_tags or tag not in _SEEN else up_tags | {tag}
        self.signs = up_signs if up_signs.issuperset(signs) else up_signs.union(signs)
        self.own = tag if tag in BLOCK else parent.own if parent else "none"
        self.near = signs or (parent.near if parent else ())
        other = any(s != "main" for s in signs)
        mark = tag in _FURNITURE or other
        before = bool(parent and parent.marked)
        #: Of the innermost element that should hold the article: whether it has other signs too, and whether furniture
        #: stands around it and within it.
        if tag in ("article", "main") or "main" in signs:
            self.core, self.head, self.inner = ("marked" if other else "clean"), before, False
        else:
            self.core, self.head, self.inner = (parent.core, parent.head, parent.inner or mark) if parent else (None, False, mark)
        self.marked = before or mark


@dataclass
class Block:
    text: str
    within: Open | None
    linked: int


def blocks(source: str) -> list[Block]:
    """The leaf blocks of a page in order: their text, the innermost open element, and characters in links.

    Markup may be broken or cut off anywhere. Character references are decoded, white space runs become one space,
    br counts as white space; what UNREAD elements hold is passed over. Raw text that is never closed runs to the end of
    the page; any other unread element that isn't closed, or within which another of its name begins, ends with the element
    around it, a button or select with the next block. A head ends at the first text or element that can't stand in it.
    The time is linear in the page, whatever its depth.
    """
    out: list[Block] = []
    stack: list[Open] = []
    places: dict[str, list[int]] = {}
    parts: list[str] = []
    linked, links, at, hidden = 0, 0, 0, 0
    marks: dict[str, list[int]] = {}

    def closed(name: str, at: int) -> int:
        """Where an unread element that begins before `at` has ended, if its end tag comes before another of its name (of
        raw text: at all); -1 if not."""
        if name not in marks:
            tags = re.finditer(rf"<(/?){re.escape(name)}(?![a-zA-Z0-9])[^>]*(?:>|\Z)", source, re.I)
            marks[name] = [m.end() if m[1] else -m.start() - 1 for m in tags if m[1] or name not in RAW]
        own = marks[name]
        seen[name] = next((i for i in range(seen.get(name, 0), len(own)) if (own[i] if own[i] >= 0 else -own[i] - 1) >= at), len(own))
        return own[seen[name]] if seen[name] < len(own) and own[seen[name]] >= 0 else -1

    seen: dict[str, int] = {}

    def flush() -> None:
        nonlocal linked
        if parts:
            text = " ".join("".join(parts).split())
            if text:
                out.append(Block(text, stack[-1] if stack else None, min(linked, len(text))))
            parts.clear()
        linked = 0

    def read(text: str) -> None:
        nonlocal linked
        if hidden:
            return
        if places.get("head") and not text.isspace():
            shut(places["head"][0])
        if "&" in text:
            text = html.unescape(text)
        parts.append(text)
        if links:
            linked += len(text)

    def shut(depth: int) -> None:
        nonlocal hidden
        while len(stack) > depth:
            tag = stack.pop().tag
            places[tag].pop()
            hidden -= tag in UNREAD

    def open_(name: str, signs: tuple[str, ...] = ()) -> None:
        nonlocal hidden
        places.setdefault(name, []).append(len(stack))
        stack.append(Open(name, signs, stack[-1] if stack else None))
        hidden += name in UNREAD

    def last(names: Iterable[str]) -> int:
        return max((places[n][-1] for n in names if places.get(n)), default=-1)

    found = _TAG.search(source)
    while found:
        if found.start() > at:
            read(source[at : found.start()])
        at = found.end()
        name = found["name"]
        if name:
            name = name.lower()
            if places.get("head") and not found["end"] and name not in IN_HEAD:
                shut(places["head"][0])
            if found["end"]:
                if name == "a":
                    links = max(0, links - 1)
                if places.get(name):
                    if name in BLOCK:
                        flush()
                    shut(places[name][-1])
                elif name == "p":
                    flush()
            elif name in UNREAD:
                if name in LOOSE and places.get(name):  # neither holds another of its kind
                    shut(places[name][-1])
                if not found["attrs"].endswith("/") or name in RAW:
                    end = closed(name, at)
                    if end >= 0 or name in RAW:
                        at = end if end >= 0 else len(source)
                    else:
                        open_(name)
            elif name in VOID:
                if name == "hr":
                    flush()
                elif name != "wbr":
                    parts.append(" ")
            else:
                if name in BLOCK:
                    loose = min((places[x][0] for x in LOOSE if places.get(x)), default=-1)
                    if loose >= 0:
                        shut(loose)
                    flush()
                    p = last(("p",))
                    if p >= max(0, len(stack) - 6):
                        shut(p)
                        links = 0
                    if name in CLOSES:
                        begins = last(CLOSES[name])
                        if begins >= 0 and begins >= last(("table",) if name in ("tr", "td", "th") else BOUNDS):
                            shut(begins)
                if name == "a":
                    links += 1
                attrs = found["attrs"]
                signs = ()
                if attrs:
                    words = {w for g in _NAMED.findall(attrs) for w in _PARTS.findall("".join(g).lower())}
                    signs = tuple(sorted({_SIGN[w] for w in words if w in _SIGN}))
                open_(name, signs)
        found = _TAG.search(source, at)
    if at < len(source):
        read(source[at:])
    flush()
    return out


_OUTSIDE = Open("none", (), None)
_STOPS = (".", "!", "?", "…", '."', ".”", ":", "。")


def features(page: list[Block]) -> list[list[str]]:
    """For each block the names of what holds of it: its ancestors' tags and signs, and the shape of its text."""
    out = []
    n = len(page)
    for i, b in enumerate(page):
        at = b.within or _OUTSIDE
        f = ["bias", f"own:{at.own if at.own in _SEEN else 'other'}"]
        f += [f"in:{t}" for t in at.tags]
        f += [f"sign:{s}" for s in at.signs]
        f += [f"near:{s}" for s in at.near]
        if at.core:
            marked = ["head"] * at.head + ["inner"] * at.inner + ["core"] * (at.core == "marked")
            f += [f"core:{m}" for m in marked] or ["core:clean"]
        if not at.signs and at.tags.isdisjoint(("nav", "header", "footer", "aside", "form", "article", "main")):
            f.append("plain")
        size = len(b.text)
        f.append("size:%d" % min(6, size.bit_length() // 2 + (size > 400)))
        share = b.linked / size
        f.append("links:" + ("none" if share == 0 else "some" if share < 0.3 else "many" if share < 0.8 else "all"))
        if b.text.endswith(_STOPS):
            f.append("stops")
        words = b.text.count(" ") + 1
        f.append("words:%d" % min(6, words.bit_length()))
        if words >= 8 and ("," in b.text or ". " in b.text):
            f.append("sentence")
        if "©" in b.text or "(c)" in b.text.lower()[:40]:
            f.append("copyright")
        f.append("place:%d" % (4 * i // n))
        out.append(f)
    return out


@dataclass
class Field:
    """Weights of the field for `content` against `other`: of features, of each step between labels, of the first."""

    weights: dict[str, float]
    step: np.ndarray
    first: np.ndarray

    def emissions(self, page: list[Block]) -> list[float]:
        w = self.weights
        return [sum(w.get(x, 0.0) for x in f) for f in features(page)]

    def decode(self, page: list[Block]) -> list[bool]:
        """The likeliest labels of a page's blocks together (Viterbi); ties go to `other`."""
        if not page:
            return []
        e = self.emissions(page)
        (s00, s01), (s10, s11) = self.step.tolist()
        a, b = float(self.first[0]), float(self.first[1]) + e[0]
        back = []
        for x in e[1:]:
            from0, from1 = a + s01, b + s11
            stay0, stay1 = a + s00, b + s10
            back.append((stay1 > stay0, from1 > from0))
            a, b = max(stay0, stay1), max(from0, from1) + x
        label = b > a
        labels = [label]
        for to0, to1 in reversed(back):
            label = to1 if label else to0
            labels.append(label)
        return labels[::-1]


def main_text(field: Field, source: str | None) -> str:
    """The content blocks of a page, in order, with an empty line between them; no page: empty."""
    if not source:
        return ""
    page = blocks(source)
    return "\n\n".join(b.text for b, good in zip(page, field.decode(page), strict=True) if good)


def fit(pages: Iterable[tuple[str, set[str]]], rounds: int = 120, rate: float = 0.15, decay: float = 2e-4) -> Field:
    """The field with the greatest penalised likelihood for labelled pages: html, and the texts of its content blocks.

    Gradients are exact, from the forward-backward sums of all pages at once; at most MAX_PAGES pages are used.
    """
    data = []
    for source, content in pages:
        page = blocks(source)
        if page:
            data.append((features(page), [int(b.text in content) for b in page]))
        if len(data) == MAX_PAGES:
            break
    names = {x: i for i, x in enumerate(sorted({x for f, _ in data for y in f for x in y}))}
    many, long = len(data), max((len(y) for _, y in data), default=0)
    x = np.zeros((many, long, len(names)), np.float32)
    y, mask = np.zeros((many, long), int), np.zeros((many, long), bool)
    for i, (f, labels) in enumerate(data):
        for t, own in enumerate(f):
            x[i, t, [names[k] for k in own]] = 1
        y[i, : len(labels)], mask[i, : len(labels)] = labels, True
    blocks_in_all = max(1, int(mask.sum()))
    size = len(names)
    theta, m, v = np.zeros(size + 6), np.zeros(size + 6), np.zeros(size + 6)
    gold = np.zeros(size + 6)
    gold[:size] = x[(y == 1) & mask].sum(axis=0)
    both = mask[:, 1:] & mask[:, :-1]
    np.add.at(gold[size : size + 4], (2 * y[:, :-1] + y[:, 1:])[both], 1)
    np.add.at(gold[size + 4 :], y[:, 0] if long else [], 1)
    for turn in range(1, rounds + 1):
        w, step, first = theta[:size], theta[size : size + 4].reshape(2, 2), theta[size + 4 :]
        e = np.zeros((many, long, 2))
        e[:, :, 1] = x @ w.astype(np.float32)
        alpha, beta = np.zeros((many, long, 2)), np.zeros((many, long, 2))
        for t in range(long):
            if t == 0:
                alpha[:, 0] = first + e[:, 0]
                continue
            new = np.logaddexp.reduce(alpha[:, t - 1, :, None] + step, axis=1) + e[:, t]
            alpha[:, t] = np.where(mask[:, t, None], new, alpha[:, t - 1])
        for t in range(long - 2, -1, -1):
            new = np.logaddexp.reduce(step + (e[:, t + 1] + beta[:, t + 1])[:, None, :], axis=2)
            beta[:, t] = np.where(mask[:, t + 1, None], new, 0.0)
        z = np.logaddexp.reduce(alpha[:, -1], axis=1) if long else np.zeros(0)
        p = np.exp(alpha + beta - z[:, None, None]) * mask[:, :, None] if long else e
        pair = np.exp(alpha[:, :-1, :, None] + step + (e[:, 1:] + beta[:, 1:])[:, :, None, :] - z[:, None, None, None]) * both[:, :, None, None]
        model = np.concatenate([np.einsum("pt,ptf->f", p[:, :, 1], x), pair.sum(axis=(0, 1)).ravel(), p[:, 0].sum(axis=0) if long else np.zeros(2)])
        g = (model - gold) / blocks_in_all + decay * theta
        m, v = 0.9 * m + 0.1 * g, 0.99 * v + 0.01 * g * g
        theta = theta - rate * (m / (1 - 0.9**turn)) / (np.sqrt(v / (1 - 0.99**turn)) + 1e-8)
    return Field({k: float(theta[i]) for k, i in names.items()}, theta[size : size + 4].reshape(2, 2).copy(), theta[size + 4 :].copy())


def labelled_pages(n: int = 400, seed: int = 7) -> Iterator[tuple[str, set[str]]]:
    """Labelled pages for training, written from layouts drawn at random: html, and the texts of the content blocks.

    Containers, names of classes, tags and the order of parts vary; some pages have bare containers without any
    telling name, notices or comments within the article, broken markup, or a cut-off end.
    """
    rng = random.Random(seed)
    pick = rng.choice
    syllables = "an be ci do el fu ga hi ja ku lo ma ne os pi qua ra si tu ven wo xi yo za ção für é ß в да 中".split()

    def words(a: int, b: int) -> str:
        return " ".join("".join(pick(syllables) for _ in range(rng.randint(1, 4))) for _ in range(rng.randint(a, b)))

    def prose() -> str:
        return " ".join(words(4, 18).capitalize() + pick((".", ".", ".", "!", "?", ",")) for _ in range(rng.choice((1, 1, 2, 3, 5, 8)))).rstrip(",") + pick((".", ".", ".", ""))

    def link(text: str) -> str:
        return f'<a href="/{rng.randint(1, 999)}">{text}</a>'

    def attr(sign: str, odds: float = 0.9) -> str:
        if rng.random() > odds:
            return ""
        own = pick(SIGNS[sign].split())
        own = pick((own, f"{own}-{pick(('box', 'wrap', 'area', 'list', 'x1'))}", f"site-{own}"))
        return f' {pick(("class", "class", "id"))}="{own}"'

    def items(a: int, b: int, linked: float = 1.0) -> str:
        return "".join(f"<li>{link(words(1, 3)) if rng.random() < linked else words(1, 4)}</li>" for _ in range(rng.randint(a, b)))

    def menu() -> str:
        return pick((f"<nav><ul>{items(2, 8)}</ul></nav>", f"<div{attr('menu', 1)}><ul>{items(2, 8)}</ul></div>", f"<ul{attr('menu', 1)}>{items(2, 8)}</ul>", f"<nav>{' '.join(link(words(1, 2)) for _ in range(4))}</nav>", f"<div{attr('menu')}>{' | '.join(link(words(1, 2)) for _ in range(5))}</div>"))

    def head() -> str:
        inner = pick((f"<h1>{words(1, 4)}</h1>", f"<p>{words(2, 9)}</p>", f"<div{attr('head')}>{link(words(1, 3))}</div><p>{words(3, 8)}.</p>", f"<h2>{link(words(1, 3))}</h2>" + menu()))
        return pick((f"<header>{inner}</header>", f"<div{attr('head', 1)}>{inner}</div>"))

    def foot() -> str:
        inner = pick((f"&copy; {words(1, 3)} &middot; {prose()}", f"<p>© {rng.randint(1999, 2030)} {words(1, 4)}</p><p>{prose()}</p>", f"<ul>{items(2, 6)}</ul><p>{words(2, 6)}</p>", prose()))
        return pick((f"<footer>{inner}</footer>", f"<footer{attr('foot')}>{inner}</footer>", f"<div{attr('foot', 1)}>{inner}</div>"))

    def side() -> str:
        inner = pick((f"<h3>{words(1, 3)}</h3><ul>{items(2, 7)}</ul>", f"<p>{prose()}</p>", f"<h4>{words(1, 3)}</h4><p>{words(4, 12)}</p>"))
        return pick((f"<aside>{inner}</aside>", f"<aside{attr('side')}>{inner}</aside>", f"<div{attr('side', 1)}>{inner}</div>"))

    def note() -> str:
        return f"<{(t := pick(('div', 'div', 'section', 'p', 'aside')))}{attr('note', 1)}>{pick((prose(), words(3, 9) + '. ' + link(words(1, 2))))}</{t}>"

    def advert() -> str:
        return f"<{(t := pick(('div', 'div', 'div', 'section', 'aside', 'p')))}{attr('ad', 1)}>{pick((prose(), words(2, 8), link(words(2, 6))))}</{t}>"

    def form() -> str:
        return pick((f"<form{attr('form', 0.4)}><label>{words(1, 3)}</label><input><button>{words(1, 1)}</button><p>{words(2, 9)}.</p></form>", f"<div{attr('form', 1)}><form><legend>{words(1, 4)}</legend><p>{prose()}</p><input></form></div>"))

    def talk() -> str:
        one = lambda: pick((f"<p>{prose()}</p>", f"<h4>{words(1, 2)}</h4><p>{prose()}</p>", f"<span>{words(1, 2)}</span> {prose()}"))
        own = "".join(f"<{(t := pick(('div', 'li', 'article')))}{attr('talk', 0.7)}>{one()}</{t}>" for _ in range(rng.randint(1, 5)))
        title = f"<h3>{words(1, 2)}</h3>" * (rng.random() < 0.5)
        return f"<{(t := pick(('section', 'div', 'div', 'ol')))}{attr('talk', 1)}>{title}{own}</{t}>"

    def article(content: set[str]) -> str:
        def own(text: str) -> str:
            content.add(" ".join(html.unescape(text).split()))
            return text

        def inline(text: str) -> str:
            own(text)
            parts = text.split(" ")
            if len(parts) > 5 and rng.random() < 0.5:
                i, k = rng.randrange(len(parts) - 2), rng.randint(1, 2)
                t = pick(("b", "i", "em", "strong", "span", "a", "code"))
                parts[i : i + k] = [f"<{t}>" + " ".join(parts[i : i + k]) + f"</{t}>"]
            return " ".join(parts)

        body = [f"<h1>{own(words(2, 9))}</h1>"] * (rng.random() < 0.75)
        for _ in range(pick((0, 1, 2, 3, 5, 8, 13))):
            kind = rng.random()
            if kind < 0.66:
                body.append(pick(("<p>%s</p>", "<p>%s</p>", "<p>%s</p>", "<p>%s", "<div>%s</div>")) % inline(prose()))
            elif kind < 0.74:
                body.append(f"<h{(k := pick('2345'))}>{own(words(1, 6))}</h{k}>")
            elif kind < 0.81:
                body.append("<ul>" + "".join(f"<li>{inline(pick((words(1, 8), prose())))}</li>" for _ in range(rng.randint(1, 5))) + "</ul>")
            elif kind < 0.85:
                body.append(f"<blockquote><p>{own(prose())}</p></blockquote>")
            elif kind < 0.88:
                body.append(f"<p><b>{own(prose())}<br>")
            elif kind < 0.91:
                body.append("<table>" + "".join(f"<tr><td>{own(words(1, 3))}</td><td>{own(words(1, 5))}</td></tr>" for _ in range(rng.randint(1, 3))) + "</table>")
            elif kind < 0.93:
                body.append(f"<pre>{own(words(3, 9))}</pre>")
            else:
                body.append(pick((advert, note, side, form))())
        if rng.random() < 0.1:
            body.append(talk())
        return "".join(body)

    for _ in range(n):
        content: set[str] = set()
        own = article(content)
        t = pick(("article", "article", "main", "div", "div", "section", "td", "none"))
        own = own if t == "none" else f"<table><tr><td>{own}</td></tr></table>" if t == "td" else f"<{t}{attr('main', 0.5 if t == 'div' else 0.25)}>{own}</{t}>"
        if rng.random() < 0.25:
            own = f"<main>{own}</main>" if t != "main" else f'<div class="{pick(("container", "wrapper", "row"))}">{own}</div>'
        before = [f() for f in (head, menu, note, advert, form, side) if rng.random() < 0.42]
        after = [f() for f in (talk, side, advert, form, note, menu) if rng.random() < 0.3]
        rng.shuffle(before)
        rng.shuffle(after)
        after += [foot()] * (rng.random() < 0.85)
        page = f"<!DOCTYPE html><html><head><title>{words(2, 6)}</title><style>p{{margin:0}}</style></head><body>" + "".join(before) + "<script>x='</p>';</script>" + own + "".join(after)
        yield (page + "</body></html>" if rng.random() < 0.9 else page), content


def extract(pages: DataFrame, field: Field | None = None, column: str = "html") -> DataFrame:
    """Every column of pages in a struct `row`, with `text`: the main text of the whole html (null: empty).

    field: a fitted model, else one of labelled_pages(); its few hundred weights are broadcast. Pages without blocks,
    or whose blocks are all furniture, give an empty text. Columns may have any names; no rows give no rows.
    """
    sent = pages.sparkSession.sparkContext.broadcast(field or fit(labelled_pages()))
    rows = pages.select(F.struct(*[c for c in pages.columns if c != column]).alias("row"), F.col(column).alias("_html"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = sent.value
        for batch in batches:
            text = [main_text(own, x.as_py()) for x in batch.column("_html")]
            yield pa.RecordBatch.from_arrays([batch.column("row"), pa.array(text, pa.string())], ["row", "text"])

    return rows.mapInArrow(run, f"row {rows.schema['row'].dataType.simpleString()}, text string")
