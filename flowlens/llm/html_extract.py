"""Main text of web pages by a linear-chain conditional random field.

A page is cut into leaf blocks: the runs of text between block-level tags. Each block has features
of its ancestors (tag names, words of their class, id and role) and of its text. A linear chain over the
page's blocks scores the labels boilerplate and main text per feature and per pair of neighbours;
it is trained by maximum likelihood on labelled pages, and Viterbi's algorithm gives the best
labelling of a page. Pages are parsed and decoded where they are read.
"""

from __future__ import annotations

import html
import random
import re
from collections import Counter
from collections.abc import Container, Iterable, Iterator
from dataclasses import dataclass
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import text_or_empty

# HTML's elements that do not break a line of text, that have no end tag, and whose
# content is not text of the page.
INLINE = frozenset("a abbr acronym b bdi bdo big br canvas cite code data del dfn em font i img ins kbd label mark math q rp rt ruby s samp small span strike strong "
                   "sub sup svg time tt u var wbr".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style template textarea title select option head".split())
LONG_ONLY = frozenset("script style textarea title template".split())  # text up to the end tag, whatever it holds
FOREIGN = frozenset("math svg".split())  # every element inside them is part of a line
#: Elements whose end an opening tag of the same kind implies.
IMPLIED = {"p": {"p"}, "li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}}
#: Elements beyond which no end is implied.
BARS = frozenset("ul ol dl table tbody thead div section article".split())
#: Blocks that end an open paragraph.
ENDS_P = frozenset("address article aside blockquote details div dl fieldset figure footer form h1 h2 h3 h4 h5 h6 header hr main menu nav ol p pre section table ul".split())

MISQUOTED = 20  # tags of a page whose quotes hide every ">" after them, until quotes mean nothing in its tags

_NEXT = re.compile(r"<(?:(/?)([a-zA-Z][^\s/>]*+)|[!?])")
_QUOTED = re.compile(r"""(?:[^>"']++|"[^"]*+"|'[^']*+')*+>""")
_ATTRIBUTE = re.compile(r"(?<![-\w:.])([a-zA-Z_:][-\w:.]*+)\s*+=\s*+(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+))")
_NAME = re.compile(r"[a-z]+")
_SPACE = re.compile(r"\s+")
_FINISH = re.compile(r"[.!?…。！？][\"'”’)»]*$")
_ZEROS, _HUGE = re.compile("&#0+(?=[0-9])"), re.compile("&#[0-9]{8,};?")


@dataclass
class Block:
    text: str
    features: list[str]
    label: int = 0


class Open(NamedTuple):
    """An open element with what it hands down: features of it and its ancestors, training label, nearest block's tag."""

    name: str
    found: frozenset[str]
    label: str
    own: str


def opened(name: str, attributes: str) -> tuple[list[str], str | None]:
    """The features that an element gives its blocks, and its training label."""
    found, label = [f"in:{name}"], None
    if attributes and "=" in attributes:
        for key, a, b, c in _ATTRIBUTE.findall(attributes):
            key = key.lower()
            if key in ("class", "id", "role", "itemprop"):
                found += [f"as:{w}" for w in _NAME.findall((a or b or c).lower())]
            elif key == "data-label":
                label = a
            elif key in ("hidden", "aria-hidden"):
                found.append("as:hidden")
    return found, label


def tokens(page: str) -> Iterator[tuple[str, str | None, bool, str]]:
    """The page as (text, then a tag's name or none, whether it is an end tag, its attributes), in linear time.

    Comments and declarations are skipped, and so are elements with no markup inside, up to their
    end tag. A tag that no ">" follows is cut off and ends the page. Where quotes would hide every
    ">" that follows, the tag ends at the first; after ``MISQUOTED`` such tags quotes mean nothing.
    """
    at, end, misquoted = 0, len(page), 0
    last, last_data = page.rfind(">"), page.rfind("]]>")
    while at < end:
        token = _NEXT.search(page, at)
        if not token:
            yield page[at:].removesuffix("</").removesuffix("<"), None, False, ""
            return
        text, start, at = page[at:token.start()], token.start(), token.end()
        if token[2] is None:
            if page.startswith("<!--", start):
                over = page.find("-->", start + 4)
                at = over + 3 if over >= 0 else end
            elif page.startswith("<![CDATA[", start) and start < last_data:
                at = page.find("]]>", start) + 3
            else:
                over = page.find(">", at)
                at = over + 1 if over >= 0 else end
            yield text, None, False, ""
            continue
        if at > last:
            yield text, None, False, ""
            return
        over = _QUOTED.match(page, at) if misquoted < MISQUOTED else None
        misquoted += over is None
        stop = over.end() if over else page.find(">", at) + 1
        attributes, at, name = page[at:stop - 1], stop, token[2].lower()
        yield text, name, bool(token[1]), attributes
        if name in LONG_ONLY and not token[1]:
            over = re.compile(rf"</{name}(?![-\w])", re.I).search(page, at)
            if over:
                at = page.find(">", over.end()) + 1 or end
            elif not attributes.endswith("/"):
                at = end


def decoded(text: str) -> str:
    """Character references as characters; a number that is no character is U+FFFD."""
    if "&" not in text:
        return text
    if "&#" in text:  # numbers of any length
        text = _HUGE.sub("\ufffd", _ZEROS.sub("&#", text))
    return html.unescape(text)


def blocks(page: str, known: Container[str] | None = None) -> list[Block]:
    """The leaf blocks with text, in page order.

    White space is one blank, character references are decoded. Broken markup is read as browsers
    do where that matters for blocks: missing end tags, a tag cut off at the page's end. Of the
    ancestors' features only ``known`` ones are kept (none given: all), so that time is linear in
    the page however deep it nests.
    """
    done: list[Block] = []
    root = Open("", frozenset(), "0", "none")
    stack: list[Open] = []
    shape: list[int] = []  # places in the stack of elements that imply an end or bar it
    count: Counter[str] = Counter()  # open elements by name
    words: list[str] = []
    linked = 0
    raw = foreign = 0  # open elements whose content is no text, or is part of a line

    def flush() -> None:
        nonlocal linked
        if words:
            text = _SPACE.sub(" ", decoded("".join(words))).strip()
            if text:
                top = stack[-1] if stack else root
                done.append(Block(text, describe(text, linked, top), int(top.label)))
            words.clear()
        linked = 0

    def cut(place: int) -> None:
        nonlocal raw, foreign
        if not foreign and stack[place].name not in INLINE:
            flush()
        for gone in stack[place:]:
            count[gone.name] -= 1
            raw -= gone.name in RAW
            foreign -= gone.name in FOREIGN
        del stack[place:]
        while shape and shape[-1] >= place:
            shape.pop()

    def close(name: str) -> None:
        if count[name]:
            cut(next(i for i in range(len(stack) - 1, -1, -1) if stack[i].name == name))

    for text, name, ending, attributes in tokens(page):
        if text and not raw:
            words.append(text)
            if count["a"]:
                linked += len(text)
        if name is None:
            continue
        if ending:
            if name == "p" and not count["p"] and not raw:
                flush()
            close(name)
            continue
        if raw and (name == "body" or name in ENDS_P) and count["head"]:
            close("head")  # its end tag is missing
        if not raw and not foreign:
            if name not in INLINE:
                flush()
                if name in ENDS_P:
                    close("p")
                if name in IMPLIED:
                    for i in reversed(shape):
                        if stack[i].name in IMPLIED[name]:
                            cut(i)
                            break
                        if stack[i].name in BARS:
                            break
            elif name == "br":
                words.append(" ")
        if name in VOID or attributes.rstrip().endswith("/") and name not in ("a", "p", "div") or name in LONG_ONLY:
            continue
        found, label = opened(name, attributes)
        above = stack[-1] if stack else root
        new = {f for f in found if (known is None or f in known) and f not in above.found}
        if name in IMPLIED or name in BARS:
            shape.append(len(stack))
        inside = foreign or name in INLINE
        stack.append(Open(name, above.found | new if new else above.found, above.label if label is None else label, above.own if inside else name))
        count[name] += 1
        raw += name in RAW
        foreign += name in FOREIGN
    flush()
    return done


def describe(text: str, linked: int, element: Open) -> list[str]:
    """The features of a block: those of its ancestors, its own tag, and shapes of its text."""
    found = {"bias", *element.found}
    n = text.count(" ") + 1
    found.add(f"tag:{element.own}")
    found.add(f"words:{min(n.bit_length(), 7)}")
    found.add(f"links:{min(4, 4 * linked // max(1, len(text)))}")
    found.add("ends" if _FINISH.search(text) else "open")
    if "©" in text:
        found.add("sign")
    if text.count("|") + text.count("·") + text.count("›") >= 2:
        found.add("bars")
    return sorted(found)


@dataclass
class Chain:
    """Weights of label 1 over label 0 by feature, and of pairs of neighbouring labels."""

    weights: dict[str, float]
    pairs: np.ndarray  # 2 x 2

    def scores(self, page: list[Block]) -> list[float]:
        get = self.weights.get
        return [sum([get(f, 0.0) for f in b.features]) for b in page]

    def decode(self, page: list[Block]) -> list[int]:
        """Viterbi: the labelling with the greatest sum of scores."""
        if not page:
            return []
        (p00, p01), (p10, p11) = self.pairs.tolist()
        off, on, back = 0.0, 0.0, []
        for i, s in enumerate(self.scores(page)):
            if i == 0:
                off, on = 0.0, s
                continue
            from_on0, from_on1 = on + p10 > off + p00, on + p11 >= off + p01
            back.append((from_on0, from_on1))
            off, on = (on + p10 if from_on0 else off + p00), (on + p11 if from_on1 else off + p01) + s
        label = int(on >= off)
        labels = [label]
        for step in reversed(back):
            label = int(step[label])
            labels.append(label)
        return labels[::-1]


def train(pages: list[list[Block]], steps: int = 120, rate: float = 0.3, penalty: float = 1e-4) -> Chain:
    """Maximum likelihood with an L2 penalty, by adaptive gradient steps; forward-backward gives the expectations."""
    pages = [p for p in pages if p]
    names = sorted({f for p in pages for b in p for f in b.features})
    place = {f: i for i, f in enumerate(names)}
    rows = np.array([r for r, b in enumerate(b for p in pages for b in p) for _ in b.features])
    cols = np.array([place[f] for p in pages for b in p for f in b.features])
    labels = np.array([b.label for p in pages for b in p])
    length = max(map(len, pages))
    grid = np.full((len(pages), length), -1)
    at = 0
    for i, p in enumerate(pages):
        grid[i, :len(p)] = np.arange(at, at + len(p))
        at += len(p)
    real = grid >= 0
    weights, pairs = np.zeros(len(names)), np.zeros((2, 2))
    seen_w, seen_p = np.full(len(names), 1e-8), np.full((2, 2), 1e-8)
    truth = labels[grid.clip(0)]
    both = real[:, 1:]
    counted = np.array([[((truth[:, :-1] == a) & (truth[:, 1:] == b) & both).sum() for b in (0, 1)] for a in (0, 1)])
    for _ in range(steps):
        score = np.bincount(rows, weights[cols], minlength=len(labels))
        unary = np.zeros((*grid.shape, 2))
        unary[..., 1] = np.where(real, score[grid.clip(0)], 0)
        forward, backward = unary.copy(), np.zeros_like(unary)
        for t in range(1, length):
            step = np.logaddexp.reduce(forward[:, t - 1, :, None] + pairs, axis=1) + unary[:, t]
            forward[:, t] = np.where(real[:, t, None], step, forward[:, t - 1])
        for t in range(length - 2, -1, -1):
            step = np.logaddexp.reduce(pairs + (unary[:, t + 1] + backward[:, t + 1])[:, None, :], axis=2)
            backward[:, t] = np.where(real[:, t + 1, None], step, 0)
        total = np.logaddexp.reduce(forward[:, -1], axis=1)
        on = np.exp(forward[..., 1] + backward[..., 1] - total[:, None])[real]
        joint = np.exp(forward[:, :-1, :, None] + pairs + (unary[:, 1:] + backward[:, 1:])[:, :, None, :] - total[:, None, None, None])
        slope_w = np.bincount(cols, (labels - on)[rows], minlength=len(names)) / len(pages) - penalty * weights
        slope_p = (counted - joint[both].sum(axis=0)) / len(pages) - penalty * pairs
        seen_w += slope_w**2
        seen_p += slope_p**2
        weights += rate * slope_w / np.sqrt(seen_w)
        pairs += rate * slope_p / np.sqrt(seen_p)
    return Chain({f: float(w) for f, w in zip(names, weights, strict=True)}, pairs)


# Labelled pages: layouts of common kinds of sites, with the main text's elements marked.

_SYLLABLES = "an be ca do el fi go ha in jo ka lo me no or pa qui re sa te un ve wi xa yo zu ment tion sch que ción der é ü ö".split()


def _sentence(rng: random.Random, least: int = 4, most: int = 24) -> str:
    said = ["".join(rng.choices(_SYLLABLES, k=rng.randint(1, 3))) for _ in range(rng.randint(least, most))]
    if rng.random() < 0.08:  # noisy texts are main text as well
        said = [w + rng.choice(("***", "%%%", "&amp;&amp;&amp;", "!!")) for w in said]
    return " ".join(said).capitalize() + rng.choices((".", "!", "?", ""), (20, 1, 1, 2))[0]


def _paragraph(rng: random.Random) -> str:
    said = " ".join(_sentence(rng) for _ in range(rng.randint(1, 6)))
    return said if rng.random() < 0.9 else _sentence(rng, 1, 2)


def _links(rng: random.Random, n: int) -> str:
    return "".join(f'<li><a href="/{i}">{_sentence(rng, 1, 2)}</a></li>' for i in range(n))


def _comment(rng: random.Random) -> str:
    return f'<div class="comment"><p class="author">{_sentence(rng, 1, 2)}</p><p>{_paragraph(rng)}</p></div>'


def labelled_page(rng: random.Random) -> str:
    """One page; elements with ``data-label`` 1 hold main text, all else is boilerplate."""
    body = []
    title = _sentence(rng, 2, 10)
    for _ in range(rng.randint(1, 9)):
        kind = rng.random()
        text = _paragraph(rng)
        if rng.random() < 0.25:
            text = f"<b>{text}"  # unclosed, as in many pages
        if rng.random() < 0.15:
            words = text.split(" ")
            k = rng.randrange(len(words))
            text = " ".join([*words[:k], f'<a href="#">{words[k]}</a>', *words[k + 1:]])
        if kind < 0.72:
            body.append(f"<p>{text}{rng.choice(('</p>', '</p>', '<br>', ''))}")
        elif kind < 0.8:
            body.append(f"<h2>{_sentence(rng, 2, 7)}</h2><p>{text}</p>")
        elif kind < 0.88:
            body.append(f"<ul>{''.join(f'<li>{_sentence(rng)}</li>' for _ in range(rng.randint(2, 5)))}</ul>")
        elif kind < 0.93:
            body.append(f"<blockquote>{text}</blockquote>")
        elif kind < 0.97:
            body.append(f"<pre>{text}</pre>")
        else:
            body.append(f"<table><tr><td>{_sentence(rng, 1, 4)}</td><td>{_sentence(rng, 1, 4)}</td></tr></table>")
        if rng.random() < 0.08:
            body.append(f'<div class="{rng.choice(("ad", "ads", "advert", "advertisement", "sponsored", "promo banner"))}" data-label="0">{_sentence(rng)}</div>')
        if rng.random() < 0.06:
            body.append(f'<aside class="{rng.choice(("related", "pullquote", "sidebar"))}" data-label="0">{_sentence(rng)}<ul>{_links(rng, 3)}</ul></aside>')
    inner = f"<h1>{title}</h1>" + "".join(body)
    wrap = rng.choice(("article", "article", "main", "article-div", "content", "post", "section", "body-div"))
    if wrap in ("article", "main", "section"):
        main = f'<{wrap} data-label="1">{inner}</{wrap}>'
    else:
        name = {"article-div": "article-body", "content": "content", "post": "post entry-content", "body-div": "story-text main"}[wrap]
        main = f'<div class="{name}" data-label="1">{inner}</div>'
    if rng.random() < 0.2:
        main = f'<main>{main}</main>'
    before, after = [], []
    nav = rng.choice((f"<nav><ul>{_links(rng, rng.randint(3, 8))}</ul></nav>", f'<div class="{rng.choice(("menu", "navbar", "breadcrumb", "nav top"))}">{_links(rng, 5)}</div>',
                      f'<ul id="menu">{_links(rng, 4)}</ul>', f"<nav>{_sentence(rng, 1, 2)} | {_sentence(rng, 1, 2)} | {_sentence(rng, 1, 2)}</nav>"))
    before.append(nav)
    if rng.random() < 0.5:
        before.append(f'<header class="{rng.choice(("site-header", "top", "masthead"))}"><p>{_sentence(rng, 1, 6)}</p></header>')
    if rng.random() < 0.4:
        before.append(f'<div class="{rng.choice(("cookie-notice", "notice", "alert", "banner", "consent", "popup modal"))}"><p>{_paragraph(rng)}</p></div>')
    if rng.random() < 0.5:
        before.append(f'<div class="{rng.choice(("ad", "ads", "advert", "sponsored"))}">{_sentence(rng, 3, 12)}</div>')
    if rng.random() < 0.3:
        before.append(f'<form action="/s"><label>{_sentence(rng, 1, 3)}</label><input name="q"><button>{_sentence(rng, 1, 1)}</button></form>')
    if rng.random() < 0.5:
        after.append(f'<aside class="{rng.choice(("sidebar", "related", "widget"))}"><h3>{_sentence(rng, 1, 4)}</h3><p>{_paragraph(rng)}</p><ul>{_links(rng, 4)}</ul></aside>')
    elif rng.random() < 0.4:
        after.append(f'<div id="{rng.choice(("sidebar", "related", "widgets", "recommended"))}"><h3>{_sentence(rng, 1, 4)}</h3><p>{_paragraph(rng)}</p></div>')
    if rng.random() < 0.5:
        said = "".join(_comment(rng) for _ in range(rng.randint(1, 4)))
        after.append(rng.choice((f'<section class="comments"><h2>{_sentence(rng, 1, 3)}</h2>{said}</section>', f'<div id="comments">{said}</div>',
                                 f'<div class="reader-comments discussion">{said}</div>', f'<ol class="commentlist"><li>{said}</li></ol>')))
    if rng.random() < 0.3:
        after.append(f'<div class="{rng.choice(("newsletter", "subscribe", "share social", "signup"))}"><p>{_sentence(rng)}</p><form><input><button>{_sentence(rng, 1, 2)}</button></form></div>')
    after.append(rng.choice((f"<footer>&copy; {_sentence(rng, 1, 3)} &middot; {_sentence(rng)}</footer>", f"<footer><p>{_paragraph(rng)}</p><ul>{_links(rng, 3)}</ul></footer>",
                             f'<div class="footer">{_sentence(rng)}</div>', f'<div id="footer"><p>{_paragraph(rng)}</p></div>')))
    if rng.random() < 0.5:
        rng.shuffle(before)
    return f"<html><head><title>{title}</title></head><body>{''.join(before)}{main}{''.join(after)}</body></html>"


TRAINING_PAGES = 400


def trained(pages: int = TRAINING_PAGES, seed: int = 7) -> Chain:
    """The model of so many labelled pages; the same in every run."""
    rng = random.Random(seed)
    return train([blocks(labelled_page(rng)) for _ in range(pages)])


def main_text(page: str, chain: Chain) -> str:
    own = blocks(page, chain.weights)
    return "\n\n".join([b.text for b, on in zip(own, chain.decode(own), strict=True) if on])


def extracted(pages: DataFrame, chain: Chain) -> DataFrame:
    """Every row of ``pages`` (page_id, url, html): page_id, url, text and n_chars (code points).

    A null or empty page has an empty text. Rows are read one by one, so repeated rows repeat; a
    null id or url stays null; other columns are not read.
    """
    def extract(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [main_text(h, chain) for h in batch.column(2).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(texts, pa.string()), pa.array(map(len, texts), pa.int64())],
                                             names=["page_id", "url", "text", "n_chars"])

    rows = pages.select(F.col("page_id").cast("long"), "url", text_or_empty("html").alias("html"))
    return rows.mapInArrow(extract, "page_id long, url string, text string, n_chars long")
