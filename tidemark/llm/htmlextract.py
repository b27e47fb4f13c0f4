"""Main text of web pages: a linear-chain conditional random field over the leaf blocks of the DOM.

A leaf block is the text between two tags of blocks. Its features are its ancestors' tags and the words of their class,
id and role, and properties of its text; the chain's labels are text and rest. The field is trained on labelled pages:
this module writes them, from layouts whose parts are known (training_pages), so that every block has a label. Pages
are decoded by Viterbi, each for itself.
"""

from __future__ import annotations

import html
import random
import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StringType, StructField, StructType

# Fixed values of the HTML standard: elements without end tags, of raw text, that are never shown, and inline ones.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea title noembed noframes iframe".split())
HIDDEN = frozenset("script style head title template textarea select option datalist iframe noframes noembed".split())
INLINE = frozenset("a abbr acronym b bdi bdo big cite code data del dfn em font i img input ins kbd label mark nobr output q rp rt ruby s samp small span strike strong sub sup time tt u var wbr br math maction annotation menclose merror mfenced mfrac mi mmultiscripts mn mo mover mpadded mphantom mroot mrow ms mspace msqrt mstyle msub msubsup msup mtable mtd mtext mtr munder munderover semantics svg g path circle ellipse line polygon polyline rect defs use text tspan textpath canvas audio video object".split())
#: What a head may hold: anything else ends a head whose end tag is left out.
HEAD = frozenset("base basefont bgsound link meta noframes noscript script style template title head".split())
CLOSED_BY = {"p": "p", "li": "li", "dt": "dt dd", "dd": "dt dd", "tr": "tr td th", "td": "td th", "th": "td th", "option": "option"}
SCOPES = frozenset("ul ol dl table article section aside main nav div body blockquote".split())

TOKEN = re.compile(r"""<!--.*?(?:-->|\Z)|<[!?][^>]*>|<(/?)([a-zA-Z][^\s/>]*+)((?:[^>"']++|"[^"]*+"|'[^']*+')*+)>|<(/?)([a-zA-Z][^\s/>]*+)([^>]*+)>""", re.S)
COMMENT = re.compile(r"<!--.*", re.S)
NAMED = re.compile(r"""(?:^|[\s"'/])(class|id|role|aria-label|data-keep)\s*=\s*("[^"]*"|'[^']*'|[^\s"'>]+)""", re.I)
WORD = re.compile(r"[a-z]+|[A-Z]+(?![a-z])|[A-Z][a-z]+")
SPACES = re.compile(r"\s+")


@dataclass
class Block:
    text: str
    features: frozenset[str]
    label: bool
    links: int
    parent: str


def _attributes(text: str) -> tuple[list[str], bool | None]:
    """Words of class, id and role, and names of several words as a whole; the training label, if the tag carries one."""
    words, label = [], None
    if "=" in text:
        for name, value in NAMED.findall(text):
            value = value.strip("\"'")
            if name.lower() == "data-keep":
                label = value == "1"
            else:
                for one in html.unescape(value).split():
                    own = [w.lower() for w in WORD.findall(one)]
                    words += [f"word={w}" for w in own]
                    if len(own) > 1:
                        words.append(f"name={'-'.join(own)}")
    return words, label


@dataclass
class Element:
    tag: str
    parent: int
    words: list[str]
    hidden: bool
    label: bool
    block: str  # tag of the innermost element that is not inline, itself included


def blocks(page: str) -> list[Block]:
    """The leaf blocks of a page in order; time grows with the page's length, also where tags are never closed."""
    out: list[tuple[str, int, int]] = []  # text, element, characters in links
    elements = [Element("#", -1, [], False, False, "#")]
    stack = [0]
    opened: Counter[str] = Counter()  # tags on the stack
    parts: list[str] = []
    links, in_link, at, end = 0, 0, 0, len(page)
    last = page.rfind(">")

    def flush() -> None:
        nonlocal links
        if parts:
            text = SPACES.sub(" ", html.unescape("".join(parts))).strip()
            parts.clear()
            if text:
                out.append((text, stack[-1], links))
        links = 0

    def cut(depth: int) -> None:
        for e in stack[depth:]:
            opened[elements[e].tag] -= 1
        del stack[depth:]

    while at < end:
        # without a later > only a comment can follow
        m = TOKEN.search(page, at) if at <= last else COMMENT.search(page, at)
        stop = m.start() if m else end
        top = elements[stack[-1]]
        if top.tag == "head" and page[at:stop].strip("\t\n\f\r "):
            cut(len(stack) - 1)
            top = elements[stack[-1]]
        if stop > at and not top.hidden:
            parts.append(page[at:stop])
            links += (stop - at) * (in_link > 0)
        if not m:
            break
        name = (m[2] or m[5]) if at <= last else None
        at = m.end()
        if not name:
            continue
        tag, closing, attributes = name.lower(), m[1] or m[4], (m[3] or m[6] or "")
        if not closing and top.tag == "head" and tag not in HEAD:
            cut(len(stack) - 1)
        if closing:
            if tag not in INLINE:
                flush()
            elif tag == "a":
                in_link = max(in_link - 1, 0)
            if opened[tag] > 0:
                for i in range(len(stack) - 1, 0, -1):
                    own = elements[stack[i]].tag
                    if own == tag:
                        cut(i)
                        break
                    if tag in INLINE and own not in INLINE:  # an inline tag's end closes no block
                        break
        elif tag in VOID:
            if tag == "br":
                parts.append(" ")
            elif tag not in INLINE:
                flush()
        else:
            if tag not in INLINE:
                flush()
                while elements[stack[-1]].tag in INLINE:
                    cut(len(stack) - 1)
                in_link = 0
                closes = CLOSED_BY.get(tag, "" if tag in ("tbody", "thead", "tfoot") else "p").split()
                if any(opened[c] > 0 for c in closes):
                    for i in range(len(stack) - 1, 0, -1):
                        own = elements[stack[i]].tag
                        if own in closes:
                            cut(i)
                            break
                        if own in SCOPES:
                            break
            elif tag == "a":
                in_link += 1
            words, label = _attributes(attributes)
            parent = elements[stack[-1]]
            elements.append(Element(tag, stack[-1], words, parent.hidden or tag in HIDDEN, parent.label if label is None else label, parent.block if tag in INLINE else tag))
            stack.append(len(elements) - 1)
            opened[tag] += 1
            if tag in RAW:
                close = re.compile(rf"</{tag}\b[^>]*>", re.I).search(page, at) if at <= last else None
                at = close.end() if close else end
                cut(len(stack) - 1)
    flush()
    own = _element_features(elements, out)
    return [Block(text, own[e], elements[e].label, linked, elements[e].block) for text, e, linked in out]


def _element_features(elements: list[Element], out: list[tuple[str, int, int]]) -> list[frozenset[str]]:
    """Tags and words of each element and its ancestors.

    Words on html and body, and on an element that holds most of the page's text around another such element (one with
    words of its own, an article or a main part), tell about the page, not about the block: they are left out.
    """
    size = [0] * len(elements)
    for text, e, _ in out:
        size[e] += len(text)
    total = sum(size)
    for e in range(len(elements) - 1, 0, -1):
        size[elements[e].parent] += size[e]
    wide = [e for e in range(1, len(elements)) if 2 * size[e] > total and elements[e].tag not in INLINE]  # each inside the one before
    inner = max((e for e in wide if elements[e].words or elements[e].tag in ("article", "main")), default=0)
    around = {e for e in wide if e < inner}
    found = [frozenset[str]()]
    for e in range(1, len(elements)):
        x = elements[e]
        above = found[x.parent]
        if x.tag in INLINE and not x.words:
            found.append(above)
            continue
        own = {f"tag={x.tag}"}
        if e not in around and x.tag not in ("html", "body"):
            own.update(x.words)
        found.append(above if own <= above else above | own)
    return found


def features(block: Block) -> list[str]:
    """All features of a block."""
    text = block.text
    n = len(text)
    words = text.count(" ") + 1
    share = min(block.links / n, 1.0)
    own = [f"in={block.parent}", f"words={min(words.bit_length(), 8)}", f"links={int(share * 4)}", f"stop={text[-1] in '.!?…:;»”\"'}", f"sentences={min(sum(text.count(c) for c in '.!?'), 4)}"]
    if "©" in text or "(c)" in text:
        own.append("copyright")
    return [*block.features, *own]


class Field:
    """Weights of a two-label chain: features for the label text, transitions, start."""

    def __init__(self, weights: dict[str, float], moves: np.ndarray, start: float):
        self.weights, self.moves, self.start = weights, moves, start

    def decode(self, found: list[Block]) -> list[bool]:
        """The likeliest labels of a page's blocks."""
        if not found:
            return []
        get = self.weights.get
        move = self.moves.tolist()
        scores = [sum(get(f, 0.0) for f in features(b)) for b in found]
        no, yes, back = 0.0, scores[0] + self.start, []
        for s in scores[1:]:
            a, b, c, d = no + move[0][0], yes + move[1][0], no + move[0][1], yes + move[1][1]
            back.append((b > a, d > c))
            no, yes = max(a, b), max(c, d) + s
        label = yes > no
        out = [label]
        for from_no, from_yes in reversed(back):
            label = from_yes if label else from_no
            out.append(label)
        return out[::-1]

    @classmethod
    def train(cls, pages: list[list[Block]], rounds: int = 200, penalty: float = 0.02, rate: float = 0.1) -> Field:
        """Maximises the labels' penalised likelihood by gradient steps; marginals by the forward-backward recursion."""
        pages = [p for p in pages if p]
        names: dict[str, int] = {}
        longest = max(map(len, pages))
        page_of, at_of, rows, cols, label = [], [], [], [], []
        n = 0
        for i, page in enumerate(pages):
            for t, block in enumerate(page):
                page_of.append(i)
                at_of.append(t)
                label.append(block.label)
                for f in features(block):
                    rows.append(n)
                    cols.append(names.setdefault(f, len(names)))
                n += 1
        page_of, at_of, rows, cols, label = map(np.array, (page_of, at_of, rows, cols, label))
        lengths = np.array([len(p) for p in pages])
        y = np.zeros((len(pages), longest), int)
        y[page_of, at_of] = label
        inside = np.arange(longest) < lengths[:, None]
        step_in = inside[:, 1:]
        pairs = np.zeros((2, 2))
        np.add.at(pairs, (y[:, :-1][step_in], y[:, 1:][step_in]), 1)
        observed = np.bincount(cols, weights=label[rows], minlength=len(names))
        first = y[:, 0].sum()
        theta = np.zeros(len(names) + 5)
        mean, square = np.zeros_like(theta), np.zeros_like(theta)
        for k in range(1, rounds + 1):
            w, moves, start = theta[: len(names)], theta[len(names) : len(names) + 4].reshape(2, 2), theta[-1]
            emit = np.zeros((len(pages), longest, 2))
            emit[page_of, at_of, 1] = np.bincount(rows, weights=w[cols], minlength=n)
            emit[:, 0, 1] += start
            forward, backward = np.zeros_like(emit), np.zeros_like(emit)
            forward[:, 0] = emit[:, 0]
            for t in range(1, longest):
                new = np.logaddexp.reduce(forward[:, t - 1, :, None] + moves, axis=1) + emit[:, t]
                forward[:, t] = np.where(inside[:, t, None], new, forward[:, t - 1])
            for t in range(longest - 2, -1, -1):
                new = np.logaddexp.reduce(moves + (emit[:, t + 1] + backward[:, t + 1])[:, None, :], axis=2)
                backward[:, t] = np.where(inside[:, t + 1, None], new, 0)
            total = np.logaddexp.reduce(forward[:, -1], axis=1)
            chance = np.exp(forward[:, :, 1] + backward[:, :, 1] - total[:, None])
            both = np.exp(forward[:, :-1, :, None] + moves + (emit[:, 1:] + backward[:, 1:])[:, :, None, :] - total[:, None, None, None])
            gradient = np.r_[observed - np.bincount(cols, weights=chance[page_of, at_of][rows], minlength=len(names)), (pairs - (both * step_in[:, :, None, None]).sum(axis=(0, 1))).ravel(), first - chance[:, 0].sum()]
            gradient = gradient - penalty * theta
            mean, square = 0.9 * mean + 0.1 * gradient, 0.99 * square + 0.01 * gradient * gradient
            theta = theta + rate * (mean / (1 - 0.9**k)) / (np.sqrt(square / (1 - 0.99**k)) + 1e-8)
        return cls(dict(zip(names, theta[: len(names)].tolist(), strict=True)), theta[len(names) : len(names) + 4].reshape(2, 2), float(theta[-1]))


def training_pages(count: int = 400, seed: int = 11) -> list[str]:
    """Pages of many layouts; the attribute data-keep of their parts is the label and is no feature."""
    r = random.Random(seed)
    syllables = "ba ko mi ter lan os per vi da sun gel tra ni mo re cal is tu on sche ül é ña".split()
    word = lambda: "".join(r.choice(syllables) for _ in range(r.randint(1, 4)))
    words = lambda a, b: " ".join(word() for _ in range(r.randint(a, b)))
    sentence = lambda: words(4, 18).capitalize() + r.choice([".", ".", ".", "!", "?"])
    sentences = lambda a, b: " ".join(sentence() for _ in range(r.randint(a, b)))
    link = lambda: f'<a href="/{word()}">{words(1, 3)}</a>'
    items = lambda a, b: "<ul>" + "".join(f"<li>{link()}</li>" for _ in range(r.randint(a, b))) + "</ul>"
    named = lambda tag, names, inner: f'<{tag}{r.choice([" class=", " id="])}"{r.choice(names.split())}">{inner}</{tag}>'

    contents = "content article article-body post post-content entry-content story main main-content text body-text"
    # what a page has besides, as themes write it on an element around the text
    states = "has-sidebar sidebar-right sidebar-left no-sidebar comments-open comments-closed header-fixed with-ads no-banner newsletter-popup-enabled single menu-open footer-widgets"

    def prose() -> str:
        kind = r.random()
        if kind < 0.66:
            return f"<p>{sentences(1, 6)}" + "</p>" * (r.random() < 0.8)
        if kind < 0.72:
            return f"<p>{words(1, 5)}.</p>"
        if kind < 0.78:
            return f"<h{(k := r.randint(2, 4))}>{words(2, 7)}</h{k}>"
        if kind < 0.83:
            return f"<blockquote><p>{sentences(1, 3)}</p></blockquote>"
        if kind < 0.88:
            return "<ul>" + "".join(f"<li>{r.choice([words(2, 9), sentence()])}</li>" for _ in range(r.randint(2, 5))) + "</ul>"
        if kind < 0.92:
            return f"<table><tr><th>{words(1, 2)}</th><td>{words(1, 4)}</td></tr><tr><td>{words(1, 3)}</td><td>{words(1, 3)}</td></tr></table>"
        if kind < 0.95:
            return f"<pre>{words(3, 20)}</pre>"
        if kind < 0.965:
            return f'<p><a href="/{word()}">{words(2, 8)}</a></p>'
        return f"<p>{sentence()} {link()} {sentence()}</p>"

    def story() -> str:
        body = "".join(prose() for _ in range(r.randint(1, 9)))
        head = f"<h1>{words(3, 10)}</h1>"
        if r.random() < 0.3:
            body = f"<p><b>{sentences(1, 3)}<br>" + body
        if r.random() < 0.2:
            body += named("div", "share social share-buttons related newsletter", items(2, 4)).replace("<div", '<div data-keep="0"')
        if r.random() < 0.15:
            body = f'<figure><img src="x"><figcaption>{sentence()}</figcaption></figure>' + body
        inner = head + body
        kind = r.random()
        if kind < 0.35:
            out = f"<article>{inner}</article>"
        elif kind < 0.5:
            out = f"<main><article>{inner}</article></main>"
        elif kind < 0.62:
            out = f"<main>{inner}</main>"
        elif kind < 0.7:
            out = f"<article><header>{head}</header>{body}</article>"
        elif kind < 0.78:
            out = f"<{(k := r.choice(['div', 'section']))}>{inner}</{k}>"
        else:
            out = named("div", contents, inner)
            if r.random() < 0.3:
                own = [r.choice(contents.split()), *r.sample(states.split(), r.randint(1, 3))]
                r.shuffle(own)
                out = f'<div class="{" ".join(own)}">{inner}</div>'
        return re.sub(r"^<(\w+)", r'<\1 data-keep="1"', out)

    def notice() -> str:
        inner = r.choice([f"<p>{sentences(1, 2)}</p>", sentences(1, 2)]) + r.choice(["", f"<button>{word()}</button>", link()])
        return named("div", "cookie cookie-banner consent notice gdpr banner alert popup modal paywall", inner) if r.random() < 0.8 else f'<div role="{r.choice(["dialog", "alert", "banner"])}">{inner}</div>'

    def advert() -> str:
        return named(r.choice(["div", "aside", "section"]), "ad ads advert advertisement sponsored promo sponsor ad-slot banner-ad", r.choice([sentence(), f"<p>{sentences(1, 3)}</p>", link(), words(2, 6)]))

    def comments() -> str:
        one = lambda: r.choice(["<li>", '<div class="comment">', "<p>"]) + f"<b>{word()}</b> {sentences(1, 3)}"
        if r.random() < 0.3:
            inner = "".join(f"<article><p>{sentences(1, 3)}</p></article>" for _ in range(r.randint(1, 4)))
            return named(r.choice(["div", "section"]), "comments comment-list discussion responses replies", inner)
        inner = f"<h3>{words(1, 2)}</h3>" * (r.random() < 0.6) + "".join(r.choice([one(), f'<div class="comment"><p>{sentences(1, 4)}</p></div>', f"<article><p>{sentences(1, 3)}</p></article>"]) for _ in range(r.randint(1, 5)))
        return named(r.choice(["div", "section", "ol"]), "comments comment-list comments-area discussion responses replies reader-comments", inner)

    def side() -> str:
        inner = r.choice([items(3, 6), f"<h3>{words(1, 3)}</h3>" + items(2, 5), f"<p>{sentences(1, 2)}</p>"])
        return f"<aside>{inner}</aside>" if r.random() < 0.5 else named("div", "sidebar side widget related related-posts recommended trending most-read", inner)

    def form() -> str:
        return f"<form><label>{words(1, 3)}</label><input><p>{sentence()}</p><button>{word()}</button></form>" if r.random() < 0.7 else named("div", "search newsletter subscribe signup login", f"<form><p>{sentence()}</p><input></form>")

    def menu() -> str:
        return r.choice([f"<nav>{items(3, 8)}</nav>", named("div", "menu nav navigation navbar breadcrumb breadcrumbs topnav", items(3, 7)), named("ul", "menu nav tabs", "".join(f"<li>{link()}</li>" for _ in range(5)))])

    def header() -> str:
        inner = r.choice([f"<h1>{words(1, 4)}</h1>", f"<p>{words(1, 5)}</p>", words(1, 4), sentence()]) + r.choice(["", menu()])
        return f"<header>{inner}</header>" if r.random() < 0.6 else named("div", "header site-header masthead topbar logo", inner)

    def footer() -> str:
        inner = r.choice([f"&copy; {word()}.example &middot; {sentences(1, 3)}", f"<p>&copy; {words(2, 5)}</p>" + items(2, 5), f"<p>{sentences(1, 3)}</p>"])
        return f"<footer>{inner}</footer>" if r.random() < 0.7 else named("div", "footer site-footer copyright colophon bottom", inner)

    pages = []
    for _ in range(count):
        before = [part() for part, share in ((header, 0.5), (menu, 0.8), (notice, 0.35), (advert, 0.5), (form, 0.2), (side, 0.15)) if r.random() < share]
        after = [part() for part, share in ((comments, 0.45), (side, 0.45), (advert, 0.3), (form, 0.3), (notice, 0.15)) if r.random() < share]
        r.shuffle(before)
        r.shuffle(after)
        body = "".join([*before, story(), *after, *([footer()] if r.random() < 0.85 else [])])
        if r.random() < 0.3:
            body = named("div", "page wrapper container site layout", body)
        pages.append(f"<!DOCTYPE html><html><head><title>{words(2, 5)}</title><style>p{{}}</style></head><body>{body}</body></html>")
    return pages


def trained(pages: int = 400) -> Field:
    return Field.train([blocks(p) for p in training_pages(pages)])


def main_text(page: str, model: Field) -> str:
    found = blocks(page)
    return "\n".join(b.text for b, keep in zip(found, model.decode(found), strict=True) if keep)


def extract_text(pages: DataFrame, model: Field | None = None) -> DataFrame:
    """The columns of pages with text (of the blocks decoded as text, one a line) and n_chars, its code points.

    White space inside a block becomes one space, character references are decoded, nothing else is dropped or cut: only
    what is never shown as text (scripts, styles, the head, templates, form controls, frames) is no block. A null or
    empty html, and a page without text blocks, give an empty text. Pages are decoded each for itself: ties and repeated
    rows give equal results, and very long pages are read whole. Columns of pages with the new names are replaced.
    """
    fitted = pages.sparkSession.sparkContext.broadcast(model or trained())
    others = [c for c in pages.columns if c not in ("text", "n_chars")]
    own = pages.select(F.struct(*(F.col(f"`{c}`") for c in others)).alias("row"), F.col("html").cast("string").alias("html"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [main_text(x.as_py() or "", fitted.value) for x in batch.column("html")]
            yield pa.RecordBatch.from_arrays([batch.column("row"), pa.array(texts, pa.string()), pa.array(map(len, texts), pa.int64())], ["row", "text", "n_chars"])

    schema = StructType([own.schema["row"], StructField("text", StringType()), StructField("n_chars", LongType())])
    return own.mapInArrow(run, schema).select("row.*", "text", "n_chars")
