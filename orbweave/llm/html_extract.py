"""Main-text extraction with a linear-chain conditional random field over a page's leaf blocks.

A page is cut into leaf blocks (text between block-level tags). A block's features are the tags and the
class and id words of all its ancestors, and facts about its text. Two labels, main text and the rest, form
a chain; the field is trained by maximum likelihood on labelled pages and decoded by Viterbi. Labelled
pages come from ``labelled_pages``, a seeded generator of layouts; any list of labelled pages will do.
"""

from __future__ import annotations

import html
import math
import random
import re
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from orbweave.llm.shared import table

# HTML's block-level elements, elements without an end tag, and elements that hold no text.
BLOCK_TAGS = frozenset("address article aside blockquote body button caption center dd details dialog div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 head header hgroup hr html label legend li main menu nav ol option p pre section select summary table tbody td tfoot th thead tr ul".split())
VOID_TAGS = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW_TAGS = frozenset("script style title textarea iframe noembed noframes".split())  # what they hold is no markup
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())

_ATTRIBUTES = r"""(?:[^>"']|"[^"]*"|'[^']*')*+"""
_TOKEN = re.compile(rf"<(/?)([a-zA-Z][a-zA-Z0-9:-]*)({_ATTRIBUTES})>|<(/?)([a-zA-Z][a-zA-Z0-9:-]*)([^>]*)>|<!--(?:-?>|.*?--!?>|(.*))|<[!?/][^>]*>", re.S)
_RAW_END = {tag: re.compile(rf"</{tag}(?=[\s/>])(?:{_ATTRIBUTES}>|[^>]*>)", re.S | re.I) for tag in sorted(RAW_TAGS)}
_SCRIPT_MARK = re.compile(r"<!--|-->|<(/?)script(?=[\s/>])", re.I)
FOREIGN_TAGS = ("svg", "math")  # in them a slash before ">" ends an element; HTML's own elements ignore it
_VALUE_SLASH = re.compile(r"=\s*[^\s\"'>]*/\Z")  # the end of an unquoted value
_NAMED = re.compile(r"""\b(?:class|id|role)\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s>]+))""", re.I)
_PART = re.compile(r"[a-z]+")
_CLUES = {  # fixed values: words that notices, forms and adverts use, in lower case
    "legal": ("©", "copyright", "all rights reserved", "privacy", "terms of"),
    "consent": ("cookie", "consent", "accept"),
    "social": ("subscribe", "newsletter", "share this", "follow us", "sign up", "log in", "reply"),
    "advert": ("advert", "sponsored", "promo"),
}
MARK_REST, MARK_MAIN = "\ue000", "\ue001"  # first characters of labelled blocks


@dataclass
class Block:
    context: int  # number of its ancestors' feature set
    text: str
    linked: int  # characters inside links
    tag: str


@dataclass
class Contexts:
    """Feature sets of ancestors. ``known``: the only features worth keeping (None while training)."""

    known: frozenset[str] | None = None
    sets: list[frozenset[str]] = field(default_factory=lambda: [frozenset()])
    numbers: dict = field(default_factory=dict)

    def enter(self, parent: int, tag: str, attributes: str) -> int:
        key = (parent, tag, attributes)
        found = self.numbers.get(key)
        if found is None:
            names = [f"<{tag}>"]
            for m in _NAMED.finditer(attributes):
                names += ["." + x for x in _PART.findall((m[1] or m[2] or m[3] or "").lower())]
            if self.known is not None:
                names = [x for x in names if x in self.known]
            grown = self.sets[parent].union(names)
            if len(grown) == len(self.sets[parent]):
                found = parent
            else:
                found = self.numbers.get(grown)
                if found is None:
                    found = self.numbers[grown] = len(self.sets)
                    self.sets.append(grown)
            self.numbers[key] = found
        return found


def _script_end(page: str, at: int) -> int:
    """Where a script's end tag begins. Inside ``<!-- -->`` a script tag opens another level, which its end tag closes."""
    escaped = nested = False
    while m := _SCRIPT_MARK.search(page, at):
        at = m.end()
        if m[0] == "<!--":
            if not escaped:
                escaped, at = True, at - 2  # its dashes may be those of "-->"
        elif m[0] == "-->":
            escaped = nested = False
        elif m[1] and not nested:
            return m.start()
        else:
            nested = escaped and not m[1]
    return len(page)


def silent_end(page: str, tag: str, at: int) -> int:
    """Past the end of an element without text of its own that was opened before ``at``; the page's end if nothing ends it.

    End tags may carry white space, attributes and a slash. Templates nest, and end tags in their comments and scripts are none.
    """
    last = page.rfind(">") + 1  # no tag ends behind it
    if tag in RAW_TAGS:
        m = _RAW_END[tag].search(page, _script_end(page, at) if tag == "script" else at, last)
        return m.end() if m else len(page)
    depth = 1
    while depth and (m := _TOKEN.search(page, at, last)):
        at, found, ends = m.end(), (m[2] or m[5] or "").lower(), m[1] or m[4]
        if found in RAW_TAGS and not ends:
            at = silent_end(page, found, at)
        elif found == "template":
            depth += -1 if ends else 1
    return at if not depth else len(page)


def leaf_blocks(page: str, contexts: Contexts) -> list[Block]:
    """The page's leaf blocks in order, with decoded text and single spaces.

    Comments end at ``-->``, ``--!>``, ``<!-->`` and ``<!--->``. A comment, script, style, title, text area, frame or template
    that nothing ends goes to the end of the page, as in browsers, so what follows it is no text.
    """
    stack: list[tuple[str, int]] = [("", 0)]
    open_tags: dict[str, int] = {}
    out: list[Block] = []
    parts: list[str] = []
    linked = 0

    def flush():
        nonlocal linked
        if parts:
            text = " ".join(html.unescape("".join(parts)).split())
            if text:
                out.append(Block(stack[-1][1], text, min(linked, len(text)), stack[-1][0]))
            parts.clear()
        linked = 0

    def close(tag: str):
        while True:
            name, _ = stack.pop()
            open_tags[name] -= 1
            if name == tag:
                return

    at, last = 0, page.rfind(">") + 1  # no tag ends behind it
    open_comment = page.find("<!--", last)
    size = len(page) if open_comment < 0 else open_comment
    while m := _TOKEN.search(page, at, last):
        if m.start() > at:
            parts.append(page[at : m.start()])
            if open_tags.get("a"):
                linked += m.start() - at
        at = m.end()
        tag = m[2] or m[5]
        if not tag:
            if m[7] is not None:
                at = size  # a comment that nothing ends
            continue
        tag, ends, attributes = tag.lower(), m[1] or m[4], m[3] or m[6] or ""
        foreign = tag in FOREIGN_TAGS or any(open_tags.get(x) for x in FOREIGN_TAGS)
        closed = foreign and attributes.endswith("/") and not _VALUE_SLASH.search(attributes)
        if (tag in RAW_TAGS or tag == "template") and not (ends or closed):
            at = silent_end(page, tag, at)
            continue
        if tag == "br":
            parts.append(" ")
            continue
        block = tag in BLOCK_TAGS
        if block:
            flush()
        if ends:
            if open_tags.get(tag):
                close(tag)
            continue
        if block and open_tags.get("p") and tag not in ("button", "label", "option", "select"):
            close("p")
        if tag in ("li", "option", "tr", "td", "th", "dt", "dd") and stack[-1][0] == tag:
            close(tag)
        if tag in VOID_TAGS:
            continue
        if closed:
            continue
        # inline tags only matter for their links; they keep their parent's features
        context = contexts.enter(stack[-1][1], tag, attributes) if block else stack[-1][1]
        stack.append((tag, context))
        open_tags[tag] = open_tags.get(tag, 0) + 1
    if at < size:
        parts.append(page[at:size])
    flush()
    return out


def text_features(block: Block) -> list[str]:
    text, n = block.text, len(block.text)
    size = min(7, int(math.log2(1 + n) / 1.5))
    out = ["bias", f"size:{size}", f"links:{min(4, 5 * block.linked // max(n, 1))}", f"tag:{'h' if block.tag in HEADINGS else block.tag if block.tag in ('p', 'li', 'td', 'div', 'pre', 'blockquote') else 'other'}"]
    out.append("stop" if text[-1] in ".!?…:;。" else "nostop")
    low = text.lower()
    out += [f"{k}:{size}" for k, clues in _CLUES.items() if any(x in low for x in clues)]  # a clue says less in a long text
    return out


@dataclass(frozen=True)
class Field:
    """A trained field: weights of main text against the rest, and transition scores (rest, main) x (rest, main)."""

    weights: dict[str, float]
    transitions: tuple[tuple[float, float], tuple[float, float]]

    def label(self, scores: list[float]) -> list[int]:
        """The best labels by Viterbi; ``scores``: what speaks for main text, block by block."""
        (rr, rm), (mr, mm) = self.transitions
        back, rest, main = [], 0.0, scores[0]
        for s in scores[1:]:
            from_rest, from_main = int(main + mr > rest + rr), int(main + mm > rest + rm)
            back.append((from_rest, from_main))
            rest, main = max(rest + rr, main + mr), s + max(rest + rm, main + mm)
        at = int(main > rest)
        labels = [at]
        for step in reversed(back):
            at = step[at]
            labels.append(at)
        return labels[::-1]


class Extractor:
    """Applies a field to pages; remembers ancestors' scores from page to page within a bound."""

    MOST_CONTEXTS = 20_000

    def __init__(self, crf: Field):
        self.field = crf
        self.known = frozenset(k for k in crf.weights if k[0] in "<.")
        self.reset()

    def reset(self):
        self.contexts, self.scores = Contexts(self.known), [0.0]

    def main_blocks(self, page: str | None) -> list[str]:
        if len(self.contexts.numbers) > self.MOST_CONTEXTS:
            self.reset()
        blocks = leaf_blocks(page or "", self.contexts)
        if not blocks:
            return []
        weights = self.field.weights
        for known in self.contexts.sets[len(self.scores) :]:
            self.scores.append(sum(weights[x] for x in known))
        scores = [self.scores[b.context] + sum(weights.get(x, 0.0) for x in text_features(b)) for b in blocks]
        return [b.text for b, y in zip(blocks, self.field.label(scores), strict=True) if y]


# --- labelled pages -----------------------------------------------------------------------------------------

_SYLLABLES = "ba ce di fo gu la me ni po ra se ti vo xa ze lo mi nu pa re so ta".split()
# How layouts name their parts.
MAIN_AREAS = ('<article>', '<main>', '<main><article>', '<div class="content">', '<div id="main-content">', '<div class="post-body">', '<section class="entry">', '<div class="article-text">', '<div role="main">', '<article class="post">', '<div><article>', '<div>', '<section>', '<div class="page"><div>', '', '', '', '')
REST_AREAS = {
    "menu": ('<nav>', '<div class="menu">', '<div id="navigation">', '<div class="navbar">', '<div class="breadcrumb">', '<header>', '<header class="site-header">'),
    "header": ('<header>', '<div id="header">', '<div class="masthead">', '<div class="top-bar">', '<div class="site-title">'),
    "footer": ('<footer>', '<div id="footer">', '<div class="footer">', '<div class="copyright">', '<footer class="site-footer">'),
    "sidebar": ('<aside>', '<div class="sidebar">', '<div class="widget">', '<div id="related">', '<aside class="related">', '<div class="recommended">'),
    "advert": ('<div class="ad">', '<div class="ads">', '<div class="advert">', '<div id="ad-banner">', '<div class="sponsored">', '<aside class="promo">', '<div class="advertisement">'),
    "notice": ('<div class="cookie-notice">', '<div id="consent">', '<div class="notice">', '<div role="alert">', '<div class="banner">', '<div class="popup">', '<dialog>', '<div class="alert">'),
    "form": ('<form>', '<form class="newsletter">', '<div class="subscribe"><form>', '<form id="search">', '<div class="login">'),
    "comments": ('<div id="comments">', '<section class="comments">', '<div class="comment-list">', '<ol class="commentlist">', '<section id="discussion" class="comment">', '<div class="replies">'),
    "social": ('<div class="share">', '<div class="social">', '<ul class="sharing">'),
}
_PHRASES = {"notice": ("We use cookies, accept?", "Your consent matters."), "footer": ("© all rights reserved", "Privacy and terms of use"), "form": ("Subscribe to the newsletter", "Sign up", "Log in"), "social": ("Share this", "Follow us"), "advert": ("Sponsored", "Advertisement"), "comments": ("Reply", "Leave a comment")}


def _sentence(r: random.Random, least: int, most: int) -> str:
    words = ["".join(r.choice(_SYLLABLES) for _ in range(r.randint(1, 4))) for _ in range(r.randint(least, most))]
    return " ".join(words).capitalize() + "."


def _closing(area: str) -> str:
    return "".join(f"</{t}>" for t in reversed(re.findall(r"<(\w+)", area)))


def _rest_part(r: random.Random, kind: str) -> str:
    area = r.choice(REST_AREAS[kind])
    texts = [r.choice(_PHRASES[kind])] if kind in _PHRASES and r.random() < 0.5 else []
    if kind in ("menu", "social", "sidebar") and r.random() < 0.7:
        items = "".join(f'<li><a href="/x">{MARK_REST}{_sentence(r, 1, 3)[:-1]}</a></li>' for _ in range(r.randint(2, 7)))
        return f"{area}<ul>{items}</ul>{_closing(area)}"
    long = kind in ("comments", "advert", "notice", "sidebar", "footer")
    texts += [_sentence(r, 2, 40 if long else 8) for _ in range(r.randint(1, 4 if kind == "comments" else 2))]
    wrap = r.choice(("p", "div", "span")) if len(texts) == 1 else r.choice(("p", "div", "li"))
    inner = "".join(f"<{wrap}>{MARK_REST}{t}</{wrap}>" for t in texts)
    return f"{area}{inner}{_closing(area)}"


def labelled_pages(count: int, seed: int = 7) -> list[str]:
    """Pages whose blocks begin with MARK_MAIN or MARK_REST; layouts differ in tags, names, order and nesting."""
    r, pages = random.Random(seed), []
    for _ in range(count):
        area = r.choice(MAIN_AREAS)
        body = [f"<h1>{MARK_MAIN}{_sentence(r, 2, 9)[: -1 if r.random() < 0.7 else None]}</h1>"] if r.random() < 0.8 else []
        for _ in range(r.choice((1, 2, 4, 8, 14))):
            kind = r.random()
            if kind < 0.65:
                body.append(f"<p>{MARK_MAIN}{_sentence(r, 1, 90)}</p>")
            elif kind < 0.72:
                body.append(f"<h2>{MARK_MAIN}{_sentence(r, 1, 5)[:-1]}</h2>")
            elif kind < 0.8:
                body.append("<ul>" + "".join(f"<li>{MARK_MAIN}{_sentence(r, 1, 12)}</li>" for _ in range(r.randint(1, 5))) + "</ul>")
            elif kind < 0.86:
                body.append(f"<blockquote>{MARK_MAIN}{_sentence(r, 3, 40)}</blockquote>")
            elif kind < 0.9:
                body.append(f"<pre>{MARK_MAIN}{_sentence(r, 3, 20)}</pre>")
            elif kind < 0.95:
                body.append(f"<p><b>{MARK_MAIN}{_sentence(r, 2, 30)}<br>")
            else:
                body.append("<table><tr>" + "".join(f"<td>{MARK_MAIN}{_sentence(r, 1, 4)[:-1]}</td>" for _ in range(3)) + "</tr></table>")
        for kind in r.sample(("advert", "sidebar", "comments", "social", "form", "notice"), r.choice((0, 0, 1, 2, 3))):
            body.insert(r.randint(1, len(body)) if body and kind in ("advert", "sidebar") else len(body), _rest_part(r, kind))
        before = [_rest_part(r, k) for k in ("menu", "header", "advert", "notice", "form", "sidebar") if r.random() < (0.85 if k == "menu" else 0.35)]
        after = [_rest_part(r, k) for k in ("comments", "sidebar", "advert", "social", "form", "notice") if r.random() < 0.3]
        if r.random() < 0.85:
            after.append(_rest_part(r, "footer"))
        r.shuffle(before)
        pages.append(f"<html><head><title>x</title></head><body>{''.join(before)}{area}{''.join(body)}{_closing(area)}{''.join(after)}</body></html>")
    return pages


def train(pages: list[str], rounds: int = 200, rate: float = 0.2, penalty: float = 0.05) -> Field:
    """Maximum likelihood with a Gaussian prior, by Adam; all pages advance side by side."""
    contexts, rows, truth = Contexts(), [], []
    for page in pages:
        blocks = leaf_blocks(page, contexts)
        labels = [int(b.text[0] == MARK_MAIN) for b in blocks]
        for b in blocks:
            b.text = b.text[1:].strip() or "."
        rows.append([contexts.sets[b.context] | set(text_features(b)) for b in blocks])
        truth.append(labels)
    names = sorted({x for row in rows for b in row for x in b})
    number = {x: i for i, x in enumerate(names)}
    n, most = len(rows), max(map(len, rows))
    x = np.zeros((n, most, len(names)), dtype=np.float32)
    y, live = np.zeros((n, most), dtype=int), np.zeros((n, most), dtype=bool)
    for p, row in enumerate(rows):
        for i, b in enumerate(row):
            x[p, i, [number[k] for k in b]] = 1
            y[p, i], live[p, i] = truth[p][i], True
    flat = x[live]
    wanted = np.zeros((2, 2))
    pairs = live[:, 1:]
    np.add.at(wanted, (y[:, :-1][pairs], y[:, 1:][pairs]), 1)
    theta = np.zeros(len(names) + 4)
    m = v = np.zeros_like(theta)
    for step in range(1, rounds + 1):
        emit = np.zeros((n, most, 2))
        emit[live, 1] = flat @ theta[: len(names)]
        trans = theta[len(names) :].reshape(2, 2)
        forward, backward = np.zeros((n, most, 2)), np.zeros((n, most, 2))
        forward[:, 0] = emit[:, 0]
        for t in range(1, most):
            forward[:, t] = emit[:, t] + np.logaddexp.reduce(forward[:, t - 1, :, None] + trans, axis=1)
        for t in range(most - 2, -1, -1):
            came = np.logaddexp.reduce(trans + (emit[:, t + 1] + backward[:, t + 1])[:, None, :], axis=2)
            backward[:, t] = np.where(live[:, t + 1, None], came, 0.0)
        both = forward + backward
        total = np.logaddexp.reduce(both[:, 0], axis=1)
        gamma = np.exp(both[..., 1] - total[:, None])
        pair = np.exp(forward[:, :-1, :, None] + trans + (emit + backward)[:, 1:, None, :] - total[:, None, None, None])[pairs].sum(axis=0)
        gradient = np.concatenate([flat.T @ (y - gamma)[live], (wanted - pair).ravel()]) - penalty * theta
        m, v = 0.9 * m + 0.1 * gradient, 0.99 * v + 0.01 * gradient**2
        theta = theta + rate * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.99**step)) + 1e-8)
    t = theta[len(names) :]
    return Field({k: float(theta[i]) for k, i in number.items()}, ((float(t[0]), float(t[1])), (float(t[2]), float(t[3]))))


TRAINING_PAGES = 400  # bound of the labelled sample


def _extract(crf: Field):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        extractor = Extractor(crf)
        for batch in batches:
            page = batch.column(batch.num_columns - 1)
            for lo in range(0, batch.num_rows, 200):
                blocks = [extractor.main_blocks(h.as_py()) for h in page.slice(lo, 200)]
                kept = [batch.column(i).slice(lo, 200) for i in range(batch.num_columns - 1)]
                yield pa.RecordBatch.from_arrays([*kept, pa.array(blocks, pa.list_(pa.string()))], names=[*batch.schema.names[:-1], "blocks"])

    return run


def extract_main_text(pages: DataFrame, crf: Field) -> DataFrame:
    """(page_id, url, blocks, text) for each row: the main text's blocks, and their join by blank lines.

    A null or empty page, or one without main text, gives no blocks and an empty text. Null ids and repeated
    rows keep their rows; an empty table gives an empty result; other columns are not read.
    """
    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), "url", "html")
    made = rows.mapInArrow(_extract(crf), "page_id long, url string, blocks array<string>")
    return made.withColumn("text", F.array_join("blocks", "\n\n"))


def op9_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The main text of every page, by a field trained on generated labelled pages."""
    found = extract_main_text(table(spark, sf_dir, "pages"), train(labelled_pages(TRAINING_PAGES)))
    return found.select("page_id", "url", "text", F.length("text").cast("long").alias("n_chars"))
