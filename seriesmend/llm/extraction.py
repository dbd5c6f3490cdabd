"""Main text of web pages: a conditional random field over the leaf blocks of the DOM.

1. A page is read once into leaf blocks: stretches of text between the starts and ends of
   block elements, each with its ancestors' tags and class words and features of its text.
2. A linear chain over a page's blocks has two states, main text or not; a block's
   features score its state, a 2 x 2 matrix scores neighbours.  It is fitted by maximum
   likelihood (forward and backward sums, L2) and decoded by Viterbi.
3. It is trained on at most ``TRAIN_PAGES`` pages of the table that mark their text
   themselves (an article or main element without the parts listed in ``ASIDES``), chosen
   by a hash of page_id, and on as many pages of hand-labelled layouts filled with texts
   from those.  In every second of the former, landmarks are turned into plain div
   elements, so that class words, links, lengths and neighbours must do.  The weights are ``SIZE`` numbers,
   whatever the table's size.

Scripts, styles, titles, comments and other raw elements hold no blocks.  Character
references are decoded, white space (any) becomes one space, blocks are joined by a line
feed; ``br`` is white space.  Reading is linear also in broken pages: unclosed comments
and raw elements end the page, unmatched end tags are ignored.

A null or empty html gives an empty text; null page_id or url are handed through, such
pages aren't trained on; repeated rows give equal results; an empty table gives no rows.
Very long pages are read whole, one at a time.  Other columns aren't read.
"""

from __future__ import annotations

import html as entities
import re
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from seriesmend.llm.common import quoted
from seriesmend.llm.layouts import labelled_pages

TRAIN_PAGES = 400
TRAIN_CHARS = 200_000    # longer pages aren't trained on
FEATURES = 4096
SIZE = FEATURES + 6      # and start (2) and transition (4) scores
ROUNDS, RATE, L2 = 120, 0.15, 2e-4
PREFIX = 5               # letters of a longer class word that count on their own
BYTES_AT_ONCE = 4 << 20  # of results

# ---- leaf blocks -------------------------------------------------------------

# fixed by the HTML standard
BLOCKS = frozenset(
    "address article aside blockquote body button caption center col colgroup dd details dialog dir div dl dt fieldset "
    "figcaption figure footer form h1 h2 h3 h4 h5 h6 head header hgroup hr html legend li main menu nav ol optgroup "
    "option p pre search section select summary table tbody td tfoot th thead tr ul".split()
)
SECTIONS = frozenset("article aside footer form header main nav section".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style title textarea noscript iframe noembed noframes xmp template svg math".split())
ENDED_BY = {"li": ("li",), "dt": ("dt", "dd"), "dd": ("dt", "dd"), "tr": ("td", "th", "tr"), "td": ("td", "th"),
            "th": ("td", "th"), "option": ("option",), "tbody": ("td", "th", "tr", "thead", "tbody")}

TAG = re.compile(r"<(/?)([a-zA-Z][^\s/>]*+)([^>=]*+(?:=\s*+(?:\"[^\"]*+\"|'[^']*+')?+[^>=]*+)*+)>")
NAMES = re.compile(r"\b(class|id|role|itemprop|data-y)\s*+=\s*+(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+))", re.I)
NAME_PART = re.compile(r"[A-Za-z][a-z]*+|[0-9]++")
RAW_END = {name: re.compile(f"</{name}(?=[\\s/>])", re.I) for name in RAW}

LANDMARKS = frozenset(("article", "main"))
# parts of an article that aren't its text: elements, and words of classes
ASIDE_TAGS = frozenset("nav aside footer form select button fieldset".split())
ASIDES = frozenset(
    "ad ads advert advertisement banner comment comments commentlist cookie footer login menu nav newsletter notice promo "
    "related reply responses share sidebar social sponsored subscribe widget".split()
)
CUES = re.compile(
    r"©|copyright|all rights reserved|cookies?\b|newsletter|subscribe|sign (?:in|up)|log ?in|privacy policy|"
    r"advertisement|sponsored|read more|share this|leave a comment|datenschutz|impressum|mentions légales|aviso legal", re.I)

_known: dict[str, int] = {}


def feature(name: str) -> int:
    """A feature's place, by a hash that is the same everywhere."""
    place = _known.get(name)
    if place is None:
        if len(_known) > 50_000:
            _known.clear()
        place = _known[name] = zlib.crc32(name.encode("utf-8", "replace")) % FEATURES
    return place


LANDMARK_TAG = re.compile(r"<(/?)(?:article|main)(?=[\s/>])", re.I)


def _described(name: str, attributes: str) -> tuple[list[str], list[int]]:
    """An element's name and class words, and its features."""
    words, features = [name], [feature("in:" + name)]
    if attributes and not attributes.isspace():
        for kind, *values in NAMES.findall(attributes):
            if kind.lower() == "data-y":
                words.append("data-y")
                continue
            for word in NAME_PART.findall("".join(values)):
                word = word.lower()
                words.append("." + word)
                features.append(feature("." + word))
                if len(word) > PREFIX:   # advert, advertising
                    features.append(feature("." + word[:PREFIX] + "-"))
    return words, features


class Element:
    __slots__ = ("name", "features", "words", "inline", "counts")
    described: dict[tuple[str, str], tuple[list[str], list[int]]] = {}

    def __init__(self, name: str, attributes: str):
        self.name = name
        key = (name, attributes)
        known = self.described.get(key)
        if known is None:
            known = _described(name, attributes)
            if len(attributes) < 100:
                if len(self.described) > 10_000:
                    self.described.clear()
                self.described[key] = known
        self.words, self.features = known
        self.inline: list[Element] = []      # open inline elements inside this block element
        self.counts: dict[str, int] = {}


@dataclass
class Block:
    text: str
    features: list[int]   # to learn from; empty if the page is only scored
    label: bool           # by the page's own marks
    score: float


class Reader:
    """One page to its leaf blocks: scored by ``weights``, or else with features and labels.

    The scores of open elements are kept as a running sum, so that deep pages cost no more.
    """

    def __init__(self, weights: list[float] | None = None):
        self.weights = weights
        self.blocks: list[Block] = []
        self.stack = [Element("", "")]
        self.active: dict[int, int] = {}     # features of open elements
        self.sum = 0.0                       # ... and their score
        self.words: dict[str, int] = {}      # names and class words of open elements
        self.links = 0                       # open links
        self.open: dict[str, int] = {}
        self.sections = [""]                 # open sectioning elements
        self.parts: list[str] = []
        self.inside: set[int] = set()        # features of inline elements around the text
        self.linked = 0
        self.marked = False

    def _enter(self, e: Element) -> None:
        for f in e.features:
            n = self.active.get(f, 0)
            self.active[f] = n + 1
            if not n and self.weights:
                self.sum += self.weights[f]
        self.links += e.name == "a"
        if not self.weights:
            for w in e.words:
                self.words[w] = self.words.get(w, 0) + 1

    def _leave(self, e: Element) -> None:
        for f in e.features:
            self.active[f] -= 1
            if not self.active[f]:
                del self.active[f]
                if self.weights:
                    self.sum -= self.weights[f]
        self.links -= e.name == "a"
        if not self.weights:
            for w in e.words:
                self.words[w] -= 1
                if not self.words[w]:
                    del self.words[w]

    def _pop(self) -> str:
        block = self.stack.pop()
        while block.inline:
            self._leave(block.inline.pop())
        self._leave(block)
        self.open[block.name] -= 1
        if block.name in SECTIONS:
            self.sections.pop()
        return block.name

    def text(self, piece: str) -> None:
        self.parts.append(piece)
        if piece and not piece.isspace():
            if self.links:
                self.linked += len(piece)
            inline = self.stack[-1].inline
            if inline:
                self.inside.update(inline[-1].features)

    def boundary(self) -> None:
        if not self.parts:
            return
        text = "".join(self.parts)
        self.parts.clear()
        if "&" in text:
            text = entities.unescape(text)
        text = " ".join(text.split())
        if text:
            own = self.stack[-1]
            more = [f for f in self.inside if f not in self.active]
            more += [feature("own:" + own.name), feature("near:" + self.sections[-1]),
                     feature("nested:" + ">".join(self.sections[-2:])), feature(f"{own.name} in {self.sections[-1]}")]
            more += [feature("own" + w) for w in own.words if w[:1] == "."]
            more += text_features(text, self.linked / len(text))
            if self.weights:
                self.blocks.append(Block(text, [], False, self.sum + sum(self.weights[f] for f in more)))
            else:
                self.blocks.append(Block(text, [*self.active, *more], self._is_main(), 0.0))
        self.inside.clear()
        self.linked = 0

    def _is_main(self) -> bool:
        if self.marked:      # a page with labels of its own
            return "data-y" in self.words and not self._aside()
        return bool(LANDMARKS & self.words.keys() or ".articlebody" in self.words) and not self._aside()

    def _aside(self) -> bool:
        return bool(ASIDE_TAGS & self.words.keys()) or any(w[:1] == "." and w[1:] in ASIDES for w in self.words)

    def start(self, name: str, attributes: str) -> None:
        if name in BLOCKS:
            self.boundary()
            if self.open.get("p"):
                while self._pop() != "p":
                    pass
            if name in VOID:
                return
            while self.stack[-1].name in ENDED_BY.get(name, ()):
                self._pop()
            e = Element(name, attributes)
            self.stack.append(e)
            self.open[name] = self.open.get(name, 0) + 1
            if name in SECTIONS:
                self.sections.append(name)
            self._enter(e)
        elif name == "br":
            self.parts.append(" ")
        elif name not in VOID:
            e = Element(name, attributes)
            top = self.stack[-1]
            top.inline.append(e)
            top.counts[name] = top.counts.get(name, 0) + 1
            self._enter(e)

    def end(self, name: str) -> None:
        if name in BLOCKS:
            self.boundary()
            if self.open.get(name) and name not in ("html", "body"):
                while self._pop() != name:
                    pass
            return
        top = self.stack[-1]
        if not top.counts.get(name):
            return
        while True:
            e = top.inline.pop()
            top.counts[e.name] -= 1
            self._leave(e)
            if e.name == name:
                return

    def read(self, page: str) -> list[Block]:
        self.marked = "data-y" in page
        at, n = 0, len(page)
        while at < n:
            start = page.find("<", at)
            if start < 0:
                self.text(page[at:])
                break
            if start > at:
                self.text(page[at:start])
            follows = page[start + 1: start + 2]
            if page.startswith("<!--", start):
                end = page.find("-->", start + 2)
                if end < 0:
                    break
                at = end + 3
            elif follows in ("!", "?") and follows:
                end = page.find(">", start)
                if end < 0:
                    break
                at = end + 1
            elif follows.isascii() and follows.isalpha() or follows == "/":
                m = TAG.match(page, start)
                if m is None:
                    end = page.find(">", start)
                    if end < 0:
                        break     # cut off inside a tag
                    at = end + 1  # an end tag without a name
                    continue
                at, name = m.end(), m[2].lower()
                if m[1]:
                    self.end(name)
                elif name in RAW:
                    close = RAW_END[name].search(page, at)
                    if close is None:
                        break
                    end = page.find(">", close.end())
                    at = n if end < 0 else end + 1
                else:
                    self.start(name, m[3])
            else:
                self.text("<")
                at = start + 1
        self.boundary()
        return self.blocks


def text_features(text: str, linked: float) -> list[int]:
    words = text.count(" ") + 1
    letters = sum(map(text.count, "0123456789"))
    found = [
        f"words:{min(words, 1 << 9).bit_length()}",
        f"chars:{min(len(text), 1 << 12).bit_length()}",
        f"linked:{0 if linked == 0 else 1 if linked < 0.3 else 2 if linked < 0.8 else 3}",
        f"stop:{text[-1] in '.!?…:;»”'}",
        f"digits:{letters * 4 > len(text)}",
    ]
    if words < 40 and CUES.search(text):
        found.append("cue")
    if " | " in text or "»" in text or "·" in text:
        found.append("bars")
    if words > 15:
        found.append("long")
    return [feature(f) for f in found] + [feature("any")]


def leaf_blocks(page: str | None, weights: list[float] | None = None) -> list[Block]:
    blocks = Reader(weights).read(page or "")
    if blocks:
        for block, name in ((blocks[0], "first"), (blocks[-1], "last")):
            if weights:
                block.score += weights[feature(name)]
            else:
                block.features.append(feature(name))
    return blocks


# ---- the random field --------------------------------------------------------

def viterbi(rows: list[float], weights: list[float]) -> list[int]:
    """The likeliest states of one page's blocks by their scores; no main text among equals."""
    start, (a, b, c, d) = weights[FEATURES: FEATURES + 2], weights[FEATURES + 2:]
    back: list[tuple[int, int]] = []
    if not rows:
        return []
    no, yes = start[0], start[1] + rows[0]
    for s in rows[1:]:
        from_no, from_yes = (0 if no + a >= yes + c else 1), (0 if no + b >= yes + d else 1)
        no, yes = max(no + a, yes + c), max(no + b, yes + d) + s
        back.append((from_no, from_yes))
    states = [0 if no >= yes else 1]
    for step in reversed(back):
        states.append(step[states[-1]])
    return states[::-1]


class Pages:
    """Training pages as arrays, longest first, so that a time step is a prefix of them."""

    def __init__(self, pages: list[tuple[list[list[int]], list[int]]]):
        pages = sorted((p for p in pages if p[0]), key=lambda p: -len(p[0]))
        self.lengths = np.array([len(p[0]) for p in pages], np.int64)
        self.n, self.longest = len(pages), int(self.lengths.max(initial=0))
        self.flat = np.fromiter((f for p in pages for b in p[0] for f in b), np.int64)
        self.owner = np.repeat(np.arange(self.lengths.sum()), [len(b) for p in pages for b in p[0]])
        self.labels = np.full((self.n, self.longest), -1, np.int64)
        self.inside = np.arange(self.longest) < self.lengths[:, None]
        self.labels[self.inside] = [y for p in pages for y in p[1]]
        self.active = [int((self.lengths > t).sum()) for t in range(self.longest)]

    def loss_and_gradient(self, weights: np.ndarray) -> tuple[float, np.ndarray]:
        """Mean negative log-likelihood of a block, with its gradient."""
        start, trans = weights[FEATURES: FEATURES + 2], weights[FEATURES + 2:].reshape(2, 2)
        own = np.zeros((self.n, self.longest, 2))
        own[self.inside, 1] = np.bincount(self.owner, weights[self.flat], int(self.lengths.sum()))
        forward, backward = np.zeros_like(own), np.zeros_like(own)
        forward[:, 0] = start + own[:, 0]
        for t in range(1, self.longest):
            k = self.active[t]
            moved = forward[:k, t - 1, :, None] + trans
            forward[:k, t] = np.logaddexp(moved[:, 0], moved[:, 1]) + own[:k, t]
        for t in reversed(range(self.longest - 1)):
            k = self.active[t + 1]
            moved = trans + (own[:k, t + 1] + backward[:k, t + 1])[:, None, :]
            backward[:k, t] = np.logaddexp(moved[:, :, 0], moved[:, :, 1])
        last = forward[np.arange(self.n), self.lengths - 1]
        total = np.logaddexp(last[:, 0], last[:, 1])
        states = np.exp(forward + backward - total[:, None, None])
        loss, gradient = float(total.sum()), np.zeros(SIZE)
        is_main = self.labels == 1
        loss -= own[..., 1][is_main].sum() + start[self.labels[:, 0]].sum()
        off = np.where(self.inside, states[..., 1] - is_main, 0)[self.inside]
        gradient[:FEATURES] = np.bincount(self.flat, off[self.owner], FEATURES)
        first = np.eye(2)[self.labels[:, 0]]
        gradient[FEATURES: FEATURES + 2] = (states[:, 0] - first).sum(axis=0)
        pairs = np.zeros((2, 2))
        for t in range(1, self.longest):
            k = self.active[t]
            joint = (forward[:k, t - 1, :, None] + trans + (own[:k, t] + backward[:k, t])[:, None, :]) - total[:k, None, None]
            pairs += np.exp(joint).sum(axis=0)
            seen = np.bincount(self.labels[:k, t - 1] * 2 + self.labels[:k, t], minlength=4).reshape(2, 2)
            pairs -= seen
            loss -= (seen * trans).sum()
        gradient[FEATURES + 2:] = pairs.reshape(4)
        blocks = max(int(self.lengths.sum()), 1)
        return loss / blocks + L2 * (weights**2).sum() / 2, gradient / blocks + L2 * weights


def fit(pages: list[tuple[list[list[int]], list[int]]]) -> np.ndarray:
    """Weights by Adam on all pages at once."""
    data, weights = Pages(pages), np.zeros(SIZE)
    if not data.n:
        return weights
    mean, square = np.zeros(SIZE), np.zeros(SIZE)
    for t in range(1, ROUNDS + 1):
        _, gradient = data.loss_and_gradient(weights)
        mean = 0.9 * mean + 0.1 * gradient
        square = 0.99 * square + 0.01 * gradient**2
        weights -= RATE * (mean / (1 - 0.9**t)) / (np.sqrt(square / (1 - 0.99**t)) + 1e-8)
    return weights


PLAIN_TEXTS = {
    "P": ["The first sentence of a paragraph goes on for a while, as they do. A second one follows it, and a third ends here.",
          "Some paragraphs are brief.", "No.", "Others, with a clause or two between commas, take up a line of their own, or a little more than that."],
    "S": ["A short sentence", "Words of a heading", "It is only one line of text."],
    "W": ["Home", "News", "About us"],
}


def training_pages(pages: list[str], seed: int = 1) -> list[tuple[list[list[int]], list[int]]]:
    """(features, labels) of self-marked pages, half without landmarks, and of hand-labelled ones."""
    out, texts = [], {"P": [], "S": [], "W": []}
    for i, page in enumerate(pages):
        blocks = leaf_blocks(page)
        labels = [int(b.label) for b in blocks]
        if not any(labels):
            continue
        for b in blocks:
            kinds = ("P" if len(b.text) > 80 else "PS") if b.label else "W" if len(b.text) < 30 else "S"
            for kind in kinds:
                texts[kind].append(entities.escape(b.text))
        if i % 2:   # the same blocks, without landmarks
            blocks = leaf_blocks(LANDMARK_TAG.sub(r"<\1div", page))
        out.append(([b.features for b in blocks], labels))
    for kind, known in texts.items():
        known.extend(PLAIN_TEXTS[kind])
    for page in labelled_pages(max(len(out), 60), texts, seed):
        blocks = leaf_blocks(page)
        out.append(([b.features for b in blocks], [int(b.label) for b in blocks]))
    return out


def main_text(page: str | None, weights: list[float]) -> str:
    blocks = leaf_blocks(page, weights)
    states = viterbi([b.score for b in blocks], weights)
    return "\n".join(b.text for b, state in zip(blocks, states) if state)


# ---- over a table ------------------------------------------------------------

def _train(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    pages = [page for batch in batches for page in batch.column("html").to_pylist()]
    weights = fit(training_pages(pages))
    yield pa.RecordBatch.from_pydict({"weights": pa.array([weights.astype("<f8").tobytes()], pa.binary())})


def train(pages: DataFrame, page_id: str = "page_id", html: str = "html", n: int = TRAIN_PAGES) -> np.ndarray:
    """The model, fitted in one task to at most ``n`` pages, the first by a hash of page_id."""
    key = quoted(page_id)
    order = F.xxhash64(key.cast("string"))
    ids = [r[0] for r in pages.select(key.alias("k")).filter(F.col("k").isNotNull())
           .distinct().orderBy(F.xxhash64(F.col("k").cast("string")), "k").limit(n).collect()]
    sample = pages.filter(key.isin(ids) & (F.length(quoted(html)) <= TRAIN_CHARS)).select(
        order.alias("order"), key.alias("k"), quoted(html).alias("html"))
    fitted = sample.orderBy("order", "k", F.xxhash64("html")).limit(n).coalesce(1).mapInArrow(_train, "weights binary")
    rows = fitted.collect()
    return np.frombuffer(rows[0][0], "<f8") if rows else fit(training_pages([]))


def _extracting(weights: list[float]):
    def pages(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts, start, size = [], 0, 0
            html = batch.column("html")
            for i in range(batch.num_rows):
                texts.append(main_text(html[i].as_py(), weights))
                size += len(texts[-1])
                if size >= BYTES_AT_ONCE or i == batch.num_rows - 1:
                    part = batch.slice(start, i + 1 - start)
                    yield pa.RecordBatch.from_arrays(
                        [part.column("page_id"), part.column("url"), pa.array(texts, pa.string()),
                         pa.array([len(t) for t in texts], pa.int64())],
                        ["page_id", "url", "text", "n_chars"],
                    )
                    texts, start, size = [], i + 1, 0

    return pages


def extract(
    pages: DataFrame, weights: np.ndarray | None = None, page_id: str = "page_id", url: str = "url", html: str = "html"
) -> DataFrame:
    """page_id, url, text and n_chars of every page; the model is fitted first if not given."""
    if weights is None:
        weights = train(pages, page_id, html)
    named = pages.select(quoted(page_id).alias("page_id"), quoted(url).alias("url"), quoted(html).cast("string").alias("html"))
    kinds = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in named.schema[:2])
    return named.mapInArrow(_extracting(weights.tolist()), f"{kinds}, text string, n_chars long")
