"""Main text of web pages by a recurrent block labeller.

A page is read as a sequence of leaf blocks, the runs of text between block-level tags. Each block has a vector of its tag path
(tags, classes and ids of all that enclose it), of its hashed words, and of a few measures (length, share of link text, place).
A bidirectional LSTM in numpy reads the whole sequence, so the label of a block depends on everything before and behind it, and
a logistic output says whether the block belongs to the article.

There are no hand-made labels, so the labeller is fitted on a bounded sample of pages (``train_pages``) in two ways. Where a page
marks its parts by HTML's own meaning (article or main against nav, aside, header, footer, form, and class names that tell), these
marks are the labels. And the blocks so labelled are set into other page layouts (content in plain divs under many class names,
around it menus, sidebars, notices, adverts, forms, comments), in which paths are varied or bare, so that the labeller learns
to go by words and neighbours as well as by paths. Prediction is one map over the pages.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterable, Iterator
from dataclasses import dataclass
from html.parser import HTMLParser

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from tessera.llm.common import hash_sample
from tessera.llm.words import Texts, U, mix

# HTML elements by what they do to text.
BLOCK_TAGS = set(
    "address article aside blockquote body button caption center dd details dialog dir div dl dt fieldset figcaption figure footer form frameset h1 h2 h3 h4 h5 h6 header hr html legend li main menu nav ol optgroup option p pre section select summary table tbody td tfoot th thead tr ul".split()
)
SILENT_TAGS = set("head title script style noscript template svg math iframe object canvas audio video datalist noframes noembed textarea".split())
VOID_TAGS = set("area base br col embed hr img input link meta param source track wbr".split())
#: An opening tag of the key ends an open element of these, if no container lies between.
ENDS = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"}, "optgroup": {"option", "optgroup"}}
CONTAINERS = set("ul ol dl table select body html article section div main aside nav header footer form".split())


class Path:
    """Names of the elements that enclose a block, outermost first: each with a link to what encloses it, so that a block in many
    elements costs no more than its own. ``bag`` is kept here once it is known."""

    __slots__ = ("parent", "name", "depth", "bag")

    def __init__(self, parent: Path | None, name: str):
        self.parent, self.name, self.depth, self.bag = parent, name, 1 + (parent.depth if parent else 0), None

    @classmethod
    def of(cls, names: Iterable[str]) -> Path | None:
        path = None
        for name in names:
            path = cls(path, name)
        return path


def upward(path: Path | None) -> Iterator[Path]:
    """The path's elements, innermost first."""
    while path is not None:
        yield path
        path = path.parent


class Block:
    __slots__ = ("at", "text", "linked")

    def __init__(self, path: Path | Iterable[str] | None, text: str, linked: int):
        self.at = path if path is None or isinstance(path, Path) else Path.of(path)
        self.text, self.linked = text, linked

    @property
    def path(self) -> tuple[str, ...]:
        return tuple(p.name for p in upward(self.at))[::-1]


class _Reader(HTMLParser):
    """Collects the leaf blocks of a page."""

    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.open: list[tuple[str, Path]] = []  # (tag, its element)
        self.count: Counter[str] = Counter()  # open elements by tag
        self.blocks: list[Block] = []
        self.held: list[str] = []
        self.links = self.silent = self.linked = 0

    def flush(self) -> None:
        text = " ".join("".join(self.held).split())
        if text:
            self.blocks.append(Block(self.open[-1][1] if self.open else None, text, min(self.linked, len(text))))
        self.held, self.linked = [], 0

    def pop_to(self, k: int) -> None:
        for tag, _ in self.open[k:]:
            self.links -= tag == "a"
            self.silent -= tag in SILENT_TAGS
            self.count[tag] -= 1
        del self.open[k:]

    def handle_starttag(self, tag, attrs):
        if tag == "body":
            if self.silent:
                names = [(t, p.name) for t, p in self.open if t not in SILENT_TAGS]
                self.open, path = [], None
                for t, name in names:
                    path = Path(path, name)
                    self.open.append((t, path))
                self.count = Counter(t for t, _ in self.open)
            self.silent = 0
        if tag in BLOCK_TAGS:
            self.flush()
            ends = ENDS.get(tag, set()) | {"p"}
            if any(self.count[x] for x in ends):
                for k in range(len(self.open) - 1, -1, -1):
                    name = self.open[k][0]
                    if name in ends:
                        self.pop_to(k)
                        break
                    if name in CONTAINERS:
                        break
        elif tag == "br":
            self.held.append(" ")
        if tag in VOID_TAGS:
            return
        told = [x for key, value in attrs if key in ("class", "id", "role") and value for x in value.lower().split()]
        self.open.append((tag, Path(self.open[-1][1] if self.open else None, " ".join([tag, *told]))))
        self.count[tag] += 1
        self.links += tag == "a"
        self.silent += tag in SILENT_TAGS

    def handle_startendtag(self, tag, attrs):
        self.handle_starttag(tag, attrs)
        if tag not in VOID_TAGS and tag not in BLOCK_TAGS:
            self.handle_endtag(tag)

    def handle_endtag(self, tag):
        if tag in BLOCK_TAGS:
            self.flush()
        if not self.count[tag]:
            return
        for k in range(len(self.open) - 1, -1, -1):
            if self.open[k][0] == tag:
                self.pop_to(k)
                break
            if tag not in BLOCK_TAGS and self.open[k][0] in BLOCK_TAGS:
                break

    def handle_data(self, data):
        if not self.silent:
            self.held.append(data)
            if self.links:
                self.linked += len(data)


def blocks(html: str | None) -> list[Block]:
    """Leaf blocks of a page in order: character references decoded, white space turned into single spaces, none empty."""
    reader = _Reader()
    reader.feed(html or "")
    reader.close()
    reader.flush()
    return reader.blocks


@dataclass(frozen=True)
class Labeller:
    path_size: int = 64
    word_size: int = 48
    hidden: int = 16
    train_pages: int = 240
    layouts: int = 800
    train_blocks: int = 200  # blocks of a page that one training sequence may have; longer pages are several sequences
    epochs: int = 24
    batch: int = 32
    rate: float = 0.02
    seed: int = 9

    @property
    def inputs(self) -> int:
        return self.path_size + self.word_size + MEASURES


MEASURES = 10


def _bag(texts: list[str], size: int, seed: int) -> np.ndarray:
    """Signed hashed counts of the words of each text."""
    found = Texts(pa.array(texts, pa.large_string()), lower=True)
    hashes = mix(found.hashes + U(seed))
    sign = np.where(hashes >> U(63), 1.0, -1.0)
    return np.bincount(found.owner * size + (hashes % U(size)).astype(np.int64), sign, len(texts) * size).reshape(-1, size)


def _path_bags(each: list[Block], size: int) -> np.ndarray:
    """The bag of the words of each block's path: that of what encloses an element and the element's own, worked out once."""
    new: list[Path] = []
    for b in each:
        chain = []
        for p in upward(b.at):
            if p.bag is not None and len(p.bag) in (0, size):  # waiting, or known
                break
            p.bag = np.empty(0)
            chain.append(p)
        new += reversed(chain)
    own = _bag([p.name for p in new], size, 21).astype(np.float32)
    for p, bag in zip(new, own, strict=True):
        p.bag = bag if p.parent is None else p.parent.bag + bag
    nothing = np.zeros(size, np.float32)
    return np.stack([b.at.bag if b.at else nothing for b in each])


def vectors(page: list[Block], labeller: Labeller) -> np.ndarray:
    """The input vector of each block of a page."""
    return stacked([page], labeller)


def stacked(pages: list[list[Block]], labeller: Labeller) -> np.ndarray:
    """The input vectors of the blocks of many pages, one after the other."""
    each = [b for page in pages for b in page]
    if not each:
        return np.empty((0, labeller.inputs), np.float32)
    paths = _path_bags(each, labeller.path_size)
    words = _bag([b.text for b in each], labeller.word_size, 22)
    words /= np.maximum(np.sqrt((words**2).sum(1, keepdims=True)), 1)
    length = np.array([len(b.text) for b in each], float)
    count = np.array([b.text.count(" ") + 1 for b in each], float)
    links = np.array([b.linked for b in each], float)
    stops = np.array([b.text.count(".") + b.text.count("!") + b.text.count("?") for b in each], float)
    commas = np.array([b.text.count(",") for b in each], float)
    place = np.concatenate([np.arange(len(p)) / max(1, len(p) - 1) for p in pages])
    heads = np.array([bool(re.match(r"h[1-6]\b", b.at.name)) if b.at else False for b in each], float)
    depth = np.array([b.at.depth if b.at else 0 for b in each], float)
    ends = np.array([b.text[-1] in ".!?…" for b in each], float)
    measures = np.stack([np.log1p(length) / 4, np.log1p(count) / 3, links / length, stops / count, commas / count, place, heads, depth / 10, ends, np.log1p(stops)], 1)
    return np.concatenate((np.clip(paths, -3, 3) / 2, words, measures), 1).astype(np.float32)


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -30, 30)))


class BiLstm:
    """Two LSTM layers side by side, one read backward, and a logistic output; trained by back-propagation through time."""

    def __init__(self, inputs: int, hidden: int, seed: int):
        random = np.random.default_rng(seed)
        self.hidden = hidden
        scale = 1 / np.sqrt(inputs + hidden)
        self.p = {}
        for side in "fb":
            self.p[f"w{side}"] = random.normal(0, scale, (inputs + hidden, 4 * hidden)).astype(np.float32)
            self.p[f"o{side}"] = np.concatenate((np.zeros(hidden), np.ones(hidden), np.zeros(2 * hidden))).astype(np.float32)
        self.p["v"] = random.normal(0, 0.1, (2 * hidden,)).astype(np.float32)
        self.p["c"] = np.zeros(1, np.float32)

    def _read(self, x: np.ndarray, side: str, keep: bool) -> tuple[np.ndarray, list]:
        """States of one direction for x (step, page, input)."""
        h = c = np.zeros((x.shape[1], self.hidden), np.float32)
        n = self.hidden
        inward = x.reshape(-1, x.shape[2]) @ self.p[f"w{side}"][: x.shape[2]] + self.p[f"o{side}"]
        inward = inward.reshape(*x.shape[:2], -1)
        out, kept = np.empty((*x.shape[:2], n), np.float32), []
        for t in range(len(x)):
            z = inward[t] + h @ self.p[f"w{side}"][x.shape[2] :]
            gates = _sigmoid(z[:, : 3 * n])
            new = np.tanh(z[:, 3 * n :])
            before, last = c, h
            c = gates[:, n : 2 * n] * c + gates[:, :n] * new
            squashed = np.tanh(c)
            h = gates[:, 2 * n :] * squashed
            out[t] = h
            if keep:
                kept.append((gates, new, before, last, squashed))
        return out, kept

    @staticmethod
    def _turn(x: np.ndarray, sizes: np.ndarray) -> np.ndarray:
        """Each page's own steps in reverse; padding stays behind."""
        steps = np.arange(len(x))[:, None]
        at = np.where(steps < sizes, sizes - 1 - steps, steps)
        return np.take_along_axis(x, at[:, :, None], 0)

    def forward(self, x: np.ndarray, sizes: np.ndarray, keep: bool = False):
        ahead, kept_f = self._read(x, "f", keep)
        turned = self._turn(x, sizes)
        back, kept_b = self._read(turned, "b", keep)
        states = np.concatenate((ahead, self._turn(back, sizes)), 2)
        return _sigmoid(states @ self.p["v"] + self.p["c"][0]), (states, kept_f, kept_b, turned)

    def _back(self, x: np.ndarray, side: str, kept: list, slope: np.ndarray, grads: dict) -> None:
        n, w = self.hidden, self.p[f"w{side}"]
        dh = dc = np.zeros((x.shape[1], n), np.float32)
        gw, go = np.zeros_like(w), np.zeros_like(self.p[f"o{side}"])
        for t in range(len(x) - 1, -1, -1):
            gates, new, before, last, squashed = kept[t]
            dh = dh + slope[t]
            dc = dc + dh * gates[:, 2 * n :] * (1 - squashed**2)
            dz = np.concatenate((dc * new, dc * before, dh * squashed), 1) * gates * (1 - gates)
            dz = np.concatenate((dz, dc * gates[:, :n] * (1 - new**2)), 1)
            gw[: x.shape[2]] += x[t].T @ dz
            gw[x.shape[2] :] += last.T @ dz
            go += dz.sum(0)
            dh = dz @ w[x.shape[2] :].T
            dc = dc * gates[:, n : 2 * n]
        grads[f"w{side}"], grads[f"o{side}"] = gw, go

    def gradients(self, x: np.ndarray, sizes: np.ndarray, truth: np.ndarray, weight: np.ndarray) -> dict:
        chance, (states, kept_f, kept_b, turned) = self.forward(x, sizes, True)
        lack = (chance - truth) * weight / max(weight.sum(), 1)
        grads = {"v": np.einsum("tb,tbh->h", lack, states), "c": np.array([lack.sum()], np.float32)}
        slope = lack[:, :, None] * self.p["v"]
        self._back(x, "f", kept_f, slope[:, :, : self.hidden], grads)
        self._back(turned, "b", kept_b, self._turn(slope[:, :, self.hidden :], sizes), grads)
        return grads


# Parts of names of elements that hold no article text, and names of elements that do.
OTHER_NAMES = re.compile(r"(?:^|[\s_-])(?:ad|ads|advert\w*|sponsor\w*|promo\w*|banner|cookie\w*|consent|gdpr|notice|popup|modal|newsletter|subscribe|signup|login|search|comment\w*|disqus|replies|sidebar|menu|navbar|nav|navigation|breadcrumb\w*|share|social|related|widget|pagination|masthead|footer|copyright|toolbar)(?:$|[\s_-])")
OTHER_TAGS = set("nav aside footer form header button select menu dialog".split())
ARTICLE_TAGS = set("article main".split())
CONTENT_LAYOUTS = ["article", "main", "div content", "div post", "div entry-content", "div article-body", "div story", "section main-text", "div text", "div", "section", "div main", "main article", "div container div col article", "div wrapper div page div body-text"]
HEAD_LAYOUTS = ["header", "div header", "div masthead", "header site-header", "div top-bar"]
MENU_LAYOUTS = ["nav", "ul menu", "div navbar", "div nav ul", "nav main-nav ul", "div menu", "div breadcrumbs"]
SIDE_LAYOUTS = ["aside", "div sidebar", "aside widget", "div related", "section related-links", "div right-column widget"]
NOTICE_LAYOUTS = ["div cookie-notice", "div cookie-banner", "div consent", "div notice", "div alert", "div gdpr", "section notice", "div popup"]
ADVERT_LAYOUTS = ["div ad", "div ads", "div advert", "div advertisement", "div sponsored", "aside promo", "div promo", "div banner", "ins adsbygoogle"]
FORM_LAYOUTS = ["form", "form newsletter", "div subscribe form", "form search", "div login form", "fieldset form"]
COMMENT_LAYOUTS = ["section comments", "div comments", "div comment", "ol comment-list li comment", "div replies", "ul comments li", "section reader-comments"]
FOOT_LAYOUTS = ["footer", "div footer", "footer site-footer", "div copyright", "div bottom"]


def marked(block: Block) -> float:
    """1 for article text, 0 for what is not, by the marks of the page itself; nan without marks."""
    article = None
    for element in upward(block.at):
        tag, _, told = element.name.partition(" ")
        if tag in ARTICLE_TAGS:
            article = 1.0
            break
        if (tag in OTHER_TAGS) or (told and OTHER_NAMES.search(told)):
            return 0.0
    return float("nan") if article is None else article


def _layout(random: np.random.Generator, own: list[Block], other: list[str], sentences: list[str]) -> tuple[list[Block], list[float]]:
    """A page of another layout with the article blocks ``own`` and other parts around it."""
    page: list[tuple[Block, float]] = []
    outer = ["html", "body", *[["div wrapper"], ["div page"], ["div"], [], []][random.integers(5)]]
    chance = lambda p: random.random() < p

    def part(layouts: list[str], tag: str, texts: list[str], link: bool) -> None:
        words = layouts[random.integers(len(layouts))].split(" ")
        path = [*outer, words[0] + (" " + " ".join(words[1:2]) if len(words) > 1 else ""), *words[2:]]
        if chance(0.4):
            title = " ".join(sentences[random.integers(len(sentences))].split()[: random.integers(1, 4)])
            page.append((Block((*path, f"h{random.integers(2, 5)}"), title, 0), 0.0))
        page.extend((Block((*path, *tag.split()), text, len(text) if link else 0), 0.0) for text in texts)

    some = lambda low, high, pool: [pool[random.integers(len(pool))] for _ in range(random.integers(low, high + 1))]
    short = lambda low, high: [" ".join(x.split()[: random.integers(1, 4)]) for x in some(low, high, sentences)]
    if chance(0.3):
        part(NOTICE_LAYOUTS, ["p", "span", ""][random.integers(3)], some(1, 2, sentences), False)
    if chance(0.5):
        part(HEAD_LAYOUTS, ["h1", "p", "a"][random.integers(3)], short(1, 2), chance(0.5))
    if chance(0.8):
        part(MENU_LAYOUTS, "li a", short(3, 9), True)
    if chance(0.4):
        part(ADVERT_LAYOUTS, ["", "p", "a"][random.integers(3)], some(1, 1, other or sentences), chance(0.4))
    if chance(0.2):
        part(SIDE_LAYOUTS, ["li a", "p"][random.integers(2)], some(1, 5, sentences), chance(0.6))
    words = (CONTENT_LAYOUTS[random.integers(2)] if chance(0.3) else CONTENT_LAYOUTS[random.integers(len(CONTENT_LAYOUTS))]).split(" ")
    base = [*outer, words[0] + (" " + " ".join(words[1:2]) if len(words) > 1 else ""), *words[2:]]
    # A run of the blocks may stand in a list, a quotation, a table or the like.
    kinds = [["ul", "li"], ["ul", "li"], ["ol", "li"], ["pre"], ["blockquote", "p"], ["div"], ["table", "tr", "td"], ["h2"], ["section", "p"]]
    begin, other_kind = random.integers(len(own)), kinds[random.integers(len(kinds))]
    run = range(begin, begin + random.integers(1, 5)) if chance(0.8) else range(0)
    for i, b in enumerate(own):
        inner = [x for x in b.path if re.match(r"(?:p|h[1-6]|li|ul|ol|blockquote|b|i|em|strong|span|td|tr|table|pre)\b", x)]
        inner = [x.partition(" ")[0] for x in inner]
        if inner[:1] == ["p"] and i in run:
            inner = other_kind
        page.append((Block((*base, *inner), b.text, b.linked), 1.0))
        if chance(0.04):
            part(ADVERT_LAYOUTS, "", some(1, 1, other or sentences), False)
    if chance(0.2):
        # Comments of readers inside the element that holds the article.
        page_outer, outer = outer, base
        part(COMMENT_LAYOUTS, ["p", "div", "li"][random.integers(3)], some(1, 8, sentences), False)
        outer = page_outer
    if chance(0.3):
        part(SIDE_LAYOUTS, ["li a", "p", "li"][random.integers(3)], some(1, 6, sentences), chance(0.6))
    if chance(0.25):
        part(FORM_LAYOUTS, ["label", "p", "button", "option"][random.integers(4)], short(1, 5), False)
    if chance(0.35):
        part(COMMENT_LAYOUTS, ["p", "div", ""][random.integers(3)], some(1, 8, sentences), False)
    if chance(0.2):
        part(NOTICE_LAYOUTS, "p", some(1, 2, sentences), False)
    if chance(0.75):
        part(FOOT_LAYOUTS, ["p", "", "a"][random.integers(3)], [f"© {x}" if chance(0.5) else x for x in some(1, 2, other or sentences)], chance(0.3))
    return [b for b, _ in page], [y for _, y in page]


def fit(pages: list[str], labeller: Labeller) -> BiLstm:
    """The labeller fitted to a sample of pages; pages without any marks only lend nothing to learn from."""
    net = BiLstm(labeller.inputs, labeller.hidden, labeller.seed)
    random = np.random.default_rng(labeller.seed)
    read = [blocks(html) for html in pages]
    labels = [[marked(b) for b in page] for page in read]
    samples = [(page, y) for page, y in zip(read, labels) if any(x == x for x in y)]
    articles = [[b for b, x in zip(page, y) if x == 1] for page, y in samples]
    articles = [a for a in articles if a]
    other = [b.text for page, y in samples for b, x in zip(page, y) if x == 0]
    sentences = [s for a in articles for b in a for s in re.split(r"(?<=[.!?]) ", b.text) if 2 <= len(s.split()) <= 40]
    if articles and sentences:
        # Short articles and parts of long ones, with or without their beginning, so that neither length nor a title tells.
        for _ in range(labeller.layouts):
            a = articles[random.integers(len(articles))]
            begin = random.integers(len(a)) if random.random() < 0.4 else 0
            samples.append(_layout(random, a[begin : random.integers(begin + 1, len(a) + 1)], other, sentences))
    if not samples:
        return net
    cut = labeller.train_blocks
    samples = [(page[k : k + cut], y[k : k + cut]) for page, y in samples for k in range(0, len(page), cut)]
    inputs = [vectors(page, labeller) for page, _ in samples]
    truths = [np.array(y, np.float32) for _, y in samples]
    moment = {k: (np.zeros_like(v), np.zeros_like(v)) for k, v in net.p.items()}
    step = 0
    for epoch in range(labeller.epochs):
        order = sorted(range(len(samples)), key=lambda i: len(inputs[i]) + 8 * random.random())
        batches = [order[k : k + labeller.batch] for k in range(0, len(order), labeller.batch)]
        for k in random.permutation(len(batches)):
            x, sizes = padded([inputs[i] for i in batches[k]])
            truth = np.full(x.shape[:2], np.nan, np.float32)
            for j, i in enumerate(batches[k]):
                truth[: len(truths[i]), j] = truths[i]
            weight = (~np.isnan(truth)).astype(np.float32)
            # Paths are hidden in some pages, so that words and neighbours must do.
            hidden = random.random(x.shape[1]) < 0.15
            x[:, hidden, : labeller.path_size] = 0
            weight[:, hidden] *= 0.3
            # Words are hidden in others, so that pages in languages that the sample lacks are read by the rest.
            foreign = ~hidden & (random.random(x.shape[1]) < 0.4)
            x[:, foreign, labeller.path_size : labeller.path_size + labeller.word_size] = 0
            grads = net.gradients(x, sizes, np.nan_to_num(truth), weight)
            norm = np.sqrt(sum(float((g**2).sum()) for g in grads.values()))
            step += 1
            rate = labeller.rate * min(1, (labeller.epochs - epoch) / labeller.epochs * 1.5)
            for name, g in grads.items():
                g = g * min(1, 5 / max(norm, 1e-9))
                m, v = moment[name]
                m += 0.1 * (g - m)
                v += 0.001 * (g * g - v)
                net.p[name] = (net.p[name] - rate * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.999**step)) + 1e-8)).astype(np.float32)
    return net


def padded(each: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """(step, page, input) and the number of steps of each page."""
    sizes = np.array([len(x) for x in each])
    out = np.zeros((max(1, sizes.max(initial=0)), len(each), each[0].shape[1]), np.float32)
    for j, x in enumerate(each):
        out[: len(x), j] = x
    return out, sizes


#: Block vectors held at once, padding included (one page may have more).
CELLS = 40_000


def label(pages: list[list[Block]], net: BiLstm, labeller: Labeller) -> list[np.ndarray]:
    """Whether each block of each page is article text."""
    out: list[np.ndarray] = [np.empty(0, bool)] * len(pages)
    order = sorted((i for i, p in enumerate(pages) if p), key=lambda i: len(pages[i]))
    while order:
        # The longest page decides the padding.
        take = max(1, CELLS // len(pages[order[-1]]))
        group, order = order[-take:], order[:-take]
        flat = stacked([pages[i] for i in group], labeller)
        edges = np.cumsum([0, *(len(pages[i]) for i in group)])
        x, sizes = padded([flat[a:b] for a, b in zip(edges, edges[1:])])
        chance, _ = net.forward(x, sizes)
        for j, i in enumerate(group):
            out[i] = chance[: sizes[j], j] >= 0.5
    return out


def _extract(batches: Iterator[pa.RecordBatch], net: BiLstm, labeller: Labeller) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for k in range(0, batch.num_rows, 500):
            part = batch.slice(k, 500)
            pages = [blocks(html.as_py()) for html in part.column("html")]
            texts = ["\n".join(b.text for b, own in zip(page, keep) if own) for page, keep in zip(pages, label(pages, net, labeller))]
            yield pa.RecordBatch.from_arrays(
                [part.column("page_id"), part.column("url"), pa.array(texts, pa.string()), pa.array(map(len, texts), pa.int64()), pa.array(map(len, pages), pa.int64())],
                names=["page_id", "url", "text", "n_chars", "n_blocks"],
            )


def main_text(pages: DataFrame, labeller: Labeller = Labeller(), net: BiLstm | None = None) -> DataFrame:
    """(page_id, url, text, n_chars, n_blocks) for every row of ``pages`` (page_id, url, html; other columns are ignored).

    The text is the blocks labelled as article, in page order, joined by line feeds; nothing of them is cut. A null or empty
    page, and one without article blocks, has an empty text. Repeated rows are read each for itself; an empty table gives no
    rows. The labeller is fitted on the ``train_pages`` pages of smallest hash unless ``net`` is given.
    """
    if net is None:
        usable = pages.filter("html is not null").select("page_id", "html")
        sample = hash_sample(usable, usable.count(), ("page_id", "html"), labeller.train_pages)
        net = fit([r["html"] for r in sample.collect()], labeller)
    held = pages.sparkSession.sparkContext.broadcast(net)
    return pages.select("page_id", "url", "html").mapInArrow(lambda b: _extract(b, held.value, labeller), "page_id long, url string, text string, n_chars long, n_blocks long")
