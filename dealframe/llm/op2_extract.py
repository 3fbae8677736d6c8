"""HTML extraction by minimum-cut labelling of text blocks.

A page is cut into text blocks at block-level tags. A log-linear classifier gives each
block the log-odds of being content from its length, links, sentence end, neighbours,
tag and place, with class names as a weak hint. Its costs are fitted on a bounded sample
of the table's own pages, whose blocks label themselves: those in an article are content,
those in menus, footers, forms and the like, and those beside an article, are not.
Log-odds and the tags' own word become the capacities to the two terminals. Smoothness
edges join neighbouring blocks and, through one node for each enclosing element, blocks
that are close in the document tree. The maximum flow gives the labelling of least total
cost; blocks on the source side are the main text, in page order.

Defined cases: null and empty pages give empty text; scripts, styles, comments and
the head are never text; character references are decoded, white space inside a
block is one space, blocks are joined by one space; unclosed tags end with their
parent, a tag that never ends is dropped; a tie of costs counts as boilerplate;
repeated rows are extracted each; other columns are ignored; an empty table gives
no rows; a table whose pages don't label themselves is read with fixed costs.
"""

from __future__ import annotations

import html
import re
import zlib
from collections import Counter, deque
from dataclasses import dataclass
from math import exp, log1p

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from dealframe.llm._common import append_columns, table

TOKEN = re.compile(
    r"<!--.*?(?:-->|\Z)|<[!?][^>]*(?:>|\Z)"
    r"|<(?P<end>/?)(?P<name>[a-zA-Z][^\s/>]*)(?P<attrs>[^>\"']*(?:\"[^\"]*\"[^>\"']*|'[^']*'[^>\"']*)*)>"
    r"|<(?P<end2>/?)(?P<name2>[a-zA-Z][^\s/>]*)(?P<attrs2>[^>]*)(?:>|\Z)",
    re.S,
)
ATTR = re.compile(r"""([a-zA-Z-]+)(?:\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+)))?""")
WORD = re.compile(r"[A-Z]?[a-z]+|[A-Z]+|\d+")

# Fixed values of HTML: elements by kind.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea title xmp iframe noembed noframes".split())
BLOCK = frozenset(
    "address article aside blockquote body br button caption center dd details dialog dir div dl dt fieldset figcaption figure footer form "
    "frameset h1 h2 h3 h4 h5 h6 head header hr html legend li main menu nav noscript ol optgroup option p pre section select summary "
    "table tbody td template tfoot th thead tr ul".split()
)
CLOSES_P = BLOCK - {"br", "button", "option", "body", "html", "head"}
SAME = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"}}
SCOPE = frozenset("html body table ul ol dl div section article main aside nav header footer form td".split())
NEVER = frozenset("head noscript template svg math select button option audio video object canvas".split())
BOILER = frozenset("nav aside footer menu dialog fieldset".split())
CONTROLS = frozenset("input select textarea button".split())
#: Class words of notices and adverts outside an article, and of readers' comments.
NOTICES = frozenset("cookie cookies consent gdpr newsletter popup advert advertisement sponsored".split())
COMMENTS = frozenset("comment comments reply replies respond responses discussion".split())
#: A form with fewer words than FORM_WORDS, and as many more for each control, is a form and not a page in one.
FORM_WORDS = 40
#: Class words that hint at what isn't content, or is: a weak feature, where the fit starts.
HINTS_BAD = frozenset("ad ads advert advertisement banner sponsored promo sidebar nav menu breadcrumb footer cookie cookies consent notice popup newsletter subscribe share sharing social related widget comment comments reply".split())
HINTS_GOOD = frozenset("article content post entry story body text".split())
#: Elements that an article or page part never stands in, where they weren't closed.
UNCLOSED = ("nav", "head", "form", "ul", "select")
ROLES = frozenset("navigation banner contentinfo complementary search form alert alertdialog dialog menu menubar toolbar".split())


class Element:
    """An open element: what it and its ancestors say by their own meaning (tags, roles, hidden), and their class words."""

    __slots__ = ("name", "parent", "depth", "never", "boiler", "article", "outer", "nest", "form", "above", "controls", "size", "link", "words", "below")

    def __init__(self, name: str, parent: Element | None, attrs: str) -> None:
        self.name, self.parent = name, parent
        self.depth = parent.depth + 1 if parent else 0
        self.never = bool(parent and parent.never) or name in NEVER
        self.boiler = bool(parent and parent.boiler) or name in BOILER
        self.article = bool(parent and parent.article) or name in ("article", "main")
        # The outermost article element, the article within it (a comment or teaser, or a part), and the form around.
        self.outer: Element | None = parent.outer if parent else None
        self.nest: Element | None = parent.nest if parent else None
        if name == "article":
            if self.outer is None:
                self.outer = self
            elif self.nest is None:
                self.nest = self
        self.form: Element | None = parent.form if parent else None
        self.above = self.form
        if name == "form":
            self.form = self
        #: Controls of a form; words of a form, or of an article but for those of articles within it.
        self.controls = self.size = 0
        self.link = bool(parent and parent.link) or name == "a"
        self.words: frozenset[str] = parent.words if parent else frozenset()
        # Words of elements within the article.
        self.below: frozenset[str] = parent.below if parent else frozenset()
        if name == "header" and not (parent and parent.article):
            self.boiler = True
        if attrs and name not in ("html", "body"):
            self._read(attrs)

    def is_form(self) -> bool:
        """Whether some form around is one, and not the frame of a page."""
        f = self.form
        while f is not None:
            if f.size < FORM_WORDS * (1 + f.controls):
                return True
            f = f.above
        return False

    def is_aside(self) -> bool:
        """Whether the article within an article is a comment or a teaser: by its names, or outweighed by the text around."""
        return self.nest is not None and (bool(self.nest.words & COMMENTS) or self.outer.size >= self.nest.size)

    def _read(self, attrs: str) -> None:
        if "=" not in attrs:
            self.boiler = self.boiler or bool(re.search(r"(^|\s)hidden(\s|/|$)", attrs))
            return
        for m in ATTR.finditer(attrs):
            key = m[1].lower()
            value = m[2] or m[3] or m[4] or ""
            if key in ("class", "id"):
                own = {w.lower() for w in WORD.findall(value)}
                self.words = self.words | own
                if self.parent is not None and self.parent.article:
                    self.below = self.below | own
            elif key == "role":
                self.boiler = self.boiler or value.lower() in ROLES
                self.article = self.article or value.lower() in ("main", "article")
            elif key == "itemprop" and value.lower() == "articlebody":
                self.article = True
            elif key == "hidden" or (key == "style" and re.search(r"display\s*:\s*none", value)):
                self.boiler = True


class Block:
    __slots__ = ("text", "linked", "at")

    def __init__(self, text: str, linked: int, at: Element) -> None:
        self.text, self.linked, self.at = text, linked, at


def parse(page: str) -> list[Block]:
    """Text blocks with the element they stand in and their characters inside links."""
    top = here = Element("#root", None, "")
    out: list[Block] = []
    held: list[str] = []
    linked, owner = 0, top
    pos, n = 0, len(page)
    # How many elements of a name are open: what isn't open is not looked for.
    open_names: Counter[str] = Counter()

    def close(e: Element) -> None:
        nonlocal here
        while here is not e:
            open_names[here.name] -= 1
            here = here.parent

    def flush() -> None:
        nonlocal linked
        if held:
            text = " ".join(html.unescape("".join(held)).split())
            if text:
                out.append(Block(text, min(linked, len(text)), owner))
                size = text.count(" ") + 1
                if (a := owner.nest or owner.outer) is not None:
                    a.size += size
                f = owner.form
                while f is not None:
                    f.size += size
                    f = f.above
            held.clear()
        linked = 0

    while pos < n:
        m = TOKEN.search(page, pos)
        end = m.start() if m else n
        if end > pos and not here.never:
            if not held:
                owner = here
            held.append(page[pos:end])
            if here.link:
                linked += end - pos
        if not m:
            break
        pos = m.end()
        name = m["name"] or m["name2"]
        if not name:
            continue
        name = name.lower()
        closing = m["end"] if m["name"] else m["end2"]
        if closing:
            if name in BLOCK:
                flush()
            e = here if open_names[name] > 0 else top
            while e.parent and e.name != name:
                if e.name in SCOPE and name not in SCOPE:
                    e = top
                    break
                e = e.parent
            if e.parent:
                close(e.parent)
            continue
        if name in BLOCK:
            flush()
        if name in CONTROLS and here.form is not None:
            here.form.controls += 1
        if name in RAW:
            stop = re.compile(f"</{re.escape(name)}\\s*>", re.I).search(page, pos)
            pos = stop.end() if stop else n
            continue
        if name in VOID:
            continue
        attrs = (m["attrs"] if m["name"] else m["attrs2"]) or ""
        if name in CLOSES_P or name in SAME:
            wanted = SAME.get(name, set())
            e = here if open_names["p"] > 0 or any(open_names[w] > 0 for w in wanted) else top
            while e.parent and e.name not in SCOPE and e.name not in wanted and e.name != "p":
                e = e.parent
            if e.parent and (e.name in wanted or e.name == "p"):
                close(e.parent)
        if name in ("article", "main", "body", "footer"):
            # These never stand inside a menu or a form that wasn't closed.
            e, last = here, None
            while e.parent and any(open_names[x] > 0 for x in UNCLOSED):
                if e.name in UNCLOSED:
                    last = e
                e = e.parent
            if last is not None:
                close(last.parent)
        if attrs.rstrip().endswith("/") and name not in BLOCK:
            continue
        here = Element(name, here, attrs)
        open_names[name] += 1
    flush()
    return out


#: Numbers of a block's own feature vector; a bias and the hashed class words follow.
SHAPE = 16
WORD_SLOTS = 512


def vectors(blocks: list[Block]) -> tuple[np.ndarray, list[list[int]]]:
    """Features of a page's blocks (shape, neighbours, tag, place) and the slots of their class words.

    Whether a block stands in an article or in a menu by its tags isn't among them: that
    is what the costs are fitted to, and enters the terminal capacities by itself.
    """
    n = len(blocks)
    x = np.zeros((n, SHAPE + 1))
    size = np.array([b.text.count(" ") + 1 for b in blocks], float)
    chars = np.array([len(b.text) for b in blocks], float)
    linked = np.array([b.linked for b in blocks], float) / chars
    x[:, 0] = 1
    x[:, 1] = np.log1p(size) / 3
    x[:, 2] = linked
    x[:, 3] = [b.text[-1] in ".!?\"”»" for b in blocks]
    x[:, 4] = size <= 3
    x[:, 5] = [sum(c.isdigit() for c in b.text) / len(b.text) for b in blocks]
    x[:, 6] = [sum(c in "|©·•»>" for c in b.text) / (b.text.count(" ") + 1) for b in blocks]
    x[:, 7] = [b.at.name in ("h1", "h2", "h3", "h4") for b in blocks]
    x[:, 8] = [b.at.name in ("p", "blockquote", "pre") for b in blocks]
    x[:, 9] = [b.at.name in ("li", "td", "th", "dt", "dd", "label") for b in blocks]
    x[1:, 10] = x[:-1, 1]
    x[:-1, 11] = x[1:, 1]
    x[1:, 12] = linked[:-1]
    x[:-1, 13] = linked[1:]
    total = np.cumsum(chars)
    x[:, 14] = np.minimum(1.0, chars / max(1.0, total[-1] if n else 1.0))
    x[:, 15] = [min(b.at.depth, 20) / 20 for b in blocks]
    x[:, 16] = size >= 12
    return x, [sorted({zlib.crc32(w.encode()) % WORD_SLOTS for w in b.at.words}) for b in blocks]


def own_label(b: Block) -> int | None:
    """What the tags around a block say: 1 article, 0 boilerplate, None nothing (also within an article, below a name that hints at other things)."""
    if b.at.boiler or b.at.is_aside() or b.at.is_form() or (b.at.below if b.at.article else b.at.words) & NOTICES:
        return 0
    return 1 if b.at.article and not b.at.below & HINTS_BAD else None


@dataclass
class Costs:
    """Weights of a log-linear classifier of blocks."""

    shape: np.ndarray
    words: np.ndarray

    def log_odds(self, x: np.ndarray, words: list[list[int]]) -> np.ndarray:
        z = x @ self.shape
        for i, w in enumerate(words):
            if w:
                # Words vote together: many names on the way down don't add up to more than one.
                z[i] += self.words[w].mean()
        return z


def _hints() -> np.ndarray:
    out = np.zeros(WORD_SLOTS)
    for words, v in ((HINTS_BAD, -5.0), (HINTS_GOOD, 1.0)):
        for w in words:
            out[zlib.crc32(w.encode()) % WORD_SLOTS] = v
    return out


#: Used where no page labels itself, and where the fit starts: long, sentence-like, unlinked blocks are content.
PRIOR = Costs(np.array([-1.0, 2.0, -4.0, 1.0, -1.0, -1.0, -1.0, 0.7, 0.7, -0.7, 0.3, 0.3, -0.5, -0.5, 0.5, 0.0, 1.0]), _hints())


def fit(pages: list[str], rounds: int = 300) -> Costs:
    """Costs from blocks that label themselves by their tags; on pages with an article, blocks outside it are boilerplate too.

    A penalty draws the weights to PRIOR. Each kind weighs the same. Blocks of an article
    below a name that hints at other things teach nothing.
    """
    xs, ws, ys = [], [], []
    for page in pages:
        found = parse(page)
        if not found:
            continue
        labels = [own_label(b) for b in found]
        if 1 in labels:
            labels = [0 if v is None and not b.at.article else v for v, b in zip(labels, found, strict=True)]
        x, w = vectors(found)
        use = [i for i, v in enumerate(labels) if v is not None]
        xs.append(x[use])
        ws += [w[i] for i in use]
        ys += [labels[i] for i in use]
    y = np.asarray(ys, float)
    if not len(y) or y.min() == y.max():
        return PRIOR
    x = np.vstack(xs)
    rows = np.repeat(np.arange(len(ws)), [len(w) for w in ws])
    slots = np.concatenate([np.asarray(w, np.int64) for w in ws]) if len(rows) else np.zeros(0, np.int64)
    share = 1 / np.maximum(np.array([len(w) for w in ws]), 1)[rows]
    weight = np.where(y == 1, 0.5 / max(1, (y == 1).sum()), 0.5 / max(1, (y == 0).sum()))
    a, b = PRIOR.shape.copy(), PRIOR.words.copy()
    ma, mb, va, vb = np.zeros_like(a), np.zeros_like(b), np.zeros_like(a), np.zeros_like(b)
    for t in range(1, rounds + 1):
        z = x @ a + np.bincount(rows, weights=b[slots] * share, minlength=len(y))
        g = (1 / (1 + np.exp(-np.clip(z, -30, 30))) - y) * weight
        for p, grad, m, v in ((a, x.T @ g + 0.002 * (a - PRIOR.shape), ma, va), (b, np.bincount(slots, weights=g[rows] * share, minlength=WORD_SLOTS) + 0.01 * (b - PRIOR.words), mb, vb)):
            m += 0.1 * (grad - m)
            v += 0.01 * (grad * grad - v)
            p -= 0.05 * (m / (1 - 0.9**t)) / (np.sqrt(v / (1 - 0.99**t)) + 1e-9)
    return Costs(a, b)


#: Log-odds that a block's own tags are worth, beside the fitted ones, and most that the fitted ones count.
TAGS, MOST = 3.0, 4.0


def evidence(blocks: list[Block], costs: Costs) -> np.ndarray:
    """Log-odds that each block is content."""
    x, words = vectors(blocks)
    z = np.clip(costs.log_odds(x, words), -MOST, MOST)
    for i, b in enumerate(blocks):
        v = own_label(b)
        if v == 0:
            # Tags say menu, footer, form or comment outright; an article's word is weaker, as it holds such things.
            z[i] -= TAGS + MOST
        elif v == 1:
            z[i] += TAGS
    return z


class Flow:
    """Maximum flow by level graphs and blocking flows (Dinic); nodes 0 and 1 are the terminals."""

    def __init__(self, nodes: int) -> None:
        self.to: list[int] = []
        self.cap: list[float] = []
        self.out: list[list[int]] = [[] for _ in range(nodes)]

    def edge(self, a: int, b: int, there: float, back: float = 0.0) -> None:
        self.out[a].append(len(self.to))
        self.to.append(b)
        self.cap.append(there)
        self.out[b].append(len(self.to))
        self.to.append(a)
        self.cap.append(back)

    def levels(self) -> list[int]:
        level = [-1] * len(self.out)
        level[0] = 0
        todo = deque([0])
        while todo:
            a = todo.popleft()
            for k in self.out[a]:
                b = self.to[k]
                if level[b] < 0 and self.cap[k] > 1e-9:
                    level[b] = level[a] + 1
                    todo.append(b)
        return level

    def source_side(self) -> list[bool]:
        while True:
            level = self.levels()
            if level[1] < 0:
                return [x >= 0 for x in level]
            nxt = [0] * len(self.out)
            path: list[int] = []
            a = 0
            while True:
                if a == 1:
                    flow = min(self.cap[k] for k in path)
                    for k in path:
                        self.cap[k] -= flow
                        self.cap[k ^ 1] += flow
                    cut = next(i for i, k in enumerate(path) if self.cap[k] <= 1e-9)
                    a = self.to[path[cut] ^ 1]
                    del path[cut:]
                    continue
                edges = self.out[a]
                while nxt[a] < len(edges):
                    k = edges[nxt[a]]
                    if self.cap[k] > 1e-9 and level[self.to[k]] == level[a] + 1:
                        break
                    nxt[a] += 1
                if nxt[a] < len(edges):
                    path.append(edges[nxt[a]])
                    a = self.to[edges[nxt[a]]]
                elif path:
                    k = path.pop()
                    a = self.to[k ^ 1]
                    nxt[a] += 1
                else:
                    break


def softplus(z: float) -> float:
    return z + log1p(exp(-z)) if z > 0 else log1p(exp(z))


#: Smoothness: between neighbouring blocks, and from a block to its element and up; both scale with the blocks' doubt.
ADJACENT, PROXIMITY = 1.5, 1.0


def label(blocks: list[Block], z: np.ndarray) -> list[bool]:
    """The minimum cut of a page's blocks for given log-odds: True is content."""
    node: dict[Element, int] = {}
    for b in blocks:
        e = b.at
        while e is not None and e not in node:
            node[e] = len(blocks) + 2 + len(node)
            e = e.parent
    g = Flow(2 + len(blocks) + len(node))
    for i, b in enumerate(blocks):
        v = float(z[i])
        g.edge(0, i + 2, softplus(v))
        g.edge(i + 2, 1, softplus(-v))
        g.edge(i + 2, node[b.at], PROXIMITY, PROXIMITY)
        if i:
            near = ADJACENT if b.at.parent is blocks[i - 1].at.parent and own_label(b) == own_label(blocks[i - 1]) else ADJACENT / 4
            g.edge(i + 1, i + 2, near, near)
    for e in node:
        if e.parent is not None:
            # Content keeps together within an element, and less so across it.
            g.edge(node[e], node[e.parent], PROXIMITY / 2, PROXIMITY / 2)
    side = g.source_side()
    return [side[i + 2] for i in range(len(blocks))]


def main_text(page: str | None, costs: Costs = PRIOR) -> str:
    """The content blocks of a page, joined by one space.

    A page on which nothing is content has its blocks that no tag condemns, where there
    are any: there is no article to tell them from.
    """
    blocks = parse(page or "")
    if not blocks:
        return ""
    keep = label(blocks, evidence(blocks, costs))
    if not any(keep):
        keep = [own_label(b) != 0 for b in blocks]
    return " ".join(b.text for b, k in zip(blocks, keep, strict=True) if k)


#: Pages, and bytes of them, that the costs are fitted on at most (the first by hash of id).
MAX_PAGES, MAX_BYTES = 400, 20_000_000


def train(pages: DataFrame, max_pages: int = MAX_PAGES, max_bytes: int = MAX_BYTES) -> Costs:
    """Costs from a bounded sample of the table's own pages: ids and lengths are ranked, then the pages fetched."""
    size = F.octet_length("html").cast("long").alias("_len")
    ranked = pages.where("html is not null and page_id is not null").select("page_id", size, F.xxhash64("html").alias("_h"))
    ranked = ranked.orderBy(F.xxhash64("page_id"), "page_id", "_h").limit(max_pages).collect()
    picked, room = {}, max_bytes
    for r in ranked:
        if r["_len"] <= room:
            picked[r["page_id"], r["_h"]] = r["_len"]
            room -= r["_len"]
    if not picked:
        return PRIOR
    want = pages.sparkSession.createDataFrame(list(picked), f"page_id {dict(pages.dtypes)['page_id']}, _h long")
    rows = pages.select("page_id", F.xxhash64("html").alias("_h"), "html").join(F.broadcast(want), ["page_id", "_h"]).groupBy("page_id", "_h").agg(F.min("html").alias("html")).collect()
    return fit([r["html"] for r in sorted(rows, key=lambda r: (r["page_id"], r["_h"]))])


def with_main_text(pages: DataFrame, costs: Costs, keep: list[str] | None = None, out: str = "text", chars: str = "n_chars") -> DataFrame:
    """``keep`` (default: all columns), the main text and its code points."""

    def make():
        def batch(b: pa.RecordBatch) -> list[pa.Array]:
            got = [main_text(x.as_py(), costs) for x in b.column("html")]
            return [pa.array(got, pa.string()), pa.array([len(x) for x in got], pa.int64())]

        return batch

    return append_columns(pages, pages.columns if keep is None else keep, [(out, T.StringType()), (chars, T.LongType())], make)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = table(spark, sf_dir, "pages").select("page_id", "url", "html")
    return with_main_text(pages, train(pages), ["page_id", "url"])
