"""Main text of web pages by a tree-structured graphical model.

A page becomes a tree of its block elements, with the runs of text between their borders as leaves.  Each node has a hidden
label: main text or not.  Its own potential is a sum of weights of what is seen at the node (tag, names of classes, length,
share of links, sentence ends); each pair of parent and child has a potential by the child's kind.  Sum-product messages go
up from the leaves and down from the root and give every node's marginal; a run is main text where its marginal is over a
half.  The weights are fitted on labelled pages by the gradient of the likelihood, which the same messages give.

Labelled pages: those of `html_pages`, and at most SAMPLE rows of the table, chosen by hash, whose own <article> or <main>
serves as the label; each of these is seen a second time with its tags and classes made plain, so that the model does not
lean on them alone.  The bound on the sample is part of the method; extraction is a map over all rows, without an exchange.

White space is what Unicode calls so.  A line break inside a block is white space; blocks are joined by one line end.

Edge cases: null and empty pages have the empty text; text without any tag is judged as a run below the root; elements that
are never closed end with their parent; a tag that the page breaks off in is no text, a broken character reference is; rows
that repeat are judged alike; no rows give no rows; a table without labelled pages is judged by those of `html_pages`.
"""

from __future__ import annotations

import html
import re

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import arrow_schema, small_batches, table
from .html_pages import LABELLED

#: Labelled rows of the table at most, and their length at most: the sample is bounded in bytes.
SAMPLE, SAMPLE_CHARS = 256, 50_000
#: Weight of a page of html_pages against one of the table.
TAUGHT = 15.0
STEPS, RATE, PRIOR = 200, 0.1, 2e-3

#: Elements that separate blocks; all others are part of a run of text.
STRUCTURE = ("#root", "html", "body", "div", "section", "article", "main", "nav", "header", "footer", "aside", "form", "fieldset", "center", "details", "dialog", "menu", "table", "thead", "tbody", "tfoot", "tr")
TEXT_BLOCKS = ("p", "h1", "h2", "h3", "h4", "h5", "h6", "ul", "ol", "li", "dl", "dt", "dd", "blockquote", "pre", "figure", "figcaption", "td", "th", "caption", "address", "summary", "hgroup", "legend")
#: What a browser does not show as text, or shows as a control.
HIDDEN = ("template", "svg", "math", "select", "datalist", "button", "canvas", "object", "video", "audio", "noscript")
RAW = ("script", "style", "title", "textarea", "iframe", "noembed", "noframes", "xmp")
VOID = ("area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "param", "source", "track", "wbr")
#: Elements whose start ends an open one of these, up to the elements that stop the search.
ENDS = {"li": (("li",), ("ul", "ol", "menu")), "dt": (("dt", "dd"), ("dl",)), "dd": (("dt", "dd"), ("dl",)), "tr": (("tr", "td", "th", "caption"), ("table",)), "td": (("td", "th"), ("tr", "table")), "th": (("td", "th"), ("tr", "table")), "thead": (("caption", "tr", "td", "th"), ("table",)), "tbody": (("thead", "tbody", "caption", "tr", "td", "th"), ("table",)), "tfoot": (("thead", "tbody", "tr", "td", "th"), ("table",))}
KEEPS_P = ("li", "dt", "dd", "tr", "td", "th", "thead", "tbody", "tfoot", "caption", "legend", "html", "body")

#: Words in the names of classes, identifiers and roles, by what they speak of.
NAMES = {
    "main": "article content main post entry story text blog document",
    "menu": "nav navbar navigation menu breadcrumb breadcrumbs pagination pager toolbar tabs",
    "head": "header masthead banner topbar top branding logo head",
    "foot": "footer foot copyright colophon bottom contentinfo imprint legal",
    "side": "sidebar aside side rail widget widgets related recommended recommendations trending popular teaser teasers more complementary",
    "ad": "ad ads adv advert adverts advertisement advertising sponsor sponsored sponsors promo promoted promotion dfp adsense",
    "notice": "cookie cookies consent gdpr notice notices alert popup modal overlay newsletter subscribe subscription signup paywall dialog toast announcement",
    "social": "share sharing social follow facebook twitter",
    "form": "form search login signin register contact poll survey",
    "comment": "comment comments reply replies respond discussion disqus reader thread feedback",
}
SPOKEN = {
    "notice": ("cookie", "privacy policy", "newsletter", "sign up", "subscribe"),
    "foot": ("©", "copyright", "all rights reserved", "terms of use"),
    "ad": ("advertisement", "sponsored"),
    "comment": ("comments", "leave a reply", "log in"),
}
GROUP = {word: name for name, words in NAMES.items() for word in words.split()}
TOKEN = re.compile(r"<!--.*?(?:--!?>|\Z)|<[!?][^>]*>?|<(/?)([a-zA-Z][^\s/>]*)((?:[^>=]+|=\s*\"[^\"]*\"|=\s*'[^']*'|=)*+)(>?)", re.S)
ATTRIBUTE = re.compile(r"(?:^|\s)(class|id|role|hidden|data-main)\s*(?:=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+)))?", re.I)
WORD = re.compile(r"[A-Z]?[a-z]+|[A-Z]+")


class Page:
    """The tree of a page: for each node its parent (an earlier node), tag ("" for a run), groups of names and text."""

    __slots__ = ("chars", "groups", "labels", "links", "parents", "tags", "texts")

    def __init__(self, source: str):
        self.parents, self.tags, self.groups, self.texts, self.chars, self.links, self.labels = [-1], ["#root"], [()], [None], [0], [0], [None]
        self._read(source)
        for k in range(len(self.parents) - 1, 0, -1):
            up = self.parents[k]
            self.chars[up] += self.chars[k]
            self.links[up] += self.links[k]

    def _node(self, parent: int, tag: str, groups: tuple, text: str | None, chars: int, links: int, label) -> int:
        for column, value in ((self.parents, parent), (self.tags, tag), (self.groups, groups), (self.texts, text), (self.chars, chars), (self.links, links), (self.labels, label)):
            column.append(value)
        return len(self.parents) - 1

    def _read(self, source: str) -> None:
        stack: list[tuple[str, int]] = [("#root", 0)]
        hidden = link = 0  # open hidden elements, whether a link is open
        run: list[str] = []
        linked = 0
        at, size = 0, len(source)

        def close() -> None:
            nonlocal linked
            if run:
                text = " ".join(html.unescape("".join(run)).split())
                if text:
                    self._node(stack[-1][1], "", (), text, len(text), min(linked, len(text)), self.labels[stack[-1][1]])
                run.clear()
                linked = 0

        def pop_to(depth: int) -> None:
            nonlocal hidden
            close()
            while len(stack) > depth:
                hidden -= stack.pop()[0] in HIDDEN

        while at < size:
            found = TOKEN.search(source, at)
            text = source[at : found.start() if found else size]
            if text and not hidden:
                run.append(text)
                linked += len(text) if link else 0
            if not found:
                break
            at = found.end()
            name = found[2]
            if name is None or not found[4]:
                continue  # a comment, a declaration, or a tag that the page breaks off in
            tag = name.lower()
            if found[1]:
                if tag == "a":
                    link = 0
                elif tag == "br":
                    run.append(" ")
                elif tag not in ("body", "html"):
                    depth = next((d for d in range(len(stack) - 1, 0, -1) if stack[d][0] == tag), 0)
                    if depth:
                        pop_to(depth)
                continue
            if tag in RAW:
                end = re.compile(rf"</{tag}(?=[\s/>])[^>]*>?", re.I).search(source, at)
                at = end.end() if end else size
                continue
            if tag == "a":
                link = 1
            elif tag == "br":
                run.append(" ")
            elif tag == "hr":
                close()
            elif tag in KINDS or tag in HIDDEN:
                if tag not in KEEPS_P and tag not in HIDDEN:
                    depth = next((d for d in range(len(stack) - 1, 0, -1) if stack[d][0] in ("p", "td", "th", "li", "table")), 0)
                    if depth and stack[depth][0] == "p":
                        pop_to(depth)
                if tag in ENDS:
                    ended, stops = ENDS[tag]
                    low = 0
                    for d in range(len(stack) - 1, 0, -1):
                        if stack[d][0] in stops:
                            break
                        if stack[d][0] in ended:
                            low = d
                    if low:
                        pop_to(low)
                if found[3].rstrip().endswith("/") and tag in HIDDEN:
                    continue
                groups, label = (), self.labels[stack[-1][1]]
                if "=" in found[3] or "hidden" in found[3]:
                    groups, label = self._names(found[3], label)
                if tag in KINDS:
                    close()
                    stack.append((tag, self._node(stack[-1][1], tag, groups, None, 0, 0, label)))
                else:
                    stack.append((tag, stack[-1][1]))
                hidden += tag in HIDDEN
        close()

    @staticmethod
    def _names(attributes: str, label):
        groups = set()
        for a in ATTRIBUTE.finditer(attributes):
            key, value = a[1].lower(), a[2] or a[3] or a[4] or ""
            if key == "data-main":
                label = value == "1"
            elif key == "hidden":
                groups.add("hidden")
            else:
                groups.update(GROUP[w] for w in map(str.lower, WORD.findall(value)) if w in GROUP)
        return tuple(groups), label


KINDS = {"": 0} | dict.fromkeys(TEXT_BLOCKS, 1) | dict.fromkeys(STRUCTURE, 2)


def bucket(value: float, *steps: float) -> int:
    return sum(value >= s for s in steps)


def seen(page: Page, plain: bool = False) -> list[list[str]]:
    """What is seen at each node.  plain: tags of structure are all div, names are not seen."""
    out = []
    for k, tag in enumerate(page.tags):
        chars, share = page.chars[k], bucket(page.links[k] / page.chars[k], 0.01, 0.3, 0.7) if page.chars[k] else 4
        if tag:
            if plain and KINDS[tag] == 2:
                tag = "div"
            out.append(["block", f"tag {tag}", f"block links {share}", f"block length {bucket(chars, 1, 60, 300, 1500)}"] + ([] if plain else [f"name {g}" for g in page.groups[k]]))
        else:
            text, up = page.texts[k], page.tags[page.parents[k]]
            up = "div" if plain and KINDS[up] == 2 else up
            low = text.lower() if chars < 300 else ""
            said = [f"says {g}" for g, words in SPOKEN.items() if any(w in low for w in words)] if low else []
            out.append(["run", f"run in {up}", f"run links {share}", f"run length {bucket(chars, 25, 80, 200)}", f"run ends {text[-1] in '.!?…:”\"»'}", *said])
    return out


class Forest:
    """The nodes of many pages in levels, for messages between all parents and children of a level at once."""

    def __init__(self, pages: list[tuple[list[int], list[int], list[list[int]]]]):
        """pages: parents, kinds and numbers of what is seen, by node."""
        import numpy as np

        sizes = [len(p) for p, _, _ in pages]
        starts = np.repeat(np.cumsum([0, *sizes[:-1]]), sizes) if sizes else np.zeros(0, int)
        parents = np.array([x for p, _, _ in pages for x in p], int)
        self.parents = np.where(parents >= 0, parents + starts, -1)
        self.kinds = np.array([x for _, k, _ in pages for x in k], int)
        counts = [len(s) for _, _, seen_at in pages for s in seen_at]
        self.what = np.array([x for _, _, seen_at in pages for s in seen_at for x in s], int)
        self.where = np.repeat(np.arange(len(counts)), counts)
        depth: list[int] = []
        for (p, _, _), start in zip(pages, np.cumsum([0, *sizes[:-1]]), strict=True):
            for x in p:
                depth.append(0 if x < 0 else depth[start + x] + 1)
        depth = np.array(depth, int)
        order = np.argsort(depth, kind="stable")
        self.levels = np.split(order, np.flatnonzero(np.diff(depth[order])) + 1) if len(order) else []

    def marginals(self, weights, edges):
        """Log odds of every node, and of each pair of parent and child: its four probabilities."""
        import numpy as np

        n = len(self.parents)
        up = np.bincount(self.where, weights[self.what], n)
        sent = np.zeros(n)
        e = edges[self.kinds]  # n x parent's label x own label
        for level in self.levels[:0:-1]:
            own, t = up[level], e[level]
            sent[level] = np.logaddexp(t[:, 1, 0], t[:, 1, 1] + own) - np.logaddexp(t[:, 0, 0], t[:, 0, 1] + own)
            up += np.bincount(self.parents[level], sent[level], n)
        belief = up.copy()
        rest = np.zeros(n)
        for level in self.levels[1:]:
            r, t = belief[self.parents[level]] - sent[level], e[level]
            rest[level] = r
            belief[level] += np.logaddexp(t[:, 0, 1], r + t[:, 1, 1]) - np.logaddexp(t[:, 0, 0], r + t[:, 1, 0])
        both = e + np.stack([np.zeros(n), rest], 1)[:, :, None] + np.stack([np.zeros(n), up], 1)[:, None, :]
        both = np.exp(both - both.max((1, 2), keepdims=True))
        return belief, both / both.sum((1, 2), keepdims=True)


class Model:
    """Numbers of what can be seen, their weights, and the potentials of parent and child by the child's kind."""

    def __init__(self, numbers: dict[str, int], weights, edges):
        self.numbers, self.weights, self.edges = numbers, weights, edges

    def of(self, page: Page, plain: bool = False):
        return page.parents, [KINDS[t] for t in page.tags], [[self.numbers[s] for s in at if s in self.numbers] for at in seen(page, plain)]

    def runs(self, sources: list[str]) -> list[list[tuple[str, float]]]:
        """For each page its runs of text in page order, with their marginals."""
        import numpy as np

        pages = [Page(s) for s in sources]
        belief = Forest([self.of(p) for p in pages]).marginals(self.weights, self.edges)[0]
        out, at = [], 0
        for p in pages:
            odds = belief[at : at + len(p.parents)]
            at += len(p.parents)
            out.append([(t, float(1 / (1 + np.exp(-odds[k])))) for k, t in enumerate(p.texts) if t is not None])
        return out


def article_labels(page: Page) -> list[bool] | None:
    """The page's own <article> or <main> as labels; None where it has neither, or several."""
    tops = [k for k, t in enumerate(page.tags) if t == "article"] or [k for k, t in enumerate(page.tags) if t == "main"]
    if len(tops) != 1:
        return None
    inside = [False] * len(page.tags)
    for k in range(tops[0], len(page.tags)):
        inside[k] = k == tops[0] or page.parents[k] >= tops[0] and inside[page.parents[k]] and page.tags[k] not in ("nav", "aside", "footer", "form") and not {"ad", "comment"} & set(page.groups[k])
    return inside


def fit(sources: list[str]) -> Model:
    """The weights that make the labels of the labelled pages likeliest, under a Gaussian prior."""
    import numpy as np

    taught = [(p := Page(s), [bool(x) for x in p.labels], TAUGHT) for s in LABELLED]
    taught += [(p, own, 1.0) for p in map(Page, sources) if (own := article_labels(p)) is not None]
    numbers: dict[str, int] = {}
    views = [(p, labels, w / 2, plain) for p, labels, w in taught for plain in (False, True)]
    for p, _, _, plain in views:
        for at in seen(p, plain):
            for s in at:
                numbers.setdefault(s, len(numbers))
    model = Model(numbers, np.zeros(len(numbers)), np.zeros((3, 2, 2)))
    forest = Forest([model.of(p, plain) for p, _, _, plain in views])
    label = np.array([x for _, labels, _, _ in views for x in labels], int)
    share = np.repeat([w for _, _, w, _ in views], [len(labels) for _, labels, _, _ in views])
    child = forest.parents >= 0
    total = sum(w for _, _, w, _ in views)
    target = np.zeros((len(label), 2, 2))
    target[np.arange(len(label)), label[forest.parents], label] = 1
    x = np.concatenate([model.weights, model.edges.ravel()])
    first, second = np.zeros_like(x), np.zeros_like(x)
    for step in range(1, STEPS + 1):  # Adam
        weights, edges = x[: len(numbers)], x[len(numbers) :].reshape(3, 2, 2)
        belief, both = forest.marginals(weights, edges)
        miss = share * (label - 1 / (1 + np.exp(-belief)))
        g = np.bincount(forest.what, miss[forest.where], len(numbers))
        pair = np.zeros((3, 2, 2))
        np.add.at(pair, forest.kinds[child], (share[:, None, None] * (target - both))[child])
        gradient = np.concatenate([g, pair.ravel()]) / total - PRIOR * x
        first, second = 0.9 * first + 0.1 * gradient, 0.99 * second + 0.01 * gradient**2
        x = x + RATE * (first / (1 - 0.9**step)) / (np.sqrt(second / (1 - 0.99**step)) + 1e-8)
    return Model(numbers, x[: len(numbers)], x[len(numbers) :].reshape(3, 2, 2))


def train(pages: DataFrame, body: str = "html") -> Model:
    """The model of `html_pages` and of a bounded sample of the table's labelled rows.  The sample is chosen by hashes, which
    are all that is ordered; then only the rows of these hashes are fetched, each text once."""
    c = F.col(body).cast("string")
    own = pages.select(c.alias("_html")).filter((F.length("_html") <= SAMPLE_CHARS) & F.col("_html").rlike("(?i)<(article|main)[\\s>]")).withColumn("_h", F.xxhash64("_html"))
    picked = [r._h for r in own.select("_h").distinct().orderBy("_h").limit(SAMPLE).collect()]
    rows = own.filter(F.col("_h").isin(picked)).groupBy("_h").agg(F.min("_html").alias("_html")).collect() if picked else []
    return fit([r._html for r in sorted(rows, key=lambda r: r._h)])


def blocks(pages: DataFrame, model: Model, key: str = "page_id", body: str = "html") -> DataFrame:
    """key, place, block, marginal: every run of text of every page."""
    small_batches(pages.sparkSession, 64)
    kind = f"{key} {pages.schema[key].dataType.simpleString()}, place int, block string, marginal double"
    schema = arrow_schema(kind)

    def run(batches):
        import pyarrow as pa

        for batch in batches:
            ids = batch.column(0).to_pylist()
            rows = [(i, k, text, p) for i, runs in zip(ids, model.runs([x or "" for x in batch.column(1).to_pylist()]), strict=True) for k, (text, p) in enumerate(runs)]
            yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], f.type) for k, f in enumerate(schema)], schema=schema)

    return pages.select(key, F.col(body).cast("string").alias("_html")).mapInArrow(run, kind)


def extract(pages: DataFrame, model: Model, keep: tuple[str, ...] = ("page_id", "url"), body: str = "html") -> DataFrame:
    """keep, text, n_chars: the main text of every page."""
    small_batches(pages.sparkSession, 64)
    kind = ", ".join(f"`{c}` {pages.schema[c].dataType.simpleString()}" for c in keep) + ", text string, n_chars bigint"
    schema = arrow_schema(kind)

    def run(batches):
        import pyarrow as pa

        for batch in batches:
            *kept, bodies = batch.columns
            texts = ["\n".join(t for t, p in runs if p > 0.5) for runs in model.runs([x or "" for x in bodies.to_pylist()])]
            yield pa.RecordBatch.from_arrays([*kept, pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())], schema=schema)

    return pages.select(*keep, F.col(body).cast("string").alias("_html")).mapInArrow(run, kind)


def query(spark, sf_dir):
    """op13: every page's main text."""
    pages = table(spark, sf_dir, "pages")
    return extract(pages, train(pages))
