"""Main text of web pages by minimum-cut labelling of their text blocks.

A page is cut into blocks (the text between block-level tags), each with what stands around it: the
elements that hold it, their class and id words, its share of link text, words, punctuation. A
classifier turns that into a probability of being content: the weights of the text features are
learnt by logistic regression from blocks whose markup names them, the markup's own are stated. Its
two log costs become the capacities from the source and to the sink. Neighbouring blocks are joined by a smoothness edge, a
strong one if the same element holds both, a weak one across elements of the same kind of region,
none between a region that is content by its element (article, main) and one that is not. Blocks of
one element are also joined to the element's first block (DOM proximity), so a block that is far
from it in the page follows its siblings. The minimum cut, by maximum flow, separates content from
boilerplate; ties go to boilerplate.

A bad name (a class, id or role with a word such as sidebar) counts for all that the element holds,
up to a main element, and up to an article if nothing else on the page is content. Names of what goes
with an element (with-sidebar, has-menu, any layout) and headers of an article (post-header) are not bad.

Scripts, styles, the head, forms and comments of the markup are never text. Character references
are decoded, white space inside a block is one space, blocks are joined by two line feeds. A null or
empty page, or one without content, has the empty text. Repeated rows are extracted each.
"""

from __future__ import annotations

import html as references
import math
import re
from collections import deque
from collections.abc import Iterator

import pyarrow as pa
from pyspark.ml.classification import LogisticRegression
from pyspark.ml.functions import array_to_vector
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from blockwatch.llm.common import lean, query, table

# Element names by their part in a page (fixed values of HTML).
BLOCK = frozenset("""address article aside blockquote body caption center dd details dialog dir div dl dt fieldset
figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr html legend li main menu nav ol optgroup option p
pre search section summary table tbody td tfoot th thead tr ul""".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
SILENT = frozenset("""script style noscript template head title textarea select button iframe object svg canvas math
audio video datalist""".split())
RAW = ("script", "style", "textarea", "title", "iframe", "noscript")
BOILERPLATE = frozenset("nav aside footer form menu dialog search fieldset".split())
CONTENT = frozenset("article main".split())
CLOSES_P = BLOCK - {"body", "html", "option", "optgroup", "td", "th", "tr", "tbody", "thead", "tfoot", "caption"}
#: Elements that an opening tag of the same group ends.
SIBLINGS = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"},
            "th": {"td", "th"}, "option": {"option"}, "p": {"p"}}
#: Words of class, id or role names that speak for boilerplate or content (fixed values).
BAD_WORDS = frozenset("""ad ads advert advertisement advertising alert author banner bar breadcrumb breadcrumbs byline
comment comments consent cookie cookies copyright disqus foot footer footnav gdpr head header hidden login menu meta
modal nav navbar navigation newsletter notice pagination popup promo recommended register related reply replies
respond search share sharing sidebar signup skip social sponsor sponsored subscribe subscription tags toolbar
tooltip topbar widget widgets complementary contentinfo dialog feedback""".split())
GOOD_WORDS = frozenset("article body content entry main post story text".split())
#: Words from which on a name tells what goes with the element, not what it is (with-sidebar, has-menu).
MODIFIERS = frozenset("with without has have no".split())
#: Bad words that name a headline's element inside an article or behind one of these words.
HEADLINE, ARTICLE_WORDS = frozenset("head header".split()), frozenset("article entry post story".split())

#: What the markup itself says weighs this much (log odds); what the text says is learnt, and bounded.
MARKUP = {"content": 4.0, "boilerplate": -7.0, "bad": -9.0, "good": 1.5}
TEXT_NAMES = ("links", "words", "stops", "paragraph", "heading", "item")
TEXT_BOUND = 2.0
#: Pages whose blocks train the text weights, at most.
TRAIN_PAGES = 2000
#: Bias and text weights where no page of the sample has both kinds of regions.
PLAIN_TEXT = (-0.9, -3.5, 0.55, 0.8, 0.9, 0.6, -0.6)
SAME_ELEMENT, SAME_REGION, ELEMENT_HEAD = 0.9, 0.3, 0.4

_TAG = re.compile(
    r"<!--.*?(?:-->|\Z)|<[!?][^>]*+(?:>|\Z)|"
    r"<(/?)([a-zA-Z][a-zA-Z0-9:-]*+)((?:[^>\"']++|\"[^\"]*+\"|'[^']*+')*+)>|"
    r"<(/?)([a-zA-Z][a-zA-Z0-9:-]*+)([^>]*+)(?:>|\Z)", re.S)
_RAW_END = {name: re.compile(rf"</{name}(?=[\s/>])[^>]*+(?:>|\Z)", re.I) for name in RAW}
_ATTRIBUTE = re.compile(r"\b(class|id|role|hidden|style)\s*+(?:=\s*+(?:\"([^\"]*+)\"|'([^']*+)'|([^\s>]++)))?", re.I)
_NAME_WORD = re.compile(r"[A-Z]?[a-z]+|[A-Z]+(?![a-z])")
_STOPS = re.compile(r"[.!?;:,]")


def _named(value: str, inside: bool) -> tuple[bool, bool]:
    """Whether the names of a class, id or role are bad, and good; ``inside`` an article or not."""
    bad = good = False
    for name in value.split():
        words = [w.lower() for w in _NAME_WORD.findall(name)]
        if "layout" in words:  # how the page is laid out
            continue
        words = words[:next((i for i, w in enumerate(words) if w in MODIFIERS), len(words))]
        own = BAD_WORDS.intersection(words)
        if own <= HEADLINE and (inside or ARTICLE_WORDS.intersection(words)):
            own = frozenset()
        bad = bad or bool(own)
        good = good or bool(GOOD_WORDS.intersection(words))
    return bad, good


class _Element:
    """An open element: what its own tags and those around it say."""

    __slots__ = ("name", "number", "content", "boilerplate", "bad", "good", "silent", "first")

    def __init__(self, name: str, number: int, attributes: str, around: _Element | None, reset: bool = False):
        self.name, self.number, self.first = name, number, None
        self.content = around.content if around else False
        self.boilerplate = around.boilerplate if around else False
        self.bad = around.bad if around else False
        self.good = around.good if around else False
        self.silent = around.silent if around else False
        if name in SILENT:
            self.silent = True
        if name == "main" or (reset and name == "article" and not self.content):
            self.bad = False
        if name in CONTENT:
            self.content, self.boilerplate = True, self.boilerplate and name != "main"
        if name in BOILERPLATE or (name == "header" and not self.content):
            self.boilerplate = True
        if attributes and name not in ("html", "body"):
            for key, *values in _ATTRIBUTE.findall(attributes):
                value = values[0] or values[1] or values[2]
                if key.lower() == "style":
                    self.silent = self.silent or "display:none" in value.replace(" ", "").lower()
                elif key.lower() == "hidden":
                    self.silent = True
                else:
                    bad, good = _named(value, self.content)
                    if bad and name != "main":
                        self.bad = True
                    elif good:
                        self.good = True

    def region(self) -> tuple:
        return self.content, self.boilerplate, self.bad


class _Block:
    __slots__ = ("text", "element", "leaf", "linked")

    def __init__(self, text: str, element: _Element, leaf: str, linked: int):
        self.text, self.element, self.leaf, self.linked = text, element, leaf, linked


def _blocks(page: str, reset: bool = False) -> list[_Block]:
    """The text blocks of a page, in order; with ``reset``, bad names around an article do not count in it."""
    root = _Element("html", 0, "", None)
    stack, out, number = [root], [], 0
    parts: list[str] = []
    linked, links = 0, 0

    def flush() -> None:
        nonlocal linked
        if parts:
            text = " ".join(references.unescape("".join(parts)).split())
            parts.clear()
            if text:
                leaf = stack[-1]
                # The element that holds the block is the one around its own paragraph, item or heading.
                holder = stack[-2] if len(stack) > 1 and leaf.name in ("p", "li", "h1", "h2", "h3", "h4", "h5", "h6", "dt", "dd") \
                    and leaf.region() == stack[-2].region() else leaf
                out.append(_Block(text, holder, leaf.name, linked))
        linked = 0

    at, end = 0, len(page)
    while at < end:
        m = _TAG.search(page, at)
        stop = m.start() if m else end
        if stop > at and not stack[-1].silent:
            piece = page[at:stop]
            parts.append(piece)
            if links:
                linked += len(piece)
        if not m:
            break
        at = m.end()
        name = m.group(2) or m.group(5)
        if name is None:
            continue
        name = name.lower()
        closing, attributes = (m.group(1), m.group(3)) if m.group(2) else (m.group(4), m.group(6))
        if name == "a":
            links = max(0, links + (-1 if closing else 1))
            continue
        if name not in BLOCK and name not in SILENT:
            if name == "br":
                parts.append(" ")
            continue
        if name in BLOCK:
            flush()
            links = 0
        if closing:
            if any(e.name == name for e in stack[1:]):
                while stack.pop().name != name:
                    pass
            continue
        if name in CLOSES_P or name in SIBLINGS:
            ended = SIBLINGS.get(name, set()) | ({"p"} if name in CLOSES_P else set())
            while len(stack) > 1 and stack[-1].name in ended:
                stack.pop()
        if name in VOID or attributes.endswith("/"):
            continue
        number += 1
        if name in _RAW_END:  # its text is not markup
            m = _RAW_END[name].search(page, at)
            at = m.end() if m else end
            continue
        if name == "body":  # ends a head that was left open
            del stack[1:]
        stack.append(_Element(name, number, attributes, stack[-1], reset))
    flush()
    return out


def _text_features(b: _Block) -> tuple[float, ...]:
    """Of TEXT_NAMES: what a block's text says, whatever holds it."""
    return (min(1.0, b.linked / len(b.text)), math.log1p(b.text.count(" ") + 1) - 1.5,
            min(1.0, len(_STOPS.findall(b.text)) / 3), float(b.leaf == "p"),
            float(b.leaf[0] == "h" and b.leaf[1:].isdigit()), float(b.leaf in ("li", "td", "th", "option")))


def _probability(b: _Block, text: tuple[float, ...] = PLAIN_TEXT) -> float:
    z = text[0] + sum(w * x for w, x in zip(text[1:], _text_features(b), strict=True))
    z = max(-TEXT_BOUND, min(TEXT_BOUND, z))
    e = b.element
    z += MARKUP["content"] * e.content + MARKUP["boilerplate"] * e.boilerplate + MARKUP["bad"] * e.bad
    z += MARKUP["good"] * (e.good and not e.bad)
    return 1 / (1 + math.exp(-max(-12.0, min(12.0, z))))


def fit_text(pages: DataFrame, html: str = "html") -> tuple[float, ...]:
    """Bias and text weights by logistic regression, from blocks whose markup says what they are
    (inside an article or main, or inside navigation, footers, adverts and the like), on at most
    about TRAIN_PAGES pages with the smallest hashes."""
    rows = pages.select(F.coalesce(F.col(html), F.lit("")).alias("html"))
    share = min(1.0, (1.1 * TRAIN_PAGES) / max(rows.count(), 1))
    bound = min(2 ** 63 - 1, int(share * 2 ** 64) - 2 ** 63)

    @lean
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            known = [(x, x.element.content and not x.element.bad and not x.element.boilerplate)
                     for p in b.column(0).to_pylist() for x in _blocks(p)
                     if x.element.content or x.element.boilerplate or x.element.bad]
            yield pa.RecordBatch.from_pydict({
                "x": pa.array([list(_text_features(x)) for x, _ in known], pa.list_(pa.float64())),
                "label": pa.array([float(y) for _, y in known], pa.float64())})

    blocks = rows.where(F.xxhash64("html") <= bound).mapInArrow(run, "x array<double>, label double")
    # Text of the two kinds weighs the same, however many blocks each has.
    counts = {r["label"]: r["n"] for r in blocks.groupBy("label").agg(F.count(F.lit(1)).alias("n")).collect()}
    if len(counts) < 2:
        return PLAIN_TEXT
    total = sum(counts.values())
    weight = F.when(F.col("label") == 1, total / counts[1.0]).otherwise(total / counts[0.0])
    model = LogisticRegression(featuresCol="features", labelCol="label", weightCol="w", regParam=0.01, maxIter=30).fit(
        blocks.select(array_to_vector("x").alias("features"), "label", weight.alias("w")))
    return (float(model.intercept), *map(float, model.coefficients))


def minimum_cut(source: list[float], sink: list[float], edges: list[tuple[int, int, float]]) -> list[bool]:
    """Whether each node is on the source's side of the minimum cut of a graph whose nodes have a
    capacity from the source and to the sink, and undirected edges between them."""
    n = len(source)
    # Flow straight through a node leaves it with one of its capacities.
    excess = [s - t for s, t in zip(source, sink, strict=True)]
    near: list[dict[int, float]] = [{} for _ in range(n)]
    for a, b, c in edges:
        if a != b and c > 0:
            near[a][b] = near[a].get(b, 0.0) + c
            near[b][a] = near[b].get(a, 0.0) + c
    tiny = 1e-12
    while True:
        # Shortest augmenting path from any node with excess to any node with room.
        back = {v: -1 for v in range(n) if excess[v] > tiny}
        queue, found = deque(back), -1
        while queue and found < 0:
            v = queue.popleft()
            for w, c in near[v].items():
                if c > tiny and w not in back:
                    back[w] = v
                    if excess[w] < -tiny:
                        found = w
                        break
                    queue.append(w)
        if found < 0:
            return [v in back for v in range(n)]
        path, v = [], found
        while back[v] >= 0:
            path.append((back[v], v))
            v = back[v]
        push = min(excess[v], -excess[found], min(near[a][b] for a, b in path))
        excess[v] -= push
        excess[found] += push
        for a, b in path:
            near[a][b] -= push
            near[b][a] = near[b].get(a, 0.0) + push


def _edges(blocks: list[_Block]) -> list[tuple[int, int, float]]:
    out = []
    for e in {b.element for b in blocks}:
        e.first = None
    for i, b in enumerate(blocks):
        if i:
            a = blocks[i - 1]
            if a.element is b.element:
                out.append((i - 1, i, SAME_ELEMENT))
            elif a.element.region() == b.element.region():
                out.append((i - 1, i, SAME_REGION))
        if b.element.first is None:
            b.element.first = i
        elif b.element.first != i - 1:
            out.append((b.element.first, i, ELEMENT_HEAD))
    return out


def main_text(page: str | None, text: tuple[float, ...] = PLAIN_TEXT) -> str:
    """The main text of one page, by the given text weights."""
    found = _kept(_blocks(page or ""), text)
    # A page without content whose article stands in an element with a bad name: the name is no verdict on it.
    return found or _kept(_blocks(page or "", reset=True), text)


def _kept(blocks: list[_Block], text: tuple[float, ...]) -> str:
    if not blocks:
        return ""
    p = [_probability(b, text) for b in blocks]
    content = minimum_cut([-math.log(1 - x) for x in p], [-math.log(x) for x in p], _edges(blocks))
    return "\n\n".join(b.text for b, keep in zip(blocks, content, strict=True) if keep)


def extract(pages: DataFrame, html: str = "html", keep: list[str] | None = None,
            text: tuple[float, ...] | None = None) -> DataFrame:
    """Every row as ``row`` (a struct of its columns, or of those in ``keep``), with its main ``text``;
    text weights that are not given are fitted on the pages."""
    weights = fit_text(pages, html) if text is None else text

    @lean
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            texts = [main_text(x, weights) for x in b.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(texts, pa.string())], names=["row", "text"])

    rows = pages.select(F.struct(*(keep or ["*"])).alias("row"), F.coalesce(F.col(html), F.lit("")).alias("html"))
    return rows.mapInArrow(run, f"row {rows.schema['row'].dataType.simpleString()}, text string")


@query("op4_html")
def html_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = extract(table(spark, sf_dir, "pages"), keep=["page_id", "url"])
    return found.select("row.page_id", "row.url", "text", F.length("text").cast("bigint").alias("n_chars"))
