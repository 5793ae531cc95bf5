"""Main text of web pages by a tree-structured graphical model.

A page becomes a tree of its block elements.  Each element has a binary label,
content or not.  Its own evidence is a weighted sum of features (tag, words of
its class, id and role, own words, share of link text, sentence ends); a
potential for each pair of labels connects it with its parent.  Sum-product
messages pass upward from the leaves and downward from the root, which gives the
exact marginal of every element.  The text blocks of elements with a marginal
above one half are the main text, in page order.

Weights and pair potentials are trained here, as a conditional random field: the
gradient of the likelihood is observed minus expected counts, both from the
messages.  The labelled pages are made by ``labelled_pages``: a fixed number of
small pages in many layouts, whose elements carry their label in ``data-y``.

Parsing follows HTML where it matters for text: comments, scripts, styles and
other raw elements are skipped to their end tag; a block start closes an open
paragraph; list items, cells and options close their predecessors; a stray end
tag is ignored; every page has one html and one body element.  Elements that are no
blocks belong to their block, formulas and embedded media's text too; ``br`` is white space.
A slash at the end of a start tag closes nothing.

Defined results.  A null or empty page, or one without content, gives "".
Repeated rows are handled row by row.  Other columns are ignored.
"""

from __future__ import annotations

import html as entities
import math
import random
import re
from functools import cache

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

N_LABELLED, EPOCHS = 400, 30
_TAG = re.compile(r"<(?:(!--)|(/?)([a-zA-Z][a-zA-Z0-9:-]*)((?:\"[^\"]*\"|'[^']*'|[^>\"'])*+)>|[!?/][^>]*+>)")
_ATTRIBUTE = re.compile(r"([a-zA-Z_:][-\w:.]*)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+))")
_TOKEN = re.compile(r"[a-z]+")
# Elements by their role in parsing.
RAW = frozenset("script style template noscript textarea select title".split())
BLOCK = frozenset("body button caption center colgroup dir hgroup html head legend listing noframes optgroup search summary plaintext xmp".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
CLOSES_P = frozenset("address article aside blockquote details div dl fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hr main menu nav ol p pre section table ul".split())
SIBLINGS = {"li": ("li",), "dt": ("dt", "dd"), "dd": ("dt", "dd"), "tr": ("tr", "td", "th"), "td": ("td", "th"), "th": ("td", "th"), "option": ("option",), "tbody": ("thead", "tbody", "tr", "td", "th"), "tfoot": ("tbody", "tr", "td", "th")}
BOUNDS = frozenset("ul ol dl table select menu".split())
# Words of class, id and role that tell what an element is for.
BAD_WORDS = frozenset("ad ads advert adverts advertisement alert banner breadcrumb breadcrumbs byline comment comments consent cookie cookies disqus footer form header links login masthead menu meta modal nav navbar navigation newsletter notice notification outbrain pager pagination popup promo promotion recommended related reply replies respond search share sharing shoutbox sidebar sidebars signup skip social sponsor sponsored subscribe tags teaser toc toolbar tooltip widget widgets complementary contentinfo".split())
GOOD_WORDS = frozenset("article articlebody body content entry main maincontent post story text prose".split())
TAGS = {"address": "meta", "article": "article", "main": "article", "nav": "nav", "header": "header", "footer": "footer", "aside": "aside", "form": "form", "button": "form", "fieldset": "form", "menu": "nav", "p": "p", "h1": "h", "h2": "h", "h3": "h", "h4": "h", "h5": "h", "h6": "h", "ul": "list", "ol": "list", "dl": "list", "li": "item", "dt": "item", "dd": "item", "table": "table", "tr": "table", "td": "cell", "th": "cell", "tbody": "table", "pre": "pre", "blockquote": "pre", "figure": "figure", "figcaption": "figure", "section": "div", "div": "div", "html": "root", "body": "root", "dialog": "form"}


_HIDDEN = re.compile(r"(?:^|\s)hidden(?=[\s=/]|$)", re.I)
_QUOTED = re.compile(r"\"[^\"]*\"|'[^']*'")


def _is_block(tag: str) -> bool:
    """Whether an element is a node of the tree; all others, unknown ones too, are part of their block's text, as in a browser."""
    return tag in BLOCK or tag in TAGS or tag in CLOSES_P or tag in SIBLINGS


def _is_hidden(attributes: str, found: dict[str, str]) -> bool:
    style = found.get("style", "").replace(" ", "").lower()
    return found.get("aria-hidden") == "true" or "display:none" in style or "visibility:hidden" in style or bool(_HIDDEN.search(_QUOTED.sub('""', attributes)))


class Node:
    __slots__ = ("tag", "parent", "features", "label", "parts", "words", "linked", "ends")

    def __init__(self, tag: str, parent: int, attributes: str):
        self.tag, self.parent, self.label = tag, parent, None
        self.features = ["tag=" + TAGS.get(tag, "other")]
        self.words = self.linked = self.ends = 0
        if attributes:
            found = {k.lower(): a or b or c or "" for k, a, b, c in _ATTRIBUTE.findall(attributes)}
            named = " ".join(found.get(k, "") for k in ("class", "id", "role")).lower()
            tokens = set(_TOKEN.findall(named))
            if tokens & BAD_WORDS:
                self.features += ["bad", "bad " + self.features[0]]
            if tokens & GOOD_WORDS:
                self.features.append("good")
            if _is_hidden(attributes, found):
                self.features.append("hidden")
            if "data-y" in found:
                self.label = int(found["data-y"])


def parse(page: str) -> tuple[list[Node], list[tuple[int, str]]]:
    """The elements of a page, parents first, and its text blocks as (element, text) in page order."""
    nodes = [Node("html", -1, ""), Node("body", 0, "")]
    stack, blocks, buffer, link, lower = [0, 1], [], [], 0, None
    at, size = 0, len(page)

    def text(piece: str) -> None:
        buffer.append(piece)
        if link:
            nodes[stack[-1]].linked += len(piece.split())

    def flush() -> None:
        if buffer:
            own = " ".join(entities.unescape("".join(buffer)).split())
            buffer.clear()
            if own:
                node = nodes[stack[-1]]
                node.words += own.count(" ") + 1
                node.ends += own.endswith((".", "!", "?", ":", "…", "。", '"', "”"))
                blocks.append((stack[-1], own))

    def close(tags, stop=BOUNDS) -> None:
        """Close the innermost open element of ``tags`` that stands inside the nearest ``stop``."""
        for k in range(len(stack) - 1, 1, -1):
            tag = nodes[stack[k]].tag
            if tag in tags:
                flush()
                del stack[k:]
                return
            if tag in stop:
                return

    while at < size:
        found = _TAG.search(page, at)
        if not found:
            text(page[at:])
            break
        if found.start() > at:
            text(page[at : found.start()])
        at = found.end()
        if found[1]:
            end = page.find("-->", found.start() + 4 - 2 * page.startswith("<!-->", found.start()))
            at = size if end < 0 else end + 3
            continue
        if not found[3]:
            continue
        tag, attributes = found[3].lower(), found[4]
        if found[2]:
            if tag == "a":
                link = max(0, link - 1)
            elif _is_block(tag):
                close((tag,), stop=frozenset(("td", "th", "table")) if tag in ("p", "div", "section") else frozenset())
            continue
        if tag in RAW:
            lower = lower or page.lower()
            end = lower.find(f"</{tag}", at)
            if end < 0:
                at = size
            else:
                end = page.find(">", end)
                at = size if end < 0 else end + 1
            continue
        if not _is_block(tag):
            if tag == "br":
                text(" ")
            elif tag == "a":
                link += 1
            continue
        if tag in CLOSES_P:
            close(("p",), stop=BOUNDS | {"td", "th", "button", "caption"})
        if tag in SIBLINGS:
            close(SIBLINGS[tag])
        flush()
        if tag in ("html", "head", "body"):
            continue
        link = 0
        nodes.append(Node(tag, stack[-1], attributes))
        if tag not in VOID:
            stack.append(len(nodes) - 1)
    flush()
    for node in nodes:
        n = node.words
        node.features.append("words=" + str(min(5, (n > 0) + (n > 3) + (n > 10) + (n > 25) + (n > 60))))
        if n:
            share = node.linked / n
            node.features.append("linked=" + str((share > 0.2) + (share > 0.7)))
            node.features.append("ends=" + str(min(1, node.ends)))
        if node.parent >= 0:
            node.features.append(node.features[0] + ">" + TAGS.get(nodes[node.parent].tag, "other"))
    return nodes, blocks


class Model:
    """Feature weights, a bias, and log potentials of (parent's label, child's label)."""

    def __init__(self):
        self.weights: dict[str, float] = {"bias": -0.5}
        self.pair = [[0.5, -0.5], [-0.5, 0.5]]

    def evidence(self, nodes: list[Node]) -> list[float]:
        w = self.weights
        return [w["bias"] + sum([w.get(f, 0.0) for f in n.features]) for n in nodes]

    def marginals(self, nodes: list[Node]) -> tuple[list[float], list[tuple[float, float, float, float]]]:
        """Marginal of content for each node, and of (parent, child) labels 00, 01, 10, 11 for each but the first.

        All messages are log odds.  Parents precede children, so one pass back
        and one pass forth over the nodes is the whole schedule.
        """
        (p00, p01), (p10, p11) = ([math.exp(x) for x in row] for row in self.pair)
        up = self.evidence(nodes)
        sent = [0.0] * len(nodes)
        for i in range(len(nodes) - 1, 0, -1):
            odds = math.exp(min(50.0, max(-50.0, up[i])))
            sent[i] = math.log((p11 * odds + p10) / (p01 * odds + p00))
            up[nodes[i].parent] += sent[i]
        belief = up[:]
        pairs = [(0.0, 0.0, 0.0, 0.0)] * len(nodes)
        for i in range(1, len(nodes)):
            from_parent = math.exp(min(50.0, max(-50.0, belief[nodes[i].parent] - sent[i])))
            own = math.exp(min(50.0, max(-50.0, up[i])))
            a, b, c, d = p00, p01 * own, p10 * from_parent, p11 * from_parent * own
            total = a + b + c + d
            pairs[i] = (a / total, b / total, c / total, d / total)
            belief[i] = math.log((b + d) / (a + c))
        return [1 / (1 + math.exp(-min(50.0, max(-50.0, x)))) for x in belief], pairs


def train(pages: list[str], epochs: int = EPOCHS) -> Model:
    """Likelihood ascent (AdaGrad) on pages whose elements carry ``data-y``; elements without it are labelled 0."""
    model, squares = Model(), {}
    parsed = [parse(p)[0] for p in pages]

    def move(key, gradient: float, get, put) -> None:
        squares[key] = squares.get(key, 1e-6) + gradient * gradient
        put(get() + 0.5 * gradient / math.sqrt(squares[key]))

    for _ in range(epochs):
        for nodes in parsed:
            odds, pairs = model.marginals(nodes)
            change: dict[str, float] = {}
            for i, node in enumerate(nodes):
                miss = (node.label or 0) - odds[i]
                if abs(miss) > 1e-4:
                    for f in (*node.features, "bias"):
                        change[f] = change.get(f, 0.0) + miss
            for f, g in change.items():
                g -= 0.002 * model.weights.get(f, 0.0)
                move(f, g, lambda f=f: model.weights.get(f, 0.0), lambda v, f=f: model.weights.__setitem__(f, v))
            for y in (0, 1):
                for z in (0, 1):
                    g = sum((nodes[i].label or 0) == z and (nodes[nodes[i].parent].label or 0) == y for i in range(1, len(nodes)))
                    g -= sum(pairs[i][2 * y + z] for i in range(1, len(nodes)))
                    g -= 0.002 * model.pair[y][z]
                    move((y, z), g, lambda y=y, z=z: model.pair[y][z], lambda v, y=y, z=z: model.pair[y].__setitem__(z, v))
    return model


def labelled_pages(n: int = N_LABELLED, seed: int = 7, misnamed: float = 0.05) -> list[str]:
    """Small pages in many layouts; ``data-y`` is 1 on the elements of the article and 0 elsewhere.

    Names are weak evidence: a share ``misnamed`` of all elements has one of the other kind."""
    rng = random.Random(seed)
    word = lambda: "".join(rng.choices("aeioulnrstdm", k=rng.randint(2, 9)))
    words = lambda a, b: " ".join(word() for _ in range(rng.randint(a, b)))
    pick = rng.choice

    def el(tag: str, y: int, inner: str, name: str = "") -> str:
        if rng.random() < misnamed:
            name = pick(sorted(BAD_WORDS if y else GOOD_WORDS))
        named = f' {pick(("class", "id"))}="{name}"' if name else ""
        return f"<{tag}{named} data-y={y}>{inner}</{tag}>"

    def sentences(a: int, b: int) -> str:
        return " ".join(words(3, 14).capitalize() + pick((".", ".", ".", "!", "?")) for _ in range(rng.randint(a, b)))

    def links(y: int, tag: str = "ul") -> str:
        return el(tag, y, "".join(el("li", y, f'<a href="/{word()}">{words(1, 4)}</a>') for _ in range(rng.randint(2, 7))))

    def boiler() -> str:
        kind = rng.randrange(14)
        if kind == 13:
            inner = pick((sentences(1, 4), el("p", 0, sentences(1, 4))))
            return f"<{pick(('div', 'p', 'section'))} {pick(('hidden', 'aria-hidden=true', 'style=display:none'))} data-y=0>{inner}</div>"
        if kind == 0:
            return el("nav", 0, links(0), pick(("", "menu", "navbar")))
        if kind == 1:
            return el("header", 0, el(pick(("div", "p", "h1")), 0, words(1, 5)) + (links(0) if rng.random() < 0.5 else ""), pick(("", "masthead")))
        if kind == 2:
            return el("aside", 0, el("h3", 0, words(1, 3)) + pick((links(0), el("p", 0, sentences(1, 4)))), pick(("", "sidebar", "widget")))
        if kind == 3:
            return el("div", 0, pick((words(3, 12), sentences(1, 3), el("p", 0, sentences(1, 4)))), pick(("ad", "ads", "advert", "promo banner", "sponsored", "ad-slot")))
        if kind == 4:
            return el("div", 0, pick((sentences(1, 2), el("p", 0, sentences(1, 2)))) + el("button", 0, word()), pick(("cookie-notice", "notice", "consent", "newsletter signup", "popup")))
        if kind == 5:
            return el("form", 0, f"<label>{words(1, 3)}</label><input name=q>" + el("p", 0, sentences(1, 2)), pick(("", "search", "login")))
        if kind in (6, 7):
            one = lambda: el(pick(("div", "li", "article")), 0, el("p", 0, sentences(1, 5)), pick(("comment", "comment-body", "reply")))
            return el(pick(("section", "div", "ol")), 0, el("h2", 0, words(1, 3)) + "".join(one() for _ in range(rng.randint(1, 4))), "comments")
        if kind == 8:
            return el("div", 0, el("h3", 0, words(1, 3)) + links(0), pick(("related", "recommended links", "share social", "tags")))
        if kind == 9:
            return el("div", 0, links(0), pick(("breadcrumb", "menu", "toc", "pagination")))
        if kind == 10:
            return el("div", 0, el("div", 0, pick((sentences(1, 3), links(0)))) + el("p", 0, sentences(1, 3)), pick(("sidebar", "widget", "footer")))
        return el("footer", 0, pick((f"&copy; {words(2, 8)}.", el("p", 0, sentences(1, 3)), el("div", 0, words(1, 9)) + links(0))), pick(("", "footer")))

    def content() -> str:
        out = [el("h1", 1, words(2, 9))] if rng.random() < 0.8 else []
        if out and rng.random() < 0.2:
            out = [el("header", 1, out[0])]
        for _ in range(rng.randint(1, 8)):
            kind = rng.random()
            if kind < 0.6:
                out.append(el("p", 1, sentences(1, 6) if rng.random() < 0.8 else words(1, 3).capitalize() + pick((".", ""))))
            elif kind < 0.67:
                out.append(el(pick(("h2", "h3")), 1, words(1, 6)))
            elif kind < 0.73:
                out.append(el(pick(("ul", "ol")), 1, "".join(el("li", 1, words(2, 12)) for _ in range(rng.randint(2, 5)))))
            elif kind < 0.77:
                out.append(el(pick(("blockquote", "pre")), 1, sentences(1, 2)))
            elif kind < 0.8:
                out.append(el("table", 1, "".join(el("tr", 1, el("td", 1, words(1, 3)) + el("td", 1, words(1, 3))) for _ in range(3))))
            elif kind < 0.84:
                out.append(el(pick(("section", "div")), 1, el("p", 1, sentences(1, 4))))
            elif kind < 0.89:
                out.append(el("div", 1, sentences(1, 5)))
            else:
                out.append(boiler())
        return "".join(out)

    pages = []
    for _ in range(n):
        body = content()
        shape = rng.randrange(8)
        if shape <= 2:
            body = el(pick(("article", "main", "article")), 1, body, pick(("", "", "post", "content")))
        elif shape == 3:
            body = el("main", 1, el("article", 1, body))
        elif shape == 4:
            body = el("div", 1, body, pick(("content", "main", "article-body", "post entry", "story")))
        elif shape == 5:
            body = el("div", 1, el("div", 1, body, pick(("content", "text"))), pick(("", "main")))
        elif shape == 6:
            body = el(pick(("div", "section")), 1, body, pick(("", "main", "content", "text")))
        before = "".join(boiler() for _ in range(rng.randint(0, 4)))
        after = "".join(boiler() for _ in range(rng.randint(0, 4)))
        whole = body if rng.random() < 0.15 else before + body + after
        if rng.random() < 0.3:
            whole = f"<div data-y=0 class={pick(('wrapper', 'page', 'container'))}>{whole}</div>"
        pages.append(f"<html><head><title>{words(1, 5)}</title></head><body>{whole}</body></html>")
    return pages


@cache
def default_model() -> Model:
    return train(labelled_pages())


def main_blocks(page: str | None, model: Model) -> list[str]:
    """The text blocks of a page's main text, in page order."""
    if not page:
        return []
    nodes, blocks = parse(page)
    odds, _ = model.marginals(nodes)
    return [own for i, own in blocks if odds[i] > 0.5]


def extract(pages: DataFrame, model: Model | None = None) -> DataFrame:
    """(page_id, url, text, n_chars, n_blocks) of every page."""
    model = model or default_model()

    def run(batches):
        for batch in batches:
            for i in range(0, batch.num_rows, 500):
                part = batch.slice(i, 500)
                blocks = [main_blocks(page, model) for page in part.column(2).to_pylist()]
                texts = ["\n\n".join(b) for b in blocks]
                yield pa.RecordBatch.from_arrays(
                    [part.column(0).cast(pa.int64()), part.column(1).cast(pa.string()), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64()), pa.array([len(b) for b in blocks], pa.int64())],
                    names=["page_id", "url", "text", "n_chars", "n_blocks"],
                )

    return pages.select("page_id", "url", "html").mapInArrow(run, "page_id bigint, url string, text string, n_chars bigint, n_blocks bigint")


def op2_html_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extract(spark.read.parquet(f"{sf_dir}/pages.parquet"))
