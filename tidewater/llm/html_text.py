"""HTML extraction by a tree-structured graphical model.

The DOM is the graph: each element and each piece of text is a node that is content or not.
A node's own potential comes from its tag, the words of its class and id, and, for text,
the length of its block and how much of that is linked; a potential on every edge links a child to
its parent. Sum-product messages, once upward and once downward, give every node's
exact marginal. Both kinds of potential are counted from labelled pages: by default some
hundreds that ``labelled_pages`` lays out in many styles and labels as it writes them.

Text whose marginal is at least one half is content. White space in a block becomes one
space, blocks stand in page order with a line break between.

Defined results: a null or empty page has an empty text; markup that is cut off or not closed
is read as far as it goes, a head ends where a page's body must have begun, controls end at a block; a page of plain text is all content; repeated rows give equal
texts; an empty table gives an empty result; other columns of the input are not read.
"""

from __future__ import annotations

import math
import random
import re
from collections import defaultdict
from collections.abc import Iterator
from dataclasses import dataclass
from html import unescape

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidewater.llm._tasks import in_arrow

#: Elements whose text is never shown, and such as hold controls.
HIDDEN = frozenset("script style template noscript head title iframe object svg math canvas textarea select option datalist button input audio video map".split())
#: Of these, what is inside is no markup.
RAW = frozenset("script style textarea title iframe noscript xmp noembed noframes".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
BLOCK = frozenset("address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr html legend li main menu nav ol p pre section summary table tbody td tfoot th thead tr ul".split())
#: What may stand in a head; anything else ends it.
IN_HEAD = frozenset("base basefont bgsound link meta noscript script style template title".split())
#: Controls that a block ends.
CONTROLS = ("select", "datalist", "button", "option")
#: What an opening tag closes, if it is open within the nearest of ``SCOPE``.
CLOSES = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "tbody": {"tbody", "thead", "tr", "td", "th"}, "option": {"option"}}
SCOPE = frozenset("ul ol dl table html body div section article main aside nav header footer form".split())

#: A quote opens a string only after an equals sign.
MARKUP = re.compile(r"<!--.*?(?:-->|$)|<!\[CDATA\[.*?(?:\]\]>|$)|<[!?][^>]*(?:>|$)|<(/?)([A-Za-z][^\s/>]*)((?:=\s*+(?:\"[^\"]*(?:\"|$)|'[^']*(?:'|$))?|[^>=])*+)(?:>|$)", re.S)
NAMED = re.compile(r"\b(class|id|role)\s*=\s*(?:\"([^\"]*)|'([^']*)|([^\s>]+))", re.I)
ENDS = {t: re.compile(f"</{t}\\s*>", re.I) for t in RAW}
SPACE = re.compile(r"\s+")
PART = re.compile(r"[A-Z]?[a-z]+|[A-Z]+")


class Node:
    __slots__ = ("block", "children", "features", "linked", "parent", "tag", "text")

    def __init__(self, tag: str, parent: Node | None, features: list[str], text: str = "", block: int = 0):
        self.tag, self.parent, self.features, self.text, self.block = tag, parent, features, text, block
        self.children: list[Node] = []
        self.linked = tag == "a" or parent is not None and parent.linked
        if parent is not None:
            parent.children.append(self)


def parse(page: str) -> list[Node]:
    """All nodes, each after its parent and in page order; hidden parts are left out. Text nodes have the tag ``#``."""
    root = Node("#root", None, [])
    nodes, at, top, block = [root], 0, root, 0
    end = len(page)
    open_: dict[str, list[Node]] = defaultdict(list)  # open elements of each tag, the innermost last
    depth, scopes = {id(root): 0}, [0]  # how deep each open element stands, and those of SCOPE

    def say(a: int, z: int) -> None:
        text = page[a:z]
        if text and not text.isspace():
            if open_["head"] and top is open_["head"][-1]:
                close(top.parent)
            text = unescape(text) if "&" in text else text
            nodes.append(Node("#", top, [], text, block))
        elif text:
            nodes.append(Node("# ", top, [], " ", block))

    def close(to: Node) -> None:
        nonlocal top, block
        x = top
        while x is not to:
            if x.tag in BLOCK:
                block += 1
            if x.tag in SCOPE:
                scopes.pop()
            open_[x.tag].pop()
            del depth[id(x)]
            x = x.parent
        top = to

    def within(tag: str) -> list[Node]:
        """Open elements of the tag inside the nearest scope."""
        found, k = open_[tag], len(open_[tag])
        while k and depth[id(found[k - 1])] > scopes[-1]:
            k -= 1
        return found[k:]

    while at < end:
        m = MARKUP.search(page, at)
        if m is None:
            say(at, end)
            break
        say(at, m.start())
        at = m.end()
        tag = m[2]
        if tag is None:
            if m[0].startswith("<![CDATA["):
                say(m.start() + 9, m.end() - 3 * m[0].endswith("]]>"))
            continue
        tag = tag.lower()
        if m[1]:
            if open_[tag]:
                close(open_[tag][-1].parent)
            if tag in BLOCK:
                block += 1
            continue
        if open_["head"] and tag not in IN_HEAD:
            close(open_["head"][-1].parent)
        if tag in RAW:
            z = ENDS[tag].search(page, at)
            at = z.end() if z else end
            continue
        if tag == "br":
            nodes.append(Node("# ", top, [], " ", block))
            continue
        closes = CLOSES.get(tag, ())
        if tag in BLOCK:
            block += 1
            for t in CONTROLS:
                if open_[t]:
                    close(open_[t][0].parent)
            inner = [x[-1] for t in ("p", *closes) if (x := within(t))]
            if inner:
                close(max(inner, key=lambda x: depth[id(x)]).parent)
        outer = [x[0] for t in closes if (x := within(t))]
        if outer:
            close(min(outer, key=lambda x: depth[id(x)]).parent)
        if tag in VOID:
            continue
        made = Node(tag, top, _named(tag, m[3]))
        nodes.append(made)
        if not m[3].endswith("/") or tag in BLOCK:
            depth[id(made)] = depth[id(top)] + 1
            open_[tag].append(made)
            if tag in SCOPE:
                scopes.append(depth[id(made)])
            top = made
    return _measured(_shown(nodes))


def _measured(nodes: list[Node]) -> list[Node]:
    """Gives the first text of each block the block's features: its length, and how much of it is linked."""
    first: dict[int, Node] = {}
    size: dict[int, list[int]] = {}
    for x in nodes:
        if x.tag == "#":
            first.setdefault(x.block, x)
            n = size.setdefault(x.block, [0, 0])
            n[0] += len(x.text)
            n[1] += len(x.text) * x.linked
    for b, x in first.items():
        n, linked = size[b]
        x.features = [f"length:{min(6, n.bit_length() // 2)}", "links:all" if linked > 0.8 * n else "links:some" if linked else "links:none"]
    return nodes


def _shown(nodes: list[Node]) -> list[Node]:
    hidden: set[int] = set()
    out = []
    for x in nodes:
        if x.tag in HIDDEN or x.parent is not None and id(x.parent) in hidden:
            hidden.add(id(x))
        else:
            out.append(x)
    return out


def _named(tag: str, rest: str) -> list[str]:
    """An element's features: its tag, and the words in its class, id and role."""
    out = [f"tag:{tag}"] if tag in BLOCK else []
    if "=" in rest:
        for m in NAMED.finditer(rest):
            out += [f"name:{x.lower()}" for x in PART.findall(m[2] or m[3] or m[4] or "")]
    return out


@dataclass(frozen=True)
class Model:
    """``own``: (not content, content) log potentials by feature; ``first``: of the root; ``edges``: log potentials by
    parent's and child's state, for each kind of edge: to a block in the page, to a block in a part of it, and in a line."""

    own: dict[str, tuple[float, float]]
    edges: tuple[tuple[tuple[float, float], tuple[float, float]], ...]
    first: tuple[float, float]


def kind(node: Node) -> int:
    """The kind of edge from a node to its parent."""
    return 2 if node.tag not in BLOCK else 0 if node.parent is None or node.parent.tag in ("#root", "html", "body", "main") else 1


def marginals(nodes: list[Node], model: Model) -> list[float]:
    """The probability of each node to be content: exact, by messages up the tree and down again."""
    place = {id(x): i for i, x in enumerate(nodes)}
    up0, up1 = [0.0] * len(nodes), [0.0] * len(nodes)
    edges = [tuple(math.exp(x) for row in e for x in row) for e in model.edges]
    edges = [edges[kind(x)] for x in nodes]
    for i, x in enumerate(nodes):
        for f in x.features:
            a, b = model.own.get(f, (0.0, 0.0))
            up0[i] += a
            up1[i] += b
    up0[0] += model.first[0]
    up1[0] += model.first[1]
    sent: list[tuple[float, float]] = [(0.0, 0.0)] * len(nodes)
    for i in range(len(nodes) - 1, 0, -1):
        e00, e01, e10, e11 = edges[i]
        high = max(up0[i], up1[i])
        a, b = math.exp(up0[i] - high), math.exp(up1[i] - high)
        sent[i] = math.log(e00 * a + e01 * b) + high, math.log(e10 * a + e11 * b) + high
        j = place[id(nodes[i].parent)]
        up0[j] += sent[i][0]
        up1[j] += sent[i][1]
    # From here up0 and up1 take in what comes from above too, and so are the nodes' beliefs.
    for i in range(1, len(nodes)):
        j = place[id(nodes[i].parent)]
        e00, e01, e10, e11 = edges[i]
        p0, p1 = up0[j] - sent[i][0], up1[j] - sent[i][1]
        high = max(p0, p1)
        a, b = math.exp(p0 - high), math.exp(p1 - high)
        up0[i] += math.log(a * e00 + b * e10) + high
        up1[i] += math.log(a * e01 + b * e11) + high
    return [1 / (1 + math.exp(max(-700.0, min(700.0, a - b)))) for a, b in zip(up0, up1, strict=True)]


#: What these hold is no article, whatever else may seem so.
ASIDE = frozenset("nav header footer aside form".split())


def plausible(nodes: list[Node], model: Model) -> list[bool]:
    """Text that may be an article where no marginal says that any is: not linked, in no part for something else by
    its tag, nor, outside an article's own element, by its names. So one name alone does not empty a page, nor does its being short."""
    out: list[bool] = []
    state: dict[int, tuple[bool, bool]] = {}  # in an article's element; possible so far
    for x in nodes:
        inside, possible = state[id(x.parent)] if x.parent is not None else (False, True)
        names = sum(b - a for a, b in (model.own.get(f, (0.0, 0.0)) for f in x.features if f.startswith("name:")))
        inside = inside or x.tag in ("main", "article")
        possible = possible and x.tag not in ASIDE and (inside or names > -1)
        state[id(x)] = inside, possible
        out.append(possible and not x.linked)
    return out


def text_of(page: str | None, model: Model) -> str:
    """The main text of a page."""
    if not page:
        return ""
    nodes = parse(page)
    good = [p >= 0.5 for p in marginals(nodes, model)]
    if not any(y for x, y in zip(nodes, good, strict=True) if x.tag == "#"):
        good = plausible(nodes, model)
    blocks: list[tuple[int, list[str]]] = []
    for x, y in zip(nodes, good, strict=True):
        if x.tag == "#" and y or x.tag == "# " and blocks and blocks[-1][0] == x.block:
            if not blocks or blocks[-1][0] != x.block:
                blocks.append((x.block, []))
            blocks[-1][1].append(x.text)
    lines = (SPACE.sub(" ", "".join(b)).strip() for _, b in blocks)
    return "\n".join(x for x in lines if x)


def extract(pages: DataFrame, model: Model, html_col: str = "html", key_cols: tuple[str, ...] = ("page_id", "url")) -> DataFrame:
    """``key_cols`` and ``text`` of every page."""
    model_b = pages.sparkSession.sparkContext.broadcast(model)
    schema = pages.select(*key_cols).schema.add("text", "string", False)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = model_b.value
        for b in batches:
            for a in range(0, b.num_rows, 500):
                part = b.slice(a, 500)
                out = [text_of(x, model) for x in part.column(0).to_pylist()]
                yield pa.RecordBatch.from_arrays([*part.columns[1:], pa.array(out, pa.string())], schema.names)

    return in_arrow(pages.select(F.col(html_col), *key_cols), run, schema)


def fit(pages: list[tuple[str, list[bool]]] | None = None, smoothing: float = 0.5) -> Model:
    """Potentials from labelled pages: (html, the label of each text node in page order); an element is content if it holds any."""
    own: dict[str, list[float]] = {}
    edges = [[[smoothing, smoothing], [smoothing, smoothing]] for _ in range(3)]
    total = {k: [1.0, 1.0] for k in ("tag", "name", "length", "links")}  # of each kind of feature, by label
    for page, labels in pages or labelled_pages():
        nodes, given = parse(page), iter(labels)
        good = {id(x): next(given) for x in nodes if x.tag == "#"}
        for x in reversed(nodes):
            if good.setdefault(id(x), False) and x.parent is not None:
                good[id(x.parent)] = True
        for x in nodes:
            y = good[id(x)]
            if x.parent is not None and x.tag != "# ":
                edges[kind(x)][good[id(x.parent)]][y] += 1
            for f in x.features:
                own.setdefault(f, [smoothing, smoothing])[y] += 1
                total[f.partition(":")[0]][y] += 1
    of = lambda f: total[f.partition(":")[0]]
    logs = {f: (math.log(a / of(f)[0]), math.log(b / of(f)[1])) for f, (a, b) in own.items() if a + b > 3}
    rows = tuple(tuple(tuple(math.log(x / sum(row)) for x in row) for row in e) for e in edges)
    return Model(logs, rows, (math.log(0.1), math.log(0.9)))


def labelled_pages(n: int = 400, seed: int = 17) -> list[tuple[str, list[bool]]]:
    """Pages in many styles, with the label of each text node."""
    r = random.Random(seed)
    pick = r.choice
    word = lambda: "".join(pick(["ra", "to", "mel", "in", "sor", "e", "li", "an", "ku", "ver"]) for _ in range(r.randint(1, 4)))
    say = lambda a, b: " ".join(word() for _ in range(r.randint(a, b))).capitalize() + pick([".", ".", "", "!"])
    out = []
    for _ in range(n):
        parts: list[tuple[str, bool | None]] = []
        add = lambda text, label=None: parts.append((text, label))  # noqa: E731,B023

        def links(k: int) -> None:
            add("<ul>")
            for _ in range(k):
                add(f'<li><a href="/{word()}">')
                add(say(1, 3), False)
                add("</a></li>")
            add("</ul>")

        def wrapped(tag: str, names: str, fill) -> None:
            name = pick(names.split())
            add(f"<{tag} {pick(['class', 'id'])}=\"{name}{pick(['', '', '-' + word(), ' ' + word()])}\">" if name != "-" else f"<{tag}>")
            fill()
            add(f"</{tag}>")

        def small(a: int = 2, b: int = 25) -> None:
            for _ in range(r.randint(1, 3)):
                tag = pick(["p", "div", "span", "", "h3"])
                add(f"<{tag}>" if tag else "")
                add(say(a, b), False)
                if r.random() < 0.3:
                    add("<a href='#'>")
                    add(say(1, 3), False)
                    add("</a>")
                add(f"</{tag}>" if tag else " <i></i>")

        def long() -> None:
            small(5, 60)

        noise = [
            lambda: wrapped("nav", "- nav menu main-nav navbar breadcrumb", lambda: links(r.randint(3, 9))),
            lambda: wrapped("div", "nav menu navigation topmenu breadcrumbs pagination", lambda: links(r.randint(3, 9))),
            lambda: wrapped("header", "- header site-header top masthead", small),
            lambda: wrapped("div", "header banner top-bar masthead site-header", small),
            lambda: wrapped("aside", "- sidebar aside related", lambda: (links(r.randint(2, 5)) if r.random() < 0.5 else long())),
            lambda: wrapped("div", "sidebar side widget related recommended popular tags share social", lambda: (links(r.randint(2, 5)) if r.random() < 0.5 else long())),
            lambda: wrapped("div", "ad ads advert advertisement sponsored promo banner-ad sponsor", long),
            lambda: wrapped("div", "cookie cookie-notice notice consent gdpr newsletter subscribe popup modal alert disclaimer", long),
            lambda: wrapped("section", "comments comment discussion replies responses", long),
            lambda: wrapped("div", "comments comment comment-list reply respond", long),
            lambda: wrapped("form", "- search login form signup", small),
        ]
        foot = [lambda: wrapped("footer", "- footer site-footer", long), lambda: wrapped("div", "footer bottom copyright foot legal", long)]

        def body() -> None:
            if r.random() < 0.8:
                tag = pick(["h1", "h2"])
                add(f"<{tag}>")
                add(say(2, 12), True)
                add(f"</{tag}>")
            for _ in range(r.randint(1, 14)):
                kind = r.random()  # of the next block
                if kind < 0.14:
                    add("<ul>")
                    for _ in range(r.randint(1, 4)):
                        add("<li>")
                        add(say(1, 20), True)
                        add("</li>")
                    add("</ul>")
                elif kind < 0.18:
                    add(f'<p><a href="/{word()}">')
                    add(say(1, 9), True)
                    add("</a></p>")
                elif kind < 0.26:
                    tag = pick(["h2", "h3", "blockquote", "pre", "td", "figcaption"])
                    add(f"<{tag}>" if tag != "td" else "<table><tr><td>")
                    add(say(1, 12), True)
                    add(f"</{tag}>" if tag != "td" else "</td></tr></table>")
                else:
                    add(pick(["<p>", "<p>", "<p>", "<div>", "<p><b>"]))
                    add(say(1, pick([3, 20, 120, 300])), True)
                    for _ in range(pick([0, 0, 0, 1, 1, 2, 5])):
                        tag = pick(["a", "a", "b", "em", "i", "span", "code"])
                        add(f'<{tag} href="/{word()}">' if tag == "a" else f"<{tag}>")
                        add(say(1, 4), True)
                        add(f"</{tag}>")
                        add(say(1, 20), True)
                    add("</p>" if r.random() < 0.9 else "<br>")
                if r.random() < 0.06:
                    pick(noise[4:])()

        for f in r.sample(noise, r.randint(1, 5)):
            f()
        outer = r.random() < 0.4
        if outer:
            add(pick(['<div class="container">', '<div id="wrapper">', "<main>", '<div id="page">', "<div>"]))
        if r.random() < 0.9:
            tag = pick(["article", "article", "article", "main", "section", "div"])
            name = pick(["", ' class="content"', ' class="post"', ' id="content"', ' class="article-body"', ' class="entry"', ' class="story"']) if tag in ("article", "main") else pick([' class="content"', ' class="post-content"', ' id="main"', ' class="article"', ' class="entry-content"', ' class="story-body"', ' class="text"'])
            add(f"<{tag}{name}>")
            body()
            add(f"</{tag}>" if r.random() < 0.95 else "")
        else:
            body()
        for f in r.sample(noise[4:], r.randint(0, 3)):
            f()
        if outer:
            add(pick(["</div>", "</main>", ""]))
        pick(foot)()
        page = "".join(t for t, _ in parts)
        out.append((f"<!DOCTYPE html><html><head><title>{word()}</title></head><body>{page}</body></html>", [y for t, y in parts if y is not None and t.strip()]))
    return out
