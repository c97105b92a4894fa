"""Main text of web pages by wrapper induction.

A page is parsed into a tree of its block elements.  Its skeleton is that tree without texts, like siblings put
together.  The distinct skeletons of a host are aligned by simple tree matching into one wrapper.  A block of text that
all of the host's pages with its node of the wrapper have there is template; the other blocks vary.  Content are the
varying blocks of the article (of the body, on pages without one) outside menus, headers, footers, sidebars, notices,
adverts, forms and reader comments, which are known by their elements and by whole tokens of their class, id or role.

A token names such a thing by its last word (``site-footer``, ``cookie-notice``), general words and numbers at its end
aside (``comments-area``, ``ad-slot-2``).  It does not where the word describes a layout (``has-sidebar``,
``content-sidebar-wrap``) or the article's own header (``article-header``; ``header`` inside an article).  What holds all of
a page's articles is never outside, whatever its tokens, so a page's body or layout may be named after its sidebar; an
article may be an advert by a token of its own.

How: pages are parsed once and stored as blocks with their skeleton's number of the node and a 64-bit hash of the text;
only distinct skeletons meet in a task, at most about ``VARIANTS``; a host with more page structures gets several
wrappers, which are aligned in turn until it has one.  How many different pages have a block at a node of that one is an
aggregate; roles and template blocks go back to the pages by an equality join.

Defined cases: NULL or empty html gives the empty text; text without any element is content; broken markup is read as far
as it goes (an open comment, script or style hides the rest); a text counts as constant from ``DISTINCT`` different pages
on, so a host with fewer goes by elements alone; NULL urls share one host; pages that repeat are separate rows; elements
deeper than ``DEPTH`` belong to their ancestor there; other columns are ignored.
"""

from __future__ import annotations

import html as entities
import re
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import small_enough, stored
from .words import span_hashes

VARIANTS = 256
DISTINCT = 3
DEPTH = 64
BROADCAST_BYTES = 32 << 20

#: Fixed values of HTML: elements without content, inside a line, and with text that is no markup.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
INLINE = frozenset("a abbr acronym b bdi bdo big br cite code data del dfn em font i img ins kbd label mark q rp rt ruby s samp small span strike strong "
                   "sub sup time tt u var wbr".split())
RAW = frozenset("script style".split())
#: Elements that end an open paragraph, and elements that end their own kind.
FLOW = frozenset("p h1 h2 h3 h4 h5 h6 ul ol li dl dt dd table thead tbody tr td th blockquote pre hr".split())
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
SELF_ENDING = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"}}
SCOPE = {"li": {"ul", "ol"}, "dt": {"dl"}, "dd": {"dl"}, "tr": {"table"}, "td": {"table"}, "th": {"table"}, "option": {"select"}}
#: What is no main text: elements, and words in a class or id.
OUTSIDE = frozenset("head nav header footer aside form script style noscript iframe template button select textarea dialog menu svg object".split())
OUTSIDE_WORDS = frozenset("ad ads adv advert adverts advertisement sponsor sponsored promo banner cookie cookies consent notice notices alert menu nav navbar "
                          "navigation breadcrumb breadcrumbs sidebar aside masthead header footer comment comments disqus respond replies share social related "
                          "recommended newsletter subscribe signup login popup modal pagination pager widget toolbar skip".split())
MAIN = frozenset("article main".split())
#: Words of a token that say nothing of what it names, that say it describes a state, and that make a header the article's.
GENERAL = frozenset("area areas list wrap wrapper container box bar block blocks section left right top bottom slot unit inner outer holder group row col zone region".split())
STATES = frozenset("has with no show hide is without".split())
OF_ARTICLE = frozenset("article post entry content story news blog main body text".split())

_TOKEN = re.compile(r"""<!--.*?(?:-->|\Z)|<!\[CDATA\[(?P<cdata>.*?)(?:\]\]>|\Z)|<[!?][^>]*>|<(?P<end>/?)(?P<tag>[a-zA-Z][^\s/>]*)(?P<attrs>(?:[^>"']|"[^"]*"|'[^']*')*)>""", re.S)
_ATTR = re.compile(r"""\b(class|id|role)\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+))""", re.I)
_SPACE = re.compile(r"\s+")
_WORDS = re.compile(r"[a-z0-9]+")


@lru_cache(maxsize=1 << 16)
def names_outside(token: str) -> str:
    """The word by which a token of a class, id or role names something that is no main text, or nothing."""
    words = _WORDS.findall(token)
    if not words or words[0] in STATES:
        return ""
    while len(words) > 1 and (words[-1] in GENERAL or words[-1].isdigit()):
        words.pop()
    last = words[-1]
    if last not in OUTSIDE_WORDS or last in ("header", "sidebar", "aside") and not OF_ARTICLE.isdisjoint(words[:-1]):
        return ""
    return last


class Node:
    __slots__ = ("label", "children", "number", "by_label")

    def __init__(self, label: str):
        self.label, self.children, self.number, self.by_label = label, [], 0, {}

    def child(self, label: str) -> Node:
        """The child a new element belongs to: the last one if it is alike, any alike one for flow elements."""
        if label.split(".", 1)[0] in FLOW and label in self.by_label:
            return self.by_label[label]
        if self.children and self.children[-1].label == label:
            return self.children[-1]
        node = Node(label)
        self.children.append(node)
        self.by_label[label] = node
        return node


def _label(tag: str, attrs: str) -> str:
    if not attrs:
        return tag
    tokens = set()
    for m in _ATTR.finditer(attrs):
        found = {"-".join(_WORDS.findall(t)) for t in next(filter(None, m.groups()[1:]), "").lower().split()} - {""}
        # ids of flow elements number them, those of headings repeat their text
        if tag in FLOW and m[1].lower() == "id":
            found = set() if tag in HEADINGS else set(filter(names_outside, found))
        tokens |= found
    return ".".join([tag, *sorted(tokens)])


def _is_main(label: str) -> bool:
    """An article, unless a token that is one word makes it something else."""
    tag, *tokens = label.split(".")
    return tag in MAIN and not any(t in OUTSIDE_WORDS and t != "header" for t in tokens)


def _is_outside(label: str, in_article: bool) -> bool:
    tag, *tokens = label.split(".")
    if tag in MAIN:
        return not _is_main(label)
    if tag in ("html", "body"):
        return False
    named = {names_outside(t) for t in tokens} - {""}
    if in_article:  # the header of an article is its own
        return tag in OUTSIDE and tag != "header" or bool(named - {"header"})
    return tag in OUTSIDE or bool(named)


def spare_holders(root: Node) -> None:
    """Where all of a page's articles lie in nodes that are outside, those nodes lose what makes them so."""
    holders, todo = [], [(root, ())]
    while todo:
        node, above = todo.pop()
        if _is_main(node.label):
            if not above:
                return
            holders.extend(above)
        if _is_outside(node.label, False):
            above = (*above, node)
        todo.extend((c, above) for c in node.children)
    for node in holders:
        tag, *tokens = node.label.split(".")
        node.label = ".".join(["div" if tag in OUTSIDE else tag, *(t for t in tokens if not names_outside(t))])


def parse(source: str) -> tuple[Node, list[tuple[Node, str]]]:
    """The skeleton of a page, and its blocks of text in page order with the node of each."""
    root = Node("")
    open_tags: list[tuple[str, Node]] = [("", root)]
    blocks: list[tuple[Node, str]] = []
    run: list[str] = []
    at, n = 0, len(source)

    def end_block():
        if run:
            text = _SPACE.sub(" ", entities.unescape("".join(run))).strip()
            if text:
                blocks.append((open_tags[-1][1], text))
            run.clear()

    def close(name: str, stop: frozenset | set = frozenset()) -> bool:
        for i in range(len(open_tags) - 1, 0, -1):
            if open_tags[i][0] == name:
                end_block()
                del open_tags[i:]
                return True
            if open_tags[i][0] in stop:
                return False
        return False

    while at < n:
        m = _TOKEN.search(source, at)
        if m is None:
            run.append(source[at:])
            break
        if m.start() > at:
            run.append(source[at:m.start()])
        at = m.end()
        tag = m["tag"]
        if tag is None:
            if m["cdata"]:
                run.append(entities.unescape(m["cdata"]).replace("&", "&amp;"))
            continue
        tag = tag.lower()
        if tag in INLINE:
            if tag == "br":
                run.append(" ")
            continue
        if m["end"]:
            if not close(tag):
                end_block()
            continue
        end_block()
        if tag in FLOW or tag not in VOID:
            if open_tags[-1][0] == "p":
                del open_tags[-1]
        for name in SELF_ENDING.get(tag, ()):
            close(name, SCOPE[tag])
        node = open_tags[-1][1].child(_label(tag, m["attrs"])) if len(open_tags) <= DEPTH else open_tags[-1][1]
        if tag in RAW:
            close_at = re.compile(f"</{tag}", re.I).search(source, at)
            if close_at is None:
                break
            at = source.find(">", close_at.end()) + 1 or n
        elif tag not in VOID and not m["attrs"].rstrip().endswith("/") or tag in FLOW and tag not in VOID:
            open_tags.append((tag, node))
    end_block()
    spare_holders(root)
    return root, blocks


def numbered(root: Node) -> str:
    """Number the nodes in document order; the skeleton as text: label, children in brackets."""
    out, count, stack = [], 0, [(root, False)]
    while stack:
        node, done = stack.pop()
        if done:
            out.append(")")
            continue
        node.number = count
        count += 1
        out.append(f"{node.label}(")
        stack.append((node, True))
        stack.extend((c, False) for c in reversed(node.children))
    return "".join(out)


def read_skeleton(text: str) -> list[Node]:
    """The nodes of a skeleton's text, by number."""
    nodes: list[Node] = []
    stack: list[Node] = []
    for label, close in re.findall(r"([^()]*)\(|(\))", text):
        if close:
            stack.pop()
            continue
        node = Node(label)
        node.number = len(nodes)
        nodes.append(node)
        if stack:
            stack[-1].children.append(node)
        stack.append(node)
    return nodes


def simple_tree_matching(a: Node, b: Node) -> tuple[int, list[tuple[Node, Node]]]:
    """The greatest number of node pairs that keep labels, ancestry and order of siblings, and the pairs."""
    memo: dict[tuple[int, int], tuple[int, list]] = {}

    def match(x: Node, y: Node) -> tuple[int, list]:
        if x.label != y.label:
            return 0, []
        known = memo.get((id(x), id(y)))
        if known:
            return known
        m, n = len(x.children), len(y.children)
        best = [[0] * (n + 1) for _ in range(m + 1)]
        for i in range(1, m + 1):
            for j in range(1, n + 1):
                best[i][j] = max(best[i - 1][j], best[i][j - 1], best[i - 1][j - 1] + match(x.children[i - 1], y.children[j - 1])[0])
        pairs, i, j = [], m, n
        while i and j:
            got = match(x.children[i - 1], y.children[j - 1])[0]
            if got and best[i][j] == best[i - 1][j - 1] + got:
                pairs.append((x.children[i - 1], y.children[j - 1]))
                i, j = i - 1, j - 1
            elif best[i][j] == best[i - 1][j]:
                i -= 1
            else:
                j -= 1
        memo[id(x), id(y)] = best[m][n] + 1, pairs[::-1]
        return memo[id(x), id(y)]

    score, _ = match(a, b)
    out, todo = [], [(a, b)] if score else []
    while todo:
        x, y = todo.pop()
        out.append((x, y))
        todo.extend(match(x, y)[1])
    return score, out


class Wrapper:
    """One tree for all pages of a host."""

    def __init__(self):
        self.root = Node("")

    def add(self, nodes: list[Node]) -> list[Node]:
        """Align a skeleton.  Gives the wrapper's node of each of its nodes."""
        pairs = {id(s): t for t, s in simple_tree_matching(self.root, nodes[0])[1]}
        place: list[Node] = []
        for s in nodes:
            t = pairs.get(id(s))
            if t is None:
                t = Node(s.label)
            place.append(t)
        for s in nodes:
            t, after = place[s.number], 0
            for c in s.children:
                own = place[c.number]
                if own in t.children:
                    after = t.children.index(own) + 1
                else:
                    t.children.insert(after, own)
                    after += 1
        return place

    def roles(self) -> dict[int, bool]:
        """By id of a node: whether its text is content as far as elements tell."""
        content: dict[int, bool] = {}
        has_main = any(_is_main(t.label) for t in _in_order(self.root))
        walk = [(self.root, not has_main, False)]
        while walk:
            t, inside, outside = walk.pop()
            outside |= _is_outside(t.label, inside and has_main)
            inside |= _is_main(t.label)
            content[id(t)] = inside and not outside
            walk.extend((c, inside, outside) for c in t.children)
        return content


def induce(pdf: pd.DataFrame) -> pd.DataFrame:
    """Of some trees of one host: the wrapper, its nodes of each tree's nodes, and which of its nodes may hold content."""
    wrapper = Wrapper()
    pdf = pdf.sort_values(["pages", "key"], ascending=[False, True])
    places = [wrapper.add(read_skeleton(tree)) for tree in pdf["tree"]]
    tree, roles = numbered(wrapper.root), wrapper.roles()
    bits = ["1" if roles[id(t)] else "0" for t in _in_order(wrapper.root)]
    # the wrapper is named by its first tree, and told once
    return pd.DataFrame({"host": pdf["host"].values, "key": pdf["key"].values, "wrapper_key": pdf["key"].iloc[0],
                         "tree": [tree] + [None] * (len(pdf) - 1), "pages": pdf["pages"].values, "place": [[t.number for t in place] for place in places],
                         "roles": ["".join(bits[t.number] for t in place) for place in places]})


def _in_order(root: Node) -> list[Node]:
    out, stack = [], [root]
    while stack:
        out.append(stack.pop())
        stack.extend(reversed(out[-1].children))
    return out


INDUCED = "host string, key long, wrapper_key long, tree string, pages long, place array<int>, roles string"
PARSED = ("page_id long, url string, host string, skeleton_key long, skeleton string, page_hash long, "
          "blocks array<struct<node: int, hash: long, text: string>>")


def parsed(pages: DataFrame) -> DataFrame:
    """Each page with its skeleton and its blocks of text."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = {k: [] for k in ("page_id", "url", "host", "skeleton_key", "skeleton", "page_hash", "blocks")}
            for page_id, url, source in zip(*(batch.column(c).to_pylist() for c in ("page_id", "url", "html"))):
                root, blocks = parse(source or "")
                skeleton = numbered(root)
                raw = [skeleton.encode(), "\n".join(t for _, t in blocks).encode("utf-8", "surrogatepass"),
                       *(t.encode("utf-8", "surrogatepass") for _, t in blocks)]
                ends = np.cumsum([len(x) for x in raw])
                h = span_hashes(np.frombuffer(b"".join(raw), np.uint8), ends - [len(x) for x in raw], ends).view(np.int64).tolist()
                host = re.match(r"\s*(?:[a-zA-Z][a-zA-Z0-9+.-]*:)?//(?:[^/?#@]*@)?([^/?#:]*)", url or "")
                for k, v in zip(out, (page_id, url, host[1].lower() if host else "", h[0], skeleton, h[1],
                                      [{"node": node.number, "hash": x, "text": text} for (node, text), x in zip(blocks, h[2:])])):
                    out[k].append(v)
            block = pa.struct([("node", pa.int32()), ("hash", pa.int64()), ("text", pa.string())])
            yield pa.RecordBatch.from_pydict(out, schema=pa.schema([
                ("page_id", pa.int64()), ("url", pa.string()), ("host", pa.string()), ("skeleton_key", pa.int64()), ("skeleton", pa.string()),
                ("page_hash", pa.int64()), ("blocks", pa.list_(block))]))

    return pages.select(F.col("page_id").cast("long").alias("page_id"), "url", "html").mapInArrow(run, PARSED)


def aligned(shapes: DataFrame) -> DataFrame:
    """(host, skeleton_key, place, roles) of all page structures: the nodes of the host's one wrapper, and which may hold content."""
    trees, total = shapes.select("host", F.col("skeleton_key").alias("key"), F.col("skeleton").alias("tree"), "pages"), None
    while True:
        many = trees.groupBy("host").agg(F.count(F.lit(1)).alias("n"))
        got = stored(trees.join(many, "host").withColumn("part", F.expr(f"pmod(xxhash64(key), (n + {VARIANTS - 1}) div {VARIANTS})"))
                     .groupBy("host", "part").applyInPandas(lambda pdf: induce(pdf), INDUCED), "wrappers")
        if total is None:
            total = got.select("host", F.col("key").alias("skeleton_key"), "wrapper_key", "place", "roles")
        else:
            step = got.select("host", F.col("key").alias("wrapper_key"), F.col("wrapper_key").alias("next"), F.col("place").alias("to"), F.col("roles").alias("as"))
            total = stored(total.join(step, ["host", "wrapper_key"]).select(
                "host", "skeleton_key", F.col("next").alias("wrapper_key"), F.expr("transform(place, x -> to[x])").alias("place"),
                F.expr("array_join(transform(place, x -> substr(`as`, x + 1, 1)), '')").alias("roles")), "wrappers")
        pages = got.groupBy("host", "wrapper_key").agg(F.sum("pages").alias("pages"), F.max("tree").alias("tree"))
        if pages.groupBy("host").agg(F.count(F.lit(1)).alias("n")).filter("n > 1").isEmpty():
            return total.select("host", "skeleton_key", "place", "roles")
        trees = pages.select("host", F.col("wrapper_key").alias("key"), "tree", "pages")


def wrappers(page_trees: DataFrame) -> DataFrame:
    """(host, skeleton_key, roles, template) of all page structures; template: node and hash of the blocks that all pages have."""
    shapes = stored(page_trees.groupBy("host", "skeleton_key").agg(F.min("skeleton").alias("skeleton"), F.countDistinct("page_hash").alias("pages")), "shapes")
    total = aligned(shapes)
    sized = total.join(shapes.select("host", "skeleton_key", "pages"), ["host", "skeleton_key"])
    met = sized.select("host", "skeleton_key", "pages", F.posexplode("place").alias("node", "at"))
    all_pages = met.groupBy("host", "at").agg(F.sum("pages").alias("all_pages")).filter(f"all_pages >= {DISTINCT}")
    # copies of a page say nothing new; a block that a different page of the shape lacks is no template
    blocks = page_trees.select("host", "skeleton_key", "page_hash", F.explode(F.expr("array_distinct(transform(blocks, b -> struct(b.node, b.hash)))")).alias("b")) \
        .select("host", "skeleton_key", "b.node", "b.hash", "page_hash").distinct().groupBy("host", "skeleton_key", "node", "hash").agg(F.count(F.lit(1)).alias("seen"))
    placed = blocks.join(met, ["host", "skeleton_key", "node"]).filter("seen = pages").select("host", "skeleton_key", "node", "hash", "at", "seen")
    constant = placed.groupBy("host", "at", "hash").agg(F.sum("seen").alias("seen")).join(all_pages, ["host", "at"]).filter("seen = all_pages").select("host", "at", "hash")
    template = placed.join(constant, ["host", "at", "hash"]).groupBy("host", "skeleton_key").agg(F.collect_list(F.struct("node", "hash")).alias("template"))
    return total.join(template, ["host", "skeleton_key"], "left") \
        .select("host", "skeleton_key", "roles", F.expr("coalesce(template, array())").alias("template"))


def main_text(pages: DataFrame) -> DataFrame:
    """page_id, url, text, n_chars of every page."""
    trees = stored(parsed(pages), "page-trees")
    roles = stored(wrappers(trees).select(F.col("host").alias("h"), F.col("skeleton_key").alias("k"), "roles", "template"), "roles")
    if small_enough(roles, BROADCAST_BYTES, "h", "roles", "template"):
        roles = F.broadcast(roles)
    content = "filter(blocks, b -> substr(roles, b.node + 1, 1) = '1' and not array_contains(template, struct(b.node, b.hash)))"
    text = F.expr(f"array_join(transform({content}, b -> b.text), '\n')")
    return trees.join(roles, (F.col("host") == F.col("h")) & (F.col("skeleton_key") == F.col("k"))) \
        .select("page_id", "url", text.alias("text")).withColumn("n_chars", F.length("text").cast("long"))
