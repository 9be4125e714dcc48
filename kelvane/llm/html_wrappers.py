"""Operator 8: main text of pages by wrapper induction.

A page is parsed into a tree of elements; inline elements and text belong to the
block around them. Each host has a reference page: of CANDIDATES pages (least hashes of
their ids) the one that aligns best with the others, so an empty page or an error page is none. Every page of
the host is aligned with the reference by simple tree matching: two nodes of one tag match,
children are matched in order by dynamic programming, and equal text counts extra so that constant
nodes anchor the alignment. Of siblings whose table would have more than CELLS cells those that are equal and unique on both
sides are matched first, and what lies between is matched in order by tag.

Over all pages of the host that differ from the reference, aligned with the node or not, a node whose
text is the reference's in at least CONSTANT of at least LEAST pages is template. Other
nodes are slots, and what they hold is counted. The content is the smallest subtree that holds REGION of all text in
slots; slots outside it (menus and adverts whose words vary, lists of links) are boilerplate. A page's text is
that of its node aligned with that subtree, without template. If constant nodes hold over COPIES of a
host's content its pages are near copies of one page, and what they share isn't template.

Roles break ties: text in elements that are menus, headers, footers, sidebars, notices, adverts, forms,
scripts or reader comments by tag, role, class or id isn't counted and is left out within the content as well; a content
inside an article or main element is that element; an article or a first-level heading
outside stays if the reference has nothing like it. Roles alone decide for pages whose host has too few pages, or no
such subtree, and for a page that has nothing aligned with it.

Only counts of (host, node) and one skeleton for each host are gathered: pages meet
their host's skeleton in an equi-join, which Spark broadcasts while the skeletons
are small and whose hot hosts adaptive execution splits beyond. Pages are read
twice; their html is never stored again. Trees are walked without recursion.

Defined results: a null or empty page has the empty text; a page without markup is
its text; a null url has a host of its own kind (null) whose pages are aligned with
none; repeated rows are repeated; truncated and unclosed markup ends at the page's
end; other columns are not read.
"""

from __future__ import annotations

import re
from html import unescape

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import sized_batches, stored

#: Share of a host's other pages that must repeat a node's text, the fewest pages that can tell, and the share of slots' text in the content.
CONSTANT, LEAST, REGION = 0.9, 5, 0.9
#: The share of constant text above which pages are near copies, the pages a reference is chosen from, and the cells of a table of siblings.
COPIES, CANDIDATES, CELLS = 0.8, 5, 40_000

VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea title noscript xmp".split())
OUT = frozenset("head title script style noscript template iframe svg canvas object nav aside form button select textarea input dialog menu footer".split())
#: Elements whose text is never shown as text.
NEVER = frozenset("head title script style noscript template iframe svg canvas object select textarea input button".split())
BLOCKS = frozenset(
    "html body div p h1 h2 h3 h4 h5 h6 ul ol li dl dt dd table thead tbody tfoot tr td th caption section article main header footer nav aside form "
    "fieldset blockquote pre figure figcaption address details summary hr hgroup center dialog menu".split()
)
#: A start tag of the key ends an open element of these names, unless one of the last set lies between.
ENDS = {k: (frozenset(["p"]), frozenset("button td th body".split())) for k in BLOCKS - {"html", "body", "td", "th", "tr"}}
ENDS |= {
    "li": (frozenset(["li", "p"]), frozenset("ul ol menu".split())),
    "dt": (frozenset("dt dd p".split()), frozenset(["dl"])),
    "dd": (frozenset("dt dd p".split()), frozenset(["dl"])),
    "tr": (frozenset("tr td th p".split()), frozenset(["table"])),
    "td": (frozenset("td th p".split()), frozenset(["table", "tr"])),
    "th": (frozenset("td th p".split()), frozenset(["table", "tr"])),
    "option": (frozenset(["option"]), frozenset(["select"])),
}
ROLES = frozenset("navigation banner contentinfo complementary search alert alertdialog dialog menu menubar form toolbar".split())
WORDS = frozenset(
    "ad ads advert adverts advertisement advertising sponsor sponsored promo promoted promotion cookie cookies consent gdpr notice notices notification alert "
    "popup modal overlay newsletter subscribe subscription signup social share sharing related recommended recommendations sidebar aside widget menu nav navbar "
    "navigation breadcrumb breadcrumbs footer masthead comment comments commentlist disqus respond replies login search pagination pager toolbar banner skip".split()
)
MARKUP = re.compile(r"<(?:!--|[!?]|(/?)([A-Za-z][^\s/>]*))")
#: What follows a tag's name, up to its end: quotes count behind an equals sign.
REST, PLAIN_REST = re.compile(r"((?:[^>\"'=]|=\s*\"[^\"]*\"|=\s*'[^']*'|[=\"'])*+)>"), re.compile(r"([^>]*)>")
ATTRIBUTE = re.compile(r"""(class|id|role|hidden|aria-hidden|style)(?:\s*=\s*("[^"]*"|'[^']*'|[^\s"'>]+))?(?=[\s/>]|$)""", re.I)


class Node:
    """An element that is a block; runs of text are its children as strings."""

    __slots__ = ("tag", "children", "out", "inside", "number")

    def __init__(self, tag: str, out: bool, inside: bool):
        self.tag, self.out, self.inside, self.children, self.number = tag, out, inside, [], -1


def left_out(tag: str, attributes: str, inside: bool) -> bool:
    """Whether an element is no part of the main text by its tag, role, class or id; inside: it is in an article."""
    if tag in OUT or tag == "header" and not inside:
        return True
    if not attributes or tag in ("html", "body", "article", "main") and "comment" not in attributes.lower():
        return False
    for m in ATTRIBUTE.finditer(attributes):
        name, value = m[1].lower(), (m[2] or "").strip("\"'").lower()
        if name == "hidden" or name == "aria-hidden" and value == "true" or name == "style" and re.search(r"display\s*:\s*none", value):
            return True
        if name == "role" and value in ROLES:
            return True
        if name in ("class", "id") and (words := set(re.split(r"[^a-z0-9]+", value))) & WORDS and not words & {"content", "main", "article", "body", "post"}:
            return True
        if name in ("class", "id") and not inside and value in ("header", "site-header", "page-header", "top-bar", "topbar"):
            return True
    return False


def parse(html: str) -> Node:
    """The tree of blocks of a page. Inline markup vanishes; br and other breaks are spaces."""
    root = Node("#root", False, False)
    stack: list[tuple[str, Node | None]] = [("#root", root)]
    blocks = [root]
    opened: dict[str, int] = {}

    def close(k: int) -> None:
        for name, node in stack[k:]:
            opened[name] -= 1
            if node is not None:
                blocks.pop()
        del stack[k:]

    at, rest = 0, REST
    while True:
        m = MARKUP.search(html, at)
        text = html[at : m.start()] if m else html[at:]
        if text:
            blocks[-1].children.append(text)
        if not m:
            return root
        tag = (m[2] or "").lower()
        if not tag:  # a comment or declaration
            close_mark = "-->" if m[0] == "<!--" else ">"
            end = html.find(close_mark, m.end())
            at = len(html) if end < 0 else end + len(close_mark)
            continue
        more = rest.match(html, m.end())
        if more is None:  # a quote that never ends: from here on quotes don't count, so the page is read in linear time
            rest = PLAIN_REST
            more = rest.match(html, m.end())
        if more is None:
            return root
        attributes, at = more[1], more.end()
        if m[1]:
            if not opened.get(tag):
                if tag in ("br", "p"):
                    blocks[-1].children.append(" ")
                continue
            for k in range(len(stack) - 1, 0, -1):
                if stack[k][0] == tag:
                    close(k)
                    break
                if stack[k][0] in ("article", "td", "table", "body") and tag not in BLOCKS:
                    break
            continue
        if tag in VOID:
            if tag in ("br", "hr"):
                blocks[-1].children.append(" ")
            continue
        if tag in ENDS:
            ends, bar = ENDS[tag]
            for k in range(len(stack) - 1, 0, -1):
                if not any(map(opened.get, ends)):
                    break
                if stack[k][0] in ends:
                    close(k)
                elif stack[k][0] in bar or stack[k][0] in BLOCKS and stack[k][0] not in ("ul", "ol"):
                    break
        inside = blocks[-1].inside or tag in ("article", "main")
        out = left_out(tag, attributes, blocks[-1].inside)
        if tag in BLOCKS or out:
            node = Node(tag, out, inside)
            blocks[-1].children.append(node)
            if tag not in RAW:
                stack.append((tag, node))
                blocks.append(node)
                opened[tag] = opened.get(tag, 0) + 1
        else:
            stack.append((tag, None))
            opened[tag] = opened.get(tag, 0) + 1
        if tag in RAW:
            end = re.compile(f"</{tag}", re.I).search(html, at)
            at = end.start() if end else len(html)
            if stack[-1][0] == tag:
                close(len(stack) - 1)


def main_roots(root: Node) -> list[Node]:
    """The articles that count; else main elements; else the whole page."""
    found: dict[str, list[Node]] = {"article": [], "main": []}
    stack = [root]
    while stack:
        node = stack.pop()
        if node.out:
            continue
        if node.tag in found:
            found[node.tag].append(node)
            if node.tag == "article":
                continue
        stack += [c for c in reversed(node.children) if isinstance(c, Node)]
    return found["article"] or found["main"][:1] or [root]


def own_text(node: Node) -> str:
    """A node's own runs of text, without its child blocks, white space as one space."""
    return " ".join(unescape("".join(c if isinstance(c, str) else " " * (c.tag in BLOCKS) for c in node.children)).split())


class Tree:
    """A skeleton: tags, hashes and lengths of own texts, parents, children and whether roles leave a node out, in page order."""

    def __init__(self, tags: list[str], hashes: list[int], lengths: list[int], parents: list[int], outs: list[int]):
        self.tags, self.hashes, self.lengths, self.parents, self.outs = tags, hashes, lengths, parents, outs
        self.kids: list[list[int]] = [[] for _ in tags]
        for k, p in enumerate(parents):
            if p >= 0:
                self.kids[p].append(k)
        self._whole: list[int] | None = None

    def whole(self) -> list[int]:
        """A hash of each subtree."""
        if self._whole is None:
            self._whole = [0] * len(self.tags)
            for k in range(len(self.tags) - 1, -1, -1):
                self._whole[k] = hash((self.tags[k], self.hashes[k], tuple(self._whole[c] for c in self.kids[k])))
        return self._whole

    def same(self, other: Tree) -> bool:
        return self.hashes == other.hashes and self.tags == other.tags and self.parents == other.parents

    def dump(self) -> str:
        import json

        return json.dumps([self.tags, self.hashes, self.lengths, self.parents, self.outs], separators=(",", ":"))

    @classmethod
    def load(cls, text: str) -> Tree:
        import json

        return cls(*json.loads(text))


def skeleton(root: Node) -> tuple[Tree, list[Node]]:
    """The tree of a page and its nodes, numbered in page order."""
    import zlib

    tags, hashes, lengths, parents, outs, nodes = [], [], [], [], [], []
    stack = [(root, -1, False)]
    while stack:
        node, parent, out = stack.pop()
        out = out or node.out
        node.number = len(nodes)
        text = own_text(node)
        tags.append(node.tag)
        hashes.append(zlib.crc32(text.encode("utf-8", "replace")) or 1 if text else 0)
        lengths.append(len(text))
        parents.append(parent)
        outs.append(int(out))
        nodes.append(node)
        stack += [(c, node.number, out) for c in reversed(node.children) if isinstance(c, Node) and c.tag not in NEVER]
    return Tree(tags, hashes, lengths, parents, outs), nodes


def increasing(values: list[int]) -> list[int]:
    """Places of a longest increasing subsequence of distinct numbers."""
    from bisect import bisect_left

    tails, places, back = [], [], []
    for k, v in enumerate(values):
        at = bisect_left(tails, v)
        back.append(places[at - 1] if at else -1)
        tails[at:], places[at:] = [v, *tails[at + 1 :]], [k, *places[at + 1 :]]
    out, k = [], places[-1] if places else -1
    while k >= 0:
        out.append(k)
        k = back[k]
    return out[::-1]


def stretches(a: Tree, b: Tree, first: list[int], second: list[int]):
    """Parts of two lists of siblings that are matched with each other."""
    if len(first) * len(second) <= CELLS:
        return [(first, second)]
    from collections import Counter

    x, y = a.whole(), b.whole()
    once = Counter(x[k] for k in first), Counter(y[k] for k in second)
    place = {y[k]: n for n, k in enumerate(second) if once[1][y[k]] == 1}
    anchors = [(n, place[x[k]]) for n, k in enumerate(first) if once[0][x[k]] == 1 and x[k] in place]
    anchors = [anchors[k] for k in increasing([j for _, j in anchors])]
    out, i, j = [], 0, 0
    for n, m in anchors:
        out += [(first[i:n], second[j:m]), ([first[n]], [second[m]])]
        i, j = n + 1, m + 1
    return [*out, (first[i:], second[j:])]


def in_order(a: Tree, b: Tree, first: list[int], second: list[int]) -> list[tuple[int, int]]:
    """Siblings matched one after another by tag."""
    out, j, waiting = [], 0, {}
    for n, k in enumerate(second):
        waiting.setdefault(b.tags[k], []).append(n)
    at = dict.fromkeys(waiting, 0)
    for x in first:
        places = waiting.get(a.tags[x], ())
        k = at.get(a.tags[x], 0)
        while k < len(places) and places[k] < j:
            k += 1
        if k < len(places):
            out.append((x, second[places[k]]))
            j, k = places[k] + 1, k + 1
        if places:
            at[a.tags[x]] = k
    return out


def match(a: Tree, b: Tree) -> tuple[int, list[tuple[int, int]]]:
    """(weight, pairs of node numbers) of the best alignment of two trees by simple tree matching."""

    def solve(i: int, j: int):
        first, second = a.kids[i], b.kids[j]
        score, mine = 3 if a.hashes[i] == b.hashes[j] and a.hashes[i] else 1, []
        for xs, ys in stretches(a, b, first, second) if first and second else ():
            if len(xs) * len(ys) > CELLS:
                for x, y in in_order(a, b, xs, ys):
                    w, found = yield x, y
                    score += w
                    mine.append(found)
                continue
            n, m = len(xs), len(ys)
            below: dict[tuple[int, int], tuple] = {}
            best = [[0] * (m + 1) for _ in range(n + 1)]
            for p in range(1, n + 1):
                x, row, last = xs[p - 1], best[p], best[p - 1]
                tag, own, leaf = a.tags[x], a.hashes[x], not a.kids[x]
                for q in range(1, m + 1):
                    y = ys[q - 1]
                    w = 0
                    if tag == b.tags[y]:
                        if leaf or not b.kids[y]:
                            w = 3 if own == b.hashes[y] and own else 1
                        else:
                            below[p, q] = yield x, y
                            w = below[p, q][0]
                    w += last[q - 1]
                    row[q] = w if w > row[q - 1] and w >= last[q] else max(row[q - 1], last[q])
            p, q = n, m
            while p and q:
                if best[p][q] == best[p - 1][q]:
                    p -= 1
                elif best[p][q] == best[p][q - 1]:
                    q -= 1
                else:
                    mine.append(below[p, q][1] if (p, q) in below else (xs[p - 1], ys[q - 1], ()))
                    p, q = p - 1, q - 1
            score += best[n][m]
        return score, (i, j, mine)

    stack, value = [solve(0, 0)], None
    while stack:
        try:
            pair = stack[-1].send(value)
        except StopIteration as end:
            stack.pop()
            value = end.value
        else:
            stack.append(solve(*pair))
            value = None
    pairs, todo = [], [value[1]]
    while todo:
        i, j, more = todo.pop()
        pairs.append((i, j))
        todo += more
    return value[0], pairs


class Wrapper:
    """A host's reference, its template nodes and the node of its content (None if roles must decide)."""

    def __init__(self, tree: Tree, pages: int, same: dict[int, int], mass: dict[int, int], constant: float = CONSTANT, region: float = REGION):
        self.tree, self.region = tree, None
        self.template = {k for k, n in same.items() if tree.hashes[k] and n >= constant * pages}
        total = [mass.get(k, 0) for k in range(len(tree.tags))]
        for k in range(len(total) - 1, 0, -1):
            total[tree.parents[k]] += total[k]
        k = 0
        while total[0] and (below := next((c for c in tree.kids[k] if total[c] >= region * total[0]), None)):
            k = below
        up = k
        while up > 0 and tree.tags[up] not in ("article", "main"):
            up = tree.parents[up]
        k = up if up > 0 else k
        if tree.tags[k] not in ("#root", "html", "body"):
            self.region = k
        inside = [n for n in self.template if self.within(n, k)]
        held = sum(tree.lengths[n] * same[n] for n in inside)
        if held > COPIES * (held + total[k]):
            self.template -= set(inside)

    def within(self, node: int, top: int) -> bool:
        while node > top:
            node = self.tree.parents[node]
        return node == top

    def text(self, root: Node) -> str:
        """The main text of a page of the host."""
        page, nodes = skeleton(root)
        _, pairs = match(self.tree, page)
        gone = {j for i, j in pairs if i in self.template and self.tree.hashes[i] == page.hashes[j]}
        roots = main_roots(root)
        if self.region is not None and (found := next((j for i, j in pairs if i == self.region), None)) is not None:
            aligned = {j for _, j in pairs}
            chosen = {found}
            for k, tag in enumerate(page.tags):  # ties: what the reference knows nothing of, and titles
                if not page.outs[k] and (tag == "article" and k not in aligned or tag == "h1" and k < found and k not in gone):
                    chosen.add(k)
            roots, last = [], -1
            for k in sorted(chosen):  # subtrees are runs of numbers: what lies in a chosen one isn't taken again
                if k > last:
                    roots.append(nodes[k])
                    last = self._last(page, k)
        text = text_of(roots, gone)
        return text or text_of(main_roots(root), set())

    @staticmethod
    def _last(page: Tree, k: int) -> int:
        while page.kids[k]:
            k = page.kids[k][-1]
        return k


def text_of(roots: list[Node], template: set[int]) -> str:
    """Text of the main part without template nodes' own text, blocks joined by one space."""
    parts: list[str] = []
    for r in roots:
        stack: list[tuple[Node, list[str], object]] = [(r, [], iter(r.children))]
        while stack:
            node, run, rest = stack[-1]
            c = next(rest, None)
            if isinstance(c, str):
                run.append(c)
                continue
            if c is not None and c.tag not in BLOCKS:
                continue
            if run and node.number not in template and (t := " ".join(unescape("".join(run)).split())):
                parts.append(t)
            run.clear()
            if c is None:
                stack.pop()
            elif not c.out:
                stack.append((c, [], iter(c.children)))
    return " ".join(parts)


def host_of(url):
    return F.lower(F.regexp_extract(url, r"^[A-Za-z][A-Za-z0-9+.\-]*://(?:[^/?#@]*@)?([^/?#:]*)", 1))


def reference(pages: list[str]) -> Tree:
    """Of some pages of a host the skeleton that aligns best with the others', weighed by their sizes."""
    trees = [skeleton(parse(h))[0] for h in pages]
    if len(trees) < 3:
        return trees[0]
    weight = [[0.0] * len(trees) for _ in trees]
    for i, x in enumerate(trees):
        for j in range(i):
            weight[i][j] = weight[j][i] = match(x, trees[j])[0] / (len(x.tags) + len(trees[j].tags)) * min(len(x.tags), len(trees[j].tags))
    return trees[max(range(len(trees)), key=lambda k: (sum(weight[k]), -k))]


def skeletons(pages: DataFrame) -> DataFrame:
    """host and the skeleton of its reference page."""
    some = [F.min(F.struct(F.xxhash64(F.lit(k), F.col("rank")).alias("r"), F.col("html"))).alias(f"c{k}") for k in range(CANDIDATES)]
    chosen = pages.groupBy("host").agg(*some).select("host", F.array_distinct(F.array(*[F.col(f"c{k}.html") for k in range(CANDIDATES)])).alias("pages"))  # a row a host leaves each task

    def run(batches):
        import pyarrow as pa

        for b in batches:
            trees = [reference(p).dump() for p in b.column("pages").to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column("host"), pa.array(trees, pa.string())], names=["host", "tree"])

    return chosen.mapInArrow(run, "host string, tree string")


def count_nodes(pages: DataFrame) -> DataFrame:
    """host, node, same (pages that differ from the reference and repeat the node's text) and mass (characters of other texts at the node, roles' apart); node -1 has the number of all pages of the host that differ."""
    from collections import Counter

    def run(batches):
        import pyarrow as pa

        known: dict[str, Tree] = {}
        for b in batches:
            same, mass = Counter(), Counter()
            for host, html, tree in zip(b.column("host").to_pylist(), b.column("html").to_pylist(), b.column("tree").to_pylist()):
                if len(known) > 500:
                    known.clear()
                if tree not in known:
                    known[tree] = Tree.load(tree)
                whole, (page, _) = known[tree], skeleton(parse(html))
                if page.same(whole):
                    continue
                same[host, -1] += 1
                partner = {j: i for i, j in match(whole, page)[1]}
                owner = [0] * len(page.tags)
                for j in range(len(page.tags)):
                    i = partner.get(j)
                    owner[j] = owner[page.parents[j]] if i is None else i
                    if not page.hashes[j]:
                        continue
                    if i is not None and whole.hashes[i] == page.hashes[j]:
                        same[host, i] += 1
                    elif not page.outs[j]:
                        mass[host, owner[j]] += page.lengths[j]
            keys = list(same.keys() | mass.keys())
            columns = [pa.array([k[0] for k in keys], pa.string()), *(pa.array(x, pa.int64()) for x in ([k[1] for k in keys], [same[k] for k in keys], [mass[k] for k in keys]))]
            yield pa.RecordBatch.from_arrays(columns, names=["host", "node", "same", "mass"])

    counts = pages.select("host", "html", "tree").mapInArrow(run, "host string, node bigint, same bigint, mass bigint")
    return counts.groupBy("host", "node").agg(F.sum("same").alias("same"), F.sum("mass").alias("mass"))


def wrappers(pages: DataFrame, least: int = LEAST) -> DataFrame:
    """host, tree, and the counts of its reference's nodes for pages (host, rank, html), of hosts with enough pages that differ."""
    trees = stored(skeletons(pages.where("host <> ''")), "skeletons")
    counts = stored(count_nodes(pages.join(trees, "host")), "node-counts")
    whole = counts.where(f"node = -1 and same >= {int(least)}").select("host", F.col("same").alias("pages"))
    nodes = counts.where("node >= 0").groupBy("host").agg(F.collect_list(F.struct("node", "same", "mass")).alias("nodes"))  # nodes of one page
    return stored(trees.join(whole, "host").join(nodes, "host"), "wrappers")


def extract(pages: DataFrame) -> DataFrame:
    """page_id, url and text for every row of pages (page_id, url, html)."""
    sized_batches(pages.sparkSession, 500)
    base = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), F.coalesce(F.col("html").cast("string"), F.lit("")).alias("html"))
    base = base.withColumn("host", host_of(F.col("url"))).withColumn("rank", F.xxhash64(F.lit("page"), F.col("page_id")))
    found = base.select("page_id", "url", "html", "host").join(wrappers(base), "host", "left")

    def run(batches):
        import pyarrow as pa

        known: dict[str, Wrapper] = {}
        for b in batches:
            out = []
            for k, (host, html) in enumerate(zip(b.column("host").to_pylist(), b.column("html").to_pylist())):
                if not b.column("pages")[k].is_valid:
                    out.append(text_of(main_roots(parse(html)), set()))
                    continue
                if len(known) > 500:
                    known.clear()
                if host not in known:
                    counts = b.column("nodes")[k].as_py()
                    same, mass = ({n["node"]: n[name] for n in counts} for name in ("same", "mass"))
                    known[host] = Wrapper(Tree.load(b.column("tree")[k].as_py()), b.column("pages")[k].as_py(), same, mass)
                out.append(known[host].text(parse(html)))
            yield pa.RecordBatch.from_arrays([b.column("page_id"), b.column("url"), pa.array(out, pa.string())], names=["page_id", "url", "text"])

    return found.select("page_id", "url", "html", "host", "tree", "pages", "nodes").mapInArrow(run, "page_id bigint, url string, text string")


def op8_wrapper_induction(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Registered query: the main text of every page."""
    out = extract(spark.read.parquet(f"{sf_dir}/pages.parquet"))
    return out.select("page_id", "url", "text", F.char_length("text").cast("long").alias("n_chars"))
