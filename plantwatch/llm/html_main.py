"""Main text of web pages by minimum-cut labelling.

A page is cut into text blocks at its block elements. A classifier gives each block the log-odds of being content from its
own text alone; they become the capacities to the two terminals. Smoothness edges join blocks that follow each other,
weaker the farther they are apart in the DOM, and every block and element with the element around it, whose tag and class
words are a capacity of its own. The minimum cut, found by maximum flow, is the labelling with the least sum of scores
overruled and edges cut; the blocks on its source side are the text.

The classifier is a table of log-odds by kind of block. It is counted over all pages: blocks below elements whose tag or
class words tell what they are count for or against their kind, beside some counts that hand-set scores stand for.
"""

import html
import math
import re
from collections import Counter, deque
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import functions as F

# ---- blocks ---------------------------------------------------------------------------------------------------------

_TOKEN = re.compile(r"""<!--.*?(?:-->|\Z)|<!\[CDATA\[.*?(?:\]\]>|\Z)|<[!?][^>]*>?
    |<(?P<close>/?)(?P<tag>[A-Za-z][A-Za-z0-9:-]*)(?P<rest>(?:[^>"']++|"[^"]*+"|'[^']*+')*+>|[^>]*+>)
    |(?P<text>[^<]+|<)""", re.S | re.X)
_ATTRIBUTE = re.compile(r"""(?i)(?<![\w-])(class|id|role|style|hidden|aria-hidden)(?:\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+)))?""")
_RAW_END = {t: re.compile(rf"(?i)</{t}(?=[\s/>])[^>]*>?") for t in ("script", "style", "title", "textarea", "xmp", "template", "noscript", "svg", "annotation", "annotation-xml", "iframe", "object", "select")}
#: Of these, elements that end with their parent at the latest.
_ENDS_WITH_PARENT = {"template", "noscript", "svg", "object", "select", "annotation", "annotation-xml"}
_VOID = set("area base br col embed hr img input link meta param source track wbr".split())
_BLOCK = set("""address article aside blockquote body button caption center dd details dialog dir div dl dt fieldset figcaption figure footer form
    h1 h2 h3 h4 h5 h6 head header hgroup hr html legend li main menu nav ol optgroup option p pre search section summary table tbody td tfoot th thead tr ul""".split())
#: What an opening tag closes, and the elements that it does not look beyond.
_CLOSES = {"li": ({"li"}, {"ul", "ol", "menu"}), "dt": ({"dt", "dd"}, {"dl"}), "dd": ({"dt", "dd"}, {"dl"}), "tr": ({"tr", "td", "th"}, {"table"}),
           "td": ({"td", "th"}, {"tr", "table"}), "th": ({"td", "th"}, {"tr", "table"}), "option": ({"option"}, {"select"})}
_IN_P = _BLOCK - {"li", "dt", "dd", "td", "th", "tr", "tbody", "thead", "tfoot", "caption", "body", "html", "head", "button", "option", "legend", "summary"}

# ---- evidence of elements -------------------------------------------------------------------------------------------

#: Cost of what is in an element, a block: below 0 for boilerplate, above for content.
BOILER, ARTICLE, CONTENT = -6.0, 6.0, 2.5
BOILER_TAGS = set("nav footer aside form button menu header dialog head search fieldset legend option".split())
BOILER_WORDS = set("""ad ads adv advert adverts advertisement advertising adsense sponsor sponsored promo promotion banner cookie cookies consent gdpr notice notices alert
    sidebar sidebars side aside rail comment comments commentlist respond reply replies disqus discussion menu menus nav navbar navigation breadcrumb breadcrumbs
    footer foot header masthead topbar share sharing social related recommended recommendations newsletter subscribe subscription popup modal overlay login signin signup
    register widget widgets toolbar pagination pager copyright legal skip hidden complementary contentinfo search toc tags outbrain taboola""".split())
CONTENT_WORDS = set("article content post entry story main text articlebody maincontent postcontent".split())
_WORDS = re.compile(r"[A-Z]+(?![a-z])|[A-Z]?[a-z]+")
#: The cost of a boilerplate word beside a class that is only of content words; words after one of these cost nothing.
MIXED = -3.5
NEGATIONS = {"has", "with", "no", "not", "without"}
#: Below an element of this cost or less, articles and content words are no evidence (reader comments are often articles).
VOID_BELOW = -3.0


class _Element:
    __slots__ = ("tag", "parent", "above", "depth", "in_article", "named", "high", "cost", "void", "below")

    def __init__(self, tag, rest, parent):
        self.tag, self.parent = tag, parent
        self.depth = parent.depth + 1 if parent else 0
        self.above = parent.above if self.depth > DEEPEST + 1 else parent
        self.in_article = bool(parent and parent.in_article) or tag in ("article", "main")
        self.named, self.high, self.void, self.below = 0.0, ARTICLE if tag in ("article", "main") else 0.0, False, 0
        self.cost = BOILER if tag in BOILER_TAGS and not (tag == "header" and self.in_article) else 0.0
        if len(rest) > 4 and tag not in ("html", "body"):
            for m in _ATTRIBUTE.finditer(rest):
                name, value = m[1].lower(), m[2] or m[3] or m[4] or ""
                if name in ("hidden", "aria-hidden", "style"):
                    if name == "hidden" or value.lower() == "true" or re.search(r"display\s*:\s*none", value, re.I):
                        self.cost = BOILER
                    continue
                boiler, content = _named(value)
                if boiler and tag != "main":
                    self.named = min(self.named, MIXED if content else BOILER)
                if content:
                    self.high = max(self.high, CONTENT)


def _named(value):
    """Whether a class, id or role has a boilerplate word that is not negated, and whether it has a class of content words."""
    boiler = content = False
    for name in value.split():
        words = [w.lower() for w in _WORDS.findall(name)]
        if words and words[0] in NEGATIONS:
            continue
        if not BOILER_WORDS.isdisjoint(words):
            boiler = True
        elif not CONTENT_WORDS.isdisjoint(words):
            content = True
    return boiler, content


def _weigh(elements, blocks):
    """Put the costs on the elements.

    What class words cost falls with the share of the page's unlinked text that an element holds, from half of it on to
    nothing for all of it. Evidence of content counts where no boilerplate is said of the element or of one around it.
    """
    for block in blocks:
        block.element.below += len(block.text) - block.linked
    for e in reversed(elements):
        if e.parent:
            e.parent.below += e.below
    total = elements[0].below
    for e in elements[1:]:
        if e.named and total:
            e.named *= min(1.0, 2.0 * (1.0 - e.below / total))
        e.cost = min(e.cost, e.named)
        e.void = e.parent.void or e.parent.cost <= VOID_BELOW
        if not e.void and e.cost > VOID_BELOW:
            e.cost += e.high


class Block:
    """A text block: its text, the element that holds it, and how many of its characters are in links."""

    __slots__ = ("text", "element", "linked")

    def __init__(self, text, element, linked):
        self.text, self.element, self.linked = text, element, linked


def blocks_of(page):
    """The text blocks of a page in order: character references decoded, white space as single spaces, none empty."""
    root = at = _Element("#", "", None)
    elements, ends, loose, opened = [root], {}, False, Counter()
    found, parts, linked, links = [], [], 0, 0

    def flush():
        nonlocal parts, linked
        if parts:
            text = " ".join(html.unescape("".join(parts)).split())
            if text:
                found.append(Block(text, at, min(linked, len(text))))
        parts, linked = [], 0

    def leave(node):
        """Close all elements up to ``node``."""
        nonlocal at
        while at is not node.parent:
            opened[at.tag] -= 1
            at = at.parent

    place, size = 0, len(page)
    while place < size:
        m = _TOKEN.match(page, place)
        if m is None:  # a tag without an end
            break
        place = m.end()
        if m["text"]:
            parts.append(m["text"])
            if links:
                linked += len(m["text"].strip())
            continue
        if not m["tag"]:
            continue
        tag = m["tag"].lower()
        if m["close"]:
            if tag == "a":
                links = 0
            elif tag in _BLOCK:
                flush()
                if opened[tag]:
                    node = at
                    while node.tag != tag:
                        node = node.parent
                    leave(node)
            continue
        if tag in _RAW_END and not m["rest"].endswith("/>"):
            if tag not in ends or ends[tag] and ends[tag].start() < place:
                ends[tag] = _RAW_END[tag].search(page, place)
            end = ends[tag]
            if tag not in _ENDS_WITH_PARENT:
                place = end.end() if end else size
            elif end or not loose:
                stop = _parent_end(page, at, place, end.start() if end else size)
                loose = stop is None and not end
                place = stop if stop is not None else end.end() if end else place
            continue
        if tag == "br":
            parts.append(" ")
        elif tag == "a":
            links = 1
        elif tag in _BLOCK:
            flush()
            if tag in _CLOSES or tag in _IN_P:
                closes, stop = _CLOSES.get(tag, ({"p"}, {"div", "td", "th", "li", "article", "section", "body", "blockquote", "main", "table"}))
                node = at
                if any(opened[t] for t in closes):
                    while node is not root and node.tag not in closes and node.tag not in stop:
                        node = node.parent
                    if node.tag in closes:
                        leave(node)
            if tag not in _VOID:
                at = _Element(tag, m["rest"], at)
                elements.append(at)
                opened[tag] += 1
    flush()
    _weigh(elements, found)
    return found


def _parent_end(page, at, place, limit):
    """Where, before ``limit``, an element that is open at ``place`` is closed, or None."""
    above, opened = {}, Counter()
    node = at
    while node:
        above[node.tag], node = True, node.parent
    while place < limit and (m := _TOKEN.match(page, place)) and m.start() < limit:
        tag = (m["tag"] or "").lower()
        if tag in _BLOCK and tag not in _VOID:
            if not m["close"]:
                opened[tag] += 1
            elif opened[tag]:
                opened[tag] -= 1
            elif tag in above:
                return place
        place = m.end()
    return None


# ---- classifier -----------------------------------------------------------------------------------------------------

#: Bounds of a block's log-odds; counts that the hand-set score of a kind of block stands for.
LEAST, MOST, PRIOR = -2.0, 2.0, 20.0
#: Added for blocks of links outside articles.
LINKED = -1.0


def kind(block):
    """The kind of a block: powers of 2 in its length (up to 10), marks (up to 2), and steps of the share of linked text."""
    n, density = len(block.text), block.linked / len(block.text)
    marks = sum(min(2, block.text.count(c)) for c in ".,;!?")
    return min(10, n.bit_length() - 1), min(2, marks), 0 if not block.linked else 1 if density <= 0.2 else 2 if density <= 0.5 else 3


def prior(kind):
    """The hand-set log-odds of a kind of block."""
    length, marks, links = kind
    return max(LEAST, min(MOST, -0.5 + min(2.0, 1.5 * 2**length / 60.0) + marks / 2.0 - (0.0, 0.0, 1.0, 4.0)[links]))


def told(blocks):
    """(kind, content or not) of the blocks below elements with evidence; the nearest such element counts."""
    for block in blocks:
        e = block.element
        while e.parent and not e.cost and not e.void:
            e = e.parent
        if e.cost or e.void:
            yield kind(block), e.cost > 0


def log_odds(counts):
    """The classifier: log-odds by kind from {(kind, content): blocks}; kinds without counts keep the hand-set ones."""
    table = {}
    for k in {k for k, _ in counts}:
        p = 1.0 / (1.0 + math.exp(-prior(k)))
        odds = (counts.get((k, True), 0) + PRIOR * p) / (counts.get((k, False), 0) + PRIOR * (1.0 - p))
        table[k] = max(LEAST, min(MOST, math.log(odds)))
    return table


def score(block, table=None):
    """Above 0 for content, below for boilerplate."""
    k = kind(block)
    return (table[k] if table and k in table else prior(k)) + (LINKED if k[2] == 3 and not block.element.in_article else 0.0)


# ---- minimum cut ----------------------------------------------------------------------------------------------------

#: Smoothness of blocks that follow each other at DOM distance d: FOLLOW / d. Of an element in the one around it: INSIDE a block.
#: INSIDE is over MOST, so text alone doesn't leave an element whose kind is known.
#: What an element with evidence is tells little about the one around it: OUTWARD for all of it.
FOLLOW, INSIDE, OUTWARD = 0.5, 2.2, 0.3
#: Elements deeper than this are as if they lay side by side in the one at this depth.
DEEPEST = 256


def _distance(a, b):
    """Steps between two elements in the tree, at least 1."""
    steps = 0
    while a is not b:
        if a.depth >= b.depth:
            a = a.parent
        else:
            b = b.parent
        steps += 1
    return max(1, steps)


def graph_of(blocks, table=None):
    """(scores, edges): a node for each block, then one for each element that has evidence or holds several nodes.

    The cost of an element counts for every block below, and so does its edge to the element around it if it has no cost.
    """
    scores = [score(b, table) for b in blocks]
    edges = [(k, k + 1, FOLLOW / _distance(a.element, b.element)) for k, (a, b) in enumerate(zip(blocks, blocks[1:]))]
    size, tie, held = [1] * len(scores), [INSIDE] * len(scores), {}
    for k, block in enumerate(blocks):
        e = block.element
        if e in held:
            held[e].append(k)
            continue
        held[e] = [k]
        while e.above and e.above not in held:
            e = e.above
            held[e] = []
    for e in sorted(held, key=lambda e: -e.depth):
        inside = held[e]
        if e.cost or len(inside) > 1:
            node, n = len(scores), sum(size[k] for k in inside)
            edges += [(k, node, tie[k]) for k in inside]
            scores.append(e.cost * n)
            size.append(n)
            tie.append(OUTWARD if e.cost else INSIDE * n)
            inside = [node]
        if e.above:
            held[e.above] += inside
    return scores, edges


def minimum_cut(scores, edges):
    """Labels (True: content) with the least sum of overruled scores and cut edges.

    A node whose score outweighs all its open edges has the same label in some minimum cut; such nodes are settled first,
    which leaves small graphs for the maximum flow.
    """
    unary, near = list(scores), [{} for _ in scores]
    for i, j, w in edges:
        near[i][j] = near[i].get(j, 0.0) + w
        near[j][i] = near[j].get(i, 0.0) + w
    open_weight = [sum(x.values()) for x in near]
    label, queue = [None] * len(unary), deque(range(len(unary)))
    while queue:
        i = queue.popleft()
        if label[i] is None and abs(unary[i]) >= (open_weight[i] if near[i] else 0.0):
            label[i] = unary[i] > 0
            for j, w in near[i].items():
                unary[j] += w if label[i] else -w
                del near[j][i]
                open_weight[j] -= w
                queue.append(j)
    open_nodes = [i for i in range(len(unary)) if label[i] is None]
    if open_nodes:
        for i in open_nodes:
            label[i] = False
        for i in _source_side(open_nodes, unary, near):
            label[i] = True
    return label


def _source_side(nodes, unary, near):
    """Nodes on the source side of a minimum cut, by blocking flows in layers of the residual graph."""
    rest = {i: dict(near[i]) for i in nodes}
    rest["s"], rest["t"] = {}, {}
    for i in nodes:
        if unary[i] > 0:
            rest["s"][i], rest[i]["s"] = unary[i], 0.0
        elif unary[i] < 0:
            rest[i]["t"], rest["t"][i] = -unary[i], 0.0
    while True:
        level, queue = {"s": 0}, deque("s")
        while queue:
            u = queue.popleft()
            for v, c in rest[u].items():
                if c > 1e-12 and v not in level:
                    level[v] = level[u] + 1
                    queue.append(v)
        if "t" not in level:
            return [i for i in nodes if i in level]
        ahead = {u: [v for v, c in rest[u].items() if c > 1e-12 and level.get(v) == level[u] + 1] for u in level}
        path = ["s"]
        while path:
            u = path[-1]
            if u == "t":
                steps = list(zip(path, path[1:]))
                flow = min(rest[a][b] for a, b in steps)
                for a, b in steps:
                    rest[a][b] -= flow
                    rest[b][a] += flow
                path = path[:1 + next(k for k, (a, b) in enumerate(steps) if rest[a][b] <= 1e-12)]
                continue
            # the last step of a node stays in its list as long as it carries flow
            while ahead[u] and rest[u][ahead[u][-1]] <= 1e-12:
                ahead[u].pop()
            if ahead[u]:
                path.append(ahead[u][-1])
            else:
                path.pop()
                if path:
                    ahead[path[-1]].pop()


def main_text(page, table=None):
    """The main text of a page: its content blocks in page order, joined by line feeds. ``table`` is a classifier."""
    blocks = blocks_of(page)
    return "\n".join(b.text for b, content in zip(blocks, minimum_cut(*graph_of(blocks, table))) if content)


def trained(pages, html_column="html"):
    """The classifier of a table of pages: the kinds of all its blocks are counted, and only the counts (at most 264) collected."""

    def count(batches):
        counts = Counter()
        for batch in batches:
            for page in batch["html"]:
                counts.update(told(blocks_of(page)))
        yield pd.DataFrame([(*k, content, n) for (k, content), n in counts.items()], columns=names)

    names = ["length", "marks", "links", "content", "n"]
    rows = pages.select(F.coalesce(F.col(html_column), F.lit("")).alias("html"))
    rows = rows.mapInPandas(count, "length int, marks int, links int, content boolean, n bigint")
    rows = rows.groupBy(*names[:-1]).agg(F.sum("n").alias("n"))
    return log_odds({((r.length, r.marks, r.links), r.content): r.n for r in rows.collect()})


def extracted(pages, table=None, id_column="page_id", url_column="url", html_column="html"):
    """Per row: ``page_id``, ``url``, ``text`` and ``n_chars`` (its code points). ``table`` is a classifier; if none is given, the pages train one.

    Null and empty pages, and pages without content, have an empty text. Repeated rows come back repeated; null ids and
    urls stay null; other columns are left out, whatever their names; an empty table gives an empty result. A ``header``
    outside articles is boilerplate with the headings in it. Very long pages are read whole, one at a time.
    """
    table = trained(pages, html_column) if table is None else table

    @F.pandas_udf("string")
    def text(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for held in batches:
            yield pd.Series([main_text(p, table) for p in held], dtype=object)

    rows = pages.select(F.col(id_column).alias("page_id"), F.col(url_column).alias("url"), text(F.coalesce(F.col(html_column), F.lit(""))).alias("text"))
    return rows.withColumn("n_chars", F.length("text").cast("bigint"))
