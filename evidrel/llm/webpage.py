"""HTML extraction by wrapper induction.

Pages of one host are aligned with each other, a bounded number at a time: their
DOM trees, with runs of equal siblings folded, are matched to a reference page
by simple tree matching (the largest common top-down tree that keeps the order
of siblings). Nodes whose text is the same on most of the aligned pages become
the template, and so does a member of a run whose text is in that run on most of
them; slots whose text varies become content. Pages with the same main text say
nothing about what is constant in it and count once; on a page most of whose
main text would go it is not template but a copy, and stays. The main text is
the article element, or else the subtree that gathers most of the varying text,
without the parts that page markup declares as menus, notices and the like.
"""

from __future__ import annotations

import html
import re
import sys
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pandas as pd
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from evidrel.llm.common import arrow_rows, written

#: Pages aligned at a time, and pages of a host in one task's share.
ALIGNED, SHARE = 64, 256
#: Hosts larger than a share whose sizes are sent to all tasks; more of them are joined.
SENT_HOSTS = 100_000
#: Aligned pages with different texts that a template text must be on: so many, and this part of them.
SAME_PAGES, SAME_PART = 4, 0.6
#: Cells of a sibling table that are filled at a time; larger ones are divided at their best middle.
CELLS = 250_000
#: Frames for deep nesting, which plain Python functions keep on the heap.
sys.setrecursionlimit(10_000_000)

# Element names of HTML by role.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea title xmp noembed noframes iframe".split())
INLINE = frozenset("a abbr acronym b bdi bdo big br cite code data del dfn em font i img ins kbd label mark q rp rt ruby s samp small span strike strong sub sup time tt u var wbr".split())
DROPPED = frozenset("head nav footer aside form script style noscript template iframe svg button select option textarea input menu dialog object embed applet canvas audio video map math title noembed noframes".split())
CLOSES_P = frozenset("address article aside blockquote center details dialog dir div dl fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr main menu nav ol p pre search section table ul".split())
ROLES = frozenset("navigation banner contentinfo complementary search form dialog alert alertdialog menu menubar toolbar".split())
NAMES = frozenset(
    """ad ads adv advert adverts advertisement advertising adsense banner breadcrumb breadcrumbs comment comments commentlist consent cookie cookies disqus dropdown
    footer gdpr header hidden login masthead menu menubar modal nav navbar navigation newsletter notice notices notification overlay pager pagination paywall popup
    promo promos promoted promotion recommend recommended recommendations related replies reply respond search share sharing sidebar signup skip social sponsor
    sponsored subscribe subscription teaser toolbar topbar widget widgets""".split()
)

#: Of them the parts that may be longer than the main text.
LONG = frozenset("comment comments commentlist disqus recommend recommended recommendations related replies reply respond".split())
#: What a box around a part may be called, behind its name.
BOXES = frozenset("area bar block body box cell col column container content frame group holder inner item items link links list module outer panel pane row section slot unit wrap wrapper zone".split())
#: Before a name: the element has such a part, or not, beside or in it.
MODIFIERS = frozenset("has no with without".split())

_TOKEN = re.compile(
    r"""<!--.*?(?:-->|\Z)|<[!?][^>]*+>?|<(/?)([a-zA-Z][^\s/>]*+)((?:[^>"']++|"[^"]*+"|'[^']*+')*+)>|<(/?)([a-zA-Z][^\s/>]*+)([^>]*+)>?|[^<]++|<""",
    re.S,
)
_ATTR = re.compile(r"""(class|id|role|hidden|aria-hidden|style|itemprop)(?:\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+)))?""", re.I)
_PART = re.compile(r"[A-Z]?[a-z]+|[A-Z]+|[0-9]+")
_SPACE = re.compile(r"\s+")


class Node:
    __slots__ = ("tag", "attrs", "kids", "key")

    def __init__(self, tag: str, attrs: dict[str, str]):
        self.tag, self.attrs, self.kids = tag, attrs, []
        self.key = f"{tag}#{attrs.get('class', '')}" if attrs else tag


class Open:
    """The elements that are open, and the places of each tag among them: ends are found without a walk."""

    def __init__(self, root: Node):
        self.nodes, self.places = [root], {}

    def push(self, node: Node) -> None:
        self.places.setdefault(node.tag, []).append(len(self.nodes))
        self.nodes.append(node)

    def close(self, tags: tuple[str, ...], stop: tuple[str, ...]) -> None:
        """Closes the innermost of the tags and what is in it, unless a stop lies further in."""
        last = lambda names: max((p[-1] for t in names if (p := self.places.get(t))), default=0)
        at = last(tags)
        if at > last(stop):
            for node in self.nodes[at:]:
                self.places[node.tag].pop()
            del self.nodes[at:]


def parse(text: str) -> Node:
    """A lenient DOM: void and raw elements, implied ends of p, li, dt, dd, tr, td, th and option; stray ends ignored."""
    root = Node("#root", {})
    stack, at, n = Open(root), 0, len(text)
    while at < n:
        m = _TOKEN.match(text, at)
        at = m.end()
        tag = m[2] or m[5]
        if tag is None:
            if text[m.start()] != "<" or m.end() - m.start() == 1:
                stack.nodes[-1].kids.append(m[0])
            continue
        tag = tag.lower()
        if m[1] or m[4]:
            stack.close((tag,), ())
            continue
        raw = m[3] or m[6] or ""
        attrs = {a[0].lower(): a[1] or a[2] or a[3] or "" for a in _ATTR.findall(raw)} if "=" in raw or "hidden" in raw else {}
        if tag in CLOSES_P:
            stack.close(("p",), ("button", "td", "th", "table", "object"))
        if tag == "li":
            stack.close(("li",), ("ul", "ol", "menu"))
        elif tag in ("dt", "dd"):
            stack.close(("dt", "dd"), ("dl",))
        elif tag in ("tr", "td", "th"):
            stack.close(("tr",) if tag == "tr" else ("td", "th"), ("table",) if tag == "tr" else ("tr", "table"))
        elif tag == "option":
            stack.close(("option",), ("select",))
        node = Node(tag, attrs)
        stack.nodes[-1].kids.append(node)
        if tag in VOID or raw.endswith("/") and tag not in INLINE and tag not in CLOSES_P:
            continue
        if tag in RAW:
            end = re.compile(rf"</{tag}\b[^>]*>?", re.I).search(text, at)
            node.kids.append(text[at : end.start() if end else n])
            at = end.end() if end else n
        else:
            stack.push(node)
    return root


def declared(node: Node, inside: bool, kept: frozenset[int] | set[int] = frozenset()) -> bool:
    """Whether markup says that a node is no main text; inside: within an article; kept: ids of nodes whose names don't count."""
    return stated(node, inside) or id(node) not in kept and bool(named(node))


def stated(node: Node, inside: bool) -> bool:
    """By element, role, or because it is hidden."""
    tag, a = node.tag, node.attrs
    if tag in DROPPED or tag == "header" and not inside:
        return True
    if not a or tag in ("html", "body", "main", "article", "#root"):
        return False
    if a.get("role", "").lower() in ROLES or "hidden" in a or a.get("aria-hidden", "").lower() == "true":
        return True
    return "style" in a and bool(re.search(r"display\s*:\s*none|visibility\s*:\s*hidden", a["style"], re.I))


def named(node: Node) -> set[str]:
    """The NAMES that head a class or id: its last word, words for boxes aside, as in cookie-notice or ad-slot.

    A name before another word (search-story, notice-of-meeting) says what a
    part is about, and what follows a modifier (has-, no-, with-) what a wrapper
    is next to.
    """
    a = node.attrs
    if not a or node.tag in ("html", "body", "main", "article", "#root"):
        return set()
    found = set()
    for name in f"{a.get('class', '')} {a.get('id', '')}".split():
        parts = [x.lower() for x in _PART.findall(name) if not x.isdigit()]
        if MODIFIERS.intersection(parts):
            continue
        while len(parts) > 1 and parts[-1] in BOXES:
            parts.pop()
        if parts and parts[-1] in NAMES:
            found.add(parts[-1])
    return found


def is_main(node: Node) -> bool:
    return node.tag in ("article", "main") or "articlebody" in node.attrs.get("itemprop", "").lower() or node.attrs.get("role", "").lower() == "main"


def wrappers(root: Node, dropped: set[int]) -> set[int]:
    """Ids of nodes that are named as another part but hold the page's main text.

    Such a node holds more than half of the varying text of the article or main
    element around it. Where no such element with text lies outside such nodes,
    it holds one, or more than half of the page's. Comments and related pages
    may be longer than the main text, and hold articles, and stay declared.
    """
    inner: set[int] = set()
    outside = False
    kept: set[int] = set()

    def look(node: Node, hidden: bool, within: list[list]) -> tuple[int, bool]:
        """The varying text below a node, and whether a main element is there."""
        nonlocal outside
        if stated(node, len(within) > 1) or id(node) in dropped:
            return 0, False
        names = named(node)
        if names & LONG:
            return 0, False
        main = is_main(node)
        scope = [*within, []] if main else within
        size, has = 0, main
        for x in node.kids:
            got = (len(x.strip()), False) if isinstance(x, str) else look(x, hidden or bool(names), scope)
            size, has = size + got[0], has or got[1]
        if names:
            scope[-1].append((node, size))
            if has:
                inner.add(id(node))
        outside |= main and not hidden and size > 0
        if main or node is root and not outside:
            kept.update(id(x) for x, n in scope[-1] if 2 * n > size)
        return size, has

    look(root, False, [[]])
    return kept | (set() if outside else inner)


def plain(node: Node | str) -> str:
    """All text below a node, white space as single spaces."""
    out: list[str] = []
    todo = [node]
    while todo:
        x = todo.pop()
        if isinstance(x, str):
            out.append(x)
        elif x.tag not in ("script", "style", "template", "noscript"):
            out.append(" ")
            todo.extend(reversed(x.kids))
    return _SPACE.sub(" ", html.unescape("".join(out))).strip()


class Folded:
    """A page's tree for matching: elements in document order, runs of equal siblings as one."""

    def __init__(self, root: Node):
        self.nodes: list[list[Node]] = []
        self.keys: list[str] = []
        self.kids: list[list[int]] = []
        shape: list[str] = []
        todo: list = [([root], None)]
        while todo:
            run, parent = todo.pop()
            if run is None:
                shape.append(")")
                continue
            me = len(self.nodes)
            self.nodes.append(run)
            self.keys.append(run[0].key)
            self.kids.append([])
            if parent is not None:
                self.kids[parent].append(me)
            shape.append(f"({run[0].key}")
            todo.append((None, None))
            if len(run) > 1:  # a run's inner structure varies with its length
                continue
            runs: list[list[Node]] = []
            for x in run[0].kids:
                if isinstance(x, Node) and x.tag not in INLINE and x.tag not in VOID:
                    if runs and runs[-1][0].key == x.key:
                        runs[-1].append(x)
                    else:
                        runs.append([x])
            todo.extend((r, me) for r in reversed(runs))
        self.shape = "".join(shape)


def tree_match(a: Folded, b: Folded, i: int = 0, j: int = 0) -> tuple[int, list[tuple[int, int]]]:
    """Simple tree matching: the size of the largest order-keeping match below two nodes, and its pairs."""
    if a.keys[i] != b.keys[j]:
        return 0, []
    x, y = a.kids[i], b.kids[j]
    if len(x) * len(y) > CELLS:
        pairs = _divided(a, b, x, y, {})
        return len(pairs) + 1, [(i, j), *pairs]
    best: dict[tuple[int, int], tuple[int, list]] = {}
    table = [[0] * (len(y) + 1) for _ in range(len(x) + 1)]
    for p in range(1, len(x) + 1):
        for q in range(1, len(y) + 1):
            top = max(table[p - 1][q], table[p][q - 1])
            if a.keys[x[p - 1]] == b.keys[y[q - 1]]:
                got = best[p, q] = tree_match(a, b, x[p - 1], y[q - 1])
                top = max(top, table[p - 1][q - 1] + got[0])
            table[p][q] = top
    pairs, p, q = [(i, j)], len(x), len(y)
    while p and q:
        if table[p][q] == table[p - 1][q]:
            p -= 1
        elif table[p][q] == table[p][q - 1]:
            q -= 1
        else:
            pairs += best[p, q][1]
            p, q = p - 1, q - 1
    return table[-1][-1] + 1, pairs


def _divided(a: Folded, b: Folded, x: list[int], y: list[int], known: dict) -> list[tuple[int, int]]:
    """The pairs of the best order-keeping match of very many siblings: halves of x, met where their best sizes add up to most."""

    def size(p: int, q: int) -> int:
        if a.keys[p] != b.keys[q]:
            return 0
        if (p, q) not in known:
            known[p, q] = tree_match(a, b, p, q)[0]
        return known[p, q]

    def last_row(ps: list[int], qs: list[int]) -> np.ndarray:
        row = np.zeros(len(qs) + 1, np.int64)
        for p in ps:
            row[1:] = np.maximum(row[1:], row[:-1] + np.array([size(p, q) for q in qs], np.int64))
            np.maximum.accumulate(row, out=row)
        return row

    if not x or not y:
        return []
    if len(x) == 1:
        sizes = [size(x[0], q) for q in y]
        best = max(range(len(y)), key=sizes.__getitem__)
        return tree_match(a, b, x[0], y[best])[1] if sizes[best] else []
    mid = len(x) // 2
    cut = int((last_row(x[:mid], y) + last_row(x[mid:][::-1], y[::-1])[::-1]).argmax())
    return _divided(a, b, x[:mid], y[:cut], known) + _divided(a, b, x[mid:], y[cut:], known)


def template(pages: list[Folded]) -> list[set[int]]:
    """For each page the ids of nodes whose text is the template's: single nodes, and members of runs."""
    ref = max(pages, key=lambda f: (len(f.nodes), f.shape))
    maps: dict[str, list[tuple[int, int]]] = {}
    texts: list[Counter] = [Counter() for _ in ref.nodes]
    seen = [0] * len(ref.nodes)
    own: list[dict[int, list[tuple[int, str]]]] = []
    mains = set()
    for f in pages:
        if f.shape not in maps:
            maps[f.shape] = [(k, k) for k in range(len(ref.nodes))] if f.shape == ref.shape else tree_match(ref, f)[1]
        mine = {r: [(id(x), plain(x)) for x in f.nodes[k]] for r, k in maps[f.shape] if not f.kids[k]}
        own.append(mine)
        main = "\n".join(plain(x) for x in region(f.nodes[0][0], set()))
        if main in mains:  # pages with the same main text say nothing about what is constant
            continue
        mains.add(main)
        for r, members in mine.items():
            seen[r] += 1
            texts[r].update({t for _, t in members if t})
    constant = [{t for t, k in c.items() if k >= SAME_PAGES and k >= SAME_PART * n} for c, n in zip(texts, seen, strict=True)]
    out = []
    for f, mine in zip(pages, own, strict=True):
        drop = {}
        for r, members in mine.items():
            drop |= {x: len(t) for x, t in members if t in constant[r]}
        out.append(_own_kept(f.nodes[0][0], drop))
    return out


def _own_kept(root: Node, drop: dict[int, int]) -> set[int]:
    """The nodes to drop; those in a main text most of which would go with them are its own, on a copy of a page, and stay."""
    out = set(drop)
    for main in region(root, set()):
        if main.tag not in ("article", "main") and "itemprop" not in main.attrs:
            continue
        inside, todo = {}, [main]
        while todo:
            x = todo.pop()
            if isinstance(x, Node):
                if id(x) in drop:
                    inside[id(x)] = drop[id(x)]
                else:
                    todo.extend(x.kids)
        if 2 * sum(inside.values()) > len(plain(main)):
            out -= set(inside)
    return out


def region(root: Node, dropped: set[int], kept: frozenset[int] | set[int] = frozenset()) -> list[Node]:
    """Where the main text is: articles, else main, else the subtree that gathers most of the varying text."""
    found: dict[str, list[Node]] = {"article": [], "body": [], "main": []}
    sizes: dict[int, int] = {}

    def look(node: Node) -> int:
        if declared(node, False, kept) or id(node) in dropped:
            return 0
        if node.tag == "article":
            found["article"].append(node)
        elif "articlebody" in node.attrs.get("itemprop", "").lower():
            found["body"].append(node)
        elif node.tag == "main" or node.attrs.get("role", "").lower() == "main":
            found["main"].append(node)
        total = 0
        for x in node.kids:
            total += len(x.strip()) if isinstance(x, str) else look(x) if node.tag != "article" else len(plain(x))
        sizes[id(node)] = total
        return total

    look(root)
    for kind in ("body", "article", "main"):
        if any(sizes.get(id(x)) for x in found[kind]):
            return found[kind]
    node = root
    while True:
        kids = [x for x in node.kids if isinstance(x, Node) and sizes.get(id(x))]
        top = max(kids, key=lambda x: sizes[id(x)], default=None)
        if top is None or top.tag in INLINE or top.tag in ("p", "ul", "ol", "table", "blockquote", "pre") or sizes[id(top)] < 0.7 * sizes[id(node)]:
            return [node]
        node = top


#: Links of a block, and items of a list, from which text that is nearly all links is a menu.
MENU_LINKS = 3


def menus(node: Node) -> set[int]:
    """Lists of MENU_LINKS items and more, each of them a link and hardly anything else."""
    out: set[int] = set()
    todo = [node]
    while todo:
        x = todo.pop()
        kids = [k for k in x.kids if isinstance(k, Node)]
        items = [k for k in kids if k.tag == "li"]
        if x.tag in ("ul", "ol", "menu") and len(items) >= MENU_LINKS and all(mostly_linked(k) for k in items):
            out.add(id(x))
        else:
            todo += kids
    return out


def mostly_linked(node: Node) -> bool:
    """Whether a subtree has text, more than half of it inside links."""
    total = linked = 0
    todo: list = [(node, node.tag == "a")]
    while todo:
        x, inside = todo.pop()
        for k in x.kids:
            if isinstance(k, str):
                total += len(k.strip())
                linked += len(k.strip()) if inside else 0
            elif k.tag not in RAW:
                todo.append((k, inside or k.tag == "a"))
    return 2 * linked > total > 0


def blocks(node: Node, dropped: set[int], guessed: bool, kept: frozenset[int] | set[int] = frozenset()) -> list[str]:
    """The blocks of a subtree in page order; guessed: without blocks of several links and little else, and lists of links.

    A headline or a paragraph that is one link stays.
    """
    out: list[str] = []
    run: list[str] = []
    linked = links = 0
    dropped = dropped | menus(node) if guessed else dropped

    def flush() -> None:
        nonlocal linked, links
        text = _SPACE.sub(" ", html.unescape("".join(run))).strip()
        if text and not (guessed and links >= MENU_LINKS and 2 * linked > len(text)):
            out.append(text)
        run.clear()
        linked = links = 0

    todo: list = [node]
    inside_a = 0
    while todo:
        x = todo.pop()
        if isinstance(x, str):
            run.append(x)
            linked += len(x.strip()) if inside_a else 0
        elif isinstance(x, tuple):
            if x[0] == "block":
                flush()
            else:
                inside_a -= 1
        elif x is not node and (id(x) in dropped or declared(x, True, kept)):
            if x.tag not in INLINE:
                flush()
        elif x.tag == "br":
            run.append(" ")
        elif x.tag not in VOID:
            if x.tag not in INLINE:
                flush()
                todo.append(("block",))
            elif x.tag == "a":
                inside_a += 1
                links += 1
                todo.append(("link",))
            todo.extend(reversed(x.kids))
        elif x.tag == "hr":
            flush()
    flush()
    return out


def extract(pages: list[str]) -> list[str]:
    """The main texts of pages of one host."""
    roots = [parse(p) for p in pages]
    drops = template([Folded(r) for r in roots]) if len(roots) >= SAME_PAGES else [set() for _ in roots]
    out = []
    for root, dropped in zip(roots, drops, strict=True):
        kept = wrappers(root, dropped)
        parts = region(root, dropped, kept)
        guessed = parts[0].tag not in ("article", "main") and "itemprop" not in parts[0].attrs
        out.append("\n\n".join(b for part in parts for b in blocks(part, dropped, guessed, kept)))
    return out


def main_text(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """(page_id, url, text, n_chars) for every row.

    Null and empty pages, and pages without main text, give an empty text. A
    null or odd url counts as a host of its own name. Rows that repeat an id are
    pages of their own. Pages of a host are read in the order of their ids,
    ALIGNED at a time, so a host of any size needs bounded memory; the last two
    batches are of even size, so that only hosts with fewer than SAME_PAGES
    pages go without alignment. A host with more than SHARE pages is dealt by
    a hash of the id to as many tasks as its size asks for, whatever other hosts
    the table holds. Other columns are not read; an empty table gives an empty
    table.
    """
    spark = pages.sparkSession
    arrow_rows(spark)
    host = F.coalesce(F.lower(F.regexp_extract(F.col(url_col), r"^[a-zA-Z][a-zA-Z0-9+.-]*://([^/?#]*)", 1)), F.lit(""))
    rows = pages.select(F.col(id_col).cast("long").alias("page_id"), F.col(url_col).alias("url"), F.coalesce(F.col(html_col), F.lit("")).alias("html"), host.alias("host"))
    large = written(rows.groupBy("host").count().where(F.col("count") > SHARE).select("host", F.ceil(F.col("count") / SHARE).cast("int").alias("shares")), "hosts")
    few = large.count() <= SENT_HOSTS
    def pack(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        z = zstandard.ZstdCompressor(level=3)
        for f in frames:
            yield f.assign(html=[z.compress(h.encode()) for h in f["html"]])

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        z = zstandard.ZstdDecompressor()
        at, buffer = None, []

        def done(buffer: list) -> pd.DataFrame:
            texts = extract([z.decompress(h).decode() for *_, h in buffer])
            return pd.DataFrame({"page_id": [b[0] for b in buffer], "url": [b[1] for b in buffer], "text": texts, "n_chars": [len(t) for t in texts]}).astype({"page_id": "Int64"})

        def rest() -> Iterator[pd.DataFrame]:
            """What a host's full batches leave, in two even ones if it is more than one."""
            half = len(buffer) if len(buffer) <= ALIGNED else len(buffer) // 2
            yield done(buffer[:half])
            if half < len(buffer):
                yield done(buffer[half:])

        for f in frames:
            for page, url, host_name, salted, packed in zip(f["page_id"], f["url"], f["host"], f["salt"], f["html"], strict=True):
                if buffer and (host_name, salted) != at:
                    yield from rest()
                    buffer = []
                elif len(buffer) >= 2 * ALIGNED:
                    yield done(buffer[:ALIGNED])
                    buffer = buffer[ALIGNED:]
                at = (host_name, salted)
                buffer.append((None if pd.isna(page) else int(page), url, bytes(packed)))
        if buffer:
            yield from rest()

    packed = rows.mapInPandas(pack, "page_id long, url string, html binary, host string")
    packed = packed.join(F.broadcast(large) if few else large, "host", "left")
    packed = packed.withColumn("salt", F.pmod(F.xxhash64("page_id"), F.coalesce("shares", F.lit(1))).cast("int")).drop("shares")
    dealt = packed.repartition("host", "salt").sortWithinPartitions("host", "salt", "page_id", "url")
    return dealt.mapInPandas(run, "page_id long, url string, text string, n_chars long")
