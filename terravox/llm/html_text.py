"""Main text of web pages by a site style tree.

The DOM trees of one host are merged by path (tag, class, id and role of every element from the root, and its number among
its parent's children of that kind), so a node of the site tree knows in how many pages it stands, in which presentations (the
tags of its children) and with which contents (the text of its branch). Both distributions have an entropy, scaled to 0..1 by
the number of pages; with l presentations and g = 0.9 a node's importance is (1 - g**l) * H(presentation) + g**l * H(content).
Nodes are scored everywhere, inside ``article`` and ``main`` too: boxes that a host repeats have low entropies, and their
branches are removed from every page of the host.

What a node is called is a prior: a tag or class that names page furniture halves the importance (a header inside ``article``
or ``main`` is none), and so does standing outside them on pages that have one. Where a host has fewer than ``MIN_PAGES`` pages with a
node, the prior stands alone: furniture goes, and in a host that small ``article`` and ``main`` are the text if they hold half of what is
left. Elements that are not shown as text, and comments of readers (as new on each page as the text is), are settled by name.

Pages of one host whose ``article`` and ``main`` (or else all) text agree are copies and count once in the tree, so that a text put up
often is not taken for a menu; a page that the tree would leave empty gives what the prior alone leaves.

One row per page and path is shuffled, with hashes, and never by host alone, so a host with a third of all pages loads no single
task. The paths of all hosts that settle something go to every task while they are few; else pages are dealt by host and salt.

Edge cases: null or empty html gives an empty text; a null url is a host of its own; tags may be unclosed or badly nested;
repeated rows are returned each.
"""

from __future__ import annotations

import html
import re
import zlib

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from terravox.llm.common import small, written
from terravox.ship import ship

MIN_PAGES, LEAST, GAMMA = 8, 0.3, 0.9
#: What a prior against a node leaves of its importance: furniture by name, and outside article and main.
NAMED, OUTSIDE = 0.5, 0.5
#: Paths that settle something are sent to all tasks up to this number (8 bytes each); beyond it pages are joined by host and salt.
BROADCAST_PATHS, SALTS = 500_000, 32

_NAME = re.compile(r"</?([a-zA-Z][^\s/>]*)")
#: The attributes of a tag up to its end; quoted values may hold ">". Nothing is tried twice, so a tag costs its own length.
_REST = re.compile(r"((?:[^>\"']++|\"[^\"]*+\"|'[^']*+')*+)>")
_MARK = re.compile(r"(?:^|[\s\"'/])(class|id|role)\s*=\s*(\"[^\"]*\"|'[^']*'|[^\s>\"']+)", re.IGNORECASE)
_HOST = re.compile(r"^(?:[a-zA-Z][a-zA-Z0-9+.-]*:)?//(?:[^/?#@]*@)?([^/?#:]*)")

# Element kinds of the HTML standard.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea title xmp iframe noembed noframes".split())
INLINE = frozenset("a abbr acronym b bdi bdo big cite code data del dfn em font i img ins kbd label mark q rp rt ruby s samp small span strike strong sub sup time tt u var wbr".split())
CLOSES_P = frozenset("address article aside blockquote center details dialog dir div dl fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr main menu nav ol p pre search section summary table ul".split())
BARRIERS = frozenset("button table td th".split())
SIBLINGS = {"li": ({"li"}, {"ul", "ol", "menu"}), "dt": ({"dt", "dd"}, {"dl"}), "dd": ({"dt", "dd"}, {"dl"}), "tr": ({"tr", "td", "th"}, {"table"}), "td": ({"td", "th"}, {"tr", "table"}), "th": ({"td", "th"}, {"tr", "table"}), "option": ({"option"}, {"select"})}
_RAW_END = {tag: re.compile(rf"</{tag}(?=[\s/>]|\Z)(?:[^>]*>|[^>]*\Z)", re.IGNORECASE) for tag in RAW}
UNSEEN = frozenset("script style noscript template iframe select textarea svg canvas title head object audio video".split())
FURNITURE_TAGS = frozenset("nav footer aside form button dialog menu".split())
FURNITURE_NAMES = frozenset("ad ads adv advert adverts advertisement advertising banner breadcrumb breadcrumbs consent cookie cookies footer header masthead menu modal nav navbar navigation newsletter notice notices popup promo promoted related share sharing sidebar social sponsor sponsored subscribe toolbar widget".split())
HEADERS = frozenset("header masthead".split())
COMMENTS = frozenset("comment comments comment-list commentlist comments-area disqus disqus_thread reply replies respond".split())
MAIN = frozenset(("article", "main"))


def host_of(url: str | None) -> str:
    m = _HOST.match(url or "")
    return m[1].lower() if m else ""


def marks(attributes: str) -> tuple[str, list[str], bool]:
    """Class, id and role of a start tag: as one string, split into lower-case names, and whether one of them names comments."""
    found = [(k.lower(), v.strip("\"'").lower()) for k, v in _MARK.findall(attributes)] if "=" in attributes else []
    names = [n for _, v in found for n in re.split(r"[^a-z]+", v) if n]
    return "".join(f".{k[0]}:{v}" for k, v in found), names, any(not COMMENTS.isdisjoint(v.split()) for _, v in found)


class Node:
    __slots__ = ("tag", "path", "gone", "main", "named", "style", "content", "kinds")

    def __init__(self, tag: str, path: int, gone: bool, main: bool, named: bool):
        self.tag, self.path, self.gone, self.main, self.named = tag, path, gone, main, named
        self.style = self.content = 0
        self.kinds: dict[str, int] = {}


def walk(page: str, low: frozenset = frozenset(), high: frozenset = frozenset(), close=None) -> tuple[str, str]:
    """Reads a page once; returns the text of its main elements, and that of all kept branches.

    low: paths of branches to remove; high: paths to keep in spite of their names; close(node) is called for every
    element that ends, and last for the root.
    """
    root = Node("", 0, False, False, False)
    stack = [root]
    blocks: list[tuple[str, bool]] = []
    line: list[str] = []
    line_main = False

    def flush():
        if line:
            if words := "".join(line).split():
                blocks.append((" ".join(words), line_main))
            line.clear()

    open_at: dict[str, list[int]] = {}

    def deepest(tags) -> int:
        """Where on the stack the innermost open element of these tags is; 0 if none is open."""
        return max((open_at[t][-1] for t in tags if open_at.get(t)), default=0)

    def close_to(depth: int):
        while depth and len(stack) > depth:
            pop()

    def pop():
        node = stack.pop()
        open_at[node.tag].pop()
        stack[-1].content += node.content
        if close:
            close(node)

    def text(raw: str):
        nonlocal line_main
        top = stack[-1]
        said = html.unescape(raw) if "&" in raw else raw
        if close:
            if words := said.split():
                top.content += zlib.crc32(" ".join(words).encode("utf-8", "replace")) * 2654435761 + 1
        if not top.gone:
            if top.main != line_main:
                flush()
                line_main = top.main
            line.append(said)

    at, end, quotes = 0, len(page), True
    while at < end:
        begin = page.find("<", at)
        if begin < 0:
            text(page[at:])
            break
        name = _NAME.match(page, begin)
        if name is None:
            after = page[begin + 1 : begin + 2]
            if after not in ("!", "?"):
                # A "<" that begins no tag is text; so is what comes before it.
                text(page[at : begin + 1])
                at = begin + 1
                continue
            if begin > at:
                text(page[at:begin])
            if page.startswith("<![CDATA[", begin):
                stop = page.find("]]>", begin)
                text(page[begin + 9 : stop if stop >= 0 else end])
            else:
                stop = page.find("-->", begin + 4) if page.startswith("<!--", begin) else page.find(">", begin)
            at = end if stop < 0 else stop + (1 if page[stop] == ">" else 3)
            continue
        rest = _REST.match(page, name.end()) if quotes else None
        if rest is None:
            # A quote that never closes: from here on tags end at the next ">", so that no later tag looks for its end again.
            quotes = False
            stop = page.find(">", name.end())
            if stop < 0:
                text(page[at:])
                break
            rest_text, then = page[name.end() : stop], stop + 1
        else:
            rest_text, then = rest[1], rest.end()
        if begin > at:
            text(page[at:begin])
        at, slash, tag, rest = then, page[begin + 1] == "/", name[1], rest_text
        tag = tag.lower()
        if tag not in INLINE:
            flush()
        if slash:
            close_to(deepest((tag,)))
            continue
        if tag in CLOSES_P:
            depth = deepest(("p",))
            if depth > deepest(BARRIERS):
                close_to(depth)
        elif tag in SIBLINGS:
            ends, stops = SIBLINGS[tag]
            depth = deepest(ends)
            if depth > deepest(stops):
                close_to(depth)
        top = stack[-1]
        label, names, others = marks(rest) if rest else ("", (), False)
        top.style = (top.style * 31 + zlib.crc32(tag.encode())) & 0x7FFFFFFF
        if tag in VOID:
            continue
        kind = tag + label
        number = top.kinds[kind] = top.kinds.get(kind, -1) + 1
        path = zlib.crc32(f"{top.path:x}/{kind}#{number}".encode("utf-8", "replace"))
        main = top.main or tag in MAIN
        page_itself = tag in ("body", "html")
        furniture = not page_itself and (tag in FURNITURE_TAGS or (tag == "header" and not top.main) or any(n in FURNITURE_NAMES and not (main and n in HEADERS) for n in names))
        gone = top.gone or tag in UNSEEN or (others and not page_itself) or path in low or (furniture and path not in high)
        node = Node(tag, path, gone, main, furniture)
        open_at.setdefault(tag, []).append(len(stack))
        stack.append(node)
        if tag in RAW:
            m = _RAW_END[tag].search(page, at)
            at = end if m is None else m.end()
            pop()
        elif rest.endswith("/") and tag in ("svg", "path"):
            pop()
    flush()
    while len(stack) > 1:
        pop()
    if close:
        close(root)
    return " ".join(t for t, main in blocks if main), " ".join(t for t, _ in blocks)


def site_tree(pages: DataFrame) -> DataFrame:
    """(host, path, n_pages, importance, named, outside) of every node; pages: host, html.

    named: page furniture by its name; outside: share of its pages in which it stands outside an article or main.
    """

    def run(batches):
        for batch in small(batches):
            cols: tuple[list, ...] = ([], [], [], [], [], [], [])
            for host, page in zip(batch.column("host").to_pylist(), batch.column("html").to_pylist()):
                nodes: list[tuple] = []
                whole: list[int] = []
                mains: list[int] = []

                def close(node, nodes=nodes, whole=whole, mains=mains):
                    if not node.tag:
                        whole.append(node.content)
                    elif node.tag not in UNSEEN and node.tag not in ("html", "body"):
                        nodes.append((node.path, node.style, node.content & 0x7FFFFFFFFFFFFFFF, node.named, not node.main))
                        if node.tag in MAIN:
                            mains.append(node.content)

                walk(page, close=close)
                key = sum(mains) if any(mains) else whole[0]
                key &= 0x7FFFFFFFFFFFFFFF
                for path, style, content, named, outside in nodes:
                    for c, v in zip(cols, (host, path, key, style, content, named, outside and any(mains))):
                        c.append(v)
            kinds = (pa.string(), pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.bool_(), pa.bool_())
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, kinds)], names=["host", "path", "page", "style", "content", "named", "outside"])

    nodes = pages.select("host", "html").mapInArrow(run, "host string, path long, page long, style long, content long, named boolean, outside boolean")
    # Copies of a page count once.
    once = nodes.groupBy("host", "path", "page").agg(F.min(F.struct("style", "content")).alias("v"), F.max("named").alias("named"), F.max("outside").alias("outside"))
    both = once.select("host", "path", "named", "outside", F.explode(F.array(F.struct(F.lit(0).alias("what"), F.col("v.style").alias("value")), F.struct(F.lit(1).alias("what"), F.col("v.content").alias("value")))).alias("x"))
    counts = both.groupBy("host", "path", "x.what", "x.value").agg(F.count("*").alias("k"), F.max("named").alias("named"), F.count_if("outside").alias("out"))
    style, content = F.col("what") == 0, F.col("what") == 1
    k_log_k = F.col("k") * F.log(F.col("k").cast("double"))
    merged = counts.groupBy("host", "path").agg(
        F.sum(F.when(style, F.col("k"))).alias("n_pages"), F.count(F.when(style, 1)).alias("styles"),
        F.sum(F.when(style, k_log_k)).alias("s"), F.sum(F.when(content, k_log_k)).alias("c"),
        F.max("named").alias("named"), F.sum(F.when(style, F.col("out"))).alias("out"))
    n = F.col("n_pages")
    entropy = lambda x: F.when(n > 1, F.greatest(F.lit(0.0), 1 - F.col(x) / (n * F.log(n.cast("double"))))).otherwise(1.0)
    share = F.pow(F.lit(GAMMA), F.col("styles"))
    return merged.select("host", "path", "n_pages", ((1 - share) * entropy("s") + share * entropy("c")).alias("importance"), "named", (F.col("out") / n).alias("outside"))


def main_text(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html", least: float = LEAST, min_pages: int = MIN_PAGES) -> DataFrame:
    """(page_id, url, text, n_chars), one row per page."""
    ship(pages.sparkSession)

    def hosts(batches):
        for batch in batches:
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array([host_of(u) for u in batch.column(1).to_pylist()], pa.string())], names=["id", "url", "html", "host"])

    picked = pages.select(F.col(id_col).cast("long").alias("id"), F.col(url_col).cast("string").alias("url"), F.coalesce(F.col(html_col), F.lit("")).alias("html"))
    known = picked.mapInArrow(hosts, "id long, url string, html string, host string")
    prior = F.when(F.col("named"), NAMED).otherwise(1.0) * (1 - (1 - OUTSIDE) * F.col("outside"))
    told = site_tree(known).filter(F.col("n_pages") >= min_pages).withColumn("low", F.col("importance") * prior < least)
    low = told.groupBy("host").agg(*[F.sort_array(F.collect_list(F.when(x, F.col("path")))).alias(c) for c, x in (("low", F.col("low")), ("high", F.col("named") & ~F.col("low")))])

    def run(batches):
        for batch in small(batches):
            out, sets = [], {}
            for page, host, low, high in zip(*(batch.column(c).to_pylist() for c in ("html", "host", "low", "high"))):
                if host not in sets:
                    sets[host] = frozenset(low or ()), frozenset(high or ())
                main, text = walk(page, *sets[host])
                told = low is not None
                if not text and told:
                    (main, text), told = walk(page), False
                out.append(main if not told and 2 * len(main) >= len(text) else text)
            yield pa.RecordBatch.from_arrays([batch.column("id"), batch.column("url"), pa.array(out, pa.string()), pa.array([len(t) for t in out], pa.int64())], names=["page_id", "url", "text", "n_chars"])

    low = written(low, "low-paths")
    if (low.agg(F.sum(F.size("low") + F.size("high"))).first()[0] or 0) <= BROADCAST_PATHS:
        joined = known.join(F.broadcast(low), "host", "left")
    else:
        dealt = low.withColumn("salt", F.explode(F.array(*map(F.lit, range(SALTS)))))
        joined = known.withColumn("salt", F.pmod(F.xxhash64("id", "url"), F.lit(SALTS)).cast("int")).join(dealt, ["host", "salt"], "left")
    return joined.select("id", "url", "html", "host", "low", "high").mapInArrow(run, "page_id long, url string, text string, n_chars long")
