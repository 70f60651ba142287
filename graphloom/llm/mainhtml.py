"""Main text of web pages by a consensus of container paths for each host.

Each page's containers are scored by the text that stands directly in them,
less what is link text, with a share of the containers below. The page votes
for its best ``votes`` containers, named by a generalised path of tags and classes
(digits become '#'); votes are summed for each host and path in Spark. Pages
are then read again with their host's first ``kept`` paths in order of votes: the first that
the page has gives the text, from all of its containers on that path. A page
with none of them uses its own best.

Left out wherever they stand: scripts, styles, forms, menus, headers, footers,
sidebars, notices, adverts and reader comments, by tag, role or a class or id
that names them. End tags that HTML lets out are implied. Character references are decoded; block tags and line breaks
separate words, other tags don't.

Null or empty pages give an empty text. A null or odd url belongs to the host
''. Repeated rows keep their rows; ties go to the longer text, then to the path
first in order. Other columns are ignored. An empty table gives an empty
result. Pages have no length limit, and text outside the choice of container
is never cut.
"""

from __future__ import annotations

import html
import re
from collections import defaultdict
from collections.abc import Iterator
from dataclasses import dataclass, field

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import materialize

# Tags of HTML by what they do here.
RAW = frozenset("script style noscript template svg iframe object textarea title xmp canvas video audio".split())
SKIP = frozenset("head nav header footer aside form button select dialog menu fieldset".split())
CONTAINERS = frozenset("html body div article main section td center".split())
INLINE = frozenset("a abbr acronym b bdi bdo big cite code data del dfn em font i img ins kbd label mark q s samp small span strike strong sub sup time tt u var wbr".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
#: Words of a class or id that mark what isn't the article.
BOILERPLATE = frozenset(
    "ad ads advert advertisement adverts advertising banner breadcrumb breadcrumbs byline-social comment comments commentlist consent cookie cookies cta disclaimer disqus footer gdpr header login masthead menu menubar "
    "modal nav navbar navigation newsletter notice notices notification outbrain overlay pager pagination paywall popup promo promotion recommended related replies reply respond rss share sharing sidebar signup skip skyscraper social sponsor sponsored subscribe taboola toolbar widget widgets".split()
)
ROLES = frozenset("navigation banner contentinfo complementary search dialog alert alertdialog menu menubar".split())
#: Words before which a class says what its page has, not what it is.
ABOUT = frozenset("has have with no not non without hide show is are uses after before below above until".split())
# Tags whose end may be left out; what ends them, up to which tags.
P_ENDS = frozenset("address article aside blockquote center details dialog dir div dl fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr main menu nav ol p pre search section summary table ul".split())
ROW_PARTS, CELLS = frozenset(("tr", "td", "th")), frozenset(("td", "th"))
IMPLIED = {
    "li": (frozenset(("li",)), frozenset(("ul", "ol", "menu"))),
    "dt": (frozenset(("dt", "dd")), frozenset(("dl",))),
    "dd": (frozenset(("dt", "dd")), frozenset(("dl",))),
    "tr": (ROW_PARTS, frozenset(("table",))),
    "tbody": (ROW_PARTS | {"thead", "tbody"}, frozenset(("table",))),
    "td": (CELLS, frozenset(("tr", "table"))),
    "th": (CELLS, frozenset(("tr", "table"))),
    "option": (frozenset(("option",)), frozenset(("select", "datalist"))),
}
#: An end tag doesn't reach beyond these, save those of tables.
WALLS = frozenset("table td th".split())
#: Words that speak for a container.
GOOD = frozenset("article articlebody body content entry main post story text".split())

TOKEN = re.compile(r"<!--.*?(?:-->|\Z)|<!\[CDATA\[.*?(?:\]\]>|\Z)|<[!?][^>]*>|<(/?)([a-zA-Z][^\s/>]*)((?:[^>\"']|\"[^\"]*\"|'[^']*')*)>", re.S)
LOOSE = re.compile(r"<(/?)([a-zA-Z][^\s/>]*)([^>]*)>")
#: One attribute after another, so that a name inside a value isn't taken for one.
ATTRIBUTE = re.compile(r"([^\s=/>\"']+)(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+)))?")
CAMEL = re.compile(r"(?<=[a-z])(?=[A-Z])")


@dataclass
class Node:
    """An open or closed container."""

    path: str
    parent: int
    good: bool
    direct: int = 0
    link: int = 0
    total: int = 0
    pieces: list = field(default_factory=list)


def boilerplate(name: str) -> bool:
    """True if a class or id names what isn't the article.

    The name as a whole, its first or its last part does so: 'sidebar-left',
    'site_footer'; but not 'has-sidebar' or 'no-comments'.
    """
    parts = [re.sub(r"\d+$", "", w) for w in re.split(r"[-_]+", CAMEL.sub("-", name).lower())]
    parts = [w for w in parts if w]
    if not parts or ABOUT & set(parts[:-1]):
        return False
    return "-".join(parts) in BOILERPLATE or parts[0] in BOILERPLATE or parts[-1] in BOILERPLATE


def _marks(attributes: str) -> tuple[str, set[str], bool]:
    """Class text, words of class and id, left out."""
    classes, found, out = "", set(), False
    seen = set()
    for m in ATTRIBUTE.finditer(attributes):
        name, value = m[1].lower(), m[2] or m[3] or m[4] or ""
        if name in seen:
            continue  # the first of equal attributes counts
        seen.add(name)
        if name in ("class", "id"):
            if name == "class":
                classes = value
            for w in value.split():
                out = out or boilerplate(w)
                found.update(re.split(r"[-_\d]+", CAMEL.sub("-", w).lower()))
        elif name == "role":
            out = out or value.strip().lower() in ROLES
        elif name == "hidden":
            out = True
        elif name == "aria-hidden":
            out = out or value.strip().lower() == "true"
    return classes, found, out


def step_of(tag: str, classes: str) -> str:
    """A tag with its classes, digits generalised."""
    own = sorted({re.sub(r"\d+", "#", c.lower()) for c in classes.split()})
    return ".".join([tag, *own])


def parse(page: str | None) -> list[Node]:
    """Containers in page order; pieces are (order, text) of their own."""
    page = page or ""
    nodes = [Node("", -1, False)]
    stack: list[tuple[str, int, bool]] = [("", 0, False)]  # tag, node, left out
    at, in_link, order = 0, 0, 0

    def text(raw: str) -> None:
        nonlocal order
        if not raw or stack[-1][2]:
            return
        value = html.unescape(raw) if "&" in raw else raw
        node = nodes[stack[-1][1]]
        node.pieces.append((order, value))
        order += 1
        n = len(value) - value.count(" ") if value.strip() else 0
        node.direct += n
        if in_link:
            node.link += n

    def gap() -> None:
        nonlocal order
        if not stack[-1][2]:
            nodes[stack[-1][1]].pieces.append((order, " "))
            order += 1

    while True:
        lt = page.find("<", at)
        if lt < 0:
            text(page[at:])
            break
        m = TOKEN.match(page, lt) or LOOSE.match(page, lt)
        if m is None:
            # A '<' that opens nothing is text.
            text(page[at : lt + 1])
            at = lt + 1
            continue
        text(page[at:lt])
        at = m.end()
        if m[2] is None:
            continue
        tag = m[2].lower()
        if tag == "a":
            in_link = 0 if m[1] else 1
        if tag in RAW:
            if not m[1] and not m[3].endswith("/"):
                end = re.compile(rf"</{re.escape(tag)}\b[^>]*>", re.I).search(page, at)
                at = end.end() if end else len(page)
            continue
        if tag not in INLINE:
            gap()
        if m[1]:
            for k in range(len(stack) - 1, 0, -1):
                if stack[k][0] == tag:
                    del stack[k:]
                    if tag not in INLINE:
                        gap()
                    break
                if stack[k][0] in WALLS and tag not in ("table", "tr", "td", "th", "tbody", "thead", "tfoot", "body", "html") or tag in INLINE and stack[k][0] in CONTAINERS:
                    break
            continue
        if tag in IMPLIED or tag in P_ENDS:
            ends, until = IMPLIED.get(tag, (("p",), CONTAINERS | WALLS))
            lowest = 0
            for k in range(len(stack) - 1, 0, -1):
                if stack[k][0] in ends:
                    lowest = k
                elif stack[k][0] in until:
                    break
            if lowest:
                del stack[lowest:]
                gap()
        if tag in VOID or m[3].endswith("/"):
            continue
        if tag == "body":
            while stack[-1][0] == "head":
                stack.pop()
        out = stack[-1][2] or tag in SKIP
        classes = ""
        if not out and m[3].strip():
            classes, words, marked = _marks(m[3])
            out = marked and tag not in ("html", "body", "main")
        else:
            words = set()
        if tag in CONTAINERS:
            if not out:
                nodes.append(Node(f"{nodes[stack[-1][1]].path}>{step_of(tag, classes)}", stack[-1][1], tag in ("article", "main") or bool(words & GOOD)))
                stack.append((tag, len(nodes) - 1, False))
            else:
                stack.append((tag, stack[-1][1], True))
        elif out or tag in ("ul", "ol", "dl", "table", "span"):
            stack.append((tag, stack[-1][1], out))
    for i in range(len(nodes) - 1, -1, -1):
        nodes[i].total += nodes[i].direct
        if nodes[i].parent >= 0:
            nodes[nodes[i].parent].total += nodes[i].total
    return nodes


def scores(nodes: list[Node]) -> dict[str, float]:
    """Score of each path on a page."""
    direct = [max(0.0, n.direct - 2.0 * n.link) for n in nodes]
    own = defaultdict(float)
    for n, d in zip(nodes, direct):
        weight, i = 1.0, n
        while True:
            own[i.path] += weight * d * (1.5 if i.good else 1.0)
            if i.parent < 0:
                break
            i, weight = nodes[i.parent], weight / 2
    total: dict[str, int] = defaultdict(int)
    for n in nodes:
        total[n.path] += n.total
    out = dict(own)
    # A path that misses much of its parent's text gives way to the parent.
    for n in nodes:
        if n.parent >= 0 and not n.good and n.path:
            up = nodes[n.parent].path
            if total[n.path] and total[up] > 1.25 * total[n.path] and up:
                out[up] = max(out[up], out[n.path] * 1.01)
    out.pop("", None)
    return {p: s for p, s in out.items() if s > 0} or ({"": float(total[""])} if total[""] else {})


def extract(nodes: list[Node], path: str) -> str:
    """Text of all containers on a path, with what stands in them."""
    chosen = [n.path == path for n in nodes]
    for i, n in enumerate(nodes):
        chosen[i] = chosen[i] or (n.parent >= 0 and chosen[n.parent])
    pieces = sorted(x for n, c in zip(nodes, chosen) if c for x in n.pieces)
    return " ".join("".join(t for _, t in pieces).split())


def main_text(page: str | None, paths: list[str]) -> tuple[str, str]:
    """Text and the path it came from."""
    nodes = parse(page)
    have = {n.path for n in nodes if n.total}
    for p in paths:
        if p in have:
            return extract(nodes, p), p
    own = scores(nodes)
    if not own:
        return "", ""
    best = max(own, key=lambda p: (own[p], -len(p), p))
    return extract(nodes, best), best


def host_of(url_col: str):
    return F.coalesce(F.regexp_extract(F.lower(F.col(url_col)), r"^[a-z][a-z0-9+.-]*://(?:[^/@?#]*@)?([^/?#:]*)", 1), F.lit(""))


def host_paths(pages: DataFrame, url_col: str = "url", html_col: str = "html", votes: int = 3, kept: int = 8) -> DataFrame:
    """Per host the paths in order of votes, at most ``kept``.

    A page gives its best ``votes`` paths their share of its best score. Votes
    are summed before and after the shuffle, so a host with a third of all
    pages costs one row a path and task.
    """

    def vote(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows: dict[tuple[str, str], list[float]] = defaultdict(lambda: [0.0, 0])
            for host, page in zip(batch["host"], batch["html"]):
                own = scores(parse(page))
                top = sorted(own, key=lambda p: (-own[p], p))[:votes]
                for p in top:
                    rows[host, p][0] += own[p] / own[top[0]] if p == top[0] else 0.5 * own[p] / own[top[0]]
                    rows[host, p][1] += 1
            yield pd.DataFrame([(h, p, s, n) for (h, p), (s, n) in rows.items()], columns=["host", "path", "vote", "pages"])

    cast = pages.select(host_of(url_col).alias("host"), F.col(html_col).alias("html")).mapInPandas(vote, "host string, path string, vote double, pages long")
    # Sums of doubles depend on their order; six places don't.
    summed = cast.groupBy("host", "path").agg(F.round(F.sum("vote"), 6).alias("vote"), F.sum("pages").alias("pages"))
    best = Window.partitionBy("host").orderBy(F.desc("vote"), F.desc("pages"), "path")
    ranked = summed.withColumn("rank", F.row_number().over(best)).filter(F.col("rank") <= kept)
    return ranked.groupBy("host").agg(F.transform(F.array_sort(F.collect_list(F.struct("rank", "path"))), lambda x: x["path"]).alias("paths"))


def extract_pages(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html", broadcast_hosts: int = 20_000, salts: int = 16) -> DataFrame:
    """Per page: the id, url, text and path.

    Hosts' paths are broadcast up to ``broadcast_hosts`` hosts; beyond it they
    join by host and a salt, so that a common host is dealt over tasks.
    """
    paths = materialize(host_paths(pages, url_col, html_col), "host-paths")
    picked = pages.select(F.col(id_col).alias("id"), F.col(url_col).alias("url"), F.col(html_col).alias("html"), host_of(url_col).alias("host"))
    if paths.count() <= broadcast_hosts:
        joined = picked.join(F.broadcast(paths), "host", "left")
    else:
        salted = paths.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(salts - 1))))
        joined = picked.withColumn("salt", F.pmod(F.xxhash64("id", "html"), F.lit(salts)).cast("int")).join(salted, ["host", "salt"], "left")

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            found = [main_text(h, list(p) if p is not None else []) for h, p in zip(batch["html"], batch["paths"])]
            yield pd.DataFrame({"id": batch["id"], "url": batch["url"], "text": [x[0] for x in found], "path": [x[1] for x in found]})

    kind = pages.schema[id_col].dataType.simpleString()
    out = joined.select("id", "url", "html", "paths").mapInPandas(run, f"id {kind}, url string, text string, path string")
    return out.withColumnRenamed("id", id_col)
