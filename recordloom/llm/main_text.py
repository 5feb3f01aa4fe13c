"""Main text of web pages by consensus of their host.

Every page scores its containers and votes for the best ones by a generalised path of tags and classes.  Votes are
summed per host in Spark.  Each page is then read again and its text is taken from the first of its host's winning
paths that it has, widened to the article around it; a page that has none falls back on its own best container.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass, field
from html import unescape

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from recordloom.llm.common import join_figures, row_key
from recordloom.session import materialise

VOTES = 3
WINNERS = 8
LEAST_SHARE = 0.2
LINKED_SHARE = 0.3

TOKEN = re.compile(
    r"<!--.*?(?:-->|\Z)|<!\[CDATA\[(?P<data>.*?)(?:\]\]>|\Z)|<[!?][^>]*+>?"
    r"|<(?P<end>/?)(?P<tag>[a-zA-Z][^\s/>]*+)(?P<attrs>(?:[^>\"']|\"[^\"]*+\"|'[^']*+')*+|[^>]*+)>"
    r"|(?P<text>[^<]++|<)", re.S)
ATTRIBUTE = re.compile(r"([^\s=\"'<>/]++)(?:\s*+=\s*+(?:\"([^\"]*+)\"|'([^']*+)'|([^\s\"'>]++)))?")
RAW = frozenset("script style textarea title noscript template iframe svg math xmp noembed noframes".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
DROPPED = frozenset("nav footer aside form button select option menu dialog object canvas audio video head".split())
BLOCK = frozenset(
    "address article aside blockquote body br caption center dd details dialog div dl dt fieldset figcaption figure footer "
    "form h1 h2 h3 h4 h5 h6 header hr html legend li main menu nav ol p pre section summary table tbody td tfoot th thead "
    "tr ul".split())
CONTAINER = frozenset("article main section div td body".split())
#: An opening tag ends open elements of these tags, up to the nearest border.
ENDS = {"p": ("p",), "li": ("li",), "dt": ("dt", "dd"), "dd": ("dt", "dd"), "tr": ("tr", "td", "th"), "td": ("td", "th"),
        "th": ("td", "th"), "option": ("option",)}
BORDERS = frozenset("table ul ol dl article section main div body html td th blockquote".split())
#: A class or id is boilerplate if it is made of such names, with nothing but neutral words beside them.
NAMES = (r"(?:ads?|advert\w*|banner|breadcrumbs?|captcha|comments?|commentlist|consent|cookies?|disqus|footer|gdpr|"
         r"header|masthead|menu|modal|nav|navbar|navigation|newsletter|notice|pager|pagination|popup|promo\w*|related|replies|"
         r"respond|share|sharing|sidebar|signup|social|sponsor\w*|subscribe|toolbar|widget)")
NEUTRAL = (r"(?:site|page|global|main|top|bottom|left|right|primary|secondary|box|container|wrap|wrapper|area|list|block|section|"
           r"bar|links?|items?|inner|outer|body|content|posts?|articles?|form|buttons?|icons?|text|\d+)")
BOILERPLATE = re.compile(rf"(?:{NEUTRAL}[_-]+)*+{NAMES}(?:[_-]+(?:{NAMES}|{NEUTRAL}))*+", re.I)
#: Of these, the ones whose articles are not the page's.
OTHERS = re.compile(r"(?:^|[\s_-])(?:ads?|advert\w*|comments?|commentlist|disqus|promo\w*|related|replies|respond|sponsor\w*)(?:$|[\s_-])", re.I)
ROLES = frozenset("navigation banner contentinfo complementary search dialog alert form".split())


@dataclass
class Node:
    """An element: its path, whether it is boilerplate, and what counts for its score.

    ``loose`` names a sign of boilerplate that the rest of the page may refute.
    """

    tag: str
    path: str
    skip: bool
    parent: Node | None
    number: int
    loose: str = ""
    held: int = 0
    held_linked: int = 0
    text: int = 0
    linked: int = 0
    score: float = 0.0
    blocks: list[str] = field(default_factory=list)


def attributes(attrs: str) -> dict[str, str]:
    found: dict[str, str] = {}
    for m in ATTRIBUTE.finditer(attrs):
        found.setdefault(m[1].lower(), m[2] or m[3] or m[4] or "")
    return found


def generalised(tag: str, found: dict[str, str]) -> str:
    """The tag with its classes, digits as #, so that pages of one template share it."""
    classes = sorted({re.sub(r"\d+", "#", c.lower()) for c in found.get("class", "").split()})
    return ".".join([tag, *classes[:4]])


def is_boilerplate(tag: str, found: dict[str, str], parents: list[Node]) -> bool:
    """Whether an element is boilerplate whatever it holds."""
    if tag in DROPPED:
        return tag != "form"
    if tag == "header":
        return not any(node.tag in ("article", "main") for node in parents)
    if not found or tag in ("html", "body", "article", "main"):
        return False
    return bool("hidden" in found or found.get("role", "").lower() in ROLES
                or re.search(r"display\s*:\s*none", found.get("style", "")))


def loose_sign(tag: str, found: dict[str, str]) -> str:
    """The classes and ids by which an element seems to be boilerplate, if any; a form always seems to."""
    if tag in ("html", "body", "article", "main"):
        return ""
    names = [name for name in f"{found.get('class', '')} {found.get('id', '')}".split() if BOILERPLATE.fullmatch(name)]
    return " ".join([*names, "form"] if tag == "form" else names)


class Page:
    """One page read once: the text blocks of each wanted container, or scores of all of them."""

    def __init__(self, html: str):
        self.nodes = [Node("#", "", False, None, 0)]
        self.stack = [self.nodes[0]]
        self.blocks: list[tuple[Node, str, int]] = []
        self.buffer: list[str] = []
        self.linked = 0
        self.read(html)
        self.close_block()
        self.settle()

    def read(self, html: str) -> None:
        at, size = 0, len(html)
        while at < size:
            token = TOKEN.match(html, at)
            if token is None:  # a bracket that opens nothing
                self.add_text("<")
                at += 1
                continue
            at = token.end()
            if token["text"] is not None:
                self.add_text(unescape(token["text"]))
            elif token["data"] is not None:
                self.add_text(token["data"])
            elif token["tag"] is not None:
                tag = token["tag"].lower()
                if token["end"]:
                    self.end(tag)
                elif tag in ("svg", "math") and token["attrs"].endswith("/"):
                    continue
                elif tag in RAW:
                    close = re.compile(rf"</{re.escape(tag)}\s*>", re.I).search(html, at)
                    at = close.end() if close else size
                else:
                    self.start(tag, token["attrs"])

    def add_text(self, text: str) -> None:
        if not self.stack[-1].skip:
            self.buffer.append(text)
            if any(node.tag == "a" for node in self.stack[-4:]):
                self.linked += len(text)

    def close_block(self) -> None:
        if self.buffer:
            text = " ".join("".join(self.buffer).split())
            if text:
                self.blocks.append((self.stack[-1], text, min(self.linked, len(text))))
            self.buffer, self.linked = [], 0

    def start(self, tag: str, attrs: str) -> None:
        if tag in BLOCK:
            self.close_block()
        if tag in VOID:
            return
        for place in range(len(self.stack) - 1, 0, -1):
            if self.stack[place].tag in ENDS.get(tag, ()):
                del self.stack[place:]
                break
            if self.stack[place].tag in BORDERS:
                break
        parent = self.stack[-1]
        found = attributes(attrs)
        skip, loose = parent.skip or is_boilerplate(tag, found, self.stack), loose_sign(tag, found)
        # Text inside a line can't be set aside.
        skip = skip or bool(loose and tag not in BLOCK)
        node = Node(tag, f"{parent.path}/{generalised(tag, found)}", skip, parent, len(self.nodes), "" if skip else loose)
        self.nodes.append(node)
        self.stack.append(node)

    def end(self, tag: str) -> None:
        if tag in BLOCK:
            self.close_block()
        for place in range(len(self.stack) - 1, 0, -1):
            if self.stack[place].tag == tag:
                if any(node.loose for node in self.stack[place:]):
                    self.close_block()
                del self.stack[place:]
                break

    def sums(self) -> None:
        """How much text each element holds."""
        for node in self.nodes:
            node.held = node.held_linked = 0
        for node, text, linked in self.blocks:
            node.held, node.held_linked = node.held + len(text), node.held_linked + linked
        for node in reversed(self.nodes[1:]):
            node.parent.held += node.held
            node.parent.held_linked += node.held_linked

    def settle(self) -> None:
        """Drop what loose signs call boilerplate.

        They are refuted for an element around the main element, around all articles of the page (unless it is a place
        for others' articles), or around most of its unlinked text where no article is outside; and for all
        elements where nothing would be left.
        """
        if any(node.loose for node in self.nodes):
            self.sums()
            total = self.nodes[0].held - self.nodes[0].held_linked
            articles, mains = [0] * len(self.nodes), [False] * len(self.nodes)
            for node in reversed(self.nodes):
                at = node.number
                if node.tag in ("article", "main") and not node.skip:
                    articles[at], mains[at] = node.held, mains[at] or (node.tag == "main" and node.held > 0)
                if node.parent is not None:
                    articles[node.parent.number] += articles[at]
                    mains[node.parent.number] = mains[node.parent.number] or mains[at]
            aside = [False] * len(self.nodes)
            for node in self.nodes[1:]:
                alone = articles[node.number] == articles[0]
                holds = mains[node.number] or (alone and articles[0] > 0 and not OTHERS.search(node.loose)) or (
                    alone and 2 * (node.held - node.held_linked) > total)
                aside[node.number] = aside[node.parent.number] or bool(node.loose and not holds)
            left = [block for block in self.blocks if not aside[block[0].number]]
            if left:
                self.blocks = left
                for node in self.nodes:
                    node.skip = node.skip or aside[node.number]
        self.sums()

    def containers(self) -> list[tuple[float, str]]:
        """Scores of containers, best first: a block counts by its unlinked text, whole for the nearest container,
        half and less for those around it; a link-heavy container loses."""
        seen: dict[int, Node] = {}
        for node, text, linked in self.blocks:
            worth, up = float(len(text) - linked), node
            while up is not None:
                if up.tag in CONTAINER and not up.skip:
                    up.score += worth * (1.5 if up.tag in ("article", "main") else 1.0)
                    up.text, up.linked = up.text + len(text), up.linked + linked
                    seen[up.number] = up
                    worth /= 2
                up = up.parent
        return sorted(((n.score * (1 - n.linked / max(1, n.text)), n.path) for n in seen.values()), key=lambda x: (-x[0], x[1]))

    def widened(self, roots: list[Node]) -> list[Node]:
        """The elements around ``roots``, all of one path, that hold the rest of their text.

        That is the nearest article, or main element if little of what it adds is linked.  Without one, the parents, as
        long as they add little text beside that of ``roots``, and little of it linked; to the body only what stands
        directly in it may come in.
        """

        def parents(nodes: list[Node]) -> list[Node]:
            return list({node.parent.number: node.parent for node in nodes}.values())

        def added(nodes: list[Node]) -> tuple[int, int]:
            return (sum(node.held for node in nodes) - sum(node.held for node in roots),
                    sum(node.held_linked for node in nodes) - sum(node.held_linked for node in roots))

        above, wide = roots, None
        while above[0].parent is not None:
            if above[0].tag == "article":
                return above
            if above[0].tag == "main":
                text, linked = added(above)
                wide = above if linked <= LINKED_SHARE * text else None
                break
            above = parents(above)
        if wide is not None:
            return wide
        core = sum(node.held - node.held_linked for node in roots)
        numbers = {node.number for node in roots}
        wide = roots
        while wide[0].tag not in ("main", "body") and wide[0].parent is not None:
            above = parents(wide)
            text, linked = added(above)
            if linked > LINKED_SHARE * text or 2 * (text - linked) > core:
                break
            if above[0].tag in ("body", "html", "#") and text and not self.only_direct(above, numbers | {n.number for n in wide}):
                break
            wide = above
        return wide

    def only_direct(self, nodes: list[Node], known: set[int]) -> bool:
        """Whether all text of ``nodes`` is in the ``known`` elements or in no container of its own."""
        tops = {node.number for node in nodes}
        seen: dict[int, bool] = {}
        for block, _, _ in self.blocks:
            chain, node, good = [], block, True
            while node is not None and node.number not in tops and node.number not in known:
                if node.number in seen:
                    good = seen[node.number]
                    break
                chain.append(node.number)
                if node.tag in CONTAINER:
                    good = False
                    break
                node = node.parent
            for number in chain:
                seen[number] = good
            if not good:
                return False
        return True

    def under(self, path: str) -> str:
        """The blocks of all elements on a path and of what belongs to them, in page order."""
        roots = {node.number for node in self.widened([node for node in self.nodes if node.path == path and not node.skip])}
        inside: dict[int, bool] = {}

        def within(node: Node | None) -> bool:
            chain = []
            while node is not None and node.number not in inside:
                chain.append(node)
                if node.number in roots:
                    break
                node = node.parent
            answer = node is not None and (inside.get(node.number) or node.number in roots)
            for passed in chain:
                inside[passed.number] = answer
            return answer

        return "\n".join(text for node, text, _ in self.blocks if within(node))


def host_of(url: Column) -> Column:
    return F.lower(F.regexp_extract(F.coalesce(url, F.lit("")), r"^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]*)", 1))


def page_votes(pages: DataFrame) -> DataFrame:
    """(host, path, weight): each page's best containers, weighted by their share of the best one's score."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            hosts, paths, weights = [], [], []
            for host, html in zip(batch.column("host").to_pylist(), batch.column("html")):
                ranked = [c for c in Page(html.as_py() or "").containers()[:VOTES] if c[0] > 0]
                for score, path in ranked:
                    hosts.append(host), paths.append(path), weights.append(score / ranked[0][0])
            yield pa.RecordBatch.from_arrays([pa.array(hosts, pa.string()), pa.array(paths, pa.string()),
                                              pa.array(weights, pa.float64())], ["host", "path", "weight"])

    return pages.select("host", "html").mapInArrow(run, "host string, path string, weight double")


def winners(votes: DataFrame) -> DataFrame:
    """(host, paths): up to WINNERS paths with LEAST_SHARE of the best one's votes at least, best first.

    Votes are combined on the map side, so a hot host is a few rows; weights are summed in thousandths, exactly.
    """
    counted = votes.groupBy("host", "path").agg(F.sum(F.round(F.col("weight") * 1000).cast("bigint")).alias("n"))
    order = Window.partitionBy("host").orderBy(F.desc("n"), "path")
    best = F.first("n").over(order)
    ranked = counted.withColumn("_at", F.row_number().over(order)).withColumn("_best", best)
    good = ranked.where((F.col("_at") <= WINNERS) & (F.col("n") >= F.col("_best") * LEAST_SHARE))
    return good.groupBy("host").agg(F.sort_array(F.collect_list(F.struct("_at", "path"))).alias("_p")).select(
        "host", F.col("_p.path").alias("paths"))


def extracted(pages: DataFrame) -> DataFrame:
    """(page_id, url, text) from rows that carry their host's winning ``paths``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = []
            for html, paths in zip(batch.column("html"), batch.column("paths").to_pylist()):
                page = Page(html.as_py() or "")
                own = {path: score for score, path in page.containers() if score > 0}
                top = max(own.values(), default=0.0)
                # A winner that holds next to nothing on this page is not its main text.
                path = next((p for p in paths or [] if own.get(p, 0.0) >= LEAST_SHARE * top and p in own), next(iter(own), None))
                texts.append(page.under(path) if path else "\n".join(text for _, text, _ in page.blocks))
            yield pa.RecordBatch.from_arrays([batch.column("page_id"), batch.column("url"), pa.array(texts, pa.string())],
                                             ["page_id", "url", "text"])

    return pages.select("page_id", "url", "html", "paths").mapInArrow(run, "page_id bigint, url string, text string")


def main_text(pages: DataFrame) -> DataFrame:
    """page_id, url, text and n_chars for every row of ``pages`` (page_id, url, html).

    A null or empty html has an empty text, and so has a page of boilerplate only.  Pages without a host, null url
    included, vote together.  Repeated rows are read each; other columns are left out.
    """
    rows = pages.select("page_id", "url", "html", host_of(F.col("url")).alias("host"))
    chosen = materialise(winners(page_votes(rows)), "paths")
    known = join_figures(rows, chosen, "host", row_key(1, "page_id", "url"))
    return extracted(known).withColumn("n_chars", F.length("text").cast("bigint"))
