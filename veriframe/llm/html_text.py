"""Main text of web pages by consensus of a host's pages.

First pass: each page's containers are scored by the prose they hold (text outside links), and all that have any are
summed as generalised paths of tag and class names, digits removed. Spark sums the scores by host and path (partial
sums in the map tasks: a host of any size is a row a task), and each host takes the path with the highest score of those that
enough of its pages have. Second pass: each page is read again and the text of the article that holds its host's winning path is taken, without
boilerplate inside it, so that headline, lead and short sections beside the inner container stay; a page that lacks the path falls back on its own best container.

Pages are read as browsers read them: a quote within or after an unquoted value is a plain character, a tag goes on to its
``>``, and each character is looked at a bounded number of times, whatever stays open.
"""

from __future__ import annotations

import hashlib
import html as entities
import re
from collections import Counter
from collections.abc import Iterator

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from veriframe.llm.common import durable, fits, slices, small_batches
from veriframe.llm.url_filter import split_url

#: Hosts whose winners are broadcast at most; more are joined by a shuffle.
BROADCAST_HOSTS = 200_000
#: A path needs this share of its host's pages to win.
SHARE = 0.3
#: Steps of a path at most. Elements nested deeper go by the path of the last that has one, so that paths don't grow with the square of the depth; their text counts and stays.
DEPTH = 256
#: A tag: its name, then attributes (each with a quoted, an unquoted or no value) and slashes in any order. Nothing in it is tried twice.
_TAG = re.compile(r"""<(/?)([A-Za-z][^\s/>]*+)((?:[\s/]++|[^\s/>][^\s/>=]*+(?:\s*+=\s*+(?:"[^"]*+"|'[^']*+'|[^\s>"'][^\s>]*+))?+)*+)>""")
_ATTRIBUTE = re.compile(r"""([^\s/>=][^\s/>=]*+)(?:\s*+=\s*+(?:"([^"]*+)"|'([^']*+)'|([^\s>"'][^\s>]*+)))?+""")
_COMMENT_END = re.compile(r"--!?>")
#: Fixed values of HTML: elements without content, elements whose content is no text of the page, elements that begin a block.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style noscript template textarea title svg annotation annotation-xml iframe object canvas select".split())
BLOCK = frozenset(
    "address article aside blockquote body center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hr html "
    "li main menu nav ol p pre section summary table tbody td tfoot th thead tr ul head".split()
)
#: An open <p> ends before any of these.
ENDS_P = BLOCK - {"td", "th", "tr", "tbody", "thead", "tfoot", "html", "head", "body"}
#: An open one of the second ends before the first, unless one of the third is opened in between.
_ENDS = {"li": (("li",), ("ul", "ol", "menu")), "dt": (("dt", "dd"), ("dl",)), "dd": (("dt", "dd"), ("dl",)), "tr": (("tr",), ("table",)), "td": (("td", "th"), ("tr", "table")), "th": (("td", "th"), ("tr", "table"))}
SKIP = frozenset("nav header footer aside menu dialog head".split())
#: Controls whose text is part of a sentence where most of its block stands outside of them.
INLINE = frozenset("button label".split())
CONTROLS = frozenset("input button select textarea".split())
_ROLES = frozenset("navigation banner contentinfo complementary search dialog alert form menu".split())
#: Words in class names and ids: of readers' comments, of other boilerplate, of what is boilerplate in an article only where a host repeats it or links are most of it, and of what is so anywhere only where links are.
_READERS = re.compile(r"(?:^|-)(?:comments?|commentlist|respond|replies|disqus)(?:$|-)")
_NAMED = re.compile(
    r"(?:^|-)(?:ads?|adv|adverts?|advertisements?|advertising|banners?|sponsor(?:s|ed)?|nav|navbar|navigation|menus?|sidebar|sidebars|side-bar|footer|masthead|breadcrumbs?|"
    r"cookies?|consent|gdpr|popup|modal|newsletter|subscribe|signup|login|related-(?:posts?|articles?|links?|stories|content|news|items?)|recommended|recommendations|pagination|pager|toolbar|copyright)(?:$|-)"
)
_LOOSE = re.compile(r"(?:^|-)(?:hidden|notices?|promos?|promotion|alerts?|related)(?:$|-)")
#: How readers' comments begin: with their number, or with a title where items with an author or a time follow.
_NUMBERED = re.compile(r"\(?[0-9]+\)?\s+(?:comments?|replies|responses|kommentare?|commentaires?|comentarios?)\W*", re.IGNORECASE)
_TITLED = re.compile(r"(?:(?:reader )?comments?|replies|responses|discussion|join the (?:conversation|discussion)|kommentare?|commentaires?|comentarios?)\s*(?:\([0-9]+\))?\W*", re.IGNORECASE)
_SIGNED = re.compile(r"(?:^|-)(?:author|user|username|avatar|date|time|timestamp|posted)(?:$|-)")
_WEAK = re.compile(r"(?:^|-)(?:social|share|sharing|widgets?|skip|search|tags?|meta|byline|header|aside)(?:$|-)")
PARAGRAPHS = frozenset("article blockquote h2 h3 h4 h5 h6 p pre table".split())
SURE, READERS, NAMED, WEAK, FORM, LOOSE, CONTROL = 1, 2, 3, 4, 5, 6, 7


class Node:
    __slots__ = ("article", "controls", "end", "heads", "inline", "key", "links", "loose", "mark", "parent", "path", "prose", "signed", "skip", "start", "tag")

    def __init__(self, tag: str, path: str, parent: Node | None, mark: int, start: int) -> None:
        self.tag, self.path, self.parent, self.mark, self.start = tag, path, parent, mark, start
        self.end, self.prose, self.links, self.controls, self.heads, self.skip = -1, 0, 0, 0, 2 * (tag in ("h1", "main")) | (tag in PARAGRAPHS), False
        self.article, self.inline, self.signed, self.key = False, mark == CONTROL or (parent is not None and parent.inline), False, ""
        self.loose: Node | None = self if mark == LOOSE else parent.loose if parent is not None else None


def _attributes(raw: str) -> dict[str, str]:
    out: dict[str, str] = {}
    for m in _ATTRIBUTE.finditer(raw):
        out.setdefault(m[1].lower(), m[2] or m[3] or m[4] or "")
    return out


def _step(tag: str, attributes: dict[str, str]) -> str:
    return ".".join([tag, *sorted(set(re.sub(r"\d+", "", attributes.get("class", "").lower()).split()))])


def _mark(tag: str, attributes: dict[str, str], in_article: bool) -> int:
    if tag in SKIP and not (tag == "header" and in_article):
        return SURE
    if "hidden" in attributes or attributes.get("aria-hidden") == "true" or re.search(r"display\s*:\s*none", attributes.get("style", "")):
        return SURE
    names = [re.sub(r"([a-z])([A-Z])", r"\1-\2", n).lower().replace("_", "-") for n in f"{attributes.get('class', '')} {attributes.get('id', '')}".split()]
    if tag not in ("html", "body", "main"):
        if any(map(_READERS.search, names)):
            return READERS
        if tag != "article" and (attributes.get("role", "").lower() in _ROLES or any(map(_NAMED.search, names))):
            return NAMED
        if tag != "article" and any(map(_LOOSE.search, names)):
            return LOOSE
        if tag != "article" and any(map(_WEAK.search, names)):
            return WEAK
    if tag in INLINE:
        return CONTROL
    return FORM if tag == "form" else 0


def _boilerplate(node: Node, page_prose: int, repeated: frozenset[str]) -> bool:
    """Of an element with a mark, its text and links summed; ``repeated``: keys of those whose text its host repeats. What holds the page's heading or main element only wraps it; so does a form around most of the page."""
    if node.mark in (SURE, READERS):
        return True
    if node.heads & 2:
        return False
    if node.mark == FORM:
        return node.controls > 0 and not (node.heads & 1 and 2 * node.prose > page_prose)
    if node.mark == LOOSE:
        return not node.article or node.key in repeated or node.links >= node.prose
    return node.mark == NAMED or node.mark == WEAK and node.links >= node.prose


def _comments(node: Node, first: str, children: list[Node]) -> bool:
    """Whether an element that holds several items, of like paths and signed, or says their number, is readers' comments; ``first`` is its first block."""
    if node.heads & 2 or len(first) > 60 or node.tag in PARAGRAPHS - {"article"} | {"html", "body", "main"}:
        return False
    if _NUMBERED.fullmatch(first):
        return True
    if not _TITLED.fullmatch(first):
        return False
    items = Counter(c.path for c in children if c.signed)
    return max(items.values(), default=0) >= 2


def parse(page: str, repeated: frozenset[str] = frozenset()) -> tuple[list[Node], list[tuple[Node, str]]]:
    """Elements in page order, and (element that holds it, text) of the blocks, without what boilerplate elements hold (``repeated``: see _boilerplate); ``start`` and ``end`` of an element count raw blocks.

    ``prose`` and ``links`` of an element are the characters outside and inside links of its own blocks.
    """
    root = Node("", "", None, 0, 0)
    nodes, stack = [root], [root]
    raw_blocks: list[tuple[Node, list[tuple[Node, str, bool]]]] = []
    parts: list[tuple[Node, str, bool]] = []
    open_at: dict[str, list[int]] = {"a": [], "": []}  # places in the stack by tag; under "" those of blocks

    def close_block() -> None:
        nonlocal parts
        if parts:
            raw_blocks.append((stack[-1], parts))
            parts = []

    def text(raw: str) -> None:
        if raw:
            parts.append((stack[-1], raw, bool(open_at["a"])))

    def pop_to(depth: int) -> None:
        while len(stack) > depth:
            node = stack.pop()
            node.end = len(raw_blocks)
            open_at[node.tag].pop()
            if node.tag in BLOCK:
                open_at[""].pop()

    def last(tags: tuple[str, ...]) -> int:
        return max((x[-1] for t in tags if (x := open_at.get(t))), default=0)

    at, size = 0, len(page)
    while at < size:
        begin = page.find("<", at)
        text(page[at : begin if begin >= 0 else size])
        if begin < 0:
            break
        m = _TAG.match(page, begin)
        if not m:
            follows = page[begin + 1 : begin + 2]
            if page.startswith("<![CDATA[", begin):
                end = page.find("]]>", begin)
                text(page[begin + 9 : end if end >= 0 else size])
                at = end + 3 if end >= 0 else size
            elif page.startswith("<!--", begin):
                end = _COMMENT_END.search(page, begin + 2)
                at = end.end() if end else size
            elif follows in ("!", "?", "/") and page[begin + 1 : begin + 3] != "/":
                end = page.find(">", begin)
                at = end + 1 if end >= 0 else size
            elif follows.isascii() and follows.isalpha():
                at = size  # a tag that never ends
            else:
                text("<")
                at = begin + 1
            continue
        at, tag = m.end(), m[2].lower()
        if tag in BLOCK:
            close_block()
        if m[1]:  # an end tag closes what is open inside its element; one without a start is ignored
            depth = last((tag,))
            if depth and not (tag not in BLOCK and open_at[""] and open_at[""][-1] > depth):
                pop_to(depth)
            continue
        if tag in CONTROLS and (form := last(("form",))):
            stack[form].controls += 1
        if tag in RAW:
            end = re.compile(rf"</{tag}(?=[\s/>])[^>]*>", re.IGNORECASE).search(page, at)
            at = end.end() if end else size
            continue
        if tag in VOID:
            if tag in ("br", "img", "input"):
                text(" ")
            continue
        if tag in ENDS_P and (top := last(("",))) and stack[top].tag == "p":
            pop_to(top)
        if tag in _ENDS:
            same, inside = _ENDS[tag]
            if (depth := last(same)) > last(inside):
                pop_to(depth)
        attributes = _attributes(m[3]) if m[3].strip(" /\n\t\r\f") else {}
        if m[3].endswith("/") and tag not in BLOCK:
            continue
        above = stack[-1]
        path = f"{above.path}/{_step(tag, attributes)}" if tag in BLOCK and len(stack) <= DEPTH else above.path
        node = Node(tag, path, above, _mark(tag, attributes, bool(last(("article", "main")))), len(raw_blocks))
        node.article = bool(last(("article", "main")))
        if node.mark == LOOSE:
            node.key = f"{path}#{re.sub(r'[0-9]+', '', attributes.get('id', ''))}"
        node.signed = tag == "time" or "class" in attributes and any(map(_SIGNED.search, attributes["class"].lower().replace("_", "-").split()))
        nodes.append(node)
        open_at.setdefault(tag, []).append(len(stack))
        if tag in BLOCK:
            open_at[""].append(len(stack))
        stack.append(node)
    close_block()
    pop_to(1)
    root.end = len(raw_blocks)
    for _, found in raw_blocks:
        for node, raw, linked in found:
            if linked:
                node.links += len(raw.strip())
            else:
                node.prose += len(raw.strip())
    for node in reversed(nodes[1:]):
        above = node.parent
        above.signed |= node.signed
        above.prose, above.links, above.controls, above.heads = above.prose + node.prose, above.links + node.links, above.controls + node.controls, above.heads | node.heads
    children: dict[int, list[Node]] = {}
    titles = {i for i, (_, found) in enumerate(raw_blocks) if len(t := " ".join("".join(raw for _, raw, _ in found[:8]).split())) <= 60 and (_NUMBERED.fullmatch(t) or _TITLED.fullmatch(t))}
    if titles:
        for node in nodes[1:]:
            if node.parent.start in titles:
                children.setdefault(id(node.parent), []).append(node)
    for node in nodes[1:]:
        node.skip = node.parent.skip or (node.mark > 0 and _boilerplate(node, root.prose, repeated))
        if not node.skip and node.start in titles and node.end > node.start + 1 and node.tag in BLOCK:
            node.skip = _comments(node, " ".join("".join(raw for _, raw, _ in raw_blocks[node.start][1]).split()), children.get(id(node), []))
    for node in nodes:
        node.prose = node.links = 0
    blocks = []
    for holder, found in raw_blocks:
        kept = [(raw, linked) for node, raw, linked in found if not node.skip and not node.inline]
        if any(node.inline for node, _, _ in found):
            outside = sum(len(raw.strip()) for raw, _ in kept)
            if outside > sum(len(raw.strip()) for node, raw, _ in found if node.inline and not node.skip):
                kept = [(raw, linked) for node, raw, linked in found if not node.skip]
        if whole := " ".join(entities.unescape("".join(raw for raw, _ in kept)).split()):  # all white space, also what references stand for
            links = min(len(whole), sum(len(raw.strip()) for raw, linked in kept if linked))
            holder.prose, holder.links = holder.prose + len(whole) - links, holder.links + links
            blocks.append((holder, whole))
    return nodes, blocks


def containers(page: str) -> list[tuple[str, float]]:
    """Generalised paths of a page's containers with their scores, best first: the text of blocks that are mostly no links, discounted by a tenth for each level between."""
    return _scored(parse(page)[1])


def _scored(blocks: list[tuple[Node, str]]) -> list[tuple[str, float]]:
    score: dict[str, float] = {}
    for holder, text in blocks:
        value = len(text) if holder.prose > holder.links else 0
        path = holder.path
        inner = path.rsplit("/", 1)[-1].split(".")[0]
        if inner in ("p", "h1", "h2", "h3", "h4", "h5", "h6", "li", "pre", "blockquote", "td", "th", "dd", "dt", "figcaption"):
            path = path.rsplit("/", 1)[0]
        part = 1.0
        while True:
            step = path.rsplit("/", 1)[-1].split(".")[0]
            if step not in ("p", "li", "ul", "ol", "table", "tbody", "tr"):
                score[path] = score.get(path, 0.0) + part * value
            if not path:  # the page itself
                break
            part *= 0.9
            path = path.rsplit("/", 1)[0]
    return sorted(((p, s) for p, s in score.items() if s > 0), key=lambda x: (-x[1], x[0]))


def _under(holder: Node, path: str) -> bool:
    return holder.path == path or holder.path.startswith(path + "/")


def whole_article(blocks: list[tuple[Node, str]], path: str) -> str:
    """The nearest article around ``path``; without one the nearest main, unless more than half of what it adds are links; else ``path``."""
    steps = path.split("/")
    for tag in ("article", "main"):
        if depth := max((k for k, step in enumerate(steps) if step.split(".")[0] == tag), default=0):
            wider = "/".join(steps[: depth + 1])
            added = {id(h): h for h, _ in blocks if _under(h, wider) and not _under(h, path)}.values()
            return wider if tag == "article" or sum(h.links for h in added) <= sum(h.prose for h in added) else path
    return path


def loose_texts(nodes: list[Node], blocks: list[tuple[Node, str]]) -> set[tuple[str, str]]:
    """(key, digest of its text) of the elements that names leave open."""
    if not any(n.mark == LOOSE for n in nodes):
        return set()
    held: dict[int, tuple[Node, list[str]]] = {}
    for holder, text in blocks:
        if (node := holder.loose) is not None:  # the nearest
            held.setdefault(id(node), (node, []))[1].append(text)
    return {(node.key, hashlib.md5("\n".join(texts).encode()).hexdigest()) for node, texts in held.values()}


def extract(page: str, path: str | None, repeated: frozenset[str] = frozenset()) -> str:
    """Blocks of the article around ``path`` joined by empty lines; of that around the page's best container if the path is null or holds nothing."""
    _, blocks = parse(page, repeated)
    for wanted in (path, None):
        if wanted is None:
            own = _scored(blocks)
            wanted = own[0][0] if own else ""
        if any(_under(holder, wanted) for holder, _ in blocks):
            wanted = whole_article(blocks, wanted)
            return "\n\n".join(t for holder, t in blocks if _under(holder, wanted))
    return "\n\n".join(t for _, t in blocks)


def host_paths(pages: DataFrame) -> DataFrame:
    """(host, path, repeated): the path that each host's pages vote for, and the keys of open elements whose texts repeat: at least two pages have one, and there are at most half as many texts as pages."""

    def score(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            sums: dict[tuple[str, str | None, str | None], list[int]] = {}
            for host, page in zip(batch.host, batch.html):
                nodes, blocks = parse(page or "")
                for path, value in ([*_scored(blocks), (None, 0.0)]):
                    both = sums.setdefault((host, path, None), [0, 0])
                    both[0] += round(1_000 * value)  # whole numbers: sums don't depend on their order
                    both[1] += 1
                for key, digest in loose_texts(nodes, blocks):
                    sums.setdefault((host, key, digest), [0, 0])[1] += 1
            yield pd.DataFrame([(*k, *v) for k, v in sums.items()], columns=["host", "path", "said", "score", "pages"])

    host = split_url(F.col("url"))[0]
    votes = small_batches(pages.select(host.alias("host"), F.col("html").cast("string").alias("html"))).mapInPandas(score, "host string, path string, said string, score long, pages long")
    sums = durable(votes.groupBy("host", "path", "said").agg(F.sum("score").alias("score"), F.sum("pages").alias("pages")), "host-votes")
    total = sums.where("path IS NULL").select("host", F.col("pages").alias("total"))
    voted = sums.where("path IS NOT NULL AND said IS NULL").join(total, "host").where(F.col("pages") >= SHARE * F.col("total"))
    best = voted.groupBy("host").agg(F.min(F.struct(-F.col("score"), F.col("path"))).alias("best")).select("host", "best.path")
    texts = sums.where("said IS NOT NULL").groupBy("host", "path").agg(F.sum("pages").alias("n"), F.count("*").alias("texts")).where("n >= 2 AND 2 * texts <= n")
    return best.join(texts.groupBy("host").agg(F.sort_array(F.collect_set("path")).alias("repeated")), "host", "left")


def main_text(pages: DataFrame, broadcast_hosts: int = BROADCAST_HOSTS) -> DataFrame:
    """``pages`` (page_id, url, html, ...) -> (page_id, url, text), one row for each input row.

    Null and empty html give an empty text. Pages without a host (null or malformed urls) vote together. White space
    in a block is one space; blocks are joined by two line feeds. Elements may be nested to any depth, pages may be of any length: the time of
    a page is in proportion to it. Paths with equal scores go by their order as text. Repeated rows each vote and each get a row; other
    columns are ignored, whatever their names. An empty table gives an empty result.
    """
    winners = durable(host_paths(pages), "host-paths")
    narrow = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), F.col("html").cast("string").alias("html")).withColumn("_host", split_url(F.col("url"))[0])
    side = winners.withColumnRenamed("host", "_h")
    side = F.broadcast(side) if fits(winners, broadcast_hosts) else side
    joined = narrow.join(side, F.col("_host") == F.col("_h"), "left").select("page_id", "url", "html", "path", "repeated")

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            texts = [extract(page or "", path, frozenset(repeated or ())) for page, path, repeated in zip(*(batch.column(c).to_pylist() for c in (2, 3, 4)))]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())], names=["page_id", "url", "text", "n_chars"])

    return small_batches(joined).mapInArrow(read, "page_id long, url string, text string, n_chars long")


def op1_html_text(spark, sf_dir: str) -> DataFrame:
    return main_text(spark.read.parquet(f"{sf_dir}/pages.parquet").select("page_id", "url", "html"))
