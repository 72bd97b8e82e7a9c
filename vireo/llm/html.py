"""Main text of web pages by composite text density.

For every element i of the DOM: C_i characters and T_i tags below it, LC_i of those characters and LT_i of those tags in
links; b is the body. Its density is

    C_i / T_i * log(C_i / LC_i * T_i / LT_i) / log(log(C_i / (C_i - LC_i) * LC_i + LC_b / C_b * C_i + e))

with zeros in denominators taken as 1. A node's sum is that of its children's densities. The node with the largest sum
(the first of equals) fixes the threshold: the least density on its path to the body. Walking down from the body through
nodes that reach the threshold, the largest-sum node of each such subtree is marked where its sum is positive, and the
text of the marked subtrees is the result.

Defined results: a null page gives null; a page without text gives the empty text; without a body the whole page but for
its head is the body; a head also ends, as in HTML, at the first text or element that can't be in it; a tag ends at the first
> outside its quoted values (of a quote that nothing closes, at the next >); unclosed tags, comments and scripts end where
HTML would end them, at the latest at the end of the page; an end tag that closes nothing is a line break at most. Of nodes
with equal sums the first counts; repeated rows give the same text each. Pages of any length and depth are parsed whole, in
time linear in their length; no step recurses. Columns of other names are ignored.
"""

from __future__ import annotations

import html as entities
import math
import re

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from vireo.llm import common

_VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
_RAW = frozenset("script style noscript template iframe".split())
_BLOCK = frozenset(
    "address article aside blockquote body br center dd details div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hr html li main nav ol p pre section table tbody td tfoot th thead title tr ul".split()
)
#: A start tag of the first kind ends an open element of the second.
_CLOSES = {
    **dict.fromkeys("address article aside blockquote div dl fieldset footer form h1 h2 h3 h4 h5 h6 header hr main nav ol p pre section table ul".split(), ("p",)),
    "li": ("li", "p"), "dt": ("dt", "dd", "p"), "dd": ("dt", "dd", "p"), "tr": ("tr", "td", "th"), "td": ("td", "th"), "th": ("td", "th"), "option": ("option",),
}
#: Elements that such an ending does not reach through.
_WALLS = {"li": ("ul", "ol"), "dt": ("dl",), "dd": ("dl",), "tr": ("table",), "td": ("table", "tr"), "th": ("table", "tr")}
_TAG = re.compile(r"<(?:(!--)|([!?])|(/?)([a-zA-Z][^\s/>]*))")
_VALUE = re.compile(r">|=\s*([\"'])")
#: What may be in a head.
_HEAD = frozenset("base basefont bgsound link meta noframes noscript script style template title".split())
_P_WALLS = ("td", "th", "li", "div", "section", "article", "body", "button", "table")
_END = {t: re.compile(rf"</{t}(?=[\s/>])[^>]*>", re.I) for t in _RAW}
_BLANK = re.compile(r"[ \t\r\f\v ]+")


def parse(page: str) -> tuple[list[str], list[int], list[tuple[int, str]]]:
    """(names, parents, texts): nodes in document order, node 0 a root; texts as (owner, text) in document order, with
    the owner's position and, for a line break, a text of one line feed."""
    names, parents, texts, stack = ["#root"], [-1], [], [0]
    depths: dict[str, list[int]] = {}  # of the open elements of each name, and of all open blocks
    blocks: list[int] = []
    unclosed: set[str] = set()  # quotes that do not come again
    last, at, length = page.rfind(">") + 1, 0, len(page)

    def deepest(of) -> int:
        return max((depths[x][-1] for x in of if depths.get(x)), default=0)

    def cut(k: int) -> None:
        while len(stack) > k:
            name = names[stack.pop()]
            depths[name].pop()
            if name in _BLOCK:
                blocks.pop()

    def text(raw: str) -> None:
        if raw:
            if names[stack[-1]] == "head" and raw.strip():
                cut(len(stack) - 1)
            texts.append((stack[-1], entities.unescape(raw) if "&" in raw else raw))

    def brk(name: str) -> None:
        if name in _BLOCK:
            texts.append((stack[-1], "\n"))

    def tag_end(i: int) -> int:
        while m := _VALUE.search(page, i):
            quote = m.group(1)
            i = m.end()
            if not quote:
                return i
            if quote not in unclosed:
                end = page.find(quote, i)
                if end < 0:
                    unclosed.add(quote)
                else:
                    i = end + 1
        return length

    while at < length:
        m = _TAG.search(page, at, last) if at < last else None
        if not m:
            comment = page.find("<!--", at)
            text(page[at:] if comment < 0 else page[at:comment])
            break
        text(page[at : m.start()])
        at = m.end()
        comment, other, slash, name = m.groups()
        if comment:
            end = page.find("-->", at)
            at = end + 3 if end >= 0 else length
            continue
        if other:
            end = page.find(">", at)
            at = end + 1 if end >= 0 else length
            continue
        at = tag_end(at)
        name = name.lower()
        if slash:
            k = deepest((name,))
            if not k:
                brk(name)
            elif name in _BLOCK or not blocks or blocks[-1] < k:  # an inline end tag does not close a block
                brk(name)
                cut(k)
            continue
        if name not in _HEAD and depths.get("head"):
            cut(depths["head"][-1])
        if name in _RAW:
            if not page[m.start() : at].endswith("/>"):
                end = _END[name].search(page, at)
                at = end.end() if end else length
            continue
        if closes := _CLOSES.get(name):
            k = deepest(closes)
            if k > deepest(_P_WALLS if closes == ("p",) else _WALLS.get(name, ())):
                cut(k)
        brk(name)
        names.append(name)
        parents.append(stack[-1])
        if name not in _VOID:
            depths.setdefault(name, []).append(len(stack))
            if name in _BLOCK:
                blocks.append(len(stack))
            stack.append(len(names) - 1)
    return names, parents, texts


def density(c: int, t: int, lc: int, lt: int, cb: int, lcb: int) -> float:
    if not c:
        return 0.0
    inner = c / max(1, c - lc) * lc + lcb / max(1, cb) * c + math.e
    base = math.log(inner)
    value = c / max(1, lc) * max(1, t) / max(1, lt)
    scale = math.log(base) if base > 1 else 0.0
    link = math.log(value) / scale if scale > 1e-9 else math.log(value) / 1e-9
    return c / max(1, t) * link


def extract(page: str | None) -> str | None:
    """The main text of a page."""
    if page is None:
        return None
    names, parents, texts = parse(page)
    n = len(names)
    chars, tags, link_chars, link_tags = [0] * n, [0] * n, [0] * n, [0] * n
    in_link, hidden = [False] * n, [False] * n
    body = next((i for i, x in enumerate(names) if x == "body"), 0)
    for i in range(1, n):
        in_link[i] = in_link[parents[i]] or names[i] == "a"
        hidden[i] = hidden[parents[i]] or names[i] == "head"
    for owner, s in texts:
        if not hidden[owner]:
            size = len("".join(s.split()))
            chars[owner] += size
            if in_link[owner]:
                link_chars[owner] += size
    for i in range(n - 1, 0, -1):
        p = parents[i]
        chars[p] += chars[i]
        link_chars[p] += link_chars[i]
        tags[p] += tags[i] + 1
        link_tags[p] += link_tags[i] + (names[i] == "a")
    if not chars[body]:
        body = 0
    dens = [density(chars[i], tags[i], link_chars[i], link_tags[i], chars[body], link_chars[body]) for i in range(n)]
    sums = [0.0] * n
    for i in range(1, n):
        sums[parents[i]] += dens[i]
    inside, best = [False] * n, list(range(n))  # best: the largest sum of each subtree
    inside[body] = True
    for i in range(body + 1, n):
        inside[i] = inside[parents[i]]
    for i in range(n - 1, 0, -1):
        p = parents[i]
        if sums[best[i]] > sums[best[p]] or sums[best[i]] == sums[best[p]] and best[i] < best[p]:
            best[p] = best[i]
    top, threshold = best[body], math.inf
    while True:
        threshold = min(threshold, dens[top])
        if top == body or top <= 0:
            break
        top = parents[top]
    marked, open_ = [False] * n, [False] * n
    open_[body] = True
    for i in range(body, n):
        if inside[i] and (i == body or open_[parents[i]]) and dens[i] >= threshold - 1e-9:
            open_[i] = True
            if sums[best[i]] > 0 or chars[body] and best[body] == i:  # a subtree without dense children has no sum to win by
                marked[best[i]] = True
        elif i != body:
            open_[i] = False
    for i in range(1, n):
        marked[i] = marked[i] or marked[parents[i]]
    out = "".join(s if s == "\n" else s.replace("\n", " ") for owner, s in texts if marked[owner] and not hidden[owner])
    lines = (_BLANK.sub(" ", line).strip() for line in out.split("\n"))
    return "\n".join(line for line in lines if line)


def extracted(pages: DataFrame) -> DataFrame:
    """A row per page: page_id, url, text and its n_chars."""
    common.small_batches(pages.sparkSession)

    def run(batches):
        for b in batches:
            found = [extract(p) for p in b.column("html").to_pylist()]
            yield pa.RecordBatch.from_arrays(
                [b.column("page_id"), b.column("url"), pa.array(found, pa.string()), pa.array([None if t is None else len(t) for t in found], pa.int64())], ["page_id", "url", "text", "n_chars"]
            )

    return pages.select(F.col("page_id").cast("bigint").alias("page_id"), "url", "html").mapInArrow(run, "page_id bigint, url string, text string, n_chars bigint")
