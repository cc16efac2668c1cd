"""Main text of web pages through wrappers inferred per host.

A page becomes a token stream with balanced tags.  The wrapper of a host is a union-free regular expression over tags and
text slots: it starts as the first page and is aligned with one page after the other.  Where streams differ, siblings of
one kind in a row fold into a repeated group, tokens missing on one side become optional, and differing texts become
slots.  Texts that stay the same on at least ``SUPPORT`` different pages are template: a text carries the least marks of the
pages it stands on, up to so many, so a text of one page stays a text of one page however many others the host has.  The
wrapper then says which paths
hold the article: the article or main element if the host has one, else the element with the most paragraph text, without
the parts that are menus, headers, footers, sidebars, notices, adverts, forms, scripts, styles or comments by their tag,
role or class, and outside article elements without template texts and link lists.  A link list is a container of blocks
whose text is mostly links; links in running text are text.

Wrappers are folded per task, merged per host and salt, then per host, so a host that owns a third of the pages is never
in one place; its wrapper is as small as any other's.  Pages that do not have the wrapper's article path are their own
wrapper.

Defined results: null and empty html give an empty text; null urls and urls without host share one wrapper; comments,
scripts and tags that never end reach to the end of the page; repeated pages count as one for template texts; plain text
without markup is one block; pages of any length and depth are read whole; an empty table gives an empty result.
"""

from __future__ import annotations

import json
import re
from collections.abc import Iterator
from functools import lru_cache
from html import unescape

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import attach, stage_table

SUPPORT = 5
SALTS = 64
WIDER = 1.5  # an outer element with so many times the text takes the place of the best holder
HOSTS_IN_MEMORY = 2000
SMALL_HOSTS = 5000
DEEPEST = 150  # elements below stand beside each other there, in order and with what encloses them
ALIGN_CELLS = 1 << 18

# Element kinds of HTML.
VOID = set("area base br col embed hr img input link meta param source track wbr".split())
RAW = set("script style title textarea xmp iframe noembed noframes".split())
BLOCKS = set("address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure "
             "footer form h1 h2 h3 h4 h5 h6 header hgroup hr html legend li main menu nav ol option p pre section summary "
             "table tbody tfoot thead tr ul".split())
SPACES = {"br", "td", "th"}
LISTS = set("aside center details dir div dl footer header menu nav ol section table ul".split())
CLOSES = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"},
          "th": {"td", "th"}, "option": {"option"}, "body": {"head"}}
SCOPES = {"li": {"ul", "ol", "menu"}, "dt": {"dl"}, "dd": {"dl"}, "tr": {"table"}, "td": {"table"}, "th": {"table"},
          "option": {"select"}}

# What is not article, by tag, by role, and by a part of a class or id.
NOT_ARTICLE = set("head nav footer aside form script style noscript template iframe button select textarea svg canvas object "
                  "dialog menu title label input audio video math noembed noframes".split())
ROLES = set("navigation banner contentinfo complementary search dialog alertdialog alert menu menubar toolbar form".split())
PARTS = set("ad ads adv advert adverts advertisement advertising adsense sponsor sponsored promo promotion banner cookie cookies "
            "consent gdpr notice notices notification alert warning popup modal overlay newsletter subscribe subscription signup "
            "share sharing social sidebar sidenav menu nav navbar navigation breadcrumb breadcrumbs footer masthead topbar "
            "comment comments commentlist disqus reply replies respond discussion related recommended recommendations teaser widget toolbar pagination "
            "pager login search skip disclaimer copyright legal paywall tagcloud header".split())
BODIES = ({"article"}, {"main"})
BODY_PARTS = ("articlebody", "article-body", "article-content", "post-content", "post-body", "entry-content", "story-body",
              "main-content", "article", "content")

_TOKEN = re.compile(
    r"<!--.*?(?:-->|\Z)|<[!?][^>]*(?:>|\Z)|</([a-zA-Z][^\s/>]*)[^>]*(?:>|\Z)"
    r"|<([a-zA-Z][^\s/>]*)((?:[^>\"']|\"[^\"]*\"|'[^']*')*)>|<([a-zA-Z][^\s/>]*)([^>]*)(?:>|\Z)", re.S)
_ATTRIBUTE = re.compile(r"([a-zA-Z][-\w:]*)(?:\s*=\s*(\"[^\"]*\"|'[^']*'|[^\s\"'>]+))?")
_NAMING = {"class", "id", "role", "hidden", "aria-hidden", "style", "itemprop"}


class Element:
    """A tag of a page with its children, texts among them as plain strings."""

    __slots__ = ("tag", "label", "bad", "children", "mark")

    def __init__(self, tag: str, attributes: str):
        self.tag, self.children, self.mark = tag, [], 0
        named = {}
        if attributes and ("=" in attributes or "hidden" in attributes):
            named = {k.lower(): unescape(v.strip("\"'")) for k, v in _ATTRIBUTE.findall(attributes) if k.lower() in _NAMING}
        every = f"{named.get('class', '')} {named.get('id', '')}".lower().split()
        words = [w for w in every if not re.search(r"\d", w)]
        self.label = ".".join([tag, *sorted(set(words))])
        if "itemprop" in named:
            self.label += "." + named["itemprop"].lower()
        if named.get("role", "").lower() == "main":
            self.label += ".role-main"
        parts = {p for w in every for p in re.split(r"[-_:\d]+", w)}
        whole = tag in ("html", "body", "main", "article") and not parts & {"comment", "comments", "reply"}
        self.bad = (tag in NOT_ARTICLE or named.get("role", "").lower() in ROLES or "hidden" in named
                    or named.get("aria-hidden", "").lower() == "true"
                    or re.search(r"display\s*:\s*none|visibility\s*:\s*hidden", named.get("style", "").lower()) is not None
                    or (not whole and bool(parts & PARTS)))


def parse(html: str) -> Element:
    """Balanced tree of a page; every unbalanced tag finds a place.  The root has the mark of the page."""
    import xxhash

    root = Element("#page", "")
    root.mark = xxhash.xxh64_intdigest(html)
    stack, at = [root], 0

    def hang(node) -> None:
        """Add a child to the innermost open element; from a depth on elements are siblings and go on behind each other."""
        if len(stack) <= DEEPEST:
            stack[-1].children.append(node)
            return
        beside = stack[DEEPEST - 1].children
        if isinstance(node, Element):
            node.bad |= stack[-1].bad
            beside.append(node)
            return
        if beside[-1] is not stack[-1]:  # an inner element stands between: the text goes on in a copy
            again = Element(stack[-1].tag, "")
            again.label, again.bad = stack[-1].label, stack[-1].bad
            beside.append(again)
            stack[-1] = again
        stack[-1].children.append(node)

    while at < len(html):
        found = _TOKEN.search(html, at)
        text = html[at:found.start()] if found else html[at:]
        if text:
            hang(text)
        if not found:
            break
        at = found.end()
        end, tag, attributes = found[1], found[2] or found[4], found[3] if found[2] else found[5]
        if end:
            name = end.lower()
            for i in range(len(stack) - 1, 0, -1):
                if stack[i].tag == name:
                    del stack[i:]
                    break
        elif tag:
            name = tag.lower()
            if name in BLOCKS:
                _close(stack, {"p"}, {"td", "th", "li", "div", "article", "section", "body", "blockquote"})
            if name in CLOSES:
                _close(stack, CLOSES[name], SCOPES.get(name, set()))
            element = Element(name, attributes or "")
            hang(element)
            if name in RAW:
                close = re.compile(rf"</{name}[^>]*(?:>|\Z)", re.I).search(html, at)
                element.children.append(html[at:close.start() if close else len(html)])
                at = close.end() if close else len(html)
            elif name not in VOID and not (attributes or "").endswith("/"):
                stack.append(element)
    return root


def _close(stack: list[Element], names: set[str], scopes: set[str]) -> None:
    """End the innermost open element of these names, unless one of the scopes is open inside it."""
    for i in range(len(stack) - 1, 0, -1):
        if stack[i].tag in names:
            del stack[i:]
            return
        if stack[i].tag in scopes:
            return


# ---------------------------------------------------------------- wrappers
# A wrapper item is [label, optional, repeated, text hash or None for a slot, children, chars, link chars, paragraph chars,
# the least SUPPORT marks of the pages with this same text].

def _item(node, link: bool = False, mark: int | None = None) -> list | None:
    import xxhash

    mark = node.mark if mark is None else mark
    if isinstance(node, str):
        text = " ".join(node.split())
        return ["#", 0, 0, xxhash.xxh64_hexdigest(text), [], len(text), len(text) if link else 0, 0, [mark]] if text else None
    own = [x for c in node.children if (x := _item(c, link or node.tag == "a", mark))] if node.tag not in RAW else []
    paragraph = sum(x[5] for x in own if x[0].split(".")[0] in ("p", "blockquote", "pre", "li", "#"))
    return [node.label + ("!" if node.bad else ""), 0, 0, None, fold(own), sum(x[5] for x in own), sum(x[6] for x in own), paragraph, []]


def fold(items: list[list]) -> list[list]:
    """Items of one kind in a row become one repeated item."""
    out: list[list] = []
    for x in items:
        if out and out[-1][0] == x[0]:
            out[-1] = merge(out[-1], x)
            out[-1][2] = 1
        else:
            out.append(x)
    return out


def merge(a: list, b: list) -> list:
    """One item for two aligned ones."""
    same = a[3] is not None and a[3] == b[3]
    return [a[0], a[1] | b[1], a[2] | b[2], a[3] if same else None, align(a[4], b[4]), a[5] + b[5], a[6] + b[6], a[7] + b[7],
            sorted({*a[8], *b[8]})[:SUPPORT] if same else []]


def align(left: list[list], right: list[list]) -> list[list]:
    """Longest common subsequence of kinds; what has no partner becomes optional."""
    if [x[0] for x in left] == [x[0] for x in right]:
        return [merge(a, b) for a, b in zip(left, right, strict=True)]
    n, m = len(left), len(right)
    if n * m > ALIGN_CELLS:
        return fold(_nearest(left, right))
    best = [[0] * (m + 1) for _ in range(n + 1)]
    for i in range(n - 1, -1, -1):
        for j in range(m - 1, -1, -1):
            best[i][j] = best[i + 1][j + 1] + 1 if left[i][0] == right[j][0] else max(best[i + 1][j], best[i][j + 1])
    out, i, j = [], 0, 0
    while i < n or j < m:
        if i < n and j < m and left[i][0] == right[j][0]:
            out.append(merge(left[i], right[j]))
            i, j = i + 1, j + 1
        elif j == m or (i < n and best[i + 1][j] >= best[i][j + 1]):
            out.append([left[i][0], 1, *left[i][2:]])
            i += 1
        else:
            out.append([right[j][0], 1, *right[j][2:]])
            j += 1
    return fold(out)


def _nearest(left: list[list], right: list[list]) -> list[list]:
    """Long lists are aligned in one pass: where kinds differ, the side whose next partner is farther waits."""
    ahead: list[dict[str, list[int]]] = [{}, {}]
    for places, items in zip(ahead, (left, right), strict=True):
        for k in range(len(items) - 1, -1, -1):
            places.setdefault(items[k][0], []).append(k)
    out, i, j = [], 0, 0
    while i < len(left) and j < len(right):
        a, b = left[i][0], right[j][0]
        if a == b:
            out.append(merge(left[i], right[j]))
            i, j = i + 1, j + 1
            continue
        for places, kind, here in ((ahead[1], a, j), (ahead[0], b, i)):
            while places.get(kind) and places[kind][-1] < here:
                places[kind].pop()
        to_right = ahead[1][a][-1] - j if ahead[1].get(a) else len(right)
        to_left = ahead[0][b][-1] - i if ahead[0].get(b) else len(left)
        if to_left <= to_right:
            out.append([a, 1, *left[i][2:]])
            i += 1
        else:
            out.append([b, 1, *right[j][2:]])
            j += 1
    return out + [[x[0], 1, *x[2:]] for x in left[i:]] + [[x[0], 1, *x[2:]] for x in right[j:]]


def _walk(items: list[list], path: str) -> Iterator[tuple[str, list]]:
    """All items with their paths; a part that is no article has a mark in its path."""
    for x in items:
        own = f"{path}/{x[0]}"
        yield own, x
        yield from _walk(x[4], own)


def compile_wrapper(wrapper: list, pages: int) -> dict:
    """Article paths, and the template texts and link lists outside article elements."""
    elements = [(path, x) for path, x in _walk(wrapper[4], "") if x[0] != "#" and "!" not in path]
    tag = lambda x: x[0].rstrip("!").split(".")
    for names in BODIES:
        roots = [p for p, x in elements if tag(x)[0] in names or (names == {"main"} and "role-main" in tag(x))]
        if roots:
            return {"roots": _outermost(roots), "texts": [], "lists": []}
    for part in BODY_PARTS:
        roots = [p for p, x in elements if part in tag(x)[1:]]
        if roots:
            return {"roots": _outermost(roots), "texts": [], "lists": []}
    size = {p: _article_chars(x) for p, x in elements if tag(x)[0] in BLOCKS} | {"": _article_chars(wrapper)}
    holders = [(x[7] - x[6], -p.count("/"), p) for p, x in elements if p in size and x[7] > x[6]]
    holders.append((wrapper[7] - wrapper[6], 0, ""))
    root = max(holders)[2]
    while root and size.get(up := root.rpartition("/")[0], 0) >= WIDER * size.get(root, 0):
        root = up
    texts = [[p, x[3]] for p, x in _walk(wrapper[4], "") if x[0] == "#" and len(x[8]) >= SUPPORT] if pages >= SUPPORT else []
    lists = [p for p, x in elements if tag(x)[0] in LISTS and x[5] and x[6] >= 0.6 * x[5] and not f"{root}/".startswith(f"{p}/")]
    return {"roots": [root], "texts": texts, "lists": lists}


def _article_chars(x: list) -> int:
    """Characters outside links and outside parts that are no article."""
    if x[0] == "#":
        return x[5] - x[6]
    return 0 if "!" in x[0] else sum(_article_chars(c) for c in x[4])


def _outermost(paths: list[str]) -> list[str]:
    return sorted(p for p in set(paths) if not any(p.startswith(q + "/") for q in paths))


def blocks(page: Element, found: dict) -> list[str] | None:
    """Texts of the blocks in the article; None if the page has no article path of the wrapper."""
    import xxhash

    roots, lists = set(found["roots"]), set(found["lists"])
    texts = {tuple(x) for x in found["texts"]}
    out: list[str] = []
    line: list[str] = []
    seen = False

    def flush() -> None:
        text = " ".join("".join(line).split())
        if text:
            out.append(text)
        line.clear()

    # An explicit stack: pages nest deeply.  Entries: node, path of the parent, inside an article; or a closing mark.
    todo: list = [(page, None, False)]
    while todo:
        node, path, inside = todo.pop()
        if node is None:
            flush()
            continue
        if isinstance(node, str):
            if inside:
                plain = unescape(node)
                if not (texts and plain.strip() and (f"{path}/#", xxhash.xxh64_hexdigest(" ".join(node.split()))) in texts):
                    line.append(plain)
            continue
        own = "" if path is None else f"{path}/{node.label}{'!' if node.bad else ''}"
        if node.bad or own in lists:
            flush() if node.tag in BLOCKS else None
            continue
        here = inside or own in roots
        seen |= here
        if node.tag in BLOCKS or (here and not inside):
            flush()
            todo.append((None, None, False))
        elif node.tag in SPACES:
            line.append(" ")
        if node.tag not in RAW:
            todo += [(c, own, here) for c in reversed(node.children)]
    flush()
    return out if seen else None


def main_text(html: str | None, found: dict | None = None) -> str:
    """Blocks of the article, one per line; the page's own wrapper serves where the given one does not fit."""
    if not html:
        return ""
    page = parse(html)
    got = blocks(page, found) if found else None
    if got is None:
        got = blocks(page, compile_wrapper(_item(page), 1)) or []
    return "\n".join(got)


def _fold_pages(batches: Iterator) -> Iterator:
    """(host, salt, wrapper, pages) of each task."""
    import xxhash

    held: dict[str, list] = {}
    seen: set[int] = set()
    for batch in batches:
        for host, html in zip(batch.column("host").to_pylist(), batch.column("html").to_pylist(), strict=True):
            mark = xxhash.xxh64_intdigest(html)
            if mark in seen:
                continue
            seen.add(mark)
            item = _item(parse(html))
            if host in held:
                held[host] = [merge(held[host][0], item), held[host][1] + 1, held[host][2]]
            else:
                held[host] = [item, 1, mark % SALTS]
            if len(held) > HOSTS_IN_MEMORY:
                yield _wrapper_rows(held)
                held, seen = {}, set()
    if held:
        yield _wrapper_rows(held)


def _wrapper_rows(held: dict[str, list]):
    import pyarrow as pa

    rows = [(host, salt, json.dumps(w), n) for host, (w, n, salt) in held.items()]
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(
        zip(*rows, strict=True), (pa.string(), pa.int32(), pa.string(), pa.int64()), strict=True)], names=["host", "salt", "wrapper", "pages"])


def _merge_wrappers(table):
    import pyarrow as pa

    rows = sorted(zip(table.column("wrapper").to_pylist(), table.column("pages").to_pylist(), strict=True))
    whole = json.loads(rows[0][0])
    for text, _ in rows[1:]:
        whole = merge(whole, json.loads(text))
    return pa.table({"host": table.column("host").slice(0, 1), "salt": table.column("salt").slice(0, 1),
                     "wrapper": pa.array([json.dumps(whole)]), "pages": pa.array([sum(n for _, n in rows)], pa.int64())})


_WRAPPER = "host string, salt int, wrapper string, pages bigint"


def wrappers(pages: DataFrame) -> DataFrame:
    """Written table (host, wrapper, pages): one wrapper per host, merged in two steps."""
    rows = pages.where(F.length("html") > 0).select("host", "html").mapInArrow(_fold_pages, _WRAPPER)
    rows = rows.groupBy("host", "salt").applyInArrow(_merge_wrappers, _WRAPPER)
    rows = rows.groupBy("host").applyInArrow(_merge_wrappers, _WRAPPER)
    return stage_table(rows.select("host", "wrapper", "pages"), "html-wrappers")


@lru_cache(maxsize=512)
def _compiled(wrapper: str, pages: int) -> dict:
    return compile_wrapper(json.loads(wrapper), pages)


def with_host(pages: DataFrame) -> DataFrame:
    return pages.withColumn("host", F.coalesce(F.lower(F.try_parse_url("url", F.lit("HOST"))), F.lit("")))


def extract(pages: DataFrame) -> DataFrame:
    """page_id, url, text, n_chars for every row of ``pages`` (page_id, url, html)."""
    given = with_host(pages.select("page_id", "url", "html"))
    met = attach(given, wrappers(given), "host", F.xxhash64("page_id"), small_rows=SMALL_HOSTS)

    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa

        for batch in batches:
            texts = [main_text(html, _compiled(w, n) if w else None) for html, w, n in zip(
                *(batch.column(c).to_pylist() for c in ("html", "wrapper", "pages")), strict=True)]
            yield pa.RecordBatch.from_arrays(
                [batch.column("page_id"), batch.column("url"), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())],
                names=["page_id", "url", "text", "n_chars"])

    key = pages.schema["page_id"].dataType.simpleString()
    return met.select("page_id", "url", "html", "wrapper", "pages").mapInArrow(
        run, f"page_id {key}, url string, text string, n_chars bigint")
