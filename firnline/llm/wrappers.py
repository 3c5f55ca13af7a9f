"""Main text of web pages by wrappers inferred per host.

A wrapper is a union-free regular expression over the token streams (tags and texts) of a host's pages,
kept as a tree: a node has a label (tag and names), is plain, optional or repeated, and a text is a
literal or, once two pages differ there, a slot. Inference is iterative: a page's own tree is folded
(neighbouring siblings, or groups of siblings, with the same labels become one repeated group), then
aligned with the wrapper so far; what only one side has becomes optional, texts that differ become slots.

Pages of a host are first folded together within each task, then partial wrappers are merged in two
rounds, so no task sees all pages of a host. Wrappers hold structure, not texts. Which nodes are content
is decided on the wrapper: parts that the page furniture names (menus, notices, adverts, comments and so
on) are left out, and the article or main element is taken where the page has one, otherwise the smallest
part that holds all texts that vary. Every page is then aligned with its host's wrapper, and its texts at
content nodes are its main text, block by block.
"""

from __future__ import annotations

import html
import json
import re
import zlib
from bisect import bisect_left
from collections.abc import Callable, Iterator
from itertools import accumulate

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from firnline.llm.texts import ship
from firnline.session import broadcast_if_small, stored

#: Fixed values of HTML: elements that never have content, whose content is no markup, and that begin a block.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea title noscript template iframe svg xmp".split())
BLOCKS = frozenset(("address article aside blockquote body caption center dd details dialog div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6"
                    " head header hr html legend li main menu nav ol option p pre section summary table tbody td tfoot th thead tr ul").split())
CLOSED_BY = {"p": BLOCKS - {"html", "head", "body"}, "li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "tbody", "tfoot"},
             "td": {"td", "th", "tr", "tbody", "tfoot"}, "th": {"td", "th", "tr", "tbody", "tfoot"}, "option": {"option"}, "head": {"body"}}
FURNITURE_TAGS = frozenset("nav footer aside form head script style noscript template iframe svg button select textarea dialog menu title option".split())
FURNITURE_NAMES = frozenset(("ad ads advert adverts advertisement advertising sponsor sponsored promo promotion banner cookie cookies consent gdpr notice notices alert popup"
                             " modal overlay newsletter subscribe signup sidebar side menu nav navbar navigation breadcrumb breadcrumbs pagination pager footer masthead"
                             " comment comments discussion replies disqus share sharing social related recommended widget legal copyright skip toolbar"
                             " contentinfo complementary search").split())
HEADER_NAMES = frozenset(("header", "banner", "masthead", "topbar"))
CONTENT = frozenset(("article", "main"))
#: Elements that class and id words never judge: they stand for the page or its text, or head a part of it (ids of headings are often made of their words).
UNJUDGED = frozenset("html body main article h1 h2 h3 h4 h5 h6".split()) | {""}
NEGATIONS = frozenset("no not non without with has".split())
DISCUSSION = frozenset("comment comments discussion replies disqus".split())
#: Elements that are pieces of a text, never the part that holds it.
NARROW = frozenset("# p li ul ol dl dt dd h1 h2 h3 h4 h5 h6 blockquote pre".split())
DEPTH = 150
TOKEN = re.compile(r"<!--.*?(?:-->|\Z)|<[!?][^>]*(?:>|\Z)|<(/?)([A-Za-z][A-Za-z0-9:-]*)((?:[^>\"']|\"[^\"]*\"|'[^']*')*)(?:>|\Z)|[^<]+|<", re.S)
NAMES = re.compile(r"(?:^|\s)(class|id|role)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]+))", re.I)


def label_words(attribute: str, value: str) -> list[str]:
    """Words of a class, role or id for a label: those of an id begin with #, those that say what is not there (no-sidebar) with _."""
    out = []
    for name in value.split():
        words = [w for w in re.split(r"[^a-z]+", name) if w]
        mark = "#" if attribute == "id" else "_" if words and (words[0] in NEGATIONS or name == "side-by-side") else ""
        out += [mark + w for w in words]
    return out


def parse(page: str) -> list:
    """Tree of the page's block elements: [label, children], with ["#", text] for a run of text."""
    root = ["", []]
    stack, run, at = [("", root)], [], 0

    def close_run() -> None:
        text = " ".join("".join(run).split())
        run.clear()
        if text:
            stack[-1][1][1].append(["#", text])

    while at < len(page):
        m = TOKEN.match(page, at)
        at = m.end()
        tag = m.group(2)
        if tag is None:
            if m.group()[0] != "<" or len(m.group()) == 1:
                run.append(html.unescape(m.group()))
            continue
        tag, closing = tag.lower(), m.group(1)
        if not closing and tag in RAW:
            end = re.compile(rf"</{tag}\b[^>]*>?", re.I).search(page, at)
            at = end.end() if end else len(page)
            continue
        if tag == "br":
            run.append(" ")
        if tag in VOID or tag not in BLOCKS:
            continue
        close_run()
        if closing:
            depth = next((i for i in range(len(stack) - 1, 0, -1) if stack[i][0] == tag), 0)
            if depth:
                del stack[depth:]
            continue
        while len(stack) > 1 and tag in CLOSED_BY.get(stack[-1][0], ()):
            stack.pop()
        node = [".".join([tag, *sorted({w for g in NAMES.findall(m.group(3)) for w in label_words(g[0].lower(), (g[1] or g[2] or g[3]).lower())})]), []]
        stack[min(len(stack), DEPTH) - 1][1][1].append(node)
        stack.append((tag, node if len(stack) < DEPTH else stack[DEPTH - 1][1]))
    close_run()
    return root


def folded(node: list) -> list:
    """Wrapper of one page: [label, flags, children, characters of own texts on all pages]; a text is ["#", mark].

    flags: 1 optional, 2 repeated. mark: 0 for a slot, a hash for a literal, negative if several pages have it.
    """
    if node[0] == "#":
        return ["#", zlib.crc32(node[1].encode()) or 1]
    return [node[0], 0, fold_list([folded(c) for c in node[1]]), sum(len(c[1]) for c in node[1] if c[0] == "#")]


def fold_list(items: list, join: Callable[[list, list], list] | None = None) -> list:
    """Neighbouring groups of up to four siblings with equal labels become one repeated group."""
    join = join or repeated_node
    for size in range(1, 5):
        out: list = []
        i = 0
        while i < len(items):
            group = items[i:i + size]
            before = out[-size:]
            if len(group) == size == len(before) and [x[0] for x in group] == [x[0] for x in before] and (size > 1 or group[0][0] != "#"):
                out[-size:] = [join(a, b) for a, b in zip(before, group, strict=True)]
                i += size
            else:
                out.append(items[i])
                i += 1
        items = out
    return items


def lengths(a: list[str], b: list[str]) -> list[int]:
    """Length of the longest common subsequence of a and each beginning of b; a bit per entry of b."""
    raw = {x: bytearray(len(b) // 8 + 1) for x in set(a)}
    for j, y in enumerate(b):
        if y in raw:
            raw[y][j >> 3] |= 1 << (j & 7)
    places = {x: int.from_bytes(r, "little") for x, r in raw.items()}
    every = (1 << len(b)) - 1
    free = every
    for x in a:
        hits = free & places[x]
        free = ((free + hits) | (free - hits)) & every
    return [0, *accumulate(1 - int(bit) for bit in reversed(f"{free:0{len(b)}b}"))] if b else [0]


def common(a: list[str], b: list[str]) -> list[tuple[int, int]]:
    """A longest common subsequence; long lists are halved where the lengths of both sides add up best, so memory stays linear."""
    if len(a) > 1 and len(a) * len(b) > 250_000:
        half = len(a) // 2
        before, after = lengths(a[:half], b), lengths(a[:half - 1:-1], b[::-1])[::-1]
        cut = max(range(len(b) + 1), key=lambda j: before[j] + after[j])
        return common(a[:half], b[:cut]) + [(half + i, cut + j) for i, j in common(a[half:], b[cut:])]
    best = [[0] * (len(b) + 1) for _ in range(len(a) + 1)]
    for i in range(len(a) - 1, -1, -1):
        for j in range(len(b) - 1, -1, -1):
            best[i][j] = best[i + 1][j + 1] + 1 if a[i] == b[j] else max(best[i + 1][j], best[i][j + 1])
    out, i, j = [], 0, 0
    while i < len(a) and j < len(b):
        if a[i] == b[j]:
            out.append((i, j))
            i, j = i + 1, j + 1
        elif best[i + 1][j] >= best[i][j + 1]:
            i += 1
        else:
            j += 1
    return out


def pairs(left: list, right: list) -> list[tuple[int, int]]:
    """Alignment of two sibling lists by label: a longest common subsequence."""
    a, b = [x[0] for x in left], [x[0] for x in right]
    return [(i, i) for i in range(len(a))] if a == b else common(a, b)


def places(children: list, kids: list) -> list[int | None]:
    """Place among kids (siblings of a wrapper) of each of a page's children, None for labels that kids lack.

    The children are folded like the wrapper and aligned with it; what is left goes on from the last place,
    or back to the start of a repeated group.
    """
    out: list[int | None] = [None] * len(children)

    def together(a: list, b: list) -> list:
        a[1].extend(b[1])
        return a

    groups = fold_list([[c[0], [i]] for i, c in enumerate(children)], together)
    for x, y in pairs(groups, kids):
        for i in groups[x][1]:
            out[i] = y
    by_label: dict[str, list[int]] = {}
    for k, n in enumerate(kids):
        by_label.setdefault(n[0], []).append(k)
    last = 0
    for i, c in enumerate(children):
        if out[i] is None and c[0] in by_label:
            same = by_label[c[0]]
            at = bisect_left(same, last)
            out[i] = same[at] if at < len(same) else same[0]
        last = last if out[i] is None else out[i]
    return out


def merged(left: list, right: list, repeated: bool = False, one_page: bool = False) -> list:
    """Wrapper that fits whatever fits left or right; both have the same label."""
    one_page = one_page or repeated
    if left[0] == "#":
        same = abs(left[1]) == abs(right[1])
        return ["#", (min(left[1], right[1]) if one_page else -abs(left[1])) if same else 0]
    flags = left[1] | right[1] | (2 if repeated else 0)
    out, i, j = [], 0, 0
    for x, y in [*pairs(left[2], right[2]), (len(left[2]), len(right[2]))]:
        out.extend(optional(n) for n in (*left[2][i:x], *right[2][j:y]))
        if x < len(left[2]):
            out.append(merged(left[2][x], right[2][y], one_page=one_page))
        i, j = x + 1, y + 1
    return [left[0], flags, fold_list(out), left[3] + right[3]]


def repeated_node(left: list, right: list) -> list:
    return merged(left, right, True)


def optional(node: list) -> list:
    return node if node[0] == "#" else [node[0], node[1] | 1, *node[2:]]


def furniture_tag(label: str, in_content: bool) -> bool:
    tag = label.split(".")[0]
    return tag in FURNITURE_TAGS or (tag == "header" and not in_content)


def furniture_names(label: str, in_content: bool) -> bool:
    tag, *names = label.split(".")
    if tag in UNJUDGED:
        return False
    # an id in the text is an anchor, except that of the discussion; ids of pieces of a text are anchors everywhere
    ids = {n[1:] for n in names if n[0] == "#" and tag not in NARROW}
    judged = {n for n in names if n[0] != "#"} | (ids & DISCUSSION if in_content else ids)
    return bool(FURNITURE_NAMES & judged) or (not in_content and bool(HEADER_NAMES & judged))


def is_furniture(label: str, in_content: bool) -> bool:
    return furniture_tag(label, in_content) or furniture_names(label, in_content)


class Content(set):
    """Numbers of content nodes; without has those for pages that meet none of the first."""

    without: set[int] = frozenset()


def content_nodes(wrapper: list) -> Content:
    """Preorder numbers of the wrapper's nodes whose texts are content.

    They are the article and main elements, and for pages without any of these (all pages, if the host has
    none) the smallest part that holds all varying texts outside of them.
    A header with a heading that varies belongs to the text. Class and id words do not judge a part that holds more than half of the text that varies. Of the
    discussion's words one does even then, unless the part has the page's main heading.
    """
    nodes: list[tuple[list, int, int, bool, bool]] = []  # node, parent, end of its part, left out, below a content element

    def titled(node: list, heading: bool = False) -> bool:
        """Whether a heading in it varies: then it heads the text, not the site."""
        if node[0] == "#":
            return heading and node[1] >= 0
        return any(titled(c, heading or node[0].split(".")[0] in ("h1", "h2", "h3")) for c in node[2])

    def number(node: list, parent: int, out: bool, inside: bool) -> None:
        me = len(nodes)
        tag, *names = node[0].split(".")
        inside = inside or ((tag == "header" or bool(HEADER_NAMES.intersection(n.lstrip("#") for n in names))) and titled(node))
        out = out or (node[0] != "#" and furniture_tag(node[0], inside))
        nodes.append((node, parent, 0, out, inside))
        for c in node[2] if node[0] != "#" else ():
            number(c, me, out, inside or node[0].split(".")[0] in CONTENT)
        nodes[me] = (node, parent, len(nodes), out, inside)

    number(wrapper, -1, False, False)
    held, headed = [0] * len(nodes), [False] * len(nodes)
    for every in (False, True):  # where nothing varies, all texts count
        for i in range(len(nodes) - 1, -1, -1):
            n, parent, _, out, _ = nodes[i]
            if n[0] == "#":
                continue
            if not out and any(c[0] == "#" and (every or c[1] >= 0) for c in n[2]):
                held[i] += n[3]
            headed[i] = headed[i] or n[0].split(".")[0] == "h1"
            if parent >= 0:
                held[parent] += held[i]
                headed[parent] = headed[parent] or headed[i]
        if held[0]:
            break
    for i, (n, parent, end, out, inside) in enumerate(nodes):
        if parent >= 0 and not out and n[0] != "#":
            most = 2 * held[i] > held[0] and (headed[i] or not DISCUSSION.intersection(w.lstrip("#") for w in n[0].split(".")[1:]))
            out = furniture_names(n[0], inside) and not most
        nodes[i] = (n, parent, end, out or (parent >= 0 and nodes[parent][3]), inside)
    tops = [i for i, (n, _, _, out, _) in enumerate(nodes) if not out and n[0].split(".")[0] in CONTENT]
    within = {j for i in tops for j in range(i, nodes[i][2])}
    texts = [i for i, (n, _, _, out, _) in enumerate(nodes) if n[0] == "#" and not out and i not in within]
    texts = [i for i in texts if nodes[i][0][1] >= 0] or texts
    here = texts[0] if texts else 0
    while here and (nodes[here][2] <= texts[-1] or nodes[here][0][0].split(".")[0] in NARROW):  # up to what holds them all
        here = nodes[here][1]
    other = {j for j in range(here, nodes[here][2]) if not nodes[j][3]}
    content = Content({j for j in within if not nodes[j][3]} if tops else other)
    content.without = other if tops else frozenset()
    return content


def main_text(page: list, wrapper: list, content: Content, alone: bool = False) -> str:
    """Texts of the page's tree at content nodes of the wrapper, one block a line.

    Siblings are aligned with the wrapper's; repeated ones fall on one node, and what a content node lacks is
    kept. A page that
    has no text there is judged by its own tree.
    """
    sizes: dict[int, int] = {}

    def size(node: list) -> int:
        if id(node) not in sizes:
            sizes[id(node)] = 1 if node[0] == "#" else 1 + sum(map(size, node[2]))
        return sizes[id(node)]

    def numbered(node: list, me: int) -> list[tuple[list, int]]:
        kids, at = [], me + 1
        for c in node[2]:
            kids.append((c, at))
            at += size(c)
        return kids

    def texts(wanted: set[int]) -> tuple[list[str], bool]:
        out: list[str] = []
        met = False

        def rest(node: list) -> None:
            for c in node[1]:
                if c[0] == "#":
                    out.append(c[1])
                elif not is_furniture(c[0], True):
                    rest(c)

        def walk(node: list, frame: list, me: int) -> None:
            nonlocal met
            met = met or (me in wanted)
            kids = numbered(frame, me)
            for c, place in zip(node[1], places(node[1], frame[2]), strict=True):
                if c[0] == "#":
                    if me in wanted:  # whether the wrapper has a text here or not
                        out.append(c[1])
                elif place is not None:
                    walk(c, *kids[place])
                elif me in wanted and not is_furniture(c[0], True):
                    rest(c)

        walk(page, wrapper, 0)
        return out, met

    found, met = texts(content)
    if not met and content.without:
        found, _ = texts(content.without)
    if found or alone or not page[1]:
        return "\n".join(found)
    own = folded(page)
    return main_text(page, own, content_nodes(own), True)


HOST = r"^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]+)"


#: Beginnings of the tags that tell templates apart, without their attributes other than class.
PARTS = r"(?is)<((?:body|main|article|section|div|table|header|footer|nav|aside)\b)(?:[^>]*?\sclass\s*=\s*[\"']?([^\"'>]*))?"


def host_of(url, page):
    """Host of the URL; pages without one go by the tags and classes they use, as " " and a hash."""
    host = F.lower(F.coalesce(F.regexp_extract(url, HOST, 1), F.lit("")))
    page = F.coalesce(page, F.lit(""))
    parts = F.zip_with(F.regexp_extract_all(page, F.lit(PARTS), 1), F.regexp_extract_all(page, F.lit(PARTS), 2), lambda t, c: F.concat_ws(".", t, c))
    kind = F.array_join(F.array_sort(F.array_distinct(F.transform(parts, lambda x: F.regexp_replace(F.lower(x), "[^a-z.]+", " ")))), "|")
    return F.when(host != "", host).otherwise(F.concat(F.lit(" "), F.md5(kind)))


def infer(pages: DataFrame) -> DataFrame:
    """host, wrapper (as JSON) of every host of pages(host, html)."""
    def within_task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found: dict[str, list] = {}
            for host, page in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                own = folded(parse(page.as_py() or ""))
                found[host] = merged(found[host], own) if host in found else own
            yield pa.RecordBatch.from_pydict({"host": list(found), "wrapper": [json.dumps(w) for w in found.values()]})

    def together(key: tuple, part: pd.DataFrame) -> pd.DataFrame:
        all_ = sorted(part["wrapper"])
        out = json.loads(all_[0])
        for w in all_[1:]:
            out = merged(out, json.loads(w))
        return pd.DataFrame({"host": [key[0]], "wrapper": [json.dumps(out)]})

    kind = "host string, wrapper string"
    partial = pages.select("host", "html").mapInArrow(within_task, kind).distinct()
    salted = partial.groupBy("host", F.pmod(F.xxhash64("wrapper"), F.lit(64))).applyInPandas(together, kind)
    return salted.groupBy("host").applyInPandas(together, kind)


def main_texts(pages: DataFrame) -> DataFrame:
    """page_id, url, text of every page; NULL or empty html gives an empty text, pages without a host are grouped by structure.

    Repeated rows stay; other columns are ignored.
    """
    ship(pages.sparkSession)
    rows = pages.select("page_id", "url", host_of(F.col("url"), F.col("html")).alias("host"), "html")
    found = stored(infer(rows), "wrappers")
    kind = f"page_id {dict(pages.dtypes)['page_id']}, url string, text string"

    def extract(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ready: dict[str, tuple[list, Content]] = {}
        for batch in batches:
            out = []
            for page, raw in zip(batch.column(2), batch.column(3).to_pylist(), strict=True):
                if raw not in ready:
                    if len(ready) >= 1000:
                        ready.clear()
                    wrapper = json.loads(raw)
                    ready[raw] = (wrapper, content_nodes(wrapper))
                out.append(main_text(parse(page.as_py() or ""), *ready[raw]))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(out, pa.string())], ["page_id", "url", "text"])

    joined = rows.join(broadcast_if_small(found), "host").select("page_id", "url", "html", "wrapper")
    return joined.mapInArrow(extract, kind)
