"""Main text of web pages by wrappers inferred per host.

A wrapper is a union-free regular expression over the token stream of a host's pages: tags in order,
nested; groups that are optional or repeated; texts that are constant or slots. Inference aligns one
page after another: neighbours that repeat fold into a repeated group, tokens that one side lacks
become optional, texts that differ become slots. Aligning two wrappers works the same way, so tasks
infer wrappers of what they have read and Spark merges them by host in two steps; only wrappers move,
never the pages of a host.

From the wrapper come, for pages without an article element, the host's constant texts by their places
(notices, slogans) and the region around the fullest slot text. Pages with an article element are read
by that element, without the wrapper. Parts whose element or class names a
role other than article text (menus, headers, forms, adverts, comments, ...) never count.
"""

from __future__ import annotations

import html
import json
import re
from collections.abc import Iterable, Iterator

import pandas as pd
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lectern.llm.columns import Batches, arrow_map, slices
from lectern.session import pin

TOKEN = re.compile(
    r"<!--.*?(?:-->|\Z)"
    r"|<(?P<raw>script|style|noscript|template|svg|textarea|iframe|object|math)\b[^>]*>.*?(?:</(?P=raw)\s*>|\Z)"
    r"|</?(?P<name>[a-z][a-z0-9:-]*)(?P<attrs>(?:\"[^\"]*\"|'[^']*'|[^'\">])*+)>"
    r"|<[/!?]?[a-z!?][^>]*(?:>|\Z)",
    re.I | re.S,
)
ATTRIBUTE = re.compile(r"(?<![\w-])(class|id|role|hidden|aria-hidden)(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+)))?", re.I)
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
BLOCK = frozenset(
    "html head body title article main section div header footer nav aside form p h1 h2 h3 h4 h5 h6 ul ol li dl dt dd "
    "table thead tbody tfoot tr td th caption blockquote pre figure figcaption address fieldset legend details summary "
    "hgroup menu dialog select option button center hr".split()
)
CLOSES_P = BLOCK - frozenset("td th caption option legend summary".split())
CLOSES_SAME = {
    "li": ("ul", "ol", "menu"), "dt": ("dl",), "dd": ("dl",), "tr": ("table",), "td": ("tr", "table"),
    "th": ("tr", "table"), "option": ("select",),
}
PAGE_ROLES = frozenset("head nav footer aside form button select dialog menu fieldset".split())
# Words in class, id or role that name something other than article text.
OTHER_ROLE = re.compile(
    r"(?:^|[\s_-])(?:ads?|adverts?|advertisements?|advertising|sponsor(?:ed)?|banner|promo(?:tion)?|nav|navigation|navbar|"
    r"menu|breadcrumbs?|sidebar|side-bar|header|masthead|footer|cookies?|cookie-?\w*|consent|gdpr|notice|alert|popup|"
    r"modal|overlay|newsletter|subscribe|signup|login|comments?|comment-?list|disqus|replies|reply|share|sharing|"
    r"social|related|recommended|widget|toolbar|pagination|pager|search|skip-?link|complementary|contentinfo|"
    r"copyright|legal)(?:$|[\s_-])",
    re.I,
)
# Names of the article's own head, and elements whose names and classes are the text's own.
ARTICLE_HEAD = re.compile(r"\b(?:article|post|entry|story|page|chapter|section)[_-]+header\b", re.I)
OWN_NAMES = frozenset("h1 h2 h3 h4 h5 h6 table caption thead tbody tfoot tr td th dt dd figure figcaption pre blockquote".split())
CONTENT_ROLE = re.compile(r"(?:^|\s)main(?:$|\s)", re.I)
LIMIT = 48  # children of an element before order among them is given up
DEPTH = 100  # levels of structure that are told apart; the text of deeper ones counts to the last of them

Path = tuple[str, ...]


class Element:
    __slots__ = ("children", "label", "name", "other")

    def __init__(self, name: str, label: str, other: bool):
        self.name, self.label, self.other, self.children = name, label, other, []


def _labelled(name: str, attrs: str, inside_article: bool) -> tuple[str, bool]:
    """The label that tells the elements of a page apart, and whether it is off the article."""
    label, other = name, name in PAGE_ROLES or (name == "header" and not inside_article)
    for key, *values in ATTRIBUTE.findall(attrs) if attrs else ():
        value = " ".join(values).strip()
        key = key.lower()
        if key == "hidden" or (key == "aria-hidden" and value.lower() == "true"):
            other = True
        elif key in ("class", "id", "role") and value:
            named = name not in OWN_NAMES and name not in ("html", "body", "article", "main")
            other = other or (named and bool(OTHER_ROLE.search(ARTICLE_HEAD.sub("", value))))
            if key == "role" and CONTENT_ROLE.search(value):
                name = "main"
            if key == "class":
                label = f"{name}.{'.'.join(sorted(set(value.split())))}"
    return ("article" if name in ("article", "main") else label), other


def parse(page: str | None) -> Element:
    """Blocks and structure of a page; markup inside blocks is gone, references are decoded."""
    root = Element("", "", False)
    # Beside every open element: whether it is off the article, whether it is in one, levels of structure.
    stack, states, text = [root], [(False, False, 0)], []
    at = 0

    def flush() -> None:
        whole = " ".join(html.unescape("".join(text)).split())
        text.clear()
        if whole:
            stack[-1].children.append(whole)

    def close(to: int) -> None:
        if any(e.name in BLOCK or e.other for e in stack[to:]):
            flush()
        del stack[to:]
        del states[to:]

    for m in TOKEN.finditer(page or ""):
        text.append(page[at : m.start()])
        at = m.end()
        name = (m["name"] or "").lower()
        if not name:
            continue
        if page[m.start() + 1] == "/":
            for i in range(len(stack) - 1, 0, -1):
                if stack[i].name == name:
                    close(i)
                    break
            continue
        if name == "br":
            text.append(" ")
            continue
        block = name in BLOCK
        if block:
            flush()
            limits = CLOSES_SAME.get(name, ())
            for i in range(len(stack) - 1, 0, -1):
                open_name = stack[i].name
                if (name in CLOSES_P and open_name == "p") or (limits and (open_name == name or {open_name, name} == {"dt", "dd"})):
                    close(i)
                    break
                if open_name in limits or (open_name in BLOCK and open_name != "p" and not limits):
                    break
        if name in VOID:
            continue
        off, inside, depth = states[-1]
        label, other = _labelled(name, m["attrs"], inside)
        if other and not block:
            flush()
        # Elements inside a block do not matter for the structure unless they name a role.
        element = Element(name, label, other)
        if (block or other) and (depth < DEPTH or not off and (other or (label == "article" and not inside))):
            stack[-1].children.append(element)
            depth += 1
        else:
            element.children = stack[-1].children
        stack.append(element)
        states.append((off or other, inside or label == "article", depth))
    text.append((page or "")[at:])
    close(1)
    flush()
    return root


def blocks(element: Element, path: Path = (), off: bool = False) -> Iterator[tuple[Path, bool, str]]:
    """(path, off the article, text) of every block in page order."""
    for child in element.children:
        if isinstance(child, str):
            yield path, off, child
        else:
            yield from blocks(child, (*path, child.label), off or child.other)


# A wrapper node is a list: [label, optional, repeated, pages, chars, text or children].
# Texts have the label "#"; None stands for a slot. Groups of siblings have labels in parentheses.


def as_wrapper(element: Element) -> list:
    children = []
    for child in element.children:
        if isinstance(child, str):
            children.append(["#", False, False, 1, len(child), child])
        elif not child.other:
            children.append([child.label, False, False, 1, 0, as_wrapper(child)])
    return bounded(fold(children))


def combine(a: list, b: list, pages: int) -> list:
    """One node for two of the same label."""
    new_page = pages > max(a[3], b[3])
    if a[0] == "#":
        inside = a[5] if a[5] == b[5] else None
    else:
        inside = any_order(a[5] + b[5], new_page) if a[0] == ANY else align(a[5], b[5], new_page)
    return [a[0], a[1] or b[1], a[2] or b[2], pages, a[4] + b[4], inside]


def fold(nodes: list) -> list:
    """Neighbouring repeats of one to four siblings become one repeated node or group."""
    for period in (1, 2, 3, 4):
        out = []
        i = 0
        while i < len(nodes):
            labels = [n[0] for n in nodes[i : i + period]]
            j = i + period
            while len(labels) == period and [n[0] for n in nodes[j : j + period]] == labels:
                j += period
            if j == i + period or len(labels) < period:
                out.append(nodes[i])
                i += 1
                continue
            merged = nodes[i : i + period]
            for k in range(i + period, j, period):
                merged = [combine(x, y, max(x[3], y[3])) for x, y in zip(merged, nodes[k : k + period], strict=True)]
            if period == 1:
                merged[0][2] = True
                out += merged
            else:
                out.append([f"({' '.join(labels)})", False, True, max(n[3] for n in merged), 0, merged])
            i = j
        nodes = out
    return nodes


def align(a: list, b: list, new_page: bool = True) -> list:
    """The least general sequence found that covers both: common nodes merge, others become optional."""
    n, m = len(a), len(b)
    best = [[0] * (m + 1) for _ in range(n + 1)]
    for i in range(n - 1, -1, -1):
        for j in range(m - 1, -1, -1):
            skip = max(best[i + 1][j], best[i][j + 1])
            best[i][j] = max(skip, best[i + 1][j + 1] + 1) if a[i][0] == b[j][0] else skip
    out, i, j = [], 0, 0
    while i < n or j < m:
        if i < n and j < m and a[i][0] == b[j][0] and best[i][j] == best[i + 1][j + 1] + 1:
            pages = a[i][3] + b[j][3] if new_page else max(a[i][3], b[j][3])
            out.append(combine(a[i], b[j], pages))
            i, j = i + 1, j + 1
        elif j == m or (i < n and best[i + 1][j] >= best[i][j + 1]):
            out.append([a[i][0], True, *a[i][2:]])
            i += 1
        else:
            out.append([b[j][0], True, *b[j][2:]])
            j += 1
    return bounded(fold(out))


ANY = "(*)"  # any order: a repeated group of optional nodes, one per label


def any_order(nodes: list, new_page: bool) -> list:
    by_label: dict[str, list] = {}
    for node in [x for y in nodes for x in (y[5] if y[0] == ANY else [y])]:
        known = by_label.get(node[0])
        pages = known and (known[3] + node[3] if new_page else max(known[3], node[3]))
        by_label[node[0]] = combine(known, node, pages) if known else node
    return [[x[0], True, True, *x[3:]] for x in by_label.values()]


def bounded(nodes: list) -> list:
    """``nodes``, or any order of them if there are too many, so that no alignment grows with a page."""
    if len(nodes) <= LIMIT:
        return nodes
    return [[ANY, True, True, max(x[3] for x in nodes), 0, any_order(nodes, False)]]


def reading(pages: int, wrapper: list) -> dict:
    """What extraction needs of a wrapper: constant texts outside articles by place, and the region of the article.

    A constant says how many of its texts a page has there, 0 for any number. The region starts around
    the fullest slot texts and grows while slots stand beside it.
    """
    constants: dict[tuple[Path, str], int] = {}
    weight: dict[Path, int] = {}

    def walk(nodes: list, path: Path, inside: bool, many: bool) -> None:
        for label, _, repeated, seen, chars, inner in nodes:
            several = many or repeated
            if label == "#":
                if not inside and inner is not None and seen >= 3:
                    known = constants.get((path, inner))
                    constants[path, inner] = 0 if several or known == 0 else (known or 0) + 1
                if inner is None or pages < 3:
                    weight[path] = weight.get(path, 0) + chars
            elif label.startswith("("):
                walk(inner, path, inside, several)
            else:
                walk(inner, (*path, label), inside or label == "article", several)

    walk(wrapper, (), False, False)
    below: dict[Path, int] = {}
    for path, chars in weight.items():
        for n in range(len(path) + 1):
            below[path[:n]] = below.get(path[:n], 0) + chars
    place = max(sorted(weight), key=weight.get)[:-1] if weight else ()
    while place and below[place[:-1]] > below[place]:
        place = place[:-1]
    held = [[list(path), text, n] for (path, text), n in sorted(constants.items())]
    return {"constants": held if weight else [], "place": list(place)}


def main_text(page: str | None, rule: dict) -> list[str]:
    """The article's blocks. Without an article element: what varies in the host's region of the article."""
    found = [(path, text) for path, off, text in blocks(parse(page)) if not off]
    article = [text for path, text in found if "article" in path]
    if article:
        return article
    place = tuple(rule["place"])
    left = {(tuple(path), text): n or len(found) for path, text, n in rule["constants"]}
    rest = []
    for path, text in found:
        if left.get((path, text), 0):
            left[path, text] -= 1
        else:
            rest.append((path, text))
    return [text for path, text in rest if path[: len(place)] == place] or [text for _, text in rest]


def _merge_all(rows: pd.DataFrame) -> pd.DataFrame:
    pages, wrapper = 0, None
    rows = rows.sort_values(["wrapper", "pages"])  # the order of arrival must not matter
    for n, text in zip(rows["pages"], rows["wrapper"], strict=True):
        other = json.loads(text)
        pages, wrapper = pages + int(n), other if wrapper is None else align(wrapper, other)
    return pd.DataFrame({"host": [rows["host"].iloc[0]], "pages": [pages], "wrapper": [json.dumps(wrapper)]})


def host_of(url):
    return F.coalesce(F.lower(F.regexp_extract(url, r"^[A-Za-z][A-Za-z0-9+.-]*://([^/?#]*)", 1)), F.lit(""))


def infer_wrappers(pages: DataFrame, url: str = "url", html_column: str = "html") -> DataFrame:
    """``host``, ``pages`` and ``wrapper`` (JSON): one row per host, from every page of the host."""
    rows = pages.select(host_of(pages[url]).alias("host"), pages[html_column].alias("html"))

    def infer(batches: Batches) -> Iterable[dict]:
        known: dict[str, tuple[int, list]] = {}

        def result() -> dict:
            return {
                "host": list(known),
                "part": [TaskContext.get().partitionId() % 64] * len(known),
                "pages": [n for n, _ in known.values()],
                "wrapper": [json.dumps(w) for _, w in known.values()],
            }

        for whole in batches:
            for batch in slices(whole, "html"):
                for host, page in zip(batch.column("host").to_pylist(), batch.column("html").to_pylist(), strict=True):
                    new = as_wrapper(parse(page))
                    n, wrapper = known.get(host, (0, None))
                    known[host] = n + 1, new if wrapper is None else align(wrapper, new)
            if len(known) > 2000:
                yield result()
                known.clear()
        yield result()

    partial = arrow_map(rows, infer, "host string, part int, pages bigint, wrapper string")
    schema = "host string, pages bigint, wrapper string"
    # A host on very many tasks merges in two steps, so no group holds more than a share of its wrappers.
    merged = partial.groupBy("host", "part").applyInPandas(_merge_all, schema)
    return merged.groupBy("host").applyInPandas(_merge_all, schema)


def extract_main_text(
    pages: DataFrame, page_id: str = "page_id", url: str = "url", html_column: str = "html", broadcast_mb: int = 16
) -> DataFrame:
    """``page_id``, ``url``, ``text`` (blocks joined by newlines, empty if none) and ``n_blocks`` per row.

    Null and empty pages give empty text; pages without a host share the wrapper of "". Repeated rows
    count as pages. The rules per host are broadcast if all of them together measure at most
    ``broadcast_mb``, else joined by host.
    """

    def read(batches: Batches) -> Iterable[dict]:
        for batch in batches:
            hosts, numbers, wrappers = (batch.column(c).to_pylist() for c in ("host", "pages", "wrapper"))
            rules = [json.dumps(reading(n, json.loads(w))) for n, w in zip(numbers, wrappers, strict=True)]
            yield {"host": hosts, "rule": rules}

    rules = pin(arrow_map(infer_wrappers(pages, url, html_column), read, "host string, rule string"))
    size = rules.agg(F.sum(F.length("rule") + F.length("host") + 64).alias("n")).first()["n"] or 0
    rows = pages.select(
        pages[page_id].alias("page_id"), pages[url].alias("url"), pages[html_column].alias("html"),
        host_of(pages[url]).alias("host"),
    )
    joined = rows.join(F.broadcast(rules) if size <= broadcast_mb << 20 else rules, "host", "left")

    def extract(batches: Batches) -> Iterable[dict]:
        for whole in batches:
            for batch in slices(whole, "html"):
                rule = {r: json.loads(r) for r in set(batch.column("rule").to_pylist())}
                found = [
                    main_text(page, rule[r])
                    for page, r in zip(batch.column("html").to_pylist(), batch.column("rule").to_pylist(), strict=True)
                ]
                yield {
                    "page_id": batch.column("page_id"),
                    "url": batch.column("url"),
                    "text": ["\n".join(b) for b in found],
                    "n_blocks": [len(b) for b in found],
                }

    id_type = pages.schema[page_id].dataType.simpleString()
    return arrow_map(
        joined.select("page_id", "url", "html", "rule"), extract, f"page_id {id_type}, url string, text string, n_blocks int"
    )
