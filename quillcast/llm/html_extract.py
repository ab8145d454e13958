"""Main text of web pages by line-block distribution.

Markup is stripped into lines, one for each block of text. What is known by its
markup not to be article text (menus, headers, footers, sidebars, notices,
adverts, forms, comments, code) is left out. A line's size is its text outside
links. Sizes are summed over windows of WINDOW lines: where a sum reaches SURGE
the text surges, and where it falls below again it dives. The page's dense lines
are those between, and they show where the article is: from the container of
the densest window it is widened to the next outer one as long as that adds a
SHARE of dense text; an article or main element is not left. All lines of that
container are kept. If nothing but the page itself holds the dense lines, the
text is what lies between its first surge and its last dive.

Each page is its own job inside a mapInArrow batch: no shuffle, and no state.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from html import unescape

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

WINDOW, SURGE, SHARE = 3, 86, 0.25

_TOKEN = re.compile(r"""<!--.*?(?:-->|\Z)|<[!?][^>]*(?:>|\Z)|<(/?)([a-zA-Z][^\s/>]*)((?:[^>"']|"[^"]*"|'[^']*')*)(>|\Z)?""", re.S)
_ATTR = re.compile(r"""([a-zA-Z_:@][-\w:.]*)(?:\s*=\s*("[^"]*"|'[^']*'|[^\s"'>]+))?""")
_BLOCKS = frozenset("address article aside blockquote body caption center dd details dialog div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 head header hgroup hr html legend li main menu nav ol option p pre section summary table tbody td tfoot th thead title tr ul".split())
_VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
#: Elements whose content is no markup: they end at their own end tag only.
_RAW = frozenset("script style textarea title noscript template iframe xmp noembed noframes".split())
_DROP = frozenset("head nav footer aside form menu dialog select button svg math object audio video canvas".split()) | _RAW
_HEADINGS = frozenset("h1 h2 h3 h4 h5 h6 hgroup".split())
_ROLES = frozenset("navigation banner contentinfo complementary search form alert alertdialog dialog menu menubar toolbar note".split())
#: Whole class names and ids, with or without an ending for a box, that name what is no article text.
_NAMES = re.compile(
    r"(?:ads?|adverts?|advertis\w*|adsense|banners?|sponsor(?:ed|s)?|promos?|promotions?|(?:side|nav)-?bar|(?:sub|top|main|site|side|page|global|footer|header)?[-_]?(?:menu|nav|navigation)|breadcrumbs?|"
    r"(?:site|page|main|top|global)?[-_]?(?:header|footer)|masthead|topbar|(?:user|reader|post|article)?[-_]?comments?|commentlist|disqus|repl(?:y|ies)|(?:cookies?|site|legal|privacy|gdpr)?[-_]?(?:notices?|consent)|cookies?|gdpr|popup|modal|overlay|"
    r"newsletter|subscribe|subscription|signup|login|share|sharing|social|related|recommend(?:ed|ations?)|widgets?|pagination|pager|search|skip-?link|copyright|disclaimer|toolbar)"
    r"(?:[-_]?(?:ba(?:r|nner)|box(?:es)?|block|slot|unit|list|links?|items?|wrap(?:per)?|container|section|area|widget|inner|outer|top|bottom|left|right|form|buttons?|icons?|articles?|posts?|stories|\d+))*",
    re.I,
)
_NAMED = frozenset("div section ul ol dl aside span p figure table header".split())
#: A paragraph, table or figure is text unless its name says that it was put there by others.
_PLACED = re.compile(r"(?:ads?|adverts?|advertis\w*|sponsor(?:ed|s)?|promos?|(?:cookies?|legal|privacy)?[-_]?notices?|cookies?|newsletter|copyright|disclaimer)", re.I)
_COMMENT = re.compile(r"(?:comments?|repl(?:y|ies)|related|recommend(?:ed|ations?)|teasers?|promos?|ads?)(?:[-_]?(?:item|box|body|\d+))*", re.I)
_CONTAINERS = frozenset("article main section div td body".split())
#: A dropped one of these ends where the next block begins.
_LOOSE = frozenset("p li dt dd option".split())
_HIDDEN = re.compile(r"display\s*:\s*none|visibility\s*:\s*hidden", re.I)


def _attributes(text: str) -> dict[str, str]:
    return {k.lower(): unescape((v or "").strip("\"'")) for k, v in _ATTR.findall(text)}


def _dropped(tag: str, a: dict[str, str]) -> bool:
    if tag in _DROP or a.get("role", "").lower() in _ROLES or "hidden" in a or a.get("aria-hidden") == "true" or _HIDDEN.search(a.get("style", "")):
        return True
    names = f"{a.get('class', '')} {a.get('id', '')}".split()
    if tag == "article":
        return any(_COMMENT.fullmatch(n) for n in names)
    if tag not in _NAMED:
        return False
    known = _PLACED if tag in ("p", "table", "figure", "span") else _NAMES
    return any(known.fullmatch(n) for n in names)


class _Page:
    """A page's lines (text, characters of it inside links, container), and the containers' outer ones and kinds."""

    def __init__(self, html: str):
        self.lines: list[tuple[str, int, int]] = []
        self.outer, self.kind = [-1], ["html"]
        parts: list[str] = []
        links: list[str] = []
        stack, own, opened = [("html", 0)], 0, Counter()  # open containers; the innermost; how many are open of each name
        in_link, headings_only, depth = 0, False, 0  # depth: headers open inside an article
        skip, inside = "", Counter()  # the element dropped, and what is open within it
        at, end = 0, len(html)

        def flush() -> None:
            text = " ".join(unescape("".join(parts)).split())
            if text:
                self.lines.append((text, len(" ".join(unescape("".join(links)).split())), own))
            parts.clear(), links.clear()

        while at < end:
            m = _TOKEN.search(html, at)
            chunk = html[at : m.start() if m else end]
            if chunk and not skip:
                parts.append(chunk)
                if in_link:
                    links.append(chunk)
            if not m:
                break
            at = m.end()
            tag = (m[2] or "").lower()
            if not tag:
                continue
            if m[4] is None:  # a quote that never closes: the tag still ends at the next >
                close = html.find(">", at)
                at = end if close < 0 else close + 1
            closing, alone = bool(m[1]), tag in _VOID or (m[3] or "").endswith("/")
            if skip:
                if closing:
                    if inside[tag]:
                        inside[tag] -= 1
                        if not inside[skip]:
                            skip = ""
                        continue
                    if not opened[tag] or tag == skip:
                        continue
                    skip = ""  # its parent ends: it was never closed
                elif skip in _LOOSE and (tag == skip or tag in _BLOCKS and skip == "p") or tag in ("article", "main") and skip not in ("article", "main", "form"):
                    skip = ""
                else:
                    inside[tag] += not alone
                    continue
            if tag in _BLOCKS:
                flush()
            if closing:
                if tag == "a":
                    in_link = max(0, in_link - 1)
                elif tag == "header":
                    headings_only = False
                if opened[tag]:
                    while True:
                        name, _ = stack.pop()
                        opened[name] -= 1
                        depth -= name in ("article", "main")
                        if name == tag:
                            break
                    own = stack[-1][1]
                continue
            if tag == "br":
                parts.append(" ")
                continue
            a = _attributes(m[3]) if m[3] and ("=" in m[3] or "hidden" in m[3]) else {}
            out = tag not in ("html", "body") and _dropped(tag, a)
            if tag == "header" and not out:
                headings_only, out = depth > 0, depth == 0
            if out:
                flush()
                if tag in _RAW:
                    close = re.compile(rf"</{tag}\b[^>]*(?:>|\Z)", re.I).search(html, at)
                    at = close.end() if close else end
                elif not alone:
                    skip, inside = tag, Counter({tag: 1})
                continue
            if headings_only and tag in _BLOCKS and tag not in _HEADINGS and tag != "header":
                skip, inside = tag, Counter({tag: 1})
                continue
            if tag == "a":
                in_link += 1
            if tag in _CONTAINERS and not alone:
                self.outer.append(own)
                self.kind.append("article" if tag == "article" or a.get("itemprop") == "articleBody" else "main" if tag == "main" or a.get("role") == "main" else "html" if tag == "body" else tag)
                own = len(self.outer) - 1
                stack.append((tag, own))
                opened[tag] += 1
                depth += tag in ("article", "main")
        flush()


def dense_lines(sizes: list[int], window: int = WINDOW, surge: int = SURGE) -> list[bool]:
    """Whether each line lies in a window of lines whose sizes add up to the surge, or to the page's largest sum if none does; lines without size don't."""
    ends = [0]
    for s in sizes:
        ends.append(ends[-1] + s)
    n = len(sizes)
    sums = [ends[min(n, i + window)] - ends[i] for i in range(max(1, n - window + 1))]
    least = max(1, min(surge, max(sums)))
    dense, until = [], 0
    for i in range(n):
        if i < len(sums) and sums[i] >= least:
            until = i + window
        dense.append(i < until and sizes[i] > 0)
    return dense


def main_text(html: str) -> str:
    """The article's blocks, joined by empty lines; '' if the page has no text."""
    page = _Page(html)
    lines = page.lines
    sizes = [len(t) - linked if 2 * linked <= len(t) else 0 for t, linked, _ in lines]
    if not any(sizes):
        sizes = [len(t) for t, _, _ in lines]
    if not lines:
        return ""
    dense = dense_lines(sizes)
    held = [0] * len(page.outer)  # dense text of each container and all within it
    for (_, _, own), size, d in zip(lines, sizes, dense):
        held[own] += size * d
    for i in range(len(held) - 1, 0, -1):  # an outer container always comes before
        held[page.outer[i]] += held[i]
    marked = [i for i, kind in enumerate(page.kind) if kind in ("article", "main") and held[i]]
    if marked:
        most = max(held[i] for i in marked)
        roots = {i for i in marked if held[i] >= SHARE * most}
        roots = {i for i in roots if page.kind[i] == "article"} or roots
    else:
        sums = [sum(s for s, d in zip(sizes[i : i + WINDOW], dense[i : i + WINDOW]) if d) for i in range(len(sizes))]
        top = next(i for i in range(len(sizes)) if sums[i] == max(sums))
        root = lines[next(i for i in range(top, len(sizes)) if dense[i])][2]
        up = root
        while up > 0:
            up = page.outer[up]
            if held[up] >= (1 + SHARE) * held[root]:
                root = up
        roots = {root}
    within = [False] * len(page.outer)
    for i in range(len(within)):
        within[i] = i in roots or i > 0 and within[page.outer[i]]
    kept = [i for i, (_, _, own) in enumerate(lines) if within[own]]
    if all(page.kind[i] == "html" for i in roots):
        some = [i for i in kept if dense[i]]
        kept = [i for i in kept if some[0] - WINDOW < i < some[-1] + WINDOW and _joins(i, some, sizes)]
    return "\n\n".join(lines[i][0] for i in kept)


def _joins(i: int, some: list[int], sizes: list[int]) -> bool:
    """Whether the line lies between the first surge and the last dive, the windows at both ends included."""
    if some[0] <= i <= some[-1]:
        return True
    span = range(i, some[0]) if i < some[0] else range(some[-1] + 1, i + 1)
    return all(sizes[k] for k in span)


def _extract(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        texts = [main_text(h.as_py() or "") for h in batch.column(2)]
        yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())], ["id", "url", "text", "n_chars"])


def extract_pages(pages: DataFrame, page_id: str = "page_id", url: str = "url", html: str = "html") -> DataFrame:
    """page_id, url, text and n_chars (code points) for every row.

    Null, empty or text-free html: empty text. Plain text without markup is one
    block. Cut-off pages give what they hold. Ids and addresses pass through,
    nulls and repeats too. Empty table: empty result. Other columns are ignored.
    """
    types = {c: pages.schema[c].dataType.simpleString() for c in (page_id, url)}
    rows = pages.select(F.col(page_id).alias("id"), F.col(url).alias("url"), F.col(html).cast("string").alias("html"))
    made = rows.mapInArrow(_extract, f"id {types[page_id]}, url {types[url]}, text string, n_chars long")
    return made.select(F.col("id").alias(page_id), F.col("url").alias(url), "text", "n_chars")
