"""HTML main text by line-block distribution.

1. Strip markup: a tolerant scanner reads tags, comments and raw-text elements.  Block elements
   end lines.  What stands in navigation, page headers and footers, sidebars, notices, adverts,
   forms, comment sections or hidden elements leaves a gap: one empty line, and one for each block in it.  White
   space between the tags of two blocks is no line.
2. Sum text lengths over a sliding window of ``WINDOW`` lines; link text does not count.
3. Surge: a window over the threshold that begins with a non-empty line.  Dive: the end of the run of
   windows over zero.  The text between surge and dive is kept, and a surge takes
   with it the non-empty lines directly above.
4. Main element: where a page marks one (article or main), its text weighs ``MAIN_WEIGHT`` times, link text
   included, against the largest surge outside.  If it weighs as much, surges are sought among its lines only,
   where gaps do not count (an advert between two paragraphs ends no article);
   if not (a teaser beside unmarked text), the mark is ignored and all lines count alike.
5. If no window reaches the threshold, it is lowered to the largest window.

Character references are decoded, white space inside a line becomes one space, lines are joined by
one space.  Nothing is capped.

Edge cases: null, empty and markup-only pages give an empty text.  Unclosed or truncated elements end
with their parent or the page, elements whose end tag may be left out also with the next one; a tag cut off at the end
of the page is dropped.  Repeated rows are done one by one.

An element is noise by its tag, a hidden state, or words of its class, id and role: outside the main element also by a part of
a name (ad-slot), inside it by whole class tokens and roles.  Headings are no noise by name, nor is an
element that holds most of the page's text by a part of a name, nearly all by a whole one, or all of it.
"""

from __future__ import annotations

import html as _html
import re
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T

from . import rows, workspace

WINDOW = 3
THRESHOLD = 86
MAIN_WEIGHT = 3
RAW = "script|style|noscript|template|textarea|title|iframe|object|canvas|svg|math|xmp|noembed|noframes"
TOKEN = re.compile(
    rf"<!--.*?(?:-->|\Z)|<(?:svg|math)\b[^>]*/>|<(?P<raw>{RAW})\b[^>]*>.*?(?:</(?P=raw)\s*>|\Z)"
    r"|<(?P<end>/?)(?P<name>[a-zA-Z][a-zA-Z0-9:-]*)(?P<attrs>(?:[^<>\"']|\"[^\"]*\"|'[^']*')*+)>"
    r"|</?(?P<odd>[a-zA-Z][a-zA-Z0-9:-]*)[^<>]*>|<[!?/][^>]*>|<[a-zA-Z!/?][^<>]*\Z",
    re.S | re.I,
)
BLOCKS = frozenset("address article aside blockquote body br caption center dd details dialog dir div dl dt fieldset figcaption figure footer form frameset h1 h2 h3 h4 h5 h6 head header hgroup hr html legend li main menu nav ol option p pre section summary table tbody td tfoot th thead tr ul".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
DROPPED = frozenset("nav footer aside form menu head button select dialog".split())
MAIN = frozenset(("article", "main"))
#: Words of class, id and role that mark what is not the article.
NOISE = frozenset("ad ads adv advert adverts advertisement advertising sponsor sponsored promo promotion banner cookie cookies consent gdpr notice notices sidebar menu nav navbar navigation breadcrumb breadcrumbs footer comment comments commentlist respond reply replies discussion disqus share sharing social related recommended recommendations newsletter subscribe signup login popup modal overlay widget widgets toolbar pagination pager search complementary contentinfo masthead topbar".split())
COMMENTS = frozenset("comment comments commentlist respond reply replies disqus".split())
#: Words of names that speak of noise elsewhere, as has-sidebar.
STATES = frozenset("has no with without".split())
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
#: Noise by a part of a name, by a whole name, by a whole name of comments, by the element itself.
WEAK, STRONG, LAST, SURE = 1, 2, 3, 4
#: Scans of a page in search of wrappers that are named like noise.
WRAPPERS = 4
_P_ENDS = frozenset("address article aside blockquote center details dialog dir div dl dd dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr li main menu nav ol p pre section table ul".split())
_CELLS = frozenset(("td", "th", "tr", "tbody", "tfoot", "thead"))
#: Elements whose end tag may be left out, with the start tags that end them.
CLOSED_BY = {"p": _P_ENDS, "li": frozenset(("li",)), "dt": frozenset(("dt", "dd")), "dd": frozenset(("dt", "dd")), "td": _CELLS, "th": _CELLS, "tr": _CELLS - {"td", "th"}, "tbody": frozenset(("tbody", "tfoot", "thead")), "thead": frozenset(("tbody", "tfoot")), "option": frozenset(("option", "optgroup"))}
OWN_HEADER = frozenset("article entry post content story page title".split())
_WORDS = re.compile(r"[a-z0-9]+")
_ATTR = re.compile(r"\b(class|id|role|hidden|aria-hidden|style)\b(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+)))?", re.I)


@lru_cache(maxsize=4096)
def noise_kind(name: str, attrs: str, inside: bool = False) -> int:
    """Whether an element by its name and attributes holds no article text: 0 no, else WEAK, STRONG or SURE.

    In the main element (``inside``) whole class tokens and roles count only; names of headings never do.
    """
    if name in DROPPED:
        return SURE
    if name in ("html", "body"):
        return 0
    kind = 0
    for key, *values in _ATTR.findall(attrs):
        key, value = key.lower(), next((v for v in values if v), "").lower()
        if key == "hidden" or (key == "aria-hidden" and value == "true"):
            return SURE
        if key == "style":
            if re.search(r"display\s*:\s*none|visibility\s*:\s*hidden", value):
                return SURE
            continue
        if name in HEADINGS or (inside and key == "id"):
            continue
        if key == "role" and value == "banner":
            kind = max(kind, STRONG)
        for token in value.split():
            words = set(_WORDS.findall(token))
            if token in NOISE:
                kind = max(kind, LAST if token in COMMENTS else STRONG)
            elif not inside and not words & STATES and words & NOISE:
                kind = max(kind, WEAK)
        words = set(_WORDS.findall(value))
        if "header" in words and not words & OWN_HEADER and name not in MAIN and (not inside or "header" in value.split()):
            kind = max(kind, WEAK)
    return kind


def _is_wrapper(kind: int, held: int, total: int, inside: bool, main: int) -> bool:
    """Whether an element that is noise by its names holds so much of the page that it is a wrapper of the text."""
    if kind == WEAK:
        return 2 * held > total
    return held == total or (kind == STRONG and 4 * held > 3 * total and (inside or not main))


Line = tuple[str | None, int, bool]


def lines_of(page: str) -> tuple[list[Line], bool]:
    """((text, length without link text, in the main element) of each line, whether there is a main element).

    The text of an empty line that is a gap is None.
    """
    spared: set[int] = set()
    for _ in range(WRAPPERS):
        lines, has_main, dropped = _scan(page, spared, SURE)
        main = sum(len(t) for t, _, inside in lines if inside and t)
        total = sum(len(t) for t, _, _ in lines if t) + sum(held for _, _, held, _ in dropped)
        more = {at for at, kind, held, inside in dropped if held and _is_wrapper(kind, held, total, inside, main)}
        if not more:
            return lines, has_main
        spared |= more
    return _scan(page, spared, 0)[:2]  # wrappers within wrappers: such names say nothing on this page


def _scan(page: str, spared: set[int], trusted: int) -> tuple[list[Line], bool, list[tuple[int, int, int, bool]]]:
    """Lines, whether there is a main element, and (place, kind, text length, in the main element) of what was dropped by names.

    Elements that start at ``spared`` are not dropped by names; none is if trusted is 0.
    """
    out: list[Line] = []
    dropped: list[tuple[int, int, int, bool]] = []
    parts: list[str] = []
    link = inside = held = gap = 0
    has_main = in_link = False
    opened: list[str] = []  # the open elements around the text, by the names that matter
    count: dict[str, int] = {}
    open_noise: list[str] = []  # the noise element, and what is in it by the names that matter
    root = (0, SURE, False)

    def close() -> None:
        nonlocal link
        text = " ".join(_html.unescape("".join(parts)).split())
        out.append((text, max(0, len(text) - link), inside > 0))
        parts.clear()
        link = 0

    def text(a: int, b: int) -> None:
        nonlocal link, held
        if a >= b:
            return
        if open_noise:
            held += len(" ".join(page[a:b].split()))
            return
        parts.append(page[a:b])
        if in_link:
            link += len(" ".join(_html.unescape(page[a:b]).split()))

    def end_noise() -> None:
        nonlocal gap
        open_noise.clear()
        out.extend([(None, 0, False)] * (1 + gap))
        gap = 0
        if root[1] < SURE:
            dropped.append((root[0], root[1], held, root[2]))

    def noise_of(name: str, attrs: str, at: int) -> int:
        kind = SURE if name == "header" and not inside else noise_kind(name, attrs, inside > 0)
        return 0 if kind < SURE and (not trusted or at in spared) else kind

    def leave(name: str) -> None:
        while opened:
            last = opened.pop()
            count[last] -= 1
            if last == name:
                return

    at = 0
    for m in TOKEN.finditer(page):
        text(at, m.start())
        at = m.end()
        name = m["name"] or m["odd"]
        if not name:
            continue
        name, end, attrs = name.lower(), bool(m["end"]) or m[0].startswith("</"), m["attrs"] or ""
        if open_noise:
            if not end and (name == "body" or (name in MAIN and not has_main and not noise_of(name, attrs, m.start()))):
                end_noise()  # an unclosed container does not swallow the article
            elif end and (name in ("body", "html") or (name in MAIN and inside and name not in open_noise)):
                end_noise()  # nor what follows its parent
            elif end and name in open_noise:
                while open_noise.pop() != name:
                    pass
                if not open_noise:
                    end_noise()
                    close()
                continue
            elif end:
                if not count.get(name):
                    continue
                end_noise()  # the end of an element around it
                close()
            else:
                while open_noise and name in CLOSED_BY.get(open_noise[-1], ()):
                    open_noise.pop()
                gap += name in BLOCKS
                if open_noise:
                    if (name in BLOCKS or name in open_noise) and name not in VOID and not attrs.endswith("/"):
                        open_noise.append(name)
                    continue
                end_noise()  # an end tag that may be left out
                close()
        if not end:
            while opened and name in CLOSED_BY.get(opened[-1], ()):
                count[opened.pop()] -= 1
        kind = 0 if end or name in VOID else noise_of(name, attrs, m.start())
        if kind:
            close()
            if not attrs.endswith("/"):
                open_noise.append(name)
                root, held = (m.start(), kind, inside > 0), 0
            continue
        if name == "a":
            in_link = not end
        if name in BLOCKS:
            close()
            in_link = in_link and name in ("br", "wbr")
            if name in MAIN:
                inside = inside + 1 if not end else max(0, inside - 1)
                has_main = True
            if end and count.get(name):
                leave(name)
            elif not end and name not in VOID and not attrs.endswith("/"):
                opened.append(name)
                count[name] = count.get(name, 0) + 1
    text(at, len(page))
    close()
    if open_noise:
        end_noise()
    return out, has_main, dropped


def surges(size: list[int], window: int, threshold: int) -> list[tuple[int, int]]:
    """(from, to) of the text between surge and dive points, for the sizes of lines."""
    n = len(size)
    upto = [0]
    for s in size:
        upto.append(upto[-1] + s)
    block = [upto[min(i + window, n)] - upto[i] for i in range(n)]
    found, i = [], 0
    while i < n:
        if not (size[i] and block[i] >= threshold):
            i += 1
            continue
        a = i
        while a and size[a - 1]:
            a -= 1
        while i < n and block[i]:
            i += 1
        found.append((a, i))
    return found


def _lowered(size: list[int], window: int, threshold: int) -> int:
    """The threshold, or the largest window where none reaches it."""
    most = max((sum(size[i:i + window]) for i in range(len(size))), default=0)
    return min(threshold, max(1, most))


def main_text(page: str | None, *, window: int = WINDOW, threshold: int = THRESHOLD) -> str:
    """The text between surge and dive points of a page."""
    if not page:
        return ""
    lines, _ = lines_of(page)
    lines = [x for x in lines if x[0] != ""]
    inside, outside = [len(t) for t, _, main in lines if main and t], [n for _, n, main in lines if not main]
    most = max((sum(outside[a:b]) for a, b in surges(outside, window, threshold)), default=0)
    size = [n for _, n, _ in lines]
    if inside and MAIN_WEIGHT * sum(inside) >= most:
        size, lines = inside, [x for x in lines if x[2] and x[0]]
    return " ".join(t for a, b in surges(size, window, _lowered(size, window, threshold)) for t, _, _ in lines[a:b] if t)


FIELDS = [T.StructField("text", T.StringType()), T.StructField("n_chars", T.LongType())]


def extract(pages: DataFrame, *, html: str = "html", window: int = WINDOW, threshold: int = THRESHOLD) -> DataFrame:
    """``pages`` with text and n_chars."""

    def work(column: pa.Array) -> list[pa.Array]:
        found = [main_text(x, window=window, threshold=threshold) for x in column.to_pylist()]
        return [pa.array(found, pa.string()), pa.array([len(x) for x in found], pa.int64())]

    return rows.extend(pages, html, FIELDS, work)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """op9: the main text of every page."""
    return extract(workspace.table(spark, sf_dir, "pages").select("page_id", "url", "html")).select("page_id", "url", "text", "n_chars")

#: The pages of the test tables have one article without noise inside: blocks between its tags, references decoded.
ORACLE_SQL = r"""
WITH a AS (SELECT page_id, url, regexp_extract(coalesce(html, ''), '(?s)<article>(.*?)(</article>|$)', 1) AS inner_html FROM pages),
b AS (SELECT page_id, url, list_transform(regexp_split_to_array(inner_html, '</?p>|</?h1>|<br>'), lambda x: regexp_replace(x, '<[^>]*>', '', 'g')) AS blocks FROM a),
r AS (SELECT page_id, url, list_transform(blocks, lambda x: regexp_replace(replace(replace(replace(replace(replace(x,
        '&nbsp;', ' '), '&lt;', '<'), '&gt;', '>'), '&quot;', '"'), '&#39;', chr(39)), '&amp;?', '&', 'g')) AS blocks FROM b),
c AS (SELECT page_id, url, list_transform(blocks, lambda x: trim(regexp_replace(x, '[\s\x{A0}]+', ' ', 'g'))) AS blocks FROM r),
t AS (SELECT page_id, url, array_to_string(list_filter(blocks, lambda x: x <> ''), ' ') AS text FROM c)
SELECT page_id, url, text, CAST(length(text) AS BIGINT) AS n_chars FROM t
"""
