"""Main text of web pages: block parsing, and differencing against the page with the nearest url of the same host."""

from __future__ import annotations

import html
import re
from collections.abc import Iterator
from typing import NamedTuple

import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from auditloom.llm.common import durable
from auditloom.llm.url_filter import host_path

#: Consecutive pages of a host that one alignment task group takes.
CHUNK = 256
#: A neighbour that shares more than this part of a page's lines may be a near copy; such lines need a third page that has them.
COPY_SHARE = 0.5
#: Pages on either side of a page among which its neighbours and those third pages are found.
REACH = 4
#: Bits that an alignment of two pages may hold at once; longer pages are aligned by halves.
TABLE_BITS = 1 << 26

_TAG = re.compile(r"""<(/?)([a-zA-Z][^\s/>]*+)((?:[^>"']++|"[^"]*+"|'[^']*+')*+)>|<[!?][^>]*>""", re.S)
_LOOSE = re.compile(r"<(/?)([a-zA-Z][^\s/>]*+)([^>]*)>")
_ATTR = re.compile(r"""([a-zA-Z-]+)\s*=\s*("[^"]*"|'[^']*'|[^\s"'>]+)""")
RAW = {"script", "style", "textarea", "title", "xmp", "iframe", "noembed", "noframes"}
VOID = {"area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "param", "source", "track", "wbr"}
BLOCKS = {
    "address", "article", "aside", "blockquote", "body", "caption", "center", "dd", "details", "dialog", "dir", "div", "dl", "dt",
    "fieldset", "figcaption", "figure", "footer", "form", "h1", "h2", "h3", "h4", "h5", "h6", "head", "header", "hgroup", "hr", "html",
    "legend", "li", "main", "menu", "nav", "ol", "p", "pre", "section", "summary", "table", "tbody", "td", "tfoot", "th", "thead", "tr", "ul",
}
#: Elements that are never part of an article, and names by which pages mark such parts in class, id or role.
DROPPED = {"head", "nav", "footer", "aside", "form", "script", "style", "noscript", "template", "svg", "iframe", "button", "select", "textarea", "menu", "dialog", "object", "canvas", "audio", "video", "title", "fieldset"}
MARKS = {
    "ad", "ads", "advert", "adverts", "advertisement", "advertising", "sponsor", "sponsored", "promo", "promotion", "banner",
    "nav", "navbar", "navigation", "menu", "breadcrumb", "breadcrumbs", "pagination", "pager", "sidebar", "aside", "widget", "related",
    "footer", "cookie", "cookies", "consent", "notice", "popup", "modal", "overlay", "newsletter", "subscribe", "subscription", "signup",
    "comment", "comments", "commentlist", "respond", "disqus", "share", "sharing", "social", "complementary", "contentinfo", "search", "login",
}
#: Marks and elements that are dropped outside of the article only: inside, a header holds its title.
OUTSIDE = {"header", "masthead", "topbar"}


class Block(NamedTuple):
    text: str
    inside: bool  # within an article or main element


def _marked(attrs: str) -> set[str]:
    names: set[str] = set()
    if attrs:
        for name, value in _ATTR.findall(attrs):
            if name.lower() in ("class", "id", "role"):
                names.update(re.split(r"[^a-z0-9]+", html.unescape(value.strip("\"'")).lower()))
    return names


def parse(page: str) -> list[Block]:
    """Text blocks of a page in order, without the parts that elements or their marks tell apart from an article.

    Inline markup vanishes, ``br`` counts as white space, and every block-level tag ends a block. Character
    references are decoded before white space is folded. If the page has an article, only blocks of articles count as
    inside; if it has none, those of main; else none does.
    """
    blocks: list[tuple[str, bool, bool]] = []
    words: list[str] = []
    dropped = ""  # the element whose end is awaited while skipping
    depth, article, main, at, size = 0, 0, 0, 0, len(page)
    last = {mark: page.rfind(mark) for mark in (">", "-->", "]]>")}  # no search runs past the last one, so the scan is linear

    def flush() -> None:
        text = " ".join(html.unescape("".join(words)).split())
        words.clear()
        if text:
            blocks.append((text, article > 0, main > 0))

    while at < size:
        lt = page.find("<", at)
        if lt < 0:
            lt = size
        if lt > at and not dropped:
            words.append(page[at:lt])
        if lt == size:
            break
        if lt > last[">"]:  # no tag is closed from here on; a comment without an end hides the rest
            if not dropped and not page.startswith("<!--", lt):
                words.append(page[lt:])
            break
        mark = "-->" if page.startswith("<!--", lt) else "]]>" if page.startswith("<![CDATA[", lt) else ""
        if mark and last[mark] >= lt + 4:
            at = page.index(mark, lt + 4) + 3
            continue
        m = _TAG.match(page, lt) or _LOOSE.match(page, lt)
        if not m:
            if not dropped:
                words.append("<")
            at = lt + 1
            continue
        at = m.end()
        if not m.group(2):
            continue
        end, name, attrs = m.group(1), m.group(2).lower(), m.group(3)
        if not end and name in RAW and not attrs.endswith("/"):
            close = re.compile(rf"</{re.escape(name)}[\s/>]", re.I).search(page, at)
            at = close.start() if close else size
            close = _TAG.match(page, at) if close else None
            at = close.end() if close else at
            continue
        if dropped:
            if name == dropped and (end or name != "p"):
                depth += -1 if end else 1
                if depth == 0:
                    dropped = ""
            elif dropped in ("p", "li") and name in BLOCKS and (end or name == "p"):
                dropped, depth = "", 0  # an unclosed paragraph ends with its parent or the next one
                if not end and name == "p":
                    flush()
                elif name in ("article", "main"):
                    flush()
                    article, main = max(0, article - (name == "article")), max(0, main - (name == "main"))
            continue
        if name == "br":
            words.append(" ")
        if name in BLOCKS:
            flush()
        if end:
            if name == "article":
                article = max(0, article - 1)
            elif name == "main":
                main = max(0, main - 1)
            continue
        if name in VOID or attrs.endswith("/"):
            continue
        marks = _marked(attrs)
        outside = not article and (name == "header" or marks & OUTSIDE)
        if name in DROPPED or (marks & MARKS and name not in ("html", "body", "main")) or outside:
            flush()
            dropped, depth = name, 1
        elif name == "article":
            article += 1
        elif name == "main" or "main" in marks and "role" in attrs:
            main += name == "main"
    flush()
    if any(a for _, a, _ in blocks):
        return [Block(t, a) for t, a, _ in blocks]
    return [Block(t, m) for t, _, m in blocks]


def _rows(own: list[int], other: list[int], keep: bool) -> list[int]:
    """Bit vectors of the longest common subsequences of growing parts of ``own`` with all starts of ``other``.

    A vector's zeros up to bit j count the lines that the part has in common with ``other[:j + 1]``. All rows with
    ``keep``, else the last.
    """
    at: dict[int, int] = {}
    for j, line in enumerate(other):
        at[line] = at.get(line, 0) | 1 << j
    mask = (1 << len(other)) - 1
    v, rows = mask, []
    for line in own:
        u = v & at.get(line, 0)
        v = (v + u | v - u) & mask
        if keep:
            rows.append(v)
    return rows if keep else [v]


def _lengths(v: int, n: int) -> list[int]:
    """Common lines with the starts of 0 to n lines."""
    out = [0]
    for bit in reversed(f"{v:0{n}b}" if n else ""):
        out.append(out[-1] + (bit == "0"))
    return out


def shared_lines(own: list[int], other: list[int]) -> list[int]:
    """Positions in ``own`` of a longest common subsequence with ``other``.

    Lines that only one side has are left out and equal ends are matched first; the rest is aligned by bit vectors, and by
    halves where these would take more than TABLE_BITS.
    """
    here, there = set(own), set(other)
    places = [i for i, line in enumerate(own) if line in there]
    a, b = [own[i] for i in places], [line for line in other if line in here]
    return [places[i] for i in _aligned(a, b)]


def _aligned(a: list[int], b: list[int]) -> list[int]:
    n = 0
    while n < min(len(a), len(b)) and a[n] == b[n]:
        n += 1
    m = 0
    while m < min(len(a), len(b)) - n and a[-1 - m] == b[-1 - m]:
        m += 1
    ends = list(range(n)), list(range(len(a) - m, len(a)))
    x, y = a[n : len(a) - m], b[n : len(b) - m]
    if not x or not y:
        inner = []
    elif len(x) * len(y) <= TABLE_BITS or len(x) == 1:
        rows, inner, i, j = _rows(x, y, True), [], len(x) - 1, len(y) - 1
        while i >= 0 and j >= 0:
            upto, above = (2 << j) - 1, rows[i - 1] if i else -1
            if x[i] == y[j]:
                inner.append(i)
                i, j = i - 1, j - 1
            elif (rows[i] & upto).bit_count() == (above & upto).bit_count():
                i -= 1
            else:
                j -= 1
        inner.reverse()
    else:
        half = len(x) // 2
        ahead = _lengths(_rows(x[:half], y, False)[0], len(y))
        behind = _lengths(_rows(x[half:][::-1], y[::-1], False)[0], len(y))[::-1]
        cut = max(range(len(y) + 1), key=lambda j: ahead[j] + behind[j])
        inner = _aligned(x[:half], y[:cut]) + [half + i for i in _aligned(x[half:], y[cut:])]
    return ends[0] + [n + i for i in inner] + ends[1]


def _alike(a: str, b: str) -> int:
    """Length of the common start of two paths."""
    n = min(len(a), len(b))
    return next((i for i in range(n) if a[i] != b[i]), n)


def _align(pdf: pd.DataFrame) -> pd.DataFrame:
    pdf = pdf.sort_values("rank", kind="stable")
    hosts, paths, ranks, own = pdf["host"].tolist(), pdf["path"].tolist(), pdf["rank"].tolist(), pdf["own"].tolist()
    lines = [list(map(int, x)) for x in pdf["lines"]]
    sets, same, found = [frozenset(x) for x in lines], pdf["same"].tolist(), []
    for i in range(len(pdf)):
        if not own[i]:
            continue
        near = []
        for side in (range(i - 1, max(-1, i - REACH - 1), -1), range(i + 1, min(len(pdf), i + REACH + 1))):
            others = [j for j in side if hosts[j] == hosts[i] and abs(ranks[j] - ranks[i]) <= REACH and sets[j] != sets[i]]
            near += [(n, -_alike(paths[i], paths[j]), j) for n, j in enumerate(others)]
        if not near:
            continue
        first, *rest = [j for *_, j in sorted(near)]
        shared, rest = shared_lines(lines[i], lines[first]), [j for j in rest if sets[j] != sets[first]]
        if rest and len(shared) > COPY_SHARE * len(lines[i]):
            known = frozenset().union(*(sets[j] for j in rest))
            shared = [p for p in shared if lines[i][p] in known]
        if shared:
            found.append((same[i], shared))
    return pd.DataFrame(found, columns=["same", "shared"])


def template_lines(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """Lines outside of a marked article that a page shares with its nearest page: ``key, shared``.

    Pages of a host with equal lines are copies and count as one, that of the smallest path; all take its result. These
    are ordered by path and id, and a page's nearest one is that of its two neighbours in this order whose path starts like
    its own for longer. Lines shared with it are the template's, whatever their share; if they are most of the page, which
    may then be a near copy, only those that a third page within REACH also has, unless there is none. Texts travel as hashes of
    lines. The order is made by a range sort over all hosts, and ranks are cut into chunks of fixed size that overlap by
    REACH pages, so a host with a third of all pages is spread like any other.
    """
    host, path = host_path(F.col(url_col))
    key = F.xxhash64(F.col(id_col), F.col(url_col), F.col(html_col))

    def hashed(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in parts:
            found = []
            for page in part.column("_html"):
                blocks = parse(page.as_py() or "")
                found.append([xxhash.xxh64_intdigest(b.text.encode("utf-8", "surrogatepass")) - (1 << 63) for b in blocks if not b.inside])
            columns = [part.column(n) for n in ("key", "id", "host", "path")]
            yield pa.RecordBatch.from_arrays([*columns, pa.array(found, pa.list_(pa.int64()))], names=["key", "id", "host", "path", "lines"])

    kind = pages.schema[id_col].dataType.simpleString()
    slim = pages.select(key.alias("key"), F.col(id_col).alias("id"), host.alias("host"), path.alias("path"), F.col(html_col).alias("_html"))
    signed = slim.mapInArrow(hashed, f"key bigint, id {kind}, host string, path string, lines array<bigint>")
    signed = durable(signed.where((F.size("lines") > 0)).withColumn("same", F.xxhash64("host", "lines")), "page-lines")
    least = F.min(F.struct("path", "id", "key")).alias("least")
    distinct = signed.groupBy("same").agg(F.any_value("host").alias("host"), F.any_value("lines").alias("lines"), least).select("same", "host", "least.*", "lines")
    ordered = distinct.repartitionByRange("host", "path", "id", "key").sortWithinPartitions("host", "path", "id", "key")
    ordered = durable(ordered.withColumn("at", F.monotonically_increasing_id()), "page-order")
    part = F.shiftrightunsigned("at", 33).alias("part")
    sizes = ordered.groupBy(part).agg(F.count("*").alias("n"))  # one row per partition of the sort
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = sizes.select("part", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("offset"))
    ranked = ordered.withColumn("part", part).join(F.broadcast(offsets), "part")
    rank = (F.col("at").bitwiseAND(F.lit((1 << 33) - 1)) + F.col("offset")).alias("rank")
    ranked = ranked.select("same", "host", "path", "lines", rank)
    home = F.floor(F.col("rank") / CHUNK).cast("bigint")
    edge = F.array(home, F.when(F.col("rank") % CHUNK < REACH, home - 1), F.when(F.col("rank") % CHUNK >= CHUNK - REACH, home + 1))
    dealt = ranked.withColumn("chunk", F.explode(F.array_compact(edge))).withColumn("own", F.col("chunk") == home)
    found = dealt.groupBy("chunk").applyInPandas(_align, "same bigint, shared array<int>")
    found = signed.select("key", "same").join(found, "same")
    return found.groupBy("key").agg(F.min("shared").alias("shared"))


def extract_text(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """Main text of every page: ``id_col, url_col, text, n_chars``.

    Blocks of a marked article (or main element) are the text. Where a page marks none, the text is every block
    that element names and marks don't tell apart, less the lines that the page shares, in order, with the page of the
    nearest url on its host that is not a copy (see ``template_lines``). Blocks are joined by one newline. Null html counts as empty and gives an empty text; a
    null url has an empty host, like any other without ``://``. Repeated rows stay, each with the same result;
    other columns are ignored; an empty table gives no rows.
    """
    key = F.xxhash64(F.col(id_col), F.col(url_col), F.col(html_col))
    shared = durable(template_lines(pages, id_col, url_col, html_col), "page-shared")
    slim = pages.select(F.col(id_col).alias("_id"), F.col(url_col).alias("_url"), F.col(html_col).alias("_html"), key.alias("key"))
    joined = slim.join(shared, "key", "left").drop("key")

    def texts(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in parts:
            found = []
            for page, drop in zip(part.column("_html"), part.column("shared"), strict=True):
                blocks = parse(page.as_py() or "")
                if any(b.inside for b in blocks):
                    found.append("\n".join(b.text for b in blocks if b.inside))
                else:
                    gone = set(drop.as_py() or ())
                    found.append("\n".join(b.text for i, b in enumerate(blocks) if i not in gone))
            yield pa.RecordBatch.from_arrays([part.column("_id"), part.column("_url"), pa.array(found, pa.string()), pa.array([len(t) for t in found], pa.int64())], names=[id_col, url_col, "text", "n_chars"])

    kind = pages.schema[id_col].dataType.simpleString()
    return joined.mapInArrow(texts, f"`{id_col}` {kind}, `{url_col}` string, text string, n_chars bigint")
