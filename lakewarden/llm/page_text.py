"""Main text of web pages by nearest-URL page differencing.

Each page becomes lines, one for each block of text, without what its markup names as no part of the article. Within a
host, pages are put in the order of their URL paths; a page's lines are aligned with those of its
neighbours by longest common subsequence, the one whose path shares the longer beginning first, and
shared lines are deleted: what two pages of a site have in common is the site's, not the page's. A line inside an
article element is only deleted if the neighbour has it outside of one: articles that quote each other keep their text.
Pages of a host with the same lines count as one, and a neighbour that leaves a page almost none of its prose is a copy of it
and says nothing about what is the site's: the other neighbour is asked then.

Neighbours come from a two-level rank over range partitions and a join on (host, rank), so a host with a third of all
pages is spread over many tasks.
"""

from __future__ import annotations

import html as entities
import re
from bisect import bisect_left
from collections.abc import Iterator
from urllib.parse import urlsplit

import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import in_small_batches, named, range_dealt, running, stored, table
from .decontamination import small

PROSE, COPY = 100, 0.8  # characters of a line of prose; share of a page's prose that only a copy has

# HTML elements and words in class, id or role that hold no article text.
RAW = {"script", "style", "noscript", "template", "svg", "iframe", "textarea", "title", "canvas", "object"}
LEFT_OUT = {"head", "nav", "footer", "aside", "form", "header", "menu", "dialog", "button", "select", "fieldset"} | RAW
WORDS_OUT = {
    "ad", "ads", "advert", "adverts", "advertisement", "banner", "sponsor", "sponsored", "promo", "cookie", "cookies", "consent", "notice", "alert", "sidebar", "menu", "nav",
    "navbar", "navigation", "breadcrumb", "breadcrumbs", "footer", "header", "masthead", "comment", "comments", "respond", "reply", "share", "social", "related", "popup",
    "modal", "newsletter", "subscribe", "signup", "login", "search", "widget", "toolbar", "complementary", "contentinfo",
}
#: With one of these a class or id still names a part of the page: related-posts, comment-list, ad-slot.
PARTS = {"area", "bar", "block", "box", "container", "form", "inner", "item", "items", "link", "links", "list", "panel", "post", "posts", "section", "slot", "thread", "unit", "widget", "wrap", "wrapper"}
BODY = {"article", "main"}
VOID = {"br", "img", "hr", "meta", "link", "input", "wbr", "source", "area", "base", "col", "embed", "param", "track"}
BLOCKS = {"address", "article", "aside", "blockquote", "body", "dd", "div", "dl", "dt", "figcaption", "figure", "footer", "form", "h1", "h2", "h3", "h4", "h5", "h6", "head", "header", "hr", "html", "li", "main", "nav", "ol", "p", "pre", "section", "table", "tbody", "td", "tfoot", "th", "thead", "title", "tr", "ul", "dialog", "fieldset", "menu"}

# a quoted value ends before white space or the tag's end; where quotes do not close like that, the tag ends at the first >
TAG = re.compile(
    r"""<!--.*?(?:-->|\Z)|<[!?][^>]*(?:>|\Z)|<(/?)([a-zA-Z][a-zA-Z0-9:-]*)(?:((?:=\s*"[^"]*"(?=[\s/>])|=\s*'[^']*'(?=[\s/>])|[^>"'=]|=(?!\s*["']))*+)(?:>|\Z)|([^>]*)(?:>|\Z))""", re.S
)
ATTRIBUTE = re.compile(r"""(?:class|id|role)\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s>]+))""", re.I)


def _left_out(tag: str, attributes: str, inside: bool) -> bool:
    """Whether an element is no part of the article. Inside an article a class or id counts as a whole: entry-header is not header."""
    if tag in LEFT_OUT and not (inside and tag == "header"):
        return True
    if tag in ("body", "html") or not attributes:
        return False
    names = [n for m in ATTRIBUTE.finditer(attributes) for n in (m[1] or m[2] or m[3] or "").lower().split()]
    if not inside and tag not in BODY:
        return any(w in WORDS_OUT for n in names for w in re.split(r"[^a-z]+", n))
    parts = [[w for w in re.split(r"[^a-z0-9]+", n) if w] for n in names]
    return any(any(w in WORDS_OUT for w in p) and all(w in WORDS_OUT or w in PARTS or w.isdigit() for w in p) for p in parts if p != ["header"])


def _tags(source: str) -> list[tuple[int, int, str, bool, str, bool]]:
    """(start, end, tag, closing, attributes, closed) of all tags, comments (without a tag) and raw elements; closed: an
    opening tag has an end tag of its own."""
    found: list[list] = []
    open_at: list[tuple[str, int]] = []
    at = 0
    while m := TAG.search(source, at):
        at, tag, attributes = m.end(), (m[2] or "").lower(), m[3] if m[3] is not None else m[4] or ""
        if tag in RAW and m[1] != "/" and not attributes.endswith("/"):
            end = re.compile(rf"</{tag}\s*>", re.I).search(source, at)
            at = end.end() if end else len(source)
            tag = "raw"
        found.append([m.start(), at, tag, m[1] == "/", attributes, False])
        if m[1] == "/":
            if any(t == tag for t, _ in open_at):
                while True:
                    t, i = open_at.pop()
                    if t == tag:
                        found[i][5] = True
                        break
        elif tag and tag != "raw" and tag not in VOID and not attributes.endswith("/"):
            open_at.append((tag, len(found) - 1))
    return [tuple(x) for x in found]


def lines_of(source: str | None) -> tuple[list[str], list[bool]]:
    """The blocks of text of a page, and whether each is inside an article element. Broken markup is
    read as far as it goes: an end tag closes what is open inside its element; an article ends what is left out around
    it and has no end tag."""
    lines: list[str] = []
    inside: list[bool] = []
    parts: list[str] = []
    stack: list[tuple[str, bool, bool]] = []  # open elements, whether they are left out, whether they have an end tag
    out = body = 0

    def flush() -> None:
        if parts:
            text = " ".join(entities.unescape("".join(parts)).split())
            parts.clear()
            if text:
                lines.append(text)
                inside.append(body > 0)

    source, at = source or "", 0
    for start, end, tag, closing, attributes, closed in _tags(source):
        if not out:
            parts.append(source[at:start])
        at = end
        if tag in BLOCKS:
            flush()
        elif tag == "br" and not out:
            parts.append(" ")
        if closing:
            if any(t == tag for t, _, _ in stack):
                while stack:
                    t, gone, _ = stack.pop()
                    out -= gone
                    body -= t in BODY
                    if t == tag:
                        break
        elif tag and tag != "raw" and tag not in VOID and not attributes.endswith("/"):
            if tag in BODY:
                while any(gone and not has_end for _, gone, has_end in stack):
                    t, gone, _ = stack.pop()
                    out -= gone
                    body -= t in BODY
            if tag in ("p", "li") and stack and stack[-1][0] == tag:
                out -= stack.pop()[1]
            gone = _left_out(tag, attributes, body > 0)
            stack.append((tag, gone, closed))
            out += gone
            body += tag in BODY
    if not out:
        parts.append(source[at:])
    flush()
    return lines, inside


def shared_lines(a: list[int], b: list[int]) -> dict[int, int]:
    """A longest common subsequence, as positions in a and b (longest increasing run of matches)."""
    i = 0
    while i < min(len(a), len(b)) and a[i] == b[i]:
        i += 1
    j = 0
    while j < min(len(a), len(b)) - i and a[-1 - j] == b[-1 - j]:
        j += 1
    found = {p: p for p in range(i)} | {len(a) - 1 - p: len(b) - 1 - p for p in range(j)}
    places: dict[int, list[int]] = {}
    for q in range(len(b) - j - 1, i - 1, -1):
        places.setdefault(b[q], []).append(q)
    ends: list[int] = []
    nodes: list[tuple[int, int, tuple | None]] = []
    for p in range(i, len(a) - j):
        for q in places.get(a[p], ()):  # from the right, so that p is used once
            k = bisect_left(ends, q)
            node = (p, q, nodes[k - 1] if k else None)
            if k == len(ends):
                ends.append(q)
                nodes.append(node)
            else:
                ends[k], nodes[k] = q, node
    node = nodes[-1] if nodes else None
    while node:
        found[node[0]] = node[1]
        node = node[2]
    return found


def page_key(url: str | None) -> tuple[str, str]:
    try:
        at = urlsplit((url or "").strip())
        return (at.netloc or "").lower(), at.path or "/"
    except ValueError:
        return "", url or ""


def _parsed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        hosts, paths, texts, inner, hashes, keys, sizes = [], [], [], [], [], [], []
        for url, source in zip(batch.column(2), batch.column(3), strict=True):
            host, path = page_key(url.as_py())
            lines, inside = lines_of(source.as_py())
            hosts.append(host)
            paths.append(path)
            texts.append(lines)
            inner.append(inside)
            hashes.append([xxhash.xxh3_64_intdigest(x.encode("utf-8", "replace")) - (1 << 63) for x in lines])
            keys.append(xxhash.xxh3_64_intdigest(repr((hashes[-1], inside)).encode()) - (1 << 63))
            sizes.append([len(x) for x in lines])
        made = [pa.array(hosts, pa.string()), pa.array(paths, pa.string()), pa.array(texts, pa.list_(pa.string())), pa.array(inner, pa.list_(pa.bool_())), pa.array(hashes, pa.list_(pa.int64())), pa.array(keys, pa.int64()), pa.array(sizes, pa.list_(pa.int32()))]
        yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), batch.column(2), *made], ["rid", "id", "url", "host", "path", "lines", "inside", "hashes", "key", "sizes"])


def _common(a: str, b: str) -> int:
    n = 0
    while n < min(len(a), len(b)) and a[n] == b[n]:
        n += 1
    return n


def shared_with_site(inside: list[bool], hashes: list[int], sizes: list[int], path: str, neighbours: list[tuple[str, list[int], list[bool]]]) -> list[int]:
    """The positions of a page's lines that are the site's. A neighbour that leaves nothing, or almost none of the page's prose
    (lines of PROSE characters), is a copy of the page and says nothing about what is the site's: the other is asked, or
    the markup alone decides."""
    prose = sum(n for n in sizes if n >= PROSE)
    for _, other, within in sorted(neighbours, key=lambda x: -_common(path, x[0])):
        shared = shared_lines(hashes, other)
        gone = [i for i in sorted(shared) if not (inside[i] and within[shared[i]])]
        if len(gone) < len(hashes) and (not prose or sum(sizes[i] for i in gone if sizes[i] >= PROSE) <= COPY * prose):
            return gone
    return []


def _differenced(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(first, gone) of the pages that share lines."""
    for batch in batches:
        firsts, gone = [], []
        for row in batch.to_pylist():
            near = [(row[f"{k}_path"] or "", row[k], row[f"{k}_in"]) for k in ("before", "after") if row[k] is not None]
            if at := shared_with_site(row["inside"], row["hashes"], row["sizes"], row["path"], near):
                firsts.append(row["first"])
                gone.append(at)
        yield pa.RecordBatch.from_arrays([pa.array(firsts, pa.int64()), pa.array(gone, pa.list_(pa.int32()))], ["first", "gone"])


@in_small_batches
def extract_text(df: DataFrame, *, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """The main text of every page: id, url, text, one row for each input row.

    Null or empty html gives the empty text. Pages with a null or broken URL count as one host without a name. A page
    alone on its host is read by its markup only; so is one whose neighbours are near copies of it. Repeated
    rows, and pages of a host with the same lines, get the same text. Whole pages, however long; an empty table gives an empty
    result; other columns are ignored.
    """
    pages = df.select(F.monotonically_increasing_id().alias("rid"), named(df, id_col).alias("id"), named(df, url_col).alias("url"), named(df, html_col).alias("html"))
    kind = pages.schema["id"].dataType.simpleString()
    schema = f"rid long, id {kind}, url string, host string, path string, lines array<string>, inside array<boolean>, hashes array<long>, key long, sizes array<int>"
    parsed = stored(pages.mapInArrow(_parsed, schema), "pages")
    # pages of a host with the same lines: the first in the order of paths stands for them
    first = stored(parsed.groupBy("host", "key").agg(F.min(F.struct("path", "rid")).alias("f"), F.count("*").alias("c")).select("host", "key", F.col("f.path").alias("path"), F.col("f.rid").alias("first"), "c"), "first-pages")
    order = ["host", "path", "first"]
    ranked = running(range_dealt(first.select(*order), order, "page-order"), order, F.lit(1), "rank", ["host"]).select(F.col("first").alias("rid"), "rank")
    # only hashes of lines meet the neighbours'; the texts stay where they are
    near = parsed.select("rid", "host", "path", "hashes", "inside", "sizes").join(ranked, "rid").withColumnRenamed("rid", "first")
    side = lambda name, step: near.select("host", (F.col("rank") + step).alias("rank"), F.col("path").alias(f"{name}_path"), F.col("hashes").alias(name), F.col("inside").alias(f"{name}_in"))
    joined = near.join(side("before", 1), ["host", "rank"], "left").join(side("after", -1), ["host", "rank"], "left")
    gone = joined.select("first", "path", "inside", "hashes", "sizes", "before_path", "before", "before_in", "after_path", "after", "after_in").mapInArrow(_differenced, "first long, gone array<int>")
    gone = stored(gone, "shared-lines")
    again = first.filter("c > 1").select("host", "key", "first")
    repeated = stored(parsed.select("rid", "host", "key").join(small(again, again.count()), ["host", "key"]).filter("rid <> first").select("rid", "first"), "repeated-pages")
    gone = stored(gone.withColumnRenamed("first", "rid").unionByName(repeated.join(gone, "first").select("rid", "gone")), "gone-lines")
    out = parsed.select("rid", "id", "url", "lines").join(small(gone, gone.count()), "rid", "left")
    kept = F.when(F.col("gone").isNull(), F.col("lines")).otherwise(F.filter("lines", lambda x, i: ~F.array_contains("gone", i)))
    return out.select("id", "url", F.array_join(kept, "\n").alias("text"))


def op3_page_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The main text of every page of `pages`."""
    out = extract_text(table(spark, sf_dir, "pages"))
    return out.select(F.col("id").alias("page_id"), "url", "text", F.char_length("text").cast("long").alias("n_chars"))
