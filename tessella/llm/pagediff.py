"""Main text of web pages by comparing each page with the one whose URL is nearest.

1. Every page is cut into lines, one per block element, with the part of the page that it stands in.
2. Within a host, pages with different lines are sorted by URL path; a page's nearest one, by the length of the common
   path, is its neighbour in that order. Sorting is by ranges over all hosts, so a host may hold any share of the pages;
   what lies across a range's border comes from one row per range.
3. The lines of both are aligned by a longest common subsequence, and shared lines are deleted.

Differencing alone can't tell a site's frame from its text: navigation that differs from page to page stays, and what
two articles share goes, as does all of an article that stands on two pages. So a declared article (`article`, else
`main`, and their roles) is what may stay if there is one, its lines are kept even where they are shared, and menus, headers,
footers, sidebars, notices, adverts, forms and comments go by their elements, roles and class names, shared or not.
Where a page declares no article, deletion of shared lines decides over all the rest.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator
from html import unescape
from urllib.parse import urlsplit

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tessella.llm.common import Scratch, prepare, table

#: Where a line stands: left out whatever is shared, undecided, in the main part, in an article.
OUT, OPEN, MAIN, ARTICLE = -1, 0, 1, 2

# ---- fixed values: elements, roles and words of class names and ids --------------------------
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea title xmp".split())
BLOCK = frozenset(
    "address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure footer form "
    "h1 h2 h3 h4 h5 h6 head header hgroup hr html legend li main menu nav ol option p pre search section summary table tbody td "
    "tfoot th thead title tr ul".split()
)
#: Elements that end an open element of the same group among their siblings.
SIBLINGS = {"li": ("li",), "dt": ("dt", "dd"), "dd": ("dt", "dd"), "tr": ("tr", "td", "th"), "td": ("td", "th"), "th": ("td", "th"), "option": ("option",)}
SCOPES = frozenset("article aside blockquote body div dl fieldset footer form header html main nav ol section table td th ul".split())
LEFT_OUT = frozenset(
    "aside audio button canvas datalist dialog fieldset footer form head iframe input label menu nav noscript object "
    "script search select style svg template textarea title video".split()
)
ROLES_OUT = frozenset("alert alertdialog banner complementary contentinfo dialog form menu menubar navigation search status toolbar".split())
WORDS_OUT = frozenset(
    "ad ads adsense advert advertisement advertising adverts banner breadcrumb breadcrumbs comment comments consent cookie cookies disqus "
    "footer gdpr masthead menu modal nav navbar navigation newsletter notice notices pagination popup promo promoted promotion related replies "
    "respond share sharing sidebar social sponsor sponsored subscribe subscription toolbar widget widgets".split()
)
#: Of these, what an article inside doesn't escape.
COMMENTS = frozenset("comment comments disqus replies respond".split())
# ---------------------------------------------------------------------------------------------

TAG = re.compile(
    r"<!--.*?(?:-->|\Z)|<(/?)([A-Za-z][^\s/>]*+)([^>\"']*+(?:\"[^\"]*+\"[^>\"']*+|'[^']*+'[^>\"']*+)*+)>|<(/?)([A-Za-z][^\s/>]*+)([^>]*+)>|<[!?/][^>]*+>?", re.S
)
ATTRIBUTE = re.compile(r"\b(class|id|role)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]+))", re.I)


def _place(name: str, attributes: str, now: int, commented: bool) -> tuple[int, bool]:
    """Where what an element holds stands, from the place that it stands in itself."""
    if name in LEFT_OUT and now != OUT:
        return OUT, True  # nothing inside comes back
    words, roles = set(), set()
    if "=" in attributes:
        for key, *values in ATTRIBUTE.findall(attributes):
            value = "".join(values).lower()
            (roles if key.lower() == "role" else words).update(re.split(r"\s+" if key.lower() == "role" else r"[^a-z0-9]+", value))
    if roles & ROLES_OUT:
        return OUT, True
    if name in ("html", "body"):
        return now, commented
    if name in ("article", "main") or roles & {"article", "main"}:
        if commented or words & COMMENTS:
            return OUT, True
        return (ARTICLE if name == "article" or "article" in roles else max(now, MAIN)), False
    if words & WORDS_OUT:
        return OUT, commented or bool(words & COMMENTS)
    if name == "header" and now == OPEN:
        return OUT, commented
    return now, commented


def page_lines(html: str) -> Iterator[tuple[str, int]]:
    """(text, place) of a page's lines with text: a line per block, references decoded, white space as one blank."""
    stack: list[tuple[str, int, bool]] = [("", OPEN, False)]
    held: list[tuple[str, int]] = []
    at = 0

    def line():
        """What a block has gathered; what an inline element of it leaves out is a line of its own."""
        place = max((p for _, p in held), default=OUT)
        for some, kept in ((place, True), (OUT, False)):
            text = " ".join(unescape("".join(t for t, p in held if (p != OUT or place == OUT) == kept)).split())
            if text:
                yield text, some
        held.clear()

    def closed(names, inside: frozenset) -> None:
        """Pop the nearest open element of these names, unless one of `inside` is nearer."""
        for i in range(len(stack) - 1, 0, -1):
            if stack[i][0] in names:
                del stack[i:]
                return
            if stack[i][0] in inside:
                return

    while m := TAG.search(html, at):
        held.append((html[at : m.start()], stack[-1][1]))
        at, name = m.end(), (m[2] or m[5] or "").lower()
        if not name:
            continue
        if name in BLOCK:
            yield from line()
        elif name == "br":
            held.append((" ", stack[-1][1]))
        if m[1] or m[4]:
            if name not in VOID:
                closed((name,), frozenset() if name in SCOPES or name == "head" else SCOPES)
            continue
        attributes = m[3] if m[2] else m[6]
        if name in RAW:
            end = re.compile(rf"</{name}\b[^>]*>?", re.I).search(html, at)
            at = end.end() if end else len(html)
        elif name not in VOID and not attributes.endswith("/"):
            if name == "body":
                closed(("head",), frozenset())
            if name in BLOCK:
                closed(("p",), SCOPES)
            if name in SIBLINGS:
                closed(SIBLINGS[name], SCOPES - {"td", "th"} if name == "tr" else SCOPES - set(SIBLINGS[name]))
            stack.append((name, *_place(name, attributes, *stack[-1][1:])))
    held.append((html[at:], stack[-1][1]))
    yield from line()


# ---- longest common subsequence ---------------------------------------------------------------

#: Bytes of bit rows that an alignment holds; longer ones are halved first.
ROW_BYTES = 16_000_000


def _rows(a: list, b: list) -> Iterator[int]:
    """After each element of a: a number whose bit j is 0 where b's first j + 1 elements share one more with a than its first j."""
    where: dict = {}
    for j, x in enumerate(b):
        where[x] = where.get(x, 0) | 1 << j
    full = (1 << len(b)) - 1
    v = full
    for x in a:
        u = v & where.get(x, 0)
        v = ((v + u) | (v - u)) & full
        yield v


def _lengths(a: list, b: list) -> np.ndarray:
    """Length of the longest common subsequence of a with every prefix of b."""
    v = (1 << len(b)) - 1
    for v in _rows(a, b):  # noqa: B007  the last
        pass
    bits = np.unpackbits(np.frombuffer(v.to_bytes(len(b) // 8 + 1, "little"), np.uint8), bitorder="little")[: len(b)]
    return np.concatenate([[0], np.cumsum(1 - bits.astype(np.int64))])


def aligned(a: list, b: list) -> list[int]:
    """Places in a of one longest common subsequence of a and b, ascending."""
    both = set(a) & set(b)
    places, a, b = [i for i, x in enumerate(a) if x in both], [x for x in a if x in both], [x for x in b if x in both]
    return [places[i] for i in _aligned(a, b)]


def _aligned(a: list, b: list) -> list[int]:
    head = 0
    while head < min(len(a), len(b)) and a[head] == b[head]:
        head += 1
    foot = 0
    while foot < min(len(a), len(b)) - head and a[-1 - foot] == b[-1 - foot]:
        foot += 1
    middle_a, middle_b = a[head : len(a) - foot], b[head : len(b) - foot]
    return [*range(head), *(head + i for i in _middle(middle_a, middle_b)), *range(len(a) - foot, len(a))]


def _middle(a: list, b: list) -> list[int]:
    if not a or not b:
        return []
    if len(a) > 1 and len(a) * len(b) > 8 * ROW_BYTES:
        half = len(a) // 2
        cut = int(np.argmax(_lengths(a[:half], b) + _lengths(a[half:][::-1], b[::-1])[::-1]))
        return _aligned(a[:half], b[:cut]) + [half + i for i in _aligned(a[half:], b[cut:])]
    rows = [v.to_bytes(len(b) // 8 + 1, "little") for v in _rows(a, b)]
    more = lambda i, j: not rows[i][j >> 3] >> (j & 7) & 1
    out, i, j = [], len(a), len(b)
    while i and j:
        if not more(i - 1, j - 1):
            j -= 1
            continue
        i -= 1
        if not (i and more(i - 1, j - 1)):
            out.append(i)
            j -= 1
    return out[::-1]


# ---- pairs of pages ---------------------------------------------------------------------------

SIGNS = "host string, path string, digest binary, signs array<long>"


def address(url: str | None) -> tuple[str, str]:
    """Host and path, its parts separated by a sign that sorts before all others."""
    try:
        u = urlsplit(url or "")
        return u.netloc.rpartition("@")[2].lower(), u.path.replace("/", "\x01")
    except ValueError:  # no URL at all
        return "", url or ""


def sign(text: str) -> int:
    return int.from_bytes(hashlib.blake2b(text.encode("utf-8", "surrogatepass"), digest_size=8).digest(), "little", signed=True)


def _digest(host: str, signs: list[int]) -> bytes:
    return hashlib.blake2b(host.encode("utf-8", "surrogatepass") + b"\0" + np.array(signs, "<i8").tobytes(), digest_size=16).digest()


def _pages(batches) -> Iterator[tuple]:
    """(page_id, url, host, path, lines, places, signs) of every page."""
    for b in batches:
        for page_id, url, html in zip(*(b.column(i).to_pylist() for i in range(3)), strict=True):
            lines = list(page_lines(html or ""))
            yield page_id, url, *address(url), [t for t, _ in lines], [p for _, p in lines], [sign(t) for t, _ in lines]


def _packed(lines: list[str]) -> bytes:
    """A page's lines, compressed, as all of them are shuffled once."""
    data = "\n".join(lines).encode("utf-8", "surrogatepass")
    return len(data).to_bytes(8, "little") + pa.compress(data, codec="zstd", asbytes=True)


def _unpacked(data: bytes) -> list[str]:
    text = pa.decompress(data[8:], int.from_bytes(data[:8], "little"), codec="zstd", asbytes=True).decode("utf-8", "surrogatepass")
    return text.split("\n") if text else []


def _sent(rows: Iterator[tuple], schema: pa.Schema, size: int = 4_000_000) -> Iterator[pa.RecordBatch]:
    """Rows as Arrow batches of 500 rows or about `size` characters or items of their last columns."""
    held, n = [], 0
    for row in rows:
        held.append(row)
        n += sum(map(len, row[-1])) if isinstance(row[-1], list) and row[-1] and isinstance(row[-1][0], str) else len(row[-1])
        if len(held) == 500 or n > size:
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*held, strict=True), schema, strict=True)], schema=schema)
            held, n = [], 0
    if held:
        yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*held, strict=True), schema, strict=True)], schema=schema)


def signed(pages: DataFrame) -> DataFrame:
    """Host, path, digest and signs of pages with different lines; of pages of a host with the same lines, the first path stands."""
    schema = pa.schema([("host", pa.string()), ("path", pa.string()), ("digest", pa.binary()), ("signs", pa.list_(pa.int64()))])

    def read(batches):
        yield from _sent(((host, path, _digest(host, signs), signs) for _, _, host, path, _, _, signs in _pages(batches)), schema)

    each = pages.mapInArrow(read, SIGNS)
    first = each.groupBy("digest").agg(F.min(F.struct("host", "path", "signs")).alias("page"))
    return first.select("page.host", "page.path", "digest", "page.signs")


def neighbours(distinct: DataFrame, scratch: Scratch) -> DataFrame:
    """distinct (as SIGNS) with `before` and `after`: structs (path, signs) of the pages next to it in its host's order, or null."""
    ranged = distinct.repartitionByRange("host", "path", "digest").sortWithinPartitions("host", "path", "digest")
    rows = scratch.write(ranged.withColumn("part", F.spark_partition_id()), "ranges")
    page = F.struct("host", "path", "digest", "signs")
    ends = rows.groupBy("part").agg(F.min(page).alias("first"), F.max(page).alias("last"))
    by_part = Window.orderBy("part")  # a row per range
    ends = ends.select("part", F.lag("last").over(by_part).alias("_before"), F.lead("first").over(by_part).alias("_after"))
    w = Window.partitionBy("part").orderBy("host", "path", "digest")
    near = rows.withColumns({"_lag": F.lag(page).over(w), "_lead": F.lead(page).over(w)}).join(ends, "part")

    def same_host(c):
        return F.when(c["host"] == F.col("host"), F.struct(c["path"].alias("path"), c["signs"].alias("signs")))

    return near.select(
        "path", "digest", "signs",
        same_host(F.coalesce("_lag", "_before")).alias("before"), same_host(F.coalesce("_lead", "_after")).alias("after"),
    )


def _common(a: str, b: str) -> int:
    n = min(len(a), len(b))
    return next((i for i in range(n) if a[i] != b[i]), n)


def nearest(path: str, before: dict | None, after: dict | None) -> dict | None:
    """Of two neighbours the one whose path starts alike for longer, at a tie the one before."""
    if not before or not after:
        return before or after
    return before if _common(path, before["path"]) >= _common(path, after["path"]) else after


def shared_lines(pages: DataFrame, scratch: Scratch) -> DataFrame:
    """digest, shared: the numbers (from 0) of the lines that a page shares with its nearest one in their order."""
    schema = pa.schema([("digest", pa.binary()), ("shared", pa.list_(pa.int32()))])

    def compare(batches):
        def rows():
            for b in batches:
                for r in b.to_pylist():
                    other = nearest(r["path"], r["before"], r["after"])
                    yield r["digest"], aligned(r["signs"], other["signs"]) if other else []

        yield from _sent(rows(), schema)

    return neighbours(signed(pages), scratch).mapInArrow(compare, "digest binary, shared array<int>")


def main_lines(lines: list[str], places: list[int], shared: list[int]) -> list[str]:
    """What of a page is kept: the best place's lines, without shared ones unless it is an article."""
    best, gone = max(places, default=OUT), set(shared)
    if best == OUT:
        return []
    return [t for i, (t, p) in enumerate(zip(lines, places, strict=True)) if p == best and (best == ARTICLE or i not in gone)]


def extract(pages: DataFrame, scratch: Scratch) -> DataFrame:
    """page_id, url, lines (kept), n_lines, n_shared, from pages (page_id, url, html).

    Null html has no lines; a null or malformed url is a host of its own kind, all of these together. Repeated rows give
    a row each, alike. A page without another of its host that differs shares nothing. An empty table gives no rows; other columns
    are ignored.
    """
    prepare(pages.sparkSession)
    pages = pages.select("page_id", "url", "html")
    whole = pa.schema([("page_id", pa.int64()), ("url", pa.string()), ("digest", pa.binary()), ("places", pa.binary()), ("lines", pa.binary())])
    kept = pa.schema([("page_id", pa.int64()), ("url", pa.string()), ("n_lines", pa.int64()), ("n_shared", pa.int64()), ("lines", pa.list_(pa.string()))])

    def read(batches):
        yield from _sent(((i, url, _digest(host, signs), np.array(places, np.int8).tobytes(), _packed(lines)) for i, url, host, _, lines, places, signs in _pages(batches)), whole)

    def choose(batches):
        def rows():
            for b in batches:
                for r in b.to_pylist():
                    shared, places = r["shared"] or [], np.frombuffer(r["places"], np.int8).tolist()
                    yield r["page_id"], r["url"], len(places), len(shared), main_lines(_unpacked(r["lines"]), places, shared)

        yield from _sent(rows(), kept)

    each = pages.mapInArrow(read, "page_id long, url string, digest binary, places binary, lines binary")
    joined = each.join(shared_lines(pages, scratch), "digest", "left").select("page_id", "url", "places", "lines", "shared")
    return joined.mapInArrow(choose, "page_id long, url string, n_lines long, n_shared long, lines array<string>")


def op12_html(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The main text of every page. What is left in the shared folder are the signs of lines; texts aren't written twice."""
    got = extract(table(spark, sf_dir, "pages"), Scratch(spark, "pages")).withColumn("text", F.array_join("lines", "\n"))
    return got.select("page_id", "url", "text", F.char_length("text").cast("long").alias("n_chars"), "n_lines", "n_shared")
