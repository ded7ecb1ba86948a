"""Main text of web pages: marked-up structure and nearest-URL page differencing.

A page is read once into lines: the text of a block, decoded, white space as one blank.
Each line has flags: inside an article (or main), in a block of prose, inside something
that isn't content by its element, role or class (menus, headers, footers, sidebars,
notices, adverts, forms, comments).

Pages are sorted by host and URL path. Copies tell nothing, so a page's neighbours are the
nearest pages before and after it in its host whose lines differ from its own; its partner is
the one with the longer common path (the one before, if equal). The two pages' lines are
aligned by longest common subsequence and lines in common are template: deleted, but for
prose inside an article, which near copies of an article share (deleting it would lose text
that the pages own). Where a page marks an article, lines outside it are dropped as well. On
a page that marks none, only lines in common with both neighbours, where it has two, are
template.

Pages are dealt out by ranges of the sort key, range i to task i; their number grows with
the bytes. A range's first and last pages also go to the ranges beside it, so a large host is
spread over many tasks. A page whose neighbouring range ends in copies of it finds no
partner on that side.

Rules: null and empty html has no text (""); a null url is a host of its own, sorted by
page_id. Repeated rows are copies of each other. An empty table gives no row. Other
columns are ignored. The alignment of pages of any length needs linear memory.
"""

from __future__ import annotations

import html
import re
from typing import NamedTuple

import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from waymark.llm._common import size_of

# Elements of HTML by how their text counts.
BLOCKS = frozenset("address article aside blockquote body caption center dd details dialog div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hr html li main menu nav ol p pre search section summary table tbody td tfoot th thead tr ul".split())
PROSE = frozenset("blockquote caption dd dt figcaption h1 h2 h3 h4 h5 h6 li p pre summary td th".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style noscript template textarea title iframe noembed noframes xmp".split())
NOT_CONTENT = frozenset("nav header footer aside form menu button select dialog head svg object search".split())
NOT_ROLES = frozenset("navigation banner contentinfo complementary search dialog alertdialog alert form menu menubar toolbar".split())
NOT_CLASSES = frozenset("ad ads adv advert adverts advertisement advertising banner breadcrumb breadcrumbs comment comments commentlist consent cookie cookies disqus footer gdpr header login masthead menu modal nav navbar navigation newsletter notice notices pager pagination popup promo promoted promotion related replies reply share sharing sidebar signup social sponsor sponsored subscribe subscription toolbar widget".split())

#: Bytes of pages that a range aims at, ranges at most, characters of a key that place it.
RANGE_BYTES, MOST_RANGES, CUT = 8 << 20, 50_000, 400

#: A quote opens a value only behind =, and only where another closes it.
TAG = re.compile(r"<!--.*?(?:-->|\Z)|<[!?][^>]*(?:>|\Z)|<(/?)([a-zA-Z][^\s/>]*)((?:=\s*\"[^\"]*\"|=\s*'[^']*'|[^>])*+)(?:>|\Z)", re.S)
NAME = re.compile(r"(?:^|\s)(class|id|role)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]+))", re.I)
PARTS = re.compile(r"[\s_-]+")


class Page(NamedTuple):
    lines: list[str]
    inside: list[bool]
    prose: list[bool]
    out: list[bool]
    marked: bool
    hashes: list[int]


def not_content(name: str, attributes: str) -> bool:
    if name in NOT_CONTENT:
        return True
    if "=" not in attributes:
        return False
    for what, *value in NAME.findall(attributes):
        words = PARTS.split(html.unescape("".join(value)).lower())
        if not (NOT_ROLES if what.lower() == "role" else NOT_CLASSES).isdisjoint(words) and name not in ("html", "body", "article", "main") or what.lower() != "role" and name == "article" and not {"comment", "comments", "reply"}.isdisjoint(words):
            return True
    return False


def read_page(source: str | None) -> Page:
    """Lines of a page in order, and what is known of each."""
    page = Page([], [], [], [], False, [])
    source = source or ""
    stack: list[tuple[str, bool, bool, bool]] = []  # name, excluded, inside an article, inside main
    held: list[str] = []
    marks = {"article": False, "main": False}
    areas: list[tuple[bool, bool]] = []
    at = 0

    def state() -> tuple[bool, bool, bool]:
        return stack[-1][1:] if stack else (False, False, False)

    def end_block() -> None:
        if held:
            text = "".join(held)
            text = " ".join((html.unescape(text) if "&" in text else text).split())
            held.clear()
            if text:
                out, article, main = state()
                page.lines.append(text)
                page.out.append(out)
                areas.append((article, main))
                page.prose.append(any(x[0] in PROSE for x in stack))

    while m := TAG.search(source, at):
        if m.start() > at:
            held.append(source[at : m.start()])
        at = m.end()
        if m[2] is None:
            continue
        name = m[2].lower()
        if m[1]:
            if name in BLOCKS:
                end_block()
            for i in range(len(stack) - 1, -1, -1):
                if stack[i][0] == name:
                    del stack[i:]
                    break
            continue
        if name in RAW:
            close = re.compile(rf"</{re.escape(name)}(?=[\s/>]|\Z)[^>]*(?:>|\Z)", re.I).search(source, at)
            at = close.end() if close else len(source)
            continue
        if name in BLOCKS:
            end_block()
            for i in range(len(stack) - 1, -1, -1):  # a block ends an open paragraph, an item the one before it
                if stack[i][0] == "p" or stack[i][0] == name == "li":
                    del stack[i:]
                    break
                if stack[i][0] in BLOCKS:
                    break
        elif name == "br":
            held.append(" ")
        if name in VOID:
            continue
        out, article, main = state()
        role_main = name == "main" or "main" in m[3] and any(w.lower() == "role" and "main" in v for w, *v in NAME.findall(m[3]))
        out = out or not_content(name, m[3])
        if not out:
            marks["article"] |= name == "article"
            marks["main"] |= role_main
        stack.append((name, out, article or name == "article" and not out, main or role_main and not out))
    if at < len(source):
        held.append(source[at:])
    end_block()
    which = 0 if marks["article"] else 1
    marked = marks["article"] or marks["main"]
    page.inside.extend(x[which] for x in areas)
    page.hashes.extend(xxhash.xxh64_intdigest(x.encode("utf-8", "surrogatepass")) for x in page.lines)
    return page._replace(marked=marked)


def common(a: list[int], b: list[int], most: int = 1 << 31) -> set[int]:
    """Positions in a of a longest common subsequence of a and b. Rows are bit vectors;
    where a and b are too long to keep all of them (`most` bits), a is halved."""
    found: set[int] = set()
    lo, n, m = 0, len(a), len(b)
    while lo < min(n, m) and a[lo] == b[lo]:
        found.add(lo)
        lo += 1
    while n > lo and m > lo and a[n - 1] == b[m - 1]:
        n, m = n - 1, m - 1
        found.add(n)
    x, y = a[lo:n], b[lo:m]
    if not x or not y or set(x).isdisjoint(y):
        return found
    if len(x) * len(y) > most and len(x) > 1:
        half = len(x) // 2
        ahead, behind = lengths(rows(x[:half], y)[-1], len(y)), lengths(rows(x[half:][::-1], y[::-1])[-1], len(y))
        cut = max(range(len(y) + 1), key=lambda k: ahead[k] + behind[len(y) - k])
        return found | {lo + i for i in common(x[:half], y[:cut], most)} | {lo + half + i for i in common(x[half:], y[cut:], most)}
    every = rows(x, y, True)
    i, j = len(x), len(y)
    while i and j:
        if x[i - 1] == y[j - 1]:
            i, j = i - 1, j - 1
            found.add(lo + i)
        elif every[i] >> (j - 1) & 1:
            j -= 1
        else:
            i -= 1
    return found


def rows(a: list[int], b: list[int], every: bool = False) -> list[int]:
    """Bit vectors of the LCS table's rows (the last, or every): bit j is 0 where b's
    first j + 1 have a longer common subsequence than its first j."""
    places: dict[int, int] = {}
    for j, x in enumerate(b):
        places[x] = places.get(x, 0) | 1 << j
    full = (1 << len(b)) - 1
    row, out = full, [full]
    for x in a:
        here = row & places.get(x, 0)
        row = (row + here | row - here) & full
        if every:
            out.append(row)
    return out if every else [row]


def lengths(row: int, m: int) -> list[int]:
    out = [0]
    for c in reversed(bin(row)[2:].rjust(m, "0")) if m else "":
        out.append(out[-1] + (c == "0"))
    return out


def shown(page: Page, partner: Page | None, further: Page | None = None) -> str:
    """Main text of a page, given the page nearest to it and, if unmarked, the other one."""
    shared = common(page.hashes, partner.hashes) if partner else set()
    if further:
        shared &= common(page.hashes, further.hashes)
    own = [x for i, x in enumerate(page.lines) if not page.out[i] and (page.inside[i] or not page.marked) and (i not in shared or page.inside[i] and page.prose[i])]
    return "\n".join(own)


def place(key: Column, lows: list[str]) -> Column:
    """Number of the range that a key lies in: the last whose low isn't above it."""
    table, half = F.lit(lows), lambda s: F.floor((s["lo"] + s["hi"]) / 2).cast("int")
    step = lambda s, _: F.when(F.get(table, half(s)) <= key, F.struct(half(s).alias("lo"), s["hi"].alias("hi"))).otherwise(F.struct(s["lo"].alias("lo"), half(s).alias("hi")))
    start = F.struct(F.lit(0).alias("lo"), F.lit(len(lows)).alias("hi"))
    return F.aggregate(F.array_repeat(F.lit(0), len(lows).bit_length()), start, step)["lo"]


def shared_start(a: str, b: str) -> int:
    n = min(len(a), len(b))
    return next((i for i in range(n) if a[i] != b[i]), n)


def ranges_of(rows: DataFrame) -> list[tuple[str, int, int]]:
    """Ranges of the sort key, ascending: the low end (at most CUT characters), and hashes of
    the first and last key in it. Their number grows with the bytes of the pages, MOST_RANGES
    at most; that is all the driver gets."""
    size = size_of(rows)
    if not size:
        size = (rows.agg(F.sum(F.octet_length("html"))).first()[0] or 0) // 4
    parts = min(MOST_RANGES, max(int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-size // RANGE_BYTES)))
    keys = rows.select("key", F.substring("key", 1, CUT).alias("cut")).repartitionByRange(parts, "cut")
    ends = keys.groupBy(F.spark_partition_id().alias("p")).agg(F.min("cut").alias("low"), F.min("key").alias("first"), F.max("key").alias("last"))
    return sorted(tuple(r) for r in ends.select("low", F.xxhash64("first"), F.xxhash64("last")).collect())


def dealt(rows: DataFrame, ranges: list[tuple[str, int, int]]) -> DataFrame:
    """rows, range i in partition i in the order of the key; the first and last page of a
    range also go, not as `mine`, to the range beside it."""
    lows, firsts, lasts = (list(x) for x in zip(*ranges, strict=True))
    own, mark = F.col("own"), F.xxhash64("key")
    beside = F.array(F.when(F.get(F.lit(firsts), own) == mark, own - 1), F.when(F.get(F.lit(lasts), own) == mark, own + 1))
    inside = lambda x: x.isNotNull() & (x >= 0) & (x < len(lows))
    placed = rows.withColumn("own", place(F.substring("key", 1, CUT), lows))
    spread = placed.withColumn("part", F.explode(F.array_union(F.array("own"), F.filter(beside, inside))))
    spread = spread.select("part", "key", "page_id", "url", "host", "path", (F.col("own") == F.col("part")).alias("mine"), "html")
    return spread.repartitionById(len(lows), F.col("part")).sortWithinPartitions("part", "key")


class Seen:
    """Rows in the order of the key, each with the nearest rows before and after it, in its
    host, whose lines differ from its own. A run of copies is held as ids without html."""

    def __init__(self):
        self.before, self.run = None, []  # the last row that differs from the run, the run

    def text_of(self, row: dict, after: dict | None) -> tuple:
        near = [x for x in (self.before, after) if x and x["host"] == row["host"]]
        partner = max(near, key=lambda x: shared_start(x["path"], row["path"]), default=None)
        further = next((x["page"] for x in near if x is not partner and not row["page"].marked), None)
        text = shown(row["page"], partner and partner["page"], further)
        return row["page_id"], row["url"], text, len(text)

    def close(self, after: dict | None = None) -> list[tuple]:
        """Texts of the run's own pages, now that the page after it is known."""
        out = [self.text_of(x, after) for x in self.run if x["mine"]]
        self.before, self.run = (self.run[-1] if self.run else None), []
        return out

    def add(self, row: dict) -> list[tuple]:
        last = self.run[-1] if self.run else None
        if last and last["host"] == row["host"] and last["page"].hashes == row["page"].hashes:
            row["page"] = last["page"]
            self.run.append(row)
            return []
        out = self.close(row)
        self.run = [row]
        return out


def extract(pages: DataFrame) -> DataFrame:
    """Per row of pages: page_id, url, text, n_chars."""
    url = F.coalesce(F.col("url"), F.lit(""))
    host = F.lower(F.regexp_extract(url, r"^(?:[a-zA-Z][a-zA-Z0-9+.-]*:)?//([^/?#]*)", 1))
    path = F.regexp_replace(F.regexp_extract(url, r"^(?:(?:[a-zA-Z][a-zA-Z0-9+.-]*:)?//[^/?#]*)?([^?#]*)", 1), r"/+$", "")
    order = F.lpad(F.coalesce(F.col("page_id").cast("string"), F.lit("")), 20, "0")
    key = F.concat_ws("\u0001", host, path, order).alias("key")
    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url"), host.alias("host"), path.alias("path"), key, F.col("html"))
    ranges = ranges_of(rows)
    if not ranges:
        return pages.select(F.col("page_id").cast("long").alias("page_id"), "url", F.lit("").alias("text"), F.lit(0).cast("long").alias("n_chars"))

    def batch(out):
        kinds = (pa.int64(), pa.string(), pa.string(), pa.int64())
        columns = list(zip(*out, strict=True)) or [()] * 4
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, kinds, strict=True)], names=["page_id", "url", "text", "n_chars"])

    def run(batches):
        seen = Seen()
        for b in batches:
            out, names = [], [x for x in b.schema.names if x != "html"]
            for i, row in enumerate(b.select(names).to_pylist()):
                row["page"] = read_page(b.column("html")[i].as_py())
                out += seen.add(row)
            yield batch(out)
        yield batch(seen.close())

    return dealt(rows, ranges).mapInArrow(run, "page_id long, url string, text string, n_chars long")
