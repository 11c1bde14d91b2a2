"""Main text of web pages: nearest-URL page differencing, then a check by markup.

Pages are paired by URL path order within their host (each page with the one before it, the first of a host with the one
after it), all lines (blocks) of the two are aligned by a longest common subsequence of line hashes, and shared lines go.
A page whose lines outside boilerplate are all shared is a copy of its neighbour; differencing cannot tell template from
text there and deletes nothing.

Markup then sorts the lines into three kinds: inside an ``article`` or ``main`` element, inside an element that is
navigation, header, footer, aside, form, script or the like by its tag, role, class or id, and other. Boilerplate that
differencing left (menus that vary from page to page) goes, shared lines of an article (passages that two texts have in
common) come back. Where a ``main`` element or, by length, articles are at least half of what is left, they alone are the text.

Only hashes and URLs are ordered (a range partition with neighbours carried over its borders, so a hot host is spread over
tasks). Page texts are not shuffled unless the table of deleted lines is too large to broadcast.

Defined results: a null or empty page has the empty text; a null or host-less URL is not paired; pages with equal URLs
are ordered by id; repeated page ids count as separate rows, but what is deleted from one of them is deleted from all;
broken markup is read as far as it goes, an unclosed boilerplate element ends where an article begins; an article that is
marked (a reader comment, a teaser) or lies in a closed boilerplate element other than a form is boilerplate. White space of
any kind becomes one blank, ``br`` too. Extra columns pass through, ``text`` and ``n_chars`` are replaced.
"""

from __future__ import annotations

import html
import re
from collections.abc import Iterator
from math import isqrt

import pyarrow as pa
import xxhash
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StringType, StructField, StructType

from tripflow.llm.memory import released
from tripflow.session import durable

ARTICLE, OTHER, BOILER, CENTRE = 0, 1, 2, 3  # CENTRE: inside a main element
FIRST, INNER, LAST = 0, 1, 2  # a row's place in its task
OFTEN = 64  # a line's places are kept as bits once there are so many; that is at most 1/OFTEN of all pairs of lines

# Element names, roles and words of class or id attributes by what they mark.
SILENT = "script style noscript template textarea title svg iframe select button canvas"
VOID = set("area base br col embed hr img input link meta param source track wbr".split())
INLINE = set("a abbr b bdi bdo cite code data del dfn em font i ins kbd label mark q s samp small span strong sub sup time tt u var img wbr br object math mi mn mo ms mtext mrow msup msub msubsup mfrac msqrt mroot mover munder munderover mstyle semantics".split())
MAIN = {"article", "main"}
BOILER_TAGS = set("nav header footer aside form menu dialog head".split())
BOILER_ROLES = set("navigation banner contentinfo complementary search form menu menubar dialog alert".split())
BOILER_WORDS = set("""ad ads advert adverts advertisement advertising banner breadcrumb breadcrumbs comment comments consent cookie cookies copyright
    disqus footer header login masthead menu modal nav navbar navigation newsletter notice notices popup promo promotion recommended related
    replies reply search share sharing sidebar signup social sponsor sponsored subscribe teaser toolbar widget widgets""".split())
ABOUT = ("has-", "no-", "with-", "without-", "tag-", "category-")  # such names tell the layout or subject, not what the element is
CLOSES = {"p": {"p"}, "li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"}}

_SILENT = "|".join(SILENT.split())
TOKEN = re.compile(rf"""<!--.*?(?:-->|\Z)|<(?:{_SILENT})\b[^>]*/>|<({_SILENT})\b[^>]*>.*?(?:</\1\s*>|\Z)|<[!?][^>]*(?:>|\Z)
    |<(/?)([a-zA-Z][\w:-]*)((?:[^>"']++|"[^"]*+"|'[^']*+')*+)>|<(/?)([a-zA-Z][\w:-]*)([^>]*)(?:>|\Z)""", re.S | re.I | re.X)
ATTRIBUTE = re.compile(r"""([^\s"'<>/=]+)(?:\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>][^\s>]*)))?|"[^"]*"|'[^']*'""")
TELLING = {"class", "id", "role", "hidden", "aria-hidden", "style"}
WORDS = re.compile(r"[a-z]+")


def _marked(attributes: str) -> bool:
    """Do the attributes of an element say that it is not main text?"""
    for m in ATTRIBUTE.finditer(attributes):  # one after the other, so a value is never read for names
        name = (m[1] or "").lower()
        if name not in TELLING:
            continue
        value = (m[2] or m[3] or m[4] or "").lower()
        if name in ("class", "id"):
            value = " ".join(v for v in value.split() if not v.startswith(ABOUT))
        if name in ("class", "id") and not BOILER_WORDS.isdisjoint([*WORDS.findall(value), *re.sub(r"[-_]", "", value).split()]):
            return True
        if name == "role" and value in BOILER_ROLES or name == "hidden" or name == "aria-hidden" and value == "true":
            return True
        if name == "style" and "display:none" in value.replace(" ", ""):
            return True
    return False


def lines(page: str | None) -> list[tuple[int, str]]:
    """The blocks of a page in order: kind and text."""
    out: list[tuple[int, str]] = []
    # element, the kind of its inside, whether it is cut out of its block, and the lines before it where it says itself that it is boilerplate
    open_: list[tuple[str, int, bool, int | None]] = []
    words: list[str] = []
    at, page = 0, page or ""

    def say(text: str) -> None:
        if not (open_ and open_[-1][2]):
            words.append(text)

    def kind() -> int:
        return open_[-1][1] if open_ else OTHER

    def end_block() -> None:
        if words:
            text = " ".join("".join(words).split())
            words.clear()
            if text:
                out.append((kind(), text))

    for m in TOKEN.finditer(page):
        if m.start() > at:
            say(html.unescape(page[at:m.start()]))
        at = m.end()
        name, closing, attributes = (m[3] or m[6] or "").lower(), m[2] or m[5], m[4] or m[7] or ""
        if name == "br":
            say(" ")
        elif closing:
            if name not in INLINE:
                end_block()
            if any(x[0] == name for x in open_):
                while (last := open_.pop())[0] != name:
                    pass
                if last[3] is not None:  # closed, so the articles in it are boilerplate too
                    out[last[3]:] = [(BOILER if k == ARTICLE else k, text) for k, text in out[last[3]:]]
        elif name in INLINE:
            if attributes and name not in VOID and _marked(attributes):
                open_.append((name, kind(), True, None))
            elif open_ and open_[-1][2] and name == open_[-1][0]:
                open_.append(open_[-1])
        elif name:
            end_block()
            if name in VOID or attributes.endswith("/"):
                continue
            if name in CLOSES and any(x[0] in CLOSES[name] for x in open_):
                while open_[-1][0] in CLOSES[name] | INLINE:
                    open_.pop()
            inside, since = kind(), None
            if name == "main" or name in MAIN and not _marked(attributes):
                inside = CENTRE if name == "main" or inside == CENTRE else ARTICLE
            elif name in BOILER_TAGS and not (name == "header" and inside in (ARTICLE, CENTRE)) or name not in ("body", "html") and _marked(attributes):
                inside = BOILER
                since = len(out) if name != "form" else None  # some pages are one form as a whole
            open_.append((name, inside, False, since))
    if at < len(page):
        say(html.unescape(page[at:]))
    end_block()
    return out


def shared(a: list[int], b: list[int]) -> list[int]:
    """Positions in ``a`` of one longest common subsequence with ``b``.

    Bit j of row i is 0 where the subsequence of a[:i] and b grows by b[j]. Only every root-th row is kept, the rows between
    two of them are made again on the way back, so memory is far below one bit per pair of lines, whatever repeats.
    """
    both = set(a) & set(b)
    mine = [i for i, x in enumerate(a) if x in both]
    places: dict[int, list[int]] = {}
    width = 0
    for x in b:
        if x in both:
            places.setdefault(x, []).append(width)
            width += 1
    whole, step = (1 << width) - 1, isqrt(len(mine)) + 1
    ready: dict[int, int] = {}

    def row_after(row: int, x: int) -> int:
        m = ready.get(x)
        if m is None:
            bits = bytearray(width // 8 + 1)
            for j in places[x]:
                bits[j >> 3] |= 1 << (j & 7)
            m = int.from_bytes(bits, "little")
            if len(places[x]) >= OFTEN:
                ready[x] = m
        u = row & m
        return ((row + u) | (row - u)) & whole

    kept, row = [whole], whole
    for k, i in enumerate(mine, 1):
        row = row_after(row, a[i])
        if k % step == 0:
            kept.append(row)
    found, j = [], width - 1
    for start in range(step * (len(mine) // step), -1, -step):
        rows = [kept[start // step]]
        for i in mine[start:start + step]:
            rows.append(row_after(rows[-1], a[i]))
        for k in range(len(rows) - 1, 0, -1):
            while j >= 0 and rows[k] >> j & 1:
                j -= 1
            if j >= 0 and rows[k - 1] >> j & 1:
                found.append(mine[start + k - 1])
                j -= 1
    return found[::-1]


def main_text(page: str | None, gone: set[int] | None = None) -> str:
    """The text of a page; ``gone`` numbers the lines outside articles that differencing deletes."""
    left = [(kind, text) for i, (kind, text) in enumerate(lines(page)) if kind != BOILER and not (kind == OTHER and gone and i in gone)]
    own, other = (sum(len(text) for kind, text in left if (kind == OTHER) == side) for side in (False, True))
    if own >= other or any(kind == CENTRE for kind, _ in left):
        left = [(kind, text) for kind, text in left if kind != OTHER]
    return "\n".join(text for _, text in left)


def _deleted(own: list[int], kinds: list[int], neighbour: list[int]) -> list[int]:
    """The lines outside articles and boilerplate that the page shares with its neighbour; none of a copy."""
    common = set(shared(own, neighbour))
    if all(i in common for i, k in enumerate(kinds) if k != BOILER):
        return []
    return [i for i, k in enumerate(kinds) if k == OTHER and i in common]


def _neighbours(rows: Iterator[tuple]) -> Iterator[tuple[tuple | None, tuple, tuple | None]]:
    """Each row with the one before and the one after it."""
    before = row = None
    for after in rows:
        if row:
            yield before, row, after
            before = row
        row = after
    if row:
        yield before, row, None


def deleted_lines(pages: DataFrame, id_col: str, url_col: str, html_col: str) -> DataFrame:
    """``id`` and ``gone`` for the pages that lose lines to their neighbour."""
    kind_of = dict(pages.dtypes)[id_col]
    url = F.coalesce(F.col(url_col), F.lit(""))
    host = F.lower(F.regexp_extract(url, r"^[a-zA-Z][a-zA-Z0-9+.-]*://([^/?#]*)", 1))
    path = F.regexp_extract(url, r"^[a-zA-Z][a-zA-Z0-9+.-]*://[^/?#]*([^?#]*)", 1)

    def hashes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            every, kinds = [], []
            for page in batch.column(3):
                found = lines(page.as_py())
                every.append([xxhash.xxh64_intdigest(t.encode("utf-8", "replace")) - (1 << 63) for _, t in found])
                kinds.append([k for k, _ in found])
            yield pa.RecordBatch.from_arrays([*batch.columns[:3], pa.array(every, pa.list_(pa.int64())), pa.array(kinds, pa.list_(pa.int32()))],
                                             names=["id", "host", "path", "lines", "kinds"])

    schema = f"id {kind_of}, host string, path string, lines array<bigint>, kinds array<int>"
    slim = pages.select(F.col(id_col).alias("id"), host.alias("host"), path.alias("path"), F.col(html_col))
    slim = durable(slim.mapInArrow(released(hashes), schema).filter("host <> ''"), "page-lines")
    order = ["host", "path", "id"]

    def differ(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Each row against the row before it; the task's first and last rows are handed on with their lines."""
        task, id_type, out = TaskContext.get().partitionId(), None, []
        names = ["task", "place", "id", "host", "gone", "lines", "kinds"]

        def rows() -> Iterator[tuple]:
            nonlocal id_type
            for batch in batches:
                id_type = batch.column(0).type
                yield from zip(*[c.to_pylist() for c in batch.columns])

        def flush() -> pa.RecordBatch:
            types = [pa.int64(), pa.int64(), id_type, pa.string(), pa.list_(pa.int32()), pa.list_(pa.int64()), pa.list_(pa.int32())]
            return pa.RecordBatch.from_arrays([pa.array([r[k] for r in out], t) for k, t in enumerate(types)], names=names)

        for before, row, after in _neighbours(rows()):
            key, at, _, own, kinds = row
            partner = next((x for x in (before, after) if x and x[1] == at), None)
            gone = _deleted(own, kinds, partner[3]) if partner and kinds else []
            if before is None:
                out.append((task, FIRST, key, at, gone, own, kinds))
            elif gone:
                out.append((task, INNER, key, at, gone, None, None))
            if after is None:
                out.append((task, LAST, key, at, None, own, kinds))
            if len(out) >= 1000:
                yield flush()
                out = []
        if out:
            yield flush()

    schema = f"task bigint, place bigint, id {kind_of}, host string, gone array<int>, lines array<bigint>, kinds array<int>"
    ranged = slim.repartitionByRange(*[F.col(c) for c in order]).sortWithinPartitions(*order)
    found = durable(ranged.mapInArrow(released(differ), schema), "page-differences")
    inner = found.filter(F.col("place") == INNER).select("id", "gone")
    # two rows per task: the row before a task's first row is the last row of the task before it
    ends = found.filter(F.col("place") != INNER)
    by_task = Window.partitionBy(F.lit(0)).orderBy("task", "place")
    ends = ends.withColumns({"host_before": F.lag("host").over(by_task), "lines_before": F.lag("lines").over(by_task)})
    ends = ends.filter((F.col("place") == FIRST) & (F.size("kinds") > 0))

    def borders(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = zip(*[c.to_pylist() for c in batch.columns])
            out = [(key, _deleted(own, kinds, theirs) if same else hint) for key, hint, own, kinds, theirs, same in rows]
            yield pa.RecordBatch.from_arrays([pa.array([r[0] for r in out], batch.column(0).type), pa.array([r[1] for r in out], pa.list_(pa.int32()))], names=["id", "gone"])

    edge = ends.select("id", "gone", "lines", "kinds", "lines_before", F.col("host").eqNullSafe(F.col("host_before")).alias("same"))
    edge = edge.mapInArrow(released(borders), f"id {kind_of}, gone array<int>").filter("size(gone) > 0")
    both = inner.unionByName(edge)
    return both.groupBy("id").agg(F.array_distinct(F.flatten(F.collect_list("gone"))).alias("gone"))


def extracted(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """``pages`` without the html, with ``text`` and ``n_chars`` (code points)."""
    gone = durable(deleted_lines(pages, id_col, url_col, html_col), "page-gone").withColumnsRenamed({"id": "__id", "gone": "__gone"})
    keep = [c for c in pages.columns if c not in ("text", "n_chars", html_col)]
    # the input's own columns go as one, so that no name of theirs can clash
    rows = pages.select(F.struct(*keep).alias("__row"), F.col(id_col).alias("__page"), F.col(html_col).alias("__html"))
    rows = rows.join(gone, F.col("__page").eqNullSafe(F.col("__id")), "left").select(*[F.col("__row")[c].alias(c) for c in keep], F.col("__html").alias("html "), F.col("__gone").alias("gone "))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n = batch.num_columns
            texts = [main_text(p.as_py(), set(g.as_py() or ())) for p, g in zip(batch.column(n - 2), batch.column(n - 1))]
            yield pa.RecordBatch.from_arrays([*batch.columns[:n - 2], pa.array(texts, pa.string()), pa.array(map(len, texts), pa.int64())],
                                             names=[*batch.schema.names[:n - 2], "text", "n_chars"])

    fields = rows.schema.fields[:len(keep)]
    return rows.mapInArrow(released(run), StructType([*fields, StructField("text", StringType()), StructField("n_chars", LongType())]))
