"""Main text of web pages, by nearest-URL page differencing with structure as arbiter.

A page falls into its visible lines (blocks), once, into a stored table.  Pages are
ordered by host and URL path.  Each is paired with the nearest page of its host whose
content isn't a copy of its own: the one before or the one after it, whichever shares
the longer beginning of the path.  The lines of the two, menus and notices included, are
aligned by their longest common subsequence, and shared lines are deleted.

Structure decides where differencing can't: an unshared line goes if it lies in a menu,
header, footer, sidebar, notice, advert, form or reader comment, told by tag, role, class
or id, or beside the page's article; a shared line of an ``article`` or ``main`` element
comes back if it is a whole paragraph, if it stands alone between unshared ones or if half
of the article is shared (a copied article), so runs of short shared lines within an
article, as menus are, stay deleted.  Pages without an article are left to differencing
and those elements.

Only digests and paths are shuffled in URL order, so a host with a third of all pages is
spread over many tasks; what stands next to a task's first and last pages is handed on
through one small row for each end of a task.

Defined results: a null html gives an empty text; null and malformed URLs are one host
without a name; a page whose host holds nothing but copies of it has no partner, so no
line of it is shared; rows with equal ids and contents get equal results; an unclosed
element ends with the page; an empty table gives no rows; further columns are ignored.
"""

from __future__ import annotations

import hashlib
import html
import re
from collections.abc import Iterator
from math import isqrt
from urllib.parse import urlsplit

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from foliate.llm import common

#: Elements that are left out, that aren't seen, that hold raw text, and that part lines.
LEFT_OUT = frozenset("head nav footer aside form button select option input textarea iframe svg canvas object noscript template dialog menu script style title".split())
UNSEEN = frozenset("head select option input textarea iframe svg canvas object noscript template script style title".split())
RAW = frozenset("script style textarea title iframe noscript template".split())
INLINE = frozenset("a abbr acronym b bdi bdo big cite code data del dfn em font i ins kbd label mark q rb rp rt ruby s samp small span strike strong sub sup time tt u var wbr".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
ROLES = frozenset("navigation banner contentinfo complementary search form dialog alertdialog alert menu menubar".split())
_PARTS = re.compile(r"(?:^|[\s_-])(?:ads?|advert\w*|adsense|sponsor\w*|promo\w*|banner|sidebar|side-?bar|cookies?|consent|gdpr|notice|notices|notification|popup|modal|overlay|newsletter|subscribe|signup|share|sharing|social|related|recommend\w*|comments?|comment-?list|disqus|respond|replies|menu|nav|navbar|navigation|breadcrumbs?|footer|masthead|widget|pagination|skip-?link)(?=$|[\s_-])", re.I)
_MARKUP = re.compile(r"<!--.*?(?:-->|\Z)|<[!?][^>]*(?:>|\Z)|<(/?)([a-zA-Z][^\s/>]*)((?:[^>\"']|\"[^\"]*\"|'[^']*')*)(?:>|\Z)", re.S)
_ATTRIBUTE = re.compile(r"([^\s=\"'/]+)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+))|([^\s=\"'/]+)")
_SPACE = re.compile(r"\s+")
BROADCAST_BYTES = 16 << 20
#: Where a line stands: beside everything named, in an article, or in an element that is left out.
BESIDE, ARTICLE, ASIDE = 0, 1, 2


def _unwanted(tag: str, attributes: str, in_article: bool) -> str:
    """Whether an element is left out, and whether it isn't even seen."""
    if tag in LEFT_OUT or tag == "header" and not in_article:
        return "unseen" if tag in UNSEEN else "aside"
    if not attributes.strip() or tag in ("article", "main", "body", "html"):
        return ""
    own = {(m[1] or m[5]).lower(): html.unescape(m[2] or m[3] or m[4] or "") for m in _ATTRIBUTE.finditer(attributes)}
    if "hidden" in own or own.get("aria-hidden", "").lower() == "true" or re.search(r"display\s*:\s*none|visibility\s*:\s*hidden", own.get("style", ""), re.I):
        return "unseen"
    return "aside" if own.get("role", "").lower() in ROLES or _PARTS.search(own.get("class", "")) or _PARTS.search(own.get("id", "")) else ""


def visible(page: str | None) -> tuple[list[str], list[int]]:
    """A page's lines and where each stands."""
    out: list[str] = []
    kinds: list[int] = []
    held: list[str] = []
    article = 0
    skipped, depth, seen = "", 0, True
    page, at = page or "", 0

    def close() -> None:
        text = _SPACE.sub(" ", "".join(held)).strip()
        held.clear()
        if text:
            out.append(text)
            kinds.append(ASIDE if skipped else ARTICLE if article else BESIDE)

    while True:
        m = _MARKUP.search(page, at)
        if seen:
            held.append(html.unescape(page[at : m.start() if m else len(page)]))
        if not m:
            break
        at, tag = m.end(), (m[2] or "").lower()
        if not tag:
            continue
        alone = tag in VOID or m[3].rstrip().endswith("/")
        if not m[1] and tag in RAW and (skipped or _unwanted(tag, m[3], article > 0)) and not alone:
            if tag not in INLINE and seen:
                close()
            end = re.compile(rf"</{re.escape(tag)}\s*>", re.I).search(page, at)
            at = end.end() if end else len(page)
            continue
        if skipped:
            if tag not in INLINE and seen:
                close()
            if tag == skipped and tag not in VOID:
                depth += -1 if m[1] else not alone
                if depth == 0:
                    if tag in INLINE and seen:
                        close()
                    skipped, seen = "", True
            continue
        if tag not in INLINE:
            close()
        container = tag in ("article", "main")
        if m[1]:
            if container and article:
                article -= 1
            continue
        if how := _unwanted(tag, m[3], article > 0):
            if not alone:
                # An inline element that isn't seen parts no line.
                if how == "aside" or tag not in INLINE:
                    close()
                skipped, depth, seen = tag, 1, how != "unseen"
        elif container:
            article += 1
    close()
    return out, kinds


def lines(page: str | None) -> tuple[list[str], list[bool], bool]:
    """The lines that structure doesn't leave out, whether each lies in an article, and whether one does."""
    text, kinds = visible(page)
    inside = [k == ARTICLE for k in kinds if k != ASIDE]
    return [t for t, k in zip(text, kinds, strict=True) if k != ASIDE], inside, any(inside)


def line_hash(text: str) -> int:
    import xxhash

    return xxhash.xxh3_64_intdigest(text.encode())


def shared(a: list[int], b: list[int]) -> list[bool]:
    """Which of ``a`` a longest common subsequence with ``b`` holds.

    Bit-parallel: a row of bits for each of ``b``.  One row in ``isqrt(len(b))`` is kept,
    and those between are made again on the way back.
    """
    out = [False] * len(a)
    low = 0
    while low < min(len(a), len(b)) and a[low] == b[low]:
        out[low] = True
        low += 1
    high = 0
    while high < min(len(a), len(b)) - low and a[-1 - high] == b[-1 - high]:
        out[-1 - high] = True
        high += 1
    a, b = a[low : len(a) - high], b[low : len(b) - high]
    places: dict[int, list[int]] = {}
    for i, x in enumerate(a):
        places.setdefault(x, []).append(i)
    b = [x for x in b if x in places]
    if not a or not b:
        return out
    full = (1 << len(a)) - 1
    masks: dict[int, int] = {}

    def mask(x: int) -> int:
        own = places[x]
        if len(own) < 64:
            return sum(1 << i for i in own)
        if x not in masks:  # a line in 64 at most has one
            raw = bytearray(len(a) // 8 + 1)
            for i in own:
                raw[i >> 3] |= 1 << (i & 7)
            masks[x] = int.from_bytes(raw, "little")
        return masks[x]

    def after(v: int, x: int) -> int:
        u = v & mask(x)
        return ((v + u) | (v - u)) & full

    step = max(1, isqrt(len(b)))
    marks, v = [], full
    for j, x in enumerate(b):
        if j % step == 0:
            marks.append(v)
        v = after(v, x)
    # A zero bit in a row is a place at which the subsequence grows; walk back from the end.
    i, j, block, rows = len(a) - 1, len(b) - 1, -1, []
    while i >= 0 and j >= 0:
        if j // step != block:
            block = j // step
            rows = [marks[block]]
            for x in b[block * step : (block + 1) * step]:
                rows.append(after(rows[-1], x))
        k = j - block * step  # rows[k] stands before the j-th of b, rows[k + 1] after it
        if rows[k + 1] >> i & 1:
            i -= 1
        elif j and not rows[k] >> i & 1:
            j -= 1
        else:
            out[low + i] = True
            i, j = i - 1, j - 1
    return out


#: Words of a line that a menu or notice within an article has at most; longer shared lines, and sentences, are repeated paragraphs.
SHORT = 5


def terse(line: str) -> bool:
    return line.count(" ") < SHORT and not line.endswith((".", "!", "?", "…", "。"))


def decide(kinds: list[int], same: list[bool], brief: list[bool]) -> list[bool]:
    """Which lines are main text.

    Differencing comes first: shared lines go. Of an article's, those come back that aren't ``brief`` (see ``terse``: a
    repeated paragraph), that stand alone between unshared ones (a chance repeat), or all if half or more of the article is
    shared (a copied article, not a template); what is left are runs of short shared lines, as menus and notices within
    articles are. Unshared lines go by structure.
    """
    article = [k == ARTICLE for k in kinds]
    own = [i for i, k in enumerate(article) if k]
    if not own:
        return [k == BESIDE and not s for k, s in zip(kinds, same, strict=True)]
    if 2 * sum(same[i] for i in own) >= len(own):
        return article
    short = [same[i] and brief[i] for i in own]
    kept = list(article)
    for at, i in enumerate(own):
        kept[i] = not (short[at] and (at > 0 and short[at - 1] or at + 1 < len(own) and short[at + 1]))
    return kept


def _place(url: str | None) -> tuple[str, str]:
    try:
        parts = urlsplit(url or "")
        return (parts.hostname or "").lower(), parts.path
    except ValueError:
        return "", url or ""


def _parsed(pages: DataFrame) -> DataFrame:
    """Each page's place, lines, where they stand, their hashes, and a digest of its content that copies share."""

    def make():
        def each(batch: pa.RecordBatch) -> pa.RecordBatch:
            places = [_place(u) for u in batch.column(2).to_pylist()]
            texts, kinds, hashes, copies = [], [], [], []
            for page in batch.column(3).to_pylist():
                text, kind = visible(page)
                own = [line_hash(t) for t in text]
                content = ARTICLE if ARTICLE in kind else BESIDE
                texts.append(text)
                kinds.append(bytes(kind))
                hashes.append(np.array(own, "<u8").tobytes())
                copies.append(hashlib.blake2b(np.array([h for h, k in zip(own, kind, strict=True) if k == content], "<u8").tobytes(), digest_size=16).digest())
            columns = [*batch.columns[:3], *(pa.array(list(c), pa.string()) for c in zip(*places, strict=True)), pa.array(texts, pa.list_(pa.string())), *(pa.array(c, pa.binary()) for c in (kinds, hashes, copies))]
            return pa.RecordBatch.from_arrays(columns, names=["page_id", "key", "url", "host", "path", "texts", "kinds", "hashes", "copy"])

        return each

    return common.on_batches(pages, make, "page_id long, key long, url string, host string, path string, texts array<string>, kinds binary, hashes binary, copy binary")


def common_start(a: str, b: str) -> int:
    n = 0
    for x, y in zip(a, b):  # noqa: B905
        if x != y:
            break
        n += 1
    return n


def _neighbours(parsed: DataFrame) -> DataFrame:
    """Pages in URL order, each with the contents that stand before and after its run of copies within its task."""
    schema = "page_id long, key long, host string, path string, copy binary, part int, edge int, head boolean, tail boolean, prev binary, prev_path string, next binary, next_path string"
    kinds = (pa.int64(), pa.int64(), pa.string(), pa.string(), pa.binary(), pa.int32(), pa.int32(), pa.bool_(), pa.bool_(), pa.binary(), pa.string(), pa.binary(), pa.string())
    names = [c.split(" ")[0] for c in schema.split(", ")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from itertools import groupby

        from pyspark import TaskContext

        part = TaskContext.get().partitionId()
        rows = (row for batch in batches for row in zip(*(c.to_pylist() for c in batch.columns), strict=True))
        before = now = None

        def made(own: list[tuple], before: tuple | None, after: tuple | None) -> pa.RecordBatch:
            prev = before if before and before[2] == own[0][2] else (None,) * 5
            next_ = after if after and after[2] == own[0][2] else (None,) * 5
            head, tail, last = before is None, after is None, len(own) - 1
            out = [(*r, part, (head and k == 0) + 2 * (tail and k == last), head, tail, prev[4], prev[3], next_[4], next_[3]) for k, r in enumerate(own)]
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out, strict=True), kinds, strict=True)], names=names)

        for _, group in groupby(rows, key=lambda r: (r[2], r[4])):
            after = list(group)  # ids and paths of adjacent copies
            if now is not None:
                yield made(now, before, after[0])
                before = now[-1]
            now = after
        if now is not None:
            yield made(now, before, None)

    order = ["host", "path", "page_id", "key"]
    ranged = parsed.select("page_id", "key", "host", "path", "copy").repartitionByRange(common.partitions(parsed.sparkSession), *order).sortWithinPartitions(*order)
    return ranged.mapInArrow(run, schema)


def _ends(ordered: DataFrame) -> tuple[dict, dict]:
    """For each range partition, up to two different contents that stand before it and after it (two rows of each partition)."""
    rows = ordered.filter("edge > 0").select("part", "edge", "host", "path", "copy", "prev", "prev_path", "next", "next_path").collect()
    first = {r.part: r for r in rows if r.edge & 1}
    last = {r.part: r for r in rows if r.edge & 2}

    def walk(parts: list[int], near: dict, copy: str, path: str) -> dict[int, list[tuple]]:
        out, held = {}, []
        for p in parts:
            out[p] = list(held)
            r = near[p]
            own = (r.host, r.path, bytes(r.copy))
            other = [(r.host, r[path], bytes(r[copy]))] if r[copy] is not None else [h for h in held if h[0] == r.host and h[2] != own[2]][:1]
            held = [own, *other]
        return out

    return walk(sorted(last), last, "prev", "prev_path"), walk(sorted(first, reverse=True), first, "next", "next_path")


def _partners(parsed: DataFrame) -> DataFrame:
    """``page_id, key, partner`` (the lines' hashes of the nearest page that isn't a copy) of the pages that have one."""
    spark = parsed.sparkSession
    ordered = common.store(_neighbours(parsed), "page_order")
    ends = spark.sparkContext.broadcast(_ends(ordered))

    def choose(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        before, after = ends.value

        def other(held: list[tuple], host: str, copy: bytes) -> tuple:
            return next(((c, p) for h, p, c in held if h == host and c != copy), (None, ""))

        for batch in batches:
            found = []
            for page_id, key, host, path, copy, part, _, head, tail, prev, prev_path, next_, next_path in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if prev is None and head:
                    prev, prev_path = other(before[part], host, copy)
                if next_ is None and tail:
                    next_, next_path = other(after[part], host, copy)
                if prev is None or next_ is not None and common_start(path, next_path) > common_start(path, prev_path):
                    prev = next_
                if prev is not None:
                    found.append((page_id, key, prev))
            if found:
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*found, strict=True), (pa.int64(), pa.int64(), pa.binary()), strict=True)], names=["page_id", "key", "partner"])

    chosen = common.store(ordered.mapInArrow(choose, "page_id long, key long, partner binary").dropDuplicates(["page_id", "key"]), "page_choices")
    contents = common.store(parsed.groupBy("copy").agg(F.min("hashes").alias("hashes")), "page_contents")
    return chosen.join(contents, chosen.partner == contents["copy"]).select("page_id", "key", F.col("hashes").alias("partner"))


def extract(pages: DataFrame) -> DataFrame:
    """``page_id, url, text, n_chars`` of each row, and of its visible lines ``n_lines``, those ``n_shared`` with its partner, and those shared that an article keeps, ``n_overruled`` (long)."""
    keyed = pages.select(F.col("page_id").cast("long").alias("page_id"), F.xxhash64("url", "html").alias("key"), F.col("url").cast("string").alias("url"), F.col("html").cast("string").alias("html"))
    parsed = common.store(_parsed(keyed), "page_lines")
    partners = common.store(_partners(parsed), "page_partners")
    size = partners.agg(F.sum(F.length("partner") + 32)).first()[0] or 0
    other = partners.select(F.col("page_id").alias("of"), F.col("key").alias("of_key"), "partner")
    joined = parsed.join(F.broadcast(other) if size <= BROADCAST_BYTES else other, F.col("page_id").eqNullSafe(F.col("of")) & (F.col("key") == F.col("of_key")), "left")

    def make():
        def each(batch: pa.RecordBatch) -> pa.RecordBatch:
            found = []
            for text, kinds, hashes, partner in zip(*(batch.column(k).to_pylist() for k in (2, 3, 4, 5)), strict=True):
                same = shared(np.frombuffer(hashes, "<u8").tolist(), np.frombuffer(partner, "<u8").tolist()) if partner else [False] * len(text)
                kept = decide(list(kinds), same, list(map(terse, text)))
                main = " ".join(t for t, k in zip(text, kept, strict=True) if k)
                found.append((main, len(main), len(text), sum(same), sum(s and k for s, k in zip(same, kept, strict=True))))
            columns = [pa.array(list(c), t) for c, t in zip(zip(*found, strict=True), (pa.string(), *[pa.int64()] * 4), strict=True)]
            return pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), *columns], names=["page_id", "url", "text", "n_chars", "n_lines", "n_shared", "n_overruled"])

        return each

    return common.on_batches(joined.select("page_id", "url", "texts", "kinds", "hashes", "partner"), make, "page_id long, url string, text string, n_chars long, n_lines long, n_shared long, n_overruled long")
