"""The main body of web pages, by tag-path ratios."""

from __future__ import annotations

import html
import math
import re
from collections import defaultdict
from collections.abc import Iterator, Set
from dataclasses import dataclass
from functools import reduce
from typing import NamedTuple

import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import IntegerType, StringType, StructType

from corpusloom.functions.urls import host
from corpusloom.runtime import cut, keep, map_batches

#: Tags that are part of the running text, and elements that have no end tag.
RUNNING = frozenset("a abbr b br code em i small span strong sub sup u".split())
EMPTY = frozenset("area base br col embed hr img input link meta param source track wbr".split())
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
CELLS = frozenset("td th caption".split())
ITEMS = frozenset("li dt dd".split())
#: What an element that begins ends, if it is still open.
CLOSES = {
    "li": ("li", "p"), "td": ("td", "th", "p"), "th": ("td", "th", "p"), "tr": ("tr", "td", "th", "p"), "dt": ("dt", "dd", "p"),
    "dd": ("dt", "dd", "p"), "option": ("option",),
} | dict.fromkeys(
    "p h1 h2 h3 h4 h5 h6 ul ol dl table div section article aside header footer main nav blockquote pre form hr fieldset".split(), ("p",)
)
#: A comment; an element that is dropped with its content; a tag, up to the end of the page if it is cut off.
TOKEN = re.compile(
    r"<!--.*?(?:-->|\Z)"
    r"|<(script|style|noscript|head)(?=[\s/>])(?:[^'\">]++|\"[^\"]*+\"|'[^']*+')*+>.*?(?:</\1\s*>|\Z)"
    r"|<(/?)([a-zA-Z][^\s/>]*+)((?:[^'\">]++|\"[^\"]*+(?:\"|\Z)|'[^']*+(?:'|\Z))*+)(>|\Z)"
    r"|<[!?][^>]*+(?:>|\Z)",
    re.DOTALL | re.IGNORECASE,
)
#: The same where a quote is left open up to the end of the page: quotes mean nothing then.
PLAIN_TOKEN = re.compile(r"<!--.*?(?:-->|\Z)|<(script|style|noscript|head)(?=[\s/>])[^>]*+>.*?(?:</\1\s*>|\Z)|<(/?)([a-zA-Z][^\s/>]*+)([^>]*+)(>|\Z)|<[!?][^>]*+(?:>|\Z)", re.DOTALL | re.IGNORECASE)
NAME = re.compile(r"(?:^|\s)(?:class|id)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+))", re.IGNORECASE)
PUNCTUATION = re.compile(r"[.,;:!?…。、，；：！？]")
ENDS = ".!?…。！？"
CLOSERS = "\"'”’)]"
CLAUSE = re.compile(r"[.;:!?…。；！？]+\s*|,\s+")
DIGITS = re.compile(r"\d+")
#: A clause is furniture if it stands on this share of all different pages, and outside the body on
#: at least OUTSIDE of those (text of articles hardly ever does); a whole block if it recurs in
#: different company on BLOCK_SHARE of all, and of a site's pages on their square root more.
#: Shares are of the corpus and of each site. Nothing on fewer than LEAST_PAGES pages is furniture.
CLAUSE_SHARE, OUTSIDE, BLOCK_SHARE, LEAST_PAGES = 0.003, 0.2, 0.03, 3
MOST_ENTRIES = 2_000_000
#: Content nodes have a ratio of at least so many standard deviations of their page's; what is
#: neither node nor heading counts so much against its elements.
THRESHOLD, AGAINST = 1.0, -0.1
#: Of the strength (ratios of content nodes, summed up) of the corpus's median body, what a body
#: without a heading needs; what is weaker is a page's notices.
WEAK = 0.5
#: The number of blocks that a whole block is seen with.
NEAR = 5


@dataclass(slots=True)
class Block:
    """A stretch of text between two tags that are no part of running text.

    ``leaf`` is the element that holds it, ``path`` its root-to-leaf tag path, both as
    numbers of the page; ``pointer`` tells a line that leads to another article.
    """

    tag: str
    leaf: int
    path: int
    size: int
    linked: int
    marks: int
    leads: bool
    ends: bool
    pointer: bool
    text: str = ""


@dataclass(slots=True)
class Page:
    """Its blocks, and of each element, numbered from 1 in order, the element around it (0: none)."""

    blocks: list[Block]
    parent: list[int]

    def last_within(self) -> list[int]:
        """Of each element the last one inside of it, so that ``e <= x <= last[e]`` tells x in e."""
        last = list(range(len(self.parent)))
        for e in range(len(last) - 1, 0, -1):
            around = self.parent[e]
            if last[e] > last[around]:
                last[around] = last[e]
        return last


def read_page(page: str) -> Page:
    """The numbered blocks of a page, in order; comments, head, script, style and noscript left out.

    End tags that nothing opened are ignored; elements that a new one cannot be inside of
    are closed by it, so that unclosed paragraphs, items, rows and cells do not nest. An
    element costs the same at any depth.
    """
    out: list[Block] = []
    parent = [0]
    tags: list[str] = []
    ids: list[int] = [0]
    paths: list[int] = [0]
    known: dict[tuple[int, str], int] = {}
    opened: dict[str, list[int]] = defaultdict(list)
    parts: list[str] = []
    linked, leads, in_link, begun, at = 0, False, False, False, 0

    def close(k: int) -> None:
        while len(tags) > k:
            opened[tags.pop()].pop()
            ids.pop(), paths.pop()

    def end_block() -> None:
        nonlocal parts, linked, leads, begun
        if begun and (text := _decoded("".join(parts)).strip()):
            own = tags[-1] if tags else ""
            # most of it is a link, or it begins with one and a colon
            points = linked > 0.4 * len(text) or (leads and text[linked : linked + 4].lstrip().startswith(":"))
            out.append(
                Block(own, ids[-1], paths[-1], len(text), linked, len(PUNCTUATION.findall(text)), leads, ends_sentence(text), linked > 0 and points, text)
            )
        parts, linked, leads, begun = [], 0, False, False

    pattern, tail = TOKEN, 0
    while tail >= 0:
        first, tail = tail, -1
        for m in pattern.finditer(page, first):
            _, slash, tag, attributes, closed = m.groups()
            start = m.start()
            if tag and not closed:
                if pattern is TOKEN:  # from here on quotes mean nothing; a second time no tag follows
                    pattern, tail = PLAIN_TOKEN, start
                break
            if start > at:
                raw = page[at:start]
                if in_link or not begun:
                    seen = len(_decoded(raw).strip())
                    if in_link and seen:
                        leads = leads or not begun
                        linked += seen
                    begun = begun or seen > 0
                parts.append(raw)
            at = m.end()
            if tag:
                tag = tag.lower()
                if tag in RUNNING:
                    if tag == "a":
                        in_link = not slash
                    elif tag == "br":
                        parts.append(" ")
                    continue
            elif page.startswith("<!--", start):
                continue
            if parts:
                end_block()
            if not tag:
                continue
            if slash:
                if opened.get(tag):
                    close(opened[tag][-1])
            elif tag not in EMPTY:
                for over in CLOSES.get(tag, ()):
                    if tags and tags[-1] == over:
                        close(len(tags) - 1)
                own = NAME.search(attributes) if attributes else None
                label = f"{tag}.{own.group(1) or own.group(2) or own.group(3) or ''}" if own else tag
                parent.append(ids[-1])
                ids.append(len(parent) - 1)
                paths.append(known.setdefault((paths[-1], label), len(known) + 1))
                opened[tag].append(len(tags))
                tags.append(tag)
    if at < len(page):
        raw = page[at:]
        seen = len(_decoded(raw).strip())
        if in_link and seen:
            leads = leads or not begun
            linked += seen
        begun = begun or seen > 0
        parts.append(raw)
    end_block()
    return Page(out, parent)


def text_blocks(page: str) -> list[Block]:
    return read_page(page).blocks


def ends_sentence(text: str) -> bool:
    return text.rstrip(CLOSERS)[-1:] in ENDS if text else False


def _decoded(text: str) -> str:
    return html.unescape(text) if "&" in text else text


def masked(text: str) -> str:
    return DIGITS.sub("0", " ".join(text.split()).lower())


def entry_id(text: str) -> int:
    """64 bits that stand for a clause or a whole block in all tables of the corpus."""
    return xxhash.xxh3_64_intdigest(text.encode("utf-8", "replace")) - 2**63


def clauses(line: str) -> list[str]:
    """The clauses of a masked line, without those of a single short word."""
    return [c for c in (x.strip() for x in CLAUSE.split(line)) if len(c) > 8]


def path_ratios(blocks: list[Block], away: list[bool]) -> list[float]:
    """Of each block the fused ratio of its tag path, smoothed over its neighbours.

    Of every root-to-leaf path the unlinked text and the punctuation are summed up and
    divided by its blocks; the two are fused as the root of their product. Blocks
    that are ``away`` (furniture and pointers) have no part in it.
    """
    text, marks, count = defaultdict(int), defaultdict(int), defaultdict(int)
    for b, x in zip(blocks, away, strict=True):
        if not x:
            text[b.path] += max(0, b.size - b.linked)
            marks[b.path] += b.marks
            count[b.path] += 1
    fused = {p: math.sqrt(text[p] * marks[p]) / n for p, n in count.items()}
    own = [0.0 if x else fused[b.path] for b, x in zip(blocks, away, strict=True)]
    padded = [own[0], *own, own[-1]] if own else []
    return [0.25 * a + 0.5 * b + 0.25 * c for a, b, c in zip(padded, padded[1:], padded[2:])]


def content_nodes(ratios: list[float], away: list[bool]) -> list[bool]:
    """Whether each block's ratio reaches the threshold of its page, THRESHOLD standard deviations; none that is ``away``."""
    n = len(ratios) or 1
    mean = sum(ratios) / n
    least = THRESHOLD * math.sqrt(sum((r - mean) ** 2 for r in ratios) / n)
    return [r > 0 and r >= least and not x for r, x in zip(ratios, away, strict=True)]


class Body(NamedTuple):
    """Indices of the blocks within the element that holds the main text, furniture included,
    whether a heading is among them, the sum of the ratios of its content nodes, and the
    greatest ratio of the page."""

    inside: list[int]
    titled: bool
    strength: float
    top: float


class Usual(NamedTuple):
    """The medians of the corpus's bodies, 0 before they are known."""

    strength: float = 0.0
    top: float = 0.0


def body_of(page: Page, furnished: list[bool], usual: Usual = Usual()) -> Body:
    """The body of a page; without any block if it has none.

    A content node (``content_nodes``) counts for its elements by its path's ratio, as a share
    of the page's or the usual greatest one, a heading by the ratio of what it heads, and what
    is neither against them; furniture, cells, and items that a heading stands over, do neither. Of all elements the one of the
    greatest sum is the body, or the innermost with all its headings that has most of
    that sum; one around it, if all that this adds is headed. Sums go up the tree once.
    """
    blocks, parent = page.blocks, page.parent
    away = [f or b.pointer or b.tag == "button" for b, f in zip(blocks, furnished, strict=True)]
    ratios = path_ratios(blocks, away)
    chosen = content_nodes(ratios, [x or b.tag in HEADINGS for b, x in zip(blocks, away, strict=True)])
    most = max(ratios, default=0.0)
    top = max(most, usual.top) or 1.0
    last = page.last_within()
    gain, held = [0.0] * len(parent), [0] * len(parent)
    titles: list[int] = []
    headed: list[bool] = []
    over = -1  # what holds the last heading
    for i, b in enumerate(blocks):
        heading = b.tag in HEADINGS
        if heading:
            over = parent[b.leaf]
        headed.append(0 <= over <= b.leaf <= last[over])
        if heading:
            follows = i + 1 < len(blocks) and not away[i + 1] and over <= blocks[i + 1].leaf <= last[over]
            value = 1.0 if b.tag == "h1" else ratios[i] / top if follows else AGAINST
            if follows or b.tag == "h1":
                titles.append(b.leaf)
        elif chosen[i]:
            value = ratios[i] / top
        elif furnished[i] or b.tag in CELLS or (b.tag in ITEMS and headed[i]):
            value = 0.0
        else:
            value = AGAINST
        gain[b.leaf] += value
        held[b.leaf] += not heading
    for e in range(len(parent) - 1, 0, -1):
        gain[parent[e]] += gain[e]
        held[parent[e]] += held[e]
    best = max((e for e in range(len(parent)) if held[e]), key=lambda e: (round(gain[e], 6), e), default=0)
    if gain[best] <= 0:
        return Body([], False, 0.0, most)
    if titles:  # notices around the body may add to it: within, all that is headed is enough
        low, high = min(titles), max(titles)
        common, e = [], low
        while True:
            if e <= low and high <= last[e] and held[e] and gain[e] >= 0.5 * gain[best]:
                common.append(e)
            if not e:
                break
            e = parent[e]
        wider = max(common, default=best)
        if wider < best and all(h or best <= b.leaf <= last[best] for b, h in zip(blocks, headed, strict=True) if wider <= b.leaf <= last[wider]):
            best = wider
        best = max([best, *(e for e in common if best != wider)])
    inside = [i for i, b in enumerate(blocks) if best <= b.leaf <= last[best]]
    strength = sum(ratios[i] for i in inside if chosen[i])
    return Body(inside, any(best <= leaf <= last[best] for leaf in titles), strength, most)


def rest_of(page: Page, furnished: list[bool], bare: bool = False) -> list[int]:
    """Indices of the blocks left on a page without a body of its own: a short text, a table or a list.

    What is neither furniture nor pointer is main text, however short, if it stands together,
    with none of these in between; otherwise notices that nothing tells as furniture cannot
    be parted from it. ``bare``: only if the page holds nothing else.
    """
    blocks, parent = page.blocks, page.parent
    last = page.last_within()
    lists: dict[int, list[int]] = defaultdict(list)
    for i, b in enumerate(blocks):
        if b.tag in ITEMS:
            lists[parent[b.leaf]].append(i)
    away = [f or b.pointer or b.tag == "button" or (b.leads and not b.ends) for b, f in zip(blocks, furnished, strict=True)]
    for items in lists.values():  # a list is main text or not as a whole
        out = 2 * sum(away[i] for i in items) > len(items) or any(furnished[i] for i in items)
        for i in items:
            away[i] = out
    for i in range(len(blocks) - 1, -1, -1):  # a heading goes with what it heads
        if blocks[i].tag in HEADINGS and blocks[i].tag != "h1":
            over = parent[blocks[i].leaf]
            away[i] = i + 1 == len(blocks) or away[i + 1] or not over <= blocks[i + 1].leaf <= last[over]
    left = [i for i, x in enumerate(away) if not x]
    if all(blocks[i].tag in HEADINGS for i in left):
        return []
    if bare:
        return left if len(left) == len(blocks) else []
    low, high = min(blocks[i].leaf for i in left), max(blocks[i].leaf for i in left)
    around = low
    while high > last[around]:
        around = parent[around]
    return left if len(left) == sum(around <= b.leaf <= last[around] for b in blocks) else []


def block_entries(b: Block, line: str | None = None) -> tuple[int, list[int], list[int]]:
    """Ids of the whole block and of its clauses, and the clauses' lengths; (0, [], []) for
    headings, cells and listed links, which are never taken for furniture. ``line``: its text, masked."""
    if b.tag in HEADINGS or b.tag in CELLS or (b.tag in ITEMS and b.linked > 0.5 * b.size):
        return 0, [], []
    line = masked(b.text) if line is None else line
    parts = clauses(line)
    return entry_id("=" + line), list(map(entry_id, parts)), list(map(len, parts))


def is_furniture(b: Block, entries: tuple[int, list[int], list[int]], furniture: Set[int]) -> bool:
    """Whether the block as a whole (not of a list), or most of its clauses' text, is known as furniture."""
    whole, parts, sizes = entries
    if not whole:
        return False
    if whole in furniture and b.tag not in ITEMS:
        return True
    known = sum(n for e, n in zip(parts, sizes, strict=True) if e in furniture)
    return 2 * known > sum(sizes)


def main_of(page: Page, furnished: list[bool], usual: Usual = Usual()) -> list[int]:
    """Indices of the blocks with the main text: of the body, or what ``rest_of`` leaves, less furniture and pointers.

    A body without a heading that is weak (WEAK) is none.
    """
    kept = (*ITEMS, "td", "th", *HEADINGS)
    out = []
    found = body_of(page, furnished, usual)
    weak = not found.titled and found.strength < WEAK * usual.strength
    for i in rest_of(page, furnished) if weak or not found.inside else found.inside:
        b = page.blocks[i]
        if not furnished[i] and b.tag != "button" and (not b.pointer or b.tag in kept):
            out.append(i)
    return out


def main_blocks(html_text: str, furniture: Set[int] = frozenset(), usual: Usual = Usual()) -> list[tuple[int, Block]]:
    """(block_no, block) of the main text of a page, counted from 1."""
    page = read_page(html_text)
    furnished = [is_furniture(b, block_entries(b), furniture) for b in page.blocks]
    return [(i + 1, page.blocks[i]) for i in main_of(page, furnished, usual)]


def page_table(tabs: DataFrame, details: DataFrame) -> DataFrame:
    """(page_id, html, site) of both tables; the site is the host."""
    of = lambda frame, url: frame.select("page_id", "html", host(F.col(url)).alias("site"))
    return of(tabs, "source_url").union(of(details, "url"))


KEPT_FIELDS = (
    "titled boolean, strength double, top double, body bigint, near array<bigint>, every bigint, every_near array<bigint>, text array<string>, tag array<string>, num array<int>, parent array<int>, "
    "whole array<bigint>, clause array<bigint>, size array<int>, company array<bigint>, inner array<bigint>, outer array<bigint>"
)
#: What ``num`` holds of each block.
NUMBERS = ("leaf", "path", "size", "linked", "marks", "flags", "clauses")


def parsed_pages(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Pages (page_id, page, site, html) as columns: their blocks and elements, and what the corpus counts.

    ``body`` is a digest of the text of the body, ``near`` the longest blocks of it, ``every``
    and ``every_near`` the same of the whole page, ``company`` the whole blocks, ``inner`` and
    ``outer`` the clauses within the body and those only outside of it. Headings, cells and
    pointers are in none of these three. A page that holds nothing but main text counts as titled.
    """
    for given in batches:
        for at in range(0, given.num_rows, 200):
            batch = given.slice(at, 200)
            rows = [_parsed(page) for page in batch.column(3).to_pylist()]
            columns = [pa.array([r[f.name] for r in rows], f.type) for f in KEPT_ARROW]
            yield pa.RecordBatch.from_arrays([*batch.columns[:3], *columns], names=["page_id", "page", "site", *KEPT_ARROW.names])


LONGS, INTS, TEXTS = pa.list_(pa.int64()), pa.list_(pa.int32()), pa.list_(pa.string())
KEPT_ARROW = pa.schema(
    [
        ("titled", pa.bool_()), ("strength", pa.float64()), ("top", pa.float64()), ("body", pa.int64()), ("near", LONGS), ("every", pa.int64()),
        ("every_near", LONGS), ("text", TEXTS), ("tag", TEXTS), ("num", INTS), ("parent", INTS),
        ("whole", LONGS), ("clause", LONGS), ("size", INTS), ("company", LONGS), ("inner", LONGS), ("outer", LONGS),
    ]
)


def _parsed(html_text: str) -> dict:
    page = read_page(html_text)
    blocks = page.blocks
    nothing = [False] * len(blocks)
    bare = rest_of(page, nothing, bare=True)
    found = body_of(page, nothing)
    inside = set(found.inside or bare)
    lines = [masked(b.text) for b in blocks]
    own = [lines[i] for i in sorted(inside)] or lines
    num, whole, clause, size, company = [], [], [], [], []
    places: dict[int, bool] = {}
    for i, b in enumerate(blocks):
        w, parts, sizes = block_entries(b, lines[i])
        num += (b.leaf, b.path, b.size, b.linked, b.marks, b.leads | b.ends << 1 | b.pointer << 2, len(parts))
        whole.append(w)
        clause += parts
        size += sizes
        if w and not b.pointer:
            company.append(w)
            for e in parts:
                places[e] = places.get(e, False) or i in inside
    longest = lambda texts: [entry_id("=" + x) for x in sorted(dict.fromkeys(texts), key=len, reverse=True)[: NEAR + 1]]
    return {
        "titled": bool(bare) or found.titled, "strength": found.strength, "top": found.top,
        "body": entry_id("\n".join(own)), "near": longest(own), "every": entry_id("\n".join(lines)), "every_near": longest(lines),
        "text": [b.text for b in blocks], "tag": [b.tag for b in blocks], "num": num, "parent": page.parent,
        "whole": whole, "clause": clause, "size": size, "company": list(dict.fromkeys(company)),
        "inner": [e for e, x in places.items() if x], "outer": [e for e, x in places.items() if not x],
    }


def usual_body(kept: DataFrame) -> Usual:
    median = kept.agg(F.percentile_approx("strength", 0.5), F.percentile_approx("top", 0.5)).first()
    return Usual(*(x or 0.0 for x in median))


def with_bodies(kept: DataFrame, usual: Usual) -> DataFrame:
    """(site, body, near, company, inner, outer) of ``parsed_pages``, with the bodies that are none taken back.

    A body without a heading whose content nodes come to less than WEAK of the ``usual`` ones
    (the median of all pages) is a page's notices: all of it is outside, and the page counts as a whole.
    """
    weak = ~F.col("titled") & (F.col("strength") < WEAK * usual.strength)
    return kept.select(
        "site",
        F.when(weak, F.col("every")).otherwise(F.col("body")).alias("body"),
        F.when(weak, F.col("every_near")).otherwise(F.col("near")).alias("near"),
        "company",
        F.when(weak, F.array().cast("array<bigint>")).otherwise(F.col("inner")).alias("inner"),
        F.when(weak, F.concat("inner", "outer")).otherwise(F.col("outer")).alias("outer"),
    )


def _different(bodies: DataFrame, key: list[str], entry: Column | None) -> DataFrame:
    """(*key, different): in how different company the bodies (``near``) of each key are.

    Of the NEAR longest other blocks of a body, first to last, the different ones are
    counted over the bodies, and the median of these counts is taken.
    """
    others = F.col("near") if entry is None else F.array_remove("near", entry)
    at = lambda k: F.try_element_at(others, F.lit(k) % F.greatest(F.size(others), F.lit(1)) + 1)
    ranked = F.array(*(F.struct(F.lit(k).alias("rank"), at(k).alias("block")) for k in range(NEAR)))
    counts = bodies.select(*key, F.inline(ranked)).distinct().groupBy(*key, "rank").agg(F.count("*").alias("n"))
    return counts.groupBy(*key).agg(F.get(F.sort_array(F.collect_list("n")), F.lit(NEAR // 2)).alias("different"))


def frequent_entries(kept: DataFrame, within: list[str]) -> DataFrame:
    """(*within, entry) of ``with_bodies`` that are furniture of the corpus or, within ['site'], of a site.

    Entries are clauses and whole blocks. Pages with the same body count once, so that
    copies make nothing furniture, and a whole block counts by what it stands with
    (``_different``), so that near copies do not either: they share most of their blocks,
    while a review line, which always stands inside the body, stands with others on every
    page. Clauses need to stand outside of bodies, so those inside are counted only of
    clauses that do so often enough: the others never leave their page.
    """
    key = [*within, "entry"]
    of = lambda column: kept.select(*within, "body", F.explode(column).alias("entry"))
    bodies = kept.groupBy(*within, "body").agg(F.min("near").alias("near"))
    totals = bodies.groupBy(*within).agg(F.count("*").alias("all_pages"))
    varied = _different(bodies, within, None).withColumnRenamed("different", "all_different")
    if within:
        totals = cut(totals.join(varied, within))
        with_totals = lambda frame: frame.join(totals, within)
    else:
        n, different = totals.first()[0], (varied.first() or [0])[0] or 0
        with_totals = lambda frame: frame.withColumns({"all_pages": F.lit(n), "all_different": F.lit(different)})
    least = F.greatest(F.lit(LEAST_PAGES), CLAUSE_SHARE * F.col("all_pages"))
    outer = of("outer").distinct()
    often = with_totals(outer.groupBy(*key).agg(F.count("*").alias("pages")))
    candidates = cut(often.where(F.col("pages") >= OUTSIDE * least).select(*key))
    placed = outer.join(candidates, key, "left_semi").withColumn("inside", F.lit(0))
    placed = placed.union(of("inner").join(candidates, key, "left_semi").withColumn("inside", F.lit(1)))
    counts = placed.groupBy(*key, "body").agg(F.max("inside").alias("inside")).groupBy(*key)
    counts = with_totals(counts.agg(F.count("*").alias("pages"), F.sum("inside").alias("inside")))
    clauses_found = counts.where((F.col("pages") >= least) & (F.col("pages") - F.col("inside") >= OUTSIDE * F.col("pages")))
    blocks = of("company").distinct()
    recurring = blocks.groupBy(*key).agg(F.count("*").alias("pages")).where(F.col("pages") >= LEAST_PAGES)
    near = blocks.join(recurring.select(*key), key, "left_semi").join(bodies, [*within, "body"])
    # a few pages of a site may hold the same short paragraph by chance
    chance = F.sqrt("all_different") if within else F.lit(0)
    blocks_found = with_totals(_different(near, key, F.col("entry"))).where(
        (F.col("different") >= LEAST_PAGES) & (F.col("different") >= F.col("all_different") * BLOCK_SHARE + chance)
    )
    return clauses_found.select(*key).union(blocks_found.select(*key)).distinct()


def _own_entries(kept: DataFrame, known: list[DataFrame]) -> DataFrame:
    """(page, own): of each page the entries that one of ``known`` (entry, or site and entry) names."""
    entries = kept.select("page", "site", F.explode(F.array_union("whole", "clause")).alias("entry"))
    hits = [entries.join(k, [c for c in k.columns], "left_semi").select("page", "entry") for k in known]
    return reduce(DataFrame.union, hits).groupBy("page").agg(F.collect_set("entry").alias("own"))


def main_content(pages: DataFrame, texts: bool = True, most_entries: int = MOST_ENTRIES) -> DataFrame:
    """(page_id, block_no INT, text) of the blocks with the main text of each page of ``pages``.

    Pages are parsed once; their blocks and what the corpus counts of them are kept in the
    shared folder. Furniture of the corpus is found from these and known to all tasks of
    the second pass; there is little of it, as it stands on a given share of all pages. More
    than ``most_entries``, and furniture of single sites, if ``pages`` has a column ``site``,
    is joined to the pages that have it, as there is no bound to the number of sites. The second
    pass needs no texts; without ``texts`` (and the column) they are not read again.

    Null and empty pages, and pages without main text, give no rows; repeated rows give
    repeated rows; further columns are ignored.
    """
    spark = pages.sparkSession
    sites = "site" in pages.columns
    site = F.col("site").cast("string") if sites else F.lit(None).cast("string")
    source = pages.where("html is not null and html <> ''").select(
        "page_id", F.xxhash64(site, "html").alias("page"), F.when(site != "", F.xxhash64(site)).alias("site"), "html"
    )
    key = pages.schema["page_id"]
    shape = f"page_id {key.dataType.simpleString()}, page bigint, site bigint, {KEPT_FIELDS}"
    kept = keep(map_batches(source, parsed_pages, shape))
    usual = usual_body(kept)
    told = with_bodies(kept, usual)
    corpus = cut(frequent_entries(told, []))
    few = corpus.count() <= most_entries
    furniture = spark.sparkContext.broadcast(frozenset(r[0] for r in corpus.collect()) if few else frozenset())
    joined = [*([] if few else [corpus]), *([cut(frequent_entries(told.where("site is not null"), ["site"]))] if sites else [])]
    joined = [frame for frame in joined if not frame.isEmpty()]
    fields = ["page_id", "page", "tag", "num", "parent", "whole", "clause", "size", *(["text"] if texts else [])]
    parts = kept.select(*fields)
    if joined:
        parts = parts.join(_own_entries(kept, joined), "page", "left")
    else:
        parts = parts.withColumn("own", F.lit(None).cast("array<bigint>"))
    result = StructType([key]).add("block_no", IntegerType())
    result = result.add("text", StringType()) if texts else result

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = furniture.value
        for given in batches:
            for at in range(0, given.num_rows, 200):
                batch = given.slice(at, 200)
                of = {name: batch.column(name).to_pylist() for name in batch.schema.names if name not in ("page_id", "page")}
                row, no, text = [], [], []
                for r, own in enumerate(of["own"]):
                    page, entries = _kept_page(*(of[x][r] for x in ("tag", "num", "parent", "whole", "clause", "size")))
                    names = known.union(own) if own else known
                    furnished = [is_furniture(b, e, names) for b, e in zip(page.blocks, entries, strict=True)]
                    for i in main_of(page, furnished, usual):
                        row.append(r), no.append(i + 1)
                        if texts:
                            text.append(of["text"][r][i])
                found = [batch.column("page_id").take(pa.array(row, pa.int32())), pa.array(no, pa.int32())]
                yield pa.RecordBatch.from_arrays(found + ([pa.array(text, pa.string())] if texts else []), names=result.names)

    return map_batches(parts, run, result)


def _kept_page(tags: list[str], num: list[int], parent: list[int], whole: list[int], clause: list[int], size: list[int]) -> tuple:
    """A page of ``parsed_pages`` again, without its texts, and its blocks' entries."""
    blocks, entries, at, width = [], [], 0, len(NUMBERS)
    for i, tag in enumerate(tags):
        leaf, path, length, linked, marks, flags, n = num[i * width : (i + 1) * width]
        blocks.append(Block(tag, leaf, path, length, linked, marks, bool(flags & 1), bool(flags & 2), bool(flags & 4)))
        entries.append((whole[i], clause[at : at + n], size[at : at + n]))
        at += n
    return Page(blocks, parent), entries
