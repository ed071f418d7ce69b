"""Splitting oversized texts at natural boundaries, by dynamic programming."""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import IntegerType, StringType, StructType

from corpusloom.runtime import map_batches

PARAGRAPH, LINE, SENTENCE, CLAUSE, WORD, CHARACTER = range(6)
#: What a cut at each kind of boundary costs, what one directly after a heading costs more,
#: and what each piece costs, as its deviation from equal sizes is counted by its square.
#: Two cuts at ends of sentences or better, and the piece between, cost at most 16 more than
#: none, so a cut at a clause or word is never best where such ends are no more than a piece
#: apart; likewise one within a word where words are (at most 56 more).
COSTS = (0.0, 0.6, 1.0, 20.0, 24.0, 60.0)
AFTER_HEADING = 3.0
PIECE = 2.0
BALANCE = 2.0
#: Stretches longer than a piece without any boundary may be cut between the grapheme clusters
#: nearest to each multiple of a piece's length by this number.
GRID = 64

BREAK = "\n\r\v\f\x85" + chr(0x2028) + chr(0x2029)
#: Each matches at a place: where the next text begins after a blank line, a line end, a sentence ...
#: Runs are taken as a whole and from their first character only, so that time is linear.
PARAGRAPHS = re.compile(r"(?<![\n\r \t])[ \t]*+(?:\r\n|\n|\r)[ \t]*+(?:\r\n|\n|\r)(?:[ \t]*+(?:\r\n|\n|\r))*+")
LINES = re.compile(rf"(?<![{BREAK}])[{BREAK}]++")
SENTENCES = re.compile(r"(?<![.!?…։؟।۔])([.!?…։؟।۔]++)[\"'”’»)\]*_]*+\s++(?=\S)|[。！？｡]++[」』）”’]*+")
CLAUSES = re.compile(r"[,;:]\s++|[，；：、]")
WORDS = re.compile(r"(?<!\s)\s++(?=\S)")
CLUSTERS = regex.compile(r"\X")
HEADINGS = re.compile(r"(?m)^([ \t]{0,3}#{1,6}[ \t][^\r\n]*+)(?:\r\n|\n|\r)?+")
#: Words that end in a full stop within a sentence.
ABBREVIATION = re.compile(
    r"(?:\b(?:dr|prof|mr|mrs|ms|st|vs|cf|ch|fig|no|nr|al|approx|ca|bzw|vgl|kap|abb|max|min|usw|etc|sog|inkl)|"
    r"\b(?:e\.\s?g|i\.\s?e|z\.\s?b|d\.\s?h|u\.\s?a|a\.\s?m|p\.\s?m)|\b\w)\.$",
    re.IGNORECASE,
)


def boundaries(text: str) -> dict[int, float]:
    """Places after which the text may be cut, each with what a cut there costs."""
    found: dict[int, int] = {}

    def add(at: int, kind: int) -> None:
        if 0 < at < len(text) and found.get(at, CHARACTER) > kind:
            found[at] = kind

    for m in PARAGRAPHS.finditer(text):
        add(m.end(), PARAGRAPH)
    for m in LINES.finditer(text):
        add(m.end(), LINE)
    for m in SENTENCES.finditer(text):
        if not m.group(1) or not ABBREVIATION.search(text[max(0, m.end(1) - 16) : m.end(1)]):
            add(m.end(), SENTENCE)
    costs = {at: COSTS[kind] for at, kind in found.items()}
    for m in HEADINGS.finditer(text):
        for at in (m.end(), *[x.end() for x in PARAGRAPHS.finditer(text, m.end(1), m.end() + 8)][:1]):
            if at in costs:
                costs[at] += AFTER_HEADING
    return costs


def cut_places(text: str, limit: int = 4000, overlap: int = 200) -> list[int]:
    """Ends of the pieces of ``text``; the last is its length. See ``split_oversized``."""
    n, step = len(text), limit - overlap
    if n <= limit:
        return [n]
    costs = boundaries(text)
    for finer in (((CLAUSES, CLAUSE), (WORDS, WORD)), None):
        edges = [0, *sorted(costs), n]
        for a, b in zip(edges, edges[1:]):
            if b - a <= step:
                continue
            for pattern, kind in finer or ():
                for m in pattern.finditer(text, a, b):
                    if a < m.end() < b:
                        costs.setdefault(m.end(), COSTS[kind])
            if not finer:
                costs |= dict.fromkeys(_between_clusters(text, a, b, max(1, step // GRID)), COSTS[CHARACTER])
    # the first piece is as long as its end, any other its end less that of the one before and the overlap
    places = sorted(at for at in costs if at > overlap)
    ends = np.array([overlap, *places, n], dtype=np.int64)
    price = np.array([0.0, *(costs[at] for at in places), 0.0]) + PIECE
    ideal = (n - overlap) / -(-(n - overlap) // step)
    first = np.searchsorted(ends, ends - step)
    best, back = np.zeros(len(ends)), np.zeros(len(ends), dtype=np.int64)
    for j in range(1, len(ends)):
        i = first[j]
        off = (ends[j] - ends[i:j]) / ideal - 1
        total = best[i:j] + BALANCE * off * off
        back[j] = at = i + total.argmin()
        best[j] = total[at - i] + price[j]
    out, j = [], len(ends) - 1
    while j > 0:
        out.append(int(ends[j]))
        j = back[j]
    return out[::-1]


def _between_clusters(text: str, a: int, b: int, stride: int) -> list[int]:
    """Places between grapheme clusters in ``text[a:b]``, one near each ``stride`` characters.

    A cluster longer than twice that is cut inside, as nothing else is possible.
    """
    out, at = [], a
    while at + stride < b:
        place = target = at + stride
        last = at  # clusters are found from the last place on, so that none is split
        m = CLUSTERS.match(text, last)
        while m and m.end() <= target:
            last = m.end()
            m = CLUSTERS.match(text, last)
        if last > at:
            place = last
        elif m and m.end() <= at + 2 * stride and m.end() < b:
            place = m.end()
        if text[place - 1] == "\r" and text[place : place + 1] == "\n" and place + 1 < b:
            place += 1
        out.append(place)
        at = place
    return out


def split_oversized(
    texts: DataFrame, key: str, fields: list[str], limit: int = 4000, overlap: int = 200
) -> DataFrame:
    """(key, field_name, piece_no, n_pieces, start_char, end_char, piece) of each text of ``fields``.

    ``piece`` is the text from character start_char (counted from 0) up to end_char, at most
    ``limit`` Unicode code points; each piece after the first begins with exactly the last
    ``overlap`` characters of the one before it, so that the pieces lose nothing. Cuts come
    where the sum of their costs (paragraphs before lines, sentences, clauses and words;
    grapheme clusters only where a stretch has none of these), of the pieces, and of the
    imbalance of sizes is least over all boundaries. No cut is within the first ``overlap`` characters.

    A text within the limit is one piece, an empty one an empty piece; a null text has none.
    Repeated rows give repeated pieces. Further columns, whatever their names, are ignored.
    Only oversized texts leave the JVM. There is no shuffle.
    """
    if not 0 <= overlap < limit:
        raise ValueError("the overlap must be smaller than the limit")
    rows = texts.select(
        F.col(key).alias("k"),
        F.inline(F.array(*[F.struct(F.lit(f).alias("field_name"), F.col(f).alias("text")) for f in fields])),
    ).where(F.col("text").isNotNull())
    kind = texts.schema[key].dataType
    shape = StructType().add("k", kind).add("field_name", StringType()).add("piece_no", IntegerType()).add("n_pieces", IntegerType())
    shape = shape.add("start_char", IntegerType()).add("end_char", IntegerType()).add("piece", StringType())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for at in range(0, whole.num_rows, 64):  # an output batch of bounded size
                batch = whole.slice(at, 64)
                row, no, count, start, end, piece = [], [], [], [], [], []
                for r, text in enumerate(batch.column(2).to_pylist()):
                    ends = cut_places(text, limit, overlap)
                    begin = 0
                    for i, e in enumerate(ends, 1):
                        row.append(r), no.append(i), count.append(len(ends)), start.append(begin), end.append(e)
                        piece.append(text[begin:e])
                        begin = max(0, e - overlap)
                take = pa.array(row, pa.int32())
                numbers = [pa.array(x, pa.int32()) for x in (no, count, start, end)]
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).take(take), batch.column(1).take(take), *numbers, pa.array(piece, pa.string())],
                    names=shape.fieldNames(),
                )

    long = F.length("text") > limit
    whole = rows.where(~long).select(
        "k", "field_name", F.lit(1).alias("piece_no"), F.lit(1).alias("n_pieces"), F.lit(0).alias("start_char"),
        F.length("text").alias("end_char"), F.col("text").alias("piece"),
    )
    return whole.union(map_batches(rows.where(long), run, shape)).withColumnRenamed("k", key)


def oversized(texts: DataFrame, key: str, fields: list[str], **how) -> DataFrame:
    """(key, field_name): the texts that came out as more than one piece."""
    return split_oversized(texts, key, fields, **how).where("piece_no = 1 and n_pieces > 1").select(key, "field_name")
