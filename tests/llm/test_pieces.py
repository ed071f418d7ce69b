import time

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from corpusloom.llm.pieces import cut_places, oversized, split_oversized

TEXTS = {
    "sentences": "A short sentence stands here, so it can be cut. " * 900,
    "paragraphs": ("Some words of a paragraph. More of them follow.\r\n\r\n" * 30 + "## Heading\n\n") * 12,
    "words": "word " * 4000, "letters": "x" * 20_000, "accents": "é" * 9000, "kanji": "病気です。" * 3000,
    "lines": "\n" * 30_000, "families": "\U0001F468‍\U0001F469‍\U0001F467" * 3000,
}


def check(text, ends, limit, overlap):
    assert ends[-1] == len(text) and ends == sorted(set(ends))
    begin, whole = 0, ""
    for e in ends:
        assert e - begin <= limit
        whole += text[begin if not whole else begin + overlap : e]
        begin = max(0, e - overlap)
    assert whole == text


@pytest.mark.parametrize("name", TEXTS)
def test_pieces_lose_nothing(name):
    text = TEXTS[name]
    ends = cut_places(text)
    check(text, ends, 4000, 200)
    assert len(ends) <= 1.5 * (len(text) / 3800) + 2
    inner = ends[:-1]
    if name == "sentences":
        assert all(text[:e].endswith(". ") for e in inner)
    if name == "paragraphs":
        assert all(text[:e].endswith("\n\n") or text[:e].endswith("\r\n\r\n") for e in inner)
        assert not any(text[:e].endswith("## Heading\n\n") for e in inner)
    if name == "words":
        assert all(text[:e].endswith(" ") for e in inner)
    if name == "accents":
        assert all(text[e] == "e" for e in inner)
    if name == "kanji":
        assert all(text[e - 1] == "。" for e in inner)
    if name == "families":
        assert all(text[e] == "\U0001F468" for e in inner)


@settings(max_examples=150, deadline=None)
@given(st.text(alphabet="ab .\n\r,́。#|", max_size=600), st.integers(10, 80), st.integers(0, 9))
def test_any_text(text, limit, overlap):
    check(text, cut_places(text, limit, overlap), limit, overlap)


def every_boundary(text):
    """What a cut at each place costs, words and clauses included, and places within words."""
    from corpusloom.llm import pieces as p

    costs = dict.fromkeys(range(1, len(text)), p.COSTS[p.CHARACTER])
    costs |= {m.end(): p.COSTS[p.WORD] for m in p.WORDS.finditer(text)}
    costs |= {m.end(): p.COSTS[p.CLAUSE] for m in p.CLAUSES.finditer(text) if m.end() < len(text)}
    return costs | p.boundaries(text)


def cost(ends, costs, n, limit, overlap):
    from corpusloom.llm import pieces as p

    ideal = (n - overlap) / max(1, -(-(n - overlap) // (limit - overlap)))
    total, begin = 0.0, overlap
    for e in ends:
        total += p.BALANCE * ((e - begin) / ideal - 1) ** 2 + p.PIECE + (costs[e] if e < n else 0.0)
        begin = e
    return total


def least_cost(text, limit, overlap):
    """The least cost over all places, by trying every last piece of every prefix."""
    from corpusloom.llm import pieces as p

    n, costs = len(text), every_boundary(text)
    ideal = (n - overlap) / max(1, -(-(n - overlap) // (limit - overlap)))
    best = {overlap: 0.0}
    for e in range(overlap + 1, n + 1):
        before = [b for b in best if 0 < e - b <= limit - overlap]
        if before:
            own = p.PIECE + (costs[e] if e < n else 0.0)
            best[e] = min(best[b] + p.BALANCE * ((e - b) / ideal - 1) ** 2 for b in before) + own
    return best[n]


@settings(max_examples=60, deadline=None)
@given(st.lists(st.sampled_from(["aa", "bbbb. ", "c, ", "dd ", "e", "\n", "\n\n", "# f\n", "gg! "]), min_size=60, max_size=140), st.integers(60, 90), st.integers(0, 9))
def test_cost_is_least(parts, limit, overlap):
    """All boundaries have a part in it, not only those that the operator looks at (pieces here are
    shorter than GRID, so that it may cut at any cluster)."""
    text = "".join(parts)
    if len(text) > limit:
        ends = cut_places(text, limit, overlap)
        check(text, ends, limit, overlap)
        assert cost(ends, every_boundary(text), len(text), limit, overlap) <= least_cost(text, limit, overlap) + 1e-6


@pytest.mark.parametrize("run", [" ", "\t", "\n", " \n", ".", "# ", "a\n", ",", '."', "x"])
def test_time_is_linear(run):
    for text in ("a" * 4001 + run * (1_000_000 if len(run) == 1 else 100_000), run * (1_000_000 if len(run) == 1 else 100_000) + "a. " * 2000):
        begun = time.process_time()
        check(text, cut_places(text), 4000, 200)
        assert time.process_time() - begun < (20 if run == "a\n" else 5)


def test_table(spark):
    rows = spark.createDataFrame(
        [(1, "a" * 4000, None, "x"), (2, "b. " * 2000, "", "y"), (2, "b. " * 2000, "", "y"), (None, "c", "d" * 4001, "z")],
        "content_id bigint, markdown string, plain_text string, piece string",
    )
    got = split_oversized(rows, "content_id", ["markdown", "plain_text"]).collect()
    assert sum(r["content_id"] == 2 and r["field_name"] == "markdown" for r in got) == 4
    assert sum(r["piece"] == "" for r in got) == 2 and len(got) == 1 + 4 + 2 + 1 + 2
    found = sorted((tuple(r) for r in oversized(rows, "content_id", ["markdown", "plain_text"]).collect()), key=str)
    assert found == [(2, "markdown"), (2, "markdown"), (None, "plain_text")]
    assert split_oversized(rows.limit(0), "content_id", ["markdown"]).count() == 0
    with pytest.raises(ValueError):
        split_oversized(rows, "content_id", ["markdown"], 10, 10)
