import random

import pytest
import tiktoken
from hypothesis import given, settings
from hypothesis import strategies as st

from corpusloom.llm.bpe import PATTERN, TOKENIZERS, BytePairEncoder, SegmentTree, token_counts, token_ids

PATH = f"{TOKENIZERS}/byte_bpe_50k.tiktoken"


@pytest.fixture(scope="module")
def encoder():
    with open(PATH, "rb") as f:
        return BytePairEncoder(f.read())


@pytest.fixture(scope="module")
def other(encoder):
    return tiktoken.Encoding("own", pat_str=PATTERN, mergeable_ranks=encoder.rank, special_tokens={})


@settings(max_examples=400, deadline=None)
@given(st.text(max_size=80))
def test_any_text(encoder, other, text):
    assert encoder.encode(text) == other.encode_ordinary(text)


@pytest.mark.parametrize("text", ["a" * 30_000, "\n" * 5000, " " * 5000 + "x", "<|endoftext|>", "'ll'LL\x1c\x85　 1१", "naïve \U0001F600" * 999, "\x00\x01"])
def test_texts(encoder, other, text):
    assert encoder.encode(text) == other.encode_ordinary(text)


def test_joins_the_leftmost_of_equal_rank():
    import base64

    lines = b"\n".join(base64.b64encode(t) + b" %d" % i for i, t in enumerate([b"a", b"b", b"aa", b"ab"]))
    assert BytePairEncoder(lines).merge(b"aaab") == [2, 3]


def test_segment_tree():
    random.seed(2)
    for n in (1, 2, 7, 64):
        values = [random.randint(0, 9) * n + i for i in range(n)]
        tree = SegmentTree(list(values))
        for _ in range(200):
            i = random.randrange(n)
            values[i] = random.randint(0, 9) * n + i
            tree.set(i, values[i])
            assert tree.node[1] == min(values)


def test_table(spark, other):
    long = "Ein sehr langer Text, ähnlich wie dieser. " * 20_000
    data = [(1, "Hello world", "x"), (2, "", "x"), (3, None, "x"), (4, "  \n", "x"), (1, "Hello world", "x"), (None, long, "y")]
    frame = spark.createDataFrame(data, "doc_id bigint, text string, source string").selectExpr("*", "0 AS key", "1 AS ids", "2 AS __text2")
    got = sorted(((r["doc_id"], list(r["ids"])) for r in token_ids(frame).collect()), key=str)
    assert got == sorted(((d, other.encode_ordinary(t) if t else []) for d, t, _ in data), key=str)
    counts = sorted(((r["doc_id"], r["n_tokens"]) for r in token_counts(frame, ["doc_id", "source"]).collect()), key=str)
    assert counts == sorted(((d, len(i)) for d, i in got), key=str)
    assert token_ids(frame.limit(0)).count() == 0
