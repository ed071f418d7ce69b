import itertools
import random
import unicodedata

import pytest

from corpusloom.llm.lookalikes import consistent_form, look_rules, lookalike_pairs, transducer

SAME = [
    ("Ｆｅver　2", "Fever 2"), ("é", "\xe9"), ("ệ", "ệ"), ("Å", "Å"), ("ﬁx", "fix"), ("Ⅱ", "II"),
    ("a​́b", "\xe1b"), ("x\xa0y", "x y"), ("соr", "cor"), ("ё", "\xeb"), ("‐", "-"), ("\xb5", "μ"), ("ĳ", "ij"),
    ("한", "한"), ("\xad⁠﻿", ""), ("K", "K"), ("－", "-"), ("ｶﾞ", "ガ"),
]
APART = [("A", "a"), ("e", "\xe9"), ("2", "\xb2"), ("2", "₂"), ("2", "②"), ("a-b", "ab"), ("α", "a"), ("ss", "\xdf"), ("a  b", "a b"), ("o", "0")]


@pytest.mark.parametrize(("a", "b"), SAME)
def test_same(a, b):
    assert transducer()(a) == transducer()(b)


@pytest.mark.parametrize(("a", "b"), APART)
def test_apart(a, b):
    assert transducer()(a) != transducer()(b)


def test_one_pass_is_enough():
    change = transducer()
    random.seed(3)
    letters = [*look_rules(), *map(chr, range(0x300, 0x330)), *"abcxyz -"]
    for _ in range(3000):
        text = "".join(random.choices(letters, k=random.randint(1, 12)))
        once = change(text)
        assert change(once) == once
        assert change(unicodedata.normalize("NFD", text)) == change(unicodedata.normalize("NFC", text))


def test_trie_equals_rules_and_composition():
    change, rules = transducer(), look_rules()
    random.seed(5)
    for c in random.sample([chr(x) for x in range(0x80, 0x2FFF)], 2500):
        if unicodedata.category(c)[0] == "M":
            continue
        for marks in ("", "́", "̣̂"):
            want = unicodedata.normalize("NFC", "".join(rules.get(x, x) for x in unicodedata.normalize("NFC", c + marks)))
            assert change(c + marks) == want, (hex(ord(c)), marks)


def test_pairs_against_brute_force(spark):
    random.seed(1)
    spellings = [x for pair in SAME[:8] for x in pair] + ["plain", "other", "", None]
    rows = [(random.choice(["label", "alias"]), n // 2, random.choice(spellings)) for n in range(160)]
    rows += [("label", 900 + n, "\xe9") for n in range(60)]  # a large group of copies
    want, change = set(), transducer()
    for (f, k, v), (g, m, w) in itertools.product(rows, rows):
        if f == g and k < m and v is not None and w is not None and v != w and change(v) == change(w):
            want.add((f, k, m))
    frame = spark.createDataFrame(rows, "field_name string, key bigint, value string").selectExpr("*", "1 AS form", "2 AS lo")
    got = [tuple(r) for r in lookalike_pairs(frame).collect()]
    assert len(got) == len(set(got)) and set(got) == want
    assert lookalike_pairs(frame.limit(0)).count() == 0


def test_form_column(spark):
    rows = spark.createDataFrame([(1, "Ａ", "old"), (2, None, "old"), (3, "", "old"), (1, "Ａ", "old")], "k int, v string, form string")
    assert [r["form"] for r in consistent_form(rows, "v").orderBy("k").collect()] == ["A", "A", None, ""]
    long = spark.createDataFrame([("ａé" * 200_000,)], "v string")
    assert consistent_form(long, "v").first()["form"] == "a\xe9" * 200_000
