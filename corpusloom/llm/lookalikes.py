"""One consistent form for text that looks the same, by a transducer over grapheme clusters."""

from __future__ import annotations

import itertools
import unicodedata
from collections.abc import Iterator
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from corpusloom.runtime import cut, map_batches

#: Letters of other scripts whose shape is that of a Latin letter. Letters that
#: only resemble one, such as alpha or beta, are not here: a reader tells them apart.
LATIN_SHAPES = {
    "cyrillic": ("аеорсухѕіјһԁԛԝӏАВЕЅІЈКМНОРСТУХԌԚԜҮӀ", "aeopcyxsijhdqwlABESIJKMHOPCTYXGQWYI"),
    "greek": ("οϲϳνΑΒΕΖΗΙΚΜΝΟΡΤΥΧϹϿ", "ocjvABEZHIKMNOPTYXCƆ"),
    "armenian": ("օսհԼՍՕ", "ouhLUO"),
}
#: Hyphens of the shape of hyphen-minus; the micro sign is Greek mu.
SAME_SHAPES = {"‐": "-", "‑": "-", "µ": "μ"}
#: Parts of Unicode's compatibility mappings that keep the look.
WIDTHS = ("<wide>", "<narrow>")
JOINED = ("<compat>", "<initial>", "<medial>", "<final>", "<isolated>")
VISIBLE_SPACES = chr(0x1680)
JAMO = "".join(f"{chr(a)}-{chr(b)}" for a, b in ((0x1100, 0x11FF), (0xA960, 0xA97F), (0xD7B0, 0xD7FF)))
KEPT_CONTROLS = "\t\n\v\f\r\x1c\x1d\x1e\x1f\x85"


def _codepoints() -> Iterator[str]:
    return map(chr, itertools.chain(range(0xD800), range(0xE000, 0x20000), range(0xE0000, 0xE1000)))


@lru_cache(1)
def look_rules() -> dict[str, str]:
    """What each single character becomes; characters without a rule stay.

    Invisible characters become nothing, all kinds of single space a space, full and half
    widths the ordinary form, joined letters and Roman numerals their letters, look-alikes
    of other scripts the Latin letter, all in composed form. Raised, lowered, circled and
    styled characters keep their form, as do accents and letter case.
    """
    import regex

    unseen = regex.compile(r"\p{Default_Ignorable_Code_Point}")
    shapes = dict(SAME_SHAPES)
    for given, latin in LATIN_SHAPES.values():
        if len(given) != len(latin):
            raise ValueError("look-alikes don't pair up")
        for a, b in zip(given, latin, strict=True):
            if shapes.setdefault(a, b) != b:
                raise ValueError(f"conflicting rules for {a!r}")

    def same(c: str) -> str:
        tag, *parts = unicodedata.decomposition(c).split() or [""]
        if tag in WIDTHS:
            return "".join(map(same, map(lambda x: chr(int(x, 16)), parts)))
        if tag in JOINED:
            plain = unicodedata.normalize("NFKD", c)
            letters = all(unicodedata.category(x)[0] in "LM" for x in plain)
            if letters and (unicodedata.category(c) == "Nl" or tag != "<compat>" or len(plain) > 1 and c not in "ẚŉ"):
                return plain
        if c in shapes:
            return shapes[c]
        apart = unicodedata.normalize("NFD", c)
        return c if apart == c else "".join(map(same, apart))

    rules: dict[str, str] = {}
    for c in _codepoints():
        kind = unicodedata.category(c)
        if unseen.match(c) or kind == "Cc" and c not in KEPT_CONTROLS:
            rules[c] = ""
        elif kind == "Zs" and c not in VISIBLE_SPACES:
            if c != " ":
                rules[c] = " "
        elif (to := unicodedata.normalize("NFC", same(c))) != c:
            rules[c] = to
    for c, to in rules.items():  # one pass must be enough, whatever the order
        again = unicodedata.normalize("NFC", "".join(rules.get(x, x) for x in to))
        if again != to:
            raise ValueError(f"the rule of {c!r} meets another rule: {to!r} becomes {again!r}")
    return rules


class Transducer:
    """Longest match over a trie of rules, cluster by cluster, each text in one pass.

    The trie holds the single rules and every sequence of a base and its combining marks,
    in any order of marks that do not interact, that Unicode composes to one character.
    """

    def __init__(self) -> None:
        import regex

        self.rules = look_rules()
        self.root: dict = {}
        composed = [c for c in _codepoints() if unicodedata.decomposition(c)[:1] not in ("", "<")]
        for c in composed:
            apart = unicodedata.normalize("NFD", c)
            to = unicodedata.normalize("NFC", "".join(self.rules.get(x, x) for x in apart))
            for marks in itertools.permutations(apart[1:]) if len(apart) < 5 else [apart[1:]]:
                spelt = apart[0] + "".join(marks)
                if unicodedata.normalize("NFC", spelt) == unicodedata.normalize("NFC", c):
                    self._add(spelt, to)
                    if unicodedata.normalize("NFC", spelt[:2]) != spelt[:2]:
                        self._add(unicodedata.normalize("NFC", spelt[:2]) + spelt[2:], to)
        for c, to in self.rules.items():
            self._add(c, to)
        ignored = "".join(sorted(f"\\U{ord(c):08x}" for c, to in self.rules.items() if not to))
        ignored += chr(0xFF9E) + chr(0xFF9F)  # half-width voicing marks belong to the letter before
        plain = r"\x09-\x0d\x1c-\x7e"
        # runs beyond plain ASCII, with the character before, that a mark may belong to
        self.run = regex.compile(rf"[{plain}]?[^{plain}]+")
        self.cluster = regex.compile(rf"[{JAMO}]+|.[\p{{M}}{ignored}]*", regex.DOTALL)
        self.kept: dict[str, str] = {}

    def _add(self, spelt: str, to: str) -> None:
        node = self.root
        for c in spelt:
            node = node.setdefault(c, {})
        if node.setdefault("", to) != to:
            raise ValueError(f"conflicting rules for {spelt!r}: {node['']!r} and {to!r}")

    def _one(self, found) -> str:
        out = []
        for cluster in self.cluster.findall(found.group()):
            to = self.kept.get(cluster)
            if to is None:
                if len(self.kept) > 100_000:
                    self.kept.clear()
                to = self.kept[cluster] = self._walk(cluster)
            out.append(to)
        return "".join(out)

    def _walk(self, cluster: str) -> str:
        # invisible characters do not part a base from its marks
        seen = "".join(c for c in cluster if self.rules.get(c) != "")
        out, at = [], 0
        while at < len(seen):
            node, end, to = self.root, at + 1, seen[at]
            for i in range(at, len(seen)):
                node = node.get(seen[i])
                if node is None:
                    break
                if "" in node:
                    end, to = i + 1, node[""]
            out.append(to)
            at = end
        return unicodedata.normalize("NFC", "".join(out))  # marks beyond any composed character

    def __call__(self, text: str) -> str:
        return self.run.sub(self._one, text)


@lru_cache(1)
def transducer() -> Transducer:
    return Transducer()


def consistent_form(values: DataFrame, column: str, to: str = "form") -> DataFrame:
    """``values`` with ``to``: the consistent form of the text ``column``; null stays null.

    Forms are equal just when the texts look the same. Empty texts stay empty; every row
    stays, repeated ones too. ``to`` replaces a column of that name.
    """
    kept = [c for c in values.columns if c != to]
    source = values.select(*kept)
    at = kept.index(column)
    shape = StructType([*source.schema.fields]).add(to, "string")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        change = transducer()
        for batch in batches:
            form = [None if t is None else change(t) for t in batch.column(at).to_pylist()]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(form, pa.string())], names=[*kept, to])

    return map_batches(source, run, shape)


def lookalike_pairs(values: DataFrame) -> DataFrame:
    """(field_name, key_a, key_b), key_a < key_b: rows of a field that hold values which look
    the same but differ, of ``values`` (field_name, key, value).

    Null values pair with nothing. A pair comes once, however many values of its rows match.
    Values that nothing else looks like leave before the join; the others are joined by
    128-bit digests, so that no text is shuffled, and identical copies are never paired.
    Forms are made once and kept in the shared folder, as two steps need them.
    """
    forms = consistent_form(values.where(F.col("value").isNotNull()).select("field_name", "key", "value"), "value")
    spelt = cut(
        forms.select("field_name", "key", F.unhex(F.md5("form")).alias("form"), F.unhex(F.md5("value")).alias("value"))
    )
    mixed = (
        spelt.groupBy("field_name", "form").agg(F.min("value").alias("lo"), F.max("value").alias("hi")).where("lo <> hi")
    )
    left = spelt.join(mixed.select("field_name", "form"), ["field_name", "form"], "left_semi")
    a, b = left.alias("a"), left.alias("b")
    return (
        a.join(
            b,
            (F.col("a.field_name") == F.col("b.field_name"))
            & (F.col("a.form") == F.col("b.form"))
            & (F.col("a.value") != F.col("b.value"))
            & (F.col("a.key") < F.col("b.key")),
        )
        .select("a.field_name", F.col("a.key").alias("key_a"), F.col("b.key").alias("key_b"))
        .distinct()
    )


def text_values(documents: DataFrame, candidates: DataFrame) -> DataFrame:
    """(field_name, key, value) of labels, aliases and summaries."""
    label = candidates.select(F.lit("label").alias("field_name"), F.col("candidate_id").alias("key"), F.col("label").alias("value"))
    alias = documents.select(F.lit("alias"), "document_no", F.explode("aliases"))
    summary = documents.select(F.lit("summary"), "document_no", "summary")
    return label.union(alias).union(summary)
