"""Text functions, Column -> Column, inside whole-stage code generation unless said otherwise."""

from __future__ import annotations

import unicodedata

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

PLURAL_ES = r"(s|x|z|ch|sh)$"
ICD = r"^[A-Z]\d[\dA-Z.]*$"
#: Text that must not appear in stored content, and keys that hold secrets.
HTML_MARKERS = (
    r"(?i)<!doctype|<\s*/?\s*(?:html|head|body|script|style|form|iframe|input|button|nav|footer|header|aside|article|div|"
    r"span|p|h[1-6]|table|tr|t[dh]|ul|ol|li|a)\b"
)
HTML_KEYS = ("raw_html", "html", "content_html", "clean_html", "dom", "page_source")
SECRET_KEYS = ("password", "passwd", "secret", "token", "api_key", "authorization", "cookie", "username")


def _normalised(form: str):
    @F.pandas_udf(StringType())
    def run(texts: pd.Series) -> pd.Series:
        return texts.map(lambda t: t if t is None or t.isascii() else unicodedata.normalize(form, t))

    return run


def nfc(text: Column) -> Column:
    """Composed form; an Arrow function, as Spark has none."""
    return _normalised("NFC")(text)


def nfkc(text: Column) -> Column:
    """Compatibility form; an Arrow function, as Spark has none."""
    return _normalised("NFKC")(text)


def fold(text: Column) -> Column:
    """Letters without case. Besides sharp s, full case folding is not followed."""
    return F.replace(F.lower(text), F.lit("ß"), F.lit("ss"))


def collapse(text: Column) -> Column:
    """White space of any kind becomes one space; none is left at the ends."""
    return F.trim(F.regexp_replace(text, r"(?U)\s+", " "))


def plain_text(markdown: Column) -> Column:
    """Markdown without links' targets and marks, on one line."""
    pipes = F.replace(markdown, F.lit("\\|"), F.lit("|"))
    labels = F.regexp_replace(pipes, r"\[([^\]]+)\]\([^)]+\)", "$1")
    return collapse(F.regexp_replace(labels, r"[*_`#>|]", ""))


def ground_text(markdown: Column) -> Column:
    """The form in which values and sources are compared."""
    return fold(plain_text(F.replace(markdown, F.lit("<br>"), F.lit(" "))))


def search_name(text: Column) -> Column:
    """Words of a name, without case and punctuation; a cut-off plural ending joins its word."""
    words = F.trim(F.regexp_replace(fold(text), r"(?U)[\W_]+", " "))
    return F.regexp_replace(words, r"(\S) (e?s)$", "$1$2")


def name_identity(text: Column) -> Column:
    """Runs of ASCII letters and digits only."""
    return F.array_join(F.regexp_extract_all(fold(text), F.lit(r"([a-z0-9]+)"), 1), " ")


def audit_name(text: Column) -> Column:
    """One line, without case and without marks at the ends."""
    return F.btrim(collapse(fold(text)), F.lit(" .,;:"))


def label_parts(label: Column) -> Column:
    """Parts of a label between spaced hyphens; the last is the main name, the others aliases."""
    return F.filter(F.transform(F.split(label, r"(?U)\s+-\s+"), collapse), lambda x: x != "")


def is_alias(query: Column, label: Column) -> Column:
    """Whether the query is one of the label's aliases."""
    parts = label_parts(label)
    before = F.slice(parts, 1, F.greatest(F.size(parts) - 1, F.lit(0)))
    return F.exists(before, lambda x: search_name(x) == search_name(query))


def plural_of(word: Column) -> Column:
    return (
        F.when(word.rlike(r"[^aeiou]y$"), F.regexp_replace(word, "y$", "ies"))
        .when(word.rlike(PLURAL_ES), F.concat(word, F.lit("es")))
        .otherwise(F.concat(word, F.lit("s")))
    )


def is_plural_pair(left: Column, right: Column) -> Column:
    """Whether two names are equal but for the number of their last word."""
    a, b = search_name(left), search_name(right)
    head = lambda x: F.regexp_replace(x, r"\S+$", "")
    last = lambda x: F.regexp_extract(x, r"(\S+)$", 1)
    differ = (last(a) != "") & (last(b) != "") & (head(a) == head(b)) & (last(a) != last(b))
    return differ & ((plural_of(last(a)) == last(b)) | (plural_of(last(b)) == last(a)))


def overlaps(left: Column, right: Column) -> Column:
    """Whether the words of one name are a run of words of the other."""
    a, b = search_name(left), search_name(right)
    padded = lambda x: F.concat(F.lit(" "), x, F.lit(" "))
    return (a != "") & (b != "") & (padded(a).contains(padded(b)) | padded(b).contains(padded(a)))


def slug(text: Column, length: int = 60, default: str = "disease") -> Column:
    """A name for folders; accented Latin letters lose their accents."""
    accented = "àáâãäåçèéêëìíîïñòóôõöùúûüýÿ"
    ascii_ = "aaaaaaceeeeiiiinooooouuuuyy"
    plain = F.translate(F.lower(text), accented, ascii_)
    name = F.btrim(F.regexp_replace(plain, "[^a-z0-9]+", "-"), F.lit("-"))
    cut = F.rtrim(F.substring(name, 1, length), F.lit("-"))
    return F.when(F.coalesce(cut, F.lit("")) == "", default).otherwise(cut)


def holds_html(text: Column) -> Column:
    return F.coalesce(text.rlike(HTML_MARKERS), F.lit(False))


def redact(text: Column, secrets: list[str]) -> Column:
    """Every secret replaced, the longest first."""
    for s in sorted(filter(None, secrets), key=len, reverse=True):
        text = F.replace(text, F.lit(s), F.lit("[REDACTED]"))
    return text


def redact_map(values: Column) -> Column:
    """A map whose secret keys lose their values."""
    return F.transform_values(values, lambda k, v: F.when(F.lower(k).isin(*SECRET_KEYS), "[REDACTED]").otherwise(v))


def joined_highlight(label: Column) -> Column:
    """A label whose plural ending was split off by highlighting, as in ``arrhythmia s``."""
    return F.regexp_replace(collapse(label), r"(\w) (e?s)$", "$1$2")


def normal_markdown(markdown: Column) -> Column:
    """Line ends, trailing spaces and runs of blank lines made uniform; ends with one line end.

    Composed form is not part of it: apply ``nfc`` before where texts may need it.
    """
    lines = F.regexp_replace(markdown, r"\r\n?", "\n")
    clean = F.regexp_replace(F.regexp_replace(lines, r"(?U)(?:(?!\n)\s)+(?=\n|\z)", ""), r"\n{3,}", "\n\n")
    return F.concat(F.regexp_replace(clean, r"(?U)\A\s+|\s+\z", ""), F.lit("\n"))


def content_hash(markdown: Column) -> Column:
    return F.sha2(normal_markdown(markdown), 256)


def excerpt(text: Column, needle: Column, words: int = 15, lead: int = 3) -> Column:
    """At most ``words`` words of a text around the first place of the needle, else null."""
    at = F.position(F.lower(needle), F.lower(text))
    before = F.size(F.filter(F.split(F.substr(text, F.lit(1), at - 1), r"\s+"), lambda x: x != ""))
    every = F.filter(F.split(text, r"\s+"), lambda x: x != "")
    start = F.greatest(before - lead, F.lit(0)) + 1
    return F.when(at > 0, F.array_join(F.slice(every, start, F.lit(words)), " "))


def without_nulls(values: Column) -> Column:
    return F.filter(values, lambda x: x.isNotNull())
