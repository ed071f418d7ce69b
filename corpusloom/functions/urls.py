"""Addresses and identities made of them."""

from __future__ import annotations

from urllib.parse import parse_qsl, urlencode, urljoin

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

PARTS = r"^(?:([A-Za-z][A-Za-z0-9+.\-]*):)?(?://([^/?#]*))?([^?#]*)(?:\?([^#]*))?(?:#.*)?$"
#: What tells a page of one disease, and what links must not be followed.
DETAIL = r"(?i)(/([a-z]{2}_)?(med|medical|disease)_[^/?#]+\.html?|/diseases?/[^/?#]+/?)$"
MUTATING_LABELS = ("+", "edit", "edit note")
MUTATING_PATHS = r"(?i)edit|cart|delete|logout"


def part(url: Column, n: int) -> Column:
    """1 scheme, 2 authority, 3 path, 4 query."""
    return F.regexp_extract(url, PARTS, n)


def canonical_url(url: Column) -> Column:
    """Scheme and host in lower case, no ending slashes, parameters, fragment or tracking; the query's
    pairs decoded, sorted by key and value, and encoded again. Null stays null.

    Escapes that are no UTF-8 decode to the replacement character.
    """
    path = F.regexp_replace(part(url, 3), r";[^/]*$", "")
    path = F.when(path.isin("", "/"), "/").otherwise(F.rtrim(path, F.lit("/")))
    decoded = lambda x: F.coalesce(F.try_url_decode(x), x)

    def pair(x: Column) -> Column:
        given = F.split(x, "=", 2)
        return F.struct(decoded(given[0]).alias("k"), decoded(F.coalesce(F.get(given, F.lit(1)), F.lit(""))).alias("v"))

    pairs = F.transform(F.filter(F.split(part(url, 4), "&"), lambda x: x != ""), pair)
    kept = F.array_sort(F.filter(pairs, lambda p: ~F.lower(p["k"]).startswith("utm_")))
    # '*' is the one mark that the two encoders treat differently, '~' the other
    encoded = lambda x: F.replace(F.replace(F.url_encode(x), F.lit("*"), F.lit("%2A")), F.lit("%7E"), F.lit("~"))
    query = F.array_join(F.transform(kept, lambda p: F.concat(encoded(p["k"]), F.lit("="), encoded(p["v"]))), "&")
    head = F.concat(F.lower(part(url, 1)), F.lit("://"), F.lower(part(url, 2)), path)
    return F.when(query == "", head).otherwise(F.concat(head, F.lit("?"), query))


def canonical_text(url: str) -> str:
    """``canonical_url`` of one address, for code that holds it as text."""
    head, _, rest = url.partition("://")
    rest = rest.partition("#")[0]
    rest, _, query = rest.partition("?")
    host_name, slash, path = rest.partition("/")
    folder, _, last = path.rpartition("/")
    path = (f"{folder}/" if "/" in path else "") + last.partition(";")[0]
    pairs = sorted(p for p in parse_qsl(query, keep_blank_values=True) if not p[0].lower().startswith("utm_"))
    return f"{head.lower()}://{host_name.lower()}/{path}".rstrip("/") + ("" if path.strip("/") else "/") + (f"?{urlencode(pairs)}" if pairs else "")


@F.pandas_udf(StringType())
def absolute_url(links: pd.Series, pages: pd.Series) -> pd.Series:
    """Links resolved against their page; what cannot be resolved is null."""

    def one(link, page):
        try:
            return None if link is None or page is None else urljoin(page, link)
        except ValueError:
            return None

    return pd.Series([one(a, b) for a, b in zip(links, pages, strict=True)], dtype=object)


def host(url: Column) -> Column:
    return F.regexp_replace(F.lower(part(url, 2)), r"^.*@|:\d+$", "")


def is_allowed(url: Column, hosts: list[str], secure: bool = False) -> Column:
    schemes = ["https"] if secure else ["http", "https"]
    return F.coalesce(F.lower(part(url, 1)).isin(*schemes) & host(url).isin(*hosts), F.lit(False))


def is_mutating(label: Column, url: Column) -> Column:
    """Whether a link changes something."""
    said = F.lower(F.trim(F.coalesce(label, F.lit(""))))
    return said.isin(*MUTATING_LABELS) | part(url, 3).rlike(MUTATING_PATHS)


def is_detail(url: Column) -> Column:
    return F.regexp_replace(url, r"[?#].*$", "").rlike(DETAIL)


def item_id(plugin: Column, canonical: Column) -> Column:
    return F.sha2(F.concat(plugin, F.lit("\n"), canonical), 256)


def candidate_id(page: Column, candidate: Column) -> Column:
    return F.concat(F.lit("candidate-"), F.substring(F.sha2(F.concat(page, F.lit("\n"), candidate), 256), 1, 20))


def fingerprint(url: Column, kind: Column, text: Column) -> Column:
    """The same for pages that differ only in letter case and white space."""
    words = F.trim(F.regexp_replace(F.lower(F.coalesce(text, F.lit(""))), r"(?U)\s+", " "))
    return F.sha2(F.concat_ws("\n", url, kind, words), 256)


#: Words that make a link no content, or likely content.
NO_CONTENT = (
    "calculator", "copyright", "financial", "history", "hobbies", "imprint", "logout", "occupation", "privacy",
    "questionnaire", "rating-sheet", "travel", "user-settings",
)
CONTENT = ("disease", "diseases", "medical", "medicine", "conditions")


def candidate_score(url: Column, label: Column) -> Column:
    """How promising a link is, 0 to 95: language pages and plain pages before words of content."""
    path = F.lower(part(url, 3))
    said = F.concat(path, F.lit(" "), F.lower(F.coalesce(label, F.lit(""))))
    has = lambda words: F.exists(F.array(*[F.lit(w) for w in words]), lambda w: F.instr(said, w) > 0)
    page = path.rlike(r"/(en_)?[^/]+\.html?$")
    return (
        F.when(url.isNull() | has(NO_CONTENT) | url.rlike(r"[?#]."), 0)
        .when(page & path.startswith("/en_"), 95).when(page, 88).when(path.startswith("/en_"), 92).when(has(CONTENT), 72).otherwise(0)
    )
