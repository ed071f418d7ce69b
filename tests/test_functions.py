import datetime as dt
from urllib.parse import parse_qsl, urlencode, urlsplit, urlunsplit

import pytest
from pyspark.sql import functions as F

from corpusloom.functions import text as t
from corpusloom.functions import times, urls


def values(spark, rows, schema, column):
    return [r[0] for r in spark.createDataFrame([(*r, n) if isinstance(r, tuple) else (r, n) for n, r in enumerate(rows)], schema + ", n int").orderBy("n").select(column).collect()]


@pytest.mark.parametrize(
    ("given", "wanted"),
    [
        ("HTTPS://WWW.Manuals.Example/en_med_asthma.htm/?utm_source=test&b=2&a=1#section", "https://www.manuals.example/en_med_asthma.htm?a=1&b=2"),
        ("http://h", "http://h/"), ("http://h/", "http://h/"), ("http://H/a//", "http://h/a"), ("http://h/a;v=1?UTM_x=1", "http://h/a"), (None, None),
    ],
)
def test_canonical_url(spark, given, wanted):
    rows = spark.createDataFrame([(given,)], "u string")
    assert rows.select(urls.canonical_url(F.col("u")), urls.canonical_url_exact("u")).first()[:] == (wanted, wanted)


def test_exact_canonical_url_decodes(spark):
    u = "http://h/p?b=%7E+x&a=&a=%41"
    got = spark.createDataFrame([(u,)], "u string").select(urls.canonical_url_exact("u")).first()[0]
    s = urlsplit(u)
    assert got == urlunsplit((s.scheme, s.netloc, s.path, urlencode(sorted(parse_qsl(s.query, keep_blank_values=True))), ""))


def test_links(spark):
    rows = spark.createDataFrame([("../b.htm", "http://h/x/a.htm"), (None, "http://h"), ("http://[", "http://h")], "l string, p string")
    assert [r[0] for r in rows.select(urls.absolute_url("l", "p")).collect()] == ["http://h/b.htm", None, None]
    u = F.col("u")
    one = spark.createDataFrame([("https://u@H.example:80/en_med_x.htm?q=1",), ("ftp://h.example/cart",), (None,)], "u string")
    got = one.select(urls.host(u), urls.is_allowed(u, ["h.example"]), urls.is_allowed(u, ["h.example"], True), urls.is_detail(u), urls.is_mutating(F.lit(""), u)).collect()
    assert got[0][:] == ("h.example", True, True, True, False)
    assert got[1][:] == ("h.example", False, False, False, True)
    assert got[2][1] is False


def test_search_names(spark):
    got = values(spark, ["  Cardiac—Arrhythmia! ", "arrhythmia s", "Straße_Ä", "", None, "s", "virus es"], "x string", t.search_name(F.col("x")))
    assert got == ["cardiac arrhythmia", "arrhythmias", "strasse ä", "", None, "s", "viruses"]
    assert values(spark, ["Ａｂ　c"], "x string", t.search_name(t.nfkc(F.col("x")))) == ["ab c"]


@pytest.mark.parametrize(
    ("a", "b", "wanted"),
    [("Artery", "Arteries", True), ("Virus", "Viruses", True), ("Cardiac arrhythmia", "Cardiac arrhythmia s", True), ("Heart disease", "Cardiac disease", False), ("Day", "Days", True), ("", "", False), ("Fever", "fever", False)],
)
def test_plurals(spark, a, b, wanted):
    assert spark.createDataFrame([(a, b)], "a string, b string").select(t.is_plural_pair(F.col("a"), F.col("b"))).first()[0] is wanted


@pytest.mark.parametrize(
    ("q", "label", "wanted"),
    [("Angina pectoris", "Angina pectoris - Coronary artery disease", True), ("Angina", "Angina pectoris - Coronary artery disease", False), ("COVID", "COVID-19", False)],
)
def test_aliases(spark, q, label, wanted):
    assert spark.createDataFrame([(q, label)], "a string, b string").select(t.is_alias(F.col("a"), F.col("b"))).first()[0] is wanted


def test_markdown_texts(spark):
    got = values(spark, ["**a** [b](http://x) \\| `c`\n# d", None, ""], "x string", t.plain_text(F.col("x")))
    assert got == ["a b c d", None, ""]
    a, b = "# Café\r\n\r\n\r\nText   \r\n", "# Café\n\nText\n"
    hashes = values(spark, [a, b], "x string", t.content_hash(t.nfc(F.col("x"))))
    assert hashes[0] == hashes[1]


def test_guards(spark):
    assert values(spark, ["a <DIV>b", "a < b", None], "x string", t.holds_html(F.col("x"))) == [True, False, False]
    assert values(spark, ["k=abcd ab"], "x string", t.redact(F.col("x"), ["ab", "abcd", ""])) == ["k=[REDACTED] [REDACTED]"]
    m = spark.sql("select map('Token', 'x', 'a', 'y') as m").select(t.redact_map(F.col("m"))).first()[0]
    assert m == {"Token": "[REDACTED]", "a": "y"}
    assert values(spark, ["Ärger & Co.", "", None, "-"], "x string", t.slug(F.col("x"))) == ["arger-co", "disease", "disease", "disease"]
    assert values(spark, [("one two three Four five", "four")], "x string, y string", t.excerpt(F.col("x"), F.col("y"), 3, 1)) == ["three Four five"]


def test_instants(spark):
    base = dt.datetime(2025, 3, 20, 10, 0, tzinfo=dt.UTC).timestamp()
    same = ["2025-03-20T10:00:00Z", "2025-03-20 10:00:00", "2025-03-20T12:00:00.000000+02:00", "2025-03-20T15:30:00+0530", " 2025-03-20t05:00:00-05 ", str(int(base)), f"{base:.3f}", "2025-03-20T10:00"]
    assert set(values(spark, same, "x string", times.instant_micros(F.col("x")))) == {int(base) * 1_000_000}
    assert values(spark, ["n/a", "", None, "pending", "2025-13-01", "2025-02-30T00:00:00Z", "99999999999999"], "x string", times.instant_micros(F.col("x"))) == [None] * 7
    assert values(spark, ["2025-03-20"], "x string", times.instant_micros(F.col("x"))) == [(int(base) - 36000) * 1_000_000]
