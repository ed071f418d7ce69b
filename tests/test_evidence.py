from pyspark.sql import functions as F

from corpusloom.functions import arrays
from corpusloom.operators import evidence


def test_quotes(spark):
    src = spark.createDataFrame([(1, "Rest and **fluids** help.")], "k int, s string")
    d = spark.createDataFrame([(1, "fluids help", None), (1, "Drink!", "rest and"), (1, "x", "y"), (1, None, ""), (2, "rest", "rest")], "k int, v string, q string")
    got = {(r["support"], r["v"]) for r in evidence.quoted_values(d, src, "k", "v", "q", "s").collect()}
    assert got == {("exact", "fluids help"), ("quote", "rest and"), ("not_found", None)}


def test_merge(spark):
    rows = spark.createDataFrame([(["Heart Failure"], ["failure", "cough"]), (None, ["a"]), (["a"], None)], "a array<string>, b array<string>")
    assert [r[0] for r in rows.select(evidence.merged_with_source(F.col("a"), F.col("b"))).collect()] == [["Heart Failure", "cough"], ["a"], ["a"]]


def test_tables_kept(spark):
    schema = "k int, table_no int, row_no int, cells string"
    src = spark.createDataFrame([(1, 0, 0, "A b"), (1, 0, 1, "c"), (1, 1, 0, "z")], schema)
    clean = spark.createDataFrame([(1, 5, 0, "ab"), (1, 5, 1, "C"), (1, 6, 0, "other")], schema)
    assert evidence.tables_kept(src, clean, "k").first()[:] == (1, 2, 1)


def test_reuse(spark):
    items = spark.createDataFrame([("a", "1", True), ("b", "1", False), ("c", "2", True)], "k string, v string, unchanged boolean")
    known = spark.createDataFrame([("a", "1"), ("b", "1"), ("c", "1")], "k string, v string")
    keep, again = evidence.reusable(items, known, "k", ["v"])
    assert [r["k"] for r in keep.collect()] == ["a"] and sorted(r["k"] for r in again.collect()) == ["b", "c"]


def test_decisions(spark):
    offered = spark.createDataFrame([("p", "c1"), ("p", "c2")], "page string, candidate_id string")
    made = spark.createDataFrame([("p", "c2", 1), ("p", "c9", 2), ("q", None, 3)], "page string, chosen string, decided_at int")
    got = {(r["chosen"], r["is_valid"], r["place"]) for r in evidence.decisions_in_order(offered, made, ["page"]).collect()}
    assert got == {("c2", True, 1), ("c9", False, 2), (None, True, 1)}


def test_page_kinds(spark):
    rows = spark.createDataFrame(
        [("x", 0, 0, False, True), ("Access denied", 9, 0, False, False), ("symptoms " * 60, 9, 0, True, False), ("x", 9, 4, False, False), ("x", 9, 0, False, False), (None, 0, 0, False, False)],
        "t string, l int, d int, u boolean, p boolean",
    )
    kinds = rows.select(evidence.page_kind(*[F.col(c) for c in "tldup"]).alias("k")).select("k.*").collect()
    assert [r["kind"] for r in kinds] == ["login", "blocked", "detail", "list", "menu", "unknown"]
    assert kinds[3]["confidence"] == 0.9


def test_arrays(spark):
    row = spark.sql("select '[\"a\"]' j, 'x' bad, map('a','1','b','2') now, map('b','3','c',cast(null as string)) past, map('x',true,'y',cast(null as boolean)) checks, array('missing:a','b') w, ' 7 ' h, '-3' neg")
    c = F.col
    got = row.select(
        arrays.decoded_list(c("j")), arrays.decoded_list(c("bad")), arrays.changed_keys(c("now"), c("past")), arrays.changed_keys(F.lit(None).cast("map<string,string>"), c("now")),
        arrays.all_hold(c("checks")), arrays.after_prefix(c("w"), "missing:"), arrays.retry_after_seconds(c("h")), arrays.retry_after_seconds(c("neg")),
        arrays.retry_after_seconds(c("bad")), arrays.lacking(c("w"), F.lit(None).cast("array<string>")),
    ).first()
    assert got[:] == (["a"], [], ["a", "b"], ["a", "b"], False, ["a"], 7.0, 0.0, None, ["b", "missing:a"])
    kinds = spark.createDataFrame([(200,), (401,), (404,), (429,), (503,), (None,)], "s int").select(arrays.kind_of_status(c("s")))
    assert [r[0] for r in kinds.collect()] == ["ok", "auth", "request", "rate_limit", "server", "unknown"]


def test_map_digest_ignores_order(spark):
    r = spark.sql("select map('a','1','b',cast(null as string)) x, map('b',cast(null as string),'a','1') y, map('a','1','b','') z").select(*[arrays.map_digest(F.col(k)) for k in "xyz"]).first()
    assert r[0] == r[1] != r[2]


def test_candidate_scores(spark):
    from corpusloom.functions.urls import candidate_score

    rows = [("https://h/en_x.htm", None, 95), ("https://h/x.html", "a", 88), ("https://h/en_x", "", 92), ("https://h/a/b", "Diseases", 72), ("https://h/a", "b", 0),
            ("https://h/x.html", "Privacy", 0), ("https://h/x.html?q=1", "a", 0), (None, "disease", 0)]
    got = spark.createDataFrame(rows, "u string, l string, w int").select(candidate_score(F.col("u"), F.col("l")), "w").collect()
    assert all(a == b for a, b in got)


def test_checkpoints(spark):
    listed = spark.createDataFrame([("i", "raw", "d1"), ("i", "md", "d2"), ("k", "raw", "d1"), ("k", "md", None)], "item string, name string, sha256 string")
    found = spark.createDataFrame([("i", "raw", "d1"), ("i", "md", "d2"), ("k", "raw", "other")], "item string, name string, sha256 string")
    got = {r["item"]: r["is_valid"] for r in evidence.valid_checkpoints(listed, found, ["item"], ["raw", "md"]).collect()}
    assert got == {"i": True, "k": False}


def test_listed_items(spark):
    links = [("/en_med_a.htm?utm_x=1", "first"), ("https://h/en_med_a.htm#t", "last"), ("/en_med_self.htm", "self"), ("https://other/en_med_b.htm", "b"), ("/about", "c")]
    pages = spark.createDataFrame([(1, "https://h/en_med_self.htm", links), (2, None, [])], "k int, url string, links array<struct<url:string,label:string>>")
    assert [tuple(r) for r in evidence.listed_items(pages, "k", "url", "links", ["h"]).collect()] == [(1, "https://h/en_med_a.htm", "last")]


def test_resolutions(spark):
    matches = spark.createDataFrame([("a", "exact", 1), ("b", "exact", 2), ("c", "alias", None)], "q string, tier string, id int")
    asked = spark.createDataFrame([(x,) for x in "abcda"], "q string")
    done = spark.createDataFrame([(2,)], "id int")
    got = {tuple(r) for r in evidence.resolutions(matches, asked, "q", done, "id").collect()}
    assert got == {("a", "matched"), ("b", "existing"), ("c", "ambiguous"), ("d", "not_found")}


def test_attached_details(spark):
    rows = spark.createDataFrame([(1, "Flu!"), (1, "Cold")], "k int, label string")
    details = spark.createDataFrame([(1, "flu", "u2", 2), (1, "FLU", "u1", 1), (1, "flu", "u1", 3), (2, "flu", "u9", 0)], "k int, label string, url string, position int")
    got = sorted(tuple(r) for r in evidence.attached_details(rows, details, "k", "label").collect())
    assert got == [(1, "Flu!", "u1", 1), (1, "Flu!", "u2", 2)]
