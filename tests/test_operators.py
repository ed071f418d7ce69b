import datetime as dt
import random

from pyspark.sql import functions as F

from corpusloom.operators import hierarchy, html_pages, markdown_fields, matching, reports, state, traverse


def test_upsert_keeps_what_is_not_replaced(spark):
    schema = "k string, title string, url string, status string"
    old = spark.createDataFrame([("a", "A", "u1", "parsed"), ("b", "B", "u2", "parsed"), (None, "N", "u", "x")], schema)
    new = spark.createDataFrame([("a", None, "v1", "discovered"), ("c", "C", "v3", "discovered"), (None, None, "w", "y")], schema)
    got = {tuple(r) for r in state.upsert(old, new, ["k"], ["url"], ["title"]).collect()}
    assert got == {("a", "A", "v1", "parsed"), ("b", "B", "u2", "parsed"), ("c", "C", "v3", None), (None, "N", "w", "x")}
    assert state.upsert(old.limit(0), new, ["k"], ["url"], ["title"]).count() == 3


def test_jobs_once_and_latest_rows(spark):
    day = dt.datetime(2025, 1, 1)
    jobs = spark.createDataFrame([("a", "p", "running", day, None), ("a", "p", "completed", day, day + dt.timedelta(1)), (None, "p", "x", day, None)], "job_id string, plugin string, status string, created_at timestamp, finished_at timestamp").withColumn("started_at", F.col("created_at"))
    assert [r["status"] for r in state.distinct_jobs(jobs).collect()] == ["completed"]


def test_backoff_and_recovery(spark):
    rows = spark.range(1, 9)
    assert [r[0] for r in rows.select(state.backoff_seconds(F.col("id"), 2.0, 60.0)).collect()] == [2, 4, 8, 16, 32, 60, 60, 60]
    s = spark.createDataFrame([("fetching", True), ("fetching", False), ("parsed", False)], "s string, a boolean")
    assert [r[0] for r in s.select(state.recovered_status(F.col("s"), F.col("a"))).collect()] == ["fetched", "discovered", "parsed"]


MD = "intro line\n\n# Asthma\n\nPFO\n\nQ21.1\n\nA long summary, with a full stop.\n\n| Field | Value |\n| --- | --- |\n| Causes | clinical \\| laboratory |\n| Prognosis | one |\n| Prognosis | two |\n| Other | x |\n| Causes | CLINICAL \\| laboratory |\n\n## Next\r\n\r\n### \n\ntext"


def test_chunks(spark):
    rows = spark.createDataFrame([(1, MD), (2, None), (3, ""), (4, "\n\n# H\n"), (5, "x")], "k int, m string")
    got = [tuple(r) for r in markdown_fields.chunks(rows, "k", "m").orderBy("k", "chunk_no").select("k", "chunk_no", "heading", "level").collect()]
    assert got == [(1, 1, "Document", 1), (1, 2, "Asthma", 1), (1, 3, "Next", 2), (4, 1, "H", 1), (5, 1, "Document", 1)]


def test_fields(spark):
    rows = spark.createDataFrame([(1, MD)], "k int, m string")
    f = markdown_fields.table_fields(rows, "k", "m")
    assert [tuple(r) for r in f.orderBy("line_no").select("field", "value").collect()] == [("causes", "clinical | laboratory"), ("prognosis", "one"), ("prognosis", "two"), ("causes", "CLINICAL | laboratory")]
    merged = {r["field"]: r["merged"] for r in markdown_fields.merged_fields(f, "k", "line_no").collect()}
    assert merged == {"causes": "clinical | laboratory", "prognosis": "one\n\ntwo"}
    intro = spark.createDataFrame([(1, MD.removeprefix("intro line\n\n"))], "k int, m string")
    got = {(r["kind"], r["value"]) for r in markdown_fields.intro_blocks(intro, "k", "m").collect()}
    assert got == {("aliases", "PFO"), ("summary", "A long summary, with a full stop.")}
    assert markdown_fields.missing_fields(f, "k").first()["missing"].split(",")[:2] == ["aliases", "summary"]


def test_grounding(spark):
    src = spark.createDataFrame([(1, "Rest and **fluids**. More.")], "k int, s string")
    val = spark.createDataFrame([(1, "rest and fluids"), (1, "Invented treatment"), (1, "Rest\n\nmore.")], "k int, v string")
    assert [r["is_grounded"] for r in markdown_fields.grounded(val, src, "k", "v", "s").collect()] == [True, False, True]


PAGE = """<html><head><title>T</title><script>var a='</p>';</script></head><body><nav><a href=/n>N</a></nav>
<div class="breadcrumb">Home &raquo; Heart</div><article><h1>Title &amp; more</h1><p>A <b>bold</b> <a href="/x/?utm_source=f&b=1">link</a><br>next
<ul><li>one<ul><li>deep</ul><li>two</ul><ol><li>a<li>b</ol><table><tr><th>H<th>I<tr><td>1|2<td>x<br>y<tr><td>z</table>
<table><tr><td>only</table><blockquote>q</blockquote><pre> code </pre></article><footer>F</footer>"""


def test_page(spark):
    r = html_pages.pages_read(spark.createDataFrame([(1, PAGE, "http://h/p"), (2, None, "u"), (3, " ", None)], "k int, h string, u string"), "k", "h", "u").collect()
    assert [x["k"] for x in r] == [1]
    m = r[0]["markdown"]
    for part in ("# Title & more\n", "A **bold** [link](http://h/x?b=1)\nnext", "- one\n  - deep\n- two", "1. a\n2. b", "| H | I |\n| --- | --- |\n| 1\\|2 | x / y |\n| z |  |", "| Column 1 |\n| --- |\n| only |", "> q", "```\ncode\n```"):
        assert part in m, (part, m)
    assert "N" not in r[0]["plain_text"].split("\n") and "F" not in r[0]["plain_text"].split("\n")
    assert r[0]["title"] == "Title & more" and r[0]["breadcrumb"] == ["Home", "Heart"] and len(r[0]["tables"]) == 2


def test_paths_repair_jumps(spark):
    rows = spark.createDataFrame([([("a", 0), ("b", 2), ("c", 2), ("d", 1), ("e", -1)],)], "r array<struct<name:string,level:int>>")
    assert rows.select(hierarchy.paths(F.col("r"))).first()[0] == [["a"], ["a", "b"], ["a", "b", "c"], ["a", "d"], ["e"]]
    px = spark.createDataFrame([(0.0,), (25.0,), (37.5,), (62.5,), (30.0,), (None,)], "p double")
    assert [tuple(r) for r in px.select(hierarchy.indent_level(F.col("p")), hierarchy.off_grid(F.col("p"))).collect()] == [(0, False), (1, False), (2, True), (2, True), (1, True), (0, False)]
    r = spark.sql("select array('Name','A','','C') h, array('x','1') c").select(hierarchy.ratings(F.col("h"), F.col("c"))).first()[0]
    assert r == {"A": "1"}


def test_tiers(spark):
    labels = spark.createDataFrame([(1, "Asthma"), (2, "Angina - Heart pain"), (3, "Fevers"), (4, "Flu"), (5, "flu!")], "id int, label string")
    asked = spark.createDataFrame([("asthma",), ("angina",), ("Fever",), ("FLU",), ("nothing",), ("",)], "q string")
    got = {r["q"]: (r["tier"], r["n_candidates"], r["id"]) for r in matching.tiered_matches(asked, labels, "q", "id", "label").collect()}
    assert got == {"asthma": ("exact", 1, 1), "angina": ("alias", 1, 2), "Fever": ("plural", 1, 3), "FLU": ("exact", 2, None)}


def test_plurals_of_every_ending(spark):
    pairs = [("Calorie", "Calories"), ("Artery", "Arteries"), ("Virus", "Viruses"), ("Abscess", "Abscesses"), ("Series", "Serieses"), ("Eye", "Eyes")]
    for turn in (1, -1):
        two = [p[::turn] for p in pairs]
        labels = spark.createDataFrame([(n, y) for n, (_, y) in enumerate(two)], "id int, label string")
        asked = spark.createDataFrame([(x,) for x, _ in two], "q string")
        got = {(r["q"], r["tier"], r["n_candidates"], r["id"]) for r in matching.tiered_matches(asked, labels, "q", "id", "label").collect()}
        assert got == {(x, "plural", 1, n) for n, (x, _) in enumerate(two)}


def test_copies_of_a_page_are_one_candidate(spark):
    rows = [(1, "Asthma", "https://a.example/x?utm_source=f"), (2, "Asthma", "https://A.example/x#top"), (3, "Flu", "http://a.example/f"), (4, "Flu", "https://b.example/f")]
    candidates = spark.createDataFrame(rows, "id int, label string, url string")
    asked = spark.createDataFrame([("asthma",), ("flu",)], "q string")

    def found(hosts):
        labels = matching.unique_candidates(candidates, "id", "label", "url", hosts)
        return {r["q"]: (r["n_candidates"], r["id"]) for r in matching.tiered_matches(asked, labels, "q", "id", "label").collect()}

    assert found(None) == {"asthma": (1, 1), "flu": (1, 4)} and found(["a.example"]) == {"asthma": (1, 1)}


def test_shorter_queries(spark):
    names = spark.createDataFrame([(1, "Multiple and mixed valvular heart disease"), (2, "HIV/AIDS"), (3, "Down syndrome / Trisomy 21"), (4, "a  b")], "k int, n string")
    got = {}
    for r in matching.shorter_queries(names, "k", "n").orderBy("k", "query_no").collect():
        got.setdefault(r["k"], []).append(r["query"])
    assert got[1] == ["Multiple and mixed valvular heart disease", "Multiple and mixed valvular heart", "Multiple and mixed valvular", "Multiple mixed valvular heart disease", "Mixed valvular heart disease", "Valvular heart disease"]
    assert got[2] == ["HIV/AIDS"] and got[3] == ["Down syndrome / Trisomy 21", "Down syndrome", "Trisomy 21"] and got[4] == ["a b"]


def test_distinct_names(spark):
    rows = spark.createDataFrame([(1, " Sepsis "), (2, "Down   syndrome"), (3, "sepsis"), (4, "")], "o int, n string")
    assert [r["n"] for r in matching.distinct_names(rows, "n", "o").orderBy("o").collect()] == ["Sepsis", "Down syndrome"]


def test_traversal(spark):
    edges = spark.createDataFrame([("A", "S"), ("A", "X"), ("B", "X"), ("S", "D"), ("S", "A"), ("X", "D"), (None, "D")], "parent string, child string")
    roots = spark.createDataFrame([("A",), ("B",), ("A",)], "root string")
    got = {(r["root"], r["node"]): (r["depth"], r["path"]) for r in traverse.reach(edges, roots, 5).collect()}
    assert got["A", "D"] == (2, ["A", "S", "D"]) and got["B", "D"] == (2, ["B", "X", "D"]) and len(got) == 7
    assert traverse.reach(edges, roots, 0).count() == 2
    assert sorted("".join(r["path"]) for r in traverse.all_paths(edges, roots, 3).collect()) == ["A", "AS", "ASD", "AX", "AXD", "B", "BX", "BXD"]
    scores = spark.createDataFrame([("S", 1.0), ("X", 2.0), ("D", 3.0)], "node string, score double")
    assert {(r["node"], r["level"]) for r in traverse.best_first(edges, roots, scores, 2, 1).collect()} == {("A", 0), ("B", 0), ("X", 1), ("D", 2)}


def test_component_changes_and_order(spark):
    random.seed(1)
    rows = spark.createDataFrame([(1, "j1", "i", "h", "s", "t", dt.datetime(2025, 1, 1), ["b", "a"]), (2, "j2", "i", "H", None, "u", dt.datetime(2025, 1, 2), ["a", "c", "b"])], "report_row_id int, job_id string, item_id string, content_hash string, snapshot_hash string, title string, received_at timestamp, warnings array<string>")
    assert [r["changed"] for r in reports.component_changes(rows).collect()] == ["snapshot,title"]
    got = reports.ordered_distinct(rows.withColumn("job_id", F.lit("j")), "job_id", "warnings", ["report_row_id"]).orderBy("place").collect()
    assert [r["value"] for r in got] == ["b", "a", "c"]


def test_numbered_attempts_of_a_hot_key(spark):
    day = dt.datetime(2025, 1, 1)
    rows = [(n, "hot" if n % 3 else f"k{n % 7}", day + dt.timedelta(hours=(n * 37) % 500)) for n in range(400)] + [(900, None, day)]
    e = spark.createDataFrame(rows, "id int, k string, ts timestamp")
    got = {r["id"]: r["attempt_no"] for r in state.numbered_attempts(e.where("k is not null"), ["k"], ["ts", "id"], F.to_date("ts")).collect()}
    want, seen = {}, {}
    for i, k, t in sorted((r for r in rows if r[1]), key=lambda r: (r[2], r[0])):
        seen[k] = want[i] = seen.get(k, 0) + 1
    assert got == want


def test_loops_and_stops(spark):
    trace = spark.createDataFrame([(1, "a", n) for n in range(5)] + [(1, "b", 9), (2, "a", 1)], "k int, page string, n int")
    assert [tuple(r) for r in traverse.loops(trace, "k", "page", "n").select("k", "page", "visits", "first_over").collect()] == [(1, "a", 5, 2)]
    pages = spark.createDataFrame([(1, "x", 1), (1, "x", 2), (1, "x", 3), (1, "y", 4)], "k int, item string, page int")
    assert [r["page"] for r in traverse.first_seen(pages, "k", "item", "page").where("stops").collect()] == [3]
