import random

from corpusloom.llm.reading import ReadingModel, fit_levels, prose_sentences, reading_levels

WORDS = {n: [f"w{chr(96 + n)}{chr(97 + i)}" for i in range(20)] for n in range(1, 6)}


def text(level, sentences, rng, mixed=0.3):
    out = []
    for i in range(sentences):
        of = level if i < sentences * (1 - mixed) else max(1, min(5, level + rng.choice([-1, 1])))
        out.append(" ".join(rng.sample(WORDS[of], 6) + ["the", "of"]) + ".")
    rng.shuffle(out)
    return " ".join(out) + "\n| dose | mg |\nCode Z05.3; ref. 12/3.\n"


def test_held_out_accuracy():
    rng = random.Random(1)
    train = [(text(n, 12, rng), n) for n in range(1, 6) for _ in range(20)]
    model = fit_levels(train)
    tests = [(text(n, 11, rng), n) for n in range(1, 6) for _ in range(20)]
    assert sum(model.level(t) == n for t, n in tests) >= 98
    assert "the" not in model.grades and model.level("") == model.usual
    assert model.level(tests[0][0].replace(".", " ").lower() * 3) == 1


def test_labelled_documents_of_the_tables(spark, data):
    import duckdb

    rows = duckdb.sql(f"SELECT text, reading_level FROM '{data}/documents.parquet' JOIN '{data}/reading_labels.parquet' USING (doc_id) WHERE text IS NOT NULL ORDER BY doc_id").fetchall()
    if len(rows) >= 40:
        model = fit_levels(rows[::2])
        assert sum(model.level(t) == n for t, n in rows[1::2]) >= 0.8 * len(rows[1::2])


def test_sentences():
    assert list(prose_sentences("One two. Three!\n| a | b |\n# Head\n* Four")) == [["one", "two"], ["three"], ["four"]]
    assert [len(s) for s in prose_sentences("a b " * 45)] == [18] * 5
    assert ReadingModel().level("nothing known") == 3


def test_table(spark):
    rng = random.Random(2)
    docs = [(n, text(n % 5 + 1, 10, rng)) for n in range(60)]
    docs += [(100, None), (101, ""), (102, " ".join(["x"] * 39)), (103, " ".join(["x"] * 40)), (104, "y " * 30_000), (3, docs[3][1])]
    labels = [(n, n % 5 + 1) for n in range(40)] + [(40, None), (41, 9), (None, 2), (999, 1), (0, 5)]
    d = spark.createDataFrame(docs, "doc_id bigint, text string").selectExpr("*", "1 AS reading_level", "2 AS level")
    lab = spark.createDataFrame(labels, "doc_id bigint, reading_level int").selectExpr("*", "'z' AS text")
    got = {r["doc_id"]: r["reading_level"] for r in reading_levels(d, lab).collect()}
    assert set(got) == {*range(42, 60), 40, 103, 104}
    assert sum(got[n] == n % 5 + 1 for n in range(42, 60)) >= 16
    assert {r["reading_level"] for r in reading_levels(d, lab.limit(0)).collect()} == {3}
    assert reading_levels(d.limit(0), lab).count() == 0
