import re

from corpusloom.llm.maincontent import Usual, entry_id, main_blocks, main_content, text_blocks

PROSE = "Doctors confirm the diagnosis with an exercise test, and sometimes a tissue sample is necessary as well. "
FRAME = """<!DOCTYPE html><html><HEAD><title>x</title><style>p{{}}</style><script>var t='</p><div>menu</div>';</script></HEAD><body>
<div><p>We use cookies to improve our services.</p><button>OK</button></div><div><ul><li><a href=/1>Home</a></li><li><a href=/2>News</a></li></ul></div>
{body}<div><h2>Related topics</h2><p><a href=/3>Other fever</a>: It is often treated with rest and some tea.</p></div>
<div><p>Terms of use</p><p>&copy; 2021 site.example</p></div></body></html>"""
ARTICLE = """<div><h1>Acute fever</h1><p>Reviewed on 3 March 2026 &middot; 2 min read</p><h2>Causes</h2><p>{a}<p>{a}<em>More</em> of <a href=/x>it</a>.
<ul><li><a href=/4>Cold</a><li>{a}</ul><table><tr><th>C<th>R<tr><td>x<td>+5%</table><p>Rare.</p><p>Read also: <a href=/5>Long other fever</a></p>
<div class=box><p>Sign up for the newsletter today.</p></div></div>"""


#: What the pass over a corpus would have learnt of these sites.
LEARNT = frozenset(map(entry_id, ("=reviewed on 0 march 0 · 0 min read", "sign up for the newsletter today")))
#: What its articles' bodies are like.
USUAL = Usual(45.0, 20.0)


def texts(page):
    return [b.text for _, b in main_blocks(page, LEARNT, USUAL)]


def test_blocks():
    page = "<!-- a<b> --><p>one <b>two</b><br>three</p><NOSCRIPT>x</NOSCRIPT>&#65;&amp;<hr/><td title='a>b'>  </td>tail<div"
    assert [b.text for b in text_blocks(page)] == ["one two three", "A&", "tail<div"]
    assert text_blocks("") == [] and text_blocks("<p> </p>") == []
    assert [b.text for b in text_blocks("<head><title>t</title></head><header>h</header>")] == ["h"]


def test_article():
    a = PROSE * 2
    want = ["Acute fever", "Causes", a.strip(), f"{a}More of it.", "Cold", a.strip(), "C", "R", "x", "+5%", "Rare."]
    assert texts(FRAME.format(body=ARTICLE.format(a=a))) == want
    assert texts(FRAME.format(body=ARTICLE.format(a=a)).upper().replace("&MIDDOT;", "&middot;").replace("&COPY;", "&copy;")) == [x.upper() for x in want]
    assert texts(ARTICLE.format(a=a)) == want  # a fragment
    assert texts(re.sub(r"\n", "", FRAME.format(body=ARTICLE.format(a=a)))) == [x for x in want]


def test_no_main_text():
    assert texts(FRAME.format(body="<p>Please sign in to view this page.</p>")) == []


def test_block_numbers():
    page = FRAME.format(body=ARTICLE.format(a=PROSE))
    every = [b.text for b in text_blocks(page)]
    assert all(every[n - 1] == b.text for n, b in main_blocks(page))


def test_furniture_is_learnt(spark):
    notes = "Our editors wish you a pleasant day in these halls."
    rows = []
    for n in range(60):
        words = " ".join(f"{chr(97 + n % 26)}{chr(97 + i)}{chr(97 + n // 26)}word" for i in range(9))
        body = f"<div><h1>Case {chr(97 + n % 26)}</h1><p>{words}, {PROSE}</p><p>{notes}</p></div>"
        rows.append((n, FRAME.format(body=body)))
    rows += [(500 + n, rows[0][1]) for n in range(40)] + [(900, None), (901, ""), (902, rows[0][1])]
    pages = spark.createDataFrame(rows, "page_id bigint, html string").selectExpr("*", "1 AS block_no", "'t' AS text", "2 AS digest")
    got = main_content(pages).collect()
    assert {r["page_id"] for r in got} == {r[0] for r in rows} - {900, 901}
    assert not any(r["text"] == notes for r in got)
    assert sum(PROSE.strip() in r["text"] for r in got) == len(rows) - 2
    assert main_content(pages.limit(0)).count() == 0


def test_long_page():
    page = FRAME.format(body="<div><h1>T</h1>" + f"<p>{PROSE}</p>" * 20_000 + "</div>")
    assert len(main_blocks(page)) == 20_001


def words(n, k):
    return " ".join("".join(chr(97 + int(d)) for d in f"{n:03}{k:03}{i:03}") for i in range(9))


def varied(n, note):
    text = "".join(f"<p>{words(n, k)}, {PROSE}</p>" for k in range(4))
    return FRAME.format(body=f"<div><h1>Case {words(n, 9)[:9]}</h1>{note}{text}</div>")


def test_near_copies_are_no_furniture(spark):
    """A third of the pages is one article whose copies differ in a menu, a token and an advert."""
    note = "<p>Reviewed on 3 March 2026 &middot; 2 min read</p>"
    rows = [(n, varied(n, note)) for n in range(60)]
    own = [f"{words(900, k)}, {PROSE}".strip() for k in range(4)]
    for n in range(30):
        body = "".join(f"<p>{x}</p>" for x in own) + f"<p>Token {words(n, 50)} of this print.</p>"
        page = FRAME.format(body=f"<div><h1>Copied</h1>{note}{body}</div>").replace("Home</a>", f"Home {words(n, 60)}</a>")
        rows.append((1000 + n, page))
    got = main_content(spark.createDataFrame(rows, "page_id bigint, html string")).collect()
    assert not any("min read" in r["text"] for r in got)
    for n in range(30):
        assert {r["text"] for r in got if r["page_id"] == 1000 + n} >= {"Copied", *own}


def test_furniture_of_a_small_site(spark):
    """Twelve pages of one site among 6000 have a notice of their own inside and outside the body."""
    note = "<p>Written by the friends of this house.</p>"
    rows = [(n, "www.large.example", f"<div><h1>Case</h1><p>{words(n, 1)}, {PROSE}</p></div>") for n in range(6000 - 12)]
    rows += [(10_000 + n, "www.small.example", varied(n, note)) for n in range(12)]
    pages = spark.createDataFrame(rows, "page_id bigint, site string, html string")
    got = [r for r in main_content(pages).collect() if r["page_id"] >= 10_000]
    assert len({r["page_id"] for r in got}) == 12 and sum(PROSE.strip() in r["text"] for r in got) == 48
    assert not any("friends" in r["text"] for r in got)


def test_long_lists_of_short_items():
    items = "<ul>" + "".join(f"<li>short item {i}</li>" for i in range(60)) + "</ul>"
    sections = f"<div><h2>Causes</h2>{f'<p>{PROSE * 3}</p>' * 3}</div><div><h2>Names</h2>{items}</div>"
    got = texts(FRAME.format(body=f"<article><h1>Fever</h1>{sections}</article>"))
    assert got[:2] == ["Fever", "Causes"] and got[-61:] == ["Names", *(f"short item {i}" for i in range(60))]
    assert texts(FRAME.format(body=f"<article><h1>Fever</h1><h2>Names</h2>{items}</article>"))[:2] == ["Fever", "Names"]
    lines = "".join(f"<p>short line {i}</p>" for i in range(60))
    got = texts(FRAME.format(body=f"<article><h1>Fever</h1>{sections.replace(items, lines)}</article>"))
    assert got[0] == "Fever" and got[-1] == "short line 59"


def test_short_pages_without_headings(spark):
    table = "<table><tr><th>Drug</th><th>Dose</th></tr><tr><td>x</td><td>+5</td></tr></table>"
    short = {
        f"<p>{PROSE}</p>": [PROSE.strip()],
        "<div><p>One short note.</p><p>Two more words.</p></div>": ["One short note.", "Two more words."],
        table: ["Drug", "Dose", "x", "+5"],
        "<dl><dt>Fever</dt><dd>High temperature</dd></dl>": ["Fever", "High temperature"],
        "<ul><li>aspirin</li><li>ibuprofen</li><li>rest</li></ul>": ["aspirin", "ibuprofen", "rest"],
    }
    for page, want in short.items():
        assert texts(page) == want
    assert texts("<div><a href=/1>Home</a></div>") == [] and texts("<h2>More</h2>") == []
    # in the frame of a site, once the corpus has taught it
    rows = [(n, varied(n, "")) for n in range(60)] + [(100 + n, FRAME.format(body=f"<div>{p}</div>")) for n, p in enumerate(short)]
    got = main_content(spark.createDataFrame(rows, "page_id bigint, html string")).orderBy("page_id", "block_no").collect()
    for n, want in enumerate(short.values()):
        assert [r["text"] for r in got if r["page_id"] == 100 + n] == want
