"""Queries on names, Markdown, pages and graphs."""

from __future__ import annotations

from pyspark.sql import functions as F

from corpusloom.functions import text as t
from corpusloom.functions import urls
from corpusloom.operators import hierarchy, html_pages, markdown_fields, matching, traverse
from corpusloom.runtime import table


def _titles(spark, d):
    return table(spark, d, "report_items").select("title").where("title is not null").distinct()


def _content(spark, d):
    return table(spark, d, "clean_content")


def text_plain(spark, d):
    rows = _content(spark, d).select("content_id", t.plain_text(F.col("markdown")).alias("plain"))
    return rows.where("plain is not null").select("content_id", F.sha2("plain", 256).alias("digest"), F.length("plain").alias("n_chars"))


def text_ground(spark, d):
    rows = _content(spark, d).select("content_id", t.ground_text(t.nfc(F.col("markdown"))).alias("g")).where("g is not null")
    return rows.select("content_id", F.sha2("g", 256).alias("digest"))


def text_search_name(spark, d):
    return _titles(spark, d).select("title", t.search_name(F.col("title")).alias("name"), t.name_identity(F.col("title")).alias("identity"), t.audit_name(F.col("title")).alias("audit"))


def text_slug(spark, d):
    return _titles(spark, d).select("title", t.slug(F.col("title")).alias("slug"))


def search_name_compat(spark, d):
    rows = table(spark, d, "search_candidates").select("candidate_id", t.search_name(t.nfkc(F.col("label"))).alias("name"))
    return rows.groupBy("name").agg(F.count("*").alias("labels"), F.min("candidate_id").alias("first_id"))


def name_dedup(spark, d):
    rows = table(spark, d, "report_items").select("title", "report_row_id").where("title is not null")
    return matching.distinct_names(rows, "title", "report_row_id")


def html_guard(spark, d):
    p = table(spark, d, "raw_tabs")
    return p.groupBy("tab_key").agg(F.count_if(t.holds_html(F.col("html"))).alias("with_html"), F.count("*").alias("pages"))


def redacted(spark, d):
    rows = _titles(spark, d)
    return rows.select("title", t.redact(F.lower("title"), ["fever", "fev", "syndrome"]).alias("redacted"))


def md_normal_hash(spark, d):
    return _content(spark, d).where("markdown is not null").select("content_id", t.content_hash(t.nfc(F.col("markdown"))).alias("digest"))


def chunk_headings(spark, d):
    c = markdown_fields.chunks(_content(spark, d), "content_id", "markdown")
    return c.select("content_id", "chunk_no", "heading", "level", F.sha2("body", 256).alias("digest"))


def field_rows(spark, d):
    return markdown_fields.table_fields(_content(spark, d), "content_id", "markdown")


def field_merge(spark, d):
    rows = markdown_fields.table_fields(_content(spark, d), "content_id", "markdown")
    return markdown_fields.merged_fields(rows, "content_id", "line_no").select("content_id", "field", "n_values", F.sha2("merged", 256).alias("digest"))


def intro_blocks(spark, d):
    return markdown_fields.intro_blocks(_content(spark, d), "content_id", "markdown")


def document_names(spark, d):
    rows = _content(spark, d).select("content_id", markdown_fields.document_name(F.col("markdown")).alias("name"))
    return rows.where("name is not null")


def missing_after_rules(spark, d):
    rows = markdown_fields.table_fields(_content(spark, d), "content_id", "markdown")
    return markdown_fields.missing_fields(rows, "content_id")


def grounding(spark, d):
    c = _content(spark, d)
    rows = markdown_fields.table_fields(c, "content_id", "markdown")
    g = markdown_fields.grounded(rows, c, "content_id", "value", "plain_text")
    return g.groupBy("field").agg(F.count("*").alias("n"), F.count_if("is_grounded").alias("grounded"))


def evidence(spark, d):
    rows = markdown_fields.document_name(F.col("markdown"))
    c = _content(spark, d).select("content_id", rows.alias("name"), "plain_text").where("name is not null and plain_text is not null")
    return c.select("content_id", t.excerpt(F.col("plain_text"), F.col("name")).alias("excerpt")).where("excerpt is not null")


def tiered_match(spark, d):
    labels = matching.unique_candidates(table(spark, d, "search_candidates").where("label is not null"), "candidate_id", "label", "url")
    asked = table(spark, d, "search_candidates").select("search_query").where("search_query is not null").distinct()
    return matching.tiered_matches(asked, labels, "search_query", "candidate_id", "label")


def query_backoff(spark, d):
    names = table(spark, d, "disease_documents").select("document_no", "disease_name").where("disease_name is not null")
    return matching.shorter_queries(names, "document_no", "disease_name")


def phrase_overlap(spark, d):
    rows = table(spark, d, "search_candidates").where("search_query is not null and label is not null")
    return rows.select("candidate_id", t.overlaps(F.col("search_query"), F.col("label")).alias("overlaps"),
                       t.is_plural_pair(F.col("search_query"), F.col("label")).alias("plural"),
                       t.is_alias(F.col("search_query"), F.col("label")).alias("alias"))


def search_representative(spark, d):
    rows = table(spark, d, "search_candidates").select(
        F.lower(F.trim("search_query")).alias("q"), "candidate_id", "rank_no", (F.col("label").isNotNull() & (F.col("rank_no") < 6)).alias("ok")
    )
    return matching.representative(rows, "q", "ok", "rank_no", "candidate_id").select("q", "candidate_id", "rank_no")


def _pages(spark, d):
    p = table(spark, d, "raw_tabs").select("page_id", F.col("source_url").alias("url"), "html")
    return p.union(table(spark, d, "raw_tab_details").select("page_id", "url", "html"))


def html_read(spark, d):
    p = html_pages.pages_read(_pages(spark, d), "page_id", "html", "url")
    return p.select("page_id", "title", "plain_text", "markdown", "removed_nodes", "warnings", "forms")


def html_titles(spark, d):
    title = t.collapse(F.regexp_extract("html", r"(?is)<title[^>]*>(.*?)</title>", 1))
    return _pages(spark, d).where("html is not null").select("page_id", title.alias("title"))


def html_link_count(spark, d):
    n = F.regexp_count("html", F.lit(r"(?i)<a\s[^>]*href="))
    return _pages(spark, d).where("html is not null").select("page_id", n.alias("links"))


def html_links(spark, d):
    p = html_pages.pages_read(_pages(spark, d), "page_id", "html", "url")
    each = p.select("page_id", "url", F.posexplode("links").alias("pos", "l"))
    return each.select("page_id", "pos", urls.absolute_url(F.col("l.url"), F.col("url")).alias("target"), F.col("l.label").alias("label"))


def html_tables(spark, d):
    p = html_pages.pages_read(_pages(spark, d), "page_id", "html", "url")
    each = p.select("page_id", F.posexplode("tables").alias("table_no", "rows"))
    return each.select("page_id", "table_no", F.posexplode("rows").alias("row_no", "cells")).select(
        "page_id", "table_no", "row_no", F.array_join("cells", " | ").alias("cells")
    )


def html_profile(spark, d):
    p = html_pages.pages_read(_pages(spark, d), "page_id", "html", "url")
    return p.select("page_id", F.size("links").alias("links"), F.size("tables").alias("tables"), F.size("headings").alias("headings"), "forms", F.length("plain_text").alias("n_chars"))


def menu_trails(spark, d):
    p = html_pages.pages_read(_pages(spark, d), "page_id", "html", "url")
    return hierarchy.menu_levels(p.where(F.size("breadcrumb") > 0), "page_id", "breadcrumb", "title")


def page_fingerprints(spark, d):
    rows = _pages(spark, d).where("html is not null")
    fp = urls.fingerprint(F.coalesce("url", F.lit("")), F.lit("page"), F.col("html"))
    return rows.groupBy(fp.alias("fingerprint")).agg(F.count("*").alias("pages"), F.min("page_id").alias("first_page"))


def tree_paths(spark, d):
    orders = table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey")
    row = F.struct(F.col("l_linenumber").alias("i"), F.col("l_partkey").cast("string").alias("name"), F.pmod("l_partkey", F.lit(4)).cast("int").alias("level"))
    tables = orders.groupBy("l_orderkey").agg(F.sort_array(F.collect_list(row)).alias("rows"))  # a few lines of one order
    return hierarchy.tree_rows(tables, "l_orderkey", "rows")


def indent_levels(spark, d):
    p = table(spark, d, "part").select("p_partkey", (F.col("p_size") * 2.5).alias("px"))
    return p.select("p_partkey", hierarchy.indent_level(F.col("px")).alias("level"), hierarchy.off_grid(F.col("px")).alias("off_grid"))


def _edges(spark, d):
    node = lambda kind, c: F.concat(F.lit(kind), F.col(c).cast("string"))
    e = table(spark, d, "nation").select(node("r", "n_regionkey").alias("parent"), node("n", "n_nationkey").alias("child"))
    e = e.union(table(spark, d, "customer").select(node("n", "c_nationkey"), node("c", "c_custkey")))
    e = e.union(table(spark, d, "supplier").select(node("n", "s_nationkey"), node("s", "s_suppkey")))
    return e.union(table(spark, d, "nation").select(node("n", "n_nationkey"), node("r", "n_regionkey")))  # cycles


def _roots(spark, d):
    return table(spark, d, "region").select(F.concat(F.lit("r"), F.col("r_regionkey").cast("string")).alias("root"))


def bfs_reach(spark, d):
    return traverse.reach(_edges(spark, d), _roots(spark, d), 3).select("root", "node", "depth", F.array_join("path", ">").alias("path"))


def bfs_paths(spark, d):
    return traverse.all_paths(_edges(spark, d), _roots(spark, d), 2).select("root", "node", "depth", F.array_join("path", ">").alias("path"))


def best_first(spark, d):
    e = _edges(spark, d)
    scores = e.groupBy("child").agg(F.count("*").alias("n")).select(F.col("child").alias("node"), (F.length("child") + F.col("n")).cast("double").alias("score"))
    return traverse.best_first(e, _roots(spark, d), scores, 3, 20)


def pagination_stop(spark, d):
    rows = table(spark, d, "lineitem").select("l_suppkey", "l_partkey", F.to_date("l_shipdate").alias("page"))
    return traverse.first_seen(rows, "l_suppkey", "l_partkey", "page")


def loop_guard(spark, d):
    rows = table(spark, d, "events")
    return traverse.loops(rows, "user_id", "event_type", "event_id")


def direct_children(spark, d):
    e = _edges(spark, d).distinct()
    return e.groupBy("parent").agg(F.count("*").alias("children"), F.min("child").alias("first_child"))


def alias_rows(spark, d):
    return table(spark, d, "disease_documents").select("document_no", F.posexplode("aliases").alias("p", "alias")).select(
        "document_no", (F.col("p") + 1).alias("value_order"), "alias"
    )


def heading_rows(spark, d):
    return _content(spark, d).select("content_id", F.posexplode("headings").alias("p", "heading")).select(
        "content_id", (F.col("p") + 1).alias("section_order"), "heading"
    )


QUERIES = [
    text_plain, text_ground, text_search_name, text_slug, search_name_compat, name_dedup, html_guard, redacted, md_normal_hash,
    chunk_headings, field_rows, field_merge, intro_blocks, document_names, missing_after_rules, grounding, evidence, tiered_match,
    query_backoff, phrase_overlap, search_representative, html_read, html_titles, html_link_count, html_links, html_tables,
    html_profile, menu_trails, page_fingerprints, tree_paths, indent_levels, bfs_reach, bfs_paths, best_first, pagination_stop,
    loop_guard, direct_children, alias_rows, heading_rows,
]

# RE2 knows no Unicode white space; \s of Python and of the engine is this class
WS = r"[\s\x0b\x{1c}-\x{1f}\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]"


def _collapse(x: str) -> str:
    return f"trim(regexp_replace({x}, '{WS}+', ' ', 'g'))"


def _plain(x: str) -> str:
    inner = f"regexp_replace(replace({x}, '\\|', '|'), '\\[([^\\]]+)\\]\\([^)]+\\)', '\\1', 'g')"
    return _collapse(f"regexp_replace({inner}, '[*_`#>|]', '', 'g')")


def _ground(x: str) -> str:
    return f"replace(lower({_plain(f'replace({x}, $$<br>$$, $$ $$)')}), 'ß', 'ss')"


def _name(x: str) -> str:
    words = f"trim(regexp_replace(replace(lower({x}), 'ß', 'ss'), '[^\\pL\\pN\\pM]+', ' ', 'g'))"
    return f"regexp_replace({words}, '(\\S) (e?s)$', '\\1\\2')"


LINES = r"string_split(replace(replace(markdown, chr(13) || chr(10), chr(10)), chr(13), chr(10)), chr(10))"
FIELD_CASE = "CASE label " + " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in markdown_fields.TABLE_FIELDS.items()) + " END"
FIELD_ROWS = f"""
SELECT content_id, CAST(line_no AS INTEGER) AS line_no, {FIELD_CASE} AS field, value FROM (
  SELECT content_id, line_no, replace(lower({_plain("cells[1]")}), 'ß', 'ss') AS label, trim(cells[2]) AS value FROM (
    SELECT content_id, line_no, list_transform(string_split(trim(trim(replace(line, '\\|', chr(1))), '|'), '|'), lambda x: replace(trim(x), chr(1), '|')) AS cells
    FROM (SELECT content_id, unnest({LINES}) AS line, generate_subscripts({LINES}, 1) - 1 AS line_no FROM clean_content WHERE markdown IS NOT NULL)
    WHERE starts_with(line, '|') AND length(line) - length(replace(line, '|', '')) >= 3) WHERE len(cells) >= 2)
WHERE field IS NOT NULL AND NOT regexp_matches(value, '^[-:]*$')"""
PAGES = "(SELECT page_id, source_url AS url, html FROM raw_tabs UNION ALL SELECT page_id, url, html FROM raw_tab_details)"
EDGES = """(SELECT 'r' || n_regionkey AS parent, 'n' || n_nationkey AS child FROM nation UNION SELECT 'n' || c_nationkey, 'c' || c_custkey FROM customer
  UNION SELECT 'n' || s_nationkey, 's' || s_suppkey FROM supplier UNION SELECT 'n' || n_nationkey, 'r' || n_regionkey FROM nation)"""
H1 = r"regexp_extract(markdown, '(?m)^#\s+(.+?)\s*$', 1)"
HTML_TITLE = "regexp_extract(html, '(?is)<title[^>]*>(.*?)</title>', 1)"
TITLES = "(SELECT DISTINCT title FROM report_items WHERE title IS NOT NULL)"

SQL = {
    "text_plain": f"SELECT content_id, sha256(p) AS digest, CAST(length(p) AS INTEGER) AS n_chars FROM (SELECT content_id, {_plain('markdown')} AS p FROM clean_content) WHERE p IS NOT NULL",
    "text_ground": f"SELECT content_id, sha256(p) AS digest FROM (SELECT content_id, {_ground('nfc_normalize(markdown)')} AS p FROM clean_content) WHERE p IS NOT NULL",
    "text_search_name": f"""SELECT title, {_name('title')} AS name, array_to_string(regexp_extract_all(replace(lower(title), 'ß', 'ss'), '[a-z0-9]+'), ' ') AS identity,
        trim({_collapse("replace(lower(title), 'ß', 'ss')")}, ' .,;:') AS audit FROM {TITLES}""",
    "text_slug": f"""SELECT title, CASE WHEN s = '' THEN 'disease' ELSE s END AS slug FROM (SELECT title, rtrim(substr(trim(regexp_replace(
        translate(lower(title), 'àáâãäåçèéêëìíîïñòóôõöùúûüýÿ', 'aaaaaaceeeeiiiinooooouuuuyy'), '[^a-z0-9]+', '-', 'g'), '-'), 1, 60), '-') AS s FROM {TITLES})""",
    "name_dedup": f"""SELECT min(report_row_id) AS report_row_id, arg_min(t, report_row_id) AS title FROM (SELECT report_row_id, {_collapse('title')} AS t FROM report_items WHERE title IS NOT NULL)
        WHERE t <> '' GROUP BY replace(lower(t), 'ß', 'ss')""",
    "html_guard": "SELECT tab_key, count(*) FILTER (regexp_matches(html, '(?i)<!doctype|<html|<body|<script|<iframe|<div|<span|<table|</')) AS with_html, count(*) AS pages FROM raw_tabs GROUP BY tab_key",
    "redacted": f"SELECT title, replace(replace(replace(lower(title), 'syndrome', '[REDACTED]'), 'fever', '[REDACTED]'), 'fev', '[REDACTED]') AS redacted FROM {TITLES}",
    "md_normal_hash": f"""SELECT content_id, sha256(regexp_replace(regexp_replace(regexp_replace(
        array_to_string(list_transform({LINES.replace('markdown', 'nfc_normalize(markdown)')}, lambda x: regexp_replace(x, '{WS}+$', '')), chr(10)), '\n{{3,}}', chr(10) || chr(10), 'g'),
        '^{WS}+', ''), '{WS}+$', '') || chr(10)) AS digest FROM clean_content WHERE markdown IS NOT NULL""",
    "chunk_headings": f"""WITH l AS (SELECT content_id, unnest({LINES}) AS line, generate_subscripts({LINES}, 1) AS pos FROM clean_content WHERE markdown IS NOT NULL),
        h AS (SELECT *, regexp_matches(line, '^(#{{1,6}})\\s+(.+?)\\s*$') AS is_head FROM l),
        n AS (SELECT *, sum(is_head::INT) OVER (PARTITION BY content_id ORDER BY pos) AS chunk, row_number() OVER (PARTITION BY content_id, rid ORDER BY pos) FROM (SELECT *, 1 AS rid FROM h)),
        c AS (SELECT content_id, chunk, regexp_replace(regexp_replace(string_agg(line, chr(10) ORDER BY pos), '^{WS}+', ''), '{WS}+$', '') AS body,
          arg_min(CASE WHEN is_head THEN regexp_extract(line, '^(#{{1,6}})\\s+(.+?)\\s*$', 2) ELSE 'Document' END, pos) AS heading,
          arg_min(CASE WHEN is_head THEN length(regexp_extract(line, '^(#{{1,6}})\\s', 1)) ELSE 1 END, pos) AS level FROM n GROUP BY content_id, chunk)
        SELECT content_id, CAST(row_number() OVER (PARTITION BY content_id ORDER BY chunk) AS INTEGER) AS chunk_no, heading, CAST(level AS INTEGER) AS level, sha256(body) AS digest FROM c WHERE body <> ''""",
    "field_rows": FIELD_ROWS,
    "field_merge": f"""WITH r AS ({FIELD_ROWS}), g AS (SELECT *, {_ground('value')} AS gr FROM r), f AS (SELECT content_id, field, gr, min(line_no) AS line_no, arg_min(value, line_no) AS v FROM g WHERE gr <> '' GROUP BY ALL)
        SELECT content_id, field, CAST(count(*) AS INTEGER) AS n_values, sha256(CASE WHEN field IN ('summary', 'prognosis') THEN string_agg(trim(v), chr(10) || chr(10) ORDER BY line_no) ELSE string_agg(trim(v), chr(10) ORDER BY line_no) END) AS digest FROM f GROUP BY content_id, field""",
    "document_names": f"SELECT content_id, name FROM (SELECT content_id, nullif({_plain(H1)}, '') AS name FROM clean_content) WHERE name IS NOT NULL",
    "missing_after_rules": f"""WITH r AS ({FIELD_ROWS}), h AS (SELECT content_id, list(DISTINCT field) AS have FROM r GROUP BY content_id)
        SELECT content_id, array_to_string(list_filter([{", ".join(repr(f) for f in markdown_fields.FIELDS)}], lambda x: NOT list_contains(have, x)), ',') AS missing FROM h""",
    "grounding": f"""WITH r AS ({FIELD_ROWS}), s AS (SELECT content_id, {_ground('plain_text')} AS src FROM clean_content)
        SELECT field, count(*) AS n, count(*) FILTER (contains(src, {_ground('value')})) AS grounded FROM r JOIN s USING (content_id) GROUP BY field""",
    "phrase_overlap": f"""WITH x AS (SELECT candidate_id, label, {_name('search_query')} AS a, {_name('label')} AS b FROM search_candidates WHERE search_query IS NOT NULL AND label IS NOT NULL),
        y AS (SELECT *, regexp_extract(a, '(\\S+)$', 1) AS la, regexp_extract(b, '(\\S+)$', 1) AS lb, regexp_replace(a, '\\S+$', '') AS ha, regexp_replace(b, '\\S+$', '') AS hb FROM x),
        z AS (SELECT *, CASE WHEN regexp_matches(la, '[^aeiou]y$') THEN regexp_replace(la, 'y$', 'ies') WHEN regexp_matches(la, '(s|x|z|ch|sh)$') THEN la || 'es' ELSE la || 's' END AS pa,
          CASE WHEN regexp_matches(lb, '[^aeiou]y$') THEN regexp_replace(lb, 'y$', 'ies') WHEN regexp_matches(lb, '(s|x|z|ch|sh)$') THEN lb || 'es' ELSE lb || 's' END AS pb FROM y)
        SELECT candidate_id, a <> '' AND b <> '' AND (contains(' ' || a || ' ', ' ' || b || ' ') OR contains(' ' || b || ' ', ' ' || a || ' ')) AS overlaps,
          la <> '' AND lb <> '' AND ha = hb AND la <> lb AND (pa = lb OR pb = la) AS plural,
          list_contains(list_transform(list_filter(regexp_split_to_array(label, '{WS}+-{WS}+'), lambda p: {_collapse('p')} <> '')[:-2], lambda p: {_name('p')}), a) AS alias FROM z""",
    "search_representative": """SELECT q, arg_min(candidate_id, (r, candidate_id)) AS candidate_id, arg_min(rank_no, (r, candidate_id)) AS rank_no FROM (SELECT lower(trim(search_query)) AS q, candidate_id, rank_no,
        CASE WHEN label IS NOT NULL AND rank_no < 6 AND rank_no > 0 THEN 0 WHEN label IS NOT NULL AND rank_no < 6 THEN 1 ELSE 2 END AS r FROM search_candidates) GROUP BY q""",
    "html_titles": f"SELECT page_id, {_collapse(HTML_TITLE)} AS title FROM {PAGES} WHERE html IS NOT NULL",
    "html_link_count": f"SELECT page_id, CAST(len(regexp_extract_all(html, '(?i)<a\\s[^>]*href=')) AS INTEGER) AS links FROM {PAGES} WHERE html IS NOT NULL",
    "page_fingerprints": f"""SELECT sha256(coalesce(url, '') || chr(10) || 'page' || chr(10) || {_collapse("lower(html)")}) AS fingerprint, count(*) AS pages, min(page_id) AS first_page
        FROM {PAGES} WHERE html IS NOT NULL GROUP BY 1""",
    "indent_levels": "SELECT p_partkey, CAST(round_even(p_size * 2.5::DOUBLE / 25, 0) AS INTEGER) AS level, abs(p_size * 2.5::DOUBLE / 25 - round_even(p_size * 2.5::DOUBLE / 25, 0)) > 0.01 AS off_grid FROM part",
    "bfs_reach": f"""WITH RECURSIVE p AS (SELECT 'r' || r_regionkey AS root, 'r' || r_regionkey AS node, 0 AS depth, ['r' || r_regionkey] AS path FROM region
        UNION ALL SELECT root, child, depth + 1, list_append(path, child) FROM p JOIN {EDGES} ON node = parent WHERE depth < 3 AND NOT list_contains(path, child))
        SELECT root, node, depth, array_to_string(path, '>') AS path FROM (SELECT *, row_number() OVER (PARTITION BY root, node ORDER BY depth, path) AS n FROM p) WHERE n = 1""",
    "bfs_paths": f"""WITH RECURSIVE p AS (SELECT 'r' || r_regionkey AS root, 'r' || r_regionkey AS node, 0 AS depth, ['r' || r_regionkey] AS path FROM region
        UNION ALL SELECT root, child, depth + 1, list_append(path, child) FROM p JOIN {EDGES} ON node = parent WHERE depth < 2 AND NOT list_contains(path, child))
        SELECT root, node, depth, array_to_string(path, '>') AS path FROM p""",
    "pagination_stop": """WITH f AS (SELECT l_suppkey, l_partkey, min(CAST(l_shipdate AS DATE)) AS page FROM lineitem GROUP BY ALL), n AS (SELECT l_suppkey, page, count(*) AS n_new FROM f GROUP BY ALL),
        e AS (SELECT l_suppkey, page, coalesce(n_new, 0) AS n_new FROM (SELECT DISTINCT l_suppkey, CAST(l_shipdate AS DATE) AS page FROM lineitem) LEFT JOIN n USING (l_suppkey, page))
        SELECT l_suppkey, page, n_new, n_new = 0 AND coalesce(lag(n_new) OVER (PARTITION BY l_suppkey ORDER BY page) = 0, false) AS stops FROM e""",
    "loop_guard": """SELECT user_id, event_type, CAST(count(*) AS INTEGER) AS visits, min(event_id) FILTER (n = 3) AS first_over FROM (SELECT *, row_number() OVER (PARTITION BY user_id, event_type ORDER BY event_id) AS n FROM events)
        GROUP BY user_id, event_type HAVING count(*) >= 3""",
    "direct_children": f"SELECT parent, count(*) AS children, min(child) AS first_child FROM {EDGES} GROUP BY parent",
    "alias_rows": "SELECT document_no, CAST(generate_subscripts(aliases, 1) AS INTEGER) AS value_order, unnest(aliases) AS alias FROM disease_documents",
    "heading_rows": "SELECT content_id, CAST(generate_subscripts(headings, 1) AS INTEGER) AS section_order, unnest(headings) AS heading FROM clean_content",
}
