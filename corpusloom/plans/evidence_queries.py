"""Queries on values, their evidence, tabs and pages."""

from __future__ import annotations

from pyspark.sql import functions as F

from corpusloom.functions import arrays, urls
from corpusloom.functions import text as t
from corpusloom.operators import evidence, html_pages, markdown_fields, matching
from corpusloom.plans.text_queries import FIELD_ROWS, SQL as TEXT_SQL, _ground
from corpusloom.runtime import table


def atoms_explode(spark, d):
    docs = table(spark, d, "disease_documents")
    return evidence.atoms(docs, "document_no", ["disease_name", "summary"], ["aliases"])


def evidence_ground(spark, d):
    c = table(spark, d, "clean_content")
    rows = markdown_fields.table_fields(c, "content_id", "markdown").withColumn("quote", F.substring("value", 1, 40))
    q = evidence.quoted_values(rows.withColumn("value", F.concat("value", F.lit(" x"))), c, "content_id", "value", "quote", "plain_text")
    return q.groupBy("field", "support").agg(F.count("*").alias("n"))


def tab_states(spark, d):
    keys = ["job_id", "item_id", "tab_key"]
    return evidence.tab_pairs(table(spark, d, "raw_tabs"), table(spark, d, "clean_content"), keys).groupBy("tab_key", "state").agg(F.count("*").alias("tabs"))


def detail_join(spark, d):
    raw = table(spark, d, "raw_tabs").select("page_id", "tab_key")
    details = table(spark, d, "raw_tab_details").select(F.col("tab_page_id").alias("page_id"), "available")
    return raw.join(details, "page_id").groupBy("tab_key").agg(F.count("*").alias("details"), F.count_if("available").alias("available"))


def detail_targets(spark, d):
    rows = table(spark, d, "raw_tab_details").where("trim(label) <> '' and trim(url) <> ''")
    return rows.groupBy("tab_page_id", "url").agg(F.min_by("label", "page_id").alias("label"), F.min("page_id").alias("page_id"))


def page_kinds(spark, d):
    tabs = table(spark, d, "raw_tabs").select("page_id", F.col("source_url").alias("url"), "html")
    p = html_pages.pages_read(tabs, "page_id", "html", "url")
    details = F.size(F.filter("links", lambda x: x["url"].rlike(urls.DETAIL)))
    kind = evidence.page_kind(F.col("plain_text"), F.size("links"), details, F.coalesce(urls.is_detail(F.col("url")), F.lit(False)), F.col("forms") > 0)
    return p.select("page_id", kind.alias("k")).groupBy("k.kind").agg(F.count("*").alias("pages"), F.max("k.confidence").alias("best"))


def snapshot_digests(spark, d):
    rows = table(spark, d, "clean_content").where("job_id is not null and item_id is not null and tab_key is not null")
    one = rows.groupBy("job_id", F.lower(F.trim("item_id")).alias("item_id"), "tab_key").agg(F.max("content_hash").alias("h"))
    part = F.struct(F.concat(F.lit("tab:"), "tab_key").alias("key"), F.col("h").alias("value"))
    maps = one.groupBy("job_id", "item_id").agg(F.collect_list(part).alias("parts"))  # an item's few tabs
    m = arrays.component_map(F.col("parts"))
    return maps.select("job_id", "item_id", F.size(m).alias("components"), arrays.map_digest(m).alias("digest"))


def content_lengths(spark, d):
    c = table(spark, d, "clean_content")
    return c.select("content_id", arrays.total_length(F.coalesce("headings", F.array().cast("array<string>"))).alias("heading_chars"),
                    F.sha2(arrays.joined_texts(F.coalesce("headings", F.array().cast("array<string>"))), 256).alias("joined"))


def warning_fields(spark, d):
    rows = table(spark, d, "report_items").select(F.explode(arrays.after_prefix(F.col("warnings"), "missing_field:")).alias("field"))
    return rows.groupBy("field").agg(F.count("*").alias("n"))


def over_budget(spark, d):
    c = table(spark, d, "clean_content").select("content_id", F.length("markdown").alias("n_chars"), F.regexp_count("markdown", F.lit(r"(?m)^#{1,6}\s")).alias("chunks"))
    return c.where("n_chars > 20000 or chunks > 40")


def nested_aliases(spark, d):
    rows = table(spark, d, "disease_documents").select("document_no", F.size(evidence.merged_with_source(F.array("disease_name"), F.col("aliases"))).alias("names"))
    return rows.where("names is not null")


def label_clean(spark, d):
    rows = table(spark, d, "search_candidates").where("label is not null")
    return rows.groupBy(t.joined_highlight(F.col("label")).alias("label")).agg(F.count("*").alias("n"))


def candidate_scores(spark, d):
    rows = table(spark, d, "search_candidates").where("url is not null")
    return rows.select("candidate_id", urls.candidate_score(F.col("url"), F.col("label")).alias("score"))


def best_candidate(spark, d):
    rows = table(spark, d, "search_candidates").where("url is not null and search_query is not null")
    score = urls.candidate_score(F.col("url"), F.col("label"))
    order = F.struct((-score).alias("s"), "url", "candidate_id")
    return rows.groupBy(F.lower(F.trim("search_query")).alias("q")).agg(F.min_by("candidate_id", order).alias("candidate_id"), F.max(score).alias("score"))


def _read(spark, d):
    tabs = table(spark, d, "raw_tabs").select("page_id", F.col("source_url").alias("url"), "html")
    return html_pages.pages_read(tabs, "page_id", "html", "url")


def listing_items(spark, d):
    pages = _read(spark, d)
    return evidence.listed_items(pages, "page_id", "url", "links", ["www.manuals.example", "manuals.example"])


def page_observations(spark, d):
    return evidence.observations(_read(spark, d), "page_id")


def resolution_audit(spark, d):
    asked = table(spark, d, "search_candidates").where("search_query is not null")
    labels = matching.unique_candidates(table(spark, d, "search_candidates").where("label is not null"), "candidate_id", "label", "url")
    found = matching.tiered_matches(asked, labels, "search_query", "candidate_id", "label")
    done = table(spark, d, "search_candidates").where("rank_no = 1").select("candidate_id")
    return evidence.resolutions(found, asked, "search_query", done, "candidate_id").groupBy("outcome").agg(F.count("*").alias("names"))


def hash_fidelity(spark, d):
    rows = table(spark, d, "clean_content").where("markdown is not null")
    same = F.lower("content_hash") == t.content_hash(t.nfc(F.col("markdown")))
    return rows.groupBy("tab_key").agg(F.count("*").alias("contents"), F.count_if(same).alias("same"), F.count_if(F.col("content_hash").isNull()).alias("unhashed"))


QUERIES = [
    candidate_scores, best_candidate, listing_items, page_observations, resolution_audit, hash_fidelity,
    atoms_explode, evidence_ground, tab_states, detail_join, detail_targets, page_kinds, snapshot_digests, content_lengths,
    warning_fields, over_budget, nested_aliases, label_clean,
]

PATH = "lower(regexp_extract(url, '^[^:]*://[^/?#]*([^?#]*)', 1))"
SCORES = f"""SELECT candidate_id, url, search_query, CAST(CASE WHEN len(list_filter([{", ".join(repr(w) for w in urls.NO_CONTENT)}], lambda w: contains(said, w))) > 0 OR regexp_matches(url, '[?#].') THEN 0
  WHEN regexp_matches(path, '/(en_)?[^/]+\\.html?$') AND starts_with(path, '/en_') THEN 95 WHEN regexp_matches(path, '/(en_)?[^/]+\\.html?$') THEN 88 WHEN starts_with(path, '/en_') THEN 92
  WHEN len(list_filter([{", ".join(repr(w) for w in urls.CONTENT)}], lambda w: contains(said, w))) > 0 THEN 72 ELSE 0 END AS INTEGER) AS score
  FROM (SELECT *, {PATH} AS path, {PATH} || ' ' || lower(coalesce(label, '')) AS said FROM search_candidates WHERE url IS NOT NULL)"""

SQL = {
    "candidate_scores": f"SELECT candidate_id, score FROM ({SCORES})",
    "best_candidate": f"SELECT lower(trim(search_query)) AS q, arg_min(candidate_id, (-score, url, candidate_id)) AS candidate_id, max(score) AS score FROM ({SCORES}) WHERE search_query IS NOT NULL GROUP BY 1",
    "hash_fidelity": f"""SELECT tab_key, count(*) AS contents, count(*) FILTER (lower(content_hash) = digest) AS same, count(*) FILTER (content_hash IS NULL) AS unhashed
        FROM clean_content JOIN ({TEXT_SQL['md_normal_hash']}) USING (content_id) GROUP BY tab_key""",
    "atoms_explode": f"""SELECT *, sha256({_ground('value')}) AS digest FROM (
        SELECT document_no, 'disease_name' AS field, disease_name AS value FROM disease_documents UNION ALL SELECT document_no, 'summary', summary FROM disease_documents
        UNION ALL SELECT document_no, 'aliases', unnest(aliases) FROM disease_documents) WHERE trim(value) <> ''""",
    "evidence_ground": f"""WITH r AS ({FIELD_ROWS}), s AS (SELECT content_id, {_ground('plain_text')} AS src FROM clean_content),
        q AS (SELECT field, {_ground("(value || ' x')")} AS v, {_ground('substr(value, 1, 40)')} AS q, src FROM r LEFT JOIN s USING (content_id))
        SELECT field, CASE WHEN coalesce(v <> '' AND contains(src, v), false) THEN 'exact' WHEN coalesce(q <> '' AND contains(src, q), false) THEN 'quote' ELSE 'not_found' END AS support, count(*) AS n FROM q GROUP BY ALL""",
    "tab_states": """WITH r AS (SELECT job_id, item_id, tab_key, bool_or(coalesce(available, false) AND coalesce(length(html), 0) > 0) AS a FROM raw_tabs GROUP BY ALL),
        c AS (SELECT job_id, item_id, tab_key, max(coalesce(length(plain_text), 0)) AS n FROM clean_content GROUP BY ALL)
        SELECT r.tab_key, CASE WHEN NOT a THEN 'unavailable' WHEN coalesce(n, 0) > 0 THEN 'clean' ELSE 'lost' END AS state, count(*) AS tabs FROM r LEFT JOIN c USING (job_id, item_id, tab_key) GROUP BY ALL""",
    "detail_join": "SELECT tab_key, count(*) AS details, count(*) FILTER (d.available) AS available FROM raw_tabs r JOIN raw_tab_details d ON d.tab_page_id = r.page_id GROUP BY tab_key",
    "detail_targets": "SELECT tab_page_id, url, arg_min(label, page_id) AS label, min(page_id) AS page_id FROM raw_tab_details WHERE trim(label) <> '' AND trim(url) <> '' GROUP BY tab_page_id, url",
    "snapshot_digests": """WITH o AS (SELECT job_id, lower(trim(item_id)) AS item_id, tab_key, max(content_hash) AS h FROM clean_content WHERE job_id IS NOT NULL AND item_id IS NOT NULL AND tab_key IS NOT NULL GROUP BY ALL)
        SELECT job_id, item_id, CAST(count(*) AS INTEGER) AS components, sha256(string_agg('tab:' || tab_key || chr(31) || coalesce('=' || h, '-'), chr(30) ORDER BY tab_key)) AS digest FROM o GROUP BY ALL""",
    "content_lengths": "SELECT content_id, CAST(length(array_to_string(coalesce(headings, []), '')) AS INTEGER) AS heading_chars, sha256(array_to_string(list_filter(coalesce(headings, []), lambda x: x <> ''), chr(10))) AS joined FROM clean_content",
    "warning_fields": "SELECT substr(w, 15) AS field, count(*) AS n FROM (SELECT unnest(warnings) AS w FROM report_items) WHERE starts_with(w, 'missing_field:') GROUP BY 1",
    "over_budget": r"SELECT content_id, CAST(n_chars AS INTEGER) AS n_chars, CAST(chunks AS INTEGER) AS chunks FROM (SELECT content_id, length(markdown) AS n_chars, len(regexp_extract_all(markdown, '(?m)^#{1,6}\s')) AS chunks FROM clean_content) WHERE n_chars > 20000 OR chunks > 40",
    "nested_aliases": """SELECT document_no, CAST(1 + len(list_filter(coalesce(aliases, []), lambda m: NOT contains(replace(lower(disease_name), 'ß', 'ss'), replace(lower(m), 'ß', 'ss')))) AS INTEGER) AS names FROM disease_documents WHERE disease_name IS NOT NULL""",
}
