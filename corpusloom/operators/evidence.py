"""Values against the texts they are said to come from."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from corpusloom.functions.text import fold, ground_text, search_name
from corpusloom.functions.urls import absolute_url, canonical_url, fingerprint, is_allowed, is_detail


def quoted_values(drafts: DataFrame, sources: DataFrame, key: str, value: str, quote: str, text: str) -> DataFrame:
    """``drafts`` with support and ``value`` corrected by its quote.

    support is 'exact' if the value stands in the source, 'quote' if only its quote does, which
    then takes its place, else 'not_found' and the value is null.
    """
    both = drafts.join(sources.select(key, ground_text(F.col(text)).alias("__s")), key, "left")
    stands = lambda c: F.coalesce((ground_text(c) != "") & F.col("__s").contains(ground_text(c)), F.lit(False))
    support = F.when(stands(F.col(value)), "exact").when(stands(F.col(quote)), "quote").otherwise("not_found")
    kept = F.when(F.col("support") == "exact", F.col(value)).when(F.col("support") == "quote", F.col(quote))
    return both.withColumn("support", support).withColumn(value, kept).drop("__s")


def merged_with_source(sure: Column, drafted: Column) -> Column:
    """Values of the source first, then drafted ones that no source value contains."""
    empty = F.array().cast("array<string>")
    a, b = F.coalesce(sure, empty), F.coalesce(drafted, empty)
    return F.concat(a, F.filter(b, lambda m: ~F.exists(a, lambda d: F.instr(fold(d), fold(m)) > 0)))


def atoms(documents: DataFrame, key: str, fields: list[str], lists: list[str]) -> DataFrame:
    """(key, field, value, digest): one row for each value of each field, blank ones left out."""

    def named(field: str, values: Column) -> Column:
        return F.transform(values, lambda v: F.struct(F.lit(field).alias("field"), v.alias("value")))

    arrays = [named(f, F.array(F.col(f))) for f in fields] + [named(f, F.col(f)) for f in lists]
    every = F.concat(*[F.coalesce(a, F.array().cast("array<struct<field:string,value:string>>")) for a in arrays])
    rows = documents.select(key, F.inline(F.filter(every, lambda x: F.trim(x["value"]) != "")))
    return rows.withColumn("digest", F.sha2(ground_text(F.col("value")), 256))


def tables_kept(source: DataFrame, clean: DataFrame, key: str) -> DataFrame:
    """(key, tables, kept): how many of a page's tables stand in the clean one with the same rows.

    Tables are (key, table_no, row_no, cells); white space and letter case of cells do not count.
    """

    def digests(rows: DataFrame) -> DataFrame:
        flat = F.regexp_replace(fold(F.col("cells")), r"(?U)\s+", "")
        # the rows of one table; as an array they are as long as the page they come from
        return rows.groupBy(key, "table_no").agg(F.sha2(F.to_json(F.sort_array(F.collect_list(F.struct("row_no", flat.alias("c"))))["c"]), 256).alias("d"))

    a, b = digests(source), digests(clean).select(key, "d").distinct().withColumn("__k", F.lit(1))
    return a.join(b, [key, "d"], "left").groupBy(key).agg(F.count("*").alias("tables"), F.count("__k").alias("kept"))


def tab_pairs(raw: DataFrame, clean: DataFrame, keys: list[str]) -> DataFrame:
    """Raw tabs with what became of them: status 'clean', 'lost' (available, but no clean text) or 'unavailable'.

    Of several rows of a tab the available one counts.
    """
    r = raw.groupBy(*keys).agg(F.bool_or(F.coalesce("available", F.lit(False)) & (F.coalesce(F.length("html"), F.lit(0)) > 0)).alias("available"))
    c = clean.groupBy(*keys).agg(F.max(F.coalesce(F.length("plain_text"), F.lit(0))).alias("n_chars"))
    both = r.join(c, keys, "left")
    return both.select(
        *keys, F.coalesce("n_chars", F.lit(0)).alias("n_chars"),
        F.when(~F.col("available"), "unavailable").when(F.coalesce("n_chars", F.lit(0)) > 0, "clean").otherwise("lost").alias("state"),
    )


def reusable(items: DataFrame, versions: DataFrame, key: str, version: list[str]) -> tuple[DataFrame, DataFrame]:
    """Items whose document can be kept, as nothing and no version changed, and those to make anew."""
    same = versions.select(key, *version).distinct()
    keep = items.where("unchanged").join(same, [key, *version], "left_semi")
    return keep, items.join(keep.select(key), key, "left_anti")


def page_kind(text: Column, links: Column, detail_links: Column, url_is_detail: Column, password_form: Column) -> Column:
    """(kind, confidence) of a page by the first rule that fits: login, blocked, list, detail, menu, unknown."""
    words = F.length(F.coalesce(text, F.lit("")))
    score = F.lit(0.35) * url_is_detail.cast("int") + F.lit(0.3) * (words >= 250).cast("int") + F.lit(0.15) * fold(text).rlike("cause|symptom|treatment|diagnosis").cast("int")
    rule = lambda kind, c: F.struct(F.lit(kind).alias("kind"), F.bround(c, 2).alias("confidence"))
    blocked = fold(text).rlike("captcha|access denied|please sign in|session has ended")
    return (
        F.when(password_form, rule("login", F.lit(1.0)))
        .when(F.coalesce(blocked, F.lit(False)) & (words < 400), rule("blocked", F.lit(1.0)))
        .when((score >= 0.65) & (words >= 250), rule("detail", score))
        .when(detail_links >= 3, rule("list", F.least(F.lit(0.7) + F.lit(0.05) * detail_links, F.lit(0.95))))
        .when(links >= 5, rule("menu", F.lit(0.8)))
        .otherwise(rule("unknown", F.least(F.coalesce(score, F.lit(0.0)), F.lit(0.6))))
    )


def decisions_in_order(offered: DataFrame, decisions: DataFrame, keys: list[str]) -> DataFrame:
    """Decisions with is_valid: whether what was chosen had been offered, and place, their number by key."""
    have = offered.groupBy(*keys).agg(F.collect_set("candidate_id").alias("__offered"))  # a page's candidates
    valid = F.coalesce(F.col("chosen").isNull() | F.array_contains("__offered", F.col("chosen")), F.lit(False))
    place = F.row_number().over(Window.partitionBy(*keys).orderBy("decided_at", "chosen"))
    return decisions.join(have, keys, "left").withColumn("is_valid", valid).withColumn("place", place).drop("__offered")


def valid_checkpoints(items: DataFrame, files: DataFrame, keys: list[str], required: list[str]) -> DataFrame:
    """(keys, is_valid): whether every required artifact of an item is there with the digest it was listed with.

    ``items`` (keys, name, sha256) as listed, ``files`` (keys, name, sha256) as found.
    """
    found = files.select(*keys, "name", F.col("sha256").alias("__d"))
    both = items.where(F.col("name").isin(*required)).join(found, [*keys, "name"], "left")
    good = F.count_if(F.coalesce(F.col("__d") == F.col("sha256"), F.lit(False)))
    return both.groupBy(*keys).agg((good == len(required)).alias("is_valid"))


def listed_items(pages: DataFrame, key: str, url: str, links: str, hosts: list[str]) -> DataFrame:
    """(key, target, label): pages of single items that a page links to, by canonical address.

    Links to other hosts and to the page itself are left out; of several labels the last counts.
    """
    each = pages.select(key, F.col(url).alias("__page"), F.posexplode(links).alias("__i", "__l"))
    target = canonical_url(absolute_url(F.col("__l.url"), F.col("__page")))
    rows = each.select(key, "__i", target.alias("target"), canonical_url(F.col("__page")).alias("__self"), F.col("__l.label").alias("label"))
    rows = rows.where(is_allowed(F.col("target"), hosts) & is_detail(F.col("target")) & (F.col("target") != F.col("__self")))
    return rows.groupBy(key, "target").agg(F.max_by("label", "__i").alias("label"))


def observations(pages: DataFrame, key: str, most_links: int = 80, most_headings: int = 40, most_chars: int = 30_000) -> DataFrame:
    """What a reader with a small window is shown of a page: a bounded view, with the page's fingerprint.

    The bounds are those of the view, and the whole page stays in its table.
    """
    text = F.substring("plain_text", 1, most_chars)
    return pages.select(
        key, "title", F.size(F.slice("links", 1, most_links)).alias("links"), F.size(F.slice("headings", 1, most_headings)).alias("headings"),
        F.length(text).alias("n_chars"), fingerprint(F.coalesce("url", F.lit("")), F.coalesce("title", F.lit("")), text).alias("fingerprint"),
    )


def resolutions(matches: DataFrame, asked: DataFrame, query: str, done: DataFrame, key: str) -> DataFrame:
    """(query, outcome): what became of each name: matched, existing (its item is done already), ambiguous or not_found."""
    names = asked.select(query).distinct()
    both = names.join(matches, query, "left").join(done.select(key).distinct().withColumn("__done", F.lit(True)), key, "left")
    outcome = F.when(F.col("tier").isNull(), "not_found").when(F.col(key).isNull(), "ambiguous").when(F.col("__done"), "existing").otherwise("matched")
    return both.select(query, outcome.alias("outcome"))


def attached_details(rows: DataFrame, details: DataFrame, key: str, label: str) -> DataFrame:
    """(key, label, url, place): details of a page joined to the rows that name them, each address once for a row."""
    d = details.select(key, search_name(F.col(label)).alias("__n"), "url", F.col("position").alias("__p"))
    both = rows.select(key, label, search_name(F.col(label)).alias("__n")).distinct().join(d, [key, "__n"])
    first = both.groupBy(key, label, "url").agg(F.min("__p").alias("__p"))
    return first.withColumn("place", F.row_number().over(Window.partitionBy(key, label).orderBy("__p", "url"))).drop("__p")
