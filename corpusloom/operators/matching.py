"""Names against labels: tiers of matching, shorter queries, representatives."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from corpusloom.functions.text import collapse, fold, is_plural_pair, label_parts, search_name
from corpusloom.functions.urls import canonical_url, host, part

#: Words that carry no meaning of their own in a name.
CONNECTORS = tuple("a an and for in of on or the to with without".split())
MOST_QUERIES = 8
TIERS = ("exact", "alias", "plural")


def distinct_names(names: DataFrame, name: str, order: str) -> DataFrame:
    """Names on one line, the first of those equal without case; blank ones left out."""
    clean = names.withColumn(name, collapse(F.col(name))).where(F.col(name) != "")
    first = F.min_by(F.col(name), F.col(order))
    return clean.groupBy(fold(F.col(name)).alias("folded")).agg(F.min(order).alias(order), first.alias(name)).select(order, name)


def unique_candidates(candidates: DataFrame, key: str, label: str, url: str, hosts: list[str] | None = None) -> DataFrame:
    """(key, label): the first candidate of each canonical https address, of ``hosts`` only if given."""
    safe = F.lower(part(F.col(url), 1)) == "https"
    if hosts is not None:
        safe = safe & host(F.col(url)).isin(*hosts)
    first = F.min_by(F.struct(key, label), F.col(key))
    kept = candidates.where(safe & F.col(key).isNotNull()).groupBy(canonical_url(F.col(url)).alias("__u")).agg(first.alias("c"))
    return kept.select("c.*")


def match_keys(labels: DataFrame, key: str, label: str) -> DataFrame:
    """(key, label, tier, match_key): all names under which a label can be found.

    The plural tier is keyed by each possible singular of the name, so that every tier is an
    equality join and no label is compared with every query.
    """
    exact = search_name(F.col(label))
    aliases = F.transform(F.slice(label_parts(F.col(label)), 1, F.greatest(F.size(label_parts(F.col(label))) - 1, F.lit(0))), search_name)
    entries = F.concat(
        F.array(F.struct(F.lit("exact").alias("tier"), exact.alias("match_key"))),
        F.transform(aliases, lambda x: F.struct(F.lit("alias").alias("tier"), x.alias("match_key"))),
        F.transform(singulars(exact), lambda x: F.struct(F.lit("plural").alias("tier"), x.alias("match_key"))),
    )
    return labels.select(key, label, F.inline(F.array_distinct(entries))).where("match_key <> ''")


def singulars(name: Column) -> Column:
    """A name with each word that its last one may be the plural of, itself included; others may share one."""
    made = (F.regexp_replace(name, end, to) for end, to in (("s$", ""), ("es$", ""), ("ies$", "y")))
    return F.array_distinct(F.array(name, *made))


def tiered_matches(queries: DataFrame, labels: DataFrame, query: str, key: str, label: str) -> DataFrame:
    """(query, tier, n_candidates, key): of the best tier that has any label, its only one.

    Exact comes before alias, alias before plural; a tier with several labels is ambiguous
    and chooses none. Queries that match nothing give no row.
    """
    asked = queries.select(query).distinct().withColumn("__q", search_name(F.col(query)))
    same = F.array(*[F.struct(F.lit(t).alias("tier"), F.col("__q").alias("match_key")) for t in TIERS if t != "plural"])
    keyed = F.concat(same, F.transform(singulars(F.col("__q")), lambda x: F.struct(F.lit("plural").alias("tier"), x.alias("match_key"))))
    # copies of a label are one row of the join
    labelled = match_keys(labels, key, label).groupBy("tier", "match_key", label).agg(
        F.count_distinct(key).alias("__n"), F.min(key).alias(key)
    )
    found = asked.select(query, F.inline(keyed)).join(labelled, ["tier", "match_key"])
    found = found.where((F.col("tier") != "plural") | is_plural_pair(F.col(query), F.col(label)))
    found = found.drop("match_key").distinct()  # several singulars may bring up the same pair
    rank = F.array_position(F.array(*[F.lit(t) for t in TIERS]), F.col("tier"))
    best = found.groupBy(query, rank.alias("rank"), "tier").agg(
        F.sum("__n").alias("n_candidates"), F.min(key).alias(key)
    )
    first = F.row_number().over(Window.partitionBy(query).orderBy("rank"))
    return best.withColumn("__n", first).where("__n = 1").select(
        query, "tier", "n_candidates", F.when(F.col("n_candidates") == 1, F.col(key)).alias(key)
    )


def shorter_queries(names: DataFrame, key: str, name: str) -> DataFrame:
    """(key, query_no, query): a name, its slash aliases, then ever shorter forms, at most eight.

    Shorter forms drop one or two last or first words that carry meaning, or all connectors,
    and are only made of names that keep at least three such words. Forms equal by
    ``search_name`` come once.
    """
    base = F.filter(
        F.transform(F.concat(F.array(F.col(name)), F.split(F.col(name), r"(?U)\s+/\s+")), collapse), lambda x: x != ""
    )
    forms = F.flatten(F.transform(F.filter(base, lambda x: ~x.contains("/")), _forms))
    every = F.concat(base, forms)
    numbered = F.transform(every, lambda x, i: F.struct(search_name(x).alias("id"), i.alias("i"), x.alias("q")))
    # the first of each identity: no earlier entry has it
    kept = F.filter(
        numbered, lambda x: (x["id"] != "") & ~F.exists(numbered, lambda y: (y["i"] < x["i"]) & (y["id"] == x["id"]))
    )
    rows = names.select(key, F.posexplode(F.slice(F.transform(kept, lambda x: x["q"]), 1, MOST_QUERIES)).alias("pos", "query"))
    return rows.select(key, (F.col("pos") + 1).alias("query_no"), "query")


def _forms(name: Column) -> Column:
    words = F.transform(F.split(name, " "), lambda w, i: F.struct(i.alias("i"), w.alias("w")))
    meant = F.filter(words, lambda x: ~F.regexp_replace(fold(x["w"]), r"(?U)^\W+|\W+$", "").isin(*CONNECTORS))
    text = lambda xs: F.array_join(F.transform(xs, lambda x: x["w"]), " ")
    n = F.size(meant)
    prefix = lambda k: F.when(n >= 3 + k, text(F.filter(words, lambda x: x["i"] < F.try_element_at(meant, n - (k - 1))["i"])))
    suffix = lambda k: F.when(n >= 3 + k, text(F.slice(meant, F.lit(1 + k), F.greatest(n - k, F.lit(0)))))
    capital = lambda x: F.concat(F.upper(F.substring(x, 1, 1)), F.expr("''"), x.substr(F.lit(2), F.length(x)))
    made = F.array(prefix(1), prefix(2), F.when(n >= 4, text(meant)), capital(suffix(1)), capital(suffix(2)))
    return F.when(n >= 4, F.array_compact(made)).otherwise(F.array().cast("array<string>"))


def representative(variants: DataFrame, key: str, ok: str, hits: str, order: str) -> DataFrame:
    """Of the searches of a name the first good one with hits, else the first good one, else the first."""
    rank = F.when(F.col(ok) & (F.col(hits) > 0), 0).when(F.col(ok), 1).otherwise(2)
    rest = [c for c in variants.columns if c != key]
    best = F.min_by(F.struct(*rest), F.struct(rank.alias("r"), F.col(order).alias("o")))
    return variants.groupBy(key).agg(best.alias("v")).select(key, "v.*")
