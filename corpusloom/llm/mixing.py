"""Mixing sources to target weights within a budget of tokens."""

from __future__ import annotations

import math
from collections.abc import Sequence

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from corpusloom.llm.bpe import token_counts
from corpusloom.runtime import cut, ship

DOCUMENTS_PER_BLOCK = 1024
STEPS = 200


def temperature_weights(
    sizes: Sequence[float], exponent: float
) -> list[float]:
    """Shares proportional to size to the power ``exponent``: 1 natural, 0 equal. Zero sizes get 0."""
    top = max(sizes, default=0)
    raw = [(s / top) ** exponent if s > 0 else 0.0 for s in sizes]
    total = sum(raw)
    return [r / total for r in raw] if total else raw


def bisect_exponent(
    sizes: Sequence[float], wanted: float, limits: Sequence[float], entropy: float | None = None
) -> float:
    """The exponent in 0..1 of the flattest mix that keeps to the limits and to an entropy.

    ``limits`` are the most tokens a source may give (size times repeats) of ``wanted`` in
    all; ``entropy`` (nats) is the least spread above which no more flattening is asked for.
    If not even the natural shares keep to the limits, the exponent is 1.
    """

    def fits(x: float) -> bool:
        shares = temperature_weights(sizes, x)
        return all(w * wanted <= m * (1 + 1e-12) for w, m in zip(shares, limits, strict=True))

    def spread(x: float) -> float:
        return -sum(w * math.log(w) for w in temperature_weights(sizes, x) if w > 0)

    def enough(x: float) -> bool:
        return fits(x) and (entropy is None or spread(x) <= entropy)

    if enough(0.0):
        return 0.0
    low, high = 0.0, 1.0
    for _ in range(STEPS):
        mid = (low + high) / 2
        low, high = (low, mid) if enough(mid) else (mid, high)
    return high


def capped_budgets(weights: Sequence[float], limits: Sequence[float], wanted: float) -> list[float]:
    """Tokens of each source: proportional to the weights, none above its limit.

    The common factor is bisected until the budgets add up to ``wanted``; what a limited
    source cannot give goes to the others in proportion. If all are at their limits, the
    mix stays smaller than wanted.
    """
    open_ = [(w, m) for w, m in zip(weights, limits, strict=True) if w > 0 and m > 0]
    if not open_ or wanted <= 0:
        return [0.0] * len(weights)
    low, high = 0.0, max(m / w for w, m in open_)
    for _ in range(STEPS):
        mid = (low + high) / 2
        low, high = (mid, high) if sum(min(m, mid * w) for w, m in open_) < wanted else (low, mid)
    return [min(m, high * w) if w > 0 and m > 0 else 0.0 for w, m in zip(weights, limits, strict=True)]


SHARES = "mix_id string, source string, target_share double, size_tokens bigint, max_repeats int, wanted_tokens double, budget double"


def mix_budgets(totals: DataFrame, plans: DataFrame, targets: DataFrame) -> DataFrame:
    """A budget for each source of each mix (columns of ``SHARES``).

    ``totals`` (source, size_tokens). Weights are made to add up to 1 over the sources of a
    mix that have tokens and a weight above 0; of repeated target rows the largest counts.
    Null, zero or negative weights, null or zero max_repeats, null mixes and sources without
    documents get no budget.
    """
    everything = totals.agg(F.coalesce(F.sum("size_tokens"), F.lit(0)).alias("all_tokens")).scalar()
    wanted = (
        plans.where(F.col("mix_id").isNotNull())
        .groupBy("mix_id")
        .agg(F.max("size_ratio").alias("size_ratio"))
        .select("mix_id", (F.coalesce("size_ratio", F.lit(0.0)) * everything).alias("wanted_tokens"))
    )
    rows = (
        targets.where(F.col("source").isNotNull())
        .groupBy("mix_id", "source")
        .agg(F.max(F.struct("target_weight", "max_repeats")).alias("t"))
        .select("mix_id", "source", F.col("t.target_weight").alias("weight"), F.col("t.max_repeats").alias("max_repeats"))
        .join(wanted, "mix_id")
        .join(totals, "source", "left")
    )

    def solve(group: pd.DataFrame) -> pd.DataFrame:
        sizes = group["size_tokens"].fillna(0).astype("int64")
        repeats = group["max_repeats"].fillna(0).clip(lower=0).astype("int64")
        weights = group["weight"].fillna(0).clip(lower=0).astype(float).where(sizes > 0, 0.0)
        share = weights / weights.sum() if weights.sum() > 0 else weights
        budget = capped_budgets(list(share), list((sizes * repeats).astype(float)), float(group["wanted_tokens"].iloc[0]))
        return pd.DataFrame(
            {
                "mix_id": group["mix_id"], "source": group["source"], "target_share": share, "size_tokens": sizes,
                "max_repeats": repeats.astype("int32"), "wanted_tokens": group["wanted_tokens"], "budget": budget,
            }
        )

    ship(totals.sparkSession)
    return rows.groupBy("mix_id").applyInPandas(solve, SHARES)


def temperature_budgets(totals: DataFrame, size_ratio: float, max_repeats: int, entropy: float | None = None) -> DataFrame:
    """Budgets (``SHARES``) of a mix without targets: natural shares flattened by temperature,
    as far as the repetition limit and the entropy allow."""

    def solve(group: pd.DataFrame) -> pd.DataFrame:
        sizes = group["size_tokens"].astype(float)
        wanted = sizes.sum() * size_ratio
        exponent = bisect_exponent(list(sizes), wanted, list(sizes * max_repeats), entropy)
        share = pd.Series(temperature_weights(list(sizes), exponent), index=group.index)
        budget = (share * wanted).clip(upper=sizes * max_repeats)
        return pd.DataFrame(
            {
                "mix_id": "temperature", "source": group["source"], "target_share": share, "size_tokens": group["size_tokens"],
                "max_repeats": max_repeats, "wanted_tokens": wanted, "budget": budget,
            }
        )

    ship(totals.sparkSession)
    return totals.where("source is not null and size_tokens > 0").groupBy(F.lit("all").alias("one")).applyInPandas(solve, SHARES)


def _order(*of: str) -> Column:
    """A place in a permutation: each mix has its own, the same on every run."""
    return F.xxhash64(F.lit("mix"), *of)


def realise(sizes: DataFrame, budgets: DataFrame) -> DataFrame:
    """(mix_id, source, doc_id, n_tokens, repeats): documents whose tokens meet the budgets.

    ``sizes`` (doc_id, source, n_tokens). Each document of a source occurs as often as the
    source fits the budget as a whole. The rest is one more, partial pass over a permutation
    of blocks: whole blocks as long as they fit, and of the block at the border single
    documents in their permuted order, each taken if it still fits. Running sums are over
    blocks, and over documents of one block only, so that no task holds a whole source.
    Texts without tokens, and null sources, are in no mix.
    """
    has = sizes.where((F.col("n_tokens") > 0) & F.col("source").isNotNull())
    counts = has.groupBy("source").agg(F.count("*").alias("documents"))
    passes = (
        budgets.where("budget > 0 and size_tokens > 0")
        .join(counts, "source")
        .withColumn("full", F.least(F.floor(F.col("budget") / F.col("size_tokens") + 1e-9), F.col("max_repeats").cast("long")))
        .withColumn("rest", F.when(F.col("full") < F.col("max_repeats"), F.col("budget") - F.col("full") * F.col("size_tokens")).otherwise(0.0))
        .withColumn("blocks", F.ceil(F.col("documents") / DOCUMENTS_PER_BLOCK))
        .select("mix_id", "source", "full", "rest", "blocks")
    )
    placed = has.join(passes, "source").withColumn("block", F.pmod(_order("mix_id", "doc_id"), F.col("blocks")))
    running = Window.partitionBy("mix_id", "source").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    blocks = (
        placed.where("rest >= 1")
        .groupBy("mix_id", "source", "block", "rest")
        .agg(F.sum("n_tokens").alias("block_tokens"))
        .withColumn("before", F.coalesce(F.sum("block_tokens").over(running), F.lit(0)))
        .where("before < rest")
        .select(
            "mix_id", "source", "block", (F.col("rest") - F.col("before")).alias("left"),
            (F.col("before") + F.col("block_tokens") <= F.col("rest")).alias("whole"),
        )
    )
    marked = placed.join(blocks, ["mix_id", "source", "block"], "left")
    border = marked.where("not whole").select("mix_id", "source", "doc_id", "n_tokens", "left", _order("doc_id", "mix_id").alias("place"))

    def fill(group: pd.DataFrame) -> pd.DataFrame:
        left, taken = float(group["left"].iloc[0]), []
        group = group.sort_values(["place", "doc_id"])
        for i, n in zip(group.index, group["n_tokens"], strict=True):
            if n <= left:
                taken.append(i)
                left -= n
        return group.loc[taken, ["mix_id", "source", "doc_id"]]

    ship(sizes.sparkSession)
    kind = sizes.schema["doc_id"].dataType.simpleString()
    extra = border.groupBy("mix_id", "source").applyInPandas(fill, f"mix_id string, source string, doc_id {kind}")
    single = extra.select("mix_id", "doc_id", F.lit(1).alias("single"))
    return (
        marked.join(single, ["mix_id", "doc_id"], "left")
        .withColumn("repeats", (F.col("full") + F.when(F.col("whole"), 1).otherwise(F.coalesce("single", F.lit(0)))).cast("int"))
        .where("repeats > 0")
        .select("mix_id", "source", "doc_id", "n_tokens", "repeats")
    )


def document_sizes(documents: DataFrame, **how) -> DataFrame:
    """(doc_id, source, n_tokens), counted once and kept, as totals and choice both need it."""
    return cut(token_counts(documents, ["doc_id", "source"], **how))


def source_totals(sizes: DataFrame) -> DataFrame:
    return sizes.groupBy("source").agg(F.sum("n_tokens").alias("size_tokens"))


def mixed(documents: DataFrame, plans: DataFrame, targets: DataFrame, **how) -> DataFrame:
    """(mix_id, source, doc_id, n_tokens, repeats) of every mix of ``plans``; see ``realise``.

    Empty plans, targets or documents give no rows; further columns are ignored.
    """
    sizes = document_sizes(documents, **how)
    return realise(sizes, cut(mix_budgets(source_totals(sizes), plans, targets)))


def reached_shares(chosen: DataFrame, budgets: DataFrame) -> DataFrame:
    """Of each source of each mix: its target share, and the share and tokens really reached."""
    got = chosen.groupBy("mix_id", "source").agg(
        F.sum(F.col("n_tokens") * F.col("repeats")).alias("tokens"),
        F.max("repeats").alias("most_repeats"),
        F.count("*").alias("documents"),
    )
    of_mix = Window.partitionBy("mix_id")
    tokens = F.coalesce("tokens", F.lit(0))
    return (
        budgets.join(got, ["mix_id", "source"], "left")
        .withColumn("tokens", tokens)
        .withColumn("all", F.sum("tokens").over(of_mix))
        .select(
            "mix_id", "source", "target_share", (F.col("tokens") / F.nullif(F.col("all"), F.lit(0))).alias("reached_share"),
            "tokens", "size_tokens", "max_repeats", F.coalesce("most_repeats", F.lit(0)).alias("most_repeats"),
            F.coalesce("documents", F.lit(0)).alias("documents"), "wanted_tokens", F.col("all").alias("mix_tokens"),
        )
    )


def share_report(documents: DataFrame, plans: DataFrame, targets: DataFrame, **how) -> DataFrame:
    """``reached_shares`` of every mix of ``plans``."""
    sizes = document_sizes(documents, **how)
    budgets = cut(mix_budgets(source_totals(sizes), plans, targets))
    return reached_shares(realise(sizes, budgets), budgets)


def temperature_report(documents: DataFrame, size_ratio: float, max_repeats: int, entropy: float | None = None, **how) -> DataFrame:
    """``reached_shares`` of a mix without targets, flattened by temperature."""
    sizes = document_sizes(documents, **how)
    budgets = cut(temperature_budgets(source_totals(sizes), size_ratio, max_repeats, entropy))
    return reached_shares(realise(sizes, budgets), budgets)
