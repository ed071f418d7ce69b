"""What changed between full snapshots, by Merkle trees over hash ranges of the keys."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from corpusloom.runtime import cut

FANOUT_BITS = 4
OUTER_SPACE = " \t\r\n"


def clean_key(name: str) -> Column:
    """Letter case and outer white space do not tell keys apart."""
    return F.lower(F.btrim(F.col(name), F.lit(OUTER_SPACE)))


def snapshot_order(jobs: DataFrame) -> DataFrame:
    """(job_id, plugin, seq, last_seq): the completed jobs of each plugin in order of creation.

    Repeated job rows count once. Jobs of equal created_at follow each other by job_id;
    a null created_at comes first. Jobs without job_id are left out.
    """
    done = (
        jobs.where((F.col("status") == "completed") & F.col("job_id").isNotNull())
        .groupBy("job_id")
        .agg(F.min("plugin").alias("plugin"), F.min("created_at").alias("created_at"))
    )
    by_plugin = Window.partitionBy("plugin")
    return done.select(
        "job_id",
        "plugin",
        F.row_number().over(by_plugin.orderBy(F.col("created_at").asc_nulls_first(), "job_id")).alias("seq"),
        F.count("*").over(by_plugin).cast("int").alias("last_seq"),
    )


def snapshot_members(items: DataFrame, order: DataFrame) -> DataFrame:
    """(plugin, seq, last_seq, item_id, snapshot_hash): one row for each item of each snapshot of ``order``.

    Rows are combined before the shuffle, so that an item with very many rows costs
    no more than any other. Of several known hashes the one received last holds
    (then the greatest report_row_id, then the greatest hash); blank hashes are unknown.
    """
    known = F.lower(F.btrim(F.col("snapshot_hash"), F.lit(OUTER_SPACE)))
    rows = items.where(F.col("item_id").isNotNull() & F.col("job_id").isNotNull()).select(
        "job_id",
        clean_key("item_id").alias("item_id"),
        F.when(known != "", F.struct("received_at", "report_row_id", known.alias("h"))).alias("best"),
    )
    return (
        rows.join(order, "job_id")
        .groupBy("plugin", "seq", "last_seq", "item_id")
        .agg(F.max("best").alias("best"))
        .select("plugin", "seq", "last_seq", "item_id", F.col("best.h").alias("snapshot_hash"))
    )


def tree_depth(rows: int, rows_per_leaf: int = 256) -> int:
    """Levels below the root, so that a leaf holds about rows_per_leaf rows of all snapshots."""
    return min(8, max(1, math.ceil(math.log(max(rows, 1) / rows_per_leaf + 1, 2**FANOUT_BITS))))


def _leaf(depth: int) -> Column:
    return F.shiftrightunsigned(F.xxhash64("item_id"), 64 - FANOUT_BITS * depth)


def changed_ranges(members: DataFrame, depth: int) -> DataFrame:
    """(plugin, node, pairs): the leaves of the hash tree and the snapshot pairs in which they differ.

    A node's digest of a snapshot is the exclusive or of its rows' 128-bit digests, so
    that parents follow from their children without another pass over the rows. From
    the root down, only the children of nodes that differ are compared; pair ``i`` is
    snapshot ``i`` against ``i - 1``. Digests of equal 128 bits are taken as equal.
    """
    known = F.coalesce(F.col("snapshot_hash"), F.lit(""))
    leaves = members.groupBy("plugin", "last_seq", "seq", _leaf(depth).alias("node")).agg(
        F.bit_xor(F.xxhash64(F.lit(1), "item_id", known)).alias("a"),
        F.bit_xor(F.xxhash64(F.lit(2), known, "item_id")).alias("b"),
    )
    changed = None
    for level in range(depth + 1):
        up = FANOUT_BITS * (depth - level)
        nodes = leaves
        if up:
            nodes = leaves.groupBy("plugin", "last_seq", "seq", F.shiftrightunsigned("node", up).alias("node")).agg(
                F.bit_xor("a").alias("a"), F.bit_xor("b").alias("b")
            )
        # at most one entry for each snapshot
        nodes = nodes.groupBy("plugin", "node").agg(
            F.first("last_seq").alias("last_seq"),
            F.map_from_entries(F.collect_list(F.struct("seq", F.struct("a", "b")))).alias("digests"),
        )
        pairs = F.when(F.col("last_seq") > 1, F.sequence(F.lit(2), F.col("last_seq"))).otherwise(F.array().cast("array<int>"))
        if changed is not None:
            above = changed.select("plugin", F.col("node").alias("parent"), F.col("pairs").alias("open"))
            nodes = nodes.alias("n").join(
                above.alias("u"),
                F.col("n.plugin").eqNullSafe(F.col("u.plugin"))
                & (F.shiftrightunsigned("n.node", FANOUT_BITS) == F.col("u.parent")),
            ).select("n.*", "open")
            pairs = F.col("open")
        differs = F.filter(pairs, lambda i: ~F.try_element_at("digests", i).eqNullSafe(F.try_element_at("digests", i - 1)))
        changed = nodes.select("plugin", "node", differs.alias("pairs")).where(F.size("pairs") > 0)
    return changed


def snapshot_changes(items: DataFrame, jobs: DataFrame, depth: int | None = None) -> DataFrame:
    """(job_id, item_id, change_kind) between each two consecutive snapshots of a plugin.

    job_id is the later job, change_kind 'added', 'removed' or 'changed'. An item whose
    hash is unknown in either snapshot has not changed. A completed job without any rows
    is an empty snapshot. Rows with a null item_id or job_id belong to no item and are
    left out; a blank item_id is an item of its own. Other columns, whatever their names,
    are ignored. Empty tables give no rows.

    Only rows of hash ranges whose digests differ are compared. Each item has at most one
    row in each snapshot by then, so that a group is never larger than the number of jobs.
    """
    if depth is None:
        depth = tree_depth(items.count())  # of Parquet, read from the footers
    order = cut(snapshot_order(jobs))  # one row for each job, needed in every step
    members = snapshot_members(items, order)
    ranges = changed_ranges(members, depth)
    rows = (
        members.withColumn("node", _leaf(depth))
        .alias("m")
        .join(
            ranges.alias("r"),
            F.col("m.plugin").eqNullSafe(F.col("r.plugin")) & (F.col("m.node") == F.col("r.node")),
        )
        .select("m.plugin", "m.seq", "m.last_seq", "m.item_id", "m.snapshot_hash", "r.pairs")
        .where(F.array_contains("pairs", F.col("seq")) | F.array_contains("pairs", F.col("seq") + 1))
    )
    history = Window.partitionBy("plugin", "item_id").orderBy("seq")
    before = F.lag(F.struct("seq", "snapshot_hash")).over(history)
    after = F.lead("seq").over(history)
    rows = rows.withColumns({"before": before, "after": after})
    here = F.array_contains("pairs", F.col("seq")) & (F.col("seq") > 1)
    follows = F.coalesce(F.col("before.seq") == F.col("seq") - 1, F.lit(False))
    arrived = F.when(
        here,
        F.when(~follows, F.lit("added")).when(
            F.col("before.snapshot_hash") != F.col("snapshot_hash"), F.lit("changed")
        ),
    )
    compared = F.array_contains("pairs", F.col("seq") + 1)
    left = compared & ~F.coalesce(F.col("after") == F.col("seq") + 1, F.lit(False))
    events = F.array(
        F.when(arrived.isNotNull(), F.struct(F.col("seq").alias("at"), arrived.alias("kind"))),
        F.when(left, F.struct((F.col("seq") + 1).alias("at"), F.lit("removed").alias("kind"))),
    )
    found = rows.select("plugin", "item_id", F.explode(F.array_compact(events)).alias("e"))
    return (
        found.alias("f")
        .join(
            order.alias("o"),
            F.col("f.plugin").eqNullSafe(F.col("o.plugin")) & (F.col("f.e.at") == F.col("o.seq")),
        )
        .select("o.job_id", "f.item_id", F.col("f.e.kind").alias("change_kind"))
    )
