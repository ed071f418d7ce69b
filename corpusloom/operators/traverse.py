"""Bounded traversal of link graphs."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from corpusloom.runtime import cut


def reach(edges: DataFrame, seeds: DataFrame, depth: int, parent: str = "parent", child: str = "child") -> DataFrame:
    """(root, node, depth, path): every node within ``depth`` links of a root, once by the shortest path.

    One join for each level; nodes seen on earlier levels are left out by an anti join, so
    that cycles end and diamonds are expanded once. Of equally short paths the least holds.
    Each level is kept in the shared folder, which bounds the lineage.
    """
    links = edges.where(F.col(parent).isNotNull() & F.col(child).isNotNull()).select(parent, child).distinct()
    level = seeds.select(F.col("root"), F.col("root").alias("node"), F.lit(0).alias("depth"), F.array("root").alias("path")).distinct()
    seen = level
    for d in range(1, depth + 1):
        step = (
            level.join(links, F.col("node") == F.col(parent))
            .groupBy("root", F.col(child).alias("node"))
            .agg(F.min("path").alias("path"))
            .join(seen.select("root", "node"), ["root", "node"], "left_anti")
        )
        level = cut(step.select("root", "node", F.lit(d).alias("depth"), F.concat("path", F.array("node")).alias("path")))
        seen = seen.union(level)
        if level.isEmpty():
            break
    return seen


def all_paths(edges: DataFrame, seeds: DataFrame, depth: int, parent: str = "parent", child: str = "child") -> DataFrame:
    """(root, node, depth, path): every path without a repeated node of at most ``depth`` links.

    This keeps each of the ways on which a node is found; there may be many more than nodes.
    """
    links = edges.where(F.col(parent).isNotNull() & F.col(child).isNotNull()).select(parent, child).distinct()
    level = seeds.select(F.col("root"), F.col("root").alias("node"), F.lit(0).alias("depth"), F.array("root").alias("path")).distinct()
    out = level
    for d in range(1, depth + 1):
        step = level.join(links, (F.col("node") == F.col(parent)) & ~F.array_contains("path", F.col(child)))
        level = step.select("root", F.col(child).alias("node"), F.lit(d).alias("depth"), F.concat("path", F.array(child)).alias("path"))
        out = out.union(level)
    return out


def best_first(edges: DataFrame, seeds: DataFrame, scores: DataFrame, levels: int, width: int, parent: str = "parent", child: str = "child") -> DataFrame:
    """(node, level, score): of every level the ``width`` best nodes not seen before are followed.

    A search by score with a bounded front; ``levels`` and ``width`` are its limits.
    """
    links = edges.select(parent, child).distinct()
    front = seeds.select(F.col("root").alias("node"), F.lit(0).alias("level"), F.lit(0.0).alias("score")).distinct()
    seen = front
    for d in range(1, levels + 1):
        step = (
            front.select("node").join(links, F.col("node") == F.col(parent)).select(F.col(child).alias("node")).distinct()
            .join(seen.select("node"), "node", "left_anti").join(scores, "node")
            .orderBy(F.col("score").desc(), "node").limit(width)
        )
        front = cut(step.select("node", F.lit(d).alias("level"), F.col("score").cast("double").alias("score")))
        seen = seen.union(front)
    return seen


def first_seen(pages: DataFrame, key: str, item: str, page: str) -> DataFrame:
    """(key, page, n_new, stops): how many items each page of a walk shows first, and where a run
    of two pages without new ones would end the reading. Windows are over the pages of one walk."""
    first = pages.groupBy(key, item).agg(F.min(page).alias(page)).groupBy(key, page).agg(F.count("*").alias("n_new"))
    every = pages.select(key, page).distinct().join(first, [key, page], "left").withColumn("n_new", F.coalesce("n_new", F.lit(0)))
    before = F.lag("n_new").over(Window.partitionBy(key).orderBy(page))
    return every.withColumn("stops", (F.col("n_new") == 0) & F.coalesce(before == 0, F.lit(False)))


def loops(trace: DataFrame, key: str, page: str, order: str, most: int = 3) -> DataFrame:
    """(key, page, visits, first_over): pages that a walk visits ``most`` times or more."""
    counted = trace.groupBy(key, page).agg(F.count("*").cast("int").alias("visits")).where(F.col("visits") >= most)
    # only the first rows of each group leave their partitions
    nth = F.row_number().over(Window.partitionBy(key, page).orderBy(order))
    over = trace.select(key, page, order).withColumn("nth", nth).where(F.col("nth") <= most).where(F.col("nth") == most)
    return counted.join(over.select(key, page, F.col(order).alias("first_over")), [key, page])
