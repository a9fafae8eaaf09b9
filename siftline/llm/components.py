"""Connected components of a table of links."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from siftline.llm.common import store
from siftline.operators.lookup import lookup_join


def components(links: DataFrame, most_rounds: int = 60) -> DataFrame:
    """Columns ``a, b`` (long) to ``node, component``: the smallest node that can be reached.

    Nodes without a link, or linked with themselves only, are not listed; an
    empty table gives none. Links with a null end are left out.

    Each round hangs every node's larger neighbours, then its smaller ones,
    below its smallest neighbour, until only stars are left. Minima are
    aggregated before the shuffle, and a node with very many links is dealt out
    by a salt or not shuffled at all.
    """
    tree = store(
        links.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v"))
        .where("a IS NOT NULL AND b IS NOT NULL AND u <> v")
        .distinct(),
        "links",
    )
    known = _state(tree)
    for _ in range(most_rounds):
        if not known[0]:
            break
        tree = store(_lower_side(_upper_side(tree)), "links")
        now = _state(tree)
        if now == known:
            break
        known = now
    else:
        raise RuntimeError(f"components did not settle in {most_rounds} rounds")
    roots = tree.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct()
    return tree.select(F.col("u").alias("node"), F.col("v").alias("component")).unionAll(roots)


def _state(tree: DataFrame) -> tuple:
    """Count and two order-free sums: equal when a round changed nothing."""
    digest = F.xxhash64("u", "v")
    row = tree.agg(
        F.count("*"),
        F.coalesce(F.sum(F.shiftright(digest, 32)), F.lit(0)),
        F.coalesce(F.sum(digest.bitwiseAND(0xFFFFFFFF)), F.lit(0)),
    ).first()
    return tuple(row)


def _upper_side(tree: DataFrame) -> DataFrame:
    """Every node's larger neighbours go to its smallest neighbour or itself.

    Only nodes with a smaller neighbour change anything. The root of a large
    star has none, so a star is a lookup that finds nothing, on any task.
    """
    both = tree.unionAll(tree.select(F.col("v").alias("u"), F.col("u").alias("v")))
    least = both.groupBy("u").agg(F.min("v").alias("m")).where("m < u")
    lower = store(least.select(F.col("u").alias("v"), "m"), "least")
    moved = lookup_join(tree, lower, "left", key="v", spread="u")
    return moved.select("u", F.coalesce("m", "v").alias("v")).distinct()


def _lower_side(tree: DataFrame) -> DataFrame:
    """Every node and its smaller neighbours go to the smallest of them."""
    least = tree.groupBy("u").agg(F.min("v").alias("m"))
    moved = tree.join(least, "u").where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
    return moved.unionAll(least.select("u", F.col("m").alias("v"))).distinct()
