"""Trees as intervals: every node's place in depth-first order and the last place below it.

With these numbers "below", "above" and "how many below" are comparisons of two integers, and no table of all
pairs of ancestors and descendants is made.  They come from pointer doubling: round k knows each node's ancestor
2^k levels up, and sums over the levels in between, so a tree takes rounds by the logarithm of its depth.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import durable
from .ordering import running


def ancestors_by_doubling(nodes: DataFrame, up: DataFrame, *, path: str | None = None) -> tuple[DataFrame, DataFrame, int]:
    """(id, parent_id, depth, root_id, size, and the ``path`` of a column's values from the root down), the ids that no
    root reaches, and the rounds taken.

    ``nodes`` has distinct ids, ``up`` (id, parent_id) at most one parent of each, itself a node.  A round joins each node
    with the node 2^k levels above it.  Nodes on a cycle or below one never reach a root: they are those still
    climbing when more levels than nodes have been climbed.
    """
    if path:
        # On a cycle paths would grow without end: those nodes are found first, and left out.
        _, cyclic, _ = ancestors_by_doubling(nodes.select("id"), up)
        nodes, up = nodes.join(cyclic, "id", "left_anti"), up.join(cyclic, "id", "left_anti")
        done, _, rounds = _climbed(nodes, up, path)
        return done, cyclic, rounds
    return _climbed(nodes, up, None)


def _climbed(nodes: DataFrame, up: DataFrame, path: str | None) -> tuple[DataFrame, DataFrame, int]:
    n = nodes.count()
    start = nodes.join(up.select("id", "parent_id"), "id", "left")
    at = start.select(
        "id", "parent_id", F.col("parent_id").alias("anc"), F.when(F.col("parent_id").isNull(), 0).otherwise(1).cast("long").alias("depth"), F.coalesce("parent_id", "id").alias("root_id"),
        F.lit(1).cast("long").alias("size"), *([F.array(path).alias("path")] if path else []),
    )
    at = durable(at, "climb")
    rounds, reach = 0, 1
    while reach <= 2 * n and not at.where("anc IS NOT NULL").isEmpty():
        above = at.select(F.col("id").alias("anc"), F.col("anc").alias("_anc"), F.col("depth").alias("_depth"), F.col("root_id").alias("_root"), *([F.col("path").alias("_path")] if path else []))
        below = at.where("anc IS NOT NULL").groupBy(F.col("anc").alias("id")).agg(F.sum("size").alias("_more"))
        climbed = at.join(above, "anc", "left").join(below, "id", "left")
        at = climbed.select(
            "id", "parent_id", F.col("_anc").alias("anc"), (F.col("depth") + F.coalesce("_depth", F.lit(0))).alias("depth"), F.coalesce("_root", "root_id").alias("root_id"),
            (F.col("size") + F.coalesce("_more", F.lit(0))).alias("size"), *([F.when(F.col("_path").isNull(), F.col("path")).otherwise(F.concat("_path", "path")).alias("path")] if path else []),
        )
        at = durable(at, "climb")
        rounds, reach = rounds + 1, 2 * reach
    done = at.where("anc IS NULL").drop("anc")
    return done, at.where("anc IS NOT NULL").select("id"), rounds


def intervals(nodes: DataFrame, up: DataFrame) -> DataFrame:
    """id, parent_id, root_id, depth, size (with itself), enter and leave of each node that a root reaches.

    ``enter`` numbers nodes from 1 in depth-first order, siblings and roots by id; ``leave`` is the last number below a
    node, so b lies at or below a where a.enter <= b.enter <= a.leave.
    """
    tree, _, _ = ancestors_by_doubling(nodes.select("id"), up)
    # A node's distance from its parent's place: itself and all that earlier siblings hold.
    steps = running(tree, [F.col("parent_id"), F.col("id")], {"_sum": F.col("size")})
    first = steps.groupBy("parent_id").agg(F.min(F.col("_sum") - F.col("size")).alias("_base"))
    steps = steps.alias("s").join(first.alias("f"), F.col("s.parent_id").eqNullSafe(F.col("f.parent_id"))).select("s.*", (F.col("s._sum") - F.col("s.size") - F.col("f._base") + 1).alias("step"))
    at = durable(steps.select("id", "parent_id", "root_id", "depth", "size", F.col("step").alias("enter"), F.col("parent_id").alias("anc")), "tour")
    while not at.where("anc IS NOT NULL").isEmpty():
        above = at.select(F.col("id").alias("anc"), F.col("anc").alias("_anc"), F.col("enter").alias("_enter"))
        at = durable(at.join(above, "anc", "left").select("id", "parent_id", "root_id", "depth", "size", (F.col("enter") + F.coalesce("_enter", F.lit(0))).alias("enter"), F.col("_anc").alias("anc")), "tour")
    return at.select("id", "parent_id", "root_id", "depth", "size", "enter", (F.col("enter") + F.col("size") - 1).alias("leave"))


def is_below(above: str, below: str):
    """The condition that ``below`` (an alias of ``intervals``) lies at or below ``above``."""
    return (F.col(f"{below}.enter") >= F.col(f"{above}.enter")) & (F.col(f"{below}.enter") <= F.col(f"{above}.leave"))


def subtree_sums(tree: DataFrame, values: DataFrame, name: str) -> DataFrame:
    """id, ``name``: the sum of ``values`` (id, ``name``) at and below each node of ``tree`` (``intervals``).

    One running sum in depth-first order, and its difference between a node's two ends: no pair of nodes is made.
    """
    per = values.groupBy("id").agg(F.sum(name).alias("_v"))
    rows = tree.join(per, "id", "left").select("id", "enter", "leave", F.coalesce("_v", F.lit(0)).alias("_v"))
    sums = running(rows, [F.col("enter")], {"_sum": F.col("_v")})
    ends = sums.select(F.col("enter").alias("leave"), F.col("_sum").alias("_end"))
    return sums.join(ends, "leave").select("id", (F.col("_end") - F.col("_sum") + F.col("_v")).alias(name))
