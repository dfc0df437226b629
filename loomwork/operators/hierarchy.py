"""The taxonomy: building, checking and walking a tree of hubs."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..session import durable
from .intervals import ancestors_by_doubling
from .ordering import running


def build_tree(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """HUBS rows from nodes (id, name) and edges (parent_id, child_id).

    A node keeps its least depth, and of several parents at that depth the smallest.  Nodes that no
    root reaches (those on a cycle and below one) become roots.  Where no node has two parents, depths and paths come
    by pointer doubling, in rounds by the logarithm of the depth; else levels are joined one after another from the
    roots, until one is empty: a level holds only nodes that no level before it has, so a cycle ends it too.
    """
    known = edges.join(nodes.select(F.col("id").alias("child_id")), "child_id", "left_semi").join(nodes.select(F.col("id").alias("parent_id")), "parent_id", "left_semi").distinct()
    roots = nodes.join(known.select(F.col("child_id").alias("id")), "id", "left_anti")
    start = lambda r: r.select("id", "name", F.coalesce("name", F.lit("")).alias("path"), F.lit(None).cast("string").alias("parent_id"), F.lit(0).alias("depth"), F.col("id").alias("branch_root_id"))
    if known.groupBy("child_id").agg(F.count("*").alias("n")).where("n > 1").isEmpty():
        tree, left, _ = ancestors_by_doubling(nodes.select("id", "name"), known.select(F.col("child_id").alias("id"), "parent_id"), path="name")
        done = tree.join(nodes, "id").select("id", "name", F.array_join("path", " > ").alias("path"), "parent_id", F.col("depth").cast("int").alias("depth"), F.col("root_id").alias("branch_root_id"))
        return _with_leaves(done.unionByName(start(nodes.join(left, "id", "left_semi"))), known)
    level = durable(start(roots), "level")
    done = level
    while True:
        up = level.select(F.col("id").alias("parent_id"), F.col("path").alias("up"), "depth", "branch_root_id")
        found = known.join(up, "parent_id").groupBy(F.col("child_id").alias("id")).agg(F.min(F.struct("parent_id", "up", "depth", "branch_root_id")).alias("p"))
        found = found.join(done.select("id"), "id", "left_anti").join(nodes, "id")
        level = found.select(
            "id", "name", F.concat_ws(" > ", "p.up", "name").alias("path"), F.col("p.parent_id").alias("parent_id"), (F.col("p.depth") + 1).alias("depth"), F.col("p.branch_root_id").alias("branch_root_id")
        )
        level = durable(level, "level")
        if level.isEmpty():
            break
        done = done.unionByName(level)
    left = nodes.join(done.select("id"), "id", "left_anti")
    return _with_leaves(done.unionByName(start(left)), known)


def _with_leaves(done: DataFrame, known: DataFrame) -> DataFrame:
    parents = known.select(F.col("parent_id").alias("id")).distinct().withColumn("_has", F.lit(True))
    return done.join(parents, "id", "left").select("id", "name", "path", "parent_id", "depth", "branch_root_id", F.col("_has").isNull().alias("is_leaf"))


def integrity_issues(hubs: DataFrame, related: DataFrame | None = None) -> DataFrame:
    """(rule, id) for each broken rule: unknown parent, depth not parent's + 1, a root's depth not
    0, a hub that no root reaches (on a cycle or below one), a relation of one direction or to an
    unknown hub."""
    up = hubs.select(F.col("id").alias("parent_id"), F.col("depth").alias("up_depth"))
    child = hubs.where("parent_id IS NOT NULL").join(up, "parent_id", "left")
    issues = child.where("up_depth IS NULL").select(F.lit("unknown_parent").alias("rule"), "id")
    issues = issues.union(child.where("up_depth IS NOT NULL AND depth <> up_depth + 1").select(F.lit("depth").alias("rule"), "id"))
    issues = issues.union(hubs.where("parent_id IS NULL AND depth <> 0").select(F.lit("root_depth"), "id"))
    # A hub without a known parent is named above, and stands for a root here.
    _, cyclic, _ = ancestors_by_doubling(hubs.select("id"), child.where("up_depth IS NOT NULL").select("id", "parent_id"))
    issues = issues.union(cyclic.select(F.lit("unreachable").alias("rule"), "id"))
    if related is not None:
        known = hubs.select(F.col("id").alias("hub_b"))
        issues = issues.union(related.join(known, "hub_b", "left_anti").select(F.lit("unknown_related"), F.col("hub_a")))
        back = related.select(F.col("hub_b").alias("hub_a"), F.col("hub_a").alias("hub_b"))
        issues = issues.union(related.join(back, ["hub_a", "hub_b"], "left_anti").select(F.lit("one_way"), F.col("hub_a")))
    return issues


def siblings(hubs: DataFrame) -> DataFrame:
    """id, parent_id and the number of other hubs with that parent; ``siblings_of`` lists them."""
    own = hubs.where("parent_id IS NOT NULL").select("id", "parent_id")
    return own.join(own.groupBy("parent_id").agg((F.count("*") - 1).alias("n_siblings")), "parent_id").select("id", "parent_id", "n_siblings")


def siblings_of(hubs: DataFrame, asked: DataFrame) -> DataFrame:
    """(id, sibling_id) for the hubs named in ``asked`` (id)."""
    a = hubs.join(asked.select("id"), "id", "left_semi").where("parent_id IS NOT NULL").alias("a")
    pairs = a.join(hubs.alias("b"), (F.col("a.parent_id") == F.col("b.parent_id")) & (F.col("a.id") != F.col("b.id")))
    return pairs.select(F.col("a.id").alias("id"), F.col("b.id").alias("sibling_id"))


def descendants(hubs: DataFrame) -> DataFrame:
    """(ancestor_id, id, distance): each hub under its ancestors and itself (distance 0).

    Paths from the root come by pointer doubling, in rounds by the logarithm of the depth.  Nodes on a cycle, and
    those below one, are walked level by level, and a pair that is reached again is not followed further.  To count or
    sum what lies below, or to test for it, ``intervals`` needs no pair of nodes.
    """
    edges = hubs.where("parent_id IS NOT NULL").select("id", "parent_id").join(hubs.select(F.col("id").alias("parent_id")), "parent_id", "left_semi")
    tree, cyclic, _ = ancestors_by_doubling(hubs.select("id"), edges, path="id")
    out = tree.select(F.posexplode("path").alias("at", "ancestor_id"), "id", "depth").select("ancestor_id", "id", (F.col("depth") - F.col("at")).cast("int").alias("distance"))
    edges = edges.join(cyclic, "id", "left_semi")
    level = cyclic.select(F.col("id").alias("ancestor_id"), "id", F.lit(0).alias("distance"))
    while not level.isEmpty():
        out = out.unionByName(level)
        level = level.withColumnRenamed("id", "parent_id").join(edges, "parent_id").select("ancestor_id", "id", (F.col("distance") + 1).alias("distance"))
        level = durable(level.dropDuplicates(["ancestor_id", "id"]).join(out.select("ancestor_id", "id"), ["ancestor_id", "id"], "left_anti"), "level")
    return out


def hard_negatives(hubs: DataFrame, n: int) -> DataFrame:
    """Up to ``n`` confusable hubs of each: siblings first, then cousins, each by id.

    Only the first few children of a parent, and the first few grandchildren of a grandparent,
    can be among the first ``n`` of anyone, so lists of those are joined and not whole families.
    """
    up = hubs.where("parent_id IS NOT NULL").select("id", "parent_id")
    by_parent = Window.partitionBy("parent_id").orderBy("id")
    first = up.withColumn("_r", F.row_number().over(by_parent)).where(F.col("_r") <= n + 1).drop("_r")
    sib = up.join(first.select("parent_id", F.col("id").alias("negative_id")), "parent_id").where("id <> negative_id")
    # n of each parent, then 2 n of each grandparent: whichever parent is left out, n remain.
    grand = first.join(up.select(F.col("id").alias("parent_id"), F.col("parent_id").alias("grand_id")), "parent_id")
    few = grand.withColumn("_r", F.row_number().over(by_parent)).where(F.col("_r") <= n)
    few = few.withColumn("_r", F.row_number().over(Window.partitionBy("grand_id").orderBy("id"))).where(F.col("_r") <= 2 * n)
    parents = up.select(F.col("id").alias("parent_id"), F.col("parent_id").alias("grand_id"))
    listed = parents.join(few.select("grand_id", F.col("id").alias("negative_id"), F.col("parent_id").alias("uncle")), "grand_id").where("parent_id <> uncle")
    listed = listed.withColumn("_r", F.row_number().over(Window.partitionBy("parent_id").orderBy("negative_id"))).where(F.col("_r") <= n)
    cousin = up.join(listed.select("parent_id", "negative_id"), "parent_id")
    every = sib.select("id", "negative_id", F.lit(1).alias("kind")).unionByName(cousin.select("id", "negative_id", F.lit(2).alias("kind")))
    one = every.groupBy("id", "negative_id").agg(F.min("kind").alias("kind"))
    w = Window.partitionBy("id").orderBy("kind", "negative_id")
    return one.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= n)


def error_class(pairs: DataFrame, hubs: DataFrame) -> DataFrame:
    """How near a wrong hub (predicted_id) is to the right one (true_id)."""
    up = hubs.select("id", "parent_id")
    grand = up.join(up.select(F.col("id").alias("parent_id"), F.col("parent_id").alias("grand_id")), "parent_id", "left").select("id", "parent_id", "grand_id")
    t, p = grand.select(*[F.col(c).alias(f"t_{c}") for c in grand.columns]), grand.select(*[F.col(c).alias(f"p_{c}") for c in grand.columns])
    both = pairs.join(t, F.col("true_id") == F.col("t_id"), "left").join(p, F.col("predicted_id") == F.col("p_id"), "left")
    kind = (
        F.when(F.col("true_id") == F.col("predicted_id"), "correct").when(F.col("t_parent_id") == F.col("p_parent_id"), "same_parent")
        .when(F.col("t_grand_id") == F.col("p_grand_id"), "same_grandparent").otherwise("unrelated")
    )
    return both.select(*pairs.columns, kind.alias("error_class"))


def add_bridges(related: DataFrame, accepted: DataFrame) -> DataFrame:
    """The relation with accepted pairs added in both directions, as sorted neighbour arrays."""
    both = related.select("hub_a", "hub_b").union(accepted.select("hub_a", "hub_b")).union(accepted.select("hub_b", "hub_a")).distinct()
    return both.groupBy("hub_a").agg(F.array_sort(F.collect_set("hub_b")).alias("related"))


def by_name(hubs: DataFrame, names: DataFrame) -> DataFrame:
    """name, id: the first hub (by id) of each asked name, case apart; null if there is none."""
    keyed = hubs.groupBy(F.lower("name").alias("key")).agg(F.min("id").alias("id"))
    return names.select("name", F.lower("name").alias("key")).join(keyed, "key", "left").select("name", "id")


def level_order(hubs: DataFrame) -> DataFrame:
    """id, place: parents before children, by depth and id (the order in which rows may be added)."""
    return running(hubs.select("id", "depth"), [F.col("depth"), F.col("id")], {}, rank="place").select("id", "depth", "place")


def save_tree(hubs: DataFrame, path: str) -> None:
    hubs.write.mode("errorifexists").parquet(path)


def load_tree(spark: SparkSession, path: str) -> DataFrame:
    """A saved tree; one that breaks a rule is refused."""
    hubs = spark.read.parquet(path)
    bad = integrity_issues(hubs).limit(5).collect()
    if bad:
        raise ValueError(f"{path}: {[(r.rule, r.id) for r in bad]}")
    return hubs
