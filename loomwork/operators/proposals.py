"""Bridges between hub groups, and proposals of new hubs from controls that fit none."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.vectors import normalised
from . import similarity
from .density import density_clusters


def classify_hubs(links: DataFrame, hubs: DataFrame) -> DataFrame:
    """hub_id, class: reached by AI frameworks alone, by others alone, by both or by none."""
    per = links.groupBy("hub_id").agg(F.bool_or("is_ai").alias("ai"), F.bool_or(~F.col("is_ai")).alias("other"))
    kind = F.when(F.col("ai") & F.col("other"), "both").when(F.col("ai"), "ai_only").when(F.col("other"), "traditional_only").otherwise("unlinked")
    return hubs.select(F.col("id").alias("hub_id")).join(per, "hub_id", "left").select("hub_id", kind.alias("class"))


def centroids(members: DataFrame) -> DataFrame:
    """Renormalised mean vector, size and frameworks of each cluster (cluster_id, item_id,
    framework_id, embedding): means are of each position, so vectors are never gathered."""
    at = members.select("cluster_id", F.posexplode("embedding").alias("i", "v")).groupBy("cluster_id", "i").agg(F.avg(F.col("v").cast("double")).alias("v"))
    vec = at.groupBy("cluster_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("i", "v"))), lambda x: x["v"]).alias("c"))
    size = members.groupBy("cluster_id").agg(F.countDistinct("item_id").alias("n_controls"), F.countDistinct("framework_id").alias("n_frameworks"))
    return vec.join(size, "cluster_id").select("cluster_id", normalised(F.col("c")).alias("centroid"), "n_controls", "n_frameworks")


#: Clusters that are compared with each other at once.
MOST_CLUSTERS = 10_000


def separated(clusters: DataFrame, separation: float) -> DataFrame:
    """cluster_id, _lost of the clusters that a near one removes."""
    found = clusters.select("cluster_id", "n_controls", "centroid").orderBy("cluster_id").limit(MOST_CLUSTERS + 1).collect()
    if len(found) > MOST_CLUSTERS:
        raise ValueError(f"guardrails are for at most {MOST_CLUSTERS} clusters")
    gone: set[int] = set()
    if found:
        x = np.array([r.centroid for r in found], float)
        size = [r.n_controls for r in found]
        for i in range(len(found)):
            if i in gone:
                continue
            for j in np.flatnonzero(x[i + 1 :] @ x[i] >= separation) + i + 1:
                if int(j) not in gone:
                    gone.add(i if size[i] < size[j] else int(j))
    kind = clusters.schema["cluster_id"].dataType.simpleString()
    return clusters.sparkSession.createDataFrame([(found[i].cluster_id, True) for i in sorted(gone)], f"cluster_id {kind}, _lost boolean")


def guardrails(clusters: DataFrame, hubs: DataFrame, *, least_controls: int = 3, least_frameworks: int = 2, separation: float = 0.7, uncertain: float = 0.2, budget: int = 40) -> DataFrame:
    """Each cluster with the rule it failed, if any, its nearest hub and its evidence.

    Evidence first; then, cluster by cluster in order of id, one nearer than ``separation`` to a
    later one loses if it is smaller, else the later one does (a cluster that is gone removes no
    other); then those beyond ``budget`` in order of evidence.  Clusters are few (at most
    ``MOST_CLUSTERS``, checked): the order in which they remove each other is worked out on the driver.
    """
    best = similarity.top_hubs(clusters.select(F.col("cluster_id").alias("item_id"), F.col("centroid").alias("embedding")), hubs.select("hub_id", "embedding"), 1)
    best = best.select(F.col("item_id").alias("cluster_id"), F.col("hub_id").alias("parent_hub_id"), F.col("sim").alias("parent_sim"))
    rows = clusters.join(best, "cluster_id").withColumn("evidence", F.col("n_controls") * F.col("n_frameworks"))
    weak = (F.col("n_controls") < least_controls) | (F.col("n_frameworks") < least_frameworks)
    lost = separated(rows.where(~weak), separation)
    rows = rows.join(lost, "cluster_id", "left").withColumn("failed", F.when(weak, "evidence").when(F.col("_lost"), "separation"))
    w = Window.partitionBy("failed").orderBy(F.desc("evidence"), "cluster_id")
    over = F.col("failed").isNull() & (F.row_number().over(w) > budget)
    return rows.select("cluster_id", "n_controls", "n_frameworks", "evidence", "parent_hub_id", F.round("parent_sim", 6).alias("parent_sim"), (F.col("parent_sim") < uncertain).alias("uncertain"), F.when(over, "budget").otherwise(F.col("failed")).alias("failed"))


def named(passing: DataFrame, hubs: DataFrame) -> DataFrame:
    """Proposals with a placeholder name from the nearest hub's."""
    near = hubs.select(F.col("id").alias("parent_hub_id"), F.col("name").alias("_near"))
    name = F.concat(F.lit("Cluster "), F.col("cluster_id").cast("string"), F.lit(" (near: "), F.coalesce("_near", "parent_hub_id"), F.lit(")"))
    return passing.join(near, "parent_hub_id", "left").withColumn("name", name).drop("_near")


def propose_hubs(items: DataFrame, hubs: DataFrame, *, ood_threshold: float, least: int = 3, samples: int = 2, budget: int = 40) -> DataFrame:
    """Proposals of new hubs from items (item_id, framework_id, embedding) that fit no hub
    (hub_id, embedding): items under the threshold are clustered by density, and clusters pass the guardrails."""
    best = similarity.top_hubs(items, hubs, 1).where(F.col("sim") < ood_threshold).select("item_id")
    away = items.join(best, "item_id", "left_semi")
    clusters = density_clusters(away, least=least, samples=samples).join(away, "item_id")
    return guardrails(centroids(clusters), hubs, budget=budget)


def bridge_rows(links: DataFrame, hubs: DataFrame, vectors: DataFrame, k: int = 3) -> DataFrame:
    """For each hub of AI frameworks, its k nearest hubs of others and its farthest (a negative), with
    names and numbers of links."""
    kinds = classify_hubs(links, hubs)
    side = lambda c: vectors.join(kinds.where(F.col("class") == c).select("hub_id"), "hub_id", "left_semi")
    asked, other = side("ai_only").withColumnRenamed("hub_id", "item_id"), side("traditional_only")
    top = similarity.top_hubs(asked, other, k).select("item_id", "hub_id", "sim", "rank", F.lit("candidate").alias("kind"))
    opposite = other.withColumn("embedding", F.transform("embedding", lambda x: -x))
    far = similarity.top_hubs(asked, opposite, 1).select("item_id", "hub_id", (-F.col("sim")).alias("sim"), F.lit(0).alias("rank"), F.lit("negative").alias("kind"))
    n = links.groupBy("hub_id").agg(F.count("*").alias("n_links"))
    name = hubs.select(F.col("id").alias("hub_id"), "name")
    out = top.unionByName(far).join(name, "hub_id", "left").join(n, "hub_id", "left")
    return out.select(F.col("item_id").alias("ai_hub_id"), F.col("hub_id").alias("trad_hub_id"), "kind", "rank", F.round("sim", 6).alias("similarity"), F.col("name").alias("trad_name"), F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"))
