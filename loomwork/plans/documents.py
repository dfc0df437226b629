"""Documents for people: hub reference, reviewer's guide, data set card, and the files that carry them."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators import evaluation
from ..sources import writers
from ..sources.versions import VersionLog


def hub_reference(hubs: DataFrame) -> DataFrame:
    """hub_id, name, path, parent_id, is_leaf of every hub; the caller orders it by path."""
    parents = hubs.where("parent_id IS NOT NULL").select(F.col("parent_id").alias("id")).distinct().withColumn("_has", F.lit(True))
    rows = hubs.join(parents, "id", "left")
    return rows.select(F.col("id").alias("hub_id"), "name", F.coalesce("path", F.lit("")).alias("path"), "parent_id", F.col("_has").isNull().alias("is_leaf"))


GUIDE = """# How to review these assignments

Each row says that a control belongs to a hub. Please decide for every row whether it does.

## What to do

1. Read the control's title and text.
2. Read the hub's name and its path from the root; the hub reference lists all hubs by path.
3. Choose a status: `accepted`, `rejected`, or `reassigned` with the id of a better hub.
4. Add a note where the reason is not plain.

Rows marked as out of distribution resemble no hub well: a rejection is often right there.
Some rows have known answers; they measure how careful a review is, and look like all others.

## How much there is

| Priority | Rows | Minutes a row | Hours |
|---|---|---|---|
{rows}| **all** | {total} | | {hours} |
"""

#: Minutes that a row of each priority takes, at least and at most.
MINUTES = {"routine": (1, 2), "careful": (2, 3), "critical": (3, 5)}


def reviewer_guide(priorities: DataFrame) -> str:
    """The guide as Markdown, with numbers of rows by ``priority`` (one row a priority is collected)."""
    counts = {r["priority"]: r["n"] for r in priorities.groupBy("priority").agg(F.count("*").alias("n")).collect()}
    span = lambda lo, hi: f"{lo:.1f} to {hi:.1f}"
    rows, low, high = "", 0.0, 0.0
    for name, (a, b) in MINUTES.items():
        n = counts.get(name, 0)
        rows += f"| {name} | {n} | {a} to {b} | {span(n * a / 60, n * b / 60)} |\n"
        low, high = low + n * a / 60, high + n * b / 60
    return GUIDE.format(rows=rows, total=sum(counts.values()), hours=span(low, high))


def write_review_bundle(review: DataFrame, hubs: DataFrame, path: str) -> None:
    """A folder for reviewers: the rows (with ``priority``) and the hub reference as JSON lines, and the guide."""
    spark = review.sparkSession
    review.write.mode("errorifexists").json(f"{path}/assignments")
    hub_reference(hubs).orderBy("path", "hub_id").write.mode("errorifexists").json(f"{path}/hubs")
    spark.createDataFrame([(reviewer_guide(review),)], "value string").coalesce(1).write.mode("errorifexists").text(f"{path}/guide")


def dataset_card(title: str, dataset: dict[str, DataFrame], review: DataFrame | None = None, *, licence: str, sources: list[tuple[str, str]] = ()) -> str:
    """The data set's card: its sizes, assignments by type, frameworks with their numbers, and, with ``review``
    (framework_id, n, accepted_rate), a review's rates with their average weighted by rows."""
    rows = dataset["crosswalk"]
    size = rows.agg(F.count("*").alias("n"), F.countDistinct("framework_id").alias("f"), F.countDistinct("control_id").alias("c"), F.countDistinct("hub_id").alias("h")).first()
    text = f"# {title}\n\n{size['n']} assignments of {size['c']} controls from {size['f']} frameworks to {size['h']} hubs. Licence: {licence}.\n\n"
    kinds = rows.groupBy("assignment_type").agg(F.count("*").alias("rows"))
    text += writers.card("Assignments by type", kinds, "assignment_type").replace("# ", "## ", 1) + "\n"
    text += writers.card("Frameworks", dataset["frameworks"], dataset["frameworks"].columns[0]).replace("# ", "## ", 1)
    if review is not None:
        text += "\n" + writers.metrics_card("Review", review, "framework_id", ["accepted_rate"], intro="Share of reviewed rows that were accepted as they were.", sources=sources).replace("# ", "## ", 1)
    return text


def publish_dataset(log: VersionLog, dataset: dict[str, DataFrame], card: str, key: str) -> int:
    """The data set's tables and its card as one version; its number."""
    text = dataset["crosswalk"].sparkSession.createDataFrame([(card,)], "text string")
    return log.commit({**dataset, "card": text}, key=key, note={"kind": "dataset"})


def save_holdout(log: VersionLog, items: DataFrame, key: str, parts: dict[str, int], rest: str, seed: int) -> DataFrame:
    """A hashed split (``key``, part) saved as the table ``holdout``; a split that is saved already is the one that counts."""
    saved = log.read("holdout")
    if saved is None:
        log.commit({"holdout": evaluation.hashed_split(items, key, parts, rest, seed).select(key, "part")}, key=f"holdout-{seed}", note={"parts": parts, "rest": rest, "seed": seed})
        saved = log.read("holdout")
    return saved


def latest_proposals(rows: DataFrame) -> DataFrame:
    """The proposals of the last round, for an exchange; none if there is no round."""
    last = rows.agg(F.max("round").alias("_last"))  # one row
    return rows.join(F.broadcast(last), F.col("round") == F.col("_last")).drop("_last")
