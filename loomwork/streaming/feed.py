"""The review feed as a stream: decisions arrive as files, the latest of each item counts."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

DECISIONS = "id bigint, status string, reviewer_hub_id string, notes string, ts timestamp"


def decisions(spark: SparkSession, path: str, files_per_trigger: int = 100) -> DataFrame:
    return spark.readStream.schema(DECISIONS).option("maxFilesPerTrigger", files_per_trigger).json(path)


def once(stream: DataFrame, delay: str = "1 day") -> DataFrame:
    """Repeats of a decision within the watermark are dropped; state is bounded by it."""
    return stream.withWatermark("ts", delay).dropDuplicatesWithinWatermark(["id", "status", "reviewer_hub_id"])


def windowed_counts(stream: DataFrame, window: str = "1 day", delay: str = "1 day") -> DataFrame:
    """Decisions by status in tumbling windows; a window closes when the watermark passes it."""
    return stream.withWatermark("ts", delay).groupBy(F.window("ts", window), "status").agg(F.count("*").alias("n"))


def latest(rows: DataFrame) -> DataFrame:
    """The last decision of each id, ties by status."""
    cols = [F.col(c) for c in rows.columns if c != "id"]
    return rows.groupBy("id").agg(F.max_by(F.struct(*cols), F.struct("ts", "status")).alias("d")).select("id", "d.*")


def versions(spark: SparkSession, path: str) -> list[tuple[int, str, int]]:
    """(number, run, epoch) of the written versions, in order; those that were not ended are left out."""
    place = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    fs = place.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    if not fs.exists(place):
        return []
    names = [f.getPath() for f in fs.listStatus(place)]
    done = [n.getName() for n in names if n.getName().startswith("v=") and fs.exists(spark.sparkContext._jvm.org.apache.hadoop.fs.Path(n, "_SUCCESS"))]
    return sorted((int(n), run, int(epoch)) for n, run, epoch in (d[2:].split("~") for d in done))


def current(spark: SparkSession, path: str) -> DataFrame:
    """The decisions of the last version."""
    found = versions(spark, path)
    if not found:
        return spark.createDataFrame([], DECISIONS)
    return spark.read.schema(DECISIONS).parquet(f"{path}/v={'~'.join(map(str, found[-1]))}")


def upsert(path: str, run: str = "0") -> Callable[[DataFrame, int], None]:
    """For ``foreachBatch``: the latest decisions as a new version next to the old ones.

    A version is named by its number, the run and the epoch.  A batch that runs again writes its
    own version again on what was there before it, so each counts once.  A stream with a new
    checkpoint takes a new ``run`` name and goes on from the last version, whatever its epochs.
    """

    def write(batch: DataFrame, epoch: int) -> None:
        spark = batch.sparkSession
        found = versions(spark, path)
        again = next((k for k, (_, r, e) in enumerate(found) if (r, e) == (run, epoch)), None)
        before = found if again is None else found[:again]
        number = (before[-1][0] + 1 if before else 0) if again is None else found[again][0]
        new = latest(batch)
        if before:
            old = spark.read.schema(DECISIONS).parquet(f"{path}/v={'~'.join(map(str, before[-1]))}")
            new = latest(old.unionByName(new.select(*old.columns)))
        new.write.mode("overwrite").parquet(f"{path}/v={number}~{run}~{epoch}")

    return write
