"""A session with the settings that the operators assume."""

from __future__ import annotations

from pyspark.sql import SparkSession


def get_session(app: str = "loomwork", **conf: str) -> SparkSession:
    """UTC, adaptive execution with skew handling; other settings are the cluster's."""
    base = {
        "spark.sql.session.timeZone": "UTC",
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.skewJoin.enabled": "true",
        "spark.sql.adaptive.coalescePartitions.enabled": "true",
    }
    builder = SparkSession.builder.appName(app)
    for k, v in (base | conf).items():
        builder = builder.config(k, v)
    return builder.getOrCreate()


#: Spark deletes an action's shuffle files at its end where this is set, and else when the driver happens to collect its garbage.
SHUFFLES_END = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def written(df, path: str, **options: str) -> None:
    """``df`` written to ``path`` as parquet; the shuffle files it took are deleted then, as nothing reads them again."""
    conf = df.sparkSession.conf
    before = conf.get(SHUFFLES_END, None)
    conf.set(SHUFFLES_END, "true")
    try:
        df.write.options(**options).parquet(path)
    finally:
        conf.unset(SHUFFLES_END) if before is None else conf.set(SHUFFLES_END, before)


def durable(df, what: str = "step"):
    """``df`` written to a folder that the driver and all executors reach, and read back.

    Cuts lineage for loops; survives lost executors.  The folder is ``spark.checkpoint.dir``; in
    local mode, where that may be unset, the warehouse.
    """
    import uuid

    spark = df.sparkSession
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        base = spark.conf.get("spark.sql.warehouse.dir")
    path = f"{base.rstrip('/')}/loomwork-{what}-{uuid.uuid4().hex}"
    written(df, path)
    return spark.read.schema(df.schema).parquet(path)
