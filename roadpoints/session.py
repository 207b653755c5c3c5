"""Session defaults, and the folder in which iterative operators cut their lineage."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import Column, DataFrame, Observation, SparkSession, functions as F


def local_session(cores: int | str = 8, memory: str = "12g", app: str = "roadpoints") -> SparkSession:
    """A session for tests and benchmarks on one machine."""
    spark = (
        SparkSession.builder.master(f"local[{cores}]").appName(app)
        .config("spark.ui.enabled", "false")
        .config("spark.driver.memory", memory)
        .config("spark.sql.shuffle.partitions", str(cores))
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def shared_dir(spark: SparkSession) -> str:
    """The cluster's checkpoint folder; one of our own only in local mode with none set."""
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if folder:
        return folder
    if not spark.sparkContext.master.startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a folder all executors share")
    folder = tempfile.mkdtemp(prefix="roadpoints-")
    spark.conf.set("spark.checkpoint.dir", folder)
    return folder


def cut(df: DataFrame) -> DataFrame:
    """Write ``df`` to the shared folder and read it back.

    The result no longer depends on the plan that made it, survives the loss of
    executors, and has a known size, so adaptive execution can plan with it.
    """
    path = f"{shared_dir(df.sparkSession).rstrip('/')}/cut-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def cut_counting(df: DataFrame, count: Column | None = None) -> tuple[DataFrame, int]:
    """``cut`` that also returns the number of rows (or another aggregate) observed while writing."""
    seen = Observation()
    out = cut(df.observe(seen, (F.count(F.lit(1)) if count is None else count).alias("n")))
    return out, int(seen.get["n"] or 0)
