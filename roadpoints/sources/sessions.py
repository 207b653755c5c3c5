"""Session documents: schema, scan, sink, subsets and statistics."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F, types as T

PAIR_LIST = T.ArrayType(T.ArrayType(T.DoubleType()))
MAP = T.MapType(T.StringType(), T.StringType())
ACTION = T.StructType([T.StructField("timestamp", T.DoubleType()), T.StructField("relative_time", T.DoubleType()), T.StructField("action", T.StringType()),
                       T.StructField("category", T.StringType()), T.StructField("position", T.ArrayType(T.DoubleType())), T.StructField("data", MAP)])
CONTEXT = T.StructType([T.StructField("session_duration", T.DoubleType()), T.StructField("total_edits", T.LongType()), T.StructField("edit_rate", T.DoubleType())])
SAMPLE = T.StructType([T.StructField("timestamp", T.StringType()), T.StructField("action", T.IntegerType()), T.StructField("category", T.StringType()),
                       T.StructField("position", T.ArrayType(T.DoubleType())), T.StructField("state_vector", T.ArrayType(T.DoubleType())),
                       T.StructField("reward", T.DoubleType()), T.StructField("context", CONTEXT)])
SESSION = T.StructType([
    T.StructField("file_path", T.StringType()), T.StructField("timestamp", T.StringType()), T.StructField("labels", T.MapType(T.StringType(), PAIR_LIST)),
    T.StructField("skeleton", PAIR_LIST), T.StructField("metadata", MAP), T.StructField("user_actions", T.ArrayType(ACTION)),
    T.StructField("polygon_info", T.StructType([T.StructField("index", T.IntegerType()), T.StructField("total", T.IntegerType())])),
    T.StructField("samples", T.ArrayType(SAMPLE)), T.StructField("deleted_points", T.MapType(T.StringType(), PAIR_LIST))])


def scan(spark: SparkSession, path: str, name: str | None = None) -> DataFrame:
    """All sessions of a folder with file, mtime and size, newest first; ``name`` filters by a part of the file name."""
    df = (spark.read.schema(SESSION).option("multiLine", True).json(path)
          .withColumns({"file": F.col("_metadata.file_path"), "mtime": F.col("_metadata.file_modification_time"), "size": F.col("_metadata.file_size")}))
    if name:
        df = df.where(F.substring_index("file", "/", -1).contains(name))
    return df.orderBy(F.desc("mtime"))


def of_base(sessions: DataFrame, base: str) -> DataFrame:
    """All sessions of one base file (base, base-1, base-2, ...)."""
    return sessions.where(F.substring_index("file", "/", -1).startswith(base.split("_")[0]))


def from_points(points: DataFrame, mode: str = "points") -> DataFrame:
    """One document per layer. A document holds its layer's labels by definition, so its size is that of the file it becomes."""
    lists = points.groupBy("layer_id", "category").agg(F.transform(F.array_sort(F.collect_list(F.struct("ord", "x", "y"))), lambda p: F.array(p["x"], p["y"])).alias("pts"))
    labels = lists.groupBy("layer_id").agg(F.map_from_entries(F.collect_list(F.struct("category", "pts"))).alias("labels"))
    blank = {f.name: F.lit(None).cast(f.dataType) for f in SESSION.fields if f.name not in ("labels", "metadata", "file_path")}
    return labels.withColumns({**blank, "file_path": F.concat(F.lit("layer-"), F.col("layer_id").cast("string")), "metadata": F.create_map(F.lit("file_mode"), F.lit(mode))})


def write(sessions: DataFrame, path: str) -> None:
    """Append session documents as JSON lines, one folder per layer."""
    sessions.write.mode("append").partitionBy("layer_id").json(path)


def older_than(sessions: DataFrame, days: int) -> DataFrame:
    """Sessions past their age: reported, never deleted."""
    return sessions.where(F.current_timestamp() - F.col("mtime") > F.make_dt_interval(F.lit(days)))


def statistics(sessions: DataFrame) -> DataFrame:
    """Count, total and mean size by file mode."""
    mode = F.coalesce(F.element_at("metadata", F.lit("file_mode")), F.lit("unknown"))
    return sessions.groupBy(mode.alias("file_mode")).agg(F.count(F.lit(1)).alias("sessions"), F.sum("size").alias("bytes"), F.avg("size").alias("mean_bytes"))
