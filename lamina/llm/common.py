"""What the operators of this subpackage share: table access and staging in the shared folder."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


#: Bytes of an Arrow batch (a longer row is a batch of its own), so that the memory of a task that
#: runs Python does not grow with the length of the texts.
BATCH_BYTES = 4 << 20


def batched(df: DataFrame) -> DataFrame:
    """df, whose session sends Arrow batches of BATCH_BYTES at most."""
    conf = df.sparkSession.conf
    now = conf.get("spark.sql.execution.arrow.maxBytesPerBatch", None)
    if now != str(BATCH_BYTES):
        conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(BATCH_BYTES))
    return df


def shared_dir(spark: SparkSession) -> str:
    """The folder that all executors share: spark.checkpoint.dir; a local one only where it is unset."""
    conf = spark.sparkContext.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None)
    if conf:
        return conf.rstrip("/")
    current = spark.sparkContext._jsc.sc().getCheckpointDir()
    if current.isEmpty():
        if not spark.sparkContext.master.startswith("local[") and spark.sparkContext.master != "local":
            raise RuntimeError("spark.checkpoint.dir has to name a folder that all executors share")
        spark.sparkContext.setCheckpointDir(tempfile.mkdtemp(prefix="lamina-"))
        current = spark.sparkContext._jsc.sc().getCheckpointDir()
    return current.get().rstrip("/")


def staged_path(spark: SparkSession, label: str) -> str:
    return f"{shared_dir(spark)}/lamina/{label}-{uuid.uuid4().hex}"


def staged(df: DataFrame, label: str, path: str | None = None) -> DataFrame:
    """Write df as Parquet in the shared folder and read it back, so that a lost executor
    costs a re-read and not a recomputation."""
    path = path or staged_path(df.sparkSession, label)
    df.write.option("compression", "zstd").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def shuffle_partitions(spark: SparkSession) -> int:
    return max(1, int(spark.conf.get("spark.sql.shuffle.partitions", "200")))


def dense_rank_in_group(df: DataFrame, group: list[str], order: list[Column | str], spread: Column, name: str, buckets: int) -> DataFrame:
    """Adds `name`: numbers 0, 1, 2, ... without gaps inside each group.

    A group is dealt out over `buckets` by `spread`, so that a hot group is numbered by many
    tasks: rows are numbered inside (group, bucket), and a table of one row per (group, bucket)
    gives each bucket its first number."""
    from pyspark.sql import Window

    df = df.withColumn("_b", F.pmod(F.xxhash64(spread), F.lit(buckets)))
    keys = [*group, "_b"]
    sizes = df.groupBy(*keys).agg(F.count(F.lit(1)).alias("_n"))
    first = sizes.withColumn(
        "_first",
        F.sum("_n").over(Window.partitionBy(*group).orderBy("_b").rowsBetween(Window.unboundedPreceding, -1)),
    ).select(*keys, F.coalesce("_first", F.lit(0)).alias("_first"))
    ranked = df.withColumn("_r", F.row_number().over(Window.partitionBy(*keys).orderBy(*order)))
    on = [ranked[k].eqNullSafe(first[k]) for k in keys]
    cond = on[0]
    for c in on[1:]:
        cond = cond & c
    out = ranked.join(first, cond, "left").withColumn(name, F.col("_first") + F.col("_r") - 1)
    return out.select(*[ranked[c] for c in ranked.columns if c not in ("_b", "_r")], name)
