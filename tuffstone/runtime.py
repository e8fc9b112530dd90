"""Session helpers shared by every operator."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One of the parquet tables of a data directory."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def ensure_checkpoint_dir(spark: SparkSession) -> None:
    """Make ``DataFrame.checkpoint`` usable.

    A cluster names a folder that every executor shares in ``spark.checkpoint.dir``; it is used as it
    stands. Only where the setting is absent (local tests) is a folder of our own made.
    """
    context = spark.sparkContext
    if context.getCheckpointDir() is not None:
        return
    named = spark.conf.get("spark.checkpoint.dir", None)
    if named:
        context.setCheckpointDir(named)
        return
    if not context.master.startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
    context.setCheckpointDir(tempfile.mkdtemp(prefix="tuffstone-"))


def cut(df: DataFrame) -> DataFrame:
    """``df`` written as a table in the shared folder and read again: its lineage ends there.

    The table survives the loss of executors and is compressed, unlike an RDD checkpoint. The folder is the
    cluster's scratch space; whoever empties it after a job removes the table.
    """
    spark = df.sparkSession
    ensure_checkpoint_dir(spark)
    path = f"{spark.sparkContext.getCheckpointDir()}/table-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def spread(df: DataFrame) -> DataFrame:
    """``df`` over all cores if it comes in so few parts that most would idle; else as it is.

    Large inputs have many more parts than there are cores and are never shuffled here; nor are inputs that
    come out of a shuffle, whose parts were chosen by size.
    """
    if "Exchange" in df._jdf.queryExecution().executedPlan().toString():
        return df
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores) if df.rdd.getNumPartitions() * 2 <= cores else df


def largest_keys(rows: DataFrame, keys: list[str], n: int = 1000) -> DataFrame:
    """The ``n`` keys with the most rows, a bounded table for ``broadcast``: any other key holds under an n-th of all.

    Joins salt these keys alone. Counts combine before they are shuffled.
    """
    return rows.groupBy(*keys).agg(F.count("*").alias("__n")).orderBy(F.desc("__n"), *keys).limit(n).select(*keys, F.lit(True).alias("__hot"))


def salted(rows: DataFrame, hot: DataFrame, keys: list[str], salts: int, by: list[str] | None) -> DataFrame:
    """``rows`` with a column ``salt``: rows of ``hot`` keys fall into ``salts`` parts by a hash of ``by``, or go to all of
    them if ``by`` is None; other rows have salt 0."""
    marked = rows.join(F.broadcast(hot), keys, "left")
    is_hot = F.coalesce("__hot", F.lit(False))
    if by is None:
        parts = F.when(is_hot, F.sequence(F.lit(0), F.lit(salts - 1))).otherwise(F.array(F.lit(0)))
        return marked.withColumn("salt", F.explode(parts)).drop("__hot")
    return marked.withColumn("salt", F.when(is_hot, F.pmod(F.xxhash64(*by), F.lit(salts)).cast("int")).otherwise(0)).drop("__hot")


def put_file(spark: SparkSession, name: str, content: bytes, folder: str | None = None) -> str:
    """Write a small file into the shared folder, whatever its file system; returns its path.

    Files of one ``folder`` name lie together.
    """
    ensure_checkpoint_dir(spark)
    context = spark.sparkContext
    path = f"{context.getCheckpointDir()}/{folder or f'file-{uuid.uuid4().hex}'}/{name}"
    place = context._jvm.org.apache.hadoop.fs.Path(path)
    out = place.getFileSystem(context._jsc.hadoopConfiguration()).create(place)
    try:
        out.write(content, 0, len(content))
    finally:
        out.close()
    return path
