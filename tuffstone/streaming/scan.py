"""The same operators over streams of files or rows.

Extraction is stateless and runs on a stream as on a table. Repeats are dropped within a watermark, so state
is bounded by time; joins with advisories are stream-static; counts are windowed.
"""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tuffstone.functions.versions import version_key
from tuffstone.operators import advisories, secrets
from tuffstone.runtime import ensure_checkpoint_dir


def file_stream(spark: SparkSession, root: str, glob: str = "*") -> DataFrame:
    """``(path, content, length, seen_at)`` of files as they arrive under ``root``."""
    schema = "path string, modificationTime timestamp, length long, content binary"
    raw = spark.readStream.format("binaryFile").schema(schema).option("recursiveFileLookup", True).option("pathGlobFilter", glob).load(root)
    return raw.select("path", "content", "length", F.col("modificationTime").alias("seen_at"))


def secret_stream(files: DataFrame, rules: tuple = secrets.RULES) -> DataFrame:
    """Findings of a stream of files ``(path, content)``."""
    return secrets.scan_secrets(files, rules)


def first_sightings(stream: DataFrame, keys: list[str], time: str, delay: str = "1 day") -> DataFrame:
    """Each key once while it keeps coming within ``delay``."""
    return stream.withColumn(time, F.col(time).cast("timestamp")).withWatermark(time, delay).dropDuplicatesWithinWatermark(keys)


def counts_by_window(events: DataFrame, time: str, key: str, width: str = "1 hour", delay: str = "2 hours") -> DataFrame:
    """(start, key, n) per window, final once the watermark has passed it; later rows are dropped."""
    return events.withColumn(time, F.col(time).cast("timestamp")).withWatermark(time, delay).groupBy(F.window(time, width), key).agg(F.count("*").alias("n")).select(F.col("window.start").alias("start"), key, "n")


def match_stream(components: DataFrame, entries: DataFrame) -> DataFrame:
    """(comp_id, cve_id) for each range of the static ``entries`` that holds the version of a streamed component.

    Components without version or platform name match nothing; an advisory with several ranges that hold the
    version comes once for each.
    """
    known = components.withColumn("vendor", advisories.cpe_part(F.col("cpe"), 3)).withColumn("product", advisories.cpe_part(F.col("cpe"), 4))
    known = known.where("vendor is not null and product is not null and coalesce(version, '') <> ''").withColumn("vkey", version_key(F.col("version")))
    hits = known.select("comp_id", "vendor", "product", "vkey").join(advisories.nvd_bounds(entries), ["vendor", "product"]).where(advisories.in_bounds(F.col("vkey")))
    return hits.select("comp_id", F.col("id").alias("cve_id"))


def run_to_end(stream: DataFrame, spark: SparkSession, name: str, mode: str = "append") -> DataFrame:
    """All rows a finite stream gives, as a table ``name`` in the shared folder; for backfills.

    Every batch writes a part of its own (in complete mode the one part there is), so a batch that is run again
    replaces what it wrote before. Nothing comes to the driver.
    """
    ensure_checkpoint_dir(spark)
    path = f"{spark.sparkContext.getCheckpointDir()}/{name}"

    def write(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{path}/part={0 if mode == 'complete' else number}")

    query = stream.writeStream.outputMode(mode).foreachBatch(write).option("checkpointLocation", f"{path}-progress").trigger(availableNow=True).start()
    query.awaitTermination()
    try:
        return spark.read.parquet(path).select(*stream.columns)
    except AnalysisException:  # no batch at all
        return spark.createDataFrame([], stream.schema)
