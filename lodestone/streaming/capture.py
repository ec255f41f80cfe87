"""Capture as a stream: each message once, calendar buckets that close, late rows set aside."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.normal import canonical_id
from ..functions.text import half_year
from ..runtime import scratch_path


def once(stream: DataFrame, at: str = "received_at", late: str = "30 days") -> DataFrame:
    """The first delivery of each id; state of older ids is given up after ``late``. Rows without id pass."""
    keyed = stream.withColumn("_key", F.coalesce(canonical_id(F.col("id")), F.concat(F.lit("row "), F.col("row_id").cast("string"))))
    return keyed.withWatermark(at, late).dropDuplicatesWithinWatermark(["_key"]).drop("_key")


def tumbling(stream: DataFrame, at: str, width: str, late: str, *keys: str) -> DataFrame:
    """Counts per closed window; a window comes out once, when nothing for it may arrive any more."""
    w = stream.withWatermark(at, late).groupBy(F.window(at, width), *keys).agg(F.count(F.lit(1)).alias("n"))
    return w.select(F.col("window.start").alias("start"), *keys, "n")


def half_years(stream: DataFrame, epoch: str) -> DataFrame:
    """Counts per calendar half-year, which is no fixed duration, as a running aggregate."""
    return stream.groupBy(half_year(F.col(epoch)).alias("period")).agg(F.count(F.lit(1)).alias("n"))


def drained(stream: DataFrame, mode: str = "append") -> DataFrame:
    """Run a stream over all that is there now, into the shared folder, and read the result."""
    spark = stream.sparkSession
    path = scratch_path(spark, "stream")
    if mode == "append":
        q = stream.writeStream.outputMode("append").format("parquet").option("path", path).option("checkpointLocation", path + "-state").trigger(availableNow=True).start()
    else:

        def put(batch: DataFrame, epoch: int) -> None:
            batch.write.mode("overwrite").parquet(path)

        q = stream.writeStream.outputMode(mode).foreachBatch(put).option("checkpointLocation", path + "-state").trigger(availableNow=True).start()
    q.awaitTermination()
    return spark.read.schema(stream.schema).parquet(path)


def source(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    path = f"{sf_dir}/{name}.parquet"
    schema = spark.read.parquet(path).schema
    # A table is one file or a folder of files; the stream reads either.
    target = spark._jvm.org.apache.hadoop.fs.Path(path)
    if target.getFileSystem(spark._jsc.hadoopConfiguration()).getFileStatus(target).isFile():
        return spark.readStream.schema(schema).option("pathGlobFilter", f"{name}.parquet").parquet(sf_dir)
    return spark.readStream.schema(schema).parquet(path)
