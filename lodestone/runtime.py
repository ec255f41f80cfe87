"""Session helpers: shared scratch storage, lineage cuts and worker caches."""

from __future__ import annotations

import os
import tempfile
import uuid
from contextlib import contextmanager

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

_OWN_DIR = os.path.join(tempfile.gettempdir(), f"lodestone-{os.getpid()}")


def session(app: str = "lodestone", cpus: str = "8", **conf: str) -> SparkSession:
    """A local session with the settings the library is tested under."""
    builder = (
        SparkSession.builder.master(f"local[{cpus}]")
        .appName(app)
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.shuffle.partitions", str(cpus))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.ui.enabled", "false")
        .config("spark.driver.memory", os.environ.get("LODESTONE_DRIVER_MEMORY", "8g"))
    )
    for name, value in conf.items():
        builder = builder.config(name, value)
    return builder.getOrCreate()


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share.

    It is the session's ``spark.checkpoint.dir``. Only where that is unset and
    the master is local, as in tests on one machine, a local temporary folder is
    chosen and set; a cluster without the setting is an error.
    """
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if not folder:
        set_before = spark.sparkContext._jsc.sc().getCheckpointDir()
        master = spark.sparkContext.master
        if set_before.isDefined():
            folder = set_before.get()
        elif master != "local" and not master.startswith("local["):
            raise RuntimeError("spark.checkpoint.dir must name a folder that all executors share")
        else:
            folder = f"file://{_OWN_DIR}"
            spark.sparkContext.setCheckpointDir(folder)
            spark.conf.set("spark.checkpoint.dir", folder)
    return folder.rstrip("/")


_SCRATCH: dict[str, list[str]] = {}


def scratch_path(spark: SparkSession, tag: str) -> str:
    path = f"{shared_dir(spark)}/lodestone/{tag}-{uuid.uuid4().hex[:12]}"
    _SCRATCH.setdefault(spark.sparkContext.applicationId, []).append(path)
    return path


def release(spark: SparkSession) -> int:
    """Delete the intermediate tables that this application has made; results must be written before. Returns how many there were."""
    paths = _SCRATCH.pop(spark.sparkContext.applicationId, [])
    for path in paths:
        delete_path(spark, path)
    return len(paths)


def cut(df: DataFrame, tag: str) -> DataFrame:
    """Write ``df`` to the shared folder and read it back, cutting its lineage."""
    spark = df.sparkSession
    path = scratch_path(spark, tag)
    df.write.parquet(path)
    return read_back(spark, path, df.schema)


def read_back(spark: SparkSession, path: str, schema: T.StructType) -> DataFrame:
    out = spark.read.schema(schema).parquet(path)
    out._lodestone_path = path
    return out


def drop(*frames: DataFrame | None) -> None:
    """Delete the files behind frames made by :func:`cut` that nothing reads any more."""
    for df in frames:
        path = getattr(df, "_lodestone_path", None)
        if path:
            delete_path(df.sparkSession, path)


@contextmanager
def shuffles_cleared(spark: SparkSession):
    """Within it, what a query has shuffled is deleted as soon as the query is done."""
    name = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    before = spark.conf.get(name, "false")
    spark.conf.set(name, "true")
    try:
        yield
    finally:
        spark.conf.set(name, before)


def delete_path(spark: SparkSession, path: str) -> None:
    jvm = spark._jvm
    target = jvm.org.apache.hadoop.fs.Path(path)
    target.getFileSystem(spark._jsc.hadoopConfiguration()).delete(target, True)


def write_text(spark: SparkSession, path: str, text: str) -> None:
    """Write a small file so that it appears whole or not at all; an existing one is an error."""
    jvm = spark._jvm
    target, part = jvm.org.apache.hadoop.fs.Path(path), jvm.org.apache.hadoop.fs.Path(f"{path}.{uuid.uuid4().hex[:8]}.tmp")
    system = target.getFileSystem(spark._jsc.hadoopConfiguration())
    out = system.create(part)
    out.write(bytearray(text.encode("utf-8")))
    out.close()
    if system.exists(target) or not system.rename(part, target):
        system.delete(part, False)
        raise FileExistsError(path)


def read_text(spark: SparkSession, path: str) -> str:
    return "\n".join(r[0] for r in spark.read.option("wholetext", True).text(path).collect())


def names_in(spark: SparkSession, path: str) -> list[str]:
    """The names of what a folder holds; none if it does not exist."""
    target = spark._jvm.org.apache.hadoop.fs.Path(path)
    system = target.getFileSystem(spark._jsc.hadoopConfiguration())
    return sorted(s.getPath().getName() for s in system.listStatus(target)) if system.exists(target) else []


def worker_cache(key: str, build):
    """A value kept for the life of a Python worker process, across its tasks."""
    import builtins

    cache = builtins.__dict__.setdefault("_lodestone_worker_cache", {})
    if key not in cache:
        cache[key] = build()
    return cache[key]


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def key128(*cols: Column) -> list[Column]:
    """Two independent 64-bit hashes of the columns, together a 128-bit key."""
    return [F.xxhash64(*cols), F.xxhash64(F.lit("k2"), *cols)]


def skew_join(left: DataFrame, right: DataFrame, on: list[str], weight: str, total: int, share: int = 200) -> DataFrame:
    """Inner join where one key may hold a large part of ``left``.

    ``right`` has one row per key, ``weight`` says how many rows of ``left`` the
    key has. Keys with more than ``total / share`` rows are at most ``share`` in
    number, so that part of ``right`` has a proven bound and is broadcast; the
    others meet in an ordinary shuffled join that no single key dominates.
    """
    limit = max(1, total // share)
    hot = right.filter(F.col(weight) > limit)
    flags = F.broadcast(hot.select(*on, F.lit(True).alias("_hot")))
    marked = left.join(flags, on, "left")
    cold_part = marked.filter(F.col("_hot").isNull()).drop("_hot").join(right.filter(F.col(weight) <= limit), on)
    hot_part = left.join(F.broadcast(hot), on)
    return cold_part.unionByName(hot_part)
