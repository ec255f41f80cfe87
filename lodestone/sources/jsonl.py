"""JSON lines in and out: nothing is dropped without being counted."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

CORRUPT = "_corrupt_record"


def _struct(**fields: T.DataType) -> T.StructType:
    return T.StructType([T.StructField(name, kind) for name, kind in fields.items()])


_S, _L = T.StringType(), T.LongType()
EVIDENCE = _struct(
    id=_S, cell_id=_S, source=_S, url=_S, title=_S, text=_S, author=_S, community=_S,
    engagement=_struct(score=_L, comments=_L), created_utc=_L, captured_utc=_L, query=_S,
)
HEALTH = _struct(source=_S, status=_S, fallback=_S, detail=_S)


def scan(spark: SparkSession, paths: list[str], schema: T.StructType = EVIDENCE) -> tuple[DataFrame, DataFrame]:
    """Rows of JSON-lines files and folders, and a health row per file.

    Lines that are no JSON objects of the schema are left out of the rows and
    counted as ``dropped`` in the health table, where a file without a sound line
    is ``unavailable``, one with a bad line ``degraded``. Paths named twice are read once.
    Rows keep their file as ``_file``.
    """
    wide = T.StructType([*schema.fields, T.StructField(CORRUPT, T.StringType())])
    unique = list(dict.fromkeys(p.rstrip("/") for p in paths))
    raw = (
        spark.read.schema(wide).option("mode", "PERMISSIVE").option("columnNameOfCorruptRecord", CORRUPT)
        .option("recursiveFileLookup", "true").option("pathGlobFilter", "*.jsonl").json(unique)
        .withColumn("_file", F.input_file_name())
    )
    first = schema.fieldNames()[0]
    good = F.col(CORRUPT).isNull() & F.col(first).isNotNull()
    counts = raw.groupBy("_file").agg(F.count(F.lit(1)).alias("lines"), F.count_if(~good).alias("dropped"))
    status = F.when(F.col("dropped") == F.col("lines"), "unavailable").when(F.col("dropped") > 0, "degraded").otherwise("ok")
    return raw.filter(good).drop(CORRUPT), counts.withColumn("status", status)


def read_health(spark: SparkSession, path: str) -> DataFrame:
    """A health log written as JSON lines or as one JSON array per file."""
    text = spark.read.text(path, wholetext=True)
    body = F.trim("value")
    array = F.from_json(body, T.ArrayType(HEALTH))
    lines = F.transform(F.filter(F.split(body, "\n"), lambda x: F.trim(x) != ""), lambda x: F.from_json(x, HEALTH))
    entries = F.when(body.startswith("["), array).otherwise(lines)
    return text.select(F.posexplode(entries).alias("seq", "h")).select("seq", "h.*").filter("source is not null")


def append_new(rows: DataFrame, path: str, key: str = "id") -> None:
    """Append the rows whose key is not in ``path`` yet, the first of each key; null keys are always new."""
    spark = rows.sparkSession
    fresh = rows.filter(F.col(key).isNotNull()).dropDuplicates([key])
    try:
        there = spark.read.schema(rows.schema).json(path).select(key).filter(F.col(key).isNotNull()).distinct()
        fresh = fresh.join(there, key, "left_anti")
    except Exception as e:  # a first write has nothing to read
        if "PATH_NOT_FOUND" not in str(e):
            raise
    fresh.unionByName(rows.filter(F.col(key).isNull())).write.mode("append").json(path)


def lines(spark: SparkSession, path: str) -> DataFrame:
    """Non-blank lines of a text file that are no comments."""
    t = spark.read.text(path).select(F.trim("value").alias("line"))
    return t.filter("line <> '' and not startswith(line, '#')")


def inputs(spark: SparkSession, paths: list[str]) -> tuple[list[str], DataFrame]:
    """The files behind ``paths`` (files, or folders searched to any depth), each once by its real path, and a problem row for every path that is not there.

    Names that begin with a dot or an underscore are scratch files and left out.
    """
    jvm, conf = spark._jvm, spark._jsc.hadoopConfiguration()
    found: dict[str, None] = {}
    problems = []
    for p in paths:
        target = jvm.org.apache.hadoop.fs.Path(p)
        system = target.getFileSystem(conf)
        if not system.exists(target):
            problems.append((p, "not found"))
            continue
        each = system.listFiles(system.resolvePath(target), True)
        while each.hasNext():
            real = system.resolvePath(each.next().getPath())
            if not real.getName().startswith((".", "_")) and real.getName().endswith((".json", ".jsonl")):
                found[real.toString()] = None
    return sorted(found), spark.createDataFrame(problems, "path string, problem string")


def document(spark: SparkSession, path: str, schema: T.StructType) -> DataFrame:
    """A JSON document as one row; no row if the file is not there or holds no object of the schema."""
    files, _ = inputs(spark, [path])
    if not files:
        return spark.createDataFrame([], schema)
    read = spark.read.schema(schema).option("multiLine", True).option("mode", "PERMISSIVE").json(files)
    return read.filter(F.coalesce(*[F.col(f"`{f}`").isNotNull().cast("int") * 0 for f in schema.fieldNames()]).isNotNull()).dropna("all")


def write_by_source(rows: DataFrame, path: str, one_file: bool = False) -> None:
    """Evidence as JSON lines, one folder for each source or all together; rows of a source that is null go under its default name."""
    (rows.write if one_file else rows.write.partitionBy("source")).mode("append").json(path)


def append_health(entries: DataFrame, path: str) -> None:
    """Add health entries to a log; nothing that stands there is read or changed."""
    entries.select(*HEALTH.fieldNames()).write.mode("append").json(path)


def strict_json(row: DataFrame) -> DataFrame:
    """Every row as one JSON text without not-a-number or infinite values, which become null."""
    def finite(f):
        c = F.col(f"`{f.name}`")
        if isinstance(f.dataType, (T.DoubleType, T.FloatType)):
            c = F.when(F.isnan(c) | (F.abs(c) == float("inf")), None).otherwise(c)
        return c.alias(f.name)

    return row.select(F.to_json(F.struct(*[finite(f) for f in row.schema.fields]), {"ignoreNullFields": "false"}).alias("json"))
