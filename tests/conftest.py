import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

from lodestone.runtime import session  # noqa: E402

SMALL = "/root/testdata/sf0.001"


@pytest.fixture(scope="session")
def spark():
    s = session("tests", "4", **{"spark.sql.shuffle.partitions": "4", "spark.sql.adaptive.coalescePartitions.enabled": "true"})
    s.sparkContext.setLogLevel("ERROR")
    yield s
    s.stop()


@pytest.fixture(scope="session")
def small():
    return SMALL


EVIDENCE = (
    "row_id bigint, batch_id bigint, id string, cell_id string, source string, url string, title string, text string, author string, community string, "
    "engagement struct<score: bigint, comments: bigint>, created_utc bigint, captured_utc bigint, query string, received_at timestamp_ntz"
)


def evidence_row(row_id, **given):
    row = dict(row_id=row_id, batch_id=1, id=None, cell_id=None, source="reddit", url=None, title=None, text=None, author=None, community=None,
               engagement=None, created_utc=None, captured_utc=None, query=None, received_at=None)
    row.update(given)
    return tuple(row.values())


def write_evidence(spark, folder, rows, extra=None):
    """An evidence table of given rows; ``extra`` adds constant columns of any name."""
    from pyspark.sql import functions as F

    df = spark.createDataFrame([evidence_row(**r) if isinstance(r, dict) else r for r in rows], EVIDENCE)
    for name, value in (extra or {}).items():
        df = df.withColumn(name, F.lit(value))
    df.coalesce(2).write.mode("overwrite").parquet(f"{folder}/evidence_sample.parquet")
    return str(folder)


@pytest.fixture(scope="session")
def empty_tables(spark, tmp_path_factory):
    """All tables without a row."""
    folder = tmp_path_factory.mktemp("empty")
    for name in os.listdir(SMALL):
        spark.read.parquet(f"{SMALL}/{name}").limit(0).coalesce(1).write.parquet(f"{folder}/{name}")
    return str(folder)
