"""Sets of row positions inside data files: deletion and selection vectors.

A position is (file, index of the row in the file). A set is written to the
shared folder as one small bitmap per 65536 positions of a file, spread over
folders by file, so that a task that reads one file loads the bitmaps of that
file only. Wide columns never move: a scan asks the set about its own rows.
"""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..runtime import scratch_path, worker_cache

CHUNK = 65536
FOLDERS = 64
#: A worker keeps the bitmaps of so many files.
HELD = 64
FILE, POS = "_ls_file", "_ls_pos"


def scan_with_positions(spark: SparkSession, path: str, columns: list | None = None) -> DataFrame:
    """A parquet scan with every row's file and index beside the asked columns."""
    df = spark.read.parquet(path)
    wanted = ["*"] if columns is None else list(columns)
    return df.select(*wanted, F.col("_metadata.file_path").alias(FILE), F.col("_metadata.row_index").alias(POS))


def write_positions(positions: DataFrame, tag: str) -> str:
    """Write the set of ``(FILE, POS)`` rows; returns its path. Repeated positions count once."""
    spark = positions.sparkSession
    path = scratch_path(spark, tag)
    chunks = (
        positions.select(FILE, F.expr(f"{POS} div {CHUNK}").alias("chunk"), F.expr(f"cast({POS} % {CHUNK} as int)").alias("at"))
        .groupBy(FILE, "chunk")
        .agg(F.array_sort(F.collect_set("at")).alias("at"))
        .select(FILE, "chunk", "at", F.pmod(F.crc32(F.encode(FILE, "UTF-8")), F.lit(FOLDERS)).cast("int").alias("folder"))
    )
    # A chunk holds at most 65536 positions, whatever the size of its file.
    chunks.mapInArrow(_pack, f"{FILE} string, chunk bigint, bits binary, folder int").write.partitionBy("folder").parquet(path)
    return path


def _pack(batches):
    import numpy as np

    for batch in batches:
        if not batch.num_rows:
            continue
        bits = []
        for at in batch.column("at"):
            mask = np.zeros(CHUNK, dtype=bool)
            mask[at.values.to_numpy(zero_copy_only=False)] = True
            bits.append(np.packbits(mask).tobytes())
        yield pa.RecordBatch.from_arrays(
            [batch.column(FILE), batch.column("chunk"), pa.array(bits, pa.binary()), batch.column("folder")],
            names=[FILE, "chunk", "bits", "folder"],
        )


class Positions:
    """The worker's side of a position set."""

    def __init__(self, path: str):
        self.path = path

    def _of(self, file: str) -> dict:
        import zlib

        import pyarrow.dataset as ds
        from pyarrow import fs

        def load() -> dict:
            system, root = fs.FileSystem.from_uri(self.path)
            folder = f"{root}/folder={zlib.crc32(file.encode()) % FOLDERS}"
            if system.get_file_info(folder).type == fs.FileType.NotFound:
                return {}
            found = ds.dataset(folder, filesystem=system, format="parquet").to_table(filter=ds.field(FILE) == file)
            return dict(zip(found.column("chunk").to_pylist(), found.column("bits").to_pylist()))

        held = worker_cache("positions", dict)
        key = (self.path, file)
        if key not in held:
            if len(held) >= HELD:
                held.pop(next(iter(held)))
            held[key] = load()
        return held[key]

    def contains(self, files: list, positions) -> "np.ndarray":
        """For each row whether its position is in the set."""
        import numpy as np

        out = np.zeros(len(positions), dtype=bool)
        if not len(positions):
            return out
        names = np.asarray(files, dtype=object)
        for file in set(files):
            rows = np.nonzero(names == file)[0]
            chunks = self._of(file)
            at = positions[rows]
            for chunk in np.unique(at // CHUNK):
                packed = chunks.get(int(chunk))
                if packed is not None:
                    mask = np.unpackbits(np.frombuffer(packed, np.uint8)).astype(bool)
                    inside = at // CHUNK == chunk
                    out[rows[inside]] = mask[at[inside] % CHUNK]
        return out


def position_filter(path: str, inside: bool):
    """A pandas UDF over (file, position): whether the row is in the set (or out of it)."""
    import pandas as pd
    from pyspark.sql.functions import pandas_udf

    def keep(file, pos):
        found = Positions(path).contains(file.tolist(), pos.to_numpy())
        return pd.Series(found if inside else ~found)

    return pandas_udf(keep, "boolean")
