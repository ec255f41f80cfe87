"""Encoding of a corpus with a public byte-level BPE tokenizer, by overlapping chunks.

A short text is encoded where it is read. A long one is cut into overlapping
chunks that are pre-tokenised in parallel; neighbours are stitched at the first
position in their overlap that both see as the start of a pre-token. What a
pre-token is depends only on what follows its start, so from there on both
agree; the pieces between stitches are encoded in parallel and their ids joined.
"""

from __future__ import annotations

import base64
import os

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..runtime import table, worker_cache

TOKENIZERS = os.environ.get("LODESTONE_TOKENIZERS", "/opt/tokenizers")
VOCABULARY = "byte_bpe_50k.tiktoken"
#: Fixed value: the pre-tokenisation pattern that belongs to the vocabulary.
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
CHUNK, OVERLAP = 16_384, 512


def encoder(vocabulary: str):
    """The tokenizer of a vocabulary file, built once per worker."""

    def build():
        import tiktoken

        with open(vocabulary, "rb") as lines:
            ranks = {base64.b64decode(a): int(b) for a, b in (line.split() for line in lines)}
        return tiktoken.Encoding("public", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})

    return worker_cache(f"encoder|{vocabulary}", build)


def _list_array(parts: list) -> pa.Array:
    """An Arrow list<int32> column from one list of ids per row."""
    import numpy as np

    offsets = np.zeros(len(parts) + 1, np.int32)
    np.cumsum([len(p) for p in parts], out=offsets[1:])
    flat = np.fromiter((i for p in parts for i in p), np.int32, count=int(offsets[-1])) if len(parts) else np.empty(0, np.int32)
    return pa.ListArray.from_arrays(pa.array(offsets), pa.array(flat))


def boundaries(text: str) -> list[int]:
    """The starts of the pre-tokens of a text."""
    import regex

    rx = worker_cache("pre-tokens", lambda: regex.compile(PATTERN))
    return [m.start() for m in rx.finditer(text)]


def chunk_spans(length: int, chunk: int, overlap: int) -> list[tuple[int, int]]:
    """Spans of overlapping chunks: each ends ``overlap`` characters into the next one."""
    starts = range(0, max(1, length), chunk)
    return [(s, min(length, s + chunk + overlap)) for s in starts]


def encode_column(df: DataFrame, key: str, text: str, vocabulary: str, chunk: int = CHUNK, overlap: int = OVERLAP) -> DataFrame:
    """``(key, ids)`` for every row of ``df``.

    A null and an empty text have the ids ``[]``. Strings that look like special
    tokens are ordinary text. Repeated rows and null keys
    each come out; the key is only carried. Joining the tokens' bytes gives back the text's UTF-8 bytes.
    """
    short = F.col(text).isNull() | (F.length(text) <= chunk)
    kind = df.schema[key].dataType.simpleString()
    narrow = df.select(F.col(key).alias("_key"), F.col(text).alias("_text"))

    def encode(batches):
        enc = encoder(vocabulary)
        for batch in batches:
            ids = [enc.encode_ordinary(t) if t else [] for t in batch.column("_text").to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column("_key"), _list_array(ids)], names=["_key", "ids"])

    small = narrow.filter(short).mapInArrow(encode, f"_key {kind}, ids array<int>")

    def chunks(batches):
        for batch in batches:
            for key_, copy, t in zip(*(batch.column(c) for c in ("_key", "copy", "_text"))):
                t = t.as_py()
                spans = chunk_spans(len(t), chunk, overlap)
                # Few chunks at a time, so a long text is not held twice.
                for at in range(0, len(spans), 64):
                    some = spans[at : at + 64]
                    fields = [pa.array(range(at, at + len(some)), pa.int32()), pa.array([s for s, _ in some], pa.int64()), pa.array([t[s:e] for s, e in some], pa.string())]
                    yield pa.RecordBatch.from_arrays([pa.array([key_.as_py()] * len(some), key_.type), pa.array([copy.as_py()] * len(some), pa.int64()), *fields],
                                                     names=["_key", "copy", "i", "start", "part"])

    def pre_tokenise(batches):
        for batch in batches:
            head, tail = [], []
            for s, part in zip(batch.column("start").to_pylist(), batch.column("part").to_pylist()):
                e = s + len(part)
                marks = [s + m for m in boundaries(part)]
                head.append([m for m in marks if m < s + overlap])
                # A piece must not end in white space: where a run of it is split depends on what follows. The last
                # boundary is not trusted, as the end of the chunk may have made it.
                tail.append([m for m in marks[:-1] if e - overlap <= m < e - 1 and m > s and not part[m - s - 1].isspace()])
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in ("_key", "copy", "i", "start", "part")), _list_array(head), _list_array(tail)],
                                             names=["_key", "copy", "i", "start", "part", "head", "tail"])

    def encode_pieces(batches):
        enc = encoder(vocabulary)
        for batch in batches:
            ids = [enc.encode_ordinary(t) for t in batch.column("part").to_pylist()]
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in ("_key", "copy", "piece")), _list_array(ids)], names=["_key", "copy", "piece", "ids"])

    width = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    named = narrow.filter(~short).withColumn("copy", F.monotonically_increasing_id())
    parts = named.mapInArrow(chunks, f"_key {kind}, copy bigint, i int, start bigint, part string")
    marked = parts.repartition(width, "copy", "i").mapInArrow(pre_tokenise, f"_key {kind}, copy bigint, i int, start bigint, part string, head array<int>, tail array<int>")
    # Only neighbours meet: a chunk ends where the next one and itself see the same boundary first.
    follows = W.partitionBy("copy").orderBy("i")
    stop = F.array_min(F.array_intersect("tail", F.lead("head").over(follows)))
    stitched = marked.select("_key", "copy", "i", "start", "part", stop.alias("stop"), F.lead("start").over(follows).alias("next"))
    begun = stitched.withColumn("begin", F.lag("stop").over(follows))
    piece = F.sum(F.when(F.col("begin").isNull(), 0).otherwise(1)).over(follows)
    first, last = F.coalesce("begin", "start"), F.coalesce("stop", "next", F.col("start") + F.length("part"))
    own = F.substring(F.col("part"), (first - F.col("start") + 1).cast("int"), (last - first).cast("int"))
    cut_up = begun.select("_key", "copy", "i", piece.alias("piece"), own.alias("part"))
    # Neighbours without a common boundary are one piece: one run of characters as long as the overlap joins them.
    whole = cut_up.groupBy("_key", "copy", "piece").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("i", "part"))), lambda x: x["part"]), "").alias("part"))
    encoded = whole.repartition(width, "copy", "piece").mapInArrow(encode_pieces, f"_key {kind}, copy bigint, piece bigint, ids array<int>")
    joined = encoded.groupBy("_key", "copy").agg(F.array_sort(F.collect_list(F.struct("piece", "ids"))).alias("p"))
    large = joined.select("_key", F.flatten(F.col("p.ids")).alias("ids"))
    return small.unionByName(large).select(F.col("_key").alias(key), "ids")


def count_column(df: DataFrame, text: str, vocabulary: str, carried: list[str]) -> DataFrame:
    """``carried`` columns and ``n_tokens`` of every row; 0 for null and empty texts."""
    fields = [f for f in df.select(*carried).schema.fields]
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in fields) + ", n_tokens bigint"

    def count(batches):
        enc = encoder(vocabulary)
        for batch in batches:
            n = [len(enc.encode_ordinary(t)) if t else 0 for t in batch.column(text).to_pylist()]
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in carried), pa.array(n, pa.int64())], names=[*carried, "n_tokens"])

    return df.select(*carried, text).mapInArrow(count, schema)


def p8_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The ids of every document by byte_bpe_50k."""
    return encode_column(table(spark, sf_dir, "documents"), "doc_id", "text", f"{TOKENIZERS}/{VOCABULARY}")


QUERIES = {"p8_ids": p8_ids}
ORACLES: dict[str, str] = {}
