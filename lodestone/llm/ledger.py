"""Duplicates hidden by formatting differences: an incremental ledger of contents.

Two rows have the same content if title and text consist of the same letters and
digits in the same order. Letter case, whitespace, punctuation and the order of
labelled fields do not matter, and title and text may be exchanged.
"""

from __future__ import annotations

import json
import re
import uuid

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.normal import REMOVAL_MARKS, letters
from ..runtime import cut, delete_path, drop, key128, names_in, read_text, scratch_path, skew_join, table, write_text

#: A field starts the text or follows one of these separators.
_START = r"(?:^|[\n;|/])[\s\p{Z}\p{Cf}\-*•>]*"
_LABEL = r"\p{L}[\p{L} ]{1,39}?"
LABEL_SHARE = 0.005
NO_ROW = 2**63 - 1


def learn_labels(rows: DataFrame, share: float = LABEL_SHARE) -> list[str]:
    """The field labels of a corpus: what stands before a colon at field starts in many rows.

    Counted over all rows. A label needs ``share`` of the rows (at least three of them), so
    that at most ``1 / share`` times the mean number of labels in a row can be kept.
    An empty table has no labels.
    """
    # Texts without a colon are not searched.
    found = F.when(F.contains("text", F.lit(":")), F.regexp_extract_all("text", F.lit(rf"{_START}({_LABEL})[ ]?:"), F.lit(1)))
    counted = rows.select(F.explode(F.array_distinct(found)).alias("label")).groupBy(F.lower("label").alias("label")).count()
    n = rows.count()
    kept = counted.filter(F.col("count") >= max(3, share * n)).collect()
    return sorted(r["label"] for r in kept)


def content(c: Column, labels: list[str]) -> Column:
    """Letters and digits of a text; the fields of a text with labelled fields are sorted.

    A text with two or more of the labels is searched for field starts; for all
    others one replacement is enough. Two fields suffice where the text begins with one; elsewhere it takes three, since
    prose that is broken into lines may have a label word at the start of a line.
    """
    plain = letters(c)
    if not labels:
        return plain
    blank = r"[\s\p{Z}\p{Cf}]"
    either = "|".join(rf"{blank}+".join(map(re.escape, x.split())) for x in sorted(labels, key=len, reverse=True))
    heads = "".join(sorted({x[0] for x in labels}))
    start = rf"{_START}(?=[{heads}])(?=(?:{either})\b)"
    firsts = sorted({x.split()[0] for x in labels})

    def split(low: Column, present: Column) -> Column:
        parts = F.split(F.regexp_replace(low, start, "\u0001"), "\u0001")
        return _once(parts, lambda x: F.when(labelled(x, present), F.array_join(F.array_sort(F.filter(F.transform(x, letters), lambda y: y != "")), "\u0001")))

    def labelled(parts: Column, present: Column) -> Column:
        n = F.size(parts)
        return ((present >= 2) & (n > 2) & (F.element_at(parts, 1) == "")) | ((present >= 3) & (n > 3))

    def fields(low: Column) -> Column:
        """The sorted fields; null where the text is no labelled one. Only texts that may be labelled are split at all."""
        likely = lambda present: (present >= 3) | (present >= 2) & low.rlike(rf"^[\s\p{{Z}}\p{{Cf}}\-*•>;|/]*(?:{either})\b")
        present = sum(F.contains(low, F.lit(x)).cast("int") for x in firsts)
        return _once(present, lambda p: F.when(likely(p), split(low, p)))

    return F.coalesce(_once(F.lower(c), fields), plain)


def _once(value: Column, then) -> Column:
    """``then(value)``, for which the value is made once, however often it is used; Spark makes it anew in every branch of a condition."""
    return F.element_at(F.transform(F.array(value), then), 1)


def content_keys(rows: DataFrame, labels: list[str], extra: tuple = ()) -> DataFrame:
    """``(row_id, *extra, key_hi, key_lo)`` of every row; null keys for rows without text.

    Null, empty and removed texts, and texts without a letter or digit, have no
    content. A null title counts as an empty one. Rows without content are left
    for the caller to filter once the keys are written: a filter here would be pushed below
    and make every content twice.
    """
    title, text = F.coalesce(content(F.col("title"), labels), F.lit("")), content(F.col("text"), labels)
    pair = rows.select("row_id", *extra, title.alias("_a"), text.alias("_b"))
    there = (F.col("_b") != "") & ~F.col("_b").isin(*REMOVAL_MARKS)
    keys = [F.when(there, k) for k in key128(F.least("_a", "_b"), F.greatest("_a", "_b"))]
    return pair.select("row_id", *extra, keys[0].alias("key_hi"), keys[1].alias("key_lo"))


class Ledger:
    """Counts of every content seen so far, in buckets of the key, at ``path``.

    A batch is aggregated and placed by bucket; then each of its buckets is
    full-outer-joined with the same bucket of the ledger, which the task reads where it stands. Buckets
    that the batch does not touch are neither read nor written, and the ledger is
    never shuffled. Counts add up; the smallest row_id stays as representative. A
    version becomes visible with its manifest, so a broken batch leaves the last one as it was; what a version
    replaces is deleted when the next but one is complete. A batch that
    is given a name is booked once, however often it is applied. An empty batch changes nothing.

    ``labels`` belong to the ledger, since keys depend on them: they are kept with it, and opening it
    again takes them from there. ``buckets`` is fixed when the ledger is made; a bucket should fit
    into the memory of a task (a million contents take 32 MB). One writer at a time: a second one fails when it
    commits the same version. Keys of null are the caller's to leave out; a null row_id counts as a copy and is
    no representative.
    """

    def __init__(self, spark: SparkSession, path: str, labels: list[str] | None = None, buckets: int = 12):
        self.spark, self.path = spark, path.rstrip("/")
        kept = [x for x in names_in(spark, self.path) if re.fullmatch(r"manifest-\d+\.json", x)]
        if kept:
            self.state = json.loads(read_text(spark, f"{self.path}/{kept[-1]}"))
        else:
            self.state = {"version": 0, "labels": labels or [], "buckets": buckets, "at": {}, "batches": [], "stale": []}

    @property
    def labels(self) -> list[str]:
        return self.state["labels"]

    def apply(self, keys: DataFrame, batch: str | None = None) -> None:
        """Book the rows of one batch, given as their ``content_keys``."""
        state, path = self.state, self.path
        if batch is not None and batch in state["batches"]:
            return
        buckets, at, version = state["buckets"], dict(state["at"]), state["version"] + 1
        folder = f"{version:06d}-{uuid.uuid4().hex[:8]}"
        new = keys.groupBy("key_hi", "key_lo").agg(F.count(F.lit(1)).alias("copies"), F.coalesce(F.min("row_id"), F.lit(NO_ROW)).alias("first_row_id"))
        new = cut(new.select(F.pmod("key_hi", F.lit(buckets)).cast("int").alias("bucket"), "*"), "ledger-batch")
        # At most as many numbers as there are buckets.
        touched = [str(r[0]) for r in new.select("bucket").distinct().collect()]
        if touched:
            width = min(buckets, int(self.spark.conf.get("spark.sql.shuffle.partitions")))
            placed = new.repartition(width, "bucket").sortWithinPartitions("bucket")
            merged = placed.mapInArrow(lambda batches: _merge(batches, path, at), f"bucket int, {_ENTRY}")
            merged.write.partitionBy("bucket").parquet(f"{path}/v={folder}")
        drop(new)
        stale = [f"v={at[b]}/bucket={b}" for b in touched if b in at]
        following = {**state, "version": version, "at": {**at, **{b: folder for b in touched}}, "stale": stale, "batches": state["batches"] + [batch] * (batch is not None)}
        write_text(self.spark, f"{path}/manifest-{version:012d}.json", json.dumps(following))
        for old in state["stale"]:
            delete_path(self.spark, f"{path}/{old}")
        self.state = following

    def contents(self) -> DataFrame:
        """``(key_hi, key_lo, copies, first_row_id)``."""
        paths = [f"{self.path}/v={v}/bucket={b}" for b, v in sorted(self.state["at"].items())]
        if not paths:
            return self.spark.createDataFrame([], _ENTRY)
        found = self.spark.read.schema(_ENTRY).parquet(*paths)
        return found.withColumn("first_row_id", F.nullif("first_row_id", F.lit(NO_ROW)))


_ENTRY = "key_hi bigint, key_lo bigint, copies bigint, first_row_id bigint"
_FIELDS = ("key_hi", "key_lo", "copies", "first_row_id")


def _merge(batches, path: str, at: dict):
    """The buckets of one task: each joined with its present state, read from the shared folder."""
    import pyarrow.dataset as ds
    from pyarrow import fs

    def joined(bucket: int, parts: list):
        columns = [np.concatenate([p[k] for p in parts]) for k in range(4)]
        version = at.get(str(bucket))
        if version is not None:
            system, root = fs.FileSystem.from_uri(f"{path}/v={version}/bucket={bucket}")
            old = ds.dataset(root, filesystem=system, format="parquet").to_table(columns=list(_FIELDS))
            columns = [np.concatenate([x, old.column(f).to_numpy()]) for f, x in zip(_FIELDS, columns)]
        order = np.lexsort((columns[1], columns[0]))
        hi, lo, copies, first = (x[order] for x in columns)
        edge = np.ones(len(hi), bool)
        edge[1:] = (hi[1:] != hi[:-1]) | (lo[1:] != lo[:-1])
        start = np.nonzero(edge)[0]
        out = [np.full(len(start), bucket, np.int32), hi[start], lo[start], np.add.reduceat(copies, start), np.minimum.reduceat(first, start)]
        whole = pa.RecordBatch.from_arrays([pa.array(x) for x in out], names=["bucket", *_FIELDS])
        for s in range(0, whole.num_rows, 65_536):
            yield whole.slice(s, 65_536)

    held, bucket = [], None
    for batch in batches:
        numbers = batch.column("bucket").to_numpy()
        columns = [batch.column(f).to_numpy() for f in _FIELDS]
        for b in np.unique(numbers).tolist():
            if bucket is not None and b != bucket:
                yield from joined(bucket, held)
                held = []
            bucket = b
            mine = numbers == b
            held.append([x[mine] for x in columns])
    if held:
        yield from joined(bucket, held)


def booked(spark: SparkSession, rows: DataFrame, batch: str = "batch_id", slices: int = 3, extra: tuple = ()) -> tuple[DataFrame, Ledger]:
    """Book ``rows`` into a ledger of their own, in slices of arriving batches. Returns their keys and the ledger."""
    labels = learn_labels(rows)
    keys = cut(content_keys(rows, labels, (batch, *extra)), "content-keys").filter("key_hi is not null")
    low, high, n = keys.agg(F.min(batch), F.max(batch), F.count(F.lit(1))).first()
    buckets = max(int(spark.conf.get("spark.sql.shuffle.partitions")), n // 1_000_000)
    ledger = Ledger(spark, scratch_path(spark, "ledger"), labels, buckets)
    low, high = (0, 0) if low is None else (low, high)
    edges = [low + (high - low) * i // slices for i in range(1, slices)]
    bounds = [None, *sorted(set(edges)), None]
    number = F.coalesce(F.col(batch), F.lit(low))
    for start, end in zip(bounds, bounds[1:]):
        part = keys
        if start is not None:
            part = part.filter(number > start)
        if end is not None:
            part = part.filter(number <= end)
        ledger.apply(part, f"{start}..{end}")
    return keys, ledger


def p6_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row per copy of a content, with the first row of that content."""
    rows = table(spark, sf_dir, "evidence_sample").select("row_id", "batch_id", "title", "text")
    keys, ledger = booked(spark, rows)
    several = ledger.contents().filter("copies > 1")
    copies = skew_join(keys, several, ["key_hi", "key_lo"], "copies", keys.count())
    return copies.filter("row_id <> first_row_id").select("first_row_id", "row_id")


def p6_contents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every content once, by its earliest row, with its number of copies."""
    rows = table(spark, sf_dir, "evidence_sample").select("row_id", "batch_id", "title", "text")
    return booked(spark, rows)[1].contents().select(F.col("first_row_id").alias("row_id"), "copies")


QUERIES = {"p6_found": p6_found, "p6_contents": p6_contents}


_BLANK = r"[\s\p{Z}\p{Cf}]"
_START_SQL = r"(?:^|[\n;|/])[\s\p{Z}\p{Cf}\-*•>]*"


def _plain_sql(c: str) -> str:
    return rf"regexp_replace(replace(lower({c}), 'ß', 'ss'), '[^\p{{L}}\p{{N}}]+', '', 'g')"


def _content_sql(c: str) -> str:
    parts = rf"string_split(regexp_replace(lower({c}), '{_START_SQL}\b(' || either || ')\b', chr(1) || '\1', 'g'), chr(1))"
    fields = f"list_sort(list_filter(list_transform({parts}, lambda x: {_plain_sql('x')}), lambda x: x <> ''))"
    present = f"len(list_filter(heads, lambda h: contains(lower({c}), h)))"
    many = f"({present} >= 2 and len({parts}) > 2 and {parts}[1] = '' or {present} >= 3 and len({parts}) > 3)"
    return f"case when either is not null and {many} then array_to_string({fields}, chr(1)) else {_plain_sql(c)} end"


CONTENTS_SQL = rf"""
starts as (select unnest(list_distinct(regexp_extract_all(text, '{_START_SQL}(\p{{L}}[\p{{L}} ]{{1,39}}?)[ ]?:', 1))) as label from evidence_sample),
labels as (select lower(label) as label from starts group by 1 having count(*) >= greatest(3, 0.005 * (select count(*) from evidence_sample))),
l as (select string_agg(replace(label, ' ', '{_BLANK}+'), '|' order by length(label) desc, label) as either, list_distinct(list(split_part(label, ' ', 1))) as heads from labels),
t as (select row_id, coalesce({_content_sql('title')}, '') as a, {_content_sql('text')} as b from evidence_sample, l),
contents as (select row_id, least(a, b) || chr(2) || greatest(a, b) as k from t where b is not null and b not in ('', 'removed', 'deleted', 'removedbymoderator', 'deletedbyuser')),
firsts as (select row_id, min(row_id) over (partition by k) as first_row_id, count(*) over (partition by k) as copies from contents)"""
ORACLES = {
    "p6_found": f"with {CONTENTS_SQL} select first_row_id, row_id from firsts where row_id <> first_row_id",
    "p6_contents": f"with {CONTENTS_SQL} select row_id, copies from firsts where row_id = first_row_id",
}
