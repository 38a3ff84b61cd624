"""Exact duplicates by sorting contents.

Sampled splitters range-partition the normalised texts, Spark's external sort places equal ones next to each other,
and each text is compared with its neighbour in full. The sort order is the text's first bytes, then its SHA-256
(which orders texts that share a long start without comparing them byte by byte), then the text, then the id from the
largest down; so the first row of a run of equals is the one that stays.

The id is part of the range key: a text that a third of the rows share is spread over as many partitions as it fills.
Runs that a partition's border cuts are put together again from the partitions' first and last runs, two rows a
partition, matched by SHA-256; that table is bounded by the number of partitions and is the only thing broadcast.
The samples are 100 keys a partition, each of under 150 bytes.

Defined results: a null text counts as empty; of rows with equal text and equal id one stays; a null id is smaller
than any; an empty table gives an empty one; other columns are not read.
"""

from __future__ import annotations

import hashlib
from bisect import bisect_right
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import LOWER_AZ, cut, slices, text_of, whole_rows, width

#: Bytes of a text in the range key.
HEAD = 64
#: Rows sampled for each part of drop_copies, and the sample's seed.
SAMPLE = 100
SEED = 1


def _normalise(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in slices(batches):
        texts = [x.translate(LOWER_AZ) for x in batch.column("text").cast(pa.binary()).to_pylist()]
        yield pa.RecordBatch.from_arrays(
            [batch.column("id"), pa.array([x[:HEAD] for x in texts], pa.binary()), pa.array([hashlib.sha256(x).digest() for x in texts], pa.binary()), pa.array(texts, pa.binary())],
            ["id", "head", "digest", "norm"],
        )


def _runs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows of runs of equal texts; only ids are held until a run ends."""
    names = ["id", "keep", "size", "first", "edge", "part", "digest"]
    part = TaskContext.get().partitionId()
    open_ids: list[pa.Array] = []
    last = digest = None
    started = 0

    def closed(edge: bool) -> pa.RecordBatch:
        ids = pa.concat_arrays(open_ids)
        n = len(ids)
        first = np.zeros(n, dtype=bool)
        first[0] = True
        full = lambda v, kind: pa.array([v], kind).take(pa.array(np.zeros(n, dtype=np.int32)))
        return pa.RecordBatch.from_arrays([ids, full(ids[0].as_py(), pa.int64()), full(n, pa.int64()), pa.array(first), full(edge, pa.bool_()), full(part, pa.int32()), full(digest, pa.binary())], names)

    for batch in batches:
        n = batch.num_rows
        if not n:
            continue
        norm, ids, digests = batch.column("norm"), batch.column("id"), batch.column("digest")
        new = np.ones(n, dtype=bool)
        new[0] = last is None or norm[0].as_py() != last
        if n > 1:
            new[1:] = pc.not_equal(norm[1:], norm[:-1]).to_numpy(zero_copy_only=False)
        starts = np.flatnonzero(new)
        if len(starts) == 0 or starts[0] > 0:
            open_ids.append(ids[: starts[0] if len(starts) else n])
        if len(starts):
            if open_ids:
                yield closed(edge=started == 1)
            # all runs that start and end in this batch at once
            sizes = np.diff(np.append(starts, n))
            inner, at = starts[:-1], starts[-1]
            if len(inner):
                lo = int(inner[0])
                k = at - lo
                keep = np.repeat(inner, sizes[:-1])
                edge = np.zeros(k, dtype=bool)
                if started == 0:
                    edge[: sizes[0]] = True
                yield pa.RecordBatch.from_arrays([ids[lo:at], ids.take(pa.array(keep)), pa.array(np.repeat(sizes[:-1], sizes[:-1])), pa.array(new[lo:at]), pa.array(edge), pa.array(np.full(k, part, dtype=np.int32)), digests[lo:at]], names)
            started += len(starts)
            open_ids, digest = [ids[at:]], digests[int(at)].as_py()
        last = norm[n - 1].as_py()
    if open_ids:
        yield closed(edge=True)


def group_copies(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", partitions: int | None = None) -> DataFrame:
    """(id, keep_id, group_size, kept, text_sha256), a row for each row of df; of a group of texts that are equal but
    for the case of A-Z, the row with the largest id is kept."""
    rows = df.select(F.col(id_col).cast("long").alias("id"), text_of(text_col).alias("text"))
    rows = rows.mapInArrow(_normalise, "id long, head binary, digest binary, norm binary")
    largest_first = F.col("id").desc_nulls_last()
    rows = rows.repartitionByRange(partitions or width(df), "head", "digest", largest_first).sortWithinPartitions("head", "digest", "norm", largest_first)
    runs = cut(rows.mapInArrow(_runs, "id long, keep long, size long, first boolean, edge boolean, part int, digest binary"))
    edges = runs.where("edge and first").groupBy("digest").agg(F.sum("size").alias("all_size"), F.max("keep").alias("all_keep"), F.min("part").alias("first_part"))
    found = runs.join(F.broadcast(edges.withColumnRenamed("digest", "edge_digest")), F.when(F.col("edge"), F.col("digest")) == F.col("edge_digest"), "left")
    return found.select(
        F.col("id").alias(id_col),
        F.coalesce("all_keep", "keep").alias("keep_id"),
        F.coalesce("all_size", "size").alias("group_size"),
        (F.col("first") & F.coalesce(F.col("part") == F.col("first_part"), F.lit(True))).alias("kept"),
        F.lower(F.hex("digest")).alias("text_sha256"),
    )


def _firsts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The first row of each run of equal texts, `edge` where the run is the partition's first or last."""
    part = TaskContext.get().partitionId()
    last: bytes | None = None
    waiting: pa.RecordBatch | None = None  # the last run's first row
    runs = 0

    def out(rows: pa.RecordBatch, edge: bool) -> pa.RecordBatch:
        n = rows.num_rows
        return pa.RecordBatch.from_arrays([rows.column("row"), rows.column("digest"), pa.array(np.full(n, edge)), pa.array(np.full(n, part, dtype=np.int32))], ["row", "digest", "edge", "part"])

    for batch in batches:
        new = []
        for i, text in enumerate(batch.column("norm").to_pylist()):
            if text != last:
                new.append(i)
                last = text
        if not new:
            continue
        first = batch.take(pa.array(new, pa.int32()))
        if waiting is not None:
            yield out(waiting, runs == 1)
        runs += len(new)
        if len(new) > 1:
            if waiting is None:
                yield out(first.slice(0, 1), True)
            yield out(first.slice(int(waiting is None), len(new) - 1 - int(waiting is None)), False)
        waiting = first.slice(len(new) - 1)
    if waiting is not None:
        yield out(waiting, True)


def _largest_first(digest: bytes, doc_id: int | None) -> tuple:
    return digest, doc_id is None, -(doc_id or 0)


def _splitters(df: DataFrame, id_col: Column, norm: Column, parts: int) -> list[tuple]:
    """parts - 1 keys that cut a sample of df, SAMPLE rows a part, into equal parts. They are drawn once, so that rows go
    to the same part whenever their table is derived."""
    share = min(1.0, SAMPLE * parts / max(1, df.count()))
    rows = df.sample(False, share, SEED).select(F.substring(norm, 1, HEAD).alias("head"), F.unhex(F.sha2(norm, 256)).alias("digest"), id_col.alias("id"))
    keys = sorted((bytes(r["head"]), *_largest_first(bytes(r["digest"]), r["id"])) for r in rows.collect())
    return [keys[len(keys) * i // parts] for i in range(1, parts)] if keys else []


def drop_copies(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", partitions: int | None = None) -> DataFrame:
    """df's rows that are kept, one of each group; of rows with equal text and id any one. Whole rows are sorted by
    their texts, in one shuffle; runs that a partition's border cuts are known by their SHA-256, two rows a partition."""
    parts = partitions or width(df)
    norm = lambda text: _lower_az(F.coalesce(text.cast("string"), F.lit(""))).cast("binary")
    splitters = _splitters(df, F.col(id_col).cast("long"), norm(F.col(text_col)), parts)

    @F.arrow_udf("int")
    def part_of(head: pa.Array, digest: pa.Array, doc_id: pa.Array) -> pa.Array:
        keys = zip(head.to_pylist(), digest.to_pylist(), doc_id.to_pylist())
        return pa.array([bisect_right(splitters, (h, *_largest_first(d, i))) for h, d, i in keys], pa.int32())

    rows = df.select(whole_rows(df), F.col(id_col).cast("long").alias("id"), norm(F.col(text_col)).alias("norm"))
    rows = rows.select("row", "id", F.substring("norm", 1, HEAD).alias("head"), F.unhex(F.sha2("norm", 256)).alias("digest"))
    rows = rows.withColumn("part", part_of("head", "digest", "id")).repartitionById(parts, "part").drop("part")
    order = ("head", "digest", "norm", F.col("id").desc_nulls_last())
    rows = rows.withColumn("norm", norm(F.col("row").getField(text_col))).sortWithinPartitions(*order)  # made again, not shuffled
    schema = T.StructType([rows.schema["row"], T.StructField("digest", T.BinaryType()), T.StructField("edge", T.BooleanType()), T.StructField("part", T.IntegerType())])
    firsts = rows.select("row", "digest", "norm").mapInArrow(_firsts, schema)
    edges = firsts.where("edge").groupBy(F.col("digest").alias("edge_digest")).agg(F.min("part").alias("first_part"))
    joined = firsts.join(F.broadcast(edges), F.when(F.col("edge"), F.col("digest")) == F.col("edge_digest"), "left")
    return joined.where(F.coalesce(F.col("part") == F.col("first_part"), F.lit(True))).select("row.*")


def _lower_az(text: Column) -> Column:
    return F.when(F.octet_length(text) == F.length(text), F.lower(text)).otherwise(F.translate(text, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"))
