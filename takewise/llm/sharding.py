"""Sharding by a two-pass external shuffle, with columns only.

1. Rows are scattered uniformly into buckets by a seeded hash of their number in the input, so equal texts, ids or
   sources meet no more often than others do. There are as many buckets as keep one near BUCKET_BYTES, and at least one
   a shuffle partition, each partition with equally many.
2. Each bucket, which fits in memory, is put through a Fisher-Yates shuffle (Spark's shuffle() of an array) and written.

The written order, bucket after bucket, is a uniform random permutation of the rows. It is cut into shards of equal
counts: shard s has the places from ceil(s * n / shards) on, so counts are at most one apart (the law `rows`), slots have
no gaps, and a bucket's rows lie in few shards. Only buckets' counts are summed up across partitions, in two levels.

The permutation is drawn once, as it is written; what is read later, by lost executors too, is that table. With the same
seed, files and settings it is drawn alike. With ids given twice, each row has its own place.

Defined results: a null text has size 8 and the CRC-32 of no bytes; null and repeated ids and equal rows are dealt as
all others are, equal texts too (the law of counts leaves no room to keep them together); with fewer rows than shards
some shards are empty; an empty table gives an empty one; all of the table's columns are kept, as one struct.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import rewritten, stage_folder, text_of, whole_rows, width

SHARDS = 24
SEED = 2024
#: Bytes of a bucket, about; a task holds one at a time.
BUCKET_BYTES = 16 << 20
#: Buckets at most, of which each has a row in a broadcast table of under 32 MB; beyond that they get larger.
MOST_BUCKETS = 1 << 20
#: Bytes that a record takes beside its text.
OVERHEAD = 8


def size_of(text: Column) -> Column:
    return F.octet_length(text).cast("long") + F.lit(OVERHEAD)


def shuffled(df: DataFrame, text_col: str = "text", seed: int = SEED, bucket_bytes: int = BUCKET_BYTES, folder: str | None = None) -> DataFrame:
    """(bucket, place, row) of all rows of df in a random order by (bucket, place), written to a folder (a new one in the
    shared folder unless given) and read again."""
    parts = width(df)
    total = df.agg(F.sum(size_of(text_of(text_col)))).first()[0] or 0
    each = min(-(-total // (bucket_bytes * parts)), max(1, MOST_BUCKETS // parts))  # buckets a partition
    buckets = parts * max(1, each)
    scattered = df.select(F.pmod(F.xxhash64(F.lit(seed), F.monotonically_increasing_id()), F.lit(buckets)).alias("bucket"), whole_rows(df))
    scattered = scattered.withColumn("part", F.pmod("bucket", F.lit(parts)).cast("int")).repartitionById(parts, "part")
    mixed = scattered.groupBy("part", "bucket").agg(F.shuffle(F.collect_list("row"), seed).alias("rows"))
    placed = mixed.select("bucket", F.posexplode("rows").alias("place", "row"))
    return rewritten(placed, folder or stage_folder(df.sparkSession))


def offsets(written: DataFrame, block: int = 1024) -> DataFrame:
    """(bucket, before): the rows in the buckets before each one, summed up within blocks of buckets and over blocks."""
    counts = written.groupBy("bucket").agg(F.count("*").alias("n")).withColumn("block", F.floor(F.col("bucket") / block))
    earlier = lambda w, n: F.coalesce(F.sum(n).over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    inside = counts.withColumn("inside", earlier(Window.partitionBy("block").orderBy("bucket"), "n"))
    blocks = counts.groupBy("block").agg(F.sum("n").alias("n"))  # MOST_BUCKETS / block rows at most
    blocks = blocks.select("block", earlier(Window.orderBy("block"), "n").alias("outside"))
    return inside.join(F.broadcast(blocks), "block").select("bucket", (F.col("inside") + F.col("outside")).alias("before"))


def deal(df: DataFrame, shards: int = SHARDS, text_col: str = "text", seed: int = SEED, bucket_bytes: int = BUCKET_BYTES, folder: str | None = None) -> DataFrame:
    """(row, shard, slot) for each row of df, row a struct of its columns."""
    written = shuffled(df, text_col, seed, bucket_bytes, folder)
    rows = written.count()
    placed = written.join(F.broadcast(offsets(written)), "bucket").withColumn("at", F.col("before") + F.col("place"))
    shard = F.expr(f"at * {shards} div {max(1, rows)}")
    first = F.expr(f"(shard * {rows} + {shards - 1}) div {shards}")
    return placed.withColumn("shard", shard).select("row", F.col("shard").cast("int").alias("shard"), (F.col("at") - first).alias("slot"))


def write_shards(df: DataFrame, folder: str, **rule) -> None:
    """df's columns and `slot` as Parquet in a folder `shard=s` for each shard; rule as in deal. Files have rows by slot."""
    dealt = deal(df, **rule).select("row.*", "shard", "slot")
    dealt.sortWithinPartitions("shard", "slot").write.partitionBy("shard").parquet(folder)


def digest(dealt: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, size, text_crc32, law, shard, slot, grown_shard) of what deal returns."""
    text = F.coalesce(F.col("row").getField(text_col).cast("string"), F.lit(""))
    return dealt.select(
        F.col("row").getField(id_col).alias(id_col),
        size_of(text).alias("size"),
        F.crc32(text.cast("binary")).alias("text_crc32"),
        F.lit("rows").alias("law"),
        "shard",
        "slot",
        F.lit(None).cast("int").alias("grown_shard"),
    )
