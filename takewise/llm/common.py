"""Helpers that the corpus operators share."""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.lineage import cut, forget, shared_folder

#: bytes.translate table that lower-cases A-Z and nothing else.
LOWER_AZ = bytes(c + 32 if 65 <= c <= 90 else c for c in range(256))

#: The same, with a space for each other byte of ASCII that is neither a letter nor a digit.
WORD_BYTES = bytes(c if c >= 128 or chr(c).isalnum() else 32 for c in LOWER_AZ)


#: Bytes of an Arrow batch between Spark and a Python worker, at most; Spark's own bound is 64 MB.
BATCH_BYTES = 4 << 20


def small_batches(spark: SparkSession) -> None:
    """Keeps Arrow batches small, in the executors' memory outside the heap as well as in the workers'. This setting of
    the session stays, as queries read it when they run, after the call that makes them."""
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(BATCH_BYTES))


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    small_batches(spark)
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def rewritten(df: DataFrame, folder: str) -> DataFrame:
    """Writes a table to a folder as Parquet and reads it again."""
    df.write.parquet(folder)
    return df.sparkSession.read.parquet(folder)


def stage_folder(spark: SparkSession) -> str:
    """A new name in the shared folder."""
    return f"{shared_folder(spark)}/{uuid.uuid4().hex}"


def whole_rows(df: DataFrame) -> Column:
    """df's columns as one struct, so that helper columns beside it clash with none of them; `row.*` has them again."""
    return F.struct(*(F.col(f"`{c}`") for c in df.columns)).alias("row")


def slices(batches: Iterator[pa.RecordBatch], rows: int = 256) -> Iterator[pa.RecordBatch]:
    """The batches in slices of so many rows, so that Python objects are made of a few texts at a time; at the end of
    the task Arrow gives back what it holds."""
    for batch in batches:
        for at in range(0, batch.num_rows, rows):
            yield batch.slice(at, rows)
    pa.default_memory_pool().release_unused()


def text_of(name: str = "text") -> Column:
    """The text as a string; null counts as empty."""
    return F.coalesce(F.col(name).cast("string"), F.lit(""))


def width(df: DataFrame) -> int:
    """Partitions for an explicit repartition: the session's number of shuffle partitions."""
    return int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))


def crc_class(id_col: str, parts: int) -> Column:
    """crc32 of the id's decimal text, modulo parts; null ids have the class of the empty text."""
    return F.pmod(F.crc32(F.coalesce(F.col(id_col).cast("string"), F.lit("")).cast("binary")), F.lit(parts))


def keep_by_id(docs: DataFrame, kept: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """The rows of docs whose id is in kept, by a shuffle join that copes with a null id."""
    ids = kept.select(F.col(id_col).alias("kept_id")).distinct()
    rows = docs.select(F.col(id_col).alias("own_id"), whole_rows(docs))
    return rows.join(ids, F.col("own_id").eqNullSafe(F.col("kept_id")), "left_semi").select("row.*")
