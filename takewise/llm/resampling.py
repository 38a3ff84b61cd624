"""Importance resampling to a target distribution, ranked by a distributed radix sort.

Features are the runs of 1 to `longest` words, hashed into buckets by CRC-32. The corpus' and the target's bucket counts,
two arrays of BUCKETS entries, give each bucket a gain; a document's weight is the sum of its features' gains, looked up
in that array, and its score adds a Gumbel draw from a hash of its id. The share of documents with the highest scores is
drawn, which is sampling without replacement in proportion to the weights' exponentials.

Ranks come from a least-significant-digit radix sort over the composite key (drawable at all, score from the highest,
id, features): places start as rows lie in their partitions; a pass counts the current digit's values in each partition, a
prefix sum over (digit, partition) gives each its first destination, each row goes to its destination (the next row of
its digit), and the rows are sent there: stable, as rows keep their order within a digit. The partitions are equal
ranges of places, so no key, however hot, makes one larger. Only the counts go through the driver: COUNTS at most, as
digits get narrower with more partitions.

Defined results: a null or blank text has no features, so weight 0, and is not drawn if a least number of words is asked;
a null id has the hash of the empty text and comes after all others of its score; of rows with equal score and id those
with fewer features come first (what is still equal differs in nothing that is returned); buckets that a table lacks
count as 0; empty tables give empty results, or gains against an empty target; other columns are not read.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator
from zlib import crc32

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import WORD_BYTES, cut, slices, text_of, width

BUCKETS = 10_000
SEED = 2024
#: Words that a document must have to be drawn, and the percentage drawn of those that have them.
LEAST_WORDS = 20
PERCENT = 10
#: Counts of (digit, partition) at most: 16 MB in the driver and in each worker.
COUNTS = 1 << 21
#: Bits of a place's number within its partition.
INDEX_BITS = 33


def words_of(raw: bytes) -> list[bytes]:
    """Words of a UTF-8 text: letters and digits of ASCII, A-Z lower-cased, and all beyond ASCII."""
    return raw.translate(WORD_BYTES).split()


def feature_buckets(words: list[bytes], longest: int = 1, buckets: int = BUCKETS) -> np.ndarray:
    """The bucket of each run of 1 to longest words."""
    runs = words if longest == 1 else [b" ".join(words[i : i + k]) for k in range(1, longest + 1) for i in range(len(words) - k + 1)]
    return np.fromiter(map(crc32, runs), np.int64, len(runs)) % buckets


def bucket_counts(df: DataFrame, text_col: str = "text", longest: int = 1, buckets: int = BUCKETS) -> np.ndarray:
    """Features of all texts by bucket; a task sends a row a bucket at most."""

    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(buckets, dtype=np.int64)
        for batch in slices(batches):
            for raw in batch.column("text").cast(pa.binary()).to_pylist():
                total += np.bincount(feature_buckets(words_of(raw), longest, buckets), minlength=buckets)
        at = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(total[at])], ["bucket", "n"])

    rows = df.select(text_of(text_col).alias("text")).mapInArrow(counted, "bucket long, n long").groupBy("bucket").agg(F.sum("n").alias("n")).collect()
    found = np.zeros(buckets, dtype=np.int64)
    for r in rows:
        found[r["bucket"]] = r["n"]
    return found


def gains(corpus: np.ndarray, target: np.ndarray) -> np.ndarray:
    """Thousandths of the logarithm of how much more often the target has a bucket than the corpus, smoothed by one."""
    many, few, size = float(corpus.sum()), float(target.sum()), float(len(corpus))
    return np.array([math.floor(1000 * math.log((t + 1.0) * (many + size) / ((s + 1.0) * (few + size)))) for s, t in zip(corpus.tolist(), target.tolist())], dtype=np.int64)


def draw(doc_id: int | None, seed: int = SEED) -> int:
    """Thousandths of a Gumbel draw that the id decides."""
    h = int(hashlib.sha256(b"%d:%s" % (seed, b"" if doc_id is None else b"%d" % doc_id)).hexdigest()[:8], 16)
    return math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296)))


def scored(df: DataFrame, gain: np.ndarray, id_col: str = "doc_id", text_col: str = "text", longest: int = 1, seed: int = SEED) -> DataFrame:
    """(id, n_words, n_features, weight, score) of each row."""
    held = df.sparkSession.sparkContext.broadcast(gain)  # a number a bucket
    names = ["id", "n_words", "n_features", "weight", "score"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = held.value
        for batch in slices(batches):
            ids, found = batch.column("id").to_pylist(), []
            for doc_id, raw in zip(ids, batch.column("text").cast(pa.binary()).to_pylist()):
                words = words_of(raw)
                at = feature_buckets(words, longest, len(table))
                weight = int(table[at].sum())
                found.append((len(words), len(at), weight, weight + draw(doc_id, seed)))
            yield pa.RecordBatch.from_arrays([batch.column("id"), *(pa.array([x[i] for x in found], pa.int64()) for i in range(4))], names)

    rows = df.select(F.col(id_col).cast("long").alias("id"), text_of(text_col).alias("text"))
    return rows.mapInArrow(run, ", ".join(f"{n} long" for n in names))


def _digit(fields: list[np.ndarray], bits: list[int], low: int, width_: int) -> np.ndarray:
    """Bits low to low + width_ of the composite key whose fields, from the least significant, have so many bits each."""
    out, at = np.zeros(len(fields[0]), dtype=np.int64), 0
    for field, n in zip(fields, bits):
        first, last = max(low, at), min(low + width_, at + n)
        if first < last:
            part = (field >> np.uint64(first - at)) & np.uint64((1 << (last - first)) - 1)
            out |= part.astype(np.int64) << (first - low)
        at += n
    return out


def radix_ranks(rows: DataFrame, keys: list[str], partitions: int | None = None, counts: int = COUNTS) -> DataFrame:
    """rows with column `rank`, from 1, in the order of their long columns keys (the first decides first, nulls last; all
    ascending), by LSD radix passes."""
    parts = max(1, min(partitions or width(rows), counts // 4))
    digit_bits = max(2, int(math.log2(counts // parts)))
    radix = 1 << digit_bits
    start = cut(rows.repartition(parts).withColumn("place", F.monotonically_increasing_id()))
    bounds = start.agg(F.count("*").alias("n"), *(f(k).alias(f"{f.__name__}_{k}") for k in keys for f in (F.min, F.max))).first()
    n = bounds["n"]
    chunk = max(1, -(-n // parts))
    least, most = ({k: bounds[f"{f}_{k}"] or 0 for k in keys} for f in ("min", "max"))
    order = keys[::-1]
    bits = [(most[k] - least[k] + 1).bit_length() for k in order]  # one value more, for nulls
    passes = max(1, -(-sum(bits) // digit_bits))

    def digits(batch: pa.RecordBatch, low: int) -> np.ndarray:
        fields = []
        for k in order:
            column = batch.column(k)
            field = column.fill_null(least[k]).to_numpy().view(np.uint64) - np.array(least[k], dtype=np.int64).view(np.uint64)
            fields.append(np.where(column.is_null().to_numpy(zero_copy_only=False), np.uint64(most[k] - least[k] + 1), field))
        return _digit(fields, bits, low, digit_bits)

    def parted(batch: pa.RecordBatch) -> Iterator[tuple[int, np.ndarray]]:
        """A batch's rows by their partition of places."""
        of = batch.column("place").to_numpy() >> INDEX_BITS
        for p in np.unique(of):
            yield int(p), np.flatnonzero(of == p)

    table, schema = start, start.schema
    for i in range(passes):
        low = i * digit_bits

        def counted(batches: Iterator[pa.RecordBatch], low: int = low) -> Iterator[pa.RecordBatch]:
            found: dict[int, np.ndarray] = {}
            for batch in batches:
                d = digits(batch, low)
                for p, at in parted(batch):
                    found.setdefault(p, np.zeros(radix, dtype=np.int64))
                    found[p] += np.bincount(d[at], minlength=radix)
            yield pa.RecordBatch.from_arrays([pa.array(list(found), pa.int64()), pa.array([x.tobytes() for x in found.values()], pa.binary())], ["part", "counts"])

        first = np.zeros((parts, radix), dtype=np.int64)
        for r in table.mapInArrow(counted, "part long, counts binary").collect():  # parts * radix numbers in all
            first[r["part"]] += np.frombuffer(r["counts"], dtype=np.int64)
        before = np.cumsum(first.T.ravel())
        first = np.concatenate(([0], before[:-1])).reshape(radix, parts).T
        held = rows.sparkSession.sparkContext.broadcast(np.ascontiguousarray(first))

        def dealt(batches: Iterator[pa.RecordBatch], low: int = low, held=held, last: bool = i == passes - 1) -> Iterator[pa.RecordBatch]:
            free: dict[int, np.ndarray] = {}  # the next destination of each digit
            for batch in batches:
                d, to = digits(batch, low), np.zeros(batch.num_rows, dtype=np.int64)
                for p, at in parted(batch):
                    nexts = free.setdefault(p, held.value[p].copy())
                    mine = at[np.argsort(d[at], kind="stable")]
                    values, begin, times = np.unique(d[mine], return_index=True, return_counts=True)
                    to[mine] = np.repeat(nexts[values] - begin, times) + np.arange(len(mine))
                    nexts[values] += times
                place = to + 1 if last else (to // chunk << INDEX_BITS) | to % chunk
                yield batch.set_column(batch.schema.get_field_index("place"), "place", pa.array(place))

        table = table.mapInArrow(dealt, schema)
        if i < passes - 1:
            where = F.shiftright("place", INDEX_BITS).cast("int")
            table = cut(table.repartitionById(parts, where).sortWithinPartitions("place"))
    return table.withColumnRenamed("place", "rank")


def resample(df: DataFrame, target: DataFrame, id_col: str = "doc_id", text_col: str = "text", target_text: str = "text", longest: int = 1, buckets: int = BUCKETS, seed: int = SEED, least_words: int = LEAST_WORDS, percent: int = PERCENT, partitions: int | None = None) -> DataFrame:
    """(id, n_features, weight, score, rank) of each row of df; rank is null for rows not drawn. percent of the documents
    with least_words words or more are drawn, rounded down."""
    gain = gains(bucket_counts(df, text_col, longest, buckets), bucket_counts(target, target_text, longest, buckets))
    rows = scored(df, gain, id_col, text_col, longest, seed)
    rows = rows.select("id", "n_features", "weight", "score", (F.col("n_words") < least_words).cast("long").alias("short"), (-F.col("score")).alias("down"))
    ranked = cut(radix_ranks(rows, ["short", "down", "id", "n_features"], partitions))
    drawn = percent * ranked.where("short = 0").count() // 100
    rank = F.when(F.col("rank") <= drawn, F.col("rank"))  # those with too few words come last
    return ranked.select(F.col("id").alias(id_col), "n_features", "weight", "score", rank.alias("rank"))
