"""Catalogues of files: songs, roles, skipped entries, and the order in which names are listed."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.lineage import cut


def number_of(name: Column) -> Column:
    """The whole number before a name's first underscore, of 38 digits at most besides leading zeros, or null."""
    head = F.substring_index(name, "_", 1)
    return F.when(head.rlike("^0*[0-9]{1,38}$"), F.regexp_replace(head, "^0+(?=[0-9])", "").cast("decimal(38,0)"))


def take_catalog(paths: DataFrame, original: str = "original.wav", melody: str = "melody.wav", practice: str = "practice") -> DataFrame:
    """(song, title, role, name, path, reason) for each distinct path song/file or song/practice/file of a column path.
    Roles are `original`, `melody` and `practice` (WAV files in that folder); what is none of these is `skipped` with the
    reason, and so is all of a song that has no take, by `no take in this song`."""
    p = paths.select("path").where("path is not null").distinct().withColumn("part", F.split("path", "/"))
    depth, last = F.size("part"), F.element_at("part", -1)
    wav = F.lower(last).endswith(".wav")
    role = F.when((depth == 2) & (last == original), "original").when((depth == 2) & (last == melody), "melody").when((depth == 3) & (F.get("part", F.lit(1)) == practice) & wav, "practice")
    reason = F.when(~wav, "not a .wav file").when(role.isNull(), "not at a place of takes")
    rows = p.select("path", F.get("part", F.lit(0)).alias("song"), F.coalesce(role, F.lit("skipped")).alias("role"), F.regexp_replace(last, "(?i)[.]wav$", "").alias("name"), F.when(role.isNull(), reason).alias("reason"))
    songs = rows.groupBy("song").agg(F.count_if(F.col("role") != "skipped").alias("takes"))
    rows = rows.join(songs, "song").withColumn("reason", F.when(F.col("takes") == 0, "no take in this song").otherwise(F.col("reason")))
    title = F.when(F.contains("song", F.lit("_")), F.expr("substr(song, instr(song, '_') + 1)")).otherwise(F.col("song"))
    return rows.select("song", title.alias("title"), "role", "name", "path", "reason")


def catalog_counts(catalog: DataFrame) -> DataFrame:
    """(song, n_original, n_melody, n_practice, n_skipped)"""
    n = lambda r: F.count_if(F.col("role") == r).alias(f"n_{r}")
    return catalog.groupBy("song").agg(n("original"), n("melody"), n("practice"), n("skipped"))


def natural_order(names: DataFrame, name: str, key: str, partitions: int | None = None) -> DataFrame:
    """names with place, from 1: names that start with a number by it, the others last, then by name and key. Rows are
    dealt out by ranges of all three, so that equal numbers, or none, don't meet in one task; a partition's rows are
    counted, and its first place is the sum of the counts before it, a row a partition."""
    n = partitions or int(names.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    order = [F.col("__none"), F.col("__number"), F.col(name), F.col(key)]
    rows = names.withColumn("__number", number_of(F.col(name))).withColumn("__none", F.col("__number").isNull())
    placed = rows.repartitionByRange(n, *order).sortWithinPartitions(*order).withColumn("__at", F.monotonically_increasing_id())
    # written out, as the ranges are sampled anew if the table is derived again
    placed = cut(placed.withColumn("__part", F.shiftright("__at", 33)).withColumn("__at", F.col("__at").bitwiseAND(F.lit((1 << 33) - 1))))
    counts = placed.groupBy("__part").agg(F.count("*").alias("n"))
    sizes = {r["__part"]: r["n"] for r in counts.collect()}  # a row a partition
    first, total = [], 0
    for part in sorted(sizes):
        first += [F.lit(part), F.lit(total)]
        total += sizes[part]
    if not first:
        return placed.withColumn("place", F.col("__at")).drop("__number", "__none", "__at", "__part")
    start = F.element_at(F.create_map(*first), F.col("__part"))
    return placed.withColumn("place", F.col("__at") + start.cast("bigint") + 1).drop("__number", "__none", "__at", "__part")
