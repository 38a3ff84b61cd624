"""Pitch, timing and dynamics of pairs."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from ..config import DB_FLOOR, DEAD_BAND_SEC, MIN_NOTE_SEC, OFF_PITCH_CENTS, PITCH_HOP, SAMPLE_RATE
from ..functions.scalars import log2, to_db
from .pairing import notes_with_frames, pair_by_ordinal


def mad(df: DataFrame, by: list[str], value: str) -> DataFrame:
    """(by, median, mad) of a value in each group."""
    middle = df.select(*by, F.col(value).alias("value"), F.median(value).over(W.partitionBy(*by)).alias("median"))
    return middle.groupBy(*by).agg(F.first("median").alias("median"), F.median(F.abs(F.col("value") - F.col("median"))).alias("mad"))


def note_deviation(notes: DataFrame, frames: DataFrame, least_frames: float = MIN_NOTE_SEC * SAMPLE_RATE / PITCH_HOP) -> DataFrame:
    """(pair_id, note_no, cents, ref_hz, prac_hz) of notes paired by ordinal: the median cents of the practice note's
    voiced frames less that of the reference note's, both against the reference note's f0_hz, and each side's median
    pitch. All three are null, and the note counts as unpaired, where a side is missing, has less than least_frames or no
    voiced frame. notes has pair_id, side, take_id, note_no, f0_hz, start_frame and span_end (exclusive); frames
    take_id, frame, voiced and f0_hz.

    A median of cents lies between those of the two middle pitches, so these alone are kept of a note, and measured once
    the reference note is beside them. Cents of just 50 are common and are told from more by the last bit, so they are
    computed in the order told here. Both tables are read once; with pair_id in frames too, all is grouped by the pair,
    and tables bucketed by it need no exchange."""
    key = [c for c in ("pair_id", "take_id") if c in frames.columns]
    carried = tuple(c for c in ("pair_id", "side") if c not in key)
    spans = notes.withColumn("base_hz", F.col("f0_hz"))
    rows = notes_with_frames(frames.select(*key, "frame", "voiced", "f0_hz"), spans, key, (*carried, "base_hz"))
    long_ = F.greatest(F.lit(1), F.col("span_end") - F.col("start_frame")) >= least_frames
    sung = F.col("framed") & (F.col("voiced") == 1) & (F.col("f0_hz") > 0) & long_
    middle = lambda way: F.expr(f"percentile_disc(0.5) within group (order by sung {way})")
    found = rows.withColumn("sung", F.when(sung, F.col("f0_hz"))).groupBy("pair_id", "take_id", "side", "note_no").agg(
        middle("asc").alias("low"), middle("desc").alias("high"), F.max("base_hz").alias("base_hz")
    )
    both = pair_by_ordinal(found, ["low", "high", "base_hz"])
    half = lambda c: 0.5 * (1200.0 * log2(F.col(c) / F.col("ref_base_hz")))
    of = lambda side: half(f"{side}_low") + half(f"{side}_high")
    both = both.withColumn("cents", F.when(F.col("ref_base_hz") > 0, of("prac") - of("ref")))
    hz = lambda side: F.when(F.col("cents").isNotNull(), 0.5 * F.col(f"{side}_low") + 0.5 * F.col(f"{side}_high")).alias(f"{side}_hz")
    return both.select("pair_id", "note_no", "cents", hz("ref"), hz("prac"))


def pitch_summary(deviation: DataFrame, off: float = OFF_PITCH_CENTS, rate: int = SAMPLE_RATE) -> DataFrame:
    """(pair_id, median_abs_cents, off_pitch_ratio, n_notes_used, n_unpaired, sample_rate) of note_deviation's rows."""
    used = F.count("cents")
    zero = lambda x: F.coalesce(x, F.lit(0.0))
    return deviation.groupBy("pair_id").agg(
        zero(F.median(F.abs("cents"))).alias("median_abs_cents"),
        zero(F.avg(F.when(F.col("cents").isNotNull(), (F.abs("cents") > off).cast("double")))).alias("off_pitch_ratio"),
        used.alias("n_notes_used"), (F.count("*") - used).alias("n_unpaired"), F.lit(rate).alias("sample_rate"),
    )


def timing_summary(found: DataFrame, dead: float = DEAD_BAND_SEC) -> DataFrame:
    """(pair_id, median_sec, spread_sec, early_ratio, late_ratio, on_time_ratio, n_notes_used, n_unpaired) of pair_onsets'
    rows; zeros where no note is matched, no row for a pair with an error."""
    found = found.where("error_code is null").select("pair_id", (F.col("prac_sec") - F.col("ref_sec")).alias("dev"))
    found = found.withColumn("middle", F.median("dev").over(W.partitionBy("pair_id")))
    zero = lambda x: F.coalesce(x, F.lit(0.0))
    share = lambda cond: zero(F.avg(F.when(F.col("dev").isNotNull(), cond.cast("double"))))
    return found.groupBy("pair_id").agg(
        zero(F.first("middle")).alias("median_sec"), zero(F.median(F.abs(F.col("dev") - F.col("middle")))).alias("spread_sec"),
        share(F.col("dev") < -dead).alias("early_ratio"), share(F.col("dev") > dead).alias("late_ratio"), share(F.abs("dev") <= dead).alias("on_time_ratio"),
        F.count("dev").alias("n_notes_used"), F.count_if(F.col("dev").isNull()).alias("n_unpaired"),
    )


def note_energy(frames: DataFrame, by: tuple[str, ...] = (), floor: float = DB_FLOOR) -> DataFrame:
    """(take_id, note_no, by, median_db, mean_db) of each note's frames, by naming columns that a take has one value of;
    spans that stay at the floor are dropped."""
    db = frames.withColumn("db", to_db(F.col("rms")))
    return db.groupBy("take_id", "note_no", *by).agg(F.median("db").alias("median_db"), F.avg("db").alias("mean_db"), F.max("db").alias("top")).where(F.col("top") > floor).drop("top")


def dynamics_summary(pairs: DataFrame) -> DataFrame:
    """pairs has pair_id, ref_db and prac_db; a missing side is null and counts one unpaired note a side there is."""
    d = pairs.withColumn("dev", F.col("prac_db") - F.col("ref_db")).withColumn("middle", F.median("dev").over(W.partitionBy("pair_id")))
    there = lambda c: F.col(c).isNotNull().cast("bigint")
    zero = lambda x: F.coalesce(x, F.lit(0.0))
    return d.groupBy("pair_id").agg(
        zero(F.first("middle")).alias("median_db"), zero(F.median(F.abs(F.col("dev") - F.col("middle")))).alias("spread_db"),
        F.count("dev").alias("n_notes_used"), F.sum(F.when(F.col("dev").isNull(), there("ref_db") + there("prac_db")).otherwise(0)).alias("n_unpaired"),
    )


def energy_ratio(frames: DataFrame) -> DataFrame:
    one = lambda s: F.avg(F.when(F.col("side") == s, F.col("rms")))
    return frames.groupBy("pair_id").agg((one("practice") / F.nullif(one("reference"), F.lit(0.0))).alias("energy_ratio"))
