"""Gates that takes must pass before anything is derived from them. A take that fails has an error code in its row.

takes has take_id, sample_rate and n_samples, for ingest_verdict pair_id, side and readable too; samples has take_id
and pcm, a take's samples in one row or in chunks.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..config import DURATION_SEC, SAMPLE_RATE, SILENCE_RMS


def downmix(channels: DataFrame, by: tuple[str, ...] = ("take_id",)) -> DataFrame:
    """(by, pcm): the mean of all channels, sample by sample, of rows (by, channel, pcm), chunks of the same samples
    having the same by. Where channels differ in length, the mean is of those that go on."""
    together = channels.groupBy(*by).agg(F.collect_list("pcm").alias("all"))
    longest = F.array_max(F.transform("all", F.size))
    places = F.when(longest > 0, F.sequence(F.lit(0), longest - 1)).otherwise(F.array().cast("array<int>"))

    def mean(i: Column) -> Column:
        there = F.filter(F.transform("all", lambda x: F.get(x, i).cast("double")), lambda v: v.isNotNull())
        return F.aggregate(there, F.lit(0.0), lambda a, v: a + v) / F.size(there)

    return together.select(*by, F.transform(places, mean).alias("pcm"))


def duration(n_samples: Column, rate: Column) -> Column:
    return F.coalesce(n_samples, F.lit(0)) / F.when(rate > 0, rate)


def duration_code(seconds: Column, low: float, high: float) -> Column:
    """The bounds themselves are allowed."""
    return F.when(seconds < low, "INPUT_TOO_SHORT").when(seconds > high, "INPUT_TOO_LONG")


def duration_gate(takes: DataFrame, low: float = DURATION_SEC[0], high: float = DURATION_SEC[1]) -> DataFrame:
    """(take_id, duration_sec, error_code); without a positive sample rate CORE_BUILD_FAILED and no duration."""
    seconds = duration(F.col("n_samples"), F.col("sample_rate"))
    return takes.select("take_id", seconds.alias("duration_sec"), F.when(seconds.isNull(), "CORE_BUILD_FAILED").otherwise(duration_code(seconds, low, high)).alias("error_code"))


def loudness(samples: DataFrame) -> DataFrame:
    """(take_id, rms, finite) over whole takes, from sums of the chunks."""
    x = F.transform("pcm", lambda v: v.cast("double"))
    squares = F.aggregate(x, F.lit(0.0), lambda a, v: a + v * v)
    odd = F.exists(x, lambda v: F.isnan(v) | (F.abs(v) == float("inf")))
    sums = samples.select("take_id", squares.alias("s"), F.size("pcm").alias("n"), odd.alias("odd")).groupBy("take_id").agg(F.sum("s").alias("s"), F.sum("n").alias("n"), F.bool_or("odd").alias("odd"))
    return sums.select("take_id", F.when(F.col("n") > 0, F.sqrt(F.col("s") / F.col("n"))).alias("rms"), (~F.col("odd")).alias("finite"))


def silence_code(rms: Column, floor: float) -> Column:
    """A take without samples is silent; the floor itself is not."""
    return F.when(F.coalesce(rms, F.lit(0.0)) < floor, "INPUT_SILENT")


def silence_gate(takes: DataFrame, samples: DataFrame, floor: float = SILENCE_RMS) -> DataFrame:
    """(take_id, rms, error_code) for each take, with samples or without."""
    joined = takes.select("take_id").join(loudness(samples), "take_id", "left")
    return joined.select("take_id", "rms", silence_code(F.col("rms"), floor).alias("error_code"))


def nonfinite_gate(samples: DataFrame) -> DataFrame:
    """(take_id, error_code): any NaN or infinite sample fails the take."""
    return loudness(samples).select("take_id", F.when(~F.col("finite"), "CORE_BUILD_FAILED").alias("error_code"))


def ingest_verdict(takes: DataFrame, samples: DataFrame, rate: int = SAMPLE_RATE, low: float = DURATION_SEC[0], high: float = DURATION_SEC[1], floor: float = SILENCE_RMS) -> DataFrame:
    """(pair_id, usable, first_code): a take's code is that of its first failing gate (unreadable, another sample rate,
    duration, silence, samples that are no numbers); a pair's is its reference's, else its practice's. A pair is usable
    if both sides are there and pass; a missing side counts as unreadable."""
    seconds = duration(F.col("n_samples"), F.col("sample_rate"))
    code = F.coalesce(
        F.when(~F.coalesce("readable", F.lit(False)) | ~F.coalesce(F.col("sample_rate") > 0, F.lit(False)), "INPUT_UNREADABLE"),
        F.when(F.col("sample_rate") != rate, "CORE_BUILD_FAILED"),
        duration_code(seconds, low, high), silence_code(F.col("rms"), floor), F.when(~F.col("finite"), "CORE_BUILD_FAILED"),
    )
    judged = takes.join(loudness(samples), "take_id", "left").select("pair_id", "side", F.coalesce(code, F.lit("")).alias("code"))
    of = lambda s: F.coalesce(F.max(F.when(F.col("side") == s, F.col("code"))), F.lit("INPUT_UNREADABLE"))
    pairs = judged.groupBy("pair_id").agg(of("reference").alias("r"), of("practice").alias("p"))
    first = F.coalesce(F.nullif("r", F.lit("")), F.nullif("p", F.lit("")))
    return pairs.select("pair_id", first.isNull().alias("usable"), first.alias("first_code"))
