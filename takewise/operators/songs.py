"""The corpus job: note events of songs through melody choice, transposition, cropping to bars, repeats and planted defects to
expected notes, labels and a summary, for all songs at once. A song that cannot be used is a summary row with its error.
"""

from __future__ import annotations

from functools import reduce
from typing import NamedTuple

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from ..config import BEAT_TICKS, LEAD_SEC, TAIL_SEC
from ..functions.lineage import bucketed, cut
from ..functions.scalars import note_name
from . import scores


VARIANTS = ("pitch", "timing", "dynamics", "wrong_notes", "dropouts")


class Settings(NamedTuple):
    bar_ticks: int = 4 * BEAT_TICKS
    #: Ticks within which onsets count as one chord.
    chord: int = 6
    seed: int = 7
    beat: int = BEAT_TICKS


class Songs(NamedTuple):
    """summary (a row a song), melody (song_id, note_no, st_tick, en_tick, midi, velocity), expected notes, and labels."""

    summary: DataFrame
    melody: DataFrame
    expected: DataFrame
    labels: DataFrame


def numbered(score: DataFrame) -> DataFrame:
    """score with note_no, from 1, by start, pitch and end."""
    order = W.partitionBy("song_id").orderBy("st_tick", "midi", "en_tick", "velocity")
    return score.withColumn("note_no", F.row_number().over(order).cast("bigint"))


def melodies(score: DataFrame, songs: DataFrame, chord: int) -> DataFrame:
    """One note at a time: of songs in mode `topvoice` the highest note of each chord, at the chord's first onset; of the
    others all notes; each cut where the next one starts."""
    modes = songs.select("song_id", "mode")
    rows = score.join(modes, "song_id")
    top = scores.top_voice(rows.where("mode = 'topvoice'"), chord).select("song_id", "note_no", "anchor")
    voiced = rows.where("mode = 'topvoice'").join(top, ["song_id", "note_no"]).withColumn("st_tick", F.col("anchor")).drop("anchor")
    both = voiced.unionByName(rows.where("mode <> 'topvoice'")).drop("mode")
    return numbered(scores.enforce_mono(both).drop("note_no"))


def cropped(melody: DataFrame, bar_ticks: int) -> tuple[DataFrame, DataFrame]:
    """(melody from the first bar on that has a note, (song_id, seg_ticks) of the whole bars up to the last one)."""
    bounds = scores.bar_bounds(melody, bar_ticks)
    rows = melody.join(bounds, "song_id").withColumns({c: F.col(c) - F.col("t0") for c in ("st_tick", "en_tick")}).drop("t0", "t1")
    return rows, bounds.select("song_id", (F.col("t1") - F.col("t0")).alias("seg_ticks"))


def planted(melody: DataFrame, tempo: DataFrame, seed: int, beat: int = BEAT_TICKS) -> list[tuple[str, DataFrame, list[str], str]]:
    """Of each of the five planted defects its name, the melody with it, the columns that are its labels, and which notes
    have it."""
    moved = scores.perturb_timing(melody, tempo, seed, beat=beat).join(melody, ["song_id", "note_no"])
    moved = scores.first_tempo(moved, tempo).withColumn("shift_sec", scores.rounded_half_up(scores.seconds((F.col("new_start") - F.col("st_tick")) * F.col("__us"), beat), 4))
    return [
        ("pitch", scores.perturb_pitch(melody, seed), ["planted_cents"], "true"), ("timing", moved, ["shift_sec"], "new_start <> st_tick"), ("dynamics", scores.perturb_dynamics(melody, seed), ["factor"], "true"),
        ("wrong_notes", scores.perturb_wrong_notes(melody, tempo, seed, beat=beat), ["planted_semitones"], "planted_semitones <> 0"), ("dropouts", scores.perturb_dropouts(melody, seed).withColumn("gone", F.lit(1.0)), ["gone"], "dropped"),
    ]


def variants(melody: DataFrame, tempo: DataFrame, seed: int, beat: int = BEAT_TICKS) -> DataFrame:
    """(song_id, variant, note_no, onset_sec, midi, label, value): the labels of the five planted defects."""
    found = [scores.defect_labels(rows, tempo, name, labels, where, beat) for name, rows, labels, where in planted(melody, tempo, seed, beat)]
    return reduce(DataFrame.unionByName, found)


class Standards(NamedTuple):
    """score as it was heard, plan (a row a song that has a melody and a tempo), and the final melody of those it suits."""

    score: DataFrame
    plan: DataFrame
    melody: DataFrame


def standards(events: DataFrame, tempo: DataFrame, songs: DataFrame, settings: Settings = Settings()) -> Standards:
    """The melodies that all else is measured by; tables as in build."""
    s = settings
    score = bucketed(numbered(scores.notes_of_events(events)), "song_id", ("st_tick",))
    melody, sizes = cropped(melodies(score, songs, s.chord), s.bar_ticks)
    melody = bucketed(melody, "song_id", ("st_tick",))
    shifts = scores.transpose_shift(melody).select("song_id", "shift")
    lengths = scores.decide_repeats(scores.tick_to_sec(sizes, tempo, "seg_ticks", "sec", s.beat))
    lead = scores.sec_to_tick(lengths.select("song_id").withColumn("at", F.lit(LEAD_SEC)), tempo, "at", "lead", s.beat).drop("at")
    plan = cut(lengths.join(shifts, "song_id").join(lead, "song_id"))
    good = plan.where("repeats is not null").select("song_id", "seg_ticks", "repeats", "shift", "lead")
    rows = melody.join(good, "song_id").withColumn("copy", F.explode(F.sequence(F.lit(0).cast("bigint"), F.col("repeats") - 1)))
    at = F.col("copy") * F.col("seg_ticks") + F.col("lead")
    rows = rows.select("song_id", (F.col("st_tick") + at).alias("st_tick"), (F.col("en_tick") + at).alias("en_tick"), (F.col("midi") + F.col("shift")).alias("midi"), "velocity")
    return Standards(score, plan, numbered(rows))


def build(events: DataFrame, tempo: DataFrame, songs: DataFrame, settings: Settings = Settings()) -> Songs:
    """events has song_id, midi, tick, is_on, note_no and velocity; tempo song_id, tick and us_per_beat; songs song_id and
    mode (`topvoice` or `asis`). Errors are NO_NOTES, NO_TEMPO, and SONG_LENGTH where no number of repeats brings a song
    into the allowed length. The summary counts the notes with each defect; labels are derived when they are read."""
    s = settings
    score, plan, final = standards(events, tempo, songs, s)
    final = bucketed(final, "song_id", ("st_tick",))
    expected = scores.expected_notes(final, tempo, s.beat)
    labels = variants(final, tempo, s.seed, s.beat)
    counts = {v: rows.where(where).groupBy("song_id").agg(F.count("*").alias(v)) for v, rows, _, where in planted(final, tempo, s.seed, s.beat)}
    ends = scores.tick_to_sec(final.groupBy("song_id").agg(F.max("en_tick").alias("last"), F.count("*").alias("n_notes"), F.min("midi").alias("low"), F.max("midi").alias("high")), tempo, "last", "end_sec", s.beat)
    first = tempo.groupBy("song_id").agg(F.min_by("us_per_beat", "tick").alias("us"))
    found = songs.select("song_id", "mode").join(score.groupBy("song_id").agg(F.lit(True).alias("heard")), "song_id", "left").join(first, "song_id", "left")
    found = found.join(plan, "song_id", "left").join(ends, "song_id", "left")
    for v in VARIANTS:
        found = found.join(counts[v], "song_id", "left")
    error = F.when(F.col("heard").isNull(), "NO_NOTES").when(F.col("us").isNull(), "NO_TEMPO").when(F.col("repeats").isNull(), "SONG_LENGTH")
    n = lambda c: F.coalesce(c, F.lit(0)).alias(f"n_{c}")
    summary = found.select(
        "song_id", "mode", error.alias("error_code"), F.coalesce("n_notes", F.lit(0)).alias("n_notes"), note_name(F.col("low")).alias("lowest"), note_name(F.col("high")).alias("highest"), (F.lit(60e6) / F.col("us")).alias("bpm"),
        F.when(error.isNull(), F.col("shift")).alias("shift"), "repeats", F.col("sec").alias("seg_sec"), (F.col("end_sec") + TAIL_SEC).alias("duration_sec"),
        *map(n, VARIANTS),
    )
    return Songs(summary, final, expected, labels)
