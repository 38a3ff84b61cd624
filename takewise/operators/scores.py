"""Score tables: notes from events, tempo maps, melody extraction, repeats, planted defects and checks.

Ticks and midi numbers are BIGINT; a score has song_id, note_no, st_tick, en_tick, midi and velocity. Times are sums of
ticks times microseconds a beat, kept as whole numbers until they become seconds.
"""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from ..config import ALLOWED_MIDI, BEAT_TICKS, LEAD_SEC, MIN_NOTE_SEC, MOST_REPEATS, OFF_PITCH_CENTS, PREFERRED_MIDI, PREFERRED_SEC, QC_PASS, SONG_SEC, TAIL_SEC
from ..functions.scalars import hz_to_midi, midi_to_hz, note_name
from .pairing import frames_in_spans


#: Islands of onsets that are walked together.
ISLANDS = 1024


def notes_of_events(events: DataFrame) -> DataFrame:
    """(song_id, midi, st_tick, en_tick, velocity): note-ons and note-offs of a pitch meet first in, first out; an off
    without an open note is ignored, and so is an empty note. At a tick, offs come first."""
    key = ["song_id", "midi"]
    order = W.partitionBy(*key).orderBy("tick", "is_on", "note_no")
    balance = F.sum(F.when(F.col("is_on") == 1, 1).otherwise(-1)).over(order.rowsBetween(W.unboundedPreceding, 0))
    e = events.withColumn("balance", balance)
    stray = F.greatest(F.lit(0), -F.min("balance").over(order.rowsBetween(W.unboundedPreceding, 0)))
    e = e.withColumn("stray", stray).withColumn("newly", F.col("stray") > F.coalesce(F.lag("stray").over(order), F.lit(0)))
    e = e.withColumn("rank", F.sum(F.when(F.col("is_on") == 1, 0).otherwise(1)).over(order.rowsBetween(W.unboundedPreceding, 0)) - F.col("stray"))
    e = e.withColumn("on_rank", F.sum("is_on").over(order.rowsBetween(W.unboundedPreceding, 0)))
    on = e.where("is_on = 1").select(*key, F.col("on_rank").alias("rank"), F.col("tick").alias("st_tick"), "velocity")
    off = e.where("is_on = 0 and not newly").select(*key, "rank", F.col("tick").alias("en_tick"))
    return on.join(off, [*key, "rank"]).where("en_tick > st_tick").select(*key, "st_tick", "en_tick", "velocity")


def tempo_segments(tempo: DataFrame) -> DataFrame:
    """tempo with next_tick and passed: ticks times microseconds a beat up to the segment's start."""
    w = W.partitionBy("song_id").orderBy("tick")
    took = F.coalesce((F.col("tick") - F.lag("tick").over(w)) * F.lag("us_per_beat").over(w), F.lit(0).cast("bigint"))
    t = tempo.withColumn("next_tick", F.lead("tick").over(w)).withColumn("took", took)
    return t.withColumn("passed", F.sum("took").over(w.rowsBetween(W.unboundedPreceding, 0))).drop("took")


def _as_of(rows: DataFrame, tempo: DataFrame, order: str, at: Column) -> DataFrame:
    """(song_id, __row, __last) of rows: the last segment (t, p, u) of the song whose order column is at most a row's place,
    the first one for rows before it. A running last over both in order, so a song may have as many segments as rows.
    song_id stays outside of __row, so that what follows by song needs no exchange."""
    first = F.row_number().over(W.partitionBy("song_id").orderBy(order)) == 1
    segments = tempo_segments(tempo).select("song_id", F.when(~first, F.col(order).cast("double")).alias("__at"), F.struct(F.col("tick").alias("t"), F.col("passed").alias("p"), F.col("us_per_beat").alias("u")).alias("__seg"))
    placed = rows.select("song_id", F.coalesce(at.cast("double"), F.lit(float("-inf"))).alias("__at"), F.struct(*(c for c in rows.columns if c != "song_id")).alias("__row"))
    seen = W.partitionBy("song_id").orderBy(F.asc_nulls_first("__at"), F.col("__row").isNotNull()).rowsBetween(W.unboundedPreceding, 0)
    both = segments.unionByName(placed, allowMissingColumns=True).withColumn("__last", F.last("__seg", True).over(seen))
    return both.where("__row is not null and __last is not null").select("song_id", "__row", "__last")


def _again(found: DataFrame, rows: DataFrame, out: str) -> DataFrame:
    """rows, with out, of _as_of's result."""
    return found.select(*(F.col("song_id" if c == "song_id" else f"__row.{c}") for c in rows.columns), F.col("__out").alias(out))


def seconds(tick_us: Column, beat: int = BEAT_TICKS) -> Column:
    return tick_us / F.lit(1e6 * beat)


def tick_to_sec(rows: DataFrame, tempo: DataFrame, tick: str, out: str, beat: int = BEAT_TICKS) -> DataFrame:
    """rows with the seconds of a tick column, by the last tempo segment that starts at or before it; ticks before the
    first segment take its tempo."""
    passed = F.col("__last.p") + (F.col("__row").getField(tick) - F.col("__last.t")) * F.col("__last.u")
    return _again(_as_of(rows, tempo, "tick", F.col(tick)).withColumn("__out", seconds(passed, beat)), rows, out)


def sec_to_tick(rows: DataFrame, tempo: DataFrame, sec: str, out: str, beat: int = BEAT_TICKS) -> DataFrame:
    """rows with the smallest tick that reaches a time."""
    want = lambda column: column * F.lit(1e6 * beat)
    ticks = F.ceil(F.round((want(F.col("__row").getField(sec)) - F.col("__last.p")) / F.col("__last.u"), 6))
    return _again(_as_of(rows, tempo, "passed", want(F.col(sec))).withColumn("__out", F.col("__last.t") + ticks), rows, out)


def rounded_half_up(x: Column, digits: int) -> Column:
    """Rounded by way of one multiplication and floor, which other engines repeat to the bit."""
    scale = F.lit(float(10**digits))
    return F.floor(x * scale + F.lit(0.5)) / scale


def polyphony(score: DataFrame) -> DataFrame:
    """(song_id, max_voices, poly_ratio): a sweep over starts and ends; ends come first at a tick. The ratio is that of
    the time with more than one note to all time from the first start to the last end, rests included."""
    ends = F.explode(F.array(F.struct(F.col("st_tick").alias("tick"), F.lit(1).alias("step")), F.struct(F.col("en_tick").alias("tick"), F.lit(-1).alias("step"))))
    steps = score.where("en_tick > st_tick").select("song_id", ends.alias("e")).groupBy("song_id", F.col("e.tick").alias("tick")).agg(F.sum("e.step").alias("step"))
    w = W.partitionBy("song_id").orderBy("tick")
    run = steps.withColumn("voices", F.sum("step").over(w.rowsBetween(W.unboundedPreceding, 0))).withColumn("long", F.coalesce(F.lead("tick").over(w) - F.col("tick"), F.lit(0)))
    several = F.sum(F.when(F.col("voices") > 1, F.col("long")).otherwise(0))
    return run.groupBy("song_id").agg(F.max("voices").alias("max_voices"), (several / F.sum("long")).alias("poly_ratio"))


def track_profile(score: DataFrame) -> DataFrame:
    p = score.groupBy("song_id").agg(F.count("*").alias("n_notes"), F.min("midi").alias("min_midi"), F.max("midi").alias("max_midi"))
    return p.join(polyphony(score), "song_id", "left")


def transpose_shift(score: DataFrame, preferred: tuple[int, int] = PREFERRED_MIDI, allowed: tuple[int, int] = ALLOWED_MIDI) -> DataFrame:
    """(song_id, shift, low, high): the smallest shift that brings all notes into the preferred range, else into the
    allowed one, with that range; 0 and the allowed range for notes that fit into neither."""
    r = score.groupBy("song_id").agg(F.min("midi").alias("a"), F.max("midi").alias("b"))
    tried = []
    for low, high in (preferred, allowed):
        least, most = F.lit(low) - F.col("a"), F.lit(high) - F.col("b")
        shift = F.when(least > 0, least).when(most < 0, most).otherwise(0)
        tried.append(F.when(least <= most, F.struct(shift.cast("bigint").alias("shift"), F.lit(low).alias("low"), F.lit(high).alias("high"))))
    none = F.struct(F.lit(0).cast("bigint").alias("shift"), F.lit(allowed[0]).alias("low"), F.lit(allowed[1]).alias("high"))
    return r.select("song_id", F.coalesce(*tried, none).alias("x")).select("song_id", "x.shift", "x.low", "x.high")


def bar_bounds(score: DataFrame, bar_ticks: int) -> DataFrame:
    """(song_id, t0, t1): the whole bars that hold all of a song's notes."""
    t0 = F.floor(F.min("st_tick") / bar_ticks) * bar_ticks
    return score.groupBy("song_id").agg(t0.cast("bigint").alias("t0"), (F.ceil(F.max("en_tick") / bar_ticks) * bar_ticks).cast("bigint").alias("t1"))


def merge_tracks(tracks: DataFrame, shifts: DataFrame, bounds: DataFrame) -> DataFrame:
    """tracks (song_id, track, ...) of all tracks of a song together, shifted in pitch by shifts (song_id, shift), those
    notes that lie within bounds (song_id, t0, t1), from tick 0 on; a track without such notes gives none."""
    rows = tracks.join(shifts.select("song_id", "shift"), "song_id").join(bounds, "song_id").where("st_tick >= t0 and en_tick <= t1")
    return rows.withColumns({"midi": F.col("midi") + F.col("shift"), "st_tick": F.col("st_tick") - F.col("t0"), "en_tick": F.col("en_tick") - F.col("t0")}).drop("shift", "t0", "t1")


def bar_crop(score: DataFrame, first_bar: int, bars: int, bar_ticks: int) -> DataFrame:
    """Notes that start in the bars, from tick 0 on, cut at the last bar's end."""
    a, b = first_bar * bar_ticks, (first_bar + bars) * bar_ticks
    rows = score.where((F.col("st_tick") >= a) & (F.col("st_tick") < b))
    return rows.withColumn("st_tick", F.col("st_tick") - a).withColumn("en_tick", F.least("en_tick", F.lit(b)) - a)


def decide_repeats(lengths: DataFrame, allowed: tuple[float, float] = SONG_SEC, best: tuple[float, float] = PREFERRED_SEC, most: int = MOST_REPEATS, around: float = LEAD_SEC + TAIL_SEC) -> DataFrame:
    """lengths (song_id, sec) with repeats: with lead and tail, the fewest that come into the best range, else the ones
    within the allowed range nearest to an end of the best one, else null."""
    total = lambda k: k * F.col("sec") + F.lit(around)
    away = lambda t: F.when(t.between(*best), 0.0).otherwise(F.least(F.abs(t - best[0]), F.abs(t - best[1])))
    fits = F.filter(F.sequence(F.lit(1), F.lit(most)), lambda k: total(k).between(*allowed))
    ranked = F.array_sort(F.transform(fits, lambda k: F.struct(F.round(away(total(k)), 6).alias("a"), k.alias("k"))))
    return lengths.withColumn("repeats", F.get(ranked, F.lit(0))["k"].cast("bigint"))


def repeat_notes(score: DataFrame, times: int, segment_ticks: int) -> DataFrame:
    rows = score.withColumn("copy", F.explode(F.sequence(F.lit(0).cast("bigint"), F.lit(times - 1).cast("bigint"))))
    shift = F.col("copy") * segment_ticks
    return rows.withColumn("st_tick", F.col("st_tick") + shift).withColumn("en_tick", F.col("en_tick") + shift)


def top_voice(score: DataFrame, tolerance: int) -> DataFrame:
    """The highest note of each cluster of onsets (the first of equals); a cluster has the onsets within the tolerance of
    its first. Onsets that follow the one before at more than the tolerance begin one in any case, so only what stands
    between two of these is walked together."""
    order = W.partitionBy("song_id").orderBy("st_tick", "midi", "en_tick", "note_no")
    begins = F.coalesce(F.col("st_tick") - F.lag("st_tick").over(order) > tolerance, F.lit(True)).cast("bigint")
    parted = score.withColumn("__begins", begins).withColumn("__island", F.sum("__begins").over(order.rowsBetween(W.unboundedPreceding, 0)))
    rows = parted.select("song_id", F.floor(F.col("__island") / ISLANDS).alias("__some"), "st_tick", "midi", "en_tick", "note_no")
    kinds = {c: rows.schema[c].dataType.simpleString() for c in ("song_id", "note_no")}

    def run(group: pa.Table) -> pa.Table:
        group = group.sort_by([(c, "ascending") for c in ("st_tick", "midi", "en_tick", "note_no")])
        starts, pitches = group.column("st_tick").to_pylist(), group.column("midi").to_pylist()
        anchors: list[int] = []
        best: list[int] = []
        for k, (at, midi) in enumerate(zip(starts, pitches)):
            if not anchors or at - anchors[-1] > tolerance:
                anchors.append(at)
                best.append(k)
            elif midi > pitches[best[-1]]:
                best[-1] = k
        chosen = group.take(pa.array(best, pa.int64()))
        return pa.table([chosen.column("song_id"), pa.array(anchors, pa.int64()), chosen.column("midi").cast(pa.int64()), chosen.column("note_no")], ["song_id", "anchor", "midi", "note_no"])

    return rows.groupBy("song_id", "__some").applyInArrow(run, f"song_id {kinds['song_id']}, anchor long, midi long, note_no {kinds['note_no']}")


def enforce_mono(score: DataFrame) -> DataFrame:
    """Notes by start, the highest first; each ends where the next starts, and empty ones go."""
    nxt = F.lead("st_tick").over(W.partitionBy("song_id").orderBy("st_tick", F.desc("midi"), "note_no"))
    return score.withColumn("en_tick", F.least("en_tick", nxt)).where("en_tick > st_tick")


def uniform(seed: int, tag: str, *keys: str) -> Column:
    """A number in [0, 1) that depends on the seed, the tag and the row's keys alone, however rows are partitioned: the
    first 52 bits of an MD5."""
    name = F.concat_ws(":", F.lit(str(seed)), F.lit(tag), *(F.col(k).cast("string") for k in keys))
    return F.conv(F.substring(F.md5(name.cast("binary")), 1, 13), 16, 10).cast("bigint") / F.lit(float(1 << 52))


def _drawn(seed: int, tag: str) -> Column:
    return uniform(seed, tag, "song_id", "note_no")


def _between(u: Column, low: float, high: float) -> Column:
    return F.lit(low) + u * F.lit(high - low)


def perturb_pitch(score: DataFrame, seed: int, share: float = 0.85, sharp: float = 0.68, far: tuple[float, float] = (45.0, 115.0), near: float = 25.0) -> DataFrame:
    """score with planted_cents: most notes far off, more of them sharp than flat, the others a little."""
    size = _between(_drawn(seed, "size"), *far) * F.when(_drawn(seed, "sign") < sharp, 1).otherwise(-1)
    return score.withColumn("planted_cents", rounded_half_up(F.when(_drawn(seed, "far") < share, size).otherwise(_between(_drawn(seed, "near"), -near, near)), 1))


def perturb_dynamics(score: DataFrame, seed: int, usual: tuple[float, float] = (0.30, 1.35), faint: tuple[float, float] = (0.12, 0.25), share: float = 0.10) -> DataFrame:
    """score with velocity times a factor, within 3 to 127: uneven throughout, and a share of the notes nearly silent."""
    factor = F.when(_drawn(seed, "faint") < share, _between(_drawn(seed, "faint size"), *faint)).otherwise(_between(_drawn(seed, "size"), *usual))
    rows = score.withColumn("__f", factor).withColumn("factor", rounded_half_up(F.col("__f"), 3))
    return rows.withColumn("velocity", F.least(F.greatest(F.rint(F.col("velocity") * F.col("__f")), F.lit(3.0)), F.lit(127.0)).cast("bigint")).drop("__f")


def first_tempo(rows: DataFrame, tempo: DataFrame) -> DataFrame:
    """rows with __us, the microseconds a beat at the song's start."""
    return rows.join(tempo.groupBy("song_id").agg(F.min_by("us_per_beat", "tick").alias("__us")), "song_id")


def perturb_wrong_notes(score: DataFrame, tempo: DataFrame, seed: int, share: float = 0.15, least_sec: float = MIN_NOTE_SEC, beat: int = BEAT_TICKS) -> DataFrame:
    """score with planted_semitones: of each song's notes of least_sec, by the tempo at its start, the share with the
    smallest hash, one at least, moves by one to three semitones either way, within 21 to 108."""
    fit = seconds((F.col("en_tick") - F.col("st_tick")) * F.col("__us"), beat) >= least_sec
    rows = first_tempo(score, tempo).withColumn("__fit", fit).withColumn("__u", _drawn(seed, "wrong"))
    rank = F.row_number().over(W.partitionBy("song_id", "__fit").orderBy("__u", "note_no"))
    size = F.count("*").over(W.partitionBy("song_id", "__fit"))
    step = F.floor(_drawn(seed, "step") * 6) - 3
    step = F.when(step >= 0, step + 1).otherwise(step)
    rows = rows.withColumn("planted_semitones", F.when(F.col("__fit") & (rank <= F.greatest(F.lit(1.0), F.rint(size * share))), step).otherwise(0))
    moved = F.least(F.greatest(F.col("midi") + F.col("planted_semitones"), F.lit(21)), F.lit(108))
    return rows.withColumn("midi", F.when(F.col("planted_semitones") != 0, moved).otherwise(F.col("midi")).cast("bigint")).drop("__fit", "__u", "__us")


def perturb_dropouts(score: DataFrame, seed: int, share: float = 0.12) -> DataFrame:
    """score with dropped: from about share of the notes on, a run of one note (twice as likely), two or three; a run
    that would start within another does not. note_no counts each song's notes from 1 or 0 without gaps."""
    run = F.greatest(F.lit(1), F.floor(_drawn(seed, "long") * 4)).cast("bigint")
    rows = score.withColumn("__run", F.when(_drawn(seed, "drop") < share, run).otherwise(0))
    runs = rows.where("__run > 0").groupBy("song_id").agg(F.array_sort(F.collect_list(F.struct("note_no", "__run"))).alias("r"))
    none = F.array().cast("array<struct<note_no:bigint,__run:bigint>>")
    free = lambda acc, x: (F.size(acc) == 0) | (x["note_no"] >= F.element_at(acc, -1)["note_no"] + F.element_at(acc, -1)["__run"])
    kept = F.aggregate("r", none, lambda acc, x: F.when(free(acc, x), F.array_append(acc, x)).otherwise(acc))
    gone = runs.select("song_id", F.explode(kept).alias("k")).select("song_id", F.explode(F.sequence(F.col("k.note_no"), F.col("k.note_no") + F.col("k.__run") - 1)).alias("note_no"), F.lit(True).alias("dropped"))
    return rows.drop("__run").join(gone, ["song_id", "note_no"], "left").withColumn("dropped", F.coalesce("dropped", F.lit(False)))


def perturb_timing(mono: DataFrame, tempo: DataFrame, seed: int, drift: float = 0.055, most_sec: float = 0.090, most_share: float = 0.30, least_sec: float = 0.020, beat: int = BEAT_TICKS) -> DataFrame:
    """mono with new_start and new_end (ticks). Notes follow one another, so what moves is the boundary between two: by
    up to most_sec, and most_share of the shorter note, either way, and earlier the nearer the song's end, by drift
    seconds there; ticks are those of the tempo at the song's start. Both notes of a boundary keep a quarter of their
    length, and least_sec, else it stays; the song keeps its notes, their order, and its first and last tick. Each
    boundary heeds the one before it, so a song's are walked in order, a song a group."""
    w = W.partitionBy("song_id").orderBy("st_tick", "note_no")
    size = F.col("en_tick") - F.col("st_tick")
    rows = first_tempo(mono, tempo).withColumn("__long", size)
    first, last = F.min("st_tick").over(W.partitionBy("song_id")), F.max("en_tick").over(W.partitionBy("song_id"))
    shorter = F.least(F.lag("__long").over(w), F.col("__long"))
    cap = F.least(F.lit(most_sec), F.lit(most_share) * seconds(shorter * F.col("__us"), beat))
    wish = (_drawn(seed, "timing") * 2 - 1) * cap - F.lit(drift) * (F.col("st_tick") - first) / F.greatest(F.lit(1), last - first)
    ticks = F.ceil(F.round(F.abs(wish) * F.lit(1e6 * beat) / F.col("__us"), 6)) * F.signum(wish)
    floor = F.rint(F.lit(least_sec) * F.lit(1e6 * beat) / F.col("__us"))
    least = F.greatest(F.floor(F.lit(0.25) * F.col("__long")), floor)
    rows = rows.select("song_id", "note_no", "st_tick", "en_tick", ticks.cast("bigint").alias("push"), least.cast("bigint").alias("least"))
    return rows.groupBy("song_id").applyInArrow(_boundaries, f"song_id {rows.schema['song_id'].dataType.simpleString()}, note_no long, new_start long, new_end long")


def _boundaries(song: pa.Table) -> pa.Table:
    """A song's notes with their boundaries moved one after the other."""
    song = song.sort_by([("st_tick", "ascending"), ("note_no", "ascending")])
    start, end, push, least = (song.column(c).to_pylist() for c in ("st_tick", "en_tick", "push", "least"))
    new = start[:1]
    for i in range(1, len(start)):
        low, high = new[-1] + least[i - 1], end[i] - least[i]
        new.append(start[i] if high < low else min(max(start[i] + push[i], low), high))
    return pa.table([song.column("song_id"), song.column("note_no"), pa.array(new, pa.int64()), pa.array([*new[1:], end[-1]], pa.int64())], ["song_id", "note_no", "new_start", "new_end"])


def defect_labels(perturbed: DataFrame, tempo: DataFrame, variant: str, labels: list[str], where: str = "true", beat: int = BEAT_TICKS) -> DataFrame:
    """(song_id, variant, note_no, onset_sec, midi, label, value): a row for each label column of each perturbed note that
    the condition keeps; onset_sec is that of the standard."""
    rows = tick_to_sec(perturbed.where(where), tempo, "st_tick", "__sec", beat)
    each = F.explode(F.array(*(F.struct(F.lit(c).alias("label"), F.col(c).cast("double").alias("value")) for c in labels)))
    rows = rows.select("song_id", F.lit(variant).alias("variant"), "note_no", rounded_half_up(F.col("__sec"), 4).alias("onset_sec"), "midi", each.alias("x"))
    return rows.select("song_id", "variant", "note_no", "onset_sec", "midi", "x.label", "x.value")


def expected_notes(score: DataFrame, tempo: DataFrame, beat: int = BEAT_TICKS) -> DataFrame:
    """(song_id, ordinal, onset_sec, end_sec, duration_sec, midi, name, hz, velocity): notes by start, counted from 0."""
    rows = tick_to_sec(tick_to_sec(score, tempo, "st_tick", "__on", beat), tempo, "en_tick", "__off", beat)
    ordinal = F.row_number().over(W.partitionBy("song_id").orderBy("st_tick", "note_no")) - 1
    return rows.select(
        "song_id", ordinal.cast("bigint").alias("ordinal"), rounded_half_up(F.col("__on"), 4).alias("onset_sec"), rounded_half_up(F.col("__off"), 4).alias("end_sec"),
        rounded_half_up(F.col("__off") - F.col("__on"), 4).alias("duration_sec"), "midi", note_name(F.col("midi")).alias("name"), F.round(midi_to_hz(F.col("midi")), 6).alias("hz"), "velocity",
    )


def note_pitch(notes: DataFrame, frames: DataFrame, frame_sec: float, part: tuple[float, float]) -> DataFrame:
    """notes (take_id, note_no, onset_sec, duration_sec, midi) with estimate: the midi number of the median pitch of the
    voiced frames (take_id, frame, voiced, f0_hz) in that part of the note, ends included; null without such a frame."""
    at = lambda share: F.round((F.col("onset_sec") + F.col("duration_sec") * share) / frame_sec, 6)
    spans = notes.select("take_id", "note_no", F.ceil(at(part[0])).alias("start_frame"), (F.floor(at(part[1])) + 1).alias("span_end"))
    inside = frames_in_spans(frames.select("take_id", "frame", "voiced", "f0_hz"), spans).where("voiced = 1 and f0_hz > 0")
    found = inside.groupBy("take_id", "note_no").agg(hz_to_midi(F.median("f0_hz")).alias("estimate"))
    return notes.join(found, ["take_id", "note_no"], "left")


def pitch_qc(notes: DataFrame, frames: DataFrame, frame_sec: float, least_sec: float = MIN_NOTE_SEC, within: float = OFF_PITCH_CENTS, least_share: float = QC_PASS) -> DataFrame:
    """(take_id, n_stable, n_detected, n_within, pass_rate, median_abs_cents, n_octave, passed) over the notes of
    least_sec, measured in their 20 to 80 % part; bounds in cents are strict."""
    stable = note_pitch(notes.where(F.col("duration_sec") >= least_sec), frames, frame_sec, (0.2, 0.8))
    off = F.abs((F.col("estimate") - F.col("midi")) * 100)
    rows = stable.withColumn("off", off)
    rate = F.count_if(F.col("off") < within) / F.count("*")
    return rows.groupBy("take_id").agg(
        F.count("*").alias("n_stable"), F.count("off").alias("n_detected"), F.count_if(F.col("off") < within).alias("n_within"), rate.alias("pass_rate"), F.median("off").alias("median_abs_cents"),
        F.count_if(F.abs(F.col("off") - 1200) < within).alias("n_octave"), (rate >= least_share).alias("passed"),
    )


def label_recovery(labels: DataFrame, notes: DataFrame, frames: DataFrame, frame_sec: float, least_sec: float = MIN_NOTE_SEC) -> DataFrame:
    """(take_id, n, median_abs_error, max_abs_error): cents measured in the 30 to 80 % part of notes of least_sec, less
    those planted (labels: take_id, note_no, planted_cents); notes without a voiced frame are left out."""
    measured = note_pitch(notes.where(F.col("duration_sec") >= least_sec), frames, frame_sec, (0.3, 0.8)).where("estimate is not null")
    gap = F.abs((F.col("estimate") - F.col("midi")) * 100 - F.col("planted_cents"))
    both = labels.join(measured, ["take_id", "note_no"]).withColumn("gap", gap)
    return both.groupBy("take_id").agg(F.count("*").alias("n"), F.median("gap").alias("median_abs_error"), F.max("gap").alias("max_abs_error"))


def wrong_note_hits(labels: DataFrame, notes: DataFrame, frames: DataFrame, frame_sec: float, within: float = OFF_PITCH_CENTS) -> DataFrame:
    """(take_id, n_labels, n_hits): planted wrong notes (labels: take_id, note_no, played_midi) whose measured pitch is
    the played one's."""
    both = labels.join(note_pitch(notes, frames, frame_sec, (0.3, 0.8)), ["take_id", "note_no"], "left")
    return both.groupBy("take_id").agg(F.count("*").alias("n_labels"), F.count_if(F.abs((F.col("estimate") - F.col("played_midi")) * 100) < within).alias("n_hits"))


def nearest_row(queries: DataFrame, table: DataFrame, by: str, value: str, name: str) -> DataFrame:
    """queries with nearest: the name of the row of table (by, value, name) with the same by whose value, to six digits, is
    nearest, the first name of equals. A two-sided as-of join: over both in order of their values, the last row of the
    table up to a query's place and, in falling order, the first from there on."""
    rows = table.where(F.col(value).isNotNull()).groupBy(F.col(by).alias("__by"), F.round(value, 6).alias("__v")).agg(F.min(name).alias("__n"))
    rows = rows.select("__by", "__v", F.struct("__v", "__n").alias("__t"))
    asked = queries.select(F.col(by).alias("__by"), F.col(value).alias("__v"), F.struct("*").alias("__q"))
    both = rows.unionByName(asked, allowMissingColumns=True)
    group = W.partitionBy("__by")
    seen = lambda order: F.last("__t", True).over(group.orderBy(order, F.col("__q").isNotNull()).rowsBetween(W.unboundedPreceding, 0))
    both = both.withColumn("__before", seen(F.asc("__v"))).withColumn("__after", seen(F.desc("__v"))).where("__q is not null")
    far = lambda t: F.when(F.col(t).isNotNull(), F.struct(F.round(F.abs(F.col(t)["__v"] - F.col("__v")), 6).alias("a"), F.col(t)["__n"].alias("n")))
    near = F.array_min(F.filter(F.array(far("__before"), far("__after")), lambda x: x.isNotNull()))
    return both.select("__q.*", near["n"].alias("nearest"))
