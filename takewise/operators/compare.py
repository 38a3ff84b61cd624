"""The compare job: takes and their samples through gates, alignment, features, notes and metrics to documents, for all
pairs at once. What fails is a row: a pair that the gates or the alignment stop has a document with its error, a metric
that gives a pair nothing leaves its problem there.

Samples are chunks (take_id, chunk_no, pcm) of settings.chunk samples, so no row holds a take. Notes and frames are written
once, in buckets by pair, and every metric reads them from there.
"""

from __future__ import annotations

from typing import NamedTuple

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from ..config import ALIGN_BAND, ALIGN_HOP, ENERGY_SPAN_FRAMES, FMAX_HZ, FMIN_HZ, FRAME, MIN_NOTE_SEC, ONSET_FRAME, PITCH_HOP, RMS_HOP, SAMPLE_RATE, SERIES_POINTS
from ..functions.lineage import bucketed, cut
from . import align, frames, gates, metrics, pairing, results


class Settings(NamedTuple):
    """How samples are stored and cut; the rest follows the operators' own defaults."""

    chunk: int = 1 << 16
    rate: float = SAMPLE_RATE
    align_length: int = 2 * ALIGN_HOP
    align_hop: int = ALIGN_HOP
    align_hz: tuple[float, float] = (27.5, 4200.0)
    band: float = ALIGN_BAND
    pitch_length: int = FRAME
    pitch_hop: int = PITCH_HOP
    pitch_hz: tuple[float, float] = (FMIN_HZ, FMAX_HZ)
    rms_length: int = ONSET_FRAME
    rms_hop: int = RMS_HOP
    min_note_sec: float = MIN_NOTE_SEC
    onset_gap_sec: float = 0.05
    points: int = SERIES_POINTS


class Compared(NamedTuple):
    views: DataFrame
    scalars: DataFrame
    series: DataFrame
    path: DataFrame


#: Scalars of each metric, in order, with their units.
SCALARS = {
    "pitch": (("median_abs_cents", "cents"), ("off_pitch_ratio", "ratio"), ("n_notes_used", "count"), ("n_unpaired", "count"), ("sample_rate", "hz")),
    "timing": (("median_sec", "seconds"), ("spread_sec", "seconds"), ("early_ratio", "ratio"), ("late_ratio", "ratio"), ("on_time_ratio", "ratio"), ("n_notes_used", "count"), ("n_unpaired", "count")),
    "dynamics": (("median_db", "db"), ("spread_db", "db"), ("n_notes_used", "count"), ("n_unpaired", "count")),
}
#: Series of each metric, after its scalars, with their units and the port of their time axis.
SERIES = {
    "pitch": (("per_note_cents", "cents", "notes.reference"), ("per_note_f0_reference", "hz", "notes.reference"), ("per_note_f0_practice", "hz", "notes.reference")),
    "timing": (("per_note_onset_sec", "seconds", "notes.reference"),),
    "dynamics": (("envelope_db_reference", "db", "notes.reference"), ("envelope_db_practice", "db", "notes.practice")),
}


def _long(table: DataFrame, algorithm: str) -> DataFrame:
    rows = F.explode(F.array(*(F.struct(F.lit(k).alias("key"), F.col(k).cast("double").alias("value")) for k, _ in SCALARS[algorithm])))
    return table.select("pair_id", rows.alias("x")).select("pair_id", "x.*")


def registry(rate: float = SAMPLE_RATE, least_frames: float = MIN_NOTE_SEC * SAMPLE_RATE / PITCH_HOP) -> results.MetricRegistry:
    """The three metrics, over the tables that tables_of makes."""
    found = results.MetricRegistry()
    found.register("pitch", "1", ("deviation",), lambda t: _long(metrics.pitch_summary(t["deviation"], rate=int(rate)), "pitch"))
    found.register("timing", "1", ("onsets",), lambda t: _long(metrics.timing_summary(t["onsets"]), "timing"))
    found.register("dynamics", "1", ("energy",), lambda t: _long(metrics.dynamics_summary(_energy_pairs(t["energy"])), "dynamics"))
    return found


def _energy_pairs(energy: DataFrame) -> DataFrame:
    both = pairing.pair_by_ordinal(energy, ["median_db"])
    return both.select("pair_id", "note_no", F.col("ref_median_db").alias("ref_db"), F.col("prac_median_db").alias("prac_db"))


def features(samples: DataFrame, sides: DataFrame, s: Settings) -> dict[str, DataFrame]:
    """notes, pitch and rms of the takes of sides (take_id, pair_id, side), each written once in buckets by pair."""
    halo = lambda length: frames.with_halo(samples, s.chunk, length)
    named = lambda df, *order: bucketed(df.join(sides, "take_id"), "pair_id", order)
    low, _ = frames.lags(s.rate, s.pitch_length, *s.pitch_hz)
    diff = frames.yin_difference(frames.Cut(halo(s.pitch_length), s.pitch_length, s.pitch_hop), s.pitch_length, s.rate, *s.pitch_hz)
    pitch = named(frames.voicing(frames.yin_f0(diff, low, s.rate)), "take_id", "frame")
    rms = named(frames.frame_rms(frames.Cut(halo(s.rms_length), s.rms_length, s.rms_hop)), "take_id", "frame")
    notes = frames.note_segments(pitch, rms, s.pitch_hop, s.rms_hop, s.rate, s.min_note_sec)
    return {"pitch": pitch, "rms": rms, "notes": named(notes, "take_id", "note_no")}


def aligned(samples: DataFrame, sides: DataFrame, s: Settings) -> tuple[DataFrame, DataFrame]:
    """(path, checks) of each pair, from the chroma of both sides."""
    sizes = samples.groupBy("take_id").agg(F.sum(F.size("pcm")).alias("n"))
    chroma = frames.align_chroma(frames.with_halo(samples, s.chunk, s.align_length), s.rate, s.align_length, s.align_hop, *s.align_hz, sizes=sizes)
    chroma = chroma.join(sides, "take_id").select("pair_id", "side", "frame", F.col("bins").alias("features"))
    chroma = bucketed(chroma, "pair_id", ("side", "frame"))
    one = lambda name: chroma.where(F.col("side") == name).select("pair_id", "frame", "features")
    path = cut(align.warp_path(one("reference"), one("practice"), s.band))
    n = lambda name: F.count_if(F.col("side") == name)
    counts = chroma.groupBy("pair_id").agg(n("reference").alias("n_ref"), n("practice").alias("n_prac"))
    return path, align.path_checks(path, counts)


def tables_of(f: dict[str, DataFrame], samples: DataFrame, s: Settings) -> dict[str, DataFrame]:
    """What the metrics read: note deviations, matched onsets, and notes' energy. Onsets are the notes' own; those of a
    take without notes are found in its samples."""
    notes, takes = f["notes"], f["rms"].select("pair_id", "take_id", "side").distinct()
    last = f["pitch"].groupBy("pair_id", "take_id").agg((F.max("frame") + 1).alias("n_frames"))
    spans = pairing.note_spans(notes.join(last, ["pair_id", "take_id"]), "start_frame", F.col("n_frames"), "pair_id", "take_id")
    least = s.min_note_sec * s.rate / s.pitch_hop
    deviation = metrics.note_deviation(spans, f["pitch"].select("pair_id", "take_id", "frame", "voiced", "f0_hz"), least)
    deviation = deviation.join(notes.where("side = 'reference'").select("pair_id", "note_no", F.col("onset_sec").alias("t")), ["pair_id", "note_no"], "left")
    silent = takes.join(notes.select("take_id").distinct(), "take_id", "left_anti")
    found = frames.onsets(frames.with_halo(samples.join(silent.select("take_id"), "take_id", "left_semi"), s.chunk, s.rms_length), s.rate, s.rms_length, s.rms_hop, 1.0, s.onset_gap_sec)
    number = F.row_number().over(W.partitionBy("take_id").orderBy("frame")).cast("bigint")
    found = found.withColumn("note_no", number).join(takes, "take_id").select("pair_id", "side", "note_no", "onset_sec")
    onsets = pairing.pair_onsets(notes.select("pair_id", "side", "note_no", "onset_sec").unionByName(found))
    start = F.rint(F.col("onset_sec") * s.rate / s.rms_hop).cast("bigint")
    loud = notes.withColumn("start_frame", start)
    loud = pairing.note_spans(loud, "start_frame", F.col("start_frame") + ENERGY_SPAN_FRAMES, "pair_id", "take_id")
    inside = pairing.frames_in_spans(f["rms"].select("pair_id", "take_id", "side", "frame", "rms"), loud, ["pair_id", "take_id"])
    energy = metrics.note_energy(inside, ("pair_id", "side"))
    energy = energy.join(notes.select("pair_id", "take_id", "note_no", F.col("onset_sec").alias("t")), ["pair_id", "take_id", "note_no"])
    return {"deviation": cut(deviation), "onsets": cut(onsets), "energy": cut(energy)}


def _ranked(rows: DataFrame, algorithm: str, first: int, items: tuple) -> DataFrame:
    """rows (pair_id, key, ...) with what is known of their key: rank, ord, label, unit, source_port."""
    rank = list(SCALARS).index(algorithm)
    known = F.create_map(*(x for i, item in enumerate(items) for x in (F.lit(item[0]), F.struct(F.lit(first + i).alias("ord"), F.lit(item[1]).alias("unit"), F.lit(item[2] if len(item) > 2 else "").alias("source_port")))))
    told = F.element_at(known, F.col("key"))
    return rows.withColumns({"algorithm_id": F.lit(algorithm), "rank": F.lit(rank), "ord": told["ord"], "label": F.regexp_replace("key", "_", " "), "unit": told["unit"], "source_port": told["source_port"]})


def _series(tables: dict[str, DataFrame], points: int) -> DataFrame:
    """The metrics' series, a row a point, in the order of the notes."""

    def of(df: DataFrame, order: Column, values: dict[str, Column], algorithm: str) -> DataFrame:
        each = F.explode(F.array(*(F.struct(F.lit(k).alias("key"), v.alias("value")) for k, v in values.items()))).alias("x")
        rows = df.select("pair_id", order.alias("o"), "t", each).select("pair_id", "o", "t", "x.*").where("value is not null")
        rows = rows.withColumn("idx", F.row_number().over(W.partitionBy("pair_id", "key").orderBy("o")) - 1)
        return _ranked(rows.drop("o"), algorithm, len(SCALARS[algorithm]), SERIES[algorithm])

    d = tables["deviation"].where("cents is not null")
    pitch = of(d, F.col("note_no"), {"per_note_cents": F.col("cents"), "per_note_f0_reference": F.col("ref_hz"), "per_note_f0_practice": F.col("prac_hz")}, "pitch")
    matched = tables["onsets"].where("ref_no is not null and prac_no is not null")
    timing = of(matched.withColumn("t", F.col("ref_sec")), F.col("ref_sec"), {"per_note_onset_sec": F.col("prac_sec") - F.col("ref_sec")}, "timing")
    side = lambda s: F.when(F.col("side") == s, F.col("mean_db"))
    loud = of(tables["energy"], F.col("note_no"), {"envelope_db_reference": side("reference"), "envelope_db_practice": side("practice")}, "dynamics")
    return results.downsample(pitch.unionByName(timing).unionByName(loud), ["pair_id", "algorithm_id", "key"], points)


def compare(takes: DataFrame, samples: DataFrame, settings: Settings = Settings()) -> Compared:
    """takes has take_id, pair_id, side, readable, sample_rate and n_samples, and a uri if there is one; samples take_id,
    chunk_no and pcm. The results go to results.nested_document and results.report_lines."""
    s = settings
    verdict = cut(gates.ingest_verdict(takes, samples))
    usable = verdict.where("usable").select("pair_id")
    sides = takes.join(usable, "pair_id").select("take_id", "pair_id", "side")
    sound = samples.join(sides.select("take_id"), "take_id", "left_semi").select("take_id", "chunk_no", "pcm")
    path, checks = aligned(sound, sides, s)
    state = verdict.join(cut(checks.select("pair_id", F.col("error_code").alias("unaligned"))), "pair_id", "left")
    failed = F.coalesce("first_code", "unaligned", F.when(~F.col("usable"), "INPUT_UNREADABLE"))
    builds = state.select("pair_id", F.when(failed.isNull(), "DATA_READY").otherwise("FAILED").alias("state"), failed.alias("error_code"), F.lit(None).cast("string").alias("error_detail"))
    ready = builds.where("state = 'DATA_READY'").select("pair_id")
    tables = {n: t.join(ready, "pair_id", "left_semi") for n, t in tables_of(features(sound, sides, s), sound, s).items()}
    metric = registry(s.rate)
    values = cut(metric.run(tables))
    envelopes = metric.envelopes(ready, None, tables, values)
    scalars = None
    for name, items in SCALARS.items():
        rows = _ranked(values.where(F.col("algorithm_id") == name).select("pair_id", "key", "value"), name, 0, items).drop("source_port")
        scalars = rows if scalars is None else scalars.unionByName(rows)
    series = cut(_series(tables, s.points))
    basis = F.lit("REFERENCE").alias("timeline_basis")
    curves = series.select("pair_id", "algorithm_id", "rank", "ord", "key", "unit").distinct()
    items = scalars.select("pair_id", "algorithm_id", "rank", "ord", "key", F.lit("scalar").alias("kind"), "value", "unit", F.lit(None).cast("string").alias("timeline_basis"))
    items = items.unionByName(curves.select("pair_id", "algorithm_id", "rank", "ord", "key", F.lit("series").alias("kind"), F.lit(None).cast("double").alias("value"), "unit", basis))
    shown = cut(results.project(envelopes, items))
    views = results.run_view(builds, shown)
    uri = F.col("uri") if "uri" in takes.columns else F.concat(F.lit("take/"), F.col("take_id").cast("string"))
    of = lambda name: F.max(F.when(F.col("side") == name, uri)).alias(f"{name}_uri")
    views = views.join(takes.groupBy("pair_id").agg(of("reference"), of("practice")), "pair_id")
    good = shown.where("problem is null").select("pair_id", F.col("key").alias("full"))
    full = lambda df: df.withColumn("full", F.concat_ws(".", "algorithm_id", "key")).join(good, ["pair_id", "full"], "left_semi").drop("key").withColumnRenamed("full", "key")
    return Compared(views, full(scalars).withColumn("threshold", F.lit(None).cast("double")), full(series.withColumn("timeline_basis", F.lit("REFERENCE"))), path)
