"""Framing, spectra, pitch candidates and note segments.

Samples are rows (take_id, pcm ARRAY<DOUBLE>) or, for long takes, chunks (take_id, chunk_no, pcm). What needs a
spectrum or an autocorrelation is cut and computed in one pass over Arrow batches, many frames at once, and its result
stays an array in the frame's row, so that no frame becomes a row by itself and no bin or lag is shuffled; the rest is
built-in expressions and windows.
"""

from __future__ import annotations

import math
from bisect import bisect_left, insort
from collections.abc import Callable, Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window as W

from ..config import ALIGN_HOP, FMAX_HZ, FMIN_HZ, FRAME, MIN_NOTE_SEC, ONSET_FLOOR, ONSET_FRAME, PITCH_HOP, RMS_HOP, SAMPLE_RATE, VOICED_FLOOR
from .pairing import frames_in_spans


#: Bytes of frames in an Arrow batch, about.
BATCH = 4 << 20


class Cut(NamedTuple):
    """How takes are cut into frames: 1 + (n - length) div hop of each take with border zeros on both ends, most of them at
    most; a short take gives one frame filled up with zeros. samples has take_id and pcm, or for takes stored in chunks
    `at`, the place of a chunk's first sample, and `own`, how many of its samples are its own: those after them are the
    next samples of the take, length - 1 or what there is."""

    samples: DataFrame
    length: int
    hop: int
    most: Column | None = None
    border: int = 0


def cut_centered(samples: DataFrame, length: int, hop: int, most: Column | None = None) -> Cut:
    """Takes with length / 2 zeros on both ends."""
    return Cut(samples, length, hop, most, length // 2)


def with_halo(chunks: DataFrame, chunk: int, length: int) -> DataFrame:
    """(take_id, at, own, pcm) for Cut of takes stored as chunks of chunk samples (the last may be shorter): the first
    length - 1 samples that follow a chunk come to it by (take, chunk), so no row or task holds a whole take."""
    rows = chunks.where(F.size("pcm") > 0).select("take_id", F.col("chunk_no").cast("bigint").alias("chunk_no"), "pcm")
    reach = max(1, -(-(length - 1) // chunk))  # chunks that the halo spans
    head = F.slice("pcm", 1, max(1, min(chunk, length - 1)))
    sent = rows.select("take_id", F.explode(F.sequence(F.lit(1), F.lit(reach))).alias("k"), "chunk_no", head.alias("head")).select("take_id", (F.col("chunk_no") - F.col("k")).alias("chunk_no"), F.struct("k", "head").alias("part"))
    if reach == 1:
        sent = sent.select("take_id", "chunk_no", F.col("part.head").alias("halo"))
    else:
        sent = sent.where("chunk_no >= 0").groupBy("take_id", "chunk_no").agg(F.flatten(F.transform(F.array_sort(F.collect_list("part")), lambda p: p["head"])).alias("halo"))
    halo = F.slice(F.coalesce("halo", F.array().cast(rows.schema["pcm"].dataType)), F.lit(1), F.lit(max(0, length - 1)))
    return rows.join(sent, ["take_id", "chunk_no"], "left").select("take_id", (F.col("chunk_no") * chunk).alias("at"), F.size("pcm").cast("bigint").alias("own"), F.concat("pcm", halo).alias("pcm"))


def _windows(pcm: np.ndarray, at: int, own: int | None, length: int, hop: int, border: int) -> tuple[int, np.ndarray]:
    """(number of the first frame, frames) that begin in a row's own samples; a row that has no more than them, or fewer
    than length - 1 after them, ends its take."""
    ends = own is None or len(pcm) - own < length - 1
    size = len(pcm) if own is None else own
    first = 0 if at == 0 else -(-(at + border) // hop)
    left = border if at == 0 else 0
    x = np.pad(pcm, (left, border if ends else 0)) if left or (ends and border) else pcm
    if at == 0 and len(x) < length:
        x = np.pad(x, (0, length - len(x)))
    begin = first * hop - border - at + left  # of the first frame, in x
    last = left + size - 1 if at else max(left + size - 1, 0)  # the last place where a frame may begin
    if begin + length > len(x) or begin > last:
        return first, np.zeros((0, length))
    return first, np.lib.stride_tricks.sliding_window_view(x, length)[begin : last + 1 : hop]


def measured(cut: Cut, measures: dict[str, Callable[[np.ndarray], np.ndarray]]) -> DataFrame:
    """(take_id, frame, an array for each measure), cut and measured in one pass over Arrow batches: no frame becomes a
    row or crosses to the JVM unless a measure returns it. A measure maps a matrix of frames to a matrix of results."""
    chunked = "own" in cut.samples.columns
    pcm = F.col("pcm") if cut.samples.schema["pcm"].dataType in (T.ArrayType(T.DoubleType()), T.ArrayType(T.FloatType())) else F.col("pcm").cast("array<double>")
    most = F.lit(2**31 - 1) if cut.most is None else cut.most
    place = ("at", "own") if chunked else (F.lit(0).cast("bigint").alias("at"), F.lit(None).cast("bigint").alias("own"))
    rows = cut.samples.select("take_id", *place, most.cast("bigint").alias("most"), pcm.alias("pcm"))
    kind = rows.schema["take_id"].dataType.simpleString()
    _, length, hop, _, border = cut

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        step = max(1, BATCH // (8 * length))
        for batch in batches:
            for i in range(batch.num_rows):
                values = batch.column("pcm")[i].values
                x = np.zeros(0) if values is None else values.to_numpy(zero_copy_only=False).astype(np.float64, copy=False)
                first, windows = _windows(x, batch.column("at")[i].as_py(), batch.column("own")[i].as_py(), length, hop, border)
                windows = windows[: max(0, batch.column("most")[i].as_py() - first)]
                for at in range(0, len(windows), step):
                    part = np.ascontiguousarray(windows[at : at + step])
                    out = [_lists(measure(part)) for measure in measures.values()]
                    takes = batch.column("take_id").take(pa.array(np.full(len(part), i)))
                    yield pa.RecordBatch.from_arrays([takes, pa.array(np.arange(first + at, first + at + len(part))), *out], ["take_id", "frame", *measures])

    return rows.mapInArrow(run, ", ".join([f"take_id {kind}", "frame long", *(f"{n} array<double>" for n in measures)]))


def _lists(matrix: np.ndarray) -> pa.Array:
    """A list a row."""
    n, k = matrix.shape
    ends = np.arange(0, n * k + 1, k, dtype=np.int32) if k else np.zeros(n + 1, dtype=np.int32)
    return pa.ListArray.from_arrays(pa.array(ends), pa.array(np.ascontiguousarray(matrix, dtype=np.float64).ravel()))


def frames(samples: DataFrame, length: int, hop: int, most: Column | None = None, border: int = 0) -> DataFrame:
    """(take_id, frame, x): the frames of Cut as rows."""
    return measured(Cut(samples, length, hop, most, border), {"x": lambda x: x})


def centered_frames(samples: DataFrame, length: int, hop: int, most: Column | None = None) -> DataFrame:
    """frames() of takes with length / 2 zeros on both ends."""
    return frames(samples, length, hop, most, length // 2)


def frames_of_chunks(chunks: DataFrame, chunk: int, length: int, hop: int, border: int = 0) -> DataFrame:
    """frames() of takes stored as chunks of chunk samples."""
    return frames(with_halo(chunks, chunk, length), length, hop, border=border)


def per_frame(framed: DataFrame | Cut, measure: Callable[[np.ndarray], np.ndarray], name: str) -> DataFrame:
    """(take_id, frame, name): measure maps a matrix of frames to a matrix of results, one row each; frames have the
    same length throughout. Of a Cut they are measured as they are cut."""
    if isinstance(framed, Cut):
        return measured(framed, {name: measure})
    kind = framed.schema["take_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                x = batch.column("x").flatten().to_numpy().reshape(batch.num_rows, -1)
                yield pa.RecordBatch.from_arrays([batch.column("take_id"), batch.column("frame"), _lists(measure(x))], ["take_id", "frame", name])

    return framed.select("take_id", "frame", F.col("x").cast("array<double>").alias("x")).mapInArrow(run, f"take_id {kind}, frame long, {name} array<double>")


def frame_rms(framed: DataFrame | Cut) -> DataFrame:
    """(take_id, frame, rms), at most 1."""
    level = lambda x: np.minimum(np.sqrt((x * x).mean(axis=1, keepdims=True)), 1.0)
    return per_frame(framed, level, "rms").withColumn("rms", F.get("rms", F.lit(0)))


def _hann(length: int, periodic: bool = True) -> np.ndarray:
    return 0.5 - 0.5 * np.cos(2 * np.pi * np.arange(length) / max(1, length if periodic else length - 1))


def magnitudes(x: np.ndarray, periodic: bool = True) -> np.ndarray:
    """Hann-windowed magnitudes of each row, bins 0 to length / 2."""
    found = np.fft.rfft(x * _hann(x.shape[1], periodic), axis=1)
    return np.sqrt(found.real**2 + found.imag**2)


def spectra(framed: DataFrame | Cut) -> DataFrame:
    """(take_id, frame, mag ARRAY<DOUBLE>)"""
    return per_frame(framed, magnitudes, "mag")


def spectrum(framed: DataFrame | Cut) -> DataFrame:
    """(take_id, frame, k, mag), a row for each bin."""
    return spectra(framed).select("take_id", "frame", F.posexplode("mag").alias("k", "mag")).withColumn("k", F.col("k").cast("bigint"))


def align_chroma(samples: DataFrame, rate: float = SAMPLE_RATE, length: int = 2 * ALIGN_HOP, hop: int = ALIGN_HOP, fmin: float = 27.5, fmax: float = 4200.0, base: float = 27.5, sizes: DataFrame | None = None) -> DataFrame:
    """(take_id, frame, bins): magnitudes of centered frames that start within the take, (n - 1) div hop of them, folded
    into twelve classes (bin 0 is A), each frame's length 1, silent ones all 0. Of with_halo's chunks sizes (take_id, n)
    must tell how long the takes are."""

    def fold(x: np.ndarray) -> np.ndarray:
        hz = np.arange(length // 2 + 1) * (rate / length)
        inside = np.flatnonzero((hz >= fmin) & (hz <= fmax) & (hz > 0))
        classes = np.mod(np.round(12 * np.log2(hz[inside] / base)).astype(np.int64), 12)
        folded = magnitudes(x)[:, inside] @ np.eye(12)[classes]
        norm = np.sqrt((folded * folded).sum(axis=1, keepdims=True))
        return folded / np.where(norm > 0, norm, 1.0)

    if sizes is not None:
        found = per_frame(cut_centered(samples, length, hop), fold, "bins")
        return found.join(sizes.select("take_id", "n"), "take_id").where(F.col("frame") < F.floor((F.col("n") - 1) / hop)).drop("n")
    most = F.floor((F.size("pcm") - 1) / hop)
    return per_frame(cut_centered(samples, length, hop, most), fold, "bins")


def chroma_filters(rate: float, length: int) -> np.ndarray:
    """Twelve filters (rows, the first is C) over bins 0 to length / 2: Gaussian bumps a bin wide or a semitone, whichever
    is more, each bin's weights of length 1, then weighted by how far the bin is from the fifth octave."""
    place = 12 * np.log2(np.arange(1, length) * rate / length / 27.5)  # semitones above the lowest A
    place = np.concatenate(([place[0] - 18], place))  # the bin at 0 Hz: an octave and a half below the next
    spread = np.append(np.maximum(np.diff(place), 1.0), 1.0)
    away = np.mod(place - np.arange(12)[:, None] + 6, 12) - 6
    bump = np.exp(-2.0 * (away / spread) ** 2)
    bump = bump / np.sqrt((bump * bump).sum(axis=0)) * np.exp(-0.5 * ((place / 12 - 5) / 2) ** 2)
    return bump[(np.arange(12) + 3) % 12, : length // 2 + 1]


def chroma(samples: DataFrame, rate: float = SAMPLE_RATE, length: int = FRAME, hop: int = ALIGN_HOP) -> DataFrame:
    """(take_id, frame, bins): power of centered frames through chroma_filters, each frame's maximum 1, silent ones 0."""

    def filtered(x: np.ndarray) -> np.ndarray:
        power = magnitudes(x) ** 2 @ chroma_filters(rate, length).T
        top = power.max(axis=1, keepdims=True)
        return np.clip(power / np.where(top > 0, top, 1.0), 0.0, 1.0)

    return per_frame(cut_centered(samples, length, hop), filtered, "bins")


def lags(rate: float, length: int, fmin: float, fmax: float) -> tuple[int, int]:
    """Least and largest lag of a frame's pitch."""
    return int(math.floor(rate / fmax)), min(int(math.ceil(rate / fmin)), length - 1)


def yin_difference(framed: DataFrame | Cut, length: int = FRAME, rate: float = SAMPLE_RATE, fmin: float = FMIN_HZ, fmax: float = FMAX_HZ) -> DataFrame:
    """(take_id, frame, d): cumulative-mean-normalised difference at lags floor(rate / fmax) to ceil(rate / fmin). The
    difference at lag k is 2 (acf(0) - acf(k)) less the energy of the first k samples, none at lag 1."""
    low, high = lags(rate, length, fmin, fmax)

    def measure(x: np.ndarray) -> np.ndarray:
        size = 1 << (2 * length - 1).bit_length()
        acf = np.fft.irfft(np.abs(np.fft.rfft(x, size, axis=1)) ** 2, size, axis=1)[:, : high + 1]
        energy = np.cumsum(x * x, axis=1)[:, :high]
        energy[:, 0] = 0.0
        raw = 2 * (acf[:, :1] - acf[:, 1:]) - energy
        mean = np.cumsum(raw, axis=1) / np.arange(1, high + 1)
        return raw[:, low - 1 :] / (mean[:, low - 1 :] + np.finfo(np.float64).tiny)

    return per_frame(framed, measure, "d")


def _minima(low: int, rate: float) -> Column:
    """Structs (tau, d, f0_hz) of the local minima of column d, the lag refined by a parabola but for the last."""
    d = lambda i: F.get("d", i)

    def candidate(i: Column) -> Column:
        a, b = d(i + 1) + d(i - 1) - 2 * d(i), (d(i + 1) - d(i - 1)) / 2
        shift = F.when(F.abs(b) >= F.abs(a), F.lit(0.0)).otherwise(-b / a)
        tau = i + low
        return F.struct(tau.cast("bigint").alias("tau"), d(i).alias("d"), (F.lit(float(rate)) / (tau + F.coalesce(shift, F.lit(0.0)))).alias("f0_hz"))

    inner = F.when(F.size("d") > 1, F.sequence(F.lit(1), F.size("d") - 1)).otherwise(F.array().cast("array<int>"))
    lowest = F.filter(inner, lambda i: (d(i) < d(i - 1)) & F.coalesce(d(i) <= d(i + 1), F.lit(True)))
    return F.transform(lowest, candidate)


def yin_candidates(diff: DataFrame, low: int, rate: float = SAMPLE_RATE) -> DataFrame:
    """(take_id, frame, tau, d, f0_hz) of local minima; low is the least lag of diff."""
    return diff.select("take_id", "frame", F.explode(_minima(low, rate)).alias("c")).select("take_id", "frame", "c.tau", "c.d", "c.f0_hz")


def yin_f0(diff: DataFrame, low: int, rate: float = SAMPLE_RATE, threshold: float = 0.3, voiced: float = VOICED_FLOOR) -> DataFrame:
    """(take_id, frame, f0_hz, confidence): the first candidate below the threshold, else the lowest; f0 is 0 where
    the confidence is under the voiced floor."""
    rows = diff.select("take_id", "frame", _minima(low, rate).alias("c"))
    early = F.get(F.filter("c", lambda x: x["d"] < threshold), F.lit(0))
    lowest = F.array_min(F.transform("c", lambda x: F.struct(x["d"].alias("d"), x["tau"].alias("tau"), x["f0_hz"].alias("f0_hz"))))
    rows = rows.select("take_id", "frame", F.coalesce(early["f0_hz"], lowest["f0_hz"]).alias("hz"), F.coalesce(early["d"], lowest["d"]).alias("d"))
    sure = F.coalesce(F.least(F.greatest(1 - F.col("d"), F.lit(0.0)), F.lit(1.0)), F.lit(0.0))
    return rows.select("take_id", "frame", F.when(sure >= voiced, F.col("hz")).otherwise(0.0).alias("f0_hz"), sure.alias("confidence"))


def voicing(pitch: DataFrame, floor: float = VOICED_FLOOR) -> DataFrame:
    """pitch with confidence in [0, 1], NaN as 0, voiced by the floor, and f0 0 where unvoiced."""
    sure = F.least(F.greatest(F.coalesce(F.nanvl("confidence", F.lit(0.0)), F.lit(0.0)), F.lit(0.0)), F.lit(1.0))
    on = sure >= floor
    return pitch.withColumn("confidence", sure).withColumn("voiced", on.cast("int")).withColumn("f0_hz", F.when(on, F.coalesce(F.nanvl("f0_hz", F.lit(0.0)), F.lit(0.0))).otherwise(0.0))


def hps_f0(framed: DataFrame | Cut, length: int, rate: float = SAMPLE_RATE, harmonics: int = 5, fmin: float = 40.0, fmax: float = 4000.0, least: int = 512) -> DataFrame:
    """(take_id, frame, k, f0_hz): of the bins from fmin to below fmax, the one whose magnitude, times those at its
    multiples up to harmonics that the spectrum has, is largest (logarithms to six digits; the lowest of equals). Frames
    of under least samples, and bands of under eight bins in such a case, have f0 0 and no k."""
    low, high = (int(np.searchsorted(np.arange(length // 2 + 1) * (rate / length), f)) for f in (fmin, fmax))

    def best(x: np.ndarray) -> np.ndarray:
        log = np.log(np.maximum(magnitudes(x, periodic=False), 1e-12))
        total = log.copy()
        for h in range(2, harmonics + 1):
            part = log[:, ::h]
            total[:, : part.shape[1]] += part
        return low + np.round(total[:, low:high], 6).argmax(axis=1)[:, None].astype(float)

    if length < least or high <= low:
        numbered = measured(framed, {}) if isinstance(framed, Cut) else framed
        return numbered.select("take_id", "frame", F.lit(None).cast("bigint").alias("k"), F.lit(0.0).alias("f0_hz"))
    found = per_frame(framed, best, "k").withColumn("k", F.get("k", F.lit(0)).cast("bigint"))
    return found.withColumn("f0_hz", F.col("k") * (rate / length))


def voiced_runs(pitch: DataFrame, min_frames: int) -> DataFrame:
    """(take_id, note_no, start_frame, end_frame, f0_hz) of runs of voiced frames, end exclusive."""
    v = pitch.where("voiced = 1").withColumn("run", F.col("frame") - F.row_number().over(W.partitionBy("take_id").orderBy("frame")))
    runs = v.groupBy("take_id", "run").agg(F.min("frame").alias("start_frame"), (F.max("frame") + 1).alias("end_frame"), F.median("f0_hz").alias("f0_hz")).where(F.col("end_frame") - F.col("start_frame") >= min_frames)
    return runs.withColumn("note_no", F.row_number().over(W.partitionBy("take_id").orderBy("start_frame")).cast("bigint")).drop("run")


def note_segments(pitch: DataFrame, rms: DataFrame, pitch_hop: int = PITCH_HOP, rms_hop: int = RMS_HOP, rate: float = SAMPLE_RATE, min_sec: float = MIN_NOTE_SEC) -> DataFrame:
    """(take_id, note_no, start_frame, end_frame, onset_sec, f0_hz, rms): voiced runs of min_sec with their median
    pitch and the median energy of the energy frames that start in them, or of the nearest one if none does."""
    runs = voiced_runs(pitch, max(1, math.ceil(round(min_sec * rate / pitch_hop, 9))))
    up = lambda c: F.ceil(F.col(c) * pitch_hop / rms_hop).cast("bigint")
    spans = runs.select("take_id", "note_no", up("start_frame").alias("start_frame"), up("end_frame").alias("span_end"))
    inside = frames_in_spans(rms.select("take_id", "frame", "rms"), spans).groupBy("take_id", "note_no").agg(F.median("rms").alias("inside"))
    last = rms.groupBy("take_id").agg(F.max("frame").alias("last"))
    at = runs.join(last, "take_id", "left").withColumn("at", F.least(F.rint(F.col("start_frame") * pitch_hop / rms_hop).cast("bigint"), F.col("last")))
    near = at.join(rms.select("take_id", F.col("frame").alias("at"), F.col("rms").alias("near")), ["take_id", "at"], "left")
    joined = near.join(inside, ["take_id", "note_no"], "left")
    return joined.select("take_id", "note_no", "start_frame", "end_frame", (F.col("start_frame") * pitch_hop / rate).alias("onset_sec"), "f0_hz", F.coalesce("inside", "near").alias("rms"))


def threshold_onsets(rms: DataFrame, level: float = 0.15) -> DataFrame:
    """(take_id, frame) where energy, relative to the take's maximum, goes up through the level. rms has take_id, frame and
    rms, or chunks: the frame of the first and an array of the energies from there on. Frames of a chunk stay in its row,
    so rows are sorted by chunk; the sort for the frame before comes first and serves the join as well."""
    if not isinstance(rms.schema["rms"].dataType, T.ArrayType):
        rms = rms.withColumn("rms", F.array("rms"))
    chunks = rms.where(F.size("rms") > 0).select("take_id", "frame", "rms")
    top = chunks.groupBy("take_id").agg(F.max(F.array_max("rms")).alias("top"))
    last = F.struct(F.element_at("rms", -1).alias("rms"))  # null only where there is no chunk before
    c = chunks.withColumn("before", F.lag(last).over(W.partitionBy("take_id").orderBy("frame"))).join(top, "take_id")
    e = lambda x: F.when(F.col("top") > 0, x / F.col("top")).otherwise(0.0)
    at = lambda i: e(F.get("rms", i))
    first = F.when(F.col("before").isNull(), 0.0).otherwise(e(F.col("before.rms")))
    up = F.filter(F.sequence(F.lit(0), F.size("rms") - 1), lambda i: (at(i) >= level) & (F.when(i > 0, at(i - 1)).otherwise(first) < level))
    return c.select("take_id", "frame", F.explode(up).alias("i")).select("take_id", (F.col("frame") + F.col("i")).alias("frame"))


def sliding_median(x: np.ndarray, reach: int) -> np.ndarray:
    """The median of the values within reach places of each, by one sorted list that gains a value and loses one a step."""
    held = sorted(x[:reach].tolist())
    out = np.empty(len(x))
    for k in range(len(x)):
        if k + reach < len(x):
            insort(held, float(x[k + reach]))
        if k > reach:
            del held[bisect_left(held, float(x[k - reach - 1]))]
        n = len(held)
        out[k] = held[n // 2] if n % 2 else (held[n // 2 - 1] + held[n // 2]) / 2
    return out


def peaks(db: np.ndarray, reach: int, gap: int) -> list[int]:
    """Places of the peaks of the rise in dB above 1.5 times the median within reach places, the first and the last left
    out, at least gap apart, the earlier of two staying."""
    rise = np.maximum(np.diff(db, prepend=db[:1]), 0.0)
    high = rise > 1.5 * sliding_median(rise, reach) + 1e-3
    high[1:] &= rise[1:] >= rise[:-1]
    high[:-1] &= rise[:-1] >= rise[1:]
    kept: list[int] = []
    for k in np.flatnonzero(high[1:-1]) + 1:
        if not kept or k - kept[-1] >= gap:
            kept.append(int(k))
    return kept


def novelty_onsets(db: DataFrame, reach: int, gap: int) -> DataFrame:
    """(take_id, frame): peaks() of each take's levels; db has take_id, frame and db. A group is a take's levels, a number
    a frame."""
    kind = db.schema["take_id"].dataType.simpleString()

    def run(group: pa.Table) -> pa.Table:
        group = group.sort_by("frame")
        kept = pa.array(peaks(group.column("db").to_numpy(), reach, gap), pa.int64())
        return pa.table([group.column("take_id").take(kept), group.column("frame").take(kept)], ["take_id", "frame"])

    rows = db.select("take_id", F.col("frame").cast("bigint").alias("frame"), F.col("db").cast("double").alias("db"))
    return rows.groupBy("take_id").applyInArrow(run, f"take_id {kind}, frame long")


def onsets(samples: DataFrame, rate: float = SAMPLE_RATE, length: int = ONSET_FRAME, hop: int = RMS_HOP, reach_sec: float = 1.0, gap_sec: float = 0.05) -> DataFrame:
    """(take_id, frame, onset_sec) of takes, or of with_halo's chunks: peaks() of the level of whole frames, with the median
    of a second to either side. A take of fewer than two frames has none."""
    level = lambda x: 20.0 * np.log10(np.sqrt((x * x).mean(axis=1, keepdims=True)) + ONSET_FLOOR)
    db = measured(Cut(samples, length, hop), {"db": level}).withColumn("db", F.get("db", F.lit(0)))
    found = novelty_onsets(db, max(1, round(reach_sec * rate / hop)), max(1, math.ceil(round(gap_sec * rate / hop, 9))))
    return found.withColumn("onset_sec", F.col("frame") * (hop / rate))


def window_error(t0: Column, t1: Column, upper: Column | None = None) -> Column:
    """Why [t0, t1) seconds cannot be read, or null."""
    odd = lambda t: t.isNull() | F.isnan(t)
    code = F.when(odd(t0) | odd(t1), "NOT_A_NUMBER").when(t0 >= t1, "EMPTY_WINDOW").when(t0 < 0, "NEGATIVE_START")
    return code if upper is None else code.when(t1 > upper, "BEYOND_END")


def time_slice(table: DataFrame, t0: float, t1: float, rate: float = SAMPLE_RATE, hop: int = 1, column: str = "frame", in_seconds: bool = False) -> DataFrame:
    """Rows of [t0, t1) seconds: samples (hop 1) and frames from floor(t0 * rate / hop) to before floor(t1 * rate / hop),
    path points by the time of their reference frame and notes by their onset (in_seconds, the column holding seconds or,
    with hop, frames). The bounds are literals, so the filter reaches the scan; invalid windows raise."""
    if not 0 <= t0 < t1:
        raise ValueError(f"not a window: [{t0}, {t1})")
    if in_seconds:
        at = F.col(column) * (hop / rate) if hop > 1 else F.col(column)
        return table.where((at >= t0) & (at < t1))
    return table.where((F.col(column) >= math.floor(t0 * rate / hop)) & (F.col(column) < math.floor(t1 * rate / hop)))


def time_slices(table: DataFrame, windows: DataFrame, rate: float = SAMPLE_RATE, hop: int = 1, column: str = "frame", in_seconds: bool = False, bucket_sec: float = 1.0) -> DataFrame:
    """(window_id, error_code, table's columns) of each window's rows; windows has window_id, take_id, t0, t1 and the
    take's upper bound in seconds. A window that cannot be read has one row with its error, an empty one none.

    An interval join: rows meet the windows that reach their bucket of time, so what is joined is the windows' own rows
    and those of the two buckets at their ends; windows are first cut to the buckets that the take has rows in."""
    at = F.col(column) * (hop / rate) if hop > 1 and in_seconds else F.col(column)
    size = bucket_sec if in_seconds else max(1, int(bucket_sec * rate / hop))
    checked = windows.withColumn("error_code", window_error(F.col("t0"), F.col("t1"), F.col("upper")))
    bad = checked.where("error_code is not null").select("window_id", "error_code", "take_id")
    good = checked.where("error_code is null").select("window_id", "take_id", *((F.col(t) if in_seconds else F.floor(F.col(t) * rate / hop)).alias(f"__{t}") for t in ("t0", "t1")))
    rows = table.withColumn("__bucket", F.floor(at / size)).withColumn("__place", at)
    ends = rows.groupBy("take_id").agg(F.min("__bucket").alias("__low"), F.max("__bucket").alias("__high"))
    low, high = F.greatest(F.floor(F.col("__t0") / size), F.col("__low")), F.least(F.floor(F.col("__t1") / size), F.col("__high"))
    reach = good.join(ends, "take_id").where(low <= high).select("window_id", "take_id", "__t0", "__t1", F.explode(F.sequence(low, high)).alias("__bucket"))
    inside = (F.col("__place") >= F.col("__t0")) & (F.col("__place") < F.col("__t1"))
    found = rows.join(reach, ["take_id", "__bucket"]).where(inside).select("window_id", F.lit(None).cast("string").alias("error_code"), *table.columns)
    return found.unionByName(bad, allowMissingColumns=True)
