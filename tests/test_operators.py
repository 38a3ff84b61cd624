"""Operators that SQL does not check, boundary values, plans, and planted defects."""

import hashlib
import math
import random
import re
import time
import tracemalloc
import wave

import numpy as np
import pytest
from pyspark.sql import functions as F

from takewise.operators import align, frames, gates, metrics, pairing, results, scores
from takewise.operators import catalogue as catalogue_ops
from takewise.plans import catalogue
from takewise.sources import adapters, files


def brute_path(x, y, band):
    """Least-cost paths by a full table."""
    n, m = len(x), len(y)
    cost = np.full((n, m), np.inf)
    for i in range(n):
        for j in range(m):
            if abs(i / n - j / m) <= band + 1e-12:
                d = np.linalg.norm(x[i] - y[j])
                before = [cost[a, b] for a, b in ((i - 1, j - 1), (i - 1, j), (i, j - 1)) if a >= 0 and b >= 0]
                cost[i, j] = d + (min(before) if before else 0)
    return cost[-1, -1]


@pytest.mark.parametrize("tie", ["diagonal", "as_written"])
def test_warp_path_is_least(tie):
    rng = np.random.default_rng(1)
    for n, m in ((1, 1), (5, 5), (8, 13), (20, 9), (12, 12)):
        x, y = rng.random((n, 3)), rng.random((m, 3))
        path = align.banded_path(x, y, 0.5, tie)
        assert path[0] == (0, 0) and path[-1] == (n - 1, m - 1)
        assert all((b[0] - a[0], b[1] - a[1]) in ((1, 1), (1, 0), (0, 1)) for a, b in zip(path, path[1:]))
        assert sum(np.linalg.norm(x[i] - y[j]) for i, j in path) == pytest.approx(brute_path(x, y, 0.5))
    flat = np.zeros((4, 1))
    same = align.banded_path(flat, flat, 0.5, tie)
    assert (same == [(i, i) for i in range(4)]) == (tie == "diagonal")


def test_warp_path_in_blocks():
    """Walked block by block, with the way back found again, ties included; little is held of a long pair."""
    rng = np.random.default_rng(4)
    for n, m in ((1, 40), (33, 32), (90, 70), (300, 211)):
        for x, y in ((rng.random((n, 2)), rng.random((m, 2))), (rng.integers(0, 2, (n, 1)) * 1.0, rng.integers(0, 2, (m, 1)) * 1.0)):
            for tie in ("diagonal", "as_written"):
                for band in (0.05, 0.3, 1.0):
                    assert align.banded_path(x, y, band, tie, held=100) == align.banded_path(x, y, band, tie)
    x, y = rng.random((4000, 1)), rng.random((4000, 1))
    tracemalloc.start()
    align.banded_path(x, y, 0.5, "diagonal", held=0)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 4_000_000 < align.Band(x, y, 0.5).cells()  # a byte a cell would be 12 MB


def test_warp_path_query(spark, sf):
    one = lambda s: adapters.pitch_frames(spark, sf).where(F.col("side") == s).select("pair_id", "frame", F.array("f0_hz").alias("features"))
    path = align.warp_path(one("reference"), one("practice"))
    sizes = adapters.pitch_frames(spark, sf).groupBy("pair_id").agg(F.count(F.when(F.col("side") == "reference", 1)).alias("n_ref"), F.count(F.when(F.col("side") == "practice", 1)).alias("n_prac"))
    for r in align.path_checks(path, sizes.where("n_ref > 0 and n_prac > 0")).collect():
        assert r.monotone and (r.coverage == 1 or r.error_code)


def test_frames_of_any_chunking(spark):
    takes = [(1, [float(i) for i in range(37)]), (2, [1.0, 2.0]), (3, [0.5] * 16)]
    whole = {(r.take_id, r.frame): r.x for r in frames.frames(spark.createDataFrame(takes, "take_id long, pcm array<double>"), 16, 6).collect()}
    for size in (1, 7, 64):
        chunks = [(t, k, x[k * size : (k + 1) * size]) for t, x in takes for k in range(-(-len(x) // size))]
        got = frames.frames_of_chunks(spark.createDataFrame(chunks, "take_id long, chunk_no long, pcm array<double>"), size, 16, 6)
        assert {(r.take_id, r.frame): r.x for r in got.collect()} == whole


@pytest.mark.parametrize("length,hop,border", [(16, 6, 0), (16, 6, 8), (16, 16, 8), (5, 7, 0), (7, 3, 3), (16, 40, 8)])
def test_measures_of_chunks_and_of_takes(spark, length, hop, border):
    """Cut and measured in one pass, takes in chunks of any size give what whole takes give, in doubles and in floats."""
    rng = np.random.default_rng(length * hop)
    takes = [(i, rng.normal(size=n).round(3)) for i, n in enumerate((37, 2, 16, 15, 17, 64, 100))]
    want = {}
    for i, x in takes:
        padded = np.pad(x, border)
        padded = np.pad(padded, (0, max(0, length - len(padded))))
        for k in range(1 + (len(padded) - length) // hop):
            want[i, k] = padded[k * hop : k * hop + length]
    level = {"x": lambda x: x, "peak": lambda x: x.max(axis=1, keepdims=True)}
    whole = spark.createDataFrame([(i, x.tolist()) for i, x in takes], "take_id long, pcm array<double>")
    tables = [frames.Cut(whole, length, hop, border=border)]
    for size in (1, 7, 64):
        chunks = [(i, k, x[k * size : (k + 1) * size].tolist()) for i, x in takes for k in range(-(-len(x) // size))]
        kind = "double" if size > 1 else "float"
        table = spark.createDataFrame(chunks, f"take_id long, chunk_no long, pcm array<{kind}>")
        tables.append(frames.Cut(frames.with_halo(table, size, length), length, hop, border=border))
    for cut in tables:
        got = {(r.take_id, r.frame): r for r in frames.measured(cut, level).collect()}
        assert set(got) == set(want)
        assert all(np.allclose(r.x, want[k], atol=1e-6) and np.isclose(r.peak[0], want[k].max(), atol=1e-6) for k, r in got.items())


def test_novelty_onsets(spark):
    rng = np.random.default_rng(3)
    db = np.round(rng.random(60) * 20, 3)
    rise = np.maximum(np.diff(db, prepend=db[0]), 0)
    want, last = [], None
    for k in range(1, 59):
        middle = np.median(rise[max(0, k - 5) : k + 6])
        if rise[k] > 1.5 * middle + 1e-3 and rise[k] >= rise[k - 1] and rise[k] >= rise[k + 1] and (last is None or k - last >= 4):
            want.append(k)
            last = k
    rows = spark.createDataFrame([(1, k, float(v)) for k, v in enumerate(db)], "take_id long, frame long, db double")
    assert sorted(r.frame for r in frames.novelty_onsets(rows, 5, 4).collect()) == want


def tone(n, *hz, rate=44100.0):
    t = np.arange(n) / rate
    return sum(np.sin(2 * np.pi * f * t) / (i + 1) for i, f in enumerate(hz))


def test_signal_at_real_sizes(spark):
    """Frames of 2048 samples against numpy, and pitches of known tones."""
    rng = np.random.default_rng(5)
    takes = [(1, tone(30_000, 440.0, 880.0)), (2, rng.normal(size=20_000)), (3, np.zeros(9_000)), (4, tone(1_000, 300.0))]
    df = spark.createDataFrame([(i, x.tolist()) for i, x in takes], "take_id long, pcm array<double>")
    pcm = dict(takes)
    window = 0.5 - 0.5 * np.cos(2 * np.pi * np.arange(2048) / 2048)
    framed = frames.Cut(df, 2048, 512)
    assert sorted(map(tuple, frames.spectra(framed).collect())) == sorted(map(tuple, frames.spectra(frames.frames(df, 2048, 512)).collect()))
    for r in frames.spectra(framed).collect():
        x = np.resize(np.pad(pcm[r.take_id], (0, 2048))[r.frame * 512 : r.frame * 512 + 2048], 2048)
        assert np.allclose(r.mag, np.abs(np.fft.rfft(x * window)))
    wide = lambda x, n: np.concatenate((np.zeros(n // 2), x, np.zeros(n // 2)))
    hann = 0.5 - 0.5 * np.cos(2 * np.pi * np.arange(4096) / 4096)
    seen = {}
    for r in frames.align_chroma(df).collect():
        x = wide(pcm[r.take_id], 4096)[r.frame * 2048 : r.frame * 2048 + 4096]
        mag, hz = np.abs(np.fft.rfft(x * hann)), np.arange(2049) * 44100 / 4096
        out = np.zeros(12)
        for m, f in zip(mag, hz):
            if 27.5 <= f <= 4200:
                out[int(np.round(12 * np.log2(f / 27.5))) % 12] += m
        assert np.allclose(r.bins, out / (np.linalg.norm(out) or 1.0))
        seen[r.take_id] = seen.get(r.take_id, 0) + 1
    assert seen == {i: (len(x) - 1) // 2048 for i, x in takes if len(x) > 2048}
    for r in frames.chroma(df).collect():
        assert len(r.bins) == 12 and (max(r.bins) == 1.0 or (r.take_id == 3 and max(r.bins) == 0.0))
        if r.take_id == 1 and 2 <= r.frame <= 10:
            assert r.bins[9] == 1.0  # A, counted from C
    low, high = frames.lags(44100, 2048, 130.81, 2093.0)
    diff = frames.yin_difference(framed)
    for r in diff.collect():
        x = np.pad(pcm[r.take_id], (0, 2048))[r.frame * 512 : r.frame * 512 + 2048]
        energy = np.cumsum(x * x)
        raw = np.array([2 * (x @ x - x[: 2048 - k] @ x[k:]) - (energy[k - 1] if k > 1 else 0.0) for k in range(1, high + 1)])
        mean = np.cumsum(raw) / np.arange(1, high + 1)
        assert np.allclose(r.d, raw[low - 1 :] / (mean[low - 1 :] + np.finfo(float).tiny), atol=1e-6)
    f0 = frames.yin_f0(diff, low).where("take_id = 1").collect()
    assert all(abs(1200 * np.log2(r.f0_hz / 440)) < 5 and r.confidence > 0.9 for r in f0)
    assert all(r.f0_hz == 0 for r in frames.yin_f0(diff, low).where("take_id = 3").collect())
    rich = spark.createDataFrame([(1, tone(9_000, *(440.0 * h for h in range(1, 7))).tolist())], "take_id long, pcm array<double>")
    assert all(abs(r.f0_hz - 440) < 22 for r in frames.hps_f0(frames.frames(rich, 2048, 512), 2048).collect())
    assert {r.f0_hz for r in frames.hps_f0(frames.frames(df, 256, 128), 256).collect()} == {0.0}


def test_band_path_at_size():
    """2,584 frames a side within a quarter: the path ends, and has the least cost of a short one's full table."""
    rng = np.random.default_rng(2)
    x, y = rng.random((2584, 12)), rng.random((2584, 12))
    began = time.perf_counter()
    path = align.banded_path(x, y, 0.25, "diagonal")
    assert path[0] == (0, 0) and path[-1] == (2583, 2583) and time.perf_counter() - began < 5
    assert all(abs(i / 2584 - j / 2584) <= 0.25 + 1e-9 for i, j in path)


def test_gates(spark):
    """The bounds are allowed, one sample beyond is not; an empty take is silent; the first failing gate names the take."""
    rate = 44100
    takes = [(1, 1, "reference", True, rate, 45 * rate), (2, 1, "practice", True, rate, 45 * rate - 1), (3, 2, "reference", True, rate, 120 * rate), (4, 2, "practice", True, rate, 120 * rate), (5, 3, "reference", True, rate, 120 * rate + 1), (6, 3, "practice", False, 0, 1),
             (7, 4, "reference", True, 22050, 1), (8, 4, "practice", True, rate, 60 * rate), (9, 5, "reference", True, rate, 60 * rate), (10, 6, "reference", True, rate, 60 * rate), (11, 6, "practice", True, rate, 60 * rate)]
    t = spark.createDataFrame(takes, "take_id long, pair_id long, side string, readable boolean, sample_rate int, n_samples long")
    assert {r.take_id: r.error_code for r in gates.duration_gate(t).collect() if r.error_code} == {2: "INPUT_TOO_SHORT", 5: "INPUT_TOO_LONG", 6: "CORE_BUILD_FAILED", 7: "INPUT_TOO_SHORT"}
    loud = [(i, [0.5, -0.5]) for i in (1, 2, 3, 4, 5, 7, 8, 9)] + [(1, [0.5]), (10, [1e-4, -1e-4]), (11, [9.9e-5])]
    s = spark.createDataFrame(loud, "take_id long, pcm array<double>")
    assert {r.take_id for r in gates.silence_gate(t, s).collect() if r.error_code} == {6, 11}
    odd = s.unionByName(spark.createDataFrame([(8, [float("nan")]), (9, [float("-inf")])], s.schema))
    assert {r.take_id for r in gates.nonfinite_gate(odd).collect() if r.error_code} == {8, 9}
    got = {r.pair_id: (r.usable, r.first_code) for r in gates.ingest_verdict(t, odd).collect()}
    assert got == {1: (False, "INPUT_TOO_SHORT"), 2: (True, None), 3: (False, "INPUT_TOO_LONG"), 4: (False, "CORE_BUILD_FAILED"), 5: (False, "CORE_BUILD_FAILED"), 6: (False, "INPUT_SILENT")}
    stereo = spark.createDataFrame([(1, 0, [1.0, 3.0, 5.0]), (1, 1, [3.0, 1.0])], "take_id long, channel int, pcm array<double>")
    assert gates.downmix(stereo).first().pcm == [2.0, 2.0, 5.0]


def test_transpose_shift_of_any_range(spark):
    """The rule of the two ranges, spelled out, on ranges that fit, fit only the wider one, or neither."""
    rng = np.random.default_rng(7)
    ranges = [(10, 14), (30, 100), (60, 84), (55, 88), (84, 85), (0, 33), (0, 34)] + [tuple(sorted(rng.integers(0, 128, 2).tolist())) for _ in range(60)]
    rows = [(i, m) for i, r in enumerate(ranges) for m in r]
    for r in scores.transpose_shift(spark.createDataFrame(rows, "song_id long, midi long")).collect():
        lo, hi = ranges[r.song_id]
        for a, b in ((60, 84), (55, 88)):
            fits = [s for s in range(-128, 129) if lo + s >= a and hi + s <= b]
            if fits:
                want = (min(fits, key=abs), a, b)
                break
        else:
            want = (0, 55, 88)
        assert (r.shift, r.low, r.high) == want


def test_set_similarity_loses_nothing(spark):
    """All pairs of different sets at the threshold or above, against plain Python; equal sets are one."""
    rng = random.Random(4)
    sets = {i: {rng.choice("aaaabbbccdefghij") for _ in range(rng.randint(1, 9))} for i in range(120)}
    rows = [(i, t) for i, s in sets.items() for t in s] + [(0, next(iter(sets[0])))]
    pairs, members = pairing.set_similarity(spark.createDataFrame(rows, "id long, token string"), 0.6)
    least = {}
    for i, s in sets.items():
        least.setdefault(frozenset(s), i)
    assert {(r.id, r.representative) for r in members.collect()} == {(i, least[frozenset(s)]) for i, s in sets.items()}
    want = {(a, b): len(x & y) / len(x | y) for x, a in least.items() for y, b in least.items() if a < b and len(x & y) / len(x | y) >= 0.6}
    got = {(r.a, r.b): r.similarity for r in pairs.collect()}
    assert got == want and len(want) > 20


def test_natural_order_in_any_partitions(spark):
    names = [(i, f"{i * 37 % 50}_x" if i % 3 else "same name" if i % 2 else f"n{i}") for i in range(300)]
    df = spark.createDataFrame(names, "k long, name string").repartition(5)
    want = sorted(names, key=lambda x: (not x[1][0].isdigit(), int(x[1].split("_")[0]) if x[1][0].isdigit() else 0, x[1], x[0]))
    for n in (1, 3, 9):
        got = {r.k: r.place for r in catalogue_ops.natural_order(df, "name", "k", n).collect()}
        assert got == {k: i + 1 for i, (k, _) in enumerate(want)}
    assert catalogue_ops.natural_order(df.limit(0), "name", "k").count() == 0


def test_boundaries(spark):
    notes = [(0, "reference", 1, 0.0), (0, "practice", 1, 0.1), (0, "reference", 2, 1.0), (0, "practice", 2, 1.2), (1, "reference", 1, 0.0)]
    df = spark.createDataFrame(notes, "pair_id long, side string, note_no long, onset_sec double")
    m = pairing.match_onsets(df, 0.1).collect()
    assert [(r.pair_id, r.ref_no, r.prac_no) for r in m] == [(0, 1, 1)]
    every = {(r.pair_id, r.ref_no, r.prac_no, r.error_code) for r in pairing.pair_onsets(df, 0.1).collect()}
    assert every == {(0, 1, 1, None), (0, 2, None, None), (0, None, 2, None), (1, 1, None, None)}
    for bad in ([(0, "practice", 3, float("nan"))], [(0, "practice", 3, 0.5)], [(0, "reference", 3, float("inf"))]):
        got = pairing.pair_onsets(df.unionByName(spark.createDataFrame(bad, df.schema))).where("pair_id = 0").collect()
        assert [(r.ref_no, r.prac_no, r.error_code) for r in got] == [(None, None, "ALGORITHM_FAILED")]
    warped = pairing.pair_onsets(df.withColumn("timeline_basis", F.lit("WARPED")))
    assert warped.where("error_code is null").count() == 0
    d = spark.createDataFrame([(1, 50.0), (1, 50.1), (1, None), (2, None)], "pair_id long, cents double")
    got = {r.pair_id: (r.off_pitch_ratio, r.n_notes_used, r.n_unpaired) for r in metrics.pitch_summary(d).collect()}
    assert got == {1: (0.5, 2, 1), 2: (0.0, 0, 1)}


def song(spark):
    return spark.createDataFrame([(1, i, i * 400, i * 400 + 400, 60 + i % 12, 80) for i in range(200)], "song_id long, note_no long, st_tick long, en_tick long, midi long, velocity long")


def tempo(spark):
    return spark.createDataFrame([(1, 0, 500_000)], "song_id long, tick long, us_per_beat long")


def test_planted_defects(spark):
    """Shares, sizes and bounds of each defect; timing keeps notes, order, ends and a quarter of each length."""
    s, t = song(spark), tempo(spark)
    cents = np.array([r.planted_cents for r in scores.perturb_pitch(s, 3).collect()])
    far = np.abs(cents) > 30
    assert 0.75 < far.mean() < 0.95 and (np.abs(cents[far]) >= 45).all() and np.abs(cents).max() <= 115 and 0.55 < (cents[far] > 0).mean() < 0.8
    wrong = scores.perturb_wrong_notes(s, t, 3).collect()
    assert sum(r.planted_semitones != 0 for r in wrong) == 30 and {abs(r.planted_semitones) for r in wrong} == {0, 1, 2, 3}
    few = scores.perturb_wrong_notes(s.where("note_no < 3"), t, 3).collect()
    assert sum(r.planted_semitones != 0 for r in few) == 1
    short = s.withColumn("en_tick", F.col("st_tick") + 10)
    assert scores.perturb_wrong_notes(short, t, 3).where("planted_semitones <> 0").count() == 0
    high = scores.perturb_wrong_notes(s.withColumn("midi", F.lit(108).cast("bigint")), t, 3)
    assert high.agg(F.max("midi")).first()[0] == 108
    loud = scores.perturb_dynamics(s, 3).collect()
    assert all(3 <= r.velocity <= 127 for r in loud) and 0.03 < np.mean([r.factor < 0.26 for r in loud]) < 0.2
    gone = sorted(r.note_no for r in scores.perturb_dropouts(s, 3).where("dropped").collect())
    assert 10 < len(gone) < 80
    moved = sorted((r.note_no, r.new_start, r.new_end) for r in scores.perturb_timing(s, t, 3).collect())
    assert len(moved) == 200 and moved[0][1] == 0 and moved[-1][2] == 80_000
    assert all(b - a >= 100 for _, a, b in moved) and all(x[2] == y[1] for x, y in zip(moved, moved[1:]))
    late = np.array([a - 400 * i for i, a, _ in moved])
    assert late.any() and late[-50:].mean() < late[:50].mean() < 40  # it drifts ahead
    labels = scores.defect_labels(scores.perturb_wrong_notes(s, t, 3), t, "wrong", ["planted_semitones"], "planted_semitones <> 0")
    assert labels.count() == 30 and labels.where("abs(onset_sec - note_no * 400 / 960) > 1e-4").count() == 0


def test_results_do_not_depend_on_partitions(spark):
    s, t = song(spark), tempo(spark)
    one = (lambda x: scores.perturb_pitch(x, 5), lambda x: scores.perturb_wrong_notes(x, t, 5), lambda x: scores.perturb_dropouts(x, 5), lambda x: scores.perturb_timing(x, t, 5))
    for f in one:
        assert sorted(f(s.repartition(1)).collect()) == sorted(f(s.repartition(7)).collect())


def test_polyphony_counts_rests(spark):
    rows = [(1, 0, 10, 60), (1, 5, 10, 64), (1, 20, 30, 60), (2, 0, 5, 60)]
    got = {r.song_id: (r.max_voices, round(r.poly_ratio, 6)) for r in scores.polyphony(spark.createDataFrame(rows, "song_id long, st_tick long, en_tick long, midi long")).collect()}
    assert got == {1: (2, round(5 / 30, 6)), 2: (1, 0.0)}


def test_registry(spark):
    registry = results.MetricRegistry()
    metric = lambda t: t["x"].select("pair_id", F.lit("k").alias("key"), F.lit(1).alias("value"))
    registry.register("a", "1", ("x",), metric)
    with pytest.raises(ValueError):
        registry.register("a", "2", ("x",), metric)
    registry.register("b", "1", ("missing",), metric)
    got = registry.run({"x": spark.range(2).withColumnRenamed("id", "pair_id")}).collect()
    assert [(r.pair_id, r.algorithm_id, r.value) for r in got] == [(0, "a", 1.0), (1, "a", 1.0)]


def test_wav_headers(spark, tmp_path):
    for name, channels, rate, frames_ in (("mono.wav", 1, 44100, 44100), ("stereo.wav", 2, 22050, 11025)):
        with wave.open(str(tmp_path / name), "wb") as w:
            w.setnchannels(channels)
            w.setsampwidth(2)
            w.setframerate(rate)
            w.writeframes(b"\0\0" * channels * frames_)
    plain = (tmp_path / "mono.wav").read_bytes()
    (tmp_path / "list.wav").write_bytes(plain[:36] + b"LIST\3\0\0\0abc\0" + plain[36:])
    (tmp_path / "short.wav").write_bytes(plain[:-100])
    (tmp_path / "cut.wav").write_bytes(b"RIFF\0\0")
    (tmp_path / "nodata.wav").write_bytes(plain[:36])
    (tmp_path / "text.wav").write_bytes(b"no sound " * 10)
    got = {r.relative_path: r for r in files.wav_header_scan(spark, str(tmp_path)).collect()}
    assert (got["mono.wav"].duration_sec, got["mono.wav"].channels, got["mono.wav"].bit_depth, got["mono.wav"].format) == (1.0, 1, 16, "PCM")
    assert (got["stereo.wav"].duration_sec, got["stereo.wav"].sample_rate_hz) == (0.5, 22050)
    assert got["list.wav"].duration_sec == 1.0 and got["short.wav"].duration_sec == pytest.approx(1 - 50 / 44100)
    assert all(got[n].error_code == "INPUT_UNREADABLE" and got[n].duration_sec is None for n in ("cut.wav", "text.wav", "nodata.wav"))


def test_manifest(spark, tmp_path):
    (tmp_path / "m.csv").write_text("\ufeffid,title,sec\n\ufeff1,Tune é,60.5\n", encoding="utf-8")
    schema = "id long, title string, sec double"
    assert [tuple(r) for r in files.read_manifest(spark, str(tmp_path / "m.csv"), schema).collect()] == [(1, "Tune é", 60.5)]
    files.write_manifest(spark.createDataFrame([(1, "a,b", 0.5), (2, "ü", None)], schema).coalesce(1), str(tmp_path / "out"))
    (part,) = (tmp_path / "out").glob("*.csv")
    assert part.read_bytes().startswith(b"\xef\xbb\xbfid,title,sec")
    assert [tuple(r) for r in files.read_manifest(spark, str(tmp_path / "out"), schema).collect()] == [(1, "a,b", 0.5), (2, "ü", None)]


def test_label_files(spark, tmp_path):
    (tmp_path / "labels.json").write_text('{"song": 3,\n "labels": {"late": {"sec": 0.2}, "off": {"cents": -30.5, "note": 4}}}')
    read = files.read_label_files(spark, str(tmp_path / "labels.json"), "song long, labels map<string, map<string, double>>")
    got = files.explode_labels(read.withColumn("labels", F.to_json("labels")), "labels", ["song"])
    assert sorted(tuple(r) for r in got.collect()) == [(3, "late", "sec", 0.2), (3, "off", "cents", -30.5), (3, "off", "note", 4.0)]
    files.write_documents(spark.createDataFrame([("{}",)], "document string"), str(tmp_path / "docs"))
    assert spark.read.text(str(tmp_path / "docs")).first()[0] == "{}"


def test_join_kinds(spark, sf):
    for name in ("band_distance", "frames_in_spans", "note_pitch_deviation", "tick_to_sec", "set_similarity"):
        plan = catalogue.queries()[name](spark, sf)._jdf.queryExecution().executedPlan().toString()
        assert not re.search("BroadcastNestedLoopJoin|CartesianProduct", plan), name


def test_onsets_of_samples(spark):
    """Against a plain median of a second to either side, for whole takes and for chunks, with takes of under two frames."""
    rng = np.random.default_rng(6)
    takes = {1: rng.normal(size=60_000) * np.repeat(rng.random(60) ** 4, 1000), 2: np.zeros(30_000), 3: rng.normal(size=1200), 4: tone(44_100, 440.0) * np.tile(np.linspace(1, 0, 4410), 10)}
    want = set()
    for i, x in takes.items():
        n = 1 + max(0, (len(x) - 1024) // 256)
        level = np.array([20 * np.log10(np.sqrt(np.mean(x[k * 256 : k * 256 + 1024] ** 2)) + 1e-12) for k in range(n)])
        rise = np.maximum(np.diff(level, prepend=level[:1]), 0)
        half, gap, last = round(44100 / 256), int(np.ceil(0.05 * 44100 / 256)), None
        for k in range(1, n - 1):
            if rise[k] > 1.5 * np.median(rise[max(0, k - half) : k + half + 1]) + 1e-3 and rise[k] >= rise[k - 1] and rise[k] >= rise[k + 1] and (last is None or k - last >= gap):
                want.add((i, k))
                last = k
    assert len(want) > 20
    whole = spark.createDataFrame([(i, x.tolist()) for i, x in takes.items()], "take_id long, pcm array<double>")
    got = frames.onsets(whole).collect()
    assert {(r.take_id, r.frame) for r in got} == want and all(r.onset_sec == r.frame * (256 / 44100) for r in got)
    chunks = spark.createDataFrame([(i, k, x[k * 5000 : (k + 1) * 5000].tolist()) for i, x in takes.items() for k in range(-(-len(x) // 5000))], "take_id long, chunk_no long, pcm array<double>")
    assert {(r.take_id, r.frame) for r in frames.onsets(frames.with_halo(chunks, 5000, 1024)).collect()} == want


def test_sliding_median():
    rng = np.random.default_rng(1)
    for n, reach in ((1, 3), (7, 1), (50, 5), (40, 60)):
        x = rng.integers(0, 5, n) / 2
        assert frames.sliding_median(x, reach).tolist() == [np.median(x[max(0, k - reach) : k + reach + 1]) for k in range(n)]


def test_content_hash_of_a_large_port(spark):
    """8 million rows of one port: a leaf holds HASH_CHUNK items, whatever the partitioning; one item or place more differs."""
    n = 8_000_000
    port = lambda parts, last=n: spark.range(0, last, 1, parts).select(F.lit(1).alias("take_id"), "id", (F.col("id") % 1009).alias("v"))
    root = lambda df: results.content_hash(df, ["take_id"], "pcm", "id", ["v"]).first().content_hash
    same = root(port(3))
    assert same == root(port(16).repartition(7, "v")) != root(port(3, n - 1))
    small = [(1, i, i * i) for i in range(70)]
    sha = lambda s: hashlib.sha256(s.encode()).hexdigest()
    leaves = [sha(",".join(str(v) for _, i, v in small if i // 4 == k)) for k in range(18)]
    nodes = [sha(",".join(leaves[k : k + 4])) for k in range(0, 18, 4)]
    df = spark.createDataFrame(small, "take_id long, id long, v long").repartition(5)
    assert results.content_hash(df, ["take_id"], "x", "id", ["v"], 4).first().content_hash == sha(f"takewise|x|70|{','.join(nodes)}")


def test_many_windows_join_their_own_rows(spark):
    """1,000 overlapping windows of a take of 20,000 frames join little more than their rows."""
    rng = np.random.default_rng(8)
    table = spark.range(20_000).select(F.lit(1).alias("take_id"), F.col("id").alias("frame"), (F.col("id") * 3).alias("v"))
    data = [(i, 1, float(a), float(a + b), 1e6) for i, (a, b) in enumerate(zip(rng.random(1000) * 900, rng.random(1000) * 8))]
    windows = spark.createDataFrame([*data, (1000, 1, -5.0, 0.5, 1e6), (1001, 1, 0.0, 1e6, 1e6), (1002, 1, 3.0, 2.0, 1e6), (1003, 2, 0.0, 1.0, 1e6)], "window_id long, take_id long, t0 double, t1 double, upper double")
    got = frames.time_slices(table, windows, 44100.0, 2048)
    found = {(r.window_id, r.error_code): (r.n, r.low, r.high) for r in got.groupBy("window_id", "error_code").agg(F.count("frame").alias("n"), F.min("frame").alias("low"), F.max("frame").alias("high")).collect()}
    for i, _, t0, t1, _ in data:
        low, high = math.floor(t0 * 44100 / 2048), min(20_000, math.floor(t1 * 44100 / 2048))
        assert found.get((i, None), (0, None, None)) == ((high - low, low, high - 1) if high > low else (0, None, None))
    assert found[1001, None] == (20_000, 0, 19_999) and (1000, "NEGATIVE_START") in found and (1002, "EMPTY_WINDOW") in found
    assert re.search(r"Join.*__bucket", got._jdf.queryExecution().executedPlan().toString())


def test_band_cells_are_few(spark):
    """Cells joined beyond the band are at most a tenth of it."""
    frames_of = lambda n: spark.range(n).select(F.lit(1).alias("pair_id"), F.col("id").alias("frame"), F.array(F.col("id").cast("double")).alias("features"))
    for n, m in ((700, 900), (5, 7), (1, 1)):
        sizes = spark.createDataFrame([(1, n, m)], "pair_id long, n_ref long, n_prac long")
        joined = align.band_cells(frames_of(n), frames_of(m), sizes, 0.25).count()
        got = {(r.i, r.j): r.distance for r in align.band_distance(frames_of(n), frames_of(m), sizes, 0.25).collect()}
        want = {(i, j): abs(float(i - j)) for i in range(n) for j in range(m) if abs(i / n - j / m) <= 0.25}
        assert got == want and (n < 100 or joined <= 1.1 * len(want))


def test_long_islands_are_walked(spark):
    """An island of 100,000 onsets a side, against a plain walk; a chord of many notes at the same time."""
    n = 100_000
    rng = np.random.default_rng(12)
    ref, prac = np.sort(rng.random(n) * 900).round(6), np.sort(rng.random(n) * 900).round(6)
    rows = [(1, s, k + 1, float(x)) for s, side in (("reference", ref), ("practice", prac)) for k, x in enumerate(side)]
    import pandas as pd

    df = spark.createDataFrame(pd.DataFrame(rows, columns=["pair_id", "side", "note_no", "onset_sec"]))
    got = {(r.ref_no, r.prac_no) for r in pairing.pair_onsets(df).collect()}
    i = j = 0
    want = set()
    while i < n or j < n:
        gap = prac[j] - ref[i] if i < n and j < n else None
        hit = gap is not None and abs(gap) <= 0.1
        a, b = hit or j == n or (gap is not None and gap > 0), hit or i == n or (gap is not None and gap <= 0)
        want.add((i + 1 if a else None, j + 1 if b else None))
        i, j = i + a, j + b
    assert got == want
    score = spark.range(50_000).select(F.lit(1).alias("song_id"), F.col("id").alias("note_no"), F.col("id").alias("st_tick"), (F.col("id") + 9).alias("en_tick"), (F.col("id") * 7 % 61).alias("midi"), F.lit(64).cast("long").alias("velocity"))
    top = scores.top_voice(score, 10).collect()
    assert sorted(r.anchor for r in top) == list(range(0, 50_000, 11))
    assert all(r.midi == max(k * 7 % 61 for k in range(r.anchor, min(50_000, r.anchor + 11))) for r in top)


def test_nearest_of_a_large_table(spark):
    """A group's table of 100,000 rows; equal distances go to the first name, what has no table gets null."""
    n = 100_000
    table = spark.range(n).select(F.lit("a").alias("g"), (F.col("id") / 10).alias("v"), F.format_string("n%06d", "id").alias("name"))
    table = table.unionByName(spark.createDataFrame([("b", 1.0, "z"), ("b", 1.0, "y"), ("b", 3.0, "x"), ("b", None, "w")], "g string, v double, name string"))
    asked = spark.createDataFrame([("a", 5.04), ("a", 5.05), ("a", -3.0), ("a", 1e9), ("b", 2.0), ("b", 1.2), ("c", 1.0), ("b", 2.0)], "g string, v double")
    got = sorted((r.g, r.v, r.nearest) for r in scores.nearest_row(asked, table, "g", "v", "name").collect())
    assert got == [("a", -3.0, "n000000"), ("a", 5.04, "n000050"), ("a", 5.05, "n000050"), ("a", 1e9, f"n{n - 1:06d}"), ("b", 1.2, "y"), ("b", 2.0, "x"), ("b", 2.0, "x"), ("c", 1.0, None)]


def test_hot_tokens_join_few_pairs(spark):
    """A token that a tenth of 100,000 sets have: what is joined is near the output, and no similar pair is lost."""
    n = 100_000
    ids = spark.range(n)
    hot = ids.where(F.col("id") % 10 == 0).select("id", F.lit(-1).cast("long").alias("token"))
    own = ids.select("id", (F.col("id") * 2).alias("token")).unionByName(ids.where(F.col("id") % 10 > 0).select("id", (F.col("id") * 2 + 1).alias("token")))
    twins = ids.where(F.col("id") < 500).select((F.col("id") + n).alias("id"), F.explode(F.array(F.col("id") * 2, F.lit(-1).cast("long"), F.lit(-2).cast("long"))).alias("token"))  # of id 10 k: one token more
    tokens = hot.unionByName(own).unionByName(twins).cache()
    pairs, _ = pairing.set_similarity(tokens, 0.5)
    got = {(r.a, r.b) for r in pairs.collect()}
    sets = {}
    for r in tokens.where(f"id < 2000 or id >= {n}").collect():
        sets.setdefault(r.id, set()).add(r.token)
    known = sorted(sets)
    want = {(a, b) for i, a in enumerate(known) for b in known[i + 1 :] if 2 * len(sets[a] & sets[b]) >= len(sets[a] | sets[b])}
    assert {(a, b) for a, b in got if a in sets and b in sets} == want and len(want) > 100_000
    often = tokens.groupBy("token").agg(F.count("*").alias("k"))
    order = tokens.join(often, "token").groupBy("id").agg(F.transform(F.array_sort(F.collect_list(F.struct("k", "token"))), lambda x: x["token"]).alias("t"))
    size = F.size("t")
    prefixes = order.select("id", size.alias("n"), F.posexplode(F.slice("t", F.lit(1), (size - F.ceil(size * 0.5) + 1).cast("int"))).alias("pos", "token"))
    assert pairing.overlap_candidates(prefixes, 0.5).count() <= 3 * len(got)  # of 5 * 10 ** 7 pairs of the token's sets
    tokens.unpersist()


def test_song_corpus(spark, sf):
    """Melodies have one note at a time from the lead on, repeats are the first pass again, and labels agree with what was planted."""
    from takewise.operators import songs
    from takewise.plans import songs as plans

    done = plans._build(spark, sf)
    summary = {r.song_id: r for r in done.summary.collect()}
    melody = {}
    for r in done.melody.orderBy("song_id", "st_tick").collect():
        melody.setdefault(r.song_id, []).append(r)
    assert {r.error_code for r in summary.values()} == {None, "NO_NOTES", "SONG_LENGTH"} and set(melody) == {k for k, r in summary.items() if not r.error_code}
    for k, notes in melody.items():
        assert all(a.en_tick <= b.st_tick or a.st_tick == b.st_tick for a, b in zip(notes, notes[1:]))
        one = len(notes) // summary[k].repeats
        assert len(notes) == one * summary[k].repeats == summary[k].n_notes
        gap = {b.st_tick - a.st_tick for a, b in zip(notes, notes[one:])}
        assert len(gap) == (summary[k].repeats > 1) and all(a.midi == b.midi for a, b in zip(notes, notes[one:]))
        assert 45 <= summary[k].duration_sec + 2 * summary[k].seg_sec and summary[k].duration_sec <= 120
    n = {(r.song_id, r.variant): r.n for r in done.labels.groupBy("song_id", "variant").agg(F.countDistinct("note_no").alias("n")).collect()}
    for k in melody:
        assert all(n.get((k, v), 0) == summary[k][f"n_{v}"] for v in songs.VARIANTS)
    assert done.labels.where("variant = 'timing' and abs(value) > 0.16").count() == 0
    nothing = songs.build(adapters.note_events(spark, sf).limit(0), adapters.tempo(spark, sf), spark.createDataFrame([(1, "asis")], "song_id long, mode string"))
    assert [r.error_code for r in nothing.summary.collect()] == ["NO_NOTES"] and nothing.expected.count() == nothing.labels.count() == 0


def test_warped_samples(spark):
    """Sample by sample against the rule, for chunks of any size; what cannot be warped is one row."""
    rng = np.random.default_rng(2)
    n_ref, prac = 45, rng.normal(size=37)
    path = [(1, k, i, j) for k, (i, j) in enumerate([(0, 0), (0, 1), (1, 1), (2, 3), (3, 3), (4, 4)])] + [(2, 0, 0, 9), (4, 0, 0, 0)]
    table = spark.createDataFrame(path, "pair_id long, step long, reference_frame long, practice_frame long")
    sizes = spark.createDataFrame([(1, n_ref, 37), (2, 16, 37), (3, 16, 37), (4, 16, 0)], "pair_id long, n_ref long, n_prac long")
    first = {0: 0, 1: 1, 2: 3, 3: 3, 4: 4}
    for chunk in (1, 7, 64):
        chunks = spark.createDataFrame([(p, k, prac[k * chunk : (k + 1) * chunk].tolist()) for p in (1, 2, 3) for k in range(-(-37 // chunk))], "pair_id long, chunk_no int, pcm array<double>")
        got = align.warped_samples(table, chunks, sizes, chunk, 8).collect()
        assert sorted((r.pair_id, r.error_code) for r in got if r.error_code) == [(k, "CORE_BUILD_FAILED") for k in (2, 3, 4)]
        flat = [x for r in sorted((r for r in got if not r.error_code), key=lambda r: r.frame) for x in r.pcm]
        assert flat == [prac[min(first[min(i // 8, 4)] * 8, 36)] for i in range(n_ref)]


def test_tempo_maps_of_many_segments(spark):
    """100,000 segments of a song: ticks to seconds and back, before the first segment and beyond the last."""
    n = 100_000
    tempo = spark.range(n).select(F.lit(1).alias("song_id"), (F.col("id") * 10 + 5).alias("tick"), (400_000 + F.col("id") % 7 * 1000).alias("us_per_beat"))
    ticks = spark.range(0, 10 * n + 100, 7).select(F.lit(1).alias("song_id"), (F.col("id") - 20).alias("tick"), F.lit("x").alias("sec"))
    us = [400_000 + k % 7 * 1000 for k in range(n)]
    passed = np.concatenate(([0], np.cumsum(np.array(us) * 10)))
    rows = scores.tick_to_sec(ticks, tempo, "tick", "at").collect()
    assert len(rows) == ticks.count()
    for r in rows[:: len(rows) // 500]:
        k = min(max((r.tick - 5) // 10, 0), n - 1)
        assert r.at == pytest.approx((passed[k] + (r.tick - 5 - 10 * k) * us[k]) / 480e6) and r.sec == "x"
    back = scores.sec_to_tick(spark.createDataFrame([(1, r.at) for r in rows[:: len(rows) // 500]] + [(2, 1.0)], "song_id long, at double"), tempo, "at", "t").collect()
    assert sorted(r.t for r in back) == sorted(r.tick for r in rows[:: len(rows) // 500])


def test_file_queries_leave_no_folder(spark, sf):
    from pathlib import Path

    from takewise.functions.lineage import shared_folder
    from takewise.plans import files as plans

    folder = Path(shared_folder(spark).removeprefix("file:"))
    before = {p.name for p in folder.iterdir()}
    for name in ("wav_header_scan", "manifest_csv"):
        assert plans.QUERIES[name](spark, sf).count() > 0
    assert not [p for p in folder.iterdir() if p.name not in before and len(p.name) == 32]


def test_wav_files_of_many_chunks(spark, tmp_path):
    """Any number of chunks may stand before the data."""
    chunk = lambda name, body: name + len(body).to_bytes(4, "little") + body + b"\0" * (len(body) % 2)
    head = chunk(b"fmt ", (1).to_bytes(2, "little") + (1).to_bytes(2, "little") + (8000).to_bytes(4, "little") + (16000).to_bytes(4, "little") + (2).to_bytes(2, "little") + (16).to_bytes(2, "little"))
    body = b"WAVE" + head + b"".join(chunk(b"LIST", b"x" * (i % 5)) for i in range(300)) + chunk(b"data", b"\0" * 16_000)
    (tmp_path / "a.wav").write_bytes(b"RIFF" + len(body).to_bytes(4, "little") + body)
    r = files.wav_header_scan(spark, str(tmp_path)).first()
    assert (r.duration_sec, r.sample_rate_hz, r.error_code) == (1.0, 8000, None)


def test_cents_at_the_bound(spark, sf):
    """Pitches and cents to the last bit, as cents of just 50 are off or not by it; medians of two frames among them."""
    import duckdb

    hz = lambda v: 130.81 * math.pow(2.0, v / 12)
    notes, frames_, want = [], [], {}
    for i in range(400):
        ref, prac = [hz(i / 25)] * 2, [hz(i / 25 + 0.4), hz(i / 25 + 0.6)]
        for take, side, own in ((2 * i, "reference", ref), (2 * i + 1, "practice", prac)):
            notes.append((i, side, take, 1, own[0], 0, 2))
            frames_ += [(take, k, 1, x) for k, x in enumerate(own)]
        middle = lambda xs: 0.5 * (1200 * math.log2(xs[0] / ref[0])) + 0.5 * (1200 * math.log2(xs[1] / ref[0]))  # noqa: B023, E731
        want[i] = middle(prac) - middle(ref)
    n = spark.createDataFrame(notes, "pair_id long, side string, take_id long, note_no long, f0_hz double, start_frame long, span_end long")
    f = spark.createDataFrame(frames_, "take_id long, frame long, voiced int, f0_hz double")
    deviation = metrics.note_deviation(n, f, 1).collect()
    assert {r.pair_id: r.cents for r in deviation} == want and len({c > 50 for c in want.values()}) == 2
    assert all(r.prac_hz == 0.5 * hz(r.pair_id / 25 + 0.4) + 0.5 * hz(r.pair_id / 25 + 0.6) for r in deviation)
    rows = duckdb.execute(f"with events as (select * from '{sf}/events.parquet'), notes as ({adapters.SQL['notes']}) select event_id, f0_hz from notes").fetchall()
    assert dict(rows) == {r.event_id: r.f0_hz for r in adapters.notes(spark, sf).collect()}


@pytest.mark.parametrize("carried", [0, 4, 16])
def test_set_similarity_in_blocks(spark, monkeypatch, carried):
    """The same pairs, once each, with sets that go along with their tokens and without, in blocks of a few sets."""
    monkeypatch.setattr(pairing, "BLOCK", 8)
    monkeypatch.setattr(pairing, "CARRIED", carried)
    rng = random.Random(5)
    sets = {i: {"http:", f"host{rng.randrange(4)}", rng.choice(("en", "de")), *(f"t{rng.randrange(60)}" for _ in range(rng.randrange(5)))} for i in range(150)}
    pairs, members = pairing.set_similarity(spark.createDataFrame([(i, t) for i, s in sets.items() for t in s], "id long, token string"), 0.6)
    first = {}
    for i, s in sets.items():
        first.setdefault(frozenset(s), i)
    assert {r.id: r.representative for r in members.collect()} == {i: first[frozenset(s)] for i, s in sets.items()}
    own = sorted(first.values())
    want = {(a, b): len(sets[a] & sets[b]) / len(sets[a] | sets[b]) for i, a in enumerate(own) for b in own[i + 1 :]}
    got = [((r.a, r.b), r.similarity) for r in pairs.collect()]
    assert len(got) == len(dict(got)) and dict(got) == {p: s for p, s in want.items() if s >= 0.6} and len(got) > 100


@pytest.mark.parametrize("carried", [0, 3, 16])
def test_set_similarity_of_copies(spark, monkeypatch, carried):
    """All pairs of ids once each, those of equal sets too, with more copies of a set than a block has."""
    monkeypatch.setattr(pairing, "BLOCK", 8)
    monkeypatch.setattr(pairing, "CARRIED", carried)
    rng = random.Random(6)
    kinds = [{"http:", f"host{rng.randrange(3)}", rng.choice(("en", "de")), *(f"t{rng.randrange(30)}" for _ in range(rng.randrange(4)))} for _ in range(40)]
    sets = {i: kinds[0] if i % 4 == 0 else rng.choice(kinds) for i in range(120)}
    pairs, members = pairing.set_similarity(spark.createDataFrame([(i, t) for i, s in sets.items() for t in s], "id long, token string"), 0.6, copies=True)
    want = {(a, b): len(sets[a] & sets[b]) / len(sets[a] | sets[b]) for a in sets for b in sets if a < b}
    got = [((r.a, r.b), r.similarity) for r in pairs.collect()]
    assert len(got) == len(dict(got)) and dict(got) == {p: s for p, s in want.items() if s >= 0.6}
    assert {r.id: r.representative for r in members.collect()} == {i: min(k for k, x in sets.items() if x == s) for i, s in sets.items()}


def test_pages_of_equal_urls_are_pairs(spark, tmp_path):
    """Every two pages at the threshold are a pair, and those whose URLs have the same segments too."""
    urls = ["http://a.org/en/1", "http://a.org/en/1", "http://a.org/en/1/", "http://a.org/en/2", "https://b.org/de/1/x/y", "https://b.org/de/1/y/x", "http://c.org", "", None]
    spark.createDataFrame(list(enumerate(urls)), "page_id long, url string").write.parquet(str(tmp_path / "pages.parquet"))
    sets = {i: set(u.split("/")) - {""} for i, u in enumerate(urls) if u}
    want = {(a, b): round(len(x & y) / len(x | y), 6) for a, x in sets.items() for b, y in sets.items() if a < b and 5 * len(x & y) >= 3 * len(x | y)}
    rows = catalogue.queries()["set_similarity"](spark, str(tmp_path)).collect()
    assert {(r.a, r.b): r.similarity for r in rows if r.id is None} == want and len(want) == 7
    assert {r.id: r.representative for r in rows if r.id is not None} == {0: 0, 1: 0, 2: 0, 3: 3, 4: 4, 5: 4, 6: 6}


def plan_of(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_band_is_not_sent_through_the_driver(spark, sf):
    """Frames that go with many parts of the band are shuffled, not broadcast, however small Spark takes them to be."""
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "100m")
    try:
        assert "Broadcast" not in plan_of(catalogue.queries()["band_distance"](spark, sf))
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")


def test_songs_shuffle_once(spark, sf, monkeypatch):
    """Expected notes need the exchange of the score and one of the tempo for each as-of join; the corpus job writes no
    labels to count them."""
    from takewise.operators import songs
    from takewise.plans import songs as plans

    plan = plan_of(scores.expected_notes(adapters.score(spark, sf), adapters.tempo(spark, sf)))
    assert plan.count("Exchange hashpartitioning") <= 3
    written = []
    keep = songs.cut
    monkeypatch.setattr(songs, "cut", lambda df: written.append(df.columns) or keep(df))
    plans._build(spark, sf)
    assert written and not [c for c in written if "label" in c]


def test_threshold_onsets_of_chunks(spark, sf):
    """Rows and chunks of any length give what a walk gives; in the query no frame is a row before the sort."""
    from takewise.plans import signal

    rng = random.Random(3)
    takes = {t: [(f, rng.choice([0.0, 0.1, 0.149, 0.15, 0.2, 1.0, None])) for f in range(60) if f % 13 != 5] for t in range(6)}
    takes |= {7: [(0, 0.0), (1, 0.0)], 8: [(4, 2.0)], 9: [(0, None), (1, 1.0)], 10: [(0, math.nan), (1, math.nan)]}
    want = []
    for t, rows in takes.items():
        known = [r for _, r in rows if r is not None]
        top = math.nan if any(map(math.isnan, known)) else max(known)
        e = [None if r is None else r / top if top else 0.0 for _, r in rows]
        want += [(t, f) for (f, _), x, b in zip(rows, e, [0.0, *e]) if x is not None and b is not None and not x < 0.15 and b < 0.15]
    rows = [(t, f, r) for t, kept in takes.items() for f, r in kept]
    chunks = []
    for t, f, r in rows:
        if chunks and chunks[-1][0] == t and chunks[-1][1] + len(chunks[-1][2]) == f and rng.random() < 0.8:
            chunks[-1][2].append(r)
        else:
            chunks.append((t, f, [r]))
    chunks.append((0, 99, []))
    got = lambda data, kind: sorted(map(tuple, frames.threshold_onsets(spark.createDataFrame(rng.sample(data, len(data)), f"take_id long, frame long, rms {kind}")).collect()))
    assert got(rows, "double") == got(chunks, "array<double>") == sorted(want) and {8, 10} <= {t for t, _ in want}
    plan = plan_of(signal.threshold_onsets(spark, sf))
    assert plan.count("Generate explode") == 1 and plan.index("Generate explode") < plan.index("Sort [")
