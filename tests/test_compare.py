"""The compare job at real sizes: planted differences come out in the documents, what fails is a row."""

import json
import math

import numpy as np
import pyarrow as pa
import pyarrow.parquet as pq
import pytest

from takewise.operators import compare, results

RATE = 44100
CHUNK = 1 << 16


def played(seconds, notes, stretch=1.0, cents=0.0, late=0.0, gain=1.0):
    """Tones with six harmonics of notes (start, length, hz), the rest silence."""
    x = np.zeros(int(seconds * RATE))
    for start, length, hz in notes:
        at, n = int((start * stretch + late) * RATE), int(length * RATE)
        t = np.arange(n) / RATE
        tone = sum(np.sin(2 * np.pi * hz * 2 ** (cents / 1200) * h * t) / h for h in range(1, 7))
        x[at : at + n] += gain * 0.2 * tone * np.minimum(1, np.minimum(t, t[::-1]) * 50)
    return x


@pytest.fixture(scope="module")
def compared(spark, tmp_path_factory):
    folder = tmp_path_factory.mktemp("takes")
    tune = [(1 + 4 * k, 3.0, hz) for k, hz in enumerate((261.63, 392.0, 523.25, 587.33, 440.0, 329.63, 493.88, 349.23, 293.66, 261.63))]
    base = played(46, tune)
    sounds = {
        0: base, 1: base,  # the same
        2: base, 3: played(46, tune, cents=100 * math.log2(1.06) * 12),
        4: base, 5: played(46, tune, late=0.09, gain=0.5),
        6: base, 7: base[: 44 * RATE],  # too short
        8: base, 9: np.zeros(46 * RATE),  # silent
        10: base,
    }
    rows = [(i, k, x[k * CHUNK : (k + 1) * CHUNK].astype(np.float32)) for i, x in sounds.items() for k in range(-(-len(x) // CHUNK))]
    pq.write_table(pa.table({"take_id": [r[0] for r in rows], "chunk_no": [r[1] for r in rows], "pcm": pa.array([r[2] for r in rows])}), folder / "samples.parquet", row_group_size=8)
    takes = [(i, i // 2, "practice" if i % 2 else "reference", True, RATE, len(x), f"{i}.wav") for i, x in sounds.items()]
    takes.append((11, 5, "practice", False, RATE, 0, "11.wav"))
    table = spark.createDataFrame(takes, "take_id long, pair_id long, side string, readable boolean, sample_rate int, n_samples long, uri string")
    done = compare.compare(table, spark.read.parquet(str(folder / "samples.parquet")), compare.Settings(chunk=CHUNK))
    documents = {r.pair_id: json.loads(r.document) for r in results.nested_document(done.views, done.scalars, done.series).collect()}
    return done, documents, len(tune)


def test_documents(compared):
    _, documents, n = compared
    value = lambda p, key: next(s["value"] for s in documents[p]["scalars"] if s["key"] == key)
    errors = {p: d.get("error_code") for p, d in documents.items()}
    assert errors == {0: None, 1: None, 2: None, 3: "INPUT_TOO_SHORT", 4: "INPUT_SILENT", 5: "INPUT_UNREADABLE"}
    assert all(documents[p]["scalars"] == documents[p]["series"] == [] for p in (3, 4, 5))
    for p in (0, 1, 2):
        assert value(p, "pitch.n_notes_used") == value(p, "timing.n_notes_used") == value(p, "dynamics.n_notes_used") == n
        assert {s["key"]: s["n_points"] for s in documents[p]["series"]} == {f"{a}.{k}": n for a, items in compare.SERIES.items() for k, _, _ in items}
    assert value(0, "pitch.median_abs_cents") == value(0, "timing.median_sec") == value(0, "dynamics.median_db") == 0.0
    assert value(1, "pitch.median_abs_cents") == pytest.approx(1200 * math.log2(1.06), abs=1) and value(1, "pitch.off_pitch_ratio") == 1.0
    assert value(2, "pitch.median_abs_cents") < 1 and value(2, "timing.late_ratio") == 1.0 and value(2, "timing.median_sec") == pytest.approx(0.09, abs=2048 / RATE)
    assert value(2, "dynamics.median_db") == pytest.approx(-6.02, abs=0.3) and value(1, "dynamics.median_db") == pytest.approx(0, abs=0.3)
    hz = next(s for s in documents[1]["series"] if s["key"] == "pitch.per_note_f0_practice")
    assert hz["values"][4] == pytest.approx(440 * 1.06, rel=0.002) and hz["t"][4] == pytest.approx(17, abs=2048 / RATE)


def test_paths_and_report(compared):
    done, _, _ = compared
    assert {r.pair_id for r in done.path.select("pair_id").distinct().collect()} == {0, 1, 2}
    same = done.path.where("pair_id = 0 and reference_frame <> practice_frame").count()
    assert same == 0
    lines = {(r.pair_id, r.line_no): r.line for r in results.report_lines(done.views, done.scalars, done.series).collect()}
    assert lines[3, 1] == "reference 6.wav, practice 7.wav" and lines[3, 2] == "state FAILED" and lines[3, 3].startswith("error INPUT_TOO_SHORT")
    assert lines[1, 3].startswith("median abs cents = 10") and lines[1, 3].endswith(" cents")
