"""Defaults of the operators' parameters."""

# Fixed values that results depend on.
SAMPLE_RATE = 44100
DURATION_SEC = (45.0, 120.0)
ALIGN_HOP = 2048
ALIGN_BAND = 0.25
FRAME = 2048
PITCH_HOP = 2048
RMS_HOP = 256
ONSET_FRAME = 1024
ONSET_FLOOR = 1e-12
FMIN_HZ = 130.81
FMAX_HZ = 2093.0
SILENCE_RMS = 1e-4
MIN_COVERAGE = 0.90
MIN_NOTE_SEC = 0.150
VOICED_FLOOR = 0.5
OFF_PITCH_CENTS = 50.0
MATCH_TOLERANCE_SEC = 0.100
DEAD_BAND_SEC = 0.023
DB_FLOOR = -80.0
BUDGET_BYTES = 512 * 1024 * 1024
SERIES_POINTS = 2000
ENERGY_SPAN_FRAMES = 100
ANCHOR_TOLERANCE = 0.02
UNITS = ("amplitude", "chroma", "hz", "index", "rms", "cents", "seconds", "db", "ratio", "count")
NOTE_NAMES = ("C", "C#", "D", "D#", "E", "F", "F#", "G", "G#", "A", "A#", "B")
STATUSES = ("OK", "DEGRADED", "INCOMPATIBLE", "FAILED")
BASES = ("REFERENCE", "WARPED")
ERRORS_OF_STATUS = {"INCOMPATIBLE": ("PLUGIN_INCOMPATIBLE",), "FAILED": ("ALGORITHM_FAILED", "ALGORITHM_TIMEOUT", "ALGORITHM_RESULT_INVALID")}
REQUIRED_PORTS = ("pcm.mapped.reference", "pcm.mapped.practice")
FIELD_LAYOUTS = {
    "warp_path": ("reference_frame", "practice_frame"),
    "pitch": ("f0_hz", "voiced", "confidence"),
    "notes": ("onset_sec", "f0_hz", "rms"),
    "chroma": NOTE_NAMES,
}

# Fixed values of the score tables.
BEAT_TICKS = 480
PREFERRED_MIDI = (60, 84)
ALLOWED_MIDI = (55, 88)
SONG_SEC = (45.0, 120.0)
PREFERRED_SEC = (60.0, 90.0)
LEAD_SEC = 0.4
TAIL_SEC = 0.4
MOST_REPEATS = 16
QC_PASS = 0.90
