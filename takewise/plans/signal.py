"""Queries over samples and frames: gates, framing, spectra, pitch, segments and alignment."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.scalars import rounded as R
from ..functions.scalars import to_db
from ..operators import align as L
from ..operators import frames as S
from ..operators import gates as T
from ..sources import adapters as A
from ..sources.adapters import sql

QUERIES, SQL = {}, {}
RATE, LENGTH, HOP = 64.0, 16, 8


def query(text):
    def add(f):
        QUERIES[f.__name__] = f
        if text:
            SQL[f.__name__] = text
        return f

    return add


# gates


@query(sql("samples", """
, v as (select pair_id, unnest(pcm) as x, generate_subscripts(pcm, 1) - 1 as i from samples)
select pair_id, i, round(avg(x), 6) + 0.0 as mono from v group by pair_id, i"""))  # fmt: skip
def downmix(spark, d):
    channels = A.samples(spark, d).select("pair_id", F.col("side").alias("channel"), "pcm")
    return T.downmix(channels, ("pair_id",)).select("pair_id", F.posexplode("pcm").alias("i", "x")).select("pair_id", F.col("i").cast("bigint").alias("i"), R(F.col("x")).alias("mono"))


_DURATION = "case when n_samples / sample_rate < 45 then 'INPUT_TOO_SHORT' when n_samples / sample_rate > 120 then 'INPUT_TOO_LONG' end"


@query(sql("takes", f"select take_id, round(n_samples / sample_rate, 6) as duration_sec, {_DURATION} as error_code from takes"))
def duration_gate(spark, d):
    return T.duration_gate(A.takes(spark, d)).withColumn("duration_sec", F.round("duration_sec", 6))


_LOUD = """, x as (select take_id, unnest(pcm) as v from quiet_samples),
loud as (select take_id, sqrt(sum(v * v) / count(*)) as rms, bool_and(isfinite(v)) as finite from x group by take_id)
"""


@query(sql("takes quiet_samples", _LOUD + """
select take_id, case when not finite then null else round(rms, 9) end as rms, case when coalesce(rms, 0) < 0.0001 then 'INPUT_SILENT' end as error_code from takes left join loud using (take_id)"""))  # fmt: skip
def silence_gate(spark, d):
    g = T.silence_gate(A.takes(spark, d), A.quiet_samples(spark, d))
    return g.withColumn("rms", F.when(~F.isnan("rms") & (F.col("rms") < float("inf")), F.round("rms", 9)))


@query(sql("quiet_samples", _LOUD + "select take_id, case when not finite then 'CORE_BUILD_FAILED' end as error_code from loud"))
def nonfinite_gate(spark, d):
    return T.nonfinite_gate(A.quiet_samples(spark, d))


#: Why either side of a pair cannot be used (rc, pc), in table b.
VERDICT = _LOUD + f""", c as (
  select pair_id, side, coalesce(case when not readable then 'INPUT_UNREADABLE' end, case when sample_rate <> 44100 then 'CORE_BUILD_FAILED' end, {_DURATION},
    case when coalesce(rms, 0) < 0.0001 then 'INPUT_SILENT' end, case when not finite then 'CORE_BUILD_FAILED' end) as code from takes left join loud using (take_id)),
p as (select distinct pair_id from takes),
b as (
  select p.pair_id, case when r.pair_id is null then 'INPUT_UNREADABLE' else r.code end as rc, case when q.pair_id is null then 'INPUT_UNREADABLE' else q.code end as pc
  from p left join c r on r.pair_id = p.pair_id and r.side = 'reference' left join c q on q.pair_id = p.pair_id and q.side = 'practice')
"""


@query(sql("takes quiet_samples", VERDICT + "select pair_id, rc is null and pc is null as usable, coalesce(rc, pc) as first_code from b"))
def ingest_verdict(spark, d):
    return T.ingest_verdict(A.takes(spark, d), A.quiet_samples(spark, d))


# framing


_FR = """, fr as (select take_id, frame, pcm[frame * 8 + 1 : frame * 8 + 16] as x from (
  select take_id, pcm, unnest(range(1 + (len(pcm) - 16) // 8)) as frame from samples))
"""
_HASH = "round(list_sum(list_transform(x, lambda v, i: v * i)), 6) + 0.0"


def _weighted(x="x"):
    """A number that tells arrays apart: places (from 1) times values."""
    return R(F.aggregate(F.transform(x, lambda v, i: v * (i + 1)), F.lit(0.0), lambda a, v: a + v))


@query(sql("samples", _FR + f"select take_id, frame, cast(len(x) as bigint) as n, {_HASH} as content from fr"))
def frames(spark, d):
    return S.frames(A.samples(spark, d), LENGTH, HOP).select("take_id", "frame", F.size("x").cast("bigint").alias("n"), _weighted().alias("content"))


@query(sql("samples", _FR + f"select take_id, frame, cast(len(x) as bigint) as n, {_HASH} as content from fr"))
def frames_of_chunks(spark, d):
    s = A.samples(spark, d).select("take_id", "pcm", F.explode(F.sequence(F.lit(0), F.floor((F.size("pcm") - 1) / 7).cast("int"))).alias("chunk_no"))
    chunks = s.select("take_id", "chunk_no", F.slice("pcm", F.col("chunk_no") * 7 + 1, F.lit(7)).alias("pcm"))
    return S.frames_of_chunks(chunks, 7, LENGTH, HOP).select("take_id", F.col("frame").cast("bigint").alias("frame"), F.size("x").cast("bigint").alias("n"), _weighted().alias("content"))


@query(sql("samples", f""", c as (select take_id, list_concat(list_concat(list_transform(range(8), lambda i: 0.0::double), pcm), list_transform(range(8), lambda i: 0.0::double)) as pcm from samples),
fr as (select take_id, frame, pcm[frame * 8 + 1 : frame * 8 + 16] as x from (select take_id, pcm, unnest(range(1 + (len(pcm) - 16) // 8)) as frame from c))
select take_id, frame, cast(len(x) as bigint) as n, {_HASH} as content from fr"""))  # fmt: skip
def centered_frames(spark, d):
    return S.centered_frames(A.samples(spark, d), LENGTH, HOP).select("take_id", "frame", F.size("x").cast("bigint").alias("n"), _weighted().alias("content"))


@query(sql("samples", """, fr as (select take_id, frame, pcm[frame * 4 + 1 : frame * 4 + 8] as x from (
  select take_id, pcm, unnest(range(1 + (len(pcm) - 8) // 4)) as frame from samples))
select take_id, frame, round(least(sqrt(list_sum(list_transform(x, lambda v: v * v)) / 8), 1.0), 6) as rms from fr"""))  # fmt: skip
def rms_frames(spark, d):
    return S.frame_rms(S.Cut(A.samples(spark, d), 8, 4)).withColumn("rms", F.round("rms", 6))


def _sp(frames: str, name: str, period: int = LENGTH) -> str:
    """SQL of magnitudes by the definition, of a table of frames; the window's period is its length, or one less."""
    part = lambda f: f"pow(sum(v * (0.5 - 0.5 * cos(2 * pi() / {period} * n)) * {f}(2 * pi() / {LENGTH} * ((k * n) % {LENGTH}))), 2)"
    return f""", {name}_x as (select take_id, frame, unnest(x) as v, generate_subscripts(x, 1) - 1 as n from {frames}),
{name} as (select take_id, frame, k, sqrt({part("cos")} + {part("sin")}) as mag from {name}_x, (select unnest(range({LENGTH // 2 + 1})) as k) group by take_id, frame, k)
"""


@query(sql("samples", _FR + _sp("fr", "sp") + "select take_id, frame, k, round(mag, 6) as mag from sp"))
def spectrum_magnitude(spark, d):
    return S.spectrum(S.Cut(A.samples(spark, d), LENGTH, HOP)).withColumn("mag", F.round("mag", 6))


_CENTERED = """, padded as (select take_id, len(pcm) as size, list_concat(list_concat(list_transform(range(8), lambda i: 0.0::double), pcm), list_transform(range(8), lambda i: 0.0::double)) as pcm from samples),
cf as (select take_id, frame, size, pcm[frame * 8 + 1 : frame * 8 + 16] as x from (select take_id, size, pcm, unnest(range(1 + (len(pcm) - 16) // 8)) as frame from padded))
"""


def _binned(df, digits=6):
    b = df.select("take_id", "frame", F.posexplode("bins").alias("bin", "value"))
    return b.select("take_id", "frame", F.col("bin").cast("bigint").alias("bin"), F.round("value", digits).alias("value"))


@query(sql("samples", _CENTERED + ", inside as (select * from cf where frame < (size - 1) // 8)" + _sp("inside", "sp") + """, fo as (
  select take_id, frame, bin, coalesce(sum(mag) filter (where k > 0 and k * 4.0 between 3 and 32 and (cast(round_even(12 * log2(greatest(k, 1) * 4.0 / 27.5), 0) as bigint) % 12 + 12) % 12 = bin), 0) as v
  from sp, (select unnest(range(12)) as bin) group by all)
select take_id, frame, bin, round(case when sum(v * v) over w > 0 then v / sqrt(sum(v * v) over w) else 0 end, 6) as value
from fo window w as (partition by take_id, frame)"""))  # fmt: skip
def align_chroma(spark, d):
    return _binned(S.align_chroma(A.samples(spark, d), RATE, LENGTH, HOP, 3.0, 32.0))


@query(sql("samples", _CENTERED + _sp("cf", "sp") + """, place as (
  select k, case when k = 0 then 12 * log2(4.0 / 27.5) - 18 else 12 * log2(greatest(k, 1) * 4.0 / 27.5) end as q from (select unnest(range(17)) as k)),
spread as (select k, q, greatest(lead(q) over (order by k) - q, 1.0) as s from place),
bump as (
  select k, c, q, exp(-2.0 * pow((q - c + 6 - 12 * floor((q - c + 6) / 12) - 6) / s, 2)) as g from spread, (select unnest(range(12)) as c) where k <= 8),
wt as (
  select k, (c + 9) % 12 as bin, g / sqrt(sum(g * g) over (partition by k)) * exp(-0.5 * pow((q / 12 - 5) / 2, 2)) as w from bump),
fo as (select take_id, frame, bin, sum(mag * mag * w) as v from sp join wt using (k) group by all)
select take_id, frame, bin, round(case when max(v) over w > 0 then v / max(v) over w else 0 end, 6) as value
from fo window w as (partition by take_id, frame)"""))  # fmt: skip
def chroma_frames(spark, d):
    return _binned(S.chroma(A.samples(spark, d), RATE, LENGTH, HOP))


#: Lags 2 to 8: pitches of 8 to 32 Hz at 64 samples a second.
FMIN, FMAX, LOW = 8.0, 32.0, 2
#: Candidates of a pitch (table cd) of the frames in table fr.
YIN = """, raw as (
  select take_id, frame, tau, 2 * (list_sum(list_transform(x, lambda v: v * v)) - list_sum(list_transform(range(1, 17 - tau), lambda i: x[i] * x[i + tau])))
    - case when tau = 1 then 0 else list_sum(list_transform(x[1:tau], lambda v: v * v)) end as raw
  from (select *, unnest(range(1, 9)) as tau from fr)),
dd as (select take_id, frame, tau, raw / (sum(raw) over (partition by take_id, frame order by tau rows between unbounded preceding and current row) / tau + 2.2250738585072014e-308) as d from raw),
df as (select * from dd where tau >= 2),
nb as (select *, lag(d) over w as b, lead(d) over w as a from df window w as (partition by take_id, frame order by tau)),
cd as (
  select take_id, frame, tau, d, 64.0 / (tau + case when a is null or abs((a - b) / 2) >= abs(a + b - 2 * d) then 0 else -((a - b) / 2) / (a + b - 2 * d) end) as f0_hz
  from nb where d < b and (a is null or d <= a))
"""


def _yin(spark, d):
    return S.yin_difference(S.Cut(A.samples(spark, d), LENGTH, HOP), LENGTH, RATE, FMIN, FMAX)


@query(sql("samples", _FR + YIN + "select take_id, frame, tau, round(d, 6) + 0.0 as d from df"))
def yin_difference(spark, d):
    rows = _yin(spark, d).select("take_id", "frame", F.posexplode("d").alias("i", "d"))
    return rows.select("take_id", "frame", (F.col("i") + LOW).cast("bigint").alias("tau"), R(F.col("d")).alias("d"))


@query(sql("samples", _FR + YIN + "select take_id, frame, tau, round(d, 6) as d, round(f0_hz, 6) as f0_hz from cd"))
def yin_candidates(spark, d):
    return S.yin_candidates(_yin(spark, d), LOW, RATE).withColumns({"d": F.round("d", 6), "f0_hz": F.round("f0_hz", 6)})


@query(sql("samples", _FR + YIN + """, pk as (
  select *, row_number() over (partition by take_id, frame order by case when d < 0.3 then 0 else 1 end, case when d < 0.3 then tau else d end, tau) as rn from cd)
select fr.take_id, fr.frame, round(case when coalesce(least(greatest(1 - d, 0), 1), 0) >= 0.5 then f0_hz else 0 end, 6) as f0_hz,
  round(coalesce(least(greatest(1 - d, 0), 1), 0), 6) as confidence
from fr left join (select * from pk where rn = 1) p using (take_id, frame)"""))  # fmt: skip
def yin_f0(spark, d):
    return S.yin_f0(_yin(spark, d), LOW, RATE).withColumns({"f0_hz": F.round("f0_hz", 6), "confidence": F.round("confidence", 6)})


@query(sql("pitch_frames", """
select take_id, frame, case when confidence >= 0.5 then 1 else 0 end as voiced, round(case when confidence >= 0.5 then f0_hz else 0 end, 6) as f0_hz,
  round(least(greatest(confidence, 0), 1), 6) as confidence from pitch_frames"""))  # fmt: skip
def voicing(spark, d):
    return S.voicing(A.pitch_frames(spark, d)).select("take_id", "frame", "voiced", F.round("f0_hz", 6).alias("f0_hz"), F.round("confidence", 6).alias("confidence"))


@query(sql("samples", _FR + _sp("fr", "sp", LENGTH - 1) + """, pr as (
  select a.take_id, a.frame, a.k, round(sum(ln(greatest(b.mag, 1e-12))), 6) as p
  from sp a, (select unnest([1, 2, 3]) as h) h, sp b
  where a.k between 1 and 2 and b.take_id = a.take_id and b.frame = a.frame and b.k = a.k * h group by all)
select take_id, frame, k, cast(k * 4 as double) as f0_hz from (select *, row_number() over (partition by take_id, frame order by p desc, k) as rn from pr) where rn = 1"""))  # fmt: skip
def hps_f0(spark, d):
    return S.hps_f0(S.Cut(A.samples(spark, d), LENGTH, HOP), LENGTH, RATE, 3, 3.0, 9.0, least=LENGTH)


@query(sql("pitch_frames rms_frames", """, v as (
  select *, frame - row_number() over (partition by take_id order by frame) as run from pitch_frames where voiced = 1),
rn as (
  select take_id, min(frame) as start_frame, max(frame) + 1 as end_frame, median(f0_hz) as f0_hz from v group by take_id, run having max(frame) + 1 - min(frame) >= 4),
nt as (select *, row_number() over (partition by take_id order by start_frame) as note_no from rn)
select n.take_id, n.note_no, start_frame, end_frame, round(start_frame * cast(0.05 as double), 6) as onset_sec, round(any_value(n.f0_hz), 6) as f0_hz, round(median(r.rms), 9) as rms
from nt n join rms_frames r on r.take_id = n.take_id and r.frame >= n.start_frame * 8 and r.frame < n.end_frame * 8
group by n.take_id, n.note_no, start_frame, end_frame"""))  # fmt: skip
def note_segments(spark, d):
    s = S.note_segments(A.pitch_frames(spark, d), A.rms_frames(spark, d), 8, 1, 160.0, 0.2)
    return s.withColumns({"onset_sec": F.round("onset_sec", 6), "f0_hz": F.round("f0_hz", 6), "rms": F.round("rms", 9)})


@query(sql("rms_frames", """, lv as (select take_id, frame, round(20.0 * log10(greatest(rms, 0.0001)), 6) as db from rms_frames),
nv as (select take_id, frame, greatest(coalesce(db - lag(db) over (partition by take_id order by frame), 0), 0) as n from lv),
md as (
  select *, median(n) over (w rows between 6 preceding and 6 following) as m, lag(n) over w as p, lead(n) over w as q from nv window w as (partition by take_id order by frame)),
pk as (select take_id, frame from md where n > 1.5 * m + 0.001 and n >= p and n >= q),
nx as (select a.take_id, a.frame, min(b.frame) as later from pk a join pk b on b.take_id = a.take_id and b.frame >= a.frame + 12 group by all),
kept as (select take_id, min(frame) as frame from pk group by take_id union all select k.take_id, nx.later from kept k join nx on nx.take_id = k.take_id and nx.frame = k.frame)
select take_id, frame from kept""", recursive=True))  # fmt: skip
def pcm_onsets(spark, d):
    r = A.rms_frames(spark, d).select("take_id", "frame", F.round(to_db(F.col("rms")), 6).alias("db"))
    return S.novelty_onsets(r, 6, 12)


@query(sql("samples", """, fr as (select take_id, frame, pcm[frame * 4 + 1 : frame * 4 + 8] as x from (select take_id, pcm, unnest(range(1 + (len(pcm) - 8) // 4)) as frame from samples)),
lv as (select take_id, frame, 20.0 * log10(sqrt(list_sum(list_transform(x, lambda v: v * v)) / 8) + 1e-12) as db from fr),
nv as (select take_id, frame, greatest(coalesce(db - lag(db) over (partition by take_id order by frame), 0), 0) as n from lv),
md as (
  select *, median(n) over (w rows between 4 preceding and 4 following) as m, lag(n) over w as p, lead(n) over w as q from nv window w as (partition by take_id order by frame)),
pk as (select take_id, frame from md where n > 1.5 * m + 0.001 and n >= p and n >= q),
nx as (select a.take_id, a.frame, min(b.frame) as later from pk a join pk b on b.take_id = a.take_id and b.frame >= a.frame + 2 group by all),
kept as (select take_id, min(frame) as frame from pk group by take_id union all select k.take_id, nx.later from kept k join nx on nx.take_id = k.take_id and nx.frame = k.frame)
select take_id, frame, frame * 4 / 64.0::double as onset_sec from kept""", recursive=True))  # fmt: skip
def sample_onsets(spark, d):
    """Onsets from samples, with a median of a quarter of a second and peaks an eighth apart."""
    return S.onsets(A.samples(spark, d), RATE, 8, 4, 0.25, 0.125)


@query(sql("rms_frames", """, e as (select take_id, frame, rms / nullif(max(rms) over (partition by take_id), 0) as e from rms_frames),
w as (select *, lag(e, 1, 0.0) over (partition by take_id order by frame) as b from e)
select take_id, frame from w where e >= 0.15 and b < 0.15"""))  # fmt: skip
def threshold_onsets(spark, d):
    return S.threshold_onsets(A.rms_chunks(spark, d))


_WINDOWS = """, up as (select take_id, count(*) * 2048 / 44100.0 as upper from pitch_frames group by take_id),
win as (
  select take_id * 10 + k as window_id, take_id, k, case k when 0 then 0.5 when 1 then 1.0 when 2 then -1.0 else 0.25 end as t0,
    case k when 0 then 1.5 when 1 then 1.0 when 2 then 2.0 when 3 then cast('nan' as double) when 4 then upper + 0.001 else upper end as t1, upper from up, (select unnest(range(6)) as k))
"""


@query(sql("pitch_frames", _WINDOWS + """
select window_id, take_id, case k when 1 then 'EMPTY_WINDOW' when 2 then 'NEGATIVE_START' when 3 then 'NOT_A_NUMBER' else 'BEYOND_END' end as error_code, cast(null as bigint) as frame, cast(null as double) as f0_hz
from win where k between 1 and 4
union all select window_id, w.take_id, null, frame, round(f0_hz, 6) from win w join pitch_frames p on p.take_id = w.take_id and frame >= floor(t0 * 44100 / 2048) and frame < floor(t1 * 44100 / 2048) where k in (0, 5)"""))  # fmt: skip
def time_slice(spark, d):
    p = A.pitch_frames(spark, d).select("take_id", "frame", "f0_hz")
    up = p.groupBy("take_id").agg((F.count("*") * 2048 / F.lit(44100.0)).alias("upper"))
    w = up.select("take_id", "upper", F.explode(F.sequence(F.lit(0), F.lit(5))).alias("k"))
    t0 = F.when(F.col("k") == 0, 0.5).when(F.col("k") == 1, 1.0).when(F.col("k") == 2, -1.0).otherwise(0.25)
    t1 = F.when(F.col("k") == 0, 1.5).when(F.col("k") == 1, 1.0).when(F.col("k") == 2, 2.0).when(F.col("k") == 3, float("nan")).when(F.col("k") == 4, F.col("upper") + 0.001).otherwise(F.col("upper"))
    w = w.select((F.col("take_id") * 10 + F.col("k")).alias("window_id"), "take_id", t0.alias("t0"), t1.alias("t1"), "upper")
    return S.time_slices(p, w, 44100.0, 2048).select("window_id", "take_id", "error_code", "frame", F.round("f0_hz", 6).alias("f0_hz"))


@query(sql("notes paths", """, w as (select pair_id, k, k * 10.0 as t0, k * 10.0 + 15.0 as t1 from (select distinct pair_id from notes), (select unnest(range(3)) as k))
select w.pair_id * 10 + k as window_id, 'note' as kind, take_id, note_no as place from w join notes n on n.pair_id = w.pair_id and onset_sec >= t0 and onset_sec < t1
union all select w.pair_id * 10 + k, 'path', null, step from w join paths p on p.pair_id = w.pair_id and reference_frame * (2048 / 44100.0::double) >= t0 / 10 and reference_frame * (2048 / 44100.0::double) < t1 / 10"""))  # fmt: skip
def time_slice_seconds(spark, d):
    """Windows of notes by their onset, and of path points by the time of their reference frame."""
    n = A.notes(spark, d).select("take_id", "pair_id", "note_no", "onset_sec")
    each = F.explode(F.sequence(F.lit(0), F.lit(2))).alias("k")
    w = n.select("take_id", "pair_id").distinct().select("*", each).select((F.col("pair_id") * 10 + F.col("k")).alias("window_id"), "take_id", (F.col("k") * 10.0).alias("t0"), (F.col("k") * 10.0 + 15).alias("t1"), F.lit(1e6).alias("upper"))
    notes = S.time_slices(n.drop("pair_id"), w, column="onset_sec", in_seconds=True)
    p = A.paths(spark, d).select(F.col("pair_id").alias("take_id"), "step", "reference_frame")
    v = p.select("take_id").distinct().select("*", each).select((F.col("take_id") * 10 + F.col("k")).alias("window_id"), "take_id", F.col("k").cast("double").alias("t0"), (F.col("k") + 1.5).alias("t1"), F.lit(1e6).alias("upper"))
    points = S.time_slices(p, v, 44100.0, 2048, "reference_frame", in_seconds=True)
    notes = notes.select("window_id", F.lit("note").alias("kind"), "take_id", F.col("note_no").alias("place"))
    return notes.unionByName(points.select("window_id", F.lit("path").alias("kind"), F.lit(None).cast("bigint").alias("take_id"), F.col("step").alias("place")))


# alignment


_SIZES = """, sz as (
  select pair_id, count(*) filter (where side = 'reference') as n_ref, count(*) filter (where side = 'practice') as n_prac from pitch_frames group by pair_id)
"""


def _sizes(spark, d):
    return A.pitch_frames(spark, d).groupBy("pair_id").agg(F.count(F.when(F.col("side") == "reference", 1)).alias("n_ref"), F.count(F.when(F.col("side") == "practice", 1)).alias("n_prac"))


def _side(spark, d, name):
    return A.pitch_frames(spark, d).where(F.col("side") == name).select("pair_id", "frame", F.array("f0_hz", F.col("confidence") * 100).alias("features"), F.col("f0_hz").alias("value"))


@query(sql("pitch_frames", _SIZES + """
select r.pair_id, r.frame as i, p.frame as j, round(sqrt(pow(r.f0_hz - p.f0_hz, 2) + pow(r.confidence * 100 - p.confidence * 100, 2)), 6) as distance
from pitch_frames r join sz using (pair_id) join pitch_frames p on p.pair_id = r.pair_id and p.side = 'practice' and abs(r.frame / n_ref - p.frame / n_prac) <= 0.25
where r.side = 'reference'"""))  # fmt: skip
def band_distance(spark, d):
    b = L.band_distance(_side(spark, d, "reference"), _side(spark, d, "practice"), _sizes(spark, d))
    return b.withColumn("distance", R(F.col("distance")))


@query(sql("pitch_frames", """, xs as (
  select pair_id, list(f0_hz order by frame) as x, list(confidence * 100 order by frame) as u, count(*) as n from pitch_frames where side = 'reference' group by pair_id),
ys as (select pair_id, list(f0_hz order by frame) as y, list(confidence * 100 order by frame) as w, count(*) as m from pitch_frames where side = 'practice' group by pair_id),
xy as (select * from xs join ys using (pair_id)),
walk(pair_id, s, c1, c2) as (
  select pair_id, cast(0 as bigint), list_transform(range(n), lambda i: case when i = 0 then sqrt(pow(x[1] - y[1], 2) + pow(u[1] - w[1], 2)) end), list_transform(range(n), lambda i: cast(null as double)) from xy
  union all
  select pair_id, s + 1, list_transform(range(n), lambda i: case when s + 1 - i between 0 and m - 1 and abs(i * m - (s + 1 - i) * n) <= 0.25 * n * m + 1e-6
    then sqrt(pow(x[i + 1] - y[s + 2 - i], 2) + pow(u[i + 1] - w[s + 2 - i], 2)) + least(case when i > 0 then c2[i] end, case when i > 0 then c1[i] end, c1[i + 1]) end), c1
  from walk join xy using (pair_id) where s < n + m - 2)
select pair_id, round(c1[n], 4) as cost, true as complete from walk join xy using (pair_id) where s = n + m - 2""", recursive=True))  # fmt: skip
def warp_path(spark, d):
    ref, prac = (_side(spark, d, s).select("pair_id", "frame", "features") for s in ("reference", "practice"))
    path = L.warp_path(ref, prac)
    ends = path.groupBy("pair_id").agg((F.max("reference_frame") + F.max("practice_frame")).alias("end"), (F.min("reference_frame") + F.min("practice_frame")).alias("start"))
    sizes = _sizes(spark, d).where("n_ref > 0 and n_prac > 0")
    cost = L.path_cost(path, ref, prac).join(ends, "pair_id").join(sizes, "pair_id")
    return cost.select("pair_id", F.round("cost", 4).alias("cost"), ((F.col("start") == 0) & (F.col("end") == F.col("n_ref") + F.col("n_prac") - 2)).alias("complete"))


@query(sql("paths pitch_frames", _SIZES + """, b as (
  select *, reference_frame < lag(reference_frame) over (partition by pair_id order by step) as back from paths),
c as (select pair_id, not coalesce(bool_or(back), false) as monotone, count(distinct reference_frame) as n from b group by pair_id)
select pair_id, coalesce(monotone, true) as monotone, round(coalesce(n, 0) / sz.n_ref, 6) as coverage,
  case when not coalesce(monotone, true) or coalesce(n, 0) / sz.n_ref < 0.9 then 'ALIGNMENT_UNRECOVERABLE' end as error_code
from sz left join c using (pair_id)"""))  # fmt: skip
def path_checks(spark, d):
    return L.path_checks(A.paths(spark, d), _sizes(spark, d)).withColumn("coverage", F.round("coverage", 6))


@query(sql("paths", """, m as (
  select pair_id, avg(abs(practice_frame - reference_frame) * 0.05) as w, max_by(practice_frame, step) - min_by(practice_frame, step) as p,
    max_by(reference_frame, step) - min_by(reference_frame, step) as r from paths group by pair_id)
select pair_id, round(w, 6) as mean_abs_warp_sec, round(nullif(p, 0) / nullif(r, 0), 6) as tempo_ratio from m"""))  # fmt: skip
def path_metrics(spark, d):
    return L.path_metrics(A.paths(spark, d), 0.05).withColumns({c: R(F.col(c)) for c in ("mean_abs_warp_sec", "tempo_ratio")})


@query(sql("paths", """, f as (
  select *, coalesce(reference_frame < lag(reference_frame) over w, false) as rf, coalesce(practice_frame < lag(practice_frame) over w, false) as pf
  from paths window w as (partition by pair_id order by step))
select pair_id, count(*) as n_rows, round(avg((reference_frame <> practice_frame)::int), 6) as non_identity_ratio, not bool_or(rf) as reference_monotone,
  not bool_or(pf) as practice_monotone, max_by(reference_frame, step) as end_reference, max_by(practice_frame, step) as end_practice from f group by pair_id"""))  # fmt: skip
def path_summary(spark, d):
    return L.path_summary(A.paths(spark, d)).withColumn("non_identity_ratio", R(F.col("non_identity_ratio")))


@query(sql("paths pitch_frames", """, p as (select * from pitch_frames where side = 'practice'),
f as (select pair_id, reference_frame as frame, min(practice_frame) as p from paths group by all),
l as (select pair_id, max(frame) as last from p group by pair_id)
select f.pair_id, f.frame, round(p.f0_hz, 6) as value from f join l using (pair_id) join p on p.pair_id = f.pair_id and p.frame = greatest(0, least(f.p, last))"""))  # fmt: skip
def warp_reindex(spark, d):
    return L.warp_reindex(A.paths(spark, d), _side(spark, d, "practice").drop("features"), ["value"]).withColumn("value", F.round("value", 6))


@query(sql("samples", """, pa as (
  select pair_id, i as reference_frame, case when pair_id % 7 = 3 and i = 5 then 8 else least(7, i * (1 + pair_id % 3) // 2) end as practice_frame from (select distinct pair_id, unnest(range(6)) as i from samples)),
n as (select pair_id, max(case when side = 'reference' then 60 end) as n_ref, max(case when side = 'practice' then len(pcm) end) as n_prac from samples group by pair_id),
f as (select pair_id, n_ref, unnest(range((n_ref - 1) // 8 + 1)) as frame from n where pair_id % 7 <> 3 and n_prac > 0)
select f.pair_id, f.frame, cast(least(8, n_ref - frame * 8) as bigint) as n, round(s.pcm[pa.practice_frame * 8 + 1], 6) + 0.0 as value, cast(null as varchar) as error_code
from f join pa on pa.pair_id = f.pair_id and pa.reference_frame = least(f.frame, 5) join samples s on s.pair_id = f.pair_id and s.side = 'practice'
union all select pair_id, null, null, null, 'CORE_BUILD_FAILED' from n where n_ref > 0 and (pair_id % 7 = 3 or n_prac is null)"""))  # fmt: skip
def warped_port(spark, d):
    """Practice samples on the reference's axis, by paths of their own, some beyond the practice's end."""
    s = A.samples(spark, d)
    n = s.groupBy("pair_id").agg(F.max(F.when(F.col("side") == "reference", 60)).alias("n_ref"), F.coalesce(F.max(F.when(F.col("side") == "practice", F.size("pcm"))), F.lit(0)).alias("n_prac"))
    p = s.select("pair_id").distinct().select("pair_id", F.explode(F.sequence(F.lit(0).cast("bigint"), F.lit(5).cast("bigint"))).alias("reference_frame"))
    frame = F.expr("case when pair_id % 7 = 3 and reference_frame = 5 then 8 else least(7, reference_frame * (1 + pair_id % 3) div 2) end")
    parts = F.array(F.slice("pcm", 1, 40), F.slice("pcm", 41, 40))
    chunks = s.where("side = 'practice'").select("pair_id", F.posexplode(parts).alias("chunk_no", "pcm"))
    w = L.warped_samples(p.withColumn("practice_frame", frame), chunks, n, 40, 8)
    size = F.when(F.col("pcm").isNotNull(), F.size("pcm")).cast("bigint")
    return w.select("pair_id", "frame", size.alias("n"), R(F.get("pcm", F.lit(0))).alias("value"), "error_code")
