"""Queries over notes and their frames: formulas, pairing, and the metrics of pairs."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from ..config import ENERGY_SPAN_FRAMES
from ..functions import scalars as X
from ..functions.lineage import bucketed
from ..operators import align as L
from ..operators import metrics as G
from ..operators import pairing as J
from ..operators import results as O
from ..sources import adapters as A
from ..sources.adapters import sql

QUERIES, SQL = {}, {}


def query(text):
    def add(f):
        QUERIES[f.__name__] = f
        if text:
            SQL[f.__name__] = text
        return f

    return add


R = X.rounded


@query(sql("notes", """
select event_id, round(case when f0_hz > 0 then 1200 * log2(f0_hz / 440.0) end, 6) + 0.0 as cents from notes"""))  # fmt: skip
def hz_to_cents(spark, d):
    return A.notes(spark, d).select("event_id", R(X.hz_to_cents(F.col("f0_hz"), F.lit(440.0))).alias("cents"))


@query(sql("score", """
select song_id, note_no, round(440.0 * pow(2.0, (midi - 69) / 12.0), 6) as hz,
  round(69.0 + 12.0 * log2(440.0 * pow(2.0, (midi - 69) / 12.0) / 440.0), 6) + 0.0 as midi_back from score"""))  # fmt: skip
def midi_hz(spark, d):
    hz = X.midi_to_hz(F.col("midi"))
    return A.score(spark, d).select("song_id", "note_no", F.round(hz, 6).alias("hz"), R(X.hz_to_midi(hz)).alias("midi_back"))


@query(sql("score", """
select song_id, note_no, ['C','C#','D','D#','E','F','F#','G','G#','A','A#','B'][midi % 12 + 1] || (midi // 12 - 1) as name from score"""))  # fmt: skip
def note_name(spark, d):
    return A.score(spark, d).select("song_id", "note_no", X.note_name(F.col("midi")).alias("name"))


@query(sql("rms_frames", "select take_id, frame, round(20.0 * log10(greatest(rms, 0.0001)), 6) + 0.0 as db from rms_frames"))
def to_db(spark, d):
    return A.rms_frames(spark, d).select("take_id", "frame", R(X.to_db(F.col("rms"))).alias("db"))


@query(sql("pitch_frames", """
select take_id, frame, case when f0_hz > 0 then cast(round_even(69.0 + 12.0 * log2(f0_hz / 440.0), 0) as bigint) % 12 end as pitch_class from pitch_frames"""))  # fmt: skip
def pitch_class(spark, d):
    return A.pitch_frames(spark, d).select("take_id", "frame", X.pitch_class(F.col("f0_hz")).alias("pitch_class"))


@query("select page_id, case when contains(url, '.') then string_split(url, '.')[1] else url end as prefix from pages")
def port_prefix(spark, d):
    return A.table(spark, d, "pages").select("page_id", X.port_prefix(F.col("url")).alias("prefix"))


@query(sql("notes", """,
leaves as (select take_id, note_no // 8 as place, count(*) as n, sha256(string_agg(note_no || ':' || event_id, ',' order by note_no)) as digest from notes group by all),
nodes as (select take_id, place // 8 as place, sum(n) as n, sha256(string_agg(digest, ',' order by place)) as digest from leaves group by take_id, place // 8)
select take_id, sha256('takewise' || '|' || 'notes' || '|' || sum(n) || '|' || string_agg(digest, ',' order by place)) as content_hash
from nodes group by take_id"""))  # fmt: skip
def content_hash(spark, d):
    """Leaves of eight notes, so that takes have several."""
    return O.content_hash(A.notes(spark, d), ["take_id"], "notes", "note_no", ["note_no", "event_id"], 8)


_PAIRED = """, r as (select * from notes where side = 'reference'), p as (select * from notes where side = 'practice'),
both_sides as (
  select coalesce(r.pair_id, p.pair_id) as pair_id, coalesce(r.note_no, p.note_no) as note_no,
    r.event_id as ref_event_id, p.event_id as prac_event_id, r.f0_hz as ref_hz, p.f0_hz as prac_hz
  from r full join p on r.pair_id = p.pair_id and r.note_no = p.note_no),
dev as (
  select pair_id, note_no, case when ref_hz > 0 and prac_hz > 0 then 1200 * log2(prac_hz / ref_hz) end as cents from both_sides)
"""


@query(sql("notes", _PAIRED + "select pair_id, note_no, ref_event_id, prac_event_id from both_sides"))
def pair_by_ordinal(spark, d):
    return J.pair_by_ordinal(A.notes(spark, d), ["event_id"]).select("pair_id", "note_no", "ref_event_id", "prac_event_id")


def shared_tables(spark, d):
    """The notes and frames of all pairs, each written once in buckets by pair, for what runs several metrics on them."""
    notes = bucketed(A.notes(spark, d), "pair_id", ("take_id", "note_no"))
    return {"notes": notes, "pitch": bucketed(A.pitch_frames_of(notes), "pair_id", ("take_id", "frame")), "rms": bucketed(A.rms_frames_of(notes), "pair_id", ("take_id", "frame"))}


def _three_frame_notes(notes):
    """Notes of three frames each over the frame tables, with their spans."""
    last = F.max("note_no").over(W.partitionBy("pair_id", "take_id"))
    n = notes.withColumn("n_frames", last).where("note_no % 3 = 1").withColumn("start_frame", F.col("note_no") - 1)
    n = n.withColumn("note_no", F.floor((F.col("note_no") + 2) / 3))
    return J.note_spans(n, "start_frame", F.col("n_frames"), "pair_id", "take_id")


_SPANS = """, nf as (select take_id, max(note_no) as n_frames from notes group by take_id),
n3 as (
  select n.take_id, n.pair_id, n.side, (n.note_no + 2) // 3 as note_no, n.note_no - 1 as start_frame, n.f0_hz, nf.n_frames
  from notes n join nf using (take_id) where n.note_no % 3 = 1),
spans as (
  select *, coalesce(lead(start_frame) over (partition by take_id order by note_no), n_frames) as span_end from n3),
inside as (
  select s.take_id, s.pair_id, s.side, s.note_no, f.frame, f.voiced, f.f0_hz
  from spans s join pitch_frames f on f.take_id = s.take_id and f.frame >= s.start_frame and f.frame < s.span_end)
"""


@query(sql("notes pitch_frames", _SPANS + "select take_id, note_no, start_frame, span_end from spans"))
def note_spans(spark, d):
    return _three_frame_notes(A.notes(spark, d)).select("take_id", "note_no", "start_frame", "span_end")


@query(sql("notes pitch_frames", _SPANS + "select take_id, note_no, frame, voiced from inside"))
def frames_in_spans(spark, d):
    return J.frames_in_spans(A.pitch_frames(spark, d).select("take_id", "frame", "voiced"), _three_frame_notes(A.notes(spark, d)))


#: Spans of under 2.5 frames count as too short.
LEAST_FRAMES = 2.5
_DEVIATION = _SPANS + f""", base as (select pair_id, note_no, f0_hz as base_hz from spans where side = 'reference'),
med as (
  select i.pair_id, i.side, i.note_no, median(1200 * log2(i.f0_hz / b.base_hz)) as c, median(i.f0_hz) as hz
  from inside i join base b using (pair_id, note_no) join spans s on s.take_id = i.take_id and s.note_no = i.note_no
  where i.voiced = 1 and i.f0_hz > 0 and greatest(1, s.span_end - s.start_frame) >= {LEAST_FRAMES} group by all),
nd as (
  select coalesce(r.pair_id, p.pair_id) as pair_id, coalesce(r.note_no, p.note_no) as note_no, pm.c - rm.c as cents,
    case when pm.c is not null and rm.c is not null then rm.hz end as ref_hz, case when pm.c is not null and rm.c is not null then pm.hz end as prac_hz
  from (select * from spans where side = 'reference') r full join (select * from spans where side = 'practice') p on r.pair_id = p.pair_id and r.note_no = p.note_no
  left join med rm on rm.pair_id = r.pair_id and rm.note_no = r.note_no and rm.side = 'reference'
  left join med pm on pm.pair_id = p.pair_id and pm.note_no = p.note_no and pm.side = 'practice')
"""


def note_deviation(spark, d, tables=None):
    if tables:
        return G.note_deviation(_three_frame_notes(tables["notes"]), tables["pitch"], LEAST_FRAMES)
    return G.note_deviation(_three_frame_notes(A.notes(spark, d)), A.pitch_frames(spark, d), LEAST_FRAMES)


@query(sql("notes pitch_frames", _DEVIATION + "select pair_id, note_no, round(cents, 6) + 0.0 as cents from nd"))
def note_pitch_deviation(spark, d):
    return note_deviation(spark, d).select("pair_id", "note_no", R(F.col("cents")).alias("cents"))


@query(sql("notes pitch_frames", _DEVIATION + """
select pair_id, coalesce(round(median(abs(cents)), 6), 0.0) as median_abs_cents,
  coalesce(round(avg(case when cents is null then null when abs(cents) > 50 then 1.0 else 0.0 end), 6), 0.0) as off_pitch_ratio,
  count(cents) as n_notes_used, count(*) - count(cents) as n_unpaired, 44100 as sample_rate from nd group by pair_id"""))  # fmt: skip
def pitch_metrics(spark, d):
    m = G.pitch_summary(note_deviation(spark, d))
    return m.withColumns({c: R(F.col(c)) for c in ("median_abs_cents", "off_pitch_ratio")})


def _pitch_curves(deviation):
    n = deviation.where("cents is not null")
    place = F.row_number().over(W.partitionBy("pair_id").orderBy("note_no")).cast("bigint")
    return n.select("pair_id", place.alias("place"), F.round("ref_hz", 6).alias("ref_hz"), F.round("prac_hz", 6).alias("prac_hz"), R(F.col("cents")).alias("cents"))


@query(sql("notes pitch_frames", _DEVIATION + """
select pair_id, row_number() over (partition by pair_id order by note_no) as place, round(ref_hz, 6) as ref_hz, round(prac_hz, 6) as prac_hz from nd where cents is not null"""))  # fmt: skip
def note_pitch_curves(spark, d):
    return _pitch_curves(note_deviation(spark, d)).drop("cents")


_ENERGY = f""", spans as (
  select take_id, pair_id, side, note_no, (note_no - 1) * 8 as start_frame,
    coalesce(lead((note_no - 1) * 8) over (partition by take_id order by note_no), (note_no - 1) * 8 + {ENERGY_SPAN_FRAMES}) as span_end from notes),
db as (
  select s.take_id, s.pair_id, s.side, s.note_no, 20.0 * log10(greatest(f.rms, 0.0001)) as db
  from spans s join rms_frames f on f.take_id = s.take_id and f.frame >= s.start_frame and f.frame < s.span_end),
e as (select pair_id, side, note_no, median(db) as m, avg(db) as a from db group by all having max(db) > -80),
pe as (
  select coalesce(r.pair_id, p.pair_id) as pair_id, coalesce(r.note_no, p.note_no) as note_no, r.m as ref_db, p.m as prac_db
  from (select * from e where side = 'reference') r full join (select * from e where side = 'practice') p
    on r.pair_id = p.pair_id and r.note_no = p.note_no)
"""


def _energy(notes, frames):
    notes = notes.withColumn("start_frame", (F.col("note_no") - 1) * 8)
    notes = J.note_spans(notes, "start_frame", F.col("start_frame") + ENERGY_SPAN_FRAMES, "pair_id", "take_id")
    inside = J.frames_in_spans(frames.select("take_id", "frame", "rms", "pair_id", "side"), notes, ["pair_id", "take_id"])
    return G.note_energy(inside, ("pair_id", "side"))


def _energy_pairs(notes, frames):
    return J.pair_by_ordinal(_energy(notes, frames), ["median_db"]).select("pair_id", "note_no", F.col("ref_median_db").alias("ref_db"), F.col("prac_median_db").alias("prac_db"))


@query(sql("notes rms_frames", _ENERGY + "select pair_id, note_no, round(ref_db, 6) + 0.0 as ref_db, round(prac_db, 6) + 0.0 as prac_db from pe"))
def note_energy_pairs(spark, d):
    return _energy_pairs(A.notes(spark, d), A.rms_frames(spark, d)).withColumns({c: R(F.col(c)) for c in ("ref_db", "prac_db")})


@query(sql("notes rms_frames", _ENERGY + """, dv as (select pair_id, prac_db - ref_db as dev, ref_db, prac_db from pe),
md as (select pair_id, median(dev) as m from dv group by pair_id),
sp as (select pair_id, max(m) as m, median(abs(dev - m)) as s from dv join md using (pair_id) where dev is not null group by pair_id)
select pair_id, coalesce(round(max(sp.m), 6) + 0.0, 0.0) as median_db, coalesce(round(max(sp.s), 6), 0.0) as spread_db, count(dev) as n_notes_used,
  cast(sum(case when dev is null then (ref_db is not null)::int + (prac_db is not null)::int else 0 end) as bigint) as n_unpaired
from dv left join sp using (pair_id) group by pair_id"""))  # fmt: skip
def dynamics_metrics(spark, d):
    m = G.dynamics_summary(_energy_pairs(A.notes(spark, d), A.rms_frames(spark, d)))
    return m.withColumns({c: R(F.col(c)) for c in ("median_db", "spread_db")})


@query(sql("notes rms_frames", _ENERGY + "select pair_id, side, note_no, round(a, 6) + 0.0 as mean_db from e"))
def note_energy_envelope(spark, d):
    return _energy(A.notes(spark, d), A.rms_frames(spark, d)).select("pair_id", "side", "note_no", R(F.col("mean_db")).alias("mean_db"))


@query(sql("notes", """, m as (select take_id, median(value) as m from notes group by take_id)
select take_id, round(max(m), 6) as median, round(median(abs(value - m)), 6) as mad from notes join m using (take_id) group by take_id"""))  # fmt: skip
def mad(spark, d):
    return G.mad(A.notes(spark, d), ["take_id"], "value").select("take_id", R(F.col("median")).alias("median"), R(F.col("mad")).alias("mad"))


@query(sql("rms_frames", """
select pair_id, round(avg(rms) filter (where side = 'practice') / nullif(avg(rms) filter (where side = 'reference'), 0), 6) as energy_ratio
from rms_frames group by pair_id"""))  # fmt: skip
def energy_ratio(spark, d):
    return G.energy_ratio(A.rms_frames(spark, d)).withColumn("energy_ratio", R(F.col("energy_ratio")))


#: Pairs whose first reference onset is no number.
_BAD = "pair_id % 17 = 3 and side = 'reference' and note_no = 1"
_MATCH = f""", on_ as (select pair_id, side, note_no, case when {_BAD} then cast('nan' as double) else onset_sec end as onset_sec from notes),
bad as (select distinct pair_id from on_ where isnan(onset_sec)),
r as (select pair_id, onset_sec, note_no, row_number() over (partition by pair_id order by onset_sec, note_no) as i from on_ where side = 'reference' and pair_id not in (select pair_id from bad)),
p as (select pair_id, onset_sec, note_no, row_number() over (partition by pair_id order by onset_sec, note_no) as j from on_ where side = 'practice' and pair_id not in (select pair_id from bad)),
walk(pair_id, i, j, hit, ref_no, prac_no, ref_sec, prac_sec) as (
  select pair_id, 1, 1, false, null::bigint, null::bigint, null::double, null::double from (select distinct pair_id from notes)
  union all
  select w.pair_id, case when abs(p.onset_sec - r.onset_sec) <= 0.1 or p.onset_sec > r.onset_sec then w.i + 1 else w.i end,
    case when abs(p.onset_sec - r.onset_sec) <= 0.1 or p.onset_sec <= r.onset_sec then w.j + 1 else w.j end,
    abs(p.onset_sec - r.onset_sec) <= 0.1, r.note_no, p.note_no, r.onset_sec, p.onset_sec
  from walk w join r on r.pair_id = w.pair_id and r.i = w.i join p on p.pair_id = w.pair_id and p.j = w.j),
hits as (select * from walk where hit)
"""


def _onsets(notes):
    return notes.withColumn("onset_sec", F.when(F.expr(_BAD), float("nan")).otherwise(F.col("onset_sec")))


@query(sql("notes", _MATCH + """
select pair_id, ref_no, prac_no, cast(null as varchar) as error_code from hits
union all select pair_id, note_no, null, null from r where (pair_id, note_no) not in (select (pair_id, ref_no) from hits)
union all select pair_id, null, note_no, null from p where (pair_id, note_no) not in (select (pair_id, prac_no) from hits)
union all select pair_id, null, null, 'ALGORITHM_FAILED' from bad""", recursive=True))  # fmt: skip
def match_onsets(spark, d):
    return J.pair_onsets(_onsets(A.notes(spark, d))).select("pair_id", "ref_no", "prac_no", "error_code")


@query(sql("notes", _MATCH + "select pair_id, ref_no, round(prac_sec - ref_sec, 6) + 0.0 as deviation_sec from hits", recursive=True))
def timing_deviation(spark, d):
    return J.match_onsets(_onsets(A.notes(spark, d))).select("pair_id", "ref_no", R(F.col("prac_sec") - F.col("ref_sec")).alias("deviation_sec"))


@query(sql("notes", _MATCH + """, dv as (select pair_id, prac_sec - ref_sec as dev from hits),
md as (select pair_id, median(dev) as m from dv group by pair_id),
t as (
  select pair_id, max(m) as m, median(abs(dev - m)) as s, avg((dev < -0.023)::int) as e, avg((dev > 0.023)::int) as l,
    avg((abs(dev) <= 0.023)::int) as o, count(*) as n from dv join md using (pair_id) group by pair_id),
a as (select pair_id, count(*) as n_all from notes group by pair_id)
select pair_id, round(coalesce(m, 0), 6) + 0.0 as median_sec, round(coalesce(s, 0), 6) as spread_sec, round(coalesce(e, 0), 6) as early_ratio,
  round(coalesce(l, 0), 6) as late_ratio, round(coalesce(o, 0), 6) as on_time_ratio, coalesce(n, 0) as n_notes_used, n_all - 2 * coalesce(n, 0) as n_unpaired
from a left join t using (pair_id) where pair_id not in (select pair_id from bad)""", recursive=True))  # fmt: skip
def timing_metrics(spark, d):
    found = J.pair_onsets(_onsets(A.notes(spark, d)))
    m = G.timing_summary(found)
    return m.withColumns({c: R(F.col(c)) for c in m.columns if c.endswith(("sec", "ratio"))})


@query(sql("notes", """, s as (
  select pair_id, min(onset_sec) filter (where side = 'reference') as r0, max(onset_sec) filter (where side = 'reference') as r1,
    min(onset_sec) filter (where side = 'practice') as p0, max(onset_sec) filter (where side = 'practice') as p1 from notes group by pair_id)
select pair_id, note_no, round(r0 + (onset_sec - p0) * (r1 - r0) / nullif(p1 - p0, 0), 6) + 0.0 as scaled_sec
from notes join s using (pair_id) where side = 'practice'"""))  # fmt: skip
def linear_rescale(spark, d):
    return L.linear_rescale(A.notes(spark, d)).withColumn("scaled_sec", R(F.col("scaled_sec")))


@query(sql("notes", _PAIRED + """
select pair_id, note_no - 1 as idx, round(ref_hz, 6) as ref_value, round(prac_hz, 6) as prac_value, case when ref_hz > 0 then cast(0 as double) end as ref_cents,
  round(case when ref_hz > 0 and prac_hz > 0 then 1200 * log2(prac_hz / ref_hz) end, 6) + 0.0 as prac_cents from both_sides"""))  # fmt: skip
def comparison_line(spark, d):
    s = A.notes(spark, d).select("pair_id", "side", (F.col("note_no") - 1).alias("idx"), F.col("f0_hz").alias("value"))
    c = J.comparison_line(s, ["pair_id"])
    return c.withColumns({n: R(F.col(n)) for n in ("ref_value", "prac_value", "prac_cents")})
