"""Queries over score tables."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from ..functions.scalars import rounded as R
from ..operators import catalogue as C
from ..operators import scores as M
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


@query(sql("note_events", """,
n as (select song_id, midi, tick as st_tick, velocity, row_number() over (partition by song_id, midi order by tick, note_no) as k from note_events where is_on = 1),
f as (select song_id, midi, tick as en_tick, row_number() over (partition by song_id, midi order by tick, note_no) as k from note_events where is_on = 0)
select song_id, midi, st_tick, en_tick, velocity from n join f using (song_id, midi, k) where en_tick > st_tick"""))  # fmt: skip
def note_events_to_notes(spark, d):
    return M.notes_of_events(A.note_events(spark, d))


#: Seconds are ticks times microseconds a beat, whole numbers, over 480 million.
TEMPO = """, sg as (
  select *, lead(tick) over w as next_tick, coalesce((tick - lag(tick) over w) * lag(us_per_beat) over w, 0) as took
  from tempo window w as (partition by song_id order by tick)),
seg as (select *, cast(sum(took) over (partition by song_id order by tick rows between unbounded preceding and current row) as bigint) as passed from sg)
"""
AT = lambda tick, g: f"({g}.passed + ({tick} - {g}.tick) * {g}.us_per_beat) / 480000000.0::double"


@query(sql("score tempo", TEMPO + """
select s.song_id, s.note_no, round(""" + AT("s.st_tick", "g") + """, 6) + 0.0 as onset_sec
from score s join seg g on g.song_id = s.song_id and (s.st_tick >= g.tick or g.tick = 0) and (s.st_tick < g.next_tick or g.next_tick is null)"""))  # fmt: skip
def tick_to_sec(spark, d):
    return M.tick_to_sec(A.score(spark, d), A.tempo(spark, d), "st_tick", "sec").select("song_id", "note_no", R(F.col("sec")).alias("onset_sec"))


@query(sql("score tempo", TEMPO + """, q as (select song_id, note_no, note_no * 0.037::double as at from score)
select q.song_id, q.note_no, g.tick + cast(ceil(round((q.at * 480000000.0::double - g.passed) / g.us_per_beat, 6)) as bigint) as tick
from q join (select *, lead(passed) over (partition by song_id order by passed) as next_passed from seg) g
  on g.song_id = q.song_id and q.at * 480000000.0::double >= g.passed and (q.at * 480000000.0::double < g.next_passed or g.next_passed is null)"""))  # fmt: skip
def sec_to_tick(spark, d):
    q = A.score(spark, d).select("song_id", "note_no", (F.col("note_no") * F.lit(0.037)).alias("at"))
    return M.sec_to_tick(q, A.tempo(spark, d), "at", "tick").select("song_id", "note_no", "tick")


_POLY = """, ev as (select song_id, st_tick as tick, 1 as step from score where en_tick > st_tick union all select song_id, en_tick, -1 from score where en_tick > st_tick),
st as (select song_id, tick, sum(step) as step from ev group by all),
rn as (
  select song_id, sum(step) over (partition by song_id order by tick rows between unbounded preceding and current row) as voices,
    lead(tick) over (partition by song_id order by tick) - tick as long from st),
po as (
  select song_id, cast(max(voices) as bigint) as max_voices,
    round(sum(case when voices > 1 then long else 0 end) / sum(long), 6) as poly_ratio from rn group by song_id)
"""


@query(sql("score", _POLY + "select song_id, max_voices, poly_ratio from po"))
def polyphony(spark, d):
    return M.polyphony(A.score(spark, d)).withColumn("poly_ratio", R(F.col("poly_ratio")))


@query(sql("score", _POLY + """
select song_id, count(*) as n_notes, min(midi) as min_midi, max(midi) as max_midi, any_value(max_voices) as max_voices, any_value(poly_ratio) as poly_ratio
from score left join po using (song_id) group by song_id"""))  # fmt: skip
def track_profile(spark, d):
    return M.track_profile(A.score(spark, d)).withColumn("poly_ratio", R(F.col("poly_ratio")))


#: Every note of a song, its pitch moved and its range widened by the song's number: ranges that fit either way or not.
_MOVED = "midi + song_id % 50 - 25 + case when note_no % 2 = 0 then song_id % 13 else 0 end"


@query(sql("score", f""", r as (select song_id, min({_MOVED}) as a, max({_MOVED}) as b from score group by song_id),
c as (
  select song_id, s, a + s >= 60 and b + s <= 84 as best, a + s >= 55 and b + s <= 88 as fits from r, (select unnest(range(-128, 129)) as s)),
k as (select song_id, s, best, row_number() over (partition by song_id order by case when best then 0 else 1 end, abs(s)) as rn from c where best or fits)
select r.song_id, coalesce(k.s, 0) as shift, case when k.best then 60 else 55 end as low, case when k.best then 84 else 88 end as high from r left join k on k.song_id = r.song_id and rn = 1"""))  # fmt: skip
def transpose_shift(spark, d):
    return M.transpose_shift(A.score(spark, d).withColumn("midi", F.expr(_MOVED)))


@query(sql("score", """
select song_id, note_no, st_tick - 3840 as st_tick, least(en_tick, 7680) - 3840 as en_tick from score where st_tick >= 3840 and st_tick < 7680"""))  # fmt: skip
def bar_crop(spark, d):
    return M.bar_crop(A.score(spark, d), 2, 2, 1920).select("song_id", "note_no", "st_tick", "en_tick")


@query("""
with t as (select s_suppkey as song_id, 3.0::double + (s_suppkey * 7) % 140 as sec from supplier),
c as (
  select song_id, k, case when k * sec + 0.8::double between 60 and 90 then 0 else round(least(abs(k * sec + 0.8::double - 60), abs(k * sec + 0.8::double - 90)), 6) end as away
  from t, (select unnest(range(1, 17)) as k) where k * sec + 0.8::double between 45 and 120)
select song_id, sec, (select k from c where c.song_id = t.song_id order by away, k limit 1) as repeats from t""")  # fmt: skip
def decide_repeats(spark, d):
    t = A.table(spark, d, "supplier").select(F.col("s_suppkey").alias("song_id"), (F.lit(3.0) + F.expr("(s_suppkey * 7) % 140")).alias("sec"))
    return M.decide_repeats(t)


@query(sql("score", """
select song_id, note_no, copy, st_tick + copy * 12000 as st_tick, en_tick + copy * 12000 as en_tick from score, (select unnest(range(3)) as copy)"""))  # fmt: skip
def repeat_notes(spark, d):
    return M.repeat_notes(A.score(spark, d), 3, 12000).select("song_id", "note_no", "copy", "st_tick", "en_tick")


JOINED = lambda tick, g: f"join seg {g} on {g}.song_id = s.song_id and (s.{tick} >= {g}.tick or {g}.tick = 0) and (s.{tick} < {g}.next_tick or {g}.next_tick is null)"
NOTE_NAME = "['C','C#','D','D#','E','F','F#','G','G#','A','A#','B'][midi % 12 + 1] || (midi // 12 - 1)"
UP4 = lambda x: f"floor({x} * 10000.0::double + 0.5::double) / 10000.0::double"


@query(sql("score tempo", TEMPO + f""", p as (
  select s.*, {AT("s.st_tick", "a")} as on_sec, {AT("s.en_tick", "b")} as off_sec from score s {JOINED("st_tick", "a")} {JOINED("en_tick", "b")})
select song_id, row_number() over (partition by song_id order by st_tick, note_no) - 1 as ordinal, {UP4("on_sec")} as onset_sec, {UP4("off_sec")} as end_sec, {UP4("(off_sec - on_sec)")} as duration_sec, midi,
  ['C','C#','D','D#','E','F','F#','G','G#','A','A#','B'][midi % 12 + 1] || (midi // 12 - 1) as name, round(440.0 * pow(2.0, (midi - 69) / 12.0), 6) as hz, velocity from p"""))  # fmt: skip
def expected_notes(spark, d):
    return M.expected_notes(A.score(spark, d), A.tempo(spark, d))


@query(sql("score", """, o as (select song_id, st_tick, midi, note_no, row_number() over (partition by song_id order by st_tick, midi, en_tick, note_no) as r from score),
w as (
  select song_id, r, st_tick as anchor, midi, note_no from o where r = 1
  union all
  select o.song_id, o.r, case when o.st_tick - w.anchor <= 6 then w.anchor else o.st_tick end,
    case when o.st_tick - w.anchor <= 6 and o.midi <= w.midi then w.midi else o.midi end, case when o.st_tick - w.anchor <= 6 and o.midi <= w.midi then w.note_no else o.note_no end
  from w join o on o.song_id = w.song_id and o.r = w.r + 1)
select song_id, anchor, midi, note_no from (select *, row_number() over (partition by song_id, anchor order by r desc) as k from w) where k = 1""", recursive=True))  # fmt: skip
def top_voice(spark, d):
    return M.top_voice(A.score(spark, d), 6)


_MONO = """, mo as (
  select song_id, note_no, midi, st_tick, least(en_tick, coalesce(lead(st_tick) over (partition by song_id order by st_tick, midi desc, note_no), en_tick)) as en_tick from score)
"""


@query(sql("score", _MONO + "select song_id, note_no, st_tick, en_tick from mo where en_tick > st_tick"))
def enforce_mono(spark, d):
    return M.enforce_mono(A.score(spark, d)).select("song_id", "note_no", "st_tick", "en_tick")


@query(sql("notes", """
, r as (select take_id, note_no, f0_hz from notes where note_no <= 20), q as (select take_id, note_no, f0_hz from notes where note_no > 20)
select take_id, note_no, (select r.note_no from r where r.take_id = q.take_id order by round(abs(r.f0_hz - q.f0_hz), 6), r.note_no limit 1) as nearest from q"""))  # fmt: skip
def nearest_row(spark, d):
    n = A.notes(spark, d).select("take_id", "note_no", "f0_hz")
    return M.nearest_row(n.where("note_no > 20"), n.where("note_no <= 20"), "take_id", "f0_hz", "note_no").select("take_id", "note_no", "nearest")


@query("""
with n as (select p_partkey, case when p_partkey % 3 = 0 then p_name else (p_partkey * 37 % 1000) || '_' || p_name end as name from part)
select p_partkey, name, row_number() over (order by case when regexp_matches(name, '^[0-9]+_') then 0 else 1 end,
  cast(nullif(regexp_extract(name, '^([0-9]+)_', 1), '') as bigint), name, p_partkey) as place from n""")  # fmt: skip
def natural_order(spark, d):
    n = A.table(spark, d, "part").select("p_partkey", F.expr("case when p_partkey % 3 = 0 then p_name else concat(p_partkey * 37 % 1000, '_', p_name) end").alias("name"))
    return C.natural_order(n, "name", "p_partkey")


@query(sql("score", """, t as (select song_id % 10 as book, song_id as track, note_no, midi, st_tick, en_tick from score),
b as (select book, floor(min(st_tick) / 1920.0) * 1920 as t0, floor(max(en_tick) / 1920.0) * 1920 as t1 from t group by book),
r as (select book, min(midi) as lo, max(midi) as hi from t group by book),
sh as (
  select book, case when hi - lo <= 24 then case when lo < 60 then 60 - lo when hi > 84 then 84 - hi else 0 end when hi - lo <= 33 then case when lo < 55 then 55 - lo when hi > 88 then 88 - hi else 0 end else 0 end as shift from r)
select book, track, note_no, midi + shift as midi, cast(st_tick - t0 as bigint) as st_tick, cast(en_tick - t0 as bigint) as en_tick from t join b using (book) join sh using (book) where st_tick >= t0 and en_tick <= t1"""))  # fmt: skip
def merge_tracks(spark, d):
    t = A.score(spark, d).select(F.pmod("song_id", F.lit(10)).alias("book"), F.col("song_id").alias("track"), "note_no", "midi", "st_tick", "en_tick").withColumnRenamed("book", "song_id")
    bounds = M.bar_bounds(t, 1920)
    last = t.groupBy("song_id").agg((F.floor(F.max("en_tick") / 1920) * 1920).alias("t1"))  # the last whole bar
    bounds = bounds.drop("t1").join(last, "song_id")
    return M.merge_tracks(t, M.transpose_shift(t), bounds).withColumnRenamed("song_id", "book")


# planted defects: hashes and folds as SQL

U = lambda tag: f"(cast('0x' || substr(md5('7:{tag}:' || song_id || ':' || note_no), 1, 13) as bigint) / 4503599627370496.0::double)"
BETWEEN = lambda tag, low, high: f"({low}::double + {U(tag)} * ({high}::double - {low}::double))"
_FIRST = ", ft as (select song_id, arg_min(us_per_beat, tick) as us from tempo group by song_id)\n"


@query(sql("score", f"""
select song_id, note_no, midi, floor(case when {U("far")} < 0.85 then {BETWEEN("size", 45.0, 115.0)} * case when {U("sign")} < 0.68 then 1 else -1 end else {BETWEEN("near", -25.0, 25.0)} end * 10.0::double + 0.5::double) / 10.0::double as planted_cents
from score"""))  # fmt: skip
def perturb_pitch(spark, d):
    return M.perturb_pitch(A.score(spark, d), 7).select("song_id", "note_no", "midi", "planted_cents")


@query(sql("score tempo", TEMPO + f""", pp as (
  select song_id, note_no, midi, st_tick, floor(case when {U("far")} < 0.85 then {BETWEEN("size", 45.0, 115.0)} * case when {U("sign")} < 0.68 then 1 else -1 end else {BETWEEN("near", -25.0, 25.0)} end * 10.0::double + 0.5::double) / 10.0::double as v from score)
select s.song_id, 'off_pitch' as variant, s.note_no, {UP4(AT("s.st_tick", "a"))} as onset_sec, s.midi, 'planted_cents' as label, v as value from pp s {JOINED("st_tick", "a")}"""))  # fmt: skip
def defect_labels(spark, d):
    return M.defect_labels(M.perturb_pitch(A.score(spark, d), 7), A.tempo(spark, d), "off_pitch", ["planted_cents"])


@query(sql("score", f""", f as (
  select song_id, note_no, velocity, case when {U("faint")} < 0.1 then {BETWEEN("faint size", 0.12, 0.25)} else {BETWEEN("size", 0.3, 1.35)} end as f from score)
select song_id, note_no, floor(f * 1000.0::double + 0.5::double) / 1000.0::double as factor, cast(least(greatest(round_even(velocity * f, 0), 3), 127) as bigint) as velocity from f"""))  # fmt: skip
def perturb_dynamics(spark, d):
    return M.perturb_dynamics(A.score(spark, d), 7).select("song_id", "note_no", "factor", "velocity")


@query(sql("score tempo", _FIRST + f""", e as (
  select s.song_id, note_no, midi, (en_tick - st_tick) * us / 480000000.0::double >= 0.05 as fit, {U("wrong").replace("song_id", "s.song_id")} as u, cast(floor({U("step").replace("song_id", "s.song_id")} * 6) as bigint) - 3 as st from score s join ft using (song_id)),
k as (select *, row_number() over (partition by song_id, fit order by u, note_no) as rn, count(*) over (partition by song_id, fit) as n from e),
w as (select *, case when fit and rn <= greatest(1, round_even(n * 0.15::double, 0)) then case when st >= 0 then st + 1 else st end else 0 end as planted_semitones from k)
select song_id, note_no, planted_semitones, case when planted_semitones <> 0 then least(greatest(midi + planted_semitones, 21), 108) else midi end as midi from w"""))  # fmt: skip
def perturb_wrong_notes(spark, d):
    return M.perturb_wrong_notes(A.score(spark, d), A.tempo(spark, d), 7, least_sec=0.05).select("song_id", "note_no", "planted_semitones", "midi")


@query(sql("score", f""", r as (
  select song_id, note_no, greatest(1, cast(floor({U("long")} * 4) as bigint)) as run from score where {U("drop")} < 0.12),
nx as (select a.song_id, a.note_no, min(b.note_no) as later from r a join r b on b.song_id = a.song_id and b.note_no >= a.note_no + a.run group by all),
kept as (select song_id, min(note_no) as note_no from r group by song_id union all select k.song_id, nx.later from kept k join nx on nx.song_id = k.song_id and nx.note_no = k.note_no),
gone as (select song_id, note_no + unnest(range(run)) as note_no from kept join r using (song_id, note_no))
select s.song_id, s.note_no, g.note_no is not null as dropped from score s left join gone g on g.song_id = s.song_id and g.note_no = s.note_no""", recursive=True))  # fmt: skip
def perturb_dropouts(spark, d):
    return M.perturb_dropouts(A.score(spark, d), 7).select("song_id", "note_no", "dropped")


def _legato(spark, d):
    """Each song's melody without gaps: a note ends where the next one starts."""
    mono = M.enforce_mono(A.score(spark, d))
    return mono.withColumn("en_tick", F.coalesce(F.lead("st_tick").over(W.partitionBy("song_id").orderBy("st_tick", F.desc("midi"), "note_no")), F.col("en_tick")))


@query(sql("score tempo", _MONO + _FIRST + f""", lg as (
  select song_id, note_no, st_tick, coalesce(lead(st_tick) over (partition by song_id order by st_tick, midi desc, note_no), en_tick) as en_tick from mo where en_tick > st_tick),
q as (
  select *, en_tick - st_tick as long, row_number() over w as i, min(st_tick) over (partition by song_id) as first, max(en_tick) over (partition by song_id) as last, lag(en_tick - st_tick) over w as before
  from lg join ft using (song_id) window w as (partition by song_id order by st_tick, note_no)),
h as (
  select *, ({U("timing")} * 2 - 1) * least(0.09::double, 0.3::double * (least(before, long) * us / 480000000.0::double)) - 0.055::double * (st_tick - first) / greatest(1, last - first) as wish,
    cast(greatest(floor(0.25::double * long), round_even(0.02::double * 480000000.0::double / us, 0)) as bigint) as keep from q),
m as (select *, cast(ceil(round(abs(wish) * 480000000.0::double / us, 6)) * sign(wish) as bigint) as push from h),
f as (
  select song_id, i, st_tick as new_start, keep from m where i = 1
  union all
  select m.song_id, m.i, case when m.en_tick - m.keep < f.new_start + f.keep then m.st_tick else least(greatest(m.st_tick + m.push, f.new_start + f.keep), m.en_tick - m.keep) end, m.keep
  from f join m on m.song_id = f.song_id and m.i = f.i + 1)
select f.song_id, m.note_no, f.new_start, coalesce(lead(f.new_start) over (partition by f.song_id order by f.i), m.last) as new_end from f join m using (song_id, i)""", recursive=True))  # fmt: skip
def perturb_timing(spark, d):
    return M.perturb_timing(_legato(spark, d), A.tempo(spark, d), 7)


# checks of planted defects against frames

#: Notes of three frames of 0.1 s; a frame has the pitch of its note's first frame, off by up to 60 cents, or an octave.
_QC = """, g as (
  select take_id, frame, voiced, first_value(f0_hz) over (partition by take_id, frame // 3 order by frame) as base, count(*) over (partition by take_id) as n_frames from pitch_frames),
fr as (
  select take_id, frame, voiced, base * pow(2.0, ((frame // 3 % 7 - 3) * 20 + case when frame // 3 % 11 = 5 then 1200 else 0 end + frame % 3) / 1200.0) as f0_hz, base, n_frames from g),
nt as (
  select take_id, frame // 3 as note_no, frame * 0.1::double as onset_sec, (least(n_frames, frame + 3) - frame) * 0.1::double as duration_sec, cast(round_even(69 + 12 * log2(greatest(base, 1.0) / 440.0), 0) as bigint) as midi
  from fr where frame % 3 = 0)
"""
_PART = lambda low, high: f"""(select nt.take_id, nt.note_no, 69 + 12 * log2(median(f.f0_hz) / 440.0) as estimate from nt join fr f on f.take_id = nt.take_id
    and f.frame >= ceil(round((onset_sec + duration_sec * {low}::double) / 0.1::double, 6)) and f.frame <= floor(round((onset_sec + duration_sec * {high}::double) / 0.1::double, 6))
    where f.voiced = 1 and f.f0_hz > 0 group by nt.take_id, nt.note_no)"""  # noqa: E731


def _qc(spark, d):
    w = W.partitionBy("take_id", "third").orderBy("frame")
    f = A.pitch_frames(spark, d).select("take_id", "frame", "voiced", "f0_hz").withColumn("third", F.floor(F.col("frame") / 3))
    f = f.withColumn("base", F.first("f0_hz").over(w)).withColumn("n_frames", F.count("*").over(W.partitionBy("take_id")))
    cents = (F.col("third") % 7 - 3) * 20 + F.when(F.col("third") % 11 == 5, 1200).otherwise(0) + F.col("frame") % 3
    f = f.withColumn("f0_hz", F.col("base") * F.pow(F.lit(2.0), cents / F.lit(1200.0)))
    long_ = (F.least("n_frames", F.col("frame") + 3) - F.col("frame")) * F.lit(0.1)
    midi = F.rint(F.lit(69) + F.lit(12) * F.log2(F.greatest("base", F.lit(1.0)) / 440.0)).cast("bigint")
    n = f.where("frame % 3 = 0").select("take_id", F.col("third").alias("note_no"), (F.col("frame") * F.lit(0.1)).alias("onset_sec"), long_.alias("duration_sec"), midi.alias("midi"))
    return n, f.select("take_id", "frame", "voiced", "f0_hz")


@query(sql("pitch_frames", _QC + f""", c as (
  select nt.take_id, round(abs((estimate - midi) * 100), 6) as off from nt left join {_PART(0.2, 0.8)} e using (take_id, note_no) where duration_sec >= 0.15)
select take_id, count(*) as n_stable, count(off) as n_detected, count(*) filter (where off < 50) as n_within, round(count(*) filter (where off < 50) / count(*), 6) as pass_rate,
  round(median(off), 4) as median_abs_cents, count(*) filter (where abs(off - 1200) < 50) as n_octave, count(*) filter (where off < 50) / count(*) >= 0.9 as passed from c group by take_id"""))  # fmt: skip
def pitch_qc(spark, d):
    q = M.pitch_qc(*_qc(spark, d), 0.1)
    return q.withColumns({"pass_rate": F.round("pass_rate", 6), "median_abs_cents": F.round("median_abs_cents", 4)})


@query(sql("pitch_frames", _QC + f""", m as (
  select nt.take_id, abs((estimate - midi) * 100 - (note_no % 7 - 3) * 20) as gap from nt join {_PART(0.3, 0.8)} e using (take_id, note_no) where duration_sec >= 0.15)
select take_id, count(*) as n, round(median(gap), 4) as median_abs_error, round(max(gap), 4) as max_abs_error from m group by take_id"""))  # fmt: skip
def label_recovery(spark, d):
    n, f = _qc(spark, d)
    labels = n.select("take_id", "note_no", ((F.col("note_no") % 7 - 3) * 20).cast("double").alias("planted_cents"))
    r = M.label_recovery(labels, n, f, 0.1)
    return r.withColumns({c: F.round(c, 4) for c in ("median_abs_error", "max_abs_error")})


@query(sql("pitch_frames", _QC + f""", m as (
  select nt.take_id, estimate, midi + case when note_no % 11 = 5 then 12 else note_no % 3 end as played from nt left join {_PART(0.3, 0.8)} e using (take_id, note_no) where note_no % 4 = 1)
select take_id, count(*) as n_labels, count(*) filter (where round(abs((estimate - played) * 100), 6) < 50) as n_hits from m group by take_id"""))  # fmt: skip
def wrong_note_hits(spark, d):
    n, f = _qc(spark, d)
    played = F.col("midi") + F.when(F.col("note_no") % 11 == 5, 12).otherwise(F.col("note_no") % 3)
    return M.wrong_note_hits(n.where("note_no % 4 = 1").select("take_id", "note_no", played.alias("played_midi")), n, f, 0.1)
