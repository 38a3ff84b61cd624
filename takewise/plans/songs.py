"""The corpus job over the score's note events."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..config import LEAD_SEC, TAIL_SEC
from ..functions.scalars import rounded as R
from ..operators import scores as M
from ..operators import songs as C
from ..sources import adapters as A
from ..sources.adapters import sql
from .scores import BETWEEN, NOTE_NAME, TEMPO, AT, JOINED, U, UP4

QUERIES, SQL = {}, {}


def query(text):
    def add(f):
        QUERIES[f.__name__] = f
        SQL[f.__name__] = text
        return f

    return add


#: Some songs without events, some sixteen times as long, and every other one with chords.
_NONE, _SLOW, _MODE = "song_id % 10 = 7", "case when song_id % 10 = 3 then 16 else 1 end", "case when song_id % 2 = 0 then 'topvoice' else 'asis' end"


def _tables(spark, d):
    events = A.note_events(spark, d).where(f"not ({_NONE})").withColumn("tick", F.expr(f"tick * {_SLOW}"))
    songs = A.table(spark, d, "supplier").select(F.col("s_suppkey").alias("song_id")).withColumn("mode", F.expr(_MODE))
    return events, A.tempo(spark, d), songs


def _build(spark, d):
    return C.build(*_tables(spark, d))


_MELODY = TEMPO + f""", ev as (select song_id, midi, tick * {_SLOW} as tick, is_on, note_no, velocity from note_events where not ({_NONE})),
on_ as (select song_id, midi, tick as st_tick, velocity, row_number() over (partition by song_id, midi order by tick, note_no) as k from ev where is_on = 1),
off_ as (select song_id, midi, tick as en_tick, row_number() over (partition by song_id, midi order by tick, note_no) as k from ev where is_on = 0),
sc as materialized (
  select *, row_number() over (partition by song_id order by st_tick, midi, en_tick, velocity) as note_no
  from (select song_id, midi, st_tick, en_tick, velocity from on_ join off_ using (song_id, midi, k) where en_tick > st_tick)),
o as materialized (select *, row_number() over (partition by song_id order by st_tick, midi, en_tick, note_no) as r from sc where song_id % 2 = 0),
w as (
  select song_id, r, st_tick as anchor, midi, note_no from o where r = 1
  union all
  select o.song_id, o.r, case when o.st_tick - w.anchor <= 6 then w.anchor else o.st_tick end,
    case when o.st_tick - w.anchor <= 6 and o.midi <= w.midi then w.midi else o.midi end, case when o.st_tick - w.anchor <= 6 and o.midi <= w.midi then w.note_no else o.note_no end
  from w join o on o.song_id = w.song_id and o.r = w.r + 1),
top as (select song_id, anchor, note_no from (select *, row_number() over (partition by song_id, anchor order by r desc) as k from w) where k = 1),
vo as (
  select song_id, note_no, anchor as st_tick, en_tick, midi, velocity from sc join top using (song_id, note_no)
  union all select song_id, note_no, st_tick, en_tick, midi, velocity from sc where song_id % 2 <> 0),
mn as (
  select song_id, midi, velocity, st_tick, least(en_tick, coalesce(lead(st_tick) over (partition by song_id order by st_tick, midi desc, note_no), en_tick)) as en_tick from vo),
bo as (select song_id, cast(floor(min(st_tick) / 1920.0) * 1920 as bigint) as t0, cast(ceil(max(en_tick) / 1920.0) * 1920 as bigint) as t1, min(midi) as lo, max(midi) as hi from mn where en_tick > st_tick group by song_id),
sz as (
  select song_id, t0, t1 - t0 as st_tick, case when hi - lo <= 24 then case when lo < 60 then 60 - lo when hi > 84 then 84 - hi else 0 end
    when hi - lo <= 33 then case when lo < 55 then 55 - lo when hi > 88 then 88 - hi else 0 end else 0 end as shift from bo),
ln as (select s.*, {AT("s.st_tick", "g")} as sec from sz s {JOINED("st_tick", "g")}),
ca as (
  select song_id, k, case when k * sec + {LEAD_SEC + TAIL_SEC}::double between 60 and 90 then 0 else round(least(abs(k * sec + {LEAD_SEC + TAIL_SEC}::double - 60), abs(k * sec + {LEAD_SEC + TAIL_SEC}::double - 90)), 6) end as away
  from ln, (select unnest(range(1, 17)) as k) where k * sec + {LEAD_SEC + TAIL_SEC}::double between 45 and 120),
pl as (
  select ln.song_id, t0, ln.st_tick as seg, shift, sec, repeats, g.tick + cast(ceil(round(({LEAD_SEC}::double * 480000000.0::double - g.passed) / g.us_per_beat, 6)) as bigint) as lead_ticks
  from ln left join (select song_id, arg_min(k, (away, k)) as repeats from ca group by song_id) using (song_id)
  join (select *, lead(passed) over (partition by song_id order by passed) as next_passed from seg) g on g.song_id = ln.song_id
    and {LEAD_SEC}::double * 480000000.0::double >= g.passed and ({LEAD_SEC}::double * 480000000.0::double < g.next_passed or g.next_passed is null)),
fin as materialized (
  select *, row_number() over (partition by song_id order by st_tick, midi, en_tick, velocity) as note_no from (
    select song_id, st_tick - t0 + c * seg + lead_ticks as st_tick, en_tick - t0 + c * seg + lead_ticks as en_tick, midi + shift as midi, velocity
    from mn join pl using (song_id), (select unnest(range(16)) as c) where en_tick > st_tick and c < repeats)),
ex as (
  select s.*, {AT("s.st_tick", "a")} as on_sec, {AT("s.en_tick", "b")} as off_sec from fin s {JOINED("st_tick", "a")} {JOINED("en_tick", "b")})
"""


@query(sql("note_events tempo", _MELODY + f"""
select song_id, row_number() over (partition by song_id order by st_tick, note_no) - 1 as ordinal, {UP4("on_sec")} as onset_sec, {UP4("off_sec")} as end_sec, {UP4("(off_sec - on_sec)")} as duration_sec, midi,
  {NOTE_NAME} as name, round(440.0 * pow(2.0, (midi - 69) / 12.0), 6) as hz, velocity from ex""", recursive=True))  # fmt: skip
def song_notes(spark, d):
    """The expected notes of all songs that can be used."""
    tables = _tables(spark, d)
    return M.expected_notes(C.standards(*tables).melody, tables[1])


@query(sql("note_events tempo", _MELODY + f""", ft as (select song_id, arg_min(us_per_beat, tick) as us from tempo group by song_id),
fit as (select song_id, count(*) as n from fin join ft using (song_id) where (en_tick - st_tick) * us / 480000000.0::double >= 0.15 group by song_id),
dr as materialized (select song_id, note_no, greatest(1, cast(floor({U("long")} * 4) as bigint)) as run from fin where {U("drop")} < 0.12),
nx as materialized (select a.song_id, a.note_no, min(b.note_no) as later from dr a join dr b on b.song_id = a.song_id and b.note_no >= a.note_no + a.run group by all),
kept as (select song_id, min(note_no) as note_no from dr group by song_id union all select k.song_id, nx.later from kept k join nx on nx.song_id = k.song_id and nx.note_no = k.note_no),
gone as (select song_id, count(*) as n from (select song_id, note_no + unnest(range(run)) as note_no from kept join dr using (song_id, note_no)) join fin using (song_id, note_no) group by song_id),
su as (select song_id, count(*) as n_notes, min(midi) as lo, max(midi) as hi, max(off_sec) as end_sec from ex group by song_id)
select s.s_suppkey as song_id, case when s.s_suppkey % 2 = 0 then 'topvoice' else 'asis' end as mode, case when pl.song_id is null then 'NO_NOTES' when repeats is null then 'SONG_LENGTH' end as error_code,
  coalesce(n_notes, 0) as n_notes, {NOTE_NAME.replace("midi", "lo")} as lowest, {NOTE_NAME.replace("midi", "hi")} as highest, round(60e6 / us, 6) as bpm, case when repeats is not null then shift end as shift, repeats, round(sec, 6) as seg_sec,
  round(end_sec + {TAIL_SEC}::double, 6) as duration_sec, coalesce(n_notes, 0) as n_pitch, coalesce(n_notes, 0) as n_dynamics,
  case when fit.n is null then 0 else cast(greatest(1, round_even(fit.n * 0.15::double, 0)) as bigint) end as n_wrong_notes, coalesce(gone.n, 0) as n_dropouts
from supplier s left join pl on pl.song_id = s.s_suppkey left join ft on ft.song_id = s.s_suppkey left join su on su.song_id = s.s_suppkey
left join fit on fit.song_id = s.s_suppkey left join gone on gone.song_id = s.s_suppkey""", recursive=True))  # fmt: skip
def song_corpus(spark, d):
    """The summary of all songs, with the number of labels of each planted defect (but timing's, which perturb_timing
    checks note by note); what cannot be used has its error."""
    return _build(spark, d).summary.drop("n_timing").withColumns({c: R(F.col(c)) for c in ("bpm", "seg_sec", "duration_sec")})
