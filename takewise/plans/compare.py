"""The compare job from takes and samples to documents."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.scalars import rounded as R
from ..operators import compare as C
from ..operators import results as O
from ..sources import adapters as A
from ..sources.adapters import sql
from .results import read_documents
from .signal import VERDICT, YIN

QUERIES, SQL = {}, {}


def query(text):
    def add(f):
        QUERIES[f.__name__] = f
        SQL[f.__name__] = text
        return f

    return add


#: Takes of 64 samples a second: pitch frames of 16 by 8, energy frames of 8 by 4.
SETTINGS = C.Settings(chunk=40, rate=64.0, align_length=16, align_hop=8, align_hz=(3.0, 32.0), pitch_length=16, pitch_hop=8, pitch_hz=(8.0, 32.0), rms_length=8, rms_hop=4, onset_gap_sec=0.125)

_scalars = ", ".join(f"('{a}', {r}, {o}, '{k}', '{u}')" for r, (a, items) in enumerate(C.SCALARS.items()) for o, (k, u) in enumerate(items))
_series = ", ".join(f"('{a}', {r}, {len(C.SCALARS[a]) + o}, '{k}', '{u}')" for r, (a, items) in enumerate(C.SERIES.items()) for o, (k, u, _) in enumerate(items))
_FEATURES = f""", us as (select p.* from played p join b on b.pair_id = p.pair_id where rc is null and pc is null),
fr as (select take_id, frame, pcm[frame * 8 + 1 : frame * 8 + 16] as x from (select take_id, pcm, unnest(range(1 + (len(pcm) - 16) // 8)) as frame from us)){YIN},
pk as (
  select *, row_number() over (partition by take_id, frame order by case when d < 0.3 then 0 else 1 end, case when d < 0.3 then tau else d end, tau) as rn from cd),
pit as (
  select take_id, pair_id, side, frame, case when sure >= 0.5 then 1 else 0 end as voiced, case when sure >= 0.5 then f0_hz else 0 end as f0_hz from (
    select us.take_id, pair_id, side, fr.frame, f0_hz, coalesce(least(greatest(1 - d, 0), 1), 0) as sure
    from us join fr using (take_id) left join (select * from pk where rn = 1) p on p.take_id = fr.take_id and p.frame = fr.frame)),
rf as (
  select take_id, pair_id, side, frame, sqrt(list_sum(list_transform(x, lambda v: v * v)) / 8) as level, least(sqrt(list_sum(list_transform(x, lambda v: v * v)) / 8), 1.0) as rms
  from (select take_id, pair_id, side, frame, pcm[frame * 4 + 1 : frame * 4 + 8] as x from (select *, unnest(range(1 + (len(pcm) - 8) // 4)) as frame from us))),
v as (select *, frame - row_number() over (partition by take_id order by frame) as run from pit where voiced = 1),
rn as (
  select take_id, pair_id, side, min(frame) as start_frame, max(frame) + 1 as end_frame, median(f0_hz) as f0_hz from v group by take_id, pair_id, side, run having max(frame) + 1 - min(frame) >= 2),
nt as (select *, row_number() over (partition by take_id order by start_frame) as note_no, start_frame * 8 / 64.0::double as onset_sec from rn),
nf as (select take_id, max(frame) + 1 as n_frames from pit group by take_id),
spans as (select nt.*, coalesce(lead(start_frame) over (partition by take_id order by note_no), n_frames) as span_end from nt join nf using (take_id)),
med as (
  select s.pair_id, s.side, s.note_no, median(log2(f.f0_hz)) as o, median(f.f0_hz) as hz
  from spans s join pit f on f.take_id = s.take_id and f.frame >= s.start_frame and f.frame < s.span_end where f.voiced = 1 and f.f0_hz > 0 group by all),
nd as (
  select coalesce(r.pair_id, p.pair_id) as pair_id, coalesce(r.note_no, p.note_no) as note_no, r.onset_sec as t, 1200 * (pm.o - rm.o) as cents,
    case when pm.o is not null and rm.o is not null then rm.hz end as ref_hz, case when pm.o is not null and rm.o is not null then pm.hz end as prac_hz
  from (select * from spans where side = 'reference') r full join (select * from spans where side = 'practice') p on r.pair_id = p.pair_id and r.note_no = p.note_no
  left join med rm on rm.pair_id = r.pair_id and rm.note_no = r.note_no and rm.side = 'reference'
  left join med pm on pm.pair_id = p.pair_id and pm.note_no = p.note_no and pm.side = 'practice'),
pm as (
  select pair_id, coalesce(median(abs(cents)), 0.0) as median_abs_cents, coalesce(avg(case when cents is null then null when abs(cents) > 50 then 1.0 else 0.0 end), 0.0) as off_pitch_ratio,
    count(cents) as n_notes_used, count(*) - count(cents) as n_unpaired, 64 as sample_rate from nd group by pair_id)
"""
#: Onsets of notes, and of samples where a take has none, matched in step.
_TIMING = """, nv as (
  select take_id, pair_id, side, frame, greatest(coalesce(db - lag(db) over (partition by take_id order by frame), 0), 0) as n
  from (select *, 20.0 * log10(level + 1e-12) as db from rf where take_id not in (select take_id from nt))),
md as (
  select *, median(n) over (w rows between 16 preceding and 16 following) as m, lag(n) over w as p, lead(n) over w as q from nv window w as (partition by take_id order by frame)),
pks as (select take_id, pair_id, side, frame from md where n > 1.5 * m + 0.001 and n >= p and n >= q),
nx as (select a.take_id, a.frame, min(b.frame) as later from pks a join pks b on b.take_id = a.take_id and b.frame >= a.frame + 2 group by all),
kept(take_id, frame) as (select take_id, min(frame) from pks group by take_id union all select k.take_id, nx.later from kept k join nx on nx.take_id = k.take_id and nx.frame = k.frame),
on_ as (
  select pair_id, side, note_no, onset_sec from nt
  union all select pair_id, side, row_number() over (partition by take_id order by frame), frame * 4 / 64.0::double from kept join (select distinct take_id, pair_id, side from rf) using (take_id)),
ro as (select pair_id, onset_sec, row_number() over (partition by pair_id order by onset_sec, note_no) as i from on_ where side = 'reference'),
po as (select pair_id, onset_sec, row_number() over (partition by pair_id order by onset_sec, note_no) as j from on_ where side = 'practice'),
walk(pair_id, i, j, hit, ref_sec, prac_sec) as (
  select pair_id, 1, 1, false, null::double, null::double from (select distinct pair_id from on_)
  union all
  select w.pair_id, case when abs(p.onset_sec - r.onset_sec) <= 0.1 or p.onset_sec > r.onset_sec then w.i + 1 else w.i end,
    case when abs(p.onset_sec - r.onset_sec) <= 0.1 or p.onset_sec <= r.onset_sec then w.j + 1 else w.j end, abs(p.onset_sec - r.onset_sec) <= 0.1, r.onset_sec, p.onset_sec
  from walk w join ro r on r.pair_id = w.pair_id and r.i = w.i join po p on p.pair_id = w.pair_id and p.j = w.j),
hits as (select pair_id, ref_sec, prac_sec, prac_sec - ref_sec as dev from walk where hit),
mid as (select pair_id, median(dev) as m from hits group by pair_id),
tm as (
  select a.pair_id, coalesce(max(m), 0) as median_sec, coalesce(median(abs(dev - m)), 0) as spread_sec, coalesce(avg((dev < -0.023)::int), 0) as early_ratio, coalesce(avg((dev > 0.023)::int), 0) as late_ratio,
    coalesce(avg((abs(dev) <= 0.023)::int), 0) as on_time_ratio, count(dev) as n_notes_used, max(n_all) - 2 * count(dev) as n_unpaired
  from (select pair_id, count(*) as n_all from on_ group by pair_id) a left join hits using (pair_id) left join mid using (pair_id) group by a.pair_id),
es as (select *, coalesce(lead(start_frame) over (partition by take_id order by note_no) * 2, start_frame * 2 + 100) as stop from nt),
en as (
  select s.pair_id, s.side, s.note_no, s.onset_sec as t, median(db) as m, avg(db) as a from es s
  join (select take_id, frame, 20.0 * log10(greatest(rms, 0.0001)) as db from rf) f on f.take_id = s.take_id and f.frame >= s.start_frame * 2 and f.frame < s.stop
  group by all having max(db) > -80),
pe as (
  select pair_id, max(case when side = 'practice' then m end) - max(case when side = 'reference' then m end) as dev, count(*) as sides from en group by pair_id, note_no),
dmid as (select pair_id, median(dev) as m from pe group by pair_id),
dm as (
  select pair_id, coalesce(max(m), 0) as median_db, coalesce(median(abs(dev - m)), 0) as spread_db, count(dev) as n_notes_used, sum(case when dev is null then sides else 0 end) as n_unpaired
  from pe join dmid using (pair_id) group by pair_id)
"""
_long = lambda t, a: " union all ".join(f"select pair_id, '{a}' as algorithm_id, '{k}' as key, cast({k} as double) as value from {t}" for k, _ in C.SCALARS[a])
_RESULT = f""", ran as ({_long("pm", "pitch")} union all {_long("tm", "timing")} union all {_long("dm", "dynamics")}),
sc(algorithm_id, rank, ord, key, unit) as (values {_scalars}), sr(algorithm_id, rank, ord, key, unit) as (values {_series}),
points as (
  select pair_id, 'per_note_cents' as key, note_no::double as o, t, cents as value from nd where cents is not null union all select pair_id, 'per_note_f0_reference', note_no, t, ref_hz from nd where cents is not null
  union all select pair_id, 'per_note_f0_practice', note_no, t, prac_hz from nd where cents is not null union all select pair_id, 'per_note_onset_sec', ref_sec, ref_sec, dev from hits
  union all select pair_id, 'envelope_db_' || side, note_no, t, a from en),
ready as (select b.pair_id, a.algorithm_id, x.pair_id is null as none from b, (select distinct algorithm_id from sc) a left join (select distinct pair_id, algorithm_id from ran) x on x.pair_id = b.pair_id and x.algorithm_id = a.algorithm_id
  where rc is null and pc is null),
told as (select pair_id, string_agg(algorithm_id || ': status=FAILED, error_code=ALGORITHM_FAILED, no result', '; ' order by algorithm_id) filter (where none) as problems from ready group by pair_id)
select b.pair_id, '2' as schema_version, 'take/' || (b.pair_id * 2) as reference_uri, 'take/' || (b.pair_id * 2 + 1) as practice_uri, case when coalesce(rc, pc) is null then 'DATA_READY' else 'FAILED' end as state,
  coalesce(rc, pc, case when problems is not null then 'ALGORITHM_RESULT_INVALID' end) as error_code, problems as error_detail, cast(null as bigint) as place, cast(null as varchar) as key, cast(null as varchar) as label,
  cast(null as varchar) as unit, cast(null as varchar) as timeline_basis, cast(null as bigint) as idx, cast(null as double) as t, cast(null as double) as value from b left join told using (pair_id)
union all select pair_id, null, null, null, null, null, null, row_number() over (partition by pair_id order by rank, ord), algorithm_id || '.' || key, replace(key, '_', ' '), unit, null, null, null, round(value, 6) + 0.0 from ran join sc using (algorithm_id, key)
union all select pair_id, null, null, null, null, null, null, dense_rank() over (partition by pair_id order by rank, ord), algorithm_id || '.' || key, replace(key, '_', ' '), unit, 'REFERENCE',
  row_number() over (partition by pair_id, key order by o) - 1, round(t, 6) + 0.0, round(value, 6) + 0.0 from points join sr using (key)"""


@query(sql("takes played", VERDICT.replace("quiet_samples", "played") + _FEATURES + _TIMING + _RESULT, recursive=True))
def compare_job(spark, d):
    """The job's documents, read again: a row for each pair with its head, one for each scalar and each point."""
    done = C.compare(A.takes(spark, d), A.played_samples(spark, d), SETTINGS)
    rows = read_documents(O.nested_document(done.views, done.scalars, done.series))
    return rows.withColumns({c: R(F.col(c)) for c in ("t", "value")})
