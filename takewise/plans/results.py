"""Queries over results: ports, envelopes, checks, runs, series, reports and set operations."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from ..config import NOTE_NAMES
from ..functions.scalars import rounded as R
from ..operators import checks as K
from ..operators import metrics as G
from ..operators import pairing as J
from ..operators import results as O
from ..operators.checks import Requirement
from ..sources import adapters as A
from ..sources.adapters import sql
from . import notes as N

QUERIES, SQL = {}, {}


def query(text):
    def add(f):
        QUERIES[f.__name__] = f
        if text:
            SQL[f.__name__] = text
        return f

    return add


# ports

#: The ports of a pair: name, element type, dimensions, fields, units, timeline, hop and sample rate.
_CHROMA = ",".join(NOTE_NAMES)
PORTS = [("warp_path", "int32", "warp_point,axis", "reference_frame,practice_frame", "index", "REFERENCE", 0, 0), ("pcm.warped.practice", "float32", "sample", "", "amplitude", "WARPED", 0, 44100)]
for _side in ("reference", "practice"):
    PORTS += [
        (f"pcm.mapped.{_side}", "float32", "sample", "", "amplitude", "REFERENCE", 0, 44100), (f"pitch.{_side}", "float32", "frame,field", "f0_hz,voiced,confidence", "hz", "REFERENCE", 2048, 44100),
        (f"rms.{_side}", "float32", "frame", "", "rms", "REFERENCE", 256, 44100), (f"chroma.lowres.{_side}", "float32", "frame,bin", _CHROMA, "chroma", "REFERENCE", 2048, 0),
        (f"notes.{_side}", "float32", "note,field", "onset_sec,f0_hz,rms", "index", "REFERENCE", 0, 0),
    ]
_PORT_COLUMNS = "port_id, element_type, dims, fields, units, timeline_basis, hop_length, sample_rate"

#: What is wrong with some pairs' ports, in words that both engines read.
_ABSENT = "(pair_id % 11 = 1 and port_id = 'rms.practice') or (pair_id % 11 = 2 and port_id = 'pcm.mapped.practice')"
_TWICE = "pair_id % 11 = 3 and port_id = 'warp_path'"
_PLANTED = {
    "schema_version": "case when pair_id % 7 = 4 and port_id = 'notes.reference' then 'v2' else 'v1' end",
    "element_type": "case when pair_id % 7 = 1 and port_id = 'pitch.reference' then 'float64' else element_type end",
    "dims": "dims",
    "fields": "case when pair_id % 11 = 4 and port_id = 'pitch.reference' then 'voiced,f0_hz,confidence' when pair_id % 7 = 2 and port_id = 'notes.practice' then 'onset_sec,rms' when pair_id % 11 = 9 and port_id = 'rms.practice' then 'x' else fields end",
    "units": "case when pair_id % 11 = 7 and port_id = 'pitch.practice' then 'Hz' else units end",
    "timeline_basis": "case when pair_id % 7 = 3 and port_id = 'pitch.practice' then 'WARPED' else timeline_basis end",
    "hop_length": "case when pair_id % 11 = 5 and port_id = 'notes.practice' then 256 when pair_id % 11 = 6 and port_id = 'rms.reference' then 0 else hop_length end",
    "sample_rate": "case when pair_id % 7 = 5 and port_id = 'rms.reference' then 22050 else sample_rate end",
    "rationale": "case when pair_id % 11 = 8 and port_id = 'chroma.lowres.reference' then '  ' else 'needed' end",
}
_literal = lambda v: "'" + v + "'" if isinstance(v, str) else str(v)
_PORTS = f""", pairs as (select distinct pair_id from notes), base({_PORT_COLUMNS}) as (values {", ".join("(" + ", ".join(map(_literal, p)) + ")" for p in PORTS)}),
each as (select pair_id, base.* from pairs, base where not ({_ABSENT})),
all_ports as (select * from each union all select * from each where {_TWICE}),
ports as (select pair_id, port_id, {", ".join(f"{x} as {c}" for c, x in _PLANTED.items())} from all_ports)
"""


def _pairs(spark, d):
    return A.notes(spark, d).select("pair_id").distinct()


def _ports(spark, d):
    names = _PORT_COLUMNS.split(", ")
    base = F.array(*(F.struct(*(F.lit(v).alias(n) for n, v in zip(names, p))) for p in PORTS))
    each = _pairs(spark, d).select("pair_id", F.explode(base).alias("p")).select("pair_id", "p.*").where(f"not ({_ABSENT})")
    rows = each.unionByName(each.where(_TWICE)).selectExpr("pair_id", "port_id", *(f"{x} as {c}" for c, x in _PLANTED.items()))
    listed = lambda c: F.filter(F.split(c, ","), lambda x: x != "")
    return rows.withColumn("dimensions", listed("dims")).withColumn("field_names", listed("fields"))


@query(sql("notes", _PORTS + f"""
select pair_id, port_id, 'duplicate' as rule from ports group by pair_id, port_id having count(*) > 1
union all select pair_id, m, 'missing' from pairs, (select unnest(['pcm.mapped.reference', 'pcm.mapped.practice']) as m) where (pair_id, m) not in (select (pair_id, port_id) from ports)
union all select pair_id, port_id, 'rationale' from ports where trim(rationale) = ''
union all select pair_id, port_id, 'fields' from ports where fields <> case when not contains(dims, ',') then '' when port_id = 'warp_path' then 'reference_frame,practice_frame' when port_id like 'pitch.%' then 'f0_hz,voiced,confidence'
  when port_id like 'notes.%' then 'onset_sec,f0_hz,rms' when port_id like 'chroma.%' then '{_CHROMA}' end
union all select pair_id, port_id, 'hop' from ports where case when dims like '%frame%' then hop_length <= 0 else hop_length <> 0 end
union all select pair_id, port_id, 'unit' from ports where units not in ('amplitude', 'chroma', 'hz', 'index', 'rms', 'cents', 'seconds', 'db', 'ratio', 'count')
union all select distinct pair_id, port_id, 'symmetry' from ports where regexp_matches(port_id, '[.](reference|practice)$') and port_id not like 'pcm.warped.%' and (pair_id,
  case when port_id like '%.reference' then replace(port_id, '.reference', '.practice') else replace(port_id, '.practice', '.reference') end) not in (select (pair_id, port_id) from ports)"""))  # fmt: skip
def port_integrity(spark, d):
    return K.port_integrity(_ports(spark, d))


NEEDS = (
    Requirement("pitch", "pitch.reference", element_type="float32", required_fields=("f0_hz", "voiced"), sample_rate=44100),
    Requirement("pitch", "pitch.practice", timeline_basis="REFERENCE", element_type="float32", required_fields=("f0_hz", "voiced"), sample_rate=44100),
    Requirement("pitch", "notes.reference", required_fields=("onset_sec", "f0_hz")),
    Requirement("pitch", "notes.practice", required_fields=("onset_sec", "f0_hz")),
    Requirement("timing", "notes.reference", schema_version="v1", timeline_basis="REFERENCE"),
    Requirement("timing", "notes.practice", timeline_basis="REFERENCE"),
    Requirement("dynamics", "rms.reference", sample_rate=44100),
    Requirement("dynamics", "rms.practice"),
    Requirement("dynamics", "pcm.mapped.practice", required=False),
    Requirement("timbre", "mfcc.reference"),
)
_or_null = lambda v: "null" if v is None else _literal(v)
_NEEDS = ", needs(algorithm_id, place, port_id, required, version, basis, kind, wanted, rate) as (values " + ", ".join(
    f"('{r.algorithm_id}', {i}, '{r.port_id}', {str(r.required).lower()}, '{r.schema_version}', {_or_null(r.timeline_basis)}, {_or_null(r.element_type)}, '{','.join(r.required_fields)}', {_or_null(r.sample_rate)})" for i, r in enumerate(NEEDS)
) + """),
met as (
  select pairs.pair_id, n.algorithm_id, n.place, n.port_id, n.required, bool_or(p.port_id is not null) as ok from pairs cross join needs n left join ports p on p.pair_id = pairs.pair_id and p.port_id = n.port_id
    and (n.version = '*' or n.version = p.schema_version) and (n.basis is null or n.basis = p.timeline_basis) and (n.kind is null or n.kind = p.element_type) and (n.rate is null or n.rate = p.sample_rate)
    and (n.wanted = '' or list_has_all(string_split(p.fields, ','), string_split(n.wanted, ','))) group by all),
resolved as (
  select pair_id, algorithm_id, case when bool_or(required and not ok) then 'INCOMPATIBLE' else 'OK' end as status, coalesce(string_agg(port_id, ',' order by place) filter (where ok), '') as available,
    coalesce(string_agg(port_id, ',' order by place) filter (where not ok and not required), '') as missing_optional, coalesce(string_agg(port_id, ',' order by place) filter (where not ok and required), '') as incompatible_required
  from met group by pair_id, algorithm_id)
"""


def _resolved(spark, d):
    return K.input_resolution(_pairs(spark, d), _ports(spark, d), NEEDS)


@query(sql("notes", _PORTS + _NEEDS + "select * from resolved"))
def input_resolution(spark, d):
    joined = lambda c: F.array_join(c, ",").alias(c)
    return _resolved(spark, d).select("pair_id", "algorithm_id", "status", joined("available"), joined("missing_optional"), joined("incompatible_required"))


@query("""
with asked as (select event_id, case event_id % 6 when 0 then null when 1 then [] when 2 then ['dynamics', 'pitch'] when 3 then ['timbre', 'timing'] when 4 then ['pitch', 'pitch'] else ['x', 'y'] end as names from events),
reg(name, rank) as (values ('pitch', 0), ('timing', 1), ('dynamics', 2))
select event_id as request_id, name as algorithm_id, rank, cast(null as varchar) as error_code from asked, reg where names is null or list_contains(names, name)
union all select event_id, n, null, 'UNKNOWN_ALGORITHM' from (select distinct event_id, unnest(names) as n from asked) where n not in (select name from reg)
union all select event_id, null, null, 'EMPTY_SELECTION' from asked where len(names) = 0""")  # fmt: skip
def algorithm_selection(spark, d):
    k = F.col("event_id") % 6
    of = lambda *n: F.array(*map(F.lit, n)).cast("array<string>")
    names = F.when(k == 1, of()).when(k == 2, of("dynamics", "pitch")).when(k == 3, of("timbre", "timing")).when(k == 4, of("pitch", "pitch")).when(k == 5, of("x", "y"))
    return K.algorithm_selection(A.table(spark, d, "events").select(F.col("event_id").alias("request_id"), names.alias("names")), ("pitch", "timing", "dynamics"))


_DECLARED = ("pitch.reference", "pitch.practice", "rms.reference", "rms.practice", "notes.reference", "mfcc.reference")


@query(sql("notes", _PORTS + f""", want as (select pair_id, q.port_id from pairs, (select unnest({list(_DECLARED)}) as port_id) q)
(select pair_id, port_id, 'missing' as side from want except select pair_id, port_id, 'missing' from ports) union all
(select pair_id, port_id, 'extra' from ports except select pair_id, port_id, 'extra' from want)"""))  # fmt: skip
def port_set_equality(spark, d):
    return K.port_set_equality(_pairs(spark, d), _ports(spark, d), _DECLARED)


@query(sql("notes", _PORTS + _NEEDS + 'select distinct port_id, port_id in (select port_id from ports) as "exists" from needs'))
def port_intersection(spark, d):
    return K.port_intersection(_ports(spark, d), NEEDS)


# envelopes

_ALGORITHMS = ("pitch", "timing", "dynamics")
_REQUIRED = {a: ",".join(r.port_id for r in NEEDS if r.algorithm_id == a and r.required) for a in _ALGORITHMS}
_req = "case rank " + " ".join(f"when {i} then '{_REQUIRED[a]}'" for i, a in enumerate(_ALGORITHMS)) + " end"
_alg = "case rank " + " ".join(f"when {i} then '{a}'" for i, a in enumerate(_ALGORITHMS)) + " end"
_k = "(pair_id * 3 + rank) % 14"
#: Envelopes of each pair, and what breaks a rule in some of them.
_ENVELOPE = {
    "algorithm_id": f"case when {_k} = 13 then 'timbre?' else {_alg} end",
    "algorithm_version": f"case when {_k} = 12 then '2' else '1' end",
    "status": f"case {_k} when 1 then 'DONE' when 2 then 'DEGRADED' when 3 then 'DEGRADED' when 4 then 'FAILED' when 5 then 'FAILED' when 6 then 'INCOMPATIBLE' else 'OK' end",
    "required": f"case when {_k} = 11 then 'notes.practice' else {_req} end",
    "consumed": f"case when {_k} = 10 then 'mfcc.reference,notes.practice' else {_req} end",
    "coverage": f"case {_k} when 3 then cast(0.5 as double) when 8 then cast(1.5 as double) when 9 then cast('nan' as double) end",
    "warning": f"case when {_k} = 0 then 'short' else '' end",
    "error_code": f"case {_k} when 5 then 'PLUGIN_INCOMPATIBLE' when 6 then 'PLUGIN_INCOMPATIBLE' when 7 then 'ALGORITHM_FAILED' end",
    "error_detail": f"case {_k} when 6 then 'no port' end",
}
_i = "(pair_id + rank * 5) % 9"
#: Their items: a scalar, two series and a scalar, and what breaks a rule in some of them.
_ITEM = {
    "key": f"case when ord = 1 or (ord = 4 and {_i} = 4) then 'median' when ord = 2 then 'note_reference' when ord = 3 then 'note_practice' when {_i} = 5 then '' else 'n_notes' end",
    "kind": f"case when ord in (2, 3) then 'series' when ord = 4 and {_i} = 7 then 'table' else 'scalar' end",
    "unit": f"case when ord = 1 and {_i} = 1 then 'ms' when ord = 4 then 'count' else 'cents' end",
    "timeline_basis": f"case when ord not in (2, 3) or (ord = 2 and {_i} = 3) then null when ord = 3 and {_i} = 6 then 'WARPED' else 'REFERENCE' end",
    "n_t": "case when ord in (2, 3) then 3 end",
    "n_values": f"case when ord = 2 and {_i} = 2 then 2 when ord in (2, 3) then 3 end",
}
_ENV = f""", ranked as (select distinct pair_id, rank from notes, (select unnest([0, 1, 2]) as rank)),
envelopes as (select pair_id, rank, {", ".join(f"{x} as {c}" for c, x in _ENVELOPE.items())} from ranked),
means as (select pair_id, avg(value) as v from notes group by pair_id),
items as (
  select pair_id, rank, ord, {_ENVELOPE["algorithm_id"]} as algorithm_id, {", ".join(f"{x} as {c}" for c, x in _ITEM.items())}, round(v * ord, 6) as value
  from ranked join means using (pair_id), (select unnest([1, 2, 3, 4]) as ord))
"""


def _ranked(spark, d):
    return _pairs(spark, d).select("pair_id", F.explode(F.array(*map(F.lit, range(3)))).alias("rank"))


def _envelopes(spark, d):
    e = _ranked(spark, d).selectExpr("pair_id", "rank", *(f"{x} as {c}" for c, x in _ENVELOPE.items()))
    listed = lambda c: F.filter(F.split(c, ","), lambda x: x != "")
    return e.withColumns({"required_ports": listed("required"), "consumed_ports": listed("consumed"), "warnings": listed("warning")})


def _means(spark, d):
    """Each pair's mean, its values added in the order of events: means often end in half a unit of the sixth digit, and
    there the order of the sum decides. A running sum, so that no row or buffer holds a pair's values."""
    order = W.partitionBy("pair_id").orderBy("event_id", "value")
    n = A.notes(spark, d).select("pair_id", "event_id", "value")
    n = n.select("pair_id", "value", F.sum("value").over(order.rowsBetween(W.unboundedPreceding, 0)).alias("total"), F.row_number().over(order).alias("place"))
    return n.groupBy("pair_id").agg((F.max_by("total", "place") / F.count("value")).alias("v"))


def _items(spark, d):
    """The value is rounded as the SQL's engine does it, by the product with a million."""
    rows = _ranked(spark, d).join(_means(spark, d), "pair_id").select("*", F.explode(F.array(*map(F.lit, range(1, 5)))).alias("ord"))
    return rows.selectExpr("pair_id", "rank", "ord", f"{_ENVELOPE['algorithm_id']} as algorithm_id", *(f"{x} as {c}" for c, x in _ITEM.items()), "round(v * ord * 1e6d) / 1e6d as value")


@query(sql("notes", _ENV + "select pair_id, algorithm_id, key, unit from items where unit not in ('amplitude', 'chroma', 'hz', 'index', 'rms', 'cents', 'seconds', 'db', 'ratio', 'count')"))
def unit_vocabulary_check(spark, d):
    return K.unit_violations(_items(spark, d)).select("pair_id", "algorithm_id", "key", "unit")


@query(sql("notes", _ENV + """
select pair_id, algorithm_id, 'status' as rule, status as detail from envelopes where status not in ('OK', 'DEGRADED', 'INCOMPATIBLE', 'FAILED')
union all select pair_id, algorithm_id, 'unit', key || ' ' || unit from items where unit = 'ms' or kind = 'table'
union all select pair_id, algorithm_id, 'length', key from items where n_t <> n_values
union all select pair_id, algorithm_id, 'basis', key from items where kind = 'series' and timeline_basis is null
union all select pair_id, algorithm_id, 'coverage', case when isnan(coverage) then 'NaN' else cast(coverage as varchar) end from envelopes where isnan(coverage) or coverage < 0 or coverage > 1
union all select pair_id, algorithm_id, 'evidence', 'no coverage or warning' from envelopes where status = 'DEGRADED' and coverage is null and warning = ''
union all select pair_id, algorithm_id, 'error', coalesce(error_code, 'none') from envelopes
  where (status = 'FAILED' and coalesce(error_code, '') not in ('ALGORITHM_FAILED', 'ALGORITHM_TIMEOUT', 'ALGORITHM_RESULT_INVALID')) or (status = 'INCOMPATIBLE' and coalesce(error_code, '') <> 'PLUGIN_INCOMPATIBLE')
union all select pair_id, algorithm_id, 'no_error', error_code from envelopes where status in ('OK', 'DEGRADED', 'DONE') and error_code is not null"""))  # fmt: skip
def envelope_check(spark, d):
    return K.envelope_check(_envelopes(spark, d), _items(spark, d))


_VERSIONS = {a: "1" for a in _ALGORITHMS}


@query(sql("notes", _PORTS + _NEEDS + _ENV + f""", e as (
  select e.*, r.available, case e.algorithm_id {" ".join(f"when '{a}' then '{_REQUIRED[a]}'" for a in _ALGORITHMS)} end as wanted from envelopes e left join resolved r using (pair_id, algorithm_id)),
lacks as (
  select pair_id, algorithm_id, wanted, array_to_string(list_filter(string_split(consumed, ','), lambda x: not list_contains(string_split(coalesce(available, ''), ','), x)), ',') as a,
    array_to_string(list_filter(string_split(consumed, ','), lambda x: not list_contains(string_split(wanted, ','), x)), ',') as b from e)
select pair_id, algorithm_id, 'algorithm' as rule, algorithm_id as detail from e where wanted is null
union all select pair_id, algorithm_id, 'version', algorithm_version from e where wanted is not null and algorithm_version <> '1'
union all select pair_id, algorithm_id, 'required', required from e where wanted is not null and required <> wanted
union all select pair_id, algorithm_id, 'available', a from lacks where wanted is not null and a <> ''
union all select pair_id, algorithm_id, 'declared', b from lacks where wanted is not null and b <> ''
union all select distinct pair_id, algorithm_id, 'key', '' from items where key = ''
union all select pair_id, algorithm_id, 'key', key from items where key <> '' group by pair_id, algorithm_id, key having count(*) > 1"""))  # fmt: skip
def consumed_subset_check(spark, d):
    return K.consumed_check(_envelopes(spark, d), _items(spark, d), _resolved(spark, d), _VERSIONS, NEEDS)


# projection and runs

_PROJECTED = _ENV + """, shown as (
  select i.*, i.algorithm_id || '.' || i.key as full_key from items i join envelopes e using (pair_id, algorithm_id) where status in ('OK', 'DEGRADED')),
again as (select *, row_number() over (partition by pair_id, full_key order by rank, ord) > 1 as again from shown),
based as (select *, first_value(case when kind = 'series' and not again then timeline_basis end ignore nulls) over (partition by pair_id order by rank, ord rows between unbounded preceding and current row) as first_basis from again),
projected as (
  select pair_id, algorithm_id, full_key as key, kind, value, unit, timeline_basis, case when again then 'key repeated' when kind = 'series' and timeline_basis is null then 'timeline basis unknown'
    when kind = 'series' and timeline_basis <> first_basis then 'timeline basis mixed' end as problem from based
  union all select pair_id, algorithm_id, null, null, null, null, null, concat_ws(', ', 'status=' || status, 'error_code=' || error_code, error_detail) from envelopes where status not in ('OK', 'DEGRADED')),
builds as (
  select pair_id, case when pair_id % 13 = 0 then 'FAILED' else 'DATA_READY' end as state, case when pair_id % 13 = 0 then 'INPUT_TOO_SHORT' end as error_code, case when pair_id % 13 = 0 then '12 s' end as error_detail from (select distinct pair_id from notes)),
told as (
  select pair_id, count(*) filter (where problem is null and kind = 'scalar') as n_scalars, count(*) filter (where problem is null and kind = 'series') as n_series,
    string_agg(coalesce(key, algorithm_id) || ': ' || problem, '; ' order by coalesce(key, algorithm_id) || ': ' || problem) as problems from projected group by pair_id),
views as (
  select pair_id, state, coalesce(error_code, case when problems is not null then 'ALGORITHM_RESULT_INVALID' end) as error_code, nullif(concat_ws('; ', error_detail, problems), '') as error_detail,
    coalesce(n_scalars, 0) as n_scalars, coalesce(n_series, 0) as n_series from builds left join told using (pair_id))
"""


def _projected(spark, d):
    return O.project(_envelopes(spark, d), _items(spark, d))


def _builds(spark, d):
    failed = F.col("pair_id") % 13 == 0
    return _pairs(spark, d).select("pair_id", F.when(failed, "FAILED").otherwise("DATA_READY").alias("state"), F.when(failed, "INPUT_TOO_SHORT").alias("error_code"), F.when(failed, "12 s").alias("error_detail"))


@query(sql("notes", _PROJECTED + "select * from projected"))
def project_results(spark, d):
    return _projected(spark, d)


@query(sql("notes", _PROJECTED + "select *, error_code is null and n_scalars + n_series > 0 as success from views"))
def run_success(spark, d):
    return O.run_view(_builds(spark, d), _projected(spark, d))


@query(sql("notes", _PROJECTED + """
select pair_id, case when pair_id % 13 = 0 then 'A_UNBUILT' when problems is not null then 'D_BLOCKED' when coalesce(n_scalars, 0) + coalesce(n_series, 0) = 0 then 'B_NO_SOURCE' else 'C_HAS_DATA' end as state
from builds left join told using (pair_id)"""))  # fmt: skip
def classify_run(spark, d):
    v = O.run_view(_builds(spark, d), _projected(spark, d))
    return v.select("pair_id", O.run_state(F.col("state") == "DATA_READY", F.col("error_code").isNotNull(), F.col("n_scalars") + F.col("n_series") > 0).alias("state"))


_PLACED = """, placed as (select pair_id, rank * 10 + ord as place, case when ord = 4 and rank = 1 then key else algorithm_id || '.' || key end as key from items where kind = 'scalar')
"""


@query(sql("notes", _ENV + _PLACED + """, g as (
  select pair_id, case when contains(key, '.') then string_split(key, '.')[1] else '(none)' end as prefix, min(place) as first, count(*) as n, string_agg(key, ',' order by place, key) as keys from placed group by all)
select pair_id, prefix, row_number() over (partition by pair_id order by first, prefix) as group_no, n, keys from g"""))  # fmt: skip
def group_scalars(spark, d):
    key = F.when((F.col("ord") == 4) & (F.col("rank") == 1), F.col("key")).otherwise(F.concat_ws(".", "algorithm_id", "key"))
    s = _items(spark, d).where("kind = 'scalar'").select("pair_id", (F.col("rank") * 10 + F.col("ord")).alias("place"), key.alias("key"))
    return O.group_scalars(s).select("pair_id", "prefix", F.col("group_no").cast("bigint").alias("group_no"), "n", F.array_join("keys", ",").alias("keys"))


# documents and reports

_DOC = _ENV + """, vw as (
  select pair_id, 'ref/' || pair_id || '.wav' as reference_uri, 'prac/' || pair_id || '.wav' as practice_uri, case when pair_id % 13 = 0 then 'FAILED' else 'DATA_READY' end as state,
    case when pair_id % 13 = 0 then 'INPUT_TOO_SHORT' end as error_code, case when pair_id % 13 = 0 then '12 s' end as error_detail from (select distinct pair_id from notes)),
sc as (select pair_id, rank, ord, algorithm_id || '.' || key as key, 'the ' || key as label, value, unit, case when ord = 1 then 50.0::double end as threshold from items where ord in (1, 4) and pair_id % 13 <> 0),
se as (
  select pair_id, rank, ord, algorithm_id || '.' || key as key, 'each ' || key as label, unit, coalesce(timeline_basis, 'WARPED') as timeline_basis, 'notes.reference' as source_port, idx, idx * 0.5::double as t, round(value + idx, 6) as value
  from items, (select unnest([0, 1, 2]) as idx) where ord in (2, 3) and pair_id % 13 <> 0)
"""


def _document_tables(spark, d):
    p = F.col("pair_id").cast("string")
    views = _builds(spark, d).select("pair_id", F.concat(F.lit("ref/"), p, F.lit(".wav")).alias("reference_uri"), F.concat(F.lit("prac/"), p, F.lit(".wav")).alias("practice_uri"), "state", "error_code", "error_detail")
    items = _items(spark, d).where("pair_id % 13 <> 0").withColumn("full", F.concat_ws(".", "algorithm_id", "key"))
    scalars = items.where("ord in (1, 4)").select("pair_id", "rank", "ord", F.col("full").alias("key"), F.concat(F.lit("the "), "key").alias("label"), "value", "unit", F.when(F.col("ord") == 1, 50.0).alias("threshold"))
    series = items.where("ord in (2, 3)").select("*", F.explode(F.array(*map(F.lit, range(3)))).alias("idx"))
    series = series.select("pair_id", "rank", "ord", F.col("full").alias("key"), F.concat(F.lit("each "), "key").alias("label"), "unit", F.coalesce("timeline_basis", F.lit("WARPED")).alias("timeline_basis"), F.lit("notes.reference").alias("source_port"), "idx", (F.col("idx") * F.lit(0.5)).alias("t"), F.round(F.col("value") + F.col("idx"), 6).alias("value"))
    return views, scalars, series


_DOCUMENT = """schema_version string, inputs struct<reference string, practice string>, state string, error_code string, error_detail string,
scalars array<struct<key string, label string, value double, unit string>>, series array<struct<key string, label string, unit string, timeline_basis string, source_port string, n_points int, t array<double>, values array<double>>>"""


@query(sql("notes", _DOC + """
select pair_id, '2' as schema_version, reference_uri, practice_uri, state, error_code, error_detail, cast(null as bigint) as place, cast(null as varchar) as key, cast(null as varchar) as label, cast(null as varchar) as unit,
  cast(null as varchar) as timeline_basis, cast(null as bigint) as idx, cast(null as double) as t, cast(null as double) as value from vw
union all select pair_id, null, null, null, null, null, null, row_number() over (partition by pair_id order by rank, ord), key, label, unit, null, null, null, value from sc
union all select pair_id, null, null, null, null, null, null, dense_rank() over (partition by pair_id order by rank, ord), key, label, unit, timeline_basis, idx, t, value from se"""))  # fmt: skip
def metrics_sink(spark, d):
    """The documents, read again: a row for each with its head, and one for each scalar and each point."""
    return read_documents(O.nested_document(*_document_tables(spark, d)))


def read_documents(documents):
    doc = documents.select("pair_id", F.from_json("document", _DOCUMENT).alias("x"))
    head = doc.select("pair_id", "x.schema_version", F.col("x.inputs.reference").alias("reference_uri"), F.col("x.inputs.practice").alias("practice_uri"), "x.state", "x.error_code", "x.error_detail")
    place = (F.col("i") + 1).cast("bigint").alias("place")
    scalars = doc.select("pair_id", F.posexplode("x.scalars").alias("i", "s")).select("pair_id", place, "s.key", "s.label", "s.unit", "s.value")
    series = doc.select("pair_id", F.posexplode("x.series").alias("i", "s")).select("pair_id", place, "s.key", "s.label", "s.unit", "s.timeline_basis", F.posexplode(F.arrays_zip("s.t", "s.values")).alias("idx", "p"))
    series = series.select("pair_id", "place", "key", "label", "unit", "timeline_basis", F.col("idx").cast("bigint").alias("idx"), F.col("p.t").alias("t"), F.col("p.values").alias("value"))
    return head.unionByName(scalars, allowMissingColumns=True).unionByName(series, allowMissingColumns=True)


@query(sql("notes", _DOC + """, ls as (
  select pair_id, 0 as part, 0 as rank, 0 as ord, 'reference ' || reference_uri || ', practice ' || practice_uri as line from vw
  union all select pair_id, 1, 0, 0, 'state ' || state from vw
  union all select pair_id, 2, 0, 0, 'error ' || error_code || ' - ' || error_detail from vw where error_code is not null
  union all select pair_id, 3, rank, ord, label || ' = ' || printf('%.6f', value) || ' ' || unit || case when threshold is not null then ' (threshold ' || printf('%.6f', threshold) || ')' else '' end from sc
  union all select pair_id, 4, rank, ord, any_value(label) || ': ' || count(*) || ' points, t in seconds, ' || any_value(timeline_basis) || ' (' || case any_value(timeline_basis) when 'REFERENCE' then 'source time kept' else 'time normalised' end
    || '), values in ' || any_value(unit) from se group by pair_id, rank, ord)
select pair_id, row_number() over (partition by pair_id order by part, rank, ord, line) as line_no, line from ls"""))  # fmt: skip
def report_lines(spark, d):
    return O.report_lines(*_document_tables(spark, d))


# series

_SERIES = """, se as (select pair_id, rank * 10 + ord as ord, algorithm_id || '.' || key as key from items where kind = 'series' and not (pair_id % 4 = 1 and ord = 3)),
b as (select pair_id, ord, key, regexp_replace(key, '_(reference|practice|ref|prac)$', '') as base, regexp_matches(key, '_(reference|ref)$') as is_ref from se)
"""


def _series(spark, d):
    s = _items(spark, d).where("kind = 'series' and not (pair_id % 4 = 1 and ord = 3)")
    return s.select("pair_id", (F.col("rank") * 10 + F.col("ord")).alias("ord"), F.concat_ws(".", "algorithm_id", "key").alias("key"))


@query(sql("notes", _ENV + _SERIES + "select r.pair_id, r.base, r.key as ref_key, p.key as prac_key from b r join b p on r.pair_id = p.pair_id and r.base = p.base where r.is_ref and not p.is_ref"))
def series_pairs(spark, d):
    return O.series_pairs(_series(spark, d))


@query(sql("notes", _ENV + _SERIES + "select pair_id, key from b where (pair_id, base) in (select (pair_id, base) from b group by pair_id, base having count(*) < 2)"))
def unpaired_series(spark, d):
    return O.unpaired_series(_series(spark, d))


@query("""
with t as (select distinct page_id as id, w as token from (select page_id, unnest(string_split(url, '/')) as w from pages) where length(w) > 0),
g as (select id, list(token order by token) as tokens, count(*) as n from t group by id),
c as (select min(id) as id, tokens from g group by tokens),
u as (select id, n, unnest(tokens) as token from g),
s as (select a.id as a, b.id as b, a.n as na, b.n as nb, count(*) as k from u a join u b on a.token = b.token and a.id < b.id group by all)
select a, b, round(k / (na + nb - k), 6) as similarity, cast(null as bigint) as id, cast(null as bigint) as representative from s where k / (na + nb - k) >= 0.6
union all select null, null, null, g.id, c.id from g join c using (tokens)""")  # fmt: skip
def set_similarity(spark, d):
    """Pairs of pages by their sets of URL segments, those of equal sets too, and each page's set by its smallest page."""
    words = F.explode(F.split("url", "/"))
    t = A.table(spark, d, "pages").select(F.col("page_id").alias("id"), words.alias("token")).where("length(token) > 0")
    pairs, members = J.set_similarity(t, 0.6, copies=True)
    return pairs.withColumn("similarity", R(F.col("similarity"))).unionByName(members, allowMissingColumns=True)


@query(sql("notes", """, s as (select take_id, note_no - 1 as idx, value, max(note_no - 1) over (partition by take_id) as last from notes),
j as (select take_id, last, cast(round_even(i * last / 19.0::double, 0) as bigint) as idx from (select distinct take_id, last from s), (select unnest(range(20)) as i) where last >= 20)
select s.take_id, s.idx, s.value from s where s.last < 20 or (s.take_id, s.idx) in (select (take_id, idx) from j)"""))  # fmt: skip
def downsample(spark, d):
    s = A.notes(spark, d).select("take_id", (F.col("note_no") - 1).alias("idx"), "value")
    return O.downsample(s, ["take_id"], 20)


@query(sql("pitch_frames", """, b as (select take_id, frame, case when f0_hz > 0 then f0_hz + (frame % 3) * 0.5::double else 0 end as y, case when frame % 10 = 3 then 0 else voiced end as vb from pitch_frames where frame % 25 <> 7),
j as (select coalesce(a.take_id, b.take_id) as take_id, a.f0_hz as x, y, a.voiced as va, vb from pitch_frames a full join b on a.take_id = b.take_id and a.frame = b.frame),
c as (select *, case when va = 1 and vb = 1 and x > 0 and y > 0 then abs(1200 * log2(y / x)) end as cents from j)
select take_id, count(*) filter (where x is null or y is null) as n_missing, round(max(abs(x - y)), 6) as max_gap, round(avg(abs(x - y)), 6) as mean_gap,
  round(quantile_cont(abs(x - y), 0.95), 6) as p95_gap, round(corr(x, y), 6) as r, round(avg(case when vb is not null then (va = vb)::int end), 6) as voiced_agreement, count(cents) as n_both_voiced,
  round(median(cents), 6) as median_cents, round(quantile_cont(cents, 0.95), 6) as p95_cents, round(max(cents), 6) as max_cents, count(*) filter (where cents > 5) as n_over from c group by take_id"""))  # fmt: skip
def frame_equivalence(spark, d):
    a = A.pitch_frames(spark, d).select("take_id", "frame", F.col("f0_hz").alias("value"), "voiced")
    b = a.where("frame % 25 <> 7").select("take_id", "frame", F.when(F.col("value") > 0, F.col("value") + (F.col("frame") % 3) * 0.5).otherwise(0.0).alias("value"), F.when(F.col("frame") % 10 == 3, 0).otherwise(F.col("voiced")).alias("voiced"))
    e = O.frame_equivalence(a, b, ["take_id", "frame"], "take_id", 5.0)
    return e.withColumns({c: R(F.col(c)) for c in ("max_gap", "mean_gap", "p95_gap", "r", "voiced_agreement", "median_cents", "p95_cents", "max_cents")})


@query(sql("rms_frames notes", """, c as (select pair_id, take_id, avg(rms) as v from rms_frames group by pair_id, take_id),
o as (select take_id, avg(rms) * 0.5625::double + case when take_id % 6 = 1 then 0.03 when take_id % 6 = 2 then 0.0199 else 0 end as was from notes where take_id % 10 <> 9 group by take_id
  union all select max(take_id) + 1, 0.5 from notes)
select o.take_id, round(was, 9) as expected, round(v, 9) as actual, coalesce(abs(v - was) <= 0.02, false) as match from o left join c using (take_id)"""))  # fmt: skip
def drift_report(spark, d):
    """Anchors of the frames against those recorded of the notes; one recorded take is gone."""
    now = A.rms_frames(spark, d).groupBy("take_id").agg(F.avg("rms").alias("value"))
    n = A.notes(spark, d)
    k = F.col("take_id") % 6
    was = n.where("take_id % 10 <> 9").groupBy("take_id").agg((F.avg("rms") * 0.5625).alias("v")).select("take_id", (F.col("v") + F.when(k == 1, 0.03).when(k == 2, 0.0199).otherwise(0.0)).alias("value"))
    gone = n.agg((F.max("take_id") + 1).alias("take_id")).select("take_id", F.lit(0.5).alias("value"))
    report = O.drift_report(now, was.unionByName(gone), ["take_id"])
    return report.withColumns({"expected": R(F.col("expected"), 9), "actual": R(F.col("actual"), 9)})


@query(sql("notes", """, m as (select pair_id, event_type, avg(rms) as v from notes group by pair_id, event_type),
l as (select pair_id, arg_min(event_type, (round(v, 12), event_type)) as actual from m group by pair_id),
w as (select pair_id, min(event_type) as expected from notes group by pair_id)
select w.pair_id, expected, actual, expected = actual as match from w join l using (pair_id)"""))  # fmt: skip
def lowest_check(spark, d):
    n = A.notes(spark, d)
    m = n.groupBy("pair_id", "event_type").agg(F.round(F.avg("rms"), 12).alias("v"))
    return O.lowest_check(m, n.groupBy("pair_id").agg(F.min("event_type").alias("event_type")), "pair_id", "event_type", "v")


# the metrics of all pairs

_LABELS = {"pitch": ("median_abs_cents", "off_pitch_ratio", "n_notes_used", "n_unpaired", "sample_rate"), "timing": ("median_sec", "spread_sec", "early_ratio", "late_ratio", "on_time_ratio", "n_notes_used", "n_unpaired"), "dynamics": ("median_db", "spread_db", "n_notes_used", "n_unpaired")}
_METRICS = f""", pm as ({N.SQL["pitch_metrics"]}), tm as ({N.SQL["timing_metrics"]}), dm as ({N.SQL["dynamics_metrics"]}),
ran as ({" union all ".join(f"select pair_id, '{a}' as algorithm_id, '{k}' as key, cast({k} as double) as value from {a[0]}m" for a, keys in _LABELS.items() for k in keys)})
"""


def _long(df, keys):
    rows = F.explode(F.array(*(F.struct(F.lit(k).alias("key"), F.col(k).cast("double").alias("value")) for k in keys)))
    return df.select("pair_id", rows.alias("x")).select("pair_id", "x.key", "x.value")


def registry() -> O.MetricRegistry:
    """The three metrics of a pair, and one that needs a port that no pair has."""
    found = O.MetricRegistry()
    of = lambda a: tuple(r for r in NEEDS if r.algorithm_id == a)
    found.register("pitch", "1", ("spans", "pitch"), lambda t: _long(G.pitch_summary(G.note_deviation(t["spans"], t["pitch"], N.LEAST_FRAMES)), _LABELS["pitch"]), of("pitch"))
    found.register("timing", "1", ("onsets",), lambda t: _long(G.timing_summary(J.pair_onsets(t["onsets"])), _LABELS["timing"]), of("timing"))
    found.register("dynamics", "1", ("energy",), lambda t: _long(G.dynamics_summary(t["energy"]), _LABELS["dynamics"]), of("dynamics"))
    found.register("timbre", "1", ("mfcc",), lambda t: t["mfcc"], of("timbre"))
    return found


def _tables(spark, d):
    t = N.shared_tables(spark, d)
    return {"spans": N._three_frame_notes(t["notes"]), "pitch": t["pitch"], "onsets": N._onsets(t["notes"]), "energy": N._energy_pairs(t["notes"], t["rms"])}


@query(sql("notes", _METRICS + "select pair_id, algorithm_id, key, round(value, 6) + 0.0 as value from ran"))
def metric_registry(spark, d):
    return registry().run(_tables(spark, d)).withColumn("value", R(F.col("value")))


@query(sql("notes", _PORTS + _NEEDS + _METRICS + """, got as (select pair_id, algorithm_id, count(*) as n from ran group by all),
e as (
  select r.pair_id, r.algorithm_id, concat_ws(',', case when r.algorithm_id = 'timbre' then 'mfcc' end, nullif(incompatible_required, '')) as lacks, coalesce(n, 0) as n from resolved r left join got using (pair_id, algorithm_id))
select pair_id, algorithm_id, '1' as algorithm_version, case when lacks <> '' then 'INCOMPATIBLE' when n = 0 then 'FAILED' else 'OK' end as status, case when lacks <> '' then 'PLUGIN_INCOMPATIBLE' when n = 0 then 'ALGORITHM_FAILED' end as error_code,
  case when lacks <> '' then lacks when n = 0 then 'no result' end as error_detail, case when lacks = '' then n else 0 end as n_values from e"""))  # fmt: skip
def run_metrics(spark, d):
    tables = _tables(spark, d)
    return registry().envelopes(_pairs(spark, d), _ports(spark, d), tables, registry().run(tables))


@query(sql("notes", _METRICS + f""", df as (select distinct pair_id, ['01_pitch', '02_timing', '03_dynamics', '04_wrong', '05_dropouts'][1 + pair_id % 5] as defect from notes)
select defect, {", ".join(f"round(avg(value) filter (where algorithm_id = '{a}' and key = '{k}'), 9) + 0.0 as {a}_{k}" for a, k in (("pitch", "median_abs_cents"), ("pitch", "n_unpaired"), ("timing", "median_sec"), ("timing", "late_ratio"), ("timing", "early_ratio"), ("dynamics", "median_db"), ("dynamics", "n_unpaired")))}
from df join ran using (pair_id) group by defect"""))  # fmt: skip
def defect_matrix(spark, d):
    defects = _pairs(spark, d).select("pair_id", F.get(F.array(*map(F.lit, ("01_pitch", "02_timing", "03_dynamics", "04_wrong", "05_dropouts"))), (F.col("pair_id") % 5).cast("int")).alias("defect"))
    scalars = metric_registry(spark, d).select("pair_id", F.concat_ws("_", "algorithm_id", "key").alias("key"), "value")
    keys = ["pitch_median_abs_cents", "pitch_n_unpaired", "timing_median_sec", "timing_late_ratio", "timing_early_ratio", "dynamics_median_db", "dynamics_n_unpaired"]
    m = O.defect_matrix(defects, scalars, keys)
    return m.withColumns({k: R(F.col(k), 9) for k in keys})


@query(sql("notes", f""", cv as ({N.SQL["note_pitch_curves"]}), dv as ({N.SQL["note_pitch_deviation"]}), en as ({N.SQL["note_energy_envelope"]}),
dc as (select pair_id, row_number() over (partition by pair_id order by note_no) as place, cents from dv where cents is not null),
es as (select pair_id, side, row_number() over (partition by pair_id, side order by note_no) as place, mean_db from en),
n as (select pair_id, min(k) as n from (select pair_id, side, count(*) as k from es group by all) group by pair_id)
select cv.pair_id, 'pitch' as metric, cv.place - 1 as idx, cv.place::double as axis, ref_hz as reference, prac_hz as practice, cents as delta from cv join dc using (pair_id, place)
union all select pair_id, 'dynamics', place - 1, place::double, max(case when side = 'reference' then mean_db end), max(case when side = 'practice' then mean_db end), null from es join n using (pair_id) where place <= n group by pair_id, place"""))  # fmt: skip
def metric_table(spark, d):
    """Wide tables of the pitch and energy series of each pair."""
    t = N.shared_tables(spark, d)
    curves = N._pitch_curves(N.note_deviation(spark, d, t))
    energy = N._energy(t["notes"], t["rms"]).withColumn("place", F.row_number().over(W.partitionBy("pair_id", "side").orderBy("note_no")))

    def series_of(df, values):
        """A row for each value of a row, by the names of their series."""
        each = F.explode(F.array(*(F.struct(k.alias("key"), F.col(c).alias("value")) for k, c in values))).alias("x")
        return df.select("pair_id", (F.col("place") - 1).cast("bigint").alias("idx"), F.col("place").cast("double").alias("t"), each).select("pair_id", "idx", "t", "x.*")

    series = series_of(curves, [(F.lit(f"pitch.per_note_{k}"), c) for k, c in (("f0_reference", "ref_hz"), ("f0_practice", "prac_hz"), ("cents", "cents"))])
    series = series.unionByName(series_of(energy.withColumn("mean_db", R(F.col("mean_db"))), [(F.concat(F.lit("dynamics.envelope_db_"), "side"), "mean_db")]))
    pitch = O.metric_table(series, "pitch", {"reference": ".per_note_f0_reference", "practice": ".per_note_f0_practice", "delta": ".per_note_cents"})
    loud = O.metric_table(series, "dynamics", {"reference": ".envelope_db_reference", "practice": ".envelope_db_practice"})
    columns = ("pair_id", "metric", "idx", "axis", "reference", "practice", "delta")
    return pitch.withColumn("metric", F.lit("pitch")).select(*columns).unionByName(loud.withColumn("metric", F.lit("dynamics")).withColumn("delta", F.lit(None).cast("double")).select(*columns))


# sizes and hashes

_SIZED = """, kinds(name, numbers, width) as (values ('pitch', 3, 4), ('rms', 1, 4), ('notes', 3, 4)),
counts as (
  select 'pitch' as name, pair_id, side, count(*) as frames from pitch_frames group by all union all select 'rms', pair_id, side, count(*) from rms_frames group by all union all select 'notes', pair_id, side, count(*) from notes group by all),
sized as (
  select pair_id, name || '.' || side as port_id, frames || case when numbers > 1 then 'x' || numbers else '' end as shape, frames, frames * numbers as element_count, width, 'float32' as dtype from counts join kinds using (name))
"""


def _sized(spark, d):
    return O.port_summary({"pitch": (A.pitch_frames(spark, d), 3, 4, "float32"), "rms": (A.rms_frames(spark, d), 1, 4, "float32"), "notes": (A.notes(spark, d), 3, 4, "float32")})


@query(sql("notes pitch_frames rms_frames", _SIZED + "select * from sized"))
def port_summary(spark, d):
    return _sized(spark, d)


@query(sql("notes pitch_frames rms_frames", _SIZED + "select pair_id, cast(sum(element_count * width) as bigint) as bytes, case when sum(element_count * width) > 9000 then 'CORE_BUILD_FAILED' end as error_code from sized group by pair_id"))
def budget_check(spark, d):
    return O.budget_check(_sized(spark, d), 9000)


@query(sql("notes", "select distinct take_id, take_id % 5 <> 2 and take_id % 7 <> 3 as same from notes"))
def determinism_check(spark, d):
    """Two runs over the notes, the second with other values in some takes and without others."""
    n = A.notes(spark, d)
    second = n.where("take_id % 7 <> 3").repartition(3, "event_id").withColumn("event_id", F.when((F.col("take_id") % 5 == 2) & (F.col("note_no") == 1), -1).otherwise(F.col("event_id")))
    hashed = lambda t: O.content_hash(t, ["take_id"], "notes", "note_no", ["note_no", "event_id"])
    return O.determinism_check(hashed(n), hashed(second), ["take_id"])
