"""Checks of ports, requirements and result envelopes. What breaks a rule is a row; nothing raises.

ports: pair_id, port_id, schema_version, element_type, dimensions and field_names (arrays), units, timeline_basis,
hop_length, sample_rate, rationale. envelopes: pair_id, algorithm_id, algorithm_version, status, required_ports and
consumed_ports (arrays), coverage, warnings (array), error_code. payload: pair_id, algorithm_id, key, kind (scalar or
series), unit, timeline_basis, n_t, n_values. Declared requirements are metadata, a tuple of Requirement a program.
"""

from __future__ import annotations

from typing import NamedTuple

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..config import ERRORS_OF_STATUS, FIELD_LAYOUTS, REQUIRED_PORTS, STATUSES, UNITS
from ..functions.scalars import port_prefix


class Requirement(NamedTuple):
    """A port that an algorithm reads; `*` and None leave a property open."""

    algorithm_id: str
    port_id: str
    required: bool = True
    schema_version: str = "*"
    timeline_basis: str | None = None
    element_type: str | None = None
    required_fields: tuple[str, ...] = ()
    sample_rate: int | None = None


def _strings(values: tuple[str, ...]) -> Column:
    return F.array(*map(F.lit, values)).cast("array<string>")


def unit_violations(results: DataFrame, units: tuple[str, ...] = UNITS) -> DataFrame:
    """Rows whose unit is missing or outside the vocabulary."""
    return results.where(F.col("unit").isNull() | ~F.col("unit").isin(*units))


def _found(rows: DataFrame, rule: str, *keys: str) -> DataFrame:
    return rows.select(*keys, F.lit(rule).alias("rule"))


def port_integrity(ports: DataFrame, required: tuple[str, ...] = REQUIRED_PORTS, layouts: dict[str, tuple[str, ...]] = FIELD_LAYOUTS, units: tuple[str, ...] = UNITS) -> DataFrame:
    """(pair_id, port_id, rule): `duplicate`; `missing` (a required port); `rationale` (blank); `fields` (a port of one
    dimension names fields, or one of several has not exactly its class's layout); `hop` (not positive though there are
    frames, or not 0 though there are none); `unit`; `symmetry` (a side without its twin, but for pcm.warped)."""
    key = ("pair_id", "port_id")
    layout = F.create_map(*(c for k, v in layouts.items() for c in (F.lit(k), _strings(v))))
    expected = F.when(F.size("dimensions") <= 1, F.array().cast("array<string>")).otherwise(F.try_element_at(layout, port_prefix(F.col("port_id"))))
    names = F.coalesce("field_names", F.array().cast("array<string>"))
    framed = F.array_contains("dimensions", "frame")
    hop = F.coalesce("hop_length", F.lit(0))
    rows = [
        _found(ports.groupBy(*key).agg(F.count("*").alias("n")).where("n > 1"), "duplicate", *key),
        _found(ports.where(F.trim(F.coalesce("rationale", F.lit(""))) == ""), "rationale", *key),
        _found(ports.where(~F.coalesce(names == expected, F.lit(False))), "fields", *key),
        _found(ports.where(F.when(framed, hop <= 0).otherwise(hop != 0)), "hop", *key),
        _found(unit_violations(ports.withColumn("unit", F.col("units")), units), "unit", *key),
    ]
    per_pair = ports.groupBy("pair_id").agg(F.collect_set("port_id").alias("have"))  # the closed set of ports of a pair
    absent = per_pair.select("pair_id", F.explode(F.array_except(_strings(required), F.col("have"))).alias("port_id"))
    twin = lambda p: F.when(p.endswith(".reference"), F.regexp_replace(p, "[.]reference$", ".practice")).when(p.endswith(".practice"), F.regexp_replace(p, "[.]practice$", ".reference"))
    alone = F.filter("have", lambda p: ~p.startswith("pcm.warped.") & twin(p).isNotNull() & ~F.array_contains(F.col("have"), F.coalesce(twin(p), F.lit(""))))
    rows += [_found(absent, "missing", *key), _found(per_pair.select("pair_id", F.explode(alone).alias("port_id")), "symmetry", *key)]
    out = rows[0]
    for r in rows[1:]:
        out = out.unionByName(r)
    return out


def envelope_check(envelopes: DataFrame, payload: DataFrame, units: tuple[str, ...] = UNITS) -> DataFrame:
    """(pair_id, algorithm_id, rule, detail) of the eight rules of an envelope by itself: `status` unknown; `unit` outside
    the vocabulary (or an item that is neither scalar nor series); `length` (times and values of a series differ);
    `basis` of a series missing; `coverage` outside [0, 1] or not finite; `evidence` (DEGRADED without coverage and
    warnings); `error` (INCOMPATIBLE or FAILED without a code of that status); `no_error` (OK or DEGRADED with one)."""
    key = ["pair_id", "algorithm_id"]
    items = payload.select(*key, F.explode(F.array(
        F.struct(F.lit("unit").alias("rule"), F.when(F.col("unit").isNull() | ~F.col("unit").isin(*units) | ~F.col("kind").isin("scalar", "series"), F.concat_ws(" ", "key", "unit")).alias("detail")),
        F.struct(F.lit("length").alias("rule"), F.when((F.col("kind") == "series") & (F.col("n_t") != F.col("n_values")), F.col("key")).alias("detail")),
        F.struct(F.lit("basis").alias("rule"), F.when((F.col("kind") == "series") & F.col("timeline_basis").isNull(), F.col("key")).alias("detail")),
    )).alias("x"))
    status, code = F.col("status"), F.col("error_code")
    known = status.isin(*STATUSES)
    right = F.lit(False)
    for s, codes in ERRORS_OF_STATUS.items():
        right = right | ((status == s) & code.isin(*codes))
    failed = status.isin(*ERRORS_OF_STATUS)
    cover = F.col("coverage")
    own = envelopes.select(*key, F.explode(F.array(
        F.struct(F.lit("status").alias("rule"), F.when(~F.coalesce(known, F.lit(False)), F.coalesce(status, F.lit("none"))).alias("detail")),
        F.struct(F.lit("coverage").alias("rule"), F.when(F.isnan(cover) | ~cover.between(0.0, 1.0), cover.cast("string")).alias("detail")),
        F.struct(F.lit("evidence").alias("rule"), F.when((status == "DEGRADED") & cover.isNull() & (F.coalesce(F.size("warnings"), F.lit(0)) <= 0), F.lit("no coverage or warning")).alias("detail")),
        F.struct(F.lit("error").alias("rule"), F.when(failed & ~F.coalesce(right, F.lit(False)), F.coalesce(code, F.lit("none"))).alias("detail")),
        F.struct(F.lit("no_error").alias("rule"), F.when(~failed & code.isNotNull(), code).alias("detail")),
    )).alias("x"))
    return own.unionByName(items).where("x.detail is not null").select(*key, "x.rule", "x.detail")


def consumed_check(envelopes: DataFrame, payload: DataFrame, resolution: DataFrame, versions: dict[str, str], requirements: tuple[Requirement, ...]) -> DataFrame:
    """(pair_id, algorithm_id, rule, detail) of an envelope against its algorithm and what was there: `algorithm` not
    registered; `version` another one; `required` (the list differs from the algorithm's); `available` (a port was
    consumed that the pair has not); `declared` (one that the algorithm does not require); `key` (blank or repeated).
    resolution has pair_id, algorithm_id and available (array), as input_resolution gives them."""
    key = ["pair_id", "algorithm_id"]
    of = {a: tuple(r.port_id for r in requirements if r.algorithm_id == a and r.required) for a in versions}
    wanted = F.create_map(*(c for a, p in of.items() for c in (F.lit(a), _strings(p))))
    version = F.create_map(*(F.lit(x) for pair in versions.items() for x in pair))
    e = envelopes.join(resolution.select(*key, "available"), key, "left").withColumn("wanted", F.try_element_at(wanted, F.col("algorithm_id")))
    none = F.array().cast("array<string>")
    missing = lambda a, b: F.array_join(F.array_except(F.coalesce(a, none), F.coalesce(b, none)), ",")
    told = lambda rule, broken, detail: F.struct(F.lit(rule).alias("rule"), F.when(F.col("wanted").isNotNull() & broken, detail).alias("detail"))
    rules = F.array(
        F.struct(F.lit("algorithm").alias("rule"), F.when(F.col("wanted").isNull(), F.col("algorithm_id")).alias("detail")),
        told("version", F.try_element_at(version, F.col("algorithm_id")) != F.col("algorithm_version"), F.col("algorithm_version")),
        told("required", ~F.coalesce(F.col("required_ports") == F.col("wanted"), F.lit(False)), F.array_join(F.coalesce("required_ports", none), ",")),
        told("available", missing(F.col("consumed_ports"), F.col("available")) != "", missing(F.col("consumed_ports"), F.col("available"))),
        told("declared", missing(F.col("consumed_ports"), F.col("wanted")) != "", missing(F.col("consumed_ports"), F.col("wanted"))),
    )
    own = e.select(*key, F.explode(rules).alias("x")).where("x.detail is not null").select(*key, "x.rule", "x.detail")
    blank = payload.where(F.coalesce("key", F.lit("")) == "").select(*key, F.lit("key").alias("rule"), F.lit("").alias("detail")).distinct()
    twice = payload.where("key <> ''").groupBy(*key, "key").agg(F.count("*").alias("n")).where("n > 1").select(*key, F.lit("key").alias("rule"), F.col("key").alias("detail"))
    return own.unionByName(blank).unionByName(twice)


def _passes(need: Column, port: Column) -> Column:
    """Whether a port is the one that is needed and has what is asked of it."""
    open_or = lambda name: need[name].isNull() | F.coalesce(need[name] == port[name], F.lit(False))
    return (
        (need["port_id"] == port["port_id"]) & ((need["schema_version"] == "*") | F.coalesce(need["schema_version"] == port["schema_version"], F.lit(False)))
        & open_or("timeline_basis") & open_or("element_type") & open_or("sample_rate")
        & (F.size(F.array_except(need["required_fields"], F.coalesce(port["field_names"], F.array().cast("array<string>")))) == 0)
    )


def declared(requirements: tuple[Requirement, ...]) -> Column:
    """The requirements as an array column."""
    kinds = {"required": "boolean", "sample_rate": "int"}
    one = lambda r: F.struct(*((_strings(v) if n == "required_fields" else F.lit(v).cast(kinds.get(n, "string"))).alias(n) for n, v in r._asdict().items()))
    return F.array(*map(one, requirements))


def input_resolution(pairs: DataFrame, ports: DataFrame, requirements: tuple[Requirement, ...]) -> DataFrame:
    """(pair_id, algorithm_id, status, available, missing_optional, incompatible_required) for each pair and algorithm.
    A port counts if it exists and its schema, timeline, element type, fields and sample rate are as asked; status is
    INCOMPATIBLE if a required one does not, else OK, whatever optional ones are missing. Lists keep the order declared."""
    columns = ("port_id", "schema_version", "timeline_basis", "element_type", "field_names", "sample_rate")
    have = ports.groupBy("pair_id").agg(F.collect_list(F.struct(*columns)).alias("ports"))  # the closed set of ports of a pair
    joined = pairs.select("pair_id").join(have, "pair_id", "left")
    needs = F.transform(declared(requirements), lambda n: F.struct(n["algorithm_id"].alias("algorithm_id"), n["port_id"].alias("port_id"), n["required"].alias("required"), F.coalesce(F.exists("ports", lambda p: _passes(n, p)), F.lit(False)).alias("passes")))
    algorithms = tuple(dict.fromkeys(r.algorithm_id for r in requirements))
    rows = joined.select("pair_id", needs.alias("needs")).select("pair_id", "needs", F.explode(_strings(algorithms)).alias("algorithm_id"))
    ids = lambda keep: F.transform(F.filter("needs", lambda n: (n["algorithm_id"] == F.col("algorithm_id")) & keep(n)), lambda n: n["port_id"])
    rows = rows.select("pair_id", "algorithm_id", ids(lambda n: n["passes"]).alias("available"), ids(lambda n: ~n["passes"] & ~n["required"]).alias("missing_optional"), ids(lambda n: ~n["passes"] & n["required"]).alias("incompatible_required"))
    return rows.withColumn("status", F.when(F.size("incompatible_required") > 0, "INCOMPATIBLE").otherwise("OK"))


def algorithm_selection(requests: DataFrame, registry: tuple[str, ...]) -> DataFrame:
    """(request_id, algorithm_id, rank, error_code) of requests (request_id, names ARRAY<STRING>): the named algorithms in
    the registry's order (rank from 0), all if names is null; UNKNOWN_ALGORITHM for a name that is not registered;
    EMPTY_SELECTION for a request of none, EMPTY_REGISTRY where nothing is registered at all."""
    known = _strings(registry)
    ranked = F.transform(F.sequence(F.lit(0), F.lit(max(0, len(registry) - 1))), lambda i: F.struct(F.get(known, i).alias("algorithm_id"), i.alias("rank"), F.lit(None).cast("string").alias("error_code")))
    chosen = F.filter(ranked, lambda x: x["algorithm_id"].isNotNull() & (F.col("names").isNull() | F.array_contains(F.col("names"), F.coalesce(x["algorithm_id"], F.lit("")))))
    error = lambda name, code: F.struct(name.cast("string").alias("algorithm_id"), F.lit(None).cast("int").alias("rank"), F.lit(code).alias("error_code"))
    strange = F.transform(F.array_except(F.coalesce("names", F.array().cast("array<string>")), known), lambda n: error(n, "UNKNOWN_ALGORITHM"))
    none = F.lit(None)
    rows = F.when(F.lit(not registry), F.array(error(none, "EMPTY_REGISTRY"))).when(F.size("names") == 0, F.array(error(none, "EMPTY_SELECTION"))).otherwise(F.concat(chosen, strange))
    return requests.select("request_id", F.explode(rows).alias("x")).select("request_id", "x.algorithm_id", "x.rank", "x.error_code")


def port_set_equality(pairs: DataFrame, ports: DataFrame, declared_ports: tuple[str, ...]) -> DataFrame:
    """(pair_id, port_id, side): ports that are declared and `missing`, and those that are there and `extra`."""
    have = ports.groupBy("pair_id").agg(F.collect_set("port_id").alias("have"))
    rows = pairs.select("pair_id").join(have, "pair_id", "left").withColumn("have", F.coalesce("have", F.array().cast("array<string>")))
    one = lambda a, b, side: F.transform(F.array_except(a, b), lambda p: F.struct(p.alias("port_id"), F.lit(side).alias("side")))
    want = _strings(declared_ports)
    return rows.select("pair_id", F.explode(F.concat(one(want, F.col("have"), "missing"), one(F.col("have"), want, "extra"))).alias("x")).select("pair_id", "x.port_id", "x.side")


def port_intersection(ports: DataFrame, requirements: tuple[Requirement, ...]) -> DataFrame:
    """(port_id, exists): each declared port, and whether any pair has it."""
    session = ports.sparkSession
    want = session.createDataFrame([(p,) for p in dict.fromkeys(r.port_id for r in requirements)], "port_id string")
    have = ports.select("port_id").distinct().withColumn("exists", F.lit(True))
    return want.join(have, "port_id", "left").select("port_id", F.coalesce("exists", F.lit(False)).alias("exists"))
