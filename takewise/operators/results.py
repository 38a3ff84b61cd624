"""Running of metrics, and assembly of their results. All failures are rows.

Scalars are rows (pair_id, algorithm_id, rank, ord, key, label, value, unit, threshold), rank and ord giving the order of
algorithms and of items; series have pair_id, algorithm_id, rank, ord, key, label, unit, timeline_basis, source_port and,
a row each, idx (from 0), t and value.
"""

from __future__ import annotations

from collections.abc import Callable
from typing import NamedTuple

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from ..config import ANCHOR_TOLERANCE, BASES, BUDGET_BYTES, SERIES_POINTS
from ..functions.scalars import hz_to_cents, port_prefix
from .checks import Requirement, input_resolution


#: Rows of a port that one leaf of its hash tree holds, leaves of a node.
HASH_CHUNK = 4096


class Metric(NamedTuple):
    version: str
    needs: tuple[str, ...]
    run: Callable[[dict[str, DataFrame]], DataFrame]
    requirements: tuple[Requirement, ...]
    label: str


class MetricRegistry:
    """Metrics by id, in the order of their registration; a metric is a function from named tables to a DataFrame
    (pair_id, key, value) and declares the tables, and the ports of a pair, that it needs."""

    def __init__(self):
        self.metrics: dict[str, Metric] = {}

    def register(self, name: str, version: str, needs: tuple[str, ...], metric: Callable[[dict[str, DataFrame]], DataFrame], requirements: tuple[Requirement, ...] = (), label: str = "") -> None:
        if name in self.metrics:
            raise ValueError(f"metric {name} is registered already")
        self.metrics[name] = Metric(version, needs, metric, requirements, label or name)

    def run(self, tables: dict[str, DataFrame], names: list[str] | None = None) -> DataFrame:
        """(pair_id, algorithm_id, key, value) of the named metrics whose tables are all there, in one plan."""
        out = None
        for name, m in self.metrics.items():
            if (names is None or name in names) and all(n in tables for n in m.needs):
                rows = m.run(tables).select("pair_id", F.lit(name).alias("algorithm_id"), "key", F.col("value").cast("double").alias("value"))
                out = rows if out is None else out.unionByName(rows)
        if out is None:
            raise ValueError("no metric can run on these tables")
        return out

    def envelopes(self, pairs: DataFrame, ports: DataFrame, tables: dict[str, DataFrame], values: DataFrame, names: list[str] | None = None) -> DataFrame:
        """(pair_id, algorithm_id, algorithm_version, status, error_code, error_detail, n_values) for each pair and
        named metric; values are run()'s rows. INCOMPATIBLE where the pair has not the ports or the program not the
        tables, FAILED where a pair got no row, a null or a number that is none; no metric touches another's rows."""
        chosen = {n: m for n, m in self.metrics.items() if names is None or n in names}
        needs = tuple(r for m in chosen.values() for r in m.requirements)
        missing = {n: ",".join(t for t in m.needs if t not in tables) for n, m in chosen.items()}
        metrics = F.array(*(F.struct(F.lit(n).alias("algorithm_id"), F.lit(m.version).alias("algorithm_version"), F.lit(missing[n]).alias("no_table")) for n, m in chosen.items()))
        rows = pairs.select("pair_id", F.explode(metrics).alias("m")).select("pair_id", "m.*")
        if needs:
            resolved = input_resolution(pairs, ports, needs).select("pair_id", "algorithm_id", F.array_join("incompatible_required", ",").alias("no_port"))
            rows = rows.join(resolved, ["pair_id", "algorithm_id"], "left")
        else:
            rows = rows.withColumn("no_port", F.lit(""))
        odd = F.col("value").isNull() | F.isnan("value") | (F.abs("value") == float("inf"))
        got = values.groupBy("pair_id", "algorithm_id").agg(F.count("*").alias("n_values"), F.count_if(odd).alias("n_odd"))
        rows = rows.join(got, ["pair_id", "algorithm_id"], "left")
        lacks = F.concat_ws(",", F.nullif("no_table", F.lit("")), F.nullif(F.coalesce("no_port", F.lit("")), F.lit("")))
        n = F.coalesce("n_values", F.lit(0))
        failed = (n == 0) | (F.coalesce("n_odd", F.lit(0)) > 0)
        status = F.when(lacks != "", "INCOMPATIBLE").when(failed, "FAILED").otherwise("OK")
        return rows.select(
            "pair_id", "algorithm_id", "algorithm_version", status.alias("status"), F.when(lacks != "", "PLUGIN_INCOMPATIBLE").when(failed, "ALGORITHM_FAILED").alias("error_code"),
            F.when(lacks != "", lacks).when(n == 0, "no result").when(failed, "not a number").alias("error_detail"), F.when(status == "OK", n).otherwise(0).alias("n_values"),
        )


def project(envelopes: DataFrame, items: DataFrame) -> DataFrame:
    """(pair_id, algorithm_id, key, kind, value, unit, timeline_basis, problem): what a pair's envelopes show, keys being
    algorithm.key. An envelope that is not OK or DEGRADED shows nothing and leaves one row with its problem; an item
    has a problem, and isn't shown, if its key came before, if it is a series without a known timeline basis, or if the
    pair's first series has another. envelopes has status, error_code and error_detail; items pair_id, algorithm_id,
    rank, ord, key, kind, value, unit and timeline_basis."""
    good = F.col("status").isin("OK", "DEGRADED")
    told = F.concat_ws(", ", F.concat(F.lit("status="), "status"), F.concat(F.lit("error_code="), "error_code"), "error_detail")
    bad = envelopes.where(~F.coalesce(good, F.lit(False))).select("pair_id", "algorithm_id", told.alias("problem"))
    shown = items.join(envelopes.where(good).select("pair_id", "algorithm_id"), ["pair_id", "algorithm_id"], "left_semi").withColumn("key", F.concat_ws(".", "algorithm_id", "key"))
    order = W.partitionBy("pair_id").orderBy("rank", "ord")
    again = F.row_number().over(W.partitionBy("pair_id", "key").orderBy("rank", "ord")) > 1
    series = F.col("kind") == "series"
    known = F.coalesce(F.col("timeline_basis").isin(*BASES), F.lit(False))
    shown = shown.withColumn("again", again).withColumn("basis", F.when(series & ~F.col("again") & known, F.col("timeline_basis")))
    first = F.first("basis", True).over(order.rowsBetween(W.unboundedPreceding, 0))
    problem = F.when(F.col("again"), "key repeated").when(series & ~known, "timeline basis unknown").when(series & (F.col("timeline_basis") != first), "timeline basis mixed")
    columns = ("pair_id", "algorithm_id", "key", "kind", "value", "unit", "timeline_basis", "problem")
    return shown.withColumn("problem", problem).select(*columns).unionByName(bad, allowMissingColumns=True).select(*columns)


def run_view(builds: DataFrame, projected: DataFrame) -> DataFrame:
    """(pair_id, state, error_code, error_detail, n_scalars, n_series, success) of each pair of builds (pair_id, state,
    error_code, error_detail). Problems of the projection make ALGORITHM_RESULT_INVALID where there is no error yet. A
    run is a success if it has no error code and shows a scalar or a series."""
    clean = F.col("problem").isNull()
    problems = F.array_join(F.array_sort(F.collect_list(F.when(~clean, F.concat_ws(": ", F.coalesce("key", "algorithm_id"), "problem")))), "; ")
    got = projected.groupBy("pair_id").agg(F.count_if(clean & (F.col("kind") == "scalar")).alias("n_scalars"), F.count_if(clean & (F.col("kind") == "series")).alias("n_series"), F.nullif(problems, F.lit("")).alias("problems"))
    v = builds.join(got, "pair_id", "left")
    code = F.coalesce("error_code", F.when(F.col("problems").isNotNull(), "ALGORITHM_RESULT_INVALID"))
    n = lambda c: F.coalesce(c, F.lit(0)).alias(c)
    v = v.select("pair_id", "state", code.alias("error_code"), F.nullif(F.concat_ws("; ", "error_detail", "problems"), F.lit("")).alias("error_detail"), n("n_scalars"), n("n_series"))
    return v.withColumn("success", F.col("error_code").isNull() & (F.col("n_scalars") + F.col("n_series") > 0))


def run_state(built: Column, blocked: Column, has_source: Column) -> Column:
    return F.when(~built, "A_UNBUILT").when(blocked, "D_BLOCKED").when(~has_source, "B_NO_SOURCE").otherwise("C_HAS_DATA")


def group_scalars(scalars: DataFrame) -> DataFrame:
    """(pair_id, prefix, group_no, n, keys): scalars (pair_id, place, key) by what is before the key's first dot, groups
    by their first place, from 1, and keys by theirs; a key without a dot is in the group (none)."""
    prefix = F.when(F.contains("key", F.lit(".")), port_prefix(F.col("key"))).otherwise("(none)")
    keys = F.transform(F.array_sort(F.collect_list(F.struct("place", "key"))), lambda x: x["key"])
    groups = scalars.groupBy("pair_id", prefix.alias("prefix")).agg(F.min("place").alias("first"), F.count("*").alias("n"), keys.alias("keys"))
    return groups.select("pair_id", "prefix", F.row_number().over(W.partitionBy("pair_id").orderBy("first", "prefix")).alias("group_no"), "n", "keys")


def metric_table(series: DataFrame, algorithm: str, columns: dict[str, str]) -> DataFrame:
    """(pair_id, idx, axis, columns): an algorithm's series side by side by index, columns naming the end of each one's
    key; a pair has as many rows as its shortest series that is there, and axis is the first one's t."""
    key = F.col("key")
    name = F.coalesce(*(F.when(key == f"{algorithm}{end}", F.lit(c)) for c, end in columns.items()))
    s = series.select("pair_id", name.alias("name"), "idx", "t", "value").where("name is not null")
    shortest = s.groupBy("pair_id", "name").agg(F.count("*").alias("n")).groupBy("pair_id").agg(F.min("n").alias("n"))
    s = s.join(shortest, "pair_id").where("idx < n")
    axis = F.coalesce(*(F.max(F.when(F.col("name") == c, F.col("t"))) for c in columns))
    return s.groupBy("pair_id", "idx").agg(axis.alias("axis"), *(F.max(F.when(F.col("name") == c, F.col("value"))).alias(c) for c in columns))


def defect_matrix(defects: DataFrame, scalars: DataFrame, keys: list[str]) -> DataFrame:
    """(defect, keys): the mean of each scalar (key as algorithm.key) over the pairs with a defect (pair_id, defect)."""
    return defects.join(scalars, "pair_id").groupBy("defect").pivot("key", keys).agg(F.avg("value"))


def port_summary(tables: dict[str, tuple[DataFrame, int, int, str]]) -> DataFrame:
    """(pair_id, port_id, shape, frames, element_count, width, dtype), by counting the rows (pair_id, side) of each
    table; a table comes with its numbers a row, their bytes and their type, and makes a port a side."""
    out = None
    for name, (table, numbers, width, dtype) in tables.items():
        n = table.groupBy("pair_id", "side").agg(F.count("*").alias("frames"))
        shape = F.concat(F.col("frames").cast("string"), F.lit(f"x{numbers}" if numbers > 1 else ""))
        rows = n.select("pair_id", F.concat_ws(".", F.lit(name), "side").alias("port_id"), shape.alias("shape"), "frames", (F.col("frames") * numbers).alias("element_count"), F.lit(width).alias("width"), F.lit(dtype).alias("dtype"))
        out = rows if out is None else out.unionByName(rows)
    return out


def budget_check(ports: DataFrame, budget: int = BUDGET_BYTES) -> DataFrame:
    """(pair_id, bytes, error_code): only more than the budget fails."""
    size = F.sum(F.col("element_count") * F.col("width"))
    return ports.groupBy("pair_id").agg(size.alias("bytes"), F.when(size > budget, "CORE_BUILD_FAILED").alias("error_code"))


def content_hash(table: DataFrame, by: list[str], port: str, order: str, columns: list[str], chunk: int = HASH_CHUNK) -> DataFrame:
    """(by, content_hash): the root of a hash tree. Rows whose order (a whole number) has the same quotient by chunk are a
    leaf, the SHA-256 of their columns' text in order; so many leaves make a node, the SHA-256 of theirs; the root is that
    of a domain, the port, the number of rows and the nodes'. No row holds more than chunk items of a port, and a hot port
    is spread over its leaves; a port of chunk cubed rows has chunk nodes."""

    def folded(rows: DataFrame, text: str, head: tuple = (), of: tuple[str, ...] = ()) -> DataFrame:
        items = F.transform(F.array_sort(F.collect_list(F.struct("__at", text))), lambda x: x[text])
        whole = F.concat_ws("|", *head, F.sum("__n").cast("string"), F.array_join(items, ",")) if head else F.array_join(items, ",")
        return rows.groupBy(*by, *of).agg(F.sum("__n").alias("__n"), F.sha2(whole.cast("binary"), 256).alias("__digest"))

    up = F.floor(F.col("__at") / chunk)
    rows = table.select(*by, F.col(order).alias("__at"), F.concat_ws(":", *(F.col(c).cast("string") for c in columns)).alias("__text"), F.lit(1).cast("bigint").alias("__n"))
    leaves = folded(rows.withColumn("__up", up), "__text", of=("__up",)).withColumnRenamed("__up", "__at")
    nodes = folded(leaves.withColumn("__up", up), "__digest", of=("__up",)).withColumnRenamed("__up", "__at")
    root = folded(nodes, "__digest", (F.lit("takewise"), F.lit(port)))
    return root.select(*by, F.col("__digest").alias("content_hash"))


def determinism_check(first: DataFrame, second: DataFrame, by: list[str]) -> DataFrame:
    """(by, same): whether two runs' content hashes agree; what only one run has does not."""
    joined = first.select(*by, F.col("content_hash").alias("a")).join(second.select(*by, F.col("content_hash").alias("b")), by, "full")
    return joined.select(*by, F.coalesce(F.col("a") == F.col("b"), F.lit(False)).alias("same"))


def downsample(series: DataFrame, by: list[str], points: int = SERIES_POINTS) -> DataFrame:
    """series (by, idx, value) with idx from 0; longer ones keep points evenly spaced rows, both ends among them."""
    last = series.groupBy(*by).agg(F.max("idx").alias("__last"))
    j = lambda up: F.floor(F.col("idx") * (points - 1) / F.col("__last") + up).cast("bigint")
    target = lambda j: F.rint(j * F.col("__last") / (points - 1))
    near = [target(j(u)) == F.col("idx") for u in (-1, 0, 1)]
    keep = (F.col("__last") < points) | near[0] | near[1] | near[2]
    return series.join(last, by).where(keep).drop("__last")


def series_pairs(series: DataFrame) -> DataFrame:
    """(pair_id, base, ref_key, prac_key): keys that end in _reference and _practice (or _ref, _prac), the first of each."""
    base = F.regexp_replace("key", "_(reference|practice|ref|prac)$", "")
    ref = F.col("key").rlike("_(reference|ref)$")
    s = series.where(F.col("key").rlike("_(reference|practice|ref|prac)$")).select("pair_id", base.alias("base"), "key", ref.alias("is_ref"), "ord")
    first = F.row_number().over(W.partitionBy("pair_id", "base", "is_ref").orderBy("ord", "key"))
    s = s.withColumn("rn", first).where("rn = 1")
    one = lambda c, n: s.where(c).select("pair_id", "base", F.col("key").alias(n))
    return one(F.col("is_ref"), "ref_key").join(one(~F.col("is_ref"), "prac_key"), ["pair_id", "base"])


def unpaired_series(series: DataFrame) -> DataFrame:
    """(pair_id, key) of the series that series_pairs gives no partner."""
    keys = series_pairs(series).select("pair_id", F.explode(F.array("ref_key", "prac_key")).alias("key"))
    return series.select("pair_id", "key").join(keys, ["pair_id", "key"], "left_anti")


def frame_equivalence(a: DataFrame, b: DataFrame, key: list[str], by: str, over: float = 50.0) -> DataFrame:
    """Per group, of two variants (key, value, voiced): rows that only one has; largest, mean and 95th percentile of the
    absolute difference; correlation; agreement of voicing; and, where both are voiced, the frames and the median, 95th
    percentile and maximum of the difference in cents, and how many are over a limit."""
    both = a.select(*key, F.col("value").alias("x"), F.col("voiced").alias("va")).join(b.select(*key, F.col("value").alias("y"), F.col("voiced").alias("vb")), key, "full")
    gap = F.abs(F.col("x") - F.col("y"))
    cents = F.when((F.col("va") == 1) & (F.col("vb") == 1), F.abs(hz_to_cents(F.col("y"), F.col("x"))))
    return both.groupBy(by).agg(
        F.count_if(F.col("x").isNull() | F.col("y").isNull()).alias("n_missing"), F.max(gap).alias("max_gap"), F.avg(gap).alias("mean_gap"), F.percentile(gap, 0.95).alias("p95_gap"),
        F.corr("x", "y").alias("r"), F.avg((F.col("va") == F.col("vb")).cast("double")).alias("voiced_agreement"), F.count(cents).alias("n_both_voiced"),
        F.median(cents).alias("median_cents"), F.percentile(cents, 0.95).alias("p95_cents"), F.max(cents).alias("max_cents"), F.count_if(cents > over).alias("n_over"),
    )


def drift_report(current: DataFrame, recorded: DataFrame, by: list[str], tolerance: float = ANCHOR_TOLERANCE) -> DataFrame:
    """(by, expected, actual, match): recorded anchors (by, value) against current ones; one that is gone doesn't match."""
    joined = recorded.select(*by, F.col("value").alias("expected")).join(current.select(*by, F.col("value").alias("actual")), by, "left")
    return joined.select(*by, "expected", "actual", F.coalesce(F.abs(F.col("actual") - F.col("expected")) <= tolerance, F.lit(False)).alias("match"))


def lowest_check(current: DataFrame, expected: DataFrame, by: str, name: str, value: str) -> DataFrame:
    """(by, expected, actual, match): whether the named one has the group's lowest value (the least name of equals)."""
    lowest = current.where(F.col(value).isNotNull()).groupBy(by).agg(F.min_by(name, F.struct(value, name)).alias("actual"))
    joined = expected.select(by, F.col(name).alias("expected")).join(lowest, by, "left")
    return joined.select(by, "expected", "actual", F.coalesce(F.col("expected") == F.col("actual"), F.lit(False)).alias("match"))


def _curves(series: DataFrame) -> DataFrame:
    """A row for each series, its points as arrays in order."""
    head = ["pair_id", "rank", "ord", "key", "label", "unit", "timeline_basis", "source_port"]
    points = F.array_sort(F.collect_list(F.struct("idx", F.col("t").cast("double").alias("t"), F.col("value").cast("double").alias("value"))))
    s = series.groupBy(*head).agg(points.alias("p"))
    return s.select(*head, F.size("p").alias("n_points"), F.transform("p", lambda x: x["t"]).alias("t"), F.transform("p", lambda x: x["value"]).alias("values"))


def nested_document(views: DataFrame, scalars: DataFrame, series: DataFrame) -> DataFrame:
    """(pair_id, document): one JSON document a pair with schema_version, inputs, state, error_code and error_detail
    (left out where null), scalars and series, in order. views has pair_id, reference_uri, practice_uri, state,
    error_code and error_detail."""

    def gathered(rows: DataFrame, fields: list[str], name: str) -> DataFrame:
        items = F.array_sort(F.collect_list(F.struct("rank", "ord", F.struct(*fields).alias("item"))), lambda a, b: F.when(F.struct(a["rank"], a["ord"]) < F.struct(b["rank"], b["ord"]), -1).when(F.struct(a["rank"], a["ord"]) > F.struct(b["rank"], b["ord"]), 1).otherwise(0))
        return rows.groupBy("pair_id").agg(F.transform(items, lambda x: x["item"]).alias(name))

    s = gathered(scalars, ["key", "label", "value", "unit"], "scalars")
    c = gathered(_curves(series), ["key", "label", "unit", "timeline_basis", "source_port", "n_points", "t", "values"], "series")
    v = views.join(s, "pair_id", "left").join(c, "pair_id", "left")
    empty = lambda n, df: F.coalesce(n, F.array().cast(df.schema[n].dataType)).alias(n)
    inputs = F.struct(F.col("reference_uri").alias("reference"), F.col("practice_uri").alias("practice")).alias("inputs")
    return v.select("pair_id", F.to_json(F.struct(F.lit("2").alias("schema_version"), inputs, "state", "error_code", "error_detail", empty("scalars", s), empty("series", c))).alias("document"))


def report_lines(views: DataFrame, scalars: DataFrame, series: DataFrame, decimals: int = 6) -> DataFrame:
    """(pair_id, line_no, line): inputs, state, error if there is one, then `label = value unit (threshold x)` for each
    scalar and, for each series, its number of points, unit and what its time axis keeps. Numbers only, no verdicts."""
    number = lambda c: F.format_string(f"%.{decimals}f", F.col(c).cast("double"))
    line = lambda part, text, rank=F.lit(0), ord_=F.lit(0): (F.lit(part).alias("part"), rank.cast("int").alias("rank"), ord_.cast("int").alias("ord"), text.alias("line"))
    rows = views.select("pair_id", *line(0, F.concat(F.lit("reference "), "reference_uri", F.lit(", practice "), "practice_uri")))
    rows = rows.unionByName(views.select("pair_id", *line(1, F.concat(F.lit("state "), "state"))))
    rows = rows.unionByName(views.where("error_code is not null").select("pair_id", *line(2, F.concat_ws(" ", F.lit("error"), "error_code", F.concat(F.lit("- "), "error_detail")))))
    told = F.concat_ws(" ", F.concat("label", F.lit(" = "), number("value")), F.nullif("unit", F.lit("")), F.when(F.col("threshold").isNotNull(), F.concat(F.lit("(threshold "), number("threshold"), F.lit(")"))))
    rows = rows.unionByName(scalars.select("pair_id", *line(3, told, F.col("rank"), F.col("ord"))))
    axis = F.when(F.col("timeline_basis") == "REFERENCE", "source time kept").when(F.col("timeline_basis") == "WARPED", "time normalised").otherwise("not marked")
    curves = series.groupBy("pair_id", "rank", "ord", "label", "unit", "timeline_basis").agg(F.count("*").cast("string").alias("n"))
    told = F.concat("label", F.lit(": "), "n", F.lit(" points, t in seconds, "), "timeline_basis", F.lit(" ("), axis, F.lit(")"), F.coalesce(F.concat(F.lit(", values in "), F.nullif("unit", F.lit(""))), F.lit("")))
    rows = rows.unionByName(curves.select("pair_id", *line(4, told, F.col("rank"), F.col("ord"))))
    place = F.row_number().over(W.partitionBy("pair_id").orderBy("part", "rank", "ord", "line"))
    return rows.select("pair_id", place.cast("bigint").alias("line_no"), "line")
