"""Personal data: regular expressions propose spans, checksums confirm them, nearby words move the score.

Everything is built-in column expressions in one narrow stage: no shuffle, no Python, and the state of a row is its
own matches. A pattern runs twice over a text that holds a match (the matches, and the gaps between them by split);
offsets are prefix sums of their lengths, found by doubling in O(n log n) for n matches.

The patterns are those of the contract with possessive quantifiers, and with a guard that starts a match only where
a run of its characters starts or where the last match ended (\\G). Both leave the matches as they are: what stands
after each run cannot be in it, so a later start in the same run would fail in the same way. They keep long runs
linear, and Java's matcher from recursing once a repetition.

Defined results: a null or empty text has no spans; each row is treated by itself, so repeated rows and repeated or
null ids get the same spans as any; the input's other columns are kept out of the way (only id and text are read).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import text_of

# Kinds in their order, with their pattern, the words near a span that speak for it, and the score
# without and with such a word. A span counts from THRESHOLD on; the first four kinds always do.
KINDS = {
    "email": (
        r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
        r"\b(?:e-?mail|mailto|contact|write|reply)\b", 0.9, 1.0,
    ),
    "ip": (
        r"(?:\G|(?<![0-9]))[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++",
        r"\b(?:ip|host|server|address|ping|login)\b", 0.6, 0.9,
    ),
    "card": (
        r"[0-9](?:[\x20-]?[0-9])++",
        r"\b(?:card|credit|visa|mastercard|amex|payment|pay)\b", 0.7, 1.0,
    ),
    "phone": (
        r"\+[0-9][\x20().0-9-]+[0-9]",
        r"\b(?:phone|tel|call|mobile|fax|whatsapp)\b", 0.7, 0.95,
    ),
    "iban": (
        r"(?<![A-Za-z0-9])[A-Z]{2}[0-9]{2}(?:\x20?[A-Z0-9]{4}){2,7}(?:\x20?[A-Z0-9]{1,3})?(?![A-Za-z0-9])",
        r"\b(?:iban|account|bank|konto|cuenta|compte)\b", 0.8, 1.0,
    ),
    "ssn": (
        r"(?<![0-9-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![0-9-])",
        r"\b(?:ssn|social security|taxpayer)\b", 0.3, 0.9,
    ),
    "token": (
        r"(?<![A-Za-z0-9])(?:(?:AKIA|ASIA)[A-Z0-9]{16}|gh[pousr]_[A-Za-z0-9]{36}|glpat-[A-Za-z0-9_-]{20}|xox[abprs]-[A-Za-z0-9-]{10,}|AIza[A-Za-z0-9_-]{35})",
        r"\b(?:key|token|secret|credentials?)\b", 0.8, 1.0,
    ),
    "secret": (
        r"(?<![A-Za-z0-9])(?:password|passwd|secret|token|api[_-]?key|access[_-]?key)\x20{0,2}[:=]\x20{0,2}[\"']?[A-Za-z0-9+/_.-]{8,}",
        r"\b(?:login|config|env|export|credentials?)\b", 0.7, 0.9,
    ),
}
BASE = ("email", "ip", "card", "phone")
THRESHOLD = 0.5
#: Code points before a span in which context words are looked for, other matches among them.
CONTEXT = 40
#: The fewest code points of a match; with a gap of one or none they bound how many matches stand in a context.
SHORTEST = {"email": 5, "ip": 7, "card": 2, "phone": 4, "iban": 12, "ssn": 11, "token": 15, "secret": 14}


def _digits(value: Column) -> Column:
    return F.regexp_replace(value, "[^0-9]", "")


def _luhn(digits: Column) -> Column:
    """The check sum: every second digit from the right is doubled, less 9 if above 9; the sum ends in 0."""

    def add(total: Column, i: Column) -> Column:
        digit = F.substring(digits, i, F.lit(1)).cast("int")
        twice = digit * 2 - F.when(digit > 4, 9).otherwise(0)
        return total + F.when((F.length(digits) - i) % 2 == 1, twice).otherwise(digit)

    return F.aggregate(F.sequence(F.lit(1), F.length(digits)), F.lit(0), add) % 10 == 0


def _mod97(value: Column) -> Column:
    """ISO 7064: the first four characters go last, A is 10 and so on, and the number leaves 1 modulo 97."""
    plain = F.replace(value, F.lit(" "), F.lit(""))
    turned = F.concat(F.substr(plain, F.lit(5)), F.substr(plain, F.lit(1), F.lit(4)))

    def add(rest: Column, c: Column) -> Column:
        code = F.ascii(c)
        return F.when(code >= 65, (rest * 100 + code - 55) % 97).otherwise((rest * 10 + code - 48) % 97)

    return F.aggregate(F.split(turned, "(?!^)(?!$)"), F.lit(0), add) == 1


def _valid(kind: str, value: Column) -> Column:
    if kind == "ip":
        part = lambda p: F.length(F.regexp_replace(p, "^0+", "")) <= 3
        parts = F.split(value, r"\.")
        short = F.forall(parts, part)
        return F.when(short, F.forall(parts, lambda p: F.right(p, F.lit(3)).cast("int") <= 255)).otherwise(False)
    if kind == "card":
        digits = _digits(value)
        return F.when(F.length(digits).between(12, 19), _luhn(digits)).otherwise(False)
    if kind == "phone":
        return F.length(_digits(value)).between(9, 15)
    if kind == "iban":
        return F.when(F.length(F.replace(value, F.lit(" "), F.lit(""))).between(15, 34), _mod97(value)).otherwise(False)
    return F.lit(True)


def _prefix_sums(steps: Column) -> Column:
    """Running sums of an array: at pass k each element adds the one 2^k before it."""

    def double(sums: Column, k: Column) -> Column:
        far = F.pow(F.lit(2), k).cast("int")
        shifted = F.concat(F.array_repeat(F.lit(0), far), F.slice(sums, F.lit(1), F.size(sums) - far))
        return F.when(far < F.size(sums), F.zip_with(sums, shifted, lambda a, b: a + b)).otherwise(sums)

    return F.aggregate(F.sequence(F.lit(0), F.length(F.bin(F.size(steps).cast("long")))), steps, double)


def _pairs(kind: str, text: Column) -> Column:
    """Each match m with the gap g before it; null where there is none."""
    pattern = KINDS[kind][0]
    gaps = F.split(text, pattern, -1)
    pairs = F.zip_with(F.regexp_extract_all(text, F.lit(pattern), F.lit(0)), F.slice(gaps, F.lit(1), F.size(gaps) - 1), lambda m, g: F.struct(m.alias("m"), g.alias("g")))
    return F.when(text.rlike(pattern), pairs)


def _spans(kind: str, rank: int, pairs: Column) -> Column:
    """pairs is a column of _pairs, not an expression, as every span looks into it."""
    _, words, plain, raised = KINDS[kind]
    ends = _prefix_sums(F.transform(pairs, lambda p: F.length(p["m"]) + F.length(p["g"])))
    most = CONTEXT // SHORTEST[kind] + 1

    def placed(p: Column, i: Column) -> Column:
        earlier = F.slice(pairs, F.greatest(i + 1 - most, F.lit(1)), F.least(i, F.lit(most)))
        before = F.concat(F.array_join(F.transform(earlier, lambda q: F.concat(q["g"], q["m"])), ""), p["g"])
        near = F.when(F.length(p["g"]) >= CONTEXT, p["g"]).otherwise(before)
        return F.struct(p["m"].alias("m"), F.lower(F.right(near, F.lit(CONTEXT))).rlike(words).alias("near"))

    def span(p: Column, end: Column) -> Column:
        return F.struct(
            (end - F.length(p["m"])).alias("start"), F.lit(rank).alias("rank"), end.alias("end"), F.lit(kind).alias("kind"),
            p["m"].alias("value"), F.when(p["near"], raised).otherwise(plain).alias("score"),
        )

    spans = F.zip_with(F.transform(pairs, placed), ends, span)
    keep = lambda s: _valid(kind, s["value"]) & (F.lit(kind in BASE) | (s["score"] >= THRESHOLD))
    none = F.array().cast("array<struct<start:int,rank:int,end:int,kind:string,value:string,score:double>>")
    return F.when(pairs.isNotNull(), F.filter(spans, keep)).otherwise(none)


def _found(df: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(id, text, spans)"""
    docs = df.select(F.col(id_col).alias("id"), text_of(text_col).alias("text"))
    docs = docs.select("id", "text", *(_pairs(k, F.col("text")).alias(k) for k in KINDS))
    docs = docs.select("id", "text", *(_spans(k, i, F.col(k)).alias(k) for i, k in enumerate(KINDS)))
    return docs.select("id", "text", F.array_sort(F.concat(*(F.col(k) for k in KINDS))).alias("spans"))


def find_personal_data(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, spans): spans has the start, end (code points, end exclusive), kind, value and score of each, by start
    and then kind in the order of KINDS; spans of different kinds may overlap."""
    return _found(df, id_col, text_col).select(F.col("id").alias(id_col), "spans")


def redact(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, text) with each span replaced by its kind in brackets; of overlapping spans the first one counts."""
    docs = _found(df, id_col, text_col)
    state = F.struct(F.lit("").alias("out"), F.lit(0).alias("at"))

    def step(acc: Column, s: Column) -> Column:
        return F.when(s["start"] < acc["at"], acc).otherwise(F.struct(
            F.concat(acc["out"], F.substr(F.col("text"), acc["at"] + 1, s["start"] - acc["at"]), F.lit("["), s["kind"], F.lit("]")).alias("out"),
            s["end"].alias("at"),
        ))

    done = F.aggregate("spans", state, step, lambda acc: F.concat(acc["out"], F.substr(F.col("text"), acc["at"] + 1)))
    return docs.select(F.col("id").alias(id_col), done.alias(text_col))


def digest(df: DataFrame) -> DataFrame:
    """The contract's columns of find_personal_data's rows."""
    listed = lambda spans: F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")
    base = F.filter("spans", lambda s: s["kind"].isin(*BASE))
    count = lambda kind: F.size(F.filter("spans", lambda s: s["kind"] == kind))
    return df.select(
        "doc_id",
        *(count(k).cast("long").alias(f"n_{k}") for k in BASE),
        F.size("spans").cast("long").alias("n_spans"),
        F.sha2(listed(base).cast("binary"), 256).alias("base_sha256"),
        listed(F.col("spans")).alias("spans"),
    )
