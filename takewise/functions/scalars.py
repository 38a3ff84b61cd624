"""Scalar formulas over columns; native expressions, but for the two that have to agree with the C library to the last bit."""

from __future__ import annotations

import math
from collections.abc import Callable

import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType

from ..config import NOTE_NAMES


def _each(x: Column, formula: Callable[[float], float | None]) -> Column:
    """A formula of the C library on each value, null for null."""

    def run(values: pa.Array) -> pa.Array:
        return pa.array([None if v is None else formula(v) for v in values.to_pylist()], pa.float64())

    return F.arrow_udf(run, DoubleType())(x)


def exp2(x: Column) -> Column:
    """2 to the power of x; Spark's pow differs in the last bit of one value in ten."""
    return _each(x, lambda v: math.inf if v >= 1024 else math.pow(2.0, v))


def log2(x: Column) -> Column:
    """Null where x is not above 0; Spark's log2, a quotient of two logarithms, differs in the last bit of one value in three."""
    return _each(x, lambda v: math.log2(v) if v > 0 else None)


def rounded(x: Column, digits: int = 6) -> Column:
    """Rounded, and -0.0 as 0.0."""
    return F.round(x, digits) + F.lit(0.0)


def hz_to_cents(hz: Column, reference: Column) -> Column:
    """1200 * log2(hz / reference); null where either is not above 0."""
    return F.when((hz > 0) & (reference > 0), F.lit(1200.0) * F.log2(hz / reference))


def midi_to_hz(midi: Column) -> Column:
    return F.lit(440.0) * F.pow(F.lit(2.0), (midi - F.lit(69)) / F.lit(12.0))


def hz_to_midi(hz: Column) -> Column:
    return F.when(hz > 0, F.lit(69.0) + F.lit(12.0) * F.log2(hz / F.lit(440.0)))


def note_name(midi: Column) -> Column:
    names = F.array(*(F.lit(n) for n in NOTE_NAMES))
    return F.concat(F.element_at(names, F.pmod(midi, F.lit(12)).cast("int") + 1), (F.floor(midi / F.lit(12)) - 1).cast("bigint").cast("string"))


def to_db(x: Column, floor: float = 1e-4) -> Column:
    return F.lit(20.0) * F.log10(F.greatest(x, F.lit(floor)))


def pitch_class(hz: Column) -> Column:
    """Octave-blind class, 0 = C, rounding half to even."""
    return F.when(hz > 0, F.pmod(F.rint(hz_to_midi(hz)), F.lit(12.0)).cast("bigint"))


def port_prefix(port: Column) -> Column:
    return F.substring_index(port, ".", 1)
