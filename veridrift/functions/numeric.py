"""Numeric predicates whose answers are never NULL, and the tolerance used throughout."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

TOLERANCE = 1e-9


def holds(predicate: Column) -> Column:
    """The predicate, with NULL counted as false: a check must not pass for want of a value."""
    return F.coalesce(predicate, F.lit(False))


def number(value: Column) -> Column:
    """Double of a number, boolean or numeric string; ANSI mode raises on anything else."""
    return value.cast("double")


def finite(value: Column) -> Column:
    """Neither NULL, NaN nor infinite.  (Spark orders NaN above all, so it is tested apart.)"""
    return holds(~F.isnan(value) & (F.abs(value) < F.lit(float("inf"))))


def close(a: Column, b: Column, relative: float = TOLERANCE, absolute: float = TOLERANCE) -> Column:
    """Both finite, and apart by no more than the larger of the two tolerances."""
    scale = F.greatest(F.abs(a), F.abs(b)) * F.lit(relative)
    return finite(a) & finite(b) & holds(F.abs(a - b) <= F.greatest(scale, F.lit(absolute)))


def within(value: Column, low: float = 0.0, high: float = 1.0) -> Column:
    """Finite and between the bounds, both included."""
    return finite(value) & holds(value.between(low, high))


def dominated(value: Column, bound: Column, slack: float = TOLERANCE) -> Column:
    """``value`` isn't above ``bound`` by more than ``slack``."""
    return finite(value) & finite(bound) & holds(value <= bound + F.lit(slack))


def ratio(a: Column, b: Column) -> Column:
    """a / b, NULL where b is zero (ANSI mode would raise)."""
    return a / F.nullif(b, F.lit(0).cast("double"))
