"""Binary operators, monoids and semirings as builders of Column expressions."""

from __future__ import annotations

import math
from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Lists in which a group is folded by an operator that has no aggregate.
BUCKETS = 1024


def _nan() -> Column:
    return F.lit(float("nan"))


def _fraction(x: Column) -> Column:
    return x - F.floor(x)


def ieee_divide(a: Column, b: Column) -> Column:
    """Division by zero gives an infinity, or NaN for 0/0, rather than an error."""
    by_zero = F.when(F.isnan(a) | (a == 0), _nan()).when(a > 0, F.lit(math.inf)).otherwise(F.lit(-math.inf))
    return F.when(b != 0, F.try_divide(a, b)).otherwise(by_zero)


def _least(a: Column, b: Column) -> Column:
    return F.when(F.isnan(a) | F.isnan(b), _nan()).otherwise(F.least(a, b))


@dataclass(frozen=True)
class BinaryOp:
    name: str
    of: Callable[[Column, Column], Column]

    def __call__(self, a: Column, b: Column) -> Column:
        return self.of(a, b)


PLUS = BinaryOp("plus", lambda a, b: a + b)
MINUS = BinaryOp("minus", lambda a, b: a - b)
TIMES = BinaryOp("mul", lambda a, b: a * b)
DIVIDE = BinaryOp("div", ieee_divide)
MIN = BinaryOp("min", _least)
MAX = BinaryOp("max", lambda a, b: F.greatest(a, b))
MAXFRAC = BinaryOp("maxfrac", lambda a, b: F.when(_fraction(a) >= _fraction(b), a).otherwise(b))
FIRST = BinaryOp("first", lambda a, b: a)
SECOND = BinaryOp("second", lambda a, b: b)


@dataclass(frozen=True)
class Monoid:
    """An operator with its identity. `fold` is its aggregate; without one, lists of a group's values are folded in sorted order."""

    op: BinaryOp
    identity: float
    fold: Callable[[Column], Column] | None = None

    def __call__(self, a: Column, b: Column | None = None) -> Column:
        return self.op(a, F.lit(self.identity) if b is None else b)

    def aggregate(self, x: Column) -> Column:
        if self.fold:
            return self.fold(x)
        return F.aggregate(F.array_sort(F.collect_list(x)), F.lit(float(self.identity)), lambda acc, v: self.op(acc, v))

    def reduce(self, df: DataFrame, keys: list[str], x: Column, into: str, spread: Column) -> DataFrame:
        """(keys, into): x folded by keys. Without an aggregate of its own a group is folded in buckets of `spread` first, which only
        an associative and commutative operator allows, so that no list holds a whole hot group."""
        if self.fold:
            return df.groupBy(*keys).agg(self.fold(x).alias(into))
        bucket = F.pmod(F.xxhash64(spread), F.lit(BUCKETS)).alias("__bucket")
        once = df.select(*keys, x.alias(into), bucket).groupBy(*keys, "__bucket").agg(self.aggregate(F.col(into)).alias(into))
        return once.groupBy(*keys).agg(self.aggregate(F.col(into)).alias(into))


PLUS_MONOID = Monoid(PLUS, 0.0, F.sum)
TIMES_MONOID = Monoid(TIMES, 1.0, F.product)
MIN_MONOID = Monoid(MIN, float.fromhex("0x1.fffffffffffffp+1023"), F.min)
MAX_MONOID = Monoid(MAX, -float.fromhex("0x1.fffffffffffffp+1023"), F.max)
#: Ties go to the smallest value.
MAXFRAC_MONOID = Monoid(MAXFRAC, 0.0, lambda x: F.max_by(x, F.struct(_fraction(x), -x)))
FIRST_MONOID = Monoid(FIRST, 0.0)


@dataclass(frozen=True)
class Semiring:
    add: Monoid
    mul: BinaryOp


PLUS_TIMES = Semiring(PLUS_MONOID, TIMES)
PLUS_MIN = Semiring(PLUS_MONOID, MIN)
MIN_TIMES = Semiring(MIN_MONOID, TIMES)
MAXFRAC_PLUS = Semiring(MAXFRAC_MONOID, PLUS)
MIN_PLUS = Semiring(MIN_MONOID, PLUS)
SEMIRINGS = {"plus_mul": PLUS_TIMES, "plus_min": PLUS_MIN, "min_mul": MIN_TIMES, "maxfrac_plus": MAXFRAC_PLUS, "min_plus": MIN_PLUS}
