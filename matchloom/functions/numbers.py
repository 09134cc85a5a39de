"""Numbers: dot products, clipped sigmoids, exact rank sums."""

from __future__ import annotations

import math
from fractions import Fraction

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T


def dot(a: Column, b: Column) -> Column:
    """Inner product of two arrays in double precision, from the first component on."""
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def length(v: Column) -> Column:
    return F.sqrt(dot(v, v))


def sigmoid(x: Column) -> Column:
    return 1.0 / (1.0 + F.exp(-F.greatest(F.lit(-40.0), F.least(F.lit(40.0), x))))


def linear(weights: dict[str, float], scales: dict[str, float] | None = None, instead: dict[str, Column] | None = None) -> Column:
    """Weighted sum of named columns, each divided by its scale; absent (null) features count as 0. instead: other columns for some names."""
    scales, instead = scales or {}, instead or {}
    out = F.lit(0.0)
    for name, w in weights.items():
        out = out + F.coalesce(instead.get(name, F.col(name)).cast("double"), F.lit(0.0)) * F.lit(w / scales.get(name, 1.0))
    return out


#: The smallest number that every 60 + rank, for ranks 1 to 20, divides: rank sums are then sums of integers, and ties are exact.
RRF_BASE, RRF_RANKS = 60, 20
RRF_LCM = math.lcm(*range(RRF_BASE + 1, RRF_BASE + RRF_RANKS + 1))


def rrf_units(rank: Column) -> Column:
    """1 / (60 + rank) in units of 1 / RRF_LCM, as a decimal; 0 for null and for ranks beyond 20."""
    table = F.create_map(*[x for r in range(1, RRF_RANKS + 1) for x in (F.lit(r), F.lit(str(RRF_LCM // (RRF_BASE + r))).cast("decimal(38,0)"))])
    return F.coalesce(F.element_at(table, rank.cast("int")), F.lit(0).cast("decimal(38,0)"))


#: Digits of the exact sum: sums of different value differ in them as long as the product of their denominators is below 10**RRF_DIGITS.
RRF_DIGITS = 81
#: Lists up to which the sum is made of decimals: the product of their denominators must be below 10**RRF_PRODUCT (four ranks of ten million each).
RRF_LISTS, RRF_PRODUCT, RRF_STEP = 4, 28, 9


@F.udf(returnType=T.StructType([T.StructField("units", T.StringType()), T.StructField("exact", T.StringType())]))
def _rrf_sum(ranks):
    own = [RRF_BASE + r for r in ranks if r is not None and r > 0]
    total = sum((Fraction(1, d) for d in own), Fraction(0))
    return str(sum(RRF_LCM // d for d in own)), str(total.numerator * 10**RRF_DIGITS // total.denominator).zfill(RRF_DIGITS + 6)


def _rrf_decimals(ranks: Column) -> Column:
    """The same by long division of one fraction."""
    whole = lambda x: x.cast("decimal(38,0)")
    quotient = lambda a, b: whole((a - a % b) / b)
    own = F.transform(F.filter(ranks, lambda r: r > 0), lambda r: whole(r + RRF_BASE))
    units = F.aggregate(own, whole(F.lit(0)), lambda s, d: whole(s + quotient(F.lit(str(RRF_LCM)).cast("decimal(38,0)"), d)))
    start = F.struct(whole(F.lit(0)).alias("n"), whole(F.lit(1)).alias("d"))
    fraction = F.aggregate(own, start, lambda s, d: F.struct(whole(s["n"] * d + s["d"]).alias("n"), whole(s["d"] * d).alias("d")))

    def digits(of: Column) -> Column:
        step = lambda s: whole(s["rest"] * 10**RRF_STEP)
        more = lambda s, _: F.struct(
            F.concat(s["digits"], F.lpad(quotient(step(s), of["d"]).cast("string"), RRF_STEP, "0")).alias("digits"), whole(step(s) % of["d"]).alias("rest")
        )
        long = F.aggregate(F.sequence(F.lit(1), F.lit(RRF_DIGITS // RRF_STEP)), F.struct(F.lit("0" * 6).alias("digits"), of["n"].alias("rest")), more)["digits"]
        return F.when(of["d"] < F.lit("1" + "0" * RRF_PRODUCT).cast("decimal(38,0)"), long).otherwise(F.raise_error("ranks are too large for an exact sum of decimals"))

    return F.struct(units.cast("string").alias("units"), F.transform(F.array(fraction), digits)[0].alias("exact"))


def rrf_sum(ranks: Column, lists: int | None = None) -> Column:
    """struct(units, exact) of an array of ranks of any size: 1 / (60 + rank) in whole units of 1 / RRF_LCM, summed, and the digits of the sum as one fraction.

    Strings of digits: equal sums have equal `exact`, which sorts as the sums do. Null ranks count for nothing. lists: the most ranks that an array has, if known; up to RRF_LISTS
    of them are summed without Python.
    """
    own = F.transform(ranks, lambda r: r.cast("long"))
    return _rrf_sum(own) if lists is None or lists > RRF_LISTS else _rrf_decimals(own)


def log_size(n: Column, most: int = 128) -> Column:
    return F.log1p(n.cast("double")) / math.log1p(most)


def capped(value: Column, most: float = 2.0) -> Column:
    """A value cut at `most`, as a share of it."""
    return F.least(value, F.lit(most)) / most
