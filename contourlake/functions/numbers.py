"""Rounding and random numbers with the semantics of 64-bit floats in scripting languages."""

from __future__ import annotations

from decimal import ROUND_HALF_UP, Decimal
from functools import lru_cache

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

#: Multiplier and increment of the linear congruential generator, modulus 2^32 (fixed values).
LCG_A, LCG_C = 1664525, 1013904223


def round_half_up(x: Column) -> Column:
    """To the nearest integer, halves towards plus infinity."""
    return F.floor(x + F.lit(0.5))


@lru_cache(1 << 16)
def fixed(value: float, digits: int) -> str:
    """Decimal text by the exact binary value, halves away from zero; zero has no sign, small negatives keep theirs."""
    if value != value or value in (float("inf"), float("-inf")):
        return {"inf": "Infinity", "-inf": "-Infinity"}.get(str(value), "NaN")
    # only an odd multiple of 2^-(digits + 1) lies halfway between two texts; formatting rounds these to even
    if value * (2 << digits) % 2 != 1:
        return "%.*f" % (digits, value + 0.0)
    text = str(Decimal(value).quantize(Decimal(1).scaleb(-digits), ROUND_HALF_UP))
    return text if value else text.lstrip("-")


def to_fixed(x: Column, digits: int) -> Column:
    """`fixed` as a column; built-in rounding works on the shortest decimal form, which differs at near-halves."""

    @F.pandas_udf("string")
    def run(s: pd.Series) -> pd.Series:
        return s.map(lambda v: None if pd.isna(v) else fixed(float(v), digits))

    return run(x.cast("double"))


def halves_fixed(x: Column) -> Column:
    """Two-decimal text of multiples of a half (and of any value with two exact decimals), without Python."""
    return F.format_string("%.2f", x.cast("double") + F.lit(0.0))


def round_to(value: float, digits: int) -> float:
    return float(fixed(value, digits))


def lcg_next(state: Column) -> Column:
    """The generator's next state, as a bigint below 2^32."""
    return F.pmod(state.cast("long") * F.lit(LCG_A) + F.lit(LCG_C), F.lit(1 << 32))


def lcg_draws(seed: Column, n: int) -> Column:
    """The first n draws in [0, 1)."""
    state = F.aggregate(
        F.sequence(F.lit(1), F.lit(n)),
        F.struct(seed.cast("long").alias("s"), F.array().cast("array<double>").alias("out")),
        lambda acc, _: F.struct(lcg_next(acc["s"]).alias("s"), F.concat(acc["out"], F.array(lcg_next(acc["s"]).cast("double") / float(1 << 32))).alias("out")),
    )
    return state["out"]


class Lcg:
    """The same generator on the driver or in a worker."""

    def __init__(self, seed: int):
        self.state = seed & 0xFFFFFFFF

    def __call__(self) -> float:
        self.state = (self.state * LCG_A + LCG_C) & 0xFFFFFFFF
        return self.state / (1 << 32)
