"""Colours as hex text, integer channels and packed keys."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Luminance weights, and the bounds of near-black, dark and light (fixed values).
WEIGHTS = (0.299, 0.587, 0.114)
NEAR_BLACK, DARK, LIGHT = 30, 55, 240


def _clamped(v: Column) -> Column:
    return F.least(F.lit(255), F.greatest(F.lit(0), v)).cast("int")


def hex_byte(v: Column) -> Column:
    return F.lower(F.lpad(F.hex(_clamped(v)), 2, "0"))


def rgb_to_hex(r: Column, g: Column, b: Column) -> Column:
    """#rrggbb, channels clamped to a byte."""
    return F.concat(F.lit("#"), hex_byte(r), hex_byte(g), hex_byte(b))


def channel(hex_: Column, index: int) -> Column:
    """Channel 0, 1 or 2 of #rrggbb as an int; 0 for digits that are none."""
    digits = F.substring(F.regexp_replace(hex_, "#", ""), 1 + 2 * index, 2)
    return F.when(digits.rlike("^[0-9a-fA-F]{1,2}$"), F.conv(digits, 16, 10).cast("int")).otherwise(0)


def hex_to_rgb(hex_: Column) -> Column:
    return F.struct(channel(hex_, 0).alias("r"), channel(hex_, 1).alias("g"), channel(hex_, 2).alias("b"))


def hex_to_unit(hex_: Column) -> Column:
    """Channels from 0 to 1."""
    return F.struct(*[(channel(hex_, k) / 255.0).alias(n) for k, n in enumerate("rgb")])


def packed(r: Column, g: Column, b: Column) -> Column:
    """(r << 16) | (g << 8) | b."""
    return F.shiftleft(r.cast("int"), 16).bitwiseOR(F.shiftleft(g.cast("int"), 8)).bitwiseOR(b.cast("int"))


def luminance(hex_: Column) -> Column:
    return channel(hex_, 0) * WEIGHTS[0] + channel(hex_, 1) * WEIGHTS[1] + channel(hex_, 2) * WEIGHTS[2]


def near_black(hex_: Column) -> Column:
    return F.when(luminance(hex_) < NEAR_BLACK, F.lit("#000000")).otherwise(hex_)


def distance2(r: Column, g: Column, b: Column, cr: Column, cg: Column, cb: Column) -> Column:
    return (r - cr) * (r - cr) + (g - cg) * (g - cg) + (b - cb) * (b - cb)


def alpha_hex(opacity: Column) -> Column:
    """An opacity from 0 to 1 as two hex digits."""
    return hex_byte(F.floor(F.least(F.lit(1.0), F.greatest(F.lit(0.0), opacity)) * 255 + 0.5))


def auto_palette_size(n: Column) -> Column:
    """4 colours below 12,000 pixels, 8 below 90,000, else 10."""
    return F.when(n < 12_000, 4).when(n < 90_000, 8).otherwise(10)


def requested_palette_size(n: Column) -> Column:
    return F.least(F.lit(16), F.greatest(F.lit(2), F.floor(n))).cast("int")


def layer_params(hex_: Column, speckle: float, tolerance: float, smoothing: float) -> Column:
    """Speckle size, tolerance, smoothing and least area of a layer: finer for dark and light colours."""
    lum = luminance(hex_)
    dark, light = lum < DARK, lum > LIGHT
    return F.struct(
        F.when(dark | light, F.lit(1)).otherwise(F.lit(speckle)).alias("speckle"),
        F.when(dark, F.lit(max(0.28, tolerance * 0.4))).when(light, F.lit(max(0.35, tolerance * 0.45))).otherwise(F.lit(tolerance)).alias("tolerance"),
        F.when(dark, F.lit(smoothing * 0.1)).when(light, F.lit(smoothing * 0.15)).otherwise(F.lit(smoothing)).alias("smoothing"),
        F.when(dark | light, F.lit(1)).otherwise(F.lit(8)).alias("min_area"),
    )
