"""Scalar arithmetic on columns."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F


def finite(x: Column) -> Column:
    """Whether x is neither null nor NaN nor infinite."""
    return x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf")))


def finite_or(x: Column, default: Column) -> Column:
    return F.when(finite(x), x).otherwise(default)


def round_half_up(x: Column, digits: int = 2) -> Column:
    """Rounds halves toward plus infinity."""
    return F.floor(x * 10**digits + 0.5) / 10**digits


def clamp(x: Column, low: float, high: float) -> Column:
    return F.least(F.lit(high), F.greatest(F.lit(low), x))


def quadratic(x: Column, a: float, b: float, c: float) -> Column:
    return (x * a + b) * x + c


def log_add(x: Column, y: Column, least: float = -36.0) -> Column:
    """log(exp(x) + exp(y)); the smaller does not count below `least` of the greater."""
    hi, lo = F.greatest(x, y), F.least(x, y)
    return F.when(lo - hi < least, hi).otherwise(hi + F.log1p(F.exp(lo - hi)))


def mel_htk(hz: Column) -> Column:
    return F.log(hz / 700 + 1) * 1127.0


def hz_htk(mel: Column) -> Column:
    return (F.exp(mel / 1127.0) - 1) * 700


#: The Slaney scale: linear up to 1000 Hz, then 27 steps per factor of 6.4.
_LINEAR, _BREAK, _STEP = 200.0 / 3, 1000.0, math.log(6.4) / 27


def mel_slaney(hz: Column) -> Column:
    return F.when(hz < _BREAK, hz / _LINEAR).otherwise(_BREAK / _LINEAR + F.log(F.greatest(hz, F.lit(1e-9)) / _BREAK) / _STEP)


def hz_slaney(mel: Column) -> Column:
    return F.when(mel < _BREAK / _LINEAR, mel * _LINEAR).otherwise(_BREAK * F.exp((mel - _BREAK / _LINEAR) * _STEP))


def vtln_warp(hz: Column, low_cut: float, high_cut: float, low: float, high: float, factor: float) -> Column:
    """Piecewise linear warp: frequencies scale by 1/factor in the middle and meet low and high at the ends."""
    left, right = low_cut * max(1.0, factor), high_cut * min(1.0, factor)
    scale = 1 / factor
    at_left, at_right = scale * left, scale * right
    below = low + (hz - low) * ((at_left - low) / (left - low))
    above = high + (hz - high) * ((high - at_right) / (high - right))
    return F.when((hz < low) | (hz > high), hz).when(hz < left, below).when(hz < right, hz * scale).otherwise(above)


def reflect(i: Column, n: Column) -> Column:
    """Index into n samples mirrored at both ends without end."""
    m = F.pmod(i, 2 * n)
    return F.when(m < n, m).otherwise(2 * n - 1 - m)


def power_of_two(n: Column) -> Column:
    """The least power of two that is n or more."""
    return F.when(n <= 1, F.lit(1).cast("long")).otherwise(F.pow(F.lit(2.0), F.ceil(F.log2(n.cast("double") - 0.5))).cast("long"))


def level_confidence(level: Column) -> tuple[Column, Column]:
    """Two linear maps of a level of 1 to 10."""
    x = clamp(level, 1, 10)
    return 0.5 - (x - 1) * 1.3 / 9, -1.5 + (x - 1) * 2 / 9
