"""Rounding that agrees with correctly rounded binary doubles (ties to even on the exact value)."""

from pyspark.sql import functions as F

_FINE = 2 ** 20


def once(value, build):
    """``build`` applied to the value, which then appears once in the plan however often it is used."""
    return F.get(F.transform(F.array(value), build), F.lit(0))


def exact_round(value, digits):
    """Round a double by its exact binary value; Spark's ``round`` works on the shortest decimal text instead.

    The value (times 2**20 while it is small) is split into a whole and a fraction, both exact, so the rest left
    after the candidate shows on which side of a tie the double lies. From 1e13 on a double has less than ten binary
    places and is exact as a whole number of 1024ths; from 2**52 on it is whole and so its own rounding.
    """
    return once(value.cast("double"), lambda v: _rounded(v, 10 ** digits))


def _rounded(value, power):
    scale = F.when(F.abs(value) < float(_FINE), F.lit(_FINE)).otherwise(F.lit(1))
    whole = F.floor(value * scale)
    exact = whole.cast("decimal(14,0)") + (value * scale - whole).cast("decimal(17,17)")
    candidate = F.floor(value * float(power))
    rest = exact * F.lit(power).cast("decimal(5,0)") - (candidate * scale).cast("decimal(18,0)")
    side = rest + rest - scale.cast("decimal(7,0)")
    up = (side > 0) | ((side == 0) & (candidate % 2 != 0))
    small = (candidate + up.cast("bigint")).cast("double") / float(power)
    return F.when(F.abs(value) < 1e13, small).when(F.abs(value) < 2.0 ** 52, _rounded_large(value, power)).otherwise(value)


def _rounded_large(value, power):
    parts = (value * 1024.0).cast("bigint").cast("decimal(19,0)") * F.lit(power).cast("decimal(5,0)")
    rest = F.pmod(parts, F.lit(1024).cast("decimal(4,0)"))
    candidate = ((parts - rest) / F.lit(1024).cast("decimal(4,0)")).cast("decimal(24,0)")
    up = (rest > 512) | ((rest == 512) & (candidate % F.lit(2).cast("decimal(1,0)") != 0))
    return ((candidate + up.cast("int").cast("decimal(1,0)")) / F.lit(power).cast("decimal(5,0)")).cast("double")


def fixed_text(value, digits):
    """The value with a fixed number of decimals, as text."""
    return F.format_string(f"%.{digits}f", exact_round(value, digits))


def percent_of(part, whole):
    """100 * part / whole as a double; 0 when the whole is 0."""
    return F.when(whole > 0, part.cast("double") / whole * 100.0).otherwise(F.lit(0.0))
