"""Decimal rounding that agrees with correctly rounded half-even formatting.

``round`` in Spark works on the shortest decimal text of a double and rounds halves up, so
0.0625 to 3 digits, or 2.675 to 2 digits, come out differently from languages that round the
binary value. This one multiplies exactly (product plus its error term) and decides halves on
the true value. It is plain double arithmetic, so it stays in generated code.
"""

from pyspark.sql import Column, functions as F

_SPLIT = 134217729.0  # 2**27 + 1, cuts a double into two halves of 26 bits


def pround(value, digits: int) -> Column:
    """Round a double half-even on its exact value; ``digits`` from 0 to 8."""
    if not 0 <= digits <= 8:
        raise ValueError("digits must be between 0 and 8")
    x = (F.col(value) if isinstance(value, str) else value).cast("double")
    scale = float(10**digits)
    scaled = x * scale
    high = x * _SPLIT - (x * _SPLIT - x)
    error = (high * scale - scaled) + (x - high) * scale
    whole = F.floor(scaled)
    part = scaled - whole
    odd = F.pmod(whole, F.lit(2)) == 1
    up = (part > 0.5) | ((part == 0.5) & ((error > 0) | ((error == 0) & odd)))
    rounded = (whole + F.when(up, 1).otherwise(0)) / F.lit(scale)
    # Doubles this large have no such digits; NaN and infinities pass through as well.
    return F.when(F.abs(scaled) < 4.5e15, rounded).otherwise(x)
