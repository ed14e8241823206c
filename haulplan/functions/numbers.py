"""Exact numeric expressions, as SQL text over a column name or expression."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Leading bits kept by :func:`coarse_size` after the highest one.
COARSE_BITS = 10


def floor_log2(value: str) -> str:
    """Exponent of the highest set bit; values below 1 count as 1."""
    return f"(length(bin(greatest({value}, 1L))) - 1)"


def ceil_log2(value: str) -> str:
    """Smallest e with ``2**e >= value``; 0 for values below 2."""
    return f"(CASE WHEN {value} >= 2 THEN length(bin({value} - 1)) ELSE 0 END)"


def coarse_size(value: str, bits: int = COARSE_BITS) -> Column:
    """``value`` with only its leading ``bits + 1`` bits kept.

    Monotone in ``value`` and exact below ``2**(bits + 1)``, so it splits sizes
    into at most ``2**bits`` ordered buckets per power of two.
    """
    shift = f"greatest(length(bin(abs({value}))) - {bits + 1}, 0)"
    kept = f"shiftleft(shiftright(abs({value}), {shift}), {shift})"
    return F.expr(f"CASE WHEN {value} < 0 THEN -{kept} ELSE {kept} END")


def round_half_even(value: str, digits: int) -> Column:
    """Round a double to ``digits`` decimals by its binary value, a true tie going to the even digit.

    ``round`` and ``bround`` start from the shortest decimal text of a double and
    so move values that only look like a tie; number patterns do not.
    """
    return F.expr(f"cast(format_number({value}, '0.{'0' * digits}') AS double)")
