"""Readable texts for sizes, times, rates and size ranges, over a column name or SQL expression."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Units of the size texts.
BYTE_UNITS = ["B", "KiB", "MiB", "GiB", "TiB", "PiB"]


def _bytes_text(size: str) -> str:
    scaled = [f"concat(format_number({size} / {1024**power}D, '0.00'), ' {unit}')" for power, unit in enumerate(BYTE_UNITS)]
    steps = " ".join(f"WHEN {size} < {1024 ** (power + 1)}L THEN {scaled[power]}" for power in range(1, 5))
    return f"CASE WHEN {size} < 1024 THEN concat({size}, ' B') {steps} ELSE {scaled[5]} END"


def human_bytes(size: str) -> Column:
    """``512 B``, ``1.50 KiB``, ... ``2048.00 PiB``."""
    return F.expr(_bytes_text(size))


def human_seconds(seconds: str) -> Column:
    """``2d 3h 0m 5s``; leading units that are zero are left out; ``n/a`` if undefined."""
    total = f"cast(rint({seconds}) AS bigint)"
    days, hours, minutes, rest = f"({total} div 86400)", f"({total} % 86400 div 3600)", f"({total} % 3600 div 60)", f"({total} % 60)"
    return F.expr(
        f"""CASE WHEN {seconds} >= 0 AND {seconds} < {2**63}D THEN concat_ws(' ',
          CASE WHEN {days} > 0 THEN concat({days}, 'd') END,
          CASE WHEN {hours} > 0 OR ({days} > 0 AND {total} % 3600 > 0) THEN concat({hours}, 'h') END,
          CASE WHEN {minutes} > 0 OR ({total} >= 3600 AND {rest} > 0) THEN concat({minutes}, 'm') END,
          concat({rest}, 's')) ELSE 'n/a' END"""
    )


def human_rate(bytes_per_second: str, prefer_units: str = "Gbps") -> Column:
    """``9.50 Gbps`` (bits) or, with ``prefer_units='MBps'``, ``1187.50 MB/s``."""
    if prefer_units.lower().startswith("g"):
        return F.expr(f"concat(format_number({bytes_per_second} * 8D / 1e9D, '0.00'), ' Gbps')")
    return F.expr(f"concat(format_number({bytes_per_second} / 1e6D, '0.00'), ' MB/s')")


def percent(part: str, whole: str) -> Column:
    """``100 * part / whole`` as a double, 0 when there is no whole."""
    return F.expr(f"CASE WHEN {whole} <> 0 THEN 100D * ({part}) / {whole} ELSE 0D END")


def span_label(low: str, high: str) -> Column:
    return F.expr(f"concat({_bytes_text(low)}, ' - ', {_bytes_text(high)})")


def interval_label(low: str, high: str, is_last: str) -> Column:
    closing = f"CASE WHEN {is_last} THEN ']' ELSE ')' END"
    return F.expr(f"concat('[', {_bytes_text(low)}, ', ', {_bytes_text(high)}, {closing})")
