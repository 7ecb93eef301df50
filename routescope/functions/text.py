"""Text helpers with fixed, engine-independent rules."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# The characters Python's str.strip() removes; the class reads the same in Java's regex and in RE2.
WHITE = r"[\t\n\x0B\f\r\x1c-\x20\x{85}\x{A0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]"


def strip(c: Column) -> Column:
    return F.regexp_replace(c, f"^{WHITE}+|{WHITE}+$", "")


def sort_key(id_: Column) -> list[Column]:
    """Digit ids first by number, then the others by code point; equal numbers by the id itself."""
    digits = id_.rlike("^[0-9]+$")
    return [F.when(digits, 0).otherwise(1), F.when(digits, id_.try_cast("decimal(38,0)")), id_]


def human_duration(s: Column) -> Column:
    """59.94 -> 59.9s; 119.7 -> 1m 60s (the rest is rounded after the split); 7260 -> 2h 1m."""
    minutes = F.floor(s / 60)
    short = F.format_string("%.1fs", F.bround(s, 1))
    middle = F.format_string("%dm %.0fs", minutes, F.bround(s - minutes * 60, 0))
    long = F.format_string("%dh %dm", F.floor(minutes / 60), minutes % 60)
    return F.when(s < 60, short).when(minutes < 60, middle).otherwise(long)


def human_bytes(n: Column) -> Column:
    """Steps of 1,024 with two decimals, B to TB; a half rounds to the even digit."""
    n = n.cast("double")
    out = F.format_string("%.2f TB", F.bround(n / 1024.0**4, 2))
    for i, unit in reversed(list(enumerate(("B", "KB", "MB", "GB")))):
        out = F.when(n < 1024.0 ** (i + 1), F.format_string(f"%.2f {unit}", F.bround(n / 1024.0**i, 2))).otherwise(out)
    return out
