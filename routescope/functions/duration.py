"""The printed form of a duration for driver-side reports; the column form is in ``text``."""

from __future__ import annotations


def printed(seconds: float) -> str:
    minutes, rest = divmod(seconds, 60)
    if seconds < 60:
        return f"{seconds:.1f}s"
    if minutes < 60:
        return f"{int(minutes)}m {rest:.0f}s"
    hours, minutes = divmod(int(minutes), 60)
    return f"{hours}h {minutes}m"
