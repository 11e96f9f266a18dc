"""Names of helper columns that meet no column of the caller."""

from __future__ import annotations


def free_name(base: str, taken: list[str]) -> str:
    """``base``, with underscores behind it until no taken name equals it in any case."""
    low = {t.lower() for t in taken}
    while base.lower() in low:
        base += "_"
    return base
