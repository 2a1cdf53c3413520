"""Checks of plain arguments, with one wording for all callers."""

from __future__ import annotations

import math
from numbers import Integral, Real


def number_within(value: float, name: str, low: float = -math.inf, high: float = math.inf) -> float:
    """``value`` as a float if it is a finite number of [low, high]. True and False are not numbers."""
    if isinstance(value, bool) or not isinstance(value, Real):
        raise TypeError(f"{name}: a number is needed, not {type(value).__name__}")
    number = float(value)
    if math.isfinite(number) and low <= number <= high:
        return number
    raise ValueError(f"{name}: {number} is not a finite number from {low:g} to {high:g}")


def row_limit(value: int | None, name: str = "limit") -> int | None:
    """A count of rows of at least one, or None for all rows."""
    if value is None:
        return None
    if isinstance(value, bool) or not isinstance(value, Integral):
        raise TypeError(f"{name}: a whole number is needed, not {type(value).__name__}")
    if value < 1:
        raise ValueError(f"{name}: {value} asks for no rows")
    return int(value)
