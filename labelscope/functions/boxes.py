"""Bounding-box columns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from labelscope.domain import BOX, INVALID_BOX, MAX_IMAGE_SIDE, UNREADABLE


def whole_number(name: str, missing: str = "raise") -> Column:
    """A coordinate cut to its whole part.

    ``missing='raise'`` fails the job on a null; ``'quarantine'`` turns nulls and
    unreadable text into null instead.
    """
    if missing == "quarantine":
        return F.expr(f"try_cast(try_cast({name} AS double) AS bigint)")
    if missing != "raise":
        raise ValueError(f"missing must be 'raise' or 'quarantine', not {missing!r}")
    error = f"raise_error('{name} is missing; box coordinates must be numbers')"
    return F.expr(f"CASE WHEN {name} IS NULL THEN {error} ELSE cast(cast({name} AS double) AS bigint) END")


def valid_box() -> Column:
    x1, y1, x2, y2 = BOX
    return F.expr(f"coalesce({x2} > {x1} AND {y2} > {y1}, false)")


def clamped(width: str, height: str) -> list[str]:
    """SQL of the four sides of the box cut to the image."""
    x1, y1, x2, y2 = BOX
    return [
        f"greatest(0L, {x1})", f"greatest(0L, {y1})",
        f"least(cast({width} AS bigint), {x2})", f"least(cast({height} AS bigint), {y2})",
    ]


def crop_fail_reason(width: str, height: str, cached: str = "false") -> Column:
    """Why a box cannot be cut, null when it can; checked in this order."""
    x1, y1, x2, y2 = clamped(width, height)
    return (
        F.when(~valid_box(), INVALID_BOX)
        .when(F.expr(cached), None)
        .when(F.expr(f"{width} IS NULL OR {width} < 0"), UNREADABLE)
        .when(
            F.expr(f"{x2} <= {x1} OR {y2} <= {y1}"),
            F.expr(f"concat('Bbox clamped to empty region (', {x1}, ',', {y1}, ',', {x2}, ',', {y2}, ')')"),
        )
    )


def target_size(width: str, height: str, limit: int = MAX_IMAGE_SIDE) -> tuple[Column, Column]:
    """Size after shrinking the longest side to ``limit``; smaller images stay."""
    longest = f"greatest({width}, {height})"

    def fit(side: str) -> Column:
        small = f"cast({side} * (double({limit}) / {longest}) AS bigint)"
        return F.expr(f"CASE WHEN {longest} > {limit} THEN {small} ELSE cast({side} AS bigint) END")

    return fit(width), fit(height)
