"""Shot geometry on a 105 x 68 m pitch; x runs to the attacked goal line, y across, both in [0, 1]."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from kickframe.functions.cols import col

LENGTH_M, WIDTH_M, HALF_GOAL_M = 105.0, 68.0, 3.66


def _offsets(x: Column | str, y: Column | str) -> tuple[Column, Column]:
    return (1 - col(x)) * LENGTH_M, (col(y) - 0.5) * WIDTH_M


def shot_distance_m(x: Column | str, y: Column | str) -> Column:
    dx, dy = _offsets(x, y)
    return F.hypot(dx, dy)


def shot_angle_deg(x: Column | str, y: Column | str) -> Column:
    """Opening angle between the posts."""
    dx, dy = _offsets(x, y)
    return F.degrees(F.abs(F.atan2(HALF_GOAL_M - dy, dx) - F.atan2(-HALF_GOAL_M - dy, dx)))


def is_header(shot_type: Column | str) -> Column:
    return F.coalesce(F.lower(col(shot_type)).contains("head"), F.lit(False)).cast("int")
