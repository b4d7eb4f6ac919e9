"""Geometry, money and time arithmetic as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

EARTH_METRES = 6_371_000


def haversine(lat1: Column, lon1: Column, lat2: Column, lon2: Column) -> Column:
    h = F.pow(F.sin(F.radians(lat2 - lat1) / 2), 2) + F.cos(F.radians(lat1)) * F.cos(F.radians(lat2)) * F.pow(F.sin(F.radians(lon2 - lon1) / 2), 2)
    return 2 * EARTH_METRES * F.atan2(F.sqrt(h), F.sqrt(1 - h))


def iou(a: str, b: str) -> Column:
    """Of two box structs (x, y, width, height) by column name; 0 where both are empty."""

    def side(at, size):
        lo = F.greatest(F.col(f"{a}.{at}"), F.col(f"{b}.{at}"))
        hi = F.least(F.col(f"{a}.{at}") + F.col(f"{a}.{size}"), F.col(f"{b}.{at}") + F.col(f"{b}.{size}"))
        return F.greatest(F.lit(0.0), hi - lo)

    both = side("x", "width") * side("y", "height")
    union = F.col(f"{a}.width") * F.col(f"{a}.height") + F.col(f"{b}.width") * F.col(f"{b}.height") - both
    return F.when(union > 0, both / union).otherwise(0.0)


def half_up(x: Column, digits: int = 0) -> Column:
    """Rounding by floor(x + 0.5), also below zero."""
    scale = float(10**digits)
    return F.floor(x * scale + 0.5) / scale


def rounded_pay(x: Column, mode: str) -> Column:
    return {"rupee": half_up(x), "half": F.floor(x * 2 + 0.5) / 2, "paise": half_up(x, 2)}[mode]


def fiscal_year(day: Column) -> Column:
    """Year in which the fiscal year from April starts."""
    return F.year(F.add_months(day, -3))


def fiscal_quarter(day: Column) -> Column:
    return F.quarter(F.add_months(day, -3))


def band(value: Column, bounds: list[float], labels: list[str]) -> Column:
    """The first label whose bound is above the value; the last label beyond all bounds."""
    out = F.lit(labels[-1])
    for bound, label in reversed(list(zip(bounds, labels[:-1], strict=True))):
        out = F.when(value < bound, label).otherwise(out)
    return out


def in_quiet_hours(minute: Column, start: int, end: int) -> Column:
    """Minutes of the day; the interval may pass midnight."""
    return ((minute >= start) & (minute < end)) if start <= end else ((minute >= start) | (minute < end))


def minute_of_day(ts: Column) -> Column:
    return F.hour(ts) * 60 + F.minute(ts)


def rounded_hours(minutes: Column, mode: str) -> Column:
    step = {"NEAREST_15": 15, "NEAREST_30": 30, "FLOOR_15": 15, "CEIL_15": 15}[mode]
    units = minutes / step
    whole = {"NEAREST": F.floor(units + 0.5), "FLOOR": F.floor(units), "CEIL": F.ceil(units)}[mode.split("_")[0]]
    return whole * step / 60
