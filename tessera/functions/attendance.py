"""Rules of a day's attendance and of the policies behind it, as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .measure import rounded_hours


def resolved(sources: list[tuple[str, Column]], default: Column) -> tuple[Column, Column]:
    """(value, source): the first of the labelled sources that isn't null, and its label; else the default and SYSTEM_DEFAULT."""
    value, label = default, F.lit("SYSTEM_DEFAULT")
    for name, c in reversed(sources):
        value, label = F.when(c.isNotNull(), c).otherwise(value), F.when(c.isNotNull(), F.lit(name)).otherwise(label)
    return value, label


def day(
    punch_in: Column, punch_out: Column, shift_start: Column, shift_end: Column, *, kind: Column, breaks: Column, grace: Column, early_tolerance: Column, half_day: Column, full_day: Column, max_late: Column, rounding: str = "NONE", lop: Column | None = None,
    late_deduction: Column | None = None, early_deduction: Column | None = None,
) -> dict[str, Column]:
    """A day's status and figures, by twelve steps in order. Times are minutes of the day, thresholds hours.

    kind: WORK, HOLIDAY, WEEK_OFF or LEAVE. Without a punch in the day is its kind, or ABSENT;
    without a punch out it is INCOMPLETE. Lateness counts beyond the grace, only on work days,
    and beyond `max_late` minutes the day is ABSENT. Full days are PRESENT or LATE, half ones
    HALF_DAY, less is LOP if `lop` says so, else EARLY_EXIT. Overtime is what goes beyond a full day.
    """
    lop = F.lit(False) if lop is None else lop
    worked_minutes = F.greatest(punch_out - punch_in - F.coalesce(breaks, F.lit(0)), F.lit(0))
    hours = rounded_hours(worked_minutes, rounding) if rounding != "NONE" else worked_minutes / 60.0
    late_by = punch_in - shift_start
    counts = kind == "WORK"
    complete = punch_in.isNotNull() & punch_out.isNotNull()
    too_late = complete & counts & (late_by > max_late)
    late = complete & counts & (late_by > grace)
    early = complete & counts & (shift_end - punch_out > early_tolerance)
    status = (
        F.when(punch_in.isNull(), F.when(kind.isin("HOLIDAY", "WEEK_OFF"), kind).when(kind == "LEAVE", "ON_LEAVE").otherwise("ABSENT"))
        .when(punch_out.isNull(), "INCOMPLETE")
        .when(too_late, "ABSENT")
        .when(hours >= full_day, F.when(late, "LATE").otherwise("PRESENT"))
        .when(hours >= half_day, "HALF_DAY")
        .when(lop, "LOP")
        .otherwise("EARLY_EXIT")
    )
    worked = F.when(complete, hours).otherwise(0.0)
    figure = lambda flag, minutes: F.when(flag, minutes).otherwise(0)
    return {
        "status": status, "is_late": F.coalesce(late, F.lit(False)), "late_minutes": figure(late, late_by), "is_early_exit": F.coalesce(early, F.lit(False)), "early_minutes": figure(early, shift_end - punch_out), "worked_hours": worked,
        "overtime_hours": F.when(too_late, 0.0).otherwise(F.greatest(worked - full_day, F.lit(0.0))), "late_deduction": F.when(late, F.lit(None) if late_deduction is None else late_deduction), "early_deduction": F.when(early, F.lit(None) if early_deduction is None else early_deduction),
    }
