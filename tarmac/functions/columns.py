"""Column expressions.

Every function here returns a ``Column`` built from ``pyspark.sql.functions``
only, so all of it stays inside whole-stage code generation.  Operators take
column names (or Columns) as parameters; the flight schema is just the default.
"""

from __future__ import annotations

from itertools import chain

from pyspark.sql import Column
from pyspark.sql import functions as F

from tarmac.functions import constants as K


def _c(x) -> Column:
    return F.col(x) if isinstance(x, str) else x


# --- flags and targets (B4-B6) ---------------------------------------------

def delay_target(arr_delay="ArrDelay", threshold: int = K.DELAY_THRESHOLD_MINUTES) -> Column:
    """1 when the arrival delay is strictly above the threshold; null counts as on time."""
    return F.coalesce((_c(arr_delay) > threshold).cast("int"), F.lit(0))


def weekend_flag(day_of_week="DayOfWeek") -> Column:
    """1 for Saturday/Sunday with Monday = 1."""
    return (_c(day_of_week) >= 6).cast("int")


def iso_day_of_week(date_col) -> Column:
    """Monday = 1 .. Sunday = 7 (``dayofweek`` would start on Sunday)."""
    return (F.weekday(_c(date_col)) + 1).cast("int")


def positive_flag(x="DepDelay") -> Column:
    return (_c(x) > 0).cast("int")


# --- clock and calendar (C1, R1, R2) ----------------------------------------

def hhmm_hour(hhmm="CRSDepTime") -> Column:
    """Floor division by 100 (floored, also for negative clocks)."""
    return F.floor(_c(hhmm) / 100).cast("int")


def hhmm_minute(hhmm="CRSDepTime") -> Column:
    """Floored modulo 100."""
    return F.pmod(_c(hhmm), F.lit(100)).cast("int")


def quarter_of_month(month="Month") -> Column:
    return (F.floor((_c(month) - 1) / 3) + 1).cast("int")


def date_from_parts(year, month, day) -> Column:
    """Lenient date: an impossible day (Feb 30) gives null instead of an error."""
    text = F.format_string("%04d-%02d-%02d", _c(year), _c(month), _c(day))
    return F.try_to_date(text, "yyyy-MM-dd")


def month_name(month="Month") -> Column:
    """Number -> 3-letter name, keyed by the number (not by position)."""
    return F.try_element_at(F.array(*[F.lit(n) for n in K.MONTH_NAMES]), _c(month).cast("int"))


def weekday_name(day_of_week="DayOfWeek") -> Column:
    return F.try_element_at(F.array(*[F.lit(n) for n in K.WEEKDAY_NAMES]),
                            _c(day_of_week).cast("int"))


# --- bins (C2, C3, C4) -------------------------------------------------------

def _right_closed_bins(x: Column, edges, labels, open_top: bool = False) -> Column:
    """(e0,e1] -> l0, (e1,e2] -> l1, ...; outside all bins -> null.

    ``Bucketizer`` is left-closed, so the bins are written as a ``when`` chain.
    With ``open_top`` the last bin has no upper bound.
    """
    expr = None
    n = len(labels)
    for i, label in enumerate(labels):
        lo, hi = edges[i], edges[i + 1]
        cond = x > lo
        if not (open_top and i == n - 1):
            cond = cond & (x <= hi)
        expr = F.when(cond, F.lit(label)) if expr is None else expr.when(cond, F.lit(label))
    return expr


def time_of_day(hour="dep_hour") -> Column:
    return _right_closed_bins(_c(hour), K.TIME_OF_DAY_EDGES, K.TIME_OF_DAY_LABELS)


def distance_group(distance="Distance", open_top: bool = False) -> Column:
    """Training rule: (0,500] .. (2000,6000]; ``open_top`` is the serving rule."""
    return _right_closed_bins(_c(distance), K.DISTANCE_EDGES, K.DISTANCE_LABELS, open_top)


def season(month="Month") -> Column:
    mapping = F.create_map(*[F.lit(x) for x in chain.from_iterable(K.SEASON_BY_MONTH.items())])
    return F.try_element_at(mapping, _c(month).cast("int"))


def one_hot(x: Column, level: str) -> Column:
    """0/1 indicator; a null category gives 0."""
    return F.coalesce((x == F.lit(level)).cast("int"), F.lit(0))


# --- numeric helpers (C5, C7, R3, R6) ---------------------------------------

def log_distance(distance="Distance") -> Column:
    return F.log1p(_c(distance).cast("double"))


def elapsed_estimate(distance="distance") -> Column:
    """``int(distance / 8 + 30)`` - truncation, as the serving path does."""
    return (_c(distance) / 8 + 30).cast("int")


def clamp_non_negative(x) -> Column:
    return F.greatest(_c(x), F.lit(0))


def elapsed_total(taxi_out="TaxiOut", air_time="AirTime", taxi_in="TaxiIn") -> Column:
    return _c(taxi_out) + _c(air_time) + _c(taxi_in)


# --- rule-based delay risk (R4) ---------------------------------------------

def delay_risk(carrier="Reporting_Airline", hour="dep_hour", month="Month",
               day_of_week="DayOfWeek") -> Column:
    carrier_term = F.coalesce(
        F.try_element_at(
            F.create_map(*[F.lit(x) for x in chain.from_iterable(K.CARRIER_RISK.items())]),
            _c(carrier)),
        F.lit(0.0))
    h, m = _c(hour), _c(month)
    score = (F.lit(K.RISK_BASE) + carrier_term
             + F.when((h >= 14) & (h <= 20), F.lit(K.RISK_AFTERNOON)).otherwise(F.lit(0.0))
             + F.when(h < 9, F.lit(K.RISK_EARLY)).otherwise(F.lit(0.0))
             + F.when(m.isin(*K.RISK_PEAK_MONTHS), F.lit(K.RISK_PEAK)).otherwise(F.lit(0.0))
             + F.when(_c(day_of_week) >= 6, F.lit(K.RISK_WEEKEND)).otherwise(F.lit(0.0)))
    lo, hi = K.RISK_CLIP
    return F.least(F.greatest(score, F.lit(lo)), F.lit(hi))


# --- delay cause allocation (R5) --------------------------------------------

def cause_allocation(arr_delay="ArrDelay", shares=(0.3, 0.2, 0.2, 0.05, 0.25),
                     threshold: int = K.DELAY_THRESHOLD_MINUTES) -> Column:
    """Array of per-cause minutes: total x share, each rounded half-to-even on its own.

    Only delays above the threshold are allocated; other rows get zeros.  The
    parts may not add up to the total, as in the original rule.
    """
    total = _c(arr_delay).cast("double")
    share_arr = F.array(*[F.lit(float(s)) for s in shares])
    alloc = F.transform(share_arr, lambda s: F.bround(total * s, 0).cast("int"))
    zeros = F.array_repeat(F.lit(0), len(shares))
    return F.when(_c(arr_delay) > threshold, alloc).otherwise(zeros)
