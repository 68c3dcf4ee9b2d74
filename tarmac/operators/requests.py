"""Request validation, quarantine split and score decoration.

Validation is a pure column expression: each failed rule contributes its name
to a ``reasons`` text, so valid and rejected rows are split by a filter -
no row ever leaves the executors.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tarmac.functions import constants as K

REQUIRED = ["month", "day_of_month", "day_of_week", "dep_hour", "carrier", "origin",
            "dest", "distance"]


#: What reading raw requests found wrong: an array of ``<field>:type`` or ``body:malformed``.
FAILED = "parse_failed"


def rejection_reasons(required: list[str] = REQUIRED, ranges=K.REQUEST_RANGES, failed: str | None = None):
    """Comma-separated failed rules ('' when valid).

    A required field that is null fails as ``<field>:missing``; a present value
    outside its range fails as ``<field>:range``.  Origin equal to dest is
    accepted, as in the original service.  ``failed`` names a column of reasons found
    before: they come first, and a field that failed there is not missing.
    """
    fails = []
    for f in required:
        missing = F.col(f).isNull()
        if failed:
            missing = missing & ~F.array_contains(failed, f"{f}:type") & ~F.array_contains(failed, "body:malformed")
        fails.append(F.when(missing, F.lit(f"{f}:missing")))
    for f, (lo, hi) in ranges.items():
        c = F.col(f)
        bad = F.lit(False)
        if lo is not None:
            bad = bad | (c < lo)
        if hi is not None:
            bad = bad | (c > hi)
        fails.append(F.when(c.isNotNull() & bad, F.lit(f"{f}:range")))
    reasons = F.array_compact(F.array(*fails))
    return F.concat_ws(",", F.concat(F.col(failed), reasons) if failed else reasons)


def valid_condition(required: list[str] = REQUIRED, ranges=K.REQUEST_RANGES):
    """The same rules as one boolean conjunction (cheap; short-circuits)."""
    cond = F.lit(True)
    for f in required:
        cond = cond & F.col(f).isNotNull()
    for f, (lo, hi) in ranges.items():
        c = F.col(f)
        ok = F.lit(True)
        if lo is not None:
            ok = ok & (c >= lo)
        if hi is not None:
            ok = ok & (c <= hi)
        cond = cond & (c.isNull() | ok)
    return cond


def validate(req: DataFrame) -> DataFrame:
    return req.withColumns({"reasons": rejection_reasons()}) \
              .withColumns({"valid": F.col("reasons") == ""})


def split_valid(req: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(valid rows, quarantined rows with their reasons).

    Accepted rows are selected by the boolean form of the rules; the reasons
    text is only built for the rejected rows.  Raw requests also fail by what reading them found;
    their text goes with the rejected rows only.
    """
    ok = valid_condition()
    if FAILED not in req.columns:
        return (req.filter(ok),
                req.filter(~ok).withColumns({"reasons": rejection_reasons(),
                                             "valid": F.lit(False)}))
    ok = (F.size(FAILED) == 0) & ok
    return (req.filter(ok).drop(FAILED, "raw"),
            req.filter(~ok).withColumns({"reasons": rejection_reasons(failed=FAILED),
                                         "valid": F.lit(False)}).drop(FAILED))


def decorate(df: DataFrame, prediction: str = "prediction", probability: str = "probability") -> DataFrame:
    """Label text, rounded probability, confidence = max(p, 1 - p)."""
    p = F.col(probability).cast("double")
    return df.select(
        "*",
        F.when(F.col(prediction) == 1, F.lit(K.DELAYED_LABEL)).otherwise(F.lit(K.ON_TIME_LABEL))
        .alias("prediction_label"),
        F.round(p, 4).alias("delay_probability"),
        F.col(prediction).cast("int").alias("is_delayed"),
        F.round(F.greatest(p, F.lit(1.0) - p), 4).alias("confidence"),
    )
