"""Row filters, null rules and the delay target."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tarmac.functions import columns as X
from tarmac.functions import constants as K

_NUMERIC = (T.ByteType, T.ShortType, T.IntegerType, T.LongType,
            T.FloatType, T.DoubleType, T.DecimalType)


def operated_condition(cancelled: str = "Cancelled", diverted: str = "Diverted"):
    """Kept rows: both flags equal 0 (a null flag is not kept)."""
    return (F.col(cancelled) == 0) & (F.col(diverted) == 0)


def keep_operated(df: DataFrame, cancelled: str = "Cancelled", diverted: str = "Diverted") -> DataFrame:
    """B1: drop cancelled and diverted flights; the filter reaches the scan."""
    return df.filter(operated_condition(cancelled, diverted))


def removed_rows(df: DataFrame, cancelled: str = "Cancelled", diverted: str = "Diverted") -> DataFrame:
    """B2: rows in, rows kept and rows removed in one aggregate pass."""
    kept = F.count_if(F.coalesce(operated_condition(cancelled, diverted), F.lit(False)))
    return (df.agg(F.count(F.lit(1)).alias("rows_in"), kept.alias("rows_out"))
              .withColumn("rows_removed", F.col("rows_in") - F.col("rows_out")))


def numeric_columns(df: DataFrame) -> list[str]:
    return [f.name for f in df.schema.fields if isinstance(f.dataType, _NUMERIC)]


def fill_numeric_nulls(df: DataFrame, value=0, subset: list[str] | None = None) -> DataFrame:
    """Every numeric column (or the subset) null -> ``value``."""
    cols = set(subset if subset is not None else numeric_columns(df))
    if not cols:
        return df
    # One projection: coalesce(c, value) keeps each column's type and name.
    return df.select(*[F.coalesce(F.col(c), F.lit(value).cast(t)).alias(c) if c in cols
                       else F.col(c) for c, t in df.dtypes])


def clean_flights(raw: DataFrame, arr_delay: str = "ArrDelay") -> DataFrame:
    """B1 -> B3 -> B4: operated flights, numeric nulls 0, then ``is_delayed``.

    The fill comes before the target, so a null arrival delay is on time.
    """
    df = fill_numeric_nulls(keep_operated(raw))
    return df.withColumns({K.TARGET: X.delay_target(arr_delay)})
