"""The feature transform (P2) and the serving-side feature builder.

``transform`` fits the category model once (one aggregation pass) and then
applies everything as a single lazy projection over the cleaned rows: one
scan, three broadcast lookups, no further shuffle.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tarmac.functions import columns as X
from tarmac.functions import constants as K
from tarmac.operators.cleaning import clean_flights, fill_numeric_nulls
from tarmac.operators.encoders import CategoryModel

# Pinned one-hot levels: first level of each group dropped.
ONE_HOT_LEVELS = {
    "time_of_day": K.TIME_OF_DAY_LABELS[1:],
    "season": K.SEASON_LEVELS[1:],
    "distance_group": K.DISTANCE_LABELS[1:],
}
ONE_HOT_COLUMNS = [f"{g}_{lvl}" for g, lvls in ONE_HOT_LEVELS.items() for lvl in lvls]
FEATURES = K.BASE_FEATURES + ONE_HOT_COLUMNS
PROCESSED_COLUMNS = K.META_COLUMNS + FEATURES + [K.TARGET]


def derived_columns(df: DataFrame) -> DataFrame:
    """Calendar, clock, distance and flag features (C1-C5, B5, B6) plus categorical bins."""
    hour = X.hhmm_hour("CRSDepTime")
    return df.withColumns({
        "dep_hour": hour,
        "dep_minute": X.hhmm_minute("CRSDepTime"),
        "time_of_day": X.time_of_day(hour),
        "is_weekend": X.weekend_flag("DayOfWeek"),
        "season": X.season("Month"),
        "distance_group": X.distance_group("Distance"),
        "dep_delay_flag": X.positive_flag("DepDelay"),
        "log_distance": X.log_distance("Distance"),
    })


def one_hot_columns(group_cols: dict[str, str] | None = None) -> list:
    group_cols = group_cols or {g: g for g in ONE_HOT_LEVELS}
    return [X.one_hot(F.col(group_cols[g]), lvl).alias(f"{g}_{lvl}")
            for g, lvls in ONE_HOT_LEVELS.items() for lvl in lvls]


def prefixed_columns(df: DataFrame, prefixes: list[str] = K.ONE_HOT_PREFIXES) -> list[str]:
    """Columns whose name starts with any of the prefixes, in table order."""
    return [c for c in df.columns if any(c.startswith(p) for p in prefixes)]


def project_processed(df: DataFrame, extra: list[str] | None = None) -> DataFrame:
    """B7 + B9: meta, base features, one-hots, target - in that order, types pinned."""
    casts = {"ArrDelay": "double", "DepDelay": "double", "origin_freq": "double",
             "dest_freq": "double", "log_distance": "double"}
    cols = []
    for c in K.META_COLUMNS + K.BASE_FEATURES:
        cols.append(F.col(c).cast(casts.get(c, "int")).alias(c) if c not in
                    ("FlightDate", "Reporting_Airline", "Origin", "Dest") else F.col(c))
    out = df.select(*(extra or []), *cols, *one_hot_columns(), F.col(K.TARGET).cast("int"))
    return fill_numeric_nulls(out, 0, subset=FEATURES)


def transform(raw: DataFrame, model: CategoryModel | None = None,
              keep_key: bool = False) -> tuple[DataFrame, CategoryModel]:
    """Raw flights -> the 32-column processed table, and the fitted category model."""
    cleaned = clean_flights(raw)
    if model is None:
        model = CategoryModel.fit(cleaned)
    df = derived_columns(model.transform(cleaned))
    extra = ["flight_key"] if keep_key and "flight_key" in raw.columns else []
    return project_processed(df, extra), model


# --- serving-side features (B12, B13, C6, D3, E5) ----------------------------

def request_defaults(req: DataFrame) -> DataFrame:
    """Defaults: minute 0, dep_delay 0, taxi_out 15; elapsed missing or 0 -> int(d/8+30)."""
    return req.withColumns({
        "dep_minute": F.coalesce(F.col("dep_minute"), F.lit(K.REQUEST_DEFAULTS["dep_minute"])),
        "dep_delay": F.coalesce(F.col("dep_delay").cast("double"),
                                F.lit(K.REQUEST_DEFAULTS["dep_delay"])),
        "taxi_out": F.coalesce(F.col("taxi_out"), F.lit(K.REQUEST_DEFAULTS["taxi_out"])),
        "crs_elapsed_time": F.coalesce(F.nullif(F.col("crs_elapsed_time"), F.lit(0)),
                                       X.elapsed_estimate("distance")).cast("int"),
    })


REQUEST_COLUMNS = ["month", "day_of_month", "day_of_week", "dep_hour", "dep_minute",
                   "carrier", "origin", "dest", "distance", "dep_delay", "taxi_out",
                   "crs_elapsed_time"]


def serving_features(req: DataFrame, mode: str = "fitted",
                     model: CategoryModel | None = None, suffix: str = "",
                     keep_request: bool = False) -> DataFrame:
    """Request rows -> the training feature columns (FEATURES order) plus pass-through columns.

    ``fitted``: the same rules and fitted tables as training (unseen -> 0).
    ``serving_compat``: the original serving shortcuts - static carrier codes
    (unknown -> 0), uniform airport share 1/30, an open-topped distance bin and
    a fall indicator in place of winter (so winter is absent -> 0 after alignment).
    Request names differ from feature names only by case, so the request
    columns are moved aside first (Spark resolves names case-insensitively).
    With a ``suffix`` the feature columns are renamed and ``keep_request`` may
    carry the request columns through (to build both modes in one pass).
    """
    if keep_request and not suffix:
        raise ValueError("keep_request needs a suffix (names would collide)")
    taken = {c.lower() for c in REQUEST_COLUMNS + FEATURES}
    keep = [c for c in req.columns if c.lower() not in taken]
    df = request_defaults(req).select(*keep, *[F.col(c).alias("_r_" + c) for c in REQUEST_COLUMNS])
    r = {c: F.col("_r_" + c) for c in REQUEST_COLUMNS}
    df = df.withColumns({"_tod": X.time_of_day(r["dep_hour"]), "_season": X.season(r["month"])})
    if mode == "fitted":
        if model is None:
            raise ValueError("fitted mode needs a CategoryModel")
        df = df.withColumn("_dg", X.distance_group(r["distance"]))
        df = model.transform(df, keys={"carrier": "_r_carrier", "origin": "_r_origin",
                                       "dest": "_r_dest"})
        encoded = [F.col("carrier_encoded"), F.col("origin_freq"), F.col("dest_freq")]
        onehots = one_hot_columns({"time_of_day": "_tod", "season": "_season",
                                   "distance_group": "_dg"})
    elif mode == "serving_compat":
        codes = F.create_map(*[F.lit(x) for kv in K.SERVING_CARRIER_CODES.items() for x in kv])
        share = F.lit(1.0 / len(K.AIRPORTS))
        df = df.withColumn("_dg", X.distance_group(r["distance"], open_top=True))
        encoded = [F.coalesce(F.try_element_at(codes, F.upper(r["carrier"])), F.lit(0)),
                   share, share]
        onehots = [X.one_hot(F.col("_tod"), lvl).alias(f"time_of_day_{lvl}")
                   for lvl in ONE_HOT_LEVELS["time_of_day"]]
        onehots += [X.one_hot(F.col("_season"), lvl).alias(f"season_{lvl}")
                    for lvl in ("spring", "summer")]
        onehots += [F.lit(0).alias("season_winter")]   # compat builds season_fall instead
        onehots += [X.one_hot(F.col("_dg"), lvl).alias(f"distance_group_{lvl}")
                    for lvl in ONE_HOT_LEVELS["distance_group"]]
    else:
        raise ValueError(f"unknown mode {mode!r}")
    base = [r["month"].cast("int"), r["day_of_month"].cast("int"), r["day_of_week"].cast("int"),
            r["dep_hour"].cast("int"), r["dep_minute"].cast("int"),
            encoded[0].cast("int"), encoded[1].cast("double"), encoded[2].cast("double"),
            r["distance"].cast("int"), X.log_distance(r["distance"]),
            X.weekend_flag(r["day_of_week"]), X.positive_flag(r["dep_delay"]),
            r["dep_delay"].cast("double"), r["taxi_out"].cast("int"),
            r["crs_elapsed_time"].cast("int")]
    carried = [F.col("_r_" + c).alias(c) for c in REQUEST_COLUMNS] if keep_request else []
    out = df.select(*keep, *carried, *[e.alias(n + suffix) for e, n in zip(base, K.BASE_FEATURES)],
                    *[o.alias(n + suffix) for o, n in zip(onehots, ONE_HOT_COLUMNS)])
    return fill_numeric_nulls(out, 0, subset=[c + suffix for c in K.BASE_FEATURES])


def align(df: DataFrame, feature_order: list[str], keep: list[str] | None = None) -> DataFrame:
    """Order columns by the saved feature list; an absent feature becomes 0."""
    present = set(df.columns)
    cols = [F.col(c) if c in present else F.lit(0).alias(c) for c in feature_order]
    return df.select(*(keep or []), *cols)
