"""Fixed values.

These must equal the values the original platform uses, so that the derived
columns, lookups and reports agree with it.  They are stated here plainly and
in their natural order; nothing else in the package re-types them.
"""

# --- Fixed values: raw flight record columns, in file order -----------------
RAW_COLUMNS = [
    "Year", "Quarter", "Month", "DayofMonth", "DayOfWeek", "FlightDate",
    "Reporting_Airline", "Flight_Number_Reporting_Airline", "Origin", "Dest",
    "CRSDepTime", "DepDelay", "DepDelayMinutes", "TaxiOut", "TaxiIn",
    "ArrDelay", "ArrDelayMinutes", "Cancelled", "Diverted",
    "CRSElapsedTime", "ActualElapsedTime", "AirTime", "Distance",
    "CarrierDelay", "WeatherDelay", "NASDelay", "SecurityDelay", "LateAircraftDelay",
]

# --- Fixed values: processed table layout -----------------------------------
META_COLUMNS = ["Year", "FlightDate", "Reporting_Airline", "Origin", "Dest",
                "ArrDelay", "Flight_Number_Reporting_Airline"]
BASE_FEATURES = ["Month", "DayofMonth", "DayOfWeek", "dep_hour", "dep_minute",
                 "carrier_encoded", "origin_freq", "dest_freq",
                 "Distance", "log_distance", "is_weekend", "dep_delay_flag",
                 "DepDelay", "TaxiOut", "CRSElapsedTime"]
ONE_HOT_PREFIXES = ["time_of_day_", "season_", "distance_group_"]
TARGET = "is_delayed"
# Columns that are never model inputs.
EXCLUDE_COLUMNS = META_COLUMNS + [TARGET]

# --- Fixed values: bins (right-closed intervals) and their labels -----------
TIME_OF_DAY_EDGES = [-1, 6, 12, 18, 24]
TIME_OF_DAY_LABELS = ["night", "morning", "afternoon", "evening"]
DISTANCE_EDGES = [0, 500, 1000, 2000, 6000]
DISTANCE_LABELS = ["short", "medium", "long", "ultra_long"]

# --- Fixed values: month -> season ------------------------------------------
SEASON_BY_MONTH = {
    12: "winter", 1: "winter", 2: "winter",
    3: "spring", 4: "spring", 5: "spring",
    6: "summer", 7: "summer", 8: "summer",
    9: "fall", 10: "fall", 11: "fall",
}
# Levels in the order the training encoder sees them; the first is dropped.
SEASON_LEVELS = ["fall", "spring", "summer", "winter"]

# --- Fixed values: month and weekday names ----------------------------------
MONTH_NAMES = ["Jan", "Feb", "Mar", "Apr", "May", "Jun",
               "Jul", "Aug", "Sep", "Oct", "Nov", "Dec"]
WEEKDAY_NAMES = ["Mon", "Tue", "Wed", "Thu", "Fri", "Sat", "Sun"]

# --- Fixed values: carriers -------------------------------------------------
CARRIER_NAMES = {
    "AA": "American Airlines", "DL": "Delta Air Lines",
    "UA": "United Airlines", "WN": "Southwest Airlines",
    "B6": "JetBlue Airways", "AS": "Alaska Airlines",
    "NK": "Spirit Airlines", "F9": "Frontier Airlines",
    "G4": "Allegiant Air", "HA": "Hawaiian Airlines",
}
# Static carrier codes used by the serving path (unknown -> 0).
SERVING_CARRIER_CODES = {
    "AA": 0, "AS": 1, "B6": 2, "DL": 3, "F9": 4,
    "G4": 5, "HA": 6, "NK": 7, "UA": 8, "WN": 9,
}
# Carrier term of the rule-based delay risk.
CARRIER_RISK = {
    "AA": 0.02, "DL": -0.03, "UA": 0.01, "WN": 0.03, "B6": 0.04,
    "AS": -0.02, "NK": 0.06, "F9": 0.05, "G4": 0.07, "HA": -0.04,
}

# --- Fixed values: airports known to the serving path -----------------------
AIRPORTS = [
    "ATL", "DFW", "DEN", "ORD", "LAX", "CLT", "MCO", "LAS",
    "PHX", "MIA", "SEA", "IAH", "JFK", "EWR", "SFO", "MSP",
    "BOS", "DTW", "FLL", "PHL", "LGA", "BWI", "SLC", "SAN",
    "IAD", "DCA", "MDW", "TPA", "PDX", "HNL",
]

# --- Fixed values: delay risk rule ------------------------------------------
RISK_BASE = 0.20
RISK_AFTERNOON = 0.08          # departure hour 14..20
RISK_EARLY = -0.05             # departure hour before 9
RISK_PEAK_MONTHS = [6, 7, 8, 12]
RISK_PEAK = 0.05
RISK_WEEKEND = 0.02
RISK_CLIP = (0.05, 0.50)

# --- Fixed values: delay cause columns --------------------------------------
CAUSE_COLUMNS = ["CarrierDelay", "WeatherDelay", "NASDelay",
                 "SecurityDelay", "LateAircraftDelay"]

# --- Fixed values: request validation and defaults --------------------------
REQUEST_RANGES = {
    "month": (1, 12), "day_of_month": (1, 31), "day_of_week": (1, 7),
    "dep_hour": (0, 23), "dep_minute": (0, 59), "distance": (50, 6000),
    "taxi_out": (0, None),
}
REQUEST_DEFAULTS = {"dep_minute": 0, "dep_delay": 0.0, "taxi_out": 15}

# --- Fixed values: drift monitoring -----------------------------------------
# production column -> training column
DRIFT_FEATURES = [("distance", "Distance"), ("dep_delay", "DepDelay"),
                  ("dep_hour", "dep_hour"), ("month", "Month")]
DRIFT_ALPHA = 0.05
DRIFT_MIN_ROWS = 30

# --- Fixed values: prediction log layout ------------------------------------
LOG_COLUMNS = ["timestamp", "carrier", "origin", "dest", "month", "dep_hour",
               "distance", "dep_delay", "prediction", "probability"]

# --- Fixed values: labels ---------------------------------------------------
CLASS_NAMES = ["On-Time", "Delayed"]
DELAYED_LABEL = "DELAYED"
ON_TIME_LABEL = "ON TIME"
DELAY_THRESHOLD_MINUTES = 15
SPLIT_SEED = 42
TEST_FRACTION = 0.2
