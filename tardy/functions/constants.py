"""Fixed values.  These must stay equal to the behaviour being reproduced.

All rules of the library read their thresholds, labels and defaults from
here, so training, exploration and serving agree.
"""

# --- fixed values: derived trip features ---------------------------------
WEEKEND_DAYS = [6, 7]                       # DayOfWeek, 1 = Monday
RUSH_HOUR_RANGES = [(6, 9), (17, 20)]       # inclusive DepHour ranges
TIME_OF_DAY_BANDS = [                       # inclusive DepHour ranges
    ("Morning", 6, 11),
    ("Afternoon", 12, 17),
    ("Evening", 18, 21),
]
TIME_OF_DAY_OTHER = "Night"                 # also null hour and hour 24
DISTANCE_SHORT_BELOW = 500                  # Distance < 500 -> Short
DISTANCE_MEDIUM_UPTO = 1500                 # 500..1500 -> Medium, else Long
DISTANCE_LABELS = ("Short", "Medium", "Long")
DATE_PATTERN = "dd-MM-yyyy"
DAY_NAMES = {1: "Mon", 2: "Tue", 3: "Wed", 4: "Thu", 5: "Fri", 6: "Sat", 7: "Sun"}
LABEL_THRESHOLDS = (30, 60)                 # ArrDelay > t minutes, strict

# --- fixed values: cleaning -------------------------------------------------
EDA_CAST_COLUMNS = [
    "ArrDelay", "DepDelay", "Distance", "DayOfWeek", "Month", "Day",
    "TaxiIn", "TaxiOut", "CarrierDelay", "WeatherDelay", "NASDelay",
    "SecurityDelay", "LateAircraftDelay", "ActualElapsedTime",
    "AirTime", "DepTime", "ArrTime", "CRSArrTime", "CRSElapsedTime",
]
CORRELATION_EXCLUDED = [
    "CarrierDelay", "WeatherDelay", "NASDelay", "SecurityDelay",
    "LateAircraftDelay", "Cancelled", "Diverted", "CancellationCode", "FlightNum",
]
SUMMARY_COLUMNS = ["ArrDelay", "DepDelay", "Distance", "ActualElapsedTime"]

# --- fixed values: model inputs ---------------------------------------------
NUMERIC_FEATURES = [
    "DayOfWeek", "Month", "Day", "DepHour", "IsWeekend", "IsRushHour",
    "Distance", "CRSElapsedTime", "CRSArrHour",
    "AvgCarrierDelay", "AvgHourDelay", "AvgRouteDelay",
    "AvgOriginDelay", "AvgDestDelay", "AvgCarrierHourDelay",
    "CarrierFlightCount", "RouteFlightCount",
]
NUMERIC_FEATURES_WITH_DEP = NUMERIC_FEATURES + ["DepDelay", "TaxiOut"]
CATEGORICAL_FEATURES = ["UniqueCarrier", "Origin", "Dest", "TimeOfDay", "DistanceCategory"]
TARGET = "ArrDelay"
AVERAGE_COLUMNS = [
    "AvgCarrierDelay", "AvgHourDelay", "AvgRouteDelay",
    "AvgOriginDelay", "AvgDestDelay", "AvgCarrierHourDelay",
]

# --- fixed values: serving ---------------------------------------------------
REQUEST_DEFAULTS = {
    "DepHour": 12, "Distance": 1000, "DayOfWeek": 1, "Month": 1, "Day": 15,
    "CRSElapsedTime": 120, "CRSArrHour": 14, "UniqueCarrier": "WN",
    "Origin": "ORD", "Dest": "LAX", "DepDelay": 0.0, "TaxiOut": 15,
    "model_type": "A",
}
LOOKUP_MISS_DEFAULTS = {
    "AvgCarrierDelay": 60.0, "AvgHourDelay": 55.0, "AvgRouteDelay": 58.0,
    "AvgOriginDelay": 57.0, "AvgDestDelay": 57.0, "AvgCarrierHourDelay": 58.0,
}
SERVING_CARRIER_FLIGHT_COUNT = 10000
SERVING_ROUTE_FLIGHT_COUNT = 5000
DISTANCE_NOT_FOUND = 1000
RESPONSE_DEADLINE_SECONDS = 10
MODEL_B = "B"

# --- fixed values: request form and answer bands ----------------------------
FORM_DEFAULT_DURATION = 120
FORM_DEFAULT_DISTANCE = 1000
FORM_DEFAULT_DEP_DELAY = 0
FORM_DEFAULT_TAXI_OUT = 15
FORM_FIXED_DAY = 15
FORM_MIN_DURATION = 10
SEVERITY_ON_TIME_UPTO = 15                  # minutes <= 15
SEVERITY_DELAYED_UPTO = 45                  # minutes <= 45, else critical
SEVERITY_LABELS = ("on_time", "delayed", "critical")
RISK_LOW_BELOW = 25                         # percent < 25
RISK_MEDIUM_BELOW = 50                      # percent < 50, else high
RISK_LABELS = ("low", "medium", "high")
LATE_SHARE_THRESHOLD = 15
