"""Names and fixed values of the observation model."""

from __future__ import annotations

from pyspark.sql import types as T

METRICS = ["traffic_volume", "avg_speed_kmph", "public_transport_usage", "parking_occupancy_pct", "road_incidents", "waterlogging_reports", "power_outage_minutes", "citizen_complaints", "temperature_c"]
COUNT_METRICS = ["traffic_volume", "public_transport_usage", "road_incidents", "waterlogging_reports", "citizen_complaints"]
FACTORS = ["city", "zone", "hour", "month", "weekday"]
SOURCE_COLUMNS = ["record_id", "city", "zone", "timestamp_text", *METRICS]
_REAL = {"avg_speed_kmph", "parking_occupancy_pct", "power_outage_minutes", "temperature_c"}
SOURCE_SCHEMA = T.StructType([T.StructField(c, T.StringType() if c in SOURCE_COLUMNS[:4] else T.DoubleType() if c in _REAL else T.LongType()) for c in SOURCE_COLUMNS])

# The domain rules of the model.
SPEED_RANGE = (0.0, 120.0)
PARKING_LIMIT = 100.0
TEMPERATURE_LIMIT = 45.0
OUTAGE_LIMIT = 60.0
NEIGHBOUR_TOLERANCE = 10.0
SLOT_HOURS = (0, 4, 8, 12, 16, 20)
UNKNOWN = "[UNKNOWN]"
ALPHA = 0.01
RHO_GATE = 0.20
ETA_GATE = 0.06
Z99 = 2.5758293035489004
FOLDS = ((1, 0.50, 0.60), (2, 0.60, 0.70), (3, 0.70, 0.80))
PAIRS = [(a, b) for i, a in enumerate(METRICS) for b in METRICS[i + 1 :]]
