"""Column vocabularies and fixed schemas of the lap / sample / corner tables."""

from __future__ import annotations

from pyspark.sql import types as T

# --- fixed values: channel names and lap-duration columns (must equal the reference) ---
CAR_CHANNELS = ("Speed", "Throttle", "Brake", "RPM", "nGear", "DRS")
POSITION_CHANNELS = ("X", "Y", "Z")
DEFAULT_COMPARISON_CHANNELS = ("Speed", "Throttle", "Brake", "RPM", "nGear", "DRS", "TimeSeconds")
LAP_TIME_COLUMNS = ("LapTime", "Sector1Time", "Sector2Time", "Sector3Time")
LAP_TABLE_COLUMNS = (
    "Driver", "LapNumber", "LapTimeSeconds", "Sector1TimeSeconds", "Sector2TimeSeconds",
    "Sector3TimeSeconds", "Compound", "TyreLife", "Stint", "Team", "TrackStatus",
    "PitOutTime", "PitInTime",
)
CLUSTER_FEATURES = ("LapTimeSeconds", "Sector1TimeSeconds", "Sector2TimeSeconds",
                    "Sector3TimeSeconds", "TyreLife")
ANOMALY_FEATURES = ("LapTimeSeconds", "Sector1TimeSeconds", "Sector2TimeSeconds",
                    "Sector3TimeSeconds")
NUMERIC_SAMPLE_COLUMNS = ("Distance", "RelativeDistance", "TimeSeconds", "SessionTimeSeconds",
                          *CAR_CHANNELS, *POSITION_CHANNELS)
DATASET_VERSION = 1
DEFAULT_GRID_POINTS = 1200
DEFAULT_FREQUENCY_HZ = 10
# --- end of fixed values ---

# Keys: laps carry the reference's capitalised names, samples snake_case ones.
SESSION = "session_id"
LAP_KEYS = ("session_id", "Driver", "LapNumber")
SAMPLE_KEYS = ("session_id", "driver", "lap_number")

LAPS = T.StructType([
    T.StructField("session_id", T.StringType()),
    T.StructField("Driver", T.StringType()),
    T.StructField("LapNumber", T.IntegerType()),
    T.StructField("LapTimeSeconds", T.DoubleType()),
    T.StructField("Sector1TimeSeconds", T.DoubleType()),
    T.StructField("Sector2TimeSeconds", T.DoubleType()),
    T.StructField("Sector3TimeSeconds", T.DoubleType()),
    T.StructField("Compound", T.StringType()),
    T.StructField("TyreLife", T.DoubleType()),
    T.StructField("Stint", T.IntegerType()),
    T.StructField("Team", T.StringType()),
    T.StructField("TrackStatus", T.StringType()),
    T.StructField("PitOutTime", T.StringType()),
    T.StructField("PitInTime", T.StringType()),
])

CORNERS = T.StructType([
    T.StructField("session_id", T.StringType()),
    T.StructField("X", T.DoubleType()),
    T.StructField("Y", T.DoubleType()),
    T.StructField("Number", T.IntegerType()),
    T.StructField("Letter", T.StringType()),
    T.StructField("Angle", T.DoubleType()),
    T.StructField("Distance", T.DoubleType()),
])

# One row per selected lap of a prepared dataset (replaces the JSON manifest's lap list).
LAP_INDEX = T.StructType([
    T.StructField("session_id", T.StringType()),
    T.StructField("position", T.IntegerType()),
    T.StructField("driver", T.StringType()),
    T.StructField("lap_number", T.IntegerType()),
    T.StructField("lap_time_seconds", T.DoubleType()),
    T.StructField("team", T.StringType()),
    T.StructField("compound", T.StringType()),
    T.StructField("stint", T.IntegerType()),
    T.StructField("sector1", T.DoubleType()),
    T.StructField("sector2", T.DoubleType()),
    T.StructField("sector3", T.DoubleType()),
])

MANIFEST_LAP = T.StructType([
    T.StructField("driver", T.StringType()),
    T.StructField("lap_number", T.LongType()),
    T.StructField("lap_time_seconds", T.DoubleType()),
    T.StructField("team", T.StringType()),
    T.StructField("compound", T.StringType()),
    T.StructField("stint", T.LongType()),
    T.StructField("telemetry_file", T.StringType()),
    T.StructField("sector1", T.DoubleType()),
    T.StructField("sector2", T.DoubleType()),
    T.StructField("sector3", T.DoubleType()),
])

MANIFEST = T.StructType([
    T.StructField("dataset_version", T.LongType()),
    T.StructField("generated_at", T.StringType()),
    T.StructField("request", T.StructType([
        T.StructField("year", T.LongType()),
        T.StructField("grand_prix", T.StringType()),
        T.StructField("session_type", T.StringType()),
    ])),
    T.StructField("frequency_hz", T.LongType()),
    T.StructField("laps", T.ArrayType(MANIFEST_LAP)),
])


def require(df, columns, what: str) -> None:
    """Schema check at the API edge (driver-side, no job)."""
    missing = [c for c in columns if c not in df.columns]
    if missing:
        raise ValueError(f"{what} needs column(s) {missing}; got {df.columns}")


def present(df, columns) -> list[str]:
    return [c for c in columns if c in df.columns]
