"""Column contracts of the tables."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import types as T

#: Fixed values of the data format: columns of raw tracks.
RAW_TRACKS = T.StructType(
    [
        T.StructField("frame", T.LongType()),
        T.StructField("timestamp_s", T.DoubleType()),
        T.StructField("track_id", T.LongType()),
        T.StructField("class_id", T.IntegerType()),
        T.StructField("class_name", T.StringType()),
        *(T.StructField(c, T.DoubleType()) for c in ("confidence", "x1", "y1", "x2", "y2", "center_x", "center_y", "ground_x", "ground_y")),
    ]
)
#: Fixed values of the data format: fields of telemetry.
TELEMETRY_FIELDS = ("latitude", "longitude", "relative_altitude_m", "gimbal_yaw_deg", "gimbal_pitch_deg", "gimbal_roll_deg", "focal_length_35mm")
TELEMETRY = T.StructType([T.StructField("frame", T.LongType()), *(T.StructField(c, T.DoubleType()) for c in TELEMETRY_FIELDS)])
#: Columns that brief gaps are interpolated in, where a table has them.
INTERPOLATED = ("confidence", "x1", "y1", "x2", "y2", "center_x", "center_y", "ground_x", "ground_y")

#: Columns that the levels cannot do without.
CLEAN_NEEDS = frozenset({"frame", "timestamp_s", "track_id", "class_id", "class_name", "confidence", "ground_x", "ground_y"})
LEVEL2_NEEDS = CLEAN_NEEDS | {"x1", "y1", "x2", "y2"}


def require_columns(df: DataFrame, needed: frozenset[str] | set[str], what: str) -> DataFrame:
    """df, if it has all needed columns; their absence is an error before any job runs."""
    missing = sorted(set(needed) - set(df.columns))
    if missing:
        raise ValueError(f"{what} lacks columns {missing}")
    return df


def positive_fps(fps: float) -> float:
    if not fps > 0 or fps == float("inf"):
        raise ValueError("fps must be positive and finite")
    return float(fps)
