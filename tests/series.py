"""Small hand-made hourly series."""

from __future__ import annotations

import math
from datetime import datetime, timedelta

from pyspark.sql import DataFrame, SparkSession, functions as F

from rainloom.constants import RAW_COLUMNS

T = "observation_time"


def hourly(spark: SparkSession, hours: int, stations=("a",), start="2023-12-25 00:00:00", drop=()) -> DataFrame:
    """Deterministic weather-like rows; ``drop`` lists the hour offsets to leave out."""
    first = datetime.fromisoformat(start)
    rows = []
    for s, station in enumerate(stations):
        for i in range(hours):
            if i in drop:
                continue
            values = [round(10 * math.sin(i * (j + 1) / 7 + s) + j, 3) for j in range(len(RAW_COLUMNS))]
            values[RAW_COLUMNS.index("precipitation")] = max(0.0, round(5 * math.sin(i / 3 + s), 2))
            rows.append((station, first + timedelta(hours=i), *values))
    ddl = f"station_id string, {T} timestamp_ntz, " + ", ".join(f"{c} double" for c in RAW_COLUMNS)
    return spark.createDataFrame(rows, ddl)


def at(text: str):
    return F.lit(text).cast("timestamp_ntz")


def as_set(df: DataFrame, digits: int = 9) -> set:
    fix = lambda v: round(v, digits) if isinstance(v, float) else v
    return {tuple(fix(v) for v in row) for row in df.select(*sorted(df.columns)).collect()}
