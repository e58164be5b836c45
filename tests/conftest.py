import datetime as dt
import sys
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))

from meterspark.schemas import MEASUREMENT_SCHEMA  # noqa: E402
from meterspark.session import build_session  # noqa: E402

START = dt.datetime(2026, 1, 1)


@pytest.fixture(scope="session")
def spark():
    session = build_session(
        "tests",
        master="local[8]",
        spark__sql__shuffle__partitions="8",
        spark__ui__enabled="false",
        spark__driver__memory="8g",
    )
    session.sparkContext.setLogLevel("ERROR")
    yield session
    session.stop()


@pytest.fixture
def readings(spark):
    """Rows from ``(minute, overrides)`` pairs; every channel has a plain value by default."""

    def build(rows, **common):
        records = []
        for number, (minute, changes) in enumerate(rows):
            record = {
                "series_id": "a",
                "source_row_number": number + 2,
                "observed_at": START + dt.timedelta(minutes=minute),
                "timestamp_original": None,
                "timezone_context": "UTC",
                "interval_seconds": 60,
                "energy_kwh": None,
                "active_power_kw": 1.0,
                "reactive_power_kw": 0.1,
                "voltage_v": 230.0,
                "current_a": 4.0,
                "sub_metering_1_wh": 0.0,
                "sub_metering_2_wh": 0.0,
                "sub_metering_3_wh": 0.0,
                "parse_status": "valid",
                "quality_flags": [],
            }
            records.append({**record, **common, **changes})
        return spark.createDataFrame(records, MEASUREMENT_SCHEMA)

    return build


@pytest.fixture
def hourly(spark):
    """Hourly facts from a list of energies (None for a missing value)."""

    def build(energies, start=START, series="a", **columns):
        rows = [
            (
                series,
                start + dt.timedelta(hours=h),
                None if e is None else float(e),
                columns.get("coverage", 1.0),
                columns.get("status", "complete"),
            )
            for h, e in enumerate(energies)
        ]
        return spark.createDataFrame(
            rows,
            "series_id string, hour_start timestamp_ntz, energy_kwh double, "
            "coverage_ratio double, quality_status string",
        )

    return build
