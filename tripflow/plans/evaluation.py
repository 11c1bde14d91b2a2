"""Whole evaluations of calibrated forecasts."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tripflow.operators import forecast
from tripflow.session import durable


def fit_forecast(fit: DataFrame, keys: list[str], bins: str, label: str = "label") -> DataFrame:
    """Quantile table of the fitting rows.

    It has one row per key and bin and everything after it reads it several times, so it is
    written to the checkpoint folder once instead of being refitted per use.
    """
    return durable(forecast.binned_quantiles(fit, keys, bins, label))


def calibrated_forecast(rows: DataFrame, keys: list[str], bins: str, label: str = "label", miss: float = 0.2,
                        role: str = "role") -> DataFrame:
    """Test rows with raw and conformal intervals; ``role`` says fit, calibrate or test.

    All folds and horizons run in the same jobs, as key columns; the rows are written once and read by the three of them.
    """
    rows = durable(rows, "forecast-rows")
    table = fit_forecast(rows.filter(F.col(role) == "fit"), keys, bins, label)
    calibration = forecast.forecast(rows.filter(F.col(role) == "calibrate"), table, keys, bins)
    test = forecast.forecast(rows.filter(F.col(role) == "test"), table, keys, bins)
    return forecast.widen(test, forecast.conformal_shift(calibration, keys, label, miss=miss), keys)
