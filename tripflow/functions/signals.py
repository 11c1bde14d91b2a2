"""Signal vocabulary as data: raw header, canonical name, tier, unit scale and offset."""

from __future__ import annotations

from dataclasses import dataclass
from functools import cache

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tripflow.functions.headers import header_key_of

# Measured channels as (canonical, tier, raw header), in schema order.
MEASURED = (
    ("time_s", "index", "Time [s]"),
    ("amb_temp_c", "upstream", "Ambient Temperature [°C]"),
    ("amb_temp_sensor_c", "upstream", "Ambient Temperature Sensor [°C]"),
    ("elevation_m", "upstream", "Elevation [m]"),
    ("velocity_kmh", "vehicle", "Velocity [km/h]"),
    ("throttle_pct", "vehicle", "Throttle [%]"),
    ("motor_torque_nm", "vehicle", "Motor Torque [Nm]"),
    ("accel_long_ms2", "vehicle", "Longitudinal Acceleration [m/s^2]"),
    ("regen_signal", "vehicle", "Regenerative Braking Signal"),
    ("batt_voltage_v", "vehicle", "Battery Voltage [V]"),
    ("batt_current_a", "vehicle", "Battery Current [A]"),
    ("batt_temp_c", "vehicle", "Battery Temperature [°C]"),
    ("batt_temp_max_c", "vehicle", "max. Battery Temperature [°C]"),
    ("soc_pct", "vehicle", "SoC [%]"),
    ("soc_displayed_pct", "vehicle", "displayed SoC [%]"),
    ("soc_min_pct", "vehicle", "min. SoC [%]"),
    ("soc_max_pct", "vehicle", "max. SoC [%)"),
    ("cabin_temp_c", "cabin", "Cabin Temperature Sensor [°C]"),
    ("coolant_heatercore_c", "heater_circuit", "Coolant Temperature Heatercore [°C]"),
    ("coolant_req_c", "heater_circuit", "Requested Coolant Temperature [°C]"),
    ("coolant_inlet_c", "heater_circuit", "Coolant Temperature Inlet [°C]"),
    ("coolant_flow_lph", "heater_circuit", "Coolant Volume Flow +500 [l/h]"),
    ("hx_temp_c", "heater_circuit", "Heat Exchanger Temperature [°C]"),
    ("hx_out_c", "heater_circuit", "Temperature Heat Exchanger Outlet [°C]"),
    ("heater_coolant_in_c", "heater_circuit", "Temperature Coolant Heater Inlet [°C]"),
    ("heater_coolant_out_c", "heater_circuit", "Temperature Coolant Heater Outlet [°C]"),
    ("vent_defrost_lat_l_c", "heater_circuit", "Temperature Defrost lateral left [°C]"),
    ("vent_defrost_lat_r_c", "heater_circuit", "Temperature Defrost lateral right [°C]"),
    ("vent_defrost_ctr_c", "heater_circuit", "Temperature Defrost central [°C]"),
    ("vent_defrost_ctr_l_c", "heater_circuit", "Temperature Defrost central left [°C]"),
    ("vent_defrost_ctr_r_c", "heater_circuit", "Temperature Defrost central right [°C]"),
    ("vent_footwell_drv_c", "heater_circuit", "Temperature Footweel Driver [°C]"),
    ("vent_footwell_pax_c", "heater_circuit", "Temperature Footweel Co-Driver [°C]"),
    ("vent_feet_drv_c", "heater_circuit", "Temperature Feetvent Driver [°C]"),
    ("vent_feet_pax_c", "heater_circuit", "Temperature Feetvent Co-Driver [°C]"),
    ("vent_head_drv_c", "heater_circuit", "Temperature Head Driver [°C]"),
    ("vent_head_pax_c", "heater_circuit", "Temperature Head Co-Driver [°C]"),
    ("vent_right_c", "heater_circuit", "Temperature Vent right [°C]"),
    ("vent_ctr_r_c", "heater_circuit", "Temperature Vent central right [°C]"),
    ("vent_ctr_l_c", "heater_circuit", "Temperature Vent central left [°C]"),
    ("heat_power_can_w", "actuator", "Heating Power CAN [kW]"),
    ("heat_power_lin_w", "actuator", "Heating Power LIN [W]"),
    ("aircon_power_w", "actuator", "AirCon Power [kW]"),
    ("heater_signal", "actuator", "Heater Signal"),
    ("heater_voltage_v", "actuator", "Heater Voltage [V]"),
    ("heater_current_a", "actuator", "Heater Current [A]"),
    ("heat_power_req_w", "target", "Requested Heating Power [W]"),
)
# Simulated channels as (canonical, raw header).
SIMULATED = (
    ("time_s", "Time [s]"),
    ("amb_temp_c", "Ambient Temperature [C]"),
    ("slope_rad", "Slope [rad]"),
    ("wind_speed_ms", "Wind Speed [m/s]"),
    ("accel_long_ms2", "Longitudinal Acceleration [m/s^2]"),
    ("speed_ms", "Speed [m/s]"),
    ("position_m", "Position [m]"),
    ("drive_power_w", "Drive Power [W]"),
    ("batt_voltage_v", "Pack Voltage [V]"),
    ("batt_current_a", "Battery Current [A]"),
    ("soc_pct", "SOC [%]"),
    ("batt_temp_c", "Mean Cell Temperature [C]"),
    ("cabin_temp_c", "Cabin Temperature [C]"),
    ("heat_power_req_w", "Heating Power [kW]"),
    ("heat_power_peak_w", "Heating Power inclPeak [kW]"),
    ("coolant_inlet_c", "Heatexchanger Inlet Coolant Temp [C]"),
    ("hx_out_c", "Heatexchanger Outlet Air Temp [C]"),
    ("blower_w", "Blower [W]"),
    ("aux_total_w", "Auxiliaries Total [W]"),
)
# Unit factors and offsets applied once at ingest, run-name codes, the target.
SCALE = {"heat_power_can_w": 1000.0, "aircon_power_w": 1000.0}
OFFSET = {"coolant_flow_lph": -500.0}
SIMULATED_SCALE = {"heat_power_req_w": 1000.0, "heat_power_peak_w": 1000.0}
AMBIENT_CODES = {"Neg10": -10.0, "0": 0.0, "Pos10": 10.0}
TARGET = "heat_power_req_w"
TIERS = ("index", "upstream", "vehicle", "cabin", "heater_circuit", "actuator", "target")


@dataclass(frozen=True)
class Signal:
    canonical: str
    tier: str | None
    header: str


def key_map(signals: list[Signal]) -> dict[str, str]:
    """Header key to canonical name; one key may not name two signals."""
    out: dict[str, str] = {}
    for s in signals:
        key = header_key_of(s.header)
        if out.setdefault(key, s.canonical) != s.canonical:
            raise ValueError(f"header key {key!r} names both {out[key]!r} and {s.canonical!r}")
    return out


@cache
def measured() -> tuple[Signal, ...]:
    return tuple(Signal(name, tier, header) for name, tier, header in MEASURED)


@cache
def simulated() -> tuple[Signal, ...]:
    return tuple(Signal(name, None, header) for name, header in SIMULATED)


def measured_map() -> dict[str, str]:
    return key_map(list(measured()))


def simulated_map() -> dict[str, str]:
    return key_map(list(simulated()))


def columns_in_tiers(*tiers: str) -> list[str]:
    """Canonical names of the given tiers, in schema order."""
    unknown = set(tiers) - set(TIERS)
    if unknown:
        raise ValueError(f"unknown tiers {sorted(unknown)}")
    return [s.canonical for s in measured() if s.tier in tiers]


def select_tiers(df: DataFrame, *tiers: str, keys: tuple[str, ...] = ("trip",)) -> DataFrame:
    """Prune a wide table to the keys and the signals of some tiers; ``<name>__2`` follows its base."""
    wanted = columns_in_tiers(*tiers)
    have = [c for w in wanted for c in (w, f"{w}__2") if c in df.columns]
    return df.select(*keys, *[c for c in have if c not in keys])


def signal_table(spark: SparkSession) -> DataFrame:
    """The vocabulary as a table: canonical, tier, header, header_key."""
    rows = [(s.canonical, s.tier, s.header, header_key_of(s.header)) for s in measured()]
    return spark.createDataFrame(rows, "canonical string, tier string, header string, header_key string")


def apply_units(df: DataFrame, scale: dict[str, float], offset: dict[str, float]) -> DataFrame:
    """Factor then offset, for the columns that are there."""
    def fixed(c: str) -> Column:
        return F.col(c) * scale.get(c, 1.0) + offset.get(c, 0.0)
    return df.withColumns({c: fixed(c) for c in df.columns if c in scale or c in offset})
