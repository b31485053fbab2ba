"""Reference formulas of physics and units, as column expressions in SI units."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

# WGS-84 normal gravity, free-air reduction, the standard atmosphere and standard gravity.
G_EQUATOR, G_K, E2 = 9.7803253359, 0.00193185265241, 0.00669437999014
FREE_LINEAR, FREE_LATITUDE, FREE_QUADRATIC, MGAL = 0.3087691, 0.0004398, 7.2125e-8, 1e-5
T0, LAPSE, P0, TROPOPAUSE, T1, P1, R_AIR, EXPONENT = 288.15, 0.0065, 101325.0, 11000.0, 216.65, 22632.06, 287.05287, 5.2558797
G0 = 9.80665
# Units by name: dimension, size and offset in the base unit.
UNITS = {
    "m": ("length", 1.0, 0.0), "km": ("length", 1000.0, 0.0), "cm": ("length", 0.01, 0.0), "s": ("time", 1.0, 0.0), "ms": ("time", 0.001, 0.0), "kg": ("mass", 1.0, 0.0), "g": ("mass", 0.001, 0.0),
    "m/s": ("speed", 1.0, 0.0), "km/h": ("speed", 1000.0 / 3600.0, 0.0), "kn": ("speed", 1852.0 / 3600.0, 0.0), "m/s2": ("acceleration", 1.0, 0.0), "gal": ("acceleration", 0.01, 0.0), "mgal": ("acceleration", 1e-5, 0.0),
    "N": ("force", 1.0, 0.0), "kN": ("force", 1000.0, 0.0), "Pa": ("pressure", 1.0, 0.0), "hPa": ("pressure", 100.0, 0.0), "kPa": ("pressure", 1000.0, 0.0), "bar": ("pressure", 100000.0, 0.0),
    "K": ("temperature", 1.0, 0.0), "degC": ("temperature", 1.0, 273.15), "kg/m3": ("density", 1.0, 0.0), "deg": ("angle", math.pi / 180.0, 0.0), "rad": ("angle", 1.0, 0.0),
}


def convert(value: Column, source: str, target: str) -> Column:
    """``value`` from one unit to another of the same dimension; other pairs are refused."""
    (da, a, oa), (db, b, ob) = UNITS[source], UNITS[target]
    if da != db:
        raise ValueError(f"cannot convert {da} to {db}")
    return (value.cast("double") * F.lit(a) + F.lit(oa) - F.lit(ob)) / F.lit(b)


def gravity(latitude_deg: Column, altitude_m: Column) -> Column:
    """Normal gravity at a latitude, reduced to an altitude of up to 20 km."""
    s = F.pow(F.sin(F.radians(latitude_deg.cast("double"))), F.lit(2.0))
    h = altitude_m.cast("double")
    surface = F.lit(G_EQUATOR) * (F.lit(1.0) + F.lit(G_K) * s) / F.sqrt(F.lit(1.0) - F.lit(E2) * s)
    return surface + (-(F.lit(FREE_LINEAR) - F.lit(FREE_LATITUDE) * s) * h + F.lit(FREE_QUADRATIC) * h * h) * F.lit(MGAL)


def temperature(altitude_m: Column) -> Column:
    h = altitude_m.cast("double")
    return F.when(h <= TROPOPAUSE, F.lit(T0) - F.lit(LAPSE) * h).otherwise(F.lit(T1))


def pressure(altitude_m: Column) -> Column:
    """Pressure of the standard atmosphere up to 20 km."""
    h = altitude_m.cast("double")
    low = F.lit(P0) * F.pow(temperature(h) / F.lit(T0), F.lit(EXPONENT))
    return F.when(h <= TROPOPAUSE, low).otherwise(F.lit(P1) * F.exp(F.lit(-G0) * (h - F.lit(TROPOPAUSE)) / F.lit(R_AIR * T1)))


def density(altitude_m: Column) -> Column:
    return pressure(altitude_m) / (F.lit(R_AIR) * temperature(altitude_m))


def weight(mass_kg: Column) -> Column:
    return mass_kg.cast("double") * F.lit(G0)


def hydrostatic(depth_m: Column, density_kg_m3: Column) -> Column:
    return density_kg_m3.cast("double") * F.lit(G0) * depth_m.cast("double")


def dynamic_pressure(density_kg_m3: Column, speed: Column) -> Column:
    return F.lit(0.5) * density_kg_m3.cast("double") * speed * speed


def apex_height(speed: Column) -> Column:
    return speed.cast("double") * speed / F.lit(2.0 * G0)


def apex_time(speed: Column) -> Column:
    return speed.cast("double") / F.lit(G0)


def launch_speed(height: Column) -> Column:
    return F.sqrt(F.lit(2.0 * G0) * height.cast("double"))
