"""Expressions of power, fuel and emission rates per frame."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, functions as F

from kerbline.params import Params

# Published parameters of the power-based fuel model, light duty and heavy duty.
FUEL_MODEL = {
    "LDV": {
        "mass_kg": 1453.0, "cd": 0.30, "area_m2": 2.32, "eta_d": 0.92, "lambda_rot": 0.04,
        "Cr": 1.75, "c1": 0.0328, "c2": 4.575,
        "alpha0": 4.7738e-4, "alpha1": 5.363e-5, "alpha2": 1.0e-6,
        "co2_g_per_l": 2310.0,
    },
    "HDDT": {
        "mass_kg": 7239.0, "cd": 0.78, "area_m2": 8.90, "eta_d": 0.95, "lambda_rot": 0.10,
        "Cr": 1.75, "c1": 0.0328, "c2": 4.575,
        "alpha0": 4.7738e-4, "alpha1": 5.363e-5, "alpha2": 1.0e-6,
        "co2_g_per_l": 2680.0,
    },
}
AIR_DENSITY = 1.2256
GRAVITY = 9.80665

# Specific-power polynomial and its emission lines.
VSP_AIR, VSP_ROLLING, VSP_DRIVETRAIN = 0.00035, 0.132, 0.000302
VSP_GRAVITY, ROAD_GRADE = 9.81, 0.0
VSP_MASS = {"LDV": 1500.0, "HDDT": 8000.0}
VSP_LINES = {"co2": (0.7, 0.5), "nox": (0.1, 0.05)}


def vehicle_category(veh_class: Column) -> Column:
    """Model category of a class code or name; everything that is not a truck is light duty."""
    is_truck = veh_class.cast("string").isin("2", "Truck")
    return F.when(is_truck, F.lit("HDDT")).otherwise(F.lit("LDV"))


def model_parameter(category: Column, name: str) -> Column:
    light, heavy = FUEL_MODEL["LDV"][name], FUEL_MODEL["HDDT"][name]
    if light == heavy:
        return F.lit(light)
    return F.when(category == "LDV", F.lit(light)).otherwise(F.lit(heavy))


def traction_power_kw(speed: Column, acceleration: Column, category: Column) -> Column:
    v, a = speed.cast("double"), acceleration.cast("double")
    mass = model_parameter(category, "mass_kg")
    inertia = mass * (1 + model_parameter(category, "lambda_rot")) * a
    rolling = (
        mass * GRAVITY * model_parameter(category, "Cr") / 1000.0
        * (model_parameter(category, "c1") * (v * 3.6) + model_parameter(category, "c2"))
    )
    drag = 0.5 * AIR_DENSITY * model_parameter(category, "area_m2") * model_parameter(category, "cd") * (v * v)
    return (inertia + rolling + drag) * v / (1000.0 * model_parameter(category, "eta_d"))


def fuel_lps(power_kw: Column, category: Column) -> Column:
    idle = model_parameter(category, "alpha0")
    load = (
        idle + model_parameter(category, "alpha1") * power_kw
        + model_parameter(category, "alpha2") * (power_kw * power_kw)
    )
    return F.when(power_kw >= 0, load).otherwise(idle)


def co2_gps(fuel: Column, category: Column) -> Column:
    return fuel * model_parameter(category, "co2_g_per_l")


def specific_power(speed: Column, acceleration: Column, mass: Column) -> Column:
    v, a = speed.cast("double"), acceleration.cast("double")
    slope = VSP_GRAVITY * math.sin(ROAD_GRADE)
    return (v * a + VSP_AIR * (v * v * v) + VSP_ROLLING * v + VSP_DRIVETRAIN * (v * v) + slope * v) / mass


def specific_power_rate(vsp: Column, gas: str) -> Column:
    slope, idle = VSP_LINES[gas]
    return F.when(vsp < 0, F.lit(idle)).otherwise(slope * vsp + idle)


def add_fuel_model(df: DataFrame) -> DataFrame:
    """Needs v_long_smooth, a_long_smooth and veh_class; adds category, speeds, power, fuel and CO2."""
    category = F.col("vehicle_type")
    return (
        df.withColumn("vehicle_type", vehicle_category(F.col("veh_class")))
        .withColumns({
            "v_kmh": (F.col("v_long_smooth").cast("double") * 3.6).cast("float"),
            "a_kmhps": (F.col("a_long_smooth").cast("double") * 3.6).cast("float"),
            "_power": traction_power_kw(F.col("v_long_smooth"), F.col("a_long_smooth"), category),
        })
        .withColumn("_fuel", fuel_lps(F.col("_power"), category))
        .withColumns({
            "cpf_power_kw": F.col("_power").cast("float"),
            "cpf_fuel_rate_lps": F.col("_fuel").cast("float"),
            "cpf_co2_rate_gps": co2_gps(F.col("_fuel"), category).cast("float"),
        })
        .drop("_power", "_fuel")
    )


def add_specific_power(df: DataFrame, p: Params) -> DataFrame:
    mass = F.lit(VSP_MASS["LDV"])
    if p.vsp_mass_by_class:
        mass = F.when(F.col("vehicle_type") == "HDDT", F.lit(VSP_MASS["HDDT"])).otherwise(mass)
    vsp = specific_power(F.col("v_long_smooth"), F.col("a_long_smooth"), mass)
    return (
        df.withColumn("vsp_value", vsp.cast("float"))
        .withColumns({
            "vsp_co2_rate": specific_power_rate(F.col("vsp_value"), "co2").cast("float"),
            "vsp_nox_rate": specific_power_rate(F.col("vsp_value"), "nox").cast("float"),
        })
    )
