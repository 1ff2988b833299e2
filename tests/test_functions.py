"""Expressions, one row at a time."""

import math

import pytest
from pyspark.sql import functions as F

from kerbline.functions import emissions, kinematics, rates, safety
from kerbline.params import Params

P = Params()


def column(spark, values, kind="double"):
    return spark.createDataFrame([(i, v) for i, v in enumerate(values)], f"i int, x {kind}").orderBy("i")


def results(df, expression):
    return [r[0] for r in df.select(expression).collect()]


def power_by_hand(v, a, mass, drag, front, rolling, rotating=1.04, drive=0.92):
    """Resistance forces in newtons times speed, in kilowatts."""
    roll = mass * 9.80665 * rolling / 1000 * (0.0328 * v * 3.6 + 4.575)
    air = 0.5 * 1.2256 * drag * front * v * v
    return (mass * rotating * a + roll + air) * v / drive / 1000


@pytest.mark.parametrize("acceleration", [-3.0, -0.4, 0.0, 0.9])
def test_power_of_several_speeds(spark, acceleration):
    speeds = [0.0, 3.0, 13.9, 25.0, 41.5]
    df = column(spark, speeds)
    power = results(df, emissions.traction_power_kw(F.col("x"), F.lit(acceleration), F.lit("LDV")))
    assert power == pytest.approx([power_by_hand(v, acceleration, 1453, 0.3, 2.32, 1.75) for v in speeds])
    assert power[0] == 0 and (power[3] < 0) == (acceleration < 0)


@pytest.mark.parametrize("category", ["LDV", "HDDT"])
def test_fuel_of_idle_braking_and_load(spark, category):
    df = column(spark, [-40.0, 0.0, None, 7.5, 22.0, 80.0, 160.0])
    lps = emissions.fuel_lps(F.col("x"), F.lit(category))
    idle, zero, unknown, *load = results(df, lps)
    assert idle == zero == unknown > 0 and all(low < high for low, high in zip([idle, *load], load))
    # A parabola in power: the third differences of equal steps vanish.
    steps = results(column(spark, [10.0, 20.0, 30.0, 40.0]), lps)
    assert steps[3] - 3 * steps[2] + 3 * steps[1] - steps[0] == pytest.approx(0, abs=1e-12)
    per_litre = {"LDV": 2310, "HDDT": 2680}[category]
    assert results(df, emissions.co2_gps(lps, F.lit(category))) == pytest.approx([per_litre * f for f in [idle, zero, unknown, *load]])


def test_category_and_class_codes(spark):
    df = column(spark, ["1", "2", "Truck", "Car", "Bus", None], "string")
    assert results(df, emissions.vehicle_category(F.col("x"))) == ["LDV", "HDDT", "HDDT", "LDV", "LDV", "LDV"]
    assert results(df, kinematics.encode_class(F.col("x"))) == [None, None, 2, 1, None, None]
    assert results(df, kinematics.decode_class(F.col("x"))) == ["Car", "Truck", "Truck", "Car", "Bus", None]
    assert results(df, kinematics.recode_class(F.col("x"))) == [1, 2, 2, 1, None, None]


def test_specific_power(spark):
    df = column(spark, [10.0])
    vsp = results(df, emissions.specific_power(F.col("x"), F.lit(0.5), F.lit(1500.0)))[0]
    assert vsp == pytest.approx((5.0 + 0.35 + 1.32 + 0.0302) / 1500)
    line = column(spark, [-1.0, 0.0, 2.0])
    assert results(line, emissions.specific_power_rate(F.col("x"), "co2")) == pytest.approx([0.5, 0.5, 1.9])
    assert results(line, emissions.specific_power_rate(F.col("x"), "nox")) == pytest.approx([0.05, 0.05, 0.25])
    frame = spark.createDataFrame([(10.0, 0.5, 1), (10.0, 0.5, 2)], "v_long_smooth float, a_long_smooth float, veh_class int")
    by_class = emissions.add_specific_power(emissions.add_fuel_model(frame), Params(vsp_mass_by_class=True)).collect()
    assert by_class[0].vsp_value / by_class[1].vsp_value == pytest.approx(8000 / 1500, rel=1e-5)
    same = emissions.add_specific_power(emissions.add_fuel_model(frame), P).collect()
    assert same[0].vsp_value == same[1].vsp_value


def test_drac(spark):
    df = spark.createDataFrame(
        [(0, 20.0, 5.0), (1, 5.0, 5.0), (2, None, 5.0), (3, 20.0, 0.0), (4, 20.0, -4.0), (5, -1.0, 0.0), (6, 20.0, None)],
        "i int, g double, c float").orderBy("i")
    got = results(df, safety.drac(F.col("g"), F.col("c")))
    inf = math.inf
    assert got == pytest.approx([25 / 30, inf, inf, 0.0, 16 / 40, inf, inf])


def test_protected_divide_and_risk(spark):
    df = spark.createDataFrame([(0, 8.0, 0.0), (1, 8.0, 2.0), (2, None, 2.0), (3, 8.0, None)], "i int, n double, d double").orderBy("i")
    assert results(df, safety.protected_divide(F.col("n"), F.col("d"))) == [99.0, 4.0, None, None]
    ttc = column(spark, [-1.0, 1.99, 2.0, 3.99, 4.0, 99.0], "float")
    assert results(ttc, safety.risk_level(F.col("x"), P)) == [2, 2, 1, 1, 0, 0]


def test_ttc_conventions_and_raw_mode(spark):
    df = spark.createDataFrame(
        [(0, 20.0, 4.0, 0.0, 20.0), (1, 20.0, -4.0, 3.0, 20.0), (2, None, None, 0.0, 0.0), (3, -2.0, -4.0, 0.0, 5.0), (4, 20.0, 0.0, 2.5, 20.0)],
        "i int, dist_headway double, rel_velocity float, ttc_raw float, dist_headway_raw float").orderBy("i")
    ttc = lambda p: [r.TTC for r in safety.add_safety(df, p).collect()]
    assert ttc(P) == [99.0, 5.0, 99.0, -0.5, 99.0]
    assert ttc(Params(ttc_convention="closing")) == [5.0, 99.0, 99.0, 99.0, 99.0]
    raw = safety.add_safety(df, Params(recompute_safety=False)).collect()
    assert [r.TTC for r in raw] == [99.0, 3.0, 99.0, 99.0, 2.5]
    assert raw[0].DRAC == pytest.approx(16 / 32) and raw[1].DRAC == pytest.approx(16 / 40)
    assert [r.risk_level for r in safety.add_safety(df, P).collect()] == [0, 0, 0, 2, 0]


def test_bins_on_their_edges(spark):
    df = column(spark, [0.0, 1.9, 2.0, 2.5, 3.0, 3.5, 4.0, 9.0, -1.0, None])
    assert results(df, rates.ttc_bucket(F.col("x"))) == [
        "<2", "<2", "2-3", "2-3", "3-4", "3-4", ">=4", ">=4", "<2", "unknown"]
    assert results(df, rates.severity_bin(F.col("x"))) == [
        "<=2s", "<=2s", "<=2s", "(2,3]s", "(2,3]s", "(3,4]s", "(3,4]s", ">4s", "unknown", "unknown"]
    length = column(spark, [0.0, 0.4, 0.6, 0.7, 0.8, 1.0, 1.01, -0.1, None])
    assert results(length, rates.duration_bin(F.col("x"))) == [
        "<=0.4s", "<=0.4s", "(0.4,0.6]s", "(0.6,0.8]s", "(0.6,0.8]s", "(0.8,1.0]s", ">1.0s", "unknown", "unknown"]


def test_rates_guard_their_denominator(spark):
    df = column(spark, [2000.0, 0.0, 1e-6, -5.0, None])
    assert results(df, rates.per_km(F.lit(10.0), F.col("x"))) == [5.0, None, None, None, None]
    assert results(df, rates.per_second(F.lit(10.0), F.col("x"))) == [0.005, None, 1e7, None, None]


LENGTHS = [0.04, 1 / 29.97, 3.0, 7.0, 60.0, 2500.0]


@pytest.mark.parametrize("length", LENGTHS)
def test_durations_are_sums_of_frame_lengths(spark, length):
    def total(frames, known=F.lit(1)):
        seconds = rates.frame_seconds(frames.columns, 25.0)
        return frames.agg(rates.total_seconds(F.sum(seconds), F.max(known), F.min("id"), F.max("id"), 25.0)).first()[0]

    rows = spark.range(15)
    stored = rows.select("id", F.lit(length).cast("float").alias("dt"))
    assert total(stored.withColumn("frame_s", F.lit(length))) == round(15 * length, 9)
    assert total(stored) == pytest.approx(15 * length, rel=1e-7)
    assert total(stored.filter("id % 2 = 0")) == pytest.approx(8 * length, rel=1e-7)
    unknown = stored.withColumn("dt", F.lit(None).cast("float"))
    assert total(unknown.filter("id % 2 = 0"), F.lit(0)) == 15 / 25  # the span of frames at the default rate
    assert total(rows.withColumn("dt", F.lit(0.0))) == pytest.approx(15 / 25)


@pytest.mark.parametrize("length", LENGTHS)
def test_thresholds_are_reached_in_single_precision(spark, length):
    stored = spark.range(10).select(F.lit(length).cast("float").cast("double").alias("dt")).agg(F.sum("dt").alias("d"))
    assert stored.select(rates.reaches(F.col("d"), 10 * length), rates.reaches(F.col("d"), 10.01 * length)).first() == (True, False)


def test_unknown_rates_count_nothing(spark):
    df = spark.createDataFrame([(1, None), (1, 2.0), (2, None)], "g int, r double")
    sums = dict(df.groupBy("g").agg(rates.integral(F.col("r"), F.lit(0.5))).collect())
    assert sums == {1: 1.0, 2: 0.0}


def test_names_of_recordings(spark):
    df = column(spark, [1, 12, 123], "int")
    assert results(df, kinematics.recording_name(F.col("x"))) == ["recording_01", "recording_12", "recording_123"]
    back = results(df, kinematics.recording_of_name(kinematics.recording_name(F.col("x"))))
    assert back == [1, 12, 123]
    odd = column(spark, ["recording_x", "recording_07"], "string")
    assert results(odd, kinematics.recording_of_name(F.col("x"))) == [None, 7]


def test_box_scaling_survives_an_extent_of_zero(spark):
    df = column(spark, [5.0])
    assert results(df, kinematics.scale_to_box(F.col("x"), F.lit(5.0), F.lit(5.0), 720)) == [0.0]


def test_parameters_round_half_to_even():
    assert Params(frame_rate=25.0).frames(3.0) == 75
    assert Params(frame_rate=1.0).frames(2.5) == 2 and Params(frame_rate=1.0).frames(3.5) == 4
