"""Edge cases of the scalar rules (FIXTURES §4): exact thresholds, unit gaps, NULL handling."""

from pyspark.sql import functions as F

from riskframe.functions import rules, units


def _one(spark, schema, rows, expr):
    return [r[0] for r in spark.createDataFrame(rows, schema).select(expr).collect()]


def test_height_units_and_gaps(spark):
    rows = [(1.6,), (65.0,), (170.0,), (1.0,), (2.2,), (30.0,), (84.0,), (100.0,), (125.0,), (None,)]
    got = _one(spark, "h double", rows, units.height_to_cm("h"))
    assert got[0] == 160.00000000000003 or abs(got[0] - 160.0) < 1e-9
    assert abs(got[1] - 165.1) < 1e-9
    assert got[2] == 170.0
    assert got[3:] == [0.0] * 7          # undecidable gaps and NULL -> 0


def test_weight_follows_height_unit(spark):
    rows = [(65.0, 150.0), (170.0, 70.0), (None, 80.0), (170.0, None)]
    got = _one(spark, "h double, w double", rows, units.weight_to_kg("h", "w"))
    assert abs(got[0] - 150 * 0.45359237) < 1e-9
    assert got[1] == 70.0 and got[2] == 80.0 and got[3] is None


def test_pound_suspicion_bands(spark):
    rows = [(150.0, 86.7), (150.0, 86.6), (153.0, 87.0), (195.0, 121.0), (1.6, 100.0)]
    got = _one(spark, "h double, w double", rows, units.weight_to_kg_with_suspicion("h", "w"))
    assert abs(got[0] - 86.7 * 0.45359237) < 1e-9     # at the limit: converted
    assert got[1] == 86.6
    assert abs(got[2] - 87.0 * 0.45359237) < 1e-9
    assert abs(got[3] - 121.0 * 0.45359237) < 1e-9
    assert abs(got[4] - 100.0 * 0.45359237) < 1e-9   # metre heights fall in the first band


def test_bmi_zero_height_is_null(spark):
    got = _one(spark, "h double, w double", [(0.0, 70.0), (200.0, 80.0)], units.bmi("h", "w"))
    assert got[0] is None and abs(got[1] - 20.0) < 1e-9


def test_frax_band_edges(spark):
    got = _one(spark, "p double", [(9.99,), (10.0,), (20.0,), (20.01,), (None,)], rules.frax_band("p"))
    assert got == ["Low", "Moderate", "Moderate", "High", ""]


def test_caroc_thresholds_exact(spark):
    # female, age exactly 60 -> band "<65": high -2.3, low -3.7; T exactly on a threshold is not above it
    schema = ("bmdtest_tscore_fn double, PatientAge double, PatientGender int, oralster int, obreak int, ankle int, "
              "clavicle int, elbow int, femur int, wrist int, shoulder int, tibfib int, hip int, spine int")
    z = (0,) * 11
    rows = [(-2.3, 60.0, 1, *z), (-2.29, 60.0, 1, *z), (-3.7, 60.0, 1, *z), (-2.0, 85.0, 2, *z),
            (-1.99, 85.0, None, *z), (None, 70.0, 1, *z), (-1.0, 70.0, 1, 1, 0, *(0,) * 9),
            (None, 70.0, 1, 0, 0, *(0,) * 7, 1, 0)]
    df = spark.createDataFrame(rows, schema)
    got = [r[0] for r in df.select(rules.caroc_risk().alias("r")).collect()]
    assert got[0] == 1        # -2.3 is not > -2.3 -> 1
    assert got[1] == 0
    assert got[2] == 2        # <= low
    assert got[3] == 1        # male 85+: high -2.0
    assert got[4] == 0        # NULL gender uses the male table
    assert got[5] is None     # missing T-score stays missing
    assert got[6] == 1        # oralster bumps 0 -> 1
    assert got[7] == 2        # hip fracture overrides even without a T-score


def test_staged_rule_equals_single_expression(spark):
    schema = ("bmdtest_tscore_fn double, PatientAge double, PatientGender int, oralster int, obreak int, ankle int, "
              "clavicle int, elbow int, femur int, wrist int, shoulder int, tibfib int, hip int, spine int")
    rows = [(t / 10.0, float(a), g, 0, 2 if t % 3 == 0 else 0, 0, 0, 0, 0, 0, 0, 0, 0, 0)
            for t in range(-45, 5, 3) for a in (55, 60, 64, 65, 80, 85, 90) for g in (1, 2)]
    df = spark.createDataFrame(rows, schema)
    a = df.select(rules.caroc_risk().alias("r")).collect()
    b = rules.with_caroc_risk(df, "r").select("r").collect()
    assert a == b


def test_days_and_second_fracture_flag(spark):
    import datetime as dt
    rows = [(dt.datetime(2020, 1, 1, 23), dt.datetime(2022, 1, 1, 1)), (dt.datetime(2020, 1, 1), None)]
    df = spark.createDataFrame(rows, "a timestamp_ntz, b timestamp_ntz")
    d = rules.abs_days_between("a", "b")
    got = df.select(d.alias("d"), rules.within_days(d).alias("f")).collect()
    assert got[0]["d"] == 730 and got[0]["f"] is True
    assert got[1]["d"] is None and got[1]["f"] is False
