"""Rounding as the SQL rounds."""

from pyspark.sql import functions as F

from candlemill.functions.columns import half_away
from candlemill.operators.signals import round_interval


def test_rounding_is_binary_with_halves_away_from_zero(spark):
    x = [32.0203035, 8.0733635, 0.5, -0.5, 2.5, -2.5, 0.49999999999999994, 1e300, float("nan"), None]
    got = [r[0] for r in spark.createDataFrame([(v,) for v in x], "x double").select(half_away(F.col("x"), 6)).collect()]
    assert got[:2] == [32.020303, 8.073363] and got[2:6] == [0.5, -0.5, 2.5, -2.5] and got[6] == 0.5 and got[7] == 1e300
    assert got[8] != got[8] and got[9] is None
    whole = [r[0] for r in spark.createDataFrame([(v,) for v in x[2:7]], "x double").select(half_away(F.col("x"))).collect()]
    assert whole == [1.0, -1.0, 3.0, -3.0, 0.0]


def test_round_interval_is_a_twentieth_of_an_exact_power_of_ten(spark):
    got = spark.createDataFrame([(2.45e-5,), (3e-11,), (7.0,)], "p double").select(round_interval(F.col("p"))).collect()
    assert [r[0] for r in got] == [1e-5 * 0.05, 1e-11 * 0.05, 0.05]
