"""Scalar expressions against Python's own arithmetic."""

import math

import pytest
from pyspark.sql import functions as F

from rankloom.functions import scalar

CASES = [
    ("height", {"height": 7.25}, [], 7.25),
    ("left - right * 3", {"left": 10, "right": 2.5}, [], 10 - 2.5 * 3),
    ("_0 / (_1 + 1)", {}, [9.0, 2.0], 9 / 3),
    ("(price - _0) * (price + _0)", {"price": 6}, [2.5], 36 - 6.25),
    ("sqrt(sqr(a) + sqr(b))", {"a": 5, "b": 12}, [], math.hypot(5, 12)),
    ("exp(ln(4) / 2) - pow(2, 0 - 3)", {}, [], 2 - 1 / 8),
    ("log(1000) + log(81, 3)", {}, [], 7.0),
    ("floor(0 - 2.5) * ceil(2.1)", {}, [], -9.0),
    ("mod(29, 8) + fabs(0 - 4.75)", {}, [], 9.75),
    ("- - - 5 + +3", {}, [], -2.0),
    ("100 - 30 - 7 - 1", {}, [], 62.0),
    ("360 / 5 / 4", {}, [], 18.0),
    ("and(44, 15) + or(36, 9) / 5 - xor(5, 3) + bcnt(96)", {}, [], (44 & 15) + (36 | 9) / 5 - (5 ^ 3) + 2),
    ("if_lt(1, 2, if_ge(4, 4, 11, 12), 13)", {}, [], 11.0),
    ("if_le(3, 2, 1, if_gt(7, 6.5, k, 0))", {"k": 0.125}, [], 0.125),
    ("if_eq(2, 2 + 0.000000001, 1, 0) - if_eq(2, 2.01, 1, 0)", {}, [], 1.0),
    ("atan(1) * 4 + asin(1) - acos(0)", {}, [], math.pi),
    ("sinh(1) + cosh(1) - tanh(0)", {}, [], math.e),
    ("sqr(sin(0.7)) + sqr(cos(0.7)) + tan(0)", {}, [], 1.0),
    ("0 / 0", {}, [], 0.0),
]


def value(spark, *a, **k):
    return spark.range(1).select(scalar.compile(*a, **k).alias("v")).first().v


@pytest.mark.parametrize("text,variables,args,want", CASES)
def test_expression(spark, text, variables, args, want):
    assert value(spark, text, [F.lit(float(a)) for a in args], variables=variables) == pytest.approx(want, abs=1e-7)


def test_columns_and_constants_together(spark):
    """A saturating term frequency with a length norm, over columns."""
    rows = spark.createDataFrame([(1.0, 20.0), (4.0, 80.0), (0.0, 5.0)], "tf double, size double")
    got = scalar.compile("if_gt(tf, 0, ln(1 + tf) / (1 + slope * (size / mean - 1)), 0)", names={"tf": F.col("tf"), "size": F.col("size")}, variables={"slope": 0.4, "mean": 40})
    want = [math.log(2) / (1 + 0.4 * (0.5 - 1)), math.log(5) / (1 + 0.4 * (2 - 1)), 0.0]
    assert [r.v for r in rows.select(got.alias("v")).collect()] == pytest.approx(want)


def test_logarithms_of_nothing(spark):
    assert value(spark, "log(0)") == -math.inf and value(spark, "ln(0)") == -math.inf
    assert math.isnan(value(spark, "ln(0 - 1)"))


def test_errors(spark):
    for bad in ("3 *", "unheard_of(2)", "4 5", "sqr()", "((2)", "a ? b"):
        with pytest.raises(ValueError):
            scalar.compile(bad, variables={"a": 1, "b": 2})
    with pytest.raises(ValueError):
        scalar.compile("nobody")
    with pytest.raises(Exception, match="division by zero"):
        value(spark, "5 / (2 - 2)")


def test_custom_function(spark):
    scalar.define("halved", 1)(lambda x: x / 2)
    assert value(spark, "halved(9) + 1") == 5.5
