import pytest
from pyspark.sql import functions as F

from fieldpulse.functions import keys as K
from fieldpulse.functions.angles import angle_difference, heading, wrap_angle
from fieldpulse.functions.columns import (
    extract_group,
    id_text,
    parse_timestamp,
    replace_labels,
    seconds_between,
    without_nan,
)


def one(spark, column, **values):
    names = list(values) or ["a"]
    kinds = {str: "string", float: "double", int: "bigint"}
    schema = ", ".join(f"{n} {kinds.get(type(values.get(n)), 'string')}" for n in names)
    df = spark.createDataFrame([tuple(values.get(n) for n in names)], schema)
    return df.select(column.alias("v")).first()["v"]


@pytest.mark.parametrize(
    "first, second, turn",
    [(0, 90, 90), (90, 0, -90), (10, 350, -20), (350, 10, 20), (359.99, 0, 0.01), (180, 270, 90)],
)
def test_angle_difference(spark, first, second, turn):
    found = one(spark, angle_difference("a", "b"), a=float(first), b=float(second))
    assert found == pytest.approx(turn, abs=1e-9)


def test_angle_difference_of_opposites_is_half_a_turn(spark):
    assert abs(one(spark, angle_difference("a", "b"), a=0.0, b=180.0)) == pytest.approx(180)


@pytest.mark.parametrize(
    "raw, plain, folded, half",
    [(0, -90, 90, 0), (90, 0, 0, 90), (180, 90, 90, -180), (270, -180, 180, -90), (359.99, -90.01, 90.01, -0.01)],
)
def test_wrap_angle(spark, raw, plain, folded, half):
    value = float(raw)
    assert one(spark, wrap_angle("a", 90, False), a=value) == pytest.approx(plain)
    assert one(spark, wrap_angle("a", 90, True), a=value) == pytest.approx(folded)
    assert one(spark, wrap_angle("a", 180, False), a=value) == pytest.approx(half)


def test_heading_axes(spark):
    assert one(spark, heading(F.col("a"), F.col("b"), "y"), a=1.0, b=0.0) == pytest.approx(90)
    assert one(spark, heading(F.col("a"), F.col("b"), "x"), a=1.0, b=0.0) == pytest.approx(0)
    with pytest.raises(ValueError):
        heading(F.col("a"), F.col("b"), "z")


def test_replace_labels_passes_unknown_and_fills_null(spark):
    mapping = {"a": "A", "b": "B"}
    assert one(spark, replace_labels("a", mapping), a="a") == "A"
    assert one(spark, replace_labels("a", mapping), a="c") == "c"
    assert one(spark, replace_labels("a", mapping), a=None) is None
    assert one(spark, replace_labels("a", mapping, "N"), a=None) == "N"
    assert one(spark, replace_labels("a", {}), a="c") == "c"


def test_extract_group_is_null_without_match(spark):
    assert one(spark, extract_group("a", r"(\d+)", 1), a="x12") == "12"
    assert one(spark, extract_group("a", r"(\d+)", 1), a="x") is None


def test_parse_timestamp_gives_null_for_bad_text(spark):
    assert one(spark, parse_timestamp("a"), a="2016-08-12 00:30:01.500").microsecond == 500_000
    assert one(spark, parse_timestamp("a"), a="12/08/2016") is None


def test_seconds_between(spark):
    a = parse_timestamp(F.lit("2016-08-12 00:30:01.500"))
    b = parse_timestamp(F.lit("2016-08-12 00:30:00.000"))
    assert one(spark, seconds_between(a, b)) == pytest.approx(1.5)
    assert one(spark, seconds_between(a, b, whole=True)) == 1.0


@pytest.mark.parametrize("raw, text", [("31057.0", "31057"), ("31057", "31057"), ("x", None), (None, None), ("9e12", None)])
def test_id_text(spark, raw, text):
    assert one(spark, id_text("a"), a=raw) == text


def test_without_nan(spark):
    assert one(spark, without_nan("a"), a=float("nan")) is None
    assert one(spark, without_nan("a"), a=1.0) == 1.0


def test_build_key_is_null_when_a_part_is(spark):
    assert one(spark, K.build_key("a", "b"), a=1, b="x") == "1-x"
    assert one(spark, K.build_key("a", "b"), a=1, b=None) is None


def test_key_parts(spark):
    key = "26624-1-10"
    assert one(spark, K.key_first("a"), a=key) == "26624"
    assert one(spark, K.key_rest("a"), a=key) == "1-10"
    assert one(spark, K.key_rest("a"), a="alone") == ""
    assert one(spark, K.key_prefix("a"), a=key) == "26624"
    assert one(spark, K.key_after("a"), a=key) == "-1-10"
    assert one(spark, K.key_suffix("a"), a=key) == "0"
    assert one(spark, K.is_unknown_play("a"), a="26624-1-0") is True
    assert one(spark, K.is_unknown_play("a"), a=key) is False
    assert one(spark, K.is_plausible_key("a"), a="Unclear-280-2918") is False
