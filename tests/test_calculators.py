import pytest
from pyspark.sql import functions as F

from loomwork.functions import calculators as calc
from loomwork.functions import scalars

L = F.lit


def run(spark, column):
    return spark.range(1).select(column.alias("r")).first()["r"]


def test_bmr(spark):
    assert run(spark, calc.bmr(L("male"), L(70.0), L(175.0), L(25.0)))["data"]["bmr"] == pytest.approx(1673.75)
    assert run(spark, calc.bmr(L("female"), L(60.0), L(165.0), L(25.0)))["data"]["bmr"] == pytest.approx(1345.25)
    bad = run(spark, calc.bmr(L("male"), L(0.0), L(175.0), L(25.5)))
    assert not bad["ok"] and bad["data"] is None and set(bad["errors"]) == {"weightKg", "age"}


def test_tdee(spark):
    assert run(spark, calc.tdee(L(1673.75), L("moderate")))["data"]["tdee"] == pytest.approx(2594.31, abs=0.01)


def test_body_fat(spark):
    none = L(None).cast("double")
    assert run(spark, calc.body_fat(L("male"), L(170.0), L(40.0), L(80.0), none))["data"][0] == pytest.approx(11.96, abs=0.01)
    assert run(spark, calc.body_fat(L("female"), L(160.0), L(34.0), L(70.0), L(95.0)))["data"][0] == pytest.approx(25.17, abs=0.05)
    assert not run(spark, calc.body_fat(L("male"), L(170.0), L(90.0), L(80.0), none))["ok"]
    assert "hipCm" in run(spark, calc.body_fat(L("female"), L(160.0), L(34.0), L(70.0), none))["errors"]


@pytest.mark.parametrize("goal, expected", [("cut", (2000, 154, 55.56, 221)), ("bulk", (2750, 126, 76.39, 389.63)), ("maintain", (2500, 126, 69.44, 342.75))])
def test_macros(spark, goal, expected):
    d = run(spark, calc.macros(L(2500.0), L(70.0), L(goal)))["data"]
    assert (d["calories"], d["proteinG"], d["fatG"], d["carbsG"]) == pytest.approx(expected, abs=0.01)


def test_macros_override(spark):
    assert run(spark, calc.macros(L(2500.0), L(70.0), L("cut"), L(0.9)))["data"]["calories"] == pytest.approx(2250)


def test_ffmi(spark):
    assert tuple(run(spark, calc.ffmi(L(80.0), L(180.0), L(15.0)))["data"]) == pytest.approx((68, 20.99, 20.99), abs=0.01)
    assert tuple(run(spark, calc.ffmi(L(80.0), L(170.0), L(15.0)))["data"])[1:] == pytest.approx((23.53, 24.14), abs=0.01)


def test_one_rm(spark):
    assert tuple(run(spark, calc.one_rm(L(100.0), L(5)))["data"]) == pytest.approx((116.67, 112.5), abs=0.01)
    assert not run(spark, calc.one_rm(L(100.0), L(0)))["ok"]


def test_last_issue_wins(spark):
    rules = [("a", L(False), "first"), ("a", L(False), "last")]
    assert run(spark, calc.validated(rules, L(1)))["errors"] == {"a": "first"}
    assert run(spark, calc.validated(rules, L(1), last_wins=True))["errors"] == {"a": "last"}


@pytest.mark.parametrize(
    "at, offset, start",
    [("2026-10-05 13:27:51", 480, "2026-10-04 16:00:00"), ("2026-10-05 15:59:59", 480, "2026-10-04 16:00:00"), ("2026-10-05 16:00:00", 480, "2026-10-05 16:00:00"), ("2026-10-05 02:00:00", -300, "2026-10-04 05:00:00")],
)
def test_start_of_day(spark, at, offset, start):
    assert run(spark, F.date_format(scalars.start_of_day(L(at).cast("timestamp"), offset), "yyyy-MM-dd HH:mm:ss")) == start


def test_log_line(spark):
    assert run(spark, scalars.log_line(L("bmr"), L('{"bmr": 1673.4, "tdee": 2594}'))) == "BMR 1673 kcal · TDEE 2594 kcal"
    assert run(spark, scalars.log_line(L("bodyfat"), L('{"bodyFatPct": 11.96}'))) == "体脂率 12.0%"
    assert run(spark, scalars.log_line(L("macros"), L("{"))) == "{"
    assert run(spark, scalars.log_line(L("other"), L("{}"))) == "{}"


def test_retryable(spark):
    none, no = L(None).cast("int"), L(False)
    text = L("x")
    cases = [(L("AbortError"), L(503), False), (text, L(429), True), (text, L(500), True), (text, L(404), False), (L("TimeoutError"), none, True), (text, none, False)]
    for name, status, expected in cases:
        assert run(spark, scalars.retryable(name, status, L(None).cast("string"), no, L(""))) is expected
    assert run(spark, scalars.retryable(text, none, L("ECONNRESET"), no, L(""))) is True
    assert run(spark, scalars.retryable(L("TypeError"), none, L(None).cast("string"), no, L("fetch failed"))) is True


def test_backend(spark):
    keys = {"deepseek": L(""), "claude": L("k")}
    assert [run(spark, scalars.backend(L(m).cast("string"), keys)) for m in (None, "deepseek", "claude", "rule", "odd")] == ["claude", "rule", "claude", "rule", "claude"]


def test_small_scalars(spark):
    assert run(spark, scalars.sigmoid(L(-1000.0))) == 0.0 and run(spark, scalars.sigmoid(L(0.0))) == 0.5
    assert run(spark, scalars.backoff(L(2), 100, 300, L(0.5))) == 225
    assert run(spark, scalars.retry_after_seconds(L(6001))) == 7 and run(spark, scalars.retry_after_seconds(L(0))) == 1
    assert run(spark, scalars.cleaned_request_id(L("a b\x1b[c"))) == "abc"
    assert run(spark, scalars.ratios(L(0.0), L(0.0), L(0.0))) is None
