"""Statistics against closed forms and published values; edge cases of attribution."""

import datetime as dt
import math

import pytest
from pyspark.sql import functions as F

from liftworks.functions import columns as C
from liftworks.functions import stats as S
from liftworks.operators import contact, effect, population, vintage


def value(spark, text):
    return spark.range(1).select(F.expr(text).alias("v")).first()["v"]


@pytest.mark.parametrize("x", [0.0, 0.5, 1.0, 1.959963984540054, 3.0, 6.0])
def test_erfc(spark, x):
    assert value(spark, S.erfc(f"{x!r}e0")) == pytest.approx(math.erfc(x), rel=2e-7)


@pytest.mark.parametrize(("s1", "n1", "s0", "n0", "p"), [(30, 842, 1, 210, 0.0179637), (965, 15597, 196, 3899, 0.0061818), (0, 0, 1, 5, 1.0), (5, 5, 5, 5, 1.0), (0, 9, 0, 9, 1.0)])
def test_z_test(spark, s1, n1, s0, n0, p):
    assert value(spark, S.z_test_p(str(n1), str(s1), str(n0), str(s0))) == pytest.approx(p, abs=1e-6)


@pytest.mark.parametrize(("n1", "n0", "split", "chi2"), [(1999540, 111408, 0.95, 342.54), (894779, 77817, 0.95, 18439.91), (132015, 14703, 0.9, 0.07), (158895, 8336, 0.95, 0.08)])
def test_sample_ratio(spark, n1, n0, split, chi2):
    assert value(spark, S.srm_chi2(str(n1), str(n0), f"{split}e0")) == pytest.approx(chi2, abs=0.006)


def test_chi2_p(spark):
    assert value(spark, S.chi2_p(S.srm_chi2("132015", "14703", "0.9e0"))) == pytest.approx(0.7860, abs=2e-4)


def test_fiscal_and_keys(spark):
    d = spark.createDataFrame([(dt.date(2024, 11, 1), " 00012 "), (dt.date(2025, 1, 31), "000"), (dt.date(2025, 10, 5), "7")], "d date, k string")
    assert [tuple(r) for r in d.select(C.fiscal_cohort("d"), C.client_key("k")).collect()] == [("FY2025Q1", "12"), ("FY2025Q1", "0"), ("FY2025Q4", "7")]


def day(n):
    return dt.date(2025, 3, 1) + dt.timedelta(days=n)


@pytest.fixture
def small(spark):
    rows = [
        (1, "a", "t1", "ACQ", "action", "R", "EM", day(0), day(10), 10, "2025-03"),
        (2, "a", "t2", "ACQ", "action", "R", "EM_IM", day(0), day(10), 10, "2025-03"),  # the same day again
        (3, "b", "t1", "ACQ", "control", "R", "XX", day(0), None, None, "2025-03"),  # no end
        (4, "c", "t1", "ACQ", "action", "R", "EM", day(5), day(15), 10, "2025-03"),
    ]
    return spark.createDataFrame(rows, "decision_id long, client_id string, tactic_id string, campaign string, arm string, report_group string, channel string, start_dt date, end_dt date, window_days int, cohort string")


def test_windows_are_inclusive(spark, small):
    events = spark.createDataFrame([("a", "acquisition", day(10)), ("a", "acquisition", day(0)), ("b", "acquisition", day(1)), ("c", "acquisition", day(4)), ("c", "acquisition", day(16))], "client_id string, metric string, success_dt date")
    got = {r["decision_id"]: (r["success"], r["success_dt"]) for r in population.attributed(small, events).collect()}
    assert got == {1: (1, day(0)), 2: (1, day(0)), 3: (0, None), 4: (0, None)}


def test_no_events_and_missing_arm(spark, small):
    none = spark.createDataFrame([], "client_id string, metric string, success_dt date")
    done = population.attributed(small, none)
    assert done.count() == 4 and done.agg(F.sum("success")).first()[0] == 0
    assert effect.lift_by(done.where("arm = 'action'"), "campaign").count() == 0
    row = effect.lift_by(done, "campaign").first()
    assert row["p_value"] == 1.0 and row["relative_lift"] == 0.0
    curve = vintage.curves(done.where("arm = 'action'"), ("campaign", "arm")).orderBy("day").collect()
    assert [r["success_cnt"] for r in curve] == [0] * 11


def test_ties_have_an_order(small):
    assert [(r["decision_id"], r["seq"]) for r in contact.sequenced(small).orderBy("decision_id").collect()] == [(1, 1), (2, 2), (3, 1), (4, 1)]
    t = contact.transitions(small).collect()
    assert len(t) == 1 and t[0]["gap"] == 0
