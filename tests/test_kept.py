"""Kept tables, trees, sketches, guards and push-down: plans that must hold, and results against brute force."""

import os
import random
from collections import Counter, defaultdict
from datetime import date, timedelta

import pytest
from pyspark.sql import functions as F

from liftworks.operators import contact, population, profile, sketch, spend, tree
from liftworks.plans import kept
from liftworks.sources import fixtures as X
from liftworks.sources import readers, scratch, store

DAY = date(2000, 1, 1)
POPULATION = "decision_id long, client_id string, tactic_id string, campaign string, arm string, report_group string, channel string, start_dt date, end_dt date, window_days int, cohort string"


def day(n):
    return DAY + timedelta(days=n)


def decided(rng, n, clients=9, first=0, span=400):
    """Rows of POPULATION; a few have no end."""
    out = []
    for k in range(n):
        start, window = rng.randrange(span), rng.choice([30, 90])
        campaign = rng.choice(["ACQ", "ACT", "USE", "TOK"])
        end = None if rng.random() < 0.05 else day(start + window)
        out.append((first + k, str(rng.randrange(clients)), f"t{start}", campaign, "action", "R", "EM", day(start), end, window, day(start).strftime("%Y-%m")))
    return out


def happened(rng, n, clients=9, span=520):
    return sorted({(str(rng.randrange(clients)), rng.choice(["acquisition", "activation", "usage", "token"]), day(rng.randrange(span))) for _ in range(n)})


GOAL = {"ACQ": "acquisition", "ACT": "activation", "USE": "usage", "TOK": "token"}


def by_hand(rows, events):
    days = defaultdict(list)
    for c, m, d in events:
        days[c, m].append(d)
    return Counter((r[0], min((d for d in days[r[1], GOAL[r[3]]] if r[8] is not None and r[7] <= d <= r[8]), default=None)) for r in rows)


def found(df):
    return Counter(map(tuple, df.select("decision_id", "success_dt").collect()))


def plan_of(df):
    return df._jdf.queryExecution().executedPlan().toString()


# --- by client -------------------------------------------------------------------------------------------------------------------------


def test_nothing_moves_between_tables_kept_by_client(spark):
    rng = random.Random(1)
    rows, events = decided(rng, 300), happened(rng, 300)
    with scratch.temporaries(), scratch.setting(spark, "spark.sql.autoBroadcastJoinThreshold", -1):
        d = store.staged_by_client(spark.createDataFrame(rows, POPULATION), 6)
        e = store.staged_by_client(population.event_days(spark.createDataFrame(events, "client_id string, metric string, success_dt date")), 6)
        t = store.staged_by_client(spark.createDataFrame([(c, x, 5) for c, _, x in events], "client_id string, txn_dt date, amount int").withColumn("amount", F.col("amount").cast("decimal(18,2)")), 6)
        done = population.attributed(d, e)
        assert "Exchange" not in plan_of(done) and found(done) == by_hand(rows, events)
        a = store.staged_by_client(done, 6)
        for df in (contact.sequenced(a), contact.transitions(a), population.first_success(a)):
            assert "Exchange" not in plan_of(df)
        money = spend.pre_post(population.first_deployments(a), t, "campaign")
        moved = [x for x in plan_of(money).splitlines() if "Exchange" in x]
        assert moved and not any("client_id" in x for x in moved)
    assert not [r for r in spark.sql("SHOW TABLES").collect() if r["tableName"].startswith("staged_")]


def test_another_session_opens_the_table(spark, tmp_path):
    rng = random.Random(2)
    df = spark.createDataFrame(decided(rng, 100), POPULATION)
    store.save_by_client(df, "kept_here", str(tmp_path / "t"), 4, ("start_dt",))
    other = spark.newSession()
    other.sql("DROP TABLE IF EXISTS kept_here")
    again = store.open_by_client(other, "kept_there", str(tmp_path / "t"), POPULATION, 4)
    assert Counter(map(tuple, again.collect())) == Counter(map(tuple, df.collect()))
    assert "Exchange" not in plan_of(contact.sequenced(again))
    other.sql("DROP TABLE kept_there")


def test_attribution_moves_each_table_once(spark):
    rng = random.Random(3)
    rows, events = decided(rng, 200), happened(rng, 200)
    with scratch.setting(spark, "spark.sql.autoBroadcastJoinThreshold", -1):
        done = population.attributed(spark.createDataFrame(rows, POPULATION), spark.createDataFrame(events, "client_id string, metric string, success_dt date"))
        assert plan_of(done).count("Exchange ") == 2 and found(done) == by_hand(rows, events)


def test_days_of_events_need_no_move_where_lines_lie_by_client(spark):
    lines = spark.createDataFrame([(str(k % 7), "RAN"[k % 3], day(k % 40), 1.0, k % 2 == 0 or None) for k in range(200)], "client_id string, l_returnflag string, l_shipdate date, l_extendedprice double, listed boolean")
    with scratch.temporaries(), scratch.setting(spark, "spark.sql.autoBroadcastJoinThreshold", -1):
        kept_lines = store.staged_by_client(lines, 6)
        days = population.event_days(X.events_of(kept_lines))
        assert "Exchange" not in plan_of(days) and "Exchange" not in plan_of(X.spend_of(kept_lines))
        want = defaultdict(set)
        for c, f, d, _, listed in lines.collect():
            want[c, d] |= {{"R": "acquisition", "A": "activation", "N": "usage"}[f]} | ({"token"} if f == "N" and listed else set())
        assert {(r["client_id"], r["success_dt"]): set(r["metrics"]) for r in days.collect()} == want


# --- by month --------------------------------------------------------------------------------------------------------------------------


def files(root):
    return {f"{os.path.basename(d)}/{f}" for d, _, names in os.walk(root) for f in names if f.endswith(".parquet")}


def test_increments_equal_one_run(spark, tmp_path):
    rng, root = random.Random(4), str(tmp_path / "kept")
    rows, events = decided(rng, 240), happened(rng, 400)
    rng.shuffle(events)
    rows_in, events_in = [rows[:100], rows[100:100], rows[100:]], [events[:150], events[150:300], events[300:]]
    known = []
    for fresh, news in zip(rows_in, events_in, strict=True):
        known += news
        frame = lambda x: spark.createDataFrame(x, "client_id string, metric string, success_dt date")
        store.advance(root, spark.createDataFrame(fresh, POPULATION), frame(news), frame(known))
    kept_rows = store.open_by_month(spark, root, POPULATION + ", success_dt date, success int")
    assert found(kept_rows) == by_hand(rows, events)
    assert kept_rows.where("success <> CAST(success_dt IS NOT NULL AS int)").count() == 0


def test_only_touched_months_are_written(spark, tmp_path):
    root = str(tmp_path / "kept")
    one = lambda k, client, start: (k, client, "t", "ACQ", "action", "R", "EM", day(start), day(start + 30), 30, day(start).strftime("%Y-%m"))
    rows = [one(1, "1", 0), one(2, "1", 40), one(3, "1", 80), one(4, "2", 100)]
    frame = lambda x: spark.createDataFrame([(c, "acquisition", d) for c, d in x], "client_id string, metric string, success_dt date")
    assert store.advance(root, spark.createDataFrame(rows, POPULATION), frame([("1", day(85))]), frame([("1", day(85))])) == ["2000-01", "2000-02", "2000-03", "2000-04"]
    before = files(root)
    news = [("1", day(41)), ("1", day(86)), ("2", day(10))]  # one meets the second deployment, one is too late to matter, one meets none
    assert store.advance(root, spark.createDataFrame([], POPULATION), frame(news), frame([("1", day(85)), *news])) == ["2000-02"]
    changed = before ^ files(root)
    assert changed and all(x.startswith("cohort=2000-02/") for x in changed)
    assert store.advance(root, spark.createDataFrame([], POPULATION), frame([]), frame([])) == []


def test_only_events_that_a_window_can_hold_are_joined(spark, tmp_path, monkeypatch):
    seen, real = [], population.attributed
    monkeypatch.setattr(population, "attributed", lambda d, e, *a: seen.append({r["success_dt"] for r in e.collect()}) or real(d, e, *a))
    one = lambda k, start: (k, "1", "t", "ACQ", "action", "R", "EM", day(start), day(start + 30), 30, day(start).strftime("%Y-%m"))
    events = spark.createDataFrame([("1", "acquisition", day(n)) for n in range(0, 300, 3)], "client_id string, metric string, success_dt date")
    store.advance(str(tmp_path / "kept"), spark.createDataFrame([one(1, 100), one(2, 110)], POPULATION), events, events)
    store.advance(str(tmp_path / "kept"), spark.createDataFrame([], POPULATION), events, events)
    assert seen == [{day(n) for n in range(102, 141, 3)}, set()]
    assert found(store.open_by_month(spark, str(tmp_path / "kept"), POPULATION + ", success_dt date, success int")) == {(1, day(102)): 1, (2, day(111)): 1}


# --- trees -----------------------------------------------------------------------------------------------------------------------------


def grown(rows, depth):
    """Splits {(node): (feature, cut)} of rows (age, channel, contacts, success), by trying all."""
    def gini(part):
        n, s = len(part), sum(r[3] for r in part)
        return 2 * s * (n - s) / n

    out = {}

    def grow(part, node, level):
        best = None
        for f, name in enumerate(tree.FEATURES):
            for cut in sorted({r[f] for r in part}):
                left = [r for r in part if (r[f] == cut if name == "channel" else r[f] <= cut)]
                right = [r for r in part if not (r[f] == cut if name == "channel" else r[f] <= cut)]
                if left and right and (gain := gini(part) - gini(left) - gini(right)) > 1e-9 and (best is None or gain > best[0] + 1e-9):
                    best = gain, name, cut, left, right
        if best and level < depth:
            out[node] = best[1:3]
            grow(best[3], 2 * node, level + 1)
            grow(best[4], 2 * node + 1, level + 1)

    grow(rows, 1, 0)
    return out


def test_trees_against_trying_all_splits(spark):
    rng, made, want = random.Random(5), [], {}
    for campaign, size in (("A", 400), ("B", 150), ("C", 99)):
        names, rows = ["EM", "IM", "MB"], []
        for client in range(size):
            contacts, age, channel = rng.choice([1, 1, 2, 3]), rng.choice([None, 20, 35, 50, 70]), rng.choice(names)
            success = int(rng.random() < (0.1 + 0.3 * (channel == "IM") + 0.3 * ((age or 0) > 40) + 0.1 * contacts * (campaign == "A")))
            rows.append((age or 0, names.index(channel) + 1, contacts, success))
            for k in range(contacts):
                made.append((client * 10 + k, f"{campaign}{client}", campaign, "action", channel if k == 0 else "XX", age if k == 0 else 99, success if k == 0 else 1 - success, day(k), "t"))
        if size >= 100:
            want[campaign] = grown(rows, tree.DEPTH)
    df = spark.createDataFrame(made, "decision_id long, client_id string, campaign string, arm string, channel string, age int, success int, start_dt date, tactic_id string")
    got = defaultdict(dict)
    for r in tree.splits(df)[0].collect():
        got[r["campaign"]][r["node"]] = (r["feature"], r["cut"])
    assert dict(got) == want and all(len(w) > 3 for w in want.values())
    shares = tree.importance(df).groupBy("campaign").agg(F.round(F.sum("importance"), 4)).collect()
    assert {tuple(r) for r in shares} == {("A", 1.0), ("B", 1.0)}
    assert tree.importance(df.where("campaign = 'C'")).count() == 0


# --- e-mail from two tables --------------------------------------------------------------------------------------------------------------


def test_feedback_is_cut_down_before_the_join(spark):
    at = "2000-01-05 10:00:00"
    master = spark.createDataFrame([("h1", "t1", "0007 "), ("h1", "t1", "0007 "), ("h1", "t9", "0007"), ("h2", "t1", "008"), ("h3", "t2", "9")], "hashed_id string, treatment string, client_no string")
    event = spark.createDataFrame([("h1", "t1", 1, at), ("h1", "t1", 2, at), ("h1", "t9", 4, at), ("h2", "t2", 1, at), ("h3", "t2", 3, at)], "hashed_id string, treatment string, disposition int, at string")
    tactics = spark.createDataFrame([("t1", "RG1"), ("t1", "RG2"), ("t2", "RG1")], "tactic_id string, report_group string")
    rows = profile.feedback_of(master, event, tactics)
    assert {(r["client_id"], r["treatment"], r["sent"], r["opened"], r["clicked"], r["unsubscribed"]) for r in profile.email_flags(rows).collect()} == {("7", "t1", 1, 1, 0, 0), ("9", "t2", 0, 0, 1, 0)}
    with scratch.setting(spark, "spark.sql.autoBroadcastJoinThreshold", -1):
        lines = [x for x in rows._jdf.queryExecution().optimizedPlan().toString().splitlines() if "Join" in x]
    depth = lambda x: len(x) - len(x.lstrip(" :+-"))
    assert "Inner" in lines[0] and len(lines) == 3 and all("LeftSemi" in x and depth(x) > depth(lines[0]) for x in lines[1:])


# --- snapshots ---------------------------------------------------------------------------------------------------------------------------


def test_only_wanted_months_are_read(spark, tmp_path):
    rows = spark.createDataFrame([(str(c), d, "s", c) for c in range(20) for d in (date(2000, 1, 31), date(2000, 2, 29), date(2000, 3, 31))], "client_id string, month_end date, segment string, age int")
    rows.write.partitionBy("month_end").parquet(str(tmp_path / "p"))
    for d in ("2000-03-31", "2001-01-31"):  # what reads these fails
        os.makedirs(tmp_path / f"p/month_end={d}", exist_ok=True)
        (tmp_path / f"p/month_end={d}/part-bad.parquet").write_bytes(b"no parquet at all")
    snapshots = spark.read.schema(rows.schema).parquet(str(tmp_path / "p"))
    d = spark.createDataFrame([(k, str(k), date(2000, 1 + k % 2, 3)) for k in range(30)], "decision_id long, client_id string, start_dt date")
    out = profile.enriched(d, profile.of_months(snapshots, d, "2000-12-31"), "2000-12-31", strict=True)
    assert "dynamicpruning" in plan_of(out)
    assert {(r["decision_id"], r["age"]) for r in out.collect()} == {(k, k if k < 20 else None) for k in range(30)}


def test_only_the_latest_partition_is_read(spark, tmp_path):
    rows = spark.createDataFrame([(str(c), d) for c in range(3) for d in (date(2000, 1, 31), date(2000, 2, 29))], "client_id string, month_end date")
    rows.write.partitionBy("month_end").parquet(str(tmp_path / "p"))
    table = spark.read.schema(rows.schema).parquet(str(tmp_path / "p"))
    plan = plan_of(readers.latest(table, "month_end"))
    assert "PartitionFilters: [isnotnull(month_end" in plan and "month_end#" in plan.split("PartitionFilters")[1] and "2000-02-29" in plan.split("PartitionFilters")[1]
    assert {r["client_id"] for r in readers.latest(table, "month_end").collect()} == {"0", "1", "2"}
    assert readers.latest(table.where("client_id = 'none'"), "month_end").count() == 0


def test_a_doubled_snapshot_is_an_error(spark):
    rows = [("1", date(2000, 1, 31), "s", 5), ("1", date(2000, 1, 31), "s", 6), ("2", date(2000, 1, 31), None, None)]
    snapshots = spark.createDataFrame(rows, "client_id string, month_end date, segment string, age int")
    d = spark.createDataFrame([(1, "1", date(2000, 1, 3)), (2, "2", date(2000, 1, 3)), (3, "3", date(2000, 1, 3))], "decision_id long, client_id string, start_dt date")
    assert profile.enriched(d, snapshots, "2000-12-31").count() == 3
    with pytest.raises(Exception, match="two snapshots of client 1"):
        profile.enriched(d, snapshots, "2000-12-31", strict=True).collect()
    fine = profile.enriched(d, snapshots.where("age IS NULL OR age = 5"), "2000-12-31", strict=True)
    assert {(r["decision_id"], r["age"]) for r in fine.collect()} == {(1, 5), (2, None), (3, None)}


def test_snapshots_made_from_a_small_table_are_not_broadcast(spark):
    month = F.explode(F.sequence(F.lit("2000-01-01").cast("date"), F.lit("2000-12-01").cast("date"), F.expr("interval 1 month")))
    snapshots = spark.range(50).select(F.col("id").cast("string").alias("client_id"), F.col("id").alias("age"), month.alias("m")).select("client_id", F.last_day("m").alias("month_end"), "age")
    d = spark.createDataFrame([(k, str(k), date(2000, 1 + k % 12, 3)) for k in range(60)], "decision_id long, client_id string, start_dt date")
    for strict in (False, True):
        out = profile.enriched(d, snapshots, "2000-12-31", strict).select("decision_id", "age")
        assert "BroadcastHashJoin" not in plan_of(out)
        assert {tuple(r) for r in out.collect()} == {(k, k if k < 50 else None) for k in range(60)}


def customers(spark, path, n):
    spark.range(n).select(F.col("id").alias("c_custkey"), F.lit("s").alias("c_mktsegment"), F.lit(1.0).alias("c_acctbal")).coalesce(1).write.parquet(f"{path}/customer.parquet")
    return str(path)


def test_snapshots_of_many_clients_are_made_by_many_tasks(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(X, "CLIENTS", 100, raising=False)
    rows = X.profiles(spark, customers(spark, tmp_path, 1000))
    per_task = [r["count"] for r in rows.groupBy(F.spark_partition_id()).count().collect()]
    assert len(per_task) > 5 and max(per_task) < 200 * 78 and sum(per_task) == 78_000
    assert {(r["n"], r["clients"]) for r in profile.partition_sizes(rows).collect()} == {(1000, 1000)}


def test_a_large_month_is_written_by_several_tasks(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(X, "CLIENTS", 500, raising=False)
    with scratch.temporaries(), scratch.setting(spark, "spark.sql.adaptive.advisoryPartitionSizeInBytes", "8KB"):
        table = kept.by_month_end(spark, customers(spark, tmp_path, 4000))
        files = Counter(f.split("month_end=")[1].split("/")[0] for f in table.inputFiles())
        assert len(files) == 78 and min(files.values()) > 1
        assert {r["count"] for r in table.groupBy("month_end").count().collect()} == {4000} and table.distinct().count() == 78 * 4000


# --- warehouse ---------------------------------------------------------------------------------------------------------------------------


def test_the_database_filters_and_adds_up(spark):
    sf = "/root/testdata/sf0.001"
    if not os.path.isdir(sf):
        pytest.skip("test tables are not here")
    plan = plan_of(kept.by_warehouse(spark, sf))
    assert "PushedAggregates: [COUNT(*), MAX(O_ORDERKEY)]" in plan.replace("o_orderkey", "O_ORDERKEY").replace('"', "") or "PushedAggregates: [COUNT" in plan
    assert "PushedFilters: [o_custkey IS NOT NULL, o_day IS NOT NULL, o_custkey > 100, o_day >= 9500]" in plan and "PushedGroupByExpressions: [o_year]" in plan


def test_ranges_need_no_bounds(spark):
    url = "jdbc:derby:memory:bounds;create=true"
    for name, rows in (("FULL_T", spark.range(10, 60)), ("NONE_T", spark.range(0))):
        rows.select(F.col("id").cast("int").alias("K")).write.format("jdbc").options(url=url, dbtable=name, driver=kept.DERBY).save()
    full = readers.read_jdbc_whole(spark, url, "FULL_T", "K", 5, driver=kept.DERBY)
    assert full.count() == 50 and max(full.groupBy(F.spark_partition_id()).count().toPandas()["count"]) <= 12
    assert readers.read_jdbc_whole(spark, url, "NONE_T", "K", 5, driver=kept.DERBY).count() == 0


# --- sketches ----------------------------------------------------------------------------------------------------------------------------


def test_sketches_keep_their_error_when_merged(spark):
    n = 200_000
    df = spark.range(n).select(F.concat(F.lit("c"), "id").alias("client_id"), F.when(F.col("id") % 3 == 0, "A").otherwise("B").alias("campaign"), (F.col("id") % 12).cast("string").alias("cohort"))
    df = df.unionByName(df.where("id IS NULL" if "id" in df.columns else "campaign = 'A' AND cohort < '6'").withColumn("campaign", F.lit("B")))
    kept_rows = sketch.client_sketches(df, "campaign", "cohort")
    exact = {r["campaign"]: r["n"] for r in df.groupBy("campaign").agg(F.count_distinct("client_id").alias("n")).collect()}
    for r in sketch.counted(sketch.rolled_up(kept_rows, "campaign")).collect():
        assert abs(r["clients"] / exact[r["campaign"]] - 1) < 0.03
    whole = sketch.counted(sketch.rolled_up(kept_rows)).first()
    assert abs(whole["clients"] / n - 1) < 0.03 and whole["deployments"] == df.count()
    both = df.where("campaign = 'A'").join(df.where("campaign = 'B'").select("client_id").distinct(), "client_id", "left_semi").select("client_id").distinct().count()
    assert abs(sketch.overlap(kept_rows, "campaign", "A", "B").first()["both"] - both) < 0.03 * n


def test_sketches_of_many_clients_count_exactly(spark):
    n = 120_000  # far above what one sketch holds
    df = spark.range(n).select(F.concat(F.lit("c"), "id").alias("client_id"), F.explode(F.array(F.when(F.col("id") % 3 == 0, "A").otherwise("B"), F.when(F.col("id") % 5 == 0, "B"))).alias("campaign"), (F.col("id") % 4).cast("string").alias("cohort")).where("campaign IS NOT NULL")
    kept_rows = sketch.client_sketches(df, "campaign", "cohort")
    want = {r["campaign"]: (r["deployments"], r["clients"]) for r in df.groupBy("campaign").agg(F.count("*").alias("deployments"), F.count_distinct("client_id").alias("clients")).collect()}
    assert {r["campaign"]: (r["deployments"], r["clients"]) for r in sketch.counted(sketch.rolled_up(kept_rows, "campaign")).collect()} == want
    assert sketch.counted(sketch.rolled_up(kept_rows)).first()["clients"] == n
    both = sketch.overlap(kept_rows, "campaign", "A", "B").first()
    assert (both["a_clients"], both["b_clients"], both["both"]) == (want["A"][1], want["B"][1], n // 15)
    none = sketch.overlap(kept_rows, "campaign", "none", "B").first()
    assert (none["a_clients"], none["both"]) == (0, 0)
    with pytest.raises(Exception, match="more parts"):
        sketch.counted(sketch.rolled_up(sketch.client_sketches(df, "campaign", parts=2), "campaign")).collect()


def test_merged_percentiles_keep_their_rank(spark):
    df = spark.range(120_000).select((F.col("id") % 30_000).cast("string").alias("client_id"), F.lit("A").alias("campaign"), (F.col("id") % 30_000 % 7).alias("part"))
    df = df.unionByName(df.where("client_id < '5' AND part > 2"))
    merged = sketch.percentiles(sketch.contact_sketches(df, "campaign", "part"), "campaign").first()
    per = sorted(r["n"] for r in df.groupBy("client_id").agg(F.count("*").alias("n")).collect())
    for share, got in ((0.5, merged["p50"]), (0.9, merged["p90"])):
        assert any(per[min(max(int((share + e) * len(per)), 0), len(per) - 1)] == got for e in (-0.005, 0, 0.005))
    assert merged["clients"] == len(per) and merged["most"] == per[-1]


# --- rules in force ----------------------------------------------------------------------------------------------------------------------


def test_a_stopped_contact_stops_no_other(spark):
    rows = [(k, "1", f"t{k}", "TOK", ch, day(d), None) for k, (ch, d) in enumerate([("EM", 0), ("EM", 20), ("EM", 40), ("IM", 41), ("EM", 75), ("EM", 95), ("XX", 95), ("EM", 131)])]
    rows += [(20, "2", "t", "ACQ", "IM", day(0), day(3)), (21, "2", "t", "SEA", "IM", day(3), None), (22, "2", "t", "SEA", "IM", day(30), None), (23, "2", "t", "USE", "IM", day(30), None)]
    df = spark.createDataFrame(rows, "decision_id long, client_id string, tactic_id string, campaign string, channel string, start_dt date, success_dt date")
    got = {r["decision_id"]: r["rule"] for r in contact.enforced(df).collect()}
    assert got == {0: None, 1: "cooldown", 2: None, 3: None, 4: "cap", 5: None, 6: None, 7: None, 20: None, 21: "cooldown", 22: "goal", 23: None}
    assert contact.enforced(df.limit(0)).count() == 0


def test_feedback_tables_hold_what_the_flat_one_does(spark):
    sf = "/root/testdata/sf0.001"
    if not os.path.isdir(sf):
        pytest.skip("test tables are not here")
    flat = X.deployment_feedback(spark, sf)
    tactics = flat.select(F.col("treatment").alias("tactic_id"))
    two = profile.email_flags(profile.feedback_of(*X.feedback_tables(spark, sf), tactics))
    assert Counter(map(tuple, two.collect())) == Counter(map(tuple, profile.email_flags(flat).collect()))


# --- heavy clients -----------------------------------------------------------------------------------------------------------------------


def test_a_client_of_a_million_events(spark):
    rng = random.Random(6)
    rows = decided(rng, 1000, clients=1, span=3000) + decided(rng, 200, clients=9, first=5000, span=3000)
    made = spark.range(1_000_000).select(F.lit("0").alias("client_id"), F.element_at(F.array(*[F.lit(m) for m in ("acquisition", "activation", "usage", "token")]), (F.col("id") % 4 + 1).cast("int")).alias("metric"), F.date_add(F.lit(DAY), (F.xxhash64("id") % 800 * 2 + 1600).cast("int")).alias("success_dt"))
    few = happened(rng, 500, span=3100)
    events = made.unionByName(spark.createDataFrame(few, made.schema))
    d = spark.createDataFrame(rows, POPULATION)
    out = population.attributed_of_heavy(d, events, heavy=10_000)
    assert out.columns == population.attributed(d, events).columns
    known = [tuple(r) for r in events.distinct().collect()]
    assert found(out) == by_hand(rows, known)


def test_bins_of_heavy_clients_are_even(spark):
    """No (client, metric, bin) holds more than the days of a bin, however many events a day has."""
    with scratch.temporaries():
        made = spark.range(300_000).select((F.col("id") % 1).cast("string").alias("client_id"), F.element_at(F.array(F.lit("acquisition"), F.lit("usage")), (F.col("id") % 2 + 1).cast("int")).alias("metric"), F.date_add(F.lit(DAY), (F.col("id") % 900).cast("int")).alias("success_dt"))
        d = spark.createDataFrame(decided(random.Random(7), 1000, clients=1, span=900), POPULATION)
        plan = plan_of(population.attributed_of_heavy(d, made, heavy=1000))
        assert "_bin" in plan and "Cartesian" not in plan and "NestedLoop" not in plan
        per = made.distinct().groupBy("metric", F.floor(F.datediff("success_dt", F.lit("1970-01-01").cast("date")) / population.BIN)).count().selectExpr("max(count)").first()[0]
        assert per <= population.BIN


def test_a_driver_local_folder_is_refused_on_a_cluster():
    from types import SimpleNamespace as Of

    def session(master, **conf):
        get = lambda key, *default: conf.get(key.rsplit(".", 2)[-2] + "_" + key.rsplit(".", 1)[-1], *default)
        return Of(conf=Of(get=get), sparkContext=Of(master=master, applicationId="app"))

    for master in ("yarn", "spark://host:7077", "local-cluster[3,2,1000]"):
        with pytest.raises(ValueError, match="checkpoint"):
            scratch.shared_dir(session(master, warehouse_dir="file:/tmp/w"))
    assert scratch.shared_dir(session("local[4]", warehouse_dir="file:/tmp/w")) == "file:/tmp/w/_staged/app"
    assert scratch.shared_dir(session("yarn", warehouse_dir="hdfs://n/w")) == "hdfs://n/w/_staged/app"
    assert scratch.shared_dir(session("yarn", warehouse_dir="file:/tmp/w", checkpoint_dir="hdfs://n/c")) == "hdfs://n/c/app"
