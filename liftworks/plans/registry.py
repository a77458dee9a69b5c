"""Registered queries over the test tables, each with the SQL that says the same on the raw tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from liftworks import config as K
from liftworks.functions import columns as C
from liftworks.functions import stats as S
from liftworks.operators import contact, effect, population, profile, quality, scorecard, spend, tree, vintage
from liftworks.sources import fixtures as X
from liftworks.sources import readers

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLE_SQL: dict[str, str] = {}


def plain(df: DataFrame) -> DataFrame:
    """Whole numbers as long, exact decimals as double: the same types as the SQL."""
    return df.select(*[F.col(c).cast("long").alias(c) if t in ("int", "smallint", "tinyint") else F.col(c).cast("double").alias(c) if t.startswith("decimal") else F.col(c) for c, t in df.dtypes])


def add(name: str, query: Query, sql: str | None = None) -> None:
    QUERIES[name] = lambda spark, sf_dir: plain(query(spark, sf_dir))
    if sql:
        ORACLE_SQL[name] = sql


def dep(spark: SparkSession, sf_dir: str) -> DataFrame:
    return population.deployments(X.raw_decisions(spark, sf_dir))


def ev(spark: SparkSession, sf_dir: str) -> DataFrame:
    return X.outcome_events(spark, sf_dir)


def att(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = dep(spark, sf_dir)
    return population.attributed(d, ev(spark, sf_dir))


def on_att(f: Callable[[DataFrame], DataFrame]) -> Query:
    return lambda spark, sf_dir: f(att(spark, sf_dir))


def on_dep(f: Callable[[DataFrame], DataFrame]) -> Query:
    return lambda spark, sf_dir: f(dep(spark, sf_dir))


def with_txns(f: Callable[[DataFrame, DataFrame], DataFrame]) -> Query:
    return lambda spark, sf_dir: f(att(spark, sf_dir), X.transactions(spark, sf_dir))


def rich(spark: SparkSession, sf_dir: str) -> DataFrame:
    return profile.enriched(att(spark, sf_dir), X.profiles(spark, sf_dir), X.PROFILE_CAP)


# --- the tables in SQL -------------------------------------------------------------------------------------------------------

_CODE, _WINDOW, _CHANNEL = K.case("o_orderpriority", X.CODES), K.case("o_orderpriority", X.WINDOWS), K.case("o_orderstatus", X.CHANNELS)
_PRIMARY = K.case("campaign", {c.code: c.metric for c in K.CAMPAIGNS})
_SECONDARY = K.case("campaign", {c.code: c.secondary for c in K.CAMPAIGNS if c.secondary})
_FISCAL = "'FY' || year(start_dt + INTERVAL 2 MONTH) || 'Q' || quarter(start_dt + INTERVAL 2 MONTH)"
BASE = f"""
dep AS (SELECT o_orderkey AS decision_id, CAST(o_custkey AS VARCHAR) AS client_id, strftime(o_orderdate, '%Y%j') || {_CODE} AS tactic_id, {_CODE} AS campaign,
  CASE WHEN o_custkey % 100 >= 90 THEN 'control' ELSE 'action' END AS arm, 'RG' || o_orderstatus AS report_group, CASE WHEN o_custkey % 100 >= 90 THEN 'XX' ELSE {_CHANNEL} END AS channel,
  CAST(o_orderdate AS DATE) AS start_dt, CAST(o_orderdate AS DATE) + ({_WINDOW}) AS end_dt, CAST({_WINDOW} AS BIGINT) AS window_days, strftime(o_orderdate, '%Y-%m') AS cohort FROM orders),
shipped AS (SELECT CAST(o_custkey AS VARCHAR) AS client_id, l_returnflag, l_partkey, CAST(l_shipdate AS DATE) AS dt, CAST(l_extendedprice AS DECIMAL(18,2)) AS amount FROM lineitem JOIN orders ON l_orderkey = o_orderkey),
ev AS (SELECT client_id, {K.case("l_returnflag", {"R": "acquisition", "A": "activation", "N": "usage"})} AS metric, dt AS success_dt FROM shipped UNION
  SELECT client_id, 'token', dt FROM shipped JOIN part ON p_partkey = l_partkey WHERE l_returnflag = 'N' AND p_size <= 10),
txn AS (SELECT client_id, dt AS txn_dt, amount FROM shipped),
att AS (SELECT d.*, f.success_dt, CASE WHEN f.success_dt IS NULL THEN 0 ELSE 1 END AS success FROM dep d LEFT JOIN
  (SELECT d.decision_id, min(e.success_dt) AS success_dt FROM (SELECT *, {_PRIMARY} AS metric FROM dep) d JOIN ev e ON e.client_id = d.client_id AND e.metric = d.metric AND e.success_dt BETWEEN d.start_dt AND d.end_dt GROUP BY 1) f USING (decision_id)),
fst AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY client_id, campaign ORDER BY start_dt, tactic_id, decision_id) AS rn FROM att) WHERE rn = 1),
seq AS (SELECT *, row_number() OVER (PARTITION BY client_id, campaign ORDER BY start_dt, tactic_id, decision_id) AS seq FROM att),
tr AS (SELECT *, start_dt - prev_start AS gap FROM (SELECT *, lag(campaign) OVER w AS prev_campaign, lag(start_dt) OVER w AS prev_start FROM dep WINDOW w AS (PARTITION BY client_id ORDER BY start_dt, tactic_id, decision_id)) WHERE prev_campaign IS NOT NULL),
aft AS (SELECT *, start_dt - first_success AS gap FROM (SELECT *, min(success_dt) OVER (PARTITION BY client_id, campaign) AS first_success FROM att) WHERE start_dt > first_success),
prof AS (SELECT CAST(c_custkey AS VARCHAR) AS client_id, last_day(CAST(m AS DATE)) AS month_end, c_mktsegment AS segment, c_acctbal AS income, CASE WHEN c_custkey % 17 <> 0 THEN 18 + c_custkey * 7 % 60 END AS age, c_custkey % 15 AS tenure
  FROM customer, range(TIMESTAMP '1995-01-01', TIMESTAMP '2001-06-02', INTERVAL 1 MONTH) g(m)),
rich AS (SELECT a.*, p.segment, p.income, p.age, p.tenure FROM att a LEFT JOIN prof p ON p.client_id = a.client_id AND p.month_end = least(last_day(a.start_dt), DATE '{X.PROFILE_CAP}')),
fb AS (SELECT CAST(user_id AS VARCHAR) AS client_id, CAST(date_trunc('week', ts) AS DATE) AS treatment, {K.case("event_type", {"signup": 1, "view": 2, "click": 3, "error": 4})} AS disposition, CAST(ts AS DATE) AS day FROM events)"""
_ARMS = "count(*) FILTER (WHERE arm = 'action') AS n1, coalesce(sum(success) FILTER (WHERE arm = 'action'), 0)::BIGINT AS s1, count(*) FILTER (WHERE arm = 'control') AS n0, coalesce(sum(success) FILTER (WHERE arm = 'control'), 0)::BIGINT AS s0"
_P = S.z_test_p("n1", "s1", "n0", "s0")
_N = ("n1", "s1", "n0", "s0")
_JUDGED = f"""round({S.rate("s1", "n1")}, 6) + 0e0 AS action_rate, round({S.rate("s0", "n0")}, 6) + 0e0 AS control_rate, round({S.lift(*_N)}, 6) + 0e0 AS lift, round({S.relative_lift(*_N)}, 6) + 0e0 AS relative_lift,
round({S.lift(*_N)} - {S.half_width(*_N)}, 6) + 0e0 AS ci_low, round({S.lift(*_N)} + {S.half_width(*_N)}, 6) + 0e0 AS ci_high, round({_P}, 6) + 0e0 AS p_value, {S.significance(_P)} AS significance, round({S.lift(*_N)} / 100e0 * n1, 4) + 0e0 AS incremental"""


def q(select: str, ctes: str = "") -> str:
    return f"WITH {BASE}{', ' + ctes if ctes else ''} {select}"


def judged(rows: str, names: str) -> str:
    return f"SELECT {names}, n1, s1, n0, s0, {_JUDGED} FROM ({rows})"


def by_arms(by: str, source: str = "att", both: bool = True) -> str:
    return f"SELECT {by}, {_ARMS} FROM {source} GROUP BY {by}" + (" HAVING n1 > 0 AND n0 > 0" if both else "")


def r(s: str, n: str) -> str:
    return f"round({S.rate(s, n)}, 6)"


def grouped(by: str, aggs: str, source: str) -> str:
    return f"SELECT {by}, {aggs} FROM {source} GROUP BY {by}"


# --- population, attribution ---------------------------------------------------------------------------------------------------

_DEP = "decision_id, client_id, tactic_id, campaign, arm, report_group, channel, start_dt, end_dt, window_days, cohort"
add("o1_deployments", dep, q(f"SELECT {_DEP} FROM dep"))
add("o2_o5_outcome_events", ev, q("SELECT client_id, metric, success_dt FROM ev"))
add("o11_events_of_clients", lambda s, d: population.of_clients(ev(s, d), dep(s, d).where("campaign = 'TOK'")), q("SELECT * FROM ev WHERE client_id IN (SELECT client_id FROM dep WHERE campaign = 'TOK')"))
add("p5_o10_complete_periods", lambda s, d: population.deployments(X.raw_decisions(s, d), data_end="2001-01-01", without=("1999001ACQ",)).groupBy("campaign").agg(F.count("*").alias("n")), q("SELECT campaign, count(*) AS n FROM dep WHERE start_dt < DATE '2001-01-01' AND tactic_id <> '1999001ACQ' GROUP BY 1"))
add("p8_fiscal_cohort", on_dep(lambda d: d.groupBy(C.fiscal_cohort("start_dt").alias("fiscal")).agg(F.count("*").alias("n"))), q(f"SELECT {_FISCAL} AS fiscal, count(*) AS n FROM dep GROUP BY 1"))
add("p9_fiscal_of_quarter", on_dep(lambda d: d.select(F.concat(F.year("start_dt").cast("string"), F.lit("Q"), F.quarter("start_dt").cast("string")).alias("label")).withColumn("fiscal", C.fiscal_of_quarter("label")).distinct()), q("SELECT DISTINCT label, 'FY' || (y + CASE WHEN qt = 4 THEN 1 ELSE 0 END) || 'Q' || (qt % 4 + 1) AS fiscal FROM (SELECT year(start_dt) AS y, quarter(start_dt) AS qt, year(start_dt) || 'Q' || quarter(start_dt) AS label FROM dep)"))
add("p10_month_end", on_dep(lambda d: d.groupBy(C.month_end("start_dt", X.PROFILE_CAP).alias("month_end")).agg(F.count("*").alias("n"))), q(f"SELECT least(last_day(start_dt), DATE '{X.PROFILE_CAP}') AS month_end, count(*) AS n FROM dep GROUP BY 1"))
add("p19_email_channel", on_dep(lambda d: d.where(C.has_channel("channel", "EM")).groupBy("campaign", "channel").agg(F.count("*").alias("n"))), q("SELECT campaign, channel, count(*) AS n FROM dep WHERE list_contains(string_split(channel, '_'), 'EM') GROUP BY ALL"))
add("a1_first_success", att, q(f"SELECT {_DEP}, success_dt, success::BIGINT AS success FROM att"))
add("a2_metric_flags", lambda s, d: population.metric_flags(dep(s, d), ev(s, d), ["acquisition", "activation", "usage", "token"]).select("decision_id", *[c for m in ("acquisition", "activation", "usage", "token") for c in (m, f"{m}_dt")]),
    q("SELECT d.decision_id, " + ", ".join(f"(count(*) FILTER (WHERE e.metric = '{m}') > 0)::BIGINT AS {m}, min(e.success_dt) FILTER (WHERE e.metric = '{m}') AS {m}_dt" for m in ("acquisition", "activation", "usage", "token")) + " FROM dep d LEFT JOIN ev e ON e.client_id = d.client_id AND e.success_dt BETWEEN d.start_dt AND d.end_dt GROUP BY 1"))
add("p11_secondary_metric", lambda s, d: effect.performance(population.attributed(dep(s, d).where("campaign = 'TOK'"), ev(s, d), population.campaign_metrics(True)), "campaign", "arm"),
    q(f"SELECT campaign, arm, count(*) AS deployments, sum(hit)::BIGINT AS successes, {r('sum(hit)', 'count(*)')} AS rate FROM (SELECT d.decision_id, any_value(campaign) AS campaign, any_value(arm) AS arm, (count(e.client_id) > 0)::INT AS hit FROM dep d LEFT JOIN ev e ON e.client_id = d.client_id AND e.metric = {_SECONDARY} AND e.success_dt BETWEEN d.start_dt AND d.end_dt WHERE campaign = 'TOK' GROUP BY 1) GROUP BY ALL"))
add("a4_first_deployments", on_att(lambda d: population.first_deployments(d).select("client_id", "campaign", "decision_id", "start_dt")), q("SELECT client_id, campaign, decision_id, start_dt FROM fst"))
add("a6_first_success_of_client", on_att(lambda d: population.first_success(d).select("decision_id", "first_success")), q("SELECT decision_id, min(success_dt) OVER (PARTITION BY client_id, campaign) AS first_success FROM att"))
add("s9_latest_snapshot", lambda s, d: readers.latest(X.profiles(s, d), "month_end").withColumn("age", F.coalesce("age", F.lit(-1))), q("SELECT client_id, month_end, segment, income, coalesce(age, -1)::BIGINT AS age, tenure::BIGINT AS tenure FROM prof WHERE month_end = (SELECT max(month_end) FROM prof)"))

# --- aggregates, effect ----------------------------------------------------------------------------------------------------------

_PERF = f"count(*) AS deployments, sum(success)::BIGINT AS successes, {r('sum(success)', 'count(*)')} AS rate"
add("ag02_universe", on_dep(lambda d: d.agg(F.count("*").alias("n"), F.countDistinct("client_id").alias("clients"), F.round(F.count("*") / F.countDistinct("client_id"), 6).alias("per_client"), F.countDistinct("campaign").alias("campaigns"), F.min("start_dt").alias("first_start"), F.max("start_dt").alias("last_start"))),
    q("SELECT count(*) AS n, count(DISTINCT client_id) AS clients, round(count(*)::DOUBLE / count(DISTINCT client_id), 6) AS per_client, count(DISTINCT campaign) AS campaigns, min(start_dt) AS first_start, max(start_dt) AS last_start FROM dep"))
add("ag03_arm_split", on_dep(lambda d: d.groupBy("arm").agg(F.count("*").alias("n"), F.countDistinct("client_id").alias("clients"))), q(grouped("arm", "count(*) AS n, count(DISTINCT client_id) AS clients", "dep")))
add("ag04_volume", on_dep(lambda d: profile.share(d.where("arm = 'action'"), "campaign").drop("total")), q(f"SELECT campaign, n, {r('n', '(sum(n) OVER ())')} AS pct FROM (SELECT campaign, count(*) AS n FROM dep WHERE arm = 'action' GROUP BY 1)"))
add("ag05_by_cohort", on_att(lambda d: effect.performance(d, "campaign", "arm", "cohort")), q(grouped("campaign, arm, cohort", _PERF, "att")))
add("ag01_ag06_by_arm", on_att(lambda d: effect.performance(d, "campaign", "arm")), q(grouped("campaign, arm", _PERF, "att")))
_SETS = [("campaign", "cohort", "report_group"), ("campaign", "cohort"), ("campaign",)]
_ALL = "SELECT campaign, CASE WHEN grouping(cohort) = 1 THEN 'ALL' ELSE cohort END AS cohort, CASE WHEN grouping(report_group) = 1 THEN 'ALL' ELSE report_group END AS report_group, {} FROM {} GROUP BY GROUPING SETS ({})"
add("ag08_rollup", on_att(lambda d: effect.rollup(d, _SETS)), q(judged(_ALL.format(_ARMS, "att", "(campaign, cohort, report_group), (campaign, cohort), (campaign)"), "campaign, cohort, report_group")))
add("ag09_ag12_contact_stats", on_dep(contact.contact_stats), q("SELECT campaign, count(*) AS clients, round(avg(n), 6) AS avg_contacts, quantile_disc(n, 0.5)::DOUBLE AS median, quantile_disc(n, 0.9)::DOUBLE AS p90, max(n) AS most FROM (SELECT campaign, client_id, count(*) AS n FROM dep GROUP BY ALL) GROUP BY 1"))
add("ag11_ag15_dominant_channel", on_dep(lambda d: profile.most_common(d, "channel", "campaign", "report_group")), q("SELECT campaign, report_group, channel, n FROM (SELECT *, row_number() OVER (PARTITION BY campaign, report_group ORDER BY n DESC, channel) AS k FROM (SELECT campaign, report_group, channel, count(*) AS n FROM dep GROUP BY ALL)) WHERE k = 1"))
add("ag14_successful_clients", on_att(lambda d: d.groupBy("client_id").agg(*[F.coalesce(F.max(F.when(F.col("campaign") == c.code, F.col("success"))), F.lit(-1)).alias(c.code.lower()) for c in K.CAMPAIGNS])), q("SELECT client_id, " + ", ".join(f"coalesce(max(success) FILTER (WHERE campaign = '{c.code}'), -1)::BIGINT AS {c.code.lower()}" for c in K.CAMPAIGNS) + " FROM att GROUP BY 1"))
add("ag16_null_counts", lambda s, d: profile.null_counts(X.profiles(s, d)), q("SELECT count(*) AS rows, " + ", ".join(f"count(*) FILTER (WHERE {c} IS NULL) AS null_{c}" for c in ("client_id", "month_end", "segment", "income", "age", "tenure")) + " FROM prof"))
add("ag17_segment_share", lambda s, d: profile.share(X.table(s, d, "customer"), F.col("c_mktsegment").alias("segment")).drop("total"), f"SELECT segment, n, {r('n', '(sum(n) OVER ())')} AS pct FROM (SELECT c_mktsegment AS segment, count(*) AS n FROM customer GROUP BY 1)")
add("ag18_mix_by_month", on_dep(lambda d: profile.share(d, "cohort", "channel", within=("cohort",))), q(f"SELECT cohort, channel, n, (sum(n) OVER (PARTITION BY cohort))::BIGINT AS total, {r('n', '(sum(n) OVER (PARTITION BY cohort))')} AS pct FROM (SELECT cohort, channel, count(*) AS n FROM dep GROUP BY ALL)"))
add("ag19_mix_by_scope", on_dep(lambda d: profile.share(d.withColumn("scope", F.lit("all")).unionByName(d.where("campaign = 'ACQ'").withColumn("scope", F.lit("ACQ"))), "scope", "channel", within=("scope",))),
    q(f"SELECT scope, channel, n, (sum(n) OVER (PARTITION BY scope))::BIGINT AS total, {r('n', '(sum(n) OVER (PARTITION BY scope))')} AS pct FROM (SELECT scope, channel, count(*) AS n FROM (SELECT 'all' AS scope, channel FROM dep UNION ALL SELECT 'ACQ', channel FROM dep WHERE campaign = 'ACQ') GROUP BY ALL)"))
add("j7_ag20_match_rate", lambda s, d: profile.match_rate(rich(s, d)), q("SELECT campaign, count(*) AS deployments, count(segment) AS matched, round(avg(age), 6) AS avg_age, round(avg(tenure), 6) AS avg_tenure FROM rich GROUP BY 1"))
add("ag21_snapshot_sizes", lambda s, d: profile.partition_sizes(X.profiles(s, d)), q("SELECT month_end, count(*) AS n, count(DISTINCT client_id) AS clients FROM prof GROUP BY 1"))
add("t5_sample_ratio", on_dep(lambda d: effect.sample_ratio(d.withColumn("success", F.lit(0)))), q(f"SELECT campaign, n1, n0, round(chi2, 4) AS chi2, round({S.chi2_p('chi2')}, 6) AS p_value, CASE WHEN {S.chi2_p('chi2')} <= 0.05e0 THEN 'ALERT' ELSE 'OK' END AS status FROM (SELECT *, {S.srm_chi2('n1', 'n0', '0.9e0')} AS chi2 FROM ({by_arms('campaign', both=False)}))"))
add("t7_e8_stability", on_att(effect.stability), q("SELECT campaign, cohorts, round(cv, 4) AS cv, CASE WHEN cv < 0.5 THEN 'STABLE' WHEN cv < 1 THEN 'MODERATE' ELSE 'UNSTABLE' END AS stability FROM (SELECT campaign, count(*) AS cohorts, CASE WHEN count(*) = 1 THEN 0 WHEN abs(avg(lift)) < 1e-9 THEN 999 ELSE stddev_samp(lift) / abs(avg(lift)) END AS cv FROM (SELECT campaign, " + S.lift(*_N) + f" AS lift FROM ({by_arms('campaign, cohort')})) GROUP BY 1)"))
add("e1_e10_lift_by_cohort", on_att(lambda d: effect.lift_by(d, "campaign", "cohort")), q(judged(by_arms("campaign, cohort"), "campaign, cohort")))
add("e2_overall_lift", on_att(lambda d: effect.lift_by(d, "campaign")), q(judged(by_arms("campaign"), "campaign")))
_CLIENTS = "(SELECT {0}, arm, client_id, max(success) AS success FROM {1} GROUP BY {0}, arm, client_id)"
_LONG = "(" + " UNION ALL ".join(f"SELECT campaign, arm, client_id, success, '{k}' AS slice_type, {v} AS slice FROM rich" for k, v in (("OVERALL", "'ALL'"), ("COHORT", "cohort"), ("CHANNEL", "channel"), ("REPORT_GROUP", "report_group"))) + ")"
add("e5_slices", on_att(lambda d: effect.slices(d, ["cohort", "channel", "report_group"])), q(judged(by_arms("campaign, slice_type, slice", _CLIENTS.format("campaign, slice_type, slice", _LONG)), "campaign, slice_type, slice")))
_BANDS = "(" + " UNION ALL ".join(f"SELECT campaign, arm, client_id, success, '{k}' AS slice_type, {v} AS slice FROM rich" for k, v in (("OVERALL", "'ALL'"), ("AGE_BAND", S.bucket("age", *K.AGES)), ("TENURE_BAND", S.bucket("tenure", *K.TENURES)), ("INCOME_BAND", S.bucket("income", *K.INCOMES)))) + ")"
add("e6_p17_segments", lambda s, d: effect.slices(profile.segments(rich(s, d)), ["age_band", "tenure_band", "income_band"]), q(judged(by_arms("campaign, slice_type, slice", _CLIENTS.format("campaign, slice_type, slice", _BANDS)), "campaign, slice_type, slice")))
add("e9_efficiency", on_att(scorecard.efficiency), q(f"SELECT campaign, deployments, clients, round(deployments::DOUBLE / clients, 6) AS avg_contacts, CASE WHEN incremental > 0 THEN round(deployments / incremental, 4) ELSE 0 END + 0e0 AS per_incremental FROM (SELECT campaign, count(*) AS deployments, count(DISTINCT client_id) AS clients FROM att WHERE arm = 'action' GROUP BY 1) JOIN ({judged(by_arms('campaign'), 'campaign')}) USING (campaign)"))
_ACT = "SELECT campaign, CASE WHEN grouping(cohort) = 1 THEN 'ALL' ELSE cohort END AS cohort, CASE WHEN grouping(report_group) = 1 THEN 'ALL' ELSE report_group END AS report_group, count(*) AS n1, sum(success)::BIGINT AS s1, count(DISTINCT client_id) AS clients FROM att WHERE arm = 'action' GROUP BY GROUPING SETS ((campaign), (campaign, cohort), (campaign, report_group), (campaign, cohort, report_group))"
_CON = "SELECT campaign, CASE WHEN grouping(cohort) = 1 THEN 'ALL' ELSE cohort END AS cohort, count(*) AS n0, sum(success)::BIGINT AS s0 FROM att WHERE arm = 'control' GROUP BY GROUPING SETS ((campaign), (campaign, cohort))"
_CONS = judged(f"SELECT a.*, coalesce(n0, 0) AS n0, coalesce(s0, 0) AS s0 FROM ({_ACT}) a LEFT JOIN ({_CON}) c USING (campaign, cohort)", "campaign, cohort, report_group, clients")
_VALUE = f"CASE WHEN p_value < 0.05 AND lift > 0 THEN incremental * ({K.case('campaign', {c.code: c.unit_value for c in K.CAMPAIGNS}, '0')})::DOUBLE ELSE 0 END"
_ELIGIBLE = f"CASE WHEN p_value < 0.05 AND lift > 0 THEN {K.case('campaign', {c.code: c.eligibility for c in K.CAMPAIGNS})} ELSE 'not_sig' END"
_CONS = f"SELECT *, round({_VALUE}, 2)::DOUBLE AS value, {_ELIGIBLE} AS eligibility, trunc(lift / 100e0 * clients)::BIGINT AS incremental_clients FROM ({_CONS})"
add("e3_consolidated", on_att(scorecard.consolidated), q(_CONS))
add("e4_consolidated_lite", on_att(lambda d: scorecard.consolidated(d).where("cohort <> 'ALL' AND report_group = 'ALL'").drop("report_group")), q(f"SELECT * EXCLUDE (report_group) FROM ({_CONS}) WHERE cohort <> 'ALL' AND report_group = 'ALL'"))
add("e14_value_totals", on_att(lambda d: scorecard.value_totals(scorecard.consolidated(d))), q(f"SELECT eligibility, count(*) AS campaigns, round(sum(value), 2) AS value FROM ({_CONS}) WHERE cohort = 'ALL' AND report_group = 'ALL' GROUP BY 1"))
TREE = "tcl AS (SELECT campaign, contacts, channel, age, success FROM (SELECT *, count(*) OVER (PARTITION BY client_id, campaign) AS contacts, row_number() OVER (PARTITION BY client_id, campaign ORDER BY start_dt, tactic_id, decision_id) AS rn FROM rich WHERE arm = 'action') WHERE rn = 1)," + tree.sql("tcl")
add("t9_importance", lambda s, d: tree.importance(rich(s, d)), q("SELECT campaign, feature, importance FROM importance", TREE))
add("t9_splits", lambda s, d: tree.splits(rich(s, d))[0].withColumn("gain", F.round("gain", 6)), q("SELECT campaign, level::BIGINT AS level, node::BIGINT AS node, feature, cut::BIGINT AS cut, round(gain, 6) AS gain FROM splits", TREE))

# --- channels, report groups -----------------------------------------------------------------------------------------------------

add("c1_channels", on_dep(lambda d: profile.share(d, "campaign", "arm", "channel", within=("campaign", "arm")).drop("total")), q(f"SELECT campaign, arm, channel, n, {r('n', '(sum(n) OVER (PARTITION BY campaign, arm))')} AS pct FROM (SELECT campaign, arm, channel, count(*) AS n FROM dep GROUP BY ALL)"))
add("c2_channel_balance", on_dep(lambda d: d.where("arm = 'control'").groupBy("campaign").agg(F.count("*").alias("n"), F.count_if(F.col("channel") == "XX").alias("xx")).withColumn("balance", F.expr("CASE WHEN xx > 0.95e0 * n THEN 'XX-only holdout' ELSE 'channel-balanced' END"))), q("SELECT campaign, count(*) AS n, count(*) FILTER (WHERE channel = 'XX') AS xx, CASE WHEN count(*) FILTER (WHERE channel = 'XX') > 0.95 * count(*) THEN 'XX-only holdout' ELSE 'channel-balanced' END AS balance FROM dep WHERE arm = 'control' GROUP BY 1"))
add("c3_rate_by_channel", on_att(lambda d: effect.performance(d.where("arm = 'action'"), "campaign", "channel")), q(grouped("campaign, channel", _PERF, "att WHERE arm = 'action'")))
add("c4_c5_channel_lift", on_att(effect.channel_lift), q(judged(f"SELECT campaign, channel, n1, s1, CASE WHEN holdout THEN x0 ELSE n0 END AS n0, CASE WHEN holdout THEN xs0 ELSE s0 END AS s0, CASE WHEN holdout THEN 'XX holdout' WHEN n0 > 0 THEN 'matched' ELSE 'N/A' END AS baseline FROM (SELECT *, x0 > 0.95 * all0 AS holdout FROM ({by_arms('campaign, channel', both=False)}) JOIN (SELECT campaign, count(*) AS all0, count(*) FILTER (WHERE channel = 'XX') AS x0, sum(success) FILTER (WHERE channel = 'XX')::BIGINT AS xs0 FROM att WHERE arm = 'control' GROUP BY 1) USING (campaign)) WHERE n1 > 0", "campaign, channel, baseline")))
add("c6_multi_channel", on_dep(lambda d: d.groupBy("campaign", "client_id").agg(F.countDistinct("channel").alias("channels")).groupBy("campaign", "channels").agg(F.count("*").alias("clients"))), q("SELECT campaign, channels, count(*) AS clients FROM (SELECT campaign, client_id, count(DISTINCT channel) AS channels FROM dep GROUP BY ALL) GROUP BY ALL"))
add("c7_report_groups", on_dep(lambda d: d.groupBy("campaign", "report_group").agg(F.count("*").alias("n"), F.countDistinct("client_id").alias("clients"))), q(grouped("campaign, report_group", "count(*) AS n, count(DISTINCT client_id) AS clients", "dep")))
add("c8_rate_by_report_group", on_att(lambda d: effect.performance(d, "campaign", "report_group", "arm")), q(grouped("campaign, report_group, arm", _PERF, "att")))
add("c9_report_group_lift", on_att(lambda d: effect.lift_by(d, "campaign", "report_group")), q(judged(by_arms("campaign, report_group"), "campaign, report_group")))
add("c10_clients_by_channel", on_dep(lambda d: d.where("campaign IN ('ACQ', 'TOK')").groupBy("campaign", "channel").agg(F.countDistinct("client_id").alias("clients"))), q(grouped("campaign, channel", "count(DISTINCT client_id) AS clients", "dep WHERE campaign IN ('ACQ', 'TOK')")))

# --- contacts --------------------------------------------------------------------------------------------------------------------

add("w1_e7_frequency", on_att(contact.frequency), q(f"SELECT campaign, bucket, bucket_order, count(*) AS clients, round(avg(n), 6) AS avg_contacts, {r('sum(success)', 'count(*)')} AS rate FROM (SELECT *, {S.bucket('n', *K.CONTACTS)} AS bucket, ({S.bucket_order('n', K.CONTACTS[0])})::BIGINT AS bucket_order FROM (SELECT campaign, client_id, count(*) AS n, max(success) AS success FROM att GROUP BY ALL)) GROUP BY ALL"))
add("w3_sequence", on_att(lambda d: contact.sequenced(d).select("decision_id", "seq")), q("SELECT decision_id, seq FROM seq"))
add("w4_diminishing", on_att(contact.diminishing), q(grouped("campaign, seq", _PERF, "seq WHERE seq <= 10")))
_CUM = f"SELECT campaign, seq, deployments, successes, {r('(sum(successes) OVER w)', '(sum(successes) OVER p)')} AS cum_success_pct, {r('(sum(deployments) OVER w)', '(sum(deployments) OVER p)')} AS cum_deployment_pct FROM (SELECT campaign, seq, count(*) AS deployments, sum(success)::BIGINT AS successes FROM seq GROUP BY ALL) WINDOW w AS (PARTITION BY campaign ORDER BY seq), p AS (PARTITION BY campaign)"
add("w5_cumulative", on_att(contact.cumulative), q(_CUM))
add("w6_cap_coverage", on_att(contact.cap_coverage), q("SELECT campaign, " + ", ".join(f"max(cum_success_pct) FILTER (WHERE seq <= {c}) AS cap_{c}" for c in (3, 5, 7, 10)) + f" FROM ({_CUM}) GROUP BY 1"))
add("w7_p14_gaps", on_dep(contact.gaps), q(f"SELECT {S.bucket('gap', *K.GAPS)} AS bucket, count(*) AS transitions, count(DISTINCT client_id) AS clients, round(avg(gap), 6) AS avg_gap FROM tr GROUP BY 1"))
add("w8_close_contacts", on_dep(contact.close_contacts), q("SELECT count(*) AS transitions, count(DISTINCT client_id) AS clients FROM tr WHERE gap < 25"))
_MATRIX = "SELECT prev_campaign, campaign, count(*) AS transitions, count(DISTINCT client_id) AS clients, round(avg(gap), 6) AS avg_gap FROM tr GROUP BY ALL"
add("w9_transition_matrix", on_dep(contact.matrix), q(_MATRIX))
add("w9_top_transitions", on_dep(contact.matrix_top), q(f"{_MATRIX} ORDER BY transitions DESC, prev_campaign, campaign LIMIT 20"))
_STAGE = {c.code: c.stage for c in K.CAMPAIGNS}
add("w10_transition_classes", on_dep(contact.transition_classes), q(f"SELECT class, transitions, {r('transitions', '(sum(transitions) OVER ())')} AS pct, round(CASE WHEN class = 'self-loop' THEN 0 ELSE {S.rate("transitions", "(sum(transitions) FILTER (WHERE class <> 'self-loop') OVER ())")} END, 6) AS pct_of_moves FROM (SELECT CASE WHEN campaign = prev_campaign THEN 'self-loop' WHEN step = 0 THEN 'lateral' WHEN step > 0 THEN 'forward' ELSE 'backward' END AS class, count(*) AS transitions FROM (SELECT *, {K.case('campaign', _STAGE)} - {K.case('prev_campaign', _STAGE)} AS step FROM tr) GROUP BY 1)"))
add("w11_bucket_mix", on_dep(contact.bucket_mix), q(f"SELECT {S.bucket('n', *K.CONTACTS)} AS bucket, campaign, count(*) AS deployments, count(DISTINCT client_id) AS clients FROM (SELECT *, count(*) OVER (PARTITION BY client_id) AS n FROM dep) GROUP BY ALL"))
add("w13_duplicates", on_dep(lambda d: contact.grain_duplicates(d, ["client_id", "start_dt"]).select("decision_id", "copies")), q("SELECT decision_id, copies FROM (SELECT decision_id, count(*) OVER (PARTITION BY client_id, start_dt) AS copies FROM dep) WHERE copies > 1"))
_WASTE = "count(*) AS wasted, count(DISTINCT client_id) AS clients"
add("x1_waste", on_att(lambda d: contact.waste(d, "campaign")), q(grouped("campaign", _WASTE, "aft")))
add("x2_waste_by_channel", on_att(lambda d: contact.waste(d, "campaign", "channel")), q(grouped("campaign, channel", _WASTE, "aft")))
add("x2_waste_by_channel_cohort", on_att(lambda d: contact.waste(d, "channel", "cohort")), q(grouped("channel, cohort", _WASTE, "aft")))
add("x3_waste_context", on_att(contact.waste_context), q(f"SELECT campaign, successful, coalesce(wasted, 0) AS wasted, coalesce(clients, 0) AS clients, {r('coalesce(clients, 0)', 'successful')} AS pct FROM (SELECT campaign, count(DISTINCT client_id) AS successful FROM att WHERE success = 1 GROUP BY 1) LEFT JOIN ({grouped('campaign', _WASTE, 'aft')}) USING (campaign)"))
add("x4_waste_parts", on_att(contact.waste_by_channel_part), q("SELECT campaign, count(*) FILTER (WHERE list_contains(string_split(channel, '_'), 'EM')) AS em, count(*) FILTER (WHERE list_contains(string_split(channel, '_'), 'IM')) AS im, count(*) AS wasted FROM aft GROUP BY 1"))
add("x5_p15_waste_gaps", on_att(contact.waste_gaps), q(f"SELECT campaign, {S.bucket('gap', *K.AFTER_SUCCESS)} AS bucket, count(*) AS wasted FROM aft GROUP BY ALL"))
_WORST = "SELECT client_id, count(*) AS wasted FROM aft GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 10"
add("x6_worst_clients", on_att(contact.worst_clients), q(_WORST))
add("x6_worst_timeline", on_att(contact.worst_timeline), q(f"SELECT client_id, decision_id, campaign, channel, start_dt, success::BIGINT AS success FROM att WHERE client_id IN (SELECT client_id FROM ({_WORST}))"))
_PAIRS = "prs AS (SELECT a.client_id, a.decision_id AS a_id, b.decision_id AS b_id, abs(b.start_dt - a.start_dt) AS gap, CASE WHEN a.success = 1 AND b.success = 1 THEN 'BOTH' WHEN a.success = 1 THEN 'A_ONLY' WHEN b.success = 1 THEN 'B_ONLY' ELSE 'NEITHER' END AS pattern FROM att a JOIN att b USING (client_id) WHERE a.campaign = 'ACQ' AND b.campaign = 'USE')"
_AB = ("ACQ", "USE")
add("x7_p16_pair_gaps", on_att(lambda d: contact.pair_gaps(d, *_AB)), q(f"SELECT {S.bucket('gap', *K.PAIR_GAPS)} AS bucket, count(*) AS pairs, count(DISTINCT client_id) AS clients FROM prs GROUP BY 1", _PAIRS))
add("x8_j8_pair_patterns", on_att(lambda d: contact.pair_patterns(d, *_AB)), q("SELECT pattern, count(*) AS pairs, count(DISTINCT client_id) AS clients FROM prs GROUP BY 1", _PAIRS))
add("x8_client_patterns", on_att(lambda d: contact.client_patterns(d, *_AB)), q("SELECT CASE WHEN sa = 1 AND sb = 1 THEN 'BOTH' WHEN sa = 1 THEN 'A_ONLY' WHEN sb = 1 THEN 'B_ONLY' ELSE 'NEITHER' END AS pattern, count(*) AS clients FROM (SELECT client_id, max(success) FILTER (WHERE campaign = 'ACQ') AS sa, max(success) FILTER (WHERE campaign = 'USE') AS sb FROM att GROUP BY 1) WHERE sa IS NOT NULL AND sb IS NOT NULL GROUP BY 1"))
add("x9_overlap", on_dep(lambda d: contact.overlap(d, *_AB)), q(f"SELECT a_clients, b_clients, both_ AS \"both\", {r('both_', 'a_clients')} AS pct_of_a, {r('both_', 'b_clients')} AS pct_of_b FROM (SELECT count(*) FILTER (WHERE x) AS a_clients, count(*) FILTER (WHERE y) AS b_clients, count(*) FILTER (WHERE x AND y) AS both_ FROM (SELECT bool_or(campaign = 'ACQ') AS x, bool_or(campaign = 'USE') AS y FROM dep GROUP BY client_id))"))
add("x10_j9_window_overlap", on_att(lambda d: contact.window_overlap(population.first_deployments(d), *_AB)), q(f"SELECT {S.bucket('gap', *K.WINDOW_GAPS)} AS bucket, CASE WHEN a0 < b0 THEN 'A' WHEN a0 > b0 THEN 'B' ELSE 'SAME' END AS first, count(*) AS clients FROM (SELECT a.start_dt AS a0, b.start_dt AS b0, greatest(b.start_dt - a.end_dt, a.start_dt - b.end_dt) AS gap FROM fst a JOIN fst b USING (client_id) WHERE a.campaign = 'ACQ' AND b.campaign = 'USE') GROUP BY ALL"))
add("x11_j2_j3_split_by_overlap", on_att(lambda d: contact.split_by_overlap(d, *_AB)), q(f"SELECT CASE WHEN client_id IN (SELECT client_id FROM dep WHERE campaign = 'USE') THEN 'overlap' ELSE 'only' END AS scope, arm, count(*) AS deployments, {r('sum(success)', 'count(*)')} AS rate FROM att WHERE campaign = 'ACQ' GROUP BY ALL"))
add("x12_closest_pairs", on_att(lambda d: contact.closest_pairs(d, *_AB)), q("SELECT client_id, a_id, b_id, gap FROM prs WHERE pattern = 'BOTH' ORDER BY gap, client_id, a_id, b_id LIMIT 10", _PAIRS))
add("x13_containment", on_dep(lambda d: contact.containment(d, "report_group")), q("SELECT a.g AS group_a, b.g AS group_b, any_value(n) AS clients, count(*) AS shared FROM ids a JOIN ids b ON a.client_id = b.client_id AND a.g <> b.g JOIN (SELECT g, count(*) AS n FROM ids GROUP BY 1) s ON s.g = a.g GROUP BY ALL", "ids AS (SELECT DISTINCT report_group AS g, client_id FROM dep)"))
add("x14_shared_tactics", on_dep(contact.shared_tactics), q("SELECT a.g AS group_a, b.g AS group_b, count(*) AS tactics FROM ids a JOIN ids b ON a.tactic_id = b.tactic_id AND a.g < b.g GROUP BY ALL", "ids AS (SELECT DISTINCT report_group AS g, tactic_id FROM dep)"))
_CAPPED = "capped AS (SELECT *, CASE WHEN channel = 'EM_IM' THEN 60 WHEN channel = 'EM' THEN 30 ELSE 14 END AS cool, CASE WHEN channel = 'EM_IM' THEN 1 WHEN channel = 'EM' THEN 2 ELSE 3 END AS most, count(*) OVER (PARTITION BY client_id, channel ORDER BY start_dt RANGE BETWEEN INTERVAL 89 DAYS PRECEDING AND CURRENT ROW) AS n, start_dt - lag(start_dt) OVER (PARTITION BY client_id, channel ORDER BY start_dt, decision_id) AS since FROM dep WHERE channel <> 'XX'), brc AS (SELECT decision_id, campaign, channel, (n > most)::BIGINT AS over_cap, coalesce(since < cool, false)::BIGINT AS in_cooldown FROM capped WHERE n > most OR since < cool), sup AS (SELECT * FROM (SELECT *, min(success_dt) OVER (PARTITION BY client_id, goal) AS reached FROM (SELECT *, " + _PRIMARY + " AS goal FROM att)) WHERE start_dt > reached)"
add("r6_cap_breaches", on_att(contact.cap_breaches), q("SELECT decision_id, campaign, channel, over_cap, in_cooldown FROM brc", _CAPPED))
add("r7_suppressed", on_att(contact.suppressed), q("SELECT decision_id, client_id, campaign, goal, reached FROM sup", _CAPPED))
add("r8_avoided", on_att(contact.avoided), q("SELECT 'cap_and_cooldown' AS rule, count(*) AS avoided FROM brc UNION ALL SELECT 'after_success', count(*) FROM aft UNION ALL SELECT 'over_5_contacts', count(*) FROM seq WHERE seq > 5 UNION ALL SELECT 'goal_reached', count(*) FROM sup", _CAPPED))

# --- curves ----------------------------------------------------------------------------------------------------------------------


def _curve(by: str, source: str = "att", days: str | None = None, unit: str = "deployment") -> str:
    source = source if unit == "deployment" else f"(SELECT {by}, client_id, start_dt, min(success_dt) AS success_dt, max(window_days) AS window_days FROM {source} GROUP BY ALL)"
    n = "count(*)" if unit == "deployment" else "count(DISTINCT client_id)"
    eq = " AND ".join(f"h.{c.strip()} = g.{c.strip()}" for c in by.split(","))
    own = ", ".join(f"g.{c.strip()}" for c in by.split(","))
    return f"SELECT {by}, day, window_days, client_cnt, success_cnt, {r('success_cnt', 'client_cnt')} AS rate FROM (SELECT {own}, g.day, g.window_days, g.client_cnt, (sum(coalesce(h.n, 0)) OVER (PARTITION BY {own} ORDER BY g.day))::BIGINT AS success_cnt FROM (SELECT *, unnest(range({days or 'window_days'} + 1)) AS day FROM (SELECT {by}, {n} AS client_cnt, quantile_disc(window_days, 0.5) AS window_days FROM {source} GROUP BY {by})) g LEFT JOIN (SELECT {by}, success_dt - start_dt AS day, count(*) AS n FROM {source} WHERE success_dt IS NOT NULL GROUP BY ALL) h ON {eq} AND h.day = g.day)"


_BY = "campaign, cohort, arm, report_group"
add("v1_curves", on_att(vintage.curves), q(_curve(_BY)))
_FLAGS = "flg AS (" + " UNION ALL ".join(f"SELECT d.campaign, d.cohort, d.arm, d.client_id, d.decision_id, d.start_dt, d.window_days, '{m}' AS metric, min(e.success_dt) AS success_dt FROM dep d LEFT JOIN ev e ON e.client_id = d.client_id AND e.metric = '{m}' AND e.success_dt BETWEEN d.start_dt AND d.end_dt GROUP BY ALL" for m in ("usage", "token")) + ")"
add("v3_metric_curves", lambda s, d: vintage.metric_curves(population.metric_flags(dep(s, d), ev(s, d), ["usage", "token"]), ["usage", "token"]), q(_curve("campaign, cohort, arm, metric", "flg"), _FLAGS))
_FQ = f"fq AS (SELECT *, {_FISCAL} AS fiscal FROM att)"
add("v2_fiscal_curves", on_att(vintage.fiscal_curves), q(_curve("campaign, fiscal, arm", "fq"), _FQ))
add("v4_client_curves", on_att(lambda d: vintage.curves(d, ("campaign", "cohort", "arm"), unit="client")), q(_curve("campaign, cohort, arm", unit="client")))
_CA = _curve("campaign, arm")
add("v5_ramp", on_att(lambda d: vintage.ramp(vintage.curves(d, ("campaign", "arm")))), q(f"SELECT campaign, arm, min(day) FILTER (WHERE rate >= 0.5 * top) AS day_50, min(day) FILTER (WHERE rate >= 0.9 * top) AS day_90 FROM (SELECT *, max(rate) OVER (PARTITION BY campaign, arm) AS top FROM ({_CA})) WHERE top > 0 GROUP BY ALL"))
add("v5_ramp_by_cohort", on_att(lambda d: vintage.ramp(vintage.curves(d, ("campaign", "cohort", "arm")), by=("campaign", "cohort", "arm"))), q(f"SELECT campaign, cohort, arm, min(day) FILTER (WHERE rate >= 0.5 * top) AS day_50, min(day) FILTER (WHERE rate >= 0.9 * top) AS day_90 FROM (SELECT *, max(rate) OVER (PARTITION BY campaign, cohort, arm) AS top FROM ({_curve('campaign, cohort, arm')})) WHERE top > 0 GROUP BY ALL"))
add("v6_v7_fixed_grid", on_att(lambda d: vintage.curves(d.where("campaign = 'ACQ'"), ("campaign", "cohort", "arm"), days=30, unit="client")), q(_curve("campaign, cohort, arm", "acq", "30", "client"), "acq AS (SELECT * FROM att WHERE campaign = 'ACQ')"))
_FQ2 = "'FY' || year(CAST(cohort || '-01' AS DATE) + INTERVAL 2 MONTH) || 'Q' || quarter(CAST(cohort || '-01' AS DATE) + INTERVAL 2 MONTH)"
add("r1_to_fiscal", on_att(lambda d: vintage.to_fiscal(vintage.curves(d, ("campaign", "cohort", "arm")))), q(f"SELECT campaign, {_FQ2} AS fiscal, arm, day, sum(client_cnt)::BIGINT AS client_cnt, sum(success_cnt)::BIGINT AS success_cnt, {r('sum(success_cnt)', 'sum(client_cnt)')} AS rate FROM ({_curve('campaign, cohort, arm')}) GROUP BY ALL"))
add("r2_r3_rates_table", on_att(lambda d: vintage.rates_table(vintage.curves(d), 30)), q(f"SELECT campaign, arm, CASE WHEN grouping(report_group) = 1 THEN 'ALL' ELSE report_group END AS report_group, sum(client_cnt)::BIGINT AS client_cnt, sum(success_cnt)::BIGINT AS success_cnt, {r('sum(success_cnt)', 'sum(client_cnt)')} AS rate FROM ({_curve(_BY)}) WHERE day = 30 GROUP BY GROUPING SETS ((campaign, arm, report_group), (campaign, arm))"))
add("r5_latest_lifts", on_att(lambda d: vintage.latest_lifts(vintage.curves(d, ("campaign", "cohort", "arm")))), q(f"SELECT *, round(action_rate - control_rate, 5) + 0e0 AS lift FROM (SELECT campaign, cohort, max(rate) FILTER (WHERE arm = 'action') AS action_rate, max(rate) FILTER (WHERE arm = 'control') AS control_rate, dr AS rank FROM (SELECT * FROM (SELECT *, dense_rank() OVER (PARTITION BY campaign ORDER BY cohort DESC) AS dr FROM ({_curve('campaign, cohort, arm')})) WHERE dr <= 3) GROUP BY campaign, cohort, dr) WHERE rank <= 3"))

# --- spend -----------------------------------------------------------------------------------------------------------------------


def _prepost(by: str, source: str = "fst", anchor: str = "start_dt", pre: str = "window_days", to: str = "end_dt") -> str:
    return f"SELECT {by}, count(*) AS clients, coalesce(sum(pre_spend), 0)::DECIMAL(38,2)::DOUBLE AS pre_spend, coalesce(sum(post_spend), 0)::DECIMAL(38,2)::DOUBLE AS post_spend, coalesce(sum(pre_txns), 0)::BIGINT AS pre_txns, coalesce(sum(post_txns), 0)::BIGINT AS post_txns FROM (SELECT decision_id, {', '.join(f'any_value({c}) AS {c}' for c in by.split(', '))}, sum(amount) FILTER (WHERE txn_dt < {anchor}) AS pre_spend, sum(amount) FILTER (WHERE txn_dt >= {anchor}) AS post_spend, count(*) FILTER (WHERE txn_dt < {anchor}) AS pre_txns, count(*) FILTER (WHERE txn_dt >= {anchor}) AS post_txns FROM (SELECT * FROM {source} WHERE {anchor} IS NOT NULL) d LEFT JOIN txn t ON t.client_id = d.client_id AND txn_dt >= {anchor} - ({pre})::INT AND txn_dt <= {to} GROUP BY decision_id) GROUP BY {by}"


_PC = "pre_spend / clients AS avg_pre, post_spend / clients AS avg_post, (post_spend::DECIMAL(38,2) - pre_spend::DECIMAL(38,2))::DOUBLE / clients AS change"
add("d1_j5_pre_post", with_txns(lambda d, t: spend.per_client(spend.pre_post(population.first_deployments(d), t, "campaign", "cohort", "arm"))), q(f"SELECT *, {_PC} FROM ({_prepost('campaign, cohort, arm')})"))
add("d2_pre_post_overall", with_txns(lambda d, t: spend.per_client(spend.pre_post(population.first_deployments(d), t, "campaign", "arm"))), q(f"SELECT *, {_PC} FROM ({_prepost('campaign, arm')})"))


def _did(rows: str, by: str = "campaign") -> str:
    m = lambda arm, c: f"coalesce(max({c}::DOUBLE / clients) FILTER (WHERE arm = '{arm}'), 0)"
    d = lambda k: f"round(({m('action', 'post_' + k)} - {m('action', 'pre_' + k)}) - ({m('control', 'post_' + k)} - {m('control', 'pre_' + k)}), 4) + 0e0 AS did_{k}"
    return f"SELECT {by}, {d('spend')}, {d('txns')} FROM ({rows}) GROUP BY {by}"


add("d3_ag13_did", with_txns(lambda d, t: spend.did(population.first_deployments(d), t, "campaign")), q(_did(_prepost("campaign, arm"))))
_AFTER = "SELECT {0}, count(*) AS successes, count(spend) AS with_spend, coalesce(sum(spend), 0)::DECIMAL(38,2)::DOUBLE AS spend, coalesce(sum(txns), 0)::BIGINT AS txns, coalesce(sum(spend), 0)::DOUBLE / count(*) AS avg_spend FROM (SELECT decision_id, any_value(campaign) AS campaign, any_value(cohort) AS cohort, any_value(arm) AS arm, sum(amount) AS spend, count(amount) AS txns FROM (SELECT * FROM att WHERE success = 1) d LEFT JOIN txn t ON t.client_id = d.client_id AND txn_dt BETWEEN success_dt AND end_dt GROUP BY decision_id) GROUP BY {0}"
add("d4_after_success", with_txns(lambda d, t: spend.after_success(d, t, "campaign", "arm")), q(_AFTER.format("campaign, arm")))
add("d7_d8_after_success_by_cohort", with_txns(lambda d, t: spend.after_success(d, t, "campaign", "cohort")), q(_AFTER.format("campaign, cohort")))
_VEL = "SELECT campaign, arm, day, successes, cum_spend, cum_spend::DOUBLE / successes AS per_success FROM (SELECT g.campaign, g.arm, g.day, successes, (sum(coalesce(spend, 0)) OVER (PARTITION BY g.campaign, g.arm ORDER BY g.day))::DECIMAL(38,2)::DOUBLE AS cum_spend FROM (SELECT *, unnest(range(91)) AS day FROM (SELECT campaign, arm, count(*) AS successes FROM att WHERE success = 1 GROUP BY ALL)) g LEFT JOIN (SELECT campaign, arm, txn_dt - success_dt AS day, sum(amount) AS spend FROM att d JOIN txn t ON t.client_id = d.client_id AND txn_dt BETWEEN success_dt AND success_dt + 90 GROUP BY ALL) s ON s.campaign = g.campaign AND s.arm = g.arm AND s.day = g.day)"
add("d5_velocity", with_txns(lambda d, t: spend.velocity(d, t, "campaign", "arm")), q(_VEL))
add("d6_milestones", with_txns(lambda d, t: spend.milestones(spend.velocity(d, t, "campaign", "arm"))), q(f"SELECT * FROM ({_VEL}) WHERE day IN (7, 14, 30, 60, 90)"))
add("d9_success_anchor", with_txns(lambda d, t: spend.pre_post(d, t, "campaign", "arm", anchor="success_dt")), q(_prepost("campaign, arm", "att", "success_dt")))
add("d10_by_flag", with_txns(lambda d, t: spend.by_flag(d, t, "success", "campaign")), q("SELECT campaign, success::BIGINT AS success, count(*) AS deployments, count(spend) AS users, coalesce(sum(spend), 0)::DECIMAL(38,2)::DOUBLE AS spend FROM (SELECT decision_id, any_value(campaign) AS campaign, any_value(success) AS success, sum(amount) AS spend FROM att d LEFT JOIN txn t ON t.client_id = d.client_id AND txn_dt BETWEEN start_dt AND end_dt GROUP BY decision_id) GROUP BY ALL"))
add("d11_fixed_pre", with_txns(lambda d, t: spend.pre_post(d.where("campaign = 'USE'"), t, "campaign", "arm", pre_days=30)), q(_prepost("campaign, arm", "att", pre="30") + " HAVING campaign = 'USE'"))
add("d12_w12_last_cohorts", with_txns(lambda d, t: spend.last_cohorts(spend.pre_post(population.first_deployments(d), t, "campaign", "cohort", "arm"), 6, "campaign", "arm")), q(f"SELECT *, {_PC} FROM (SELECT campaign, arm, sum(clients)::BIGINT AS clients, sum(pre_txns)::BIGINT AS pre_txns, sum(post_txns)::BIGINT AS post_txns, sum(pre_spend)::DECIMAL(38,2)::DOUBLE AS pre_spend, sum(post_spend)::DECIMAL(38,2)::DOUBLE AS post_spend FROM (SELECT *, dense_rank() OVER (PARTITION BY campaign, arm ORDER BY cohort DESC) AS k FROM ({_prepost('campaign, cohort, arm')})) WHERE k <= 6 GROUP BY ALL)"))
add("d13_fixed_horizon", with_txns(lambda d, t: spend.pre_post(d, t, "campaign", anchor="success_dt", pre_days=90, post_days=90)), q(_prepost("campaign", "att", "success_dt", "90", "success_dt + 90")))

# --- e-mail, other sources, quality ----------------------------------------------------------------------------------------------

_EM = "em AS (SELECT client_id, treatment, " + ", ".join(f"max((disposition = {k})::INT)::BIGINT AS {n}, min(day) FILTER (WHERE disposition = {k}) AS {n}_dt" for k, n in ((1, "sent"), (2, "opened"), (3, "clicked"), (4, "unsubscribed"))) + " FROM fb WHERE disposition IS NOT NULL GROUP BY ALL)"
add("s7_email_flags", lambda s, d: profile.email_flags(X.email_feedback(s, d)), q("SELECT * FROM em", _EM))
add("ag07_j4_email_funnel", lambda s, d: profile.email_funnel(X.email_feedback(s, d).select("client_id", "treatment").distinct(), profile.email_flags(X.email_feedback(s, d))),
    q("SELECT CASE WHEN grouping(treatment) = 1 THEN 'ALL' ELSE treatment::VARCHAR END AS treatment, count(*) AS population, " + ", ".join(f"coalesce(sum({c}), 0)::BIGINT AS {c}" for c in ("sent", "opened", "clicked", "unsubscribed")) + ", " + ", ".join(f"{r(f'coalesce(sum({c}), 0)', 'coalesce(sum(sent), 0)')} AS {c}_rate" for c in ("opened", "clicked", "unsubscribed")) + " FROM (SELECT DISTINCT client_id, treatment FROM fb) LEFT JOIN em USING (client_id, treatment) GROUP BY GROUPING SETS ((treatment), ())", _EM))
add("o9_channel_events", lambda s, d: X.table(s, d, "events").where("event_type = 'purchase' AND value > 0").select(F.col("user_id").cast("string").alias("client_id"), F.to_date("ts").alias("success_dt")).distinct(), "SELECT DISTINCT CAST(user_id AS VARCHAR) AS client_id, CAST(ts AS DATE) AS success_dt FROM events WHERE event_type = 'purchase' AND value > 0")
_OF = {"campaigns_present": "5 campaigns", "events_overlap": "' || count(*) || ' metrics", "flag_has_date": "' || count(*) || ' attributed", "inside_window": "' || count(*) || ' attributed"}
_CHECK = "SELECT '{0}' AS check_name, CASE WHEN {1} = 0 THEN 'PASS' ELSE 'FAIL' END AS status, ({1})::BIGINT AS n_bad, ({1})::BIGINT || ' of {3}' AS detail FROM {2}"
_Q = [("campaigns_present", "5 - count(DISTINCT campaign)", "dep"), ("null_end", "count(*) FILTER (WHERE end_dt IS NULL)", "dep"), ("unique_grain", "count(*) - count(DISTINCT decision_id)", "dep"), ("rows_kept", "count(*) - (SELECT count(*) FROM dep)", "att"), ("flag_has_date", "count(*) FILTER (WHERE (success = 1) <> (success_dt IS NOT NULL))", "att"), ("inside_window", "count(*) FILTER (WHERE success_dt < start_dt OR success_dt > end_dt)", "att"), ("events_overlap", "count(*) FILTER (WHERE hi < (SELECT min(start_dt) FROM dep) OR lo > (SELECT max(start_dt) FROM dep))", "(SELECT metric, min(success_dt) AS lo, max(success_dt) AS hi FROM ev GROUP BY 1)")]
_REPORT = " UNION ALL ".join(_CHECK.format(n, e, s, _OF.get(n, "' || (SELECT count(*) FROM dep) || ' deployments")) for n, e, s in _Q) + "".join(f" UNION ALL SELECT '{n}', 'INFO', {e}, {e} || ' of ' || count(*) || ' {w}' FROM {s}" for n, e, w, s in (("on_boundary", "count(*) FILTER (WHERE success_dt = start_dt OR success_dt = end_dt)", "attributed", "att"), ("blank_channel", "count(*) FILTER (WHERE coalesce(channel, '') = '')", "deployments", "dep")))
add("q1_q8_quality_report", lambda s, d: quality.report(dep(s, d), att(s, d), ev(s, d)), q(_REPORT))
add("q14_quality_summary", lambda s, d: quality.summary(quality.report(dep(s, d), att(s, d), ev(s, d))), q(f"SELECT status, count(*) AS checks FROM ({_REPORT}) GROUP BY 1"))
add("q10_q12_rederived", lambda s, d: quality.rederived(att(s, d), ev(s, d), population.campaign_metrics()), q(f"SELECT campaign, count(*) AS checked, count(*) FILTER (WHERE success_dt IS DISTINCT FROM (SELECT min(e.success_dt) FROM ev e WHERE e.client_id = m.client_id AND e.metric = m.metric AND e.success_dt >= m.start_dt AND e.success_dt <= m.end_dt)) AS mismatches FROM (SELECT *, {_PRIMARY} AS metric FROM att) m GROUP BY 1"))
add("q9_sample", on_att(quality.sample), q("SELECT campaign, arm, success::BIGINT AS success, decision_id FROM (SELECT *, row_number() OVER (PARTITION BY campaign, arm, success ORDER BY md5(decision_id::VARCHAR)) AS k FROM att) WHERE k <= 3"))
add("q11_keys_agree", lambda s, d: quality.keys_agree(dep(s, d), X.transactions(s, d)), q("SELECT count(*) FILTER (WHERE x AND y) AS \"both\", count(*) FILTER (WHERE x AND y IS NULL) AS only_a, count(*) FILTER (WHERE x IS NULL) AS only_b FROM (SELECT DISTINCT client_id, true AS x FROM dep) FULL JOIN (SELECT DISTINCT client_id, true AS y FROM txn) USING (client_id)"))
add("e12_curve_export", with_txns(scorecard.exports), q(f"SELECT campaign, cohort, arm, 'vintage' AS curve_type, day, rate AS value, client_cnt AS n FROM ({_curve('campaign, cohort, arm')}) UNION ALL SELECT campaign, 'ALL', arm, 'velocity', day, per_success, successes FROM ({_VEL})"))

from liftworks.plans import kept, reports  # noqa: E402, F401  the further queries register themselves here
