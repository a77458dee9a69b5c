"""Registered queries of source rules, full reports and further checks, each with SQL on the raw tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from liftworks import config as K
from liftworks.functions import stats as S
from liftworks.operators import contact, effect, population, profile, quality, scorecard, spend, tree, vintage
from liftworks.plans import registry as R
from liftworks.plans.registry import ORACLE_SQL as O
from liftworks.plans.registry import add, att, dep, ev, on_att, on_dep, q, r, with_txns
from liftworks.sources import fixtures as X
from liftworks.sources import rules
from liftworks.sources.scratch import staged, temporaries

# --- source rules ------------------------------------------------------------------------------------------------------------------

_LINES = "SELECT DISTINCT CAST(o_custkey AS VARCHAR) AS client_id, CAST(l_shipdate AS DATE) AS success_dt FROM lineitem JOIN orders ON l_orderkey = o_orderkey"
_PAIRS = "((l_returnflag IN ('R', 'N') AND l_linestatus = 'O') OR (l_returnflag = 'A' AND l_linestatus = 'F'))"
add("s4_o4_purchases", lambda s, d: rules.purchases(X.purchase_log(s, d)), f"{_LINES} WHERE l_linenumber % 2 = 1 AND l_quantity > 5 AND {_PAIRS}")
add("o7_purchases_by_type", lambda s, d: rules.purchases(X.purchase_log(s, d), types=(10, 13), service=None), f"{_LINES} WHERE l_quantity > 5 AND l_returnflag IN ('R', 'N')")
_CARD = "o_orderstatus IN ('F', 'O') AND o_orderkey % 3 = 1 AND o_orderkey % 11 <> 0"
add("s5_cards", lambda s, d: rules.cards(X.card_table(s, d)).groupBy("status").agg(F.count("*").alias("n"), F.min("issued").alias("first_issued")), f"SELECT CASE o_orderstatus WHEN 'F' THEN '06' ELSE '08' END AS status, count(*) AS n, min(CAST(o_orderdate AS DATE)) AS first_issued FROM orders WHERE {_CARD} GROUP BY 1")
add("o2_o3_card_events", lambda s, d: rules.card_events(X.card_table(s, d)), f"SELECT DISTINCT CAST(o_custkey AS VARCHAR) AS client_id, m AS metric, CASE m WHEN 'acquisition' THEN CAST(o_orderdate AS DATE) ELSE CAST(o_orderdate AS DATE) + 5 END AS success_dt FROM orders, (VALUES ('acquisition'), ('activation')) v(m) WHERE {_CARD}")
_LOG = f"{_LINES} JOIN part ON p_partkey = l_partkey WHERE l_quantity <= 40 AND l_returnflag <> 'A'"
_BOTH = "o_orderkey % 5 <> 0 AND l_suppkey % 3 = 1 AND l_linenumber >= 2"
_FLOOR = "1998-01-01"
add("s6_o5_wallet_strict", lambda s, d: rules.wallet_events(X.wallet_log(s, d), X.token_list(s, d), "strict", _FLOOR), f"{_LOG} AND {_BOTH} AND p_size <= 20 AND l_linestatus = 'O' AND l_quantity > 3 AND l_shipdate >= DATE '{_FLOOR}'")
add("o5_wallet_broad", lambda s, d: rules.wallet_events(X.wallet_log(s, d), X.token_list(s, d), "broad"), f"{_LOG} AND {_BOTH} AND p_size <= 20")
add("o8_wallet_warehouse", lambda s, d: rules.wallet_events(X.wallet_log(s, d), X.token_list(s, d), "warehouse", _FLOOR), f"{_LOG} AND l_suppkey % 3 <= 1 AND p_size <= 20 AND l_quantity > 3 AND l_shipdate >= DATE '{_FLOOR}'")
_KINDS = {"by_merchant": "p_size <= 20 AND l_linestatus = 'O' AND l_quantity > 3", "by_token": "p_size <= 20", "any_token": "true"}
add("o6_wallet_flags", lambda s, d: rules.wallet_flags(dep(s, d), X.wallet_log(s, d), X.token_list(s, d)),
    q("SELECT decision_id, " + ", ".join(f"(min(dt) FILTER (WHERE {c}) IS NOT NULL)::BIGINT AS {n}, min(dt) FILTER (WHERE {c}) AS {n}_dt" for n, c in _KINDS.items()) + " FROM dep LEFT JOIN log ON log.client_id = dep.client_id AND dt BETWEEN start_dt - 30 AND end_dt GROUP BY 1",
      f"log AS (SELECT CAST(o_custkey AS VARCHAR) AS client_id, CAST(l_shipdate AS DATE) AS dt, p_size, l_linestatus, l_quantity FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN part ON p_partkey = l_partkey WHERE l_quantity <= 40 AND l_returnflag <> 'A' AND {_BOTH})"))
add("j6_listed_snapshots", lambda s, d: profile.of_listed(X.profiles(s, d).where(F.col("month_end") == X.PROFILE_CAP), dep(s, d).where("campaign = 'TOK'")).select("client_id", "segment", "tenure"), q(f"SELECT client_id, segment, tenure FROM prof WHERE month_end = DATE '{X.PROFILE_CAP}' AND client_id IN (SELECT client_id FROM dep WHERE campaign = 'TOK')"))


def _twice(s, d):
    """Snapshots of one month, those of every third client a second time with a longer tenure."""
    rows = X.profiles(s, d).where(F.col("month_end") == X.PROFILE_CAP)
    return rows.unionByName(rows.where("CAST(client_id AS long) % 3 = 0").withColumn("tenure", F.col("tenure") + 1))


add("a5_one_snapshot", lambda s, d: profile.one_snapshot(_twice(s, d)).select("client_id", "segment", "tenure"), q(f"SELECT client_id, segment, tenure + CASE WHEN CAST(client_id AS BIGINT) % 3 = 0 THEN 1 ELSE 0 END AS tenure FROM prof WHERE month_end = DATE '{X.PROFILE_CAP}'"))

# --- e-mail on deployments -----------------------------------------------------------------------------------------------------------

_EML = f"""dem AS (SELECT CAST(o_custkey AS VARCHAR) AS client_id, strftime(o_orderdate, '%Y%j') || {R._CODE} AS tactic_id, {", ".join(f"max((l_linenumber = {k})::INT)::BIGINT AS {n}, min(CAST(l_shipdate AS DATE)) FILTER (WHERE l_linenumber = {k}) AS {n}_dt" for k, n in enumerate(profile.FUNNEL, 1))}
  FROM lineitem JOIN orders ON l_orderkey = o_orderkey WHERE l_linenumber <= 4 GROUP BY 1, 2),
eml AS (SELECT att.*, {", ".join(f"coalesce({n}, 0) AS {n}, {n}_dt" for n in profile.FUNNEL)} FROM att LEFT JOIN dem USING (client_id, tactic_id) WHERE list_contains(string_split(channel, '_'), 'EM'))"""


def mailed(s, d):
    return profile.with_email(att(s, d), profile.email_flags(X.deployment_feedback(s, d)))


_GRAINS = "SELECT campaign, CASE WHEN grouping(cohort) = 1 THEN 'ALL' ELSE cohort END AS cohort, CASE WHEN grouping(report_group) = 1 THEN 'ALL' ELSE report_group END AS report_group, count(*) AS email_deployments, " + ", ".join(f"sum({c})::BIGINT AS {c}" for c in profile.FUNNEL) + ", " + ", ".join(f"CASE WHEN sum(sent) > 0 THEN {r(f'sum({c})', 'sum(sent)')} END AS {c}_rate" for c in profile.FUNNEL[1:]) + " FROM eml WHERE arm = 'action' GROUP BY GROUPING SETS ((campaign), (campaign, cohort), (campaign, cohort, report_group))"
add("ag07_email_by_grain", lambda s, d: profile.email_by_grain(mailed(s, d)), q(_GRAINS, _EML))
_MAILS = "emc AS (" + " UNION ALL ".join(f"SELECT campaign, cohort, arm, client_id, start_dt, window_days, '{m}' AS metric, {m}_dt AS success_dt FROM eml" for m in profile.FUNNEL) + ")"
add("v3_email_curves", lambda s, d: vintage.metric_curves(mailed(s, d), list(profile.FUNNEL)), q(R._curve("campaign, cohort, arm, metric", "emc"), f"{_EML}, {_MAILS}"))

# --- full reports --------------------------------------------------------------------------------------------------------------------

add("ag04_volume_full", on_dep(lambda d: profile.volume(d.where("arm = 'action'"))), q(f"SELECT campaign, n AS deployments, clients, round(n::DOUBLE / clients, 6) AS avg_contacts, {r('n', '(sum(n) OVER ())')} AS pct FROM (SELECT campaign, count(*) AS n, count(DISTINCT client_id) AS clients FROM dep WHERE arm = 'action' GROUP BY 1)"))
_CONTACTS = q("SELECT campaign, round(avg(n), 6) AS avg_contacts, quantile_disc(n, 0.5)::DOUBLE AS median, quantile_disc(n, 0.9)::DOUBLE AS p90, max(n) AS most FROM (SELECT campaign, client_id, count(*) AS n FROM dep WHERE arm = 'action' GROUP BY ALL) GROUP BY 1")
_MAILED = q(f"SELECT * EXCLUDE (opened, clicked, unsubscribed) FROM ({_GRAINS})", _EML)
add("e3_consolidated_full", lambda s, d: scorecard.consolidated_full(att(s, d), mailed(s, d)), f"SELECT * FROM ({O['e3_consolidated']}) LEFT JOIN ({_CONTACTS}) USING (campaign) LEFT JOIN ({_MAILED}) USING (campaign, cohort, report_group)")
add("e4_consolidated_complete", on_att(lambda d: scorecard.lite(d, "2001-05")), f"SELECT * FROM ({O['e4_consolidated_lite']}) WHERE cohort <= '2001-05'")
_FREQUENCY = f"(SELECT campaign, arm, success, 'FREQUENCY' AS slice_type, {S.bucket('n', *K.CONTACTS)} AS slice FROM (SELECT campaign, arm, client_id, count(*) AS n, max(success) AS success FROM att GROUP BY ALL))"
add("e7_frequency_effect", on_att(effect.by_frequency), q(R.judged(R.by_arms("campaign, slice_type, slice", _FREQUENCY), "campaign, slice_type, slice")))
add("e8_credibility", on_att(effect.credibility), f"SELECT * FROM ({O['t5_sample_ratio']}) LEFT JOIN ({O['t7_e8_stability']}) USING (campaign)")
add("e12_detail_export", on_att(scorecard.detail), f"SELECT * FROM ({O['e5_slices']}) UNION ALL BY NAME SELECT * FROM ({O['e7_frequency_effect']})")
add("t4_increments", on_att(lambda d: effect.increments(scorecard.consolidated(d).select("campaign", "cohort", "report_group", "lift", "clients"))), f"WITH m AS (SELECT *, round(lift * 1e6)::BIGINT * clients AS m FROM ({O['e3_consolidated']})), t AS (SELECT *, sign(m) * ((abs(m) + 5000000) // 10000000) / 10e0 AS tenths FROM m) SELECT campaign, cohort, report_group, lift, clients, (sign(m) * (abs(m) // 100000000))::BIGINT AS whole, tenths + 0e0 AS fraction, greatest(tenths, 0e0) + 0e0 AS floored FROM t")
_SRM = f"SELECT campaign, CASE WHEN {S.chi2_p('chi2')} <= 0.01e0 THEN 'ALERT' ELSE 'OK' END AS srm_status, round({S.chi2_p('chi2')}, 6) AS srm_p FROM (SELECT campaign, {S.srm_chi2('n1', 'n0', '0.9e0')} AS chi2 FROM ({R.by_arms('campaign', both=False)}))"
_AFTER = R._AFTER.format("campaign").replace("WHERE success = 1", "WHERE success = 1 AND arm = 'action'")
_CARD_SQL = f"""SELECT campaign, n1, n0, action_rate, control_rate, lift, p_value, {S.stars("p_value")} AS stars, significance, incremental, srm_status, srm_p, cv, stability, deployments, clients, day_50, day_90, did_spend, avg_spend,
round(deployments::DOUBLE / clients, 6) AS avg_contacts, CASE WHEN incremental > 0 THEN round(deployments / incremental, 4) ELSE 0 END + 0e0 AS per_incremental
FROM ({O["e2_overall_lift"]}) LEFT JOIN ({q(_SRM)}) USING (campaign) LEFT JOIN ({O["t7_e8_stability"]}) USING (campaign)
LEFT JOIN ({q("SELECT campaign, count(*) AS deployments, count(DISTINCT client_id) AS clients FROM dep WHERE arm = 'action' GROUP BY 1")}) USING (campaign)
LEFT JOIN (SELECT campaign, day_50, day_90 FROM ({O["v5_ramp"]}) WHERE arm = 'action') USING (campaign) LEFT JOIN ({O["d3_ag13_did"]}) USING (campaign) LEFT JOIN (SELECT campaign, avg_spend FROM ({q(_AFTER)})) USING (campaign)"""
add("e11_scorecard", with_txns(scorecard.scorecard), _CARD_SQL)


def card_with_importance(spark, sf_dir):
    """The scorecard and the trees from one attribution, written once."""
    with temporaries():
        done = staged(att(spark, sf_dir))
        trees = tree.importance(profile.enriched(done, X.profiles(spark, sf_dir), X.PROFILE_CAP))
        return staged(scorecard.with_importance(scorecard.scorecard(done, X.transactions(spark, sf_dir)), trees), keep=True)


add("e11_scorecard_with_importance", card_with_importance,
    f"SELECT c.*, t.feature AS top_feature, t.importance AS top_importance FROM ({O['e11_scorecard']}) c LEFT JOIN (SELECT * FROM ({O['t9_importance']}) QUALIFY row_number() OVER (PARTITION BY campaign ORDER BY importance DESC, feature) = 1) t USING (campaign)")
add("v4_event_days", on_att(vintage.event_day_curves), q(f"SELECT campaign, cohort, arm, day, client_cnt, (sum(n) OVER (PARTITION BY campaign, cohort, arm ORDER BY day))::BIGINT AS success_cnt, {r('(sum(n) OVER (PARTITION BY campaign, cohort, arm ORDER BY day))', 'client_cnt')} AS rate FROM (SELECT campaign, cohort, arm, day, count(*) AS n FROM (SELECT campaign, cohort, arm, client_id, min(success_dt - start_dt) AS day FROM att WHERE success_dt IS NOT NULL GROUP BY ALL) GROUP BY ALL) JOIN (SELECT campaign, cohort, arm, count(DISTINCT client_id) AS client_cnt, quantile_disc(window_days, 0.5) AS window_days FROM att GROUP BY ALL) USING (campaign, cohort, arm) WHERE day <= window_days"))
add("v6_fixed_grid_90", on_att(lambda d: vintage.curves(d.where("campaign = 'TOK'"), ("campaign", "cohort", "arm"), days=90, unit="client")), q(R._curve("campaign, cohort, arm", "tok", "90", "client"), "tok AS (SELECT * FROM att WHERE campaign = 'TOK')"))
add("r4_labels", on_att(lambda d: vintage.labelled(vintage.curves(d))), f"SELECT campaign, cohort, CASE arm WHEN 'action' THEN 'Test' ELSE 'Control' END AS arm, report_group, day, window_days, client_cnt, success_cnt, round(rate / 100e0, 8) AS rate, {R._PRIMARY} AS metric, report_group AS category FROM ({O['v1_curves']})")
add("x10_gap_stats", on_att(lambda d: contact.window_gaps(population.first_deployments(d), "ACQ", "USE")), q("SELECT CASE WHEN a0 < b0 THEN 'A' WHEN a0 > b0 THEN 'B' ELSE 'SAME' END AS first, count(*) AS clients, count(*) FILTER (WHERE gap <= 0) AS overlapping, min(gap) AS least, max(gap) AS most, round(avg(gap), 6) AS mean, quantile_disc(gap, 0.5)::DOUBLE AS median FROM (SELECT a.start_dt AS a0, b.start_dt AS b0, greatest(b.start_dt - a.end_dt, a.start_dt - b.end_dt) AS gap FROM fst a JOIN fst b USING (client_id) WHERE a.campaign = 'ACQ' AND b.campaign = 'USE') GROUP BY 1"))

# --- spend ---------------------------------------------------------------------------------------------------------------------------


def _rollups(rows: str, by: str, sums: str) -> str:
    return f"SELECT {by}, c AS cohort, {sums} FROM (SELECT *, unnest(CASE WHEN k <= 6 THEN [cohort, 'ALL', 'AVG_6M'] ELSE [cohort, 'ALL'] END) AS c FROM (SELECT *, dense_rank() OVER (PARTITION BY {by} ORDER BY cohort DESC) AS k FROM ({rows}))) GROUP BY {by}, c"


_MONEY = "sum({0}::DECIMAL(38,2))::DECIMAL(38,2)::DOUBLE AS {0}"
_COUNT = "sum({0})::BIGINT AS {0}"
add("d7_after_success_full", with_txns(spend.after_success_full), f"SELECT *, round(100 * (with_spend::DOUBLE / successes), 6) AS pct_with_spend, spend / successes AS avg_spend, txns::DOUBLE / successes AS avg_txns FROM ({_rollups(O['d7_d8_after_success_by_cohort'], 'campaign', ', '.join([*map(_COUNT.format, ('successes', 'with_spend', 'txns')), _MONEY.format('spend')]))})")
add("d9_did_around_success", with_txns(lambda d, t: spend.did(d, t, "campaign", anchor="success_dt")), q(R._did(R._prepost("campaign, arm", "att", "success_dt"))))
add("d9_did_around_success_by_cohort", with_txns(lambda d, t: spend.did(d, t, "campaign", "cohort", anchor="success_dt")), q(R._did(R._prepost("campaign, cohort, arm", "att", "success_dt"), "campaign, cohort")))
add("d10_usage_rate", with_txns(lambda d, t: spend.usage(spend.by_flag(d, t, "success", "campaign"))), f"SELECT *, round((100 * users)::DOUBLE / deployments, 6) AS usage_rate FROM ({O['d10_by_flag']})")
_UNIFIED = _rollups(q(R._prepost("campaign, cohort, arm")), "campaign, arm", ", ".join([_COUNT.format("clients"), *(_MONEY.format(f"{p}_spend") for p in ("pre", "post")), *(_COUNT.format(f"{p}_txns") for p in ("pre", "post"))]))
_UNIFIED = " UNION ALL ".join(f"SELECT campaign, cohort, arm, clients, '{p.upper()}' AS period, {p}_spend AS spend, {p}_txns AS txns, {p}_spend / clients AS avg_spend FROM ({_UNIFIED})" for p in ("pre", "post"))
add("d12_w12_unified", with_txns(lambda d, t: spend.unified(population.first_deployments(d), t)), _UNIFIED)
add("q15_coverage", with_txns(lambda d, t: quality.coverage(spend.unified(population.first_deployments(d), t))), f"SELECT campaign, period, count(DISTINCT cohort) AS cohorts, sum(clients)::BIGINT AS clients FROM ({_UNIFIED}) WHERE cohort NOT IN ('AVG_6M', 'ALL') GROUP BY ALL")
add("d13_lift_pct", with_txns(lambda d, t: spend.lift_pct(spend.pre_post(d, t, "campaign", anchor="success_dt", pre_days=90, post_days=90))), f"SELECT *, CASE WHEN pre_spend > 0 THEN round(100 * (post_spend::DECIMAL(38,2) - pre_spend::DECIMAL(38,2))::DOUBLE / pre_spend, 6) END AS lift_pct FROM ({O['d13_fixed_horizon']})")

# --- quality ---------------------------------------------------------------------------------------------------------------------------

_YEARS = list(range(1995, 2002))
add("q1_years", on_dep(lambda d: quality.years_present(d, _YEARS)), q(f"SELECT y::BIGINT AS year, count(decision_id) AS deployments, CASE WHEN count(decision_id) > 0 THEN 'PASS' ELSE 'FAIL' END AS status FROM range({_YEARS[0]}, {_YEARS[-1] + 1}) g(y) LEFT JOIN dep ON year(start_dt) = y GROUP BY y"))
_METRICS = ["acquisition", "activation", "usage", "token"]
add("q6_primary_flag", lambda s, d: quality.primary_flag(att(s, d), population.metric_flags(dep(s, d), ev(s, d), _METRICS).select("decision_id", *_METRICS)), q(f"SELECT campaign, count(*) AS checked, count(*) FILTER (WHERE success <> (EXISTS (SELECT 1 FROM ev e WHERE e.client_id = m.client_id AND e.metric = m.metric AND e.success_dt >= m.start_dt AND e.success_dt <= m.end_dt))::INT) AS mismatches FROM (SELECT *, {R._PRIMARY} AS metric FROM att) m GROUP BY 1"))
add("q8_distributions", on_dep(quality.distributions), q(f"SELECT \"column\", value, n, {r('n', '(sum(n) OVER (PARTITION BY \"column\"))')} AS pct FROM (SELECT 'channel' AS \"column\", coalesce(trim(channel), '') AS value, count(*) AS n FROM dep GROUP BY ALL UNION ALL SELECT 'report_group', coalesce(trim(report_group), ''), count(*) FROM dep GROUP BY ALL)"))
_CASES = {"shortest": ("true", "window_days"), "longest": ("true", "window_days DESC"), "boundary": ("success_dt = start_dt OR success_dt = end_dt", "1"), "several": ("client_id IN (SELECT client_id FROM dep GROUP BY 1 HAVING count(DISTINCT campaign) > 1)", "1")}
add("q9_edge_cases", on_att(quality.edge_cases), q(" UNION ALL ".join(f"SELECT '{n}' AS kind, campaign, decision_id FROM (SELECT *, row_number() OVER (PARTITION BY campaign ORDER BY {o}, md5(decision_id::VARCHAR)) AS k FROM att WHERE {c}) WHERE k <= 3" for n, (c, o) in _CASES.items())))
