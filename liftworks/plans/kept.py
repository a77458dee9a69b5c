"""Registered queries of sources and kept tables: each writes its source from the test tables and reads it as production would."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from liftworks import config as K
from liftworks.functions import columns as C
from liftworks.operators import contact, population, profile, quality, sketch, spend
from liftworks.plans.registry import _CODE, BASE, add, att, dep, ev, on_att, on_dep, q, r, with_txns
from liftworks.plans.registry import ORACLE_SQL as O
from liftworks.sources import fixtures as X
from liftworks.sources import readers, scratch, store


def kept(df: DataFrame, *partitions: str) -> str:
    """Where the rows were written to, partitioned by these columns."""
    path = scratch.claimed(df.sparkSession)
    df.write.partitionBy(*partitions).parquet(path) if partitions else df.write.parquet(path)
    return path


# --- sources -----------------------------------------------------------------------------------------------------------------------

YEARS = (1996, 1997, 2000)


def years_of_decisions(spark: SparkSession, sf_dir: str) -> DataFrame:
    raw = X.raw_decisions(spark, sf_dir).withColumn("event_year", F.year("start_dt"))
    return readers.read_partitions(spark, kept(raw, "event_year"), "event_year", list(YEARS), ["decision_id", "tactic_id", "group_code"])


_RAW = f"SELECT o_orderkey AS decision_id, strftime(o_orderdate, '%Y%j') || {_CODE} AS tactic_id, CASE WHEN o_custkey % 100 >= 90 THEN 'TG7 ' ELSE 'TG4 ' END AS group_code, year(o_orderdate)::BIGINT AS event_year FROM orders"
add("s1_years_of_decisions", years_of_decisions, f"{_RAW} WHERE year(o_orderdate) IN {YEARS}")


def present_or_empty(spark: SparkSession, sf_dir: str, source: DataFrame) -> DataFrame:
    """Rows of a source that is there, and of one that is not, by column."""
    ddl = ", ".join(f"`{c}` {t}" for c, t in source.dtypes)
    there, missing = (readers.read_or_empty(spark, p, ddl) for p in (kept(source), f"{scratch.shared_dir(spark)}/none-{uuid.uuid4().hex}"))
    return there.withColumn("origin", F.lit("there")).unionByName(missing.withColumn("origin", F.lit("missing"))).groupBy("origin").agg(F.count("*").alias("rows"), *[F.count(c).alias(c) for c in source.columns])


_COUNTS = lambda table, names: f"SELECT 'there' AS origin, count(*) AS rows, {', '.join(f'count({e}) AS {c}' for c, e in names.items())} FROM {table}"
add("s2_cards_or_empty", lambda s, d: present_or_empty(s, d, X.card_table(s, d)), _COUNTS("orders", {"client_id": "o_custkey", "status": "o_orderstatus", "service": "o_orderkey", "issued": "CASE WHEN o_orderkey % 11 <> 0 THEN 1 END", "activated": "CASE WHEN o_orderkey % 3 <> 0 THEN 1 END"}))
add("s3_purchases_or_empty", lambda s, d: present_or_empty(s, d, X.purchase_log(s, d)), _COUNTS("lineitem", {c: "l_orderkey" for c in ("service", "txn_type", "message", "amount", "txn_dt", "card_no")}))

DERBY = "org.apache.derby.iapi.jdbc.AutoloadedDriver"


def in_warehouse(spark: SparkSession, sf_dir: str) -> tuple[str, str]:
    """URL and catalog of a database (in memory) that holds the orders' numbers."""
    name = f"wh_{uuid.uuid4().hex}"
    url = f"jdbc:derby:memory:{name};create=true"
    rows = X.table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey", F.year("o_orderdate").alias("o_year"), F.datediff(F.to_date("o_orderdate"), F.lit("1970-01-01").cast("date")).alias("o_day"))
    rows.repartition(1).write.format("jdbc").options(url=url, dbtable="ORDERS", driver=DERBY, batchsize="5000").save()  # Derby's memory takes one writer
    return url, readers.warehouse(spark, name, url, DERBY)


def by_warehouse(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders by year of some clients, worked out by the database."""
    _, catalog = in_warehouse(spark, sf_dir)
    return spark.table(f"{catalog}.APP.ORDERS").where("o_custkey > 100 AND o_day >= 9500").groupBy("o_year").agg(F.count("*").alias("orders"), F.max("o_orderkey").alias("last_order"))


def warehouse_ranges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All orders of the database, read by ranges of a column whose ends it is asked for."""
    url, _ = in_warehouse(spark, sf_dir)
    return readers.read_jdbc_whole(spark, url, "ORDERS", "o_day", 8, driver=DERBY).groupBy("o_custkey").agg(F.count("*").alias("orders"), F.min("o_day").alias("first_day"))


add("s8_warehouse_pushdown", by_warehouse, "SELECT year(o_orderdate)::BIGINT AS o_year, count(*) AS orders, max(o_orderkey) AS last_order FROM orders WHERE o_custkey > 100 AND CAST(o_orderdate AS DATE) - DATE '1970-01-01' >= 9500 GROUP BY 1")
add("s8_warehouse_ranges", warehouse_ranges, "SELECT o_custkey, count(*) AS orders, min(CAST(o_orderdate AS DATE) - DATE '1970-01-01')::BIGINT AS first_day FROM orders GROUP BY 1")


def by_month_end(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Client snapshots as a table partitioned by month-end; a month too large for one task is written by several."""
    rows = X.profiles(spark, sf_dir)
    path = kept(rows.hint("rebalance", "month_end"), "month_end")
    return spark.read.schema(rows.schema).parquet(path)


add("s9_latest_partition", lambda s, d: readers.latest(by_month_end(s, d), "month_end").select("client_id", "month_end", "segment", F.coalesce("age", F.lit(-1)).alias("age")), f"SELECT client_id, month_end, segment, age FROM ({O['s9_latest_snapshot']})")
MONTHS = ("1996-02-29", "1999-12-31")
add("s10_months_of_profiles", lambda s, d: by_month_end(s, d).where(F.col("month_end").isin(*[F.lit(m).cast("date") for m in MONTHS])).select("client_id", "month_end", "segment", "age"),
    q(f"SELECT client_id, month_end, segment, age::BIGINT AS age FROM prof WHERE month_end IN ({', '.join(f'DATE {m!r}' for m in MONTHS)})"))


def asof(df: DataFrame, snapshots: DataFrame) -> DataFrame:
    """Deployments with their profiles from a partitioned table: only the wanted months are read, and a doubled snapshot is an error."""
    return profile.enriched(df, profile.of_months(snapshots, df, X.PROFILE_CAP), X.PROFILE_CAP, strict=True)


#: Deployments of one quarter, so that most of the snapshots' months are not wanted.
QUARTER = ("1997-04-01", "1997-06-30")
_IN_QUARTER = f"start_dt BETWEEN DATE '{QUARTER[0]}' AND DATE '{QUARTER[1]}'"
add("j7_s10_asof_months", lambda s, d: asof(dep(s, d).where(_IN_QUARTER), by_month_end(s, d)).select("decision_id", "client_id", "month_end", "segment", "income", F.coalesce("age", F.lit(-1)).alias("age"), "tenure"),
    q(f"SELECT decision_id, client_id, least(last_day(start_dt), DATE '{X.PROFILE_CAP}') AS month_end, segment, income, coalesce(age, -1)::BIGINT AS age, tenure::BIGINT AS tenure FROM rich WHERE {_IN_QUARTER}"))
add("q13_guarded_match_rate", lambda s, d: profile.match_rate(asof(att(s, d), by_month_end(s, d))), O["j7_ag20_match_rate"])


def fallback(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Attributed deployments from the enriched table, or as here where there is none from the plain one."""
    return readers.first_that_exists(spark, [f"{scratch.shared_dir(spark)}/none-{uuid.uuid4().hex}", kept(att(spark, sf_dir))])


def saved_and_counted(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Attributed deployments saved, the rows that arrived compared with those that were written, and read again."""
    path = scratch.claimed(spark)
    readers.save_checked(att(spark, sf_dir), path)
    return spark.read.parquet(path)


add("s11_saved_and_counted", saved_and_counted, O["a1_first_success"])
add("s12_fallback", lambda s, d: fallback(s, d).groupBy("campaign").agg(F.count("*").alias("deployments"), F.sum("success").alias("successes")), q("SELECT campaign, count(*) AS deployments, sum(success)::BIGINT AS successes FROM att GROUP BY 1"))


def through_csv(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A report written as CSV within the size guard, and read again."""
    rows = dep(spark, sf_dir).groupBy("campaign", "cohort", "arm").agg(F.count("*").alias("deployments"))
    path = scratch.claimed(spark)
    readers.save_csv(rows, path)
    return spark.read.option("header", True).schema(rows.schema).csv(path)


add("s13_csv_export", through_csv, q("SELECT campaign, cohort, arm, count(*) AS deployments FROM dep GROUP BY ALL"))

# --- e-mail from the vendor's two tables -----------------------------------------------------------------------------------------------


def two_table_flags(spark: SparkSession, sf_dir: str) -> DataFrame:
    """E-mail flags of one campaign's tactic ids, the master and event tables cut down to these before they meet."""
    master, event = X.feedback_tables(spark, sf_dir)
    return profile.email_flags(profile.feedback_of(master, event, dep(spark, sf_dir).where("campaign = 'ACQ' AND channel LIKE '%EM%'")))


_MAIL = f"""ids AS (SELECT DISTINCT tactic_id AS treatment FROM dep WHERE campaign = 'ACQ' AND channel LIKE '%EM%'),
fb2 AS (SELECT CAST(o_custkey AS VARCHAR) AS client_id, strftime(o_orderdate, '%Y%j') || {_CODE} AS treatment, l_linenumber AS disposition, CAST(l_shipdate AS DATE) AS day FROM lineitem JOIN orders ON l_orderkey = o_orderkey WHERE l_linenumber <= 4)"""
_FLAG = ", ".join(f"max((disposition = {k})::BIGINT) AS {n}" for k, n in enumerate(profile.FUNNEL, 1)) + ", " + ", ".join(f"min(day) FILTER (WHERE disposition = {k}) AS {n}_dt" for k, n in enumerate(profile.FUNNEL, 1))
add("s7_two_tables", two_table_flags, q(f"SELECT client_id, treatment, {_FLAG} FROM fb2 JOIN ids USING (treatment) GROUP BY ALL", _MAIL))

# --- attributed deployments kept by client and by month --------------------------------------------------------------------------------


def lines_by_client(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The lines moved to their clients, once: days of events are worked out where they lie, and spend is read from them."""
    return store.staged_by_client(X.shipped(spark, sf_dir))


def kept_by_client(spark: SparkSession, sf_dir: str, lines: DataFrame | None = None) -> DataFrame:
    """Deployments attributed where both tables lie by client, and kept so."""
    lines = lines_by_client(spark, sf_dir) if lines is None else lines
    d, e = store.staged_by_client(dep(spark, sf_dir)), store.staged_by_client(population.event_days(X.events_of(lines)))
    return store.staged_by_client(population.attributed(d, e))


def pre_post_kept(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines = lines_by_client(spark, sf_dir)
    return spend.per_client(spend.pre_post(population.first_deployments(kept_by_client(spark, sf_dir, lines)), X.spend_of(lines), "campaign", "cohort", "arm"))


add("s11_kept_attribution", kept_by_client, O["a1_first_success"])
add("s11_kept_sequence", lambda s, d: contact.sequenced(kept_by_client(s, d)).select("decision_id", "seq"), O["w3_sequence"])
add("s11_kept_gaps", lambda s, d: contact.gaps(kept_by_client(s, d)), O["w7_p14_gaps"])
add("s11_kept_waste", lambda s, d: contact.waste(kept_by_client(s, d), "campaign"), O["x1_waste"])
add("s11_kept_pre_post", pre_post_kept, O["d1_j5_pre_post"])

#: In the test tables a client of 60 events is a heavy one.
add("j1_heavy_clients", lambda s, d: population.attributed_of_heavy(dep(s, d), ev(s, d), heavy=60), O["a1_first_success"])

#: Days before which the first waves of deployments and events lie.
WAVES = ("1997-01-01", "1999-06-15", "2100-01-01")


def in_waves(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Deployments and events that come in three waves, attributed wave by wave into one table by month."""
    # Every wave reads both more than once, and making the events moves all lines.
    root, d, e, since = scratch.claimed(spark), scratch.staged(dep(spark, sf_dir)), scratch.staged(ev(spark, sf_dir)), "1900-01-01"
    for until in WAVES:
        store.advance(root, d.where(F.col("start_dt").between(since, F.date_sub(F.lit(until).cast("date"), 1))), e.where(F.col("success_dt").between(since, F.date_sub(F.lit(until).cast("date"), 1))), e.where(F.col("success_dt") < until))
        since = until
    return store.open_by_month(spark, root, ", ".join(f"`{c}` {t}" for c, t in population.attributed(d, e).dtypes))


add("s11_incremental", in_waves, O["a1_first_success"])

# --- wider forms -------------------------------------------------------------------------------------------------------------------------


def cards_by_month(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Cards' status by month of issue, of all clients and of those in one experiment."""
    issued = X.card_table(spark, sf_dir).where("issued IS NOT NULL").withColumn("month", F.date_format("issued", "yyyy-MM"))
    return profile.mix_of_scopes(issued, dep(spark, sf_dir).where("campaign = 'TOK' AND cohort = '1997-03'"), "month", "status", within=("month",))


_ISSUED = f"issued AS (SELECT CAST(o_custkey AS VARCHAR) AS client_id, {K.case('o_orderstatus', {'F': '06', 'O': '08', 'P': '01'})} AS status, strftime(o_orderdate, '%Y-%m') AS month FROM orders WHERE o_orderkey % 11 <> 0), both_scopes AS (SELECT 'all' AS scope, * FROM issued UNION ALL SELECT 'experiment', * FROM issued WHERE client_id IN (SELECT client_id FROM dep WHERE campaign = 'TOK' AND cohort = '1997-03'))"
add("ag19_cards_by_scope", cards_by_month, q(f"SELECT scope, month, status, n, total, {r('n', 'total')} AS pct FROM (SELECT *, (sum(n) OVER (PARTITION BY scope, month))::BIGINT AS total FROM (SELECT scope, month, status, count(*) AS n FROM both_scopes GROUP BY ALL))", _ISSUED))

def labels_of_quarters(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fiscal quarters of calendar-quarter labels in all forms that reports use, and null for what is none."""
    y, k = F.year("start_dt").cast("string"), F.quarter("start_dt").cast("string")
    labels = F.array(F.concat(y, F.lit("Q"), k), F.concat(y, F.lit("-Q"), k), F.concat(F.lit("Q"), k, F.lit(" "), y), F.concat(F.lit("year "), y))
    return dep(spark, sf_dir).select(F.explode(labels).alias("label")).distinct().withColumn("fiscal", C.fiscal_of_quarter("label"))


_LABELS = " UNION ".join(f"SELECT {e} AS label, 'FY' || (y + CASE WHEN k = 4 THEN 1 ELSE 0 END) || 'Q' || (k % 4 + 1) AS fiscal FROM yk" for e in ("y || 'Q' || k", "y || '-Q' || k", "'Q' || k || ' ' || y")) + " UNION SELECT 'year ' || y, NULL FROM yk"
add("p9_fiscal_of_labels", labels_of_quarters, q(_LABELS, "yk AS (SELECT DISTINCT year(start_dt) AS y, quarter(start_dt) AS k FROM dep)"))

_SPENT = "SELECT g.campaign, g.cohort, g.arm, g.day, successes, (sum(coalesce(spend, 0)) OVER (PARTITION BY g.campaign, g.cohort, g.arm ORDER BY g.day))::DECIMAL(38,2)::DOUBLE AS cum_spend FROM (SELECT *, unnest(range(121)) AS day FROM (SELECT campaign, cohort, arm, count(*) AS successes FROM att WHERE success = 1 GROUP BY ALL)) g LEFT JOIN (SELECT campaign, cohort, arm, txn_dt - success_dt AS day, sum(amount) AS spend FROM att d JOIN txn t ON t.client_id = d.client_id AND txn_dt BETWEEN success_dt AND success_dt + 120 GROUP BY ALL) s USING (campaign, cohort, arm, day)"
add("d5_velocity_by_cohort", with_txns(lambda d, t: spend.velocity(d, t, "campaign", "cohort", "arm", most=120)), q(f"SELECT *, cum_spend / successes AS per_success FROM ({_SPENT})"))

# --- checks and rules --------------------------------------------------------------------------------------------------------------------

_METRICS = ("acquisition", "activation", "usage", "token")


def all_rederived(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each metric's first day of every deployment against the raw events, by campaign and metric."""
    flags = population.metric_flags(dep(spark, sf_dir), ev(spark, sf_dir), list(_METRICS))
    long = flags.select("decision_id", "client_id", "campaign", "start_dt", "end_dt", F.explode(F.array(*[F.struct(F.lit(m).alias("metric"), F.col(f"{m}_dt").alias("success_dt")) for m in _METRICS])).alias("x")).select("*", "x.*").drop("x")
    return quality.rederived(long.withColumn("campaign", F.concat("campaign", F.lit(":"), "metric")), ev(spark, sf_dir), "metric").select(F.substring_index("campaign", ":", 1).alias("campaign"), F.substring_index("campaign", ":", -1).alias("metric"), "checked", "mismatches")


_FIRST = "SELECT d.decision_id, d.client_id, d.campaign, d.start_dt, d.end_dt, m.metric, min(e.success_dt) AS success_dt FROM dep d CROSS JOIN (SELECT unnest(" + str(list(_METRICS)) + ") AS metric) m LEFT JOIN ev e ON e.client_id = d.client_id AND e.metric = m.metric AND e.success_dt BETWEEN d.start_dt AND d.end_dt GROUP BY ALL"
add("q10_all_metrics", all_rederived, q("SELECT campaign, metric, count(*) AS checked, count(*) FILTER (WHERE success_dt IS DISTINCT FROM (SELECT e.success_dt FROM ev e WHERE e.client_id = f.client_id AND e.metric = f.metric AND e.success_dt >= f.start_dt AND e.success_dt <= f.end_dt ORDER BY e.success_dt LIMIT 1)) AS mismatches FROM f GROUP BY ALL", f"f AS ({_FIRST})"))

add("ag10_sketched_universe", on_dep(lambda d: sketch.counted(sketch.rolled_up(sketch.client_sketches(d, "campaign", "cohort"), "campaign"))), q("SELECT campaign, count(*) AS deployments, count(DISTINCT client_id) AS clients, round(count(*)::DOUBLE / count(DISTINCT client_id), 6) AS per_client FROM dep GROUP BY 1"))
add("x9_sketched_overlap", on_dep(lambda d: sketch.overlap(sketch.client_sketches(d, "campaign", "cohort"), "campaign", "ACQ", "USE")), O["x9_overlap"])
add("ag12_sketched_percentiles", on_dep(lambda d: sketch.percentiles(sketch.contact_sketches(d, "campaign", "arm"), "campaign")), q("SELECT campaign, count(*) AS clients, max(n) AS most, quantile_disc(n, 0.5)::BIGINT AS p50, quantile_disc(n, 0.9)::BIGINT AS p90 FROM (SELECT campaign, client_id, count(*) AS n FROM dep GROUP BY ALL) GROUP BY 1"))

_LIMIT, _DAYS, _COOL = (K.case("channel", {c: v[i] for c, v in K.CAPS.items()}) for i in range(3))
_GOAL = K.case("campaign", {c.code: c.metric for c in K.CAMPAIGNS})
_FORCE = f"""
goal AS (SELECT *, min(success_dt) OVER (PARTITION BY client_id, {_GOAL}) AS reached, start_dt - DATE '1970-01-01' AS day, row_number() OVER (PARTITION BY client_id ORDER BY start_dt, tactic_id, decision_id) AS k, {_LIMIT} AS lim, {_DAYS} AS dys, {_COOL} AS cool FROM att),
walk AS (SELECT client_id, 0::BIGINT AS k, NULL::BIGINT AS decision_id, NULL::VARCHAR AS campaign, NULL::VARCHAR AS channel, NULL::VARCHAR AS rule, []::STRUCT(c VARCHAR, d BIGINT)[] AS seen FROM (SELECT DISTINCT client_id FROM att)
  UNION ALL SELECT client_id, k, decision_id, campaign, channel, rule, CASE WHEN rule IS NULL THEN list_append(seen, {{'c': channel, 'd': day}}) ELSE seen END FROM (
    SELECT g.client_id, g.k, g.decision_id, g.campaign, g.channel, g.day, w.seen, CASE WHEN g.start_dt > g.reached THEN 'goal' WHEN len(list_filter(w.seen, lambda x: x.c = g.channel AND x.d > g.day - g.dys)) + 1 > g.lim THEN 'cap' WHEN len(list_filter(w.seen, lambda x: x.c = g.channel AND g.day - x.d < g.cool)) > 0 THEN 'cooldown' END AS rule
    FROM walk w JOIN goal g ON g.client_id = w.client_id AND g.k = w.k + 1)),
forced AS (SELECT decision_id, client_id, campaign, channel, rule FROM walk WHERE k > 0)"""
_WITH = f"WITH RECURSIVE {BASE},{_FORCE} "
add("r8_enforced", on_att(contact.enforced), _WITH + "SELECT * FROM forced")
add("r8_enforced_volumes", on_att(lambda d: contact.volumes(contact.enforced(d))), _WITH + "SELECT coalesce(rule, 'NONE') AS rule, count(*) AS contacts, count(DISTINCT client_id) AS clients FROM forced GROUP BY 1")
