"""Spend before and after an anchor, difference-in-differences, spend after success, velocity."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

MONEY = "decimal(38,2)"


def pre_post(first: DataFrame, txns: DataFrame, *by: str, anchor: str = "start_dt", pre_days: int | None = None, post_days: int | None = None) -> DataFrame:
    """Clients, spend and transactions before [anchor - days, anchor) and after [anchor, end] by these columns, all clients counted.

    The days before are the window's unless given; those after end with the window unless given. Deployments without anchor are left out."""
    d = first.where(F.col(anchor).isNotNull()).withColumn("_at", F.col(anchor)).withColumn("_from", F.date_sub(anchor, F.lit(pre_days) if pre_days is not None else F.col("window_days")))
    d = d.withColumn("_to", F.date_add(anchor, F.lit(post_days)) if post_days is not None else F.col("end_dt")).select("decision_id", "client_id", *by, "_at", "_from", "_to").alias("d")
    t = txns.alias("t")
    hit = d.join(t, (F.col("d.client_id") == F.col("t.client_id")) & (F.col("t.txn_dt") >= F.col("d._from")) & (F.col("t.txn_dt") <= F.col("d._to")), "left")
    before, after = F.col("t.txn_dt") < F.col("d._at"), F.col("t.txn_dt") >= F.col("d._at")
    # The join has dealt the rows out by client; the sums of a deployment are made there.
    rows = hit.groupBy("d.client_id", "d.decision_id", *[F.col(f"d.{c}").alias(c) for c in by]).agg(*[F.sum(F.when(c, v)).alias(n) for n, c, v in (("pre_spend", before, F.col("t.amount")), ("post_spend", after, F.col("t.amount")), ("pre_txns", before, F.lit(1)), ("post_txns", after, F.lit(1)))])
    total = lambda c: F.coalesce(F.sum(c), F.lit(0))
    return rows.groupBy(*by).agg(F.count("*").alias("clients"), total("pre_spend").cast(MONEY).alias("pre_spend"), total("post_spend").cast(MONEY).alias("post_spend"), total("pre_txns").cast("long").alias("pre_txns"), total("post_txns").cast("long").alias("post_txns"))


def per_client(rows: DataFrame) -> DataFrame:
    """Averages per client of a pre/post table, and the change."""
    avg = lambda c: F.col(c).cast("double") / F.col("clients")
    return rows.withColumn("avg_pre", avg("pre_spend")).withColumn("avg_post", avg("post_spend")).withColumn("change", (F.col("post_spend") - F.col("pre_spend")).cast("double") / F.col("clients"))


def did(first: DataFrame, txns: DataFrame, *by: str, **how) -> DataFrame:
    """(post - pre) per client in the action arm minus the same in the control arm; a missing arm or period counts 0."""
    rows = pre_post(first, txns, *by, "arm", **how)
    mean = lambda arm, n: F.coalesce(F.max(F.when(F.col("arm") == arm, F.col(n).cast("double") / F.col("clients"))), F.lit(0.0))
    out = rows.groupBy(*by).agg(*[mean(a, f"{p}_{m}").alias(f"{a[0]}_{p}_{m}") for a in ("action", "control") for p in ("pre", "post") for m in ("spend", "txns")])
    diff = lambda m: F.round((F.col(f"a_post_{m}") - F.col(f"a_pre_{m}")) - (F.col(f"c_post_{m}") - F.col(f"c_pre_{m}")), 4)
    return out.select(*by, diff("spend").alias("did_spend"), diff("txns").alias("did_txns"))


def after_success(df: DataFrame, txns: DataFrame, *by: str) -> DataFrame:
    """Spend from success to the window's end per successful deployment; those without any stay in the averages."""
    d = df.where("success = 1").select("decision_id", "client_id", *by, "success_dt", "end_dt").alias("d")
    t = txns.alias("t")
    hit = d.join(t, (F.col("d.client_id") == F.col("t.client_id")) & F.col("t.txn_dt").between(F.col("d.success_dt"), F.col("d.end_dt")), "left")
    rows = hit.groupBy("d.client_id", "d.decision_id", *[F.col(f"d.{c}").alias(c) for c in by]).agg(F.sum("t.amount").alias("spend"), F.nullif(F.count("t.txn_dt"), F.lit(0)).alias("txns"))
    return rows.groupBy(*by).agg(F.count("*").alias("successes"), F.count("spend").alias("with_spend"), F.coalesce(F.sum("spend"), F.lit(0)).cast(MONEY).alias("spend"), F.coalesce(F.sum("txns"), F.lit(0)).alias("txns")).withColumn("avg_spend", F.col("spend").cast("double") / F.col("successes"))


def velocity(df: DataFrame, txns: DataFrame, *by: str, most: int = 90) -> DataFrame:
    """Cumulative spend per successful deployment by day since success, on a complete grid of days."""
    d = df.where("success = 1").select("decision_id", "client_id", *by, "success_dt").alias("d")
    t = txns.alias("t")
    hit = d.join(t, (F.col("d.client_id") == F.col("t.client_id")) & F.col("t.txn_dt").between(F.col("d.success_dt"), F.date_add(F.col("d.success_dt"), most)))
    sums = hit.groupBy(*[F.col(f"d.{c}").alias(c) for c in by], F.datediff("t.txn_dt", "d.success_dt").alias("day")).agg(F.sum("t.amount").alias("spend"))
    grid = d.groupBy(*by).agg(F.count("*").alias("successes")).withColumn("day", F.explode(F.sequence(F.lit(0), F.lit(most))))
    upto = Window.partitionBy(*by).orderBy("day").rowsBetween(Window.unboundedPreceding, 0)
    rows = grid.join(sums, [*by, "day"], "left").withColumn("cum_spend", F.sum(F.coalesce("spend", F.lit(0))).over(upto).cast(MONEY))
    return rows.select(*by, "day", "successes", "cum_spend", (F.col("cum_spend").cast("double") / F.col("successes")).alias("per_success"))


def milestones(curve: DataFrame, days=(7, 14, 30, 60, 90)) -> DataFrame:
    return curve.where(F.col("day").isin(*days))


def by_flag(df: DataFrame, txns: DataFrame, flag: str, *by: str) -> DataFrame:
    """Spend inside the window by a 0/1 flag of the deployment."""
    d, t = df.select("decision_id", "client_id", *by, flag, "start_dt", "end_dt").alias("d"), txns.alias("t")
    hit = d.join(t, (F.col("d.client_id") == F.col("t.client_id")) & F.col("t.txn_dt").between(F.col("d.start_dt"), F.col("d.end_dt")))
    sums = hit.groupBy("decision_id").agg(F.sum("t.amount").alias("spend"))
    rows = d.join(sums, "decision_id", "left")
    return rows.groupBy(*by, flag).agg(F.count("*").alias("deployments"), F.count("spend").alias("users"), F.coalesce(F.sum("spend"), F.lit(0)).cast(MONEY).alias("spend"))


def last_cohorts(rows: DataFrame, k: int = 6, *by: str) -> DataFrame:
    """Pre/post rows of each group's latest k cohorts added up (ratios are made from sums, not averaged)."""
    latest = rows.withColumn("_n", F.dense_rank().over(Window.partitionBy(*by).orderBy(F.desc("cohort")))).where(F.col("_n") <= k)
    return per_client(latest.groupBy(*by).agg(*[F.sum(c).alias(c) for c in ("clients", "pre_txns", "post_txns")], *[F.sum(c).cast(MONEY).alias(c) for c in ("pre_spend", "post_spend")]))


def with_rollups(rows: DataFrame, k: int, by: tuple[str, ...], sums: tuple[str, ...]) -> DataFrame:
    """Rows by cohort, with those of the latest k cohorts added up (cohort AVG_6M) and all of them (cohort ALL), per `by`. Ratios are made from sums."""
    recent = F.dense_rank().over(Window.partitionBy(*by).orderBy(F.desc("cohort"))) <= k
    parts = F.array(F.col("cohort"), F.lit("ALL"), F.when(F.col("_recent"), "AVG_6M"))
    long = rows.withColumn("_recent", recent).withColumn("cohort", F.explode(parts)).where("cohort IS NOT NULL")
    kind = lambda c: MONEY if c.endswith("spend") and not c.startswith("with_") else "long"
    return long.groupBy(*by, "cohort").agg(*[F.sum(c).cast(kind(c)).alias(c) for c in sums])


def after_success_full(df: DataFrame, txns: DataFrame, k: int = 6) -> DataFrame:
    """Spend after success by campaign and cohort, for the latest k cohorts and in all: totals, share (%) with spend, averages."""
    rows = with_rollups(after_success(df, txns, "campaign", "cohort"), k, ("campaign",), ("successes", "with_spend", "spend", "txns"))
    avg = lambda c: F.col(c).cast("double") / F.col("successes")
    return rows.withColumns({"pct_with_spend": F.round(100 * avg("with_spend"), 6), "avg_spend": avg("spend"), "avg_txns": avg("txns")})


def unified(df: DataFrame, txns: DataFrame, k: int = 6) -> DataFrame:
    """campaign, cohort, arm, period (PRE, POST), clients, spend, txns, avg_spend: every campaign under one rule, first deployments, the window's
    days before and after the start; with rows of the latest k cohorts (AVG_6M) and of all (ALL)."""
    rows = with_rollups(pre_post(df, txns, "campaign", "cohort", "arm"), k, ("campaign", "arm"), ("clients", "pre_spend", "post_spend", "pre_txns", "post_txns"))
    periods = F.array(*[F.struct(F.lit(p.upper()).alias("period"), F.col(f"{p}_spend").alias("spend"), F.col(f"{p}_txns").alias("txns")) for p in ("pre", "post")])
    rows = rows.select("campaign", "cohort", "arm", "clients", F.explode(periods).alias("x")).select("campaign", "cohort", "arm", "clients", "x.*")
    return rows.withColumn("avg_spend", F.col("spend").cast("double") / F.col("clients"))


def usage(rows: DataFrame) -> DataFrame:
    """`by_flag` rows with the share (%) of deployments that spent."""
    return rows.withColumn("usage_rate", F.round(100 * F.col("users") / F.col("deployments"), 6))


def lift_pct(rows: DataFrame) -> DataFrame:
    """Pre/post rows with the change of spend in % of what was before; null where nothing was."""
    return rows.withColumn("lift_pct", F.when(F.col("pre_spend") > 0, F.round(100 * (F.col("post_spend") - F.col("pre_spend")).cast("double") / F.col("pre_spend").cast("double"), 6)))
