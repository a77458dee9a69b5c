"""Success by days since start: cumulative curves on complete day grids, their fiscal roll-ups, ramps and rates."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from liftworks import config as K
from liftworks.functions import columns as C
from liftworks.functions import stats as S

GROUP = ("campaign", "cohort", "arm", "report_group")


def curves(df: DataFrame, by: tuple = GROUP, days: int | None = None, unit: str = "deployment") -> DataFrame:
    """day, count, cumulative successes and rate (%) of each group, on a grid from 0 to the group's median window (or `days`).

    Unit client counts a client's first success once per start. A group without success keeps its grid of zeros."""
    if unit == "client":
        df = df.groupBy(*by, "client_id", "start_dt").agg(F.min("success_dt").alias("success_dt"), F.max("window_days").alias("window_days"))
    count = F.countDistinct("client_id") if unit == "client" else F.count("*")
    groups = df.groupBy(*by).agg(count.alias("client_cnt"), F.expr("CAST(percentile_disc(0.5) WITHIN GROUP (ORDER BY window_days) AS int)").alias("window_days"))
    grid = groups.withColumn("day", F.explode(F.sequence(F.lit(0), F.lit(days) if days is not None else F.col("window_days"))))
    hits = df.where("success_dt IS NOT NULL").groupBy(*by, F.datediff("success_dt", "start_dt").alias("day")).agg(F.count("*").alias("n"))
    upto = Window.partitionBy(*by).orderBy("day").rowsBetween(Window.unboundedPreceding, 0)
    rows = grid.join(hits, [*by, "day"], "left").withColumn("success_cnt", F.sum(F.coalesce("n", F.lit(0))).over(upto))
    return rows.select(*by, "day", "window_days", "client_cnt", "success_cnt", F.expr(f"round({S.rate('success_cnt', 'client_cnt')}, 6)").alias("rate"))


def metric_curves(flags: DataFrame, metrics: list[str], by: tuple = ("campaign", "cohort", "arm")) -> DataFrame:
    """Curves of several metrics (columns <metric>_dt) from one scan: deployments are unpivoted by metric."""
    pairs = F.array(*[F.struct(F.lit(m).alias("metric"), F.col(f"{m}_dt").alias("success_dt")) for m in metrics])
    long = flags.drop("success_dt").withColumn("x", F.explode(pairs)).select(*by, "client_id", "start_dt", "window_days", "x.metric", "x.success_dt")
    return curves(long, (*by, "metric"))


def fiscal_curves(df: DataFrame, by: tuple = ("campaign", "fiscal", "arm")) -> DataFrame:
    return curves(df.withColumn("fiscal", C.fiscal_cohort("start_dt")), by)


def ramp(curve: DataFrame, shares=(0.5, 0.9), by: tuple = ("campaign", "arm")) -> DataFrame:
    """First day on which a group's curve reaches each share of its final rate; null for a curve of zeros."""
    rows = curve.withColumn("top", F.max("rate").over(Window.partitionBy(*by))).where("top > 0")
    return rows.groupBy(*by).agg(*[F.min(F.when(F.col("rate") >= s * F.col("top"), F.col("day"))).alias(f"day_{round(100 * s)}") for s in shares])


def to_fiscal(curve: DataFrame) -> DataFrame:
    """Monthly curves added up by fiscal quarter, the rate made anew."""
    rows = curve.withColumn("fiscal", C.fiscal_cohort(F.to_date(F.concat("cohort", F.lit("-01")))))
    out = rows.groupBy("campaign", "fiscal", "arm", "day").agg(F.sum("client_cnt").alias("client_cnt"), F.sum("success_cnt").alias("success_cnt"))
    return out.withColumn("rate", F.expr(f"round({S.rate('success_cnt', 'client_cnt')}, 6)"))


def rates_table(curve: DataFrame, day: int) -> DataFrame:
    """Rates on one day by report group, and weighted over all of them."""
    rows = curve.where(F.col("day") == day)
    out = rows.groupingSets([[F.col("campaign"), F.col("arm"), F.col("report_group")], [F.col("campaign"), F.col("arm")]], "campaign", "arm", "report_group").agg(F.sum("client_cnt").alias("client_cnt"), F.sum("success_cnt").alias("success_cnt"), F.grouping("report_group").alias("g"))
    return out.select("campaign", "arm", F.expr("CASE WHEN g = 1 THEN 'ALL' ELSE report_group END").alias("report_group"), "client_cnt", "success_cnt", F.expr(f"round({S.rate('success_cnt', 'client_cnt')}, 6)").alias("rate"))


def latest_lifts(curve: DataFrame, k: int = 3) -> DataFrame:
    """Final lift of the latest k cohorts of each campaign, latest first."""
    last = curve.groupBy("campaign", "cohort", "arm").agg(F.max(F.struct("day", "rate")).alias("x"))
    rows = last.groupBy("campaign", "cohort").agg(F.max(F.when(F.col("arm") == "action", F.col("x.rate"))).alias("action_rate"), F.max(F.when(F.col("arm") == "control", F.col("x.rate"))).alias("control_rate"))
    rows = rows.withColumn("rank", F.row_number().over(Window.partitionBy("campaign").orderBy(F.desc("cohort"))))
    return rows.where(F.col("rank") <= k).withColumn("lift", F.round(F.col("action_rate") - F.col("control_rate"), 5))


def event_day_curves(df: DataFrame, by: tuple = ("campaign", "cohort", "arm")) -> DataFrame:
    """Cumulative clients with a success by day since start, on days with events only, up to the group's median window; each client counts
    once, on its earliest such day."""
    groups = df.groupBy(*by).agg(F.countDistinct("client_id").alias("client_cnt"), F.expr("CAST(percentile_disc(0.5) WITHIN GROUP (ORDER BY window_days) AS int)").alias("window_days"))
    first = df.where("success_dt IS NOT NULL").groupBy(*by, "client_id").agg(F.min(F.datediff("success_dt", "start_dt")).alias("day"))
    rows = first.groupBy(*by, "day").agg(F.count("*").alias("n")).join(groups, [*by]).where("day <= window_days")
    upto = Window.partitionBy(*by).orderBy("day").rowsBetween(Window.unboundedPreceding, 0)
    rows = rows.withColumn("success_cnt", F.sum("n").over(upto))
    return rows.select(*by, "day", "client_cnt", "success_cnt", F.expr(f"round({S.rate('success_cnt', 'client_cnt')}, 6)").alias("rate"))


def labelled(curve: DataFrame) -> DataFrame:
    """Curves as reports show them: metric by its name, arms by their labels, report group as category too, rates as fractions."""
    metric = F.expr(K.case("campaign", {c.code: c.metric for c in K.CAMPAIGNS}))
    own = F.col("metric") if "metric" in curve.columns else F.lit("PRIMARY")
    return curve.withColumns({"metric": F.when(own == "PRIMARY", metric).otherwise(own), "arm": F.expr(K.case("arm", K.ARM_LABELS)), "category": F.col("report_group"), "rate": F.round(F.col("rate") / 100.0, 8)})
