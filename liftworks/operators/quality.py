"""Data-quality checks as rows: check_name, status, n_bad, detail."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from liftworks.config import CAMPAIGNS
from liftworks.operators import profile


def report(population: DataFrame, done: DataFrame, events: DataFrame) -> DataFrame:
    """All checks of deployments and their attribution: presence, null ends, unique grain, no lost or doubled rows, flags equal dates, dates
    inside windows, events of the treatment range, blanks. detail says of how many what was found. One pass over each frame; the checks come
    from one joined row."""
    codes = [c.code for c in CAMPAIGNS]
    blank = F.trim(F.coalesce(F.col("channel"), F.lit(""))) == ""
    p = population.agg(F.lit(len(codes)) - F.count_distinct(F.when(F.col("campaign").isin(*codes), F.col("campaign"))), F.count_if(F.col("end_dt").isNull()), F.count("*") - F.count_distinct("decision_id"), F.count("*"), F.count_if(blank), F.min("start_dt"), F.max("start_dt"))
    p = p.toDF("campaigns_present", "null_end", "unique_grain", "deployments", "blank_channel", "from", "to")
    d = done.agg(F.count("*"), F.count_if((F.col("success") == 1) != F.col("success_dt").isNotNull()), F.count_if((F.col("success_dt") < F.col("start_dt")) | (F.col("success_dt") > F.col("end_dt"))), F.count_if((F.col("success_dt") == F.col("start_dt")) | (F.col("success_dt") == F.col("end_dt"))))
    d = d.toDF("attributed", "flag_has_date", "inside_window", "on_boundary")
    e = events.groupBy("metric").agg(F.min("success_dt").alias("lo"), F.max("success_dt").alias("hi")).agg(F.collect_list(F.struct("lo", "hi")).alias("ranges"))  # a row per metric
    rows = p.crossJoin(d).crossJoin(e).withColumn("rows_kept", F.abs(F.col("attributed") - F.col("deployments")))  # one row each
    rows = rows.withColumn("events_overlap", F.size(F.filter("ranges", lambda r: (r["hi"] < F.col("from")) | (r["lo"] > F.col("to")))))
    info = ("on_boundary", "blank_channel")
    names = ("campaigns_present", "null_end", "unique_grain", "rows_kept", "flag_has_date", "inside_window", "events_overlap", *info)
    of = {"campaigns_present": (F.lit(len(codes)), "campaigns"), "events_overlap": (F.size("ranges"), "metrics"), **{n: (F.col("attributed"), "attributed") for n in ("flag_has_date", "inside_window", "on_boundary")}}
    status = lambda n: F.lit("INFO") if n in info else F.when(F.col(n) == 0, "PASS").otherwise("FAIL")

    def detail(n):
        whole, what = of.get(n, (F.col("deployments"), "deployments"))
        return F.concat(F.col(n).cast("string"), F.lit(" of "), whole.cast("string"), F.lit(f" {what}"))

    checks = F.array(*[F.struct(F.lit(n).alias("check_name"), status(n).alias("status"), F.col(n).cast("long").alias("n_bad"), detail(n).alias("detail")) for n in names])
    return rows.select(F.explode(checks).alias("x")).select("x.*")


def years_present(population: DataFrame, years: list[int]) -> DataFrame:
    """year, deployments of every expected year, with a status."""
    found = population.groupBy(F.year("start_dt").alias("year")).agg(F.count("*").alias("n"))
    wanted = population.sparkSession.createDataFrame([(y,) for y in years], "year int")
    return wanted.join(found, "year", "left").select("year", F.coalesce("n", F.lit(0)).alias("deployments"), F.when(F.col("n") > 0, "PASS").otherwise("FAIL").alias("status"))


def rederived(done: DataFrame, events: DataFrame, metric: str) -> DataFrame:
    """Deployments whose date differs from what raw events say, by an own route: from each client's sorted event days of the metric, the
    first one that is not before the start, if it is not after the end."""
    days = events.groupBy("client_id", F.col("metric").alias("_m")).agg(F.sort_array(F.collect_set("success_dt")).alias("days"))  # of one client and metric
    rows = done.withColumn("_m", F.expr(metric)).join(days, ["client_id", "_m"], "left")
    first = F.try_element_at(F.filter("days", lambda x: x >= F.col("start_dt")), F.lit(1))
    rows = rows.withColumn("raw_dt", F.when(first <= F.col("end_dt"), first))
    return rows.groupBy("campaign").agg(F.count("*").alias("checked"), F.count_if(~F.col("success_dt").eqNullSafe(F.col("raw_dt"))).alias("mismatches"))


def primary_flag(done: DataFrame, flags: DataFrame) -> DataFrame:
    """By campaign: deployments, and those whose success is not the flag (0/1, a column per metric) of the campaign's primary metric."""
    own = F.expr("CASE campaign " + " ".join(f"WHEN '{c.code}' THEN {c.metric}" for c in CAMPAIGNS) + " END")
    rows = done.select("decision_id", "campaign", "success").join(flags, "decision_id", "left")
    return rows.groupBy("campaign").agg(F.count("*").alias("checked"), F.count_if(~own.eqNullSafe(F.col("success"))).alias("mismatches"))


def distributions(df: DataFrame, names: tuple[str, ...] = ("channel", "report_group")) -> DataFrame:
    """column, value, n and share (%) of each value of several columns (blank: ""), from one scan."""
    long = df.select(F.explode(F.array(*[F.struct(F.lit(n).alias("column"), F.coalesce(F.trim(F.col(n)), F.lit("")).alias("value")) for n in names])).alias("x")).select("x.*")
    return profile.share(long, "column", "value", within=("column",)).drop("total")


def edge_cases(df: DataFrame, k: int = 3) -> DataFrame:
    """kind, campaign, decision_id: per campaign the k deployments with the shortest and with the longest window, k with a success on the
    first or last day, and k of clients who are in several campaigns; by a hash of their id: the same on every run."""
    several = F.size(F.collect_set("campaign").over(Window.partitionBy("client_id"))) > 1
    rows = df.withColumn("_several", several).withColumn("_h", F.md5(F.col("decision_id").cast("string").cast("binary")))
    kinds = {"shortest": (F.lit(True), "window_days"), "longest": (F.lit(True), F.desc("window_days")), "boundary": ((F.col("success_dt") == F.col("start_dt")) | (F.col("success_dt") == F.col("end_dt")), "_h"), "several": (F.col("_several"), "_h")}
    out = None
    for kind, (chosen, order) in kinds.items():
        w = Window.partitionBy("campaign").orderBy(order, "_h")
        one = rows.where(chosen).withColumn("_n", F.row_number().over(w)).where(F.col("_n") <= k).select(F.lit(kind).alias("kind"), "campaign", "decision_id")
        out = one if out is None else out.unionByName(one)
    return out


def coverage(rows: DataFrame) -> DataFrame:
    """Cohorts and successes by campaign and period of the unified table; averages over cohorts are left out."""
    return rows.where("cohort NOT IN ('AVG_6M', 'ALL')").groupBy("campaign", "period").agg(F.count_distinct("cohort").alias("cohorts"), F.sum("clients").alias("clients"))


def sample(df: DataFrame, k: int = 3) -> DataFrame:
    """k deployments of each campaign, arm and outcome, chosen by a hash of their id: the same on every run."""
    w = Window.partitionBy("campaign", "arm", "success").orderBy(F.md5(F.col("decision_id").cast("string").cast("binary")))
    return df.withColumn("_n", F.row_number().over(w)).where(F.col("_n") <= k).select("campaign", "arm", "success", "decision_id")


def keys_agree(a: DataFrame, b: DataFrame) -> DataFrame:
    """Clients known to both sources, and to one only."""
    x, y = (d.select("client_id").distinct().withColumn(n, F.lit(1)) for d, n in ((a, "x"), (b, "y")))
    return x.join(y, "client_id", "full").agg(F.count_if(F.expr("x = 1 AND y = 1")).alias("both"), F.count_if(F.col("y").isNull()).alias("only_a"), F.count_if(F.col("x").isNull()).alias("only_b"))


def guard(before: DataFrame, after: DataFrame) -> DataFrame:
    """`after`, or an error if a join changed the number of rows. Both are counted: give written frames."""
    n, m = before.count(), after.count()
    if n != m:
        raise ValueError(f"the join made {m} rows of {n}")
    return after


def summary(rows: DataFrame) -> DataFrame:
    return rows.groupBy("status").agg(F.count("*").alias("checks"))
