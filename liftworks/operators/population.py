"""Deployments, outcome events restricted to them, and first success inside each treatment window."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from liftworks.config import CAMPAIGNS, case
from liftworks.functions import columns as C
from liftworks.sources.scratch import staged

ARMS = {"TG4": "action", "TG7": "control"}
#: Events from which on a client's are dealt out by days too, and the days of a bin.
HEAVY, BIN = 100_000, 30


def deployments(raw: DataFrame, data_end: str | None = None, arms: dict = ARMS, without: tuple = ()) -> DataFrame:
    """Cleaned decisions: keys derived, known arms only, incomplete periods and named bad tactics left out, distinct rows."""
    df = raw.select(
        "decision_id",
        C.client_key("event_id").alias("client_id"),
        "tactic_id",
        C.campaign_code("tactic_id").alias("campaign"),
        F.expr(case("trim(group_code)", arms)).alias("arm"),
        F.trim("report_code").alias("report_group"),
        F.trim("channel_code").alias("channel"),
        "start_dt",
        "end_dt",
        F.datediff("end_dt", "start_dt").alias("window_days"),
        C.cohort("start_dt").alias("cohort"),
    ).where("arm IS NOT NULL")
    if data_end:
        df = df.where(F.col("start_dt") < F.lit(data_end).cast("date"))
    if without:
        df = df.where(~F.col("tactic_id").isin(*without))
    return df.distinct()


def of_clients(events: DataFrame, population: DataFrame) -> DataFrame:
    """Events of clients who were in an experiment (semi join, before any wider shuffle)."""
    return events.join(population.select("client_id").distinct(), "client_id", "left_semi")


def campaign_metrics(secondary: bool = False) -> str:
    """SQL for the metric that a campaign is judged by."""
    return case("campaign", {c.code: (c.secondary if secondary else c.metric) for c in CAMPAIGNS if not secondary or c.secondary})


def event_days(events: DataFrame) -> DataFrame:
    """client_id, success_dt, metrics: one row per client and day, its metrics in an array."""
    return events.groupBy("client_id", "success_dt").agg(F.array_sort(F.collect_set("metric")).alias("metrics"))


def attributed(population: DataFrame, events: DataFrame, metric: str | None = None, key: str = "decision_id") -> DataFrame:
    """Deployments with success (0/1) and success_dt: the first event of their metric from start to end, both inclusive.

    One interval join on client and metric, reduced to the first day per deployment where its rows already are: no deployment is lost or
    doubled, rows alike in all columns are one. A null end never matches. `metric`: SQL for a deployment's metric; the campaign's primary
    one by default. `events` of one row per client and day (`event_days`) are joined on the client alone, so where both tables are laid
    out by client nothing is moved."""
    d = population.withColumn("_metric", F.expr(metric or campaign_metrics())).alias("d")
    e = events.alias("e")
    of_metric = F.array_contains("e.metrics", F.col("d._metric")) if "metrics" in events.columns else F.col("d._metric") == F.col("e.metric")
    hit = d.join(e, (F.col("d.client_id") == F.col("e.client_id")) & of_metric & (F.col("e.success_dt") >= F.col("d.start_dt")) & (F.col("e.success_dt") <= F.col("d.end_dt")), "left")
    # The client and metric come first among the keys: the join has dealt the rows out by them.
    rows = hit.groupBy(*[F.col(f"d.`{c}`").alias(c) for c in dict.fromkeys([*population.columns, "_metric"])]).agg(F.min("e.success_dt").alias("success_dt"))
    return rows.select(*population.columns, "success_dt", F.when(F.col("success_dt").isNotNull(), 1).otherwise(0).alias("success"))


def attributed_of_heavy(population: DataFrame, events: DataFrame, heavy: int = HEAVY, metric: str | None = None) -> DataFrame:
    """`attributed` where some clients have very many events: the same rows, in the same columns.

    Clients of more than `heavy` events (any number of them: they are told apart by joins) have their events cut to one per metric and day
    before these move, and go to bins of BIN days each; their deployments go to every bin that their window touches, and meet the events
    there. Each event stands in one bin, so windows keep their exact ends. All others are attributed as ever."""
    crowd = staged(events.groupBy("client_id").count().where(F.col("count") > heavy).select("client_id"))
    rest = attributed(population.join(crowd, "client_id", "left_anti").select(population.columns), events.join(crowd, "client_id", "left_anti"), metric)
    day = lambda c: F.datediff(c, F.lit("1970-01-01").cast("date"))
    d = population.join(crowd, "client_id", "left_semi").select(*population.columns, F.expr(metric or campaign_metrics()).alias("_metric"))
    bins = F.when(F.col("end_dt") >= F.col("start_dt"), F.sequence(F.floor(day("start_dt") / BIN), F.floor(day("end_dt") / BIN)))
    d = d.withColumn("_bin", F.explode_outer(bins)).alias("d")
    e = events.join(crowd, "client_id", "left_semi").select("client_id", "metric", "success_dt").distinct().withColumn("_bin", F.floor(day("success_dt") / BIN)).alias("e")
    same = [F.col(f"d.{a}") == F.col(f"e.{b}") for a, b in (("client_id", "client_id"), ("_metric", "metric"), ("_bin", "_bin"))]
    hit = d.join(e, same[0] & same[1] & same[2] & F.col("e.success_dt").between(F.col("d.start_dt"), F.col("d.end_dt")), "left")
    rows = hit.groupBy(*[F.col(f"d.`{c}`").alias(c) for c in population.columns]).agg(F.min("e.success_dt").alias("success_dt"))
    return rest.unionByName(rows.withColumn("success", F.when(F.col("success_dt").isNotNull(), 1).otherwise(0)))


def metric_flags(population: DataFrame, events: DataFrame, metrics: list[str], key: str = "decision_id") -> DataFrame:
    """Deployments with, for each metric, a flag (0/1) and the first date inside the window: one join for all metrics."""
    d, e = population.alias("d"), events.where(F.col("metric").isin(*metrics)).alias("e")
    hit = d.join(e, (F.col("d.client_id") == F.col("e.client_id")) & F.col("e.success_dt").between(F.col("d.start_dt"), F.col("d.end_dt")), "left")
    df = hit.groupBy(*[F.col(f"d.`{c}`").alias(c) for c in population.columns]).agg(*[F.min(F.when(F.col("e.metric") == m, F.col("e.success_dt"))).alias(f"{m}_dt") for m in metrics])
    return df.withColumns({m: F.when(F.col(f"{m}_dt").isNotNull(), 1).otherwise(0) for m in metrics})


def first_deployments(df: DataFrame) -> DataFrame:
    """Each client's first deployment in each campaign (by start, then tactic id, then decision)."""
    w = Window.partitionBy("client_id", "campaign").orderBy("start_dt", "tactic_id", "decision_id")
    return df.withColumn("_n", F.row_number().over(w)).where("_n = 1").drop("_n")


def first_success(df: DataFrame) -> DataFrame:
    """Deployments with their client's first success in the campaign."""
    return df.withColumn("first_success", F.min("success_dt").over(Window.partitionBy("client_id", "campaign")))
