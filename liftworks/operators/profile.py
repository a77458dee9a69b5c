"""Client profiles joined as of a month-end, e-mail funnels, value shares."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from liftworks import config as K
from liftworks.functions import columns as C
from liftworks.functions import stats as S


def one_snapshot(profiles: DataFrame) -> DataFrame:
    """One row per client and month-end: of several, the largest by its own values in order."""
    names = [c for c in profiles.columns if c not in ("client_id", "month_end")]
    return profiles.groupBy("client_id", "month_end").agg(F.max(F.struct(*names)).alias("_p")).select("client_id", "month_end", "_p.*")


def guarded(profiles: DataFrame) -> DataFrame:
    """The snapshots, or an error while they are read where a client has two of one month-end: a join with them can double no row."""
    names = [c for c in profiles.columns if c not in ("client_id", "month_end")]
    told = F.raise_error(F.concat(F.lit("profile: two snapshots of client "), F.coalesce("client_id", F.lit("?")), F.lit(" on "), F.coalesce(F.col("month_end").cast("string"), F.lit("?"))))
    rows = profiles.groupBy("client_id", "month_end").agg(F.count("*").alias("_n"), F.max(F.struct(*names)).alias("_p"))
    return rows.select("client_id", "month_end", F.when(F.col("_n") == 1, F.col("_p")).otherwise(told.cast(rows.schema["_p"].dataType)).alias("_p")).select("client_id", "month_end", "_p.*")


def enriched(df: DataFrame, profiles: DataFrame, cap: str, strict: bool = False) -> DataFrame:
    """Deployments with their client's profile at the start's month-end, at most the latest snapshot; none is lost, none doubled.

    strict: two snapshots of a client and month-end are an error instead of the larger one. The snapshots are never broadcast: Spark takes
    rows that are exploded from a small table for as few as that table's, and would send all of them through the driver."""
    snapshots = guarded(profiles) if strict else one_snapshot(profiles)
    return df.withColumn("month_end", C.month_end("start_dt", cap)).join(snapshots.hint("merge"), ["client_id", "month_end"], "left")


def of_months(profiles: DataFrame, df: DataFrame, cap: str) -> DataFrame:
    """The snapshots of the month-ends that the deployments ask for. The months, at most one for each of the calendar, are sent to all tasks,
    and where the table is partitioned by month_end Spark reads their partitions alone."""
    months = df.select(C.month_end("start_dt", cap).alias("month_end")).where(F.col("month_end") <= F.lit(cap).cast("date")).distinct()
    return profiles.join(F.broadcast(months), "month_end", "left_semi")


def of_listed(profiles: DataFrame, clients: DataFrame) -> DataFrame:
    """Snapshots of the clients on a list; Spark broadcasts the list where it is small enough by its own measure."""
    return profiles.join(clients.select("client_id").distinct(), "client_id", "left_semi")


def segments(df: DataFrame) -> DataFrame:
    """Enriched deployments with age, tenure and income buckets; unknown values have their own."""
    return df.withColumns({"age_band": F.expr(S.bucket("age", *K.AGES)), "tenure_band": F.expr(S.bucket("tenure", *K.TENURES)), "income_band": F.expr(S.bucket("income", *K.INCOMES))})


def match_rate(df: DataFrame) -> DataFrame:
    return df.groupBy("campaign").agg(F.count("*").alias("deployments"), F.count_if(F.col("segment").isNotNull()).alias("matched"), F.round(F.avg("age"), 6).alias("avg_age"), F.round(F.avg("tenure"), 6).alias("avg_tenure"))


def null_counts(df: DataFrame) -> DataFrame:
    """One row: rows and nulls of every column, in one pass."""
    return df.agg(F.count("*").alias("rows"), *[F.count_if(F.col(c).isNull()).alias(f"null_{c}") for c in df.columns])


def share(df: DataFrame, *by: str, within: tuple = ()) -> DataFrame:
    """Rows by these columns and their share (%) of all rows, or of those alike in `within`."""
    total = Window.partitionBy(*within).rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    rows = df.groupBy(*by).agg(F.count("*").alias("n")).withColumn("total", F.sum("n").over(total))
    return rows.withColumn("pct", F.expr(f"round({S.rate('n', 'total')}, 6)"))


def mix_of_scopes(rows: DataFrame, population: DataFrame, *by: str, within: tuple = ()) -> DataFrame:
    """Rows by these columns and their share (%) within some of them, twice: scope all, and scope experiment for the clients of a population
    alone (a semi join: a client in it many times counts once)."""
    part = rows.join(population.select("client_id").distinct(), "client_id", "left_semi").select(rows.columns)
    both = rows.withColumn("scope", F.lit("all")).unionByName(part.withColumn("scope", F.lit("experiment")))
    return share(both, "scope", *by, within=("scope", *within))


def most_common(df: DataFrame, value: str, *by: str) -> DataFrame:
    """The most frequent value of each group; ties go to the first by name."""
    rows = df.where(F.col(value).isNotNull()).groupBy(*by, value).agg(F.count("*").alias("n"))
    return rows.withColumn("_r", F.row_number().over(Window.partitionBy(*by).orderBy(F.desc("n"), value))).where("_r = 1").drop("_r")


def partition_sizes(df: DataFrame) -> DataFrame:
    return df.groupBy("month_end").agg(F.count("*").alias("n"), F.countDistinct("client_id").alias("clients"))


def email_flags(feedback: DataFrame) -> DataFrame:
    """One row per client and treatment: flag and first day of each disposition. One aggregate, so tactics shared by groups cannot double rows."""
    kinds = {1: "sent", 2: "opened", 3: "clicked", 4: "unsubscribed"}
    return feedback.where("disposition IS NOT NULL").groupBy("client_id", "treatment").agg(
        *[F.max(F.when(F.col("disposition") == k, 1).otherwise(0)).alias(n) for k, n in kinds.items()], *[F.min(F.when(F.col("disposition") == k, F.col("day"))).alias(f"{n}_dt") for k, n in kinds.items()]
    )


def feedback_of(master: DataFrame, event: DataFrame, tactics: DataFrame) -> DataFrame:
    """client_id, treatment, disposition, day from the vendor's two tables: master (hashed_id, treatment, client_no) and event (hashed_id,
    treatment, disposition, at), which meet on both keys, for the treatments among the tactic ids.

    Both tables are cut down to these treatments before they meet, so what is shuffled for the join follows the campaigns, not the
    vendor's tables. A master row that is there twice, or a tactic id that two report groups share, doubles rows here but none of
    `email_flags`, which is one aggregate per client and treatment."""
    ids = tactics.select(F.col("tactic_id").alias("treatment")).distinct()
    m, e = (t.join(ids, "treatment", "left_semi") for t in (master, event))
    return m.join(e, ["hashed_id", "treatment"]).select(C.client_key("client_no").alias("client_id"), "treatment", "disposition", F.to_date("at").alias("day"))


def email_funnel(population: DataFrame, flags: DataFrame) -> DataFrame:
    """Funnel by treatment and in all (grouping sets) over a population of (client, treatment); rates (%) of sent."""
    rows = population.join(flags, ["client_id", "treatment"], "left").na.fill(0, ["sent", "opened", "clicked", "unsubscribed"])
    rows = rows.withColumn("treatment", F.col("treatment").cast("string"))
    out = rows.groupingSets([[F.col("treatment")], []], "treatment").agg(F.count("*").alias("population"), *[F.sum(c).alias(c) for c in ("sent", "opened", "clicked", "unsubscribed")], F.grouping("treatment").alias("g"))
    return out.select(F.expr("CASE WHEN g = 1 THEN 'ALL' ELSE treatment END").alias("treatment"), "population", "sent", "opened", "clicked", "unsubscribed", *[F.expr(f"round({S.rate(c, 'sent')}, 6)").alias(f"{c}_rate") for c in ("opened", "clicked", "unsubscribed")])


FUNNEL = ("sent", "opened", "clicked", "unsubscribed")


def volume(df: DataFrame) -> DataFrame:
    """Deployments, clients, contacts per client and share (%) of all deployments, by campaign."""
    rows = df.groupBy("campaign").agg(F.count("*").alias("deployments"), F.countDistinct("client_id").alias("clients")).withColumn("total", F.sum("deployments").over(Window.partitionBy().rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)))
    return rows.select("campaign", "deployments", "clients", F.round(F.col("deployments") / F.col("clients"), 6).alias("avg_contacts"), F.expr(f"round({S.rate('deployments', 'total')}, 6)").alias("pct"))


def with_email(df: DataFrame, flags: DataFrame) -> DataFrame:
    """Deployments in an e-mail channel with their feedback (by client and tactic id; one row each, whatever report groups share an id)."""
    return df.where(C.has_channel("channel", "EM")).join(flags.withColumnRenamed("treatment", "tactic_id"), ["client_id", "tactic_id"], "left").na.fill(0, list(FUNNEL))


def email_by_grain(df: DataFrame) -> DataFrame:
    """E-mail deployments of the action arm and rates (%) of sent by campaign, by cohort, and by cohort and report group, in one pass."""
    from liftworks.operators import effect

    sets = [("campaign",), ("campaign", "cohort"), ("campaign", "cohort", "report_group")]
    rows = effect.with_all(df.where("arm = 'action'").select("campaign", "cohort", "report_group", *FUNNEL), sets, [F.count("*").alias("email_deployments"), *[F.sum(c).alias(c) for c in FUNNEL]])
    return rows.select("campaign", "cohort", "report_group", "email_deployments", *FUNNEL, *[F.expr(f"CASE WHEN sent > 0 THEN round({S.rate(c, 'sent')}, 6) END").alias(f"{c}_rate") for c in FUNNEL[1:]])
