"""One row per campaign, and the combined report at several grains."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from liftworks.functions import stats as S
from liftworks.operators import contact, effect, population, profile, spend, vintage
from liftworks.sources import readers
from liftworks.sources.scratch import staged, temporaries


def consolidated(df: DataFrame) -> DataFrame:
    """Action rows at four grains against the campaign and cohort's control (not a matched report group), clients, value.

    Grains: campaign; campaign and cohort; campaign and report group; campaign, cohort and report group."""
    sets = [("campaign",), ("campaign", "cohort"), ("campaign", "report_group"), ("campaign", "cohort", "report_group")]
    # CUBE-like over cohort and report group: 'ALL' where a column is rolled up
    action = effect.with_all(df.where("arm = 'action'").select("campaign", "cohort", "report_group", "success", "client_id"), sets, [F.count("*").alias("n1"), F.sum("success").alias("s1"), F.countDistinct("client_id").alias("clients")])
    control = effect.with_all(df.where("arm = 'control'").select("campaign", "cohort", "success"), [("campaign",), ("campaign", "cohort")], [F.count("*").alias("n0"), F.sum("success").alias("s0")])
    rows = action.join(control, ["campaign", "cohort"], "left").na.fill(0, ["n0", "s0"])
    out = effect.valued(effect.judged(rows.select("campaign", "cohort", "report_group", "clients", "n1", "s1", "n0", "s0")))
    return out.withColumn("incremental_clients", F.expr("CAST(lift / 100e0 * clients AS int)"))


def value_totals(rows: DataFrame) -> DataFrame:
    """Value of the overall rows by eligibility."""
    return rows.where("cohort = 'ALL' AND report_group = 'ALL'").groupBy("eligibility").agg(F.count("*").alias("campaigns"), F.round(F.sum("value"), 2).alias("value"))


def efficiency(df: DataFrame) -> DataFrame:
    """Deployments, clients, contacts per client, deployments per incremental client (0 where there are none)."""
    a = df.where("arm = 'action'").groupBy("campaign").agg(F.count("*").alias("deployments"), F.countDistinct("client_id").alias("clients"))
    e = effect.lift_by(df, "campaign").select("campaign", "incremental")
    return a.join(e, "campaign", "left").select("campaign", "deployments", "clients", F.expr(f"round({S._d('deployments')} / clients, 6)").alias("avg_contacts"), F.expr("CASE WHEN incremental > 0 THEN round(deployments / incremental, 4) ELSE 0e0 END").alias("per_incremental"))


def consolidated_full(df: DataFrame, email: DataFrame) -> DataFrame:
    """`consolidated` with the campaign's contacts per client (action) and the grain's e-mail deployments and rates (null where it has none)."""
    contacts = contact.contact_stats(df.where("arm = 'action'")).select("campaign", "avg_contacts", "median", "p90", "most")
    mails = profile.email_by_grain(email).drop("opened", "clicked", "unsubscribed")
    return consolidated(df).join(contacts, "campaign", "left").join(mails, ["campaign", "cohort", "report_group"], "left")


def lite(df: DataFrame, complete_to: str) -> DataFrame:
    """`consolidated` by campaign and cohort, without cohorts after the last complete one."""
    return consolidated(df.where(F.col("cohort") <= complete_to)).where("cohort <> 'ALL' AND report_group = 'ALL'").drop("report_group")


def scorecard(df: DataFrame, txns: DataFrame) -> DataFrame:
    """One row per campaign: effect, credibility, efficiency, ramp, difference-in-differences, spend after success. The deployments and the
    spend are written once and read for all parts."""
    with temporaries():
        df, txns = staged(df), staged(txns)
        small = staged(effect.counted(df, "campaign", "cohort"))  # a row per campaign, cohort and arm
        e = effect.lift_by(small, "campaign", unit="counted").select("campaign", "n1", "n0", "action_rate", "control_rate", "lift", "p_value", F.expr(S.stars("p_value")).alias("stars"), "significance", "incremental")
        srm = effect.sample_ratio(small, alpha=0.01, unit="counted").select("campaign", F.col("status").alias("srm_status"), F.col("p_value").alias("srm_p"))
        stab = effect.stability(small, unit="counted").select("campaign", "cv", "stability")
        act = df.where("arm = 'action'").groupBy("campaign").agg(F.count("*").alias("deployments"), F.countDistinct("client_id").alias("clients"))
        ramp = vintage.ramp(vintage.curves(df, ("campaign", "arm"))).where("arm = 'action'").select("campaign", "day_50", "day_90")
        did = spend.did(population.first_deployments(df), txns, "campaign").select("campaign", "did_spend")
        after = spend.after_success(df.where("arm = 'action'"), txns, "campaign").select("campaign", "avg_spend")
        out = e
        for part in (srm, stab, act, ramp, did, after):
            out = out.join(part, "campaign", "left")
        contacts = F.expr(f"round({S._d('deployments')} / clients, 6)")
        return staged(out.withColumns({"avg_contacts": contacts, "per_incremental": F.expr("CASE WHEN incremental > 0 THEN round(deployments / incremental, 4) ELSE 0e0 END")}), keep=True)


def with_importance(card: DataFrame, rows: DataFrame) -> DataFrame:
    """The scorecard with each campaign's most important feature; ties go to the first by name."""
    best = rows.groupBy("campaign").agg(F.max(F.struct(F.col("importance"))).alias("x")).join(rows, "campaign").where(F.col("importance") == F.col("x.importance"))
    return card.join(best.groupBy("campaign").agg(F.min("feature").alias("top_feature"), F.max("importance").alias("top_importance")), "campaign", "left")


def detail(df: DataFrame) -> DataFrame:
    """Effectiveness rows of all slices and contact frequencies in one long table."""
    return effect.slices(df, ["cohort", "channel", "report_group"]).unionByName(effect.by_frequency(df))


def exports(df: DataFrame, txns: DataFrame) -> DataFrame:
    """Curves of all kinds as one long table: campaign, cohort, arm, curve_type, day, value, n."""
    v = vintage.curves(df, ("campaign", "cohort", "arm")).select("campaign", "cohort", "arm", F.lit("vintage").alias("curve_type"), "day", F.col("rate").alias("value"), F.col("client_cnt").alias("n"))
    s = spend.velocity(df, txns, "campaign", "arm").select("campaign", F.lit("ALL").alias("cohort"), "arm", F.lit("velocity").alias("curve_type"), "day", F.col("per_success").alias("value"), F.col("successes").alias("n"))
    return v.unionByName(s)


def export_all(df: DataFrame, txns: DataFrame, folder: str) -> None:
    """Writes the scorecard, the detail rows and the curves as CSV files below a folder."""
    with temporaries():
        df, txns = staged(df), staged(txns)
        for name, rows in (("scorecard", scorecard(df, txns)), ("detail", detail(df)), ("curves", exports(df, txns))):
            readers.save_csv(rows, f"{folder.rstrip('/')}/{name}")
