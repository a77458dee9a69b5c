"""Success rates, lift, significance, sample-ratio and stability, at any grain."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from liftworks.config import CAMPAIGNS, CONTACTS, case
from liftworks.functions import stats as S
from liftworks.sources.scratch import staged, temporaries

ACTION = "arm = 'action'"
CONTROL = "arm = 'control'"
N = ("n1", "s1", "n0", "s0")


def performance(df: DataFrame, *by: str) -> DataFrame:
    """Deployments, successes and rate (%) by these columns."""
    return df.groupBy(*by).agg(F.count("*").alias("deployments"), F.sum("success").alias("successes")).withColumn("rate", F.expr(f"round({S.rate('successes', 'deployments')}, 6)"))


def counted(df: DataFrame, *by: str) -> DataFrame:
    """by, arm, n, s: deployments and successes, small enough to be counted up again at every coarser grain (`arms` with unit counted)."""
    return df.groupBy(*by, "arm").agg(F.count("*").alias("n"), F.sum("success").alias("s"))


def arms(df: DataFrame, *by: str, unit: str = "deployment") -> DataFrame:
    """n1, s1 (action) and n0, s0 (control) by these columns; unit client counts clients and those with any success, unit counted adds up
    the rows of `counted`."""
    if unit == "counted":
        return df.groupBy(*by).agg(*arm_aggs("sum(n)", "sum(s)"))
    if unit == "client":
        df = df.groupBy(*by, "arm", "client_id").agg(F.max("success").alias("success"))
    return df.groupBy(*by).agg(*arm_aggs())


def judged(df: DataFrame) -> DataFrame:
    """Lift, interval, p-value, labels and incremental clients of rows with n1, s1, n0, s0."""
    out = df.withColumn("p", F.expr(S.z_test_p(*N)))
    return out.select(
        *df.columns,
        F.expr(f"round({S.rate('s1', 'n1')}, 6)").alias("action_rate"),
        F.expr(f"round({S.rate('s0', 'n0')}, 6)").alias("control_rate"),
        F.expr(f"round({S.lift(*N)}, 6)").alias("lift"),
        F.expr(f"round({S.relative_lift(*N)}, 6)").alias("relative_lift"),
        F.expr(f"round({S.lift(*N)} - {S.half_width(*N)}, 6)").alias("ci_low"),
        F.expr(f"round({S.lift(*N)} + {S.half_width(*N)}, 6)").alias("ci_high"),
        F.expr("round(p, 6)").alias("p_value"),
        F.expr(S.significance("p")).alias("significance"),
        F.expr(f"round({S.lift(*N)} / 100e0 * n1, 4)").alias("incremental"),
    )


def lift_by(df: DataFrame, *by: str, unit: str = "deployment", both: bool = True) -> DataFrame:
    """Judged rows by these columns; slices that lack an arm are dropped unless both is False."""
    rows = arms(df, *by, unit=unit)
    return judged(rows.where("n1 > 0 AND n0 > 0") if both else rows)


def with_all(df: DataFrame, sets: list[tuple[str, ...]], aggs: list) -> DataFrame:
    """Aggregates over grouping sets in one pass; columns outside a set read 'ALL'."""
    every = list(dict.fromkeys(c for s in sets for c in s))
    out = df.groupingSets([[F.col(c) for c in s] for s in sets], *[F.col(c) for c in every]).agg(*aggs, *[F.grouping(c).alias(f"_g_{c}") for c in every])
    return out.withColumns({c: F.when(F.col(f"_g_{c}") == 1, "ALL").otherwise(F.col(c)) for c in every}).drop(*[f"_g_{c}" for c in every])


def arm_aggs(n: str = "count(*)", s: str = "sum(success)") -> list:
    parts = (("n1", n, ACTION), ("s1", s, ACTION), ("n0", n, CONTROL), ("s0", s, CONTROL))
    return [F.expr(f"coalesce({f} FILTER (WHERE {arm}), 0)").cast("long").alias(x) for x, f, arm in parts]


def rollup(df: DataFrame, sets: list[tuple[str, ...]]) -> DataFrame:
    """Judged rows at several grains from one pass over the deployments."""
    return judged(with_all(df, sets, arm_aggs()))


def slices(df: DataFrame, names: list[str]) -> DataFrame:
    """Effectiveness at each of several slicings (one scan, unpivoted): slice_type, slice, judged by client; slices lacking an arm dropped."""
    pairs = F.array(F.struct(F.lit("OVERALL").alias("slice_type"), F.lit("ALL").alias("slice")), *[F.struct(F.lit(n.upper()).alias("slice_type"), F.col(n).cast("string").alias("slice")) for n in names])
    long = df.select("campaign", "arm", "client_id", "success", F.explode(pairs).alias("x")).select("campaign", "arm", "client_id", "success", "x.slice_type", "x.slice")
    return lift_by(long, "campaign", "slice_type", "slice", unit="client")


def sample_ratio(df: DataFrame, *by: str, alpha: float = 0.05, unit: str = "deployment") -> DataFrame:
    """Chi-squared of the arms' deployments against the designed split, with an alert."""
    rows = arms(df, "campaign", *by, unit=unit).withColumn("split", F.expr(case("campaign", {c.code: c.split for c in CAMPAIGNS}) + " * 1e0"))
    rows = rows.withColumn("chi2", F.expr(S.srm_chi2("n1", "n0", "split"))).withColumn("p", F.expr(S.chi2_p("chi2")))
    return rows.select("campaign", *by, "n1", "n0", F.expr("round(chi2, 4)").alias("chi2"), F.expr("round(p, 6)").alias("p_value"), F.expr(f"CASE WHEN p <= {alpha}e0 THEN 'ALERT' ELSE 'OK' END").alias("status"))


def stability(df: DataFrame, unit: str = "deployment") -> DataFrame:
    """Spread of the cohorts' lifts: sample deviation over the mean's size; 999 for a mean of about 0, 0 for a single cohort."""
    lifts = arms(df, "campaign", "cohort", unit=unit).where("n1 > 0 AND n0 > 0").withColumn("lift", F.expr(S.lift(*N)))
    rows = lifts.groupBy("campaign").agg(F.count("*").alias("cohorts"), F.avg("lift").alias("m"), F.stddev_samp("lift").alias("s"))
    rows = rows.withColumn("cv", F.expr("CASE WHEN cohorts = 1 THEN 0e0 WHEN abs(m) < 1e-9 THEN 999e0 ELSE s / abs(m) END"))
    return rows.select("campaign", "cohorts", F.round("cv", 4).alias("cv"), F.expr("CASE WHEN cv < 0.5e0 THEN 'STABLE' WHEN cv < 1e0 THEN 'MODERATE' ELSE 'UNSTABLE' END").alias("stability"))


def valued(rows: DataFrame) -> DataFrame:
    """Value of significant, positive increments, and whether it may be claimed."""
    sure = "p_value < 0.05e0 AND lift > 0"
    return rows.withColumn("value", F.expr(f"round(CASE WHEN {sure} THEN incremental * {case('campaign', {c.code: c.unit_value for c in CAMPAIGNS}, '0')} ELSE 0e0 END, 2)")).withColumn("eligibility", F.expr(f"CASE WHEN {sure} THEN {case('campaign', {c.code: c.eligibility for c in CAMPAIGNS})} ELSE 'not_sig' END"))


def channel_lift(df: DataFrame) -> DataFrame:
    """Lift of each channel: against the holdout's rate where over 95 % of a campaign's controls are in XX, else against the same channel's."""
    by = df.groupBy("campaign", "channel").agg(*arm_aggs())
    base = by.groupBy("campaign").agg(F.sum("n0").alias("all0"), F.sum(F.when(F.col("channel") == "XX", F.col("n0")).otherwise(0)).alias("x0"), F.sum(F.when(F.col("channel") == "XX", F.col("s0")).otherwise(0)).alias("xs0"))
    rows = by.join(base, "campaign").withColumn("holdout", F.expr("x0 > 0.95e0 * all0")).where("n1 > 0")
    rows = rows.withColumn("n0", F.expr("CASE WHEN holdout THEN x0 ELSE n0 END")).withColumn("s0", F.expr("CASE WHEN holdout THEN xs0 ELSE s0 END"))
    return judged(rows.select("campaign", "channel", "n1", "s1", "n0", "s0", F.when(F.col("holdout"), "XX holdout").when(F.col("n0") > 0, "matched").otherwise("N/A").alias("baseline")))


def by_frequency(df: DataFrame) -> DataFrame:
    """Effectiveness by bucket of a client's contacts in the campaign, in the columns of `slices` (slice_type FREQUENCY)."""
    per = df.groupBy("campaign", "arm", "client_id").agg(F.count("*").alias("n"), F.max("success").alias("success"))
    rows = per.select("campaign", "arm", "success", F.lit("FREQUENCY").alias("slice_type"), F.expr(S.bucket("n", *CONTACTS)).alias("slice"))
    return lift_by(rows, "campaign", "slice_type", "slice")


def credibility(df: DataFrame) -> DataFrame:
    """One row per campaign: the sample ratio and the cohorts' stability."""
    with temporaries():
        rows = staged(counted(df, "campaign", "cohort"))
        return staged(sample_ratio(rows, unit="counted").join(stability(rows, unit="counted"), "campaign", "left"), keep=True)


def increments(rows: DataFrame) -> DataFrame:
    """Incremental clients of rows with lift (points) and clients in three forms: cut to a whole number, to the nearest tenth, at least 0.

    The lift counts to its sixth digit; from there on all is done in whole numbers, so no result rests on the last bit of a double."""
    millionths = F.round(F.col("lift") * 1e6).cast("long") * F.col("clients")
    rows = rows.withColumn("_m", millionths)
    whole = F.expr("CAST(sign(_m) AS LONG) * (abs(_m) div 100000000)")
    tenths = F.expr("CAST(sign(_m) AS LONG) * ((abs(_m) + 5000000) div 10000000)") / F.lit(10.0)
    return rows.withColumns({"whole": whole, "fraction": tenths, "floored": F.greatest(tenths, F.lit(0.0))}).drop("_m")
