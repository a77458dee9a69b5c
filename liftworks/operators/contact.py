"""Contact pressure: frequency, sequence, gaps, transitions, waste after success, overlaps, and contact rules."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from liftworks import config as K
from liftworks.functions import stats as S

ORDER = ("start_dt", "tactic_id", "decision_id")


def contact_stats(df: DataFrame) -> DataFrame:
    """Contacts per client: average, median, 90th percentile (discrete) and most, by campaign."""
    per = df.groupBy("campaign", "client_id").agg(F.count("*").alias("n"))
    return per.groupBy("campaign").agg(F.count("*").alias("clients"), F.round(F.avg("n"), 6).alias("avg_contacts"), F.expr("CAST(percentile_disc(0.5) WITHIN GROUP (ORDER BY n) AS double)").alias("median"), F.expr("CAST(percentile_disc(0.9) WITHIN GROUP (ORDER BY n) AS double)").alias("p90"), F.max("n").alias("most"))


def frequency(df: DataFrame) -> DataFrame:
    """Clients, average contacts and success rate by bucket of contacts."""
    per = df.groupBy("campaign", "client_id").agg(F.count("*").alias("n"), F.max("success").alias("success"))
    per = per.withColumn("bucket", F.expr(S.bucket("n", *K.CONTACTS))).withColumn("bucket_order", F.expr(S.bucket_order("n", K.CONTACTS[0])))
    return per.groupBy("campaign", "bucket", "bucket_order").agg(F.count("*").alias("clients"), F.round(F.avg("n"), 6).alias("avg_contacts"), F.expr(f"round({S.rate('sum(success)', 'count(*)')}, 6)").alias("rate"))


def sequenced(df: DataFrame) -> DataFrame:
    """Each deployment's place among its client's in the campaign."""
    return df.withColumn("seq", F.row_number().over(Window.partitionBy("client_id", "campaign").orderBy(*ORDER)))


def diminishing(df: DataFrame, most: int = 10) -> DataFrame:
    """Success rate by contact number up to `most`."""
    return sequenced(df).where(F.col("seq") <= most).groupBy("campaign", "seq").agg(F.count("*").alias("deployments"), F.sum("success").alias("successes"), F.expr(f"round({S.rate('sum(success)', 'count(*)')}, 6)").alias("rate"))


def cumulative(df: DataFrame) -> DataFrame:
    """Shares (%) of all conversions and deployments reached by each contact number."""
    rows = sequenced(df).groupBy("campaign", "seq").agg(F.count("*").alias("deployments"), F.sum("success").alias("successes"))
    upto = Window.partitionBy("campaign").orderBy("seq").rowsBetween(Window.unboundedPreceding, 0)
    every = Window.partitionBy("campaign")
    rows = rows.withColumns({"cs": F.sum("successes").over(upto), "ts": F.sum("successes").over(every), "cd": F.sum("deployments").over(upto), "td": F.sum("deployments").over(every)})
    return rows.select("campaign", "seq", "deployments", "successes", F.expr(f"round({S.rate('cs', 'ts')}, 6)").alias("cum_success_pct"), F.expr(f"round({S.rate('cd', 'td')}, 6)").alias("cum_deployment_pct"))


def cap_coverage(df: DataFrame, caps=(3, 5, 7, 10)) -> DataFrame:
    """Share (%) of conversions kept at each cap on contacts."""
    return cumulative(df).groupBy("campaign").agg(*[F.max(F.when(F.col("seq") <= c, F.col("cum_success_pct"))).alias(f"cap_{c}") for c in caps])


def transitions(df: DataFrame) -> DataFrame:
    """Each deployment with its client's previous one: prev_campaign, gap (days); a client's first has none and is left out."""
    w = Window.partitionBy("client_id").orderBy(*ORDER)
    return df.withColumn("prev_campaign", F.lag("campaign").over(w)).withColumn("prev_start", F.lag("start_dt").over(w)).where("prev_campaign IS NOT NULL").withColumn("gap", F.datediff("start_dt", "prev_start"))


def gaps(df: DataFrame) -> DataFrame:
    rows = transitions(df).withColumn("bucket", F.expr(S.bucket("gap", *K.GAPS)))
    return rows.groupBy("bucket").agg(F.count("*").alias("transitions"), F.countDistinct("client_id").alias("clients"), F.round(F.avg("gap"), 6).alias("avg_gap"))


def close_contacts(df: DataFrame, days: int = 25) -> DataFrame:
    """Transitions closer than `days`, and their clients."""
    return transitions(df).where(F.col("gap") < days).agg(F.count("*").alias("transitions"), F.countDistinct("client_id").alias("clients"))


def matrix(df: DataFrame) -> DataFrame:
    return transitions(df).groupBy("prev_campaign", "campaign").agg(F.count("*").alias("transitions"), F.countDistinct("client_id").alias("clients"), F.round(F.avg("gap"), 6).alias("avg_gap"))


def matrix_top(df: DataFrame, k: int = 20) -> DataFrame:
    """The most frequent transitions; ties by campaign names."""
    return matrix(df).orderBy(F.desc("transitions"), "prev_campaign", "campaign").limit(k)


def transition_classes(df: DataFrame) -> DataFrame:
    """Self-loops, lateral, forward and backward moves in the funnel, with shares of all and of those that are no self-loops."""
    stage = {c.code: c.stage for c in K.CAMPAIGNS}
    rows = transitions(df).withColumn("step", F.expr(f"{K.case('campaign', stage)} - {K.case('prev_campaign', stage)}"))
    kind = F.when(F.col("campaign") == F.col("prev_campaign"), "self-loop").when(F.col("step") == 0, "lateral").when(F.col("step") > 0, "forward").otherwise("backward")
    out = rows.groupBy(kind.alias("class")).agg(F.count("*").alias("transitions"))
    every = Window.partitionBy().rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    out = out.withColumn("n", F.sum("transitions").over(every)).withColumn("moves", F.sum(F.when(F.col("class") != "self-loop", F.col("transitions")).otherwise(0)).over(every))
    return out.select("class", "transitions", F.expr(f"round({S.rate('transitions', 'n')}, 6)").alias("pct"), F.expr(f"round(CASE WHEN class = 'self-loop' THEN 0e0 ELSE {S.rate('transitions', 'moves')} END, 6)").alias("pct_of_moves"))


def bucket_mix(df: DataFrame) -> DataFrame:
    """By bucket of a client's contacts in all campaigns: clients and deployments of each campaign."""
    w = Window.partitionBy("client_id")
    rows = df.withColumn("n", F.count("*").over(w)).withColumn("bucket", F.expr(S.bucket("n", *K.CONTACTS)))
    return rows.groupBy("bucket", "campaign").agg(F.count("*").alias("deployments"), F.countDistinct("client_id").alias("clients"))


def grain_duplicates(df: DataFrame, keys: list[str]) -> DataFrame:
    """Rows that share their keys with another row."""
    return df.withColumn("copies", F.count("*").over(Window.partitionBy(*keys))).where("copies > 1")


def after_success(df: DataFrame) -> DataFrame:
    """Deployments that start after their client's first success in the campaign, with days since then."""
    w = Window.partitionBy("client_id", "campaign")
    return df.withColumn("first_success", F.min("success_dt").over(w)).where("start_dt > first_success").withColumn("gap", F.datediff("start_dt", "first_success"))


def waste(df: DataFrame, *by: str) -> DataFrame:
    """Contacts after success by these columns."""
    return after_success(df).groupBy(*by).agg(F.count("*").alias("wasted"), F.countDistinct("client_id").alias("clients"))


def waste_context(df: DataFrame) -> DataFrame:
    """By campaign: clients with a success, those contacted again, their share (%)."""
    won = df.where("success = 1").groupBy("campaign").agg(F.countDistinct("client_id").alias("successful"))
    hit = waste(df, "campaign")
    return won.join(hit, "campaign", "left").na.fill(0, ["wasted", "clients"]).withColumn("pct", F.expr(f"round({S.rate('clients', 'successful')}, 6)"))


def waste_by_channel_part(df: DataFrame) -> DataFrame:
    """Wasted contacts by e-mail, by mobile and in all."""
    rows = after_success(df)
    part = lambda p: F.sum(F.when(F.array_contains(F.split("channel", "_"), p), 1).otherwise(0))
    return rows.groupBy("campaign").agg(part("EM").alias("em"), part("IM").alias("im"), F.count("*").alias("wasted"))


def waste_gaps(df: DataFrame) -> DataFrame:
    rows = after_success(df).withColumn("bucket", F.expr(S.bucket("gap", *K.AFTER_SUCCESS)))
    return rows.groupBy("campaign", "bucket").agg(F.count("*").alias("wasted"))


def worst_clients(df: DataFrame, k: int = 10) -> DataFrame:
    return waste(df, "client_id").select("client_id", "wasted").orderBy(F.desc("wasted"), "client_id").limit(k)


def worst_timeline(df: DataFrame, k: int = 10) -> DataFrame:
    """All deployments of the worst clients."""
    return df.join(F.broadcast(worst_clients(df, k).select("client_id")), "client_id", "left_semi").select("client_id", "decision_id", "campaign", "channel", "start_dt", "success")  # k ids


def pairs(df: DataFrame, a: str, b: str) -> DataFrame:
    """Every deployment of one campaign with every one of another of the same client: gap (days, absolute) and pattern."""
    x = df.where(F.col("campaign") == a).select("client_id", F.col("start_dt").alias("a_start"), F.col("success").alias("sa"), F.col("decision_id").alias("a_id"))
    y = df.where(F.col("campaign") == b).select("client_id", F.col("start_dt").alias("b_start"), F.col("success").alias("sb"), F.col("decision_id").alias("b_id"))
    pattern = F.when((F.col("sa") == 1) & (F.col("sb") == 1), "BOTH").when(F.col("sa") == 1, "A_ONLY").when(F.col("sb") == 1, "B_ONLY").otherwise("NEITHER")
    return x.join(y, "client_id").withColumn("gap", F.abs(F.datediff("b_start", "a_start"))).withColumn("pattern", pattern)


def pair_gaps(df: DataFrame, a: str, b: str) -> DataFrame:
    return pairs(df, a, b).withColumn("bucket", F.expr(S.bucket("gap", *K.PAIR_GAPS))).groupBy("bucket").agg(F.count("*").alias("pairs"), F.countDistinct("client_id").alias("clients"))


def pair_patterns(df: DataFrame, a: str, b: str) -> DataFrame:
    return pairs(df, a, b).groupBy("pattern").agg(F.count("*").alias("pairs"), F.countDistinct("client_id").alias("clients"))


def closest_pairs(df: DataFrame, a: str, b: str, k: int = 10) -> DataFrame:
    return pairs(df, a, b).where("pattern = 'BOTH'").select("client_id", "a_id", "b_id", "gap").orderBy("gap", "client_id", "a_id", "b_id").limit(k)


def client_patterns(df: DataFrame, a: str, b: str) -> DataFrame:
    """Of clients in both campaigns: in which they succeeded at all."""
    won = lambda c: F.max(F.when(F.col("campaign") == c, F.col("success")))
    per = df.where(F.col("campaign").isin(a, b)).groupBy("client_id").agg(won(a).alias("sa"), won(b).alias("sb")).where("sa IS NOT NULL AND sb IS NOT NULL")
    pattern = F.when((F.col("sa") == 1) & (F.col("sb") == 1), "BOTH").when(F.col("sa") == 1, "A_ONLY").when(F.col("sb") == 1, "B_ONLY").otherwise("NEITHER")
    return per.groupBy(pattern.alias("pattern")).agg(F.count("*").alias("clients"))


def overlap(df: DataFrame, a: str, b: str) -> DataFrame:
    """Clients of one campaign, of another and of both, with shares (%)."""
    per = df.groupBy("client_id").agg(F.max((F.col("campaign") == a).cast("int")).alias("x"), F.max((F.col("campaign") == b).cast("int")).alias("y"))
    rows = per.agg(F.sum("x").alias("a_clients"), F.sum("y").alias("b_clients"), F.sum(F.col("x") * F.col("y")).alias("both"))
    return rows.withColumn("pct_of_a", F.expr(f"round({S.rate('both', 'a_clients')}, 6)")).withColumn("pct_of_b", F.expr(f"round({S.rate('both', 'b_clients')}, 6)"))


def window_overlap(first: DataFrame, a: str, b: str) -> DataFrame:
    """Of clients' first deployments in two campaigns: whether windows overlap, which came first, bucket of the gap between windows."""
    x = first.where(F.col("campaign") == a).select("client_id", F.col("start_dt").alias("a0"), F.col("end_dt").alias("a1"))
    y = first.where(F.col("campaign") == b).select("client_id", F.col("start_dt").alias("b0"), F.col("end_dt").alias("b1"))
    rows = x.join(y, "client_id").withColumn("gap", F.greatest(F.datediff("b0", "a1"), F.datediff("a0", "b1")))
    rows = rows.withColumn("bucket", F.expr(S.bucket("gap", *K.WINDOW_GAPS))).withColumn("first", F.when(F.col("a0") < F.col("b0"), "A").when(F.col("a0") > F.col("b0"), "B").otherwise("SAME"))
    return rows.groupBy("bucket", "first").agg(F.count("*").alias("clients"))


def window_gaps(first: DataFrame, a: str, b: str) -> DataFrame:
    """Of clients' first deployments in two campaigns, by which came first: clients, those with overlapping windows, gap statistics (days
    between windows, below zero where they overlap; the median is discrete)."""
    x = first.where(F.col("campaign") == a).select("client_id", F.col("start_dt").alias("a0"), F.col("end_dt").alias("a1"))
    y = first.where(F.col("campaign") == b).select("client_id", F.col("start_dt").alias("b0"), F.col("end_dt").alias("b1"))
    rows = x.join(y, "client_id").withColumn("gap", F.greatest(F.datediff("b0", "a1"), F.datediff("a0", "b1"))).withColumn("first", F.when(F.col("a0") < F.col("b0"), "A").when(F.col("a0") > F.col("b0"), "B").otherwise("SAME"))
    return rows.groupBy("first").agg(F.count("*").alias("clients"), F.count_if(F.col("gap") <= 0).alias("overlapping"), F.min("gap").alias("least"), F.max("gap").alias("most"), F.round(F.avg("gap"), 6).alias("mean"), F.expr("CAST(percentile_disc(0.5) WITHIN GROUP (ORDER BY gap) AS double)").alias("median"))


def split_by_overlap(df: DataFrame, a: str, b: str) -> DataFrame:
    """Deployments and success rate of campaign a, for clients who are also in b and those who are not."""
    ids = df.where(F.col("campaign") == b).select("client_id").distinct()
    own = df.where(F.col("campaign") == a)
    rows = own.join(ids, "client_id", "left_semi").withColumn("scope", F.lit("overlap")).unionByName(own.join(ids, "client_id", "left_anti").withColumn("scope", F.lit("only")))
    return rows.groupBy("scope", "arm").agg(F.count("*").alias("deployments"), F.expr(f"round({S.rate('sum(success)', 'count(*)')}, 6)").alias("rate"))


def containment(df: DataFrame, column: str) -> DataFrame:
    """For every pair of groups: clients of the one, and how many of them are in the other."""
    ids = df.select(F.col(column).alias("g"), "client_id").distinct()
    sizes = ids.groupBy("g").agg(F.count("*").alias("clients"))
    both = ids.alias("a").join(ids.alias("b"), "client_id").where("a.g <> b.g").groupBy(F.col("a.g").alias("g"), F.col("b.g").alias("other")).agg(F.count("*").alias("shared"))
    return both.join(sizes, "g").select(F.col("g").alias("group_a"), F.col("other").alias("group_b"), "clients", "shared")


def shared_tactics(df: DataFrame) -> DataFrame:
    """For every pair of report groups: tactic ids that both use."""
    ids = df.select("report_group", "tactic_id").distinct()
    return ids.alias("a").join(ids.alias("b"), "tactic_id").where("a.report_group < b.report_group").groupBy(F.col("a.report_group").alias("group_a"), F.col("b.report_group").alias("group_b")).agg(F.count("*").alias("tactics"))


def _cap_flags(df: DataFrame, caps: dict) -> DataFrame:
    """over_cap and in_cooldown (0/1) of every deployment; channels without a rule break none."""
    df = df.withColumn("day", F.datediff("start_dt", F.lit("1970-01-01").cast("date")))
    limit, days, cool = ({c: v[i] for c, v in caps.items()} for i in range(3))
    by_days = {d: [c for c in caps if days[c] == d] for d in sorted(set(days.values()))}
    n = F.lit(None).cast("long")
    for d, own in by_days.items():
        w = Window.partitionBy("client_id", "channel").orderBy("day").rangeBetween(-d + 1, 0)
        n = F.when(F.col("channel").isin(*own), F.count("*").over(w)).otherwise(n)
    prev = F.lag("day").over(Window.partitionBy("client_id", "channel").orderBy("day", "decision_id"))
    df = df.withColumns({"in_window": n, "since": F.col("day") - prev})
    return df.withColumns({"over_cap": F.expr(f"CASE WHEN in_window > {K.case('channel', limit)} THEN 1 ELSE 0 END"), "in_cooldown": F.expr(f"CASE WHEN since < {K.case('channel', cool)} THEN 1 ELSE 0 END")}).drop("day", "in_window", "since")


def cap_breaches(df: DataFrame, caps: dict = K.CAPS) -> DataFrame:
    """Deployments that break their channel's cap (more than n in the days before, itself included) or its cool-down."""
    rows = _cap_flags(df.where(F.col("channel").isin(*caps)), caps)
    return rows.where("over_cap = 1 OR in_cooldown = 1").select("decision_id", "campaign", "channel", "over_cap", "in_cooldown")


def _reached(df: DataFrame) -> DataFrame:
    """The campaign's goal (metric), and the first day on which its client reached that in any campaign."""
    goal = F.expr(K.case("campaign", {c.code: c.metric for c in K.CAMPAIGNS}))
    return df.withColumn("goal", goal).withColumn("reached", F.min("success_dt").over(Window.partitionBy("client_id", "goal")))


def suppressed(df: DataFrame) -> DataFrame:
    """Deployments whose client had already reached the campaign's goal (metric) by an earlier success in any campaign with that goal."""
    return _reached(df).where("start_dt > reached").select("decision_id", "client_id", "campaign", "goal", "reached")


def avoided(df: DataFrame, most: int = 5, caps: dict = K.CAPS) -> DataFrame:
    """Deployments that each rule would have avoided, from one pass: all windows lie within a client, so the rows are dealt out once."""
    w = Window.partitionBy("client_id", "campaign")
    rows = df.repartition("client_id").withColumns({"first_success": F.min("success_dt").over(w), "seq": F.row_number().over(w.orderBy(*ORDER))})
    rows = _reached(_cap_flags(rows, caps))
    rules = {"cap_and_cooldown": "over_cap = 1 OR in_cooldown = 1", "after_success": "start_dt > first_success", f"over_{most}_contacts": f"seq > {most}", "goal_reached": "start_dt > reached"}
    one = rows.agg(*[F.count_if(F.coalesce(F.expr(c), F.lit(False))).alias(n) for n, c in rules.items()])
    return one.select(F.explode(F.array(*[F.struct(F.lit(n).alias("rule"), F.col(n).alias("avoided")) for n in rules])).alias("x")).select("x.*")


def enforced(df: DataFrame, caps: dict = K.CAPS) -> DataFrame:
    """decision_id, client_id, campaign, channel and rule of all contacts, as if the rules had been in force: goal (the campaign's goal reached
    before), cap and cooldown (of the channel, counting only earlier contacts that were let through), in this order; null where let through.

    A contact that a rule stops no longer counts against later ones, so each client's contacts are gone through once, in order. What is
    held for a client are its own contacts."""
    day = F.datediff("start_dt", F.lit("1970-01-01").cast("date"))
    rows = _reached(df).select("client_id", F.struct(*ORDER, "campaign", "channel", day.alias("day"), F.coalesce(F.col("start_dt") > F.col("reached"), F.lit(False)).alias("late")).alias("c"))
    lists = rows.groupBy("client_id").agg(F.array_sort(F.collect_list("c")).alias("all"))
    limit, days, cool = ({c: v[i] for c, v in caps.items()} for i in range(3))
    of = lambda values, x: F.coalesce(*[F.when(x["channel"] == c, F.lit(v)) for c, v in values.items()], F.lit(None))
    kept = lambda x: F.struct(x["channel"].alias("channel"), x["day"].alias("day"))

    def step(s, x):
        within = F.size(F.filter(s["kept"], lambda k: (k["channel"] == x["channel"]) & (k["day"] > x["day"] - of(days, x)))) + 1
        close = F.exists(s["kept"], lambda k: (k["channel"] == x["channel"]) & (x["day"] - k["day"] < of(cool, x)))
        rule = F.when(x["late"], "goal").when(within > of(limit, x), "cap").when(F.coalesce(close, F.lit(False)), "cooldown")
        told = F.array(F.struct(x["decision_id"].alias("decision_id"), x["campaign"].alias("campaign"), x["channel"].alias("channel"), rule.alias("rule")))
        return F.struct(F.when(rule.isNull(), F.concat(s["kept"], F.array(kept(x)))).otherwise(s["kept"]).alias("kept"), F.concat(s["out"], told).alias("out"))

    none = lambda kind: F.expr(f"CAST(array() AS array<struct<{kind}>>)")
    start = F.struct(none("channel: string, day: int").alias("kept"), none("decision_id: bigint, campaign: string, channel: string, rule: string").alias("out"))
    return lists.select("client_id", F.explode(F.aggregate("all", start, step, lambda s: s["out"])).alias("x")).select("x.decision_id", "client_id", "x.campaign", "x.channel", "x.rule")


def volumes(rows: DataFrame) -> DataFrame:
    """rule (NONE where let through), contacts, clients of enforced contacts."""
    return rows.groupBy(F.coalesce("rule", F.lit("NONE")).alias("rule")).agg(F.count("*").alias("contacts"), F.count_distinct("client_id").alias("clients"))
