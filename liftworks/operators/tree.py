"""Importance of contacts, channel and age for success: a decision tree for every campaign, all grown at once.

The rows are counted once into cells (campaign, contacts, channel, age); a cell, not a row, is what the trees are grown on, so each level
is one grouping of small counts into histograms (campaign, node, feature, bin) and one choice of the best split per node. There is no loop
over campaigns, and nothing but the cells grows with the data, up to their bounded number for a campaign.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from liftworks.operators import population
from liftworks.sources.scratch import staged, temporaries

#: Depth of the trees, and clients from which on a campaign has one.
DEPTH, LEAST = 4, 100
#: Features in the order that ties are broken by; channels part by one against the rest, the others by an upper bound.
FEATURES = ("age", "channel", "contacts")
#: Values at the ends of the bins: contacts and ages above count as these.
MOST = {"contacts": 64, "age": 120}


def clients(df: DataFrame) -> DataFrame:
    """A row per client and campaign of the action arm: contacts in the campaign, channel, age (0 if unknown) and success of the first deployment."""
    action = df.where("arm = 'action'")
    n = action.groupBy("client_id", "campaign").agg(F.count("*").alias("contacts"))
    first = population.first_deployments(action).select("client_id", "campaign", "channel", "age", "success")
    return first.join(n, ["client_id", "campaign"])


def cells(rows: DataFrame, least: int = LEAST) -> DataFrame:
    """campaign, contacts, channel (its rank by name in the campaign), age, n, s (successes): counts of the campaigns that have `least` rows.

    Blank and null channels are one, named UNKNOWN."""
    channel = F.coalesce(F.nullif(F.trim("channel"), F.lit("")), F.lit("UNKNOWN"))
    bins = {"contacts": F.least(F.col("contacts"), F.lit(MOST["contacts"])).cast("int"), "age": F.greatest(F.least(F.coalesce(F.col("age").cast("int"), F.lit(0)), F.lit(MOST["age"])), F.lit(0))}
    counts = rows.groupBy("campaign", bins["contacts"].alias("contacts"), channel.alias("name"), bins["age"].alias("age")).agg(F.count("*").alias("n"), F.sum("success").cast("long").alias("s"))
    counts = counts.withColumns({"channel": F.dense_rank().over(Window.partitionBy("campaign").orderBy("name")), "total": F.sum("n").over(Window.partitionBy("campaign"))})
    return counts.where(F.col("total") >= least).select("campaign", "contacts", "channel", "age", "n", "s")


def impurity(n: str, s: str) -> str:
    """Gini impurity times the rows: 2 s (n - s) / n."""
    return f"(2e0 * CAST({s} AS DOUBLE) * CAST({n} - {s} AS DOUBLE) / CAST({n} AS DOUBLE))"


#: What a split takes off the impurity of a node with (n, s) whose left part has (nl, sl).
GAIN = f"{impurity('n', 's')} - {impurity('nl', 'sl')} - {impurity('(n - nl)', '(s - sl)')}"


def best_splits(counts: DataFrame) -> DataFrame:
    """campaign, node, feature, cut, gain: the best split of each node; the larger gain, then the first feature by name, then the least cut."""
    each = F.explode(F.array(*[F.struct(F.lit(f).alias("feature"), F.col(f).alias("bin")) for f in FEATURES]))
    hist = counts.select("campaign", "node", "n", "s", each.alias("x")).groupBy("campaign", "node", "x.feature", "x.bin").agg(F.sum("n").alias("bn"), F.sum("s").alias("bs"))
    of = Window.partitionBy("campaign", "node", "feature")
    upto = of.orderBy("bin").rowsBetween(Window.unboundedPreceding, 0)
    left = {f"{x}l": F.when(F.col("feature") == "channel", F.col(f"b{x}")).otherwise(F.sum(f"b{x}").over(upto)) for x in "ns"}
    hist = hist.withColumns({**left, "n": F.sum("bn").over(of), "s": F.sum("bs").over(of)}).where("nl < n")
    hist = hist.withColumn("gain", F.expr(GAIN)).where("gain > 1e-9")
    return hist.groupBy("campaign", "node").agg(F.min(F.struct((-F.col("gain")).alias("loss"), "feature", F.col("bin").alias("cut"))).alias("x")).select("campaign", "node", "x.feature", "x.cut", (-F.col("x.loss")).alias("gain"))


def splits(df: DataFrame, depth: int = DEPTH, least: int = LEAST) -> tuple[DataFrame, DataFrame]:
    """The trees' splits (campaign, level, node, feature, cut, gain; the root is node 1, the children of n are 2n and 2n + 1) and the cells."""
    counts = staged(cells(clients(df), least), keep=True)
    now, found = counts.withColumn("node", F.lit(1)), None
    for level in range(depth):
        best = staged(best_splits(now).withColumn("level", F.lit(level)), keep=True)
        found = best if found is None else found.unionByName(best)
        value = F.coalesce(*[F.when(F.col("feature") == f, F.col(f)) for f in FEATURES])
        goes_left = F.when(F.col("feature") == "channel", value == F.col("cut")).otherwise(value <= F.col("cut"))
        now = now.join(best.select("campaign", "node", "feature", "cut"), ["campaign", "node"])
        now = staged(now.withColumn("node", 2 * F.col("node") + (~goes_left).cast("int")).drop("feature", "cut"), keep=True)
    return found.select("campaign", "level", "node", "feature", "cut", "gain"), counts


def importance(df: DataFrame, depth: int = DEPTH, least: int = LEAST) -> DataFrame:
    """campaign, feature, importance: each feature's share of all that a campaign's splits take off the impurity (0 without splits)."""
    with temporaries():
        found, counts = splits(df, depth, least)
        every = counts.select("campaign").distinct().withColumn("feature", F.explode(F.array(*[F.lit(f) for f in FEATURES])))
        sums = found.groupBy("campaign", "feature").agg(F.sum("gain").alias("gain"))
        rows = every.join(sums, ["campaign", "feature"], "left").withColumn("all", F.sum("gain").over(Window.partitionBy("campaign")))
        return staged(rows.select("campaign", "feature", F.round(F.coalesce(F.col("gain") / F.col("all"), F.lit(0.0)), 6).alias("importance")), keep=True)


def sql(rows: str, depth: int = DEPTH, least: int = LEAST) -> str:
    """CTEs, the last `importance`, that say the same of a table (campaign, contacts, channel, age, success) of clients."""
    out = f"""
cell0 AS (SELECT campaign, least(contacts, {MOST['contacts']}) AS contacts, coalesce(nullif(trim(channel), ''), 'UNKNOWN') AS name, greatest(least(coalesce(age, 0), {MOST['age']}), 0) AS age, count(*) AS n, sum(success)::BIGINT AS s FROM {rows} GROUP BY ALL),
cell AS (SELECT campaign, contacts, dense_rank() OVER (PARTITION BY campaign ORDER BY name) AS channel, age, n, s FROM cell0 QUALIFY sum(n) OVER (PARTITION BY campaign) >= {least}),
lv0 AS (SELECT *, 1 AS node FROM cell)"""
    for k in range(depth):
        long = " UNION ALL ".join(f"SELECT campaign, node, '{f}' AS feature, {f} AS bin, n, s FROM lv{k}" for f in FEATURES)
        out += f""",
hist{k} AS (SELECT campaign, node, feature, bin, sum(n)::BIGINT AS bn, sum(s)::BIGINT AS bs FROM ({long}) GROUP BY ALL),
part{k} AS (SELECT campaign, node, feature, bin, (sum(bn) OVER w)::BIGINT AS n, (sum(bs) OVER w)::BIGINT AS s, CASE WHEN feature = 'channel' THEN bn ELSE (sum(bn) OVER o)::BIGINT END AS nl, CASE WHEN feature = 'channel' THEN bs ELSE (sum(bs) OVER o)::BIGINT END AS sl
  FROM hist{k} WINDOW w AS (PARTITION BY campaign, node, feature), o AS (PARTITION BY campaign, node, feature ORDER BY bin)),
best{k} AS (SELECT campaign, node, feature, bin AS cut, gain FROM (SELECT *, {GAIN} AS gain FROM part{k} WHERE nl < n) WHERE gain > 1e-9 QUALIFY row_number() OVER (PARTITION BY campaign, node ORDER BY gain DESC, feature, bin) = 1),
lv{k + 1} AS (SELECT l.* REPLACE (2 * node + CASE b.feature WHEN 'channel' THEN CASE WHEN channel = cut THEN 0 ELSE 1 END WHEN 'age' THEN CASE WHEN age <= cut THEN 0 ELSE 1 END ELSE CASE WHEN contacts <= cut THEN 0 ELSE 1 END END AS node) FROM lv{k} l JOIN best{k} b USING (campaign, node))"""
    found = " UNION ALL ".join(f"SELECT {k} AS level, * FROM best{k}" for k in range(depth))
    return out + f""",
splits AS ({found}),
importance AS (SELECT campaign, feature, round(coalesce(gain / sum(gain) OVER (PARTITION BY campaign), 0e0), 6) AS importance
  FROM (SELECT DISTINCT campaign, unnest({list(FEATURES)}) AS feature FROM cell) LEFT JOIN (SELECT campaign, feature, sum(gain) AS gain FROM splits GROUP BY ALL) USING (campaign, feature))"""
