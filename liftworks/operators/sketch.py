"""Mergeable sketches of clients and contacts: kept per fine group, merged for any roll-up without reading deployments again.

Theta sketches count distinct clients and overlaps. A sketch of more than 2^LG_CLIENTS clients only estimates, and its estimate depends on
the order of merges; so each group's clients are dealt out by hash to PARTS sketches, every one of which stays exact: up to some 60 million
clients of a group all counts and overlaps are exact. A sketch that holds more is an error that names the remedy, never a silent estimate.
KLL sketches give percentiles, exactly up to K values of a group and beyond that with a rank error of about 2.3 / K^0.9, 0.1 %. The exact
forms are `profile` and `contact`'s.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from liftworks.functions import stats as S

#: Base-2 logarithm of the clients that a theta sketch holds, and the values that a KLL sketch holds.
LG_CLIENTS, K = 14, 4096
#: Theta sketches of a group; sketches that are merged need the same number.
PARTS = 4096


def client_sketches(df: DataFrame, *by: str, parts: int = PARTS) -> DataFrame:
    """by, _part, deployments, clients (a sketch): what is kept of the deployments of each group, by parts of the clients."""
    part = F.pmod(F.xxhash64("client_id"), F.lit(parts)).alias("_part")
    return df.groupBy(*by, part).agg(F.count("*").alias("deployments"), F.theta_sketch_agg("client_id", LG_CLIENTS).alias("clients"))


def rolled_up(sketches: DataFrame, *by: str) -> DataFrame:
    """The kept sketches merged to coarser groups, or with no column to one."""
    return sketches.groupBy(*by, "_part").agg(F.sum("deployments").alias("deployments"), F.theta_union_agg("clients", LG_CLIENTS).alias("clients"))


def size(clients: Column) -> Column:
    """The clients of a sketch, 0 of none; an error where the sketch holds more than it can count."""
    n = F.theta_sketch_estimate(clients)
    told = F.raise_error(F.lit(f"sketch: more than {2**LG_CLIENTS} clients in a part of a group; make the sketches with more parts")).cast("long")
    return F.coalesce(F.when(n > 2**LG_CLIENTS, told).otherwise(n), F.lit(0))


def counted(sketches: DataFrame) -> DataFrame:
    """deployments, clients (their number) and contacts per client of each group."""
    by = [c for c in sketches.columns if c not in ("_part", "deployments", "clients")]
    rows = sketches.groupBy(*by).agg(F.sum("deployments").alias("deployments"), F.sum(size(F.col("clients"))).alias("clients"))
    return rows.withColumn("per_client", F.round(F.try_divide(F.col("deployments").cast("double"), F.col("clients").cast("double")), 6))


def overlap(sketches: DataFrame, column: str, a: str, b: str) -> DataFrame:
    """One row: clients of two values of a column, of both, and their shares (%)."""
    whole = rolled_up(sketches.where(F.col(column).isin(a, b)), column)
    pair = whole.groupBy("_part").agg(*[F.any_value(F.when(F.col(column) == v, F.col("clients")), True).alias(n) for n, v in (("a", a), ("b", b))])
    each = pair.select(size(F.col("a")).alias("a"), size(F.col("b")).alias("b"), size(F.theta_intersection("a", "b")).alias("both"))
    rows = each.agg(*[F.coalesce(F.sum(c), F.lit(0)).alias(n) for c, n in (("a", "a_clients"), ("b", "b_clients"), ("both", "both"))])
    return rows.withColumns({f"pct_of_{x}": F.expr(f"round({S.rate('both', f'{x}_clients')}, 6)") for x in "ab"})


def contact_sketches(df: DataFrame, *by: str) -> DataFrame:
    """by, contacts (a sketch of the contacts per client), clients and most of each group; a client has to stand in one group for a roll-up to hold."""
    per = df.groupBy(*by, "client_id").agg(F.count("*").alias("n"))
    return per.groupBy(*by).agg(F.kll_sketch_agg_bigint("n", K).alias("contacts"), F.count("*").alias("clients"), F.max("n").alias("most"))


def percentiles(sketches: DataFrame, *by: str, ranks: tuple[float, ...] = (0.5, 0.9)) -> DataFrame:
    """by, clients, most and p50, p90, ... of the contacts per client, from merged sketches."""
    rows = sketches.groupBy(*by).agg(F.sum("clients").alias("clients"), F.max("most").alias("most"), F.kll_merge_agg_bigint("contacts", K).alias("c"))
    return rows.select(*by, "clients", "most", *[F.kll_sketch_get_quantile_bigint("c", F.lit(x)).cast("long").alias(f"p{round(100 * x)}") for x in ranks])
