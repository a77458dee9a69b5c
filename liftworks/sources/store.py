"""Campaign tables kept for further work: laid out by client in buckets, or by month and brought forward by new events."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from liftworks.operators import population
from liftworks.sources import readers, scratch
from liftworks.sources.scratch import staged, temporaries

#: Buckets of a kept table: tables that are joined need the same number, and a bucket of the largest has to fit a task.
BUCKETS = 64
#: The column by which month tables are partitioned.
MONTH = "cohort"


def save_by_client(df: DataFrame, table: str, path: str, buckets: int = BUCKETS, order: tuple[str, ...] = ()) -> DataFrame:
    """Overwrite a table bucketed by client_id, a file for each bucket. Joins and windows that begin with the client need no shuffle of it."""
    rows = df.repartition(buckets, "client_id")
    rows.write.mode("overwrite").format("parquet").option("path", path).bucketBy(buckets, "client_id").sortBy("client_id", *order).saveAsTable(table)
    return df.sparkSession.table(table)


def open_by_client(spark: SparkSession, table: str, path: str, columns: str, buckets: int = BUCKETS) -> DataFrame:
    """The table that another session saved: its columns (as DDL) and buckets have to be those that it was saved with."""
    spark.sql(f"CREATE TABLE IF NOT EXISTS {table} ({columns}) USING parquet CLUSTERED BY (client_id) INTO {buckets} BUCKETS LOCATION '{path}'")
    return spark.table(table)


def staged_by_client(df: DataFrame, buckets: int | None = None) -> DataFrame:
    """A bucketed table among the temporary ones: gone, from the catalog too, with the block that it was made in."""
    spark = df.sparkSession
    name = f"staged_{uuid.uuid4().hex}"
    path = scratch.claimed(spark, table=name)
    return save_by_client(df, name, path, buckets or int(spark.conf.get("spark.sql.shuffle.partitions")))


def by_month(df: DataFrame, path: str, months: str = MONTH) -> None:
    """Overwrite the months that the rows have, and no other one; a month too large for one task is written by several."""
    df.hint("rebalance", months).write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(months).parquet(path)


def open_by_month(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """The table with its columns in order; a typed empty one where nothing was saved yet."""
    return readers.read_or_empty(spark, path, schema, typed=True).select(*spark.createDataFrame([], schema).columns)


def advance(root: str, fresh: DataFrame, news: DataFrame, events: DataFrame) -> list[str]:
    """Bring the attributed deployments at `root`, by month, forward: `fresh` deployments join them, and `news` (events not seen before)
    change the first success of older ones. `events` are all events, the news among them. Gives the months written, in order.

    A new event can only bring a first success forward, so older deployments need the news alone: those in whose window a new day lies
    before their success. They are looked for in the months that the longest window reaches back to; of these, the months in which a
    deployment changed or joins are written anew, all others stay untouched. As many runs as one likes give what one over everything gives.

    Events move only where a window can hold them: for the fresh deployments those from their first start to their last end, of the news
    those up to the last end of an older one. Frames that are costly to make are best staged before: they are asked for these days first."""
    spark = fresh.sparkSession
    with temporaries():
        first, last = fresh.agg(F.min("start_dt"), F.max("end_dt")).first()
        joined = staged(population.attributed(fresh, events.where(F.col("success_dt").between(F.lit(first).cast("date"), F.lit(last).cast("date")))))
        schema = ", ".join(f"`{c}` {t}" for c, t in joined.dtypes)
        now = open_by_month(spark, root, schema)
        lo, hi = news.agg(F.min("success_dt"), F.max("success_dt")).first()
        changed = None
        if lo is not None:
            longest, last = now.agg(F.max(F.datediff("end_dt", "start_dt")), F.max("end_dt")).first()
            reach = now.where(F.col(MONTH).between(F.date_format(F.date_sub(F.lit(lo), longest or 0), "yyyy-MM"), F.date_format(F.lit(hi), "yyyy-MM")))
            d = reach.withColumn("metric", F.expr(population.campaign_metrics())).alias("d")
            e = news.where(F.col("success_dt") <= F.lit(last).cast("date")).alias("e")
            met = (F.col("d.client_id") == F.col("e.client_id")) & (F.col("d.metric") == F.col("e.metric")) & F.col("e.success_dt").between(F.col("d.start_dt"), F.col("d.end_dt"))
            earlier = F.col("d.success_dt").isNull() | (F.col("e.success_dt") < F.col("d.success_dt"))
            changed = staged(d.join(e, met & earlier).groupBy("d.decision_id", f"d.{MONTH}").agg(F.min("e.success_dt").alias("_new")))
        touched = joined.select(MONTH) if changed is None else joined.select(MONTH).unionByName(changed.select(MONTH))
        months = sorted(r[0] for r in touched.distinct().collect())  # a row per month
        if months:
            rows = now.where(F.col(MONTH).isin(*months))
            if changed is not None:
                rows = rows.join(changed.drop(MONTH), "decision_id", "left").withColumn("success_dt", F.coalesce("_new", "success_dt"))
                rows = rows.withColumn("success", F.col("success_dt").isNotNull().cast("int")).drop("_new")
            by_month(staged(rows.select(joined.columns)).unionByName(joined), root)  # older rows are written aside first: what is read is overwritten
    return months
