"""The test tables as campaign tables (raw decisions, outcome events, spend, e-mail feedback, profile snapshots)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from liftworks.config import case

#: Campaign code, window and channel by columns of the test tables.
CODES = {"1-URGENT": "ACQ", "2-HIGH": "SEA", "3-MEDIUM": "ACT", "4-NOT SPECIFIED": "USE", "5-LOW": "TOK"}
WINDOWS = {"1-URGENT": 30, "2-HIGH": 30, "3-MEDIUM": 90, "4-NOT SPECIFIED": 90, "5-LOW": 90}
CHANNELS = {"F": "EM", "O": "IM", "P": "EM_IM"}
PROFILE_CAP = "2001-06-30"
#: Clients whose snapshots one task makes: some 780,000 rows.
CLIENTS = 10_000


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def raw_decisions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Treatment decisions as they come: padded codes, zero-padded client ids."""
    start = F.to_date("o_orderdate")
    control = F.col("o_custkey") % 100 >= 90
    return table(spark, sf_dir, "orders").select(
        F.concat(F.date_format(start, "yyyyDDD"), F.expr(case("o_orderpriority", CODES))).alias("tactic_id"),
        F.concat(F.lpad(F.col("o_custkey").cast("string"), 12, "0"), F.lit(" ")).alias("event_id"),
        F.when(control, "TG7 ").otherwise("TG4 ").alias("group_code"),
        F.concat(F.lit("RG"), F.col("o_orderstatus"), F.lit("  ")).alias("report_code"),
        start.alias("start_dt"),
        F.date_add(start, F.expr(case("o_orderpriority", WINDOWS))).alias("end_dt"),
        F.when(control, "XX").otherwise(F.expr(case("o_orderstatus", CHANNELS))).alias("channel_code"),
        F.col("o_orderkey").alias("decision_id"),
    )


def _shipped(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_partkey", "l_returnflag", "l_shipdate", "l_extendedprice")
    orders = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("l_orderkey"), F.col("o_custkey").cast("string").alias("client_id"))
    return lines.join(orders, "l_orderkey")


def shipped(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines with their client, and whether their part is listed: what outcome events and spend are made from."""
    lookup = table(spark, sf_dir, "part").where("p_size <= 10").select(F.col("p_partkey").alias("l_partkey"), F.lit(True).alias("listed"))
    return _shipped(spark, sf_dir).join(lookup, "l_partkey", "left").select("client_id", "l_returnflag", "l_shipdate", "l_extendedprice", "listed")


def events_of(lines: DataFrame) -> DataFrame:
    """client_id, metric, success_dt of shipped lines: one row per client, metric and day."""
    own = F.expr(case("l_returnflag", {"R": "acquisition", "A": "activation", "N": "usage"}))
    metrics = F.when((F.col("l_returnflag") == "N") & F.col("listed"), F.array(own, F.lit("token"))).otherwise(F.array(own))
    return lines.select("client_id", F.explode(metrics).alias("metric"), F.to_date("l_shipdate").alias("success_dt")).dropDuplicates(["client_id", "metric", "success_dt"])


def spend_of(lines: DataFrame) -> DataFrame:
    return lines.select("client_id", F.to_date("l_shipdate").alias("txn_dt"), F.col("l_extendedprice").cast("decimal(18,2)").alias("amount"))


def outcome_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """client_id, metric, success_dt: one row per client, metric and day, from one pass over the lines."""
    return events_of(shipped(spark, sf_dir))


def transactions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spend_of(_shipped(spark, sf_dir))


def email_feedback(spark: SparkSession, sf_dir: str) -> DataFrame:
    """client_id, treatment (week), disposition 1 sent, 2 opened, 3 clicked, 4 unsubscribed, day."""
    codes = {"signup": 1, "view": 2, "click": 3, "error": 4}
    return table(spark, sf_dir, "events").select(
        F.col("user_id").cast("string").alias("client_id"), F.to_date(F.date_trunc("week", F.col("ts"))).alias("treatment"), F.expr(case("event_type", codes)).alias("disposition"), F.to_date("ts").alias("day")
    )


def profiles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Client snapshots by month-end, 1995-01 to the cap.

    A small file gives 78 rows for each of its own, so the clients are dealt out to tasks before their months are made: what a task holds does
    not grow with the table, and groupings that contain the client need no shuffle of the snapshots."""
    months = F.explode(F.sequence(F.lit("1995-01-01").cast("date"), F.lit("2001-06-01").cast("date"), F.expr("interval 1 month")))
    clients = table(spark, sf_dir, "customer").withColumn("client_id", F.col("c_custkey").cast("string"))
    return clients.repartition(clients.count() // CLIENTS + 1, "client_id").withColumn("month", months).select(
        "client_id",
        F.last_day("month").alias("month_end"),
        F.col("c_mktsegment").alias("segment"),
        F.col("c_acctbal").alias("income"),
        F.when(F.col("c_custkey") % 17 != 0, (18 + F.col("c_custkey") * 7 % 60).cast("int")).alias("age"),
        (F.col("c_custkey") % 15).cast("int").alias("tenure"),
    )


def deployment_feedback(spark: SparkSession, sf_dir: str) -> DataFrame:
    """E-mail feedback on deployments: an order's first four lines are its dispositions 1 to 4; client_id, treatment (tactic id), disposition, day."""
    lines = table(spark, sf_dir, "lineitem").where("l_linenumber <= 4").select("l_orderkey", F.col("l_linenumber").alias("disposition"), F.to_date("l_shipdate").alias("day"))
    orders = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("l_orderkey"), F.col("o_custkey").cast("string").alias("client_id"), F.concat(F.date_format("o_orderdate", "yyyyDDD"), F.expr(case("o_orderpriority", CODES))).alias("treatment"))
    return lines.join(orders, "l_orderkey").select("client_id", "treatment", "disposition", "day")


def purchase_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines as point-of-sale records: card_no (client from the 7th character on), service, txn_type, message, amount, txn_dt."""
    codes = lambda c, values: F.expr(case(c, values))
    lines = table(spark, sf_dir, "lineitem").select("l_orderkey", (F.col("l_linenumber") % 2 + 35).alias("service"), codes("l_returnflag", {"R": 10, "A": 12, "N": 13}).alias("txn_type"), codes("l_linestatus", {"O": "0210", "F": "0220"}).alias("message"), (F.col("l_quantity") - 5).cast("decimal(18,2)").alias("amount"), F.to_date("l_shipdate").alias("txn_dt"))
    orders = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("l_orderkey"), F.concat(F.lit("451900"), F.lpad(F.col("o_custkey").cast("string"), 9, "0"), F.lit("1")).alias("card_no"))
    return lines.join(orders, "l_orderkey").drop("l_orderkey")


def card_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders as cards: client_id, status, service, issued (null for every eleventh), activated (null for a third)."""
    day = F.to_date("o_orderdate")
    return table(spark, sf_dir, "orders").select(
        F.col("o_custkey").cast("string").alias("client_id"), F.expr(case("o_orderstatus", {"F": "06", "O": "08", "P": "01"})).alias("status"), (F.col("o_orderkey") % 3 + 35).cast("int").alias("service"),
        F.when(F.col("o_orderkey") % 11 != 0, day).alias("issued"), F.when(F.col("o_orderkey") % 3 != 0, F.date_add(day, 5)).alias("activated"),
    )


def wallet_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines as wallet records: card_no, visa_no, requestor (token), amount, service, entry_mode, merchant, approval, txn_dt."""
    lines = table(spark, sf_dir, "lineitem").select(
        "l_orderkey", F.concat(F.when(F.col("l_suppkey") % 3 == 0, "45190").when(F.col("l_suppkey") % 3 == 1, "45199").otherwise("40000"), F.lit("0000")).alias("visa_no"), F.concat((F.col("l_linenumber") - 1).cast("string"), F.lit("-"), F.col("l_partkey").cast("string")).alias("requestor"),
        F.when(F.col("l_quantity") > 40, 1).otherwise(0).alias("amount"), F.lit(36).alias("service"), F.when(F.col("l_returnflag") == "A", "010").otherwise("000").alias("entry_mode"), F.when(F.col("l_linestatus") == "O", "Provisioning").alias("merchant"), F.when(F.col("l_quantity") > 3, "ok").alias("approval"), F.to_date("l_shipdate").alias("txn_dt"),
    )
    orders = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("l_orderkey"), F.concat(F.when(F.col("o_orderkey") % 5 == 0, "45191").otherwise("45190"), F.lit("0"), F.lpad(F.col("o_custkey").cast("string"), 9, "0"), F.lit("1")).alias("card_no"))
    return lines.join(orders, "l_orderkey").drop("l_orderkey")


def token_list(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Requestors of wallets: requestor, wallet (Y or N)."""
    rows = table(spark, sf_dir, "part").select(F.explode(F.sequence(F.lit(0), F.lit(6))).alias("n"), "p_partkey", F.when(F.col("p_size") <= 20, "Y").otherwise("N").alias("wallet"))
    return rows.select(F.concat(F.col("n").cast("string"), F.lit("-"), F.col("p_partkey").cast("string")).alias("requestor"), "wallet")


def feedback_tables(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """The e-mail vendor's two tables, keyed by hashed client and treatment: master (with the client's number, padded) has a row per order,
    twice for every fifth, and one per user and week of `events`, whose treatments are no tactic of ours; event has their lines and events."""
    hashed = lambda c: F.md5(F.concat(F.lit("mail:"), F.col(c).cast("string")).cast("binary"))
    orders = table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey", F.concat(F.date_format("o_orderdate", "yyyyDDD"), F.expr(case("o_orderpriority", CODES))).alias("treatment"))
    weeks = table(spark, sf_dir, "events").select("user_id", F.date_format(F.date_trunc("week", "ts"), "yyyyDDD'WEB'").alias("treatment"), F.expr(case("event_type", {"signup": 1, "view": 2, "click": 3, "error": 4})).alias("disposition"), F.col("ts").cast("timestamp").alias("at"))
    twice = F.explode(F.sequence(F.lit(1), F.when(F.col("o_orderkey") % 5 == 0, 2).otherwise(1)))
    ours = orders.select(hashed("o_custkey").alias("hashed_id"), "treatment", F.concat(F.lpad(F.col("o_custkey").cast("string"), 12, "0"), F.lit(" ")).alias("client_no"), twice.alias("n")).drop("n")
    master = ours.unionByName(weeks.select(hashed("user_id").alias("hashed_id"), "treatment", F.lpad(F.col("user_id").cast("string"), 12, "0").alias("client_no")).distinct())
    lines = table(spark, sf_dir, "lineitem").where("l_linenumber <= 4").select(F.col("l_orderkey").alias("o_orderkey"), F.col("l_linenumber").alias("disposition"), F.col("l_shipdate").cast("timestamp").alias("at"))
    event = lines.join(orders, "o_orderkey").select(hashed("o_custkey").alias("hashed_id"), "treatment", "disposition", "at").unionByName(weeks.select(hashed("user_id").alias("hashed_id"), "treatment", "disposition", "at"))
    return master, event
