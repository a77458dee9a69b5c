"""What counts as a card, a purchase or a wallet provisioning: parameterised filters of the raw records."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from liftworks.functions import columns as C

#: Fixed values: (transaction type, message type) of purchases, statuses of live cards, the debit service.
PURCHASES, STATUSES, SERVICE = ((10, "0210"), (13, "0210"), (12, "0220")), ("06", "08"), 36
#: The card prefixes of wallet provisioning.
CARD, VISA = "45190", "45199"
#: Days before a deployment's start from which the warehouse's wallet flags count.
LOOK_BACK = 30


def purchases(log: DataFrame, pairs: tuple = PURCHASES, types: tuple = (), service: int | None = SERVICE) -> DataFrame:
    """client_id, success_dt of qualified purchases, one per client and day: amount over 0, the service (any if None), and one of the
    (type, message) pairs, or one of the types whatever the message (the warehouse's variant)."""
    hits = [(F.col("txn_type") == t) & (F.col("message") == m) for t, m in pairs] if not types else [F.col("txn_type").isin(*types)]
    rows = log.where(reduce(lambda a, b: a | b, hits) & (F.col("amount") > 0))
    if service is not None:
        rows = rows.where(F.col("service") == service)
    return rows.select(C.card_client("card_no").alias("client_id"), F.col("txn_dt").alias("success_dt")).distinct()


def cards(table: DataFrame, statuses: tuple = STATUSES, service: int = SERVICE) -> DataFrame:
    """Live cards of the service that have an issue date."""
    return table.where(F.col("status").isin(*statuses) & (F.col("service") == service) & F.col("issued").isNotNull())


def card_events(table: DataFrame) -> DataFrame:
    """client_id, metric, success_dt: issue dates are acquisitions, activation dates activations, one per client and day."""
    both = F.array(F.struct(F.lit("acquisition").alias("metric"), F.col("issued").alias("success_dt")), F.struct(F.lit("activation").alias("metric"), F.col("activated").alias("success_dt")))
    return cards(table).select("client_id", F.explode(both).alias("x")).select("client_id", "x.*").where("success_dt IS NOT NULL").distinct()


def _wallet(log: DataFrame, tokens: DataFrame, variant: str, merchant: str) -> DataFrame:
    """Wallet records of a variant. strict: both prefixes, a wallet's requestor, the merchant, an approval; broad: without the last two;
    warehouse: either prefix on the visa number, an approval, any merchant and any card prefix."""
    rows = log.where((F.col("amount") == 0) & (F.col("service") == SERVICE) & (F.col("entry_mode") == "000"))
    if variant == "warehouse":
        rows = rows.where(F.substring("visa_no", 1, 5).isin(CARD, VISA) & F.col("approval").isNotNull())
    else:
        rows = rows.where((F.substring("card_no", 1, 5) == CARD) & (F.substring("visa_no", 1, 5) == VISA) & (F.substring("requestor", 1, 1) > "0"))
    if variant == "strict":
        rows = rows.where((F.col("merchant") == merchant) & F.col("approval").isNotNull())
    return rows.join(tokens.where("wallet = 'Y'").select("requestor").distinct(), "requestor", "left_semi")


def wallet_events(log: DataFrame, tokens: DataFrame, variant: str = "strict", floor: str | None = None, merchant: str = "Provisioning") -> DataFrame:
    """client_id, success_dt of wallet provisionings by a variant (strict, broad, warehouse), from a day on, one per client and day."""
    if variant not in ("strict", "broad", "warehouse"):
        raise ValueError(f"no such variant: {variant}")
    rows = _wallet(log, tokens, variant, merchant)
    if floor:
        rows = rows.where(F.col("txn_dt") >= F.lit(floor).cast("date"))
    return rows.select(C.card_client("card_no").alias("client_id"), F.col("txn_dt").alias("success_dt")).distinct()


def wallet_flags(population: DataFrame, log: DataFrame, tokens: DataFrame, look_back: int = LOOK_BACK, merchant: str = "Provisioning") -> DataFrame:
    """decision_id and, for three readings of success side by side, a flag (0/1) and the first day from look_back days before the start to
    the end: by_merchant (merchant and approval), by_token (a wallet's requestor), any_token (any record of the card prefixes). One join for all."""
    rows = log.where((F.col("amount") == 0) & (F.col("service") == SERVICE) & (F.col("entry_mode") == "000") & (F.substring("card_no", 1, 5) == CARD) & (F.substring("visa_no", 1, 5) == VISA) & (F.substring("requestor", 1, 1) > "0"))
    listed = tokens.where("wallet = 'Y'").select("requestor", F.lit(True).alias("listed")).distinct()
    rows = rows.join(listed, "requestor", "left").select(C.card_client("card_no").alias("client_id"), "txn_dt", "listed", "merchant", "approval").alias("e")
    d = population.select("decision_id", "client_id", "start_dt", "end_dt").alias("d")
    hit = d.join(rows, (F.col("d.client_id") == F.col("e.client_id")) & (F.col("e.txn_dt") >= F.date_sub("d.start_dt", look_back)) & (F.col("e.txn_dt") <= F.col("d.end_dt")))
    kinds = {"by_merchant": F.col("listed") & (F.col("merchant") == merchant) & F.col("approval").isNotNull(), "by_token": F.col("listed"), "any_token": F.lit(True)}
    first = hit.groupBy("decision_id").agg(*[F.min(F.when(c, F.col("txn_dt"))).alias(f"{n}_dt") for n, c in kinds.items()])
    out = population.select("decision_id").join(first, "decision_id", "left")
    return out.withColumns({n: F.col(f"{n}_dt").isNotNull().cast("int") for n in kinds})
