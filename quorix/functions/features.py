"""The fourteen features of a transaction payload, and whether the payload is valid."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quorix.functions.scalar import category_code, clamp01, f32, iso_hour, iso_weekday, lit32, minutes_between, portion

WIDTH = 14
NAMES = [f"f{i}" for i in range(WIDTH)]
#: Features that are shares, clamped to 0..1, and those of the last transaction: -1 without one.
SHARES, LAST = (0, 1, 2, 3, 4, 5, 6, 7, 8, 13), (5, 6)
UNKNOWN_RISK = 0.5
#: Risks of the categories that are known without a file.
DEFAULT_RISKS = {
    "5411": 0.15, "5812": 0.30, "5912": 0.20, "5944": 0.45, "7801": 0.80,
    "7802": 0.75, "7995": 0.85, "4511": 0.35, "5311": 0.25, "5999": 0.50,
}

def _struct(**fields: T.DataType) -> T.StructType:
    return T.StructType([T.StructField(k, v) for k, v in fields.items()])


_FLOAT, _TEXT, _FLAG = T.FloatType(), T.StringType(), T.BooleanType()
PAYLOAD = _struct(
    id=_TEXT,
    transaction=_struct(amount=_FLOAT, installments=_FLOAT, requested_at=_TEXT),
    customer=_struct(avg_amount=_FLOAT, tx_count_24h=_FLOAT, known_merchants=T.ArrayType(_TEXT)),
    merchant=_struct(id=_TEXT, mcc=_TEXT, avg_amount=_FLOAT),
    terminal=_struct(is_online=_FLAG, card_present=_FLAG, km_from_home=_FLOAT),
    last_transaction=_struct(timestamp=_TEXT, km_from_current=_FLOAT),
)
_REQUIRED = ["transaction.amount", "transaction.installments", "customer.avg_amount", "customer.tx_count_24h", "merchant.id", "merchant.mcc", "merchant.avg_amount", "terminal.is_online", "terminal.card_present", "terminal.km_from_home"]
_NUMBERS = ["transaction.amount", "transaction.installments", "customer.avg_amount", "customer.tx_count_24h", "merchant.avg_amount", "terminal.km_from_home"]


def is_valid() -> Column:
    """All required fields there and finite, times of 19 characters or more; a last transaction is whole or absent."""
    ok = F.coalesce(F.length("transaction.requested_at") >= 19, F.lit(False))
    for name in _REQUIRED:
        ok = ok & F.col(name).isNotNull()
    for name in _NUMBERS:
        ok = ok & ~F.coalesce(F.abs(F.col(name)) == F.lit(float("inf")), F.lit(False)) & ~F.coalesce(F.isnan(name), F.lit(False))
    last = F.coalesce(F.length("last_transaction.timestamp") >= 19, F.lit(False)) & F.col("last_transaction.km_from_current").isNotNull()
    return ok & (F.col("last_transaction").isNull() | last)


def unknown_merchant() -> Column:
    return F.when(F.coalesce(F.exists("customer.known_merchants", lambda known: known == F.col("merchant.id")), F.lit(False)), lit32(0)).otherwise(lit32(1))


def with_risk(payloads: DataFrame, risks: DataFrame) -> DataFrame:
    """payloads with mcc_risk, joined on the category code; risks (mcc_code, risk) has at most 10,000 rows."""
    table = risks.select(F.col("mcc_code").alias("_code"), f32(F.col("risk")).alias("_risk"))
    return payloads.join(F.broadcast(table), category_code(F.col("merchant.mcc")) == F.col("_code"), "left").withColumn("mcc_risk", F.coalesce("_risk", lit32(UNKNOWN_RISK))).drop("_code", "_risk")


def raw() -> list[Column]:
    """What f0 to f13 of a payload with mcc_risk are before they are clamped; null for a last transaction that isn't there."""
    c = F.col
    amount, average = c("transaction.amount"), c("customer.avg_amount")
    return [
        portion(amount, 10_000),
        portion(c("transaction.installments"), 12),
        F.when(average > 0, portion(amount / average, 10)).otherwise(lit32(1)),
        portion(iso_hour(c("transaction.requested_at")), 23),
        portion(iso_weekday(c("transaction.requested_at")), 6),
        portion(minutes_between(c("transaction.requested_at"), c("last_transaction.timestamp")), 1440),
        portion(c("last_transaction.km_from_current"), 1000),
        portion(c("terminal.km_from_home"), 1000),
        portion(c("customer.tx_count_24h"), 20),
        F.when(c("terminal.is_online"), lit32(1)).otherwise(lit32(0)),
        F.when(c("terminal.card_present"), lit32(1)).otherwise(lit32(0)),
        unknown_merchant(),
        c("mcc_risk"),
        portion(c("merchant.avg_amount"), 10_000),
    ]


def clamped() -> list[Column]:
    """f0 to f13 of their raw columns."""
    out = [clamp01(F.col(n)) if i in SHARES else F.col(n) for i, n in enumerate(NAMES)]
    for i in LAST:
        out[i] = F.when(F.col("_none"), lit32(-1)).otherwise(out[i])
    return out


def features(payloads: DataFrame, risks: DataFrame, keep: list[str]) -> DataFrame:
    """keep and f0 to f13.

    In two steps: an expression that is used twice in one would be computed twice.
    """
    rows = with_risk(payloads, risks).select(*keep, F.col("last_transaction").isNull().alias("_none"), *[e.alias(n) for e, n in zip(raw(), NAMES)])
    return rows.select(*keep, *[e.alias(n) for e, n in zip(clamped(), NAMES)])
