"""Evaluation of scored transactions, and running profiles of a service."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def confusion(scored: DataFrame, flagged: str = "flagged", fraud: str = "fraud") -> DataFrame:
    """One row: tp, tn, fp, fn, errors; a null prediction is an error."""
    p, y = F.col(flagged), F.col(fraud) == 1
    return scored.agg(F.count_if(p & y).alias("tp"), F.count_if(~p & ~y).alias("tn"), F.count_if(p & ~y).alias("fp"), F.count_if(~p & y).alias("fn"), F.count_if(p.isNull()).alias("errors"))


def weighted_error(counts: DataFrame) -> DataFrame:
    """A false alarm weighs 1, a missed fraud 3, an error 5; over 15 % of failures is past the cutoff."""
    total = F.col("tp") + F.col("tn") + F.col("fp") + F.col("fn") + F.col("errors")
    failed = F.col("fp") + F.col("fn") + F.col("errors")
    return counts.select((F.col("fp") + 3 * F.col("fn") + 5 * F.col("errors")).alias("weighted"), (failed / total).alias("failure_rate"), (failed > 0.15 * total).alias("past_cutoff"))


def latency_score(p99_ms: Column) -> Column:
    """1000 for each tenfold under a second: at most 3000, and -3000 beyond two seconds."""
    return F.when(p99_ms > 2000, F.lit(-3000.0)).otherwise(F.least(F.lit(3000.0), 1000 * F.log10(1000 / F.greatest(p99_ms, F.lit(1.0)))))


def p99(rows: DataFrame, latency: str = "latency_ms") -> DataFrame:
    return rows.agg(F.percentile(latency, 0.99).alias("p99_ms")).withColumn("p99_score", latency_score(F.col("p99_ms")))


def running_profile(requests: DataFrame, every: int) -> DataFrame:
    """(requests, avg_parse, avg_search, avg_write) after each ``every`` requests, from (seq, parse, search, write); seq counts from 1.

    Requests are summed in groups first, so the running sum has one row a group.
    """
    group = F.expr(f"(seq - 1) div {every}")
    sums = requests.groupBy(group.alias("g")).agg(F.count("*").alias("n"), *[F.sum(c).alias(c) for c in ("parse", "search", "write")]).where(F.col("n") == every)
    w = Window.orderBy("g").rowsBetween(Window.unboundedPreceding, 0)
    total = F.sum("n").over(w)
    return sums.select(total.alias("requests"), *[(F.sum(c).over(w) / total).alias(f"avg_{c}") for c in ("parse", "search", "write")])


def readiness(vectors: DataFrame, clusters: DataFrame | None = None) -> DataFrame:
    out = vectors.agg(F.count("*").alias("vectors"))
    if clusters is not None:
        out = out.join(clusters.agg(F.count("*").alias("clusters")))
    return out.withColumn("ready", F.col("vectors") > 0)
