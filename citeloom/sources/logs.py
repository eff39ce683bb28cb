"""Run logs and decision logs."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

DECISIONS = ("accepted", "rejected", "overridden")


def latest_stage(runs: DataFrame, stage: str, order: str = "load_ord") -> DataFrame:
    """The newest run's result of a stage, from runs with results array<struct<stage, outcome, ...>>."""
    each = runs.select(order, F.explode("results").alias("r")).where(F.col("r.stage") == stage)
    return each.agg(F.max_by("r", order).alias("r")).where("r IS NOT NULL").select("r.*")


def valid_decision(df: DataFrame) -> DataFrame:
    """df with problem: an unknown verb, or a rejection or override without rationale; null if the decision may be stored."""
    needs = F.col("decision").isin("rejected", "overridden") & (F.trim(F.coalesce("rationale", F.lit(""))) == "")
    return df.withColumn("problem", F.when(~F.coalesce(F.col("decision").isin(*DECISIONS), F.lit(False)), "unknown decision").when(needs, "rationale required"))


def append_decisions(df: DataFrame, path: str) -> DataFrame:
    """Append the valid decisions to the log; returns the refused ones."""
    checked = valid_decision(df)
    checked.where("problem IS NULL").drop("problem").write.mode("append").json(path)
    return checked.where("problem IS NOT NULL")


def agreement(log: DataFrame) -> DataFrame:
    """One row: decisions by verb and the share accepted, in per cent; null for an empty log."""
    n = F.count(F.lit(1))
    counts = [F.count_if(F.col("decision") == d).alias(d) for d in DECISIONS]
    return log.agg(n.alias("total"), *counts, F.round(F.try_divide(100.0 * F.count_if(F.col("decision") == "accepted"), n), 6).alias("agreement_pct"))
