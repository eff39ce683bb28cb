"""Evaluation of rankings: recall, precision, abstention, calibration, paired significance, confusion."""

from __future__ import annotations

import math
import resource
import time
from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.designation import citation_digits, is_base


def retrieval_metrics(results: DataFrame, relevant: Column, k: int = 10, queries: DataFrame | None = None) -> DataFrame:
    """One row over results (query_id, rank, ...): queries, recall at 1 and k, mean precision at 5."""
    q = results.withColumn("ok", F.coalesce(relevant, F.lit(False))).groupBy("query_id").agg(
        F.max(F.when((F.col("rank") == 1) & F.col("ok"), 1).otherwise(0)).alias("r1"),
        F.max(F.when((F.col("rank") <= k) & F.col("ok"), 1).otherwise(0)).alias("rk"),
        F.sum(F.when((F.col("rank") <= 5) & F.col("ok"), 1).otherwise(0)).alias("p5"),
    )
    if queries is not None:
        q = queries.select("query_id").distinct().join(q, "query_id", "left").fillna(0)
    n = F.count(F.lit(1))
    return q.agg(n.alias("queries"), F.sum("r1").alias("rank_1"), F.sum("rk").alias("recall_hits"), F.round(F.sum("r1") / n, 6).alias("recall_at_1"), F.round(F.sum("rk") / n, 6).alias("recall_at_k"), F.round(F.sum("p5") / (5.0 * n), 6).alias("precision_at_5"))


def calibration(scored: DataFrame, score: str = "score", correct: str = "correct") -> DataFrame:
    """(bucket, n, correct, accuracy) in tenths of the score; 1.0 falls into the last."""
    b = F.least(F.floor(F.col(score) * 10), F.lit(9)).cast("int")
    g = scored.groupBy(b.alias("bucket")).agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col(correct)).alias("correct"))
    return g.withColumn("accuracy", F.round(F.col("correct") / F.col("n"), 6))


def calibration_error(buckets: DataFrame) -> DataFrame:
    """One row: expected calibration error, the weighted distance of each bucket's accuracy from its middle."""
    miss = F.abs(F.col("correct") / F.col("n") - (F.col("bucket") / 10.0 + 0.05))
    return buckets.agg(F.sum("n").alias("n"), F.round(F.sum(F.col("n") * miss) / F.sum("n"), 6).alias("ece"))


def mcnemar(a: DataFrame, b: DataFrame) -> DataFrame:
    """One row over two tables (query_id, correct): both, only_a, only_b, neither."""
    j = a.select("query_id", F.col("correct").alias("x")).join(b.select("query_id", F.col("correct").alias("y")), "query_id")
    x, y = F.col("x"), F.col("y")
    return j.agg(F.count_if(x & y).alias("both"), F.count_if(x & ~y).alias("only_a"), F.count_if(~x & y).alias("only_b"), F.count_if(~x & ~y).alias("neither"))


def mcnemar_p(only_a: int, only_b: int) -> float:
    """Exact two-sided p of the discordant counts."""
    n = only_a + only_b
    return min(1.0, 2 * sum(math.comb(n, i) for i in range(min(only_a, only_b) + 1)) / 2**n) if n else 1.0


def confusion(truth: DataFrame, truth_col: str = "truth", said_col: str = "said") -> DataFrame:
    """One row: tp, fp, fn, tn, accuracy."""
    t, s = F.col(truth_col), F.col(said_col)
    tp, fp, fn, tn = F.count_if(t & s), F.count_if(~t & s), F.count_if(t & ~s), F.count_if(~t & ~s)
    return truth.agg(tp.alias("tp"), fp.alias("fp"), fn.alias("fn"), tn.alias("tn"), F.round(F.try_divide((tp + tn).cast("double"), F.count(F.lit(1))), 6).alias("accuracy"))


def abstention_table(a: DataFrame, b: DataFrame) -> DataFrame:
    """What strategy b (query_id, decision, correct) does where strategy a abstains: (b_abstains, b_right, b_wrong)."""
    j = a.where("decision = 'abstain'").select("query_id").join(b, "query_id")
    ab = F.col("decision") == "abstain"
    return j.agg(F.count_if(ab).alias("b_abstains"), F.count_if(~ab & F.col("correct")).alias("b_right"), F.count_if(~ab & ~F.col("correct")).alias("b_wrong"))


def leaderboard(registry: DataFrame, measured: DataFrame) -> DataFrame:
    """Every registered strategy with its figures; unmeasured ones stay, marked so."""
    return registry.join(measured, "strategy", "left").withColumn("measured", F.col("queries").isNotNull())


def same_standard(a: Column, b: Column) -> Column:
    """Whether two designations name one standard: equal bases, or equal bare numbers, of however many digits."""
    digits = citation_digits(a, None)
    return (F.upper(is_base(a)) == F.upper(is_base(b))) | ((digits != "") & (digits == citation_digits(b, None)))


def rank_1_by(outcomes: DataFrame, key: str, least: int = 8) -> DataFrame:
    """(key, queries, rank_1, accuracy) over outcomes (query_id, key, r1 boolean), for keys with `least` queries or more."""
    g = outcomes.groupBy(key).agg(F.count(F.lit(1)).alias("queries"), F.count_if("r1").alias("rank_1")).where(F.col("queries") >= least)
    return g.withColumn("accuracy", F.round(F.col("rank_1") / F.col("queries"), 6))


def abstention(decisions: DataFrame) -> DataFrame:
    """One row over decisions (query_id, decision, correct): queries, abstained, answered, right among the answered, and the shares."""
    n, off = F.count(F.lit(1)), F.count_if(F.col("decision") == "abstain")
    right = F.count_if((F.col("decision") != "abstain") & F.coalesce("correct", F.lit(False)))
    return decisions.agg(n.alias("queries"), off.alias("abstained"), (n - off).alias("answered"), right.alias("right"), F.round(F.try_divide(off.cast("double"), n), 6).alias("abstention_rate"), F.round(F.try_divide(right.cast("double"), n - off), 6).alias("precision"))


def flagged_sample(flags: DataFrame, negatives: int = 20, seed: int = 11, key: str = "doc_id") -> DataFrame:
    """All rows flagged true, and `negatives` of the others: those of the least hash of seed and key, so reruns agree."""
    off = flags.where(~F.col("truth")).withColumn("_h", F.md5(F.concat_ws(":", F.lit(str(seed)), F.col(key).cast("string"))))
    return flags.where("truth").unionByName(off.orderBy("_h", key).limit(negatives).drop("_h"))


def abstention_cross(a: DataFrame, b: DataFrame, listed: DataFrame) -> DataFrame:
    """What strategy b (query_id, decision, correct) does where a abstains, and how often the right answer is in its list
    (listed: query_id): (abstentions, b_abstains, b_right, b_wrong, in_list)."""
    off = a.where("decision = 'abstain'").select("query_id").distinct()
    j = off.join(b, "query_id", "left").join(listed.select("query_id").distinct().withColumn("_l", F.lit(True)), "query_id", "left")
    ab, ok = F.col("decision") == "abstain", F.coalesce("correct", F.lit(False))
    return j.agg(F.count(F.lit(1)).alias("abstentions"), F.count_if(ab).alias("b_abstains"), F.count_if(~ab & ok).alias("b_right"), F.count_if(~ab & ~ok).alias("b_wrong"), F.count("_l").alias("in_list"))


def timed(build: Callable[[], DataFrame], queries: int) -> dict[str, float]:
    """Seconds that a strategy's result takes, in all and for each query, and the driver's peak memory in MB."""
    began = time.perf_counter()
    rows = build().count()
    took = time.perf_counter() - began
    return {"rows": rows, "seconds": round(took, 3), "ms_a_query": round(1000 * took / max(queries, 1), 3), "driver_peak_mb": round(resource.getrusage(resource.RUSAGE_SELF).ru_maxrss / 1024, 1)}
