"""Resolution of cited designations against a register, coverage, and dead citations."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.designation import citation_digits, is_base

STEPS = ("exact", "is_base_fallback", "number_fallback")


def first_by(df: DataFrame, key: str, *order: Column) -> DataFrame:
    """One row of each key: the first by the given order. Rows without key are left out."""
    w = Window.partitionBy(key).orderBy(*order)
    return df.where(F.col(key).isNotNull() & (F.col(key) != "")).withColumn("_n", F.row_number().over(w)).where("_n = 1").drop("_n")


def resolve(citations: DataFrame, register: DataFrame, carry: list[str], citation: str = "citation") -> DataFrame:
    """citations with hit (the register's is_number), matched_by and the carried register columns; null where unresolved.

    register has is_number, is_base, is_digits and load_ord. Steps: exact number; base, first in load order; bare number,
    first by number. Distinct spellings are resolved once and joined back, so a popular citation costs one lookup.
    """
    cols = ["is_number", *[c for c in carry if c != "is_number"]]
    dims = [
        first_by(register, "is_number", F.col("load_ord")).withColumn("_key", F.col("is_number")),
        first_by(register, "is_base", F.col("load_ord")).withColumn("_key", F.col("is_base")),
        first_by(register, "is_digits", F.col("is_number"), F.col("load_ord")).withColumn("_key", F.col("is_digits")),
    ]
    c = F.col("_citation")
    known = citations.select(F.col(citation).alias("_citation")).where(c.isNotNull()).distinct()
    known = known.select(c, c.alias("_k0"), is_base(c).alias("_k1"), citation_digits(c).alias("_k2"))
    for i, d in enumerate(dims):
        known = known.join(d.select(F.col("_key").alias(f"_k{i}"), F.struct(*cols).alias(f"_r{i}")), f"_k{i}", "left")
    row = F.coalesce("_r0", "_r1", "_r2")
    how = F.when(F.col("_r0").isNotNull(), STEPS[0]).when(F.col("_r1").isNotNull(), STEPS[1]).when(F.col("_r2").isNotNull(), STEPS[2])
    known = known.select(c.alias(citation), row["is_number"].alias("hit"), how.alias("matched_by"), *[row[x].alias(x) for x in cols[1:]])
    return citations.join(known, citation, "left")


def missing(wanted: DataFrame, register: DataFrame, citation: str = "citation") -> DataFrame:
    """Rows of wanted that the register holds under none of the three keys."""
    keys = wanted.withColumns({"_b": is_base(F.col(citation)), "_d": citation_digits(F.col(citation))})
    held = register.select("is_number", "is_base", "is_digits")
    keys = keys.join(held, keys[citation] == held.is_number, "left_anti")
    keys = keys.join(held.select("is_base").distinct(), F.col("_b") == F.col("is_base"), "left_anti")
    return keys.join(held.select("is_digits").where("is_digits <> ''").distinct(), F.col("_d") == F.col("is_digits"), "left_anti").drop("_b", "_d")


def coverage_stats(citations: DataFrame, register: DataFrame, citation: str = "citation") -> DataFrame:
    """One row: distinct cited designations, how many the register holds, and the share in per cent."""
    cited = resolve(citations.select(citation).where(F.col(citation).isNotNull()).distinct(), register, [], citation)
    n, held = F.count(F.lit(1)), F.count("hit")
    return cited.agg(n.alias("distinct_cited"), held.alias("matched"), F.round(100.0 * held / n, 6).alias("coverage_pct"))


def backlog(citations: DataFrame, register: DataFrame, doc_id: str = "doc_id", citation: str = "citation") -> DataFrame:
    """Unheld bases by demand: (is_number, documents)."""
    gaps = missing(citations.select(doc_id, citation).distinct(), register, citation)
    return gaps.groupBy(is_base(F.col(citation)).alias("is_number")).agg(F.countDistinct(doc_id).alias("documents"))


def dead_bases(register: DataFrame) -> DataFrame:
    """Bases with a withdrawn or superseded part and no current one."""
    dead = register.where(F.col("status").isin("Withdrawn", "Superseded")).select("is_base").distinct()
    return dead.join(register.where("status = 'Current'").select("is_base").distinct(), "is_base", "left_anti")


def dead_citations(citations: DataFrame, register: DataFrame, citation: str = "citation") -> DataFrame:
    """Citations whose base is dead, with is_base."""
    return citations.withColumn("is_base", is_base(F.col(citation))).join(dead_bases(register), "is_base", "left_semi")


def check_dead(citations: DataFrame, register: DataFrame, citation: str = "citation") -> DataFrame:
    """For each citation found, dead (by the resolved row's status), status and replaced_by (UNKNOWN if the register names none)."""
    r = resolve(citations, register, ["status", "replaced_by"], citation)
    dead = F.coalesce(F.col("status").isin("Withdrawn", "Superseded"), F.lit(False))
    return r.withColumns({"found": F.col("hit").isNotNull(), "dead": dead, "replaced_by": F.when(dead, F.coalesce("replaced_by", F.lit("UNKNOWN")))})


def certification(citations: DataFrame, rules: DataFrame, citation: str = "citation") -> DataFrame:
    """citations with the rule that applies (exact number, else base): rule and mandatory; null where no rule."""
    exact = first_by(rules, "is_number", F.col("load_ord")).select(F.col("is_number").alias(citation), F.struct("is_number", "mandatory").alias("_x"))
    base = first_by(rules, "is_base", F.col("load_ord")).select(F.col("is_base").alias("_b"), F.struct("is_number", "mandatory").alias("_y"))
    c = citations.withColumn("_b", is_base(F.col(citation))).join(exact, citation, "left").join(base, "_b", "left")
    rule = F.coalesce("_x", "_y")
    return c.withColumns({"rule": rule["is_number"], "mandatory": rule["mandatory"]}).drop("_b", "_x", "_y")
