"""Corpus upkeep: reading documents, re-citing, mark scan, golden queries, grounding of rules, roles of neighbours, calibration lines."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.designation import extract_citations, is_base
from ..functions.text import ABBREVIATIONS, CAPITALS, PHRASES, demands_mark, role_of
from .lookup import dead_citations, missing, resolve
from .merge import majority


def cited(texts: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, pos, citation) of all texts."""
    return texts.select(doc_id, F.posexplode(extract_citations(F.col(text))).alias("pos", "c")).select(doc_id, "pos", "c.citation")


def reading_stats(texts: DataFrame, doc_id: str = "doc_id", text: str = "text", scanned: str = "scanned") -> DataFrame:
    """One row: documents read, scanned ones, distinct citations."""
    t = texts.withColumn("_c", F.transform(extract_citations(F.col(text)), lambda x: x["citation"]))
    n = t.agg(F.count(F.lit(1)).alias("documents"), F.count_if(scanned).alias("scanned"))
    return n.crossJoin(F.broadcast(t.select(F.explode("_c").alias("c")).agg(F.countDistinct("c").alias("distinct_citations"))))  # one row each


def mark_scan(texts: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, demands_mark): Yes or No over all attachments of a document, 'No attachment read' if none has text."""
    g = texts.groupBy(doc_id).agg(F.max(demands_mark(F.col(text))).alias("m"))
    return g.select(doc_id, F.when(F.col("m"), "Yes").when(~F.col("m"), "No").otherwise("No attachment read").alias("demands_mark"))


def recite(texts: DataFrame, register: DataFrame) -> DataFrame:
    """(doc_id, citations, family, outdated, unmatched, usability) extracted anew: the family by majority of the resolved
    citations, the first seen on ties; a document without any is Not extractable."""
    c = resolve(cited(texts), register, ["family"])
    family = majority(c.where("hit IS NOT NULL"), "doc_id", "family", "pos").select("doc_id", "family")
    dead = dead_citations(c.select("doc_id", "citation").distinct(), register).groupBy("doc_id").agg(F.array_sort(F.collect_set("citation")).alias("outdated"))
    lists = c.groupBy("doc_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("pos", "citation"))), lambda x: x["citation"]).alias("citations"), F.array_sort(F.collect_set(F.when(F.col("hit").isNull(), F.col("citation")))).alias("unmatched"))
    d = texts.select("doc_id").distinct()
    for part in (lists, family, dead):
        d = d.join(part, "doc_id", "left")
    return d.withColumn("usability", F.when(F.size(F.coalesce("citations", F.array())) > 0, "Usable").otherwise("Not extractable"))


def harvest(edges: DataFrame, register: DataFrame) -> DataFrame:
    """(citation): ends of edges that the register doesn't hold."""
    return missing(edges.select(F.explode(F.array("src", "dst")).alias("citation")).distinct(), register)


def orphan_rules(rules: DataFrame, register: DataFrame) -> DataFrame:
    """One row: rules, mandatory ones, and rules whose standard the register doesn't hold."""
    lost = missing(rules.select(F.col("is_number").alias("citation")), register).agg(F.count(F.lit(1)).alias("orphans"))
    return rules.agg(F.count(F.lit(1)).alias("rules"), F.count_if(F.col("mandatory") == "Yes").alias("mandatory")).crossJoin(F.broadcast(lost))  # one row each


def golden_queries(rules: DataFrame, register: DataFrame, shortest: int = 22) -> DataFrame:
    """(query, expected_is): product descriptions of held standards, at least `shortest` long, that don't repeat the title,
    each once. rules: is_number, is_base, product, load_ord."""
    held = register.select(F.explode(F.array("is_number", "is_base")).alias("_h")).where("_h IS NOT NULL").distinct()
    q = F.trim(F.regexp_replace("product", r"\s+", " "))
    r = rules.withColumn("query", q).where(F.length(q) >= shortest)
    r = r.join(held.withColumn("_x", F.lit(1)), F.col("is_number") == F.col("_h"), "left").drop("_h")
    r = r.join(held.withColumn("_y", F.lit(1)), F.col("is_base") == F.col("_h"), "left").where("_x IS NOT NULL OR _y IS NOT NULL")
    titles = register.groupBy("is_number").agg(F.min("title").alias("_t"))
    r = r.join(titles, "is_number", "left").where(~F.coalesce(F.lower(F.substring("query", 1, 40)) == F.lower(F.substring("_t", 1, 40)), F.lit(False)))
    return r.groupBy(F.lower("query").alias("_q")).agg(F.min_by(F.struct("query", "is_number"), "load_ord").alias("r")).select("r.query", F.col("r.is_number").alias("expected_is"))


def ungrounded_rules(titles: DataFrame, title: str = "title") -> DataFrame:
    """(added): expansions with a word that no title of the register has."""
    words = titles.select(F.explode(F.regexp_extract_all(F.lower(title), F.lit("[a-z0-9-]+"), F.lit(0))).alias("w")).distinct()
    added = sorted({*ABBREVIATIONS.values(), *CAPITALS.values(), *PHRASES.values()})
    r = titles.sparkSession.createDataFrame([(a, w) for a in added for w in a.lower().split()], "added string, w string")
    return r.join(words, "w", "left_anti").select("added").distinct()


def by_role(related: DataFrame, title: str = "title", proxy: float = 0.75) -> DataFrame:
    """(src, role, n, members, proxies): neighbours grouped by what they are for, strongest first; proxies have confidence `proxy` or more."""
    r = related.withColumn("role", role_of(F.col(title)))
    member = F.struct((-F.col("confidence")).alias("o"), F.col("dst"), F.col("confidence"))
    g = r.groupBy("src", "role").agg(F.count(F.lit(1)).alias("n"), F.array_sort(F.collect_list(member)).alias("m"))
    return g.select("src", "role", "n", F.transform("m", lambda x: x["dst"]).alias("members"), F.transform(F.filter("m", lambda x: x["confidence"] >= proxy), lambda x: x["dst"]).alias("proxies"))


#: Fixed value: the order in which groups of neighbours are shown.
ROLE_ORDER = ("product", "test_method", "installation", "safety", "terminology", "dimensions", "quality_system")


def role_groups(related: DataFrame, title: str = "title", likely: int = 6) -> DataFrame:
    """by_role with place, the groups' fixed order, and likely: a source's strongest proxies, `likely` at most, over all groups."""
    g = by_role(related, title)
    place = F.array_position(F.array(*map(F.lit, ROLE_ORDER)), F.col("role"))
    sure = related.where(F.col("confidence") >= 0.75).groupBy("src").agg(F.slice(F.transform(F.array_sort(F.collect_list(F.struct((-F.col("confidence")).alias("o"), "dst"))), lambda x: x["dst"]), 1, likely).alias("likely"))
    return g.withColumn("place", place.cast("int")).join(sure, "src", "left").select("src", "place", "role", "n", "members", "proxies", F.coalesce("likely", F.array().cast("array<string>")).alias("likely"))


def amendment_tallies(diffs: DataFrame) -> DataFrame:
    """(field, n, entries) of amendments (is_number, field, held, portal)."""
    return diffs.groupBy("field").agg(F.count(F.lit(1)).alias("n"), F.countDistinct("is_number").alias("entries"))


def column_summary(df: DataFrame, columns: list[str]) -> DataFrame:
    """(column, rows, known, kinds): rows, those with a value, and distinct values of each column, in one pass."""
    each = F.explode(F.array(*[F.struct(F.lit(c).alias("column"), F.col(c).cast("string").alias("v")) for c in columns])).alias("x")
    return df.select(each).select("x.*").groupBy("column").agg(F.count(F.lit(1)).alias("rows"), F.count("v").alias("known"), F.countDistinct("v").alias("kinds"))


def calibration_line(scored: DataFrame, buckets: DataFrame, score: str = "score", least: int = 30) -> DataFrame:
    """scored with the accuracy measured in its score's tenth, null where fewer than `least` queries support it."""
    b = buckets.where(F.col("n") >= least).select("bucket", "accuracy")
    return scored.withColumn("bucket", F.least(F.floor(F.col(score) * 10), F.lit(9)).cast("int")).join(F.broadcast(b), "bucket", "left")  # ten rows


def first_mentions(found: DataFrame, citation: Column | None = None) -> DataFrame:
    """The first finding of each document and citation, by place."""
    return found.groupBy("doc_id", "citation").agg(F.min_by(F.struct("kind", "severity", "text"), "place").alias("f")).select("doc_id", "citation", "f.*")


def scan_citations(texts: DataFrame, register: DataFrame) -> DataFrame:
    """(doc_id, kept, dropped) of recognised texts: a misread number is dropped unless the register holds its base."""
    c = cited(texts).withColumn("_b", is_base(F.col("citation")))
    held = register.select(F.col("is_base").alias("_b"), F.lit(True).alias("_k")).distinct()
    c = c.join(held, "_b", "left")
    some = lambda cond: F.array_sort(F.collect_list(F.when(cond, F.col("citation"))))
    return c.groupBy("doc_id").agg(some(F.col("_k").isNotNull()).alias("kept"), some(F.col("_k").isNull()).alias("dropped"))
