"""The forward query: which register entry governs each of a batch of product descriptions."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import clauses
from ..functions.designation import extract_citations
from ..functions.text import clip_query, expand_query, material_verdict, role_verdict, script_of, stated_voltage, voltage_verdict
from ..session import Scratch
from . import association, corpus, lookup, ranking

SHOWN, RELATED = 5, 12


def prepared(queries: DataFrame) -> DataFrame:
    """(query_id, text, asked, stated, script): queries clipped, with the register's vocabulary appended for the rankings, the
    voltage they state, and their script where it is not Latin."""
    q = queries.select("query_id", clip_query(F.col("text")).alias("text"))
    return q.select("query_id", "text", expand_query(F.col("text")).alias("asked"), stated_voltage(F.col("text")).alias("stated"), script_of(F.coalesce("text", F.lit(""))).alias("script"))


def register_texts(register: DataFrame, title: str = "title") -> DataFrame:
    """(doc, text): what an entry is found by: number, title and family. With another title column (another language) that alone."""
    text = F.concat_ws(" — ", "is_number", "title", "family") if title == "title" else F.col(title)
    return register.select(F.col("is_number").alias("doc"), text.alias("text"))


def rankings_of(asked: DataFrame, register: DataFrame, vectors: tuple[DataFrame, DataFrame] | None = None) -> dict[str, DataFrame]:
    """name -> (query_id, doc, score, rank): BM25 over the register; the Hindi titles for Devanagari queries, where the register
    has title_hi; dense, where vectors of entries (doc, embedding) and queries (query_id, query) are given."""
    out = {"bm25": ranking.bm25(register_texts(register), asked, query="asked", doc_id="doc", query_id="query_id")}
    if "title_hi" in register.columns:
        own = asked.where("script = 'devanagari'")
        hindi = ranking.bm25(register_texts(register, "title_hi"), own, query="text", doc_id="doc", query_id="query_id", pattern=ranking.INDIC)
        out["hindi"] = hindi.where("score > 0")
    if vectors is not None:
        out["dense"] = ranking.dense(vectors[0].withColumnRenamed("doc", "vec_id"), vectors[1], ranking.DEPTH)
    return out


def judged(candidates: DataFrame, asked: DataFrame, register: DataFrame) -> DataFrame:
    """candidates (query_id, doc, score) with the register's fields, the three verdicts and their common place."""
    entry = lookup.first_by(register, "is_number", F.col("load_ord")).select(F.col("is_number").alias("doc"), "is_base", "title", "family", "status", "year")
    c = candidates.select("query_id", "doc", "score").join(entry, "doc").join(asked.select("query_id", "text", "stated"), "query_id")
    q, t = F.col("text"), F.col("title")
    return ranking.order_candidates(c.withColumns({"voltage": voltage_verdict(q, t), "material": material_verdict(q, t), "role": role_verdict(q, t)}))


def recommend(queries: DataFrame, register: DataFrame, edges: DataFrame, rules: DataFrame, vectors: tuple[DataFrame, DataFrame] | None = None, strategy: str | None = None, rerank=None) -> tuple[DataFrame, DataFrame]:
    """Candidates and answers for queries (query_id, text).

    The rankings to DEPTH are fused to a shortlist (one ranking alone is cut to it), or taken by a registered strategy;
    candidates are judged by voltage, material and role and put in one order; the gate recommends or abstains. A query in a
    script that no ranking reads abstains as translation_unavailable.

    candidates: query_id, place, doc, title, status, score, voltage, material, role, the first SHOWN of each query.
    answers: query_id, decision, reason, doc, score, gap, rule, mandatory, related, clause; the last four only if recommended.
    """
    scratch = Scratch(queries.sparkSession, "forward")
    asked = scratch.keep(prepared(queries), "asked")
    found = rankings_of(asked, register, vectors)
    if strategy is not None:
        c = ranking.run_strategy(strategy, found, edges, rerank)
    elif len(found) > 1:
        fused = ranking.fuse([r.select("query_id", "doc", "rank") for r in found.values()])
        n = None
        for r in found.values():
            one = r.select("query_id").distinct()
            n = one if n is None else n.unionByName(one)
        n = n.groupBy("query_id").agg(F.count(F.lit(1)).alias("n"))  # a query counts the rankings that answer it
        c = fused.join(n, "query_id").select("query_id", "doc", F.round(ranking.sigmoid(12.0 * (F.least(F.col("rrf") * (ranking.FUSE + 1.0) / F.col("n"), F.lit(1.0)) - 0.55)), 6).alias("score"), "rank")
    else:
        c = ranking.run_strategy("bm25", found)
    c = scratch.keep(judged(c, asked, register), "candidates")
    answer = ranking.gate(c, place="place", queries=asked)
    unread = asked.select("query_id", F.col("script").isNotNull().alias("foreign"))
    answer = answer.join(unread, "query_id").withColumn("reason", F.when(F.col("foreign") & (F.col("reason") == "no_candidates"), "translation_unavailable").otherwise(F.col("reason"))).drop("foreign")
    answer = scratch.keep(answer, "answers")
    top = answer.where("decision = 'recommend'").select("query_id", "doc")
    near = association.related_of(top.select(F.col("doc").alias("citation")).distinct(), edges, RELATED)
    near = near.groupBy(F.col("citation").alias("doc")).agg(F.transform(F.array_sort(F.collect_list(F.struct("rank", "dst"))), lambda x: x["dst"]).alias("related"))
    scheme = rules if "scheme" in rules.columns else rules.withColumn("scheme", F.lit(None).cast("string"))
    rule = lookup.certification(top.select(F.col("doc").alias("citation")).distinct(), scheme).select(F.col("citation").alias("doc"), "rule", "mandatory")
    rule = rule.join(lookup.first_by(scheme, "is_number", F.col("load_ord")).select(F.col("is_number").alias("rule"), "scheme"), "rule", "left")
    entry = c.where("place = 1").select("query_id", "title", "family", "year", "status")
    full = top.join(near, "doc", "left").join(rule, "doc", "left").join(entry, "query_id")
    none = F.array().cast("array<string>")
    text = clauses.clause(F.col("doc"), F.col("title"), F.col("family"), F.col("year"), F.col("status"), F.coalesce("related", none), F.col("mandatory"), F.col("scheme"))
    full = full.select("query_id", "rule", "mandatory", F.coalesce("related", none).alias("related"), text.alias("clause"))
    shown = c.where(F.col("place") <= SHOWN).select("query_id", "place", "doc", "title", "status", "score", "voltage", "material", "role")
    return shown, answer.join(full, "query_id", "left").select("query_id", "decision", "reason", "doc", "score", "gap", "rule", "mandatory", "related", "clause")


def allied(answers: DataFrame, edges: DataFrame, register: DataFrame) -> DataFrame:
    """The role groups of the standards related to each recommended one (src)."""
    near = association.related_of(answers.where("decision = 'recommend'").select(F.col("doc").alias("citation")).distinct(), edges, RELATED)
    named = near.join(association.titles(near.select(F.col("dst").alias("citation")), register).withColumnRenamed("citation", "dst"), "dst", "left")
    return corpus.role_groups(named.select(F.col("citation").alias("src"), "dst", "confidence", "title"))


def routed(texts: DataFrame, text: str = "text") -> DataFrame:
    """texts with route: audit if the text cites anything, else draft. Null and empty texts are drafted."""
    cites = F.size(extract_citations(F.coalesce(F.col(text), F.lit("")))) > 0
    return texts.withColumn("route", F.when(cites, "audit").otherwise("draft"))
