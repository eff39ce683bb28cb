"""Audit of a document's citations: findings, suggestions, verdict."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.designation import citation_digits
from ..session import Scratch
from .lookup import certification, resolve

CONFIDENCE, SUPPORT, PER_SOURCE, TOTAL = 0.55, 8, 3, 8
DEAD = ("Withdrawn", "Superseded")


def one_edit(a: Column, b: Column) -> Column:
    """Optimal string alignment distance exactly 1: one insertion, deletion or substitution, or a swap of neighbours."""
    at = F.sequence(F.lit(1), F.greatest(F.length(a) - 1, F.lit(1)))
    swapped = lambda i: F.concat(F.substr(a, F.lit(1), i - 1), F.substr(a, i + 1, F.lit(1)), F.substr(a, i, F.lit(1)), F.substr(a, i + 2))
    swap = (F.length(a) == F.length(b)) & (F.length(a) > 1) & (a != b) & F.exists(at, lambda i: swapped(i) == b)
    return (F.levenshtein(a, b) == 1) | swap


def _neighbourhood(c: Column) -> Column:
    """Blocking keys: the text and all texts with one character deleted. Texts one edit or swap apart share a key."""
    at = F.sequence(F.lit(1), F.greatest(F.length(c), F.lit(1)))
    return F.array_distinct(F.concat(F.array(c), F.transform(at, lambda i: F.concat(F.substr(c, F.lit(1), i - 1), F.substr(c, i + 1)))))


def near_numbers(unknown: DataFrame, known: DataFrame) -> DataFrame:
    """(number, candidate): known numbers one edit or swap from an unknown one, by equal deletion neighbours instead of a nested loop."""
    u = unknown.select("number").distinct().select("number", F.explode(_neighbourhood(F.col("number"))).alias("key"))
    k = known.select("candidate").distinct().select("candidate", F.explode(_neighbourhood(F.col("candidate"))).alias("key"))
    return u.join(k, "key").select("number", "candidate").distinct().where(one_edit(F.col("number"), F.col("candidate")))


def did_you_mean(unresolved: DataFrame, cited: DataFrame, register: DataFrame, edges: DataFrame) -> DataFrame:
    """(doc_id, number, candidate, strength): for each unresolved number the near register number that the document's
    other citations are most often cited with, if any is.

    unresolved: doc_id, number; cited: doc_id, number (resolved ones); register: number; edges: a, b, n_co on numbers.
    """
    near = near_numbers(unresolved, register.select(F.col("number").alias("candidate")))
    both = edges.select("a", "b", "n_co").unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b"), "n_co"))
    return _likeliest(unresolved, near, cited, both)


def _likeliest(unresolved: DataFrame, near: DataFrame, cited: DataFrame, both: DataFrame) -> DataFrame:
    """The candidate of each document's number that its other citations have most edges with. both: edges a, b, n_co in either direction.

    A number has over a hundred near ones and few of them have an edge, so candidates meet their edges once for each number, not in every
    document that cites it.
    """
    both = both.groupBy("a", "b").agg(F.max("n_co").alias("n_co"))
    linked = near.join(both, F.col("candidate") == F.col("a")).select("number", "candidate", F.col("b").alias("other"), "n_co")
    c = unresolved.join(cited.select("doc_id", F.col("number").alias("other")).distinct(), "doc_id")
    c = c.join(linked, ["number", "other"]).groupBy("doc_id", "number", "candidate").agg(F.sum("n_co").alias("strength"))
    w = Window.partitionBy("doc_id", "number").orderBy(F.desc("strength"), "candidate")
    return c.withColumn("_n", F.row_number().over(w)).where("_n = 1").drop("_n")


def missing_connected(cited: DataFrame, edges: DataFrame, dead: DataFrame, confidence: float = CONFIDENCE, support: int = SUPPORT, per_source: int = PER_SOURCE, total: int = TOTAL) -> DataFrame:
    """(doc_id, item, source, confidence, n_co): items usually cited with a document's citations but absent from it.

    Declarative form: strong edges from cited items to uncited, live ones; the best per_source of each source; each item
    once, by its best confidence; the best `total` of a document. cited: doc_id, item; dead: item.
    """
    strong = edges.where((F.col("confidence") >= confidence) & (F.col("n_co") >= support)).join(dead.select(F.col("item").alias("dst")), "dst", "left_anti")
    c = cited.select("doc_id", F.col("item").alias("src")).distinct().join(strong, "src")
    c = c.join(cited.select("doc_id", F.col("item").alias("dst")).distinct(), ["doc_id", "dst"], "left_anti")
    pick = lambda df, keys, n, *order: df.withColumn("_n", F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).where(F.col("_n") <= n).drop("_n")
    best = (F.desc("confidence"), F.desc("n_co"))
    c = pick(c, ["doc_id", "src"], per_source, *best, "dst")
    c = pick(c, ["doc_id", "dst"], 1, *best, "src")
    c = pick(c, ["doc_id"], total, *best, "dst")
    return c.select("doc_id", F.col("dst").alias("item"), F.col("src").alias("source"), "confidence", "n_co")


#: Candidates of a source that the rule in order looks at.
FETCHED = 12


def missing_in_order(cited: DataFrame, edges: DataFrame, dead: DataFrame, confidence: float = CONFIDENCE, support: int = SUPPORT, per_source: int = PER_SOURCE, total: int = TOTAL, fetched: int = FETCHED) -> DataFrame:
    """(doc_id, item, source, confidence, n_co, place): items usually cited with a document's citations but absent from it, by the rule
    that goes through the citations in their order.

    Each source looks at its `fetched` strongest edges, from the most confident, and takes up to per_source items. What the document cites
    or is dead isn't taken, nor what an earlier source has taken with at least this confidence; with less, the item passes to this source.
    The best `total` items of a document stay, by confidence and count, then by when they were first taken. So a source's choice depends
    on the sources before it, which no window over the rows expresses: `missing_connected` is the form without an order.

    cited: doc_id, item, place (of repeated items the first place counts); edges: src, dst, n_co, confidence; dead: item. Candidates
    come to a task sorted by document and order and are folded as they come; what is held is the items that one document has taken.
    """
    rank = Window.partitionBy("src").orderBy(F.desc("confidence"), F.desc("n_co"), "dst")
    strong = edges.where((F.col("confidence") >= confidence) & (F.col("n_co") >= support)).select("src", "dst", "n_co", "confidence")
    strong = strong.withColumn("_n", F.row_number().over(rank)).where(F.col("_n") <= fetched)
    strong = strong.join(dead.select(F.col("item").alias("dst")).distinct(), "dst", "left_anti")
    own = cited.where(F.col("doc_id").isNotNull()).groupBy("doc_id", F.col("item").alias("src")).agg(F.min("place").alias("_at"))
    c = own.join(strong, "src").join(own.select("doc_id", F.col("src").alias("dst")), ["doc_id", "dst"], "left_anti")
    c = c.select("doc_id", "src", "dst", "confidence", "n_co", "_at", "_n").repartition("doc_id").sortWithinPartitions("doc_id", "_at", "src", "_n")
    kind = {f.name: f.dataType.simpleString() for f in c.schema.fields}
    schema = f"doc_id {kind['doc_id']}, item {kind['dst']}, source {kind['src']}, confidence double, n_co bigint, place int"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        doc, source, kept, held, types = None, None, 0, {}, None
        out: list[tuple] = []

        def end() -> None:
            ranked = sorted(held.items(), key=lambda x: (-x[1][0], -x[1][1]))[:total]  # dicts keep the order of first taking
            out.extend((doc, item, s, f, n, i + 1) for i, (item, (f, n, s)) in enumerate(ranked))
            held.clear()

        def given() -> pa.RecordBatch:
            made = pa.RecordBatch.from_arrays([pa.array([r[i] for r in out], t) for i, t in enumerate(types)], ["doc_id", "item", "source", "confidence", "n_co", "place"])
            out.clear()
            return made

        for batch in batches:
            names = {n: batch.column(n).type for n in batch.schema.names}
            types = [names["doc_id"], names["dst"], names["src"], pa.float64(), pa.int64(), pa.int32()]
            for d, s, item, f, n in zip(*(batch.column(x).to_pylist() for x in ("doc_id", "src", "dst", "confidence", "n_co"))):
                if d != doc:
                    end()
                    doc, source = d, None
                if s != source:
                    source, kept = s, 0
                if kept < per_source and (item not in held or held[item][0] < f):
                    held[item] = (f, n, s)
                    kept += 1
            yield given()
        if types:
            end()
            yield given()

    return c.mapInArrow(run, schema)


#: What an audit needs of a resolved citation's register entry.
CARRIED = ["status", "replaced_by", "is_digits"]


def _resolved(citations: DataFrame, register: DataFrame, rules: DataFrame | None = None) -> DataFrame:
    """(citation, doc_id, hit, matched_by, status, replaced_by, is_digits) of each document's distinct citations; with rules also rule and
    mandatory. Spellings meet register and rules once, before they go to the documents."""
    cited = citations.select("doc_id", "citation").distinct()
    if rules is None:
        return resolve(cited, register, CARRIED)
    known = resolve(citations.select("citation").where("citation IS NOT NULL").distinct(), register, CARRIED)
    return cited.join(certification(known, rules), "citation", "left")


def _finding(df: DataFrame, kind: str, severity: str, detail: Column, citation: str = "citation") -> DataFrame:
    return df.select("doc_id", F.lit(kind).alias("kind"), F.lit(severity).alias("severity"), F.col(citation).alias("citation"), detail.alias("detail"))


def _findings(r: DataFrame, marks: DataFrame) -> DataFrame:
    replaced = F.coalesce("replaced_by", F.lit("UNKNOWN"))
    dead = _finding(r.where(F.col("status").isin(*DEAD)), "dispute_risk", "high", F.concat(F.col("status"), F.lit("; replaced by "), replaced))
    unknown = _finding(r.where("hit IS NULL"), "not_in_register", "medium", F.concat(F.lit("no entry for number "), citation_digits(F.col("citation"))))
    ruled = r.where("hit IS NOT NULL AND mandatory = 'Yes'")
    unmarked = ruled.join(marks.where("demands_mark = 'Yes'").select("doc_id").distinct(), "doc_id", "left_anti")
    return dead.unionByName(unknown).unionByName(_finding(unmarked, "statutory_omission", "high", F.concat(F.lit("mandatory under "), F.col("rule"))))


def _connected(r: DataFrame, register: DataFrame, edges: DataFrame, **limits) -> DataFrame:
    held = r.where("hit IS NOT NULL").select("doc_id", F.col("hit").alias("item"))
    dead = register.where(F.col("status") != "Current").select(F.col("is_number").alias("item"))
    m = missing_connected(held, edges, dead, **limits)
    detail = F.concat(F.lit("cited with "), F.col("source"), F.lit(" in "), F.col("n_co").cast("string"), F.lit(" documents"))
    return _finding(m, "missing_connected", "low", detail, "item")


def _meant(r: DataFrame, register: DataFrame, edges: DataFrame) -> DataFrame:
    gone = r.where("hit IS NULL").select("doc_id", "citation", citation_digits(F.col("citation")).alias("number")).where("number <> ''")
    numbers = register.select(F.col("is_number").alias("n"), F.col("is_digits").alias("d")).where("d <> ''")
    near = near_numbers(gone, numbers.select(F.col("d").alias("candidate")))
    # only edges from a candidate to something else matter, and few numbers are candidates
    chosen = numbers.join(near.select(F.col("candidate").alias("d")).distinct(), "d", "left_semi")
    e = edges.join(chosen.select(F.col("n").alias("src"), F.col("d").alias("a")), "src").join(numbers.select(F.col("n").alias("dst"), F.col("d").alias("b")), "dst")
    back = edges.join(chosen.select(F.col("n").alias("dst"), F.col("d").alias("a")), "dst").join(numbers.select(F.col("n").alias("src"), F.col("d").alias("b")), "src")
    both = e.select("a", "b", "n_co").unionByName(back.select("a", "b", "n_co"))
    best = _likeliest(gone.select("doc_id", "number").distinct(), near, r.where("hit IS NOT NULL").select("doc_id", F.col("is_digits").alias("number")), both)
    first = numbers.groupBy(F.col("d").alias("candidate")).agg(F.min("n").alias("did_you_mean"))
    return gone.join(best.select("doc_id", "number", "candidate"), ["doc_id", "number"]).join(first, "candidate").select("doc_id", "citation", "did_you_mean")


def findings(citations: DataFrame, register: DataFrame, rules: DataFrame, marks: DataFrame) -> DataFrame:
    """(doc_id, kind, severity, citation, detail): a dead citation, a mandatory rule without a mark demanded, an unregistered number.

    citations: doc_id, citation; marks: doc_id, demands_mark. One row of each document, kind and citation.
    """
    return _findings(_resolved(citations, register, rules), marks)


def connected_findings(citations: DataFrame, register: DataFrame, edges: DataFrame, **limits) -> DataFrame:
    """Findings of the standards usually cited with a document's own but absent from it. edges: src, dst, n_co, confidence on
    register numbers; citations: doc_id, citation."""
    return _connected(_resolved(citations, register), register, edges, **limits)


def meant(citations: DataFrame, register: DataFrame, edges: DataFrame) -> DataFrame:
    """(doc_id, citation, did_you_mean): for each unregistered citation the register entry one edit away that the document's
    other citations are most cited with, where there is one. edges as in connected_findings."""
    return _meant(_resolved(citations, register), register, edges)


def audit(docs: DataFrame, citations: DataFrame, register: DataFrame, rules: DataFrame, marks: DataFrame, edges: DataFrame, **limits) -> tuple[DataFrame, DataFrame]:
    """The whole audit of each document: its findings and its verdict.

    Findings (doc_id, kind, severity, citation, detail, action, text, place, did_you_mean) are of all four kinds: dead, without
    the mark, usually cited alongside but missing, and not registered, the last with the entry that may be meant. Verdicts
    (doc_id, cited, resolved, dispute_risk, statutory_omission, missing_connected, not_in_register, high, medium, low,
    verdict) have a row of every document. Citations are resolved once and written; all kinds read that table, and both results read
    the written findings.
    """
    keep = Scratch(docs.sparkSession, "audit")
    r = keep.keep(_resolved(citations, register, rules), "resolved")
    found = _findings(r, marks).unionByName(_connected(r, register, edges, **limits))
    found = found.join(_meant(r, register, edges).withColumn("kind", F.lit("not_in_register")), ["doc_id", "citation", "kind"], "left")
    found = keep.keep(found, "found")
    n = r.groupBy("doc_id").agg(F.count(F.lit(1)).alias("cited"), F.count("hit").alias("resolved"))
    kinds = ("dispute_risk", "statutory_omission", "missing_connected", "not_in_register")
    by_kind = found.groupBy("doc_id").agg(*[F.count_if(F.col("kind") == k).alias(k) for k in kinds])
    v = verdicts(docs, found).join(n, "doc_id", "left").join(by_kind, "doc_id", "left").fillna(0, ["cited", "resolved", *kinds])
    return suggestions(found), v.select("doc_id", "cited", "resolved", *kinds, "high", "medium", "low", "verdict")


def corrigendum(found: DataFrame) -> DataFrame:
    """(doc_id, text): a document's suggestions as the numbered lines of a corrigendum."""
    lines = F.array_sort(F.collect_list(F.struct("place", "text")))
    g = suggestions(found).groupBy("doc_id").agg(lines.alias("l"))
    return g.select("doc_id", F.array_join(F.transform("l", lambda x: F.concat(x["place"].cast("string"), F.lit(". "), x["text"])), "\n").alias("text"))


def verdicts(docs: DataFrame, found: DataFrame) -> DataFrame:
    """(doc_id, high, medium, low, verdict): blocking with a high finding, review with any, clean without."""
    f = found.groupBy("doc_id").agg(*[F.count_if(F.col("severity") == s).alias(s) for s in ("high", "medium", "low")])
    d = docs.select("doc_id").distinct().join(f, "doc_id", "left").fillna(0, ["high", "medium", "low"])
    return d.withColumn("verdict", F.when(F.col("high") > 0, "blocking").when(F.col("medium") + F.col("low") > 0, "review").otherwise("clean"))


def suggestions(found: DataFrame) -> DataFrame:
    """found with action and text: replace a dead citation, add a clause, or have a number checked."""
    act = F.when(F.col("kind") == "dispute_risk", "replace").when(F.col("kind") == "statutory_omission", "add_clause").when(F.col("kind") == "missing_connected", "add").otherwise("unresolved")
    text = F.when(act == "replace", F.format_string("Replace %s (%s).", "citation", "detail")).when(act == "add_clause", F.format_string("Require the standard mark for %s, %s.", "citation", "detail")).when(act == "add", F.format_string("Consider citing %s.", "citation")).otherwise(F.format_string("Check %s: %s.", "citation", "detail"))
    order = F.coalesce(*[F.when(F.col("severity") == s, F.lit(i)) for i, s in enumerate(("high", "medium", "low"))], F.lit(3))
    return found.withColumns({"action": act, "text": text, "place": F.row_number().over(Window.partitionBy("doc_id").orderBy(order, "kind", "citation"))})
