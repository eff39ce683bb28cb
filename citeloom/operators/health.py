"""Corpus health: documents that cite dead or unregistered designations, demand, buyers, certification gaps."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.designation import is_base
from ..session import Scratch, dealt_to

#: Rows of the fact that a task groups by all sets at first, each of which makes a row of every set.
ROWS = 250_000


def preferred_status(register: DataFrame) -> DataFrame:
    """(base, status, replaced_by): one row of each upper-cased base; a current part wins, then load order."""
    w = Window.partitionBy("base").orderBy((F.col("status") == "Current").desc(), "load_ord")
    r = register.withColumn("base", F.upper("is_base"))
    return r.withColumn("_n", F.row_number().over(w)).where("_n = 1").select("base", "status", "replaced_by")


def fact(citations: DataFrame, docs: DataFrame, register: DataFrame, mandatory: DataFrame, citation: str = "citation") -> DataFrame:
    """One row of each document and cited base: dead, mandatory, and the document's columns. The other queries read this.

    mandatory has base, upper-cased. Documents without citations are not in it.
    """
    c = citations.select("doc_id", F.upper(is_base(F.col(citation))).alias("base")).where("base IS NOT NULL").distinct()
    c = c.join(preferred_status(register), "base", "left").withColumn("dead", F.coalesce(F.col("status") != "Current", F.lit(False)))
    c = c.join(mandatory.select("base").distinct().withColumn("mandatory", F.lit(True)), "base", "left")
    return c.withColumn("mandatory", F.coalesce("mandatory", F.lit(False))).join(docs, "doc_id")


def headline(f: DataFrame) -> DataFrame:
    """One row: citing documents, those that cite something dead, share, distinct dead bases."""
    n, dead = F.countDistinct("doc_id"), F.countDistinct(F.when(F.col("dead"), F.col("doc_id")))
    return f.agg(n.alias("documents"), dead.alias("documents_dead"), F.round(100.0 * dead / n, 6).alias("dead_pct"), F.countDistinct(F.when(F.col("dead"), F.col("base"))).alias("dead_standards"))


def by(f: DataFrame, key: str) -> DataFrame:
    """Documents and dead-citing documents by a document column."""
    d = f.groupBy(key, "doc_id").agg(F.max("dead").alias("dead"))
    return d.groupBy(key).agg(F.count(F.lit(1)).alias("documents"), F.count_if("dead").alias("documents_dead"))


def ranked(f: DataFrame, dead_only: bool, limit: int | None = None) -> DataFrame:
    """(base, documents) by demand."""
    g = (f.where("dead") if dead_only else f).groupBy("base").agg(F.countDistinct("doc_id").alias("documents"))
    return g.orderBy(F.desc("documents"), "base").limit(limit) if limit else g


def buyers(f: DataFrame, key: str, least: int = 10, limit: int = 15) -> DataFrame:
    """Buyers with at least `least` documents by dead-citing documents, each with the dead base it cites most."""
    g = by(f, key).where(F.col("documents") >= least)
    pairs = f.where("dead").groupBy(key, "base").agg(F.countDistinct("doc_id").alias("n"))
    w = Window.partitionBy(key).orderBy(F.desc("n"), "base")
    top = pairs.withColumn("_n", F.row_number().over(w)).where("_n = 1").select(key, F.col("base").alias("top_dead"), F.col("n").alias("top_dead_documents"))
    return g.join(top, key, "left").orderBy(F.desc("documents_dead"), F.desc("documents"), key).limit(limit)


def certification_gap(f: DataFrame, mark: str = "demands_mark") -> DataFrame:
    """One row: documents citing a mandatory base, how many of them weren't scanned for the mark, demand it, or don't; and the gap
    among the scanned in per cent."""
    d = f.where("mandatory").groupBy("doc_id").agg(F.first(mark).alias("m"))
    yes, no = F.count_if(F.col("m") == "Yes"), F.count_if(F.col("m") == "No")
    cited = F.count(F.lit(1))
    return d.agg(cited.alias("cited"), (cited - yes - no).alias("unknown"), yes.alias("demanded"), no.alias("gap"), F.round(F.try_divide(100.0 * no, yes + no), 6).alias("gap_pct"))


def profile(f: DataFrame, keys: tuple[str, ...], buyer: str) -> DataFrame:
    """(kind, key, documents, documents_dead, top_dead, top_dead_documents): the whole health report from one reading of the fact.

    Kinds are all (key is null), each of keys and buyer (documents and dead-citing documents), and base (documents that cite
    the base, and the same if it is dead, else 0). top_dead is the dead base that most documents of a buyer cite, ties by name.

    One grouping by sets counts (document), (key, document) for each key, (base) and (buyer, base) at once: the fact is written, dealt by
    document to tasks of about ROWS rows and expanded there with partial counts, and the result is written. All figures are counted from that. A row of the fact is a
    document and a base, so rows of a set with base are documents.
    """
    by = [*keys, buyer]
    sets = [["doc_id"], *[[k, "doc_id"] for k in by], ["base"], [buyer, "base"]]
    names = [*by, "doc_id", "base"]
    scratch = Scratch(f.sparkSession, "health")
    rows = scratch.keep(f.select(*names, "dead"), "rows")
    rows = rows.repartition(dealt_to(rows, ROWS), "doc_id")
    bit = {c: 1 << (len(names) - 1 - i) for i, c in enumerate(names)}
    place = {tuple(x): sum(b for c, b in bit.items() if c not in x) for x in sets}  # grouping_id: a bit for each column that is left out
    grouped = rows.groupingSets([[F.col(c) for c in x] for x in sets], *names)
    one = grouped.agg(F.grouping_id().alias("_set"), F.count(F.lit(1)).alias("n"), F.max("dead").alias("dead"))
    one = scratch.keep(one, "sets")
    kind = F.coalesce(F.when(F.col("_set") == place["doc_id",], "all"), *[F.when(F.col("_set") == place[k, "doc_id"], k) for k in by])
    key = F.coalesce(*[F.when(F.col("_set") == place[k, "doc_id"], F.col(k).cast("string")) for k in by])
    docs = one.select(kind.alias("kind"), key.alias("key"), "dead").where("kind IS NOT NULL")
    docs = docs.groupBy("kind", "key").agg(F.count(F.lit(1)).alias("documents"), F.count_if("dead").alias("documents_dead"))
    pairs = one.where((F.col("_set") == place[buyer, "base"]) & F.col("dead"))
    first = pairs.groupBy(F.col(buyer).cast("string").alias("key")).agg(F.min(F.struct((-F.col("n")).alias("n"), "base")).alias("t"))
    first = first.select(F.lit(buyer).alias("kind"), "key", F.col("t.base").alias("top_dead"), (-F.col("t.n")).alias("top_dead_documents"))
    docs = docs.join(first, (docs.kind == first.kind) & docs.key.eqNullSafe(first.key), "left").select(docs.kind, docs.key, "documents", "documents_dead", "top_dead", "top_dead_documents")
    bases = one.where(F.col("_set") == place["base",]).select(F.lit("base").alias("kind"), F.col("base").alias("key"), F.col("n").alias("documents"), F.when(F.col("dead"), F.col("n")).otherwise(0).alias("documents_dead"), F.lit(None).cast("string").alias("top_dead"), F.lit(None).cast("long").alias("top_dead_documents"))
    return docs.unionByName(bases)
