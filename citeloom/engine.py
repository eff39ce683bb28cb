"""The façade: one method for each request the engine answers, over tables given as DataFrames."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .functions.designation import extract_citations, primary_notification
from .functions.text import document_title, expand_query
from .operators import association, audit, corpus, forward, health, layout, lookup, paging, ranking
from .sources import logs, tables


@dataclass
class Engine:
    """register: is_number, is_base, is_digits, load_ord, title, family, status, replaced_by, year. documents: doc_id, ministry, year,
    demands_mark. citations: doc_id, citation. rules: is_number, is_base, load_ord, mandatory, scheme, notification. edges: see
    association.cocitation_edges, with src and dst as register numbers."""

    spark: SparkSession
    register: DataFrame
    documents: DataFrame
    citations: DataFrame
    rules: DataFrame
    edges: DataFrame

    def _one(self, text: str) -> DataFrame:
        paging.checked_request(text)
        return self.spark.createDataFrame([(0, text)], "doc_id long, text string")

    def _asked(self, number: str) -> DataFrame:
        return self.spark.createDataFrame([(number,)], "citation string")

    def _page(self, df: DataFrame, order: list[str], sort: str, descending: bool, limit: int, offset: int) -> DataFrame:
        """A page of a list with total, the rows that the filters leave; sorted by a column of the list, ties by its own order."""
        if sort and sort not in df.columns:
            raise ValueError(f"no column {sort} to sort by")
        first = [F.col(sort).desc_nulls_last() if descending else F.col(sort).asc_nulls_last()] if sort else []
        total = df.agg(F.count(F.lit(1)).alias("total"))
        return paging.page(df.crossJoin(F.broadcast(total)), [*first, *order], limit, offset)  # one row

    def standards(self, q: str = "", status: str = "", family: str = "", sort: str = "", descending: bool = False, limit: int = 100, offset: int = 0) -> DataFrame:
        r = paging.search(paging.equal_filters(self.register, {"status": status, "family": family}), q, ["is_number", "title", "family"], "is_digits")
        return self._page(r, ["is_number", "load_ord"], sort, descending, limit, offset)

    def standard(self, number: str) -> DataFrame:
        """The entry with its rule and its related standards, the strongest twelve in order."""
        r = lookup.resolve(self._asked(number), self.register, ["title", "status", "replaced_by", "family", "year"])
        rule = lookup.certification(self._asked(number), self.rules).select("citation", "rule", "mandatory")
        near = association.related_of(self._asked(number), self.edges, forward.RELATED).groupBy("citation")
        near = near.agg(F.transform(F.array_sort(F.collect_list(F.struct("rank", "dst"))), lambda x: x["dst"]).alias("related"))
        return r.join(rule, "citation", "left").join(near, "citation", "left")

    def dead(self, number: str) -> DataFrame:
        return lookup.check_dead(self._asked(number), self.register)

    def related(self, number: str, limit: int = 5) -> DataFrame:
        """Neighbours of a designation that the register holds; association.related_of answers for any."""
        known = lookup.resolve(self._asked(number), self.register, []).where("hit IS NOT NULL")
        return association.related_of(known, self.edges, limit)

    def certifications(self, q: str = "", scheme: str = "", mandatory: str = "", sort: str = "", descending: bool = False, limit: int = 100, offset: int = 0) -> DataFrame:
        r = self.rules.withColumns({"notification_history": F.col("notification"), "notification": primary_notification(F.col("notification"))})
        r = paging.equal_filters(r, {"scheme": scheme, "mandatory": mandatory})
        return self._page(paging.search(r, q, ["is_number", "notification"]), ["is_number", "load_ord"], sort, descending, limit, offset)

    def tenders(self, q: str = "", ministry: str = "", year: int | str = "", sort: str = "", descending: bool = False, limit: int = 100, offset: int = 0) -> DataFrame:
        d = self.documents.withColumn("_id", F.col("doc_id").cast("string"))
        category = F.col("category") if "category" in d.columns else F.lit(None).cast("string")
        d = d.withColumns({"_t": document_title(category, F.col("_id"))})
        d = d.withColumns({"title": F.col("_t.title"), "title_derived": F.col("_t.derived")}).drop("_t")
        d = paging.search(paging.equal_filters(d, {"ministry": ministry, "year": year}), q, ["_id", "title", "ministry"]).drop("_id")
        dead = lookup.dead_citations(self.citations, self.register).groupBy("doc_id").agg(F.count(F.lit(1)).alias("dead"))
        any_cited = self.citations.select("doc_id", F.lit(True).alias("_c")).distinct()
        page = self._page(d, ["doc_id"], sort, descending, limit, offset).join(dead, "doc_id", "left").join(any_cited, "doc_id", "left")
        now = F.when(F.col("_c").isNull(), "No citations").when(F.col("dead") > 0, "Yes").otherwise("No")
        return page.withColumns({"dead": F.coalesce("dead", F.lit(0)).cast("long"), "dead_now": now}).drop("_c")

    def tender(self, doc_id) -> DataFrame:
        return self.documents.where(F.col("doc_id") == doc_id)

    def backlog(self) -> DataFrame:
        return lookup.backlog(self.citations, self.register).orderBy(F.desc("documents"), "is_number")

    def stats(self) -> dict[str, DataFrame]:
        return {"coverage": lookup.coverage_stats(self.citations, self.register), "status": paging.count_by(self.register, "status"), "families": paging.count_by(self.register, "family"), "decades": paging.decades(self.register, "year"), "degrees": association.degrees(self.edges)}

    def graph(self, nodes: int = 400, edges: int = 2000, min_count: int = 2, per_node: int = 12) -> DataFrame:
        return association.full_graph(self.edges, nodes, edges, min_count, per_node)

    def graph_nodes(self, **limits) -> DataFrame:
        return association.described_nodes(self.graph(**limits), self.register)

    def graph_summary(self, **limits) -> DataFrame:
        """One row: edges held, distinct pairs, edges shown, and whether the display leaves any out."""
        pairs = F.countDistinct(F.least("src", "dst"), F.greatest("src", "dst"))
        held = self.edges.agg(F.count(F.lit(1)).alias("total_edges"), pairs.alias("distinct_pairs"))
        shown = self.graph(**limits).agg(F.count(F.lit(1)).alias("shown"))
        return held.crossJoin(F.broadcast(shown)).withColumn("truncated", F.col("shown") < F.col("distinct_pairs"))  # one row each

    def path(self, a: str, b: str) -> DataFrame:
        ends = [lookup.resolve(self._asked(x), self.register, []).select(F.coalesce("hit", "citation").alias("node")) for x in (a, b)]
        return association.shortest_paths(self.edges, *ends)

    def graph_layout(self, **limits) -> DataFrame:
        return layout.layout(self.graph(**limits))

    def neighbourhood(self, number: str, depth: int = 1, limit: int = 40) -> DataFrame:
        seed = lookup.resolve(self._asked(number), self.register, []).select(F.col("hit").alias("node")).where("node IS NOT NULL")
        return association.ego_network(self.edges, seed, depth, limit)

    def extract(self, text: str) -> DataFrame:
        return self._one(text).select(F.explode(extract_citations(F.col("text"))).alias("c")).select("c.*")

    def audit_text(self, text: str) -> DataFrame:
        """Findings of one text with actions, in order."""
        return self.audit_report(text)[0].orderBy("place")

    def audit_report(self, text: str) -> tuple[DataFrame, DataFrame]:
        """Findings of all kinds, and the verdict, of one text."""
        doc = self._one(text)
        return audit.audit(doc, corpus.cited(doc), self.register, self.rules, corpus.mark_scan(doc), self.edges)

    def recommend(self, text: str, k: int = ranking.SHORTLIST) -> DataFrame:
        """Register entries for a product description by BM25 over number, title and family, with the gate's scores."""
        q = self._one(text).select(F.col("doc_id").alias("item_id"), expand_query(F.col("text")).alias("text"))
        top = ranking.bm25(forward.register_texts(self.register), q, k, doc_id="doc")
        return top.withColumn("score", F.round(ranking.calibrated("lexical", F.col("score")), 6))

    def answer(self, text: str, strategy: str | None = None, vectors: tuple[DataFrame, DataFrame] | None = None) -> tuple[DataFrame, DataFrame]:
        """Candidates and the gated answer for a product description (see forward.recommend)."""
        return forward.recommend(self._one(text).withColumnRenamed("doc_id", "query_id"), self.register, self.edges, self.rules, vectors, strategy)

    def route(self, text: str) -> str:
        """audit if the text cites anything, else draft."""
        return "audit" if self.extract(text).head(1) else "draft"

    def _cited_items(self) -> DataFrame:
        """(doc, item, dead): what each document cites, by the register's number where it resolves, else as written."""
        r = lookup.check_dead(self.citations, self.register)
        return r.select(F.col("doc_id").alias("doc"), F.coalesce("hit", "citation").alias("item"), "dead").distinct()

    def _alike(self, text: str, doc_texts: DataFrame) -> DataFrame:
        q = self._one(text).withColumnRenamed("doc_id", "item_id")
        return ranking.bm25(doc_texts, q, ranking.PEER_DOCUMENTS)

    def peers(self, text: str, doc_texts: DataFrame) -> DataFrame:
        """What the documents most like a text cite, dead ones first. doc_texts: doc_id, text."""
        items = self._cited_items()
        return ranking.peers(self._alike(text, doc_texts), items, dead=items.where("dead").select("item"))

    def peer_report(self, text: str, doc_texts: DataFrame, docs: DataFrame) -> DataFrame:
        """Which of those documents repeat a dead citation, their buyers, and examples. docs: doc, buyer, category."""
        return ranking.peer_report(self._alike(text, doc_texts), self._cited_items().where("dead"), docs)

    def health_index(self) -> dict[str, DataFrame]:
        base = self.rules.where("mandatory = 'Yes'").select(F.upper("is_base").alias("base"))
        f = health.fact(self.citations, self.documents, self.register, base)
        return {"headline": health.headline(f), "by_year": health.by(f, "year"), "dead": health.ranked(f, True, 15), "demand": health.ranked(f, False, 15), "buyers": health.buyers(f, "ministry"), "certification_gap": health.certification_gap(f)}

    def evidence(self, number: str, limit: int = 25) -> DataFrame:
        """The first documents that cite the number, each with how many do, their share of all in per cent, and whether the list is cut."""
        hit = lookup.resolve(self._asked(number), self.register, []).select("hit")
        docs = lookup.resolve(self.citations, self.register, []).join(hit, "hit", "left_semi").select("doc_id").distinct()
        n = docs.agg(F.count(F.lit(1)).alias("documents"))
        of = self.documents.agg(F.count(F.lit(1)).alias("corpus"))
        figures = n.crossJoin(F.broadcast(of)).select("documents", F.round(F.try_divide(100.0 * F.col("documents"), F.col("corpus")), 1).alias("share_pct"), (F.col("documents") > limit).alias("truncated"))
        return docs.orderBy("doc_id").limit(limit).crossJoin(F.broadcast(figures))  # one row

    def decide(self, decisions: DataFrame, path: str) -> DataFrame:
        return logs.append_decisions(decisions, path)

    def decisions(self, path: str) -> DataFrame:
        return logs.agreement(self.spark.read.schema("decision string, rationale string").json(path))

    def export(self, name: str, path: str) -> None:
        known = {"register": lambda: self.register, "documents": lambda: self.documents, "edges": lambda: self.edges, "rules": lambda: self.rules, "backlog": self.backlog}
        if name not in known:
            raise ValueError(f"{name} is not exportable")
        tables.export_csv(known[name](), name, path)
