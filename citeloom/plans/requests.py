"""Queries of the lists, details and strategies that a front end asks for, over the driver's tables, with their SQL."""

from __future__ import annotations

from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from ..engine import Engine
from ..functions import clauses
from ..functions import text as T
from ..operators import audit, forward, merge, presentation, ranking
from ..session import Scratch, table
from ..sources import tables
from ..streaming import incremental, sinks
from . import extended as X
from . import synthetic as S
from .catalogue import _BM25, _DENSE, _FOUND, _REG, _RRF, _bm25, _dense, _edges, _with, query


def _engine(spark: SparkSession, sf: str) -> Engine:
    k = F.col("load_ord")
    rules = S.rules(spark, sf).withColumns({"scheme": F.when(k % 3 == 0, "Scheme I").otherwise("Scheme II"), "notification": F.concat(F.lit("Order "), k.cast("string"), F.lit(" of Steel, Superseded by Order 1"))})
    docs = S.documents(spark, sf).withColumn("category", F.when(F.col("doc_id") % 2 == 0, F.concat(F.lit("Goods for "), "department")))
    return Engine(spark, S.register(spark, sf), docs, S.citations(spark, sf), rules, _edges(spark, sf))


@query(
    """SELECT is_number, mandatory, scheme, notification, notification || ', Superseded by Order 1' AS notification_history, count(*) OVER () AS total FROM (
  SELECT *, CASE WHEN load_ord % 3 = 0 THEN 'Scheme I' ELSE 'Scheme II' END AS scheme, 'Order ' || load_ord || ' of Steel' AS notification FROM rules)
WHERE scheme = 'Scheme I' AND (contains(lower(is_number), 'part 1') OR contains(lower(notification), 'part 1')) ORDER BY notification DESC, is_number, load_ord LIMIT 30 OFFSET 2""",
    _REG,
)
def certification_list(spark, sf):
    """A page of the rules of one scheme that a search finds, by their orders, each with its order's history."""
    page = _engine(spark, sf).certifications("Part 1", "Scheme I", "", "notification", True, 30, 2)
    return page.select("is_number", "mandatory", "scheme", "notification", "notification_history", "total")


@query(
    """SELECT d.doc_id, d.year, d.ministry, d.department, title, title_derived, coalesce(n, 0) AS dead, CASE WHEN c.doc_id IS NULL THEN 'No citations' WHEN n > 0 THEN 'Yes' ELSE 'No' END AS dead_now, total FROM (
  SELECT *, count(*) OVER () AS total FROM (SELECT *, CASE WHEN doc_id % 2 = 0 THEN 'Goods for ' || department ELSE '' END AS title, doc_id % 2 = 0 AS title_derived FROM docs)
  WHERE year = 1996 AND (contains(lower(title), 'goods') OR contains(lower(ministry), 'goods')) ORDER BY doc_id DESC LIMIT 40) d
LEFT JOIN (SELECT doc_id, count(*) AS n FROM cit WHERE trim(split_part(citation, '(', 1)) IN (SELECT is_base FROM deadb) GROUP BY doc_id) x ON x.doc_id = d.doc_id LEFT JOIN (SELECT DISTINCT doc_id FROM cit) c ON c.doc_id = d.doc_id""",
    _REG,
)
def tender_list(spark, sf):
    """A page of one year's documents that a search finds, with titles and how many of their citations are dead now."""
    page = _engine(spark, sf).tenders("Goods", year=1996, sort="doc_id", descending=True, limit=40)
    return page.select("doc_id", "year", "ministry", "department", "title", "title_derived", "dead", "dead_now", "total")


@query("SELECT doc_id, year, ministry, department, demands_mark FROM docs WHERE doc_id = (SELECT min(doc_id) FROM docs)", _REG)
def tender_detail(spark, sf):
    e = _engine(spark, sf)
    return e.tender(e.documents.agg(F.min("doc_id")).first()[0]).select("doc_id", "year", "ministry", "department", "demands_mark")


@query("SELECT o_orderkey AS id, CASE WHEN o_orderkey % 3 = 0 THEN 'draft' WHEN l.c IS NULL THEN 'draft' ELSE 'audit' END AS route FROM orders LEFT JOIN (SELECT doc_id, min(citation) AS c FROM cit GROUP BY doc_id) l ON l.doc_id = o_orderkey", _REG)
def routed_texts(spark, sf):
    """Every order's text, with a citation or without, sent to the audit or to a draft."""
    first = S.citations(spark, sf).groupBy("doc_id").agg(F.min("citation").alias("c"))
    o = table(spark, sf, "orders").select(F.col("o_orderkey").alias("doc_id"), F.col("o_orderpriority").alias("p")).join(first, "doc_id", "left")
    text = F.when(F.col("doc_id") % 3 == 0, F.concat(F.lit("Supply of IST clocks, "), "p")).otherwise(F.concat_ws(" ", F.lit("Cement as in"), "c"))
    return forward.routed(o.select(F.col("doc_id").alias("id"), text.alias("text"))).select("id", "route")


@query("SELECT o_orderstatus AS status, count(*) AS n FROM orders WHERE o_orderkey % 4 <> 1 GROUP BY o_orderstatus")
def usable_population(spark, sf):
    """Statistics over the usable documents only, and over the columns that are there."""
    o = table(spark, sf, "orders").select(F.col("o_orderstatus").alias("status"), F.when(F.col("o_orderkey") % 4 == 1, "Scanned").otherwise("Usable").alias("usability"))
    return tables.projected(tables.usable(o), ["absent", "status"]).groupBy("status").agg(F.count(F.lit(1)).alias("n"))


# ---------------------------------------------------------------- strategies

_WORDS = ("सीमेंट", "केबल तार", "इस्पात पाइप", "जल पंप")
_HINDI = "CASE p_size % 4 " + " ".join(f"WHEN {i} THEN '{w}'" for i, w in enumerate(_WORDS)) + " END || ' ' || split_part(p_name, ' ', 2)"
_INDIC = "'[ऀ-ॿ]+|[a-z0-9]+'"


@query(
    "SELECT query_id, doc, score, CAST(rank AS INTEGER) AS rank FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, doc) AS rank FROM scored) WHERE rank <= 20 AND score > 0",
    f"""{_REG.rstrip()},
texts AS (SELECT is_number AS doc, regexp_extract_all(lower({_HINDI}), {_INDIC}) AS w FROM reg JOIN part ON p_partkey = load_ord),
asked AS (SELECT query_id, term, count(*) AS qf FROM (SELECT p_partkey AS query_id, unnest(regexp_extract_all(lower({_HINDI}), {_INDIC})) AS term FROM part WHERE p_partkey % 20 = 0) GROUP BY ALL),
post AS (SELECT doc, term, count(*) AS tf, any_value(dl) AS dl FROM (SELECT doc, len(w) AS dl, unnest(w) AS term FROM texts) GROUP BY doc, term),
tot AS (SELECT count(*) AS n, avg(len(w)) AS avgdl FROM texts),
raw AS (SELECT term, ln(n - count(*) + 0.5::DOUBLE) - ln(count(*) + 0.5::DOUBLE) AS raw FROM post CROSS JOIN tot GROUP BY term, n),
idf AS (SELECT term, CASE WHEN raw < 0 THEN 0.25::DOUBLE * (SELECT avg(raw) FROM raw) ELSE raw END AS idf FROM raw),
scored AS (SELECT query_id, doc, round(sum(qf * idf * tf * 2.5::DOUBLE / (tf + 1.5::DOUBLE * (0.25::DOUBLE + 0.75::DOUBLE * dl / avgdl))), 6) AS score FROM post JOIN asked USING (term) JOIN idf USING (term) CROSS JOIN tot GROUP BY query_id, doc)
""",
)
def hindi_ranking(spark, sf):
    """Register entries by their Hindi titles, for queries in Devanagari."""
    p = table(spark, sf, "part")
    words = F.element_at(F.array(*map(F.lit, _WORDS)), (F.col("p_size") % 4 + 1).cast("int"))
    title = F.concat(words, F.lit(" "), F.split_part("p_name", F.lit(" "), F.lit(2)))
    reg = S.register(spark, sf).join(p.select(F.col("p_partkey").alias("load_ord"), title.alias("title_hi")), "load_ord")
    asked = Scratch(spark, "hindi").keep(forward.prepared(p.where("p_partkey % 20 = 0").select(F.col("p_partkey").alias("query_id"), title.alias("text"))), "asked")
    return forward.rankings_of(asked, reg)["hindi"]


@query(
    """SELECT query_id, doc, round(1.0::DOUBLE / (1.0::DOUBLE + exp(-(12.0::DOUBLE * (least(rrf / (2 / 61.0::DOUBLE), 1.0::DOUBLE) - 0.55::DOUBLE)))), 6) AS score, rank FROM rrf
UNION ALL SELECT query_id, doc, 0.0::DOUBLE, CAST(10 + row_number() OVER (PARTITION BY query_id ORDER BY n_co DESC, doc) AS INTEGER) FROM (
  SELECT query_id, doc, n_co FROM (SELECT *, row_number() OVER (PARTITION BY query_id, doc ORDER BY hit, via) AS m FROM (
    SELECT query_id, dst AS doc, src AS via, n_co, hit FROM (
      SELECT s.query_id, s.rank AS hit, e.src, e.dst, e.n_co, row_number() OVER (PARTITION BY s.query_id, e.src ORDER BY e.n_co DESC, e.dst) AS r FROM (SELECT * FROM rrf WHERE rank <= 3) s JOIN edges e ON e.src = s.doc) WHERE r <= 5) x
    WHERE NOT EXISTS (SELECT 1 FROM rrf d WHERE d.query_id = x.query_id AND d.doc = x.doc)) WHERE m = 1)""",
    _with(S.EDGES.replace("tot AS", "baskets AS").replace("CROSS JOIN tot", "CROSS JOIN baskets"), _BM25, _DENSE, _RRF),
)
def strategy_graph(spark, sf):
    """The registered strategy that puts the neighbours of the first hits behind a fused shortlist."""
    return ranking.run_strategy("graph_expand", {"bm25": _bm25(spark, sf), "dense": _dense(spark, sf)}, _edges(spark, sf))


_LEXICAL = "rtop AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, doc) AS rank FROM rscore) WHERE rank <= 10)"
_LEXICAL_SCORE = "round(1.0::DOUBLE / (1.0::DOUBLE + exp(-(4.0::DOUBLE * (score / 14.0::DOUBLE - 1.0::DOUBLE)))), 6) AS score"
#: The forward query's SQL with its shortlist fused from two rankings of the register's entries, by words and by vectors.
_FUSED = X._FORWARD.replace(
    _LEXICAL,
    """rl AS (SELECT query_id, doc, rank FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, doc) AS rank FROM rscore) WHERE rank <= 20),
rd AS (SELECT query_id, doc, rank FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, doc) AS rank FROM (
  SELECT q.query_id, r.is_number AS doc, round(list_sum(list_transform(list_zip(v.embedding, w.embedding), lambda x: x[1]::DOUBLE * x[2]::DOUBLE)), 6) AS score
  FROM ask q JOIN embeddings w ON w.vec_id = q.query_id, reg r JOIN embeddings v ON v.vec_id = r.load_ord)) WHERE rank <= 20),
rboth AS (SELECT * FROM rl UNION ALL SELECT * FROM rd),
rn AS (SELECT query_id, CASE WHEN query_id IN (SELECT query_id FROM rl) THEN 1 ELSE 0 END + CASE WHEN query_id IN (SELECT query_id FROM rd) THEN 1 ELSE 0 END AS n FROM ask),
rfused AS (SELECT query_id, doc, round(sum(1.0::DOUBLE / (60 + rank)), 9) AS rrf FROM rboth GROUP BY query_id, doc),
rtop AS (SELECT query_id, doc, round(1.0::DOUBLE / (1.0::DOUBLE + exp(-(12.0::DOUBLE * (least(rrf * 61.0::DOUBLE / n, 1.0::DOUBLE) - 0.55::DOUBLE)))), 6) AS score
  FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY rrf DESC, doc) AS rank FROM rfused) JOIN rn USING (query_id) WHERE rank <= 10)""",
).replace(_LEXICAL_SCORE, "score")


def _forward_fused(spark, sf):
    reg, asked = X._asked(spark, sf)
    v = table(spark, sf, "embeddings")
    entries = reg.join(v, F.col("load_ord") == F.col("vec_id")).select(F.col("is_number").alias("doc"), "embedding")
    queries = asked.join(v, F.col("query_id") == F.col("vec_id")).select("query_id", F.col("embedding").alias("query"))
    return forward.recommend(asked, reg, X._numbered_edges(spark, sf), S.rules(spark, sf), (entries, queries))


@query("SELECT query_id, place, doc, title, status, score, voltage, material, role FROM placed WHERE place <= 5", _REG.rstrip() + "," + _FUSED + "\n")
def forward_fused(spark, sf):
    """Candidates for product descriptions, from the register's words and its vectors together; entries and queries without a vector have the words only."""
    return _forward_fused(spark, sf)[0]


@query("SELECT query_id, CASE WHEN reason = 'clear_match' THEN 'recommend' ELSE 'abstain' END AS decision, reason, doc, score, gap FROM ans", _REG.rstrip() + "," + _FUSED + "\n")
def forward_fused_answers(spark, sf):
    return _forward_fused(spark, sf)[1].select("query_id", "decision", "reason", "doc", "score", "gap")


# ---------------------------------------------------------------- pages, translations, applied amendments

_TEXT = "CASE kind WHEN 'dispute_risk' THEN 'Replace ' || citation || ' (' || detail || ').' WHEN 'statutory_omission' THEN 'Require the standard mark for ' || citation || ', ' || detail || '.' ELSE 'Check ' || citation || ': ' || detail || '.' END"


@query(
    f"""SELECT d.doc_id, '<!doctype html><meta charset=utf-8><title>Audit ' || d.doc_id || '</title><h1>Audit of ' || d.doc_id || '</h1><p>1 < 2. Verdict: ' || verdict || ' (' || high || ' high, ' || medium || ' medium, 0 low).</p>'
  || coalesce('<table><tr><th>Citation</th><th>Finding</th><th>Severity</th><th>Action</th></tr>' || lines || '</table>', '<p>No findings.</p>') AS page FROM (
  SELECT d.doc_id, count(*) FILTER (WHERE severity = 'high') AS high, count(*) FILTER (WHERE severity = 'medium') AS medium, CASE WHEN count(*) FILTER (WHERE severity = 'high') > 0 THEN 'blocking' WHEN count(severity) > 0 THEN 'review' ELSE 'clean' END AS verdict,
    string_agg('<tr><td>' || citation || '</td><td>' || kind || '</td><td>' || severity || '</td><td>' || {_TEXT} || '</td></tr>', '' ORDER BY CASE severity WHEN 'high' THEN 0 ELSE 1 END, kind, citation) AS lines
  FROM docs d LEFT JOIN found USING (doc_id) GROUP BY d.doc_id) d""",
    _REG + ",\n" + _FOUND + "\n",
)
def report_texts(spark, sf):
    """The printable page of every document's audit, whole."""
    docs = S.documents(spark, sf)
    found = audit.findings(S.citations(spark, sf), S.register(spark, sf), S.rules(spark, sf), docs)
    return presentation.report(audit.verdicts(docs, found), audit.suggestions(found), "1 < 2")


@query("SELECT p_partkey AS id, 'SUPPLY OF 11 kV ' || upper(p_name) AS translation FROM part")
def translations_filled(spark, sf):
    """Titles translated in two runs by a stand-in that raises letters: the second run finds the first one's in the cache and asks for the rest."""
    p = table(spark, sf, "part").select(F.col("p_partkey").alias("id"), F.concat(F.lit("supply of 11 kV "), "p_name").alias("text"), F.lit("xx").alias("language"))
    s, nothing = Scratch(spark, "cache"), spark.createDataFrame([], "text string, language string, translation string")
    raised = lambda texts, language: [t.upper() for t in texts]
    _, first = clauses.translated(p.where("id % 2 = 0"), nothing, raised)
    first.select("text", "language", "translation").write.parquet(f"{s.root}/c")
    every, fresh = clauses.translated(p, spark.read.parquet(f"{s.root}/c"), raised)
    fresh.select("text", "language", "translation").write.mode("append").parquet(f"{s.root}/c")
    return every.select("id", "translation")


@query("SELECT is_number, CASE WHEN load_ord % 7 = 0 THEN 'Withdrawn' ELSE status END AS status, CASE WHEN load_ord % 7 = 0 AND status <> 'Withdrawn' THEN 'portal' ELSE 'given' END AS provenance FROM reg", _REG)
def stream_applied(spark, sf):
    """The register after a stream's differences were applied; the same batch comes twice."""
    reg, s, k = S.register(spark, sf).withColumn("provenance", F.lit("given")), Scratch(spark, "applied"), F.col("load_ord")
    sent = reg.select(F.col("is_number").alias("portal_number"), F.when(k % 7 == 0, "Withdrawn").otherwise(F.col("status")).alias("status"), "year")
    diffs = sinks.BatchTable(spark, f"{s.root}/diffs")
    each = incremental.detect_amendments(reg, diffs, apply=lambda d: merge.apply_amendments(reg, d, "portal").write.mode("overwrite").parquet(f"{s.root}/register"))
    each(sent, 0)
    each(sent, 0)
    return spark.read.parquet(f"{s.root}/register").select("is_number", "status", "provenance")



# ---------------------------------------------------------------- text functions over the tables' own words


@query(
    """SELECT doc_id, CASE WHEN text IS NULL OR length(text) <= 300 THEN text WHEN back > 0 AND 301 - back > 180 THEN left(text, CAST(301 - back AS BIGINT)) ELSE left(text, 300) END AS clipped
FROM (SELECT doc_id, text, strpos(reverse(left(text, 300)), '.') AS back FROM documents)"""
)
def clipped_texts(spark, sf):
    """Every document's text cut as a long query is: behind its last sentence, if that is far enough."""
    return table(spark, sf, "documents").select("doc_id", T.clip_query(F.col("text"), 300).alias("clipped"))


@query("SELECT p_partkey AS id, p_size || ' mm|IS ' || (100 + p_partkey) || CASE WHEN p_partkey % 2 = 0 THEN '|' || p_size || '.5 kV' ELSE '' END AS spans FROM part")
def protected_quantities(spark, sf):
    """Quantities and designations between the words of every part's name, which a translation must not touch."""
    k, size = F.col("p_partkey"), F.col("p_size").cast("string")
    text = F.concat("p_name", F.lit(" of "), size, F.lit(" mm to IS "), (k + 100).cast("string"), F.lit(", "), "p_type", F.when(k % 2 == 0, F.concat(F.lit(" at "), size, F.lit(".5 kV"))).otherwise(""))
    return table(spark, sf, "part").select(k.alias("id"), F.array_join(clauses.protected_spans(text), "|").alias("spans"))


@query(
    r"""SELECT p_partkey AS id, p_size % 4 = 0 OR regexp_matches(p_name || ' ' || p_type, '(?i)\b(service|services|hiring|manpower|repair|transport|printing|training|survey|audit)\b') AS service FROM part"""
)
def service_categories(spark, sf):
    """Whether a category names a service, over the words of all parts' names and types, with a service's word behind every fourth size."""
    words = F.element_at(F.array(*map(F.lit, ("Repair", "housekeeping", "Annual Maintenance", "SURVEY"))), (F.col("p_partkey") % 4 + 1).cast("int"))
    text = F.concat_ws(" ", "p_name", "p_type", F.when(F.col("p_size") % 4 == 0, words))
    return table(spark, sf, "part").select(F.col("p_partkey").alias("id"), T.is_service(text).alias("service"))
