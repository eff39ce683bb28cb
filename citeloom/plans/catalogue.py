"""All queries of the library over the driver's tables, with their SQL where SQL can express them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import designation as D
from ..functions import text as X
from ..operators import association as A
from ..operators import audit, evaluate, health, lookup, merge, paging, ranking, reuse
from ..session import Scratch, table
from ..sources import html_tables, logs
from ..streaming import incremental
from . import synthetic as S

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}


def query(sql: str | None = None, prefix: str = ""):
    def register(f):
        QUERIES[f.__name__] = f
        if sql is not None:
            ORACLE_SQL[f.__name__] = prefix + sql
        return f

    return register


def _with(*parts: str) -> str:
    return "WITH " + ",\n".join(parts) + "\n"


_REG, _EDGES = S.SQL, _with(S.EDGES)


def _edges(spark: SparkSession, sf: str) -> DataFrame:
    li = table(spark, sf, "lineitem").select(F.col("l_orderkey").alias("basket"), F.col("l_partkey").alias("item"))
    return A.cocitation_edges(li, min_co=2, min_confidence=0.05, min_src=1)


def _kept_edges(spark: SparkSession, sf: str) -> DataFrame:
    """The edges as a written table, for queries that read them several times."""
    return Scratch(spark, "edges").keep(_edges(spark, sf), "edges")


# ---------------------------------------------------------------- association graph


@query("SELECT * FROM edges", _EDGES)
def cocitation_edges(spark, sf):
    return _edges(spark, sf)


_BEST = "best AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY least(src, dst), greatest(src, dst) ORDER BY confidence DESC, src) AS rn FROM edges) WHERE rn = 1)"


@query("SELECT src, dst, n_src, n_dst, n_co, confidence, lift FROM best", _with(S.EDGES, _BEST))
def cocitation_undirected_best(spark, sf):
    return A.undirected_best(_edges(spark, sf))


_CAP = """ends AS (SELECT src, dst, n_co, src AS e FROM best UNION ALL SELECT src, dst, n_co, dst FROM best),
kept AS (SELECT DISTINCT src, dst FROM (SELECT *, row_number() OVER (PARTITION BY e ORDER BY n_co DESC, src, dst) AS r FROM ends) WHERE r <= 3)"""


@query("SELECT b.src, b.dst, n_co FROM best b JOIN kept k ON b.src = k.src AND b.dst = k.dst", _with(S.EDGES, _BEST, _CAP))
def cocitation_edge_cap(spark, sf):
    return A.cap_edges(A.undirected_best(_edges(spark, sf)), 3).select("src", "dst", "n_co")


@query("SELECT node, count(*) AS degree FROM (SELECT src AS node FROM edges UNION ALL SELECT dst FROM edges) GROUP BY node ORDER BY degree DESC, node LIMIT 20", _EDGES)
def node_degree_top(spark, sf):
    return A.degrees(_edges(spark, sf)).orderBy(F.desc("degree"), "node").limit(20)


@query("SELECT src, dst, confidence, n_co, rank FROM (SELECT *, CAST(row_number() OVER (PARTITION BY src ORDER BY confidence DESC, n_co DESC, dst) AS INTEGER) AS rank FROM edges) WHERE rank <= 5", _EDGES)
def related_standards(spark, sf):
    return A.related(_edges(spark, sf), 5).select("src", "dst", "confidence", "n_co", "rank")


_SEEDS = "seeds AS (SELECT node FROM (SELECT src AS node, count(*) AS n FROM edges GROUP BY src) ORDER BY n DESC, node LIMIT 5)"


def _seeds(e: DataFrame) -> DataFrame:
    return e.groupBy(F.col("src").alias("node")).agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), "node").limit(5).select("node")


@query(
    """SELECT src, dst, n_co, confidence, min(hop) AS hop FROM (
  SELECT t.*, 1 AS hop FROM top t WHERE src IN (SELECT node FROM seeds)
  UNION ALL SELECT t.*, 2 FROM top t WHERE src IN (SELECT dst FROM top WHERE src IN (SELECT node FROM seeds)) AND src NOT IN (SELECT node FROM seeds)) GROUP BY ALL""".replace("GROUP BY ALL", "GROUP BY src, dst, n_co, confidence"),
    _with(S.EDGES, _SEEDS, "top AS (SELECT src, dst, n_co, confidence FROM (SELECT *, row_number() OVER (PARTITION BY src ORDER BY confidence DESC, n_co DESC, dst) AS r FROM edges) WHERE r <= 10)"),
)
def ego_network_depth2(spark, sf):
    e = _kept_edges(spark, sf)
    return A.ego_network(e, _seeds(e), depth=2, limit=10)


@query(
    """SELECT seed, node, CAST(min(h) AS INTEGER) AS hops FROM walk GROUP BY seed, node""",
    "WITH RECURSIVE " + ",\n".join([S.EDGES, _SEEDS, "links AS (SELECT src, dst FROM edges UNION SELECT dst, src FROM edges)", "walk AS (SELECT node AS seed, node, 0 AS h FROM seeds UNION SELECT w.seed, l.dst, w.h + 1 FROM walk w JOIN links l ON l.src = w.node WHERE w.h < 3)"]) + "\n",
)
def shortest_path_hops(spark, sf):
    e = _kept_edges(spark, sf)
    return A.hops(e, _seeds(e), depth=3)


@query(
    """SELECT k.src, k.dst, n_co, a.d AS src_degree, b.d AS dst_degree FROM kept2 k
JOIN deg a ON a.node = k.src JOIN deg b ON b.node = k.dst""",
    _with(
        S.EDGES,
        "e0 AS (SELECT * FROM edges WHERE n_co >= 2)",
        "tops AS (SELECT node FROM (SELECT node, count(*) AS d FROM (SELECT src AS node FROM e0 UNION ALL SELECT dst FROM e0) GROUP BY node) ORDER BY d DESC, node LIMIT 200)",
        "e1 AS (SELECT * FROM e0 WHERE src IN (SELECT node FROM tops) AND dst IN (SELECT node FROM tops) ORDER BY n_co DESC, src, dst LIMIT 500)",
        "best AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY least(src, dst), greatest(src, dst) ORDER BY confidence DESC, src) AS rn FROM e1) WHERE rn = 1)",
        _CAP,
        "kept2 AS (SELECT b.* FROM best b JOIN kept k ON b.src = k.src AND b.dst = k.dst)",
        "deg AS (SELECT node, count(*) AS d FROM (SELECT src AS node FROM kept2 UNION ALL SELECT dst FROM kept2) GROUP BY node)",
    ),
)
def full_graph(spark, sf):
    return A.full_graph(_kept_edges(spark, sf), 200, 500, 2, 3).select("src", "dst", "n_co", "src_degree", "dst_degree")


# ---------------------------------------------------------------- resolution, coverage, dead citations


@query("SELECT doc_id, pos, c.citation, hit, matched_by FROM cit c JOIN res USING (citation)", _REG)
def resolve_designations(spark, sf):
    return lookup.resolve(S.citations(spark, sf).select("doc_id", "pos", "citation"), S.register(spark, sf), [])


@query("SELECT count(*) AS distinct_cited, count(hit) AS matched, round(100.0::DOUBLE * count(hit) / count(*), 6) AS coverage_pct FROM res", _REG)
def coverage_stats(spark, sf):
    return lookup.coverage_stats(S.citations(spark, sf), S.register(spark, sf))


@query("SELECT trim(split_part(citation, '(', 1)) AS is_number, count(DISTINCT doc_id) AS documents FROM cit WHERE citation IN (SELECT citation FROM res WHERE hit IS NULL) GROUP BY 1", _REG)
def coverage_backlog(spark, sf):
    return lookup.backlog(S.citations(spark, sf), S.register(spark, sf))


@query("SELECT d.year, count(DISTINCT doc_id) AS documents, count(*) AS citations FROM cit JOIN docs d USING (doc_id) WHERE trim(split_part(citation, '(', 1)) IN (SELECT is_base FROM deadb) GROUP BY d.year", _REG)
def dead_citation_documents(spark, sf):
    dead = lookup.dead_citations(S.citations(spark, sf), S.register(spark, sf))
    return dead.join(S.documents(spark, sf).select("doc_id", "year"), "doc_id").groupBy("year").agg(F.countDistinct("doc_id").alias("documents"), F.count(F.lit(1)).alias("citations"))


@query("""SELECT r.citation, hit IS NOT NULL AS found, coalesce(status <> 'Current', false) AS dead, status,
  CASE WHEN status <> 'Current' THEN coalesce(replaced_by, 'UNKNOWN') END AS replaced_by FROM res r LEFT JOIN reg ON hit = is_number""", _REG)
def check_dead_citation(spark, sf):
    return lookup.check_dead(S.citations(spark, sf).select("citation").distinct(), S.register(spark, sf)).select("citation", "found", "dead", "status", "replaced_by")


@query("""SELECT s.citation, coalesce(a.is_number, b.n) AS rule, coalesce(a.mandatory, b.m) AS mandatory FROM spelled s LEFT JOIN rules a ON s.citation = a.is_number
LEFT JOIN (SELECT is_base, arg_min(is_number, load_ord) AS n, arg_min(mandatory, load_ord) AS m FROM rules GROUP BY is_base) b ON s.k1 = b.is_base""", _REG)
def check_certification(spark, sf):
    return lookup.certification(S.citations(spark, sf).select("citation").distinct(), S.rules(spark, sf)).select("citation", "rule", "mandatory")


@query("""SELECT r.is_number, r.title, r.status, u.mandatory, count(DISTINCT c.doc_id) AS documents FROM reg r LEFT JOIN rules u USING (is_number)
LEFT JOIN (SELECT hit, doc_id FROM cit JOIN res USING (citation)) c ON c.hit = r.is_number GROUP BY ALL""".replace("GROUP BY ALL", "GROUP BY r.is_number, r.title, r.status, u.mandatory"), _REG)
def standard_detail(spark, sf):
    reg = S.register(spark, sf)
    hits = lookup.resolve(S.citations(spark, sf), reg, []).where("hit IS NOT NULL").groupBy(F.col("hit").alias("is_number")).agg(F.countDistinct("doc_id").alias("documents"))
    out = reg.join(S.rules(spark, sf).select("is_number", "mandatory"), "is_number", "left").join(hits, "is_number", "left")
    return out.select("is_number", "title", "status", "mandatory", F.coalesce("documents", F.lit(0)).cast("long").alias("documents"))


@query("""SELECT c.doc_id, count(*) AS citations, count(*) FILTER (WHERE trim(split_part(citation, '(', 1)) IN (SELECT is_base FROM deadb)) AS dead,
  CASE WHEN count(*) FILTER (WHERE trim(split_part(citation, '(', 1)) IN (SELECT is_base FROM deadb)) > 0 THEN 'Yes' ELSE 'No' END AS dead_now FROM cit c GROUP BY c.doc_id""", _REG)
def list_documents_dead_now(spark, sf):
    c = S.citations(spark, sf).withColumn("is_base", D.is_base(F.col("citation")))
    c = c.join(lookup.dead_bases(S.register(spark, sf)).withColumn("d", F.lit(1)), "is_base", "left").groupBy("doc_id").agg(F.count(F.lit(1)).alias("citations"), F.count("d").alias("dead"))
    return c.withColumn("dead_now", F.when(F.col("dead") > 0, "Yes").otherwise("No"))


# ---------------------------------------------------------------- health


def _fact(spark, sf):
    return health.fact(S.citations(spark, sf), S.documents(spark, sf), S.register(spark, sf), S.mandatory(spark, sf))


@query("""SELECT count(DISTINCT doc_id) AS documents, count(DISTINCT doc_id) FILTER (WHERE dead) AS documents_dead,
  round(100.0::DOUBLE * count(DISTINCT doc_id) FILTER (WHERE dead) / count(DISTINCT doc_id), 6) AS dead_pct, count(DISTINCT base) FILTER (WHERE dead) AS dead_standards FROM fact""", _REG)
def health_headline(spark, sf):
    return health.headline(_fact(spark, sf))


_BY = "SELECT {0}, count(*) AS documents, count(*) FILTER (WHERE dead) AS documents_dead FROM (SELECT {0}, doc_id, bool_or(dead) AS dead FROM fact GROUP BY {0}, doc_id) GROUP BY {0}"


@query(_BY.format("year"), _REG)
def health_by_year(spark, sf):
    return health.by(_fact(spark, sf), "year")


@query(_BY.format("department"), _REG)
def health_by_family(spark, sf):
    return health.by(_fact(spark, sf), "department")


@query("""SELECT b.*, base AS top_dead, n AS top_dead_documents FROM (""" + _BY.format("ministry") + """) b LEFT JOIN (
  SELECT * FROM (SELECT ministry, base, n, row_number() OVER (PARTITION BY ministry ORDER BY n DESC, base) AS r FROM
    (SELECT ministry, base, count(DISTINCT doc_id) AS n FROM fact WHERE dead GROUP BY ministry, base)) WHERE r = 1) t USING (ministry)
WHERE documents >= 10 ORDER BY documents_dead DESC, documents DESC, ministry LIMIT 15""".replace("SELECT b.*, base", "SELECT ministry, documents, documents_dead, base"), _REG)
def health_buyers_top_dead(spark, sf):
    return health.buyers(_fact(spark, sf), "ministry")


_KIND = "SELECT '{0}' AS kind, CAST({0} AS VARCHAR) AS key, count(*) AS documents, count(*) FILTER (WHERE dead) AS documents_dead FROM (SELECT {0}, doc_id, bool_or(dead) AS dead FROM fact GROUP BY {0}, doc_id) GROUP BY {0}"


@query(
    f"""SELECT kind, key, documents, documents_dead, top_dead, top_dead_documents FROM (
  SELECT 'all' AS kind, CAST(NULL AS VARCHAR) AS key, count(*) AS documents, count(*) FILTER (WHERE dead) AS documents_dead FROM (SELECT doc_id, bool_or(dead) AS dead FROM fact GROUP BY doc_id)
  UNION ALL {_KIND.format("year")} UNION ALL {_KIND.format("department")} UNION ALL {_KIND.format("ministry")}
  UNION ALL SELECT 'base', base, count(*), count(*) FILTER (WHERE dead) FROM fact GROUP BY base) k
LEFT JOIN (SELECT 'ministry' AS kind, ministry AS key, base AS top_dead, n AS top_dead_documents FROM (SELECT ministry, base, count(*) AS n, row_number() OVER (PARTITION BY ministry ORDER BY count(*) DESC, base) AS r FROM fact WHERE dead GROUP BY ministry, base) WHERE r = 1) t USING (kind, key)""",
    _REG,
)
def health_profile(spark, sf):
    return health.profile(_fact(spark, sf), ("year", "department"), "ministry")


@query("SELECT base, count(DISTINCT doc_id) AS documents FROM fact WHERE dead GROUP BY base", _REG)
def health_dead_rank(spark, sf):
    return health.ranked(_fact(spark, sf), dead_only=True)


@query("SELECT base, count(DISTINCT doc_id) AS documents FROM fact GROUP BY base ORDER BY documents DESC, base LIMIT 15", _REG)
def health_demand_rank(spark, sf):
    return health.ranked(_fact(spark, sf), dead_only=False, limit=15)


@query("""SELECT count(*) AS cited, count(*) FILTER (WHERE m IS NULL) AS unknown, count(*) FILTER (WHERE m = 'Yes') AS demanded, count(*) FILTER (WHERE m = 'No') AS gap,
  round(100.0::DOUBLE * count(*) FILTER (WHERE m = 'No') / count(m), 6) AS gap_pct FROM (SELECT doc_id, any_value(demands_mark) AS m FROM fact WHERE mandatory GROUP BY doc_id)""", _REG)
def certification_gap(spark, sf):
    return health.certification_gap(_fact(spark, sf))


# ---------------------------------------------------------------- lists, facets, counts


@query("SELECT status AS value, count(*) AS n FROM reg GROUP BY status", _REG)
def status_counts(spark, sf):
    return paging.count_by(S.register(spark, sf), "status")


@query("SELECT CAST(year // 10 * 10 AS VARCHAR) AS decade, count(*) AS n FROM reg GROUP BY 1", _REG)
def decade_histogram(spark, sf):
    return paging.decades(S.register(spark, sf), "year")


@query("SELECT DISTINCT 'family' AS facet, family AS value FROM reg UNION SELECT DISTINCT 'status', status FROM reg", _REG)
def facets(spark, sf):
    return paging.facets(S.register(spark, sf), ["family", "status"])


@query("SELECT is_number, title, family, status FROM reg WHERE status = 'Current' AND (contains(lower(title), 'bolt') OR contains(lower(family), 'bolt')) ORDER BY title, is_number LIMIT 25 OFFSET 10", _REG)
def search_page(spark, sf):
    r = paging.search(paging.equal_filters(S.register(spark, sf), {"status": "Current", "family": ""}), "Bolt", ["title", "family"], "is_digits")
    return paging.page(r.select("is_number", "title", "family", "status"), ["title", "is_number"], 25, 10)


@query("SELECT 'standards' AS name, count(*) AS n FROM reg UNION ALL SELECT 'documents', count(*) FROM docs UNION ALL SELECT 'citations', count(*) FROM cit UNION ALL SELECT 'rules', count(*) FROM rules", _REG)
def corpus_stats(spark, sf):
    out = None
    for name, df in (("standards", S.register(spark, sf)), ("documents", S.documents(spark, sf)), ("citations", S.citations(spark, sf)), ("rules", S.rules(spark, sf))):
        one = df.agg(F.count(F.lit(1)).alias("n")).select(F.lit(name).alias("name"), "n")
        out = one if out is None else out.unionByName(one)
    return out


@query("""SELECT citation AS is_number, count(DISTINCT doc_id) AS documents, round(100.0::DOUBLE * count(DISTINCT doc_id) / (SELECT count(DISTINCT doc_id) FROM cit), 6) AS share_pct FROM
(SELECT DISTINCT item AS citation, doc_id FROM cit) GROUP BY citation""", _REG)
def corpus_evidence(spark, sf):
    c = S.citations(spark, sf).select("doc_id", F.concat(F.lit("IS "), D.citation_digits(F.col("citation"))).alias("is_number"))
    total = c.agg(F.countDistinct("doc_id").alias("t"))
    g = c.groupBy("is_number").agg(F.countDistinct("doc_id").alias("documents")).crossJoin(F.broadcast(total))  # one row
    return g.select("is_number", "documents", F.round(100.0 * F.col("documents") / F.col("t"), 6).alias("share_pct"))


# ---------------------------------------------------------------- retrieval

_TOK = "regexp_extract_all(lower(coalesce(text, '')), '[a-z0-9]+')"
_BM25 = f"""asked AS (SELECT item_id AS query_id, term, count(*) AS qf FROM (SELECT item_id, unnest({_TOK}) AS term FROM benchmark) GROUP BY item_id, term),
size AS (SELECT doc_id AS doc, len({_TOK}) AS dl FROM documents),
post AS (SELECT doc, term, count(*) AS tf FROM (SELECT doc_id AS doc, unnest({_TOK}) AS term FROM documents) GROUP BY doc, term),
tot AS (SELECT count(*) AS n, avg(dl) AS avgdl FROM size),
raw AS (SELECT term, ln(n - count(*) + 0.5::DOUBLE) - ln(count(*) + 0.5::DOUBLE) AS raw FROM post CROSS JOIN tot GROUP BY term, n),
idf AS (SELECT term, CASE WHEN raw < 0 THEN 0.25::DOUBLE * (SELECT avg(raw) FROM raw) ELSE raw END AS idf FROM raw),
scored AS (SELECT query_id, doc, round(sum(qf * idf * tf * 2.5::DOUBLE / (tf + 1.5::DOUBLE * (0.25::DOUBLE + 0.75::DOUBLE * dl / avgdl))), 6) AS score
  FROM post JOIN asked USING (term) JOIN idf USING (term) JOIN size USING (doc) CROSS JOIN tot GROUP BY query_id, doc),
bm AS (SELECT * FROM (SELECT *, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, doc) AS INTEGER) AS rank FROM scored) WHERE rank <= 20)"""
_DENSE = """dn AS (SELECT * FROM (SELECT *, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, doc) AS INTEGER) AS rank FROM (
  SELECT q.vec_id AS query_id, v.vec_id AS doc, round(list_sum(list_transform(list_zip(v.embedding, q.embedding), lambda x: x[1]::DOUBLE * x[2]::DOUBLE)), 6) AS score
  FROM embeddings v JOIN (SELECT * FROM embeddings WHERE vec_id % 20 = 0) q ON v.vec_id <> q.vec_id)) WHERE rank <= 20)"""


def _bm25(spark, sf, k=ranking.DEPTH):
    return ranking.bm25(table(spark, sf, "documents"), table(spark, sf, "benchmark"), k)


def _dense(spark, sf, k=ranking.DEPTH):
    """Every vector whose id is divisible by 20 against all others."""
    v = table(spark, sf, "embeddings")
    q = v.where("vec_id % 20 = 0").select(F.col("vec_id").alias("query_id"), F.col("embedding").alias("query"))
    return ranking.dense(v, q, k)


@query("SELECT query_id, doc, score, rank FROM bm", _with(_BM25))
def bm25_topk(spark, sf):
    return _bm25(spark, sf)


@query("SELECT query_id, doc, score, rank FROM dn", _with(_DENSE))
def dense_topk(spark, sf):
    return _dense(spark, sf)


_RRF = "fused AS (SELECT query_id, doc, round(sum(1.0::DOUBLE / (60 + rank)), 9) AS rrf FROM (SELECT query_id, doc, rank FROM bm UNION ALL SELECT query_id, doc, rank FROM dn) GROUP BY query_id, doc), rrf AS (SELECT * FROM (SELECT *, CAST(row_number() OVER (PARTITION BY query_id ORDER BY rrf DESC, doc) AS INTEGER) AS rank FROM fused) WHERE rank <= 10)"


def _fused(spark, sf):
    return ranking.fuse([_bm25(spark, sf).select("query_id", "doc", "rank"), _dense(spark, sf).select("query_id", "doc", "rank")])


@query("SELECT query_id, doc, rrf, rank FROM rrf", _with(_BM25, _DENSE, _RRF))
def rrf_fusion(spark, sf):
    return _fused(spark, sf)


@query(
    """SELECT query_id, doc, score, gap, CASE WHEN reason = 'clear_match' THEN 'recommend' ELSE 'abstain' END AS decision, reason FROM (
  SELECT *, CASE WHEN score < 0.45 THEN 'no_close_match' WHEN score < 0.8 AND gap < 0.1 THEN 'ambiguous' ELSE 'clear_match' END AS reason FROM (
    SELECT *, round(score - coalesce(lead(score) OVER (PARTITION BY query_id ORDER BY rank), 0), 6) AS gap FROM (
      SELECT query_id, doc, rank, round(1.0::DOUBLE / (1.0::DOUBLE + exp(-(4.0::DOUBLE * (score / 14.0::DOUBLE - 1.0::DOUBLE)))), 6) AS score FROM bm)) WHERE rank = 1)""",
    _with(_BM25),
)
def hybrid_gate(spark, sf):
    return ranking.gate(_bm25(spark, sf).withColumn("score", F.round(ranking.calibrated("lexical", F.col("score")), 6)))


@query(
    """SELECT query_id, doc, via, n_co FROM (SELECT *, row_number() OVER (PARTITION BY query_id, doc ORDER BY hit, via) AS m FROM (
  SELECT query_id, dst AS doc, src AS via, n_co, hit FROM (
    SELECT s.query_id, s.rank AS hit, e.src, e.dst, e.n_co, row_number() OVER (PARTITION BY s.query_id, e.src ORDER BY e.n_co DESC, e.dst) AS r
    FROM (SELECT * FROM dn WHERE rank <= 3) s JOIN edges e ON e.src = s.doc) WHERE r <= 5) x
  WHERE NOT EXISTS (SELECT 1 FROM dn d WHERE d.query_id = x.query_id AND d.doc = x.doc)) WHERE m = 1""",
    _with(S.EDGES, _DENSE),
)
def graph_expand(spark, sf):
    return ranking.expand_by_graph(_dense(spark, sf), _edges(spark, sf))


_REL = "rel AS (SELECT d.query_id, d.rank, d.score, a.label = b.label AS ok FROM dn d JOIN embeddings a ON a.vec_id = d.query_id JOIN embeddings b ON b.vec_id = d.doc)"


def _relevant(spark, sf):
    v = table(spark, sf, "embeddings").select("vec_id", "label")
    d = _dense(spark, sf).join(v.select(F.col("vec_id").alias("query_id"), F.col("label").alias("a")), "query_id")
    return d.join(v.select(F.col("vec_id").alias("doc"), F.col("label").alias("b")), "doc").withColumn("ok", F.col("a") == F.col("b"))


@query(
    """SELECT count(*) AS queries, CAST(sum(r1) AS BIGINT) AS rank_1, CAST(sum(rk) AS BIGINT) AS recall_hits, round(sum(r1)::DOUBLE / count(*), 6) AS recall_at_1,
  round(sum(rk)::DOUBLE / count(*), 6) AS recall_at_k, round(sum(p5)::DOUBLE / (5.0::DOUBLE * count(*)), 6) AS precision_at_5 FROM (
  SELECT query_id, max(CASE WHEN rank = 1 AND ok THEN 1 ELSE 0 END) AS r1, max(CASE WHEN rank <= 10 AND ok THEN 1 ELSE 0 END) AS rk, sum(CASE WHEN rank <= 5 AND ok THEN 1 ELSE 0 END) AS p5 FROM rel GROUP BY query_id)""",
    _with(_DENSE, _REL),
)
def retrieval_metrics(spark, sf):
    return evaluate.retrieval_metrics(_relevant(spark, sf), F.col("ok"), 10)


_BUCKETS = "bk AS (SELECT CAST(least(floor(least(greatest(score, 0), 1) * 10), 9) AS INTEGER) AS bucket, count(*) AS n, count(*) FILTER (WHERE ok) AS correct FROM rel GROUP BY 1)"


def _buckets(spark, sf):
    r = _relevant(spark, sf).withColumn("score", F.least(F.greatest("score", F.lit(0.0)), F.lit(1.0)))
    return evaluate.calibration(r, "score", "ok")


@query("SELECT bucket, n, correct, round(correct::DOUBLE / n, 6) AS accuracy FROM bk", _with(_DENSE, _REL, _BUCKETS))
def calibration_buckets(spark, sf):
    return _buckets(spark, sf)


@query("SELECT CAST(sum(n) AS BIGINT) AS n, round(sum(n * abs(correct::DOUBLE / n - (bucket / 10.0::DOUBLE + 0.05::DOUBLE))) / sum(n), 6) AS ece FROM bk", _with(_DENSE, _REL, _BUCKETS))
def calibration_ece(spark, sf):
    return evaluate.calibration_error(_buckets(spark, sf))


_PAIRED = "a AS (SELECT query_id, bool_or(ok AND rank = 1) AS x FROM rel GROUP BY query_id), b AS (SELECT query_id, bool_or(ok AND rank = 2) AS y FROM rel GROUP BY query_id)"


@query("SELECT count(*) FILTER (WHERE x AND y) AS both, count(*) FILTER (WHERE x AND NOT y) AS only_a, count(*) FILTER (WHERE NOT x AND y) AS only_b, count(*) FILTER (WHERE NOT x AND NOT y) AS neither FROM a JOIN b USING (query_id)", _with(_DENSE, _REL, _PAIRED))
def mcnemar_counts(spark, sf):
    r = _relevant(spark, sf)
    at = lambda k: r.groupBy("query_id").agg(F.max(F.col("ok") & (F.col("rank") == k)).alias("correct"))
    return evaluate.mcnemar(at(1), at(2))


@query(
    """SELECT query_id, item, documents, round(documents::DOUBLE / peers, 6) AS share FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY documents DESC, item) AS r FROM (
  SELECT query_id, peers, item, count(*) AS documents FROM grp JOIN (SELECT DISTINCT l_orderkey AS doc, l_partkey AS item FROM lineitem) USING (doc) GROUP BY query_id, peers, item)) WHERE r <= 12""",
    _with(
        _BM25,
        "grp0 AS (SELECT *, max(score) OVER (PARTITION BY query_id) AS best FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, doc) AS r FROM scored WHERE score > 0) WHERE r <= 30)",
        "grp AS (SELECT * FROM (SELECT *, count(*) OVER (PARTITION BY query_id) AS peers FROM grp0 WHERE score >= 0.35::DOUBLE * best) WHERE peers >= 3)",
    ),
)
def peer_citations(spark, sf):
    c = table(spark, sf, "lineitem").select(F.col("l_orderkey").alias("doc"), F.col("l_partkey").alias("item"))
    return ranking.peers(_bm25(spark, sf, ranking.PEER_DOCUMENTS), c)


_TITLE = "p_name || ' of ' || (CASE p_partkey % 4 WHEN 0 THEN 'mild steel' WHEN 1 THEN 'HDPE' WHEN 2 THEN 'rubber' ELSE 'wood' END) || (CASE p_partkey % 3 WHEN 0 THEN ' for voltages up to and including ' || p_size || ' kV' WHEN 1 THEN ', code of practice' ELSE '' END)"


@query(
    f"""SELECT p_partkey AS doc, title, voltage, material, role, status, score, CAST(row_number() OVER (ORDER BY
  CASE voltage WHEN 'in_band' THEN 0 WHEN 'not_declared' THEN 1 ELSE 2 END, CASE material WHEN 'match' THEN 0 WHEN 'not_declared' THEN 1 ELSE 2 END,
  CASE role WHEN 'match' THEN 0 ELSE 1 END, CASE status WHEN 'Current' THEN 0 WHEN 'Superseded' THEN 1 ELSE 2 END, score DESC, p_partkey) AS INTEGER) AS place FROM (
  SELECT p_partkey, {_TITLE} AS title, CASE WHEN p_partkey % 3 <> 0 THEN 'not_declared' WHEN p_size >= 11 THEN 'in_band' ELSE 'out_of_band' END AS voltage,
  CASE p_partkey % 4 WHEN 0 THEN 'match' WHEN 3 THEN 'not_declared' ELSE 'different_material' END AS material,
  CASE WHEN p_partkey % 3 = 1 THEN 'wrong_kind' ELSE 'match' END AS role,
  CASE WHEN p_partkey % 10 < 2 THEN 'Withdrawn' WHEN p_partkey % 10 = 2 THEN 'Superseded' ELSE 'Current' END AS status, p_retailprice AS score FROM part)"""
)
def constraint_ranking(spark, sf):
    title = F.expr(_TITLE)
    k, q = F.col("p_partkey"), F.lit("mild steel cable for 650 V or 11 kV")
    status = F.when(k % 10 < 2, "Withdrawn").when(k % 10 == 2, "Superseded").otherwise("Current")
    c = table(spark, sf, "part").select(F.lit(1).alias("query_id"), k.alias("doc"), title.alias("title"), status.alias("status"), F.col("p_retailprice").alias("score"))
    c = c.withColumns({"voltage": X.voltage_verdict(q, F.col("title")), "material": X.material_verdict(q, F.col("title")), "role": X.role_verdict(q, F.col("title"))})
    return ranking.order_candidates(c).select("doc", "title", "voltage", "material", "role", "status", "score", "place")


# ---------------------------------------------------------------- audit


@query(
    """SELECT u.number, k.candidate FROM (SELECT DISTINCT CAST(p_partkey * 7 AS VARCHAR) AS number FROM part) u
JOIN (SELECT DISTINCT CAST(p_partkey + 100 AS VARCHAR) AS candidate FROM part) k ON abs(length(number) - length(candidate)) <= 1 AND damerau_levenshtein(number, candidate) = 1"""
)
def near_numbers(spark, sf):
    p = table(spark, sf, "part")
    return audit.near_numbers(p.select((F.col("p_partkey") * 7).cast("string").alias("number")), p.select((F.col("p_partkey") + 100).cast("string").alias("candidate")))


@query(
    """SELECT doc_id, number, candidate, strength FROM (SELECT *, row_number() OVER (PARTITION BY doc_id, number ORDER BY strength DESC, candidate) AS r FROM (
  SELECT u.doc_id, u.number, k.number AS candidate, CAST(sum(e.n_co) AS BIGINT) AS strength FROM un u JOIN known k ON abs(length(u.number) - length(k.number)) <= 1 AND damerau_levenshtein(u.number, k.number) = 1
  JOIN (SELECT DISTINCT doc_id, number FROM ct) c ON c.doc_id = u.doc_id JOIN es e ON e.a = k.number AND e.b = c.number GROUP BY u.doc_id, u.number, k.number)) WHERE r = 1""",
    _with(
        S.EDGES,
        "ct AS (SELECT l_orderkey AS doc_id, CAST(l_partkey AS VARCHAR) AS number FROM lineitem WHERE l_partkey % 10 <> 3)",
        "un AS (SELECT DISTINCT l_orderkey AS doc_id, CAST(l_partkey AS VARCHAR) AS number FROM lineitem WHERE l_partkey % 10 = 3)",
        "known AS (SELECT DISTINCT CAST(p_partkey AS VARCHAR) AS number FROM part WHERE p_partkey % 10 <> 3)",
        "es AS (SELECT a, b, max(n_co) AS n_co FROM (SELECT CAST(src AS VARCHAR) AS a, CAST(dst AS VARCHAR) AS b, n_co FROM edges UNION ALL SELECT CAST(dst AS VARCHAR), CAST(src AS VARCHAR), n_co FROM edges) GROUP BY a, b)",
    ),
)
def did_you_mean(spark, sf):
    li = table(spark, sf, "lineitem").select(F.col("l_orderkey").alias("doc_id"), F.col("l_partkey").cast("string").alias("number"), (F.col("l_partkey") % 10 == 3).alias("gone"))
    reg = table(spark, sf, "part").where("p_partkey % 10 <> 3").select(F.col("p_partkey").cast("string").alias("number"))
    e = _edges(spark, sf).select(F.col("src").cast("string").alias("a"), F.col("dst").cast("string").alias("b"), "n_co")
    return audit.did_you_mean(li.where("gone").select("doc_id", "number").distinct(), li.where("NOT gone").select("doc_id", "number"), reg, e)


@query(
    """SELECT doc_id, dst AS item, src AS source, confidence, n_co FROM (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY confidence DESC, n_co DESC, dst) AS r3 FROM (
  SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY doc_id, dst ORDER BY confidence DESC, n_co DESC, src) AS r2 FROM (
    SELECT * FROM (SELECT c.doc_id, e.src, e.dst, e.confidence, e.n_co, row_number() OVER (PARTITION BY c.doc_id, e.src ORDER BY e.confidence DESC, e.n_co DESC, e.dst) AS r1
      FROM (SELECT DISTINCT l_orderkey AS doc_id, l_partkey AS item FROM lineitem) c JOIN edges e ON e.src = c.item
      WHERE e.dst % 10 > 1 AND e.confidence >= 0.06 AND e.n_co >= 2 AND NOT EXISTS (SELECT 1 FROM lineitem l WHERE l.l_orderkey = c.doc_id AND l.l_partkey = e.dst)) WHERE r1 <= 3)) WHERE r2 = 1)) WHERE r3 <= 8""",
    _EDGES,
)
def missing_connected(spark, sf):
    li = table(spark, sf, "lineitem").select(F.col("l_orderkey").alias("doc_id"), F.col("l_partkey").alias("item"))
    dead = table(spark, sf, "part").where("p_partkey % 10 <= 1").select(F.col("p_partkey").alias("item"))
    return audit.missing_connected(li, _edges(spark, sf), dead, confidence=0.06, support=2)


@query(
    """SELECT doc_id, item, source, confidence, n_co, CAST(row_number() OVER (PARTITION BY doc_id ORDER BY confidence DESC, n_co DESC, first) AS INTEGER) AS place FROM (
  SELECT doc_id, x.item AS item, arg_max(x.source, x.confidence) AS source, max(x.confidence) AS confidence, arg_max(x.n_co, x.confidence) AS n_co, min(x.turn) AS first FROM (
    SELECT doc_id, unnest(taken) AS x FROM (SELECT doc_id, arg_max(taken, n) AS taken FROM fold GROUP BY doc_id)) GROUP BY doc_id, x.item)
QUALIFY row_number() OVER (PARTITION BY doc_id ORDER BY confidence DESC, n_co DESC, first) <= 8""",
    "WITH RECURSIVE " + S.EDGES + """,
own AS (SELECT l_orderkey AS doc_id, l_partkey AS src, min(l_linenumber) AS line FROM lineitem GROUP BY ALL),
strong AS (SELECT *, row_number() OVER (PARTITION BY src ORDER BY confidence DESC, n_co DESC, dst) AS r FROM edges WHERE confidence >= 0.06 AND n_co >= 2),
cand AS (SELECT o.doc_id, e.src, e.dst, e.confidence, e.n_co, row_number() OVER (PARTITION BY o.doc_id ORDER BY o.line, o.src, e.r) AS n FROM own o JOIN strong e ON e.src = o.src
  WHERE e.r <= 12 AND e.dst % 10 > 1 AND NOT EXISTS (SELECT 1 FROM own c WHERE c.doc_id = o.doc_id AND c.src = e.dst)),
fold AS (
  SELECT DISTINCT doc_id, CAST(0 AS BIGINT) AS n, CAST(NULL AS BIGINT) AS src, CAST(0 AS BIGINT) AS kept, CAST([] AS STRUCT(item BIGINT, source BIGINT, confidence DOUBLE, n_co BIGINT, turn BIGINT)[]) AS taken FROM cand
  UNION ALL
  SELECT doc_id, n, src, so_far + CASE WHEN takes THEN 1 ELSE 0 END, CASE WHEN takes THEN list_append(taken, {'item': dst, 'source': src, 'confidence': confidence, 'n_co': n_co, 'turn': n}) ELSE taken END FROM (
    SELECT *, so_far < 3 AND coalesce(list_max(list_transform(list_filter(taken, lambda t: t.item = dst), lambda t: t.confidence)) < confidence, true) AS takes FROM (
      SELECT c.doc_id, CAST(c.n AS BIGINT) AS n, CAST(c.src AS BIGINT) AS src, CAST(c.dst AS BIGINT) AS dst, c.confidence, c.n_co, f.taken, CASE WHEN c.src IS NOT DISTINCT FROM f.src THEN f.kept ELSE 0 END AS so_far
      FROM fold f JOIN cand c ON c.doc_id = f.doc_id AND c.n = f.n + 1)))
""",
)
def missing_in_order(spark, sf):
    li = table(spark, sf, "lineitem").select(F.col("l_orderkey").alias("doc_id"), F.col("l_partkey").alias("item"), F.col("l_linenumber").alias("place"))
    dead = table(spark, sf, "part").where("p_partkey % 10 <= 1").select(F.col("p_partkey").alias("item"))
    return audit.missing_in_order(li, _edges(spark, sf), dead, confidence=0.06, support=2)


_FOUND = """found AS (
  SELECT DISTINCT c.doc_id, 'dispute_risk' AS kind, 'high' AS severity, c.citation, g.status || '; replaced by ' || coalesce(g.replaced_by, 'UNKNOWN') AS detail FROM cit c JOIN res r USING (citation) JOIN reg g ON g.is_number = r.hit WHERE g.status <> 'Current'
  UNION ALL SELECT DISTINCT c.doc_id, 'not_in_register', 'medium', c.citation, 'no entry for number ' || s.k2 FROM cit c JOIN res r USING (citation) JOIN spelled s USING (citation) WHERE hit IS NULL
  UNION ALL SELECT DISTINCT c.doc_id, 'statutory_omission', 'high', c.citation, 'mandatory under ' || coalesce(a.is_number, b.n) FROM cit c JOIN res r USING (citation) JOIN spelled s USING (citation) LEFT JOIN rules a ON c.citation = a.is_number
    LEFT JOIN (SELECT is_base, arg_min(is_number, load_ord) AS n, arg_min(mandatory, load_ord) AS m FROM rules GROUP BY is_base) b ON s.k1 = b.is_base
    WHERE hit IS NOT NULL AND coalesce(a.mandatory, b.m) = 'Yes' AND c.doc_id NOT IN (SELECT doc_id FROM docs WHERE demands_mark = 'Yes'))"""


def _found(spark, sf):
    return audit.findings(S.citations(spark, sf), S.register(spark, sf), S.rules(spark, sf), S.documents(spark, sf))


@query("SELECT * FROM found", _REG + ",\n" + _FOUND + "\n")
def audit_findings(spark, sf):
    return _found(spark, sf)


@query(
    """SELECT d.doc_id, count(*) FILTER (WHERE severity = 'high') AS high, count(*) FILTER (WHERE severity = 'medium') AS medium, count(*) FILTER (WHERE severity = 'low') AS low,
  CASE WHEN count(*) FILTER (WHERE severity = 'high') > 0 THEN 'blocking' WHEN count(severity) > 0 THEN 'review' ELSE 'clean' END AS verdict FROM docs d LEFT JOIN found USING (doc_id) GROUP BY d.doc_id""",
    _REG + ",\n" + _FOUND + "\n",
)
def audit_verdict(spark, sf):
    return audit.verdicts(S.documents(spark, sf), _found(spark, sf))


@query(
    """SELECT doc_id, kind, citation, CASE kind WHEN 'dispute_risk' THEN 'replace' WHEN 'statutory_omission' THEN 'add_clause' ELSE 'unresolved' END AS action,
  CASE kind WHEN 'dispute_risk' THEN 'Replace ' || citation || ' (' || detail || ').' WHEN 'statutory_omission' THEN 'Require the standard mark for ' || citation || ', ' || detail || '.' ELSE 'Check ' || citation || ': ' || detail || '.' END AS text,
  CAST(row_number() OVER (PARTITION BY doc_id ORDER BY CASE severity WHEN 'high' THEN 0 ELSE 1 END, kind, citation) AS INTEGER) AS place FROM found""",
    _REG + ",\n" + _FOUND + "\n",
)
def audit_suggestions(spark, sf):
    return audit.suggestions(_found(spark, sf)).select("doc_id", "kind", "citation", "action", "text", "place")


# ---------------------------------------------------------------- text functions over built texts

_TEXTS = "SELECT o_orderkey AS id, 'Pipes as per IS ' || (1000 + o_orderkey % 700) || ' (Part ' || (1 + o_orderkey % 3) || '), valves to IS:' || (2000 + o_orderkey % 90) || '1995; see relevant IS 10. THIS 20 and IS ' || (1000 + o_orderkey % 700) || ' (part-' || (1 + o_orderkey % 3) || ') again.' AS text FROM orders"


def _texts(spark, sf):
    return table(spark, sf, "orders").select(F.col("o_orderkey").alias("id"), F.expr(_TEXTS[_TEXTS.index("'Pipes") : _TEXTS.index(" AS text")]).alias("text"))


@query(
    f"""SELECT id, CAST(pos AS INTEGER) AS pos, citation FROM (SELECT id, 0 AS pos, regexp_extract(text, '(IS \\d+ \\(Part \\d\\))', 1) AS citation FROM ({_TEXTS})
UNION ALL SELECT id, 1, 'IS ' || regexp_extract(text, 'to IS:(\\d{{4}})1995', 1) FROM ({_TEXTS}))"""
)
def extract_citations(spark, sf):
    return _texts(spark, sf).select("id", F.posexplode(D.extract_citations(F.col("text"))).alias("pos", "c")).select("id", "pos", "c.citation")


@query(f"SELECT id, CASE WHEN id % 2 = 0 THEN [CAST(2000 + id % 90 AS VARCHAR)] ELSE [] END AS leaked FROM (SELECT o_orderkey AS id FROM orders)".replace("[CAST(2000 + id % 90 AS VARCHAR)]", "CAST(2000 + id % 90 AS VARCHAR)").replace("[]", "''"))
def subset_guard(spark, sf):
    n = F.col("o_orderkey")
    text = F.concat(F.lit("Supply to IS "), (F.lit(1000) + n % 700).cast("string"), F.lit(" and IS:"), (F.lit(2000) + n % 90).cast("string"))
    allowed = F.when(n % 2 == 0, F.array(F.concat(F.lit("IS "), (F.lit(1000) + n % 700).cast("string"), F.lit(" (Part 1)")))).otherwise(F.array(F.concat(F.lit("IS "), (F.lit(1000) + n % 700).cast("string")), F.concat(F.lit("IS "), (F.lit(2000) + n % 90).cast("string"))))
    return table(spark, sf, "orders").select(n.alias("id"), F.array_join(X.leaked_designations(text, allowed), ",").alias("leaked"))


@query("SELECT o_orderkey AS id, 'Order (S.O. ' || o_orderkey || ' (E) dated 30-01-2020)' AS head FROM orders")
def primary_notification(spark, sf):
    n = F.col("o_orderkey").cast("string")
    text = F.concat(n, F.lit(".  Order (S.O. "), n, F.lit(" (E) dated 30-01-2020 with more) Superseded by S.O. 9"))
    return table(spark, sf, "orders").select(F.col("o_orderkey").alias("id"), D.primary_notification(text).alias("head"))


@query("SELECT p_partkey AS id, CASE p_partkey % 3 WHEN 0 THEN p_name || ' uPVC pipe unplasticized polyvinyl chloride' WHEN 1 THEN p_name || ' MS plate for earthing mild steel earthing and bonding' ELSE p_name || ' ms plate' END AS expanded FROM part")
def query_expand(spark, sf):
    q = F.concat("p_name", F.when(F.col("p_partkey") % 3 == 0, " uPVC pipe").when(F.col("p_partkey") % 3 == 1, " MS plate for earthing").otherwise(" ms plate"))
    return table(spark, sf, "part").select(F.col("p_partkey").alias("id"), X.expand_query(q).alias("expanded"))


@query("SELECT doc_id, CASE WHEN lang = 'en' AND len(regexp_extract_all(lower(coalesce(text, '')), '[a-z0-9]+')) > 0 THEN 'latin' ELSE 'other' END AS kind, len(regexp_extract_all(lower(coalesce(text, '')), '[a-z0-9]+')) AS n_tokens FROM documents")
def token_counts(spark, sf):
    n = F.size(X.tokens(F.col("text"))).cast("long")
    return table(spark, sf, "documents").select("doc_id", F.when((F.col("lang") == "en") & (n > 0), "latin").otherwise("other").alias("kind"), n.alias("n_tokens"))


# ---------------------------------------------------------------- text reuse

_SETS = """t AS (SELECT doc_id AS doc, regexp_extract_all(lower(coalesce(text, '')), '[a-z0-9]+') AS w FROM documents),
s0 AS (SELECT doc, list_sort(list_distinct(list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i+4], ' ')))) AS h FROM t WHERE len(w) >= 5),
s AS (SELECT doc, h, len(h) AS n FROM s0 WHERE len(h) >= 40),
"""
_SH = (
    _SETS
    + """rep AS (SELECT min(doc) AS doc, h, any_value(n) AS n FROM s GROUP BY h),
x AS (SELECT doc, n, unnest(h) AS g FROM rep),
pairs AS (SELECT a.doc AS a, b.doc AS b, count(*)::DOUBLE / (any_value(a.n) + any_value(b.n) - count(*)) AS jaccard FROM x a JOIN x b ON a.g = b.g AND a.doc < b.doc GROUP BY a.doc, b.doc HAVING count(*)::DOUBLE / (any_value(a.n) + any_value(b.n) - count(*)) >= 0.5
  UNION ALL SELECT r.doc, s.doc, 1.0::DOUBLE FROM s JOIN rep r ON s.h = r.h WHERE s.doc <> r.doc)"""
)
_EVERY = (
    _SETS
    + """x AS (SELECT doc, n, unnest(h) AS g FROM s),
pairs AS (SELECT a.doc AS a, b.doc AS b, count(*)::DOUBLE / (any_value(a.n) + any_value(b.n) - count(*)) AS jaccard FROM x a JOIN x b ON a.g = b.g AND a.doc < b.doc GROUP BY a.doc, b.doc HAVING count(*)::DOUBLE / (any_value(a.n) + any_value(b.n) - count(*)) >= 0.5)"""
)


@query("SELECT a, b, round(jaccard, 6) AS jaccard FROM pairs", _with(_EVERY))
def shingle_jaccard_pairs(spark, sf):
    """Every pair of documents, copies and their links among them."""
    return reuse.jaccard_pairs(reuse.shingled(table(spark, sf, "documents")), 0.5, whole=True).select("a", "b", F.round("jaccard", 6).alias("jaccard"))


@query("SELECT doc, min(o) AS cluster FROM reach GROUP BY doc", "WITH RECURSIVE " + _SH + ",\ne AS (SELECT a, b FROM pairs WHERE jaccard >= 0.8),\nl AS (SELECT a, b FROM e UNION SELECT b, a FROM e),\nreach AS (SELECT a AS doc, a AS o FROM l UNION SELECT l.b, r.o FROM reach r JOIN l ON l.a = r.doc)\n")
def reuse_clusters(spark, sf):
    return reuse.clusters(reuse.jaccard_pairs(reuse.shingled(table(spark, sf, "documents")), 0.8))


@query(
    "SELECT t::DOUBLE AS threshold, count(DISTINCT o) AS clusters, count(*) AS documents FROM (SELECT t, doc, min(o) AS o FROM reach GROUP BY t, doc) GROUP BY t",
    "WITH RECURSIVE " + _SH + ",\ne AS (SELECT t, a, b FROM pairs JOIN (VALUES (0.8), (0.65), (0.5)) v(t) ON jaccard >= t::DOUBLE),\nl AS (SELECT t, a, b FROM e UNION SELECT t, b, a FROM e),\nreach AS (SELECT t, a AS doc, a AS o FROM l UNION SELECT r.t, l.b, r.o FROM reach r JOIN l ON l.a = r.doc AND l.t = r.t)\n",
)
def reuse_threshold_sweep(spark, sf):
    pairs = reuse.jaccard_pairs(reuse.shingled(table(spark, sf, "documents")), 0.5, linking=True)
    return reuse.threshold_sweep(Scratch(spark, "sweep").keep(pairs, "pairs"))


@query("SELECT a, b, round(jaccard, 6) AS jaccard FROM pairs WHERE jaccard >= 0.8", _with(_SH))
def minhash_lsh_pairs(spark, sf):
    """At 0.8 a pair shares none of the 32 bands of 4 rows once in 20 million pairs, so the exact pairs are expected."""
    pairs = reuse.lsh_pairs(reuse.shingled(table(spark, sf, "documents")), 0.8)
    return pairs.select("a", "b", F.round("jaccard", 6).alias("jaccard"))


# ---------------------------------------------------------------- snapshots


@query("SELECT c_custkey AS id, c_name AS name, 'held' AS origin FROM customer WHERE c_custkey % 3 > 0 UNION ALL SELECT c_custkey, c_name, 'new' FROM customer WHERE c_custkey % 3 = 0 AND c_custkey % 5 <> 0")
def additive_merge(spark, sf):
    c = table(spark, sf, "customer").select(F.col("c_custkey").alias("id"), F.col("c_name").alias("name"))
    held = c.where("id % 3 > 0").withColumn("origin", F.lit("held"))
    new = c.where("id % 5 <> 0").withColumn("origin", F.lit("new"))
    return merge.additive_merge(held, new.unionByName(new.withColumn("origin", F.lit("repeat"))).withColumn("o", F.col("origin")), ["id", "name"], "o").select("id", "name", "origin")


@query("SELECT c_custkey AS id, CASE WHEN c_custkey % 4 = 0 THEN c_acctbal * 2 ELSE c_acctbal END AS balance, c_mktsegment AS segment FROM customer")
def owned_upsert(spark, sf):
    m = table(spark, sf, "customer").select(F.col("c_custkey").alias("id"), F.col("c_acctbal").alias("balance"), F.col("c_mktsegment").alias("segment"))
    new = m.where("id % 4 = 0").select("id", (F.col("balance") * 2).alias("balance"))
    return merge.owned_upsert(m, new, "id", ["balance", "segment"])


@query("""SELECT is_number, CASE WHEN load_ord % 7 = 0 AND status <> 'Withdrawn' THEN 'Status' ELSE 'Year' END AS field, CASE WHEN load_ord % 7 = 0 AND status <> 'Withdrawn' THEN status ELSE CAST(year AS VARCHAR) END AS held,
  CASE WHEN load_ord % 7 = 0 AND status <> 'Withdrawn' THEN 'Withdrawn' ELSE CAST(year + 1 AS VARCHAR) END AS portal FROM reg WHERE (load_ord % 7 = 0 AND status <> 'Withdrawn') OR load_ord % 11 = 0""", _REG)
def amendment_diff(spark, sf):
    held = S.register(spark, sf)
    k = F.col("load_ord")
    portal = held.select(F.regexp_replace("is_number", r" \(Part (\d)\)", r" : Part $1").alias("portal_number"), F.when(k % 7 == 0, "Withdrawn").otherwise(F.col("status")).alias("status"), F.when(k % 11 == 0, F.col("year") + 1).otherwise(F.col("year")).alias("year"))
    return merge.amendments(held.select("is_number", "status", "year"), portal)


@query("SELECT 'customer' AS name, CAST(1000000000 AS BIGINT) AS rows_before, count(*) AS rows_now, false AS accepted FROM customer UNION ALL SELECT 'supplier', 1, count(*), true FROM supplier")
def shrink_guard(spark, sf):
    now = None
    for name in ("customer", "supplier"):
        one = table(spark, sf, name).agg(F.count(F.lit(1)).alias("n")).select(F.lit(name).alias("name"), "n")
        now = one if now is None else now.unionByName(one)
    return merge.shrink_guard(now.select("name", F.when(F.col("name") == "customer", 1000000000).otherwise(1).cast("long").alias("n")), now)


@query("SELECT 'only_a' AS side, CAST(item AS VARCHAR) AS item FROM (SELECT DISTINCT item FROM cit EXCEPT SELECT is_base FROM reg) UNION ALL SELECT 'only_b', is_base FROM (SELECT is_base FROM reg EXCEPT SELECT item FROM cit)", _REG)
def invariant_symmetric_difference(spark, sf):
    cited = S.citations(spark, sf).select("item").distinct()
    return merge.symmetric_difference(cited, S.register(spark, sf).select(F.col("is_base").alias("item")).distinct())


@query("SELECT o_custkey AS buyer, o_orderpriority AS value, votes FROM (SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY votes DESC, f) AS r FROM (SELECT o_custkey, o_orderpriority, count(*) AS votes, min(o_orderkey) AS f FROM orders GROUP BY 1, 2)) WHERE r = 1")
def majority_vote(spark, sf):
    o = table(spark, sf, "orders").select(F.col("o_custkey").alias("buyer"), F.col("o_orderpriority").alias("value"), "o_orderkey")
    return merge.majority(o, "buyer", "value", "o_orderkey")


# ---------------------------------------------------------------- pages, logs, evaluation, stream


@query(r"SELECT page_id, trim(regexp_replace(replace(replace(replace(replace(replace(replace(regexp_replace(regexp_replace(html, '(?is)(<script\b.*?</script\s*>|<style\b.*?</style\s*>)', ' ', 'g'), '(?s)<[^>]*>', ' ', 'g'), '&nbsp;', ' '), '&lt;', '<'), '&gt;', '>'), '&quot;', '" + '"' + r"'), '&#39;', ''''), '&amp;', '&'), '\s+', ' ', 'g')) AS text FROM pages")
def html_text(spark, sf):
    return table(spark, sf, "pages").select("page_id", X.plain_text(F.col("html")).alias("text"))


@query("SELECT event_id, user_id, last_value(CASE WHEN event_type = 'purchase' THEN value END IGNORE NULLS) OVER (PARTITION BY user_id ORDER BY event_id ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS heading FROM events")
def carry_down(spark, sf):
    e = table(spark, sf, "events").select("event_id", "user_id", F.when(F.col("event_type") == "purchase", F.col("value")).alias("heading"))
    return html_tables.carry_down(e, "user_id", "event_id", ["heading"])


@query("SELECT stage, k FROM (SELECT event_type AS stage, CAST(json_extract_string(props, '$.k') AS BIGINT) AS k, row_number() OVER (PARTITION BY event_type ORDER BY event_id DESC) AS r FROM events) WHERE r = 1")
def run_log_latest(spark, sf):
    e = table(spark, sf, "events").select("event_id", F.col("event_type").alias("stage"), F.get_json_object("props", "$.k").cast("long").alias("k"))
    return e.groupBy("stage").agg(F.max_by("k", "event_id").alias("k"))


@query("SELECT count(*) AS total, count(*) FILTER (WHERE event_type = 'click') AS accepted, count(*) FILTER (WHERE event_type = 'error') AS rejected, count(*) FILTER (WHERE event_type = 'signup') AS overridden, round(100.0::DOUBLE * count(*) FILTER (WHERE event_type = 'click') / count(*), 6) AS agreement_pct FROM events WHERE event_type IN ('click', 'error', 'signup')")
def decision_agreement(spark, sf):
    verb = F.when(F.col("event_type") == "click", "accepted").when(F.col("event_type") == "error", "rejected").when(F.col("event_type") == "signup", "overridden")
    e = logs.valid_decision(table(spark, sf, "events").select(verb.alias("decision"), F.lit("as logged").alias("rationale")))
    return logs.agreement(e.where("problem IS NULL"))


@query(
    """SELECT count(*) FILTER (WHERE t AND s) AS tp, count(*) FILTER (WHERE NOT t AND s) AS fp, count(*) FILTER (WHERE t AND NOT s) AS fn, count(*) FILTER (WHERE NOT t AND NOT s) AS tn,
  round(count(*) FILTER (WHERE t = s)::DOUBLE / count(*), 6) AS accuracy FROM (SELECT d.doc_id, d.doc_id % 4 = 0 AS t, coalesce(bool_or(f.dead), false) AS s FROM docs d LEFT JOIN fact f USING (doc_id) GROUP BY d.doc_id)""",
    _REG,
)
def benchmark_confusion(spark, sf):
    said = _fact(spark, sf).groupBy("doc_id").agg(F.max("dead").alias("said"))
    d = S.documents(spark, sf).select("doc_id", (F.col("doc_id") % 4 == 0).alias("truth")).join(said, "doc_id", "left")
    return evaluate.confusion(d.withColumn("said", F.coalesce("said", F.lit(False))))


@query("SELECT strftime(date_trunc('day', ts), '%Y-%m-%d') AS day, event_type, count(*) AS n, round(sum(value), 2) AS total FROM events GROUP BY 1, 2")
def events_tumbling(spark, sf):
    e = incremental.tumbling(table(spark, sf, "events"))
    return e.select(F.date_format("start", "yyyy-MM-dd").alias("day"), "event_type", "n", F.round("total", 2).alias("total"))


@query("SELECT strftime(date_trunc('day', ts), '%Y-%m-%d') AS day, event_type, count(*) AS n, round(sum(value), 2) AS total FROM events GROUP BY 1, 2")
def events_stream_tumbling(spark, sf):
    """The same counts through a stream over what the folder holds, with the newest version of the table as the result."""
    src = table(spark, sf, "events")
    s = Scratch(spark, "stream")
    name = f"events_{s.root.rsplit('-', 1)[1]}"
    stream = spark.readStream.schema(src.schema).option("pathGlobFilter", "events.parquet").parquet(sf)
    counts = incremental.tumbling(stream)
    out = f"{s.root}/counts"

    def each(batch: DataFrame, batch_id: int) -> None:
        batch.write.mode("overwrite").parquet(out)

    incremental.run_available(counts, f"{s.root}/{name}", each, mode="complete").awaitTermination()
    e = spark.read.parquet(out)
    return e.select(F.date_format("start", "yyyy-MM-dd").alias("day"), "event_type", "n", F.round("total", 2).alias("total"))
