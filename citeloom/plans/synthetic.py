"""A register and a corpus of citing documents derived from the star tables, as DataFrames and as SQL.

Parts are register entries (two parts of each base, some left out so that gaps exist), orders are documents, line items
are citations spelled in three ways.
"""

from __future__ import annotations

import zlib

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import table


def _numbered(df: DataFrame, key: str) -> DataFrame:
    base = F.concat(F.lit("IS "), (F.lit(1000) + F.floor(F.col(key) / 2)).cast("string"))
    number = F.concat(base, F.lit(" (Part "), (F.lit(1) + F.col(key) % 2).cast("string"), F.lit(")"))
    return df.withColumns({"is_base": base, "is_number": number, "is_digits": (F.lit(1000) + F.floor(F.col(key) / 2)).cast("string")})


def register(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("p_partkey")
    p = _numbered(table(spark, sf_dir, "part"), "p_partkey").where(~(k % 50).isin(8, 9))
    status = F.when(k % 10 < 2, "Withdrawn").when(k % 10 == 2, "Superseded").otherwise("Current")
    replaced = F.when((k % 10 < 3) & (k % 3 > 0), F.concat(F.lit("IS "), (F.lit(1001) + F.floor(k / 2)).cast("string"), F.lit(" (Part 1)")))
    return p.select(k.alias("load_ord"), "is_number", "is_base", "is_digits", F.col("p_name").alias("title"), F.col("p_type").alias("family"), F.col("p_size").alias("size"), status.alias("status"), replaced.alias("replaced_by"), (F.lit(1950) + k % 70).cast("int").alias("year"))


def citations(spark: SparkSession, sf_dir: str) -> DataFrame:
    li = _numbered(table(spark, sf_dir, "lineitem"), "l_partkey")
    how = F.col("l_linenumber") % 3
    c = F.when(how == 0, F.col("is_number")).when(how == 1, F.concat("is_base", F.lit(" (Sec 9)"))).otherwise(F.concat(F.lit("IS:0"), "is_digits", F.lit(" : 1995")))
    return li.select(F.col("l_orderkey").alias("doc_id"), F.col("l_linenumber").alias("pos"), c.alias("citation"), F.col("l_partkey").alias("part"), F.concat(F.lit("IS "), "is_digits").alias("item"))


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    o, c, n = table(spark, sf_dir, "orders"), table(spark, sf_dir, "customer"), table(spark, sf_dir, "nation")
    mark = F.when(F.col("o_orderstatus") == "F", "Yes").when(F.col("o_orderstatus") == "O", "No")
    d = o.join(c, o.o_custkey == c.c_custkey).join(n, F.col("c_nationkey") == F.col("n_nationkey"))
    return d.select(F.col("o_orderkey").alias("doc_id"), F.year("o_orderdate").alias("year"), F.col("n_name").alias("ministry"), F.col("c_mktsegment").alias("department"), mark.alias("demands_mark"))


def rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = _numbered(table(spark, sf_dir, "part"), "p_partkey")
    return p.select(F.col("p_partkey").alias("load_ord"), "is_number", "is_base", F.when(F.col("p_size") <= 5, "Yes").otherwise("No").alias("mandatory"))


def mandatory(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rules(spark, sf_dir).where("mandatory = 'Yes'").select(F.upper("is_base").alias("base")).distinct()


def pdfs(rows: DataFrame) -> DataFrame:
    """(path, content) of rows (path, urls): PDF files whose link annotations are objects of one packed stream."""

    def file(urls: list[str]) -> bytes:
        bodies = [b"<< /Type /Annot /Subtype /Link /A << /S /URI /URI (" + u.replace("(", "\\(").encode() + b") >> >>" for u in urls]
        bodies = [b.replace(b")) >>", b"\\)) >>") for b in bodies]
        starts = [sum(len(b) + 1 for b in bodies[:i]) for i in range(len(bodies))]
        head = " ".join(f"{i + 1} {at}" for i, at in enumerate(starts)).encode() + b"\n"
        stream = zlib.compress(head + b"\n".join(bodies))
        out = b"%PDF-1.5\n"
        one = len(out)
        out += b"90 0 obj\n<< /Type /ObjStm /N %d /First %d /Filter /FlateDecode /Length %d >>\nstream\n" % (len(bodies), len(head), len(stream)) + stream + b"\nendstream\nendobj\n"
        entries = b"".join(b"\x02\x00\x5a" + bytes([i]) for i in range(len(bodies))) + b"\x01" + one.to_bytes(2, "big") + b"\x00"
        packed = zlib.compress(entries)
        at = len(out)
        out += b"91 0 obj\n<< /Type /XRef /Size 92 /W [1 2 1] /Index [1 %d 90 1] /Filter /FlateDecode /Length %d >>\nstream\n" % (len(bodies), len(packed)) + packed + b"\nendstream\nendobj\n"
        return out + b"startxref\n%d\n%%%%EOF\n" % at

    def run(batches):
        for batch in batches:
            made = [file(u) for u in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(made, pa.binary())], ["path", "content"])

    return rows.select("path", "urls").mapInArrow(run, "path string, content binary")


#: The same tables for DuckDB: reg, cit, docs, rules.
SQL = r"""WITH reg AS (
  SELECT p_partkey AS load_ord, 'IS ' || (1000 + p_partkey // 2) || ' (Part ' || (1 + p_partkey % 2) || ')' AS is_number,
    'IS ' || (1000 + p_partkey // 2) AS is_base, CAST(1000 + p_partkey // 2 AS VARCHAR) AS is_digits, p_name AS title, p_type AS family, p_size AS size,
    CASE WHEN p_partkey % 10 < 2 THEN 'Withdrawn' WHEN p_partkey % 10 = 2 THEN 'Superseded' ELSE 'Current' END AS status,
    CASE WHEN p_partkey % 10 < 3 AND p_partkey % 3 > 0 THEN 'IS ' || (1001 + p_partkey // 2) || ' (Part 1)' END AS replaced_by,
    CAST(1950 + p_partkey % 70 AS INTEGER) AS year
  FROM part WHERE p_partkey % 50 NOT IN (8, 9)),
cit AS (
  SELECT l_orderkey AS doc_id, l_linenumber AS pos, l_partkey AS part, 'IS ' || (1000 + l_partkey // 2) AS item,
    CASE l_linenumber % 3 WHEN 0 THEN 'IS ' || (1000 + l_partkey // 2) || ' (Part ' || (1 + l_partkey % 2) || ')'
      WHEN 1 THEN 'IS ' || (1000 + l_partkey // 2) || ' (Sec 9)' ELSE 'IS:0' || (1000 + l_partkey // 2) || ' : 1995' END AS citation
  FROM lineitem),
docs AS (
  SELECT o_orderkey AS doc_id, CAST(year(o_orderdate) AS INTEGER) AS year, n_name AS ministry, c_mktsegment AS department,
    CASE o_orderstatus WHEN 'F' THEN 'Yes' WHEN 'O' THEN 'No' END AS demands_mark
  FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey),
rules AS (
  SELECT p_partkey AS load_ord, 'IS ' || (1000 + p_partkey // 2) || ' (Part ' || (1 + p_partkey % 2) || ')' AS is_number, 'IS ' || (1000 + p_partkey // 2) AS is_base,
    CASE WHEN p_size <= 5 THEN 'Yes' ELSE 'No' END AS mandatory FROM part),
spelled AS (
  SELECT DISTINCT citation, trim(split_part(citation, '(', 1)) AS k1,
    regexp_extract(regexp_replace(split_part(citation, '(', 1), ':\s*(?:19|20)\d{2}\s*$', ''), '^\s*IS(?:/(?:IEC|ISO))?\s*[:\s]?\s*0*(\d{1,6})\s*$', 1) AS k2 FROM cit),
res AS (
  SELECT s.citation, coalesce(a.is_number, b.is_number, c.is_number) AS hit,
    CASE WHEN a.is_number IS NOT NULL THEN 'exact' WHEN b.is_number IS NOT NULL THEN 'is_base_fallback' WHEN c.is_number IS NOT NULL THEN 'number_fallback' END AS matched_by
  FROM spelled s LEFT JOIN reg a ON s.citation = a.is_number
  LEFT JOIN (SELECT is_base, arg_min(is_number, load_ord) AS is_number FROM reg GROUP BY is_base) b ON s.k1 = b.is_base
  LEFT JOIN (SELECT is_digits, min(is_number) AS is_number FROM reg GROUP BY is_digits) c ON s.k2 = c.is_digits),
deadb AS (SELECT DISTINCT is_base FROM reg WHERE status <> 'Current' EXCEPT SELECT is_base FROM reg WHERE status = 'Current'),
pref AS (SELECT upper(is_base) AS base, arg_min(status, (CASE status WHEN 'Current' THEN 0 ELSE 1000000000 END) + load_ord) AS status FROM reg GROUP BY 1),
fact AS (
  SELECT DISTINCT c.doc_id, upper(trim(split_part(c.citation, '(', 1))) AS base, coalesce(p.status <> 'Current', false) AS dead,
    upper(trim(split_part(c.citation, '(', 1))) IN (SELECT upper(is_base) FROM rules WHERE mandatory = 'Yes') AS mandatory,
    d.year, d.ministry, d.department, d.demands_mark
  FROM cit c JOIN docs d USING (doc_id) LEFT JOIN pref p ON upper(trim(split_part(c.citation, '(', 1))) = p.base)
"""
#: Directed association edges of line items in orders with the given thresholds.
EDGES = r"""sets AS (SELECT DISTINCT l_orderkey AS b, l_partkey AS i FROM lineitem),
tot AS (SELECT count(DISTINCT b) AS n FROM sets), freq AS (SELECT i, count(*) AS f FROM sets GROUP BY i),
edges AS MATERIALIZED (
  SELECT x.i AS src, y.i AS dst, any_value(fx.f) AS n_src, any_value(fy.f) AS n_dst, count(*) AS n_co,
    round(count(*)::DOUBLE / any_value(fx.f), 6) AS confidence,
    round((count(*)::DOUBLE / any_value(n)) / ((any_value(fx.f)::DOUBLE / any_value(n)) * (any_value(fy.f)::DOUBLE / any_value(n))), 6) AS lift
  FROM sets x JOIN sets y ON x.b = y.b AND x.i <> y.i JOIN freq fx ON fx.i = x.i JOIN freq fy ON fy.i = y.i CROSS JOIN tot
  GROUP BY x.i, y.i HAVING count(*) >= 2 AND any_value(fx.f) >= 1 AND count(*)::DOUBLE / any_value(fx.f) >= 0.05)
"""
