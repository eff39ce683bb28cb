import io
import json
import zipfile

import pytest
from pyspark.sql import functions as F

from citeloom.sources import catalogue, documents, html_tables, logs, tables


def test_csv_with_mark_newlines_and_sentinels(spark, tmp_path):
    (tmp_path / "r.csv").write_text('is_number,title,year,status\n"IS 1 (Part 1)","two\nlines",1990.0,Current\nIS 2,N/A,nan,—\n', encoding="utf-8-sig")
    r = tables.as_register(tables.read_csv(spark, str(tmp_path / "r.csv"), tables.REGISTER)).orderBy("load_ord").collect()
    assert [(x["is_number"], x["title"], x["year"], x["status"], x["is_digits"]) for x in r] == [("IS 1 (Part 1)", "two\nlines", 1990, "Current", "1"), ("IS 2", None, None, None, "2")]


def test_export_is_allow_listed(spark, tmp_path):
    with pytest.raises(ValueError, match="exportable"):
        tables.export_csv(spark.range(1), "secrets", str(tmp_path / "x"))
    tables.export_csv(spark.range(3).withColumn("n", F.lit("a")), "edges", str(tmp_path / "y"))
    assert spark.read.option("header", True).csv(str(tmp_path / "y")).count() == 3


def test_documents(spark, tmp_path):
    xml = '<w:document xmlns:w="http://schemas.openxmlformats.org/wordprocessingml/2006/main"><w:body><w:p><w:r><w:t>As per IS 694</w:t></w:r></w:p><w:tbl><w:tr><w:tc><w:p><w:r><w:t>a</w:t></w:r></w:p></w:tc><w:tc><w:p><w:r><w:t>b</w:t></w:r></w:p></w:tc></w:tr></w:tbl></w:body></w:document>'
    raw = io.BytesIO()
    with zipfile.ZipFile(raw, "w") as z:
        z.writestr("word/document.xml", xml)
    (tmp_path / "1234.docx").write_bytes(raw.getvalue())
    (tmp_path / "5678.txt").write_bytes(b"plain")
    (tmp_path / "9999.docx").write_bytes(b"PK\x03\x04broken")
    files = documents.read_binary(spark, str(tmp_path))
    got = {r["path"].rsplit("/", 1)[1]: r for r in documents.extract_text(files).collect()}
    assert got["1234.docx"]["text"] == "As per IS 694\na\tb"
    assert got["5678.txt"]["error"] == "unsupported file type" and got["9999.docx"]["error"].startswith("BadZipFile")
    assert {r["id"] for r in documents.file_index(files).collect()} == {"1234", "5678", "9999"}


def test_links(spark):
    raw = b"%PDF /URI (https://a.example.org/x.pdf) /URI (https://evil.test/y) /URI (https://a.example.org/x.pdf)"
    df = spark.createDataFrame([(bytearray(raw),)], "content binary")
    assert df.select(documents.attachment_links(F.col("content"), ["example.org"]).alias("l")).first()["l"] == ["https://a.example.org/x.pdf"]


def test_html_rows_and_carry_down(spark):
    html = "<table><tr><th>Group A</th></tr><tr><td>1</td><td>IS 1 &amp; 2</td></tr><tr><td>2</td></tr></table>"
    rows = html_tables.table_rows(spark.createDataFrame([(1, html)], "page_id long, html string")).orderBy("pos").collect()
    assert [r["cells"] for r in rows] == [["Group A"], ["1", "IS 1 & 2"], ["2"]]
    t = spark.createDataFrame([(1, 1, "a"), (1, 2, None), (1, 3, "b"), (1, 4, None)], "p long, o long, h string")
    assert [r["h"] for r in html_tables.carry_down(t, "p", "o", ["h"]).orderBy("o").collect()] == ["a", "a", "b", "b"]
    text = spark.createDataFrame([("Gold as per IS 1417. Silver is fine; hallmark of IS 2112 and IS 1417 hallmark.",)], "t string")
    assert text.select(html_tables.prose_standards(F.col("t"), "hallmark").alias("x")).first()["x"] == ["IS 2112", "IS 1417"]


def test_catalogue_source(spark, tmp_path):
    urls = []
    for i in range(2):
        (tmp_path / f"{i}.json").write_text(json.dumps({"rows": [{"n": f"IS {i}", "t": "cement pipes"}]}))
        urls.append(f"file://{tmp_path}/{i}.json")
    df = catalogue.read_catalogue(spark, urls, "n string, t string", "rows")
    assert {r["n"] for r in df.collect()} == {"IS 0", "IS 1"}
    assert {tuple(r) for r in catalogue.vocabulary(df, "t", ["cement"]).collect()} == {("pipes", 2)}
    assert [r["n"] for r in catalogue.remaining(df, df.where("n = 'IS 0'"), "n").collect()] == ["IS 1"]


def test_logs(spark, tmp_path):
    runs = spark.createDataFrame([(1, [("link", "ok"), ("versions", "a")]), (2, [("versions", "b")])], "load_ord long, results array<struct<stage:string,outcome:string>>")
    assert logs.latest_stage(runs, "versions").first()["outcome"] == "b" and logs.latest_stage(runs, "none").count() == 0
    d = spark.createDataFrame([("accepted", None), ("overridden", " "), ("overridden", "why"), ("maybe", "x"), (None, "x")], "decision string, rationale string")
    refused = logs.append_decisions(d, str(tmp_path / "log"))
    assert {r["problem"] for r in refused.collect()} == {"rationale required", "unknown decision"}
    assert logs.agreement(spark.read.schema("decision string, rationale string").json(str(tmp_path / "log"))).first()["agreement_pct"] == 50.0
