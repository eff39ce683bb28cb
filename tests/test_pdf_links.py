import os
import sys

from pyspark.sql import functions as F

from citeloom.sources import pdf_links

sys.path.insert(0, os.path.dirname(__file__))
from pdf_files import annotation, packed, plain  # noqa: E402


def test_links_wherever_they_are_packed(spark):
    a, b, c = (annotation(x) for x in (b"(https://a.example.org/x)", rb"(https://b.org/\(1\)\057y\\z(in)ner)", b"<68747470733a2f2f632e6f72672f7a>"))
    urls = ["https://a.example.org/x", r"https://b.org/(1)/y\z(in)ner", "https://c.org/z"]
    first = plain({1: a, 2: b, 3: c})
    newer = plain({2: annotation(b"(https://d.org/new)")}, older=first)
    files = {
        "plain": (first, urls, None),
        "newer": (newer, [urls[0], "https://d.org/new", urls[2]], None),
        "packed": (packed({5: a, 6: b"<< /Type /Page >>", 7: c}), [urls[0], urls[2]], None),
        "packed without predictor": (packed({5: a, 7: b}, predictor=False), urls[:2], None),
        "no table": (first[: first.rfind(b"xref\n1")], urls, None),
        "packed, no table": (packed({5: a, 7: c}).replace(b"startxref", b"startxxxx"), [urls[0], urls[2]], None),
        "wrong table": (first.replace(b"startxref\n", b"startxref\n9"), urls, None),
        "repeated": (plain({1: a, 2: a}), urls[:1], None),
        "none": (plain({1: b"<< >>"}), [], None),
        "encrypted": (packed({5: a}, extra=b"/Encrypt 9 0 R "), None, "encrypted"),
        "text": (b"(https://a.org)", None, "not a PDF"),
        "empty": (b"", None, "not a PDF"),
        "null": (None, None, "not a PDF"),
        "cut": (packed({5: a})[:60], [], None),
    }
    df = spark.createDataFrame([(n, bytearray(f[0]) if f[0] is not None else None) for n, f in files.items()], "path string, content binary").repartition(3)
    got = {r["path"]: (r["links"], r["error"]) for r in pdf_links.links(df).collect()}
    for name, (_, links, error) in files.items():
        if name == "cut":  # its stream is broken: an error or nothing, never a failure of the job
            assert not got[name][0]
        else:
            assert got[name] == (links, error), name


def test_hosts(spark):
    df = spark.createDataFrame([(["https://x.gov.in/a", "http://gov.in", "https://evilgov.in/", "https://gov.in.evil.org/", "https://u@gov.in/", "https://gov.in:8080/q"],)], "l array<string>")
    assert df.select(pdf_links.allowed(F.col("l"), ["gov.in"])).first()[0] == ["https://x.gov.in/a", "http://gov.in", "https://gov.in:8080/q"]
