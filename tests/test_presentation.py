import numpy as np
from pyspark.sql import functions as F

from citeloom.operators import models, presentation
from citeloom.sources import catalogue


def test_encoders_are_given(spark):
    def encode(texts):
        return np.array([[len(t), t.count("a"), 0.0] for t in texts]) * (0 if texts == ["zero"] else 1)

    df = spark.createDataFrame([(1, "aaa"), (2, ""), (3, None), (4, "bb")], "doc long, text string").coalesce(1)
    got = {r["doc"]: r["embedding"] for r in models.embedded(df, encode, batch=3).collect()}
    assert got[2] is None and got[3] is None and abs(sum(v * v for v in got[1]) - 1) < 1e-6 and got[4][1] == 0


def test_recognisers_are_given_or_reported(spark):
    rows = [("a", 2, bytearray(b"two")), ("a", 1, bytearray(b"one")), ("a", 13, bytearray(b"late")), ("b", 1, bytearray(b"bad"))]
    files = spark.createDataFrame(rows, "path string, page int, content binary")

    def read(raw):
        if raw == b"bad":
            raise ValueError("broken")
        return raw.decode()

    got = {r["path"]: (r["text"], r["error"]) for r in models.recognised(files, read).collect()}
    assert got == {"a": ("one\ntwo", None), "b": (None, "ValueError: broken")}
    assert {r["error"] for r in models.recognised(files, None).collect()} == {"no recogniser"}


def test_report_escapes_and_orders(spark):
    v = spark.createDataFrame([(1, 1, 0, 0, "blocking"), (2, 0, 0, 0, "clean")], "doc_id long, high long, medium long, low long, verdict string")
    f = spark.createDataFrame([(1, "k", "high", "IS <1>", "second", 2), (1, "k", "high", "IS 2", "first & best", 1)], "doc_id long, kind string, severity string, citation string, text string, place int")
    got = {r["doc_id"]: r["page"] for r in presentation.report(v, f, "1 May").collect()}
    assert "No findings." in got[2] and got[1].index("first &amp; best") < got[1].index("IS &lt;1&gt;") and "1 May. Verdict: blocking (1 high, 0 medium, 0 low)" in got[1]


def test_samples_of_ids_repeat(spark):
    a, b = ([r["id"] for r in catalogue.id_sample(spark, 100, 9000, 50, s).collect()] for s in (1, 1))
    other = [r["id"] for r in catalogue.id_sample(spark, 100, 9000, 50, 2).collect()]
    assert a == b != other and len(set(a)) == 50 and all(100 <= i < 9000 for i in a)


def test_names_keep_numbers_only_behind_their_owners(spark):
    docs = spark.createDataFrame([("Volume_3 of 12 pumps.pdf", None), ("the_and.pdf", "N/A"), (None, "Cables")], "identifier string, family string")
    words = spark.createDataFrame([("volume",), ("pumps",), ("the",), ("and",)], "word string")
    got = {r["identifier"]: (r["name"], r["named"]) for r in presentation.readable_names(docs, words, {}, ["LED"]).collect()}
    assert got == {"Volume_3 of 12 pumps.pdf": ("Volume 3 Pumps", True), "the_and.pdf": ("Untitled tender", False), None: ("Untitled cables tender", False)}
    assert presentation.known_words(docs.select(F.lit("Big Pumps 12").alias("t")), ["t"]).count() == 2


def test_words_of_names(spark):
    names = ["technicalSpecification_v2.DOCX", "0f3b9a7c-1111-2222-3333-0123456789ab_pump.pdf", "LED lamp.set", "PUMPset", "a1b2c3 bed 2019-07-01", "", None]
    df = spark.createDataFrame(list(enumerate(names)), "i int, n string")
    got = {r["i"]: r["w"] for r in df.select("i", presentation.name_words(F.col("n")).alias("w")).collect()}
    assert got == {0: ["technical", "Specification", "v", "2"], 1: ["1111", "2222", "3333", "pump"], 2: ["LED", "lamp", "set"], 3: ["PUMPset"], 4: ["bed", "2019", "07", "01"], 5: [], 6: []}
