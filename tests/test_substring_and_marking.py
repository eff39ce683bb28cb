import random
import re

import pytest
from pyspark.sql import functions as F

from citeloom.operators import marking, substring


@pytest.mark.parametrize("pushed", [substring.PUSHED, 0])
def test_index_equals_a_scan(spark, tmp_path, monkeypatch, pushed):
    monkeypatch.setattr(substring, "PUSHED", pushed)
    rng = random.Random(pushed)
    some = lambda n: "".join(rng.choice("abAB é1%_") for _ in range(n))
    rows = [(i, rng.choice([some(rng.randrange(0, 12)), None]), some(rng.randrange(0, 9))) for i in range(400)] + [(400, None, None), (None, "abab", "x"), (401, "abab", "abab")]
    frame = spark.createDataFrame(rows, "id long, title string, number string").repartition(3)
    substring.build(frame, "id", ["title", "number"], str(tmp_path / "i"))
    needles = [some(n) for n in (1, 1, 2, 2, 2, 3, 3, 3, 3, 4, 4, 5, 6, 7)] + ["", "zzz", "z", "ABAB", "é1%", "%", None, "%_"] + [rows[7][2], rows[9][2] + "q"]
    asked = spark.createDataFrame([(n,) for n in needles], "needle string")
    got = sorted(map(tuple, substring.find(spark, str(tmp_path / "i"), frame, "id", ["title", "number"], asked).collect()))
    want = sorted({(n, i) for n in needles if n is not None for i, a, b in rows if i is not None and any(t is not None and n.lower() in t.lower() for t in (a, b))})
    assert got == want


def test_few_needles_are_pushed_to_the_scan(spark, tmp_path):
    frame = spark.createDataFrame([(i, f"title {i} of many") for i in range(50)], "id long, t string")
    substring.build(frame, "id", ["t"], str(tmp_path / "i"))
    found = substring.find(spark, str(tmp_path / "i"), frame, "id", ["t"], spark.createDataFrame([("tle 17",)], "needle string"))
    assert [tuple(r) for r in found.collect()] == [("tle 17", 17)]
    assert "PushedFilters: [In(gram" in found._jdf.queryExecution().executedPlan().toString()


def test_marks_equal_the_longest_first_pattern(spark):
    rng = random.Random(5)
    for turn in range(30):
        patterns = sorted({"".join(rng.choice("ab1 ") for _ in range(rng.randrange(1, 6))) for _ in range(rng.choice([1, 5, 40]))})
        pattern = re.compile("|".join(re.escape(p) for p in sorted(patterns, key=lambda p: (-len(p), p))))
        for _ in range(20):
            text = "".join(rng.choice("ab1 é") for _ in range(rng.randrange(0, 60)))
            assert marking.places(marking.automaton(patterns), text) == [m.span() for m in pattern.finditer(text)]


def test_thousands_of_designations_in_one_pass(spark):
    rng = random.Random(6)
    numbers = [f"IS {n}" for n in range(1000, 6000)] + [f"IS {n} (Part {p})" for n in range(1000, 1500) for p in (1, 2)]
    texts = [(i, " and ".join(rng.choice(numbers) + rng.choice(["", "!", " (Part 9)"]) for _ in range(rng.randrange(0, 6)))) for i in range(200)] + [(200, None), (201, "")]
    docs = spark.createDataFrame(texts, "id long, text string").repartition(3).withColumn("found", F.lit("x"))
    got = {r["id"]: (r["marked"], r["found"]) for r in marking.marked(docs, spark.createDataFrame([(n,) for n in [*numbers, "", None]], "designation string")).collect()}
    pattern = re.compile("|".join(re.escape(p) for p in sorted(numbers, key=len, reverse=True)))
    for i, t in texts:
        assert got[i] == ((None, 0) if t is None else (pattern.sub(lambda m: f"[{m[0]}]", t), len(pattern.findall(t))))
    none = marking.marked(docs, spark.createDataFrame([], "designation string"))
    assert {r["marked"] for r in none.collect()} == {t for _, t in texts}


def test_more_designations_than_one_automaton_takes(spark, monkeypatch):
    monkeypatch.setattr(marking, "PATTERNS", 2)
    numbers = ["IS 12", "IS 123", "IS 123 (Part 1)", "ab", "abc", "bc 9"]
    texts = [(1, "IS 123 (Part 1) and IS 124, IS 1234"), (2, "abc 9 ab IS 12"), (3, "é🙂abc IS 123 (Part 2)"), (4, None), (5, "")]
    docs = spark.createDataFrame([*texts, *texts], "id long, text string").repartition(3)
    got = sorted((r["id"], r["marked"], r["found"]) for r in marking.marked(docs, spark.createDataFrame([(n,) for n in numbers], "designation string")).collect() if r["id"] != 4)
    want = [(1, "[IS 123 (Part 1)] and [IS 12]4, [IS 123]4", 3), (2, "[abc] 9 [ab] [IS 12]", 3), (3, "é🙂[abc] [IS 123] (Part 2)", 2), (5, "", 0)]
    assert got == sorted(want * 2)


def test_sequences_are_made_in_tasks_of_bounded_rows(spark, monkeypatch):
    monkeypatch.setattr(substring, "ROWS", 10)
    frame = spark.createDataFrame([(i, "a") for i in range(95)] + [(None, "b")], "id long, t string").coalesce(1)
    own = substring.dealt(frame, "id", ["t"])
    assert own.rdd.getNumPartitions() == 10 and own.count() == 95


def test_pdf_files_of_a_small_table_are_dealt_to_all_cores(spark, sf):
    from citeloom.plans import catalogue, extended  # noqa: F401

    assert catalogue.QUERIES["pdf_annotations"](spark, sf).rdd.getNumPartitions() >= spark.sparkContext.defaultParallelism
