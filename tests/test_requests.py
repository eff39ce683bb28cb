import time

from pyspark.sql import functions as F

from citeloom.functions import clauses
from citeloom.operators import forward
from citeloom.sources import tables
from citeloom.streaming import incremental


def test_translations_are_asked_once_and_failures_again(spark):
    texts = spark.createDataFrame([(1, "cable to IS 694 of 11 kV", "hi"), (2, "pump", "hi"), (3, "pump", "ta"), (4, "pump", "hi"), (5, None, "hi"), (6, "x", None)], "id long, text string, language string")
    asked = spark.sparkContext.accumulator(0)

    def fails_on_tamil(given, language):
        asked.add(len(given))
        if language == "ta":
            raise OSError("down")
        return [f"<{t}>" for t in given]

    none = spark.createDataFrame([], "text string, language string, translation string")
    every, fresh = clauses.translated(texts, none, fails_on_tamil)
    assert {r["id"]: r["translation"] for r in every.collect()} == {1: "<cable to IS 694 of 11 kV >", 2: "<pump>", 3: None, 4: "<pump>", 5: None, 6: None}
    assert asked.value == 3 and fresh.count() == 2
    again, more = clauses.translated(texts, fresh.unionByName(fresh), lambda t, _: [x.upper() for x in t])
    assert sorted(map(tuple, more.collect())) == [("pump", "ta", "PUMP")]
    assert {r["id"]: r["translation"] for r in again.collect()}[3] == "PUMP"


def test_routes_and_optional_columns(spark):
    df = spark.createDataFrame([(1, "Cement to IS 269"), (2, "Cement"), (3, ""), (4, None)], "id long, text string")
    assert [r["route"] for r in forward.routed(df).orderBy("id").collect()] == ["audit", "draft", "draft", "draft"]
    assert tables.projected(df, ["gone", "text", "id"]).columns == ["text", "id"]


def test_periodic_runs_take_what_came_meanwhile(spark, tmp_path):
    seen = []
    write = lambda i: spark.createDataFrame([(i,)], "x int").coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    write(1)
    stream = incremental.read_stream(spark, str(tmp_path / "in"), "x int")
    running = incremental.run_periodic(stream, str(tmp_path / "c"), lambda b, i: seen.extend(r["x"] for r in b.collect()), "1 second", mode="append")
    try:
        for x in (1, 2, 3):
            if x > 1:
                write(x)
            for _ in range(120):
                if x in seen:
                    break
                time.sleep(0.25)
        assert seen == [1, 2, 3]
    finally:
        running.stop()
    assert spark.range(1).select(F.lit(1)).count() == 1
