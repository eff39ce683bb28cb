import pytest
from pyspark.sql import functions as F

from citeloom.streaming import incremental, sinks, state

SCHEMA = "k string, v int, ts timestamp"
CHANGES = SCHEMA + ", n_rows long, change string"


@pytest.fixture
def feed(spark, tmp_path):
    """A folder of arrivals, a function that runs what is there from one checkpoint, and the table of changes."""
    table = sinks.BatchTable(spark, f"file://{tmp_path}/out")

    def run(rows, **how):
        df = spark.createDataFrame(rows, "k string, v int, t string").select("k", "v", F.col("t").cast("timestamp").alias("ts"))
        df.repartition(2).write.mode("append").parquet(f"{tmp_path}/in")
        stream = incremental.read_stream(spark, f"{tmp_path}/in", SCHEMA).withWatermark("ts", "1 minute")
        incremental.run_available(state.newest(stream, "k", ["ts", "v"], **how), f"{tmp_path}/checkpoint", table.each()).awaitTermination()
        return sorted((r["k"], r["v"], r["n_rows"], r["change"]) for r in state.current(table.read(CHANGES), "k").collect())

    return run


def test_state_goes_on_after_a_restart(feed):
    at = "2024-01-01 00:0{}:00".format
    rows = [("a", 1, at(0)), ("a", 3, at(1)), ("a", 2, at(1)), ("b", None, at(5)), (None, 1, at(0)), ("a", 9, None)]
    assert feed(rows) == [("a", 3, 4, "insert"), ("b", None, 1, "insert")]
    assert feed([("a", 7, at(0)), ("b", 5, at(5)), ("c", 1, at(2))]) == [("a", 3, 5, "repeat"), ("b", 5, 2, "update"), ("c", 1, 1, "insert")]
    assert feed([("c", 2, at(3))] * 3) == [("a", 3, 5, "repeat"), ("b", 5, 2, "update"), ("c", 2, 4, "update")]


def test_idle_keys_end_and_begin_anew(feed):
    at = "2024-01-01 {}:00".format
    how = {"idle": "10 minutes", "ts": "ts"}
    assert feed([("a", 1, at("00:00")), ("b", 1, at("00:28"))], **how)  # the watermark moves to 00:27, and a ends
    assert feed([("b", 2, at("00:30"))], **how) == [("b", 2, 2, "update")]
    assert feed([("a", 5, at("00:31"))], **how) == [("a", 5, 1, "insert"), ("b", 2, 2, "update")]


def test_a_replayed_batch_replaces_its_rows(spark, tmp_path):
    t = sinks.BatchTable(spark, f"file://{tmp_path}/t")
    assert t.read("x long").count() == 0
    rows = lambda *x: spark.createDataFrame([(i,) for i in x], "x long")
    held = lambda: sorted(map(tuple, t.read("x long").select("batch", "x").collect()))
    for batch in (0, 1, 2):
        t.write(rows(batch, batch + 10), batch)
    assert held() == [(0, 0), (0, 10), (1, 1), (1, 11), (2, 2), (2, 12)]
    t.write(rows(7, 8, 9), 1)
    assert held() == [(0, 0), (0, 10), (1, 7), (1, 8), (1, 9), (2, 2), (2, 12)]
    rows(99).write.parquet(f"{tmp_path}/t/data/batch=3/died")  # an attempt without a commit
    t.write(rows(), 2)
    assert held() == [(0, 0), (0, 10), (1, 7), (1, 8), (1, 9)]
    assert sinks.BatchTable(spark, f"file://{tmp_path}/t").live().keys() == {0, 1, 2}


def test_replayed_amendments_are_reported_once(spark, tmp_path):
    held = spark.createDataFrame([("IS 2", "Current", 1990), ("IS 3", "Current", 1990)], "is_number string, status string, year int")
    sent = spark.createDataFrame([("IS 2", "Withdrawn", 1990)], "portal_number string, status string, year int")
    table, applied = sinks.BatchTable(spark, f"file://{tmp_path}/t"), []
    for diffs in (table, f"{tmp_path}/json"):
        each = incremental.detect_amendments(held, diffs, apply=lambda d: applied.append(d.count()))
        for batch in (0, 1, 1):
            each(sent, batch)
    assert applied == [1] * 6
    for found in (table.read("is_number string, field string, held string, portal string"), spark.read.schema("is_number string, field string, held string, portal string, batch long").json(f"{tmp_path}/json")):
        assert sorted((r["is_number"], r["portal"], r["batch"]) for r in found.collect()) == [("IS 2", "Withdrawn", 0), ("IS 2", "Withdrawn", 1)]
