from pyspark.sql import functions as F

from citeloom.streaming import incremental as S


def test_upsert_and_amendments_run_incrementally(spark, tmp_path):
    src, out, diffs = (str(tmp_path / x) for x in ("in", "out", "diffs"))
    schema = "portal_number string, status string, year int"
    held = spark.createDataFrame([("IS 2", "Current", 1990)], "is_number string, status string, year int")
    for status in ("Current", "Withdrawn"):
        spark.createDataFrame([("IS 2", status, 1990)], schema).coalesce(1).write.mode("append").parquet(src)
        stream = S.read_stream(spark, src, schema)
        S.run_available(stream, str(tmp_path / "c1"), S.upsert_into(out, "portal_number"), mode="append").awaitTermination()
        S.run_available(stream, str(tmp_path / "c2"), S.detect_amendments(held, diffs), mode="append").awaitTermination()
    assert [r["status"] for r in spark.read.parquet(f"{out}/v=1").collect()] == ["Withdrawn"]
    assert [(r["field"], r["portal"]) for r in spark.read.schema("field string, portal string, batch long").json(diffs).collect()] == [("Status", "Withdrawn")]


def test_running_decisions(spark):
    d = spark.createDataFrame([("accepted", "x"), ("rejected", None), ("accepted", "y")], "decision string, rationale string")
    assert {tuple(r) for r in S.running_decisions(d).collect()} == {("accepted", 2)}


def test_tumbling_batch(spark):
    e = spark.createDataFrame([("2024-01-01 01:00:00", "a", 1.0), ("2024-01-01 23:00:00", "a", 2.0), ("2024-01-02 00:00:00", "a", 4.0)], "t string, event_type string, value double").withColumn("ts", F.col("t").cast("timestamp"))
    assert sorted((r["n"], r["total"]) for r in S.tumbling(e).collect()) == [(1, 4.0), (2, 3.0)]


def test_upsert_drops_versions_that_no_replay_needs(spark, tmp_path):
    each = S.upsert_into(str(tmp_path), "k")
    for i in (0, 1, 2, 2, 3):
        each(spark.createDataFrame([("a", i), (f"b{i}", i)], "k string, v int").coalesce(1), i)
    assert sorted(p.name for p in tmp_path.iterdir() if p.is_dir()) == ["v=2", "v=3"]
    assert sorted(map(tuple, spark.read.parquet(f"{tmp_path}/v=3").collect())) == [("a", 3), ("b0", 0), ("b1", 1), ("b2", 2), ("b3", 3)]
