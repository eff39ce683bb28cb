import random
import threading
import time

import pytest
from pyspark.sql import functions as F

from citeloom.llm import sharding

DOC = "doc_id long, text string"


def rows(spark, start, n, size=400):
    rng = random.Random(start)
    return spark.createDataFrame([(start + i, f"{rng.getrandbits(size):x}") for i in range(n)], DOC)


def test_two_writers_and_a_vacuum_lose_nothing(spark, tmp_path):
    """Two threads append and compact one store while a third vacuums it all the time."""
    root = f"file://{tmp_path}/store"
    sharding.ShardStore(spark, root)
    failed, stop = [], threading.Event()

    def write(start):
        store = sharding.ShardStore(spark, root, target=40_000, fan_in=3, smallest=1000)
        for k in range(5):
            store.append(rows(spark, start + 100 * k, 20))
            try:
                store.compact()
            except RuntimeError as x:  # the other one merged the same shards first
                if "another commit" not in str(x):
                    failed.append(x)

    def clean():
        store = sharding.ShardStore(spark, root)
        while not stop.is_set():
            store.vacuum(keep=3)

    writers = [threading.Thread(target=write, args=(s,)) for s in (0, 10_000)]
    cleaner = threading.Thread(target=clean)
    for t in (*writers, cleaner):
        t.start()
    for t in writers:
        t.join()
    stop.set()
    cleaner.join()
    assert not failed
    got = sorted(r["doc_id"] for r in sharding.ShardStore(spark, root).read().collect())
    assert got == sorted(s + 100 * k + i for s in (0, 10_000) for k in range(5) for i in range(20))


def test_vacuum_leaves_writers_at_work_and_kept_versions(spark, tmp_path, monkeypatch):
    store = sharding.ShardStore(spark, f"file://{tmp_path}/store")
    store.append(rows(spark, 0, 10).coalesce(1))
    pending = store._marked(rows(spark, 50, 10).coalesce(1))  # not committed yet
    store.commit([], store.shards())
    assert store.vacuum(keep=2) == 0 and store.read(1).count() == 10
    assert store.vacuum() == 1 and store.read() is None
    store.commit(pending)
    assert store.vacuum() == 0 and store.read().count() == 10
    store._marked(rows(spark, 90, 10).coalesce(1))  # a job that died
    assert store.vacuum() == 0
    monkeypatch.setattr(sharding, "ABANDONED", 0)
    assert store.vacuum() == 1 and store.read().count() == 10


def test_large_shards_are_cut_to_the_target(spark, tmp_path):
    store = sharding.ShardStore(spark, f"file://{tmp_path}/store", target=30_000, fan_in=3, smallest=1000)
    store.append(rows(spark, 0, 400, size=8000).coalesce(1))
    assert len(store.shards()) == 1 and store.shards()[0].size > 300_000
    store.compact()
    sizes = [s.size for s in store.shards()]
    assert len(sizes) > 10 and max(sizes) <= 60_000
    assert sorted(r["doc_id"] for r in store.read().collect()) == list(range(400))
    store.append(rows(spark, 1000, 1, size=1_500_000).coalesce(1))  # one row of more than twice the target stays whole
    store.compact()
    assert store.read().count() == 401


def test_older_versions_stay_readable_unless_dropped(spark, tmp_path):
    root = f"file://{tmp_path}/store"
    first = sharding.shard(rows(spark, 0, 10), root).count()
    store = sharding.ShardStore(spark, root)
    v = store.version()
    assert sharding.shard(rows(spark, 100, 10), root).count() == 20 and first == 10 and store.read(v).count() == 10
    assert sharding.shard(rows(spark, 200, 10), root, keep=1).count() == 30


def test_stores_without_atomic_rename_are_refused(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(sharding, "UNSAFE", frozenset(["file"]))
    with pytest.raises(ValueError, match="atomic"):
        sharding.ShardStore(spark, f"file://{tmp_path}/store")


def test_compaction_keeps_the_columns_of_all_arrivals(spark, tmp_path):
    store = sharding.ShardStore(spark, f"file://{tmp_path}/store", target=60_000, fan_in=3, smallest=1000)
    store.append(rows(spark, 0, 10).coalesce(1))
    for i in range(1, 5):
        store.append(rows(spark, 10 * i, 10).withColumn("extra", F.col("doc_id") + 1).coalesce(1))
    want = sorted((i, None if i < 10 else i + 1) for i in range(50))
    held = lambda: sorted((r["doc_id"], r["extra"]) for r in store.read().collect())
    assert held() == want
    store.compact()
    assert held() == want and len(store.shards()) < 5
    assert "extra" not in store.read(1).columns
    before = store.version()
    for clash in (F.lit("x").alias("extra"), F.lit(1).alias("EXTRA")):
        with pytest.raises(ValueError):
            store.append(rows(spark, 90, 1).select("*", clash))
    assert store.version() == before and held() == want


def test_a_slow_writer_keeps_its_files_and_a_lost_one_cannot_commit(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(sharding, "ABANDONED", 1)
    store = sharding.ShardStore(spark, f"file://{tmp_path}/store")
    store.append(rows(spark, 0, 5).coalesce(1))

    def slow(batches):
        time.sleep(4)
        yield from batches

    late = rows(spark, 5, 5).coalesce(1)
    worker = threading.Thread(target=lambda: store.append(late.mapInArrow(slow, late.schema)))
    worker.start()
    while worker.is_alive():
        store.vacuum()
        time.sleep(0.3)
    worker.join()
    assert store.read().count() == 10
    lost = store._marked(rows(spark, 50, 5).coalesce(1))
    time.sleep(1.5)
    assert store.vacuum() == 1
    with pytest.raises(RuntimeError):
        store.commit(lost)
    assert store.read().count() == 10


def test_plan_equals_a_walk_through_the_tiers(spark, tmp_path, monkeypatch):
    store = sharding.ShardStore(spark, f"file://{tmp_path}/store", target=1000, fan_in=3, smallest=10)
    rng = random.Random(1)
    for _ in range(40):
        live = [sharding.Shard(f"p{i}", rng.choice([1, 9, 10, 11, 29, 31, 80, 95, 270, 300, 499, 500, 900, 1500])) for i in range(rng.randrange(0, 40))]
        monkeypatch.setattr(store, "shards", lambda version=None: live)
        tiers = {}
        for s in live:
            if s.size < 500:
                t, top = 0, 10
                while s.size > top if t == 0 else s.size >= top * 3:
                    t, top = t + 1, top if t == 0 else top * 3
                tiers.setdefault(t, []).append(s)
        want = []
        for t in sorted(tiers):
            if len(tiers[t]) < 3:
                continue
            left = list(tiers[t])
            while left:
                run = [left.pop(0)]
                while left and sum(s.size for s in run) + left[0].size <= 1000:
                    run.append(left.pop(0))
                if len(run) > 1:
                    want.append(run)
        assert store.plan() == want
        assert all(sum(s.size for s in r) <= 1000 for r in want)
