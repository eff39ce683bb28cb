import numpy as np
import pytest

from citeloom.llm import ann


def frame(spark, x, start=0):
    return spark.createDataFrame([(start + i, [float(v) for v in row]) for i, row in enumerate(x)], "vec_id long, embedding array<double>")


def brute(x, asked, k=5):
    n = x / np.linalg.norm(x, axis=1, keepdims=True)
    out = {}
    for q in asked:
        s = n @ n[q]
        s[q] = -np.inf
        out[q] = np.lexsort((np.arange(len(x)), -np.round(s, 12)))[:k].tolist()
    return out


def answers(df):
    out = {}
    for r in df.collect():
        out.setdefault(r["query_id"], []).append((r["rank"], r["vec_id"], r["score"]))
    return {q: [v for _, v, _ in sorted(rows)] for q, rows in out.items()}


def test_recall_without_clusters(spark):
    x = np.random.default_rng(1).normal(size=(4000, 48))
    df = frame(spark, x)
    got, want = answers(ann.nearest(df, df.where("vec_id % 50 = 0"))), brute(x, range(0, 4000, 50))
    assert got.keys() == want.keys() and all(len(v) == 5 for v in got.values())
    assert sum(len(set(got[q]) & set(want[q])) for q in want) >= 0.9 * 5 * len(want)


def test_few_lists_are_read_where_there_are_clusters():
    """What is calibrated depends on the vectors, and the lists read hold the neighbours that it promises."""
    rng = np.random.default_rng(2)
    apart = rng.normal(size=(80, 32))[rng.integers(0, 80, 6000)] + 0.2 * rng.normal(size=(6000, 32))
    alike = rng.normal(size=(6000, 32))
    read = {}
    for name, x in (("apart", apart), ("alike", alike)):
        index = ann.Centroids.fit(x, 375)
        most, ratio = index.calibrated(x, 5)
        row, to = index.lists(x, 24, 1, ann.COPIES, ann.CLOSE)
        q, lists = index.lists(x[:100], most + 32, ann.LEAST, max(most, ann.LEAST), ratio)
        want, hit = brute(x, range(100)), 0
        for i in range(100):
            hit += len(set(want[i]) & set(row[np.isin(to, lists[q == i])].tolist()))
        assert hit >= 0.9 * 500
        read[name] = len(lists) / 100 / 375
    assert read["apart"] < 0.1 < read["alike"] < 0.5


@pytest.mark.parametrize("name,value", [("BLOCK", 50), ("ASKED", 3), ("PART", 20)])
def test_exact_equals_brute_force_however_dealt(spark, monkeypatch, name, value):
    monkeypatch.setattr(ann, name, value)
    x = np.random.default_rng(3).normal(size=(400, 12))
    df = frame(spark, x)
    assert answers(ann.nearest(df, df.where("vec_id % 50 = 0"), exact=True)) == brute(x, range(0, 400, 50))
    near = answers(ann.nearest(df, df.where("vec_id % 50 = 0")))
    assert all(len(v) == 5 for v in near.values())


def test_lengths_scales_and_ties(spark):
    """Vectors are compared within their length; huge and tiny ones keep their cosines; ties go to smaller ids."""
    rng = np.random.default_rng(4)
    x = rng.normal(size=(300, 8))
    rows = [(i, [float(v) for v in x[i]]) for i in range(300)]
    rows += [(1000 + i, [1.0, float(i)]) for i in range(8)]
    rows += [(2000, [1e300 * float(v) for v in x[0]]), (2001, [1e-310 * float(v) for v in x[1]]), (2002, [5.0])]
    rows += [(3000 + i, [2.0**i * v for v in (1, 3, 5, 7, 1, 2, 4, 8)]) for i in (4, 0, 3, 1, 2, 7, 6, 5)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    got = {}
    for r in ann.nearest(df, df.where("vec_id IN (0, 1, 1000, 2000, 2002, 3000)"), exact=True).collect():
        got.setdefault(r["query_id"], []).append((r["rank"], r["vec_id"], r["score"]))
    got = {q: [(v, s) for _, v, s in sorted(rows)] for q, rows in got.items()}
    assert got[0][0][0] == 2000 and got[0][0][1] == pytest.approx(1.0) and got[2000][0][0] == 0
    assert got[1][0][0] == 2001 and got[1][0][1] == pytest.approx(1.0)
    assert [v for v, _ in got[1000]] == [1001, 1002, 1003, 1004, 1005] and 2002 not in got
    assert [v for v, _ in got[3000]] == [3001, 3002, 3003, 3004, 3005]


def test_a_query_whose_lists_are_too_small_reads_all(spark, monkeypatch):
    monkeypatch.setattr(ann, "LEAST", 1)
    monkeypatch.setattr(ann.Centroids, "calibrated", lambda self, x, k: (1, 1.0))
    x = np.random.default_rng(5).normal(size=(300, 6))
    df = frame(spark, np.concatenate((x, np.eye(6)[:1] * 9 + 0.001)))
    got = answers(ann.nearest(df, df, k=40))
    assert len(got) == 301 and all(len(v) == 40 for v in got.values())


def test_vectors_go_where_their_part_has_queries(spark, monkeypatch):
    """Many queries of one part don't multiply the vectors of others."""
    rng = np.random.default_rng(2)
    near, far = rng.normal(size=(300, 3)) + [9, 0, 0], rng.normal(size=(300, 5)) - 9
    rows = [(i, v.tolist()) for i, v in enumerate([*near, *far])]
    vectors = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    monkeypatch.setattr(ann, "ASKED", 10)
    seen = []
    keep = ann.Scratch.keep

    def watched(self, df, name="t"):
        out = keep(self, df, name)
        if name == "split":
            seen.append({r["part"]: r["groups"] for r in out.collect()})
        return out

    monkeypatch.setattr(ann.Scratch, "keep", watched)
    got = ann.nearest(vectors, vectors.where("vec_id < 100 OR vec_id = 599"), k=3, exact=True)
    assert got.groupBy("query_id").count().where("count = 3").count() == 101
    groups = seen[0]
    assert groups.pop(-5, 1) == 1 and all(1 <= g <= 10 for g in groups.values())
    unit = near / np.linalg.norm(near, axis=1)[:, None]
    cos = unit[:100] @ unit.T
    np.fill_diagonal(cos, -2)
    for q in range(0, 100, 9):
        want = sorted(range(300), key=lambda i: (-cos[q, i], i))[:3]
        assert [r["vec_id"] for r in got.where(f"query_id = {q}").orderBy("rank").collect()] == want
