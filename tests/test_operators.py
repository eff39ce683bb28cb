import itertools
import random

import pytest
from pyspark.sql import functions as F

from citeloom.operators import association as A
from citeloom.operators import audit, evaluate, lookup, merge, paging, ranking, reuse
from citeloom.operators.components import connected_components

REG = "is_number string, is_base string, is_digits string, load_ord long, status string, replaced_by string"


def test_components_against_union_find(spark):
    rng = random.Random(3)
    edges = [(rng.randrange(200), rng.randrange(200)) for _ in range(130)] + [(i, i + 1) for i in range(300, 340)] + [(5, 5), (None, 3)]
    got = {r["node"]: r["component"] for r in connected_components(spark.createDataFrame(edges, "a long, b long")).collect()}
    parent = {}

    def find(x):
        parent.setdefault(x, x)
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in edges:
        if a is not None and a != b:
            x, y = find(a), find(b)
            parent[max(x, y)] = min(x, y)
    assert got == {x: find(x) for x in parent}
    assert connected_components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_resolution_steps_and_gaps(spark):
    reg = spark.createDataFrame([("IS 1554 (Part 1)", "IS 1554", "1554", 1, "Withdrawn", None), ("IS 1554 (Part 2)", "IS 1554", "1554", 2, "Current", None), ("IS 9", "IS 9", "9", 3, "Superseded", "IS 10")], REG)
    cites = spark.createDataFrame([("IS 1554 (Part 2)",), ("IS 1554",), ("IS:01554",), ("IS 77",), (None,), ("IS 9",)], "citation string")
    got = {r["citation"]: (r["hit"], r["matched_by"]) for r in lookup.resolve(cites, reg, []).collect()}
    assert got["IS 1554 (Part 2)"] == ("IS 1554 (Part 2)", "exact")
    assert got["IS 1554"] == ("IS 1554 (Part 1)", "is_base_fallback")
    assert got["IS:01554"] == ("IS 1554 (Part 1)", "number_fallback")
    assert got["IS 77"] == (None, None) and got[None] == (None, None)
    assert [r["citation"] for r in lookup.missing(cites.where("citation IS NOT NULL"), reg).collect()] == ["IS 77"]
    assert [r["is_base"] for r in lookup.dead_bases(reg).collect()] == ["IS 9"]
    row = lookup.check_dead(cites.where("citation = 'IS 9'"), reg).first()
    assert row["dead"] and row["replaced_by"] == "IS 10"


def test_edge_cap_equals_greedy(spark):
    rng = random.Random(1)
    rows = [(a, b, rng.randrange(1, 30)) for a, b in itertools.combinations(range(30), 2) if rng.random() < 0.5]
    got = {(r["src"], r["dst"]) for r in A.cap_edges(spark.createDataFrame(rows, "src long, dst long, n_co long"), 3).collect()}
    per, kept = {}, set()
    for a, b, _ in sorted(rows, key=lambda r: (-r[2], r[0], r[1])):
        if per.get(a, 0) < 3 or per.get(b, 0) < 3:
            kept.add((a, b))
            per[a], per[b] = per.get(a, 0) + 1, per.get(b, 0) + 1
    assert got == kept


def test_edges_of_small_baskets(spark):
    rows = [(1, "a"), (1, "b"), (1, "a"), (2, "a"), (2, "b"), (3, "a"), (4, None)]
    e = {(r["src"], r["dst"]): r for r in A.cocitation_edges(spark.createDataFrame(rows, "basket long, item string"), 2, 0.0, 1).collect()}
    assert set(e) == {("a", "b"), ("b", "a")} and e["b", "a"]["confidence"] == 1.0 and e["a", "b"]["confidence"] == pytest.approx(2 / 3, abs=1e-6)


def osa(a, b):
    d = {}
    for i in range(-1, len(a)):
        d[i, -1] = i + 1
    for j in range(-1, len(b)):
        d[-1, j] = j + 1
    for i in range(len(a)):
        for j in range(len(b)):
            d[i, j] = min(d[i - 1, j] + 1, d[i, j - 1] + 1, d[i - 1, j - 1] + (a[i] != b[j]))
            if i and j and a[i] == b[j - 1] and a[i - 1] == b[j]:
                d[i, j] = min(d[i, j], d[i - 2, j - 2] + 1)
    return d[len(a) - 1, len(b) - 1]


def test_near_numbers_equal_brute_force(spark):
    rng = random.Random(5)
    left, right = ({"".join(rng.choice("0123") for _ in range(rng.randrange(1, 6))) for _ in range(120)} for _ in range(2))
    got = {tuple(r) for r in audit.near_numbers(spark.createDataFrame([(x,) for x in left], "number string"), spark.createDataFrame([(x,) for x in right], "candidate string")).collect()}
    assert got == {(a, b) for a in left for b in right if osa(a, b) == 1}


@pytest.mark.parametrize("bucket", [200, 5])
def test_lsh_pairs_equal_brute_force(spark, monkeypatch, bucket):
    """Sets on one template share buckets with others that aren't similar, the smallest of them among these; 3 copies are one class."""
    monkeypatch.setattr(reuse, "BUCKET", bucket)
    sets = {0: set(range(100)) | set(range(10**7, 10**7 + 14))}
    for i in range(1, 41):
        both = range(1000 * (i // 2 + 1), 1000 * (i // 2 + 1) + 8)
        sets[i] = set(range(100)) | set(both) | set(range(10**5 * i, 10**5 * i + 8))
    sets |= {50: sets[7], 51: sets[7]}
    want = {(a, b) for a in range(41) for b in range(a + 1, 41) if 5 * len(sets[a] & sets[b]) >= 4 * len(sets[a] | sets[b])} | {(7, 50), (7, 51)}
    assert len(want) == 21
    df = spark.createDataFrame([(i, sorted(v), len(v)) for i, v in sets.items()], "doc long, hashes array<bigint>, n long")
    got = {(r["a"], r["b"]) for r in reuse.lsh_pairs(df).collect()}
    assert (want - got, got - want) == (set(), set())


def test_jaccard_pairs_equal_brute_force(spark):
    rng = random.Random(2)
    base = [[rng.choice("abcdefghij") for _ in range(60)] for _ in range(12)]
    texts = {}
    for i, words in enumerate(base):
        for j in range(4):
            w = list(words)
            for _ in range(j):
                w[rng.randrange(60)] = rng.choice("xyz")
            texts[4 * i + j] = " ".join(w)
    texts[100] = texts[0]
    df = spark.createDataFrame(list(texts.items()), "doc_id long, text string")
    sets = {d: {tuple(t.split()[i : i + 5]) for i in range(56)} for d, t in texts.items()}
    want = {(a, b): len(sets[a] & sets[b]) / len(sets[a] | sets[b]) for a, b in itertools.combinations(sorted(texts), 2)}
    want = {k: v for k, v in want.items() if v >= 0.5 and (100 not in k or k == (0, 100))}
    got = {(r["a"], r["b"]): r["jaccard"] for r in reuse.jaccard_pairs(reuse.shingled(df), 0.5).collect()}
    assert got.keys() == want.keys() and all(abs(got[k] - want[k]) < 1e-9 for k in want)


def test_gate_and_order(spark):
    c = spark.createDataFrame([(1, 1, 0.9, 1), (1, 2, 0.85, 2), (2, 1, 0.5, 1), (2, 2, 0.45, 2), (3, 1, 0.2, 1)], "query_id long, doc long, score double, rank int")
    assert {r["query_id"]: r["reason"] for r in ranking.gate(c).collect()} == {1: "clear_match", 2: "ambiguous", 3: "no_close_match"}
    o = spark.createDataFrame([(1, 1, 0.9, "not_declared", "match", "match", "Withdrawn"), (1, 2, 0.9, "not_declared", "match", "match", "Current"), (1, 3, 0.1, "in_band", "match", "match", "Current")], "query_id long, doc long, score double, voltage string, material string, role string, status string")
    assert [r["doc"] for r in ranking.order_candidates(o).orderBy("place").collect()] == [3, 2, 1]


def test_snapshots(spark):
    now = spark.createDataFrame([("a", 79), ("b", 80), ("c", 0), ("d", 5)], "name string, n long")
    before = spark.createDataFrame([("a", 100), ("b", 100), ("c", 1)], "name string, n long")
    assert {r["name"]: r["accepted"] for r in merge.shrink_guard(before, now).collect()} == {"a": False, "b": True, "c": False, "d": True}
    assert all(r["accepted"] == (r["name"] != "c") for r in merge.shrink_guard(before, now, allow=True).collect())
    held = spark.createDataFrame([("IS 1 (Part 2)", "Current", 1990), ("IS 2", "Current", 1990), ("IS 3", "Current", 1990)], "is_number string, status string, year int")
    portal = spark.createDataFrame([("IS 1 : Part 1", "Withdrawn", 1990), ("IS 2", "Withdrawn", 1995), ("IS 3", "Current", 1995)], "portal_number string, status string, year int")
    assert {tuple(r) for r in merge.amendments(held, portal).collect()} == {("IS 2", "Status", "Current", "Withdrawn"), ("IS 3", "Year", "1990", "1995")}
    m = spark.createDataFrame([(1, "x", "y"), (2, "x", "y")], "id long, a string, b string")
    n = spark.createDataFrame([(1, None)], "id long, a string")
    assert {tuple(r) for r in merge.owned_upsert(m, n, "id", ["a", "b"]).collect()} == {(1, None, "y"), (2, "x", "y")}
    assert {tuple(r) for r in merge.change_counts(m, n, "id", ["a", "b"]).collect()} == {("a", 1)}
    assert merge.symmetric_difference(m, m).count() == 0


def test_search_takes_wildcards_as_text(spark):
    df = spark.createDataFrame([("100% wool", "1"), ("100 wool", "2"), (None, "3")], "title string, is_digits string")
    assert paging.search(df, "0%", ["title"]).count() == 1
    assert [r["is_digits"] for r in paging.search(df, "IS 2", ["title"], "is_digits").collect()] == ["2"]
    with pytest.raises(ValueError, match="limit"):
        paging.page(df, ["title"], 501)


def test_evaluation(spark):
    assert evaluate.mcnemar_p(20, 13) == pytest.approx(0.296, abs=1e-3) and evaluate.mcnemar_p(0, 0) == 1.0
    b = evaluate.calibration(spark.createDataFrame([(1.0, True), (0.95, False), (0.1, False)], "score double, correct boolean"))
    assert {r["bucket"]: (r["n"], r["correct"]) for r in b.collect()} == {9: (2, 1), 1: (1, 0)}
    assert evaluate.calibration_error(b).first()["ece"] == pytest.approx((2 * 0.45 + 0.15) / 3, abs=1e-6)
    assert evaluate.confusion(spark.createDataFrame([], "truth boolean, said boolean")).first()["accuracy"] is None


def test_missing_connected(spark):
    cited = spark.createDataFrame([(1, "a"), (1, "b")], "doc_id long, item string")
    e = spark.createDataFrame([("a", "b", 0.9, 9), ("a", "c", 0.8, 9), ("b", "c", 0.7, 9), ("a", "d", 0.9, 9), ("a", "e", 0.9, 3)], "src string, dst string, confidence double, n_co long")
    got = audit.missing_connected(cited, e, spark.createDataFrame([("d",)], "item string")).collect()
    assert [(r["item"], r["source"]) for r in got] == [("c", "a")]


def test_dot_handles_float_vectors(spark):
    v = spark.createDataFrame([(1, [1.0, 0.0]), (2, [0.6, 0.8]), (3, [0.0, 1.0])], "vec_id long, embedding array<float>")
    q = v.where("vec_id = 1").select(F.col("vec_id").alias("query_id"), F.col("embedding").alias("query"))
    assert [(r["doc"], r["rank"]) for r in ranking.dense(v, q, 2).orderBy("rank").collect()] == [(2, 1), (3, 2)]


def test_small_tables_are_dealt_and_large_ones_are_not(spark, tmp_path):
    from citeloom.session import spread

    df = spark.range(20)
    df.coalesce(1).write.parquet(str(tmp_path / "one"))
    df.repartition(spark.sparkContext.defaultParallelism).write.parquet(str(tmp_path / "many"))
    one, many = (spark.read.parquet(str(tmp_path / x)) for x in ("one", "many"))
    assert spread(one, "id").rdd.getNumPartitions() == spark.sparkContext.defaultParallelism and sorted(r["id"] for r in spread(one, "id").collect()) == list(range(20))
    assert spread(many, "id") is many and spread(df, "id") is df


def test_candidates_of_one_document_are_verified_in_tasks_of_bounded_pairs(spark, monkeypatch):
    monkeypatch.setattr(reuse, "VERIFIED", 8)
    whole = {0: list(range(40))} | {d: list(range(40 - d % 12)) for d in range(1, 101)}
    sets = spark.createDataFrame([(d, h, len(h)) for d, h in whole.items()], "doc long, hashes array<bigint>, n long")
    got = reuse._verified(spark.createDataFrame([(0, d) for d in range(1, 101)], "a long, b long"), sets, 0.8)
    dealt = got.groupBy(F.spark_partition_id()).count().collect()
    assert {r["b"]: r["jaccard"] for r in got.collect()} == {d: len(h) / 40 for d, h in whole.items() if d and len(h) >= 32}
    assert len(dealt) > 8 and max(r["count"] for r in dealt) < 25


def test_clusters_are_made_from_pairs_at_their_own_threshold(spark, monkeypatch, sf):
    from citeloom.plans import catalogue

    asked, whole = [], reuse.jaccard_pairs
    monkeypatch.setattr(reuse, "jaccard_pairs", lambda sets, threshold: asked.append(threshold) or whole(sets, threshold))
    assert catalogue.QUERIES["reuse_clusters"](spark, sf).count() > 0 and asked == [0.8]
