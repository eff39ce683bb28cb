"""Spanning forest, counts kept up to date, the companion rule in order, and the health report in one reading, against plain rules."""

import random
from collections import Counter, defaultdict
from itertools import combinations

import pytest
from pyspark.sql import functions as F

from citeloom.operators import association, audit, components, health, reuse


def roots(edges):
    parent = {}

    def root(x):
        while parent.setdefault(x, x) != x:
            x = parent[x]
        return x

    for a, b in edges:
        parent[root(a)] = root(b)
    return {x: root(x) for x in parent}


@pytest.mark.parametrize("seed", range(3))
def test_forest_has_the_components_of_every_threshold(spark, seed):
    rng = random.Random(seed)
    edges = [(rng.randrange(60), rng.randrange(60), rng.choice([0.5, 0.5, 0.6, 0.7, 0.8, 0.9, 1.0])) for _ in range(70)]
    edges += [(1, 2, None), (None, 3, 0.9), (7, 7, 1.0), (100, 101, 0.5), (101, 100, 0.9)] + [(200, 200 + i, 1.0) for i in range(1, 30)]
    forest = [tuple(r) for r in components.maximum_forest(spark.createDataFrame(edges, "a int, b int, weight double")).collect()]
    real = [(a, b, w) for a, b, w in edges if None not in (a, b, w) and a != b]
    best = {}
    for a, b, w in real:
        best[min(a, b), max(a, b)] = max(w, best.get((min(a, b), max(a, b)), 0))
    assert all(best[a, b] == w for a, b, w in forest)
    thresholds = (0.0, 0.5, 0.55, 0.7, 0.9, 1.0, 2.0)
    sizes = {r["threshold"]: (r["components"], r["nodes"]) for r in components.forest_sizes(spark.createDataFrame(forest, "a int, b int, weight double"), thresholds).collect()}
    for t in thresholds:
        whole, cut = (roots([(a, b) for a, b, w in e if w >= t]) for e in (real, forest))
        groups = lambda r: sorted(sorted(x for x in r if r[x] == g) for g in set(r.values()))
        assert groups(whole) == groups(cut)
        assert sizes[t] == (len(set(whole.values())), len(whole))


def test_forest_and_sweep_of_nothing(spark):
    none = spark.createDataFrame([], "a int, b int, weight double")
    assert components.maximum_forest(none).collect() == []
    assert components.maximum_forest(spark.createDataFrame([(1, 1, 1.0)], none.schema)).collect() == []
    assert reuse.threshold_sweep(spark.createDataFrame([], "a int, b int, jaccard double")).collect() == []


def test_components_run_once_for_any_number_of_thresholds(spark, monkeypatch):
    pairs = spark.createDataFrame([(1, 2, 0.9), (2, 3, 0.6), (5, 6, 0.55)], "a int, b int, jaccard double")
    runs = []
    whole = components.maximum_forest
    monkeypatch.setattr(reuse, "maximum_forest", lambda e: runs.append(1) or whole(e))
    got = sorted(map(tuple, reuse.threshold_sweep(pairs, (0.5, 0.6, 0.7, 0.8, 0.9, 0.95)).collect()))
    assert got == [(0.5, 2, 5), (0.6, 1, 3), (0.7, 1, 2), (0.8, 1, 2), (0.9, 1, 2), (0.95, 0, 0)]
    assert len(runs) == 1


@pytest.mark.parametrize("touched", [association.TOUCHED, 0])
def test_changed_counts_equal_a_full_build(spark, monkeypatch, touched):
    monkeypatch.setattr(association, "TOUCHED", touched)
    rng = random.Random(touched)
    frame = lambda sets: spark.createDataFrame([(b, i) for b, s in sets.items() for i in s], "basket long, item string")
    sets = {b: {rng.choice("abcdefghij") for _ in range(rng.randrange(1, 5))} for b in range(40)}
    counts = association.basket_counts(frame(sets))
    for turn in (1, 2):
        gone = {b: sets[b] for b in rng.sample(sorted(sets), 12)}
        new = {b: {rng.choice("cdefghijkl") for _ in range(3)} for b in [*list(gone)[:5], *range(100 * turn, 100 * turn + 6)]}
        sets = {**{b: s for b, s in sets.items() if b not in gone}, **new}
        counts = spark.createDataFrame(association.changed_counts(counts, frame(new), frame(gone)).collect(), "u string, v string, n long")
        want = Counter({(None, None): len(sets)})
        for s in sets.values():
            want.update([*((i, None) for i in s), *combinations(sorted(s), 2)])
        assert {(r["u"], r["v"]): r["n"] for r in counts.collect()} == want
        full = association.cocitation_edges(frame(sets), min_co=2, min_confidence=0.1, min_src=1)
        assert sorted(map(tuple, association.counted_edges(counts, 2, 0.1, 1).collect())) == sorted(map(tuple, full.collect()))


def test_untouched_counts_are_not_shuffled(spark, tmp_path):
    rows = [(b, f"i{b % 50}") for b in range(500)] + [(b, f"j{b % 7}") for b in range(500)]
    held = spark.createDataFrame(rows, "basket long, item string")
    association.basket_counts(held).write.parquet(str(tmp_path / "c"))
    counts = spark.read.parquet(str(tmp_path / "c"))
    change = spark.createDataFrame([(1000, "i1"), (1000, "j1")], "basket long, item string")
    out = association.changed_counts(counts, change, held.limit(0))
    plan = out._jdf.queryExecution().optimizedPlan().toString()
    assert "LeftAnti" in plan and "LeftSemi" in plan
    physical = out._jdf.queryExecution().executedPlan().toString()
    assert "SortMergeJoin" not in physical and "BroadcastHashJoin" in physical or "BroadcastNestedLoop" in physical


def plain_companions(cited, edges, dead, confidence, support, per_source, total, fetched):
    out = []
    for doc, places in cited.items():
        held = set(places)
        best = {}
        for source in sorted(held, key=lambda i: (places[i], i)):
            near = sorted(((-c, -n, dst) for s, dst, n, c in edges if s == source and c >= confidence and n >= support))[:fetched]
            kept = 0
            for c, n, dst in near:
                if dst in held or dst in dead or (dst in best and best[dst][0] >= -c):
                    continue
                best[dst] = (-c, -n, source)
                kept += 1
                if kept >= per_source:
                    break
        ranked = sorted(best.items(), key=lambda x: (-x[1][0], -x[1][1]))[:total]
        out += [(doc, item, s, c, n, i + 1) for i, (item, (c, n, s)) in enumerate(ranked)]
    return sorted(out)


@pytest.mark.parametrize("seed", range(3))
def test_companions_in_order_equal_a_plain_loop(spark, seed):
    rng = random.Random(seed)
    items = list(range(30))
    edges = [(s, d, rng.randrange(1, 6), rng.choice([0.2, 0.4, 0.5, 0.6, 0.9])) for s in items for d in rng.sample(items, 12) if s != d]
    cited = {doc: {i: rng.randrange(4) for i in rng.sample(items, rng.randrange(1, 9))} for doc in range(25)}
    dead = set(rng.sample(items, 5))
    rows = [(doc, i, p) for doc, x in cited.items() for i, p in x.items()]
    rows += [(doc, i, p + 2) for doc, i, p in rows[::3]] + [(None, 1, 1)]
    rng.shuffle(rows)
    limits = {"confidence": 0.4, "support": 2, "per_source": 2, "total": 4, "fetched": 5}
    got = audit.missing_in_order(spark.createDataFrame(rows, "doc_id long, item long, place int").repartition(5), spark.createDataFrame(edges, "src long, dst long, n_co long, confidence double"), spark.createDataFrame([(i,) for i in dead] * 2, "item long"), **limits)
    assert sorted(map(tuple, got.collect())) == plain_companions(cited, edges, dead, *limits.values())


def test_profile_reads_the_fact_once(spark):
    rng = random.Random(1)
    docs = {d: (rng.choice([1999, 2000, None]), rng.choice("xy"), rng.choice(["m1", "m2", "m3", None])) for d in range(60)}
    dead = {"b1", "b3", "b4"}
    rows = [(d, b, b in dead, *docs[d]) for d in docs for b in rng.sample(["b1", "b2", "b3", "b4", "b5"], rng.randrange(1, 4))]
    fact = spark.createDataFrame(rows, "doc_id long, base string, dead boolean, year int, department string, ministry string")
    reads = spark.sparkContext.accumulator(0)

    def counted(batches):
        for batch in batches:
            reads.add(batch.num_rows)
            yield batch

    got = {(r["kind"], r["key"]): tuple(r)[2:] for r in health.profile(fact.mapInArrow(counted, fact.schema), ("year", "department"), "ministry").collect()}
    assert reads.value == len(rows)
    want = {}
    for kind, key in [("all", lambda r: None), ("year", lambda r: None if r[3] is None else str(r[3])), ("department", lambda r: r[4]), ("ministry", lambda r: r[5])]:
        groups = defaultdict(list)
        for r in rows:
            groups[key(r)].append(r)
        for k, g in groups.items():
            top = min(((-n, b) for b, n in Counter(r[1] for r in g if r[2]).items()), default=None) if kind == "ministry" else None
            want[kind, k] = (len({r[0] for r in g}), len({r[0] for r in g if r[2]}), top and top[1], top and -top[0])
    for b in {r[1] for r in rows}:
        n = sum(r[1] == b for r in rows)
        want["base", b] = (n, n if b in dead else 0, None, None)
    assert got == want


def test_pairs_of_a_shingle_in_many_prefixes(spark, monkeypatch):
    monkeypatch.setattr(reuse, "PART", 4)
    rng = random.Random(3)
    base = list(range(50))
    sets = {d: sorted({*rng.sample(base, 46), *(1000 + rng.randrange(30) for _ in range(2))}) for d in range(40)} | {100 + d: [rng.randrange(10_000) for _ in range(45)] for d in range(10)}
    sets = {d: sorted(set(s)) for d, s in sets.items()} | {200: sorted(set(sets[0]))}
    frame = spark.createDataFrame([(d, s, len(s)) for d, s in sets.items()], "doc long, hashes array<bigint>, n bigint")
    for threshold in (0.8, 0.9):
        want = {}
        for a, b in combinations(sorted(sets), 2):
            j = len(set(sets[a]) & set(sets[b])) / len(set(sets[a]) | set(sets[b]))
            if j >= threshold and 200 not in (a, b):
                want[a, b] = j
        got = {(r["a"], r["b"]): r["jaccard"] for r in reuse.jaccard_pairs(frame, threshold).collect()}
        assert got.pop((0, 200)) == 1.0 and got == want


def test_baskets_are_dealt_to_tasks_of_bounded_rows(spark, monkeypatch):
    monkeypatch.setattr(association, "ROWS", 10)
    rng = random.Random(5)
    rows = [(b, rng.randrange(12)) for b in range(120) for _ in range(4)] + [(None, 1), (1, None)]
    df = spark.createDataFrame(rows, "basket int, item int")
    pairs = association._paired(*association._sets(df, "basket", "item"))
    dealt = [r["count"] for r in pairs.groupBy(F.spark_partition_id()).count().collect()]
    want = Counter(p for b in range(120) for p in combinations(sorted({i for x, i in rows if x == b and i is not None}), 2))
    assert Counter((r["u"], r["v"]) for r in pairs.collect()) == want
    assert len(dealt) > 24 and max(dealt) < sum(want.values()) / 8


def test_the_fact_is_dealt_before_it_is_expanded(spark, monkeypatch):
    monkeypatch.setattr(health, "ROWS", 5)
    dealt, whole = [], health.dealt_to
    monkeypatch.setattr(health, "dealt_to", lambda df, each: dealt.append((df.count(), whole(df, each))) or dealt[-1][1])
    rows = [(d, f"IS {b}", b % 3 == 0, 2000 + d % 2, f"m{d % 3}") for d in range(30) for b in range(d % 4 + 1)]
    f = spark.createDataFrame(rows, "doc_id int, base string, dead boolean, year int, ministry string")
    got = {(r["kind"], r["key"]): (r["documents"], r["documents_dead"]) for r in health.profile(f, ("year",), "ministry").collect()}
    assert dealt == [(len(rows), -(-len(rows) // 5))]
    assert got["all", None] == (30, 30) and got["year", "2000"] == (15, 15) and got["ministry", "m1"] == (10, 10) and got["base", "IS 2"] == (len([r for r in rows if r[1] == "IS 2"]), 0)


def test_counts_are_summed_in_tasks_of_bounded_rows(spark, monkeypatch):
    monkeypatch.setattr(association, "PAIRS", 20, raising=False)
    monkeypatch.setattr(association, "TOUCHED", 0)
    rng = random.Random(6)
    frame = lambda sets: spark.createDataFrame([(b, i) for b, s in sets.items() for i in s], "basket int, item int")
    old, new = ({b: rng.sample(range(30), 4) for b in range(at, at + 60)} for at in (0, 100))
    counts = association.changed_counts(association.basket_counts(frame(old)), frame(new), frame({b: old[b] for b in range(20)}))
    dealt = [r["count"] for r in counts.groupBy(F.spark_partition_id()).count().collect()]
    assert max(dealt) < sum(dealt) / 8  # the session has 4 shuffle partitions
    left = [s for b, s in {**old, **new}.items() if b >= 20]
    want = Counter({(None, None): len(left)})
    for s in left:
        want.update([*((i, None) for i in s), *combinations(sorted(s), 2)])
    assert {(r["u"], r["v"]): r["n"] for r in counts.collect()} == want


def test_candidates_without_an_edge_are_not_made_for_every_document(spark):
    frame = lambda rows, schema: spark.createDataFrame(rows, schema)
    known = [str(n) for n in range(501, 510)] + [f"5{n}0" for n in range(1, 10)] + [f"{n}00" for n in (1, 2, 3, 4, 6, 7, 8, 9)] + ["77"]
    found = audit.did_you_mean(frame([(d, "500") for d in range(200)], "doc_id int, number string"), frame([(d, "77") for d in range(200)], "doc_id int, number string"), frame([(n,) for n in known], "number string"), frame([("503", "77", 4), ("77", "900", 3)], "a string, b string, n_co long"))
    assert {tuple(r) for r in found.collect()} == {(d, "500", "503", 4) for d in range(200)}
    made, rest = [], [found._jdf.queryExecution().executedPlan()]
    while rest:
        p = rest.pop()
        if "Join" in p.nodeName():
            made.append(p.metrics().get("numOutputRows").get().value())
        inner = p.executedPlan() if "AdaptiveSparkPlan" in p.nodeName() else p.plan() if "QueryStage" in p.nodeName() else None
        rest += [inner] if inner is not None else [p.children().apply(i) for i in range(p.children().size())]
    assert max(made) <= 400  # 26 candidates in 200 documents are 5,200
