import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from citeloom import session
from citeloom.engine import Engine
from citeloom.operators import association, evaluate, forward, merge, ranking, reuse

REGISTER = "is_number string, is_base string, is_digits string, load_ord long, title string, family string, status string, replaced_by string, year int, title_hi string"
ROWS = [
    ("IS 7098 (Part 1)", "IS 7098", "7098", 1, "XLPE cables for working voltages up to and including 1 100 V", "Cables", "Current", None, 1988, "केबल"),
    ("IS 7098 (Part 2)", "IS 7098", "7098", 2, "XLPE cables for working voltages from 3.3 kV up to and including 33 kV", "Cables", "Current", None, 2011, "पानी पाइप"),
    ("IS 4985", "IS 4985", "4985", 3, "Unplasticized PVC pipes for potable water supplies", "Pipes", "Current", None, 2021, None),
    ("IS 4984", "IS 4984", "4984", 4, "HDPE pipes for water supply", "Pipes", "Withdrawn", "IS 4985", 2016, None),
    ("IS 9", "IS 9", "9", 5, "Code of practice for laying pipes for potable water supplies", "Pipes", "Current", None, 1990, None),
]


@pytest.fixture(scope="module")
def register(spark):
    rest = [(f"IS {i}", f"IS {i}", str(i), i, f"Item {i} of wood and paint", "Things", "Current", None, 2000, None) for i in range(100, 140)]
    return spark.createDataFrame(ROWS + rest, REGISTER)


@pytest.fixture(scope="module")
def tables(spark, register):
    edges = spark.createDataFrame([("IS 4985", "IS 9", 5, 0.9), ("IS 4985", "IS 4984", 9, 0.6), ("IS 4985", "IS 555", 3, 0.5), ("IS 9", "IS 4984", 2, 0.1)], "src string, dst string, n_co long, confidence double")
    rules = spark.createDataFrame([("IS 4985", "IS 4985", 1, "Yes", "Scheme I", "x")], "is_number string, is_base string, load_ord long, mandatory string, scheme string, notification string")
    return register, edges, rules


def test_forward_query_recommends_and_abstains(spark, tables):
    register, edges, rules = tables
    asked = [(1, "uPVC pipes for potable water supplies"), (2, "XLPE cables"), (3, "XLPE cables for 11 kV"), (4, "zebra crossing stripes"), (5, ""), (6, None), (7, "பைப் குழாய்"), (8, "पानी पाइप")]
    found, answers = forward.recommend(spark.createDataFrame(asked, "query_id long, text string"), register, edges, rules)
    got = {r["query_id"]: r for r in answers.collect()}
    assert set(got) == set(range(1, 9))
    assert got[1]["decision"] == "recommend" and got[1]["doc"] == "IS 4985" and got[1]["mandatory"] == "Yes"
    assert got[1]["related"] == ["IS 9", "IS 4984", "IS 555"] and "Standard Mark" in got[1]["clause"] and "IS 4985 : 2021" in got[1]["clause"]
    assert got[3]["doc"] == "IS 7098 (Part 2)"
    assert {got[i]["reason"] for i in (4, 5, 6)} == {"no_candidates"} and got[7]["reason"] == "translation_unavailable"
    assert got[8]["doc"] == "IS 7098 (Part 2)" and all(got[i]["clause"] is None for i in (4, 5, 6, 7))
    places = [(r["place"], r["voltage"]) for r in found.where("query_id = 3").orderBy("place").collect()]
    assert places[0] == (1, "in_band") and len(places) <= forward.SHOWN
    roles = {r["role"]: r for r in forward.allied(answers.where("query_id = 1"), edges, register).collect()}
    assert set(roles) == {"product", "installation"} and roles["installation"]["likely"] == ["IS 9"] and roles["installation"]["place"] == 3


def test_gate_gives_all_reasons(spark):
    cols = "query_id long, doc string, score double, rank int, is_base string, title string, stated double"
    low, high = "for voltages up to and including 1 100 V", "for voltages from 3.3 kV up to and including 33 kV"
    rows = [(1, "a", 0.95, 1, "x", low, None), (1, "b", 0.93, 2, "x", high, None), (2, "a", 0.95, 1, "x", low, 11000.0), (2, "b", 0.93, 2, "x", high, 11000.0), (3, "a", 0.95, 1, "x", low, None), (3, "b", 0.93, 2, "y", high, None), (4, "a", 0.95, 1, "x", low, None), (4, "b", 0.5, 2, "x", high, None), (5, "a", 0.95, 1, "x", low, None), (5, "b", 0.93, 2, "x", low, None), (6, "a", 0.1, 1, "x", low, None), (7, "a", 0.6, 1, "x", None, None), (7, "b", 0.55, 2, "x", None, None)]
    got = ranking.gate(spark.createDataFrame(rows, cols), queries=spark.range(1, 9).withColumnRenamed("id", "query_id")).collect()
    assert {r["query_id"]: r["reason"] for r in got} == {1: "voltage_unspecified", 2: "clear_match", 3: "clear_match", 4: "clear_match", 5: "clear_match", 6: "no_close_match", 7: "ambiguous", 8: "no_candidates"}
    assert {r["decision"] for r in got if r["reason"] != "clear_match"} == {"abstain"}


def test_strategies_run_or_are_refused(spark):
    r = spark.createDataFrame([(1, f"d{i}", 1.0 - i / 50, i + 1) for i in range(15)], "query_id long, doc string, score double, rank int")
    edges = spark.createDataFrame([("d0", "n", 4), ("d1", "d2", 9)], "src string, dst string, n_co long")
    both = {"bm25": r, "dense": r}
    assert ranking.run_strategy("dense", both).count() == 10
    grown = {x["doc"]: (x["score"], x["rank"]) for x in ranking.run_strategy("graph_expand", both, edges).collect()}
    assert grown["n"] == (0.0, 11) and len(grown) == 11
    with pytest.raises(ValueError, match="model"):
        ranking.run_strategy("hybrid_ce", both)
    turned = ranking.run_strategy("hybrid_ce", both, rerank=lambda c: c.withColumn("score", 1.0 - F.col("score")))
    assert turned.where("rank = 1").first()["doc"] == "d9"


@pytest.mark.parametrize("block", [1024, 3])
def test_bm25_equals_plain_rule(spark, monkeypatch, block):
    monkeypatch.setattr(ranking, "QUERIES", block)
    rng = random.Random(4)
    words = [f"w{i}" for i in range(30)] + ["the"] * 20
    docs = [(i, " ".join(rng.choice(words) for _ in range(rng.randrange(0, 30)))) for i in range(60)] + [(60, None), (61, "")]
    asked = [(i, " ".join(rng.choice(words) for _ in range(6))) for i in range(9)] + [(9, ""), (10, None), (11, "unknown words")]
    got = {}
    for r in ranking.bm25(spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(asked, "item_id long, text string"), 5).collect():
        got.setdefault(r["query_id"], []).append((r["rank"], r["doc"], r["score"]))
    texts = {i: (t or "").split() for i, t in docs}
    n, avg = len(texts), sum(map(len, texts.values())) / len(texts)
    raw = {w: np.log(n - d + 0.5) - np.log(d + 0.5) for w in set(words) if (d := sum(w in t for t in texts.values()))}
    idf = {w: v if v >= 0 else 0.25 * np.mean(list(raw.values())) for w, v in raw.items()}
    for q, text in asked:
        terms = [w for w in (text or "").split() if w in idf]
        score = {i: round(float(sum(idf[w] * t.count(w) * 2.5 / (t.count(w) + 1.5 * (0.25 + 0.75 * len(t) / avg)) for w in terms)), 6) for i, t in texts.items() if set(t) & set(terms)}
        best = sorted(score.items(), key=lambda x: (-x[1], x[0]))[:5]
        assert [(d, pytest.approx(s, abs=2e-6)) for _, d, s in sorted(got.get(q, []))] == best


@pytest.mark.parametrize("block", [1024, 2])
def test_dense_equals_brute_force(spark, monkeypatch, block):
    monkeypatch.setattr(ranking, "QUERIES", block)
    x = np.random.default_rng(1).normal(size=(80, 6)).astype(np.float32)
    rows = [(i, [float(v) for v in x[i]]) for i in range(80)] + [(90, None), (91, [1.0])]
    v = spark.createDataFrame(rows, "vec_id long, embedding array<float>")
    q = v.where("vec_id % 20 = 0").select(F.col("vec_id").alias("query_id"), F.col("embedding").alias("query"))
    got = {(r["query_id"], r["rank"]): r["doc"] for r in ranking.dense(v.repartition(3), q, 4).collect()}
    s = x.astype(float) @ x.astype(float).T
    np.fill_diagonal(s, -np.inf)
    assert got == {(i, k + 1): int(j) for i in range(0, 80, 20) for k, j in enumerate(np.argsort(-s[i])[:4])}


def test_peers_dead_first_and_report(spark):
    scored = spark.createDataFrame([(1, d, 1.0 - d / 100) for d in range(5)] + [(2, 0, 1.0), (2, 1, 0.1), (2, 2, 0.1)], "query_id long, doc long, score double")
    cited = spark.createDataFrame([(d, "live") for d in range(5)] + [(0, "old"), (3, "old"), (3, "older")], "doc long, item string")
    dead = spark.createDataFrame([("old",), ("older",)], "item string")
    rows = [(r["item"], r["documents"], r["dead"]) for r in ranking.peers(scored, cited, dead=dead).collect()]
    assert rows == [("old", 2, True), ("older", 1, True), ("live", 5, False)]
    docs = spark.createDataFrame([(d, f"b{d % 2}", "x" * 200) for d in range(5)], "doc long, buyer string, category string")
    r = ranking.peer_report(scored, cited.join(dead, "item"), docs).collect()
    assert len(r) == 1 and r[0]["repeating"] == 2 and [(x["doc"], x["dead"]) for x in r[0]["repeats"]] == [(3, ["old", "older"]), (0, ["old"])]
    assert r[0]["buyers"] == ["b0", "b1"] and [len(x) for x in r[0]["examples"]] == [110] * 4


def test_large_baskets_are_paired_in_parts(spark, monkeypatch):
    rows = [(b, i) for b in range(3) for i in range(b, b + 23)]
    df = spark.createDataFrame(rows, "basket long, item long")
    whole = sorted(map(tuple, association.cocitation_edges(df).collect()))
    monkeypatch.setattr(association, "PART", 4)
    assert whole and sorted(map(tuple, association.cocitation_edges(df).collect())) == whole


def test_related_by_number_only_without_other_edges(spark, tables):
    asked = spark.createDataFrame([("IS 4985 (Part 3)",), ("IS:04985",), ("IS 1",)], "citation string")
    got = {(r["citation"], r["dst"]) for r in association.related_of(asked, tables[1]).collect()}
    assert got == {(c, d) for c in ("IS 4985 (Part 3)", "IS:04985") for d in ("IS 9", "IS 4984", "IS 555")}


def test_engine_lists_paths_exports(spark, tables, tmp_path):
    register, edges, rules = tables
    docs = spark.createDataFrame([(i, "Power", 2020, "Yes", "Pumps" if i else None) for i in range(8)], "doc_id long, ministry string, year int, demands_mark string, category string")
    cites = spark.createDataFrame([(i, c) for i in range(7) for c in ("IS 4985", "IS 4984")] + [(0, "IS 4986"), (1, "IS 77")], "doc_id long, citation string")
    e = Engine(spark, register, docs, cites, rules, edges)
    page = e.standards(q="pipes", sort="year", descending=True, limit=2).collect()
    assert [r["is_number"] for r in page] == ["IS 4985", "IS 4984"] and {r["total"] for r in page} == {3}
    with pytest.raises(ValueError, match="no column"):
        e.standards(sort="nothing")
    assert e.certifications(scheme="Scheme I").count() == 1 and e.certifications(scheme="Scheme X").count() == 0
    t = {r["doc_id"]: r for r in e.tenders(ministry="Power").collect()}
    assert t[0]["dead_now"] == "Yes" and t[7]["dead_now"] == "No citations" and t[1]["title"] == "Pumps" and t[1]["title_derived"] and t[0]["total"] == 8
    row = e.evidence("IS 4985", limit=3).collect()
    assert len(row) == 3 and row[0]["documents"] == 7 and row[0]["share_pct"] == 87.5 and row[0]["truncated"]
    assert e.path("IS 555", "IS 4984").first()["path"] == ["IS 555", "IS 4985", "IS 4984"]
    assert {r["node"]: r["status"] for r in e.graph_nodes(min_count=1).collect()}["IS 555"] == "Unknown" and e.graph_summary(min_count=1).first()["truncated"] is False
    assert e.standard("IS 4985").first()["related"][0] == "IS 9"
    found, verdict = e.audit_report("Pipes to IS 4985 and IS 4984; see IS 4986.")
    kinds = {r["kind"]: r for r in found.collect()}
    assert set(kinds) == {"dispute_risk", "statutory_omission", "not_in_register"} and verdict.first()["verdict"] == "blocking"
    assert kinds["not_in_register"]["did_you_mean"] in ("IS 4985", "IS 4984")
    e.export("backlog", str(tmp_path / "b"))
    assert {r["is_number"] for r in spark.read.option("header", True).csv(str(tmp_path / "b")).collect()} == {"IS 77", "IS 4986"}
    with pytest.raises(ValueError, match="exportable"):
        e.export("secrets", str(tmp_path / "s"))
    texts = spark.createDataFrame([(i, "water pipe supply" if i < 3 else "chairs") for i in range(8)], "doc_id long, text string")
    assert [(r["item"], r["documents"], r["dead"]) for r in e.peers("pipe", texts).collect()][0] == ("IS 4984", 3, True)
    named = docs.select(F.col("doc_id").alias("doc"), F.col("ministry").alias("buyer"), "category")
    assert e.peer_report("pipe", texts, named).first()["repeating"] == 3
    with pytest.raises(ValueError, match="characters"):
        e.route("x" * 400_001)
    candidates, answers = e.answer("uPVC pipes for potable water supplies")
    assert answers.first()["doc"] == "IS 4985" and candidates.count() > 0


def test_change_counts_and_lsh(spark):
    m = spark.createDataFrame([(1, "a", None), (2, "b", 3)], "id long, x string, y int")
    n = spark.createDataFrame([(1, "z", None), (2, "b", 4), (9, "q", 1)], "id long, x string, y int")
    assert {r["column"]: r["changed"] for r in merge.change_counts(m, n, "id", ["x", "y", "gone"]).collect()} == {"x": 1, "y": 1}
    rng = random.Random(3)
    rows = []
    for g in range(25):
        w = [f"{g}x{rng.randrange(999)}" for _ in range(120)]
        for k in range(4):
            v = list(w)
            for _ in range(k):
                v[rng.randrange(120)] = f"n{rng.random()}"
            rows.append((4 * g + k, " ".join(v)))
    sets = reuse.shingled(spark.createDataFrame(rows, "doc_id long, text string"))
    exact = {(r["a"], r["b"]) for r in reuse.jaccard_pairs(sets, 0.7).collect()}
    found = {(r["a"], r["b"]) for r in reuse.lsh_pairs(sets, 0.7).collect()}
    assert found <= exact and len(found) >= 0.95 * len(exact) > 50
    same = lambda pairs: {(r["doc"], r["cluster"]) for r in reuse.clusters(pairs).collect()}
    assert same(reuse.lsh_pairs(sets, 0.7)) == same(reuse.jaccard_pairs(sets, 0.7))


def test_samples_and_timing(spark):
    flags = spark.range(200).select(F.col("id").alias("doc_id"), (F.col("id") % 50 == 0).alias("truth"))
    got = sorted(map(tuple, evaluate.flagged_sample(flags, 20).collect()))
    assert len(got) == 24 and got == sorted(map(tuple, evaluate.flagged_sample(flags.repartition(5), 20).collect()))
    assert evaluate.timed(lambda: flags, 10)["rows"] == 200


def test_shared_folder_is_asked_for_on_a_cluster(spark, monkeypatch):
    class Conf:
        def get(self, *_):
            return None

    class Undefined:
        def isDefined(self):
            return False

    class Context:
        def getCheckpointDir(self):
            return Undefined()

        def isLocal(self):
            return False

    jsc = type("J", (), {"sc": lambda self: Context()})()
    fake = type("S", (), {"conf": Conf(), "sparkContext": type("C", (), {"_jsc": jsc})()})()
    with pytest.raises(RuntimeError, match="checkpoint"):
        session.shared_dir(fake)


def test_entry_tells_missing_from_broken(monkeypatch):
    import sys

    import __spark_entry__ as e

    class Gone:
        def __init__(self, name, missing):
            self.name, self.missing = name, missing

        def find_spec(self, name, path=None, target=None):
            if name == self.name:
                raise ModuleNotFoundError(f"No module named {self.missing!r}", name=self.missing)

    held = {k: v for k, v in sys.modules.items() if k.startswith("citeloom.llm") or k == "corpus_pipeline"}
    for name, missing, ok in (("citeloom.llm", "citeloom.llm", True), ("citeloom.llm", "xxhash", False)):
        for k in held:
            monkeypatch.delitem(sys.modules, k, raising=False)
        monkeypatch.setattr(sys, "meta_path", [Gone(name, missing), *sys.meta_path])
        monkeypatch.delattr("citeloom.llm", raising=False) if not held else None
        if ok:
            assert not [q for q in e.queries() if q.startswith("op")]
        else:
            with pytest.raises(ModuleNotFoundError):
                e.queries()
        monkeypatch.undo()
