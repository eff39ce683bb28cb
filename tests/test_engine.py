import pytest
from pyspark.sql import functions as F

from citeloom.engine import Engine
from citeloom.functions import clauses
from citeloom.operators import association, corpus, layout

REG = [("IS 1554 (Part 1)", "IS 1554", "1554", 1, "PVC cables", "Cables", "Withdrawn", None, 1988), ("IS 694", "IS 694", "694", 2, "PVC insulated cables for working voltages up to and including 1 100 V", "Cables", "Current", None, 2010), ("IS 9", "IS 9", "9", 3, "Code of practice for laying pipes", "Pipes", "Current", None, 1990)]


@pytest.fixture(scope="module")
def engine(spark):
    reg = spark.createDataFrame(REG, "is_number string, is_base string, is_digits string, load_ord long, title string, family string, status string, replaced_by string, year int")
    docs = spark.createDataFrame([(i, "Power", 2020 + i % 2, "Yes" if i % 2 else "No") for i in range(12)], "doc_id long, ministry string, year int, demands_mark string")
    cites = spark.createDataFrame([(i, c) for i in range(11) for c in ("IS 694", "IS 1554 (Part 1)")] + [(0, "IS 77")], "doc_id long, citation string")
    rules = spark.createDataFrame([("IS 694", "IS 694", 1, "Yes", "Scheme I", "1. Order (S.O. 2) dated 01-02-2020 Superseded by x")], "is_number string, is_base string, load_ord long, mandatory string, scheme string, notification string")
    edges = association.cocitation_edges(cites.select(F.col("doc_id").alias("basket"), F.col("citation").alias("item")), 1, 0.0, 1)
    return Engine(spark, reg, docs, cites, rules, edges)


def test_lookups(engine):
    assert engine.standards(q="cables", status="Current").count() == 1
    row = engine.standard("IS:694").first()
    assert row["hit"] == "IS 694" and row["mandatory"] is None
    assert engine.standard("IS 694").first()["mandatory"] == "Yes"
    assert engine.dead("IS 1554").first()["dead"] and engine.certifications().first()["notification"] == "Order (S.O. 2) dated 01-02-2020"
    assert [r["dst"] for r in engine.related("IS 77").collect()] == [] and engine.related("IS 694", 1).first()["dst"] == "IS 1554 (Part 1)"
    assert {r["dead_now"] for r in engine.tenders().collect()} == {"Yes", "No citations"} and engine.tender(3).count() == 1
    assert [(r["is_number"], r["documents"]) for r in engine.backlog().collect()] == [("IS 77", 1)]
    assert engine.evidence("IS 694").count() == 11


def test_flows(engine, spark, tmp_path):
    assert engine.route("as per IS 694") == "audit" and engine.route("a cable") == "draft"
    found = engine.audit_text("Cables to IS 694 and IS 1554 (Part 1), also IS 4321.").collect()
    assert {(r["kind"], r["action"]) for r in found} == {("statutory_omission", "add_clause"), ("dispute_risk", "replace"), ("not_in_register", "unresolved")}
    assert engine.audit_text("no numbers at all").count() == 0
    assert engine.recommend("insulated cable voltages").first()["doc"] == "IS 694"
    health = engine.health_index()
    assert health["headline"].first()["documents_dead"] == 11 and health["certification_gap"].first()["demanded"] == 5
    assert engine.neighbourhood("IS 694", 2).count() > 0 and set(engine.stats()) >= {"coverage", "status"}
    assert engine.graph_layout(min_count=1).count() == 3
    texts = spark.createDataFrame([(i, "power cable supply" if i < 5 else "chairs") for i in range(11)], "doc_id long, text string")
    assert {r["item"] for r in engine.peers("cable", texts).collect()} == {"IS 694", "IS 1554 (Part 1)", "IS 77"}
    d = spark.createDataFrame([("accepted", None), ("overridden", None)], "decision string, rationale string")
    assert engine.decide(d, str(tmp_path / "log")).count() == 1 and engine.decisions(str(tmp_path / "log")).first()["total"] == 1


def test_corpus_upkeep(engine, spark):
    texts = spark.createDataFrame([(1, "IS 694, IS 1554 (Part 1), IS 77; shall be certified"), (2, "nothing"), (3, None)], "doc_id long, text string")
    got = {r["doc_id"]: r for r in corpus.recite(texts, engine.register).collect()}
    assert got[1]["family"] == "Cables" and got[1]["unmatched"] == ["IS 77"] and got[1]["outdated"] == ["IS 1554 (Part 1)"] and got[2]["usability"] == "Not extractable"
    assert {r["doc_id"]: r["demands_mark"] for r in corpus.mark_scan(texts).collect()} == {1: "Yes", 2: "No", 3: "No attachment read"}
    assert corpus.reading_stats(texts.withColumn("scanned", F.col("text").isNull())).first()["distinct_citations"] == 3
    assert [r["citation"] for r in corpus.harvest(engine.edges, engine.register).collect()] == ["IS 77"]
    assert corpus.orphan_rules(engine.rules, engine.register).first()["orphans"] == 0
    row = corpus.scan_citations(texts, engine.register).first()
    assert row["kept"] == ["IS 1554 (Part 1)", "IS 694"] and row["dropped"] == ["IS 77"]
    rules = engine.rules.withColumn("product", F.lit("PVC insulated cables of copper"))
    assert corpus.golden_queries(rules, engine.register).first()["expected_is"] == "IS 694"
    assert corpus.ungrounded_rules(engine.register).count() > 0
    roles = corpus.by_role(engine.edges.join(engine.register.select(F.col("is_number").alias("dst"), "title"), "dst", "left"))
    assert {r["role"] for r in roles.collect()} == {"product"}
    b = spark.createDataFrame([(9, 40, 0.8), (1, 3, 0.1)], "bucket int, n long, accuracy double")
    s = spark.createDataFrame([(1, 0.95), (2, 0.12)], "q long, score double")
    assert {r["q"]: r["accuracy"] for r in corpus.calibration_line(s, b).collect()} == {1: 0.8, 2: None}


def test_clauses(engine, spark):
    df = engine.register.where("is_number = 'IS 694'")
    text = df.select(clauses.clause(F.col("is_number"), F.col("title"), F.col("family"), F.col("year"), F.col("status"), F.array(F.lit("IS 9")), F.lit("Yes"), F.lit("Scheme I")).alias("t")).first()["t"]
    assert text.startswith("All cables delivered must meet IS 694 : 2010") and "Standard Mark" in text
    cases = {"": "empty_response", "Sure, here": "not_a_clause", "The supplier shall ensure IS 694": "obligation_on_person_not_goods", "IS 694 with ISI mark": "invented_certification_duty",
             "IS 694 is optional": "unsupported_permissive_claim", "IS 694 and IS 4985": "subset_guard_failed", "Cables conform": "governing_standard_missing", "Cables shall conform to IS 694.": None}
    c = spark.createDataFrame([(k,) for k in cases], "t string").withColumn("p", clauses.phrasing_problem(F.col("t"), F.lit("IS 694"), F.array(F.lit("IS 694")), F.lit("No")))
    assert {r["t"]: r["p"] for r in c.collect()} == cases
    t = spark.createDataFrame([("cable 11 kV to IS 1554 (Part 1) IP66",)], "t string")
    m = t.select(clauses.masked(F.col("t")).alias("m"), clauses.protected_spans(F.col("t")).alias("s"))
    assert "1554" not in m.first()["m"] and m.select(clauses.restored(F.col("m"), F.col("s")).alias("r")).first()["r"] == "cable 11 kV to IS 1554 (Part 1) IP66"


def test_layout_keeps_nodes_apart(spark):
    rows = [(i, j, 1 + (i // 5 == j // 5) * 20) for i in range(20) for j in range(i)]
    xy = layout.layout(spark.createDataFrame(rows, "src long, dst long, n_co long")).collect()
    assert len({(r["x"], r["y"]) for r in xy}) == 20 and all(0 <= r["x"] <= layout.WIDTH for r in xy)
