import itertools
import random
from collections import Counter

import corpus_pipeline as P
import duckdb
from pyspark.sql import functions as F

from citeloom.llm import decontaminate, mixing, simhash, toxicity
from citeloom.llm.labelled import fold

DOC = "doc_id long, text string, lang string, source string, n_chars long"


def test_stages_take_effect(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    sizes, columns = [docs.count()], docs.columns
    for _, stage in P.STAGES[:-1]:
        docs = stage(spark, docs, sf).cache()
        assert docs.columns == columns
        sizes.append(docs.count())
    assert sizes[1] < sizes[0] and sizes[2] < sizes[1] and sizes[3] < sizes[2]
    last = P.STAGES[-1][1](spark, docs, sf)
    assert last.count() == sizes[-1]
    bench = spark.read.parquet(f"{sf}/benchmark.parquet")
    assert decontaminate.contaminated(docs, bench).count() == 0
    assert P.run(spark, sf).count() == sizes[-1]


def test_stages_on_odd_rows(spark, sf):
    rng = random.Random(1)
    rows = [(1, None, None, None, None), (2, "", "en", "a", 0), (3, "x y", "en", "a", 3), (3, "x y", "en", "a", 3), (None, "some words here", None, "b", 15), (4, " ".join(str(rng.random()) for _ in range(5000)), "en", "b", 1)]
    for docs in (spark.createDataFrame(rows, DOC), spark.createDataFrame([], DOC)):
        docs = docs.withColumns({"score": F.lit(1), "copies": F.lit(2)})
        for name, stage in P.STAGES:
            out = stage(spark, docs, sf)
            assert out.count() <= 2 * max(docs.count(), 0)
            if name == "near-duplicates" and docs.count():
                assert sorted(r["doc_id"] or 0 for r in out.collect()) == [0, 1, 3, 4]


def test_stages_equal_brute_force(spark, sf, tmp_path):
    """Each stage on what the one before kept, against a plain rule over the collected rows."""
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    stage = dict(P.STAGES)
    rows = lambda df: Counter(tuple(r) for r in df.collect())

    def written(df, name):
        df.write.parquet(str(tmp_path / name))
        return spark.read.parquet(str(tmp_path / name))

    kept = written(stage["toxicity"](spark, docs, sf), "a")
    model = toxicity.train(docs, spark.read.parquet(f"{sf}/labels.parquet"), fold("doc_id", 5) != 0)
    assert rows(kept) == Counter(tuple(r) for r in docs.collect() if model.score(r["text"]) < 0.5)

    single = written(stage["near-duplicates"](spark, kept, sf), "b")
    texts = {r["doc_id"]: set(simhash.shingle_set((r["text"] or "").encode()).tolist()) for r in kept.collect()}
    low = {i: i for i in texts}
    links = [(a, b) for a, b in itertools.combinations(sorted(texts), 2) if 5 * len(texts[a] & texts[b]) >= 4 * len(texts[a] | texts[b])]
    while any(low[a] != low[b] for a, b in links):
        for a, b in links:
            low[a] = low[b] = min(low[a], low[b])
    assert links and sorted(r["doc_id"] for r in single.collect()) == sorted(i for i in texts if low[i] == i)

    clean = written(stage["decontamination"](spark, single, sf), "c")
    index = next(decontaminate.indexes(spark.read.parquet(f"{sf}/benchmark.parquet")))
    assert rows(clean) == Counter(tuple(r) for r in single.collect() if not decontaminate._find(index, (r["text"] or "").encode()))

    mixed = written(stage["mixing"](spark, clean, sf), "d")
    c = duckdb.connect()
    c.sql(f"CREATE VIEW documents AS SELECT * FROM '{tmp_path}/c/*.parquet'")
    want = Counter({d: t // s for d, s, _, _, t in c.sql(mixing.SQL).fetchall() if s and t})
    got = Counter(r["doc_id"] for r in mixed.collect() if (r["text"] or "").split())
    assert got == want

    stored = stage["sharding"](spark, mixed, sf)
    assert Counter(r["doc_id"] for r in stored.collect()) == Counter(r["doc_id"] for r in mixed.collect())
    assert stored.select("shard", "shard_row").distinct().count() == mixed.count()


def test_of_rows_that_share_an_id_the_smallest_text_stays(spark):
    texts = [" ".join(f"{w}{i}" for i in range(30)) for w in ("late", "early", "other")]
    rows = [(1, texts[0], 1), (1, texts[1], 2), (1, texts[1], 2), (2, texts[2], 3), (2, None, 4)]
    for given in (rows, rows[::-1]):
        docs = spark.createDataFrame(given, "doc_id long, text string, lang int")
        assert sorted(map(tuple, simhash.keep_one(docs).collect())) == [(1, texts[1], 2), (2, None, 4)]
