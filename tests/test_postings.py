import random
import re
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest

from citeloom.operators import postings, ranking


def batch_of(texts, vocabulary):
    counts = [Counter(t for t in x if t in vocabulary) for x in texts]
    place = {t: i for i, t in enumerate(vocabulary)}
    rows = [sorted((place[t], n) for t, n in c.items()) for c in counts]
    columns = [pa.array(range(len(texts))), pa.array([len(x) for x in texts], pa.int64()), pa.array([[a for a, _ in r] for r in rows], pa.list_(pa.int32())), pa.array([[b for _, b in r] for r in rows], pa.list_(pa.int32()))]
    return pa.RecordBatch.from_arrays(columns, ["doc", "n", "terms", "tfs"])


@pytest.mark.parametrize("seed", range(4))
def test_blocks_give_the_best_of_all_documents(seed):
    rng = random.Random(seed)
    words = [f"w{i}" for i in range(60)]
    chance = [1 / (i + 1) for i in range(60)]
    texts = [rng.choices(words, chance, k=rng.choice([3, 10, 40, 200])) for _ in range(3000)]
    texts[100:130] = [texts[100]] * 30  # ties
    avgdl = sum(map(len, texts)) / len(texts)
    own = ranking.Postings(postings.Segment([batch_of(texts, words)], ("n", "doc")), avgdl)
    for _ in range(20):
        asked = {rng.randrange(60): rng.choice([0.1, 1.5, 4.0, 7.0, -0.2]) for _ in range(rng.randrange(1, 8))}
        scores = {}
        for i, x in enumerate(texts):
            c = Counter(x)
            if any(words[t] in c for t in asked):
                scores[i] = round(sum(w * c[words[t]] * 2.5 / (c[words[t]] + 1.5 * (0.25 + 0.75 * len(x) / avgdl)) for t, w in asked.items()), 6)
        want = sorted(((-s, i) for i, s in scores.items()))[:10]
        rows, found, _ = own.best(list(asked.items()), 10)
        got = sorted((-s, own.ids[int(r)].as_py()) for r, s in zip(rows, found))
        assert got == [(pytest.approx(s, abs=2e-6), i) for s, i in want]
        floor = -want[4][0] if len(want) > 4 else 0
        rows, found, _ = own.best(list(asked.items()), 10, floor)
        assert len(rows) == sum(-s >= floor for s, _ in want)


def test_documents_that_cannot_win_are_not_scored():
    rng = random.Random(9)
    texts = [["the"] * rng.randrange(1, 4) + [f"x{rng.randrange(500)}" for _ in range(rng.randrange(2, 300))] for _ in range(20_000)]
    own = ranking.Postings(postings.Segment([batch_of(texts, ["the", "x7", "x8"])], ("n", "doc")), 150.0)
    _, found, scored = own.best([(0, 0.3), (1, 6.0), (2, 6.0)], 10)
    assert len(found) == 10 and scored < 0.4 * len(texts)


def test_words_of_bytes_equal_the_pattern():
    words = ranking.terms_of(ranking.LATIN)
    for text in ("IS 456:2000, Part-2", "Éa KELVIN K5 İx straße", "", "日本 a1B2", "a\x00b\x7fc_d"):
        assert words(text.encode()) == re.findall("[a-z0-9]+", text.lower())
    assert ranking.terms_of(ranking.INDIC)("सीमेंट OPC ४३".encode()) == re.findall(ranking.INDIC, "सीमेंट OPC ४३".lower())


def test_tallies_count_documents_of_every_word(spark, monkeypatch):
    monkeypatch.setattr(postings, "TALLY", 3)
    texts = ["a b a", "b c", "", None, "d e f g a"]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(2)
    counts = postings.counted(docs, ["a", "c"], ranking.terms_of(ranking.LATIN), tallied=True)
    want = Counter(w for t in texts for w in set((t or "").split()))
    assert {r["word"]: r["df"] for r in postings.tallies(counts).collect()} == want
    rows = {r["doc"]: (r["n"], r["terms"], r["tfs"]) for r in counts.where("terms IS NOT NULL").collect()}
    assert rows == {0: (3, [0], [2]), 1: (2, [1], [1]), 2: (0, [], []), 3: (0, [], []), 4: (5, [0], [1])}
    assert postings.frequencies(counts.where("terms IS NOT NULL"), 2).tolist() == np.array([2, 1]).tolist()


def test_bm25_in_rounds_and_blocks(spark, monkeypatch):
    rng = random.Random(4)
    text = lambda n: " ".join(f"w{int(rng.expovariate(0.2))}" for _ in range(n))
    docs = spark.createDataFrame([(i, text(rng.randrange(0, 30))) for i in range(300)] + [(300, None)], "doc_id long, text string").repartition(3)
    queries = spark.createDataFrame([(i, text(6)) for i in range(25)] + [(25, ""), (26, None), (27, "zzz"), (None, "w1")], "item_id long, text string")
    want = sorted(map(tuple, ranking.bm25(docs, queries, 5).collect()))
    assert len(want) == 125
    for name, value in (("QUERIES", 4), ("TERMS", 40), ("POSTINGS", 200)):
        monkeypatch.setattr(ranking, name, value)
    assert sorted(map(tuple, ranking.bm25(docs, queries, 5).collect())) == want
    assert ranking.bm25(docs.where("doc_id < 0"), queries, 5).collect() == [] == ranking.bm25(docs, queries.where("item_id = 25"), 5).collect()


def test_queries_of_the_same_terms_are_one_search(spark, monkeypatch):
    searches = []
    searched = ranking._searched
    monkeypatch.setattr(ranking, "_searched", lambda names, *rest: searches.append(len(names)) or searched(names, *rest))
    docs = spark.createDataFrame([(i, f"pump {'steel ' * (i % 3)}pipe {i % 7}") for i in range(60)], "doc_id long, text string")
    forms = ["steel pump 3", "3, Pump (steel)", "steel pump 3 steel", "pipe"]
    queries = spark.createDataFrame([(i, forms[i % 4]) for i in range(400)] + [(400, "none"), (401, ""), (402, None)], "item_id long, text string")
    got = ranking.bm25(docs, queries, 4).collect()
    assert sum(searches) == 4  # three of the forms, and one that no document answers
    of = {}
    for r in got:
        of.setdefault(r["query_id"], []).append((r["rank"], r["doc"], r["score"]))
    assert set(of) == set(range(400)) and all(len(x) == 4 for x in of.values())
    for f in range(4):
        alone = sorted((r["rank"], r["doc"], r["score"]) for r in ranking.bm25(docs, queries.where(f"item_id = {f}"), 4).collect())
        assert all(sorted(of[i]) == alone for i in range(f, 400, 4))


def test_a_task_holds_few_texts_at_once(spark, monkeypatch):
    from unittest.mock import MagicMock

    from citeloom.operators import reuse

    monkeypatch.setattr(reuse, "spread", lambda df, *by: df)
    docs = MagicMock()
    docs.select.return_value.mapInArrow = lambda function, schema: function
    text = pa.array([" ".join(f"w{i}x{j}" for j in range(60)) for i in range(600)], pa.string())
    batch = lambda t: iter([pa.RecordBatch.from_arrays([pa.array(range(600)), t], ["doc", "text"])])
    assert [b.num_rows for b in reuse.shingled(docs)(batch(text))] == [256, 256, 88]
    counted = postings.counted(docs, ["w1x1"], lambda t: t.decode().split())
    assert [b.num_rows for b in counted(batch(text.cast(pa.binary())))] == [256, 256, 88]
