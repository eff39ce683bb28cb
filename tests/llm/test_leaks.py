import random

from pyspark.sql import functions as F

from citeloom.llm import decontaminate as D

WORDS = "lorem ipsum dolor sit amet elit sed tempor magna aliqua enim minim quis nisi aute velit".split()
NAMES = ["Anna", "Berta", "Clara", "Dora"]


def agrees(a, b):
    """Whether two stretches of (token, value, slot) are equal, or alike but for consistent slots, half or more being words."""
    if [t for t, _, _ in a] != [t for t, _, _ in b]:
        return False
    pairs = {(x, y) for (_, x, s), (_, y, _) in zip(a, b) if s}
    if all(x == y for x, y in pairs):
        return True
    one = len({x for x, _ in pairs}) == len(pairs) == len({y for _, y in pairs})
    return one and 2 * sum(s for _, _, s in a) <= len(a)


def consistent(a, b):
    pairs = {(x, y) for (_, x, s), (_, y, _) in zip(a, b) if s}
    return len({x for x, _ in pairs}) == len(pairs) == len({y for _, y in pairs})


def brute(doc, item):
    """The longest agreeing stretch of two texts over all diagonals, by trying every part of every diagonal."""
    d, i = ([(int(x.token[k]), int(x.value[k]), bool(x.slot[k])) for k in range(len(x.token))] for x in (D.canonical(doc), D.canonical(item)))
    best = 0
    least = min(D.STRETCH, len(i))
    for shift in range(-len(i) + 1, len(d)):
        at = [k for k in range(len(i)) if 0 <= k + shift < len(d) and i[k][0] == d[k + shift][0]]
        runs, start = [], None
        for k in at:
            if start is None or k != last + 1:  # noqa: F821
                start = k
                runs.append([k, k])
            runs[-1][1] = last = k  # noqa: F841
        for a, b in runs:
            whole = consistent(i[a : b + 1], d[a + shift : b + 1 + shift])
            need = least if whole else max(least, D.PART)
            for x in range(a, b + 1):
                for y in range(b, x + need - 2, -1):
                    if y - x + 1 > best and agrees(i[x : y + 1], d[x + shift : y + 1 + shift]):
                        best = y - x + 1
                        break
    return best


def text(rng, n):
    out = []
    for _ in range(n):
        r = rng.random()
        out.append(rng.choice(NAMES) if r < 0.12 else str(rng.randrange(4)) if r < 0.24 else rng.choice(WORDS))
    return "So " + " ".join(out)


def changed(rng, t):
    """Other numbers and names, mostly consistent, in a part of the text."""
    other = dict(zip(NAMES, rng.sample(NAMES, 4))) | {str(i): str(i + 5) for i in range(4)}
    w = t.split()
    a, b = sorted(rng.sample(range(len(w)), 2))
    w = w[a : b + 1]
    return " ".join(other.get(x, x) if rng.random() < 0.97 else rng.choice(WORDS) for x in w)


def test_join_equals_brute_force(spark):
    rng = random.Random(2)
    items = [(i, text(rng, rng.choice([3, 7, 9, 20, 60]))) for i in range(14)]
    docs = [(i, text(rng, 30) + ". " + (items[i % 14][1] if i % 3 == 0 else changed(rng, items[i % 14][1])) + " " + text(rng, 30)) for i in range(60)]
    bench = spark.createDataFrame(items, "item_id long, text string")
    found = D.contaminated(spark.createDataFrame(docs, "doc_id long, text string").repartition(5), bench)
    got = {(r["doc_id"], r["item_id"]): r["n_tokens"] for r in found.collect()}
    want = {(d, i): n for d, t in docs for i, x in items if (n := brute(t.encode(), x.encode()))}
    assert got == want and len(want) > 25


def test_join_equals_the_search_of_single_texts(spark, sf):
    docs, bench = spark.read.parquet(f"{sf}/documents.parquet"), spark.read.parquet(f"{sf}/benchmark.parquet")
    index = next(D.indexes(bench))
    want = {(r["doc_id"], i): n for r in docs.collect() for i, (n, _) in D._find(index, (r["text"] or "").encode()).items()}
    assert want and {(r["doc_id"], r["item_id"]): r["n_tokens"] for r in D.contaminated(docs, bench).collect()} == want


def test_a_full_filter_changes_nothing(spark, monkeypatch):
    monkeypatch.setattr(D, "FILTER", 6)
    rng = random.Random(3)
    items = [(i, text(rng, 40)) for i in range(30)]
    docs = [(i, text(rng, 20) + " " + t + " " + text(rng, 20)) for i, t in items] + [(100 + i, text(rng, 80)) for i in range(20)]
    found = D.contaminated(spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string"))
    assert {(r["doc_id"], r["item_id"]) for r in found.collect()} == {(i, i) for i in range(30)}


def test_odd_columns_copies_and_ids(spark):
    rng = random.Random(4)
    item = text(rng, 40)
    rows = [(None, item, 1), (None, "other words", 2), (1, item, 3), (1, item, 4), (1, None, 5), (2, "", 6)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, n int").withColumns({"digest": F.lit(1), "_leak": F.lit("x"), "item.id": F.lit(2)})
    bench = spark.createDataFrame([(None, item), (7, item), (7, item + " more")], "item_id long, text string")
    assert sorted((r["doc_id"] or 0, r["item_id"] or 0) for r in D.contaminated(docs, bench).collect()) == [(0, 0), (0, 7), (1, 0), (1, 7)]
    assert sorted(r["n"] for r in D.decontaminate(docs, bench).collect()) == [2, 5, 6]


def test_steps_are_dropped(spark, sf):
    """Only what a result reads stays in the shared folder, and that goes too when it is asked for."""
    from citeloom import session
    from citeloom.llm import ann, simhash

    docs = spark.read.parquet(f"{sf}/documents.parquet").limit(50)
    vectors = spark.createDataFrame([(i, [float(i), 1.0]) for i in range(9)], "vec_id long, embedding array<double>")
    out = [simhash.near_duplicates(docs), simhash.keep_one(docs), D.contaminated(docs, spark.read.parquet(f"{sf}/benchmark.parquet")), ann.nearest(vectors, vectors)]
    assert not [r for r in session._roots if "-steps-" in r] and all(df.count() >= 0 for df in out)
