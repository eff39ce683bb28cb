import hashlib
import itertools
import random
from collections import Counter

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from citeloom.llm import ann, decontaminate, html, labelled, langid, mixing, quality, repeats, sharding, simhash, toxicity
from citeloom.llm import queries as Q

DOC = "doc_id long, text string, lang string, source string, n_chars long"


def doc(i, text, lang="en", source="s"):
    return (i, text, lang, source, len(text or ""))


@pytest.fixture(scope="module")
def odd(spark):
    """Nulls, empty, blank and long texts, repeated rows, shared ids, and columns that clash with results'."""
    long = " ".join(f"w{i % 977}" for i in range(60_000))
    rows = [doc(1, None), doc(2, ""), doc(3, " \t\n"), doc(4, "a b c d e f"), doc(4, "a b c d e f"), doc(5, long), doc(None, "a b c d e f"), doc(6, "x", None, None), doc(7, "a b c d e f", None, "t")]
    return spark.createDataFrame(rows, DOC).withColumns({"score": F.lit("keep?"), "_n": F.lit(1), "size": F.lit(2), "shard": F.lit("z"), "component_id": F.lit(0), "rank": F.lit(3)})


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], DOC)


WORDS = ["lorem", "ipsum", "dolor", "sit", "amet", "elit", "sed", "tempor", "magna", "aliqua", "enim", "minim", "quis", "nisi", "aute", "velit"]


def prose(rng, n):
    return " ".join(rng.choice(WORDS) for _ in range(n))


# ---------------------------------------------------------------- 1, 4, 9: classifiers


def test_toxicity_learns_words_and_misspellings():
    rng = random.Random(1)
    rows = []
    for i in range(300):
        w = prose(rng, 120).split()
        if i % 3 == 0:
            for k in range(3):
                w[rng.randrange(120)] = rng.choice(["grumbolt", "grumbolts", "grumbolter", "zarkwit", "zarkwits"])
        rows.append((" ".join(w), int(i % 3 == 0)))
    m = toxicity.fit(rows)
    assert np.mean([(m.score(t) >= 0.5) == bool(y) for t, y in rows]) > 0.97
    clean = prose(rng, 4000)
    assert m.score(clean) < 0.5 <= m.score(clean + " grumboltz you zarkwitz " + clean)
    assert m.score("") < 0.5 and m.score(None) == m.score("")


def test_toxicity_word_margins_equal_plain_rule():
    margin = np.random.default_rng(0).normal(size=toxicity.BUCKETS)
    raw = toxicity.fold("Ab abc! é wörd x1")

    def bucket(g):
        h = np.uint32(g[0])
        for b in g[1:]:
            h = np.uint32((int(h) * 0x01000193 + b) % 2**32)
        return ((int(h) + len(g)) * 0x9E3779B1 % 2**32) >> 16

    want = []
    for w in raw.tobytes().split():
        s = b" " + w + b" "
        want.append(np.mean([margin[bucket(s[i : i + n])] for n in range(3, 6) for i in range(len(s) - n + 1)] or [0.0]))
    assert np.allclose(toxicity.word_margins(raw, margin), want)


def test_toxicity_scores_equal_plain_rule():
    """A text's score from each word's n-grams by themselves: repeats dropped, the best mean of six words in a row."""
    rng = random.Random(7)
    m = toxicity.Model(np.random.default_rng(1).normal(size=toxicity.BUCKETS), 0.7, -0.2)
    for n in (0, 1, 5, 6, 7, 200):
        words = [rng.choice(["ab", "abc", "Zürich", "x1", "lorem", "ipsum", "lorem"]) for _ in range(n)]
        calm = [w for i, w in enumerate(words) if not i or w != words[i - 1]]
        value = [float(toxicity.word_margins(toxicity.fold(w), m.margin)[0]) for w in calm]
        bags = [value] if len(value) <= 6 else [value[i : i + 6] for i in range(len(value) - 5)]
        best = max((sum(b) / len(b) for b in bags if b), default=0.0)
        assert m.score(" ".join(words)) == pytest.approx(1 / (1 + np.exp(-(0.7 * best - 0.2))))


def test_toxicity_pieces_do_not_change_a_score(monkeypatch):
    m = toxicity.Model(np.random.default_rng(0).normal(size=toxicity.BUCKETS), 1.0, 0.0)
    text = prose(random.Random(2), 3000)
    whole = m.score(text)
    monkeypatch.setattr(toxicity, "PIECE", 500)
    assert m.score(text) == pytest.approx(whole)


def test_quality_ranks_and_thresholds():
    rng = random.Random(3)
    good = [(prose(rng, 80) + ".", 1) for _ in range(200)]
    poor = [(" ".join(w + "###" for w in prose(rng, 80).split()), 0) for _ in range(20)] + [(" ".join(w for w in WORDS[:8] for _ in range(9)), 0) for _ in range(20)]
    m = quality.fit(good + poor)
    s = m.score(np.array([quality.features(t) for t, _ in good + poor]))
    assert ((s >= 0.7) == np.array([y for _, y in good + poor], bool)).all()
    assert 0 <= m.score(quality.features("")[None, :])[0] <= 1


def test_language_by_nearest_centroid(spark):
    rng = random.Random(4)
    make = lambda syl: " ".join("".join(rng.choice(syl) for _ in range(3)) for _ in range(60))
    rows = [(make(["tha", "ing", "wh"]), "en") for _ in range(40)] + [(make(["sch", "ung", "ß"]), "de") for _ in range(40)]
    m = langid.fit(rows)
    df = spark.createDataFrame([(1, make(["tha", "ing", "wh"])), (2, make(["SCH", "UNG", "ß"])), (3, None), (4, "12 !"), (5, "日本語 の テキスト")], "doc_id long, text string")
    got = {r["doc_id"]: r for r in langid.identify(df, m).collect()}
    assert [got[i]["lang_pred"] for i in (1, 2, 3, 4)] == ["en", "de", "und", "und"]
    assert got[5]["rejected"] and not got[1]["rejected"] and all(0 <= r["score"] <= 1 for r in got.values())


def test_classifiers_on_odd_rows(spark, odd, empty):
    labels = spark.createDataFrame([(4, 1, 1), (4, 0, 0), (5, 0, 0), (None, 1, 1), (7, None, 3)], "doc_id long, quality int, toxic int")
    t, q = toxicity.train(odd, labels), quality.train(odd, labels)
    lang = langid.train(odd)
    for out in (toxicity.score(odd, t), quality.score(odd, q), langid.identify(odd, lang)):
        rows = out.collect()
        assert len(rows) == 9 and all(isinstance(r["score"], float) and 0 <= r["score"] <= 1 for r in rows)
        assert len({r["score"] for r in rows if r["doc_id"] in (1, 2, 3)}) == 1
    none = labels.limit(0)
    assert toxicity.score(empty, toxicity.train(empty, none)).count() == 0
    assert quality.score(empty, quality.train(empty, none)).count() == 0
    assert langid.identify(empty, langid.train(empty)).count() == 0
    assert {r["lang_pred"] for r in langid.identify(odd, langid.train(empty)).collect()} == {"und"}


def test_sample_is_bounded_and_balanced(spark):
    docs = spark.createDataFrame([(i, f"text {i}") for i in range(100)], "doc_id long, text string")
    labels = spark.createDataFrame([(i, int(i < 20)) for i in range(100)], "doc_id long, y0 int").withColumnRenamed("y0", "toxic")
    got = labelled.sample(docs, labels, "toxic", 30, balanced=True)
    assert Counter(y for _, y in got) == {0: 15, 1: 15}
    assert got == labelled.sample(docs.repartition(7), labels.repartition(5), "toxic", 30, balanced=True)
    assert len(labelled.sample(docs, labels, "toxic", 30, balanced=False)) == 30


def test_sample_takes_long_texts_up_to_its_characters(spark):
    docs = spark.createDataFrame([(i, "long " * 20_000 if i % 2 else f"text {i}") for i in range(40)], "doc_id long, text string")
    labels = spark.createDataFrame([(i, i % 2) for i in range(40)], "doc_id long, toxic int")
    got = labelled.sample(docs, labels, "toxic", 30, balanced=True)
    assert Counter(y for _, y in got) == {0: 15, 1: 15} and all(len(t) == 100_000 for t, y in got if y)
    few = labelled.sample(docs, labels, "toxic", 30, balanced=True, characters=500_000)
    assert Counter(y for _, y in few) == {0: 15, 1: 3}


def test_every_language_is_learned(spark, monkeypatch):
    """More languages than the sample has rows for, one with long texts only, one whose row is repeated often."""
    monkeypatch.setattr(langid, "ROWS", 100)
    monkeypatch.setattr(langid, "LEAST", 3)
    names = [a + b for a in "abcdefghijklmnopqrst" for b in "abcdefghijklmno"]
    word = lambda n, k: (n + "xyzuvw"[k % 6]) * 3
    rows = [(100 * i + k, " ".join(word(n, k + j) for j in range(6)), n) for i, n in enumerate(names) for k in range(4)]
    rows += [(50_000 + k, "longword " * 30_000, "long") for k in range(2)] + [(60_000, "repeated words here", "often")] * 4000
    m = langid.train(spark.createDataFrame(rows, "doc_id long, text string, lang string"))
    assert m.names == sorted([*names, "long", "often"])
    df = spark.createDataFrame([(1, "longword longword"), (2, "ajx ajx"), (3, "½ ² Ⅷ 12"), (4, "repeated words")], "doc_id long, text string")
    got = {r["doc_id"]: r["lang_pred"] for r in langid.identify(df, m).collect()}
    assert got[1] == "long" and got[3] == "und" and got[4] == "often"


def test_language_centroids_equal_plain_rule():
    """Scores by the definition: TF-IDF vectors of every n-gram, the nearest centroid's cosine."""
    rng = random.Random(20)
    rows = [(" ".join("".join(rng.choice(v) for _ in range(4)) for _ in range(20)), v) for v in ("abc", "cde") for _ in range(15)]
    m = langid.fit(rows, centroids=1)

    def plain(text):
        folded, out = " " + "".join(c if c.isalpha() else " " for c in text.lower()) + " ", np.zeros(langid.DIM)
        folded = " ".join(folded.split(" ")) if "  " not in folded else " " + " ".join(folded.split()) + " "
        for n in range(1, 5):
            for i in range(len(folded) - n + 1):
                h = 0
                for k, c in enumerate(folded[i : i + n].encode()):
                    h = c if not k else (h * 0x01000193 + c) % 2**32
                out[((h + n) * 0x9E3779B1 % 2**32) >> 19] += 1
        return out

    tf = {t: np.log1p(plain(t)) for t, _ in rows}
    idf = np.log(31 / (1 + sum((v > 0).astype(int) for v in tf.values()))) + 1
    unit = lambda v: v / np.linalg.norm(v)
    for name in ("abc", "cde"):
        centre = unit(sum(unit(tf[t] * idf) for t, v in rows if v == name))
        for t, _ in rows[:4]:
            who, cosine = m.predict(langid.counts(t)[None, :])
            want = float(unit(tf[t] * idf) @ centre)
            assert want <= cosine[0] + 1e-5 and (m.names[who[0]] != name or abs(want - cosine[0]) < 1e-5)


def test_quality_equals_plain_ranking():
    """Pairwise logistic loss by plain gradient descent gives the same weights' direction and the same decisions."""
    rng = np.random.default_rng(21)
    rows = [("word " * rng.integers(3, 60) + "#" * rng.integers(0, 9), int(v)) for v in rng.integers(0, 2, 200)]
    rows = [(t if y else t.upper() + " 11 11 11", y) for t, y in rows]
    m = quality.fit(rows, pairs=4000, seed=5)
    z = np.clip((np.array([quality.features(t) for t, _ in rows]) - m.mean) / m.scale, -8, 8)
    y = np.array([v for _, v in rows])
    d = (z[y == 1][:, None, :] - z[y == 0][None, :, :]).reshape(-1, z.shape[1])
    w = np.zeros(z.shape[1])
    for _ in range(3000):
        w += 0.2 * ((d / (1 + np.exp(np.clip(d @ w, -30, 30)))[:, None]).mean(axis=0) - 1e-3 * w)
    assert np.corrcoef(z @ w, z @ m.weights)[0, 1] > 0.99
    assert (((z @ m.weights) >= m.cut) == (y == 1)).all()


# ---------------------------------------------------------------- 2: near-duplicates


def brute_components(fps, distance=2):
    ids = sorted(fps)
    low = {i: i for i in ids}
    while True:
        new = {i: min(low[j] for j in ids if (fps[i] ^ fps[j]).bit_count() <= distance) for i in ids}
        if new == low:
            return low
        low = new


def test_fingerprint_by_the_contract():
    import xxhash

    for text in (b"", b"One  two", b"A b\tc\nd E f g", "É ß x y z q".encode()):
        words = [w for w in text.lower().replace(b"\x0b", b" ").split() if w]
        grams = [b" ".join(words[i : i + 3]) for i in range(max(len(words) - 2, 1))] if words else []
        hs = [xxhash.xxh64_intdigest(g, 42) for g in grams]
        want = sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hs) > len(hs)) if hs else 0
        assert simhash.fingerprint(text, 3) == want


@pytest.mark.parametrize("bucket", [2048, 3])
def test_links_equal_brute_force(spark, bucket):
    """Chains of fingerprints, also with buckets so small that hot ones must be split to the last level."""
    rng = random.Random(5)
    fps = {}
    for c in range(6):
        f = rng.getrandbits(64)
        for _ in range(25):
            fps[len(fps)] = f
            for _ in range(rng.choice([1, 2, 2, 3])):
                f ^= 1 << rng.randrange(64)
    df = spark.createDataFrame([(simhash._signed(f),) for f in fps.values()], "fp long")
    edges = simhash.fingerprint_links(df, 2, bucket=bucket).collect()
    assert edges
    assert all(((r["a"] ^ r["b"]) & (2**64 - 1)).bit_count() >= 1 for r in edges)
    low = brute_components(fps)
    parent = {simhash._signed(f): simhash._signed(f) for f in fps.values()}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for r in edges:
        parent[max(find(r["a"]), find(r["b"]))] = min(find(r["a"]), find(r["b"]))
    groups = lambda of: {frozenset(i for i in fps if of(i) == g) for g in {of(i) for i in fps}}
    assert groups(lambda i: find(simhash._signed(fps[i]))) == groups(lambda i: low[i])


def test_near_duplicates_on_odd_rows(odd, empty):
    got = simhash.near_duplicates(odd).collect()
    assert len(got) == 9
    by = {}
    for r in got:
        by.setdefault(r["doc_id"], r)
    assert by[1]["fingerprint"] == "0" * 16 and {by[i]["component_id"] for i in (1, 2, 3)} == {1}
    assert by[None]["component_id"] == 4 and by[7]["component_id"] == 4
    assert simhash.near_duplicates(empty).count() == 0


def test_keep_one_of_similar_texts(spark, odd, empty):
    rng = random.Random(6)
    vocabulary = ["".join(rng.choice("abcdefgh") for _ in range(5)) for _ in range(500)]
    rows, groups = [], 20
    for g in range(groups):
        w = [rng.choice(vocabulary) for _ in range(300)]
        for k in range(4):
            v = list(w)
            for _ in range(k):
                v[rng.randrange(300)] = "changed"
            rows.append(doc(100 * g + k, " ".join(v)))
    kept = simhash.keep_one(spark.createDataFrame(rows, DOC))
    assert kept.columns == [c.split()[0] for c in DOC.split(", ")]
    assert {r["doc_id"] for r in kept.collect()} == {100 * g for g in range(groups)}
    left = simhash.keep_one(odd)
    assert sorted(r["doc_id"] for r in left.collect()) == [1, 4, 5, 6] and left.columns == odd.columns
    assert simhash.keep_one(empty).count() == 0


def test_hot_group_is_linked_through_its_parts(spark, monkeypatch):
    monkeypatch.setattr(simhash, "PAIRED", 5)
    rng = random.Random(8)
    w = [f"t{rng.randrange(9999)}" for _ in range(400)]
    rows = []
    for i in range(60):
        v = list(w)
        v[rng.randrange(400)] = f"c{i}"
        rows.append(doc(i, " ".join(v)))
    assert [r["doc_id"] for r in simhash.keep_one(spark.createDataFrame(rows, DOC)).collect()] == [0]


def similar(rows):
    """Pairs of a Jaccard similarity of 0.8 or more over five-word shingles, by brute force."""
    sets = {r[0]: {tuple(w[k : k + 5]) for w in [r[1].split()] for k in range(len(w) - 4)} for r in rows}
    return {(a, b) for a, b in itertools.combinations(sorted(sets), 2) if 5 * len(sets[a] & sets[b]) >= 4 * len(sets[a] | sets[b])}


def test_links_are_verified_on_shingles(spark):
    """Texts on one template, of similarity 0.67, stay; a few of 0.8 or more, also of few words, are linked."""
    rng = random.Random(12)
    base = [f"t{rng.randrange(9999)}" for _ in range(320)]
    rows = [doc(i, " ".join(base + [f"u{rng.randrange(10**6)}" for _ in range(80)])) for i in range(150)]
    rows += [doc(500 + i, " ".join(rows[i][1].split()[:-10])) for i in range(5)]
    rows += [doc(600, "one two three four five six seven eight"), doc(601, "one two three four five six seven eight nine")]
    gone = {b for _, b in similar(rows)}
    assert gone == {500, 501, 502, 503, 504, 601}
    kept = {r["doc_id"] for r in simhash.keep_one(spark.createDataFrame(rows, DOC)).collect()}
    assert kept == {r[0] for r in rows} - gone


def test_hot_buckets_lose_no_pair(spark, monkeypatch):
    """All texts share a template, so buckets are hot, but only pairs of 0.8 or more go; parts can't be linked through one node."""
    monkeypatch.setattr(simhash, "PAIRED", 8)
    rng = random.Random(13)
    base, rows = [f"t{k}" for k in range(440)], []
    for i in range(80):
        both = [f"p{i}x{k}" for k in range(12)]
        rows += [doc(2 * i + side, " ".join(base + both + [f"u{rng.randrange(10**8)}" for _ in range(48)])) for side in (0, 1)]
    assert similar(rows) == {(2 * i, 2 * i + 1) for i in range(80)}
    assert sorted(r["doc_id"] for r in simhash.keep_one(spark.createDataFrame(rows, DOC)).collect()) == list(range(0, 160, 2))


# ---------------------------------------------------------------- 3: mixing


def test_mixing_equals_sql_and_meets_targets(spark, tmp_path):
    rng = random.Random(9)
    rows = [doc(i, prose(rng, rng.randrange(0, 60)) if i % 17 else None, source=rng.choice(["a", "a", "a", "b", "c", None])) for i in range(900)]
    df = spark.createDataFrame(rows, DOC)
    df.coalesce(1).write.parquet(str(tmp_path / "d"))
    c = duckdb.connect()
    c.sql(f"CREATE VIEW documents AS SELECT * FROM '{tmp_path}/d/*.parquet'")
    want = sorted(c.sql(mixing.SQL).fetchall())
    mixed = mixing.mix(df.repartition(5))
    got = sorted(tuple(r) for r in mixed.select("doc_id", "size", "source_size", "target", F.col("size") * F.col("copies")).collect())
    assert got == want
    taken = {r["source"]: (r["t"], r["target"]) for r in mixed.groupBy("source", "target").agg(F.sum(F.col("size") * F.col("copies")).alias("t")).collect()}
    assert all(abs(t - goal) <= 120 for t, goal in taken.values()) and all(r["copies"] <= 2 for r in mixed.collect())


def test_mixing_odd_rows(odd, empty):
    m = mixing.mix(odd)
    assert m.count() == 9 and set(odd.columns) - {"size"} <= set(m.columns)
    assert mixing.mix(empty).count() == 0


def test_mixing_shared_ids_equal_sql(spark, tmp_path):
    """A third of the rows share an id, a third have none, and many are equal: they are dealt to cells and still get the SQL's copies."""
    rng = random.Random(10)
    rows = [doc(rng.choice([7, None, i]), prose(rng, rng.choice([3, 3, 3, 4])), source=rng.choice(["a", "b", "b", None])) for i in range(600)]
    spark.createDataFrame(rows, DOC).repartition(6).write.parquet(str(tmp_path / "d"))
    c = duckdb.connect()
    c.sql(f"CREATE VIEW documents AS SELECT * FROM '{tmp_path}/d/*.parquet'")
    mixed = mixing.mix(spark.read.parquet(str(tmp_path / "d")))
    got = Counter(tuple(r) for r in mixed.select("doc_id", "size", "source_size", "target", F.col("size") * F.col("copies")).collect())
    assert got == Counter(c.sql(mixing.SQL).fetchall())
    again = mixing.mix(spark.createDataFrame(rows[::-1], DOC).repartition(3))
    same = lambda df: Counter((r["doc_id"], r["text"], r["source"], r["copies"]) for r in df.collect())
    assert same(again) == same(mixed)


def test_targets_of_many_sources_equal_plain_filling(spark):
    rng = random.Random(11)
    sizes = {f"s{i:04d}": rng.choice([0, 1, 5, 50, 5000]) + rng.randrange(3) for i in range(700)} | {None: 40}
    rows = [(k or "", k is None, v) for k, v in sizes.items()]
    df = spark.createDataFrame(rows, "_mix_sk string, _mix_sn boolean, source_size long")
    got = {None if r["_mix_sn"] else r["_mix_sk"]: r["target"] for r in mixing.targets(df, (3, 1, 2), 1.5, 2.0).collect()}
    names = sorted(k for k in sizes if k is not None) + [None]
    weight = {k: (3, 1, 2)[i % 3] for i, k in enumerate(names)}
    target, left = {}, 1.5 * sum(sizes.values())
    while True:
        level = left / sum(weight[k] for k in names if k not in target)
        full = [k for k in names if k not in target and 2.0 * sizes[k] <= level * weight[k]]
        if not full:
            break
        for k in full:
            target[k] = 2.0 * sizes[k]
            left -= target[k]
    assert got == {k: target.get(k, level * weight[k]) for k in names} and 0 < len(target) < 700
    assert sum(got.values()) == pytest.approx(1.5 * sum(sizes.values()))


def test_mixing_ids_and_names_of_any_kind(spark):
    df = spark.createDataFrame([(f"k{i % 3}" if i % 5 else None, "a b " * (i % 4), "s", i) for i in range(60)], "doc_id string, text string, source string, `_mix_sk.x` int")
    got = mixing.mix(df).collect()
    assert len(got) == 60 and {r["_mix_sk.x"] for r in got} == set(range(60)) and all(0 <= r["copies"] <= 2 for r in got)


def test_word_count_equals_pattern(spark):
    import re

    texts = ["", " ", "a", " a ", "a b\t\nc", "\x0b x\x0c\r y", "é\u00a0z \u2003 q", "\x1f a", None, "x " * 5000, "\U0001f600 $1 \\ x"]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string")
    got = dict(map(tuple, df.select("i", mixing.word_count(F.col("t"))).collect()))
    assert got == {i: len(re.findall(r"[^\x20\x09-\x0D]+", t or "")) for i, t in enumerate(texts)}


# ---------------------------------------------------------------- 5: repeats


def brute_repeats(texts, length):
    count = Counter(t[i : i + length] for t in texts for i in range(len(t) - length + 1))
    out = []
    for t in texts:
        gone = np.zeros(len(t), bool)
        for i in range(len(t) - length + 1):
            if count[t[i : i + length]] > 1:
                gone[i : i + length] = True
        kept = bytes(b for b, g in zip(t, gone) if not g)
        out.append((len(t), int(gone.sum()), sum(1 for i in range(len(t)) if gone[i] and not (i and gone[i - 1])), hashlib.sha256(kept).hexdigest()))
    return out


@pytest.mark.parametrize("hot", [2048, 1])
def test_repeats_equal_brute_force(spark, monkeypatch, hot):
    monkeypatch.setattr(repeats, "HOT", hot)
    rng = random.Random(10)
    make = lambda n: "".join(rng.choice("abcdé ") for _ in range(n))
    shared, other = make(260), make(420)
    texts = [make(300) + shared + make(100), shared + make(150), make(90) + shared[10:230] + make(90), other, other, other[:200] + "!" + other[201:], make(50) + other[100:350], "ab" * 300, "é" * 150, "", None, make(199), shared[:199], other[5:204] + shared[:199]]
    texts += [make(20) + shared[:205] + make(20) for _ in range(12)]
    df = spark.createDataFrame([doc(i, t) for i, t in enumerate(texts)], DOC)
    got = {r["doc_id"]: (r["n_bytes"], r["n_removed"], r["n_spans"], repeats.sha256(bytes(r["kept"]))) for r in repeats.remove_repeats(df).collect()}
    assert [got[i] for i in range(len(texts))] == brute_repeats([(t or "").encode() for t in texts], 200)


def test_repeats_in_pieces(monkeypatch):
    rng = random.Random(11)
    t = "".join(rng.choice("ab ") for _ in range(3000)).encode()
    whole = repeats.anchors(np.frombuffer(t, np.uint8), 200)
    assert sum(whole[3] - whole[2] + 1) == 2801
    monkeypatch.setattr(repeats, "PIECE", 700)
    windows = []
    for a, b in repeats._pieces(len(t), 200):
        h, _, first, last = repeats.anchors(np.frombuffer(t, np.uint8)[a:b], 200)
        windows += [(a + i, x) for x, f, z in zip(h, first, last) for i in range(f, z + 1)]
    assert windows == [(i, x) for x, f, z in zip(whole[0], whole[2], whole[3]) for i in range(f, z + 1)]


def test_run_length_index_equals_sorted_suffixes():
    rng = random.Random(12)
    for _ in range(10):
        base = bytes(rng.choice(b"abc") for _ in range(120))
        t = b"\xff".join([base, base[:60] + b"x" + base[61:], base[30:], b"ab" * 40]) + b"\xff"
        order = sorted(range(len(t)), key=lambda i: t[i:])
        want = [0] * len(t)
        for x, y in itertools.pairwise(order):
            n = next((k for k in range(len(t)) if t[x + k : x + k + 1] != t[y + k : y + k + 1] or max(x, y) + k >= len(t)), len(t))
            want[x], want[y] = max(want[x], n), max(want[y], n)
        assert repeats.RunLengthIndex(t).longest_elsewhere().tolist() == want


def test_repeats_odd_rows(odd, empty):
    rows = repeats.remove_repeats(odd).collect()
    assert len(rows) == 9 and all(r["n_bytes"] == r["n_removed"] + len(r["kept"]) for r in rows)
    assert repeats.remove_repeats(empty).count() == 0


# ---------------------------------------------------------------- 6: nearest neighbours


def test_ann_recall_ties_and_exclusions(spark):
    rng = np.random.default_rng(13)
    centers = rng.normal(size=(30, 16))
    x = centers[rng.integers(0, 30, 3000)] + 0.4 * rng.normal(size=(3000, 16))
    rows = [(i, [float(v) for v in x[i]]) for i in range(3000)] + [(5000 + i, [1.0] + [0.0] * 15) for i in range(400)]
    rows += [(9000, None), (9050, [0.0] * 16), (9100, [float("nan")] * 16), (9150, [1.0, 2.0]), (9200, [None] + [1.0] * 15), (None, [1.0] * 16), (50, rows[50][1])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>")
    got = {}
    for r in ann.nearest(df, df.where("vec_id % 50 = 0")).collect():
        got.setdefault(r["query_id"], []).append((r["rank"], r["vec_id"], r["score"]))
    good = [(i, np.array(v, np.float32).astype(float)) for i, v in rows[:3400]]
    ids, m = np.array([i for i, _ in good]), np.stack([v for _, v in good])
    norm = np.linalg.norm(m, axis=1)
    hits = total = 0
    for q in np.flatnonzero(ids % 50 == 0):
        s = m @ m[q] / (norm * norm[q])
        best = [j for j in np.lexsort((ids, -np.round(s, 12))) if j != q][:5]
        mine = sorted(got.pop(int(ids[q])))
        assert [k for k, _, _ in mine] == [1, 2, 3, 4, 5] and all(s[list(ids).index(v)] == pytest.approx(c) for _, v, c in mine)
        hits, total = hits + len({int(ids[j]) for j in best} & {v for _, v, _ in mine}), total + 5
        if ids[q] >= 5000:
            assert [v for _, v, _ in mine] == [v for v in range(5000, 5007) if v != ids[q]][:5]
    assert not got and hits / total >= 0.9


def test_ann_small_and_empty(spark):
    df = spark.createDataFrame([(0, [1.0, 0.0]), (1, [1.0, 1.0])], "vec_id long, embedding array<float>")
    assert [(r["query_id"], r["rank"], r["vec_id"]) for r in ann.nearest(df, df.where("vec_id = 0")).collect()] == [(0, 1, 1)]
    assert ann.nearest(df.limit(0), df.limit(0)).count() == 0 and ann.nearest(df.limit(1), df.limit(1)).count() == 0


def test_ann_blocks_of_a_list(spark, monkeypatch):
    monkeypatch.setattr(ann, "BLOCK", 7)
    rng = np.random.default_rng(14)
    rows = [(i, [float(v) for v in rng.normal(size=8)]) for i in range(60)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    got = {(r["query_id"], r["rank"]): r["vec_id"] for r in ann.nearest(df, df.where("vec_id < 5")).collect()}
    m = np.array([v for _, v in rows])
    m /= np.linalg.norm(m, axis=1, keepdims=True)
    assert got == {(q, k + 1): int(j) for q in range(5) for k, j in enumerate([j for j in np.argsort(-(m @ m[q])) if j != q][:5])}


def test_probed_lists_keep_recall_as_lists_grow():
    """Vectors without clusters, 2,048 lists: brute force against what the probed lists hold."""
    rng = np.random.default_rng(3)
    x = rng.standard_normal((20_480, 64))
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    index = ann.Centroids.fit(x, 2048)
    row, to = index.lists(x, 24, 1, ann.COPIES, ann.CLOSE)
    q, (least, most) = x[:60], ann.probes(2048)
    asked, read = index.lists(q, most + 32, least, most, ann.REACH)
    hit = 0
    for i in range(60):
        want = set(np.argsort(-(x @ q[i]))[1:6].tolist())
        hit += len(want & set(row[np.isin(to, read[asked == i])].tolist()))
    assert hit >= 0.95 * 300


# ---------------------------------------------------------------- 7: decontamination

ITEM = "A train leaves Paris at 90 km per hour and meets John after 3 hours; how far did John travel before the train stopped in Paris again today"

SHOUT = "Été comme hiver, la même rivière passe sous le vieux pont de pierre et file vers la mer"


def test_decontamination(spark, odd, empty):
    rng = random.Random(15)
    bench = spark.createDataFrame([(1, ITEM), (2, "short one here"), (3, None), (4, ""), (8, SHOUT)], "item_id long, text string")
    other = ITEM.replace("Paris", "Rome").replace("John", "Mary").replace("90", "120").replace("3 hours", "7 hours")
    mixed = ITEM.replace("meets John", "meets Mary")  # John and Mary in the slots of one name
    fill = lambda: prose(rng, 40)
    rows = [doc(1, fill() + ". " + ITEM + ". " + fill()), doc(2, fill() + " " + other), doc(3, mixed[len("A train leaves Paris at 90 km ") :]), doc(4, fill()), doc(5, "so " + "short one here" + " ok"), doc(6, ITEM[:30]), doc(7, (fill() + ". " + SHOUT).upper())]
    docs = spark.createDataFrame(rows, DOC)
    got = {(r["doc_id"], r["item_id"]): (r["n_tokens"], r["n_changed"]) for r in decontaminate.contaminated(docs, bench).collect()}
    assert set(got) == {(1, 1), (2, 1), (5, 2), (7, 8)} and got[1, 1][1] == 0 and got[2, 1][1] >= 5
    assert {r["doc_id"] for r in decontaminate.decontaminate(docs, bench).collect()} == {3, 4, 6}
    assert decontaminate.decontaminate(odd, bench).count() == 9 and decontaminate.contaminated(odd, bench.limit(0)).count() == 0
    assert decontaminate.contaminated(empty, bench).count() == 0 and decontaminate.decontaminate(odd, bench.limit(0)).columns == odd.columns


def test_decontamination_keeps_parts_around_a_contradiction(spark):
    rng = random.Random(14)
    left, right = prose(rng, 40), prose(rng, 60)
    rows = [(1, f"{left} 3 {right} 3 magna."), (2, "Then Anna 4 Berta 5 Clara 6 Dora 7 Emma 8 Frida 9 Greta 11 Hanna 12 went.")]
    bench = spark.createDataFrame(rows, "item_id long, text string")
    texts = [f"{left} 4 {right} 5 magna.", rows[1][1], "Then Anna 4 Berta 5 Clara 6 Dora 1 Emma 2 Frida 0 Greta 1 Hanna 2 went."]
    docs = spark.createDataFrame([doc(i, x) for i, x in enumerate(texts)], DOC)
    got = {(r["doc_id"], r["item_id"]): (r["n_tokens"], r["n_changed"]) for r in decontaminate.contaminated(docs, bench).collect()}
    assert set(got) == {(0, 1), (1, 2)}
    assert got[0, 1] == (101, 1) and got[1, 2][1] == 0


def test_longest_part_equals_brute_force(monkeypatch):
    monkeypatch.setattr(decontaminate, "PART", 2)
    rng = random.Random(15)
    for _ in range(400):
        n, least = rng.randrange(3, 24), rng.randrange(2, 8)
        slot = np.array([rng.random() < 0.5 for _ in range(n)])
        a = np.array([rng.randrange(4) if s else 9 for s in slot], np.uint64)
        b = np.array([(x if rng.random() < 0.6 else rng.randrange(4)) if s else 9 for s, x in zip(slot, a)], np.uint64)
        item, other = (decontaminate.Tokens(v, v, slot, np.arange(n), np.arange(n)) for v in (a, b))

        def agrees(i, j):
            pairs = set(zip(a[i:j][slot[i:j]].tolist(), b[i:j][slot[i:j]].tolist()))
            one = len({x for x, _ in pairs}) == len(pairs) == len({y for _, y in pairs})
            return (a[i:j] == b[i:j]).all() or (one and 2 * slot[i:j].sum() <= j - i)

        want = max((j - i for i in range(n) for j in range(i + least, n + 1) if agrees(i, j)), default=None)
        got = decontaminate._longest(item, 0, other, 0, n, least)
        assert (got and got[0]) == want


def test_decontamination_in_blocks_and_pieces(spark, monkeypatch):
    rng = random.Random(16)
    items = [(i, prose(random.Random(100 + i), 30)) for i in range(12)]
    docs = [(i, prose(rng, 500) + " " + items[i][1] + " " + prose(rng, 500)) for i in range(12)]
    bench, d = spark.createDataFrame(items, "item_id long, text string"), spark.createDataFrame(docs, "doc_id long, text string")
    want = {(i, i) for i in range(12)}
    assert {(r["doc_id"], r["item_id"]) for r in decontaminate.contaminated(d, bench).collect()} == want
    assert len(list(decontaminate.indexes(bench, block=400))) > 3
    text = docs[3][1].encode()
    index = next(decontaminate.indexes(bench))
    monkeypatch.setattr(decontaminate, "PIECE", 1600)
    assert set(decontaminate._find(index, text)) == {3}


# ---------------------------------------------------------------- 8: HTML

PAGE = """<!DOCTYPE html><html><head><title>T</title><style>p{{}}</style><script>var t="</p>";</script></head><body>
<header><h2>Site</h2></header><nav><ul><li><a href=/>Home</a></ul></nav><div class="cookie-notice">We use cookies.</div>
<div class="page"><div class="post-{0}"><h1>Title {0} &amp; more</h1><p>First <b>bold</b>ness of page {0},<br>second&nbsp;line.<p>Unclosed paragraph {0}.
<div class="ad">Buy now</div><form><p>Your mail</p></form></div><div class=sidebar><p>Other posts, a long list of other posts that is longer than the text of the page itself, and more of it here.</div></div>
<div id="comments"><p>First!</p></div><footer>&copy; x</footer></body></html>"""


def test_html_main_text(spark):
    rows = [(i, f"https://U@Blog.example.org:8{i}/p?x", PAGE.format(i)) for i in range(8)] + [(20, "https://blog.example.org/q", "<p>Odd <i>page</i></p>"), (21, None, None), (22, "x", ""), (23, "https://blog.example.org/r", "no tags &lt;at&gt; all")]
    df = spark.createDataFrame(rows, "page_id long, url string, html string").withColumn("path", F.lit(1))
    got = {r["page_id"]: r for r in html.extract(df).collect()}
    for i in range(8):
        assert got[i]["text"] == f"Title {i} & more First boldness of page {i}, second line. Unclosed paragraph {i}."
        assert got[i]["n_chars"] == len(got[i]["text"])
    assert [got[i]["text"] for i in (20, 21, 22, 23)] == ["Odd page", "", "", "no tags <at> all"]
    shuffled = html.extract(df, broadcast_hosts=0)
    assert sorted(map(tuple, shuffled.collect())) == sorted(tuple(r) for r in got.values())
    assert html.extract(df.limit(0)).count() == 0


def test_host_column_agrees(spark):
    urls = ["http://A.b.c/x", "https://u:p@h.org:80", "x", "", None, "ftp://z?y"]
    got = spark.createDataFrame([(u,) for u in urls], "u string").select(html.host_column(F.col("u")).alias("h")).collect()
    assert [r["h"] for r in got] == [html.host_of(u) for u in urls]


# ---------------------------------------------------------------- 10: sharding


def test_sharding_merges_commits_and_recovers(spark, tmp_path, odd, empty):
    root = f"file://{tmp_path}/store"
    store = sharding.ShardStore(spark, root, target=60_000, fan_in=3, smallest=1000)
    rng = random.Random(17)
    for k in range(4):
        store.append(spark.createDataFrame([doc(100 * k + i, str(rng.getrandbits(4000))) for i in range(20)], DOC).repartition(2))
    assert store.version() == 4 and len(store.shards()) == 8
    assert len(store.shards(2)) == 4
    store._written(spark.createDataFrame([doc(1, "orphan of a failed job")], DOC))
    version = store.compact()
    assert version > 4 and len(store.shards()) < 8 and not store.plan()
    rows = store.read()
    assert sorted(r["doc_id"] for r in rows.collect()) == sorted(100 * k + i for k in range(4) for i in range(20))
    assert store.vacuum() >= 9 and store.read().count() == 80
    with pytest.raises(RuntimeError, match="another commit"):
        store.commit([], [sharding.Shard("gone", 1)])
    out = sharding.shard(odd, f"file://{tmp_path}/odd")
    assert out.count() == 9 and out.select("shard", "shard_row").distinct().count() == 9
    assert sharding.shard(empty, f"file://{tmp_path}/none").count() == 0


def test_a_lost_race_for_a_version_retries(spark, tmp_path, monkeypatch):
    store = sharding.ShardStore(spark, f"file://{tmp_path}/race")
    store.append(spark.createDataFrame([doc(1, "a")], DOC))
    seen = iter([0, 1])  # the first look is stale
    monkeypatch.setattr(store, "version", lambda: next(seen))
    assert store.commit([sharding.Shard("b", 1)]) == 2


# ---------------------------------------------------------------- queries


@pytest.mark.parametrize("name", sorted(Q.QUERIES))
def test_queries_run_on_the_driver_tables(spark, sf, name):
    df = Q.QUERIES[name](spark, sf)
    table = {"op6_ann": None, "op7_decontamination": None, "op8_html": "pages", "op11_search": None, "op12_filters": None}.get(name, "documents")
    n = df.count()
    assert n > 0 and (table is None or n == spark.read.parquet(f"{sf}/{table}.parquet").count())
