
import math

import random
import re
from collections import Counter

import duckdb
import numpy as np

from pyspark.sql import functions as F

from citeloom.llm import interactions, licenses, repeats, search
from citeloom.llm import queries as Q
from citeloom.llm.license_rules import CERTAINTY, KEYWORDS, LABELS, RULES
from citeloom.operators import postings
from citeloom.session import table

WORDS = ["lorem", "ipsum", "dolor", "sit", "amet", "elit", "sed", "tempor", "magna", "aliqua", "enim", "minim", "quis", "nisi", "aute", "velit"]


def same_as_sql(spark, sf, query, sql):
    c = duckdb.connect()
    for t in ("documents", "benchmark", "labels"):
        c.sql(f"CREATE VIEW {t} AS SELECT * FROM '{sf}/{t}.parquet'")
    got, want = query(spark, sf), c.execute(sql)
    names = [x[0] for x in want.description]
    assert sorted(got.columns) == sorted(names)
    assert sorted(map(tuple, got.select(*names).collect())) == sorted(want.fetchall())


# ---------------------------------------------------------------- 11: ranked lexical search


def plain_search(docs, items, k):
    own = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")
    low = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    words = lambda t: own.findall((t or "").translate(low))
    texts = [(i, Counter(w), len(w)) for i, w in ((i, words(t)) for i, t in docs)]
    n, length = sum(x[2] > 0 for x in texts), sum(x[2] for x in texts)
    df = Counter(t for _, c, _ in texts for t in c)
    out = []
    for item, text in items:
        scores = []
        for i, c, size in texts:
            m = 25 + (75 * size * n) // max(1, length)
            s = sum(math.floor(1000 * math.log((2 * n + 2) / (2 * df[t] + 1))) * ((10**9 * c[t]) // (1000 * c[t] + 8 * m)) for t in words(text) if t in c)
            scores.append((-s, i is None, i or 0, i))
        out += [(item, r + 1, s[3], -s[0]) for r, s in enumerate(sorted(x for x in scores if x[0] < 0)[:k])]
    return out


def test_search_equals_sql(spark, sf):
    same_as_sql(spark, sf, Q.QUERIES["op11_search"], Q.ORACLE_SQL["op11_search"])


def test_search_equals_brute_force(spark, monkeypatch):
    rng = random.Random(3)
    some = lambda n: " ".join(rng.choice(WORDS + [f"rare{rng.randrange(200)}"] * 4) for _ in range(n))
    docs = [(i, some(rng.randrange(1, 60))) for i in range(700)]
    docs += [(700 + i, docs[5][1]) for i in range(40)] + [(3, docs[3][1]), (None, docs[5][1]), (800, None), (801, ""), (802, " .. "), (803, "ÉTÉ été Éa LOREM-ipsum"), (804, some(30_000))]
    items = [(i, some(rng.randrange(1, 12))) for i in range(30)] + [(40, docs[5][1]), (41, "lorem lorem lorem ipsum"), (42, None), (43, "absent"), (44, "été LOREM"), (45, "")]
    frame = spark.createDataFrame(docs, "doc_id long, text string").repartition(3).withColumns({"n": F.lit("x"), "doc": F.lit(1), "item_id": F.lit(2)})
    asked = spark.createDataFrame(items + [(None, "lorem"), (41, "zzz")], "item_id long, text string").withColumn("q", F.lit(0))
    want = sorted(plain_search(docs, items, 7), key=lambda x: (x[0], x[1]))
    for size in (search.POSTINGS, 500):  # one segment a task, and many with their floors carried on
        monkeypatch.setattr(search, "POSTINGS", size)
        monkeypatch.setattr(search, "FIRST_RANGE", 16)
        monkeypatch.setattr(search, "ITEMS", 20)
        got = search.search(frame, asked, k=7)
        assert got.columns == ["item_id", "rank", "doc_id", "score"]
        assert sorted(map(tuple, got.collect()), key=lambda x: (x[0], x[1])) == want
    monkeypatch.setattr(search, "TERMS", 100)  # the queries' terms in several rounds
    assert sorted(map(tuple, search.search(frame, asked, k=7).collect()), key=lambda x: (x[0], x[1])) == want


def test_search_of_nothing(spark):
    none, one = spark.createDataFrame([], "doc_id long, text string"), spark.createDataFrame([(1, "a b")], "doc_id long, text string")
    asked = spark.createDataFrame([(1, "a")], "item_id long, text string")
    assert search.search(none, asked).collect() == []
    assert search.search(one, asked.where("item_id > 1")).collect() == []
    # one document: w = floor(1000 ln(4 / 3)), m = 25 + 75
    assert [tuple(r) for r in search.search(one, asked).collect()] == [(1, 1, 1, 287 * (10**9 // (1000 + 800)))]


def test_maxscore_reads_less_and_keeps_ties():
    import pyarrow as pa

    rng = np.random.default_rng(5)
    n, common, rare = 20_000, 6, 40
    terms, tfs = [], []
    for _ in range(n):
        t = sorted({*range(common), *(common + rng.integers(0, rare, 1)).tolist()})
        terms.append(t)
        tfs.append(rng.integers(1, 4, len(t)).tolist())
    batch = pa.RecordBatch.from_arrays([pa.array(range(n)), pa.array([len(t) * 2 for t in terms], pa.int64()), pa.array(terms, pa.list_(pa.int32())), pa.array(tfs, pa.list_(pa.int32()))], ["doc", "n", "terms", "tfs"])
    shard = search.Shard(postings.Segment([batch]), n, 2 * sum(map(len, terms)))
    asked = [(t, 20) for t in range(common)] + [(common + 3, 6000), (common + 9, 5000)]
    best, read = shard.best(asked, 10)
    norm = 25 + (75 * shard_n(batch) * n) // (2 * sum(map(len, terms)))
    weight = dict(asked)
    scores = [sum(weight[t] * ((10**9 * f) // (1000 * f + 8 * int(m))) for t, f in zip(a, b) if t in weight) for a, b, m in zip(terms, tfs, norm)]
    assert best == sorted((-s, i) for i, s in enumerate(scores))[:10]
    assert read < 0.2 * sum(t in weight for a in terms for t in a)


def shard_n(batch):
    return batch.column(1).to_numpy()


# ---------------------------------------------------------------- 12: filter interactions


def test_interactions_equal_sql(spark, sf):
    same_as_sql(spark, sf, Q.QUERIES["op12_filters"], Q.ORACLE_SQL["op12_filters"])


def plain_masks(rows):
    first = {}
    for i, t, _ in rows:
        if i is not None:
            first[t or ""] = min(first.get(t or "", i), i)
    out = []
    for i, t, part in rows:
        t = t or ""
        w = re.findall(r"[^\x20\x09-\x0D]+", t)
        fails = [len(w) < 100, 100 * len(set(w)) < 80 * len(w), 100 * len(re.findall("[A-Z]", t)) > 10 * len(t), bool(re.search(r"[#$%&*|]", t)), i is not None and first[t] < i]
        out.append((i, part or "", fails))
    return out


def test_interactions_equal_a_walk_through_each_order(spark, monkeypatch):
    rng = random.Random(8)
    text = lambda: " ".join(rng.choice(["Aa", "BB", "c", "d#", "é x", f"u{rng.randrange(400)}", f"v{rng.randrange(400)}", f"w{rng.randrange(4000)}"]) + rng.choice(["", "", "\n", " "]) for _ in range(rng.choice([5, 99, 100, 101, 300])))
    rows = [(i, text(), rng.choice(["en", "fr", None, ""])) for i in range(60)]
    rows += [(100 + i, rows[i % 4][1], "en") for i in range(30)] + [(200, None, "en"), (201, "", "fr"), (None, rows[0][1], "en"), (None, None, None), (3, rows[3][1], "de"), (202, " ".join(f"x{i}" for i in range(30_000)), "de")]
    labels = [(i, rng.choice([0, 1, None]), rng.choice([0, 1, None])) for i in range(0, 140, 2)] + [(4, 1, 1), (None, 1, 1), (999, 1, 1)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string").repartition(5).withColumns({"mask": F.lit("x"), "part": F.lit("y"), "digest": F.lit(1)})
    monkeypatch.setattr(interactions, "ROWS", 16)
    monkeypatch.setattr(interactions, "PARTS", 2)
    got = {(r["part"], r["filter_order"], r["step"]): tuple(r)[3:] for r in interactions.interactions(interactions.failures(docs), spark.createDataFrame(labels, "doc_id long, quality int, toxic int")).collect()}
    good, bad = ({i for i, *v in labels if i is not None and v[k] == 1} for k in (0, 1))
    masks, want = plain_masks(rows), {}
    for part in {p for _, p, _ in masks}:
        shapley = Counter()
        for order in interactions.ORDERS:
            left = [(i, f) for i, p, f in masks if p == part]
            all_of = list(left)
            for s, name in enumerate(order):
                k = interactions.FILTERS.index(name)
                out = [(i, f) for i, f in left if f[k]]
                left = [(i, f) for i, f in left if not f[k]]
                shapley[name] += len(out)
                want[part, order, s + 1] = [len(left), len(out), sum(f[k] for _, f in all_of) - len(out), sum(f[k] and sum(f) == 1 for _, f in all_of), sum(i in good for i, _ in out), sum(i in bad for i, _ in out)]
        for order in interactions.ORDERS:
            for s, name in enumerate(order):
                want[part, order, s + 1].append(shapley[name])
    assert got == {k: tuple(v) for k, v in want.items()}


def test_interactions_of_nothing(spark):
    docs, labels = spark.createDataFrame([], "doc_id long, text string, lang string"), spark.createDataFrame([], "doc_id long, quality int, toxic int")
    assert interactions.interactions(interactions.failures(docs), labels).collect() == []


# ---------------------------------------------------------------- 13: license scan


def plain_scan(text):
    """What the scan has to find, rule by rule with finditer and pair by pair."""
    low = (text or "").translate(str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"))
    words = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", low)
    line = " " + " ".join(words) + " "
    places = [(i, label) for phrase, label in licenses.PHRASES.items() for p in [phrase.split()] for i in range(len(words)) if words[i : i + len(p)] == p]
    found = []
    for rank, rule in enumerate(RULES):
        for m in re.finditer(f" ({rule.pattern})(?= )", line):
            start = line[: m.start()].count(" ")
            found.append((start, start + len(m[1].split()), rule.level, rank, rule.label))
    holds = lambda e, d: e[0] <= d[0] and d[1] <= e[1] and (e[2] < d[2] or e[2] == d[2] and (e[1] - e[0] > d[1] - d[0] or e[:2] == d[:2] and e[3] < d[3]))
    stay = [d for d in found if not any(holds(e, d) for e in found)]
    base = sorted({x for _, x in places})
    starts = [i for i, _ in places]
    score = max([CERTAINTY[d[2]] for d in stay] + [CERTAINTY[3] if base else 0.0])
    labels = sorted({*base, *(d[4] for d in stay)})
    plain_scan.stay = sorted((d[4], d[2], d[3], d[0], d[1]) for d in stay)
    return len(words), len(places), min(starts, default=None), max(starts, default=None), ",".join(base), ",".join(labels), score, sorted(Counter(d[4] for d in stay).items())


def examples(rule, rng):
    """A text that the rule's pattern matches, with a random choice at each alternative."""
    from re import _constants as C
    from re import _parser

    def walk(items):
        out = ""
        for op, arg in items:
            if op is C.LITERAL:
                out += chr(arg)
            elif op is C.BRANCH:
                out += walk(rng.choice(arg[1]))
            elif op is C.SUBPATTERN:
                out += walk(arg[3])
            elif op in (C.MAX_REPEAT, C.MIN_REPEAT):
                out += "".join(walk(arg[2]) for _ in range(rng.randint(arg[0], min(arg[1], arg[0] + 1))))
            elif op is C.IN:
                kind, value = rng.choice(arg)
                out += chr(value) if kind is C.LITERAL else chr(rng.randint(*value)) if kind is C.RANGE else {C.CATEGORY_DIGIT: "7", C.CATEGORY_NOT_SPACE: "q"}[value]
            else:
                raise AssertionError(op)
        return out

    return walk(_parser.parse(rule.pattern))


def test_rules_are_reachable_through_their_keywords():
    rng = random.Random(2)
    assert len(RULES) >= 300 and len({(r.label, r.pattern) for r in RULES}) == len(RULES)
    for r in RULES:
        for _ in range(12):
            text = " " + examples(r, rng)
            assert re.fullmatch(r.pattern, text[1:]), (r, text)
            assert " " + r.keyword in text, (r, text)


def test_scan_equals_plain_rules(spark):
    rng = random.Random(6)
    given = [None, "", " \n.", "a", "CC-BY cc by, (CC BY-NC 4.0); ccby", "All Rights\nReserved. all rights reserved all rights", "the GNU General Public License, version 3. general public license", "LİCENSE Licensed under MİT, Key", "lICENSED UNDER THE APACHE LICENSE, VERSION 2.0", "Copyright (c) 2019-2021 Äüß. Alle Rechte vorbehalten", "cc by " * 3000, "x " * 20_000 + "SPDX-License-Identifier: GPL-2.0-or-later"]
    for r in RULES:
        given.append(examples(r, rng).title())
    for _ in range(150):
        parts = [examples(rng.choice(RULES), rng) if rng.random() < 0.6 else " ".join(rng.choice(WORDS) for _ in range(rng.randrange(6))) for _ in range(rng.randrange(1, 7))]
        given.append(rng.choice([" ", ". ", "\n", ""]).join(parts).replace(" ", rng.choice([" ", "-", "\r\n", " \x7f"])))
    docs = spark.createDataFrame(list(enumerate(given)), "doc_id long, text string").repartition(4).withColumns({"n_words": F.lit("x"), "found": F.lit(1), "_words": F.lit("y")})
    rows = {r["doc_id"]: r for r in licenses.scan(docs).collect()}
    assert len(rows) == len(given)
    for i, text in enumerate(given):
        r = rows[i]
        got = (r["n_words"], r["n_base"], r["first_word"], r["last_word"], r["base_labels"], r["labels"], r["score"], sorted(map(tuple, r["found"])))
        assert got == plain_scan(text), text


def test_detections_are_those_behind_the_labels(spark):
    rng = random.Random(7)
    given = [None, "", "cc by " * 400]
    for _ in range(60):
        given.append(rng.choice([" ", ". "]).join(examples(rng.choice(RULES), rng) if rng.random() < 0.7 else rng.choice(WORDS) for _ in range(rng.randrange(1, 9))))
    docs = spark.createDataFrame([*enumerate(given), (3, given[3])], "doc_id long, text string").repartition(4)
    got = {}
    for r in licenses.detections(docs).collect():
        got.setdefault(r["doc_id"], []).append(tuple(r)[1:])
    for i, text in enumerate(given):
        plain_scan(text)
        assert sorted(got.get(i, [])) == sorted(plain_scan.stay * (2 if i == 3 else 1)), text


def test_scan_of_a_table(spark, sf):
    texts = dict(table(spark, sf, "documents").select("doc_id", "text").collect())
    rows = Q.QUERIES["op13_licenses"](spark, sf).collect()
    assert len(rows) == len(texts)
    for r in rows:
        assert (r["n_words"], r["n_base"], r["first_word"], r["last_word"], r["base_labels"], r["labels"], r["score"]) == plain_scan(texts[r["doc_id"]])[:7]
    assert licenses.scan(spark.createDataFrame([], "doc_id long, text string")).collect() == []


def test_scan_stays_in_the_jvm(spark, sf):
    plan = Q.QUERIES["op13_licenses"](spark, sf)._jdf.queryExecution().executedPlan().toString()
    assert not re.search("Python|Pandas|Arrow|Exchange", plan)


# ---------------------------------------------------------------- 5: texts of few bytes


def test_spans_of_low_entropy_texts_are_merged_in_the_tasks(spark):
    texts = ["a" * 300_000, "ab" * 100_000 + "end", "-=- " * 50_000, "a" * 150 + "b" * 150, "x" * 199, "q" * 201]
    docs = spark.createDataFrame([(i, t) for i, t in enumerate(texts)] + [(None, "a" * 250)], "doc_id long, text string").repartition(3)
    source = docs.select("doc_id", F.xxhash64("text").alias("digest"), F.col("text").cast("binary").alias("t"))
    spans = {r["doc_id"]: r["spans"] for r in repeats.repeated_spans(source).collect()}
    assert all(len(s) < 200 for s in spans.values())  # and not one for each window
    got = {r["doc_id"]: (r["n_removed"], r["n_spans"]) for r in repeats.remove_repeats(docs).collect()}
    assert got == {0: (300_000, 1), 1: (200_000, 1), 2: (200_000, 1), 3: (0, 0), 4: (0, 0), 5: (201, 1), None: (250, 1)}


def test_merged_spans_cover_the_same(spark):
    import pyarrow as pa

    rng = random.Random(4)
    rows = [(rng.choice([None, 1, 2, 1 << 60, (1 << 60) + 1]), rng.choice([5, -5]), a, a + rng.randrange(1, 9)) for a in [rng.randrange(60) for _ in range(150)]]
    batch = pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], pa.int64()) for k in range(4)], ["doc_id", "digest", "start", "end"])
    (out,) = repeats._merged(iter([batch, batch.slice(0, 0)]))
    cover = lambda spans: {(d, g, x) for d, g, a, b in spans for x in range(a, b)}
    got = [tuple(r.values()) for r in out.to_pylist()]
    assert cover(got) == cover(rows)
    assert len(got) == sum((d, g, x - 1) not in cover(rows) for d, g, x in cover(rows))
