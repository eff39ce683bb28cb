import math
import random

from citeloom.operators import layout


def test_layout_equals_plain_averaging(spark):
    rng = random.Random(3)
    rows = [(rng.randrange(20), rng.randrange(20), rng.randrange(1, 5)) for _ in range(60)] + [(3, 3, 9), (100, 101, 1)]
    edges = spark.createDataFrame(rows, "src long, dst long, n_co long")
    got = {r["node"]: (r["x"], r["y"]) for r in layout.layout(edges, rounds=8).collect()}
    w = {}
    for a, b, n in rows:
        if a != b:
            for p in ((a, b), (b, a)):
                w[p] = w.get(p, 0) + n
    nodes = sorted({a for a, _ in w})
    d = {u: sum(n for (a, _), n in w.items() if a == u) for u in nodes}
    start = {r["node"]: (r["x"], r["y"]) for r in spark.createDataFrame([(u,) for u in nodes], "node long").select("node", layout._start(layout.F.col("node"), 1).alias("x"), layout._start(layout.F.col("node"), 2).alias("y")).collect()}
    x, y = ({u: start[u][k] for u in nodes} for k in (0, 1))
    total = sum(d.values())
    for r in range(8):
        x, y = ({u: z[u] / 2 + sum(n * z[b] for (a, b), n in w.items() if a == u) / d[u] / 2 for u in nodes} for z in (x, y))
        if (r + 1) % layout.WRITTEN == 0:
            mean = lambda z: sum(d[u] * z[u] for u in nodes) / total
            x, y = ({u: z[u] - mean(z) for u in nodes} for z in (x, y))
            dot = lambda p, q: sum(d[u] * p[u] * q[u] for u in nodes) / total
            share = dot(x, y) / dot(x, x)
            y = {u: y[u] - share * x[u] for u in nodes}
            x, y = ({u: z[u] / math.sqrt(dot(z, z)) for u in nodes} for z in (x, y))
    own = {r["node"]: (r["x"], r["y"]) for r in spark.createDataFrame([(u,) for u in nodes], "node long").select("node", layout._start(layout.F.col("node"), 3).alias("x"), layout._start(layout.F.col("node"), 4).alias("y")).collect()}
    for u in nodes:
        want = (layout.WIDTH / 2 + (layout.WIDTH / 2 - layout.MARGIN) * math.tanh(x[u] / 2), layout.HEIGHT / 2 + (layout.HEIGHT / 2 - layout.MARGIN) * math.tanh(y[u] / 2))
        assert all(abs(a - b) <= 0.11 for a, b in zip(got[u], (w + layout.APART * o for w, o in zip(want, own[u]))))
    assert len(got) == len(nodes)
    assert layout.layout(edges.limit(0)).collect() == []


def test_groups_stand_apart(spark):
    rows = [(a, b, 5) for g in (0, 10) for a in range(g, g + 8) for b in range(a + 1, g + 8)] + [(0, 10, 1)]
    at = {r["node"]: r["x"] for r in layout.layout(spark.createDataFrame(rows, "src long, dst long, n_co long")).collect()}
    left, right = sorted([[at[i] for i in range(1, 8)], [at[i] for i in range(11, 18)]])
    assert max(left) < min(right)
