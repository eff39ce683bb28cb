"""Two-dimensional layout of a graph by rounds of averaging."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import Scratch

#: The canvas, how far nodes are moved apart, the rounds, and after how many of them the places are written.
WIDTH, HEIGHT, MARGIN, APART, ROUNDS, WRITTEN = 1000.0, 600.0, 40.0, 30.0, 24, 4


def _start(node: Column, seed: int) -> Column:
    """A number from -1 to 1 that depends on the node alone."""
    return F.pmod(F.xxhash64(node, F.lit(seed)), F.lit(1 << 20)).cast("double") / (1 << 19) - 1


def layout(edges: DataFrame, rounds: int = ROUNDS) -> DataFrame:
    """(node, x, y) of every node on an edge src, dst, n_co; repeated or turned edges add up, loops are ignored.

    Nodes begin at places given by a hash. In each round a node moves half of the way to the mean of its neighbours, weighed by count; then
    both directions are centred and scaled to one, and what the second shares with the first is taken out, all weighed by the nodes'
    degrees. So neighbours draw together along the two slowest directions of the averaging while the whole keeps its size. At the end
    places are pressed onto the canvas, the far ones most, and each node is moved by up to half of the room that it has on an even canvas
    (APART at most), in a direction of its own, so that nodes with the same neighbours don't coincide. Steps of a tenth.

    A round is a join of the edges with the places, both dealt by node, and one aggregation to a row of sums; places are
    written every few rounds, so the plan stays short. No task or driver holds the graph, whatever its size.
    """
    keep = Scratch(edges.sparkSession, "layout")
    e = edges.where(F.col("src") != F.col("dst"))
    e = e.select(F.col("src").alias("u"), F.col("dst").alias("v"), "n_co").unionByName(e.select(F.col("dst").alias("u"), F.col("src").alias("v"), "n_co"))
    e = keep.keep(e.groupBy("u", "v").agg(F.sum("n_co").cast("double").alias("w")), "edges")
    now = e.groupBy(F.col("u").alias("node")).agg(F.sum("w").alias("d")).select("node", "d", _start(F.col("node"), 1).alias("x"), _start(F.col("node"), 2).alias("y"))
    for r in range(rounds):
        if r % WRITTEN == 0:
            now = keep.keep(now, "places")
        near = e.join(now.select(F.col("node").alias("v"), "x", "y"), "v").groupBy(F.col("u").alias("node")).agg(F.sum(F.col("w") * F.col("x")).alias("sx"), F.sum(F.col("w") * F.col("y")).alias("sy"))
        now = now.join(near, "node").select("node", "d", (F.col("x") / 2 + F.col("sx") / F.col("d") / 2).alias("x"), (F.col("y") / 2 + F.col("sy") / F.col("d") / 2).alias("y"))
        if (r + 1) % WRITTEN == 0 or r + 1 == rounds:
            now = _spread(keep.keep(now, "places"))
    apart = min(APART, 0.5 * (WIDTH * HEIGHT / max(1, now.count())) ** 0.5)
    placed = lambda c, size, seed: F.round(F.lit(size / 2) + (size / 2 - MARGIN) * F.tanh(F.col(c) / 2) + apart * _start(F.col("node"), seed), 1).alias(c)
    return now.select("node", placed("x", WIDTH, 3), placed("y", HEIGHT, 4))


def _spread(places: DataFrame) -> DataFrame:
    """Both directions centred, apart from each other and of size one, weighed by d. The sums are one row."""
    d, x, y = F.col("d"), F.col("x"), F.col("y")
    s = places.agg(F.sum(d), F.sum(d * x), F.sum(d * y), F.sum(d * x * x), F.sum(d * y * y), F.sum(d * x * y)).first()
    if not s[0]:
        return places
    mx, my = s[1] / s[0], s[2] / s[0]
    xx, yy, xy = (s[3] / s[0] - mx * mx, s[4] / s[0] - my * my, s[5] / s[0] - mx * my)
    shared = xy / xx if xx > 1e-18 else 0.0
    rest = yy - shared * xy
    size = lambda v: v**0.5 if v > 1e-18 else 1.0
    return places.select("node", "d", ((x - mx) / size(xx)).alias("x"), ((y - my - shared * (x - mx)) / size(rest)).alias("y"))
