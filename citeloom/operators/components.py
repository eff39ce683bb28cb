"""Connected components of an edge table by alternating star contraction."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import Scratch


def connected_components(edges: DataFrame, a: str = "a", b: str = "b", scratch: Scratch | None = None) -> DataFrame:
    """(node, component): component is the smallest node reachable; only nodes on an edge between two different nodes appear.

    Each round runs a large-star and a small-star pass (Kiveris et al., 2014) and writes the shrunken edge set to the
    shared folder, so lineage stays short and a lost executor costs one round. A round shuffles the edges a constant
    number of times and the number of rounds is logarithmic in practice; nothing is collected but one checksum row. Null ends and
    self loops are ignored; repeated edges count once; an empty input gives an empty result.
    """
    scratch = scratch or Scratch(edges.sparkSession, "components")
    u, v = F.col("u"), F.col("v")
    now, path = scratch.write(
        edges.select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v"))
        .where(F.col(a).isNotNull() & F.col(b).isNotNull() & (F.col(a) != F.col(b)))
        .distinct(),
        "edges",
    )
    seen = None
    while True:
        both = now.unionByName(now.select(v.alias("u"), u.alias("v")))
        low = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.join(low, "u").where(v > u).select(v.alias("u"), F.col("m").alias("v")).where(u != v).distinct()
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(low, "u").select(
            F.explode(F.array(F.struct(u.alias("u"), F.col("m").alias("v")), F.struct(v.alias("u"), F.col("m").alias("v")))).alias("e")
        )
        small = small.select("e.u", "e.v").where(u != v).distinct()
        after, new_path = scratch.write(small, "edges")
        check = after.agg(F.count(F.lit(1)).alias("n"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)")).alias("s")).first()
        scratch.drop(path)
        now, path = after, new_path
        if seen == tuple(check) or not check["n"]:
            roots = now.select(v.alias("node"), v.alias("component")).distinct()
            return now.select(u.alias("node"), v.alias("component")).unionByName(roots)
        seen = tuple(check)


def maximum_forest(edges: DataFrame, a: str = "a", b: str = "b", weight: str = "weight", scratch: Scratch | None = None) -> DataFrame:
    """(a, b, weight): a maximum spanning forest, by which the components at every threshold are known from one run.

    Boruvka's rounds: every component takes its heaviest edge to another one (ties by the ends, so the order is total and no
    cycle can close), components joined by the taken edges become one, and of the edges between two components the heaviest stays. A round
    at least halves the components; the taken edges of each are written. The edges of a component among the forest's with a
    weight of t or more are those of the whole graph's with such edges only, and a node's heaviest edge is in the forest. Null
    ends or weights and self loops are ignored, repeated edges count once with their largest weight.
    """
    scratch = scratch or Scratch(edges.sparkSession, "forest")
    ends = edges.select(F.least(a, b).alias("a"), F.greatest(a, b).alias("b"), F.col(weight).alias("w"))
    ends = ends.where(F.col(a).isNotNull() & F.col(b).isNotNull() & F.col("w").isNotNull() & (F.col(a) != F.col(b)))
    now, path = scratch.write(ends.groupBy("a", "b").agg(F.max("w").alias("w")).select(F.col("a").alias("u"), F.col("b").alias("v"), F.struct("w", "a", "b").alias("e")), "edges")
    taken = None
    while now.head(1):
        both = now.unionByName(now.select(F.col("v").alias("u"), F.col("u").alias("v"), "e"))
        best = both.groupBy("u").agg(F.max(F.struct("e", "v")).alias("m")).select("u", "m.v", "m.e")
        best = scratch.keep(best.groupBy("e").agg(F.min("u").alias("u"), F.max("v").alias("v")), "taken")  # an edge that both ends take is one
        taken = best if taken is None else taken.unionByName(best)
        steps = Scratch(edges.sparkSession, "forest-components")
        whole = connected_components(best.select("u", F.when(F.col("u") == F.col("v"), F.lit(None)).otherwise(F.col("v")).alias("v")), "u", "v", steps)
        name = lambda side: whole.select(F.col("node").alias(side), F.col("component").alias(f"_{side}"))
        left = now.join(name("u"), "u").join(name("v"), "v").where("_u <> _v")
        left = left.groupBy(F.least("_u", "_v").alias("u"), F.greatest("_u", "_v").alias("v")).agg(F.max("e").alias("e"))
        after, new_path = scratch.write(left, "edges")
        scratch.drop(path)
        steps.drop()
        now, path = after, new_path
    found = now.select("e") if taken is None else taken.select("e")
    return found.select(F.col("e.a").alias("a"), F.col("e.b").alias("b"), F.col("e.w").alias("weight"))


def forest_sizes(forest: DataFrame, thresholds: tuple[float, ...]) -> DataFrame:
    """(threshold, components, nodes) of the edges at or over each threshold, counted on a maximum forest: a tree has a node more than
    edges, so there are as many components as nodes with such an edge less such edges."""
    at = F.array(*[F.lit(float(t)) for t in thresholds])
    nodes = forest.select(F.explode(F.array("a", "b")).alias("n"), "weight").groupBy("n").agg(F.max("weight").alias("weight")).select("weight", F.lit(0).alias("edge"))
    each = nodes.unionByName(forest.select("weight", F.lit(1).alias("edge"))).select("weight", "edge", F.explode(at).alias("threshold"))
    over = lambda kind: F.count_if((F.col("edge") == kind) & (F.col("weight") >= F.col("threshold")))
    return each.groupBy("threshold").agg((over(0) - over(1)).alias("components"), over(0).alias("nodes"))
