"""Association graph of items that occur in the same basket, and queries over it."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.designation import citation_digits
from ..functions.text import shown
from ..session import Scratch, dealt_to
from .lookup import first_by, resolve

#: Items of a basket that are paired in one task.
PART = 1000
#: Rows of baskets that a task deals and counts at first. Tasks merged by their shuffled bytes would hold some millions, as keys compress well.
ROWS = 250_000
#: Pairs that a task makes, or sums, at most on average; and tasks that they are dealt to at most.
PAIRS, TASKS = 1_000_000, 10_000
#: Share of rows with rare items from which on leaving these out before pairing is worth two shuffles of the rest.
RARE = 0.1


def cocitation_edges(baskets: DataFrame, min_co: int = 2, min_confidence: float = 0.20, min_src: int = 2, basket: str = "basket", item: str = "item") -> DataFrame:
    """Directed edges (src, dst, n_src, n_dst, n_co, confidence, lift) between items of one basket.

    Items of a basket are a set. An item in fewer than min_co baskets can have no edge; where such items are many, they are dropped
    before pairing. Pairs are formed once, unordered, and turned after counting, which halves the shuffle.
    """
    spark = baskets.sparkSession
    sets, n = _sets(baskets, basket, item)
    size = _sizes(sets)
    freq = Scratch(spark, "freq").keep(sets.groupBy("i").agg(F.count(F.lit(1)).alias("f")), "freq")
    rare, rows = freq.agg(F.sum(F.when(F.col("f") < min_co, F.col("f"))), F.sum("f")).first()
    if (rare or 0) > RARE * (rows or 0):
        sets = _dealt(sets.join(freq.where(F.col("f") >= min_co).select("i"), "i", "left_semi"), n)
    pairs = _pair_counts(sets, n, size).withColumnRenamed("n", "n_co").where(F.col("n_co") >= min_co)
    return _edges(pairs, freq, spark.range(1).select(F.lit(size[0]).cast("long").alias("n")), min_confidence, min_src)


def _dealt(rows: DataFrame, n: int) -> DataFrame:
    """rows with t, whole baskets in the task t of n. What is grouped by t and more stays in its task."""
    return rows.withColumn("t", F.pmod(F.xxhash64("b"), F.lit(n)).cast("int")).repartitionById(n, "t")


def _sets(baskets: DataFrame, basket: str, item: str) -> tuple[DataFrame, int]:
    """Distinct (b, i, t), whole baskets dealt to tasks t of about ROWS rows, and the number of these tasks."""
    rows = baskets.select(F.col(basket).alias("b"), F.col(item).alias("i"))
    n = dealt_to(rows, ROWS)
    return _dealt(rows.where("i IS NOT NULL AND b IS NOT NULL"), n).distinct(), n


def _sizes(sets: DataFrame) -> tuple[int, int, float]:
    """Baskets, the largest one's items, and all pairs, counted."""
    c = F.col("c").cast("double")
    size = sets.groupBy("t", "b").agg(F.count(F.lit(1)).alias("c")).agg(F.count(F.lit(1)), F.max("c"), F.sum(c * (c - 1) / 2)).first()
    return size[0], size[1] or 0, size[2] or 0.0


def _tasks(n: int, rows: float) -> int:
    return max(n, min(TASKS, int(-(-rows // PAIRS))))


def _pair_counts(sets: DataFrame, n: int, size: tuple[int, int, float], alone: bool = False) -> DataFrame:
    """(u, v, n): in how many baskets u and v occur, u < v, from `_sets` and their `_sizes`; with alone also each item's with v null.

    A task pairs the items of its baskets from their lists and counts its own pairs first, so a pair of very many baskets is few rows.
    If a basket has more than PART items no list is made, and baskets are paired in parts. Counts are summed in tasks of about PAIRS rows,
    however few partitions the session has.
    """
    m = _tasks(n, size[2])
    none = F.lit(None).cast(sets.schema["i"].dataType)
    if size[1] <= PART:
        lists = (_dealt(sets, m) if m > n else sets).groupBy("t", "b").agg(F.sort_array(F.collect_list("i")).alias("a")).select("t", F.posexplode("a").alias("k", "u"), "a")
        others = F.slice("a", F.col("k") + 2, F.size("a"))
        pairs = lists.select("t", "u", F.explode(F.concat(F.array(none), others) if alone else others).alias("v"))
        pairs = pairs.groupBy("t", "u", "v").agg(F.count(F.lit(1)).alias("n"))
    else:
        pairs = _paired(sets, m)
        pairs = (pairs.unionByName(sets.select(F.col("i").alias("u"), none.alias("v"))) if alone else pairs).withColumn("n", F.lit(1))
    return _summed(pairs, m)


def _summed(counts: DataFrame, n: int) -> DataFrame:
    """The sums of counts (u, v, n) by pair, in n tasks."""
    return counts.select("u", "v", "n").repartition(n, "u", "v").groupBy("u", "v").agg(F.sum("n").alias("n"))


def _paired(sets: DataFrame, n: int) -> DataFrame:
    """(u, v) of every two items u < v of a basket, from distinct (b, i), in n tasks. A basket is dealt to parts of PART items, and every
    two parts are paired in a task of their own."""
    parts = F.ceil(F.count(F.lit(1)).over(Window.partitionBy("b")) / PART).cast("int")
    live = sets.repartition(n, "b").withColumn("k", parts).withColumn("p", F.pmod(F.xxhash64("i"), F.col("k")).cast("int"))
    x = live.select("b", F.col("i").alias("u"), "p", F.explode(F.sequence(F.lit(0), F.col("k") - 1)).alias("q"))
    y = live.select("b", F.col("i").alias("v"), F.col("p").alias("q"), F.explode(F.sequence(F.lit(0), F.col("k") - 1)).alias("p"))
    x, y = x.repartition(n, "b", "p", "q"), y.repartition(n, "b", "p", "q")
    return x.join(y, ["b", "p", "q"]).where(F.col("u") < F.col("v")).select("u", "v")


def _edges(pairs: DataFrame, freq: DataFrame, total: DataFrame, min_confidence: float, min_src: int) -> DataFrame:
    """Directed edges from counts: pairs (u, v, n_co), freq (i, f), total (n)."""
    turned = F.explode(F.array(F.struct(F.col("u").alias("src"), F.col("v").alias("dst")), F.struct(F.col("v").alias("src"), F.col("u").alias("dst"))))
    e = pairs.select(turned.alias("e"), "n_co").select("e.src", "e.dst", "n_co")
    e = e.join(freq.select(F.col("i").alias("src"), F.col("f").alias("n_src")), "src").join(freq.select(F.col("i").alias("dst"), F.col("f").alias("n_dst")), "dst").crossJoin(F.broadcast(total))  # one row
    e = e.withColumn("confidence", F.col("n_co") / F.col("n_src"))
    lift = (F.col("n_co") / F.col("n")) / ((F.col("n_src") / F.col("n")) * (F.col("n_dst") / F.col("n")))
    e = e.where((F.col("n_src") >= min_src) & (F.col("confidence") >= min_confidence))
    return e.select("src", "dst", "n_src", "n_dst", "n_co", F.round("confidence", 6).alias("confidence"), F.round(lift, 6).alias("lift"))


#: Changed counts up to which they are sent to all tasks.
TOUCHED = 500_000


def basket_counts(baskets: DataFrame, basket: str = "basket", item: str = "item") -> DataFrame:
    """(u, v, n): in how many baskets both items occur, u < v; an item alone has v null, and the row without items counts the baskets.
    What `cocitation_edges` is computed from, as a table that `changed_counts` keeps up to date."""
    sets, n = _sets(baskets, basket, item)
    size = _sizes(sets)
    none = F.lit(None).cast(sets.schema["i"].dataType)
    whole = baskets.sparkSession.range(1).select(none.alias("u"), none.alias("v"), F.lit(size[0]).cast("long").alias("n")).where("n > 0")  # one row
    return _pair_counts(sets, n, size, alone=True).unionByName(whole)


def changed_counts(counts: DataFrame, added: DataFrame, removed: DataFrame, basket: str = "basket", item: str = "item") -> DataFrame:
    """counts (see `basket_counts`) after whole baskets were added and others removed; a basket that changes is both.

    The change is the added baskets' counts less the removed ones'. With up to TOUCHED changed ones these are sent to the tasks, and only
    the touched counts are shuffled; the others stay where they are. With more, counts and change are summed in one shuffle, in
    tasks of about PAIRS rows. Counts that come to nothing go.
    """
    minus = basket_counts(removed, basket, item).withColumn("n", -F.col("n"))
    delta = Scratch(counts.sparkSession, "delta").keep(basket_counts(added, basket, item).unionByName(minus), "delta")
    if delta.count() > TOUCHED:
        both = counts.unionByName(delta)
        return _summed(both, dealt_to(both, PAIRS)).where("n > 0")
    delta = delta.groupBy("u", "v").agg(F.sum("n").alias("n")).where("n <> 0")
    keys = F.broadcast(delta.select(F.col("u").alias("_u"), F.col("v").alias("_v")))  # TOUCHED rows at most
    same = F.col("u").eqNullSafe(F.col("_u")) & F.col("v").eqNullSafe(F.col("_v"))
    touched = counts.join(keys, same, "left_semi").unionByName(delta).groupBy("u", "v").agg(F.sum("n").alias("n")).where("n > 0")
    return counts.join(keys, same, "left_anti").unionByName(touched)


def counted_edges(counts: DataFrame, min_co: int = 2, min_confidence: float = 0.20, min_src: int = 2) -> DataFrame:
    """The edges of `cocitation_edges` from counts."""
    pairs = counts.where((F.col("v").isNotNull()) & (F.col("n") >= min_co)).select("u", "v", F.col("n").alias("n_co"))
    freq = counts.where("u IS NOT NULL AND v IS NULL").select(F.col("u").alias("i"), F.col("n").alias("f"))
    total = counts.where("u IS NULL").select("n")  # one row
    return _edges(pairs, freq, total, min_confidence, min_src)


def undirected_best(edges: DataFrame) -> DataFrame:
    """One row of each pair: the direction of higher confidence, on ties from the smaller item."""
    w = Window.partitionBy(F.least("src", "dst"), F.greatest("src", "dst")).orderBy(F.desc("confidence"), "src")
    return edges.withColumn("_n", F.row_number().over(w)).where("_n = 1").drop("_n")


def cap_edges(edges: DataFrame, cap: int = 12) -> DataFrame:
    """Undirected edges of which an end has the edge among its `cap` strongest (count, then ends).

    The same as taking edges by strength and skipping those whose two ends are both full: an end with room has kept
    all its edges so far, so having room is having rank cap or less. Each end ranks its own edges, in two windows.
    """
    both = edges.select("src", "dst", "n_co", F.explode(F.array("src", "dst")).alias("_end"))
    w = Window.partitionBy("_end").orderBy(F.desc("n_co"), "src", "dst")
    kept = both.withColumn("_r", F.row_number().over(w)).where(F.col("_r") <= cap).select("src", "dst").distinct()
    return edges.join(kept, ["src", "dst"], "left_semi")


def degrees(edges: DataFrame) -> DataFrame:
    """(node, degree) over both ends."""
    return edges.select(F.explode(F.array("src", "dst")).alias("node")).groupBy("node").agg(F.count(F.lit(1)).alias("degree"))


def related(edges: DataFrame, limit: int = 5) -> DataFrame:
    """The `limit` strongest neighbours of each source with rank."""
    w = Window.partitionBy("src").orderBy(F.desc("confidence"), F.desc("n_co"), "dst")
    return edges.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= limit)


def ego_network(edges: DataFrame, seeds: DataFrame, depth: int = 2, limit: int = 40) -> DataFrame:
    """Edges (src, dst, n_co, confidence, hop) within `depth` steps of the seeds (column node), `limit` from each node."""
    top = Scratch(edges.sparkSession, "ego").keep(related(edges, limit).select("src", "dst", "n_co", "confidence"), "top")
    seen, frontier, out = seeds.select("node").distinct(), seeds.select("node").distinct(), None
    for hop in range(1, depth + 1):
        step = top.join(frontier, top.src == frontier.node, "left_semi").withColumn("hop", F.lit(hop))
        out = step if out is None else out.unionByName(step)
        frontier = step.select(F.col("dst").alias("node")).distinct().join(seen, "node", "left_anti")
        seen = seen.unionByName(frontier)
    return out.groupBy("src", "dst", "n_co", "confidence").agg(F.min("hop").alias("hop"))


def hops(edges: DataFrame, seeds: DataFrame, depth: int = 3) -> DataFrame:
    """(seed, node, hops): fewest steps from each seed, up to `depth`, edges taken in both directions."""
    scratch = Scratch(edges.sparkSession, "hops")
    edges = scratch.keep(edges.select("src", "dst"), "edges")
    links = scratch.keep(edges.unionByName(edges.select(F.col("dst").alias("src"), F.col("src").alias("dst"))).distinct(), "links")
    seen = seeds.select(F.col("node").alias("seed"), "node").distinct().withColumn("hops", F.lit(0))
    frontier = seen
    for hop in range(1, depth + 1):
        step = frontier.join(links, frontier.node == links.src).select("seed", F.col("dst").alias("node")).distinct()
        frontier = scratch.keep(step.join(seen, ["seed", "node"], "left_anti").withColumn("hops", F.lit(hop)), "frontier")
        seen = seen.unionByName(frontier)
    return seen


def full_graph(edges: DataFrame, node_limit: int, edge_limit: int, min_count: int, per_node: int) -> DataFrame:
    """The display graph: edges of min_count, top nodes by degree, top edges by count, best direction of each pair, capped
    at per_node, with both ends' degrees. The order of the steps matters."""
    e = edges.where(F.col("n_co") >= min_count)
    nodes = degrees(e).orderBy(F.desc("degree"), "node").limit(node_limit).select("node")
    e = e.join(nodes, e.src == nodes.node, "left_semi").join(nodes, e.dst == nodes.node, "left_semi")
    e = cap_edges(undirected_best(e.orderBy(F.desc("n_co"), "src", "dst").limit(edge_limit)), per_node)
    d = degrees(e)
    e = e.join(d.select(F.col("node").alias("src"), F.col("degree").alias("src_degree")), "src")
    return e.join(d.select(F.col("node").alias("dst"), F.col("degree").alias("dst_degree")), "dst")


def related_of(asked: DataFrame, edges: DataFrame, limit: int = 5, citation: str = "citation") -> DataFrame:
    """(citation, src, dst, confidence, n_co, rank): the strongest neighbours of each asked designation.

    Edges whose source is the designation or its base are taken; only a designation that has none of these takes those
    whose source has its bare number.
    """
    asked = asked.select(F.col(citation).alias("citation")).where("citation IS NOT NULL").distinct()
    keys = asked.select("citation", F.explode(F.array_distinct(F.array(F.col("citation"), F.trim(F.substring_index("citation", "(", 1))))).alias("key"))
    e = edges.select("src", "dst", "confidence", "n_co")
    first = keys.join(e, keys.key == e.src).drop("key")
    rest = asked.join(first.select("citation").distinct(), "citation", "left_anti").withColumn("digits", citation_digits(F.col("citation"))).where("digits <> ''")
    second = rest.join(e.withColumn("digits", citation_digits(F.col("src"))), "digits").drop("digits")
    w = Window.partitionBy("citation").orderBy(F.desc("confidence"), F.desc("n_co"), "dst", "src")
    both = first.unionByName(second.select(*first.columns)).withColumn("rank", F.row_number().over(w))
    return both.where(F.col("rank") <= limit).select("citation", "src", "dst", "confidence", "n_co", "rank")


def described_nodes(edges: DataFrame, register: DataFrame) -> DataFrame:
    """(node, title, status, family, degree): the ends of edges with the register's fields, by number, else by base (the first in
    load order); N/A and Unknown where the register has neither."""
    d = degrees(edges)
    fields = F.struct("title", "status", "family")
    exact = first_by(register, "is_number", F.col("load_ord")).select(F.col("is_number").alias("node"), fields.alias("x"))
    base = first_by(register, "is_base", F.col("load_ord")).select(F.col("is_base").alias("_base"), fields.alias("y"))
    n = d.join(exact, "node", "left").withColumn("_base", F.trim(F.substring_index("node", "(", 1))).join(base, "_base", "left")
    r = F.coalesce("x", "y")
    return n.select("node", shown(r["title"]).alias("title"), F.coalesce(r["status"], F.lit("Unknown")).alias("status"), shown(r["family"]).alias("family"), "degree")


def titles(designations: DataFrame, register: DataFrame, citation: str = "citation") -> DataFrame:
    """(citation, title) of the designations that the register holds, resolved like any citation."""
    r = resolve(designations.select(F.col(citation).alias("citation")).distinct(), register, ["title"])
    return r.where("hit IS NOT NULL").select("citation", F.coalesce("title", F.lit("")).alias("title"))


def shortest_paths(edges: DataFrame, seeds: DataFrame, targets: DataFrame, depth: int = 6) -> DataFrame:
    """(seed, node, hops, path): a shortest path from each seed to each target (columns node) within `depth` steps, edges taken
    both ways. Of several the one whose nodes, read from the target back, come first. A seed that is a target has itself."""
    scratch = Scratch(edges.sparkSession, "paths")
    e = scratch.keep(edges.select("src", "dst"), "edges")
    links = scratch.keep(e.unionByName(e.select(F.col("dst").alias("src"), F.col("src").alias("dst"))).distinct(), "links")
    seen = seeds.select(F.col("node").alias("seed"), "node").distinct().withColumns({"hops": F.lit(0), "path": F.array("node")})
    frontier = seen
    for hop in range(1, depth + 1):
        step = frontier.join(links, frontier.node == links.src).select("seed", F.col("dst").alias("node"), F.concat("path", F.array("dst")).alias("path"), "src")
        step = step.groupBy("seed", "node").agg(F.min_by("path", "src").alias("path")).withColumn("hops", F.lit(hop))
        frontier = scratch.keep(step.join(seen.select("seed", "node"), ["seed", "node"], "left_anti").select("seed", "node", "hops", "path"), "frontier")
        if not frontier.head(1):
            break
        seen = seen.unionByName(frontier)
    return seen.join(targets.select("node").distinct(), "node", "left_semi").select("seed", "node", "hops", "path")


def strongest_first(edges: DataFrame) -> DataFrame:
    """Edges by confidence and count, strongest first, ties by ends."""
    return edges.orderBy(F.desc("confidence"), F.desc("n_co"), "src", "dst")


def edge_change(before: DataFrame, after: DataFrame) -> DataFrame:
    """One row of a rebuild: edges before and after, edges added, and edges dropped."""
    keys = lambda df, name: df.select("src", "dst", F.lit(1).alias(name))
    j = keys(before, "b").join(keys(after, "a"), ["src", "dst"], "full")
    return j.agg(F.count("b").alias("before"), F.count("a").alias("after"), F.count_if(F.col("b").isNull()).alias("added"), F.count_if(F.col("a").isNull()).alias("dropped"))
