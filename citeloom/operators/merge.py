"""Keeping snapshots: guarded loads, additive merges, owned-column upserts, change detection."""

from __future__ import annotations

import uuid

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.designation import citation_digits, parts_of
from ..functions.text import from_register_portal, item_category, labelled_field
from ..session import Scratch


def shrink_guard(previous: DataFrame, now: DataFrame, share: float = 0.8, allow: bool = False) -> DataFrame:
    """(name, rows_before, rows_now, accepted) from tables (name, n): an empty table, or one below `share` of before, is refused."""
    j = now.select("name", F.col("n").alias("rows_now")).join(previous.select("name", F.col("n").alias("rows_before")), "name", "left")
    ok = (F.col("rows_now") > 0) & (F.lit(allow) | F.col("rows_before").isNull() | (F.col("rows_now") >= share * F.col("rows_before")))
    return j.select("name", "rows_before", "rows_now", ok.alias("accepted"))


def load_guarded(tables: dict[str, DataFrame], root: str, share: float = 0.8, allow: bool = False) -> DataFrame:
    """Write all tables under root if the guard accepts each of them, and their sizes to root/_sizes; the guard's verdicts.

    If one is refused nothing is written, and the sizes of the last accepted load stay. A new load goes to folders of its
    own, and the sizes, written last, name them, so a load that dies half-way leaves the last one in place.
    """
    spark = next(iter(tables.values())).sparkSession
    sizes = "name string, n long, path string"
    scratch = Scratch(spark, "load")
    held = {k: scratch.write(df, k) for k, df in tables.items()}
    try:
        last = spark.read.schema(sizes).json(f"{root}/_sizes").collect()  # one row a table
    except AnalysisException as x:
        if x.getCondition() != "PATH_NOT_FOUND":
            raise
        last = []
    now = spark.createDataFrame([(k, df.count()) for k, (df, _) in held.items()], "name string, n long")
    verdicts = shrink_guard(spark.createDataFrame([(r["name"], r["n"]) for r in last], "name string, n long"), now, share, allow)
    rows = verdicts.collect()  # one row a table
    if all(r["accepted"] for r in rows):
        load = uuid.uuid4().hex
        for k, (df, _) in held.items():
            df.write.parquet(f"{root}/{load}/{k}")
        state = [(r["name"], r["rows_now"], f"{root}/{load}/{r['name']}") for r in rows]
        spark.createDataFrame(state, sizes).coalesce(1).write.mode("overwrite").json(f"{root}/_sizes")
    scratch.drop(scratch.root)
    return spark.createDataFrame(rows, verdicts.schema)


def loaded(spark: SparkSession, root: str, name: str) -> DataFrame:
    """A table of the last accepted load."""
    path = spark.read.schema("name string, n long, path string").json(f"{root}/_sizes").where(F.col("name") == name).first()["path"]
    return spark.read.parquet(path)


def additive_merge(held: DataFrame, collected: DataFrame, keys: list[str], order: str) -> DataFrame:
    """held plus the collected rows whose keys it has none of; of several with one first key the first by order."""
    new = collected
    for k in keys:
        new = new.join(held.select(k).where(F.col(k).isNotNull()).distinct(), k, "left_anti")
    w = Window.partitionBy(keys[0]).orderBy(order)
    new = new.withColumn("_n", F.row_number().over(w)).where("_n = 1").drop("_n")
    return held.unionByName(new.select(*held.columns))


def owned_upsert(master: DataFrame, new: DataFrame, key: str, owned: list[str]) -> DataFrame:
    """master with its owned columns taken from new, where new has the row and the column; others stay untouched."""
    cols = [c for c in owned if c in new.columns and c in master.columns]
    n = new.select(F.col(key).alias("_key"), F.struct(*cols).alias("_new"))
    j = master.join(n, master[key] == n._key, "left")
    return j.select(*[F.when(F.col("_key").isNotNull(), F.col("_new")[c]).otherwise(F.col(c)).alias(c) if c in cols else F.col(c) for c in master.columns])


def change_counts(master: DataFrame, new: DataFrame, key: str, owned: list[str]) -> DataFrame:
    """(column, changed): rows whose value an upsert changes, null-safe."""
    cols = [c for c in owned if c in new.columns and c in master.columns]
    m, n = master.select(key, *[F.col(c).alias(f"m_{c}") for c in cols]), new.select(key, *[F.col(c).alias(f"n_{c}") for c in cols])
    sums = m.join(n, key).agg(*[F.count_if(~F.col(f"m_{c}").eqNullSafe(F.col(f"n_{c}"))).alias(c) for c in cols])
    return sums.select(F.explode(F.map_from_entries(F.array(*[F.struct(F.lit(c).alias("k"), F.col(c).alias("v")) for c in cols]))).alias("column", "changed"))


def amendments(held: DataFrame, portal: DataFrame) -> DataFrame:
    """(is_number, field, held, portal): one difference of each entry, status before year.

    Entries match by bare number and part numbers; a record of another part is no amendment.
    held: is_number, status, year; portal: portal_number, status, year.
    """
    h = held.select("is_number", F.col("status").alias("hs"), F.col("year").alias("hy"), citation_digits(F.col("is_number")).alias("d"), F.array_join(parts_of(F.col("is_number")), "/").alias("p"))
    q = portal.select("portal_number", F.col("status").alias("ps"), F.col("year").alias("py"), citation_digits(F.col("portal_number")).alias("d"), F.array_join(parts_of(F.col("portal_number")), "/").alias("p"))
    j = h.join(q, ["d", "p"]).where("d <> ''")
    status, year = F.col("hs") != F.col("ps"), F.col("py").isNotNull() & ~F.col("hy").eqNullSafe(F.col("py"))
    j = j.where(F.coalesce(status, F.lit(False)) | year)
    by = F.coalesce(status, F.lit(False))
    return j.select("is_number", F.when(by, "Status").otherwise("Year").alias("field"), F.when(by, F.col("hs")).otherwise(F.col("hy").cast("string")).alias("held"), F.when(by, F.col("ps")).otherwise(F.col("py").cast("string")).alias("portal"))


def match_counts(held: DataFrame, portal: DataFrame) -> DataFrame:
    """One row: portal records, those that match a held entry by number and parts, those of a held number but another part, and
    those of no held number. held: is_number; portal: portal_number."""
    parts = lambda c: F.array_join(parts_of(F.col(c)), "/")
    h = held.select(citation_digits(F.col("is_number")).alias("d"), parts("is_number").alias("p")).where("d <> ''")
    q = portal.select(citation_digits(F.col("portal_number")).alias("d"), parts("portal_number").alias("p"))
    q = q.join(h.distinct().withColumn("same", F.lit(True)), ["d", "p"], "left").join(h.select("d").distinct().withColumn("known", F.lit(True)), "d", "left")
    same, known = F.col("same").isNotNull(), F.col("known").isNotNull()
    return q.agg(F.count(F.lit(1)).alias("records"), F.count_if(same).alias("matched"), F.count_if(~same & known).alias("mismatched"), F.count_if(~known).alias("unknown"))


def to_check(register: DataFrame, prefix: str) -> DataFrame:
    """Register rows that a portal sweep has to check: all but those that came from the portal itself."""
    return register.where(from_register_portal(F.col("provenance"), prefix))


def rederive(documents: DataFrame, forms: DataFrame, labels: dict[str, str], key: str = "doc_id") -> DataFrame:
    """documents with category and the labelled columns read anew from saved forms (key, text), where the form has them.

    A category that the form lacks stays; labelled columns are replaced wherever a form was read, as a blank there is known
    to be one. Documents without a form are untouched.
    """
    f = forms.select(F.col(key).alias("_key"), F.nullif(item_category(F.col("text")), F.lit("")).alias("_category"), *[labelled_field(F.col("text"), label).alias(f"_{c}") for c, label in labels.items()])
    j = documents.join(f, documents[key] == f._key, "left")
    new = {"category": F.coalesce("_category", "category")} | {c: F.when(F.col("_key").isNotNull(), F.col(f"_{c}")).otherwise(F.col(c)) for c in labels}
    return j.select(*[new[c].alias(c) if c in new else F.col(c) for c in documents.columns])


def apply_amendments(register: DataFrame, diffs: DataFrame, stamp: str) -> DataFrame:
    """register with the amended status or year, and provenance stamped where something changed."""
    pick = lambda f: F.max(F.when(F.col("field") == f, F.col("portal")))
    d = diffs.groupBy(F.col("is_number").alias("_k")).agg(pick("Status").alias("_s"), pick("Year").alias("_y"))
    j = register.join(d, register.is_number == d._k, "left")
    new = {"status": F.coalesce("_s", "status"), "year": F.coalesce(F.col("_y").cast("int"), "year"), "provenance": F.when(F.col("_k").isNotNull(), F.lit(stamp)).otherwise(F.col("provenance"))}
    return j.select(*[new[c].alias(c) if c in new else F.col(c) for c in register.columns])


def review_dates(register: DataFrame, dates: DataFrame, today: str) -> DataFrame:
    """register with review_due from dates and overdue (Yes or No) against today; null where no date is known."""
    d = dates.select("is_number", F.col("review_due").cast("date").alias("review_due"))
    return register.drop("review_due", "overdue").join(d, "is_number", "left").withColumn("overdue", F.when(F.col("review_due") < F.lit(today).cast("date"), "Yes").when(F.col("review_due").isNotNull(), "No"))


def symmetric_difference(a: DataFrame, b: DataFrame) -> DataFrame:
    """Rows of one side only, with side: the proof of equality is an empty result."""
    return a.exceptAll(b).withColumn("side", F.lit("only_a")).unionByName(b.exceptAll(a).withColumn("side", F.lit("only_b")))


def majority(rows: DataFrame, key: str, value: str, order: str) -> DataFrame:
    """(key, value, votes): the most frequent value of each key, on ties the one seen first."""
    g = rows.where(F.col(value).isNotNull()).groupBy(key, value).agg(F.count(F.lit(1)).alias("votes"), F.min(order).alias("_first"))
    w = Window.partitionBy(key).orderBy(F.desc("votes"), "_first")
    return g.withColumn("_n", F.row_number().over(w)).where("_n = 1").select(key, value, "votes")
