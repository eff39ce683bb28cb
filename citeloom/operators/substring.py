"""Substring search by an index of short character sequences, in place of a scan of all texts for every needle."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

#: Length of the indexed sequences, how many of a needle's are looked up (the rarest), and up to how many looked up at once are pushed to the scan.
LENGTH, LOOKED_UP, PUSHED = 3, 4, 1000
#: Rows whose sequences one task makes, some 100 each and 100 bytes of memory for one.
ROWS = 50_000


def grams(text: Column, shorter: bool) -> Column:
    """The distinct sequences of LENGTH characters of a text, and all shorter ones if asked for, of its lower-case form."""
    low = F.lower(F.coalesce(text.cast("string"), F.lit("")))
    of = lambda n: F.transform(F.when(F.length(low) >= n, F.sequence(F.lit(1), F.length(low) - n + 1)).otherwise(F.array().cast("array<int>")), lambda i: F.substr(low, i, F.lit(n)))
    return F.array_distinct(F.concat(*[of(n) for n in range(1 if shorter else LENGTH, LENGTH + 1)]))


def dealt(rows: DataFrame, key: str, columns: list[str]) -> DataFrame:
    """The columns of rows with a key, under key and t0, t1, ..., in tasks of about ROWS rows, at least as many as cores."""
    own = rows.where(F.col(key).isNotNull()).select(F.col(key).alias("key"), *[F.col(c).alias(f"t{i}") for i, c in enumerate(columns)])
    return own.repartition(max(own.sparkSession.sparkContext.defaultParallelism, -(-own.count() // ROWS)), "key")


def build(rows: DataFrame, key: str, columns: list[str], root: str) -> None:
    """Write the index of some columns of rows under root: postings (gram, key), dealt by ranges of gram and sorted, and counts (gram, n).

    Sequences shorter than LENGTH are indexed too, so short needles are one look-up. A row is posted once for a sequence, in whichever
    columns it occurs; rows without key are left out. A frequent sequence's postings may fill several files.
    """
    own = dealt(rows, key, columns)  # by key, so distinct needs no other shuffle
    each = own.select("key", F.explode(F.array_distinct(F.concat(*[grams(F.col(f"t{i}"), True) for i in range(len(columns))]))).alias("gram")).distinct()
    each.repartitionByRange("gram", "key").sortWithinPartitions("gram", "key").write.parquet(f"{root}/postings")
    rows.sparkSession.read.parquet(f"{root}/postings").groupBy("gram").agg(F.count(F.lit(1)).alias("n")).write.parquet(f"{root}/counts")


def find(spark: SparkSession, root: str, rows: DataFrame, key: str, columns: list[str], needles: DataFrame, needle: str = "needle") -> DataFrame:
    """(needle, key): rows one of whose columns holds the needle, letter case aside; % and _ are characters like others.

    Of each needle the LOOKED_UP rarest sequences are looked up; rows that hold them all are candidates and are checked against the
    texts. Few sequences (a page of searches) go to the scan as a filter, which skips the other ranges of the index; many are joined.
    The empty needle is in every row that has a text. Null needles find nothing. rows must be those of the index.
    """
    asked = needles.where(F.col(needle).isNotNull()).select(F.col(needle).alias("needle")).distinct()
    low = F.lower(F.col("needle"))
    counts = spark.read.parquet(f"{root}/counts")
    parts = asked.where("needle <> ''").select("needle", F.explode(F.when(F.length(low) < LENGTH, F.array(low)).otherwise(grams(F.col("needle"), False))).alias("gram"))
    rank = Window.partitionBy("needle").orderBy("n", "gram")
    looked = parts.join(counts, "gram", "left").withColumn("n", F.coalesce("n", F.lit(0))).withColumn("at", F.row_number().over(rank)).where(F.col("at") <= LOOKED_UP)
    looked = looked.select("needle", "gram", F.count(F.lit(1)).over(Window.partitionBy("needle")).alias("k"))
    postings = spark.read.parquet(f"{root}/postings")
    few = [r["gram"] for r in looked.select("gram").distinct().limit(PUSHED + 1).collect()]
    if len(few) <= PUSHED:
        postings, looked = postings.where(F.col("gram").isin(few)), F.broadcast(looked)
    # dealt by key first: a task that reads a frequent sequence's postings holds no counts of them
    near = postings.join(looked, "gram").repartition("key").groupBy("needle", "key", "k").agg(F.count(F.lit(1)).alias("n")).where("n = k").select("needle", "key")
    texts = rows.where(F.col(key).isNotNull()).select(F.col(key).alias("key"), *[F.lower(F.col(c).cast("string")).alias(f"t{i}") for i, c in enumerate(columns)])
    any_of = lambda test: F.greatest(*[F.coalesce(test(F.col(f"t{i}")), F.lit(False)) for i in range(len(columns))], F.lit(False))
    found = near.join(texts, "key").where(any_of(lambda t: F.contains(t, F.lower(F.col("needle"))))).select("needle", "key").distinct()
    if not asked.where("needle = ''").head(1):
        return found
    return found.unionByName(texts.where(any_of(lambda t: t.isNotNull())).select(F.lit("").alias("needle"), "key").distinct())
