"""License scan: ordered signature rules behind a keyword prefilter, with suppression by priority and containment. Column functions only."""

from __future__ import annotations

import json

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .batches import quoted
from .license_rules import CERTAINTY, KEYWORDS, LABELS, RULES, any_keyword

#: Phrases whose places are counted exactly, and their labels.
PHRASES = {"cc by": "cc-by", "general public license": "gpl", "all rights reserved": "reserved"}
#: Characters that are in no word, after and before A-Z are lower-cased.
_BETWEEN, _BEFORE = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]", r"[\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]"
_BEGIN, _END = "\x01", "\x02"


def _blanks(c: Column) -> Column:
    return F.octet_length(c) - F.octet_length(F.replace(c, F.lit(" "), F.lit("")))


def normalised(text: Column) -> Column:
    """The words of a text, A-Z in lower case, with one blank before, between and after them.

    lower() changes other letters too, but only İ and the Kelvin sign to something with ASCII letters; these two are replaced before, so
    that a word's letters between a and z are those that the text has in either case.
    """
    low = F.lower(F.regexp_replace(F.coalesce(text, F.lit("")), "[İK]", "ı"))
    return F.concat(F.lit(" "), F.trim(F.regexp_replace(low, _BETWEEN + "+", " ")), F.lit(" "))


def _constant(rows: list, schema: str) -> Column:
    return F.from_json(F.lit(json.dumps(rows)), schema)


def _pattern(rule: Column) -> Column:
    return F.concat(F.lit(" ("), rule["pattern"], F.lit(")(?= )"))


def _detections(words: Column, rules: Column) -> Column:
    """All matches of the rules as structs (start, back, level, rule, label): first word, minus the word after the last one.

    Each match gets a mark on its first and its last word; the places of the marks among the words are the interval, so the work is
    linear in the text for each rule whose keyword the text holds.
    """

    def of(r: Column) -> Column:
        marked = F.split(F.regexp_replace(words, _pattern(r), F.lit(f" {_BEGIN}$1{_END}")), " ", -1)
        places = lambda has, row: F.filter(F.transform(marked, lambda w, i: F.when(has(w), row(i))), lambda x: x.isNotNull())
        starts = places(lambda w: F.startswith(w, F.lit(_BEGIN)), lambda i: i - 1)  # a blank before the first word makes an empty one
        ends = places(lambda w: F.endswith(w, F.lit(_END)), lambda i: i)
        return F.transform(F.arrays_zip(starts.alias("s"), ends.alias("e")), lambda x: F.struct(x["s"].alias("start"), (-x["e"]).alias("back"), r["level"].alias("level"), r["rule"].alias("rule"), r["label"].alias("label")))

    return F.flatten(F.transform(rules, of))


def _kept(detections: Column) -> Column:
    """(counts, best): how many detections of each label stay, by the label's number, and the best level of those.

    A detection goes if one that ranks before it holds its whole interval: one of a better level, or of the same level that is longer or,
    for the same words, whose rule stands first. In the order (start, longest first, level, rule) such a one always comes before it, so
    one pass suffices, with the farthest end so far of each level and those better.
    """
    levels = len(CERTAINTY)
    start = F.struct(F.array_repeat(F.lit(-1), levels).alias("ends"), F.array_repeat(F.lit(0), len(LABELS)).alias("counts"), F.lit(levels + 1).alias("best"))

    def step(state: Column, d: Column) -> Column:
        end = -d["back"]
        gone = F.element_at(state["ends"], d["level"]) >= end
        ends = F.transform(state["ends"], lambda e, i: F.when((i + 1 >= d["level"]) & (e < end), end).otherwise(e))
        counts = F.when(gone, state["counts"]).otherwise(F.transform(state["counts"], lambda n, i: F.when(i == d["label"], n + 1).otherwise(n)))
        best = F.when(gone, state["best"]).otherwise(F.least(state["best"], d["level"]))
        return F.struct(ends.alias("ends"), counts.alias("counts"), best.alias("best"))

    return F.aggregate(F.array_sort(detections), start, step, lambda s: F.struct(s["counts"].alias("counts"), s["best"].alias("best")))


def scan(docs: DataFrame, text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """(doc_id, n_words, n_base, first_word, last_word, base_labels, labels, score, found) of every row of docs.

    n_base counts the places of PHRASES, first_word and last_word are their first and last start; base_labels their labels. found is
    an array of (label, places) of the rules' detections that stay (see `_kept`); labels joins both, and score is the certainty
    of the best level that stays (0 without any; a base phrase alone counts as a named license without version).

    A rule is tried only on texts that hold its keyword; texts that hold none, nearly all, are passed over by one pattern of all keywords
    before their words are made. Everything is a column of one projection: nothing
    is shuffled or leaves the JVM, and a row's memory is a few times its text. Null and empty texts, and those without a word, have
    zeros, null places and empty labels; repeated rows are repeated; other columns are ignored.
    """
    rules = _constant([{"level": r.level, "rule": i, "label": LABELS.index(r.label), "keyword": r.keyword, "pattern": r.pattern} for i, r in enumerate(RULES)], "array<struct<level int, rule int, label int, keyword string, pattern string>>")
    own = F.col(quoted(text))
    edge = lambda c: F.when(F.regexp_like(c, F.lit(_BEFORE)), 1).otherwise(0)
    # a text that begins or ends between words has an empty part there
    n_words = F.when(F.length(own) > 0, F.size(F.split(own, _BEFORE + "+", -1)) - edge(F.left(own, F.lit(1))) - edge(F.right(own, F.lit(1)))).otherwise(0).cast("long")
    rows = docs.select(F.col(quoted(doc_id)).alias(doc_id), n_words.alias("n_words"), F.when(F.regexp_like(own, F.lit(any_keyword(_BEFORE))), normalised(own)).alias("_words"))
    words = F.col("_words")
    present = F.filter(_constant(KEYWORDS, "array<string>"), lambda k: F.contains(words, F.concat(F.lit(" "), k)))
    places = lambda p: F.when(words.contains(f" {p} "), F.regexp_count(words, F.lit(f" {p}(?= )"))).otherwise(0)
    rows = rows.select(doc_id, "_words", "n_words", F.when(words.isNotNull(), present).alias("_present"), *[places(p).cast("long").alias(f"_n{i}") for i, p in enumerate(PHRASES)])
    tried = F.filter(rules, lambda r: F.array_contains(F.col("_present"), r["keyword"]) & F.regexp_like(words, _pattern(r)))
    first = [F.when(F.col(f"_n{i}") > 0, _blanks(F.substring_index(words, f" {p} ", 1)).cast("long")) for i, p in enumerate(PHRASES)]
    last = [F.when(F.col(f"_n{i}") > 0, F.col("n_words") - len(p.split()) - _blanks(F.substring_index(words, f" {p} ", -1))) for i, p in enumerate(PHRASES)]
    base = F.array_compact(F.array(*[F.when(F.col(f"_n{i}") > 0, F.lit(label)) for i, label in enumerate(PHRASES.values())]))
    rows = rows.select(
        doc_id,
        "n_words",
        sum((F.col(f"_n{i}") for i in range(1, len(PHRASES))), F.col("_n0")).alias("n_base"),
        F.least(*first).alias("first_word"),
        F.greatest(*last).alias("last_word"),
        base.alias("_base"),
        F.when(F.size("_present") > 0, _kept(_detections(words, tried))).alias("_kept"),
    )
    named = F.arrays_zip(_constant(LABELS, "array<string>").alias("label"), F.coalesce(F.col("_kept.counts"), F.array()).alias("places"))  # not looked up in a lambda, which would count again for each label
    rows = rows.select("*", F.filter(named, lambda x: x["places"] > 0).alias("found"))
    certain = _constant({str(i): c for i, c in CERTAINTY.items()}, "map<string, double>")
    score = F.greatest(F.coalesce(certain[F.col("_kept.best").cast("string")], F.lit(0.0)), F.when(F.size("_base") > 0, CERTAINTY[3]).otherwise(0.0))
    labels = F.array_sort(F.array_union("_base", F.transform("found", lambda x: x["label"])))
    joined = lambda a: F.array_join(a, ",")
    return rows.select(doc_id, "n_words", "n_base", "first_word", "last_word", joined(F.array_sort("_base")).alias("base_labels"), joined(labels).alias("labels"), score.alias("score"), "found")


def detections(docs: DataFrame, text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """(doc_id, label, level, rule, start, end): the detections behind `scan`'s labels, a row each: words start to end (exclusive) of
    the text, and the rule's number in RULES. Repeated rows give their detections each; texts without any give no rows.

    Suppression is the same as in `_kept`, here as running maxima over a text's detections in order, so a text with very many is
    sorted and spilled as rows are.
    """
    rules = _constant([{"level": r.level, "rule": i, "label": LABELS.index(r.label), "keyword": r.keyword, "pattern": r.pattern} for i, r in enumerate(RULES)], "array<struct<level int, rule int, label int, keyword string, pattern string>>")
    own, words = F.col(quoted(text)), F.col("_words")
    rows = docs.where(F.regexp_like(own, F.lit(any_keyword(_BEFORE)))).select(F.col(quoted(doc_id)).alias(doc_id), F.monotonically_increasing_id().alias("_row"), normalised(own).alias("_words"))
    present = F.filter(_constant(KEYWORDS, "array<string>"), lambda k: F.contains(words, F.concat(F.lit(" "), k)))
    rows = rows.select(doc_id, "_row", "_words", present.alias("_present"))
    tried = F.filter(rules, lambda r: F.array_contains(F.col("_present"), r["keyword"]) & F.regexp_like(words, _pattern(r)))
    each = rows.select(doc_id, "_row", F.explode(_detections(words, tried)).alias("d"))
    before = Window.partitionBy("_row").orderBy("d.start", "d.back", "d.level", "d.rule").rowsBetween(Window.unboundedPreceding, -1)
    far = F.array(*[F.max(F.when(F.col("d.level") <= level, -F.col("d.back"))).over(before) for level in sorted(CERTAINTY)])
    each = each.withColumn("_far", F.element_at(far, F.col("d.level")))
    names = _constant(LABELS, "array<string>")
    each = each.where(F.col("_far").isNull() | (F.col("_far") < -F.col("d.back")))
    return each.select(doc_id, F.element_at(names, F.col("d.label") + 1).alias("label"), "d.level", "d.rule", "d.start", (-F.col("d.back")).alias("end"))
