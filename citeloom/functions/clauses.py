"""Clauses: composition from facts, guards over phrased text, protected spans, the translation cache's keys."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
import pyarrow.compute
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import Scratch
from .text import demands_mark, leaked_designations

# Wording that a phrased clause must not have, and spans that a translation must not touch.
REFUSAL = r"(?i)^\s*(i (cannot|can't|am unable)|as an ai|sorry|here is|here's|certainly|sure[,.])"
PERSON = r"(?i)\b(supplier|purchaser|contractor|bidder|tenderer|vendor|department|employer)s?\b[^.]{0,60}?\b(?:shall|must|is\s+required\s+to|are\s+required\s+to)\s+(?:also\s+)?(?:comply|conform|adhere|ensure|review|refer|verify|check)"
PERMISSIVE = r"(?i)\bnot\s+(?:strictly\s+)?(?:mandatory|compulsory|required|obligatory|binding)\b|\bnon-?mandatory\b|\bmerely\s+advisory\b|\bfor\s+reference\s+only\b|\bdiscretion\b|\boptional\b|\bwhere\s+deemed\s+(?:necessary|appropriate)\b|\bfor\s+reference\b|\bguidance\s+only\b|\bwherever\s+applicable\b|\bencouraged\s+to\b|\bindustry\s+practice\b|\bneed\s+not\s+(?:be|comply)\b"
PROTECTED = r"(?i)\bIS[:\s/]*\d{2,}(?:\s*\([^)]{0,40}\))?|\bIS/IEC\s*\d{2,}|\d+(?:\.\d+)?\s*(?:kV|V|kW|W|mm|mm2|sqmm|A|Hz|K)\b|\bIP\s?\d{2}\b"
# Reason codes of the guards, in the order in which one is reported, and statuses that need a caution.
REASONS = ("empty_response", "not_a_clause", "obligation_on_person_not_goods", "invented_certification_duty", "dropped_certification_duty", "unsupported_permissive_claim", "subset_guard_failed", "governing_standard_missing")
UNSAFE = ("Superseded", "Withdrawn")
#: Standards that a clause names beside the governing one.
BESIDE = 4

#: The sentences of a clause, in order: what it states, and its wording over the facts of `_facts`. A sentence whose
#: condition fails, or one of whose facts is null, is left out.
SENTENCES = (
    ("conformity", None, "All %s delivered must meet %s (%s).", ("goods", "edition", "title")),
    ("companions", "beside", "Documents for similar goods often name %s as well; whether each applies is to be decided for this purchase.", ("beside",)),
    ("certification", "certified", "Certification is compulsory under %s, so goods without a valid Standard Mark will be refused.", ("scheme",)),
    ("caution", "unsafe", "The register lists %s as %s: confirm its standing before this text is published.", ("number", "status")),
)


def _facts(number: Column, title: Column, family: Column, year: Column, status: Column, related: Column, mandatory: Column, scheme: Column) -> dict[str, Column]:
    """What the sentences speak of, as text, and their conditions."""
    goods = F.coalesce(family, F.lit("material"))
    acronym = goods.rlike(r"^.\p{Lu}")  # LED lighting keeps its capitals
    companions = F.array_join(F.slice(related, 1, BESIDE), ", ")
    return {
        "number": number,
        "goods": F.when(acronym, goods).otherwise(F.concat(F.lower(F.left(goods, F.lit(1))), F.substr(goods, F.lit(2)))),
        "edition": F.concat_ws(" : ", number, year.cast("string")),
        "title": F.coalesce(title, F.lit("untitled")),
        "status": status,
        "beside": F.nullif(companions, F.lit("")),
        "scheme": F.coalesce(scheme, F.lit("the scheme on file")),
        "certified": mandatory == "Yes",
        "unsafe": status.isin(*UNSAFE),
    }


def sentences(number: Column, title: Column, family: Column, year: Column, status: Column, related: Column, mandatory: Column, scheme: Column) -> Column:
    """array<struct<about, text>>: the sentences of a specification clause that the register's fields call for."""
    facts = _facts(number, title, family, year, status, related, mandatory, scheme)
    rows = []
    for about, condition, wording, used in SENTENCES:
        ready = F.lit(True) if condition is None or condition in used else F.coalesce(facts[condition], F.lit(False))
        for name in used:
            ready = ready & facts[name].isNotNull()
        rows.append(F.when(ready, F.struct(F.lit(about).alias("about"), F.format_string(wording, *[facts[x] for x in used]).alias("text"))))
    return F.array_compact(F.array(*rows))


def clause(number: Column, title: Column, family: Column, year: Column, status: Column, related: Column, mandatory: Column, scheme: Column) -> Column:
    """The sentences as one text."""
    made = sentences(number, title, family, year, status, related, mandatory, scheme)
    return F.array_join(F.transform(made, lambda x: x["text"]), " ")


def broken_rules(text: Column, governing: Column, allowed: Column, mandatory: Column, years: Column | None = None) -> Column:
    """array<string>: every guard that a phrased clause breaks, each judged by itself, in the order of REASONS."""
    said = F.trim(F.coalesce(text, F.lit("")))
    duty, asked = F.coalesce(mandatory == "Yes", F.lit(False)), demands_mark(said)
    broken = {
        "empty_response": said == "",
        "not_a_clause": said.rlike(REFUSAL),
        "obligation_on_person_not_goods": said.rlike(PERSON),
        "unsupported_permissive_claim": said.rlike(PERMISSIVE),
        "invented_certification_duty": asked & ~duty,
        "dropped_certification_duty": duty & ~asked,
        "governing_standard_missing": ~F.contains(said, F.trim(F.substring_index(governing, "(", 1))),
        "subset_guard_failed": F.size(leaked_designations(said, allowed, years)) > 0,
    }
    return F.array_compact(F.array(*[F.when(F.coalesce(broken[r], F.lit(False)), F.lit(r)) for r in REASONS]))


def phrasing_problem(text: Column, governing: Column, allowed: Column, mandatory: Column, years: Column | None = None) -> Column:
    """Why a phrased clause can't be used, by the first of REASONS; null if it can."""
    return F.try_element_at(broken_rules(text, governing, allowed, mandatory, years), F.lit(1))


def protected_spans(text: Column) -> Column:
    return F.regexp_extract_all(text, F.lit(PROTECTED), F.lit(0))


def masked(text: Column) -> Column:
    """The text with its protected spans as opaque tokens Z0Z, Z1Z ..., in order."""
    parts, spans = F.split(text, PROTECTED), protected_spans(text)
    return F.array_join(F.transform(parts, lambda p, i: F.when(i < F.size(spans), F.concat(p, F.lit(" Z"), i.cast("string"), F.lit("Z "))).otherwise(p)), "")


def restored(text: Column, spans: Column) -> Column:
    """Masked text, translated or not, with the spans back in place and single blanks."""
    pairs = F.transform(spans, lambda s, i: F.struct(s.alias("s"), i.alias("i")))
    back = F.aggregate(pairs, text, lambda acc, p: F.regexp_replace(acc, F.concat(F.lit(r"(?i)\s*Z\s*"), p["i"].cast("string"), F.lit(r"\s*Z\s*")), F.concat(F.lit(" "), p["s"], F.lit(" "))))
    return F.trim(F.regexp_replace(back, r"\s{2,}", " "))


def from_cache(texts: DataFrame, cache: DataFrame, text: str = "text", language: str = "language") -> DataFrame:
    """texts with translation from a cache (text, language, translation); null is what still has to be translated."""
    return texts.join(cache.select(text, language, "translation"), [text, language], "left")


#: Texts that a translator gets at once.
TOGETHER = 400


def translated(texts: DataFrame, cache: DataFrame, translate: Callable[[list[str], str], list[str]], text: str = "text", language: str = "language") -> tuple[DataFrame, DataFrame]:
    """texts with translation, and the rows (text, language, translation) that were not in the cache, to be appended to it.

    Each missing text goes once to translate(texts, language), up to TOGETHER of one language at a time, in the tasks, with its
    designations and quantities masked; they are put back afterwards. A call that fails leaves its texts without translation and out of
    the cache, so a later run asks again. Of repeated cache rows the least counts; null texts stay untranslated.
    """
    held = cache.groupBy(text, language).agg(F.min("translation").alias("translation"))
    open_ = from_cache(texts.select(text, language).where(F.col(text).isNotNull() & F.col(language).isNotNull()).distinct(), held, text, language).where("translation IS NULL")
    asked = open_.select(F.col(text).alias("t"), F.col(language).alias("l"), masked(F.col(text)).alias("m"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            table = pa.Table.from_batches([batch])
            for name in table.column("l").unique().to_pylist():
                own = table.filter(pa.compute.equal(table.column("l"), name))
                for at in range(0, own.num_rows, TOGETHER):
                    part = own.slice(at, TOGETHER)
                    try:
                        said = list(translate(part.column("m").to_pylist(), name))
                    except Exception:  # asked again by a later run
                        continue
                    if len(said) == part.num_rows:
                        yield from part.append_column("s", pa.array(said, pa.string())).to_batches()

    fresh = asked.mapInArrow(run, "t string, l string, m string, s string").where("s IS NOT NULL")
    fresh = fresh.select(F.col("t").alias(text), F.col("l").alias(language), restored(F.col("s"), protected_spans(F.col("t"))).alias("translation"))
    fresh = Scratch(texts.sparkSession, "translations").keep(fresh, "fresh")
    return from_cache(texts, held.unionByName(fresh), text, language), fresh
