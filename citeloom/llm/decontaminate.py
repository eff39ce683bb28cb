"""Benchmark decontamination by template windows with typed placeholders and a slot consistency check."""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import Scratch
from .batches import bounds, quoted, runs

#: Template tokens of a window, and of the least stretch that counts (a shorter benchmark text must be there whole).
WINDOW, STRETCH = 8, 12
#: Template tokens of the least part that counts of a stretch whose slots contradict each other. A part as short as STRETCH may be
#: the common frame of a question about someone or something else.
PART = 24
#: Bytes of benchmark text of an index in memory.
BLOCK = 16 << 20
#: Bytes of a document that are taken in at once. Pieces overlap by a quarter and meet at a blank, so a stretch of up to that length
#: is whole in one of them; a longer one is found by its parts.
PIECE = 4 << 20
#: Bits of the filter's positions: windows whose hash has no bit there are in no benchmark text and aren't brought to the join.
FILTER = 26

# Words taken as numbers and as units.
NUMBER_WORDS = "zero one two three four five six seven eight nine ten eleven twelve thirteen fourteen fifteen sixteen seventeen eighteen nineteen twenty thirty forty fifty sixty seventy eighty ninety hundred thousand million billion dozen half".split()
UNIT_WORDS = "mm cm m km inch inches foot feet yard yards mile miles mg g kg gram grams kilogram kilograms ton tons tonne tonnes lb lbs pound pounds ounce ounces ml l liter liters litre litres s sec second seconds min minute minutes h hour hours day days week weeks month months year years hz khz mhz ghz v kv volt volts w kw watt watts j kj joule joules degree degrees percent dollar dollars euro euros cent cents usd eur gbp meter meters metre metres".split()

_MULTIPLIER = np.uint64(0x9E3779B97F4A7C15)
_INVERSE = np.uint64(pow(0x9E3779B97F4A7C15, -1, 1 << 64))
_MIX = np.uint64(0xBF58476D1CE4E5B9)
NUM, NAME, UNIT = np.uint64(1), np.uint64(2), np.uint64(3)
_KIND = np.zeros(256, np.uint8)  # 1: part of a word; 2: digit, part of a word
_KIND[[b for b in range(256) if b >= 128 or chr(b).isalpha()]] = 1
_KIND[48:58] = 2
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_ENDS = np.zeros(256, bool)
_ENDS[[ord(c) for c in ".!?:\n"]] = True
_powers: dict[str, np.ndarray] = {}


def _power(n: int) -> tuple[np.ndarray, np.ndarray]:
    if not _powers or len(_powers["up"]) < n:
        size = max(n, 1 << 16)
        with np.errstate(over="ignore"):
            _powers["up"] = np.cumprod(np.concatenate((np.ones(1, np.uint64), np.full(size, _MULTIPLIER))))
            _powers["down"] = np.cumprod(np.concatenate((np.ones(1, np.uint64), np.full(size, _INVERSE))))
    return _powers["up"], _powers["down"]


@dataclass
class Tokens:
    """Template tokens of a text: hash (a placeholder's number for slots), value hash, slot flag, first and end byte."""

    token: np.ndarray
    value: np.ndarray
    slot: np.ndarray
    start: np.ndarray
    end: np.ndarray


def word_hashes(raw: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    up, down = _power(len(raw) + 1)
    total = np.concatenate((np.zeros(1, np.uint64), np.cumsum((raw.astype(np.uint64) + np.uint64(1)) * up[: len(raw)], dtype=np.uint64)))
    h = (total[end] - total[start]) * down[start]
    h = (h ^ (h >> np.uint64(29))) * _MIX
    return (h ^ (h >> np.uint64(32))) | np.uint64(16)


def _listed(words: list[str]) -> np.ndarray:
    return np.sort(np.array([word_hashes(b := np.frombuffer(w.encode(), np.uint8), np.zeros(1, np.int64), np.array([len(b)]))[0] for w in words]))


def _among(x: np.ndarray, known: np.ndarray) -> np.ndarray:
    if not len(known):
        return np.zeros(len(x), bool)
    return known[np.minimum(np.searchsorted(known, x), len(known) - 1)] == x


_NUMBERS, _UNITS = _listed(NUMBER_WORDS), _listed(UNIT_WORDS)


def canonical(text: bytes) -> Tokens:
    """Words of ASCII letters, digits and other scripts' bytes, lower-cased. Numbers, units after a number, and names
    (capitalised inside a sentence, but not all in capitals) become placeholders; neighbouring placeholders of a kind become one."""
    raw = np.frombuffer(text, np.uint8)
    kind = _KIND[raw]
    inside = np.concatenate(([False], kind > 0, [False]))
    edge = np.flatnonzero(inside[1:] != inside[:-1])
    start, end = edge[::2], edge[1::2]
    if not len(start):
        none = np.zeros(0, np.int64)
        return Tokens(none.astype(np.uint64), none.astype(np.uint64), none.astype(bool), none, none)
    low = _LOWER[raw]
    wide = np.flatnonzero((raw[1:] >= 0x80) & (raw[1:] <= 0x9E) & (raw[:-1] == 0xC3) & (raw[1:] != 0x97)) + 1
    low[wide] += 32
    value = word_hashes(low, start, end)
    digit = np.concatenate(([0], np.cumsum(kind == 2)))
    number = (digit[end] > digit[start]) | _among(value, _NUMBERS)
    upper = (raw >= 65) & (raw <= 90)
    upper[wide] = True
    uppers = np.concatenate(([0], np.cumsum(upper)))
    letters = np.concatenate(([0], np.cumsum((raw < 0x80) | (raw >= 0xC0))))
    lead = upper[start] | (upper[np.minimum(start + 1, len(raw) - 1)] & (raw[start] == 0xC3))
    capital = lead & (uppers[end] - uppers[start] == 1) & (letters[end] - letters[start] > 1)  # words all in capitals are words
    ends = np.concatenate(([0], np.cumsum(_ENDS[raw])))
    opens = np.concatenate(([True], ends[start[1:]] > ends[end[:-1]]))
    name = capital & ~opens & ~number
    before = np.concatenate(([False], number[:-1]))
    unit = before & ~number & ~name & _among(value, _UNITS)
    token = np.where(number, NUM, np.where(unit, UNIT, np.where(name, NAME, value)))
    slot = number | unit | name
    first = np.concatenate(([True], ~slot[1:] | (token[1:] != token[:-1])))
    if not first.all():
        at = np.flatnonzero(first)
        last = np.append(at[1:], len(first)) - 1
        value = np.where(last > at, word_hashes(low, start[at], end[last]), value[at])
        token, slot, start, end = token[at], slot[at], start[at], end[last]
    return Tokens(token, value, slot, start, end)


def windows(token: np.ndarray, n: int) -> np.ndarray:
    """Hash of each n neighbouring template tokens."""
    if len(token) < n:
        return np.zeros(0, np.uint64)
    h = np.zeros(len(token) - n + 1, np.uint64)
    for i in range(n):
        h = (h ^ token[i : len(token) - n + 1 + i]) * _MULTIPLIER
        h ^= h >> np.uint64(31)
    return h


@dataclass
class Index:
    """The same search over one text in memory: template windows of some benchmark texts, by length, with item and place."""

    items: list[tuple[int, Tokens]]
    tables: dict[int, tuple[np.ndarray, np.ndarray, np.ndarray]] = field(default_factory=dict)

    def __post_init__(self) -> None:
        made: dict[int, list] = defaultdict(list)
        for i, (_, t) in enumerate(self.items):
            n = min(WINDOW, len(t.token))
            if n:
                h = windows(t.token, n)
                made[n].append((h, np.full(len(h), i), np.arange(len(h))))
        for n, parts in made.items():
            h, item, place = (np.concatenate(x) for x in zip(*parts))
            order = np.argsort(h, kind="stable")
            self.tables[n] = (h[order], item[order], place[order])

    def find(self, doc: Tokens) -> dict[int, tuple[int, int]]:
        """item_id -> (tokens of the longest consistent stretch, slots in it whose values differ)."""
        found: dict[int, tuple[int, int]] = {}
        for n, (known, item, place) in self.tables.items():
            h = windows(doc.token, n)
            hit = np.flatnonzero(_among(h, known))
            if not len(hit):
                continue
            a, b = np.searchsorted(known, h[hit], "left"), np.searchsorted(known, h[hit], "right")
            at = np.repeat(hit, b - a)
            row = np.arange(len(at)) - np.repeat(np.cumsum(b - a) - (b - a), b - a) + np.repeat(a, b - a)
            who, shift = item[row], at - place[row]
            order = np.lexsort((at, shift, who))
            who, shift, at = who[order], shift[order], at[order]
            cut = np.flatnonzero((np.diff(who) != 0) | (np.diff(shift) != 0) | (np.diff(at) != 1)) + 1
            for i, j in zip(np.append(0, cut), np.append(cut, len(at))):
                item_id, t = self.items[who[i]]
                length, base = int(at[j - 1] - at[i]) + n, int(at[i] - shift[i])
                least = min(STRETCH, len(t.token))
                if length < least or length <= found.get(item_id, (0, 0))[0]:
                    continue
                best = _longest(t, base, doc, int(at[i]), length, max(least, found.get(item_id, (0, 0))[0] + 1))
                if best is not None:
                    found[item_id] = best
        return found


def _longest(item: Tokens, i: int, doc: Tokens, j: int, length: int, least: int) -> tuple[int, int] | None:
    """(tokens, changed slots) of the longest part of a stretch that agrees and has `least` tokens or more, or None.

    A part agrees if all its slots have the item's values; or if one value in the item is one value in the document and the
    other way round, and literal words are half or more. In a stretch with a contradiction a part has PART tokens at least. For each end the earliest consistent start is kept while the end
    moves on; only where words are too few in that part are later starts tried.
    """
    a, b = item.value[i : i + length], doc.value[j : j + length]
    slot = item.slot[i : i + length]
    differs = slot & (a != b)
    pairs = set(zip(a[slot].tolist(), b[slot].tolist()))
    if not len({x for x, _ in pairs}) == len(pairs) == len({y for _, y in pairs}):
        least = max(least, PART)
    best: tuple[int, int] | None = None

    def take(start: int, end: int) -> None:
        nonlocal best, least
        best, least = (end - start, int(differs[start:end].sum())), end - start + 1

    # verbatim parts lie between slots that differ
    cuts = np.concatenate(([-1], np.flatnonzero(differs), [length]))
    k = int(np.diff(cuts).argmax())
    if cuts[k + 1] - cuts[k] - 1 >= least:
        take(int(cuts[k]) + 1, int(cuts[k + 1]))
    # the last place at which a slot contradicts an earlier one bounds the start; balance is words less slots before each place
    balance = np.concatenate(([0], np.cumsum(np.where(slot, -1, 1))))
    low, last_x, last_y = 0, {}, {}
    slots = np.flatnonzero(slot).tolist()
    x_at, y_at = a.tolist(), b.tolist()
    for at, end in zip([*slots, None], [*slots, length]):
        # parts that end before this slot; ends between two slots only add words, so the latest is the best
        if end - low >= least:
            start = low + np.flatnonzero(balance[low : end - least + 1] <= balance[end])
            if len(start):
                take(int(start[0]), end)
        if at is None:
            break
        x, y = x_at[at], y_at[at]
        # all other pairs of x or of y must be left of the part
        for seen, key, value in ((last_x, x, y), (last_y, y, x)):
            known = seen.setdefault(key, {})
            low = max([low, *(p + 1 for other, p in known.items() if other != value)])
            seen[key] = {value: at}
    return best


def _pieces(text: bytes) -> Iterator[bytes]:
    """The text, or overlapping pieces of a very long one, cut at blanks."""
    overlap = PIECE // 4
    k = 0
    while True:
        end = len(text) if len(text) - k <= PIECE else max(text.rfind(b" ", k + PIECE // 2, k + PIECE), k + PIECE // 2)
        yield text[k:end]
        if end == len(text):
            return
        k = max(text.rfind(b" ", k, end - overlap), end - overlap)


def _find(index: Index, text: bytes) -> dict[int, tuple[int, int]]:
    found: dict[int, tuple[int, int]] = {}
    for piece in _pieces(text):
        for k, v in index.find(canonical(piece)).items():
            found[k] = max(found.get(k, (0, 0)), v)
    return found


def indexes(benchmark: DataFrame, text: str = "text", item_id: str = "item_id", block: int = BLOCK) -> Iterator[Index]:
    """Indexes of blocks of the benchmark, read row by row, each of at most `block` bytes of text or one text."""
    held: list[tuple[int, Tokens]] = []
    size = 0
    rows = benchmark.select(F.col(item_id).cast("long"), F.col(text).cast("binary")).where(F.length(text) > 0).distinct()
    for i, t in rows.orderBy(item_id).toLocalIterator():
        if held and size + len(t) > block:
            yield Index(held)
            held, size = [], 0
        held.append((i, canonical(bytes(t))))
        size += len(t)
    if held:
        yield Index(held)


def _item_windows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The template windows of benchmark texts (item_id, item, t) as rows."""
    for batch in batches:
        for i in range(batch.num_rows):
            tokens = canonical(batch.column(2)[i].as_py())
            n = min(WINDOW, len(tokens.token))
            if n:
                h = windows(tokens.token, n)
                at = np.arange(len(h))[:, None] + np.arange(n)
                slots = (tokens.slot[at] << np.arange(n)).sum(axis=1)
                yield _rows(batch.slice(i, 1), ["item_id", "item"], h, {"n": np.full(len(h), n, np.int32), "place": np.arange(len(h)), "total": np.full(len(h), len(tokens.token)), "slots": slots.astype(np.int64)}, tokens.value[at], "item_values")


def _rows(one: pa.RecordBatch, keep: list[str], h: np.ndarray, more: dict[str, np.ndarray], values: np.ndarray, name: str) -> pa.RecordBatch:
    """Rows of one text's windows: its columns repeated, the hash, other numbers, and the window's token values as bytes."""
    first = pa.array(np.zeros(len(h), np.int64))
    packed = pa.array([v.tobytes() for v in np.ascontiguousarray(values)], pa.binary())
    columns = [one.column(i).take(first) for i in range(len(keep))] + [pa.array(h.view(np.int64)), *map(pa.array, more.values()), packed]
    return pa.RecordBatch.from_arrays(columns, [*keep, "h", *more, name])


def _text_windows(bits: Broadcast, lengths: list[int]):
    """Rows of the documents' windows that pass the filter; batches are (doc_id, digest, t)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen = bits.value
        for batch in batches:
            for i in range(batch.num_rows):
                for piece, text in enumerate(_pieces(batch.column(2)[i].as_py())):
                    tokens = canonical(text)
                    for n in lengths:
                        h = windows(tokens.token, n)
                        bit = h >> np.uint64(64 - FILTER)
                        at = np.flatnonzero((seen[bit >> np.uint64(6)] >> (bit & np.uint64(63))) & np.uint64(1))
                        if len(at):
                            more = {"n": np.full(len(at), n, np.int32), "piece": np.full(len(at), piece, np.int32), "pos": at}
                            yield _rows(batch.slice(i, 1), ["doc_id", "digest"], h[at], more, tokens.value[at[:, None] + np.arange(n)], "doc_values")

    return run


def _filter(windows: DataFrame) -> np.ndarray:
    """A bitmap over the first FILTER bits of the windows' hashes; its size is fixed, whatever the benchmark's."""
    bit = windows.select(F.shiftrightunsigned("h", 64 - FILTER).alias("bit")).select(F.shiftright("bit", 6).alias("word"), F.expr("shiftleft(1L, cast(bit & 63 as int))").alias("mask"))
    words = bit.groupBy("word").agg(F.bit_or("mask").alias("mask")).toArrow()  # 2 ** (FILTER - 6) rows at most
    out = np.zeros(1 << (FILTER - 6), np.uint64)
    out[words.column("word").to_numpy()] = words.column("mask").to_numpy().view(np.uint64)
    return out


_SIDES = ["digest", "doc", "piece", "item"]


def _checked(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(doc_id, digest, item_id, n_tokens, n_changed) of the texts and items whose windows, which come sorted by text, item, shift and
    place, make a stretch that agrees."""
    for table in runs(batches, _SIDES):
        cuts = bounds(table, _SIDES)
        shift, pos, n, total, slots = (table.column(c).to_numpy() for c in ("shift", "pos", "n", "total", "slots"))
        sides = [table.column(c).to_pylist() for c in ("item_values", "doc_values")]
        breaks = np.flatnonzero(np.concatenate(([True], (np.diff(shift) != 0) | (np.diff(pos) != 1))))
        found: list[tuple[int, int, int]] = []
        for a, b in zip(cuts, cuts[1:]):
            best: tuple[int, int] | None = None
            starts = np.union1d(breaks[np.searchsorted(breaks, a) : np.searchsorted(breaks, b)], [a])
            for i, j in zip(starts, np.append(starts[1:], b)):
                width, least = int(n[i]), min(STRETCH, int(total[i]))
                length = int(j - i) - 1 + width
                least = max(least, best[0] + 1 if best else 0)
                if length < least:
                    continue
                item, doc = (_stretch(side[i:j], width) for side in sides)
                flags = np.concatenate((slots[i : j - 1] & 1, (slots[j - 1] >> np.arange(width)) & 1)).astype(bool)
                best = _longest(Tokens(item, item, flags, item, item), 0, Tokens(doc, doc, flags, doc, doc), 0, length, least) or best
            if best:
                found.append((int(a), *best))
        if found:
            rows, tokens, changed = zip(*found)
            some = table.select(["doc_id", "digest", "item_id"]).take(pa.array(rows)).combine_chunks().to_batches()
            yield from (pa.RecordBatch.from_arrays([*x.columns, pa.array(tokens, pa.int64()), pa.array(changed, pa.int64())], ["doc_id", "digest", "item_id", "n_tokens", "n_changed"]) for x in some)


def _stretch(values: list[bytes], width: int) -> np.ndarray:
    """Token values of neighbouring windows, without what they share."""
    whole = np.frombuffer(b"".join(values), np.uint64).reshape(-1, width)
    return np.concatenate((whole[:-1, 0], whole[-1]))


def _digest(text: Column) -> Column:
    return F.concat_ws("-", F.xxhash64(text), F.xxhash64(F.lit(1), text))


def contaminated_texts(docs: DataFrame, benchmark: DataFrame, text: str = "text", doc_id: str | None = "doc_id") -> DataFrame:
    """(doc_id, digest, item_id, n_tokens, n_changed): `contaminated` with each text's 128-bit digest; doc_id null where not asked for."""
    scratch, steps = Scratch(docs.sparkSession, "leaks"), Scratch(docs.sparkSession, "leaks-steps")
    items = benchmark.select(F.col("item_id").cast("long").alias("item_id"), F.col("text").cast("binary").alias("t")).where(F.length("t") > 0).distinct()
    items = items.select("item_id", F.xxhash64("item_id", "t").alias("item"), "t").mapInArrow(_item_windows, "item_id long, item long, h long, n int, place long, total long, slots long, item_values binary")
    items = steps.keep(items, "items")
    lengths = sorted(r["n"] for r in items.select("n").distinct().collect())  # WINDOW rows at most
    bits = docs.sparkSession.sparkContext.broadcast(_filter(items))
    who = F.col(quoted(doc_id)).cast("long") if doc_id else F.lit(None).cast("long")
    source = docs.select(who.alias("doc_id"), _digest(F.col(quoted(text))).alias("digest"), F.col(quoted(text)).cast("binary").alias("t")).where(F.length("t") > 0)
    seen = source.mapInArrow(_text_windows(bits, lengths), "doc_id long, digest string, h long, n int, piece int, pos long, doc_values binary")
    # copies of a text under one id are one text
    seen = seen.groupBy("doc_id", "digest", "piece", "n", "pos", "h").agg(F.first("doc_values").alias("doc_values"))
    met = seen.join(items, ["n", "h"]).withColumns({"doc": F.coalesce("doc_id", F.lit(-(1 << 63))), "shift": F.col("pos") - F.col("place")})
    met = met.repartition(*_SIDES).sortWithinPartitions(*_SIDES, "shift", "pos")
    met = met.select("doc_id", "digest", "doc", "piece", "item", "item_id", "shift", "pos", "n", "total", "slots", "item_values", "doc_values")
    found = scratch.keep(met.mapInArrow(_checked, "doc_id long, digest string, item_id long, n_tokens long, n_changed long"), "found")
    steps.drop()
    return found


def contaminated(docs: DataFrame, benchmark: DataFrame, text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """(doc_id, item_id, n_tokens, n_changed): which documents hold which benchmark texts, as they are or re-parameterised.

    A document holds an item if at least STRETCH template tokens in a row agree (all of a shorter item), and either all their
    slots have the item's values, or at least half are literal words and slots agree consistently: one value in the item
    is one value in the document and the other way round. n_tokens is the longest such stretch, n_changed the slots in it
    with another value; where a slot contradicts others, parts of PART tokens or more count.

    Both sides' windows of WINDOW template tokens (all of a shorter item) are rows, joined in Spark by their hash. A
    document's windows are rows only if they pass a filter of the benchmark's hashes, which drops none that match. Joined
    windows come together by text and item, neighbours on a diagonal make a stretch, and its slots are checked there. So
    nothing but the filter, of fixed size, is held by the driver or sent to all tasks, whatever the benchmark's size.

    Null and empty texts hold nothing; repeated documents give one row; a document with null id is reported with null.
    Empty tables give no rows.
    """
    best = F.max(F.struct("n_tokens", "n_changed"))
    found = contaminated_texts(docs, benchmark, text, doc_id)
    return found.groupBy("doc_id", "item_id").agg(best.alias("m")).select("doc_id", "item_id", "m.n_tokens", "m.n_changed")


def decontaminate(docs: DataFrame, benchmark: DataFrame, text: str = "text") -> DataFrame:
    """docs without the rows whose text holds a benchmark text, as `contaminated` decides. Columns and repeated rows stay."""
    own = "_leak"
    while own in [c.lower() for c in docs.columns]:
        own += "_"
    leaks = contaminated_texts(docs, benchmark, text, None).select(F.col("digest").alias(own)).distinct()
    return docs.join(leaks, _digest(F.col(quoted(text))) == F.col(own), "left_anti")
