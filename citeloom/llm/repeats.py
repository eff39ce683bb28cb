"""Removal of long repeated strings with a run-length Burrows-Wheeler index.

Strings are equal by their bytes inside an index. Two whole segments are equal if their anchors and their 64-bit hashes are, so an
error needs a collision among the segments of one anchor; windows of an anchor with many segments are equal by 128-bit hashes.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import Scratch
from .batches import bounds, runs

#: Bytes of an anchor; window starts of a text that are taken at once; text of one index; segments of one anchor beyond
#: which its windows are counted one by one.
ANCHOR, PIECE, INDEX, HOT = 64, 4 << 20, 2 << 20, 2048
_MULTIPLIER = 0x9E3779B97F4A7C15
_MIX = np.uint64(0xBF58476D1CE4E5B9)
_LOW24 = np.uint64((1 << 24) - 1)
_powers: dict[str, np.ndarray] = {}


def _power(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of the multiplier and of its inverse, modulo 2 ** 64."""
    if not _powers or len(_powers["up"]) < n:
        size = max(n, 1 << 17)
        for name, base in (("up", _MULTIPLIER), ("down", pow(_MULTIPLIER, -1, 1 << 64))):
            _powers[name] = np.cumprod(np.concatenate((np.ones(1, np.uint64), np.full(size, base, np.uint64))))
    return _powers["up"], _powers["down"]


def _mixed(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(31))) * _MIX
    h = (h ^ (h >> np.uint64(29))) * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(32))


def anchors(raw: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Anchor hash, segment hash, first and last window start of each run of windows that share an anchor.

    The anchor of a window (a string of `length` bytes) is the leftmost of its ANCHOR-byte strings of least hash, so it
    depends on the window alone: equal windows have equal anchors. A segment is all bytes of a run's windows.
    """
    n = len(raw)
    up, down = _power(n + 1)
    total = np.concatenate((np.zeros(1, np.uint64), np.cumsum((raw.astype(np.uint64) + np.uint64(1)) * up[:n], dtype=np.uint64)))
    h = _mixed((total[ANCHOR:] - total[:-ANCHOR]) * down[: n - ANCHOR + 1])
    low = (h & ~_LOW24) | np.arange(len(h), dtype=np.uint64)
    width, span = length - ANCHOR + 1, 1
    while 2 * span <= width:
        low = np.minimum(low[:-span], low[span:])
        span *= 2
    if span < width:
        low = np.minimum(low[: len(low) - (width - span)], low[width - span :])
    at = low & _LOW24
    first = np.flatnonzero(np.concatenate(([True], at[1:] != at[:-1])))
    last = np.append(first[1:], len(at)) - 1
    segment = _mixed((total[last + length] - total[first]) * down[first] + (last - first).astype(np.uint64))
    return h[at[first].astype(np.int64)], segment, first, last


def _pieces(size: int, length: int) -> Iterator[tuple[int, int]]:
    """First and end byte of pieces whose windows together are the text's windows, each in one piece."""
    for k in range(0, size - length + 1, PIECE):
        yield k, min(size, k + PIECE + length - 1)


class RunLengthIndex:
    """Run-length compressed Burrows-Wheeler transform of a text with the suffixes at its runs' ends.

    The transform is read once, for its runs; of the suffix array only the entries at the runs' first and last rows are kept,
    with the longest common prefixes there, so what stays grows with the runs and not with the text. Where the symbol before a suffix and the one before its neighbour in the suffix array are equal, the common
    prefix is one shorter than that of the suffix one place earlier in the text; so a stream over the text from sample
    to sample yields every place's longest match elsewhere, in either direction of the suffix array.
    """

    def __init__(self, text: bytes):
        self.n = n = len(text)
        padded = np.frombuffer(text + bytes(16), np.uint8).astype(np.uint64)
        words = np.zeros(n + 8, np.uint64)
        for k in range(8):
            words[: n + 8] = (words << np.uint64(8)) | padded[k : k + n + 8]
        self._words = words
        order = self._suffixes(words)
        before = np.frombuffer(text, np.uint8)[order - 1]
        edge = np.concatenate(([True], (before[1:] != before[:-1]) | (order[1:] == 0) | (order[:-1] == 0)))
        head = np.flatnonzero(edge)
        self.runs = len(head)
        tail = np.append(head[1:], n) - 1
        self.head_at, self.head_match = order[head], self._common(order[head], order[head - 1], head > 0)
        self.tail_at, self.tail_match = order[tail], self._common(order[tail], order[(tail + 1) % n], tail < n - 1)

    def _suffixes(self, words: np.ndarray) -> np.ndarray:
        """Suffix array by prefix doubling; only suffixes that are still tied are sorted again."""
        n = self.n
        order = np.argsort(words[:n], kind="stable")
        key = words[order]
        start = np.concatenate(([True], key[1:] != key[:-1]))
        rank = np.zeros(n + 1, np.int64)
        first = np.maximum.accumulate(np.where(start, np.arange(n), 0))
        rank[order] = first + 1
        tied = ~start
        tied[:-1] |= ~start[1:]
        slots = np.flatnonzero(tied)
        step = 8
        while len(slots):
            who = order[slots]
            nxt = rank[np.minimum(who + step, n)]
            by = np.argsort((rank[who] << np.int64(32)) | nxt, kind="stable")
            who, nxt, old = who[by], nxt[by], rank[who[by]]
            order[slots] = who
            fresh = np.concatenate(([True], (old[1:] != old[:-1]) | (nxt[1:] != nxt[:-1])))
            rank[who] = np.maximum.accumulate(np.where(fresh, slots, 0)) + 1
            tied = ~fresh
            tied[:-1] |= ~fresh[1:]
            slots = slots[tied]
            step *= 2
        return order

    def _common(self, a: np.ndarray, b: np.ndarray, real: np.ndarray) -> np.ndarray:
        """Length of the common prefix of the suffixes at a and b, zero where not real."""
        out = np.zeros(len(a), np.int64)
        live = np.flatnonzero(real)
        a, b, w, done = a[live], b[live], self._words, 0
        while len(live):
            x = w[np.minimum(a + done, self.n)] ^ w[np.minimum(b + done, self.n)]
            end = np.minimum(self.n - a, self.n - b) - done
            same = 8 - (64 - _leading(x) + 7) // 8
            more = (same == 8) & (end > 8)
            out[live[~more]] = done + np.minimum(same, end)[~more]
            live, a, b = live[more], a[more], b[more]
            done += 8
        return out

    def longest_elsewhere(self) -> np.ndarray:
        """For each place of the text the longest string from there that also begins at another place."""
        place = np.arange(self.n)
        best = np.zeros(self.n, np.int64)
        for at, match in ((self.head_at, self.head_match), (self.tail_at, self.tail_match)):
            sampled = np.full(self.n, -1)
            sampled[at] = at
            value = np.zeros(self.n, np.int64)
            value[at] = match
            source = np.maximum.accumulate(sampled)
            best = np.maximum(best, np.where(source >= 0, value[source] - (place - source), 0))
        return best


def _leading(x: np.ndarray) -> np.ndarray:
    """Number of leading zero bits of unsigned 64-bit numbers."""
    n = np.zeros(len(x), np.int64)
    x = x.copy()
    zero = x == 0
    for s in (32, 16, 8, 4, 2, 1):
        small = x < np.uint64(1) << np.uint64(64 - s)
        n += np.where(small, s, 0)
        x = np.where(small, x << np.uint64(s), x)
    return np.where(zero, 64, n)


def _spans(flags: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    edge = np.flatnonzero(np.diff(np.concatenate(([0], flags.astype(np.int8), [0]))))
    return edge[::2], edge[1::2]


def _in_rows(made: tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]) -> tuple[np.ndarray, ...]:
    """Equal segments that follow each other as one: anchor, segment, first and last window of the first one, last window of the last one,
    how many. In a text of one letter, or of few bytes over and over, nearly all segments are such."""
    anchor, segment, first, last = made
    new = np.flatnonzero(np.concatenate(([True], (anchor[1:] != anchor[:-1]) | (segment[1:] != segment[:-1]))))
    many = np.diff(new, append=len(anchor))
    return anchor[new], segment[new], first[new], last[new], last[new + many - 1], many


def _merged(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Spans (doc_id, digest, start, end) with those of a batch that touch or overlap in one text made one."""
    for batch in batches:
        if not batch.num_rows:
            continue
        ids, none = batch.column(0).fill_null(0).to_numpy(), batch.column(0).is_null().to_numpy(zero_copy_only=False)
        digest, start, end = (batch.column(k).to_numpy() for k in (1, 2, 3))
        by = np.lexsort((start, digest, ids, none))
        ids, none, digest, start, end = (x[by] for x in (ids, none, digest, start, end))
        text = np.cumsum(np.concatenate(([False], (ids[1:] != ids[:-1]) | (none[1:] != none[:-1]) | (digest[1:] != digest[:-1]))))
        far = np.maximum.accumulate(end + (text << 40))  # the farthest end so far; no text has 2 ** 40 bytes
        new = np.flatnonzero(np.concatenate(([True], start[1:] + (text[1:] << 40) > far[:-1])))
        ends = (far - (text << 40))[np.append(new[1:], len(far)) - 1]
        kept = batch.select([0, 1]).take(pa.array(by[new]))
        yield pa.RecordBatch.from_arrays([*kept.columns, pa.array(start[new]), pa.array(ends)], ["doc_id", "digest", "start", "end"])


def repeated_spans(docs: DataFrame, length: int = 200, scratch: Scratch | None = None) -> DataFrame:
    """(doc_id, digest, spans): for each text with repeated windows the byte ranges [start, end) to remove; they may overlap.

    docs has doc_id, digest (of the text) and t (binary).
    1. Every window belongs to an anchor; windows in a row with one anchor form a segment. About one segment for each 70
       bytes is shuffled, as two hashes and its place; equal segments in a row are one with a count.
    2. Segments that occur twice are removed whole. They are counted with partial sums, so copies by the million cost a
       row for each task.
    3. Anchors with several different segments (edges of shared passages, edited copies) may share some windows. The
       segments' bytes are fetched, brought together by anchor, and indexed together: a run-length Burrows-Wheeler index of
       whole anchors, INDEX bytes of text at a time. Matching statistics of `length` and more mark windows.
    4. The windows of an anchor with more than HOT different segments are counted one by one by 128-bit hashes, which
       again uses partial sums, so a passage that a third of all documents share isn't gathered in one task.
    5. Neighbouring spans of a text are made one in the tasks, before a text's spans are brought together.
    """
    scratch = scratch or Scratch(docs.sparkSession, "repeats")

    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, digests = batch.column(0).to_numpy(zero_copy_only=False), batch.column(1).to_numpy()
            out: list[tuple] = []
            size = 0
            for i, t in enumerate(batch.column(2)):
                t = t.as_py() or b""
                for a, b in _pieces(len(t), length):
                    made = _in_rows(anchors(np.frombuffer(t, np.uint8)[a:b], length))
                    out.append((np.full(len(made[0]), i), made[0].view(np.int64), made[1].view(np.int64), made[2] + a, made[3] + a, made[4] + a, made[5]))
                    size += len(made[0])
                if size > 200_000 or (out and i == batch.num_rows - 1):
                    row, *rest = (np.concatenate(x) for x in zip(*out))
                    yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(row)), pa.array(digests[row]), *map(pa.array, rest)], ["doc_id", "digest", "anchor", "segment", "a", "b", "last", "many"])
                    out, size = [], 0
            if out:
                row, *rest = (np.concatenate(x) for x in zip(*out))
                yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(row)), pa.array(digests[row]), *map(pa.array, rest)], ["doc_id", "digest", "anchor", "segment", "a", "b", "last", "many"])

    rows = scratch.keep(docs.select("doc_id", "digest", "t").where(F.length("t") >= length).mapInArrow(find, "doc_id long, digest long, anchor long, segment long, a long, b long, last long, many long"), "rows")
    segments = rows.groupBy("anchor", "segment").agg(F.sum("many").alias("n"), F.min(F.struct("doc_id", "digest", "a", "b")).alias("at"))
    segments = scratch.keep(segments, "segments")
    mixed = scratch.keep(segments.groupBy("anchor").agg(F.count(F.lit(1)).alias("kinds")).where("kinds > 1"), "mixed")
    whole = rows.join(segments.where("n > 1").select("anchor", "segment"), ["anchor", "segment"], "left_semi")
    found = whole.select("doc_id", "digest", F.col("a").alias("start"), (F.col("last") + length).alias("end"))

    wanted = segments.join(mixed, "anchor").select("anchor", "n", "at.*", "kinds")
    wanted = wanted.groupBy("doc_id", "digest").agg(F.collect_list(F.struct("anchor", "n", "a", "b", "kinds")).alias("w"))
    # a row for each text and not for each copy: equal (doc_id, digest) are one text
    both = docs.select("doc_id", "digest", "t").join(wanted.withColumnRenamed("doc_id", "d"), (F.col("doc_id").eqNullSafe(F.col("d"))) & (docs.digest == wanted.digest)).select("doc_id", docs.digest, "t", "w")

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                t, w = batch.column(2)[i].as_py(), batch.column(3)[i].values
                anchor, n, a, b, kinds = (w.field(k).to_numpy() for k in range(5))
                for k in range(0, len(a), 4096):
                    part = slice(k, k + 4096)
                    texts = [t[x : y + length] for x, y in zip(a[part].tolist(), b[part].tolist())]
                    m = len(texts)
                    yield pa.RecordBatch.from_arrays([pa.array(anchor[part]), pa.array(n[part]), pa.array(kinds[part]), pa.array(np.repeat(batch.column(0).slice(i, 1).to_numpy(zero_copy_only=False), m)).cast(pa.int64()), pa.array(np.full(m, batch.column(1)[i].as_py())), pa.array(a[part]), pa.array(texts, pa.binary())], ["anchor", "n", "kinds", "doc_id", "digest", "a", "s"])

    bytes_of = scratch.keep(both.mapInArrow(cut, "anchor long, n long, kinds long, doc_id long, digest long, a long, s binary"), "bytes")

    def index(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in runs(batches, ["anchor"]):
            cuts, texts = bounds(table, ["anchor"]), table.column("s").to_pylist()
            size = np.concatenate(([0], np.cumsum([len(x) + 1 for x in texts])))
            i = 0
            while i < len(cuts) - 1:
                j = max(i + 1, int(np.searchsorted(size[cuts], size[cuts[i]] + INDEX, "right")) - 1)
                r0, r1 = cuts[i], cuts[j]
                i = j
                # 0xFF ends a segment: it isn't part of any UTF-8 text
                long = RunLengthIndex(b"\xff".join(texts[r0:r1]) + b"\xff").longest_elsewhere() >= length
                base = size[r0:r1] - size[r0]
                left = (size[r0 + 1 : r1 + 1] - size[r0])[np.searchsorted(base, np.arange(len(long)), "right") - 1] - np.arange(len(long)) - 1
                first, end = _spans(long & (left >= length))
                of = np.searchsorted(base, first, "right") - 1
                start = table.column("a").to_numpy()[r0:r1][of] + first - base[of]
                if len(of):
                    yield pa.RecordBatch.from_arrays([table.column("doc_id").combine_chunks().take(pa.array(of + r0)), table.column("digest").combine_chunks().take(pa.array(of + r0)), pa.array(start), pa.array(start + (end - first) - 1 + length)], ["doc_id", "digest", "start", "end"])

    cold = bytes_of.where(F.col("kinds") <= HOT).repartition("anchor").sortWithinPartitions("anchor").select("anchor", "doc_id", "digest", "a", "s")
    marked = cold.mapInArrow(index, "doc_id long, digest long, start long, end long")

    def one_by_one(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            names = ["doc_id", "digest", "n", "a", "s"]
            for i in range(batch.num_rows):
                d, g, n, a, s = (batch.column(k)[i].as_py() for k in names)
                hashes = [xxhash.xxh3_128_digest(s[k : k + length]) for k in range(len(s) - length + 1)]
                m = len(hashes)
                yield pa.RecordBatch.from_arrays([pa.array([d] * m, pa.int64()), pa.array([g] * m, pa.int64()), pa.array([n] * m, pa.int64()), pa.array(range(a, a + m), pa.int64()), pa.array(hashes, pa.binary())], ["doc_id", "digest", "n", "start", "h"])

    hot = bytes_of.where(F.col("kinds") > HOT).mapInArrow(one_by_one, "doc_id long, digest long, n long, start long, h binary")
    seen = hot.groupBy("h").agg(F.sum("n").alias("n"), F.count(F.lit(1)).alias("m")).where("n > 1").select("h")
    counted = hot.join(seen, "h", "left_semi").select("doc_id", "digest", "start", (F.col("start") + length).alias("end"))
    found = found.unionByName(marked).unionByName(counted).mapInArrow(_merged, "doc_id long, digest long, start long, end long")
    # rows that repeat an id and text add the same spans again
    return found.groupBy("doc_id", "digest").agg(F.collect_set(F.struct("start", "end")).alias("spans"))


def remove_repeats(docs: DataFrame, length: int = 200, text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """(doc_id, kept, n_bytes, n_removed, n_spans) for every row: kept is the text as UTF-8 bytes without each byte that
    is covered by a string of `length` bytes which also begins anywhere else, in this or another document.

    Strings are judged on the input. A null text counts as empty. Rows that are equal in id and text are copies of each
    other. Other columns are ignored; an empty table gives no rows; texts of any length are processed whole.
    """
    scratch = Scratch(docs.sparkSession, "repeats")
    source = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.xxhash64(text).alias("digest"), F.coalesce(F.col(text).cast("binary"), F.lit(b"")).alias("t"))
    steps = Scratch(docs.sparkSession, "repeats-steps")
    spans = scratch.keep(repeated_spans(source, length, steps), "spans").withColumnsRenamed({"doc_id": "d", "digest": "g"})
    steps.drop(steps.root)
    both = source.join(spans, F.col("doc_id").eqNullSafe(F.col("d")) & (F.col("digest") == F.col("g")), "left").select("doc_id", "t", "spans")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            kept, removed, count = [], [], []
            for t, s in zip(batch.column(1), batch.column(2)):
                t = t.as_py()
                if not s.is_valid:
                    kept.append(t), removed.append(0), count.append(0)
                    continue
                depth = np.zeros(len(t) + 1, np.int32)
                np.add.at(depth, s.values.field(0).to_numpy(), 1)
                np.add.at(depth, s.values.field(1).to_numpy(), -1)
                gone = np.cumsum(depth[:-1]) > 0
                kept.append(np.frombuffer(t, np.uint8)[~gone].tobytes())
                removed.append(int(gone.sum()))
                count.append(len(_spans(gone)[0]))
            sizes = [x + len(k) for x, k in zip(removed, kept)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(kept, pa.binary()), *(pa.array(x, pa.int64()) for x in (sizes, removed, count))], ["doc_id", "kept", "n_bytes", "n_removed", "n_spans"])

    return both.mapInArrow(run, "doc_id long, kept binary, n_bytes long, n_removed long, n_spans long")


def sha256(raw: bytes) -> str:
    return hashlib.sha256(raw).hexdigest()
