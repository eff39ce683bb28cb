"""SimHash near-duplicate grouping with pigeonring candidate filtering."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators.components import connected_components
from ..session import Scratch
from .batches import as_bytes, bounds, columns, quoted, runs

BITS, SEGMENTS = 64, 5
#: A bucket of more fingerprints than this is split by more agreeing bits, until LEAF bits are left open.
BUCKET, LEAF = 2048, 11


def _segments(count: int = SEGMENTS) -> list[int]:
    edges = [round(BITS * i / count) for i in range(count + 1)]
    return [((1 << (b - a)) - 1) << a for a, b in zip(edges, edges[1:])]


def _budgets(distance: int) -> list[int]:
    """Most differing bits of the first l segments of a chain, l = 1 ... SEGMENTS."""
    return [distance * (i + 1) // SEGMENTS for i in range(SEGMENTS)]


def _signed(x: int) -> int:
    return x - (1 << 64) if x >> 63 else x


def _split(mask: int, parts: int) -> list[int]:
    """The bits open in a mask dealt to so many parts, each added to the mask."""
    free = [i for i in range(BITS) if not mask >> i & 1]
    return [mask | sum(1 << i for i in free[p::parts]) for p in range(parts)]


def fingerprint(text: bytes, width: int) -> int:
    """The contract's fingerprint: lower-cased ASCII, words between ASCII white space, majority over the shingles' bits."""
    words = text.lower().split()
    if not words:
        return 0
    whole = b" ".join(words)
    n = len(words)
    ends = np.cumsum([len(w) + 1 for w in words]) - 1
    starts = np.concatenate(([0], ends[:-1] + 1))
    if n < width:
        return xxhash.xxh64_intdigest(whole, 42)
    ones, total, h = np.zeros(BITS, np.int64), n - width + 1, xxhash.xxh64_intdigest
    for k in range(0, total, 1 << 16):
        a, b = starts[k : min(total, k + (1 << 16))].tolist(), ends[k + width - 1 : min(total, k + (1 << 16)) + width - 1].tolist()
        hashes = np.array([h(whole[i:j], 42) for i, j in zip(a, b)], dtype="<u8")
        ones += np.unpackbits(hashes.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * ones > total, bitorder="little").view("<u8")[0])


def simhash(docs: DataFrame, width: int = 3, text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """(doc_id, fp): a signed 64-bit SimHash of every whole text; null and wordless texts have fingerprint zero."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            made = np.array([fingerprint(t, width) for t in as_bytes(batch.column(1))], dtype=np.uint64).view(np.int64)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(made)], ["doc_id", "fp"])

    return docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).cast("binary").alias("t")).mapInArrow(run, "doc_id long, fp long")


def _links(distance: int, chains: dict[int, int]):
    """Pairs of a bucket that pass the chain's budgets and then the whole distance, reduced to a star for each local group."""
    segments = np.array(_segments(), dtype=np.uint64)
    budgets = _budgets(distance)

    def close(x: np.ndarray, y: np.ndarray, start: int) -> np.ndarray:
        differ = x[:, None] ^ y[None, :]
        total = np.bitwise_count(differ & segments[start])
        good = total <= budgets[0]
        for i in range(1, SEGMENTS):
            total = total + np.bitwise_count(differ & segments[(start + i) % SEGMENTS])
            good &= total <= budgets[i]
        return good

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in runs(batches, ["mask", "val"]):
            at = bounds(table, ["mask", "val"])
            masks, fps = table.column("mask").to_numpy(), table.column("fp").to_numpy()
            a, b = [], []
            for i, j in zip(at, at[1:]):
                if j - i < 2:
                    continue
                fp = np.sort(fps[i:j])
                near = close(u := fp.view(np.uint64), u, chains[int(masks[i])])
                label = np.arange(len(fp))
                while True:
                    low = np.where(near, label[None, :], len(fp)).min(axis=1)
                    low = np.minimum(label[low], low)
                    if (low == label).all():
                        break
                    label = low
                own = label != np.arange(len(fp))
                a.append(fp[own])
                b.append(fp[label[own]])
            if a:
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(a)), pa.array(np.concatenate(b))], ["a", "b"])

    return run


def fingerprint_links(fps: DataFrame, distance: int = 2, bucket: int = BUCKET, scratch: Scratch | None = None) -> DataFrame:
    """(a, b): edges that connect all distinct fingerprints at the given Hamming distance or less, and no others.

    Pigeonring principle: put the 64 bits on a ring of five segments. If two fingerprints differ in at most d bits, some
    starting segment has every chain of its next l segments within l * d / 5 differences. With d = 2 the first two
    segments must agree, so every fingerprint goes to five buckets, one for each start, keyed by 25 or 26 bits; inside a
    bucket the longer chains are tested before the whole distance. A bucket of more than `bucket` fingerprints (a hot
    group of near copies) is dealt by a pigeonhole step into three finer ones, which agree in a third of the open bits
    more; this repeats until buckets are small or 11 bits are open, where no more than 2048 fingerprints can exist.
    Buckets are exact at every level: no candidate is dropped. Only the links' star for each bucket leaves a task.
    """
    if not 0 <= distance <= 2:
        raise ValueError("distance must be 0, 1 or 2")
    scratch = scratch or Scratch(fps.sparkSession, "simhash")
    segments = _segments()
    masks = {segments[i] | segments[(i + 1) % SEGMENTS]: i for i in range(SEGMENTS)}
    rows = fps.select("fp").distinct().select("fp", F.explode(F.array(*[F.lit(_signed(m)) for m in masks])).alias("mask"))
    rows = scratch.keep(rows.select("fp", "mask", F.expr("fp & mask").alias("val")), "bucketed")
    found = None
    while True:
        sizes = rows.groupBy("mask", "val").agg(F.count(F.lit(1)).alias("n")).where("n > 1")
        sizes = scratch.keep(sizes, "sizes")
        open_bits = BITS - max(m.bit_count() for m in masks)
        most = sizes.agg(F.max("n")).first()[0] or 0
        cold = sizes if open_bits <= LEAF else sizes.where(F.col("n") <= bucket)
        pairs = (
            rows.join(cold.drop("n"), ["mask", "val"], "left_semi")
            .repartition("mask", "val")
            .sortWithinPartitions("mask", "val")
            .select("mask", "val", "fp")
            .mapInArrow(_links(distance, {_signed(m): i for m, i in masks.items()}), "a long, b long")
        )
        found = pairs if found is None else found.unionByName(pairs)
        if open_bits <= LEAF or most <= bucket:
            return found
        finer = {m: _split(m, 3) for m in masks}
        deal = F.create_map(*[x for m, s in finer.items() for x in (F.lit(_signed(m)), F.array(*[F.lit(_signed(k)) for k in s]))])
        rows = (
            rows.join(sizes.where(F.col("n") > bucket).drop("n"), ["mask", "val"], "left_semi")
            .select("fp", F.explode(deal[F.col("mask")]).alias("mask"))
            .select("fp", "mask", F.expr("fp & mask").alias("val"))
        )
        rows = scratch.keep(rows, "bucketed")
        masks = {k: masks[m] for m, s in finer.items() for k in s}


def near_duplicates(docs: DataFrame, width: int = 3, distance: int = 2, text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """(doc_id, fingerprint, component_id) for every row of docs.

    component_id is the smallest doc_id reachable over links between fingerprints. Rows with equal fingerprints are one
    node of the graph, so any number of exact copies adds one row to the search. Null texts count as empty; wordless
    texts share fingerprint zero and link like any other. A null doc_id is kept with its component's smallest id, null if
    it has none. Repeated rows are kept. Other columns are ignored. An empty table gives no rows.
    """
    scratch, steps = Scratch(docs.sparkSession, "simhash"), Scratch(docs.sparkSession, "simhash-steps")
    fps = scratch.keep(simhash(docs, width, text, doc_id), "fps")
    nodes = steps.keep(fps.groupBy("fp").agg(F.min("doc_id").alias("low")), "nodes")
    parts = connected_components(fingerprint_links(nodes, distance, scratch=steps), scratch=steps)
    placed = nodes.join(parts, nodes.fp == parts.node, "left").select("fp", "low", F.coalesce("component", "fp").alias("part"))
    placed = steps.keep(placed, "placed")
    lowest = placed.groupBy("part").agg(F.min("low").alias("component_id"))
    named = scratch.keep(placed.join(lowest, "part").select("fp", "component_id"), "named")
    steps.drop()
    return fps.join(named, "fp").select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


#: Wide fingerprints: words of 64 bits, segments on their ring, differing bits up to which a pair is verified (at a Jaccard
#: similarity of 0.8 the mean is 39 of 256, the deviation 6, both more for a few shingles), and the similarity that links.
WORDS, RING, DISTANCE, SIMILAR = 4, 16, 72, 0.8
#: Keys of a text, shingles in a key's bag, members of a bucket that are paired at once.
VIEWS, BAG, PAIRED = 12, 4, 512
_ODD = np.random.default_rng(7).integers(0, 1 << 63, WORDS + VIEWS, dtype=np.uint64) * np.uint64(2) + np.uint64(1)


def _remixed(h: np.ndarray, odd: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(32))) * odd
    h = (h ^ (h >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)
    return h ^ (h >> np.uint64(32))


def shingle_set(text: bytes, width: int = 5) -> np.ndarray:
    """Distinct hashes of a text's word shingles, ascending; a text of fewer words is one shingle."""
    words = text.lower().split()
    h = xxhash.xxh64_intdigest
    whole = b" ".join(words)
    if len(words) < width:
        return np.array([h(whole, 42)], dtype=np.uint64)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
    starts = np.concatenate(([0], ends[:-1] + 1))
    return np.unique(np.array([h(whole[i:j], 42) for i, j in zip(starts.tolist(), ends[width - 1 :].tolist())], dtype=np.uint64))


def wide_sketch(text: bytes, width: int = 5) -> tuple[int, bytes, list[int]]:
    """A hash of a text's set of shingles; its 256-bit SimHash, views' keys and size, packed; and its buckets.

    A view is a bag of BAG shingles, the smallest under an order of its own; its key is 32 bits of the bag's hash, and its
    bucket is the key with the view's number. Texts of Jaccard similarity s agree in a view with a probability of about
    s ** BAG, so at 0.8 they miss all views once in 500 pairs.
    """
    hashes = shingle_set(text, width)
    ones, bag = np.zeros((WORDS, BITS), np.int64), np.zeros((VIEWS, 0), np.uint64)
    for k in range(0, len(hashes), 1 << 14):
        ones += _ones(_remixed(hashes[None, k : k + (1 << 14)], _ODD[:WORDS, None]))
        bag = np.concatenate((bag, _remixed(hashes[None, k : k + (1 << 14)], _ODD[WORDS:, None])), axis=1)
        bag = np.partition(bag, BAG - 1, axis=1)[:, :BAG] if bag.shape[1] > BAG else bag
    bits = np.packbits(2 * ones > len(hashes), axis=1, bitorder="little")
    bag = np.sort(bag, axis=1)
    key = _ODD[WORDS:].copy()
    for k in range(bag.shape[1]):
        key = _remixed(key ^ bag[:, k], _ODD[k])
    key >>= np.uint64(32)
    packed = bits.tobytes() + key.astype("<u4").tobytes() + np.array([len(hashes)], "<u4").tobytes()
    buckets = key | np.arange(VIEWS, dtype=np.uint64) << np.uint64(32)
    return _signed(xxhash.xxh64_intdigest(hashes.tobytes(), 42)), packed, buckets.view(np.int64).tolist()


def _ones(x: np.ndarray) -> np.ndarray:
    """How often each bit is set in each row of hashes. Bytes are summed 255 at a time, which can't overflow them."""
    n = x.shape[1]
    unpacked = np.unpackbits(np.ascontiguousarray(x).view(np.uint8).reshape(x.shape[0], n, 8), axis=2, bitorder="little")
    whole = n // 255 * 255
    out = np.add.reduce(unpacked[:, whole:], axis=1, dtype=np.uint8).astype(np.int64)
    if whole:
        out += np.add.reduce(unpacked[:, :whole].reshape(x.shape[0], -1, 255, BITS), axis=2, dtype=np.uint8).sum(axis=1, dtype=np.int64)
    return out


class _Members:
    """A bucket's members: fingerprints, views' keys and numbers of shingles, unpacked."""

    def __init__(self, key: int, packed: list[bytes]):
        raw = np.frombuffer(b"".join(packed), np.uint8).reshape(len(packed), -1)
        self.view = key >> 32
        self.prints = np.ascontiguousarray(raw[:, : 8 * WORDS]).view(np.uint16)
        self.keys = np.ascontiguousarray(raw[:, 8 * WORDS : -4]).view("<u4")[:, : self.view]
        self.size = np.ascontiguousarray(raw[:, -4:]).view("<u4")[:, 0].astype(np.int64)

    def near(self, r: int, distance: int, side: np.ndarray, group: np.ndarray) -> np.ndarray:
        """Members after r that make a candidate with it: of another side, if it has one, and another group.

        Pairs are first tested by pigeonring: from some segment on the ring, chains of 1 to 4 segments must all keep within
        their share of the distance. A pair that shares the key of an earlier view is a candidate there.
        """
        d = np.bitwise_count(self.prints[r] ^ self.prints[r + 1 :]).astype(np.int16)
        fits, total = np.ones(d.shape, bool), np.zeros(d.shape, np.int16)
        for n in range(4):
            total += np.roll(d, -n, axis=1)
            fits &= total <= distance * (n + 1) // RING
        own, size = self.size[r], self.size[r + 1 :]
        at = np.flatnonzero(fits.any(axis=1) & (np.minimum(own, size) >= SIMILAR * np.maximum(own, size) - 1e-9))
        at = at[d[at].sum(axis=1) <= distance]
        at = r + 1 + at[~(self.keys[r] == self.keys[r + 1 + at]).any(axis=1)]
        return at[(group[at] != group[r]) & ((side[at] != side[r]) | (side[r] < 0))]


def _candidates(distance: int):
    """(key, part, node) of the members of a bucket that make a candidate with another."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in runs(batches, ["key", "part"]):
            at = bounds(table, ["key", "part"])
            key, side, group = (table.column(c).to_numpy() for c in ("key", "side", "group"))
            packed = table.column("packed").to_pylist()
            flag = np.zeros(table.num_rows, bool)
            for i, j in zip(at, at[1:]):
                members = _Members(int(key[i]), packed[i:j])
                for r in range(j - i - 1):
                    near = members.near(r, distance, side[i:j], group[i:j])
                    flag[i + near] = True
                    flag[i + r] |= len(near) > 0
            if flag.any():
                yield from table.select(["key", "part", "node", "side", "group"]).filter(pa.array(flag)).combine_chunks().to_batches()

    return run


def _verified(distance: int, width: int):
    """Star edges over the candidates of a bucket whose sets of shingles have a Jaccard similarity of SIMILAR, exactly.

    Pairs that are already linked within the bucket aren't counted again, so a large group of copies costs a row or so.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in runs(batches, ["key", "part"]):
            at = bounds(table, ["key", "part"])
            key, node, side, group = (table.column(c).to_numpy() for c in ("key", "node", "side", "group"))
            packed, text = table.column("packed").to_pylist(), table.column("t")
            edges: list[np.ndarray] = []
            for i, j in zip(at, at[1:]):
                members, label = _Members(int(key[i]), packed[i:j]), np.arange(j - i)
                sets = [shingle_set(t, width) for t in as_bytes(text.slice(i, j - i))]
                for r in range(j - i - 1):
                    near = members.near(r, distance, side[i:j], group[i:j])
                    near = near[label[near] != label[r]]
                    if not len(near):
                        continue
                    flat = np.concatenate([sets[k] for k in near])
                    place = np.minimum(np.searchsorted(sets[r], flat), len(sets[r]) - 1)
                    size = members.size[near]
                    common = np.add.reduceat((sets[r][place] == flat).astype(np.int64), np.cumsum(size) - size)
                    good = near[common >= SIMILAR * (len(sets[r]) + size - common) - 1e-9]
                    for old in np.unique(label[good]):
                        label[label == old] = label[r]
                own = label != np.arange(j - i)
                edges.append(np.stack([node[i:j][label[own]], node[i:j][own]], axis=1))
            both = _forest(np.concatenate(edges)) if edges else np.zeros((0, 2), np.int64)
            if len(both):
                yield pa.RecordBatch.from_arrays([pa.array(both[:, 0]), pa.array(both[:, 1])], ["a", "b"])

    return run


def _forest(edges: np.ndarray) -> np.ndarray:
    """Edges of a spanning forest as stars: each node with the least node of its group."""
    if not len(edges):
        return edges
    names, flat = np.unique(edges, return_inverse=True)
    a, b = flat.reshape(-1, 2).T
    label = np.arange(len(names))
    while True:
        new = label.copy()
        low = np.minimum(label[a], label[b])
        np.minimum.at(new, a, low)
        np.minimum.at(new, b, low)
        new = new[new]
        if (new == label).all():
            break
        label = new
    own = label != np.arange(len(names))
    return np.stack([names[label[own]], names[own]], axis=1)


def similar_groups(docs: DataFrame, width: int = 5, distance: int = DISTANCE, text: str = "text", doc_id: str = "doc_id", scratch: Scratch | None = None) -> DataFrame:
    """(doc_id, component_id): groups of texts linked by a Jaccard similarity of their shingle sets of SIMILAR or more.

    Equal sets are one node. 64 bits tell texts of this similarity apart from others too coarsely, and no exact key search reaches
    their distance. So fingerprints have 256 bits, candidates meet in the buckets of their views, and pigeonring with a wide
    distance prunes them. Every link is then verified on the whole sets: the candidates' texts come to their buckets, each
    pair in the first view that it shares.

    A bucket of more than PAIRED nodes is dealt to parts of about that size, each with the bucket's least node, so that a hot
    group is linked through it. Then the parts are paired block by block, and what the links so far leave in different
    components is compared across them; a bucket that is one component already needs no blocks. So no pair of a bucket is lost.
    """
    result = scratch or Scratch(docs.sparkSession, "similar")
    scratch = Scratch(docs.sparkSession, "similar-steps")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            made = [wide_sketch(t, width) for t in as_bytes(batch.column(1))] or []
            columns = [pa.array([m[k] for m in made], kind) for k, kind in enumerate((pa.int64(), pa.binary(), pa.list_(pa.int64())))]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(2), *columns], ["doc_id", "hash", "node", "packed", "keys"])

    source = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).cast("binary").alias("t")).withColumn("hash", F.xxhash64("t"))
    sketched = scratch.keep(source.mapInArrow(run, "doc_id long, hash long, node long, packed binary, keys array<long>"), "sketched")
    one = F.min(F.struct("doc_id", "hash")).alias("one")  # a row that has the node's text
    nodes = scratch.keep(sketched.groupBy("node").agg(F.min("doc_id").alias("low"), one, F.min("packed").alias("packed"), F.min("keys").alias("keys")), "nodes")
    sizes = nodes.select("node", F.explode("keys").alias("key")).groupBy("key").agg(F.count(F.lit(1)).alias("n"), F.min("node").alias("least")).where("n > 1")
    sizes = scratch.keep(sizes, "sizes")

    def edges(dealt: DataFrame) -> DataFrame:
        """Verified links within the parts (key, part, node, side, group, packed), between sides and groups only."""
        dealt = dealt.select("key", "part", "node", "side", "group", "packed")
        placed = dealt.repartition("key", "part").sortWithinPartitions("key", "part").mapInArrow(_candidates(distance), "key long, part long, node long, side long, group long")
        placed = scratch.keep(placed, "candidates")
        wanted = placed.select("node").distinct().join(nodes, "node").select("node", "packed", F.col("one.doc_id").alias("id"), F.col("one.hash").alias("hash"))
        texts = source.join(wanted, (source.hash == wanted.hash) & source.doc_id.eqNullSafe(wanted.id)).groupBy("node").agg(F.first("packed").alias("packed"), F.first("t").alias("t"))
        brought = placed.join(texts, "node").select("key", "part", "node", "side", "group", "packed", "t")
        return scratch.keep(brought.repartition("key", "part").sortWithinPartitions("key", "part").mapInArrow(_verified(distance, width), "a long, b long"), "links")

    parts = F.ceil(F.col("n") / PAIRED)
    mine = F.pmod(F.xxhash64("node", "key"), parts)
    part = F.explode(F.when(F.col("node") == F.col("least"), F.sequence(F.lit(0).cast("long"), parts - 1)).otherwise(F.array(mine)))
    rows = nodes.select("node", "packed", F.explode("keys").alias("key")).join(sizes, "key")
    links = edges(rows.withColumns({"part": part, "side": F.lit(-1).cast("long"), "group": F.col("node")}))
    groups = connected_components(links, scratch=scratch)
    hot = sizes.where(F.col("n") > PAIRED)
    if hot.head(1):
        now = nodes.join(groups, "node", "left").select("node", "packed", "keys", F.coalesce("component", "node").alias("group"))
        rows = scratch.keep(now.select("node", "packed", "group", F.explode("keys").alias("key")).join(hot, "key"), "hot")
        apart = rows.groupBy("key").agg((F.min("group") != F.max("group")).alias("apart")).where("apart").select("key")
        rows = rows.join(apart, "key", "left_semi").withColumns({"side": mine, "parts": parts})
        rows = rows.withColumn("other", F.explode(F.sequence(F.lit(0).cast("long"), F.col("parts") - 1))).where("other != side")
        links = links.unionByName(edges(rows.withColumn("part", F.least("side", "other") * F.col("parts") + F.greatest("side", "other"))))
        groups = connected_components(links, scratch=scratch)
    placed = scratch.keep(nodes.join(groups, "node", "left").select("node", "low", F.coalesce("component", "node").alias("part")), "placed")
    lowest = placed.groupBy("part").agg(F.min("low").alias("component_id"))
    out = sketched.select("doc_id", "node").join(placed.join(lowest, "part").select("node", "component_id"), "node").select("doc_id", "component_id")
    out = result.keep(out, "groups")
    scratch.drop()
    return out


def keep_one(docs: DataFrame, width: int = 5, text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """docs with one row of each group of similar texts (see similar_groups): the one with the smallest id. Columns stay.

    Null texts count as empty, and wordless texts are one group. Rows that repeat an id count as one document, of which
    the one with the smallest text stays (null first; of equal texts the one whose other columns have the smallest hash). Rows without an id stay only if no row of their group has one. An empty table stays empty.
    """
    scratch = Scratch(docs.sparkSession, "similar")
    own = "_near"
    while any(c.lower().startswith(own) for c in docs.columns):
        own += "_"
    key, low, n = f"{own}id", f"{own}low", f"{own}n"
    groups = similar_groups(docs, width, text=text, doc_id=doc_id, scratch=scratch).select(F.col("doc_id").alias(key), F.col("component_id").alias(low))
    first = scratch.keep(groups.where(F.col(key).eqNullSafe(F.col(low))).groupBy(key).agg(F.count(F.lit(1)).alias(n)), "first")
    # the same plan at every size: the kept ids grow with the documents
    kept = docs.join(first.hint("merge"), F.col(doc_id).cast("long").eqNullSafe(F.col(key)), "inner")
    mine = columns(docs.columns)
    once = kept.where((F.col(n) == 1) | F.col(key).isNull()).select(*mine)
    if not first.where((F.col(n) > 1) & F.col(key).isNotNull()).head(1):
        return once
    hashed = [quoted(f.name) for f in docs.schema.fields if "map<" not in f.dataType.simpleString()]
    least = F.struct(F.col(quoted(text)), F.xxhash64(*hashed))
    more = kept.where((F.col(n) > 1) & F.col(key).isNotNull()).groupBy(key).agg(F.min_by(F.struct(*mine), least).alias(low))
    return once.unionByName(more.select(*[F.col(low)[c].alias(c) for c in docs.columns]))
