"""N-gram Jaccard join: size bands, tiles of bitmap signatures, exact checks.

Two texts link when the Jaccard index of their k-word shingle sets reaches a
threshold ``num / den``.  The plan, which loses no link:

1. Every text becomes a set of 64-bit shingle hashes.  Equal sets are one node.
2. Sizes fall into bands.  Within a band two sets of the threshold differ in
   ``d`` shingles at most, so when hashes are dealt into ``d + K`` parts, at
   least K parts are equal.  A node emits a signature for every choice of K
   parts of its band, and of the next band if a larger partner may be there.
   Shingles that many documents have (boilerplate) are left out of them.  For
   low thresholds, with many signatures for each node, 40 bits of each are
   dealt out first, packed, and only signatures that may come twice travel
   with their nodes.
3. Nodes that share a signature form clusters, and each cluster is cut into
   tiles by set size.  Within tiles and from each tile to the next all pairs
   are compared: hashed bitmaps bound the overlap from above by bit counts,
   and what passes is intersected exactly.  Pairs already known to be connected
   are skipped.
4. Of the other pairs of tiles, those are compared whose sizes allow a link and
   that are not of one and the same component by then.  A dense cluster so
   costs about its tiles, not their square.
5. Components of the links give the classes.

Sets are told apart by 64-bit hashes: n different sets meet by chance with a
probability of about n^2 / 2^65.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import cache
from itertools import combinations
from math import comb

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from . import textkit as tk
from .components import components
from .runtime import free_name, prepare, written

BAND_RATIO = 1.4
#: A set with a larger share of rare shingles emits no signatures of the whole.
MANY_RARE = 0.75
#: A shingle is common from so many documents on; the most common ones count, as many as one worker can hold.
COMMON_DOCS = 20
MOST_COMMON = 1_000_000
BLOCK_SHINGLES = 1_500_000
NODE_BITS = 1 << 27
#: Prints are the leading bits of signatures: those that choose a bucket, and those that are packed.  A task packs so many at a time.
BUCKET_BITS, PRINT_BITS = 12, 28
PRINTS = 500_000
REPEAT_BITS = 27
FEW_NODES = 32
BITS = 1024
TILE_DOCS = 1000
TILE_SHINGLES = 400_000
BROADCAST_SIZES = 200_000
U64 = np.uint64


class Scheme:
    """Bands and parts of one threshold ``num / den``."""

    def __init__(self, num: int, den: int):
        self.num, self.den = num, den
        if not 0 < num <= den or BAND_RATIO * num < den:
            raise ValueError("the threshold must lie between 5/7 and 1")

    def differ(self, b: int) -> int:
        """Most shingles by which sets of at most ``b`` differ: 2 b (1 - t) / (1 + t)."""
        return 2 * b * (self.den - self.num) // (self.den + self.num)

    @staticmethod
    def spare(d: int) -> int:
        """Equal parts of partners beyond the first."""
        return 3 + d // 8

    @cache
    def start(self, band: int) -> int:
        """The smallest size in a band; band 0 starts where unequal sets can link."""
        if band == 0:
            n = 1
            while self.differ(n) == 0:
                n += 1
            return max(1, n - 1)
        return int(self.start(band - 1) * BAND_RATIO) + 1

    @cache
    def band(self, n: int) -> int:
        k = 0
        while self.start(k + 1) <= n:
            k += 1
        return k

    @cache
    def parts(self, band: int) -> tuple[int, int, np.ndarray | None, np.ndarray]:
        """(parts, K, choices of K parts or None where K is 1, inner bounds)."""
        d = self.differ(self.start(band + 1) - 1)
        k = {0: 1, 1: 4, 2: 3}.get(d, 2 if d <= 7 else 1)
        m = d + k if k > 1 else d + 1 + self.spare(d)
        chosen = np.array(list(combinations(range(m), k))) if k > 1 else None
        assert chosen is None or len(chosen) == comb(m, k)
        inner = np.array([(i << 64) // m for i in range(1, m)], dtype=U64)
        return m, k, chosen, inner

    def signatures(self, s: np.ndarray, common: np.ndarray | None = None) -> np.ndarray:
        """All signatures of a sorted set.

        Without its common shingles a set still differs from a partner by
        ``d`` at most, so signatures of the rare ones alone lose nothing, as
        long as both partners emit them.  A set with few common shingles emits
        only those, one with many only signatures of the whole set, and sets
        in between emit both: the shares are such that partners always meet.
        """
        n = len(s)
        if n < self.start(0):
            return np.zeros(0, U64)
        rare = s if common is None or not len(common) else s[common[np.minimum(np.searchsorted(common, s), len(common) - 1)] != s]
        t = self.num / self.den
        kinds = [(rare, 1)] if len(rare) >= (MANY_RARE - (1 - t)) * t * n - 1 else []
        if len(rare) <= MANY_RARE * n + 1 and len(rare) < n:
            kinds.append((s, 2))
        band = self.band(n)
        bands = [band, band + 1] if n * self.den // self.num >= self.start(band + 1) else [band]
        return np.concatenate([self.of_band(x, b, kind) for x, kind in kinds for b in bands])

    def of_band(self, s: np.ndarray, band: int, kind: int) -> np.ndarray:
        m, k, chosen, inner = self.parts(band)
        at = np.concatenate([[0], np.searchsorted(s, inner), [len(s)]])
        total = np.zeros(len(s) + 1, U64)
        np.cumsum(tk.mix(s), out=total[1:])
        size = np.diff(at)
        part = tk.mix(total[at[1:]] - total[at[:-1]] + np.arange(m, dtype=U64) * U64(0x9E3779B97F4A7C15) + size.astype(U64) * U64(0xC2B2AE3D27D4EB4F))
        if chosen is not None:
            sig = part[chosen].sum(axis=1, dtype=U64)
        else:
            # Partners have spare + 1 equal parts, and equal parts are of equal size: the spare
            # smallest ones of a set, which match by chance most often, are not needed.
            sig = part[size >= np.sort(size)[m - k - self.differ(self.start(band + 1) - 1)]]
        return tk.mix(sig + U64((band * 4 + kind) * 0x165667B19E3779F9 & (2**64 - 1)))


def nodes_of(sets: list[np.ndarray]) -> np.ndarray:
    """One hash for each set: equal sets are one node."""
    size = np.array([len(s) for s in sets], dtype=U64)
    sums = np.array([int(tk.mix(s).sum(dtype=U64)) if len(s) else 0 for s in sets], dtype=U64)
    return tk.mix(sums + size).view(np.int64)


def described(k: int, bits=None) -> object:
    """A UDF: text -> (size, node), and with a bitmap of nodes whether the node may be in it."""

    @F.arrow_udf("struct<n:bigint,node:bigint>" if bits is None else "struct<n:bigint,node:bigint,maybe:boolean>")
    def udf(text: pa.Array) -> pa.Array:
        size, node = [], [np.zeros(0, np.int64)]
        for chunk in tk.chunks(text):
            sets = tk.shingle_sets(*chunk, k)
            size += [len(s) for s in sets]
            node.append(nodes_of(sets))
        n, nodes = np.array(size, dtype=np.int64), np.concatenate(node)
        if bits is None:
            return pa.StructArray.from_arrays([pa.array(n), pa.array(nodes)], ["n", "node"])
        maybe = np.zeros(len(n), bool)
        maybe[maybe_in(bits.value, nodes, n)] = True
        return pa.StructArray.from_arrays([pa.array(n), pa.array(nodes), pa.array(maybe)], ["n", "node", "maybe"])

    return udf


def signatures_of(batches: Iterator[pa.RecordBatch], scheme: Scheme, k: int, common) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """The signatures of each batch's texts with their nodes, once for equal sets of a task."""
    seen: set[int] = set()
    boilerplate = None if common is None else common.value
    for b in batches:
        for chunk in tk.chunks(b.column(0)):
            sets = tk.shingle_sets(*chunk, k)
            sigs, nodes = [], []
            for s, node in zip(sets, nodes_of(sets).tolist(), strict=True):
                if len(s) and node not in seen:
                    seen.add(node)
                    sigs.append(scheme.signatures(s, boilerplate))
                    nodes.append(np.full(len(sigs[-1]), node))
            if sigs:
                yield np.concatenate(sigs), np.concatenate(nodes)


def signed(num: int, den: int, k: int, common, repeated=None):
    """mapInArrow over texts: (sig, node), without signatures that the bitmap of repeated ones rules out."""
    scheme = Scheme(num, den)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for sigs, nodes in signatures_of(batches, scheme, k, common):
            if repeated is not None:
                at = sigs >> U64(64 - REPEAT_BITS)
                take = ((repeated.value[at >> U64(6)] >> (at & U64(63))) & U64(1)).astype(bool)
                sigs, nodes = sigs[take], nodes[take]
            yield pa.RecordBatch.from_arrays([pa.array(sigs.view(np.int64)), pa.array(nodes)], ["sig", "node"])

    return run


def printed(num: int, den: int, k: int, common):
    """mapInArrow over texts: (bucket, prints), the leading bits of all signatures; a row for each bucket and PRINTS signatures."""
    scheme = Scheme(num, den)

    def dealt(block: list[np.ndarray]) -> pa.RecordBatch:
        prints = np.sort(np.concatenate(block) >> U64(64 - BUCKET_BITS - PRINT_BITS))
        third = np.zeros(len(prints), bool)
        third[2:] = prints[2:] == prints[:-2]
        prints = prints[~third]  # two tell all
        buckets, first = np.unique(prints >> U64(PRINT_BITS), return_index=True)
        each = np.split((prints & U64((1 << PRINT_BITS) - 1)).astype(np.uint32), first[1:])
        return pa.RecordBatch.from_arrays([pa.array(buckets.astype(np.int32)), pa.array([packed_prints(x) for x in each], pa.binary())], ["bucket", "prints"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        block, held = [], 0
        for sigs, _ in signatures_of(batches, scheme, k, common):
            block.append(sigs)
            held += len(sigs)
            if held >= PRINTS:
                yield dealt(block)
                block, held = [], 0
        if held:
            yield dealt(block)

    return run


def packed_prints(sorted_prints: np.ndarray) -> bytes:
    """Sorted numbers of 32 bits as steps, the same byte of each together, compressed."""
    steps = np.diff(sorted_prints, prepend=np.uint32(0))
    planes = np.ascontiguousarray(steps.view(np.uint8).reshape(-1, 4).T).tobytes()
    return len(sorted_prints).to_bytes(4, "little") + pa.Codec("zstd", compression_level=1).compress(planes, asbytes=True)


def unpacked_prints(packed: bytes) -> np.ndarray:
    n = int.from_bytes(packed[:4], "little")
    planes = np.frombuffer(pa.Codec("zstd").decompress(packed[4:], n * 4, asbytes=True), np.uint8).reshape(4, n)
    return np.cumsum(np.ascontiguousarray(planes.T).view(np.uint32).ravel(), dtype=np.uint32)


def repeated_prints(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """mapInArrow over (bucket, prints), sorted by bucket: each bucket's part of the bitmap of prints that come twice or more."""
    for g in tk.groups(batches, ["bucket"]):
        prints = np.sort(np.concatenate([unpacked_prints(x) for x in g["prints"].to_pylist()]))
        at = prints[1:][prints[1:] == prints[:-1]] >> np.uint32(PRINT_BITS + BUCKET_BITS - REPEAT_BITS)
        part = np.zeros(1 << (REPEAT_BITS - BUCKET_BITS), bool)
        part[at] = True
        yield pa.RecordBatch.from_arrays([g["bucket"][:1].combine_chunks().cast(pa.int32()), pa.array([np.packbits(part, bitorder="little").tobytes()], pa.binary())], ["bucket", "bits"])


def repeats(texts: DataFrame, num: int, den: int, k: int, common) -> np.ndarray:
    """A bitmap of 2^REPEAT_BITS bits, by the leading bits of signatures: those that come twice have theirs, whatever the corpus' size."""
    n = int(texts.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    prints = texts.mapInArrow(printed(num, den, k, common), "bucket int, prints binary").repartition(n, "bucket").sortWithinPartitions("bucket")
    parts = prints.mapInArrow(repeated_prints, "bucket int, bits binary").toArrow()
    out = np.zeros((1 << BUCKET_BITS, 1 << (REPEAT_BITS - BUCKET_BITS - 6)), U64)
    for bucket, bits in zip(parts["bucket"].to_pylist(), parts["bits"].to_pylist(), strict=True):
        out[bucket] = np.frombuffer(bits, U64)
    return out.ravel()


def sketched(k: int, bits):
    """mapInArrow over texts: (node, n, bitmap) of those whose node may be in the bitmap of nodes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for chunk in tk.chunks(b.column(0)):
                sets = tk.shingle_sets(*chunk, k)
                node, size = nodes_of(sets), np.array([len(s) for s in sets], dtype=np.int64)
                take = maybe_in(bits.value, node, size)
                maps = bitmaps([sets[i] for i in take])
                yield pa.RecordBatch.from_arrays([pa.array(node[take]), pa.array(size[take]), pa.array([m.tobytes() for m in maps], pa.binary())], ["node", "n", "bits"])

    return run


def maybe_in(bits: np.ndarray, node: np.ndarray, size: np.ndarray) -> np.ndarray:
    """Positions of nodes that are no empty sets and have their bit."""
    at = np.mod(node, NODE_BITS)
    return np.flatnonzero((size > 0) & ((bits[at // 64] >> (at % 64).astype(U64)) & U64(1)).astype(bool))


def bounded_pairs(num: int, den: int):
    """mapInArrow over (a, b, sizes, bitmaps): the pairs whose bit counts allow a link."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if not b.num_rows:
                continue
            col = {c: b.column(b.schema.get_field_index(c)) for c in ("n_a", "n_b", "bits_a", "bits_b")}
            x, y = (np.frombuffer(b"".join(col[c].to_pylist()), U64).reshape(b.num_rows, -1) for c in ("bits_a", "bits_b"))
            n = [col[c].to_numpy() for c in ("n_a", "n_b")]
            both = n[0] + n[1]
            most = (both - np.bitwise_count(x ^ y).sum(axis=1, dtype=np.int64)) // 2
            keep = pa.array((most * (num + den) >= num * both) & (np.minimum(*n) * den >= np.maximum(*n) * num))
            yield b.select(["a", "b"]).filter(keep)

    return run


def node_bits(nodes: DataFrame) -> np.ndarray:
    """A bitmap of NODE_BITS bits of which each node sets one: of bounded size whatever the number of nodes."""
    at = F.pmod("node", F.lit(NODE_BITS))
    words = nodes.select((at / 64).cast("long").alias("word"), F.call_function("shiftleft", F.lit(1).cast("long"), (at % 64).cast("int")).alias("bit")).groupBy("word").agg(F.bit_or("bit").alias("bits")).toArrow()
    out = np.zeros(NODE_BITS // 64, U64)
    out[words["word"].to_numpy()] = words["bits"].to_numpy().view(U64)
    return out


def packed(k: int, bits):
    """mapInArrow over texts: (node, n, packed text) of those whose node may be in the bitmap."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for buf, offs in tk.chunks(b.column(0)):
                sets = tk.shingle_sets(buf, offs, k)
                node, size = nodes_of(sets), np.array([len(s) for s in sets], dtype=np.int64)
                take = maybe_in(bits.value, node, size)
                texts = [pack(buf[offs[i] : offs[i + 1]]) for i in take]
                yield pa.RecordBatch.from_arrays([pa.array(node[take]), pa.array(size[take]), pa.array(texts, pa.binary())], ["node", "n", "packed"])

    return run


def repeated_shingles(k: int):
    """mapInArrow over texts: shingles that come up twice in a block of BLOCK_SHINGLES, with their counts.

    A shingle that is common in a corpus does so in some blocks at least.
    What is missed makes signatures weaker and changes no result.
    """

    def counted(block: list[np.ndarray]) -> pa.RecordBatch:
        words, n = np.unique(np.concatenate(block), return_counts=True)
        return pa.RecordBatch.from_arrays([pa.array(words[n > 1].view(np.int64)), pa.array(n[n > 1])], ["w", "n"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        block, held = [np.zeros(0, U64)], 0
        for b in batches:
            for chunk in tk.chunks(b.column(0)):
                sets = tk.shingle_sets(*chunk, k)
                block += sets
                held += sum(len(s) for s in sets)
                if held > BLOCK_SHINGLES:
                    yield counted(block)
                    block, held = [np.zeros(0, U64)], 0
        yield counted(block)

    return run


def common_shingles(texts: DataFrame, k: int) -> np.ndarray:
    """Sorted hashes of shingles that many documents have, MOST_COMMON at most."""
    rows = texts.mapInArrow(repeated_shingles(k), "w long, n long").groupBy("w").agg(F.sum("n").alias("n")).where(F.col("n") >= COMMON_DOCS)
    top = rows.orderBy(F.desc("n"), "w").limit(MOST_COMMON).select("w").toArrow()
    return np.sort(top["w"].to_numpy().view(U64))


def pack(text: np.ndarray) -> bytes:
    """A text's bytes, compressed: what the shuffles of whole texts carry."""
    return len(text).to_bytes(8, "little") + pa.Codec("zstd", compression_level=3).compress(text.tobytes(), asbytes=True)


def unpack(packed: bytes) -> bytes:
    return pa.Codec("zstd").decompress(packed[8:], int.from_bytes(packed[:8], "little"), asbytes=True)


def bitmaps(sets: list[np.ndarray]) -> np.ndarray:
    """BITS bits for each set, from its hashes."""
    out = np.zeros((len(sets), BITS // 64), U64)
    for i, s in enumerate(sets):
        bits = np.zeros(BITS, np.uint8)
        bits[(s >> U64(17)).astype(np.int64) % BITS] = 1
        out[i] = np.packbits(bits).view(U64)
    return out


def overlap(a: np.ndarray, b: np.ndarray) -> int:
    """Size of the intersection of two sorted sets."""
    if len(a) > len(b):
        a, b = b, a
    at = np.searchsorted(b, a)
    at[at == len(b)] = len(b) - 1
    return int((b[at] == a).sum())


def tile_links(left: list[np.ndarray], right: list[np.ndarray] | None, num: int, den: int) -> list[tuple[int, int]]:
    """Links that connect all of two tiles (or one) that are connected.

    Positions count on from the left tile to the right one.  A pair that is
    connected already is not compared: the classes stay the same.
    """
    sets = left + (right or [])
    size = np.array([len(s) for s in sets], dtype=np.int64)
    maps = bitmaps(sets)
    label = np.arange(len(sets))
    found = []
    for i in range(len(left)):
        js = np.arange(len(left), len(sets)) if right is not None else np.arange(i + 1, len(sets))
        js = js[(label[js] != label[i]) & (np.minimum(size[js], size[i]) * den >= np.maximum(size[js], size[i]) * num) & (size[js] > 0)]
        if not len(js):
            continue
        apart = np.bitwise_count(maps[js] ^ maps[i]).sum(axis=1, dtype=np.int64)
        both = size[js] + size[i]
        most = (both - apart) // 2
        for j in js[most * (num + den) >= num * both]:
            if label[j] == label[i]:
                continue
            if overlap(sets[i], sets[j]) * (num + den) >= num * (size[i] + size[j]):
                found.append((i, int(j)))
                label[label == label[j]] = label[i]
    return found


def compare(num: int, den: int, k: int):
    """mapInArrow over rows sorted by pair: the links of each pair of tiles; with no second tile, of all rows."""
    keys = ["cluster", "i", "j"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for g in tk.groups(batches, keys):
            texts = pa.array([unpack(x) for x in g["packed"].to_pylist()], pa.binary())
            sets = [s for c in tk.chunks(texts) for s in tk.shingle_sets(*c, k)]
            node = g["node"].to_numpy()
            tile, i, j = g["tile"].to_numpy(), g["i"][0].as_py(), g["j"][0].as_py()
            order = np.flatnonzero(tile == i) if j is not None else np.arange(len(node))
            rest = np.flatnonzero(tile == j) if j is not None else None
            at = order if rest is None else np.concatenate([order, rest])
            got = tile_links([sets[x] for x in order], None if rest is None else [sets[x] for x in rest], num, den)
            if got:
                a, b = np.array(got).T
                yield pa.RecordBatch.from_arrays([pa.array(node[at[a]]), pa.array(node[at[b]])], ["a", "b"])

    return run


def stars(shared: DataFrame) -> DataFrame:
    """Each node with the smallest one of each of its signatures: enough to connect all of them."""
    return shared.where("node <> least").select(F.col("node").alias("a"), F.col("least").alias("b")).distinct()


def pruned(shared: DataFrame, texts: DataFrame, num: int, den: int, k: int) -> DataFrame:
    """Candidate edges: of signatures that few nodes have, all pairs whose bitmaps allow a link; of others, stars.

    Chance matches of weak signatures would chain unrelated texts into one
    cluster that grows with the corpus; bit counts end nearly all of them.
    """
    few = shared.where(F.col("size") <= FEW_NODES).groupBy("sig").agg(F.array_sort(F.collect_set("node")).alias("v"))
    pairs = F.flatten(F.transform("v", lambda x: F.transform(F.filter("v", lambda y: y > x), lambda y: F.struct(x.alias("a"), y.alias("b")))))
    pairs = written(few.select(F.explode(pairs).alias("p")).select("p.a", "p.b").distinct(), "pairs")
    nodes = pairs.select(F.col("a").alias("node")).unionByName(pairs.select(F.col("b").alias("node")))
    bits = texts.sparkSession.sparkContext.broadcast(node_bits(nodes))
    maps = texts.mapInArrow(sketched(k, bits), "node long, n long, bits binary").groupBy("node").agg(F.max("n").alias("n"), F.max("bits").alias("bits"))
    maps = written(maps, "bitmaps")
    side = lambda x: maps.select(F.col("node").alias(x), F.col("n").alias(f"n_{x}"), F.col("bits").alias(f"bits_{x}"))
    kept = pairs.join(side("a"), "a").join(side("b"), "b").select("a", "b", "n_a", "n_b", "bits_a", "bits_b").mapInArrow(bounded_pairs(num, den), "a long, b long")
    return kept.unionByName(stars(shared.where(F.col("size") > FEW_NODES))).distinct()


def classes(df: DataFrame, text: Column, num: int = 9, den: int = 10, k: int = 3, boilerplate: bool = False) -> tuple[DataFrame, object]:
    """(node, component) of every node that links to another, and the UDF for nodes.

    Nodes without a link are not listed.  Texts without words have n = 0 and
    are no nodes.  ``boilerplate`` finds common shingles first, and then which
    signatures come twice, by a pass for each: worth it for low thresholds,
    where signatures rest on few shingles and are many.
    """
    spark = prepare(df.sparkSession)
    sc = spark.sparkContext
    rows = df.select(text.alias("text"))
    common = sc.broadcast(common_shingles(rows, k)) if boilerplate else None
    repeated = sc.broadcast(repeats(rows, num, den, k, common)) if boilerplate else None
    sigs = rows.mapInArrow(signed(num, den, k, common, repeated), "sig long, node long")
    by_sig = Window.partitionBy("sig")
    shared = sigs.withColumn("least", F.min("node").over(by_sig)).withColumn("most", F.max("node").over(by_sig)).withColumn("size", F.count("*").over(by_sig)).where("least <> most")
    if boilerplate:
        near = written(pruned(written(shared, "shared"), rows, num, den, k), "near")
    else:
        near = written(stars(shared), "near")
    cluster = written(components(near).select("node", F.col("component").alias("cluster")), "clusters")

    # Only texts of clusters are shuffled: a bitmap of bounded size keeps back the rest, the join decides.
    first = Window.partitionBy("node").orderBy("n")
    texts = rows.mapInArrow(packed(k, sc.broadcast(node_bits(cluster))), "node long, n long, packed binary")
    texts = texts.withColumn("rn", F.row_number().over(first)).where("rn = 1").drop("rn").join(cluster, "node")
    texts = written(texts, "near-texts")

    tiles = written(tiled(texts), "tiles")
    spans = written(tiles.groupBy("cluster", "tile").agg(F.min("n").alias("least"), F.max("n").alias("most")), "spans")
    after = spans.withColumn("next", F.lead("tile").over(Window.partitionBy("cluster").orderBy("tile")))
    groups = after.select("cluster", "tile", F.col("tile").alias("i"), F.lit(None).cast("long").alias("j")).unionByName(after.where("next is not null").select("cluster", F.col("next").alias("tile"), F.col("tile").alias("i"), F.lit(None).cast("long").alias("j")))
    near_links = written(compared(tiles, groups, num, den, k), "near-links")
    if after.groupBy("cluster").count().where("count > 2").isEmpty():
        return components(near_links), described(k)

    # Tiles that are not neighbours: only where something is left to connect.
    so_far = components(near_links)
    of_tile = tiles.select("cluster", "tile", "node").join(so_far, "node", "left").groupBy("cluster", "tile").agg(F.min(F.coalesce("component", "node")).alias("one"), F.max(F.coalesce("component", "node")).alias("other"))
    after = after.join(of_tile, ["cluster", "tile"])
    a, b = after.alias("a"), after.alias("b")
    reach = F.expr(f"a.cluster = b.cluster and b.tile > a.next and a.most * {den} >= b.least * {num} and not (a.one = a.other and b.one = b.other and a.one = b.one)")
    pairs = written(a.join(b, reach).select(F.col("a.cluster").alias("cluster"), F.col("a.tile").alias("i"), F.col("b.tile").alias("j")), "tile-pairs")
    groups = pairs.select("cluster", F.col("i").alias("tile"), "i", "j").unionByName(pairs.select("cluster", F.col("j").alias("tile"), "i", "j"))
    return components(near_links.unionByName(compared(tiles, groups, num, den, k))), described(k)


def tiled(texts: DataFrame) -> DataFrame:
    """(cluster, tile, node, n, packed): tiles of about TILE_DOCS texts and TILE_SHINGLES shingles, in order of size.

    No cluster meets in one task: tiles follow from how many texts of each
    size a cluster has, and sizes of more than one tile are dealt out by hash.
    """
    sizes = texts.groupBy("cluster", "n").agg(F.count("*").alias("docs"))
    weight = F.greatest(F.col("docs") / TILE_DOCS, F.col("docs") * F.col("n") / TILE_SHINGLES)
    before = Window.partitionBy("cluster").orderBy("n").rowsBetween(Window.unboundedPreceding, -1)
    sizes = sizes.withColumn("weight", weight).withColumn("before", F.coalesce(F.sum("weight").over(before), F.lit(0.0)))
    sizes = written(sizes.select("cluster", "n", "docs", F.floor("before").alias("first"), F.ceil("weight").alias("parts")), "sizes")
    # One in TILE_DOCS texts at most is a size of its own here.
    many = sizes.where(f"docs > {TILE_DOCS}").select("cluster", "n", "first", "parts")
    many = F.broadcast(many) if many.limit(BROADCAST_SIZES + 1).count() <= BROADCAST_SIZES else many
    dealt = texts.join(many, ["cluster", "n"], "left")
    rest = dealt.where("parts is null").drop("first", "parts").join(sizes.where(f"docs <= {TILE_DOCS}").select("cluster", "n", "first", "parts"), ["cluster", "n"])
    both = dealt.where("parts is not null").unionByName(rest)
    return both.select("cluster", (F.col("first") + F.pmod("node", "parts")).alias("tile"), "node", "n", "packed")


def compared(tiles: DataFrame, groups: DataFrame, num: int, den: int, k: int) -> DataFrame:
    """The links within each group: (cluster, i, j) lists its tiles."""
    n = int(tiles.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    pieces = tiles.join(groups, ["cluster", "tile"]).select("cluster", "i", "j", "tile", "node", "packed")
    pieces = pieces.repartition(n, "cluster", "i", "j").sortWithinPartitions("cluster", "i", "j", "node")
    return pieces.mapInArrow(compare(num, den, k), "a long, b long")


def jaccard_classes(df: DataFrame, doc_id: str = "doc_id", text: str = "text", num: int = 9, den: int = 10, k: int = 3) -> DataFrame:
    """Per row: doc_id, n_shingles and component_id, the class's smallest doc_id.

    Null or empty texts have no shingles and a class of their own; repeated
    rows come back as often as they are in ``df``; null doc_ids are larger
    than any other.  Very long texts are compared whole.  Of ``df`` only the
    two columns are read.
    """
    linked, brief = classes(df, F.col(text), num, den, k)
    rows = written(df.select(F.col(doc_id).alias("doc_id"), brief(F.col(text)).alias("x")).select("doc_id", F.col("x.n").alias("n_shingles"), F.col("x.node").alias("node")), "sized")
    nodes = rows.where("n_shingles > 0").groupBy("node").agg(F.min("doc_id").alias("least"))
    named = nodes.join(linked, "node", "left").select("node", "least", F.coalesce("component", "node").alias("component"))
    top = named.groupBy("component").agg(F.min("least").alias("component_id"))
    of_node = named.join(top, "component").select("node", "component_id")
    out = rows.join(of_node, (rows["node"] == of_node["node"]) & (rows["n_shingles"] > 0), "left")
    return out.select("doc_id", "n_shingles", F.coalesce("component_id", "doc_id").alias("component_id"))


def one_of_each(df: DataFrame, doc_id: str = "doc_id", text: str = "text", num: int = 8, den: int = 10, k: int = 5) -> DataFrame:
    """``df`` without all rows but one of each class: the smallest doc_id stays.

    Rows without words, null and empty texts among them, are all kept.  Among
    rows that tie in doc_id and text exactly one stays; null ids come last.
    Very long texts are compared whole; other columns pass through, whatever
    their names.  An empty table gives an empty one.
    """
    linked, brief = classes(df, F.col(text), num, den, k, boilerplate=True)
    node, rn, keep_node, keep_id, x = (free_name(df, c) for c in ("node", "rn", "keep_node", "keep_id", "described"))
    sized = df.withColumn(x, brief(F.col(text)))
    nodes = written(sized.where(F.col(f"{x}.n") > 0).groupBy(F.col(f"{x}.node").alias("node")).agg(F.min(doc_id).alias("least"), F.count("*").alias("rows")), "nodes")
    linked = written(linked, "linked")
    named = nodes.join(linked, "node", "left").select("node", "least", F.coalesce("component", "node").alias("component"))
    best = named.groupBy("component").agg(F.min_by(F.struct("node", "least"), F.struct(F.col("least").isNull(), "least", "node")).alias("k"))
    best = best.select(F.col("k.node").alias(keep_node), F.col("k.least").alias(keep_id))
    # A text that has no copy and no link stays where it is; a bitmap of bounded size tells most of them, the join decides of the rest.
    bits = df.sparkSession.sparkContext.broadcast(node_bits(nodes.where("rows > 1").select("node").unionByName(linked.select("node"))))
    sized = df.withColumn(x, described(k, bits)(F.col(text)))
    rows = sized.where(F.col(f"{x}.maybe")).withColumn(node, F.col(f"{x}.node"))
    kept = rows.join(best, (F.col(node) == F.col(keep_node)) & F.col(doc_id).eqNullSafe(F.col(keep_id)))
    kept = kept.withColumn(rn, F.row_number().over(Window.partitionBy(node).orderBy(text))).where(F.col(rn) == 1)
    return kept.select(*df.columns).unionByName(sized.where(~F.col(f"{x}.maybe")).select(*df.columns))
