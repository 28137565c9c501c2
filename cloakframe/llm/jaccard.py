"""N-gram Jaccard join by T-occurrence search (DivideSkip).

Two sets with Jaccard similarity of t or more share at least T = t / (1 + t) * (n + m) shingles. DivideSkip, distributed:

1. Order all shingles by how frequent they are (levels of counts over all documents, then hash). Of each set, the T - l most frequent
   shingles are its long lists; they are never merged. The others, n - T + l of them, are its short lists: an inverted index over
   them is dealt by shingle to parts of bounded size. In each part every set looks its short lists up: a binary search skips what is too small for it,
   a heap merges the rest of the lists, and counts how often each other set meets it. Pairs that meet in l short lists or more, over all parts, are candidates.
2. Candidates are probed in the long lists: a set is in the list of a shingle if a binary search finds the shingle in the sorted set. The count over one whole set is the exact overlap.

The order decides only how much work there is, never the result. Texts with equal sets are one class, so copies don't meet in lists.

joined() needs components only, so it leaves out pairs that are known to be connected. A first round links classes that agree in a band of minimum hashes to one
class of each band, and a second one each class with its nearest one in each list of a frequent shingle, by bitmaps of parities, as far as the exact overlap
confirms it; lists then give pairs between different components of those links only. Pairs of near copies that meet in lists of shared shingles (of SHARED documents or more) are never rows: a part gives
a spanning forest of them, the components of all forests are groups, and a group's lists are looked up, merged and probed once more in cells (a block of its classes, or two), each with all lists and whole sets of its
classes, that give spanning links. The result is whole: every pair of classes in different components that can reach t meets in the short lists of shingles that are not shared often enough, or is in
a cell. A list of a very frequent shingle is dealt as pairs of blocks of it, to many tasks. links() leaves nothing out and gives every pair.

Defined results: null texts and texts without words have empty sets, link with nothing and are components of their own; rows that repeat
or share a doc_id keep one row each; null doc_ids are never a component's smallest unless all are null; very long texts are worked on whole, one by one; an empty
table gives an empty one; columns other than doc_id and text are not looked at, whatever their names.
Bitmaps and levels that go to all executors grow with the input up to a fixed size (MOST_SLOTS, MOST_IDS); beyond it there is more work, and the same result.
"""

from __future__ import annotations

import hashlib
import heapq
from collections.abc import Iterator
from itertools import groupby

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from cloakframe.llm.common import counted, lean, passing, slices, table, text_batches, utf8_views, written
from cloakframe.llm.components import components, roots
from cloakframe.llm.shingles import mix, shingle_sets

#: Levels of shingles and bitmaps of ids have 2^21 slots for inputs up to 4 GB, and grow with the input to at most 2^24 and 2^28. A slot is a shingle's or an id's first bits.
SLOT_BITS, MOST_SLOTS, MOST_IDS, BUCKET = 21, 24, 28, 32768
#: A task counts blocks of so many shingles; levels begin at these numbers of documents.
BLOCK, LEVELS = 1 << 21, (16, 64, 256, 1024, 4096, 16384, 65536, 1 << 20)
#: Shingles of so many documents are shared, of a level or not. Their bitmap has 2^23 slots for inputs up to 4 GB, and grows to at most 2^28.
SHARED, SHARED_BITS, MOST_SHARED = 4, 23, 28
#: Blocks of the lists of shingles of the two highest levels.
SPLIT = {7: 4, 8: 16}
BANDS, ROWS = 8, 3
#: Bits of a set's parity.
PARITY = 1024
PART = 1 << 18
#: Postings that a part of the index has on average (at least, unless there would be fewer parts than partitions, and at most), and pairs that are looked at together in it.
LEAST_POSTINGS, PART_POSTINGS, TOGETHER = 1 << 12, 1 << 17, 1 << 18
#: Shingles that a block of a group's classes has on average.
GROUP_BLOCK = 1 << 17
#: h: the list (a shingle, or a pair of blocks of its list); side: 1 and 2 in a pair of different blocks, else 0.
POSTING = np.dtype([("h", "<u8"), ("c", "<i8"), ("label", "<i8"), ("n", "<i4"), ("place", "<u4"), ("side", "u1")])
#: In lists of shared shingles, postings carry the parity, so that all but the shortest lists are sieved where they are merged.
HEAVY = np.dtype([*POSTING.descr, ("parity", f"V{PARITY // 8}")])
_ODD = mix(np.arange(1, BANDS * ROWS + 1, dtype=np.uint64)) | np.uint64(1)
_NONE = 1 << 30
#: What lists give: all pairs that meet in them, only each class's nearest one, or a spanning forest of the pairs.
ALL, NEAREST, FOREST = "all", "nearest", "forest"


def least_overlap(n: np.ndarray | int, m: np.ndarray | int, percent: int):
    """T: the least overlap of sets of n and m elements at that similarity."""
    return -((-percent * (n + m)) // (100 + percent))


def extra(n):
    """l of a set of n elements."""
    return 1 + n // 32


def short_lists(n: int, percent: int) -> int:
    return min(n, n - -(-percent * n // 100) + extra(n))


def slot_bits(docs: DataFrame, most: int, least: int = SLOT_BITS) -> int:
    """Bits of slots for an input of this size, as the optimizer estimates it (at or over 2^60 bytes it has no idea): one slot for 2 KB (if least is SLOT_BITS)."""
    size = int(docs._jdf.queryExecution().optimizedPlan().stats().sizeInBytes())
    return min(most, max(least, (size >> 11 + SLOT_BITS - least).bit_length())) if size < 1 << 60 else least


def _bits(df: DataFrame, slot: str, bits: int = SLOT_BITS) -> np.ndarray:
    """A bitmap of the slots in df, by native aggregates; rows of 4 KB come to the driver, 2^bits bits in all."""
    return _bitmaps(df, slot, bits, [F.lit(True)])[0].astype(bool)


def _bitmaps(df: DataFrame, slot: str, bits: int, conditions: list[Column]) -> np.ndarray:
    """A bitmap of the slots in df for each condition, in one pass."""
    one = F.col(slot) + 1  # the first bucket has number 1 and holds the values from 1 on; 0 has a bucket of its own
    rows = df.select(F.bitmap_bucket_number(one).alias("k"), *[F.when(c, F.bitmap_bit_position(one)).alias(f"at{i}") for i, c in enumerate(conditions)])
    out = np.zeros((len(conditions), 1 << bits), np.uint8)
    found = rows.groupBy("k").agg(*[F.expr(f"bitmap_construct_agg(at{i}) FILTER (WHERE at{i} IS NOT NULL)").alias(f"b{i}") for i in range(len(conditions))])
    for r in found.collect():
        for i in range(len(conditions)):
            if r[f"b{i}"] is not None:
                out[i, (r["k"] - 1) * BUCKET + np.flatnonzero(np.unpackbits(np.frombuffer(r[f"b{i}"], np.uint8), bitorder="little"))] = 1
    return out


def _summed(values: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct values, and the sum of each one's counts."""
    order = np.argsort(values, kind="stable")
    values, counts = values[order], counts[order]
    first = np.flatnonzero(np.append(True, values[1:] != values[:-1]))
    return values[first], np.add.reduceat(counts, first)


def shingle_counts(docs: DataFrame, words: int, bits: int) -> DataFrame:
    """slot, n: the number of documents that the shared shingles of each slot are in, whichever tasks they are read by.

    Shingles go by their first bits to parts, which count them by the 32 bits that follow: of a task's block those that it has once (`ones`),
    and the others with their number (`many`), so that a part gets a very frequent one once from each block."""
    tasks = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    high, least = min(bits, (4 * tasks - 1).bit_length()), min(SHARED, LEVELS[0])

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[np.ndarray] = []

        def out() -> Iterator[pa.RecordBatch]:
            if held:
                h = np.concatenate(held) >> np.uint64(32 - high)
                held.clear()
                h.sort()
                first = np.flatnonzero(np.append(True, h[1:] != h[:-1]))
                n, h = np.diff(np.append(first, len(h))), h[first]
                one, low = n == 1, (h & np.uint64(0xFFFFFFFF)).astype(np.uint32)
                ends = np.arange(1, (1 << high) + 1, dtype=np.uint64) << np.uint64(32)
                many = np.stack([low[~one], n[~one].astype(np.uint32)], axis=1)
                cut = [np.append(0, np.searchsorted(h[x], ends)).astype(np.int32) for x in (one, ~one)]
                data = [pa.Array.from_buffers(pa.binary(), 1 << high, [None, pa.py_buffer(at * np.int32(wide)), pa.py_buffer(x.tobytes())]) for at, wide, x in zip(cut, (4, 8), (low[one], many), strict=True)]
                some = pa.array((np.diff(cut[0]) > 0) | (np.diff(cut[1]) > 0))
                yield pa.RecordBatch.from_arrays([pa.array(np.arange(1 << high, dtype=np.int32)), *data], names=["part", "ones", "many"]).filter(some)

        size = 0
        for batch in batches:
            for part in slices(batch, "text", PART):
                for s in shingle_sets(*utf8_views(part.column("text")), words):
                    held.append(s)
                    size += len(s)
                if size >= BLOCK:
                    yield from out()
                    size = 0
        yield from out()

    def frequent(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ones, many = [], []
        for batch in batches:
            at = batch.column("part")[0].as_py()
            ones.append(np.frombuffer(utf8_views(batch.column("ones"))[0].tobytes(), np.uint32))
            many.append(np.frombuffer(utf8_views(batch.column("many"))[0].tobytes(), np.uint32).reshape(-1, 2))
        single, several = np.concatenate(ones), np.concatenate(many)
        value, n = _summed(np.append(single, several[:, 0]), np.append(np.ones(len(single), np.int64), several[:, 1].astype(np.int64)))
        value, n = value[n >= least], n[n >= least]
        if len(value):
            slot, n = _summed(((np.uint64(at) << np.uint64(32)) | value.astype(np.uint64)) >> np.uint64(32 + high - bits), n)
            yield pa.RecordBatch.from_arrays([pa.array(slot.astype(np.int64)), pa.array(n)], names=["slot", "n"])

    def grouped(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from lean(frequent)(batches)

    dealt = docs.select("text").mapInArrow(lean(work), "part int, ones binary, many binary")
    return dealt.groupBy("part").applyInArrow(grouped, "slot long, n long")


def levels_of(counts: DataFrame, bits: int) -> np.ndarray:
    """A level for each slot of shingles, from shingle_counts() of so many bits or more."""
    return _bitmaps(counts, "slot", bits, [F.col("n") >= least for least in LEVELS]).sum(axis=0, dtype=np.uint8)


def shingle_levels(docs: DataFrame, words: int, bits: int = SLOT_BITS) -> np.ndarray:
    return levels_of(shingle_counts(docs, words, bits), bits)


def class_of(s: np.ndarray) -> int:
    return int.from_bytes(hashlib.blake2b(s.tobytes(), digest_size=8).digest(), "little", signed=True)


def sketched(docs: DataFrame, words: int, percent: int, level: np.ndarray, shared: np.ndarray | None = None) -> DataFrame:
    """doc_id, n, c (class: hash of the set), bands, short (the short lists' shingles; the first `light` are not shared), heavy (the levels of the others, 0 for none) and
    parity of every document; c is null for empty sets. shared: a bitmap of slots."""
    schema = "doc_id long, n long, c long, bands array<long>, short binary, light int, heavy binary, parity array<long>"
    levels, bits = docs.sparkSession.sparkContext.broadcast(level), len(level).bit_length() - 1
    shared = np.zeros(1, np.uint8) if shared is None else np.packbits(shared, bitorder="little")
    sharing, fine = docs.sparkSession.sparkContext.broadcast(shared), (8 * len(shared)).bit_length() - 1

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lev, some = levels.value, sharing.value
        for batch in batches:
            for part in slices(batch, "text", PART):
                n, c, bands, short, light, heavy, parity = [], [], [], [], [], [], []
                for s in shingle_sets(*utf8_views(part.column("text")), words):
                    n.append(len(s))
                    if not len(s):
                        c.append(None), bands.append([]), short.append(b""), light.append(0), heavy.append(b""), parity.append([])
                        continue
                    c.append(class_of(s))
                    low = np.concatenate([(s[i : i + 4096, None] * _ODD).min(axis=0)[None] for i in range(0, len(s), 4096)]).min(axis=0).reshape(BANDS, ROWS)
                    key = mix(mix(mix(low[:, 0]) + low[:, 1]) + low[:, 2] + np.arange(BANDS, dtype=np.uint64))
                    bands.append(key.view(np.int64))
                    parity.append(np.packbits(np.bincount((s & np.uint64(PARITY - 1)).astype(np.int64), minlength=PARITY) & 1).view(np.int64))
                    of = lev[(s >> np.uint64(64 - bits)).astype(np.int64)]
                    at = (s >> np.uint64(64 - fine)).astype(np.int64)
                    often = np.where(of > 0, of + 1, (some[at >> 3] >> (at & 7).astype(np.uint8)) & 1)
                    order = np.argsort(often, kind="stable")[: short_lists(len(s), percent)]
                    few = int((often[order] == 0).sum())
                    short.append(s[order].tobytes()), light.append(few), heavy.append(of[order[few:]].tobytes())
                cols = [pa.array(n, pa.int64()), pa.array(c, pa.int64()), pa.array(bands, pa.list_(pa.int64())), pa.array(short, pa.binary()), pa.array(light, pa.int32()), pa.array(heavy, pa.binary()), pa.array(parity, pa.list_(pa.int64()))]
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), *cols], names=["doc_id", "n", "c", "bands", "short", "light", "heavy", "parity"])

    return docs.select("doc_id", "text").mapInArrow(lean(work), schema)


def whole_sets(docs: DataFrame, needed: DataFrame, words: int) -> DataFrame:
    """c and whole (its sorted hashes), one row each, of the classes in needed (c, id: one of its documents), and of others whose documents' ids share a slot
    with a needed one: documents are left out by a bitmap of ids before their sets are computed."""
    bits = slot_bits(docs, MOST_IDS)
    slot = lambda c: F.pmod(F.xxhash64(c), F.lit(1 << bits)).alias("slot")
    known = docs.sparkSession.sparkContext.broadcast(np.packbits(_bits(needed.select(slot("id")), "slot", bits), bitorder="little"))

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        wanted = known.value
        for batch in batches:
            at = batch.column("slot").to_numpy()
            batch = batch.filter(pa.array((wanted[at >> 3] >> (at & 7).astype(np.uint8)) & 1 > 0))
            for part in slices(batch, "text", PART):
                found = [s for s in shingle_sets(*utf8_views(part.column("text")), words)]
                yield pa.RecordBatch.from_arrays([pa.array([class_of(s) for s in found], pa.int64()), pa.array([s.tobytes() for s in found], pa.binary())], names=["c", "whole"])

    return docs.select("text", slot("doc_id")).mapInArrow(lean(work), "c long, whole binary").groupBy("c").agg(F.first("whole").alias("whole"))


def ends(pairs: DataFrame) -> DataFrame:
    """c and id of both classes of each pair (x, y, xid, yid)."""
    return pairs.select(F.explode(F.array(F.struct(F.col("x").alias("c"), F.col("xid").alias("id")), F.struct(F.col("y").alias("c"), F.col("yid").alias("id")))).alias("s")).select("s.c", "s.id")


def overlap(a: np.ndarray, b: np.ndarray) -> int:
    """How many elements of the smaller set a binary search finds in the larger one."""
    a, b = (a, b) if len(a) <= len(b) else (b, a)
    at = np.searchsorted(b, a)
    return int((b[np.minimum(at, len(b) - 1)] == a).sum())


def probed(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """Of candidate pairs (x, y of classes), those that are linked, as u and v. sets: c and whole of all their classes."""
    both = pairs.join(sets.select(F.col("c").alias("x"), F.col("whole").alias("wx")), "x").join(sets.select(F.col("c").alias("y"), F.col("whole").alias("wy")), "y")

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keep = []
            for p, q in zip(batch.column("wx"), batch.column("wy"), strict=True):
                a, b = np.frombuffer(p.as_buffer(), np.uint64), np.frombuffer(q.as_buffer(), np.uint64)
                shared = overlap(a, b)
                keep.append(100 * shared >= percent * (len(a) + len(b) - shared))
            yield pa.RecordBatch.from_arrays([batch.column("x"), batch.column("y")], names=["u", "v"]).filter(pa.array(keep, pa.bool_()))

    return written(both.select("x", "y", "wx", "wy").mapInArrow(lean(work), "u long, v long"), "links")


def banded_pairs(classes: DataFrame) -> DataFrame:
    """Each class with the smallest class of each of its bands: at most 8 pairs a class."""
    rows = classes.select("c", F.explode("bands").alias("band"))
    stars = written(rows.groupBy("band").agg(F.min("c").alias("y"), F.count("*").alias("k")).where("k > 1").drop("k"), "stars")  # so that the join can split a hot band
    return rows.join(stars, "band").where("c <> y").select(F.col("c").alias("x"), "y").distinct()


def _packed(rows: np.ndarray) -> bytes:
    """Postings field by field: most classes are their own label, and shuffles compress what repeats."""
    return b"".join(np.ascontiguousarray(rows[f]).tobytes() for f in rows.dtype.names)


def _unpacked(data: pa.Buffer, kind: np.dtype) -> np.ndarray:
    n, at = data.size // kind.itemsize, 0
    rows = np.empty(n, kind)
    for f in kind.names:
        rows[f] = np.frombuffer(data, kind[f], n, at)
        at += n * kind[f].itemsize
    return rows


def in_blocks(rows: np.ndarray, level: np.ndarray) -> np.ndarray:
    """Postings of very frequent shingles as postings of pairs of blocks of their lists: in each pair with a posting's own block, one."""
    out = [rows[level < min(SPLIT)]]
    for at, blocks in SPLIT.items():
        own = rows[level == at]
        block = (mix(own["c"].view(np.uint64)) % np.uint64(blocks)).astype(np.int64)
        for other in range(blocks):
            cell = own.copy()
            pair = np.minimum(block, other) * blocks + np.maximum(block, other) + 1
            cell["h"] = mix(cell["h"] + pair.astype(np.uint64))
            cell["side"] = np.where(block == other, 0, np.where(block < other, 1, 2))
            out.append(cell)
    return np.concatenate(out)


def _deal(parts: int, heavy_only: bool = False):
    """Postings of a task as one record array for each part of the lists (and another for lists of shared shingles). heavy_only: none but lists of shingles with a level."""

    def dealt(held: list[np.ndarray], heavy: bool) -> Iterator[pa.RecordBatch]:
        if not held:
            return
        rows = np.concatenate(held)
        held.clear()
        part = (rows["h"] % np.uint64(parts)).astype(np.int32)
        order = np.argsort(part, kind="stable")
        rows, part = rows[order], part[order]
        at = np.flatnonzero(np.diff(part, prepend=-1))
        ends = np.append(at[1:], len(rows))
        yield pa.RecordBatch.from_arrays([pa.array(part[at]), pa.array([_packed(rows[a:b]) for a, b in zip(at, ends, strict=True)], pa.binary()), pa.array([heavy] * len(at))], names=["part", "rows", "heavy"])

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[list[np.ndarray]] = [[], []]
        size = 0
        for batch in batches:
            parities = batch.column("parity").flatten().to_numpy().reshape(-1, PARITY // 64)
            for i, (c, label, n, short, light, level) in enumerate(zip(*(batch.column(k).to_pylist() for k in ("c", "label", "n", "short", "light", "heavy")), strict=True)):
                h, level = np.frombuffer(short, np.uint64), np.frombuffer(level, np.uint8)
                skip = light + int((level == 0).sum()) if heavy_only else light  # levels ascend
                level = level[skip - light :]
                for heavy, own in ((0, h[:light]), (1, h[skip:])):
                    if len(own) and heavy >= heavy_only:
                        rows = np.zeros(len(own), HEAVY if heavy else POSTING)
                        rows["h"], rows["c"], rows["label"], rows["n"] = own, c, label, n
                        rows["place"] = np.arange(len(own)) + skip * heavy
                        if heavy:
                            rows["parity"] = np.frombuffer(parities[i].tobytes(), HEAVY["parity"])[0]
                            rows = in_blocks(rows, level)
                        held[heavy].append(rows)
                        size += len(rows) * (1 + 4 * heavy)
                if size >= 1 << 19:
                    for heavy in (0, 1):
                        yield from dealt(held[heavy], bool(heavy))
                    size = 0
        for heavy in (0, 1):
            yield from dealt(held[heavy], bool(heavy))

    return work


def heap_merged(runs: list[list[int]]) -> Iterator[tuple[int, int]]:
    """Each number in some ascending runs, and in how many of them it is."""
    if len(runs) == 1:
        return ((y, 1) for y in runs[0])
    return ((y, sum(1 for _ in same)) for y, same in groupby(heapq.merge(*runs)))


def _looked_up(rows: np.ndarray, percent: int, give: str) -> Iterator[pa.RecordBatch]:
    """Pairs that meet in some lists that are short for both, with how often: across labels only, of sizes that fit and, where postings
    have one, of parities that fit. NEAREST: of each posting only the pair whose parities are apart least. FOREST: stars that connect what the pairs do, with 0 for how often.

    Sets are ranked by size, and lists ascend by rank; a set looks up, in each of its lists, what comes before it and is not too small."""
    if not len(rows):
        return
    rows = rows[np.argsort(rows["h"], kind="stable")]
    first = np.flatnonzero(np.append(True, rows["h"][1:] != rows["h"][:-1]))
    count = np.diff(np.append(first, len(rows)))
    mixed = np.minimum.reduceat(rows["label"], first) < np.maximum.reduceat(rows["label"], first)
    rows, which = rows[np.repeat(mixed, count)], np.repeat(np.arange(int(mixed.sum())), count[mixed])
    if not len(rows):
        return
    order = np.lexsort((rows["c"], rows["n"], which))
    rows, which = rows[order], which[order]
    ids, one, back = np.unique(rows["c"], return_index=True, return_inverse=True)
    by_size = np.lexsort((ids, rows["n"][one]))
    rank = np.empty(len(ids), np.int64)
    rank[by_size] = np.arange(len(ids))
    ids, size, rank = ids[by_size], rows["n"][one][by_size].astype(np.int64), rank[back]
    parity = np.frombuffer(np.ascontiguousarray(rows["parity"][one][by_size]).tobytes(), np.uint64).reshape(-1, PARITY // 64) if "parity" in rows.dtype.names else None
    label, place, side = rows["label"], rows["place"].astype(np.int64), rows["side"]
    fits = np.searchsorted(size, -(-percent * size // 100))  # the first rank that is not too small for a rank
    keys = which * len(ids) + rank
    lo, hi = np.searchsorted(keys, which * len(ids) + fits[rank]), np.searchsorted(keys, keys)
    probing = np.lexsort((which, rank))  # the postings of a set side by side
    probing = probing[hi[probing] > lo[probing]]
    ends = np.cumsum((hi - lo)[probing])
    close, partner = np.full(len(rows), _NONE), np.zeros(len(rows), np.int64)
    found: list[list] = [[], [], []]
    tree = np.zeros(0, np.int64), np.zeros(0, np.int64)

    def out() -> Iterator[pa.RecordBatch]:
        x, y, n = (np.array(c, np.int64) for c in found)
        for c in found:
            c.clear()
        yield pa.RecordBatch.from_arrays([pa.array(v) for v in (ids[x], ids[y], size[x], size[y], n)], names=["x", "y", "nx", "ny", "k"])

    i = 0
    while i < len(probing):
        j = max(i + 1, int(np.searchsorted(ends, (ends[i - 1] if i else 0) + TOGETHER, side="right")))
        own = probing[i:j]
        i, many = j, (hi - lo)[own]
        p = np.repeat(own, many)
        q = np.arange(len(p)) - np.repeat(np.cumsum(many) - many, many) + np.repeat(lo[own], many)
        a, b = rank[p], rank[q]
        long = least_overlap(size[a], size[b], percent) - np.minimum(extra(size[a]), extra(size[b]))  # lists of the pair that are never merged
        ok = (label[p] != label[q]) & (a != b) & (place[p] < size[a] - long) & (place[q] < size[b] - long) & ((side[p] == 0) | (side[p] != side[q]))
        p, q, a, b = p[ok], q[ok], a[ok], b[ok]
        if parity is not None:
            apart = np.bitwise_count(parity[a] ^ parity[b]).sum(axis=1, dtype=np.int64)
            ok = apart <= size[a] + size[b] - 2 * least_overlap(size[a], size[b], percent)
            p, q, a, b, apart = p[ok], q[ok], a[ok], b[ok], apart[ok]
        if not len(p):
            continue
        if give == FOREST:
            node, root = roots(np.append(tree[0], a), np.append(tree[1], b))
            tree = node[node != root], root[node != root]
            continue
        if give == NEAREST:
            for at, other in ((p, q), (q, p)):
                best = np.lexsort((apart, at))
                best = best[np.append(True, at[best][1:] != at[best][:-1])]
                best = best[apart[best] < close[at[best]]]
                close[at[best]], partner[at[best]] = apart[best], other[best]
            continue
        cut = np.flatnonzero(np.append(True, p[1:] != p[:-1]))  # the runs: what one posting meets
        probe, starts, y = a[cut].tolist(), [*cut.tolist(), len(p)], b.tolist()
        k = 0
        while k < len(probe):
            m = k + 1
            while m < len(probe) and probe[m] == probe[k]:
                m += 1
            for other, n in heap_merged([y[starts[r] : starts[r + 1]] for r in range(k, m)]):
                found[0].append(probe[k]), found[1].append(other), found[2].append(n)
            k = m
        if len(found[0]) >= 1 << 16:
            yield from out()
    if give == FOREST:
        x, y = tree
        yield pa.RecordBatch.from_arrays([pa.array(v) for v in (ids[x], ids[y], size[x], size[y], np.zeros(len(x), np.int64))], names=["x", "y", "nx", "ny", "k"])
    elif give == NEAREST:
        p = np.flatnonzero(close < _NONE)
        a, b = rank[p], rank[partner[p]]
        pairs = np.unique(np.stack([np.minimum(a, b), np.maximum(a, b)], axis=1), axis=0)
        x, y = pairs[:, 0], pairs[:, 1]
        yield pa.RecordBatch.from_arrays([pa.array(v) for v in (ids[x], ids[y], size[x], size[y], np.ones(len(x), np.int64))], names=["x", "y", "nx", "ny", "k"])
    elif found[0]:
        yield from out()


def _meetings(percent: int, give: str):
    """The lists of one part, looked up; those of shingles that are not shared have three postings at most, so they give all their pairs instead of a forest."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[bool, list[np.ndarray]] = {False: [], True: []}
        for b in batches:
            for x, heavy in zip(b.column("rows"), b.column("heavy").to_pylist(), strict=True):
                held[heavy].append(_unpacked(x.as_buffer(), HEAVY if heavy else POSTING))
        for heavy, rows in held.items():
            if rows:
                yield from _looked_up(np.concatenate(rows), percent, ALL if give == FOREST and not heavy else give)

    return work


def _met(classes: DataFrame, postings: int, percent: int, give: str) -> DataFrame:
    """x, y, nx, ny, k: what the lists of classes (c, label, n, short, light, heavy, parity) of different labels give, part by part. postings: how many there are in all."""
    tasks = int(classes.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    parts = max(tasks, min(16 * tasks, postings // LEAST_POSTINGS), postings // PART_POSTINGS)
    dealt = classes.select("c", "label", "n", "short", "light", "heavy", "parity").mapInArrow(lean(_deal(parts, give == NEAREST)), "part int, rows binary, heavy boolean")
    meet = _meetings(percent, give)

    def grouped(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from lean(meet)(batches)

    return dealt.groupBy("part").applyInArrow(grouped, "x long, y long, nx long, ny long, k long")


def _often(met: DataFrame, percent: int) -> DataFrame:
    return met.groupBy("x", "y", "nx", "ny").agg(F.sum("k").alias("k")).where(F.col("k") >= needed_meetings("nx", "ny", percent)).select("x", "y")


def met_pairs(classes: DataFrame, postings: int, percent: int) -> DataFrame:
    """Every candidate pair (x, y) of classes of different labels: those that meet in enough short lists."""
    return _often(_met(classes, postings, percent, ALL), percent)


def nearest_pairs(classes: DataFrame, postings: int, percent: int) -> DataFrame:
    """Only each class's nearest one in each list of a shingle that has a level."""
    return _met(classes, postings, percent, NEAREST).select("x", "y").distinct()


def met_groups(classes: DataFrame, postings: int, percent: int) -> tuple[DataFrame, DataFrame]:
    """Candidates, as pairs (x, y) that meet often enough in lists of shingles that are not shared, and as groups (c, group) of classes that any meetings in the other lists
    connect: a pair that can be linked is one of the pairs, or both of its classes are in one group."""
    met = written(_met(classes, postings, percent, FOREST), "met")
    found = written(components(met.where("k = 0").select(F.col("x").alias("u"), F.col("y").alias("v"))), "found")
    groups = found.select(F.col("node").alias("c"), F.col("label").alias("group")).unionAll(found.select(F.col("label").alias("c"), F.col("label").alias("group")).distinct())
    return _often(met.where("k > 0"), percent), groups


def _spanning(percent: int):
    """Links (u, v) that connect the labels in one cell (c, label, n, short, parity, side, whole) as all of its links do: its lists are looked up and merged, and the pairs that meet
    often enough are probed, unless links before them connect their labels."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cell = pa.Table.from_batches(list(batches))
        c, label, n, side = (cell[k].to_numpy() for k in ("c", "label", "n", "side"))
        if not len(c) or label.min() == label.max():
            return
        short, whole = ([np.frombuffer(v.as_buffer(), np.uint64) for v in cell[k]] for k in ("short", "whole"))
        parity = cell["parity"].combine_chunks().flatten().to_numpy().reshape(-1, PARITY // 64)
        many = np.array([len(v) for v in short])
        of = np.repeat(np.arange(len(c)), many)
        rows = np.zeros(len(of), HEAVY)
        rows["h"], rows["c"], rows["label"], rows["n"], rows["side"] = np.concatenate(short), c[of], label[of], n[of], side[of]
        rows["place"] = np.arange(len(of)) - np.repeat(np.cumsum(many) - many, many)
        rows["parity"] = np.ascontiguousarray(parity).view(HEAVY["parity"])[:, 0][of]
        met = list(_looked_up(rows, percent, ALL))
        if not met:
            return
        x, y, nx, ny, k = (np.concatenate([b.column(i).to_numpy() for b in met]) for i in range(5))
        order = np.lexsort((y, x))
        x, y, nx, ny, k = (v[order] for v in (x, y, nx, ny, k))
        first = np.flatnonzero(np.append(True, (x[1:] != x[:-1]) | (y[1:] != y[:-1])))
        x, y, nx, ny, k = x[first], y[first], nx[first], ny[first], np.add.reduceat(k, first)
        total = least_overlap(nx, ny, percent)
        often = np.flatnonzero(k >= np.minimum(np.minimum(extra(nx), extra(ny)), total))
        at, up = {v: i for i, v in enumerate(c.tolist())}, {v: v for v in label.tolist()}

        def top(v: int) -> int:
            while up[v] != v:
                up[v] = v = up[up[v]]
            return v

        u, v = [], []
        for i in often[np.argsort(-k[often], kind="stable")].tolist():
            p, q = at[x[i]], at[y[i]]
            a, b = top(label[p]), top(label[q])
            if a != b and overlap(whole[p], whole[q]) >= total[i]:
                up[max(a, b)] = min(a, b)
                u.append(x[i]), v.append(y[i])
        yield pa.RecordBatch.from_arrays([pa.array(u, pa.int64()), pa.array(v, pa.int64())], names=["u", "v"])

    return work


def spanning_links(groups: DataFrame, total: int, classes: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """Links (u, v) between classes of one group that connect what all of them do. groups: c, n, group; total: the sum of n; classes: c, label, short, parity; sets: c, whole.

    A group has blocks of GROUP_BLOCK shingles on average, and a cell for each block and each two of them; small groups share cells."""
    cells = max(int(classes.sparkSession.conf.get("spark.sql.shuffle.partitions")), total // GROUP_BLOCK)
    sizes = groups.groupBy("group").agg(F.ceil(F.sum("n") / GROUP_BLOCK).cast("int").alias("blocks"))
    key = F.when(F.col("blocks") == 1, F.pmod(F.xxhash64("group"), F.lit(cells))).otherwise(F.col("group"))
    own = groups.join(sizes, "group").select("c", "n", "blocks", key.alias("key"), F.pmod(F.xxhash64("c"), F.col("blocks")).cast("int").alias("block"))
    rows = own.join(classes.select("c", "label", "short", "parity"), "c").join(sets, "c").withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    side = F.when(F.col("block") == F.col("other"), 0).when(F.col("block") < F.col("other"), 1).otherwise(2)
    rows = rows.select("key", F.least("block", "other").alias("low"), F.greatest("block", "other").alias("high"), "c", "label", "n", "short", "parity", side.alias("side"), "whole")
    span = _spanning(percent)

    def spanned(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from lean(span)(batches)

    return written(rows.groupBy("key", "low", "high").applyInArrow(spanned, "u long, v long"), "links")


def needed_meetings(nx: str, ny: str, percent: int) -> Column:
    """In how many lists that are short for both a pair must meet: l, as each has T - l long ones, or T if that is less."""
    total = F.ceil(F.lit(percent) * (F.col(nx) + F.col(ny)) / F.lit(100 + percent))
    least = lambda n: F.lit(1) + F.floor(F.col(n) / 32)  # noqa: E731  extra()
    return F.least(least(nx), least(ny), total)


def sieved(pairs: DataFrame, classes: DataFrame, percent: int) -> DataFrame:
    """Pairs (x, y) whose sets can't differ by too much, with a document of each (xid, yid): each element flips one of 1024 bits of its set's parity, so the
    parities differ in no more bits than the sets do in elements. classes: c, id, n, parity."""
    of = lambda c: classes.select(F.col("c").alias(c), F.col("id").alias(f"{c}id"), F.col("n").alias(f"n{c}"), F.col("parity").alias(f"p{c}"))
    both = pairs.join(of("x"), "x").join(of("y"), "y")
    apart = F.aggregate(F.zip_with("px", "py", lambda a, b: F.bit_count(a.bitwiseXOR(b))), F.lit(0), lambda s, v: s + v)
    total = F.ceil(F.lit(percent) * (F.col("nx") + F.col("ny")) / F.lit(100 + percent))
    return both.where(apart <= F.col("nx") + F.col("ny") - 2 * total).select("x", "y", "xid", "yid")


def labelled(classes: DataFrame, links: DataFrame) -> DataFrame:
    """classes with label: the smallest class that links reach."""
    found = components(links)
    return classes.join(found, classes["c"] == found["node"], "left").withColumn("label", F.coalesce("label", "c")).drop("node")


def classified(docs: DataFrame, words: int, percent: int) -> tuple[DataFrame, DataFrame, int]:
    """Of documents: doc_id, n, c; of classes: c, id (the smallest doc_id) and what sketched() gives; the number of postings."""
    bits, fine = slot_bits(docs, MOST_SLOTS), slot_bits(docs, MOST_SHARED, SHARED_BITS)
    counts = written(shingle_counts(docs, words, fine), "counts")
    level = levels_of(counts.withColumn("slot", F.shiftright("slot", fine - bits)), bits)
    base = written(sketched(docs, words, percent, level, _bits(counts, "slot", fine)), "sketches")
    own = ["n", "bands", "short", "light", "heavy", "parity"]
    first = F.min(F.struct(F.isnull("doc_id").alias("none"), "doc_id", *own)).alias("first")
    classes = base.where("c IS NOT NULL").groupBy("c").agg(first).select("c", F.col("first.doc_id").alias("id"), *[f"first.{c}" for c in own])
    return base.select("doc_id", "n", "c"), *counted(classes, "classes", F.octet_length("short") / 8)


def _typed(docs: DataFrame) -> DataFrame:
    text_batches(docs.sparkSession)
    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string"))


def links(docs: DataFrame, words: int = 5, percent: int = 80) -> DataFrame:
    """u, v: every pair of classes that are linked, each class as the smallest doc_id of its documents. n near copies of each other have n (n - 1) / 2 links; joined()
    doesn't list them."""
    docs = _typed(docs)
    _, classes, postings = classified(docs, words, percent)
    candidates = written(sieved(met_pairs(classes.withColumn("label", F.col("c")), int(postings), percent), classes, percent), "pairs")
    sets = written(whole_sets(docs, ends(candidates), words), "sets")
    found, of = probed(candidates, sets, percent), classes.select("c", "id")
    ids = found.join(of.select(F.col("c").alias("u"), F.col("id").alias("a")), "u").join(of.select(F.col("c").alias("v"), F.col("id").alias("b")), "v")
    return ids.select(F.least("a", "b").alias("u"), F.greatest("a", "b").alias("v"))


def joined(docs: DataFrame, words: int = 5, percent: int = 80) -> DataFrame:
    """doc_id, n_shingles, component_id, class_id of every document (doc_id, text)."""
    docs = _typed(docs)
    with passing(docs.sparkSession):
        members, of = _grouped(docs, words, percent)
    out = members.join(of, F.col("c") == F.col("__c"), "left")
    return out.select("doc_id", F.col("n").alias("n_shingles"), F.coalesce("component_id", "doc_id").alias("component_id"), F.coalesce("class_id", "doc_id").alias("class_id"))


def _grouped(docs: DataFrame, words: int, percent: int) -> tuple[DataFrame, DataFrame]:
    """doc_id, n, c of documents; __c, component_id, class_id of classes."""
    base, classes, postings = classified(docs, words, percent)

    def confirmed(pairs: DataFrame) -> DataFrame:
        pairs = written(sieved(pairs, classes, percent), "pairs")
        return probed(pairs, written(whole_sets(docs, ends(pairs), words), "sets"), percent)

    found = confirmed(banded_pairs(classes))
    found = found.unionAll(confirmed(nearest_pairs(labelled(classes, found), int(postings), percent)))
    apart = classes.join(written(labelled(classes.select("c"), found), "labels"), "c")
    pairs, groups = met_groups(apart, int(postings), percent)
    pairs = written(sieved(pairs, classes, percent), "pairs")
    groups, total = counted(groups.join(classes.select("c", "id", "n"), "c"), "groups", F.col("n"))
    sets = written(whole_sets(docs, ends(pairs).unionAll(groups.select("c", "id")), words), "sets")
    found = found.unionAll(probed(pairs, sets, percent)).unionAll(spanning_links(groups, int(total), apart, sets, percent))
    groups = written(labelled(classes.select("c", "id"), found), "groups")
    smallest = groups.groupBy("label").agg(F.min("id").alias("component_id"))
    of = groups.join(smallest, "label").select(F.col("c").alias("__c"), "component_id", F.col("id").alias("class_id"))
    return written(base, "members", lasts=True), written(of, "of", lasts=True)  # so that the join can split a hot class


def op10_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    return joined(table(spark, sf_dir, "documents"), words=4, percent=85).select("doc_id", "n_shingles", "component_id")


QUERIES = {"op10_jaccard": op10_jaccard}
ORACLE_SQL = {
    "op10_jaccard": """
WITH RECURSIVE words AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents),
shingles AS (
  SELECT DISTINCT doc_id, unnest(CASE WHEN len(w) >= 4 THEN list_transform(range(1, len(w) - 2), lambda i: array_to_string(w[i:i + 3], ' '))
    WHEN len(w) > 0 THEN [array_to_string(w, ' ')] ELSE [] END) AS s FROM words),
sizes AS (SELECT doc_id, count(*) AS n FROM shingles GROUP BY doc_id),
shared AS (SELECT a.doc_id AS u, b.doc_id AS v, count(*) AS k FROM shingles a JOIN shingles b ON a.s = b.s AND a.doc_id <> b.doc_id GROUP BY 1, 2),
links AS (SELECT u, v FROM shared JOIN sizes x ON x.doc_id = u JOIN sizes y ON y.doc_id = v WHERE 100 * k >= 85 * (x.n + y.n - k)),
reach(doc_id, c) AS (SELECT doc_id, doc_id FROM documents UNION SELECT l.v, r.c FROM reach r JOIN links l ON l.u = r.doc_id),
least AS (SELECT doc_id, min(c) AS component_id FROM reach GROUP BY doc_id)
SELECT d.doc_id, coalesce(n, 0)::BIGINT AS n_shingles, component_id FROM documents d JOIN least USING (doc_id) LEFT JOIN sizes USING (doc_id)"""
}
