"""Suffix-array dedup: bytes covered by a long string that also starts elsewhere, by external induced sorting.

Strings of `length` bytes must meet wherever they are, so texts are first cut into regions by content: of the hashes of all
runs of about a third of `length` bytes inside a string, the smallest (the last of equals) is the string's anchor; strings with one anchor start side by side
and make a region. Equal strings have equal anchors, so an anchor that occurs once can't repeat anything. The regions
of the others, each distinct one once with the number of times it occurs, are dealt by anchor to shards, as many as their bytes need. A shard's
regions are one text, sorted with common prefixes by `induced`; neighbours in that order that share `length` bytes are one
string, which repeats if the regions that hold it occur more than once in all. Starts of repeated strings go back
to the texts by region, and each text unites what they cover.

The sorter's queues go to disk beyond BUDGET, in a temporary file of their task. A shard's text, weights, types and names are in memory, some 60 bytes for each of its own; shards have SHARD_BYTES on average
and an anchor at most HOT regions there, of under 2 x `length` bytes each unless the text is periodic, so that is bounded however large the input is. The group of an anchor with over HOT distinct regions could outgrow any
task; its regions are cut into cells of 32 starts, dealt by 128-bit hashes of what a cell's strings have in common. Where cells of one
hash differ, their strings' own hashes are compared: together if they are few, else dealt one by one; all with partial sums.

Defined results: a null text is empty; texts under `length` bytes never lose a byte; repeated rows are repeated texts, of
which each loses what they share; rows are kept one for one, whatever their ids; very long texts are worked on whole; clashing columns are replaced; an empty table gives an empty one.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, functions as F

from cloakframe.llm.common import counted, lean, passing, slices, table, text_batches, utf8_views, written
from cloakframe.llm.induced import repeated
from cloakframe.llm.shingles import mix, powers, word_bounds

LENGTH = 400
#: Words of a passage.
PASSAGE = 51
#: An anchor with more distinct regions than this is dealt by string.
HOT, CELL = 256, 32
#: Cells of one key that are looked at together; those of a key with more are taken apart.
TOGETHER = 512
PART = 1 << 19
_PLACE = np.uint64((1 << 24) - 1)
#: Starts of a text that are looked at together; a longer text gives regions that end there.
STRETCH = 1 << 23
#: Bytes of queues that a sorter keeps in memory; bytes of regions that a shard has on average.
BUDGET, SHARD_BYTES = 1 << 27, 1 << 20
#: Bytes of hashes of word runs that are compared together, on average.
RUN_BYTES = 1 << 22


def _totals(raw: np.ndarray, seed: int = 1) -> tuple[np.ndarray, np.ndarray]:
    """Running sums from which the hash of any run of bytes follows; another seed gives other hashes."""
    power, inverse = powers(len(raw) + 1)
    codes = raw.astype(np.uint64) + np.uint64(1) if seed == 1 else mix(raw.astype(np.uint64) + np.uint64(seed << 8))
    total = np.zeros(len(raw) + 1, np.uint64)
    np.cumsum(codes * power[:-1], out=total[1:])
    return total, inverse


def _run_hash(totals: tuple[np.ndarray, np.ndarray], start: np.ndarray, end: np.ndarray) -> np.ndarray:
    total, inverse = totals
    return mix((total[end] - total[start]) * inverse[start])


def _last_minimum(h: np.ndarray, window: int) -> np.ndarray:
    """For each run of `window` values the place of the one with the smallest 40 high bits, the last of equals. At most 2^24 values."""
    n = len(h) - window + 1
    key = (h & ~_PLACE) | (_PLACE - np.arange(len(h), dtype=np.uint64))
    rows = np.append(key, np.full(-len(h) % window, ~np.uint64(0))).reshape(-1, window)
    ahead = np.minimum.accumulate(rows, axis=1).ravel()
    behind = np.minimum.accumulate(rows[:, ::-1], axis=1)[:, ::-1].ravel()
    return (_PLACE - (np.minimum(behind[:n], ahead[window - 1 : window - 1 + n]) & _PLACE)).astype(np.int64)


def gram(length: int) -> int:
    """The bytes of the runs among which a string's anchor is chosen."""
    return max(1, length * 8 // 25)


def regions(raw: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """First start, number of starts, anchor hash and number of places of the anchor, of each region of one text.
    Neighbours with equal anchors (periodic text) are one region, in which the anchor has several places."""
    n = len(raw) - length + 1
    if n <= 0:
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.uint64), np.zeros(0, np.int64)
    if n > STRETCH:
        parts = [(i, regions(raw[i : i + STRETCH + length - 1], length)) for i in range(0, n, STRETCH)]
        return tuple(np.concatenate([p[c] + i if c == 0 else p[c] for i, p in parts]) for c in range(4))
    k = gram(length)
    at = np.arange(len(raw) - k + 1)
    h = _run_hash(_totals(raw), at, at + k)
    anchor = _last_minimum(h, length - k + 1)
    value = h[anchor]
    start = np.flatnonzero(np.append(True, value[1:] != value[:-1]))
    places = np.add.reduceat(np.append(True, anchor[1:] != anchor[:-1]).astype(np.int64), start)
    return start, np.diff(np.append(start, n)), value[start], places


def text_key() -> list:
    return [F.xxhash64("text").alias("t"), F.octet_length("text").alias("len")]


def found_regions(docs: DataFrame, length: int) -> DataFrame:
    """doc_id, t, len, start, n, h, k, g1, g2: every region, with its anchor's hash and places and the 128-bit digest of its bytes."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, "text", PART):
                raw, off = utf8_views(part.column("text"))
                row, cols, digests = [], [[], [], [], []], []
                for i in np.flatnonzero(np.diff(off) >= length).tolist():
                    one = raw[off[i] : off[i + 1]]
                    found = regions(one, length)
                    row.append(np.full(len(found[0]), i))
                    for c, x in zip(cols, found, strict=True):
                        c.append(x)
                    view = memoryview(np.ascontiguousarray(one))
                    digests += [hashlib.blake2b(view[a : a + n + length - 1], digest_size=16).digest() for a, n in zip(found[0].tolist(), found[1].tolist(), strict=True)]
                if not row:
                    continue
                where = pa.array(np.concatenate(row))
                g = np.frombuffer(b"".join(digests), np.int64).reshape(-1, 2)
                start, n, h, k = map(np.concatenate, cols)
                yield pa.RecordBatch.from_arrays(
                    [*(part.column(c).take(where) for c in ("doc_id", "t", "len")), pa.array(start.astype(np.int32)), pa.array(n.astype(np.int32)), pa.array(h.view(np.int64)), pa.array(k.astype(np.int32)), pa.array(g[:, 0].copy()), pa.array(g[:, 1].copy())],
                    names=["doc_id", "t", "len", "start", "n", "h", "k", "g1", "g2"],
                )

    return docs.select("doc_id", "text", *text_key()).mapInArrow(lean(work), "doc_id long, t long, len int, start int, n int, h long, k int, g1 long, g2 long")


def region_bytes(docs: DataFrame, groups: DataFrame, length: int) -> DataFrame:
    """groups (g1, g2, h, n, m, hot, and one place: doc_id, t, len, start) with the regions' bytes."""
    per_text = groups.groupBy("doc_id", "t", "len").agg(F.collect_list(F.struct("start", "n", "h", "g1", "g2", "m", "hot")).alias("list"))
    keyed = docs.select("doc_id", "text", *text_key()).where(F.col("len") >= length).alias("d")
    same = F.col("d.doc_id").eqNullSafe(F.col("p.doc_id")) & (F.col("d.t") == F.col("p.t")) & (F.col("d.len") == F.col("p.len"))
    both = keyed.join(per_text.alias("p"), same).select("d.text", "p.list")

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ("n", "h", "g1", "g2", "m", "hot")
        for batch in batches:
            for part in slices(batch, "text", 1 << 21):
                raw, off = utf8_views(part.column("text"))
                view, lists = memoryview(np.ascontiguousarray(raw)), part.column("list")
                items = lists.flatten()
                text = np.repeat(np.arange(part.num_rows), np.diff(lists.offsets.to_numpy()))
                start = items.field("start").to_numpy() + off[text]
                size = items.field("n").to_numpy() + (length - 1)
                data = [bytes(view[a : a + k]) for a, k in zip(start.tolist(), size.tolist(), strict=True)]
                yield pa.RecordBatch.from_arrays([*(items.field(c) for c in names), pa.array(data, pa.binary())], names=[*names, "data"])

    return both.mapInArrow(lean(work), "n int, h long, g1 long, g2 long, m long, hot boolean, data binary")


def _runs(flags: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    edges = np.flatnonzero(np.diff(np.concatenate([[0], flags.astype(np.int8), [0]])))
    return edges[0::2], edges[1::2]


def _sorted_shard(length: int, budget: int):
    """A shard's regions to the runs of repeated starts of each: g1, g2, first, last (start offsets, last excluded)."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen, keys, weights, parts = set(), [], [], []
        for batch in batches:
            raw, off = utf8_views(batch.column("data"))
            for i, (g1, g2, m) in enumerate(zip(*(batch.column(c).to_pylist() for c in ("g1", "g2", "m")), strict=True)):
                if (g1, g2) not in seen:  # a repeated row of the table gives its regions twice
                    seen.add((g1, g2)), keys.append((g1, g2)), weights.append(m)
                    parts += [raw[off[i] : off[i + 1]].astype(np.uint16) + np.uint16(1), np.zeros(1, np.uint16)]
        if not keys:
            return
        text = np.concatenate(parts)
        size = np.array([len(p) for p in parts[0::2]])
        first = np.concatenate([[0], np.cumsum(size + 1)[:-1]])
        valid = np.ones(len(text), bool)
        for k in range(length):
            valid[first + size - k] = False
        weight = np.where(valid, np.repeat(np.array(weights, np.int64), size + 1), 0)
        a, b = _runs(repeated(text, weight, valid, length, budget))
        which = np.searchsorted(first, a, side="right") - 1
        pairs = np.array(keys, np.int64).reshape(-1, 2)[which]
        yield pa.RecordBatch.from_arrays([pa.array(pairs[:, 0].copy()), pa.array(pairs[:, 1].copy()), pa.array((a - first[which]).astype(np.int32)), pa.array((b - first[which]).astype(np.int32))], names=["g1", "g2", "first", "last"])

    return work


def _hot_cells(length: int):
    """The regions of hot anchors in cells: strings whose anchor lies in them at one of CELL places. Of each cell its key (the bytes that all
    strings of the cell have in common, and the place), a digest of all its bytes, and its strings' own hashes."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            cols = [[] for _ in range(6)]
            hashes, row = [], []
            raw, off = utf8_views(batch.column("data"))
            for i in range(batch.num_rows):
                one = raw[off[i] : off[i + 1]]
                totals = [_totals(one, seed) for seed in (1, 2)]
                s = np.arange(len(one) - length + 1)
                k = gram(length)
                at = np.arange(len(one) - k + 1)
                anchor = _last_minimum(_run_hash(totals[0], at, at + k), length - k + 1)
                place = (anchor - s) // CELL
                first = np.flatnonzero(np.append(True, (anchor[1:] != anchor[:-1]) | (place[1:] != place[:-1])))
                last = np.append(first[1:], len(s))
                core = anchor[first] - CELL * place[first]
                for c, t in zip(cols, totals, strict=False):
                    c.append(mix(_run_hash(t, core, core - CELL + 1 + length) + place[first].astype(np.uint64)))
                for c, t in zip(cols[2:], totals, strict=False):
                    c.append(_run_hash(t, first, last - 1 + length))
                cols[4].append(first)
                cols[5].append(last)
                both = np.stack([_run_hash(t, s, s + length) for t in totals], axis=1)
                hashes += [both[a:b].tobytes() for a, b in zip(first.tolist(), last.tolist(), strict=True)]
                row.append(np.full(len(first), i))
            if row:
                k1, k2, d1, d2, first, last = map(np.concatenate, cols)
                take = pa.array(np.concatenate(row))
                yield pa.RecordBatch.from_arrays(
                    [*(pa.array(x.view(np.int64)) for x in (k1, k2, d1, d2)), *(batch.column(c).take(take) for c in ("g1", "g2", "m")), pa.array(first.astype(np.int32)), pa.array(last.astype(np.int32)), pa.array(hashes, pa.binary())],
                    names=["k1", "k2", "d1", "d2", "g1", "g2", "m", "first", "last", "strings"],
                )

    return work


CELL_KEY = ["k1", "k2", "d1", "d2"]
_KEYS = "k1 long, k2 long, d1 long, d2 long"


def _each_string(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Cells to single strings."""
    for batch in batches:
        raw, off = utf8_views(batch.column("strings"))
        both, count = np.frombuffer(raw.tobytes(), np.int64).reshape(-1, 2), np.diff(off) // 16
        row = np.repeat(np.arange(batch.num_rows), count)
        place = np.arange(len(row)) - np.repeat(np.cumsum(count) - count, count)
        take = pa.array(row)
        yield pa.RecordBatch.from_arrays([pa.array(both[:, 0].copy()), pa.array(both[:, 1].copy()), pa.array(place.astype(np.int32)), *(batch.column(c).take(take) for c in (*CELL_KEY, "m"))], names=["w1", "w2", "a", *CELL_KEY, "m"])


def _few_cells(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Runs of repeated strings among distinct cells that are looked at together."""
    rows = pa.Table.from_batches(list(batches)).combine_chunks()
    raw, off = utf8_views(rows.column("strings"))
    count = np.diff(off) // 16
    row = np.repeat(np.arange(len(count)), count)
    both = np.frombuffer(raw.tobytes(), np.dtype([("a", "<u8"), ("b", "<u8")]))
    order = np.lexsort((both["b"], both["a"]))
    ordered = both[order]
    first = np.flatnonzero(np.append(True, ordered[1:] != ordered[:-1]))
    many = np.add.reduceat(rows.column("m").to_numpy()[row[order]], first) > 1
    repeats = np.zeros(len(row), bool)
    repeats[order] = np.repeat(many, np.diff(np.append(first, len(row))))
    start = np.cumsum(count) - count
    a, b = _runs(np.insert(repeats, start, False))  # a gap before each cell, so that no run goes on in the next one
    gap = start + np.arange(len(start))
    which = np.searchsorted(gap, a, side="right") - 1
    take = pa.array(which)
    yield pa.RecordBatch.from_arrays([*(rows.column(c).take(take).combine_chunks() for c in CELL_KEY), pa.array((a - gap[which] - 1).astype(np.int32)), pa.array((b - gap[which] - 1).astype(np.int32))], names=[*CELL_KEY, "a", "b"])


def _few(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    yield from lean(_few_cells)(batches)


def hot_runs(data: DataFrame, length: int, parts: int) -> DataFrame:
    """g1, g2, runs (of repeated starts) of the regions of hot anchors. A cell that is the only one of its key repeats whole if it occurs twice;
    the strings of different cells of one key are compared."""
    cells = written(data.mapInArrow(lean(_hot_cells(length)), f"{_KEYS}, g1 long, g2 long, m long, first int, last int, strings binary"), "cells")
    distinct = cells.groupBy(*CELL_KEY).agg(F.sum("m").alias("m"), F.min("strings").alias("strings"))
    keys = cells.groupBy(*CELL_KEY).agg(F.sum("m").alias("m")).groupBy("k1", "k2").agg(F.sum("m").alias("all"), F.count("*").alias("n")).where("all > 1")
    known = written(distinct.join(keys, ["k1", "k2"]), "known")
    same = known.where("n = 1").select(*CELL_KEY, F.lit(0).alias("a"), (F.octet_length("strings") / 16).cast("int").alias("b"))
    some = known.where(F.col("n").between(2, TOGETHER)).select(F.pmod(F.xxhash64("k1", "k2"), F.lit(parts)).cast("int").alias("part"), *CELL_KEY, "m", "strings")
    few = some.groupBy("part").applyInArrow(_few, f"{_KEYS}, a int, b int")
    strings = known.where(F.col("n") > TOGETHER).select(*CELL_KEY, "m", "strings").mapInArrow(lean(_each_string), f"w1 long, w2 long, a int, {_KEYS}, m long")
    again = strings.groupBy("w1", "w2").agg(F.sum("m").alias("k")).where("k > 1").select("w1", "w2")
    single = strings.join(again, ["w1", "w2"], "left_semi").select(*CELL_KEY, "a", (F.col("a") + 1).alias("b"))
    # written, so that the join below can split a cell that very many regions have
    packed = written(same.unionAll(few).unionAll(single).groupBy(*CELL_KEY).agg(F.collect_list(F.struct("a", "b")).alias("runs")), "packed")
    moved = F.transform("runs", lambda r: F.struct((F.col("first") + r["a"]).alias("first"), (F.col("first") + r["b"]).alias("last")))
    return cells.select(*CELL_KEY, "g1", "g2", "first").join(packed, CELL_KEY).select("g1", "g2", moved.alias("runs"))


def removed_ranges(docs: DataFrame, length: int = LENGTH, budget: int = BUDGET) -> DataFrame:
    """t, len and covers (list of from, to: bytes covered by repeated strings, may overlap) of every text that loses bytes."""
    spark = docs.sparkSession
    text_batches(spark)
    tasks = int(spark.conf.get("spark.sql.shuffle.partitions"))
    every = written(found_regions(docs, length), "regions")
    # what is joined below is written first: a join can split a hot key only if both of its sides come from shuffles of its own
    twice = written(every.groupBy("h").agg(F.sum("k").alias("k")).where("k > 1").select("h"), "twice")
    candidates = written(every.join(twice, "h", "left_semi"), "candidates")
    groups = candidates.groupBy("h", "g1", "g2", "n").agg(F.count("*").alias("m"), F.min(F.struct("doc_id", "t", "len", "start")).alias("at"))
    groups = written(groups.select("h", "g1", "g2", "n", "m", "at.*"), "groups")
    hot = written(groups.groupBy("h").agg((F.count("*") > HOT).alias("hot")), "hot")
    data, size = counted(region_bytes(docs, groups.join(hot, "h"), length), "bytes", F.octet_length("data"))
    sort = _sorted_shard(length, budget)

    def grouped(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from lean(sort)(batches)

    cool = data.where("NOT hot").select(F.pmod(F.xxhash64("h"), F.lit(max(8 * tasks, size // SHARD_BYTES))).cast("int").alias("shard"), "g1", "g2", "m", "data")
    by_sorting = cool.groupBy("shard").applyInArrow(grouped, "g1 long, g2 long, first int, last int").select("g1", "g2", F.array(F.struct("first", "last")).alias("runs"))
    by_string = hot_runs(data.where("hot").select("g1", "g2", "m", "data"), length, 4 * tasks)
    runs = written(by_sorting.unionAll(by_string), "runs")
    packed = runs.groupBy("g1", "g2").agg(F.flatten(F.collect_list("runs")).alias("runs"))
    # copies of a text give the same rows; one of each is enough, and is what the partial aggregation leaves
    places = candidates.groupBy("t", "len", "start", "g1", "g2").agg(F.lit(1).alias("one"))
    covers = F.transform("runs", lambda r: F.struct((F.col("start") + r["first"]).alias("a"), (F.col("start") + r["last"] + (length - 1)).alias("b")))
    return places.join(packed, ["g1", "g2"]).select("t", "len", covers.alias("covers")).groupBy("t", "len").agg(F.flatten(F.collect_list("covers")).alias("covers"))


def word_regions(raw: np.ndarray, off: np.ndarray, words: int, length: int) -> tuple[np.ndarray, ...]:
    """Row, first byte (from the row's start), bytes, anchor hash and number of places of the anchor, of each region of runs of `words` words that have
    under `length` bytes. A run's anchor is the smallest hash of the quarters of it that start at a word; neighbours with equal anchors are one region."""
    start, end = word_bounds(raw, off)
    n, gram = len(start) - words + 1, max(1, words // 4)
    if n <= 0:
        return tuple(np.zeros(0, t) for t in (np.int64, np.int64, np.int64, np.uint64, np.int64))
    row = np.searchsorted(off, start, side="right") - 1
    ok = (row[:n] == row[words - 1 :]) & (end[words - 1 :] - start[:n] < length)
    h = _run_hash(_totals(raw), start[: len(start) - gram + 1], end[gram - 1 :])
    over = words - gram + 1
    anchor = np.concatenate([_last_minimum(h[i : min(i + STRETCH, n) + over - 1], over) + i for i in range(0, n, STRETCH)])
    value = h[anchor]
    new = np.ones(n, bool)
    new[1:] = (value[1:] != value[:-1]) | (row[1:n] != row[: n - 1]) | (ok[1:] != ok[:-1])
    new[::STRETCH] = True
    first = np.flatnonzero(new)
    places = np.add.reduceat(np.append(True, anchor[1:] != anchor[:-1]).astype(np.int64) | new, first)
    last = np.append(first[1:], n) - 1
    keep = ok[first]
    first, last, places = first[keep], last[keep], places[keep]
    return row[first], start[first] - off[row[first]], end[last + words - 1] - start[first], value[first], places


def _run_rows(rows: pa.RecordBatch | pa.Table) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Of regions with their runs' hashes: each run's row, hash, first and last byte."""
    raw, off = utf8_views(rows.column("strings"))
    row = np.repeat(np.arange(rows.num_rows), np.diff(off) // 16)
    places = (rows.column(c).combine_chunks() if isinstance(rows, pa.Table) else rows.column(c) for c in ("a", "b"))
    return row, np.frombuffer(raw.tobytes(), np.dtype([("a", "<i8"), ("b", "<i8")])), *(x.flatten().to_numpy() for x in places)


def _compared_runs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of regions that are looked at together, those runs of regions with m = 1 that another region has too, or the same one elsewhere."""
    rows = pa.Table.from_batches(list(batches)).combine_chunks()
    row, both, a, b = _run_rows(rows)
    if not len(row):
        return
    m = rows.column("m").to_numpy()[row]
    order = np.lexsort((both["b"], both["a"]))
    ordered = both[order]
    first = np.flatnonzero(np.append(True, ordered[1:] != ordered[:-1]))
    repeats = np.zeros(len(row), bool)
    repeats[order] = np.repeat(np.add.reduceat(m[order], first) > 1, np.diff(np.append(first, len(row))))
    found = np.flatnonzero(repeats & (m == 1))
    take = pa.array(row[found])
    yield pa.RecordBatch.from_arrays([*(rows.column(c).take(take).combine_chunks() for c in ("g1", "g2")), pa.array(a[found]), pa.array(b[found])], names=["g1", "g2", "a", "b"])


def _each_run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Regions to single runs."""
    for batch in batches:
        row, both, a, b = _run_rows(batch)
        take = pa.array(row)
        yield pa.RecordBatch.from_arrays([pa.array(both["a"].copy()), pa.array(both["b"].copy()), *(batch.column(c).take(take) for c in ("g1", "g2", "m")), pa.array(a), pa.array(b)], names=["w1", "w2", "g1", "g2", "m", "a", "b"])


def repeated_words(docs: DataFrame, words: int, length: int) -> DataFrame:
    """t, len and covers, as removed_ranges(), of runs of `words` whole words that have under `length` bytes and also start elsewhere.

    Regions by anchor as for strings of bytes: one that occurs twice repeats whole; where an anchor has several distinct regions their runs are compared by 128-bit
    hashes, in parts of about RUN_BYTES of them; those of an anchor with over TOGETHER regions are dealt one by one, with partial sums."""

    def found(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, "text", PART):
                raw, off = utf8_views(part.column("text"))
                row, start, size, h, k = word_regions(raw, off, words, length)
                view, at = memoryview(np.ascontiguousarray(raw)), off[row] + start
                g = np.frombuffer(b"".join(hashlib.blake2b(view[x : x + y], digest_size=16).digest() for x, y in zip(at.tolist(), size.tolist(), strict=True)), np.int64).reshape(-1, 2)
                where = pa.array(row)
                yield pa.RecordBatch.from_arrays(
                    [*(part.column(c).take(where) for c in ("doc_id", "t", "len")), pa.array(start.astype(np.int32)), pa.array(size.astype(np.int32)), pa.array(h.view(np.int64)), pa.array(k.astype(np.int32)), pa.array(g[:, 0].copy()), pa.array(g[:, 1].copy())],
                    names=["doc_id", "t", "len", "start", "n", "h", "k", "g1", "g2"],
                )

    def runs_of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, "data", PART):
                raw, off = utf8_views(part.column("data"))
                start, end = word_bounds(raw, off)
                row = np.searchsorted(off, start, side="right") - 1
                a, b = start[: max(0, len(start) - words + 1)], end[words - 1 :]
                same = row[: len(a)] == row[words - 1 :]
                a, b, row = a[same], b[same], row[: len(a)][same]
                view = memoryview(np.ascontiguousarray(raw))
                w = b"".join(hashlib.blake2b(view[x:y], digest_size=16).digest() for x, y in zip(a.tolist(), b.tolist(), strict=True))
                at = np.append(0, np.cumsum(np.bincount(row, minlength=part.num_rows))).astype(np.int32)
                lists = [pa.ListArray.from_arrays(pa.array(at), pa.array((x - off[row]).astype(np.int32))) for x in (a, b)]
                strings = pa.Array.from_buffers(pa.binary(), part.num_rows, [None, pa.py_buffer(at * np.int32(16)), pa.py_buffer(w)])
                yield pa.RecordBatch.from_arrays([*(part.column(c) for c in ("h", "g1", "g2", "m", "hot")), strings, *lists], names=["h", "g1", "g2", "m", "hot", "strings", "a", "b"])

    def compared(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from lean(_compared_runs)(batches)

    every = written(docs.select("doc_id", "text", *text_key()).mapInArrow(lean(found), "doc_id long, t long, len int, start int, n int, h long, k int, g1 long, g2 long"), "word-regions")
    twice = written(every.groupBy("h").agg(F.sum("k").alias("k")).where("k > 1").select("h"), "twice")
    candidates = written(every.join(twice, "h", "left_semi"), "candidates")
    groups = candidates.groupBy("h", "g1", "g2", "n").agg(F.count("*").alias("m"), F.max("k").alias("k"), F.min(F.struct("doc_id", "t", "len", "start")).alias("at"))
    groups = written(groups.select("h", "g1", "g2", "n", "m", "k", "at.*"), "groups")
    mixed = groups.groupBy("h").agg(F.count("*").alias("groups"), F.max("k").alias("places")).where("groups > 1 OR places > 1")
    mixed = written(mixed.select("h", (F.col("groups") > TOGETHER).alias("hot")), "mixed")
    # regions of m = 1 alone may repeat in part, but those of m > 1 are what they repeat
    data = region_bytes(docs, groups.join(mixed, "h"), 1).mapInArrow(lean(runs_of), "h long, g1 long, g2 long, m long, hot boolean, strings binary, a array<int>, b array<int>")
    data, size = counted(data, "runs", F.octet_length("strings"))
    tasks = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    part = F.pmod(F.xxhash64("h"), F.lit(max(4 * tasks, size // RUN_BYTES))).cast("int").alias("part")
    few = data.where("NOT hot").select(part, "g1", "g2", "m", "strings", "a", "b").groupBy("part").applyInArrow(compared, "g1 long, g2 long, a int, b int")
    runs = data.where("hot").mapInArrow(lean(_each_run), "w1 long, w2 long, g1 long, g2 long, m long, a int, b int")
    again = runs.groupBy("w1", "w2").agg(F.sum("m").alias("m")).where("m > 1").select("w1", "w2")
    many = runs.where("m = 1").join(again, ["w1", "w2"], "left_semi").select("g1", "g2", "a", "b")
    partly = few.unionAll(many).groupBy("g1", "g2").agg(F.collect_list(F.struct("a", "b")).alias("runs"))
    wholly = groups.where("m > 1").select("g1", "g2", F.array(F.struct(F.lit(0).alias("a"), F.col("n").alias("b"))).alias("runs"))
    packed = written(partly.unionAll(wholly), "packed")
    places = candidates.groupBy("t", "len", "start", "g1", "g2").agg(F.lit(1).alias("one"))
    covers = F.transform("runs", lambda r: F.struct((F.col("start") + r["a"]).alias("a"), (F.col("start") + r["b"]).alias("b")))
    return places.join(packed, ["g1", "g2"]).select("t", "len", covers.alias("covers")).groupBy("t", "len").agg(F.flatten(F.collect_list("covers")).alias("covers"))


def _united(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Maximal runs covered by [a, b)."""
    order = np.argsort(a, kind="stable")
    a, b = a[order], np.maximum.accumulate(b[order])
    new = np.append(True, a[1:] > b[:-1])
    return a[new], b[np.append(np.flatnonzero(new)[1:] - 1, len(b) - 1)]


def _ranges(*lists: pa.Scalar) -> tuple[np.ndarray, np.ndarray]:
    """Maximal runs covered by the ranges of lists that may be null."""
    known = [x.values for x in lists if x.is_valid and len(x.values)]
    if not known:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    return _united(*(np.concatenate([x.field(c).to_numpy().astype(np.int64) for x in known]) for c in ("a", "b")))


def _left(one: np.ndarray, a: np.ndarray, b: np.ndarray) -> list[bytes]:
    return [one[x:y].tobytes() for x, y in zip(np.append(0, b), np.append(a, len(one)), strict=True)]


def deduplicated(docs: DataFrame, length: int = LENGTH, with_text: bool = False, words: int = 0, from_text_alone: bool = False) -> DataFrame:
    """docs' other columns with n_bytes, n_removed, n_spans, kept_sha256 and, if asked, text: the remaining bytes (those that a cut leaves of
    a character, at its ends, are dropped from text). Clashing columns are replaced. words: runs of so many whole words that repeat go too,
    if they have fewer bytes than `length`; from_text_alone: they go from text, and the other columns tell of strings of `length` bytes alone."""
    added = ["n_bytes long", "n_removed long", "n_spans long", "kept_sha256 string", *["text string"] * with_text]
    names = [x.split()[0] for x in added]
    others = [c for c in docs.columns if c not in (*names, "text")]
    base = docs.select(*[F.col(f"`{c}`") for c in others], F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    source = base.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    with passing(docs.sparkSession):
        none = F.lit(None).cast("array<struct<a:int,b:int>>")
        ranges = removed_ranges(source, length).withColumn("more", none)
        if words:
            short = repeated_words(source, words, length)
            short = short.select("t", "len", none.alias("covers"), F.col("covers").alias("more")) if from_text_alone else short.withColumn("more", none)
            ranges = ranges.unionAll(short).groupBy("t", "len").agg(*(F.flatten(F.collect_list(c)).alias(c) for c in ("covers", "more")))
        ranges = written(ranges, "ranges", lasts=True).alias("r")
    keyed = base.select("*", *[k.alias(f"__{n}") for k, n in zip(text_key(), ("t", "len"), strict=True)])
    both = keyed.join(ranges, (F.col("__t") == F.col("r.t")) & (F.col("__len") == F.col("r.len")), "left").select(*[F.col(f"`{c}`") for c in others], "text", "covers", "more")
    schema = ", ".join([*(f"`{c}` {base.schema[c].dataType.simpleString()}" for c in others), *added])

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, "text", 1 << 22):
                raw, off = utf8_views(part.column("text"))
                covers, more = part.column("covers"), part.column("more")
                rows = []
                for i in range(part.num_rows):
                    one = raw[off[i] : off[i + 1]]
                    a, b = _ranges(covers[i])
                    keep, first = _left(one, a, b), (a, b)
                    left = b"".join(keep)
                    row = (len(one), int((b - a).sum()), len(a), hashlib.sha256(left).hexdigest())
                    if with_text:
                        a, b = _ranges(covers[i], more[i])
                        keep = keep if len(a) == len(first[0]) and (a == first[0]).all() and (b == first[1]).all() else _left(one, a, b)
                        row = (*row, b"".join(x.decode("utf-8", "ignore").encode() for x in keep).decode())
                    rows.append(row)
                kinds = [pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.string()]
                cols = list(zip(*rows, strict=True))
                yield pa.RecordBatch.from_arrays([*(part.column(c) for c in others), *(pa.array(c, k) for c, k in zip(cols, kinds, strict=False))], names=[*others, *names])

    return both.mapInArrow(lean(work), schema)


def op4_suffix(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Besides the contract's columns text: what is left of each text without them and without passages of over 50 words that repeat in fewer bytes."""
    return deduplicated(table(spark, sf_dir, "documents").select("doc_id", "text"), with_text=True, words=PASSAGE, from_text_alone=True)


QUERIES = {"op4_suffix": op4_suffix}
ORACLE_SQL: dict[str, str] = {}
