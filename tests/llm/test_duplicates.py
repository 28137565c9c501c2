"""Jaccard join, components, induced sorting, suffix dedup and the pipeline against brute force."""

import hashlib
import random
import re
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from cloakframe.llm import induced, jaccard, suffix
from cloakframe.llm.components import components
from tests.conftest import SF

LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def shingles(text, n):
    w = re.findall(r"[^\x20\x09-\x0d]+", (text or "").translate(LOWER))
    return {tuple(w[i : i + n]) for i in range(len(w) - n + 1)} if len(w) >= n else ({tuple(w)} if w else set())


def brute_components(rows, words, percent):
    sets, parent = [shingles(t, words) for _, t in rows], list(range(len(rows)))

    def find(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for i, a in enumerate(sets):
        for j in range(i):
            if a and 100 * len(a & sets[j]) >= percent * len(a | sets[j]):
                parent[find(i)] = find(j)
    least = {}
    for i, (d, _) in enumerate(rows):
        if d is not None:
            least[find(i)] = min(d, least.get(find(i), d))
    return Counter((d, len(sets[i]), least.get(find(i))) for i, (d, _) in enumerate(rows))


def planted(seed, groups=25):
    """Groups of near copies around the threshold, exact copies, and passages that many documents share."""
    rng = random.Random(seed)
    word = lambda: "".join(rng.choices("abcdefg", k=3))
    passage, texts = [word() for _ in range(30)], [None, "", " \n", "A b", "a B", "a", "x y z w", "X y z w"]
    for _ in range(groups):
        base = [word() for _ in range(rng.choice([3, 8, 30, 120]))]
        for _ in range(rng.randint(1, 6)):
            copy = list(base)
            for _ in range(rng.choice([0, 0, 1, 2, 3, 6])):
                copy[rng.randrange(len(copy))] = word()
            texts.append(" ".join(copy + (passage if rng.random() < 0.4 else [])))
    rng.shuffle(texts)
    return list(enumerate(texts)) + [(3, texts[3]), (None, texts[4]), (None, "only here")]


@pytest.mark.parametrize(("seed", "words", "percent"), [(1, 4, 85), (2, 5, 80), (3, 1, 50)])
def test_joined(spark, seed, words, percent):
    rows = planted(seed)
    df = spark.createDataFrame(rows, "doc_id long, text string").withColumn("label", F.lit("clash"))
    got = Counter((r["doc_id"], r["n_shingles"], r["component_id"]) for r in jaccard.joined(df, words, percent).collect())
    assert got == brute_components(rows, words, percent)


def test_long_lists_are_sieved_exactly(spark, monkeypatch):
    """A large cloud of near copies, with the levels of heavy shingles set low."""
    rng = random.Random(7)
    base = [f"w{i}" for i in range(80)]
    rows = []
    for d in range(150):
        copy = list(base)
        for _ in range(rng.randint(0, 4)):
            copy[rng.randrange(80)] = f"v{rng.randrange(10**6)}"
        rows.append((d, " ".join(copy)))
    monkeypatch.setattr(jaccard, "LEVELS", (2, 8, 32))
    got = Counter((r["doc_id"], r["n_shingles"], r["component_id"]) for r in jaccard.joined(spark.createDataFrame(rows, "doc_id long, text string"), 4, 85).collect())
    assert got == brute_components(rows, 4, 85)


def test_joined_tables(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text")
    rows = [tuple(r) for r in docs.collect()]
    got = Counter((r["doc_id"], r["n_shingles"], r["component_id"]) for r in jaccard.op10_jaccard(spark, SF).collect())
    assert got == brute_components(rows, 4, 85)
    assert jaccard.joined(docs.limit(0)).count() == 0


def test_documents_of_every_slot(spark):
    """Slots 0 and 1, both sides of a bucket's end, and the last one; the id of a class that hashes to slot 0."""
    slots = [0, 1, 32767, 32768, 32769, (1 << 21) - 1]
    assert np.flatnonzero(jaccard._bits(spark.createDataFrame([(x,) for x in slots], "slot long"), "slot")).tolist() == slots
    base = [f"w{i}" for i in range(60)]
    rows = [(1314495, " ".join(base)), (1314500, " ".join([*base[:-1], "other"])), (1314501, "far from both of them")]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    assert df.where(F.pmod(F.xxhash64("doc_id"), F.lit(1 << jaccard.SLOT_BITS)) == 0).count() == 1
    got = Counter((r["doc_id"], r["n_shingles"], r["component_id"]) for r in jaccard.joined(df, 4, 85).collect())
    assert got == brute_components(rows, 4, 85)


def test_copies_leave_one_set(spark):
    """Copies that pass the bitmap: rows of one doc_id, and another document of the needed class that is needed for nothing."""
    a, b = "one two three four five six", "six five four three two one"
    rows = [(7, a)] * 5 + [(8, b), (9, a), (9, b)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    base = jaccard.sketched(docs, 4, 85, np.zeros(1 << jaccard.SLOT_BITS, np.uint8))
    needed = base.groupBy("c").agg(F.min("doc_id").alias("id"))
    got = [(r["c"], len(r["whole"]) // 8) for r in jaccard.whole_sets(docs, needed, 4).collect()]
    assert sorted(got) == sorted((r["c"], 3) for r in needed.collect())


def test_components(spark):
    rng = random.Random(8)
    edges = [(rng.randrange(60), rng.randrange(60)) for _ in range(45)] + [(100 + i, 101 + i) for i in range(20)] + [(5, 5), (200, 200)]
    parent = {x: x for e in edges for x in e}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in edges:
        x, y = find(a), find(b)
        parent[max(x, y)] = min(x, y)
    linked = {x for a, b in edges if a != b for x in (a, b)}
    got = {r["node"]: r["label"] for r in components(spark.createDataFrame(edges, "u long, v long")).collect()}
    assert got == {x: find(x) for x in linked if x != find(x)}


def test_suffixes_and_common_prefixes():
    rng = np.random.default_rng(9)
    for _ in range(400):
        parts = [np.append(rng.integers(1, rng.integers(2, 6), rng.integers(1, 30)), 0) for _ in range(rng.integers(1, 5))]
        if rng.random() < 0.4:
            parts.append(parts[0])
        text = np.concatenate(parts).astype(np.uint16)
        budget = int(rng.integers(0, 2000))  # small ones put the queues on disk
        found = list(induced.suffixes(text, 10**4, budget))
        order = sorted(range(len(text)), key=lambda i: text[i:].tolist(), reverse=True)
        assert np.concatenate([p for p, _ in found]).tolist() == order

        def common(i, j, text=text):
            k = 0
            while i + k < len(text) and j + k < len(text) and text[i + k] == text[j + k]:
                k += 1
            return k

        assert np.concatenate([c for _, c in found]).tolist() == [0] + [common(a, b) for a, b in zip(order, order[1:], strict=False)]


def brute_removed(rows, length):
    data = [(t or "").encode() for _, t in rows]
    seen = Counter(b[i : i + length] for b in data for i in range(len(b) - length + 1))
    out = []
    for (d, _), b in zip(rows, data, strict=True):
        gone = bytearray(len(b))
        for i in range(len(b) - length + 1):
            if seen[b[i : i + length]] > 1:
                gone[i : i + length] = b"\1" * length
        spans = sum(g and not (i and gone[i - 1]) for i, g in enumerate(gone))
        out.append((d, len(b), sum(gone), spans, hashlib.sha256(bytes(x for x, g in zip(b, gone, strict=True) if not g)).hexdigest()))
    return Counter(out)


def passages(seed, length):
    rng = random.Random(seed)
    text = lambda n: "".join(rng.choices("abcdeé ", k=n))
    shared = [text(length + rng.randint(-3, 2 * length)) for _ in range(4)]
    rows = [None, "", "short", "a" * (3 * length), "ab" * length, text(6 * length)]
    for _ in range(25):
        rows.append("".join(rng.choice(shared)[rng.randint(0, 3) :] if rng.random() < 0.5 else text(rng.randint(1, 2 * length)) for _ in range(rng.randint(1, 4))))
    rows += [rows[5], rows[7]]
    return [*enumerate(rows), (4, rows[4]), (None, rows[8]), (None, text(50))]


@pytest.mark.parametrize(("seed", "hot", "together", "stretch"), [(1, 256, 512, 1 << 23), (2, 1, 512, 1 << 23), (3, 1, 1, 97)])
def test_removed(spark, monkeypatch, seed, hot, together, stretch):
    monkeypatch.setattr(suffix, "HOT", hot)
    monkeypatch.setattr(suffix, "TOGETHER", together)
    monkeypatch.setattr(suffix, "STRETCH", stretch)
    length = 40
    rows = passages(seed, length)
    df = spark.createDataFrame(rows, "doc_id long, text string").withColumn("n_bytes", F.lit("clash"))
    got = suffix.deduplicated(df, length, with_text=True).collect()
    assert Counter((r["doc_id"], r["n_bytes"], r["n_removed"], r["n_spans"], r["kept_sha256"]) for r in got) == brute_removed(rows, length)
    assert all(len(r["text"].encode()) <= r["n_bytes"] - r["n_removed"] for r in got)


def brute_left(rows, length, words):
    """What is left of each text without repeated strings of `length` bytes and repeated runs of so many whole words."""
    data = [(t or "").encode() for _, t in rows]
    spans = [[m.span() for m in re.finditer(rb"[^\x20\x09-\x0d]+", b)] for b in data]
    every = [{(i, i + length) for i in range(len(b) - length + 1)} | {(w[i][0], w[i + words - 1][1]) for i in range(len(w) - words + 1)} for b, w in zip(data, spans, strict=True)]
    seen = Counter(b[x:y] for b, own in zip(data, every, strict=True) for x, y in own)
    out = []
    for (d, _), b, own in zip(rows, data, every, strict=True):
        edges = [0] * (len(b) + 1)
        for x, y in own:
            if seen[b[x:y]] > 1:
                edges[x] += 1
                edges[y] -= 1
        depth, kept, parts = 0, bytearray(), []
        for i, x in enumerate(b):
            depth += edges[i]
            if depth:
                parts, kept = (parts + [kept] if kept else parts), bytearray()
            else:
                kept.append(x)
        out.append((d, b"".join(bytes(k) for k in [*parts, kept]).decode("utf-8", "ignore")))
    return Counter(out)


def test_removed_tables(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text")
    rows = [tuple(r) for r in docs.collect()]
    got = suffix.op4_suffix(spark, SF).collect()
    assert Counter((r["doc_id"], r["n_bytes"], r["n_removed"], r["n_spans"], r["kept_sha256"]) for r in got) == brute_removed(rows, 400)
    left = brute_left(rows, 400, suffix.PASSAGE)
    assert {r["doc_id"]: len(r["text"]) for r in got} == {d: len(t) for d, t in left}
    assert sum(len(t) for _, t in left) < sum(r["n_bytes"] - r["n_removed"] for r in got)
    assert suffix.deduplicated(docs.limit(0)).count() == 0


@pytest.mark.parametrize(("seed", "words", "stretch", "together"), [(1, 6, 1 << 23, 512), (2, 9, 1 << 23, 2), (3, 6, 13, 0)])
def test_repeated_words(spark, monkeypatch, seed, words, stretch, together):
    """Passages of few letters, so that anchors repeat by chance and within a region; texts cut into stretches."""
    monkeypatch.setattr(suffix, "STRETCH", stretch)
    monkeypatch.setattr(suffix, "TOGETHER", together)
    length, rng = 40, random.Random(seed)
    text = lambda n: "".join(rng.choice("ab") + rng.choice([" ", "  ", "\n", "c ", ""]) for _ in range(n))
    shared = [text(rng.randint(8, 30)) for _ in range(4)]
    rows = [None, "", " ", "a " * 30, text(200)] + ["".join(rng.choice(shared) if rng.random() < 0.4 else text(rng.randint(1, 20)) for _ in range(rng.randint(1, 5))) for _ in range(25)]
    rows = [*enumerate([*rows, rows[4]]), (4, rows[4]), (7, rows[7]), (None, rows[9])]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = suffix.deduplicated(df, length, with_text=True, words=words, from_text_alone=True).collect()
    assert Counter((r["doc_id"], r["n_bytes"], r["n_removed"], r["n_spans"], r["kept_sha256"]) for r in got) == brute_removed(rows, length)
    assert Counter((r["doc_id"], r["text"]) for r in got) == brute_left(rows, length, words)


def test_pipeline_stages(spark, tmp_path):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    for i, (_, stage) in enumerate(corpus_pipeline.STAGES):
        before = docs
        out = stage(spark, docs, SF)
        path = str(tmp_path / str(i))
        out.write.parquet(path)
        docs = spark.read.parquet(path)
        if i < 4:
            assert tuple(docs.columns) == corpus_pipeline.COLUMNS
        if i == 1:
            want = brute_components([(r["doc_id"], r["text"]) for r in before.collect()], 5, 80)
            assert {r["doc_id"] for r in docs.collect()} == {d for d, _, c in want if d == c}
        if i == 2:
            kept = {r["doc_id"]: r["text"] for r in docs.collect()}
            for d, n, gone, *_ in brute_removed([(r["doc_id"], r["text"]) for r in before.collect()], corpus_pipeline.REPEAT_BYTES):
                assert n - gone - 6 <= len(kept[d].encode()) <= n - gone
    assert docs.count() > 0 and {"doc_id", "n_tokens", "ids"} <= set(docs.columns)


def test_passages_of_short_words(spark):
    """Repeats of over 50 words go though they have under 240 bytes, in other documents and in one; those of 50 stay."""
    rng = random.Random(11)
    word = lambda k: "".join(rng.choices("abcdefghé", k=k))
    prose = lambda n: " ".join(word(rng.randint(6, 9)) for _ in range(n))
    short = lambda n: rng.choice([" ", "  ", "\n"]).join(word(rng.randint(1, 3)) for _ in range(n))
    shared = [short(n) for n in (50, 51, 52, 58)]
    rows = [None, "", " ", " ".join("a" * 50), " ".join("b" * 51), " ".join("b" * 51), " ".join("c" * 70)]
    for s in shared:
        rows += [f"{prose(20)} {s} {prose(9)}", f"{prose(3)} {s}", f"{s} {prose(12)}"]
    rows += [f"{shared[1]} {prose(5)} {shared[1]}", prose(2) + shared[2], " ".join(word(1) for _ in range(300)), rows[7]]
    rows = [*enumerate(rows), (7, rows[7]), (None, rows[9])]
    assert all(len(s.encode()) < corpus_pipeline.REPEAT_BYTES for s in shared)
    spans = [[m.span() for m in re.finditer(rb"[^\x20\x09-\x0d]+", (t or "").encode())] for _, t in rows]
    runs = [{(w[i][0], w[i + 50][1]) for i in range(len(w) - 50)} for w in spans]
    data = [(t or "").encode() for _, t in rows]
    seen = Counter(d[a:b] for d, own in zip(data, runs, strict=True) for a, b in own)
    long = Counter(d[i : i + 240] for d in data for i in range(len(d) - 239))
    want = []
    for (d, _), b, own in zip(rows, data, runs, strict=True):
        gone = bytearray(len(b))
        for x, y in [*own, *((i, i + 240) for i in range(len(b) - 239))]:
            if seen[b[x:y]] > 1 or long[b[x:y]] > 1:
                gone[x:y] = b"\1" * (y - x)
        want.append((d, bytes(x for x, g in zip(b, gone, strict=True) if not g).decode("utf-8", "ignore")))
    df = spark.createDataFrame(rows, "doc_id long, text string").select("doc_id", "text", F.lit("en").alias("lang"), F.lit("a").alias("source"), F.lit(1).cast("long").alias("n_chars"))
    got = Counter((r["doc_id"], r["text"]) for r in corpus_pipeline.repeated_passages(spark, df, SF).collect())
    assert got == Counter(want)
    assert got[(4, "")] == 1 and got[(3, rows[3][1])] == 1


def test_pipeline_edges(spark, tmp_path):
    rows = [(1, None, None, None, None), (2, " ".join(f"word{i}" for i in range(200)), "en", "a", 5), (2, " ".join(f"word{i}" for i in range(200)), "en", "a", 5), (None, " ".join(f"other{i}" for i in range(90)), "en", None, 1)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").withColumn("size", F.lit("x"))
    for df, want in ((docs, 2), (docs.limit(0), 0)):
        for i, (_, stage) in enumerate(corpus_pipeline.STAGES[:3]):
            path = str(tmp_path / f"{want}-{i}")
            stage(spark, df, SF).write.parquet(path)
            df = spark.read.parquet(path)
        assert df.count() == want
        corpus_pipeline.tokens(spark, corpus_pipeline.mixed_sources(spark, df, SF), SF).collect()


def test_levels_do_not_depend_on_the_number_of_tasks(spark):
    rows = [(i, f"each of these texts has this one sentence in it own {i} words {i} follow {i}") for i in range(40)]
    one, many = (jaccard.shingle_levels(spark.createDataFrame(spark.sparkContext.parallelize(rows, n), "doc_id long, text string"), 4) for n in (1, 40))
    assert (one == many).all() and sorted(one[one > 0].tolist()) == [1] * 8


@pytest.mark.parametrize("length", [1000, 150])
def test_near_copies_below_the_threshold_are_not_listed_in_pairs(spark, monkeypatch, length):
    """Near copies that their parities can't tell apart (long ones), and such as meet in many lists of a dozen (short ones): few are linked, and lists give fewer rows than they have postings."""
    rng = random.Random(length)
    base = [f"w{i}" for i in range(length)]
    edits = [(rng.randrange(length), f"e{i}") for i in range(150 * 8 // 12)]
    rows = [(0, "far from all of them"), (1, None)]
    for d in range(2, 62 if length == 1000 else 152):
        copy = list(base)
        for at, word in [(rng.randrange(length), f"v{d}x{i}") for i in range(11)] if length == 1000 else rng.sample(edits, 8):
            copy[at] = word
        rows.append((d, " ".join(copy)))
    postings = sum(jaccard.short_lists(len(shingles(t, 4)), 85) for _, t in rows)
    seen, meetings = [], jaccard._meetings

    def observed(*args, **kwargs):
        seen.append(spark.sparkContext.accumulator(0))
        rows_out, work = seen[-1], meetings(*args, **kwargs)

        def run(batches):
            for batch in work(batches):
                rows_out.add(batch.num_rows)
                yield batch

        return run

    monkeypatch.setattr(jaccard, "_meetings", observed)
    monkeypatch.setattr(jaccard, "GROUP_BLOCK", 1 << 12, raising=False)
    got = Counter((r["doc_id"], r["n_shingles"], r["component_id"]) for r in jaccard.joined(spark.createDataFrame(rows, "doc_id long, text string"), 4, 85).collect())
    assert got == brute_components(rows, 4, 85)
    assert len(seen) == 2 and seen[1].value < postings


@pytest.mark.parametrize("block", [1 << 8, 1 << 17])
def test_links_within_groups(spark, monkeypatch, block):
    """Without links of bands and of nearest partners, all come from cells of one or two blocks, and from the shortest lists."""
    rows = planted(4)
    rng, base = random.Random(6), [f"w{i}" for i in range(80)]
    for d in range(60):
        copy = list(base)
        for _ in range(rng.randint(1, 5)):
            copy[rng.randrange(80)] = f"v{rng.randrange(10**6)}"
        rows.append((2000 + d, " ".join(copy)))
    monkeypatch.setattr(jaccard, "GROUP_BLOCK", block)
    monkeypatch.setattr(jaccard, "banded_pairs", lambda classes: classes.select(F.col("c").alias("x"), F.col("c").alias("y")).limit(0))
    monkeypatch.setattr(jaccard, "nearest_pairs", lambda classes, *_: classes.select(F.col("c").alias("x"), F.col("c").alias("y")).limit(0))
    got = Counter((r["doc_id"], r["n_shingles"], r["component_id"]) for r in jaccard.joined(spark.createDataFrame(rows, "doc_id long, text string"), 4, 85).collect())
    assert got == brute_components(rows, 4, 85)
