"""Media, BPE, sharding, mixing, quality, URLs, WARC, chat: against brute force, round trips and planted cases."""

import hashlib
import io
import math
import random
import re
import zlib

import numpy as np
import pytest
from hypothesis import given, settings, strategies as st
from pyspark.sql import functions as F

from cloakframe.llm import bpe, chat, media, mixing, quality, sharding, urls, warc
from tests.conftest import SF

DOCS = "doc_id long, text string, lang string, source string, n_chars long"
ODD = [(0, None), (None, "no id"), (2, ""), (2, ""), (3, "é" * 50_000), (4, " \t\n"), (5, "a\x00b"), (6, "x " * 30_000), (7, "voilà le café <|endoftext|> x")]


@pytest.fixture(scope="module")
def odd(spark):
    """Nulls in any column, repeated rows, long texts, and an extra column with a clashing name."""
    rows = [(d, t, None if d == 2 else "en", None if d == 3 else f"s{(d or 0) % 3}", None) for d, t in ODD]
    return spark.createDataFrame(rows, DOCS).withColumn("size", F.lit("clash")).withColumn("kept", F.lit(1))


@pytest.fixture(scope="module")
def docs(spark):
    return spark.read.parquet(f"{SF}/documents.parquet")


# -- media


def pnm(kind, w, h, body):
    return b"P%d # note\n%d %d\n" % (kind, w, h) + (b"255\n" if kind not in (1, 4) else b"") + body


def test_netpbm_kinds():
    grey = np.arange(6, dtype=np.uint8).reshape(2, 3, 1)
    assert (media.decode_netpbm(pnm(5, 3, 2, grey.tobytes())) == grey).all()
    assert (media.decode_netpbm(pnm(2, 3, 2, b"0 1 2\n# x\n3 4 5")) == grey).all()
    assert (media.decode_netpbm(pnm(6, 1, 2, bytes(range(6)))) == np.arange(6).reshape(2, 1, 3)).all()
    assert (media.decode_netpbm(b"P1\n3 1\n1 0 1")[0, :, 0] == [0, 1, 0]).all() and (media.decode_netpbm(b"P4\n3 1\n\xa0")[0, :, 0] == [0, 1, 0]).all()
    assert media.decode_netpbm(b"P5\n1 1\n65535\n\x01\x02")[0, 0, 0] == 258


def test_bmp_round_trip_and_order():
    rng = np.random.default_rng(1)
    for w, h in ((1, 1), (5, 3), (64, 2)):
        pixels = rng.integers(0, 256, (h, w, 3), dtype=np.uint8)
        assert (media.decode_bmp(media.encode_bmp(pixels)) == pixels).all()


@settings(max_examples=30, deadline=None)
@given(st.integers(1, 9), st.integers(1, 9), st.integers(1, 7), st.integers(1, 7), st.integers(0, 99))
def test_area_resize(h, w, th, tw, seed):
    x = np.random.default_rng(seed).integers(0, 256, (h, w, 1)).astype(np.uint8)
    big = np.kron(x[:, :, 0].astype(float), np.ones((th, tw))).reshape(th, h, tw, w)  # each target area is h x w parts of the enlarged image
    assert np.allclose(media.area_resize(x, th, tw)[:, :, 0], big.mean(axis=(1, 3)))


def test_text_media(spark, odd):
    rows = media.text_media(odd).collect()
    assert len(rows) == len(ODD)
    by = {}
    for r in rows:
        by.setdefault(r["doc_id"], r)
    for d, t in ODD:
        data = (t or "").encode()
        payload = data + b" " * (-len(data) % 192 if data else 192)
        r = by[d]
        assert (r["n_bytes"], r["payload_bytes"], r["payload_sha256"], r["tail_crc32"]) == (len(data), len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-16:]))
        stored = media.store_payload(payload)
        assert media.decode_image(stored).tobytes() == payload and (r["media_bytes"], r["media_sha256"]) == (len(stored), hashlib.sha256(stored).hexdigest())


def test_tiles(spark, tmp_path):
    pixels = np.random.default_rng(2).integers(0, 256, (20, 30, 3), dtype=np.uint8)
    df = spark.createDataFrame([(1, bytearray(media.encode_bmp(pixels)), "x"), (2, bytearray(b"junk"), "y"), (3, None, "z")], "k int, image binary, width string")
    media.write_tiles(df, str(tmp_path / "t"))
    rows = {r["k"]: r for r in spark.read.parquet(str(tmp_path / "t")).collect()}
    tile = np.load(io.BytesIO(rows[1]["tile_npy"]))
    assert tile.shape == (16, 16, 3) and rows[1]["width"] == 30 and len(rows[1]["dhash"]) == 16
    assert rows[2]["tile_npy"] is None and rows[3]["dhash"] is None
    assert media.tiles(df.limit(0)).count() == 0


# -- BPE


@pytest.fixture(scope="module")
def tokenizer():
    return bpe.loaded(bpe.vocabulary_path())


@pytest.mark.parametrize("span", [1, 256])
def test_fragments_encode_as_the_whole(span, monkeypatch):
    monkeypatch.setattr(bpe, "SPAN", span)
    tokenizer = bpe.ForcedBoundaryBpe(bpe.vocabulary_path())
    assert tokenizer.quick is not None
    random.seed(3)
    parts = [*"ab ,.\n\t\r '", "\x85", "\xa0", "\u2003", "\u3000", "\x1c", "<|endoftext|>", "é", "à", "'s", "日本", "1", "\x0b", "\u200b", "\ufeff", "😀"]
    for _ in range(4000):
        text = "".join(random.choices(parts, k=random.randint(0, 14)))
        want = tokenizer.tokenizer.encode(text, add_special_tokens=False).ids
        ids = tokenizer.encode_batch([text])[0]
        assert np.frombuffer(ids, "<u4").tolist() == want, text
        assert tokenizer.decode(ids) == tokenizer.tokenizer.decode(want, skip_special_tokens=False)


def test_forced_pairs_are_in_no_token(monkeypatch):
    monkeypatch.setattr(bpe, "SPAN", 1)
    tokenizer = bpe.ForcedBoundaryBpe(bpe.vocabulary_path())
    assert len(tokenizer.fragments("a b c")) == 3
    for f, g in zip(*(lambda x: (x, x[1:]))(tokenizer.fragments("It's à la carte, voilà  done\n\nnext line, €5 ")), strict=False):
        assert not tokenizer.inside[f.encode()[-1], g.encode()[0]]


def test_encoded_rows(spark, odd, tokenizer):
    rows = bpe.encoded(odd, bpe.vocabulary_path(), with_ids=True).collect()
    assert sorted((r["doc_id"] is None, r["doc_id"] or 0) for r in rows) == sorted((d is None, d or 0) for d, _ in ODD)
    texts = dict(ODD)
    for r in rows:
        want = tokenizer.tokenizer.encode(texts[r["doc_id"]] or "", add_special_tokens=False).ids
        assert r["n_tokens"] == len(want) and r["ids_sha256"] == hashlib.sha256(np.array(want, "<u4").tobytes()).hexdigest()
        assert r["decoded_sha256"] == hashlib.sha256((texts[r["doc_id"]] or "").encode()).hexdigest()
    assert bpe.encoded(odd.limit(0), bpe.vocabulary_path()).count() == 0


# -- sharding


def scalar_jump(key, n):
    b, j = -1, 0
    while j < n:
        b = j
        key = (key * 2862933555777941757 + 1) % 2**64
        j = int((b + 1) * (float(1 << 31) / float((key >> 33) + 1)))
    return b


def test_jump_is_the_published_one():
    keys = np.random.default_rng(4).integers(0, 2**63, 2000).astype(np.uint64)
    for n in (1, 2, 8, 9, 1000):
        assert sharding.jump(keys, n).tolist() == [scalar_jump(int(k), n) for k in keys]


def test_sharded_rows(spark, odd, docs):
    for df in (odd, docs):
        rows = sharding.sharded(df.select("doc_id", "text", F.lit(1).alias("slot")), "doc_id", 8).collect()
        assert len(rows) == df.count()
        for s in range(8):
            assert sorted(r["slot"] for r in rows if r["shard"] == s) == list(range(sum(r["shard"] == s for r in rows)))
        assert all(r["grown_shard"] in (r["shard"], 8) for r in rows)
        assert len({(r["doc_id"], r["shard"]) for r in rows}) == len({r["doc_id"] for r in rows})
    assert sharding.sharded(docs.limit(0), "doc_id", 8).count() == 0


def test_op3(spark, docs):
    rows = {r["doc_id"]: r for r in sharding.op3_sharding(spark, SF).collect()}
    for r in docs.collect():
        assert (rows[r["doc_id"]]["size"], rows[r["doc_id"]]["text_crc32"]) == (len((r["text"] or "").encode()) + 1, zlib.crc32((r["text"] or "").encode()))


# -- mixing


def test_word_count(spark, odd):
    for r in odd.select("text", mixing.word_count(F.col("text")).alias("n")).collect():
        assert r["n"] == len(re.findall(r"[^\x20\x09-\x0D]+", r["text"] or ""))


def water(sizes, weights, total, most):
    """Reshares until none is above its limit."""
    target, free = {}, dict(enumerate(sizes))
    while free:
        left, w = total - sum(target.values()), sum(weights[i] for i in free)
        over = [i for i, s in free.items() if left * weights[i] / w > most * s]
        if not over:
            return target | {i: left * weights[i] / w for i in free}
        for i in over:
            target[i] = most * free.pop(i)
    return target


@pytest.mark.parametrize("seed", range(4))
def test_targets(spark, seed):
    random.seed(seed)
    sizes = [random.choice([0, 1, 5, 50, 400, 3000]) for _ in range(random.randint(1, 7))]
    names = [*(f"s{i}" for i in range(len(sizes) - 1)), None]
    got = {r["source"]: r["target"] for r in mixing.targets(spark.createDataFrame(list(zip(names, sizes, strict=True)), "source string, source_size long")).collect()}
    want = water(sizes, [(3, 1, 2)[i % 3] for i in range(len(sizes))], 1.5 * sum(sizes), 2.0)
    for i, name in enumerate(names):
        assert math.isclose(got[name], want[i], rel_tol=1e-9, abs_tol=1e-9)


def test_mixed(spark, odd, docs):
    for df in (odd, docs):
        rows = mixing.mixed(df.drop("size").withColumn("size", mixing.word_count(F.col("text")))).collect()
        assert len(rows) == df.count()
        for s in {r["source"] for r in rows}:
            own = [r for r in rows if r["source"] == s]
            assert sum(r["size"] for r in own) == own[0]["source_size"]
            assert abs(sum(r["taken"] for r in own) - own[0]["target"]) <= max(r["size"] for r in own)
        for r in rows:
            assert r["taken"] in (0, r["size"], 2 * r["size"]) and len(r["positions"]) * r["size"] == r["taken"]
            assert all(0 <= p <= 1 for p in r["positions"]) and r["positions"] == sorted(r["positions"])
    assert mixing.mixed(docs.limit(0).withColumn("size", F.lit(1).cast("long"))).count() == 0


def test_inverse_demand(spark):
    knots = ((0.0, 2.0), (0.25, 0.5), (1.0, 1.0))
    area = lambda t: (2 * t - 3 * t * t) if t <= 0.25 else 0.3125 + 0.5 * (t - 0.25) + (t - 0.25) ** 2 / 3
    for r in spark.range(21).select((F.col("id") / 20).alias("u")).withColumn("t", mixing.inverse_demand(F.col("u"), knots)).collect():
        assert math.isclose(area(r["t"]), r["u"] * area(1.0), abs_tol=1e-9)


# -- quality


def base_statistics(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", text or "")
    runs = [tuple(words[i : i + 8]) for i in range(len(words) - 7)]
    many = {}
    for r in runs:
        many[r] = many.get(r, 0) + 1
    marked = {i + k for i, r in enumerate(runs) if many[r] > 1 for k in range(8)}
    lines = [x for x in (text or "").split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    return len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text or "")), len(lines) - len(set(lines)), len(marked)


def test_statistics(spark, odd, docs):
    extra = spark.createDataFrame([(100 + i, " ".join(random.Random(i).choices("abc", k=60)) + "\n\n a\n a\n \n") for i in range(40)], "doc_id long, text string")
    for df in (odd, docs, extra):
        for r in quality.statistics(df).collect():
            assert tuple(r[c] for c in quality.BASE) == base_statistics(r["text"]), r["text"][:80]


def test_learned_rules_reject_junk_and_keep_clean_documents(spark, docs):
    labels = spark.read.parquet("/root/testdata/sf0.01/labels.parquet")
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    rows = quality.judged(docs, labels).join(labels, "doc_id").where("NOT base_failed").select("quality", "kept").collect()
    good, bad = [r["kept"] for r in rows if r["quality"] == 1], [r["kept"] for r in rows if r["quality"] == 0]
    assert sum(good) / len(good) > 0.98 and sum(bad) / len(bad) < 0.2


def test_judged_edges(spark, odd):
    labels = spark.createDataFrame([(0, 1, 0), (None, 0, 0), (3, None, 0), (3, 0, 1), (3, 0, 1)], "doc_id long, quality int, toxic int")
    rows = quality.judged(odd, labels).collect()
    assert len(rows) == len(ODD) and not any(r["kept"] for r in rows if r["text"] is None)
    assert quality.judged(odd.limit(0), labels).count() == 0 and quality.judged(odd, labels.limit(0)).count() == len(ODD)


def test_learner_finds_a_planted_conjunction():
    rng = np.random.default_rng(5)
    x = {"a": rng.random(2000), "b": rng.random(2000), "c": rng.random(2000)}
    y = (x["a"] > 0.7) & (x["b"] < 0.3)
    rules = quality.learn(x, y)
    hit = np.zeros(2000, bool)
    for r in rules:
        hit |= quality._covers(r, x, 2000)
    assert (hit == y).mean() > 0.98
    assert quality.learn(x, np.zeros(2000, bool)) == []


# -- URLs


CASES = [
    (None, "", "", None), ("no scheme", "", "", None), ("http://Example.COM/en/7x?q#f", "example.com", "/en/7x", "example.com/en/7"), ("https://a.example.com/en/8", "a.example.com", "/en/8", "com/en/"),
    ("ftp://x.net/de/8#/de/", "x.net", "/de/8", "net/de/"), ("http://sub.example.net/de/81", "sub.example.net", "/de/81", "example.net/de/8"), ("http://org/es/", "org", "/es/", "org/es/"), ("http://morg/es/", "morg", "/es/", None),
    ("http://example.com?x=/en/", "example.com", "", None), ("http://example.com:80/en/1", "example.com:80", "/en/1", None), ("://ÀB.com/EN/", "Àb.com", "/EN/", None), ("http://com/en/a://b/c", "com", "/en/a://b/c", "com/en/"),
]


def test_url_rules(spark):
    df = spark.createDataFrame([(i, u) for i, (u, *_) in enumerate(CASES)], "page_id long, url string").withColumn("host", F.lit("clash"))
    rows = {r["page_id"]: r for r in urls.judged(df).collect()}
    verdicts = {r: v for v, r in urls.RULES}
    for i, (_, host, path, rule) in enumerate(CASES):
        r = rows[i]
        assert (r["host"], r["path"], r["rule"]) == (host, path, rule)
        assert r["verdict"] == verdicts[rule] if rule else r["verdict"] in ("allow", "block")
    assert urls.judged(df.limit(0)).count() == 0


def test_boosted_trees_learn(spark):
    rng = random.Random(6)
    made = [(f"http://{'ads' if bad else 'www'}-{rng.randint(1, 99)}.x{rng.randint(1, 5)}.com/" + ("?a=1&b=2&c=3&d=" if bad else "p/q/") + str(rng.randint(1, 10**6)), bad) for bad in (i % 2 for i in range(800))]
    df = urls.with_parts(spark.createDataFrame(made, "url string, label int"))
    train, test = df.limit(500), df.subtract(df.limit(500))
    model = urls.fit(train)
    scored = urls.with_features(test).withColumn("suffix_rate", model.suffix_rate()).withColumn("ok", (model.score() > 0).cast("int") == F.col("label"))
    assert scored.agg(F.avg(F.col("ok").cast("int"))).first()[0] > 0.95


# -- WARC


def test_warc_round_trip(spark, tmp_path):
    long = "x" * 1200
    rows = [(1, "http://a", long), (2, "http://b\r\nX: y", long), (3, "http://c", "short"), (4, None, "short"), (5, "u", None), (None, "n", long), (7, "u", "a\r\n\r\nWARC/1.1\r\n" + "é" * 900), (8, "u", "y" * 999), (8, "u", "y" * 999), (9, "u", "z" * 1000), (9, "u", "z" * 1000)]
    df = spark.createDataFrame(rows, "page_id long, url string, html string")
    path = str(tmp_path / "w")
    warc.write_archives(warc.captures(df, "page_id", "html", "url"), path, per_file=4)
    read = warc.read_archives(spark, path, with_block=True)
    assert read.count() == 3 * len(rows)
    for r in read.where("warc_type = 'response'").collect():
        assert r["payload_digest"] == "sha1:" + r["block_sha1"] == "sha1:" + hashlib.sha1(bytes(r["block"])).hexdigest()
    got = [(r["key"], r["main"]["warc_type"], r["main"]["refers_to"], r["request"]["target_uri"], r["metadata"]["text"]) for r in warc.assembled(read).collect()]
    assert len(got) == len(rows)
    kinds = {(k, t, to) for k, t, to, *_ in got}
    assert {(1, "revisit", "<urn:capture:2>"), (2, "response", None), (None, "revisit", "<urn:capture:2>"), (3, "response", None), (8, "response", None), (9, "response", None)} <= kinds
    assert sorted(int(m.split()[-1]) for *_, m in got) == sorted(len((h or "").encode()) for *_, h in rows)
    assert warc.assembled(warc.read_archives(spark, path)).where("request IS NULL OR metadata IS NULL").count() == 0


def test_warc_empty(spark, tmp_path):
    df = spark.createDataFrame([], "page_id long, url string, html string")
    path = str(tmp_path / "w")
    warc.write_archives(warc.captures(df, "page_id", "html", "url"), path)
    assert warc.assembled(warc.read_archives(spark, path)).count() == 0


# -- chat


def test_snapshots(spark):
    say = lambda c, *t: [(c, i, "user" if i % 2 == 0 else "assistant", x) for i, x in enumerate(t)]
    rows = say(1, "a", "b") + say(2, "a", "b", "c") + say(3, "a", "x") + say(4, "a", "b", "c") + say(5, "b", "a") + say(6, None, "q") + say(7, None) + [(None, 0, None, "a"), (8, 0, "user", "a"), (8, 0, "user", "a")]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").withColumn("place", F.lit("clash"))
    got = {r["conv_id"]: r for r in chat.rendered(df).collect()}
    assert set(got) == {2, 3, 5, 6, None, 8}
    assert got[2]["n_copies"] == 2 and got[2]["rendered"] == "<|user|>\na<|end|>\n<|assistant|>\nb<|end|>\n<|user|>\nc<|end|>\n"
    assert chat.rendered(df.limit(0)).count() == 0
