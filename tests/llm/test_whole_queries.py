"""Whole queries and general interfaces against brute force; edge cases of single operators."""

import hashlib
import io
import random
import re
import struct
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from cloakframe.llm import bpe, chat, components, jaccard, media, quality, suffix, urls, warc
from tests.conftest import SF
from tests.llm.test_duplicates import planted, shingles
from tests.llm.test_text_operators import base_statistics


# -- components and links


@pytest.mark.parametrize("chunk", [4, 1 << 20])
def test_components_of_many_chunks(spark, monkeypatch, chunk):
    monkeypatch.setattr(components, "CHUNK", chunk)
    rng = random.Random(3)
    edges = [(rng.randrange(40), rng.randrange(40)) for _ in range(30)] + [(100 + i, 101 + i) for i in range(15)] + [(7, 7)]
    groups = {x: {x} for e in edges for x in e}
    for a, b in edges:
        both = groups[a] | groups[b]
        for x in both:
            groups[x] = both
    links = spark.createDataFrame(edges, "u long, v long").repartition(5)
    got = {r["node"]: r["label"] for r in components.components(links).collect()}
    assert got == {x: min(g) for x, g in groups.items() if x != min(g)}
    assert components.components(links.limit(0)).count() == 0


def test_every_link(spark):
    rows = [(d, t) for d, t in planted(4) if d is not None]
    rows = [*dict(rows).items()]
    classes = {}
    for d, t in rows:
        if s := frozenset(shingles(t, 4)):
            classes.setdefault(s, []).append(d)
    want = {tuple(sorted((min(x), min(y)))) for a, x in classes.items() for b, y in classes.items() if a != b and 100 * len(a & b) >= 80 * len(a | b)}
    got = jaccard.links(spark.createDataFrame(rows, "doc_id long, text string"), 4, 80).collect()
    assert {tuple(r) for r in got} == want and len(got) == len(want)


def test_hot_lists_are_dealt_as_pairs_of_blocks(spark, monkeypatch):
    """Near copies that share very frequent shingles only; every pair of classes meets in one pair of blocks of each list."""
    monkeypatch.setattr(jaccard, "LEVELS", (2, 4, 8, 9, 10, 11, 12, 13))
    rng = random.Random(12)
    base = [f"w{i}" for i in range(60)]
    rows = []
    for d in range(90):
        copy = list(base)
        for _ in range(rng.randint(1, 3)):
            copy[rng.randrange(60)] = f"v{rng.randrange(10**6)}"
        rows.append((d, " ".join(copy)))
    sets = [shingles(t, 4) for _, t in rows]
    want = {(i, j) for i in range(90) for j in range(i + 1, 90) if sets[i] != sets[j] and 100 * len(sets[i] & sets[j]) >= 85 * len(sets[i] | sets[j])}
    got = [tuple(r) for r in jaccard.links(spark.createDataFrame(rows, "doc_id long, text string"), 4, 85).collect()]
    assert set(got) == want and len(got) == len(want)


def test_heap_merge():
    rng = random.Random(1)
    for _ in range(50):
        runs = [sorted(rng.sample(range(30), rng.randint(0, 20))) for _ in range(rng.randint(1, 6))]
        assert dict(jaccard.heap_merged(runs)) == {y: sum(y in r for r in runs) for r in runs for y in r}


# -- whole registered queries


def tree_score(model, x):
    def walk(t):
        while t.feature >= 0:
            t = t.left if x[t.feature] <= t.threshold else t.right
        return t.value

    return model.prior + sum(walk(t) for t in model.trees)


def test_op9_urls_whole(spark):
    """Hosts, paths, rules, and the model's verdicts of every page, in plain Python from the trees that the query's own fit makes."""
    pages = spark.read.parquet(f"{SF}/pages.parquet").select("page_id", "url")
    parts = urls.with_parts(pages)
    rule, verdict = urls.rule_for(F.col("host"), F.col("path"))
    labelled = parts.withColumns({"rule": rule, "v": verdict}).where("rule IS NOT NULL").select("url", "host", "path", (F.col("v") == "block").cast("int").alias("label"))
    model, counts = urls.fit(labelled), {}
    rows = [tuple(r) for r in pages.collect()]

    def split(url):
        head, found, rest = (url or "").partition("://")
        host = re.match(r"[^/?#]*", rest)[0] if found else ""
        path = re.match(r"[^?#]*", rest[len(host) :])[0] if found else ""
        return re.sub("[A-Z]+", lambda m: m[0].lower(), host), path

    def ruled(host, path):
        fits = [(len(r), v, r) for v, r in urls.RULES if (host == r.partition("/")[0] or host.endswith("." + r.partition("/")[0])) and path.startswith("/" + r.partition("/")[2])]
        return max(fits)[1:] if fits else (None, None)

    for _, url in rows:
        host, path = split(url)
        if (v := ruled(host, path)[0]) is not None:
            n = counts.setdefault(host.rpartition(".")[2], [0, 0])
            n[0], n[1] = n[0] + (v == "block"), n[1] + 1
    rate = sum(n[0] for n in counts.values()) / sum(n[1] for n in counts.values())
    assert rate == pytest.approx(model.rate)
    want = {}
    for page, url in rows:
        text, (host, path) = url or "", split(url)
        v, r = ruled(host, path)
        n = max(len(text), 1)
        s, k = counts.get(host.rpartition(".")[2], (rate * 0, 0))
        entropy = -sum(text.count(c) / n * np.log2(text.count(c) / n) for c in set(text))
        x = [len(text), len(host), len(path), path.count("/"), sum("0" <= c <= "9" for c in text) / n, entropy, text.count("&") + text.count("="), host.count(".") + 1, text.count("-"), (s + urls.PRIOR * rate) / (k + urls.PRIOR)]
        score = tree_score(model, x)
        want[page] = (host, path, r, v or ("block" if score > 0 else "allow"), score)
    got = urls.op9_urls(spark, SF).collect()
    assert len(got) == len(rows)
    for r in got:
        host, path, rule, verdict, score = want[r["page_id"]]
        assert (r["host"], r["path"], r["rule"]) == (host, path, rule) and abs(r["score"] - score) < 1e-6
        assert r["verdict"] == verdict or abs(score) < 1e-6


def test_urls_sample_holds_different_urls(spark, monkeypatch):
    many = [("http://same.com/en/1", 1)] * 500 + [(f"http://a{i}.x.com/{i}", i % 2) for i in range(300)]
    df = urls.with_parts(spark.createDataFrame(many, "url string, label int"))
    seen = []
    monkeypatch.setattr(urls, "train", lambda x, y, *rest: seen.append(len(y)) or urls.Model(0.0, 0.5, {}, []))
    urls.fit(df, sample=5000)
    assert seen == [301]
    urls.fit(df, sample=50)
    assert 0 < seen[1] <= 50


def test_long_urls_and_nulls(spark):
    df = spark.createDataFrame([(1, "http://a.b/" + "x" * 200_000), (2, None), (2, None), (3, "http://example.com/en/" + "9" * 50_000)], "page_id long, url string").withColumn("verdict", F.lit(7))
    rows = urls.judged(df).collect()
    assert len(rows) == 4 and {r["verdict"] for r in rows} <= {"allow", "block"}


def test_op8_quality_whole(spark):
    """Base statistics, ratios and the learned list of every document in plain Python."""
    docs, labels = spark.read.parquet(f"{SF}/documents.parquet"), spark.read.parquet(f"{SF}/labels.parquet")
    rules = quality.fit(docs.select("doc_id", "text"), labels)
    texts = {r["doc_id"]: r["text"] for r in docs.collect()}
    got = quality.op8_quality(spark, SF).collect()
    assert len(got) == len(texts)
    for r in got:
        text = texts[r["doc_id"]] or ""
        base = dict(zip(quality.BASE, base_statistics(text), strict=True))
        n, chars = max(base["n_words"], 1), max(base["word_chars"], 1)
        lines = max(1, sum(bool(re.search(r"[^\x20\x09-\x0D]", x)) for x in text.split("\n")))
        x = {"symbol_ratio": base["n_symbols"] / chars, "repeat_ratio": base["n_repeat_words"] / n, "dup_line_ratio": base["n_dup_lines"] / lines, "mean_word": base["word_chars"] / n, "line_words": base["n_words"] / lines}
        x |= {f"{k}_ratio": len(re.findall(p, text)) / chars for k, p in (("upper", "[A-Z]"), ("mark", "[!?]"), ("digit", "[0-9]"))}
        failed = base["n_words"] < 20 or 100 * base["n_repeat_words"] > 30 * base["n_words"]
        rule = next((i for i, terms in enumerate(rules, 1) if all(x[f] >= v if op == ">=" else x[f] <= v for f, op, v in terms)), 0)
        assert (r["base_failed"], r["rule"], r["kept"]) == (failed, rule, not failed and rule == 0)
        assert tuple(r[c] for c in quality.BASE) == tuple(base.values())


def test_op1_media_whole(spark):
    texts = {r["doc_id"]: (r["text"] or "").encode() for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    rows = media.op1_media(spark, SF).collect()
    assert len(rows) == len(texts)
    features = {}
    for r in rows:
        data = texts[r["doc_id"]]
        payload = data + b" " * (-len(data) % 192 if data else 192)
        assert (r["n_bytes"], r["payload_bytes"], r["payload_sha256"], r["tail_crc32"]) == (len(data), len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-16:]))
        assert features.setdefault(data, (r["media_sha256"], r["feature"])) == (r["media_sha256"], r["feature"])


def test_op7_bpe_whole(spark):
    from tokenizers import Tokenizer

    encoder = Tokenizer.from_file(bpe.vocabulary_path())
    encoder.no_truncation(), encoder.no_padding()
    texts = {r["doc_id"]: r["text"] or "" for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    rows = bpe.op7_bpe(spark, SF).collect()
    assert len(rows) == len(texts)
    for r in rows:
        ids = encoder.encode(texts[r["doc_id"]], add_special_tokens=False).ids
        decoded = encoder.decode(ids, skip_special_tokens=False)
        assert (r["n_tokens"], r["ids_sha256"], r["decoded_sha256"]) == (len(ids), hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest(), hashlib.sha256(decoded.encode()).hexdigest())


def test_op4_text_is_what_is_left(spark):
    for r in suffix.op4_suffix(spark, SF).collect():
        if r["n_removed"] == 0:
            assert hashlib.sha256(r["text"].encode()).hexdigest() == r["kept_sha256"]
        assert len(r["text"].encode()) <= r["n_bytes"] - r["n_removed"]


# -- media


BAD = [b"P5 0 0 255 ", b"P2 1 1 255 70000", b"P2 1 1 0 0", b"P5 1 1 70000 xx", b"P5 99999 99999 255 x", b"P2 1 1 255 -4", b"P3 1 1 255 1 2", b"P9", b"", b"BM", b"BM" + b"\0" * 60, b"P1 2 1 2"]


def bmp(width, height, bits, packed, body, masks=b"", palette=b"", old=False):
    if old:
        head = struct.pack("<IHHHH", 12, width, height, 1, bits)
    else:
        head = struct.pack("<IiiHHIIiiII", 40, width, height, 1, bits, packed, len(body), 0, 0, 0, 0)
    start = 14 + len(head) + len(masks) + len(palette)
    return b"BM" + struct.pack("<IHHI", start + len(body), 0, 0, start) + head + masks + palette + body


def test_images_that_cannot_be_decoded_give_null_rows(spark):
    rows = media.tiles(spark.createDataFrame([(i, bytearray(b)) for i, b in enumerate(BAD)], "k int, image binary")).collect()
    assert len(rows) == len(BAD) and all(r["tile_npy"] is None and r["dhash"] is None for r in rows)


def test_scaled_samples_masks_and_old_headers():
    assert media.decode_netpbm(b"P2 3 1 15 0 7 15")[0, :, 0].tolist() == [0, 119, 255]
    assert media.decode_netpbm(b"P5 2 1 1023 " + struct.pack(">HH", 0, 1023))[0, :, 0].tolist() == [0, 65535]
    red = struct.pack("<I", 0x000000FF)
    assert media.decode_bmp(bmp(1, 1, 32, 3, red, struct.pack("<III", 0xFF, 0xFF00, 0xFF0000)))[0, 0].tolist() == [255, 0, 0]
    assert media.decode_bmp(bmp(1, 1, 32, 0, red))[0, 0].tolist() == [0, 0, 255]
    assert media.decode_bmp(bmp(2, 1, 16, 3, struct.pack("<HH", 0xF800, 0x07E0), struct.pack("<III", 0xF800, 0x07E0, 0x1F)))[0].tolist() == [[255, 0, 0], [0, 255, 0]]
    assert media.decode_bmp(bmp(1, 1, 16, 0, struct.pack("<HH", 0x1F, 0)))[0, 0].tolist() == [0, 0, 255]
    assert media.decode_bmp(bmp(2, 1, 1, 0, b"\x40\0\0\0", palette=b"\1\2\3\4\5\6", old=True))[0].tolist() == [[3, 2, 1], [6, 5, 4]]
    out = io.BytesIO(media.tile_npy(media.decode_netpbm(b"P2 1 1 255 9")))
    assert np.load(out).shape == (16, 16, 1)


# -- WARC, chat, BPE


def test_revisits_name_a_record(spark, tmp_path):
    body = "x" * 1500
    rows = [(1, "u", body), (4, "u", body), (4, "u", body), (2, "v", body), (6, "w", "y" * 1200), (5, "w", "y" * 1200), (7, "z", "é" * 400_000)]
    df = spark.createDataFrame(rows, "page_id long, url string, html string").withColumns({"key": F.lit("clash"), "digest": F.lit(1), "at": F.lit(2)})
    warc.write_archives(warc.captures(df, "page_id", "html", "url"), str(tmp_path / "w"))
    read = warc.read_archives(spark, str(tmp_path / "w"))
    ids = [r["record_id"] for r in read.collect()]
    assert len(ids) == len(set(ids)) == 3 * len(rows)
    revisits = read.where("warc_type = 'revisit'").collect()
    responses = {r["record_id"]: r for r in read.where("warc_type = 'response'").collect()}
    assert len(revisits) == 3 and all(responses[r["refers_to"]]["payload_digest"] == r["payload_digest"] for r in revisits)
    assert warc.assembled(read).count() == len(rows)


def test_chat_ties_and_long_texts(spark):
    long = "t" * 300_000
    rows = [(1, 0, "user", "a"), (1, 0, "assistant", "a"), (2, 0, "assistant", "a"), (2, 0, "user", "a"), (2, 1, "user", long), (None, 0, "user", long), (None, None, None, None)]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").withColumns({"p1": F.lit("clash"), "n_turns": F.lit(0)})
    got = {r["conv_id"]: r for r in chat.rendered(df).collect()}
    assert set(got) == {2, None} and got[2]["n_turns"] == 3 and len(got[2]["rendered"]) > 300_000


def test_bpe_clashing_columns(spark):
    df = spark.createDataFrame([(1, "héllo wörld"), (1, "héllo wörld"), (None, None)], "doc_id long, text string").withColumns({"n_tokens": F.lit("x"), "ids": F.lit(1)})
    rows = bpe.encoded(df, bpe.vocabulary_path()).collect()
    assert len(rows) == 3 and {r["n_tokens"] for r in rows} - {0} and all(len(r["ids_sha256"]) == 64 for r in rows)
