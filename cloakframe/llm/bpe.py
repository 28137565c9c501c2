"""BPE encoding and decoding by forced-boundary splitting.

A pair of neighbouring bytes that is inside no token of the vocabulary can't be merged across, so a token boundary
lies there for certain. Texts are cut before ASCII white space that follows a character which isn't white space, where
the byte pair is such a forced one (the pre-tokenizer's pattern always ends a match there as well), at the first such place after
SPAN characters; each fragment is encoded on its own and the ids are concatenated. So the work and memory of encoding
follow the fragment and not the text.

Defined results: a null text is an empty one and has no ids; every other text, however long, decodes to itself. Added
tokens of the file (their strings in a text) are found as the library finds them. Rows are kept one for one.
"""

from __future__ import annotations

import array
import hashlib
import json
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, functions as F

from cloakframe.llm.common import lean, slices, table, text_batches

#: Unicode's White_Space characters.
_SPACE = "\\t-\\r \\x85\\xa0\\u1680\\u2000-\\u200a\\u2028\\u2029\\u202f\\u205f\\u3000"
#: Fixed value: the pre-tokenizer's pattern.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
#: Fragments end at the first forced boundary after so many characters.
SPAN = 256
#: Fragments that have no boundary for so many are left to the slower library, whose time is not the square of a fragment's length.
LONG = 4096


def byte_alphabet() -> dict[str, int]:
    """The characters by which byte-level vocabularies write bytes: printable Latin-1 as itself, the others from U+0100 on."""
    plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    return {chr(b): b for b in plain} | {chr(0x100 + i): b for i, b in enumerate(sorted({*range(256)} - {*plain}))}


class ForcedBoundaryBpe:
    """Encodes and decodes with a byte-level BPE file of the tokenizers library."""

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.no_truncation()
        self.tokenizer.no_padding()
        alphabet = byte_alphabet()
        added = {x["id"]: x["content"].encode() for x in spec["added_tokens"]}
        vocabulary = {i: bytes(map(alphabet.__getitem__, t)) for t, i in spec["model"]["vocab"].items() if i not in added} | added
        self.bytes_of = [vocabulary.get(i, b"") for i in range(max(vocabulary) + 1)]
        self.inside = np.zeros((256, 256), bool)
        for token in self.bytes_of:
            codes = np.frombuffer(token, np.uint8)
            self.inside[codes[:-1], codes[1:]] = True
        # Cuts stand before the white space of `cuts`, after any character (of the BMP, not white space) whose last byte never
        # comes before one of them inside a token.
        cuts = [*range(9, 14), 32]
        forced = ~self.inside[:, cuts].any(axis=1)
        last = [c if c < 0x80 else 0x80 | c & 0x3F for c in range(0x10000)]
        space = re.compile(f"[{_SPACE}]")
        good = [bool(forced[last[c]]) and not 0xD800 <= c < 0xE000 and not space.match(chr(c)) for c in range(0x10000)]
        edges = np.flatnonzero(np.diff(np.array([False, *good, False]).astype(np.int8)))
        before = "".join(f"\\u{a:04x}-\\u{b - 1:04x}" for a, b in edges.reshape(-1, 2).tolist())
        self.fragment = re.compile(f"(?s).{{{SPAN},}}?(?:(?<=[{before}])(?=[\\t-\\r ])|\\Z)|.+")
        self.quick = self._quick(spec, {t: i for i, t in vocabulary.items() if i not in added}, added)

    @staticmethod
    def _quick(spec: dict, ranks: dict[bytes, int], added: dict[int, bytes]):
        """A faster encoder of the same vocabulary, if the file is one whose tokens' ids are their merges' ranks; else None."""
        pre, model = spec["pre_tokenizer"] or {}, spec["model"]
        alphabet = byte_alphabet()
        made = ["".join(m if isinstance(m, list) else m.split(" ")) for m in model["merges"]]
        ids = [ranks.get(bytes(map(alphabet.__getitem__, t)), -1) for t in made]
        plain = spec["normalizer"] is None and spec["post_processor"] is None and pre.get("type") == "ByteLevel" and pre.get("use_regex", True) and not pre.get("add_prefix_space")
        ranked = all(a < b for a, b in zip(ids, ids[1:], strict=False)) and ids[:1] > [255] and all(ranks.get(bytes([b]), 256) < 256 for b in range(256)) and not model.get("ignore_merges") and not model.get("dropout")
        exact = all(not (x["lstrip"] or x["rstrip"] or x["single_word"] or x["normalized"]) for x in spec["added_tokens"])
        if not (plain and ranked and exact):
            return None
        import tiktoken

        return tiktoken.Encoding("file", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={t.decode(): i for i, t in added.items()})

    def fragments(self, text: str) -> list[str]:
        return self.fragment.findall(text)

    def _encode(self, fragment: str) -> bytes:
        if self.quick is None or len(fragment) > LONG:
            return np.array(self.tokenizer.encode(fragment, add_special_tokens=False).ids, "<u4").tobytes()
        return array.array("I", self.quick.encode(fragment, allowed_special="all")).tobytes()

    def encode_batch(self, texts: list[str]) -> list[bytes]:
        """The ids of each text as little-endian unsigned 32-bit integers."""
        return [b"".join(map(self._encode, self.fragments(t))) for t in texts]

    def decode(self, ids: bytes) -> str:
        at = np.frombuffer(ids, "<u4").tolist()
        return b"".join(map(self.bytes_of.__getitem__, at)).decode("utf-8", "replace")


_loaded: dict[str, ForcedBoundaryBpe] = {}


def loaded(path: str) -> ForcedBoundaryBpe:
    if path not in _loaded:
        _loaded[path] = ForcedBoundaryBpe(path)
    return _loaded[path]


def vocabulary_path(name: str = "byte_bpe_50k.json") -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def encoded(docs: DataFrame, path: str, with_ids: bool = False) -> DataFrame:
    """doc_id, n_tokens, ids_sha256, decoded_sha256 and, if asked, the ids themselves of every whole text."""
    text_batches(docs.sparkSession)
    schema = "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string" + ", ids binary" * with_ids

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = loaded(path)
        for batch in batches:
            for part in slices(batch, "text", 1 << 22):
                ids = bpe.encode_batch([t or "" for t in part.column("text").to_pylist()])
                cols = [
                    part.column("doc_id"),
                    pa.array([len(x) // 4 for x in ids], pa.int64()),
                    pa.array([hashlib.sha256(x).hexdigest() for x in ids]),
                    pa.array([hashlib.sha256(bpe.decode(x).encode()).hexdigest() for x in ids]),
                ]
                if with_ids:
                    cols.append(pa.array(ids, pa.binary()))
                yield pa.RecordBatch.from_arrays(cols, names=[x.split()[0] for x in schema.split(", ")])

    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(lean(work), schema)


def op7_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return encoded(table(spark, sf_dir, "documents"), vocabulary_path())


QUERIES = {"op7_bpe": op7_bpe}
ORACLE_SQL: dict[str, str] = {}
