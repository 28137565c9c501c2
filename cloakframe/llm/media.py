"""Media columns: Netpbm and BMP images decoded to numpy arrays, area-resized by integral images, kept as NPY tiles with difference hashes.

Defined results: a null image or one that can't be decoded gives a row with a null tile and a null hash; images of any
size give a tile of the asked size (smaller images are enlarged by the same area rule). Netpbm samples are scaled to 255, or to 65535 if their maximum is over 255; bits of P1 and P4 stay 0 and 1.
Columns of the input that clash with the columns added here are replaced; all others are kept; an empty table gives an empty one. No step shuffles, so memory is one Arrow batch;
a very long text is one image.
"""

from __future__ import annotations

import hashlib
import io
import re
import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, functions as F

from cloakframe.llm.common import lean, passing, slices, table, text_batches, written

UNIT, TILE = 192, 16


def decode_netpbm(data: bytes) -> np.ndarray:
    """P1 to P6, plain and raw, as (height, width, channels); samples over 8 bits as uint16."""
    kind = data[:2]
    if kind not in (b"P1", b"P2", b"P3", b"P4", b"P5", b"P6"):
        raise ValueError("not Netpbm")
    at, head = 2, []
    while len(head) < (2 if kind in (b"P1", b"P4") else 3):
        found = re.compile(rb"(?:\s|#[^\n\r]*[\n\r])*(\d+)").match(data, at)
        if not found:
            raise ValueError("Netpbm header is cut short")
        head.append(int(found[1]))
        at = found.end()
    width, height, most = (*head, 1)[:3]
    channels = 3 if kind in (b"P3", b"P6") else 1
    n = width * height * channels
    if not n or not 0 < most < 65536 or n > 8 * len(data):
        raise ValueError("Netpbm size or maximum is wrong, or data is cut short")
    if kind in (b"P2", b"P3"):
        out = np.array(re.sub(rb"#[^\n\r]*", b"", data[at:]).split()[:n], dtype=np.int64)
    elif kind == b"P1":
        out = 1 - np.frombuffer(re.sub(rb"#[^\n\r]*|\s", b"", data[at:])[:n], np.uint8) % 2
    elif kind == b"P4":
        stride = (width + 7) // 8
        rows = np.frombuffer(data, np.uint8, stride * height, at + 1).reshape(height, stride)
        out = 1 - np.unpackbits(rows, axis=1)[:, :width]
    else:
        out = np.frombuffer(data, np.uint8 if most < 256 else ">u2", n, at + 1)
    if out.size != n or out.min() < 0 or out.max() > most:
        raise ValueError("Netpbm data is cut short or a sample exceeds the maximum")
    full = 255 if most < 256 else 65535
    if most not in (1, full) or (most == 1 and kind not in (b"P1", b"P4")):
        out = (out.astype(np.int64) * full + most // 2) // most
    return out.astype(np.uint8 if most < 256 else np.uint16, copy=False).reshape(height, width, channels)


def decode_bmp(data: bytes) -> np.ndarray:
    """Uncompressed BMP of 1, 4, 8, 16, 24 or 32 bits a pixel, with or without bit masks, either row order, old and new headers, as (height, width, 3) of uint8 in RGB."""
    if data[:2] != b"BM" or len(data) < 26:
        raise ValueError("not BMP")
    start, head = struct.unpack_from("<II", data, 10)
    old, packed = head == 12, 0
    if old:
        width, height, _, bits = struct.unpack_from("<HHHH", data, 18)
    else:
        width, height, _, bits, packed = struct.unpack_from("<iiHHI", data, 18)
    if packed not in (0, 3) or bits not in (1, 4, 8, 16, 24, 32) or (packed == 3 and bits not in (16, 32)) or width <= 0 or not height:
        raise ValueError("BMP kind isn't handled")
    rows, stride = abs(height), (width * bits + 31) // 32 * 4
    raw = np.frombuffer(data, np.uint8, stride * rows, start).reshape(rows, stride)
    if height > 0:
        raw = raw[::-1]
    if packed == 3 or bits == 16:
        masks = struct.unpack_from("<III", data, 54) if packed == 3 else (0x7C00, 0x3E0, 0x1F)
        pixels = np.ascontiguousarray(raw[:, : width * bits // 8]).view(f"<u{bits // 8}").astype(np.int64)
        if not all(masks):
            raise ValueError("a BMP mask is empty")
        low = [(m & -m).bit_length() - 1 for m in masks]
        return np.stack([(((pixels & m) >> k) * 255 + (m >> k) // 2) // (m >> k) for m, k in zip(masks, low, strict=True)], axis=2).astype(np.uint8)
    if bits >= 24:
        return np.ascontiguousarray(raw[:, : width * bits // 8].reshape(rows, width, bits // 8)[:, :, 2::-1])
    colours = 1 << bits if old else struct.unpack_from("<I", data, 46)[0] or 1 << bits
    wide = 3 if old else 4
    palette = np.frombuffer(data, np.uint8, wide * colours, 14 + head).reshape(-1, wide)[:, 2::-1]
    index = raw if bits == 8 else np.unpackbits(raw, axis=1) if bits == 1 else np.stack([raw >> 4, raw & 15], axis=2).reshape(rows, -1)
    return palette[index[:, :width]]


def decode_image(data: bytes) -> np.ndarray:
    return decode_bmp(data) if data[:2] == b"BM" else decode_netpbm(data)


def encode_ppm(pixels: np.ndarray) -> bytes:
    height, width, channels = pixels.shape
    return b"P%d\n%d %d\n255\n" % (6 if channels == 3 else 5, width, height) + pixels.tobytes()


def encode_bmp(pixels: np.ndarray) -> bytes:
    height, width, _ = pixels.shape
    stride = (width * 3 + 3) // 4 * 4
    body = np.zeros((height, stride), np.uint8)
    body[:, : width * 3] = pixels[::-1, :, ::-1].reshape(height, width * 3)
    return b"BM" + struct.pack("<IHHIIiiHHIIiiII", 54 + body.size, 0, 0, 54, 40, width, height, 1, 24, 0, body.size, 2835, 2835, 0, 0) + body.tobytes()


def _edges(size: int, parts: int) -> tuple[np.ndarray, np.ndarray]:
    at = np.arange(parts + 1) * (size / parts)
    low = np.minimum(at.astype(np.int64), size - 1)
    return low, at - low


def area_resize(pixels: np.ndarray, height: int, width: int) -> np.ndarray:
    """The mean of each of height x width equal areas, pixels on a border counted by the share inside, from an integral image."""
    h, w, c = pixels.shape
    total = np.zeros((h + 1, w, c))
    np.cumsum(pixels, axis=0, out=total[1:], dtype=np.float64)
    y, fy = _edges(h, height)
    rows = np.diff(total[y] + fy[:, None, None] * (total[y + 1] - total[y]), axis=0)
    across = np.zeros((height, w + 1, c))
    np.cumsum(rows, axis=1, out=across[:, 1:])
    x, fx = _edges(w, width)
    cells = np.diff(across[:, x] + fx[None, :, None] * (across[:, x + 1] - across[:, x]), axis=1)
    return cells * (height * width / (h * w))


def grey(pixels: np.ndarray) -> np.ndarray:
    return pixels if pixels.shape[2] == 1 else (pixels @ np.array([0.299, 0.587, 0.114]))[:, :, None]


def difference_hash(pixels: np.ndarray) -> int:
    """64 bits: of each of 8 rows of 9 grey areas, whether an area is darker than the next."""
    small = np.rint(area_resize(pixels, 8, 9) * 256).astype(np.int64)
    levels = np.rint(grey(small)).astype(np.int64)[:, :, 0]
    return int.from_bytes(np.packbits(levels[:, :-1] < levels[:, 1:]).tobytes(), "big")


def tile_npy(pixels: np.ndarray, size: int = TILE) -> bytes:
    out = io.BytesIO()
    np.save(out, np.clip(np.rint(area_resize(pixels, size, size)), 0, 65535).astype(pixels.dtype), allow_pickle=False)
    return out.getvalue()


def tiles(df: DataFrame, image: str = "image", size: int = TILE) -> DataFrame:
    """df with height, width, tile_npy (an NPY file of size x size areas) and dhash (16 hex digits) of its image column."""
    added = "height int, width int, tile_npy binary, dhash string"
    names = [x.split()[0] for x in added.split(", ")]
    kept = [c for c in df.columns if c not in names]
    schema = ", ".join([*(f"`{c}` {df.schema[c].dataType.simpleString()}" for c in kept), added])

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            made = []
            for data in batch.column(image).to_pylist():
                try:
                    pixels = decode_image(bytes(data))
                    made.append((*pixels.shape[:2], tile_npy(pixels, size), f"{difference_hash(pixels):016x}"))
                except (ValueError, TypeError, struct.error, IndexError, ArithmeticError):
                    made.append((None,) * 4)
            cols = list(zip(*made, strict=True)) or [[]] * 4
            kinds = (pa.int32(), pa.int32(), pa.binary(), pa.string())
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in kept), *(pa.array(x, t) for x, t in zip(cols, kinds, strict=True))], names=[*kept, *names])

    return df.mapInArrow(work, schema)


def write_tiles(df: DataFrame, path: str, image: str = "image", size: int = TILE) -> None:
    """Writes the tiles of df as a table whose tile_npy values are NPY files, through Spark's own writer."""
    tiles(df, image, size).drop(image).write.parquet(path)


def store_payload(payload: bytes) -> bytes:
    """An image whose 8-bit samples are the payload (a multiple of 192 bytes): P6, P5 or BMP, as the payload's checksum says."""
    kind = zlib.crc32(payload) % 3
    samples = np.frombuffer(payload, np.uint8)
    if kind == 1:
        return encode_ppm(samples.reshape(-1, UNIT, 1))
    pixels = samples.reshape(-1, UNIT // 3, 3)
    return encode_bmp(pixels) if kind else encode_ppm(pixels)


def text_media(docs: DataFrame) -> DataFrame:
    """Each whole text (null: empty) as UTF-8, padded with spaces to a positive multiple of 192 bytes and stored as an image's samples in a table of images;
    the images are read back, decoded and described, their NPY tiles are written, and the tiles' digests are taken from what was written. Equal texts give equal values.
    Rows are kept one for one, repeated ones too."""
    text_batches(docs.sparkSession)

    def store(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, "text", 1 << 22):
                texts = [x.as_buffer().to_pybytes() if x.is_valid else b"" for x in part.column("text").cast(pa.binary())]
                images = [store_payload(t + b" " * (UNIT - len(t) % UNIT if len(t) % UNIT or not t else 0)) for t in texts]
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), pa.array(list(map(len, texts)), pa.int64()), pa.array(images, pa.binary())], names=["doc_id", "n_bytes", "image"])

    stored = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(lean(store), "doc_id long, n_bytes long, image binary")
    schema = "doc_id long, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, seen string, media_kind string, tile_npy binary"

    def described(image: bytes) -> tuple:
        pixels = decode_image(image)
        back = pixels.tobytes()
        seen = f"{difference_hash(pixels):016x}-{pixels.shape[0]}x{pixels.shape[1]}"
        return len(back), hashlib.sha256(back).hexdigest(), zlib.crc32(back[-16:]), len(image), hashlib.sha256(image).hexdigest(), seen, "bmp" if image[:2] == b"BM" else image[:2].decode(), tile_npy(pixels)

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, "image", 1 << 22):
                cols = zip(*(described(x.as_buffer().to_pybytes()) for x in part.column("image")), strict=True)
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), part.column("n_bytes"), *(pa.array(x) for x in cols)], names=[x.split()[0] for x in schema.split(", ")])

    with passing(docs.sparkSession):
        tiled = written(written(stored, "images").mapInArrow(lean(work), schema), "tiles", lasts=True)
    feature = F.concat_ws("-", "seen", F.substring(F.sha2("tile_npy", 256), 1, 16)).alias("feature")
    return tiled.select("doc_id", "n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", feature, "media_kind", F.octet_length("tile_npy").cast("long").alias("tile_bytes"))


def op1_media(spark: SparkSession, sf_dir: str) -> DataFrame:
    return text_media(table(spark, sf_dir, "documents"))


QUERIES = {"op1_media": op1_media}
ORACLE_SQL: dict[str, str] = {}

