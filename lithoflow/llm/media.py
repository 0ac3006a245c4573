"""Media columns: Netpbm and BMP bytes decoded to numpy arrays, area-resized, tiled as NPY, hashed.

``decode`` reads P1-P6 (text and binary, maxval up to 65535) and uncompressed BMP (1, 4, 8, 16, 24 and 32 bits, with masks
too). Samples are scaled to the full range of 8 bits (16, if maxval is above 255); a sample above maxval is an error.
``media_features`` adds per row: width, height, channels, samples (raw decoded bytes), a square NPY tile and a 64-bit
difference hash. Area resizing is exact: the integral image is read at fractional edges by bilinear interpolation.

Defined cases: null or undecodable bytes give null in every added column and an ``error`` text; equal bytes give equal
results; repeated rows are rows each; an empty table gives none; columns of the input other than the id and bytes are not
carried. Batches are cut by bytes, and long images are resized in strips, so memory follows the longest single text.
"""

from __future__ import annotations

import hashlib
import io
import re
import struct
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from .common import byte_sizes, slices

WIDTH, TILE, STRIP = 64, 32, 4096


#: The largest sample count and the most digits of a number that a header may name.
MOST_SAMPLES, DIGITS = 1 << 40, 12


def _netpbm_header(data: bytes, n: int) -> tuple[list[int], int]:
    at, out = 2, []
    while len(out) < n:
        m = re.compile(rb"(?:\s|#[^\n]*\n)*(\d+)").match(data, at)
        if not m or len(m[1]) > DIGITS:
            raise ValueError("netpbm header")
        out.append(int(m[1]))
        at = m.end()
    return out, at


def _full_range(samples: np.ndarray, top: int) -> np.ndarray:
    """Samples of 0 to top, scaled to the full range of 8 bits (16, if top is above 255) and rounded."""
    if samples.size and int(samples.max()) > top:
        raise ValueError("netpbm sample above maxval")
    kind, full = (np.uint8, 255) if top < 256 else (np.uint16, 65535)
    return samples.astype(kind) if top == full else ((samples.astype(np.uint64) * full * 2 + top) // (2 * top)).astype(kind)


def decode_netpbm(data: bytes) -> np.ndarray:
    kind = data[:2]
    if kind not in (b"P1", b"P2", b"P3", b"P4", b"P5", b"P6"):
        raise ValueError("not netpbm")
    bits = kind in (b"P1", b"P4")
    head, at = _netpbm_header(data, 2 if bits else 3)
    w, h = head[:2]
    top = 1 if bits else head[2]
    c = 3 if kind in (b"P3", b"P6") else 1
    if not (w and h and 0 < top < 65536 and w * h * c <= MOST_SAMPLES):
        raise ValueError("netpbm size")
    if kind in (b"P4", b"P5", b"P6"):
        at += 1
        if kind == b"P4":
            rows = np.frombuffer(data, np.uint8, h * ((w + 7) // 8), at).reshape(h, -1)
            return ((1 - np.unpackbits(rows, axis=1)[:, :w]) * 255).astype(np.uint8)[:, :, None]
        return _full_range(np.frombuffer(data, np.uint8 if top < 256 else ">u2", h * w * c, at), top).reshape(h, w, c)
    body = re.sub(rb"#[^\n]*", b"", data[at:])
    if kind == b"P1":
        flat = np.frombuffer(re.sub(rb"[^01]", b"", body), np.uint8)[: h * w] - 48
        return ((1 - flat.reshape(h, w)) * 255).astype(np.uint8)[:, :, None]
    words = body.split(None, h * w * c)[: h * w * c]
    if any(len(x) > DIGITS or not x.isdigit() for x in words):
        raise ValueError("netpbm sample")
    return _full_range(np.array(words, dtype=np.int64), top).reshape(h, w, c)


def _masked(pixels: np.ndarray, masks: tuple[int, ...]) -> np.ndarray:
    """The bits of each mask, scaled to 0 to 255."""
    out = np.zeros((*pixels.shape, len(masks)), np.uint8)
    for n, mask in enumerate(masks):
        if mask:
            low = (mask & -mask).bit_length() - 1
            top = mask >> low
            out[..., n] = (((pixels & mask) >> low).astype(np.uint64) * 255 * 2 + top) // (2 * top)
    return out


def decode_bmp(data: bytes) -> np.ndarray:
    offset, head, w, h, _, depth, packing = struct.unpack_from("<IIiiHHI", data, 10)
    if packing not in (0, 3) or depth not in (1, 4, 8, 16, 24, 32) or w <= 0 or h == 0 or head < 40:
        raise ValueError("bmp kind")
    if packing == 3 and depth not in (16, 32):
        raise ValueError("bmp masks")
    stride, rows = (w * depth + 31) // 32 * 4, abs(h)
    if stride * rows > MOST_SAMPLES:
        raise ValueError("bmp size")
    raw = np.frombuffer(data, np.uint8, stride * rows, offset).reshape(rows, stride)
    raw = raw[::-1] if h > 0 else raw
    if packing == 3 or depth == 16:  # masks of red, green and blue; 5 bits each where none are given
        masks = struct.unpack_from("<III", data, 54) if packing == 3 else (0x7C00, 0x3E0, 0x1F)
        pixels = np.ascontiguousarray(raw[:, : w * depth // 8]).view("<u2" if depth == 16 else "<u4")
        return _masked(pixels.astype(np.int64), masks)
    if depth >= 24:
        return raw[:, : w * depth // 8].reshape(rows, w, depth // 8)[:, :, 2::-1]
    index = raw if depth == 8 else np.unpackbits(raw, axis=1).reshape(rows, -1, depth) @ (1 << np.arange(depth)[::-1])
    colours = struct.unpack_from("<I", data, 46)[0] or 1 << depth
    if colours > 1 << depth:
        raise ValueError("bmp palette")
    palette = np.frombuffer(data, np.uint8, colours * 4, 14 + head).reshape(-1, 4)
    return palette[index[:, :w]][:, :, 2::-1]


def decode(data: bytes) -> np.ndarray:
    """Height x width x channels."""
    return decode_bmp(data) if data[:2] == b"BM" else decode_netpbm(data)


def encode_pgm(payload: bytes, width: int = WIDTH) -> bytes:
    return b"P5\n%d %d\n255\n" % (width, len(payload) // width) + payload


def grey(image: np.ndarray) -> np.ndarray:
    return image[:, :, 0].astype(np.float64) if image.shape[2] == 1 else image[:, :, :3].astype(np.float64) @ (0.299, 0.587, 0.114)


def area_resize(image: np.ndarray, height: int, width: int) -> np.ndarray:
    """Mean of each target cell's exact area, of a grey or colour image. The integral image is made in strips of rows, and only
    its rows at the target's edges are held."""
    h, w = image.shape[:2]
    edge = np.linspace(0, h, height + 1)
    low = np.minimum(edge.astype(int), h - 1)
    needed = np.unique(np.concatenate([low, low + 1]))
    held, total = np.zeros((len(needed), w)), np.zeros(w)
    for start in range(0, h, STRIP):
        part = image[start : start + STRIP]
        sums = np.cumsum(grey(part) if part.ndim == 3 else part.astype(np.float64), 0)
        here = np.flatnonzero((needed > start) & (needed <= start + len(part)))
        held[here] = total + sums[needed[here] - start - 1]
        total = total + sums[-1]
    at = np.searchsorted(needed, low)
    part = (edge - low)[:, None]
    rows = held[at] * (1 - part) + held[np.searchsorted(needed, low + 1)] * part
    table = np.concatenate([np.zeros((height + 1, 1)), np.cumsum(rows, 1)], 1)
    edge = np.linspace(0, w, width + 1)
    low = np.minimum(edge.astype(int), w - 1)
    edges = table[:, low] * (1 - (edge - low)) + table[:, low + 1] * (edge - low)
    return np.diff(np.diff(edges, axis=0), axis=1) / (h * w / (height * width))


def difference_hash(image: np.ndarray) -> str:
    small = np.round(area_resize(image, 8, 9), 6)
    return np.packbits(small[:, 1:] > small[:, :-1]).tobytes().hex()


def npy(tile: np.ndarray) -> bytes:
    np.save(out := io.BytesIO(), tile)
    return out.getvalue()


def payload_of(text: str | None) -> tuple[bytes, int]:
    raw = (text or "").encode()
    return raw + b"\0" * ((-len(raw)) % WIDTH or (0 if raw else WIDTH)), len(raw)


def text_media(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Every text as a grey PGM image of width 64: (id, n_bytes, media)."""
    kind = docs.schema[id_col].dataType.simpleString()

    def run(batches):
        for b in batches:
            for i, j in slices(b.num_rows, byte_sizes(b[1])):
                pairs = [payload_of(t.as_py()) for t in b[1].slice(i, j - i)]
                yield pa.record_batch([b[0].slice(i, j - i), pa.array([n for _, n in pairs], pa.int64()), pa.array([encode_pgm(p) for p, _ in pairs], pa.binary())], ["id", "n_bytes", "media"])

    return docs.select(id_col, text_col).mapInArrow(run, f"id {kind}, n_bytes long, media binary")


def media_features(media: DataFrame, tiles: bool = True, samples: bool = False) -> DataFrame:
    """(id, n_bytes, media) with the decoded facts; tiles: also the NPY tile, samples: also the decoded bytes."""
    kind = media.schema["id"].dataType.simpleString()
    extra = [("tile", pa.binary())] * tiles + [("samples", pa.binary())] * samples
    schema = pa.schema(
        [("n_bytes", pa.int64()), ("width", pa.int32()), ("height", pa.int32()), ("channels", pa.int32()), ("samples_bytes", pa.int64()), ("samples_sha256", pa.string()), ("tail_crc32", pa.int64()), ("media_bytes", pa.int64()), ("media_sha256", pa.string()), ("dhash", pa.string()), ("error", pa.string()), *extra]
    )

    def row(n, data):
        out = dict.fromkeys(schema.names) | {"n_bytes": n}
        if data is None:
            return out | {"error": "null"}
        out |= {"media_bytes": len(data), "media_sha256": hashlib.sha256(data).hexdigest()}
        try:
            image = decode(data)
        except (ValueError, IndexError, OverflowError, MemoryError, struct.error) as e:
            return out | {"error": str(e)[:200]}
        raw = image.tobytes()
        out |= {"height": image.shape[0], "width": image.shape[1], "channels": image.shape[2], "samples_bytes": len(raw), "samples_sha256": hashlib.sha256(raw).hexdigest(), "tail_crc32": zlib.crc32(raw[-64:]), "dhash": difference_hash(image)}
        if tiles:
            out["tile"] = npy(np.clip(np.round(area_resize(image, TILE, TILE)), 0, 65535).astype(np.uint8 if image.dtype == np.uint8 else np.uint16))
        if samples:
            out["samples"] = raw
        return out

    def run(batches):
        for b in batches:
            for i, j in slices(b.num_rows, byte_sizes(b["media"]), 128):
                part = b.slice(i, j - i)
                rows = [row(n.as_py(), m.as_py()) for n, m in zip(part["n_bytes"], part["media"], strict=True)]
                yield pa.record_batch([part["id"], *pa.RecordBatch.from_pylist(rows, schema).columns], ["id", *schema.names])

    more = ", tile binary" * tiles + ", samples binary" * samples
    return media.select("id", "n_bytes", "media").mapInArrow(run, f"id {kind}, n_bytes long, width int, height int, channels int, samples_bytes long, samples_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, dhash string, error string{more}")


def write_tiles(media: DataFrame, path: str) -> None:
    """Writes id, size, NPY tile and difference hash of each image as Parquet."""
    media_features(media).select("id", "width", "height", "channels", "tile", "dhash", "error").write.parquet(path)
