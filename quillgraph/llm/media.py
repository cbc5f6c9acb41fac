"""Media columns: Netpbm and BMP images in binary columns, as numpy arrays inside tasks.

Decodes P1 to P6 and uncompressed BMP, resizes by area through integral images, and
writes small tiles as NPY bytes with a difference hash. Images are rows: Spark deals
them out, nothing is shuffled, and long images are summed band by band.

Defined results: null media, and bytes that are no such image (too few bytes for the size that the
header says, samples over its maximum, palette indices beyond the palette), give null features and a false
``decoded``; no bytes at all make a task fail; repeated rows give repeated rows; an empty table gives no rows; only the named
columns are read. For texts as payloads: null counts as empty, which is one row of spaces.
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
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import blank

#: Values of an image that are summed at once.
BAND = 1 << 20
NETPBM = re.compile(rb"P([1-6])" + rb"(?:\s|#[^\n]*\n)+(\d+)" * 2)
NUMBER = re.compile(rb"(?:\s|#[^\n]*\n)+(\d+)")


def encode_ppm(image: np.ndarray) -> bytes:
    """P6 for three channels, P5 for one."""
    height, width = image.shape[:2]
    return b"P%d\n%d %d\n255\n" % (6 if image.ndim == 3 else 5, width, height) + np.ascontiguousarray(image, np.uint8).tobytes()


def encode_bmp(image: np.ndarray) -> bytes:
    """24-bit, bottom row first, rows padded to four bytes."""
    height, width = image.shape[:2]
    rows = np.zeros((height, -(-width * 3 // 4) * 4), np.uint8)
    rows[:, : width * 3] = image[::-1, :, ::-1].reshape(height, -1)
    return struct.pack("<2sIHHIIiiHHIIiiII", b"BM", 54 + rows.size, 0, 0, 54, 40, width, height, 1, 24, 0, rows.size, 0, 0, 0, 0) + rows.tobytes()


def decode(media: bytes) -> np.ndarray | None:
    """The image's samples, (height, width) or (height, width, 3); None if it is none."""
    try:
        return _decode_bmp(media) if media[:2] == b"BM" else _decode_netpbm(media)
    except (ValueError, struct.error):
        return None


def _decode_netpbm(media: bytes) -> np.ndarray | None:
    if not (found := NETPBM.match(media)):
        return None
    kind, width, height = (int(x) for x in found.groups())
    end, most, bitmap, channels = found.end(), 1, kind in (1, 4), 3 if kind in (3, 6) else 1
    if not bitmap:
        if not (number := NUMBER.match(media, end)):
            return None
        end, most = number.end(), int(number[1])
    shape = (height, width, 3)[: 2 + (channels == 3)]
    size = width * height * channels
    # every kind has a bit at least for each sample
    if not (size and 0 < most < 65536 and size <= 8 * len(media)):
        return None
    if kind <= 3:
        body = re.sub(rb"#[^\n]*", b"", media[end:])
        if bitmap:  # digits may stand without space
            plain = re.findall(rb"[01]", body)[:size]
        else:
            plain = body.split()[:size]
        if len(plain) < size or any(not x.isdigit() or len(x.lstrip(b"0")) > 5 for x in plain):
            return None
        samples = np.array([int(x) for x in plain], np.int64)
        if samples.max() > most:
            return None
        return ((1 - samples) * 255 if bitmap else samples).astype(np.uint8 if most < 256 else np.uint16).reshape(shape)
    end += 1  # one white space
    if kind == 4:
        line = -(-width // 8)
        bits = np.unpackbits(np.frombuffer(media, np.uint8, line * height, end).reshape(height, line), axis=1)[:, :width]
        return (1 - bits) * np.uint8(255)
    samples = np.frombuffer(media, np.uint8 if most < 256 else ">u2", size, end)
    return samples.reshape(shape) if samples.max() <= most else None


def _decode_bmp(media: bytes) -> np.ndarray | None:
    start, head, width, height, _, depth, packed = struct.unpack_from("<10xIIiiHHI", media)
    top_down, height = height < 0, abs(height)
    line = -(-max(width, 0) * depth // 32) * 4
    if packed or head < 40 or depth not in (8, 24, 32) or width <= 0 or not height or start + line * height > len(media):
        return None
    rows = np.frombuffer(media, np.uint8, line * height, start).reshape(height, line)
    rows = rows if top_down else rows[::-1]
    if depth == 8:
        colours = struct.unpack_from("<I", media, 46)[0] or 256
        if colours > 256 or 14 + head + 4 * colours > len(media) or (indices := rows[:, :width]).max() >= colours:
            return None
        return np.frombuffer(media, np.uint8, 4 * colours, 14 + head).reshape(-1, 4)[:, 2::-1][indices]
    return rows[:, : width * depth // 8].reshape(height, width, depth // 8)[:, :, 2::-1]


def _spans(size: int, to: int) -> tuple[np.ndarray, np.ndarray]:
    """Edges of ``to`` equal spans: whole places, and the part of the next one."""
    edges = np.arange(to + 1) * size / to
    whole = np.minimum(edges.astype(np.int64), size - 1)
    return whole, edges - whole


def _sums_before(image: np.ndarray, to: int) -> np.ndarray:
    """Sums of all rows before each of the edges of ``to`` equal spans; rows are read in bands."""
    whole, part = _spans(len(image), to)
    across = [1] * (image.ndim - 1)
    sums, total = np.zeros((to + 1, *image.shape[1:])), np.zeros(image.shape[1:])
    band = max(1, BAND // max(1, total.size))
    for at in range(0, len(image), band):
        rows = np.cumsum(image[at : at + band], axis=0, dtype=np.float64)
        here = (whole >= at) & (whole < at + len(rows))
        k = whole[here] - at
        sums[here] = total + np.where((k > 0).reshape(-1, *across), rows[k - 1], 0)
        total = total + rows[-1]
    return sums + part.reshape(-1, *across) * image[whole]


def _shrink(image: np.ndarray, to: int) -> np.ndarray:
    """Means over ``to`` equal spans of the first axis."""
    return np.diff(_sums_before(image, to), axis=0) * (to / len(image))


def area_resize(image: np.ndarray, height: int, width: int) -> np.ndarray:
    """Area means, larger or smaller, from the corners of each cell in the image's integral image.

    Only the rows at cells' edges are held of the integral image, along the longer side.
    """
    if image.shape[1] > image.shape[0]:
        return np.swapaxes(area_resize(np.swapaxes(image, 0, 1), width, height), 0, 1)
    rows = np.cumsum(_sums_before(image, height), axis=1)
    rows = np.concatenate([np.zeros_like(rows[:, :1]), rows], axis=1)
    whole, part = _spans(image.shape[1], width)
    left = rows[:, whole]
    corners = left + part.reshape(-1, *[1] * (image.ndim - 2)) * (rows[:, whole + 1] - left)
    return np.diff(np.diff(corners, axis=0), axis=1) * (height * width / (image.shape[0] * image.shape[1]))


def npy_tile(image: np.ndarray, side: int) -> bytes:
    tile = np.rint(area_resize(image, side, side)).astype(np.uint8 if image.dtype.itemsize == 1 else np.uint16)
    np.save(out := io.BytesIO(), tile, allow_pickle=False)
    return out.getvalue()


def difference_hash(tile: bytes) -> str:
    """Of an NPY tile: 64 bits, one where brightness falls from a cell to its right neighbour, of 8 rows and 9 columns."""
    image = np.load(io.BytesIO(tile), allow_pickle=False)
    grey = image.mean(axis=2) if image.ndim == 3 else image
    cells = area_resize(grey, 8, 9)
    return np.packbits(np.round(cells[:, :-1], 6) > np.round(cells[:, 1:], 6)).tobytes().hex()


SCHEMA = "decoded boolean, height int, width int, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, tile binary, feature string"


def _features(media: bytes | None, side: int) -> tuple:
    if media is None or (image := decode(media)) is None:
        return (False, None, None, None, None, None, None if media is None else len(media), None if media is None else hashlib.sha256(media).hexdigest(), None, None)
    payload = image.tobytes()
    tile = npy_tile(image, side)
    return (
        True, *image.shape[:2], len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-16:]),
        len(media), hashlib.sha256(media).hexdigest(), tile, difference_hash(tile),
    )


def media_features(df: DataFrame, keep: list[str], media_col: str = "media", side: int = 32) -> DataFrame:
    """Columns ``keep`` and what the images in ``media_col`` hold: digests of samples and stored bytes, an NPY tile, a difference hash."""
    rows = df.select(*keep, F.col(media_col).alias("media"))
    schema = rows.select(*keep, *[F.lit(None).cast(kind).alias(name) for name, kind in (x.split() for x in SCHEMA.split(", "))]).schema
    names, kinds = schema.names, [pa.bool_(), pa.int32(), pa.int32(), pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.binary(), pa.string()]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                part = batch.slice(at, 256)
                got = [_features(m.as_py(), side) for m in part.column(len(keep))]
                made = [pa.array([g[i] for g in got], kind) for i, kind in enumerate(kinds)]
                yield pa.RecordBatch.from_arrays([*part.columns[: len(keep)], *made], names)

    return rows.mapInArrow(run, schema)


ENCODERS = {"ppm": encode_ppm, "bmp": encode_bmp}


def text_media(docs: DataFrame, width: int = 64, id_col: str = "doc_id", text_col: str = "text", kinds: tuple[str, ...] = ("ppm",)) -> DataFrame:
    """``id_col, n_bytes, media``: each whole text as the samples of an image ``width`` pixels wide, filled up with spaces.

    With several kinds (ppm, bmp) a hash of the text says which one stores it.
    """
    line = 3 * width
    rows = docs.select(F.col(id_col), blank(F.col(text_col)).alias("text_"))
    schema = rows.select(id_col, F.lit(0).cast("long").alias("n_bytes"), F.lit(b"").alias("media")).schema

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                part = batch.slice(at, 256)
                raw = [t.as_py().encode("utf-8", "surrogatepass") for t in part.column(1)]
                filled = [r + b" " * (-len(r) % line if r else line) for r in raw]
                media = [ENCODERS[kinds[zlib.crc32(f) % len(kinds)]](np.frombuffer(f, np.uint8).reshape(-1, width, 3)) for f in filled]
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array([len(r) for r in raw], pa.int64()), pa.array(media, pa.binary())], [id_col, "n_bytes", "media"])

    return rows.mapInArrow(run, schema)
