"""TIFF media columns: write byte payloads as images, walk directories, decode every page.

The reader takes little- and big-endian classic TIFF, walks the chain of image directories,
decodes uncompressed, PackBits, LZW and deflate strips or tiles of 8- or 16-bit samples,
chunky or planar, undoes the horizontal predictor and gives one row per page.

The writer stores bytes as 8-bit RGB images 64 pixels (192 bytes) wide, deflate strips with
the horizontal predictor, at most ``PAGE_ROWS`` rows to a page.

Defined results: a null text is an empty one; a null medium has no page; a medium of which any
page can't be read has one row with page -1 and the reason in ``error``: that includes sizes
of zero, and pages, strips or tiles of more than ``max_page_bytes`` bytes, which are refused
before anything of that size is made. Columns other than the medium are carried along.
"""

from __future__ import annotations

import struct
import zlib
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import as_bytes, mapped

WIDTH, SAMPLES = 64, 3
UNIT = WIDTH * SAMPLES
PAGE_ROWS, STRIP_ROWS = 512, 64
#: Bytes of one page's samples, or of one strip or tile, that the reader takes on.
MAX_PAGE_BYTES = 256 << 20
#: Bytes of samples after which a task passes its rows on.
OUT_BYTES = 8 << 20

# Tag numbers, compression schemes and field types of the format.
IMAGE_WIDTH, IMAGE_LENGTH, BITS, COMPRESSION, PHOTOMETRIC = 256, 257, 258, 259, 262
STRIP_OFFSETS, SAMPLES_PER_PIXEL, ROWS_PER_STRIP, STRIP_COUNTS, PLANAR = 273, 277, 278, 279, 284
PREDICTOR, TILE_WIDTH, TILE_LENGTH, TILE_OFFSETS, TILE_COUNTS = 317, 322, 323, 324, 325
NONE, LZW, DEFLATE, OLD_DEFLATE, PACKBITS = 1, 5, 8, 32946, 32773
BYTE, SHORT, LONG = 1, 3, 4


class Page(NamedTuple):
    width: int
    height: int
    samples: int
    bits: int
    compression: int
    pixels: bytes


def packbits_decode(data: bytes, size: int = MAX_PAGE_BYTES) -> bytes:
    """Runs and literals, until at least ``size`` bytes are there."""
    out, i, n = bytearray(), 0, len(data)
    while i < n and len(out) < size:
        k = data[i]
        if k < 128:
            out += data[i + 1 : i + 2 + k]
            i += 2 + k
        else:
            if k > 128 and i + 1 < n:
                out += data[i + 1 : i + 2] * (257 - k)
            i += 2 if k > 128 else 1
    return bytes(out)


def deflate_decode(data: bytes, size: int = MAX_PAGE_BYTES) -> bytes:
    return zlib.decompressobj().decompress(data, size)


def lzw_decode(data: bytes, size: int = MAX_PAGE_BYTES) -> bytes:
    """Codes of 9 to 12 bits, most significant first; 256 clears the table, 257 ends. Stops when
    at least ``size`` bytes are there."""
    table: list[bytes] = []
    out: list[bytes] = []
    made = 0
    width, held, bits, last = 9, 0, 0, b""
    for byte in data:
        held, bits = held << 8 | byte, bits + 8
        if bits < width:
            continue
        bits -= width
        code, held = held >> bits, held & ((1 << bits) - 1)
        if code == 256:
            table, width, last = [bytes([i]) for i in range(256)] + [b"", b""], 9, b""
            continue
        if code == 257:
            break
        if not table:
            raise ValueError("LZW data without a first clear code")
        if code < len(table):
            word = table[code]
        elif code == len(table) and last:
            word = last + last[:1]
        else:
            raise ValueError("LZW code beyond the table")
        out.append(word)
        made += len(word)
        if made >= size:
            break
        if last:
            table.append(last + word[:1])
            if len(table) >= (1 << width) - 1 and width < 12:
                width += 1
        last = word
    return b"".join(out)


_DECODERS = {NONE: lambda data, size: data, LZW: lzw_decode, DEFLATE: deflate_decode, OLD_DEFLATE: deflate_decode, PACKBITS: packbits_decode}


def _directory(data: bytes, order: str, at: int) -> tuple[dict[int, list[int]], int]:
    sizes, codes = {1: 1, 2: 1, 3: 2, 4: 4, 5: 8}, {1: "B", 2: "B", 3: "H", 4: "I", 5: "Q"}
    (count,) = struct.unpack_from(order + "H", data, at)
    tags = {}
    for i in range(count):
        tag, kind, n = struct.unpack_from(order + "HHI", data, at + 2 + 12 * i)
        if kind not in sizes:
            continue
        place = at + 10 + 12 * i
        if n * sizes[kind] > 4:
            (place,) = struct.unpack_from(order + "I", data, place)
        tags[tag] = list(struct.unpack_from(f"{order}{n}{codes[kind]}", data, place))
    return tags, struct.unpack_from(order + "I", data, at + 2 + 12 * count)[0]


def pages_of(data: bytes, max_page_bytes: int = MAX_PAGE_BYTES) -> Iterator[Page]:
    """The pages of one TIFF file, in the order of its directories."""
    order = {b"II": "<", b"MM": ">"}.get(data[:2])
    if order is None or struct.unpack_from(order + "H", data, 2)[0] != 42:
        raise ValueError("not a classic TIFF file")
    (at,) = struct.unpack_from(order + "I", data, 4)
    seen = set()
    while at:
        if at in seen:
            raise ValueError("directories form a loop")
        seen.add(at)
        tags, at = _directory(data, order, at)
        yield _page(data, order, tags, max_page_bytes)


def _page(data: bytes, order: str, tags: dict[int, list[int]], max_page_bytes: int) -> Page:
    one = lambda tag, default: tags.get(tag, [default])[0]
    width, height = tags[IMAGE_WIDTH][0], tags[IMAGE_LENGTH][0]
    samples, bits, scheme = one(SAMPLES_PER_PIXEL, 1), one(BITS, 1), one(COMPRESSION, NONE)
    if bits not in (8, 16):
        raise ValueError(f"{bits}-bit samples")
    if scheme not in _DECODERS:
        raise ValueError(f"compression {scheme}")
    planar = one(PLANAR, 1) == 2
    tiled = TILE_OFFSETS in tags
    w, h = (tags[TILE_WIDTH][0], tags[TILE_LENGTH][0]) if tiled else (width, min(height, one(ROWS_PER_STRIP, height)))
    if min(width, height, samples, w, h) < 1:
        raise ValueError("a size of zero")
    if samples * bits // 8 * max(width * height, w * h) > max_page_bytes:
        raise ValueError(f"a page, strip or tile of more than {max_page_bytes} bytes")
    offsets, counts = (tags[TILE_OFFSETS], tags[TILE_COUNTS]) if tiled else (tags[STRIP_OFFSETS], tags[STRIP_COUNTS])
    kind = np.dtype(np.uint8 if bits == 8 else order + "u2")
    depth = 1 if planar else samples
    image = np.zeros((samples if planar else 1, height, width, depth), kind)
    across, down = -(-width // w), -(-height // h)
    for k in range(across * down * (samples if planar else 1)):
        plane, place = divmod(k, across * down)
        y, x = place // across * h, place % across * w
        rows = h if tiled else min(h, height - y)
        raw = _DECODERS[scheme](data[offsets[k] : offsets[k] + counts[k]], rows * w * depth * kind.itemsize)
        block = np.frombuffer(raw, kind, rows * w * depth).reshape(rows, w, depth)
        if one(PREDICTOR, 1) == 2:
            block = np.cumsum(block, axis=1, dtype=kind.newbyteorder("="))
        image[plane, y : y + rows, x : x + w] = block[: height - y, : width - x]
    pixels = image.transpose(1, 2, 0, 3) if planar else image[0]
    return Page(width, height, samples, bits, scheme, pixels.astype(kind.newbyteorder("<")).tobytes())


def encode(payload: bytes) -> bytes:
    """A TIFF file whose pages' pixels are ``payload``, a positive multiple of 192 bytes."""
    if not payload or len(payload) % UNIT:
        raise ValueError(f"a payload is a positive multiple of {UNIT} bytes")
    rows = np.frombuffer(payload, np.uint8).reshape(-1, WIDTH, SAMPLES)
    out = bytearray(b"II*\0\0\0\0\0")
    link = 4
    for first in range(0, len(rows), PAGE_ROWS):
        page = rows[first : first + PAGE_ROWS]
        page = np.concatenate((page[:, :1], page[:, 1:] - page[:, :-1]), axis=1)
        offsets, counts = [], []
        for y in range(0, len(page), STRIP_ROWS):
            strip = zlib.compress(page[y : y + STRIP_ROWS].tobytes(), 1)
            offsets.append(len(out))
            counts.append(len(strip))
            out += strip
        fields = [(IMAGE_WIDTH, SHORT, [WIDTH]), (IMAGE_LENGTH, LONG, [len(page)]), (BITS, SHORT, [8] * SAMPLES), (COMPRESSION, SHORT, [DEFLATE]), (PHOTOMETRIC, SHORT, [2]), (STRIP_OFFSETS, LONG, offsets), (SAMPLES_PER_PIXEL, SHORT, [SAMPLES]), (ROWS_PER_STRIP, LONG, [STRIP_ROWS]), (STRIP_COUNTS, LONG, counts), (PLANAR, SHORT, [1]), (PREDICTOR, SHORT, [2])]
        entries = bytearray()
        for tag, kind, values in fields:
            packed = struct.pack(f"<{len(values)}{'H' if kind == SHORT else 'I'}", *values)
            if len(packed) > 4:
                out += b"\0" * (len(out) % 2)
                place = struct.pack("<I", len(out))
                out += packed
            else:
                place = packed.ljust(4, b"\0")
            entries += struct.pack("<HHI", tag, kind, len(values)) + place
        out += b"\0" * (len(out) % 2)
        struct.pack_into("<I", out, link, len(out))
        out += struct.pack("<H", len(fields)) + entries
        link = len(out)
        out += b"\0\0\0\0"
    return bytes(out)


def padded(text: bytes) -> bytes:
    return text.ljust(max(UNIT, -(-len(text) // UNIT) * UNIT))


def to_tiff(documents: DataFrame) -> DataFrame:
    """``documents(doc_id, text)`` to doc_id, n_bytes and media (the text's bytes as a TIFF file)."""

    def rows(batch):
        texts = as_bytes(batch.column("text"))
        return {"doc_id": batch.column("doc_id"), "n_bytes": pa.array([len(t) for t in texts], pa.int64()), "media": pa.array([encode(padded(t)) for t in texts], pa.binary())}

    plain = documents.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return mapped(plain, "doc_id bigint, n_bytes bigint, media binary", rows)


_PAGE_FIELDS = [("page", pa.int32()), ("width", pa.int32()), ("height", pa.int32()), ("samples", pa.int32()), ("bits", pa.int32()), ("compression", pa.int32()), ("pixels", pa.binary()), ("error", pa.string())]


def tiff_pages(media: DataFrame, column: str = "media", max_page_bytes: int = MAX_PAGE_BYTES) -> DataFrame:
    """One row per page of the files in ``column``: the other columns (those named like a
    page's are left out), page, width, height, samples, bits, compression, pixels, error."""
    own = [n for n, _ in _PAGE_FIELDS]
    others = [f for f in media.schema.fields if f.name != column and f.name not in own]
    names = [f.name for f in others]
    ddl = ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in others), "page int, width int, height int, samples int, bits int, compression int, pixels binary, error string"])

    def found(data):
        try:
            return [(k, *p, None) for k, p in enumerate(pages_of(data, max_page_bytes))]
        except (ValueError, KeyError, IndexError, OverflowError, MemoryError, struct.error, zlib.error) as e:
            return [(-1, None, None, None, None, None, None, f"{type(e).__name__}: {e}")]

    def made(batch, take, out):
        columns = list(zip(*out, strict=True)) or [()] * len(own)
        index = pa.array(take, pa.int32())
        return pa.RecordBatch.from_arrays([*(batch.column(n).take(index) for n in names), *(pa.array(c, t) for c, (_, t) in zip(columns, _PAGE_FIELDS, strict=True))], names + own)

    def run(batches):
        for batch in batches:
            take, out, size = [], [], 0
            for i, data in enumerate(batch.column(column)):
                if (data := data.as_py()) is None:
                    continue
                pages = found(data)
                take += [i] * len(pages)
                out += pages
                size += sum(len(p[6] or b"") for p in pages)
                if size > OUT_BYTES:
                    yield made(batch, take, out)
                    take, out, size = [], [], 0
            yield made(batch, take, out)

    return media.select(*names, column).mapInArrow(run, ddl)


def features(payload: np.ndarray, pages: int) -> str:
    """Pages, sum of samples, and the share in 1/10,000 of samples in each of 8 equal ranges."""
    share = np.bincount(payload >> 5, minlength=8) * 10_000 // len(payload)
    return f"{pages}:{int(payload.sum(dtype=np.int64))}:" + "-".join(map(str, share.tolist()))


def digest(documents: DataFrame) -> DataFrame:
    """The contract's columns, from pages read back; a text's pages follow one another, so no
    shuffle is needed to join them."""
    from hashlib import sha256

    media = to_tiff(documents).select("doc_id", "n_bytes", F.octet_length("media").cast("bigint").alias("media_bytes"), F.sha2("media", 256).alias("media_sha256"), "media")
    names = ["doc_id", "n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature"]

    def run(batches):
        head, parts = None, []
        out: list[tuple] = []

        def close():
            payload = b"".join(parts)
            out.append((head[0], head[1], len(payload), sha256(payload).hexdigest(), zlib.crc32(payload[-16:]), head[2], head[3], features(np.frombuffer(payload, np.uint8), len(parts))))

        for batch in batches:
            pages = batch.column("page").to_pylist()
            heads = list(zip(*(batch.column(n).to_pylist() for n in ("doc_id", "n_bytes", "media_bytes", "media_sha256")), strict=True))
            for page, h, pixels in zip(pages, heads, batch.column("pixels").to_pylist(), strict=True):
                if page == 0 and head is not None:
                    close()
                    parts = []
                head = h
                parts.append(pixels)
            yield _batch(out, names)
            out = []
        if head is not None:
            close()
        yield _batch(out, names)

    return tiff_pages(media).where("error IS NULL OR raise_error(error) IS NULL").select("doc_id", "n_bytes", "media_bytes", "media_sha256", "page", "pixels").mapInArrow(run, "doc_id bigint, n_bytes bigint, payload_bytes bigint, payload_sha256 string, tail_crc32 bigint, media_bytes bigint, media_sha256 string, feature string")


def _batch(rows: list[tuple], names: list[str]) -> pa.RecordBatch:
    kinds = [pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string()]
    columns = list(zip(*rows, strict=True)) or [()] * len(names)
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, kinds, strict=True)], names)
