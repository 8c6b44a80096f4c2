"""Media columns: TIFF files in a binary column, one row per page out.

The reader walks the chain of image directories, fetches strips or tiles, decodes them (none, PackBits, LZW, deflate),
undoes the horizontal predictor and returns the samples of each page. The writer makes such files from bytes, losslessly.
"""

from __future__ import annotations

import hashlib
import struct
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# Fixed values of the TIFF 6.0 format: tags, field types with their sizes, compression schemes, and LZW's special codes.
WIDTH, HEIGHT, BITS, COMPRESSION, PHOTOMETRIC = 256, 257, 258, 259, 262
STRIP_OFFSETS, SAMPLES, ROWS_PER_STRIP, STRIP_COUNTS, PLANAR = 273, 277, 278, 279, 284
PREDICTOR, TILE_WIDTH, TILE_HEIGHT, TILE_OFFSETS, TILE_COUNTS = 317, 322, 323, 324, 325
TYPES = {1: ("B", 1), 3: ("H", 2), 4: ("I", 4)}
NONE, LZW, DEFLATE, OLD_DEFLATE, PACKBITS = 1, 5, 8, 32946, 32773
CLEAR, END, FIRST_FREE = 256, 257, 258
CODES_BEFORE_CLEAR = 3836
#: Pages of more bytes than this are reported as faults; a stored byte can't stand for more than GROWTH bytes in any scheme.
MOST_PAGE_BYTES, GROWTH = 1 << 30, 4096


def _code_widths() -> np.ndarray:
    """Bits of the j-th code after a clear code: entry 258 + j exists once it is written, and 511, 1023, 2047 widen."""
    entry = FIRST_FREE + np.arange(CODES_BEFORE_CLEAR + 4) - 1
    return 9 + (entry >= 511).astype(np.int64) + (entry >= 1023) + (entry >= 2047)


CODE_WIDTHS = _code_widths()
CODE_STARTS = np.concatenate([[0], np.cumsum(CODE_WIDTHS)])


def packbits_encode(rows: np.ndarray) -> bytes:
    """Runs of three and more are replicated, the rest is literal; no packet crosses a row."""
    height, width = rows.shape
    same = rows[:, 1:] == rows[:, :-1]
    triple = (same[:, 1:] & same[:, :-1]).any(axis=1) if width > 2 else np.zeros(height, bool)
    raw = rows.tobytes()
    out = bytearray()
    for r in range(height):
        line = raw[r * width : (r + 1) * width]
        if not triple[r]:
            for at in range(0, width, 128):
                part = line[at : at + 128]
                out.append(len(part) - 1)
                out += part
            continue
        changes = np.flatnonzero(~same[r]) + 1
        starts = [0, *changes.tolist(), width]
        literal = bytearray()
        for a, b in zip(starts, starts[1:], strict=False):
            if b - a < 3:
                literal += line[a:b]
                continue
            for at in range(0, len(literal), 128):
                part = literal[at : at + 128]
                out.append(len(part) - 1)
                out += part
            literal.clear()
            left = b - a
            while left:
                n = min(left, 128)
                if n == 1:
                    out += bytes((0, line[a]))
                else:
                    out += bytes((257 - n, line[a]))
                left -= n
        for at in range(0, len(literal), 128):
            part = literal[at : at + 128]
            out.append(len(part) - 1)
            out += part
    return bytes(out)


def packbits_decode(data: bytes, size: int) -> bytes:
    out, at, end, made = [], 0, len(data), 0
    while at < end and made < size:
        head = data[at]
        if head < 128:
            part = data[at + 1 : at + 2 + head]
            at += 2 + head
        elif head > 128:
            part = data[at + 1 : at + 2] * (257 - head)
            at += 2
        else:
            at += 1
            continue
        out.append(part)
        made += len(part)
    return b"".join(out)


def _pack_codes(codes: list[int]) -> np.ndarray:
    """The bits, one to a byte, of codes that follow one clear code."""
    values = np.asarray(codes, np.int64)
    widths = CODE_WIDTHS[: len(values)]
    bits = (values[:, None] >> np.arange(11, -1, -1)) & 1
    return bits[np.arange(12)[None, :] >= 12 - widths[:, None]].astype(np.uint8)


def lzw_encode(data: bytes) -> bytes:
    clear = np.array([1, 0, 0, 0, 0, 0, 0, 0, 0], np.uint8)
    parts = [clear]
    codes: list[int] = []
    table: dict[int, int] = {}
    get, prefix, free = table.get, -1, FIRST_FREE
    for byte in data:
        if prefix < 0:
            prefix = byte
            continue
        key = prefix << 8 | byte
        code = get(key)
        if code is not None:
            prefix = code
            continue
        codes.append(prefix)
        table[key] = free
        free += 1
        prefix = byte
        if len(codes) == CODES_BEFORE_CLEAR:
            codes.append(CLEAR)
            parts.append(_pack_codes(codes))
            codes.clear()
            table.clear()
            free = FIRST_FREE
    if prefix >= 0:
        codes.append(prefix)
    codes.append(END)
    parts.append(_pack_codes(codes))
    return np.packbits(np.concatenate(parts)).tobytes()


_SINGLE = [bytes((i,)) for i in range(256)] + [b"", b""]


def lzw_decode(data: bytes, size: int) -> bytes:
    """Codes are cut out of the bits a whole table at a time, as their widths depend on their number alone."""
    padded = np.frombuffer(data + b"\0\0\0", np.uint8).astype(np.int64)
    total = len(data) * 8
    out: list[bytes] = []
    bit, made, table = 0, 0, list(_SINGLE)
    while bit + 9 <= total and made < size:
        starts = bit + CODE_STARTS[:-1]
        n = int(np.searchsorted(starts + CODE_WIDTHS, total, side="right"))
        starts, widths = starts[:n], CODE_WIDTHS[:n]
        first = starts >> 3
        loaded = padded[first] << 16 | padded[first + 1] << 8 | padded[first + 2]
        codes = (loaded >> (24 - (starts & 7) - widths)) & ((1 << widths) - 1)
        stops = np.flatnonzero((codes == CLEAR) | (codes == END))
        stop = int(stops[0]) if len(stops) else n
        table = list(_SINGLE)
        previous = b""
        for code in codes[:stop].tolist():
            if code < len(table):
                entry = table[code]
            elif previous:
                entry = previous + previous[:1]
            else:
                raise ValueError("an LZW stream begins with a code that isn't a byte")
            if previous:
                table.append(previous + entry[:1])
            out.append(entry)
            made += len(entry)
            previous = entry
        if stop == n or codes[stop] == END:
            break
        bit += int(CODE_STARTS[stop + 1])
    return b"".join(out)


def decode_block(data: bytes, compression: int, size: int) -> bytes:
    if compression == NONE:
        raw = data
    elif compression == PACKBITS:
        raw = packbits_decode(data, size)
    elif compression == LZW:
        raw = lzw_decode(data, size)
    elif compression in (DEFLATE, OLD_DEFLATE):
        raw = zlib.decompressobj().decompress(data, size)
    else:
        raise ValueError(f"compression {compression} isn't supported")
    if len(raw) < size:
        raise ValueError(f"a block holds {len(raw)} bytes of {size}")
    return raw[:size]


@dataclass
class Page:
    number: int
    width: int
    height: int
    samples: int
    bits: int
    compression: int
    tiled: bool
    predictor: int
    pixels: np.ndarray  # height, width, samples


def _directory(data: bytes, at: int, order: str) -> tuple[dict[int, list[int]], int]:
    (count,) = struct.unpack_from(order + "H", data, at)
    tags: dict[int, list[int]] = {}
    for k in range(count):
        entry = at + 2 + 12 * k
        tag, kind, n = struct.unpack_from(order + "HHI", data, entry)
        if kind in TYPES:
            code, size = TYPES[kind]
            where = entry + 8 if n * size <= 4 else struct.unpack_from(order + "I", data, entry + 8)[0]
            tags[tag] = list(struct.unpack_from(f"{order}{n}{code}", data, where))
    return tags, struct.unpack_from(order + "I", data, at + 2 + 12 * count)[0]


def _undo_predictor(block: np.ndarray, predictor: int) -> np.ndarray:
    if predictor == 1:
        return block
    if predictor != 2:
        raise ValueError(f"predictor {predictor} isn't supported")
    return np.cumsum(block, axis=1, dtype=block.dtype)


def pages(data: bytes) -> Iterator[Page]:
    """The pages of a TIFF file, in the order of its directory chain. ValueError where it can't be read."""
    order = {b"II": "<", b"MM": ">"}.get(data[:2])
    if order is None or len(data) < 8 or struct.unpack_from(order + "H", data, 2)[0] != 42:
        raise ValueError("this isn't a TIFF file")
    (at,) = struct.unpack_from(order + "I", data, 4)
    seen: set[int] = set()
    total = 0
    try:
        while at and at not in seen:
            seen.add(at)
            tags, following = _directory(data, at, order)
            page = _page(data, tags, len(seen) - 1, order)
            total += page.pixels.nbytes
            if total > GROWTH * len(data):
                raise ValueError(f"{len(seen)} pages of {total} bytes can't be in a file of {len(data)} bytes, or share their strips")
            yield page
            at = following
    except (struct.error, KeyError, IndexError, OverflowError, zlib.error) as fault:
        raise ValueError(f"damaged TIFF file: {fault!r}") from fault


def _page(data: bytes, tags: dict[int, list[int]], number: int, order: str) -> Page:
    width, height = tags[WIDTH][0], tags[HEIGHT][0]
    samples, bits = tags.get(SAMPLES, [1])[0], tags.get(BITS, [1])[0]
    compression, predictor = tags.get(COMPRESSION, [NONE])[0], tags.get(PREDICTOR, [1])[0]
    if bits not in (8, 16, 32) or (samples > 1 and tags.get(PLANAR, [1])[0] != 1):
        raise ValueError(f"{samples} samples of {bits} bits in this layout aren't supported")
    dtype = np.dtype(f"{order}u{bits // 8}")
    tiled = TILE_OFFSETS in tags
    if min(width, height, samples) < 1 or width * height * samples * dtype.itemsize > min(MOST_PAGE_BYTES, GROWTH * len(data)):
        raise ValueError(f"a page of {width} x {height} x {samples} can't be in a file of {len(data)} bytes, or is too large")
    pixels = np.empty((height, width, samples), dtype.newbyteorder("="))
    if tiled:
        tall, wide = tags[TILE_HEIGHT][0], tags[TILE_WIDTH][0]
        if min(tall, wide) < 1 or tall * wide * samples * dtype.itemsize > min(MOST_PAGE_BYTES, GROWTH * len(data)):
            raise ValueError(f"tiles of {wide} x {tall} can't be in this file")
        across = -(-width // wide)
        offsets, counts = tags[TILE_OFFSETS], tags[TILE_COUNTS]
        if len(offsets) != across * -(-height // tall):
            raise ValueError(f"{len(offsets)} tiles don't make a page of {width} x {height}")
        places = [(r * tall, c * wide, tall, wide) for r in range(-(-height // tall)) for c in range(across)]
    else:
        tall = min(max(tags.get(ROWS_PER_STRIP, [height])[0], 1), height)
        offsets, counts = tags[STRIP_OFFSETS], tags[STRIP_COUNTS]
        places = [(r, 0, min(tall, height - r), width) for r in range(0, height, tall)]
    for (top, left, rows, columns), offset, n in zip(places, offsets, counts, strict=True):
        raw = decode_block(data[offset : offset + n], compression, rows * columns * samples * dtype.itemsize)
        block = np.frombuffer(raw, dtype).reshape(rows, columns, samples).astype(pixels.dtype, copy=False)
        block = _undo_predictor(block, predictor)
        pixels[top : top + rows, left : left + columns] = block[: height - top, : width - left]
    return Page(number, width, height, samples, bits, compression, tiled, predictor, pixels)


def _encode_block(block: np.ndarray, compression: int, predictor: int) -> bytes:
    if predictor == 2:
        changed = block.copy()
        changed[:, 1:] -= block[:, :-1]
        block = changed
    if compression == PACKBITS:
        return packbits_encode(block)
    raw = block.tobytes()
    return {NONE: bytes, LZW: lzw_encode, DEFLATE: lambda x: zlib.compress(x, 6)}[compression](raw)


def write_tiff(images: list[tuple[np.ndarray, int, bool, int]], rows_per_strip: int = 64, tile: int = 32) -> bytes:
    """A little-endian file of 8-bit grey pages, each given as (rows, compression, tiled, predictor)."""
    out = bytearray(b"II*\0\0\0\0\0")
    link = 4
    for rows, compression, tiled, predictor in images:
        height, width = rows.shape
        if tiled:
            padded = np.zeros((-(-height // tile) * tile, -(-width // tile) * tile), np.uint8)
            padded[:height, :width] = rows
            blocks = [padded[r : r + tile, c : c + tile] for r in range(0, height, tile) for c in range(0, width, tile)]
        else:
            blocks = [rows[r : r + rows_per_strip] for r in range(0, height, rows_per_strip)]
        offsets, counts = [], []
        for block in blocks:
            data = _encode_block(block, compression, predictor)
            offsets.append(len(out))
            counts.append(len(data))
            out += data
        fields: list[tuple[int, int, list[int]]] = [
            (WIDTH, 4, [width]), (HEIGHT, 4, [height]), (BITS, 3, [8]), (COMPRESSION, 3, [compression]),
            (PHOTOMETRIC, 3, [1]), (SAMPLES, 3, [1]),
        ]
        if tiled:
            fields += [(PREDICTOR, 3, [predictor]), (TILE_WIDTH, 4, [tile]), (TILE_HEIGHT, 4, [tile])]
            fields += [(TILE_OFFSETS, 4, offsets), (TILE_COUNTS, 4, counts)]
        else:
            fields += [(STRIP_OFFSETS, 4, offsets), (ROWS_PER_STRIP, 4, [rows_per_strip]), (STRIP_COUNTS, 4, counts)]
            fields += [(PREDICTOR, 3, [predictor])]
        fields.sort()
        out += b"\0" * (len(out) % 2)
        outside = {}
        for tag, kind, values in fields:
            if len(values) * TYPES[kind][1] > 4:
                outside[tag] = len(out)
                out += struct.pack(f"<{len(values)}{TYPES[kind][0]}", *values)
        struct.pack_into("<I", out, link, len(out))
        out += struct.pack("<H", len(fields))
        for tag, kind, values in fields:
            at = struct.pack("<I", outside[tag]) if tag in outside else struct.pack("<" + TYPES[kind][0], *values).ljust(4, b"\0")
            out += struct.pack("<HHI", tag, kind, len(values)) + at
        link = len(out)
        out += b"\0\0\0\0"
    return bytes(out)


#: A payload becomes rows of this many samples, and pages of at most PAGE_ROWS rows.
UNIT, ROW_WIDTH, PAGE_ROWS = 576, 96, 512


def pad(raw: bytes, unit: int = UNIT) -> bytes:
    """Bytes of 255 up to a positive multiple of unit."""
    return raw + b"\xff" * (unit * max(1, -(-len(raw) // unit)) - len(raw))


def payload_to_tiff(payload: bytes) -> bytes:
    """Losslessly stores bytes as 8-bit grey pages. The scheme of a page follows from the payload and its number."""
    rows = np.frombuffer(payload, np.uint8).reshape(-1, ROW_WIDTH)
    mark = zlib.crc32(payload)
    images = []
    for number, top in enumerate(range(0, len(rows), PAGE_ROWS)):
        choice = mark + number
        compression = (DEFLATE, PACKBITS, LZW)[choice % 3]
        predictor = 2 if compression != PACKBITS and choice // 6 % 2 else 1
        images.append((rows[top : top + PAGE_ROWS], compression, bool(choice // 3 % 2), predictor))
    return write_tiff(images)


def store_as_tiff(docs: DataFrame) -> DataFrame:
    """(doc_id, n_bytes, media): each whole text, padded, as a TIFF file. A null text counts as empty."""

    def batches(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in parts:
            sizes, media = [], []
            for value in part.column(1):
                raw = value.as_py() or b""
                sizes.append(len(raw))
                media.append(payload_to_tiff(pad(raw)))
            yield pa.record_batch([part.column(0), pa.array(sizes, pa.int64()), pa.array(media, pa.binary())], ["doc_id", "n_bytes", "media"])

    chosen = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").cast("binary").alias("text"))
    return chosen.mapInArrow(batches, "doc_id long, n_bytes long, media binary")


PAGE_SCHEMA = (
    "key long, page int, width int, height int, samples int, bits int, compression int, tiled boolean, predictor int, "
    "pixels binary, error string"
)


def tiff_pages(files: DataFrame, key: str = "doc_id", media: str = "media") -> DataFrame:
    """One row per page of each file: its number from 0, its layout and its samples, row by row.

    A null file gives no row. A file that can't be read gives the pages before the fault, then one row with the fault
    in `error` and nothing else; it stops no other file. Pages of a file that are larger together than its bytes could
    hold, as directories that share their strips can be, are such a fault.
    """
    names = [x.split()[0] for x in PAGE_SCHEMA.split(", ")]

    def batches(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        schema = pa.schema(
            [("key", pa.int64()), *[(n, pa.int32()) for n in names[1:7]], ("tiled", pa.bool_()), ("predictor", pa.int32()), ("pixels", pa.binary()), ("error", pa.string())]
        )
        for part in parts:
            for row_key, file in zip(part.column(0).to_pylist(), part.column(1), strict=True):
                data = file.as_py()
                if data is None:
                    continue
                told = lambda *r: pa.RecordBatch.from_pylist([dict(zip(names, r, strict=True))], schema)
                try:
                    for p in pages(data):  # a page at a time: of a file's pages no two are held
                        yield told(row_key, p.number, p.width, p.height, p.samples, p.bits, p.compression, p.tiled, p.predictor, p.pixels.tobytes(), None)
                except ValueError as fault:
                    yield told(row_key, *[None] * 9, str(fault))

    chosen = files.select(F.col(key).cast("long").alias("key"), F.col(media).alias("media"))
    return chosen.mapInArrow(batches, PAGE_SCHEMA).withColumnRenamed("key", key)


def page_features(found: list[Page]) -> str:
    """Integer features of a file's pages: extent, moments, mean step between neighbours and a 16-bin histogram."""
    flat = np.concatenate([p.pixels.reshape(-1) for p in found])
    wide = flat.astype(np.int64)
    steps = sum(int(np.abs(np.diff(p.pixels[:, :, 0].astype(np.int16), axis=1)).sum()) for p in found)
    bins = np.bincount(flat >> 4, minlength=16)
    return (
        f"pages={len(found)};rows={sum(p.height for p in found)};sum={int(wide.sum())};squares={int((wide * wide).sum())};"
        f"steps={steps};bins={','.join(map(str, bins.tolist()))}"
    )


def tiff_digest(stored: DataFrame) -> DataFrame:
    """Reads the pages of stored files back and digests them: one row per row of store_as_tiff."""

    def batches(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in parts:
            out: list[list] = [[] for _ in range(6)]
            for file in part.column(2):
                data = file.as_py()
                found = list(pages(data))
                payload = b"".join(p.pixels.tobytes() for p in found)
                row = (
                    len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-32:]), len(data),
                    hashlib.sha256(data).hexdigest(), page_features(found),
                )
                for column, value in zip(out, row, strict=True):
                    column.append(value)
            kinds = (pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string())
            names = ["doc_id", "n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature"]
            yield pa.record_batch([part.column(0), part.column(1), *[pa.array(c, k) for c, k in zip(out, kinds, strict=True)]], names)

    return stored.mapInArrow(
        batches,
        "doc_id long, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, "
        "media_sha256 string, feature string",
    )


def media_features(docs: DataFrame) -> DataFrame:
    """Store each text of docs as TIFF, read it back, and return its digests and features.

    One row per input row, narrow, without a shuffle; equal texts give equal values. A null text counts as empty and
    becomes one unit of 255s; a null doc_id stays null; repeated rows, extra columns and empty tables need no care.
    """
    return tiff_digest(store_as_tiff(docs))
