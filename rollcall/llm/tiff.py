"""TIFF as a media column: write pages losslessly, walk image directories, decode strips and tiles, one row a page.

Read: classic and BigTIFF of both byte orders; samples of 1, 2, 4, 8, 16 and 32 bits, chunky or in planes, either fill
order; compressions none, LZW, deflate and PackBits; horizontal differencing. Not read (such a page is an error row):
fax and JPEG compressions, floating-point differencing, samples of differing sizes. Written: classic, 8 bits, chunky.
"""

from __future__ import annotations

import hashlib
import struct
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common

# Fixed values of the format.
NONE, LZW, DEFLATE, OLD_DEFLATE, PACKBITS = 1, 5, 8, 32946, 32773
TYPE_SIZE = {1: 1, 2: 1, 3: 2, 4: 4, 5: 8, 6: 1, 7: 1, 8: 2, 9: 4, 10: 8, 11: 4, 12: 8, 13: 4, 16: 8, 17: 8, 18: 8}
WHOLE = {1: "B", 3: "H", 4: "I", 13: "I", 16: "Q", 18: "Q"}  # struct codes of the types that sizes and offsets have
WIDTH, HEIGHT, BITS, COMPRESSION, PHOTOMETRIC = 256, 257, 258, 259, 262
STRIP_OFFSETS, SAMPLES, ROWS_PER_STRIP, STRIP_COUNTS, PLANAR, PREDICTOR = 273, 277, 278, 279, 284, 317
TILE_WIDTH, TILE_HEIGHT, TILE_OFFSETS, TILE_COUNTS = 322, 323, 324, 325
FILL_ORDER = 266


def unpack_bits(data: bytes) -> bytes:
    out, i = bytearray(), 0
    while i < len(data):
        n = data[i]
        if n < 128:
            out += data[i + 1: i + 2 + n]
            i += n + 2
        elif n > 128:
            out += data[i + 1: i + 2] * (257 - n)
            i += 2
        else:
            i += 1
    return bytes(out)


def pack_bits(data: bytes) -> bytes:
    out, i = bytearray(), 0
    while i < len(data):
        run = 1
        while run < 128 and i + run < len(data) and data[i + run] == data[i]:
            run += 1
        if run > 1:
            out += bytes([257 - run, data[i]])
            i += run
            continue
        j = i + 1
        while j < len(data) and j - i < 128 and not (j + 1 < len(data) and data[j] == data[j + 1]):
            j += 1
        out += bytes([j - i - 1]) + data[i:j]
        i = j
    return bytes(out)


def lzw_decode(data: bytes) -> bytes:
    out, table, width, acc, bits, last = [], [], 9, 0, 0, None
    for byte in data:
        acc, bits = ((acc << 8) | byte) & 0xFFFFFF, bits + 8
        if bits < width:
            continue
        bits -= width
        code = (acc >> bits) & ((1 << width) - 1)
        if code == 257:
            break
        if code == 256:
            table, width, last = [bytes([b]) for b in range(256)] + [b"", b""], 9, None
            continue
        if last is None:
            word = table[code]
        else:
            word = table[code] if code < len(table) else last + last[:1]
            table.append(last + word[:1])
            # The width grows one code early in this format.
            width = 9 if len(table) < 511 else 10 if len(table) < 1023 else 11 if len(table) < 2047 else 12
        out.append(word)
        last = word
    return b"".join(out)


def lzw_encode(data: bytes) -> bytes:
    out, acc, bits, width = bytearray(), 0, 0, 9

    def put(code):
        nonlocal acc, bits
        acc, bits = (acc << width) | code, bits + width
        while bits >= 8:
            bits -= 8
            out.append((acc >> bits) & 255)
        acc &= (1 << bits) - 1

    put(256)
    table, size, word = {bytes([b]): b for b in range(256)}, 258, b""
    for b in data:
        longer = word + bytes([b])
        if longer in table:
            word = longer
            continue
        put(table[word])
        table[longer], size = size, size + 1
        width = 9 if size < 512 else 10 if size < 1024 else 11 if size < 2048 else 12
        if size >= 4094:
            put(256)
            table, size, width = {bytes([b]): b for b in range(256)}, 258, 9
        word = bytes([b])
    if word:
        put(table[word])
        size += 1
        width = 9 if size < 512 else 10 if size < 1024 else 11 if size < 2048 else 12
    put(257)
    if bits:
        out.append((acc << (8 - bits)) & 255)
    return bytes(out)


def expand(data: bytes, compression: int) -> bytes:
    if compression == NONE:
        return data
    if compression in (DEFLATE, OLD_DEFLATE):
        return zlib.decompress(data)
    if compression == PACKBITS:
        return unpack_bits(data)
    if compression == LZW:
        return lzw_decode(data)
    raise ValueError(f"compression {compression} isn't supported")


def shrink(data: bytes, compression: int) -> bytes:
    return {NONE: bytes, DEFLATE: lambda d: zlib.compress(d, 1), OLD_DEFLATE: lambda d: zlib.compress(d, 1),
            PACKBITS: pack_bits, LZW: lzw_encode}[compression](data)


def write_tiff(pages: list[tuple[int, int, int, bytes]], compression: int = DEFLATE, predictor: int = 2,
               rows_per_strip: int = 256, tile: tuple[int, int] | None = None, order: str = "<") -> bytes:
    """pages: (width, height, samples a pixel, bytes). tile: (width, height) for tiles in place of strips."""
    out = bytearray((b"II*\0" if order == "<" else b"MM\0*") + b"\0\0\0\0")
    link = 4  # where the offset of the next directory goes
    for w, h, spp, data in pages:
        image = np.frombuffer(data, np.uint8).reshape(h, w, spp)
        tw, th = tile or (w, min(rows_per_strip, h))
        offsets, counts = [], []
        for y in range(0, h, th):
            for x in range(0, w, tw):
                part = image[y: y + th, x: x + tw]
                if tile:
                    part = np.pad(part, ((0, th - part.shape[0]), (0, tw - part.shape[1]), (0, 0)))
                if predictor == 2:
                    part = np.concatenate([part[:, :1], part[:, 1:] - part[:, :-1]], axis=1)
                # PackBits runs may not cross rows.
                packed = (b"".join(pack_bits(row.tobytes()) for row in part) if compression == PACKBITS else shrink(part.tobytes(), compression))
                offsets.append(len(out))
                counts.append(len(packed))
                out += packed + b"\0" * (len(packed) % 2)
        tags = {WIDTH: (4, [w]), HEIGHT: (4, [h]), BITS: (3, [8] * spp), COMPRESSION: (3, [compression]), PHOTOMETRIC: (3, [2 if spp >= 3 else 1]),
                SAMPLES: (3, [spp]), PLANAR: (3, [1]), PREDICTOR: (3, [predictor])}
        tags |= ({TILE_WIDTH: (4, [tw]), TILE_HEIGHT: (4, [th]), TILE_OFFSETS: (4, offsets), TILE_COUNTS: (4, counts)} if tile
                 else {STRIP_OFFSETS: (4, offsets), ROWS_PER_STRIP: (4, [th]), STRIP_COUNTS: (4, counts)})
        entries = b""
        for tag, (kind, values) in sorted(tags.items()):
            raw = struct.pack(f"{order}{len(values)}{'H' if kind == 3 else 'I'}", *values)
            if len(raw) > 4:
                at = len(out)
                out += raw
                raw = struct.pack(order + "I", at)
            entries += struct.pack(order + "HHI", tag, kind, len(values)) + raw.ljust(4, b"\0")
        out[link: link + 4] = struct.pack(order + "I", len(out))
        out += struct.pack(order + "H", len(tags)) + entries
        link = len(out)
        out += b"\0\0\0\0"
    return bytes(out)


def directories(data: bytes):
    """Each image directory in turn: {tag: values}, and its byte order as tag 0. A directory met twice ends the walk."""
    order = {b"II": "<", b"MM": ">"}.get(data[:2])
    magic = struct.unpack(order + "H", data[2:4])[0] if order and len(data) >= 8 else 0
    if magic not in (42, 43):
        raise ValueError("not a TIFF")
    big = magic == 43
    number, offset, entry, first = ("Q", "Q", 20, 8) if big else ("H", "I", 12, 4)
    nn, on = (8, 8) if big else (2, 4)
    at, seen = struct.unpack(order + offset, data[first: first + on])[0], set()
    while at and at not in seen:
        seen.add(at)
        n = struct.unpack(order + number, data[at: at + nn])[0]
        tags: dict = {0: order}
        for i in range(n):
            p = at + nn + entry * i
            tag, kind, count = struct.unpack(order + "HH" + offset, data[p: p + 4 + on])
            size = TYPE_SIZE.get(kind, 1) * count
            q = p + 4 + on
            if size > on:
                q = struct.unpack(order + offset, data[q: q + on])[0]
            if kind in WHOLE:
                if q + size > len(data):
                    raise ValueError("a tag points beyond the file")
                tags[tag] = struct.unpack(f"{order}{count}{WHOLE[kind]}", data[q: q + size])
        yield tags
        at = struct.unpack(order + offset, data[at + nn + entry * n: at + nn + entry * n + on])[0]


_REVERSED = np.packbits(np.unpackbits(np.arange(256, dtype=np.uint8)[:, None], axis=1)[:, ::-1], axis=1).ravel()


def samples_of(raw: bytes, rows: int, width: int, spp: int, bits: int, order: str, predictor: int) -> np.ndarray:
    """rows x width x spp samples of an expanded strip or tile; rows start at whole bytes."""
    line = -(-width * spp * bits // 8)
    got = np.frombuffer(raw, np.uint8)[: rows * line]
    if len(got) < rows * line:
        raise ValueError("a strip or tile is too short")
    if bits < 8:
        each = np.unpackbits(got.reshape(rows, line), axis=1)[:, : width * spp * bits].reshape(rows, width * spp, bits)
        part = (each << np.arange(bits - 1, -1, -1, dtype=np.uint8)).sum(axis=2, dtype=np.uint8)
    else:
        part = got.view(f"{order}u{bits // 8}").astype(f"u{bits // 8}")
    part = part.reshape(rows, width, spp)
    if predictor == 2:
        part = np.cumsum(part, axis=1, dtype=part.dtype)
        part = part & ((1 << bits) - 1) if bits < 8 else part
    return part


def read_page(data: bytes, tags: dict) -> tuple[int, int, int, bytes]:
    """(width, height, samples a pixel, samples) of one directory: a byte a sample up to 8 bits, else little-endian."""
    one = lambda t, d: tags.get(t, (d,))[0]
    w, h, spp, planar, predictor = one(WIDTH, 0), one(HEIGHT, 0), one(SAMPLES, 1), one(PLANAR, 1), one(PREDICTOR, 1)
    sizes = set(tags.get(BITS, (1,)))
    bits = max(sizes)
    if len(sizes) != 1 or bits not in (1, 2, 4, 8, 16, 32):
        raise ValueError(f"samples of {sorted(sizes)} bits aren't supported")
    if planar not in (1, 2) or predictor not in (1, 2):
        raise ValueError(f"planar configuration {planar} with predictor {predictor} isn't supported")
    if w * h * spp > MOST_SAMPLES:
        raise ValueError(f"{w} x {h} x {spp} samples are more than {MOST_SAMPLES}")
    tiled = TILE_OFFSETS in tags
    tw, th = (one(TILE_WIDTH, w), one(TILE_HEIGHT, h)) if tiled else (w, min(one(ROWS_PER_STRIP, h), h) or h)
    spots = list(zip(tags[TILE_OFFSETS if tiled else STRIP_OFFSETS], tags[TILE_COUNTS if tiled else STRIP_COUNTS], strict=True))
    image = np.zeros((h, w, spp), f"<u{max(bits // 8, 1)}")
    across, down = -(-w // tw), -(-h // th)
    planes, held = (spp, 1) if planar == 2 else (1, spp)
    if len(spots) < across * down * planes:
        raise ValueError("strips or tiles are missing")
    for k, (at, n) in enumerate(spots[: across * down * planes]):
        plane, k = divmod(k, across * down)
        y, x = k // across * th, k % across * tw
        rows = th if tiled else min(th, h - y)
        raw = data[at: at + n]
        if one(FILL_ORDER, 1) == 2:
            raw = _REVERSED[np.frombuffer(raw, np.uint8)].tobytes()
        part = samples_of(expand(raw, one(COMPRESSION, NONE)), rows, tw, held, bits, tags.get(0, "<"), predictor)
        image[y: y + rows, x: x + tw, plane: plane + held] = part[: h - y, : w - x]
    return w, h, spp, image.tobytes()


MOST_SAMPLES = 1 << 28  # of a page: larger ones, as a broken header may claim, are errors
PAYLOAD = 192  # bytes of a pixel row: 64 pixels of three samples
PAGE_ROWS = 4096  # rows of a page at most
TAIL = 16  # samples whose checksum tells the end of a file


def text_to_tiff(text: str | None, **options) -> bytes:
    """UTF-8 (null: empty), filled up with spaces to a positive multiple of PAYLOAD, as pages of 64 RGB pixels a row."""
    data = (text or "").encode("utf-8")
    data += b" " * (-len(data) % PAYLOAD if data else PAYLOAD)
    step = PAYLOAD * PAGE_ROWS
    return write_tiff([(64, len(data[i: i + step]) // PAYLOAD, 3, data[i: i + step]) for i in range(0, len(data), step)], **options)


def encode(docs: DataFrame, text: str = "text", media: str = "media") -> DataFrame:
    """docs with its texts stored as TIFF in a binary column in place of the text. Null texts are stored as empty ones;
    repeated rows stay; a column called as the new one is replaced; an empty table stays empty."""
    common.ready(docs.sparkSession, 200)
    docs = docs.drop(media) if media != text else docs
    kept = [f for f in docs.schema if f.name != text]

    def run(batches):
        for batch in batches:
            for part in common.pieces(batch, text):
                made = [text_to_tiff(t) for t in part.column(text).to_pylist()]
                yield pa.RecordBatch.from_arrays([part.column(f.name) for f in kept] + [pa.array(made, pa.binary())], names=[f.name for f in kept] + [media])

    return docs.mapInArrow(run, common.schema_with(kept, (media, "binary")))


_PAGE = [("page", pa.int32(), "int"), ("last", pa.bool_(), "boolean"), ("width", pa.int32(), "int"), ("height", pa.int32(), "int"),
         ("samples_per_pixel", pa.int32(), "int"), ("error", pa.string(), "string"), ("samples", pa.binary(), "binary"),
         ("bytes_so_far", pa.int64(), "long"), ("sha256_so_far", pa.string(), "string"), ("crc32_so_far", pa.int64(), "long"),
         ("feature", pa.string(), "string"), ("media_bytes", pa.int64(), "long"), ("media_sha256", pa.string(), "string")]


BROKEN = (ValueError, KeyError, IndexError, ZeroDivisionError, struct.error, zlib.error, OverflowError)


def read_pages(df: DataFrame, media: str = "media", samples: bool = True) -> DataFrame:
    """One row a page of each file, with its other columns: size, samples, and digests of the samples up to that page.

    The page flagged `last` has the digests of the whole file (crc32_so_far: of the last TAIL bytes of samples). feature: mean
    and deviation of the samples so far, then their shares in eight equal ranges. samples=False leaves that column null.
    A page that can't be read is a row with the reason in `error`, no size and no samples; the pages after it are read.
    A null, empty or broken file, and what follows a broken directory, gives one row with page -1 and the reason.
    Columns of df with these names are replaced; an empty table gives no rows.
    """
    common.ready(df.sparkSession, 200)
    kept = [f for f in df.schema if f.name not in {media, *(n for n, _, _ in _PAGE)}]

    def pages(data):
        sha, crc, total, hist, out = hashlib.sha256(), b"", 0, np.zeros(256, np.int64), []
        whole = (len(data or b""), hashlib.sha256(data or b"").hexdigest())
        bad = lambda page, e: [page, False, None, None, None, str(e)[:200] or type(e).__name__, None, None, None, None, None, *whole]
        try:
            for tags in directories(data or b""):
                try:
                    w, h, spp, got = read_page(data, tags)
                except BROKEN as e:
                    out.append(bad(len(out), e))
                    continue
                sha.update(got)
                crc, total = (crc + got[-TAIL:])[-TAIL:], total + len(got)
                hist += np.bincount(np.frombuffer(got, np.uint8), minlength=256)
                n = max(total, 1)
                mean = (hist * np.arange(256)).sum() / n
                dev = np.sqrt(max((hist * np.arange(256) ** 2).sum() / n - mean * mean, 0))
                feature = f"{mean:.4f},{dev:.4f}," + ",".join(f"{x / n:.4f}" for x in hist.reshape(8, 32).sum(axis=1))
                out.append([len(out), False, w, h, spp, None, got if samples else None, total, sha.copy().hexdigest(), zlib.crc32(crc), feature, *whole])
        except BROKEN as e:
            out.append(bad(-1, e))
        out = out or [bad(-1, "no image directory")]
        out[-1][1] = True
        return out

    def run(batches):
        for batch in batches:
            for part in common.pieces(batch, media, 4 << 20):
                rows, at = [], []
                for i, data in enumerate(part.column(media).to_pylist()):
                    for r in pages(data):
                        rows.append(r)
                        at.append(i)
                cols = [part.column(f.name).take(pa.array(at, pa.int64())) for f in kept]
                cols += [pa.array([r[k] for r in rows], t) for k, (_, t, _) in enumerate(_PAGE)]
                yield pa.RecordBatch.from_arrays(cols, names=[f.name for f in kept] + [n for n, _, _ in _PAGE])

    return df.mapInArrow(run, common.schema_with(kept, *[(n, s) for n, _, s in _PAGE]))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """op5 over documents."""
    docs = common.documents(spark, sf_dir).select("doc_id", F.coalesce(F.octet_length("text"), F.lit(0)).cast("long").alias("n_bytes"), "text")
    return read_pages(encode(docs), samples=False).filter("last").select(
        "doc_id", "n_bytes", F.col("bytes_so_far").alias("payload_bytes"), F.col("sha256_so_far").alias("payload_sha256"),
        F.col("crc32_so_far").alias("tail_crc32"), "media_bytes", "media_sha256", "feature")
