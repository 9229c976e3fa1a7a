"""TIFF as a media column: one row for each page.

Image directories are walked from the header (either byte order, classic and big TIFF). Strips and tiles are decompressed (none, PackBits, LZW, deflate), horizontal and floating-point
predictors undone, tiles cut to the image and planes interleaved, so that a page's samples come out row by row as they would lie uncompressed, in little-endian order.

Scale: map-only, one file at a time in a worker; PackBits, predictors and tiles are numpy over whole segments; LZW walks codes, with a table of references
into what it has written.
"""

from __future__ import annotations

import itertools
import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from siteloom.llm.common import slices

NONE, LZW, ADOBE_DEFLATE, PACKBITS, DEFLATE = 1, 5, 8, 32773, 32946
_SIZES = {1: 1, 2: 1, 3: 2, 4: 4, 5: 8, 6: 1, 7: 1, 8: 2, 9: 4, 10: 8, 11: 4, 12: 8, 13: 4, 16: 8, 17: 8, 18: 8}
_LETTERS = {1: "B", 3: "H", 4: "I", 6: "b", 8: "h", 9: "i", 13: "I", 16: "Q", 17: "q", 18: "Q"}
#: Bytes of a decoded page at most, by its own header: beyond it a file is taken as damaged, so that a few forged bytes cannot exhaust a worker.
MOST = 1 << 30
SCHEMA = "doc_id long, page int, width int, height int, bits int, samples int, compression int, predictor int, photometric int, tiled boolean, pixels binary, error string"


def directories(data: bytes) -> Iterator[dict[int, tuple]]:
    """Tag -> values of each image directory, each followed by its subordinate ones (tag 330); a directory that was walked before ends its chain."""
    order = {b"II": "<", b"MM": ">"}.get(data[:2])
    if order is None or len(data) < 8:
        raise ValueError("no TIFF header")
    (version,) = struct.unpack_from(order + "H", data, 2)
    if version not in (42, 43):
        raise ValueError("no TIFF version")
    big = version == 43
    count_at, entry, word = ("Q", 20, "Q") if big else ("H", 12, "I")
    todo, seen = [struct.unpack_from(order + ("Q" if big else "I"), data, 8 if big else 4)[0]], set()
    while todo:
        place = todo.pop()
        if not place or place in seen:
            continue
        seen.add(place)
        (n,) = struct.unpack_from(order + count_at, data, place)
        place += struct.calcsize(order + count_at)
        if n * entry > len(data):
            raise ValueError("directory beyond the file")
        tags = {"order": order}
        for i in range(n):
            at = place + i * entry
            tag, kind = struct.unpack_from(order + "HH", data, at)
            (count,) = struct.unpack_from(order + word, data, at + 4)
            value = at + 4 + struct.calcsize(order + word)
            if count * _SIZES.get(kind, 1) > struct.calcsize(order + word):
                (value,) = struct.unpack_from(order + word, data, value)
            if kind in _LETTERS:
                tags[tag] = struct.unpack_from(f"{order}{count}{_LETTERS[kind]}", data, value)
        yield tags
        todo += [struct.unpack_from(order + word, data, place + n * entry)[0], *reversed(tags.get(330, ()))]


def packbits(data: bytes, limit: int) -> bytes:
    out, i, size = bytearray(), 0, len(data)
    while i < size and len(out) < limit:
        n = data[i]
        if n < 128:
            out += data[i + 1 : i + 2 + n]
            i += n + 2
        else:
            if n > 128:
                out += data[i + 1 : i + 2] * (257 - n)
            i += 2 if n != 128 else 1
    return bytes(out[:limit])


def lzw(data: bytes, limit: int) -> bytes:
    """Codes of 9 to 12 bits, most significant first; the width grows one code early, as TIFF writers do."""
    first = [bytes([i]) for i in range(256)] + [b"", b""]
    out, table, width, held, bits, before, got = [], first[:], 9, 0, 0, b"", 0
    for byte in data:
        held = (held << 8 | byte) & 0xFFFFFF
        bits += 8
        if bits < width:
            continue
        bits -= width
        code = held >> bits & ((1 << width) - 1)
        if code < 256 or code > 257:
            if not before:
                if code > 257:
                    raise ValueError("LZW code without a string")
                before = table[code]
            else:
                size = len(table)
                if code < size:
                    now = table[code]
                elif code == size:
                    now = before + before[:1]
                else:
                    raise ValueError("LZW code beyond the table")
                table.append(before + now[:1])
                before = now
                width = 9 if size < 510 else 10 if size < 1022 else 11 if size < 2046 else 12
            out.append(before)
            got += len(before)
            if got >= limit:
                break
        elif code == 256:
            table, width, before = first[:], 9, b""
        else:
            break
    return b"".join(out)[:limit]


def inflate(data: bytes, limit: int) -> bytes:
    return zlib.decompressobj().decompress(data, limit)


#: Bits of a sample that each predictor is undone for, and each byte with its bits in the other order (fill order 2).
PREDICTED = {1: (1, 2, 4, 8, 16, 32, 64), 2: (8, 16, 32, 64), 3: (16, 32, 64)}
REVERSED = bytes(int(f"{b:08b}"[::-1], 2) for b in range(256))
DECODERS = {NONE: lambda data, limit: bytes(data[:limit]), LZW: lzw, ADOBE_DEFLATE: inflate, DEFLATE: inflate, PACKBITS: packbits}


def undo(block: np.ndarray, predictor: int, bits: int, samples: int, order: str) -> np.ndarray:
    """``block``: (rows, bytes of a row) as decompressed; what comes back is little-endian."""
    size = max(1, bits // 8)
    rows = len(block)
    if predictor == 1 and size == 1:
        return block
    if predictor == 3:  # bytes of floats by significance, each row a running sum
        block = np.cumsum(block.reshape(rows, -1, samples), axis=1, dtype=np.uint8).reshape(rows, size, -1)
        return np.ascontiguousarray(block.transpose(0, 2, 1)[:, :, ::-1]).reshape(rows, -1)
    if size == 1:
        return np.cumsum(block.reshape(rows, -1, samples), axis=1, dtype=np.uint8).reshape(rows, -1)
    values = block.view(f"{order}u{size}").astype(f"<u{size}")
    if predictor == 2:
        values = np.cumsum(values.reshape(rows, -1, samples), axis=1, dtype=values.dtype).reshape(rows, -1)
    return np.ascontiguousarray(values).view(np.uint8).reshape(rows, -1)


def page(data: bytes, tags: dict[int, tuple]) -> tuple[dict, bytes]:
    """A page's numbers and samples."""
    one = lambda tag, default: tags[tag][0] if tags.get(tag) else default
    width, height, samples, order = one(256, 0), one(257, 0), one(277, 1), tags["order"]
    depths = tags.get(258) or (1,)
    compression, predictor, planar, tiled = one(259, NONE), one(317, 1), one(284, 1), 322 in tags
    about = {"width": width, "height": height, "bits": depths[0], "samples": samples, "compression": compression, "predictor": predictor, "photometric": one(262, 1), "tiled": tiled}
    bits = depths[0]
    if not width or not height or len(set(depths)) > 1 or bits not in (1, 2, 4, 8, 16, 32, 64) or width * height * samples * bits > 8 * MOST:
        raise ValueError(f"page of {width} x {height} x {samples} at {depths} bits")
    if compression not in DECODERS:
        raise ValueError(f"compression {compression}")
    if bits not in PREDICTED.get(predictor, ()):
        raise ValueError(f"predictor {predictor} at {bits} bits")
    fill = one(266, 1)
    if fill not in (1, 2):
        raise ValueError(f"fill order {fill}")
    wide, high = (one(322, 0), one(323, 0)) if tiled else (width, min(one(278, height), height))
    offsets, counts = tags.get(324 if tiled else 273, ()), tags.get(325 if tiled else 279, ())
    planes, inner = (samples, 1) if planar == 2 else (1, samples)
    across, down = -(-width // max(1, wide)), -(-height // max(1, high))
    if not wide or not high or len(offsets) < across * down * planes or len(counts) < len(offsets):
        raise ValueError("missing strips or tiles")
    row_bytes, page_bytes = -(-wide * inner * bits // 8), -(-width * inner * bits // 8)
    if tiled and across > 1 and wide * inner * bits % 8:
        raise ValueError("tiles end within a byte")
    out = np.zeros((planes, height, page_bytes), np.uint8)
    for i, (plane, y, x) in enumerate(itertools.product(range(planes), range(down), range(across))):
        rows = high if tiled else min(high, height - y * high)
        packed = data[offsets[i] : offsets[i] + counts[i]]
        raw = DECODERS[compression](packed.translate(REVERSED) if fill == 2 else packed, rows * row_bytes)
        block = np.zeros(rows * row_bytes, np.uint8)  # what is cut off stays 0
        block[: len(raw)] = np.frombuffer(raw, np.uint8)
        block = undo(block.reshape(rows, row_bytes), predictor, bits, inner, order)
        part = out[plane, y * high : y * high + rows, x * row_bytes : (x + 1) * row_bytes]
        part[:] = block[: part.shape[0], : part.shape[1]]
    if planes > 1:
        if bits % 8:
            raise ValueError("planes of less than a byte")
        out = out.reshape(planes, height, width, bits // 8).transpose(1, 2, 0, 3)
    return about, out.tobytes()


def pages(data: bytes) -> Iterator[tuple[int, dict, bytes | None, str | None]]:
    """(page, numbers, samples, error) of each directory; an error of the header or of a directory's place ends the file."""
    number, walk = 0, directories(data)
    while True:
        try:
            tags = next(walk, None)
        except (ValueError, struct.error) as e:
            yield number, {}, None, str(e)
            return
        if tags is None:
            return
        try:
            about, pixels = page(data, tags)
            yield number, about, pixels, None
        except (ValueError, zlib.error, struct.error) as e:
            yield number, {}, None, str(e)
        number += 1


def decode(files: DataFrame, column: str = "image") -> DataFrame:
    """One row a page (SCHEMA) of files (doc_id, image: binary).

    A damaged page, or a header or directory chain that breaks off, is a row with an error and null numbers; pages before and after it are decoded. So is a page of a form that is not decoded: another
    compression, predictor, depth or fill order, or more than MOST (1 GiB) of samples. Subordinate images are pages behind their own. A null or empty image gives no
    rows. A strip that ends early is filled with zeros. Repeated rows give repeated pages; an empty table none; other columns are not read.
    """
    names = [x.split()[0] for x in SCHEMA.split(", ")]
    kinds = [pa.int64(), *[pa.int32()] * 8, pa.bool_(), pa.binary(), pa.string()]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, "image", 2 << 20):
                rows = []
                for doc_id, data in zip(part.column(0).to_pylist(), part.column(1).to_pylist(), strict=True):
                    for number, about, pixels, error in pages(data) if data else ():
                        rows.append((doc_id, number, *(about.get(x) for x in names[2:10]), pixels, error))
                columns = list(zip(*rows, strict=True)) if rows else [()] * len(names)
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], names)

    return files.select(F.col("doc_id").cast("long").alias("doc_id"), F.col(column).alias("image")).mapInArrow(run, SCHEMA)
