"""TIFF files from texts, as media to decode: the bytes of a text are the samples of its pages, the least significant of a sample first.

The mode, and with it byte order, compression, predictor, strips or tiles, samples and their bits, planes and the size of places, follows from the document's number, so that a table of documents holds all of them.
"""

from __future__ import annotations

import struct
import zlib
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from siteloom.llm import tiff
from siteloom.llm.common import slices

#: Pixels of a row, and bytes of a page.
WIDTH, PAGE = 64, 64 * 256


class Mode(NamedTuple):
    order: str
    compression: int
    predictor: int
    tile: int  # pixels of a tile's side; 0: strips
    strip: int  # rows of a strip
    samples: int = 1
    bits: int = 8
    planes: bool = False
    big: bool = False


MODES = [
    Mode("<", tiff.NONE, 1, 0, 64), Mode(">", tiff.PACKBITS, 1, 0, 32), Mode("<", tiff.LZW, 2, 0, 128), Mode(">", tiff.ADOBE_DEFLATE, 2, 0, 256), Mode("<", tiff.ADOBE_DEFLATE, 1, 32, 0), Mode(">", tiff.LZW, 1, 64, 0),
    Mode("<", tiff.DEFLATE, 2, 16, 0), Mode(">", tiff.PACKBITS, 2, 32, 0), Mode("<", tiff.LZW, 2, 0, 32, samples=3), Mode(">", tiff.DEFLATE, 2, 0, 64, bits=16), Mode("<", tiff.ADOBE_DEFLATE, 3, 0, 32, bits=32),
    Mode(">", tiff.PACKBITS, 1, 0, 64, samples=3, planes=True), Mode("<", tiff.LZW, 1, 0, 128, big=True), Mode(">", tiff.ADOBE_DEFLATE, 2, 32, 0, samples=4, bits=16, big=True), Mode("<", tiff.DEFLATE, 3, 16, 0, samples=2, bits=64),
]


def packbits(data: bytes) -> bytes:
    """Runs of three equal bytes or more as runs, what lies between as literals."""
    raw, out, at = np.frombuffer(data, np.uint8), bytearray(), 0

    def literal(end: int) -> None:
        for i in range(at, end, 128):
            part = data[i : min(end, i + 128)]
            out.append(len(part) - 1)
            out.extend(part)

    starts = np.flatnonzero(np.diff(raw.astype(np.int16), prepend=-1))
    sizes = np.diff(np.append(starts, len(raw)))
    for start, size in zip(starts[sizes > 2].tolist(), sizes[sizes > 2].tolist(), strict=True):
        literal(start)
        at = start + size
        for left in range(size, 0, -128):
            n = min(left, 128)
            out += bytes([257 - n if n > 1 else 0, data[start]])
    literal(len(data))
    return bytes(out)


def lzw(data: bytes) -> bytes:
    out, held, bits = bytearray(), 256, 9
    table, size, width, prefix = {}, 258, 9, -1
    for byte in data:
        if prefix < 0:
            prefix = byte
            continue
        code = table.get(prefix << 8 | byte)
        if code is not None:
            prefix = code
            continue
        held, bits = held << width | prefix, bits + width
        table[prefix << 8 | byte] = size
        size += 1
        prefix = byte
        if size in (512, 1024, 2048):
            width += 1
        elif size == 4095:
            held, bits = held << width | 256, bits + width
            table, size, width = {}, 258, 9
        if bits > 512:
            rest = bits & 7
            out += (held >> rest).to_bytes(bits >> 3)
            held, bits = held & ((1 << rest) - 1), rest
    if prefix >= 0:
        held, bits = held << width | prefix, bits + width
        if size + 1 in (512, 1024, 2048):
            width += 1
    held, bits = held << width | 257, bits + width
    pad = -bits % 8
    return bytes(out) + (held << pad).to_bytes(bits + pad >> 3)


ENCODERS = {tiff.NONE: bytes, tiff.PACKBITS: packbits, tiff.LZW: lzw, tiff.ADOBE_DEFLATE: lambda x: zlib.compress(x, 1), tiff.DEFLATE: lambda x: zlib.compress(x, 1)}


def ahead(block: np.ndarray, mode: Mode, samples: int) -> bytes:
    """A block (rows, pixels, samples, bytes of a sample, least significant first) as it lies in the file, before compression."""
    size = block.shape[3]
    if mode.predictor == 3:
        rows = block.reshape(len(block), -1, size)[:, :, ::-1].transpose(0, 2, 1).reshape(len(block), -1, samples)
        return np.diff(rows, axis=1, prepend=np.zeros((len(rows), 1, samples), np.uint8)).tobytes()
    values = np.ascontiguousarray(block).view(f"<u{size}")[..., 0]
    if mode.predictor == 2:
        values = np.diff(values, axis=1, prepend=np.zeros((len(values), 1, samples), values.dtype))
    return values.astype(f"{mode.order}u{size}").tobytes()


def write(data: bytes, mode: Mode) -> bytes:
    """Pages of WIDTH pixels and PAGE bytes at most, the last one as high as it needs; no bytes make no pages."""
    order, size = mode.order, mode.bits // 8
    row = WIDTH * mode.samples * size
    word, count = ("Q", "Q") if mode.big else ("I", "H")
    out = bytearray(b"II" if order == "<" else b"MM") + (struct.pack(order + "HHHQ", 43, 8, 0, 0) if mode.big else struct.pack(order + "HI", 42, 0))
    link = len(out) - struct.calcsize(word)
    per_page = PAGE // row * row
    for start in range(0, len(data), per_page):
        own = data[start : start + per_page]
        height = -(-len(own) // row)
        image = np.frombuffer(own.ljust(height * row, b"\x00"), np.uint8).reshape(height, WIDTH, mode.samples, size)
        layers = [image[:, :, k : k + 1] for k in range(mode.samples)] if mode.planes else [image]
        blocks = []
        for layer in layers:
            if tile := mode.tile:
                wide = np.zeros((-(-height // tile) * tile, -(-WIDTH // tile) * tile, *layer.shape[2:]), np.uint8)
                wide[:height, :WIDTH] = layer
                blocks += [wide[y : y + tile, x : x + tile] for y in range(0, wide.shape[0], tile) for x in range(0, wide.shape[1], tile)]
            else:
                blocks += [layer[y : y + mode.strip] for y in range(0, height, mode.strip)]
        offsets, counts = [], []
        for block in blocks:
            packed = ENCODERS[mode.compression](ahead(block, mode, block.shape[2]))
            offsets.append(len(out))
            counts.append(len(packed))
            out += packed
        tags = {256: ("I", [WIDTH]), 257: ("I", [height]), 258: ("H", [mode.bits] * mode.samples), 259: ("H", [mode.compression]), 262: ("H", [2 if mode.samples == 3 else 1]), 277: ("H", [mode.samples]), 284: ("H", [2 if mode.planes else 1]), 317: ("H", [mode.predictor])}
        tags |= {322: ("H", [mode.tile]), 323: ("H", [mode.tile]), 324: (word, offsets), 325: ("I", counts)} if mode.tile else {273: (word, offsets), 278: ("I", [mode.strip]), 279: ("I", counts)}
        if mode.predictor == 3:
            tags[339] = ("H", [3] * mode.samples)
        entries, inline = bytearray(), struct.calcsize(order + word)
        for tag, (kind, values) in sorted(tags.items()):
            raw = struct.pack(f"{order}{len(values)}{kind}", *values)
            if len(raw) > inline:
                out += b"\x00" * (len(out) % 2)
                raw, place = struct.pack(order + word, len(out)), raw
                out += place
            entries += struct.pack(order + "HH" + word, tag, {"H": 3, "I": 4, "Q": 16}[kind], len(values)) + raw.ljust(inline, b"\x00")
        out += b"\x00" * (len(out) % 2)
        struct.pack_into(order + word, out, link, len(out))
        out += struct.pack(order + count, len(tags)) + entries
        link = len(out)
        out += bytes(inline)
    return bytes(out)


def images(docs: DataFrame) -> DataFrame:
    """(doc_id, image) of documents; the mode is doc_id modulo the number of modes. A null text or id has a null image, an empty text a file without pages."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch):
                ids, texts = part.column(0).to_pylist(), part.column(1).to_pylist()
                rows = [None if t is None or i is None else write(t.encode(), MODES[i % len(MODES)]) for i, t in zip(ids, texts, strict=True)]
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(rows, pa.binary())], ["doc_id", "image"])

    return docs.selectExpr("cast(doc_id as long) doc_id", "text").mapInArrow(run, "doc_id long, image binary")
