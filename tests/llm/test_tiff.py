from __future__ import annotations

import struct
import zlib

import numpy as np
import pytest

from siteloom.llm import tiff, tiff_write


def texts(r):
    return ["a", "ab" * 9000, "\x00" * 300, "z" * 16384, "z" * 16385, "".join(chr(r.randrange(1, 0x500)) for _ in range(30000)), "Mixed lines\nof text. " * 40]


@pytest.mark.parametrize("mode", tiff_write.MODES)
def test_round_trip(mode, r):
    for t in texts(r):
        data, got, numbers = t.encode(), b"", []
        for number, about, pixels, error in tiff.pages(tiff_write.write(data, mode)):
            assert error is None and about["compression"] == mode[1] and len(pixels) == about["width"] * about["height"] * about["samples"] * about["bits"] // 8
            assert (about["samples"], about["bits"], about["predictor"], about["tiled"]) == (mode.samples, mode.bits, mode.predictor, mode.tile > 0)
            numbers.append(number)
            got += pixels
        assert got[: len(data)] == data and not got[len(data) :].strip(b"\x00") and numbers == list(range(len(numbers)))


def build(order: str, tags: dict[int, tuple[int, list[int]]], body: bytes, big: bool = False) -> bytes:
    head = struct.pack(order + "H", 43 if big else 42)
    start = (b"II" if order == "<" else b"MM") + head
    size = 16 if big else 8
    place = size + len(body)
    start += struct.pack(order + "HHQ", 8, 0, place) if big else struct.pack(order + "I", place)
    word, entry = ("Q", 20) if big else ("I", 12)
    extra, out = b"", struct.pack(order + ("Q" if big else "H"), len(tags))
    after = place + struct.calcsize("Q" if big else "H") + entry * len(tags) + struct.calcsize(word)
    for tag, (kind, values) in sorted(tags.items()):
        raw = struct.pack(f"{order}{len(values)}{tiff._LETTERS[kind]}", *values)
        if len(raw) > struct.calcsize(word):
            raw, extra = struct.pack(order + word, after + len(extra)), extra + raw
        out += struct.pack(f"{order}HH{word}", tag, kind, len(values)) + raw.ljust(struct.calcsize(word), b"\x00")
    return start + body + out + struct.pack(order + word, 0) + extra


@pytest.mark.parametrize("order", ["<", ">"])
@pytest.mark.parametrize("big", [False, True])
def test_sixteen_bit_planes_with_predictor(order, big):
    image = (np.arange(5 * 7 * 3, dtype=np.uint32) * 977 % 65536).astype(np.uint16).reshape(5, 7, 3)
    planes = [zlib.compress(np.diff(image[:, :, k], axis=1, prepend=np.zeros((5, 1), np.uint16)).astype(f"{order}u2").tobytes()) for k in range(3)]
    head = 16 if big else 8
    offsets = [head, head + len(planes[0]), head + len(planes[0]) + len(planes[1])]
    tags = {256: (3, [7]), 257: (3, [5]), 258: (3, [16] * 3), 259: (3, [8]), 262: (3, [2]), 273: (4, offsets), 277: (3, [3]), 278: (3, [5]), 279: (4, list(map(len, planes))), 284: (3, [2]), 317: (3, [2])}
    ((_, about, pixels, error),) = tiff.pages(build(order, tags, b"".join(planes), big))
    assert error is None and about["samples"] == 3
    assert (np.frombuffer(pixels, "<u2").reshape(5, 7, 3) == image).all()


def test_floating_point_predictor():
    image = np.random.default_rng(0).normal(size=(4, 6)).astype(np.float32)
    rows = np.ascontiguousarray(image.astype(">f4").view(np.uint8).reshape(4, 6, 4).transpose(0, 2, 1)).reshape(4, -1)
    body = zlib.compress(np.diff(rows, axis=1, prepend=np.zeros((4, 1), np.uint8)).tobytes())
    tags = {256: (3, [6]), 257: (3, [4]), 258: (3, [32]), 259: (3, [8]), 273: (4, [8]), 277: (3, [1]), 278: (3, [4]), 279: (4, [len(body)]), 317: (3, [3])}
    ((_, _, pixels, error),) = tiff.pages(build("<", tags, body))
    assert error is None and (np.frombuffer(pixels, "<f4").reshape(4, 6) == image).all()


def test_bilevel_packbits():
    body = tiff_write.packbits(bytes([0b10101010, 0b11000000] * 3))
    tags = {256: (3, [10]), 257: (3, [3]), 259: (3, [32773]), 273: (4, [8]), 279: (4, [len(body)])}
    ((_, about, pixels, error),) = tiff.pages(build("<", tags, body))
    assert error is None and about["bits"] == 1 and pixels == bytes([0b10101010, 0b11000000] * 3)


def packed_codes(codes: list[tuple[int, int]]) -> bytes:
    bits = "".join(f"{code:0{width}b}" for code, width in codes)
    return int(bits.ljust(-(-len(bits) // 8) * 8, "0"), 2).to_bytes(-(-len(bits) // 8))


def test_lzw_known_vectors():
    """The example of the TIFF 6.0 specification; codes of the string behind the table's end; a cleared table; and the width that grows at 511."""
    assert tiff.lzw(packed_codes([(x, 9) for x in (256, 7, 258, 8, 8, 258, 6, 6, 257)]), 99) == bytes([7, 7, 7, 8, 8, 7, 7, 6, 6])
    assert tiff.lzw(packed_codes([(x, 9) for x in (256, 65, 258, 259, 257)]), 99) == b"A" + b"AA" + b"AAA"
    assert tiff.lzw(packed_codes([(x, 9) for x in (256, 65, 66, 256, 66, 258, 257)]), 99) == b"AB" + b"B" + b"BB"
    singles = [(256, 9)] + [(i % 256, 9) for i in range(254)]  # 253 strings: the table ends at 510 and the next code has 10 bits
    assert tiff.lzw(packed_codes([*singles, (258, 10), (257, 10)]), 999) == bytes(i % 256 for i in range(254)) + bytes([0, 1])
    with pytest.raises(ValueError, match="beyond"):
        tiff.lzw(packed_codes([(x, 9) for x in (256, 65, 300, 257)]), 99)


def test_fill_order_subordinate_images_and_forms_that_are_not_decoded():
    body = bytes([0b10101010, 0b11000000] * 3)
    tags = {256: (3, [10]), 257: (3, [3]), 259: (3, [1]), 273: (4, [8]), 279: (4, [len(body)])}
    ((_, _, pixels, error),) = tiff.pages(build("<", tags | {266: (3, [2])}, body.translate(tiff.REVERSED)))
    assert error is None and pixels == body
    for bad in ({266: (3, [3])}, {317: (3, [2])}, {317: (3, [9])}, {317: (3, [3]), 258: (3, [8])}, {259: (3, [7])}, {258: (3, [12])}):
        ((_, about, pixels, error),) = tiff.pages(build("<", tags | bad, body))
        assert error and pixels is None and about == {}
    grey = {256: (3, [2]), 257: (3, [1]), 258: (3, [8]), 273: (4, [8]), 279: (4, [2])}
    first = build("<", grey | {330: (4, [0, 0])}, b"ab")
    sub = [build("<", grey, x)[10:] for x in (b"cd", b"ef")]  # a directory alone; its strip is set below
    at = len(first)
    data = bytearray(first + sub[0] + sub[1])
    places = [at, at + len(sub[0])]
    spot = first.rindex(struct.pack("<II", 0, 0))
    struct.pack_into("<II", data, spot, *places)
    found = list(tiff.pages(bytes(data)))
    assert [x[0] for x in found] == [0, 1, 2] and all(x[3] is None and x[2] == b"ab" for x in found)


def test_packbits_runs():
    assert tiff.packbits(bytes([254, 7, 128, 1, 8, 9]), 99) == bytes([7, 7, 7, 8, 9])
    assert tiff_write.packbits(bytes([1, 2, 2, 2, 2, 3])) == bytes([0, 1, 253, 2, 0, 3])
    assert tiff_write.packbits(b"z" * 300) == bytes([129, 122, 129, 122, 213, 122])


def test_damage_is_an_error_row_and_not_a_crash(spark, no_docs):
    good = tiff_write.write(b"hello tiff " * 3000, tiff_write.MODES[2])
    cyclic = bytearray(tiff_write.write(b"abc", tiff_write.MODES[0]))
    cyclic[-4:] = struct.pack("<I", struct.unpack_from("<I", cyclic, 4)[0])  # the chain leads back
    huge = build("<", {256: (4, [2**31]), 257: (4, [2**31]), 258: (3, [8]), 273: (4, [8]), 279: (4, [1])}, b"x")
    rows = [(1, good), (1, good), (2, None), (3, b""), (4, b"no image"), (5, bytes(cyclic)), (6, good[:40]), (7, huge), (8, b"II*\x00" + b"\xff" * 4), (None, good), (9, good[:-700])]
    found = tiff.decode(spark.createDataFrame(rows, "doc_id long, image binary")).collect()
    of = lambda i: [x for x in found if x.doc_id == i]
    assert len(of(1)) == 6 and len(of(None)) == 3 and all(x.error is None for x in of(1) + of(None))
    assert not of(2) and not of(3) and [x.error for x in of(5)] == [None]
    for i in (4, 6, 7, 8):
        assert len(of(i)) == 1 and of(i)[0].error and of(i)[0].pixels is None
    assert of(9)[-1].error
    assert tiff.decode(tiff_write.images(no_docs)).count() == 0


def test_query_table(spark, odd_docs):
    found = tiff.decode(tiff_write.images(odd_docs)).collect()
    texts = {x.doc_id: x.text for x in odd_docs.collect() if x.text and x.doc_id not in (None, 1)}
    for i, t in texts.items():
        got = b"".join(bytes(x.pixels) for x in sorted((x for x in found if x.doc_id == i), key=lambda x: x.page))
        assert got[: len(t.encode())] == t.encode()
    assert {x.doc_id for x in found} == texts.keys() | {1}
