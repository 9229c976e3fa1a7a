"""Token ids as binary: a static range asymmetric numeral system over independent, interleaved blocks.

One frequency table, counted over all rows and scaled to ``2 ** SCALE`` (more for very large vocabularies), is shared by all blocks. A row's ids are cut into blocks of ``BLOCK``; within a block ``LANES``
64-bit states take turns and share one stream of 32-bit words. Every ``STEPS`` steps a checkpoint holds all states and the place in the stream, so each such segment
decodes on its own; a CRC-32 covers each block's ids. All segments of a slice run through numpy together, one step of all lanes at a time.

Scale: the count is a map-side histogram and an aggregation of at most one row an id for each task; encoding is map-only. The table is bounded by the vocabulary.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from siteloom.llm.arrays import binary_array, bytes_of, ragged_index
from siteloom.llm.common import slices

SCALE, LANES, BLOCK, STEPS = 18, 8, 1 << 14, 256
LOW = np.uint64(1 << 31)
WORD = np.uint64(32)
BLOCKS = "doc_id long, block int, n_symbols int, crc32 long, states binary, pointers binary, words binary"


def scaled(counts: np.ndarray, size: int) -> np.ndarray:
    """Frequencies in proportion to counts that sum to ``size`` exactly (0 where nothing is counted), at least 1 for each symbol that was counted.

    What a share exceeds 1 by is scaled to what is left once each symbol has its 1; the largest remainders round up, the lower symbol of equals.
    """
    at = np.flatnonzero(counts > 0)
    freq = np.zeros(len(counts), np.int64)
    if not len(at):
        return freq
    left = size - len(at)
    share = np.maximum(counts[at] * (size / counts[at].sum()) - 1, 0)
    if not share.sum():
        share = np.ones(len(at))
    share *= left / share.sum()
    whole = np.minimum(np.floor(share).astype(np.int64), left)
    up = np.argsort(whole - share, kind="stable")
    rest = left - int(whole.sum())
    if rest >= 0:
        whole += rest // len(at)
        whole[up[: rest % len(at)]] += 1
    else:  # products rounded up to whole numbers
        whole[whole.argmax()] += rest
    freq[at] = 1 + whole
    assert freq.sum() == size and freq[at].min() >= 1
    return freq


class Table:
    """Frequencies that sum to ``2 ** scale``; a symbol that was counted has at least 1, others cannot be encoded. A table of more than an eighth of ``2 ** SCALE`` symbols is scaled to
    eight times their number, so that no vocabulary is too large."""

    def __init__(self, counts: np.ndarray):
        seen = int((counts > 0).sum())
        self.scale = max(SCALE, (8 * seen - 1).bit_length())
        if self.scale > 31:
            raise ValueError(f"{seen} distinct ids leave no room in a state")
        freq = scaled(np.asarray(counts), 1 << self.scale)
        self.freq = freq.astype(np.uint64)
        self.start = (np.cumsum(freq) - freq).astype(np.uint64)
        self.symbol = np.repeat(np.arange(len(freq), dtype=np.int32), freq)


def plan(lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(row, block number, ids) of each block; a row without ids is one empty block."""
    blocks = np.maximum(1, -(-lengths // BLOCK))
    row = np.repeat(np.arange(len(lengths)), blocks)
    number = ragged_index(np.zeros(len(lengths), np.int64), blocks)
    return row, number, np.minimum(BLOCK, lengths[row] - number * BLOCK)


def encode(flat: np.ndarray, starts: np.ndarray, sizes: np.ndarray, table: Table) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Of blocks at ``starts``: states by segment, pointers by segment, segments a block, words, and words a block."""
    if len(flat) and ((flat < 0).any() or flat.max() >= len(table.freq) or not table.freq[flat].all()):
        raise ValueError("an id that the table has not counted")
    steps = -(-sizes // LANES)
    order = np.argsort(-steps, kind="stable")
    segments = np.maximum(1, -(-steps // STEPS))
    first = np.cumsum(segments) - segments
    states = np.full((segments.sum(), LANES), LOW, np.uint64)
    x, lane = np.full((len(sizes), LANES), LOW, np.uint64), np.arange(LANES)
    active = len(sizes) - np.searchsorted(np.sort(steps), np.arange(steps.max(initial=0)), side="right")
    words, owners, step_of = [], [], []
    for t in range(len(active) - 1, -1, -1):
        n = active[t]
        own = order[:n]
        index = t * LANES + lane
        valid = index < sizes[own, None]
        s = flat[np.minimum(starts[own, None] + index, len(flat) - 1)]
        f, c, at = table.freq[s], table.start[s], x[:n]
        need = valid & (at >= f << np.uint64(63 - table.scale))
        words.append((at[need] & np.uint64(0xFFFFFFFF)).astype(np.uint32))
        owners.append(np.repeat(own, need.sum(1)))
        step_of.append(np.full(len(words[-1]), t, np.int32))
        at = np.where(need, at >> WORD, at)
        f = np.where(valid, f, np.uint64(1))
        q = at // f
        x[:n] = np.where(valid, (q << np.uint64(table.scale)) + (at - q * f) + c, at)
        if t % STEPS == 0:
            states[first[own] + t // STEPS] = x[:n]
    owner, step, word = (np.concatenate([*a[::-1], np.zeros(0, d)]) for a, d in ((owners, np.int64), (step_of, np.int32), (words, np.uint32)))
    by_block = np.argsort(owner, kind="stable")
    per_segment = np.bincount(first[owner] + step // STEPS, minlength=segments.sum())
    before = np.cumsum(per_segment) - per_segment
    return states, (before - np.repeat(before[first], segments)).astype(np.uint32), segments, word[by_block], np.bincount(owner, minlength=len(sizes))


def decode(sizes: np.ndarray, states: np.ndarray, pointers: np.ndarray, segments: np.ndarray, words: np.ndarray, word_starts: np.ndarray, table: Table) -> np.ndarray:
    """Ids of blocks, one after another; every segment starts at its checkpoint and all of them decode side by side."""
    block = np.repeat(np.arange(len(sizes)), segments)
    number = ragged_index(np.zeros(len(sizes), np.int64), segments)
    left = np.clip(sizes[block] - number * STEPS * LANES, 0, STEPS * LANES)
    target = (np.cumsum(sizes) - sizes)[block] + number * STEPS * LANES
    steps = -(-left // LANES)
    order = np.argsort(-steps, kind="stable")
    left, target = left[order], target[order]
    x, pointer = states[order], (word_starts[block] + pointers)[order].astype(np.int64)
    active = len(steps) - np.searchsorted(np.sort(steps), np.arange(steps.max(initial=0)), side="right")
    out, lane, mask = np.zeros(sizes.sum(), np.int32), np.arange(LANES), np.uint64((1 << table.scale) - 1)
    words = np.append(words, np.uint32(0)).astype(np.uint64)
    for t, n in enumerate(active):
        index = t * LANES + lane
        valid, at = index < left[:n, None], x[:n]
        slot = at & mask
        s = table.symbol[slot.astype(np.int64)]
        out[(target[:n, None] + index)[valid]] = s[valid]
        at = np.where(valid, table.freq[s] * (at >> np.uint64(table.scale)) + slot - table.start[s], at)
        need = valid & (at < LOW)
        place = np.cumsum(need, axis=1)
        word = words[np.minimum(pointer[:n, None] + place - 1, len(words) - 1)]
        x[:n] = np.where(need, at << WORD | word, at)
        pointer[:n] += place[:, -1]
    return out


def checksums(flat: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    raw, ends = memoryview(np.ascontiguousarray(flat, "<i4")).cast("B"), 4 * np.cumsum(sizes)
    return np.array([zlib.crc32(raw[e - 4 * n : e]) for e, n in zip(ends.tolist(), sizes.tolist(), strict=True)], np.int64)


def frequencies(rows: DataFrame, ids: str = "ids") -> Table:
    """The shared table, counted over all rows (doc_id, ids: little-endian uint32 in a binary column)."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(0, np.int64)
        for batch in batches:
            found = np.bincount(bytes_of(batch.column(0))[0].view("<u4").astype(np.int64))
            total, found = (found, total) if len(found) > len(total) else (total, found)
            total[: len(found)] += found
        at = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(total[at])], ["symbol", "n"])

    counted = rows.select(F.col(ids).alias("ids")).mapInArrow(count, "symbol long, n long").groupBy("symbol").agg(F.sum("n").alias("n")).toPandas()
    counts = np.zeros(int(counted.symbol.max()) + 1 if len(counted) else 1, np.int64)
    counts[counted.symbol] = counted.n
    return Table(counts)


def encode_rows(rows: DataFrame, table: Table, ids: str = "ids", verify: bool = False) -> DataFrame:
    """One row a block: (doc_id, block, n_symbols, crc32, states, pointers, words) and, with ``verify``, exact: whether decoding gives the ids and checksum again.

    ``states`` holds LANES uint64 and ``pointers`` one uint32 for each checkpoint, the first at the block's start; ``words`` the uint32 stream, all little-endian.
    A row with null ids gives no block, one with none an empty block. Repeated rows give repeated blocks; rows of any length are cut into blocks. Other columns are not read.
    """
    shared = rows.sparkSession.sparkContext.broadcast(table)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch.filter(batch.column("ids").is_valid()), "ids", 8 << 20):
                raw, offsets = bytes_of(part.column("ids"))
                flat, offsets = raw.view("<u4").astype(np.int64), offsets // 4
                row, number, sizes = plan(np.diff(offsets))
                states, pointers, segments, words, n_words = encode(flat, offsets[row] + number * BLOCK, sizes, shared.value)
                crc = checksums(flat, sizes)
                ends, word_ends = (np.concatenate([[0], np.cumsum(a)]) for a in (segments, n_words))
                columns = [part.column("doc_id").take(pa.array(row)), pa.array(number.astype(np.int32)), pa.array(sizes.astype(np.int32)), pa.array(crc), binary_array(states.view(np.uint8).ravel(), ends * 8 * LANES), binary_array(pointers.view(np.uint8), ends * 4), binary_array(words.view(np.uint8), word_ends * 4)]
                if verify:
                    back = decode(sizes, states, pointers, segments, words, word_ends[:-1], shared.value)
                    wrong = np.concatenate([[0], np.cumsum(back != flat)])
                    columns.append(pa.array((np.diff(wrong[np.concatenate([[0], np.cumsum(sizes)])]) == 0) & (checksums(back, sizes) == crc)))
                yield pa.RecordBatch.from_arrays(columns, [c.split()[0] for c in (BLOCKS + ", exact boolean" * verify).split(", ")])

    return rows.select(F.col("doc_id").cast("long").alias("doc_id"), F.col(ids).alias("ids")).mapInArrow(run, BLOCKS + ", exact boolean" * verify)


def decode_rows(blocks: DataFrame, table: Table) -> DataFrame:
    """(doc_id, block, ids, exact): ids as little-endian uint32; exact is false, and ids null, where the checksum does not hold.

    A block with a null in any column that decoding reads is left out; an empty block gives empty ids. Repeated blocks give repeated rows, an empty table none; other columns are not read.
    """
    shared = blocks.sparkSession.sparkContext.broadcast(table)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sizes = batch.column("n_symbols").to_numpy().astype(np.int64)
            (states, ends), (pointers, _), (words, word_ends) = (bytes_of(batch.column(c)) for c in ("states", "pointers", "words"))
            flat = decode(sizes, states.view(np.uint64).reshape(-1, LANES).copy(), pointers.view(np.uint32), np.diff(ends) // (8 * LANES), words.view(np.uint32), word_ends[:-1] // 4, shared.value)
            exact = checksums(flat, sizes) == batch.column("crc32").to_numpy()
            raw = binary_array(flat.astype("<u4").view(np.uint8), np.concatenate([[0], np.cumsum(sizes)]) * 4)
            raw = pa.array([x if ok else None for x, ok in zip(raw.to_pylist(), exact, strict=True)], pa.binary())
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("block"), raw, pa.array(exact)], ["doc_id", "block", "ids", "exact"])

    names = [c.split()[0] for c in BLOCKS.split(", ")]
    return blocks.select(*names).dropna(subset=names[2:]).mapInArrow(run, "doc_id long, block int, ids binary, exact boolean")
