"""Byte-level BPE with a public vocabulary: length-bucketed numpy matrices merge many pieces at once.

Texts are cut into pieces by the vocabulary's pattern; the distinct pieces of a slice fill padded matrices, one for each range of byte lengths. In
each round every row merges its leftmost pair of minimum rank: pair ranks come from an open-addressing hash table of (left id, right id), the
row is compacted by one column, and only the two pairs beside the merge are looked up again. Rows without a mergeable pair leave the matrix. A piece too long for a matrix
is cut into rows of its own, whose borders are then mended exactly (``merge_long``).

Scale: map-only, no shuffle; what a worker holds is bounded by a slice of text. The vocabulary is a file whose path is a parameter; the driver reads it and broadcasts its
bytes, so that executors need no copy. It is never trained.
"""

from __future__ import annotations

import base64
import functools
import itertools
from pathlib import Path

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import regex
import tiktoken
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from siteloom.llm.arrays import binary_array, bytes_of, list_array, ragged_index
from siteloom.llm.common import BEGINS, ENDS, map_slices

VOCABULARY = "/opt/tokenizers/byte_bpe_50k.tiktoken"
#: How that vocabulary cuts texts into pieces (its README names the pattern).
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
#: Widths of the matrices, and bytes of the rows that a piece of more bytes than the last is cut into (``merge_long``).
WIDTHS = (2, 4, 6, 8, 10, 12, 16, 20, 26, 34, 48, 80, 160, 400)
WINDOW = 128
#: Bytes of text merged at once.
SLICE = 3 << 20
NONE = np.int32(2**31 - 1)


class Vocabulary:
    """Token bytes by id, ids of the 256 bytes, and the hashed pair table."""

    def __init__(self, tokens: dict[bytes, int]):
        size = max(tokens.values()) + 1
        self.known = np.zeros(size, bool)
        lengths = np.zeros(size, np.int64)
        for t, i in tokens.items():
            self.known[i], lengths[i] = True, len(t)
        self.offsets = np.concatenate([[0], np.cumsum(lengths)])
        self.data = np.frombuffer(b"".join(t for _, t in sorted((i, t) for t, i in tokens.items())), np.uint8)
        self.byte_ids = np.array([tokens[bytes([b])] for b in range(256)], np.int32)
        pairs = [(tokens[t[:k]] << 32 | tokens[t[k:]], i) for t, i in tokens.items() for k in range(1, len(t)) if t[:k] in tokens and t[k:] in tokens]
        self.bits = max(4, (2 * len(pairs)).bit_length())
        self.keys, self.ranks = np.full(1 << self.bits, -1, np.int64), np.full(1 << self.bits, NONE, np.int32)
        todo = np.array(pairs, np.int64).reshape(-1, 2)
        slot = self._slot(todo[:, 0])
        while len(todo):  # all at once; who finds its slot taken moves on by one
            free = self.keys[slot] == -1
            first = np.unique(np.where(free, slot, -1), return_index=True)
            put = first[1][first[0] >= 0]
            self.keys[slot[put]], self.ranks[slot[put]] = todo[put, 0], todo[put, 1]
            rest = np.ones(len(todo), bool)
            rest[put] = False
            todo, slot = todo[rest], (slot[rest] + 1) & ((1 << self.bits) - 1)

    def _slot(self, key: np.ndarray) -> np.ndarray:
        return ((key.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(64 - self.bits)).astype(np.int64)

    def rank(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """Rank of the token that each pair merges into, NONE where there is none (a negative id never merges)."""
        out = np.full(left.shape, NONE, np.int32)
        at = np.flatnonzero((left >= 0) & (right >= 0))
        key = left.ravel()[at].astype(np.int64) << 32 | right.ravel()[at].astype(np.int64)
        slot, flat = self._slot(key), out.ravel()
        while len(at):
            found = self.keys[slot]
            hit = found == key
            flat[at[hit]] = self.ranks[slot[hit]]
            go = ~hit & (found != -1)
            at, key, slot = at[go], key[go], (slot[go] + 1) & ((1 << self.bits) - 1)
        return flat.reshape(left.shape)


@functools.lru_cache(2)
def of_file(raw: bytes) -> Vocabulary:
    """Of a file of lines ``base64(token) rank``."""
    return Vocabulary({base64.b64decode(a): int(b) for a, b in map(bytes.split, raw.splitlines()) if a})


def load(path: str) -> Vocabulary:
    return of_file(Path(path).read_bytes())


@functools.lru_cache(2)
def counter(raw: bytes, pattern: str = PATTERN) -> tiktoken.Encoding:
    """A native encoder of the same vocabulary and pattern, where only ids or their number are wanted."""
    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, raw.splitlines()) if a}
    return tiktoken.Encoding("own", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})


@functools.lru_cache(2)
def token_bytes(raw: bytes) -> np.ndarray:
    """Bytes of each token id."""
    sizes = {int(b): len(base64.b64decode(a)) for a, b in map(bytes.split, raw.splitlines()) if a}
    out = np.zeros(max(sizes) + 1, np.int64)
    out[list(sizes)] = list(sizes.values())
    return out


def segment_tokens(segments: pa.Array, raw: bytes) -> np.ndarray:
    """Tokens of each of the distinct ``common.segments``. Those that begin by a cut and end before one are encoded as one text, in which no piece crosses their borders; the others one by one."""
    encoder, (data, at) = counter(raw), bytes_of(segments)
    sizes, out = np.diff(at), np.zeros(len(segments), np.int64)
    inner = sizes > 1
    inner[inner] = (data[at[:-1][inner]] == 32) & BEGINS[data[at[:-1][inner] + 1]] & ENDS[data[at[1:][inner] - 1]]
    own = np.flatnonzero(inner)
    if len(own):
        ids = encoder.encode_to_numpy(data[ragged_index(at[own], sizes[own])].tobytes().decode(), disallowed_special=())
        out[own] = np.diff(np.searchsorted(np.cumsum(token_bytes(raw)[ids]), np.cumsum(sizes[own]), side="right"), prepend=0)
    for i in np.flatnonzero(~inner):
        out[i] = len(encoder.encode_to_numpy(segments[int(i)].as_py(), disallowed_special=()))
    return out


def merge_rows(matrix: np.ndarray, v: Vocabulary) -> tuple[np.ndarray, np.ndarray]:
    """(ids padded with -1, count) of each row of byte ids padded with -1."""
    out, live = matrix.copy(), np.arange(len(matrix))
    ids, ranks = matrix, v.rank(matrix[:, :-1], matrix[:, 1:])
    while len(live):
        at = ranks.argmin(1)
        rows = np.arange(len(live))
        best = ranks[rows, at]
        go = best != NONE
        if not go.all():
            done = ~go
            out[live[done]] = -1
            out[live[done], : ids.shape[1]] = ids[done]
            live, ids, ranks, at, best = live[go], ids[go], ranks[go], at[go], best[go]
            rows = rows[: len(live)]
            if not len(live):
                break
        # compaction: the column after the merge goes
        source = np.arange(ids.shape[1] - 1)[None, :]
        ids[rows, at] = best
        ids = np.take_along_axis(ids, source + (source > at[:, None]), 1)
        source = source[:, :-1]
        if not source.shape[1]:
            ranks = np.full((len(live), 1), NONE, np.int32)
            continue
        ranks = np.take_along_axis(ranks, source + (source >= at[:, None]), 1)
        right = np.flatnonzero(at < ranks.shape[1])
        ranks[right, at[right]] = v.rank(ids[right, at[right]], ids[right, at[right] + 1])
        left = np.flatnonzero(at > 0)
        ranks[left, at[left] - 1] = v.rank(ids[left, at[left] - 1], ids[left, at[left]])
    return out, (out >= 0).sum(1)


def matrix_of(data: np.ndarray, offsets: np.ndarray, rows: np.ndarray, width: int, v: Vocabulary) -> np.ndarray:
    """Byte ids of pieces, padded with -1."""
    column = np.arange(max(2, width))
    inside = column < (offsets[rows + 1] - offsets[rows])[:, None]
    return np.where(inside, v.byte_ids[data[np.minimum(offsets[rows, None] + column, len(data) - 1)]], np.int32(-1))


def merge_wide(matrix: np.ndarray, v: Vocabulary) -> np.ndarray:
    """Ids of one wide row: a round takes all pairs of the row's minimum rank, from the left and without overlap, up to the first whose merge makes a pair of lower rank; so the
    merges and their order are those of single steps."""
    ids = matrix.copy()
    ranks = v.rank(ids[:-1], ids[1:])
    while len(ranks) and (best := ranks.min()) != NONE:
        at = np.flatnonzero(ranks == best)
        # runs of adjacent places overlap: every second one of a run counts
        run = np.flatnonzero(np.diff(at, prepend=-2) != 1)
        at = at[(np.arange(len(at)) - np.repeat(run, np.diff(np.append(run, len(at))))) % 2 == 0]
        before = np.where(at > 0, ids[at - 1], -1)
        before[1:][at[1:] - 2 == at[:-1]] = best
        after = np.where(at + 2 < len(ids), ids[np.minimum(at + 2, len(ids) - 1)], -1)
        merged = np.full(len(at), best, np.int32)
        lower = np.flatnonzero((v.rank(before, merged) < best) | (v.rank(merged, after) < best))
        if len(lower):
            at = at[: lower[0] + 1]
        ids[at] = best
        ids = np.delete(ids, at + 1)
        own = at - np.arange(len(at))  # where the merged ids lie now
        ranks = np.delete(ranks, at)
        left, right = own[own > 0], own[own < len(ids) - 1]
        ranks[left - 1] = v.rank(ids[left - 1], ids[left])
        ranks[right] = v.rank(ids[right], ids[right + 1])
    return ids


def merge_many(parts: list[np.ndarray], v: Vocabulary) -> list[np.ndarray]:
    """Ids of byte strings (uint8)."""
    if not parts:
        return []
    flat, starts = encode_bytes(np.concatenate(parts), np.concatenate([[0], np.cumsum([len(x) for x in parts])]).astype(np.int64), v)
    return np.split(flat, starts[1:-1])


def merge_long(data: np.ndarray, v: Vocabulary) -> np.ndarray:
    """Ids of one piece wider than the matrices, exactly, through rows of at most ``WINDOW`` bytes.

    A sequence of tokens is the encoding of its bytes where each two neighbours, encoded together, come out as themselves: the first merge across a border would also be made
    between these two alone. Within a window that holds, so only the borders of windows are checked. Where a border fails, half a window to both sides is encoded together;
    where that fails as well, both windows become one, wider than a matrix row if need be.
    """
    parts = [data[i : i + WINDOW] for i in range(0, len(data), WINDOW)]
    found = merge_many(parts, v)
    sizes = np.diff(v.offsets)

    def text(ids: np.ndarray) -> np.ndarray:
        return v.data[ragged_index(v.offsets[ids], sizes[ids])]

    def whole(pairs: list[tuple[int, int]]) -> np.ndarray:
        """Which pairs of tokens stay apart."""
        distinct, where = np.unique(np.array(pairs, np.int64).reshape(-1, 2), axis=0, return_inverse=True)
        apart = [x.tolist() == p for x, p in zip(merge_many([text(p) for p in distinct], v), distinct.tolist(), strict=True)]
        return np.array(apart, bool)[where.ravel()]

    while len(parts) > 1:
        bad = np.flatnonzero(~whole([(a[-1], b[0]) for a, b in itertools.pairwise(found)]))
        if not len(bad):
            break
        # the half of the bytes next to the border, to the end of a token
        cut = [(len(found[k]) - int(np.searchsorted(np.cumsum(sizes[found[k]][::-1]), len(parts[k]) // 2)), 1 + int(np.searchsorted(np.cumsum(sizes[found[k + 1]]), len(parts[k + 1]) // 2))) for k in bad]
        cut = [(max(1, a), min(b, len(found[k + 1]) - 1)) for k, (a, b) in zip(bad, cut, strict=True)]
        bridges = merge_many([np.concatenate([text(found[k][a:]), text(found[k + 1][:b])]) for k, (a, b) in zip(bad, cut, strict=True)], v)
        fits = [0 < b and a < len(found[k]) for k, (a, b) in zip(bad, cut, strict=True)]
        at = [i for i, f in enumerate(fits) if f]
        good = np.zeros(len(bad), bool)
        if at:
            good[at] = whole([(found[bad[i]][cut[i][0] - 1], bridges[i][0]) for i in at]) & whole([(bridges[i][-1], found[bad[i] + 1][cut[i][1]]) for i in at])
        joined: dict[int, tuple] = {int(k): (c, x) for k, c, x, g in zip(bad, cut, bridges, good, strict=True) if g}
        failed = set(bad[~good].tolist())
        parts, found = _stitched(parts, found, joined, failed)
        fresh = [i for i, x in enumerate(found) if x is None]
        for i, ids in zip(fresh, merge_many([parts[i] for i in fresh], v), strict=True):
            found[i] = ids
    return np.concatenate(found)


def _stitched(parts: list, found: list, joined: dict[int, tuple], failed: set[int]) -> tuple[list, list]:
    """Windows with bridged borders as one part, and with failed borders as one part that is to be encoded again (None)."""
    out_parts, out_found, k = [], [], 0
    while k < len(parts):
        last = k
        while last in joined or last in failed:
            last += 1
        own = range(k, last + 1)
        if any(i in failed for i in own):
            ids = None
        else:
            pieces = []
            for i in own:
                begin = joined[i - 1][0][1] if i - 1 in joined and i > k else 0
                end = joined[i][0][0] if i in joined else len(found[i])
                pieces.append(found[i][begin:end])
                if i in joined:
                    pieces.append(joined[i][1])
            ids = np.concatenate(pieces)
        out_parts.append(np.concatenate([parts[i] for i in own]) if len(own) > 1 else parts[k])
        out_found.append(ids)
        k = last + 1
    return out_parts, out_found


def encode_pieces(pieces: pa.Array, v: Vocabulary) -> tuple[np.ndarray, np.ndarray]:
    """(flat ids, n + 1 offsets) of distinct pieces."""
    data, offsets = bytes_of(pieces)
    lengths = np.diff(offsets)
    long = np.flatnonzero(lengths > WIDTHS[-1])
    if not len(long):
        return encode_bytes(data, offsets, v)
    short = np.flatnonzero(lengths <= WIDTHS[-1])
    flat, starts = encode_bytes(data[ragged_index(offsets[short], lengths[short])], np.concatenate([[0], np.cumsum(lengths[short])]), v)
    merged = [merge_long(data[offsets[i] : offsets[i + 1]], v) for i in long]
    counts = np.zeros(len(lengths), np.int64)
    counts[short], counts[long] = np.diff(starts), [len(x) for x in merged]
    ends = np.concatenate([[0], np.cumsum(counts)])
    out = np.zeros(ends[-1], np.int32)
    out[ragged_index(ends[short], counts[short])] = flat
    out[ragged_index(ends[long], counts[long])] = np.concatenate(merged)
    return out, ends


def encode_bytes(data: np.ndarray, offsets: np.ndarray, v: Vocabulary) -> tuple[np.ndarray, np.ndarray]:
    """(flat ids, n + 1 offsets) of byte strings: those up to the widest matrix in matrices, a wider one as a row of its own."""
    lengths = np.diff(offsets)
    counts, found = np.zeros(len(lengths), np.int64), []
    for low, width in itertools.pairwise((0, *WIDTHS)):
        for rows in np.array_split(own := np.flatnonzero((lengths > low) & (lengths <= width)), max(1, len(own) * width >> 20)):
            if len(rows):
                ids, counts[rows] = merge_rows(matrix_of(data, offsets, rows, width, v), v)
                found.append((rows, ids[ids >= 0]))
    for row in np.flatnonzero(lengths > WIDTHS[-1]):
        ids = merge_wide(v.byte_ids[data[offsets[row] : offsets[row + 1]]], v)
        counts[row] = len(ids)
        found.append((np.array([row]), ids))
    starts = np.concatenate([[0], np.cumsum(counts)])
    flat = np.zeros(starts[-1], np.int32)
    for rows, ids in found:
        flat[ragged_index(starts[rows], counts[rows])] = ids
    return flat, starts


def encode(texts: pa.Array, v: Vocabulary, cut: regex.Pattern) -> tuple[np.ndarray, np.ndarray]:
    """(flat ids, n + 1 offsets) of texts; a null text has none."""
    pieces = [cut.findall(t) if t else [] for t in texts.to_pylist()]
    per_row = np.fromiter(map(len, pieces), np.int64, len(pieces))
    coded = pa.array(list(itertools.chain.from_iterable(pieces)), pa.string()).dictionary_encode()
    flat, starts = encode_pieces(coded.dictionary, v)
    piece = coded.indices.to_numpy(zero_copy_only=False).astype(np.int64)
    counts = np.diff(starts)[piece]
    ends = np.concatenate([[0], np.cumsum(counts)])
    return flat[ragged_index(starts[piece], counts)], ends[np.concatenate([[0], np.cumsum(per_row)])]


def decode(ids: np.ndarray, offsets: np.ndarray, v: Vocabulary) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(bytes, n + 1 offsets, whether all ids are known) of rows of ids; an unknown id gives no bytes."""
    fine = (ids >= 0) & (ids < len(v.known))
    fine[fine] = v.known[ids[fine]]
    safe = np.where(fine, ids, 0)
    counts = np.where(fine, np.diff(v.offsets)[safe], 0)
    ends = np.concatenate([[0], np.cumsum(counts)])
    bad = np.concatenate([[0], np.cumsum(~fine)])
    return v.data[ragged_index(v.offsets[safe], counts)], ends[offsets], np.diff(bad[offsets]) == 0


def tokenize(docs: DataFrame, path: str = VOCABULARY, pattern: str = PATTERN, text: str = "text", keep: tuple[str, ...] = ()) -> DataFrame:
    """(doc_id, keep..., tokens, n_tokens, exact) for every row of ``docs``; exact says that decoding the tokens gives the text's bytes again.

    A null text has null tokens, n_tokens 0 and exact true; an empty one has no tokens. Repeated rows give repeated rows. A text of any length is encoded whole.
    An empty table gives no rows. Columns not named in ``keep`` are not read, so none can clash.
    """
    names = ["doc_id", *(c for c in keep if c != "doc_id")]
    shared = docs.sparkSession.sparkContext.broadcast(Path(path).read_bytes())

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        v, texts = of_file(shared.value), batch.column(text)
        ids, offsets = encode(texts, v, regex.compile(pattern))
        data, ends, fine = decode(ids, offsets, v)
        raw, at = bytes_of(texts)
        exact = fine & (np.diff(ends) == np.diff(at))
        if len(raw) == len(data):
            wrong = np.concatenate([[0], np.cumsum(raw != data)])
            exact &= np.diff(wrong[at]) == 0
        else:
            exact &= np.array([bytes(data[ends[i] : ends[i + 1]]) == bytes(raw[at[i] : at[i + 1]]) for i in range(len(exact))], bool)
        valid = pc.is_valid(texts).to_numpy(zero_copy_only=False)
        return pa.RecordBatch.from_arrays([*(batch.column(c) for c in names), list_array(ids, offsets, valid), pa.array(np.diff(offsets).astype(np.int32)), pa.array(exact)], [*names, "tokens", "n_tokens", "exact"])

    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in (docs.schema[c] for c in names))
    return map_slices(docs, [*names, *([text] if text not in names else [])], run, f"{schema}, tokens array<int>, n_tokens int, exact boolean", text, SLICE)


def detokenize(rows: DataFrame, path: str = VOCABULARY, tokens: str = "tokens") -> DataFrame:
    """(doc_id, text) of rows (doc_id, tokens). Null tokens and rows with an unknown or null id give a null text; bytes that are no UTF-8 are replaced by U+FFFD."""

    shared = rows.sparkSession.sparkContext.broadcast(Path(path).read_bytes())

    def run(batches):
        v = of_file(shared.value)
        for batch in batches:
            column = batch.column("tokens")
            offsets = column.offsets.to_numpy().astype(np.int64)
            ids = pc.fill_null(column.values.slice(offsets[0], offsets[-1] - offsets[0]), -1).to_numpy(zero_copy_only=False) if len(column) else np.zeros(0, np.int32)
            data, ends, fine = decode(ids, offsets - offsets[0], v)
            fine &= pc.is_valid(column).to_numpy(zero_copy_only=False)
            raw = binary_array(data, ends)
            out = pa.array([x.decode("utf-8", "replace") if ok else None for x, ok in zip(raw.to_pylist(), fine, strict=True)], pa.string())
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), out], ["doc_id", "text"])

    return rows.select("doc_id", F.col(tokens).cast("array<int>").alias("tokens")).mapInArrow(run, f"doc_id {rows.schema['doc_id'].dataType.simpleString()}, text string")
