from __future__ import annotations

import base64
import random
import time
from pathlib import Path

import numpy as np
import pyarrow as pa
import pytest
import regex
import tiktoken
from hypothesis import given, settings
from hypothesis import strategies as st

from siteloom.llm import bpe, rans, registry


@pytest.fixture(scope="module")
def reference():
    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, Path(bpe.VOCABULARY).read_bytes().splitlines())}
    return tiktoken.Encoding("own", pat_str=bpe.PATTERN, mergeable_ranks=ranks, special_tokens={})


CUT = regex.compile(bpe.PATTERN)
TEXTS = ["", "a", " ", "\n\n  \n", "Hello world, it's 2024!", "ab" * 700, "x" * 3000, " " * 70, "日本語テキスト 😀😀", "don't   stop\t\tnow", "ſ\x00퟿é", "<|endoftext|>", "abcdefghij" * 60]


def test_bpe_matches_an_independent_encoder(reference):
    ids, offsets = bpe.encode(pa.array(TEXTS), bpe.load(bpe.VOCABULARY), CUT)
    for i, t in enumerate(TEXTS):
        assert ids[offsets[i] : offsets[i + 1]].tolist() == reference.encode_ordinary(t), t[:20]


@settings(max_examples=60, deadline=None)
@given(st.lists(st.text(max_size=60), max_size=8))
def test_bpe_round_trip(texts):
    v = bpe.load(bpe.VOCABULARY)
    ids, offsets = bpe.encode(pa.array(texts, pa.string()), v, CUT)
    data, ends, fine = bpe.decode(ids, offsets, v)
    assert fine.all()
    assert [bytes(data[ends[i] : ends[i + 1]]).decode() for i in range(len(texts))] == texts


def naive(piece: bytes, tokens: dict[bytes, int]) -> list[int]:
    parts = [bytes([b]) for b in piece]
    while True:
        ranks = [(tokens[a + b], i) for i, (a, b) in enumerate(zip(parts, parts[1:], strict=False)) if a + b in tokens]
        if not ranks:
            return [tokens[p] for p in parts]
        _, i = min(ranks)
        parts[i : i + 2] = [parts[i] + parts[i + 1]]


def test_matrices_and_windows_match_naive_merging(monkeypatch):
    """A small vocabulary where merging may lower ranks, against one merge at a time."""
    r = random.Random(5)
    tokens = {bytes([b]): b for b in range(256)}
    while len(tokens) < 330:
        t = bytes(r.choice(b"abc") for _ in range(r.randint(2, 5)))
        tokens.setdefault(t, len(tokens))
    v = bpe.Vocabulary(tokens)
    pieces = list(dict.fromkeys("".join(r.choice("abc") for _ in range(r.randint(1, 60))) for _ in range(300)))
    flat, at = bpe.encode_pieces(pa.array(pieces), v)
    for i, p in enumerate(pieces):
        assert flat[at[i] : at[i + 1]].tolist() == naive(p.encode(), tokens)
        raw = np.frombuffer(p.encode(), np.uint8)
        assert len(p) < 2 or bpe.merge_wide(v.byte_ids[raw], v).tolist() == naive(p.encode(), tokens)
        for window in (4, 9):
            monkeypatch.setattr(bpe, "WINDOW", window)
            assert bpe.merge_long(raw, v).tolist() == naive(p.encode(), tokens)


def test_very_long_pieces_match_an_independent_encoder(reference):
    """Pieces of one megabyte, at a time a byte that is not far from that of short ones."""
    r = random.Random(8)
    own = tiktoken.Encoding("whole", pat_str="(?s).+", mergeable_ranks=reference._mergeable_ranks, special_tokens={})
    v = bpe.load(bpe.VOCABULARY)
    letters = "".join(r.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(1 << 20))
    for text in (letters, "=" * 300_001, "abc" * 50_000, "".join(chr(r.randint(0x4E00, 0x9FFF)) for _ in range(50_000)), "".join(r.choice(["a", "a", "b"]) for _ in range(100_000))):
        began = time.process_time()
        found = bpe.merge_long(np.frombuffer(text.encode(), np.uint8), v)
        assert time.process_time() - began < 20e-6 * len(text.encode()) + 1
        assert found.tolist() == own.encode_ordinary(text)


def test_tokenize_odd_rows(spark, odd_docs, no_docs, reference):
    rows = bpe.tokenize(odd_docs, keep=("lang", "source")).collect()
    assert rows[0].asDict().keys() == {"doc_id", "lang", "source", "tokens", "n_tokens", "exact"}
    texts = {x.doc_id: x.text for x in odd_docs.collect() if x.doc_id is not None}
    assert len(rows) == odd_docs.count() and all(x.exact for x in rows)
    for x in rows:
        if x.doc_id is not None:
            t = texts[x.doc_id]
            assert x.tokens == (None if t is None else reference.encode_ordinary(t)) and x.n_tokens == len(x.tokens or [])
    assert bpe.tokenize(no_docs).count() == 0


def test_detokenize(spark, odd_docs):
    back = bpe.detokenize(bpe.tokenize(odd_docs)).collect()
    assert sorted(str(x.text) for x in back) == sorted(str(x.text) for x in odd_docs.collect())
    rows = spark.createDataFrame([(1, [50, 999999]), (2, [-1]), (3, []), (4, None), (5, [None])], "doc_id long, tokens array<int>")
    assert {x.doc_id: x.text for x in bpe.detokenize(rows).collect()} == {1: None, 2: None, 3: "", 4: None, 5: None}


def test_rans_blocks_round_trip():
    r = np.random.default_rng(1)
    for sizes in ([0], [1], [7, 0, 8, 9], [rans.BLOCK], [rans.BLOCK + 1, 3], [5 * rans.BLOCK + 77, 2050, 0]):
        lengths = np.array(sizes)
        flat = np.minimum(r.zipf(1.3, lengths.sum()), 60000).astype(np.int64)
        table = rans.Table(np.bincount(flat, minlength=2))
        offsets = np.concatenate([[0], np.cumsum(lengths)])
        row, number, block = rans.plan(lengths)
        assert block.sum() == lengths.sum() and block.max() <= rans.BLOCK
        states, pointers, segments, words, n_words = rans.encode(flat, offsets[row] + number * rans.BLOCK, block, table)
        assert (rans.decode(block, states, pointers, segments, words, np.cumsum(n_words) - n_words, table) == flat).all()


def test_rans_segments_decode_alone_and_size_is_near_entropy():
    r = np.random.default_rng(2)
    p = np.array([0.5, 0.25, 0.125, 0.125])
    flat = r.choice(4, rans.BLOCK, p=p).astype(np.int64)
    table = rans.Table(np.bincount(flat))
    size = np.array([len(flat)])
    states, pointers, segments, words, _ = rans.encode(flat, np.array([0]), size, table)
    assert words.nbytes * 8 / len(flat) < 1.75 * 1.03
    step = rans.STEPS * rans.LANES
    for k in range(segments[0]):  # from its checkpoint alone
        part = rans.decode(np.array([step]), states[k : k + 1], pointers[k : k + 1], np.array([1]), words, np.array([0]), table)
        assert (part == flat[k * step : (k + 1) * step]).all()


@pytest.mark.parametrize("n", [1, 2, 3, 1000, 130_000, 200_000, 1 << 18, 300_000])
@pytest.mark.parametrize("skewed", [False, True])
def test_rans_table_sums_exactly_and_large_vocabularies_round_trip(n, skewed):
    r = np.random.default_rng(n)
    counts = r.integers(1, 50, n)
    if skewed:
        counts[n // 2] = 9 * counts.sum()
    table = rans.Table(np.concatenate([[0], counts]))
    assert int(table.freq.sum()) == 1 << table.scale == len(table.symbol) and table.freq[0] == 0 and (table.freq[1:] > 0).all()
    flat = r.integers(1, n + 1, 5000)
    sizes = np.array([3000, 0, 2000])
    states, pointers, segments, words, n_words = rans.encode(flat, np.array([0, 3000, 3000]), sizes, table)
    assert (rans.decode(sizes, states, pointers, segments, words, np.concatenate([[0], np.cumsum(n_words)])[:-1], table) == flat).all()


def test_rans_table():
    assert int(rans.Table(np.array([0, 1, 0, 10**12])).freq.sum()) == 1 << rans.SCALE
    skewed = rans.Table(np.concatenate([np.ones(100000, int), [10**15]]))
    assert int(skewed.freq.sum()) == 1 << skewed.scale and skewed.freq[:-1].min() >= 1
    assert rans.Table(np.zeros(3, np.int64)).freq.sum() == 0
    with pytest.raises(ValueError, match="counted"):
        rans.encode(np.array([2]), np.array([0]), np.array([1]), rans.Table(np.array([1, 1, 0])))


def scalar_rans(ids: list[int], table: rans.Table) -> tuple[list[list[int]], list[int]]:
    """(states at each checkpoint, words in the order of decoding) of one block by the definition: one symbol at a time, in Python's whole numbers, from the last to the first."""
    states, emitted, kept = [1 << 31] * rans.LANES, [], {}
    for i in range(len(ids) - 1, -1, -1):
        lane, f, start = i % rans.LANES, int(table.freq[ids[i]]), int(table.start[ids[i]])
        if states[lane] >= f << (63 - table.scale):
            emitted.append((i, states[lane] & 0xFFFFFFFF))
            states[lane] >>= 32
        states[lane] = (states[lane] // f << table.scale) + states[lane] % f + start
        if i % (rans.LANES * rans.STEPS) == 0:
            kept[i] = list(states)
    return [kept[i] for i in sorted(kept)], [w for _, w in sorted(emitted)]


@pytest.mark.parametrize("n", [1, 7, 8, 9, 2048, 2049, 5000])
def test_rans_matches_a_scalar_coder(n):
    r = np.random.default_rng(n)
    table = rans.Table(np.bincount(r.geometric(0.02, 20000)))
    seen = np.flatnonzero(table.freq)
    flat = r.choice(seen, n)
    states, _, _, words, _ = rans.encode(flat, np.array([0]), np.array([n]), table)
    own, emitted = scalar_rans(flat.tolist(), table)
    assert states.tolist() == own and words.tolist() == emitted


def test_rans_rows(spark, odd_docs, no_docs):
    ids = registry.token_ids(odd_docs)
    table = rans.frequencies(ids)
    blocks = rans.encode_rows(ids, table, verify=True)
    rows = blocks.collect()
    assert all(x.exact for x in rows) and sum(x.n_symbols for x in rows) == sum(len(x.ids or b"") // 4 for x in ids.collect())
    assert {x.doc_id for x in rows if x.n_symbols == 0} == {3} and 2 not in {x.doc_id for x in rows}
    assert max(x.block for x in rows if x.doc_id == 5) > 2
    back = {}
    for x in sorted(rans.decode_rows(blocks, table).collect(), key=lambda x: x.block):
        assert x.exact
        back.setdefault(x.doc_id, []).append(bytes(x.ids))
    expected = {x.doc_id: bytes(x.ids) for x in ids.collect() if x.doc_id is not None and x.ids is not None}
    assert {k: b"".join(v) for k, v in back.items() if k not in (None, 1)} == {k: v for k, v in expected.items() if k != 1}
    none = registry.token_ids(no_docs)
    assert rans.encode_rows(none, rans.frequencies(none)).count() == 0


def test_rans_notices_damage(spark, odd_docs):
    ids = registry.token_ids(odd_docs)
    table = rans.frequencies(ids)
    damaged = rans.encode_rows(ids, table).where("doc_id = 5 and block = 0").selectExpr("doc_id", "block", "n_symbols", "crc32 + 1 crc32", "states", "pointers", "words")
    assert [(x.exact, x.ids) for x in rans.decode_rows(damaged, table).collect()] == [(False, None)]
