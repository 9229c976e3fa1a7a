"""Near duplicates by SimHash and meet-in-the-middle ball hashing.

A fingerprint has ``PARTS`` parts of 28 bits, each bit the sign of a vote of the document's distinct content words,
and of the character n-grams of runs in scripts without spaces, or of very many letters. It is searched in bands: runs of its bits, in their own order and then in fixed random orders.
Two documents collide when one band differs in at most ``RADIUS = 2`` bits: every band is emitted with all its variants
within half of that radius (itself and each single flip), the variants are shuffled, and two bands at distance 2 or less
share one. Collisions are deduplicated and verified by the Hamming distance of whole fingerprints; the groups are the connected
components of verified pairs, and the smallest doc_id of each stays.

Bands are as many as it takes for a pair at any distance that is accepted to collide with a probability of ``RECALL``; up to 20 bits of 196 a collision is certain. Bands are as long as it
takes for documents to collide by chance a few times only, which follows from their number (``search``).

Scale: only (variant, id) pairs of 16 bytes are shuffled, never texts. Identical fingerprints are collapsed before, so
a group of any number of exact copies emits the variants of one. A bucket of up to ``PAIRWISE`` members emits all pairs; a larger one is
searched breadth first over the members' fingerprints, which finds the same components without its pairs.
"""

from __future__ import annotations

import math
import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from siteloom.llm.common import checkpoint, hashes, map_slices, mixed, row_of, words

#: Parts of a fingerprint, bits of a part, radius of a collision within a band, distance of a verified pair over all bits, and the least probability that a pair at that distance collides.
PARTS, BITS, RADIUS, MOST, RECALL = 7, 28, 2, 30, 0.9
#: Bits that a band has beyond those that number the documents, at least; low bits of a key that name the flip.
SPARE, FLIP = 6, 6
#: Letters of a content word at least; a document without one votes with all its words.
LETTERS = 4
#: Scripts without spaces between words, letters in a row that are no word either, and characters of the n-grams that vote in place of both.
UNSPACED, RUN, GRAM = r"[\p{Han}\p{Hiragana}\p{Katakana}\p{Thai}\p{Lao}\p{Khmer}\p{Myanmar}\p{Tibetan}]", 40, 3
_RUN = re.compile(rf"[^\W\d_]{{{RUN}}}")
#: Members of a bucket up to which all pairs are emitted.
PAIRWISE = 24
#: Ids that are broadcast at most, of 8 bytes each.
BROADCAST = 500_000
COLUMNS = [f"b{i}" for i in range(PARTS)]
WHOLE = PARTS * BITS
LANES = -(-WHOLE // 8)


def lanes(vocabulary: pa.Array) -> np.ndarray:
    """Bits of each word as 0/1 bytes, eight to a uint64, so that adding up to 255 words adds all bits at once."""
    h = hashes(vocabulary)
    raw = np.stack([mixed(h, i) for i in range(-(-LANES // 8))], axis=1).view(np.uint8)[:, :LANES]
    return np.unpackbits(raw, axis=1, bitorder="little").view(np.uint64)


def unspaced(vocabulary: pa.Array) -> np.ndarray:
    """Which words are runs of text without spaces."""
    found = pc.match_substring_regex(vocabulary, UNSPACED).to_numpy(zero_copy_only=False).copy()
    for i in np.flatnonzero(pc.greater_equal(pc.utf8_length(vocabulary), RUN).to_numpy(zero_copy_only=False) & ~found):
        found[i] = _RUN.search(vocabulary[i].as_py()) is not None
    return found


def spread(row: np.ndarray, ids: np.ndarray, vocabulary: pa.Array, runs: np.ndarray) -> tuple[np.ndarray, np.ndarray, pa.Array]:
    """Rows, word numbers and vocabulary with the n-grams of the words that are ``runs`` in their place."""
    grams = [list({w[i : i + GRAM] for i in range(max(1, len(w) - GRAM + 1))}) for w in vocabulary.filter(pa.array(runs)).to_pylist()]
    size = np.array([len(x) for x in grams])
    coded = pa.array([x for each in grams for x in each], pa.large_string()).dictionary_encode()
    codes = coded.indices.to_numpy(zero_copy_only=False).astype(np.int64) + len(vocabulary)
    hit = runs[ids]
    word = (np.cumsum(runs) - 1)[ids[hit]]
    n = size[word]
    at = np.arange(n.sum()) + np.repeat((np.cumsum(size) - size)[word] - (np.cumsum(n) - n), n)
    return np.concatenate([row[~hit], np.repeat(row[hit], n)]), np.concatenate([ids[~hit], codes[at]]), pa.concat_arrays([vocabulary.cast(pa.large_string()), coded.dictionary])


def fingerprints(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(n, PARTS) parts, and whether the text has any word; a null, empty or wordless text has no fingerprint."""
    n = len(texts)
    offsets, ids, vocabulary = words(texts)
    if not len(ids):
        return np.zeros((n, PARTS), np.int32), np.zeros(n, bool)
    row = row_of(offsets)
    known, runs = len(vocabulary), unspaced(vocabulary)
    if runs.any():
        row, ids, vocabulary = spread(row, ids, vocabulary, runs)
    content = (pc.utf8_length(vocabulary).to_numpy(zero_copy_only=False) >= LETTERS)[ids] | (ids >= known)
    content |= ~(np.bincount(row[content], minlength=n) > 0)[row]
    key = np.unique(row[content] * len(vocabulary) + ids[content])
    row, ids = key // len(vocabulary), key % len(vocabulary)
    count = np.bincount(row, minlength=n)
    starts = np.concatenate([[0], np.cumsum(count)])
    # runs of at most 255 words, none across documents
    runs = np.flatnonzero((np.arange(len(row)) - starts[row]) % 255 == 0)
    table, votes = lanes(vocabulary), []
    for at in range(0, len(runs), 2000):
        own = runs[at : at + 2001]
        end = own[2000] if len(own) > 2000 else len(ids)
        votes.append(np.add.reduceat(table[ids[own[0] : end]], own[:2000] - own[0], axis=0).view(np.uint8))
    votes = np.concatenate(votes)
    first = np.concatenate([np.flatnonzero(np.diff(row[runs], prepend=-1)), [len(runs)]])
    sums = np.zeros((n, LANES * 8), np.int32)
    present = np.flatnonzero(count)
    sums[present] = np.add.reduceat(votes.astype(np.int32), first[:-1], axis=0)
    bits = (2 * sums[:, :WHOLE] > count[:, None]).reshape(n, PARTS, BITS)
    return (bits @ (1 << np.arange(BITS, dtype=np.int64))).astype(np.int32), count > 0


def fingerprint_table(docs: DataFrame, text: str = "text") -> DataFrame:
    """(doc_id, b0 .. b6) of every document that has an id and a word. Map-only."""

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        parts, has = fingerprints(batch.column(text))
        has &= pc.is_valid(batch.column("doc_id")).to_numpy(zero_copy_only=False)
        return pa.RecordBatch.from_arrays([batch.column("doc_id").filter(pa.array(has)), *(pa.array(parts[has, i]) for i in range(PARTS))], ["doc_id", *COLUMNS])

    return map_slices(docs.withColumn("doc_id", F.col("doc_id").cast("long")), ["doc_id", text], run, "doc_id long, " + ", ".join(f"{c} int" for c in COLUMNS), text)


def search(n: int) -> tuple[int, int]:
    """(bits of a band, number of bands) for so many distinct fingerprints."""
    bits = min(58 - FLIP - 10, max(BITS, n.bit_length() + SPARE))
    meets = sum(math.comb(MOST, k) * math.comb(WHOLE - MOST, bits - k) for k in range(RADIUS + 1)) / math.comb(WHOLE, bits)
    return bits, max(PARTS, math.ceil(math.log(1 - RECALL) / math.log(1 - meets)))


def bands(parts: np.ndarray, bits: int, number: int) -> np.ndarray:
    """(n, number) runs of ``bits`` bits of fingerprints (n, PARTS), none of which share a bit within one order of all bits; the first order is their own."""
    each = WHOLE // bits
    whole = ((parts[:, :, None] >> np.arange(BITS)) & 1).reshape(len(parts), WHOLE).astype(np.int64)
    out, power = np.zeros((len(parts), number), np.int64), 1 << np.arange(bits, dtype=np.int64)
    for k in range(number):
        order = np.random.default_rng(k // each).permutation(WHOLE) if k >= each else np.arange(WHOLE)
        out[:, k] = whole[:, order[k % each * bits : (k % each + 1) * bits]] @ power
    return out


def variants(reps: DataFrame, bits: int = BITS, number: int = PARTS) -> DataFrame:
    """(key, doc_id): key holds the band's number, a variant of it, and in the FLIP low bits which flip made it (0: none)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = bands(np.stack([batch.column(c).to_numpy() for c in COLUMNS], 1), bits, number) if batch.num_rows else np.zeros((0, number), np.int64)
            lists = pa.ListArray.from_arrays(pa.array(np.arange(len(found) + 1, dtype=np.int32) * number), pa.array(found.ravel()))
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), lists], ["doc_id", "bands"])

    cut = reps.select("doc_id", *COLUMNS).mapInArrow(run, "doc_id long, bands array<bigint>")
    flips = f"transform(sequence(0, {bits}), j -> shiftleft(shiftleft(cast(i as bigint), {bits}) + (v ^ if(j > 0, shiftleft(1L, j - 1), 0L)), {FLIP}) + j)"
    return cut.select(F.explode(F.expr(f"flatten(transform(bands, (v, i) -> {flips}))")).alias("key"), "doc_id")


def collisions(rows: DataFrame) -> DataFrame:
    """(a, b, hot): pairs a < b that share a variant; of a bucket above PAIRWISE, (member, null, bucket) instead.

    Rows come sorted by bucket and stream through; only one bucket's members are held at a time. A pair that meets in several buckets of a band is emitted in one only:
    bands that are equal meet as themselves, a part and its flip where the smaller flip number is 0 and not in both.
    """

    def emit(key: np.ndarray, ids: np.ndarray) -> Iterator[pa.RecordBatch]:
        bucket = key >> FLIP
        starts = np.flatnonzero(np.diff(bucket, prepend=bucket[0] - 1))
        sizes = np.diff(np.append(starts, len(bucket)))
        a, b, hot_id, hot = [], [], [], []
        for m in np.unique(sizes[(sizes > 1) & (sizes <= PAIRWISE)]):
            at = starts[sizes == m][:, None] + np.arange(m)
            flips, own = key[at] & ((1 << FLIP) - 1), ids[at]
            for i in range(m - 1):
                # both by a flip of the same bit: equal parts, which meet unflipped as well
                fine = (flips[:, i : i + 1] != flips[:, i + 1 :]) | (flips[:, i : i + 1] == 0)
                x, y = np.broadcast_to(own[:, i : i + 1], fine.shape)[fine], own[:, i + 1 :][fine]
                a.append(np.minimum(x, y))
                b.append(np.maximum(x, y))
        for s, m in zip(starts[sizes > PAIRWISE], sizes[sizes > PAIRWISE], strict=True):
            if (key[s] & ((1 << FLIP) - 1)) and key[s] == key[s + m - 1]:
                continue  # equal parts only: they meet unflipped
            hot_id.append(ids[s : s + m])
            hot.append(bucket[s : s + m])
        if a:
            x, y = np.concatenate(a), np.concatenate(b)
            pairs = pd.DataFrame({"a": x, "b": y}).query("a != b").drop_duplicates()
            yield pa.RecordBatch.from_arrays([pa.array(pairs.a.to_numpy()), pa.array(pairs.b.to_numpy()), pa.nulls(len(pairs), pa.int64())], ["a", "b", "hot"])
        if hot:
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(hot_id)), pa.nulls(sum(map(len, hot)), pa.int64()), pa.array(np.concatenate(hot))], ["a", "b", "hot"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kept: list[tuple[np.ndarray, np.ndarray]] = []
        for batch in batches:
            key, ids = (batch.column(i).to_numpy() for i in range(2))
            if not len(key):
                continue
            cut = int(np.searchsorted(key, key[-1] >> FLIP << FLIP))
            if kept and kept[-1][0][-1] >> FLIP != key[-1] >> FLIP or cut:
                yield from emit(np.concatenate([*(k for k, _ in kept), key[:cut]]), np.concatenate([*(i for _, i in kept), ids[:cut]]))
                kept = []
            kept.append((key[cut:], ids[cut:]))
        if kept:
            yield from emit(np.concatenate([k for k, _ in kept]), np.concatenate([i for _, i in kept]))

    parts = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return rows.repartition(parts, F.expr(f"shiftright(key, {FLIP})")).sortWithinPartitions("key").mapInArrow(run, "a long, b long, hot long")


def distance(left: str, right: str) -> F.Column:
    """Hamming distance of whole fingerprints."""
    return F.expr(" + ".join(f"bit_count({left}.{c} ^ {right}.{c})" for c in COLUMNS))


def reach(pdf: pd.DataFrame) -> pd.DataFrame:
    """Edges of a spanning forest of one bucket's verified pairs, breadth first; bits are compared for the unreached only."""
    pdf = pdf.drop_duplicates("doc_id").sort_values("doc_id")
    ids, bits = pdf.doc_id.to_numpy(), pdf[COLUMNS].to_numpy().astype(np.uint32)
    left, edges = np.arange(len(ids)), []
    while len(left):
        queue, left = [left[0]], left[1:]
        while queue and len(left):
            at = queue.pop()
            near = np.bitwise_count(bits[left] ^ bits[at]).sum(1) <= MOST
            edges += [(min(ids[at], ids[i]), max(ids[at], ids[i])) for i in left[near]]
            queue += left[near].tolist()
            left = left[~near]
    return pd.DataFrame(edges, columns=["a", "b"], dtype=np.int64)


def components(edges: DataFrame) -> DataFrame:
    """(doc_id, root) of all nodes but roots: the smallest id of each connected component, by alternating large and small stars.

    Each round is two aggregations and is checkpointed; edges only shrink. It ends when a round changes nothing, after O(log n) rounds in practice.
    """

    def stars(e: DataFrame, large: bool) -> DataFrame:
        both = e.select(F.col("a").alias("u"), F.col("b").alias("v")).unionByName(e.select(F.col("b").alias("u"), F.col("a").alias("v"))) if large else e.select(F.col("b").alias("u"), F.col("a").alias("v"))
        low = both.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("m"))
        if large:
            linked = both.join(low, "u").where("v > u").select(F.col("m").alias("a"), F.col("v").alias("b"))
        else:
            linked = both.join(low, "u").select(F.col("m").alias("a"), F.col("v").alias("b")).unionByName(low.select(F.col("m").alias("a"), F.col("u").alias("b")))
        return linked.where("a != b").distinct()

    def mark(e: DataFrame) -> tuple:
        return tuple(e.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first())

    edges = checkpoint(edges)
    before = mark(edges)
    while True:
        edges = checkpoint(stars(stars(edges, True), False))
        if (now := mark(edges)) == before:
            return edges.select(F.col("b").alias("doc_id"), F.col("a").alias("root"))
        before = now


def near_duplicates(docs: DataFrame, text: str = "text") -> DataFrame:
    """(doc_id, kept_doc_id): each document that goes, and the one of its group that stays (the smallest id).

    Nulls: a document without id, text or word is in no group. Empty table: no rows. Repeated rows: rows of one doc_id and text are one document; the id is never
    mapped to itself. Ties cannot occur: ids order the group. Texts of any length vote whole. Other columns are not read.
    """
    prints = checkpoint(fingerprint_table(docs, text).dropDuplicates())
    same = checkpoint(prints.groupBy(*COLUMNS).agg(F.min("doc_id").alias("rep")))
    reps = same.select(F.col("rep").alias("doc_id"), *COLUMNS)
    copies = prints.join(same, COLUMNS).where("doc_id != rep").select(F.col("rep").alias("a"), F.col("doc_id").alias("b"))
    found = checkpoint(collisions(variants(reps, *search(same.count()))))
    a, b = reps.alias("l"), reps.alias("r")
    pairs = found.where("hot is null").select("a", "b").distinct()
    verified = pairs.join(a, F.col("a") == F.col("l.doc_id")).join(b, F.col("b") == F.col("r.doc_id")).where(distance("l", "r") <= MOST).select("a", "b")
    hot = found.where("hot is not null").select("hot", F.col("a").alias("doc_id")).distinct().join(reps, "doc_id").groupBy("hot").applyInPandas(reach, "a long, b long").distinct()
    return components(verified.unionByName(hot).unionByName(copies)).withColumnRenamed("root", "kept_doc_id")


def keep_one(docs: DataFrame) -> DataFrame:
    """Pipeline stage: the rows of ``docs`` without those of documents that another of their group stands for; the smallest id of a group stays.

    Rows without id, text or word stay. Of rows that share a doc_id and a text, one stays. Rows that share a doc_id but not a text are documents of their own, ordered behind those whose
    id is theirs alone; such ids are found on the id column, and only their rows are shuffled whole. An empty table stays empty; columns of any name pass through.
    """
    repeated = checkpoint(docs.where("doc_id is not null").groupBy("doc_id").count().where("count > 1").select("doc_id"))
    if repeated.isEmpty():
        return chosen(docs, checkpoint(near_duplicates(docs).select("doc_id").distinct()), "left_anti", "doc_id").select(*docs.columns)
    node = "node"
    while node in {c.lower() for c in docs.columns}:
        node += "_"
    own = F.xxhash64("doc_id", F.coalesce("text", F.lit("\x00"))).bitwiseAND(F.lit(2**61 - 1)) + F.lit(2**62)
    parts = chosen(docs, repeated, "left_anti", "doc_id").withColumn(node, F.col("doc_id").cast("long")), chosen(docs, repeated, "left_semi", "doc_id").withColumn(node, own).dropDuplicates([node])
    found = near_duplicates(parts[0].unionByName(parts[1]).select(F.col(node).alias("doc_id"), "text"))
    gone = checkpoint(found.select(F.col("doc_id").alias(node)).distinct())
    return chosen(parts[0], gone, "left_anti", node).unionByName(chosen(parts[1], gone, "left_anti", node)).select(*docs.columns)


def chosen(docs: DataFrame, ids: DataFrame, how: str, key: str) -> DataFrame:
    """``docs`` with or without the ids, which are broadcast up to BROADCAST of them, so that no text moves; beyond that a shuffle join."""
    return docs.join(F.broadcast(ids) if ids.count() <= BROADCAST else ids, key, how)
