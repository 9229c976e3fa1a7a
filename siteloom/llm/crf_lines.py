"""Line labelling by a linear-chain conditional random field.

Every line of a document is content or boilerplate. Lines emit features of their bytes and words; a chain over the lines of a document adds weights for
neighbouring labels. Viterbi decoding, all documents of a slice side by side, finds the best labels; the share of a document's characters that lies in content
lines decides whether it is retained. Fitted by gradient ascent on the conditional likelihood (forward-backward) over labelled documents, whose
lines take their document's quality as label, and over as many spliced ones: runs of lines of good and of bad documents in turn, so that chains change label and
the weights of neighbouring labels are learnt from both.

Scale: the labelled sample is bounded by ``PER_CLASS`` documents; labelling is map-only. A document of any number of lines is decoded whole.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from siteloom.llm.arrays import bytes_of, ragged_index
from siteloom.llm.common import in_one_task, labelled_sample, map_slices, row_of, segment_sums, words
from siteloom.llm.stats import class_counts, distinct

#: Labelled documents of each class at most, lines of a training chain (longer documents give several chains), steps and rate of the ascent.
PER_CLASS, CHAIN, STEPS, RATE, DECAY = 1500, 24, 150, 0.08, 1e-3
#: Lines that a document gives a spliced chain at most, and the orders in which a good (1) and a bad document (0) are spliced.
RUN, ORDERS = 8, ((0, 1), (1, 0), (0, 1, 0), (1, 0, 1))
#: Share of a document's characters in content lines from which it is retained.
SHARE = 0.5
BOILERPLATE, CONTENT = 0, 1
FEATURES = 24


def lines(texts: pa.Array) -> tuple[np.ndarray, pa.Array]:
    """n + 1 offsets of documents, and their lines without blank ones; a null text has none."""
    split = pc.split_pattern(pc.fill_null(texts.cast(pa.large_string()), ""), "\n")
    offsets = split.offsets.to_numpy().astype(np.int64)
    flat = pc.utf8_trim_whitespace(split.values.slice(offsets[0], offsets[-1] - offsets[0]))
    full = pc.binary_length(flat).to_numpy(zero_copy_only=False) > 0 if len(flat) else np.zeros(0, bool)
    return np.concatenate([[0], np.cumsum(full)])[offsets - offsets[0]], flat.filter(pa.array(full))


def features(flat: pa.Array, first: np.ndarray) -> np.ndarray:
    """(lines, FEATURES); ``first`` marks the first line of each document."""
    data, at = bytes_of(flat)
    size = np.maximum(np.diff(at), 1)
    counts = class_counts(data, at)
    share = counts / size[:, None]
    offsets, ids, vocabulary = words(flat, lower=False)
    row, n, count = row_of(offsets), len(flat), np.diff(offsets)
    kinds = distinct(row, ids, n)
    again = np.zeros(len(ids), np.int64)
    again[1:] = (ids[1:] == ids[:-1]) & (row[1:] == row[:-1])
    again = segment_sums(again, offsets) / np.maximum(count, 1)
    raw = pc.count_substring(flat, "|").to_numpy(zero_copy_only=False)
    upper = counts[:, 1] / np.maximum(counts[:, 0] + counts[:, 1], 1)
    last, start = data[at[1:] - 1] if n else np.zeros(0, np.uint8), data[at[:-1]] if n else np.zeros(0, np.uint8)
    line = pc.dictionary_encode(flat).indices.to_numpy(zero_copy_only=False) if n else np.zeros(0, np.int64)
    same = np.zeros(n, bool)
    same[1:] = line[1:] == line[:-1]
    ratio = kinds / np.maximum(count, 1)
    ends = (last == 46) | (last == 33) | (last == 63) | (last == 58)
    out = np.stack([
        np.ones(n), np.log1p(size) / 6, np.minimum(count, 40) / 40, count <= 1, count <= 3, size / np.maximum(count, 1) / 20 > 1,
        share[:, 5], share[:, 5] > 0.04, share[:, 5] > 0.12, share[:, 4], share[:, 4] > 0.15, share[:, 2], share[:, 2] > 0.1,
        upper, (upper > 0.4) & (counts[:, 1] > 2), raw > 0, raw / np.maximum(count, 1), again, again > 0.3,
        (ratio < 0.5) & (count > 6), ends, (start >= 65) & (start <= 90), same & ~first, first,
    ], 1).astype(np.float32)
    return out


@dataclass
class Model:
    emit: np.ndarray  # (FEATURES, 2)
    move: np.ndarray  # (2, 2): from, to
    start: np.ndarray  # (2,)


def padded(values: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(rows, longest, ...) and which cells are filled."""
    sizes = np.diff(offsets)
    mask = np.arange(sizes.max(initial=0)) < sizes[:, None]
    out = np.zeros((*mask.shape, *values.shape[1:]), values.dtype)
    out[mask] = values
    return out, mask


def viterbi(scores: np.ndarray, offsets: np.ndarray, model: Model) -> np.ndarray:
    """The best labels of each line; the lower label of equals. Documents are ordered by length, so that each step touches only those that go on."""
    sizes = np.diff(offsets)
    order = np.argsort(-sizes, kind="stable")
    active = len(sizes) - np.searchsorted(np.sort(sizes), np.arange(sizes.max(initial=0)), side="right")
    at = offsets[:-1][order]
    best, back = np.zeros((len(sizes), 2)), np.zeros((len(scores), 2), np.int8)
    for t, n in enumerate(active):
        own = scores[at[:n] + t]
        if t == 0:
            best[:n] = own + model.start
            continue
        paths = best[:n, :, None] + model.move
        back[at[:n] + t] = paths.argmax(1)
        best[:n] = paths.max(1) + own
    labels = np.zeros(len(scores), np.int8)
    label = best.argmax(1)
    for t in range(len(active) - 1, -1, -1):
        n = active[t]
        labels[at[:n] + t] = label[:n]
        label[:n] = back[at[:n] + t, label[:n]]
    return labels


def train(x: np.ndarray, offsets: np.ndarray, y: np.ndarray) -> Model:
    """Adam on the mean conditional log-likelihood of chains, classes of lines weighted alike through their chains."""
    xs, mask = padded(x, offsets)
    ys, _ = padded(y.astype(np.int64), offsets)
    n, longest = mask.shape
    last = mask.sum(1) - 1
    good = (ys * mask).sum(1) / np.maximum(mask.sum(1), 1) >= 0.5
    weight = np.where(good, 0.5 / max(1, good.sum()), 0.5 / max(1, (~good).sum()))
    model = Model(np.zeros((x.shape[1], 2)), np.zeros((2, 2)), np.zeros(2))
    parameters = [model.emit, model.move, model.start]
    moments = [(np.zeros_like(p), np.zeros_like(p)) for p in parameters]
    truth = np.eye(2)[ys] * mask[..., None]
    true_moves = np.einsum("ntk,ntl,n->kl", truth[:, :-1] * mask[:, 1:, None], truth[:, 1:], weight)
    for step in range(1, STEPS + 1):
        scores = xs @ model.emit
        alpha, beta = np.zeros((n, longest, 2)), np.zeros((n, longest, 2))
        alpha[:, 0] = scores[:, 0] + model.start
        for t in range(1, longest):
            now = np.logaddexp(alpha[:, t - 1, 0, None] + model.move[0], alpha[:, t - 1, 1, None] + model.move[1]) + scores[:, t]
            alpha[:, t] = np.where(mask[:, t, None], now, alpha[:, t - 1])
        for t in range(longest - 2, -1, -1):
            ahead = beta[:, t + 1] + scores[:, t + 1]
            now = np.logaddexp(ahead[:, 0, None] + model.move[:, 0], ahead[:, 1, None] + model.move[:, 1])
            beta[:, t] = np.where(mask[:, t + 1, None], now, beta[:, t + 1])
        whole = np.logaddexp(alpha[np.arange(n), last, 0], alpha[np.arange(n), last, 1])
        belief = np.exp(alpha + beta - whole[:, None, None]) * mask[..., None]
        pair = alpha[:, :-1, :, None] + model.move + (beta + scores)[:, 1:, None, :] - whole[:, None, None, None]
        moves = np.einsum("ntkl,n->kl", np.exp(pair) * mask[:, 1:, None, None], weight)
        wrong = (truth - belief) * weight[:, None, None]
        gradients = [np.einsum("ntf,ntk->fk", xs, wrong) - DECAY * model.emit, true_moves - moves - DECAY * model.move, wrong[:, 0].sum(0) - DECAY * model.start]
        for p, g, (m, v) in zip(parameters, gradients, moments, strict=True):
            m += 0.1 * (g - m)
            v += 0.01 * (g * g - v)
            p += RATE * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.99**step)) + 1e-8)
    return model


def marks(texts: pa.Array, model: Model) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """n + 1 offsets, the label of each line that is not blank, and its characters."""
    offsets, flat = lines(texts)
    if not len(flat):
        return offsets, np.zeros(0, np.int8), np.zeros(0, np.int64)
    return offsets, viterbi(features(flat, first_lines(offsets)) @ model.emit, offsets, model), pc.utf8_length(flat).to_numpy(zero_copy_only=False).astype(np.int64)


def spliced(flat: pa.Array, offsets: np.ndarray, y: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(n + 1 offsets, line numbers, labels) of documents made of runs of lines of one good and one bad document each; every document of the larger class is used once, those of the other in turn.

    A run is taken from where the last run of the same document ended, and from its start again at its end.
    """
    some = np.diff(offsets) > 0
    good, bad = np.flatnonzero(some & (y == 1)), np.flatnonzero(some & (y == 0))
    ends, lines_of, labels = [0], [], []
    for i in range(max(len(good), len(bad))):
        pair, at = {1: good[i % len(good)], 0: bad[i % len(bad)]}, {1: 0, 0: 0}
        for c in ORDERS[i % len(ORDERS)]:
            n = offsets[pair[c] + 1] - offsets[pair[c]]
            size = min(n, 1 + (i * 5 + len(ends) * 3 + c) % RUN)
            start = at[c] if at[c] + size <= n else 0
            lines_of.append(offsets[pair[c]] + start + np.arange(size))
            labels.append(np.full(size, c))
            at[c] = start + size
        ends.append(sum(map(len, lines_of[-len(ORDERS[i % len(ORDERS)]) :])) + ends[-1])
    return np.array(ends), np.concatenate(lines_of), np.concatenate(labels)


def first_lines(offsets: np.ndarray) -> np.ndarray:
    first = np.zeros(offsets[-1], bool)
    first[offsets[:-1][np.diff(offsets) > 0]] = True
    return first


def fit_sample(texts: pa.Array, y: np.ndarray) -> Model | None:
    """None where a class is missing or nothing has a line."""
    offsets, flat = lines(texts)
    row = row_of(offsets)
    if not len(flat) or any(not (y[row] == c).any() for c in (0, 1)):
        return None
    starts = np.flatnonzero((ragged_index(np.zeros(len(texts), np.int64), np.diff(offsets)) % CHAIN) == 0)
    ends, own, labels = spliced(flat, offsets, y)
    x = np.concatenate([features(flat, first_lines(offsets)), features(flat.take(pa.array(own)), first_lines(ends))])
    return train(x, np.concatenate([starts, len(flat) + ends]), np.concatenate([y[row], labels]))


def _fit(rows: pa.Table) -> Model | None:
    rows = rows.sort_by([("y", "ascending"), ("doc_id", "ascending"), ("text", "ascending")])
    return fit_sample(rows["text"].combine_chunks(), rows["y"].to_numpy())


def fit(docs: DataFrame, labels: DataFrame, per_class: int = PER_CLASS) -> Model | None:
    """On labelled documents with a text; repeated texts count once."""
    sample = labelled_sample(docs.select("doc_id", "text"), labels, "quality", per_class).where("text is not null")
    return in_one_task(sample.groupBy("text").agg(F.min("doc_id").alias("doc_id"), F.max("y").cast("long").alias("y")), _fit)


def label(docs: DataFrame, model: Model | None) -> DataFrame:
    """(doc_id, marks, n_lines, n_content, content_share, keep) for every row; marks has a C (content) or B for each line that is not blank.

    A null, empty or blank text has no lines, an empty marks, share 0 and is not kept. Without a model (a class has no labels) all lines are content. Very long
    texts are decoded whole; equal paths take boilerplate. Repeated rows answer alike; an empty table gives no rows; other columns are not read.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model or Model(np.tile([0.0, 1.0], (FEATURES, 1)) * (np.arange(FEATURES) == 0)[:, None], np.zeros((2, 2)), np.zeros(2)))

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        offsets, labels, sizes = marks(batch.column("text"), shared.value)
        content = segment_sums(labels.astype(np.int64), offsets)
        share = segment_sums(sizes * labels, offsets) / np.maximum(segment_sums(sizes, offsets), 1)
        text = np.where(labels == CONTENT, ord("C"), ord("B")).astype(np.uint8)
        joined = pa.Array.from_buffers(pa.large_string(), batch.num_rows, [None, pa.py_buffer(offsets), pa.py_buffer(text)]).cast(pa.string())
        return pa.RecordBatch.from_arrays([batch.column("doc_id"), joined, pa.array(np.diff(offsets).astype(np.int32)), pa.array(content.astype(np.int32)), pa.array(share), pa.array((share >= SHARE) & (np.diff(offsets) > 0))], ["doc_id", "marks", "n_lines", "n_content", "content_share", "keep"])

    return map_slices(docs.withColumn("doc_id", F.col("doc_id").cast("long")), ["doc_id", "text"], run, "doc_id long, marks string, n_lines int, n_content int, content_share double, keep boolean")
