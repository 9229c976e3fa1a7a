"""Mixing to target weights by iterative proportional fitting.

Tokens (of the byte-level BPE vocabulary that the corpus is encoded with) are counted in cells of source, language and topic. Raking scales the cells in turn to the targets of each margin
until all three hold; a cell never takes more than it has. A cell's tokens after over before raking are the probability at which its documents are sampled, by a hash of the doc_id.

The targets are the corpus' own margins, tempered: a value with a share s of the tokens gets s ** TEMPER, normalised, of ``SHARE`` of all tokens, or all that it holds where that is less. A topic is the nearest of ``TOPICS`` centroids
of hashed content words, found by spherical k-means over all documents; what a language has in common is taken off first, so that topics cut across languages.

Scale: texts are read once, map-only: what each document counts is written beside it, and once more without its text, which is what the fit and the cells read; counts are combined for each task before cells are shuffled. Tokens are told from a slice's distinct segments between spaces. Topics are fitted on the words' hashed
numbers, without texts: each pass sums them by tasks, as many as there are cores (``TASKS`` at most), and only sums of fixed size meet. The summands are multiples of powers of two, so sums are exact and do not depend on how rows are spread. The sweeps run in one task, over cells alone; drawing joins the cells'
probabilities to the documents, by a broadcast up to ``BROADCAST`` cells, which moves no text, and by a shuffle join beyond. Model and vocabulary are broadcasts of fixed size.
"""

from __future__ import annotations

import pickle
from collections import Counter
from collections.abc import Callable, Iterable, Iterator
from dataclasses import dataclass
from pathlib import Path

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import cloudpickle
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from siteloom.llm import bpe
from siteloom.llm.arrays import binary_array, bytes_of
from siteloom.llm.common import bounded, checkpoint, hashes, mixed, row_of, segment_sums, segment_words, segments, slices, tidy, words

SHARE, TOPICS, TOLERANCE = 0.5, 8, 1e-4
#: Sweeps after which raking ends though cells still move: where targets ask for more than cells hold, they approach their bounds ever slower.
SWEEPS = 1000
#: Hashed words, documents that a word must occur in, and rounds of k-means at most.
WORDS, FREQUENT, ROUNDS = 1 << 13, 5, 25
#: The most frequent languages, which have a mean of their own each (the documents of all others count too, and have the mean of all documents), and tasks that sum.
LANGUAGES, TASKS = 256, 256
#: Bits after the point of summed weights, and the length below which what is left of a document beside its language's mean is nothing.
BITS, SHORT = 20, 1e-6
TEMPER = {"source": 0.7, "lang": 0.7, "topic": 0.5}
LETTERS = 4
#: Cells whose probabilities are broadcast at most (some 100 bytes each).
BROADCAST = 200_000
#: Stands for a null in a margin.
NULL = "\x00null"


#: Of each document's content words the hashed number, ascending, and how often it occurs.
ENTRY = np.dtype([("bucket", "<u2"), ("n", "<u4")])


@dataclass
class Topics:
    """Weights of hashed words for each topic, and what a language's words have in common (the last row: any other language)."""

    weights: np.ndarray  # (WORDS, TOPICS)
    languages: list[str]
    common: np.ndarray  # (languages + 1, TOPICS)

    def of(self, texts: pa.Array, languages: pa.Array) -> np.ndarray:
        """Of each text its topic; the lowest of equal ones, 0 for a text without content words."""
        return self.of_counts(*content_counts(*words(texts)), languages)

    def of_counts(self, offsets: np.ndarray, entries: np.ndarray, languages: pa.Array) -> np.ndarray:
        n = segment_sums(entries["n"].astype(np.int64), offsets)
        score = scores(offsets, entries["bucket"], entries["n"].astype(np.float32), np.ascontiguousarray(self.weights.T)) / np.maximum(n, 1)[:, None] - self.common[codes(languages, self.languages)]
        return np.where(n > 0, score.argmax(1), 0)


def scores(offsets: np.ndarray, bucket: np.ndarray, value: np.ndarray, by_topic: np.ndarray) -> np.ndarray:
    """(rows, topics): sums of each row's values by the topics' weights; topic by topic, some three times faster than all at once."""
    at = bucket.astype(np.intp)
    return np.stack([segment_sums(own.take(at) * value, offsets) for own in by_topic], 1)


def codes(languages: pa.Array, names: list[str]) -> np.ndarray:
    place = {x: i for i, x in enumerate(names)}
    return np.array([place.get(x, len(names)) for x in languages.to_pylist()], np.int64)


def buckets(vocabulary: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Hashed number of each word, and which are content words."""
    return (mixed(hashes(vocabulary), 77) % np.uint64(WORDS)).astype(np.int64), pc.utf8_length(vocabulary).to_numpy(zero_copy_only=False) >= LETTERS


def content_counts(offsets: np.ndarray, ids: np.ndarray, vocabulary: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Row offsets and ``ENTRY`` of texts' words."""
    bucket, content = buckets(vocabulary)
    found, n = np.unique((row_of(offsets) * WORDS + bucket[ids])[content[ids]], return_counts=True)
    entries = np.empty(len(found), ENTRY)
    entries["bucket"], entries["n"] = found % WORDS, n
    return np.searchsorted(found, np.arange(len(offsets)) * WORDS), entries


def as_binary(offsets: np.ndarray, entries: np.ndarray) -> pa.Array:
    return binary_array(entries.view(np.uint8), offsets * ENTRY.itemsize)


def of_binary(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    data, offsets = bytes_of(column)
    return offsets // ENTRY.itemsize, np.frombuffer(data, ENTRY)


#: Sums by a number, of what a step makes of parts: the rule by which a fit reaches the documents, here or on a cluster.
Step = Callable[[Iterator[tuple]], Iterator[tuple[int, float, np.ndarray]]]
Sums = Callable[[Step], dict[int, np.ndarray]]


def merged(found: Iterable[tuple[int, float, np.ndarray]]) -> dict[int, tuple[float, np.ndarray]]:
    """Of each number the sum of its arrays, or only that of the least order where they have orders other than 0."""
    out: dict[int, tuple[float, np.ndarray]] = {}
    for k, order, values in found:
        if k not in out:
            out[k] = order, values
        elif order == 0 == out[k][0]:
            out[k] = 0.0, out[k][1] + values
        elif order < out[k][0]:
            out[k] = order, values
    return out


def rounded(values: np.ndarray) -> np.ndarray:
    return np.round(values * 2.0**BITS) / 2.0**BITS


def fit(raw: Sums, prepared: Callable[[Callable[[tuple], tuple]], Sums], names: list[str], seed: int = 7) -> Topics:
    """Spherical k-means of all documents as means of their weighted content words, less the mean of their language.

    ``raw`` sums over parts (offsets, entries, codes of languages), ``prepared`` over what a function makes of them. The result does not depend on how documents are spread over parts or ordered. A document
    without content words has no part in it; repeated rows count as often as there are.
    """
    others = len(names)

    def occur(parts: Iterator[tuple]) -> Iterator[tuple[int, float, np.ndarray]]:
        total = np.zeros(WORDS + 1)
        for offsets, entries, _ in parts:
            total[:WORDS] += np.bincount(entries["bucket"], minlength=WORDS)
            total[WORDS] += (np.diff(offsets) > 0).sum()
        yield 0, 0.0, total

    seen = raw(occur).get(0, np.zeros(WORDS + 1))
    idf = np.where(seen[:WORDS] >= FREQUENT, np.log((1 + seen[WORDS]) / (1 + seen[:WORDS])), 0)

    def weighted(offsets: np.ndarray, entries: np.ndarray) -> np.ndarray:
        n = segment_sums(entries["n"].astype(np.int64), offsets)
        return rounded(entries["n"] * idf[entries["bucket"]] / np.repeat(n, np.diff(offsets)))

    def by_language(parts: Iterator[tuple]) -> Iterator[tuple[int, float, np.ndarray]]:
        total: dict[int, np.ndarray] = {}
        for offsets, entries, code in parts:
            x, of = weighted(offsets, entries), np.repeat(code, np.diff(offsets))
            for c in np.unique(code):
                own = of == c
                total.setdefault(int(c), np.zeros(WORDS + 1))[:WORDS] += np.bincount(entries["bucket"][own], x[own], WORDS)
                total[int(c)][WORDS] += ((np.diff(offsets) > 0) & (code == c)).sum()
        for c, values in total.items():
            yield c, 0.0, values

    sums, means = raw(by_language), np.zeros((others + 1, WORDS))
    for c, values in sums.items():
        if c < others:
            means[c] = values[:WORDS] / max(values[WORDS], 1)
    means[others] = sum((v[:WORDS] for v in sums.values()), np.zeros(WORDS)) / max(seen[WORDS], 1)
    square = np.einsum("ij,ij->i", means, means)

    def prepare(part: tuple) -> tuple:
        """Weights over the length of what is left beside the language's mean, one over that length, and a hash of both for the races."""
        offsets, entries, code = part
        x, bucket, row = weighted(offsets, entries), entries["bucket"].astype(np.int64), row_of(offsets)
        length = np.sqrt(np.maximum(segment_sums(x * x - 2 * x * means[code[row], bucket], offsets) + square[code], 0))
        full = (np.diff(offsets) > 0) & (length > SHORT)
        kept = full[row] & (x > 0)
        ends = np.concatenate([[0], np.cumsum(kept)])[offsets]
        offsets, bucket, value, code = ends[np.concatenate([[True], full])], bucket[kept].astype(np.uint16), rounded(x[kept] / length[row[kept]]).astype(np.float32), code[full].astype(np.int32)
        own = segment_sums(mixed(bucket.astype(np.uint64) << np.uint64(32) | value.view(np.uint32).astype(np.uint64), 5), offsets) + code.astype(np.uint64)
        return offsets, bucket, value, code, rounded(1 / length[full]), own

    over, centres = prepared(prepare), np.zeros((TOPICS, WORDS))

    def near(part: tuple, k: int) -> np.ndarray:
        offsets, bucket, value, code, inverse, _ = part
        return scores(offsets, bucket, value, centres[:k].astype(np.float32)) - inverse[:, None] * (means @ centres[:k].T)[code]

    for k in range(TOPICS):  # each starts from a document that is far from those before: the first to arrive, where each arrives at a rate of its distance

        def race(parts: Iterator[tuple], k: int = k) -> Iterator[tuple[int, float, np.ndarray]]:
            best = None
            for part in parts:
                offsets, bucket, value, code, inverse, own = part
                far = np.clip(1 - near(part, k).max(1), 0, None) ** 2 if k else np.ones(len(code))
                time = -np.log(((mixed(own, seed * TOPICS + k) >> np.uint64(12)).astype(np.float64) + 0.5) / 2.0**52) / np.maximum(far, 1e-300)
                time[far <= 1e-9] = np.inf
                if len(time) and time.min() < (best[0] if best else np.inf):
                    i = int(time.argmin())
                    best = time[i], np.bincount(bucket[offsets[i] : offsets[i + 1]], value[offsets[i] : offsets[i + 1]], WORDS) - inverse[i] * means[code[i]]
            if best:
                yield 0, float(best[0]), best[1]

        found = over(race)
        if not found:
            break
        centres[k] = found[0]

    def sweep(parts: Iterator[tuple]) -> Iterator[tuple[int, float, np.ndarray]]:
        total, taken = np.zeros(TOPICS * WORDS), np.zeros((TOPICS, others + 1))
        for part in parts:
            offsets, bucket, value, code, inverse, _ = part
            topic = near(part, TOPICS).argmax(1)
            total += np.bincount(np.repeat(topic, np.diff(offsets)) * WORDS + bucket, value, TOPICS * WORDS)
            np.add.at(taken, (topic, code), inverse)
        for k in np.flatnonzero(taken.sum(1)):
            yield int(k), 0.0, np.concatenate([total[k * WORDS : (k + 1) * WORDS], taken[k]])

    for _ in range(ROUNDS):
        before = centres.copy()
        for k, values in over(sweep).items():
            centre = values[:WORDS] - values[WORDS:] @ means
            centres[k] = centre / max(np.linalg.norm(centre), 1e-12)
        if (centres == before).all():
            break
    return Topics((idf[:, None] * centres.T).astype(np.float32), names, (means @ centres.T).astype(np.float32))


def fitted_topics(texts: pa.Array, languages: list[str | None], seed: int = 7) -> Topics:
    """``fit`` of texts held here."""
    names = [x for x, _ in sorted(Counter(v for v in languages if v is not None).items(), key=lambda x: (-x[1], x[0]))[:LANGUAGES]]
    part = *content_counts(*words(texts)), codes(pa.array(languages, pa.string()), names)

    def sums(own: tuple) -> Sums:
        return lambda step: {k: v for k, (_, v) in merged(step(iter([own]))).items()}

    return fit(sums(part), lambda prepare: sums(prepare(part)), names, seed)


def fit_topics(docs: DataFrame, text: str = "text") -> Topics:
    """Topics of all documents; see ``fit``."""
    return fit_counted(checkpoint(counted(docs.select("lang", text), "counts", text=text, keep_text=False)), "counts")


def fit_counted(rows: DataFrame, counts: str) -> Topics:
    """Topics of rows with ``counted`` words."""
    spark = rows.sparkSession
    rows = rows.select(F.col("lang").cast("string").alias("lang"), F.col(counts).alias("counts"))
    names = [x.lang for x in rows.where("lang is not null and counts is not null").groupBy("lang").count().orderBy(F.desc("count"), "lang").limit(LANGUAGES).collect()]
    tasks = min(TASKS, max(1, spark.sparkContext.defaultParallelism))

    def parts(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
        for batch in batches:
            if batch.num_rows:
                yield *of_binary(batch.column("counts")), codes(batch.column("lang"), names)

    def sums(table: DataFrame, read: Callable[[Iterator[pa.RecordBatch]], Iterator[tuple]]) -> Sums:
        def of(step: Step) -> dict[int, np.ndarray]:
            shared = spark.sparkContext.broadcast(cloudpickle.dumps(step))

            def out(found: Iterable[tuple[int, float, np.ndarray]]) -> Iterator[pa.RecordBatch]:
                for k, order, values in found:
                    yield pa.RecordBatch.from_arrays([pa.array([k], pa.int32()), pa.array([order], pa.float64()), pa.array([values.astype("<f8").tobytes()], pa.binary())], ["k", "order", "sums"])

            def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
                yield from out(pickle.loads(shared.value)(read(batches)))
                tidy()

            def meet(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
                rows = ((k, order, np.frombuffer(values, "<f8")) for b in batches for k, order, values in zip(*(b.column(i).to_pylist() for i in range(3)), strict=True))
                yield from out((k, *v) for k, v in merged(rows).items())

            kind = "k int, order double, sums binary"
            found = table.mapInArrow(run, kind).repartition(min(tasks, TOPICS), "k").mapInArrow(meet, kind).collect()
            shared.destroy()
            return {x.k: np.frombuffer(bytes(x.sums), "<f8") for x in found}

        return of

    def prepared(prepare: Callable[[tuple], tuple]) -> Sums:
        shared = spark.sparkContext.broadcast(cloudpickle.dumps(prepare))

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            own = pickle.loads(shared.value)
            for part in parts(batches):
                yield pa.RecordBatch.from_arrays([pa.array([pickle.dumps(own(part))], pa.binary())], ["part"])
            tidy()

        packed = checkpoint(rows.coalesce(tasks).mapInArrow(run, "part binary"))
        return sums(packed, lambda batches: (pickle.loads(x) for b in batches for x in b.column("part").to_pylist()))

    return fit(sums(rows.coalesce(tasks), parts), prepared, names)


def mapped(docs: DataFrame, out: T.StructType, slice_by: str | None, added: Callable[[pa.RecordBatch], list[pa.Array]]) -> DataFrame:
    """``docs`` with the columns of ``out``: their own by name, then ``added`` ones. Map-only."""
    bounded(docs.sparkSession)
    own = [f.name for f in out if f.name in docs.columns]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, slice_by) if slice_by else [batch]:
                yield pa.RecordBatch.from_arrays([*(part.column(x) for x in own), *added(part)], out.names)
            tidy()

    return docs.mapInArrow(run, out)


def counted(docs: DataFrame, counts: str, tokens: str | None = None, text: str = "text", keep_text: bool = True) -> DataFrame:
    """``docs`` with ``counts``, the ``ENTRY`` of their content words, and their ``tokens``; a null text has none of either."""
    raw = docs.sparkSession.sparkContext.broadcast(Path(bpe.VOCABULARY).read_bytes()) if tokens else None

    def added(part: pa.RecordBatch) -> list[pa.Array]:
        cut = segments(part.column(text))
        found = [as_binary(*content_counts(*segment_words(*cut)))]
        return [*found, pa.array(segment_sums(bpe.segment_tokens(cut[2], raw.value)[cut[1]], cut[0]), pa.int64())] if raw else found

    return mapped(docs, T.StructType([*(f for f in docs.schema.fields if keep_text or f.name != text), T.StructField(counts, T.BinaryType()), *([T.StructField(tokens, T.LongType())] if tokens else [])]), text, added)


def with_topics(rows: DataFrame, model: Topics, counts: str, topic: str) -> DataFrame:
    """``counted`` rows with their ``topic`` in place of ``counts``."""
    shared = rows.sparkSession.sparkContext.broadcast(model)

    def added(part: pa.RecordBatch) -> list[pa.Array]:
        return [pa.array(shared.value.of_counts(*of_binary(part.column(counts)), part.column("lang").cast(pa.string()))).cast(pa.string())]

    return mapped(rows, T.StructType([*(f for f in rows.schema.fields if f.name != counts), T.StructField(topic, T.StringType())]), None, added)


def unit(seed: int, text: str = "text") -> F.Column:
    """A number in [0, 1) of each row's doc_id, or of its text where it has none."""
    return F.xxhash64(F.coalesce(F.col("doc_id").cast("long"), F.xxhash64(text)), F.lit(seed)).bitwiseAND(F.lit(2**53 - 1)) / F.lit(2.0**53)


def counted_rows(docs: DataFrame, seed: int, text: str) -> DataFrame:
    """(doc_id, source, lang, unit, counts, tokens) of every row, without its text."""
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("source").cast("string").alias("source"), F.col("lang").cast("string").alias("lang"), unit(seed, text).alias("unit"), F.col(text).cast("string").alias("text"))
    return counted(rows, "counts", "tokens", keep_text=False)


def measured(docs: DataFrame, model: Topics, seed: int = 42, text: str = "text") -> DataFrame:
    """(doc_id, source, lang, unit, tokens, topic) of every row, without its text."""
    return with_topics(counted_rows(docs, seed, text), model, "counts", "topic")


def margin(name: str) -> F.Column:
    return F.coalesce(F.col(name).cast("string"), F.lit(NULL))


def cells(rows: DataFrame) -> DataFrame:
    """(source, lang, topic, have): tokens of each cell of ``measured`` rows; a null margin is a value of its own."""
    return rows.groupBy(margin("source").alias("source"), margin("lang").alias("lang"), "topic").agg(F.sum("tokens").cast("double").alias("have"))


def targets(table: pd.DataFrame, share: float, temper: dict[str, float]) -> dict[str, tuple[np.ndarray, np.ndarray, list]]:
    """Of each margin the value's number of each cell, the values' targets, and the values. A value whose target is beyond what it holds gets all of that, and the others share what is left."""
    have, out = table.have.to_numpy(), {}
    for name, power in temper.items():
        code, values = pd.factorize(table[name], sort=True)
        own = np.bincount(code, have, len(values))
        raw, target, full = (own / have.sum()) ** power, np.zeros(len(values)), np.zeros(len(values), bool)
        for _ in range(len(values)):
            left, free = share * have.sum() - own[full].sum(), raw[~full].sum()
            target = np.where(full, own, raw * (left / free if free else 0))
            if not (over := ~full & (target > own)).any():
                break
            full |= over
        out[name] = code, target, list(values)
    return out


def fitted(table: pd.DataFrame, share: float, temper: dict[str, float]) -> np.ndarray:
    """Tokens that each cell of ``table`` should give."""
    have = table.have.to_numpy()
    want = have * share
    if not have.sum():
        return want
    margins = targets(table, share, temper)
    for _ in range(SWEEPS):
        before = want
        for code, target, _ in margins.values():
            now = np.bincount(code, want, len(target))
            want = want * (target / np.where(now > 0, now, 1))[code]
        want = np.minimum(want, have)
        if np.abs(want - before).sum() < TOLERANCE * share * have.sum():
            break
    return want


def reached(table: pd.DataFrame, share: float = SHARE, temper: dict[str, float] | None = None) -> pd.DataFrame:
    """(margin, value, have, target, want) of raked cells: how far each margin holds."""
    parts = [pd.DataFrame({"margin": name, "value": values, "have": np.bincount(code, table.have, len(values)), "target": target, "want": np.bincount(code, table.want, len(values))}) for name, (code, target, values) in targets(table, share, temper or TEMPER).items()]
    return pd.concat(parts, ignore_index=True)


def rake(have: DataFrame, share: float = SHARE, temper: dict[str, float] | None = None) -> DataFrame:
    """(source, lang, topic, have, want): want sums to ``share`` of all tokens and to the tempered margins, as far as the cells hold enough. One task holds the cells, never the documents.

    A cell without tokens wants none; where no cell has tokens all want none; no cells give no rows.
    """
    powers = temper or TEMPER

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        parts = list(batches)
        if parts:
            table = pd.concat(parts).sort_values(["source", "lang", "topic"], ignore_index=True)
            yield table.assign(want=fitted(table, share, powers))

    return have.select("source", "lang", "topic", "have").coalesce(1).mapInPandas(run, "source string, lang string, topic string, have double, want double")


def probabilities(raked: DataFrame, share: float = SHARE) -> DataFrame:
    """(source, lang, topic, probability); a cell without tokens is sampled at ``share``."""
    return raked.select("source", "lang", "topic", F.when(F.col("have") > 0, F.col("want") / F.col("have")).otherwise(share).alias("probability"))


def fresh(columns: list[str], name: str) -> str:
    """A column name that does not clash."""
    while name.lower() in {c.lower() for c in columns}:
        name += "_"
    return name


def chances(rows: DataFrame) -> DataFrame:
    """(cell_source, cell_lang, topic, probability) of ``measured`` rows, broadcast where there are few."""
    chance = checkpoint(probabilities(rake(cells(rows)))).withColumnsRenamed({"source": "cell_source", "lang": "cell_lang"})
    return F.broadcast(chance) if chance.count() <= BROADCAST else chance


def mix(docs: DataFrame, seed: int = 42) -> DataFrame:
    """Pipeline stage: the sampled rows, with all their columns.

    Rows of one doc_id whose source, language and topic are equal share a fate; a row without id is drawn by its text. Null sources and languages are margins of their own; a null, empty
    or wordless text has topic 0. Equal hashes, if any, share a fate. Texts of any length are counted whole; an empty table stays empty.
    """
    counts, topic, tokens, p, a, b = (fresh(docs.columns, x) for x in ("counts", "topic", "tokens", "probability", "cell_source", "cell_lang"))
    rows = checkpoint(counted(docs, counts, tokens))
    bare = checkpoint(rows.select("source", "lang", counts, F.col(tokens).alias("tokens")))  # a checkpoint is read whole: the fit would read every text in each of its passes
    model = fit_counted(bare, counts)
    chance = chances(with_topics(bare, model, counts, "topic"))
    rows = with_topics(rows, model, counts, topic)
    rows = rows.withColumns({a: margin("source"), b: margin("lang")})
    return rows.join(chance.select(F.col("cell_source").alias(a), F.col("cell_lang").alias(b), F.col("topic").alias(topic), F.col("probability").alias(p)), [a, b, topic]).where(unit(seed) < F.col(p)).select(*docs.columns)


def sample(docs: DataFrame, seed: int = 42) -> DataFrame:
    """(doc_id, source, lang, topic, tokens, probability) of the sampled documents, with the results that ``mix`` defines; what each document counts is written once, without texts."""
    rows = checkpoint(counted_rows(docs, seed, "text"))
    rows = checkpoint(with_topics(rows, fit_counted(rows, "counts"), "counts", "topic"))
    drawn = rows.withColumns({"cell_source": margin("source"), "cell_lang": margin("lang")}).join(chances(rows), ["cell_source", "cell_lang", "topic"]).where("unit < probability")
    return drawn.select("doc_id", "source", "lang", "topic", "tokens", "probability")
