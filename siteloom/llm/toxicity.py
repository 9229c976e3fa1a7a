"""Toxicity by class-conditional Kneser-Ney models over shared backoff counts.

Words are spelt by two Kneser-Ney models of character n-grams (up to ``ORDER`` symbols, within words, a start for each declared language), toxic and ordinary,
fitted on labelled documents; a letter beyond the most frequent is spelt by digits of its code point, so that no two letters are taken for one. Where a class has not seen an n-gram it backs off to one shared model: continuation counts (distinct symbols to the left) of
shorter n-grams over the whole corpus. So a rare expression weighs by what its spelling shares with labelled ones, and what neither class has
seen says nothing. A document's score is the log-likelihood ratio of its distinct words (a word repeated is one piece of evidence) over their number, plus
``SHRINK`` words so that two words prove little; it is toxic where the score passes the threshold that separates held-out labelled documents best.

Scale: the labelled sample is bounded by ``PER_CLASS`` documents of each class. The continuation counts cover all documents: each task passes on its distinct
n-grams whose right part the sample knows, and only they are shuffled. Scoring is map-only, once for each distinct word of a slice. The model
that is broadcast is bounded by the sample.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from siteloom.llm.arrays import ragged_index
from siteloom.llm.common import checkpoint, filter_slices, in_one_task, labelled_sample, map_slices, row_of, segment_sums, slices, tidy, words

#: Labelled documents of each class at most; one in five is held out for the threshold.
PER_CLASS = 3000
#: Symbols of an n-gram at most, the discount, and words added to a document's length.
ORDER, DISCOUNT, SHRINK = 6, 0.75, 60.0
#: Codes of symbols: the most frequent letters one each, the digits that spell any other letter, the end, and the starts (any language, then each known one).
BITS, LETTERS, DIGITS, STARTS = 9, 186, 256, 68
DIGIT, END, START = LETTERS + 1, LETTERS + DIGITS + 1, LETTERS + DIGITS + 2
#: Code points: all of them have letters' codes or are spelt by two digits, from 65536 by three.
POINTS = 0x110000
#: Codes that a task holds before it passes on the distinct ones.
HELD = 1 << 21
#: Words spelt at once while fitting, and bytes of text scored at once.
CHUNK, SLICE = 1 << 15, 2 << 20


def masked(codes: np.ndarray, symbols: int) -> np.ndarray:
    return codes & ((1 << BITS * symbols) - 1)


@dataclass
class Spelling:
    """Symbols of letters and starts of languages."""

    letters: np.ndarray  # by code point; 0 for letters that digits spell
    languages: list[str]

    @staticmethod
    def of(texts: pa.Array, languages: list[str | None]) -> Spelling:
        _, ids, vocabulary = words(texts)
        point = np.frombuffer("".join(vocabulary.to_pylist()).encode("utf-32-le", "surrogatepass"), np.uint32)
        count = np.bincount(point, minlength=POINTS)
        order = np.argsort(-count, kind="stable")[:LETTERS]
        order = order[count[order] > 0]
        letters = np.zeros(POINTS, np.int16)
        letters[order] = np.arange(1, len(order) + 1)
        known, times = np.unique([x for x in languages if x is not None], return_counts=True)
        return Spelling(letters, known[np.argsort(-times, kind="stable")][: STARTS - 1].tolist())

    def starts(self, languages: list[str | None]) -> np.ndarray:
        known = {x: i + 1 for i, x in enumerate(self.languages)}
        return np.array([known.get(x, 0) for x in languages], np.int64)

    def symbols(self, point: np.ndarray, sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Symbols of words, one after another, and how many each has; ``sizes`` counts their code points."""
        code = self.letters[point].astype(np.int64)
        rare = code == 0
        if not rare.any():
            return code, sizes
        n = np.where(rare, np.where(point < 0x10000, 2, 3), 1)
        at = np.cumsum(n) - n
        out = np.zeros(int(n.sum()), np.int64)
        out[at[~rare]] = code[~rare]
        for k in range(3):  # the most significant digit first
            own = rare & (n > k)
            out[at[own] + k] = DIGIT + ((point[own].astype(np.int64) >> 8 * (n[own] - 1 - k)) & 0xFF)
        total = np.concatenate([[0], np.cumsum(n)])
        return out, np.diff(total[np.concatenate([[0], np.cumsum(sizes)])])

    def codes(self, vocabulary: pa.Array, start: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """n + 1 offsets, and of each symbol of each word but its start the code of the n-gram that ends there."""
        text = vocabulary.to_pylist()
        point = np.frombuffer("".join(text).encode("utf-32-le", "surrogatepass"), np.uint32)
        spelt, sizes = self.symbols(point, np.fromiter(map(len, text), np.int64, len(text)))
        ends = np.cumsum(sizes + 2)
        flat = np.full(ends[-1] if len(ends) else 0, END, np.int64)
        flat[ends - sizes - 2] = START + start
        flat[ragged_index(ends - sizes - 1, sizes)] = spelt
        place = ragged_index(np.zeros(len(text), np.int64), sizes + 2)
        code = flat.copy()
        for k in range(1, ORDER):
            code[k:] |= np.where(place[k:] >= k, flat[:-k] << BITS * k, 0)
        return np.concatenate([[0], np.cumsum(sizes + 1)]), code[place > 0]


@dataclass
class Model:
    """Log ratios of n-grams that a class has seen, and of contexts for the symbols that neither has seen there; both by sorted code."""

    spelling: Spelling
    codes: np.ndarray
    ratio: np.ndarray
    contexts: np.ndarray
    context_ratio: np.ndarray
    threshold: float = field(default=np.inf)

    def score(self, texts: pa.Array, languages: list[str | None]) -> np.ndarray:
        offsets, ids, vocabulary = words(texts)
        if not len(ids):
            return np.zeros(len(texts))
        start = self.spelling.starts(languages)[row_of(offsets)]
        pairs, where = np.unique(ids * STARTS + start, return_inverse=True)
        at, code = self.spelling.codes(vocabulary.take(pa.array(pairs // STARTS)), pairs % STARTS)
        value, seen = lookup(self.codes, self.ratio, code)
        rest, _ = lookup(self.contexts, self.context_ratio, code[~seen] >> BITS)
        value[~seen] = rest
        kinds = np.unique(row_of(offsets) * len(pairs) + where)  # a repeated word is one piece of evidence
        length = np.bincount(kinds // len(pairs), minlength=len(texts))
        return np.bincount(kinds // len(pairs), segment_sums(value, at)[kinds % len(pairs)], len(texts)) / (length + SHRINK)


def lookup(keys: np.ndarray, values: np.ndarray, wanted: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Values of wanted keys, 0 where there are none, and whether there are."""
    if not len(keys):
        return np.zeros(len(wanted)), np.zeros(len(wanted), bool)
    at = np.minimum(np.searchsorted(keys, wanted), len(keys) - 1)
    hit = keys[at] == wanted
    return np.where(hit, values[at], 0.0), hit


def shorter(codes: np.ndarray, symbols: int) -> np.ndarray:
    """The distinct right parts of so many symbols that hold no start."""
    parts = np.unique(masked(codes, symbols))
    first = parts >> BITS * (symbols - 1)
    return parts[(first > 0) & (first < START)]


def continuations(docs: DataFrame, spelling: Spelling, known: list[np.ndarray], text: str = "text") -> list[np.ndarray]:
    """For each k, of each known n-gram of k + 1 symbols the distinct symbols to its left over all documents."""
    shared = docs.sparkSession.sparkContext.broadcast((spelling, known))

    def distinct(texts: pa.Array) -> np.ndarray:
        """Distinct n-grams of 2 .. ORDER symbols; the level lies above a code's bits."""
        own, grams = shared.value
        _, ids, vocabulary = words(texts)
        _, code = own.codes(vocabulary, np.zeros(len(vocabulary), np.int64))
        found = []
        for k, right in enumerate(grams):
            code_k = np.unique(masked(code, k + 2))
            code_k = code_k[code_k >> BITS * (k + 1) > 0]
            found.append(code_k[lookup(right, right, masked(code_k, k + 1))[1]] | (k << BITS * ORDER))
        return np.concatenate(found)

    def codes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, n = [], 0
        for batch in batches:
            for part in slices(batch, limit=SLICE):
                held.append(distinct(part.column(0)))
                n += len(held[-1])
                if n > HELD:
                    held = [np.unique(np.concatenate(held))]
                    n = len(held[0])
                    if n > HELD // 2:
                        yield pa.RecordBatch.from_arrays([pa.array(held.pop())], ["code"])
                        n = 0
            tidy()
        if held:
            yield pa.RecordBatch.from_arrays([pa.array(np.unique(np.concatenate(held)))], ["code"])

    # the level and the right part: what is left without the leftmost symbol
    level = F.shiftright("code", BITS * ORDER)
    right = F.col("code").bitwiseAND(F.expr(f"shiftleft(1L, cast({BITS} * (shiftright(code, {BITS * ORDER}) + 1) as int)) - 1"))
    rows = docs.select(F.col(text).alias("text")).mapInArrow(codes, "code long").distinct().groupBy(level.alias("level"), right.alias("gram")).count().toArrow()
    of, gram, count = (rows[c].to_numpy() for c in ("level", "gram", "count"))
    out = []
    for k, right_parts in enumerate(known):
        order = np.argsort(gram[of == k])
        out.append(lookup(gram[of == k][order], count[of == k][order].astype(float), right_parts)[0])
    return out


def grouped(keys: np.ndarray, values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct keys and their sums."""
    distinct, where = np.unique(keys, return_inverse=True)
    return distinct, np.bincount(where, values, len(distinct))


def backoff(codes: np.ndarray, known: list[np.ndarray], counts: list[np.ndarray]) -> np.ndarray:
    """Shared probability of each code's last symbol, given its context without the leftmost symbol (and without a start)."""
    p = np.full(len(codes), 1.0 / END)
    for k, (grams, count) in enumerate(zip(known, counts, strict=True)):
        contexts, total = grouped(grams >> BITS, count)
        _, lost = grouped(grams >> BITS, np.minimum(count, DISCOUNT))
        # only where the code has a context of k symbols that lies within it, and not as a whole
        own = masked(codes, k + 1)
        first = own >> BITS * k
        fits = (first > 0) & (first < START) & (codes >> BITS * (k + 1) > 0)
        sums, there = lookup(contexts, total, own >> BITS)
        there &= fits & (sums > 0)
        part, _ = lookup(grams, np.maximum(count - DISCOUNT, 0), own)
        gone, _ = lookup(contexts, lost, own >> BITS)
        sums[~there] = 1
        p = np.where(there, part / sums + gone / sums * p, p)
    return p


def gathered(vocabulary: pa.Array, start: np.ndarray, times: list[np.ndarray], spelling: Spelling) -> tuple[np.ndarray, list[np.ndarray]]:
    """The sample's n-grams by code, and how often each class has them; times: how often each (word, start) occurs in toxic and in ordinary documents."""
    parts = []
    for at in range(0, len(vocabulary), CHUNK):
        offsets, code = spelling.codes(vocabulary.slice(at, CHUNK), start[at : at + CHUNK])
        word = row_of(offsets) + at
        # every n-gram with the start of a language counts under that of any language as well
        anywhere = spelling_any(code)
        with_start = code != anywhere
        keys, where = np.unique(np.concatenate([code, anywhere[with_start]]), return_inverse=True)
        word = np.concatenate([word, word[with_start]])
        parts.append((keys, *(np.bincount(where, own[word], len(keys)) for own in times)))
    codes, where = np.unique(np.concatenate([p[0] for p in parts]), return_inverse=True)
    counts = [np.bincount(where, np.concatenate([p[k] for p in parts]), len(codes)) for k in (1, 2)]
    return codes, counts


def known_grams(codes: np.ndarray) -> list[np.ndarray]:
    """The n-grams that the shared model counts, of 1 .. ORDER - 1 symbols."""
    return [shorter(codes, k + 1) for k in range(ORDER - 1)]


def build(vocabulary: pa.Array, start: np.ndarray, times: list[np.ndarray], spelling: Spelling, count_all: Callable[[list[np.ndarray]], list[np.ndarray]]) -> Model:
    """count_all: known n-grams -> continuation counts."""
    codes, counts = gathered(vocabulary, start, times, spelling)
    known = known_grams(codes)
    shared = backoff(codes, known, count_all(known))
    contexts, context = np.unique(codes >> BITS, return_inverse=True)
    logs, weights = [], []
    for count in counts:
        total = np.bincount(context, count, len(contexts))
        lost = np.bincount(context, np.minimum(count, DISCOUNT), len(contexts))
        weight = np.where(total > 0, lost / np.maximum(total, 1e-300), 1.0)
        p = np.maximum(count - DISCOUNT, 0) / np.maximum(total, 1e-300)[context]
        logs.append(np.log(p + weight[context] * shared))
        weights.append(np.log(weight))
    return Model(spelling, codes, logs[0] - logs[1], contexts, weights[0] - weights[1])


def spelling_any(code: np.ndarray) -> np.ndarray:
    """The same n-grams with the start of any language."""
    out = code.copy()
    for k in range(ORDER):
        symbol = (code >> BITS * k) & ((1 << BITS) - 1)
        out += np.where(symbol > START, (START - symbol) << BITS * k, 0)
    return out


def threshold(score: np.ndarray, y: np.ndarray) -> float:
    """Between the two scores where F1 of the toxic class is greatest; the higher of equals."""
    order = np.argsort(-score, kind="stable")
    s, hits = score[order], np.cumsum(y[order] == 1)
    f1 = 2 * hits / (np.arange(1, len(s) + 1) + max(1, (y == 1).sum()))
    f1[:-1][s[:-1] == s[1:]] = -1
    k = int(f1.argmax())
    return float((s[k] + s[k + 1]) / 2) if k + 1 < len(s) else float(s[k]) - 1e-9


@dataclass
class Sample:
    """A labelled sample by words: held marks the documents for the threshold."""

    texts: pa.Array
    y: np.ndarray
    languages: list[str | None]
    held: np.ndarray
    spelling: Spelling
    vocabulary: pa.Array
    start: np.ndarray
    times: list[np.ndarray]

    @staticmethod
    def of(rows: pa.Table) -> Sample | None:
        """None where a class has no document with a word. The order of rows does not matter."""
        rows = rows.sort_by([("y", "ascending"), ("doc_id", "ascending"), ("text", "ascending")])
        texts, y, languages = rows["text"].combine_chunks(), rows["y"].to_numpy(), rows["lang"].to_pylist()
        held = np.arange(len(y)) % 5 == 4
        offsets, ids, vocabulary = words(texts)
        row = row_of(offsets)
        if any(not ((y[row] == c) & ~held[row]).any() for c in (0, 1)):
            return None
        spelling = Spelling.of(texts.filter(pa.array(~held)), languages)
        pairs, where = np.unique(ids * STARTS + spelling.starts(languages)[row], return_inverse=True)
        times = [np.bincount(where[(y[row] == c) & ~held[row]], minlength=len(pairs)).astype(float) for c in (1, 0)]
        return Sample(texts, y, languages, held, spelling, vocabulary.take(pa.array(pairs // STARTS)), pairs % STARTS, times)

    def model(self, counts: list[np.ndarray]) -> Model:
        model = build(self.vocabulary, self.start, self.times, self.spelling, lambda known: counts)
        probe = np.flatnonzero(self.held if all((self.y[self.held] == c).any() for c in (0, 1)) else ~self.held)
        scores = [model.score(self.texts.take(pa.array(own)), [self.languages[i] for i in own]) for own in np.array_split(probe, len(probe) // 256 + 1)]
        model.threshold = threshold(np.concatenate(scores), self.y[probe])
        return model


def _known(rows: pa.Table) -> tuple[Spelling, list[np.ndarray]] | None:
    own = Sample.of(rows)
    return own and (own.spelling, known_grams(gathered(own.vocabulary, own.start, own.times, own.spelling)[0]))


def fit(docs: DataFrame, labels: DataFrame, text: str = "text", lang: str = "lang", per_class: int = PER_CLASS) -> Model | None:
    """The model, or None where a class has no labelled document with a word. Repeated texts count once."""
    sample = labelled_sample(docs.select("doc_id", F.col(text).alias("text"), F.col(lang).cast("string").alias("lang")), labels, "toxic", per_class).where("text is not null")
    sample = checkpoint(sample.groupBy("text").agg(F.min("doc_id").alias("doc_id"), F.max("y").cast("long").alias("y"), F.min("lang").alias("lang")))
    found = in_one_task(sample, _known)
    if found is None:
        return None
    counts = docs.sparkSession.sparkContext.broadcast(continuations(docs, *found, text))
    return in_one_task(sample, lambda rows: Sample.of(rows).model(counts.value))


def flagged(scores: np.ndarray, model: Model | None) -> np.ndarray:
    return scores > max(0.0, model.threshold) if model else np.zeros(len(scores), bool)


def score(docs: DataFrame, model: Model | None, text: str = "text", lang: str = "lang") -> DataFrame:
    """(doc_id, score, toxic) for every row.

    A null, empty or wordless text scores 0 and is not toxic; without a model (no labels of both classes) all score 0 and none is toxic. An unknown or null language starts
    words as any language does. Texts are scored whole. A score equal to the threshold is not toxic. Repeated rows score alike. An empty table gives no
    rows; other columns are not read.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        m = shared.value
        s = m.score(batch.column(text), batch.column(lang).to_pylist()) if m else np.zeros(batch.num_rows)
        return pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(s), pa.array(flagged(s, m))], ["doc_id", "score", "toxic"])

    return map_slices(docs.withColumns({"doc_id": F.col("doc_id").cast("long"), lang: F.col(lang).cast("string")}), ["doc_id", text, lang], run, "doc_id long, score double, toxic boolean", text, SLICE)


def drop_toxic(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """Pipeline stage: rows that are not toxic, with all their columns.

    A row with a null, empty or wordless text stays, and all stay where a class has no labels. A score equal to the threshold is not toxic. Repeated rows share a fate, texts of any length
    are scored whole, an empty table stays empty, and columns of any name pass through.
    """
    shared = docs.sparkSession.sparkContext.broadcast(fit(docs, labels))
    return filter_slices(docs, lambda batch: ~flagged(shared.value.score(batch.column("text"), batch.column("lang").to_pylist()), shared.value) if shared.value else np.ones(batch.num_rows, bool), limit=SLICE)
