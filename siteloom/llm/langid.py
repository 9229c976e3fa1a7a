"""Language identification by rank-order profiles of character n-grams.

A profile lists a language's ``RANKS`` most frequent n-grams of 1 to 3 letters, words padded with blanks. A document's own most frequent
n-grams are compared with each profile: an n-gram costs how far its rank is out of place, or ``RANKS`` where the profile lacks it; the language of
the least sum is the answer. How far a document may be from its language is calibrated on labelled documents that its profile was not made of, by the number of n-grams
compared, so that a text in a language without a profile is rejected even in the same script.

Scale: profiles are fitted on a bounded sample of labelled rows (``PER_LANGUAGE``); the answer is map-only.
"""

from __future__ import annotations

import functools
import unicodedata
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from siteloom.llm.common import filter_slices, in_one_task, map_slices

#: Labelled documents of each language at most, n-grams in a profile, and what share of the greatest possible distance a language may have where nothing is calibrated.
PER_LANGUAGE, RANKS, MOST = 400, 300, 0.92
#: A declared language is contradicted where another is nearer by this share of its distance at least, or by more than held-out documents of as many n-grams come to be nearer to another language (``margins``).
MARGIN = 0.12
#: Languages with profiles at most, those of most documents.
LANGUAGES = 1000
#: Words of the excerpts of held-out documents that calibrate short texts.
EXCERPTS = (1, 2, 3, 5, 8, 13, 21)
#: Held-out documents of about as many n-grams that calibrate a limit (MOST holds where there are fewer in all), the quantile of their distances, and the share of the way from there to 1 that is left free.
HELD, QUANTILE, FREE = 100, 0.99, 0.25
SEPARATOR = "\x00"
#: Bytes of text ranked at once: each letter has three n-grams of eight bytes.
SLICE = 1 << 20


#: Code points that may be letters or marks (beyond them lie private ones and the variation selectors, which say nothing), and bits of a symbol.
POINTS, BITS = 0x40000, 18


@functools.lru_cache(1)
def letters() -> np.ndarray:
    return np.array([unicodedata.category(chr(c))[0] in "LM" for c in range(POINTS)])


def grams(texts: pa.Array) -> list[np.ndarray]:
    """Sorted codes of all n-grams of each text."""
    if not len(texts):
        return []
    joined = SEPARATOR.join(t.replace(SEPARATOR, " ") if t else "" for t in pc.utf8_lower(texts.cast(pa.large_string())).to_pylist()) + SEPARATOR
    code = np.frombuffer(joined.encode("utf-32-le", "surrogatepass"), np.uint32)
    bounds = np.flatnonzero(code == 0)
    code = np.minimum(code, POINTS - 1).astype(np.int64)
    code[~letters()[code]] = 0
    # one blank before, between and after words
    keep = np.append(True, (code[1:] != 0) | (code[:-1] != 0)) if len(code) else np.zeros(0, bool)
    keep[bounds] = True
    place = np.cumsum(keep) - 1
    code, ends = np.concatenate([[0], code[keep]]), place[bounds] + 1
    out, start = [], 0
    for end in ends:  # code[start] and code[end] are blanks
        c = code[start : end + 1]
        one, two, three = c[c > 0], (c[:-1] << BITS) | c[1:], (c[:-2] << 2 * BITS) | (c[1:-1] << BITS) | c[2:]
        two, three = two[(c[:-1] > 0) | (c[1:] > 0)], three[c[1:-1] > 0]
        out.append(np.sort(np.concatenate([one | 1 << 3 * BITS, two | 2 << 3 * BITS, three | 3 << 3 * BITS])))
        start = end
    return out


def ranked(codes: np.ndarray) -> np.ndarray:
    """The RANKS most frequent codes of a sorted array, ties by code."""
    if not len(codes):
        return codes
    at = np.flatnonzero(np.diff(codes, prepend=codes[0] - 1))
    count = np.diff(np.append(at, len(codes)))
    if len(at) > RANKS:  # those beyond the last rank's count cannot enter
        least = np.partition(count, len(count) - RANKS)[len(count) - RANKS]
        few = count >= least
        at, count = at[few], count[few]
    return codes[at[np.argsort(-count, kind="stable")[:RANKS]]]


@dataclass
class Profiles:
    languages: list[str]
    codes: np.ndarray
    ranks: np.ndarray  # (codes + 1, languages); the last row is for codes that no profile has
    limits: np.ndarray = field(default_factory=lambda: np.full(RANKS + 1, MOST))  # the greatest distance accepted, by number of n-grams
    margins: np.ndarray = field(default_factory=lambda: np.full(RANKS + 1, MARGIN))  # how much nearer than the declared language another must be, by number of n-grams

    @staticmethod
    def of(ranked_by_language: dict[str, np.ndarray]) -> Profiles:
        names = sorted(ranked_by_language)
        codes = np.unique(np.concatenate([ranked_by_language[x] for x in names])) if names else np.zeros(0, np.int64)
        ranks = np.full((len(codes) + 1, len(names)), -1, np.int64)
        for j, x in enumerate(names):
            ranks[np.searchsorted(codes, ranked_by_language[x]), j] = np.arange(len(ranked_by_language[x]))
        return Profiles(names, codes, ranks)

    def distances(self, own: np.ndarray) -> np.ndarray:
        """Share of the greatest possible distance to each language, from ranked codes."""
        at = np.minimum(np.searchsorted(self.codes, own), len(self.codes) - 1)
        ranks = self.ranks[np.where(self.codes[at] == own, at, len(self.codes))]
        out = np.where(ranks < 0, RANKS, np.abs(ranks - np.arange(len(own))[:, None]))
        return out.sum(0) / (RANKS * len(own))

    def identify(self, texts: pa.Array, declared: list[str | None]) -> tuple[list[str | None], np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Of each text the nearest language, its distance, the next one's, the declared one's (1 where it has no profile), and the n-grams compared; no language without letters."""
        place = {x: j for j, x in enumerate(self.languages)}
        found, best, second, own_distance, n = [], np.ones(len(texts)), np.ones(len(texts)), np.ones(len(texts)), np.zeros(len(texts), np.int32)
        for i, codes in enumerate(grams(texts)):
            own = ranked(codes)
            n[i] = len(own)
            if not len(own) or not self.languages:
                found.append(None)
                continue
            d = self.distances(own)
            k = int(d.argmin())
            found.append(self.languages[k])
            best[i], second[i] = d[k], np.partition(d, 1)[1] if len(d) > 1 else 1.0
            if declared[i] in place:
                own_distance[i] = d[place[declared[i]]]
        return found, best, second, own_distance, n


def accepted(found: tuple[list[str | None], np.ndarray, np.ndarray, np.ndarray, np.ndarray], declared: list[str | None], profiles: Profiles) -> np.ndarray:
    """Whether a document has a language, within the limit for its n-grams, and its declared one, if a known language, is not clearly another; ``found`` is what ``identify`` finds."""
    languages, best, _, own, n = found
    known = set(profiles.languages)
    other = np.array([d in known and d != x for d, x in zip(declared, languages, strict=True)], bool)
    has = np.array([x is not None for x in languages], bool)
    return has & (best <= profiles.limits[n]) & ~(other & (own - best > profiles.margins[n] * own))


def fit(docs: DataFrame, text: str = "text", lang: str = "lang", per_language: int = PER_LANGUAGE, languages: int = LANGUAGES) -> Profiles:
    """Profiles of the ``languages`` that label most documents, each of the per_language documents of the smallest hashed ids, of equals those of the smallest ids.

    One scan of ids and languages ranks them all (each task passes on at most per_language ids of a language), one more reads the texts of those chosen.
    """
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col(lang).cast("string").alias("lang")).where("doc_id is not null and lang is not null")
    kept = rows.groupBy("lang").count().orderBy(F.desc("count"), "lang").limit(languages).select("lang")
    first = F.row_number().over(Window.partitionBy("lang").orderBy(F.xxhash64("doc_id"), "doc_id"))
    chosen = rows.withColumn("place", first).where(F.col("place") <= per_language).select("doc_id", "lang").join(F.broadcast(kept), "lang")
    sample = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col(text).alias("text")).join(F.broadcast(chosen.distinct()), "doc_id").where("text is not null").select("lang", "text")
    return in_one_task(sample, _fit)


def _fit(rows: pa.Table) -> Profiles:
    rows = rows.sort_by([("lang", "ascending"), ("text", "ascending")])
    texts = {x: rows.filter(pc.equal(rows["lang"], x))["text"].combine_chunks() for x in sorted(set(rows["lang"].to_pylist()))}
    own = {x: grams(each) for x, each in texts.items()}
    profiles = _profiles(own)
    profiles.limits, profiles.margins = calibrated(own, texts)
    return profiles


def _profiles(own: dict[str, list[np.ndarray]]) -> Profiles:
    return Profiles.of({x: ranked(codes) for x, each in own.items() if each and len(codes := np.sort(np.concatenate(each)))})


def excerpts(texts: pa.Array) -> pa.Array:
    """Of each text so many of its words as EXCERPTS says in turn, from its middle: what a short text of its language may look like."""
    out = []
    for i, t in enumerate(texts.to_pylist()):
        w = t.split()
        n = EXCERPTS[i % len(EXCERPTS)]
        at = max(0, (len(w) - n) // 2)
        out.append(" ".join(w[at : at + n]))
    return pa.array(out, pa.string())


def calibrated(own: dict[str, list[np.ndarray]], texts: dict[str, pa.Array]) -> tuple[np.ndarray, np.ndarray]:
    """Limits and margins by number of n-grams, from the distances of each half of the documents, and of excerpts of them, to profiles of the other half.

    Documents nearest to another language than their label count for nothing, as labels may be wrong. A limit is a quantile of distances to the own language. A margin is a quantile of how much
    nearer excerpts come to another language than to that of the whole, MARGIN at least; beyond it a label is contradicted.
    """
    n, distance, n_excerpt, nearer = [], [], [], []
    for half in range(2):
        profiles = _profiles({x: each[1 - half :: 2] for x, each in own.items()})
        place = {x: j for j, x in enumerate(profiles.languages)}
        for x, each in own.items():
            if x not in place:
                continue
            parts = grams(excerpts(texts[x].take(pa.array(np.arange(half, len(each), 2)))))
            for whole, part in zip(each[half::2], parts, strict=True):
                if not len(whole := ranked(whole)) or profiles.languages[int((d := profiles.distances(whole)).argmin())] != x:
                    continue
                n.append(len(whole))
                distance.append(d.min())
                if len(part := ranked(part)):
                    d = profiles.distances(part)
                    n_excerpt.append(len(part))
                    nearer.append((d[place[x]] - d.min()) / d[place[x]] if d[place[x]] else 0.0)
                    n.append(len(part))
                    distance.append(d[place[x]])
    if len(n_excerpt) < HELD:
        return np.full(RANKS + 1, MOST), np.full(RANKS + 1, MARGIN)

    def quantiles(at: np.ndarray, values: np.ndarray) -> np.ndarray:
        out = []
        for k in range(RANKS + 1):
            off = np.abs(at - k)
            out.append(np.quantile(values[off <= np.partition(off, HELD - 1)[HELD - 1]], QUANTILE))
        return np.array(out)

    q = quantiles(np.array(n), np.array(distance))
    m = quantiles(np.array(n_excerpt), np.array(nearer))
    return np.minimum(MOST, q + FREE * (1 - q)), np.maximum(MARGIN, m)


def identify(docs: DataFrame, profiles: Profiles, text: str = "text", lang: str = "lang") -> DataFrame:
    """(doc_id, declared, language, distance, next_distance, keep) for every row.

    A null or empty text, or one without letters, has a null language, distance 1 and keep false; one in a language without a profile has the nearest and, beyond the limit, keep false. Of languages at the same distance the first by name is taken. Whole texts are
    ranked; n-grams of equal counts rank by code. Repeated rows answer alike. An empty table gives no rows. Other columns are not read.
    """
    shared = docs.sparkSession.sparkContext.broadcast(profiles)

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        p, declared = shared.value, batch.column(lang)
        found = p.identify(batch.column(text), declared.to_pylist())
        keep = accepted(found, declared.to_pylist(), p)
        return pa.RecordBatch.from_arrays([batch.column("doc_id"), declared, pa.array(found[0], pa.string()), pa.array(found[1]), pa.array(found[2]), pa.array(keep)], ["doc_id", "declared", "language", "distance", "next_distance", "keep"])

    return map_slices(docs.withColumns({"doc_id": F.col("doc_id").cast("long"), lang: F.col(lang).cast("string")}), ["doc_id", text, lang], run, "doc_id long, declared string, language string, distance double, next_distance double, keep boolean", text, SLICE)


def keep_identified(docs: DataFrame) -> DataFrame:
    """Pipeline stage: the rows whose language is found and not clearly another than declared, with all their columns.

    Rows with a null or empty text, or one without letters, go. Without any declared language there is no profile, and all rows go. Repeated rows share a fate; of languages at the same
    distance the first by name counts; texts of any length are ranked whole; an empty table stays empty.
    """
    shared = docs.sparkSession.sparkContext.broadcast(fit(docs))

    def mask(batch: pa.RecordBatch) -> np.ndarray:
        declared = batch.column("lang").to_pylist()
        return accepted(shared.value.identify(batch.column("text"), declared), declared, shared.value)

    return filter_slices(docs, mask, limit=SLICE)
