"""Text functions of the audit rules, as columns."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from siteloom.plans.lineage import tidy

NOT_WORD = r"[^\p{L}\p{N}_]+"
#: Words that say nothing about a page, in alphabetical order.
STOP = "about all and are been but call can come could day did down each find first for get had has her him how into its like long look made make many may more not now number other out part people said see she some than the their them then there these time two use was water way were when which who will would write your".split()


def sha256(text: Column) -> Column:
    return F.upper(F.sha2(F.encode(text, "UTF-8"), 256))


def cleaned(html: Column) -> Column:
    """Text without scripts, styles, embedded frames and tags, white space collapsed."""
    body = F.regexp_replace(html, r"(?is)<(script|style|noscript|svg|iframe)\b[^>]*>.*?</(script|style|noscript|svg|iframe)>", " ")
    return F.trim(F.regexp_replace(F.regexp_replace(body, r"(?s)<[^>]*>", " "), r"\s+", " "))


def hamming(a: Column, b: Column) -> Column:
    return F.bit_count(a.bitwiseXOR(b))


def similarity(distance: Column) -> Column:
    """In percent of 64 bits."""
    return (F.lit(64) - distance) / F.lit(64.0) * F.lit(100.0)


_STOP = frozenset(STOP)
#: Characters of the texts whose words are numbered together: a distinct word takes some 600 bytes.
RUN = 1 << 20


def fingerprints(texts: list[str | None]) -> np.ndarray:
    """Of each text 64 votes of its words' MD5: each of at least three letters that is no stop word votes by its first eight bytes, as often as it occurs; a distinct word is hashed once."""
    import regex

    split = regex.compile(NOT_WORD).split
    number: dict[str, int] = {}
    ids = [[number.setdefault(w, len(number)) for w in split((t or "").lower()) if len(w) > 2 and w not in _STOP] for t in texts]
    digests = b"".join(hashlib.md5(w.encode()).digest()[:8] for w in number)
    bits = 2 * np.unpackbits(np.frombuffer(digests, np.uint8).reshape(-1, 8), axis=1, bitorder="little").astype(np.int32) - 1
    votes = np.stack([bits[own].sum(0) if own else np.zeros(64, np.int32) for own in ids]) if ids else np.zeros((0, 64), np.int32)
    return np.packbits(votes > 0, axis=1, bitorder="little").view("<i8")[:, 0] if len(votes) else np.zeros(0, np.int64)


def runs(texts: list[str | None], limit: int = RUN) -> Iterator[list[str | None]]:
    """Runs of texts of at most ``limit`` characters in all; a longer text is a run of its own."""
    own: list[str | None] = []
    size = 0
    for t in texts:
        n = len(t or "")
        if own and size + n > limit:
            yield own
            own, size = [], 0
        own.append(t)
        size += n
    if own:
        yield own


def fingerprint(text: str | None) -> int:
    return int(fingerprints([text])[0])


@F.pandas_udf(T.LongType())
def simhash(texts: Iterator[pd.Series]) -> Iterator[pd.Series]:
    for t in texts:
        yield pd.Series(np.concatenate([np.zeros(0, np.int64), *map(fingerprints, runs(t.tolist()))]), dtype="int64")
        tidy()


def word_set(text: Column) -> Column:
    return F.array_distinct(F.filter(F.split(F.lower(text), NOT_WORD), lambda w: F.length(w) > 2))


def jaccard(a: Column, b: Column) -> Column:
    """Of words of more than two letters; 0 where either has none."""
    x, y = word_set(a), word_set(b)
    both = F.size(F.array_union(x, y))
    return F.when((F.size(x) == 0) | (F.size(y) == 0), 0.0).otherwise(F.size(F.array_intersect(x, y)) / both)


def pixel_width(title: Column) -> Column:
    """Capitals 12, narrow signs and blanks 4, others 8."""
    count = lambda pattern: F.length(F.regexp_replace(title, pattern, ""))
    upper, narrow = F.length(title) - count(r"[\p{Lu}]"), F.length(title) - count(r"[il!|., ]")
    return F.length(title) * 8 + upper * 4 - narrow * 4


def utf16_length(text: Column) -> Column:
    return (F.octet_length(F.encode(text, "UTF-16BE")) / 2).cast("int")


def preview(text: Column, size: int = 120) -> Column:
    flat = F.regexp_replace(text, r"[\r\n]+", " ")
    return F.when(F.length(flat) > size, F.concat(F.substring(flat, 1, size), F.lit("..."))).otherwise(flat)


@F.pandas_udf(T.StringType())
def unescape(texts: pd.Series) -> pd.Series:
    import html

    return texts.map(lambda t: None if t is None else html.unescape(t))


def outdated(when: Column, now: Column, days: int = 730) -> Column:
    return F.datediff(now, when) > days


def labelled(value: Column, labels: dict, default: Column) -> Column:
    return reduce(lambda c, kv: c.when(value == F.lit(kv[0]), F.lit(kv[1])), labels.items(), F.when(F.lit(False), "")).otherwise(default)


REDIRECT_KINDS = {301: "Permanent Redirect (301)", 302: "Temporary Redirect (302)", 303: "See Other (303)", 307: "Temporary Redirect (307)", 308: "Permanent Redirect (308)"}


def redirect_kind(status: Column) -> Column:
    return labelled(status, REDIRECT_KINDS, F.format_string("Redirect (%d)", status))


def sitemap_priority(depth: Column) -> Column:
    return F.when(depth == 0, 1.0).when(depth == 1, 0.8).when(depth == 2, 0.6).otherwise(0.4)


def change_frequency(depth: Column) -> Column:
    return F.when(depth == 0, "daily").when(depth == 1, "weekly").when(depth == 2, "monthly").otherwise("yearly")


def sheet_name(name: Column) -> Column:
    return F.substring(F.translate(name, r":\/?*[]", "_______"), 1, 31)


def cell(value: Column, kind: str) -> Column:
    if kind == "boolean":
        return F.when(value, "Yes").when(~value, "No").otherwise("(none)")
    return F.coalesce(value.cast("string"), F.lit("(none)"))
