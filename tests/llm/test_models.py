"""Operators with models trained here: held-out accuracy, brute-force counterparts and odd rows."""

from __future__ import annotations

import collections
import itertools
import math
import random

import duckdb
import numpy as np
import pandas as pd
import pyarrow as pa
import pytest
from llm_data import DOCS, prose, word

from siteloom.llm import crf_lines, fm, langid, toxicity
from siteloom.llm.common import words

SWEARS = ["zorgnak", "zorgfit", "blaxhole", "krudwort", "zorgpel", "blaxmud"]


def toxic_rows(r: random.Random, n: int) -> list[tuple]:
    rows = []
    for i in range(n):
        text, toxic = prose(r, r.randint(20, 120)).split(), int(i % 4 == 0)
        for _ in range(len(text) // 12 + 1 if toxic else 0):
            text.insert(r.randrange(len(text)), r.choice(SWEARS))
        rows.append((i, " ".join(text), r.choice(["en", "xx", None]), "s", 0, toxic))
    return rows


def with_labels(spark, rows, column):
    docs = spark.createDataFrame([x[:5] for x in rows], DOCS)
    return docs, spark.createDataFrame([(x[0], x[5]) for x in rows], f"doc_id long, {column} int")


@pytest.fixture(scope="module")
def toxic_model(spark):
    docs, labels = with_labels(spark, toxic_rows(random.Random(1), 600), "toxic")
    return toxicity.fit(docs, labels)


def test_toxicity_on_held_out_documents(toxic_model):
    rows = toxic_rows(random.Random(2), 400)
    flagged = toxicity.flagged(toxic_model.score(pa.array([x[1] for x in rows]), [x[2] for x in rows]), toxic_model)
    truth = np.array([x[5] for x in rows]) == 1
    assert flagged[truth].mean() > 0.95 and flagged[~truth].mean() < 0.02


def test_unseen_expression_by_its_spelling(toxic_model):
    s = toxic_model.score(pa.array(["zorgmalu " + prose(random.Random(9), 10), prose(random.Random(9), 11)]), [None, None])
    assert s[0] > s[1] and s[0] > 0


def naive_score(model, text: str, lang: str | None) -> float:
    """Log ratios summed symbol by symbol through plain dictionaries."""
    ratios, contexts = dict(zip(model.codes.tolist(), model.ratio.tolist(), strict=True)), dict(zip(model.contexts.tolist(), model.context_ratio.tolist(), strict=True))
    _, ids, vocabulary = words(pa.array([text]))
    total, kinds = 0.0, {vocabulary[int(i)].as_py() for i in ids}
    start = toxicity.START + (model.spelling.languages.index(lang) + 1 if lang in model.spelling.languages else 0)
    for w in kinds:
        symbols = [start]
        for c in w:
            digits = [ord(c) >> 8, ord(c) & 255] if ord(c) < 0x10000 else [ord(c) >> 16, ord(c) >> 8 & 255, ord(c) & 255]
            symbols += [int(x)] if (x := model.spelling.letters[ord(c)]) else [toxicity.DIGIT + x for x in digits]
        symbols.append(toxicity.END)
        for i in range(1, len(symbols)):
            code = 0
            for s in symbols[max(0, i - toxicity.ORDER + 1) : i + 1]:
                code = code << toxicity.BITS | s
            total += ratios.get(code, contexts.get(code >> toxicity.BITS, 0.0))
    return total / (len(kinds) + toxicity.SHRINK)


def test_scores_match_naive(toxic_model):
    r = random.Random(4)
    texts = [prose(r, 30) + " zorgnak Blaxhole! zorgnak", "", prose(r, 5), "ünïcode 日本 😀"]
    for lang in (None, "en", "xx", "zz"):
        found = toxic_model.score(pa.array(texts), [lang] * len(texts))
        assert np.allclose(found, [naive_score(toxic_model, t, lang) for t in texts])


def scripted(r: random.Random, first: int, n: int) -> str:
    return "".join(chr(first + r.randrange(3000)) for _ in range(n))


@pytest.mark.parametrize("first", [0x4E00, 0x20000])
def test_toxicity_keeps_the_letters_of_large_scripts_apart(spark, first):
    """Thousands of letters, also beyond 65536, more than have symbols of their own; expressions differ by rare letters alone."""
    r = random.Random(3)
    swears = [scripted(r, first, 3) for _ in range(4)]

    def rows(seed: int, n: int) -> list[tuple]:
        r, out = random.Random(seed), []
        for i in range(n):
            own, toxic = [scripted(r, first, r.randint(1, 4)) for _ in range(r.randint(15, 40))], int(i % 3 == 0)
            for _ in range(4 * toxic):
                own.insert(r.randrange(len(own)), r.choice(swears))
            out.append((i, " ".join(own), "zh", "s", 0, toxic))
        return out

    model = toxicity.fit(*with_labels(spark, rows(1, 300), "toxic"))
    assert len({int(x) for x in model.spelling.letters if x}) == toxicity.LETTERS
    test = rows(2, 200)
    flagged, truth = toxicity.flagged(model.score(pa.array([x[1] for x in test]), ["zh"] * len(test)), model), np.array([x[5] for x in test]) == 1
    assert flagged[truth].mean() > 0.9 and flagged[~truth].mean() < 0.05


def test_kneser_ney_probabilities_match_brute_force():
    """Class models and shared backoff from word lists, by the definition."""
    r = random.Random(6)
    corpus = [word(r) for _ in range(300)]
    times = [collections.Counter(r.choices(corpus, k=200)), collections.Counter(r.choices(corpus, k=400))]
    vocabulary = sorted(set(times[0]) | set(times[1]))
    spelling = toxicity.Spelling.of(pa.array([" ".join(corpus)]), [])
    seen = {}

    def count_all(known):
        codes = np.unique(np.concatenate([spelling.codes(pa.array(corpus), np.zeros(len(corpus), np.int64))[1]]))
        out = []
        for k, grams in enumerate(known):
            left = np.unique(toxicity.masked(codes, k + 2))
            left = left[left >> toxicity.BITS * (k + 1) > 0]
            n = collections.Counter(toxicity.masked(left, k + 1).tolist())
            out.append(np.array([n[g] for g in grams.tolist()], float))
            seen[k] = n
        return out

    model = toxicity.build(pa.array(vocabulary), np.zeros(len(vocabulary), np.int64), [np.array([t[w] for w in vocabulary], float) for t in times], spelling, count_all)
    grams, contexts = [collections.Counter(), collections.Counter()], [collections.Counter(), collections.Counter()]
    for c, t in enumerate(times):
        for w, n in t.items():
            for code in spelling.codes(pa.array([w]), np.zeros(1, np.int64))[1].tolist():
                grams[c][code] += n
    known = {k: {int(toxicity.masked(np.array([c]), k + 1)[0]) for g in grams for c in g} for k in range(toxicity.ORDER - 1)}
    for c in (0, 1):
        for code, n in grams[c].items():
            contexts[c][code >> toxicity.BITS] += n

    def shared(code):
        p = 1 / toxicity.END
        for k in range(toxicity.ORDER - 1):
            own = code & ((1 << toxicity.BITS * (k + 1)) - 1)
            first = own >> toxicity.BITS * k
            if not (0 < first < toxicity.START) or not code >> toxicity.BITS * (k + 1):
                continue
            row = {g: seen[k][g] for g in known[k] if g >> toxicity.BITS == own >> toxicity.BITS and 0 < g >> toxicity.BITS * k < toxicity.START}
            if sum(row.values()) > 0:
                p = max(row.get(own, 0) - toxicity.DISCOUNT, 0) / sum(row.values()) + sum(min(v, toxicity.DISCOUNT) for v in row.values()) / sum(row.values()) * p
        return p

    for code, ratio in itertools.islice(zip(model.codes.tolist(), model.ratio.tolist(), strict=True), 0, None, 7):
        logs = []
        for c in (0, 1):
            total = contexts[c][code >> toxicity.BITS]
            lost = sum(min(n, toxicity.DISCOUNT) for g, n in grams[c].items() if g >> toxicity.BITS == code >> toxicity.BITS)
            weight = lost / total if total else 1.0
            logs.append(math.log((max(grams[c][code] - toxicity.DISCOUNT, 0) / total if total else 0) + weight * shared(code)))
        assert abs(ratio - (logs[0] - logs[1])) < 1e-9


def test_continuations_cover_all_documents(spark, r):
    texts = [prose(r, 40) for _ in range(30)]
    docs = spark.createDataFrame([(i, t, None, None, 0) for i, t in enumerate(texts)], DOCS).repartition(5)
    spelling = toxicity.Spelling.of(pa.array(texts), [])
    vocabulary = pa.array(sorted({w for t in texts for w in t.split()}))
    _, code = spelling.codes(vocabulary, np.zeros(len(vocabulary), np.int64))
    known = [toxicity.shorter(code, k + 1) for k in range(toxicity.ORDER - 1)]
    for k, (grams, found) in enumerate(zip(known, toxicity.continuations(docs, spelling, known), strict=True)):
        left = np.unique(toxicity.masked(code, k + 2))
        n = collections.Counter(toxicity.masked(left[left >> toxicity.BITS * (k + 1) > 0], k + 1).tolist())
        assert found.tolist() == [n[g] for g in grams.tolist()]


def test_toxicity_odd_rows(spark, odd_docs, no_docs, toxic_model):
    rows = toxicity.score(odd_docs, toxic_model).collect()
    assert len(rows) == odd_docs.count() and not any(x.toxic for x in rows if x.doc_id in (2, 3, 4, 7))
    assert {x.score for x in rows if x.doc_id in (2, 3, 4)} == {0.0}
    assert toxicity.score(no_docs, toxic_model).count() == 0
    labels = spark.createDataFrame([], "doc_id long, toxic int")
    assert toxicity.fit(no_docs, labels) is None and toxicity.fit(odd_docs, labels) is None
    kept = toxicity.drop_toxic(odd_docs, labels)
    assert kept.columns == odd_docs.columns and kept.count() == odd_docs.count()


def test_toxic_stage_drops_what_is_flagged(spark):
    rows = toxic_rows(random.Random(5), 400)
    docs, labels = with_labels(spark, rows, "toxic")
    model = toxicity.fit(docs, labels)
    bad = {x.doc_id for x in toxicity.score(docs, model).where("toxic").collect()}
    assert {x.doc_id for x in toxicity.drop_toxic(docs, labels).collect()} == {x[0] for x in rows} - bad and bad


LANGUAGES = {"aa": "kalomite serupa dinova lemaru", "bb": "strchk prnglo vzdrmt klpsz", "cc": "oueiau aeyoiu ilaea eioua"}


def in_language(r: random.Random, name: str, n: int) -> str:
    letters = LANGUAGES[name].replace(" ", "")
    return " ".join("".join(r.choice(letters) for _ in range(r.randint(2, 8))) for _ in range(n))


def language_rows(seed: int, n: int):
    r = random.Random(seed)
    return [(i, in_language(r, name, r.randint(8, 60)), name, "s", 0) for i, name in enumerate(r.choices(sorted(LANGUAGES), k=n))]


def naive_profile(texts) -> list[str]:
    count = collections.Counter()
    for t in texts:
        for w in "".join(c if c.isalpha() else " " for c in t.lower()).split():
            p = " " + w + " "
            count.update(p[i : i + k] for k in (1, 2, 3) for i in range(len(p) - k + 1) if p[i : i + k].strip())
    key = lambda g: (-count[g], len(g), [ord(c) if c != " " else 0 for c in g])
    return sorted(count, key=key)[: langid.RANKS]


def test_distances_match_naive(spark):
    rows = language_rows(1, 60)
    profiles = langid.fit(spark.createDataFrame(rows, DOCS))
    naive = {x: naive_profile([t for _, t, lang, *_ in rows if lang == x]) for x in LANGUAGES}
    for _, text, *_ in language_rows(2, 25):
        own = naive_profile([text])
        expected = [sum(abs(naive[x].index(g) - i) if g in naive[x] else langid.RANKS for i, g in enumerate(own)) / (langid.RANKS * len(own)) for x in sorted(LANGUAGES)]
        assert np.allclose(profiles.distances(langid.ranked(langid.grams(pa.array([text]))[0])), expected)


def test_languages_on_held_out_documents(spark):
    profiles = langid.fit(spark.createDataFrame(language_rows(3, 90), DOCS))
    rows = language_rows(4, 200)
    swapped = [(i, t, {"aa": "bb", "bb": "cc", "cc": "aa"}[lang] if i % 10 == 0 else lang, s, n) for i, t, lang, s, n in rows]
    found = langid.identify(spark.createDataFrame(swapped, DOCS), profiles).collect()
    truth = {i: lang for i, _, lang, *_ in rows}
    assert np.mean([x.language == truth[x.doc_id] for x in found]) > 0.97
    assert np.mean([x.keep for x in found if x.doc_id % 10]) == 1
    assert np.mean([x.keep for x in found if x.doc_id % 10 == 0]) < 0.5


FOREIGN = {
    "pl": "Wczoraj wieczorem poszliśmy na spacer wzdłuż rzeki, a potem wróciliśmy do domu, żeby przygotować kolację dla całej rodziny. Dzieci opowiadały o szkole i o tym, czego się nauczyły.",
    "fi": "Eilen illalla kävelimme joen rantaa pitkin ja palasimme sitten kotiin valmistamaan illallista koko perheelle. Lapset kertoivat koulusta ja siitä, mitä he olivat oppineet viikon aikana.",
    "tr": "Dün akşam nehir boyunca yürüdük ve sonra bütün aile için akşam yemeği hazırlamak üzere eve döndük. Çocuklar okuldan ve hafta boyunca öğrendiklerinden bahsettiler.",
    "id": "Kemarin malam kami berjalan di sepanjang sungai dan kemudian pulang ke rumah untuk menyiapkan makan malam bagi seluruh keluarga. Anak-anak bercerita tentang sekolah.",
}


def test_languages_without_a_profile_are_rejected(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    profiles = langid.fit(docs, per_language=100)
    foreign = spark.createDataFrame([(i, t, d, "a", 0) for i, (t, d) in enumerate((t, d) for t in FOREIGN.values() for d in (None, "en", "pl"))], DOCS)
    assert not any(x.keep for x in langid.identify(foreign, profiles).collect())
    own = langid.identify(docs, profiles).where("language = declared").collect()
    assert np.mean([x.keep for x in own]) > 0.995


def test_short_documents_are_contradicted_and_kept(spark):
    docs = spark.read.parquet("/root/testdata/sf0.1/documents.parquet")
    profiles = langid.fit(docs)
    short = [(i, " ".join(t.split()[: 3 + i % 6]), lang) for i, (t, lang) in enumerate(docs.where("length(text) > 300").select("text", "lang").limit(800).collect())]
    right = [(i, t, lang, "a", 0) for i, t, lang in short]
    wrong = [(i, t, {"en": "fr", "fr": "de", "de": "es", "es": "en"}[lang], "a", 0) for i, t, lang in short]
    kept, lost = (np.mean([x.keep for x in langid.identify(spark.createDataFrame(rows, DOCS), profiles).collect()]) for rows in (right, wrong))
    assert kept > 0.97 and lost < 0.5


def test_letters_beyond_the_basic_plane(spark):
    """Two languages in one supplementary script (letters of Gothic), told apart and kept."""
    r, letters = random.Random(2), [chr(0x10330 + i) for i in range(26)]
    text = lambda own: " ".join("".join(r.choice(own) for _ in range(r.randint(2, 6))) for _ in range(40))
    rows = [(i, text(letters[:14] if i % 2 else letters[12:]), "xa" if i % 2 else "xb", "s", 0) for i in range(300)]
    docs = spark.createDataFrame(rows, DOCS)
    found = langid.identify(docs, langid.fit(docs)).collect()
    assert all(x.language == x.declared for x in found) and np.mean([x.keep for x in found]) > 0.98


def test_profiles_are_fitted_on_the_languages_of_most_documents(spark):
    rows = [(i, "words of a text", f"l{i % 5}" if i < 50 else f"dirt{i}", "s", 0) for i in range(80)]
    assert langid.fit(spark.createDataFrame(rows, DOCS), languages=5).languages == [f"l{i}" for i in range(5)]


def test_language_odd_rows(spark, odd_docs, no_docs):
    profiles = langid.fit(spark.createDataFrame(language_rows(3, 60), DOCS))
    rows = langid.identify(odd_docs, profiles).collect()
    assert len(rows) == odd_docs.count()
    assert {(x.doc_id, x.language, x.keep, x.distance) for x in rows if x.doc_id in (2, 3, 4, 7)} == {(i, None, False, 1.0) for i in (2, 3, 4, 7)}
    assert langid.identify(no_docs, profiles).count() == 0 and langid.fit(no_docs).languages == []
    kept = langid.keep_identified(odd_docs)
    assert kept.columns == odd_docs.columns and {x.doc_id for x in kept.collect()} >= {1, 5} and not {x.doc_id for x in kept.collect()} & {2, 3, 4, 7}
    assert langid.keep_identified(no_docs).count() == 0


def quality_rows(seed: int, n: int) -> list[tuple]:
    r = random.Random(seed)
    rows = []
    for i in range(n):
        good = int(i % 3 > 0)
        lines = [prose(r, r.randint(6, 20)).capitalize() + "." for _ in range(r.randint(2, 8))]
        if not good:
            lines = [r.choice([x.upper() + "!!", " | ".join(x.split()), " ".join(w + "###" for w in x.split()), (x.split()[0] + " ") * 15]) for x in lines]
        rows.append((i, "\n".join(lines), "en", f"s{i % 5}", 0, good))
    return rows


def test_factorisation_machine_on_held_out_documents(spark):
    docs, labels = with_labels(spark, quality_rows(1, 500), "quality")
    model = fm.fit(docs, labels)
    rows = quality_rows(2, 300)
    kept = {x.doc_id: x.keep for x in fm.score(with_labels(spark, rows, "quality")[0], model).collect()}
    assert np.mean([kept[x[0]] for x in rows if x[5]]) > 0.97 and np.mean([kept[x[0]] for x in rows if not x[5]]) < 0.05


def test_factorisation_identity_matches_all_pairs():
    r = np.random.default_rng(0)
    model = fm.Model(r.normal(size=fm.SIZE).astype(np.float32), r.normal(size=(fm.SIZE, fm.FACTORS)).astype(np.float32) * 0.2)
    offsets, numbers, values = fm.features(pa.array(["some words in a text", "", None, "Other words: 12 | 3\nand lines"]), pa.array(["s", None, "t", "s"]), pa.array(["en", "en", None, "xx"]))
    found = model.score(offsets, numbers, values)
    for i in range(4):
        n, x = numbers[offsets[i] : offsets[i + 1]], values[offsets[i] : offsets[i + 1]].astype(float)
        raw = (model.weights[n] * x).sum() + sum(float(model.factors[n[a]] @ model.factors[n[b]]) * x[a] * x[b] for a, b in itertools.combinations(range(len(n)), 2))
        assert abs(found[i] - 1 / (1 + math.exp(-raw))) < 1e-3


def test_factorisation_odd_rows(spark, odd_docs, no_docs):
    docs, labels = with_labels(spark, quality_rows(1, 200), "quality")
    model = fm.fit(docs, labels)
    rows = fm.score(odd_docs, model).collect()
    assert len(rows) == odd_docs.count() and {(x.quality, x.keep) for x in rows if x.doc_id in (2, 3)} == {(0.0, False)}
    assert fm.score(no_docs, model).count() == 0
    assert fm.fit(no_docs, spark.createDataFrame([], "doc_id long, quality int")) is None
    assert {(x.doc_id, x.quality, x.keep) for x in fm.score(odd_docs, None).collect() if x.doc_id in (1, 2)} == {(1, None, True), (2, None, False)}


def test_line_labels_on_held_out_documents(spark):
    docs, labels = with_labels(spark, quality_rows(1, 400), "quality")
    model = crf_lines.fit(docs, labels)
    r, mixed, truth = random.Random(8), [], []
    good, bad = [[line for x in quality_rows(9, 300) if x[5] == q for line in x[1].split("\n")] for q in (1, 0)]
    for i in range(60):
        own = [(r.choice(good), "C") for _ in range(r.randint(3, 6))] + [(r.choice(bad), "B") for _ in range(r.randint(3, 6))]
        mixed.append((i, "\n\n".join(t for t, _ in own), "en", "s", 0))
        truth.append("".join(m for _, m in own))
    found = {x.doc_id: x for x in crf_lines.label(spark.createDataFrame(mixed, DOCS), model).collect()}
    assert np.mean([a == b for i, t in enumerate(truth) for a, b in zip(found[i].marks, t, strict=True)]) > 0.95
    for i, (_, text, *_) in enumerate(mixed):
        sizes = [len(x.strip()) for x in text.split("\n") if x.strip()]
        share = sum(n for n, m in zip(sizes, found[i].marks, strict=True) if m == "C") / sum(sizes)
        assert abs(found[i].content_share - share) < 1e-9 and found[i].keep == (share >= crf_lines.SHARE)


def test_line_labels_on_held_out_spliced_documents():
    """Half of the labelled documents train; of the other half, good and bad ones are spliced, so that chains change label."""
    rows = duckdb.sql("select d.doc_id, d.text, l.quality from '/root/testdata/sf0.1/documents.parquet' d join (select doc_id, max(quality) as quality from '/root/testdata/sf0.1/labels.parquet' group by doc_id) l using (doc_id) where l.quality is not null and d.text is not null").fetchall()
    rows.sort(key=lambda x: x[0] * 2654435761 % 2**32)
    model = crf_lines.fit_sample(pa.array([x[1] for x in rows[::2]]), np.array([x[2] for x in rows[::2]]))
    assert model.move[0, 0] > model.move[0, 1] and model.move[1, 1] > model.move[1, 0]
    r, texts, truth = random.Random(1), [], []
    good, bad = ([[y.strip() for y in x[1].split("\n") if y.strip()] for x in rows[1::2] if x[2] == q] for q in (1, 0))
    for _ in range(400):
        g, b = [(x, "C") for x in r.choice(good)], [(x, "B") for x in r.choice(bad)]
        own = r.choice([g + b, b + g, b[: 1 + len(b) // 2] + g + b[1 + len(b) // 2 :], g[: 1 + len(g) // 2] + b + g[1 + len(g) // 2 :]])
        texts.append("\n".join(x for x, _ in own))
        truth += [m for _, m in own]
    offsets, labels, _ = crf_lines.marks(pa.array(texts), model)
    right = np.array([m == "C" for m in truth]) == (labels == crf_lines.CONTENT)
    assert right.mean() > 0.93
    assert np.mean([0 < labels[a:b].mean() < 1 for a, b in itertools.pairwise(offsets)]) > 0.9


def test_spliced_chains_hold_lines_and_labels():
    texts = pa.array(["a\nb\nc", "X", None, "d", "Y\nZ", "\n \n"])
    offsets, flat = crf_lines.lines(texts)
    ends, own, labels = crf_lines.spliced(flat, offsets, np.array([1, 0, 1, 1, 0, 0]))
    assert ends[0] == 0 and ends[-1] == len(own) == len(labels) and (np.diff(ends) > 0).all()
    assert all((flat[int(i)].as_py() in "abcd") == (c == 1) for i, c in zip(own, labels, strict=True))
    assert all(len(set(labels[a:b].tolist())) == 2 for a, b in itertools.pairwise(ends))


def test_viterbi_matches_all_paths():
    r = np.random.default_rng(3)
    for _ in range(20):
        sizes = r.integers(0, 8, 6)
        offsets = np.concatenate([[0], np.cumsum(sizes)])
        model = crf_lines.Model(np.zeros((1, 2)), r.normal(size=(2, 2)), r.normal(size=2))
        scores = r.normal(size=(offsets[-1], 2))
        found = crf_lines.viterbi(scores, offsets, model)
        for i, n in enumerate(sizes):
            own = scores[offsets[i] : offsets[i + 1]]
            value = lambda path, own=own: model.start[path[0]] + sum(own[t, k] for t, k in enumerate(path)) + sum(model.move[a, b] for a, b in itertools.pairwise(path))  # noqa: B023, E731
            if n:
                assert tuple(found[offsets[i] : offsets[i + 1]]) == max(itertools.product((0, 1), repeat=int(n)), key=value)


def test_training_gradient_is_of_the_likelihood():
    """After training on separable chains the likelihood beats that of no weights."""
    r = np.random.default_rng(4)
    y = np.repeat(r.integers(0, 2, 60), 5)
    x = np.stack([np.ones(len(y)), y + r.normal(0, 0.3, len(y)), r.normal(size=len(y))], 1).astype(np.float32)
    model = crf_lines.train(x, np.arange(0, len(y) + 1, 5), y)
    assert (crf_lines.viterbi(x @ model.emit, np.arange(0, len(y) + 1, 5), model) == y).mean() > 0.98


def test_line_labels_odd_rows(spark, odd_docs, no_docs):
    docs, labels = with_labels(spark, quality_rows(1, 200), "quality")
    model = crf_lines.fit(docs, labels)
    rows = crf_lines.label(odd_docs, model).collect()
    assert len(rows) == odd_docs.count()
    assert {(x.doc_id, x.marks, x.n_lines, x.content_share, x.keep) for x in rows if x.doc_id in (2, 3, 4)} == {(i, "", 0, 0.0, False) for i in (2, 3, 4)}
    assert crf_lines.label(no_docs, model).count() == 0
    assert crf_lines.fit(no_docs, spark.createDataFrame([], "doc_id long, quality int")) is None
    assert all(set(x.marks) <= {"C"} for x in crf_lines.label(odd_docs, None).collect())


def test_conflicting_and_null_labels(spark):
    docs, _ = with_labels(spark, quality_rows(1, 60), "quality")
    labels = spark.createDataFrame([(1, 1), (1, 0), (2, None), (None, 1), (3, 0), (4, 7)], "doc_id long, quality int")
    from siteloom.llm.common import labelled_sample

    assert sorted((x.doc_id, x.y) for x in labelled_sample(docs, labels, "quality", 10).collect()) == [(1, 1), (3, 0)]
    assert isinstance(labelled_sample(docs, labels, "quality", 1).toPandas(), pd.DataFrame)
