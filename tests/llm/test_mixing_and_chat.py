from __future__ import annotations

import random
from pathlib import Path

import numpy as np
import pandas as pd
import pyarrow as pa
import pytest
from llm_data import DOCS, prose

from siteloom.llm import bpe, common, quotes, raking


def naive_rake(cells: pd.DataFrame, share: float) -> pd.Series:
    have, total = cells.have.to_numpy(), cells.have.sum()
    want = have * share
    for _ in range(raking.SWEEPS):
        before = want.copy()
        for margin, power in raking.TEMPER.items():
            sums = cells.groupby(margin).have.sum()
            raw = (sums / total) ** power
            target = raw / raw.sum() * share * total
            now = pd.Series(want).groupby(cells[margin].to_numpy()).sum()
            want = want * (target / now.where(now > 0, 1)).reindex(cells[margin]).to_numpy()
        want = np.minimum(want, have)
        if np.abs(want - before).sum() < raking.TOLERANCE * share * total:
            break
    return pd.Series(want, cells.index)


def test_raking_matches_naive_and_holds_the_margins(spark):
    r = random.Random(1)
    cells = pd.DataFrame([(s, x, t, float(r.randint(50, 2000) * (9 if s == "s0" else 1))) for s in ("s0", "s1", "s2", "s3") for x in ("en", "de", "fr") for t in "0123"], columns=["source", "lang", "topic", "have"])
    found = raking.rake(spark.createDataFrame(cells), 0.4).toPandas().set_index(["source", "lang", "topic"]).want
    expected = naive_rake(cells, 0.4)
    expected.index = pd.MultiIndex.from_frame(cells[["source", "lang", "topic"]])
    assert np.allclose(found.reindex(expected.index), expected, rtol=1e-6)
    for margin, power in raking.TEMPER.items():
        raw = (cells.groupby(margin).have.sum() / cells.have.sum()) ** power
        target = raw / raw.sum() * 0.4 * cells.have.sum()
        assert np.allclose(found.groupby(margin).sum(), target, rtol=0.01)


def test_a_cell_never_takes_more_than_it_has(spark):
    cells = pd.DataFrame([("a", "x", "0", 1000.0), ("b", "x", "0", 1.0), ("b", "y", "1", 2.0), ("c", "y", "0", 0.0)], columns=["source", "lang", "topic", "have"])
    found = raking.rake(spark.createDataFrame(cells), 0.9).toPandas()
    assert (found.want <= found.have + 1e-9).all() and (found.want >= 0).all()
    assert raking.probabilities(raking.rake(spark.createDataFrame(cells), 0.9), 0.9).where("source = 'c'").first().probability == 0.9


def test_sampling_is_calibrated(spark):
    r = random.Random(2)
    rows = [(i, prose(r, r.randint(5, 40)), r.choice(["en", "en", "en", "de"]), r.choice(["a", "a", "a", "b", "c"]), 0) for i in range(6000)]
    docs = spark.createDataFrame(rows, DOCS).repartition(4)
    model = raking.fit_topics(docs)
    measured = raking.measured(docs, model).toPandas().set_index("doc_id")
    n = {x.doc_id: x.n_tokens for x in bpe.tokenize(docs).collect()}
    assert (measured.tokens.sort_index() == pd.Series(n).sort_index()).all()
    cells = measured.reset_index().groupby(["source", "lang", "topic"], as_index=False).tokens.sum().rename(columns={"tokens": "have"})
    cells["want"] = naive_rake(cells, raking.SHARE)
    found = raking.sample(docs).toPandas()
    assert (found.tokens == found.doc_id.map(n)).all()
    p = found.merge(cells, on=["source", "lang", "topic"])
    assert len(p) == len(found) and np.allclose(p.probability, p.want / p.have, rtol=1e-3)
    for margin in ("source", "lang", "topic"):
        assert np.allclose(found.groupby(margin).tokens.sum(), cells.groupby(margin).want.sum(), rtol=0.15)
    held = raking.reached(cells)
    assert np.allclose(held.want, held.target, rtol=0.02) and abs(held.target.sum() / 3 / cells.have.sum() - raking.SHARE) < 1e-9
    assert {x.doc_id for x in raking.mix(docs).collect()} == set(found.doc_id)


def test_topics_follow_vocabularies_within_languages(spark):
    """Each language has its own words and, in its own words too, the same three subjects; a topic is a subject of a language, never a language."""
    r = random.Random(4)
    words = {(x, k): [prose(r, 1) + "xyz"[k] * 3 + x for _ in range(30)] for x in ("en", "de") for k in range(-1, 3)}
    rows = []
    for i in range(900):
        x, k = r.choice(["en", "de"]), r.randrange(3)
        rows.append((i, " ".join(r.choice(words[x, -1] if r.random() < 0.6 else words[x, k]) for _ in range(60)), x, f"subject{k}", 0))
    docs = spark.createDataFrame(rows, DOCS)
    found = raking.measured(docs, raking.fit_topics(docs)).toPandas()
    kinds = found.groupby("topic").apply(lambda t: (t.groupby(["lang", "source"]).size().max() / len(t)), include_groups=False)
    assert (kinds * found.groupby("topic").size()).sum() / len(found) > 0.95
    assert found.groupby(["lang", "source"]).topic.agg(lambda t: t.value_counts(normalize=True).iloc[0]).min() > 0.4
    empty = raking.fitted_topics(pa.array([], pa.large_string()), [])
    assert empty.of(pa.array(["some words here", None, ""], pa.string()), pa.array(["en", None, "en"], pa.string())).tolist() == [0, 0, 0]


def test_mixing_odd_rows(spark, odd_docs, no_docs):
    rows = raking.mix(odd_docs)
    assert rows.columns == odd_docs.columns
    kept = [x.doc_id for x in rows.collect()]
    assert kept.count(1) in (0, 2)  # rows of one id share a fate
    assert raking.sample(odd_docs).columns == ["doc_id", "source", "lang", "topic", "tokens", "probability"]
    assert raking.mix(no_docs).count() == 0 == raking.sample(no_docs).count()


def test_topics_come_from_all_documents(spark):
    """The model is that of all texts held in one place, whatever the partitions; its words are weighted by all documents, and its centres are those of the documents nearest to them."""
    r = random.Random(10)
    words = {(x, k): [prose(r, 1) + "xyz"[k] * 3 + x for _ in range(30)] for x in ("en", "de") for k in range(-1, 3)}
    rows = []
    for i in range(3500):
        x, k = r.choice(["en", "de"]), r.randrange(3)
        rows.append((i, " ".join(r.choice(words[x, -1] if r.random() < 0.6 else words[x, k]) for _ in range(40)), x, "a", 0))
    rows += [(9000, None, "en", "a", 0), (9001, "", None, "a", 0)]
    docs = spark.createDataFrame(rows, DOCS)
    found, expected = raking.fit_topics(docs.repartition(5)), raking.fitted_topics(pa.array([x[1] for x in rows], pa.string()), [x[2] for x in rows])
    assert found.languages == expected.languages and (found.weights == expected.weights).all() and (found.common == expected.common).all()
    counts = np.zeros((3500, raking.WORDS))
    for i, x in enumerate(rows[:3500]):
        offsets, entries = raking.content_counts(*common.words(pa.array([x[1]])))
        counts[i, entries["bucket"]] = entries["n"]
    seen = (counts > 0).sum(0)
    x = counts / counts.sum(1, keepdims=True) * np.where(seen >= raking.FREQUENT, np.log(3501 / (1 + seen)), 0)
    lang = np.array([x[2] for x in rows[:3500]])
    for name in ("en", "de"):
        x[lang == name] -= x[lang == name].mean(0)
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    topic = found.of(pa.array([x[1] for x in rows[:3500]]), pa.array(lang))
    idf = np.log(3501 / (1 + seen))
    for k in np.unique(topic):
        centre = x[topic == k].sum(0)
        own = np.where(seen >= raking.FREQUENT, found.weights[:, k] / np.maximum(idf, 1e-9), 0)
        assert own @ centre / np.linalg.norm(own) / np.linalg.norm(centre) > 0.99


def test_segments_give_words_and_tokens():
    """Of texts with white space and punctuation of all kinds, as whole texts do."""
    r = random.Random(8)
    parts = ["a", "Bc", " ", "  ", "\n", "\t", "'s", "1", "é", "ß", "à", "\u00a0", "\u3000", "\u2009", "\u0085", "日", "!", "😀", "\x00", "\x1c", "\u00c0", "中文", " x", " y,"]
    texts = pa.array(["".join(r.choice(parts) for _ in range(r.randrange(14))) for _ in range(5000)] + [None, prose(r, 3000)])
    raw = Path(bpe.VOCABULARY).read_bytes()
    offsets, segment, distinct = common.segments(texts)
    found = common.segment_sums(bpe.segment_tokens(distinct, raw)[segment], offsets)
    assert found.tolist() == [len(bpe.counter(raw).encode(t, disallowed_special=())) if t else 0 for t in texts.to_pylist()]
    whole, cut = common.words(texts), common.segment_words(offsets, segment, distinct)
    assert (whole[0] == cut[0]).all() and whole[2].take(pa.array(whole[1])).equals(cut[2].take(pa.array(cut[1])))


def test_mixing_does_not_read_texts_again_to_draw(spark):
    r = random.Random(9)
    read = spark.sparkContext.accumulator(0)

    def count(batches):
        for batch in batches:
            read.add(batch.num_rows)
            yield batch

    docs = spark.createDataFrame([(i, prose(r, 20), "en", "a", 0) for i in range(300)], DOCS)
    mixed = raking.mix(docs.mapInArrow(count, docs.schema))
    before = read.value
    assert mixed.count() and read.value == before


def test_topics_are_fitted_on_rows_without_texts(spark, monkeypatch):
    """A checkpoint is read whole, in each pass of the fit."""
    r, fit, seen = random.Random(11), raking.fit_counted, []
    monkeypatch.setattr(raking, "fit_counted", lambda rows, counts: seen.append(rows.columns) or fit(rows, counts))
    docs = spark.createDataFrame([(i, prose(r, 20), "en", "a", 0) for i in range(100)], DOCS)
    assert raking.mix(docs).count() and len(seen) == 1 and "text" not in seen[0]


def test_pipeline_reads_columns_and_leaves_one_stage(spark, monkeypatch):
    import corpus_pipeline

    plans = []

    def stage(session, docs, root):
        plans.append(docs.select("doc_id")._jdf.queryExecution().executedPlan().toString())
        return docs.where(f"doc_id % {len(plans) + 1} > 0")

    monkeypatch.setattr(corpus_pipeline, "STAGES", [(str(k), stage) for k in range(4)])
    root = "/root/testdata/sf0.001"
    expected = spark.read.parquet(f"{root}/documents.parquet").where("doc_id % 2 > 0 and doc_id % 3 > 0 and doc_id % 4 > 0 and doc_id % 5 > 0").count()
    left = lambda: {x.name for x in Path(spark.sparkContext._jsc.sc().getCheckpointDir().get().removeprefix("file:")).glob("stored-*")}
    common.checkpoint(spark.range(1))
    before = left()
    assert corpus_pipeline.run(spark, root).count() == expected > 0
    assert all("ReadSchema: struct<doc_id:bigint>" in x for x in plans) and len(plans) == 4 and len(left() - before) == 1


MAIL = "message_id long, position long, role string, text string"


def find(rows) -> dict:
    return {x.message_id: x for x in rows}


def test_nested_quotes_make_a_thread(spark):
    rows = [
        (1, 1, "a", "First message, about the harbour.\nIt has a second line here."),
        (2, 2, "b", "I disagree with that entirely.\n> First message, about the harbour.\n> It has a second line here."),
        (3, 3, "a", "Why would you disagree?\n> I disagree with that entirely.\n>> First message, about the HARBOUR!\n> > It has a   second line here."),
        (4, 4, "c", "A sibling answer to the first.\n> First message, about the harbour."),
        (5, 5, "d", "Another topic without any quote."),
        (6, 6, "e", "> a line that nobody wrote before\nanswer to nothing known"),
        (7, 7, "f", "> First message, about the harbour."),
    ]
    found = find(quotes.conversations(spark.createDataFrame(rows, MAIL)).collect())
    assert {i: (x.conversation_id, x.turn, x.parent_id, x.depth) for i, x in found.items()} == {
        1: (1, 0, None, 0), 2: (1, 1, 1, 1), 3: (1, 2, 2, 2), 4: (1, 3, 1, 1), 7: (1, 4, 1, 1), 5: (5, 0, None, 0), 6: (6, 0, None, 0),
    }
    assert found[3].text == "Why would you disagree?" and found[7].text == "" and found[6].text == "answer to nothing known"
    assert (found[3].n_quoted, found[3].n_linked) == (3, 3) and (found[6].n_quoted, found[6].n_linked) == (1, 0)


def test_most_lines_decide_and_ties_take_the_later(spark):
    a, b = ["line one of alpha", "line two of alpha"], ["line one of beta"]
    rows = [(1, 1, "x", "\n".join(a)), (2, 2, "x", "\n".join(b)), (3, 3, "x", "\n".join("> " + t for t in [*a, *b])), (4, 4, "x", "\n".join("> " + t for t in [a[0], *b])), (5, 5, "x", "line one of beta"), (6, 6, "x", "> line one of beta")]
    found = find(quotes.conversations(spark.createDataFrame(rows, MAIL)).collect())
    assert (found[3].parent_id, found[4].parent_id, found[6].parent_id) == (1, 2, 5)


def test_rebuilds_conversations_from_mail(spark):
    r = random.Random(3)
    turns = [(c, t, "user" if t % 2 == 0 else "assistant", prose(r, r.randint(3, 30)) + (f"\n{prose(r, 8)}" if t % 3 else "")) for c in range(25) for t in range(r.randint(1, 9))]
    table = spark.createDataFrame(turns, "conv_id long, turn long, role string, text string")
    found = quotes.conversations(quotes.as_mail(table)).collect()
    assert {(x.conversation_id // quotes.TURNS, x.turn, x.role, x.text) for x in found} == {(c, t, role, text) for c, t, role, text in turns}
    assert all(x.depth == x.turn for x in found)


@pytest.mark.parametrize("short", ["Gmail", "Yes.", "はい", "👍", "", None])
def test_short_turns_keep_a_conversation_whole(spark, short):
    """Also where other conversations, interleaved with it, have the same short turn."""
    texts = [["the first words of harbour " + c, "the answer about ships " + c, short, "what follows after that " + c, short, "the last words of all " + c] for c in "ab"]
    mail = quotes.as_mail(spark.createDataFrame([(c, t, "user", x) for c in range(2) for t, x in enumerate(texts[c])], "conv_id long, turn long, role string, text string"))
    mail = mail.withColumn("position", mail.message_id % quotes.TURNS * 2 + (mail.message_id / quotes.TURNS).cast("long"))
    found = quotes.conversations(mail).collect()
    assert {(x.conversation_id // quotes.TURNS, x.turn, x.depth, x.message_id % quotes.TURNS, x.text) for x in found} == {(c, t, t, t, x or "") for c in range(2) for t, x in enumerate(texts[c])}


def test_short_first_turn_and_trimmed_quotes(spark):
    rows = [
        (1, 1, "a", "Gmail"), (2, 2, "b", "Which one of the two?\n> Gmail"),
        (3, 3, "a", "a longer opening of its own"), (4, 4, "b", "Thanks!\nBob\n> a longer opening of its own"), (5, 5, "a", "fine by me\n> Thanks!\n>> a longer opening of its own"),
        (6, 6, "c", "ok\nAnn"), (7, 7, "d", "so be it then\n> ok"),
    ]
    found = find(quotes.conversations(spark.createDataFrame(rows, MAIL)).collect())
    assert {i: x.parent_id for i, x in found.items()} == {1: None, 2: 1, 3: None, 4: 3, 5: 3, 6: None, 7: 6}


def test_long_chains(spark):
    rows = [(i, i, "x", f"message number {i} says this" + (f"\n> message number {i - 1} says this" if i else "")) for i in range(300)]
    found = quotes.conversations(spark.createDataFrame(rows, MAIL)).collect()
    assert {(x.conversation_id, x.message_id, x.turn) for x in found} == {(0, i, i) for i in range(300)}


def test_shared_lines_link_to_the_last_before(spark):
    """Thousands of rows of one line cost a window, and each quote finds the last owner before it."""
    rows = [(i, i, "x", "the very same greeting" if i % 2 == 0 else "> the very same greeting\nok") for i in range(2000)]
    found = find(quotes.conversations(spark.createDataFrame(rows, MAIL)).collect())
    assert all(found[i].parent_id == i - 1 for i in range(1, 2000, 2)) and all(found[i].parent_id is None for i in range(0, 2000, 2))


def test_lines_spread_over_ranges_find_the_last_owner(spark):
    """A few hot lines, more rows each than a range holds, against all rows before; ranges without an owner too."""
    r = random.Random(6)
    rows = []
    for i in range(3000):
        h = r.choice([5, 5, 5, 5, 9, 9, 11, r.randrange(1000)])
        rows.append((i, i // 3, 0 if r.random() < (0.002 if h == 5 else 0.3) else r.choice([1, 2]), h, h, 0))
    found = {x.message_id: x.original_id for x in quotes.originals(spark.createDataFrame(rows, "message_id long, position long, level int, hash long, hash2 long, at int").repartition(7)).collect()}
    owner, expected = {}, {}
    for i, _, level, h, _, _ in rows:
        if level == 0:
            owner[h] = i
        elif h in owner:
            expected[i] = owner[h]
    assert found == expected


def test_quotes_odd_rows(spark):
    rows = [(1, 1, "x", "some original words"), (1, 1, "x", "some original words"), (2, None, None, None), (3, 3, "x", ""), (None, 4, "x", "> some original words"), (5, 5, "x", ">>>>\n> \n" + "> some original words\n" * 3000), (6, 0, "x", "> some original words")]
    table = spark.createDataFrame([(*x, 1, "k") for x in rows], MAIL + ", depth int, own string")
    found = find(quotes.conversations(table).collect())
    assert found.keys() == {1, 2, 3, 5, 6} and found[5].parent_id == 1 and found[5].n_linked == 3000
    assert found[6].parent_id is None and found[2].text == "" == found[3].text
    assert quotes.conversations(table.limit(0)).count() == 0


def test_pipeline_stages(spark, tmp_path):
    import corpus_pipeline
    from siteloom.llm import bpe, langid, simhash, toxicity

    root = "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{root}/documents.parquet")
    labels = spark.read.parquet(f"{root}/labels.parquet")
    assert [name for name, _ in corpus_pipeline.STAGES] == ["toxicity", "language_id", "near_duplicates", "mixing", "byte_bpe"]
    ids = lambda df: {x.doc_id for x in df.select("doc_id").collect()}
    expected = ids(docs) - ids(toxicity.score(docs, toxicity.fit(docs, labels)).where("toxic"))
    for k, (name, stage) in enumerate(corpus_pipeline.STAGES):
        out = stage(spark, docs, root)
        if k < 4:
            assert out.columns == docs.columns
        out.write.parquet(str(tmp_path / name))
        out = spark.read.parquet(str(tmp_path / name))
        if name == "language_id":
            expected &= ids(langid.identify(docs, langid.fit(docs)).where("keep"))
        elif name == "near_duplicates":
            expected -= ids(simhash.near_duplicates(docs))
        elif name == "mixing":
            expected = ids(raking.sample(docs))
        assert ids(out) == expected and expected
        if name == "byte_bpe":
            assert out.where("not exact").count() == 0
            back = {x.doc_id: x.text for x in bpe.detokenize(out).collect()}
            assert back == {x.doc_id: x.text for x in docs.collect()}
        docs = out
    assert ids(corpus_pipeline.run(spark, root)) == expected


@pytest.mark.parametrize("stage", range(5))
def test_pipeline_odd_rows(spark, odd_docs, no_docs, stage):
    import corpus_pipeline

    run = corpus_pipeline.STAGES[stage][1]
    for docs in (odd_docs, no_docs):
        out = run(spark, docs, "/root/testdata/sf0.001")
        assert out.count() <= docs.count() and (stage == 4 or out.columns == docs.columns)
