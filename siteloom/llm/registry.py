"""The operators' queries by name, each over its whole table with production parameters."""

from __future__ import annotations

from collections.abc import Iterator
from pathlib import Path

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from siteloom.llm import bpe, crf_lines, fm, langid, quotes, raking, rans, simhash, tiff, tiff_write, toxicity
from siteloom.llm.arrays import binary_array
from siteloom.llm.common import checkpoint, slices, table


def op1_tiff_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pages of every document's image; the images are written from the documents, which hold the table's only media."""
    return tiff.decode(tiff_write.images(table(spark, sf_dir, "documents")))


def op2_crf_line_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Line labels and retention of every document, the field fitted on its quality labels."""
    docs = table(spark, sf_dir, "documents")
    return crf_lines.label(docs, crf_lines.fit(docs, table(spark, sf_dir, "labels")))


def op3_simhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(doc_id, kept_doc_id) of the documents that near dedup removes."""
    return simhash.near_duplicates(table(spark, sf_dir, "documents"))


def token_ids(docs: DataFrame, path: str = bpe.VOCABULARY) -> DataFrame:
    """(doc_id, ids) of the documents, ids as little-endian uint32; the vocabulary's bytes are broadcast.

    A null text has null ids, an empty one none; a text of any length is encoded whole. Repeated rows give repeated rows, an empty table none; other columns are not read.
    """
    shared = docs.sparkSession.sparkContext.broadcast(Path(path).read_bytes())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = bpe.counter(shared.value)
        for batch in batches:
            for part in slices(batch):
                rows = [None if t is None else own.encode_to_numpy(t, disallowed_special=()) for t in part.column(1).to_pylist()]
                sizes = np.array([0 if r is None else len(r) for r in rows], np.int64)
                flat = np.concatenate([r for r in rows if r is not None] or [np.zeros(0, np.uint32)]).astype("<u4")
                ids = binary_array(flat.view(np.uint8), np.concatenate([[0], np.cumsum(sizes)]) * 4)
                if part.column(1).null_count:
                    ids = pa.array([None if r is None else x for r, x in zip(rows, ids.to_pylist(), strict=True)], pa.binary())
                yield pa.RecordBatch.from_arrays([part.column(0), ids], ["doc_id", "ids"])

    return docs.selectExpr("cast(doc_id as long) doc_id", "text").mapInArrow(run, "doc_id long, ids binary")


def op4_rans_token_blocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Blocks of the documents' token ids, each decoded again (exact)."""
    ids = checkpoint(token_ids(table(spark, sf_dir, "documents")))
    return rans.encode_rows(ids, rans.frequencies(ids), verify=True)


def op5_quote_linking(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Conversations rebuilt from mail that quotes its predecessors, written from all turns; -1 is the parent of a first message."""
    return quotes.conversations(quotes.as_mail(table(spark, sf_dir, "conversations"))).fillna(-1, ["parent_id"])


def op6_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Token ids of every document, and whether decoding gives its text again."""
    return bpe.tokenize(table(spark, sf_dir, "documents"))


def op7_fm_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Quality of every document, the machine fitted on its labels."""
    docs = table(spark, sf_dir, "documents")
    return fm.score(docs, fm.fit(docs, table(spark, sf_dir, "labels")))


def op8_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Language of every document, profiles fitted on its declared ones."""
    docs = table(spark, sf_dir, "documents")
    return langid.identify(docs, langid.fit(docs))


def op9_raked_mixture(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The sampled documents, their tokens and topics, and the probabilities they were drawn at."""
    return raking.sample(table(spark, sf_dir, "documents"))


def op10_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Toxicity of every document, models fitted on its labels."""
    docs = table(spark, sf_dir, "documents")
    return toxicity.score(docs, toxicity.fit(docs, table(spark, sf_dir, "labels")))


def queries() -> dict:
    return {f.__name__: f for f in (op1_tiff_pages, op2_crf_line_labels, op3_simhash_near_dedup, op4_rans_token_blocks, op5_quote_linking, op6_byte_bpe, op7_fm_quality, op8_language_id, op9_raked_mixture, op10_toxicity)}


#: The mail of op5 need not be written out in SQL: a message's lines are its turn's own at level 0 and its predecessors' at levels 1 to 3. It holds where no turn quotes by itself.
QUOTES_SQL = r"""
WITH RECURSIVE turns AS (SELECT CAST(conv_id AS BIGINT) * 4294967296 + turn AS id, role, text, lag(text, 1) OVER w AS p1, lag(text, 2) OVER w AS p2, lag(text, 3) OVER w AS p3 FROM conversations WINDOW w AS (PARTITION BY conv_id ORDER BY turn)),
parts AS (SELECT id, 0 AS level, text AS part FROM turns UNION ALL SELECT id, 1, p1 FROM turns UNION ALL SELECT id, 2, p2 FROM turns UNION ALL SELECT id, 3, p3 FROM turns),
split AS (SELECT id, level, string_split_regex(part, '\r\n|\n|\r') AS lines FROM parts WHERE part IS NOT NULL),
numbered AS (SELECT id, level, unnest(lines) AS line, unnest(range(len(lines))) AS spot FROM split),
lines AS (SELECT * FROM (SELECT id, level, spot, trim(regexp_replace(lower(line), '[^\p{L}\p{N}]+', ' ', 'g')) AS norm FROM numbered) WHERE length(norm) >= 8),
owners AS (SELECT *, last_value(CASE WHEN level = 0 THEN id END IGNORE NULLS) OVER (PARTITION BY norm ORDER BY id, level = 0, level, spot ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS original FROM lines),
found AS (SELECT * FROM owners WHERE level > 0 AND original IS NOT NULL AND original <> id),
votes AS (SELECT id, original, count(*) AS n FROM found WHERE level = 1 GROUP BY id, original),
parents AS (SELECT id, arg_max(original, {'n': n, 'original': original}) AS parent_id FROM votes GROUP BY id),
tree AS (SELECT t.id, p.parent_id FROM turns t LEFT JOIN parents p USING (id)),
walk AS (SELECT id, id AS root, [id] AS path FROM tree WHERE parent_id IS NULL UNION ALL SELECT t.id, w.root, list_append(w.path, t.id) FROM tree t JOIN walk w ON t.parent_id = w.id)
SELECT w.root AS conversation_id, CAST(row_number() OVER (PARTITION BY w.root ORDER BY w.path) - 1 AS INTEGER) AS turn, w.id AS message_id, COALESCE(tree.parent_id, -1) AS parent_id, CAST(len(w.path) - 1 AS INTEGER) AS depth, t.role, trim(regexp_replace(t.text, '\r\n|\r', chr(10), 'g'), ' ' || chr(9) || chr(10)) AS text,
(SELECT count(*) FROM lines l WHERE l.id = w.id AND l.level > 0) AS n_quoted, (SELECT count(*) FROM found f WHERE f.id = w.id) AS n_linked
FROM walk w JOIN tree USING (id) JOIN turns t USING (id)
"""


def oracle_sql() -> dict:
    return {"op5_quote_linking": QUOTES_SQL}
