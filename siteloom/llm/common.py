"""What the operators share: reliable lineage cuts, bounded slices of Arrow batches, and words as numbers."""

from __future__ import annotations

import ctypes
import pickle
import re
import tempfile
import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from siteloom.llm.arrays import bytes_of, ragged_index

#: Bytes of text that one slice of an Arrow batch holds, unless one row is longer; bounds a worker's memory.
SLICE_BYTES = 4 << 20
#: Bytes of an Arrow batch between the JVM and Python.
BATCH_BYTES = 4 << 20
#: Characters trimmed from both ends of a word.
PUNCTUATION = "!\"#$%&'()*+,-./:;<=>?@[\\]^_`{|}~«»“”‘’„…–—¡¿"


def checkpoint(df: DataFrame) -> DataFrame:
    """Cut the lineage with a reliable checkpoint in the shared folder that ``spark.checkpoint.dir`` names.

    A session in one process, as in tests, may go without that setting and gets a folder of its own; on a cluster it is an error, as executors share no temporary folder.
    """
    context = df.sparkSession.sparkContext
    if context._jsc.sc().getCheckpointDir().isEmpty():
        named = df.sparkSession.conf.get("spark.checkpoint.dir", None)
        if not named and not re.fullmatch(r"local(\[.*\])?", context.master):
            raise RuntimeError("spark.checkpoint.dir must name a folder that all executors share")
        context.setCheckpointDir(named or tempfile.mkdtemp(prefix="siteloom-checkpoint-"))
    return df.checkpoint(eager=True)


def stored(df: DataFrame) -> DataFrame:
    """``df`` written as Parquet in the checkpoint folder and read again, for tables with texts of which what follows reads a few columns, or all of them more than once: a checkpoint is neither compressed nor read by
    columns. ``forget`` deletes it; what is left goes with the session."""
    checkpoint(df.sparkSession.range(0))  # sets the folder where the session has none
    context = df.sparkSession.sparkContext
    path = context._jvm.org.apache.hadoop.fs.Path(context._jsc.sc().getCheckpointDir().get(), f"stored-{uuid.uuid4().hex}")
    path.getFileSystem(context._jsc.hadoopConfiguration()).deleteOnExit(path)
    df.write.parquet(path.toString())
    out = df.sparkSession.read.schema(df.schema).parquet(path.toString())
    out.stored_at = path
    return out


def forget(df: DataFrame) -> None:
    """Delete what ``stored`` wrote; ``df`` and what reads it cannot run any more."""
    path = df.stored_at
    path.getFileSystem(df.sparkSession.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


def bounded(spark: SparkSession) -> None:
    """Lower the session's bound of bytes of an Arrow batch to BATCH_BYTES: batches of the default 10 000 rows hold tens of megabytes of text, in the JVM and in Python, for each task."""
    name = "spark.sql.execution.arrow.maxBytesPerBatch"
    if int(spark.conf.get(name).rstrip("b")) > BATCH_BYTES:
        spark.conf.set(name, BATCH_BYTES)


def tidy() -> None:
    """Give freed memory back to the system: workers live on between stages, and what they keep counts against their executor."""
    pa.default_memory_pool().release_unused()
    if trim := getattr(ctypes.CDLL(None), "malloc_trim", None):
        trim(0)


def slices(batch: pa.RecordBatch, column: str = "text", limit: int = SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    """Zero-copy runs of rows whose ``column`` holds at most ``limit`` bytes; a longer row is a run of its own."""
    if not batch.num_rows:
        return
    sizes = pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False).astype(np.int64)
    total, start = np.cumsum(sizes), 0
    while start < len(sizes):
        before = total[start - 1] if start else 0
        end = max(start + 1, int(np.searchsorted(total, before + limit, side="right")))
        yield batch.slice(start, end - start)
        start = end


def map_slices(df: DataFrame, columns: list[str], fn: Callable[[pa.RecordBatch], pa.RecordBatch | None], schema: str | T.StructType, text: str = "text", limit: int = SLICE_BYTES) -> DataFrame:
    """Only ``columns`` reach Python (the scan is pruned to them), in bounded slices; extra columns cannot clash."""

    bounded(df.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, text, limit):
                if (out := fn(part)) is not None:
                    yield out
            tidy()

    return df.select(*columns).mapInArrow(run, schema)


def filter_slices(df: DataFrame, mask: Callable[[pa.RecordBatch], np.ndarray], text: str = "text", limit: int = SLICE_BYTES) -> DataFrame:
    """Rows where ``mask`` holds, with all columns of ``df`` under their own names, without a shuffle."""

    bounded(df.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, text, limit):
                yield part.filter(pa.array(mask(part)))
            tidy()

    return df.mapInArrow(run, df.schema)


def words(texts: pa.Array, lower: bool = True) -> tuple[np.ndarray, np.ndarray, pa.Array]:
    """Words of each text: row offsets (n + 1), word numbers, and the distinct words they number.

    A word is a run between white space with ``PUNCTUATION`` trimmed; what is empty then is no word. A null text has none.
    """
    texts = pc.fill_null(texts.cast(pa.large_string()), "")
    lists = pc.utf8_split_whitespace(pc.utf8_lower(texts) if lower else texts)
    offsets = lists.offsets.to_numpy().astype(np.int64)
    flat = lists.values.slice(offsets[0], offsets[-1] - offsets[0])
    offsets = offsets - offsets[0]
    coded = flat.dictionary_encode()
    trimmed = pc.utf8_trim(coded.dictionary, characters=PUNCTUATION).dictionary_encode()
    ids = trimmed.indices.to_numpy(zero_copy_only=False)[coded.indices.to_numpy(zero_copy_only=False)] if len(flat) else np.zeros(0, np.int32)
    vocabulary = trimmed.dictionary
    keep = (pc.binary_length(vocabulary).to_numpy(zero_copy_only=False) > 0)[ids] if len(ids) else np.zeros(0, bool)
    if not keep.all():
        offsets = np.concatenate([[0], np.cumsum(keep)])[offsets]
        ids = ids[keep]
    return offsets, ids.astype(np.int64), vocabulary


#: Bytes that surely end or begin a character other than white space; of multi-byte characters those that white space may share are left out.
ENDS, BEGINS = np.zeros(256, bool), np.zeros(256, bool)
ENDS[[*range(0x21, 0x7F), *range(0x8B, 0xC0)]] = BEGINS[[*range(0x21, 0x7F), *range(0xC3, 0xF5)]] = True
ENDS[[0x9F, 0xA0, 0xA8, 0xA9, 0xAF]] = BEGINS[[0xE1, 0xE2, 0xE3]] = False


def segments(texts: pa.Array) -> tuple[np.ndarray, np.ndarray, pa.Array]:
    """Segments of each text: row offsets (n + 1), segment numbers, and the distinct segments they number.

    A text is cut before each single space that surely lies between characters other than white space; its segments in order are the text. Words never cross such a cut, nor do pieces of
    byte-level BPE, so both may be told from the distinct segments alone. A null or empty text has none.
    """
    data, at = bytes_of(texts)
    spaces = np.flatnonzero(data[1:-1] == 32) + 1
    cut = np.zeros(len(data), bool)
    cut[spaces[ENDS[data[spaces - 1]] & BEGINS[data[spaces + 1]]]] = True
    cut[at[:-1][np.diff(at) > 0]] = True
    starts = np.flatnonzero(cut)
    coded = pa.Array.from_buffers(pa.large_binary(), len(starts), [None, pa.py_buffer(np.append(starts, len(data))), pa.py_buffer(data)]).dictionary_encode()
    return np.searchsorted(starts, at), coded.indices.to_numpy(zero_copy_only=False).astype(np.int64), coded.dictionary.cast(pa.large_string())


def segment_words(offsets: np.ndarray, segment: np.ndarray, distinct: pa.Array) -> tuple[np.ndarray, np.ndarray, pa.Array]:
    """``words`` of texts cut by ``segments``."""
    within, ids, vocabulary = words(distinct)
    sizes = np.diff(within)[segment]
    return np.concatenate([[0], np.cumsum(sizes)])[offsets], ids[ragged_index(within[segment], sizes)], vocabulary


def hashes(vocabulary: pa.Array) -> np.ndarray:
    """64-bit hash of each word, the same in every process."""
    if not len(vocabulary):
        return np.zeros(0, np.uint64)
    return pd.util.hash_array(vocabulary.to_numpy(zero_copy_only=False).astype(object), categorize=False)


def mixed(values: np.ndarray, salt: int) -> np.ndarray:
    """splitmix64 finaliser: an independent 64-bit hash for each salt."""
    x = values + np.uint64((salt * 0x9E3779B97F4A7C15 + 0x632BE59BD9B4E019) & (2**64 - 1))
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def row_of(offsets: np.ndarray) -> np.ndarray:
    """The row that each element lies in."""
    return np.repeat(np.arange(len(offsets) - 1), np.diff(offsets))


def segment_sums(values: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Sum of each row's elements along axis 0; 0 for an empty row."""
    out = np.zeros((len(offsets) - 1, *values.shape[1:]), values.dtype)
    full = np.flatnonzero(np.diff(offsets) > 0)
    if len(full):
        out[full] = np.add.reduceat(values, offsets[full], axis=0)
    return out


def labelled_sample(docs: DataFrame, labels: DataFrame, label: str, per_class: int) -> DataFrame:
    """At most ``per_class`` documents of each class 0 and 1 of ``label``, those of the smallest hashed ids, as (doc_id, y, docs' other columns).

    Only ids and classes are ordered (a bounded top-k for each class); texts are read once, behind a broadcast of those ids, whose
    number is bounded by ``2 * per_class``. A document with conflicting labels counts as 1; null ids and labels are left out.
    """
    one = labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col(label).cast("int").alias("y")).where("doc_id is not null and y in (0, 1)").groupBy("doc_id").agg(F.max("y").alias("y"))
    order = F.xxhash64("doc_id")
    chosen = one.where("y = 0").orderBy(order, "doc_id").limit(per_class).unionByName(one.where("y = 1").orderBy(order, "doc_id").limit(per_class))
    others = [c for c in docs.columns if c.lower() not in ("doc_id", "y")]
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), *others).join(F.broadcast(chosen), "doc_id").select("doc_id", "y", *others)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    bounded(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def in_one_task(rows: DataFrame, fn: Callable[[pa.Table], object]) -> object:
    """``fn`` of a bounded sample, run by an executor: only what it returns reaches the driver, whose memory stays small whatever the sample's texts weigh."""
    kind = rows.schema
    bounded(rows.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found = [b for b in batches if b.num_rows]
        if found:
            result = pickle.dumps(fn(pa.Table.from_batches(found)))
            found.clear()
            tidy()
            yield pa.RecordBatch.from_arrays([pa.array([result], pa.binary())], ["result"])

    result = rows.repartition(1).mapInArrow(run, "result binary").first()
    if result is None:
        return fn(pa.Table.from_pylist([], pa.schema([(f.name, pa.int64() if f.name in ("doc_id", "y") else pa.string()) for f in kind])))
    return pickle.loads(result[0])
