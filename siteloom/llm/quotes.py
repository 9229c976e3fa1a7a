"""Quotation linking: from quoting messages to reply-ordered conversations without quotes.

A line that starts with ``>`` marks is quoted, one level deep for each mark. Quoted and own lines are normalised (lower case, letters and digits, single spaces)
and hashed. A quoted line belongs to the last message before that has the same line as its own; a message replies to the one that most of its level-1 lines
belong to (the later of equals). A short line says too little to vote among those; a reply none of whose level-1 lines votes is linked by its whole quotation, by deeper levels, or by its short
lines (``passages``). Replies form trees, whose roots name conversations; replies are read depth first, siblings by position.

Scale: texts are parsed where they lie and moved once, at the end; what links them is 20 bytes a line. Lines meet sorted by hash and position in ranges of even size, and the last owner of a range's
last line is carried into the next, so a line that a whole corpus shares is spread over as many tasks as it needs and costs its rows, not their pairs. Chains of replies
are followed by pointer doubling, in as many rounds as the logarithm of the longest chain.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from siteloom.llm.common import checkpoint

#: Characters of a normalised line that links by itself at least; shorter ones link as parts of a passage, or where nothing else does.
LEAST = 8
_MARKS = r"^((?:[ \t]*>)*)"


def normalised(line: Column) -> Column:
    return F.trim(F.regexp_replace(F.lower(line), r"[^\p{L}\p{N}]+", " "))


def parse(messages: DataFrame) -> DataFrame:
    """(message_id, position, role, own, mark, kinds, hash, hash2): own text without quoted lines, a hash of the whole text, and all lines with a letter or digit as three arrays.

    A kind is twice the line's level, and 1 more where it is long enough to link by itself. Map-only.
    """
    lines = F.split(F.coalesce(F.col("text").cast("string"), F.lit("")), "\r\n|\n|\r")
    split = F.transform(lines, lambda line: F.struct(F.length(F.regexp_replace(F.regexp_extract(line, _MARKS, 1), r"[ \t]", "")).alias("level"), F.regexp_replace(line, _MARKS + "[ \t]?", "").alias("body"), line.alias("line")))
    rows = messages.select(F.col("message_id").cast("long").alias("message_id"), F.col("position").cast("long").alias("position"), F.col("role").cast("string").alias("role"), F.xxhash64("text").alias("mark"), split.alias("lines"))
    own = F.filter("lines", lambda x: x["level"] == 0)
    normal = F.filter(F.transform("lines", lambda x: F.struct(x["level"].alias("level"), normalised(x["body"]).alias("norm"))), lambda x: F.length(x["norm"]) > 0)
    rows = rows.select("message_id", "position", "role", "mark", F.trim(F.array_join(F.transform(own, lambda x: x["line"]), "\n"), F.lit(" \t\n")).alias("own"), normal.alias("lines"))
    kinds = F.transform("lines", lambda x: x["level"] * 2 + (F.length(x["norm"]) >= LEAST).cast("int"))
    return rows.select("message_id", "position", "role", "own", "mark", kinds.alias("kinds"), F.transform("lines", lambda x: F.xxhash64(x["norm"])).alias("hash"), F.transform("lines", lambda x: F.xxhash64(x["norm"], F.lit(1))).alias("hash2"))


def each_line(parsed: DataFrame) -> DataFrame:
    """(message_id, position, level, long, hash, hash2, at) of each line."""
    rows = parsed.select("message_id", "position", F.posexplode(F.arrays_zip("kinds", "hash", "hash2")).alias("at", "x"))
    return rows.select("message_id", "position", F.shiftright("x.kinds", 1).alias("level"), (F.col("x.kinds") % 2 == 1).alias("long"), "x.hash", "x.hash2", "at")


def links(parsed: DataFrame) -> DataFrame:
    """(message_id, level, at, original_id, original_position) of each long quoted line that an earlier message has as its own."""
    return originals(each_line(parsed).where("long").drop("long"))


FILLED = "message_id long, level int, at int, original_id long, original_position long, kind int, part int, hash long, hash2 long"
_FOUND, _OPEN, _TAIL = range(3)


def filled(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of a range of sorted lines: each quoted line with the last own line of its hash before it (_FOUND), those of the first hash that may have one in an earlier range (_OPEN), and the last owner of the
    last hash (_TAIL; without an original where the range has none, and then marked by level 1 where the whole range is of that hash)."""
    part = TaskContext.get().partitionId()
    first = last = None  # the hashes of the range's first and of the last row so far
    owner = None  # (message, position) of the last own line of ``last``
    names = [x.split()[0] for x in FILLED.split(", ")]
    for batch in batches:
        if not batch.num_rows:
            continue
        h, h2, position, message, own, at, level = (batch.column(c).to_numpy(zero_copy_only=False) for c in ("hash", "hash2", "position", "message_id", "own", "at", "level"))
        n = len(h)
        if first is None:
            first = (h[0], h2[0])
        begins = np.append(True, (h[1:] != h[:-1]) | (h2[1:] != h2[:-1]))
        if last == (h[0], h2[0]):
            begins[0] = False
        start = np.maximum.accumulate(np.where(begins, np.arange(n), -1))  # -1: of the hash that the batch before ended with
        where = np.maximum.accumulate(np.where(own, np.arange(n), -1))
        before = np.append(-1, where[:-1])  # the last own line before each row
        inside = (before >= 0) & (before >= start)
        carried = ~inside & (start < 0) & (owner is not None)
        o_id = np.where(inside, message[np.maximum(before, 0)], owner[0] if owner else 0)
        o_position = np.where(inside, position[np.maximum(before, 0)], owner[1] if owner else 0)
        got = ~own & (inside | carried) & (o_id != message)
        lost = ~own & ~(inside | carried) & (h == first[0]) & (h2 == first[1])
        rows = np.flatnonzero(got | lost)
        if len(rows):
            is_open = lost[rows]
            yield pa.RecordBatch.from_arrays([pa.array(message[rows]), pa.array(level[rows].astype(np.int32)), pa.array(at[rows].astype(np.int32)), pa.array(o_id[rows].astype(np.int64), mask=is_open), pa.array(o_position[rows].astype(np.int64), mask=is_open), pa.array(np.where(is_open, _OPEN, _FOUND).astype(np.int32)), pa.array(np.full(len(rows), part, np.int32)), pa.array(h[rows]), pa.array(h2[rows])], names)
        last = (h[-1], h2[-1])
        if where[-1] >= 0 and where[-1] >= start[-1]:
            owner = (int(message[where[-1]]), int(position[where[-1]]))
        elif start[-1] >= 0:
            owner = None
    if last is not None:
        yield pa.RecordBatch.from_pylist([{"message_id": 0, "level": int(first == last), "at": 0, "original_id": owner and owner[0], "original_position": owner and owner[1], "kind": _TAIL, "part": part, "hash": int(last[0]), "hash2": int(last[1])}], pa.schema([(x.split()[0], pa.int64() if x.endswith("long") else pa.int32()) for x in FILLED.split(", ")]))


def originals(lines: DataFrame) -> DataFrame:
    """Links of lines or passages (message_id, position, level, hash, hash2, at): the last message before that has the same at level 0.

    The lines are sorted into as many ranges as a shuffle has partitions; of each range one row, its last owner, reaches the driver.
    """
    spark = lines.sparkSession
    order = ["hash", "hash2", "position", "message_id", "own", "at"]
    ranges = lines.withColumn("own", F.col("level") == 0).repartitionByRange(int(spark.conf.get("spark.sql.shuffle.partitions")), *order).sortWithinPartitions(*order)
    rows = checkpoint(ranges.mapInArrow(filled, FILLED))
    carry, now = [], None  # now: (hash, hash2, owner)
    for t in sorted(rows.where(F.col("kind") == _TAIL).collect(), key=lambda x: x.part):
        key, owner = (t.hash, t.hash2), (t.original_id, t.original_position)
        if now is not None:
            carry.append((t.part, *now[0], *now[1]))
        if t.original_id is not None:
            now = (key, owner)
        elif now is not None and (now[0] != key or not t.level):
            now = None  # the range's last hash begins in it, or is another
    found = rows.where(F.col("kind") == _FOUND).select("message_id", "level", "at", "original_id", "original_position")
    if not carry:
        return found
    owners = spark.createDataFrame(carry, "part int, hash long, hash2 long, original_id long, original_position long")
    late = rows.where(F.col("kind") == _OPEN).drop("original_id", "original_position").join(F.broadcast(owners), ["part", "hash", "hash2"]).where("original_id != message_id")
    return found.unionByName(late.select("message_id", "level", "at", "original_id", "original_position"))


def parents(found: DataFrame) -> DataFrame:
    """(message_id, parent_id): the original of most level-1 lines, of equals the later."""
    votes = found.where("level = 1").repartition("message_id").groupBy("message_id", "original_id", "original_position").agg(F.count("*").alias("n"))
    return votes.groupBy("message_id").agg(F.max_by("original_id", F.struct("n", "original_position", "original_id")).alias("parent_id"))


def passages(parsed: DataFrame, found: DataFrame, replies: DataFrame) -> DataFrame:
    """(message_id, parent_id) of quoting messages that no level-1 line links.

    The parent is the last message before whose text is the whole quotation, one mark less on each line: quotations may end at any level, so a text counts up to each of its levels. An empty turn is
    found so by what it quotes, and one of many equal short turns by its context. Where no text matches, the nearest deeper level that links decides by its lines, then short level-1 lines do.
    """
    lost = checkpoint(parsed.where(F.exists("kinds", lambda k: k > 1)).select("message_id").join(replies, "message_id", "left_anti"))
    if lost.isEmpty():
        return replies.limit(0)
    zipped = parsed.select("message_id", "position", F.transform(F.arrays_zip("kinds", "hash", "hash2"), lambda x: F.struct(F.shiftright(x["kinds"], 1).alias("level"), x["hash"].alias("hash"), x["hash2"].alias("hash2"))).alias("lines"))

    def key(lines: Column) -> list[Column]:
        return [F.xxhash64(lines).alias("hash"), F.xxhash64(lines, F.lit(1)).alias("hash2")]

    outer = F.transform(F.filter("lines", lambda x: x["level"] > 0), lambda x: F.struct((x["level"] - 1).alias("level"), x["hash"].alias("hash"), x["hash2"].alias("hash2")))
    texts = zipped.select("message_id", "position", F.explode(F.array_distinct(F.transform("lines", lambda x: x["level"]))).alias("to"), "lines")
    texts = texts.select("message_id", "position", F.lit(0).alias("level"), *key(F.filter("lines", lambda x: x["level"] <= F.col("to"))), F.lit(0).alias("at"))
    quoters = zipped.join(lost, "message_id", "left_semi")
    whole = originals(texts.unionByName(quoters.select("message_id", "position", F.lit(1).alias("level"), *key(outer), F.lit(0).alias("at")))).select("message_id", F.col("original_id").alias("whole"))
    deep = found.where("level > 1").join(lost, "message_id", "left_semi").groupBy("message_id", "level", "original_id", "original_position").agg(F.count("*").alias("n"))
    deep = deep.groupBy("message_id").agg(F.max_by("original_id", F.struct(-F.col("level"), "n", "original_position", "original_id")).alias("deep"))
    short = each_line(parsed).where("not long").drop("long")
    lines = parents(originals(short.where("level = 0").unionByName(short.where("level = 1").join(lost, "message_id", "left_semi")))).withColumnRenamed("parent_id", "line")
    every = lost.join(whole, "message_id", "left").join(deep, "message_id", "left").join(lines, "message_id", "left")
    return every.select("message_id", F.coalesce("whole", "deep", "line").alias("parent_id")).where("parent_id is not null")


def roots(parsed: DataFrame, replies: DataFrame) -> DataFrame:
    """(message_id, root_id, parent_id): chains followed by pointer doubling; a parent is always earlier, so that chains end."""
    state = checkpoint(parsed.select("message_id").distinct().join(replies, "message_id", "left").select("message_id", F.coalesce("parent_id", "message_id").alias("root_id"), "parent_id"))
    while True:
        up = state.select(F.col("message_id").alias("root_id"), F.col("root_id").alias("up"))
        following = checkpoint(state.join(up, "root_id").select("message_id", F.col("up").alias("root_id"), "parent_id", (F.col("up") != F.col("root_id")).alias("moved")))
        going = following.where("moved").limit(1).count()
        state = following.drop("moved")
        if not going:
            return state


def ordered(pdf: pd.DataFrame) -> pd.DataFrame:
    """Depth-first order of whole conversations, rows of each together and by position."""
    root, ids, parent = pdf.root_id.tolist(), pdf.message_id.tolist(), pdf.parent_id.tolist()
    row_of, children, out = {x: i for i, x in enumerate(ids)}, [[] for _ in ids], []
    for i, p in enumerate(parent):
        if p == p and p is not None:
            children[row_of[int(p)]].append(i)
    for first, p in enumerate(parent):
        stack, turn = [(first, 0)] if p != p or p is None else [], 0
        while stack:
            row, depth = stack.pop()
            out.append((row, turn, depth))
            turn += 1
            stack += [(r, depth + 1) for r in reversed(children[row])]
    assert len(out) == len(root)
    rows, turns, depths = (list(x) for x in zip(*out, strict=True))
    done = pdf.iloc[rows].copy()
    done["turn"], done["depth"] = turns, depths
    return done[["root_id", "turn", "message_id", "parent_id", "depth", "n_quoted", "n_linked"]]


def in_order(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Batches sorted by conversation; the last conversation of a batch waits for the next."""
    held: list[pd.DataFrame] = []
    for batch in batches:
        if not len(batch):
            continue
        held.append(batch)
        if batch.root_id.iloc[0] == batch.root_id.iloc[-1] == held[0].root_id.iloc[0]:
            continue
        rows = pd.concat(held, ignore_index=True)
        going = rows.root_id == rows.root_id.iloc[-1]
        held = [rows[going]]
        if not going.all():
            yield ordered(rows[~going])
    if held:
        yield ordered(pd.concat(held, ignore_index=True))


def single(parsed: DataFrame) -> DataFrame:
    """One message of each id: the earliest position, of equals the least hash of the text, then the least role. Repeated ids are found on the id column, and only their rows are shuffled whole."""
    repeated = checkpoint(parsed.groupBy("message_id").count().where("count > 1").select("message_id"))
    if repeated.isEmpty():
        return parsed
    first = F.row_number().over(Window.partitionBy("message_id").orderBy("position", "mark", "role"))
    again = parsed.join(repeated, "message_id", "left_semi").withColumn("place", first).where("place = 1").drop("place")
    return checkpoint(parsed.join(repeated, "message_id", "left_anti").unionByName(again))


def conversations(messages: DataFrame) -> DataFrame:
    """(conversation_id, turn, message_id, parent_id, depth, role, text, n_quoted, n_linked) of messages (message_id, position, role, text).

    text is the message's own part; n_quoted counts its quoted lines that are long enough to link by themselves (LEAST), n_linked those that belong to an earlier message. A null or empty text is empty; a message
    without links starts a conversation. Rows that share a message_id are one message (``single``); a message without id is left out, a null
    position comes first. A line quoted before it was written links nothing. The ids of a conversation, not its texts, are held by one task while it is ordered. An empty table gives no rows; other columns
    are not read.
    """
    known = messages.where("message_id is not null").select("message_id", F.coalesce(F.col("position").cast("long"), F.lit(-(2**62))).alias("position"), "role", "text")
    parsed = single(checkpoint(parse(known)))
    found = checkpoint(links(parsed))
    replies = checkpoint(parents(found))
    tree = roots(parsed, replies.unionByName(passages(parsed, found, replies)))
    counts = found.groupBy("message_id").agg(F.count("*").alias("n_linked"))
    quoted = F.size(F.filter("kinds", lambda k: (k > 1) & (k % 2 == 1))).cast("long")
    rows = parsed.select("message_id", "position", quoted.alias("n_quoted")).join(tree, "message_id").join(counts, "message_id", "left").withColumn("n_linked", F.coalesce("n_linked", F.lit(0)).cast("long"))
    parts = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    order = rows.repartition(parts, "root_id").sortWithinPartitions("root_id", "position", "message_id").mapInPandas(in_order, "root_id long, turn int, message_id long, parent_id long, depth int, n_quoted long, n_linked long")
    out = order.join(parsed.select("message_id", "role", F.col("own").alias("text")), "message_id")
    return out.select(F.col("root_id").alias("conversation_id"), "turn", "message_id", "parent_id", "depth", "role", "text", "n_quoted", "n_linked")


#: Turns that a conversation has at most, as mail.
TURNS = 1 << 32


def as_mail(turns: DataFrame, levels: int = 3) -> DataFrame:
    """Messages as mail programs would write the turns of conversations (conv_id, turn, role, text): each answer above its predecessor's text, quoted, up to ``levels`` deep.

    A message's id and position are conv_id * TURNS + turn. A null text is empty; a null conv_id or turn gives a null id, which ``conversations`` leaves out. Repeated turns quote one another in any order and have
    one id; texts of any length are quoted whole; an empty table gives no rows, and other columns are not read.
    """
    turns = turns.select("conv_id", "turn", "role", F.coalesce("text", F.lit("")).alias("text"))
    key = Window.partitionBy("conv_id").orderBy("turn")
    quoted = [F.concat(F.lit("\n"), F.regexp_replace(F.lag("text", k).over(key), r"(?m)^", "> " * k)) for k in range(1, levels + 1)]
    text = F.concat(F.col("text"), *(F.coalesce(q, F.lit("")) for q in quoted))
    number = F.col("conv_id").cast("long") * TURNS + F.col("turn")
    return turns.select(number.alias("message_id"), number.alias("position"), "role", text.alias("text"))
