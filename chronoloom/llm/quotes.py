"""Conversations without quotations, each message linked to what it quotes.

Messages quote others by lines that begin with ">", one for each level. A run of
lines of one level is a passage. Passages are normalised (case, white space) and
hashed, as a whole and line by line, and joined to the messages of the same
conversation whose own text, or a line of it, has that hash. A passage belongs
to the earliest earlier message that accounts for most of it; a message replies
to the one its first level's passages mostly come from, and else to the one
before it. Quoted lines, and a line that announces them ("... wrote:"), are left
out of the text.

Messages that quote each other make a thread: the links' components, named by their
first message. A conversation comes out in the order of replies: thread by thread,
in the order of their first messages, so that a message that quotes an old one
stands with it, and every message follows the one it replies to.

A conversation may be of any length, so nothing gathers one as a whole: messages
are dealt by range of (conversation, turn), and again of (conversation, thread,
turn), numbered within their partition and moved on by the sums of the partitions
before; conversations come out in parts of at most ``PART`` messages.

Defined results: a null or empty text is an empty message; messages without a
conv_id form one conversation of their own; those without a turn come first,
reply to nothing and are never linked to; repeated rows are messages of their
own, in the order of their role and text, and as a source the first of them counts;
quoted lines of fewer than ``LEAST_CHARS`` characters link nothing by themselves; a
text of any length is read whole; an empty table gives an empty result; other
columns, whatever their names, are not read.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from itertools import islice

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

from chronoloom.llm.common import read_table, shuffle_partitions, small_batches, store
from chronoloom.llm.near_dedup import components
from chronoloom.llm.textops import Bytes, spans

PART = 64
#: Normalised lines shorter than this are too common to tell where they come from.
LEAST_CHARS = 8
#: Lines in more messages of a conversation than this are weighed for groups of messages.
RARE = 8
_MARKS = re.compile(r"^\s{0,3}((?:>\s?)+)")
_ANNOUNCES = re.compile(r"(?:wrote|writes|schrieb|a écrit|escribió)\s?:\s*$", re.IGNORECASE)


def quote_level(line: str) -> tuple[int, str]:
    """How deep a line is quoted, and the line without the marks."""
    m = _MARKS.match(line)
    return (m[1].count(">"), line[m.end() :]) if m else (0, line)


def normalised(text: str) -> str:
    return " ".join(text.lower().split())


def parse(text: str | None) -> tuple[str, list[tuple[int, list[str]]]]:
    """A message's own text, and its quoted passages as (level, lines)."""
    own: list[str] = []
    passages: list[tuple[int, list[str]]] = []
    last = 0
    for line in (text or "").split("\n"):
        level, rest = quote_level(line)
        if level == 0:
            own.append(line)
        else:
            if last == 0 and own and _ANNOUNCES.search(own[-1]):
                own.pop()
            if level != last:
                passages.append((level, []))
            passages[-1][1].append(rest)
        last = level
    return "\n".join(own).strip("\n") if passages else text or "", passages


def _hashes(strings: list[str]) -> np.ndarray:
    b = Bytes.of(pa.array(strings, pa.large_string()))
    return spans(b.raw, b.off[:-1], b.off[1:]).view(np.int64)


_PARSED = "id long, pid long, conv_id long, turn long, role string, own string, at long, last_turn long, own_hashes array<long>, passages array<int>, levels array<int>, sizes array<int>, quoted array<long>"


def parsed_messages(messages: DataFrame) -> DataFrame:
    """Messages in order, with their place in their conversation within their partition, parsed and hashed."""
    small_batches(messages.sparkSession)
    names = [x.split()[0] for x in _PARSED.split(", ")]

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pid, before, at, last = TaskContext.get().partitionId(), object(), 0, None
        number = pid << 33  # in the order of conversations and turns
        for batch in batches:
            out, strings = [], []
            for conv, turn, role, text in zip(*(batch.column(i).to_pylist() for i in range(4)), strict=True):
                if conv != before:
                    before, at, last = conv, 0, None
                own, passages = parse(text)
                keys = [normalised(x) for x in {own, *own.split("\n")}]
                keys = [x for x in keys if len(x) >= LEAST_CHARS]
                quoted = [(i, level, normalised(x)) for i, (level, lines) in enumerate(passages) for x in dict.fromkeys(["\n".join(lines), *lines])]
                quoted = [x for x in quoted if len(x[2]) >= LEAST_CHARS]
                out.append((number, pid, conv, turn, role, own, at, last, len(keys), [q[0] for q in quoted], [q[1] for q in quoted], [len(q[2]) for q in quoted], len(quoted)))
                strings += keys + [q[2] for q in quoted]
                number, at, last = number + 1, at + 1, turn
            # all strings of a batch are hashed at once
            hashes = iter(_hashes(strings).tolist())
            out = [(*x[:8], list(islice(hashes, x[8])), *x[9:12], list(islice(hashes, x[12]))) for x in out]
            columns = zip(*out, strict=True) if out else [[]] * len(names)
            kinds = [pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.string(), pa.int64(), pa.int64(), pa.list_(pa.int64()), *[pa.list_(pa.int32())] * 3, pa.list_(pa.int64())]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, kinds, strict=True)], names=names)

    rows = messages.select(F.col("conv_id").cast("long"), F.col("turn").cast("long"), F.col("role").cast("string"), F.col("text").cast("string"))
    # the texts decide where one conversation's repeated turns fall, and let one that is very long be dealt out
    dealt = rows.repartitionByRange(shuffle_partitions(messages.sparkSession), "conv_id", "turn", "role", "text").sortWithinPartitions("conv_id", "turn", "role", "text")
    return store(dealt.mapInArrow(read, _PARSED))


def linked_messages(messages: DataFrame) -> DataFrame:
    """A row for each message: (conv_id, position, turn, role, reply_to, n_quotes, n_linked, links, text), ``position`` in the order of replies."""
    rows = parsed_messages(messages)

    same = lambda a, b, c: F.col(f"{a}.{c}").eqNullSafe(F.col(f"{b}.{c}"))
    # the turn before a partition's share of a conversation
    shares = rows.groupBy("conv_id", "pid").agg(F.max("turn").alias("latest"))
    order = W.partitionBy("conv_id").orderBy("pid").rowsBetween(W.unboundedPreceding, -1)
    shares = store(shares.select("conv_id", "pid", F.max("latest").over(order).alias("before")))
    placed = rows.alias("m").join(shares.alias("s"), same("m", "s", "conv_id") & (F.col("m.pid") == F.col("s.pid")), "left")
    placed = placed.select("m.*", F.coalesce("last_turn", F.when(F.col("at") == 0, F.col("before"))).alias("previous"))

    # a passage's source is among the messages that hold one of its rare lines, each weighed by all the
    # passage's lines, or it shares common lines only: of messages with the same ones the first counts
    quoted = rows.where("turn IS NOT NULL AND size(quoted) > 0").select("conv_id", "turn", "pid", "at", F.explode(F.arrays_zip("passages", "levels", "sizes", "quoted")).alias("q"))
    quoted = quoted.select("conv_id", "turn", "pid", "at", F.col("q.passages").alias("passage"), F.col("q.levels").alias("level"), F.col("q.sizes").alias("size"), F.col("q.quoted").alias("h"))
    own = rows.where("turn IS NOT NULL").select("conv_id", "turn", F.explode("own_hashes").alias("h")).distinct()
    asked = quoted.select("conv_id", "h").distinct()
    known = own.groupBy("conv_id", "h").agg((F.count(F.lit(1)) > RARE).alias("common")).alias("k").join(asked.alias("a"), same("k", "a", "conv_id") & (F.col("k.h") == F.col("a.h"))).select("k.*")
    lines = store(own.alias("o").join(store(known).alias("k"), same("o", "k", "conv_id") & (F.col("o.h") == F.col("k.h"))).select("o.conv_id", F.col("turn").alias("source"), "o.h", "common"))
    alike = lines.where("common").groupBy("conv_id", "source").agg(F.sort_array(F.collect_set("h")).alias("hs")).groupBy("conv_id", "hs").agg(F.min("source").alias("source"))
    first = alike.select("conv_id", "source", F.explode("hs").alias("h"))

    hit = lambda held: quoted.alias("q").join(held.alias("f"), same("q", "f", "conv_id") & (F.col("q.h") == F.col("f.h")) & (F.col("f.source") < F.col("q.turn")))
    passage = ("conv_id", "pid", "at", "passage")
    rare = hit(lines.where("NOT common")).select(*(f"q.{c}" for c in passage), "f.source").distinct()
    pairs = rare.alias("r").join(quoted.alias("q"), same("r", "q", "conv_id") & (F.col("r.pid") == F.col("q.pid")) & (F.col("r.at") == F.col("q.at")) & (F.col("r.passage") == F.col("q.passage"))).select("q.*", "r.source")
    whole = pairs.alias("q").join(lines.alias("f"), same("q", "f", "conv_id") & (F.col("q.h") == F.col("f.h")) & (F.col("q.source") == F.col("f.source")))
    by_source = lambda x: x.select(*(f"q.{c}" for c in (*passage, "level", "size")), "f.source").groupBy(*passage, "level", "source").agg(F.sum("size").alias("weight"))
    weighed = by_source(whole).unionByName(by_source(hit(first)))
    passages = weighed.groupBy("conv_id", "pid", "at", "passage", "level").agg(F.max(F.struct("weight", (-F.col("source")).alias("s"))).alias("best"))
    linked = passages.groupBy("conv_id", "pid", "at").agg(F.count(F.lit(1)).alias("n_linked"), F.max(F.when(F.col("level") == 1, F.struct("best.weight", "best.s"))).alias("to"), F.array_sort(F.collect_list(F.struct("passage", "level", (-F.col("best.s")).alias("turn")))).alias("links"))

    linked = store(linked)
    # links to the first message of the turn that is replied to make threads
    turns = rows.where("turn IS NOT NULL").groupBy("conv_id", "turn").agg(F.min("id").alias("source"))
    replies = linked.where("to IS NOT NULL").select("conv_id", "pid", "at", (-F.col("to.s")).alias("turn"))
    replies = replies.alias("r").join(rows.alias("m"), same("r", "m", "conv_id") & (F.col("r.pid") == F.col("m.pid")) & (F.col("r.at") == F.col("m.at"))).select("m.id", "r.conv_id", "r.turn")
    edges = replies.alias("r").join(turns.alias("t"), same("r", "t", "conv_id") & (F.col("r.turn") == F.col("t.turn"))).select(F.col("r.id").alias("a"), F.col("t.source").alias("b"))
    threads = components(edges)

    out = placed.alias("m").join(linked.alias("l"), same("m", "l", "conv_id") & (F.col("m.pid") == F.col("l.pid")) & (F.col("m.at") == F.col("l.at")), "left").join(threads.alias("t"), F.col("m.id") == F.col("t.node"), "left")
    n_quotes = F.coalesce(F.array_max("m.passages") + 1, F.lit(0)).cast("long")
    out = out.select("m.conv_id", F.coalesce("t.component", "m.id").alias("thread"), "m.id", "m.turn", "m.role", F.when(F.col("m.turn").isNotNull(), F.coalesce(-F.col("l.to.s"), "m.previous")).alias("reply_to"), n_quotes.alias("n_quotes"), F.coalesce("l.n_linked", F.lit(0)).alias("n_linked"), F.coalesce("l.links", F.array().cast("array<struct<passage:int,level:int,turn:bigint>>")).alias("links"), F.col("m.own").alias("text"))
    return numbered(out, ["thread", "id"]).select("conv_id", "position", "turn", "role", "reply_to", "n_quotes", "n_linked", "links", "text")


def numbered(rows: DataFrame, order: list[str]) -> DataFrame:
    """``rows`` with ``position``, their number from 0 in their conversation."""
    names = rows.columns
    schema = T.StructType([*rows.schema.fields, T.StructField("_pid", T.LongType()), T.StructField("_at", T.LongType())])

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pid, before, at = TaskContext.get().partitionId(), object(), 0
        for batch in batches:
            places = []
            for conv in batch.column("conv_id").to_pylist():
                before, at = conv, at + 1 if conv == before else 0
                places.append(at)
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in names), pa.array([pid] * len(places), pa.int64()), pa.array(places, pa.int64())], names=[*names, "_pid", "_at"])

    dealt = rows.repartitionByRange(shuffle_partitions(rows.sparkSession), "conv_id", *order).sortWithinPartitions("conv_id", *order)
    dealt = store(dealt.mapInArrow(count, schema))
    # where each partition's share of a conversation begins
    shares = dealt.groupBy("conv_id", "_pid").agg(F.count(F.lit(1)).alias("n"))
    before = W.partitionBy("conv_id").orderBy("_pid").rowsBetween(W.unboundedPreceding, -1)
    shares = shares.select(F.col("conv_id").alias("_conv"), F.col("_pid").alias("_share"), F.coalesce(F.sum("n").over(before), F.lit(0)).alias("_offset"))
    out = dealt.join(shares, F.col("conv_id").eqNullSafe(F.col("_conv")) & (F.col("_pid") == F.col("_share")))
    return out.withColumn("position", F.col("_offset") + F.col("_at"))


def conversations(messages: DataFrame, part: int = PART) -> DataFrame:
    """(conv_id, part, n_messages, n_linked, messages): conversations in parts of at most ``part`` messages."""
    rows = linked_messages(messages).withColumn("part", F.floor(F.col("position") / part))
    message = F.struct("position", "turn", "role", "reply_to", "links", "text")
    return rows.groupBy("conv_id", "part").agg(F.count(F.lit(1)).alias("n_messages"), F.sum("n_linked").alias("n_linked"), F.array_sort(F.collect_list(message)).alias("messages"))


def op6_quote_linking(spark: SparkSession, sf_dir: str) -> DataFrame:
    return conversations(read_table(spark, sf_dir, "conversations"))
