"""Byte-level BPE encoding and decoding with each distinct pre-token encoded once.

Encoding:

1. Texts are cut into pre-tokens. The distinct ones of a block of documents are
   numbered, and the block keeps its texts as the sequence of those numbers,
   which are the pre-tokens' positions in packed form.
2. Distinct pre-tokens are shuffled by hash bucket, so that all blocks' copies
   of one meet in one task, which encodes it once. A frequent pre-token makes
   one entry per block, however often it occurs.
3. The ids go back to the blocks, which replace numbers by ids.

Decoding looks each id up in the token-byte table; the vocabulary is of fixed size,
so the table travels with the tasks (``TokenBytes.java``, see jvm.py).

A partition's rows are sorted before they are numbered, so a task that is repeated
after a loss makes the same blocks, whatever order its input comes in.

Only packed, compressed sequences and distinct pre-tokens are shuffled, never
texts or a row per occurrence.

Defined results: a null or empty text has no ids; rows are encoded one by one,
so repeated rows and null ids do no harm; an empty table gives an empty result;
columns not asked for, whatever their names, are not read. Special tokens' strings
are ordinary text. A document longer than ``BLOCK_BYTES`` is encoded whole, as a
block of its own.
"""

from __future__ import annotations

import base64
import zlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import public_tokenizers
import pyarrow as pa
import pyarrow.compute as pc
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from chronoloom.llm import jvm
from chronoloom.llm.common import read_table, shuffle_partitions, small_batches

VOCABULARY = "byte_bpe_multi_50k.tiktoken"
#: Bytes of text in a block of documents; a longer document is a block of its own.
BLOCK_BYTES = 16_000_000
LEAST_BUCKETS = 128
_LEVEL = 3
#: Pre-tokens that are replaced by ids at a time.
_STEP_WORDS = 250_000


@lru_cache(2)
def load_ranks(path: str) -> dict[bytes, int]:
    with open(path, "rb") as f:
        return {base64.b64decode(token): int(rank) for token, rank in (line.split() for line in f)}


@lru_cache(2)
def _encoding(path: str):
    import tiktoken  # only workers that encode load it

    # a pre-token is encoded as a whole, whatever is in it
    return tiktoken.Encoding("words", pat_str=r"[\s\S]+", mergeable_ranks=load_ranks(path), special_tokens={})


@lru_cache(2)
def _token_bytes(path: str) -> bytes:
    """The number of ids, where each one's bytes end, and all bytes."""
    ranks = load_ranks(path)
    table = [b""] * (max(ranks.values()) + 1)
    for token, rank in ranks.items():
        table[rank] = token
    return np.array([len(table), *np.cumsum([len(t) for t in table])], "<u4").tobytes() + b"".join(table)


def _pack(a: np.ndarray) -> bytes:
    """Little-endian integers by byte planes, which compress close to their entropy."""
    a = np.ascontiguousarray(a, "<u4")
    return zstandard.compress(a.view(np.uint8).reshape(-1, 4).T.tobytes(), _LEVEL)


def _unpack(data: bytes) -> np.ndarray:
    raw = np.frombuffer(zstandard.decompress(data), np.uint8)
    return np.ascontiguousarray(raw.reshape(4, -1).T).view("<u4").ravel()


_COMMON = 240


def _pack_seq(a: np.ndarray) -> bytes:
    """Numbers of which small ones are common: a byte each for those below 240; else the byte says
    the higher bits of what is above, and two more bytes the lower ones."""
    small = a < _COMMON
    rest = (a[~small] - _COMMON).astype(np.uint32)
    high = rest >> 16
    if len(high) and high.max() >= 256 - _COMMON:
        return b"\0" + _pack(a)
    first = a.astype(np.uint8)
    first[~small] = _COMMON + high
    parts = [zstandard.compress(first.tobytes(), _LEVEL), zstandard.compress((rest & 0xFF).astype(np.uint8).tobytes(), _LEVEL), zstandard.compress((rest >> 8 & 0xFF).astype(np.uint8).tobytes(), _LEVEL)]
    return b"\1" + np.array([len(x) for x in parts], "<u4").tobytes() + b"".join(parts)


def _unpack_seq(data: bytes) -> np.ndarray:
    if data[0] == 0:
        return _unpack(data[1:])
    ends = 13 + np.cumsum(np.frombuffer(data, "<u4", 3, 1).astype(np.int64))
    first, low, mid = (np.frombuffer(zstandard.decompress(data[a:b]), np.uint8) for a, b in zip([13, *ends[:2]], ends, strict=True))
    out = first.astype(np.uint32)
    far = first >= _COMMON
    out[far] = ((out[far] - _COMMON) << 16 | mid.astype(np.uint32) << 8 | low) + _COMMON
    return out


def _bucket_of(words: list[str], buckets: int, step: int = 20_000) -> np.ndarray:
    """A hash of the words alone, alike on every machine."""
    from chronoloom.llm.textops import Bytes, spans

    out = []
    for a in range(0, len(words), step):  # the hash keeps powers for as many bytes as it sees at once
        b = Bytes.of(pa.array(words[a : a + step], pa.large_string()))
        out.append(spans(b.raw, b.off[:-1], b.off[1:]) % np.uint64(buckets))
    return np.concatenate(out).astype(np.int64)


class _Block:
    """Documents being gathered; ``seq`` has the numbers of their pre-tokens."""

    def __init__(self) -> None:
        self.number: dict[str, int] = {}
        self.seq: list[np.ndarray] = []
        self.sizes: list[int] = []
        self.ids: list[pa.Array] = []
        self.bytes = 0

    def add(self, text: str, n_bytes: int, split) -> None:
        words = split(text)
        number = self.number
        self.seq.append(np.fromiter((number.setdefault(w, len(number)) for w in words), np.uint32, len(words)))
        self.sizes.append(len(words))
        self.bytes += n_bytes

    def rows(self, place: int, buckets: int) -> Iterator[tuple]:
        """The block's distinct pre-tokens by hash bucket, and its sequence.

        Its number is its place and a checksum of its sequence.
        """
        words = list(self.number)
        seq = np.concatenate(self.seq) if self.seq else np.zeros(0, np.uint32)
        # renumbered so that frequent pre-tokens have small numbers
        rank = np.empty(len(words), np.uint32)
        rank[np.argsort(-np.bincount(seq, minlength=len(words)), kind="stable")] = np.arange(len(words), dtype=np.uint32)
        packed = _pack_seq(rank[seq])
        block = place << 24 | zlib.crc32(packed) & 0xFFFFFF
        if words:
            bucket = _bucket_of(words, buckets)
            order = np.argsort(bucket, kind="stable")
            used, first = np.unique(bucket[order], return_index=True)
            for b, part in zip(used.tolist(), np.split(order, first[1:]), strict=True):
                own = [words[i].encode() for i in part.tolist()]
                sizes = np.fromiter(map(len, own), np.uint32, len(own))
                yield b, block, _pack(rank[part]), _pack(sizes), zstandard.compress(b"".join(own), _LEVEL), None
        # any task will do for the sequence: it only passes through
        yield (block * 0x9E3779B97F4A7C15 % 2**64 >> 40) % buckets, block, packed, _pack(np.array(self.sizes, np.uint32)), None, pa.concat_arrays(self.ids).to_pylist()


_ROWS = "bucket long, block long, numbers binary, sizes binary, payload binary, ids array<{id}>"


def _batches(rows: Iterator[tuple], id_type: pa.DataType, per_batch: int = 256) -> Iterator[pa.RecordBatch]:
    types = [pa.int64(), pa.int64(), pa.binary(), pa.binary(), pa.binary(), pa.list_(id_type)]
    names = ["bucket", "block", "numbers", "sizes", "payload", "ids"]
    held: list[tuple] = []
    for row in rows:
        held.append(row)
        if len(held) >= per_batch:
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*held, strict=True), types, strict=True)], names=names)
            held = []
    if held:
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*held, strict=True), types, strict=True)], names=names)


def encode(docs: DataFrame, text: str = "text", doc_id: str = "doc_id", path: str | None = None, pattern: str = public_tokenizers.PATTERN, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """(doc_id, ids) for each row of ``docs``."""
    path = path or public_tokenizers.path(VOCABULARY)
    spark = docs.sparkSession
    small_batches(spark)
    buckets = max(LEAST_BUCKETS, 4 * shuffle_partitions(spark))
    id_type, sql_type = docs.select(doc_id).schema[0].dataType, docs.select(doc_id).schema[0].dataType.simpleString()
    from pyspark.sql.pandas.types import to_arrow_type

    arrow_id = to_arrow_type(id_type)

    def numbered(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import regex

        # Unicode white space is spelt out: what \s means differs between libraries
        split = regex.compile(pattern.replace(r"[^\s", r"[^\p{White_Space}").replace(r"\s", r"\p{White_Space}").replace(r"\S", r"\P{White_Space}")).findall

        def rows() -> Iterator[tuple]:
            first = TaskContext.get().partitionId() << 20
            block, made = _Block(), 0
            for batch in batches:
                block.ids.append(batch.column(0))
                start = 0
                sizes = pc.fill_null(pc.binary_length(batch.column(1)), 0).to_pylist()
                for i, x in enumerate(batch.column(1).to_pylist()):
                    block.add(x or "", sizes[i], split)
                    if block.bytes >= block_bytes:
                        block.ids[-1] = block.ids[-1].slice(0, i + 1 - start)
                        yield from block.rows(first + made, buckets)
                        made, block, start = made + 1, _Block(), i + 1
                        block.ids.append(batch.column(0).slice(start))
            if block.sizes:
                yield from block.rows(first + made, buckets)

        return _batches(rows(), arrow_id)

    def encoded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        one = _encoding(path).encode_ordinary

        def rows() -> Iterator[tuple]:
            bucket, known = None, {}
            for batch in batches:
                for row in batch.to_pylist():
                    if row["payload"] is None:
                        yield row["bucket"], row["block"], row["numbers"], row["sizes"], None, row["ids"]
                        continue
                    if row["bucket"] != bucket:
                        bucket, known = row["bucket"], {}
                    data, at, found = zstandard.decompress(row["payload"]), 0, []
                    for size in _unpack(row["sizes"]).tolist():
                        word = data[at : at + size]
                        at += size
                        ids = known.get(word)
                        if ids is None:
                            ids = known[word] = one(word.decode())
                        found.append(ids)
                    flat = np.fromiter((i for ids in found for i in ids), np.uint32)
                    yield bucket, row["block"], row["numbers"], _pack(np.fromiter(map(len, found), np.uint32, len(found))), _pack(flat), None

        return _batches(rows(), arrow_id)

    def rejoined(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[dict] = []
        for batch in batches:
            for row in batch.to_pylist():
                if held and row["block"] != held[0]["block"]:
                    yield from joined(held)
                    held = []
                held.append(row)
        if held:
            yield from joined(held)

    def joined(rows: list[dict]) -> Iterator[pa.RecordBatch]:
        """The documents of one block, a few at a time."""
        seq = next((r for r in rows if r["payload"] is None), None)
        found = [r for r in rows if r["payload"] is not None]
        gather = lambda c: np.concatenate([np.zeros(0, np.uint32), *(_unpack(r[c]) for r in found)])
        numbers, sizes, ids = gather("numbers"), gather("sizes").astype(np.int64), gather("payload").astype(np.int32)
        words = _unpack_seq(seq["numbers"]) if seq is not None else numbers
        if seq is None or len(numbers) != (int(words.max()) + 1 if len(words) else 0):
            raise RuntimeError(f"block {rows[0]['block']} is not whole")
        rows.clear()
        start, size = np.zeros(len(numbers), np.int64), np.zeros(len(numbers), np.int64)
        start[numbers], size[numbers] = np.cumsum(sizes) - sizes, sizes
        per_doc = _unpack(seq["sizes"]).astype(np.int64)
        first = np.concatenate([[0], np.cumsum(per_doc)])
        names, at = pa.array(seq["ids"], arrow_id), 0
        while at < len(per_doc):
            to = max(at + 1, int(np.searchsorted(first, first[at] + _STEP_WORDS, "right")) - 1)
            own = words[first[at] : first[to]]
            n = size[own]
            ends = np.cumsum(n)
            out = ids[np.repeat(start[own] - (ends - n), n) + np.arange(ends[-1] if len(ends) else 0)]
            bounds = np.concatenate([[0], ends])[first[at : to + 1] - first[at]]
            lists = pa.ListArray.from_arrays(pa.array(bounds, pa.int32()), pa.array(out, pa.int32()))
            yield pa.RecordBatch.from_arrays([names.slice(at, to - at), lists], names=[doc_id, "ids"])
            at = to

    rows = docs.select(doc_id, text).sortWithinPartitions(doc_id, text).mapInArrow(numbered, _ROWS.format(id=sql_type))
    rows = rows.repartition(shuffle_partitions(spark), "bucket").sortWithinPartitions("bucket")
    rows = rows.mapInArrow(encoded, _ROWS.format(id=sql_type))
    # a block's rows meet, one block after another, and are put out piece by piece
    rows = rows.repartition(shuffle_partitions(spark), "block").sortWithinPartitions("block")
    return rows.mapInArrow(rejoined, f"`{doc_id}` {sql_type}, ids array<int>")


def decode(rows: DataFrame, ids: str = "ids", path: str | None = None) -> DataFrame:
    """``rows`` with ``decoded``, the bytes of their ids."""
    path = path or public_tokenizers.path(VOCABULARY)
    jvm.register(rows.sparkSession, "TokenBytes", {"chronoloom_token_bytes": ("Decode", "binary")})
    return rows.withColumn("decoded", jvm.call("chronoloom_token_bytes", F.col(ids), F.lit(_token_bytes(path))))


def op9_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = decode(encode(read_table(spark, sf_dir, "documents")))
    joined_ids = F.array_join(F.col("ids").cast("array<string>"), ",")
    return rows.select("doc_id", F.size("ids").cast("long").alias("n_tokens"), F.sha2(joined_ids, 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"))
