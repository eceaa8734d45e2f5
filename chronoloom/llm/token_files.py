"""Token-id files: encode documents, write their ids in coded blocks, read them back.

Documents are sorted by doc_id into shards; a shard's ids, with the end id after
each document, form one sequence, cut into blocks for the context-mixing range
coder. A file is Parquet with a row for each block:

    shard long       position of the shard in doc_id order
    block long       position of the block in its shard
    first_id long    ids of the shard before the block
    first_doc long   number in the shard of the first document of the block
    docs array       doc_ids of the documents that have ids in the block
    sizes array      how many of the block's ids are each one's
    data binary      the coded block with its checksums (context_coder)

Spark's committer writes these files, so they can lie in any store it reaches
and a lost executor's attempt leaves nothing behind. Any row can be decoded
alone. A document that spans blocks is put together from its pieces.

A tokenizer that cuts no token across ASCII white space (which is checked) encodes
each distinct run of other bytes once for ``CHUNK_BYTES`` of text, and in plain words
each distinct pre-token; any other encodes whole texts. Added tokens that stand
in a text are found as the library finds them.

Defined results: a null or empty text has the end id alone; rows that share a
doc_id follow each other, ordered by text; rows without a doc_id come first; an
empty table gives no files' rows and an empty result; other columns are not read.
Texts of any length are encoded whole; one longer than ``CHUNK_BYTES`` is a chunk
of its own.
"""

from __future__ import annotations

import json
import zlib
from collections.abc import Iterator
from functools import lru_cache
from itertools import chain

import numpy as np
import public_tokenizers
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from chronoloom.llm.common import read_table, shared_dir, shuffle_partitions, small_batches
from chronoloom.llm.context_coder import BLOCK_IDS, decoded, encoded

TOKENIZER = "word_bpe_49k.json"
END_ID = 2
#: Bytes of text that a task encodes at a time.
CHUNK_BYTES = 24_000_000

#: The normaliser and pre-tokenizer whose effect on plain words is known (fixed values).
_KNOWN_NORMALIZER = [{"type": "NFC"}, {"type": "Replace", "pattern": {"Regex": "\\s+"}, "content": " "}, {"type": "Lowercase"}]
_SUFFIX = "</w>"
_KNOWN_SPLIT = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"
#: ASCII punctuation without the apostrophe, which may begin a token of letters.
_POINTS = "".join(chr(c) for c in range(33, 127) if not chr(c).isalnum() and chr(c) != "'")


@lru_cache(2)
def _tokenizer(path: str):
    import os

    os.environ["TOKENIZERS_PARALLELISM"] = "false"  # a task has one core
    from tokenizers import Tokenizer

    return Tokenizer.from_file(path)


@lru_cache(2)
def _plain(path: str) -> bool:
    """Whether a file's tokenizer is made of the known parts, so that it cuts no token across ASCII
    white space, and a plain word (lower-case letters up to U+00FF, then ASCII punctuation) into
    these two pre-tokens."""
    spec = json.loads(_tokenizer(path).to_str())
    normal, pre = spec.get("normalizer") or {}, (spec.get("pre_tokenizer") or {}).get("pretokenizers") or [{}]
    split = pre[0]
    added = [t["content"] for t in spec.get("added_tokens") or []]
    return (
        not any(x.split() != [x] or not x.strip(_POINTS) or x.rstrip(_POINTS).isalpha() for x in added)
        and normal.get("normalizers") == _KNOWN_NORMALIZER
        and split.get("type") == "Split" and split.get("pattern") == {"Regex": _KNOWN_SPLIT} and split.get("behavior") == "Removed" and split.get("invert") is True
        and [p.get("type") for p in pre[1:]] == ["ByteLevel"] and pre[1].get("add_prefix_space") is False and pre[1].get("use_regex") is False
        and spec["model"].get("type") == "BPE" and spec["model"].get("end_of_word_suffix") == _SUFFIX and spec["model"].get("continuing_subword_prefix") is None
        and all(c + _SUFFIX in spec["model"]["vocab"] for c in [*map(chr, range(33, 127)), *(bytes(x).decode() for x in _SIGNS[128:])])
    )


def _byte_signs() -> np.ndarray:
    """For bytes from 128 the two bytes of the character by which byte-level models write them."""
    shown = [c for c in range(256) if 33 <= c <= 126 or 161 <= c <= 172 or 174 <= c <= 255]
    sign = {c: chr(c) for c in shown} | {c: chr(256 + i) for i, c in enumerate(c for c in range(256) if c not in shown)}
    return np.array([list(sign[c].encode()) if c >= 128 else [c, 0] for c in range(256)], np.uint8)


_SIGNS = _byte_signs()


def _signed(words: pa.LargeStringArray) -> pa.LargeStringArray:
    """Words as byte-level models write them: ASCII as it is, every other byte as a character."""
    at = np.frombuffer(words.buffers()[1], np.int64, len(words) + 1 + words.offset)[words.offset :]
    raw = np.frombuffer(words.buffers()[2] or b"", np.uint8)
    size = 1 + (raw > 127)
    ends = np.concatenate([[0], np.cumsum(size)])
    out = np.zeros(ends[-1], np.uint8)
    out[ends[1:] - 1] = _SIGNS[raw, size - 1]
    out[ends[:-1]] = _SIGNS[raw, 0]
    return pa.LargeStringArray.from_buffers(len(words), pa.py_buffer(ends[at]), pa.py_buffer(out))


class RunEncoder:
    """Ids of texts, from the ids of their distinct runs of bytes outside ASCII white space.

    A tokenizer of unknown parts encodes whole texts.
    """

    def __init__(self, path: str):
        self.tokenizer, self.plain = _tokenizer(path), _plain(path)
        if self.plain:
            from tokenizers import Tokenizer
            from tokenizers.pre_tokenizers import WhitespaceSplit

            # the same model on pre-tokens that are given as its words
            self.pieces = Tokenizer(self.tokenizer.model)
            self.pieces.pre_tokenizer = WhitespaceSplit()
            # the last token of every pre-token, and no other, ends with the suffix
            self.last = np.zeros(self.tokenizer.get_vocab_size(), bool)
            self.last[[i for t, i in self.tokenizer.get_vocab(with_added_tokens=False).items() if t.endswith(_SUFFIX)]] = True

    def _whole(self, texts: list[str]) -> list[list[int]]:
        return [e.ids for e in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]

    def _pieces(self, pieces: pa.LargeStringArray, step: int = 2000) -> tuple[np.ndarray, np.ndarray]:
        """Ids of distinct pre-tokens in a row, and the number of each one's."""
        pieces = _signed(pieces).to_pylist()
        found = self.pieces.encode_batch_fast([" ".join(pieces[a : a + step]) for a in range(0, len(pieces), step)], add_special_tokens=False)
        ids = np.concatenate([np.zeros(0, np.int32), *(np.array(e.ids, np.int32) for e in found)])
        sizes = np.diff(np.flatnonzero(self.last[ids]), prepend=-1)
        assert len(sizes) == len(pieces)
        return ids, sizes

    def _runs(self, runs: pa.LargeStringArray) -> pa.LargeListArray:
        """Ids of distinct runs: plain words from their two pre-tokens, others by the whole tokenizer."""
        words = pc.ascii_rtrim(runs, _POINTS)
        at, word_at = (np.frombuffer(x.buffers()[1], np.int64, len(x) + 1 + x.offset)[x.offset :] for x in (runs, words))
        raw = [np.frombuffer(x.buffers()[2] or b"", np.uint8) for x in (runs, words)]
        # letters up to U+00FF begin with a byte of at most C3
        far = np.concatenate([[0], np.cumsum(raw[1] > 0xC3)])
        plain = pc.utf8_is_alpha(words).to_numpy(zero_copy_only=False) & (far[word_at[1:]] == far[word_at[:-1]])
        lower = pc.utf8_lower(words.filter(pa.array(plain))).dictionary_encode()
        n_words, n_runs = np.diff(word_at), np.diff(at)
        ended = np.flatnonzero(plain & (n_runs > n_words))
        size = (n_runs - n_words)[ended]
        ends = np.concatenate([[0], np.cumsum(size)])
        tail = raw[0][np.repeat(at[ended + 1] - ends[1:], size) + np.arange(ends[-1])]
        tails = pa.LargeStringArray.from_buffers(len(ended), pa.py_buffer(ends), pa.py_buffer(tail)).dictionary_encode()
        others = runs.filter(pa.array(~plain)).to_pylist()
        coded = [self._pieces(lower.dictionary), self._pieces(tails.dictionary)]
        found = self._whole([x for x in others if x])
        coded.append((np.fromiter(chain.from_iterable(found), np.int32), np.fromiter(map(len, found), np.int64, len(found))))
        # each run as two pieces, of which the first here is no ids at all
        sizes = np.concatenate([[0, 0], *(n for _, n in coded)])
        ids = pa.LargeListArray.from_arrays(pa.array(np.cumsum(sizes)), pa.array(np.concatenate([x for x, _ in coded])))
        pieces = np.zeros((len(runs), 2), np.int64)
        pieces[plain, 0] = 1 + lower.indices.to_numpy()
        pieces[ended, 1] = 1 + len(lower.dictionary) + tails.indices.to_numpy()
        filled = np.fromiter(map(bool, others), bool, len(others))
        pieces[np.flatnonzero(~plain)[filled], 0] = 1 + len(lower.dictionary) + len(tails.dictionary) + np.arange(filled.sum())
        both = ids.take(pa.array(pieces.ravel()))
        return pa.LargeListArray.from_arrays(both.offsets[::2], both.values)

    def encode(self, texts: pa.Array, end_id: int) -> tuple[np.ndarray, np.ndarray]:
        """All ids in one array, and the number of each text's, with ``end_id`` after each."""
        if not self.plain:
            found = [ids + [end_id] for ids in self._whole([x or "" for x in texts.to_pylist()])]
            return np.fromiter(chain.from_iterable(found), np.int32), np.array([len(ids) for ids in found], np.int64)
        split = pc.ascii_split_whitespace(texts.fill_null("").cast(pa.large_string()))
        split = split.combine_chunks() if isinstance(split, pa.ChunkedArray) else split
        per_text = pc.list_value_length(split).to_numpy(zero_copy_only=False).astype(np.int64)
        coded = split.flatten().dictionary_encode()
        runs = self._runs(coded.dictionary)
        # the end of a text is one more run
        runs = pa.concat_arrays([runs, pa.array([[end_id]], pa.large_list(pa.int32()))])
        ends = np.cumsum(per_text + 1)
        codes = np.full(ends[-1] if len(ends) else 0, len(runs) - 1, np.int32)
        mine = np.ones(len(codes), bool)
        mine[ends - 1] = False
        codes[mine] = coded.indices.to_numpy()
        ids = runs.take(pa.array(codes))
        return ids.values.to_numpy(), np.diff(ids.offsets.to_numpy()[ends], prepend=0)


def _chunks(batches: Iterator[pa.RecordBatch], limit: int = CHUNK_BYTES) -> Iterator[tuple[list, pa.Array]]:
    """doc_ids and texts of about ``limit`` bytes at a time."""
    held, size = [], 0
    for batch in batches:
        held.append(batch)
        size += batch.column(1).nbytes
        if size >= limit:
            whole = pa.Table.from_batches(held)
            yield whole.column(0).to_pylist(), whole.column(1).combine_chunks()
            held, size = [], 0
    if held:
        whole = pa.Table.from_batches(held)
        yield whole.column(0).to_pylist(), whole.column(1).combine_chunks()


_BLOCKS = "shard long, block long, first_id long, first_doc long, docs array<long>, sizes array<int>, data binary"


def coded_blocks(docs: DataFrame, text: str = "text", doc_id: str = "doc_id", path: str | None = None, end_id: int = END_ID, block_ids: int = BLOCK_IDS) -> DataFrame:
    """The rows of the file format for ``docs``."""
    path = path or public_tokenizers.path(TOKENIZER)
    spark = docs.sparkSession
    small_batches(spark)
    size = max(_tokenizer(path).get_vocab_size(), end_id + 1)
    made = _BLOCKS.replace("data", "ids")
    names = [x.split()[0] for x in made.split(", ")]
    kinds = [pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.list_(pa.int64()), pa.list_(pa.int32()), pa.binary()]

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shard, encoder = TaskContext.get().partitionId(), RunEncoder(path)
        state = {"block": 0, "doc": 0, "left": [np.zeros(0, np.int32), [], []]}

        def rows(last: bool) -> Iterator[pa.RecordBatch]:
            """Rows of the whole blocks gathered so far, or at the end of all that is left."""
            ids, docs, sizes = state["left"]
            n_ids = len(ids) if last else len(ids) // block_ids * block_ids
            cuts = [*range(0, n_ids, block_ids), n_ids] if n_ids else [0]
            ends = np.concatenate([[0], np.cumsum(sizes, dtype=np.int64)])
            out = []
            for k, (a, b) in enumerate(zip(cuts, cuts[1:])):
                lo, hi = int(np.searchsorted(ends[1:], a, "right")), int(np.searchsorted(ends[1:], b, "left"))
                here = np.minimum(ends[lo + 1 : hi + 2], b) - np.maximum(ends[lo : hi + 1], a)
                out.append((shard, state["block"] + k, (state["block"] + k) * block_ids, state["doc"] + lo, docs[lo : hi + 1], here.tolist(), ids[a:b].astype("<u4").tobytes()))
            done = int(np.searchsorted(ends[1:], n_ids, "right"))
            rest = sizes[done:]
            if rest:
                rest[0] = int(ends[done + 1] - n_ids)
            state["left"] = [ids[n_ids:], docs[done:], rest]
            state["block"] += len(cuts) - 1
            state["doc"] += done
            for i in range(0, len(out), 16):
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out[i : i + 16]), kinds)], names=names)

        for docs, texts in _chunks(batches):
            ids, sizes = encoder.encode(texts, end_id)
            left = state["left"]
            state["left"] = [np.concatenate([left[0], ids]), left[1] + docs, left[2] + sizes.tolist()]
            yield from rows(False)
        yield from rows(True)

    # nulls sort first, as in the files
    dealt = docs.select(F.col(doc_id).cast("long").alias("d"), F.col(text).alias("t")).repartitionByRange(shuffle_partitions(spark), "d").sortWithinPartitions("d", "t")
    return dealt.mapInArrow(write, made).withColumn("data", encoded(spark, F.col("ids"), size)).drop("ids")


def write_tokens(docs: DataFrame, to: str, **options) -> None:
    coded_blocks(docs, **options).write.parquet(to)


def read_pieces(spark: SparkSession, path: str, with_ids: bool = True) -> DataFrame:
    """A row for each document in each block, decoded: (shard, doc, piece, doc_id, first_id, n, crc, ids).

    ``doc`` is the document's number in its shard and ``piece`` the block; ``crc`` is the crc32
    of the piece's ids as little-endian 32-bit integers.
    """
    small_batches(spark)
    names = ["shard", "doc", "piece", "doc_id", "first_id", "n", "crc"]

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                sizes, raw = np.array(row["sizes"], np.int64), memoryview(row["raw"])
                ends = np.cumsum(sizes)
                starts = ends - sizes
                crc = [zlib.crc32(raw[4 * a : 4 * b]) for a, b in zip(starts.tolist(), ends.tolist(), strict=True)]
                cols = [np.full(len(sizes), row["shard"]), row["first_doc"] + np.arange(len(sizes)), np.full(len(sizes), row["block"]), row["docs"], row["first_id"] + starts, sizes, crc]
                lists = [pa.ListArray.from_arrays(pa.array(np.concatenate([[0], ends]), pa.int32()), pa.array(np.frombuffer(raw, "<i4")))] if with_ids else []
                yield pa.RecordBatch.from_arrays([*(pa.array(c, pa.int64()) for c in cols), *lists], names=[*names, *(["ids"] if with_ids else [])])

    blocks = spark.read.parquet(path).withColumn("raw", decoded(spark, F.col("data"))).drop("data")
    return blocks.mapInArrow(read, ", ".join(f"{c} long" for c in names) + ", ids array<int>" * with_ids)


def shard_starts(spark: SparkSession, path: str) -> DataFrame:
    """(shard, before): ids of all shards before; a row for each shard, from the blocks' small columns."""
    sizes = spark.read.parquet(path).select("shard", F.aggregate("sizes", F.lit(0).cast("long"), lambda a, x: a + x).alias("n")).groupBy("shard").agg(F.sum("n").alias("n"))
    return sizes.select("shard", (F.sum("n").over(W.orderBy("shard")) - F.col("n")).alias("before"))


def read_tokens(spark: SparkSession, path: str) -> DataFrame:
    """(doc_id, ids) from token files."""
    pieces = read_pieces(spark, path).groupBy("shard", "doc").agg(F.min("doc_id").alias("doc_id"), F.sort_array(F.collect_list(F.struct("piece", "ids"))).alias("p"))
    return pieces.select("doc_id", F.flatten("p.ids").alias("ids"))


_POLYNOMIAL = 0xEDB88320


@lru_cache(1)
def _zero_operators() -> list[list[int]]:
    """For k = 0.. : the matrix that appends 2**k zero bits to a crc32, as images of the 32 unit vectors."""
    ops = [[_POLYNOMIAL, *(1 << i for i in range(31))]]
    for _ in range(63):
        ops.append([_apply(ops[-1], ops[-1][i]) for i in range(32)])
    return ops


def _apply(matrix: list[int], vector: int) -> int:
    out, i = 0, 0
    while vector:
        if vector & 1:
            out ^= matrix[i]
        vector >>= 1
        i += 1
    return out


def joined_crc(first: int, second: int, second_bytes: int) -> int:
    """The crc32 of two strings one after the other, from theirs."""
    bits, k = second_bytes * 8, 0
    while bits:
        if bits & 1:
            first = _apply(_zero_operators()[k], first)
        bits >>= 1
        k += 1
    return first ^ second


def document_digests(spark: SparkSession, path: str) -> DataFrame:
    """(doc_id, start, n_tokens, ids_crc32) from token files; no ids leave the tasks that decode them."""
    pieces = read_pieces(spark, path, with_ids=False).groupBy("shard", "doc").agg(F.min("doc_id").alias("doc_id"), F.min("first_id").alias("first_id"), F.sum("n").alias("n_tokens"), F.sort_array(F.collect_list(F.struct("piece", "n", "crc"))).alias("p"))

    def join(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            crcs = []
            for p in batch.column("p").to_pylist():
                crc = p[0]["crc"]
                for x in p[1:]:
                    crc = joined_crc(crc, x["crc"], 4 * x["n"])
                crcs.append(crc)
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in ("shard", "doc_id", "first_id", "n_tokens")), pa.array(crcs, pa.int64())], names=["shard", "doc_id", "first_id", "n_tokens", "ids_crc32"])

    whole = pieces.mapInArrow(join, "shard long, doc_id long, first_id long, n_tokens long, ids_crc32 long")
    return whole.join(shard_starts(spark, path), "shard").select("doc_id", (F.col("before") + F.col("first_id")).alias("start"), "n_tokens", "ids_crc32")


def op3_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = shared_dir(spark)
    write_tokens(read_table(spark, sf_dir, "documents"), path)
    return document_digests(spark, path)
