"""Tokenising, token files and the coder: exact against the libraries and in round trips."""

from __future__ import annotations

import random
import struct
import zlib

import numpy as np
import public_tokenizers as P
import pyarrow as pa
import pytest
import tiktoken
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from chronoloom.llm import byte_bpe, context_coder, token_files
from tests.llm import helpers as h


def odd_texts(n: int = 400) -> list[str | None]:
    r = random.Random(3)
    alphabet = [chr(c) for c in [*range(1, 0x250), 0x85, 0xA0, 0x1680, 0x2028, 0x3000, 0xFEFF, 0x1F600, 0x301, 0x130, 0x4E00, 0x661, 0x1100, 0x1161, *range(0x390, 0x3D0), *range(0x600, 0x640)]] + [" "] * 200 + ["'s", "'ll", "\n", "\r\n", "<|endoftext|>", "a<|startoftext|>B"] * 15
    return [None, "", " ", *("".join(r.choice(alphabet) for _ in range(r.randrange(60))) for _ in range(n))] + [r[1] for r in h.documents()]


# -- byte-level BPE ------------------------------------------------------------------------------------


@pytest.mark.parametrize("block_bytes", [200, 16_000_000])
def test_ids_are_the_librarys(spark, block_bytes):
    ranks = byte_bpe.load_ranks(P.path(byte_bpe.VOCABULARY))
    enc = tiktoken.Encoding("test", pat_str=P.PATTERN, mergeable_ranks=ranks, special_tokens={})
    texts = odd_texts()
    df = h.frame(spark, [(i, t, None, None, None) for i, t in enumerate(texts)])
    got = {r["doc_id"]: (list(r["ids"]), bytes(r["decoded"])) for r in byte_bpe.decode(byte_bpe.encode(df, block_bytes=block_bytes)).collect()}
    assert got == {i: (enc.encode_ordinary(t or ""), (t or "").encode()) for i, t in enumerate(texts)}


def test_bpe_of_repeated_rows_null_ids_and_empty_tables(spark):
    df = h.frame(spark, [(None, "a b", None, None, None), (1, "a b", None, None, None), (1, "a b", None, None, None), (None, None, None, None, None)])
    got = byte_bpe.encode(df.withColumn("block", F.lit(1)).withColumn("ids", F.lit("x"))).collect()
    assert sorted((r["doc_id"] or -1, len(r["ids"])) for r in got) == [(-1, 0), (-1, 2), (1, 2), (1, 2)]
    empty = byte_bpe.decode(byte_bpe.encode(df.limit(0)))
    assert empty.count() == 0 and empty.columns == ["doc_id", "ids", "decoded"]
    nulls = spark.createDataFrame([(1, None), (2, [])], "k int, ids array<int>")
    assert [bytes(r["decoded"]) for r in byte_bpe.decode(nulls).collect()] == [b"", b""]


@settings(max_examples=60, deadline=None)
@given(st.lists(st.integers(0, 2**21), max_size=300))
def test_packed_sequences_come_back(values):
    a = np.array(values, np.uint32)
    assert (byte_bpe._unpack_seq(byte_bpe._pack_seq(a)) == a).all() and (byte_bpe._unpack(byte_bpe._pack(a)) == a).all()


# -- the coder ---------------------------------------------------------------------------------------------


def coded(spark, blocks: list[np.ndarray], size: int) -> list[bytes]:
    df = spark.createDataFrame([(i, b.astype("<u4").tobytes()) for i, b in enumerate(blocks)], "i int, ids binary")
    return [bytes(r["x"]) for r in df.select("i", context_coder.encoded(spark, F.col("ids"), size).alias("x")).orderBy("i").collect()]


def ids_of(spark, data: list[bytes]) -> list[list[int]]:
    df = spark.createDataFrame(list(enumerate(data)), "i int, x binary")
    return [np.frombuffer(bytes(r["ids"]), "<u4").tolist() for r in df.select("i", context_coder.decoded(spark, F.col("x")).alias("ids")).orderBy("i").collect()]


def plainly_decoded(block: bytes) -> list[int]:
    """The format again in plain Python, with a list of counts and exact sums."""
    size, n = struct.unpack_from("<II", block, 4)
    code, at = block[24:], 6
    value, width = int.from_bytes(code[:6].ljust(6, b"\0")), 1 << 48
    counts, second, first, weights, adapted = [1] * size, {}, {}, {}, {}
    before = last = 0
    out = []
    for _ in range(n):
        h = lambda x: x & 0xFFFFFFFF
        k2 = h((h(last * 0x9E3779B1) ^ h(before * 0x85EBCA6B)) * 0xC2B2AE35) >> 17 if out else 0
        k1 = h(last * 0x9E3779B1) >> 17 if out else 0
        (c2, s2), ((a, sa), (b, sb)) = second.get(k2, (0, 0)), first.get(k1, ((0, 0), (0, 0)))
        key = s2, sa, min(sb, 3), s2 > 0 and sa > 0 and c2 == a, s2 > 0 and sb > 0 and c2 == b
        start2 = 16384 * (s2 + 1) // 12 if s2 else 0
        w2, w1 = weights.get(key, (start2, (16384 - start2) // 4 if sa else 0))
        total = sum(counts)
        m2 = total * w2 // (16384 - w2 - w1) if s2 else 0
        m1 = total * w1 // (16384 - w2 - w1) if sa else 0
        mb = m1 * sb // max(1, sa + sb)
        ma = m1 - mb
        share: dict[int, int] = {}
        for c, sure, mass in ((c2, s2, m2), (a, sa, ma), (b, sb, mb)):
            if sure:
                share[c] = share.get(c, counts[c]) + mass
        entries = [*share.items(), *((x, f) for x, f in enumerate(counts) if x not in share)]
        everything = sum(f for _, f in entries)
        unit = width // everything
        slot, begin = min(value // unit, everything - 1), 0
        for x, f in entries:
            if slot < begin + f:
                break
            begin += f
        value, width = value - unit * begin, unit * f
        while width < 1 << 32:
            value, width, at = value << 16 | int.from_bytes(code[at : at + 2].ljust(2, b"\0")), width << 16, at + 2
        out.append(x)
        hit2, hit_a, hit_b = s2 > 0 and c2 == x, sa > 0 and a == x, sb > 0 and b == x
        p2, p1 = m2 * hit2, ma if hit_a else mb if hit_b else 0
        pace = min(6, 2 + adapted.get(key, 0) // 8)
        adapted[key] = adapted.get(key, 0) + 1
        w2 += (p2 * 16384 // (p2 + p1 + counts[x]) - w2) >> pace
        w1 += (p1 * 16384 // (p2 + p1 + counts[x]) - w1) >> pace
        over = max(0, w2 + w1 - (16384 - 256))
        weights[key] = (w2 - over, w1) if w2 > w1 else (w2, w1 - over)
        surer = lambda c, sure: (c, min(7, sure + 1))
        doubted = lambda c, sure: (c, sure // 2) if sure > 1 else (x, 1)
        second[k2] = surer(c2, s2) if hit2 else doubted(c2, s2)
        if hit_a:
            first[k1] = surer(a, sa), (b, sb)
        elif hit_b:
            pair = (a, sa - (sa > 1)), surer(b, sb)
            first[k1] = pair[::-1] if pair[1][1] > pair[0][1] else pair
        elif not sa:
            first[k1] = (x, 1), (b, sb)
        else:
            first[k1] = (a, sa), doubted(b, sb)
        counts[x] += 24
        if sum(counts) > 1 << 20:
            counts = [(c + 1) // 2 for c in counts]
        before, last = last, x + 1
    return out


@settings(max_examples=8, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.lists(st.lists(st.integers(0, 49_999), max_size=700), min_size=1, max_size=6))
def test_blocks_come_back(spark, blocks):
    data = coded(spark, [np.array(b, np.uint32) for b in blocks], 50_000)
    assert ids_of(spark, data) == blocks


def test_the_format_is_what_it_says(spark):
    r = random.Random(4)
    blocks = [[min(int(r.expovariate(0.05)), 199) for _ in range(600)], [r.randrange(9) // 3 for _ in range(500)], [5, 6, 7, 8, 5, 6, 9] * 60, [], [3]]
    for size in (200, 1000):
        data = coded(spark, [np.array(b, np.uint32) for b in blocks], size)
        assert [plainly_decoded(x) for x in data] == blocks == ids_of(spark, data)


def test_long_skewed_blocks_come_back_and_get_smaller(spark):
    rng = np.random.default_rng(0)
    blocks = [np.minimum(rng.geometric(0.01, n), 999).astype(np.uint32) for n in (32768, 70_000, 8191, 129, 1)]
    blocks += [np.tile(rng.integers(0, 60_000, 50), 100).astype(np.uint32), np.zeros(5000, np.uint32)]
    data = coded(spark, blocks, 1 << 16)
    assert ids_of(spark, data) == [b.tolist() for b in blocks]
    # alone or with others, a block's code is the same: blocks are independent
    assert coded(spark, [blocks[2]], 1 << 16)[0] == data[2]
    sizes = [len(c) for c in data]
    assert sizes[0] < 1.1 * 32768 and sizes[-2] < 1000 and sizes[-1] < 100


def test_order_0_goes_on_learning_in_the_second_half(spark):
    rng = np.random.default_rng(2)
    halves = [rng.integers(0, 100, 16384), 40_000 + rng.integers(0, 100, 16384)]
    first, both = coded(spark, [halves[0], np.concatenate(halves)], 50_000)
    # ids that come in the second half only cost little more than those of the first
    assert len(both) < 2.3 * len(first)


def test_ids_without_pattern_cost_little_more_than_their_bits(spark):
    rng = np.random.default_rng(1)
    for bits in (16, 20):
        blocks = [rng.integers(0, 1 << bits, n).astype(np.uint32) for n in (5000, 5000, 90)]
        data = coded(spark, blocks, 1 << bits)
        assert ids_of(spark, data) == [b.tolist() for b in blocks]
        assert sum(map(len, data)) * 8 < 1.06 * bits * 10_090


def test_damage_is_noticed(spark):
    data = coded(spark, [np.arange(300, dtype=np.uint32)], 1 << 16)[0]
    for at in (0, 4, 9, 13, 17, 21, 30, len(data) - 1):
        bad = bytearray(data)
        bad[at] ^= 1
        with pytest.raises(Exception, match="corrupt block"):
            ids_of(spark, [bytes(bad)])
    with pytest.raises(Exception, match="corrupt block"):
        ids_of(spark, [data[:10]])
    with pytest.raises(Exception, match="is not below"):
        coded(spark, [np.array([7], np.uint32)], 7)


# -- token files -----------------------------------------------------------------------------------------------


@pytest.fixture(scope="module")
def tokenizer():
    return Tokenizer.from_file(P.path(token_files.TOKENIZER))


def digests(ids: list[list[int]]) -> list[tuple]:
    out, at = [], 0
    for x in ids:
        out.append((at, len(x), zlib.crc32(np.array(x, "<u4").tobytes())))
        at += len(x)
    return out


@pytest.mark.parametrize("block_ids", [64, 8192])
def test_files_hold_the_librarys_ids(spark, tmp_path, tokenizer, block_ids):
    texts = odd_texts()
    df = h.frame(spark, [(i, t, None, None, None) for i, t in enumerate(texts)][::-1]).withColumn("shard", F.lit("x"))
    path = str(tmp_path / "ids")
    token_files.write_tokens(df, path, block_ids=block_ids)
    want = [tokenizer.encode(t or "", add_special_tokens=False).ids + [2] for t in texts]
    got = {r["doc_id"]: list(r["ids"]) for r in token_files.read_tokens(spark, path).collect()}
    assert [got[i] for i in range(len(texts))] == want
    rows = token_files.document_digests(spark, path).orderBy("doc_id").collect()
    assert [tuple(r)[1:] for r in rows] == digests(want) and [r["doc_id"] for r in rows] == list(range(len(texts)))


def test_files_of_repeated_ids_and_empty_tables(spark, tmp_path, tokenizer):
    rows = [(3, "b", None, None, None), (3, "a", None, None, None), (None, "c", None, None, None), (3, "a", None, None, None)]
    token_files.write_tokens(h.frame(spark, rows), str(tmp_path / "a"))
    got = token_files.document_digests(spark, str(tmp_path / "a")).orderBy("start").collect()
    assert [r["doc_id"] for r in got] == [None, 3, 3, 3] and [r["start"] for r in got] == [0, 2, 4, 6]
    assert got[1]["ids_crc32"] == got[2]["ids_crc32"] != got[3]["ids_crc32"]
    token_files.write_tokens(h.frame(spark, rows).limit(0), str(tmp_path / "b"))
    assert token_files.document_digests(spark, str(tmp_path / "b")).count() == 0 and token_files.read_tokens(spark, str(tmp_path / "b")).count() == 0


def test_a_tokenizer_of_other_parts_encodes_whole_texts():
    e = token_files.RunEncoder(P.path("byte_bpe_50k.json"))
    t = Tokenizer.from_file(P.path("byte_bpe_50k.json"))
    texts = [x for x in odd_texts(50)]
    ids, sizes = e.encode(pa.array(texts, pa.string()), 7)
    want = [t.encode(x or "", add_special_tokens=False).ids + [7] for x in texts]
    assert not e.plain and ids.tolist() == [i for w in want for i in w] and sizes.tolist() == list(map(len, want))


def test_chunks_of_texts_and_none(tokenizer):
    e = token_files.RunEncoder(P.path(token_files.TOKENIZER))
    for texts in (["a b c d e"], [None, "f g h", "", " "], ["a é", "x" * 100_000], []):
        ids, sizes = e.encode(pa.array(texts, pa.string()), 2)
        want = [tokenizer.encode(t or "", add_special_tokens=False).ids + [2] for t in texts]
        assert ids.tolist() == [i for w in want for i in w] and sizes.tolist() == list(map(len, want))


def test_a_very_long_document_spans_blocks(spark, tmp_path, tokenizer):
    text = " ".join(f"word{i % 977} of, many" for i in range(60_000))
    token_files.write_tokens(h.frame(spark, [(1, text, None, None, None), (2, "b", None, None, None)]), str(tmp_path / "long"))
    want = [tokenizer.encode(t, add_special_tokens=False).ids + [2] for t in (text, "b")]
    assert [tuple(r)[1:] for r in token_files.document_digests(spark, str(tmp_path / "long")).orderBy("doc_id").collect()] == digests(want)


@settings(max_examples=50, deadline=None)
@given(st.binary(max_size=60), st.binary(max_size=60))
def test_crc_of_pieces(a, b):
    assert token_files.joined_crc(zlib.crc32(a), zlib.crc32(b), len(b)) == zlib.crc32(a + b)
