"""Vectorised word, line and shingle hashing over Arrow string columns.

All functions work on the UTF-8 bytes of a slice of texts at once. Words are
runs of bytes outside ``[\\x20\\x09-\\x0D]``; every such byte is ASCII, so byte
runs are code point runs. Hashes are 64-bit: eight bytes at a time are mixed into
a span's state by a bijection that all its bits go through, all spans together, so
a span costs as many steps as it has eight bytes, and no Python loop over bytes.

A text is a slice of its own if it is longer than ``SLICE_BYTES``; what is made of
it on the way takes some ten times its bytes.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from hashlib import blake2b

import numpy as np
import pyarrow as pa

#: Texts are hashed so many bytes at a time: intermediate arrays take some twenty times that.
SLICE_BYTES = 400_000

_rng = np.random.default_rng(20240229)
_ODD = _rng.integers(1, 2**63, 64, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
#: Spans longer than this are hashed one by one, each as a whole: eight bytes at a time pay for many short spans only.
LONG_SPAN = 128
_HEAD = np.array([(1 << 8 * k) - 1 for k in range(8)] + [2**64 - 1], np.uint64)

SPACE = np.zeros(256, bool)
SPACE[[0x20, *range(0x09, 0x0E)]] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[0x41:0x5B] += 32
#: True for bytes that begin a code point.
LEAD = np.ones(256, bool)
LEAD[0x80:0xC0] = False

def mix(h: np.ndarray) -> np.ndarray:
    """A bijection on 64-bit integers whose output bits depend on all input bits."""
    h = (h ^ (h >> np.uint64(33))) * np.uint64(0xFF51AFD7ED558CCD)
    h = (h ^ (h >> np.uint64(33))) * np.uint64(0xC4CEB9FE1A85EC53)
    return h ^ (h >> np.uint64(33))


def spans(raw: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Hashes of the byte spans ``raw[starts[i]:ends[i]]``; equal spans have equal hashes wherever they stand."""
    padded = np.concatenate([raw, np.zeros(8, np.uint8)])
    # the eight bytes that begin at each byte
    eights = np.ndarray(len(raw) + 1, "<u8", padded.data, strides=(1,))
    size = ends - starts
    out = mix((size.astype(np.uint64) + np.uint64(1)) * _ODD[62])
    long = np.flatnonzero(size > LONG_SPAN)
    open_ = np.flatnonzero(size <= LONG_SPAN) if len(long) else np.arange(len(size))
    at, left = starts[open_], size[open_]
    while len(open_):
        out[open_] = mix(out[open_] ^ (eights[at] & _HEAD[np.minimum(left, 8)])) * _ODD[63]
        on = left > 8
        open_, at, left = open_[on], at[on] + 8, left[on] - 8
    for i in long.tolist():
        out[i] = int.from_bytes(blake2b(raw[starts[i] : ends[i]].tobytes(), digest_size=8).digest(), "little")
    return out


def slices(texts: pa.Array, limit: int = SLICE_BYTES) -> Iterator[tuple[int, pa.Array]]:
    """(first row, slice) so that a slice has ``limit`` bytes at most, or one row."""
    if isinstance(texts, pa.ChunkedArray):
        texts = texts.combine_chunks()
    texts = texts.cast(pa.large_string()) if texts.type != pa.large_string() else texts
    if texts.null_count:
        texts = texts.fill_null("")
    ends = np.frombuffer(texts.buffers()[1], np.int64, len(texts) + 1 + texts.offset)[texts.offset :]
    at = 0
    while at < len(texts):
        to = max(at + 1, int(np.searchsorted(ends, ends[at] + limit, "right")) - 1)
        yield at, texts.slice(at, to - at)
        at = to


@dataclass
class Bytes:
    """The bytes of a slice of texts; ``off[i]:off[i+1]`` are those of text i."""

    raw: np.ndarray
    off: np.ndarray

    @classmethod
    def of(cls, texts: pa.Array) -> Bytes:
        off = np.frombuffer(texts.buffers()[1], np.int64, len(texts) + 1 + texts.offset)[texts.offset :]
        data = texts.buffers()[2]
        raw = np.frombuffer(data, np.uint8)[off[0] : off[-1]] if data is not None and off[-1] > off[0] else np.zeros(0, np.uint8)
        return cls(raw, off - off[0])

    def counts(self, mask: np.ndarray) -> np.ndarray:
        """How many bytes of each text the mask selects."""
        total = np.concatenate([[0], np.cumsum(mask, dtype=np.int64)])
        return total[self.off[1:]] - total[self.off[:-1]]

    def runs(self, inside: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Starts, ends and text numbers of the runs of ``inside`` bytes."""
        edge = np.zeros(len(self.raw) + 1, bool)
        edge[self.off[:-1]] = True
        edge = edge[:-1]
        before = np.concatenate([[False], inside[:-1]]) if len(inside) else inside
        starts = np.flatnonzero(inside & (~before | edge))
        after = np.concatenate([~inside[1:] | edge[1:], [True]]) if len(inside) else inside
        ends = np.flatnonzero(inside & after) + 1
        return starts, ends, np.searchsorted(self.off, starts, "right") - 1


@dataclass
class Words:
    """Words of a slice of texts: hash, text number; ``first[i]:first[i+1]`` are those of text i."""

    hash: np.ndarray
    doc: np.ndarray
    first: np.ndarray
    starts: np.ndarray
    ends: np.ndarray

    @classmethod
    def of(cls, b: Bytes, lower: bool) -> Words:
        starts, ends, doc = b.runs(~SPACE[b.raw])
        hashes = spans(LOWER[b.raw] if lower else b.raw, starts, ends)
        return cls(hashes, doc, np.searchsorted(doc, np.arange(len(b.off))), starts, ends)

    def windows(self, k: int) -> tuple[np.ndarray, np.ndarray]:
        """Positions of the first words of the k-word windows within one text, and the windows' hashes."""
        n = max(0, len(self.hash) - k + 1)
        at = np.flatnonzero(self.doc[:n] == self.doc[k - 1 : k - 1 + n])
        h = np.zeros(len(at), np.uint64)
        for j in range(k):
            h += self.hash[at + j] * _ODD[j]
        return at, mix(h)


def shingle_sets(texts: pa.Array, k: int) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """For slices of texts: the first row, the sorted distinct shingle hashes of all its texts, one
    text's after another's, and their bounds.

    A text of fewer than k words has one shingle, all its words; one without words has none.
    """
    for row, part in slices(texts):
        w = Words.of(Bytes.of(part), lower=True)
        at, h = w.windows(k)
        doc = w.doc[at]
        n_words = np.diff(w.first)
        short = np.flatnonzero((n_words > 0) & (n_words < k))
        if len(short):
            whole = np.zeros(len(short), np.uint64)
            for j in range(k - 1):
                has = n_words[short] > j
                whole[has] += w.hash[w.first[short[has]] + j] * _ODD[j]
            h = np.concatenate([h, mix(whole + n_words[short].astype(np.uint64))])
            doc = np.concatenate([doc, short])
        order = np.lexsort((h, doc)) if len(part) > 1 else np.argsort(h)
        h, doc = h[order], doc[order]
        new = np.ones(len(h), bool)
        new[1:] = (h[1:] != h[:-1]) | (doc[1:] != doc[:-1])
        h, doc = h[new], doc[new]
        yield row, h, np.searchsorted(doc, np.arange(len(part) + 1))
