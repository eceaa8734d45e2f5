"""Statistics of texts that a quality classifier can read."""

from __future__ import annotations

import numpy as np
import pyarrow as pa

from chronoloom.llm.textops import LEAD, SPACE, Bytes, Words, slices, spans

NAMES = (
    "log_words", "chars_per_word", "symbol_share", "upper_share", "digit_share", "bang_share", "pipe_share", "point_share",
    "foreign_share", "words_per_line", "dup_line_share", "repeat_share", "unique_share", "adjacent_share", "space_share",
)

_GOLDEN = np.uint64(0x9E3779B97F4A7C15)


def _table(*members: bytes | range) -> np.ndarray:
    out = np.zeros(256, bool)
    for m in members:
        out[list(m)] = True
    return out


_UPPER, _LOWER, _DIGIT = _table(range(0x41, 0x5B)), _table(range(0x61, 0x7B)), _table(range(0x30, 0x3A))
_SYMBOL, _BANG, _PIPE, _POINT, _FOREIGN = _table(b"#*$%&<>_=+~^@{}[]\\/`"), _table(b"!"), _table(b"|"), _table(b".,;:?'\"()-"), _table(range(0xC0, 0x100))


def _distinct(keys: np.ndarray, doc: np.ndarray, n: int) -> np.ndarray:
    _, first = np.unique(keys + doc.astype(np.uint64) * _GOLDEN, return_index=True)
    return np.bincount(doc[first], minlength=n)


def statistics(texts: pa.Array) -> np.ndarray:
    """A row of NAMES for each text; a null or empty text has zeros."""
    found = []
    for _, part in slices(texts):
        b, n = Bytes.of(part), len(part)
        w = Words.of(b, lower=True)
        words = np.diff(w.first)
        share = lambda part, whole: part / np.maximum(whole, 1)
        chars = b.counts(LEAD[b.raw])
        upper, lower, foreign = (b.counts(t[b.raw]) for t in (_UPPER, _LOWER, _FOREIGN))

        _, tri = w.windows(3)
        at, _ = w.windows(3)
        distinct_tri = _distinct(tri, w.doc[at], n)
        n_tri = np.bincount(w.doc[at], minlength=n)
        pair = (w.hash[1:] == w.hash[:-1]) & (w.doc[1:] == w.doc[:-1])

        breaks = np.flatnonzero(b.raw == 10)
        ends, starts = np.sort(np.concatenate([breaks, b.off[1:]])), np.sort(np.concatenate([breaks + 1, b.off[:-1]]))
        doc = np.repeat(np.arange(n), np.diff(np.searchsorted(breaks, b.off)) + 1)
        inked = np.concatenate([[0], np.cumsum(~SPACE[b.raw])])
        has = inked[ends] > inked[starts]
        lines = np.bincount(doc[has], minlength=n)
        distinct_lines = _distinct(spans(b.raw, starts[has], ends[has]), doc[has], n)

        found.append(
            np.stack(
                [
                    np.log1p(words), share(b.counts(LEAD[b.raw] & ~SPACE[b.raw]), words), share(b.counts(_SYMBOL[b.raw]), chars), share(upper, upper + lower + foreign), share(b.counts(_DIGIT[b.raw]), chars),
                    share(b.counts(_BANG[b.raw]), words), share(b.counts(_PIPE[b.raw]), words), share(b.counts(_POINT[b.raw]), words), share(foreign, chars), share(words, lines),
                    share(lines - distinct_lines, lines), share(n_tri - distinct_tri, n_tri), share(_distinct(w.hash, w.doc, n), words), share(np.bincount(w.doc[1:][pair], minlength=n), words), share(b.counts(SPACE[b.raw]), chars),
                ],
                1,
            )
        )
    return np.concatenate(found) if found else np.zeros((0, len(NAMES)))
