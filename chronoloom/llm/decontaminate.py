"""Benchmark passages in documents, found by spaced seeds.

A seed is the hash of the tokens that a fixed mask selects from a window; the
tokens it skips may differ. Seeds of the benchmark's items are joined with those of
the documents, and along the diagonal of each hit the two texts are compared: the
overlap is the stretch with the highest score of +1 for equal and -2 for different
tokens. It counts if it has enough equal tokens (``needed``) and ``LEAST_IDENTITY``
of its tokens are equal; where tokens were put in or left out, the pieces before
and after count together.

No overlap is missed for want of a seed. No beginning of a highest-scoring stretch
has a score below 0, so with E for equal and D for different tokens it begins EEEE,
EEEDE or EEDEE, and for each of these there is a mask (``MASKS``). The token before
it differs, and so does what the mask skips, so a stretch is one row of the join. A
stretch that has the equal tokens it needs has them within its first 18, for the
same reason; where more than ``COMMON`` items have a seed, the join compares short
fingerprints of the next 21 tokens, so that a phrase that many items hold does not
make a pair of each with each document that holds it. Pieces that count together only
and all begin with such seeds lie on diagonals at most ``MOST_SHIFT`` apart: items with the same
common seeds at the same distances are one template, a text is joined with templates, and where two
diagonals of a template are so near, it is compared with all its items. Whatever made a pair, an
item with common seeds is then compared along every diagonal that a seed of the two gives.

Only seeds that some item may have leave a task: up to ``EXACT_SEEDS`` seeds of the
benchmark, or a bitmap of 2 ** ``MOST_BITS`` bits however many there are, tell which.
Equal items are compared once, and equal documents are.

Tokens are runs of letters, digits and non-ASCII characters, A-Z lower-cased,
so punctuation and spacing do not matter.

Defined results: null or empty texts on either side overlap with nothing; items
of fewer than 4 tokens are too short to tell and match nothing, those of 4 to 7
only as a whole; pieces that count together have 4 equal tokens each; of stretches with one score
the one that begins first counts, up to its last end with that score, and of diagonals
with equally many equal tokens the one whose stretch begins first; rows that share a doc_id or an
item_id, and rows without one, are each compared; an empty table on either side
gives no overlaps; texts of any length are compared whole; other columns, whatever
their names, pass through or are not read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from chronoloom.llm.common import discard, read_table, small_batches, store
from chronoloom.llm.textops import LOWER, Bytes, mix, slices, spans

#: Items of fewer tokens are found as a whole only; longer ones by the beginnings of stretches.
SHORT = 8
#: Token positions that seeds look at, and the one between them that differs: what a stretch begins with.
MASKS = (((0, 1, 2, 3), None), ((0, 1, 2, 4), 3), ((0, 1, 3, 4), 2))
LEAST_IDENTITY = 0.75
MOST_NEEDED = 12
#: Pieces on neighbouring diagonals count together if each has so many equal tokens and so few
#: tokens were put in or left out between them.
LEAST_PIECE, MOST_SHIFT = 4, 3
#: Items that may share a seed before the join looks at more tokens.
COMMON = 32
#: Tokens of which a row has fingerprints: three integers of seven bytes.
WINDOW, BYTES = 21, 7
#: Up to so many seeds are sent to all tasks as they are (8 MB at most), with a bitmap of few bits
#: before them; more as a bitmap of 32 MB alone.
EXACT_SEEDS = 1_000_000
FEW_BITS, MOST_BITS = 22, 28
#: Positions along diagonals that are compared at a time.
PART = 2_000_000

_TOKEN = np.zeros(256, bool)
_TOKEN[128:] = True
for _a, _b in ((0x30, 0x3A), (0x41, 0x5B), (0x61, 0x7B)):
    _TOKEN[_a:_b] = True


_rng = np.random.default_rng(7)
_MUL = _rng.integers(1, 2**63, (len(MASKS) + 1, SHORT), dtype=np.uint64) * np.uint64(2) + np.uint64(1)


def needed(n_tokens: int) -> int:
    """Equal tokens that prove an overlap with an item of so many tokens."""
    return n_tokens if n_tokens < SHORT else max(8, min(MOST_NEEDED, -(-8 * n_tokens // 10)))


def tokens(part: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Token hashes and their texts' numbers."""
    b = Bytes.of(part)
    starts, ends, doc = b.runs(_TOKEN[b.raw])
    return spans(LOWER[b.raw], starts, ends), doc


def begun(h: np.ndarray, doc: np.ndarray, lengths: set[int], absent: int, first: np.ndarray | None = None, keep=None) -> np.ndarray:
    """A row for each place and mask: place, seed, token before, token skipped, fingerprints of the tokens from there.

    ``absent`` stands for what is not there: another on either side, so that it is never equal.
    ``lengths`` are those of whole items; with ``first`` only windows at a text's start. ``keep``
    tells which seeds to keep.
    """
    out = []
    for kind, (mask, gap) in [(k, m) for k, m in enumerate(MASKS)] + [(len(MASKS), (tuple(range(n)), None)) for n in sorted(lengths)]:
        if first is not None and (kind == len(MASKS)) != (len(h) < SHORT):
            continue
        at = np.arange(max(0, len(h) - mask[-1]))
        at = at[doc[at] == doc[at + mask[-1]]]
        seed = np.zeros(len(at), np.uint64)
        for j, o in enumerate(mask):
            seed += h[at + o] * _MUL[kind, j]
        seed = mix(seed + np.uint64(len(mask)))
        if keep is not None:
            hit = keep(seed)
            at, seed = at[hit], seed[hit]
        begins = np.ones(len(at), bool)
        begins[at > 0] = doc[at[at > 0] - 1] != doc[at[at > 0]]
        before = np.where(begins, np.uint64(absent), h[np.maximum(at - 1, 0)])
        # a whole item, and a beginning without a gap, have nothing that must differ: its absence on either side does
        skipped = np.full(len(at), absent, np.uint64) if gap is None else h[at + gap]
        if kind == len(MASKS):
            before = np.full(len(at), absent, np.uint64)
        out.append(np.stack([at.astype(np.uint64), seed, before, skipped]))
    at, seed, before, skipped = np.concatenate(out, 1) if out else np.zeros((4, 0), np.uint64)
    place = at.astype(np.int64)
    prints = np.zeros((WINDOW // BYTES, len(place)), np.uint64)
    for j in range(WINDOW):
        there = np.minimum(place + j, max(0, len(h) - 1))
        inside = (place + j < len(h)) & (doc[there] == doc[place]) if len(h) else np.zeros(0, bool)
        byte = np.where(inside, np.uint64(1) + h[there] % np.uint64(127), np.uint64(128 * absent)) if len(h) else np.zeros(0, np.uint64)
        prints[j // BYTES] |= byte << np.uint64(8 * (j % BYTES))
    return np.stack([at, seed, before, skipped, *prints])


#: Columns of ``begun`` in tables.
_BEGUN = ("at", "seed", "before", "skipped", "w0", "w1", "w2")


def _equal_prints(a: str, b: str) -> str:
    """SQL: how many of two rows' fingerprints are equal."""
    zeros = lambda x: f"(7 - bit_count(((({x}) & 35887507618889599L) + 35887507618889599L | ({x})) & 36170086419038336L))"
    return " + ".join(zeros(f"{a}.w{k} ^ {b}.w{k}") for k in range(WINDOW // BYTES))


def _lists(values: np.ndarray, of: np.ndarray, n: int, kind: pa.DataType) -> pa.Array:
    """A list for each of n rows; ``of`` is sorted."""
    return pa.ListArray.from_arrays(pa.array(np.searchsorted(of, np.arange(n + 1)), pa.int32()), pa.array(values, kind))


class Seeds:
    """Which seeds may be among some: exactly while these are few, beyond it by a bitmap of a fixed size."""

    def __init__(self, rows: DataFrame, column: str, n: int, exact: int = EXACT_SEEDS):
        self.sorted = None
        bits = FEW_BITS if n <= exact else MOST_BITS
        self.shift, self.words = np.uint64(64 - bits), np.zeros(1 << (bits - 6), np.uint64)
        if n <= exact:
            self.sorted = np.unique(np.array([r[0] for r in rows.select(column).distinct().collect()], np.int64).view(np.uint64))
            at = self.sorted >> self.shift
            np.bitwise_or.at(self.words, (at >> np.uint64(6)).astype(np.int64), np.uint64(1) << (at & np.uint64(63)))
        else:
            words = rows.selectExpr(f"shiftrightunsigned({column}, {64 - bits}) AS at").selectExpr("shiftright(at, 6) AS w", "shiftleft(1L, CAST(at & 63 AS INT)) AS b").groupBy("w").agg(F.bit_or("b").alias("b"))
            for r in words.toLocalIterator():
                self.words[r["w"]] = np.uint64(r["b"] & 0xFFFFFFFFFFFFFFFF)

    def has(self, seed: np.ndarray) -> np.ndarray:
        at = seed >> self.shift
        out = (self.words[(at >> np.uint64(6)).astype(np.int64)] >> (at & np.uint64(63)) & np.uint64(1)).astype(bool)
        if self.sorted is not None and out.any():
            hit = np.flatnonzero(out)
            place = np.minimum(np.searchsorted(self.sorted, seed[hit]), len(self.sorted) - 1)
            out[hit] = self.sorted[place] == seed[hit]
        return out


class Index:
    """The benchmark in the shared folder: items, their distinct token sequences and those's seeds."""

    def __init__(self, benchmark: DataFrame, text: str = "text", item_id: str = "item_id"):
        spark = benchmark.sparkSession

        def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                for row, part in slices(batch.column(1)):
                    h, doc = tokens(part)
                    ends = np.searchsorted(doc, np.arange(len(part) + 1))
                    raw = [h[a:b].tobytes() for a, b in zip(ends, ends[1:])]
                    yield pa.RecordBatch.from_arrays([batch.column(0).slice(row, len(part)), pa.array(raw, pa.binary())], names=["item_id", "tokens"])

        def seeded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                out = [np.zeros((2 + len(_BEGUN), 0), np.int64)]
                for cls, raw in zip(*(c.to_pylist() for c in batch.columns)):
                    h = np.frombuffer(raw, np.uint64)
                    rows = begun(h, np.zeros(len(h), np.int8), {len(h)} if len(h) < SHORT else set(), 1, first=np.zeros(1)).view(np.int64)
                    out.append(np.concatenate([np.full((1, rows.shape[1]), cls), np.full((1, rows.shape[1]), needed(len(h))), rows]))
                yield pa.RecordBatch.from_arrays([pa.array(c) for c in np.concatenate(out, 1)], names=["cls", "needed", *_BEGUN])

        items = benchmark.select(F.col(item_id).cast("long").alias("item_id"), F.col(text).alias("t"))
        items = store(items.mapInArrow(read, "item_id long, tokens binary").where("length(tokens) >= 32"))
        self.classes = store(items.select("tokens").distinct().withColumn("cls", F.monotonically_increasing_id()))
        self.items = store(items.join(self.classes, "tokens").select("cls", "item_id"))
        discard(items)
        found = self.classes.select("cls", "tokens").mapInArrow(seeded, ", ".join(f"{c} long" for c in ("cls", "needed", *_BEGUN)))
        found = store(found)
        many = found.groupBy("seed").agg((F.count_distinct("cls") > COMMON).alias("common"))
        self.seeds = store(found.join(many, "seed"))
        discard(found)
        n_seeds, n_common = self.seeds.agg(F.count(F.lit(1)), F.count_if("common")).first()
        # items by the places of their common seeds: a hash that two share makes pairs too many, never too few
        self.alike = self.templates = None
        if n_common:
            common = self.seeds.where("common").groupBy("cls").agg(F.array_sort(F.collect_set(F.struct("at", "seed"))).alias("places"))
            common = common.withColumn("places", F.expr("transform(places, x -> struct(x.at - places[0].at AS at, x.seed AS seed))"))
            self.alike = store(common.select("cls", F.xxhash64("places").alias("template"), "places"))
            self.templates = store(self.alike.select("template", F.explode("places").alias("p")).select("template", "p.at", "p.seed").distinct())
        self.known = Seeds(self.seeds, "seed", n_seeds)
        lengths = self.classes.where(f"length(tokens) < {8 * SHORT}").select((F.length("tokens") / 8).cast("int").alias("n")).distinct().collect()
        self.lengths = {r["n"] for r in lengths}
        self.spark, self.empty = spark, n_seeds == 0

    def discard(self) -> None:
        """Delete its tables once what was found is written."""
        for table in (self.classes, self.items, self.seeds, self.alike, self.templates):
            if table is not None:
                discard(table)


def text_key(text: Column) -> list[Column]:
    return [F.xxhash64(text).alias("f1"), F.xxhash64(F.lit(1), text).alias("f2")]


def candidates(docs: DataFrame, index: Index, text: str) -> DataFrame:
    """(f1, f2, tokens, begun): the texts that hold seeds of the benchmark, with the rows of these."""
    lengths, shared = index.lengths, docs.sparkSession.sparkContext.broadcast(index.known)

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row, part in slices(batch.column(2)):
                h, doc = tokens(part)
                found = begun(h, doc, lengths, 0, keep=shared.value.has)
                at = found[0].astype(np.int64)
                if not len(at):
                    continue
                order = np.argsort(at, kind="stable")
                at, found = at[order], found[:, order].view(np.int64)
                rows, of = np.unique(doc[at], return_inverse=True)
                first = np.searchsorted(doc, np.arange(len(part) + 1))
                found[0] -= first[doc[at]]
                raw = [h[first[d] : first[d + 1]].tobytes() for d in rows]
                keys = [batch.column(k).slice(row, len(part)).take(pa.array(rows)) for k in (0, 1)]
                yield pa.RecordBatch.from_arrays([*keys, pa.array(raw, pa.binary()), *(_lists(x, of, len(rows), pa.int64()) for x in found)], names=["f1", "f2", "tokens", *_BEGUN])

    rows = docs.where(F.col(text).isNotNull()).select(*text_key(F.col(text)), F.col(text).alias("t"))
    return rows.mapInArrow(read, "f1 long, f2 long, tokens binary, " + ", ".join(f"{c} array<long>" for c in _BEGUN))


def best_stretches(doc: np.ndarray, items: list[np.ndarray], of: np.ndarray, base: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """First token, last token + 1 and equal tokens of the highest-scoring stretch on each diagonal.

    Diagonal i compares item ``of[i]``, whose first token would stand at ``base[i]`` of the document.
    """
    sizes = np.array([len(x) for x in items], np.int64)
    start = np.concatenate([[0], np.cumsum(sizes)])
    flat = np.concatenate(items) if items else np.zeros(0, np.uint64)
    a = np.maximum(base, 0)
    n = np.maximum(0, np.minimum(len(doc), base + sizes[of]) - a)
    out = np.zeros((3, len(base)), np.int64)
    cuts, lo = np.cumsum(n + 1), 0
    while lo < len(base):
        hi = max(lo + 1, int(np.searchsorted(cuts, (cuts[lo - 1] if lo else 0) + PART, "right")))
        m, aa, bb, oo = n[lo:hi], a[lo:hi], base[lo:hi], of[lo:hi]
        # each diagonal has one entry more than tokens: the sums before and after each token
        ends = np.cumsum(m + 1)
        first = ends - (m + 1)
        seg = np.repeat(np.arange(hi - lo), m + 1)
        i = np.arange(ends[-1]) - first[seg]
        inner = i > 0
        at = aa[seg[inner]] + i[inner] - 1
        equal = np.zeros(ends[-1], np.int64)
        equal[inner] = doc[at] == flat[start[oo[seg[inner]]] + at - bb[seg[inner]]]
        same = np.cumsum(equal)
        score = np.zeros(ends[-1], np.int64)
        score[inner] = np.where(equal[inner] > 0, 1, -2)
        total = np.cumsum(score)
        # sums of a later diagonal lie below all of an earlier one, so the least so far is its own
        total = total - total[first][seg] - seg * (3 * int(m.max(initial=0)) + 3)
        low = np.minimum.accumulate(total)
        lowest = np.ones(ends[-1], bool)
        lowest[1:] = total[1:] < low[:-1]
        since = np.maximum.accumulate(np.where(lowest, np.arange(ends[-1]), 0))
        rise = total - low
        top = np.maximum.reduceat(rise, first)
        reached = np.flatnonzero(rise == top[seg])
        begin = since[reached[np.unique(seg[reached], return_index=True)[1]]]
        # of stretches with one score the first, and of its ends the last
        reached = reached[since[reached] == begin[seg[reached]]]
        end = reached[np.append(np.flatnonzero(np.diff(seg[reached])), len(reached) - 1)]
        out[:, lo:hi] = aa + begin - first, aa + end - first, same[end] - same[begin]
        lo = hi
    return out[0], out[1], out[2]


def _chained(pieces: list[tuple[int, int, int, int]], size: int) -> tuple[int, int, int]:
    """Pieces that follow each other in text and item alike, with few tokens put in or left out between them."""
    best = (0, 0, 0)
    for a, b, same, base in sorted(pieces):
        if best[2] and a >= best[1] and abs(base - last) <= MOST_SHIFT and b - best[0] <= 2 * size:
            best = (best[0], b, best[2] + same)
        elif same > best[2]:
            best = (a, b, same)
        else:
            continue
        last = base
    return best


def diagonals(doc: np.ndarray, items: list[np.ndarray]) -> list[np.ndarray]:
    """Where each item's first token would stand, for all seeds that a text and an item have in common."""
    of_item = lambda h: begun(h, np.zeros(len(h), np.int8), {len(h)} if len(h) < SHORT else set(), 1, first=np.zeros(1))
    own = [of_item(h) for h in items]
    of, own = np.repeat(np.arange(len(items)), [x.shape[1] for x in own]), np.concatenate(own, 1)
    known = np.unique(own[1])
    keep = lambda seed: known[np.minimum(np.searchsorted(known, seed), len(known) - 1)] == seed
    text = begun(doc, np.zeros(len(doc), np.int8), {len(h) for h in items if len(h) < SHORT}, 0, keep=keep)
    text = text[:, np.argsort(text[1], kind="stable")]
    lo, hi = np.searchsorted(text[1], own[1]), np.searchsorted(text[1], own[1], "right")
    i = np.repeat(np.arange(len(of)), hi - lo)
    j = np.arange(len(i)) - np.repeat(np.cumsum(hi - lo) - hi, hi - lo)
    met = (text[2][j] != own[2][i]) & (text[3][j] != own[3][i])
    base, of = text[0][j[met]].astype(np.int64) - own[0][i[met]].astype(np.int64), of[i[met]]
    return [np.unique(base[of == k]) for k in range(len(items))]


def proven(doc: np.ndarray, items: list[np.ndarray], bases: list[list[int]]) -> Iterator[tuple[int, int, int, int]]:
    """(item, first token, last token + 1, equal tokens) of the items that overlap, from their hits' diagonals."""
    of = np.repeat(np.arange(len(items)), [len(b) for b in bases])
    base = np.concatenate([np.zeros(0, np.int64), *(np.array(b, np.int64) for b in bases)])
    a, b, same = best_stretches(doc, items, of, base)
    good = np.flatnonzero((same >= LEAST_PIECE) & (same >= LEAST_IDENTITY * (b - a)))
    pieces: dict[int, list] = {}
    for i in good.tolist():
        pieces.setdefault(int(of[i]), []).append((int(a[i]), int(b[i]), int(same[i]), int(base[i])))
    for item, found in pieces.items():
        size = len(items[item])
        one = max(found, key=lambda x: (x[2], -x[0]))
        if one[2] < needed(size):
            one = _chained(found, size)
        if one[2] >= needed(size):
            yield item, one[0], one[1], one[2]


def overlapping_texts(docs: DataFrame, index: Index, text: str = "text") -> DataFrame:
    """(f1, f2, cls, first_token, end_token, n_equal, n_item) of the texts that overlap with a class of items."""
    found = store(candidates(docs, index, text))
    hits = found.select("f1", "f2", F.explode(F.arrays_zip(*_BEGUN)).alias("s")).select("f1", "f2", "s.*").distinct().alias("d")
    begins = "d.seed = i.seed AND d.before <> i.before AND d.skipped <> i.skipped"
    met = hits.join(index.seeds.alias("i"), F.expr(f"{begins} AND (NOT i.common OR {_equal_prints('d', 'i')} >= i.needed)"))
    met = met.select("f1", "f2", "cls", (F.col("d.at") - F.col("i.at")).alias("base"))
    classes = index.classes.withColumn("common", F.lit(False))
    if index.alike is not None:
        placed = hits.join(index.templates.alias("t"), "seed").select("f1", "f2", "template", (F.col("d.at") - F.col("t.at")).alias("base"))
        placed = placed.groupBy("f1", "f2", "template").agg(F.sort_array(F.collect_set("base")).alias("b"))
        near = placed.where(f"exists(zip_with(slice(b, 2, size(b)), b, (x, y) -> x - y), x -> x <= {MOST_SHIFT})").select("f1", "f2", "template")
        alike = index.alike.select("cls", "template")
        met = met.unionByName(near.join(alike, "template").select("f1", "f2", "cls", F.lit(None).cast("long").alias("base")))
        classes = index.classes.join(alike.select("cls", F.lit(True).alias("c")), "cls", "left").select("cls", "tokens", F.col("c").isNotNull().alias("common"))
    pairs = met.groupBy("f1", "f2", "cls").agg(F.collect_set("base").alias("bases"))
    # a text that hits very many items is compared in several tasks
    pairs = pairs.join(classes, "cls").withColumn("part", F.pmod(F.xxhash64("cls"), F.lit(64)))
    sides = pairs.groupBy("f1", "f2", "part").agg(F.collect_list(F.struct("cls", "bases", "tokens", "common")).alias("items"))
    texts = found.groupBy("f1", "f2").agg(F.first("tokens").alias("doc"))
    names = ["f1", "f2", "cls", "first_token", "end_token", "n_equal", "n_item"]

    def verify(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for f1, f2, doc, items in zip(*(c.to_pylist() for c in batch.columns)):
                own, doc = [np.frombuffer(x["tokens"], np.uint64) for x in items], np.frombuffer(doc, np.uint64)
                bases, common = [x["bases"] for x in items], [i for i, x in enumerate(items) if x["common"]]
                for i, base in zip(common, diagonals(doc, [own[i] for i in common]) if common else []):
                    bases[i] = base
                for i, *rest in proven(doc, own, bases):
                    out.append((f1, f2, items[i]["cls"], *rest, len(own[i])))
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in (zip(*out) if out else [[]] * len(names))], names=names)

    rows = texts.join(sides, ["f1", "f2"]).select("f1", "f2", "doc", "items").mapInArrow(verify, ", ".join(f"{c} long" for c in names))
    out = store(rows)
    discard(found)
    return out


def find_overlaps(docs: DataFrame, benchmark: DataFrame, text: str = "text", doc_id: str = "doc_id", item_id: str = "item_id") -> DataFrame:
    """(doc_id, item_id, first_token, end_token, n_equal, n_item): proven overlaps, the best of each document and item."""
    small_batches(docs.sparkSession)
    index = Index(benchmark, item_id=item_id)
    if index.empty:
        return docs.sparkSession.createDataFrame([], "doc_id long, item_id long, first_token long, end_token long, n_equal long, n_item long")
    found = overlapping_texts(docs, index, text).join(index.items, "cls")
    rows = docs.where(F.col(text).isNotNull()).select(F.col(doc_id).cast("long").alias("doc_id"), *text_key(F.col(text)))
    return rows.join(found, ["f1", "f2"]).select("doc_id", "item_id", "first_token", "end_token", "n_equal", "n_item")


def drop_contaminated(docs: DataFrame, benchmark: DataFrame, text: str = "text") -> DataFrame:
    """The rows of ``docs`` without proven overlap with any item, unchanged."""
    small_batches(docs.sparkSession)
    index = Index(benchmark)
    if index.empty:
        return docs
    found = overlapping_texts(docs, index, text).select(F.col("f1").alias("_overlap_f1"), F.col("f2").alias("_overlap_f2")).distinct()
    index.discard()
    f1, f2 = text_key(docs[text])
    return docs.join(found, (f1 == F.col("_overlap_f1")) & (f2 == F.col("_overlap_f2")), "left_anti")


def op8_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return find_overlaps(read_table(spark, sf_dir, "documents"), read_table(spark, sf_dir, "benchmark"))
