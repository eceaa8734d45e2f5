"""Near-duplicate groups by SuperMinHash, banding, verification and union-find.

1. Each text becomes its set of distinct k-word shingles (64-bit hashes), its
   128-bit set fingerprint, a SuperMinHash signature and band hashes.
2. Texts with equal sets form a class; only classes go on, so a group of exact
   copies of any size costs one row.
3. Classes that share a band meet in a bucket. Each member is verified against
   the bucket's smallest member (its pivot), a number of pairs that grows with
   the members, not with their square.
4. Verified links are contracted by union-find. In buckets that still hold
   several components, the members are dealt into bounded parts that meet
   pairwise in cells; a cell compares signatures in memory, verifies the pairs
   across components whose estimate is near the threshold and puts out links
   only, so no link within a bucket is lost for want of a luckier pivot and no
   pair that fails is ever a row.
5. Components are contracted again, to the smallest doc_id of each.

Verification compares the whole shingle sets, as integers. A pair at exactly
the threshold of 0.8 shares no band with probability (1 - 0.8^5)^32 = 3e-6, and
is passed over for its estimate with probability 2e-4 at the most (``missed``
gives both for any similarity); with ``least_estimate`` 0 no pair of a bucket is
passed over, which is the exact way.

Defined results: null or blank texts have no shingles and are linked with
nothing; rows that share a doc_id are one document, linked with whatever one of
them is linked with; rows without a doc_id are linked with nothing, have a null
component_id and are kept; texts of any length are compared whole; of documents
with equal sets the smallest doc_id names the class; an empty table gives an empty
result; other columns, whatever their names, are not read.
"""

from __future__ import annotations

from collections.abc import Iterator
from math import comb

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from chronoloom.llm.common import discard, read_table, small_batches, store
from chronoloom.llm.textops import mix, shingle_sets

BANDS, BAND_ROWS = 32, 5
SLOTS = BANDS * BAND_ROWS
#: Pairs whose signatures agree in a smaller share of slots are not verified: 3.8 standard
#: deviations below 0.8, and much less for any higher similarity.
LEAST_ESTIMATE = 0.68
#: Members and shingles in a part of a bucket.
CELL = 512
CELL_SHINGLES = 400_000
_SEED = np.uint64(0xA0761D6478BD642F)
_STEP = np.arange(1, SLOTS + 257, dtype=np.uint64) * _SEED


def superminhash(h: np.ndarray, bounds: np.ndarray, m: int = SLOTS) -> np.ndarray:
    """Signatures (a row of m 64-bit values for each set) of the sets h[bounds[i]:bounds[i+1]].

    In step j an element draws a uniform r and swaps entry j of its own random permutation with
    a later one; the slot it finds there gets j + r if that is smaller. So all of an element's
    ranks differ, which lowers the estimate's variance against independent hashes. Values of
    step j are at least j: a set whose slots are all below j needs no further step, which for
    sets much larger than m is after the first. Sets step together, elements of finished ones leave.
    """
    assert m <= 256, "permutations are kept in bytes"
    n = len(bounds) - 1
    doc = np.repeat(np.arange(n), np.diff(bounds))
    out = np.full(n * m, np.iinfo(np.uint64).max, np.uint64)
    perm: np.ndarray | None = None
    for j in range(m):
        z = mix(h + _STEP[j])
        k = j + ((z & np.uint64(0xFFFFFFFF)) * np.uint64(m - j) >> np.uint64(32)).astype(np.int64)
        if perm is None:
            slot = k
        else:
            rows = np.arange(len(h))
            slot = perm[rows, k].astype(np.int64)
            perm[rows, k] = perm[:, j]
        np.minimum.at(out, doc * m + slot, (np.uint64(j) << np.uint64(32)) | (z >> np.uint64(32)))
        open_ = out.reshape(n, m).max(1) >= np.uint64(j + 1) << np.uint64(32) if n else np.zeros(0, bool)
        stay = open_[doc]
        if not stay.any():
            break
        if perm is None:
            perm = np.repeat(np.arange(m, dtype=np.uint8)[None], int(stay.sum()), 0)
            perm[np.arange(len(perm)), k[stay]] = 0
            h, doc = h[stay], doc[stay]
        elif not stay.all():
            h, doc, perm = h[stay], doc[stay], perm[stay]
    return out.reshape(n, m)


def _sums(values: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    total = np.zeros(len(values) + 1, np.uint64)
    np.cumsum(values, out=total[1:])
    return total[bounds[1:]] - total[bounds[:-1]]


def sketches(docs: DataFrame, text: str, doc_id: str, k: int) -> DataFrame:
    """(d, n, f1, f2, bands, sig) for each row."""

    def sketch(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids = batch.column(0)
            for row, h, bounds in shingle_sets(batch.column(1), k):
                n = np.diff(bounds)
                sig = superminhash(h, bounds)
                rows = sig.reshape(len(n), BANDS, BAND_ROWS)
                band = np.repeat(mix(np.arange(1, BANDS + 1, dtype=np.uint64))[None], len(n), 0)
                for r in range(BAND_ROWS):
                    band = mix(band ^ rows[:, :, r])
                has = n > 0
                bands = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(has * BANDS)]), pa.int32()), pa.array(band[has].ravel().view(np.int64)))
                small = mix(sig).astype(np.uint16)
                yield pa.RecordBatch.from_arrays(
                    [ids.slice(row, len(n)), pa.array(n, pa.int64()), pa.array(_sums(mix(h ^ _SEED), bounds).view(np.int64)), pa.array(_sums(mix(h + _SEED), bounds).view(np.int64)), bands, pa.array([x.tobytes() for x in small], pa.binary())],
                    names=["d", "n", "f1", "f2", "bands", "sig"],
                )

    return docs.select(F.col(doc_id).cast("long").alias("d"), F.col(text).alias("t")).mapInArrow(sketch, "d long, n long, f1 long, f2 long, bands array<long>, sig binary")


def _local_roots(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Union-find over one partition's edges; puts out (node, smallest node of its tree)."""
    up: dict[int, int] = {}

    def find(x: int) -> int:
        while (p := up.setdefault(x, x)) != x:
            up[x] = up[p]
            x = up[x]
        return x

    for batch in batches:
        for a, b in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            a, b = find(a), find(b)
            if a != b:
                up[max(a, b)] = min(a, b)
    nodes = [x for x in up if find(x) != x]
    yield pa.RecordBatch.from_arrays([pa.array(nodes, pa.int64()), pa.array([find(x) for x in nodes], pa.int64())], names=["a", "b"])


def components(edges: DataFrame) -> DataFrame:
    """(node, component) of the nodes of ``edges`` (a, b); a component is named by its smallest node.

    Each round contracts every partition's edges by union-find, points each node at its smallest
    neighbour, follows pointers to their ends by doubling, and renames the edges. Every node but
    local minima disappears, so rounds are few; nodes with many edges are only ever reduced by
    partial aggregation or split joins.
    """
    forest, used = None, []

    def kept(df: DataFrame) -> DataFrame:
        used.append(store(df))
        return used[-1]

    while True:
        edges = kept(edges.where("a <> b").mapInArrow(_local_roots, "a long, b long").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct())
        if edges.isEmpty():
            break
        up = kept(edges.groupBy("a").agg(F.min("b").alias("b")))
        while True:
            far = up.alias("x").join(up.alias("y"), F.col("x.b") == F.col("y.a"), "left").select(F.col("x.a").alias("a"), F.coalesce("y.b", "x.b").alias("b"), F.col("y.b").isNotNull().alias("moved"))
            far = kept(far)
            up = far.select("a", "b")
            if far.where("moved").isEmpty():
                break
        name = lambda rows, c: rows.join(up.select(F.col("a").alias("_a"), F.col("b").alias("_b")), F.col(c) == F.col("_a"), "left").withColumn(c, F.coalesce("_b", c)).drop("_a", "_b")
        forest = up if forest is None else name(forest, "b").unionByName(up.join(forest.select(F.col("a").alias("_n")), F.col("a") == F.col("_n"), "left_anti"))
        forest = kept(forest)
        edges = name(name(edges, "a"), "b")
    if forest is None:
        return edges.select(F.col("a").alias("node"), F.col("b").alias("component"))
    for table in used:
        if table is not forest:
            discard(table)
    return forest.select(F.col("a").alias("node"), F.col("b").alias("component"))


def missed(similarity: float, least: float = LEAST_ESTIMATE) -> tuple[float, float]:
    """Probabilities that a pair of this similarity shares no band, and that its signatures agree in too few slots.

    The second is for independent slots; those of SuperMinHash vary less.
    """
    few = int(np.ceil(least * SLOTS))
    tail = sum(comb(SLOTS, i) * similarity**i * (1 - similarity) ** (SLOTS - i) for i in range(few))
    return (1 - similarity**BAND_ROWS) ** BANDS, tail


def verified(pairs: DataFrame, texts: DataFrame, k: int, percent: int) -> DataFrame:
    """The (a, b) of ``pairs`` whose texts' shingle sets satisfy 100 * intersection >= percent * union."""

    def check(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            # a pair is judged by the texts of its row: a doc_id may have several
            both = pa.concat_arrays([batch.column(2), batch.column(3)]).dictionary_encode()
            sets: list[np.ndarray] = []
            for _, h, bounds in shingle_sets(both.dictionary, k):
                sets += np.split(h, bounds[1:-1])
            a, b = both.indices.to_numpy()[: len(batch)], both.indices.to_numpy()[len(batch) :]
            keep = pa.array([_close(sets[x], sets[y], percent) for x, y in zip(a.tolist(), b.tolist(), strict=True)], pa.bool_())
            yield pa.RecordBatch.from_arrays([batch.column(0).filter(keep), batch.column(1).filter(keep)], names=["a", "b"])

    ta = texts.select(F.col("d").alias("a"), F.col("t").alias("ta"))
    tb = texts.select(F.col("d").alias("b"), F.col("t").alias("tb"))
    return pairs.join(ta, "a").join(tb, "b").select("a", "b", "ta", "tb").mapInArrow(check, "a long, b long").distinct()


def _close(a: np.ndarray, b: np.ndarray, percent: int) -> bool:
    if 100 * min(len(a), len(b)) < percent * max(len(a), len(b)):
        return False
    both = len(np.intersect1d(a, b, assume_unique=True))
    return 100 * both >= percent * (len(a) + len(b) - both)


def _cell_links(cell: list[dict], k: int, percent: int, least: float = LEAST_ESTIMATE) -> Iterator[tuple[int, int]]:
    """Verified links across components in one cell, enough of them to connect all that are linked.

    Pairs go from the most to the least alike, and a pair that earlier links already connect is
    not compared again. In a cell of two parts only pairs across the parts are looked at.
    """
    comp = [x["component"] for x in cell]
    part = np.array([x["part"] for x in cell])
    if len(cell) < 2 or len(set(comp)) == 1:
        return
    sig = np.frombuffer(b"".join(x["sig"] for x in cell), np.uint16).reshape(len(cell), SLOTS)
    _, group = np.unique(np.array(comp), return_inverse=True)
    two = (part != part[0]).any()
    near = []
    for i in range(len(cell) - 1):
        other = np.flatnonzero((group[i + 1 :] != group[i]) & ((part[i + 1 :] != part[i]) | (not two))) + i + 1
        agree = (sig[other] == sig[i]).sum(1)
        hit = agree >= least * SLOTS
        near.append(np.stack([agree[hit], np.full(hit.sum(), i), other[hit]]))
    pairs = np.concatenate(near, axis=1)
    pairs = pairs[:, np.argsort(-pairs[0], kind="stable")]
    used = np.unique(pairs[1:])
    sets: dict[int, np.ndarray] = {}
    for row, h, bounds in shingle_sets(pa.array([cell[i]["t"] for i in used.tolist()], pa.large_string()), k):
        for x in range(len(bounds) - 1):
            sets[int(used[row + x])] = h[bounds[x] : bounds[x + 1]]
    up = list(range(int(group.max()) + 1))

    def find(x: int) -> int:
        while up[x] != x:
            up[x] = up[up[x]]
            x = up[x]
        return x

    for i, j in pairs[1:].T.tolist():
        a, b = find(group[i]), find(group[j])
        if a != b and _close(sets[i], sets[j], percent):
            up[a] = b
            yield cell[i]["d"], cell[j]["d"]


def _estimated(least: float):
    def estimate(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n = len(batch)
            sa, sb = (np.frombuffer(b"".join(batch.column(c).to_pylist()), np.uint16).reshape(n, SLOTS) for c in (2, 3))
            keep = pa.array((sa == sb).sum(1) >= least * SLOTS)
            yield pa.RecordBatch.from_arrays([batch.column(0).filter(keep), batch.column(1).filter(keep)], names=["a", "b"])

    return estimate


def linked_across(tagged: DataFrame, sketch: DataFrame, texts: DataFrame, k: int, percent: int, least: float = LEAST_ESTIMATE) -> DataFrame:
    """(a, b): verified links between the components that meet in one bucket.

    ``tagged`` has (band, d, component). A bucket's members are split into the smallest component
    and the rest, each dealt by hash into parts of bounded numbers of members and shingles, and
    every two parts that can hold a pair across components meet in one cell.
    """
    sized = tagged.join(sketch, "d")
    main = F.col("component") == F.col("lo")
    lows = tagged.groupBy("band").agg(F.min("component").alias("lo"), F.max("component").alias("hi")).where("lo <> hi").select("band", "lo")
    split = sized.join(lows, "band").withColumn("main", main)
    parts = lambda m: F.ceil(F.greatest(F.sum(F.when(F.col("main") == m, 1)) / CELL, F.sum(F.when(F.col("main") == m, F.col("n"))) / CELL_SHINGLES)).cast("int")
    counted = split.groupBy("band").agg(F.first("lo").alias("lo"), F.count(F.lit(1)).alias("size"), parts(True).alias("p"), parts(False).alias("q"), F.bit_xor(F.xxhash64("d", "component")).alias("s1"), F.bit_xor(F.xxhash64(F.lit(1), "d")).alias("s2"))
    # buckets with the same members need one look
    once = counted.groupBy("size", "s1", "s2").agg(F.min_by(F.struct("band", "lo", "p", "q"), "band").alias("x")).select("x.*")
    dealt = sized.join(once, "band").withColumn("main", main)
    dealt = dealt.withColumn("part", F.when(F.col("main"), F.pmod(F.xxhash64("d"), F.col("p"))).otherwise(F.col("p") + F.pmod(F.xxhash64("d"), F.col("q"))).cast("int"))
    meets = F.sequence(F.when(F.col("main"), F.col("p")).otherwise(F.lit(0)), F.col("p") + F.col("q") - 1)
    dealt = dealt.withColumn("other", F.explode(meets)).join(texts, "d")
    cells = dealt.groupBy("band", F.least("part", "other").alias("c1"), F.greatest("part", "other").alias("c2")).agg(F.collect_list(F.struct("d", "component", "part", "sig", "t")).alias("cell"))

    def link(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [x for cell in batch.column(0).to_pylist() for x in _cell_links(cell, k, percent, least)]
            yield pa.RecordBatch.from_arrays([pa.array([a for a, _ in found], pa.int64()), pa.array([b for _, b in found], pa.int64())], names=["a", "b"])

    return cells.select("cell").mapInArrow(link, "a long, b long").distinct()


def near_duplicates(docs: DataFrame, text: str = "text", doc_id: str = "doc_id", k: int = 5, percent: int = 80, least_estimate: float = LEAST_ESTIMATE) -> DataFrame:
    """(doc_id, n_shingles, component_id, kept) for each row of ``docs``."""
    small_batches(docs.sparkSession)
    rows = store(sketches(docs, text, doc_id, k))
    ready = rows.where("n > 0 AND d IS NOT NULL")
    # bands and signatures are functions of the set, so any row's will do
    classes = store(ready.groupBy("n", "f1", "f2").agg(F.min("d").alias("d"), F.first("bands").alias("bands"), F.first("sig").alias("sig")))

    banded = classes.select("d", F.explode("bands").alias("band"))
    buckets = banded.groupBy("band").agg(F.count(F.lit(1)).alias("size"), F.min("d").alias("pivot")).where("size > 1")
    members = store(banded.join(buckets, "band"))

    sigs = classes.select("d", "sig")
    pairs = members.where("d <> pivot").select(F.col("pivot").alias("a"), F.col("d").alias("b")).distinct()
    pairs = pairs.join(sigs.select(F.col("d").alias("a"), F.col("sig").alias("sa")), "a").join(sigs.select(F.col("d").alias("b"), F.col("sig").alias("sb")), "b")
    pairs = store(pairs.select("a", "b", "sa", "sb").mapInArrow(_estimated(least_estimate), "a long, b long").distinct())

    ids = members.select("d").distinct()
    texts = store(docs.select(F.col(doc_id).cast("long").alias("d"), F.col(text).alias("t")).join(ids, "d", "left_semi"))
    links = store(verified(pairs, texts, k, percent))
    # a document with several texts joins their classes
    named = ready.join(classes.select("n", "f1", "f2", F.col("d").alias("c")), ["n", "f1", "f2"])
    several = named.groupBy("d").agg(F.min("c").alias("a"), F.max("c").alias("b")).where("a <> b").select("a", "b")
    links = store(links.unionByName(several))
    found = components(links)

    tagged = members.where("size > 2").join(found, F.col("d") == F.col("node"), "left").withColumn("component", F.coalesce("component", "d")).drop("node")
    more = store(linked_across(tagged, classes.select("d", "sig", "n"), texts, k, percent, least_estimate))
    if not more.isEmpty():
        found = components(links.unionByName(more))
    for table in (members, pairs, texts, links, more):
        discard(table)

    grouped = rows.join(classes.select("n", "f1", "f2", F.col("d").alias("c")), ["n", "f1", "f2"], "left")
    grouped = grouped.join(found, F.col("c") == F.col("node"), "left")
    component = F.when(F.col("d").isNotNull(), F.coalesce("component", "c", "d"))
    return grouped.select(F.col("d").alias("doc_id"), F.col("n").alias("n_shingles"), component.alias("component_id")).withColumn("kept", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(True)))


def keep_one_of_each(docs: DataFrame, text: str = "text", doc_id: str = "doc_id", k: int = 5, percent: int = 80) -> DataFrame:
    """The rows of ``docs`` whose document has the smallest doc_id of its group."""
    gone = near_duplicates(docs, text, doc_id, k, percent).where("NOT kept").select(F.col("doc_id").alias("_gone"))
    return docs.join(gone, F.col(doc_id) == F.col("_gone"), "left_anti")


def op10_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(read_table(spark, sf_dir, "documents").select("doc_id", "text"), k=4)


ORACLE_SQL = """
WITH RECURSIVE w AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x20\\x09-\\x0D]+') AS words FROM documents),
s AS (SELECT DISTINCT doc_id, CASE WHEN len(words) < 4 THEN array_to_string(words, ' ') ELSE array_to_string(words[i : i + 3], ' ') END AS g
  FROM (SELECT doc_id, words, unnest(range(1, greatest(2, len(words) - 2))) AS i FROM w WHERE len(words) > 0)),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
i AS (SELECT x.doc_id AS a, y.doc_id AS b, count(*) AS both_ FROM s x JOIN s y ON x.g = y.g AND x.doc_id <> y.doc_id GROUP BY x.doc_id, y.doc_id),
e AS (SELECT a, b FROM i JOIN n na ON na.doc_id = a JOIN n nb ON nb.doc_id = b WHERE 100 * both_ >= 80 * (na.n + nb.n - both_)),
r AS (SELECT doc_id, doc_id AS c FROM w UNION SELECT r.doc_id, e.b FROM r JOIN e ON r.c = e.a)
SELECT doc_id, coalesce(n.n, 0)::BIGINT AS n_shingles, min(c) AS component_id, doc_id = min(c) AS kept FROM r LEFT JOIN n USING (doc_id) GROUP BY doc_id, n.n
"""
