"""Operators on documents against brute force, on every awkward case."""

from __future__ import annotations

import hashlib
import random

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from chronoloom.llm import decontaminate, host_rules, line_dedup, near_dedup, textops
from tests.llm import helpers as h


@pytest.fixture(scope="module")
def rows():
    return h.documents()


@pytest.fixture(scope="module")
def docs(spark, rows):
    return h.frame(spark, rows).cache()


def by_id(df):
    return {r["doc_id"]: r for r in df.collect()}


# -- hashing ---------------------------------------------------------------------------------------


def test_equal_spans_have_equal_hashes():
    texts = pa.array(["ab ab\tab", "xab ab", None, "", "é ab"], pa.large_string())
    (_, part), *rest = textops.slices(texts)
    assert not rest
    w = textops.Words.of(textops.Bytes.of(part), False)
    assert np.diff(w.first).tolist() == [3, 2, 0, 0, 2]
    assert len(set(w.hash.tolist())) == 3 and len({int(x) for x in w.hash[[0, 1, 2, 4, 6]]}) == 1


def thue_morse(n: int) -> tuple[str, str]:
    a, b = "a", "b"
    for _ in range(n):
        a, b = a + b, b + a
    return a, b


def test_strings_of_structure_have_hashes_of_their_own(spark):
    """Thue-Morse strings, on which every polynomial modulo a power of two is equal."""
    for n in (1, 4, 8, 11, 13):
        part = pa.array(["{} {} {}".format(*thue_morse(n), thue_morse(n)[0])], pa.large_string())
        w = textops.Words.of(textops.Bytes.of(part), False).hash
        assert w[0] == w[2] != w[1]
    r = random.Random(1)
    texts = pa.array(["".join(r.choice("ab") for _ in range(k % 40)) + " " + "".join(r.choice("ab") for _ in range(9)) for k in range(4000)], pa.large_string())
    (_, part), *_ = textops.slices(texts, 10**7)
    w = textops.Words.of(textops.Bytes.of(part), False)
    words = [x for t in texts.to_pylist() for x in t.split()]
    assert len(set(words)) == len(set(w.hash.tolist())) == len(set(zip(words, w.hash.tolist())))
    a, b = thue_morse(9)
    rows = [(1, f"{a}\n{b}\n{a}", None, "s", 0), (2, " ".join([a] * 30 + [b] * 30), None, "s", 0), (3, " ".join([b] * 30 + [a] * 30), None, "s", 0)]
    got = by_id(host_rules.measured(h.frame(spark, rows), keep=("doc_id",)))
    assert got[1]["n_dup_lines"] == 1 and {r["component_id"] for r in near_dedup.near_duplicates(h.frame(spark, [(1, " ".join([a] * 9), None, None, 0), (2, " ".join([b] * 9), None, None, 0)])).collect()} == {1, 2}
    bench = spark.createDataFrame([(0, f"{a} {a} {b} {a} {b}")], "item_id long, text string")
    texts = h.frame(spark, [(1, f"x {b} {b} {a} {b} {a}", None, None, 0), (2, f"x {a} {a} {b} {a} {b} y", None, None, 0)])
    assert [x["doc_id"] for x in decontaminate.find_overlaps(texts, bench).collect()] == [2]


def test_slices_cover_all_rows_whatever_their_size():
    texts = pa.array(["a" * n for n in (3, 50, 0, 7, 7)])
    got = [(row, len(part)) for row, part in textops.slices(texts, 10)]
    assert sum(n for _, n in got) == 5 and [row for row, _ in got] == [0, 1, 2, 4]


# -- host rules --------------------------------------------------------------------------------------


def test_counts(docs, rows):
    got = by_id(host_rules.judged(host_rules.measured(docs, keep=("doc_id", "source"))))
    for i, want in h.host_rules(rows).items():
        assert tuple(got[i][c] for c in (*host_rules.COUNTS, "base_failed")) == want
        assert got[i]["kept"] == (not want[-1] and not got[i]["host_rejected"])
    assert len(got) == len(rows)


def test_bad_hosts_are_rejected_and_small_ones_shrunk(spark):
    good, bad = " ".join(f"word{i}" for i in range(60)), " ".join(f"#{i}%" for i in range(60))
    rows = [(i, good, None, "good", 0) for i in range(100)] + [(1000 + i, bad if i < 90 else good, None, "bad", 0) for i in range(100)]
    rows += [(2000 + i, good, None, f"h{i % 8}", 0) for i in range(80)] + [(3000, bad, None, "single", 0), (3001, good, None, None, 0)]
    counts = host_rules.measured(h.frame(spark, rows), keep=("doc_id", "source"))
    v = {r["source"]: r for r in host_rules.host_verdicts(counts).collect()}
    assert v["bad"]["host_rejected"] and not v["good"]["host_rejected"]
    assert v["bad"]["rate_symbols"] > 0.8 and v["single"]["rate_symbols"] < v["bad"]["rate_symbols"]
    kept = {r["doc_id"] for r in host_rules.apply_host_rules(h.frame(spark, rows)).collect()}
    assert kept & set(range(1000, 1100)) == set() and set(range(100)) <= kept and 3001 in kept


def test_hosts_on_clashing_columns_and_empty_tables(spark, docs, rows):
    clash = docs.withColumn("n_words", F.lit("mine")).withColumn("kept", F.lit(7))
    out = host_rules.apply_host_rules(clash)
    assert out.columns == clash.columns and {r["n_words"] for r in out.collect()} == {"mine"}
    assert host_rules.apply_host_rules(docs.limit(0)).count() == 0
    assert host_rules.judged(host_rules.measured(docs.limit(0))).count() == 0
    twice = host_rules.measured(docs.unionByName(docs), keep=("doc_id", "source"))
    assert host_rules.judged(twice).count() == 2 * len(rows)


# -- line dedup ------------------------------------------------------------------------------------------


@pytest.mark.parametrize("n_batches", [1, 3, 7])
def test_lines(docs, rows, n_batches):
    got = sorted(((r["doc_id"], r["n_lines"], r["n_dropped"], r["text"] or "") for r in line_dedup.drop_repeated_lines(docs, n_batches=n_batches, fanout=2).collect()), key=repr)
    assert got == sorted(h.deduped_lines(rows), key=repr)
    assert sum(x[2] for x in got) > 5


def test_lines_of_repeated_rows_and_other_columns(spark, docs):
    line = "a line that is long enough"
    rows = [(5, line, "x", "s", 1), (5, line + "\nmore", "y", "s", 1), (9, line, "z", "s", 1), (9, line, "z", "s", 1)]
    df = h.frame(spark, rows).withColumn("n_dropped", F.lit("old")).withColumn("gone", F.lit(3))
    out = line_dedup.drop_repeated_lines(df).orderBy("doc_id", "lang").collect()
    assert [(r["doc_id"], r["text"], r["n_dropped"], r["gone"]) for r in out] == [(5, line, 0, 3), (5, line + "\nmore", 0, 3), (9, "", 1, 3), (9, "", 1, 3)]
    assert line_dedup.drop_repeated_lines(docs.limit(0)).count() == 0


def test_lines_of_rows_with_one_id_and_different_texts(spark):
    shared = "shared boilerplate line"
    rows = [(1, shared, None, None, 0), (None, shared + "\nbody one", None, None, 0), (None, "a unique precious line\nbody two here", None, None, 0)]
    rows += [(7, shared + "\nfirst text of seven", None, None, 0), (7, "second text of seven\n" + shared, None, None, 0), (7, None, None, None, 0)]
    got = sorted(((r["doc_id"], r["n_lines"], r["n_dropped"], r["text"] or "") for r in line_dedup.drop_repeated_lines(h.frame(spark, rows)).collect()), key=repr)
    assert got == sorted(h.deduped_lines(rows), key=repr)
    assert (None, 2, 0, "a unique precious line\nbody two here") in got


def test_runs_are_compacted(spark):
    runs = line_dedup.SortedRuns(spark, 2, fanout=2)
    for k in range(5):
        batch = spark.range(k * 5, k * 5 + 10).select(F.col("id").alias("h1"), F.col("id").alias("h2"), F.lit(k).cast("long").alias("owner"))
        assert spark.table(runs.add(batch)).count() == (10 if k == 0 else 5)
        runs.compact()
    assert [len(x) for x in runs.levels] == [1, 0, 1]
    assert sum(spark.table(r).count() for r in runs.runs()) == 30
    runs.drop()
    assert not [t for t in spark.catalog.listTables() if t.name.startswith(runs.name)]


# -- near dedup -------------------------------------------------------------------------------------------------


@pytest.mark.parametrize("k", [4, 5])
def test_groups(docs, rows, k):
    got = by_id(near_dedup.near_duplicates(docs, k=k))
    want = h.groups({r[0]: r[1] for r in rows if r[0] is not None}, k, 80)
    assert {i: got[i]["component_id"] for i in want} == want
    assert all(got[r[0]]["n_shingles"] == len(h.shingles(r[1], k)) for r in rows)
    assert all(got[i]["kept"] == (want[i] == i) for i in want) and got[None]["component_id"] is None and got[None]["kept"]
    assert len(set(want.values())) < len(want)


def test_chains_of_near_copies_without_a_common_pivot(spark):
    """Each text is close to the next only; the ends are unlike, so buckets hold several components at first."""
    r = random.Random(4)
    words = [f"w{i}" for i in range(400)]
    texts = {}
    for i in range(40):
        texts[i * 3] = " ".join(words)
        at = r.randrange(0, 370)
        words = words[:at] + [f"n{i}x{j}" for j in range(18)] + words[at + 18 :]
    order = list(texts)
    r.shuffle(order)
    rows = [(new, texts[old], None, None, None) for new, old in enumerate(order)]
    got = by_id(near_dedup.near_duplicates(h.frame(spark, rows), k=4))
    want = h.groups({i: t for i, t, *_ in rows}, 4, 80)
    assert {i: got[i]["component_id"] for i in want} == want


def test_cells_split_large_buckets(spark, monkeypatch):
    monkeypatch.setattr(near_dedup, "CELL", 8)
    r = random.Random(5)
    base = [f"w{i}" for i in range(120)]
    rows = []
    for i in range(90):
        w = list(base)
        for at in r.sample(range(120), r.choice([0, 1, 3, 6, 8])):
            w[at] = f"e{r.randrange(6)}"
        rows.append((i, " ".join(w), None, None, None))
    got = by_id(near_dedup.near_duplicates(h.frame(spark, rows), k=4))
    want = h.groups({i: t for i, t, *_ in rows}, 4, 80)
    assert {i: got[i]["component_id"] for i in want} == want


def test_signatures_estimate_similarity():
    rng = np.random.default_rng(6)
    for share in (0.3, 0.8):
        both, rest = rng.integers(0, 2**63, 400, dtype=np.uint64), rng.integers(0, 2**63, 1200, dtype=np.uint64)
        n = int(400 * (1 / share - 1) / 2)
        a, b = np.sort(np.r_[both, rest[:n]]), np.sort(np.r_[both, rest[600 : 600 + n]])
        sig = near_dedup.superminhash(np.r_[a, b], np.array([0, len(a), len(a) + len(b)]))
        assert abs((sig[0] == sig[1]).mean() - share) < 0.12
    small = near_dedup.superminhash(np.array([5], np.uint64), np.array([0, 0, 1, 1]))
    # one element fills all slots with its ranks, each once
    assert sorted((small[1] >> np.uint64(32)).tolist()) == list(range(near_dedup.SLOTS))


def test_pairs_that_may_be_missed_are_as_few_as_stated(spark):
    assert near_dedup.missed(0.8)[0] < 3.1e-6 and near_dedup.missed(0.8)[1] < 2e-4 and near_dedup.missed(0.9)[1] < 1e-12 and near_dedup.missed(0.8, 0)[1] == 0
    r = random.Random(9)
    rows = []
    for i in range(150):
        w = [f"g{i}w{r.randrange(10**6)}" for _ in range(r.choice([20, 60, 200]))]
        rows.append((2 * i, " ".join(w), None, None, None))
        n = len(w) - 3
        # one or more changed words at an end change as many shingles as there are words
        for c in range(1, n):
            if 100 * (n - c) >= 80 * (n + c) and 100 * (n - c - 1) < 80 * (n + c + 1):
                rows.append((2 * i + 1, " ".join(w[:-c] + [f"x{i}y{j}" for j in range(c)]), None, None, None))
    want = h.groups({i: t for i, t, *_ in rows}, 4, 80)
    assert sum(want[2 * i + 1] == 2 * i for i in range(150)) == 150
    for least in (near_dedup.LEAST_ESTIMATE, 0.0):
        got = by_id(near_dedup.near_duplicates(h.frame(spark, rows), k=4, least_estimate=least))
        assert {i: got[i]["component_id"] for i in want} == want


def test_a_document_of_several_texts_is_linked_by_any_of_them(spark):
    a, b = (" ".join(f"{c}{i}" for i in range(60)) for c in "ab")
    near = b.replace("b30", "other")
    got = near_dedup.near_duplicates(h.frame(spark, [(2, a, None, None, 0), (2, b, None, None, 0), (7, near, None, None, 0), (9, a + " z", None, None, 0)]), k=4)
    assert {(r["doc_id"], r["component_id"]) for r in got.collect()} == {(2, 2), (7, 2), (9, 2)}


def test_components(spark):
    r = random.Random(7)
    edges = [(i, i + 1) for i in range(50)] + [(100, 101 + i) for i in range(40)] + [(r.randrange(200, 300), r.randrange(200, 300)) for _ in range(90)]
    got = {x["node"]: x["component"] for x in near_dedup.components(spark.createDataFrame(edges, "a long, b long").repartition(4)).collect()}
    up = {}

    def find(x):
        while up.setdefault(x, x) != x:
            x = up[x]
        return x

    for a, b in edges:
        a, b = find(a), find(b)
        up[max(a, b)] = min(a, b)
    assert got == {x: find(x) for x in list(up) if find(x) != x}
    assert near_dedup.components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_near_dedup_of_repeated_rows_empty_tables_and_clashes(spark, docs, rows):
    long = " ".join(f"w{i}" for i in range(50))
    other = " ".join(f"v{i}" for i in range(50))
    df = h.frame(spark, [(1, long, None, None, 0), (2, long, None, None, 0), (2, other, None, None, 0), (3, other, None, None, 0), (3, other, None, None, 0)])
    assert {(r["doc_id"], r["component_id"]) for r in near_dedup.near_duplicates(df).collect()} == {(1, 1), (2, 1), (3, 1)}
    assert near_dedup.near_duplicates(docs.limit(0)).count() == 0
    clash = docs.withColumn("component", F.lit("c")).withColumn("d", F.lit(1)).withColumn("_gone", F.lit(2))
    kept = near_dedup.keep_one_of_each(clash.drop("_gone"))
    assert kept.columns == clash.drop("_gone").columns
    want = h.groups({r[0]: r[1] for r in rows if r[0] is not None}, 5, 80)
    assert {r["doc_id"] for r in kept.collect()} == {i for i in want if want[i] == i} | {None}


# -- decontamination ----------------------------------------------------------------------------------------------


ITEMS = [(0, "Alpha beta gamma delta epsilon zeta eta theta iota kappa lambda mu nu xi omicron pi rho sigma tau upsilon."), (1, "one two three four five six"), (2, "a b c"), (3, None), (4, ""), (None, "red orange yellow green blue indigo violet brown black white grey pink cyan teal")]


def brute_overlap(item: str, text: str) -> bool:
    import re

    tok = lambda s: re.findall(r"[a-z0-9\x80-\U0010ffff]+", (s or "").translate(h.LOWER))
    a, b = tok(item), tok(text)
    if len(a) < 4:
        return False
    for base in range(-len(a) + 1, len(b)):
        eq = [a[i] == b[base + i] for i in range(len(a)) if 0 <= base + i < len(b)]
        score = [0]
        for e in eq:
            score.append(score[-1] + (1 if e else -2))
        best = max((score[j] - score[i], -i, j) for i in range(len(score)) for j in range(i, len(score)))
        same = sum(eq[-best[1] : best[2]])
        if same >= decontaminate.needed(len(a)) and same >= 0.75 * (best[2] + best[1]):
            return True
    return False


def test_passages_are_found_with_substitutions_and_clean_texts_left(spark):
    r = random.Random(8)
    filler = [f"filler{i}" for i in range(300)]
    texts = {}
    for i in range(40):
        item = r.choice([ITEMS[0][1], ITEMS[5][1]]).split()
        for at in r.sample(range(len(item)), i % 5):
            item[at] = "sub"
        cut = item if i % 3 else item[: len(item) // 2]
        texts[i] = " ".join(r.sample(filler, 30) + cut + r.sample(filler, 20))
    texts |= {100: "ONE, two-three: four\nfive six!", 101: "one two three four five", 102: "a b c", 103: None, 104: "", 105: " ".join(r.sample(filler, 200)), 106: ITEMS[0][1]}
    bench = spark.createDataFrame(ITEMS, "item_id long, text string")
    df = h.frame(spark, [(i, t, None, None, None) for i, t in texts.items()])
    got = {(x["doc_id"], x["item_id"]) for x in decontaminate.find_overlaps(df, bench).collect()}
    want = {(i, k) for i, t in texts.items() for k, item in ITEMS if t and item and brute_overlap(item, t)}
    assert got == want and len(want) > 20
    assert {(100, 1), (106, 0)} <= got and not {101, 102, 103, 104, 105} & {i for i, _ in got}
    clean = decontaminate.drop_contaminated(df.withColumn("extra", F.lit(1)), bench)
    assert {x["doc_id"] for x in clean.collect()} == set(texts) - {i for i, _ in got} and clean.columns == [*df.columns, "extra"]


def test_passages_with_tokens_put_in_or_left_out(spark):
    item = ITEMS[0][1].split()
    texts = {1: " ".join(item[:7] + ["new"] + item[7:13]), 2: " ".join(item[:6] + item[8:15]), 3: " ".join(item[:5]) + " x" * 40 + " " + " ".join(item[6:11]), 4: " ".join(item[10:15] + item[:5])}
    df = h.frame(spark, [(i, "before " + t + " after", None, None, None) for i, t in texts.items()])
    got = {x["doc_id"]: x["n_equal"] for x in decontaminate.find_overlaps(df, spark.createDataFrame(ITEMS, "item_id long, text string")).collect()}
    assert got == {1: 13, 2: 13}


def test_every_substitution_that_counts_is_found(spark):
    """8 to 24 tokens with 0 to 6 substitutions: exactly what comparing every diagonal finds."""
    r = random.Random(12)
    items = [(n * 10 + i, " ".join(f"t{n}x{i}x{j}" for j in range(n))) for n in range(4, 25) for i in range(2)]
    texts = {}
    for item, text in items:
        for subs in range(7):
            for _ in range(6):
                w = text.split()
                for at in r.sample(range(len(w)), min(subs, len(w))):
                    w[at] = r.choice(["sub", w[at - 1], "x"])
                texts[len(texts)] = (item, " ".join([f"f{r.randrange(50)}" for _ in range(r.randrange(6))] + w + [f"f{r.randrange(50)}" for _ in range(r.randrange(6))]))
    df = h.frame(spark, [(i, t, None, None, None) for i, (_, t) in texts.items()])
    got = {(x["doc_id"], x["item_id"]) for x in decontaminate.find_overlaps(df, spark.createDataFrame(items, "item_id long, text string")).collect()}
    own = dict(items)
    want = {(i, item) for i, (item, t) in texts.items() if brute_overlap(own[item], t)}
    assert got == want and 500 < len(want) < len(texts)


def test_beginnings_are_all_that_stretches_have():
    r = random.Random(2)
    for _ in range(300):
        doc = np.array([r.random() < 0.75 for _ in range(30)])
        a, b, same = (int(x[0]) for x in decontaminate.best_stretches(np.where(doc, 1, 2).astype(np.uint64), [np.ones(30, np.uint64)], np.array([0]), np.array([0])))
        score = np.where(doc, 1, -2)
        assert score[a:b].sum() == max(score[i:j].sum() for i in range(30) for j in range(i, 31)) and same == doc[a:b].sum()
        if b - a >= 5:
            held = [all(doc[a + o] for o in mask) and (gap is None or not doc[a + gap]) for mask, gap in decontaminate.MASKS]
            assert sum(held) == 1 and (a == 0 or not doc[a - 1])
        if same >= 12:
            assert doc[a : min(b, a + 18)].sum() >= 12


def test_a_phrase_that_begins_many_items(spark):
    """More than COMMON items begin alike, so the join looks at more of their tokens."""
    r = random.Random(13)
    begin = "which of the following is the best answer to the question"
    items = [(i, f"{begin} {' '.join(f'q{i}w{j}' for j in range(r.choice([1, 3, 12])))}") for i in range(5 * decontaminate.COMMON)]
    texts = {i: f"x y {t if i % 2 else t.replace('following', 'below')} z" for i, t in items[:20]} | {500: f"{begin} nothing that is asked", 501: "of the following is the best"}
    df = h.frame(spark, [(i, t, None, None, None) for i, t in texts.items()])
    found = decontaminate.find_overlaps(df, spark.createDataFrame(items, "item_id long, text string")).collect()
    want = {(i, k) for i, t in texts.items() for k, item in items if brute_overlap(item, t)}
    assert {(x["doc_id"], x["item_id"]) for x in found} == want and {(i, i) for i in range(20)} <= want
    index = decontaminate.Index(spark.createDataFrame(items, "item_id long, text string"))
    assert index.seeds.where("common").count() > 0 < index.seeds.where("NOT common").count()
    index.discard()


def test_pieces_that_begin_with_what_many_items_hold_count_together(spark):
    """Phrases of more than COMMON items around tokens of their own, with tokens put in, left out and replaced: what all diagonals give."""
    r = random.Random(14)
    parts = ["which of these five things", "has never been seen before", "in any of the rooms", "according to the guide"]
    items = {i: " ".join(f"{p} {' '.join(f'q{i}w{j}{k}' for k in range(r.choice([1, 1, 2])))}" for j, p in enumerate(parts[: r.choice([2, 3, 4])])) for i in range(3 * decontaminate.COMMON)}
    texts = {0: f"before {parts[0]} one new {parts[1]} after", 1: f"{parts[0]} and nothing else", 2: f"{parts[1]} x {parts[0]}"}
    for i in range(3, 60):
        w = items[r.randrange(len(items))].split()
        for _ in range(r.randrange(6)):
            at = r.randrange(len(w))
            w[at : at + r.choice([0, 1, 1])] = [f"n{r.randrange(9)}" for _ in range(r.choice([0, 1, 1, 2]))]
        texts[i] = " ".join(["f0"] * r.randrange(3) + w + ["f1"] * r.randrange(30) + r.choice(parts).split())
    hashed = lambda d: {k: decontaminate.tokens(pa.array([t], pa.large_string()))[0] for k, t in d.items()}
    a, b, want = hashed(items), hashed(texts), set()
    for i, text in b.items():
        for k, item in a.items():
            want |= {(i, k, *found[1:]) for found in decontaminate.proven(text, [item], [list(range(-len(item) + 1, len(text)))])}
    df = h.frame(spark, [(i, t, None, None, None) for i, t in texts.items()])
    bench = spark.createDataFrame(list(items.items()), "item_id long, text string")
    got = {(x["doc_id"], x["item_id"], x["first_token"], x["end_token"], x["n_equal"]) for x in decontaminate.find_overlaps(df, bench).collect()}
    assert got == want and {0} < {x[0] for x in want} and not {1, 2} & {x[0] for x in want}
    assert {x["doc_id"] for x in decontaminate.drop_contaminated(df, bench).collect()} == set(texts) - {x[0] for x in want}


def test_seeds_are_known_exactly_or_by_a_bitmap(spark, monkeypatch):
    rng = np.random.default_rng(3)
    some, others = (rng.integers(0, 2**64, 3000, dtype=np.uint64) for _ in range(2))
    df = spark.createDataFrame([(int(x),) for x in some.view(np.int64)], "s long")
    exact = decontaminate.Seeds(df, "s", 3000)
    assert exact.has(some).all() and not exact.has(others).any()
    monkeypatch.setattr(decontaminate, "MOST_BITS", 18)
    rough = decontaminate.Seeds(df, "s", 3000, exact=10)
    assert rough.has(some).all() and 0 < rough.has(others).mean() < 0.05 and rough.sorted is None


def test_overlaps_of_repeated_rows_clashing_columns_and_empty_tables(spark, docs):
    bench = spark.createDataFrame(ITEMS + ITEMS[:1], "item_id long, text string")
    text = "x y " + ITEMS[0][1] + " z"
    df = h.frame(spark, [(1, text, None, None, None)] * 2 + [(None, text, None, None, None), (7, "clean " * 40000, None, None, None)])
    df = df.withColumn("f1", F.lit("mine")).withColumn("cls", F.lit(1)).withColumn("tokens", F.lit(2))
    found = decontaminate.find_overlaps(df, bench.withColumn("cls", F.lit("c"))).collect()
    assert len(found) == 6 and {(x["doc_id"], x["item_id"], x["first_token"], x["end_token"], x["n_equal"], x["n_item"]) for x in found} == {(1, 0, 2, 22, 20, 20), (None, 0, 2, 22, 20, 20)}
    left = decontaminate.drop_contaminated(df, bench)
    assert left.columns == df.columns and [x["doc_id"] for x in left.collect()] == [7]
    assert decontaminate.find_overlaps(df, bench.limit(0)).count() == 0 and decontaminate.find_overlaps(docs.limit(0), bench).count() == 0
    assert decontaminate.drop_contaminated(docs, bench.limit(0)).count() == docs.count() and decontaminate.drop_contaminated(docs.limit(0), bench).count() == 0


def test_very_long_texts_are_read_whole(spark, docs):
    """One text of some 3 MB: what is at its end counts as what is at its beginning."""
    n = 250_000
    body = "\n".join(" ".join(f"w{i * 50 + j}" for j in range(50)) for i in range(n // 50))
    tail = "the last line that another document repeats"
    rows = [(1, tail, None, "s", 0), (2, body + "\n" + tail, None, "s", 0), (3, body.replace("w249999", "other") + "\n#" + tail, None, "s", 0), (4, "x" * 3_000_000, None, "s", 0)]
    df = h.frame(spark, rows)
    got = by_id(host_rules.measured(df, keep=("doc_id",)))
    assert got[2]["n_words"] == n + 7 and got[3]["n_symbols"] == 1 and (got[4]["n_words"], got[4]["word_chars"]) == (1, 3_000_000)
    got = by_id(line_dedup.drop_repeated_lines(df))
    assert (got[2]["n_lines"], got[2]["n_dropped"], got[2]["text"]) == (n // 50 + 1, 1, body) and got[4]["text"] == "x" * 3_000_000
    got = by_id(near_dedup.near_duplicates(df))
    assert got[2]["n_shingles"] == n + 3 and (got[3]["component_id"], got[4]["component_id"]) == (2, 4)
    bench = spark.createDataFrame([(0, "the last line that another document repeats")], "item_id long, text string")
    found = {x["doc_id"]: x["first_token"] for x in decontaminate.find_overlaps(df, bench).collect()}
    assert found == {1: 0, 2: n, 3: n}
    bench = spark.createDataFrame([(0, f"w{n - 3} w{n - 2} w{n - 1} {tail}")], "item_id long, text string")
    assert {x["doc_id"]: x["first_token"] for x in decontaminate.find_overlaps(df, bench).collect()} == {2: n - 3, 3: n - 3}


# -- queries -------------------------------------------------------------------------------------------------------------


def test_digest_of_lines(docs, rows):
    got = {r["doc_id"]: r["s"] for r in line_dedup.drop_repeated_lines(docs.select("doc_id", "text")).select("doc_id", F.sha2(F.coalesce("text", F.lit("")), 256).alias("s")).collect()}
    assert got == {i: hashlib.sha256(t.encode()).hexdigest() for i, _, _, t in h.deduped_lines(rows)}
