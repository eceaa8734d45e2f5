"""Small documents with every awkward case, and brute-force versions of the operators."""

from __future__ import annotations

import random
import re

WORDS = re.compile(r"[^\x20\x09-\x0D]+")
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def documents(n: int = 60, seed: int = 1) -> list[tuple]:
    """Prose of few words with copies, near copies, shared lines and passages, and odd rows at the end."""
    r = random.Random(seed)
    vocabulary = ["The", "night", "was", "cold", "and", "Wind", "blew", "over", "hills", "schön", "élan", "river", "stone", "#tag", "50%", "quiet", "lamp", "door", "road", "bird", "ash", "tin"]
    shared = "This line is shared by many documents."
    texts: list[str] = []
    for i in range(n):
        if i % 6 == 4 and texts:
            texts.append(texts[-2])
        elif i % 6 == 5 and texts:
            words = texts[-3].split(" ")
            words[len(words) // 2] = "changed"
            texts.append(" ".join(words))
        else:
            lines = [" ".join(r.choice(vocabulary) for _ in range(r.randrange(1, 30))) + "." for _ in range(r.randrange(1, 8))]
            if i % 3 == 0:
                lines.insert(r.randrange(len(lines) + 1), "  " + shared.upper() if i % 2 else shared)
            texts.append("\n".join(lines))
    rows = [(i, t, "en", f"src{i % 4}", len(t)) for i, t in enumerate(texts)]
    odd = [None, "", " \t\n\x0b\x0c\r", "one", "\n\n", "x " * 9000, "a\x1cb\x85c d e", "\x00null byte", "tail\n"]
    rows += [(n + i, t, None, None if i % 2 else "src0", None) for i, t in enumerate(odd)]
    rows.append((None, texts[0], None, "src1", 3))
    return rows


def frame(spark, rows, extra: str = ""):
    return spark.createDataFrame(rows, SCHEMA + extra)


def words(text: str | None, lower: bool = False) -> list[str]:
    return WORDS.findall((text or "").translate(LOWER) if lower else text or "")


def shingles(text: str | None, k: int) -> set[tuple]:
    w = words(text, True)
    return {tuple(w[i : i + k]) for i in range(len(w) - k + 1)} if len(w) >= k else {tuple(w)} if w else set()


def groups(texts: dict, k: int, percent: int) -> dict:
    """Smallest id reachable over links of at least percent / 100."""
    sets = {i: shingles(t, k) for i, t in texts.items()}
    up = {i: i for i in texts}

    def find(x):
        while up[x] != x:
            x = up[x]
        return x

    ids = sorted(texts)
    for n, a in enumerate(ids):
        for b in ids[:n]:
            x, y = sets[a], sets[b]
            if x and y and 100 * len(x & y) >= percent * len(x | y):
                p, q = find(a), find(b)
                up[max(p, q)] = min(p, q)
    return {i: find(i) for i in ids}


def host_rules(rows: list[tuple]) -> dict:
    """doc_id -> (n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed)."""
    out = {}
    for doc_id, text, *_ in rows:
        w = words(text)
        tri = [tuple(w[i : i + 3]) for i in range(len(w) - 2)]
        covered = {i + k for i, g in enumerate(tri) if tri.count(g) > 1 for k in range(3)} if len(w) < 2000 else set(range(len(w)))
        seen, dup = set(), 0
        for line in (text or "").split("\n"):
            if WORDS.search(line):
                dup += line in seen
                seen.add(line)
        out[doc_id] = (len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", text or "")), dup, len(covered), len(w) < 50 or 100 * len(covered) > 50 * len(w))
    return out


def deduped_lines(rows: list[tuple], least: int = 10) -> list[tuple]:
    """(doc_id, n_lines, n_dropped, kept text) for each row, null ids as one last document."""
    key = lambda line: line.strip(" \t\n\x0b\x0c\r").translate(LOWER)
    owner: dict = {}
    rank = lambda i: float("inf") if i is None else i
    for doc_id, text, *_ in rows:
        for line in (text or "").split("\n"):
            owner[key(line)] = min(owner.get(key(line), float("inf")), rank(doc_id))
    out = []
    for doc_id, text, *_ in rows:
        lines = (text or "").split("\n")
        kept = [x for x in lines if len(key(x)) < least or owner[key(x)] == rank(doc_id)]
        out.append((doc_id, len(lines), len(lines) - len(kept), "\n".join(kept)))
    return out
