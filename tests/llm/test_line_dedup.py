import random
from functools import cache

import numpy as np
import pytest

from voltlake.llm.line_dedup import SHINGLE, band_keys, dedup_lines, forest, rewrite, shingle_sets, shingles, signatures


@cache
def grams(t):
    t = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in t)
    return {t[i : i + SHINGLE] for i in range(max(1, len(t) - SHINGLE + 1))}


def alike(a, b):
    x, y = grams(a), grams(b)
    if min(len(x), len(y)) < 0.8 * max(len(x), len(y)) - 1e-9:  # then no overlap is large enough
        return False
    return len(x & y) >= 0.8 * len(x | y) - 1e-9


def brute(texts):
    """Kept texts; ids are places."""
    distinct = sorted({x for t in texts for x in (t or "").split("\n") if x.strip(" \t\n\r\x0b\x0c")})
    root = {x: x for x in distinct}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i, a in enumerate(distinct):
        for b in distinct[:i]:
            if find(a) != find(b) and alike(a, b):
                root[find(a)] = find(b)
    seen, out = set(), []
    for t in texts:
        if t is None:
            out.append(None)
            continue
        kept = []
        for x in t.split("\n"):
            if x in root:
                if find(x) in seen:
                    continue
                seen.add(find(x))
            kept.append(x)
        out.append("\n".join(kept))
    return out


def corpus(n=120, seed=1):
    r = random.Random(seed)
    word = lambda: "".join(r.choice("abcdefghié ") for _ in range(r.randrange(1, 9)))
    pool = ["x", "ab", "Of.", "café", " ", "\t\t", "", "repeated line that everybody has"]
    for _ in range(25):
        base = [word() for _ in range(r.choice([2, 8, 30, 80]))]
        pool.append(" ".join(base))
        for _ in range(r.choice([0, 1, 2, 12])):
            t = list(base)
            t[r.randrange(len(t))] = word()
            pool.append(" ".join(t))
    texts = [None, "", "\n\n", "same\nsame\nSAME\nsame "]
    for _ in range(n):
        texts.append("\n".join(r.choice(pool) if r.random() < 0.7 else " ".join(word() for _ in range(12)) for _ in range(r.randrange(1, 9))))
    return texts


@pytest.mark.parametrize(("chunk", "tile", "shared"), [(256, 1024, 1_000_000), (2, 3, 0)])
def test_against_brute_force(spark, docs, chunk, tile, shared):
    texts = corpus()
    got = {r.row.doc_id: r.kept_text for r in rewrite(docs(texts), chunk=chunk, tile=tile, shared_lines=shared).collect()}
    want = brute(texts)
    wrong = [(i, got[i], want[i]) for i in range(len(texts)) if got[i] != want[i]]
    assert len(got) == len(texts) and len(wrong) <= 1, wrong  # bands find a link with high probability, not for certain


def test_columns_nulls_and_repeats(spark, docs):
    texts = ["one line here\ntwo", "one line here", "three\nthree"]
    d = docs(texts).selectExpr("*", "1 as row", "2 as k1", "3 as told")
    rows = dedup_lines(d.unionAll(d)).collect()
    assert rows[0].__fields__ == d.columns
    assert sorted((r.doc_id, r.text, r.n_chars) for r in rows) == 2 * [] + sorted(2 * [(0, texts[0], 17), (1, "", 0), (2, "three", 5)])
    assert dedup_lines(docs([])).count() == 0
    nulls = spark.sql("select cast(null as bigint) doc_id, 'a a' text union all select 4, 'a a' union all select null, 'a a\na a'")
    assert sorted(r.text for r in dedup_lines(nulls).collect()) == ["a a", "a a", "a a\na a"]


def test_forest_links():
    base = "a quick brown fox jumps over the lazy dog and runs away from it"
    texts = [base, base + "!", "zzz", base[:-1], "another text that has nothing in common with the first of them"]
    got = forest(shingle_sets([t.encode() for t in texts]))
    assert {frozenset(p) for p in got} <= {frozenset(p) for p in [(0, 1), (0, 3), (1, 3)]} and len(got) == 2


def test_forest_across_labels():
    texts = [b"abcdefghijklmnopqrstuvwxyz" + bytes([48 + i]) for i in range(6)] + [b"something else entirely here"]
    label = np.array([5, 5, 5, 7, 7, 9, 11])
    got = forest(shingle_sets(texts), label)
    assert 2 <= len(got) <= 3 and {label[i] for p in got for i in p} == {5, 7, 9}


@pytest.mark.parametrize("n", [2, 5, 40])
def test_forest_against_pairs(n):
    r = random.Random(n)
    base = ["".join(r.choice("abcdefgh ") for _ in range(r.choice([4, 60, 700]))) for _ in range(3)]
    texts = []
    for _ in range(n):
        t = list(r.choice(base))
        for _ in range(r.randrange(1 + len(t) // 60)):
            t[r.randrange(len(t))] = "x"
        texts.append("".join(t))
    root = list(range(n))
    for i in range(n):
        for j in range(i):
            if alike(texts[i], texts[j]):
                root = [root[j] if x == root[i] else x for x in root]
    got = list(range(n))
    for i, j in forest(shingle_sets([t.encode() for t in texts])):
        assert alike(texts[i], texts[j]) and got[i] != got[j]
        got = [got[j] if x == got[i] else x for x in got]
    assert len({*zip(root, got)}) == len({*root}) == len({*got})


def test_shingles_of_any_line():
    texts = ["", "x", "ÄÖÜ", "exactly 9", "ten chars.", "Naïve façade, naïve FAÇADE", "ab" * 70000]
    counts, hashes = shingles([t.encode() for t in texts])
    assert counts.tolist() == [max(1, len(t) - SHINGLE + 1) for t in texts]
    sets = shingle_sets([t.encode() for t in texts])
    assert [len(x) for x in sets] == [len(grams(t)) for t in texts]
    assert len(shingle_sets([b"UPPER case line"])[0]) == len(np.intersect1d(*shingle_sets([b"UPPER case line", b"upper CASE line"])))


@pytest.mark.parametrize("size", [20, 60, 200, 400])
def test_recall(size):
    """Pairs of exact similarity 0.8 to 0.85 that share a band."""
    r = random.Random(size)
    pairs = []
    while len(pairs) < 400:
        a = [r.choice("abcdefghijklmnop ") for _ in range(size)]
        b = list(a)
        for _ in range(1 + r.randrange(max(1, size // 50))):
            b[r.choice([r.randrange(size), 0, size - 1])] = r.choice("xyz")
        a, b = "".join(a), "".join(b)
        if 0.8 <= len(grams(a) & grams(b)) / len(grams(a) | grams(b)) < 0.85:
            pairs.append((a.encode(), b.encode()))
    keys = [band_keys(signatures(*shingles([p[k] for p in pairs], 32))) for k in (0, 1)]
    assert (keys[0] == keys[1]).any(axis=1).mean() >= 0.97


def test_long_texts(spark, docs):
    r = random.Random(5)
    long = "".join(r.choice("abcdefgh ") for _ in range(1_300_000))
    many = "\n".join(f"line number {i} {r.random()}" for i in range(30_000))
    texts = [long, "short\n" + long[:650_000] + "x" + long[650_001:], many, many + "\nand one more", "\n" * 100_000]
    want = [long, "short", many, "and one more", "\n" * 100_000]
    assert [r.kept_text for r in sorted(rewrite(docs(texts)).collect(), key=lambda r: r.row.doc_id)] == want
