import random
import re

import xxhash

from voltlake.llm.components import connected_components
from voltlake.llm.simhash import classes, forest, keep_one


def fp(text):
    t = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    w = re.findall(r"[^\x20\x09-\x0D]+", t)
    sh = [" ".join(w[i : i + 4]) for i in range(len(w) - 3)] or ([" ".join(w)] if w else [])
    hs = [xxhash.xxh64_intdigest(s.encode(), seed=42) for s in sh]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hs) > len(hs))


def brute(texts):
    fps = [fp(t) for t in texts]
    root = list(range(len(fps)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i in range(len(fps)):
        for j in range(i):
            if (fps[i] ^ fps[j]).bit_count() <= 4:
                a, b = sorted((find(i), find(j)))
                root[b] = a
    return [(f, find(i)) for i, f in enumerate(fps)]


def texts(n=150, seed=3):
    r = random.Random(seed)
    word = lambda: "".join(r.choice("abçdEF") for _ in range(r.randrange(1, 9)))
    out = [None, "", " \t\n", "one", "two words", "A b C", "a B c", "é\u00a0x y z w", "w " * 700]
    for _ in range(n):
        base = [word() for _ in range(r.choice([3, 4, 60, 150, 400]))]
        for _ in range(r.choice([0, 0, 1, 4])):
            t = list(base)
            for _ in range(r.randrange(3)):
                t[r.randrange(len(t))] = word()
            out.append(" ".join(t))
        out.append(" \n".join(base))
    return out


def test_against_brute_force(spark, docs):
    t = texts()
    got = {r.doc_id: (r.fp % (1 << 64), r.component_id) for r in classes(docs(t)).collect()}
    assert [got[i] for i in range(len(t))] == brute(t)


def test_tiles_lose_nothing(spark, docs):
    t = texts(60, 9)
    got = {r.doc_id: (r.fp % (1 << 64), r.component_id) for r in classes(docs(t), tile=3).collect()}
    assert [got[i] for i in range(len(t))] == brute(t)


def test_keep_one_empty_repeated_clashing(spark, docs):
    t = texts(20, 4)
    d = docs(t).selectExpr("*", "1 as fp", "2 as component_id", "'k' as key")
    kept = keep_one(d.unionAll(d))
    assert kept.columns == d.columns
    want = sorted(2 * [i for i, (_, c) in enumerate(brute(t)) if c == i])
    assert sorted(r.doc_id for r in kept.collect()) == want
    assert classes(docs([])).count() == 0
    nulls = spark.sql("select cast(null as bigint) doc_id, 'a b c d e' text union all select 5, 'a b c d e' union all select null, 'q'")
    assert sorted((str(r.doc_id), str(r.component_id)) for r in classes(nulls).collect()) == [("5", "5"), ("None", "5"), ("None", "None")]


def test_components(spark):
    assert connected_components(spark.createDataFrame([], "a bigint, b bigint")).count() == 0
    r = random.Random(1)
    pairs = [(i, i + 1) for i in range(50, 90)] + [(0, i) for i in range(1, 40)] + [(r.randrange(100, 200), r.randrange(100, 200)) for _ in range(60)] + [(7, 7), (None, 3), (5, 0), (0, 5)]
    root = {}

    def find(x):
        while root.setdefault(x, x) != x:
            x = root[x]
        return x

    for a, b in pairs:
        if a is not None and a != b:
            x, y = sorted((find(a), find(b)))
            root[y] = x
    got = {x.node: x.component for x in connected_components(spark.createDataFrame(pairs, "a bigint, b bigint")).collect()}
    assert got == {x: find(x) for x in list(root)}


def test_forest_is_whole():
    import numpy as np

    fps = np.array([0, 15, 255, 1 << 40, (1 << 40) | 31], np.uint64)
    assert len(forest(fps)) == 4
