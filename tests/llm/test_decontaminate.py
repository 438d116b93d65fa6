import hashlib
import random
import re

import pytest

from voltlake.llm.decontaminate import decontaminate, find_hits, judge

W = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def ws(t):
    return W.findall("".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in t or ""))


def brute(texts, items, window=13):
    out = []
    for t in texts:
        d, hit, found = ws(t), set(), set()
        for item_id, text in items:
            b = ws(text)
            n = min(window, len(b))
            for i in range(len(b) - n + 1 if n else 0):
                for j in range(len(d) - n + 1):
                    if d[j : j + n] == b[i : i + n]:
                        hit.update(range(j, j + n))
                        found.add(str(item_id))
        out.append((len(d), len(hit), len(found), hashlib.sha256(",".join(sorted(found)).encode()).hexdigest(), bool(hit) and 20 * len(hit) >= len(d)))
    return out


def run(spark, docs, texts, items, **k):
    bench = spark.createDataFrame(items, "item_id bigint, text string")
    rows = judge(find_hits(docs(texts).select("doc_id", "text"), bench, **k)).collect()
    return [(r.n_words, r.n_hit, r.n_items, r.items_sha256, r.contaminated) for r in sorted(rows, key=lambda r: r.doc_id)]


def cases():
    r = random.Random(5)
    word = lambda: r.choice(["a", "B", "é", "the", "ß1", "x" * 30, "of"])
    items = [(i, " ".join(word() for _ in range(r.choice([1, 2, 3, 7, 12, 13, 14, 20, 40])))) for i in range(30)] + [(100, None), (101, ""), (102, "..."), (103, "a a a a a a a a a a a a a a a")]
    items += [(200, items[5][1]), (201, items[5][1].upper())]
    texts = [None, "", "...", "a", "a " * 200]
    for _ in range(60):
        t = [word() for _ in range(r.randrange(60))]
        for _ in range(r.randrange(3)):
            b = (r.choice(items)[1] or "").split(" ")
            k = r.randrange(len(b))
            at = r.randrange(len(t) + 1)
            t[at:at] = b[k : k + r.randrange(5, 30)]
        texts.append(r.choice([" ", ", ", "\n"]).join(t))
    return texts, items


def test_against_brute_force(spark, docs):
    texts, items = cases()
    assert run(spark, docs, texts, items) == brute(texts, items)


@pytest.mark.parametrize("filter_words", [4, 1 << 12])
def test_large_benchmark_by_joins(spark, docs, filter_words):
    texts, items = cases()
    assert run(spark, docs, texts, items, block_bytes=300, filter_words=filter_words) == brute(texts, items)


def test_spans_and_items_alike_on_both_ways(spark, docs):
    texts, items = cases()
    bench = spark.createDataFrame(items, "item_id bigint, text string")
    d = docs(texts).selectExpr("*", "1 as length", "2 as h", "3 as _found")
    a, b = (sorted(find_hits(d, bench, block_bytes=n).collect(), key=lambda r: r.doc_id) for n in (1 << 20, 300))
    assert a == b and a[0].__fields__ == b[0].__fields__
    for r, t in zip(a, texts):
        hits = {i for s, e in zip(r.hit_spans[::2], r.hit_spans[1::2]) for i in range(s, e)}
        assert len(hits) == r.n_hit and all(0 <= i < r.n_words for i in hits) and r.n_items == len(r.hit_items)


@pytest.mark.parametrize("block_bytes", [1 << 20, 50])
def test_long_texts_repeats_and_null_ids(spark, block_bytes):
    passage = " ".join(f"w{i}" for i in range(20))
    long = "other words here " * 100_000 + passage
    same = "a " * 600_000
    rows = [(1, long), (1, long), (None, passage), (None, passage), (2, None), (3, same), (4, passage[:-4])]
    items = [(7, passage), (7, passage), (8, "a " * 30), (None, "other words here"), (9, "w2 w3")]
    got = judge(find_hits(spark.createDataFrame(rows, "doc_id bigint, text string"), spark.createDataFrame(items, "item_id bigint, text string"), block_bytes=block_bytes)).collect()
    want = [(0, 20, 20, 2, True), (0, 20, 20, 2, True), (1, 300_020, 20, 2, False), (1, 300_020, 20, 2, False), (2, 0, 0, 0, False), (3, 600_000, 600_000, 1, True), (4, 19, 19, 2, True)]
    assert sorted((r.doc_id or 0, r.n_words, r.n_hit, r.n_items, r.contaminated) for r in got) == want


def test_empty_tables_and_clashing_columns(spark, docs):
    texts, items = cases()
    assert run(spark, docs, [], items) == []
    assert run(spark, docs, texts, []) == brute(texts, [])
    bench = spark.createDataFrame(items, "item_id bigint, text string")
    d = docs(texts).selectExpr("*", "1 as n_words", "2 as contaminated", "'x' as item_id")
    kept = decontaminate(d, bench)
    assert kept.columns == d.columns
    want = [i for i, x in enumerate(brute(texts, items)) if not x[-1]]
    assert sorted(r.doc_id for r in kept.collect()) == want
