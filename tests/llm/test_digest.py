import base64
import hashlib
import math
import random
from collections import Counter

import numpy as np
import pytest

from voltlake.llm import digest
from voltlake.llm.digest import SCALES, chains, digest_documents, entropies, entropy_histogram, fingerprints, likeness, likeness_text


def level(w):
    most = math.log2(len(w))
    return (most - sum(c * math.log2(c) for c in Counter(w).values()) / len(w)) * 1000 / most


def text(r, n):
    return " ".join("".join(r.choice("abcdefgé") for _ in range(r.randrange(1, 9))) for _ in range(n))


def test_entropy_levels():
    r = random.Random(1)
    buf = bytes(r.choice(b"aab \x00xyz") if i % 300 < 200 else r.randrange(256) for i in range(3000))
    got = entropies(np.frombuffer(buf, np.uint8))
    assert len(got) == 3000 - 63
    assert all(abs(got[i] - level(buf[i : i + 64])) < 1.001 for i in range(len(got)))
    got = entropies(np.frombuffer(buf, np.uint8), 12)
    assert all(abs(got[i] - level(buf[i : i + 12])) < 1.001 for i in range(0, len(got), 7))


def brute_features(t, rank, scale):
    """Selected places of one text."""
    lv = entropies(np.frombuffer(t, np.uint8), scale.window)
    points = Counter()
    for s in range(len(lv)):
        points[min(range(s, min(s + scale.run, len(lv))), key=lambda i: (rank[lv[i]], i))] += 1
    out = sorted(i for i, p in points.items() if p >= scale.points)
    return out or sorted(sorted(points, key=lambda i: (-points[i], i))[:1])


@pytest.mark.parametrize("scale", SCALES)
def test_features_against_brute_force(scale):
    r = random.Random(3)
    rank = np.array(r.sample(range(1001), 1001))
    texts = [text(r, n).encode() for n in (0, 1, 5, 12, 14, 20, 60, 200, 400)] + [b"x" * 64, b"ab" * 300]
    offsets = np.concatenate([[0], np.cumsum([len(t) for t in texts])])
    row, h = digest.features(np.frombuffer(b"".join(texts), np.uint8), offsets, rank, scale)
    for i, t in enumerate(texts):
        want = brute_features(t, rank, scale) if len(t) >= scale.window else ([0] if t else [])
        assert (row == i).sum() == len({t[p : p + scale.window] for p in want})


def brute_likeness(one, other):
    """Bit by bit, from the texts of two fingerprints."""
    def read(t):
        out = {}
        for x in filter(None, t.split(".")):
            k, n, b = x.split(":")
            out.setdefault(int(k), []).append((int(n), {8 * i + j for i, c in enumerate(base64.b64decode(b)) for j in range(8) if c >> (7 - j) & 1}))
        return out

    a, b = read(one), read(other)
    if not a or not b:
        return float(not a and not b)
    a, b = a[max(a.keys() & b.keys())], b[max(a.keys() & b.keys())]
    if sum(n for n, _ in a) > sum(n for n, _ in b) or len(a) > len(b):
        a, b = b, a
    total = 0.0
    for n, x in a:
        best = 0.0
        for _, y in b:
            chance, most = len(x) * len(y) / 2048, min(len(x), len(y))
            best = max(best, 1.0 if x == y else max(0.0, (len(x & y) - chance) / (most - chance)) if most > chance else 0.0)
        total += n * best
    return total / sum(n for n, _ in a)


def test_short_texts_are_like_their_half(spark, docs):
    r = random.Random(12)
    texts = [text(r, r.choice([6, 9, 12, 20, 40, 80, 200])) for _ in range(150)]
    rows = digest_documents(docs(texts)).collect()
    for lo, hi, least in ((24, 60, 0.8), (60, 128, 0.95), (128, 400, 0.99), (400, 4000, 1.0)):
        some = [x for x in rows if lo <= x.n_chars < hi]
        assert len(some) > 10 and np.mean([x.near_edited > x.near_next + 0.05 for x in some]) >= least
    long = [x for x in rows if x.n_chars >= 128]
    assert np.mean([x.near_edited for x in long]) > 0.35 and np.mean([x.near_next for x in long]) < 0.15


def test_long_texts_and_repeats(spark):
    r = random.Random(2)
    long = text(r, 300_000)
    rows = [(1, long), (1, long), (2, long[: len(long) // 2] + text(r, 100)), (None, "tail"), (None, "tail")]
    got = digest_documents(spark.createDataFrame(rows, "doc_id bigint, text string")).collect()
    assert len(got) == 5 and len({x.fingerprint for x in got if x.doc_id == 1}) == 1
    assert next(x for x in got if x.doc_id == 2).near_next > 0.9


def test_order_edited_texts_and_likeness(spark, docs, monkeypatch):
    monkeypatch.setattr(digest, "ROWS_PER_BLOCK", 7)
    r = random.Random(5)
    texts = [text(r, r.choice([0, 3, 40, 300])) for _ in range(60)] + [None, "", "日本語" * 40]
    texts[10] = texts[11] = text(r, 200)
    d = docs(texts).selectExpr("*", "1 as block", "2 as k")
    rows = {x.doc_id: x for x in digest_documents(d).collect()}
    assert len(rows) == len(texts)
    t = [x or "" for x in texts]
    by_text = {}
    for i, x in rows.items():
        nxt, n = t[i - 1], len(t[i])
        edited = t[i][: n - n // 2] + nxt[: n // 2]
        assert (x.n_chars, x.edited_sha256) == (n, hashlib.sha256(edited.encode()).hexdigest())
        assert by_text.setdefault(t[i], x.fingerprint) == x.fingerprint
        assert 0 <= x.near_edited <= 1 and 0 <= x.near_next <= 1
        assert x.near_edited == likeness_text(x.fingerprint, x.edited_fingerprint)
        assert math.isclose(x.near_edited, brute_likeness(x.fingerprint, x.edited_fingerprint), abs_tol=1e-12)
        if i:
            assert math.isclose(x.near_next, brute_likeness(x.fingerprint, rows[i - 1].fingerprint), abs_tol=1e-12)
    assert rows[11].near_next == 1
    long = [x for i, x in rows.items() if len(t[i]) > 900]
    assert all(x.near_edited > 0.3 for x in long)
    assert all(x.near_next < 0.3 for x in long if t[x.doc_id] != t[x.doc_id - 1])


def test_edges(spark, docs):
    assert digest_documents(docs([])).count() == 0
    one = digest_documents(docs(["only " * 30])).first()
    assert one.near_next == 1
    nulls = spark.sql("select cast(null as bigint) doc_id, 'aa' text union all select 3, 'bb' union all select 3, 'bb'")
    assert digest_documents(nulls).count() == 3
    h = entropy_histogram(docs(["some text " * 30]))
    assert h.count() == 1001 * len(SCALES)
    assert fingerprints(docs(["q" * 200, "", None]), h).count() == 3
    rank = np.stack([np.arange(1001)] * len(SCALES))
    assert likeness(chains([b""], rank)[0], chains([b""], rank)[0]) == 1
