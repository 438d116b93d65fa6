import random
import zlib
from itertools import pairwise

import pytest

from voltlake.llm.shards import even_cuts, local_cuts, minimax_cuts, shard


def capacity(sizes, n):
    """Smallest largest shard, by trying every capacity."""
    for c in range(max([*sizes, 0]), sum(sizes) + 1):
        used, room = 1, c
        for s in sizes:
            if s > room:
                used, room = used + 1, c
            room -= s
        if used <= n:
            return c
    return 0


def check(rows, texts, n):
    assert len(rows) == len(texts)
    by_text, shards = {}, {}
    for r, t in zip(sorted(rows, key=lambda r: r.doc_id), texts):
        t = t or ""
        assert (r.size, r.text_crc32) == (len(t.encode()) + 1, zlib.crc32(t.encode()))
        assert by_text.setdefault(t, r.shard) == r.shard
        shards.setdefault(r.shard, []).append((r.slot, r.size))
    assert all(0 <= k < n and [s for s, _ in sorted(v)] == list(range(len(v))) for k, v in shards.items())
    order = {}
    for r, t in zip(sorted(rows, key=lambda r: r.doc_id), texts):
        order.setdefault(t or "", [r.shard, r.slot, 0])
        order[t or ""][1] = min(order[t or ""][1], r.slot)
        order[t or ""][2] += r.size
    sizes = [v[2] for v in sorted(order.values())]
    assert max(sum(s for _, s in v) for v in shards.values()) == capacity(sizes, n)


@pytest.mark.parametrize("kind", ["plain", "hot", "few", "odd"])
def test_minimax(spark, docs, kind):
    r = random.Random(kind)
    if kind == "plain":
        texts = ["w" * r.randrange(300) + str(i) for i in range(200)]
    elif kind == "hot":
        texts = ["copy" * 20] * 300 + ["x" * r.randrange(60) + str(i) for i in range(400)]
    elif kind == "few":
        texts = ["one", "two", None]
    else:
        texts = [None, "", "", "é" * 50, "x" * 30000] + ["t%d" % (i % 7) for i in range(60)]
    r.shuffle(texts)
    n = 4 if kind == "odd" else 16
    check(shard(docs(texts), n).collect(), texts, n)


def test_even_cuts():
    r = random.Random(2)
    for _ in range(200):
        sizes = [r.choice([1, 5, 30, 200]) for _ in range(r.randrange(1, 80))]
        ends = [0]
        for x in sizes:
            ends.append(ends[-1] + x)
        c = capacity(sizes, 8)
        cuts, greedy = even_cuts(ends, c, ends[-1], 8), local_cuts(ends, c, ends[-1], 8)
        parts = lambda x: [b - a for a, b in zip([0, *x], x)]
        assert max(parts(cuts)) <= c and sum(parts(cuts)) == ends[-1] and set(cuts) <= set(ends)
        off = lambda x: sum((p - ends[-1] / 8) ** 2 for p in parts(x))
        assert off(cuts) <= off(greedy) + c * c


def test_narrowing_by_jobs(spark, docs, monkeypatch):
    monkeypatch.setattr("voltlake.llm.shards.minimax_cuts", lambda e, n: minimax_cuts(e, n, near_rows=3))
    r = random.Random(8)
    texts = ["w" * r.randrange(90) + str(i) for i in range(40)]
    check(shard(docs(texts), 4).collect(), texts, 4)


@pytest.mark.parametrize("hot", [0, 3000, 9000])
def test_same_cuts_by_jobs(spark, hot):
    r = random.Random(hot)
    sizes = [r.choice([1, 5, 30, 90]) for _ in range(300)]
    sizes.insert(120, max(hot, 1))
    at, rows = 0, []
    for x in sizes:
        at += x
        rows.append((at, x))
    ends = spark.createDataFrame(rows, "bytes_end bigint, group_bytes bigint").cache()
    whole = minimax_cuts(ends, 16)
    assert minimax_cuts(ends, 16, near_rows=3) == whole
    assert minimax_cuts(ends, 16, near_rows=60) == whole
    assert hot < 9000 or len(set(whole)) > 6  # greedy cuts leave most shards empty


def test_empty_repeated_and_extra_columns(spark, docs):
    assert shard(docs([])).count() == 0
    d = docs(["a", "b"]).selectExpr("*", "1 as size", "'q' as shard", "7 as h")
    rows = shard(d.unionAll(d)).collect()
    assert len(rows) == 4 and len({(r.shard, r.slot) for r in rows}) == 4
    null_id = spark.sql("select cast(null as bigint) doc_id, 'a' text union all select 1, 'a' union all select null, 'a'")
    assert sorted(r.slot for r in shard(null_id).collect()) == [0, 1, 2]
    assert all(b >= a for a, b in pairwise(sorted(r.shard for r in rows)))
