import math
import random
import re
import zlib
from collections import Counter

import numpy as np
import pytest

from voltlake.llm import lm_score
from voltlake.llm.lm_score import best_classes, class_logs, exchange, fit, fit_classes, held_out, likelihood, pair_likelihood, score, score_tokens, tokenize, vocabulary


def tokens(t):
    t = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in t or "")
    return [*re.findall(r"[^\x20\x09-\x0D]+", t), None]


def texts(n=250, seed=1):
    r = random.Random(seed)
    langs = [["der", "die", "und", "schön", "haus", "geht"], ["the", "a", "and", "house", "goes"], ["le", "la", "été", "maison"]]
    out = [None, "", " \n\t", "The THE the"]
    for _ in range(n):
        lang = r.choice(langs)
        out.append(" ".join(r.choice(lang) if r.random() < 0.8 else r.choice(lang) + str(r.randrange(60)) + r.choice(["", ".", ","]) for _ in range(r.randrange(1, 60))))
    return out


def test_exchange_raises_the_likelihood():
    r = np.random.default_rng(3)
    b = np.zeros((41, 41), int)
    seq = [0]
    for _ in range(20000):
        u = seq[-1]
        seq.append(int(r.integers(1, 21)) + (20 if 0 < u <= 20 else 0))
    np.add.at(b, (seq[:-1], seq[1:]), 1)
    start = np.r_[0, 1 + np.arange(40) % 3]
    of = exchange(b, 4)
    assert likelihood(b, of, 4) > likelihood(b, start, 4)
    assert all((of[1:21, None] != of[None, 21:]).ravel())
    for u in range(1, 41):  # no single move helps
        for c in range(1, 4):
            other = of.copy()
            other[u] = c
            assert likelihood(b, other, 4) <= likelihood(b, of, 4) + 1e-6
    m = np.zeros((4, 4))
    np.add.at(m, (of[:, None], of[None, :]), b)
    change, emit = class_logs(m, b.sum(0), of)
    assert np.allclose((10 ** (change[:, of] + emit)).sum(1), 1)


def test_a_moved_unit_is_better_off():
    """The gain of the second step against the likelihood itself."""
    r = np.random.default_rng(5)
    b = r.poisson(2.0, (30, 30)) * (r.random((30, 30)) < 0.3)
    np.fill_diagonal(b, 0)
    of = np.r_[0, r.integers(1, 5, 29)]
    m = np.zeros((5, 5))
    np.add.at(m, (of[:, None], of[None, :]), b)
    rows = {}
    for u in range(30):
        for x in range(30):
            rows[u, of[x]] = rows.get((u, of[x]), 0) + b[u, x]
            rows[u, 5 + of[x]] = rows.get((u, 5 + of[x]), 0) + b[x, u]
    keys = sorted(k for k, n in rows.items() if n)
    units, to = best_classes(np.array([k[0] for k in keys]), np.array([k[1] for k in keys]), np.array([rows[k] for k in keys]), of, m)
    assert len(units) > 3 and 0 not in units and 0 not in to
    gains = []
    for u, c in zip(units, to):
        new = of.copy()
        new[u] = c
        gains.append(likelihood(b, new, 5) - pair_likelihood(m))
    assert np.mean(np.array(gains) > 0) > 0.8 and np.mean(gains) > 0


def test_rounds_raise_the_held_out_score(spark, docs):
    """Words beyond the head whose classes only their contexts tell."""
    r = random.Random(4)
    kinds = [[f"{c}{i}q" for i in r.sample(range(10_000), 700)] for c in "abcd"]  # equal endings, so one shape
    out = []
    for _ in range(700):
        k, t = r.randrange(4), []
        for _ in range(40):
            t.append(r.choice(kinds[k]))
            k = (k + 1) % 4
        out.append(" ".join(t))
    d = docs(out)
    vocab = vocabulary(d.where(~held_out()))
    tokens = tokenize(d, vocab.dictionary)
    total = []
    for rounds in (0, 6):
        model = fit_classes(tokens.where(~held_out()), vocab, rounds)
        total.append(score_tokens(tokens, model, vocab.counts).where(held_out()).agg({"score": "sum"}).first()[0])
    assert total[1] > 0.95 * total[0]


@pytest.mark.parametrize("dictionary", [10, 1 << 17])
def test_scores(spark, docs, monkeypatch, dictionary):
    monkeypatch.setattr(lm_score, "DICTIONARY", dictionary)
    ts = texts()
    d = docs(ts).selectExpr("*", "1 as c", "'x' as word", "2 as score")
    model, counts = fit(d.where(~held_out()))
    rows = {r.doc_id: r for r in score(d, model, counts).collect()}
    out = [zlib.crc32(str(i).encode()) % 10 == 0 for i in range(len(ts))]
    c = Counter(t for x, o in zip(ts, out) if not o for t in tokens(x))
    n, v = sum(c.values()), len(c)
    assert len(rows) == len(ts) and model.train_tokens == n
    for i, t in enumerate(ts):
        tk = tokens(t)
        base = sum(math.log10((c[x] + 0.1) / (n + 0.1 * (v + 1))) for x in tk)
        assert (rows[i].n_tokens, rows[i].n_known) == (len(tk), sum(c[x] > 0 for x in tk))
        assert math.isclose(rows[i].base_score, base, rel_tol=1e-9)
    held = [i for i, o in enumerate(out) if o]
    assert sum(rows[i].score for i in held) > sum(rows[i].base_score for i in held)


@pytest.mark.parametrize("dictionary", [10, 1 << 17])
def test_probabilities_sum_to_one(spark, docs, monkeypatch, dictionary):
    """Over every known word, one unknown word of each shape, and the end, after any class."""
    monkeypatch.setattr(lm_score, "DICTIONARY", dictionary)
    model, counts = fit(docs(texts(60)))
    own = model.dictionary
    total = 10 ** (model.change[:, model.class_of[0]] + model.emit[0])
    for r in counts.collect():
        b = np.frombuffer(r.word.encode(), np.uint8)
        u = int(own.look_up(b, np.array([0]), np.array([len(b)]))[0])
        rest = (r.c + 0.1) / model.unit_total[u - own.first_shape] if u >= own.first_shape else 1
        total += 10 ** (model.change[:, model.class_of[u]] + model.emit[u]) * rest
    for u in range(own.first_shape, own.units):
        total += 10 ** (model.change[:, model.class_of[u]] + model.emit[u]) * 0.1 / model.unit_total[u - own.first_shape]
    assert np.allclose(total, 1, rtol=1e-9)


def test_scores_by_hand(spark, docs, monkeypatch):
    monkeypatch.setattr(lm_score, "DICTIONARY", 12)
    ts = texts(80)
    model, counts = fit(docs(ts))
    own, c = model.dictionary, {r.word: r.c for r in counts.collect()}
    unseen = ["the neverseen house", "", None, "été die x!"]
    got = {r.doc_id: r.score for r in score(docs(ts + unseen), model, counts).collect()}
    for i, t in enumerate(ts + unseen):
        before, want = 0, 0.0
        for w in tokens(t):
            u, rest = 0, 0.0
            if w is not None:
                b = np.frombuffer(w.encode(), np.uint8)
                u = int(own.look_up(b, np.array([0]), np.array([len(b)]))[0])
                rest = math.log10((c.get(w, 0) + 0.1) / model.unit_total[u - own.first_shape]) if u >= own.first_shape else 0.0
            want += model.change[model.class_of[before], model.class_of[u]] + model.emit[u] + rest
            before = u
        assert math.isclose(got[i], want, rel_tol=1e-9)


def test_long_texts_repeats_and_null_ids(spark):
    long = "word " * 300_000 + "x" * 500_000
    rows = [(1, long), (1, long), (None, "a word"), (None, "a word"), (2, None)]
    d = spark.createDataFrame(rows, "doc_id bigint, text string").selectExpr("*", "1 as units", "2 as row")
    model, counts = fit(d.where("doc_id is null or doc_id = 2"))
    got = sorted(((r.doc_id or 0), r.n_tokens, r.n_known) for r in score(d, model, counts).collect())
    assert got == [(0, 3, 3), (0, 3, 3), (1, 300_002, 300_001), (1, 300_002, 300_001), (2, 1, 1)] and model.train_tokens == 7


def test_empty(spark, docs):
    model, counts = fit(docs([]))
    assert score(docs([]), model, counts).count() == 0
    rows = score(docs(["a b", None]), model, counts).collect()
    assert all(np.isfinite(r.score) and r.n_known == 0 for r in rows)
