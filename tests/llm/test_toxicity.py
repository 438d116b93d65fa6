import random
import zlib

import numpy as np
import pytest

from voltlake.llm.toxicity import INSULT, KINDS, NEGATION, NEXT, OTHER, REPORT, SCOPE, TARGET, THREAT, Lexicon, Model, evidence, fit, keep_clean, marked, matches, near_copies_once, score, training_rows

STEMS = ("idiot", "lowei", "vequ")


def corpus(n=900, seed=3):
    r = random.Random(seed)
    word = lambda: "".join(r.choice(["th", "er", "an", "in", "é", "sch", "o", "ti"]) for _ in range(r.randrange(1, 5)))
    texts, toxic = [], []
    for i in range(n):
        t = [word() + r.choice(["", "", ",", ".", ".\n"]) for _ in range(r.randrange(5, 200))]
        bad = i % 5 == 0
        for _ in range(r.randrange(1, 5) if bad else 0):
            t[r.randrange(len(t))] = r.choice(STEMS) + (word() if r.random() < 0.5 else "")
        texts.append(" ".join(t))
        toxic.append(int(bad))
    return texts, toxic


def run(symbols):
    """Marks of a clause, plain words as gaps."""
    told = [i for i, x in enumerate(symbols) if x != OTHER]
    gaps = [b - a - 1 for a, b in zip([told[0] if told else 0, *told], told)]
    gaps = [max(0, g) for g in gaps]
    return [x for x in matches([symbols[i] for i in told], gaps) if x >= 8]


def by_hand(symbols):
    """What the docstring says, word by word."""
    out = []
    for i, x in enumerate(symbols):
        if x not in (INSULT, THREAT):
            continue
        first = next((k for k, y in enumerate(symbols) if y != OTHER), 0)
        negated = any(symbols[k] == NEGATION for k in range(max(first, i - SCOPE), i))
        reported = REPORT in symbols[:i]
        near = TARGET in symbols[i + 1 : i + 1 + NEXT]
        if x == INSULT:
            out.append(marked(0, negated, reported, TARGET in symbols))
        elif near:
            out.append(marked(1, negated, reported, 1))
    return out


def test_grammar():
    assert run([INSULT]) == [marked(0, 0, 0, 0)]
    assert run([NEGATION, OTHER, INSULT]) == [marked(0, 1, 0, 0)]
    assert run([NEGATION, *[OTHER] * 9, INSULT]) == [marked(0, 0, 0, 0)]
    assert run([REPORT, NEGATION, TARGET, INSULT, INSULT]) == [marked(0, 1, 1, 1)] * 2
    assert run([THREAT, OTHER, TARGET]) == [marked(1, 0, 0, 1)] and run([TARGET, THREAT]) == run([THREAT, *[OTHER] * 9, TARGET]) == []


@pytest.mark.parametrize("seed", range(4))
def test_grammar_by_hand(seed):
    r = random.Random(seed)
    for _ in range(400):
        symbols = [r.choice([OTHER] * 5 + [INSULT, THREAT, TARGET, NEGATION, REPORT]) for _ in range(r.randrange(14))]
        assert run(symbols) == by_hand(symbols), symbols


def seen(texts, stems):
    data = [t.encode() for t in texts]
    return evidence(Lexicon(stems), np.frombuffer(b"".join(data), np.uint8), np.concatenate([[0], np.cumsum([len(d) for d in data])]))


def test_clauses():
    e = seen(["You are an IDIOT. Fine.", "not an idiotic thing", "He said. idiot", "", "idiot you", "no. idiot", "kills you", "Beat the eggs."], {"idiot": (4.0, False)})
    assert [int(np.flatnonzero(x)[0]) if x.any() else None for x in e] == [4, 1, 0, None, 4, 0, 12, None]


def test_scores_by_hand():
    """Evidence and scores of whole texts against the words' symbols, clause by clause."""
    stems = {"idiot": (4.0, False), "krush": (2.5, True)}
    kind = {"you": TARGET, "not": NEGATION, "said": REPORT, "idiots": INSULT, "idiot": INSULT, "krushing": THREAT, "kill": THREAT}
    weight = {"idiots": 4.0, "idiot": 4.0, "krushing": 2.5, "kill": 3.0}
    r = random.Random(7)
    texts = ["".join(r.choice([*kind, *["plain"] * 6]) + r.choice([" ", " ", ", ", ". ", "\n"]) for _ in range(r.randrange(60))) for _ in range(80)]
    want = np.zeros((len(texts), KINDS))
    for i, t in enumerate(texts):
        for clause in t.replace("\n", ".").split("."):
            own = clause.replace(",", " ").split()
            symbols = [kind.get(w, OTHER) for w in own]
            at = [k for k, x in enumerate(symbols) if x == INSULT or x == THREAT and TARGET in symbols[k + 1 : k + 1 + NEXT]]
            for k, m in zip(at, by_hand(symbols), strict=True):
                want[i, m - 8] += weight[own[k]]
    got = seen(texts, stems)
    assert np.allclose(got, want) and want.any(axis=0).sum() >= 8
    model = Model(stems)
    z = [model.bias + sum(w * np.log1p(x) for w, x in zip(model.weights, row)) for row in want]
    assert np.allclose(model.scores(got), [1 / (1 + np.exp(-x)) for x in z])
    alone = model.scores(seen(["idiot", "kill kill kill kill", "Beat the eggs. Attack the problem.", "", "You idiot"], stems))
    assert len(set(alone[:4])) == 1 and alone[4] > 4 * alone[0]


def test_held_out(spark, docs):
    texts, toxic = corpus()
    labels = spark.createDataFrame([(i, 1, t) for i, t in enumerate(toxic)] + [(None, 1, 1), (3, 1, None)], "doc_id bigint, quality int, toxic int")
    d = docs(texts)
    model = fit(d, labels)
    rows = {r.doc_id: r.score for r in score(d.selectExpr("*", "9 as score"), model).collect()}
    out = [i for i in range(len(texts)) if zlib.crc32(str(i).encode()) % 3 == 1]
    assert np.mean([(rows[i] >= 0.7) == toxic[i] for i in out]) > 0.99
    kept = keep_clean(d, labels)
    assert kept.columns == d.columns
    assert abs(kept.count() - toxic.count(0)) <= 3


def test_edges(spark, docs):
    none = spark.createDataFrame([], "doc_id bigint, quality int, toxic int")
    d = docs([None, "", "kill you all", "x"])
    rows = {r.doc_id: r.score for r in score(d, fit(d, none)).collect()}
    assert len(rows) == 4 and rows[0] == rows[1] == rows[3] < 0.7
    assert score(docs([]), fit(docs([]), none)).count() == 0


def test_near_copies_once_and_only_they(spark, docs):
    r = random.Random(4)
    plain = lambda: "".join(r.choice("abcdefghij") for _ in range(5))
    texts = ["unrelated commonlongword " + " ".join(plain() for _ in range(40)) for _ in range(30)]
    base = texts[0].split()
    texts += [" ".join([*base[:-2], plain(), plain()]) for _ in range(6)] + [texts[1], "", "?"]
    toxic = [i % 2 for i in range(30)] + [0, 0, 0, 1, 1, 1] + [1, 0, 0]
    rows = [(i, t, x) for i, (t, x) in enumerate(zip(texts, toxic))]
    got = near_copies_once(spark.createDataFrame(rows, "doc_id bigint, text string, toxic int").repartition(3)).collect()
    assert sorted(map(tuple, got)) == [x for x in rows if x[0] < 30 or x[0] in (33, 37)]
    labels = spark.createDataFrame([(i, 1, t) for i, t in enumerate(toxic)], "doc_id bigint, quality int, toxic int")
    want = {(t, x) for i, t, x in rows if i < 30 and zlib.crc32(str(i).encode()) % 3 != 1}
    assert want <= {tuple(x) for x in training_rows(docs(texts), labels).collect()}


def test_threats_are_learned(spark, docs):
    r = random.Random(9)
    word = lambda: "".join(r.choice(["th", "er", "an", "in", "o", "ti"]) for _ in range(r.randrange(2, 5)))
    texts, toxic = [], []
    for i in range(300):
        t = [word() for _ in range(30)]
        if i % 3 == 0:
            t[10:12] = ["zukrush" + r.choice(["", "ing"]), "you"]
            t[20] = "vequ"
        texts.append(" ".join(t))
        toxic.append(int(i % 3 == 0))
    labels = spark.createDataFrame([(i, 1, t) for i, t in enumerate(toxic)], "doc_id bigint, quality int, toxic int")
    stems = fit(docs(texts), labels).stems
    assert {s: t for s, (_, t) in stems.items() if "zukrush".startswith(s) or s.startswith("veq")} == {**{s: True for s in stems if s.startswith("zuk")}, **{s: False for s in stems if s.startswith("veq")}}
    assert any(t for _, t in stems.values()) and not all(t for _, t in stems.values())


def test_long_texts_repeats_and_null_ids(spark, docs):
    texts, toxic = corpus()
    labels = spark.createDataFrame([(i, 1, t) for i, t in enumerate(toxic)], "doc_id bigint, quality int, toxic int")
    model = fit(docs(texts), labels)
    long = "plain words here. " * 80_000
    rows = spark.createDataFrame([(1, long), (1, long + "lowei lowei idiot vequ"), (None, "idiot idiot lowei"), (None, "idiot idiot lowei"), (2, None)], "doc_id bigint, text string")
    got = score(rows.selectExpr("*", "1 as toxic", "2 as found"), model).collect()
    by = {(r.doc_id, len(r.text or "")): r.score for r in got}
    assert len(got) == 5 and by[1, len(long)] == by[2, 0] < 0.7 <= by[1, len(long) + 22] and by[None, 17] >= 0.7
