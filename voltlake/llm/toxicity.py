"""Toxicity by a weighted finite-state grammar of clauses.

A lexical transducer writes each word as a symbol: insult, threat, target, negation, reported
speech or other. Stems of insults and threats are learned from labelled rows: the shortest
beginnings of words that are far likelier in toxic texts; those that mostly have a target
right after them are threats, as are a few fixed verbs. Further transducers rewrite the symbols
of a clause from left to right: negation marks what follows within a few words, reported speech
the rest of its clause, a target the insults after it. Their composition is built once. A last
transducer reads its output from right to left, so that a target also marks what stands before
it: any insult, and threats within a few words. A threat without a target is no match.

A document's evidence is the weight of the matched insults and threats of its clauses, by kind
of mark; its score is the logistic of the kinds' learned weights. Before anything is learned an
insult that is aimed at nobody weighs nothing; labels may give it a weight.

Fitting reads at most `FIT_ROWS` labelled rows of each class, chosen by a hash of their id, as
a documented bound, near copies of equal label once; scoring reads every whole text. How common
and how telling a stem must be is chosen among `SETTINGS` by the log loss over `FOLDS` folds of
those training rows alone. Labels are the only thing taken from the label table; no other column
than the text enters a score.

Defined results: an empty or null text has the evidence zero, as has one without a match; a
very long one is read whole. Without labels of both classes the lexicon is empty and the score
is the prior. A document labelled twice counts as toxic if any label says so; null labels and
ids are left out of fitting, rows without an id are scored. Repeated rows score alike. A column
`score` of the input is replaced; others pass through.
"""

from __future__ import annotations

import zlib
from dataclasses import dataclass, field
from functools import reduce
from operator import add, or_

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ._spark import arrow_limits, cut, shared_dir, table
from ._text import ALNUM, U, blocks, byte_class, lower, mix, prefix_sums, span_hashes, words

FIT_ROWS = 4000
STEM_BYTES = range(3, 13)
#: Candidates for the least number of toxic rows and the least log-odds of a stem.
SETTINGS = ((8, 4.0), (4, 4.0), (8, 2.5), (4, 2.5))
FOLDS = 3
#: Words after a threat within which its target stands.
NEXT = 3
#: A stem of which so many toxic rows have a target next to it is a threat.
AIMED = 0.5
MAX_STEMS = 5000
THRESHOLD = 0.7
SCOPE = 4
#: Near copies: word sets of this Jaccard or more, met in one of so many bands of min-hashes.
NEAR = 0.7
BANDS, BAND = 20, 3

OTHER, INSULT, THREAT, TARGET, NEGATION, REPORT = range(6)
#: Function words of the grammar in the corpus's four languages.
WORDS = {
    TARGET: "you your yours they them he she him her du dich dir ihr euch tu te toi vous ils elle tú ti usted vosotros ellos",
    NEGATION: "not no never isn't aren't wasn't nicht kein keine nie pas jamais ne aucun nunca jamás ningún",
    REPORT: "said says wrote quoted claimed reported sagte schrieb berichtete dit disait écrit dijo escribió afirmó",
    #: Stems.
    THREAT: "kill hurt destroy beat burn attack töten schlagen tuer frapper matar golpear",
}
CLAUSE_END = byte_class(lambda b: b in b".!?;\n\r")


@dataclass
class Transducer:
    """arcs: (state, symbol) to (state, symbol); what has no arc passes unchanged."""

    start: object
    arcs: dict = field(default_factory=dict)

    def step(self, state, symbol):
        return self.arcs.get((state, symbol), (state, symbol))

    def states(self) -> set:
        return {self.start, *(s for s, _ in self.arcs), *(s for s, _ in self.arcs.values())}


def compose(first: Transducer, second: Transducer, alphabet: set) -> Transducer:
    """The transducer that rewrites by the first, then by the second."""
    out = Transducer((first.start, second.start))
    todo, done = [out.start], set()
    while todo:
        state = todo.pop()
        if state in done:
            continue
        done.add(state)
        for symbol in alphabet:
            a, middle = first.step(state[0], symbol)
            b, last = second.step(state[1], middle)
            out.arcs[state, symbol] = ((a, b), last)
            todo.append((a, b))
    return out


#: Symbols of marked insults and threats: 8 + 8 * threat + 1 * negated + 2 * reported + 4 * aimed.
def marked(threat: int, negated: int, reported: int, aimed: int) -> int:
    return 8 + 8 * threat + negated + 2 * reported + 4 * aimed


KINDS = 16


def negation_transducer() -> Transducer:
    """State: words for which the negation still holds."""
    t = Transducer(0)
    for s in range(SCOPE + 1):
        left = max(0, s - 1)
        for symbol in (OTHER, TARGET, REPORT):
            t.arcs[s, symbol] = (left, symbol)
        t.arcs[s, NEGATION] = (SCOPE, OTHER)
        t.arcs[s, INSULT] = (left, marked(0, int(s > 0), 0, 0))
        t.arcs[s, THREAT] = (left, marked(1, int(s > 0), 0, 0))
    return t


def report_transducer() -> Transducer:
    t = Transducer(0, {(0, REPORT): (1, OTHER), (1, REPORT): (1, OTHER)})
    for m in range(8, 8 + KINDS):
        if not m & 2:
            t.arcs[1, m] = (1, m | 2)
    return t


def target_transducer() -> Transducer:
    """Marks the insults after a target; targets stay, for the way back."""
    t = Transducer(0, {(0, TARGET): (1, TARGET), (1, TARGET): (1, TARGET)})
    for m in range(8, 8 + KINDS // 2):
        if not m & 4:
            t.arcs[1, m] = (1, m | 4)
    return t


def returning_transducer() -> Transducer:
    """Reads a clause's marked symbols from its end. State: (whether a target was met, words for
    which it is near). Insults before a target are marked; threats near it are, others go."""
    t = Transducer((0, 0))
    for met, near in ((0, 0), *((1, k) for k in range(NEXT + 1))):
        after = (met, max(0, near - 1))
        t.arcs[(met, near), OTHER] = (after, OTHER)
        t.arcs[(met, near), TARGET] = ((1, NEXT), OTHER)
        for m in range(8, 8 + KINDS):
            threat = m - 8 >= KINDS // 2
            t.arcs[(met, near), m] = (after, (m | 4 if near else OTHER) if threat else m | 4 if met else m)
    return t


ALPHABET = {OTHER, INSULT, THREAT, TARGET, NEGATION, REPORT}
GRAMMAR = compose(compose(negation_transducer(), report_transducer(), ALPHABET), target_transducer(), ALPHABET)
RETURNING = returning_transducer()
#: How much of its stem's weight a kind carries before anything is learned.
PRIOR = np.array([(1 + 0.5 * (k >> 3 & 1)) * (0.3 if k & 1 else 1) * (0.5 if k & 2 else 1) * (1.2 if k & 4 else 0) for k in range(KINDS)])
PRIOR_BIAS = -3.0


def folded(raw: np.ndarray) -> np.ndarray:
    """Lower-cased A-Z and the capitals of Latin-1."""
    buf = lower(raw).copy()
    if len(buf) > 1:
        second = buf[1:]
        second[(buf[:-1] == 0xC3) & (second >= 0x80) & (second <= 0x9E) & (second != 0x97)] += 0x20
    return buf


class Lexicon:
    """Symbols and weights of words: by stem, of some bytes, or by whole word. `stems` gives
    each stem's weight and whether it is a threat's."""

    def __init__(self, stems: dict[str, tuple[float, bool]]) -> None:
        entries: dict[tuple[int, bool], list[tuple[int, int, float]]] = {}
        for symbol, text in WORDS.items():
            for w in text.split():
                self._put(entries, w, symbol != THREAT, symbol, 3.0 if symbol == THREAT else 0.0)
        for stem, (weight, threat) in stems.items():
            self._put(entries, stem.removesuffix("$"), stem.endswith("$"), THREAT if threat else INSULT, weight)
        self.tables = []
        for (size, whole), rows in sorted(entries.items()):
            rows = sorted({r[0]: r for r in rows}.values())
            self.tables.append((size, whole, np.array([r[0] for r in rows], np.uint64), np.array([r[1] for r in rows]), np.array([r[2] for r in rows])))

    @staticmethod
    def _put(entries, word: str, whole: bool, symbol: int, weight: float) -> None:
        b = np.frombuffer(word.encode(), np.uint8)
        h = int(span_hashes(b, np.array([0]), np.array([len(b)]))[0])
        entries.setdefault((len(b), whole), []).append((h, symbol, weight))

    def read(self, buf, starts, ends, sums) -> tuple[np.ndarray, np.ndarray]:
        symbol, weight = np.zeros(len(starts), np.int8), np.zeros(len(starts))
        size = ends - starts
        for n, whole, keys, symbols, weights in self.tables:
            long = np.flatnonzero(size == n if whole else size >= n)
            if not len(long):
                continue
            h = span_hashes(buf, starts[long], starts[long] + n, sums=sums)
            at = np.minimum(np.searchsorted(keys, h), len(keys) - 1)
            hit = keys[at] == h
            long, at = long[hit], at[hit]
            more = (weights[at] > weight[long]) | (symbol[long] == OTHER)
            symbol[long[more]], weight[long[more]] = symbols[at[more]], weights[at[more]]
        return symbol, weight


def matches(symbols: list[int], gaps: list[int]) -> list[int]:
    """A clause's marked symbols, in order; gaps: the plain words before each symbol. The
    grammar reads it from left to right, the returning transducer what comes out, backwards."""
    state, out = GRAMMAR.start, []
    for symbol, gap in zip(symbols, gaps):
        for _ in range(min(gap, SCOPE)):
            state, _ = GRAMMAR.step(state, OTHER)
        state, o = GRAMMAR.step(state, symbol)
        out.append(o)
    state, back, gap = RETURNING.start, [], 0
    for o, before in zip(out[::-1], gaps[::-1]):
        for _ in range(min(gap, NEXT)):
            state, _ = RETURNING.step(state, OTHER)
        state, o = RETURNING.step(state, o)
        back.append(o)
        gap = before
    return back[::-1]


class Clauses:
    """The words of a block, the clause of each, and the prefix sums that hash them."""

    def __init__(self, raw: np.ndarray, offsets: np.ndarray) -> None:
        self.buf, self.n = folded(raw), len(offsets) - 1
        self.starts, self.ends, self.rows = words(self.buf, offsets, ALNUM)
        if len(self.starts):
            self.sums = prefix_sums(self.buf)
            self.clause = np.cumsum(CLAUSE_END[self.buf])[self.starts] + self.rows

    def evidence(self, lexicon: Lexicon) -> np.ndarray:
        """For each row the summed weight of each kind of marked insult or threat."""
        out = np.zeros((self.n, KINDS))
        if not len(self.starts):
            return out
        symbol, weight = lexicon.read(self.buf, self.starts, self.ends, self.sums)
        core = np.unique(self.clause[(symbol == INSULT) | (symbol == THREAT)])
        told = np.flatnonzero(symbol)
        told = told[np.isin(self.clause[told], core, kind="sort")]
        if not len(told):
            return out
        clause, marks = self.clause[told], []
        edges = [0, *(np.flatnonzero(clause[1:] != clause[:-1]) + 1).tolist(), len(told)]
        gaps = np.diff(told, prepend=told[0]) - 1
        gaps[edges[:-1]] = 0
        symbols, gaps = symbol[told].tolist(), gaps.tolist()
        for a, b in zip(edges, edges[1:]):
            marks += matches(symbols[a:b], gaps[a:b])
        marks = np.array(marks)
        hit = marks >= 8
        np.add.at(out, (self.rows[told[hit]], marks[hit] - 8), weight[told[hit]])
        return out


def evidence(lexicon: Lexicon, raw: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    return Clauses(raw, offsets).evidence(lexicon)


@dataclass
class Model:
    stems: dict[str, tuple[float, bool]]
    bias: float = PRIOR_BIAS
    weights: np.ndarray = field(default_factory=lambda: PRIOR.copy())

    def scores(self, found: np.ndarray) -> np.ndarray:
        z = self.bias + np.log1p(found) @ self.weights
        return 1 / (1 + np.exp(-z))


_TARGETS = Lexicon({})


def _near_targets(own: Clauses) -> np.ndarray:
    """Which words have a target within the next `NEXT` words of their clause."""
    target = _TARGETS.read(own.buf, own.starts, own.ends, own.sums)[0] == TARGET
    out = np.zeros(len(target), bool)
    for k in range(1, NEXT + 1):
        out[:-k] |= target[k:] & (own.clause[k:] == own.clause[:-k])
    return out


def fold_of(texts: pa.Array) -> np.ndarray:
    """A training row's fold, by its text alone."""
    return np.array([zlib.crc32((t or "").encode()) % FOLDS for t in texts.to_pylist()], np.int64)


def _stem_step(wanted):
    """Document frequencies of stems, by fold; with `wanted`, of those alone."""

    def run(batches):
        keep = None if wanted is None else wanted.value
        for part, raw, offsets in blocks(batches):
            own = Clauses(raw, offsets)
            if not len(own.starts):
                continue
            buf, starts, ends, rows = own.buf, own.starts, own.ends, own.rows
            toxic = np.asarray(part.column(part.schema.get_field_index("toxic")).to_numpy(zero_copy_only=False), np.int64)
            fold, aimed = fold_of(part.column(part.schema.get_field_index("text"))), _near_targets(own)
            found: list[tuple] = []
            data = buf.tobytes()
            for n in (*STEM_BYTES, 0):  # 0: the whole word
                use = np.flatnonzero(ends - starts >= max(n, 3))
                to = starts[use] + n if n else ends[use]
                # no stem ends inside a character
                whole = np.ones(len(use), bool) if not n else (np.append(buf, 0)[to] & 0xC0) != 0x80
                use, to = use[whole], to[whole]
                if not len(use):
                    continue
                h = span_hashes(buf, starts[use], to, sums=own.sums)
                order = np.lexsort((~aimed[use], rows[use], h))  # of a row's occurrences one that is aimed
                fresh = np.r_[True, (h[order][1:] != h[order][:-1]) | (rows[use][order][1:] != rows[use][order][:-1])]
                once = order[fresh]
                _, first, number = np.unique(h[once], return_index=True, return_inverse=True)
                row = rows[use[once]]
                cell = number * FOLDS + fold[row]
                t = np.bincount(cell, weights=toxic[row], minlength=len(first) * FOLDS).reshape(-1, FOLDS)
                c = np.bincount(cell, minlength=len(first) * FOLDS).reshape(-1, FOLDS) - t
                m = np.bincount(cell, weights=toxic[row] * aimed[use[once]], minlength=len(first) * FOLDS).reshape(-1, FOLDS)
                for k, x in zip(once[first].tolist(), np.stack([t, c, m], axis=2).astype(np.int64).tolist()):
                    stem = data[starts[use[k]] : to[k]].decode("utf-8", "replace") + ("" if n else "$")
                    if keep is None or stem in keep:
                        found += [(stem, f, *v) for f, v in enumerate(x) if v[0] or v[1]]
            columns = list(zip(*found)) or [()] * 5
            yield pa.RecordBatch.from_arrays([pa.array(columns[0], pa.string()), *(pa.array(x, pa.int64()) for x in columns[1:])], names=["stem", "fold", "toxic", "clean", "aimed"])

    return run


def _counts(rows: DataFrame, wanted=None) -> DataFrame:
    found = rows.select("text", "toxic").mapInArrow(_stem_step(wanted), "stem string, fold bigint, toxic bigint, clean bigint, aimed bigint")
    return found.groupBy("stem", "fold").agg(F.sum("toxic").alias("toxic"), F.sum("clean").alias("clean"), F.sum("aimed").alias("aimed"))


def choose_stems(counts: dict[str, np.ndarray], n_toxic: int, n_clean: int, min_toxic: int, min_log_odds: float) -> dict[str, tuple[float, bool]]:
    """The shortest stems of enough toxic rows and log-odds; a longer one only where it is
    much better than its beginnings. counts: toxic, clean and aimed rows of each stem."""
    odds = lambda t, c: float(np.log((t + 0.5) / (n_toxic + 1)) - np.log((c + 0.5) / (n_clean + 1)))
    good = sorted(((len(s.encode()), s, odds(t, c), bool(a >= AIMED * t)) for s, (t, c, a) in counts.items() if t >= min_toxic and odds(t, c) >= min_log_odds), key=lambda x: (x[0], x[1]))
    out: dict[str, tuple[float, bool]] = {}
    for _, stem, w, threat in good:
        word = stem.removesuffix("$")
        above = max((out.get(word[:k], (0.0, False))[0] for k in range(1, len(word) + (stem != word))), default=0.0)
        if w > above + 1.0 or not above:
            out[stem] = (w, threat)
    return dict(sorted(out.items(), key=lambda x: (-x[1][0], x[0]))[:MAX_STEMS])


def fit_logistic(x: np.ndarray, y: np.ndarray) -> tuple[float, np.ndarray]:
    """Logistic weights with a normal prior around PRIOR, by Newton steps; balanced classes.
    No kind's weight may be negative."""
    a = np.column_stack([np.ones(len(x)), np.log1p(x)])
    centre = np.append(PRIOR_BIAS, PRIOR)
    pull = np.append(0.1, np.full(KINDS, 1.0))
    b = centre.copy()
    for _ in range(40):
        p = 1 / (1 + np.exp(-np.clip(a @ b, -30, 30)))
        grad = a.T @ (p - y) + pull * (b - centre)
        hess = (a * (p * (1 - p))[:, None]).T @ a + np.diag(pull)
        step = np.linalg.solve(hess, grad)
        b = b - step * min(1.0, 2.0 / max(1e-9, np.abs(step).max()))
        b[1:] = np.maximum(b[1:], 0.0)
        if np.abs(step).max() < 1e-6:
            break
    return float(b[0]), b[1:]


def _near_step(batches):
    """Adds to each row its set of word hashes, a text without words has 0, and its band keys."""
    for part, raw, offsets in blocks(batches):
        n = part.num_rows
        buf = folded(raw)
        starts, ends, rows = words(buf, offsets, ALNUM)
        h = span_hashes(buf, starts, ends) if len(starts) else np.zeros(0, U)
        bare = np.setdiff1d(np.arange(n), rows)
        h, rows = np.concatenate([h, np.zeros(len(bare), U)]), np.concatenate([rows, bare]).astype(np.int64)
        order = np.lexsort((h, rows))
        h, rows = h[order], rows[order]
        fresh = np.r_[True, (rows[1:] != rows[:-1]) | (h[1:] != h[:-1])]
        h, rows = h[fresh], rows[fresh]
        first = np.searchsorted(rows, np.arange(n + 1))
        keys = np.zeros((n, BANDS), U)
        for i in range(BANDS * BAND):
            x = mix(h ^ U((i + 1) * 0x9E3779B97F4A7C15 & (1 << 64) - 1))
            keys[:, i // BAND] = (keys[:, i // BAND] ^ np.minimum.reduceat(x, first[:-1])) * U(0x9E3779B97F4A7C15)
        lists = lambda at, v: pa.ListArray.from_arrays(pa.array(at, pa.int32()), pa.array(v.view(np.int64)))
        names = ["doc_id", "text", "toxic", "h"]
        yield pa.RecordBatch.from_arrays(
            [*(part.column(part.schema.get_field_index(x)) for x in names), lists(first, h), lists(np.arange(n + 1) * BANDS, keys.reshape(-1))], names=[*names, "words", "bands"]
        )


def near_copies_once(rows: DataFrame) -> DataFrame:
    """doc_id, text and toxic of the rows without a verified near copy of their own label among
    the rows of smaller doc_id. A band's rows are compared with its first alone, so the pairs
    grow with the rows and not with their square."""
    arrow_limits(rows.sparkSession)
    rows = rows.select("doc_id", "text", "toxic", F.xxhash64("text").alias("h")).dropDuplicates(["doc_id", "h"])
    rows = cut(rows.mapInArrow(_near_step, "doc_id bigint, text string, toxic int, h bigint, words array<bigint>, bands array<bigint>"), "training")
    keys = rows.select("toxic", F.struct("doc_id", "h").alias("id"), F.posexplode("bands").alias("band", "key"))
    first = keys.groupBy("toxic", "band", "key").agg(F.min("id").alias("first"), F.count("*").alias("n")).where("n > 1").drop("n")
    pairs = keys.join(first, ["toxic", "band", "key"]).where("id > first").select("id", "first").distinct()
    sets = rows.select(F.struct("doc_id", "h").alias("id"), "words")
    both = pairs.join(sets, "id").join(sets.select(F.col("id").alias("first"), F.col("words").alias("others")), "first")
    shared = F.size(F.array_intersect("words", "others"))
    copies = both.where(shared >= NEAR * (F.size("words") + F.size("others") - shared)).select("id.doc_id", "id.h").distinct()
    return rows.select("doc_id", "text", "toxic", "h").join(copies, ["doc_id", "h"], "left_anti").select("doc_id", "text", "toxic")


def training_rows(documents: DataFrame, labels: DataFrame, fit_rows: int = FIT_ROWS) -> DataFrame:
    """text and toxic of at most about `fit_rows` labelled documents of each class, near copies once,
    among those whose crc32(doc_id as text) mod 3 is not 1."""
    known = labels.where("doc_id is not null and toxic is not null").groupBy("doc_id").agg(F.max(F.col("toxic").cast("int")).alias("toxic"))
    known = known.where(F.pmod(F.crc32(F.col("doc_id").cast("string").cast("binary")), F.lit(3)) != 1)
    n = {r["toxic"]: r["n"] for r in known.groupBy("toxic").agg(F.count("*").alias("n")).collect()}
    share = lambda c: min(1 << 62, (fit_rows << 62) // max(1, c))  # noqa: E731  of the hashes, however many labels
    some = known.where(" or ".join(f"(toxic = {t} and shiftrightunsigned(xxhash64(doc_id), 2) < {share(c)})" for t, c in n.items() if t in (0, 1)) or "false")
    rows = documents.select("doc_id", "text").join(F.broadcast(some), "doc_id")  # at most about 2 * fit_rows ids
    # Else what is rare in a much copied text would pass for a sign of its label.
    return near_copies_once(rows.where("text is not null")).select("text", "toxic")


def _log_loss(model: Model, found: np.ndarray, toxic: np.ndarray) -> float:
    p = np.clip(model.scores(found), 1e-6, 1 - 1e-6)
    return float(-(toxic * np.log(p) + (1 - toxic) * np.log(1 - p)).mean())


def _fitted(stems, found: np.ndarray, toxic: np.ndarray) -> Model:
    return Model(stems, *fit_logistic(found, toxic))


def _telling(sizes: np.ndarray, without: int | None, min_toxic: int, min_log_odds: float):
    """Whether a stem's counts pass a setting in all folds but one, as choose_stems asks."""
    some = [f for f in range(FOLDS) if f != without]
    total = lambda c: reduce(add, (F.col(f"{c}{f}") for f in some))
    share = lambda c, n: F.log((total(c) + 0.5) / float(sizes[some, n].sum() + 1))
    return (total("toxic") >= min_toxic) & (share("toxic", 1) - share("clean", 0) >= min_log_odds - 1e-9)


def fit(documents: DataFrame, labels: DataFrame, fit_rows: int = FIT_ROWS, settings=SETTINGS) -> Model:
    spark = documents.sparkSession
    arrow_limits(spark)
    shared_dir(spark)
    rows = training_rows(documents, labels, fit_rows).checkpoint()
    n = {r["toxic"]: r["n"] for r in rows.groupBy("toxic").agg(F.count("*").alias("n")).collect()}
    if not n.get(0) or not n.get(1):
        return Model({})
    least = min(m for m, _ in settings)
    likely = _counts(rows.where("toxic = 1")).groupBy("stem").agg(F.sum("toxic").alias("toxic")).where(F.col("toxic") >= least).select("stem")
    wanted = spark.sparkContext.broadcast(set(likely.toArrow()["stem"].to_pylist()))  # of at most fit_rows texts
    sizes = np.zeros((FOLDS, 2), np.int64)
    for r in rows.groupBy(F.pmod(F.crc32(F.encode("text", "UTF-8")), F.lit(FOLDS)).alias("fold"), "toxic").agg(F.count("*").alias("n")).collect():
        sizes[r["fold"], r["toxic"]] = r["n"]

    names = [f"{c}{f}" for f in range(FOLDS) for c in ("toxic", "clean", "aimed")]
    by_fold = _counts(rows, wanted).groupBy("stem").agg(*(F.sum(F.when(F.col("fold") == int(x[-1]), F.col(x[:-1])).otherwise(0)).alias(x) for x in names))
    some = reduce(or_, (_telling(sizes, f, *setting) for setting in settings for f in (*range(FOLDS), None)))
    table_ = by_fold.where(some).select("stem", F.array(*names).alias("n")).toArrow()
    counts = {s: np.array(x, np.int64).reshape(FOLDS, 3) for s, x in zip(table_["stem"].to_pylist(), table_["n"].to_pylist())}

    def stems_of(setting, without=None):
        some = [f for f in range(FOLDS) if f != without]
        return choose_stems({s: x[some].sum(axis=0) for s, x in counts.items()}, int(sizes[some, 1].sum()), int(sizes[some, 0].sum()), *setting)

    lexicons = [stems_of(x, f) for x in settings for f in (*range(FOLDS), None)]
    got = rows.mapInArrow(_evidence_step(spark.sparkContext.broadcast([Lexicon(x) for x in lexicons])), "toxic int, fold bigint, found array<double>").collect()
    toxic, fold = np.array([r["toxic"] for r in got], float), np.array([r["fold"] for r in got])
    found = np.array([r["found"] for r in got]).reshape(len(got), len(lexicons), KINDS)
    losses = []
    for i in range(len(settings)):
        at, loss = i * (FOLDS + 1), 0.0
        for f in range(FOLDS):
            held = fold == f
            if held.any():
                model = _fitted(lexicons[at + f], found[~held, at + f], toxic[~held])
                loss += _log_loss(model, found[held, at + f], toxic[held]) * held.sum()
        losses.append(loss / len(got))
    best = int(np.argmin(losses)) * (FOLDS + 1) + FOLDS
    return _fitted(lexicons[best], found[:, best], toxic)


def _evidence_step(lexicons_of):
    def run(batches):
        for part, raw, offsets in blocks(batches):
            own = Clauses(raw, offsets)
            found = np.concatenate([own.evidence(x) for x in lexicons_of.value], axis=1)
            text = part.column(part.schema.get_field_index("text"))
            yield pa.RecordBatch.from_arrays(
                [part.column(part.schema.get_field_index("toxic")), pa.array(fold_of(text)), pa.array(list(found), pa.list_(pa.float64()))], names=["toxic", "fold", "found"]
            )

    return run


def _score_step(model_of, lexicon_of):
    def run(batches):
        for part, raw, offsets in blocks(batches):
            scores = model_of.value.scores(evidence(lexicon_of.value, raw, offsets))
            names = [x for x in part.schema.names if x != "score"]
            yield pa.RecordBatch.from_arrays([*(part.column(part.schema.get_field_index(x)) for x in names), pa.array(scores, pa.float64())], names=[*names, "score"])

    return run


def score(documents: DataFrame, model: Model) -> DataFrame:
    """Adds score, 0 to 1, to rows that have a text; other columns pass through."""
    spark = documents.sparkSession
    arrow_limits(spark)
    own = documents.drop("score")
    schema = T.StructType([*own.schema.fields, T.StructField("score", T.DoubleType())])
    return own.mapInArrow(_score_step(spark.sparkContext.broadcast(model), spark.sparkContext.broadcast(Lexicon(model.stems))), schema)


def keep_clean(documents: DataFrame, labels: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """The rows of `documents` that score under the threshold, with their own columns."""
    model, columns = fit(documents, labels), documents.columns
    rows = documents.select(F.struct(*(c for c in columns if c != "text")).alias("row"), "text")
    return score(rows, model).where(F.col("score") < threshold).select(*(F.col("text") if c == "text" else F.col("row")[c].alias(c) for c in columns))


def op8_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    scored = score(docs, fit(docs, table(spark, sf_dir, "labels")))
    held_out = F.pmod(F.crc32(F.col("doc_id").cast("string").cast("binary")), F.lit(3)) == 1
    return scored.select("doc_id", held_out.alias("held_out"), "score", F.when(F.col("score") >= THRESHOLD, 1).otherwise(0).alias("predicted"))
